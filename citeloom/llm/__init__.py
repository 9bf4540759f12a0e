"""Operators of a training-data pipeline, each a Spark job over tables of any size."""
