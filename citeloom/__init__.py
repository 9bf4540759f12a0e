"""Spark jobs over bibliographic libraries: ingest, normalise, facets, search."""
