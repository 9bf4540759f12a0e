"""Attachment resolution: the file under a root that belongs to each record.

A record states either an exact file name or a pattern ``Last*title*``: the name
starts with one literal and holds another after it. Literal parts are literal,
whatever characters they hold. Of several fitting files the smallest path wins.

Both cases are equi-joins between de-duplicated sides, so neither a name shared
by a third of all files nor one shared by a third of all records pairs up:

* exact: one row per base name (smallest path) meets one row per wanted name;
* pattern: each base name is cut at the lengths of wanted first literals. For the literals
  it really starts with, the rest of the name is cut once per position into pieces of GRAM
  characters, which meet the patterns by their rarest such piece; what meets is verified.
  Titles shorter than that are met by pieces of their own lengths. Pieces that no pattern
  has are dropped in place; the rest is reduced to one smallest path each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import record as R
from citeloom.session import by_rows, salted_join, stored

NAMES_PER_TASK = 20_000
GRAM = 8
SALTS = 16


def wanted_files(library: DataFrame) -> DataFrame:
    """Per record: ``exact`` name, or the literals ``lead`` and ``title`` of its pattern."""
    attachments = F.col("attachments")
    exact = R.exact_file(attachments)
    is_exact = F.get(attachments, F.lit(0))["source_filename"] == R.ARTICLE_ATTACHMENT
    is_pattern = R.has_attachment(attachments) & ~F.coalesce(is_exact, F.lit(False))
    first = R.first_author(F.col("author"))
    return library.select(
        "ord", "_id", R.file_name(attachments, first, F.col("title")).alias("fileName"),
        F.when(exact != "", exact).alias("exact"),
        F.when(is_pattern, F.replace(first, F.lit("...  "), F.lit("... "))).alias("lead"),
        F.when(is_pattern, R.glob_title(F.col("title"))).alias("title"),
    )


def list_paths(paths: DataFrame, path: str = "path") -> DataFrame:
    return paths.select(
        F.col(path).alias("path"), F.substring_index(path, "/", -1).alias("basename")
    )


def rarest_grams(patterns: DataFrame) -> DataFrame:
    """Per pattern the piece of its title to look for: lead, title, gram.

    Of the title's pieces of GRAM characters it is the one that occurs least in the patterns
    of the same first literal; a shorter title is its own piece.
    """
    length = F.char_length("title")
    at = F.explode(F.sequence(F.lit(1), F.greatest(length - GRAM + 1, F.lit(1)))).alias("at")
    pieces = patterns.select("lead", "title", at).select(
        "lead", "title", F.substr("title", F.col("at"), F.lit(GRAM)).alias("gram")
    )
    counts = pieces.groupBy("lead", "gram").agg(F.count("*").alias("n"))
    return pieces.join(counts, ["lead", "gram"]).groupBy("lead", "title").agg(
        F.min(F.struct("n", "gram"))["gram"].alias("gram")
    )


def resolve_patterns(patterns: DataFrame, names: DataFrame) -> DataFrame:
    """(lead, title, path) for distinct patterns; ``names`` is a stored table of one path
    per base name, cut by row count because each name yields some dozen pieces."""
    index = stored(rarest_grams(patterns), "grams")
    # Piece lengths per first literal: one unless there are short titles.
    sizes = index.groupBy("lead").agg(F.collect_set(F.char_length("gram")).alias("sizes"))
    leads = stored(sizes, "leads")
    lead_sizes = leads.agg(F.collect_set(F.char_length("lead"))).scalar()
    tasks = by_rows(names, "basename", NAMES_PER_TASK)
    headed = tasks.withColumn("lead_sizes", lead_sizes).select(
        "path", "basename",
        F.explode(
            F.filter("lead_sizes", lambda n: n <= F.char_length("basename"))
        ).alias("n"),
    )
    # The empty literal starts every name, so the join must not gather by literal alone.
    heads = headed.withColumn("lead", F.expr("left(basename, n)"))
    starting = salted_join(heads, leads, ["lead"], "basename", SALTS)
    sized = starting.select(
        "path", "lead", F.expr("substr(basename, n + 1)").alias("rest"),
        F.explode("sizes").alias("size"),
    ).filter(F.col("size") <= F.char_length("rest"))
    # An empty title stands everywhere; one position is enough for it.
    last_start = F.when(F.col("size") == 0, 1).otherwise(F.char_length("rest") - F.col("size") + 1)
    pieces = sized.select(
        "path", "lead", "rest", F.explode(_distinct_pieces(last_start)).alias("gram")
    )
    met = salted_join(pieces, index, ["lead", "gram"], "path", SALTS)
    fitting = met.filter(F.contains("rest", "title"))
    return fitting.groupBy("lead", "title").agg(F.min("path").alias("path"))


def _distinct_pieces(last_start: Column) -> Column:
    starts = F.sequence(F.lit(1), last_start)
    return F.array_distinct(F.transform(starts, lambda at: F.substr("rest", at, F.col("size"))))


def resolve_files(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """ord, _id, fileName and the resolved path (NULL when no file fits)."""

    def key_of(kind: str, a: Column, b: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))

    exact_key = key_of("exact", F.col("exact"), F.lit(""))
    pattern_key = key_of("pattern", F.col("lead"), F.col("title"))
    # A record without attachment gets a key of its own: it matches nothing, and the
    # many such records do not meet in one task.
    own_key = key_of("none", F.col("ord").cast("string"), F.lit(""))
    key = (
        F.when(F.col("exact").isNotNull(), exact_key)
        .when(F.col("lead").isNotNull(), pattern_key)
        .otherwise(own_key)
    )
    names = stored(files.groupBy("basename").agg(F.min("path").alias("path")), "names")
    asked = wanted.filter(F.col("lead").isNotNull()).select("lead", "title").distinct()
    patterns = stored(asked, "patterns")
    by_name = names.select(key_of("exact", F.col("basename"), F.lit("")).alias("key"), "path")
    by_pattern = resolve_patterns(patterns, names).select(pattern_key.alias("key"), "path")
    # The resolved side has one row per key, so a hot key is skewed on the record side
    # only, and adaptive execution splits that.
    return (
        wanted.withColumn("key", key)
        .join(by_name.unionByName(by_pattern), "key", "left")
        .select("ord", "_id", "fileName", "path")
    )
