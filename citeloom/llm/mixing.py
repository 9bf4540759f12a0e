"""Mix sources to target weights: certain whole copies, then Pareto order sampling.

DataFrame functions only. The text is read once to measure sizes; everything later
works on narrow rows. A hot source is never gathered into one task: ranks are
compared through word counts per (source, rank bin), and only the bin in which a
source reaches its target is ordered, by its different rows. Of equal rows at the cut, which
may be many, some are taken by numbers that many tasks give out.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.session import salted_join, stored

WORD = r"[^\x20\x09-\x0D]+"
RANK_BINS = 4096
SALTS = 16
SHARES = 64


def print_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with ``number``, from 1 on within their keys, for few keys of any number of rows.

    The rows are written with a random share of the key's, so a task that runs again sees the
    same ones; shares are numbered on their own, behind the counts of those before them.
    """
    dealt = stored(rows.withColumn("share", F.floor(F.rand(42) * SHARES).cast("int")), "numbered")
    before = Window.partitionBy(*keys).orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*keys, "share").agg(F.count("*").alias("n")).select(
        *[F.col(k).alias(f"of_{k}") for k in keys], F.col("share").alias("of_share"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in [*keys, "share"]]
    own = F.row_number().over(Window.partitionBy(*keys, "share").orderBy(F.lit(0)))
    ranked = dealt.withColumn("own", own).join(F.broadcast(counts), reduce(and_, same))
    return ranked.withColumn("number", F.col("offset") + F.col("own")).select(*rows.columns, "number")


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def length_weight(size: Column) -> Column:
    """A mild preference for longer documents; at most some 60 different values."""
    return 1.0 + F.floor(F.log2(1.0 + size))


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: int = 3
) -> DataFrame:
    """Target words of each source.

    ``sizes`` holds one row per source: ``source`` (null allowed) and ``source_size``.
    Sources by code point, null last, get the weights in turn and share all words. A
    target stops at ``most`` times its source's size; the excess goes to the others by
    weight. That is ``min(most * size, level * weight)`` for one common level, which is
    the largest of the levels met while sources are filled in the order of cap / weight.
    The two windows see one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = sizes.withColumn("n_source", F.row_number().over(by_name) - 1)
    turn = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.col("n_source") % len(weights) + 1).cast("int"),
    )
    capped = listed.withColumn("source_weight", turn).withColumn(
        "cap", F.lit(float(most)) * F.col("source_size")
    )
    order = Window.orderBy(F.col("cap") / F.col("source_weight"), "n_source")
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ahead = F.sum("source_weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    levels = capped.withColumn("level", (F.sum("source_size").over(everything) - before) / ahead)
    target = F.least(F.col("cap"), F.max("level").over(everything) * F.col("source_weight"))
    return levels.select("source", "source_size", target.alias("target"))


def _copies_scale(classes: DataFrame, most: int) -> DataFrame:
    """Per source the factor that turns document weights into expected copies.

    ``classes`` has one row per (source, weight) with its words. Expected copies are
    ``min(most, scale * weight)`` and their words sum to the target; the scale is the
    largest level met while classes are filled from the heaviest on, as above.
    """
    order = Window.partitionBy("source_key").orderBy(F.col("weight").desc())
    before = F.coalesce(
        F.sum("class_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    ahead = F.sum(F.col("class_size") * F.col("weight")).over(
        order.rowsBetween(0, Window.unboundedFollowing)
    )
    level = F.when(ahead > 0, (F.col("target") - most * before) / ahead).otherwise(0.0)
    return classes.withColumn("level", level).groupBy("source_key").agg(F.max("level").alias("scale"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    most: int = 3,
    document_weight=length_weight,
    seed: int = 42,
    bins: int = RANK_BINS,
) -> DataFrame:
    """How often the mix takes each document.

    Each document gets expected copies in proportion to its weight, at most ``most``, so
    that the expected words of a source equal its target. The whole part is certain. The
    fraction p is an inclusion probability: documents are ranked by u / (1 - u) divided by
    p / (1 - p), with u a hash of (doc_id, size, text, seed), and taken in this order until the
    words still missing are reached; the last one is taken if that ends nearer to the
    target. So the sample's size in words is fixed and reruns agree.

    ``document_weight`` maps the size column to a weight of few distinct values (one
    window row per source and value).

    One output row per input row: doc_id, source, size, source_size, target, copies, taken,
    print (hash of the text). Null or empty text: size 0, nothing taken. Null source: a source
    of its own. Null or repeated doc_id: the row stands for itself; rows of equal id and text
    get equal ranks, and at the cut as many of them are taken as fit. Empty table: no rows.
    Other columns are ignored.
    """
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source"))
    size = word_count(F.col("text"))
    sized = stored(
        docs.select(
            "doc_id", "source", key.alias("source_key"), size.alias("size"),
            print_of(F.col("text")).alias("print"),
        ), "sized"
    ).withColumn("weight", document_weight(F.col("size")))
    classes = sized.groupBy("source_key", "weight").agg(
        F.sum("size").alias("class_size"), F.first("source").alias("source")
    )
    sources = classes.groupBy("source_key").agg(
        F.first("source").alias("source"), F.sum("class_size").alias("source_size")
    )
    targets = source_targets(sources, weights, most).withColumn(
        "source_key",
        F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source")),
    )
    with_target = classes.drop("source").join(targets, "source_key")
    scales = _copies_scale(with_target, most)
    plan = stored(targets.drop("source").join(scales, "source_key"), "targets")

    expected = F.least(F.lit(float(most)), F.col("scale") * F.col("weight"))
    mantissa = F.pmod(F.xxhash64("doc_id", "size", "print", F.lit(seed)), F.lit(1 << 52))
    u = (mantissa + F.lit(0.5)) / F.lit(float(1 << 52))
    p = F.col("expected") - F.col("whole")
    odds = u / (1 - u) * (1 - p) / p
    ranked = (
        salted_join(sized, plan, ["source_key"], "doc_id", SALTS)
        .withColumn("expected", expected)
        .withColumn("whole", F.floor("expected"))
        .withColumn("rank", F.when(p > 0, odds / (1 + odds)))
        .withColumn("bin", F.least(F.floor(F.col("rank") * bins), F.lit(bins - 1)))
    )
    sums = ranked.groupBy("source_key", "bin").agg(
        F.sum(F.col("whole") * F.col("size")).alias("certain"), F.sum("size").alias("words")
    )
    # One row per source and bin, so the windows below are bounded by the number of bins.
    per_source = Window.partitionBy("source_key")
    along = per_source.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        sums.withColumn("certain", F.sum("certain").over(per_source))
        .filter("bin is not null")
        .withColumn("before", F.coalesce(F.sum("words").over(along), F.lit(0)))
        .join(plan.select("source_key", "target"), "source_key")
        .withColumn("missing", F.col("target") - F.col("certain") - F.col("before"))
        .groupBy("source_key")
        .agg(
            F.max(F.struct(F.when(F.col("missing") > 0, F.col("bin")).alias("bin"), "missing")).alias("cut")
        )
        .select("source_key", F.col("cut.bin").alias("cut_bin"), F.col("cut.missing").alias("missing"))
    )
    placed = salted_join(ranked, stored(cuts_of_all(plan, cuts), "cuts"), ["source_key"], "doc_id", SALTS)
    at_cut = F.col("bin").eqNullSafe(F.col("cut_bin")) & F.col("bin").isNotNull()
    sure = F.coalesce((F.col("bin") < F.col("cut_bin")).cast("int"), F.lit(0))
    taken = placed.filter(~at_cut).withColumn("extra", sure).unionByName(
        _cut_bin(placed.filter(at_cut))
    )
    copies = (F.col("whole") + F.col("extra")).cast("long")
    return taken.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"), "print",
    )


def _cut_bin(rows: DataFrame) -> DataFrame:
    """``extra`` for the rows of the bin in which their source reaches its target.

    In the order of (rank, doc_id, size, print) a row is taken if the words up to its middle
    are still missing. Rows that are equal in these are one group: all groups before the last
    that takes any take all, and this one, the source's cut, ``take`` of its ``n`` rows.
    """
    place = ["rank", "doc_id", "size", "print"]
    groups = rows.groupBy("source_key", *place).agg(
        F.count("*").alias("n"), F.first("missing").alias("missing")
    )
    order = Window.partitionBy("source_key").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("missing") - F.coalesce(F.sum(F.col("n") * F.col("size")).over(order), F.lit(0))
    # The words up to the middle of row j are (j - 1/2) * size.
    fitting = F.when(F.col("size") > 0, F.ceil(left / F.col("size") + 0.5) - 1).when(left > 0, F.col("n"))
    take = F.least(F.greatest(F.coalesce(fitting, F.lit(0)), F.lit(0)), F.col("n")).cast("long")
    counted = groups.withColumn("take", take).filter(F.col("take") > 0)
    last = counted.groupBy("source_key").agg(F.max(F.struct(*place, "take", "n")).alias("cut"))
    found = salted_join(rows, stored(last, "cut"), ["source_key"], "doc_id", SALTS)
    cut = F.col("cut")
    here, there = F.struct(*place), F.struct(*[cut[c].alias(c) for c in place])
    known = found.withColumn("extra", F.when(here <= there, 1).otherwise(0)).withColumn(
        "split", (here == there) & (cut["take"] < cut["n"])
    )
    # A source without a taken row has no cut.
    without = rows.join(last.select("source_key"), "source_key", "left_anti").withColumn("extra", F.lit(0))
    whole = known.filter(~F.col("split")).drop("cut", "split").unionByName(without)
    split = known.filter("split")
    if split.isEmpty():
        return whole
    some = numbered(split.drop("split"), ["source_key"])
    extra = (F.col("number") <= cut["take"]).cast("int")
    return whole.unionByName(some.withColumn("extra", extra).drop("cut", "number"))


def cuts_of_all(plan: DataFrame, cuts: DataFrame) -> DataFrame:
    """A row for every source, also for one without fractional copies."""
    return plan.select("source_key").join(cuts, "source_key", "left")


def copied(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: each row as often as the mix takes it, with its own columns.

    Rows meet their copies by (source, doc_id, size, print). ``mix`` gives all rows of such a
    key the same count, or one more to those before the cut of the source: then as many rows
    get one more. At most one key of a source is cut so, and only its rows are numbered. Null, empty and repeated rows behave as in ``mix``. Rows travel as
    one struct, so their columns may have any names.
    """
    copies = F.col("copies")
    counts = mix(docs, **options).groupBy(
        F.col("source").alias("mix_source"), F.col("doc_id").alias("mix_id"), F.col("size").alias("mix_words"),
        F.col("print").alias("mix_print"),
    ).agg(F.min(copies).alias("fewest"), (F.sum(copies) - F.min(copies) * F.count("*")).alias("more"))
    counts = stored(counts.filter((F.col("fewest") > 0) | (F.col("more") > 0)), "copies")
    on = (
        F.col("source").eqNullSafe(F.col("mix_source"))
        & F.col("doc_id").eqNullSafe(F.col("mix_id"))
        & (F.col("mix_size") == F.col("mix_words")) & (F.col("text_print") == F.col("mix_print"))
    )
    keyed = docs.select(
        F.struct("*").alias("row"), "source", "doc_id", word_count(F.col("text")).alias("mix_size"),
        print_of(F.col("text")).alias("text_print"),
    )
    taken = keyed.join(counts.filter("more = 0"), on).withColumn("mix_copies", F.col("fewest"))
    cut = counts.filter("more > 0")
    if not cut.isEmpty():
        split = numbered(keyed.join(cut, on), ["mix_source", "mix_id", "mix_words", "mix_print"])
        extra = (F.col("number") <= F.col("more")).cast("long")
        whole = split.withColumn("mix_copies", F.col("fewest") + extra).drop("number")
        taken = taken.unionByName(whole.filter("mix_copies > 0"))
    again = F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))).alias("mix_copy")
    return taken.select("row", again).select("row.*")

