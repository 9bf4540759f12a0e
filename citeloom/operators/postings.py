"""The positional word table and searches over it.

One row per (word, column, record) with the sorted positions as an array, and the record's
id, order key and year alongside so that ranking needs no join back to the records. ``rec``
is the key of the stored record; ``_id`` may be absent or repeated. Stored in segments: a file
holds all words of its records, sorted by word and year, so that equality, prefix and year
filters prune its pages. Records are dealt to segments before their words are listed: the
table itself, several times the texts, is never shuffled, a task sorts no more than a segment,
and a word that fills a third of the table lies in all of them. ``build_postings`` is the same
with a row per position; every search takes either form.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.functions.tokens import fold, raw_words, words
from citeloom.operators.clauses import (
    SCOPES, Clause, InScope, Near, Phrase, combine, leaves, required_words, scope_keys,
)
from citeloom.operators.normalize import RECORD_COLUMNS
from citeloom.session import fits_broadcast

RECORD_KEY = ["rec", "_id", "ord", "year"]
ROWS_PER_FILE = 2_000_000  # occurrences; a task sorts them in memory
MASK_BITS = 62
MAX_RARE_ROWS = 1_000_000  # a broadcast of at most that many record keys
MIN_HOT_ROWS = 1_000_000  # below this a word's postings are shuffled as they are
BAND_ROWS = 1_000  # words with fewer rows are read whole by every search


def keyed(records: DataFrame, batch: int = 0) -> DataFrame:
    """Records with ``rec``, unique and rising in file order once they are written.

    A table that has it keeps it; batches of one table pass their number. The key is
    made where records are written, so it is the same for all who read them.
    """
    if "rec" in records.columns:
        return records
    position = F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")
    return records.withColumn("rec", F.concat(F.lit(f"{batch:08x}"), position))


def build_postings(records: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Narrow: each record yields its words; nothing is shuffled until the table is written."""
    columns = columns or RECORD_COLUMNS
    records = keyed(records)
    fields = F.array(
        *[F.struct(F.lit(c).alias("col"), raw_words(F.col(c)).alias("words")) for c in columns]
    )
    per_column = records.select(*RECORD_KEY, F.inline(fields))
    return per_column.select(
        *RECORD_KEY, "col", F.posexplode("words").alias("pos", "word")
    ).select(fold(F.col("word")).alias("term"), "col", "pos", *RECORD_KEY)


def _word_runs(every: Column) -> Column:
    """The words of one text as structs (term, positions), by one sort of its words."""
    placed = F.sort_array(F.transform(every, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def runs(s: Column) -> Column:
        opens = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda k: (k == 0) | (F.get(s, k)["w"] != F.get(s, F.greatest(k - 1, F.lit(0)))["w"]),
        )

        def lists(starts: Column) -> Column:
            def one(at: Column, n: Column) -> Column:
                end = F.coalesce(F.get(starts, n + 1), F.size(s))
                own = F.slice(s, at + 1, end - at)
                return F.struct(
                    F.get(s, at)["w"].alias("term"), F.transform(own, lambda x: x["i"]).alias("positions")
                )

            return F.transform(starts, one)

        return F.get(F.transform(F.array(opens), lists), F.lit(0))

    # Variables of a lambda are computed once, however often they are named in it.
    return F.when(F.size(every) > 0, F.get(F.transform(F.array(placed), runs), F.lit(0)))


def position_lists(records: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per word, column and record: term, col, positions (sorted, from 0) and the
    record's key. Narrow: a record's own words are put together without a shuffle."""
    columns = columns or RECORD_COLUMNS
    return _lists(records, [F.struct(F.lit(c).alias("col"), F.col(c).alias("text")) for c in columns])


def _lists(records: DataFrame, cells: list[Column], *scopes: str) -> DataFrame:
    """Texts become rows first, so that one expression cuts them all."""
    texts = keyed(records).select(*RECORD_KEY, *scopes, F.inline(F.array(*cells)))
    cut = texts.select(*RECORD_KEY, *scopes, "col", raw_words(fold(F.col("text"))).alias("words"))
    runs = _word_runs(F.col("words"))
    if scopes:
        runs = F.when(F.col("col").isNotNull(), runs).otherwise(F.col("scopes"))
    found = cut.select(*RECORD_KEY, "col", F.inline(runs))
    col = F.coalesce("col", F.substring_index("term", ":", 1)).alias("col")
    return found.select("term", col, "positions", *RECORD_KEY)


def record_lists(records: DataFrame) -> DataFrame:
    """``position_lists`` and ``scope_lists`` of the same records in one pass."""
    cells = [F.struct(F.lit(c).alias("col"), F.col(c).alias("text")) for c in RECORD_COLUMNS]
    none = F.lit(None).cast("string")
    named = F.transform(
        _scope_terms(), lambda t: F.struct(t.alias("term"), F.array(F.lit(0)).alias("positions"))
    )
    rows = keyed(records).withColumn("scopes", named)
    return _lists(rows, [*cells, F.struct(none.alias("col"), none.alias("text"))], "scopes")


def occurrences(lists: DataFrame) -> DataFrame:
    """Position lists as rows of ``build_postings``."""
    rows = lists.filter(~F.col("term").startswith("@"))
    return rows.select("term", "col", F.explode("positions").alias("pos"), *RECORD_KEY)


def _scope_terms() -> Column:
    """All scopes of a record as terms, each once."""

    def named_keys(kind: str) -> Column:
        return F.transform(scope_keys(kind), lambda key: F.concat(F.lit(f"@{kind}:"), key))

    named = [named_keys(kind) for kind in SCOPES]
    known = F.filter(F.flatten(F.array_compact(F.array(*named))), lambda t: t.isNotNull())
    return F.array_distinct(known)


def scope_postings(records: DataFrame) -> DataFrame:
    """One row per scope of a record, in the form of postings: scopes are searched like words."""
    rows = keyed(records).select(*RECORD_KEY, F.explode(_scope_terms()).alias("term"))
    return rows.select(
        "term", F.substring_index("term", ":", 1).alias("col"), F.lit(0).alias("pos"), *RECORD_KEY
    )


def scope_lists(records: DataFrame) -> DataFrame:
    """The scopes in the form of position lists."""
    rows = scope_postings(records)
    return rows.select("term", "col", F.array("pos").alias("positions"), *RECORD_KEY)


def band_counts(
    lists: DataFrame, least: int = BAND_ROWS, vocabulary: DataFrame | None = None
) -> DataFrame:
    """Rows per word and year of the words with many rows: term, year, n_rows.

    With the stored vocabulary, words that occur less often than that are left out before
    anything is counted; no word has more rows than occurrences.
    """
    if vocabulary is not None:
        hot = vocabulary.filter(F.col("n_occurrences") >= least).select("term")
        lists = lists.join(F.broadcast(hot) if fits_broadcast(hot) else hot, "term", "left_semi")
    counted = lists.groupBy("term", "year").agg(F.count("*").alias("n_rows"))
    whole = F.sum("n_rows").over(Window.partitionBy("term"))
    return counted.withColumn("whole", whole).filter(F.col("whole") >= least).drop("whole")


def year_cuts(bands: DataFrame, clause: Clause, limit: int, oldest_first: bool = False) -> list[str]:
    """Years to stop at, one after the other: up to the first there are some times ``limit``
    rows of the rarest required word, up to the next four times as many, and so on.

    Empty where a search is best served at once: a required word has few rows, or no word is
    required. What a cut leaves out never counts; the caller goes on until its hits are certain.
    """
    wanted = list(dict.fromkeys(required_words(clause)))
    if not wanted:
        return []
    tests = [_term_test(word, is_prefix) for word, is_prefix in wanted]
    rows = bands.filter(reduce(lambda a, b: a | b, tests)).groupBy("year").agg(
        *[F.coalesce(F.sum(F.when(t, F.col("n_rows"))), F.lit(0)).alias(f"w{i}") for i, t in enumerate(tests)]
    ).collect()
    so_far, enough, cuts = [0] * len(tests), 4 * limit, []
    for row in sorted(rows, key=lambda r: r["year"], reverse=not oldest_first):
        so_far = [a + row[f"w{i}"] for i, a in enumerate(so_far)]
        if min(so_far) >= enough:
            cuts.append(row["year"])
            enough = 4 * min(so_far)
    return cuts


def with_scopes(words_table: DataFrame, records: DataFrame, *by: str) -> DataFrame:
    """The vocabulary with the records of each scope."""
    found = records.select(*by, F.explode(_scope_terms()).alias("term")).groupBy(*by, "term").agg(
        F.count("*").alias("n_occurrences"), F.count("*").alias("n_records")
    )
    return words_table.unionByName(found)


def files_for(spark: SparkSession, n_rows: int, rows_per_file: int) -> int:
    """Files by measured rows; small tables still use all cores."""
    return max(spark.sparkContext.defaultParallelism, -(-n_rows // rows_per_file))


def write_postings(
    postings: DataFrame, path: str, n_rows: int, rows_per_file: int = ROWS_PER_FILE
) -> None:
    """``n_rows`` is the number of occurrences, which the vocabulary's add up to. Rows at hand
    are dealt by record; from records, ``write_lists`` moves less."""
    files = files_for(postings.sparkSession, n_rows, rows_per_file)
    _write_segments(postings.repartition(files, "rec"), path)


def write_lists(records: DataFrame, path: str, n_rows: int, rows_per_file: int = ROWS_PER_FILE) -> None:
    """The word table of stored records, scopes included, a segment per task. Only the records
    are shuffled."""
    files = files_for(records.sparkSession, n_rows, rows_per_file)
    _write_segments(record_lists(records.repartition(files, "rec")), path)


def _write_segments(dealt: DataFrame, path: str) -> None:
    (
        dealt.sortWithinPartitions("term", "year", "rec")
        .write.mode("overwrite")
        .option("compression", "zstd")
        .parquet(path)
    )


def vocabulary(records: DataFrame, columns: list[str] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Per word: occurrences and records, for each value of the columns ``by`` on its own.

    Counted from the records, where one record's distinct words are known without a
    shuffle; then one row per word and task travels. Counting from the postings would
    have to shuffle every (word, record) pair.
    """
    columns = columns or RECORD_COLUMNS
    every = F.flatten(F.array_compact(F.array(*[words(F.col(c)) for c in columns])))

    def lane(occurrence: int, record: int, found: Column) -> Column:
        return F.struct(
            F.lit(occurrence).alias("occurrence"), F.lit(record).alias("record"), found.alias("w")
        )

    lanes = F.array(lane(1, 0, F.col("every")), lane(0, 1, F.array_distinct("every")))
    counted = records.select(*by, every.alias("every")).select(*by, F.inline(lanes))
    return (
        counted.select(*by, "occurrence", "record", F.explode("w").alias("term"))
        .groupBy(*by, "term")
        .agg(F.sum("occurrence").alias("n_occurrences"), F.sum("record").alias("n_records"))
    )


def _word_test(phrase: Phrase, index: int) -> Column:
    is_last = index == len(phrase.words) - 1
    return _term_test(phrase.words[index], phrase.prefix and is_last)


def write_vocabulary(words_table: DataFrame, path: str) -> int:
    """Sorted by word, so that looking a few words up reads few row groups.

    Returns the number of occurrences, which is the number of postings.
    """
    (
        words_table.repartitionByRange("term")
        .sortWithinPartitions("term")
        .write.mode("overwrite")
        .parquet(path)
    )
    written = words_table.sparkSession.read.parquet(path)
    return written.agg(F.coalesce(F.sum("n_occurrences"), F.lit(0))).first()[0]


def keep_rarest(postings: DataFrame, vocabulary: DataFrame, clause: Clause) -> DataFrame:
    """Postings of the records that hold the rarest word every match must hold.

    Saves shuffling the postings of hot words that stand beside a rare one. The
    vocabulary gives the exact number of rows of each required word; the record keys
    of the rarest are broadcast only up to MAX_RARE_ROWS. Otherwise, and where no word
    is hot, nothing changes.
    """
    wanted = list(dict.fromkeys(required_words(clause)))
    if len(wanted) < 2:
        return postings
    tests = [_term_test(word, is_prefix) for word, is_prefix in wanted]
    counts = vocabulary.filter(reduce(lambda a, b: a | b, tests)).agg(
        *[F.coalesce(F.sum(F.when(t, F.col("n_occurrences"))), F.lit(0)) for t in tests]
    )
    sizes = list(counts.first())
    rarest = sizes.index(min(sizes))
    if sizes[rarest] > MAX_RARE_ROWS or max(sizes) < MIN_HOT_ROWS:
        return postings
    holders = postings.filter(tests[rarest]).select("rec")
    return postings.join(F.broadcast(holders), "rec", "left_semi")


def _term_test(word: str, is_prefix: bool) -> Column:
    return F.col("term").startswith(word) if is_prefix else F.col("term") == word


def _any_word(phrase: Phrase) -> Column:
    tests = [_word_test(phrase, i) for i in range(len(phrase.words))]
    return reduce(lambda a, b: a | b, tests)


def _in_field(postings: DataFrame, field: str | None) -> DataFrame:
    return postings if field is None else postings.filter(F.col("col") == field)


def _offsets(phrase: Phrase) -> Column:
    """The places a word has in a phrase: one value, or several rows where a word repeats."""
    hits = [F.when(_word_test(phrase, i), F.lit(i)) for i in range(len(phrase.words))]
    head, tail = phrase.words[:-1], phrase.words[-1]
    repeats = len(set(phrase.words)) < len(phrase.words)
    if repeats or (phrase.prefix and any(w.startswith(tail) for w in head)):
        return F.explode(F.array_compact(F.array(*hits)))
    return F.coalesce(*hits)


def _phrase_records(postings: DataFrame, phrase: Phrase) -> DataFrame:
    """Records that hold a phrase.

    Every matching word votes for the position its phrase would start at. A start
    with one vote per phrase word is an occurrence, so a phrase of any length takes
    one aggregation keyed by record and position, never a pairing of hot words.
    """
    size = len(phrase.words)
    rows = _in_field(postings, phrase.field).filter(_any_word(phrase))
    if "positions" in postings.columns:
        return _phrase_merge(rows, phrase)
    votes = rows.select(*RECORD_KEY, "col", "pos", _offsets(phrase).alias("offset")).select(
        *RECORD_KEY, "col", (F.col("pos") - F.col("offset")).alias("start")
    )
    return votes.groupBy(*RECORD_KEY, "col", "start").count().filter(F.col("count") == size)


def _positions_where(test: Column) -> Column:
    """All positions of the rows that pass, of one column of one record."""
    return F.flatten(F.collect_list(F.when(test, F.col("positions"))))


def _phrase_merge(lists: DataFrame, phrase: Phrase) -> DataFrame:
    """The same from position lists: a column's lists, moved to where the phrase would start,
    are cut down to what all share."""
    n = len(phrase.words)
    met = lists.groupBy(*RECORD_KEY, "col").agg(
        *[_positions_where(_word_test(phrase, i)).alias(f"p{i}") for i in range(n)]
    )
    starts = reduce(
        lambda found, i: F.array_intersect(found, F.transform(f"p{i}", lambda x: x - i)),
        range(1, n), F.col("p0"),
    )
    return met.filter(F.size(starts) > 0)


def near_test(left: Column, right: Column, distance: int | Column) -> Column:
    """Whether two position lists of one text stand close, by one walk over both in order.

    ``l`` and ``m`` are the last two positions of the left side: a word that is on both
    sides does not stand close to itself.
    """

    def side(positions: Column, mark: int) -> Column:
        return F.transform(positions, lambda p: F.struct(p.alias("p"), F.lit(mark).alias("side")))

    none = F.lit(None).cast("int")
    begin = F.struct(none.alias("l"), none.alias("m"), none.alias("r"), F.lit(False).alias("hit"))

    def step(s: Column, x: Column) -> Column:
        is_left = x["side"] == 0
        before = F.when(is_left, s["r"]).when(s["l"] < x["p"], s["l"]).otherwise(s["m"])
        return F.struct(
            F.when(is_left, x["p"]).otherwise(s["l"]).alias("l"),
            F.when(is_left, s["l"]).otherwise(s["m"]).alias("m"),
            F.when(is_left, s["r"]).otherwise(x["p"]).alias("r"),
            (s["hit"] | F.coalesce(x["p"] - before <= distance + 1, F.lit(False))).alias("hit"),
        )

    walk = F.sort_array(F.concat(side(left, 0), side(right, 1)))
    return F.aggregate(walk, begin, step, lambda s: s["hit"])


def _near_merge(lists: DataFrame, on_left: Column, on_right: Column, distance: int) -> DataFrame:
    """The same from position lists."""
    met = lists.groupBy(*RECORD_KEY, "col").agg(
        _positions_where(on_left).alias("left"), _positions_where(on_right).alias("right")
    ).filter((F.size("left") > 0) & (F.size("right") > 0))
    return met.filter(near_test(F.col("left"), F.col("right"), distance))


def _near_records(postings: DataFrame, near: Near) -> DataFrame:
    """Records where both words stand close, from one ordered pass per text.

    Only the nearest earlier word of the other side matters, so each occurrence is
    compared with one position. A window group is one column of one record.
    """
    on_left, on_right = _word_test(near.left, 0), _word_test(near.right, 0)
    if "positions" in postings.columns:
        rows = _in_field(postings, near.field).filter(on_left | on_right)
        return _near_merge(rows, on_left, on_right, near.distance)
    rows = (
        _in_field(postings, near.field)
        .filter(on_left | on_right)
        .select(*RECORD_KEY, "col", "pos", on_left.alias("l"), on_right.alias("r"))
    )
    before = (
        Window.partitionBy(*RECORD_KEY, "col")
        .orderBy("pos")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    seen = rows.withColumns(
        {
            "last_l": F.max(F.when(F.col("l"), F.col("pos"))).over(before),
            "last_r": F.max(F.when(F.col("r"), F.col("pos"))).over(before),
        }
    )
    reach = F.col("pos") - 1 - near.distance
    close = (F.col("r") & (F.col("last_l") >= reach)) | (F.col("l") & (F.col("last_r") >= reach))
    return seen.filter(close)


def matching_records(
    postings: DataFrame, clause: Clause | None, vocabulary: DataFrame | None = None
) -> DataFrame:
    """Record keys that satisfy a clause tree; with a vocabulary, rare words go first.
    No clause, no result.

    Each leaf owns a bit. One aggregation per record ors the bits, and the whole
    boolean tree is then a test on that mask; NOT needs no anti join.
    """
    if clause is None:
        return postings.select(*RECORD_KEY).limit(0)
    if vocabulary is not None:
        postings = keep_rarest(postings, vocabulary, clause)
    found = leaves(clause)

    def bits(test) -> list[Column]:
        """One long per 62 leaves, built from a test per leaf index."""
        chunks = range(0, len(found), MASK_BITS)
        return [
            reduce(
                lambda a, b: a.bitwiseOR(b),
                [test(i, 1 << (i - start)) for i in range(start, min(start + MASK_BITS, len(found)))],
            ).alias(f"m{start // MASK_BITS}")
            for start in chunks
        ]

    single = {i: leaf for i, leaf in enumerate(found) if _is_word(leaf)}
    parts = []
    if single:
        tests = {i: _word_leaf(leaf) for i, leaf in single.items()}

        def word_bit(i: int, bit: int) -> Column:
            hit = tests.get(i)
            return F.lit(0).cast("long") if hit is None else F.when(hit, bit).otherwise(0).cast("long")

        any_word = reduce(lambda a, b: a | b, tests.values())
        parts.append(postings.filter(any_word).select(*RECORD_KEY, *bits(word_bit)))
    for i, leaf in enumerate(found):
        if i in single:
            continue
        if isinstance(leaf, Near):
            rows = _near_records(postings, leaf)
        else:
            rows = _phrase_records(postings, leaf)
        own = bits(lambda j, bit, i=i: F.lit(bit if i == j else 0).cast("long"))
        parts.append(rows.select(*RECORD_KEY, *own))
    masks = reduce(DataFrame.unionByName, parts)
    names = masks.columns[len(RECORD_KEY) :]
    merged = masks.groupBy(*RECORD_KEY).agg(*[F.bit_or(m).alias(m) for m in names])

    def leaf_hit(leaf: Phrase | Near) -> Column:
        i = found.index(leaf)
        return F.col(f"m{i // MASK_BITS}").bitwiseAND(F.lit(1 << (i % MASK_BITS)).cast("long")) != 0

    return merged.filter(combine(clause, leaf_hit)).select(*RECORD_KEY)


def _is_word(leaf: Phrase | Near | InScope) -> bool:
    return isinstance(leaf, InScope) or isinstance(leaf, Phrase) and len(leaf.words) == 1


def _word_leaf(leaf: Phrase | InScope) -> Column:
    if isinstance(leaf, InScope):
        return F.col("term") == leaf.term
    test = _word_test(leaf, 0)
    return test if leaf.field is None else test & (F.col("col") == leaf.field)
