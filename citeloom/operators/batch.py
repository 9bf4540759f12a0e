"""Many searches at once: a table of query clauses against the postings.

``clauses`` has (query_id, clause_no, field, term, is_prefix); a query matches the
records that satisfy all its clauses, and keeps its newest ``limit`` of them. The fields
``@label``, ``@folder`` and ``@type`` take an exact id or display type as their term.

How the work stays proportional to the data, whatever words the queries share:

* identical queries are answered once and copied to their ids at the end;
* distinct clauses ("atoms") meet the postings, not queries, so a hot word in a
  million queries is matched to its postings once;
* each query draws candidates from its rarest atom only, known from the vocabulary, and
  the other atoms are looked up for those candidates;
* the word join is salted by record, by the records of the most frequent word, so its
  postings spread over many tasks; the later joins are keyed by record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.tokens import WORD_CHARS, words
from citeloom.operators.clauses import SCOPES
from citeloom.operators.normalize import RECORD_COLUMNS
from citeloom.operators.postings import RECORD_KEY
from citeloom.operators.search import DEFAULT_LIMIT
from citeloom.session import fits_broadcast, salted_join, stored

ATOM = ["field", "word", "is_prefix"]
ROWS_PER_SALT = 1_000_000
MOST_SALTS = 1024
MOST_TERMS = 300  # words of a prefix that are joined one by one


def salts_for(atom_terms: DataFrame) -> int:
    """Tasks for the postings of the most frequent word asked for."""
    hottest = atom_terms.agg(F.coalesce(F.max("n_records"), F.lit(0))).first()[0]
    return max(1, min(MOST_SALTS, -(-hottest // ROWS_PER_SALT)))


def rows_of(
    postings: DataFrame, atoms: DataFrame, atom_terms: DataFrame, salts: int, most: int | None = None
) -> DataFrame:
    """Postings with each atom (atom, word, is_prefix and further columns) they satisfy.

    An atom meets the postings by its words (``atom_terms``) while these can be broadcast. As
    they grow with the vocabulary, they soon cannot; then a prefix of over ``most`` words meets
    the postings as it was asked. For these few, postings are cut to the lengths that occur.
    """
    if most is None:
        every = atoms.join(atom_terms.select("atom", "term"), "atom").drop("word", "is_prefix")
        if fits_broadcast(every):
            return postings.join(F.broadcast(every), "term")
        most = MOST_TERMS
    sizes = atom_terms.groupBy("atom").count().filter(F.col("count") > most).select("atom")
    broad = atoms.filter("is_prefix").join(sizes, "atom", "left_semi")
    named = atoms.join(broad.select("atom").distinct(), "atom", "left_anti")
    named = named.join(atom_terms.select("atom", "term"), "atom").drop("word", "is_prefix")
    return met_rows(postings, named, broad.drop("is_prefix"), salts)


def met_rows(postings: DataFrame, named: DataFrame, broad: DataFrame, salts: int) -> DataFrame:
    """Postings with the atoms of ``named``, by their words (term), and those of ``broad``, by
    the prefix they ask for (word)."""
    met = salted_join(postings, named, ["term"], "rec", salts)
    lengths = broad.agg(F.collect_set(F.char_length("word"))).first()[0]
    if not lengths:
        return met
    heads = [F.when(F.char_length("term") >= n, F.left("term", F.lit(n))) for n in sorted(lengths)]
    cut = postings.withColumn("word", F.explode(F.array(*heads))).filter("word is not null")
    opened = salted_join(cut, broad, ["word"], "rec", salts).drop("word")
    return met.unionByName(opened)


def _records_with(postings: DataFrame, atoms: DataFrame, atom_terms: DataFrame, salts: int) -> DataFrame:
    """(atom, record) of every posting that satisfies an atom."""
    rows = postings.select("term", "col", *RECORD_KEY)
    return (
        rows_of(rows, atoms.select("atom", *ATOM), atom_terms, salts)
        .filter((F.col("field") == "") | (F.col("field") == F.col("col")))
        .select("atom", *RECORD_KEY)
    )


def expand_prefixes(prefixes: DataFrame, vocabulary: DataFrame, salts: int = 16) -> DataFrame:
    """Prefix atoms with every word that starts with them, by equi-join.

    Words are cut to the prefix lengths that occur, and only to those.
    """
    lengths = prefixes.agg(F.collect_set(F.char_length("word"))).scalar()
    cut = (
        vocabulary.withColumn("lengths", lengths)
        .select(
            "term", "n_records",
            F.explode(F.filter("lengths", lambda n: n <= F.char_length("term"))).alias("size"),
        )
        .select("term", "n_records", F.expr("left(term, size)").alias("word"))
    )
    return salted_join(cut, prefixes, ["word"], "term", salts)


def _column_of(field: Column) -> Column:
    """The record column a field name means, '' for any column. Other names fail the job."""
    scopes = [f"@{kind}" for kind in SCOPES]
    by_name = F.create_map(*[F.lit(x) for c in [*RECORD_COLUMNS, *scopes] for x in (c.lower(), c)])
    known = F.coalesce(
        by_name[F.lower(field)], F.raise_error(F.concat(F.lit("unknown field "), field))
    )
    return F.when(field.isNull(), F.lit("")).otherwise(known)


def _one_word(term: Column, field: Column) -> Column:
    """The folded word of a clause, or the scope as it stands in the postings. Text of no or
    several words fails the job."""
    found = words(term)
    scope = F.lower(field).isin([f"@{kind}" for kind in SCOPES])
    message = F.concat(F.lit("not one word: "), F.coalesce(term, F.lit("NULL")))
    named = F.concat(F.lower(field), F.lit(":"), term)
    word = F.when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise(F.raise_error(message))
    return F.when(scope & term.isNotNull(), named).otherwise(word)


def batch_search(
    clauses: DataFrame, postings: DataFrame, vocabulary: DataFrame, limit: int = DEFAULT_LIMIT,
    oldest_first: bool = False, folder: str | None = None, salts: int | None = None,
) -> DataFrame:
    """Top records per query: query_id, rank, _id, year.

    The vocabulary alone names each query's rarest atom. Only these meet the postings
    freely; of all other words only the rows of candidate records go on, and a query of
    one atom needs none of them.

    Intermediate tables are written when this is called, to ``folder`` (the caller's, to
    remove after use) or a fresh one under ``spark.checkpoint.dir``. That fixes the atom
    numbers and lets the joins measure their smaller side: a small batch is broadcast and
    the postings are never shuffled, a large one meets them on (term, salt). ``salts``
    overrides the number that follows from the most frequent word.
    """
    asked = clauses.select(
        "query_id", _column_of(F.col("field")).alias("field"), _one_word(F.col("term"), F.col("field")).alias("word"),
        "is_prefix",
    )
    # One signature per query: its sorted distinct clauses. Its size is the query's own length.
    signed = asked.groupBy("query_id").agg(
        F.sort_array(F.collect_set(F.struct(*ATOM))).alias("signature")
    )
    unique = signed.groupBy("signature").agg(F.min("query_id").alias("rep"))
    rep_atoms = unique.select(
        "rep", F.size("signature").alias("n_atoms"), F.inline("signature").alias(*ATOM)
    )
    numbered = rep_atoms.select(*ATOM).distinct().withColumn(
        "atom", F.monotonically_increasing_id()
    )
    atoms = stored(numbered, "atoms", folder)

    exact = atoms.filter(~F.col("is_prefix")).join(
        vocabulary.select(F.col("term").alias("word"), "term", "n_records"), "word"
    )
    opened = expand_prefixes(atoms.filter("is_prefix"), vocabulary)
    wanted = ["atom", "field", "term", "n_records"]
    atom_terms = stored(exact.select(*wanted).unionByName(opened.select(*wanted)), "atom_terms", folder)
    # An atom without any word has no weight and so can never be satisfied.
    weights = atom_terms.groupBy("atom").agg(F.sum("n_records").alias("weight"))
    weighed = stored(atoms.join(weights, "atom"), "weights", folder)

    leads = (
        salted_join(rep_atoms, weighed, ATOM, "rep", 16)
        .groupBy("rep", "n_atoms")
        .agg(
            F.min(F.struct("weight", "atom"))["atom"].alias("atom"),
            F.collect_list("atom").alias("atoms"),
        )
        .filter(F.size("atoms") == F.col("n_atoms"))
        .select("rep", "atom", F.array_except("atoms", F.array("atom")).alias("others"))
    )
    leads = stored(leads, "leads", folder)
    salts = salts or salts_for(atom_terms)
    lead_atoms = weighed.join(leads.select("atom").distinct(), "atom", "left_semi")
    lead_rows = _records_with(postings, lead_atoms, atom_terms, salts).distinct()
    # Candidates carry their query's other atoms along, so no join on the query follows.
    candidates = stored(salted_join(lead_rows, leads, ["atom"], "rec", salts), "candidates", folder)
    single = candidates.filter(F.size("others") == 0).select("rep", *RECORD_KEY)

    checks = candidates.filter(F.size("others") > 0).select(
        "rep", F.size("others").alias("n"), *RECORD_KEY, F.explode("others").alias("atom")
    )
    asked_pairs = stored(checks.select("atom", "rec").distinct(), "checks", folder)
    check_atoms = weighed.join(asked_pairs.select("atom").distinct(), "atom", "left_semi")
    # Only rows of a candidate record go on, before anything is shuffled for them.
    met = _records_with(postings, check_atoms, atom_terms, salts).select("atom", "rec")
    held = salted_join(met, asked_pairs, ["atom", "rec"], "rec", 1).distinct()
    passed = (
        checks.join(held, ["atom", "rec"])
        .groupBy("rep", "n", *RECORD_KEY)
        .count()
        .filter(F.col("count") == F.col("n"))
        .select("rep", *RECORD_KEY)
    )
    by_year = F.col("year").asc() if oldest_first else F.col("year").desc()
    order = Window.partitionBy("rep").orderBy(by_year, "ord", "rec")
    rank = F.row_number().over(order)
    top = single.unionByName(passed).withColumn("rank", rank).filter(F.col("rank") <= limit)
    copies = signed.join(unique, "signature").select("query_id", "rep")
    return copies.join(top, "rep").select(
        "query_id", F.col("rank").cast("long").alias("rank"), "_id", "year"
    )


def typed_queries(texts: DataFrame, query_id: str, text: str) -> DataFrame:
    """Clause rows of typed query texts: every word must occur, the last as a prefix
    unless white space or another separator follows it."""
    found = texts.select(
        F.col(query_id).alias("query_id"),
        words(F.col(text)).alias("words"),
        F.col(text).rlike(f"[{WORD_CHARS}]\\z").alias("open_end"),
    )
    rows = found.select(
        "query_id", "open_end", F.size("words").alias("n"), F.posexplode("words").alias("pos", "term")
    )
    return rows.select(
        "query_id", F.col("pos").alias("clause_no"), F.lit(None).cast("string").alias("field"),
        "term", (F.col("open_end") & (F.col("pos") == F.col("n") - 1)).alias("is_prefix"),
    )
