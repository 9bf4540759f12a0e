"""Many searches at once, each a tree of conditions, against the position lists.

``nodes`` holds one row per node in postfix order: (query_id, step, op, field, terms,
distance). ``phrase`` and ``near`` rows and scopes (``label``, ``folder``, ``type``) are
leaves; ``and``, ``or`` and ``not`` join the two results before them (``not`` keeps the
earlier one without the later). ``terms`` are (word, is_prefix); a word is a phrase of one.
``tree_rows`` writes a ``Clause`` in this form.

How the work stays proportional to the data, whatever the trees share:

* identical trees are answered once, distinct leaves are tested once per candidate record;
* every tree names the words of which each of its matches holds at least one: the lightest
  word of a leaf, the lighter side of an AND, both sides of an OR, the kept side of a NOT.
  The vocabulary alone decides this; only these words meet the postings freely;
* of all other words only the rows of candidate records go on, each to the leaves asked
  for that record, so a hot word in a million leaves does not multiply its postings;
* a tree is evaluated on one bit stack per candidate: leaves push, operators join two bits;
* a tree takes its candidates in rounds, the years that rank first first, and is done as soon
  as it has ``limit`` matches: later years cannot change them. A round takes as many years as
  the matches so far call for, the last one all that are left.

Rows without a query id or of a query without rows answer nothing. A malformed tree fails the
job. Repeated leaves count once; null ``is_prefix`` is false, null ``distance`` the default.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.tokens import words
from citeloom.operators.batch import MOST_TERMS, _column_of, expand_prefixes, met_rows, salts_for
from citeloom.operators.clauses import (
    DEFAULT_DISTANCE, SCOPES, And, Clause, InScope, Near, Not, Or, Phrase,
)
from citeloom.operators.postings import MAX_RARE_ROWS, RECORD_KEY, near_test
from citeloom.operators.search import DEFAULT_LIMIT
from citeloom.session import salted_join, stored

NODES = (
    "query_id long, step int, op string, field string,"
    " terms array<struct<word:string,is_prefix:boolean>>, distance int"
)
JOINS = ("and", "or", "not")
MOST_PENDING = 60  # bits of the stack; ``tree_rows`` needs about log2 of the leaves
WHOLE_ROWS = 1_000_000  # up to so many rows of the lightest words, one round takes all years
NAMED_ROWS = 400_000  # words of prefixes that are broadcast
ROUNDS = 4
MOST_GROWTH = 16  # a round before the last takes at most so many times the rows before it
_COVER = "array<struct<weight:bigint,leads:array<struct<atom:bigint,field:string>>>>"


def _pending(clause: Clause) -> int:
    """Results that wait at once while a tree is evaluated in the order of ``tree_rows``."""
    if isinstance(clause, (And, Or)):
        needs = sorted(map(_pending, clause.parts), reverse=True)
        return max(need + (i > 0) for i, need in enumerate(needs))
    if isinstance(clause, Not):
        return max(_pending(clause.keep), _pending(clause.drop) + 1)
    return 1


def tree_rows(query_id: int, clause: Clause | None) -> list[tuple]:
    """Rows of ``NODES`` for one tree; the parts that need most room come first."""

    def leaf(op: str, field: str | None, terms: list[tuple[str, bool]], distance: int | None = None):
        return [(op, field, terms, distance)]

    def emit(c: Clause) -> list[tuple]:
        if isinstance(c, Near):
            sides = [(side.words[0], side.prefix) for side in (c.left, c.right)]
            return leaf("near", c.field, sides, c.distance)
        if isinstance(c, InScope):
            return leaf(c.kind, None, [(c.key, False)])
        if isinstance(c, Phrase):
            last = len(c.words) - 1
            return leaf("phrase", c.field, [(w, c.prefix and i == last) for i, w in enumerate(c.words)])
        if isinstance(c, Not):
            return [*emit(c.keep), *emit(c.drop), ("not", None, None, None)]
        op = "and" if isinstance(c, And) else "or"
        first, *others = sorted(c.parts, key=_pending, reverse=True)
        rows = emit(first)
        for part in others:
            rows += [*emit(part), (op, None, None, None)]
        return rows

    return [] if clause is None else [(query_id, i, *row) for i, row in enumerate(emit(clause))]


def _either(test: Column, value: Column, message: str) -> Column:
    return F.when(test, value).otherwise(F.raise_error(F.lit(message)))


def _leaf() -> Column:
    """The leaf of a node row as one comparable value, NULL on an operator."""
    op = F.lower("op")

    def one_word(t: Column) -> Column:
        found = words(t["word"])
        folded = F.when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise(
            F.raise_error(F.concat(F.lit("not one word: "), F.coalesce(t["word"], F.lit("NULL"))))
        )
        return F.struct(folded.alias("word"), F.coalesce(t["is_prefix"], F.lit(False)).alias("is_prefix"))

    def scope(t: Column) -> Column:
        named = F.concat(F.lit("@"), op, F.lit(":"), F.coalesce(t["word"], F.lit("")))
        return F.struct(named.alias("word"), F.lit(False).alias("is_prefix"))

    size = F.coalesce(F.size("terms"), F.lit(-1))
    distance = F.coalesce("distance", F.lit(DEFAULT_DISTANCE))
    is_scope = op.isin(*SCOPES)
    fits = (
        F.when(op == "phrase", size >= 1)
        .when(op == "near", (size == 2) & (distance >= 0))
        .otherwise(is_scope & (size == 1))
    )
    terms = F.when(is_scope, F.transform("terms", scope)).otherwise(F.transform("terms", one_word))
    value = F.struct(
        F.when(is_scope, "phrase").otherwise(op).alias("kind"),
        F.when(is_scope, "").otherwise(_column_of(F.col("field"))).alias("field"),
        F.when(op == "near", distance).otherwise(0).alias("distance"), terms.alias("terms"),
    )
    return F.when(
        ~F.coalesce(op.isin(*JOINS), F.lit(False)),
        _either(F.coalesce(fits, F.lit(False)), value, "malformed leaf"),
    )


def _well_formed(program: Column) -> Column:
    """Whether every operator finds two results, one is left, and the stack is deep enough."""
    begin = F.struct(F.lit(0).alias("n"), F.lit(True).alias("ok"))

    def step(s: Column, x: Column) -> Column:
        n = F.when(x["leaf"].isNotNull(), s["n"] + 1).otherwise(s["n"] - 1)
        fine = (n >= 1) & (n <= MOST_PENDING)
        return F.struct(n.alias("n"), (s["ok"] & fine).alias("ok"))

    return F.aggregate(program, begin, step, lambda s: s["ok"] & (s["n"] == 1))


def _cover(program: Column) -> Column:
    """(atom, field) pairs of which every match holds at least one, as light as the tree allows."""

    def step(stack: Column, x: Column) -> Column:
        n = F.size(stack)
        below, top = F.get(stack, n - 2), F.get(stack, n - 1)
        both = F.struct(
            (below["weight"] + top["weight"]).alias("weight"),
            F.array_union(below["leads"], top["leads"]).alias("leads"),
        )
        joined = (
            F.when(x["op"] == "or", both)
            .when((x["op"] == "and") & (top["weight"] < below["weight"]), top)
            .otherwise(below)
        )
        own = F.struct(
            x["weight"].alias("weight"),
            F.when(x["weight"] > 0, F.array(F.struct(x["atom"].alias("atom"), x["field"].alias("field"))))
            .otherwise(F.array().cast("array<struct<atom:bigint,field:string>>")).alias("leads"),
        )
        rest = F.slice(stack, 1, F.greatest(n - 2, F.lit(0)))
        is_leaf = x["leaf"].isNotNull()
        kept = F.when(is_leaf, stack).otherwise(rest)
        return F.concat(kept, F.array(F.when(is_leaf, own).otherwise(joined))).cast(_COVER)

    return F.aggregate(program, F.array().cast(_COVER), step, lambda s: F.get(s, F.lit(0))["leads"])


def _holds(program: Column, hits: Column) -> Column:
    """A tree's truth given the leaves that hit; the lowest bit is the last result."""

    def step(s: Column, x: Column) -> Column:
        below, top = F.shiftright(s, 1).bitwiseAND(F.lit(1)), s.bitwiseAND(F.lit(1))
        joined = (
            F.when(x["op"] == "and", below.bitwiseAND(top))
            .when(x["op"] == "or", below.bitwiseOR(top))
            .otherwise(below.bitwiseAND(F.lit(1) - top))
        )
        hit = F.array_contains(hits, x["leaf"]).cast("long")
        pushed = F.shiftleft(s, 1).bitwiseOR(hit)
        merged = F.shiftleft(F.shiftright(s, 2), 1).bitwiseOR(joined)
        return F.when(x["leaf"].isNotNull(), pushed).otherwise(merged).cast("long")

    return F.aggregate(program, F.lit(0).cast("long"), step) == 1


def _leaf_holds() -> Column:
    """Whether the lists of one text satisfy a leaf: ``parts`` are (slot, positions)."""

    def at(slot: Column) -> Column:
        own = F.filter("parts", lambda p: p["slot"] == slot)
        return F.flatten(F.transform(own, lambda p: p["positions"]))

    rest = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: i > 0)
    starts = F.aggregate(
        rest, at(F.lit(0)),
        lambda found, i: F.array_intersect(found, F.transform(at(i), lambda x: x - i)),
    )
    near = near_test(at(F.lit(0)), at(F.lit(1)), F.col("distance"))
    return F.when(F.col("kind") == "near", near).otherwise(F.size(starts) > 0)


def _told() -> list[Column]:
    """What a row of a lead tells of its tree's leaves: those that hold (known) and those to be
    tested (asked). A leaf that another lead stands for is left to the rows of that lead."""

    def own(x: Column) -> Column:
        return (x["atom"] == F.col("atom")) & (x["field"] == F.col("field"))

    def led(x: Column) -> Column:
        return F.exists("every", lambda e: (e["atom"] == x["atom"]) & (e["field"] == x["field"]))

    def leaves(test) -> Column:
        kept = F.filter("program", lambda x: x["leaf"].isNotNull() & (x["weight"] > 0) & test(x))
        return F.array_distinct(F.transform(kept, lambda x: x["leaf"]))

    return [
        leaves(lambda x: own(x) & (x["n"] == 1)).alias("known"),
        leaves(lambda x: (own(x) & (x["n"] > 1)) | ~led(x)).alias("asked"),
    ]


def _most_terms(sizes: DataFrame) -> int:
    """Words up to which a prefix is joined word by word, as many as NAMED_ROWS allow in all."""
    steps = [MOST_TERMS * 4**i for i in range(6)]
    sums = [F.coalesce(F.sum(F.when(F.col("count") <= n, F.col("count"))), F.lit(0)) for n in steps]
    fit = [n for n, rows in zip(steps, sizes.agg(*sums).first()) if rows <= NAMED_ROWS]
    return fit[-1] if fit else MOST_TERMS


def _supply(lead_rows: DataFrame, leads: DataFrame, oldest_first: bool, folder: str | None) -> DataFrame:
    """Per tree and year the rows of its leads (n), those of the years before it and of all."""
    counts = lead_rows.groupBy("atom", "field", "band").agg(F.count("*").alias("n"))
    rows = salted_join(leads.select("rep", "atom", "field"), stored(counts, "counts", folder), ["atom", "field"], "rep", 16)
    years = rows.groupBy("rep", "band").agg(F.sum("n").alias("n"))
    by_band = F.col("band").asc() if oldest_first else F.col("band").desc()
    of_tree = Window.partitionBy("rep")
    earlier = of_tree.orderBy(by_band).rowsBetween(Window.unboundedPreceding, -1)
    return years.withColumns({
        "before": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "total": F.sum("n").over(of_tree),
    })


def _by_rounds(supply: DataFrame, leads: DataFrame, matches, limit: int, folder: str | None) -> DataFrame:
    """The best matches of every round, which hold the best of all.

    ``low`` and ``goal`` say which years a tree takes: those with as many rows before them. What
    is left out comes after ``limit`` matches in the order of the result.
    """
    state = supply.groupBy("rep").agg(
        F.lit(0).cast("long").alias("low"), F.lit(4 * limit).cast("long").alias("goal"),
        F.lit(0).cast("long").alias("hits"),
    )
    state, found = stored(state, "state", folder), []
    for later in reversed(range(ROUNDS)):
        taken = supply.join(state, "rep").filter("before >= low and before < goal")
        taken = stored(taken, "taken", folder)
        asked_leads = salted_join(taken.select("rep", "band"), leads, ["rep"], "band", 1)
        found.append(matches(stored(asked_leads, "asked_leads", folder), ["atom", "field", "band"]))
        if not later:
            break
        own = found[-1].groupBy("rep").agg(F.count("*").alias("own"))
        seen = taken.groupBy("rep", "goal", "hits", "total").agg(F.max(F.col("before") + F.col("n")).alias("seen"))
        seen = seen.join(own, "rep", "left").na.fill(0, ["own"]).withColumn("hits", F.col("hits") + F.col("own"))
        open_ = seen.filter((F.col("hits") < limit) & (F.col("seen") < F.col("total")))
        growth = F.least(F.lit(1.5) * limit / F.greatest("hits", F.lit(1)), F.lit(MOST_GROWTH))
        goal = F.col("total") if later == 1 else F.ceil(F.col("seen") * growth)
        state = stored(
            open_.select("rep", F.col("seen").alias("low"), goal.cast("long").alias("goal"), "hits"), "state", folder
        )
        if state.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def batch_trees(
    nodes: DataFrame, postings: DataFrame, vocabulary: DataFrame, limit: int = DEFAULT_LIMIT,
    oldest_first: bool = False, folder: str | None = None, salts: int | None = None,
) -> DataFrame:
    """Top records per query: query_id, rank, _id, year.

    ``postings`` are position lists (``postings.position_lists`` and ``scope_lists``). As in
    ``batch_search``, intermediate tables are written when this is called, to ``folder`` or a
    fresh one under ``spark.checkpoint.dir``, and joins measure their smaller side.
    """
    rows = nodes.filter("query_id is not null").select(
        "query_id", F.struct("step", F.lower("op").alias("op"), _leaf().alias("leaf")).alias("node")
    )
    program = F.transform(F.sort_array(F.collect_list("node")), lambda x: F.struct(x["op"], x["leaf"]))
    asked = rows.groupBy("query_id").agg(program.alias("tree"))
    signed = stored(
        asked.withColumn("tree", _either(_well_formed(F.col("tree")), F.col("tree"), "malformed tree")),
        "trees", folder,
    )
    unique = stored(signed.groupBy("tree").agg(F.min("query_id").alias("rep")), "unique", folder)
    placed = unique.select("rep", F.posexplode("tree").alias("step", "node")).select(
        "rep", "step", "node.op", F.col("node.leaf").alias("value")
    )
    # Numbers are fixed by writing them.
    numbered = placed.select("value").filter("value is not null").distinct()
    leaves = stored(numbered.withColumn("leaf", F.monotonically_increasing_id()), "leaves", folder)
    slots = leaves.select(
        "leaf", "value.kind", "value.field", "value.distance", F.size("value.terms").alias("n"),
        F.posexplode("value.terms").alias("slot", "term"),
    ).select("leaf", "kind", "field", "distance", "n", "slot", "term.word", "term.is_prefix")
    distinct_words = slots.select("word", "is_prefix").distinct()
    atoms = stored(distinct_words.withColumn("atom", F.monotonically_increasing_id()), "atoms", folder)
    slots = slots.join(atoms, ["word", "is_prefix"]).drop("word", "is_prefix")

    exact = atoms.filter(~F.col("is_prefix")).join(
        vocabulary.select(F.col("term").alias("word"), "term", "n_records"), "word"
    )
    opened = expand_prefixes(atoms.filter("is_prefix"), vocabulary)
    wanted = ["atom", "term", "n_records"]
    atom_terms = stored(exact.select(*wanted).unionByName(opened.select(*wanted)), "atom_terms", folder)
    weights = atom_terms.groupBy("atom").agg(F.sum("n_records").alias("weight"))
    weighed = slots.join(weights, "atom", "left").na.fill(0, ["weight"])
    slots = stored(weighed, "slots", folder)
    # A leaf is found by its lightest word; one without any record weighs nothing.
    lightest = slots.groupBy("leaf").agg(
        F.min(F.struct("weight", "atom", "field")).alias("w"), F.max("n").alias("n")
    )
    steps = (
        placed.join(leaves, "value", "left").join(lightest, "leaf", "left")
        .groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("step", "op", "leaf", "n", "w.*"))).alias("program"))
    )
    one_word = (F.size("program") == 1) & (F.size("leaves") == 1) & F.col("plain")
    plain = slots.groupBy("leaf").agg((F.max("n") == 1).alias("plain"))
    programs = steps.withColumns({
        "leads": _cover(F.col("program")),
        "leaves": F.array_distinct(F.array_compact(F.transform("program", lambda x: x["leaf"]))),
    }).join(plain.withColumnRenamed("leaf", "first"), F.get("leaves", F.lit(0)) == F.col("first"))
    programs = stored(programs.withColumn("done", one_word).drop("first", "plain"), "programs", folder)

    salts = salts or salts_for(atom_terms)
    # Words of a broad prefix grow with the vocabulary; the prefix itself meets the postings.
    sizes = atom_terms.groupBy("atom").count()
    sizes = sizes.filter(F.col("count") > _most_terms(sizes)).select("atom")
    broad = stored(atoms.filter("is_prefix").join(sizes, "atom", "left_semi").select("atom", "word"), "broad", folder)
    named = atom_terms.select("atom", "term").join(broad, "atom", "left_anti")
    named = stored(named, "named", folder)

    def of_atoms(rows: DataFrame, wanted: DataFrame) -> DataFrame:
        """Postings that satisfy a wanted atom, with its columns."""
        by_term, by_head = wanted.join(named, "atom"), wanted.join(broad, "atom")
        return met_rows(rows, stored(by_term, "by_term", folder), stored(by_head, "by_head", folder), salts)

    leads = programs.select("rep", "program", "done", F.col("leads").alias("every"), F.inline("leads"))
    leads = stored(leads.select("rep", "done", *_told(), "atom", "field"), "leads", folder)
    lists = postings.select("term", "col", "positions", *RECORD_KEY)
    in_field = (F.col("field") == "") | (F.col("field") == F.col("col"))
    band = F.coalesce("year", F.lit("")).alias("band")
    lead_rows = of_atoms(lists.drop("positions"), leads.select("atom", "field").distinct()).filter(in_field)
    lead_rows = stored(lead_rows.select("atom", "field", band, *RECORD_KEY), "lead_rows", folder)
    tests = slots.select("leaf", "kind", "field", "distance", "n", "slot", "atom")
    by_year = F.col("year").asc() if oldest_first else F.col("year").desc()
    best = Window.partitionBy("rep").orderBy(by_year, "ord", "rec")

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)

    def matches(asked_leads: DataFrame, keys: list[str]) -> DataFrame:
        """The best matches of trees among the rows of their leads."""
        wanted = stored(asked_leads.select(*keys).distinct(), "keys", folder)
        own = salted_join(lead_rows, wanted, keys, "rec", salts).select(*keys, *RECORD_KEY).distinct()
        met_leads = salted_join(own, asked_leads, keys, "rec", salts)
        candidates = stored(
            met_leads.select("rep", "done", "known", "asked", *RECORD_KEY).distinct(), "candidates", folder
        )
        single = candidates.filter("done").select("rep", *RECORD_KEY)
        known = candidates.filter(~F.col("done")).select("rep", *RECORD_KEY, F.explode("known").alias("leaf"))
        open_ = candidates.filter(~F.col("done")).select("rep", *RECORD_KEY, F.explode("asked").alias("leaf"))

        pairs = open_.select("leaf", "rec").distinct()
        checks = stored(salted_join(pairs, tests, ["leaf"], "rec", salts), "checks", folder)
        # Only rows of a candidate record go on, before anything is shuffled for them.
        held = stored(checks.select(F.xxhash64("rec").alias("key")).distinct(), "held", folder)
        near = lists
        if held.count() <= MAX_RARE_ROWS:
            near = lists.join(F.broadcast(held), F.xxhash64("rec") == F.col("key"), "left_semi")
        read = of_atoms(near, checks.select("atom").distinct()).select("atom", "rec", "col", "positions")
        met = salted_join(read, checks, ["atom", "rec"], "rec", 1).filter(in_field)
        # One pass for both kinds of leaves: a word of its own needs no positions.
        texts = met.groupBy("leaf", "kind", "distance", "n", "rec", "col").agg(
            F.collect_list(F.when(F.col("n") > 1, F.struct("slot", "positions"))).alias("parts")
        )
        held_leaves = texts.filter(F.when(F.col("n") == 1, True).otherwise(_leaf_holds()))
        hits = held_leaves.select("leaf", "rec").distinct()
        every = open_.join(hits, ["leaf", "rec"]).unionByName(known)
        found = every.groupBy("rep", *RECORD_KEY).agg(F.collect_set("leaf").alias("hits"))
        judged = salted_join(found, programs.select("rep", "program"), ["rep"], "rec", salts)
        passed = judged.filter(_holds(F.col("program"), F.col("hits"))).select("rep", *RECORD_KEY)
        return stored(ranked(single.unionByName(passed)).drop("rank"), "matches", folder)

    if lead_rows.count() <= WHOLE_ROWS:
        top = ranked(matches(leads, ["atom", "field"]))
    else:
        supply = stored(_supply(lead_rows, leads, oldest_first, folder), "supply", folder)
        top = ranked(_by_rounds(supply, leads, matches, limit, folder))
    # A tree that many queries share is met by many tasks.
    copies = salted_join(signed, unique, ["tree"], "query_id", 16).select("query_id", "rep")
    return copies.join(top, "rep").select(
        "query_id", F.col("rank").cast("long").alias("rank"), "_id", "year"
    )
