"""Secret scans with a blob ledger, DataFrame functions only.

Every version of a text is addressed by its content (SHA-256). The ledger says which
rules, by version, have read which blob and what they found; a scan reads only blobs with
rules they have not met, once per blob, and findings go back to all paths of a blob.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """A regex; a match counts if group ``group`` has at least ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    base: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The three base rules. The length of a maximal run is known while matching,
# so access and hex state it in the pattern; assign matches first and is checked after.
RULES = (
    Rule(
        "assign", 1,
        r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2, 8, True,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", 0, 16, True),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32, True),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 29),
    Rule("bearer", 1, r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}=*", 0, 28),
    # To the END line; where none follows, to the end of the base64 lines, the last of which
    # may be short. Lines may be broken by a backslash and n, as in strings of code.
    Rule(
        "private", 2,
        r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
        r"(?:(?:(?!-----)[\s\S])*+-----END [A-Z ]{0,20}PRIVATE KEY-----"
        r"|(?:\s*+(?:Proc-Type|DEK-Info):[^\n]*+)*+"
        r"(?:(?:(?:\s|\\[rn])*+[A-Za-z0-9+/]{16,}+={0,2})++"
        r"(?:(?:\s|\\[rn])++[A-Za-z0-9+/]++={0,2}(?=[\x20\t\r]*+(?:\n|\z)|\\[rn]|[\"']))?)?)",
        0, 27,
    ),
)

_MATCH = "array<struct<rule_no:int,n:int,gap:int,width:int,counts:boolean>>"
_ENTRY = "array<struct<start:long,end:long,rule:string>>"
_FINDING = "array<struct<start:long,rule_no:int,end:long>>"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _matches(text: Column, number: int, rule: Rule) -> Column:
    """All matches of a rule: length of the text before each (from the last), own length."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    groups = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    parts = F.arrays_zip(
        F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found)).alias("gap"),
        found.alias("found"), groups.alias("value"),
    )
    structs = F.transform(
        parts,
        lambda m, i: F.struct(
            F.lit(number).alias("rule_no"), i.cast("int").alias("n"),
            F.length(m["gap"]).alias("gap"), F.length(m["found"]).alias("width"),
            (F.length(m["value"]) >= rule.least).alias("counts"),
        ),
    )
    return F.when(F.regexp(text, pattern), structs).otherwise(F.array().cast(_MATCH)).cast(_MATCH)


def scan_unseen(
    docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """New ledger entries: blob, scanned (keys of the rules run), findings.

    Only (blob, rule version) pairs absent from ``ledger`` are scanned, each blob once
    however many rows hold it. ``findings`` are structs (start, end, rule) in code points,
    end exclusive, sorted; ``rule`` is the rule's key. Null text is the empty text, which is
    a blob like any other; an empty table gives no entries; other columns are ignored.
    """
    keys = F.array(*[F.lit(rule.key) for rule in rules])
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "blob", blob_id(F.col("text"))
    )
    blobs = texts.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        todo = blobs.withColumn("todo", keys)
    else:
        seen = ledger.groupBy("blob").agg(F.flatten(F.collect_set("scanned")).alias("seen"))
        left = F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>")))
        todo = blobs.join(seen, "blob", "left").withColumn("todo", left).drop("seen")
        todo = todo.filter(F.size("todo") > 0)
    hits = F.concat(*[
        F.when(F.array_contains("todo", rule.key), _matches(F.col("text"), i, rule)).otherwise(
            F.array().cast(_MATCH)
        )
        for i, rule in enumerate(rules)
    ])
    scanned = todo.select("blob", "todo", F.explode_outer(hits).alias("m"))
    so_far = Window.partitionBy("blob", "m.rule_no").orderBy("m.n")
    before = F.sum(F.col("m.gap") + F.col("m.width")).over(
        so_far.rowsBetween(Window.unboundedPreceding, 0)
    )
    located = scanned.withColumn("end", before)
    finding = F.when(
        F.col("m.counts"),
        F.struct(
            (F.col("end") - F.col("m.width")).cast("long").alias("start"),
            F.col("end").cast("long").alias("end"), F.get(keys, F.col("m.rule_no")).alias("rule"),
        ),
    )
    return located.groupBy("blob").agg(
        F.first("todo").alias("scanned"),
        F.sort_array(F.collect_list(finding)).cast(_ENTRY).alias("findings"),
    )


def entries(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Blobs with findings of the rules' present versions: blob, findings.

    Findings are structs (start, rule_no, end), sorted, ``rule_no`` counting in ``rules``.
    """
    wanted = F.array(*[F.lit(rule.key) for rule in rules])
    present = F.filter("findings", lambda f: F.array_contains(wanted, f["rule"]))
    numbered = F.transform(
        present,
        lambda f: F.struct(
            f["start"].alias("start"),
            (F.array_position(wanted, f["rule"]) - 1).cast("int").alias("rule_no"),
            f["end"].alias("end"),
        ),
    )
    merged = F.array_distinct(F.sort_array(F.flatten(F.collect_list("findings"))))
    numbered = ledger.select("blob", numbered.alias("findings")).filter(F.size("findings") > 0)
    return numbered.groupBy("blob").agg(merged.alias("findings"))


def findings_by_path(
    docs: DataFrame, ledger: DataFrame, path: str = "doc_id", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """One row per input row: ``path``, blob, findings as in ``entries``, none: empty.

    Null and repeated paths are rows like others. Only blobs with findings meet the paths;
    a blob on many paths is split by Spark's skew join.
    """
    versions = docs.select(path, blob_id(F.col("text")).alias("blob"))
    joined = versions.join(entries(ledger, rules), "blob", "left")
    return joined.select(
        path, "blob", F.coalesce("findings", F.array().cast(_FINDING)).alias("findings")
    )


def described(findings: Column, rules: tuple[Rule, ...] = RULES, base_only: bool = False) -> Column:
    """Findings as text: kind:start:end, by start, then rule order, comma-joined."""
    kinds = F.array(*[F.lit(rule.kind) for rule in rules])
    if base_only:
        n_base = sum(rule.base for rule in rules)
        findings = F.filter(findings, lambda f: f["rule_no"] < n_base)
    return F.array_join(
        F.transform(
            findings,
            lambda f: F.concat_ws(
                ":", F.get(kinds, f["rule_no"]), f["start"].cast("string"), f["end"].cast("string")
            ),
        ),
        ",",
    )


def counted(findings: Column, number: int) -> Column:
    return F.size(F.filter(findings, lambda f: f["rule_no"] == number)).cast("long")


def _stretches(findings: Column) -> Column:
    """Sorted findings with touching ones merged: the end of the last (``at``), and for each
    stretch the end of the one before it and its own start (``cuts``).

    The findings are folded in chunks of about the root of their number, since adding to an
    array copies it: a text with many findings then takes little more than one pass.
    """
    span = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(findings)))).cast("int")
    chunks = F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(findings) / span).cast("int") - 1),
        lambda c: F.slice(findings, c * span + 1, span),
    )
    no_cuts = F.array().cast("array<struct<after:long,start:long>>")

    def step(done: Column, f: Column) -> Column:
        touches = (f["start"] < done["at"]) | ((f["start"] == done["at"]) & (done["at"] > 0))
        cut = F.struct(done["at"].alias("after"), f["start"].alias("start"))
        return F.struct(
            F.greatest(done["at"], f["end"]).alias("at"),
            F.when(touches, done["cuts"]).otherwise(F.array_append(done["cuts"], cut)).alias("cuts"),
        )

    def fold(done: Column, chunk: Column) -> Column:
        begin = F.struct(done["at"].alias("at"), no_cuts.alias("cuts"))
        return F.aggregate(
            chunk, begin, step,
            lambda part: F.struct(
                part["at"].alias("at"), F.array_append(done["parts"], part["cuts"]).alias("parts")
            ),
        )

    start = F.struct(
        F.lit(0).cast("long").alias("at"),
        F.array().cast("array<array<struct<after:long,start:long>>>").alias("parts"),
    )
    return F.aggregate(
        chunks, start, fold,
        lambda done: F.struct(done["at"].alias("at"), F.flatten(done["parts"]).alias("cuts")),
    )


def redacted(text: Column, findings: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch of touching findings replaced by ``mark``.

    ``findings`` are sorted structs (start, rule_no, end) in code points, as ``entries`` gives
    them; null or none: the text as it is. A null text stays null. The text is cut as
    four-byte code points, where a place is found at once, so the work grows with the text
    and its findings, not with their product.
    """
    whole = F.struct(F.encode(text, "UTF-32").alias("bytes"), _stretches(findings).alias("found"))

    def built(w: Column) -> Column:
        def piece(start: Column, end: Column) -> Column:
            cut = F.substring(w["bytes"], (start * 4 + 1).cast("int"), ((end - start) * 4).cast("int"))
            return F.decode(cut, "UTF-32")

        parts = F.transform(
            w["found"]["cuts"], lambda c: F.concat(piece(c["after"], c["start"]), F.lit(mark))
        )
        end = (F.octet_length(w["bytes"]) / 4).cast("long")
        return F.concat(F.array_join(parts, ""), piece(w["found"]["at"], end))

    # A variable of the lambda is computed once, a column named in it once per finding.
    cut = F.get(F.transform(F.array(whole), built), F.lit(0))
    return F.when(F.size(findings) > 0, cut).otherwise(text)
