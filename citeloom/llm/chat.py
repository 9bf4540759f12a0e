"""Chat formatting with Spark expressions only.

Template, per run of neighbouring turns of one role::

    <|im_start|>ROLE\nTEXT<|im_next|>TEXT<|im_end|>\n

``<|im_next|>`` stands between merged turns, so the turns can be read back. Inside
texts and roles ``&`` becomes ``&amp;`` and ``<|`` becomes ``&lt;|`` (a line break in a
role becomes ``&nl;``), so no control string of a text survives and all of it reverses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>\n"
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments.

    ``segments`` is the formatted text in pieces, in order, each with its loss mask; the
    learned pieces are exactly the (escaped) texts of the assistant.

    Turns are sorted by (turn, role, text), nulls first; so ties and repeated rows keep a
    defined place and all stay. Null text or role: empty. Null conv_id: one conversation
    of its own. No turns: no rows. Other columns are ignored. The only group that meets in
    a task is one conversation, which is also one output value.
    """
    read = turns.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("said"),
    )
    sorted_turns = read.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("turns"))

    def starts_run(i: Column) -> Column:
        role = F.get("turns", i)["role"]
        return (i == 0) | (role != F.get("turns", F.greatest(i - 1, F.lit(0)))["role"])

    starts = sorted_turns.withColumn(
        "starts", F.filter(F.sequence(F.lit(0), F.size("turns") - 1), starts_run)
    )

    def run(start: Column, n: Column) -> Column:
        end = F.coalesce(F.get("starts", n + 1), F.size("turns"))
        texts = F.transform(F.slice("turns", start + 1, end - start), lambda t: escape(t["text"]))
        return F.struct(F.get("turns", start)["role"].alias("role"), texts.alias("texts"))

    runs = starts.select("conv_id", F.transform("starts", run).alias("runs"))

    def pieces(r: Column) -> Column:
        learned = r["role"] == LEARNED_ROLE
        texts = F.transform(
            r["texts"],
            lambda text, k: F.array(
                _segment(F.when(k == 0, F.lit("")).otherwise(F.lit(NEXT)), F.lit(False)),
                _segment(text, learned),
            ),
        )
        head = F.concat(F.lit(START), escape_role(r["role"]), F.lit("\n"))
        return F.concat(
            F.array(_segment(head, F.lit(False))),
            F.flatten(texts),
            F.array(_segment(F.lit(END), F.lit(False))),
        )

    made = runs.select("conv_id", F.flatten(F.transform("runs", pieces)).alias("segments"))
    whole = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return made.select("conv_id", whole.alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation, from its text alone."""
    blocks = F.split(formatted, r"<\|im_end\|>\n")

    def turns_of(block: Column) -> Column:
        rest = F.substr(block, F.lit(len(START) + 1))
        role = F.substring_index(rest, "\n", 1)
        texts = F.split(F.substr(rest, F.length(role) + 2), r"<\|im_next\|>")
        return F.transform(
            texts,
            lambda t: F.struct(unescape_role(role).alias("role"), unescape(t).alias("text")),
        )

    return F.flatten(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), turns_of))


def learned_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""
    learned = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(learned, lambda s: unescape(s["text"])), "")


def digest(formatted: DataFrame) -> DataFrame:
    """Check columns, read back from the formatted text and the mask."""
    back = formatted.select(
        "conv_id", F.length("formatted").cast("long").alias("formatted_chars"),
        read_turns(F.col("formatted")).alias("turns"),
        learned_text(F.col("segments")).alias("learned"),
    )
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )
