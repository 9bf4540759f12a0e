"""File resolution against a direct reading of the rule."""

import random

import pytest
from helpers import attachment, author, library, record, table

from citeloom import session
from citeloom.operators import files


def expected(row, paths):
    if not row["attachments"]:
        return None
    first = row["author"][0]["last"] if row["author"] else ""
    names = [(p, p.rsplit("/", 1)[-1]) for p in paths]
    head = row["attachments"][0]
    if head["source_filename"] == "[article_pdf].pdf":
        hits = [p for p, n in names if n == head["filename"]]
    else:
        lit = row["title"][:30].replace("...  ", "... ")
        hits = [p for p, n in names if n.startswith(first) and lit in n[len(first):]]
    return min(hits, default=None)


def check(spark, rows, paths):
    listing = files.list_paths(spark.createDataFrame([(p,) for p in paths], "path string"))
    got = dict(table(files.resolve_files(files.wanted_files(library(spark, *rows)), listing), "_id", "path"))
    assert got == {r["_id"]: expected(r, paths) for r in rows}
    return got


def pattern(_id, last, title):
    return record(_id, author=[author(last, last)] if last else [], title=title,
                  attachments=[attachment("x.pdf")])


def exact(_id, name):
    return record(_id, attachments=[attachment("[article_pdf].pdf", name)])


def test_each_case(spark):
    paths = ["/r/b/a.pdf", "/r/a/a.pdf", "/r/Doe 2020 - Some title of a paper that goes.pdf",
             "/r/z/Doe - Some title of a paper that goes on.pdf", "/r/[x]*.pdf", "/r/Li *w?.pdf",
             "/r/Lin - word.pdf", "/r/X - Dots... y.pdf", "plain.pdf"]
    rows = [
        exact("e1", "a.pdf"), exact("e2", "none.pdf"), exact("e3", "[x]*.pdf"), exact("e4", "plain.pdf"),
        pattern("p1", "Doe", "Some title of a paper that goes beyond"), pattern("p2", "Li", "*w?"),
        pattern("p3", "Li", "word"), pattern("p4", "", "word"), pattern("p5", "Doe", ""),
        pattern("p6", "X", "Dots...  y"), pattern("p7", "Do", "oe"), pattern("p8", "Doe", "Doe"),
        record("n1"),
    ]
    got = check(spark, rows, paths)
    assert got["e1"] == "/r/a/a.pdf" and got["p3"] == "/r/Lin - word.pdf" and got["n1"] is None


@pytest.mark.parametrize("limit", [session.BROADCAST_BYTES, -1])
def test_random_names(spark, monkeypatch, limit):
    monkeypatch.setattr(session, "BROADCAST_BYTES", limit)
    rng = random.Random(5)

    def word(low, high):
        return "".join(rng.choice("abé.") for _ in range(rng.randint(low, high)))

    paths = sorted({f"/{word(0, 2)}/{word(1, 12)}" for _ in range(300)})
    rows = [pattern(f"p{i}", word(0, 3), word(0, 5)) for i in range(120)]
    rows += [exact(f"e{i}", word(1, 3)) for i in range(60)]
    check(spark, rows, paths)


def test_hot_names_on_both_sides_do_not_multiply(spark):
    paths = [f"/d{i}/same.pdf" for i in range(400)] + [f"/d{i}/Doe - Title.pdf" for i in range(400)]
    rows = [exact(f"e{i}", "same.pdf") for i in range(200)] + [pattern(f"p{i}", "Doe", "Title") for i in range(200)]
    check(spark, rows, paths)
