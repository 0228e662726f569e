import re
import unicodedata
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from folio.llm import format_duplicates as fd

SCHEMA = "entry_id bigint, title string, url string, id string, t string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, u, "x", "y") for i, t, u in rows], SCHEMA)


ROWS = [
    (5, "Chapter 1 | The Mill", "http://a.b/x?k=1&j=2"),
    (3, "the mill｜CHAPTER-1.", "HTTP://A.B/X?j=2&k=1&"),
    (9, " chapter1|themill", "http://a.b//x?k=1&j=2"),
    (7, "Chapter 1 | Mill The", "http://a.b/x?k=1&j=2"),
    (8, "Chapter 1 | The Mill", "http://a.b/x?k=1&j=2#p2"),
    (11, None, "http://a.b/x"),
    (10, None, "http://a.b/x/"),
    (12, "", "http://a.b/x"),
    (13, "a", None),
    (14, "A", None),
    (15, "ａ", None),
]


def test_copies(spark):
    got = {tuple(r) for r in fd.copies(frame(spark, ROWS)).collect()}
    assert got == {(3, 5), (3, 9), (10, 11), (13, 14)}


def test_collapse_counts_every_row(spark):
    got = {r["entry_id"]: r["copies"] for r in fd.collapse(frame(spark, ROWS)).collect()}
    assert got == {3: 3, 7: 1, 8: 1, 10: 2, 12: 1, 13: 2, 15: 1}
    assert sum(got.values()) == len(ROWS)


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a", "u"), (1, "a", "u"), (None, "a", "u"), (2, "A", "u")]
    assert {tuple(r) for r in fd.copies(frame(spark, rows)).collect()} == {(1, 2)}


def test_empty(spark):
    assert fd.copies(frame(spark, [])).count() == 0
    assert fd.collapse(frame(spark, [])).count() == 0


def test_hot_group_and_brute_force(spark, monkeypatch):
    """A third of all rows are one record; the skew path gives what the plain one gives."""
    monkeypatch.setattr("folio.util.HEAVY_FRACTION", 0.05)
    rows = [(i, f"Title {i % 7} - part", f"http://h/{i % 11}") for i in range(300)] + [(1000 + i, "HOT" + " " * (i % 3), "http://hot/") for i in range(150)]

    def fold(s):
        return "".join(c for c in s.lower() if not (c.isspace() or unicodedata.category(c)[0] == "P" or c in "$+<=>^`~|"))

    groups = defaultdict(list)
    for i, t, u in rows:
        groups[(tuple(sorted(fold(x) for x in re.split("[|｜]", t))), fold(u))].append(i)
    want = {(min(g), i) for g in groups.values() for i in g if i != min(g)}
    assert {tuple(r) for r in fd.copies(frame(spark, rows)).collect()} == want

    from folio import util

    a = spark.createDataFrame([(i % 3 if i % 2 else 7, i) for i in range(400)], "k int, v int")
    g = a.groupBy("k").agg(F.count("*").alias("n"))
    assert util.skew_safe_join(a, g, ["k"], "n", 200_000).count() == 400


@pytest.mark.parametrize("t", ["x" * 200_000, "—" * 50, "\n\t"])
def test_odd_texts(spark, t):
    assert fd.copies(frame(spark, [(1, t, t), (2, t.upper() + " ", t)])).count() == 1
