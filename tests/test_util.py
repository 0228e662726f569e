import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from folio import util


def test_with_previous_is_lag(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.randint(0, 50), i) for i in range(600)] + [("z", None, 1000)]
    df = spark.createDataFrame(rows, "k string, o int, i int")
    want = {(r["i"], r["p"]) for r in df.select("i", F.lag("i").over(Window.partitionBy("k").orderBy("o", "i")).alias("p")).collect()}
    got = {(r["i"], r["p"]["i"] if r["p"] else None) for r in util.with_previous(df, ["k"], ["o", "i"], ["i"], "p").collect()}
    assert got == want
    assert util.with_previous(df.limit(0), ["k"], ["o", "i"], ["i"]).count() == 0


def test_running_is_a_running_window(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), i, rng.choice([None, *range(9)])) for i in range(500)] + [("z", 1000, None)]
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(7)
    w = Window.partitionBy("k").orderBy("o")
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    v = F.col("v")
    want = df.select("k", "o", F.coalesce(F.sum("v").over(up), F.lit(0)), F.min("v").over(up), F.coalesce(F.sum("v").over(down), F.lit(0)), F.max("v").over(down), F.lead("o").over(w))
    got = util.running(df, "k", ["o"], {"s": ("sum", v), "m": ("min", v)}, {"t": ("sum", v), "x": ("max", v), "n": ("next", F.col("o"))}).select("k", "o", "s", "m", "t", "x", "n")
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    assert util.running(df.limit(0), "k", ["o"], {"s": ("sum", v)}).count() == 0


def test_skew_safe_join_matches_plain_join(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(7)).otherwise(F.col("id") % 500).cast("bigint").alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("m"))
    a = util.skew_safe_join(rows, groups, ["k"], "n", 3000)
    b = util.skew_safe_join(rows, groups, ["k"], "n", 200_000)
    assert a.count() == b.count() == 3000
    assert {tuple(r) for r in a.select("id", "m").collect()} == {tuple(r) for r in b.select("id", "m").collect()}


def test_materialize_survives_and_keeps_schema(spark):
    df = spark.createDataFrame([(1, None, [1, 2])], "a int, b string, c array<int>")
    m = util.materialize(df)
    assert m.schema == df.schema and m.collect() == df.collect()
    assert util.cleanup(spark) > 0 and util.cleanup(spark) == 0
    assert util.shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_core_stands_without_the_subpackage():
    import subprocess
    import sys

    code = (
        "import sys, importlib.abc\n"
        "class No(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('folio.llm'): raise ImportError(name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries()\n"
        "assert 'host_link_density' in q and not [k for k in q if k.startswith('p1_')]\n"
        "assert set(e.oracle_sql()) <= set(q)\n"
    )
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, check=False).returncode == 0


@pytest.mark.parametrize("name", ["__spark_entry__"])
def test_every_oracle_has_a_query(name):
    import importlib

    e = importlib.import_module(name)
    assert set(e.oracle_sql()) <= set(e.queries())
