"""Reading graphs: edges, heads, order, cycles. Chains are followed by pointer doubling: rounds grow with the logarithm of their length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.util import materialize, with_previous

MAX_ROUNDS = 40


def consecutive_edges(chapters: DataFrame, book: str, key: str, ascending: Column) -> DataFrame:
    """(book, src, dst, confidence): each chapter to the next; 0.9 in a list known to ascend, else 0.6. Input has pos."""
    e = with_previous(chapters.select(book, "pos", F.col(key).alias("dst"), ascending.alias("up")), [book], ["pos"], ["dst", "up"])
    return e.select(book, F.col("prev.dst").alias("src"), "dst", F.when(F.col("prev.up"), 0.9).otherwise(0.6).alias("confidence")).where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")


def strongest(edges: DataFrame) -> DataFrame:
    """One outgoing edge per source: the most confident, the smallest target among equals. Loops on oneself drop out."""
    e = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    return e.groupBy("src").agg(F.min_by(F.struct("dst", "confidence"), F.struct(-F.col("confidence"), "dst")).alias("b")).select("src", "b.dst", "b.confidence")


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both nodes."""
    n = nodes.select("key").distinct()
    return edges.join(n.withColumnRenamed("key", "src"), "src", "left_semi").join(n.withColumnRenamed("key", "dst"), "dst", "left_semi").where("src <> dst")


def ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, is_head, is_tail, is_orphan): nodes without a way in, without a way out, without either."""
    n = nodes.select("key").distinct()
    j = n.join(edges.select(F.col("dst").alias("key"), F.lit(True).alias("i")).distinct(), "key", "left").join(edges.select(F.col("src").alias("key"), F.lit(True).alias("o")).distinct(), "key", "left")
    return j.select("key", F.col("i").isNull().alias("is_head"), F.col("o").isNull().alias("is_tail"), (F.col("i").isNull() & F.col("o").isNull()).alias("is_orphan"))


def reading_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, head, rank, broken): each node's distance from the head of its chain.

    Nodes on a cycle, or behind one, have no head: null, broken. Where chains
    join, a node belongs to the way of its strongest predecessor.
    """
    fwd = strongest(edges)
    back = fwd.groupBy("dst").agg(F.min_by("src", F.struct(-F.col("confidence"), "src")).alias("up")).withColumnRenamed("dst", "key")
    state = materialize(nodes.select("key").distinct().join(back, "key", "left").select("key", F.coalesce("up", "key").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint").alias("d"), F.col("up").isNull().alias("done")))
    total = state.count()
    for _ in range(min(MAX_ROUNDS, max(1, total.bit_length() + 1))):
        if not state.where("NOT done").limit(1).count():
            break
        s = state.alias("s")
        t = state.select(F.col("key").alias("up"), F.col("up").alias("up2"), F.col("d").alias("d2"), F.col("done").alias("done2"))
        # finished rows need no lookup: only the others shuffle
        open_ = s.where("NOT done").join(t, "up", "left").select("key", F.coalesce("up2", "up").alias("up"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"), F.coalesce("done2", F.lit(True)).alias("done"))
        state = materialize(open_.unionByName(state.where("done")))
    return state.select("key", F.when(F.col("done"), F.col("up")).alias("head"), F.when(F.col("done"), F.col("d")).alias("rank"), (~F.col("done")).alias("broken"))


def on_cycles(edges: DataFrame) -> DataFrame:
    """(key): nodes from which the strongest edges lead back to themselves.

    Doubling gives where each node stands after as many steps as there are
    nodes; those places, and no others, are on cycles.
    """
    fwd = strongest(edges)
    step = materialize(fwd.select("src", "dst"))
    n = step.count()
    for _ in range(max(1, n.bit_length())):
        t = step.select(F.col("src").alias("dst"), F.col("dst").alias("far"))
        step = materialize(step.join(t, "dst").select("src", F.col("far").alias("dst")))
    return step.select(F.col("dst").alias("key")).distinct()


def cycle_paths(edges: DataFrame) -> DataFrame:
    """(cycle, step, key): every cycle of the strongest edges as a path from its smallest node, which names it."""
    fwd = strongest(edges).select("src", "dst")
    on = on_cycles(edges)
    ring = materialize(fwd.join(on.withColumnRenamed("key", "src"), "src", "left_semi"))
    state = ring.select(F.col("src").alias("key"), "dst", F.least("src", "dst").alias("low"))
    for _ in range(max(1, ring.count().bit_length())):
        t = state.select(F.col("key").alias("dst"), F.col("dst").alias("far"), F.col("low").alias("low2"))
        state = materialize(state.join(t, "dst").select("key", F.col("far").alias("dst"), F.least("low", "low2").alias("low")))
    named = state.select("key", "low")
    cut = ring.join(named.withColumnRenamed("key", "src"), "src").where("dst <> low").select("src", "dst", F.lit(1.0).alias("confidence"))
    return reading_order(named.select("key"), cut).select(F.col("head").alias("cycle"), F.col("rank").alias("step"), "key")


def linear_order(order: DataFrame) -> DataFrame:
    """Rows of reading_order in one line: chain after chain, and behind them the nodes that no head leads to."""
    return order.orderBy(F.col("head").isNull(), "head", "rank", "key")


def duplicates(chapters: DataFrame, seq: str = "seq", pages: str = "source_pages") -> DataFrame:
    """(seq, first_seq): chapters that share a source page with an earlier one."""
    p = chapters.select(seq, F.explode(pages).alias("page")).distinct()
    first = p.groupBy("page").agg(F.min(seq).alias("first_seq"))
    return p.join(first, "page").where(F.col("first_seq") < F.col(seq)).groupBy(seq).agg(F.min("first_seq").alias("first_seq"))


def walk_pages(pages: DataFrame, steps: DataFrame, most: int = 10) -> DataFrame:
    """(start, pos, page): pages reached from each start by accepted steps (src, dst), at most ``most`` and none twice."""
    s = strongest(steps.withColumn("confidence", F.lit(1.0)))
    cur = pages.select(F.col("page").alias("start"), F.col("page"), F.array("page").alias("seen"))
    out = cur.select("start", F.lit(1).alias("pos"), "page")
    for k in range(2, most + 1):
        cur = cur.join(s.select(F.col("src").alias("page"), "dst"), "page").where(~F.array_contains("seen", F.col("dst"))).select("start", F.col("dst").alias("page"), F.concat("seen", F.array("dst")).alias("seen"))
        cur = materialize(cur)
        if not cur.limit(1).count():
            break
        out = out.unionByName(cur.select("start", F.lit(k).alias("pos"), "page"))
    return out
