"""Lines repeated across the pages of one host (problem 3).

Nodes are normalized lines of a host, weighted by the number of its pages they
stand on; edges join consecutive lines. Nodes (and edges between them) with high
support stay, connected components of what stays are boilerplate blocks, and
matching occurrences are deleted from every page.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.util import materialize, skew_safe_join

#: A line is repeated if it stands on this many distinct pages of the host ...
MIN_PAGES = 5
#: ... and on one in so many of them. So a host has at most
#: MIN_SHARE * (lines of an average page) such lines.
MIN_SHARE = 10
#: Beyond so many repeated lines in all hosts they are joined by a shuffle, not a broadcast.
BROADCAST_NODES = 100_000

SPACE = r"[\s\p{Z}\x1C-\x1F\x85]+"


def norm(line: Column) -> Column:
    """Lower case, ends trimmed, every run of white space of any kind one space."""
    return F.lower(F.trim(F.regexp_replace(line, SPACE, " ")))


def _pages(content: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, host, lines): one row per extraction, lines as [(line_no, h1, h2)] without blank ones.

    A line is known by 128 bits of hash from here on, so texts shuffle no further.
    """
    c = content.select("page_id", "text").where("page_id IS NOT NULL AND text IS NOT NULL")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("line_no"), norm(x).alias("line")))
    hashed = F.transform(F.filter(lines, lambda x: x["line"] != ""), lambda x: F.struct(
        x["line_no"].alias("line_no"), F.xxhash64(x["line"]).alias("h1"), F.xxhash64(F.lit(17), x["line"], F.lit(3)).alias("h2")
    ))
    c = c.select("page_id", hashed.alias("lines")).where(F.size("lines") > 0)
    p = pages.select("page_id", "host").where("page_id IS NOT NULL AND host IS NOT NULL").groupBy("page_id").agg(F.min("host").alias("host"))
    return c.join(p, "page_id").select("page_id", "host", "lines")


def _counted(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repeated lines (host, h1, h2, n_pages, n_base) and the pages themselves, materialized."""
    pages = materialize(pages)
    base = pages.groupBy("host").agg(F.countDistinct("page_id").alias("n_base"))
    # a page delivered several times counts once; its lines are told apart before they shuffle
    once = pages.groupBy("page_id").agg(
        F.first("host").alias("host"), F.flatten(F.collect_set(F.transform("lines", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"))))).alias("l")
    )
    nodes = once.select("host", F.explode(F.array_distinct("l")).alias("x")).select("host", "x.h1", "x.h2").groupBy("host", "h1", "h2").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= MIN_PAGES)
    return nodes.join(base, "host").where(F.col("n_pages") * MIN_SHARE >= F.col("n_base")), pages


def _components(edges: pd.DataFrame) -> pd.DataFrame:
    """Union-find over one host's repeated lines; they are few (see MIN_SHARE)."""
    parent: dict[tuple[int, int], tuple[int, int]] = {}

    def root(x: tuple[int, int]) -> tuple[int, int]:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a1, a2, b1, b2 in zip(edges.h1, edges.h2, edges.g1, edges.g2, strict=True):
        a, b = root((a1, a2)), root((b1, b2))
        if a != b:
            parent[max(a, b)] = min(a, b)
    keys = sorted(parent)
    return pd.DataFrame({
        "host": edges.host.iloc[0], "h1": [k[0] for k in keys], "h2": [k[1] for k in keys],
        "block": [root(k)[0] for k in keys],
    }).astype({"h1": "int64", "h2": "int64", "block": "int64"})


def _join_nodes(lines: DataFrame, nodes: DataFrame, n_nodes: int) -> DataFrame:
    """Lines that are nodes. Beyond the checked bound for a broadcast only lines of a great share of all rows are broadcast; the rest is shuffled."""
    if n_nodes <= BROADCAST_NODES:
        return lines.join(F.broadcast(nodes.drop("n_pages")), ["host", "h1", "h2"])
    return skew_safe_join(lines, nodes, ["host", "h1", "h2"], "n_pages", lines.count())


def blocks(content: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repeated lines with their block (host, h1, h2, n_pages, n_base, block), and their occurrences (page_id, line_no, block)."""
    nodes, paged = _counted(_pages(content, pages))
    nodes = materialize(nodes)
    n_nodes = nodes.count()
    key = ["host", "h1", "h2"]
    exploded = paged.select("page_id", "host", F.posexplode("lines").alias("seq", "x")).select("page_id", "host", "seq", "x.line_no", "x.h1", "x.h2")
    hits = materialize(_join_nodes(exploded, nodes.select(*key, "n_pages"), n_nodes))
    # consecutive repeated lines of a page, pre-aggregated to weighted edges
    runs = hits.groupBy("page_id", "host").agg(F.array_sort(F.collect_set(F.struct("seq", "h1", "h2"))).alias("s"))
    steps = F.filter(F.zip_with("s", F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: x["b"]["seq"] == x["a"]["seq"] + 1)
    edges = runs.select("host", F.explode(steps).alias("x")).groupBy(
        "host", F.col("x.a.h1").alias("h1"), F.col("x.a.h2").alias("h2"), F.col("x.b.h1").alias("g1"), F.col("x.b.h2").alias("g2")
    ).agg(F.count("*").alias("w")).where(F.col("w") >= MIN_PAGES).drop("w")
    loops = nodes.select("host", "h1", "h2", F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    comp = edges.unionByName(loops).groupBy("host").applyInPandas(_components, "host string, h1 bigint, h2 bigint, block bigint")
    known = materialize(nodes.join(comp, key))
    return known, _join_nodes(hits, known.select(*key, "block", "n_pages"), n_nodes).select("page_id", "line_no", "block")


def block_sizes(content: DataFrame, pages: DataFrame) -> DataFrame:
    """(host, n_lines, n_blocks): how many blocks of each host have so many lines."""
    b = blocks(content, pages)[0].groupBy("host", "block").agg(F.count("*").alias("n_lines"))
    return b.groupBy("host", "n_lines").agg(F.count("*").alias("n_blocks"))


def found(content: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, line_no): every occurrence of a repeated line.

    Null or blank texts, pages without a host or without a row in ``pages``
    count nowhere. Identical extractions of a page count as one page.
    """
    return blocks(content, pages)[1].select("page_id", "line_no").distinct()


def removed(content: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, text, n_removed): each distinct text of a page without its repeated lines; null texts stay null."""
    occ = found(content, pages).groupBy("page_id").agg(F.collect_set("line_no").alias("cut"))
    c = content.select("page_id", "text").distinct()
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.coalesce(F.array_contains("cut", (i + 1).cast("int")), F.lit(False)))
    return c.join(occ, "page_id", "left").select("page_id", F.array_join(kept, "\n").alias("text"), F.coalesce(F.size("cut"), F.lit(0)).alias("n_removed"))
