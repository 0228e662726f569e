"""What is remembered about a host, and how a page is checked against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import urls

MAX_SEGMENTS, MAX_NAV = 8, 40
KINDS = ("hits", "misses", "invalidations")


def _most_frequent(rows: DataFrame, key: str, value: str, most: int, out: str) -> DataFrame:
    """Per key its ``most`` most frequent values; counts are pre-aggregated, and only a bounded list per key is kept."""
    c = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    top = c.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), value))).where(F.col("r") <= most)
    return top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", value))), lambda x: x[value]).alias(out))


def build(pages: DataFrame) -> DataFrame:
    """(host, n_pages, title_template, nav_texts, chapter_dir, chapter_dirname_numeric) from pages (host, url, title, nav array)."""
    p = pages.where("host IS NOT NULL")
    base = p.groupBy("host").agg(F.count("*").alias("n_pages"))
    seg = p.select("host", F.explode(F.array_distinct(F.filter(F.split(F.regexp_replace(F.coalesce("title", F.lit("")), "[0-9]+", "#"), r"[|｜_＿\-—·,，;；\s]+"), lambda x: x != ""))).alias("seg"))
    nav = p.select("host", F.explode(F.array_distinct("nav")).alias("t"))
    dirs = p.select("host", urls.directory(F.col("url")).alias("dir")).groupBy("host", "dir").agg(F.count("*").alias("n")).groupBy("host").agg(F.max_by("dir", F.struct("n", "dir")).alias("chapter_dir"))
    j = base.join(_most_frequent(seg, "host", "seg", MAX_SEGMENTS, "title_template"), "host", "left").join(_most_frequent(nav, "host", "t", MAX_NAV, "nav_texts"), "host", "left").join(dirs, "host", "left")
    return j.withColumn("chapter_dirname_numeric", F.regexp_extract("chapter_dir", r"([^/]*)$", 1).rlike("^[0-9]+$"))


def check(title: Column, url: Column, template: Column, chapter_dir: Column) -> Column:
    """Share of up to two checks passed (a title segment in common, the same directory); null without anything to check."""
    segs = F.split(F.regexp_replace(F.coalesce(title, F.lit("")), "[0-9]+", "#"), r"[|｜_＿\-—·,，;；\s]+")
    a = F.when(F.size(template) > 0, F.arrays_overlap(segs, template).cast("int"))
    b = F.when(chapter_dir.isNotNull(), (urls.directory(url) == chapter_dir).cast("int"))
    n = a.isNotNull().cast("int") + b.isNotNull().cast("int")
    return (F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))) / F.nullif(n, F.lit(0))


def signature_holds(stored: Column, now: Column) -> Column:
    """Whether at least half of the stored (tag, count) pairs are there."""
    return F.when(F.size(stored) == 0, False).otherwise(2 * F.size(F.array_intersect(stored, now)) >= F.size(stored))


def upsert(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Profiles with fresh ones in place of those of the same host; both have the same columns."""
    return stored.join(fresh.select("host"), "host", "left_anti").unionByName(fresh)


def record(stored: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Profiles with their counters hits, misses and invalidations raised by outcomes (host, kind); other kinds count nowhere, and hosts without a profile neither."""
    n = outcomes.groupBy("host").agg(*[F.count_if(F.col("kind") == k).alias(f"__{k}") for k in KINDS])
    j = stored.join(n, "host", "left")
    return j.select(*[(F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"__{c}"), F.lit(0))).cast("int").alias(c) if c in KINDS else F.col(c) for c in stored.columns])


def invalidate(stored: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """Profiles without those of ``hosts``; without any if none are given."""
    return stored.limit(0) if hosts is None else stored.join(hosts.select("host").distinct(), "host", "left_anti")


def safe_host(host: Column) -> Column:
    """A file name for a host's profile."""
    return F.regexp_replace(host, "[^A-Za-z0-9._-]", "_")
