"""Mixing sources to target weights (problem 8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.util import materialize

#: Beyond so many target sources their rates are joined by a shuffle with salt, not a broadcast.
BROADCAST_SOURCES = 100_000
SALTS = 64
SEED = "mix-1"


def tokens(text: Column) -> Column:
    """Tokens of the ByT5 tokenizer without special tokens: bytes of UTF-8. Null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def rates(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: its tokens, the tokens wanted, the repetition rate and whether the cap stops it short.

    The mixture is as large as all of ``docs``. Rate = wanted / tokens, at most
    max_repeats. A source without documents has 0 tokens and rate 0. Targets with
    a null source, share or cap are ignored; a source named twice counts once
    with the larger share. One row per source; sources are pre-aggregated before
    any shuffle.
    """
    per = docs.groupBy(F.col("source")).agg(F.sum(tokens(F.col("text"))).alias("tokens"), F.count("*").alias("n_docs"))
    total = per.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("total_tokens"))
    t = targets.where("source IS NOT NULL AND target_share IS NOT NULL AND max_repeats IS NOT NULL").groupBy("source").agg(
        F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")
    )
    j = t.join(per, "source", "left").crossJoin(F.broadcast(total))  # one row
    wanted = F.col("target_share") * F.col("total_tokens")
    have = F.coalesce("tokens", F.lit(0)).cast("bigint")
    return j.select(
        "source", "target_share", "max_repeats", have.alias("tokens"), "total_tokens", wanted.alias("wanted_tokens"),
        F.when(have > 0, F.least(wanted / F.nullif(have, F.lit(0)), F.col("max_repeats").cast("double"))).otherwise(F.lit(0.0)).alias("rate"),
        (F.col("max_repeats") * have < wanted).alias("short"),
    )


def unit_hash(id_col: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id and the seed alone: a rerun draws the same."""
    h = F.md5(F.concat(F.lit(seed + ":"), id_col.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _with_rates(docs: DataFrame, r: DataFrame, broadcast_sources: int) -> DataFrame:
    """Documents with their source's rate, null without one. A source may hold a third of all documents."""
    if r.count() <= broadcast_sources:
        return docs.join(F.broadcast(r), docs["source"] == r["r_source"], "left")
    salted = r.withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    d = docs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return d.join(salted, (d["source"] == salted["r_source"]) & (d["salt"] == salted["r_salt"]), "left")


def _used(docs: DataFrame, r: DataFrame, seed: str, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    d = docs.select("doc_id", "source", tokens(F.col("text")).alias("tokens"))
    j = _with_rates(d, r.select(F.col("source").alias("r_source"), "rate"), broadcast_sources)
    rate = F.coalesce("rate", F.lit(0.0))
    extra = (unit_hash(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("int")
    return j.select("doc_id", "source", "tokens", (F.floor(rate) + F.coalesce(extra, F.lit(0))).cast("int").alias("n_uses"))


def uses(docs: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, source, tokens, n_uses): floor(rate) uses and one more with the fraction's probability.

    Documents of sources without a target (or with a null source) get 0 uses.
    n_uses never exceeds max_repeats. The texts are read twice: for the tokens of
    the sources, which are written, and for the draw.
    """
    return _used(docs, materialize(rates(docs, targets)), seed)


def report(docs: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """(source, target_share, actual_share, used_tokens, short): shares of the mixture that was drawn."""
    known = materialize(rates(docs, targets))
    u = materialize(_used(docs, known, seed).groupBy("source").agg(F.sum(F.col("tokens") * F.col("n_uses")).cast("bigint").alias("used_tokens")))
    all_used = u.agg(F.sum("used_tokens").cast("bigint").alias("all_used"))
    r = known.join(u, "source", "left").crossJoin(F.broadcast(all_used))  # one row
    used = F.coalesce("used_tokens", F.lit(0)).cast("bigint")
    return r.select("source", "target_share", (used / F.nullif(F.col("all_used"), F.lit(0))).alias("actual_share"), used.alias("used_tokens"), "short")


def mixture(docs: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixture itself: (doc_id, use_no) with use_no from 1, one row per use."""
    return uses(docs, targets, seed).where("n_uses > 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n_uses"))).alias("use_no"))
