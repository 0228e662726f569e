"""Scoring against labelled data."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from folio.functions.matching import matched_size

#: Cases named with a kind of failure; all of them are rows of the failures themselves.
FIRST_CASES = 100
# Kinds of failure, in their order.
TAXONOMY = (
    "FETCH_ERROR", "ENCODING_ERROR", "PAGE_TYPE_FALSE_POSITIVE", "PAGE_TYPE_FALSE_NEGATIVE", "PAGE_TYPE_WRONG_CLASS", "CONTENT_FALSE_POSITIVE",
    "CONTENT_TRUNCATED", "CONTENT_NOISE_INCLUDED", "CONTENT_STATUS_WRONG", "CATALOG_NOT_FOUND", "CATALOG_WRONG_GROUP", "CATALOG_WRONG_DIRECTION",
    "CATALOG_PAGINATION_MISSED", "CONTENT_PAGINATION_MISSED", "CONTENT_PAGINATION_OVERMERGED", "NAVIGATION_WRONG_RELATION", "METADATA_WRONG_TITLE",
    "METADATA_WRONG_AUTHOR", "ACCESS_PAGE_MISCLASSIFIED", "CHAPTER_MISSING", "READING_ORDER_WRONG", "EXPORT_INCOMPLETE_NOT_REPORTED",
)


def roll_up(samples: DataFrame, dims: list[str]) -> DataFrame:
    """(metric, dims..., level, numerator, denominator, value, n): overall and by each dimension in one pass; no value at a zero denominator."""
    s = samples.select("metric", *dims, "numerator", "denominator")
    view = "metric, " + ", ".join(dims)
    sets = ", ".join(["(metric)"] + [f"(metric, {d})" for d in dims])
    level = "CASE " + " ".join(f"WHEN grouping({d}) = 0 THEN '{d}'" for d in dims) + " ELSE 'overall' END"
    return s.sparkSession.sql(
        f"SELECT {view}, {level} AS level, CAST(sum(numerator) AS BIGINT) AS numerator, CAST(sum(denominator) AS BIGINT) AS denominator, "
        f"sum(numerator) / nullif(sum(denominator), 0) AS value, count(*) AS n FROM {{samples}} GROUP BY GROUPING SETS ({sets})", samples=s
    )


def gate(samples: DataFrame) -> DataFrame:
    """(metric, value): weighted mean; a metric without weight passes with 1."""
    return samples.groupBy("metric").agg(F.coalesce(F.sum("numerator") / F.nullif(F.sum("denominator"), F.lit(0)), F.lit(1.0)).alias("value"))


def confusion(pairs: DataFrame, classes: list[str]) -> DataFrame:
    """One row per expected class, one zero-filled column per predicted class."""
    spark = pairs.sparkSession
    c = pairs.groupBy("expected").pivot("predicted", classes).count()
    domain = spark.createDataFrame([(k,) for k in classes], "expected string")
    return domain.join(c, "expected", "left").select("expected", *[F.coalesce(F.col(f"`{k}`"), F.lit(0)).cast("bigint").alias(k) for k in classes])


def failure_counts(failures: DataFrame) -> DataFrame:
    """(category, n, cases): all categories, zero-filled; cases: the first FIRST_CASES of each, in order."""
    domain = failures.sparkSession.createDataFrame([(k,) for k in TAXONOMY], "category string")
    n = failures.groupBy("category").agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("category").orderBy("case_id"))
    some = failures.select("category", "case_id").distinct().withColumn("r", first).where(F.col("r") <= FIRST_CASES).groupBy("category").agg(F.array_sort(F.collect_list("case_id")).alias("cases"))
    g = n.join(some, "category", "left")
    return domain.join(g, "category", "left").select("category", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.coalesce("cases", F.array().cast("array<string>")).alias("cases"))


def page_type_failure(expected: Column, predicted: Column) -> Column:
    """Kind of a page-type mistake; null if there is none."""
    return (
        F.when(expected == predicted, None).when(expected == "UNKNOWN", "PAGE_TYPE_FALSE_POSITIVE").when(predicted == "UNKNOWN", "PAGE_TYPE_FALSE_NEGATIVE").otherwise("PAGE_TYPE_WRONG_CLASS")
    )


def misclassified(pairs: DataFrame) -> DataFrame:
    """(case_id, expected, predicted): the pairs off the diagonal of the confusion."""
    return pairs.where(~F.col("expected").eqNullSafe(F.col("predicted"))).select("case_id", "expected", "predicted")


# Suites and tags that decide what kind of sample a case is.
DYNAMIC_SUITE, ACCESS_SUITE = "CN_DYNAMIC_INPUT", "CN_ACCESS_STATE"
CHALLENGE_TAGS = ("anti_bot", "challenge", "http_403", "http_200_challenge", "restricted", "paywall", "login_required")


def sample_type(suite: Column, tags: Column, input_kinds: Column, source_type: Column) -> Column:
    """dynamic, challenge, real_fixture or synthetic: the first that fits a case."""
    has = lambda a, words: F.coalesce(F.arrays_overlap(a, F.array(*map(F.lit, words))), F.lit(False))
    return (
        F.when((suite == DYNAMIC_SUITE) | has(input_kinds, ("BROWSER_DOM",)), "dynamic").when((suite == ACCESS_SUITE) | has(tags, CHALLENGE_TAGS), "challenge")
        .when(source_type == "real_capture", "real_fixture").otherwise("synthetic")
    )


#: What a page was found to be, as score_pages takes it.
PREDICTION = (
    "page_id bigint, page_type string, page_type_confidence double, content_status string, content_status_confidence double, content string, content_confidence double, book_title string, title_confidence double, "
    "author string, author_confidence double, links map<string,string>, link_confidence double, entries array<struct<title:string,target_url:string>>, catalog_confidence double, direction string"
)
#: What a page should be; a null label is not scored.
LABEL = (
    "case_id string, sample_type string, page_id bigint, page_type string, content_status string, access_status string, has_metadata boolean, book_title string, author string, has_content boolean, reference string, "
    "forbidden array<string>, entries array<struct<title:string,target_url:string>>, direction string, relations array<struct<type:string,target_url:string>>, encoding_sensitive boolean"
)
# Statuses that restrict access; relations by the kind of their pagination.
RESTRICTED = ("ACCESS_RESTRICTED", "PAYWALL", "LOGIN_REQUIRED", "ANTI_BOT", "NOT_FOUND")
CHAPTER_RELATIONS = ("PREVIOUS_CHAPTER", "NEXT_CHAPTER", "CATALOG_LINK")
PAGE_RELATIONS = {"NEXT_CONTENT_PAGE": "NEXT_PAGE", "NEXT_CATALOG_PAGE": "NEXT_PAGE", "PREVIOUS_CATALOG_PAGE": "PREVIOUS_PAGE"}


def _sample(on: Column, metric: str, numerator: Column, denominator: Column, category: Column | str, expected: Column, actual: Column, confidence: Column) -> Column:
    """A sample where ``on`` holds, else null; its kind of failure only if it falls short."""
    kind = F.lit(category) if isinstance(category, str) else category
    n, m = numerator.cast("bigint"), denominator.cast("bigint")
    return F.when(on, F.struct(
        F.lit(metric).alias("metric"), n.alias("numerator"), m.alias("denominator"), F.when(n < m, kind).alias("category"), expected.cast("string").alias("expected"), actual.cast("string").alias("actual"), confidence.cast("double").alias("confidence"),
    ))


SAMPLE = ("case_id", "sample_type", "sample_id", "metric", "numerator", "denominator", "category", "expected", "actual", "confidence")


def score_pages(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Samples (see SAMPLE) of every labelled page against what it was found to be: one join, then all by page.

    A page without a prediction is one failed sample of page_present. Null labels
    give no sample; ratios of nothing have denominator 0 and weigh nothing.
    """
    p = predictions.select(F.col("page_id").alias("p_id"), F.struct("*").alias("p"))
    j = labels.select("case_id", "sample_type", "page_id", F.struct("*").alias("l")).join(p, F.col("page_id") == F.col("p_id"), "left")
    lab, got, one = F.col("l"), F.col("p"), F.lit(1)
    here = got.isNotNull()
    none = F.lit(None)
    is_ = lambda a, b: a.eqNullSafe(b).cast("int")
    access = F.when(got["content_status"].isin(*RESTRICTED), got["content_status"]).otherwise("OK")
    emitted = got["book_title"].isNotNull() | got["author"].isNotNull()
    matched = matched_chars(got["content"], lab["reference"])
    scored = here & (lab["has_content"]) & lab["reference"].isNotNull()
    lost = lambda kind: F.when(lab["encoding_sensitive"], "ENCODING_ERROR").otherwise(kind)
    want, have = F.array_distinct(lab["entries"]), F.array_distinct(F.coalesce(got["entries"], F.array().cast("array<struct<title:string,target_url:string>>")))
    hit = F.size(F.array_intersect(want, have))
    listed = here & (F.size(lab["entries"]) > 0)
    body = F.when(got["content_status"] == "CONTENT_OK", F.coalesce(got["content"], F.lit(""))).otherwise("")
    rows = [
        _sample(~here, "page_present", F.lit(0), one, "FETCH_ERROR", F.lit("a prediction"), none, none),
        _sample(here & lab["page_type"].isNotNull(), "page_type_accuracy", is_(lab["page_type"], got["page_type"]), one, page_type_failure(lab["page_type"], got["page_type"]), lab["page_type"], got["page_type"], got["page_type_confidence"]),
        _sample(here & lab["content_status"].isNotNull(), "content_status_accuracy", is_(lab["content_status"], got["content_status"]), one, "CONTENT_STATUS_WRONG", lab["content_status"], got["content_status"], got["content_status_confidence"]),
        _sample(here & lab["access_status"].isNotNull(), "access_status_accuracy", is_(lab["access_status"], access), one, "ACCESS_PAGE_MISCLASSIFIED", lab["access_status"], access, got["content_status_confidence"]),
        _sample(
            here & ~lab["has_metadata"], "metadata_suppression", (~emitted).cast("int"), one, F.when(got["book_title"].isNotNull(), "METADATA_WRONG_TITLE").otherwise("METADATA_WRONG_AUTHOR"), none,
            F.concat_ws("|", got["book_title"], got["author"]), F.greatest(got["title_confidence"], got["author_confidence"]),
        ),
        _sample(here & lab["book_title"].isNotNull(), "book_title_accuracy", is_(lab["book_title"], got["book_title"]), one, "METADATA_WRONG_TITLE", lab["book_title"], got["book_title"], got["title_confidence"]),
        _sample(here & lab["author"].isNotNull(), "author_accuracy", is_(lab["author"], got["author"]), one, "METADATA_WRONG_AUTHOR", lab["author"], got["author"], got["author_confidence"]),
        _sample(scored, "content_retained_chars", F.coalesce(F.col("matched"), F.lit(0)), F.length(compared(lab["reference"])), lost("CONTENT_TRUNCATED"), F.length(lab["reference"]), F.col("matched"), got["content_confidence"]),
        _sample(scored, "content_precision_chars", F.coalesce(F.col("matched"), F.lit(0)), F.length(compared(F.coalesce(got["content"], F.lit("")))), lost("CONTENT_NOISE_INCLUDED"), F.length(lab["reference"]), F.col("matched"), got["content_confidence"]),
        _sample(here & ~lab["has_content"], "unsafe_body_rejection", (got["content_status"] != "CONTENT_OK").cast("int"), one, "CONTENT_FALSE_POSITIVE", F.lit("no body"), got["content_status"], got["content_status_confidence"]),
        _sample(listed, "catalog_recall", hit, F.size(want), F.when(F.size(have) == 0, "CATALOG_NOT_FOUND").otherwise("CATALOG_WRONG_GROUP"), F.size(want), F.size(have), got["catalog_confidence"]),
        _sample(listed, "catalog_precision", hit, F.size(have), "CATALOG_WRONG_GROUP", F.size(want), F.size(have), got["catalog_confidence"]),
        _sample(here & lab["direction"].isNotNull(), "catalog_direction_accuracy", is_(lab["direction"], got["direction"]), one, "CATALOG_WRONG_DIRECTION", lab["direction"], got["direction"], got["catalog_confidence"]),
    ]
    target = lambda r, names: F.try_element_at(got["links"], F.coalesce(*[F.when(r["type"] == k, F.lit(v)) for k, v in names.items()]))
    chapter = {k: k for k in CHAPTER_RELATIONS}
    many = [
        F.transform(F.coalesce(lab["forbidden"], F.array().cast("array<string>")), lambda x: _sample(here, "body_noise_exclusion", (~body.contains(x)).cast("int"), one, "CONTENT_NOISE_INCLUDED", x, none, got["content_confidence"])),
        F.transform(F.coalesce(lab["relations"], F.array().cast("array<struct<type:string,target_url:string>>")), lambda r: F.coalesce(
            _sample(here & r["type"].isin(*chapter), "navigation_accuracy", is_(target(r, chapter), r["target_url"]), one, "NAVIGATION_WRONG_RELATION", r["target_url"], target(r, chapter), got["link_confidence"]),
            _sample(
                here & r["type"].isin(*PAGE_RELATIONS), "pagination_relation_accuracy", is_(target(r, PAGE_RELATIONS), r["target_url"]), one, F.when(r["type"] == "NEXT_CONTENT_PAGE", "CONTENT_PAGINATION_MISSED").otherwise("CATALOG_PAGINATION_MISSED"),
                r["target_url"], target(r, PAGE_RELATIONS), got["link_confidence"],
            ),
        )),
    ]
    j = j.withColumn("matched", F.when(scored, matched))
    x = j.select("case_id", "sample_type", F.col("page_id").cast("string").alias("sample_id"), F.explode(F.array_compact(F.concat(F.array(*rows), *many))).alias("x"))
    return x.select("case_id", "sample_type", "sample_id", "x.*").select(*SAMPLE)


def abstained(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """(case_id, abstentions): labelled good chapters that were not taken for such."""
    j = labels.join(predictions.select("page_id", F.col("content_status").alias("got")), "page_id")
    return j.groupBy("case_id").agg(F.count_if((F.col("content_status") == "CONTENT_OK") & (F.col("got") != "CONTENT_OK")).alias("abstentions"))


def score_chapters(logical: DataFrame, found: DataFrame) -> DataFrame:
    """Samples of a case's chapters by their position.

    logical: case_id, sample_type, pos, chapter_id, source_urls, reference,
    encoding_sensitive; found: case_id, pos, source_urls, content. reading_chain_exact
    holds if a case has as many chapters as it should.
    """
    f = found.select(F.col("case_id").alias("c"), F.col("pos").alias("q"), F.col("source_urls").alias("got_urls"), "content", F.lit(True).alias("here"))
    j = logical.join(f, (F.col("case_id") == F.col("c")) & (F.col("pos") == F.col("q")), "left").withColumn("here", F.coalesce("here", F.lit(False)))
    j = j.withColumn("matched", F.when(F.col("here") & F.col("reference").isNotNull(), matched_chars(F.col("content"), F.col("reference"))))
    one, none, here = F.lit(1), F.lit(None), F.col("here")
    text = here & F.col("reference").isNotNull()
    lost = lambda kind: F.when(F.col("encoding_sensitive"), "ENCODING_ERROR").otherwise(kind)
    more = F.size(F.array_except("got_urls", "source_urls")) > 0
    urls_ = lambda c: F.array_join(c, " ")
    rows = F.array(
        _sample(F.lit(True), "logical_chapter_presence", here.cast("int"), one, "CHAPTER_MISSING", F.col("chapter_id"), none, none),
        _sample(here, "pagination_merge_accuracy", F.col("source_urls").eqNullSafe(F.col("got_urls")).cast("int"), one, F.when(more, "CONTENT_PAGINATION_OVERMERGED").otherwise("CONTENT_PAGINATION_MISSED"), urls_("source_urls"), urls_("got_urls"), none),
        _sample(text, "content_retained_chars", F.coalesce("matched", F.lit(0)), F.length(compared(F.col("reference"))), lost("CONTENT_TRUNCATED"), F.length("reference"), F.col("matched"), none),
        _sample(text, "content_precision_chars", F.coalesce("matched", F.lit(0)), F.length(compared(F.coalesce("content", F.lit("")))), lost("CONTENT_NOISE_INCLUDED"), F.length("reference"), F.col("matched"), none),
    )
    x = j.select("case_id", "sample_type", F.col("chapter_id").alias("sample_id"), F.explode(F.array_compact(rows)).alias("x")).select("case_id", "sample_type", "sample_id", "x.*")
    n = logical.groupBy("case_id", "sample_type").agg(F.count("*").alias("want")).join(found.groupBy("case_id").agg(F.count("*").alias("have")), "case_id", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    chain = n.select("case_id", "sample_type", F.col("case_id").alias("sample_id"), _sample(F.lit(True), "reading_chain_exact", (F.col("want") == F.col("have")).cast("int"), one, "READING_ORDER_WRONG", F.col("want"), F.col("have"), none).alias("x"))
    return x.unionByName(chain.select("case_id", "sample_type", "sample_id", "x.*")).select(*SAMPLE)


def groups(anchors: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Clusters of each page's chapter anchors for diagnosis: those of catalog.clusters with n_links, text_chars, selected and, given expected entries (page_id, href), n_expected and gold.

    selected: the list that was detected takes anchors from it; gold: the cluster
    with most of the expected entries.
    """
    from folio.operators import catalog

    k = catalog.clustered(anchors)
    taken = catalog.detect(anchors).select("page_id", "idx", F.lit(True).alias("taken"))
    k = k.join(taken, ["page_id", "idx"], "left")
    k = k.join(entries.select("page_id", "href", F.lit(True).alias("wanted")).distinct(), ["page_id", "href"], "left") if entries is not None else k.withColumn("wanted", F.lit(None).cast("boolean"))
    g = k.groupBy("page_id", "cluster").agg(
        F.sum(F.length("text")).alias("text_chars"), F.coalesce(F.bool_or("taken"), F.lit(False)).alias("selected"), F.count_if("wanted").alias("n_expected"),
    )
    g = g.withColumn("gold", (F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("n_expected"), "cluster")) == 1) & (F.col("n_expected") > 0))
    return catalog.clusters(anchors).join(g, ["page_id", "cluster"])


def precision_recall(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """(metric, numerator, denominator, value) of two sets of keys."""
    p, g = predicted.select(*keys).distinct(), gold.select(*keys).distinct()
    hit = p.join(g, keys).agg(F.count("*").alias("h"))
    n = p.agg(F.count("*").alias("p")).crossJoin(g.agg(F.count("*").alias("g"))).crossJoin(hit)  # one row each
    return n.select(F.explode(F.array(
        F.struct(F.lit("precision").alias("metric"), F.col("h").alias("numerator"), F.col("p").alias("denominator")), F.struct(F.lit("recall").alias("metric"), F.col("h").alias("numerator"), F.col("g").alias("denominator")),
    )).alias("x")).select("x.*", (F.col("x.numerator") / F.nullif(F.col("x.denominator"), F.lit(0))).alias("value"))


def compared(text: Column) -> Column:
    """A text as matched_chars compares it, but for composition, in length: line feeds only, trimmed."""
    return F.btrim(F.regexp_replace(text, "\r\n?", "\n"), F.lit(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"))


@F.pandas_udf(IntegerType())
def matched_chars(a: pd.Series, b: pd.Series) -> pd.Series:
    """Characters in matching blocks of two texts, both composed, with line feeds only and trimmed."""
    def norm(x: str) -> str:
        return unicodedata.normalize("NFC", x.replace("\r\n", "\n").replace("\r", "\n")).strip()

    def one(x: str | None, y: str | None) -> int | None:
        return None if x is None or y is None else matched_size(norm(x), norm(y))

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def violations(df: DataFrame, key: str, refs: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """(problem, n): duplicate keys, null keys and dangling references (other table, column here, column there)."""
    out = df.groupBy(key).agg(F.count("*").alias("c")).where(F.col(key).isNotNull() & (F.col("c") > 1)).agg(F.lit(f"duplicate {key}").alias("problem"), F.count("*").alias("n"))
    out = out.unionByName(df.where(F.col(key).isNull()).agg(F.lit(f"null {key}").alias("problem"), F.count("*").alias("n")))
    for other, here, there in refs:
        o = other.select(F.col(there).alias("__there")).where("__there IS NOT NULL").distinct()
        out = out.unionByName(df.where(F.col(here).isNotNull()).join(o, F.col(here) == F.col("__there"), "left_anti").agg(F.lit(f"dangling {here}").alias("problem"), F.count("*").alias("n")))
    return out
