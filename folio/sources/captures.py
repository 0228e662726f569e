"""Captured pages as a source, and requests answered from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import urls

# Marks of a page that needs scripts to show its text.
SHELL_MARKS = ("请开启javascript", "请开启 javascript", "enable javascript", "requires javascript", 'id="app"></div>', 'id="root"></div>')


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Captures kept as Parquet."""
    return spark.read.parquet(path)


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(url, raw_bytes): files of a folder as captures, with http://folder/file as url."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return f.select(F.concat(F.lit("http://"), F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)).alias("url"), F.col("content").alias("raw_bytes"))


# What a case's page may be, and where a case may come from.
INPUT_KINDS = ("HTTP_BYTES", "BROWSER_DOM")
SOURCE_TYPES = ("synthetic", "real_capture")


def read_case(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """Pages of JSON contract files, one row per page, with the errors of each page and its case.

    ``files`` (input_path, raw_bytes), if given, are the captured inputs: each page
    must have one, and its SHA-256 must be the stated one; raw_bytes is then a column.
    """
    c = spark.read.option("multiLine", True).json(path)
    for want in ("document_type", "source_type", "entry_page_id", "expected_path"):
        if want not in c.schema["case"].dataType.names:
            c = c.withColumn("case", F.col("case").withField(want, F.lit(None).cast("string")))
    p = c.select(*[F.col(f"case.{x}").alias(x) for x in ("case_id", "annotation_status", "document_type", "source_type", "entry_page_id", "expected_path")], F.explode("case.pages").alias("p")).withColumnRenamed("annotation_status", "status")
    for want in ("input_kind", "input_path", "http_metadata_path", "input_sha256"):
        if want not in p.schema["p"].dataType.names:
            p = p.withColumn("p", F.col("p").withField(want, F.lit(None).cast("string")))
    p = p.select("case_id", "status", "document_type", "source_type", "entry_page_id", "expected_path", "p.*")
    n = p.groupBy("case_id").agg(F.size(F.collect_set("page_id")).alias("ids"), F.size(F.collect_set("requested_url")).alias("urls"), F.count("*").alias("n"), F.bool_or(F.col("page_id") == F.col("entry_page_id")).alias("entry"))
    j = p.join(n, "case_id")
    missing = lambda x: F.coalesce(F.col(x), F.lit("")) == ""
    errs = [
        F.when(~F.col("status").eqNullSafe("READY"), "not ready"), F.when(F.coalesce("document_type", F.lit("benchmark_case")) != "benchmark_case", "no case"), F.when(F.col("source_type").isNotNull() & ~F.col("source_type").isin(*SOURCE_TYPES), "unknown source"),
        F.when(missing("case_id"), "no case id"), F.when(F.col("ids") < F.col("n"), "page_id repeated or missing"), F.when(F.col("urls") < F.col("n"), "requested_url repeated or missing"),
        F.when(~F.coalesce(F.col("requested_url"), F.lit("")).rlike("^https?://"), "no http url"), F.when(F.col("input_kind").isNotNull() & ~F.col("input_kind").isin(*INPUT_KINDS), "unknown kind of input"),
        F.when((F.col("input_kind") == "HTTP_BYTES") & missing("http_metadata_path"), "no HTTP metadata"), F.when(F.coalesce(F.length("input_sha256"), F.lit(0)) != 64, "no digest"), F.when(F.col("entry_page_id").isNotNull() & ~F.coalesce("entry", F.lit(False)), "unknown entry page"),
    ]
    if files is not None:
        j = j.join(files.select("input_path", "raw_bytes"), "input_path", "left")
        errs += [F.when(F.col("raw_bytes").isNull(), "no input"), F.when(F.sha2("raw_bytes", 256) != F.lower("input_sha256"), "another digest")]
    return j.withColumn("errors", F.array_compact(F.array(*errs))).drop("ids", "urls", "n", "entry")


def read_expected(spark: SparkSession, path: str, cases: DataFrame) -> DataFrame:
    """Page labels of JSON files of expected results, one row each, with errors against the pages (case_id, page_id) of their cases."""
    e = spark.read.option("multiLine", True).json(path)
    x = e.select("case_id", "annotation_status", "document_type", F.explode_outer("page_labels").alias("l")).select("case_id", "annotation_status", "document_type", "l.*")
    known = cases.select("case_id", "page_id", F.lit(True).alias("known")).distinct()
    twice = x.groupBy("case_id", "page_id").agg(F.count("*").alias("times"))
    j = x.join(known, ["case_id", "page_id"], "left").join(twice, ["case_id", "page_id"], "left").join(cases.select("case_id", F.lit(True).alias("has_case")).distinct(), "case_id", "left")
    err = F.array_compact(F.array(
        F.when(~F.col("document_type").eqNullSafe("benchmark_expected"), "no expected results"), F.when(~F.col("annotation_status").eqNullSafe("READY"), "not ready"), F.when(F.col("has_case").isNull(), "unknown case"),
        F.when(F.col("page_id").isNull(), "no label").when(F.col("known").isNull(), "unknown page"), F.when(F.col("times") > 1, "label repeated"),
    ))
    return j.withColumn("errors", err).drop("known", "times", "has_case", "annotation_status", "document_type")


def read_profiles(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """Host profiles kept as JSON lines; broken ones and those of another version are no profiles."""
    d = spark.read.option("mode", "DROPMALFORMED").json(path)
    return d.where(F.col("version") == version)


def latest(captures: DataFrame) -> DataFrame:
    """One capture per normalized url: the last received; ties go to the larger page_id. Null urls have none."""
    c = captures.withColumn("norm_url", urls.normalize_url(F.col("url"))).where("norm_url IS NOT NULL")
    keep = [x for x in captures.columns]
    return c.groupBy("norm_url").agg(F.max_by(F.struct(*keep), F.struct(F.coalesce("received_at", "captured_at"), "page_id")).alias("c")).select("norm_url", "c.*")


def answer(requests: DataFrame, captures: DataFrame) -> DataFrame:
    """Requests (url) with the capture of exactly that url, fragment included; none found: out of scope, never fetched."""
    c = captures.groupBy("url").agg(F.max("page_id").alias("page_id"))
    return requests.join(c, "url", "left").withColumn("out_of_scope", F.col("page_id").isNull())


def best_attempt(attempts: DataFrame, status: str = "status") -> DataFrame:
    """(url, ...): of several attempts the earliest good one, else the earliest; input has url, attempt and a status."""
    s = F.struct(*[c for c in attempts.columns if c != "url"])
    return attempts.groupBy("url").agg(F.min_by(s, F.struct((F.col(status) != "CONTENT_OK").cast("int"), F.col("attempt"))).alias("a")).select("url", "a.*")


def allowed(url: Column, host: Column, cross_domain: bool = False) -> Column:
    a = urls.authority(url)
    return a.isNotNull() & (F.lit(cross_domain) | (a == F.lower(host)))


def looks_incomplete(html: Column, n_bytes: Column) -> Column:
    """Whether a page is so small, or so marked, that a rendered capture should be taken instead."""
    low, out = F.lower(html), n_bytes < 3000
    for m in SHELL_MARKS:
        out = out | low.contains(m)
    return out


def prefer_rendered(static: DataFrame, rendered: DataFrame) -> DataFrame:
    """Static captures (url, html) with the rendered one where the static one is incomplete and there is one."""
    r = rendered.groupBy("url").agg(F.max("html").alias("rendered"))
    use = looks_incomplete(F.col("html"), F.octet_length("html")) & F.col("rendered").isNotNull()
    return static.join(r, "url", "left").withColumn("escalated", F.coalesce(use, F.lit(False))).withColumn("html", F.when(F.col("escalated"), F.col("rendered")).otherwise(F.col("html"))).drop("rendered")
