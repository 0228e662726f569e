"""Book metadata from ranked candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marketing phrases removed from titles, values that are no title.
TITLE_NOISE = (
    "最新章节列表", "最新章节", "章节列表", "全文阅读", "全文免费阅读", "免费阅读", "无弹窗广告", "无弹窗", "无广告", "txt下载", "txt全集下载", "小说在线阅读", "在线阅读", "正文",
)
BAD_TITLES = ("首页", "官网", "首页-", "章节", "小说", "阅读")


def clean_title_value(c: Column) -> Column:
    x = F.btrim(F.regexp_replace(c, "(?i)" + "|".join(TITLE_NOISE), ""), F.lit(" |＿_-—·,，:："))
    return F.when((x != "") & ~F.lower(x).isin(*BAD_TITLES), x)


def clean_author_value(c: Column) -> Column:
    x = F.btrim(c, F.lit(" \t:：,，。|"))
    return F.when((x != "") & (F.length(x) <= 30), x)


def title_from_template(title: Column) -> Column:
    """First acceptable segment of a page's title."""
    parts = F.filter(F.transform(F.split(title, r"[|｜_＿\-—－·,，;；\s　]+"), clean_title_value), lambda x: x.isNotNull())
    return F.try_element_at(parts, F.lit(1))


def _meta(name: str) -> Column:
    return F.try_element_at(F.filter("metas", lambda m: (m["name"] == name) & (m["content"] != "")), F.lit(1))["content"]


def _ld(path: str) -> Column:
    """A member of the first JSON-LD object of a book, in a list or graph of them as well; null for broken JSON. A name may be a string, an object or a list."""
    def pick(x: Column) -> Column:
        kind = F.lower(F.coalesce(F.get_json_object(x, "$['@type']"), F.lit("")))
        ok = kind.contains("book") | kind.contains("creativecontent")
        return F.when(ok, F.coalesce(F.get_json_object(x, f"$.{path}.name"), F.get_json_object(x, f"$.{path}[0].name"), F.get_json_object(x, f"$.{path}[0]"), F.get_json_object(x, f"$.{path}")))

    def each(x: Column) -> Column:
        many = lambda j: F.coalesce(F.from_json(j, "array<string>"), F.array().cast("array<string>"))
        return F.concat(F.array(x), many(x), many(F.get_json_object(x, "$['@graph']")))

    return F.try_element_at(F.filter(F.transform(F.flatten(F.transform("json_ld", each)), pick), lambda x: x.isNotNull()), F.lit(1))


def metadata(d: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(page_id, ``keep``, book_title, title_source, title_confidence, author, author_source, author_confidence, description, cover_url, volume_title)."""
    h1 = F.try_element_at(F.filter("headings", lambda h: (h["level"] == 1) & (h["text"] != "")), F.lit(1))["text"]
    label = F.nullif(F.regexp_extract("page_text", r"作\s*者\s*[:：]\s*([^\s，。；;，|\n]{1,30})", 1), F.lit(""))
    english = F.nullif(F.regexp_extract("page_text", r"(?i)author\s*[:：]\s*([^，。；;，|\n]{1,40})", 1), F.lit(""))

    def best(cands: list[tuple[Column, str, float]]) -> Column:
        rows = [F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(src).alias("source"), F.lit(conf).alias("confidence"))) for v, src, conf in cands]
        return F.coalesce(*rows)  # candidates come in the order of their confidence

    titles = best([
        (clean_title_value(_ld("name")), "json_ld", 0.90), (clean_title_value(_meta("og:novel:book_name")), "og:novel", 0.85), (clean_title_value(_meta("og:title")), "og:title", 0.70),
        (clean_title_value(h1), "h1", 0.65), (title_from_template(F.col("title")), "title", 0.45),
    ])
    authors = best([
        (clean_author_value(_ld("author")), "json_ld", 0.90), (clean_author_value(_meta("og:novel:author")), "og:novel", 0.85), (clean_author_value(label), "label", 0.80),
        (clean_author_value(english), "label_en", 0.75), (clean_author_value(_meta("author")), "meta", 0.70),
    ])
    keep = keep or []
    return d.select("page_id", *[c for c in keep if c != "metas"], "metas", titles.alias("t"), authors.alias("a")).select(
        "page_id", *keep, F.col("t.value").alias("book_title"), F.col("t.source").alias("title_source"), F.col("t.confidence").alias("title_confidence"),
        F.col("a.value").alias("author"), F.col("a.source").alias("author_source"), F.col("a.confidence").alias("author_confidence"),
        F.left(F.coalesce(_meta("og:description"), _meta("description")), F.lit(300)).alias("description"), F.coalesce(_meta("og:image"), _meta("image_src")).alias("cover_url"),
        _meta("og:novel:volume").alias("volume_title"),
    )


def page_title(d: DataFrame) -> DataFrame:
    """(page_id, page_title): see title_of."""
    return d.select("page_id", title_of().alias("page_title"))


def title_of() -> Column:
    """Of a parsed page the first heading that is a chapter title, else the first heading, else the title."""
    from folio.operators.content import strong_title

    heads = F.filter("headings", lambda h: h["text"] != "")
    strong = F.try_element_at(F.filter(heads, lambda h: strong_title(h["text"])), F.lit(1))["text"]
    return F.coalesce(strong, F.try_element_at(heads, F.lit(1))["text"], F.nullif(F.col("title"), F.lit("")))
