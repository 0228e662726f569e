"""Main-content selection, page type and access status, without a shuffle: all per page, on nested columns."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from folio.functions.titles import let, parse_title

STRONG = 0.85
#: The re-scan ends with so many containers of a page, as in the reference.
RESCANNED = 33
# Words of the page-type features.
PREV_NEXT_WORDS = ("上一章", "下一章", "上一页", "下一页", "上一节", "下一节")
CATALOG_WORD = "目录"
INTRO_WORDS = ("简介", "内容简介", "作品简介")
AUTHOR_LABELS = ("作者：", "作者:", "作 者：")
# Phrases of restricted pages, in the order of their categories.
PHRASES = (
    ("ANTI_BOT", 0.80, ("请开启javascript", "请开启 javascript", "开启浏览器javascript", "人机验证", "安全验证", "验证码", "请完成验证", "cf-browser-verification", "challenge-platform", "checking your browser", "enable javascript and cookies")),
    ("LOGIN_REQUIRED", 0.80, ("请登录", "请先登录", "登录后阅读", "登录后查看", "登陆后阅读", "需要登录", "请登陆", "login to read", "sign in to read")),
    ("PAYWALL", 0.80, ("订阅后阅读", "订阅本章", "订阅后查看", "付费章节", "vip章节", "请购买本章", "解锁本章", "本章为付费", "充值后阅读", "购买后阅读", "subscribe to read", "premium chapter")),
    ("ACCESS_RESTRICTED", 0.75, ("权限不足", "无权访问", "禁止访问", "访问受限", "内容已被删除", "内容不存在", "已被删除", "该内容无法显示")),
    ("NOT_FOUND", 0.70, ("页面不存在", "网页不存在", "您访问的页面", "page not found", "404 not found")),
)
BOT_MARKS = ("cf-browser-verification", "challenge-platform", "checking your browser", "jschl")


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def strong_title(text: Column) -> Column:
    return F.coalesce(parse_title(text)["confidence"] >= STRONG, F.lit(False))


def density_score(n: Column, titled: Column) -> Column:
    """Weighted text, punctuation, paragraphs, links and ideographs of a candidate node, in [0, 1]."""
    ratio = F.when(n["text_len"] > 0, n["link_len"] / n["text_len"]).otherwise(F.lit(1.0))
    cjk = F.when(n["text_len"] > 0, n["cjk"] / n["text_len"]).otherwise(F.lit(0.0))
    # fixed values: the weights of the score
    s = (
        0.30 * F.least(F.lit(1.0), n["text_len"] / 500.0) + 0.20 * F.least(F.lit(1.0), n["punct"] / 20.0) + 0.15 * F.least(F.lit(1.0), n["paragraphs"] / 5.0)
        + 0.20 * F.greatest(F.lit(0.0), 1.0 - ratio * 2.0) + 0.15 * cjk
        + F.when(n["tag"].isin("article", "main"), 0.05).otherwise(0.0) + F.when(titled, 0.08).otherwise(0.0) - F.when(ratio > 0.5, 0.10).otherwise(0.0)
    )
    return F.when(n["text_len"] == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)))


def scored_nodes(d: DataFrame) -> DataFrame:
    """The page's candidates with score, link_ratio and whether a chapter title is among their headings."""
    def one(n: Column) -> Column:
        titled = F.exists(F.slice("strong", n["head_from"] + 1, n["n_heads"]), lambda x: x)
        return let(titled, lambda t: F.struct(
            density_score(n, t).alias("score"), n["depth"].alias("depth"), (-n["node_id"]).alias("order"), t.alias("titled"),
            F.when(n["text_len"] > 0, n["link_len"] / n["text_len"]).otherwise(F.lit(1.0)).alias("link_ratio"), (-n["n_heads"]).alias("fewer"), n.alias("n"),
        ))

    return d.withColumn("strong", F.transform("headings", lambda h: strong_title(h["text"]))).withColumn("scored", F.transform("nodes", one))


def node_text(n: Column) -> Column:
    """A node's lines as one text."""
    return F.array_join(F.slice("lines", n["line_from"] + 1, n["n_lines"]), "\n")


def _explain(n: Column, ratio: Column) -> tuple[Column, Column]:
    good = F.array_compact(F.array(
        F.when(n["text_len"] >= 500, F.lit("long text")).when(n["text_len"] >= 200, F.lit("substantial text")),
        F.when(n["paragraphs"] >= 5, F.lit("many paragraphs")), F.when(ratio <= 0.3, F.lit("few links")), F.when(n["punct"] >= 20, F.lit("prose punctuation")),
    ))
    bad = F.array_compact(F.array(F.when(ratio > 0.5, F.lit("mostly links")), F.when(n["text_len"] < 200, F.lit("short text"))))
    return good, bad


def pick_content(d: DataFrame) -> DataFrame:
    """(page_id, node_id, ...): each page's content, see with_pick."""
    return with_pick(d, []).select("page_id", "pick.*")


def with_pick(d: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Pages as ``d`` has them (or its columns ``keep``) with their content as a struct pick, without a shuffle.

    (node_id, tag, text, score, confidence, link_ratio, anchored, positives, penalties, deep).

    The deepest container of a chapter title with prose wins; else the densest
    candidate, a deeper one among the next five within 0.02; else the whole body
    at confidence 0.35; a page without text has an empty text at confidence 0.
    deep is the densest of the first containers over looser thresholds, null if there
    is none; its text is null if it is the picked node.
    """
    keep = [c for c in (d.columns if keep is None else keep) if c != "page_id"]
    s = scored_nodes(d)
    cand = F.filter("scored", lambda x: x["n"]["tag"].isin("div", "article", "main", "section") & (x["n"]["text_len"] >= 50) & (x["score"] > 0.15))
    s = s.withColumn("cand", cand)
    anchored = F.filter("cand", lambda x: x["titled"] & (x["n"]["paragraphs"] >= 2) & (x["n"]["punct"] >= 4) & (x["link_ratio"] <= 0.5))
    by_depth = F.array_max(F.transform(anchored, lambda x: F.struct(x["depth"].alias("a"), x["fewer"].alias("b"), x["score"].alias("c"), x["order"].alias("d"), x.alias("x"))))["x"]
    ranked = F.reverse(F.array_sort(F.transform("cand", lambda x: F.struct(x["score"].alias("a"), x["depth"].alias("b"), x["order"].alias("c"), x.alias("x")))))
    s = s.withColumn("by_depth", by_depth).withColumn("ranked", ranked)
    first = F.try_element_at("ranked", F.lit(1))["x"]
    near = F.aggregate(
        F.slice("ranked", 2, 5), first,
        lambda acc, y: F.when((F.try_element_at(F.col("ranked"), F.lit(1))["a"] - y["a"] <= 0.02) & (y["x"]["depth"] > acc["depth"]), y["x"]).otherwise(acc),
    )
    body = F.try_element_at(F.filter("scored", lambda x: x["n"]["tag"].isin("body", "#root")), F.lit(1))
    loose = F.slice(F.filter("scored", lambda x: x["n"]["tag"].isin("div", "article", "main", "section") & (x["n"]["text_len"] >= 30) & (x["score"] > 0.05)), 1, RESCANNED)
    again = F.array_max(F.transform(loose, lambda x: F.struct(x["score"].alias("a"), x["order"].alias("b"), x.alias("x"))))["x"]
    s = s.withColumn("again", again).withColumn("best", F.coalesce("by_depth", near, body)).withColumn("fallback", F.size("cand") == 0)
    n, ratio = F.col("best.n"), F.col("best.link_ratio")
    good, bad = _explain(n, ratio)
    empty = F.coalesce(n["text_len"], F.lit(0)) == 0
    # let: a struct that is only bound would be taken apart and computed again for each use of a field
    return s.select("page_id", *keep, let(F.struct(
        n["node_id"].alias("node_id"), n["tag"].alias("tag"), F.coalesce(node_text(n), F.lit("")).alias("text"), F.col("best.score").alias("score"),
        F.when(empty, 0.0).when(F.col("fallback"), 0.35).otherwise(0.40 + 0.55 * F.col("best.score")).alias("confidence"), ratio.alias("link_ratio"),
        F.col("by_depth").isNotNull().alias("anchored"), good.alias("positives"), bad.alias("penalties"), n["sibling_len"].alias("sibling_len"), n["near_h1"].alias("near_h1"), n["text_len"].alias("text_len"),
        F.when(F.col("again").isNotNull(), F.struct(
            F.col("again.n.tag").alias("tag"), F.when(F.col("again.n.node_id") != n["node_id"], node_text(F.col("again.n"))).alias("text"), F.col("again.score").alias("score"),
            F.col("again.n.sibling_len").alias("sibling_len"), F.col("again.n.near_h1").alias("near_h1"), F.col("again.n.text_len").alias("text_len"),
        )).alias("deep"),
    ), lambda x: x).alias("pick"))


def deep_confidence(picked: DataFrame) -> DataFrame:
    """(page_id, confidence, tag, text): weak picks give way to the best container of the re-scan, judged by competing siblings and closeness to the heading; without one they stay."""
    x = F.col("deep")
    near = F.when(x["near_h1"], F.least(F.lit(0.95), 0.35 + 0.5 * x["score"] + 0.08)).otherwise(0.35 + 0.5 * x["score"])
    rivals = x["sibling_len"] >= F.greatest(F.lit(200), 0.5 * x["text_len"])
    again = F.greatest(F.lit(0.2), F.least(F.lit(0.95), F.when(rivals, F.greatest(F.lit(0.3), near - 0.10)).otherwise(near)))
    weak = (F.col("confidence") < 0.60) & x.isNotNull()
    return picked.select("page_id", F.when(weak, again).otherwise(F.col("confidence")).alias("confidence"), F.when(weak, x["tag"]).otherwise(F.col("tag")).alias("tag"), F.when(weak, F.coalesce(x["text"], F.col("text"))).otherwise(F.col("text")).alias("text"))


@F.pandas_udf(DoubleType())
def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two whole texts; null if one is null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def combine(density: Column, density_conf: Column, baseline: Column, baseline_agrees: Column, anchored: Column) -> Column:
    """Struct (text, confidence) of two candidates; ``baseline`` may be null, as without a second extractor."""
    longer = F.length(baseline) > F.greatest(F.lit(300), 2 * F.length(density))
    return (
        F.when(baseline.isNull(), F.struct(density.alias("text"), density_conf.alias("confidence")))
        .when(baseline_agrees >= 0.7, F.struct(density.alias("text"), F.least(F.lit(0.99), density_conf + 0.10).alias("confidence")))
        .when(longer & ~anchored, F.struct(baseline.alias("text"), F.lit(0.70).alias("confidence")))
        .otherwise(F.struct(density.alias("text"), density_conf.alias("confidence")))
    )


def _longest_run(ids: Column) -> Column:
    """Size of the largest group of equal ids."""
    zero = F.struct(F.lit(None).cast("int").alias("p"), F.lit(0).alias("n"), F.lit(0).alias("m"))
    def step(a: Column, x: Column) -> Column:
        n = F.when(a["p"].eqNullSafe(x), a["n"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("p"), n.alias("n"), F.greatest(a["m"], n).alias("m"))

    return F.aggregate(F.array_sort(ids), zero, step, lambda a: a["m"])


def page_features(d: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The features page types are scored by, and the columns ``keep``, without a shuffle; picks content first if ``d`` has no pick."""
    keep = keep or []
    if "pick" not in d.columns:
        d = with_pick(d)
    texts = F.filter("anchors", lambda a: a["text"] != "")
    like = F.filter("anchors", lambda a: strong_title(a["text"]))
    h1 = F.coalesce(F.try_element_at(F.filter("headings", lambda h: h["level"] == 1), F.lit(1))["text"], F.lit(""))
    base = d.select(
        "page_id", F.length("page_text").alias("total_len"), "link_len", F.size(texts).alias("n_links"),
        F.size(F.filter(texts, lambda a: contains_any(a["text"], PREV_NEXT_WORDS))).alias("nav_markers"),
        F.exists(texts, lambda a: a["text"].contains(CATALOG_WORD)).alias("catalog_marker"), like.alias("like"), h1.alias("h1_text"), strong_title(h1).alias("h1_is_chapter"),
        (F.exists("metas", lambda m: (m["name"] == "description") & (m["content"] != "")) | contains_any(F.left("page_text", F.lit(3000)), INTRO_WORDS)).alias("has_intro"),
        contains_any(F.left("page_text", F.lit(5000)), AUTHOR_LABELS).alias("has_author_label"),
        F.length("pick.text").alias("content_len"), F.col("pick.confidence").alias("content_conf"), *keep,
    )
    p1, p2 = F.transform("like", lambda a: a["p1"]), F.transform("like", lambda a: a["p2"])
    return base.select(
        "*", F.size("like").alias("chapter_links"), F.greatest(_longest_run(p1), _longest_run(p2)).alias("cluster"),
        F.when(F.col("total_len") > 0, F.col("link_len") / F.col("total_len")).otherwise(F.lit(0.0)).alias("link_ratio"),
    ).drop("like")


def page_types(features: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(page_id, chapter, catalog, book, page_type, confidence, ``keep``): argmax of three scores, UNKNOWN below 0.5 or with a lead below 0.05."""
    def pts(*rules: tuple[Column, float]) -> Column:
        out = F.lit(None)
        for cond, v in reversed(rules):
            out = F.when(cond, F.lit(v)).otherwise(out)
        return F.coalesce(out, F.lit(0.0))

    c = F.col
    chapter = (
        pts((c("content_len") >= 800, 0.35), (c("content_len") >= 300, 0.22)) + pts((c("content_conf") >= 0.7, 0.15)) + pts((c("nav_markers") >= 2, 0.20), (c("nav_markers") == 1, 0.10))
        + pts((c("h1_is_chapter"), 0.25)) + pts((c("h1_is_chapter") & c("catalog_marker"), 0.10)) + pts((c("h1_is_chapter") & c("content_len").between(1, 99), 0.10))
        + pts((c("link_ratio") < 0.30, 0.10)) - pts((c("chapter_links") >= 8, 0.25))
    )
    catalog = (
        pts((c("chapter_links") >= 30, 0.50), (c("chapter_links") >= 15, 0.40), (c("chapter_links") >= 8, 0.30), (c("chapter_links") >= 5, 0.20))
        + pts((c("cluster") >= 10, 0.15), (c("cluster") >= 5, 0.10)) + pts((c("content_len") < 1500, 0.10)) + pts((c("catalog_marker"), 0.10))
        + pts(((c("chapter_links") >= 5) & (c("chapter_links") >= 0.6 * c("n_links")), 0.15))
    )
    book = (
        pts(((c("h1_text") != "") & ~c("h1_is_chapter"), 0.30)) + pts((c("has_author_label"), 0.25)) + pts((c("has_intro"), 0.15))
        + pts((c("chapter_links") <= 5, 0.10)) + pts((c("content_len").between(200, 2500), 0.10))
    )
    clamp = lambda x, top: F.greatest(F.lit(0.0), F.least(F.lit(top), x))
    keep = keep or []
    s = features.select("page_id", *keep, clamp(chapter, 0.95).alias("chapter"), clamp(catalog, 0.95).alias("catalog"), clamp(book, 0.85).alias("book"))
    order = F.reverse(F.array_sort(F.array(*[
        F.struct(F.col(n).alias("s"), F.lit(k).alias("k"), F.lit(t).alias("t")) for n, k, t in (("chapter", 3, "CHAPTER_PAGE"), ("catalog", 2, "CATALOG_PAGE"), ("book", 1, "BOOK_PAGE"))
    ])))
    s = s.withColumn("o", order)
    unsure = (F.col("o")[0]["s"] < 0.5) | (F.col("o")[0]["s"] - F.col("o")[1]["s"] < 0.05)
    return s.select("page_id", "chapter", "catalog", "book", F.when(unsure, F.lit("UNKNOWN")).otherwise(F.col("o")[0]["t"]).alias("page_type"), F.col("o")[0]["s"].alias("confidence"), *keep)


def trimmed_length(text: Column) -> Column:
    return F.length(F.btrim(text, F.lit(" \t\r\n　")))


def access_marks(server: Column, html: Column, page_text: Column) -> Column:
    """Struct (bot, phrases): what a page itself says on its access; all that access_from needs of it."""
    low, text = F.lower(html), F.lower(page_text)
    bot = F.lower(F.coalesce(server, F.lit(""))).contains("cloudflare") | contains_any(low, BOT_MARKS)
    return F.struct(F.coalesce(bot, F.lit(False)).alias("bot"), F.array(*[F.coalesce(contains_any(text, words), F.lit(False)) for _, _, words in PHRASES]).alias("phrases"))


def access_from(status_code: Column, marks: Column, n: Column, content_conf: Column, neighbours: Column) -> Column:
    """Struct (status, confidence): HTTP verdict, then phrases of short pages, then the length n, also against the neighbours' median."""
    starved = F.coalesce((neighbours >= 1000) & (n < 0.2 * neighbours), F.lit(False))

    def v(status: str, conf: Column | float) -> Column:
        return F.struct(F.lit(status).alias("status"), (F.lit(conf) if isinstance(conf, float) else conf).cast("double").alias("confidence"))

    out = (
        F.when(status_code.isin(404, 410), v("NOT_FOUND", 0.95)).when(status_code == 401, v("LOGIN_REQUIRED", 0.80))
        .when(status_code.isin(403, 429, 503) & marks["bot"], v("ANTI_BOT", 0.80)).when(status_code.isin(403, 429, 503), v("ACCESS_RESTRICTED", 0.70))
    )
    for i, (status, conf, _) in enumerate(PHRASES):
        out = out.when((n <= 500) & marks["phrases"][i], v(status, conf))
    return (
        out.when(n == 0, v("EMPTY_CONTENT", 0.85)).when((n < 200) & starved, v("EMPTY_CONTENT", 0.70)).when(n < 200, v("EMPTY_CONTENT", 0.60))
        .when(starved, v("EMPTY_CONTENT", 0.55)).otherwise(v("CONTENT_OK", F.greatest(F.lit(0.60), F.least(F.lit(0.95), content_conf))))
    )


def access_status(status_code: Column, server: Column, html: Column, page_text: Column, content: Column, content_conf: Column, neighbours: Column) -> Column:
    """As access_from, from the page and its content themselves."""
    return access_from(status_code, access_marks(server, html, page_text), trimmed_length(content), content_conf, neighbours)
