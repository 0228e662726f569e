"""Following links between captured pages: lists over several pages, chapters over several pages, gaps, and books without a list.

Evidence is computed for all captured pages at once; a walk then only follows
accepted steps, so no page decides what is fetched next.
"""

from __future__ import annotations

import base64
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folio.functions import urls
from folio.functions.titles import has_page_marker, parse_title, strip_page_suffix
from folio.operators import graph, navigation
from folio.operators.content import contains_any
from folio.util import materialize, running

MAX_CATALOG_PAGES, MAX_CONTENT_PAGES, MAX_GAP_STEPS, EXPLORE_BUDGET, CATALOG_TRIES = 20, 10, 50, 8, 3
# Words of links to a table of contents, from a book's page and when exploring.
BOOK_WORDS = ("目录", "章节目录", "查看目录", "全部章节", "章节列表", "开始阅读", "点击阅读", "正文")
EXPLORE_WORDS = ("目录", "章节目录", "全部章节", "章节列表", "查看目录", "开始阅读", "点击阅读", "正文", "返回书页", "作品主页")


def by_url(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links (page_id, relation, target, score) with the page id of their target, if it was captured; by url without fragment."""
    t = pages.where("url IS NOT NULL").groupBy(urls.normalize_url(F.col("url")).alias("norm")).agg(F.max("page_id").alias("to_id"))
    return links.withColumn("norm", urls.normalize_url(F.col("target"))).join(t, "norm", "left").drop("norm")


def list_steps(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(src, dst): each list page to its next page, on evidence of at least 0.6."""
    x = by_url(links.where((F.col("relation") == "NEXT_PAGE") & (F.col("score") >= navigation.MIN_CONFIDENCE)), pages)
    return x.where("to_id IS NOT NULL AND to_id <> page_id").select(F.col("page_id").alias("src"), F.col("to_id").alias("dst"))


def list_walks(starts: DataFrame, links: DataFrame, pages: DataFrame, most: int = MAX_CATALOG_PAGES) -> DataFrame:
    """(start, pos, page, stopped_by): pages of each list in order; stopped_by, on the last one: no_next, loop, not_captured or max_pages."""
    x = by_url(links.where((F.col("relation") == "NEXT_PAGE") & (F.col("score") >= navigation.MIN_CONFIDENCE)), pages)
    nxt = materialize(x.select(F.col("page_id").alias("src"), F.col("to_id").alias("dst")))
    w = materialize(graph.walk_pages(starts.select(F.col("page_id").alias("page")).distinct(), nxt.where("dst IS NOT NULL AND src <> dst"), most))
    end = w.groupBy("start").agg(F.max("pos").alias("last"))
    why = F.when(F.col("pos") >= most, "max_pages").when(F.col("src").isNull(), "no_next").when(F.col("dst").isNull(), "not_captured").otherwise("loop")
    j = w.join(end, "start").join(nxt, w["page"] == nxt["src"], "left")
    return j.select("start", "pos", "page", F.when(F.col("pos") == F.col("last"), why).alias("stopped_by"))


def resolved_lists(anchors: DataFrame, pages: DataFrame, links: DataFrame) -> DataFrame:
    """(book_id, entry_id, title, url, source_page_url, dom_index, confidence): tables of contents of captured list pages and of the pages they go on over.

    book_id is the first page of a list: one with entries that no other page with
    entries goes on to. dom_index runs over all pages of a list in their order.
    Confidence below 0.5 is low: such entries are given all the same.
    """
    from folio.operators import catalog

    found = materialize(catalog.detect(anchors))
    have = found.select("page_id").distinct()
    steps = list_steps(links, pages).join(have.select(F.col("page_id").alias("src")), "src", "left_semi")
    starts = have.join(steps.select(F.col("dst").alias("page_id")), "page_id", "left_anti")
    w = list_walks(starts, links, pages).select(F.col("start").alias("book_id"), F.col("pos").alias("page_no"), F.col("page").alias("page_id"))
    e = found.join(w, "page_id").join(pages.select("page_id", F.col("url").alias("source_page_url")), "page_id")
    e = e.select("book_id", "page_no", "idx", F.col("text").alias("title"), urls.resolve(F.col("source_page_url"), F.col("href")).alias("url"), "source_page_url", "confidence")
    r = running(e, "book_id", ["page_no", "idx"], {"dom_index": ("sum", F.lit(1))}).withColumn("dom_index", F.col("dom_index").cast("int"))
    return r.select("book_id", F.col("dom_index").cast("bigint").alias("entry_id"), "title", "url", "source_page_url", "dom_index", "confidence")


def chapter_steps(links: DataFrame, pages: DataFrame, titles: DataFrame) -> DataFrame:
    """(src, dst, why): each chapter page to its continuation.

    A next-page link is a step if the two titles do not name different chapters;
    a next-chapter link only if the target's title bears a page mark and the
    same whole number. Pages without a number must share their title but for page marks.
    """
    t = titles.select("page_id", "page_title", F.floor(parse_title(F.col("page_title"))["order_token"]).alias("no"), strip_page_suffix(F.coalesce("page_title", F.lit(""))).alias("bare"), F.coalesce(has_page_marker(F.col("page_title")), F.lit(False)).alias("mark"))
    x = by_url(links.where(F.col("relation").isin("NEXT_PAGE", "NEXT_CHAPTER") & (F.col("score") >= navigation.MIN_CONFIDENCE)), pages).where("to_id IS NOT NULL AND to_id <> page_id")
    a = t.select(F.col("page_id"), F.col("no").alias("a_no"), F.col("bare").alias("a_bare"))
    b = t.select(F.col("page_id").alias("to_id"), F.col("no").alias("b_no"), F.col("bare").alias("b_bare"), "mark")
    j = x.join(a, "page_id").join(b, "to_id")
    same = F.when(F.col("a_no").isNull(), (F.col("a_bare") == F.col("b_bare")) & (F.col("a_bare") != "")).otherwise(F.col("b_no").isNull() | (F.col("b_no") == F.col("a_no")))
    strong = F.col("mark") & F.col("a_no").isNotNull() & (F.col("a_no") == F.col("b_no"))
    ok = j.where(F.when(F.col("relation") == "NEXT_PAGE", same).otherwise(strong))
    return ok.groupBy(F.col("page_id").alias("src")).agg(F.max_by(F.struct("to_id", "relation"), F.struct((F.col("relation") == "NEXT_PAGE").cast("int"), "score")).alias("b")).select("src", F.col("b.to_id").alias("dst"), F.col("b.relation").alias("why"))


def merge_pages(starts: DataFrame, steps: DataFrame, texts: DataFrame, most: int = MAX_CONTENT_PAGES) -> DataFrame:
    """(start, n_pages, pages, text, repeats): texts of a chapter's pages in order; repeats: its pages say the same."""
    w = graph.walk_pages(starts.select(F.col("page_id").alias("page")).distinct(), steps.select("src", "dst"), most)
    t = texts.groupBy("page_id").agg(F.max("text").alias("text"))
    j = w.join(t, w["page"] == t["page_id"], "left")
    g = j.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("pos", "page", "text"))).alias("s"))
    long = F.filter(F.transform("s", lambda x: F.regexp_replace(F.coalesce(x["text"], F.lit("")), r"[\s\p{Z}]+", "")), lambda x: F.length(x) >= 300)
    return g.select(
        "start", F.size("s").alias("n_pages"), F.transform("s", lambda x: x["page"]).alias("pages"),
        F.array_join(F.transform(F.filter("s", lambda x: x["text"].isNotNull()), lambda x: x["text"]), "\n").alias("text"), (F.size(F.array_distinct(long)) < F.size(long)).alias("repeats"),
    )


def find_catalog(anchors: DataFrame, pages: DataFrame, types: DataFrame, entries: DataFrame, words: tuple[str, ...] = BOOK_WORDS, tries: int = CATALOG_TRIES) -> DataFrame:
    """(page_id, catalog_id, rank): the first of a page's first few links with a word of lists that leads to a captured list.

    A list: its type says so on at least 0.5, or it has entries of a table of contents.
    """
    c = anchors.where(F.col("href").isNotNull() & urls.usable_href(F.col("href")) & F.length("text").between(1, 12) & contains_any(F.col("text"), words)).join(pages.select("page_id", "url"), "page_id")
    c = c.select("page_id", "idx", urls.resolve(F.col("url"), F.col("href")).alias("target")).groupBy("page_id", "target").agg(F.min("idx").alias("idx"))
    c = c.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy("idx"))).where(F.col("rank") <= tries)
    x = by_url(c, pages).where("to_id IS NOT NULL AND to_id <> page_id")
    # written first: a filter pushed into the scores would compute them over and over
    lists = materialize(types.select("page_id", "page_type", "confidence")).where("page_type = 'CATALOG_PAGE' AND confidence >= 0.5").select(F.col("page_id").alias("to_id")).union(entries.select(F.col("page_id").alias("to_id"))).distinct()
    return x.join(lists, "to_id").groupBy("page_id").agg(F.min_by(F.struct(F.col("to_id").alias("catalog_id"), "rank"), "rank").alias("b")).select("page_id", "b.catalog_id", "b.rank")


def explore(anchors: DataFrame, pages: DataFrame, types: DataFrame, entries: DataFrame, budget: int = EXPLORE_BUDGET) -> DataFrame:
    """As find_catalog with more words and more tries."""
    return find_catalog(anchors, pages, types, entries, EXPLORE_WORDS, budget)


def chapter_edges(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(src, dst, confidence): chapter pages to the next, by next links and, reversed, previous links; both of a pair that agree weigh more."""
    x = by_url(links.where(F.col("relation").isin("NEXT_CHAPTER", "PREVIOUS_CHAPTER") & (F.col("score") >= navigation.MIN_CONFIDENCE)), pages).where("to_id IS NOT NULL AND to_id <> page_id")
    nxt = F.col("relation") == "NEXT_CHAPTER"
    e = x.select(F.when(nxt, F.col("page_id")).otherwise(F.col("to_id")).alias("src"), F.when(nxt, F.col("to_id")).otherwise(F.col("page_id")).alias("dst"), "score")
    return e.groupBy("src", "dst").agg((F.max("score") + 0.1 * (F.count("*") - 1)).alias("confidence"))


def traverse(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(key, head, rank, broken): chapters of books without a list, in the order of chapter_edges."""
    e = chapter_edges(links, pages)
    n = e.select(F.col("src").alias("key")).union(e.select(F.col("dst").alias("key"))).distinct()
    return graph.reading_order(n, e)


def reciprocal(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(a, b): pages of which the first calls the second next and the second the first previous."""
    x = by_url(links, pages).where("to_id IS NOT NULL")
    n = x.where("relation = 'NEXT_CHAPTER'").select(F.col("page_id").alias("a"), F.col("to_id").alias("b"))
    p = x.where("relation = 'PREVIOUS_CHAPTER'").select(F.col("to_id").alias("a"), F.col("page_id").alias("b"))
    return n.join(p, ["a", "b"]).distinct()


def fill_gaps(ordered: DataFrame, links: DataFrame, pages: DataFrame, titles: DataFrame, most: int = MAX_GAP_STEPS) -> DataFrame:
    """(book_id, after_pos, step, page_id, title): captured pages that lead over a gap of numbers from one entry to the next.

    Input entries: book_id, pos, norm_url, number. Next-chapter links come first, next-page
    links are tried where there is none. A walk counts if every page on it has a number that
    does not fall and stays below the far end, and the far end is reached; pages that repeat
    the number before them are later pages of that chapter and no entries.
    """
    w = Window.partitionBy("book_id").orderBy("pos")
    gap = ordered.where("number IS NOT NULL").select("book_id", "pos", "norm_url", F.floor("number").alias("lo"), F.lead("norm_url").over(w).alias("far_url"), F.floor(F.lead("number").over(w)).alias("hi")).where("hi - lo >= 2")
    ids = pages.where("url IS NOT NULL").groupBy(urls.normalize_url(F.col("url")).alias("norm_url")).agg(F.max("page_id").alias("page"))
    g = gap.join(ids, "norm_url").join(ids.select(F.col("norm_url").alias("far_url"), F.col("page").alias("far")), "far_url")
    hop = by_url(links.where(F.col("relation").isin("NEXT_CHAPTER", "NEXT_PAGE") & (F.col("score") >= navigation.MIN_CONFIDENCE)), pages).where("to_id IS NOT NULL AND to_id <> page_id")
    nxt = hop.groupBy(F.col("page_id").alias("src")).agg(F.max_by("to_id", F.struct((F.col("relation") == "NEXT_CHAPTER").cast("int"), "score")).alias("dst"))
    walk = graph.walk_pages(g.select("page").distinct(), nxt, most)
    no = titles.select(F.col("page_id").alias("p"), "page_title", F.floor(parse_title(F.col("page_title"))["order_token"]).alias("no"))
    j = g.join(walk.withColumnRenamed("pos", "k").withColumnRenamed("page", "p"), F.col("page") == F.col("start")).where("k > 1").join(no, "p", "left")
    end = j.where("p = far").groupBy("book_id", "pos").agg(F.min("k").alias("end"))
    inside = j.join(end, ["book_id", "pos"]).where("k < end")
    inside = inside.withColumn("before", F.coalesce(F.lag("no").over(Window.partitionBy("book_id", "pos").orderBy("k")), F.col("lo")))
    wrong = F.col("no").isNull() | (F.col("no") < F.col("before")) | (F.col("no") >= F.col("hi"))
    chain = inside.groupBy("book_id", "pos").agg(F.count_if(wrong).alias("bad")).where("bad = 0")
    new = inside.where("no > before").join(chain.select("book_id", "pos"), ["book_id", "pos"])
    return new.select("book_id", F.col("pos").alias("after_pos"), F.row_number().over(Window.partitionBy("book_id", "pos").orderBy("k")).alias("step"), F.col("p").alias("page_id"), F.col("page_title").alias("title"))


# -- lists behind scripts --------------------------------------------------------------------------

_FUNC = r"function\s+{}\s*\(\s*(\w*)[^)]*\)\s*\{{(.*?)\}}"
_TERM = r"(?:[\"'][^\"']*[\"']|[\w.$]+(?:\((?:[\"'][^\"']*[\"']|\s*[\w$]+\s*)\))?)"
_CONCAT = re.compile(rf"({_TERM}(?:\s*\+\s*{_TERM})+)")


def resolve_literal(html: str | None, fn: str | None, arg: str | None) -> str | None:
    """The address a simple loader function builds from its argument by joining literals, globals, and either in base64; null if it is not that simple."""
    if not html or not fn:
        return None
    m = re.search(_FUNC.format(re.escape(fn)), html, re.S)
    if not m:
        return None
    param, body = m.group(1), m.group(2)

    def named(name: str) -> str | None:
        if param and name == param:
            return arg or ""
        g = re.search(rf"(?:var|let|const)?\s*\b{re.escape(name)}\s*=\s*[\"']([^\"']*)[\"']", html)
        return g.group(1) if g else None

    for e in _CONCAT.finditer(body):
        out, used = [], False
        for t in re.split(r"\s*\+\s*", e.group(1)):
            if t[0] in "\"'":
                out.append(t[1:-1])
            elif (b := re.fullmatch(r"(?:window\.)?atob\([\"']([^\"']*)[\"']\)", t)):
                out.append(base64.b64decode(b.group(1)).decode("utf-8", "replace"))
            elif (b := re.fullmatch(r"base64\(\s*([\w$]+)\s*\)", t)) and (v := named(b.group(1))) is not None:
                out.append(base64.b64encode(v.encode()).decode())
                used = used or b.group(1) == param
            elif re.fullmatch(r"[\w.$]+", t) and (v := named(t)) is not None:
                out.append(v)
                used = used or t == param
            else:
                break
        else:
            if used:
                return "".join(out)
    return None


@F.pandas_udf(StringType())
def literal_url(html: pd.Series, fn: pd.Series, arg: pd.Series) -> pd.Series:
    return pd.Series([resolve_literal(h, f, a) for h, f, a in zip(html, fn, arg, strict=True)], dtype="object")


def expand(markers: DataFrame, pages: DataFrame, payloads: DataFrame) -> DataFrame:
    """(page_id, after_href, before_href, seq, title, url): entries behind a control, read from captured payloads (url, text); none for addresses not captured."""
    from folio.operators.catalog import fragment_entries

    m = markers.join(pages.select("page_id", "url", "html"), "page_id").withColumn("data_url", urls.resolve(F.col("url"), literal_url("html", "fn", "arg")))
    j = m.join(payloads.select(F.col("url").alias("data_url"), F.col("text").alias("payload")), "data_url")
    e = j.select("page_id", "url", "after_href", "before_href", fragment_entries(F.col("payload")).alias("e"))
    e = e.select("page_id", "url", "after_href", "before_href", F.posexplode("e").alias("seq", "x"))
    return e.select("page_id", "after_href", "before_href", "seq", F.col("x.title").alias("title"), urls.resolve(F.col("url"), F.col("x.href")).alias("url"))


def override(detected: Column, chosen: Column) -> Column:
    """A direction (or any detected value) with a person's choice in its place, where there is one."""
    return F.coalesce(chosen, detected)
