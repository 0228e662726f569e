"""Links between pages: chapter hops, list pages, and what two pages have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import urls
from folio.util import materialize, skew_safe_join, with_previous

# Words of links, by relation.
NEXT_CHAPTER = ("下一章", "下一节", "下一回", "下一话", "next chapter", "next")
PREV_CHAPTER = ("上一章", "上一节", "上一回", "上一话", "previous chapter", "prev chapter", "prev", "previous")
CATALOG = ("目录", "返回目录", "章节目录", "全部章节", "章节列表", "查看目录", "contents", "table of contents")
NEXT_PAGE = ("下一页", "下页", "next page", "next", "»", "›")
PREV_PAGE = ("上一页", "上页", "previous page", "prev page", "prev", "previous", "«", "‹")
PAGING = (*NEXT_PAGE, *PREV_PAGE, "下页", "上页")
MIN_CONFIDENCE = 0.60


def _longest(text: Column, words: tuple[str, ...]) -> Column:
    return F.greatest(*[F.when(text.contains(w), F.lit(len(w))).otherwise(F.lit(0)) for w in words])


def _has(text: Column, words: tuple[str, ...]) -> Column:
    return _longest(text, words) > 0


def chapter_score(url: Column, target: Column, step: int) -> Column:
    """Evidence that a link with a chapter word leads one chapter on (step 1) or back (-1); 0 for the page itself."""
    same = urls.same_directory(url, target)
    here, there = urls.page_number(url), urls.page_number(target)
    s = F.lit(0.62) + F.when(same, 0.10).otherwise(0.0) + F.when(
        there.isNotNull() & here.isNotNull(), F.when(there == here + step, 0.15).otherwise(-0.10) if step else F.lit(-0.10)
    ).when(there.isNotNull() & same, -0.10).otherwise(0.0)
    return F.when(urls.normalize_url(target) == urls.normalize_url(url), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(0.95), s)))


def page_score(url: Column, target: Column, step: int) -> Column:
    """Evidence that a link with a paging word leads to the next (1) or previous (-1) page of a list."""
    here, there = urls.page_number(url), urls.page_number(target)
    s = F.lit(0.62) + F.when(here.isNotNull() & there.isNotNull(), F.when(there == here + step, 0.25).otherwise(-0.15)).otherwise(0.0)
    bare = lambda c: F.rtrim(F.regexp_replace(c, "/+$", ""))
    return F.when(~urls.same_directory(url, target) | (bare(target) == bare(url)), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(0.95), s)))


def link_scores(anchors: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, idx, relation, target, score): every usable link that speaks for a relation.

    A link whose paging word is longer than its chapter word is paging and no
    chapter hop; a bare page number next to the page's own counts as paging.
    """
    a = anchors.select("page_id", "idx", "text", "href").join(pages.select("page_id", "url").where("url IS NOT NULL"), "page_id").where(F.col("href").isNotNull() & urls.usable_href(F.col("href")))
    low = F.lower("text")
    a = a.select("page_id", "idx", urls.trimmed(F.col("url")).alias("url"), low.alias("low"), urls.resolve(F.col("url"), F.col("href")).alias("target"))
    t, u, w = F.col("target"), F.col("url"), F.col("low")
    short, brief = F.length(w).between(1, 30), F.length(w).between(1, 20)
    paging = _longest(w, PAGING)

    def row(name: str, ok: Column, s: Column) -> Column:
        return F.when(ok, F.struct(F.lit(name).alias("relation"), s.alias("score")))

    numeric = w.rlike("^[0-9]{1,4}$")
    step = urls.page_number(t) - urls.page_number(u)
    rows = F.array_compact(F.array(
        row("NEXT_CHAPTER", short & _has(w, NEXT_CHAPTER) & (paging <= _longest(w, NEXT_CHAPTER)), chapter_score(u, t, 1)),
        row("PREVIOUS_CHAPTER", short & _has(w, PREV_CHAPTER) & (paging <= _longest(w, PREV_CHAPTER)), chapter_score(u, t, -1)),
        row("CATALOG_LINK", short & _has(w, CATALOG) & (paging <= _longest(w, CATALOG)), chapter_score(u, t, 0)),
        row("NEXT_PAGE", brief & _has(w, NEXT_PAGE), page_score(u, t, 1)),
        row("PREVIOUS_PAGE", brief & _has(w, PREV_PAGE), page_score(u, t, -1)),
        row("NEXT_PAGE", numeric & urls.same_directory(u, t) & (step == 1), F.lit(0.62)),
        row("PREVIOUS_PAGE", numeric & urls.same_directory(u, t) & (step == -1), F.lit(0.62)),
    ))
    return a.select("page_id", "idx", "target", F.explode(rows).alias("r")).select("page_id", "idx", "r.relation", "target", "r.score").where("score > 0")


def best_links(scores: DataFrame) -> DataFrame:
    """(page_id, relation, target, score): the best link of each relation, the first among equals."""
    best = scores.groupBy("page_id", "relation").agg(F.max_by(F.struct("target", "score"), F.struct("score", -F.col("idx"))).alias("b"))
    return best.select("page_id", "relation", "b.target", "b.score")


# -- fingerprints and relations --------------------------------------------------------------------


def normalize_name(c: Column) -> Column:
    """Comparable form of a name: without white space and punctuation, in lower case."""
    return F.lower(F.regexp_replace(c, r"[\s　《》〈〉「」『』【】\[\]()（）·：:，,。.;；'\"’‘“”!！?？~～\-—_=+*&^%$#@]+", ""))


def digit_free(c: Column) -> Column:
    return F.regexp_replace(c, "[0-9]+", "#")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Of two maps of counts: sum of the smaller over sum of the larger; 0 if both are empty."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    def total(pick) -> Column:  # noqa: ANN001
        return F.aggregate(keys, F.lit(0), lambda acc, k: acc + pick(F.coalesce(F.try_element_at(a, k), F.lit(0)), F.coalesce(F.try_element_at(b, k), F.lit(0))))

    return F.coalesce(total(F.least) / F.nullif(total(F.greatest), F.lit(0)), F.lit(0.0))


def fingerprints(d: DataFrame, meta: DataFrame, pages: DataFrame) -> DataFrame:
    """Eight features per page: book title, author, title template, breadcrumb, headings, tag counts, navigation texts, host."""
    tags = ("p", "div", "h1", "h2", "a", "ul", "li", "img", "table")
    f = d.select(
        "page_id", F.filter(F.transform(F.split(digit_free(F.coalesce("title", F.lit(""))), r"[|｜_＿\-—·,，;；/\\]+"), normalize_name), lambda x: x != "").alias("template"),
        F.transform("breadcrumb", normalize_name).alias("breadcrumb"), F.transform(F.slice("headings", 1, 6), lambda h: digit_free(normalize_name(h["text"]))).alias("headings"),
        F.map_filter("tags", lambda k, v: k.isin(*tags)).alias("signature"),
        F.array_distinct(F.transform(F.filter("anchors", lambda a: a["nav"] & (a["text"] != "")), lambda a: normalize_name(a["text"]))).alias("nav_texts"),
    )
    m = meta.select("page_id", normalize_name(F.col("book_title")).alias("book"), normalize_name(F.col("author")).alias("author"))
    return f.join(m, "page_id").join(pages.select("page_id", urls.authority(F.col("url")).alias("domain")), "page_id")


def compare(a: str, b: str) -> Column:
    """Struct (similarity, coverage, confidence, verdict) of two fingerprints given as struct columns; missing features drop out."""
    A, B = F.col(a), F.col(b)
    has = lambda k: (F.size(A[k]) > 0) & (F.size(B[k]) > 0)
    parts = [
        (0.30, A["book"].isNotNull() & B["book"].isNotNull(), (A["book"] == B["book"]).cast("double")), (0.15, A["author"].isNotNull() & B["author"].isNotNull(), (A["author"] == B["author"]).cast("double")),
        (0.15, has("template"), jaccard(A["template"], B["template"])), (0.15, has("breadcrumb"), jaccard(A["breadcrumb"], B["breadcrumb"])), (0.10, has("headings"), jaccard(A["headings"], B["headings"])),
        (0.10, (F.cardinality(A["signature"]) > 0) & (F.cardinality(B["signature"]) > 0), multiset_jaccard(A["signature"], B["signature"])), (0.10, has("nav_texts"), jaccard(A["nav_texts"], B["nav_texts"])),
        (0.05, A["domain"].isNotNull() & B["domain"].isNotNull(), (A["domain"] == B["domain"]).cast("double")),
    ]
    weight, value = F.lit(0.0), F.lit(0.0)
    for w, ok, v in parts:
        weight = weight + F.when(ok, w).otherwise(0.0)
        value = value + F.when(ok, w * v).otherwise(0.0)
    sim = F.coalesce(value / F.nullif(weight, F.lit(0.0)), F.lit(0.0))
    cover = weight / 1.10
    return F.struct(
        sim.alias("similarity"), cover.alias("coverage"), (sim * (0.4 + 0.6 * cover)).alias("confidence"),
        F.when(sim >= 0.75, "SAME_BOOK").when(sim >= 0.45, "RELATED").otherwise("DIFFERENT").alias("verdict"),
    )


def classes(sets: DataFrame, key: str, doc: str, items: str) -> DataFrame:
    """(key, class_id, items, n_members, doc): each document with the class of those of its key that have the same set; class_id is the smallest document.

    Null documents, keys and sets have no row; an empty set is a set.
    """
    d = sets.where(F.col(key).isNotNull() & F.col(doc).isNotNull() & F.col(items).isNotNull()).select(F.col(key).alias("key"), F.col(doc).alias("doc"), F.array_sort(F.array_distinct(items)).alias("items"))
    d = materialize(d.withColumn("h", F.md5(F.to_json(F.struct("key", "items")))))
    g = d.groupBy("h").agg(F.min("doc").alias("class_id"), F.count("*").alias("n_members"))
    # a class may hold a third of all documents
    return skew_safe_join(d, g.withColumn("n", F.col("n_members")), ["h"], "n", d.count()).select("key", "class_id", "items", "n_members", "doc")


def alike(of: DataFrame, least: float = 0.8) -> DataFrame:
    """(key, a_id, b_id, jaccard): pairs of classes of one key whose sets have at least so much in common; empty sets are like none.

    Exact: the rarest items of a set, so many that two sets alike must share one
    of them, are joined, and only what they bring together is compared.
    """
    c = materialize(of.select("key", "class_id", "items").distinct().where(F.size("items") > 0))
    t = materialize(c.select("key", "class_id", F.size("items").alias("n"), F.explode("items").alias("item")))
    f = t.groupBy("key", "item").agg(F.count("*").alias("f"))
    w = skew_safe_join(t, f.withColumn("c", F.col("f")), ["key", "item"], "c", t.count())
    rare = w.groupBy("key", "class_id", "n").agg(F.array_sort(F.collect_list(F.struct("f", "item"))).alias("s"))
    # whole-number arithmetic: 0.8 * n may come out just above a whole number
    need = F.ceil(F.round(F.col("n") * F.lit(least), 6)).cast("int")
    head = materialize(rare.select("key", "class_id", "n", F.explode(F.slice("s", F.lit(1), F.col("n") - need + 1)).alias("x")).select("key", "class_id", "n", F.col("x.item").alias("item")))
    a, b = head.select("key", "item", F.col("class_id").alias("a_id"), F.col("n").alias("a_n")), head.select("key", "item", F.col("class_id").alias("b_id"), F.col("n").alias("b_n"))
    near = (F.col("a_id") < F.col("b_id")) & (F.round(F.greatest("a_n", "b_n") * F.lit(least), 6) <= F.least("a_n", "b_n"))
    p = a.join(b, ["key", "item"]).where(near).select("key", "a_id", "b_id").distinct()
    j = p.join(c.select("key", F.col("class_id").alias("a_id"), F.col("items").alias("a")), ["key", "a_id"]).join(c.select("key", F.col("class_id").alias("b_id"), F.col("items").alias("b")), ["key", "b_id"])
    return j.select("key", "a_id", "b_id", jaccard(F.col("a"), F.col("b")).alias("jaccard")).where(F.round("jaccard", 9) >= least)


def linked_classes(of: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc, class_id, n_members, n_links): each document with its class and the number of other classes that are alike."""
    n = pairs.select(F.col("a_id").alias("class_id")).unionByName(pairs.select(F.col("b_id").alias("class_id"))).groupBy("class_id").agg(F.count("*").alias("n_links"))
    return of.join(n, "class_id", "left").select("doc", "class_id", "n_members", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def continuity(delta: Column) -> Column:
    return F.when(delta.isNull(), None).when((delta > 0) & (delta <= 1), 1.0).when(delta > 1, 0.4).when(delta == 0, 0.1).otherwise(0.0)


def relation(nav: Column, reciprocal: Column, catalog: Column, number: Column, same: Column) -> Column:
    """Struct (score, direction, confidence) from directional evidence in [0, 1] (null: none) and the similarity of the two books."""
    parts = [(0.30, nav), (0.20, reciprocal), (0.15, catalog), (0.15, number)]
    weight = sum((F.when(v.isNotNull(), w).otherwise(0.0) for w, v in parts), F.lit(0.0))
    value = sum((F.coalesce(w * v, F.lit(0.0)) for w, v in parts), F.lit(0.0))
    s = value / F.nullif(weight, F.lit(0.0))
    cover = weight / 0.80
    conf = F.when(same.isNull(), s * (0.4 + 0.6 * cover) * 0.5).otherwise(s * (0.4 + 0.6 * cover) * (0.6 + 0.4 * same))
    return F.struct(
        F.coalesce(s, F.lit(0.0)).alias("score"), F.when(s >= 0.6, "A_BEFORE_B").when(s.isNull() | (s >= 0.4), "UNKNOWN").otherwise("B_BEFORE_A").alias("direction"), F.coalesce(conf, F.lit(0.0)).alias("confidence"),
    )


def neighbours(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """Each row as struct a with its predecessor's as struct b by key and order: pairs grow with the rows, not with their square."""
    d = with_previous(df, keys, order, cols, "a")
    return d.select(*keys, F.struct(*cols).alias("b"), "a").where("a IS NOT NULL")
