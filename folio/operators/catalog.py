"""Tables of contents: clusters, order, repair and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import urls
from folio.functions.titles import parse_title
from folio.operators.content import strong_title
from folio.util import materialize, running, with_previous

MIN_CLUSTER = 5


def size_score(n: Column) -> Column:
    return F.when(n >= 30, 0.55).when(n >= 15, 0.45).when(n >= 8, 0.30).when(n >= 5, 0.20).otherwise(0.0)


def chapter_anchors(anchors: DataFrame) -> DataFrame:
    """Anchors with a usable link and 1 to 100 characters that read as a chapter title."""
    return anchors.where(F.col("href").isNotNull() & urls.usable_href(F.col("href")) & F.length("text").between(1, 100) & strong_title(F.col("text")))


def clusters(anchors: DataFrame) -> DataFrame:
    """(page_id, cluster, size, score, dominant_dir, dir_share): chapter anchors by the nearest ancestor level with a large group.

    Levels 1 to 3: anchors are grouped by the parent of that ancestor; the first
    level whose largest group has MIN_CLUSTER members counts, else all are one.
    """
    by_dir = clustered(anchors).groupBy("page_id", "cluster", "dir").agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    out = by_dir.groupBy("page_id", "cluster").agg(
        F.sum("n").alias("size"), F.max_by(F.struct("dir", "n"), F.struct("n", -F.col("first"))).alias("d"), F.min("first").alias("first_idx")
    )
    share = F.col("d.n") / F.col("size")
    return out.select(
        "page_id", "cluster", "size", (size_score(F.col("size")) + F.when((F.col("d.dir") != "") & (share >= 0.8), 0.10).otherwise(0.0)).alias("score"), F.col("d.dir").alias("dominant_dir"), share.alias("dir_share"), "first_idx",
    )


def clustered(anchors: DataFrame) -> DataFrame:
    """(page_id, idx, text, href, dir, cluster): chapter anchors, each with its cluster, see clusters."""
    c = chapter_anchors(anchors).select("page_id", "idx", "text", "href", urls.directory(F.col("href")).alias("dir"), "p2", "p3", "p4")
    levels = None
    for lv, col in ((1, "p2"), (2, "p3"), (3, "p4")):
        g = c.groupBy("page_id", F.col(col).alias("g")).agg(F.count("*").alias("n")).where(F.col("n") >= MIN_CLUSTER).select("page_id", F.lit(lv).alias("lv"))
        levels = g if levels is None else levels.unionByName(g)
    chosen = levels.groupBy("page_id").agg(F.min("lv").alias("lv"))
    key = F.when(F.col("lv") == 1, F.col("p2")).when(F.col("lv") == 2, F.col("p3")).when(F.col("lv") == 3, F.col("p4")).otherwise(F.lit(-1))
    return c.join(chosen, "page_id", "left").select("page_id", "idx", "text", "href", "dir", key.alias("cluster"))


def detect(anchors: DataFrame) -> DataFrame:
    """(page_id, idx, text, href, confidence): entries of each page's table of contents in document order; none below five."""
    cl = clusters(anchors)
    best = cl.groupBy("page_id").agg(F.max_by(F.struct("score", "dominant_dir"), F.struct("score", "size", -F.col("first_idx"))).alias("b"))
    kept = cl.join(best, "page_id").where((F.col("score") >= 0.20) & (F.col("dominant_dir") == F.col("b.dominant_dir"))).select("page_id", "cluster", "size", F.col("b.score").alias("best"))
    enough = kept.groupBy("page_id").agg(F.sum("size").alias("n")).where(F.col("n") >= MIN_CLUSTER)
    a = clustered(anchors).join(kept.join(enough, "page_id"), ["page_id", "cluster"])
    return a.select("page_id", "idx", "text", "href", F.least(F.lit(0.95), F.col("best") + 0.15).alias("confidence"))


def keep_last(entries: DataFrame) -> DataFrame:
    """One entry per book and normalized url: the last by position; ties go to the larger id."""
    e = entries.select("entry_id", "book_id", "title", "url", "dom_index", urls.normalize_url(F.col("url")).alias("norm_url")).where("norm_url IS NOT NULL AND book_id IS NOT NULL")
    return e.groupBy("book_id", "norm_url").agg(F.max_by(F.struct("entry_id", "title", "url", "dom_index"), F.struct(F.coalesce("dom_index", F.lit(-1)), "entry_id")).alias("e")).select("book_id", "norm_url", "e.*")


def numbered(entries: DataFrame) -> DataFrame:
    """Entries with the parse of their title as struct p, each title parsed once."""
    return entries.withColumn("p", parse_title(F.col("title")))


def direction(entries: DataFrame) -> DataFrame:
    """(book_id, n_numbered, inc, dec, flat, direction, confidence) from neighbours in list order."""
    n = numbered(entries).select("book_id", "dom_index", "entry_id", F.col("p.order_token").alias("t")).where("t IS NOT NULL")
    e = with_previous(n, ["book_id"], ["dom_index", "entry_id"], ["t"]).select("book_id", "t", F.col("prev.t").alias("b"))
    g = e.groupBy("book_id").agg(F.count("*").alias("n_numbered"), F.count_if(F.col("t") > F.col("b")).alias("inc"), F.count_if(F.col("t") < F.col("b")).alias("dec"), F.count_if(F.col("t") == F.col("b")).alias("flat"))
    strict = F.col("inc") + F.col("dec")
    ratio = F.greatest("inc", "dec") / F.nullif(strict, F.lit(0))
    sure = (F.col("n_numbered") >= 3) & (strict >= 2) & (ratio >= 0.85)
    return g.select(
        "book_id", "n_numbered", "inc", "dec", "flat", F.when(sure & (F.col("inc") > F.col("dec")), "ASCENDING").when(sure, "DESCENDING").otherwise("UNKNOWN").alias("direction"),
        F.when(sure, F.least(F.lit(0.95), 0.60 + 0.35 * ratio)).otherwise(F.least(F.lit(0.40), F.coalesce(ratio * 0.4, F.lit(0.0)))).alias("confidence"),
    )


def rotate(entries: DataFrame) -> DataFrame:
    """(book_id, entry_id, pos, seam, new_pos): a list that begins with its later part is turned; others keep their order.

    The seam is the first drop of at least 3 with two near-monotone runs on either
    side, the second wholly below the first.
    """
    e = numbered(entries).select("book_id", "entry_id", "dom_index", F.floor("p.order_token").cast("bigint").alias("t"))
    e = materialize(running(e, "book_id", ["dom_index", "entry_id"], {"pos": ("sum", F.lit(1))}).withColumn("pos", F.col("pos").cast("int")))
    n = with_previous(e.where("t IS NOT NULL").select("book_id", "pos", "t"), ["book_id"], ["pos"], ["t"])
    up = (F.col("t") > F.col("prev.t")).cast("int")
    n = running(
        n.withColumn("up", up).drop("prev"), "book_id", ["pos"], {"n1": ("sum", F.lit(1)), "up1": ("sum", F.coalesce("up", F.lit(0))), "min1": ("min", F.col("t"))},
        {"n2": ("sum", F.lit(1)), "up2_all": ("sum", F.coalesce("up", F.lit(0))), "max2": ("max", F.col("t")), "next_pos": ("next", F.col("pos")), "next_t": ("next", F.col("t")), "first_up": ("next", F.col("up"))},
    )
    up2 = F.col("up2_all") - F.coalesce("first_up", F.lit(0))
    ok = (
        (F.col("next_pos") == F.col("pos") + 1) & (F.col("next_t") <= F.col("t") - 3) & (F.col("n1") >= 2) & (F.col("n2") >= 2)
        & (F.col("up1") / F.greatest(F.lit(1), F.col("n1") - 1) >= 0.95) & (up2 / F.greatest(F.lit(1), F.col("n2") - 1) >= 0.95) & (F.col("max2") <= F.col("min1"))
    )
    seams = n.where(ok).groupBy("book_id").agg(F.min("pos").alias("seam"))
    total = e.groupBy("book_id").agg(F.count("*").alias("n"))
    j = e.join(total, "book_id").join(seams, "book_id", "left")
    new = F.when(F.col("seam").isNull(), F.col("pos")).when(F.col("pos") > F.col("seam"), F.col("pos") - F.col("seam")).otherwise(F.col("pos") + F.col("n") - F.col("seam"))
    return j.select("book_id", "entry_id", "pos", "seam", new.cast("int").alias("new_pos"))


def gaps(entries: DataFrame) -> DataFrame:
    """(book_id, lo, hi): runs of missing chapter numbers between a book's least and greatest, found from neighbours without listing them."""
    t = numbered(entries).select("book_id", F.floor("p.order_token").cast("bigint").alias("n")).where("n >= 1").distinct()
    return with_previous(t, ["book_id"], ["n"], ["n"]).select("book_id", (F.col("prev.n") + 1).alias("lo"), (F.col("n") - 1).alias("hi")).where("lo <= hi")


def splice(entries: DataFrame, expansions: DataFrame) -> DataFrame:
    """Insert expansion rows (book_id, after_url, before_url, seq, title, url) after or before their anchor; unplaced ones drop out."""
    e = entries.select("book_id", "title", "url", F.col("dom_index").cast("double").alias("k"), urls.normalize_url(F.col("url")).alias("nu"))
    x = expansions.select("*", urls.normalize_url(F.col("after_url")).alias("na"), urls.normalize_url(F.col("before_url")).alias("nb"))
    pos = e.groupBy("book_id", "nu").agg(F.max("k").alias("k"))
    a = x.join(pos.select("book_id", F.col("nu").alias("na"), F.col("k").alias("ka")), ["book_id", "na"], "left").join(pos.select("book_id", F.col("nu").alias("nb"), F.col("k").alias("kb")), ["book_id", "nb"], "left")
    key = F.coalesce(F.col("ka") + 0.5, F.col("kb") - 0.5)
    put = a.where(key.isNotNull()).select("book_id", "title", "url", key.alias("k"), F.col("seq"))
    u = e.select("book_id", "title", "url", "k", F.lit(0).alias("seq")).unionByName(put)
    return u.select("book_id", "title", "url", F.row_number().over(Window.partitionBy("book_id").orderBy("k", "seq", "url")).alias("pos"))


# -- collapsed lists -------------------------------------------------------------------------------

# Words of a control that unfolds a list.
EXPAND_WORDS = ("展开完整列表", "展开列表", "展开全部", "展开所有章节", "查看完整列表", "查看全部", "查看所有章节", "显示全部", "展开")


def collapsed_markers(d: DataFrame) -> DataFrame:
    """(page_id, idx, fn, arg, after_href, before_href): controls that unfold a list by script, with the chapter links next to them."""
    call = r"^\s*([A-Za-z_$][\w$]*)\s*\(\s*['\"]?([^'\")]*)['\"]?\s*\)\s*;?\s*$"
    like = F.filter("anchors", lambda a: a["href"].isNotNull() & urls.usable_href(a["href"]) & strong_title(a["text"]))
    marks = F.filter("anchors", lambda a: F.array_contains(F.array(*map(F.lit, EXPAND_WORDS)), a["text"]) & a["onclick"].rlike(call) & (F.lower(F.coalesce(a["href"], F.lit("javascript:"))).startswith("javascript:")))
    m = d.select("page_id", like.alias("like"), marks.alias("marks")).select("page_id", "like", F.explode("marks").alias("m"))
    before = F.filter("like", lambda a: a["idx"] < F.col("m.idx"))
    after = F.filter("like", lambda a: a["idx"] > F.col("m.idx"))
    return m.select(
        "page_id", F.col("m.idx").alias("idx"), F.regexp_extract("m.onclick", call, 1).alias("fn"), F.regexp_extract("m.onclick", call, 2).alias("arg"),
        F.try_element_at(before, F.lit(-1))["href"].alias("after_href"), F.try_element_at(after, F.lit(1))["href"].alias("before_href"),
    )


def fragment_entries(payload: Column) -> Column:
    """Entries (title, href) of an unfolded list: the string of a JSON or JSONP envelope with the most links, else the payload itself."""
    inner = F.regexp_extract(payload, r"(?s)^\s*[\w.$]+\s*\(\s*(\{.*\})\s*\)\s*;?\s*$", 1)
    env = F.from_json(F.when(inner != "", inner).otherwise(payload), "map<string,string>", {"mode": "PERMISSIVE"})
    count = lambda s: F.size(F.regexp_extract_all(s, F.lit("(?i)(<a\\b)"), F.lit(1)))
    values = F.filter(F.map_values(F.coalesce(env, F.create_map().cast("map<string,string>"))), lambda v: v.isNotNull())
    best = F.array_max(F.transform(values, lambda v: F.struct(count(v).alias("n"), v.alias("v"))))["v"]
    html = F.coalesce(F.when(count(best) > 0, best), payload)
    found = F.regexp_extract_all(html, F.lit(r"(?is)(<a\b[^>]*>.*?</a>)"), F.lit(1))
    return F.transform(found, lambda a: F.struct(
        F.trim(F.regexp_replace(a, "<[^>]*>", "")).alias("title"), F.regexp_extract(a, r"(?i)href\s*=\s*[\"']?([^\"'\s>]+)", 1).alias("href"),
    ))
