"""All queries of the core over the test tables, and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import charset, textclean, titles, urls
from folio.operators import catalog, chapters, content, dom, evaluate, graph, metadata, navigation, profiles, walks
from folio.plans import pipeline
from folio.sources import captures, export
from folio.util import materialize, running, table, with_previous

Query = Callable[[SparkSession, str], DataFrame]
ANCHOR = r"(?is)<a\b[^>]*>(.*?)</a>"
HREF = r"(?is)<a\b[^>]*?href=\"([^\"]*)\"[^>]*>"


def _pages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "fetched_pages")


def _texts(html: Column) -> Column:
    """Texts of a page's anchors, by pattern: the form SQL can repeat."""
    return F.transform(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, "(?s)<[^>]*>", "")))


def host_link_density(s: SparkSession, d: str) -> DataFrame:
    p = _pages(s, d).select("host", _texts(F.col("html")).alias("a"))
    per = p.select("host", F.size("a").alias("n"), F.aggregate("a", F.lit(0), lambda acc, x: acc + F.length(x)).alias("chars"))
    return per.groupBy("host").agg(F.count("*").alias("n_pages"), F.sum("n").cast("bigint").alias("n_anchors"), F.sum("chars").cast("bigint").alias("anchor_chars"))


def url_normalize(s: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(s, d, "catalog_entries").select("entry_id", urls.normalize_url(u).alias("norm_url"), urls.authority(u).alias("authority"), urls.directory(u).alias("dir"))


def url_page_number(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "catalog_entries").select("entry_id", urls.page_number(F.col("url")).alias("page_no"))


def url_pair_similarity(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "catalog_entries").where("book_id IS NOT NULL")
    n = navigation.neighbours(e, ["book_id"], ["dom_index", "entry_id"], ["entry_id", "url"])
    return n.select(F.col("a.entry_id").alias("a_id"), F.col("b.entry_id").alias("b_id"), urls.url_similarity(F.col("a.url"), F.col("b.url")).alias("sim"))


def anchor_inventory(s: SparkSession, d: str) -> DataFrame:
    p = _pages(s, d).select("page_id", F.arrays_zip(_texts(F.col("html")).alias("t"), F.regexp_extract_all("html", F.lit(HREF), F.lit(1)).alias("h")).alias("z"))
    return p.select("page_id", F.posexplode("z").alias("dom_index", "x")).select("page_id", "dom_index", F.col("x.t").alias("text"), F.col("x.h").alias("href"))


def page_title_pick(s: SparkSession, d: str) -> DataFrame:
    h1 = F.nullif(F.trim(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)), F.lit(""))
    t = F.nullif(F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    return _pages(s, d).select("page_id", F.coalesce(h1, t).alias("title"))


def title_parse(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "catalog_entries").select("entry_id", titles.parse_title(F.col("title")).alias("p"))
    return e.select("entry_id", "p.chapter_number", "p.chapter_type", "p.order_token", "p.confidence", "p.sub_number")


def strip_suffixes(s: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    return table(s, d, "chapter_title_matches").select("match_id", titles.strip_page_suffix(t).alias("no_page"), titles.strip_sub_number(t).alias("no_part"), titles.has_page_marker(t).alias("has_marker"))


def _content_len(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "content_extractions").groupBy("page_id").agg(F.max(F.length(F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\r\n　")))).alias("n"))


def content_status(s: SparkSession, d: str) -> DataFrame:
    """Against the median length of the pages of the same host."""
    p = _pages(s, d).join(_content_len(s, d), "page_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    per = p.where("host IS NOT NULL").groupBy(F.col("host").alias("h")).agg(F.floor(F.percentile("n", F.lit(0.5))).cast("int").alias("median"))
    p = p.join(per, F.col("host") == F.col("h"), "left")
    server = F.try_element_at(F.coalesce("headers", F.create_map().cast("map<string,string>")), F.lit("server"))
    st = content.access_status(F.coalesce("status_code", F.lit(200)), server, F.col("html"), F.col("html"), F.repeat(F.lit("x"), F.col("n")), F.lit(0.8), F.col("median"))
    return p.select("page_id", st.alias("st")).select("page_id", "st.status", "st.confidence")


def phrase_hits(s: SparkSession, d: str) -> DataFrame:
    """Captured pages, and one made up of each phrase, as the captured ones hold none."""
    low = F.lower("html")
    hits = F.array_compact(F.array(*[F.when(content.contains_any(low, words), F.lit(k)) for k, _, words in content.PHRASES]))
    made = s.createDataFrame([(-i, f"<p>- {w} -</p>") for i, w in enumerate((w for _, _, words in content.PHRASES for w in words), 1)], "page_id bigint, html string")
    return _pages(s, d).select("page_id", "html").unionByName(made).select("page_id", F.explode(hits).alias("category"))


def metadata_best(s: SparkSession, d: str) -> DataFrame:
    h1 = F.nullif(F.trim(F.regexp_extract("html", r"(?is)<h1[^>]*>([^<]*)</h1>", 1)), F.lit(""))
    t = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>([^<]*)</title>", 1))
    a, b = metadata.clean_title_value(h1), metadata.title_from_template(t)
    return _pages(s, d).select("page_id", F.coalesce(a, b).alias("title"), F.when(a.isNotNull(), "h1").when(b.isNotNull(), "title").alias("source"), F.when(a.isNotNull(), 0.65).when(b.isNotNull(), 0.45).alias("confidence"))


def _by_host(s: SparkSession, d: str, made: Column) -> DataFrame:
    p = _pages(s, d).where("host IS NOT NULL").select("host", "page_id", made.alias("m"))
    return navigation.neighbours(p, ["host"], ["page_id"], ["page_id", "m"])


def fingerprint_jaccard(s: SparkSession, d: str) -> DataFrame:
    made = F.array_distinct(F.filter(F.transform(_texts(F.col("html")), navigation.normalize_name), lambda x: x != ""))
    n = _by_host(s, d, made)
    return n.select(F.col("a.page_id").alias("a_id"), F.col("b.page_id").alias("b_id"), navigation.jaccard(F.col("a.m"), F.col("b.m")).alias("jaccard"))


TAGS = ("a", "aside", "br", "div", "footer", "h1", "li", "nav", "p", "td", "ul")


def tag_signature_similarity(s: SparkSession, d: str) -> DataFrame:
    made = F.map_from_arrays(F.array(*map(F.lit, TAGS)), F.array(*[F.size(F.regexp_extract_all("html", F.lit(rf"(?i)(<{t}\b)"), F.lit(1))) for t in TAGS]))
    n = _by_host(s, d, made)
    return n.select(F.col("a.page_id").alias("a_id"), F.col("b.page_id").alias("b_id"), navigation.multiset_jaccard(F.col("a.m"), F.col("b.m")).alias("sim"))


def fingerprint_compare(s: SparkSession, d: str) -> DataFrame:
    p = _pages(s, d)
    dm = materialize(dom.dom(p))
    f = navigation.fingerprints(dm, metadata.metadata(dm), p)
    cols = [c for c in f.columns]
    n = navigation.neighbours(f.where("domain IS NOT NULL"), ["domain"], ["page_id"], cols)
    return n.select(F.col("a.page_id").alias("a_id"), F.col("b.page_id").alias("b_id"), navigation.compare("a", "b").alias("c")).select("a_id", "b_id", "c.*")


def _linked(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Entries as pages (page_id, book_id, url, ...), and their anchors: to the neighbours in the list, to the list, and paging links of some.

    The captured pages hold hardly any links between them; the lists say where those of a site would lead.
    """
    e = table(s, d, "catalog_entries").where("book_id IS NOT NULL AND url IS NOT NULL").select(F.col("entry_id").alias("page_id"), "book_id", "url", "source_page_url", "dom_index", "title")
    n = running(with_previous(e, ["book_id"], ["dom_index", "page_id"], ["url"]), "book_id", ["dom_index", "page_id"], {}, {"next_url": ("next", F.col("url"))})
    at = lambda i, text, href: F.struct(F.lit(i).alias("idx"), F.lit(text).alias("text"), href.alias("href"))
    some = lambda k, x: F.when(F.col("page_id") % k == 0, x)
    links = F.array_compact(F.array(
        at(0, "下一章", F.col("next_url")), F.when(F.col("page_id") % 5 != 0, at(1, "上一章", F.col("prev.url"))), at(2, "目录", F.col("source_page_url")), some(4, at(3, "下一页", F.col("next_url"))), some(6, at(4, "2", F.col("next_url"))),
    ))
    return e, n.select("page_id", F.explode(links).alias("a")).select("page_id", "a.*")


def _links(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p, a = _linked(s, d)
    return p, materialize(navigation.best_links(navigation.link_scores(a, p)))


def fingerprint_classes(s: SparkSession, d: str) -> DataFrame:
    """Each page with the class of its host's pages that have the same link texts in the same furniture, and how many other classes are alike."""
    dm = dom.dom(_pages(s, d)).select("page_id", "anchors")
    made = F.array_distinct(F.filter(F.transform(F.filter("anchors", lambda a: a["nav"]), lambda a: navigation.digit_free(navigation.normalize_name(a["text"]))), lambda x: x != ""))
    c = materialize(navigation.classes(dm.select("page_id", made.alias("m")).join(_pages(s, d).select("page_id", "host"), "page_id"), "host", "page_id", "m"))
    return navigation.linked_classes(c, navigation.alike(c))


def _list_sets(s: SparkSession, d: str) -> DataFrame:
    """The distinct first words of the titles of each list, by host: sets that SQL can make too."""
    e = table(s, d, "catalog_entries").where("source_page_url IS NOT NULL AND host IS NOT NULL")
    return e.groupBy("host", "source_page_url").agg(F.collect_set(F.left("title", F.lit(2))).alias("m"))


def list_classes(s: SparkSession, d: str) -> DataFrame:
    return navigation.classes(_list_sets(s, d), "host", "source_page_url", "m").select("doc", "class_id", "n_members")


def lists_alike(s: SparkSession, d: str) -> DataFrame:
    return navigation.alike(materialize(navigation.classes(_list_sets(s, d), "host", "source_page_url", "m")), 0.3)


def relation_score(s: SparkSession, d: str) -> DataFrame:
    """Neighbours of a list by their links, by links that answer each other, by the list and by their numbers."""
    e = catalog.numbered(table(s, d, "catalog_entries").where("book_id IS NOT NULL")).select("book_id", "entry_id", "dom_index", "url", F.col("p.order_token").alias("t"))
    n = navigation.neighbours(e, ["book_id"], ["dom_index", "entry_id"], ["entry_id", "url", "t", "dom_index"])
    p, links = _links(s, d)
    nav = walks.by_url(links.where("relation = 'NEXT_CHAPTER'"), p).where("to_id IS NOT NULL").groupBy(F.col("page_id").alias("x"), F.col("to_id").alias("y")).agg(F.max("score").alias("nav"))
    back = walks.reciprocal(links, p).select(F.col("a").alias("x"), F.col("b").alias("y"), F.lit(1.0).alias("back"))
    n = n.withColumn("x", F.col("a.entry_id")).withColumn("y", F.col("b.entry_id")).join(nav, ["x", "y"], "left").join(back, ["x", "y"], "left")
    cat = F.when(F.col("b.dom_index") > F.col("a.dom_index"), 1.0).when(F.col("b.dom_index") < F.col("a.dom_index"), 0.0)
    r = navigation.relation(F.col("nav"), F.col("back"), cat, navigation.continuity(F.col("b.t") - F.col("a.t")), urls.url_similarity(F.col("a.url"), F.col("b.url")))
    return n.select(F.col("x").alias("a_id"), F.col("y").alias("b_id"), r.alias("r")).select("a_id", "b_id", "r.*")


def catalog_dominant_dir(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "catalog_entries").where("source_page_url IS NOT NULL").select("source_page_url", "dom_index", "entry_id", urls.directory(F.col("url")).alias("dir"))
    g = e.groupBy("source_page_url", "dir").agg(F.count("*").alias("n"), F.min(F.struct("dom_index", "entry_id")).alias("first"))
    t = g.groupBy("source_page_url").agg(F.sum("n").alias("size"), F.min_by(F.struct("dir", "n"), F.struct(-F.col("n"), "first")).alias("b"))
    share = F.col("b.n") / F.col("size")
    return t.select("source_page_url", "size", F.col("b.dir").alias("dominant_dir"), (catalog.size_score(F.col("size")) + F.when((F.col("b.dir") != "") & (share >= 0.8), 0.10).otherwise(0.0)).alias("score"))


def catalog_keep_last(s: SparkSession, d: str) -> DataFrame:
    return catalog.keep_last(table(s, d, "catalog_entries")).select("book_id", "norm_url", "entry_id", "dom_index")


def _kept(s: SparkSession, d: str) -> DataFrame:
    return materialize(catalog.keep_last(table(s, d, "catalog_entries")))


def _blocks(s: SparkSession, d: str) -> DataFrame:
    """Each page's text with a blank line after every line, so that its lines are its blocks."""
    c = table(s, d, "content_extractions").groupBy("page_id").agg(F.max("text").alias("text"))
    return c.join(_pages(s, d).select("page_id", "host"), "page_id").select("host", "page_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


def boilerplate_blocks(s: SparkSession, d: str) -> DataFrame:
    return chapters.recurrent_blocks(_blocks(s, d), "host", "page_id", "text").select(F.col("book").alias("host"), F.col("h").alias("block_md5"), "n_docs")


def boilerplate_removed(s: SparkSession, d: str) -> DataFrame:
    r = chapters.remove_recurrent(_blocks(s, d), "host", "page_id", "text")
    return r.select(F.col("doc").alias("page_id"), F.length("text").cast("bigint").alias("n_left"), F.md5("text").alias("text_md5"), "emptied")


def clean_lines(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "content_extractions").where("text IS NOT NULL").distinct()
    return c.select("page_id", textclean.clean_text(F.col("text"), F.lit(None).cast("string")).alias("cleaned"))


def line_kinds(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "content_extractions").where("text IS NOT NULL").select("page_id", "text").distinct()
    x = c.select("page_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).select("page_id", "line_no", F.regexp_replace("raw", r"^[\s\x{3000}\x{A0}]+|[\s\x{3000}\x{A0}]+$", "").alias("line")).where("line <> ''")
    k = F.col("line")
    return x.groupBy("page_id").agg(F.count("*").alias("n_lines"), F.count_if(textclean.is_nav_line(k)).alias("n_nav"), F.count_if(textclean.is_site_prompt(k)).alias("n_prompt"), F.count_if(textclean.is_page_number_line(k)).alias("n_number"))


def duplicate_content_pages(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "content_extractions").join(_pages(s, d).select("page_id", "host"), "page_id")
    return chapters.duplicate_texts(c, "host", "page_id", "text").select(F.col("key").alias("host"), "hash", "n_pages", "first_page")


def part_merge(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "chapter_title_matches").where("book_id IS NOT NULL")
    c = chapters.in_order(m, "book_id", ["order_token", "match_id"]).select("book_id", "pos", "title", F.col("chapter_number").alias("number"), "sub_number")
    return chapters.merge_parts(c)


def running_median_ok(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").where("book_id IS NOT NULL").select("book_id", "doc_id", "n_chars")
    return chapters.running_median(docs, "book_id", ["doc_id"], "n_chars", F.col("n_chars") >= 200).select("book_id", "pos", "n_chars", "median_prev")


def consecutive_failure_cut(s: SparkSession, d: str) -> DataFrame:
    return chapters.failure_cut(table(s, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", 3)


def adaptive_pacing(s: SparkSession, d: str) -> DataFrame:
    return chapters.pacing(table(s, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")


def status_counts(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).groupBy("status_code").agg(F.count("*").alias("n"))


def profile_by_host(s: SparkSession, d: str) -> DataFrame:
    t = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>([^<]*)</title>", 1))
    p = _pages(s, d).select("host", "url", t.alias("title"), F.filter(_texts(F.col("html")), lambda x: x != "").alias("nav"))
    b = profiles.build(p)
    return b.select("host", "n_pages", "chapter_dir", "chapter_dirname_numeric", F.coalesce(F.size("title_template"), F.lit(0)).alias("n_segments"), F.coalesce(F.size("nav_texts"), F.lit(0)).alias("n_nav"), F.array_join("nav_texts", "|").alias("nav_texts"))


def profile_check(s: SparkSession, d: str) -> DataFrame:
    prof = table(s, d, "site_profiles").groupBy("host").agg(F.max_by(F.struct("title_template", "chapter_dir"), "version").alias("p"))
    t = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>([^<]*)</title>", 1))
    j = _pages(s, d).select("page_id", "host", "url", t.alias("title")).join(prof, "host")
    return j.select("page_id", profiles.check(F.col("title"), F.col("url"), F.col("p.title_template"), F.col("p.chapter_dir")).alias("passed"))


def profile_counters(s: SparkSession, d: str) -> DataFrame:
    """Profiles with a hit or a miss more for each page of their host that is checked against them."""
    ok = profile_check(s, d).where("passed IS NOT NULL").join(_pages(s, d).select("page_id", "host"), "page_id").select("host", F.when(F.col("passed") >= 0.5, "hits").otherwise("misses").alias("kind"))
    return profiles.record(table(s, d, "site_profiles"), ok).select("host", "hits", "misses", "invalidations")


def _edges(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = chapters.in_order(_kept(s, d), "book_id", ["dom_index", "entry_id"])
    k = materialize(e.withColumn("key", F.col("entry_id")))
    return k, graph.consecutive_edges(k, "book_id", "key", F.lit(True))


def graph_next_edges(s: SparkSession, d: str) -> DataFrame:
    return graph.strongest(_edges(s, d)[1])


def graph_ends(s: SparkSession, d: str) -> DataFrame:
    k, e = _edges(s, d)
    return graph.ends(k, e)


def graph_reading_order(s: SparkSession, d: str) -> DataFrame:
    k, e = _edges(s, d)
    return graph.reading_order(k, e)


def catalog_precision_recall(s: SparkSession, d: str) -> DataFrame:
    return evaluate.precision_recall(table(s, d, "chapter_title_matches").where("book_id IS NOT NULL"), table(s, d, "catalog_entries").where("book_id IS NOT NULL"), ["book_id", "title"])


def metric_rollup(s: SparkSession, d: str) -> DataFrame:
    p = _pages(s, d).select("page_id", "host", "encoding", "input_kind", "status_code").join(_content_len(s, d), "page_id", "left")
    m = p.select("host", "encoding", "input_kind", F.explode(F.array(
        F.struct(F.lit("has_content").alias("metric"), (F.coalesce("n", F.lit(0)) > 0).cast("bigint").alias("numerator"), F.lit(1).cast("bigint").alias("denominator")),
        F.struct(F.lit("ok_has_content").alias("metric"), ((F.col("status_code") == 200) & (F.coalesce("n", F.lit(0)) >= 200)).cast("bigint").alias("numerator"), F.coalesce(F.col("status_code") == 200, F.lit(False)).cast("bigint").alias("denominator")),
    )).alias("x")).select("host", "encoding", "input_kind", "x.metric", F.coalesce("x.numerator", F.lit(0)).alias("numerator"), "x.denominator")
    return evaluate.roll_up(m, ["host", "encoding", "input_kind"])


CLASSES = ["normal", "prologue", "epilogue", "extra", "afterword", "interlude", "volume", "none"]


def confusion_matrix(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "chapter_title_matches").select(F.coalesce("chapter_type", F.lit("none")).alias("expected"), F.coalesce(titles.parse_title(F.col("title"))["chapter_type"], F.lit("none")).alias("predicted"))
    return evaluate.confusion(m, CLASSES)


def failure_distribution(s: SparkSession, d: str) -> DataFrame:
    p = _pages(s, d).join(_content_len(s, d), "page_id", "left").select(F.col("page_id").cast("string").alias("case_id"), F.coalesce("n", F.lit(0)).alias("n"), "status_code", "html")
    f = p.select("case_id", F.explode(F.array_compact(F.array(
        F.when(F.col("status_code") >= 400, "FETCH_ERROR"), F.when(F.col("html").contains("�"), "ENCODING_ERROR"), F.when((F.col("n") < 200) & (F.col("status_code") == 200), "CONTENT_TRUNCATED"),
    ))).alias("category"))
    return evaluate.failure_counts(f).select("category", "n", F.array_join(F.slice("cases", 1, 3), ",").alias("first_cases"))


def safe_filenames(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "catalog_entries").select("entry_id", textclean.safe_filename(F.col("title")).alias("safe"))


def encoding_decision(s: SparkSession, d: str) -> DataFrame:
    h = _pages(s, d).select("page_id", F.try_element_at(F.coalesce("headers", F.create_map().cast("map<string,string>")), F.lit("content-type")).alias("content_type"))
    j = table(s, d, "raw_captures").join(h, "page_id", "left")
    return charset.decode_captures(j).select("page_id", "encoding", "encoding_source", "encoding_confidence", "charset_conflict", F.length("text").alias("n_chars"))


def text_agreement(s: SparkSession, d: str) -> DataFrame:
    p = content.pick_content(dom.dom(_pages(s, d)))
    t = table(s, d, "content_extractions").where("text IS NOT NULL").groupBy("page_id").agg(F.max("text").alias("b"))
    # merge: the parsed side is taken for far smaller than it is, and the driver would gather its texts to broadcast them
    return p.select("page_id", "text").join(t.hint("merge"), "page_id").select("page_id", content.agreement(F.col("text"), F.col("b")).alias("ratio"))


def dom_lines(s: SparkSession, d: str) -> DataFrame:
    return dom.lines(dom.dom(_pages(s, d)))


def content_pick(s: SparkSession, d: str) -> DataFrame:
    p = content.pick_content(dom.dom(_pages(s, d)))
    return p.select("page_id", "tag", "score", "confidence", "anchored", F.length("text").alias("n_chars"))


def content_deep(s: SparkSession, d: str) -> DataFrame:
    return content.deep_confidence(content.pick_content(dom.dom(_pages(s, d))))


def page_type_scores(s: SparkSession, d: str) -> DataFrame:
    return content.page_types(content.page_features(dom.dom(_pages(s, d))))


def metadata_extract(s: SparkSession, d: str) -> DataFrame:
    return metadata.metadata(dom.dom(_pages(s, d)))


def nav_best(s: SparkSession, d: str) -> DataFrame:
    return _links(s, d)[1]


def nav_captured(s: SparkSession, d: str) -> DataFrame:
    """The links that the captured pages have."""
    return _walk_inputs(s, d)[2]


def _list_anchors(s: SparkSession, d: str) -> DataFrame:
    """Entries as the anchors of the list page they were read from; volumes are the holders of their entries."""
    e = table(s, d, "catalog_entries").where("source_page_url IS NOT NULL AND url IS NOT NULL")
    ids = e.groupBy("source_page_url").agg(F.min("entry_id").alias("page_id"))
    v = F.coalesce(F.length("volume"), F.lit(0))
    return e.join(ids, "source_page_url").select("page_id", F.col("entry_id").cast("int").alias("idx"), F.col("title").alias("text"), F.col("url").alias("href"), F.lit(0).alias("p1"), v.alias("p2"), (v % 3).alias("p3"), F.lit(0).alias("p4"))


def catalog_cluster(s: SparkSession, d: str) -> DataFrame:
    return catalog.clusters(_list_anchors(s, d))


def catalog_detect(s: SparkSession, d: str) -> DataFrame:
    return catalog.detect(_list_anchors(s, d)).select("page_id", "idx", "confidence")


def collapsed_lists(s: SparkSession, d: str) -> DataFrame:
    return catalog.collapsed_markers(dom.dom(_pages(s, d)))


def analyze_pages(s: SparkSession, d: str) -> DataFrame:
    return pipeline.analyze(_pages(s, d)).select("page_id", F.to_json("type").alias("type"), F.to_json("metadata").alias("metadata"), F.to_json("content").alias("content"), F.to_json("links").alias("links"))


def book_chapters(s: SparkSession, d: str) -> DataFrame:
    c = pipeline.finished_chapters(table(s, d, "catalog_entries"), _pages(s, d), table(s, d, "content_extractions"))
    return c.select("book_id", "pos", "title", "page_id", "status", "confidence")


def exported_books(s: SparkSession, d: str) -> DataFrame:
    c = pipeline.finished_chapters(table(s, d, "catalog_entries"), _pages(s, d), table(s, d, "content_extractions"))
    return pipeline.export_books(c)


def book_diagnostics(s: SparkSession, d: str) -> DataFrame:
    return pipeline.diagnose(table(s, d, "catalog_entries"))


def export_bodies(s: SparkSession, d: str) -> DataFrame:
    p = _pages(s, d).select("page_id", "url", F.coalesce("status_code", F.lit(200)).alias("status_code")).join(table(s, d, "content_extractions").groupBy("page_id").agg(F.max("text").alias("text")), "page_id", "left")
    st = F.when(F.col("status_code") == 200, "CONTENT_OK").when(F.col("status_code") == 404, "NOT_FOUND").otherwise("ACCESS_RESTRICTED")
    b = export.body(st, F.col("text"), F.array("url"))
    return p.select("page_id", F.length(b).cast("bigint").alias("n_chars"), F.md5(b).alias("body_md5"))


def capture_requests(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "catalog_entries").select("entry_id", "url")
    return captures.answer(r, _pages(s, d)).select("entry_id", "page_id", "out_of_scope")


def captures_latest(s: SparkSession, d: str) -> DataFrame:
    return captures.latest(_pages(s, d).select("page_id", "url", "captured_at", "received_at")).select("norm_url", "page_id")


def capture_incomplete(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).select("page_id", captures.looks_incomplete(F.col("html"), F.octet_length("html")).alias("incomplete"))


def table_violations(s: SparkSession, d: str) -> DataFrame:
    p = _pages(s, d)
    a = evaluate.violations(table(s, d, "content_extractions"), "page_id", [(p, "page_id", "page_id")])
    b = evaluate.violations(table(s, d, "chapter_title_matches"), "match_id", [(table(s, d, "catalog_entries"), "book_id", "book_id")])
    return a.withColumn("table_name", F.lit("content_extractions")).unionByName(b.withColumn("table_name", F.lit("chapter_title_matches"))).select("table_name", "problem", "n")


def page_walks(s: SparkSession, d: str) -> DataFrame:
    e = _kept(s, d).select("book_id", F.col("norm_url").alias("u"), urls.page_number(F.col("url")).alias("no"), urls.directory(F.col("url")).alias("dir")).where("no IS NOT NULL")
    st = e.alias("a").join(e.alias("b"), (F.col("a.book_id") == F.col("b.book_id")) & (F.col("a.dir") == F.col("b.dir")) & (F.col("b.no") == F.col("a.no") + 1)).select(F.col("a.u").alias("src"), F.col("b.u").alias("dst"))
    return graph.walk_pages(_kept(s, d).select(F.col("norm_url").alias("page")).distinct(), st, walks.MAX_CATALOG_PAGES)


def _walk_inputs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = _pages(s, d)
    dm = materialize(dom.dom(p))
    return p, dm, materialize(navigation.best_links(navigation.link_scores(dom.anchors(dm), p)))


def chapter_page_merge(s: SparkSession, d: str) -> DataFrame:
    p, dm, links = _walk_inputs(s, d)
    steps = walks.chapter_steps(links, p, metadata.page_title(dm))
    m = walks.merge_pages(p, steps, table(s, d, "content_extractions"))
    return m.select("start", "n_pages", F.length("text").alias("n_chars"), "repeats")


def catalog_page_find(s: SparkSession, d: str) -> DataFrame:
    p, dm, _ = _walk_inputs(s, d)
    a = dom.anchors(dm)
    return walks.explore(a, p, content.page_types(content.page_features(dm)), catalog.detect(a))


def chapter_traversal(s: SparkSession, d: str) -> DataFrame:
    p, links = _links(s, d)
    return walks.traverse(links, p)


def graph_cycles(s: SparkSession, d: str) -> DataFrame:
    p, links = _links(s, d)
    return graph.on_cycles(walks.chapter_edges(links, p))


def graph_cycle_paths(s: SparkSession, d: str) -> DataFrame:
    p, links = _links(s, d)
    return graph.cycle_paths(walks.chapter_edges(links, p))


def graph_cycles_captured(s: SparkSession, d: str) -> DataFrame:
    """Over the links that the captured pages have."""
    p, _, links = _walk_inputs(s, d)
    return graph.on_cycles(walks.chapter_edges(links, p))


def evaluated_pages(s: SparkSession, d: str) -> DataFrame:
    """Every page scored against what the tables say of it: the longest extraction is the reference of its main text, and no page is an access page."""
    p = _pages(s, d)
    t = table(s, d, "content_extractions").groupBy("page_id").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("reference"))
    lab = p.join(t, "page_id", "left").select(
        F.col("host").alias("case_id"), evaluate.sample_type(F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.array("input_kind"), F.lit("real_capture")).alias("sample_type"), "page_id",
        F.lit("CHAPTER_PAGE").alias("page_type"), F.when(F.col("status_code") == 200, "CONTENT_OK").alias("content_status"), F.when(F.col("status_code") == 404, "NOT_FOUND").alias("access_status"), F.lit(None).cast("boolean").alias("has_metadata"),
        F.lit(None).cast("string").alias("book_title"), F.lit(None).cast("string").alias("author"), (F.length("reference") > 0).alias("has_content"), "reference", F.array(F.lit("{{")).alias("forbidden"),
        F.lit(None).cast("array<struct<title:string,target_url:string>>").alias("entries"), F.lit(None).cast("string").alias("direction"), F.lit(None).cast("array<struct<type:string,target_url:string>>").alias("relations"), F.lit(False).alias("encoding_sensitive"),
    )
    return evaluate.score_pages(lab, pipeline.predictions(p)).groupBy("metric", "sample_type").agg(F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"), F.count("*").alias("n"))


def reciprocal_links(s: SparkSession, d: str) -> DataFrame:
    p, links = _links(s, d)
    return walks.reciprocal(links, p)


def queries() -> dict[str, Query]:
    k = lambda f: lambda s, d: f(_kept(s, d))
    return {
        "host_link_density": host_link_density, "url_normalize": url_normalize, "url_page_number": url_page_number, "url_pair_similarity": url_pair_similarity,
        "anchor_inventory": anchor_inventory, "page_title_pick": page_title_pick, "title_parse": title_parse, "strip_suffixes": strip_suffixes, "content_status": content_status,
        "phrase_hits": phrase_hits, "metadata_best": metadata_best, "fingerprint_jaccard": fingerprint_jaccard, "tag_signature_similarity": tag_signature_similarity,
        "fingerprint_compare": fingerprint_compare, "fingerprint_classes": fingerprint_classes, "list_classes": list_classes, "lists_alike": lists_alike, "relation_score": relation_score, "catalog_dominant_dir": catalog_dominant_dir, "catalog_keep_last": catalog_keep_last,
        "catalog_direction": k(catalog.direction), "catalog_segment_rotate": k(catalog.rotate), "catalog_gaps": k(catalog.gaps), "boilerplate_blocks": boilerplate_blocks,
        "boilerplate_removed": boilerplate_removed, "clean_lines": clean_lines, "line_kinds": line_kinds, "duplicate_content_pages": duplicate_content_pages, "part_merge": part_merge,
        "running_median_ok": running_median_ok, "consecutive_failure_cut": consecutive_failure_cut, "adaptive_pacing": adaptive_pacing, "status_counts": status_counts,
        "profile_by_host": profile_by_host, "profile_check": profile_check, "graph_next_edges": graph_next_edges, "graph_ends": graph_ends, "graph_reading_order": graph_reading_order,
        "graph_cycles": graph_cycles, "graph_cycle_paths": graph_cycle_paths, "profile_counters": profile_counters, "graph_cycles_captured": graph_cycles_captured, "evaluated_pages": evaluated_pages, "catalog_precision_recall": catalog_precision_recall, "metric_rollup": metric_rollup, "confusion_matrix": confusion_matrix,
        "failure_distribution": failure_distribution, "safe_filenames": safe_filenames, "encoding_decision": encoding_decision, "text_agreement": text_agreement, "dom_lines": dom_lines,
        "content_pick": content_pick, "content_deep": content_deep, "page_type_scores": page_type_scores, "metadata_extract": metadata_extract, "nav_best": nav_best, "nav_captured": nav_captured,
        "catalog_cluster": catalog_cluster, "catalog_detect": catalog_detect, "collapsed_lists": collapsed_lists, "analyze_pages": analyze_pages, "book_chapters": book_chapters, "exported_books": exported_books,
        "book_diagnostics": book_diagnostics, "export_bodies": export_bodies, "capture_requests": capture_requests, "captures_latest": captures_latest,
        "capture_incomplete": capture_incomplete, "table_violations": table_violations, "page_walks": page_walks, "chapter_page_merge": chapter_page_merge,
        "catalog_page_find": catalog_page_find, "chapter_traversal": chapter_traversal, "reciprocal_links": reciprocal_links,
    }


def oracle_sql() -> dict[str, str]:
    from folio.plans.oracle import SQL

    return SQL
