"""From captures to books: the page analysis and the assembly of chapters as one plan each."""

from __future__ import annotations

import argparse
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import urls
from folio.functions.textclean import clean_text
from folio.functions.titles import has_page_marker, parse_title, strip_sub_number
from folio.operators import catalog, chapters, content, dom, graph, metadata, navigation, walks
from folio.sources import captures as cap
from folio.sources import export
from folio.util import build_session, cleanup, materialize, ship, table


META = ("book_title", "title_source", "title_confidence", "author", "author_source", "author_confidence", "description", "cover_url", "volume_title")


def judged(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(page_id, anchors, headings, title, page_text, pick, metadata, type, ``keep`` of pages): each page parsed once and judged, all in one pass.

    Nodes and lines are used up here: what is left is about as large as the page's text.
    """
    keep = keep or []
    d = content.with_pick(dom.dom(pages, keep=keep))
    own = ["anchors", "headings", "title", "page_text", "pick", *keep]
    m = metadata.metadata(d, [*own, "metas", "link_len"])
    m = m.select("page_id", *own, "metas", "link_len", F.struct(*META).alias("metadata"))
    t = content.page_types(content.page_features(m, ["anchors", "headings", "title", "page_text", "pick", "metadata", *keep]), [*own, "metadata"])
    return t.select("page_id", *own, "metadata", F.struct("page_type", "confidence", "chapter", "catalog", "book").alias("type"))


def analyze(pages: DataFrame, preview: int = 300) -> DataFrame:
    """One nested row per page: type, metadata, content with a preview, links, and the first titles of a table of contents."""
    j = materialize(judged(pages))
    links = navigation.best_links(navigation.link_scores(dom.anchors(j), pages))
    nav = links.groupBy("page_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("relation", "target")))).alias("links"))
    toc = catalog.detect(dom.anchors(j)).groupBy("page_id").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("idx", "text"))), 1, 20), lambda x: x["text"]).alias("toc"))
    c = F.struct(F.length("pick.text").alias("chars"), F.left("pick.text", F.lit(preview)).alias("preview"), F.col("pick.tag").alias("tag"), F.col("pick.confidence").alias("confidence"), F.col("pick.positives").alias("positives"), F.col("pick.penalties").alias("penalties"))
    out = j.select("page_id", "type", "metadata", c.alias("content")).join(nav, "page_id", "left").join(toc, "page_id", "left")
    return out.select("page_id", "type", "metadata", "content", "links", F.when(F.col("type.page_type") == "CATALOG_PAGE", F.col("toc")).alias("toc"))


def predictions(pages: DataFrame) -> DataFrame:
    """What each page is found to be, as evaluate.PREDICTION: the input of evaluate.score_pages. No label is read."""
    server = F.try_element_at(F.coalesce("headers", F.create_map().cast("map<string,string>")), F.lit("server"))
    j = judged(pages.withColumn("server", server), ["status_code", "server", "html"])
    marks = content.access_marks(F.col("server"), F.col("html"), F.col("page_text"))
    j = materialize(j.select("page_id", "status_code", "anchors", "pick", "metadata", "type", marks.alias("marks")))
    st = content.access_from(F.coalesce("status_code", F.lit(200)), F.col("marks"), content.trimmed_length(F.col("pick.text")), F.col("pick.confidence"), F.lit(None).cast("int"))
    links = navigation.best_links(navigation.link_scores(dom.anchors(j), pages)).where(F.col("score") >= navigation.MIN_CONFIDENCE)
    nav = links.groupBy("page_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("relation", "target")))).alias("links"), F.max("score").alias("link_confidence"))
    e = catalog.detect(dom.anchors(j)).join(pages.select("page_id", "url"), "page_id").select("page_id", "idx", "text", urls.resolve(F.col("url"), F.col("href")).alias("target_url"), "confidence")
    toc = e.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.col("text").alias("title"), "target_url"))), lambda x: F.struct(x["title"].alias("title"), x["target_url"].alias("target_url"))).alias("entries"), F.max("confidence").alias("catalog_confidence"))
    way = catalog.direction(e.select(F.col("page_id").alias("book_id"), F.col("idx").alias("dom_index"), F.col("idx").alias("entry_id"), F.col("text").alias("title"))).select(F.col("book_id").alias("page_id"), "direction")
    p = j.withColumn("st", st).join(nav, "page_id", "left").join(toc, "page_id", "left").join(way, "page_id", "left")
    return p.select(
        "page_id", F.col("type.page_type").alias("page_type"), F.col("type.confidence").alias("page_type_confidence"), F.col("st.status").alias("content_status"), F.col("st.confidence").alias("content_status_confidence"),
        F.col("pick.text").alias("content"), F.col("pick.confidence").alias("content_confidence"), *[F.col(f"metadata.{x}").alias(x) for x in ("book_title", "title_confidence", "author", "author_confidence")],
        "links", "link_confidence", "entries", F.coalesce("catalog_confidence", F.lit(0.0)).alias("catalog_confidence"), F.coalesce("direction", F.lit("UNKNOWN")).alias("direction"),
    )


def captured_entries(pages: DataFrame) -> DataFrame:
    """Entries as book_chapters takes them, from the list pages among the captures themselves, see walks.resolved_lists."""
    p = pages.join(cap.latest(pages.select("page_id", "url", "received_at", "captured_at")).select("page_id"), "page_id", "left_semi").select("page_id", "url", "html")
    d = materialize(dom.dom(p).select("page_id", "anchors"))
    a = dom.anchors(d)
    return walks.resolved_lists(a, p, materialize(navigation.best_links(navigation.link_scores(a, p))))


def ordered_entries(entries: DataFrame) -> DataFrame:
    """A book's entries in reading order: last one per url, turned round if the list descends, rotated if it begins with its later part."""
    e = materialize(catalog.keep_last(entries))
    d = catalog.direction(e).select("book_id", "direction")
    r = catalog.rotate(e).select("book_id", "entry_id", "new_pos")
    j = e.join(r, ["book_id", "entry_id"]).join(d, "book_id", "left")
    key = F.when(F.col("direction") == "DESCENDING", -F.col("new_pos")).otherwise(F.col("new_pos"))
    return chapters.in_order(j.withColumn("k", key), "book_id", ["k", "entry_id"]).select("book_id", "entry_id", "title", "url", "norm_url", "direction", "pos")


def expanded_entries(entries: DataFrame, d: DataFrame, pages: DataFrame) -> DataFrame:
    """Entries with those behind the folds of their list pages in place, read from captured payloads."""
    own = entries.select("entry_id", "book_id", "title", "url", "dom_index")
    if "source_page_url" not in entries.columns:
        return own
    x = walks.expand(catalog.collapsed_markers(d), pages, pages.select("url", F.col("html").alias("text")))
    at = x.join(pages.select("page_id", F.col("url").alias("list_url"), "norm_url"), "page_id")
    lists = entries.where("book_id IS NOT NULL").select("book_id", urls.normalize_url(F.col("source_page_url")).alias("norm_url")).distinct()
    put = materialize(at.join(lists, "norm_url").select("book_id", urls.resolve(F.col("list_url"), F.col("after_href")).alias("after_url"), urls.resolve(F.col("list_url"), F.col("before_href")).alias("before_url"), "seq", "title", "url"))
    books = put.select("book_id").distinct()
    spliced = catalog.splice(own.join(books, "book_id", "left_semi"), put)
    spliced = spliced.select(F.col("pos").cast("bigint").alias("entry_id"), "book_id", "title", "url", F.col("pos").alias("dom_index"))
    return own.join(books, "book_id", "left_anti").unionByName(spliced)


def filled_entries(ordered: DataFrame, links: DataFrame, pages: DataFrame, titles: DataFrame) -> DataFrame:
    """(book_id, pos, title, url, norm_url): ordered entries with the captured chapters that lead over gaps of their numbers."""
    e = ordered.select("book_id", "pos", "title", "url", "norm_url")
    f = walks.fill_gaps(e.withColumn("number", parse_title(F.col("title"))["order_token"]), links, pages, titles)
    new = materialize(f.join(pages.select("page_id", "url", "norm_url"), "page_id").select("book_id", F.col("after_pos").alias("pos"), "step", F.coalesce("title", "url").alias("title"), "url", "norm_url"))
    # a way over entries the list already has is no gap's
    known = new.join(e.select("book_id", "norm_url"), ["book_id", "norm_url"], "left_semi").select("book_id", "pos").distinct()
    u = e.withColumn("step", F.lit(0).cast("int")).unionByName(new.join(known, ["book_id", "pos"], "left_anti"))
    return chapters.in_order(u.withColumnRenamed("pos", "p0"), "book_id", ["p0", "step"]).select("book_id", "pos", "title", "url", "norm_url")


def walked_entries(listed: DataFrame, steps: DataFrame, links: DataFrame, pages: DataFrame, titles: DataFrame, types: DataFrame) -> DataFrame:
    """(book_id, pos, title, url, norm_url): chapters of books without a list, by their chapter links; book_id is the negative id of the first page.

    Pages of lists, links to other hosts and chains that touch a listed book do
    not count; later pages of a chapter stand for its first. Chains that run in
    a circle have no first page and are no books.
    """
    n = steps.select(F.col("src").alias("key")).union(steps.select(F.col("dst").alias("key"))).distinct()
    first = materialize(graph.reading_order(n, steps.select("src", "dst", F.lit(1.0).alias("confidence"))).where("head IS NOT NULL").select("key", "head"))
    ok = pages.select("page_id", urls.authority(F.col("url")).alias("host")).join(types.where("page_type = 'CATALOG_PAGE'").select("page_id"), "page_id", "left_anti")
    x = walks.chapter_edges(links, pages)
    x = x.join(ok.select(F.col("page_id").alias("src"), F.col("host").alias("h1")), "src").join(ok.select(F.col("page_id").alias("dst"), F.col("host").alias("h2")), "dst").where("h1 = h2")
    x = x.join(first.select(F.col("key").alias("src"), F.col("head").alias("s1")), "src", "left").join(first.select(F.col("key").alias("dst"), F.col("head").alias("d1")), "dst", "left")
    x = materialize(x.select(F.coalesce("s1", "src").alias("src"), F.coalesce("d1", "dst").alias("dst"), "confidence").where("src <> dst").groupBy("src", "dst").agg(F.max("confidence").alias("confidence")))
    o = materialize(graph.reading_order(x.select(F.col("src").alias("key")).union(x.select(F.col("dst").alias("key"))).distinct(), x).where("head IS NOT NULL"))
    own = listed.join(pages.select("page_id", "norm_url"), "norm_url").select(F.col("page_id").alias("key")).distinct()
    taken = o.join(own.join(first, "key", "left").select(F.coalesce("head", "key").alias("key")).distinct(), "key", "left_semi").select("head").distinct()
    several = o.where("rank >= 1").select("head").distinct()
    c = o.join(taken, "head", "left_anti").join(several, "head", "left_semi").join(pages.select(F.col("page_id").alias("key"), "url", "norm_url"), "key").join(titles.withColumnRenamed("page_id", "key"), "key", "left")
    return c.select((-F.col("head")).alias("book_id"), (F.col("rank") + 1).cast("int").alias("pos"), F.coalesce("page_title", F.concat(F.lit("第"), (F.col("rank") + 1).cast("string"), F.lit("章"))).alias("title"), "url", "norm_url")


def merged_parts(chs: DataFrame) -> DataFrame:
    """Chapters with the parts of one chapter as one row: texts in order, a line in place of each part without one, the first bad status, the least confidence."""
    p = parse_title(F.col("title"))
    key = chs.select("book_id", "pos", "title", p.alias("p"))
    whole = (F.col("p.chapter_type") == "normal") & (F.col("p.chapter_number") == F.floor("p.chapter_number"))
    runs = materialize(chapters.part_runs(key.select("book_id", "pos", F.when(whole, F.col("p.chapter_number")).alias("number"), "p.sub_number")).select("book_id", "pos", "run"))
    several = runs.groupBy("book_id", "run").agg(F.count("*").alias("n")).where("n > 1").select("book_id", "run", F.lit(True).alias("several"))
    j = materialize(chs.join(runs, ["book_id", "pos"]).join(several, ["book_id", "run"], "left"))
    cols = ["title", "url", "page_id", "status", "confidence", "content"]
    g = j.where("several").groupBy("book_id", "run").agg(F.array_sort(F.collect_list(F.struct("pos", *cols))).alias("s"))
    part = lambda x: F.when(x["status"] == "CONTENT_OK", F.coalesce(x["content"], F.lit(""))).otherwise(F.concat(F.lit("【"), F.coalesce(x["title"], F.lit("")), F.lit(" 未能提取："), x["status"], F.lit("】")))
    bad = F.try_element_at(F.filter("s", lambda x: x["status"] != "CONTENT_OK"), F.lit(1))["status"]
    one = F.col("s")[0]
    m = g.select(
        "book_id", F.col("run").alias("pos"), strip_sub_number(one["title"]).alias("title"), one["url"].alias("url"), F.try_element_at(F.filter(F.transform("s", lambda x: x["page_id"]), lambda x: x.isNotNull()), F.lit(1)).alias("page_id"), F.coalesce(bad, F.lit("CONTENT_OK")).alias("status"),
        F.array_min(F.transform("s", lambda x: x["confidence"])).alias("confidence"), F.array_join(F.transform("s", part), "\n\n").alias("content"),
    )
    return j.where("several IS NULL").select("book_id", F.col("run").alias("pos"), *cols).unionByName(m).withColumn("pos", F.col("pos").cast("int"))


def without_recurrent(chs: DataFrame) -> DataFrame:
    """Chapters without their book's recurrent blocks; one that is empty without them is UNKNOWN_FAILURE."""
    c = chs.withColumn("doc", F.concat_ws(":", F.col("book_id").cast("string"), F.col("pos").cast("string")))
    r = chapters.remove_recurrent(c.withColumn("content", F.coalesce("content", F.lit(""))), "book_id", "doc", "content").select("doc", F.col("text").alias("kept"), "emptied")
    lost = F.col("emptied") & (F.col("status") == "CONTENT_OK")
    j = c.join(r, "doc")
    return j.select(
        "book_id", "pos", "title", "url", "page_id", F.when(lost, "UNKNOWN_FAILURE").otherwise(F.col("status")).alias("status"),
        F.when(lost, F.least("confidence", F.lit(0.2))).otherwise(F.col("confidence")).alias("confidence"), F.when(F.col("content").isNotNull(), F.col("kept")).alias("content"),
    )


def page_extractions(d: DataFrame, picked: DataFrame, texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(page_id, text, confidence, judged): each wanted page's extraction, from the page itself where the table has none; confidence re-judged if below 0.6; judged: the length a status goes by."""
    has = texts.where("text IS NOT NULL").withColumn("c", F.col("confidence").cast("double") if "confidence" in texts.columns else F.lit(None).cast("double"))
    t = has.groupBy("page_id").agg(F.max_by(F.struct("text", "c"), F.length("text")).alias("t"))
    p = picked.withColumnRenamed("text", "own").withColumnRenamed("confidence", "own_c")
    j = wanted.join(t, "page_id", "left").join(p, "page_id", "left")
    j = j.withColumn("text", F.coalesce("t.text", "own")).withColumn("confidence", F.when(F.col("t").isNull(), F.col("own_c")).otherwise(F.coalesce("t.c", "own_c", F.lit(0.8))))
    weak = j.where("confidence < 0.6 AND deep IS NOT NULL").select("page_id", "confidence", "tag", F.col("own").alias("text"), "deep")
    deep = content.deep_confidence(weak).select("page_id", F.col("confidence").alias("deep_c"), content.trimmed_length(F.col("text")).alias("deep_n"))
    return j.select("page_id", "text", "confidence").join(deep, "page_id", "left").select("page_id", "text", F.coalesce("deep_c", "confidence").alias("confidence"), F.coalesce("deep_n", content.trimmed_length(F.col("text"))).alias("judged"))


def book_chapters(entries: DataFrame, pages: DataFrame, texts: DataFrame, max_chapters: int | None = None) -> DataFrame:
    """Chapters of every book in order: (book_id, pos, title, url, page_id, status, confidence, content).

    Entries behind folds are put in place, the list is ordered, gaps of its
    numbers are filled over next links, and books without a list are walked.
    Entries are answered from captures; a chapter without one is NOT_CAPTURED
    and stays in the list. A chapter's later pages are merged into it, its text
    is cleaned and judged against the running median of its book; then parts of
    one chapter become one. With max_chapters only so many chapters of a book are
    read, and what is left out is warned of. What recurs across a book is left to finished_chapters.
    """
    # which capture of an address counts is decided on keys alone, so that pages are not aggregated
    last = cap.latest(pages.select("page_id", "url", "received_at", "captured_at")).select("page_id", "norm_url")
    raw = pages.join(last.select("page_id"), "page_id", "left_semi")
    server = F.try_element_at(F.coalesce("headers", F.create_map().cast("map<string,string>")), F.lit("server"))
    d = judged(raw.select("page_id", "url", "status_code", server.alias("server"), "html"), ["url", "status_code", "server", "html"])
    marks = content.access_marks(F.col("server"), F.col("html"), F.col("page_text"))
    d = d.select("page_id", "url", "status_code", marks.alias("marks"), "anchors", metadata.title_of().alias("page_title"), "pick", F.col("type.page_type").alias("page_type"), urls.normalize_url(F.col("url")).alias("norm_url"))
    d = materialize(d)
    c = d.select("page_id", "url", "norm_url", "status_code", "marks")
    picked = d.select("page_id", "pick.*")
    links = materialize(navigation.best_links(navigation.link_scores(dom.anchors(d), c)))
    titles = d.select("page_id", "page_title")
    steps = materialize(walks.chapter_steps(links, c, titles))
    e = materialize(filled_entries(materialize(ordered_entries(expanded_entries(entries, d, raw.select("page_id", "url", "html", urls.normalize_url(F.col("url")).alias("norm_url"))))), links, c, titles))
    e = e.unionByName(walked_entries(e, steps, links, c, titles, d.select("page_id", "page_type")))
    e = materialize(e.join(c.select("norm_url", "page_id"), "norm_url", "left"))
    if max_chapters:
        n = e.where(F.col("pos") > max_chapters).agg(F.count("*"), F.countDistinct("book_id")).first()
        if n[0]:
            warnings.warn(f"stopped at max_chapters={max_chapters}: {n[0]} chapters of {n[1]} books are left out", stacklevel=2)
        e = e.where(F.col("pos") <= max_chapters)
    starts = e.where("page_id IS NOT NULL").select("page_id").distinct()
    x = materialize(page_extractions(d, picked, texts, starts.union(steps.select(F.col("dst").alias("page_id"))).distinct()))
    m = walks.merge_pages(starts, steps, x).select(F.col("start").alias("page_id"), F.col("text").alias("raw"), "repeats")
    j = e.join(m, "page_id", "left").join(x.select("page_id", "judged", F.col("confidence").alias("own")), "page_id", "left").join(titles, "page_id", "left")
    marked = has_page_marker(F.col("page_title")) & F.col("title").isNotNull()
    j = j.withColumn("title", F.when(F.coalesce(marked, F.lit(False)), F.col("title")).when(content.strong_title(F.col("page_title")), F.col("page_title")).otherwise(F.coalesce("title", "page_title")))
    j = materialize(j.select("book_id", "pos", "title", "url", "page_id", "repeats", "judged", "own", clean_text(F.col("raw"), F.col("title")).alias("content")))
    med = chapters.running_median(j.select("book_id", "pos", F.length(F.coalesce("content", F.lit(""))).alias("n")).withColumnRenamed("pos", "p0"), "book_id", ["p0"], "n", F.col("n") >= 200).select("book_id", F.col("pos"), "median_prev")
    j = j.join(med, ["book_id", "pos"], "left").join(c.select("page_id", "status_code", "marks"), "page_id", "left")
    own = F.coalesce("own", F.lit(0.0))
    st = content.access_from(F.coalesce("status_code", F.lit(200)), F.col("marks"), F.coalesce("judged", F.lit(0)), own, F.col("median_prev"))
    none, twice = F.col("page_id").isNull(), F.coalesce("repeats", F.lit(False))
    s = j.withColumn("st", st).select(
        "book_id", "pos", "title", "url", "page_id", F.when(none, "NOT_CAPTURED").when(twice, "UNKNOWN_FAILURE").otherwise(F.col("st.status")).alias("status"),
        F.when(none, 0.0).otherwise(F.least("st.confidence", own, F.when(twice, F.lit(0.2)))).alias("confidence"), "content",
    )
    return merged_parts(materialize(s))


def finished_chapters(entries: DataFrame, pages: DataFrame, texts: DataFrame, max_chapters: int | None = None) -> DataFrame:
    """The whole of a download: book_chapters without the blocks that recur across a book."""
    return without_recurrent(materialize(book_chapters(entries, pages, texts, max_chapters)))


def export_books(chs: DataFrame) -> DataFrame:
    """(book_id, text): merged texts with a note for every chapter that is missing or restricted."""
    b = chs.withColumn("body", export.body(F.col("status"), clean_text(F.col("content"), F.col("title")), F.array(F.coalesce("url", F.lit("")))))
    return export.merged(b)


def diagnose(entries: DataFrame) -> DataFrame:
    """(book_id, n, duplicates, missing, orphans, broken): entries of a url that another has, gaps in numbers, chapters without neighbours, and whether the order breaks."""
    e = materialize(ordered_entries(entries))
    keyed = e.withColumn("key", F.concat_ws("|", F.col("book_id").cast("string"), "norm_url"))
    edges = graph.consecutive_edges(keyed, "book_id", "key", F.col("direction") == "ASCENDING")
    end = graph.ends(keyed, edges)
    per = keyed.join(end, "key").groupBy("book_id").agg(F.count("*").alias("n"), F.count_if("is_orphan").alias("orphans"), (F.count_if("is_head") > 1).alias("broken"))
    miss = catalog.gaps(e).groupBy("book_id").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("missing"))
    raw = entries.where("url IS NOT NULL AND book_id IS NOT NULL").groupBy("book_id").agg(F.count("*").alias("raw"))
    return per.join(miss, "book_id", "left").join(raw, "book_id").select("book_id", "n", (F.col("raw") - F.col("n")).alias("duplicates"), F.coalesce("missing", F.lit(0)).alias("missing"), "orphans", "broken")


def main(argv: list[str] | None = None) -> int:
    """Command line: analyze or download over a folder of tables; exit code 1 if any chapter is flagged."""
    p = argparse.ArgumentParser(prog="folio")
    p.add_argument("command", choices=("analyze", "download", "inspect"))
    p.add_argument("tables", help="folder with fetched_pages, content_extractions and catalog_entries")
    p.add_argument("--out", required=True)
    p.add_argument("--find-lists", action="store_true", help="take entries from the captured list pages, not from catalog_entries")
    p.add_argument("--max-chapters", type=int, help="read a book only so far, with a warning; else all of it")
    a = p.parse_args(argv)
    spark = build_session("folio")
    ship(spark)
    pages = table(spark, a.tables, "fetched_pages")
    if a.command == "analyze":
        analyze(pages).write.mode("overwrite").parquet(a.out)
        cleanup(spark)
        return 0
    entries = materialize(captured_entries(pages)) if a.find_lists else table(spark, a.tables, "catalog_entries")
    if a.command == "inspect":
        diagnose(entries).write.mode("overwrite").parquet(a.out)
        cleanup(spark)
        return 0
    chs = materialize(finished_chapters(entries, pages, table(spark, a.tables, "content_extractions"), a.max_chapters))
    export.write_books(export_books(chs), a.out)
    flagged = bool(chs.where("status <> 'CONTENT_OK'").limit(1).count())
    cleanup(spark)
    return int(flagged)


def authority_of(pages: DataFrame) -> DataFrame:
    return pages.withColumn("authority", urls.authority(F.col("url")))


if __name__ == "__main__":
    raise SystemExit(main())
