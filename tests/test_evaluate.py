"""Scoring of pages and chapters against labels."""

import difflib
import random
import time

from pyspark.sql import functions as F

from folio.functions.matching import matched_size
from folio.operators import evaluate as ev
from folio.plans import pipeline

STORY = "他走进镇子，看见灯火。" * 40


def rows(df):
    return {(r["sample_id"], r["metric"], r["expected"] if r["metric"] in ("navigation_accuracy", "body_noise_exclusion") else None): r for r in df.collect()}


def labels(spark, *made):
    blank = {c.split(" ")[0]: None for c in ev.LABEL.replace("struct<title:string,target_url:string>", "x").replace("struct<type:string,target_url:string>", "x").split(", ")}
    return spark.createDataFrame([tuple({**blank, "case_id": "k", "sample_type": "synthetic", **m}.values()) for m in made], ev.LABEL)


def test_score_pages(spark):
    links = {"NEXT_CHAPTER": "http://h/2", "NEXT_PAGE": "http://h/1_2"}
    p = spark.createDataFrame([
        (1, "CHAPTER_PAGE", 0.9, "CONTENT_OK", 0.8, "abc\r\nxyz", 0.8, "B", 0.7, None, None, links, 0.7, [("t", "http://h/1"), ("u", "http://h/9")], 0.6, "ASCENDING"),
        (2, "UNKNOWN", 0.2, "PAYWALL", 0.8, "secret", 0.5, None, None, "W", 0.9, None, None, None, None, "UNKNOWN"),
    ], ev.PREDICTION)
    lab = labels(
        spark,
        {"page_id": 1, "page_type": "CHAPTER_PAGE", "content_status": "CONTENT_OK", "access_status": "OK", "book_title": "B", "author": "A", "has_content": True, "reference": "abc\nxy", "forbidden": ["xyz", "nope"], "entries": [("t", "http://h/1"), ("v", "http://h/3")], "direction": "DESCENDING",
         "relations": [("NEXT_CHAPTER", "http://h/2"), ("PREVIOUS_CHAPTER", "http://h/0"), ("NEXT_CONTENT_PAGE", "http://h/1_2")]},
        {"page_id": 2, "page_type": "CHAPTER_PAGE", "content_status": "CONTENT_OK", "access_status": "PAYWALL", "has_metadata": False, "has_content": False, "forbidden": ["secret"]},
        {"page_id": 3, "page_type": "UNKNOWN"},
        {"page_id": 2},
    )
    got = rows(ev.score_pages(lab, p))
    n = {k: (r["numerator"], r["denominator"], r["category"]) for k, r in got.items()}
    assert n["1", "page_type_accuracy", None] == (1, 1, None) and n["2", "page_type_accuracy", None] == (0, 1, "PAGE_TYPE_FALSE_NEGATIVE")
    assert n["2", "content_status_accuracy", None] == (0, 1, "CONTENT_STATUS_WRONG") and n["2", "access_status_accuracy", None] == (1, 1, None)
    assert n["2", "metadata_suppression", None] == (0, 1, "METADATA_WRONG_AUTHOR") and n["1", "author_accuracy", None][2] == "METADATA_WRONG_AUTHOR"
    assert n["1", "content_retained_chars", None] == (6, 6, None) and n["1", "content_precision_chars", None] == (6, 7, "CONTENT_NOISE_INCLUDED")
    assert n["2", "unsafe_body_rejection", None] == (1, 1, None)
    assert n["1", "catalog_recall", None] == (1, 2, "CATALOG_WRONG_GROUP") and n["1", "catalog_precision", None] == (1, 2, "CATALOG_WRONG_GROUP")
    assert n["1", "catalog_direction_accuracy", None][2] == "CATALOG_WRONG_DIRECTION"
    assert n["1", "body_noise_exclusion", "xyz"][0] == 0 and n["1", "body_noise_exclusion", "nope"][0] == 1 and n["2", "body_noise_exclusion", "secret"][0] == 1
    assert n["1", "navigation_accuracy", "http://h/2"][0] == 1 and n["1", "navigation_accuracy", "http://h/0"][2] == "NAVIGATION_WRONG_RELATION"
    assert n["1", "pagination_relation_accuracy", None] == (1, 1, None)
    assert n["3", "page_present", None] == (0, 1, "FETCH_ERROR")
    assert [tuple(r) for r in ev.abstained(lab, p).collect()] == [("k", 1)]
    assert ev.score_pages(lab.limit(0), p).count() == 0 and ev.score_pages(lab, p.limit(0)).where("metric <> 'page_present'").count() == 0


def test_score_chapters(spark):
    log = spark.createDataFrame([("k", "synthetic", i, f"c{i}", u, t, i == 3) for i, u, t in ((1, ["a", "b"], "xy"), (2, ["c"], None), (3, ["d"], "zz"), (4, ["e"], None))], "case_id string, sample_type string, pos int, chapter_id string, source_urls array<string>, reference string, encoding_sensitive boolean")
    found = spark.createDataFrame([("k", 1, ["a"], "x"), ("k", 2, ["c", "q"], "w"), ("k", 3, ["d"], "z")], "case_id string, pos int, source_urls array<string>, content string")
    n = {(r["sample_id"], r["metric"]): (r["numerator"], r["denominator"], r["category"]) for r in ev.score_chapters(log, found).collect()}
    assert n["c1", "pagination_merge_accuracy"][2] == "CONTENT_PAGINATION_MISSED" and n["c2", "pagination_merge_accuracy"][2] == "CONTENT_PAGINATION_OVERMERGED" and n["c3", "pagination_merge_accuracy"] == (1, 1, None)
    assert n["c1", "content_retained_chars"] == (1, 2, "CONTENT_TRUNCATED") and n["c3", "content_retained_chars"] == (1, 2, "ENCODING_ERROR")
    assert n["c4", "logical_chapter_presence"] == (0, 1, "CHAPTER_MISSING") and n["k", "reading_chain_exact"] == (0, 1, "READING_ORDER_WRONG")
    assert ev.score_chapters(log.limit(0), found).count() == 0


def test_kinds_and_groups(spark):
    df = spark.createDataFrame([("CN_DYNAMIC_INPUT", None, None, "synthetic"), (None, ["paywall"], ["HTTP_BYTES"], "real_capture"), ("x", [], [], "real_capture"), (None, None, None, None)], "suite string, tags array<string>, kinds array<string>, source string")
    assert [r[0] for r in df.select(ev.sample_type(*map(lambda c: df[c], ("suite", "tags", "kinds", "source")))).collect()] == ["dynamic", "challenge", "real_fixture", "synthetic"]
    a = spark.createDataFrame([(1, i, f"第{i}章", f"/b/{i}.html", 0, 5 if i < 9 else 6, 0, 0) for i in range(1, 12)], "page_id bigint, idx int, text string, href string, p1 int, p2 int, p3 int, p4 int")
    want = spark.createDataFrame([(1, "/b/9.html"), (1, "/b/10.html"), (1, "/b/1.html")], "page_id bigint, href string")
    g = {r["cluster"]: r for r in ev.groups(a, want).collect()}
    assert g[5]["selected"] and g[5]["n_expected"] == 1 and not g[5]["gold"] and g[6]["gold"] and g[6]["n_expected"] == 2
    pairs = spark.createDataFrame([("a", "X", "X"), ("b", "X", "Y"), ("c", None, None)], "case_id string, expected string, predicted string")
    assert [tuple(r) for r in ev.misclassified(pairs).collect()] == [("b", "X", "Y")]


def test_predictions(spark):
    html = f"<html><head><title>第1章 风</title></head><body><h1>第1章 风</h1><div><h2>第1章 风</h2><p>{STORY}</p><p>{STORY}</p></div><a href='2.html'>下一章</a></body></html>"
    pages = spark.createDataFrame([(1, "http://h/b/1.html", 200, html, {"server": "x"}), (2, "http://h/b/9", 404, "<p>x</p>", None), (3, "http://h/b/8", 200, None, None)], "page_id bigint, url string, status_code int, html string, headers map<string,string>")
    df = pipeline.predictions(pages)
    assert [f.name for f in df.schema.fields] == [c.split(" ")[0] for c in ev.PREDICTION.replace("struct<title:string,target_url:string>", "x").replace("map<string,string>", "m").split(", ")]
    got = {r["page_id"]: r for r in df.collect()}
    assert set(got) == {1, 2} and got[1]["content_status"] == "CONTENT_OK" and got[1]["links"]["NEXT_CHAPTER"] == "http://h/b/2.html" and got[2]["content_status"] == "NOT_FOUND"


def _edited(r, text, n):
    for _ in range(n):
        i, j = r.randrange(len(text) + 1), r.randrange(len(text) + 1)
        text = r.choice([text[:i] + "　　" + text[i:], text[:i] + text[i + 5 :], text[:i] + text[j : j + 30] + text[i:], text[:i] + "é" + text[i + 1 :]])
    return text


def test_matched_size_is_that_of_difflib():
    r = random.Random(5)
    for letters in ("a", "ab", "abcdefgh ", "一二三四五六七八九十𠀀"):
        for size in (0, 3, 40, 400):
            for _ in range(8):
                a = "".join(r.choices(letters, k=size))
                b = r.choice([_edited(r, a, 8), "".join(r.choices(letters, k=size))])
                assert matched_size(a, b) == sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()), (a, b)


def test_matched_chars_of_long_texts_that_differ(spark):
    """Pages whose text differs from the reference a little: a second or more each if every block is looked for among all pairs of characters."""
    r = random.Random(6)
    words = ["".join(r.choices("etaoinshrdlu", k=r.randint(2, 9))) for _ in range(900)]
    texts = [" ".join(r.choices(words, k=1200)) for _ in range(40)]
    d = spark.createDataFrame([(x, _edited(r, x, 30)) for x in texts], "a string, b string").select(ev.matched_chars("a", "b").alias("n"), F.length("a").alias("of"))
    t = time.time()
    assert d.where("n < 0.9 * of or n > of").count() == 0
    assert time.time() - t < 20
