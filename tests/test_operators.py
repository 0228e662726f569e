import random
import time

import pytest
from pyspark.sql import functions as F

from folio.operators import catalog, chapters, content, dom, evaluate, graph, metadata, navigation, profiles
from folio.sources import captures, export

STORY = "他走进镇子，看见灯火。" * 30


def chapter_page(n, extra=""):
    return (
        f"<html><head><title>第{n}章 风_书名 - 某站</title></head><body><nav><a href='/'>首页</a> &gt; <a href='/b/'>书</a></nav><div id=wrap><div class=c><h1>第{n}章 风</h1>"
        + "".join(f"<p>{STORY}" for _ in range(3)) + f"{extra}</div><div><a href='c{n - 1}.html'>上一章</a> <a href='./'>目录</a> <a href='c{n + 1}.html'>下一章</a></div></div></body></html>"
    )


CATALOG = "<html><body><h1>书名</h1><ul>" + "".join(f"<li><a href='/b/c{i}.html'>第{i}章 风{i}</a>" for i in range(1, 41)) + "</ul><p><a href='index_2.html'>下一页</a> <a href='index_3.html'>3</a></body></html>"
BOOK = "<html><head><meta property='og:novel:book_name' content='风之书'><meta name=description content='讲风'><script type='application/ld+json'>{\"@type\":\"Book\",\"name\":\"风书\",\"author\":{\"name\":\"李\"}}</script></head><body><h1>风之书</h1><p>作者：王五</p><p>" + "内容简介，讲一个人。" * 30 + "</p></body></html>"
PAGES = [
    (1, "http://h.x/b/c3.html", chapter_page(3)), (2, "http://h.x/b/index_1.html", CATALOG), (3, "http://h.x/b/", BOOK), (4, "http://h.x/e", ""), (5, "http://h.x/n", None), (6, None, "<p>x<p>y<br>z<!-- c --><script>q</script>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id bigint, url string, html string")


@pytest.fixture(scope="module")
def d(pages):
    return dom.dom(pages).cache()


def by_id(df):
    return {r["page_id"]: r for r in df.collect()}


def test_dom(d):
    got = by_id(d)
    assert set(got) == {1, 2, 3, 4, 6}
    assert got[2]["tags"]["li"] == 40 and len(got[2]["anchors"]) == 42
    assert len({a["p2"] for a in got[2]["anchors"][:40]}) == 1
    assert got[6]["lines"] == ["x", "y", "z c"] and (got[6]["nodes"][0]["line_from"], got[6]["nodes"][0]["n_lines"]) == (0, 3) and got[6]["page_text"] == "x y z"
    assert got[1]["breadcrumb"] == ["首页", "书"]
    assert dom.lines(d).where("page_id = 6").count() == 3


def test_parsing_is_linear():
    for html in ("<body>" + "<div>some text here</div>" * 8000, "<body>" + "<div>x" * 8000):
        t = time.time()
        r = dom.record(1, html)
        assert len(r["nodes"]) == 8001 and time.time() - t < 1
    assert {x["sibling_len"] for x in dom.record(1, "<body><div>abcd</div><div>ab</div><div>abc</div></body>")["nodes"] if x["tag"] == "div"} == {3, 4}


def test_implied_ends():
    nodes = dom.parse("<table><tr><td>a<td>b<tr><td>c</table><ul><li>x<ul><li>y</ul><li>z</ul><dl><dt>k<dd>v</dl>")
    tags = [(n.tag, n.parent.tag) for n in nodes[1:]]
    assert tags.count(("td", "tr")) == 3 and tags.count(("tr", "table")) == 2
    assert [n.depth for n in nodes if n.tag == "li"] == [2, 4, 2]


def test_content_and_types(d):
    picked = content.pick_content(d)
    got = by_id(picked)
    assert got[1]["anchored"] and got[1]["tag"] == "div" and got[1]["text"].startswith("第3章 风\n他走进") and "下一章" not in got[1]["text"]
    assert got[4]["text"] == "" and got[4]["confidence"] == 0.0
    assert got[6]["confidence"] == 0.35
    types = by_id(content.page_types(content.page_features(d)))
    assert {i: types[i]["page_type"] for i in (1, 2, 3, 4)} == {1: "CHAPTER_PAGE", 2: "CATALOG_PAGE", 3: "BOOK_PAGE", 4: "UNKNOWN"}
    deep = by_id(content.deep_confidence(picked))
    assert 0.2 <= deep[6]["confidence"] <= 0.95


def test_status(spark):
    rows = [(404, "", "", 900), (401, "", "", 0), (503, "cloudflare", "", 0), (403, "", "checking your browser", 0), (403, "", "", 0), (200, "", "请先登录", 100), (200, "", "请先登录", 900), (200, "", "", 0), (200, "", "", 150), (200, "", "", 300), (200, "", "", 900)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, code int, server string, html string, n int")
    st = content.access_status(F.col("code"), F.col("server"), F.col("html"), F.col("html"), F.repeat(F.lit("x"), F.col("n")), F.lit(0.8), F.lit(2000))
    got = [(r["s"]["status"], round(r["s"]["confidence"], 2)) for r in df.select("i", st.alias("s")).orderBy("i").collect()]
    assert got == [
        ("NOT_FOUND", 0.95), ("LOGIN_REQUIRED", 0.8), ("ANTI_BOT", 0.8), ("ANTI_BOT", 0.8), ("ACCESS_RESTRICTED", 0.7), ("LOGIN_REQUIRED", 0.8), ("CONTENT_OK", 0.8), ("EMPTY_CONTENT", 0.85), ("EMPTY_CONTENT", 0.7), ("EMPTY_CONTENT", 0.55), ("CONTENT_OK", 0.8),
    ]


def test_combine(spark):
    df = spark.createDataFrame([("a" * 100, 0.6, None, None, False), ("a" * 100, 0.6, "a" * 100, 0.9, False), ("a" * 100, 0.6, "b" * 400, 0.1, False), ("a" * 100, 0.6, "b" * 400, 0.1, True)], "d string, c double, b string, r double, k boolean")
    got = [r[0]["confidence"] for r in df.select(content.combine(F.col("d"), F.col("c"), F.col("b"), F.col("r"), F.col("k"))).collect()]
    assert got == [0.6, pytest.approx(0.7), 0.7, 0.6]


def test_metadata(d):
    got = by_id(metadata.metadata(d))
    assert (got[3]["book_title"], got[3]["title_source"], got[3]["author"], got[3]["author_source"]) == ("风书", "json_ld", "李", "json_ld")
    assert got[3]["description"] == "讲风" and got[1]["title_source"] == "h1" and got[6]["book_title"] is None
    assert by_id(metadata.page_title(d))[1]["page_title"] == "第3章 风"


def test_links(d, pages):
    got = {(r["page_id"], r["relation"]): (r["target"], round(r["score"], 2)) for r in navigation.best_links(navigation.link_scores(dom.anchors(d), pages)).collect()}
    assert got[(1, "NEXT_CHAPTER")] == ("http://h.x/b/c4.html", 0.72) and got[(1, "PREVIOUS_CHAPTER")][0] == "http://h.x/b/c2.html"
    assert got[(1, "CATALOG_LINK")][0] == "http://h.x/b/" and got[(2, "NEXT_PAGE")] == ("http://h.x/b/index_2.html", 0.87)
    assert (2, "NEXT_CHAPTER") not in got


def test_fingerprints(spark, d, pages):
    f = navigation.fingerprints(d, metadata.metadata(d), pages)
    same = f.where("page_id = 1").select(F.struct("*").alias("a"), F.struct("*").alias("b")).select(navigation.compare("a", "b").alias("c")).collect()[0]["c"]
    assert same["verdict"] == "SAME_BOOK" and same["similarity"] == pytest.approx(1.0)
    m = spark.sql("select map('a', 2, 'b', 1) x, map('a', 1, 'c', 1) y, array('p','q') p, array('q') q, cast(array() as array<string>) e")
    r = m.select(navigation.multiset_jaccard(F.col("x"), F.col("y")), navigation.jaccard(F.col("p"), F.col("q")), navigation.jaccard(F.col("p"), F.col("e"))).collect()[0]
    assert list(r) == [0.25, 0.5, 0.0]


def test_relation(spark):
    rows = [(1.0, 1.0, 1.0, 1.0, 1.0), (None, None, None, None, None), (0.0, 0.0, None, 0.0, 1.0), (None, None, 1.0, 0.1, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n double, r double, c double, k double, s double")
    got = [r["x"] for r in df.select("i", navigation.relation(*map(F.col, "nrcks")).alias("x")).orderBy("i").collect()]
    assert [g["direction"] for g in got] == ["A_BEFORE_B", "UNKNOWN", "B_BEFORE_A", "UNKNOWN"]
    assert got[0]["confidence"] == pytest.approx(1.0)


def entries(spark, lists):
    rows, k = [], 0
    for book, ts in lists.items():
        for i, t in enumerate(ts):
            k += 1
            rows.append((k, book, t, f"http://h/{book}/{i}", i))
    return spark.createDataFrame(rows, "entry_id bigint, book_id bigint, title string, url string, dom_index int")


def test_catalog_order(spark):
    e = entries(spark, {
        1: [f"第{i}章" for i in range(1, 9)], 2: [f"第{i}章" for i in range(9, 0, -1)], 3: [f"第{i}章" for i in (*range(16, 26), *range(1, 16))], 4: ["第1章", "第2章"], 5: ["第1章", "第5章", "第2章", "第9章", "第3章"], 6: ["序章", None, "x"],
    })
    got = {r["book_id"]: r for r in catalog.direction(e).collect()}
    assert {k: v["direction"] for k, v in got.items()} == {1: "ASCENDING", 2: "DESCENDING", 3: "ASCENDING", 4: "UNKNOWN", 5: "UNKNOWN"}
    r = {(x["book_id"], x["pos"]): x["new_pos"] for x in catalog.rotate(e).collect()}
    assert r[(3, 1)] == 16 and r[(3, 11)] == 1 and r[(1, 3)] == 3 and r[(5, 2)] == 2 and r[(6, 2)] == 2
    g = {(x["book_id"], x["lo"], x["hi"]) for x in catalog.gaps(e).collect()}
    assert g == {(5, 4, 4), (5, 6, 8)}
    assert catalog.rotate(e.limit(0)).count() == catalog.direction(e.limit(0)).count() == catalog.gaps(e.limit(0)).count() == 0


def test_clusters_and_detect(d):
    c = catalog.clusters(dom.anchors(d)).collect()
    assert [(r["page_id"], r["size"], r["score"], r["dominant_dir"]) for r in c if r["size"] >= 5] == [(2, 40, pytest.approx(0.65), "/b")]
    assert catalog.detect(dom.anchors(d)).where("page_id = 2").count() == 40


def test_keep_last_and_splice(spark):
    e = spark.createDataFrame([(1, 1, "a", "http://h/a", 0), (2, 1, "b", "http://h/b", 1), (3, 1, "a2", "http://h/a#x", 2), (4, None, "n", "http://h/n", 0), (5, 1, "z", None, 3)], "entry_id bigint, book_id bigint, title string, url string, dom_index int")
    k = catalog.keep_last(e)
    assert {(r["norm_url"], r["entry_id"]) for r in k.collect()} == {("http://h/a", 3), ("http://h/b", 2)}
    x = spark.createDataFrame([(1, "http://h/b", None, 1, "n1", "http://h/n1"), (1, "http://h/b", None, 2, "n2", "http://h/n2"), (1, "http://h/none", None, 1, "lost", "u")], "book_id bigint, after_url string, before_url string, seq int, title string, url string")
    assert [r["title"] for r in catalog.splice(k, x).orderBy("pos").collect()] == ["b", "n1", "n2", "a2"]


def test_collapsed(spark):
    html = "<a href='/1'>第1章</a><a href=\"javascript:void(0)\" onclick=\"load('7')\">展开全部</a><a href='/9'>第9章</a>"
    m = catalog.collapsed_markers(dom.dom(spark.createDataFrame([(1, html)], "page_id bigint, html string"))).collect()[0]
    assert (m["fn"], m["arg"], m["after_href"], m["before_href"]) == ("load", "7", "/1", "/9")
    df = spark.createDataFrame([('cb({"n":"1","html":"<a href=\'/2\'>第2章</a><a href=/3>第3章</a>"});',), ("<a href='/4'>x</a>",), ("",)], "p string")
    got = [[tuple(x) for x in r[0]] for r in df.select(catalog.fragment_entries(F.col("p"))).collect()]
    assert got == [[("第2章", "/2"), ("第3章", "/3")], [("x", "/4")], []]


def test_chapters(spark):
    c = spark.createDataFrame([(1, i, f"第{n}章 {s}", float(n), s) for i, (n, s) in enumerate([(1, None), (6, 1), (6, 2), (6, 3), (7, 1), (7, 1), (8, None)], 1)], "book_id bigint, pos int, title string, number double, sub_number int")
    got = [(r["first_pos"], r["n_parts"]) for r in chapters.merge_parts(c).orderBy("first_pos").collect()]
    assert got == [(1, 1), (2, 3), (5, 1), (6, 1), (7, 1)]
    m = spark.createDataFrame([("k", i, n) for i, n in enumerate([500, 100, 1500, 800, 900])], "k string, i int, n bigint")
    assert [r["median_prev"] for r in chapters.running_median(m, "k", ["i"], "n", F.col("n") >= 200).orderBy("pos").collect()] == [None, 500, 500, 1000, 800]
    f = spark.createDataFrame([("a", i, x) for i, x in enumerate("011011111")] + [("b", 0, "1")], "k string, i int, x string")
    assert [tuple(r) for r in chapters.failure_cut(f, "k", ["i"], F.col("x") == "1").collect()] == [("a", 9)]


def test_blocks(spark):
    note = "本站所有内容由会员上传，" * 8
    rows = [(1, i, f"正文{i}。\n\n{note}\n\n尾{i}") for i in range(4)] + [(2, 9, note), (1, 50, note), (None, 51, note), (1, 52, None)]
    df = spark.createDataFrame(rows, "book bigint, doc bigint, text string")
    got = {r["doc"]: r for r in chapters.remove_recurrent(df, "book", "doc", "text").collect()}
    assert got[0]["text"] == "正文0。\n\n尾0" and got[50]["emptied"] and got[9]["text"] == note and got[52]["text"] is None and len(got) == 8
    dup = spark.createDataFrame([("h", 1, "x" * 300), ("h", 2, " x" * 300), ("g", 3, "x" * 300), ("h", 4, "y")], "h string, p bigint, t string")
    assert [tuple(r)[2:] for r in chapters.duplicate_texts(dup, "h", "p", "t").collect()] == [(2, 1)]


@pytest.mark.parametrize("share", [200_000, 3])
def test_pacing(spark, monkeypatch, share):
    monkeypatch.setattr(chapters, "SHARE", share)
    df = spark.createDataFrame([("a", i, x == "s") for i, x in enumerate("sssssoooooo")] + [("b", 0, False), (None, 0, True)], "k string, i int, s boolean")
    got = {r["k"]: r for r in chapters.pacing(df, "k", ["i"], F.col("s")).collect()}
    assert got["a"]["interval"] == 2.5 and got["a"]["backoffs"] == 5 and got["b"]["streak"] == 1 and len(got) == 2


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.5), ("b", "c", 0.9), ("c", "d", 0.9), ("x", "y", 0.9), ("y", "z", 0.9), ("z", "x", 0.9), ("w", "x", 0.9), ("q", "q", 1.0), (None, "a", 1.0)], "src string, dst string, confidence double")
    n = spark.createDataFrame([(k,) for k in "abcdxyzwq"], "key string")
    got = {r["key"]: r for r in graph.reading_order(n, e).collect()}
    assert [(got[k]["head"], got[k]["rank"]) for k in "abcd"] == [("a", 0), ("a", 1), ("a", 2), ("a", 3)]
    assert got["q"]["rank"] == 0 and {r["key"] for r in graph.on_cycles(e).collect()} == {"x", "y", "z"}
    ends = {r["key"]: r for r in graph.ends(n, graph.known_edges(e, n)).collect()}
    assert ends["q"]["is_orphan"] and ends["a"]["is_head"] and ends["d"]["is_tail"]
    long = spark.createDataFrame([(i, i + 1, 1.0) for i in range(500)], "src bigint, dst bigint, confidence double")
    keys = spark.createDataFrame([(i,) for i in range(501)], "key bigint")
    assert {(r["key"], r["rank"]) for r in graph.reading_order(keys, long).collect()} == {(i, i) for i in range(501)}
    c = spark.createDataFrame([(1, ["p", "q"]), (2, ["q"]), (3, ["z"])], "seq int, source_pages array<string>")
    assert [tuple(r) for r in graph.duplicates(c).collect()] == [(2, 1)]
    steps = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    assert [(r["pos"], r["page"]) for r in graph.walk_pages(spark.createDataFrame([("a",)], "page string"), steps).orderBy("pos").collect()] == [(1, "a"), (2, "b"), (3, "c")]


def test_evaluate(spark):
    s = spark.createDataFrame([("m", "a", 1, 2), ("m", "b", 1, 2), ("z", "a", 0, 0)], "metric string, suite string, numerator bigint, denominator bigint")
    got = {(r["metric"], r["level"], r["suite"]): r["value"] for r in evaluate.roll_up(s, ["suite"]).collect()}
    assert got[("m", "overall", None)] == 0.5 and got[("z", "overall", None)] is None and got[("m", "suite", "a")] == 0.5
    assert {r["metric"]: r["value"] for r in evaluate.gate(s).collect()} == {"m": 0.5, "z": 1.0}
    c = evaluate.confusion(spark.createDataFrame([("x", "y"), ("x", "x")], "expected string, predicted string"), ["x", "y"]).collect()
    assert {r["expected"]: (r["x"], r["y"]) for r in c} == {"x": (1, 1), "y": (0, 0)}
    f = evaluate.failure_counts(spark.createDataFrame([("FETCH_ERROR", "c1")], "category string, case_id string")).collect()
    assert len(f) == 22 and sum(r["n"] for r in f) == 1
    p = {r["metric"]: r["value"] for r in evaluate.precision_recall(spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,), (3,), (4,)], "k int"), ["k"]).collect()}
    assert p == {"precision": 0.5, "recall": pytest.approx(1 / 3)}
    t = spark.createDataFrame([("abcd", "abxd"), (None, "a")], "a string, b string").select(evaluate.matched_chars(F.col("a"), F.col("b")), content.agreement(F.col("a"), F.col("b"))).collect()
    assert tuple(t[0]) == (3, 0.75) and t[1][0] is None
    v = spark.createDataFrame([(1,), (1,), (None,), (9,)], "k int")
    assert {r["problem"]: r["n"] for r in evaluate.violations(v, "k", [(spark.createDataFrame([(1,)], "j int"), "k", "j")]).collect()} == {"duplicate k": 1, "null k": 1, "dangling k": 1}
    k = spark.createDataFrame([("A", "A"), ("UNKNOWN", "A"), ("A", "UNKNOWN"), ("A", "B")], "e string, p string").select(evaluate.page_type_failure(F.col("e"), F.col("p"))).collect()
    assert [r[0] for r in k] == [None, "PAGE_TYPE_FALSE_POSITIVE", "PAGE_TYPE_FALSE_NEGATIVE", "PAGE_TYPE_WRONG_CLASS"]


def test_agreement_of_whole_texts(spark):
    """What follows the first 5000 characters counts."""
    a = "".join(chr(0x4E00 + i * 7 % 6000) for i in range(5500))
    b = a[:5200] + "".join(chr(0xAC00 + i) for i in range(300))
    t = spark.createDataFrame([(a, b)], "a string, b string").select(content.agreement(F.col("a"), F.col("b"))).first()
    assert t[0] == pytest.approx(5200 / 5500)


def test_text_agreement_broadcasts_no_texts(spark, tmp_path):
    """The estimate of the parsed side says nothing of its texts: however small, they don't pass through the driver."""
    from folio.plans import catalogue

    spark.createDataFrame([(1, "<html><body><div>" + "他走进镇子，看见灯火。" * 10 + "</div></body></html>"), (2, None)], "page_id bigint, html string").write.parquet(f"{tmp_path}/fetched_pages.parquet")
    spark.createDataFrame([(1, "他走进镇子，看见灯火。" * 10), (3, "x")], "page_id bigint, text string").write.parquet(f"{tmp_path}/content_extractions.parquet")
    d = catalogue.text_agreement(spark, str(tmp_path))
    assert [tuple(r) for r in d.collect()] == [(1, 1.0)]
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_profiles(spark):
    p = spark.createDataFrame([("h", "http://h/b/1.html", "第1章 风_书", ["首页", "书"]), ("h", "http://h/b/2.html", "第2章 风_书", ["首页"]), (None, "u", "t", [])], "host string, url string, title string, nav array<string>")
    b = profiles.build(p).collect()
    assert len(b) == 1 and b[0]["chapter_dir"] == "/b" and b[0]["nav_texts"] == ["首页", "书"] and "第#章" in b[0]["title_template"]
    r = p.select(profiles.check(F.col("title"), F.col("url"), F.array(F.lit("书")), F.lit("/x")).alias("c")).collect()
    assert r[0]["c"] == 0.5
    a, n = spark.createDataFrame([("h", 1), ("g", 1)], "host string, v int"), spark.createDataFrame([("h", 2)], "host string, v int")
    assert {tuple(x) for x in profiles.upsert(a, n).collect()} == {("h", 2), ("g", 1)}


def test_captures(spark, tmp_path):
    c = spark.createDataFrame([(1, "http://h/a", None, 1), (2, "http://h/a#f", 5, 2), (3, None, 1, 1)], "page_id bigint, url string, received_at int, captured_at int")
    assert [(r["norm_url"], r["page_id"]) for r in captures.latest(c).collect()] == [("http://h/a", 2)]
    q = captures.answer(spark.createDataFrame([("http://h/a",), ("http://h/zz",)], "url string"), c).collect()
    assert {r["url"]: r["out_of_scope"] for r in q} == {"http://h/a": False, "http://h/zz": True}
    a = captures.best_attempt(spark.createDataFrame([("u", 1, "EMPTY"), ("u", 2, "CONTENT_OK"), ("u", 3, "CONTENT_OK"), ("w", 1, "EMPTY")], "url string, attempt int, status string")).collect()
    assert {r["url"]: r["attempt"] for r in a} == {"u": 2, "w": 1}
    p = captures.prefer_rendered(spark.createDataFrame([("u", "short")], "url string, html string"), spark.createDataFrame([("u", "rendered")], "url string, html string")).collect()
    assert p[0]["html"] == "rendered" and p[0]["escalated"]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.html").write_bytes(b"x")
    assert [r["url"] for r in captures.read_files(spark, str(tmp_path)).collect()] == ["http://s/a.html"]
    (tmp_path / "case.json").write_text('{"case":{"case_id":"c","annotation_status":"READY","pages":[{"page_id":"1","requested_url":"http://h","input_sha256":"' + "a" * 64 + '"},{"page_id":"1","requested_url":"ftp","input_sha256":"a"}]}}')
    r = sorted(captures.read_case(spark, str(tmp_path / "case.json")).collect(), key=lambda x: len(x["errors"]))
    assert len(r) == 2 and "page_id repeated or missing" in r[0]["errors"] and "no http url" in r[1]["errors"]
    h = spark.createDataFrame([("http://H/a", "h"), ("http://g/a", "h"), ("x", "h")], "u string, h string").select(captures.allowed(F.col("u"), F.col("h"))).collect()
    assert [x[0] for x in h] == [True, False, False]


def test_export(spark, tmp_path):
    c = spark.createDataFrame([(1, 1, "第1章", "CONTENT_OK", "文", ["u"]), (1, 2, "第2章?", "PAYWALL", "半", ["u"]), (1, 3, None, "NOT_FOUND", None, ["u", "w"])], "book_id bigint, pos int, title string, status string, content string, pages array<string>")
    b = c.withColumn("body", export.body(F.col("status"), F.col("content"), F.col("pages")))
    bodies = [r["body"] for r in b.orderBy("pos").collect()]
    assert bodies[0] == "文" and bodies[1].startswith("半\n\n【本章状态：PAYWALL") and "u , w" in bodies[2]
    assert export.write_chapters(b, str(tmp_path / "out")) == ["0001 第1章.txt", "0002 第2章_.txt", "0003 _.txt"]
    m = export.merged(b).collect()[0]["text"]
    assert m.startswith("第1章\n\n文\n") and m.index("第1章") < m.index("第2章")
    assert export.write_epub(b, str(tmp_path / "b.epub"), "书") == 3
    export.write_books(export.merged(b), str(tmp_path / "books"))
    assert {(r["status"], r["n"]) for r in export.summary(b).collect()} == {("CONTENT_OK", 1), ("PAYWALL", 1), ("NOT_FOUND", 1)}


def test_long_books_are_whole(spark, monkeypatch):
    import random
    import statistics

    monkeypatch.setattr(chapters, "SHARE", 500)
    rnd = random.Random(1)
    rows = [("k", i, rnd.choice([5, rnd.randrange(300, 9000)])) for i in range(2100)] + [("j", 0, 400), ("j", 1, 1)]
    df = spark.createDataFrame(rows, "k string, i int, n bigint")
    assert {r["k"]: (r["c"], r["m"]) for r in chapters.in_order(df, "k", ["i"]).groupBy("k").agg(F.count("*").alias("c"), F.max("pos").alias("m")).collect()} == {"k": (2100, 2100), "j": (2, 2)}
    got = {(r["k"], r["pos"]): r["median_prev"] for r in chapters.running_median(df, "k", ["i"], "n", F.col("n") >= 200).collect()}
    assert len(got) == 2102 and got["j", 2] == 400
    for p in (1, 2, 500, 501, 1500, 2050, 2100):
        before = [n for k, i, n in rows if k == "k" and i < p - 1 and n >= 200]
        assert got["k", p] == (int(statistics.median(before)) if before else None)
    parts = spark.createDataFrame([(1, i + 1, f"第{i // 2}章", float(i // 2), i % 2 + 1) for i in range(2100)], "book_id bigint, pos int, title string, number double, sub_number int")
    assert chapters.merge_parts(parts).where("merged").count() == 1050
    nodes = parts.select("book_id", "pos", F.col("pos").alias("key"))
    assert graph.consecutive_edges(nodes, "book_id", "key", F.lit(True)).count() == 2099


def test_deep_rescans(spark):
    menu = "".join(f"<p><a href='/{i}'>频道{i}</a></p>" for i in range(9))
    story = "他走进镇子，看见灯火，听见远处的钟声。雪落在屋顶上，没有人说话。"
    assert 30 <= len(story) < 50
    df = spark.createDataFrame([(1, f"<body>{menu}<div>{story}</div></body>"), (2, f"<body>{menu}</body>")], "page_id bigint, html string")
    got = {r["page_id"]: r for r in content.deep_confidence(content.pick_content(dom.dom(df))).collect()}
    assert (got[1]["tag"], got[1]["text"]) == ("div", story) and got[1]["confidence"] > 0.35
    assert got[2]["tag"] == "body" and got[2]["confidence"] == 0.35


def test_classes_and_alike(spark):
    rng = random.Random(8)
    rows = [(rng.choice("gh"), i, sorted(rng.sample("abcdefgh", rng.randint(0, 8)))) for i in range(160)] + [("h", 500 + i, ["x", "y"]) for i in range(80)] + [(None, 1000, ["a"]), ("h", None, ["a"]), ("h", 1001, None)]
    df = spark.createDataFrame(rows, "k string, i bigint, m array<string>")
    sets = {}
    for k, i, m in rows:
        if k and i is not None and m is not None:
            sets.setdefault((k, tuple(m)), []).append(i)
    c = navigation.classes(df, "k", "i", "m").cache()
    assert {(r["doc"], r["class_id"], r["n_members"]) for r in c.collect()} == {(i, min(v), len(v)) for v in sets.values() for i in v}
    for least in (0.5, 0.8, 1.0):
        want = set()
        for (k, m), v in sets.items():
            for (k2, m2), v2 in sets.items():
                if k == k2 and min(v) < min(v2) and m and m2 and len({*m} & {*m2}) / len({*m} | {*m2}) >= least:
                    want.add((k, min(v), min(v2)))
        p = navigation.alike(c, least)
        assert {(r["key"], r["a_id"], r["b_id"]) for r in p.collect()} == want
    n = {r["doc"]: r["n_links"] for r in navigation.linked_classes(c, navigation.alike(c)).collect()}
    assert len(n) == 240 and n[500] == 0
    assert navigation.alike(c.limit(0)).count() == 0


def test_json_ld_in_lists_and_graphs(spark):
    ld = lambda x: f"<script type='application/ld+json'>{x}</script>"
    book = '{"@type":"Book","name":"风书","author":[{"name":"李"}]}'
    pages = spark.createDataFrame([(1, ld(f'[{{"@type":"WebSite","name":"站"}},{book}]')), (2, ld(f'{{"@graph":[{{"@type":"WebPage","name":"页"}},{book}]}}')), (3, ld("{broken") + ld(book)), (4, ld("[]"))], "page_id bigint, html string")
    got = by_id(metadata.metadata(dom.dom(pages)))
    assert [(got[i]["book_title"], got[i]["author"]) for i in (1, 2, 3, 4)] == [("风书", "李")] * 3 + [(None, None)]
