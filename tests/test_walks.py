import pytest

from folio.operators import catalog, content, dom, graph, metadata, navigation, walks

STORY = "风吹过原野，他听见声音。" * 40


def ch(title, links):
    return f"<h1>{title}</h1><div><p>{title}{STORY}</p></div>" + "".join(f"<a href='{h}'>{t}</a>" for t, h in links)


PAGES = [
    (1, "http://h/b/1.html", ch("第1章（第1页）", [("下一页", "1_2.html"), ("下一章", "1_2.html"), ("目录", "list.html")])),
    (2, "http://h/b/1_2.html", ch("第1章（第2页）", [("下一章", "2.html"), ("上一页", "1.html")])),
    (3, "http://h/b/2.html", ch("第2章 起", [("下一章", "3.html"), ("上一章", "1.html")])),
    (4, "http://h/b/3.html", ch("第3章 承", [("下一章", "4.html"), ("上一章", "2.html")])),
    (5, "http://h/b/4.html", ch("第4章 转", [("上一章", "3.html")])),
    (6, "http://h/b/list.html", "".join(f"<li><a href='{i}.html'>第{i}章</a></li>" for i in range(1, 9)) + "<a href='list_2.html'>下一页</a>"),
    (7, "http://h/b/list_2.html", "".join(f"<li><a href='{i}.html'>第{i}章</a></li>" for i in range(9, 17))),
]


@pytest.fixture(scope="module")
def t(spark):
    p = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    d = dom.dom(p).cache()
    return p, d, navigation.best_links(navigation.link_scores(dom.anchors(d), p)).cache(), metadata.page_title(d)


def test_chapter_pages(spark, t):
    p, d, links, titles = t
    steps = walks.chapter_steps(links, p, titles)
    assert {(r["src"], r["dst"], r["why"]) for r in steps.collect()} == {(1, 2, "NEXT_PAGE")}
    texts = content.pick_content(d).select("page_id", "text")
    got = {r["start"]: r for r in walks.merge_pages(p.where("page_id <= 3"), steps, texts).collect()}
    assert got[1]["pages"] == [1, 2] and got[1]["n_pages"] == 2 and not got[1]["repeats"] and got[3]["n_pages"] == 1


def test_lists(t):
    p, d, links, _ = t
    assert [tuple(r) for r in walks.list_steps(links, p).collect() if r["src"] == 6] == [(6, 7)]
    a = dom.anchors(d)
    types = content.page_types(content.page_features(d))
    assert {(r["page_id"], r["catalog_id"], r["rank"]) for r in walks.find_catalog(a, p, types, catalog.detect(a)).collect()} == {(1, 6, 1)}
    assert walks.explore(a, p, types, catalog.detect(a)).count() == 1


def test_traverse_and_reciprocal(t):
    p, _, links, _ = t
    got = {r["key"]: r["rank"] for r in walks.traverse(links, p).collect()}
    assert got[3] < got[4] < got[5]
    assert {tuple(r) for r in walks.reciprocal(links, p).collect()} == {(3, 4), (4, 5)}


def test_fill_gaps(spark, t):
    p, _, links, titles = t
    o = spark.createDataFrame([(7, 1, "http://h/b/2.html", 2.0), (7, 2, "http://h/b/4.html", 4.0), (7, 3, "http://h/b/none", 9.0)], "book_id bigint, pos int, norm_url string, number double")
    assert [tuple(r) for r in walks.fill_gaps(o, links, p, titles).collect()] == [(7, 1, 1, 4, "第3章 承")]


def test_literal_loaders(spark):
    html = "<script>var host='/data/'; function load(id){ var s=document.createElement('script'); s.src = host + 'x/' + id + '.js'; }</script><a href='/1'>第1章</a><a href='javascript:;' onclick=\"load('7')\">展开</a><a href='/9'>第9章</a>"
    assert walks.resolve_literal(html, "load", "7") == "/data/x/7.js"
    assert walks.resolve_literal("function f(a){ u(atob('L3g=') + a) }", "f", "1") == "/x1"
    assert walks.resolve_literal("function f(a){ u(b(a) + a) }", "f", "1") is None
    assert walks.resolve_literal(None, "f", "1") is None
    p = spark.createDataFrame([(1, "http://h/b/", html)], "page_id bigint, url string, html string")
    pay = spark.createDataFrame([("http://h/data/x/7.js", "cb({\"h\":\"<a href='/2'>第2章</a>\"})")], "url string, text string")
    got = walks.expand(catalog.collapsed_markers(dom.dom(p)), p, pay).collect()
    assert [(r["after_href"], r["title"], r["url"]) for r in got] == [("/1", "第2章", "http://h/2")]


def test_resolved_lists(spark):
    item = lambda i: f"<li><a href='c{i}.html'>第{i}章 风{i}</a></li>"
    body = lambda a, b, nxt: "<html><body><ul>" + "".join(item(i) for i in range(a, b)) + "</ul>" + (f"<a href='{nxt}'>下一页</a>" if nxt else "") + "</body></html>"
    html = {"index_1.html": body(1, 8, "index_2.html"), "index_2.html": body(8, 15, "index_3.html"), "index_3.html": body(15, 20, "index_1.html"), "other/index_1.html": body(1, 7, "index_2.html")}
    pages = spark.createDataFrame([(i, f"http://h/b/{u}", h) for i, (u, h) in enumerate(html.items(), 1)], "page_id bigint, url string, html string")
    a = dom.anchors(dom.dom(pages)).cache()
    links = navigation.best_links(navigation.link_scores(a, pages)).cache()
    starts = pages.where("page_id IN (1, 4)").select("page_id")
    # back to the first page on better evidence than a falling page number
    round_ = links.where("page_id <> 3").unionByName(spark.createDataFrame([(3, "NEXT_PAGE", "http://h/b/index_1.html", 0.9)], "page_id bigint, relation string, target string, score double"))
    assert {r["stopped_by"] for r in walks.list_walks(starts, links, pages).where("pos = 3").collect()} == {"no_next"}
    w = {(r["start"], r["pos"]): (r["page"], r["stopped_by"]) for r in walks.list_walks(starts, round_, pages).collect()}
    assert w == {(1, 1): (1, None), (1, 2): (2, None), (1, 3): (3, "loop"), (4, 1): (4, "not_captured")}
    assert {r["stopped_by"] for r in walks.list_walks(starts, links, pages, 2).where("pos = 2").collect()} == {"max_pages"}
    cut = links.where("page_id <> 3")
    e = walks.resolved_lists(a, pages, cut).collect()
    assert [r["title"] for r in sorted(e, key=lambda r: r["dom_index"]) if r["book_id"] == 1] == [f"第{i}章 风{i}" for i in range(1, 20)]
    assert sum(r["book_id"] == 4 for r in e) == 6 and {r["book_id"] for r in e} == {1, 4}
    assert walks.resolved_lists(a.limit(0), pages, cut).count() == 0


def test_cycle_paths(spark):
    e = spark.createDataFrame([(5, 3, 1.0), (3, 9, 1.0), (9, 5, 1.0), (1, 3, 1.0), (20, 21, 1.0), (21, 20, 1.0), (7, 8, 1.0)], "src bigint, dst bigint, confidence double")
    assert sorted(map(tuple, graph.cycle_paths(e).collect())) == [(3, 0, 3), (3, 1, 9), (3, 2, 5), (20, 0, 20), (20, 1, 21)]


def test_literal_addresses():
    html = "<script>var cb = 'x'; function load(id){ s.src = '/d/' + base64(id) + '?c=' + cb; } function other(id){ get(window.atob('L2Qv') + id + '.js') } function hard(id){ go(f(id) + g) }</script>"
    assert walks.resolve_literal(html, "load", "7") == "/d/Nw==?c=x"
    assert walks.resolve_literal(html, "other", "7") == "/d/7.js"
    assert walks.resolve_literal(html, "hard", "7") is None and walks.resolve_literal(html, "none", "7") is None and walks.resolve_literal(None, "load", "7") is None
