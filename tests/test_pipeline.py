import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from folio.plans import catalogue, pipeline
from folio.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_book(spark):
    t0 = dt.datetime(2025, 1, 1)
    story = "他走进镇子，看见灯火。" * 40
    pages = spark.createDataFrame([(i, f"http://h/b/{i}.html", 200, f"<h1>第{i}章</h1><p>{story}</p>", None, t0, t0) for i in (1, 2, 4)], "page_id bigint, url string, status_code int, html string, headers map<string,string>, received_at timestamp, captured_at timestamp")
    entries = spark.createDataFrame([(i, 7, f"第{i}章", f"http://h/b/{i}.html", 10 - i) for i in (1, 2, 3, 4)], "entry_id bigint, book_id bigint, title string, url string, dom_index int")
    texts = spark.createDataFrame([(i, f"第{i}章\n{story}") for i in (1, 2, 4)], "page_id bigint, text string")
    c = {r["pos"]: r for r in pipeline.book_chapters(entries, pages, texts).collect()}
    assert [c[i]["title"] for i in (1, 2, 3, 4)] == ["第1章", "第2章", "第3章", "第4章"]
    assert [c[i]["status"] for i in (1, 2, 3, 4)] == ["CONTENT_OK", "CONTENT_OK", "NOT_CAPTURED", "CONTENT_OK"]
    book = pipeline.export_books(pipeline.book_chapters(entries, pages, texts)).collect()[0]["text"]
    assert book.count("他走进镇子") == 120 and "NOT_CAPTURED" in book
    g = pipeline.diagnose(entries).collect()[0]
    assert (g["n"], g["missing"], g["orphans"], g["broken"]) == (4, 0, 0, False)
    a = {r["page_id"]: r for r in pipeline.analyze(pages).collect()}
    assert a[1]["content"]["preview"].startswith("第1章")


#: Queries over the links of the captured pages, which have none of these kinds.
EMPTY = {"nav_captured", "collapsed_lists", "catalog_page_find", "graph_cycles_captured"}
SMALL = {"boilerplate_blocks", "graph_cycles", "duplicate_content_pages"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_runs(spark, name):
    """Every query gives rows, and none where the data hold no case."""
    df = catalogue.queries()[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    n = df.count()
    assert n == 0 if name in EMPTY else n > 0 or name in SMALL


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pushdown(spark):
    from folio.util import table

    plan = table(spark, SF, "fetched_pages").where("page_id > 5").select("url")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(page_id), GreaterThan(page_id,5)]" in plan and "html" not in plan


def test_streams(spark, tmp_path):
    t0 = dt.datetime(2025, 1, 1)
    rows = [(i % 5, "h", t0 + dt.timedelta(minutes=i), i % 3 == 0) for i in range(20)]
    df = spark.createDataFrame(rows, "page_id bigint, host string, captured_at timestamp, shell boolean")
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    s = ingest.read_stream(spark, str(tmp_path / "in"), df.schema, 1)
    q = ingest.first_deliveries(s).writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*) from firsts").first()[0] == 5
    q = ingest.paced(s.select("host", "shell")).writeStream.format("memory").queryName("paced").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select max(backoffs) from paced").first()[0] == sum(r[3] for r in rows)
    q = ingest.host_windows(s).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c3")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from windows").select(F.col("sum(n)")).first()[0] == 20


def test_book_stages(spark):
    """Pages of one chapter, a gap, a fold, parts, a recurring block and a book without a list."""
    t0 = dt.datetime(2025, 1, 1)
    story = "他走进镇子，看见灯火。" * 40
    note = "本站所有内容由会员上传，" * 8
    link = lambda *xs: "".join(f"<a href='{h}'>{t}</a>" for t, h in xs)
    page = lambda title, text, *xs: f"<h1>{title}</h1><div><p>{text}</p></div>" + link(*xs)
    fold = "<script>function load(id){ get('/d/' + id + '.js') }</script><a href='/b/5.html'>第5章</a><a href='javascript:;' onclick=\"load('7')\">展开全部</a><a href='/b/7_1.html'>第7章 1</a>"
    html = {
        "/b/1.html": page("第1章（第1页）", "甲" + story, ("下一页", "1_2.html")), "/b/1_2.html": page("第1章（第2页）", "乙" + story, ("下一章", "2.html")),
        "/b/2.html": page("第2章", story, ("下一章", "3.html")), "/b/3.html": page("第3章", "丙" + story, ("下一章", "4.html")), "/b/4.html": page("第4章", story, ("下一章", "5.html")), "/b/5.html": page("第5章", story),
        "/d/7.js": "cb({\"h\":\"<a href='/b/6.html'>第6章</a>\"})", "/b/6.html": page("第6章", "丁" + story), "/b/7_1.html": page("第7章 1", "戊" + story), "/b/7_2.html": page("第7章 2", "己" + story), "/b/toc": fold,
        "/w/1": page("第1章", "庚" + story, ("下一章", "/w/2")), "/w/2": page("第2章", "辛" + story, ("上一章", "/w/1")),
    }
    ids = {u: i for i, u in enumerate(html, 1)}
    pages = spark.createDataFrame([(ids[u], f"http://h{u}", 200, h, None, t0, t0) for u, h in html.items()], "page_id bigint, url string, status_code int, html string, headers map<string,string>, received_at timestamp, captured_at timestamp")
    listed = [("第1章", "/b/1.html"), ("第2章", "/b/2.html"), ("第4章", "/b/4.html"), ("第5章", "/b/5.html"), ("第7章 1", "/b/7_1.html"), ("第7章 2", "/b/7_2.html")]
    entries = spark.createDataFrame([(i, 7, t, f"http://h{u}", "http://h/b/toc", i) for i, (t, u) in enumerate(listed)], "entry_id bigint, book_id bigint, title string, url string, source_page_url string, dom_index int")
    first = {"/b/1.html": "甲", "/b/1_2.html": "乙", "/b/3.html": "丙", "/b/6.html": "丁", "/b/7_1.html": "戊", "/b/7_2.html": "己"}
    texts = spark.createDataFrame([(ids[u], f"{first.get(u, '')}{story}{u}\n\n{note}") for u in html if u.startswith("/b/") and u != "/b/toc"], "page_id bigint, text string")
    rows = pipeline.finished_chapters(entries, pages, texts).collect()
    c = {r["pos"]: r for r in rows if r["book_id"] == 7}
    assert [c[i]["title"] for i in sorted(c)] == ["第1章", "第2章", "第3章", "第4章", "第5章", "第6章", "第7章"]
    assert "甲" in c[1]["content"] and "乙" in c[1]["content"] and "丙" in c[3]["content"] and "丁" in c[6]["content"] and "戊" in c[7]["content"] and "己" in c[7]["content"]
    assert not any(note in r["content"] for r in rows) and {r["status"] for r in rows} == {"CONTENT_OK"}
    w = {r["pos"]: r for r in rows if r["book_id"] == -ids["/w/1"]}
    assert "庚" in w[1]["content"] and "辛" in w[2]["content"] and len(rows) == 9


def test_graph_cycles_of_captured_links(spark, tmp_path):
    p = [(i, f"http://h/{i}", f"<h1>第{i}章</h1><a href='/{n}'>下一章</a>") for i, n in ((1, 2), (2, 3), (3, 2), (4, 5))]
    spark.createDataFrame(p, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "fetched_pages.parquet"))
    assert {r["key"] for r in catalogue.graph_cycles_captured(spark, str(tmp_path)).collect()} == {2, 3}
