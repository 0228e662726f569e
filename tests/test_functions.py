from pyspark.sql import functions as F

from folio.functions import charset, textclean, titles, urls


def col(spark, values, name="t"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")


def apply(spark, values, fn):
    return [r["v"] for r in col(spark, values).select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]


def test_chinese_numerals(spark):
    values = ["十", "十五", "二十", "一百零四", "一百二十三", "一千零一", "一万二千", "两百", "一二三", "一万亿", "零", "", "abc", "十x", None]
    assert apply(spark, values, titles.chinese_numeral) == [10, 15, 20, 104, 123, 1001, 12000, 200, 3, 100010000, None, None, None, None, None]


def test_titles(spark):
    def parsed(t):
        p = titles.parse_title(t)
        return F.concat_ws("|", p["chapter_type"], p["chapter_number"], p["order_token"], p["confidence"], p["sub_number"])

    cases = {
        "第一章": "normal|1.0|1.0|0.95", "第12章 风": "normal|12.0|12.0|0.92", "【第3回】": "normal|3.0|3.0|0.95", "第６章：２": "normal|6.0|6.0002|0.92|2", "第六章(1)": "normal|6.0|6.0001|0.92|1",
        "第1.5章 2": "normal|1.5|1.5|0.92", "卷二 起": "volume|2.0|2.0|0.92", "第三卷": "volume|3.0|3.0|0.95", "Chapter 7: The Mill": "normal|7.0|7.0|0.92", "CHAPTER 7": "normal|7.0|7.0|0.95",
        "序章": "prologue|0.9", "番外二 新春": "extra|2.0|2.0|0.85", "番外 3": "extra|3.0|3.0|0.85", "番外篇：三人": "extra|0.85", "大结局": "epilogue|0.9", "他在第三章说": "normal|3.0|3.0|0.55", "第5章5年后": "normal|5.0|5.0|0.92",
        "hello": "", "": "", "目录": "", "第零章": "",
    }
    assert dict(zip(cases, apply(spark, list(cases), parsed), strict=True)) == cases
    assert apply(spark, [None], lambda t: titles.parse_title(t)["title"]) == [None]


def test_suffixes(spark):
    assert apply(spark, ["第6章 2", "第六章(1)", "第6章 风", " x "], titles.strip_sub_number) == ["第6章", "第六章", "第6章 风", "x"]
    assert apply(spark, ["第1章（第2页）", "风(2/3)", "风_2", "风", "风（1）(2/2)"], titles.strip_page_suffix) == ["第1章", "风", "风", "风", "风"]
    assert apply(spark, ["第1章（第2页）_书", "x (2/3)", "x_2", None], titles.has_page_marker) == [True, True, False, None]


def test_urls(spark):
    u = ["http://H.x:8/a/b.html?page=3#f", "http://h/a_2.html", "http://h/index.html", "http://h/456.html", "", None, "a/b/c.htm?p=12&q=1", "http://h"]
    assert apply(spark, u, urls.page_number) == [3, 2, 1, None, None, None, 12, None]
    assert apply(spark, u, urls.authority) == ["h.x:8", "h", "h", "h", None, None, None, "h"]
    assert apply(spark, u, urls.directory) == ["/a", "", "", "", "", None, "a/b", ""]
    assert apply(spark, [" http://h/a?x#y#z ", "#a"], urls.normalize_url) == ["http://h/a?x", ""]
    d = spark.createDataFrame([("http://h/a/c9.html", "http://h/a/c10.html"), ("http://h/a/c9.html", "http://g/a/x.html"), ("http://h/a/1", "http://h/b/2"), ("http://h/a/1", None)], "a string, b string")
    assert [r[0] for r in d.select(urls.url_similarity(F.col("a"), F.col("b"))).collect()][:3] == [1.0, 0.5, 0.0]


def test_resolve_like_the_standard_library(spark):
    from urllib.parse import urljoin

    base = "http://h.x/a/b/c.html?q=1"
    hrefs = ["d.html", "/r", "../up.html", "./s", "?p=2", "#f", "http://k/l", "//m/n", "../../x/./y", "e/../f", ""]
    got = apply(spark, hrefs, lambda t: urls.resolve(F.lit(base), t))
    assert got == [urljoin(base, h) for h in hrefs]


def test_line_rules(spark):
    lines = ["上一章 | 目录 | 下一章", "上一章章节目录保存书签阅读记录下一章", "Next", "他看着目录发呆", "请记住本站域名：x", "第1/3页", "12", "第三章 风", ""]
    assert apply(spark, lines, textclean.is_nav_line) == [True, True, True, False, False, False, False, False, False]
    assert apply(spark, lines, textclean.is_site_prompt)[4] is True
    assert apply(spark, lines, textclean.is_page_number_line) == [False] * 5 + [True, True, False, False]
    assert apply(spark, lines, lambda t: textclean.is_duplicate_title(t, textclean.known_title(F.lit("第3章 风（1/2）"))))[7] is True


def test_clean_text(spark):
    t = "第3章 风\r\n&lt;b&gt;他来了&amp;走了。</b>​\n\n上一页 下一页\n　　她笑。\n2/5"
    assert apply(spark, [t], lambda c: textclean.clean_text(c, F.lit("第3章 风"))) == ["　　他来了&走了。\n\n　　她笑。"]
    assert apply(spark, ["", None], lambda c: textclean.clean_text(c, F.lit(None).cast("string"))) == ["", None]


def test_safe_filename(spark):
    names = ['a<b>:"c', "con", "COM1", " x. ", "...", "", "风" * 100, "ok"]
    assert apply(spark, names, textclean.safe_filename) == ["a_b___c", "_con", "_COM1", "x", "_", "_", "风" * 80, "ok"]


def test_charset():
    gb = "<html><meta charset=gbk><p>第一章</p>".encode("gb18030")
    assert charset.decode_page(gb, None)[:4] == (gb.decode("gb18030"), "gb18030", "meta_charset", 0.85)
    assert charset.decode_page(gb, "utf-8")[1:3] == ("utf-8", "http_header") and charset.decode_page(gb, "utf-8")[4] is True
    assert charset.decode_page(gb, "utf-8")[3] == 0.80 - 0.6 or charset.decode_page(gb, "utf-8")[3] >= 0.05
    assert charset.decide(b"\xef\xbb\xbfx", "gbk")[:3] == ("utf-8-sig", "bom", 0.99)
    assert charset.decide("x".encode("utf-32"), None)[0] == "utf-32-le"
    assert charset.decide(b'<meta http-equiv="Content-Type" content="text/html; charset=big5">', None)[:3] == ("big5", "meta_http_equiv", 0.80)
    assert charset.normalize_charset("no-such") is None and charset.normalize_charset(None) is None
    assert charset.decode_page(None, None) is None and charset.decode_page(b"", None)[0] == ""


def test_decode_captures(spark):
    d = spark.createDataFrame([(1, bytearray("好".encode("gb18030")), "text/html; charset=GBK"), (2, None, None)], "page_id bigint, raw_bytes binary, content_type string")
    got = {r["page_id"]: r for r in charset.decode_captures(d).collect()}
    assert got[1]["text"] == "好" and got[1]["encoding"] == "gb18030" and got[2]["text"] is None


def test_charset_sees_the_whole_page():
    story = "他走进镇子，看见灯火，听见远处的钟声。" * 200
    raw = b"<script>" + b"var a = 1;\n" * 6500 + b"</script>" + story.encode()
    assert len(raw) > 65536 + 10000
    text, name, source = charset.decode_page(raw, None)[:3]
    assert source == "charset_normalizer" and name == "utf-8" and "\ufffd" not in text and story in text
