import random

import numpy as np

from folio.llm import residue as rs
from folio.llm.patterns import FILLER, MESSAGE, PLACEHOLDER, may_tell

WORDS = "river stone lantern bridge quiet morning letter garden tower window silver market barrel harbour meadow".split()


def story(rng, n):
    return [" ".join(rng.choices(WORDS, k=14)).capitalize() + "." for _ in range(n)]


def page(lines, title="Chapter 1"):
    return (
        f"<html><head><title>{title}</title><script>var t='{{{{title}}}}'</script></head><body><noscript>Please enable JavaScript to read</noscript><nav><a href='/'>Home</a></nav><article><h1>{title}</h1>"
        + "".join(f"<p>{x}</p>\n" for x in lines) + "</article><footer><p>Terms of reading</p></footer></body></html>"
    )


def make():
    rng = random.Random(11)
    rows, bad = [], set()
    messages = ["HTTP Error 503: resource unavailable", "You do not have access to this document.", "Please enable JavaScript to continue reading", "Something broke on our side. Try again in 5 minutes", "Oops! We could not find that chapter."]
    for i in range(700):
        host = f"h{i % 9}.example"
        status, lines = 200, story(rng, rng.randint(1, 9))
        kind = rng.random()
        if kind < 0.15:
            lines, status = [rng.choice(messages)], rng.choice([404, 503, 500, 200, 200])
            bad.add(i)
        elif kind < 0.20:
            lines = ["Lorem ipsum dolor sit amet magna aliqua."] * rng.randint(1, 4)
            bad.add(i)
        elif kind < 0.25:
            lines.insert(rng.randint(0, len(lines)), rng.choice(["{{chapter.title}}", "${body}", "%%author_name%%", "[[body]]", "#{intro}"]))
            bad.add(i)
        elif kind < 0.30:
            status = rng.choice([404, 503])
        elif kind < 0.36:
            lines.append(f"Room {rng.randint(100, 999)} was not found on any plan, and Bela said the page had been torn out years ago.")
        rows.append((i, host, status, page(lines), "x"))
    return rows, bad


SCHEMA = "page_id bigint, host string, status_code int, html string, score string"


def test_found(spark):
    rows, bad = make()
    extra = [(9001, "h1.example", 200, None, "x"), (9002, None, None, "", "x"), (9003, "h1.example", 200, page(story(random.Random(1), 3000)), "x"), (0, *rows[0][1:]), (None, "h", 200, "x", "x")]
    df = spark.createDataFrame(rows + extra, SCHEMA)
    got = {r["page_id"] for r in rs.found(df).collect()}
    hit = len(got & bad)
    assert hit >= 0.97 * len(bad) and len(got - bad) <= 0.03 * len(bad), (sorted(bad - got)[:5], sorted(got - bad)[:5])
    kept = {r["page_id"] for r in rs.kept(df).collect()}
    assert kept == {r[0] for r in rows} - got | {9001, 9002, 9003}


def test_every_page_counts(spark):
    """Two pages among thousands tell a message, and the lines of all pages are labelled: a sample would miss them."""
    rare = "the lantern keeper has gone home early"
    rows = [(i, f"h{i % 3}.example", 404 if i % 2 else 200, f"<p>Leaf {i} of {i * 7919 % 10007} lies here alone.</p><p>{rare if i in (17, 4321) else i}</p>", "x") for i in range(9000)]
    df = rs.page_rows(spark.createDataFrame(rows, SCHEMA)).withColumn("rid", rs.F.monotonically_increasing_id()).persist()
    assert rs._hash(rare) in {r["part"] for r in rs.learned(df).where("sets % 2 = 1").collect()}
    got = {r["page_id"]: r["own"] for r in rs.weak_labels(df, 1).join(df.select("rid", "page_id"), "rid").select("page_id", "own").collect()}
    assert len(got) == 9000 and rs.LABELS[got[17][1]] == rs.LABELS[got[4321][1]] == (1, 2.0)
    df.unpersist()


def test_steps_over_shares_of_the_pages(spark, monkeypatch):
    monkeypatch.setattr(rs, "STEP_LINES", 1500)
    monkeypatch.setattr(rs, "STEPS", 24)
    rows, bad = make()
    got = {r["page_id"] for r in rs.found(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got & bad) >= 0.97 * len(bad) and len(got - bad) <= 0.03 * len(bad), (sorted(bad - got)[:5], sorted(got - bad)[:5])


def test_long_lines_stay_with_the_tasks(spark, monkeypatch):
    """Few lines of much text: the driver gets what is not 0 of the sums, a fraction of the weights, and the fit is the one of all lines in one place."""
    monkeypatch.setattr(rs, "STEPS", 12)
    rows, _ = make()
    pages = rs.materialize(rs.page_rows(spark.createDataFrame(rows, SCHEMA)).withColumn("rid", rs.F.monotonically_increasing_id()))
    taught = rs.materialize(rs.weak_labels(pages, 1))
    whole, sent, add = rs.fit(taught, 1, rs.DRIVER_CHARACTERS), [], rs._add_packed
    monkeypatch.setattr(rs, "_add_packed", lambda g, some, v: sent.append(len(some) + len(v)) or add(g, some, v))
    monkeypatch.setattr(rs.linear, "fit", None)
    parts = rs.fit(taught, 1, rs.DRIVER_CHARACTERS + 1)
    assert 12 <= len(sent) <= 12 * rs.SUMS and max(sent) < 3 * 8 * rs.linear.DIM / 4
    for a, b in zip(whole, parts, strict=True):
        assert np.allclose(a.w, b.w, atol=1e-5) and np.allclose(a.d, b.d, atol=1e-6) and abs(a.b - b.b) < 1e-6


def test_packed_sums_lose_nothing():
    g = np.zeros((3, 21))
    g[0, 3], g[1, 20], g[2, 0] = 1 / 3, -1e-300, np.inf
    total = np.ones((3, 21))
    rs._add_packed(total, *rs._packed(g))
    assert (total == 1 + g).all()


def test_cheap_look_for_phrases():
    told = [
        "we could not find it", "access is denied", "acceſs denied", "internal server error", "please turn on your javascript", "need js", "traceback", "introuvable.", "n'existe pas", "les scripts sont bloqués", "не найден",
        "доступ запрещён", "禁用了js", "見つかりませんでした。", "lorem ipsum", "asdf asdf", "tbd tbd ", "dummy text", "текст-заполнитель", "ダミー", "sed quis, ut nulla", "ut ſit ut ut", "texte d'exemple", "our text will appear",
    ]
    for s in told:
        assert FILLER.search(s) or MESSAGE.search(s), s
        assert may_tell(s) and may_tell(f"a story\n{s}\nand more"), s
    assert not may_tell("bela sed ut sit and copied the signs into the margin")


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert rs.found(df).count() == 0
    one = spark.createDataFrame([(1, "h", 200, page(["{{body}}"]), "x"), (2, "h", 200, page(["A story."]), "x")], SCHEMA)
    assert {r["page_id"] for r in rs.found(one).collect()} <= {1}


def test_placeholder_grammar():
    for s in ("{{x}}", "{{a|safe}}", "${a.b}", "#{x}", "%%x%%", "[%x%]", "[[x]]", "@@x@@", "<%= a %>", "{% block a %}", "{CHAPTER_BODY}", "{{正文内容}}", "[object Object]", "null null", "undefined", "NaN / undefined"):
        assert PLACEHOLDER.search(s), s
    for s in ("{ ash; salt }", "[name withheld]", "#7, $5, 40% of the load", "a@b.example", "he was undefined by it", "50%", "{1}"):
        assert not PLACEHOLDER.search(s), s


def test_title_on_two_lines_is_one_line_to_the_classifier(spark):
    """A line feed in a title would give each later line the n-grams of the line before it."""
    rows = [(1, "h", 404, page(["Gone."], "404\n12"), "x"), (2, "h", 200, page(["A story."], "Untitled"), "x")]
    got = {r["page_id"]: r["tail"] for r in rs.page_rows(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: "\x03404 12", 2: "\x03untitled"}


def test_few_tasks_a_step_and_modules_out_of_the_garbage_collection(spark, monkeypatch):
    """A step of little text is one task, and its worker doesn't look through all modules for garbage after it: both took more CPU than the gradients."""
    monkeypatch.setattr(rs, "STEPS", 3)
    rows, _ = make()
    pages = rs.materialize(rs.page_rows(spark.createDataFrame(rows, SCHEMA).repartition(4)).withColumn("rid", rs.F.monotonically_increasing_id()))
    taught, sent, add = rs.materialize(rs.weak_labels(pages, 1)), [], rs._add_packed
    monkeypatch.setattr(rs, "_add_packed", lambda g, some, v: sent.append(1) or add(g, some, v))
    monkeypatch.setattr(rs.linear, "fit", None)
    rs.fit(taught.repartition(4), 1, rs.DRIVER_CHARACTERS + 1)
    assert len(sent) <= 3 * -(-rs.DRIVER_CHARACTERS // rs.TASK_CHARACTERS)

    def frozen(batches):
        import gc

        rs._unwatched()
        for b in batches:
            yield b.select([0]).set_column(0, "n", rs.pa.array([gc.get_freeze_count()] * b.num_rows, rs.pa.int64()))

    assert spark.range(1).mapInArrow(frozen, "n bigint").first()["n"] > 0


def test_ngrams_in_the_order_of_the_text_give_the_same_sums():
    rng = np.random.default_rng(3)
    lines = ["", "a", "ab", "", "7 abc 19", "章节 目录", "x" * 300, "", *story(random.Random(2), 300)]
    f, r = rs.linear.ngrams(lines)
    v = (1 / np.sqrt(np.maximum(np.bincount(r, minlength=len(lines)), 1)))[r]
    w, e = rng.normal(size=rs.linear.DIM), rng.normal(size=len(lines))
    x = rs.linear.Hashed(lines)
    assert np.allclose(x.logits(rs._weights(w)), np.bincount(r, weights=w[f] * v, minlength=len(lines)), atol=1e-12)
    assert np.allclose(x.gradient(e), np.bincount(f, weights=e[r] * v, minlength=rs.linear.DIM), atol=1e-12)
    cuts = list(rs.linear.pieces(lines, 500))
    assert [i for i, _ in cuts] + [len(lines)] == [0] + [j for _, j in cuts] and all(j == i + 1 or sum(len(s) + 1 for s in lines[i:j]) <= 500 for i, j in cuts)


def test_marks_of_lines():
    html = page(["Bela {{x}} left.", "We could not find h.example", "{{y}}", "Short.", "Short."], "404")
    lines, tail, bits, parts, text = rs.page_lines(html, "h.example")
    assert lines == ["404", "bela {{x}} left.", "we could not find \x01", "{{y}}", "short.", "short."] and tail == "\x03404"
    assert [k & 3 for k in bits] == [0, 1, 0, 3, 0, 0] and [bool(k & rs._MESSAGE) for k in bits] == [False, False, True, False, False, False]
    assert [bool(k & rs._HEADING) for k in bits] == [True] + [False] * 5 and [bool(k & rs._HOSTED) for k in bits] == [False, False, True, False, False, False]
    assert all(k & 1 << 10 for k in bits) and [k >> 2 & 31 for k in bits] == [1, 0, 1, 0, 1, 1] and text == 16 + 5 + 12
    assert [len(p) for p in parts] == [0, 1, 1, 0, 0, 0] and rs.page_lines("", None) == ([], "", [], [], 0)
