import itertools
import random
import time

from folio.llm import boilerplate as bp
from folio.llm import repeated_lines as rl

WORDS = "river stone lantern bridge quiet morning letter garden tower window silver market barrel harbour window meadow".split()


def story(rng):
    return " ".join(rng.choices(WORDS, k=14)).capitalize() + "."


def site(host, n, start, told):
    """Pages of one site: menu, cookie notice, heading, byline, story with a share prompt among it, links, footer."""
    rng = random.Random(start)
    rows = []
    for i in range(n):
        body = [story(rng) for _ in range(6)]
        share, foot, cookie = f"Enjoying this? Share it from {host} today", f"All rights reserved by {host}", "We store cookies. Accept all."
        menu = ["Home", "Library", "Sign in", "Help"]
        main = [f"Chapter {i + 1} of {start}", f"Posted by the {host} desk", *body[:3], share, *body[3:]]
        nav, article, footer = ("nav", "article", "footer") if told else ("div", "div", "div")
        html = (
            f"<html><body><{nav}><ul>" + "".join(f"<li><a href='/{k}'>{m}</a></li>" for k, m in enumerate(menu)) + f"</ul></{nav}><div>{cookie}</div><{article}><h1>{main[0]}</h1>"
            + "".join(f"<p>{x}</p>\n" for x in main[1:]) + f"</{article}><div><a href='n'>Next: Chapter {i + 2}</a></div><{footer}><p>{foot}</p></{footer}></body></html>"
        )
        text = "\n".join([" > ".join(menu), cookie, *main, "", f"Next: Chapter {i + 2}", foot.upper()])
        bad = {1, 2, 8, len(main) + 4, len(main) + 5}
        rows.append((start + i, host, html, text, bad))
    return rows


ROWS = [*site("a.example", 40, 1000, True), *site("b.example", 40, 2000, True), *site("c.example", 40, 3000, False)]


def frames(spark, extra=()):
    p = spark.createDataFrame([(r[0], r[1], r[2], "t") for r in ROWS], "page_id bigint, host string, html string, text string")
    c = spark.createDataFrame([(r[0], r[3], "h") for r in ROWS] + list(extra), "page_id bigint, text string, host string")
    return c, p


def test_found(spark):
    c, p = frames(spark, [(1000, ROWS[0][3], "h"), (1001, None, "h"), (1002, "", "h"), (999, story(random.Random(1)), "h"), (None, "x", "h")])
    got = {}
    for r in bp.found(c, p).collect():
        got.setdefault(r["page_id"], set()).add(r["line_no"])
    wrong = sum(len(got.get(r[0], set()) ^ r[4]) for r in ROWS)
    assert wrong <= 0.03 * sum(len(r[4]) for r in ROWS)
    assert 999 not in got


def test_main_text(spark):
    c, p = frames(spark)
    got = {r["page_id"]: r["text"] for r in bp.main_text(c, p).collect()}
    assert len(got) == len(ROWS)
    assert got[3000].split("\n")[0] == "Chapter 1 of 3000" and "cookies" not in got[3000]


def test_empty(spark):
    c, p = frames(spark)
    assert bp.found(c.limit(0), p).count() == 0
    assert bp.found(c, p.limit(0)).count() >= 0


def cut_value(z, edges, side):
    return sum(abs(v) for v, s in zip(z, side, strict=True) if (v > 0) != s) + sum(w for a, b, w in edges if side[a] != side[b])


def test_min_cut_is_minimal():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 9)
        z = [rng.uniform(-1.5, 1.5) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 1)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        got = bp.min_cut(z, edges)
        best = min(cut_value(z, edges, s) for s in itertools.product([False, True], repeat=n))
        assert abs(cut_value(z, edges, got) - best) < 1e-6


def test_min_cut_long_chain():
    z = [0.1 if i % 2 else -0.1 for i in range(5000)]
    assert len(bp.min_cut(z, [(i, i + 1, 0.3) for i in range(4999)])) == 5000


def test_min_cut_of_many_undecided_lines():
    rng = random.Random(4)
    n = 3000
    z = [rng.uniform(-0.4, 0.4) for _ in range(n)]
    edges = [(i, i + 1, 0.35) for i in range(n - 1)] + [(i, i + rng.randint(2, 9), 0.15) for i in range(n - 9)]
    t = time.time()
    side = bp._max_flow(list(range(n)), z, near(n, edges), [None] * n)
    assert time.time() - t < 1
    flips = [cut_value(z, edges, [v if i != k else not v for i, v in enumerate(side)]) for k in range(0, n, 100)]
    assert cut_value(z, edges, side) <= min(flips) + 1e-6


def near(n, edges):
    out = [[] for _ in range(n)]
    for a, b, w in edges:
        out[a].append((b, w))
        out[b].append((a, w))
    return out


# -- repeated lines --------------------------------------------------------------------------------


def brute(content, hosts):
    pages, base = {}, {}
    for pid, t in content:
        if pid in hosts and t and t.strip():
            for x in t.split("\n"):
                k = " ".join(x.split()).lower()
                if k:
                    pages.setdefault((hosts[pid], k), set()).add(pid)
                    base.setdefault(hosts[pid], set()).add(pid)
    keep = {k for k, v in pages.items() if len(v) >= 5 and 10 * len(v) >= len(base[k[0]])}
    return {(pid, i) for pid, t in content if pid in hosts and t for i, x in enumerate(t.split("\n"), 1) if (hosts[pid], " ".join(x.split()).lower()) in keep}


def lines_case():
    rng = random.Random(9)
    hosts = {i: rng.choice(["a", "a", "a", "b", "c"]) for i in range(200)}
    notices = ["Legal  notice", "LEGAL\tNOTICE ", "　legal notice", "Share this", "By X", "rare"]
    content = []
    for i in hosts:
        t = [f"unique {i} {k}" for k in range(4)]
        for x in rng.sample(notices, 3):
            t.insert(rng.randint(0, len(t)), x)
        if rng.random() < 0.2:
            t.append("")
        content.append((i, "\n".join(t)))
    return content + content[:10] + [(3, None), (4, ""), (5, " \n\t"), (9999, "Share this")], hosts


def test_repeated_lines(spark, monkeypatch):
    content, hosts = lines_case()
    c = spark.createDataFrame([(i, t, "z") for i, t in content], "page_id bigint, text string, host string")
    p = spark.createDataFrame([(i, h, "u") for i, h in hosts.items()] + [(8888, None, "u")], "page_id bigint, host string, text string")
    want = brute(content, hosts)
    assert {tuple(r) for r in rl.found(c, p).collect()} == want
    known = rl.blocks(c, p)[0].collect()
    assert all(r["n_pages"] >= 5 and 10 * r["n_pages"] >= r["n_base"] for r in known)
    out = {(r["page_id"], r["n_removed"]) for r in rl.removed(c, p).collect()}
    assert (0, len({x for x in want if x[0] == 0})) in out
    monkeypatch.setattr(rl, "BROADCAST_NODES", 0)
    assert {tuple(r) for r in rl.found(c, p).collect()} == want
    assert rl.found(c.limit(0), p).count() == 0


def test_blocks_are_components(spark):
    content = [(i, f"x{i}\nfoot one\nfoot two\ny{i}\nalone") for i in range(8)]
    c = spark.createDataFrame(content, "page_id bigint, text string")
    p = spark.createDataFrame([(i, "h") for i, _ in content], "page_id bigint, host string")
    known = rl.blocks(c, p)[0].collect()
    assert len(known) == 3 and len({r["block"] for r in known}) == 2
