import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from folio.llm import mixing, packing, splitting


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1) for i, t, s in rows], "doc_id bigint, text string, source string, rate string, tokens int")


# -- mixing ----------------------------------------------------------------------------------------


def test_uses_follow_rates(spark):
    d = docs(spark, [(i, "x" * 100, "a" if i % 10 else "b") for i in range(2000)] + [(9001, None, None), (9002, "", "c")])
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3), ("none", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    u = {r["doc_id"]: r for r in mixing.uses(d, t).collect()}
    assert len(u) == 2002
    assert {u[i]["n_uses"] for i in range(2000) if i % 10 == 0} == {3}
    n = sum(u[i]["n_uses"] for i in range(2000) if i % 10)
    assert abs(n - 1000) < 100
    assert u[9001]["n_uses"] == 0 and u[9002]["n_uses"] == 0
    short = {r["source"]: r["short"] for r in mixing.rates(d, t).collect()}
    assert short == {"a": False, "b": True, "none": True}
    again = {r["doc_id"]: r["n_uses"] for r in mixing.uses(d, t).collect()}
    assert again == {k: v["n_uses"] for k, v in u.items()}
    rep = {r["source"]: r for r in mixing.report(d, t).collect()}
    assert abs(sum(r["actual_share"] for r in rep.values()) - 1) < 1e-9
    assert mixing.mixture(d, t).count() == sum(r["n_uses"] for r in u.values())


def test_many_sources_are_joined_with_salt(spark):
    d = docs(spark, [(i, "x" * (i % 50), f"s{i % 3}" if i % 4 else None) for i in range(400)])
    t = spark.createDataFrame([("s0", 0.5, 3), ("s1", 0.5, 2)], "source string, target_share double, max_repeats int")
    r = mixing.rates(d, t)
    same = [sorted(tuple(x) for x in mixing._used(d, r, mixing.SEED, n).collect()) for n in (0, 10)]
    assert same[0] == same[1] and len(same[0]) == 400


def test_mixing_empty(spark):
    t = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    e = docs(spark, [])
    assert mixing.uses(e, t).count() == 0
    assert [r["short"] for r in mixing.rates(e, t).collect()] in ([False], [None])
    assert mixing.report(e, t).collect()[0]["used_tokens"] == 0


# -- packing ---------------------------------------------------------------------------------------


def check_packing(spark, rows, capacity, **kw):
    got = packing.pack(docs(spark, rows), capacity, **kw).collect()
    fill, pieces = {}, {}
    for r in got:
        fill[r["container"]] = fill.get(r["container"], 0) + r["n_tokens"]
        pieces.setdefault(r["doc_id"], []).append((r["piece_no"], r["start_token"], r["n_tokens"]))
    assert all(v <= capacity for v in fill.values())
    for i, t, _ in rows:
        b = (t or "").encode()
        ps = sorted(pieces[i])
        assert [p[0] for p in ps] == list(range(1, len(ps) + 1))
        assert b"".join(b[s: s + n] for _, s, n in ps) == b
        assert len(ps) == 1 or len(b) > capacity
        for _, s, n in ps:
            b[s: s + n].decode()
    return len(fill)


def test_pack_is_tight_and_whole(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("aé好") * rng.randint(0, 60), "s") for i in range(900)] + [(2000, "好" * 150, "s"), (2001, None, "s"), (2002, "", "s")]
    n = check_packing(spark, rows, 100)
    total = sum(len((t or "").encode()) for _, t, _ in rows)
    assert n <= total / 100 * 1.06 + 2


def test_pack_few_windows_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "MERGE_ROWS", 10)
    rng = random.Random(5)
    rows = [(i, "a" * rng.randint(1, 50), "s") for i in range(400)]
    check_packing(spark, rows, 64, windows=3)


def test_pack_empty_and_bad(spark):
    assert packing.pack(docs(spark, []), 100).count() == 0
    p = packing.pack(docs(spark, [(1, "a" * 101, "s"), (2, "a" * 100, "s"), (1, "a" * 101, "s")]), 100)
    assert [r["doc_id"] for r in packing.oversized(p).collect()] == [1]
    assert tuple(packing.fill(p, 100).first()) == (302, 1, 2, 0, True)
    assert tuple(packing.fill(p.limit(0), 100).first()) == (0, 0, 0, 0, True)
    with pytest.raises(ValueError):
        packing.pack(docs(spark, []), 3)


def test_windows_best_fit():
    w = packing.Windows(10, 2, 0)
    assert [w.place(x) for x in (6, 7, 3, 4)] == [0, 1, 1, 0]
    assert w.free == []


# -- splitting -------------------------------------------------------------------------------------


def pieces_of(spark, text, limit, overlap):
    rows = splitting.split_long(docs(spark, [(1, text, "s")]), limit, overlap).orderBy("piece_no").collect()
    b = text.encode()
    at = 0
    for k, r in enumerate(rows):
        assert r["piece_no"] == k + 1 and r["n_pieces"] == len(rows)
        assert r["n_tokens"] <= limit and r["overlap_tokens"] <= overlap
        assert r["start_token"] + r["overlap_tokens"] == at
        assert r["piece"].encode() == b[r["start_token"]: r["start_token"] + r["n_tokens"]]
        at = r["start_token"] + r["n_tokens"]
    assert at == (len(b) if rows else 0)
    return [r["piece"] for r in rows]


def test_split_round_trip(spark):
    rng = random.Random(6)
    for text in (
        "".join(rng.choice(["word ", "Satz. ", "好字。", "é", "\n\n", "\r\n", "😀", "「は」"]) for _ in range(400)), "a" * 1000, "好" * 500, "😀" * 200, " " * 500, "\n" * 300,
        "one. two! three? " * 40, "“It is.” “No.” " * 30,
    ):
        for limit, overlap in ((64, 0), (64, 16), (40, 8)):
            assert len(pieces_of(spark, text, limit, overlap)) > 1


def test_split_prefers_boundaries(spark):
    text = "First paragraph is here.\n\nSecond one. It goes on and on and on."
    assert pieces_of(spark, text, 40, 0)[0] == "First paragraph is here.\n\n"
    assert pieces_of(spark, "aaaa bbbb. cccc dddd", 14, 0)[0] == "aaaa bbbb. "
    assert pieces_of(spark, "好好好。坏坏坏坏坏", 18, 0)[0] == "好好好。"


def test_split_leaves_short_null_and_empty(spark):
    d = docs(spark, [(1, "a" * 64, "s"), (2, None, "s"), (3, "", "s"), (4, "a" * 65, "s")])
    assert {r["doc_id"] for r in splitting.split_long(d, 64, 8).collect()} == {4}
    assert splitting.split_long(docs(spark, []), 64, 8).count() == 0
    with pytest.raises(ValueError):
        splitting.split_long(d, 10, 9)


def test_split_very_long(spark):
    assert len(pieces_of(spark, "word and more. " * 60_000, 4096, 256)) > 200


def test_work_grows_with_the_text(spark):
    """Millions of tokens in one text: minutes if pieces were cut from the text's start each time."""
    t = time.time()
    d = spark.range(1).select(F.lit(1).alias("doc_id"), F.repeat(F.concat(F.lit("word and more. "), F.substring(F.col("id").cast("string"), 1, 0)), 1_000_000).alias("text"))
    r = splitting.split_long(d, 4096, 256).agg(F.sum(F.col("n_tokens") - F.col("overlap_tokens")), F.max("n_tokens"), F.sum(F.octet_length("piece")), F.sum("n_tokens")).first()
    assert r[0] == 15_000_000 and r[1] <= 4096 and r[2] == r[3]
    assert packing._pieces(d, 8192, "doc_id", "text").agg(F.sum("n_tokens")).first()[0] == 15_000_000
    assert time.time() - t < 60


def test_running_ends(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        df = spark.createDataFrame([([i % 7 for i in range(n)],)], "l array<int>")
        got = df.select(splitting.running_ends(F.col("l"))).first()[0]
        assert got == list(itertools.accumulate(i % 7 for i in range(n)))
