import pickle
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from folio.llm import lookalikes as la


@pytest.fixture(scope="module")
def known(spark):
    return la.looks(spark)


SAME = [
    ("Chapter 1: A", "Ｃｈａｐｔｅｒ　１： Ａ"), ("Café", "Café"), ("a b", "a b"), ("a b", " a  b "), ("ab", "a​b﻿"), ("Coat", "Соat"), ("Of", "Оf"), ("A sail", "Α sail"),
    ("й", "й"), ("第十章", "第⼗章"), ("茶", "茶"), ("Part XII", "Part Ⅻ"), ("fish", "ﬁsh"), ("a-b", "a‐b"), ("パン", "ﾊﾟﾝ"), ("へや", "ヘや"), ("Глава 1", "Глaвa 1"), ("a|b", "a｜b"), ("K", "K"),
]
OTHER = [("a", "A"), ("e", "é"), ("x2", "x²"), ("1", "①"), ("a.", "a"), ("3", "３٣"[1]), ("ハン", "パン"), ("a-b", "a—b"), ("'", "’"), ("ab", "a b"), ("I", "l"), ("l", "1"), ("O", "0"), ("m", "rn"), ("i", "ı"), ("o", "०"), ("ǐ", "ĭ"), ("リ", "り"), ("土", "士"), ("日", "曰")]


def test_same_and_other(known):
    for a, b in SAME:
        assert known.canonical(a) == known.canonical(b), (a, b)
    for a, b in OTHER:
        assert known.canonical(a) != known.canonical(b), (a, b)


def test_readable_forms(known):
    assert known.canonical("Глaвa 40 - Мой чайник") == "Глава 40 - Мой чайник"
    assert known.canonical("第5話 パン屋のランプ") == "第5話 パン屋のランプ"
    assert known.canonical("Chapter 12") == "Chapter 12"


def test_shipped_as_it_is(known):
    again = pickle.loads(pickle.dumps(known))
    for a, _ in SAME + OTHER:
        assert again.canonical(a) == known.canonical(a)


POOL = "".join(a + b for a, b in SAME + OTHER) + "゙゚́̈ 　가각ㄱ"


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet=POOL, max_size=12))
def test_splice_is_whole_normalization_and_idempotent(known, s):
    assert known.splice(s) == known.whole(s)
    assert known.canonical(known.canonical(s)) == known.canonical(s)
    assert unicodedata.is_normalized("NFC", known.canonical(s))


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(max_size=10))
def test_any_text(known, s):
    assert known.splice(s) == known.whole(s)


def test_pairs(spark):
    e = spark.createDataFrame([(1, 7, "Café"), (2, 7, "Cafe"), (3, 8, "Café"), (4, None, "Café"), (5, 7, None), (1, 7, "Café"), (6, 7, "Café")], "entry_id bigint, book_id bigint, title string")
    m = spark.createDataFrame([(1, 7, "Café"), (2, 7, "Café"), (3, 9, "Café"), (4, 7, ""), (5, 7, None)], "match_id bigint, book_id bigint, title string")
    assert {tuple(r) for r in la.pairs(e, m).collect()} == {(1, 1), (6, 2)}
    assert la.pairs(e.limit(0), m).count() == 0
    f = {(r["kind"], r["id"]): r["form"] for r in la.forms(e, m).collect()}
    assert f[("entry", 1)] == f[("match", 1)] == "Café" and f[("entry", 5)] is None and f[("match", 4)] == ""
