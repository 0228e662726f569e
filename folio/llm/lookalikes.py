"""One consistent form of titles that look the same (problem 6).

Quick check: most characters stand for themselves in the consistent form; a
title made of them alone is left as it is, inside the JVM. Elsewhere only the
unstable segments, each with the stable character before it as context for
composition, are normalized and spliced into the unchanged rest.

Which characters are stable and which letters look alike is derived from
published data: the normalization properties of Python's Unicode database and
the confusables of the ICU library that Spark brings along.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.util import materialize, skew_safe_join

# Letters that look like a letter of another script, with the one that stands for both. They go before what the
# confusables say, which knows many more.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H",
    "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W",
    "Ѵ": "V", "Ԍ": "G", "Ӏ": "I",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    # Armenian and Latin
    "օ": "o", "ɑ": "a", "ɡ": "g", "ꓲ": "I",
    # Katakana and ideographs or Hiragana
    "ヘ": "へ", "ニ": "二", "ハ": "八", "カ": "力", "ロ": "口", "エ": "工", "タ": "夕", "ト": "卜", "ー": "一", "ノ": "丿",
    # hyphens and the apostrophe letter
    "‐": "-", "‑": "-", "ʼ": "’",
    # kra, which Greek and Cyrillic letters are confusable with
    "ĸ": "k", "κ": "k", "к": "k",
}
# Code points without a visible trace.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿\U000e0000-\U000e0fff"
# Compatibility characters that look as what they stand for: ligatures, Roman numerals, radicals.
SAME_LOOK = ((0x2160, 0x217F), (0x2E80, 0x2FDF), (0xFB00, 0xFB06), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x0132, 0x0133))
#: Rows of either side that meet in one task's block.
BLOCK = 2000
#: Ranges of stable characters, the largest, that the quick check in the JVM knows; titles with others go to the normalizer, which knows all.
QUICK_RANGES = 24
#: Blocks of Latin letters that may stand for a plain one: phonetic letters and small capitals of its shape. Other Latin letters are told apart.
PHONETIC = ((0x0250, 0x02AF), (0x1D00, 0x1D7F), (0xA730, 0xA7FF))
#: Which of several letters without a plain Latin one stands for all: one of the first of these scripts.
SCRIPTS = ("CYRILLIC", "GREEK", "CJK", "HIRAGANA", "KATAKANA", "HANGUL")

_INVISIBLE = re.compile(f"[{INVISIBLE}]+")
_SPACES = re.compile(r"[\s   -     　⠀]+")
_WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")
_CYRILLIC_ONLY = re.compile("[Ѐ-ԯ]")


def _script(c: str) -> str:
    return unicodedata.name(c, "?").split(" ")[0].split("-")[0]


def confusables(spark: SparkSession) -> dict[str, str]:
    """Letters with the letter of another script that stands for them, by the skeletons of Unicode's confusables.

    Only single base letters of scripts written from left to right count:
    accents, figures and punctuation make a visible difference, and ASCII
    letters, I and l among them, always stand for themselves. A letter goes to the
    plain Latin one of its case; those without one to a letter by SCRIPTS.
    """
    plain = [chr(c) for c in (*range(65, 91), *range(97, 123))]
    letters = [c for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c)[0] == "L" and not unicodedata.decomposition(c) and unicodedata.bidirectional(c) == "L" and not "가" <= c <= "힣"]
    skeleton = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(plain + letters)).split("\n")
    classes: dict[str, list[str]] = {}
    for c, k in zip(plain + letters, skeleton, strict=True):
        classes.setdefault(k, []).append(c)
    out = {}
    for members in classes.values():
        ascii_ = [c for c in members if c.isascii()]
        others = [c for c in members if not c.isascii()]
        rank = lambda c: (SCRIPTS.index(_script(c)) if _script(c) in SCRIPTS else len(SCRIPTS), ord(c))
        for c in others:
            kind = unicodedata.category(c)
            if ascii_:
                same = [x for x in ascii_ if unicodedata.category(x) == kind] or ([x for x in ascii_ if x.isupper()] if kind == "Lo" else []) or (ascii_ if len(ascii_) == 1 else [])
                if same and (_script(c) != "LATIN" or any(a <= ord(c) <= b for a, b in PHONETIC)):
                    out[c] = same[0]
            elif len(others) > 1:
                to = min(others, key=rank)
                if _script(to) != _script(c):
                    out[c] = to
    out |= LOOKALIKES
    for c in out:  # one step leads to the letter that stands for all
        while out[c] in out:
            out[c] = out[out[c]]
    return out


class Looks:
    """The consistent form of titles, given which letters stand for which. Small, and shipped to the tasks."""

    def __init__(self, letters: dict[str, str]):
        self.letters = letters
        self._ready()
        self.stable = self._stable_ranges()
        self._ready()

    def __getstate__(self) -> dict:
        return {"letters": self.letters, "stable": self.stable}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._ready()

    def _ready(self) -> None:
        self.char = lru_cache(200_000)(self._char)
        if not hasattr(self, "stable"):
            return
        cls = _class(self.stable)
        self.segment = lru_cache(200_000)(lambda seg: self._compose(_SPACES.sub(" ", seg)))
        # unstable characters with the stable one before them (a base for combining marks)
        self.segments = re.compile(f"(?:[{cls}])?[^{cls}]+")
        self.back: dict[str, str] = {}
        for k in sorted((k for k in self.letters if "Ѐ" <= k <= "ԯ"), key=lambda k: (not "А" <= k <= "я", k)):
            v = self.letters[k]
            if v.isascii() and (unicodedata.category(k) == unicodedata.category(v)):
                self.back.setdefault(v, k)
        kana = {v: k for k, v in self.letters.items() if k in LOOKALIKES and "ァ" <= k <= "ー"}
        self.kana = kana
        self.near_kana = re.compile(f"[{''.join(kana)}](?=[\u3099\u309aァ-ー])|(?<=[\u3099\u309aァ-ー])[{''.join(kana)}]")

    def _char(self, c: str) -> str:
        """Decomposed base form of one code point."""
        d = unicodedata.decomposition(c)
        if d.startswith(("<wide>", "<narrow>", "<font>")) or (d.startswith("<compat>") and any(a <= ord(c) <= b for a, b in SAME_LOOK)):
            c = unicodedata.normalize("NFKC", c)
        return "".join(self.letters.get(x, x) for x in unicodedata.normalize("NFD", c))

    def _compose(self, s: str) -> str:
        d = unicodedata.normalize("NFD", "".join(map(self.char, s)))  # canonical order of marks
        return unicodedata.normalize("NFC", d)

    def _stable_ranges(self) -> list[tuple[int, int]]:
        """Quick check: characters that stand for themselves, whatever stands beside them but for a combining mark, which is unstable itself."""
        second = {x for c in range(0x80, 0x30000) if (d := unicodedata.decomposition(chr(c))) and d[0] != "<" for x in unicodedata.normalize("NFD", chr(c))[1:]}
        out: list[tuple[int, int]] = []
        for i in range(0x21, 0x10000):
            c = chr(i)
            ok = (
                unicodedata.category(c) not in ("Cn", "Cs", "Cc", "Co") and not unicodedata.combining(c) and c not in second and not 0x1160 <= i <= 0x11FF
                and not _INVISIBLE.match(c) and not _SPACES.match(c) and self._compose(c) == c
            )
            if ok and out and out[-1][1] == i - 1:
                out[-1] = (out[-1][0], i)
            elif ok:
                out.append((i, i))
        return out

    @property
    def java_unstable(self) -> str:
        """Java: a title with any of these goes to the normalizer."""
        large = sorted(sorted(self.stable, key=lambda r: r[0] - r[1])[:QUICK_RANGES])
        first = [r for r in self.stable if r[1] < 0x180 and r not in large]
        cls = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in first + large)
        return rf"[^{cls}\x20]|^\x20|\x20$|\x20\x20"

    def whole(self, s: str) -> str:
        """Reference form: every step over the whole string."""
        return self._compose(_SPACES.sub(" ", _INVISIBLE.sub("", s)).strip(" "))

    def splice(self, s: str) -> str:
        """As whole, touching unstable segments only."""
        s = _INVISIBLE.sub("", s)
        return _SPACES.sub(" ", self.segments.sub(lambda m: self.segment(m.group()), s)).strip(" ")

    def display(self, form: str) -> str:
        """Give words of a Cyrillic title and Katakana words their own letters back.

        A function of the form alone, and one that can be undone: equal forms stay
        equal and others stay different.
        """
        if self.near_kana.search(form):
            last = None
            while last != form:
                last = form
                form = self.near_kana.sub(lambda m: self.kana[m.group()], form)
            form = unicodedata.normalize("NFC", form)
        if not _CYRILLIC_ONLY.search(form):
            return form
        d = unicodedata.normalize("NFD", form)

        def word(m: re.Match) -> str:
            w = m.group()
            if any(c.isascii() and c.isalpha() and c not in self.back for c in w):
                return w
            if _CYRILLIC_ONLY.search(w) or len(w) == 1:
                return "".join(self.back.get(c, c) for c in w)
            return w

        return unicodedata.normalize("NFC", _WORD.sub(word, d))

    def canonical(self, s: str | None) -> str | None:
        return None if s is None else self.display(self.splice(s))


def _class(ranges: list[tuple[int, int]]) -> str:
    return "".join(re.escape(chr(a)) + (f"-{re.escape(chr(b))}" if b > a else "") for a, b in ranges)


_KNOWN: dict[str, Looks] = {}


def looks(spark: SparkSession) -> Looks:
    """Made once a driver, from the library's data."""
    if "looks" not in _KNOWN:
        _KNOWN["looks"] = Looks(confusables(spark))
    return _KNOWN["looks"]


def with_form(df: DataFrame, title_col: str = "title", form_col: str = "form") -> DataFrame:
    """``df`` and the consistent form of its title: null for null, empty for a title without visible characters."""
    known = looks(df.sparkSession)
    unstable = F.col(title_col).rlike(known.java_unstable)
    out = [f.name for f in df.schema.fields]
    quick = df.where(~unstable | F.col(title_col).isNull()).withColumn(form_col, F.col(title_col))

    @F.pandas_udf("string")
    def normalize(t):  # noqa: ANN001, ANN202
        return t.map(known.canonical, na_action="ignore")

    slow = df.where(unstable).withColumn(form_col, normalize(F.col(title_col)))
    return quick.select(*out, form_col).unionByName(slow.select(*out, form_col))


def _forms(entries: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    e = entries.select("entry_id", "book_id", "title").where("book_id IS NOT NULL AND title IS NOT NULL")
    m = matches.select("match_id", "book_id", "title").where("book_id IS NOT NULL AND title IS NOT NULL")
    return materialize(with_form(e)), materialize(with_form(m))


def pairs(entries: DataFrame, matches: DataFrame) -> DataFrame:
    """(entry_id, match_id): same book, different title strings, same look.

    Titles are pre-aggregated to their distinct spellings; only forms that
    occur in several spellings and on both sides are expanded to rows. Rows
    with a null book or title pair with nothing.
    """
    e, m = _forms(entries, matches)
    ev = e.groupBy("book_id", "form", "title").agg(F.count("*").alias("n_e"))
    mv = m.groupBy("book_id", "form", "title").agg(F.count("*").alias("n_m"))
    both = ev.join(mv.withColumnRenamed("title", "m_title"), ["book_id", "form"]).where("title <> m_title")
    sides = materialize(both)
    want_e = sides.groupBy("book_id", "form", "title").agg(F.first("n_e").alias("n"))
    want_m = sides.groupBy("book_id", "form", F.col("m_title").alias("title")).agg(F.first("n_m").alias("n"))
    # a form's rows meet in blocks of BLOCK by BLOCK, so no task takes all copies of a title
    grid = want_e.groupBy("book_id", "form").agg(F.ceil(F.sum("n") / BLOCK).cast("bigint").alias("g_e")).join(want_m.groupBy("book_id", "form").agg(F.ceil(F.sum("n") / BLOCK).cast("bigint").alias("g_m")), ["book_id", "form"])
    key = ["book_id", "form"]
    ee = skew_safe_join(e, want_e.join(grid, key), [*key, "title"], "n", e.count())
    mm = skew_safe_join(m, want_m.join(grid, key), [*key, "title"], "n", m.count()).withColumnRenamed("title", "m_title")
    ee = ee.select(*key, "title", "entry_id", F.pmod(F.xxhash64("entry_id"), "g_e").alias("b_e"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("g_m") - 1)).alias("b_m"))
    mm = mm.select(*key, "m_title", "match_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("g_e") - 1)).alias("b_e"), F.pmod(F.xxhash64("match_id"), "g_m").alias("b_m"))
    return ee.join(mm, [*key, "b_e", "b_m"]).where("title <> m_title").select("entry_id", "match_id").distinct()


def forms(entries: DataFrame, matches: DataFrame) -> DataFrame:
    """(kind, id, title, form) for all titles of both tables; a null title has a null form."""
    e = with_form(entries.select(F.lit("entry").alias("kind"), F.col("entry_id").alias("id"), "title"))
    m = with_form(matches.select(F.lit("match").alias("kind"), F.col("match_id").alias("id"), "title"))
    return e.unionByName(m)
