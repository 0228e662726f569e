"""Chapter-title grammar as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numerals, units and sections of Chinese numbers.
CN_DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
CN_UNITS = {"十": 10, "百": 100, "千": 1000}
CN_SECTIONS = {"万": 10000, "亿": 100000000}
# Keywords of chapters without a number, and their kind.
SPECIAL = {
    "序章": "prologue", "序幕": "prologue", "序言": "prologue", "楔子": "prologue", "引言": "prologue", "序": "prologue",
    "终章": "epilogue", "尾声": "epilogue", "大结局": "epilogue", "结局": "epilogue",
    "后记": "afterword", "跋": "afterword",
    "番外": "extra", "番外篇": "extra", "外传": "extra", "特别篇": "extra",
    "间章": "interlude", "幕间": "interlude", "插章": "interlude",
}
# Characters trimmed from the ends of a title.
TRIMMED = " \t\r\n　【】〔］[]「」『』《》〈〉\"'“”‘’（）()"
# The grammar of numbered titles.
NUM = r"(?:[0-9]+(?:\.[0-9]+)?|[零〇一二两三四五六七八九十百千万亿]+)"
GAP = r"[:：\-—_\s　]*"
SP = r"[\s　]*"


def _numeral_map(d: dict[str, int]) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def chinese_numeral(text: Column) -> Column:
    """Value of a Chinese numeral, null for other characters and for values below 1.

    A digit replaces a digit before it; a unit without a digit counts once; a
    section multiplies what came before it since the last section.
    """
    digits, units, sections = _numeral_map(CN_DIGITS), _numeral_map(CN_UNITS), _numeral_map(CN_SECTIONS)
    zero = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("part"), F.lit(0).cast("bigint").alias("digit"), F.lit(True).alias("ok"))

    def state(total: Column, part: Column, digit: Column, ok: Column) -> Column:
        return F.struct(total.cast("bigint").alias("total"), part.cast("bigint").alias("part"), digit.cast("bigint").alias("digit"), ok.alias("ok"))

    def step(a: Column, c: Column) -> Column:
        d, u, s = F.try_element_at(digits, c), F.try_element_at(units, c), F.try_element_at(sections, c)
        base = F.when((a["part"] == 0) & (a["digit"] == 0), F.lit(1)).otherwise(a["part"] + a["digit"])
        return (
            F.when(d.isNotNull(), state(a["total"], a["part"], d, a["ok"]))
            .when(u.isNotNull(), state(a["total"], a["part"] + F.greatest(a["digit"], F.lit(1)) * u, F.lit(0), a["ok"]))
            .when(s.isNotNull(), state(a["total"] + base * s, F.lit(0), F.lit(0), a["ok"]))
            .otherwise(state(a["total"], a["part"], a["digit"], F.lit(False)))
        )

    t = F.regexp_replace(text, r"^[\s　]+|[\s　]+$", "")
    value = F.aggregate(F.filter(F.split(t, ""), lambda c: c != ""), zero, step, lambda a: F.when(a["ok"], a["total"] + a["part"] + a["digit"]))
    return let(value, lambda v: F.when(v > 0, v))


def clean_title(text: Column) -> Column:
    """Full-width figures as ASCII, brackets, quotes and spaces trimmed from the ends only."""
    return F.btrim(F.translate(text, "０１２３４５６７８９．", "0123456789."), F.lit(TRIMMED))


def to_number(raw: Column) -> Column:
    cn = raw.rlike("[零〇一二两三四五六七八九十百千万亿]")
    return F.when(cn, chinese_numeral(raw).cast("double")).otherwise(raw.try_cast("double"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


NUMBERED = rf"^第{SP}({NUM}){SP}([章节回话篇卷部]){GAP}(.*)$"
VOLUME = rf"^([卷部]){SP}({NUM}){GAP}(.*)$"
ENGLISH = r"(?i)^chapter[\s　]*([0-9]+(?:\.[0-9]+)?)[\s　]*[:：\-—_.\s　]*(.*)$"
KEYWORD = rf"^({'|'.join(sorted(SPECIAL, key=len, reverse=True))})[\s　]*{GAP}(.*)$"
LOOSE = rf"第{SP}({NUM}){SP}[章节回话篇卷部]"
SUB = r"^[\s　:：\-—_(（]*([0-9]{1,4})[)）\s　:：\-—_]*$"


def parse_title(text: Column) -> Column:
    """Struct (title, chapter_number, chapter_type, order_token, confidence, sub_number); null if the text is no chapter title."""
    kinds = F.create_map(*[F.lit(x) for kv in SPECIAL.items() for x in kv])
    none = F.lit(None)

    def g(t: Column, pattern: str, i: int) -> Column:
        return F.nullif(F.regexp_extract(t, pattern, i), F.lit(""))

    def full(t: Column, number: Column, kind: Column, token: Column, conf: Column, sub: Column) -> Column:
        return F.struct(
            t.alias("title"), number.cast("double").alias("chapter_number"), kind.cast("string").alias("chapter_type"), token.cast("double").alias("order_token"),
            conf.cast("double").alias("confidence"), sub.cast("int").alias("sub_number"),
        )

    def anchored(rest: Column) -> Column:
        return F.when(rest == "", F.lit(0.95)).otherwise(F.lit(0.92))

    def by_rule(v: Column) -> Column:
        """v: the cleaned title, the rule that holds, the number as written and what follows it."""
        t, rule, raw, rest, word = v["t"], v["rule"], v["raw"], v["rest"], v["word"]
        sub = F.when((rule == 1) & ~raw.contains("."), F.nullif(F.regexp_extract(rest, SUB, 1), F.lit("")).try_cast("int"))

        def with_number(n: Column) -> Column:
            number, part = n["n"], n["s"]
            kind = F.when((rule == 2) | word.isin("卷", "部"), F.lit("volume")).when(rule == 4, F.try_element_at(kinds, word)).otherwise(F.lit("normal"))
            conf = F.when(rule == 4, F.when(rest == "", F.lit(0.90)).otherwise(F.lit(0.85))).when(rule == 5, F.lit(0.55)).otherwise(anchored(rest))
            return F.when((rule == 4) | number.isNotNull(), full(t, number, kind, number + F.coalesce(part, F.lit(0)) / 10000.0, conf, part))

        return let(F.struct(to_number(raw).alias("n"), sub.alias("s")), with_number)

    def pick(t: Column) -> Column:
        # the number of an anchored rule may turn out to be none; then the next rule holds
        numeral = r"[零〇一二两三四五六七八九十百千万亿]"
        def good(pattern: str, i: int) -> Column:
            raw = F.regexp_extract(t, pattern, i)
            return t.rlike(pattern) & (~raw.rlike(numeral) | raw.rlike("[一二两三四五六七八九十百千万亿]"))

        def row(rule: int, raw: Column, rest: Column, word: Column) -> Column:
            return F.struct(t.alias("t"), F.lit(rule).alias("rule"), raw.alias("raw"), F.coalesce(F.trim(rest), F.lit("")).alias("rest"), F.coalesce(word, F.lit("")).alias("word"))

        after = F.trim(F.regexp_extract(t, KEYWORD, 2))
        lead = F.nullif(F.regexp_extract(after, rf"^({NUM})(?:[^\p{{L}}\p{{N}}_]|$)", 1), F.lit(""))
        chosen = (
            F.when(good(NUMBERED, 1), row(1, g(t, NUMBERED, 1), g(t, NUMBERED, 3), g(t, NUMBERED, 2)))
            .when(good(VOLUME, 2), row(2, g(t, VOLUME, 2), g(t, VOLUME, 3), none.cast("string")))
            .when(t.rlike(ENGLISH), row(3, g(t, ENGLISH, 1), g(t, ENGLISH, 2), none.cast("string")))
            .when(t.rlike(KEYWORD), row(4, lead, after, g(t, KEYWORD, 1)))
            .when(good(LOOSE, 1), row(5, g(t, LOOSE, 1), none.cast("string"), none.cast("string")))
        )
        return F.when(t != "", let(chosen, by_rule))

    return let(clean_title(text), pick)


def strip_sub_number(title: Column) -> Column:
    """The title without a bare part number at its end."""
    t = F.trim(title)
    return F.regexp_replace(t, r"^(第[\s　]*[0-9零〇一二两三四五六七八九十百千万]+[\s　]*[章节回话篇])[\s　:：\-—_(（]*[0-9]{1,4}[)）\s　:：\-—_]*$", "$1")


# Marks of the pages of a chapter in its title.
PAGE_MARK = r"[（(]\s*第\s*[0-9]+\s*页\s*[)）]|[（(]\s*[0-9]+\s*/\s*[0-9]+\s*[)）]"
PAGE_SUFFIX = r"(?:\s*(?:[（(]\s*(?:第\s*[0-9]+\s*页|[0-9]+\s*/\s*[0-9]+|[0-9]+)\s*[)）]|[_\-][0-9]{1,3}|第\s*[0-9]+\s*页))+\s*$"


def has_page_marker(title: Column) -> Column:
    """Whether the title names a page of a chapter: (第2页), (2/3)."""
    return title.rlike(PAGE_MARK)


def strip_page_suffix(title: Column) -> Column:
    """The title without any page decorations at its end."""
    return F.trim(F.regexp_replace(F.trim(title), PAGE_SUFFIX, ""))
