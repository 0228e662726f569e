"""Put text right that was read with a wrong encoding, by structure alone.

For operators that classify text and have no language model at hand: damaged
lines count as what they were. Readings are accepted that are strict UTF-8, or
whose characters are common where those of the text are odd.
"""

from __future__ import annotations

import re
from functools import lru_cache

from folio.llm.encoding_repair import MULTI, SINGLE, _utf8_runs, _utf8_start, candidates

# one pattern for each: with both in one, every character would be tried twice
_ODD, _LATIN_RUN = re.compile("[\x80-\x9f�ㄛ﹝偟傪]"), re.compile("[\xa0-\xff]{3}")
_GB_UTF8 = re.compile(rb"(?:[\xe2-\xef][\x80-\xbf]{2}|[\xd0\xd1][\x80-\xbf]){3}")
_CJK = re.compile("[぀-鿿]")
_KOI = re.compile("[а-я][А-Я]{2}")
_COMMON = re.compile("[、-〠぀-ヿ！-？一-鿿А-яёà-öø-ü‘’“”–—…«»·À-É]+")
_CYRILLIC = re.compile("[Ѐ-ӿ]+")


_ASCII = re.compile(r"[\x00-\x7f]+")


def damaged(text: str) -> bool:
    """Whether any line may be damaged; cheap, and hardly ever false for a line that fix() changes alone."""
    if text.isascii():
        return False
    high = _ASCII.sub(" ", text).strip(" ")
    if _ODD.search(high) or _LATIN_RUN.search(high):
        return True
    if _CJK.search(high):
        return bool(_GB_UTF8.search(high.encode("gb18030", "ignore")))
    return bool(_KOI.search(high)) or any(_utf8_start(n).search(high) and _utf8_runs(n).search(high) for n in ("cp1252", "cp1251", "mac_roman"))


@lru_cache(20_000)
def fix(line: str) -> str:
    """The line as it was, if a reading makes its characters common; else the line."""
    high = _high(line)
    if not high:
        return line
    cyrillic = 2 * _length(_CYRILLIC, line) > high
    best, key, fewest = line, _share(line, high), high
    for r, chain in candidates(line, 2):
        utf8 = "utf-8" in chain
        if cyrillic and not chain.endswith(("utf-8", "utf-8*", "koi8_r", "cp1251")):
            continue  # any Cyrillic word is also pairs of bytes of some East Asian encoding
        n = _high(r)
        # bytes of a multi-byte encoding that happen to be strict UTF-8 are hardly chance in four characters
        sure = utf8 and chain.split(">")[0] in MULTI and chain.endswith("utf-8") and high >= 4 and " " not in chain
        if key + 0.05 >= 1 and not (utf8 and n < 0.8 * fewest) and not (sure and best is line):
            continue  # whatever its share, which is 1 at most
        k = _share(r, n)
        if k > key + 0.05 or (utf8 and k >= key - 0.2 and n < 0.8 * fewest) or (sure and best is line):
            best, key, fewest = r, k, n
    return best


def _high(s: str) -> int:
    """Characters beyond ASCII."""
    return len(s) - len(s.encode("ascii", "ignore"))


def _length(p: re.Pattern, s: str) -> int:
    return sum(map(len, p.findall(s)))


def _share(s: str, high: int) -> float:
    """Share of common characters among those beyond ASCII; words with the case turned over are uncommon."""
    return 1.0 if not high else (_length(_COMMON, s) - 3 * len(_KOI.findall(s))) / high
