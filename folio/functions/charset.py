"""Decision on the encoding of captured bytes."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from charset_normalizer import from_bytes
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Declared labels and the codec that decodes them.
ALIASES = {
    "gb2312": "gb18030", "gbk": "gb18030", "cp936": "gb18030", "gb_2312": "gb18030", "utf8": "utf-8", "utf-8": "utf-8",
    "iso8859-1": "iso-8859-1", "latin1": "iso-8859-1", "windows-1252": "windows-1252", "cp1252": "windows-1252", "big5": "big5",
}
#: Declarations are looked for in so many bytes from the start.
SCAN = 4096
_META = re.compile(rb"<meta(?![^>]*http-equiv)[^>]*?charset\s*=\s*[\"']?\s*([\w-]+)", re.I)
_EQUIV = re.compile(rb"<meta[^>]+http-equiv\s*=\s*[\"']?content-type[\"']?[^>]*>", re.I)
_LABEL = re.compile(rb"charset\s*=\s*[\"']?\s*([\w-]+)", re.I)
_MARKS = (
    (codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"),
    (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"),
)


def normalize_charset(label: str | None) -> str | None:
    """Codec of a declared label, null for an unknown one."""
    if not label:
        return None
    low = label.strip().strip("\"'").lower()
    if low in ALIASES:
        return ALIASES[low]
    try:
        return codecs.lookup(low).name
    except LookupError:
        return None


def _declared(raw: bytes) -> tuple[str | None, str | None]:
    head = raw[:SCAN]
    m = _META.search(head)
    e = _EQUIV.search(head)
    x = _LABEL.search(e.group()) if e else None
    name = lambda y: normalize_charset(y.group(1).decode("ascii", "ignore")) if y else None
    return name(m), name(x)


def decide(raw: bytes | None, http_label: str | None) -> tuple[str, str, float, bool] | None:
    """(encoding, source, confidence, conflict): byte-order mark, HTTP header, meta, http-equiv, statistics, UTF-8."""
    if raw is None:
        return None
    for mark, name in _MARKS:
        if raw.startswith(mark):
            return name, "bom", 0.99, False
    http = normalize_charset(http_label)
    meta, equiv = _declared(raw)
    inside = meta or equiv
    conflict = bool(http and inside and http != inside)
    if http:
        return http, "http_header", 0.80 if conflict else 0.90, conflict
    if meta:
        return meta, "meta_charset", 0.85, False
    if equiv:
        return equiv, "meta_http_equiv", 0.80, False
    best = from_bytes(raw).best()
    if best is not None and best.encoding:
        return normalize_charset(best.encoding) or best.encoding, "charset_normalizer", 0.70, False
    return "utf-8", "utf8_fallback", 0.30, False


def decode_page(raw: bytes | None, http_label: str | None) -> tuple[str, str, str, float, bool] | None:
    """Text, encoding, source, confidence less a penalty for what could not be decoded, and whether declarations conflict."""
    d = decide(raw, http_label)
    if d is None:
        return None
    text = raw.decode(d[0], "replace")
    lost = text.count("�") / len(text) if text else 0.0
    return text, d[0], d[1], max(0.05, d[2] - min(0.6, 20 * lost)), d[3]


def decode_captures(captures: DataFrame, raw_col: str = "raw_bytes", header_col: str = "content_type") -> DataFrame:
    """Captured bytes with text, encoding, encoding_source, encoding_confidence and charset_conflict; null bytes give nulls."""

    @F.pandas_udf("text string, encoding string, encoding_source string, encoding_confidence double, charset_conflict boolean")
    def run(raw: pd.Series, header: pd.Series) -> pd.DataFrame:
        rows = []
        for r, h in zip(raw, header, strict=True):
            m = re.search(r"charset\s*=\s*\"?([\w-]+)", h, re.I) if h else None
            rows.append(decode_page(None if r is None else bytes(r), m.group(1) if m else None) or (None,) * 5)
        return pd.DataFrame(rows, columns=["text", "encoding", "encoding_source", "encoding_confidence", "charset_conflict"])

    keep = [c for c in captures.columns if c not in (raw_col, header_col)]
    return captures.withColumn("__d", run(F.col(raw_col), F.col(header_col))).select(*keep, "__d.*")
