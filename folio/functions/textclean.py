"""Line cleaning of chapter texts."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folio.functions.titles import let, parse_title, strip_page_suffix

# Words of navigation lines.
NAV_TOKENS = (
    "上一章", "下一章", "目录", "返回目录", "章节目录", "全部章节", "章节列表",
    "上一页", "下一页", "上页", "下页", "上一节", "下一节", "上一回", "下一回",
    "首页", "书页", "书签", "加入书签", "保存书签", "阅读记录", "推荐票", "投推荐票", "求收藏",
    "返回书页", "回目录", "上一卷", "下一卷",
    "prev", "previous", "next", "contents", "table of contents", "chapter list",
)
# Fixed value: symbols that part the words of a navigation line.
NAV_SPLIT = r"[\s　→←\-—=~·、,，。;；:：|/\\»«‹›➤➜►▸★☆\[\]()（）【】\"'“”]+"
# Prompts of sites between the lines of a text.
SITE_PROMPTS = (
    r"点击?(下一页|继续阅读|下一章节?继续)", r"请?记住(本站|本书|我们)(首发)?(域名|网址|地址)", r"首发(网址|域名|地址)",
    r"本站(网址|域名|地址)", r"天才一秒记住", r"最新章节.{0,8}(请到|就在|网址)", r"手机(版?|阅读).{0,10}(访问|网址)",
    r"举报(本章|章节)?错误", r"章节错误.{0,6}(举报|联系)", r"为您(提供|推荐)",
)
INDENT = "　　"


def is_nav_line(line: Column) -> Column:
    """A short line of navigation words only, parted by symbols or glued together."""
    low = F.lower(line)
    tokens = F.filter(F.split(low, NAV_SPLIT), lambda x: x != "")
    words = F.array(*[F.lit(w) for w in NAV_TOKENS])
    glued = "|".join(re.escape(w) for w in sorted(NAV_TOKENS, key=len, reverse=True))
    bare = F.regexp_replace(low, rf"^{NAV_SPLIT}|{NAV_SPLIT}$", "")
    return (F.length(line) > 0) & (F.length(line) <= 30) & (
        F.array_contains(words, bare) | low.rlike(f"^(?>{glued})+$") | ((F.size(tokens) > 0) & F.forall(tokens, lambda x: F.array_contains(words, x)))
    )


def is_site_prompt(line: Column) -> Column:
    return (F.length(line).between(1, 100)) & line.rlike("|".join(SITE_PROMPTS))


def is_page_number_line(line: Column) -> Column:
    # fixed value: the pattern of a line that only numbers a page
    return (F.length(line).between(1, 12)) & line.rlike(r"^[0-9\s　/页第\-_（()）.]+$")


def _squeeze(c: Column) -> Column:
    return F.regexp_replace(strip_page_suffix(c), r"[\s　]+", "")


def known_title(title: Column) -> Column:
    """What is_duplicate_title needs of a title, for many lines at once."""
    p = parse_title(title)
    return F.struct(title.alias("title"), _squeeze(title).alias("squeezed"), (p["confidence"] >= 0.85).alias("strong"), p["order_token"].alias("order"), p["sub_number"].alias("sub"))


def is_duplicate_title(line: Column, known: Column) -> Column:
    """The chapter's own title (see known_title) again: equal but for white space and page marks, or the same number in the grammar."""
    def same(a: Column) -> Column:
        return (a["confidence"] >= 0.85) & (a["order_token"] == known["order"]) & a["sub_number"].eqNullSafe(known["sub"])

    # the grammar is tried on short lines only, and only against a title that it reads
    again = F.when(F.coalesce(known["strong"], F.lit(False)) & (F.length(line) <= 80), let(parse_title(line), same))
    return (known["title"] != "") & ((_squeeze(line) == known["squeezed"]) | F.coalesce(again, F.lit(False)))


@F.pandas_udf(StringType())
def unescape_and_compose(s: pd.Series) -> pd.Series:
    """Entities resolved, tags of at most 200 characters dropped, then NFC: what Catalyst has no expression for."""
    return s.map(lambda x: unicodedata.normalize("NFC", re.sub(r"<[^<>]{1,200}>", "", html.unescape(x))), na_action="ignore")


def tidy(text: Column) -> Column:
    """Line feeds only, without invisible and control characters."""
    # fixed value: invisible and control characters
    t = F.regexp_replace(text, r"\r\n?", "\n")
    return F.regexp_replace(t, "[​‌‍⁠﻿­\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f]", "")


def clean_lines(text: Column, title: Column) -> Column:
    """Lines that stay: stripped, not empty, and neither navigation, prompt, page number nor the title again."""
    lines = F.transform(F.split(tidy(text), "\n"), lambda x: F.regexp_replace(x, r"^[\s　 ]+|[\s　 ]+$", ""))
    both = F.struct(lines.alias("lines"), known_title(F.coalesce(title, F.lit(""))).alias("title"))
    return let(both, lambda b: F.filter(b["lines"], lambda x: (x != "") & ~is_nav_line(x) & ~is_site_prompt(x) & ~is_page_number_line(x) & ~is_duplicate_title(x, b["title"])))


def clean_text(text: Column, title: Column) -> Column:
    """Cleaned text: each kept line indented by two ideographic spaces, parted by blank lines."""
    return F.array_join(F.transform(clean_lines(unescape_and_compose(text), title), lambda x: F.concat(F.lit(INDENT), x)), "\n\n")


def safe_filename(name: Column) -> Column:
    """A file name any system takes: no illegal characters, at most 80 long, no device name."""
    # fixed values: characters and names that file systems refuse
    x = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"^[\s　]+|[\s　]+$", "")
    x = F.regexp_replace(x, r"[. ]+$", "")
    x = F.regexp_replace(F.left(x, F.lit(80)), r"[. ]+$", "")
    return F.when(x == "", F.lit("_")).when(F.upper(x).rlike(r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"), F.concat(F.lit("_"), x)).otherwise(x)
