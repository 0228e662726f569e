"""URL functions as Column expressions (no Python in the plan)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that number the pages of a list, in the order they are looked for.
PAGE_KEYS = ("page", "p", "pg", "pageindex", "page_index", "pageno")


def normalize_url(url: Column) -> Column:
    """Trimmed, without the fragment; query and case are kept. Null stays null."""
    return F.regexp_replace(F.trim(url), r"(?s)#.*$", "")


def authority(url: Column) -> Column:
    """Lower-case host with its port, if any; null without one."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """Path as written, empty without one."""
    rest = F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*", "")
    return F.regexp_extract(rest, r"^([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def directory(url: Column) -> Column:
    """Path up to, without, its last slash; empty without a slash. The host is not part of it."""
    return F.regexp_extract(path(url), r"(?s)^(.*)/[^/]*$", 1)


def same_directory(a: Column, b: Column) -> Column:
    return directory(a) == directory(b)


def page_number(url: Column) -> Column:
    """The number of a page of a list: a query parameter, else a file name, else 1 for an index page, else null."""
    q = query(url)
    p = path(url)
    by_key = [F.nullif(F.regexp_extract(q, rf"(?i)(?:^|&){k}=([0-9]{{1,4}})(?:&|$)", 1), F.lit("")) for k in PAGE_KEYS]
    by_name = F.nullif(F.regexp_extract(p, r"(?i)[_\-]([0-9]{1,4})\.s?html?$", 1), F.lit(""))
    first = F.when(p.rlike(r"(?i)(?:index|list|catalog|default)\.s?html?$"), F.lit("1"))
    return F.coalesce(*by_key, by_name, first).cast("int")


def trimmed(url: Column) -> Column:
    """Without the white space that may stand around an address in markup."""
    return F.btrim(url, F.lit(" \t\r\n\f"))


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of a link: absolute, protocol-relative, root-relative, query-only and relative ones, with dot segments removed."""
    base, href = trimmed(base), trimmed(href)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    stem = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.concat(site, F.when(path(base) == "", F.lit("")).otherwise(directory(base)), F.lit("/"))
    joined = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(site, href))
        .when(href.startswith("?"), F.concat(stem, href))
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), href))
        .when(href == "", base)
        .otherwise(F.concat(folder, href))
    )
    dots = joined.rlike(r"/\.\.?(?:/|$|[?#])")
    head = F.regexp_extract(joined, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    tail = F.regexp_extract(joined, r"^[^?#]*(.*)$", 1)
    parts = F.split(path(joined), "/")
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))),
    )
    slash = F.when(path(joined).rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    return F.when(dots, F.concat(head, F.lit("/"), F.array_join(kept, "/"), slash, tail)).otherwise(joined)


def url_similarity(a: Column, b: Column) -> Column:
    """1 if the last numbers of two paths in one directory are neighbours, 0.5 for one directory, else 0."""
    na = F.try_element_at(F.regexp_extract_all(path(a), F.lit(r"([0-9]+)"), F.lit(1)), F.lit(-1)).try_cast("bigint")
    nb = F.try_element_at(F.regexp_extract_all(path(b), F.lit(r"([0-9]+)"), F.lit(1)), F.lit(-1)).try_cast("bigint")
    near = F.coalesce(F.abs(na - nb) == 1, F.lit(False))
    return F.when(~same_directory(a, b), 0.0).when(near, 1.0).otherwise(0.5)


def usable_href(href: Column) -> Column:
    return (href != "") & ~href.startswith("javascript:") & ~href.startswith("#") & ~href.startswith("mailto:")
