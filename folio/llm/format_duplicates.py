"""Records that differ only in formatting (problem 4).

Progressive partition refinement in three steps, each inside the classes of the
one before that have several members: how often each figure stands in the title
and url, counted without patterns; then the lengths and a hash of the letter
histograms of what formatting can't change; then the canonical keys themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.util import materialize, skew_safe_join

# What formatting may change. White space of any kind, all
# punctuation, and the symbols of ASCII and their full-width forms that serve as
# punctuation. Letters, figures, combining marks and other symbols count.
NOISE = r"[\s\p{Z}\p{Cc}\p{P}$+<=>^`|~＄＋＜＝＞＾｀｜～￨]+"
FIELD_BARS = r"[|｜￨]"


def fold(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), NOISE, "")


def histogram_key(c: Column) -> Column:
    """Hash of the sorted characters of a folded text: equal for any order of its fields."""
    return F.xxhash64(F.array_join(F.array_sort(F.split(c, "")), ""))


def _sorted_fields(c: Column, bars: str) -> Column:
    """Folded fields in a fixed order; U+001F can't occur in a folded field."""
    return F.array_join(F.array_sort(F.filter(F.transform(F.split(c, bars), fold), lambda x: x != "")), "\u001f")


def title_key(title: Column) -> Column:
    return _sorted_fields(title, FIELD_BARS)


def url_key(url: Column) -> Column:
    """Path, then the query parameters in a fixed order, then the fragment."""
    before = F.regexp_extract(url, r"(?s)^([^#]*)", 1)
    fragment = F.regexp_extract(url, r"(?s)^[^#]*#(.*)$", 1)
    path = F.regexp_extract(before, r"(?s)^([^?]*)", 1)
    query = F.regexp_extract(before, r"(?s)^[^?]*\?(.*)$", 1)
    return F.concat_ws("\u001e", fold(path), _sorted_fields(query, "[&;]"), fold(fragment))


def figures_key(title: Column, url: Column) -> Column:
    """How often each figure stands in title and url: the same for any formatting, order of fields and letter case, and cheap."""
    def counts(c: Column) -> list[Column]:
        return [F.octet_length(c) - F.octet_length(F.replace(c, F.lit(d), F.lit(""))) for d in "0123456789"]

    return F.xxhash64(*counts(url), F.coalesce(F.octet_length(title) - F.octet_length(F.translate(title, "0123456789", "")), F.lit(-1)), url.isNull())


def stripped_key(title: Column, url: Column) -> Column:
    """Lengths and letter histograms of what formatting can't change."""
    t, u = fold(title), fold(url)
    return F.xxhash64(F.coalesce(F.length(t), F.lit(-1)), F.coalesce(F.length(u), F.lit(-1)), F.coalesce(histogram_key(t), F.lit(0)), F.coalesce(histogram_key(u), F.lit(0)))


def _several(rows: DataFrame, key: str, total: int) -> DataFrame:
    """Rows of the classes with several members; a class may hold a third of all rows."""
    classes = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return skew_safe_join(rows, classes, [key], "n", total).drop(key)


def refine(df: DataFrame, id_col: str = "entry_id", title_col: str = "title", url_col: str = "url") -> tuple[DataFrame, DataFrame, int]:
    """Members (id, k_title, k_url) of classes that may have several, the groups with several, and the number of members.

    Groups: k_title, k_url, keep_id (smallest id), copies (number of rows).
    Null titles (urls) equal each other and differ from empty ones. Ids that are
    null are no records. Other columns may have any name; they are not read.
    """
    base = df.select(F.col(id_col).alias("id"), F.col(title_col).alias("t"), F.col(url_col).alias("u")).where("id IS NOT NULL")
    # the first key is so cheap that it is computed again rather than written
    first = _several(base.withColumn("figures", figures_key(F.col("t"), F.col("u"))), "figures", base.count())
    second = materialize(first.withColumn("stripped", stripped_key(F.col("t"), F.col("u"))))
    third = _several(second, "stripped", second.count())
    keyed = materialize(third.select("id", title_key(F.col("t")).alias("k_title"), url_key(F.col("u")).alias("k_url")))
    groups = keyed.groupBy("k_title", "k_url").agg(F.min("id").alias("keep_id"), F.count("*").alias("copies")).where("copies > 1")
    return keyed, groups, keyed.count()


def copies(df: DataFrame, **cols: str) -> DataFrame:
    """(keep_id, copy_id): every record that repeats another but for formatting, beside the smallest id of its group."""
    keyed, groups, members = refine(df, **cols)
    j = skew_safe_join(keyed, groups, ["k_title", "k_url"], "copies", members)
    return j.where("id <> keep_id").select("keep_id", F.col("id").alias("copy_id")).distinct()


def collapse(df: DataFrame, **cols: str) -> DataFrame:
    """(entry_id, copies): one row per distinct record with its number of rows."""
    id_col = cols.get("id_col", "entry_id")
    keyed, groups, _ = refine(df, **cols)
    repeated = skew_safe_join(keyed, groups.withColumn("n", F.col("copies")), ["k_title", "k_url"], "n", keyed.count())
    extra = repeated.where("id <> keep_id").select(F.col("id").alias("entry_id"))
    kept = groups.select(F.col("keep_id").alias("entry_id"), "copies")
    singles = df.select(F.col(id_col).alias("entry_id")).where("entry_id IS NOT NULL").join(extra, "entry_id", "left_anti")
    return singles.join(kept, "entry_id", "left").select("entry_id", F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"))
