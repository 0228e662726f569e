"""Assembly of logical chapters and operators that depend on order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folio.util import materialize, running, running_sum, with_previous

MAX_FAILURES = 5
MIN_BLOCK = 60
#: Positions of a book that one task keeps ranks over.
SHARE = 200_000


def in_order(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows with their position from 1 by key."""
    return running_sum(df, key, order, F.lit(1), "pos")


def blocks(text: Column) -> Column:
    """Blocks of a text, parted by blank lines."""
    return F.filter(F.transform(F.split(text, r"\r?\n[\s　]*\r?\n"), lambda x: F.trim(x)), lambda x: x != "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, r"[\s\p{Z}]+", "")


def recurrent_blocks(docs: DataFrame, book: str, doc: str, text: str) -> DataFrame:
    """(book, h, n_docs): blocks of 60 and more characters that stand in at least max(3, (n + 9) / 10) chapters of a book with 3 or more."""
    d = docs.select(F.col(book).alias("book"), F.col(doc).alias("doc"), F.col(text).alias("text")).where("book IS NOT NULL AND text IS NOT NULL")
    n = d.groupBy("book").agg(F.countDistinct("doc").alias("n"))
    b = d.select("book", "doc", F.explode(F.array_distinct(F.transform(F.filter(F.transform(blocks(F.col("text")), squeeze), lambda x: F.length(x) >= MIN_BLOCK), lambda x: F.md5(x)))).alias("h"))
    c = b.distinct().groupBy("book", "h").agg(F.count("*").alias("n_docs"))
    return c.join(n, "book").where((F.col("n") >= 3) & (F.col("n_docs") >= F.greatest(F.lit(3), F.floor((F.col("n") + 9) / 10)))).select("book", "h", "n_docs")


def remove_recurrent(docs: DataFrame, book: str, doc: str, text: str) -> DataFrame:
    """(doc, text, emptied): texts without their book's recurrent blocks, blocks joined by blank lines; texts without such a block stay as they are."""
    rep = recurrent_blocks(docs, book, doc, text)
    d = docs.select(F.col(book).alias("book"), F.col(doc).alias("doc"), F.col(text).alias("text"))
    hit = d.where("book IS NOT NULL AND text IS NOT NULL").select("book", "doc", F.explode(F.transform(blocks(F.col("text")), lambda x: F.md5(squeeze(x)))).alias("h")).join(rep.select("book", "h"), ["book", "h"], "left_semi")
    cut = hit.groupBy("doc").agg(F.collect_set("h").alias("cut"))
    kept = F.array_join(F.filter(blocks(F.col("text")), lambda x: ~F.array_contains("cut", F.md5(squeeze(x)))), "\n\n")
    out = d.join(cut, "doc", "left").select("doc", F.when(F.col("cut").isNull(), F.col("text")).otherwise(kept).alias("text"), F.col("cut").isNotNull().alias("was_cut"))
    return out.select("doc", "text", (F.col("was_cut") & (F.col("text") == "")).alias("emptied"))


def duplicate_texts(pages: DataFrame, key: str, page: str, text: str, least: int = 300) -> DataFrame:
    """(key, hash, n_pages, first_page): texts of at least ``least`` characters beside white space that several pages of a key share."""
    t = squeeze(F.col(text))
    p = pages.select(F.col(key).alias("key"), F.col(page).alias("page"), t.alias("t")).where("key IS NOT NULL").where(F.length("t") >= least)
    return p.select("key", F.md5("t").alias("hash"), "page").groupBy("key", "hash").agg(F.countDistinct("page").alias("n_pages"), F.min("page").alias("first_page")).where("n_pages > 1")


def part_runs(chapters: DataFrame, book: str = "book_id") -> DataFrame:
    """Chapters with the number, from 1, of the run of parts they belong to; see merge_parts."""
    c = with_previous(chapters.withColumn("__n", F.floor("number")), [book], ["pos"], ["__n", "sub_number"])
    goes_on = F.col("sub_number").isNotNull() & F.col("prev.sub_number").isNotNull() & (F.col("__n") == F.col("prev.__n")) & (F.col("sub_number") > F.col("prev.sub_number"))
    return running_sum(c, book, ["pos"], F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1), "run").drop("prev", "__n")


def merge_parts(chapters: DataFrame, book: str = "book_id") -> DataFrame:
    """(book, first_pos, n_parts, title, merged): runs of parts of one chapter as one row.

    Consecutive chapters with the same whole number merge if each has a part
    number and these ascend strictly; others stay alone. Input: book, pos,
    title, number, sub_number.
    """
    c = part_runs(chapters, book)
    return c.groupBy(book, "run").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n_parts"), F.min_by("title", "pos").alias("title")).select(book, "first_pos", "n_parts", "title", (F.col("n_parts") > 1).alias("merged"))


class Ranks:
    """Counts of whole numbers from 0, by their leading bits; as large as the numbers are different."""

    BITS = 40

    def __init__(self) -> None:
        self.n, self.at = 0, [{} for _ in range(self.BITS + 1)]

    def add(self, v: int, n: int = 1) -> None:
        self.n += n
        for b in range(self.BITS + 1):
            self.at[b][v >> b] = self.at[b].get(v >> b, 0) + n

    def nth(self, k: int) -> int:
        """The k-th smallest, from 1."""
        v = 0
        for b in range(self.BITS - 1, -1, -1):
            v <<= 1
            low = self.at[b].get(v, 0)
            if k > low:
                k, v = k - low, v + 1
        return v

    def median(self) -> int | None:
        return (self.nth((self.n + 1) // 2) + self.nth(self.n // 2 + 1)) // 2 if self.n else None


def running_median(chapters: DataFrame, book: str, order: list[str], length: str, ok: Column) -> DataFrame:
    """(book, pos, length, ok, median_prev): whole median of the lengths of good chapters before each one.

    A book's rows are parted into shares of consecutive positions; each share
    begins with the counts of the lengths before it and keeps ranks, no lists.
    """
    c = in_order(chapters.withColumn("ok", ok), book, order).select(book, "pos", length, "ok")
    c = materialize(c.withColumn("__share", F.floor((F.col("pos") - 1) / SHARE).cast("int")))
    counts = c.where("ok").groupBy(book, "__share", length).agg(F.count("*").alias("__k"))
    shares = c.where("__share > 0").select(book, "__share").distinct().withColumnRenamed("__share", "__to")
    own = counts.withColumnRenamed(book, "__book")
    past = own.join(shares, own["__book"].eqNullSafe(shares[book]) & (F.col("__share") < F.col("__to"))).groupBy(book, F.col("__to").alias("__share"), length).agg(F.sum("__k").alias("__k"))
    rows = c.withColumn("__k", F.lit(None).cast("bigint")).unionByName(past.select(book, F.lit(0).alias("pos"), length, F.lit(True).alias("ok"), "__share", "__k"))
    kind = {x: rows.schema[x].dataType.simpleString() for x in (book, length)}
    src = rows.repartition(book, "__share").sortWithinPartitions(book, "__share", "pos").select(book, "__share", "pos", length, "ok", "__k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cur, ranks = None, Ranks()
        for b in batches:
            med: list[int | None] = []
            for k, share, v, good, n in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4, 5)), strict=True):
                if (k, share) != cur:
                    cur, ranks = (k, share), Ranks()
                med.append(ranks.median() if n is None else None)
                if good and v is not None:
                    ranks.add(int(v), 1 if n is None else n)
            out = pa.RecordBatch.from_arrays([*(b.column(i) for i in (0, 2, 3, 4)), pa.array(med, pa.int64())], names=["b", "pos", "v", "ok", "m"])
            yield out.filter(b.column(5).is_null())

    return src.mapInArrow(run, f"b {kind[book]}, pos int, v {kind[length]}, ok boolean, m bigint").select(F.col("b").alias(book), "pos", F.col("v").alias(length), "ok", F.col("m").alias("median_prev"))


def failure_cut(rows: DataFrame, key: str, order: list[str], bad: Column, most: int = MAX_FAILURES) -> DataFrame:
    """(key, cut_pos): position of the row that completes the first run of ``most`` failures; keys without one have no row."""
    r = running(rows.select(key, *order, F.coalesce(bad, F.lit(False)).alias("bad")), key, order, {"pos": ("sum", F.lit(1)), "good": ("sum", (~F.col("bad")).cast("int"))})
    # failures with as many good rows before them are one run
    runs = r.where("bad").groupBy(key, "good").agg(F.count("*").alias("n"), F.min("pos").alias("first")).where(F.col("n") >= most)
    return runs.groupBy(key).agg((F.min("first") + most - 1).cast("int").alias("cut_pos"))


# -- pacing ------------------------------------------------------------------------------------------


def pace(state: tuple[float, int, int], shell: bool, base: float, top: float, factor: float, recover: int) -> tuple[float, int, int]:
    """(interval, streak, backoffs) after one more outcome: doubled at an empty shell, halved after a healthy streak."""
    interval, streak, backoffs = state
    if shell:
        return (interval, streak, backoffs) if base <= 0 else (min(top, max(interval, base) * factor), 0, backoffs + 1)
    streak += 1
    return (max(base, interval / factor), 0, backoffs) if streak >= recover else (interval, streak, backoffs)


def pacing_states(base: float, top: float, factor: float, recover: int) -> list[tuple[float, int]]:
    """Every (interval, streak) that outcomes can lead to from the start, which is the first: a few dozen."""
    out = [(max(0.0, base), 0)]
    seen = set(out)
    for interval, streak in out:
        for shell in (True, False):
            x = pace((interval, streak, 0), shell, base, top, factor, recover)[:2]
            if x not in seen:
                if len(out) >= 100_000:
                    raise ValueError("these settings of pacing lead to too many intervals")
                seen.add(x)
                out.append(x)
    return out


def pacing(rows: DataFrame, key: str, order: list[str], shell: Column, base: float = 0.3, top: float = 5.0, factor: float = 2.0, recover: int = 6) -> DataFrame:
    """(key, interval, streak, backoffs) after all outcomes of a key in their order.

    A key's rows are parted into shares of consecutive positions. What a share
    does to each state it may begin in is worked out at once, for states soon meet;
    a key's shares, one row each, are then followed from the start. Null keys have no row.
    """
    states = pacing_states(base, top, factor, recover)
    number = {x: i for i, x in enumerate(states)}
    kind = rows.schema[key].dataType.simpleString()
    src = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), *order, F.coalesce(shell, F.lit(False)).alias("shell"))
    src = in_order(src, "k", order).withColumn("share", F.floor((F.col("pos") - 1) / SHARE).cast("int"))
    src = src.repartition("k", "share").sortWithinPartitions("k", "share", "pos").select("k", "share", "shell")
    pa_kind = to_arrow_type(rows.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cur, ends, back, done = None, {}, 0, []

        def close() -> None:
            to = [0] * len(states)
            for x, starts in ends.items():
                for i in starts:
                    to[i] = number[x]
            done.append((*cur, to, back))

        for b in batches:
            for k, share, s in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if cur != (k, share):
                    if cur is not None:
                        close()
                    cur, back = (k, share), 0
                    ends = {x: [i] for i, x in enumerate(states)} if share else {states[0]: [0]}
                nxt: dict[tuple[float, int], list[int]] = {}
                for x, starts in ends.items():
                    nxt.setdefault(pace((*x, 0), s, base, top, factor, recover)[:2], []).extend(starts)
                ends = nxt
                back += bool(s) and base > 0
            if done:
                yield _batch(done)
                done = []
        if cur is not None:
            close()
            yield _batch(done)

    def _batch(rows_: list[tuple]) -> pa.RecordBatch:
        c = list(zip(*rows_, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa_kind), pa.array(c[1], pa.int32()), pa.array(c[2], pa.list_(pa.int32())), pa.array(c[3], pa.int32())], names=["k", "share", "to", "backoffs"])

    shares = src.mapInArrow(run, f"k {kind}, share int, to array<int>, backoffs int")
    g = shares.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("share", "to"))).alias("s"), F.sum("backoffs").cast("int").alias("backoffs"))
    last = F.aggregate("s", F.lit(0), lambda at, x: x["to"][at])
    each = lambda i: F.array(*[F.lit(x[i]) for x in states])
    return g.select(F.col("k").alias(key), "backoffs", last.alias("at")).select(key, each(0)[F.col("at")].alias("interval"), each(1)[F.col("at")].cast("int").alias("streak"), "backoffs")
