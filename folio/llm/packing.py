"""Filling fixed-capacity containers (problem 7).

Bounded-space online packing: every task keeps a fixed number of open windows,
places each item into the one it fits best, and emits the fullest window when an
item fits none. The windows left open at the end of the tasks are merged as items
of their own, in rounds of fewer and fewer tasks.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.splitting import as_bytes, running_ends
from folio.util import materialize

#: Open windows of a task: about as many as an Arrow batch fills. A window takes a few hundred bytes of memory.
OPEN_WINDOWS = 4096
#: Windows that one task of a merge round takes in.
MERGE_ROWS = 200_000
#: Rounds that window ids have room for (bits 58 to 62); each but the last merges something.
MOST_ROUNDS = 31


class Windows:
    """Best fit into at most ``limit`` open windows of ``capacity``."""

    def __init__(self, capacity: int, limit: int, tag: int):
        self.capacity, self.limit, self.tag = capacity, limit, tag
        self.free: list[tuple[int, int]] = []  # (free space, window), ascending
        self.made = 0

    def place(self, size: int) -> int:
        """The window the item goes into."""
        i = bisect_left(self.free, (size, -1))
        if i < len(self.free):
            room, w = self.free.pop(i)
        else:
            if len(self.free) >= self.limit:
                self.free.pop(0)  # the fullest leaves for good
            room, w = self.capacity, self.tag + self.made
            self.made += 1
        if room > size:
            insort(self.free, (room - size, w))
        return w


def _pieces(df: DataFrame, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, piece_no, start_token, n_tokens): one row for each text, several only for one above the capacity.

    An oversized text is cut after as many whole characters as a container
    holds, so all its pieces but the last fill a container.
    """
    t = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__t"))
    n = F.coalesce(F.octet_length("__t"), F.lit(0))
    small = t.where(n <= capacity).select(
        "doc_id", F.lit(1).alias("piece_no"), F.lit(0).alias("start_token"), n.alias("n_tokens")
    )
    latin = as_bytes(F.col("__t"))  # one character a token
    parts = F.regexp_extract_all(latin, F.lit(rf"(?s).{{1,{capacity}}}(?![\x80-\xBF])"), F.lit(0))
    t_large = t.where(n > capacity).select("doc_id", F.transform(parts, lambda x: F.length(x)).alias("l"))
    large = t_large.select("doc_id", F.posexplode_outer(F.arrays_zip(running_ends(F.col("l")).alias("e"), "l")).alias("i", "p")).select(
        "doc_id", (F.col("i") + 1).alias("piece_no"), (F.col("p.e") - F.col("p.l")).alias("start_token"), F.col("p.l").alias("n_tokens")
    )
    return small.unionByName(large)


def _round(items: DataFrame, capacity: int, windows: int, keep: list[str], size: str, first: int) -> DataFrame:
    """Place items: their ``keep`` columns, window id, and whether the window is still open at the end of the task.

    Within an Arrow batch larger items go first, which leaves the small ones to
    fill the gaps; the memory of a task is a batch and its open windows.
    """
    fields = [f for f in items.schema.fields if f.name in keep]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        w = Windows(capacity, windows, first + (ctx.partitionId() << 34))
        for b in batches:
            sizes = b.column(b.schema.get_field_index(size)).to_numpy(zero_copy_only=False)
            order = (-sizes).argsort(kind="stable")
            got = [0] * len(sizes)
            for i in order.tolist():
                got[i] = w.place(int(sizes[i]))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in names] + [pa.array(got, pa.int64())], names=[*names, "window"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return items.mapInArrow(run, f"{schema}, window bigint")


def pack(df: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text", windows: int = OPEN_WINDOWS) -> DataFrame:
    """(doc_id, piece_no, start_token, n_tokens, container): the container of each text or piece.

    No container holds more than ``capacity`` tokens; only a text above it is
    split. Null and empty texts take 0 tokens and get a container as any other.
    Rows with the same id are placed each by itself. An empty table gives no rows.
    """
    if capacity < 4:
        raise ValueError("a container must hold at least one character: 4 tokens")
    cols = ["doc_id", "piece_no", "start_token", "n_tokens"]
    placed = materialize(_round(_pieces(df, capacity, id_col, text_col), capacity, windows, cols, "n_tokens", 0))
    current = materialize(placed.groupBy("window").agg(F.sum("n_tokens").cast("int").alias("fill")))
    moves, step = None, 1  # window -> container, over all rounds
    while True:
        least = current.agg(F.min("fill")).first()[0]
        if least is None:
            break
        # a window that has no room for the least filled one can't be merged with any
        open_ = current.where(F.col("fill") + least <= capacity)
        n = open_.count()
        if n < 2:
            break
        tasks = -(-n // MERGE_ROWS)
        # range partitioning by fill would give one task all the full ones; a hash of the id and round mixes them
        spread = open_.repartition(tasks, F.xxhash64("window", F.lit(step))) if tasks > 1 else open_.coalesce(1)
        merged = materialize(_merge(spread, capacity, max(windows, min(n, MERGE_ROWS)), step))
        moves = merged.select("window", F.col("target").alias("container")) if moves is None else _chained(moves, merged)
        current = materialize(merged.groupBy(F.col("target").alias("window")).agg(F.sum("fill").cast("int").alias("fill")))
        if tasks == 1 or current.count() == n:  # all windows met in one task, or none found another
            break
        step += 1
        if step > MOST_ROUNDS:
            raise RuntimeError("windows still merge after as many rounds as ids have room for")
    if moves is None:
        return placed.withColumnRenamed("window", "container")
    return placed.join(moves, "window", "left").select(*cols, F.coalesce("container", "window").alias("container"))


def _chained(moves: DataFrame, merged: DataFrame) -> DataFrame:
    """Moves of the rounds so far, led on by those of one more round."""
    nxt = merged.select(F.col("window").alias("container"), "target")
    return moves.join(nxt, "container", "left").select("window", F.coalesce("target", "container").alias("container"))


def _merge(items: DataFrame, capacity: int, windows: int, step: int) -> DataFrame:
    """(window, fill, target): windows placed as items into windows of the next round, larger ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows).combine_chunks()
        fill = t.column("fill").to_numpy()
        w = Windows(capacity, windows, (step << 58) + (TaskContext.get().partitionId() << 34))
        got = [0] * len(fill)
        for i in (-fill).argsort(kind="stable").tolist():
            got[i] = w.place(int(fill[i]))
        yield pa.RecordBatch.from_arrays([t.column("window").combine_chunks(), t.column("fill").combine_chunks(), pa.array(got, pa.int64())], names=["window", "fill", "target"])

    return items.select("window", "fill").mapInArrow(run, "window bigint, fill int, target bigint")


def oversized(packed: DataFrame) -> DataFrame:
    """(doc_id): of packed texts those that were split over several containers."""
    return packed.where("piece_no = 2").select("doc_id").distinct()


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """One row on packed texts: (tokens, unsplit, split, containers_over, bound_kept).

    containers_over: containers with more than the capacity; bound_kept: there are
    at most twice as many containers as the tokens fill, and one, as where no two
    containers fit into one.
    """
    c = packed.groupBy("container").agg(F.sum("n_tokens").alias("t"), F.count_if(F.col("piece_no") == 1).alias("first"), F.count_if(F.col("piece_no") == 2).alias("second"))
    return c.agg(
        F.coalesce(F.sum("t"), F.lit(0)).cast("bigint").alias("tokens"),
        F.coalesce(F.sum("first") - F.sum("second"), F.lit(0)).cast("bigint").alias("unsplit"), F.coalesce(F.sum("second"), F.lit(0)).cast("bigint").alias("split"),
        F.count_if(F.col("t") > capacity).alias("containers_over"), (F.count("*") <= 2 * F.ceil(F.coalesce(F.sum("t"), F.lit(0)) / capacity) + 1).alias("bound_kept"),
    )
