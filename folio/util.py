"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that holds at least this fraction of all rows counts as heavy; at most
#: 1 / HEAVY_FRACTION keys can, which bounds the broadcast of heavy keys.
HEAVY_FRACTION = 1.0 / 1024


def build_session(app: str = "folio", master: str | None = None, partitions: int | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings the operators are designed for (AQE, UTC, Arrow)."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in (conf or {}).items():
        b = b.config(k, v)
    return b.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once per application, so that they need no path of their own."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = os.path.dirname(os.path.abspath(__file__))
    own = tempfile.mkdtemp(prefix="folio-code-")
    path = os.path.join(own, "folio.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("folio", os.path.relpath(full, root)))
    sc.addPyFile(path)
    atexit.register(shutil.rmtree, own, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; only a local session without it falls back to a temporary folder."""
    d = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"folio-{os.getpid()}")
    atexit.register(shutil.rmtree, own, True)
    return own


_made: list[str] = []


def cleanup(spark: SparkSession) -> int:
    """Delete the tables that materialize() wrote, once their results are no longer read; returns their number."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_made)
    while _made:
        p = jvm.org.apache.hadoop.fs.Path(_made.pop())
        p.getFileSystem(conf).delete(p, True)
    return n


def materialize(df: DataFrame, *by: str) -> DataFrame:
    """Cut lineage: write the rows as a Parquet table in the shared folder and read them back.

    The table survives the loss of an executor, has exact statistics for the
    optimizer, and is written once, columnar and compressed. ``by``: columns
    whose values have folders of their own.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/folio-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    _made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folio_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of materialize() that no plan reads any more."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    _made.remove(df._folio_path)
    p = jvm.org.apache.hadoop.fs.Path(df._folio_path)
    p.getFileSystem(conf).delete(p, True)


def skew_safe_join(rows: DataFrame, groups: DataFrame, keys: list[str], count_col: str, total: int) -> DataFrame:
    """Inner join of rows with one row per key, where a key may hold a third of all rows.

    ``groups`` has one row per key and in ``count_col`` how many of the ``total``
    rows carry it. Keys with at least HEAVY_FRACTION of the rows are at most
    1 / HEAVY_FRACTION, so those group rows are broadcast and their rows never
    shuffle; no remaining key holds more than that fraction of one shuffle.
    Null keys match null keys. ``count_col`` is not in the result.
    """
    limit = max(1, int(total * HEAVY_FRACTION))
    heavy = groups.where(F.col(count_col) >= limit).drop(count_col)
    light = groups.where(F.col(count_col) < limit).drop(count_col)
    if total < 100_000:  # one shuffle of so few rows is no skew worth a second pass
        return _null_safe(rows, groups.drop(count_col), keys, "inner")
    hot_keys = F.broadcast(heavy.select(*keys))
    return _null_safe(rows, F.broadcast(heavy), keys, "inner").unionByName(
        _null_safe(_null_safe(rows, hot_keys, keys, "left_anti"), light, keys, "inner")
    )


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    r = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"__r_{k}"])
        cond = c if cond is None else cond & c
    out = left.join(r, cond, how)
    return out.drop(*[f"__r_{k}" for k in keys]) if how == "inner" else out


def with_previous(df: DataFrame, keys: list[str], order: list[str], cols: list[str], name: str = "prev") -> DataFrame:
    """Each row with the row before it (a struct of ``cols``, null for a key's first row) by key and order.

    As lag() over keys, but a key may hold a third of all rows: rows are
    range-partitioned by key and order, so a hot key spans many tasks; within a
    task a window finds the predecessor, and the first row of a task's share
    takes the last one of the share before it, from one summary row per share.
    """
    from pyspark.sql import Window

    s = F.struct(*cols)
    r = materialize(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))
    share = Window.partitionBy(*keys, "__part").orderBy(*order)
    last = r.groupBy(*keys, "__part").agg(F.max_by(s, F.struct(*order)).alias("__last"))
    before = last.select(*keys, "__part", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__part")).alias("__before"))
    rows = r.withColumn("__lag", F.lag(s).over(share)).withColumn("__first", F.row_number().over(share) == 1)
    j = _null_safe(rows, before, [*keys, "__part"], "inner")
    return j.withColumn(name, F.when(F.col("__first"), F.col("__before")).otherwise(F.col("__lag"))).drop("__part", "__lag", "__first", "__before")


#: How running values of two shares become one.
_TOGETHER = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest, "next": F.coalesce}
_OVER = {"sum": F.sum, "min": F.min, "max": F.max}


def running(df: DataFrame, key: str, order: list[str], fore: dict[str, tuple[str, Column]], aft: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """Each row with aggregates over the rows of its key up to it (``fore``) and after it (``aft``), as name: (sum, min or max, value).

    In ``aft`` also next: the value of the row after it. As running windows, but a
    key may hold a third of all rows: rows are range-partitioned by key and order,
    and a task's share takes in what the shares of its key before (or after) it
    add up to, from one summary row per share. Rows after a row are the rows
    before it in reverse order, so that no frame is computed anew for each row.
    """
    from pyspark.sql import Window

    aft = aft or {}
    cols = df.columns
    values = {n: v for n, (_, v) in {**fore, **aft}.items()}
    r = materialize(df.select("*", *[v.alias(f"__v_{n}") for n, v in values.items()]).repartitionByRange(key, *order).withColumn("__part", F.spark_partition_id()))
    first = F.struct(*order)
    sums = [(F.min_by(f"__v_{n}", first) if kind == "next" else _OVER[kind](f"__v_{n}")).alias(f"__s_{n}") for n, (kind, _) in {**fore, **aft}.items()]
    shares = r.groupBy(key, "__part").agg(*sums)
    lo = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    hi = Window.partitionBy(key).orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    others = [_OVER[kind](f"__s_{n}").over(lo).alias(f"__o_{n}") for n, (kind, _) in fore.items()]
    others += [(F.lead(f"__s_{n}").over(Window.partitionBy(key).orderBy("__part")) if kind == "next" else _OVER[kind](f"__s_{n}").over(hi)).alias(f"__o_{n}") for n, (kind, _) in aft.items()]
    rest = shares.select(key, "__part", *others)
    up = Window.partitionBy(key, "__part").orderBy(*order)
    down = Window.partitionBy(key, "__part").orderBy(*[F.desc(c) for c in order])
    own = [_OVER[kind](f"__v_{n}").over(up.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n, (kind, _) in fore.items()]
    own += [(F.lead(f"__v_{n}").over(up) if kind == "next" else _OVER[kind](f"__v_{n}").over(down.rowsBetween(Window.unboundedPreceding, -1))).alias(n) for n, (kind, _) in aft.items()]
    j = _null_safe(r.select(*cols, "__part", *own), rest, [key, "__part"], "inner")
    return j.select(*cols, *[_TOGETHER[kind](F.col(n), F.col(f"__o_{n}")).alias(n) for n, (kind, _) in {**fore, **aft}.items()])


def running_sum(df: DataFrame, key: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Each row with the sum of a whole number over the rows of its key up to it, see running."""
    return running(df, key, order, {name: ("sum", value)}).withColumn(name, F.col(name).cast("int"))
