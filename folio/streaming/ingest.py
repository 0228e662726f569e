"""Captures as a stream: deduplicated by page within a watermark, and paced per host with state.

An extension: the batch operators serve streams of files with the same code.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folio.operators.chapters import pace


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_deliveries(captures: DataFrame, late: str = "7 days") -> DataFrame:
    """Each page once, however often it is delivered within the watermark on captured_at."""
    return captures.withWatermark("captured_at", late).dropDuplicatesWithinWatermark(["page_id"])


def host_windows(captures: DataFrame, late: str = "7 days", size: str = "1 day") -> DataFrame:
    """(window, host, n): captures per host and day."""
    return captures.withWatermark("captured_at", late).groupBy(F.window("captured_at", size), "host").agg(F.count("*").alias("n"))


def paced(outcomes: DataFrame, base: float = 0.3, top: float = 5.0, factor: float = 2.0, recover: int = 6) -> DataFrame:
    """(host, interval, streak, backoffs) after each batch, from outcomes (host string, shell boolean) with state per host."""

    def step(key: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        s = state.get if state.exists else (max(0.0, base), 0, 0)
        for part in rows:
            for shell in part["shell"]:
                s = pace(s, bool(shell), base, top, factor, recover)
        state.update(s)
        yield pd.DataFrame({"host": [key[0]], "interval": [s[0]], "streak": [s[1]], "backoffs": [s[2]]})

    return outcomes.groupBy("host").applyInPandasWithState(
        step, "host string, interval double, streak int, backoffs int", "interval double, streak int, backoffs int", "update", "NoTimeout"
    )
