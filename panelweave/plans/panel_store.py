"""The price panel as a stored table.

A price panel is read by every window, as-of join and back-test, so it is kept
as a table rather than rebuilt from ticks each time: Parquet bucketed by ticker
and sorted by date. Windows and equi joins by ticker then need no shuffle, date
filters reach the files, and the market table has a known small size.

Within one Spark application each source folder is stored once, below the shared
folder that the session names.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelweave.session import staging_path

_STORED: dict[tuple[str, str], tuple[str, str]] = {}
_LOCK = threading.Lock()
#: Rows of a bucket. A task holds one bucket, widened by every column that a chain of windows adds, so rows bound its memory; the bytes
#: of the compressed input don't.
BUCKET_ROWS = 100_000
MAX_BUCKETS = 65_536


def bucket_count(spark: SparkSession, rows: int) -> int:
    """Buckets of about BUCKET_ROWS rows each, at least one per core."""
    return int(min(MAX_BUCKETS, max(spark.sparkContext.defaultParallelism, -(-rows // BUCKET_ROWS))))


def save_panel(bars: DataFrame, path: str, table: str, buckets: int, key: str = "ticker", date: str = "date") -> DataFrame:
    """Write a (key, date) panel bucketed by key and sorted by date; returns the table.

    `bars` comes dealt by `repartition(buckets, key)`, the same hash and count as the bucketing, so that every task writes one file.
    """
    (bars.write.mode("overwrite").option("path", path)
     .bucketBy(buckets, key).sortBy(key, date).format("parquet").saveAsTable(table))
    return bars.sparkSession.table(table)


def stored_panel(spark: SparkSession, folder: str, rows: Callable[[], int], build_bars: Callable[[int], DataFrame],
                 build_market: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(bars, market) of a folder, written on first use in this application.

    `rows` bounds the number of bars; `build_bars(n)` gives them dealt to n partitions by ticker.
    """
    key = (spark.sparkContext.applicationId, folder)
    with _LOCK:
        if key not in _STORED:
            table = f"panelweave_bars_{uuid.uuid4().hex}"
            buckets = bucket_count(spark, rows())
            bars = save_panel(build_bars(buckets), staging_path(spark, "bars"), table, buckets)
            market_path = staging_path(spark, "market")
            build_market(bars).repartition(1).write.mode("overwrite").parquet(market_path)
            _STORED[key] = (table, market_path)
    table, market_path = _STORED[key]
    return spark.table(table), spark.read.parquet(market_path)
