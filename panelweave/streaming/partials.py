"""Mergeable partial rows of micro-batches: written once, compacted level by level, named by one marker.

Layout below the target: `part/` holds folders of partial rows, `_live/` numbered markers, `_checkpoint/<name>`
the progress of each source. The highest readable marker names the live folders and, for each stream, the last
batch that they contain. So a batch that runs again changes nothing, a restart goes on where the last run ended, and
a reader sees whole batches only. When `FAN` folders of a level are live, they are folded into one of the next level, so their number
grows with the logarithm of the batches. A folder that a marker has dropped is deleted one marker later.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

#: Folders of one level that are folded into one.
FAN = 8

Fold = Callable[[DataFrame], DataFrame]


class Marker:
    """The markers of a target, through the file system that Spark itself uses."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.root = spark._jvm, f"{path.rstrip('/')}/_live"
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, text: str):
        return self.jvm.org.apache.hadoop.fs.Path(text)

    def _versions(self) -> list[int]:
        if not self.fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(self.root))]
        return sorted((int(n) for n in names if n.isdigit()), reverse=True)

    def read(self) -> dict:
        """The newest marker; one that a crash left half written is passed over."""
        versions = self._versions()
        for v in versions:
            stream = self.fs.open(self._path(f"{self.root}/{v}"))
            try:
                text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                return json.loads(text) | {"version": versions[0]}
            except ValueError:
                continue
        return {"version": versions[0] if versions else 0, "live": [], "gone": [], "done": {}}

    def write(self, state: dict) -> None:
        """The next marker. It must not exist yet: another writer at the same target is an error, not an overwrite."""
        version = state["version"] + 1
        out = self.fs.create(self._path(f"{self.root}/{version}"), False)
        try:
            out.write(bytearray(json.dumps({k: state[k] for k in ("live", "gone", "done")}).encode()))
        finally:
            out.close()
        for v in self._versions():
            if v < version - 1:
                self.fs.delete(self._path(f"{self.root}/{v}"), False)

    def drop(self, folder: str) -> None:
        self.fs.delete(self._path(folder), True)


def collect_partials(stream: DataFrame, path: str, partial: Fold, fold: Fold, name: str = "main") -> StreamingQuery:
    """Add everything that is available now to the target and wait for the end.

    `partial` makes the rows of a batch, `fold` merges such rows into rows of the same kind. Each source that feeds a target has a
    `name` of its own, under which its progress is kept.
    """
    spark = stream.sparkSession
    root = path.rstrip("/")

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        query = session.sparkContext.getLocalProperty("sql.streaming.queryId")
        marker = Marker(session, root)
        state = marker.read()
        if state["done"].get(query, -1) >= number:
            return  # this batch is in already, perhaps in a larger folder by now
        folder = f"{root}/part/{query}-{number}"
        partial(batch).write.mode("overwrite").parquet(f"{folder}-0")
        live, gone, level = [*state["live"], [0, f"{folder}-0"]], [], 0
        while len(full := [f for k, f in live if k == level]) >= FAN:
            merged = f"{folder}-{level + 1}"
            fold(session.read.parquet(*full)).write.mode("overwrite").parquet(merged)
            live = [x for x in live if x[1] not in full] + [[level + 1, merged]]
            gone += full
            level += 1
        marker.write({"version": state["version"], "live": live, "gone": gone, "done": state["done"] | {query: number}})
        for old in state["gone"]:
            marker.drop(old)

    w = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/_checkpoint/{name}")
    q = w.foreachBatch(write).start()
    q.awaitTermination()
    return q


def live_folders(spark: SparkSession, path: str) -> list[str]:
    return [f for _, f in Marker(spark, path).read()["live"]]


def read_partials(spark: SparkSession, path: str) -> DataFrame:
    """The partial rows of all batches that are in; fold them to get the table."""
    folders = live_folders(spark, path)
    if not folders:
        raise ValueError(f"no batch has been collected in {path}")
    return spark.read.parquet(*folders)
