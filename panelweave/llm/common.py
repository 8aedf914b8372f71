"""Helpers shared by the text operators: tables, shared folder, Arrow batches, hashed tokens."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

#: ASCII white space that separates words: space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that the cluster shares; sets one only where none is set (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ids_and_bytes(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text as UTF-8 bytes) whatever other columns exist; a null text is empty."""
    return docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))


def partitions_for(docs: DataFrame, mb: int = 16) -> int:
    """Number of parts so that one holds about `mb` MB of text, without an upper bound."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (mb << 20)))


def columns(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple[list, ...]]:
    for b in batches:
        if b.num_rows:
            yield tuple(b.column(n).to_pylist() for n in names)


def pieces(batches, size: int = 1 << 21):
    """Batches in pieces of about `size` bytes of text, a document at least, so that the arrays of their words stay small."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield b.slice(at, stop - at)
            at = stop


def fenced(df: DataFrame, condition) -> DataFrame:
    """Rows that meet a condition on computed columns, which Spark must not compute again below them."""
    return df.withColumn("_fence", F.monotonically_increasing_id()).where(condition & (F.col("_fence") >= 0)).drop("_fence")


def token_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of k-word shingles; fewer words make one shingle, none make none."""
    n = len(h)
    if n == 0:
        return h
    k = min(k, n)
    out = np.full(n - k + 1, np.uint64(k), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[j : n - k + 1 + j])
    return np.unique(out)


#: Slots of the hashed frequency table: a fixed size, so that it may be broadcast.
SLOTS = 1 << 20
SLICES = 64


def hashed_frequencies(counts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Sum the slot numbers of a task into one vector and emit it in slices."""
    total = np.zeros(SLOTS, np.int64)
    for slots in counts:
        total += np.bincount(slots.astype(np.int64), minlength=SLOTS)
    if total.any():
        parts = total.reshape(SLICES, -1).astype("<i8")
        yield pa.RecordBatch.from_pydict(
            {"slice": pa.array(range(SLICES), pa.int32()), "counts": pa.array([p.tobytes() for p in parts], pa.binary())})


def frequency_table(sliced: DataFrame) -> np.ndarray:
    """Add up the slices of all tasks; the result has SLOTS numbers whatever the corpus size."""
    def add(batches):
        acc: dict[int, np.ndarray] = {}
        for s, c in columns(batches, "slice", "counts"):
            for i, raw in zip(s, c):
                v = np.frombuffer(raw, "<i8")
                acc[i] = acc[i] + v if i in acc else v
        if acc:
            yield pa.RecordBatch.from_pydict({"slice": pa.array(list(acc), pa.int32()),
                                              "counts": pa.array([v.tobytes() for v in acc.values()], pa.binary())})

    schema = "slice int, counts binary"
    rows = sliced.repartition(SLICES, "slice").mapInArrow(add, schema).collect()
    out = np.zeros((SLICES, SLOTS // SLICES), np.int64)
    for r in rows:
        out[r["slice"]] += np.frombuffer(r["counts"], "<i8")
    return out.reshape(-1)


def open_lists(rows: DataFrame, order: list[str], carried: list[str]) -> DataFrame:
    """Rows of the groups `g` with two rows or more, next to the group's first row in `order` (as hub_<column>).

    All columns are non-null longs. One shuffle by `g`; each task streams its sorted rows, so a
    group of any size passes in batches and nothing of a group is kept but its first row.
    """
    names = ["g", *order, *carried]
    kept = names[1:]

    def run(batches):
        hub = pending = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = {n: b.column(n).to_numpy(zero_copy_only=False) for n in names}
            if pending is not None:
                cols = {n: np.concatenate((pending[n], v)) for n, v in cols.items()}
            pending = None
            g = cols["g"]
            start = np.concatenate(([True], g[1:] != g[:-1]))
            goes_on = hub is not None and g[0] == hub["g"]
            alone = start & np.concatenate((start[1:], [True]))
            first = np.maximum.accumulate(np.where(start, np.arange(len(g)), 0))
            hubs = {n: cols[n][first] for n in kept}
            if goes_on:
                run_end = int(start[1:].argmax()) + 1 if start[1:].any() else len(g)
                for n in kept:
                    hubs[n][:run_end] = hub[n]
                alone[:run_end] = False
            hub = {"g": g[-1]} | {n: hubs[n][-1] for n in kept}
            if alone[-1]:
                pending, hub = {n: v[-1:] for n, v in cols.items()}, None
            keep = ~alone
            if keep.any():
                yield pa.RecordBatch.from_pydict({n: pa.array(v[keep]) for n, v in cols.items()} | {f"hub_{n}": pa.array(v[keep]) for n, v in hubs.items()})

    schema = ", ".join(f"{n} long" for n in [*names, *(f"hub_{n}" for n in kept)])
    return rows.select(*[F.col(n).cast("long").alias(n) for n in names]).repartition("g").sortWithinPartitions("g", *order).mapInArrow(run, schema)
