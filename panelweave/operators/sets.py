"""Set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from panelweave.operators.ordering import dedupe


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Vertical concat; columns absent from a frame are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_distinct(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Concat, then one row per key combination; the keys are the whole row, so order is irrelevant."""
    return union_by_name([f.select(*keys) for f in frames]).dropDuplicates(list(keys))


def merge_prefer_last(local: DataFrame, fresh: DataFrame, keys: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """Union of two series; the fresh row wins where both have the key, and among fresh rows the largest `tie` (all columns by default)."""
    both = local.withColumn("_p", F.lit(0)).unionByName(fresh.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    ties = [F.col(f"`{c}`").desc_nulls_last() for c in (tie or [c for c in local.columns if c not in keys])]
    return dedupe(both, keys, [F.col("_p").desc(), *ties]).drop("_p")


def universe(frames: Sequence[DataFrame], key: str = "ticker") -> DataFrame:
    """Distinct keys over all sources."""
    return reduce(lambda a, b: a.union(b), [f.select(key) for f in frames]).distinct()
