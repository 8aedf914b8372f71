"""Order-based operators that never bring a large group into one task.

* Top-k and keep-first use `row_number() <= k`. Spark plans a partial group
  limit before the shuffle, so a hot key sends at most k rows per map task.
* Quantiles, medians and bin boundaries come from radix selection (`selection`).
* Ranks of all rows start from a value histogram (partial aggregation folds
  ties). Its running count is computed per bin of a fixed grid, and bin totals are a
  small table; a group that holds a third of all rows is split over the bins.
* A full row number comes from a range-partitioned sort plus one offset per
  partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelweave.functions import numeric as N
from panelweave.operators import selection as S
from panelweave.session import shared_root

#: Types that order as doubles do (whole numbers up to 2^53).
NUMBERS = {"double", "float", "integer", "long", "short", "byte", "date"}


def top_n_per_group(df: DataFrame, n: int, group: str | Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First n rows of each group; the order must end in a unique key."""
    keys = [group] if isinstance(group, str) else list(group)
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def signal_order(date: bool = False) -> list[Column]:
    """score desc, prediction desc, ticker asc."""
    head = [F.col("date").asc()] if date else []
    return head + [F.col("rank_score").desc_nulls_last(), F.col("pred_return_pct").desc_nulls_last(), F.col("ticker").asc()]


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in the given order (pass descending columns to keep the last)."""
    return top_n_per_group(df, 1, keys, order)


def value_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Histogram per (keys, value): `n_tie` rows with the value, `n_before` below it, `n_group` in all.

    Values are counted within bins of a fixed grid, so no pass looks for boundaries first. The key combinations times
    the bins must stay a small table (days, bands, cells).
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias(value))
    hist = rows.groupBy(*keys, value).agg(F.count("*").alias("n_tie")).withColumn("_bin", S.order_bin(F.col(value)))
    inside = W.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    totals = hist.groupBy(*keys, "_bin").agg(F.sum("n_tie").alias("_t"))
    lower = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*keys, "_bin", F.coalesce(F.sum("_t").over(lower), F.lit(0)).alias("_low"),
                           F.sum("_t").over(W.partitionBy(*keys)).alias("n_group"))
    within = hist.withColumn("_in", F.coalesce(F.sum("n_tie").over(inside), F.lit(0)))
    return (within.join(totals, keys + ["_bin"])
            .select(*keys, value, "n_tie", (F.col("_in") + F.col("_low")).alias("n_before"), "n_group"))


def rank_pct(df: DataFrame, group: str, value: str, out: str = "rank_pct") -> DataFrame:
    """Percentile rank in the group, ties averaged: (rank + (ties - 1) / 2) / n."""
    r = value_ranks(df, [group], value)
    pct = (F.col("n_before") + 1 + (F.col("n_tie") - 1) / F.lit(2.0)) / F.col("n_group")
    ranks = r.select(F.col(group).alias("_g"), F.col(value).alias("_v"), pct.alias(out))
    return df.join(ranks, (F.col(group) == F.col("_g")) & (F.col(value).cast("double") == F.col("_v")), "left").drop("_g", "_v")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Linear-interpolation quantiles per key as rows (keys, prob, q); exact and distributed, by radix selection."""
    return S.group_quantiles(df, keys, value, probs)


def medians(df: DataFrame, keys: Sequence[str], value: str, out: str = "median") -> DataFrame:
    return exact_quantiles(df, keys, value, [0.5]).select(*keys, F.col("q").alias(out))


def global_row_number(df: DataFrame, order: Sequence[Column], out: str = "rn") -> DataFrame:
    """1-based position in a total order, without a single-task window.

    The sorted table is checkpointed so that both readers see the same
    partitions; each partition then needs only the row count of those before it.
    """
    shared_root(df.sparkSession)
    tagged = df.sort(*order).withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_id", 33)
    counts = tagged.groupBy(part.alias("_p")).agg(F.count("*").alias("_c"))
    lower = W.partitionBy().orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("_p", F.coalesce(F.sum("_c").over(lower), F.lit(0)).alias("_s"))
    return (tagged.withColumn("_p", part).join(starts, "_p")
            .withColumn(out, F.col("_s") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_p", "_s", "_id"))


def quantile_bins(df: DataFrame, value: str, q: int, ties: Sequence[Column | str], out: str) -> DataFrame:
    """Rank (ties by the given order) cut into q bins of equal rank width: max(0, ceil((r-1)*q/(n-1)) - 1).

    The q - 1 rows at which bins begin are selected, and all rows compared with them. Ties may be numbers or dates; other
    types need the full row number.
    """
    rows = df.where(F.col(value).isNotNull())
    names = {f"_tie{i}": F.col(t) if isinstance(t, str) else t for i, t in enumerate(ties)}
    rows = rows.withColumns(names) if names else rows
    if all(rows.schema[n].dataType.typeName() in NUMBERS for n in (value, *names)):
        order = [value, *names]
        starts = S.quantile_bounds(rows, {out: order}, q)[out]
        return rows.withColumn(out, S.bin_of(rows, order, starts)).drop(*names)
    ranked = global_row_number(rows.drop(*names), [F.col(value).asc(), *ties], "_rn")
    n = rows.agg(F.count("*")).scalar()
    span = F.greatest(n - 1, F.lit(1))
    ceil = F.floor(((F.col("_rn") - 1) * q + span - F.expr("1")) / span.cast("double"))
    return ranked.withColumn("_n", n).withColumn(out, F.greatest(F.lit(0), ceil - 1).cast("int")).drop("_rn", "_n")


def head_n(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """Global top-n report; Spark keeps n rows per task and merges them."""
    return df.orderBy(*order).limit(n)


def top_ideas(agent: DataFrame, n: int = 3, order: Sequence[Column] | None = None) -> DataFrame:
    """Best buy or long ideas with status ok; when there is none, the best of any status-ok idea.

    `is_buy_only` tells which of the two lists was used.
    """
    ok = F.lower("status") == "ok"
    buy = F.lower("recommendation").isin("buy", "long")
    pool = agent.where(ok).withColumn("is_buy_only", N.is_true(buy))
    any_buy = pool.agg(N.is_true(F.max("is_buy_only"))).scalar()
    picked = pool.where(F.col("is_buy_only") | ~any_buy)
    return head_n(picked, n, order or [F.col("confidence").desc_nulls_last(), F.col("ticker").asc()])


def in_rank_order(df: DataFrame, ranked: DataFrame, key: str = "ticker", rank: str = "rank") -> DataFrame:
    """Rows of `df` whose key is in the ranked list, carrying the rank to sort by."""
    return df.join(ranked.select(key, rank), key).orderBy(rank)
