"""Threshold grid: every (prediction >= p, score >= s) cell without a theta join.

A row belongs to cell (I, J) when at least I prediction and J score thresholds
lie at or below its values. So rows are first counted by their own (i, j), a
table of at most |P| x |S| rows, and cells are suffix sums of that table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelweave.operators import ordering as O, selection as S
from panelweave.session import shared_root

#: Bins of `actual` for a factor of two, and rows of a bin from which its values are read: cells times bins stay few.
CELL_GRID, CELL_SMALL = 16, 2000


def _reached(value: str, thresholds: Sequence[float]) -> Column:
    """How many thresholds lie at or below the value."""
    return sum((F.when(F.col(value) >= p, 1).otherwise(0) for p in thresholds), F.lit(0))


def _tag(df: DataFrame, preds, scores) -> DataFrame:
    return (df.withColumns({"_i": _reached("pred", preds), "_j": _reached("score", scores)})
            .where((F.col("_i") > 0) & (F.col("_j") > 0)))


def _spread(totals: DataFrame, extra: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Suffix sums over i, then over j, of a table that is at most grid-sized per extra key."""
    add = [F.sum(c).alias(c) for c in sums]
    half = totals.withColumn("ci", F.explode(F.sequence(F.lit(1), "_i"))).groupBy("ci", "_j", *extra).agg(*add)
    return half.withColumn("cj", F.explode(F.sequence(F.lit(1), "_j"))).groupBy("ci", "cj", *extra).agg(*add)


def _label(df: DataFrame, preds, scores) -> DataFrame:
    """Replace cell numbers by the thresholds themselves."""
    at = lambda vals, i: F.element_at(F.array(*[F.lit(float(v)) for v in vals]), F.col(i))
    return df.withColumns({"pred_min": at(preds, "ci"), "score_min": at(scores, "cj")})


SUMS = ["n", "n_actual", "n_win", "sum_actual", "sum_pred", "sum_score"]


def _counts(tagged: DataFrame) -> DataFrame:
    """One pass: counts and sums by cell and bin of `actual` (none without a value). It feeds totals and medians."""
    return tagged.groupBy("_i", "_j", F.when(F.col("actual").isNotNull(), F.array(S.order_bin(F.col("actual"), CELL_GRID))).alias("_path")).agg(
        F.count("*").alias("n"), F.count("actual").alias("n_actual"), F.count_if(F.col("actual") > 0).alias("n_win"),
        F.sum("actual").alias("sum_actual"), F.sum("pred").alias("sum_pred"), F.sum("score").alias("sum_score"),
        F.min("actual").alias("lo"), F.max("actual").alias("hi"))


def cell_totals(df: DataFrame, preds: Sequence[float], scores: Sequence[float]) -> DataFrame:
    """Counts and sums per cell of a (pred, score, actual) table; empty cells are absent."""
    preds, scores = sorted(set(preds)), sorted(set(scores))
    base = _counts(_tag(df, preds, scores)).groupBy("_i", "_j").agg(*[F.sum(c).alias(c) for c in SUMS])
    return _label(_spread(base, [], SUMS), preds, scores)


def thresholds(df: DataFrame, cols: Sequence[str], size: int = 15) -> dict[str, list[float]]:
    """Distinct quantiles of each column at `size` even steps from 0 to 0.95 (a few driver numbers)."""
    got = S.interpolated(df, cols, [0.95 * i / (size - 1) for i in range(size)])
    return {c: sorted(set(v)) for c, v in got.items()}


def threshold_grid(df: DataFrame, size: int = 15, min_samples: int = 1,
                   preds: Sequence[float] | None = None, scores: Sequence[float] | None = None) -> DataFrame:
    """Count, mean, median, win rate and score = mean * ln(1 + n) for each threshold pair.

    `df` has pred, score and actual. A missing actual counts as a loss in the
    win rate and is left out of mean and median. Cells overlap, so rows are never grouped by cell: tables of
    counts by a row's own (i, j) and bin are, and the medians are selected from those.
    """
    df = df.where(F.col("pred").isNotNull() & F.col("score").isNotNull())
    if preds is None or scores is None:
        auto = thresholds(df, ["pred", "score"], size)
        preds, scores = preds or auto["pred"], scores or auto["score"]
    preds, scores = sorted(set(preds)), sorted(set(scores))
    shared_root(df.sparkSession)
    tagged = _tag(df, preds, scores)
    counts = _counts(tagged).checkpoint()  # at most cells times bins
    base = counts.groupBy("_i", "_j").agg(*[F.sum(c).alias(c) for c in SUMS])
    t = _label(_spread(base, [], SUMS), preds, scores).where(F.col("n") >= min_samples)
    medians = S.group_quantiles(
        tagged, ["ci", "cj"], "actual", [0.5], ["_i", "_j"], lambda c, more: _spread(c, more, ["n"]),
        counts.where("_path IS NOT NULL").select("_i", "_j", "_path", "n", "lo", "hi"), CELL_GRID, CELL_SMALL)
    mean = F.try_divide(F.col("sum_actual"), F.col("n_actual"))
    return (t.join(medians.select("ci", "cj", F.col("q").alias("median_actual")), ["ci", "cj"], "left")
            .select("ci", "cj", "pred_min", "score_min", "n", mean.alias("mean_actual"), "median_actual",
                    (F.col("n_win") / F.col("n")).alias("win_rate"), (F.col("sum_pred") / F.col("n")).alias("mean_pred"),
                    (F.col("sum_score") / F.col("n")).alias("mean_score"), (mean * F.log1p("n")).alias("score")))


def best_threshold(grid: DataFrame) -> DataFrame:
    """The cell with the best mean, then win rate, count and score."""
    order = [F.col(c).desc_nulls_last() for c in ("mean_actual", "win_rate", "n", "score")]
    return grid.orderBy(*order, F.col("pred_min"), F.col("score_min")).limit(1)


def score_bands(df: DataFrame, bins: int = 10, ties: Sequence[Column] = ()) -> DataFrame:
    """Two-dimensional quantile bands of pred and score with the summary of `actual`."""
    df = df.where(F.col("pred").isNotNull() & F.col("score").isNotNull()).withColumns({f"_tie{i}": t for i, t in enumerate(ties)})
    after = [f"_tie{i}" for i in range(len(ties))]
    orders = {"pred_bin": ["pred", *after], "score_bin": ["score", *after]}
    starts = S.quantile_bounds(df, orders, bins)  # both in the same passes
    df = df.withColumns({c: S.bin_of(df, orders[c], starts[c]) for c in orders}).drop(*after)
    keys = ["pred_bin", "score_bin"]
    stats = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("actual").alias("mean_actual"),
        F.avg(F.when(F.col("actual") > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.avg("pred").alias("mean_pred"), F.avg("score").alias("mean_score"))
    return stats.join(O.medians(df, keys, "actual", "median_actual"), keys, "left")


def pivot_heatmap(cells: DataFrame, row: str, col: str, value: str, columns: Sequence, prefix: str) -> DataFrame:
    """One row per `row`, one column per listed `col` value."""
    p = cells.groupBy(row).pivot(col, list(columns)).agg(F.first(value))
    return p.select(row, *[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in columns])
