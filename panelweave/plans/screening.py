"""Daily screening and threshold analysis as plans over tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from panelweave.functions import rules as R
from panelweave.operators import features as M, filters as P, grid as G, joins as J, ordering as O, windows as X
from panelweave.sources.sinks import summary_json
from panelweave.streaming.jobs import overlay_quote

INDICATORS = ("rsi_14", "macd_line", "macd_hist", "macd_signal")


@dataclass(frozen=True)
class ScreenConfig:
    min_pred: float = 1.0
    min_score: float = -0.5
    min_turnover: float = 5_000_000.0
    min_history: int = 62
    target_mean: float = 0.0
    target_std: float = 1.0
    confidence_min: float = 0.6


def live_features(bars: DataFrame, market: DataFrame, quotes: DataFrame | None, stats: DataFrame | None,
                  features: Sequence[str], min_history: int = 62, transform: bool = True) -> DataFrame:
    """Feature row of the latest day of each ticker; `transform=False` scales raw levels instead (variant).

    Quote overlay, indicators, market join with forward fill, transforms,
    alignment, scaling and the statistics of the last 60 rows including the
    latest. All per-ticker steps share one partitioning.
    """
    b = P.min_rows(bars, min_history)
    if quotes is not None:
        b = overlay_quote(b, quotes)
    b = X.recent_return(X.macd(X.rsi(b)))
    merged = J.join_market_ffill(b, market)
    raw = {"_price": F.col("close"), "_volume": F.col("volume")}
    moved = merged.withColumns(raw)
    moved = X.feature_transform(moved, features) if transform else moved
    flat = P.align(moved, features, keep=["ticker", "date", "recent_return_pct", *raw])
    scaled = M.scale_transform(flat, stats, features) if stats is not None else flat
    rows = X.window_stats(scaled, features, 60, include_current=True).where("_hist = 60")
    return O.dedupe(rows, ["ticker"], [F.col("date").desc()])


def screen(latest: DataFrame, raw_pred: Column, rank_score: Column, c: ScreenConfig, agent: DataFrame | None = None) -> DataFrame:
    """Blend, turnover and threshold cascade, then the agent cross-check when answers are given."""
    p = latest.withColumns(R.blend_prediction(raw_pred, F.lit(c.target_mean), F.lit(c.target_std), F.col("recent_return_pct")))
    p = p.select("date", "ticker", F.col("_price").alias("current_price"), F.col("_volume").alias("current_volume"),
                 (F.col("_price") * F.col("_volume")).alias("dollar_turnover"), "recent_return_pct", "pred_model",
                 F.col("pred_final").alias("pred_return_pct"), rank_score.alias("rank_score"), "used_fallback")
    rich = F.col("dollar_turnover") >= c.min_turnover
    good = rich & (F.col("rank_score") >= c.min_score)
    picks = P.cascade_filter(p, [good & (F.col("pred_return_pct") >= c.min_pred), good, rich])
    if agent is None:
        return picks
    return R.crosscheck(agent, picks.drop("tier"), c.confidence_min, c.min_pred, c.min_score)


@dataclass(frozen=True)
class ThresholdReport:
    grid: DataFrame
    bands: DataFrame
    best: DataFrame
    summary: DataFrame


def threshold_report(scored: DataFrame, ties: Sequence[Column], size: int = 15, min_samples: int = 30, bins: int = 10) -> ThresholdReport:
    """Threshold grid, score bands, best cell and its JSON record of a (pred, score, actual) table.

    A table without any realised outcome yields grids with NULL means.
    """
    grid = G.threshold_grid(scored, size, min_samples)
    best = G.best_threshold(grid)
    return ThresholdReport(grid, G.score_bands(scored, bins, ties), best, summary_json(best))
