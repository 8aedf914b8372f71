"""Back-test plan: signals to ledger, portfolio days, monthly table and risk figures.

The picks, a few rows per day, are stored when a run is set up; the rest is lazy. Materialise `paths` once
(table or checkpoint) when several of the results are wanted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from panelweave.operators import aggregates as A, filters as P, joins as J, ordering as O, trades as T
from panelweave.session import shared_root


@dataclass(frozen=True)
class BacktestConfig:
    """Parameters of one run; defaults follow the research set-up."""

    execution_model: str = "OPEN"
    signal_delay_bdays: int = 0
    max_trades_per_day: int = 1
    holding_period: int = 20
    leverage: float = 1.0
    min_pred_return: float = 0.5
    min_score: float | None = None
    min_rank_percentile: float | None = None
    fee: float = 0.01
    stop_loss: float = -0.1
    take_profit: float | None = None
    contradiction_below: float | None = None
    risk_free_rate: float = 0.051
    starting_capital: float = 100_000.0
    start: str | None = "2024-01-01"
    end: str | None = "2025-12-31"
    replace_dot: bool = False
    skip_days_with: tuple[str, ...] = field(default_factory=tuple)
    exclude: tuple[str, ...] = field(default_factory=tuple)


@dataclass(frozen=True)
class Backtest:
    config: BacktestConfig
    picks: DataFrame
    paths: DataFrame
    ledger: DataFrame
    daily: DataFrame

    def monthly(self) -> DataFrame:
        return A.monthly(self.daily)

    def risk(self) -> DataFrame:
        return A.risk_summary(self.daily, self.config.starting_capital)

    def capm(self) -> DataFrame:
        return A.capm_regression(self.daily, self.config.risk_free_rate)

    def regimes(self) -> DataFrame:
        return A.regime_attribution(self.daily)

    def value_at_risk(self, confidence: float = 0.95) -> DataFrame:
        # selection passes over its input several times; one row per day, so the back-test runs once
        shared_root(self.daily.sparkSession)
        return A.var_cvar(self.daily.select("date", "ai_daily_return").checkpoint(), "ai_daily_return", confidence)

    def analytics(self) -> DataFrame:
        return A.trade_analytics(self.ledger)


def select_picks(signals: DataFrame, c: BacktestConfig, universe: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(cleaned signals, daily picks)."""
    s = P.coerce(signals, ["pred_return_pct", "rank_score"], ["date", "pred_return_pct", "rank_score"])
    if universe is not None:
        s = P.filter_universe(s, universe, replace_dot=c.replace_dot)
    if c.signal_delay_bdays > 0:
        s = P.shift_business_days(s, c.signal_delay_bdays)
    s = P.between_dates(s, c.start, c.end, closed=True)
    longs = P.select_signals(s, c.min_pred_return, c.min_score)
    if c.min_rank_percentile is not None:
        longs = O.rank_pct(longs, "date", "rank_score", "rank_pct").where(F.col("rank_pct") >= c.min_rank_percentile)
    longs = J.exclude_days(longs, c.skip_days_with, c.exclude)
    return s, O.top_n_per_group(longs, c.max_trades_per_day, "date", O.signal_order())


def run_backtest(signals: DataFrame, bars: DataFrame, market: DataFrame, config: BacktestConfig,
                 universe: DataFrame | None = None) -> Backtest:
    c = config
    s, picks = select_picks(signals, c, universe)
    calendar = P.between_dates(market.where(F.col("spy_close").isNotNull()), c.start, c.end, closed=True)
    paths = T.executed_paths(picks, bars, c.execution_model, c.holding_period, c.fee, c.stop_loss, c.take_profit,
                             c.contradiction_below, s)
    book = T.ledger(paths, c.starting_capital, c.max_trades_per_day, c.holding_period)
    daily = T.portfolio_daily(paths, calendar, c.starting_capital, c.max_trades_per_day, c.holding_period)
    daily = T.strategy_vs_benchmark(daily, calendar, c.starting_capital, c.leverage, c.risk_free_rate)
    return Backtest(c, picks, paths, book, daily)
