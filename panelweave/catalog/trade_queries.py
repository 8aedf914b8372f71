"""Trade paths, ledgers, portfolio figures and forward tracking."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from panelweave.catalog.filter_queries import agent, latest_signal
from panelweave.catalog.registry import SHARED_SQL, query
from panelweave.operators import aggregates as A, joins as J, ordering as O, trades as T, windows as X
from panelweave.plans.backtest import BacktestConfig, run_backtest

HOLD = 15
CONFIG = BacktestConfig(execution_model="AVG", max_trades_per_day=1, holding_period=HOLD, min_pred_return=1.0, min_score=-0.5,
                        fee=0.01, stop_loss=-0.4, take_profit=1.5, contradiction_below=-8.0, leverage=0.02, start=None, end=None)


def backtest(t):
    return run_backtest(t.signals, t.bars, t.market, CONFIG)


W3 = "OVER (PARTITION BY date, ticker ORDER BY i)"
WALL = "OVER (PARTITION BY date, ticker)"
SHARED_SQL["bt_picks"] = """
SELECT date, ticker, pred_return_pct, rank_score FROM signals WHERE pred_return_pct >= 1 AND rank_score >= -0.5
QUALIFY row_number() OVER (PARTITION BY date ORDER BY rank_score DESC, pred_return_pct DESC, ticker) = 1"""
SHARED_SQL["bt_steps"] = f"""
SELECT *, lag(close) {W3} AS pc, lag(p) {W3} AS pp FROM (
 SELECT k.date, k.ticker, k.pred_return_pct, k.rank_score, e.date AS entry_date, b.rn - e.rn AS i, b.date AS day, b.open, b.high, b.low, b.close,
  (b.open + b.high + b.low + b.close) / 4 AS p FROM bt_picks k JOIN numbered_bars e ON k.ticker = e.ticker AND k.date = e.date
 JOIN numbered_bars b ON b.ticker = k.ticker AND b.rn BETWEEN e.rn AND e.rn + 14 WHERE e.rn + 14 <= e.n_rows)"""
SHARED_SQL["bt_rets"] = """
SELECT *, CASE WHEN i = 0 THEN (close - open) / open ELSE close / pc - 1 END AS r_open,
 CASE WHEN i = 0 THEN (close - p) / p WHEN i = 14 THEN (p - pc) / pc ELSE p / pp - 1 END AS r_avg,
 CASE WHEN i = 0 THEN (close - high) / high WHEN i = 14 THEN (low - pc) / pc ELSE close / pc - 1 END AS r_pain FROM bt_steps"""
SHARED_SQL["bt_cums"] = f"""
SELECT *, product(1 + ret) OVER (PARTITION BY date, ticker ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 AS cum FROM (
 SELECT r.*, CASE WHEN i = 0 THEN r_avg - 0.01e0 ELSE r_avg END AS ret, s.pred_return_pct AS day_pred
 FROM bt_rets r LEFT JOIN signals s ON s.ticker = r.ticker AND s.date = r.day)"""
SHARED_SQL["bt_hits"] = f"""
SELECT *, coalesce(min(i) FILTER (hit IS NOT NULL) {WALL}, 14) AS exit_i FROM (
 SELECT *, coalesce(lag(cum) {W3}, 0) AS prev, CASE WHEN cum <= -0.4 THEN 'Hard Stop-Loss' WHEN cum >= 1.5 THEN 'Take Profit'
  WHEN cum < 0 AND day_pred < -8 THEN 'Contradiction Exit' END AS hit FROM bt_cums)"""
SHARED_SQL["bt_exec"] = f"""
SELECT *, product(1 + x) {WALL} - 1 AS total, max(p) FILTER (i = 0) {WALL} AS entry_price FROM (
 SELECT *, CASE WHEN i > exit_i THEN 0 WHEN i = exit_i AND reason = 'Hard Stop-Loss' THEN -0.4e0 - prev WHEN i = exit_i AND reason = 'Take Profit' THEN 1.5e0 - prev ELSE ret END AS x FROM (
  SELECT *, coalesce(max(hit) FILTER (i = exit_i) {WALL}, 'Time Exit') AS reason FROM bt_hits))"""
SHARED_SQL["bt_ledger"] = """
SELECT date, ticker, pred_return_pct, rank_score, entry_date, round_even(entry_price, 4) AS entry_price, day AS exit_date, reason AS exit_reason,
 round_even(CASE reason WHEN 'Hard Stop-Loss' THEN entry_price * (1 - 0.4e0) WHEN 'Take Profit' THEN entry_price * (1 + 1.5e0) ELSE p END, 4) AS exit_price,
 total AS strategy_return, round_even(total * 100, 2) AS strategy_return_pct, round_even(1e5 / 15, 2) AS cash_used, round_even(1e5 / 15 * total, 2) AS cash_gained,
 round_even(1e5 / 15 * (1 + total), 2) AS cash_final FROM bt_exec WHERE i = exit_i"""
SHARED_SQL["bt_daily"] = """
SELECT date, coalesce(pnl, 0) AS daily_pnl, coalesce(act, 0) AS active_capital, coalesce(stock, 0) AS stock_holding, coalesce(flow, 0) AS cash_flow, coalesce(buys, 0) AS cash_used_for_buys
FROM (SELECT date FROM market) m LEFT JOIN (
 SELECT day AS date, sum(x / 15) AS pnl, count(*) / 15e0 AS act, sum(CASE WHEN i < 14 THEN g * 1e5 / 15 ELSE 0 END) AS stock,
  sum(CASE WHEN i = 0 THEN -1e5 / 15 ELSE 0 END + CASE WHEN i = exit_i THEN 1e5 / 15 * (1 + total) ELSE 0 END) AS flow, sum(CASE WHEN i = 0 THEN 1e5 / 15 ELSE 0 END) AS buys
 FROM (SELECT *, product(1 + x) OVER (PARTITION BY date, ticker ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM bt_exec) GROUP BY day) d USING (date)"""
SHARED_SQL["bt_folio"] = """
SELECT *, (ai_equity - peak) / peak AS ai_drawdown, inv * 2 AS gross_exposure, (inv * 0.02e0 - (1 - inv)) * 100 AS net_exposure FROM (
 SELECT *, max(ai_equity) OVER (ORDER BY date) AS peak FROM (
 SELECT *, 1e5 * product(1 + ai) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS ai_equity, 1e5 * product(1 + spy) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS spy_equity,
  1e5 + sum(cash_flow) OVER (ORDER BY date) AS cash_holding FROM (
  SELECT d.*, least(active_capital, 1) AS inv, daily_pnl * 0.02e0 + (1 - least(active_capital, 1)) * (0.051e0 / 252) AS ai,
   coalesce(spy_close / lag(spy_close) OVER (ORDER BY date) - 1, 0) AS spy FROM bt_daily d JOIN market USING (date))))"""


@query("trade_daily_returns", "date:d ticker:s i:i r_open:f r_avg:f r_pain:f", "SELECT date, ticker, i, r_open, r_avg, r_pain FROM bt_rets")
def _(t):
    pos = X.positions(t.bars)
    picks = run_backtest(t.signals, t.bars, t.market, CONFIG).picks
    path = J.trade_path(J.entry_forward(picks, pos), pos, HOLD)
    for m in T.MODELS:
        path = T.daily_returns(path, m, HOLD, f"r_{m.lower()}")
    return path


@query("trade_costs", "date:d ticker:s i:i ret:f", "SELECT date, ticker, i, CASE WHEN i = 0 THEN r_open - 0.01e0 ELSE r_open END AS ret FROM bt_rets")
def _(t):
    pos = X.positions(t.bars)
    path = J.trade_path(J.entry_forward(run_backtest(t.signals, t.bars, t.market, CONFIG).picks, pos), pos, HOLD)
    return T.apply_costs(T.daily_returns(path, "OPEN", HOLD), 0.01)


@query("exit_detection", "date:d ticker:s i:i exec_ret:f exit_i:i exit_reason:s",
       "SELECT date, ticker, i, x AS exec_ret, exit_i, reason AS exit_reason FROM bt_exec")
def _(t):
    return backtest(t).paths


@query("trade_total_return", "date:d ticker:s total_return:f", "SELECT date, ticker, any_value(total) AS total_return FROM bt_exec GROUP BY ALL")
def _(t):
    return backtest(t).paths.groupBy("date", "ticker").agg(F.max("total_return").alias("total_return"))


@query("exit_price_reason", "date:d ticker:s entry_price:f exit_price:f exit_reason:s",
       "SELECT date, ticker, entry_price, exit_price, exit_reason FROM bt_ledger")
def _(t):
    return backtest(t).ledger


@query("trade_ledger_delayed", "date:d ticker:s original_signal_date:d entry_date:d", """
SELECT k.date, k.ticker, k.original_signal_date, e.date AS entry_date FROM (
 SELECT base + CAST(1 + 2 * ((wd + 1) // 5) AS INT) AS date, ticker, original_signal_date FROM (
  SELECT ticker, date AS original_signal_date, rank_score, pred_return_pct, least(isodow(date) - 1, 4) AS wd, date - CAST(greatest(isodow(date) - 5, 0) AS INT) AS base FROM signals
  WHERE pred_return_pct >= 1 AND rank_score >= -0.5)
 QUALIFY row_number() OVER (PARTITION BY base + CAST(1 + 2 * ((wd + 1) // 5) AS INT) ORDER BY rank_score DESC, pred_return_pct DESC, ticker) = 1) k
ASOF JOIN numbered_bars e ON k.ticker = e.ticker AND k.date <= e.date WHERE e.rn + 14 <= e.n_rows""")
def _(t):
    late = replace(CONFIG, signal_delay_bdays=1, contradiction_below=None)
    return run_backtest(t.signals, t.bars, t.market, late).ledger


@query("trade_ledger", "date:d ticker:s original_signal_date:d side:s pred_return_pct:f rank_score:f entry_date:d entry_price:f exit_date:d exit_price:f exit_reason:s "
       "strategy_return:f cash_used:f cash_gained:f cash_final:f strategy_return_pct:f", "SELECT *, date AS original_signal_date, 'LONG' AS side FROM bt_ledger")
def _(t):
    return backtest(t).ledger


@query("portfolio_pnl", "date:d daily_pnl:f active_capital:f", "SELECT date, daily_pnl, active_capital FROM bt_daily")
def _(t):
    return backtest(t).daily


@query("portfolio_daily", "date:d daily_pnl:f active_capital:f stock_holding:f4 cash_flow:f4 cash_used_for_buys:f4", "SELECT * FROM bt_daily")
def _(t):
    b = backtest(t)
    return T.portfolio_daily(b.paths, t.market, CONFIG.starting_capital, 1, HOLD)


@query("strategy_vs_benchmark", "date:d ai_daily_return:f spy_daily_return:f ai_equity:f2 spy_equity:f2 cash_holding:f2 ai_drawdown:f gross_exposure:f net_exposure:f",
       "SELECT date, ai AS ai_daily_return, spy AS spy_daily_return, ai_equity, spy_equity, cash_holding, ai_drawdown, gross_exposure, net_exposure FROM bt_folio")
def _(t):
    return backtest(t).daily


@query("risk_summary", "ai_roi_pct:f4 spy_roi_pct:f4 max_drawdown_pct:f avg_invested_pct:f ai_sharpe:f spy_sharpe:f correlation:f tracking_error:f information_ratio:f", """
SELECT (arg_max(ai_equity, date) / 1e5 - 1) * 100 AS ai_roi_pct, (arg_max(spy_equity, date) / 1e5 - 1) * 100 AS spy_roi_pct, min(ai_drawdown) * 100 AS max_drawdown_pct,
 avg(inv) * 100 AS avg_invested_pct, avg(ai) / stddev_samp(ai) * sqrt(252) AS ai_sharpe, avg(spy) / stddev_samp(spy) * sqrt(252) AS spy_sharpe, corr(ai, spy) AS correlation,
 stddev_samp(ai - spy) AS tracking_error, avg(ai - spy) / stddev_samp(ai - spy) * sqrt(252) AS information_ratio FROM bt_folio""")
def _(t):
    return backtest(t).risk()


@query("var_cvar", "variance:f historical_var:f historical_cvar:f parametric_var:f parametric_cvar:f", """
SELECT any_value(v) AS variance, -any_value(q) AS historical_var, -avg(ai) FILTER (ai <= q) AS historical_cvar, -(any_value(m) + any_value(s) * -1.6448536269514729e0) AS parametric_var,
 -(any_value(m) - any_value(s) * 0.10313564037537139e0 / 0.05e0) AS parametric_cvar
FROM bt_folio, (SELECT var_samp(ai) AS v, avg(ai) AS m, stddev_samp(ai) AS s, quantile_cont(ai, 0.05) AS q FROM bt_folio)""")
def _(t):
    return backtest(t).value_at_risk(0.95)


@query("trade_analytics", "total_trades:i win_rate_pct:f avg_win_pct:f avg_loss_pct:f gross_profit:f gross_loss:f profit_factor:f", """
SELECT count(*) AS total_trades, 100e0 * count(*) FILTER (r > 0) / count(*) AS win_rate_pct, avg(r) FILTER (r > 0) * 100 AS avg_win_pct, avg(r) FILTER (r <= 0) * 100 AS avg_loss_pct,
 sum(r) FILTER (r > 0) AS gross_profit, abs(sum(r) FILTER (r <= 0)) AS gross_loss, sum(r) FILTER (r > 0) / abs(sum(r) FILTER (r <= 0)) AS profit_factor
FROM (SELECT strategy_return AS r FROM bt_ledger)""")
def _(t):
    return backtest(t).analytics()


@query("monthly_resample", "month:s ai_ret_pct:f spy_ret_pct:f alpha_pct:f max_dd_pct:f exposure_pct:f gross_exposure_pct:f net_exposure_pct:f ai_equity:f spy_equity:f equity_diff:f", """
SELECT strftime(date, '%Y-%m') AS month, round_even((product(1 + ai) - 1) * 100, 2) AS ai_ret_pct, round_even((product(1 + spy) - 1) * 100, 2) AS spy_ret_pct,
 round_even(round_even((product(1 + ai) - 1) * 100, 2) - round_even((product(1 + spy) - 1) * 100, 2), 2) AS alpha_pct, round_even(min(ai_drawdown) * 100, 2) AS max_dd_pct,
 round_even(avg(inv) * 100, 2) AS exposure_pct, round_even(avg(gross_exposure), 2) AS gross_exposure_pct, round_even(avg(net_exposure), 2) AS net_exposure_pct,
 round_even(arg_max(ai_equity, date), 2) AS ai_equity, round_even(arg_max(spy_equity, date), 2) AS spy_equity, round_even(arg_max(ai_equity - spy_equity, date), 2) AS equity_diff
FROM bt_folio GROUP BY 1""")
def _(t):
    return backtest(t).monthly()


@query("regime_attribution", "ai_up_pct:f ai_down_pct:f spy_up_pct:f spy_down_pct:f excess_up_pct:f excess_down_pct:f up_days:i down_days:i", """
SELECT avg(ai) FILTER (spy > 0) * 100 AS ai_up_pct, avg(ai) FILTER (spy < 0) * 100 AS ai_down_pct, avg(spy) FILTER (spy > 0) * 100 AS spy_up_pct, avg(spy) FILTER (spy < 0) * 100 AS spy_down_pct,
 ai_up_pct - spy_up_pct AS excess_up_pct, ai_down_pct - spy_down_pct AS excess_down_pct, count(*) FILTER (spy > 0) AS up_days, count(*) FILTER (spy < 0) AS down_days FROM bt_folio""")
def _(t):
    return backtest(t).regimes()


@query("capm_regression", "capm_beta:f capm_alpha_annual_pct:f", """
SELECT b AS capm_beta, (ma - b * ms) * 25200 AS capm_alpha_annual_pct FROM (SELECT covar_samp(ai, spy) / var_samp(spy) AS b, avg(ai) - 0.051e0 / 252 AS ma, avg(spy) - 0.051e0 / 252 AS ms FROM bt_folio)""")
def _(t):
    return backtest(t).capm()


# Two tracked picks per day, evaluated 15 rows ahead.
SHARED_SQL["tr_recs"] = """
SELECT date, ticker, pred_return_pct, rank_score, CASE WHEN ticker_id % 4 = 0 THEN NULL ELSE current_price END AS current_price FROM signals
QUALIFY row_number() OVER (PARTITION BY date ORDER BY rank_score DESC, pred_return_pct DESC, ticker) <= 2"""
SHARED_SQL["tr_shared"] = "SELECT b.ticker, b.rn, b.date, b.close, m.spy_close, m.mpos FROM numbered_bars b JOIN (SELECT date, spy_close, row_number() OVER (ORDER BY date) AS mpos FROM market) m USING (date)"
SHARED_SQL["tr_entries"] = """
SELECT r.*, e.date AS entry_date, e.rn, e.n_rows, coalesce(CASE WHEN r.current_price > 0 THEN r.current_price END, e.close) AS entry_price, least(e.rn + 15, e.n_rows) AS exit_rn,
 CASE WHEN e.rn + 15 <= e.n_rows THEN 'CLOSED' ELSE 'OPEN' END AS status FROM tr_recs r JOIN numbered_bars e ON e.ticker = r.ticker AND e.date = r.date"""


def _beta_sql(anchor: str) -> str:
    return f"""
SELECT ticker, anchor_rn, CASE WHEN count(*) >= 30 AND var_samp(rm) > 0 THEN covar_samp(rs, rm) / var_samp(rm) END AS beta FROM (
 SELECT a.ticker, a.rn AS anchor_rn, s.close / lag(s.close) OVER w - 1 AS rs, s.spy_close / lag(s.spy_close) OVER w - 1 AS rm
 FROM ({anchor}) a JOIN tr_shared x ON x.ticker = a.ticker AND x.rn = a.rn JOIN tr_shared s ON s.ticker = a.ticker AND s.rn BETWEEN a.rn - 252 AND a.rn AND s.mpos > x.mpos - 253
 WINDOW w AS (PARTITION BY a.ticker, a.rn ORDER BY s.rn)) GROUP BY ALL"""


def _tracker_sql(anchor: str, on: str) -> str:
    return f"""
SELECT t.date AS signal_date, t.ticker, t.entry_date, t.entry_price, x.date AS exit_date, x.close AS exit_price, t.exit_rn - t.rn AS trading_days_held, t.status, 1000e0 AS capital_per_trade,
 1000e0 / t.entry_price AS shares, 1000e0 / t.entry_price * (x.close - t.entry_price) AS pnl_usd, (x.close / t.entry_price - 1) * 100 AS return_pct, b.beta AS capm_beta,
 CASE WHEN t.exit_rn > t.rn THEN x.spy_close / a.spy_close - 1 END AS br, CASE WHEN t.exit_rn > t.rn THEN x.close / a.close - 1 END AS sr, power(1.045e0, greatest(t.exit_rn - t.rn, 1) / 252e0) - 1 AS rf,
 br * 100 AS benchmark_return_pct, (rf + b.beta * (br - rf)) * 100 AS capm_expected_return_pct, sr - (rf + b.beta * (br - rf)) AS capm_alpha_raw, capm_alpha_raw * 100 AS capm_alpha_pct, capm_alpha_raw * 1000 AS capm_alpha_usd
FROM tr_entries t JOIN tr_shared a ON a.ticker = t.ticker AND a.rn = t.rn JOIN tr_shared x ON x.ticker = t.ticker AND x.rn = t.exit_rn LEFT JOIN ({_beta_sql(anchor)}) b ON {on}"""


SHARED_SQL["tr_trades"] = _tracker_sql("SELECT ticker, arg_min(rn, date) AS rn FROM tr_entries GROUP BY ticker", "b.ticker = t.ticker")


def recs(t):
    r = O.top_n_per_group(t.signals, 2, "date", O.signal_order())
    return r.select("date", "ticker", "pred_return_pct", "rank_score",
                    F.when(F.col("ticker_id") % 4 != 0, F.col("current_price")).alias("current_price"))


def tracked(t, mode="first_signal"):
    return T.forward_tracker(recs(t), t.bars, t.market, HOLD, beta_mode=mode)


TRADE_COLS = ("signal_date:d ticker:s entry_date:d entry_price:f exit_date:d exit_price:f trading_days_held:i status:s shares:f pnl_usd:f return_pct:f "
              "benchmark_return_pct:f capm_beta:f capm_expected_return_pct:f capm_alpha_pct:f capm_alpha_raw:f capm_alpha_usd:f")


@query("forward_tracker", TRADE_COLS, "SELECT * FROM tr_trades")
def _(t):
    return tracked(t)


@query("capm_metrics", "signal_date:d ticker:s capm_beta:f capm_alpha_pct:f",
       _tracker_sql("SELECT DISTINCT ticker, rn FROM tr_entries", "b.ticker = t.ticker AND b.anchor_rn = t.rn"))
def _(t):
    return tracked(t, "per_signal")


_SUMMARY = ("total_trades:i closed_trades:i open_trades:i closed_win_rate_pct:f closed_avg_return_pct:f closed_total_pnl_usd:f open_mtm_pnl_usd:f total_pnl_usd:f total_return_on_deployed_pct:f "
            "closed_avg_capm_alpha_pct:f closed_avg_capm_alpha_raw:f closed_total_capm_alpha_usd:f total_capm_alpha_usd:f total_capm_alpha_pct:f total_capm_alpha_raw:f")
SHARED_SQL["tr_summary"] = """
SELECT count(*) AS total_trades, count(*) FILTER (status = 'CLOSED') AS closed_trades, count(*) FILTER (status = 'OPEN') AS open_trades,
 100e0 * count(*) FILTER (status = 'CLOSED' AND pnl_usd > 0) / count(*) FILTER (status = 'CLOSED') AS closed_win_rate_pct, avg(return_pct) FILTER (status = 'CLOSED') AS closed_avg_return_pct,
 sum(pnl_usd) FILTER (status = 'CLOSED') AS closed_total_pnl_usd, sum(pnl_usd) FILTER (status = 'OPEN') AS open_mtm_pnl_usd, sum(pnl_usd) AS total_pnl_usd,
 sum(pnl_usd) / sum(capital_per_trade) * 100 AS total_return_on_deployed_pct, avg(capm_alpha_pct) FILTER (status = 'CLOSED') AS closed_avg_capm_alpha_pct,
 avg(capm_alpha_raw) FILTER (status = 'CLOSED') AS closed_avg_capm_alpha_raw, coalesce(sum(capm_alpha_usd) FILTER (status = 'CLOSED'), 0) AS closed_total_capm_alpha_usd,
 coalesce(sum(capm_alpha_usd), 0) AS total_capm_alpha_usd, coalesce(sum(capm_alpha_usd), 0) / sum(capital_per_trade) * 100 AS total_capm_alpha_pct, coalesce(sum(capm_alpha_usd), 0) / sum(capital_per_trade) AS total_capm_alpha_raw FROM tr_trades"""


@query("trade_summary", _SUMMARY, "SELECT * FROM tr_summary")
def _(t):
    return A.trade_summary(tracked(t))


def _long_sql() -> str:
    parts = []
    for c in _SUMMARY.split():
        n, k = c.split(":")
        if k == "i":
            v = f"CAST({n} AS VARCHAR)"
        elif n.endswith("_usd"):
            v = f"format('{{:,.2f}}', {n})"
        else:
            v = f"CASE WHEN {n} IS NULL THEN 'N/A' WHEN abs({n}) > 100 THEN format('{{:,.2f}}', {n}) WHEN {n} = floor({n}) THEN CAST(CAST({n} AS BIGINT) AS VARCHAR) ELSE format('{{:.4f}}', {n}) END"
        parts.append(f"SELECT '{n.replace('_', ' ').title()}' AS metric, {v} AS value FROM tr_summary")
    return " UNION ALL ".join(parts)


@query("summary_long", "metric:s value:s", _long_sql())
def _(t):
    return A.summary_long(A.trade_summary(tracked(t)))


@query("consolidate_by_ticker", "ticker:s total_shares:f total_cost_basis_usd:f signal_date_first:d signal_date_last:d entry_date_first:d consolidated_capm_alpha_usd:f weighted_avg_entry_price:f consolidated_capm_alpha_raw:f", """
SELECT ticker, sum(shares) AS total_shares, sum(capital_per_trade) AS total_cost_basis_usd, min(signal_date) AS signal_date_first, max(signal_date) AS signal_date_last, arg_min(entry_date, signal_date) AS entry_date_first,
 coalesce(sum(capm_alpha_usd), 0) AS consolidated_capm_alpha_usd, sum(capital_per_trade) / sum(shares) AS weighted_avg_entry_price, coalesce(sum(capm_alpha_usd), 0) / sum(capital_per_trade) AS consolidated_capm_alpha_raw FROM tr_trades GROUP BY ticker""")
def _(t):
    return A.consolidate_by_ticker(tracked(t))


def marked(t):
    return A.mark_positions(tracked(t), A.latest_marks(t.bars))


SHARED_SQL["tr_marks"] = """
SELECT t.*, m.mark AS mark_price, shares * entry_price AS cost_basis_usd, shares * m.mark AS market_value_usd, shares * m.mark - shares * entry_price AS unrealized_pnl_usd,
 (shares * m.mark - shares * entry_price) / (shares * entry_price) * 100 AS unrealized_return_pct FROM tr_trades t JOIN (SELECT ticker, arg_max(close, date) AS mark FROM bars GROUP BY ticker) m USING (ticker)"""


@query("mark_to_market", "signal_date:d ticker:s status:s mark_price:f cost_basis_usd:f market_value_usd:f unrealized_pnl_usd:f unrealized_return_pct:f", "SELECT * FROM tr_marks")
def _(t):
    return marked(t)


@query("mark_by_ticker", "ticker:s total_shares:f total_cost_basis_usd:f mark_price:f market_value_usd:f unrealized_pnl_usd:f weighted_avg_entry_price:f unrealized_return_pct:f", """
SELECT ticker, sum(shares) AS total_shares, sum(cost_basis_usd) AS total_cost_basis_usd, any_value(mark_price) AS mark_price, sum(market_value_usd) AS market_value_usd, sum(unrealized_pnl_usd) AS unrealized_pnl_usd,
 sum(capital_per_trade) / sum(shares) AS weighted_avg_entry_price, (any_value(mark_price) / (sum(capital_per_trade) / sum(shares)) - 1) * 100 AS unrealized_return_pct FROM tr_marks GROUP BY ticker""")
def _(t):
    return A.marks_by_ticker(marked(t))


@query("book_summary", "open_positions:i closed_positions:i open_cost_basis_usd:f open_market_value_usd:f open_unrealized_pnl_usd:f closed_realized_pnl_usd:f book_cost_basis_usd:f book_value_now_usd:f "
       "book_profit_loss_now_usd:f book_profit_loss_now_pct:f portfolio_capm_alpha_usd:f portfolio_capm_alpha_pct:f portfolio_capm_alpha_raw:f", """
SELECT count(*) FILTER (status = 'OPEN') AS open_positions, count(*) FILTER (status = 'CLOSED') AS closed_positions, sum(cost_basis_usd) FILTER (status = 'OPEN') AS open_cost_basis_usd,
 sum(market_value_usd) FILTER (status = 'OPEN') AS open_market_value_usd, open_market_value_usd - open_cost_basis_usd AS open_unrealized_pnl_usd, sum(pnl_usd) FILTER (status = 'CLOSED') AS closed_realized_pnl_usd,
 sum(capital_per_trade) AS book_cost_basis_usd, open_market_value_usd + sum(capital_per_trade) FILTER (status = 'CLOSED') + closed_realized_pnl_usd AS book_value_now_usd,
 book_value_now_usd - book_cost_basis_usd AS book_profit_loss_now_usd, book_profit_loss_now_usd / book_cost_basis_usd * 100 AS book_profit_loss_now_pct, coalesce(sum(capm_alpha_usd), 0) AS portfolio_capm_alpha_usd,
 portfolio_capm_alpha_usd / book_cost_basis_usd * 100 AS portfolio_capm_alpha_pct, portfolio_capm_alpha_usd / book_cost_basis_usd AS portfolio_capm_alpha_raw FROM tr_marks""")
def _(t):
    return A.book_summary(marked(t))


@query("daily_buy_limit", "date:d ticker:s filtered:i", """
SELECT date, ticker, (SELECT count(*) FROM signals) - (SELECT count(*) FROM tr_recs) AS filtered FROM tr_recs""")
def _(t):
    kept = T.daily_buy_limit(t.signals, 2)
    n = t.signals.agg(F.count("*")).scalar()
    return kept.withColumn("filtered", n - kept.agg(F.count("*")).scalar())


SHARED_SQL["monitor"] = """
SELECT *, CASE er WHEN 'buy' THEN CASE WHEN v = 'sell' THEN 'EXIT NOW' WHEN v = 'hold' AND c < ec - 0.2e0 THEN 'TRIM / REDUCE' WHEN held >= 20 AND chg > 3 THEN 'TAKE PROFITS' WHEN held >= 20 AND chg < -5 THEN 'EXIT / STOP LOSS'
  WHEN held >= 20 THEN 'EXIT (thesis complete)' ELSE 'HOLD' END WHEN 'sell' THEN CASE WHEN v = 'buy' THEN 'REVERSE TO BUY' ELSE 'MAINTAIN SELL' END ELSE CASE WHEN v = 'buy' THEN 'UPGRADE TO BUY' ELSE 'HOLD' END END AS exit_signal FROM (
 SELECT s.date AS date_recommended, s.ticker, CASE s.ticker_id % 3 WHEN 0 THEN 'buy' WHEN 1 THEN 'sell' ELSE 'hold' END AS er, (s.ticker_id % 10) / 10e0 AS ec, coalesce(lower(a.recommendation), 'hold') AS v,
  CASE WHEN a.ticker IS NULL THEN 0.5e0 ELSE a.confidence END AS c, date_diff('day', s.date, (SELECT max(date) FROM signals)) AS held, (l.current_price / s.current_price - 1) * 100 AS chg
 FROM signals s JOIN latest_signal l ON l.ticker = s.ticker LEFT JOIN (SELECT ticker, arg_min(recommendation, conv_id) AS recommendation, arg_min(confidence, conv_id) AS confidence FROM agent WHERE confidence IS NOT NULL GROUP BY ticker) a ON a.ticker = s.ticker
 WHERE date_diff('day', s.date, (SELECT max(date) FROM signals)) <= 20 AND s.ticker IN (SELECT ticker FROM tr_recs))"""


@query("position_monitor", "date_recommended:d ticker:s current_verdict:s current_confidence:f days_held:i price_change_pct:f exit_signal:s", """
SELECT date_recommended, ticker, v AS current_verdict, c AS current_confidence, held AS days_held, chg AS price_change_pct, exit_signal FROM monitor""")
def _(t):
    i = F.col("ticker_id")
    old = t.signals.select(
        F.col("date").alias("date_recommended"), "ticker", F.when(i % 3 == 0, "buy").when(i % 3 == 1, "sell").otherwise("hold").alias("entry_recommendation"),
        (i % 10 / F.lit(10.0)).alias("entry_confidence"), F.col("current_price").alias("entry_price"))
    as_of = t.signals.agg(F.max("date")).scalar()
    answers = O.dedupe(agent(t).where("confidence IS NOT NULL"), ["ticker"], [F.col("conv_id").asc()])
    return T.position_monitor(old, latest_signal(t), answers, recs(t), as_of, 20)
