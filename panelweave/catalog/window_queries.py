"""Window operators over the price panel."""

from __future__ import annotations

import re

from pyspark.sql import Window as W, functions as F

from panelweave.catalog.registry import SHARED_SQL, query
from panelweave.operators import ordering as O, windows as X

SHARED_SQL["panel"] = "SELECT b.*, spy_open, spy_close, spy_volume, vix_close FROM bars b JOIN market m USING (date)"


def panel(t):
    """Bars with the market columns of the day."""
    return t.bars.join(t.market, "date")


PW = "OVER (PARTITION BY ticker ORDER BY date)"
PANEL_FEATURES = ["open", "high", "low", "close", "volume", "spy_open", "spy_close", "spy_volume", "vix_close"]

# Relative changes, then differences of the vix column; shared by the feature oracles.
SHARED_SQL["features"] = "SELECT * EXCLUDE (vix_close), coalesce(vix_close - lag(vix_close) " + PW + ", 0) AS vix_close FROM (SELECT ticker, date, " + ", ".join(
    f"coalesce({c} / nullif(lag({c}) {PW}, 0) - 1, 0) AS {c}" for c in PANEL_FEATURES) + " FROM panel)"


@query("pct_change", "ticker:s date:d close:f volume:f", f"""
SELECT ticker, date, greatest(-0.5, least(0.5, coalesce(close / nullif(lag(close) {PW}, 0) - 1, 0))) AS close,
 greatest(-0.5, least(0.5, coalesce(volume / nullif(lag(volume) {PW}, 0) - 1, 0))) AS volume FROM bars""")
def _(t):
    return X.pct_change(t.bars, ["close", "volume"], 0.5)


@query("diff", "ticker:s date:d close:f", f"SELECT ticker, date, coalesce(close - lag(close) {PW}, 0) AS close FROM bars")
def _(t):
    return X.diff(t.bars, ["close"])


@query("feature_transform", "ticker:s date:d open:f close:f volume:f spy_close:f vix_close:f",
       "SELECT ticker, date, open, close, volume, spy_close, vix_close FROM features")
def _(t):
    return X.feature_transform(panel(t), PANEL_FEATURES)


# News vectors moved into the years of the price panel; the first vector of a day is kept.
SHARED_SQL["old_vectors"] = """
SELECT ticker, date - 6940 AS date, emb FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY vec_id) AS r FROM vectors) WHERE r = 1"""
SHARED_SQL["bar_bounds"] = "SELECT ticker, min(date) AS first, max(date) AS last FROM bars GROUP BY ticker"
VECTOR_DIM = 64
DIMS = [f"dim_{i + 1}" for i in range(VECTOR_DIM)]


def old_vectors(t):
    v = O.dedupe(t.vectors, ["ticker", "date"], [F.col("vec_id").asc()])
    return v.select("ticker", F.date_sub("date", 6940).alias("date"),
                    *[F.expr(f"CAST(emb[{i}] AS DOUBLE) AS {d}") for i, d in enumerate(DIMS)])


def bar_bounds(t):
    return t.bars.groupBy("ticker").agg(F.min("date").alias("first"), F.max("date").alias("last"))


# Weighted sum over past event days; the first calendar day of the bounds has full weight.
def _decay(points: str) -> str:
    return f"""
SELECT p.ticker, p.date, sum(w * v.emb[1]) AS dim_1, sum(w * v.emb[64]) AS dim_64, sum(w * v.total) AS total FROM (
 SELECT p.ticker, p.date, v.date AS vdate, (CASE WHEN v.date = b.first THEN 1e0 ELSE 0.3e0 END) * power(0.7e0, date_diff('day', v.date, p.date) - 1) AS w
 FROM {points} p JOIN bar_bounds b USING (ticker) JOIN old_vectors v ON v.ticker = p.ticker AND v.date < p.date AND v.date >= b.first AND v.date <= b.last) p
JOIN (SELECT *, list_sum(list_transform(emb, lambda x, i: CAST(x AS DOUBLE) * i)) AS total FROM old_vectors) v ON v.ticker = p.ticker AND v.date = p.vdate
GROUP BY p.ticker, p.date"""


def _dim_total():
    return F.expr(" + ".join(f"{d} * {i + 1}" for i, d in enumerate(DIMS)))


@query("ewma_calendar", "ticker:s date:d dim_1:f dim_64:f total:f", f"""
SELECT c.ticker, c.date, CASE WHEN c.date > c.first THEN coalesce(dim_1, 0) END AS dim_1, CASE WHEN c.date > c.first THEN coalesce(dim_64, 0) END AS dim_64,
 CASE WHEN c.date > c.first THEN coalesce(total, 0) END AS total
FROM (SELECT ticker, first, CAST(unnest(generate_series(first, last, INTERVAL 1 DAY)) AS DATE) AS date FROM bar_bounds WHERE ticker IN (SELECT ticker FROM old_vectors)) c
LEFT JOIN ({_decay("(SELECT ticker, CAST(unnest(generate_series(first, last, INTERVAL 1 DAY)) AS DATE) AS date FROM bar_bounds)")}) y USING (ticker, date)""")
def _(t):
    v = old_vectors(t)
    bounds = bar_bounds(t).join(v.select("ticker").distinct(), "ticker", "left_semi")
    return X.ewma_calendar(v, DIMS, bounds).withColumn("total", _dim_total())


@query("left_news_vectors", "ticker:s date:d close:f dim_1:f dim_64:f total:f", f"""
SELECT b.ticker, b.date, close, coalesce(dim_1, 0) AS dim_1, coalesce(dim_64, 0) AS dim_64, coalesce(total, 0) AS total
FROM bars b LEFT JOIN ({_decay("bars")}) y ON b.ticker = y.ticker AND b.date = y.date""")
def _(t):
    from panelweave.operators.joins import join_news_vectors
    return join_news_vectors(t.bars, old_vectors(t), DIMS).withColumn("total", _dim_total())


def _fold(expr: str, a: str, keep: str) -> str:
    return f"list_reduce({expr}, lambda y, x: {keep} * y + {a} * x)"


@query("rsi_14", "ticker:s date:d rsi_14:f", f"""
SELECT ticker, date, coalesce(CASE WHEN i >= 15 AND l <> 0 THEN 100 - 100 / (1 + g / l) END, 50) AS rsi_14 FROM (
 SELECT ticker, date, i, CASE WHEN i >= 15 THEN {_fold("gs[2:]", "(1/14e0)", "(1 - 1/14e0)")} END AS g,
   CASE WHEN i >= 15 THEN {_fold("ls[2:]", "(1/14e0)", "(1 - 1/14e0)")} END AS l FROM (
  SELECT ticker, date, row_number() {PW} AS i, list(greatest(d, 0)) {PW} AS gs, list(greatest(-d, 0)) {PW} AS ls
  FROM (SELECT ticker, date, close - lag(close) {PW} AS d FROM bars)))""")
def _(t):
    return X.rsi(t.bars)


@query("macd_12_26_9", "ticker:s date:d macd_line:f macd_hist:f macd_signal:f", f"""
SELECT ticker, date, coalesce(m, 0) AS macd_line, coalesce(m - s, 0) AS macd_hist, coalesce(s, 0) AS macd_signal FROM (
 SELECT ticker, date, m, CASE WHEN i >= 34 THEN {_fold("ms[26:]", "0.2e0", "0.8e0")} END AS s FROM (
  SELECT ticker, date, i, m, list(m) {PW} AS ms FROM (
   SELECT ticker, date, i, CASE WHEN i >= 26 THEN {_fold("cs", "(2/13e0)", "(1 - 2/13e0)")} - {_fold("cs", "(2/27e0)", "(1 - 2/27e0)")} END AS m FROM (
    SELECT ticker, date, row_number() {PW} AS i, list(close) {PW} AS cs FROM bars))))""")
def _(t):
    return X.macd(t.bars)


@query("grouped_series", "ticker:s date:d smooth:f", f"""
SELECT ticker, date, {_fold("vs", "0.1e0", "0.9e0")} AS smooth FROM (SELECT ticker, date, list(volume) {PW} AS vs FROM bars)""")
def _(t):
    w = W.partitionBy("ticker").orderBy("date")
    pos = t.bars.withColumn("_pos", F.row_number().over(w) - 1)
    return X.add_ewma_present(pos, {"smooth": X.GapEwma("volume", 0.1)})


# The panel with holes: every 17th close of even tickers and every 211th of odd ones is missing, and one is NaN.
SHARED_SQL["panel_gaps"] = f"""
SELECT * REPLACE (CASE WHEN isnan(close) THEN NULL ELSE close END AS close, CASE WHEN i % 17 = 0 THEN NULL ELSE volume END AS volume) FROM (
 SELECT * REPLACE (CASE WHEN i % CASE WHEN ticker_id % 2 = 0 THEN 17 ELSE 211 END = 0 THEN NULL WHEN ticker_id = 1 AND i = 20 THEN CAST('NaN' AS DOUBLE) ELSE close END AS close)
 FROM (SELECT *, row_number() {PW} AS i FROM panel))"""


def panel_gaps(t):
    i, n = F.row_number().over(W.partitionBy("ticker").orderBy("date")), F.when(F.col("ticker_id") % 2 == 0, 17).otherwise(211)
    hole = F.when((F.col("ticker_id") == 1) & (F.col("i") == 20), float("nan")).when(F.col("i") % n != 0, F.col("close"))
    return panel(t).withColumn("i", i).withColumns({"close": hole, "volume": F.when(F.col("i") % 17 != 0, F.col("volume"))}).drop("i")


def _gaps(x: str, alpha: str) -> str:
    """Fold of the present values: g rows after the last one, q^g of the old mean meets alpha of the new value."""
    q = f"power(1 - {alpha}, g)"
    e = f"{{'a': coalesce({q} / ({q} + {alpha}), 0), 'v': {x} * coalesce({alpha} / ({q} + {alpha}), 1)}}"
    return f"list_reduce(list({e}) FILTER ({x} IS NOT NULL) {PW}, lambda s, e: {{'a': e.a, 'v': e.a * s.v + e.v}}).v"


def _since(x: str) -> str:
    return f"i - max(CASE WHEN {x} IS NOT NULL THEN i END) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g"


@query("rsi_14_gaps", "ticker:s date:d rsi_14:f", f"""
SELECT ticker, date, coalesce(CASE WHEN k >= 14 AND l <> 0 THEN 100 - 100 / (1 + u / l) END, 50) AS rsi_14 FROM (
 SELECT ticker, date, count(d) {PW} AS k, {_gaps("greatest(d, d * 0)", "(1/14e0)")} AS u, {_gaps("greatest(-d, d * 0)", "(1/14e0)")} AS l
 FROM (SELECT *, {_since("d")} FROM (SELECT ticker, date, i, close - lag(close) {PW} AS d FROM panel_gaps)))""")
def _(t):
    return X.rsi(panel_gaps(t))


@query("macd_12_26_9_gaps", "ticker:s date:d macd_line:f macd_hist:f macd_signal:f", f"""
SELECT ticker, date, coalesce(m, 0) AS macd_line, coalesce(m - s, 0) AS macd_hist, coalesce(s, 0) AS macd_signal FROM (
 SELECT ticker, date, m, CASE WHEN count(m) {PW} >= 9 THEN {_gaps("m", "0.2e0")} END AS s FROM (
  SELECT *, {_since("m")} FROM (
   SELECT ticker, date, i, CASE WHEN count(close) {PW} >= 26 THEN {_gaps("close", "(2/13e0)")} - {_gaps("close", "(2/27e0)")} END AS m
   FROM (SELECT *, {_since("close")} FROM panel_gaps))))""")
def _(t):
    return X.macd(panel_gaps(t))


@query("grouped_series_gaps", "ticker:s date:d smooth:f", f"""
SELECT ticker, date, {_gaps("volume", "0.1e0")} AS smooth FROM (SELECT *, {_since("volume")} FROM panel_gaps)""")
def _(t):
    pos = panel_gaps(t).withColumn("_pos", F.row_number().over(W.partitionBy("ticker").orderBy("date")) - 1)
    return X.add_ewma_present(pos, {"smooth": X.GapEwma("volume", 0.1)})


SHARED_SQL["betas"] = f"""
SELECT * EXCLUDE (rs, rm, n, raw), CASE WHEN n = 60 THEN coalesce(greatest(-2, least(3, raw)), 1) ELSE 1e0 END AS beta FROM (
 SELECT *, count(rs) OVER f AS n, CASE WHEN var_samp(rm) OVER f <> 0 THEN covar_samp(rs, rm) OVER f / var_samp(rm) OVER f END AS raw FROM (
  SELECT *, close / lag(close) {PW} - 1 AS rs, spy_close / lag(spy_close) {PW} - 1 AS rm FROM panel)
 WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))"""


@query("rolling_beta_60", "ticker:s date:d beta:f", "SELECT ticker, date, beta FROM betas")
def _(t):
    return X.rolling_beta(panel(t))


@query("rolling_mean_20", "ticker:s date:d close_mean20:f volume_mean20:f", """
SELECT ticker, date, CASE WHEN count(*) OVER f = 20 THEN avg(close) OVER f END AS close_mean20,
 CASE WHEN count(*) OVER f = 20 THEN avg(volume) OVER f END AS volume_mean20 FROM bars
WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def _(t):
    return X.trailing_mean(t.bars, ["close", "volume"])


@query("lag_calendar_day", "date:d spy_close:f", """
SELECT m.date, p.spy_close FROM market m LEFT JOIN market p ON p.date = m.date - 1""")
def _(t):
    return X.lag_calendar_day(t.market.withColumn("k", F.lit("spy")), ["spy_close"], key="k")


SHARED_SQL["labelled"] = f"""
SELECT *, row_number() {PW} AS rn, lag(beta) {PW} AS beta_prev, lead(close, 19) {PW} AS xs, lead(spy_close, 19) {PW} AS xm,
 lead(1, 19) {PW} IS NOT NULL AS full19, lead(1, 20) {PW} IS NOT NULL AS full20 FROM betas"""
_LABEL = "((xs - open) / open - {b} * ((xm - spy_open) / spy_open)) * 100"


@query("forward_alpha_label", "ticker:s date:d label:f",
       f"SELECT ticker, date, {_LABEL.format(b='beta_prev')} AS label FROM labelled WHERE rn > 60 AND full20")
def _(t):
    return X.forward_alpha_label(X.rolling_beta(panel(t)), "sequence")


@query("forward_alpha_label_inference", "ticker:s date:d label:f actual_return_pct:f",
       f"SELECT ticker, date, {_LABEL.format(b='beta')} AS label, (xs / open - 1) * 100 AS actual_return_pct FROM labelled WHERE rn > 60 AND full19")
def _(t):
    return X.forward_alpha_label(X.rolling_beta(panel(t)), "inference")


_STATS = ("close", "volume", "vix_close")


@query("window60_features", "ticker:s date:d " + " ".join(f"{c}_last:f {c}_mean:f {c}_std:f" for c in _STATS),
       "SELECT * FROM (SELECT ticker, date, count(*) OVER f AS n, " + ", ".join(
           f"lag({c}) {PW} AS {c}_last, avg({c}) OVER f AS {c}_mean, stddev_pop({c}) OVER f AS {c}_std" for c in _STATS) + """
 FROM features WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)) WHERE n = 60""")
def _(t):
    return X.window_stats(X.feature_transform(panel(t), PANEL_FEATURES), _STATS).where("_hist = 60")


# The same sub-queries over the panel with holes.
for _name in ("betas", "labelled", "features"):
    SHARED_SQL[f"{_name}_gaps"] = re.sub(r"\b(panel|betas)\b", r"\1_gaps", SHARED_SQL[_name])


@query("rolling_beta_60_gaps", "ticker:s date:d beta:f", "SELECT ticker, date, beta FROM betas_gaps")
def _(t):
    return X.rolling_beta(panel_gaps(t))


@query("window60_features_gaps", "ticker:s date:d close_last:f close_mean:f close_std:f volume_mean:f volume_std:f", f"""
SELECT ticker, date, lag(close) {PW} AS close_last, avg(close) OVER f AS close_mean, stddev_pop(close) OVER f AS close_std,
 avg(volume) OVER f AS volume_mean, stddev_pop(volume) OVER f AS volume_std
FROM panel_gaps WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) QUALIFY count(*) OVER f = 60""")
def _(t):
    s = X.window_stats(panel_gaps(t), ["close", "volume"]).where("_hist = 60")
    return s.withColumn("close_last", X.N.finite(F.col("close_last")))


@query("window60_sequences", "ticker:s date:d n_rows:i n_cols:i first_close:f last_close:f", """
SELECT ticker, date, 60 AS n_rows, 2 AS n_cols, CAST(lag(close, 60) OVER w AS FLOAT) AS first_close, CAST(lag(close, 1) OVER w AS FLOAT) AS last_close
FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date) QUALIFY row_number() OVER w > 60""")
def _(t):
    s = X.window_sequences(t.bars, ["close", "volume"])
    return s.select("ticker", "date", F.size("seq").alias("n_rows"), F.size(F.col("seq")[0]).alias("n_cols"),
                    F.col("seq")[0][0].alias("first_close"), F.col("seq")[59][0].alias("last_close"))


@query("equity_curve", "date:d equity:f4", """
SELECT date, 1000e0 * exp(sum(ln(1 + r)) OVER (ORDER BY date)) AS equity FROM (
 SELECT date, coalesce(spy_close / lag(spy_close) OVER (ORDER BY date) - 1, 0) AS r FROM market)""")
def _(t):
    m = t.market.withColumn("k", F.lit("spy"))
    return X.equity_curve(X.pct_change(m.withColumn("r", F.col("spy_close")), ["r"], key="k"), "r", 1000.0)


@query("cash_holding", "date:d cash_holding:f", """
SELECT date, 1000e0 + sum(flow) OVER (ORDER BY date) AS cash_holding FROM (
 SELECT date, CAST(sum(CASE WHEN ticker_id % 2 = 0 THEN volume ELSE -volume END) AS DOUBLE) AS flow FROM bars GROUP BY date)""")
def _(t):
    flow = F.when(F.col("ticker_id") % 2 == 0, F.col("volume")).otherwise(-F.col("volume"))
    return X.running_cash(t.bars.groupBy("date").agg(F.sum(flow).alias("flow")), "flow", 1000.0)


@query("drawdown", "date:d drawdown:f", """
SELECT date, (spy_close - max(spy_close) OVER (ORDER BY date)) / max(spy_close) OVER (ORDER BY date) AS drawdown FROM market""")
def _(t):
    return X.drawdown(t.market, "spy_close")


@query("forward_fill", "ticker:s date:d close:f", """
SELECT ticker, date, last_value(c IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS close
FROM (SELECT ticker, date, CASE WHEN day(date) % 3 = 0 THEN close END AS c FROM bars)""")
def _(t):
    return X.forward_fill(t.bars.withColumn("close", F.when(F.day("date") % 3 == 0, F.col("close"))), ["close"])


@query("recent_return", "ticker:s date:d recent_return_pct:f",
       f"SELECT ticker, date, (close / nullif(lag(close, 20) {PW}, 0) - 1) * 100 AS recent_return_pct FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1")
def _(t):
    return O.dedupe(X.recent_return(t.bars), ["ticker"], [F.col("date").desc()])


@query("momentum_context", "ticker:s date:d ret_5d:f ret_20d:f vol_20d:f", f"""
SELECT ticker, date, (close / lag(close, 4) {PW} - 1) * 100 AS ret_5d, (close / lag(close, 19) {PW} - 1) * 100 AS ret_20d,
 CASE WHEN row_number() {PW} >= 20 THEN stddev_samp(r) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * sqrt(252) * 100 END AS vol_20d
FROM (SELECT *, close / lag(close) {PW} - 1 AS r FROM bars)""")
def _(t):
    return X.momentum_context(t.bars)


@query("holding_position", "ticker:s date:d rn:i exit_rn:i status:s", f"""
SELECT ticker, date, rn, least(rn + 15, n) AS exit_rn, CASE WHEN rn + 15 <= n THEN 'CLOSED' ELSE 'OPEN' END AS status
FROM (SELECT ticker, date, row_number() {PW} AS rn, count(*) OVER (PARTITION BY ticker) AS n FROM bars)""")
def _(t):
    return X.holding_exit(X.positions(t.bars), 15)


@query("flagship_top_pick_analytics", "trades:i win_rate_pct:f avg_win_pct:f avg_loss_pct:f profit_factor:f", f"""
SELECT count(*) AS trades, 100e0 * count(*) FILTER (r > 0) / count(*) AS win_rate_pct, avg(r) FILTER (r > 0) * 100 AS avg_win_pct,
 avg(r) FILTER (r <= 0) * 100 AS avg_loss_pct, sum(r) FILTER (r > 0) / abs(sum(r) FILTER (r <= 0)) AS profit_factor FROM (
 SELECT l.date, {_LABEL.format(b='beta_prev')} / 100 AS r FROM labelled l JOIN signals s ON l.ticker = s.ticker AND l.date = s.date
 WHERE l.rn > 60 AND full20 QUALIFY row_number() OVER (PARTITION BY l.date ORDER BY rank_score DESC, pred_return_pct DESC, l.ticker) = 1)""")
def _(t):
    from panelweave.operators.aggregates import trade_analytics
    labelled = X.forward_alpha_label(X.rolling_beta(panel(t)), "sequence").select("ticker", "date", "label")
    picks = O.top_n_per_group(labelled.join(t.signals, ["ticker", "date"]), 1, "date", O.signal_order())
    return trade_analytics(picks.withColumn("ret", F.col("label") / 100), "ret").withColumnRenamed("total_trades", "trades")
