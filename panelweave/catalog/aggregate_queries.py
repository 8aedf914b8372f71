"""Aggregations over the fixture views; those on trades and portfolios live in trade_queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.catalog.registry import SHARED_SQL, query
from panelweave.operators import aggregates as A, grid as G, joins as J, ordering as O, user_aggregates as U


@query("daily_vector_mean", "ticker:s date:d dim:i value:f", """
SELECT ticker, date, dim, avg(CAST(v AS DOUBLE)) AS value FROM (SELECT ticker, date, unnest(emb) AS v, unnest(range(64)) AS dim FROM vectors) GROUP BY ALL""")
def _(t):
    return A.daily_vector_mean(t.vectors, 64).select("ticker", "date", F.posexplode("emb").alias("dim", "value"))


@query("mean_prediction", "date:d ticker:s mean_pred:f", """
SELECT date, ticker, avg(pred_return_pct) AS mean_pred FROM (SELECT date, ticker, pred_return_pct FROM signals UNION ALL
 SELECT date, ticker, rank_score FROM signals WHERE ticker_id % 2 = 0) GROUP BY date, ticker""")
def _(t):
    more = t.signals.where("ticker_id % 2 = 0").select("date", "ticker", F.col("rank_score").alias("pred_return_pct"))
    return J.mean_prediction(t.signals.select("date", "ticker", "pred_return_pct").union(more))


def scored(t):
    return t.signals.select("date", "ticker_id", F.col("pred_return_pct").alias("pred"), F.col("rank_score").alias("score"),
                            F.col("actual_20d_return_pct").alias("actual"))


SHARED_SQL["scored"] = "SELECT date, ticker_id, pred_return_pct AS pred, rank_score AS score, actual_20d_return_pct AS actual FROM signals"
_BIN = "greatest(0, CAST(ceil((row_number() OVER (ORDER BY {c}, date, ticker_id) - 1) * 10 / CAST(count(*) OVER () - 1 AS DOUBLE)) AS INT) - 1)"
SHARED_SQL["bands"] = f"""
SELECT pred_bin, score_bin, count(*) AS n, avg(actual) AS mean_actual, median(actual) AS median_actual, count(*) FILTER (actual > 0) / CAST(count(*) AS DOUBLE) AS win_rate,
 avg(pred) AS mean_pred, avg(score) AS mean_score FROM (SELECT *, {_BIN.format(c="pred")} AS pred_bin, {_BIN.format(c="score")} AS score_bin FROM scored) GROUP BY 1, 2"""
TIES = ["date", "ticker_id"]


def bands(t):
    return G.score_bands(scored(t), 10, [F.col(c) for c in TIES])


@query("score_bands", "pred_bin:i score_bin:i n:i mean_actual:f median_actual:f win_rate:f mean_pred:f mean_score:f", "SELECT * FROM bands")
def _(t):
    return bands(t)


SHARED_SQL["grid_cells"] = """
SELECT p AS pred_min, s AS score_min, count(*) AS n, avg(actual) AS mean_actual, median(actual) AS median_actual, count(*) FILTER (actual > 0) / CAST(count(*) AS DOUBLE) AS win_rate,
 avg(pred) AS mean_pred, avg(score) AS mean_score, avg(actual) * ln(1 + count(*)) AS score
FROM (SELECT DISTINCT unnest(quantile_cont(pred, [0.95e0 * i / 14 FOR i IN range(15)])) AS p FROM scored),
 (SELECT DISTINCT unnest(quantile_cont(score, [0.95e0 * i / 14 FOR i IN range(15)])) AS s FROM scored) JOIN scored ON pred >= p AND scored.score >= s
GROUP BY p, s HAVING count(*) >= 30"""


def grid(t):
    return G.threshold_grid(scored(t), 15, 30)


@query("threshold_grid", "pred_min:f score_min:f n:i mean_actual:f median_actual:f win_rate:f mean_pred:f mean_score:f score:f", "SELECT * FROM grid_cells")
def _(t):
    return grid(t)


@query("best_threshold", "pred_min:f score_min:f n:i mean_actual:f score:f", """
SELECT pred_min, score_min, n, mean_actual, score FROM grid_cells ORDER BY mean_actual DESC, win_rate DESC, n DESC, score DESC LIMIT 1""")
def _(t):
    return G.best_threshold(grid(t))


@query("pivot_heatmap", "score_bin:i " + " ".join(f"b{i}:f" for i in range(10)),
       "SELECT score_bin, " + ", ".join(f"max(mean_actual) FILTER (pred_bin = {i}) AS b{i}" for i in range(10)) + " FROM bands GROUP BY score_bin")
def _(t):
    return G.pivot_heatmap(bands(t), "score_bin", "pred_bin", "mean_actual", range(10), "b")


@query("threshold_pivot", "ci:i pred_min:f " + " ".join(f"s{i}:f" for i in range(1, 16)), "SELECT ci, pred_min, " + ", ".join(
    f"max(mean_actual) FILTER (cj = {i}) AS s{i}" for i in range(1, 16)) + """
FROM (SELECT *, dense_rank() OVER (ORDER BY pred_min) AS ci, dense_rank() OVER (ORDER BY score_min) AS cj FROM grid_cells) GROUP BY ci, pred_min""")
def _(t):
    cells = grid(t).checkpoint()  # at most 225 rows
    names = cells.groupBy("ci").agg(F.first("pred_min").alias("pred_min"))
    return G.pivot_heatmap(cells, "ci", "cj", "mean_actual", range(1, 16), "s").join(names, "ci")


_Q = (1, 5, 10, 25, 50, 75, 90, 95, 99)


def _describe_sql(c):
    q = ", ".join(f"quantile_cont({c}, {p / 100}) AS q_{p}" for p in _Q)
    return (f"SELECT '{c}' AS \"column\", count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max, {q} FROM signals")


@query("describe_quantiles", "column:s n:i mean:f std:f min:f max:f " + " ".join(f"q_{p}:f" for p in _Q),
       " UNION ALL ".join(_describe_sql(c) for c in ("pred_return_pct", "rank_score", "actual_20d_return_pct")))
def _(t):
    return A.describe(t.signals, ["pred_return_pct", "rank_score", "actual_20d_return_pct"])


@query("histogram_20", "bin:i left_edge:f right_edge:f n:i", """
SELECT b AS bin, a + b * w AS left_edge, a + (b + 1) * w AS right_edge, count(x) AS n FROM (SELECT min(actual_20d_return_pct) AS a, (max(actual_20d_return_pct) - min(actual_20d_return_pct)) / 20 AS w FROM signals) e,
 (SELECT unnest(range(20)) AS b) s LEFT JOIN (SELECT actual_20d_return_pct AS x, least(19, CAST(floor((actual_20d_return_pct - (SELECT min(actual_20d_return_pct) FROM signals)) /
  (SELECT (max(actual_20d_return_pct) - min(actual_20d_return_pct)) / 20 FROM signals)) AS INT)) AS xb FROM signals WHERE actual_20d_return_pct IS NOT NULL) v ON xb = b GROUP BY ALL""")
def _(t):
    return A.histogram(t.signals, "actual_20d_return_pct")


@query("consensus", "ticker:s runs:i verdicts:s decisions:s min_confidence:f max_confidence:f avg_confidence:f consensus:s votes:i", """
SELECT ticker, count(*) AS runs, array_to_string(list_sort(list(DISTINCT verdict)), ', ') AS verdicts, array_to_string(list_sort(list(DISTINCT decision)), ', ') AS decisions,
 min(conf) AS min_confidence, max(conf) AS max_confidence, avg(conf) AS avg_confidence, any_value(mv) AS consensus, any_value(mn) AS votes FROM (
 SELECT concat('T', l_suppkey) AS ticker, concat(l_returnflag, l_linestatus) AS verdict, l_returnflag AS decision, l_discount * 10 AS conf FROM lineitem)
JOIN (SELECT ticker AS t2, arg_min(verdict, (-n, verdict)) AS mv, max(n) AS mn FROM (SELECT concat('T', l_suppkey) AS ticker, concat(l_returnflag, l_linestatus) AS verdict, count(*) AS n
 FROM lineitem GROUP BY ALL) GROUP BY ticker) ON t2 = ticker GROUP BY ticker""")
def _(t):
    runs = t.raw("lineitem").select(
        F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("ticker"), F.concat("l_returnflag", "l_linestatus").alias("verdict"),
        F.col("l_returnflag").alias("decision"), (F.col("l_discount") * 10).alias("confidence"))
    return A.consensus(runs)


@query("tickers_per_date", "date:d tickers:s", """
SELECT date, string_agg(ticker, ', ' ORDER BY rank_score DESC, pred_return_pct DESC, ticker) AS tickers FROM (SELECT * FROM signals
 QUALIFY row_number() OVER (PARTITION BY date ORDER BY rank_score DESC, pred_return_pct DESC, ticker) <= 3) GROUP BY date ORDER BY date DESC LIMIT 20""")
def _(t):
    from pyspark.sql import Window as W
    top = O.top_n_per_group(t.signals, 3, "date", O.signal_order())
    return A.tickers_per_date(top.withColumn("rank", F.row_number().over(W.partitionBy("date").orderBy(*O.signal_order()))), last=20)


@query("coverage_funnel", "input_signals:i filtered_by_turnover:i filtered_by_daily_limit:i evaluated_trades:i skipped_missing_price:i skipped_no_later_price:i", """
SELECT (SELECT count(*) FROM signals) AS input_signals, (SELECT count(*) FROM signals WHERE dollar_turnover < 50000) AS filtered_by_turnover,
 (SELECT count(*) FROM signals WHERE dollar_turnover >= 50000) - count(*) AS filtered_by_daily_limit, count(*) FILTER (k IS NOT NULL AND d) AS evaluated_trades,
 count(*) FILTER (k IS NULL) AS skipped_missing_price, count(*) FILTER (k IS NOT NULL AND NOT d) AS skipped_no_later_price FROM (
 SELECT s.date, s.ticker, b.ticker AS k, s.date <= b.last AS d FROM (SELECT * FROM signals WHERE dollar_turnover >= 50000
   QUALIFY row_number() OVER (PARTITION BY date ORDER BY rank_score DESC, pred_return_pct DESC, ticker) <= 2) s
 LEFT JOIN (SELECT ticker, max(date) AS last FROM bars WHERE ticker_id % 5 <> 0 AND date < DATE '2000-01-01' GROUP BY ticker) b USING (ticker))""")
def _(t):
    old = t.bars.where("ticker_id % 5 <> 0 AND date < '2000-01-01'")
    rich = t.signals.where("dollar_turnover >= 50000")
    entries = J.entry_forward(O.top_n_per_group(rich, 2, "date", O.signal_order()), old)
    return A.coverage_funnel(t.signals, entries, old, 50_000, 2)


@query("win_rate_lambda", "ticker:s win_rate:f compound_return:f", """
SELECT ticker, count(*) FILTER (pred_return_pct > 0) / CAST(count(*) AS DOUBLE) AS win_rate, product(1 + rank_score / 100) - 1 AS compound_return FROM signals GROUP BY ticker""")
def _(t):
    from panelweave.functions import numeric as N
    return t.signals.groupBy("ticker").agg(N.share(F.col("pred_return_pct") > 0).alias("win_rate"),
                                           N.compound(F.col("rank_score") / 100).alias("compound_return"))


@query("quality_by_key", "ticker:s quality:f articles:i", """
SELECT ticker, avg(quality) AS quality, count(*) AS articles FROM news JOIN labels USING (doc_id) GROUP BY ticker""")
def _(t):
    return A.quality_by_key(t.news, t.raw("labels"))


# The same two measures, written by the caller: a state of sums, and of logarithms for the product.
def _measures():
    import numpy as np

    def update(s, rows):
        return (s[0] + int((rows["pred_return_pct"] > 0).sum()), s[1] + len(rows), s[2] * float(np.prod(1 + rows["rank_score"] / 100)))

    return U.UserAggregate("wins long, n long, growth double", "win_rate double, compound_return double", lambda: (0, 0, 1.0), update,
                           lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] * b[2]), lambda s: (s[0] / s[1], s[2] - 1))


@query("win_rate_user_aggregate", "ticker:s win_rate:f compound_return:f", """
SELECT ticker, count(*) FILTER (pred_return_pct > 0) / CAST(count(*) AS DOUBLE) AS win_rate, product(1 + rank_score / 100) - 1 AS compound_return FROM signals GROUP BY ticker""")
def _(t):
    return U.aggregate(t.signals, ["ticker"], ["pred_return_pct", "rank_score"], _measures())
