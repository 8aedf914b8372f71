"""Joins over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.catalog.registry import SHARED_SQL, query
from panelweave.operators import aggregates as A, grid as G, joins as J, ordering as O, windows as X
from panelweave.sources.readers import lag_publication

SHARED_SQL["sparse_market"] = "SELECT date, spy_close, CASE WHEN day(date) <> 4 THEN vix_close END AS vix_close FROM market WHERE day(date) % 4 = 0"


def sparse_market(t):
    m = t.market.where(F.day("date") % 4 == 0)
    return m.select("date", "spy_close", F.when(F.day("date") != 4, F.col("vix_close")).alias("vix_close"))


@query("asof_backward_market", "ticker:s date:d close:f spy_close:f vix_close:f", """
SELECT b.ticker, b.date, b.close, m.spy_close, m.vix_close FROM bars b ASOF JOIN sparse_market m ON b.date >= m.date WHERE m.vix_close IS NOT NULL""")
def _(t):
    return J.align_market(t.bars, sparse_market(t))


@query("left_market_ffill", "ticker:s date:d close:f spy_close:f vix_close:f", """
SELECT b.ticker, b.date, b.close, last_value(m.spy_close IGNORE NULLS) OVER w AS spy_close, last_value(m.vix_close IGNORE NULLS) OVER w AS vix_close
FROM bars b LEFT JOIN sparse_market m ON b.date = m.date WINDOW w AS (PARTITION BY b.ticker ORDER BY b.date ROWS UNBOUNDED PRECEDING)""")
def _(t):
    return J.join_market_ffill(t.bars, sparse_market(t))


SHARED_SQL["monthly_macro"] = """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS m2sl FROM orders GROUP BY 1"""


def monthly_macro(t):
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return (t.raw("orders").groupBy(F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("date"))
            .agg((total / F.count("*")).alias("m2sl")))


@query("scan_macro_lagged", "date:d m2sl:f", "SELECT date + 45 AS date, m2sl FROM monthly_macro")
def _(t):
    return lag_publication(monthly_macro(t), 45)


@query("outer_macro_merge", "date:d spy_close:f vix_close:f m2sl:f", """
SELECT date, last_value(spy_close IGNORE NULLS) OVER w AS spy_close, last_value(vix_close IGNORE NULLS) OVER w AS vix_close, last_value(m2sl IGNORE NULLS) OVER w AS m2sl FROM (
 SELECT date, spy_close, vix_close, m2sl FROM (SELECT date, spy_close FROM market) a FULL JOIN (SELECT date, vix_close FROM sparse_market) b USING (date)
 FULL JOIN (SELECT date + 45 AS date, m2sl FROM monthly_macro) c USING (date)) WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)""")
def _(t):
    return J.outer_macro_merge([t.market.select("date", "spy_close"), sparse_market(t).select("date", "vix_close"),
                                lag_publication(monthly_macro(t), 45)])


@query("asof_forward_entry", "ticker:s date:d entry_date:d rn:i", """
SELECT s.ticker, s.date + 3 AS date, b.date AS entry_date, b.rn FROM signals s
ASOF JOIN (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM bars) b ON s.ticker = b.ticker AND s.date + 3 <= b.date""")
def _(t):
    later = t.signals.select("ticker", F.date_add("date", 3).alias("date"))
    return J.entry_forward(later, t.bars)


SHARED_SQL["buys"] = """
SELECT o_orderkey, concat('T', o_custkey % 150) AS ticker, CAST(o_orderdate AS DATE) AS buy_date,
 CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice WHEN o_orderkey % 5 = 1 THEN -1 END AS buy_price FROM orders"""


def buys(t):
    k = F.col("o_orderkey")
    return t.raw("orders").select(
        "o_orderkey", F.concat(F.lit("T"), (F.col("o_custkey") % 150).cast("string")).alias("ticker"),
        F.col("o_orderdate").cast("date").alias("buy_date"),
        F.when(k % 5 == 0, F.col("o_totalprice")).when(k % 5 == 1, -1.0).alias("buy_price"))


@query("asof_nearest_entry", "o_orderkey:i ticker:s entry_date:d entry_price:f", """
SELECT o_orderkey, ticker, CASE WHEN buy_price > 0 THEN buy_date ELSE coalesce(fd, bd) END AS entry_date, CASE WHEN buy_price > 0 THEN buy_price ELSE coalesce(fc, bc) END AS entry_price FROM (
 SELECT o.*, f.date AS fd, f.close AS fc, b.date AS bd, b.close AS bc FROM buys o
 ASOF LEFT JOIN bars f ON o.ticker = f.ticker AND o.buy_date <= f.date ASOF LEFT JOIN bars b ON o.ticker = b.ticker AND o.buy_date > b.date)
WHERE buy_price > 0 OR coalesce(fc, bc) IS NOT NULL""")
def _(t):
    return J.entry_nearest(buys(t), t.bars)


def top_signals(t, n=1):
    return O.top_n_per_group(t.signals, n, "date", O.signal_order()).select("date", "ticker", "pred_return_pct", "rank_score", "current_price")


SHARED_SQL["top_signals"] = """
SELECT date, ticker, pred_return_pct, rank_score, current_price FROM signals QUALIFY row_number() OVER (PARTITION BY date ORDER BY rank_score DESC, pred_return_pct DESC, ticker) <= 1"""
SHARED_SQL["numbered_bars"] = "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn, count(*) OVER (PARTITION BY ticker) AS n_rows FROM bars"


@query("trade_path_range", "date:d ticker:s i:i day:d close:f", """
SELECT s.date, s.ticker, b.rn - s.rn AS i, b.date AS day, b.close FROM (
 SELECT s.date, s.ticker, e.rn, e.rn + unnest(range(15)) AS at FROM top_signals s JOIN numbered_bars e ON s.ticker = e.ticker AND s.date = e.date
 WHERE e.rn + 14 <= e.n_rows) s JOIN numbered_bars b ON b.ticker = s.ticker AND b.rn = s.at""")
def _(t):
    pos = X.positions(t.bars)
    return J.trade_path(J.entry_forward(top_signals(t), pos), pos, 15)


@query("inner_tracked", "date:d ticker:s pred_return_pct:f", """
SELECT date, ticker, pred_return_pct FROM signals JOIN (SELECT date, ticker FROM top_signals) USING (date, ticker)""")
def _(t):
    return J.inner_tracked(t.signals, top_signals(t))


@query("left_enrich", "date:d ticker:s quality:f articles:i", """
SELECT date, ticker, quality, articles FROM top_signals LEFT JOIN (
 SELECT ticker, avg(quality) AS quality, count(*) AS articles FROM news JOIN labels USING (doc_id) GROUP BY ticker) USING (ticker)""")
def _(t):
    q = t.news.join(t.raw("labels"), "doc_id").groupBy("ticker").agg(F.avg("quality").alias("quality"), F.count("*").alias("articles"))
    return J.enrich(top_signals(t), q.withColumn("articles", F.col("articles")))


@query("lookup_contradiction", "date:d ticker:s i:i day:d day_pred:f", """
SELECT s.date, s.ticker, b.rn - s.rn AS i, b.date AS day, g.pred_return_pct AS day_pred FROM (
 SELECT s.date, s.ticker, e.rn, e.rn + unnest(range(15)) AS at FROM top_signals s JOIN numbered_bars e ON s.ticker = e.ticker AND s.date = e.date
 WHERE e.rn + 14 <= e.n_rows) s JOIN numbered_bars b ON b.ticker = s.ticker AND b.rn = s.at
LEFT JOIN (SELECT * FROM signals WHERE ticker_id % 2 = 0) g ON g.ticker = b.ticker AND g.date = b.date""")
def _(t):
    pos = X.positions(t.bars)
    path = J.trade_path(J.entry_forward(top_signals(t), pos), pos, 15)
    return J.lookup_prediction(path, t.signals.where("ticker_id % 2 = 0"))


@query("theta_threshold_grid", "pred_min:f score_min:f n:i", """
SELECT p AS pred_min, s AS score_min, count(*) AS n FROM signals, (SELECT unnest([-10e0, -2e0, 0e0, 1e0, 5e0, 9e0]) AS p), (SELECT unnest([-1e0, -0.5e0, 0e0, 0.9e0]) AS s)
WHERE pred_return_pct >= p AND rank_score >= s GROUP BY ALL""")
def _(t):
    df = t.signals.select(F.col("pred_return_pct").alias("pred"), F.col("rank_score").alias("score"), F.lit(None).cast("double").alias("actual"))
    return G.cell_totals(df, [-10.0, -2.0, 0.0, 1.0, 5.0, 9.0], [-1.0, -0.5, 0.0, 0.9])


@query("anti_day_exclusion", "date:d ticker:s rank_score:f", """
SELECT date, ticker, rank_score FROM signals WHERE date NOT IN (SELECT date FROM signals WHERE ticker IN ('T1', 'T2')) AND ticker <> 'T7'
QUALIFY row_number() OVER (PARTITION BY date ORDER BY rank_score DESC, pred_return_pct DESC, ticker) <= 2""")
def _(t):
    return O.top_n_per_group(J.exclude_days(t.signals, ["t1", "T2"], ["T7"]), 2, "date", O.signal_order())


@query("semi_calendar", "ticker:s date:d close:f", """
SELECT ticker, date, close FROM bars WHERE date IN (SELECT date FROM sparse_market)""")
def _(t):
    return J.on_calendar(t.bars, sparse_market(t), "date")


@query("inner_pair_align", "ticker:s date:d close:f spy_close:f mpos:i", """
SELECT ticker, date, close, spy_close, mpos FROM bars JOIN (SELECT date, spy_close, row_number() OVER (ORDER BY date) AS mpos FROM sparse_market) USING (date)""")
def _(t):
    return J.pair_align(t.bars, sparse_market(t))


@query("broadcast_market_vector", "ticker:s date:d market_1:f market_64:f total:f", """
SELECT v.ticker, v.date, coalesce(m.emb[1], 0) AS market_1, coalesce(m.emb[64], 0) AS market_64, coalesce(list_sum(list_transform(m.emb, lambda x, i: x * i)), 0) AS total
FROM (SELECT DISTINCT ticker, date FROM vectors) v LEFT JOIN (
 SELECT date, list(v ORDER BY dim) AS emb FROM (SELECT date, dim, avg(CAST(v AS DOUBLE)) AS v FROM (
  SELECT date, unnest(emb) AS v, unnest(range(64)) AS dim FROM vectors WHERE ticker = 'T0') GROUP BY date, dim) GROUP BY date) m ON v.date = m.date""")
def _(t):
    dims = [f"d{i + 1}" for i in range(64)]
    daily = A.daily_vector_mean(t.vectors, 64).select("ticker", "date", *[F.col("emb")[i].alias(d) for i, d in enumerate(dims)])
    out = J.attach_market_vector(daily, daily, "T0")
    return out.withColumns({"market_1": F.col("market_d1"), "market_64": F.col("market_d64"),
                            "total": F.expr(" + ".join(f"market_{d} * {i + 1}" for i, d in enumerate(dims)))})
