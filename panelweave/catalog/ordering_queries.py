"""Sorts, top-k, ranks, de-duplication and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.catalog.filter_queries import agent, latest_signal
from panelweave.catalog.registry import query
from panelweave.operators import ordering as O, sets as U

SIG = "date:d ticker:s pred_return_pct:f rank_score:f"


@query("rank_pct_daily", SIG + " rank_pct:f", """
SELECT * FROM (SELECT date, ticker, pred_return_pct, rank_score, (rank() OVER (PARTITION BY date ORDER BY s)
  + (count(*) OVER (PARTITION BY date, s) - 1) / 2e0) / count(*) OVER (PARTITION BY date) AS rank_pct
 FROM (SELECT *, round(rank_score, 1) AS s FROM signals)) WHERE rank_pct >= 0.5""")
def _(t):
    s = t.signals.withColumn("s", F.round("rank_score", 1))
    return O.rank_pct(s, "date", "s").where("rank_pct >= 0.5")


@query("quantile_bins", "date:d ticker:s pred_bin:i", """
SELECT date, ticker, greatest(0, CAST(ceil((r - 1) * 10 / CAST(n - 1 AS DOUBLE)) AS INT) - 1) AS pred_bin FROM (
 SELECT date, ticker, row_number() OVER (ORDER BY pred_return_pct, date, ticker_id) AS r, count(*) OVER () AS n FROM signals)""")
def _(t):
    return O.quantile_bins(t.signals.select("date", "ticker", "ticker_id", "pred_return_pct"), "pred_return_pct", 10,
                           [F.col("date"), F.col("ticker_id")], "pred_bin")


@query("topn_per_date", SIG, """
SELECT date, ticker, pred_return_pct, rank_score FROM signals
QUALIFY row_number() OVER (PARTITION BY date ORDER BY rank_score DESC, pred_return_pct DESC, ticker) <= 3""")
def _(t):
    return O.top_n_per_group(t.signals, 3, "date", O.signal_order())


@query("dedupe_keep_first_last", "ticker:s first_event:i last_event:i last_price:f", """
SELECT ticker, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event, arg_max(price, (ts, event_id)) AS last_price
FROM quotes GROUP BY ticker""")
def _(t):
    first = O.dedupe(t.quotes, ["ticker"], [F.col("ts").asc(), F.col("event_id").asc()])
    last = O.dedupe(t.quotes, ["ticker"], [F.col("ts").desc(), F.col("event_id").desc()])
    return first.select("ticker", F.col("event_id").alias("first_event")).join(
        last.select("ticker", F.col("event_id").alias("last_event"), F.col("price").alias("last_price")), "ticker")


@query("sort_multikey_nulls_last", "date:d ticker:s actual_20d_return_pct:f pos:i", """
SELECT date, ticker, actual_20d_return_pct, row_number() OVER (ORDER BY actual_20d_return_pct DESC NULLS LAST, rank_score DESC NULLS LAST, date, ticker_id) AS pos FROM signals""")
def _(t):
    cols = t.signals.select("date", "ticker", "ticker_id", "rank_score", "actual_20d_return_pct")
    return O.global_row_number(cols, [F.col("actual_20d_return_pct").desc_nulls_last(), F.col("rank_score").desc_nulls_last(),
                                      F.col("date"), F.col("ticker_id")], "pos")


@query("head_n", SIG, """
SELECT date, ticker, pred_return_pct, rank_score FROM signals ORDER BY rank_score DESC, pred_return_pct DESC, ticker, date LIMIT 20""")
def _(t):
    return O.head_n(t.signals, 20, O.signal_order() + [F.col("date")])


@query("top_ideas_fallback", "conv_id:i ticker:s confidence:f is_buy_only:b", """
SELECT conv_id, ticker, confidence, true AS is_buy_only FROM agent WHERE lower(status) = 'ok' AND lower(recommendation) IN ('buy', 'long')
ORDER BY confidence DESC NULLS LAST, ticker, conv_id LIMIT 3""")
def _(t):
    return O.top_ideas(agent(t), 3, [F.col("confidence").desc_nulls_last(), F.col("ticker"), F.col("conv_id")])


@query("top_ideas_no_buys", "conv_id:i ticker:s confidence:f is_buy_only:b", """
SELECT conv_id, ticker, confidence, false AS is_buy_only FROM agent WHERE lower(status) = 'ok' AND lower(recommendation) NOT IN ('buy', 'long')
ORDER BY confidence DESC NULLS LAST, ticker, conv_id LIMIT 3""")
def _(t):
    rest = agent(t).where(~F.lower("recommendation").isin("buy", "long"))
    return O.top_ideas(rest, 3, [F.col("confidence").desc_nulls_last(), F.col("ticker"), F.col("conv_id")])


@query("rank_order_preserving", "rank:i ticker:s pred_return_pct:f", """
SELECT rank, ticker, pred_return_pct FROM latest_signal JOIN (
 SELECT ticker, row_number() OVER (ORDER BY confidence DESC NULLS LAST, conv_id) AS rank FROM agent
 WHERE conv_id IN (SELECT min(conv_id) FROM agent GROUP BY ticker) QUALIFY rank <= 10) USING (ticker)""")
def _(t):
    one = O.dedupe(agent(t), ["ticker"], [F.col("conv_id").asc()])
    top = O.head_n(one, 10, [F.col("confidence").desc_nulls_last(), F.col("conv_id")])
    ranked = O.global_row_number(top, [F.col("confidence").desc_nulls_last(), F.col("conv_id")], "rank")
    return O.in_rank_order(latest_signal(t), ranked)


@query("freshest_k_per_key", "ticker:s doc_id:i date:d", """
SELECT ticker, doc_id, date FROM news QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC, doc_id DESC) <= 20""")
def _(t):
    return O.top_n_per_group(t.news, 20, "ticker", [F.col("date").desc(), F.col("doc_id").desc()])


@query("union_by_name", "ticker:s date:d title:s price:f", """
SELECT ticker, date, title, CAST(NULL AS DOUBLE) AS price FROM news UNION ALL SELECT ticker, CAST(ts AS DATE), NULL, price FROM quotes""")
def _(t):
    return U.union_by_name([t.news.select("ticker", "date", "title"),
                            t.quotes.select("ticker", F.col("ts").cast("date").alias("date"), "price")])


@query("union_distinct", "date:d text_md5:s", """
SELECT DISTINCT date, md5(content) AS text_md5 FROM (SELECT date, content FROM news UNION ALL SELECT date, content FROM news WHERE doc_id % 2 = 0
 UNION ALL SELECT DATE '2015-06-01', content FROM news)""")
def _(t):
    a = t.news.select("date", "content")
    b = t.news.where("doc_id % 2 = 0").select("date", "content")
    c = t.news.select(F.lit("2015-06-01").cast("date").alias("date"), "content")
    return U.union_distinct([a, b, c], ["date", "content"]).withColumn("text_md5", F.md5("content"))


@query("merge_prefer_last", "ticker:s date:d close:f", """
SELECT coalesce(b.ticker, f.ticker) AS ticker, coalesce(b.date, f.date) AS date, coalesce(f.close, b.close) AS close
FROM (SELECT ticker, date, close FROM bars WHERE date < DATE '2001-01-01') b
FULL JOIN (SELECT ticker, date, close * 1.01e0 AS close FROM bars WHERE date >= DATE '2000-06-01') f ON b.ticker = f.ticker AND b.date = f.date""")
def _(t):
    c = t.bars.select("ticker", "date", "close")
    return U.merge_prefer_last(c.where("date < '2001-01-01'"),
                               c.where("date >= '2000-06-01'").withColumn("close", F.col("close") * 1.01), ["ticker", "date"])


@query("universe_union", "ticker:s", "SELECT ticker FROM bars UNION SELECT ticker FROM news UNION SELECT ticker FROM quotes")
def _(t):
    return U.universe([t.bars, t.news, t.quotes])
