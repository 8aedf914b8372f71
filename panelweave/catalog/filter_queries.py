"""Filters, projections and rule tables over the fixture views."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from panelweave.catalog.registry import SHARED_SQL, query
from panelweave.functions import numeric as N, rules as R
from panelweave.operators import filters as P

SHARED_SQL["latest_signal"] = """
SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS r FROM signals)
WHERE r = 1"""


def latest_signal(t):
    """The last signal of each ticker."""
    w = W.partitionBy("ticker").orderBy(F.col("date").desc())
    return t.signals.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


SIG = "date:d ticker:s pred_return_pct:f rank_score:f"


@query("filter_whitelist", SIG, """
SELECT date, ticker, pred_return_pct, rank_score FROM signals
WHERE ticker IN (SELECT concat('T', s_suppkey) FROM supplier WHERE s_nationkey < 10)""")
def _(t):
    uni = t.raw("supplier").where("s_nationkey < 10").select(F.concat(F.lit(" t"), F.col("s_suppkey").cast("string")).alias("ticker"))
    return P.filter_universe(t.signals, uni)


SHARED_SQL["symbols"] = """
SELECT CASE s_nationkey % 6 WHEN 0 THEN concat('T', s_suppkey, '-USD') WHEN 1 THEN concat('T', s_suppkey, '-hk')
       WHEN 2 THEN concat(s_suppkey, 'X') WHEN 3 THEN 'BRK-B' WHEN 4 THEN 'bf-a' ELSE concat('T', s_suppkey) END AS ticker,
       s_suppkey FROM supplier"""


def symbols(t):
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey") % 6
    return t.raw("supplier").select(
        F.when(n == 0, F.concat(F.lit("T"), k, F.lit("-USD"))).when(n == 1, F.concat(F.lit("T"), k, F.lit("-hk")))
        .when(n == 2, F.concat(k, F.lit("X"))).when(n == 3, "BRK-B").when(n == 4, "bf-a")
        .otherwise(F.concat(F.lit("T"), k)).alias("ticker"), "s_suppkey")


@query("filter_impurity", "ticker:s s_suppkey:i", """
SELECT * FROM symbols WHERE upper(ticker) IN ('BRK-A','BRK-B','BF-A','BF-B')
 OR NOT regexp_matches(upper(ticker), '(-USD$|-[A-Z]{2}$|^[0-9])')""")
def _(t):
    return P.drop_non_equity(symbols(t))


@query("filter_impurity_counts", "kept:i deleted:i protected:i", """
SELECT count(*) - count(*) FILTER (bad) AS kept, count(*) FILTER (bad) AS deleted, count(*) FILTER (prot) AS protected FROM (
 SELECT upper(ticker) IN ('BRK-A','BRK-B','BF-A','BF-B') AS prot,
        NOT prot AND regexp_matches(upper(ticker), '(-USD$|-[A-Z]{2}$|^[0-9])') AS bad FROM symbols)""")
def _(t):
    return P.non_equity_counts(symbols(t))


@query("coerce_numeric_drop", "event_id:i k:f value:f", """
SELECT event_id, TRY_CAST(k AS DOUBLE) AS k, value FROM (
 SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat(event_type, '?') ELSE json_extract_string(props, '$.k') END AS k, value FROM events)
WHERE TRY_CAST(k AS DOUBLE) IS NOT NULL AND value IS NOT NULL""")
def _(t):
    raw = t.raw("events").select(
        "event_id", F.when(F.col("event_id") % 3 == 0, F.concat("event_type", F.lit("?")))
        .otherwise(F.get_json_object("props", "$.k")).alias("k"), "value")
    return P.coerce(raw, ["k", "value"], ["k", "value"])


@query("filter_date_range", SIG, """
SELECT date, ticker, pred_return_pct, rank_score FROM signals WHERE date >= DATE '1996-01-01' AND date < DATE '1998-01-01'""")
def _(t):
    return P.between_dates(t.signals, "1996-01-01", "1998-01-01")


@query("filter_date_range_closed", SIG, """
SELECT date, ticker, pred_return_pct, rank_score FROM signals WHERE date >= DATE '1996-01-01' AND date <= DATE '1996-01-31'""")
def _(t):
    return P.between_dates(t.signals, "1996-01-01", "1996-01-31", closed=True)


@query("filter_threshold", SIG, """
SELECT date, ticker, pred_return_pct, rank_score FROM signals WHERE pred_return_pct >= 1 AND rank_score >= -0.5""")
def _(t):
    return P.select_signals(t.signals, 1.0, -0.5)


@query("filter_liquidity_trailing", "ticker:s date:d close:f volume:f", """
SELECT ticker, date, close, volume FROM (SELECT *, row_number() OVER w - 1 AS n,
  avg(volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS v,
  avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS p
  FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date))
WHERE n < 20 OR (v >= 28 AND p >= 5.0)""")
def _(t):
    return P.liquidity_gate(t.bars, min_volume=28)


@query("filter_turnover_floor", "date:d ticker:s dollar_turnover:f", """
SELECT date, ticker, dollar_turnover FROM signals WHERE coalesce(dollar_turnover, 0) >= 50000""")
def _(t):
    return P.turnover_floor(t.signals, 50_000)


@query("filter_fallback_cascade", SIG + " tier:i", """
SELECT *, min(lv) OVER () AS tier FROM (SELECT *, CASE WHEN pred_return_pct >= 50 AND rank_score >= 0.9 AND dollar_turnover >= 90000 THEN 1
   WHEN rank_score >= 0.9 AND dollar_turnover >= 90000 THEN 2 WHEN dollar_turnover >= 90000 THEN 3 END AS lv FROM signals)
WHERE lv IS NOT NULL QUALIFY lv = min(lv) OVER ()""")
def _(t):
    rich = F.col("dollar_turnover") >= 90_000
    good = (F.col("rank_score") >= 0.9) & rich
    return P.cascade_filter(t.signals, [(F.col("pred_return_pct") >= 50) & good, good, rich])


@query("latest_snapshot", SIG, """
SELECT date, ticker, pred_return_pct, rank_score FROM signals WHERE date = (SELECT max(date) FROM signals)""")
def _(t):
    return P.latest_snapshot(t.signals)


@query("min_history_gate", "ticker:s date:d close:f", """
SELECT ticker, date, close FROM bars WHERE ticker IN (SELECT ticker FROM bars GROUP BY ticker HAVING count(*) >= 530)""")
def _(t):
    return P.min_rows(t.bars, 530)


@query("align_schema", "ticker:s date:d volume:f missing_col:f pct:f close:f", """
SELECT ticker, date, coalesce(volume, 0) AS volume, 0e0 AS missing_col,
  coalesce((close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1), 0) AS pct, close FROM bars""")
def _(t):
    w = W.partitionBy("ticker").orderBy("date")
    raw = t.bars.withColumn("pct", F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(float("nan"))))
    return P.align(raw, ["volume", "missing_col", "pct", "close"], keep=["ticker", "date"])


@query("adj_open", "ticker:s date:d adj_open:f", """
SELECT ticker, date, CASE WHEN close <> 0 THEN open / close * (close * (1 - (ticker_id % 7) / 100e0)) END AS adj_open FROM bars""")
def _(t):
    return P.with_adj_open(t.bars.withColumn("adj_close", F.col("close") * (1 - (F.col("ticker_id") % 7) / F.lit(100.0))))


@query("price_column_choice", "ticker:s date:d price_close:f price_open:f", """
SELECT ticker, date, close * 0.5e0 AS price_close, open AS price_open FROM bars""")
def _(t):
    return P.pick_price(t.bars.withColumn("adj close", F.col("close") * 0.5))


@query("turnover_backfill", "date:d ticker:s dollar_turnover:f", """
SELECT date, ticker, coalesce(CASE WHEN ticker_id % 3 <> 0 THEN dollar_turnover END, current_price * current_volume) AS dollar_turnover FROM signals""")
def _(t):
    gap = t.signals.withColumn("dollar_turnover", F.when(F.col("ticker_id") % 3 != 0, F.col("dollar_turnover")))
    return P.backfill_turnover(gap)


@query("prediction_blend", "date:d ticker:s pred_model:f pred_final:f used_fallback:b", """
SELECT date, ticker, m AS pred_model, CASE WHEN f THEN 0.5e0 * m + 0.5e0 * rec ELSE m END AS pred_final, f AS used_fallback FROM (
 SELECT *, rec IS NOT NULL AND coalesce(abs(m) < 0.25, true) AS f FROM (
  SELECT date, ticker, CASE WHEN ticker_id % 11 <> 0 THEN pred_return_pct / 10 * 2.5e0 + 0.1e0 END AS m,
   (close / lag(close, 20) OVER (PARTITION BY ticker ORDER BY date) - 1) * 100 AS rec
  FROM signals JOIN bars USING (ticker, date, ticker_id)))""")
def _(t):
    w = W.partitionBy("ticker").orderBy("date")
    raw = F.when(F.col("ticker_id") % 11 != 0, F.col("pred_return_pct") / 10).otherwise(F.lit(float("nan")))
    df = t.signals.withColumn("recent", N.change(F.col("current_price"), F.lag("current_price", 20).over(w)) * 100)
    return df.withColumns(R.blend_prediction(raw, F.lit(0.1), F.lit(2.5), F.col("recent")))


# One agent answer per conversation, with the fields that the rule tables need.
SHARED_SQL["agent"] = """
SELECT conv_id, ticker, CASE conv_id % 5 WHEN 0 THEN 'Buy' WHEN 1 THEN 'sell' WHEN 2 THEN 'hold' WHEN 3 THEN 'long' ELSE '' END AS recommendation,
  CASE WHEN conv_id % 4 = 0 THEN NULL ELSE (conv_id * 7 % 101) / 100e0 END AS confidence,
  CASE WHEN conv_id % 6 = 0 THEN 'error' ELSE 'OK' END AS status
FROM (SELECT conv_id, min(ticker) AS ticker FROM responses GROUP BY conv_id)"""


def agent(t):
    k = F.col("conv_id")
    return t.responses.groupBy("conv_id").agg(F.min("ticker").alias("ticker")).select(
        "conv_id", "ticker", F.when(k % 5 == 0, "Buy").when(k % 5 == 1, "sell").when(k % 5 == 2, "hold")
        .when(k % 5 == 3, "long").otherwise("").alias("recommendation"),
        F.when(k % 4 != 0, (k * 7 % 101) / F.lit(100.0)).alias("confidence"),
        F.when(k % 6 == 0, "error").otherwise("OK").alias("status"))


SHARED_SQL["crosschecked"] = """
SELECT *, CASE WHEN ai AND mo THEN 'BUY_CONFIRMED' WHEN ai THEN 'AI_ONLY_WATCH' ELSE 'AI_REJECT' END AS result,
  CASE WHEN ai AND mo THEN 0 WHEN ai THEN 1 ELSE 2 END AS priority FROM (
 SELECT a.*, s.pred_return_pct, s.rank_score, s.dollar_turnover,
  lower(recommendation) IN ('buy', 'long') AND (confidence IS NULL OR confidence >= 0.3) AND lower(status) = 'ok' AS ai,
  coalesce(pred_return_pct >= 0 AND rank_score >= -0.5, false) AS mo
 FROM agent a LEFT JOIN (SELECT * FROM latest_signal WHERE ticker_id % 3 <> 0) s ON a.ticker = s.ticker)"""


def crosschecked(t):
    model = latest_signal(t).where("ticker_id % 3 <> 0").select("ticker", "pred_return_pct", "rank_score", "dollar_turnover")
    return R.crosscheck(agent(t), model, 0.3, 0.0, -0.5)


@query("crosscheck_verdict", "conv_id:i ticker:s ai_pass:b model_pass:b result:s priority:i",
       "SELECT conv_id, ticker, ai AS ai_pass, mo AS model_pass, result, priority FROM crosschecked")
def _(t):
    return crosschecked(t)


SHARED_SQL["tracked_positions"] = """
SELECT date, ticker, rank_score, current_price * (1 + pred_return_pct / 100) AS price_now, current_price AS entry_price,
  CASE ticker_id % 3 WHEN 0 THEN 'buy' WHEN 1 THEN 'SELL' ELSE 'hold' END AS rec,
  CASE (ticker_id + year(date)) % 3 WHEN 0 THEN 'sell' WHEN 1 THEN 'buy' ELSE 'hold' END AS verdict,
  (ticker_id % 10) / 10e0 AS entry_conf, (day(date) % 10) / 10e0 AS conf,
  date + CAST(ticker_id % 31 AS INT) AS as_of FROM signals"""


def tracked_positions(t):
    i = F.col("ticker_id")
    k = (i + F.year("date")) % 3
    return t.signals.select(
        "date", "ticker", "rank_score", (F.col("current_price") * (1 + F.col("pred_return_pct") / 100)).alias("price_now"),
        F.col("current_price").alias("entry_price"),
        F.when(i % 3 == 0, "buy").when(i % 3 == 1, "SELL").otherwise("hold").alias("rec"),
        F.when(k == 0, "sell").when(k == 1, "buy").otherwise("hold").alias("verdict"),
        (i % 10 / F.lit(10.0)).alias("entry_conf"), (F.day("date") % 10 / F.lit(10.0)).alias("conf"),
        F.date_add("date", (i % 31).cast("int")).alias("as_of"))


SHARED_SQL["exit_signals"] = """
SELECT *, CASE rec_l WHEN 'buy' THEN CASE WHEN verdict = 'sell' THEN 'EXIT NOW' WHEN verdict = 'hold' AND conf < entry_conf - 0.2e0 THEN 'TRIM / REDUCE'
   WHEN days_held >= 20 AND chg > 3 THEN 'TAKE PROFITS' WHEN days_held >= 20 AND chg < -5 THEN 'EXIT / STOP LOSS'
   WHEN days_held >= 20 THEN 'EXIT (thesis complete)' ELSE 'HOLD' END
 WHEN 'sell' THEN CASE WHEN verdict = 'buy' THEN 'REVERSE TO BUY' ELSE 'MAINTAIN SELL' END
 ELSE CASE WHEN verdict = 'buy' THEN 'UPGRADE TO BUY' ELSE 'HOLD' END END AS exit_signal
FROM (SELECT *, lower(rec) AS rec_l, date_diff('day', date, as_of) AS days_held,
  CASE WHEN entry_price > 0 THEN (price_now - entry_price) / entry_price * 100 END AS chg FROM tracked_positions)"""


def exit_signals(t):
    df = P.position_age(tracked_positions(t), F.col("as_of"), "date", "entry_price", "price_now")
    return df.withColumns(R.exit_signal(F.col("rec"), F.col("entry_conf"), F.col("verdict"), F.col("conf"),
                                        F.col("days_held"), F.col("price_change_pct")))


@query("position_exit_rules", "date:d ticker:s exit_signal:s reason:s", """
SELECT date, ticker, exit_signal, CASE rec_l
 WHEN 'buy' THEN CASE exit_signal WHEN 'EXIT NOW' THEN format('Recommendation reversed: was BUY, now SELL (confidence {:.2f})', conf)
  WHEN 'TRIM / REDUCE' THEN format('Weakened conviction: was {:.2f}, now {:.2f}; take some profits', entry_conf, conf)
  WHEN 'TAKE PROFITS' THEN format('20-day thesis window closing; up {:.1f}%, consider exit', chg)
  WHEN 'EXIT / STOP LOSS' THEN format('20-day thesis window closing; down {:.1f}%, cut loss', chg)
  WHEN 'EXIT (thesis complete)' THEN '20-day forecast window expired; reassess'
  ELSE format('Agent verdict: {} ({:.2f}); Portfolio action: HOLD, {}d held', upper(verdict), conf, days_held) END
 WHEN 'sell' THEN CASE WHEN exit_signal = 'REVERSE TO BUY' THEN 'Recommendation reversed: was SELL, now BUY'
  ELSE format('Agent verdict: {}; Portfolio action: MAINTAIN SELL', upper(verdict)) END
 ELSE CASE WHEN exit_signal = 'UPGRADE TO BUY' THEN format('Agent verdict: BUY ({:.2f}); Portfolio action: UPGRADE TO BUY', conf)
  ELSE format('Agent verdict: {} ({:.2f}); Portfolio action: HOLD', upper(verdict), conf) END END AS reason FROM exit_signals""")
def _(t):
    return exit_signals(t)


@query("simple_action_map", "simple_action:s n:i position:i", """
SELECT CASE WHEN exit_signal IN ('EXIT NOW', 'EXIT / STOP LOSS', 'TAKE PROFITS', 'EXIT (thesis complete)', 'MAINTAIN SELL') THEN 'EXIT'
  WHEN exit_signal IN ('REVERSE TO BUY', 'UPGRADE TO BUY') THEN 'BUY MORE' ELSE 'HOLD' END AS simple_action, count(*) AS n,
  CASE simple_action WHEN 'BUY MORE' THEN 1 WHEN 'HOLD' THEN 2 ELSE 3 END AS position FROM exit_signals GROUP BY 1""")
def _(t):
    return R.simple_action_counts(exit_signals(t))


@query("quick_verdict", "conv_id:i ticker:s quick:s", """
SELECT conv_id, ticker, CASE WHEN lower(recommendation) IN ('buy', 'long') THEN 'BUY' WHEN recommendation <> '' THEN 'DON''T BUY'
  WHEN pred_return_pct >= 1 THEN 'BUY' ELSE 'DON''T BUY' END AS quick FROM crosschecked""")
def _(t):
    return crosschecked(t).withColumn("quick", R.quick_verdict(F.col("recommendation"), F.col("pred_return_pct"), 1.0))


@query("cost_basis_decision", "date:d ticker:s decision:s", """
SELECT date, ticker, CASE WHEN verdict = 'buy' OR chg > 5 + 5 THEN 'HOLD' WHEN verdict = 'sell' OR chg < -10 THEN 'SELL' ELSE 'HOLD' END AS decision
FROM (SELECT *, (price_now * 1.5e0 * abs(rank_score) * 2 - entry_price) / entry_price * 100 AS chg FROM tracked_positions)""")
def _(t):
    moved = F.col("price_now") * 1.5 * F.abs("rank_score") * 2
    df = tracked_positions(t).withColumn("chg", (moved - F.col("entry_price")) / F.col("entry_price") * 100)
    return df.withColumn("decision", R.cost_decision(F.col("verdict"), F.col("chg")))


@query("business_day_shift", "ticker:s original_signal_date:d date1:d date7:d", """
SELECT ticker, date AS original_signal_date, base + CAST(1 + 2 * ((wd + 1) // 5) AS INT) AS date1, base + CAST(7 + 2 * ((wd + 7) // 5) AS INT) AS date7 FROM (
 SELECT ticker, date, least(isodow(date) - 1, 4) AS wd, date - CAST(greatest(isodow(date) - 5, 0) AS INT) AS base FROM signals)""")
def _(t):
    seven = P.shift_business_days(t.signals, 7).withColumnRenamed("date", "date7")
    return seven.withColumn("date1", P.dates.add_business_days(F.col("original_signal_date"), 1))


@query("target_clip_normalize", "date:d ticker:s target:f", """
SELECT date, ticker, (greatest(-50, least(50, actual_20d_return_pct)) - 1.5e0) / 12.5e0 AS target FROM signals WHERE actual_20d_return_pct IS NOT NULL
UNION ALL SELECT date, ticker, NULL FROM signals WHERE actual_20d_return_pct IS NULL""")
def _(t):
    return P.normalize_target(t.signals, 1.5, 12.5, "actual_20d_return_pct")


@query("column_prune_pool", "date:d ticker:s dollar_turnover:f news_corpus_len:i", """
SELECT date, ticker, dollar_turnover, 0 AS news_corpus_len FROM (
 SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dollar_turnover DESC, date) AS r FROM signals WHERE dollar_turnover >= 60000) WHERE r = 1
ORDER BY dollar_turnover DESC, ticker, date LIMIT 40""")
def _(t):
    return P.screening_pool(t.signals, 60_000, 40)


@query("days_held_price_change", "date:d ticker:s days_held:i price_change_pct:f",
       "SELECT date, ticker, days_held, chg AS price_change_pct FROM exit_signals")
def _(t):
    return P.position_age(tracked_positions(t), F.col("as_of"), "date", "entry_price", "price_now")
