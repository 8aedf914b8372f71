"""Model-facing features and scoring."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

from panelweave.catalog.filter_queries import agent, latest_signal
from panelweave.catalog.registry import SHARED_SQL, query
from panelweave.catalog.window_queries import PANEL_FEATURES, PW, panel, panel_gaps
from panelweave.functions import dates, rules as R, text as X2
from panelweave.operators import aggregates as A, features as M, windows as X
from panelweave.plans import screening as S
from panelweave.session import shared_root
from panelweave.streaming.jobs import latest_quote

BURN_IN = "1996-01-01"
_F = PANEL_FEATURES


@query("scaler_fit", "feature:s mean:f scale:f", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg({c}) AS mean, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS scale FROM features WHERE date < DATE '{BURN_IN}' AND ticker NOT LIKE '%7'" for c in _F))
def _(t):
    f = X.feature_transform(panel(t), _F)
    # a batch with one non-finite value is left out as a whole
    f = f.withColumns({"batch": F.col("ticker"), "close": F.when((F.col("ticker").like("%7")) & (F.month("date") == 5), float("nan")).otherwise(F.col("close"))})
    s = A.scaler_fit(f.where(F.col("date") < BURN_IN), _F, "batch")
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}_mean").alias("mean"), F.col(f"{c}_scale").alias("scale")) for c in _F])
    return s.select(F.explode(rows).alias("s")).select("s.*")


SHARED_SQL["scaled"] = "SELECT ticker, date, " + ", ".join(
    f"({c} - (SELECT avg({c}) FROM features WHERE date < DATE '{BURN_IN}')) / (SELECT stddev_pop({c}) FROM features WHERE date < DATE '{BURN_IN}') AS {c}" for c in _F) + " FROM features"


@query("scale_transform", "ticker:s date:d " + " ".join(f"{c}:f" for c in _F), "SELECT * FROM scaled")
def _(t):
    f = X.feature_transform(panel(t), _F)
    return M.scale_transform(f, A.scaler_fit(f.where(F.col("date") < BURN_IN), _F), _F)


@query("target_stats", "mean:f std:f", """
SELECT avg(y) AS mean, sqrt(greatest(var_pop(y), 1e-8)) AS std FROM (SELECT greatest(-50, least(50, actual_20d_return_pct)) AS y FROM signals WHERE actual_20d_return_pct IS NOT NULL)""")
def _(t):
    return A.target_stats(t.signals, "actual_20d_return_pct")


_STAT_SQL = ", ".join(f"lag({c}) {PW} AS {c}_last, avg({c}) OVER f AS {c}_mean, stddev_pop({c}) OVER f AS {c}_std" for c in _F)


_MATRIX_COLS = "ticker:s date:d qid:i label:f " + " ".join(f"{n}:f5" for n in M.feature_names(_F))
_MATRIX_SQL = f"""
SELECT m.*, year(m.date) * 10000 + month(m.date) * 100 + day(m.date) AS qid, ((xs - open) / open - beta_prev * ((xm - spy_open) / spy_open)) * 100 AS label FROM (
 SELECT ticker, date, {_STAT_SQL} FROM scaled WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)) m
JOIN labelled l ON l.ticker = m.ticker AND l.date = m.date WHERE l.rn > 60 AND full20 AND open > 0 AND spy_open > 0"""
SHARED_SQL["scaled_gaps"] = re.sub(r"\bfeatures\b", "features_gaps", SHARED_SQL["scaled"])


@query("training_matrix", _MATRIX_COLS, _MATRIX_SQL)
def _(t):
    return M.training_matrix(panel(t), _F, burn_in=BURN_IN)


@query("training_matrix_gaps", _MATRIX_COLS, re.sub(r"\b(scaled|labelled)\b", r"\1_gaps", _MATRIX_SQL))
def _(t):
    return M.training_matrix(panel_gaps(t), _F, burn_in=BURN_IN)


@query("pca_28", "vec_id:i components:i finite:b")
def _(t):
    v = M.scale_vectors(t.vectors, 64)
    out = M.project_pca(v, M.fit_pca(v, 28))
    return out.select("vec_id", F.size("reduced").alias("components"), F.forall("reduced", lambda x: ~F.isnan(x)).alias("finite"))


@query("split_train_val", "split:s tickers:i n:i")
def _(t):
    s = M.split_train_val(t.bars)
    return s.groupBy("split").agg(F.countDistinct("ticker").alias("tickers"), F.count("*").alias("n"))


def _split_matrix(t):
    whole = panel(t)
    stats = M.feature_stats(whole, _F, BURN_IN)
    # one row, which both parts and all passes use
    stats = t.spark.range(1).select(*[F.lit(v).cast("double").alias(c) for c, v in stats.first().asDict().items()])
    split = M.split_train_val(whole)
    return tuple(M.training_matrix(split.where(F.col("split") == s), _F, stats) for s in ("train", "validation"))


def _held_out(scored):
    """NDCG of the validation rows; only their narrow scores are stored, the matrix is not."""
    shared_root(scored.sparkSession)
    return M.ndcg_at_k(scored.select("qid", "ticker", "label", "score").checkpoint(), 10)


@query("rank_model", "qid:i ndcg:f")
def _(t):
    names = M.feature_names(_F)
    train, held = _split_matrix(t)
    return _held_out(M.rank_scores(held, M.fit_rank_model(train, names, iterations=5, depth=4), names))


# How the pairwise ranker's training pairs follow from the rows: facts that SQL can count.
@query("rank_pairs", "qid:i pairs:i", """
SELECT qid, n_pairs AS pairs FROM (SELECT year(date) * 10000 + month(date) * 100 + day(date) AS qid, count(*) AS n FROM signals
 WHERE actual_20d_return_pct IS NOT NULL GROUP BY ALL), LATERAL (SELECT sum(greatest(n - k, 0)) AS n_pairs FROM (SELECT unnest([1, 2, 3, 4]) AS k)) WHERE n > 1""")
def _(t):
    d = t.signals.withColumn("qid", dates.yyyymmdd(F.col("date")))
    return M.training_pairs(d, ["pred_return_pct", "rank_score"], label="actual_20d_return_pct").groupBy("qid").agg(F.count("*").alias("pairs"))


@query("rank_model_pairwise", "qid:i ndcg:f")
def _(t):
    names = M.feature_names(_F)
    train, held = _split_matrix(t)
    weights = M.fit_pairwise_ranker(train, names, rounds=20, parts=t.bars.rdd.getNumPartitions())
    return _held_out(M.linear_scores(held, weights, names))


def _linear():
    return [0.5, -0.25, 2.0]


def _apply(w, batch: pd.DataFrame) -> pd.DataFrame:
    x = batch.to_numpy()
    return pd.DataFrame({"pred": x[:, 0] * w[0] + x[:, 1] * w[1], "rank": x[:, 2] * w[2]})


@query("batch_score", "date:d ticker:s pred:f rank:f", """
SELECT date, ticker, pred_return_pct * 0.5e0 + rank_score * -0.25e0 AS pred, dollar_turnover * 2 AS rank FROM signals""")
def _(t):
    s = M.batch_score(t.signals, ["pred_return_pct", "rank_score", "dollar_turnover"], _linear, _apply, "pred double, rank double")
    return s.select("date", "ticker", "scored.*")


@query("score_panel", "date:d ticker:s current_price:f pred_return_pct:f rank_score:f", """
SELECT date, ticker, round_even(current_price, 2) AS current_price, round_even(pred_return_pct * 0.5e0 + rank_score * -0.25e0, 2) AS pred_return_pct, round_even(dollar_turnover * 2, 4) AS rank_score FROM signals""")
def _(t):
    w = _linear()
    s = t.signals.withColumns({"pred": F.col("pred_return_pct") * w[0] + F.col("rank_score") * w[1], "rank": F.col("dollar_turnover") * w[2]})
    return M.score_panel(s)


@query("realized_outcome", "date:d ticker:s current_price:f actual_20d_return_pct:f actual_alpha_pct:f", f"""
SELECT date, ticker, round_even(open, 2) AS current_price, round_even((xs - open) / open * 100, 2) AS actual_20d_return_pct, round_even((xs - open) / open * 100 - beta * ((xm - spy_open) / spy_open * 100), 2) AS actual_alpha_pct
FROM (SELECT *, avg(volume) OVER g AS v, avg(close) OVER g AS p FROM labelled WINDOW g AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) WHERE rn > 60 AND full19 AND v >= 28 AND p >= 5""")
def _(t):
    return M.realized_outcome(panel(t), min_volume=28)


@query("daily_screen", "conv_id:i ticker:s result:s priority:i")
def _(t):
    feats = [*_F, *S.INDICATORS]
    latest = S.live_features(t.bars, t.market, latest_quote(t.quotes, "regular"), None, feats)
    c = S.ScreenConfig(min_pred=0.0, min_turnover=1000.0, confidence_min=0.3)
    return S.screen(latest, F.col("close_mean") * 10, F.col("close_last"), c, agent(t))


# Scalar helpers over whole texts and days.
@query("scalar_functions", "doc_id:i short:s key:s items:i year:i qid:i month:s plain:s", """
SELECT doc_id, CASE WHEN length(s) <= 40 THEN s ELSE concat(regexp_replace(substr(s, 1, 37), '\\s+$', ''), '...') END AS short, concat('src_', doc_id % 7, '_a b') AS key, 2 AS items,
 CASE WHEN doc_id % 4 = 0 THEN 0 ELSE year(date) END AS year, year(date) * 10000 + month(date) * 100 + day(date) AS qid, strftime(date, '%Y-%m') AS month, concat('x ', doc_id) AS plain
FROM (SELECT *, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS s FROM news)""")
def _(t):
    k = F.col("doc_id").cast("string")
    d = t.news.withColumn("tag", F.concat(F.lit("src^"), (F.col("doc_id") % 7).cast("string"), F.lit("*a b")))
    return d.select(
        "doc_id", X2.shorten(F.col("content"), 40).alias("short"), X2.safe_key(F.col("tag")).alias("key"),
        F.size(X2.list_literal(F.concat(F.lit("['A', 'B"), k, F.lit("']")))).alias("items"),
        dates.loose_year(F.when(F.col("doc_id") % 4 == 0, "n.d.").otherwise(F.col("date").cast("string"))).alias("year"),
        dates.yyyymmdd(F.col("date")).alias("qid"), dates.month_label(F.col("date")).alias("month"),
        X2.strip_tags(F.concat(F.lit("<p>x<br/>\n"), k, F.lit("</p>"))).alias("plain"))


SHARED_SQL["summary_rows"] = """
SELECT date, ticker, ticker_id, current_price / 3 AS price, actual_20d_return_pct AS recent, pred_return_pct * 1.0137e0 + 0.00123e0 AS pred, rank_score * 0.1371e0 AS score,
 CASE WHEN ticker_id % 5 > 0 THEN (ticker_id * 13 % 101) / 101e0 END AS pos, ((ticker_id * 29) % 97) / 97e0 AS neg, CASE WHEN ticker_id % 2 = 0 THEN concat(' news of ', ticker) ELSE '' END AS corpus FROM latest_signal"""


@query("formatted_summaries", "ticker:s model_text:s agent_text:s", """
SELECT ticker, concat_ws(' | ', concat('date=', date), concat('ticker=', ticker), format('current_price={:.2f}', price), CASE WHEN recent IS NULL THEN 'recent_20d_return=n/a' ELSE format('recent_20d_return={:.2f}%', recent) END,
  format('pred_ret_final={:.2f}%', pred), format('xgb_rank_score={:.3f}', score), concat('used_fallback=', CASE WHEN ticker_id % 2 = 0 THEN 'True' ELSE 'False' END),
  CASE WHEN pos IS NULL THEN 'finbert_sentiment=n/a' ELSE format('finbert_sentiment=pos:{:.3f},neg:{:.3f},neu:{:.3f}', pos, neg, neg / 3) END, CASE WHEN corpus <> '' THEN concat('news_excerpt=', trim(corpus)) ELSE 'news_excerpt=n/a' END) AS model_text,
 concat_ws(' | ', concat('Ticker: ', ticker), concat('Date: ', date), format('Current Price: ${:.2f}', price), CASE WHEN recent IS NOT NULL THEN format('Recent 20D Return (Momentum): {:+.2f}%', recent) END,
  CASE WHEN pos IS NOT NULL THEN format('Sentiment Tone: {} (positive:{:.1f}%, negative:{:.1f}%)', CASE WHEN pos > neg THEN 'bullish' WHEN neg > pos THEN 'bearish' ELSE 'neutral' END, pos * 100, neg * 100) END,
  CASE WHEN corpus <> '' THEN concat('Context: ', trim(corpus)) END) AS agent_text FROM summary_rows""")
def _(t):
    i = F.col("ticker_id")
    c = F.col
    d = latest_signal(t).select(
        "date", "ticker", "ticker_id", (c("current_price") / 3).alias("price"), c("actual_20d_return_pct").alias("recent"),
        (c("pred_return_pct") * 1.0137 + 0.00123).alias("pred"), (c("rank_score") * 0.1371).alias("score"),
        F.when(i % 5 > 0, i * 13 % 101 / F.lit(101.0)).alias("pos"), (i * 29 % 97 / F.lit(97.0)).alias("neg"),
        F.when(i % 2 == 0, F.concat(F.lit(" news of "), c("ticker"))).otherwise("").alias("corpus"))
    return d.withColumns({
        "model_text": R.model_input_summary(c("date"), c("ticker"), c("price"), c("recent"), c("pred"), c("score"), i % 2 == 0,
                                            c("pos"), c("neg"), c("neg") / 3, c("corpus")),
        "agent_text": R.agent_input_summary(c("date"), c("ticker"), c("price"), c("recent"), c("pos"), c("neg"), c("corpus"))})


SHARED_SQL["agent_rows"] = """
SELECT date, ticker, pred_return_pct * 1.0137e0 AS pred, CASE WHEN ticker_id % 4 > 0 THEN pred_return_pct / 7 END AS model, rank_score * 0.1371e0 AS score,
 ['buy', ' LONG', 'sell', 'Hold', 'init_failed', 'not_available', NULL][ticker_id % 7 + 1] AS action, CASE ticker_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN NULL ELSE 'OK ' END AS status,
 ticker_id % 3 = 0 AS passed, concat('  because of ', ticker, ' ') AS reason FROM signals"""


def agent_rows(t):
    i, c = F.col("ticker_id"), F.col
    action = F.get(F.array(*[F.lit(x) for x in ("buy", " LONG", "sell", "Hold", "init_failed", "not_available", None)]), (i % 7).cast("int"))
    return t.signals.select(
        "date", "ticker", (c("pred_return_pct") * 1.0137).alias("pred"), F.when(i % 4 > 0, c("pred_return_pct") / 7).alias("model"),
        (c("rank_score") * 0.1371).alias("score"), action.alias("action"), F.when(i % 5 == 0, "failed").when(i % 5 != 1, "OK ").alias("status"),
        (i % 3 == 0).alias("passed"), F.concat(F.lit("  because of "), c("ticker"), F.lit(" ")).alias("reason"))


@query("agent_verdicts", "date:d ticker:s verdict:s summary:s", """
SELECT date, ticker, CASE WHEN lower(trim(coalesce(status, 'n/a'))) <> 'ok' THEN 'ERROR' WHEN a IN ('buy', 'long') THEN 'BUY CONFIRMED' WHEN a IN ('sell', 'short') THEN 'AVOID / SELL'
  WHEN a IN ('hold', 'neutral') THEN 'NO BUY' ELSE upper(replace(a, '_', ' ')) END AS verdict,
 concat_ws(' | ', format('pred_ret_final={:.2f}%', pred), CASE WHEN model IS NULL THEN 'pred_ret_model=n/a' ELSE format('pred_ret_model={:.6f}', model) END,
  format('xgb_rank_score={:.3f}', score), concat('agent_action=', coalesce(action, 'n/a')), concat('agent_status=', coalesce(status, 'n/a')),
  CASE WHEN passed THEN 'agent_pass=True' ELSE 'agent_pass=False' END, concat('agent_reason=', trim(reason))) AS summary
FROM (SELECT *, lower(trim(coalesce(action, 'n/a'))) AS a FROM agent_rows)""")
def _(t):
    c = F.col
    return agent_rows(t).withColumns({
        "verdict": R.agent_verdict(c("action"), c("status")),
        "summary": R.output_summary(c("pred"), c("model"), c("score"), c("action"), c("status"), c("passed"), c("reason"))})
