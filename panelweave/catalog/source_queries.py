"""Readers and writers; each query writes data derived from the tables and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.catalog.registry import query
from panelweave.catalog.window_queries import PW, _LABEL, panel
from panelweave.operators import windows as W
from panelweave.session import staging_path
from panelweave.sources import readers as S, sinks as K

SIG = "date:d ticker:s pred_return_pct:f rank_score:f"


@query("scan_bars", "ticker:s date:d open:f high:f low:f close:f adj_close:f volume:f vix_close:f", """
SELECT ticker, date, open, high, low, close, close * 2 AS adj_close, volume, volume + 1 AS vix_close FROM bars""")
def _(t):
    path = staging_path(t.spark, "bars_csv")
    rows = t.bars.select("close", (F.col("close") * 2).alias("Adj Close"), "volume", F.col("date").cast("string").alias("Date"), "high", "open",
                         (F.col("volume") + 1).alias("vix_close"), "low", "ticker")
    bad = rows.where("ticker LIKE '%5'").withColumn("Date", F.lit("not a date"))
    K.write_bars_csv(rows.union(bad), path)
    return S.read_bars(t.spark, path)


@query("scan_news_alias", "ticker:s date:d title:s content_md5:s url:s extra:s", """
SELECT source_dataset AS ticker, date, title, md5(content) AS content_md5, NULL AS url, concat('{"id": ', doc_id, '}') AS extra FROM news""")
def _(t):
    raw = t.news.select(F.col("source_dataset").alias("Stock_Symbol"), F.col("date").alias("Published_At"), F.col("title").alias("Main_Headline"),
                        F.col("content").alias("Article"), F.concat(F.lit('{"id": '), F.col("doc_id").cast("string"), F.lit("}")).alias("MetaData"))
    return S.canonicalize(raw).withColumn("content_md5", F.md5("content"))


@query("scan_signals_detect", "date:d ticker:s pred:f score:f actual:f", """
SELECT date, ticker, pred_return_pct AS pred, rank_score AS score, actual_20d_return_pct AS actual FROM signals WHERE ticker_id % 7 <> 0""")
def _(t):
    raw = t.signals.select("date", "ticker", F.when(F.col("ticker_id") % 7 == 0, "n/a").otherwise(F.col("pred_return_pct").cast("string")).alias("pred_return_%"),
                           F.col("rank_score").alias("XGB_Rank"), F.col("actual_20d_return_pct").alias("Actual_20D_Return_%"))
    return S.read_signals(raw, keep=["date", "ticker"])


@query("scan_signals_fragments", "date:d ticker:s pred:f score:f actual:f", """
SELECT date, ticker, pred_return_pct AS pred, rank_score AS score, actual_20d_return_pct AS actual FROM signals""")
def _(t):
    raw = t.signals.select("date", "ticker", F.col("pred_return_pct").alias("model_ALPHA_v2"), F.col("rank_score").cast("string").alias("total Score"),
                           F.col("actual_20d_return_pct").alias("the return"))
    return S.read_signals(raw, loose=True, keep=["date", "ticker"])


@query("scan_tracker", "date:d ticker:s current_price:f pred_return_pct:f rank_score:f dollar_turnover:f", """
SELECT date, ticker, current_price, pred_return_pct, rank_score, NULL AS dollar_turnover FROM signals""")
def _(t):
    raw = t.signals.select(F.col("date").cast("string").alias("Date"), F.col("ticker").alias("Symbol"), F.col("current_price").cast("string").alias("Close"),
                           F.col("pred_return_pct").alias("Some_Pred"), F.col("rank_score").alias("final_Score_x"))
    return S.read_tracker(raw)


@query("scan_multi_tagged", "tag:s ticker:s pred:f turnover:f", """
SELECT 'a_forward.csv' AS tag, ticker, pred_return_pct AS pred, NULL AS turnover FROM signals WHERE year(date) < 1998
UNION ALL SELECT 'final_ensemble_results_b.csv', ticker, pred_return_pct, dollar_turnover FROM signals WHERE year(date) >= 1998""")
def _(t):
    root = staging_path(t.spark, "results")
    s = t.signals.withColumnRenamed("pred_return_pct", "pred")
    early, late, other = s.where("year(date) < 1998"), s.where("year(date) >= 1998"), s.where("year(date) = 1997")
    early.select("ticker", "pred").write.option("header", True).csv(f"{root}/a_forward.csv")
    late.select("ticker", "pred", F.col("dollar_turnover").alias("turnover")).write.option("header", True).csv(f"{root}/deep/final_ensemble_results_b.csv")
    other.select("ticker", "pred").write.option("header", True).csv(f"{root}/unrelated.csv")
    got = S.read_tagged(t.spark, root, ["final_ensemble_results*.csv", "*ensemble_results*.csv", "*forward*.csv"])
    return got.withColumn("tag", F.regexp_extract("source_file", r"([^/]+\.csv)/[^/]*$", 1))


@query("sink_split_partitioned", "doc_id:i split:s key:s", """
SELECT doc_id, CASE WHEN year(date + 2600) >= 2024 AND doc_id % 10 > 0 THEN 'backtest' ELSE 'train' END AS split, concat(ticker, '_', doc_id % 2) AS key FROM news""")
def _(t):
    path = staging_path(t.spark, "split")
    raw = t.news.select("doc_id", F.concat("ticker", F.lit("^"), (F.col("doc_id") % 2).cast("string")).alias("ticker"),
                        F.when(F.col("doc_id") % 10 > 0, F.date_add("date", 2600).cast("string")).otherwise("n.d.").alias("date"))
    K.write_split(raw, path)
    return t.spark.read.parquet(path)


@query("sink_csv_quoteall", "fields:i n:i", "SELECT 3 AS fields, count(*) AS n FROM news")
def _(t):
    path = staging_path(t.spark, "quoted")
    K.write_csv(t.news.select("doc_id", "ticker", F.regexp_replace("title", r"\s+", " ").alias("title")), path)
    lines = t.spark.read.text(path).where(~F.col("value").startswith('"doc_id"'))
    quoted = F.size(F.regexp_extract_all("value", F.lit(r'"(?:[^"]|"")*"(?=,|$)'), F.lit(0)))
    return lines.groupBy(quoted.alias("fields")).agg(F.count("*").alias("n"))


def _halves(t):
    old = t.signals.where("year(date) < 2000").select("date", "ticker", "pred_return_pct", "rank_score")
    new = t.signals.where("date >= '1999-06-01'").select("date", "ticker", (-F.col("pred_return_pct")).alias("pred_return_pct"), "rank_score")
    return old, new.where("ticker LIKE '%1' OR date >= '1999-09-01'")


_OLD = "SELECT date, ticker, pred_return_pct, rank_score FROM signals WHERE year(date) < 2000"
_NEW = "SELECT date, ticker, -pred_return_pct AS pred_return_pct, rank_score FROM signals WHERE date >= DATE '1999-06-01' AND (ticker LIKE '%1' OR date >= DATE '1999-09-01')"


@query("sink_replace_by_key", SIG, f"""
SELECT * FROM ({_OLD}) WHERE date NOT IN (SELECT date FROM ({_NEW})) UNION ALL {_NEW}""")
def _(t):
    old, new = _halves(t)
    once = K.replace_by_key(old, new, ["date"])
    return K.replace_by_key(once, new, ["date"])


@query("sink_overwrite_days", SIG, f"""
SELECT * FROM ({_OLD}) WHERE date NOT IN (SELECT date FROM ({_NEW})) UNION ALL {_NEW}""")
def _(t):
    path = staging_path(t.spark, "days")
    old, new = _halves(t)
    # month folders keep the number of partitions small
    for part in (old, new, new):
        month = part.select(F.trunc("date", "MM").alias("m")).distinct()
        table = part.withColumn("m", F.trunc("date", "MM"))
        if part is not old:
            table = K.replace_by_key(t.spark.read.parquet(path).join(month, "m", "left_semi"), table, ["date"]).checkpoint()
        K.overwrite_days(table, path, "m")
    return t.spark.read.parquet(path)


@query("sink_insert_if_absent", SIG, f"""
SELECT * FROM ({_OLD}) UNION ALL SELECT * FROM ({_NEW}) n WHERE NOT EXISTS (SELECT 1 FROM ({_OLD}) o WHERE o.date = n.date AND o.ticker = n.ticker)""")
def _(t):
    old, new = _halves(t)
    return K.insert_if_absent(old, new, ["date", "ticker"])


@query("sink_tensor_batches", "batch:i tickers:i n:i cells:i first:f4 y:f3", f"""
SELECT (k - 1) // 50 AS batch, count(DISTINCT ticker) AS tickers, count(*) AS n, count(*) * 120 AS cells, sum(before) AS first, sum(label) AS y FROM (
 SELECT ticker, {_LABEL.format(b="beta_prev")} AS label, before, dense_rank() OVER (ORDER BY ticker) AS k
 FROM (SELECT *, CAST(lag(close, 60) {PW} AS FLOAT)::DOUBLE AS before FROM labelled) WHERE rn > 60 AND full20) GROUP BY 1""")
def _(t):
    path = staging_path(t.spark, "sequences")
    y = W.forward_alpha_label(W.rolling_beta(panel(t)), "sequence").select("ticker", "date", F.col("label").alias("y"), F.lit(True).alias("labelled"))
    rows = t.bars.select("ticker", "date", "close", "volume").join(y, ["ticker", "date"], "left")
    K.write_sequences(K.batched_sequences(rows, ["close", "volume"], "labelled").select("batch", "ticker", "date", "seq", "y"), path)
    got = t.spark.read.parquet(path)
    return got.groupBy("batch").agg(F.countDistinct("ticker").alias("tickers"), F.count("*").alias("n"), F.sum(F.size(F.flatten("seq"))).alias("cells"),
                                    F.sum(F.col("seq")[0][0].cast("double")).alias("first"), F.sum("y").alias("y"))


@query("snapshot_history", "snapshot_date:d run:s ticker:s n:i", """
SELECT DATE '2000-01-01' AS snapshot_date, 'r1' AS run, ticker, count(*) AS n FROM bars WHERE date < DATE '2000-01-01' GROUP BY ticker
UNION ALL SELECT DATE '2000-01-02', 'r3', ticker, count(*) FROM bars WHERE date < DATE '2000-01-02' GROUP BY ticker""")
def _(t):
    hist = None
    for run, day in (("r1", "2000-01-01"), ("r2", "2000-01-02"), ("r3", "2000-01-02")):
        state = t.bars.where(F.col("date") < day).groupBy("ticker").agg(F.count("*").alias("n"))
        hist = K.append_snapshot(hist, state, F.lit(day).cast("date"), F.lit(run))
    return hist.withColumnRenamed("run_timestamp_utc", "run")


@query("sink_json_summary", "rows:i tickers:i best_score:f source:s", """
SELECT count(*) AS "rows", count(DISTINCT ticker) AS tickers, max(rank_score) AS best_score, 'signals' AS source FROM signals""")
def _(t):
    one = t.signals.agg(F.count("*").alias("rows"), F.countDistinct("ticker").alias("tickers"), F.max("rank_score").alias("best_score"))
    js = K.summary_json(one, {"source": "signals"})
    return js.select(F.from_json("json", "rows bigint, tickers bigint, best_score double, source string").alias("j")).select("j.*")
