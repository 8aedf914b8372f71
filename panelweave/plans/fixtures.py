"""Typed views over the given tables: bars, market, signals, news, vectors, responses, quotes.

Groups are bounded by construction. `bars` and `signals` hold one row per
(ticker, date) and `market` one row per date, so a ticker group never exceeds
the number of calendar days however the raw rows are spread. The raw rows of
one ticker and day are folded in shards, then the shards.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from panelweave.plans.panel_store import stored_panel


#: Parts into which the ticks of one ticker and day are dealt before they are folded.
SHARDS = 64
# The whole text of an answer is dealt over these headings.
ANSWER_PARTS = ("Technical Analysis", "Fundamental Assessment", "Risk Assessment", "Price Target", "Catalysts", "Investment Thesis", "Timeline")


def answer_piece(i: int) -> str:
    """DuckDB text of one part."""
    n = len(ANSWER_PARTS)
    return f"substr(text, length(text) * {i} // {n} + 1, length(text) * {i + 1} // {n} - length(text) * {i} // {n})"


class Tables:
    """Lazy access to the tables of one folder and the views derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def _panel(self) -> tuple[DataFrame, DataFrame]:
        # the number of ticks comes from the footers of the files
        return stored_panel(self.spark, self.folder, self.raw("lineitem").count, self.build_bars, self.build_market)

    @property
    def bars(self) -> DataFrame:
        return self._panel[0]

    @property
    def market(self) -> DataFrame:
        return self._panel[1]

    def build_bars(self, parts: int) -> DataFrame:
        """Daily bars folded from ticks, dealt to `parts` partitions by ticker.

        Ticks are dealt by ticker, day and shard and folded there, then the bars of the shards by ticker: what a task sorts is
        bounded by `parts`, also for a day or ticker with very many ticks, and nothing is sorted before the first shuffle.
        """
        ticks = (
            self.raw("lineitem").where(F.col("l_quantity") > 0)
            .select(F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("ticker"), F.col("l_suppkey").alias("ticker_id"),
                    F.col("l_shipdate").cast("date").alias("date"), F.col("l_quantity").alias("q"),
                    F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
                             (F.col("l_extendedprice") / F.col("l_quantity")).alias("px")).alias("o"))
            .withColumn("shard", F.pmod(F.xxhash64("o"), F.lit(SHARDS)))
        )

        def fold(df, keys, first, last, high, low, volume):
            return df.groupBy(*keys).agg(F.min(first).alias("first"), F.max(last).alias("last"), F.max(high).alias("high"),
                                         F.min(low).alias("low"), F.sum(volume).alias("volume"))

        day = ["ticker", "ticker_id", "date"]
        parted = fold(ticks.repartition(parts, "ticker", "date", "shard"), [*day, "shard"], "o", "o", "o.px", "o.px", "q")
        bars = fold(parted.repartition(parts, "ticker"), day, "first", "last", "high", "low", "volume")
        return bars.select("ticker_id", "ticker", "date", F.col("first.px").alias("open"), "high", "low", F.col("last.px").alias("close"), "volume")

    @staticmethod
    def build_market(bars: DataFrame) -> DataFrame:
        """One row per day over all tickers."""
        def mean(c):
            return F.sum(c.cast("decimal(24,8)")).cast("double") / F.count("*")

        return bars.groupBy("date").agg(
            mean(F.col("open")).alias("spy_open"), mean(F.col("close")).alias("spy_close"),
            F.sum("volume").alias("spy_volume"),
            (F.lit(1) + mean(F.col("high") - F.col("low"))).alias("vix_close"))

    @cached_property
    def signals(self) -> DataFrame:
        d = (F.year("date") * 372 + F.month("date") * 31 + F.day("date")).cast("bigint")
        w = W.partitionBy("ticker").orderBy("date")
        i = F.col("ticker_id")
        return (
            self.bars.withColumn("d", d)
            .withColumn("fwd", (F.lead("close", 19).over(w) / F.col("open") - 1) * 100)
            .select("date", "ticker_id", "ticker", F.col("close").alias("current_price"),
                    F.col("volume").alias("current_volume"), (F.col("close") * F.col("volume")).alias("dollar_turnover"),
                    (((i * 7919 + F.col("d") * 104729) % 2001 - 1000) / F.lit(100.0)).alias("pred_return_pct"),
                    (((i * 15485863 + F.col("d") * 32452843) % 2001 - 1000) / F.lit(1000.0)).alias("rank_score"),
                    F.when((i + F.col("d")) % 10 != 0, F.col("fwd")).alias("actual_20d_return_pct"))
        )

    @cached_property
    def news(self) -> DataFrame:
        return self.raw("documents").select(
            "doc_id", F.col("source").alias("source_dataset"),
            F.concat(F.lit("T"), F.replace("source", F.lit("src"), F.lit(""))).alias("ticker"),
            F.date_add(F.lit("2015-06-01").cast("date"), (F.col("doc_id") % 900).cast("int")).alias("date"),
            F.substring("text", 1, 80).alias("title"), F.col("text").alias("content"))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(
            "vec_id", F.concat(F.lit("T"), F.col("label").cast("string")).alias("ticker"),
            F.date_add(F.lit("2015-06-01").cast("date"), (F.col("vec_id") % 300).cast("int")).alias("date"),
            F.col("embedding").alias("emb"))

    @cached_property
    def responses(self) -> DataFrame:
        t, k = F.col("text"), (F.col("conv_id") + F.col("turn")) % 4
        start = lambda i: F.floor(F.length(t) * i / len(ANSWER_PARTS)).cast("int")
        piece = lambda i: F.substring(t, start(i) + 1, start(i + 1) - start(i))
        word = F.when(k == 0, "BUY").when(k == 1, "SELL").when(k == 2, "HOLD").otherwise("maybe")
        return self.raw("conversations").where(F.col("role") == "assistant").select(
            "conv_id", "turn", F.concat(F.lit("T"), (F.col("conv_id") % 20).cast("string")).alias("ticker"),
            F.concat(*[x for i, h in enumerate(ANSWER_PARTS) for x in (F.lit(f"{h}: "), piece(i), F.lit("\n"))],
                     F.lit("Final Recommendation: **"), word, F.lit("**\nConfidence: "),
                     ((F.col("conv_id") * 7 + F.col("turn")) % 101).cast("string")).alias("text"))

    @cached_property
    def quotes(self) -> DataFrame:
        return self.raw("events").select(
            "event_id", F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("ticker"), "ts",
            F.col("value").alias("price"), (F.col("event_id") % 500).alias("volume"))


# The same views as DuckDB text, used as common table expressions by the oracles.
VIEW_SQL = {
    "bars": """
SELECT ticker_id, concat('T', ticker_id) AS ticker, date,
       max(CASE WHEN i = 1 THEN px END) AS open, max(px) AS high, min(px) AS low,
       max(CASE WHEN i = n THEN px END) AS close, sum(q) AS volume
FROM (
  SELECT l_suppkey AS ticker_id, CAST(l_shipdate AS DATE) AS date,
         l_extendedprice / l_quantity AS px, l_quantity AS q,
         row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE)
             ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS i,
         count(*) OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE)) AS n
  FROM lineitem WHERE l_quantity > 0) t GROUP BY ticker_id, date""",
    "market": """
SELECT date,
       CAST(sum(CAST(open AS DECIMAL(24,8))) AS DOUBLE) / count(*) AS spy_open,
       CAST(sum(CAST(close AS DECIMAL(24,8))) AS DOUBLE) / count(*) AS spy_close,
       sum(volume) AS spy_volume,
       1 + CAST(sum(CAST(high - low AS DECIMAL(24,8))) AS DOUBLE) / count(*) AS vix_close
FROM bars GROUP BY date""",
    "signals": """
SELECT date, ticker_id, ticker, close AS current_price, volume AS current_volume,
       close * volume AS dollar_turnover,
       ((ticker_id*7919 + d*104729) % 2001 - 1000) / 100e0 AS pred_return_pct,
       ((ticker_id*15485863 + d*32452843) % 2001 - 1000) / 1000e0 AS rank_score,
       CASE WHEN (ticker_id + d) % 10 = 0 THEN NULL ELSE fwd END AS actual_20d_return_pct
FROM (
  SELECT *, CAST(year(date)*372 + month(date)*31 + day(date) AS BIGINT) AS d,
         (lead(close, 19) OVER (PARTITION BY ticker_id ORDER BY date) / open - 1) * 100 AS fwd
  FROM bars) b""",
    "news": """
SELECT doc_id, source AS source_dataset, concat('T', replace(source, 'src', '')) AS ticker,
       DATE '2015-06-01' + CAST(doc_id % 900 AS INT) AS date,
       substr(text, 1, 80) AS title, text AS content
FROM documents""",
    "vectors": """
SELECT vec_id, concat('T', label) AS ticker,
       DATE '2015-06-01' + CAST(vec_id % 300 AS INT) AS date, embedding AS emb
FROM embeddings""",
    "responses": f"""
SELECT conv_id, turn, concat('T', conv_id % 20) AS ticker,        concat({", ".join(f"'{h}: ', {answer_piece(i)}, chr(10)" for i, h in enumerate(ANSWER_PARTS))},
              'Final Recommendation: **',
              CASE (conv_id + turn) % 4 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' WHEN 2 THEN 'HOLD' ELSE 'maybe' END,
              '**', chr(10), 'Confidence: ', CAST((conv_id * 7 + turn) % 101 AS INT)) AS text
FROM conversations WHERE role = 'assistant'""",
    "quotes": """
SELECT event_id, concat('T', user_id) AS ticker, ts, value AS price,
       event_id % 500 AS volume FROM events""",
}
