"""Structured Streaming forms of ingest, upsert and quotes.

Articles are told apart by keyed state in the engine: each new one leaves the stream once. Tables that later rows
change are kept as mergeable partial rows (`partials`), folded by readers and compacted as they
grow. Progress lies beside the target, so every job goes on where its last run ended, however it was cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery

from panelweave.functions import dates, numeric as N, text as X
from panelweave.streaming.partials import collect_partials, read_partials

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Quote fields in order of preference per session, then last resorts.
SESSION_FIELDS = {
    "premarket": ("pre_market_price", "regular_market_price", "current_price", "post_market_price"),
    "postmarket": ("post_market_price", "regular_market_price", "current_price", "pre_market_price"),
    "other": ("regular_market_price", "current_price", "pre_market_price", "post_market_price"),
}
LAST_FIELDS = ("last_price", "regular_price", "previous_close")


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """The Parquet files of a folder as a stream; later files are picked up."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def new_articles(stream: DataFrame, date: str = "date", keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Each article once, as it first arrives: by key and hash of the whole content.

    The hashes seen are keyed state of the query, without a time-out; only hashes are kept, not texts.
    """
    h = X.article_hash(F.col(date).cast("string"), X.sanitize(F.col("title")), X.sanitize(F.col("content")))
    return stream.withColumn("article_hash", h).dropDuplicates([*keys, "article_hash"])


def collect_articles(stream: DataFrame, path: str, date: str = "date", keys: Sequence[str] = ("ticker",), name: str = "main") -> StreamingQuery:
    """Append the new articles of everything available now (keys, hash, doc_id) to Parquet files, each exactly once.

    State lives in RocksDB on the executors and in the checkpoint beside the files, so it may outgrow memory and survives them. A
    second run reads only files that the first has not seen.
    """
    spark = stream.sparkSession
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        out = new_articles(stream, date, keys).select(*keys, "article_hash", "doc_id")
        w = out.writeStream.trigger(availableNow=True).outputMode("append").format("parquet")
        q = w.option("path", path).option("checkpointLocation", f"{path.rstrip('/')}/_checkpoint/{name}").start()
    finally:
        spark.conf.set(STATE_STORE, before) if before else spark.conf.unset(STATE_STORE)
    q.awaitTermination()
    return q


def first_articles(spark: SparkSession, path: str) -> DataFrame:
    """The articles collected so far."""
    return spark.read.parquet(path)


def _fold_daily(rows: DataFrame) -> DataFrame:
    return rows.groupBy("date", "ticker").agg(F.max("last").alias("last"), F.sum("volume").alias("volume"))


def collect_daily(stream: DataFrame, path: str, name: str = "main") -> StreamingQuery:
    """Partial day rows: the last quote with its order, and the sum of volumes."""
    last = F.struct("ts", "event_id", "price").alias("last")
    return collect_partials(stream, path, lambda b: _fold_daily(b.select(F.col("ts").cast("date").alias("date"), "ticker", last, "volume")), _fold_daily, name)


def daily_table(spark: SparkSession, path: str) -> DataFrame:
    """One row for each day and ticker over all batches."""
    return _fold_daily(read_partials(spark, path)).select("date", "ticker", "last.price", "volume")


def quote_rank(session: str | Column, ts: str = "ts", tie: str = "event_id") -> Column:
    """Order of quotes: rows of the wanted session first, then the later ones."""
    wanted = F.lit(session) if isinstance(session, str) else session
    return F.struct((dates.session_label(F.col(ts)) == wanted).alias("s"), F.col(ts), F.col(tie))


def latest_quote(quotes: DataFrame, session: str | Column) -> DataFrame:
    """Latest positive price per ticker in the session, else in any session, with the volume of that row.

    A plain aggregate: the same code serves a batch table and a stream.
    """
    good = quotes.where(N.finite(F.col("price")) > 0)
    best = F.max_by(F.struct("price", "volume", "ts", "event_id"), quote_rank(session))
    return good.groupBy("ticker").agg(best.alias("q")).select("ticker", "q.*")


def collect_latest_quotes(stream: DataFrame, session: str, path: str, name: str = "main") -> StreamingQuery:
    """Latest quote of each ticker, as partial rows."""
    fold = lambda rows: latest_quote(rows, session)
    return collect_partials(stream, path, fold, fold, name)


def latest_quote_now(spark: SparkSession, session: str, path: str) -> DataFrame:
    """Latest quote of each ticker over all batches."""
    return latest_quote(read_partials(spark, path), session)


def overlay_quote(bars: DataFrame, quotes: DataFrame) -> DataFrame:
    """Close and volume of the last bar of each ticker replaced by the latest quote when it has one."""
    w = W.partitionBy("ticker").orderBy(F.col("date").desc())
    q = quotes.select("ticker", F.col("price").alias("_p"), F.col("volume").alias("_v"))
    d = bars.withColumn("_last", F.row_number().over(w) == 1).join(q, "ticker", "left")
    fresh = F.col("_last") & (F.col("_p") > 0)
    return d.withColumns({"close": F.when(fresh, F.col("_p")).otherwise(F.col("close")),
                          "volume": F.when(fresh, F.coalesce(F.col("_v").cast("double"), F.col("volume"))).otherwise(F.col("volume"))
                          }).drop("_last", "_p", "_v")


def quote_by_priority(df: DataFrame, session: str = "session") -> DataFrame:
    """First positive price among the ordered fields of the row's session, and where it came from."""
    have = set(df.columns)

    def first(names):
        opts = [(N.positive(F.col(n)), n) for n in names if n in have]
        price = F.coalesce(*[p for p, _ in opts])
        src = F.coalesce(*[F.when(p.isNotNull(), n) for p, n in opts])
        return price, src

    s = F.col(session)
    pre, post, other = (first((*SESSION_FIELDS[k], *LAST_FIELDS)) for k in ("premarket", "postmarket", "other"))
    pick = lambda i: F.when(s == "premarket", pre[i]).when(s == "postmarket", post[i]).otherwise(other[i])
    return df.withColumns({"quote_price": pick(0), "quote_source": F.coalesce(F.concat(pick(1), F.lit("_"), s), F.lit("unavailable"))})
