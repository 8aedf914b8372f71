"""Quotes and streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.catalog.registry import SHARED_SQL, query
from panelweave.functions import dates
from panelweave.plans.fixtures import Tables
from panelweave.session import staging_path
from panelweave.streaming import jobs as Z


class _Streamed(Tables):
    """The same views over file streams. Each table is staged as six files in mixed order; the later half arrives when it is asked for."""

    KEYS = {"documents": "doc_id", "events": "event_id"}

    def __init__(self, spark, folder, table):
        super().__init__(spark, folder)
        self.path, self.files = staging_path(spark, table), 1
        self.stage(table, "< 3")

    def stage(self, table, which):
        part = F.col(self.KEYS[table]) % 6
        super().raw(table).where(f"{self.KEYS[table]} % 6 {which}").repartition(6, part).write.mode("append").parquet(self.path)

    def raw(self, name):
        return Z.read_stream(self.spark, self.path, self.files)


def _in_two_runs(t, table, collect):
    """Three files one by one; then a new query meets the other three, two at a time."""
    first = _Streamed(t.spark, t.folder, table)
    collect(first)
    first.stage(table, ">= 3")
    rest = _Streamed.__new__(_Streamed)
    Tables.__init__(rest, t.spark, t.folder)
    rest.path, rest.files = first.path, 2
    collect(rest)


@query("stream_dedup_news", "ticker:s article_hash:s", """
SELECT DISTINCT ticker, md5(concat_ws('_', CAST(date AS VARCHAR), title, content)) AS article_hash FROM clean_news""")
def _(t):
    path = staging_path(t.spark, "articles")
    _in_two_runs(t, "documents", lambda s: Z.collect_articles(s.news, path))
    return Z.first_articles(t.spark, path)


@query("stream_upsert_daily", "date:d ticker:s price:f volume:i", """
SELECT CAST(ts AS DATE) AS date, ticker, arg_max(price, (ts, event_id)) AS price, sum(volume) AS volume FROM quotes GROUP BY ALL""")
def _(t):
    path = staging_path(t.spark, "daily")
    _in_two_runs(t, "events", lambda s: Z.collect_daily(s.quotes, path))
    return Z.daily_table(t.spark, path)


SHARED_SQL["sessions"] = """
SELECT *, CASE WHEN tm >= TIME '04:00:00' AND tm < TIME '09:30:00' THEN 'premarket' WHEN tm >= TIME '09:30:00' AND tm < TIME '16:00:00' THEN 'regular'
  WHEN tm >= TIME '16:00:00' AND tm <= TIME '20:00:00' THEN 'postmarket' ELSE 'closed' END AS session FROM (
 SELECT *, CAST(timezone('America/New_York', timezone('UTC', ts)) AS TIME) AS tm FROM quotes)"""


@query("session_label", "event_id:i session:s", "SELECT event_id, session FROM sessions")
def _(t):
    return t.quotes.withColumn("session", dates.session_label(F.col("ts")))


_LATEST = """
SELECT ticker, arg_max(price, (session = 'premarket', ts, event_id)) AS price, arg_max(volume, (session = 'premarket', ts, event_id)) AS volume,
 arg_max(event_id, (session = 'premarket', ts, event_id)) AS event_id FROM sessions WHERE price > 0 GROUP BY ticker"""
SHARED_SQL["latest_quotes"] = _LATEST


@query("latest_quote", "ticker:s price:f volume:i event_id:i", "SELECT * FROM latest_quotes")
def _(t):
    return Z.latest_quote(t.quotes, "premarket")


@query("stream_latest_quote", "ticker:s price:f volume:i event_id:i", "SELECT * FROM latest_quotes")
def _(t):
    path = staging_path(t.spark, "latest")
    _in_two_runs(t, "events", lambda s: Z.collect_latest_quotes(s.quotes, "premarket", path))
    return Z.latest_quote_now(t.spark, "premarket", path)


@query("quote_overlay", "ticker:s date:d close:f volume:f", """
SELECT b.ticker, b.date, CASE WHEN b.date = m.last AND q.price > 0 THEN q.price ELSE close END AS close, CASE WHEN b.date = m.last AND q.price > 0 THEN q.volume ELSE b.volume END AS volume
FROM bars b JOIN (SELECT ticker, max(date) AS last FROM bars GROUP BY ticker) m USING (ticker) LEFT JOIN latest_quotes q USING (ticker)""")
def _(t):
    return Z.overlay_quote(t.bars, Z.latest_quote(t.quotes, "premarket"))


@query("quote_source_priority", "event_id:i quote_price:f quote_source:s", """
SELECT event_id, coalesce(a, b, c, d) AS quote_price, CASE WHEN a > 0 THEN concat(an, '_', session) WHEN b > 0 THEN concat(bn, '_', session) WHEN c > 0 THEN concat(cn, '_', session) WHEN d > 0 THEN concat('last_price_', session) ELSE 'unavailable' END AS quote_source FROM (
 SELECT event_id, session, CASE session WHEN 'premarket' THEN pre WHEN 'postmarket' THEN post ELSE reg END AS a, CASE session WHEN 'premarket' THEN reg WHEN 'postmarket' THEN reg ELSE pre END AS b,
  CASE session WHEN 'premarket' THEN post WHEN 'postmarket' THEN pre ELSE post END AS c, lst AS d,
  CASE session WHEN 'premarket' THEN 'pre_market_price' WHEN 'postmarket' THEN 'post_market_price' ELSE 'regular_market_price' END AS an,
  CASE session WHEN 'premarket' THEN 'regular_market_price' WHEN 'postmarket' THEN 'regular_market_price' ELSE 'pre_market_price' END AS bn,
  CASE session WHEN 'premarket' THEN 'post_market_price' WHEN 'postmarket' THEN 'pre_market_price' ELSE 'post_market_price' END AS cn FROM (
  SELECT event_id, session, CASE WHEN event_id % 2 = 0 AND price > 0 AND isfinite(price) THEN price END AS reg,
   CASE WHEN event_id % 3 = 0 AND price + 1 > 0 AND isfinite(price) THEN price + 1 END AS pre, CASE WHEN event_id % 5 = 0 AND price + 2 > 0 AND isfinite(price) THEN price + 2 END AS post,
   CASE WHEN event_id % 7 = 0 AND price + 3 > 0 AND isfinite(price) THEN price + 3 END AS lst FROM sessions))""")
def _(t):
    e, p = F.col("event_id"), F.col("price")
    q = t.quotes.select("event_id", dates.session_label(F.col("ts")).alias("session"), F.when(e % 2 == 0, p).otherwise(0.0).alias("regular_market_price"),
                        F.when(e % 3 == 0, p + 1).alias("pre_market_price"), F.when(e % 5 == 0, p + 2).otherwise(-1.0).alias("post_market_price"),
                        F.when(e % 7 == 0, p + 3).alias("last_price"))
    return Z.quote_by_priority(q)
