"""URL filters by a temporal list join, in DataFrame functions only.

Dated list entries become validity intervals per key (a host, a parent domain, or a host with
its first path segment); every capture is judged by the most specific entry that was active
on its day. Distinct (key, day) pairs meet the entries in one window, so a host with a third
of all captures has one row a day there; the captures themselves follow by an equi join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+/([^/?#]+)"


def host_of(url: Column) -> Column:
    """Host in lower case; an empty text where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def section_of(url: Column) -> Column:
    """Host and first path segment, or an empty text."""
    part = F.regexp_extract(F.coalesce(url, F.lit("")), SEGMENT, 1)
    return F.when((part != "") & (host_of(url) != ""), F.concat(host_of(url), F.lit("/"), part)).otherwise("")


def keys_of(url: Column) -> Column:
    """Everything that an entry may name: section, host, and each parent domain of two labels or more."""
    labels = F.split(host_of(url), r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.array_join(F.slice(labels, i + 1, n), "."))
    return F.filter(F.array_distinct(F.concat(F.array(section_of(url)), domains)), lambda k: k != "")


def intervals(entries: DataFrame) -> DataFrame:
    """(key, action, valid_from, valid_to) from entries (key, day, seq, action); valid_to is exclusive, null if open.

    Several entries of one key and day: the one with the largest (seq, action) holds. Entries
    without key, day or action are ignored. A key has at most one interval a day.
    """
    last = entries.where("key is not null and day is not null and action is not null").groupBy("key", "day").agg(
        F.max(F.struct("seq", "action"))["action"].alias("action"))
    return last.select("key", "action", F.col("day").alias("valid_from"), F.lead("day").over(W.partitionBy("key").orderBy("day")).alias("valid_to"))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Verdict of every capture (page_id, url, day): blocked, allowed, unlisted or invalid, with the rule and its interval.

    Actions are block, allow and remove; removed or not yet listed keys don't count. A null or
    malformed url is invalid; a null day matches no entry (unlisted). page_id is expected to be unique; repeated
    rows of one page_id, url and day give one row. Other columns are ignored; empty tables give an empty
    result or only unlisted pages.
    """
    pages = captures.select("page_id", "url", "day").distinct()
    named = pages.select("page_id", "day", F.explode(keys_of(F.col("url"))).alias("key")).where("day is not null")
    rules = intervals(entries)
    asked = named.select("key", "day").distinct()
    marks = rules.select("key", F.col("valid_from").alias("day"), F.struct("action", "valid_from", "valid_to").alias("rule"), F.lit(0).alias("kind"))
    marks = marks.unionByName(asked.withColumns({"rule": F.lit(None).cast(marks.schema["rule"].dataType), "kind": F.lit(1)}))
    upto = W.partitionBy("key").orderBy("day", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    active = marks.withColumn("rule", F.last("rule", ignorenulls=True).over(upto)).where("kind = 1 and rule.action in ('block', 'allow')")
    hits = named.join(active.select("key", "day", "rule"), ["key", "day"]).groupBy("page_id", "day").agg(
        F.max(F.struct(F.length("key").alias("n"), "key", "rule")).alias("best"))
    found = pages.join(hits, ["page_id", "day"], "left")
    verdict = F.when(host_of(F.col("url")) == "", "invalid").when(F.col("best.rule.action") == "block", "blocked").when(
        F.col("best.rule.action") == "allow", "allowed").otherwise("unlisted")
    return found.select("page_id", host_of(F.col("url")).alias("host"), F.col("day").cast("string").alias("day"), verdict.alias("verdict"),
                        F.col("best.key").alias("rule_key"), F.col("best.rule.valid_from").cast("string").alias("rule_from"),
                        F.col("best.rule.valid_to").cast("string").alias("rule_to"))


def dated_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captures and list entries as the query derives them from `pages`: fetch days and entry days follow from page_id."""
    start, p = F.lit("2024-01-01").cast("date"), F.col("page_id")
    captures = pages.select("page_id", "url", F.date_add(start, (p % 366).cast("int")).alias("day"))
    action = F.when(p % 3 == 0, "block").when(p % 3 == 1, "remove").otherwise("allow")
    key = F.when(p % 2 == 0, host_of(F.col("url"))).otherwise(section_of(F.col("url")))
    entries = pages.where("page_id % 5 < 2").select(
        F.nullif(key, F.lit("")).alias("key"), F.date_add(start, ((p * 37 + 11) % 366).cast("int")).alias("day"), p.alias("seq"), action.alias("action"))
    return captures, entries


_HOST = f"lower(regexp_extract(coalesce(url, ''), '{HOST}', 1))"
_SEGMENT = f"regexp_extract(coalesce(url, ''), '{SEGMENT}', 1)"

ORACLE = f"""
WITH p AS (
  SELECT page_id, url, {_HOST} AS host, DATE '2024-01-01' + CAST(page_id % 366 AS INT) AS day,
         CASE WHEN {_SEGMENT} <> '' AND {_HOST} <> '' THEN {_HOST} || '/' || {_SEGMENT} ELSE '' END AS section FROM pages),
e AS (
  SELECT nullif(CASE WHEN page_id % 2 = 0 THEN host ELSE section END, '') AS key,
         DATE '2024-01-01' + CAST((page_id * 37 + 11) % 366 AS INT) AS day, page_id AS seq,
         CASE page_id % 3 WHEN 0 THEN 'block' WHEN 1 THEN 'remove' ELSE 'allow' END AS action
  FROM p WHERE page_id % 5 < 2),
l AS (SELECT key, day, arg_max(action, seq) AS action FROM e WHERE key IS NOT NULL GROUP BY key, day),
r AS (SELECT key, action, day AS valid_from, lead(day) OVER (PARTITION BY key ORDER BY day) AS valid_to FROM l),
k AS (
  SELECT DISTINCT page_id, day, key FROM (
    SELECT page_id, day, section AS key FROM p UNION ALL
    SELECT page_id, day, array_to_string(list_slice(labels, i, len(labels)), '.') FROM (
      SELECT page_id, day, string_split(host, '.') AS labels,
             unnest(range(1, greatest(len(string_split(host, '.')), 2))) AS i FROM p)) WHERE key <> ''),
h AS (
  SELECT k.page_id, k.key, r.action, r.valid_from, r.valid_to,
         row_number() OVER (PARTITION BY k.page_id ORDER BY length(k.key) DESC) AS i
  FROM k JOIN r ON r.key = k.key AND r.valid_from <= k.day AND (r.valid_to IS NULL OR k.day < r.valid_to)
  WHERE r.action IN ('block', 'allow'))
SELECT p.page_id, p.host, CAST(p.day AS VARCHAR) AS day,
       CASE WHEN p.host = '' THEN 'invalid' WHEN h.action = 'block' THEN 'blocked'
            WHEN h.action = 'allow' THEN 'allowed' ELSE 'unlisted' END AS verdict,
       h.key AS rule_key, CAST(h.valid_from AS VARCHAR) AS rule_from, CAST(h.valid_to AS VARCHAR) AS rule_to
FROM p LEFT JOIN h ON h.page_id = p.page_id AND h.i = 1
"""
