"""Text operators over documents, pages, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.catalog.registry import SHARED_SQL, query
from panelweave.functions import rules as R, text as X
from panelweave.operators import text as T
from panelweave.plans.fixtures import ANSWER_PARTS, answer_piece

STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def _clean(c: str) -> str:
    flat = f"regexp_replace({c}, '[\\r\\n\\t\\x0B\\f]+', ' ', 'g')"
    return f"replace({STRIP.format(flat)}, '\"', '''')"


SHARED_SQL["clean_news"] = f"SELECT doc_id, ticker, date, {_clean('title')} AS title, {_clean('content')} AS content FROM news"


def clean_news(t):
    return T.sanitize_articles(t.news)


@query("sanitize_text", "doc_id:i title:s md5:s n:i", "SELECT doc_id, title, md5(content) AS md5, length(content) AS n FROM clean_news")
def _(t):
    return clean_news(t).withColumns({"md5": F.md5("content"), "n": F.length("content")})


# Raw rows with a textual list, JSON extra fields, or neither.
SHARED_SQL["raw_news"] = """
SELECT doc_id, date, title, content, CASE doc_id % 4 WHEN 0 THEN concat('[''', lower(ticker), ''', ''BRK.B'', ''overlongticker'', '''', ''', ticker, ''']') END AS listed,
 CASE doc_id % 4 WHEN 1 THEN concat('{"stocks": ["', ticker, '", "X.Y"]}') WHEN 2 THEN concat('{"stocks": [], "tickers": ["', ticker, '"]}') END AS extra FROM news"""


def raw_news(t):
    k = F.col("doc_id") % 4
    quoted = F.format_string("['%s', 'BRK.B', 'overlongticker', '', '%s']", F.lower("ticker"), F.col("ticker"))
    return t.news.select("doc_id", "date", "title", "content", F.when(k == 0, quoted).alias("listed"),
                         F.when(k == 1, F.format_string('{"stocks": ["%s", "X.Y"]}', F.col("ticker")))
                         .when(k == 2, F.format_string('{"stocks": [], "tickers": ["%s"]}', F.col("ticker"))).alias("extra"))


HIT_WORDS = ["THE", "LES", "DER", "QUE", "OF THE", "L'A", "DE LA"]
# DuckDB keeps the sharp s in upper case; Spark and the original expand it
_UP = "upper(replace(concat_ws(' ', title, content), 'ß', 'ss'))"
_WORDS = "regexp_split_to_array(upper(replace({0}, 'ß', 'ss')), '[^\\p{{L}}\\p{{N}}_]+')"
_W = "[\\p{L}\\p{N}_]"


def _matches(texts: str, table: str) -> str:
    """Leftmost-longest matches of a table (symbol, head) in texts (doc_id, u): tokens, candidates, then a fold that skips overlaps."""
    return f"""
SELECT DISTINCT doc_id, symbol FROM (
 SELECT doc_id, unnest(list_reduce(list({{'s': s, 'e': e, 'out': [symbol]}} ORDER BY s), lambda a, x:
  CASE WHEN x.s >= a.e THEN {{'s': x.s, 'e': x.e, 'out': list_concat(a.out, x.out)}} ELSE a END).out) AS symbol FROM (
  SELECT doc_id, p AS s, max(p + length(symbol)) AS e, arg_max(symbol, length(symbol)) AS symbol FROM (
   SELECT doc_id, tk, 1 + coalesce(sum(length(tk)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM (
    SELECT doc_id, unnest(l) AS tk, unnest(range(len(l))) AS i FROM (
     SELECT doc_id, regexp_extract_all(u, '{_W}+|[^\\p{{L}}\\p{{N}}_]') AS l FROM {texts})))
  JOIN {table} ON head = tk JOIN {texts} AS full_text USING (doc_id)
  WHERE substr(u, CAST(p AS BIGINT), length(symbol)) = symbol AND NOT regexp_matches(substr(u, CAST(p AS BIGINT) + length(symbol), 1), '{_W}')
  GROUP BY doc_id, p) GROUP BY doc_id)"""


SHARED_SQL["hit_words"] = f"SELECT symbol, regexp_extract(symbol, '^{_W}+') AS head FROM (SELECT unnest({HIT_WORDS!r}) AS symbol)".replace('"L\'A"', "'L''A'")
SHARED_SQL["raw_upper"] = f"SELECT doc_id, {_UP} AS u FROM raw_news WHERE doc_id % 4 = 3"
SHARED_SQL["raw_hits"] = _matches("raw_upper", "hit_words")
SHARED_SQL["exploded_news"] = f"""
SELECT DISTINCT doc_id, title, content, replace(upper(tk), '.', '-') AS ticker FROM (
 SELECT doc_id, title, content, unnest(CASE doc_id % 4 WHEN 0 THEN list_transform(string_split(regexp_replace(listed, '[\\[\\]''"]', '', 'g'), ','), lambda x: trim(x))
  WHEN 1 THEN json_extract_string(extra, '$.stocks[*]') WHEN 2 THEN json_extract_string(extra, '$.tickers[*]')
  ELSE coalesce(hits, ['^GSPC']) END) AS tk FROM raw_news LEFT JOIN (SELECT doc_id, list(symbol) AS hits FROM raw_hits GROUP BY doc_id) USING (doc_id))
WHERE tk <> ''"""


def hits():
    return T.dictionary_hits(F.concat_ws(" ", "title", "content"), HIT_WORDS)


@query("explode_tickers", "doc_id:i ticker:s long_name:b", "SELECT doc_id, ticker, length(ticker) > 10 AS long_name FROM exploded_news")
def _(t):
    return T.explode_tickers(raw_news(t), "listed", "extra", hits())


# Every word of two letters and more, and every pair of neighbouring words with what stands between them.
SHARED_SQL["vocabulary"] = f"""
SELECT symbol, regexp_extract(symbol, '^{_W}+') AS head FROM (
 SELECT DISTINCT unnest(list_concat(regexp_extract_all(u, '{_W}{{2,}}'), regexp_extract_all(u, '{_W}+[^\\p{{L}}\\p{{N}}_]{{1,2}}{_W}+'))) AS symbol
 FROM (SELECT upper(replace(text, 'ß', 'ss')) AS u FROM benchmark))"""
SHARED_SQL["news_upper"] = f"SELECT doc_id, {_UP} AS u FROM news"


def vocabulary(t):
    up, word, other = F.upper("text"), r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
    both = F.concat(F.regexp_extract_all(up, F.lit(word + "{2,}"), F.lit(0)), F.regexp_extract_all(up, F.lit(f"{word}+{other}{{1,2}}{word}+"), F.lit(0)))
    return t.raw("benchmark").select(F.explode(both).alias("symbol")).distinct()


@query("entity_scan", "doc_id:i symbol:s", _matches("news_upper", "vocabulary"))
def _(t):
    return T.entity_scan(t.news, vocabulary(t), title="title")


PHRASES = (*X.MARKET_PHRASES, "tion the", "que les")


@query("keyword_flag", "doc_id:i ticker:s is_macro:b", f"""
WITH f AS (SELECT doc_id, ticker, ({' OR '.join(f"contains(lower(concat_ws(' ', title, content)), '{p}')" for p in PHRASES)}) AS is_macro FROM exploded_news)
SELECT * FROM f UNION ALL SELECT DISTINCT doc_id, '^GSPC' AS ticker, true AS is_macro FROM f WHERE is_macro AND doc_id NOT IN (SELECT doc_id FROM f WHERE ticker = '^GSPC')""")
def _(t):
    return T.explode_tickers(T.flag_macro(raw_news(t), phrases=PHRASES, title="title"), "listed", "extra", hits(), macro="is_macro")


SHARED_SQL["doubled_news"] = "SELECT doc_id, ticker, date, title, content FROM news UNION ALL SELECT doc_id + 1000000000, ticker, date, title, content FROM news WHERE doc_id % 3 = 0"


def doubled_news(t):
    n = t.news.select("doc_id", "ticker", "date", "title", "content")
    return n.union(n.where("doc_id % 3 = 0").withColumn("doc_id", F.col("doc_id") + 1_000_000_000))


@query("dedup_md5", "doc_id:i ticker:s date:d", """
SELECT min(doc_id) AS doc_id, ticker, date FROM doubled_news GROUP BY ticker, date, title, content""")
def _(t):
    return T.dedupe_articles(doubled_news(t))


@query("era_filter", "doc_id:i date_text:s", """
SELECT * FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'unknown' ELSE CAST(date - 300 AS VARCHAR) END AS date_text FROM news)
WHERE date_text = 'unknown' OR CAST(substr(date_text, 1, 4) AS INT) >= 2015""")
def _(t):
    d = F.when(F.col("doc_id") % 9 == 0, "unknown").otherwise(F.date_sub("date", 300).cast("string"))
    return T.era_filter(t.news.withColumn("date_text", d), "date_text")


@query("text_compose", "doc_id:i processed_date:d md5:s", """
SELECT doc_id, CAST(date + INTERVAL 22 HOUR + INTERVAL 5 HOUR AS DATE) AS processed_date, md5(concat(coalesce(CASE WHEN doc_id % 5 > 0 THEN title END, ''), '. ', content)) AS md5 FROM news WHERE doc_id % 8 > 0""")
def _(t):
    raw = t.news.withColumns({
        "title": F.when(F.col("doc_id") % 5 > 0, F.col("title")),
        "stamp": F.when(F.col("doc_id") % 8 > 0, F.concat(F.col("date").cast("string"), F.lit(" 22:00:00-05:00"))).otherwise("n/a")})
    return T.compose_text(raw, "title", "content", "stamp").withColumn("md5", F.md5("processed_text"))


@query("stratified_sample", "ticker:s doc_id:i", """
SELECT ticker, doc_id FROM news WHERE date < DATE '2016-01-01' AND substr(md5(CAST(doc_id AS VARCHAR) || ':42'), 1, 4) < '4000'""")
def _(t):
    return T.stratified_sample(t.news, fraction=0.25)


@query("text_sizes", "ticker:s n_bytes:i n_rows:i", """
SELECT ticker, sum(strlen(content)) AS n_bytes, count(*) AS n_rows FROM news GROUP BY ticker""")
def _(t):
    return T.text_sizes(t.news)


SHARED_SQL["tagged_items"] = """
SELECT doc_id, ticker, date, CASE WHEN doc_id % 7 = 0 THEN 'YF: - |' ELSE concat(CASE doc_id % 3 WHEN 0 THEN 'YF: ' WHEN 1 THEN 'NYT: ' ELSE 'WM: ' END, regexp_replace(title, '\\s+', ' ', 'g')) END AS text FROM news"""


def tagged_items(t):
    k = F.col("doc_id")
    tag = F.when(k % 3 == 0, "YF: ").when(k % 3 == 1, "NYT: ").otherwise("WM: ")
    return t.news.select("doc_id", "ticker", "date", F.when(k % 7 == 0, "YF: - |").otherwise(
        F.concat(tag, F.regexp_replace("title", r"\s+", " "))).alias("text"))


@query("corpus_build", "ticker:s corpus:s", f"""
SELECT ticker, coalesce(string_agg(p, ' | ' ORDER BY i) FILTER (i IS NOT NULL), '') AS corpus FROM (
 SELECT ticker, p, min(CASE WHEN length({STRIP.format("replace(replace(replace(replace(replace(p, 'YF:', ''), 'NYT:', ''), 'WM:', ''), '-', ''), '|', '')")}) >= 5 THEN i END) AS i FROM (
  SELECT ticker, {STRIP.format('text')} AS p, row_number() OVER (PARTITION BY ticker ORDER BY date DESC, doc_id DESC) AS i FROM tagged_items) WHERE i <= 20 GROUP BY ticker, p) GROUP BY ticker""")
def _(t):
    return T.corpus(tagged_items(t), order=[F.col("date").desc(), F.col("doc_id").desc()], items=20)


_TAGS = "trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("html_headlines", "page_id:i pos:i headline:s", f"""
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY first) - 1 AS pos, headline FROM (
 SELECT page_id, headline, min(o) AS first FROM (
  SELECT page_id, unnest(h) AS headline, unnest(range(len(h))) AS o FROM (SELECT page_id, CASE WHEN len(h) > 0 THEN h ELSE j END AS h FROM (
   SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<(?:title|h[1-4])(?:\\s[^>]*)?>(.*?)</(?:title|h[1-4])>', 1), lambda x: {_TAGS}), lambda x: length(x) > 10) AS h,
    list_transform(regexp_extract_all(html, '"(?:title|newsTitle)"\\s*:\\s*"([^"\\\\]{{12,}}.*?)"', 1), lambda x: trim(x)) AS j FROM pages))) GROUP BY page_id, headline)""")
def _(t):
    return T.html_headlines(t.raw("pages"))


# An empty section swallows the line break, so its body is the next line; the pattern of the original does the same.
def _sections_sql():
    trim = STRIP.format
    parts = []
    for i, h in enumerate(ANSWER_PARTS):
        after = f"concat('{ANSWER_PARTS[i + 1]}: ', p{i + 1})" if i + 1 < len(ANSWER_PARTS) else "regexp_extract(text, 'Final Recommendation: [*]+[A-Za-z]+[*]+')"
        parts.append(f"CASE WHEN {trim(f'p{i}')} = '' THEN {trim(after)} ELSE {trim(f'p{i}')} END AS {h.lower().replace(' ', '_')}")
    pieces = ", ".join(f"{answer_piece(i)} AS p{i}" for i in range(len(ANSWER_PARTS)))
    return (f"SELECT conv_id, turn, {', '.join(parts)} FROM (SELECT conv_id, turn, {pieces} FROM conversations WHERE role = 'assistant') "
            "JOIN (SELECT conv_id, turn, text FROM responses) USING (conv_id, turn)")


@query("section_extract", "conv_id:i turn:i " + " ".join(f"{h.lower().replace(' ', '_')}:s" for h in ANSWER_PARTS), _sections_sql())
def _(t):
    return T.extract_sections(t.responses)


# A third of the answers lack the confidence line.
SHARED_SQL["partial_responses"] = "SELECT conv_id, turn, ticker, CASE WHEN conv_id % 3 = 0 THEN regexp_replace(text, '\\nConfidence: [0-9]+$', '') ELSE text END AS text FROM responses"


def partial_responses(t):
    return t.responses.withColumn("text", F.when(F.col("conv_id") % 3 == 0, F.regexp_replace("text", r"\nConfidence: [0-9]+$", "")).otherwise(F.col("text")))


_SET = "('buy', 'sell', 'hold', 'long', 'short', 'neutral', 'wait')"
_TAIL = "recommendation\\s*[:\\-]*\\s*(?:\\*\\*|\\*|#)?\\s*([a-zA-Z]+)"


def _rec_sql(order):
    words = {"hold": ("hold", "neutral"), "sell": ("sell", "short"), "buy": ("buy", "long")}
    scan = " ".join(f"WHEN contains(lower(text), '{words[a][0]}') OR contains(lower(text), '{words[a][1]}') THEN '{a}'" for a in order)
    return (f"SELECT conv_id, turn, text, CASE WHEN a IN {_SET} THEN a WHEN b IN {_SET} THEN b {scan} ELSE 'unknown' END AS recommendation FROM ("
            f"SELECT *, lower(regexp_extract_all(text, '(?i)final\\s+{_TAIL}', 1)[-1]) AS a, lower(regexp_extract(text, '(?i){_TAIL}', 1)) AS b FROM partial_responses)")


SHARED_SQL["recommended"] = _rec_sql(("hold", "sell", "buy"))


@query("recommendation_extract", "conv_id:i turn:i recommendation:s", "SELECT conv_id, turn, recommendation FROM recommended")
def _(t):
    return partial_responses(t).withColumn("recommendation", X.recommendation(F.col("text")))


@query("recommendation_extract_legacy", "conv_id:i turn:i recommendation:s", f"SELECT conv_id, turn, recommendation FROM ({_rec_sql(('buy', 'sell', 'hold'))})")
def _(t):
    return partial_responses(t).withColumn("recommendation", X.recommendation(F.col("text"), ("buy", "sell", "hold")))


@query("confidence_extract", "conv_id:i turn:i confidence:f", """
SELECT conv_id, turn, coalesce(CASE WHEN c > 1 THEN least(1, c / 100) ELSE c END, CASE WHEN recommendation = 'hold' THEN 0.4e0 ELSE 0.45e0 END) AS confidence FROM (
 SELECT *, TRY_CAST(nullif(regexp_extract(text, '(?is)confidence[^0-9]{0,40}([0-9]*\\.?[0-9]+)', 1), '') AS DOUBLE) AS c FROM recommended)""")
def _(t):
    return partial_responses(t).withColumn("confidence", X.confidence(F.col("text"), X.recommendation(F.col("text"))))


def _count_sql(words):
    return " + ".join(f"CAST(contains(lower(content), '{w}') AS INT)" for w in words)


@query("lexicon_score", "doc_id:i high_n:i low_n:i net:i", f"""
SELECT doc_id, {_count_sql((*X.HIGH_CONVICTION, 'ation'))} AS high_n, {_count_sql((*X.LOW_CONVICTION, 'eau'))} AS low_n, high_n - low_n AS net FROM news""")
def _(t):
    low = F.lower("content")
    d = t.news.withColumns({"high_n": X.count_contained(low, (*X.HIGH_CONVICTION, "ation")), "low_n": X.count_contained(low, (*X.LOW_CONVICTION, "eau"))})
    return d.withColumn("net", F.col("high_n") - F.col("low_n"))


def _any_sql(markers):
    return " OR ".join(f"contains(m, '{w}')" for w in markers)


@query("error_classify", "event_id:i class:s", f"""
SELECT event_id, CASE WHEN {_any_sql(X.QUOTA_MARKERS)} THEN 'quota' WHEN {_any_sql(X.REFUSAL_MARKERS)} THEN 'refusal' WHEN {_any_sql(X.TRANSIENT_MARKERS)} THEN 'transient' ELSE 'other' END AS class
FROM (SELECT event_id, lower(concat(event_type, CASE event_id % 6 WHEN 0 THEN ' Read TIMEOUT' WHEN 1 THEN ' HTTP 503' WHEN 2 THEN ' Quota exceeded' WHEN 3 THEN ' Unable to provide' ELSE '' END)) AS m FROM events)""")
def _(t):
    k = F.col("event_id") % 6
    tail = F.when(k == 0, " Read TIMEOUT").when(k == 1, " HTTP 503").when(k == 2, " Quota exceeded").when(k == 3, " Unable to provide").otherwise("")
    return t.raw("events").select("event_id", X.error_class(F.concat("event_type", tail)).alias("class"))


SHARED_SQL["reports"] = """
SELECT conv_id, turn, concat('# Report', chr(10), text, chr(10), CASE WHEN conv_id % 3 = 0 THEN '**Final Recommendation**: **STRONG_BUY**' ELSE '' END, chr(10),
 CASE conv_id % 4 WHEN 0 THEN '- Should Buy Now: YES' WHEN 1 THEN 'Hold or Sell: SELL' ELSE '' END, chr(10), CASE WHEN conv_id % 5 > 0 THEN concat('- Current Verdict: WAIT', chr(10), 'Confidence: 0.', turn) ELSE '' END) AS report FROM conversations"""


@query("verdict_extract", "conv_id:i turn:i verdict:s decision:s confidence:f", """
SELECT conv_id, turn, coalesce(nullif(regexp_extract(report, '\\*\\*Final Recommendation\\*\\*:\\s*\\*\\*([A-Z_]+)\\*\\*', 1), ''), d, nullif(regexp_extract(report, '(?:Current\\s+)?Verdict:\\s*([A-Z_]+)', 1), ''), 'N/A') AS verdict,
 coalesce(d, 'N/A') AS decision, coalesce(TRY_CAST(nullif(regexp_extract(report, 'Confidence:\\s*([0-9.]+)', 1), '') AS DOUBLE), 0) AS confidence
FROM (SELECT *, nullif(regexp_extract(report, '(?:Should Buy Now|Decision|Hold or Sell):\\s*([A-Z]+)', 1), '') AS d FROM reports)""")
def _(t):
    k = F.col("conv_id")
    nl = F.lit("\n")
    report = F.concat(F.lit("# Report"), nl, F.col("text"), nl, F.when(k % 3 == 0, "**Final Recommendation**: **STRONG_BUY**").otherwise(""), nl,
                      F.when(k % 4 == 0, "- Should Buy Now: YES").when(k % 4 == 1, "Hold or Sell: SELL").otherwise(""), nl,
                      F.when(k % 5 > 0, F.concat(F.lit("- Current Verdict: WAIT\nConfidence: 0."), F.col("turn").cast("string"))).otherwise(""))
    return t.raw("conversations").withColumn("report", report).withColumns(X.report_fields(F.col("report")))


SHARED_SQL["toned"] = """
SELECT date, ticker, ticker_id, pred_return_pct * 1.0137e0 + 0.00123e0 AS pred, rank_score * 0.1371e0 AS score, (ticker_id * 13 % 101) / 101e0 AS pos, ((ticker_id * 29 + day(date)) % 97) / 97e0 AS neg,
 day(date) / 31e0 AS mpos, month(date) / 12e0 AS mneg, coalesce(actual_20d_return_pct, 0) / 7 AS recent, CASE ticker_id % 3 WHEN 0 THEN 'Buy' WHEN 1 THEN 'sell' ELSE 'hold' END AS action, ticker_id % 2 = 0 AS fb FROM signals"""


def toned(t):
    i, d = F.col("ticker_id"), F.day("date")
    return t.signals.select(
        "date", "ticker", (F.col("pred_return_pct") * 1.0137 + 0.00123).alias("pred"), (F.col("rank_score") * 0.1371).alias("score"),
        (i * 13 % 101 / F.lit(101.0)).alias("pos"), ((i * 29 + d) % 97 / F.lit(97.0)).alias("neg"), (d / F.lit(31.0)).alias("mpos"),
        (F.month("date") / F.lit(12.0)).alias("mneg"), (F.coalesce("actual_20d_return_pct", F.lit(0.0)) / 7).alias("recent"),
        F.when(i % 3 == 0, "Buy").when(i % 3 == 1, "sell").otherwise("hold").alias("action"), (i % 2 == 0).alias("fb"))


@query("sentiment_tone", "date:d ticker:s tone:s", "SELECT date, ticker, CASE WHEN pos > neg THEN 'bullish' WHEN neg > pos THEN 'bearish' ELSE 'neutral' END AS tone FROM toned")
def _(t):
    return toned(t).withColumn("tone", X.tone(F.col("pos"), F.col("neg")))


def _best(pat):
    hit = f"list_filter(f, lambda x: regexp_matches(x, '{pat}'))"
    return f"array_to_string((CASE WHEN len({hit}) > 0 THEN {hit} ELSE f END)[1:3], ' | ')"


@query("factor_narrative", "date:d ticker:s reasoning:s", f"""
SELECT date, ticker, CASE lower(action) WHEN 'buy' THEN concat('BUY ', ticker, ': ', {_best("positive|strong|material")}, '. ', CASE WHEN fb THEN 'Model applied fallback blending for risk mitigation. ' ELSE '' END, format('Expected 20D alpha: {{:+.2f}}%.', pred))
 WHEN 'sell' THEN concat('SELL/AVOID ', ticker, ': ', {_best("weak|negative|caution")}, '. ', CASE WHEN fb THEN 'Model applied fallback blending. ' ELSE '' END, format('Expected 20D alpha: {{:+.2f}}%.', pred))
 ELSE concat('HOLD ', ticker, ': ', array_to_string(f[1:2], ' | '), '. Mixed signal - awaiting clarity.') END AS reasoning FROM (
 SELECT *, list_filter([CASE WHEN recent > 5 THEN format('strong 20D momentum (+{{:.1f}}%)', recent) WHEN recent > 2 THEN format('positive momentum (+{{:.1f}}%)', recent) WHEN recent < -5 THEN format('weak momentum ({{:.1f}}%)', recent) ELSE format('neutral momentum ({{:.1f}}%)', recent) END,
  CASE WHEN abs(pred) > 10 THEN format('significant predicted alpha ({{:+.1f}}%)', pred) WHEN abs(pred) > 3 THEN format('material prediction ({{:+.1f}}%)', pred) END,
  CASE WHEN pos > 0.6 AND neg < 0.2 THEN 'strong positive sentiment' WHEN pos > 0.4 THEN 'positive sentiment bias' WHEN neg > 0.6 THEN 'strong negative sentiment' WHEN neg > 0.4 THEN 'negative sentiment bias' ELSE 'mixed sentiment' END,
  CASE WHEN mpos > mneg THEN 'favorable broad market sentiment' ELSE 'cautious broad market sentiment' END,
  CASE WHEN score > 0.05 THEN format('strong relative ranking ({{:.3f}})', score) WHEN score > -0.05 THEN 'neutral ranking' ELSE format('weak relative ranking ({{:.3f}})', score) END], lambda x: x IS NOT NULL) AS f FROM toned)""")
def _(t):
    c = F.col
    return toned(t).withColumn("reasoning", R.factor_narrative(
        c("action"), c("ticker"), c("pred"), c("recent"), c("score"), c("pos"), c("neg"), c("mpos"), c("mneg"), c("fb")))
