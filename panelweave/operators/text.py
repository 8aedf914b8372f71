"""News and response text operators. Texts are processed whole, in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelweave.functions import dates, text as X
from panelweave.operators.ordering import top_n_per_group
from panelweave.operators.symbols import dictionary_hits, entity_scan  # noqa: F401

MARKET_TICKER = "^GSPC"


def sanitize_articles(df: DataFrame, cols: Sequence[str] = ("title", "content")) -> DataFrame:
    return df.withColumns({c: X.sanitize(F.col(c)) for c in cols})


def resolve_tickers(listed: Column, extra: Column, hits: Column | None = None, market: str = MARKET_TICKER) -> Column:
    """Ticker array of a raw row: the listed ones, else those in the JSON extra, else text hits, else the market.

    A listed text that is present but holds no name blocks the fallbacks and
    yields an empty array, as in the original. The JSON is read as a variant: `stocks` may be a list or one name, other
    fields may have any shape, and text that is no JSON is passed over.
    """
    js = F.try_parse_json(extra)
    some = lambda a: F.when(F.size(a) > 0, a)
    one = lambda f: F.when(F.schema_of_variant(F.try_variant_get(js, f"$.{f}", "variant")) == "STRING", F.try_variant_get(js, f"$.{f}", "string"))
    names = lambda f: F.coalesce(some(F.try_variant_get(js, f"$.{f}", "array<string>")), F.when(one(f) != "", F.array(one(f))))
    options = [F.when(F.coalesce(listed, F.lit("")) != "", X.list_literal(listed)), names("stocks"), names("tickers")]
    if hits is not None:
        options.append(some(hits))
    raw = F.coalesce(*options, F.array(F.lit(market)))
    ok = F.filter(raw, lambda t: t.isNotNull() & (t != ""))
    return F.array_distinct(F.transform(ok, lambda t: F.translate(F.upper(t), ".", "-")))


def explode_tickers(df: DataFrame, listed: str = "ticker", extra: str = "extra", hits: Column | None = None,
                    universe: DataFrame | None = None, market: str = MARKET_TICKER, macro: str | None = None) -> DataFrame:
    """One row per article and ticker; optionally only tickers of the universe or the market.

    Names of more than ten characters are kept and marked in `long_name`, so a caller may drop them. Articles
    that the column `macro` marks get the market's row too, unless they have it.
    """
    names = resolve_tickers(F.col(listed), F.col(extra), hits, market)
    if macro is not None:
        names = F.when(F.col(macro), F.array_union(names, F.array(F.lit(market)))).otherwise(names)
    out = df.withColumn("_all", names)
    out = out.withColumn("ticker", F.explode("_all")).drop("_all").withColumn("long_name", F.length("ticker") > 10)
    if universe is not None:
        allowed = universe.select(X.normalize_ticker(F.col("ticker")).alias("_u")).union(
            df.sparkSession.range(1).select(F.lit(market))).distinct()
        out = out.join(allowed, F.col("ticker") == F.col("_u"), "left_semi")
    return out


def flag_macro(df: DataFrame, text: str = "content", phrases: Sequence[str] = X.MARKET_PHRASES, title: str | None = None) -> DataFrame:
    """is_macro: whether the lower-cased title and text hold one of the phrases."""
    body = F.col(text) if title is None else F.concat_ws(" ", F.col(title), F.col(text))
    return df.withColumn("is_macro", X.any_contains(F.lower(body), phrases))


def dedupe_articles(df: DataFrame, keys: Sequence[str] = ("ticker",), doc_id: str = "doc_id", date: str = "date",
                    title: str = "title", content: str = "content") -> DataFrame:
    """First article (smallest id) per key and content hash.

    Copies are folded to their smallest id by partial aggregation; only ids are
    shuffled for that, and the texts are then picked by a semi join on the id,
    which is unique per key. A hash copied into a third of all rows is no burden.
    """
    h = X.article_hash(F.col(date).cast("string"), F.col(title), F.col(content))
    keep = df.groupBy(*keys, h.alias("_h")).agg(F.min(doc_id).alias(doc_id)).select(*keys, doc_id)
    return df.join(keep, [*keys, doc_id], "left_semi")


def era_filter(df: DataFrame, date_text: str, start_year: int = 2015) -> DataFrame:
    """Drop rows with a known year before the start; unknown years stay."""
    y = dates.loose_year(F.col(date_text))
    return df.where((y == 0) | (y >= start_year))


def compose_text(df: DataFrame, title: str | None, body: str | None, date: str) -> DataFrame:
    """processed_date and processed_text; rows without a date are dropped."""
    t = X.compose(F.col(title) if title else None, F.col(body) if body else None)
    return df.withColumns({"processed_date": dates.utc_day(F.col(date).cast("string")), "processed_text": t}).where(
        "processed_date IS NOT NULL")


def stratified_sample(df: DataFrame, fraction: float, doc_id: str = "doc_id", date: str = "date", before: str = "2016-01-01",
                      seed: int = 42) -> DataFrame:
    """Early rows whose id hashes below the fraction (in steps of 1/65536): the same share of every key, at any size."""
    head = F.substring(F.md5(F.concat_ws(":", F.col(doc_id).cast("string"), F.lit(str(seed)))), 1, 4)
    part = F.lit(f"{min(max(round(fraction * 65536), 0), 65536):04x}") if fraction < 1 else F.lit("g")
    return df.where((F.col(date) < F.lit(before).cast("date")) & (head < part))


def text_sizes(df: DataFrame, key: str = "ticker", text: str = "content") -> DataFrame:
    """Bytes of text and rows of each key, to plan memory before texts are grouped; nothing is dropped."""
    return df.groupBy(key).agg(F.sum(F.octet_length(text)).alias("n_bytes"), F.count("*").alias("n_rows"))


def corpus(df: DataFrame, key: str = "ticker", text: str = "text", order: Sequence[Column] = (), *, items: int) -> DataFrame:
    """Freshest items of each key joined by ' | '.

    Items with fewer than five informative characters are dropped and repeats
    removed, keeping the first. The list is bounded by `items`.
    """
    top = top_n_per_group(df, items, key, order)
    w = W.partitionBy(key).orderBy(*order)
    p = X.strip(F.coalesce(F.col(text), F.lit("")))
    info = p
    for prefix in X.SOURCE_PREFIXES:
        info = F.replace(info, F.lit(prefix), F.lit(""))
    info = X.strip(F.translate(info, "-|", ""))
    top = top.withColumns({"_i": F.row_number().over(w), "_p": p, "_ok": F.length(info) >= 5})
    # keys whose items are all dropped keep an empty corpus
    packed = F.array_sort(F.collect_list(F.when(F.col("_ok"), F.struct("_i", "_p"))))
    return top.groupBy(key).agg(F.array_join(F.array_distinct(F.transform(packed, lambda s: s["_p"])), " | ").alias("corpus"))


def html_headlines(pages: DataFrame, page_id: str = "page_id", html: str = "html", limit: int | None = None) -> DataFrame:
    """Title-like strings of raw pages: heading elements, else "title" values of embedded JSON.

    Tags are stripped, texts longer than 10 characters kept, repeats dropped,
    all (or the first `limit`) returned as rows (page, pos, headline).
    """
    marks = F.regexp_extract_all(html, F.lit(r"(?is)<(?:title|h[1-4])(?:\s[^>]*)?>(.*?)</(?:title|h[1-4])>"), F.lit(1))
    heads = F.filter(F.transform(marks, X.strip_tags), lambda t: F.length(t) > 10)
    js = F.regexp_extract_all(html, F.lit(r'"(?:title|newsTitle)"\s*:\s*"([^"\\]{12,}.*?)"'), F.lit(1))
    best = F.array_distinct(F.when(F.size(heads) > 0, heads).otherwise(F.transform(js, lambda t: F.trim(t))))
    if limit is not None:
        best = F.slice(best, 1, limit)
    return pages.select(page_id, F.posexplode(best).alias("pos", "headline"))


def extract_sections(df: DataFrame, text: str = "text", names: Sequence[str] = X.SECTIONS) -> DataFrame:
    """One column per named section of a structured answer, '' when absent."""
    return df.withColumns({n.lower().replace(" ", "_"): X.section(F.col(text), n) for n in names})
