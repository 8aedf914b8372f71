"""Filters, projections and schema alignment.

All predicates are plain Catalyst expressions, so they reach the Parquet scan
when the input is a file relation. A key list is joined without a hint: Catalyst
broadcasts it when its measured size allows and shuffles it otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelweave.functions import dates, numeric as N, text as X

# Share-class symbols kept although they look like foreign suffixes.
PROTECTED_SYMBOLS = ("BRK-A", "BRK-B", "BF-A", "BF-B")
# Patterns of symbols that are not listed equities.
NON_EQUITY = r"(?i)(?:-USD$|-[A-Z]{2}$|^[0-9])"
# Price columns in order of preference, for features and for trades.
FEATURE_CLOSE = ("adj close", "adj_close", "Close", "close")
FEATURE_OPEN = ("adj open", "adj_open", "Open", "open")
TRADE_CLOSE = ("Close", "close", "adj close", "adj_close")
TRADE_OPEN = ("Open", "open", "adj open", "adj_open")


def filter_universe(df: DataFrame, universe: DataFrame, key: str = "ticker", replace_dot: bool = True) -> DataFrame:
    """Keep rows whose normalised key is in the universe.

    Both sides are trimmed and upper-cased; `replace_dot` also maps '.' to '-'
    on both. Without it (variant) 'BRK.B' does not match a 'BRK-B' file.
    """
    def norm(c):
        return X.normalize_ticker(c) if replace_dot else F.upper(F.trim(c))

    allowed = universe.select(norm(F.col(key)).alias("_u")).distinct()
    return df.join(allowed, norm(F.col(key)) == F.col("_u"), "left_semi")


def flag_non_equity(df: DataFrame, key: str = "ticker") -> DataFrame:
    """Add `protected` and `impure` flags per row."""
    u = F.upper(F.col(key))
    keep = u.isin(*PROTECTED_SYMBOLS)
    return df.withColumn("protected", keep).withColumn("impure", ~keep & u.rlike(NON_EQUITY))


def drop_non_equity(df: DataFrame, key: str = "ticker") -> DataFrame:
    return flag_non_equity(df, key).where(~F.col("impure")).drop("protected", "impure")


def non_equity_counts(df: DataFrame, key: str = "ticker") -> DataFrame:
    """One row: kept, deleted and protected counts."""
    return flag_non_equity(df, key).agg(
        F.count_if(~F.col("impure")).alias("kept"), F.count_if("impure").alias("deleted"),
        F.count_if("protected").alias("protected"))


def coerce(df: DataFrame, cols: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """Cast to double, non-numbers to NULL; drop rows lacking a required value."""
    out = df.withColumns({c: N.to_double(F.col(c).cast("string")) if dict(df.dtypes)[c] == "string"
                          else N.to_double(F.col(c)) for c in cols})
    return out.dropna(subset=list(required)) if required else out


def between_dates(df: DataFrame, start: str | None, end: str | None, closed: bool = False,
                  date: str = "date") -> DataFrame:
    """[start, end) by default, [start, end] when `closed`."""
    d, out = F.col(date), df
    if start is not None:
        out = out.where(d >= F.lit(start).cast("date"))
    if end is not None:
        hi = F.lit(end).cast("date")
        out = out.where(d <= hi if closed else d < hi)
    return out


def select_signals(df: DataFrame, min_pred: float, min_score: float | None = None,
                   pred: str = "pred_return_pct", score: str = "rank_score") -> DataFrame:
    """pred >= min_pred and, when given, score >= min_score; NaN and NULL never pass."""
    cond = N.finite(F.col(pred)) >= min_pred
    if min_score is not None:
        cond = cond & (N.finite(F.col(score)) >= min_score)
    return df.where(cond)


def liquidity_gate(df: DataFrame, min_volume: float = 750_000, min_price: float = 5.0, rows: int = 20,
                   key: str = "ticker", date: str = "date") -> DataFrame:
    """Trailing gate: means over the `rows` rows before each row; not applied while fewer exist."""
    w = W.partitionBy(key).orderBy(date)
    prior = w.rowsBetween(-rows, -1)
    return (
        df.withColumns({"_n": F.row_number().over(w) - 1, "_v": F.avg("volume").over(prior),
                        "_p": F.avg("close").over(prior)})
        .where((F.col("_n") < rows) | ((F.col("_v") >= min_volume) & (F.col("_p") >= min_price)))
        .drop("_n", "_v", "_p")
    )


def turnover_floor(df: DataFrame, floor: float = 5_000_000, col: str = "dollar_turnover") -> DataFrame:
    return df.where(F.coalesce(N.finite(F.col(col)), F.lit(0.0)) >= floor)


def cascade_filter(df: DataFrame, levels: Sequence[Column]) -> DataFrame:
    """Rows of the first level that selects anything in the whole table.

    Levels run from strict to loose and must be nested. Each row gets the number
    of the first level it meets; rows at the smallest number present are kept.
    That number is a scalar subquery, so no join is planned. Empty when no level
    matches.
    """
    tier = F.lit(None).cast("int")
    for i, cond in reversed(list(enumerate(levels, 1))):
        tier = F.when(N.is_true(cond), F.lit(i)).otherwise(tier)
    tagged = df.withColumn("tier", tier).where(F.col("tier").isNotNull())
    best = tagged.agg(F.min("tier")).scalar()
    return tagged.where(F.col("tier") == best)


def latest_snapshot(df: DataFrame, date: str = "date") -> DataFrame:
    """Rows of the latest day."""
    day = F.to_date(F.col(date))
    return df.where(day == df.agg(F.max(day)).scalar())


def min_rows(df: DataFrame, n: int, key: str = "ticker") -> DataFrame:
    """Drop keys with fewer than n rows. Counts are pre-aggregated, so a hot key costs no window."""
    enough = df.groupBy(key).count().where(F.col("count") >= n).select(key)
    return df.join(enough, key, "left_semi")


def align(df: DataFrame, schema: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Project to a frozen ordered column list; absent columns and non-finite values become 0.0."""
    have = set(df.columns)
    cols = [F.coalesce(N.finite(F.col(f"`{c}`").cast("double")), F.lit(0.0)).alias(c) if c in have
            else F.lit(0.0).alias(c) for c in schema]
    return df.select(*keep, *cols)


def freeze_schema(columns: Sequence[str], required: str = "spy_close", at_least: int = 33) -> list[str] | None:
    """The ordered list when it qualifies as a frozen schema, else None."""
    cols = list(columns)
    return cols if required in cols and len(cols) >= at_least else None


def with_adj_open(df: DataFrame, open_: str = "open", close: str = "close", adj_close: str = "adj_close") -> DataFrame:
    """adj_open = open / close * adj_close; NULL when close is 0."""
    return df.withColumn("adj_open", N.ratio(F.col(open_), F.col(close)) * F.col(adj_close))


def pick_first(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    return next((c for c in candidates if c in columns), None)


def pick_price(df: DataFrame, for_trades: bool = False) -> DataFrame:
    """Add price_close / price_open from the first columns available; open falls back to close."""
    close = pick_first(df.columns, TRADE_CLOSE if for_trades else FEATURE_CLOSE)
    if close is None:
        raise ValueError("no close column")
    open_ = pick_first(df.columns, TRADE_OPEN if for_trades else FEATURE_OPEN) or close
    return df.withColumns({"price_close": F.col(f"`{close}`"), "price_open": F.col(f"`{open_}`")})


def backfill_turnover(df: DataFrame, turnover: str = "dollar_turnover", price: str = "current_price",
                      volume: str = "current_volume") -> DataFrame:
    """Missing turnover becomes price times volume."""
    t = N.finite(F.col(turnover).cast("double"))
    return df.withColumn(turnover, F.coalesce(t, F.col(price).cast("double") * F.col(volume).cast("double")))


def normalize_target(df: DataFrame, mean: float | Column, std: float | Column, label: str = "label",
                     bound: float = 50.0) -> DataFrame:
    """(clip(label, -bound, bound) - mean) / std."""
    m, s = (x if isinstance(x, Column) else F.lit(float(x)) for x in (mean, std))
    return df.withColumn("target", N.ratio(N.clip(F.col(label), -bound, bound) - m, s))


SCREEN_FIELDS = {
    "date": "date", "ticker": "string", "current_price": "double", "current_volume": "double",
    "dollar_turnover": "double", "recent_return_pct": "double", "sent_pos": "double", "sent_neg": "double",
    "news_corpus": "string", "news_corpus_len": "bigint",
}


def screening_pool(df: DataFrame, min_turnover: float, top_n: int) -> DataFrame:
    """Non-model fields of the `top_n` most traded names, one row per ticker; all names for 0.

    Absent fields are filled by defaults. The turnover floor is dropped when no
    row reaches it. A name's best row is chosen before names are counted, so a name with many rows takes one place;
    Spark keeps one row per name and task before that shuffle.
    """
    blank = {"news_corpus": F.lit(""), "news_corpus_len": F.lit(0).cast("bigint")}
    pool = df.withColumns({c: blank.get(c, F.lit(None).cast(t)) for c, t in SCREEN_FIELDS.items() if c not in df.columns})
    pool = pool.withColumn("ticker", X.normalize_ticker(F.coalesce(F.col("ticker"), F.lit("")))).where("ticker <> ''")
    pool = backfill_turnover(pool)
    if min_turnover > 0:
        pool = cascade_filter(pool, [F.col("dollar_turnover") >= min_turnover, F.lit(True)]).drop("tier")
    order = [F.col("dollar_turnover").desc_nulls_last(), F.col("news_corpus_len").desc_nulls_last(),
             F.col("ticker").asc(), F.col("date").asc_nulls_last()]
    best = F.row_number().over(W.partitionBy("ticker").orderBy(*order))
    pool = pool.select(*SCREEN_FIELDS).withColumn("_r", best).where("_r = 1").drop("_r")
    return pool.orderBy(*order).limit(top_n) if top_n > 0 else pool


def position_age(df: DataFrame, asof: Column, entry_date: str = "entry_date", entry_price: str = "entry_price",
                 price: str = "current_price") -> DataFrame:
    """Days held as of a day and price change in percent; NULL unless the entry price is positive."""
    e = F.col(entry_price)
    return df.withColumns({
        "days_held": F.datediff(asof, F.col(entry_date)),
        "price_change_pct": F.when(e > 0, (F.col(price) - e) / e * 100)})


def shift_business_days(df: DataFrame, n: int, date: str = "date") -> DataFrame:
    """Delay the signal date by n weekdays and keep the original."""
    return df.withColumn("original_signal_date", F.col(date)).withColumn(date, dates.add_business_days(F.col(date), n))
