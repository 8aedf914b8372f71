"""As-of, path, lookup and calendar joins.

As-of joins are a union of both sides and an ignore-nulls window, never a
range condition. The left side enters as distinct (key, time) pairs, so many
left rows on one key do not enlarge the window group; they are reattached by an
equi join that adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from panelweave.functions import numeric as N
from panelweave.operators import windows as X


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, payload: Sequence[str],
         direction: str = "backward", allow_exact: bool = True, unique_left: bool = False) -> DataFrame:
    """Attach the payload of the last row at or before (backward) or first at or after (forward) each time.

    `right` holds one row per (by, time). Left rows without a match get NULLs.
    Without `by` the times must be calendar days, since one window sees them all.
    `unique_left` says that (by, time) is unique on the left as well: its rows
    then pass through the window themselves and the left side is read only once.
    """
    keys = list(by)
    cols = left.columns
    data = F.struct(*[F.col(c) for c in payload])
    row = F.struct(*[F.col(c) for c in cols]) if unique_left else F.struct(F.lit(1).alias("_one"))
    ask = left.select(*keys, F.col(left_on).alias("_t"), F.lit(True).alias("_ask"), row.alias("_row"))
    ask = ask if unique_left else ask.distinct()
    ask = ask.withColumn("_data", F.lit(None).cast(right.select(data.alias("d")).schema["d"].dataType))
    have = right.select(*keys, F.col(right_on).alias("_t"), F.lit(False).alias("_ask"),
                        F.lit(None).cast(ask.schema["_row"].dataType).alias("_row"), data.alias("_data"))
    time = F.col("_t").desc() if direction == "forward" else F.col("_t").asc()
    # False sorts before True: matching rows come first when an equal time counts
    side = F.col("_ask").asc() if allow_exact else F.col("_ask").desc()
    w = W.partitionBy(*keys).orderBy(time, side).rowsBetween(W.unboundedPreceding, 0)
    found = ask.unionByName(have).withColumn("_data", F.last("_data", ignorenulls=True).over(w)).where("_ask")
    extra = [F.col(f"_data.{c}").alias(c) for c in payload]
    if unique_left:
        return found.select(*[F.col(f"_row.{c}").alias(c) for c in cols], *extra)
    found = found.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_t", *extra)
    cond = F.col(left_on) == F.col("_t")
    for k in keys:
        cond = cond & (left[k] == F.col(f"_k_{k}"))
    return left.join(found, cond, "left").drop("_t", *[f"_k_{k}" for k in keys])


def align_market(bars: DataFrame, market: DataFrame, date: str = "date") -> DataFrame:
    """Market values of the same or last earlier day; rows with any missing value are dropped."""
    cols = [c for c in market.columns if c != date]
    days = bars.select(date).distinct()
    known = asof(days, market, [], date, date, cols, unique_left=True)
    return bars.join(known, date).dropna()


def join_market_ffill(bars: DataFrame, market: DataFrame, key: str = "ticker", date: str = "date") -> DataFrame:
    """Left join on the day, then forward fill every column per key."""
    merged = bars.join(market, date, "left")
    return X.forward_fill(merged, [c for c in merged.columns if c not in (key, date)], key, date)


def join_news_vectors(bars: DataFrame, vectors: DataFrame | None, dims: Sequence[str], alpha: float = 0.3,
                      key: str = "ticker", date: str = "date") -> DataFrame:
    """Forward-filled prices with the lagged smoothed vectors of the key; missing values become 0.

    `vectors` holds one row per (key, date). Vectors outside the price dates of
    their key are dropped. Without vectors all dimensions are 0.
    """
    if vectors is None:
        return bars.withColumns({d: F.lit(0.0) for d in dims})
    bounds = bars.groupBy(key).agg(F.min(date).alias("first"), F.max(date).alias("last"))
    with_news = bounds.join(vectors.select(key).distinct(), key, "left_semi")
    y = X.smoothed_events(bars.select(key, date).join(with_news.select(key), key, "left_semi"), vectors, dims,
                          with_news, alpha, 1, key, date)
    prices = X.forward_fill(bars, [c for c in bars.columns if c not in (key, date)], key, date)
    out = prices.join(y, [key, date], "left")
    nums = [c for c, t in out.dtypes if t in ("double", "float", "bigint", "int")]
    return out.fillna(0, subset=nums)


def outer_macro_merge(frames: Sequence[DataFrame], date: str = "date") -> DataFrame:
    """Full outer join of day tables, then forward fill only; leading gaps stay NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, date, "full")
    return X.forward_fill(out, [c for c in out.columns if c != date], None, date)


def entry_forward(signals: DataFrame, bars: DataFrame, payload: Sequence[str] = ("entry_date", "rn", "n_rows"),
                  key: str = "ticker", date: str = "date") -> DataFrame:
    """First price row on or after the signal date; signals without one are dropped.

    Signals are unique per (key, date); extra copies would each be kept.
    """
    pos = bars if "rn" in bars.columns else X.positions(bars, key, date)
    pos = pos.withColumn("entry_date", F.col(date))
    return asof(signals, pos, [key], date, date, list(payload), "forward", unique_left=True).where(F.col("entry_date").isNotNull())


def entry_nearest(buys: DataFrame, bars: DataFrame, date: str = "buy_date", price: str = "buy_price",
                  key: str = "ticker") -> DataFrame:
    """Entry date and price: a positive given price wins, else first close on or after, else last before.

    Rows without any price are dropped.
    """
    c = bars.select(key, F.col("date").alias("_d"), F.col("close").alias("_c"))
    nxt = c.select(key, "_d", F.col("_d").alias("_fd"), F.col("_c").alias("_fc"))
    prv = c.select(key, "_d", F.col("_d").alias("_bd"), F.col("_c").alias("_bc"))
    out = asof(buys, nxt, [key], date, "_d", ["_fd", "_fc"], "forward")
    out = asof(out, prv, [key], date, "_d", ["_bd", "_bc"], "backward", allow_exact=False)
    given = N.positive(F.col(price))
    out = out.withColumns({
        "entry_date": F.when(given.isNotNull(), F.col(date)).otherwise(F.coalesce("_fd", "_bd")),
        "entry_price": F.coalesce(given, F.when(F.col("_fd").isNotNull(), F.col("_fc")).otherwise(F.col("_bc")))})
    return out.where(F.col("entry_price").isNotNull()).drop("_fd", "_fc", "_bd", "_bc")


def trade_path(trades: DataFrame, bars: DataFrame, hold: int, key: str = "ticker") -> DataFrame:
    """The `hold` consecutive price rows from the entry, with step i = 0 .. hold-1.

    Trades carry `rn` and `n_rows` of their entry row; those without a full path
    are dropped before the explode. The join is an equi join on (key, rn).
    """
    steps = (trades.where(F.col("rn") + hold - 1 <= F.col("n_rows"))
             .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(hold - 1))))
             .withColumn("_at", F.col("rn") + F.col("i")).drop("rn", "n_rows"))
    rows = bars.select(F.col(key).alias("_k"), F.col("rn").alias("_rn"), F.col("date").alias("day"),
                       "open", "high", "low", "close")
    return steps.join(rows, (F.col(key) == F.col("_k")) & (F.col("_at") == F.col("_rn"))).drop("_k", "_rn", "_at")


def inner_tracked(predictions: DataFrame, tracked: DataFrame, keys: Sequence[str] = ("date", "ticker")) -> DataFrame:
    return predictions.join(tracked.select(*keys), list(keys))


def enrich(df: DataFrame, extra: DataFrame, key: str = "ticker") -> DataFrame:
    """Left join of one row per key; Catalyst broadcasts the smaller table when its size allows."""
    return df.join(extra, key, "left")


def mean_prediction(signals: DataFrame) -> DataFrame:
    return signals.groupBy("date", "ticker").agg(F.avg(N.finite(F.col("pred_return_pct"))).alias("mean_pred"))


def lookup_prediction(path: DataFrame, signals: DataFrame, day: str = "day", key: str = "ticker") -> DataFrame:
    """Mean prediction made on each path day for the same key; NULL when there is none."""
    p = mean_prediction(signals).select(F.col("date").alias("_d"), F.col("ticker").alias("_k"), F.col("mean_pred").alias("day_pred"))
    return path.join(p, (F.col(day) == F.col("_d")) & (F.col(key) == F.col("_k")), "left").drop("_d", "_k")


def exclude_days(signals: DataFrame, skip_tickers: Sequence[str] = (), exclude_tickers: Sequence[str] = ()) -> DataFrame:
    """Drop whole days on which any skip ticker appears, and the rows of excluded tickers."""
    u = F.upper("ticker")
    out = signals
    if skip_tickers:
        days = signals.where(u.isin([x.upper() for x in skip_tickers])).select("date").distinct()
        out = out.join(days, "date", "left_anti")
    if exclude_tickers:
        out = out.where(~u.isin([x.upper() for x in exclude_tickers]))
    return out


def on_calendar(df: DataFrame, calendar: DataFrame, day: str = "day") -> DataFrame:
    """Rows whose day is on the calendar."""
    return df.join(calendar.select(F.col("date").alias("_c")).distinct(), F.col(day) == F.col("_c"), "left_semi")


def pair_align(bars: DataFrame, market: DataFrame, close: str = "close", mclose: str = "spy_close") -> DataFrame:
    """Closes of stock and benchmark on shared days, with the benchmark's day number."""
    m = market.where(F.col(mclose).isNotNull()).select("date", mclose)
    m = m.withColumn("mpos", F.row_number().over(W.partitionBy().orderBy("date")))
    return bars.where(F.col(close).isNotNull()).join(m, "date")


def attach_market_vector(df: DataFrame, vectors: DataFrame, market_key: str, key: str = "ticker", date: str = "date",
                         prefix: str = "market_") -> DataFrame:
    """Every row gets the vector of the market key on its day; missing becomes 0."""
    dims = [c for c in vectors.columns if c not in (key, date)]
    m = vectors.where(F.col(key) == market_key).select(date, *[F.col(c).alias(prefix + c) for c in dims])
    return df.join(m, date, "left").fillna(0.0, subset=[prefix + c for c in dims])
