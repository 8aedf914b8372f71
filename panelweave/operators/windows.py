"""Window operators over panels with one row per (key, date).

Frames share one partitioning and ordering, so a chain of them costs one
shuffle and one sort. Because (key, date) is unique, a key group is bounded by
the calendar. Windows without a key run only on one-row-per-day tables.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from panelweave.functions import numeric as N
from panelweave.operators.ewma import Ewma, GapEwma, add_ewma, add_ewma_present  # noqa: F401
from panelweave.operators.frames import add_frame_moments, array_moments, finite_sql

#: Windows laid out at a time.
SEQUENCES = 256
#: Blocks of a frame's length that are summed at a time.
BLOCKS = 256

# Name fragments that choose the transform of a feature column.
PCT_WORDS = ("close", "open", "high", "low", "cpi", "m2", "volume")
DIFF_WORDS = ("fed", "vix", "rsi", "macd")


def by(key: str = "ticker", date: str = "date"):
    return W.partitionBy(key).orderBy(date)


def clean_change(raw: Column, bound: float | None) -> Column:
    c = F.coalesce(N.finite(raw), F.lit(0.0))
    return c if bound is None else N.clip(c, -bound, bound)


def _from_previous(df: DataFrame, cols: Sequence[str], fn: Callable[[Column, Column], Column], key: str, date: str) -> DataFrame:
    """fn(x, previous x) in place. The previous value is a column of its own: inside `fn` each mention of it would be one more window function."""
    w = by(key, date)
    d = df.withColumns({f"_before_{c}": F.lag(c).over(w) for c in cols})
    return d.withColumns({c: fn(F.col(c), F.col(f"_before_{c}")) for c in cols}).drop(*[f"_before_{c}" for c in cols])


def pct_change(df: DataFrame, cols: Sequence[str], bound: float | None = None, key="ticker", date="date") -> DataFrame:
    """x / previous x - 1 in place; first row, zero base and non-finite results become 0."""
    return _from_previous(df, cols, lambda c, before: clean_change(N.change(c, before), bound), key, date)


def diff(df: DataFrame, cols: Sequence[str], bound: float | None = None, key="ticker", date="date") -> DataFrame:
    """x - previous x in place, same clean-up as :func:`pct_change`."""
    return _from_previous(df, cols, lambda c, before: clean_change(c - before, bound), key, date)


def route_features(cols: Sequence[str]) -> tuple[list[str], list[str]]:
    """Columns to turn into relative changes and into differences, by name fragments."""
    has = lambda c, words: any(x in c.lower() for x in words)
    return [c for c in cols if has(c, PCT_WORDS)], [c for c in cols if has(c, DIFF_WORDS)]


def feature_transform(df: DataFrame, cols: Sequence[str], bound: float | None = None, key="ticker", date="date") -> DataFrame:
    """Relative changes first, then differences.

    A name such as vix_close matches both lists and gets both, one after the
    other; that is the behaviour to reproduce, not an oversight here.
    """
    pct, dif = route_features(cols)
    out = pct_change(df, pct, bound, key, date) if pct else df
    return diff(out, dif, bound, key, date) if dif else out


def rsi(df: DataFrame, n: int = 14, close: str = "close", key="ticker", date="date", out: str = "rsi_14") -> DataFrame:
    """Relative strength index with Wilder smoothing; too few changes and loss-free series give 50.

    A missing close leaves no change at its row and the next; both repeat the last smoothed values.
    """
    at = f"OVER (PARTITION BY {key} ORDER BY {date})"
    price = finite_sql(close)
    d = df.selectExpr("*", f"row_number() {at} - 1 AS _pos", f"({price}) - lag({price}) {at} AS _d")
    d = add_ewma_present(d, {"_g": GapEwma("_d * CAST(_d > 0 AS INT)", 1.0 / n, n), "_l": GapEwma("-_d * CAST(_d < 0 AS INT)", 1.0 / n, n)}, key)
    rs = N.ratio(F.col("_g"), F.col("_l"))
    return d.withColumn(out, F.coalesce(100.0 - 100.0 / (1.0 + rs), F.lit(50.0))).drop("_pos", "_d", "_g", "_l")


def macd(df: DataFrame, close: str = "close", key="ticker", date="date", fast=12, slow=26, signal=9) -> DataFrame:
    """Add macd_line, macd_hist and macd_signal; 0 before enough prices are present. Rows without a price repeat the averages."""
    at = f"OVER (PARTITION BY {key} ORDER BY {date})"
    d = add_ewma_present(df.selectExpr("*", f"row_number() {at} - 1 AS _pos", f"{finite_sql(close)} AS _x"), {
        "_f": GapEwma("_x", 2.0 / (fast + 1), fast), "_s": GapEwma("_x", 2.0 / (slow + 1), slow)}, key)
    d = d.withColumn("_m", F.col("_f") - F.col("_s"))
    d = add_ewma_present(d, {"_sig": GapEwma("_m", 2.0 / (signal + 1), signal)}, key)
    zero = F.lit(0.0)
    return d.withColumns({
        "macd_line": F.coalesce("_m", zero), "macd_hist": F.coalesce(F.col("_m") - F.col("_sig"), zero),
        "macd_signal": F.coalesce("_sig", zero)}).drop("_pos", "_x", "_f", "_s", "_m", "_sig")


def calendar_days(df: DataFrame, key="ticker", date="date") -> DataFrame:
    """Every calendar day between the first and last date of each key."""
    span = df.groupBy(key).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    return span.select(key, F.explode(F.sequence("_a", "_b")).alias(date))


def smoothed_events(points: DataFrame, events: DataFrame, values: Sequence[str], bounds: DataFrame,
                    alpha: float = 0.3, lag_days: int = 1, key="ticker", date="date") -> DataFrame:
    """Daily-calendar EWMA of sparse events, read `lag_days` before each point.

    Days without an event count as 0, the first day of `bounds` (key, first,
    last) has full weight, and events outside the bounds are dropped. The dense
    calendar is never built: gaps are handled by position. Points on the first
    day see NULL, as nothing lies before them.
    """
    day0 = bounds.selectExpr(key, "first AS _a", "last AS _b")
    vals = list(values)
    ev = (events.join(day0, key).where(f"{date} BETWEEN _a AND _b")
          .selectExpr(key, f"datediff({date}, _a) AS _pos", *vals, "0 AS _ask"))
    ask = points.join(day0, key).selectExpr(key, f"datediff({date}, _a) - {lag_days} AS _pos", *[f"0D AS {v}" for v in vals], "1 AS _ask")
    merged = (ev.unionByName(ask).where("_pos >= 0").groupBy(key, "_pos")
              .agg(*[F.expr(f"sum({v}) AS {v}") for v in vals], F.max("_ask").alias("_ask")))
    smooth = add_ewma(merged, {f"_y_{i}": Ewma(v, alpha) for i, v in enumerate(vals)}, key)
    return (smooth.where("_ask = 1").join(day0, key)
            .selectExpr(key, f"date_add(_a, CAST(_pos + {lag_days} AS INT)) AS {date}", *[f"_y_{i} AS {v}" for i, v in enumerate(vals)]))


def ewma_calendar(events: DataFrame, values: Sequence[str], bounds: DataFrame, alpha=0.3, key="ticker", date="date") -> DataFrame:
    """The lagged smoothed series on every calendar day of the bounds."""
    days = bounds.select(key, F.explode(F.sequence("first", "last")).alias(date))
    y = smoothed_events(days, events, values, bounds, alpha, 1, key, date)
    return days.join(y, [key, date], "left")


def lag_rows(df: DataFrame, cols: Sequence[str], n: int = 1, key="ticker", date="date") -> DataFrame:
    return df.withColumns({c: F.lag(c, n).over(by(key, date)) for c in cols})


def lag_calendar_day(df: DataFrame, cols: Sequence[str], key="ticker", date="date") -> DataFrame:
    """Values known the calendar day before; NULL unless that very day has a row."""
    w = by(key, date)
    fresh = F.datediff(date, F.lag(date).over(w)) == 1
    return df.withColumns({c: F.when(fresh, F.lag(c).over(w)) for c in cols})


def rolling_beta(df: DataFrame, close: str = "close", market: str = "spy_close", rows: int = 60, key="ticker",
                 date="date", out: str = "beta") -> DataFrame:
    """Sample covariance over variance of daily returns on the last `rows` rows, bounded to [-2, 3].

    Needs `rows` pairs of returns, else 1.0; so does a frame without market moves. A missing price leaves no
    return at its row and the next.
    """
    at = f"OVER (PARTITION BY {key} ORDER BY {date})"
    own = [f"`{c}`" for c in df.columns if c != out]
    prices = {"_px": finite_sql(close), "_pm": finite_sql(market)}
    d = df.selectExpr("*", *[f"try_divide({e}, lag({e}) {at}) - 1 AS {n}" for n, e in prices.items()])
    d = add_frame_moments(d, {}, rows, 0, {"_f": ("_px", "_pm")}, key, date)
    beta = "greatest(-2D, least(3D, _f_c / nullif(_f_m2y, 0D)))"
    return d.selectExpr(*own, f"CASE WHEN _f_n = {rows} AND _f_m2y > 0 THEN coalesce({beta}, 1D) ELSE 1D END AS {out}")


def trailing_mean(df: DataFrame, cols: Sequence[str], rows: int = 20, key="ticker", date="date") -> DataFrame:
    """Mean of the `rows` rows before each row, NULL until all of them exist."""
    f = by(key, date).rowsBetween(-rows, -1)
    return df.withColumns({f"{c}_mean{rows}": F.when(F.count(c).over(f) == rows, F.avg(c).over(f)) for c in cols})


def forward_alpha_label(df: DataFrame, variant: str = "sequence", horizon: int = 20, lookback: int = 60,
                        key="ticker", date="date", open_="open", close="close", mopen="spy_open",
                        mclose="spy_close", beta="beta") -> DataFrame:
    """Label each target row with the beta-adjusted return of the next `horizon` rows, in percent.

    Entry is the open of row t, exit the close of row t+horizon-1, on stock and
    market alike. Rows need `lookback` rows of history.

    ================ ============== ======================= ==================
    variant          beta           non-positive entry      last usable row
    ================ ============== ======================= ==================
    sequence         of row t-1     label 0                 final row unused
    tabular          of row t-1     row dropped             final row unused
    inference        of row t       row dropped             final row used
    ================ ============== ======================= ==================
    """
    _check(variant)
    w = by(key, date)
    live = variant == "inference"
    d = df.withColumns({
        "_rn": F.row_number().over(w), "_xs": F.lead(close, horizon - 1).over(w),
        "_xm": F.lead(mclose, horizon - 1).over(w),
        "_spare": F.lead(F.lit(1), horizon - 1 if live else horizon).over(w),
        "_b": F.col(beta) if live else F.lag(beta).over(w)})
    d = d.where((F.col("_rn") > lookback) & F.col("_spare").isNotNull())
    return _alpha(d, variant, open_, mopen).drop("_rn", "_xs", "_xm", "_spare", "_b")


def _check(variant: str) -> None:
    if variant not in ("sequence", "tabular", "inference"):
        raise ValueError(variant)


def _alpha(d: DataFrame, variant: str, open_: str, mopen: str) -> DataFrame:
    """Label and actual return from the exit prices `_xs` and `_xm` and from `_b`."""
    ok = (F.col(open_) > 0) & (F.col(mopen) > 0)
    stock = N.finite(N.change(F.col("_xs"), F.col(open_)))
    mkt = N.finite(N.change(F.col("_xm"), F.col(mopen)))
    if variant != "sequence":
        d = d.where(ok)
    return d.withColumns({
        "label": F.when(ok, (stock - F.col("_b") * mkt) * 100.0).otherwise(0.0),
        "actual_return_pct": F.when(ok, stock * 100.0)})


def window_stats(df: DataFrame, cols: Sequence[str], rows: int = 60, include_current: bool = False,
                 key="ticker", date="date") -> DataFrame:
    """Last value, mean and population standard deviation of each column over the preceding rows.

    Adds `<c>_last`, `<c>_mean`, `<c>_std`, and `_hist` with the number of rows in the frame. Missing values
    (NULL, NaN, infinite) count in no mean. `include_current` ends the frame at the row itself (live use).
    """
    own = [f"`{c}`" for c in df.columns]
    at = f"OVER (PARTITION BY {key} ORDER BY {date})"
    before = 0 if include_current else 1
    d = add_frame_moments(df, {f"_f{i}": f"`{c}`" for i, c in enumerate(cols)}, rows, before, None, key, date)
    out = []
    for i, c in enumerate(cols):
        out += [f"`{c}` AS {c}_last" if include_current else f"lag(`{c}`) {at} AS {c}_last", f"_f{i}_mean AS {c}_mean",
                f"sqrt(_f{i}_m2 / nullif(_f{i}_n, 0)) AS {c}_std"]
    return d.selectExpr(*own, "_rows AS _hist", *out)


def labelled_stats(df: DataFrame, cols: Sequence[str], rows: int = 60, variant: str = "sequence", horizon: int = 20,
                   key="ticker", date="date", open_="open", close="close", mopen="spy_open", mclose="spy_close") -> DataFrame:
    """Target rows with `label` and `<c>_last`, `<c>_mean`, `<c>_std`: :func:`rolling_beta`, :func:`window_stats` and
    :func:`forward_alpha_label` in one pass over the rows.

    Exit prices and the statistics of the frames are made in Arrow batches, since built-ins sort and copy rows with all running sums
    for them. A task holds the rows of one key and at most BLOCKS blocks of frames.
    """
    _check(variant)
    live = variant == "inference"
    own = [key, date, open_, mopen]
    inputs = {f"_l{i}": c for i, c in enumerate(cols)} | {"_p": close, "_m": mclose}
    d = df.withColumn("_rn", F.row_number().over(by(key, date)))
    d = d.selectExpr(*[f"`{c}`" for c in own], "_rn", *[f"CAST(`{c}` AS DOUBLE) AS {n}" for n, c in inputs.items()])
    width = len(cols)
    out = [f"`{c}_{s}`" for c in cols for s in ("last", "mean", "std")]
    schema = T.StructType([d.schema[c] for c in own] + [T.StructField(n.strip("`"), T.DoubleType()) for n in ("_xs", "_xm", "_b", *out)])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            starts = np.flatnonzero(b.column("_rn").to_numpy() == 1)
            if len(starts):
                held.append(b.slice(0, starts[-1]))
                yield from pieces(held)
                held, b = [], b.slice(starts[-1])
            held.append(b)
        yield from pieces(held)

    def pieces(held):
        """Whole keys, a bounded number of blocks at a time."""
        if not sum(map(len, held)):
            return
        t = pa.Table.from_batches(held).combine_chunks()
        place = t["_rn"].to_numpy() - 1
        starts = np.flatnonzero(place == 0)
        blocks = np.cumsum(place % rows == 0)
        first = 0
        while first < len(starts):
            stop = max(first + 1, int(np.searchsorted(blocks[starts], blocks[starts[first]] + BLOCKS)))
            end = starts[stop] if stop < len(starts) else len(place)
            yield part(t.slice(starts[first], end - starts[first]), place[starts[first] : end])
            first = stop

    def part(t, place):
        x = np.column_stack([t[n].to_numpy() for n in inputs])
        prices, before = np.where(np.isfinite(x[:, width:]), x[:, width:], np.nan), np.arange(len(place)) - 1
        with np.errstate(all="ignore"):
            moves = np.where((place > 0)[:, None] & (prices[before] != 0), prices / prices[before] - 1, np.nan)
        moves[~np.isfinite(moves).all(1)] = np.nan
        n, mean, m2, c = array_moments(place, np.column_stack((x[:, :width], moves)), rows, [(width, width + 1)])
        with np.errstate(all="ignore"):
            spread = m2[:, width + 1]
            raw = c[:, 0] / spread
            beta = np.where((n[:, width] == rows) & ~(spread <= 0), np.where(np.isnan(raw), 3.0, np.clip(raw, -2.0, 3.0)), 1.0)
            std = np.sqrt(m2[:, :width] / n[:, :width])
        starts = np.flatnonzero(place == 0)
        size = np.diff(starts, append=len(place))
        picked = np.flatnonzero((place >= rows) & (place + horizon < np.repeat(size + live, size)))
        prior = picked - 1  # of the same key: a target has `rows` rows before it
        pick, last, exits = pa.array(picked), pa.array(prior), pa.array(picked + horizon - 1)
        none = n[prior, :width] == 0
        arrays = [t[c].combine_chunks().take(pick) for c in own] + [t[c].combine_chunks().take(exits) for c in ("_p", "_m")]
        arrays.append(pa.array(beta[picked if live else prior]))
        for i in range(width):
            arrays += [t[f"_l{i}"].combine_chunks().take(last), pa.array(mean[prior, i], mask=none[:, i]), pa.array(std[prior, i], mask=none[:, i])]
        return pa.RecordBatch.from_arrays(arrays, schema.names)

    return _alpha(d.mapInArrow(run, schema), variant, open_, mopen).drop("_xs", "_xm", "_b")


def window_sequences(df: DataFrame, cols: Sequence[str], rows: int = 60, key="ticker", date="date") -> DataFrame:
    """`seq`: rows x features array of the preceding rows, oldest first; only full windows are kept. Missing values are NaN.

    Rows stream through their task in order of (key, date); only the last `rows` feature rows of the current key are carried
    over the border of a batch, and windows are laid out a few hundred at a time, so memory stays flat.
    """
    width, others = len(cols), list(df.columns)
    own = df.select(*[F.col(f"`{c}`") for c in others], F.array(*[F.col(f"`{c}`").cast("float") for c in cols]).alias("_f"))

    def run(batches):
        held, last = np.zeros((0, width), np.float32), None
        for b in batches:
            feats = b.column("_f").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, width)
            keys = b.column(key).to_pylist()
            start = 0
            while start < len(keys):
                stop = start + next((i for i, k in enumerate(keys[start:]) if k != keys[start]), len(keys) - start)
                if keys[start] != last:
                    held, last = held[:0], keys[start]
                seen = np.concatenate((held, feats[start:stop]))
                skip = max(0, rows - len(held))  # rows of this run without a full window
                for at in range(start + skip, stop, SEQUENCES):
                    n = min(SEQUENCES, stop - at)
                    first = len(held) + at - start - rows
                    part = sliding_window_view(seen[first : first + rows + n - 1], rows, axis=0).transpose(0, 2, 1)
                    inner = pa.ListArray.from_arrays(np.arange(n * rows + 1, dtype=np.int32) * width, pa.array(part.reshape(-1)))
                    seq = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * rows, inner)
                    yield pa.RecordBatch.from_arrays([b.column(c).slice(at, n) for c in others] + [seq], [*others, "seq"])
                held = seen[-rows:]
                start = stop

    schema = T.StructType([*df.schema.fields, T.StructField("seq", T.ArrayType(T.ArrayType(T.FloatType())))])
    return own.repartition(key).sortWithinPartitions(key, date).mapInArrow(run, schema)


def preceding_rows(cols: Sequence[str], rows: int, spec) -> Column:
    """`seq` as a window expression: rows x features array of the preceding rows, oldest first, shorter at the start of a key. Missing values are NaN.

    Unlike :func:`window_sequences` it keeps the order and the partitioning of its input, so what follows needs no sort of the wide rows.
    """
    feats = F.array(*[F.coalesce(F.col(f"`{c}`").cast("float"), F.lit(float("nan")).cast("float")) for c in cols])
    return F.collect_list(feats).over(spec.rowsBetween(-rows, -1))


def forward_fill(df: DataFrame, cols: Sequence[str], key: str | None = "ticker", date="date") -> DataFrame:
    """Last known value, never a later one. Without a key the table must hold one row per date."""
    spec = W.partitionBy(key) if key else W.partitionBy()
    w = spec.orderBy(date).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def equity_curve(df: DataFrame, ret: str, capital: float, out: str = "equity", date="date") -> DataFrame:
    """capital * running product of (1 + r) over a one-row-per-day table."""
    w = W.partitionBy().orderBy(date).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(out, F.lit(float(capital)) * F.product(F.lit(1.0) + F.coalesce(ret, F.lit(0.0))).over(w))


def running_cash(df: DataFrame, flow: str, start: float, out: str = "cash_holding", date="date") -> DataFrame:
    w = W.partitionBy().orderBy(date).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(out, F.lit(float(start)) + F.sum(F.coalesce(flow, F.lit(0.0))).over(w))


def drawdown(df: DataFrame, equity: str = "equity", out: str = "drawdown", date="date") -> DataFrame:
    """(equity - running maximum) / running maximum."""
    w = W.partitionBy().orderBy(date).rowsBetween(W.unboundedPreceding, 0)
    peak = F.max(equity).over(w)
    return df.withColumn("_peak", peak).withColumn(out, N.ratio(F.col(equity) - F.col("_peak"), F.col("_peak"))).drop("_peak")


def recent_return(df: DataFrame, rows: int = 20, close: str = "close", key="ticker", date="date", out="recent_return_pct") -> DataFrame:
    """Percent change over `rows` rows; NULL with fewer rows or a zero base."""
    return df.withColumn(out, N.change(F.col(close), F.lag(close, rows).over(by(key, date))) * 100.0)


def momentum_context(df: DataFrame, close: str = "close", key="ticker", date="date") -> DataFrame:
    """ret_5d over 4 steps, ret_20d over 19 steps, vol_20d of the last 20 returns, annualised, in percent."""
    w = by(key, date)
    d = df.withColumns({"_r": N.change(F.col(close), F.lag(close).over(w)), "_n": F.row_number().over(w)})
    last20 = w.rowsBetween(-19, 0)
    return d.withColumns({
        "ret_5d": N.change(F.col(close), F.lag(close, 4).over(w)) * 100.0,
        "ret_20d": N.change(F.col(close), F.lag(close, 19).over(w)) * 100.0,
        "vol_20d": F.when(F.col("_n") >= 20, F.stddev_samp("_r").over(last20) * F.sqrt(F.lit(252.0)) * 100.0),
    }).drop("_r", "_n")


def positions(df: DataFrame, key="ticker", date="date") -> DataFrame:
    """Add rn (1-based row position) and n_rows (rows of the key)."""
    return df.withColumns({"rn": F.row_number().over(by(key, date)),
                           "n_rows": F.count("*").over(W.partitionBy(key))})


def holding_exit(df: DataFrame, hold: int) -> DataFrame:
    """Exit position and status of an entry at rn: rn + hold when it exists, else the last row."""
    return df.withColumns({
        "exit_rn": F.least(F.col("rn") + hold, F.col("n_rows")),
        "status": F.when(F.col("rn") + hold <= F.col("n_rows"), "CLOSED").otherwise("OPEN")})
