"""Aggregations. Each is one partial/final aggregate unless its docstring says otherwise."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import DataFrame, functions as F

from panelweave.functions import numeric as N
from panelweave.operators import ordering as O



def daily_vector_mean(df: DataFrame, dim: int, vec: str = "emb", keys: Sequence[str] = ("ticker", "date"),
                      also: Sequence[str] = ()) -> DataFrame:
    """Element-wise mean of a vector of `dim` elements and of further columns; a vector of another width is an error.

    One average per element inside a single aggregate: no explode, and partial
    sums of `dim` numbers leave each map task.
    """
    fit = F.when(F.col(vec).isNull() | (F.size(vec) == dim), F.col(vec)).otherwise(
        F.raise_error(F.format_string("vector of %d elements where " + str(dim) + " are expected", F.size(vec))))
    df = df.withColumn(vec, fit)
    avgs = [F.avg(F.get(F.col(vec), F.lit(i)).cast("double")).alias(f"_e{i}") for i in range(dim)]
    out = df.groupBy(*keys).agg(*avgs, *[F.avg(c).alias(c) for c in also])
    return out.select(*keys, F.array(*[F.col(f"_e{i}") for i in range(dim)]).alias(vec), *also)


def trade_summary(trades: DataFrame) -> DataFrame:
    """One row of fifteen measures over a trade table with status CLOSED or OPEN."""
    closed, open_ = F.col("status") == "CLOSED", F.col("status") == "OPEN"
    when = lambda cond, c: F.when(cond, F.col(c))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    cap = total(F.col("capital_per_trade"))
    over_cap = lambda x, k=1.0: F.when(cap > 0, N.ratio(x, cap) * k)
    return trades.agg(
        F.count("*").alias("total_trades"), F.count_if(closed).alias("closed_trades"), F.count_if(open_).alias("open_trades"),
        (F.avg(F.when(closed, F.when(F.col("pnl_usd") > 0, 1.0).otherwise(0.0))) * 100).alias("closed_win_rate_pct"),
        F.avg(when(closed, "return_pct")).alias("closed_avg_return_pct"),
        total(when(closed, "pnl_usd")).alias("closed_total_pnl_usd"), total(when(open_, "pnl_usd")).alias("open_mtm_pnl_usd"),
        total(F.col("pnl_usd")).alias("total_pnl_usd"), over_cap(total(F.col("pnl_usd")), 100.0).alias("total_return_on_deployed_pct"),
        F.avg(when(closed, "capm_alpha_pct")).alias("closed_avg_capm_alpha_pct"),
        F.avg(when(closed, "capm_alpha_raw")).alias("closed_avg_capm_alpha_raw"),
        total(when(closed, "capm_alpha_usd")).alias("closed_total_capm_alpha_usd"),
        total(F.col("capm_alpha_usd")).alias("total_capm_alpha_usd"),
        over_cap(total(F.col("capm_alpha_usd")), 100.0).alias("total_capm_alpha_pct"),
        over_cap(total(F.col("capm_alpha_usd"))).alias("total_capm_alpha_raw"))


def consolidate_by_ticker(trades: DataFrame) -> DataFrame:
    """Position per ticker; first and last follow the table order (signal_date, ticker).

    Present it sorted by consolidated_capm_alpha_raw descending with NULLs
    last, then by weighted_avg_entry_price.
    """
    g = trades.groupBy("ticker").agg(
        F.sum("shares").alias("total_shares"), F.sum("capital_per_trade").alias("total_cost_basis_usd"),
        F.min("signal_date").alias("signal_date_first"), F.max("signal_date").alias("signal_date_last"),
        F.min_by("entry_date", "signal_date").alias("entry_date_first"),
        F.coalesce(F.sum("capm_alpha_usd"), F.lit(0.0)).alias("consolidated_capm_alpha_usd"))
    cost = F.col("total_cost_basis_usd")
    return g.withColumns({
        "weighted_avg_entry_price": N.ratio(cost, F.col("total_shares")),
        "consolidated_capm_alpha_raw": F.when(cost > 0, N.ratio(F.col("consolidated_capm_alpha_usd"), cost))})


def latest_marks(bars: DataFrame, close: str = "close") -> DataFrame:
    return bars.where(F.col(close).isNotNull()).groupBy("ticker").agg(F.max_by(close, "date").alias("mark_price"))


def mark_positions(trades: DataFrame, marks: DataFrame) -> DataFrame:
    """Trades valued at the mark of their ticker."""
    d = trades.join(marks, "ticker", "left").withColumns({
        "cost_basis_usd": F.col("shares") * F.col("entry_price"), "market_value_usd": F.col("shares") * F.col("mark_price")})
    d = d.withColumn("unrealized_pnl_usd", F.col("market_value_usd") - F.col("cost_basis_usd"))
    return d.withColumn("unrealized_return_pct", F.when(
        F.col("cost_basis_usd") > 0, N.ratio(F.col("unrealized_pnl_usd"), F.col("cost_basis_usd")) * 100))


def marks_by_ticker(positions: DataFrame) -> DataFrame:
    """Per-ticker value of marked positions joined with the consolidated entry."""
    g = positions.groupBy("ticker").agg(
        F.sum("shares").alias("total_shares"), F.sum("cost_basis_usd").alias("total_cost_basis_usd"),
        F.max("mark_price").alias("mark_price"), F.sum("market_value_usd").alias("market_value_usd"),
        F.sum("unrealized_pnl_usd").alias("unrealized_pnl_usd"))
    c = consolidate_by_ticker(positions).select("ticker", "weighted_avg_entry_price", "consolidated_capm_alpha_usd",
                                                "consolidated_capm_alpha_raw")
    entry = F.col("weighted_avg_entry_price")
    return g.join(c, "ticker", "left").withColumn("unrealized_return_pct", F.when(
        F.col("total_cost_basis_usd") > 0, N.ratio(F.col("mark_price") - entry, entry) * 100))


def book_summary(positions: DataFrame) -> DataFrame:
    """One row: open and closed positions, book value now and book profit."""
    closed, open_ = F.col("status") == "CLOSED", F.col("status") == "OPEN"
    total = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0.0))
    always = F.lit(True)
    s = positions.agg(
        F.count_if(open_).alias("open_positions"), F.count_if(closed).alias("closed_positions"),
        total(open_, "cost_basis_usd").alias("open_cost_basis_usd"), total(open_, "market_value_usd").alias("open_market_value_usd"),
        total(closed, "pnl_usd").alias("closed_realized_pnl_usd"), total(closed, "capital_per_trade").alias("_closed_capital"),
        total(always, "capital_per_trade").alias("book_cost_basis_usd"), total(always, "capm_alpha_usd").alias("portfolio_capm_alpha_usd"))
    cost = F.col("book_cost_basis_usd")
    s = s.withColumns({
        "open_unrealized_pnl_usd": F.col("open_market_value_usd") - F.col("open_cost_basis_usd"),
        "book_value_now_usd": F.col("open_market_value_usd") + F.col("_closed_capital") + F.col("closed_realized_pnl_usd")})
    s = s.withColumn("book_profit_loss_now_usd", F.col("book_value_now_usd") - cost)
    return s.withColumns({
        "book_profit_loss_now_pct": F.when(cost > 0, N.ratio(F.col("book_profit_loss_now_usd"), cost) * 100),
        "portfolio_capm_alpha_raw": F.when(cost > 0, N.ratio(F.col("portfolio_capm_alpha_usd"), cost)),
        "portfolio_capm_alpha_pct": F.when(cost > 0, N.ratio(F.col("portfolio_capm_alpha_usd"), cost) * 100)}).drop("_closed_capital")


def risk_summary(portfolio: DataFrame, capital: float, ret: str = "ai_daily_return", bench: str = "spy_daily_return") -> DataFrame:
    """ROI, drawdown, exposure, Sharpe, correlation, tracking error and information ratio of daily returns."""
    r, b = F.col(ret), F.col(bench)
    year = F.sqrt(F.lit(252.0))
    sharpe = lambda x: F.coalesce(N.ratio(F.avg(x), F.stddev_samp(x)), F.lit(0.0)) * year
    roi = lambda c: (F.max_by(c, "date") - capital) / capital * 100
    return portfolio.agg(
        roi("ai_equity").alias("ai_roi_pct"), roi("spy_equity").alias("spy_roi_pct"),
        (F.min("ai_drawdown") * 100).alias("max_drawdown_pct"), (F.avg("invested_ratio") * 100).alias("avg_invested_pct"),
        sharpe(r).alias("ai_sharpe"), sharpe(b).alias("spy_sharpe"), F.corr(r, b).alias("correlation"),
        F.stddev_samp(r - b).alias("tracking_error"), sharpe(r - b).alias("information_ratio"))


def var_cvar(df: DataFrame, ret: str, confidence: float = 0.95) -> DataFrame:
    """Variance, historical and normal value at risk with expected shortfall; all 0 without returns.

    The cutoff is an exact quantile; the tail mean reads it as a scalar subquery.
    """
    alpha = 1.0 - confidence
    z = NormalDist().inv_cdf(alpha)
    rows = df.select(N.finite(F.col(ret).cast("double")).alias("r")).dropna()
    cutoff = O.exact_quantiles(rows, [], "r", [alpha]).select("q").scalar()
    stats = rows.withColumn("_cut", cutoff).agg(
        F.var_samp("r").alias("variance"), F.avg("r").alias("_m"), F.stddev_samp("r").alias("_s"),
        F.avg(F.when(F.col("r") <= F.col("_cut"), F.col("r"))).alias("_tail"), F.max("_cut").alias("_cut"))
    zero, sd = F.lit(0.0), F.col("_s")
    return stats.select(
        F.coalesce("variance", zero).alias("variance"), F.coalesce(-F.col("_cut"), zero).alias("historical_var"),
        F.coalesce(-F.col("_tail"), zero).alias("historical_cvar"),
        F.when(sd > 0, -(F.col("_m") + sd * z)).otherwise(zero).alias("parametric_var"),
        F.when(sd > 0, -(F.col("_m") - sd * (NormalDist().pdf(z) / alpha))).otherwise(zero).alias("parametric_cvar"))


def trade_analytics(ledger: DataFrame, ret: str = "strategy_return") -> DataFrame:
    """Win rate, average win and loss in percent, gross sums and profit factor (infinite without losses)."""
    r = F.col(ret)
    win, loss = F.when(r > 0, r), F.when(r <= 0, r)
    gain, pain = F.coalesce(F.sum(win), F.lit(0.0)), F.abs(F.coalesce(F.sum(loss), F.lit(0.0)))
    return ledger.agg(
        F.count(r).alias("total_trades"), (F.avg(F.when(r > 0, 100.0).when(r.isNotNull(), 0.0))).alias("win_rate_pct"),
        F.coalesce(F.avg(win) * 100, F.lit(0.0)).alias("avg_win_pct"), F.coalesce(F.avg(loss) * 100, F.lit(0.0)).alias("avg_loss_pct"),
        gain.alias("gross_profit"), pain.alias("gross_loss"),
        F.coalesce(N.ratio(gain, pain), F.lit(float("inf"))).alias("profit_factor"))


def monthly(portfolio: DataFrame, spine: bool = True) -> DataFrame:
    """Calendar-month table of a daily portfolio; percentages and equities rounded to cents.

    Alpha is the difference of the rounded returns. `spine` also emits months
    without rows (return 0, other values NULL).
    """
    m = portfolio.groupBy(F.trunc("date", "MM").alias("month")).agg(
        (N.compound(F.col("ai_daily_return")) * 100).alias("_a"), (N.compound(F.col("spy_daily_return")) * 100).alias("_s"),
        F.max_by("ai_equity", "date").alias("ai_equity"), F.max_by("spy_equity", "date").alias("spy_equity"),
        (F.min("ai_drawdown") * 100).alias("_dd"), (F.avg("invested_ratio") * 100).alias("_x"),
        F.avg("gross_exposure").alias("_g"), F.avg("net_exposure").alias("_n"))
    if spine:
        ends = m.agg(F.min("month").alias("a"), F.max("month").alias("b"))
        months = ends.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
        m = months.join(m, "month", "left").fillna(0.0, subset=["_a", "_s"])
    r2 = lambda c: N.half_even(F.col(c) if isinstance(c, str) else c, 2)
    return m.select(
        F.date_format("month", "yyyy-MM").alias("month"), r2("_a").alias("ai_ret_pct"), r2("_s").alias("spy_ret_pct"),
        r2(r2("_a") - r2("_s")).alias("alpha_pct"), r2("_dd").alias("max_dd_pct"), r2("_x").alias("exposure_pct"),
        r2("_g").alias("gross_exposure_pct"), r2("_n").alias("net_exposure_pct"), r2("ai_equity").alias("ai_equity"),
        r2("spy_equity").alias("spy_equity"), r2(F.col("ai_equity") - F.col("spy_equity")).alias("equity_diff"))


def regime_attribution(portfolio: DataFrame, ret: str = "ai_daily_return", bench: str = "spy_daily_return") -> DataFrame:
    """Mean returns in percent on benchmark up and down days, excess and day counts."""
    up, down = F.col(bench) > 0, F.col(bench) < 0
    mean = lambda cond, c: F.coalesce(F.avg(F.when(cond, F.col(c))) * 100, F.lit(0.0))
    return portfolio.agg(
        mean(up, ret).alias("ai_up_pct"), mean(down, ret).alias("ai_down_pct"), mean(up, bench).alias("spy_up_pct"),
        mean(down, bench).alias("spy_down_pct"), (mean(up, ret) - mean(up, bench)).alias("excess_up_pct"),
        (mean(down, ret) - mean(down, bench)).alias("excess_down_pct"),
        F.count_if(up).alias("up_days"), F.count_if(down).alias("down_days"))


def capm_regression(portfolio: DataFrame, rf: float = 0.051, ret: str = "ai_daily_return", bench: str = "spy_daily_return") -> DataFrame:
    """Beta of excess returns over the whole period and annualised alpha in percent."""
    day = rf / 252.0
    r, b = F.col(ret) - day, F.col(bench) - day
    beta = F.coalesce(N.ratio(F.covar_samp(r, b), F.var_samp(b)), F.lit(0.0))
    return portfolio.agg(beta.alias("capm_beta"), ((F.avg(r) - beta * F.avg(b)) * 25200).alias("capm_alpha_annual_pct"))


QUANTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def describe(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = QUANTILES) -> DataFrame:
    """count, mean, std, min, max and exact quantiles q_N of each column, one row per column."""
    tall = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), N.to_double(F.col(c)).alias("x")) for c in cols]))
                     .alias("s")).select("s.*").dropna()
    stats = tall.groupBy("column").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
                                       F.min("x").alias("min"), F.max("x").alias("max"))
    q = O.exact_quantiles(tall, ["column"], "x", probs)
    wide = q.groupBy("column").agg(*[F.max(F.when(F.abs(F.col("prob") - p) < 1e-9, F.col("q"))).alias(f"q_{round(p * 100)}")
                                     for p in probs])
    return stats.join(wide, "column")


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Counts of equal-width bins over [min, max]; the last bin is closed. Empty bins are listed.

    A constant column spreads over [value - 0.5, value + 0.5].
    """
    x = df.select(N.to_double(F.col(col)).alias("x")).dropna()
    ends = x.agg(F.struct(F.min("x").alias("a"), F.max("x").alias("b")))
    ends = ends.select(ends.columns[0]).toDF("e")
    flat = F.col("e.a") == F.col("e.b")
    lo = F.when(flat, F.col("e.a") - 0.5).otherwise(F.col("e.a"))
    hi = F.when(flat, F.col("e.b") + 0.5).otherwise(F.col("e.b"))
    edges = ends.select(lo.alias("lo"), ((hi - lo) / bins).alias("step"))
    span = edges.select(F.struct("lo", "step")).scalar()
    counts = x.withColumn("s", span).select(
        F.least(F.floor(N.ratio(F.col("x") - F.col("s.lo"), F.col("s.step"))), F.lit(bins - 1)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    spine = edges.select("lo", "step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"))
    return spine.join(counts, "bin", "left").select(
        "bin", (F.col("lo") + F.col("bin") * F.col("step")).alias("left_edge"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("step")).alias("right_edge"), F.coalesce("n", F.lit(0)).alias("n"))


def moments_state(df: DataFrame, cols: Sequence[str], batch: str | None = None) -> DataFrame:
    """Mergeable state of a scaler: rows (feature, n, mean, m2), m2 the sum of squared deviations.

    Batches that hold any non-finite value are left out as a whole; each batch has its own moments, so one pass
    finds both, and a batch of any size is summed by partial aggregation.
    """
    bad = F.lit(False)
    for c in cols:
        bad = bad | N.finite(F.col(c).cast("double")).isNull()
    x = lambda c: F.col(c).cast("double")
    one = F.array(*[F.struct(F.lit(c).alias("feature"), F.count(c).alias("n"), F.avg(x(c)).alias("mean"),
                             (F.var_pop(x(c)) * F.count(c)).alias("m2")) for c in cols])
    per = df.groupBy(*([batch] if batch else [])).agg(one.alias("s"), F.max(bad).alias("_bad"))
    if batch is not None:
        per = per.where("not _bad")
    return merge_states(per.select(F.explode("s").alias("s")).select("s.*"))


def merge_states(*states: DataFrame) -> DataFrame:
    """One state of several: of batches, runs or partitions, in any order and grouping."""
    every = states[0]
    for s in states[1:]:
        every = every.unionByName(s)
    every = every.where("n > 0")
    # deviations of the parts' means from their common mean need that mean: a window over the few parts of a feature
    parts = every.groupBy("feature").agg(F.sum("n").alias("n"), F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("mean"),
                                         F.sum("m2").alias("inner"))
    both = every.select("feature", F.col("n").alias("_n"), F.col("mean").alias("_m")).join(parts, "feature")
    return both.groupBy("feature", "n", "mean", "inner").agg(F.sum(F.col("_n") * (F.col("_m") - F.col("mean")) ** 2).alias("outer")).select(
        "feature", "n", "mean", (F.col("inner") + F.col("outer")).alias("m2"))


def scaler_from_state(state: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with <c>_mean and <c>_scale: mean and population deviation, zero deviation as 1."""
    at = lambda c, v: F.max(F.when(F.col("feature") == c, v))
    sd = F.sqrt(F.col("m2") / F.col("n"))
    return state.agg(*[x for c in cols for x in (at(c, F.col("mean")).alias(f"{c}_mean"), at(c, F.when(sd == 0, 1.0).otherwise(sd)).alias(f"{c}_scale"))])


def scaler_fit(df: DataFrame, cols: Sequence[str], batch: str | None = None) -> DataFrame:
    """One row with <c>_mean and <c>_scale: mean and population deviation, zero deviation as 1.

    With `batch`, batches holding any non-finite value are left out as a whole.
    """
    if batch is not None:
        return scaler_from_state(moments_state(df, cols, batch), cols)
    out = []
    for c in cols:
        s = F.stddev_pop(c)
        out += [F.avg(c).alias(f"{c}_mean"), F.when(s == 0, 1.0).otherwise(s).alias(f"{c}_scale")]
    return df.agg(*out)


def target_stats(df: DataFrame, label: str = "label", bound: float = 50.0) -> DataFrame:
    """Mean and population deviation of the clipped label; variance at least 1e-8; (0, 1) without labels."""
    y = N.clip(N.finite(F.col(label)), -bound, bound)
    return df.agg(F.coalesce(F.avg(y), F.lit(0.0)).alias("mean"),
                  F.when(F.count(y) > 0, F.sqrt(F.greatest(F.var_pop(y), F.lit(1e-8)))).otherwise(1.0).alias("std"))


def consensus(runs: DataFrame, key: str = "ticker") -> DataFrame:
    """Distinct verdicts and decisions, confidence range and mean, modal verdict (ties alphabetical) per key.

    Verdicts are counted before the modal one is chosen, so a key with very many
    runs contributes one row per distinct verdict and task.
    """
    per = runs.groupBy(key, "verdict").agg(F.count("*").alias("n"))
    # max_by over (count, reversed name order): the smallest name wins among equal counts
    modal = per.groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_list("verdict")), ", ").alias("verdicts"),
        F.min_by(F.struct("verdict", "n"), F.struct(-F.col("n"), F.col("verdict"))).alias("m"))
    stats = runs.groupBy(key).agg(
        F.count("*").alias("runs"), F.array_join(F.array_sort(F.collect_set("decision")), ", ").alias("decisions"),
        F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"), F.avg("confidence").alias("avg_confidence"))
    return stats.join(modal.select(key, "verdicts", F.col("m.verdict").alias("consensus"), F.col("m.n").alias("votes")), key)


def tickers_per_date(tracker: DataFrame, last: int) -> DataFrame:
    """Comma list of the tracked tickers in rank order for the latest dates.

    The tracker holds a fixed number of picks per day, which bounds the list;
    older days are cut by a top-k before the lists are built.
    """
    days = tracker.select("date").distinct().orderBy(F.col("date").desc()).limit(last)
    rows = tracker.join(days, "date", "left_semi")
    items = F.array_sort(F.collect_list(F.struct("rank", "ticker")))
    return rows.groupBy("date").agg(F.array_join(F.transform(items, lambda s: s["ticker"]), ", ").alias("tickers"))


def coverage_funnel(signals: DataFrame, entries: DataFrame, bars: DataFrame, min_turnover: float, per_day: int) -> DataFrame:
    """Counts at each stage from input signals to evaluated trades.

    `entries` are the limited signals that found a price on or after their day.
    """
    rich = signals.where(F.coalesce("dollar_turnover", F.lit(0.0)) >= min_turnover)
    kept = O.top_n_per_group(rich, per_day, "date", O.signal_order())
    # one row per day is enough to know how many signals the daily limit keeps
    priced = bars.select(F.col("ticker").alias("_k")).distinct()
    staged = (kept.select("date", "ticker")
              .join(priced, F.col("ticker") == F.col("_k"), "left")
              .join(entries.select("date", "ticker", F.lit(True).alias("_hit")), ["date", "ticker"], "left"))
    tail = staged.agg(
        F.count("*").alias("after_limit"), F.count_if(F.col("_k").isNull()).alias("skipped_missing_price"),
        F.count_if(F.col("_k").isNotNull() & F.col("_hit").isNull()).alias("skipped_no_later_price"),
        F.count_if("_hit").alias("evaluated_trades"))
    head = signals.agg(F.struct(F.count("*").alias("n"),
                                F.count_if(F.coalesce("dollar_turnover", F.lit(0.0)) >= min_turnover).alias("r")))
    h = head.scalar()
    return tail.withColumn("_h", h).select(
        F.col("_h.n").alias("input_signals"), (F.col("_h.n") - F.col("_h.r")).alias("filtered_by_turnover"),
        (F.col("_h.r") - F.col("after_limit")).alias("filtered_by_daily_limit"),
        F.coalesce("evaluated_trades", F.lit(0)).alias("evaluated_trades"), "skipped_missing_price", "skipped_no_later_price")


def summary_long(summary: DataFrame) -> DataFrame:
    """(metric, value) text rows of a one-row summary.

    Missing is N/A; amounts (above 100 in size, or named *_usd) get separators
    and two decimals, whole numbers none, the rest four decimals.
    """
    parts = []
    for name, kind in summary.dtypes:
        c = F.col(name)
        if kind in ("double", "float"):
            big = (F.abs(c) > 100) | F.lit(name.endswith("_usd"))
            text = (F.when(c.isNull() | F.isnan(c), "N/A").when(big, F.format_string("%,.2f", c.cast("double")))
                    .when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(F.format_string("%.4f", c.cast("double"))))
        else:
            text = F.coalesce(c.cast("string"), F.lit("N/A"))
        parts.append(F.struct(F.lit(name.replace("_", " ").title()).alias("metric"), text.alias("value")))
    return summary.select(F.explode(F.array(*parts)).alias("s")).select("s.metric", "s.value")


def quality_by_key(news: DataFrame, labels: DataFrame, key: str = "ticker") -> DataFrame:
    """Mean of the quality labels and number of labelled articles per key."""
    return news.join(labels, "doc_id").groupBy(key).agg(F.avg("quality").alias("quality"), F.count("*").alias("articles"))
