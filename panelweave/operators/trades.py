"""Trade paths, exits, ledgers, portfolio days and forward tracking as set operations.

A trade is one row (date, ticker) with its entry position; its path is the
`hold` price rows from there. Path windows are partitioned by trade, so no
group exceeds `hold` rows. Exits need no sequential engine: before the first
trigger the compounded return is a running product, and the first trigger is a
minimum over the path.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, Window as W, functions as F

from panelweave.functions import numeric as N, rules as R
from panelweave.operators import filters as P, joins as J, ordering as O, windows as X
from panelweave.operators.frames import add_doubling_moments, frame_moments
from panelweave.session import shared_root

KEYS = ("date", "ticker")
MODELS = ("OPEN", "AVG", "PAIN")


def _steps():
    return W.partitionBy(*KEYS).orderBy("i")


def _whole():
    return W.partitionBy(*KEYS)


def _avg():
    return (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4


def entry_basis(model: str):
    return {"AVG": _avg(), "PAIN": F.col("high"), "OPEN": F.col("open")}[model]


def _over(a, b):
    """(a - b) / b for a positive base, else 0."""
    return F.when(b > 0, N.ratio(a - b, b)).otherwise(0.0)


def daily_returns(path: DataFrame, model: str, hold: int, out: str = "ret") -> DataFrame:
    """Return of each path day under one execution model; paths with a missing price are dropped.

    OPEN  close over previous close; day 0 from the open.
    AVG   mean of the four prices over the previous mean; day 0 is close over
          the mean, the last day is the mean over the previous *close*. The
          product therefore does not telescope to last mean / first mean; it is
          reproduced as it stands.
    PAIN  close over previous close; day 0 from the high, the last day to the low.
    """
    if model not in MODELS:
        raise ValueError(model)
    need = {"OPEN": ("open", "close"), "AVG": ("open", "high", "low", "close"), "PAIN": ("high", "low", "close")}[model]
    c, prev = F.col("close"), F.lag("close").over(_steps())
    i, last = F.col("i"), F.col("i") == hold - 1
    step = N.change(c, prev)
    if model == "OPEN":
        r = F.when(i == 0, _over(c, F.col("open"))).otherwise(step)
    elif model == "AVG":
        r = (F.when(i == 0, _over(c, _avg())).when(last, _over(_avg(), prev))
             .otherwise(N.change(_avg(), F.lag(_avg()).over(_steps()))))
    else:
        lone = _over(F.col("low"), F.col("high"))
        r = (F.when((i == 0) & last, lone).when(i == 0, _over(c, F.col("high")))
             .when(last, _over(F.col("low"), prev)).otherwise(step))
    full = F.lit(True)
    for p in need:
        full = full & F.col(p).isNotNull()
    d = path.withColumns({out: F.coalesce(r, F.lit(0.0)), "_full": F.count(F.when(full, 1)).over(_whole())})
    return d.where(F.col("_full") == hold).drop("_full")


def apply_costs(path: DataFrame, fee: float, ret: str = "ret") -> DataFrame:
    """Subtract slippage and fees once, on day 0."""
    return path.withColumn(ret, F.when(F.col("i") == 0, F.col(ret) - fee).otherwise(F.col(ret)))


def detect_exits(path: DataFrame, stop: float, take_profit: float | None = None, contradiction_below: float | None = None,
                 hold: int = 20, ret: str = "ret") -> DataFrame:
    """Cut each path at its first trigger.

    Checked per day in this order: compounded return <= stop, >= take_profit,
    negative while `day_pred` lies below `contradiction_below`. A stop or profit
    day earns level - previous compounded return, a contradiction day its own
    return, later days 0. Adds exit_i, exit_reason, exec_ret and total_return.
    """
    cum = F.product(F.lit(1.0) + F.col(ret)).over(_steps().rowsBetween(W.unboundedPreceding, 0)) - 1.0
    d = path.withColumn("_cum", cum)
    d = d.withColumn("_prev", F.coalesce(F.lag("_cum").over(_steps()), F.lit(0.0)))
    hit = F.when(F.col("_cum") <= stop, "Hard Stop-Loss")
    if take_profit is not None:
        hit = hit.when(F.col("_cum") >= take_profit, "Take Profit")
    if contradiction_below is not None:
        hit = hit.when((F.col("_cum") < 0) & (F.col("day_pred") < contradiction_below), "Contradiction Exit")
    d = d.withColumn("_hit", hit)
    first = F.min(F.when(F.col("_hit").isNotNull(), F.col("i"))).over(_whole())
    d = d.withColumns({"_first": first, "exit_i": F.coalesce(first, F.lit(hold - 1))})
    at_exit = F.when(F.col("i") == F.col("_first"), F.col("_hit"))
    d = d.withColumn("exit_reason", F.coalesce(F.max(at_exit).over(_whole()), F.lit("Time Exit")))
    level = F.when(F.col("exit_reason") == "Hard Stop-Loss", stop)
    if take_profit is not None:
        level = level.when(F.col("exit_reason") == "Take Profit", take_profit)
    d = d.withColumn("exec_ret", F.when(F.col("i") > F.col("exit_i"), 0.0)
                     .when((F.col("i") == F.col("exit_i")) & level.isNotNull(), level - F.col("_prev"))
                     .otherwise(F.col(ret)))
    total = F.product(F.lit(1.0) + F.col("exec_ret")).over(_whole()) - 1.0
    return d.withColumn("total_return", total).drop("_cum", "_prev", "_hit", "_first")


def exit_prices(path: DataFrame, model: str, stop: float, take_profit: float | None, hold: int) -> DataFrame:
    """Add entry_price and exit_price; trades without a positive one are dropped."""
    entry = F.max(F.when(F.col("i") == 0, entry_basis(model))).over(_whole())
    here = _avg() if model == "AVG" else F.col("close")
    if model == "PAIN":
        timed = (F.col("exit_i") == hold - 1) & (F.col("exit_reason") != "Contradiction Exit")
        here = F.when(timed, F.col("low")).otherwise(here)
    d = path.withColumns({"entry_price": entry, "_here": F.max(F.when(F.col("i") == F.col("exit_i"), here)).over(_whole())})
    px = F.when(F.col("exit_reason") == "Hard Stop-Loss", F.col("entry_price") * (1 + stop))
    if take_profit is not None:
        px = px.when(F.col("exit_reason") == "Take Profit", F.col("entry_price") * (1 + take_profit))
    d = d.withColumn("exit_price", px.otherwise(F.col("_here"))).drop("_here")
    return d.where((F.col("entry_price") > 0) & (F.col("exit_price") > 0))


def executed_paths(picks: DataFrame, bars: DataFrame, model: str, hold: int, fee: float, stop: float,
                   take_profit: float | None = None, contradiction_below: float | None = None,
                   predictions: DataFrame | None = None) -> DataFrame:
    """Picks to executed path rows: entry, path, returns, costs, exits and prices.

    The picks, a few rows per day, are stored first; panel and predictions are read for their tickers only.
    """
    shared_root(picks.sparkSession)
    picks = picks.checkpoint()
    own = picks.select("ticker").distinct()
    pos = X.positions(bars.join(own, "ticker", "left_semi"))
    path = J.trade_path(J.entry_forward(picks, pos), pos, hold)
    if contradiction_below is not None:
        path = J.lookup_prediction(path, predictions.join(own, "ticker", "left_semi"))
    path = apply_costs(daily_returns(path, model, hold), fee)
    path = detect_exits(path, stop, take_profit, contradiction_below, hold)
    return exit_prices(path, model, stop, take_profit, hold)


def ledger(paths: DataFrame, capital: float, max_per_day: int, hold: int) -> DataFrame:
    """One row per trade with the fixed-fraction size capital / (max_per_day * hold); amounts in cents.

    `original_signal_date` is the day of the signal before any delay.
    """
    used = capital / (max_per_day * hold)
    r = F.col("total_return")
    first = F.col("original_signal_date" if "original_signal_date" in paths.columns else "date")
    return paths.where(F.col("i") == F.col("exit_i")).select(
        "date", "ticker", first.alias("original_signal_date"), F.lit("LONG").alias("side"), "pred_return_pct", "rank_score", "entry_date",
        N.half_even(F.col("entry_price"), 4).alias("entry_price"), F.col("day").alias("exit_date"),
        N.half_even(F.col("exit_price"), 4).alias("exit_price"), "exit_reason", r.alias("strategy_return"),
        N.half_even(F.lit(used), 2).alias("cash_used"), N.half_even(used * r, 2).alias("cash_gained"),
        N.half_even(used * (1 + r), 2).alias("cash_final"), N.half_even(r * 100, 2).alias("strategy_return_pct"))


def portfolio_daily(paths: DataFrame, calendar: DataFrame, capital: float, max_per_day: int, hold: int) -> DataFrame:
    """PnL, active capital, stock holding and cash flows of each calendar day; days without trades are 0.

    Capital counts as active on all path days, also after an early exit, and the
    stock value leaves out the last calendar day of each path; both follow the
    original accounting.
    """
    frac = 1.0 / (max_per_day * hold)
    used = capital * frac
    v = J.on_calendar(paths, calendar, "day")
    grow = F.product(F.lit(1.0) + F.col("exec_ret")).over(_steps().rowsBetween(W.unboundedPreceding, 0))
    v = v.withColumns({"_g": grow, "_end": F.max("i").over(_whole())})
    zero = F.lit(0.0)
    enters = F.col("i") == 0
    day = v.groupBy(F.col("day").alias("date")).agg(
        F.sum(F.col("exec_ret") * frac).alias("daily_pnl"), (F.count("*") * frac).alias("active_capital"),
        F.sum(F.when(F.col("i") < F.col("_end"), F.col("_g") * used).otherwise(0.0)).alias("stock_holding"),
        F.sum(F.when(enters, -used).otherwise(0.0)
              + F.when(F.col("i") == F.col("exit_i"), (1 + F.col("total_return")) * used).otherwise(0.0)).alias("cash_flow"),
        F.sum(F.when(enters, used).otherwise(0.0)).alias("cash_used_for_buys"))
    names = ["daily_pnl", "active_capital", "stock_holding", "cash_flow", "cash_used_for_buys"]
    return calendar.select("date").distinct().join(day, "date", "left").select(
        "date", *[F.coalesce(F.col(c), zero).alias(c) for c in names])


def strategy_vs_benchmark(daily: DataFrame, market: DataFrame, capital: float, leverage: float = 1.0, rf: float = 0.051) -> DataFrame:
    """Daily strategy and benchmark returns, equity curves, drawdown, cash and exposures.

    One row per calendar day: the ordered windows of this table run in a single
    task over the calendar, whatever the number of trades.
    """
    d = daily.join(market.select("date", "spy_close"), "date")
    w = W.partitionBy().orderBy("date")
    ratio = F.least(F.col("active_capital"), F.lit(1.0))
    d = d.withColumns({
        "ai_daily_return": F.col("daily_pnl") * leverage + (1.0 - ratio) * (rf / 252.0),
        "spy_daily_return": F.coalesce(N.change(F.col("spy_close"), F.lag("spy_close").over(w)), F.lit(0.0)),
        "invested_ratio": ratio})
    d = X.equity_curve(d, "ai_daily_return", capital, "ai_equity")
    d = X.equity_curve(d, "spy_daily_return", capital, "spy_equity")
    d = X.running_cash(d, "cash_flow", capital)
    d = X.drawdown(d, "ai_equity", "ai_drawdown")
    inv = N.clip(F.col("invested_ratio"), 0.0, 1.0)
    return d.withColumns({
        "equity_diff": F.col("ai_equity") - F.col("spy_equity"), "gross_exposure": inv * (leverage * 100),
        "net_exposure": (inv * leverage - (1.0 - inv)) * 100}).drop("spy_close")


def daily_buy_limit(recs: DataFrame, per_day: int | None) -> DataFrame:
    """Best `per_day` recommendations of each day; no limit for None or 0."""
    if per_day is None or per_day <= 0:
        return recs
    return O.top_n_per_group(recs, per_day, "date", O.signal_order())


def _anchors(entries: DataFrame, mode: str) -> DataFrame:
    """Entry rows at which a beta is needed: the first signal of each ticker, or every signal."""
    if mode == "first_signal":
        a = entries.groupBy("ticker").agg(F.min_by(F.struct("rn", "entry_date"), "date").alias("s"))
        return a.select("ticker", "s.rn", "s.entry_date")
    if mode == "per_signal":
        return entries.select("ticker", "rn", "entry_date").distinct()
    raise ValueError(mode)


def with_shared_days(pos: DataFrame, market: DataFrame, lookback: int = 252) -> DataFrame:
    """Stock rows (from positions) next to what they share with the benchmark.

    Adds `shared` (0/1), `spos` (shared rows up to here), `window` (shared rows among the last lookback + 1 rows of both
    stock and market), and `before`, `after`: prices (close, spy_close) of the last shared row up to here and of the first from here on.
    """
    days = market.where(F.col("spy_close").isNotNull()).select("date", "spy_close")
    days = days.withColumn("mpos", F.row_number().over(W.partitionBy().orderBy("date"))).withColumn("_md", F.col("date"))
    known = J.asof(pos.select("date").distinct(), days, [], "date", "date", ["mpos", "_md", "spy_close"], unique_left=True)
    d = pos.join(known, "date").withColumn("shared", (F.coalesce(F.col("_md") == F.col("date"), F.lit(False))).cast("bigint"))
    pair = F.when(F.col("shared") == 1, F.struct("close", "spy_close"))
    w = W.partitionBy("ticker").orderBy("rn")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumns({"spos": F.sum("shared").over(run), "before": F.last(pair, ignorenulls=True).over(run)})
    far = W.partitionBy("ticker").orderBy("mpos").rangeBetween(W.unboundedPreceding, -(lookback + 1))
    d = d.withColumns({"_old": F.coalesce(F.lag("spos", lookback + 1).over(w), F.lit(0)), "_far": F.coalesce(F.sum("shared").over(far), F.lit(0))})
    d = d.withColumn("after", F.last(pair, ignorenulls=True).over(W.partitionBy("ticker").orderBy(F.desc("rn")).rowsBetween(W.unboundedPreceding, 0)))
    return d.withColumn("window", F.col("spos") - F.greatest("_old", "_far")).drop("_old", "_far", "_md", "mpos")


def capm_beta(anchors: DataFrame, shared_rows: DataFrame, lookback: int = 252) -> DataFrame:
    """Beta from the shared price days among the last lookback+1 rows of stock and of market up to each anchor (ticker, rn).

    NULL with fewer than 30 shared rows or no market variance. `shared_rows` comes from :func:`with_shared_days`. The returns of a
    window are a frame of `window` - 1 shared rows, whose moments a handful of lookups give.
    """
    w = W.partitionBy("ticker").orderBy("spos")
    own = shared_rows.where("shared = 1").select("ticker", "spos", "close", "spy_close")
    own = own.select("ticker", "spos", N.change(F.col("close"), F.lag("close").over(w)).alias("_s"),
                     N.change(F.col("spy_close"), F.lag("spy_close").over(w)).alias("_m"))
    levels = add_doubling_moments(own, "_s", "_m", lookback, "ticker", "spos")
    at = anchors.select("ticker", "rn").distinct().join(shared_rows.select("ticker", "rn", "spos", "window"), ["ticker", "rn"])
    at = at.where("window >= 30").select("ticker", F.col("rn").alias("anchor_rn"), "spos", (F.col("window") - 1).alias("len"))
    m = frame_moments(at, levels, "spos", "len", "ticker", "spos")
    return m.select("ticker", "anchor_rn", F.when((F.col("n") > 1) & (F.col("m2y") > 0), F.col("c") / F.col("m2y")).alias("capm_beta"))


def forward_tracker(signals: DataFrame, bars: DataFrame, market: DataFrame, hold: int = 20, capital: float = 1000.0,
                    lookback: int = 252, rf: float = 0.045, beta_mode: str = "first_signal") -> DataFrame:
    """Evaluate each recommendation on the price panel: entry, exit, profit and CAPM alpha.

    Entry is the first price row on or after the signal day, at the positive
    `current_price` of the signal when given. Exit is `hold` rows later
    (CLOSED), or the last row (OPEN). By default beta is the one at the first
    signal of the ticker, reused for its later signals; "per_signal" recomputes.
    """
    # a few rows per day, read by several branches below; only their tickers need a panel
    shared_root(signals.sparkSession)
    signals = signals.checkpoint()
    own = bars.where(F.col("close").isNotNull()).join(signals.select("ticker").distinct(), "ticker", "left_semi")
    pos = X.positions(own)
    entries = J.entry_forward(signals, pos.withColumn("_close", F.col("close")), ["entry_date", "rn", "n_rows", "_close"])
    entries = entries.checkpoint()
    t = X.holding_exit(entries, hold).withColumn("entry_price", F.coalesce(N.positive(F.col("current_price")), F.col("_close")))
    rows = with_shared_days(pos, market, lookback)
    start = rows.select("ticker", "rn", (F.col("spos") - F.col("shared")).alias("_from"), F.col("after").alias("_a"))
    ends = rows.select("ticker", F.col("rn").alias("exit_rn"), F.col("date").alias("exit_date"), F.col("close").alias("exit_price"),
                       F.col("spos").alias("_to"), F.col("before").alias("_b"))
    t = t.join(ends, ["ticker", "exit_rn"]).withColumn("trading_days_held", F.col("exit_rn") - F.col("rn"))
    t = t.join(start, ["ticker", "rn"])

    betas = capm_beta(_anchors(entries, beta_mode), rows, lookback)
    if beta_mode == "first_signal":
        t = t.join(betas.drop("anchor_rn"), "ticker", "left")
    else:
        t = t.join(betas.withColumnRenamed("anchor_rn", "rn"), ["ticker", "rn"], "left")

    # the first and the last shared row of the holding time; one row alone gives no return
    two = F.col("_to") - F.col("_from") >= 2
    t = t.withColumns({
        "_sr": F.when(two, N.change(F.col("_b.close"), F.col("_a.close"))),
        "_br": F.when(two, N.change(F.col("_b.spy_close"), F.col("_a.spy_close"))),
        "_rf": F.pow(F.lit(1.0 + rf), F.greatest(F.col("trading_days_held"), F.lit(1)) / 252.0) - 1.0})
    t = t.withColumn("_exp", F.col("_rf") + F.col("capm_beta") * (F.col("_br") - F.col("_rf")))
    px, entry = F.col("exit_price"), F.col("entry_price")
    shares = F.when(entry > 0, N.ratio(F.lit(float(capital)), entry)).otherwise(0.0)
    return t.select(
        F.col("date").alias("signal_date"), "ticker", "entry_date", "entry_price", "exit_date", "exit_price",
        F.lit(hold).alias("holding_days_target"), "trading_days_held", "status", F.lit(float(capital)).alias("capital_per_trade"),
        shares.alias("shares"), (shares * (px - entry)).alias("pnl_usd"),
        F.when(entry > 0, N.change(px, entry) * 100).alias("return_pct"), "pred_return_pct", "rank_score",
        (F.col("_br") * 100).alias("benchmark_return_pct"), "capm_beta", (F.col("_exp") * 100).alias("capm_expected_return_pct"),
        ((F.col("_sr") - F.col("_exp")) * 100).alias("capm_alpha_pct"), (F.col("_sr") - F.col("_exp")).alias("capm_alpha_raw"),
        ((F.col("_sr") - F.col("_exp")) * capital).alias("capm_alpha_usd"))


def position_monitor(recs: DataFrame, current: DataFrame, agent: DataFrame, tracker: DataFrame | None, as_of, days: int = 20) -> DataFrame:
    """Exit signals for the recommendations of the last `days` days that still have a current price.

    `current` and `agent` hold one row per ticker; a ticker without an agent
    answer counts as hold with confidence 0.5.
    """
    r = recs.where(F.datediff(as_of, "date_recommended") <= days)
    if tracker is not None:
        allowed = tracker.select(F.upper(F.trim("ticker")).alias("_k")).distinct()
        r = r.join(allowed, F.upper("ticker") == F.col("_k"), "left_semi")
    a = agent.select("ticker", F.lower("recommendation").alias("_v"), F.col("confidence").alias("_c"))
    r = r.join(current.select("ticker", "current_price"), "ticker").join(a, "ticker", "left")
    r = r.withColumns({"current_verdict": F.coalesce("_v", F.lit("hold")),
                       "current_confidence": F.when(F.col("_v").isNull(), 0.5).otherwise(F.col("_c"))}).drop("_v", "_c")
    r = P.position_age(r, as_of, "date_recommended", "entry_price", "current_price")
    return r.withColumns(R.exit_signal(F.col("entry_recommendation"), F.col("entry_confidence"), F.col("current_verdict"),
                                       F.col("current_confidence"), F.col("days_held"), F.col("price_change_pct"), days))
