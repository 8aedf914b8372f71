"""Decision tables as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelweave.functions import numeric as N, text as X

# Exit signal to simple action; anything else is HOLD.
SIMPLE_ACTION = {
    "EXIT NOW": "EXIT", "EXIT / STOP LOSS": "EXIT", "TAKE PROFITS": "EXIT", "EXIT (thesis complete)": "EXIT",
    "TRIM / REDUCE": "HOLD", "REVERSE TO BUY": "BUY MORE", "UPGRADE TO BUY": "BUY MORE",
    "HOLD": "HOLD", "MAINTAIN SELL": "EXIT",
}
ACTION_ORDER = {"BUY MORE": 1, "HOLD": 2, "EXIT": 3}


def blend_prediction(raw: Column, mean: Column, std: Column, recent: Column) -> dict[str, Column]:
    """De-normalise a model output; near zero or missing, blend half of the recent return in.

    A missing model value blends to NULL (still flagged), a missing recent
    return leaves the model value alone.
    """
    model = N.finite(raw * std + mean)
    use = recent.isNotNull() & F.coalesce(F.abs(model) < 0.25, F.lit(True))
    return {"pred_model": model, "used_fallback": use,
            "pred_final": F.when(use, 0.5 * model + 0.5 * recent).otherwise(model)}


def crosscheck_columns(rec: Column, conf: Column, status: Column, pred: Column, score: Column,
                       conf_min: float, min_pred: float, min_score: float) -> dict[str, Column]:
    """AI pass, model pass, verdict and priority. Unknown comparisons count as a fail."""
    ai = N.is_true(F.lower(rec).isin("buy", "long") & (conf.isNull() | (conf >= conf_min)) & (F.lower(status) == "ok"))
    model = N.is_true((pred >= min_pred) & (score >= min_score))
    return {
        "ai_pass": ai, "model_pass": model,
        "result": F.when(ai & model, "BUY_CONFIRMED").when(ai, "AI_ONLY_WATCH").otherwise("AI_REJECT"),
        "priority": F.when(ai & model, 0).when(ai, 1).otherwise(2),
    }


def crosscheck(agent: DataFrame, model: DataFrame, conf_min: float, min_pred: float, min_score: float) -> DataFrame:
    """Agent answers left-joined to one model row per ticker, with the verdict columns.

    Sort the result by priority, then confidence, score and prediction
    descending with NULLs last, to present it.
    """
    merged = agent.join(model, "ticker", "left")
    return merged.withColumns(crosscheck_columns(
        F.col("recommendation"), F.col("confidence"), F.col("status"),
        F.col("pred_return_pct"), F.col("rank_score"), conf_min, min_pred, min_score))


def fixed(c: Column, digits: int) -> Column:
    """Number with fixed decimals, rounded from its exact binary value as the printing functions of most languages do."""
    return F.call_function("format_number", c.cast("double"), F.lit("0." + "0" * digits))


def exit_signal(entry_rec: Column, entry_conf: Column, verdict: Column, conf: Column, days_held: Column,
                change_pct: Column, window_days: int = 20) -> dict[str, Column]:
    """Exit signal of a tracked recommendation and the reason in words."""
    rec, now = F.lower(entry_rec), F.lower(verdict)
    weaker = (now == "hold") & (conf < entry_conf - 0.2)
    expired = days_held >= window_days
    shout = F.upper(verdict)
    buy = (F.when(now == "sell", "EXIT NOW").when(weaker, "TRIM / REDUCE")
           .when(expired & (change_pct > 3), "TAKE PROFITS")
           .when(expired & (change_pct < -5), "EXIT / STOP LOSS")
           .when(expired, "EXIT (thesis complete)").otherwise("HOLD"))
    buy_why = (
        F.when(now == "sell", F.format_string("Recommendation reversed: was BUY, now SELL (confidence %s)", fixed(conf, 2)))
        .when(weaker, F.format_string("Weakened conviction: was %s, now %s; take some profits", fixed(entry_conf, 2), fixed(conf, 2)))
        .when(expired & (change_pct > 3),
              F.format_string("20-day thesis window closing; up %s%%, consider exit", fixed(change_pct, 1)))
        .when(expired & (change_pct < -5),
              F.format_string("20-day thesis window closing; down %s%%, cut loss", fixed(change_pct, 1)))
        .when(expired, F.lit("20-day forecast window expired; reassess"))
        .otherwise(F.format_string("Agent verdict: %s (%s); Portfolio action: HOLD, %dd held", shout, fixed(conf, 2), days_held)))
    sell = F.when(now == "buy", "REVERSE TO BUY").otherwise("MAINTAIN SELL")
    sell_why = (F.when(now == "buy", F.lit("Recommendation reversed: was SELL, now BUY"))
                .otherwise(F.format_string("Agent verdict: %s; Portfolio action: MAINTAIN SELL", shout)))
    other = F.when(now == "buy", "UPGRADE TO BUY").otherwise("HOLD")
    other_why = (F.when(now == "buy", F.format_string("Agent verdict: BUY (%s); Portfolio action: UPGRADE TO BUY", fixed(conf, 2)))
                 .otherwise(F.format_string("Agent verdict: %s (%s); Portfolio action: HOLD", shout, fixed(conf, 2))))
    return {
        "exit_signal": F.when(rec == "buy", buy).when(rec == "sell", sell).otherwise(other),
        "reason": F.when(rec == "buy", buy_why).when(rec == "sell", sell_why).otherwise(other_why),
    }


def simple_action(signal: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in SIMPLE_ACTION.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, signal), F.lit("HOLD"))


def simple_action_counts(df: DataFrame, signal: str = "exit_signal") -> DataFrame:
    """Rows per simple action with the fixed report position."""
    act = simple_action(F.col(signal))
    pos = F.create_map(*[F.lit(x) for kv in ACTION_ORDER.items() for x in kv])
    return (df.groupBy(act.alias("simple_action")).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("position", F.try_element_at(pos, F.col("simple_action"))))


def quick_verdict(agent_rec: Column, pred: Column, min_pred: float) -> Column:
    """BUY or DON'T BUY from the agent when it answered, else from the prediction."""
    rec = F.lower(F.coalesce(agent_rec, F.lit("")))
    yes = rec.isin("buy", "long") | ((rec == "") & N.is_true(pred >= min_pred))
    return F.when(yes, "BUY").otherwise("DON'T BUY")


def cost_decision(verdict: Column, change_pct: Column) -> Column:
    """HOLD or SELL of a position judged against its cost price."""
    v = F.lower(verdict)
    hold = (v == "buy") | N.is_true(change_pct > 10)
    sell = (v == "sell") | N.is_true(change_pct < -10)
    return F.when(hold, "HOLD").when(sell, "SELL").otherwise("HOLD")


def signed(x: Column, digits: int) -> Column:
    """Number text with a leading sign, like %+.Nf."""
    text = fixed(x, digits)
    return F.when(F.startswith(text, F.lit("-")), text).otherwise(F.concat(F.lit("+"), text))


def factor_narrative(action: Column, ticker: Column, pred: Column, recent: Column, score: Column,
                     pos: Column, neg: Column, market_pos: Column, market_neg: Column, fallback: Column) -> Column:
    """One-sentence reasoning from bucketed factors; at most three qualifying factors are named."""
    factors = F.array_compact(F.array(
        F.when(recent > 5, F.format_string("strong 20D momentum (+%s%%)", fixed(recent, 1)))
        .when(recent > 2, F.format_string("positive momentum (+%s%%)", fixed(recent, 1)))
        .when(recent < -5, F.format_string("weak momentum (%s%%)", fixed(recent, 1)))
        .otherwise(F.format_string("neutral momentum (%s%%)", fixed(recent, 1))),
        F.when(F.abs(pred) > 10, F.concat(F.lit("significant predicted alpha ("), signed(pred, 1), F.lit("%)")))
        .when(F.abs(pred) > 3, F.concat(F.lit("material prediction ("), signed(pred, 1), F.lit("%)"))),
        F.when((pos > 0.6) & (neg < 0.2), "strong positive sentiment").when(pos > 0.4, "positive sentiment bias")
        .when(neg > 0.6, "strong negative sentiment").when(neg > 0.4, "negative sentiment bias")
        .otherwise("mixed sentiment"),
        F.when(market_pos > market_neg, "favorable broad market sentiment").otherwise("cautious broad market sentiment"),
        F.when(score > 0.05, F.format_string("strong relative ranking (%s)", fixed(score, 3)))
        .when(score > -0.05, F.lit("neutral ranking"))
        .otherwise(F.format_string("weak relative ranking (%s)", fixed(score, 3))),
    ))

    def best(pattern):
        hit = F.filter(factors, lambda f: f.rlike(pattern))
        return F.array_join(F.slice(F.when(F.size(hit) > 0, hit).otherwise(factors), 1, 3), " | ")

    tail = F.concat(F.lit("Expected 20D alpha: "), signed(pred, 2), F.lit("%."))
    a = F.lower(action)
    return (
        F.when(a.isin("buy", "long"), F.concat(
            F.lit("BUY "), ticker, F.lit(": "), best("positive|strong|material"), F.lit(". "),
            F.when(fallback, "Model applied fallback blending for risk mitigation. ").otherwise(""), tail))
        .when(a.isin("sell", "short"), F.concat(
            F.lit("SELL/AVOID "), ticker, F.lit(": "), best("weak|negative|caution"), F.lit(". "),
            F.when(fallback, "Model applied fallback blending. ").otherwise(""), tail))
        .otherwise(F.concat(F.lit("HOLD "), ticker, F.lit(": "), F.array_join(F.slice(factors, 1, 2), " | "),
                            F.lit(". Mixed signal - awaiting clarity.")))
    )


def _labelled(label: str, value: Column, digits: int, unit: str = "") -> Column:
    """label=<formatted value>, or label=n/a when missing."""
    return F.when(value.isNotNull(), F.concat(F.lit(f"{label}="), fixed(value, digits), F.lit(unit))).otherwise(f"{label}=n/a")


def model_input_summary(day: Column, ticker: Column, price: Column, recent: Column, pred: Column, score: Column,
                        fallback: Column, pos: Column, neg: Column, neu: Column, news: Column, limit: int | None = None) -> Column:
    """Pipe-joined record of what went into a prediction."""
    known = pos.isNotNull()
    mood = F.when(known, F.format_string("finbert_sentiment=pos:%s,neg:%s,neu:%s", *[fixed(c, 3) for c in (pos, neg, neu)])).otherwise("finbert_sentiment=n/a")
    text = X.shorten(news, limit)
    return F.concat_ws(
        " | ", F.concat(F.lit("date="), day.cast("string")), F.concat(F.lit("ticker="), F.coalesce(ticker, F.lit("n/a"))),
        _labelled("current_price", price, 2), _labelled("recent_20d_return", recent, 2, "%"),
        _labelled("pred_ret_final", pred, 2, "%"), _labelled("xgb_rank_score", score, 3),
        F.concat(F.lit("used_fallback="), F.initcap(fallback.cast("string"))), mood,
        F.when(text != "", F.concat(F.lit("news_excerpt="), text)).otherwise("news_excerpt=n/a"))


def agent_input_summary(day: Column, ticker: Column, price: Column, recent: Column, pos: Column, neg: Column,
                        news: Column, limit: int | None = None) -> Column:
    """Pipe-joined decision record without model internals; missing parts are left out."""
    text = X.shorten(news, limit)
    mood = F.when(pos.isNotNull() & neg.isNotNull(), F.format_string(
        "Sentiment Tone: %s (positive:%s%%, negative:%s%%)", X.tone(pos, neg), fixed(pos * 100, 1), fixed(neg * 100, 1)))
    return F.concat_ws(
        " | ", F.concat(F.lit("Ticker: "), F.coalesce(ticker, F.lit("n/a"))), F.concat(F.lit("Date: "), day.cast("string")),
        F.when(price != 0, F.format_string("Current Price: $%s", fixed(price, 2))),
        F.when(recent.isNotNull(), F.concat(F.lit("Recent 20D Return (Momentum): "), signed(recent, 2), F.lit("%"))),
        mood, F.when(text != "", F.concat(F.lit("Context: "), text)))


# Agent actions and the verdict they stand for; others are shown as they are, in capitals.
AGENT_VERDICTS = {"buy": "BUY CONFIRMED", "long": "BUY CONFIRMED", "sell": "AVOID / SELL", "short": "AVOID / SELL",
                  "hold": "NO BUY", "neutral": "NO BUY"}


def agent_verdict(action: Column, status: Column) -> Column:
    """Buy-focused verdict of an agent's action: ERROR unless its status is ok; a missing action or status counts as n/a."""
    act, state = (F.lower(F.trim(F.coalesce(c, F.lit("n/a")))) for c in (action, status))
    known = F.create_map(*[F.lit(x) for kv in AGENT_VERDICTS.items() for x in kv])
    return F.when(state != "ok", "ERROR").otherwise(F.coalesce(F.try_element_at(known, act), F.upper(F.replace(act, F.lit("_"), F.lit(" ")))))


def output_summary(pred: Column, model: Column, score: Column, action: Column, status: Column, passed: Column, reason: Column,
                   limit: int | None = None) -> Column:
    """Pipe-joined record of what model and agent gave; missing numbers and texts are n/a."""
    def number(name: str, c: Column, digits: int, unit: str = "") -> Column:
        c = N.finite(c.cast("double"))
        return F.concat(F.lit(f"{name}="), F.coalesce(F.concat(fixed(c, digits), F.lit(unit)), F.lit("n/a")))

    return F.concat_ws(
        " | ", number("pred_ret_final", pred, 2, "%"), number("pred_ret_model", model, 6), number("xgb_rank_score", score, 3),
        F.concat(F.lit("agent_action="), F.coalesce(action, F.lit("n/a"))), F.concat(F.lit("agent_status="), F.coalesce(status, F.lit("n/a"))),
        F.concat(F.lit("agent_pass="), F.initcap(F.coalesce(passed, F.lit(False)).cast("string"))),
        F.concat(F.lit("agent_reason="), X.shorten(reason, limit)))
