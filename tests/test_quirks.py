"""Hand-computed small tables for the behaviours that are easy to get wrong."""

import datetime as dt
import json
import math
import random
import re

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from panelweave.functions import dates, numeric as N, rules as R, text as X
from panelweave.operators import aggregates as A, filters as P, grid as G, joins as J, ordering as O, sets as U, text as T, trades as TR, windows as W
from panelweave.sources import readers as S, sinks as K

DAY = dt.date(2024, 1, 1)


def series(spark, values, name="close", key="A"):
    data = [(key, DAY + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(data, f"ticker string, date date, {name} double")


def column(df, name):
    return [r[name] for r in df.orderBy("date").collect()]


def test_rsi_without_losses_is_50(spark):
    assert column(W.rsi(series(spark, range(1, 21))), "rsi_14") == [50.0] * 20


def test_vix_gets_both_transforms(spark):
    got = column(W.feature_transform(series(spark, [10, 11, 12, 9], "vix_close"), ["vix_close"]), "vix_close")
    assert got == pytest.approx([0, 0.1, -0.0090909, -0.3409091], abs=1e-6)


def test_pct_change_zero_base_and_bound(spark):
    assert column(W.pct_change(series(spark, [0, 5, 50]), ["close"], 5.0), "close") == [0.0, 0.0, 5.0]


def test_ewma_equals_pandas_over_many_chunks(spark):
    vals = [math.sin(i) * 10 + i % 7 for i in range(3000)]
    d = series(spark, vals)
    pos = d.withColumn("_pos", F.datediff("date", F.lit(DAY)))
    for alpha in (0.3, 1 / 14, 2 / 27):
        got = column(W.add_ewma(pos, {"y": W.Ewma("close", alpha)}), "y")
        want = pd.Series(vals).ewm(alpha=alpha, adjust=False).mean()
        assert got == pytest.approx(list(want), rel=1e-9, abs=1e-9)


def test_macd_and_rsi_equal_pandas(spark):
    c = pd.Series([100 + math.sin(i / 3) * 8 + (i * 37 % 11) for i in range(400)])
    m = c.ewm(span=12, adjust=False, min_periods=12).mean() - c.ewm(span=26, adjust=False, min_periods=26).mean()
    sig = m.ewm(span=9, adjust=False, min_periods=9).mean()
    got = W.macd(series(spark, c))
    assert column(got, "macd_line") == pytest.approx(list(m.fillna(0)), abs=1e-9)
    assert column(got, "macd_hist") == pytest.approx(list((m - sig).fillna(0)), abs=1e-9)
    d = c.diff()
    g = d.clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    lo = (-d.clip(upper=0)).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    want = (100 - 100 / (1 + g / lo)).fillna(50.0)
    assert column(W.rsi(series(spark, c)), "rsi_14") == pytest.approx(list(want), abs=1e-9)


def test_window_stats_are_exact_on_constant_stretches(spark):
    got = W.window_stats(series(spark, [1e6] * 5 + [3, 1, 2, 5, 4] + [7] * 6), ["close"], 4)
    std = column(got, "close_std")
    assert std[5] == 0.0 and std[-1] == 0.0
    assert std[9] == pytest.approx(pd.Series([3.0, 1, 2, 5]).std(ddof=0), abs=1e-6)


def test_rolling_beta_equals_pandas_and_defaults_to_one(spark):
    c = [100 + (i * 31 % 17) for i in range(150)]
    m = [50 + (i * 13 % 11) for i in range(150)]
    d = series(spark, c).join(series(spark, m, "spy_close").drop("ticker"), "date")
    s, b = pd.Series(c).pct_change(), pd.Series(m).pct_change()
    want = (s.rolling(60).cov(b) / b.rolling(60).var()).clip(-2, 3).fillna(1.0)
    assert column(W.rolling_beta(d), "beta") == pytest.approx(list(want), abs=1e-9)
    flat = series(spark, c).withColumn("spy_close", F.lit(5.0))
    assert set(column(W.rolling_beta(flat), "beta")) == {1.0}


def test_smoothed_events_use_only_earlier_days(spark):
    ev = series(spark, [1.0, None, 2.0], "v").dropna()
    bounds = spark.createDataFrame([("A", DAY, DAY + dt.timedelta(days=5))], "ticker string, first date, last date")
    got = column(W.ewma_calendar(ev, ["v"], bounds), "v")
    want = pd.Series([1.0, 0, 2.0, 0, 0, 0]).ewm(alpha=0.3, adjust=False).mean().shift(1)
    assert got[0] is None and got[1:] == pytest.approx(list(want)[1:])


def test_business_day_shift(spark):
    d = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (5, 6, 7, 8)], "d date")
    got = [r[0] for r in d.select(dates.add_business_days(F.col("d"), 1)).collect()]
    assert got == [dt.date(2024, 1, 8)] * 3 + [dt.date(2024, 1, 9)]
    for n in (1, 4, 5, 7, 23):
        got = [r[0] for r in d.select(dates.add_business_days(F.col("d"), n)).collect()]
        assert got == [(pd.Timestamp(2024, 1, x) + pd.offsets.BusinessDay(n)).date() for x in (5, 6, 7, 8)]


def test_asof_forward_and_nearest(spark):
    bars = series(spark, [10, None, 30]).dropna()
    sig = spark.createDataFrame([("A", DAY + dt.timedelta(days=1)), ("A", DAY + dt.timedelta(days=9))], "ticker string, date date")
    assert rows(J.entry_forward(sig, bars), "date", "entry_date") == [(DAY + dt.timedelta(days=1), DAY + dt.timedelta(days=2))]
    buys = sig.select("ticker", F.col("date").alias("buy_date"), F.lit(None).cast("double").alias("buy_price"))
    assert [r[1] for r in rows(J.entry_nearest(buys, bars), "buy_date", "entry_price")] == [30.0, 30.0]
    given = buys.withColumn("buy_price", F.lit(7.0))
    assert {r[0] for r in rows(J.entry_nearest(given, bars), "entry_price")} == {7.0}


def test_rank_pct_averages_ties(spark):
    d = spark.createDataFrame([(DAY, float(x)) for x in (1, 2, 2, 3)], "date date, s double")
    assert rows(O.rank_pct(d, "date", "s"), "rank_pct") == [(0.25,), (0.625,), (0.625,), (1.0,)]


def test_quantile_bins(spark):
    d = spark.createDataFrame([(i, float(i)) for i in range(9)], "id int, v double")
    got = O.quantile_bins(d, "v", 4, [F.col("id")], "b")
    assert [r["b"] for r in got.orderBy("id").collect()] == [0, 0, 0, 1, 1, 2, 2, 3, 3]


def test_exact_quantiles_equal_numpy(spark):
    vals = [float((i * 7919) % 503) for i in range(2000)]
    d = spark.createDataFrame([(i % 3, v) for i, v in enumerate(vals)], "k int, v double")
    got = {(r["k"], r["prob"]): r["q"] for r in O.exact_quantiles(d, ["k"], "v", [0.0, 0.05, 0.5, 0.95, 1.0]).collect()}
    for k in range(3):
        part = pd.Series(vals[k::3])
        for p in (0.0, 0.05, 0.5, 0.95, 1.0):
            assert got[(k, p)] == pytest.approx(part.quantile(p))


def test_win_rate_counts_missing_as_loss(spark):
    d = spark.createDataFrame([(1.0,), (-1.0,), (None,)], "a double")
    assert d.agg(N.share(F.col("a") > 0)).first()[0] == pytest.approx(1 / 3)


def test_nan_is_never_selected(spark):
    d = spark.createDataFrame([(float("nan"),), (float("inf"),), (2.0,), (None,)], "pred_return_pct double")
    assert P.select_signals(d, 1.0).count() == 1
    assert P.turnover_floor(d, 1.0, "pred_return_pct").count() == 1


def test_cascade_levels(spark):
    d = spark.createDataFrame([(1,), (5,)], "x int")
    assert rows(P.cascade_filter(d, [F.col("x") > 9, F.col("x") > 4, F.lit(True)]), "x", "tier") == [(5, 2)]
    assert P.cascade_filter(d, [F.col("x") > 9]).count() == 0


def test_replace_by_key_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "d int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d")], "d int, v string")
    once = K.replace_by_key(old, new, ["d"])
    assert rows(once) == rows(K.replace_by_key(once, new, ["d"])) == [(1, "a"), (2, "c"), (2, "d")]
    assert rows(K.insert_if_absent(old, new, ["d"])) == [(1, "a"), (2, "b")]


def test_last_final_recommendation_wins(spark):
    d = spark.createDataFrame([("Final Recommendation: BUY\nFinal Recommendation: **HOLD**",), ("Recommendation - Short",), ("we sell and buy",),
                               ("nothing",), ("Final Recommendation: maybe, we hold",)], "t string")
    assert [r[0] for r in d.select(X.recommendation(F.col("t"))).collect()] == ["hold", "short", "sell", "unknown", "hold"]
    assert d.select(X.recommendation(F.col("t"), ("buy", "sell", "hold"))).collect()[2][0] == "buy"


def test_confidence(spark):
    d = spark.createDataFrame([("Confidence: 75", "buy"), ("confidence 0.4", "buy"), ("none", "hold"), ("none", "buy"), ("Confidence 900", "buy")], "t string, r string")
    assert [r[0] for r in d.select(X.confidence(F.col("t"), F.col("r"))).collect()] == pytest.approx([0.75, 0.4, 0.4, 0.45, 1.0])
    long = F.lit("strong clear " * 40)
    assert d.select(X.confidence(F.lit("x"), F.lit("buy"), long)).first()[0] == pytest.approx(0.9)


def test_sections_end_at_next_heading(spark):
    text = "## Technical Analysis: up\nand up\n**Risk Assessment**: low\nTimeline: soon"
    got = T.extract_sections(spark.createDataFrame([(text,)], "text string")).first()
    assert (got["technical_analysis"], got["risk_assessment"], got["timeline"], got["catalysts"]) == ("up\nand up", "low", "soon", "")


def test_ticker_sources_in_order(spark):
    d = spark.createDataFrame([(1, "['a.b','', 'waytoolongname', 'A.B']", None), (2, None, '{"stocks":[],"tickers":["x"]}'), (3, "", None), (4, "[]", '{"stocks":["y"]}'),
                               (5, None, '{"stocks": "one", "tickers": ["two"]}'), (6, None, "no json"), (7, None, '{"stocks": {"a": 1}, "tickers": ["z", null, 5]}')],
                              "doc_id int, ticker string, extra string")
    assert rows(T.explode_tickers(d), "doc_id", "ticker", "long_name") == [
        (1, "A-B", False), (1, "WAYTOOLONGNAME", True), (2, "X", False), (3, "^GSPC", False), (5, "ONE", False), (6, "^GSPC", False), (7, "5", False), (7, "Z", False)]
    macro = rows(T.explode_tickers(d.withColumn("m", F.col("doc_id") < 4), macro="m"), "doc_id", "ticker")
    assert [r for r in macro if r[1] == "^GSPC"] == [(1, "^GSPC"), (2, "^GSPC"), (3, "^GSPC"), (6, "^GSPC")]


def test_dedupe_articles_keeps_first_and_is_idempotent(spark):
    d = spark.createDataFrame([(i, "A", "2020", "t", "same" if i < 50 else f"x{i}") for i in range(60)], "doc_id int, ticker string, date string, title string, content string")
    once = T.dedupe_articles(d)
    assert rows(once, "doc_id") == rows(T.dedupe_articles(once), "doc_id") == [(0,)] + [(i,) for i in range(50, 60)]


def test_symbols_with_marks_are_found_in_text(spark):
    docs = spark.createDataFrame([(1, "Sold brk-b, BRK.B. and AAPL-"), (2, "brk b")], "doc_id int, content string")
    known = spark.createDataFrame([("BRK-B",), ("BRK.B",), ("AAPL",), ("BRK",)], "symbol string")
    assert rows(T.entity_scan(docs, known)) == [(1, "AAPL"), (1, "BRK-B"), (1, "BRK.B"), (2, "BRK")]


@pytest.mark.parametrize("table_bytes", [1 << 20, 0])
def test_symbols_equal_an_ordered_alternation(spark, table_bytes):
    rnd = random.Random(7)
    letters, marks = "ABC\u00c9_9", "-. &^'"
    symbols = {"".join(rnd.choice(letters if rnd.random() < 0.75 else marks) for _ in range(rnd.randint(1, 7))) for _ in range(1000)} | {"^ABC", "A B C", "A.", "AB-"}
    texts = ["".join(rnd.choice(letters + letters.lower() if rnd.random() < 0.7 else marks + "\n\u00df") for _ in range(rnd.randint(0, 300))) for _ in range(120)] + [None, ""]
    titles = [rnd.choice([None, "ab", "a-b"]) for _ in texts]
    pattern = re.compile(r"\b(" + "|".join(map(re.escape, sorted((s for s in symbols if len(s) > 1), key=len, reverse=True))) + r")\b")
    want = sorted({(i, m) for i, (a, b) in enumerate(zip(titles, texts)) for m in pattern.findall(" ".join(x for x in (a, b) if x is not None).upper())})
    docs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(titles, texts))], "doc_id long, title string, content string").repartition(3)
    known = spark.createDataFrame([(s,) for s in sorted(symbols)], "symbol string")
    got = T.entity_scan(docs, known, title="title", table_bytes=table_bytes)
    assert rows(got) == sorted(want, key=repr) and len(want) > 500
    some = sorted(symbols)[::25]
    pattern = re.compile(r"\b(" + "|".join(map(re.escape, sorted((s for s in some if len(s) > 1), key=len, reverse=True))) + r")\b")
    hits = docs.select("doc_id", F.array_sort(T.dictionary_hits(F.concat_ws(" ", "title", "content"), some)).alias("h")).collect()
    assert {r.doc_id: r.h or [] for r in hits} == {i: sorted(set(pattern.findall(" ".join(x for x in (a, b) if x is not None).upper()))) for i, (a, b) in enumerate(zip(titles, texts))}


def test_price_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "ABC_daily.csv").write_text("Date,close,high,low,open,volume,Adj Close\n2024-01-02,4,3,2,1,5,6\n")
    assert rows(S.read_bars(spark, str(tmp_path)), "open", "close", "adj_close") == [(1.0, 4.0, 6.0)]
    (tmp_path / "ABC_daily.csv").write_text("Date,close\n2024-01-02,4\n")
    with pytest.raises(ValueError, match="open"):
        S.read_bars(spark, str(tmp_path))


def test_price_file_keeps_last_row_of_a_day(spark, tmp_path):
    (tmp_path / "ABC_daily.csv").write_text("Date,open,high,low,close,volume\n2024-01-02,1,1,1,1,1\n2024-01-02,2,2,2,2,2\nbad,3,3,3,3,3\n2024-01-03,4,4,4,x,4\n")
    assert rows(S.read_bars(spark, str(tmp_path)), "ticker", "date", "close") == [("ABC", dt.date(2024, 1, 2), 2.0)]


@pytest.mark.parametrize("folders", [False, True])
def test_panel_of_many_keys_needs_few_files(spark, tmp_path, folders):
    path = str(tmp_path / "bars")
    df = spark.range(600).selectExpr("concat('T', id % 300) as ticker", "cast(date_add(date'2024-01-01', cast(id div 300 as int)) as string) as Date",
                                     "1.5 as open", "2.0 as high", "1.0 as low", "id + 0.5 as close", "id as volume")
    K.write_bars_csv(df, path, folders=folders)
    files = [f for f in (tmp_path / "bars").rglob("*.csv")]
    assert len(files) == 300 if folders else len(files) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    (tmp_path / "bars" / "ONE_daily.csv").write_text("Date,open,high,low,close,volume\n2024-01-02,1,2,0,7.5,9\n")
    want = [(f"T{i % 300}", dt.date(2024, 1, 1 + i // 300), i + 0.5, float(i)) for i in range(600)] + [("ONE", dt.date(2024, 1, 2), 7.5, 9.0)]
    got = S.read_bars(spark, path)
    assert rows(got, "ticker", "date", "close", "volume") == sorted(want, key=repr)
    # headers and lines are parsed once each, not once for every column
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_csv(") <= 2


def test_files_of_one_key_are_ordered_by_number(spark, tmp_path):
    """The order of a row holds the number of its file, not the path; of one day in two files, the row of the later path stays."""
    for name, close in (("a", 1), ("c", 3), ("b", 2)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "K_daily.csv").write_text(f"Date,open,high,low,close,volume\n2024-01-02,1,1,1,{close},1\n")
    order = S.scan_csv(spark, str(tmp_path)).rows.schema["order"].dataType
    assert [f.name for f in order] == ["number", "b", "m"] and all(f.dataType.typeName() != "string" for f in order)
    assert rows(S.read_bars(spark, str(tmp_path)), "ticker", "close") == [("K", 3.0)]


def test_tagged_files_of_two_layouts(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a_forward.csv").write_text("Pred,Rank\n1,2\n")
    (tmp_path / "sub" / "final_ensemble_results_1.csv").write_text("Pred,Actual\n3,4\n")
    (tmp_path / "other.csv").write_text("Pred\n9\n")
    got = S.read_tagged(spark, str(tmp_path), ["*forward*.csv", "*ensemble_results*.csv"])
    assert rows(got, "Pred", "Rank", "Actual") == [("1", "2", None), ("3", None, "4")]


def test_many_files_of_three_layouts_and_broken_ones(spark, tmp_path):
    heads = ["Date,open,high,low,close,volume", "volume,Close,low,high,Open,Date,RSI 14", '"date","close","open","low","high","volume","note, long"']
    for i in range(90):
        day = f"2024-01-{i % 28 + 1:02d}"
        row = [f"{day},1,2,0,{i},9", f'9,{i},0,2,1,{day},50', f'"{day}","{i}","1","0","2","9","a, b"'][i % 3]
        (tmp_path / f"K{i}_daily.csv").write_text(f"{heads[i % 3]}\n{row}\n")
    got = S.read_bars(spark, str(tmp_path))
    assert rows(got, "ticker", "open", "high", "low", "close", "volume", "rsi_14") == sorted(
        [(f"K{i}", 1.0, 2.0, 0.0, float(i), 9.0, 50.0 if i % 3 == 1 else None) for i in range(90)], key=repr)
    (tmp_path / "BAD_daily.csv.gz").write_bytes(b"this is no archive")
    (tmp_path / "NONE_daily.csv").write_bytes(b"")
    (tmp_path / "LESS_daily.csv").write_text("Date,close\n2024-01-02,4\n")
    report = S.scan_csv(spark, str(tmp_path), None, S.BAR_COLUMNS, tidy=True).report.where("problem is not null")
    assert {(r.file.rsplit("/", 1)[1], r.problem) for r in report.collect()} == {
        ("BAD_daily.csv.gz", "unreadable"), ("LESS_daily.csv", "lacks open, high, low, volume")}
    with pytest.raises(ValueError, match="BAD_daily.csv.gz"):
        S.read_bars(spark, str(tmp_path))
    assert S.read_bars(spark, str(tmp_path), strict=False).count() == 90


def test_schema_detection():
    assert S.detect_signal_schema(["date", "PRED_RETURN_%", "Rank", "Actual_Alpha_%"]) == {"pred": "PRED_RETURN_%", "score": "Rank", "actual": "Actual_Alpha_%"}
    with pytest.raises(ValueError):
        S.detect_signal_schema(["my_pred", "Rank", "Actual"])
    assert S.detect_signal_schema(["my_pred", "Rank", "Actual"], loose=True)["pred"] == "my_pred"
    assert S.resolve(["Published_At", "MyHeadline"], S.NEWS_ALIASES)["title"] == "MyHeadline"


def test_stop_loss_exit(spark):
    path = spark.createDataFrame([(DAY, "A", i, r) for i, r in enumerate((0.0, -0.5, 0.2))], "date date, ticker string, i int, ret double")
    got = TR.detect_exits(path, -0.4, hold=3).orderBy("i").collect()
    assert [r["exec_ret"] for r in got] == pytest.approx([0.0, -0.4, 0.0])
    assert (got[0]["exit_i"], got[0]["exit_reason"], got[0]["total_return"]) == (1, "Hard Stop-Loss", pytest.approx(-0.4))


def test_stop_goes_before_profit_and_contradiction(spark):
    path = spark.createDataFrame([(DAY, "A", 0, -0.1, -9.0), (DAY, "A", 1, 0.9, 0.0)], "date date, ticker string, i int, ret double, day_pred double")
    got = TR.detect_exits(path, -0.05, 0.5, 0.0, 2).first()
    assert got["exit_reason"] == "Hard Stop-Loss" and got["exit_i"] == 0
    got = TR.detect_exits(path, -0.5, 0.5, 0.0, 2).orderBy("i").collect()
    assert got[0]["exit_reason"] == "Contradiction Exit" and [r["exec_ret"] for r in got] == pytest.approx([-0.1, 0.0])


def test_average_price_returns_do_not_telescope(spark):
    px = [(10.0, 12.0), (11.0, 15.0), (13.0, 13.0)]
    path = spark.createDataFrame([(DAY, "A", i, a, a, a, c) for i, (a, c) in enumerate(px)], "date date, ticker string, i int, open double, high double, low double, close double")
    got = [r["ret"] for r in TR.daily_returns(path, "AVG", 3).orderBy("i").collect()]
    p = [(3 * a + c) / 4 for a, c in px]
    assert got == pytest.approx([(12 - p[0]) / p[0], p[1] / p[0] - 1, (p[2] - 15) / 15])


def test_crosscheck_with_missing_values(spark):
    agent = spark.createDataFrame([("A", "Buy", None, "ok"), ("B", "buy", 0.9, "OK"), ("C", "buy", 0.1, "ok"), ("D", "hold", 0.9, "ok")],
                                  "ticker string, recommendation string, confidence double, status string")
    model = spark.createDataFrame([("A", 2.0, 0.0)], "ticker string, pred_return_pct double, rank_score double")
    got = R.crosscheck(agent, model, 0.5, 1.0, -0.5)
    assert rows(got, "ticker", "result") == [("A", "BUY_CONFIRMED"), ("B", "AI_ONLY_WATCH"), ("C", "AI_REJECT"), ("D", "AI_REJECT")]


def test_threshold_grid_on_a_small_table(spark):
    d = spark.createDataFrame([(1.0, 1.0, 5.0), (2.0, 1.0, -1.0), (3.0, 2.0, None), (3.0, 0.0, 7.0)], "pred double, score double, actual double")
    got = {(r["pred_min"], r["score_min"]): r for r in G.threshold_grid(d, preds=[1.0, 2.0], scores=[0.0, 1.0]).collect()}
    assert got[(1.0, 0.0)]["n"] == 4 and got[(1.0, 0.0)]["median_actual"] == 5.0
    assert got[(2.0, 1.0)]["n"] == 2 and got[(2.0, 1.0)]["mean_actual"] == -1.0 and got[(2.0, 1.0)]["win_rate"] == 0.0
    assert got[(1.0, 1.0)]["median_actual"] == 2.0


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "date date, ticker string, ret double, strategy_return double")
    assert A.var_cvar(empty, "ret").first().asDict() == dict.fromkeys(
        ["variance", "historical_var", "historical_cvar", "parametric_var", "parametric_cvar"], 0.0)
    assert A.trade_analytics(empty).first()["total_trades"] == 0
    assert O.exact_quantiles(empty, [], "ret", [0.5]).count() == 0
    nothing = spark.createDataFrame([], "pred double, score double, actual double")
    assert G.threshold_grid(nothing).count() == 0


def test_profit_factor_without_losses(spark):
    d = spark.createDataFrame([(0.1,), (0.2,)], "strategy_return double")
    assert A.trade_analytics(d).first()["profit_factor"] == math.inf


def test_consensus_ties_are_alphabetical(spark):
    d = spark.createDataFrame([("A", v, "x", 0.5) for v in ("SELL", "BUY", "SELL", "BUY", "HOLD")], "ticker string, verdict string, decision string, confidence double")
    got = A.consensus(d).first()
    assert (got["consensus"], got["votes"], got["verdicts"]) == ("BUY", 2, "BUY, HOLD, SELL")


def test_summary_text_and_json(spark):
    d = spark.createDataFrame([(3, 1234.5, 0.25, None)], "n int, pnl_usd double, rate double, gap double")
    assert dict(rows(A.summary_long(d))) == {"N": "3", "Pnl Usd": "1,234.50", "Rate": "0.2500", "Gap": "N/A"}
    assert json.loads(K.summary_json(d, {"src": "t"}).first()[0]) == {"n": 3, "pnl_usd": 1234.5, "rate": 0.25, "gap": None, "src": "t"}


def test_union_prefers_fresh_rows(spark):
    a, b = series(spark, [1, 2, 3]), series(spark, [9]).withColumn("date", F.date_add("date", 1))
    assert column(U.merge_prefer_last(a, b, ["ticker", "date"]), "close") == [1.0, 9.0, 3.0]


def test_summaries_print_the_exact_binary_value(spark):
    """2.675 lies below the tie and 0.125 on it; Python's own formatting is the rule."""
    values = [2.675, 0.125, 0.375, 1.005, -2.675, 584.405, 7773.035, -0.004, 0.0, 15.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    x = F.col("x")
    got = df.select("x", R.model_input_summary(F.lit("d"), F.lit("A"), x, x, x, x, F.lit(True), x, x, x, F.lit("")).alias("m"),
                    R.agent_input_summary(F.lit("d"), F.lit("A"), x, x, x, x, F.lit("")).alias("a")).collect()
    for r in got:
        v = r.x
        assert r.m == (f"date=d | ticker=A | current_price={v:.2f} | recent_20d_return={v:.2f}% | pred_ret_final={v:.2f}% | xgb_rank_score={v:.3f}"
                       f" | used_fallback=True | finbert_sentiment=pos:{v:.3f},neg:{v:.3f},neu:{v:.3f} | news_excerpt=n/a")
        price = f" | Current Price: ${v:.2f}" if v else ""
        assert r.a == f"Ticker: A | Date: d{price} | Recent 20D Return (Momentum): {v:+.2f}% | Sentiment Tone: neutral (positive:{v * 100:.1f}%, negative:{v * 100:.1f}%)"
