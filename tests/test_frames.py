"""Sliding frames, exponential means over gaps and frames of any length against pandas."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelweave.operators import features as M, windows as W
from panelweave.operators.frames import add_doubling_moments, add_frame_moments, frame_moments


def series(seed, n, holes, big=False):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        v = 100 + rnd.gauss(0, 5) if not (30 <= i < 95) else 50.0  # a constant stretch
        if big and i == 10:
            v = 1e150
        out.append(None if rnd.random() < holes else float("nan") if i == 20 else v)
    return out


@pytest.fixture(scope="module")
def panel(spark):
    rows = []
    for k, (n, holes) in enumerate([(1, 0), (59, 0), (200, 0.0), (260, 0.06), (130, 0.6), (61, 1.0)]):
        x, y = series(k, n, holes, big=True), series(k + 50, n, holes / 3)
        rows += [(f"K{k}", i, a, b) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "ticker string, date int, x double, y double").repartition(5)
    return df, pd.DataFrame(rows, columns=["ticker", "date", "x", "y"]).astype({"x": float, "y": float})


def same(a, b, rel=1e-9):
    return (a is None or math.isnan(a)) and (b is None or math.isnan(b)) or (a is not None and a == pytest.approx(b, rel=rel, abs=1e-9))


@pytest.mark.parametrize("rows,late", [(60, 0), (60, 1), (7, 0), (1, 2)])
def test_frame_moments(panel, rows, late):
    df, pdf = panel
    got = add_frame_moments(df, {"v": "x"}, rows, late, {"p": ("x", "y")}).toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)
    want = pdf.sort_values(["ticker", "date"]).reset_index(drop=True)
    both = want["x"].notna() & want["y"].notna()
    want["bx"], want["by"] = want["x"].where(both), want["y"].where(both)
    for k, g in want.groupby("ticker"):
        mine = got[got.ticker == k]
        for i in range(len(g)):
            f = g.iloc[max(0, i - late - rows + 1) : max(0, i - late + 1)]
            m = mine.iloc[i]
            n = int(f["x"].notna().sum())
            assert (m["_rows"], m["v_n"], m["p_n"]) == (len(f), n, int(f["bx"].notna().sum()))
            if n:
                dx = f["x"].dropna()
                assert same(m["v_mean"], dx.mean()) and same(m["v_m2"], ((dx - dx.mean()) ** 2).sum(), 1e-7)
                if dx.nunique() == 1 and len(f) == n:
                    assert m["v_m2"] == 0  # a constant frame has no spread at all, whatever lay before it
            if m["p_n"] > 1:
                bx, by = f["bx"].dropna(), f["by"].dropna()
                assert same(m["p_c"], ((bx - bx.mean()) * (by - by.mean())).sum(), 1e-6) and same(m["p_m2y"], ((by - by.mean()) ** 2).sum(), 1e-7)


def test_nan_and_large_values_leave_the_beta(spark):
    rnd = random.Random(1)
    m = [100.0]
    for _ in range(399):
        m.append(m[-1] * (1 + rnd.gauss(0, 0.01)))
    stock = [v * 2 for v in m]
    clean = spark.createDataFrame([("A", i, s, v) for i, (s, v) in enumerate(zip(stock, m))], "ticker string, date int, close double, spy_close double")
    bad = clean.withColumn("close", F.when(F.col("date") == 20, float("nan")).when(F.col("date") == 40, 1e300).otherwise(F.col("close")))
    a, b = (W.rolling_beta(d).orderBy("date").toPandas()["beta"] for d in (clean, bad))
    assert a.iloc[399] == pytest.approx(1.0, abs=1e-9) and b.iloc[102:].tolist() == pytest.approx(a.iloc[102:].tolist(), abs=1e-12)
    assert b.iloc[20:80].tolist() == [1.0] * 60


@pytest.mark.parametrize("alpha,least", [(1 / 14, 14), (2 / 13, 1), (0.5, 3), (0.01, 2)])
def test_ewma_over_gaps_equals_pandas(spark, panel, alpha, least):
    df, pdf = panel
    df = df.withColumn("x", F.when(F.col("x") < 1e100, F.col("x")))
    pdf = pdf.assign(x=pdf["x"].where(pdf["x"] < 1e100))
    got = W.add_ewma_present(df, {"s": W.GapEwma("x", alpha, least)}, pos="date").toPandas().sort_values(["ticker", "date"])
    want = pdf.groupby("ticker")["x"].apply(lambda s: s.ewm(alpha=alpha, adjust=False, min_periods=least).mean()).droplevel(0)
    for a, b in zip(got["s"], want.loc[pdf.sort_values(["ticker", "date"]).index]):
        assert same(a, b)


def test_ewma_over_a_very_long_gap_and_series(spark):
    values = {0: 5.0, 1: 6.0, 9000: 7.0, 9001: 8.0} | {i: float(i % 13) for i in range(9100, 14000)}
    n = 14000
    df = spark.createDataFrame([("A", i, values.get(i)) for i in range(n)], "ticker string, date int, x double")
    got = W.add_ewma_present(df, {"s": W.GapEwma("x", 0.3), "t": W.GapEwma("x", 0.02)}, pos="date").orderBy("date").toPandas()
    s = pd.Series([values.get(i) for i in range(n)], dtype=float)
    for name, alpha in (("s", 0.3), ("t", 0.02)):
        want = s.ewm(alpha=alpha, adjust=False).mean()
        assert all(same(a, b) for a, b in zip(got[name].iloc[::7], want.iloc[::7]))


def test_indicators_over_gaps_equal_pandas(panel):
    df, pdf = panel
    pdf = pdf.sort_values(["ticker", "date"]).reset_index(drop=True)
    pdf["x"] = pdf["x"].where(pdf["x"] < 1e100)
    df = df.withColumn("x", F.when(F.col("x") < 1e100, F.col("x")))
    rsi = W.rsi(df, close="x").toPandas().sort_values(["ticker", "date"])["rsi_14"].tolist()
    macd = W.macd(df, close="x").toPandas().sort_values(["ticker", "date"])
    at = 0
    for _, g in pdf.groupby("ticker"):
        d = g["x"].diff()
        up, down = (c.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() for c in (d.clip(lower=0), -d.clip(upper=0)))
        want = (100 - 100 / (1 + up / down.replace(0, float("nan")))).fillna(50)
        line = g["x"].ewm(span=12, adjust=False, min_periods=12).mean() - g["x"].ewm(span=26, adjust=False, min_periods=26).mean()
        signal = line.ewm(span=9, adjust=False, min_periods=9).mean()
        n = len(g)
        assert all(same(a, b, 1e-8) for a, b in zip(rsi[at : at + n], want))
        assert all(same(a, b, 1e-7) for a, b in zip(macd["macd_line"].iloc[at : at + n], line.fillna(0)))
        assert all(same(a, b, 1e-7) for a, b in zip(macd["macd_hist"].iloc[at : at + n], (line - signal).fillna(0)))
        at += n


def test_frames_of_any_length(spark, panel):
    df, pdf = panel
    levels = add_doubling_moments(df.withColumn("pos", F.col("date") + 1), "x", "y", 130)
    frames = df.select("ticker", (F.col("date") + 1).alias("pos"), (F.least(F.col("date") + 1, (F.col("date") * 7) % 130)).alias("len"))
    got = {(r.ticker, r.pos): r for r in frame_moments(frames, levels, "pos", "len").collect()}
    for k, g in pdf.sort_values("date").groupby("ticker"):
        for i in range(len(g)):
            n = min(i + 1, i * 7 % 130)
            f = g.iloc[i + 1 - n : i + 1].dropna()
            if n:
                r = got[k, i + 1]
                assert r.n == len(f)
                if len(f) > 1:
                    assert same(r.c, ((f.x - f.x.mean()) * (f.y - f.y.mean())).sum(), 1e-6) and same(r.m2y, ((f.y - f.y.mean()) ** 2).sum(), 1e-7)
            else:
                assert (k, i + 1) not in got


def test_sequences_carry_rows_over_batch_borders(spark, panel, monkeypatch):
    df, pdf = panel
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(W, "SEQUENCES", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = {(r.ticker, r.date): r.seq for r in W.window_sequences(df, ["x", "y"], 10).select("ticker", "date", "seq").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    n = 0
    for k, g in pdf.sort_values("date").groupby("ticker"):
        v = g[["x", "y"]].to_numpy("float32")
        for i in range(10, len(g)):
            assert [x for row in got[k, i] for x in row] == pytest.approx(v[i - 10 : i].ravel().tolist(), nan_ok=True)
            n += 1
    assert n == len(got)


@pytest.fixture(scope="module")
def priced(spark):
    """Prices with gaps, NaN, zeros, constant stretches and a key without a name; keys shorter and longer than a frame."""
    rnd, rows = random.Random(11), []
    odd = [None, float("nan"), float("inf"), 0.0, -1.0, 1e150]
    for k, n in enumerate((1, 7, 8, 9, 40, 61, 200, 203)):
        for i in range(n):
            price = lambda share=0.04, k=k, i=i: rnd.choice(odd) if k > 3 and rnd.random() < share else 50.0 if 20 < i < 35 else 100 + rnd.gauss(0, 5)
            market = 10 + (i % 5 if k % 2 else 0)
            rows.append((None if k == 5 else f"K{k}", i, price(), price(), price(), None if i == 50 else float(market), float(market)))
    return spark.createDataFrame(rows, "ticker string, date int, open double, close double, x double, spy_open double, spy_close double").repartition(5)


@pytest.mark.parametrize("batch", [7, 10_000])
@pytest.mark.parametrize("variant,rows,horizon", [("tabular", 8, 3), ("sequence", 60, 20), ("inference", 7, 1), ("tabular", 1, 2)])
def test_labelled_stats_are_those_of_the_single_operators(spark, priced, monkeypatch, variant, rows, horizon, batch):
    monkeypatch.setattr(W, "BLOCKS", 3)
    cols, by = ["open", "x"], ["ticker", "date"]
    steps = W.forward_alpha_label(W.window_stats(W.rolling_beta(priced, rows=rows), cols, rows), variant, horizon, rows)
    names = [*by, "label", "actual_return_pct", *[f"{c}_{s}" for c in cols for s in ("last", "mean", "std")]]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = sorted(map(repr, W.labelled_stats(priced, cols, rows, variant, horizon).select(*names).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(map(repr, steps.select(*names).collect())) and len(got) > 100


def test_training_matrix_sorts_its_rows_once(priced):
    """Sorted again and again with the running sums of all frames, a pass over the rows took most of the time of `rank_model`."""
    panel = priced.withColumns({"date": F.date_add(F.lit("1995-12-01").cast("date"), F.col("date")), "volume": F.lit(1.0)})
    matrix = M.training_matrix(panel, ["open", "close", "volume"], M.feature_stats(panel, ["open", "close", "volume"], "1996-01-01"))
    plan = matrix._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Sort [") <= 2  # one for the statistics of the features, one for the rows


def test_a_change_reads_its_previous_value_once(priced):
    plan = W.diff(W.pct_change(priced, ["open", "close"], 0.5), ["x"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lag(") == 3
