"""The stored panel: buckets bounded by rows, ticks of hot days folded."""

import datetime as dt

import pytest

from panelweave.operators import windows as W
from panelweave.plans import panel_store as P
from panelweave.plans.fixtures import Tables
from panelweave.sources import sinks as K

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_buckets_follow_rows_not_compressed_bytes(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_ROWS", 250)
    monkeypatch.setattr(P, "_STORED", {})
    t = Tables(spark, FOLDER)
    n = t.raw("lineitem").count()
    assert P.bucket_count(spark, n) == -(-n // 250) > spark.sparkContext.defaultParallelism
    assert f"SelectedBucketsCount: {-(-n // 250)} out of" in plan(t.bars.groupBy("ticker").count())


def test_no_sort_before_ticks_are_dealt(spark):
    p = plan(Tables(spark, FOLDER).build_bars(4))
    assert p.count("Exchange") == 2 and "Sort" not in p[p.rindex("Exchange"):]


def test_a_hot_day_is_folded_whole(spark, tmp_path):
    day = dt.datetime(1997, 3, 1)
    rows = [(i, i % 7, 1, 1 + i % 5, float(1 + i % 3), float(100 + i * 37 % 1001), day) for i in range(3000)]
    rows += [(9000 + i, 1, 1, 6, 2.0, 50.0 + i, day + dt.timedelta(days=i)) for i in range(4)] + [(1, 1, 1, 7, 0.0, 5.0, day)]
    cols = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz"
    spark.createDataFrame(rows, cols).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.ticker_id, r.date): r for r in Tables(spark, str(tmp_path)).build_bars(3).collect()}
    want = {}
    for r in sorted(rows):
        if r[4] > 0:
            want.setdefault((r[3], r[6].date()), []).append((r[5] / r[4], r[4]))
    assert set(got) == set(want)
    for k, ticks in want.items():
        px = [p for p, _ in ticks]
        assert tuple(got[k][c] for c in ("open", "high", "low", "close")) == (px[0], max(px), min(px), px[-1])
        assert got[k].volume == pytest.approx(sum(q for _, q in ticks)) and got[k].ticker == f"T{k[0]}"


def test_batches_hold_the_same_sequences_and_sort_only_narrow_rows(spark, tmp_path):
    bars = Tables(spark, FOLDER).bars.select("ticker", "date", "close", "volume")
    got = K.batched_sequences(bars, ["close", "volume"], "day(date) > 3", rows=5, keys_per_batch=4)
    p = plan(got)
    last = p.index("collect_list")  # plans are printed from the end
    assert "Sort" not in p[:last] and "Exchange" not in p[:last]
    K.write_sequences(got, f"{tmp_path}/s")
    read = spark.read.parquet(f"{tmp_path}/s")
    want = W.window_sequences(bars, ["close", "volume"], 5).where("day(date) > 3")
    key = lambda r: (r.ticker, r.date)
    assert {key(r): r.seq for r in read.collect()} == {key(r): r.seq for r in want.collect()}
    tickers = sorted(r.ticker for r in bars.select("ticker").distinct().collect())
    assert {(r.ticker, r.batch) for r in read.select("ticker", "batch").distinct().collect()} <= {(k, i // 4) for i, k in enumerate(tickers)}


def test_a_back_test_reads_the_panel_for_its_tickers_and_runs_once(spark, monkeypatch):
    from panelweave.operators import aggregates as A, trades as TR
    from panelweave.plans.backtest import BacktestConfig, run_backtest

    t, seen = Tables(spark, FOLDER), []
    inner = W.positions
    monkeypatch.setattr(TR.X, "positions", lambda df, *a: (seen.append(df), inner(df, *a))[1])
    b = run_backtest(t.signals.where("ticker_id <= 3"), t.bars, t.market, BacktestConfig(start=None, end=None, holding_period=5))
    tickers = lambda df: {r.ticker for r in df.select("ticker").distinct().collect()}
    assert tickers(seen[0]) == tickers(b.picks) < tickers(t.bars) and tickers(seen[0]) <= {"T0", "T1", "T2", "T3"}
    monkeypatch.setattr(A, "var_cvar", lambda df, *a: df)
    assert "SortMergeJoin" not in plan(b.value_at_risk()) and "Window" not in plan(b.value_at_risk())
    recs = t.signals.where("ticker_id = 2").select("date", "ticker", "pred_return_pct", "rank_score", "current_price")
    TR.forward_tracker(recs, t.bars, t.market, 5)
    assert tickers(seen[-1]) == {"T2"}
