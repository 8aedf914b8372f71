"""Radix selection against sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.operators import grid as G, ordering as O, selection as S


def values(seed, n):
    rnd = random.Random(seed)
    kinds = [lambda: rnd.gauss(0, 1), lambda: rnd.choice([0.0, -0.0, 1.0, 1e-300, -1e-300, 5e300, -5e300]), lambda: 1.0 + rnd.randrange(50) * 2.0 ** -52,
             lambda: rnd.choice([3.25] * 3 + [rnd.random()]), lambda: float(rnd.randrange(-5, 5))]
    return [None if rnd.random() < 0.05 else rnd.choice(kinds)() for _ in range(n)]


def test_bins_keep_the_order(spark):
    x = sorted(v for v in values(1, 3000) if v is not None)
    got = spark.createDataFrame([(v,) for v in x], "v double").orderBy("v").select(S.order_bin(F.col("v")).alias("b")).collect()
    assert all(a.b <= b.b for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("small", [4096, 3])
@pytest.mark.parametrize("n", [0, 1, 2, 9, 2000])
def test_select_rows_equals_sorting(spark, monkeypatch, small, n):
    monkeypatch.setattr(S, "SMALL", small)
    rnd = random.Random(n)
    rows = [(v, rnd.choice([None, 1, 2, 3]), i) for i, v in enumerate(values(n, n))]
    df = spark.createDataFrame(rows, "v double, t int, id long").repartition(3)
    order = sorted(((v, t, i) for v, t, i in rows if v is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
    ranks = lambda m: sorted({0, m // 3, m // 2, m - 1})
    got = S.select_rows(df, {"a": (["v", "t", "id"], ranks), "b": (["id"], lambda m: [m - 1])})
    assert got["a"] == (len(order), [tuple(None if x is None else float(x) for x in order[r]) for r in (ranks(len(order)) if order else [])])
    assert got["b"] == (n, [(float(n - 1),)] if n else [])


@pytest.mark.parametrize("small", [1_000_000, 5])
def test_group_quantiles_equal_numpy(spark, small):
    rows = [(k, v) for k in range(4) for v in values(k, [900, 7, 1, 300][k])]
    df = spark.createDataFrame(rows, "k int, v double").repartition(4)
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 1.0]
    got = {(r.k, r.prob): r.q for r in S.group_quantiles(df, ["k"], "v", probs, small=small).collect()}
    for k in range(4):
        x = np.array([v for g, v in rows if g == k and v is not None])
        if len(x):
            assert [got[k, p] for p in probs] == pytest.approx(list(np.quantile(x, probs)), rel=1e-12, abs=1e-12)
    one = S.interpolated(df, ["v"], probs)["v"]
    assert one == pytest.approx(list(np.quantile([v for _, v in rows if v is not None], probs)), rel=1e-12)


def test_bins_with_missing_ties(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([1.0, 2.0, 2.0, None]), rnd.choice([None, 1, 2]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "v double, t int, id long")
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
    want = {r[2]: max(0, -(-(i * 7) // (len(order) - 1)) - 1) for i, r in enumerate(order)}
    assert {r.id: r.b for r in O.quantile_bins(df, "v", 7, ["t", F.col("id")], "b").collect()} == want


@pytest.mark.parametrize("small", [2000, 4])
def test_grid_medians(spark, monkeypatch, small):
    monkeypatch.setattr(G, "CELL_SMALL", small)
    rnd = random.Random(5)
    rows = [(rnd.gauss(0, 1), rnd.choice([0.0, 0.5, rnd.random()]), rnd.choice([None, rnd.gauss(0, 9), 2.5])) for _ in range(800)]
    df = spark.createDataFrame(rows, "pred double, score double, actual double").repartition(3)
    for r in G.threshold_grid(df, 6).collect():
        inside = [a for p, s, a in rows if p >= r.pred_min and s >= r.score_min]
        known = [a for a in inside if a is not None]
        assert r.n == len(inside) and (r.median_actual == pytest.approx(float(np.median(known))) if known else r.median_actual is None)


def test_no_sort_of_the_rows(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).cast("double").alias("v"), "id")
    plan = O.quantile_bins(df, "v", 10, ["id"], "b")._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan
