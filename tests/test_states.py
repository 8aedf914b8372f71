"""Mergeable scaler states, user aggregates and the pairwise ranker."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.operators import aggregates as A, features as M, user_aggregates as U


def test_merged_states_equal_one_pass(spark):
    rnd = random.Random(2)
    rows = [(i % 13, 1e6 + rnd.gauss(0, 1), rnd.choice([None, 3.0, rnd.random()])) for i in range(2000)]
    df = spark.createDataFrame(rows, "b int, x double, y double")
    whole = df.fillna(0.5)
    one = {r.feature: r for r in A.moments_state(whole, ["x", "y"]).collect()}
    parts = [A.moments_state(whole.where(F.col("b") % 3 == k), ["x", "y"], "b") for k in range(3)]
    merged = {r.feature: r for r in A.merge_states(A.merge_states(*parts[:2]), parts[2]).collect()}
    for c, i in (("x", 1), ("y", 2)):
        v = np.array([0.5 if r[i] is None else r[i] for r in rows])
        for s in (one[c], merged[c]):
            assert s.n == 2000 and s["mean"] == pytest.approx(v.mean(), rel=1e-12) and s.m2 == pytest.approx(((v - v.mean()) ** 2).sum(), rel=1e-8)
    # a batch with one missing value is left out as a whole
    bad = df.withColumn("y", F.when(F.col("b") == 4, F.col("y")).otherwise(F.lit(1.0)))
    got = A.scaler_fit(bad, ["x", "y"], "b").first()
    v = np.array([r[1] for r in rows if r[0] != 4])
    assert got["x_mean"] == pytest.approx(v.mean(), rel=1e-12) and got["x_scale"] == pytest.approx(v.std(), rel=1e-6) and got["y_scale"] == 1.0
    assert A.scaler_fit(df.where("false"), ["x"], "b").first()["x_mean"] is None


def test_user_aggregate_equals_built_ins(spark, monkeypatch):
    monkeypatch.setattr(U, "HELD_KEYS", 2)
    rows = [("hot" if i % 3 else f"k{i % 7}", i % 2, float(i)) for i in range(600)] + [(None, 1, 2.0), (None, None, 3.0)]
    df = spark.createDataFrame(rows, "k string, j int, v double").repartition(5)
    range_ = U.UserAggregate("lo double, hi double, n long", "spread double, n long", lambda: (float("inf"), float("-inf"), 0),
                             lambda s, d: (min(s[0], d["v"].min()), max(s[1], d["v"].max()), s[2] + len(d)),
                             lambda a, b: (min(a[0], b[0]), max(a[1], b[1]), a[2] + b[2]), lambda s: (s[1] - s[0], s[2]))
    got = {tuple(r) for r in U.aggregate(df, ["k", "j"], ["v"], range_).collect()}
    want = {tuple(r) for r in df.groupBy("k", "j").agg((F.max("v") - F.min("v")).alias("spread"), F.count("*").alias("n")).collect()}
    assert got == want
    assert U.aggregate(df.where("false"), ["k"], ["v"], range_).count() == 0


def test_pairwise_ranker_ignores_the_level_of_a_day(spark):
    rnd = random.Random(9)
    rows = []
    for day in range(60):
        level = rnd.gauss(0, 50)
        for i in range(25):
            x = [rnd.gauss(0, 1) for _ in range(3)]
            score = 2 * x[0] - x[1]
            # the level of the day hides the order from a model that looks at single rows, through a feature that follows it
            rows.append((day, f"T{i}", *x, level / 25 + rnd.gauss(0, 1), float(np.exp(score / 4)) + level, None))
    df = spark.createDataFrame([r[:-1] for r in rows] + [(0, "none", 1.0, 1.0, 1.0, 1.0, None), (1, "nan", float("nan"), 1.0, 1.0, 1.0, 1.0)],
                               "qid int, ticker string, a double, b double, c double, d double, label double")
    names = ["a", "b", "c", "d"]
    train, held = df.where("qid < 40"), df.where("qid >= 40")
    weights = M.fit_pairwise_ranker(train, names)
    assert weights == M.fit_pairwise_ranker(train.repartition(7), names) or np.allclose(weights, M.fit_pairwise_ranker(train.repartition(7), names), rtol=1e-4)
    assert weights[0] > 1 and weights[1] < -0.5 and abs(weights[2]) < 0.3 * weights[0] and weights[0] / -weights[1] == pytest.approx(2, rel=0.3)
    ndcg = lambda scored: scored.agg(F.avg("ndcg")).first()[0]
    pair = ndcg(M.ndcg_at_k(M.linear_scores(held, weights, names), 5))
    point = ndcg(M.ndcg_at_k(M.rank_scores(held, M.fit_rank_model(train.dropna(), names, iterations=10, depth=4), names), 5))
    assert pair > point
    pairs = M.training_pairs(train, names)
    assert pairs.count() <= 4 * train.count() and {r.target for r in pairs.select("target").distinct().collect()} == {0.0, 1.0}


def test_pairwise_weights_are_the_minimum_over_the_pairs(spark):
    """Groups lie across batches and blocks; the gradient of the documented loss, taken from the pairs themselves, vanishes."""
    rnd = random.Random(4)
    rows = [(day, f"T{i}", 1e3 * rnd.gauss(0, 1), rnd.gauss(0, 1), 7.0, rnd.gauss(0, 1)) for day in range(9) for i in range(day * 40 + 1)]
    df = spark.createDataFrame(rows, "qid int, ticker string, a double, b double, c double, label double")
    names = ["a", "b", "c"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        w = np.array(M.fit_pairwise_ranker(df, names, partners=3))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pairs = M.training_pairs(df, names, partners=3).collect()
    d, t = np.array([r["diff"] for r in pairs]), np.array([r.target for r in pairs])
    scale = d.std(0, ddof=1)
    slope = (d * (1 / (1 + np.exp(-d @ w)) - t)[:, None]).mean(0) + 1e-3 * w * scale**2
    assert w[2] == 0 and np.abs(slope[:2] / scale[:2]).max() < 1e-8


def test_rankers_store_narrow_rows_only(spark, monkeypatch):
    import __spark_entry__ as entry

    frames = type(spark.range(1))
    kept, plain = [], frames.checkpoint
    monkeypatch.setattr(frames, "checkpoint", lambda df, *a: kept.append(set(df.columns)) or plain(df, *a))
    assert entry.queries()["rank_model_pairwise"](spark, "/root/testdata/sf0.001").count() > 0
    assert kept == [{"qid", "ticker", "label", "score"}]
