"""Model-facing features: scaling, projection, training matrix, splits, ranking model, scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelweave.functions import dates, numeric as N
from panelweave.operators import aggregates as A, filters as P, ordering as O, windows as X


def scale_transform(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / scale with the one-row table of `scaler_fit`, read as a scalar subquery."""
    s = stats.select(F.struct(*stats.columns)).scalar()
    out = df.withColumn("_s", s)
    return out.withColumns({c: (F.col(c) - F.col(f"_s.{c}_mean")) / F.col(f"_s.{c}_scale") for c in cols}).drop("_s")


def scale_vectors(df: DataFrame, dim: int, vec: str = "emb", fit_on: DataFrame | None = None) -> DataFrame:
    """Standardise a fixed-width vector column element by element."""
    src = fit_on if fit_on is not None else df
    at = lambda i: F.get(F.col(vec), F.lit(i)).cast("double")
    sd = lambda i: F.stddev_pop(at(i))
    stats = src.agg(F.struct(F.array(*[F.avg(at(i)) for i in range(dim)]).alias("m"),
                             F.array(*[F.when(sd(i) == 0, 1.0).otherwise(sd(i)) for i in range(dim)]).alias("s")).alias("st"))
    out = df.withColumn("_s", stats.scalar())
    centred = F.zip_with(F.col(vec), F.col("_s.m"), lambda x, m: x.cast("double") - m)
    return out.withColumn(vec, F.zip_with(centred, F.col("_s.s"), lambda x, s: x / s)).drop("_s")


def fit_pca(sample: DataFrame, k: int = 28, vec: str = "emb"):
    """Principal components of a standardised sample; the sign of each component is arbitrary."""
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(sample.select(array_to_vector(F.col(vec)).alias("_v")))


def project_pca(df: DataFrame, model, vec: str = "emb", out: str = "reduced") -> DataFrame:
    v = df.withColumn("_v", array_to_vector(F.col(vec)))
    return model.transform(v).withColumn(out, vector_to_array("_p")).drop("_v", "_p")


def _aligned(panel: DataFrame, features: Sequence[str], bound: float | None) -> DataFrame:
    keep = {f"_raw_{c}": F.col(c) for c in ("open", "close", "spy_open", "spy_close")}
    return P.align(X.feature_transform(panel.withColumns(keep), features, bound), features, keep=["ticker", "date", *keep])


def feature_stats(panel: DataFrame, features: Sequence[str], burn_in: str, bound: float | None = None) -> DataFrame:
    """Mean and deviation of the transformed and aligned features on rows before `burn_in`, as :func:`training_matrix` fits them."""
    return A.scaler_fit(_aligned(panel, features, bound).where(F.col("date") < F.lit(burn_in).cast("date")), features)


def training_matrix(panel: DataFrame, features: Sequence[str], stats: DataFrame | None = None, burn_in: str | None = None,
                    variant: str = "tabular", bound: float | None = None, lookback: int = 60, horizon: int = 20) -> DataFrame:
    """Label, query id and last/mean/std of each scaled feature for every target row.

    `panel` holds prices with the market columns. Raw prices are kept aside for
    beta and label; features are transformed, aligned and scaled (by `stats`, or
    fitted on rows before `burn_in`). All windows share one shuffle by ticker.
    Filter the tickers of `panel`, not the matrix: filters don't move past its Arrow batches.
    """
    aligned = _aligned(panel, features, bound)
    if stats is None and burn_in is not None:
        stats = feature_stats(panel, features, burn_in, bound)
    scaled = scale_transform(aligned, stats, features) if stats is not None else aligned
    rows = X.labelled_stats(scaled, features, lookback, variant, horizon, open_="_raw_open", close="_raw_close",
                            mopen="_raw_spy_open", mclose="_raw_spy_close")
    names = [f"{c}_{s}" for s in ("last", "mean", "std") for c in features]
    return rows.select("ticker", "date", dates.yyyymmdd(F.col("date")).alias("qid"), "label", *names)


def feature_names(features: Sequence[str]) -> list[str]:
    """Feature order of the matrix: all last values, then all means, then all deviations."""
    return [f"{c}_{s}" for s in ("last", "mean", "std") for c in features]


def split_train_val(df: DataFrame, key: str = "ticker", buckets: int = 20, share: float = 0.8) -> DataFrame:
    """Add split: the first 80% of key buckets train, the rest validate, each with at least one bucket.

    A key never falls into both parts.
    """
    cut = min(max(1, int(buckets * share)), buckets - 1) if buckets > 1 else buckets
    b = F.pmod(F.xxhash64(key), F.lit(buckets))
    return df.withColumn("bucket", b).withColumn("split", F.when(F.col("bucket") < cut, "train").otherwise("validation"))


def fit_rank_model(matrix: DataFrame, features: Sequence[str], iterations: int = 20, depth: int = 5, seed: int = 42) -> PipelineModel:
    """Gradient-boosted regression of the label, used as a per-day ranking score."""
    data = matrix.select("label", array_to_vector(F.array(*features)).alias("features"))
    return GBTRegressor(labelCol="label", featuresCol="features", predictionCol="score", maxIter=iterations,
                        maxDepth=depth, seed=seed, subsamplingRate=0.8).fit(data)


def _whole(features: Sequence[str], label: str) -> Column:
    whole = F.col(label).isNotNull()
    for f in features:
        whole = whole & N.finite(F.col(f).cast("double")).isNotNull()
    return whole


def training_pairs(matrix: DataFrame, features: Sequence[str], group: str = "qid", key: str = "ticker", label: str = "label",
                   partners: int = 4, seed: int = 42) -> DataFrame:
    """Pairs of rows of one group (day) with different labels: `diff` of their features, `target` 1 where the first has the larger label.

    Each row meets the next `partners` rows in an order drawn by `seed`, so a group of n rows gives at most n * partners pairs.
    Rows without a label or with a missing feature are left out.
    """
    row = F.struct(F.array(*[F.col(f).cast("double") for f in features]).alias("x"), F.col(label).cast("double").alias("y"))
    w = W.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), key), key)
    d = matrix.where(_whole(features, label)).select(group, key, row.alias("a"))
    d = d.select(group, "a", *[F.lead("a", k).over(w).alias(f"b{k}") for k in range(1, partners + 1)])
    d = d.select(group, "a", F.explode(F.array(*[f"b{k}" for k in range(1, partners + 1)])).alias("b")).where("b is not null and a.y <> b.y")
    return d.select(group, F.zip_with("a.x", "b.x", lambda p, q: p - q).alias("diff"), (F.col("a.y") > F.col("b.y")).cast("double").alias("target"))


def _pair_blocks(matrix: DataFrame, features: Sequence[str], group: str, key: str, label: str, partners: int, seed: int, parts: int | None):
    """RDD of blocks: (bytes of rows [place in the group, label, features], number of leading rows that belong to the block before).

    The rows and their order are those of :func:`training_pairs`. They move once, and pairs are never laid out: a block holds the
    rows before it that its own rows are paired with.
    """
    w = W.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), key), key)
    d = matrix.where(_whole(features, label)).select(group, key, F.col(label).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)])
    d = d if parts is None else d.repartition(parts, group)
    d = d.select(F.row_number().over(w).cast("double").alias("_place"), "_y", *[f"_x{i}" for i in range(len(features))])

    def pack(batches):
        held = np.zeros((0, len(features) + 2))
        for b in batches:
            rows = np.concatenate((held, np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)])))
            yield pa.RecordBatch.from_pydict({"rows": pa.array([rows.tobytes()], pa.binary()), "held": pa.array([len(held)], pa.int32())})
            held = rows[-partners:]

    return d.mapInArrow(pack, "rows binary, held int").rdd


def fit_pairwise_ranker(matrix: DataFrame, features: Sequence[str], group: str = "qid", key: str = "ticker", label: str = "label",
                        partners: int = 4, rounds: int = 50, ridge: float = 1e-3, seed: int = 42, parts: int | None = None) -> list[float]:
    """Weights of a linear score that orders rows within a group: logistic loss of score differences over `training_pairs`.

    The mean loss plus `ridge` / 2 times the squared weights of features in units of their deviation over the pairs is minimised by Newton's
    method; a step that doesn't lower it is halved. Sums of each round, of the size of the features, are made in the tasks and
    joined in a tree. Rows are dealt by group once (to `parts` partitions); no round stores rows or pairs. What all rows of a
    day share cancels out of every pair, so the level of a day doesn't matter.
    """
    blocks = _pair_blocks(matrix, features, group, key, label, partners, seed, parts)
    n = len(features)
    weights, step, best, scale = np.zeros(n), np.zeros(n), np.inf, None

    def sums(block, at):
        """Number, loss, gradient, curvature, differences and their squares, summed over the pairs of a block."""
        rows = np.frombuffer(block["rows"]).reshape(-1, n + 2)
        place, y, x = rows[:, 0], rows[:, 1], rows[:, 2:]
        out = nothing()
        for k in range(1, partners + 1):
            j = np.arange(max(block["held"], k), len(rows))
            j = j[(place[j] > k) & (y[j] != y[j - k])]
            d = x[j - k] - x[j]
            z, first = d @ at, y[j - k] > y[j]
            p = 0.5 + 0.5 * np.tanh(z / 2)
            loss = (np.logaddexp(0, z) - np.where(first, z, 0)).sum()
            out = add(out, (len(j), loss, d.T @ (p - first), (d * (p * (1 - p))[:, None]).T @ d, d.sum(0), (d * d).sum(0)))
        return out

    def nothing():
        return np.zeros(()), np.zeros(()), np.zeros(n), np.zeros((n, n)), np.zeros(n), np.zeros(n)

    def add(a, b):
        return tuple(u + v for u, v in zip(a, b))

    for _ in range(rounds):
        tried = weights + step
        count, loss, slope, curve, d1, d2 = blocks.map(lambda b, at=tried: sums(b, at)).treeAggregate(nothing(), add, add)
        if not count:
            break
        if scale is None:
            scale = np.sqrt(np.maximum(d2 - d1 * d1 / count, 0) / max(count - 1, 1))
            used = scale > 0
        cost = loss / count + ridge / 2 * ((tried * scale) ** 2).sum()
        if not cost < best:
            step = step / 2
            if np.abs(step * scale).max() < 1e-12:
                break
            continue
        gain, best, weights = best - cost, cost, tried
        if gain <= 1e-13 * max(1.0, abs(cost)):
            break
        s = np.where(used, scale, 1.0)
        slope = (slope / count / s + ridge * tried * s)[used]
        curve = (curve / count / np.outer(s, s) + ridge * np.eye(n))[np.ix_(used, used)]
        step = np.zeros(n)
        step[used] = -np.linalg.solve(curve, slope) / s[used]
    return weights.tolist()


def linear_scores(matrix: DataFrame, weights: Sequence[float], features: Sequence[str], out: str = "score") -> DataFrame:
    return matrix.withColumn(out, sum((F.col(f) * w for f, w in zip(features, weights)), F.lit(0.0)))


def rank_scores(matrix: DataFrame, model, features: Sequence[str]) -> DataFrame:
    return model.transform(matrix.withColumn("features", array_to_vector(F.array(*features)))).drop("features")


def ndcg_at_k(scored: DataFrame, k: int = 10, group: str = "qid", score: str = "score", label: str = "label") -> DataFrame:
    """NDCG@k per group with the label shifted to be non-negative as gain.

    Only the top k rows by score and by label are kept per group, so a large
    group never gathers in one task.
    """
    low = scored.agg(F.min(label)).scalar()
    s = scored.select(group, "ticker", score, (F.col(label) - low).alias("gain"))

    def dcg(by: str, out: str) -> DataFrame:
        order = [F.col(by).desc(), F.col("ticker").asc()]
        top = O.top_n_per_group(s, k, group, order)
        r = F.row_number().over(W.partitionBy(group).orderBy(*order))
        return top.withColumn("_r", r).groupBy(group).agg(F.sum(F.col("gain") / F.log2(F.col("_r") + 1)).alias(out))

    both = dcg(score, "dcg").join(dcg("gain", "ideal"), group)
    return both.select(group, F.coalesce(N.ratio(F.col("dcg"), F.col("ideal")), F.lit(1.0)).alias("ndcg"))


def batch_score(df: DataFrame, inputs: Sequence[str], loader: Callable[[], object], fn: Callable[[object, pd.DataFrame], pd.DataFrame],
                schema: str, out: str = "scored") -> DataFrame:
    """Apply a caller's model to Arrow batches; `loader` runs once per Python worker task.

    `fn(model, batch)` gets the input columns and returns the struct columns of
    `schema`. Batch size follows spark.sql.execution.arrow.maxRecordsPerBatch.
    Place filters and top-k before this call: the optimizer does not move them past it.
    """
    @F.pandas_udf(schema)
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        model = loader()
        for cols in batches:
            yield fn(model, pd.concat(list(cols), axis=1, keys=list(inputs)))

    return df.withColumn(out, score(*[F.col(c) for c in inputs]))


def score_panel(scored: DataFrame, price: str = "current_price", pred: str = "pred", rank: str = "rank") -> DataFrame:
    """Published columns of a scored panel: price and prediction to 2 decimals, rank score to 4.

    Sort by (date, ticker) when presenting it.
    """
    return scored.select("date", "ticker", N.half_even(F.col(price), 2).alias("current_price"),
                         N.half_even(F.col(pred), 2).alias("pred_return_pct"), N.half_even(F.col(rank), 4).alias("rank_score"))


def realized_outcome(panel: DataFrame, min_volume: float = 750_000, min_price: float = 5.0, start: str | None = None,
                     horizon: int = 20, lookback: int = 60) -> DataFrame:
    """Realised return and alpha of every fully realised target row that passes the trailing liquidity gate.

    The gate is evaluated on the whole history, before early rows are dropped.
    """
    w = X.by()
    prior = w.rowsBetween(-20, -1)
    gated = panel.withColumn("_liquid", (F.row_number().over(w) <= 20) | (
        (F.avg("volume").over(prior) >= min_volume) & (F.avg("close").over(prior) >= min_price)))
    lab = X.forward_alpha_label(X.rolling_beta(gated, rows=lookback), "inference", horizon, lookback).where("_liquid")
    if start is not None:
        lab = lab.where(F.col("date") >= F.lit(start).cast("date"))
    return lab.select("date", "ticker", N.half_even(F.col("open"), 2).alias("current_price"),
                      N.half_even(F.col("actual_return_pct"), 2).alias("actual_20d_return_pct"),
                      N.half_even(F.col("label"), 2).alias("actual_alpha_pct"))
