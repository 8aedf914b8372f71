"""Toxicity by classifier chains of linear models.

Categories are predicted one after the other; each model sees hashed words and the
probabilities of all earlier categories. For training these are out-of-fold: a document's
earlier probabilities come from models that did not see it. Training uses at most
MAX_TRAIN labelled documents (those with the smallest hash of their id); scoring reads
every document whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from panelweave.llm.common import columns

#: Most labelled documents used for training, folds, and words kept for each category.
MAX_TRAIN, FOLDS, VOCABULARY = 8000, 4, 600
_WORD = re.compile(r"[^\W\d_]+")


#: Lengths of the word beginnings that count as features besides whole words.
BEGINNINGS = (5, 7)


def _features(word: str) -> list[int]:
    """Hashes of a word and of its beginnings."""
    return [xxhash.xxh3_64_intdigest(word), *(xxhash.xxh3_64_intdigest(word[:n] + "*") for n in BEGINNINGS if len(word) >= n)]


def word_hashes(text: str | None) -> set[int]:
    """Hashes of the distinct words of a text in lower case and of their beginnings; a null text has none."""
    return {h for w in set(_WORD.findall((text or "").lower())) for h in _features(w)}


def _chosen(rows: list[np.ndarray], y: np.ndarray, most: int, least: int = 5) -> np.ndarray:
    """Word hashes that depend most on the category (chi square), among those of at least `least` documents."""
    every = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    word, back, n = np.unique(every, return_inverse=True, return_counts=True)
    hit = np.bincount(back, weights=np.repeat(y, [len(r) for r in rows]), minlength=len(word))
    expected = n * y.mean()
    score = (hit - expected) ** 2 / np.maximum(expected * (1 - y.mean()), 1e-9)
    score[n < least] = -1
    top = np.argsort(-score, kind="stable")[:most]
    return np.sort(word[top[score[top] >= 0]])


def _matrix(rows: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    x = np.zeros((len(rows), len(words)), np.float32)
    for i, r in enumerate(rows):
        at = np.searchsorted(words, r)
        ok = at < len(words)
        at, r = at[ok], r[ok]
        x[i, at[words[at] == r]] = 1
    return x


def _fit(x: np.ndarray, y: np.ndarray, l2: float = 5e-5, rounds: int = 400) -> np.ndarray:
    """Logistic regression with an unpenalised last weight, by accelerated gradient steps."""
    x = np.hstack((x, np.ones((len(x), 1), np.float32)))
    w = look = np.zeros(x.shape[1], np.float32)
    rate = 4 / max(float((x * x).sum(1).mean()), 1.0)
    for k in range(rounds):
        grad = x.T @ (1 / (1 + np.exp(-(x @ look))) - y).astype(np.float32) / len(x)
        grad[:-1] += l2 * look[:-1]
        new = look - rate * grad
        look, w = new + k / (k + 3) * (new - w), new
    return w


def _predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def train_chain(labelled: DataFrame, categories: list[str], max_train: int = MAX_TRAIN, folds: int = FOLDS) -> list[dict]:
    """Chain of models from rows (doc_id, text, one 0/1 column for each category), in the order of `categories`.

    Rows with a null id or category are not used. The sample of at most `max_train` rows is the one with the
    smallest hashes of doc_id; only its distinct word hashes reach the driver. A category of one
    value gets its base rate.
    """
    rows = labelled.where(" and ".join(f"`{c}` is not null" for c in ["doc_id", *categories]))
    picked = rows.select("doc_id", F.xxhash64(F.lit(7), "doc_id").alias("order")).distinct().orderBy("order").limit(max_train)
    sample = rows.join(F.broadcast(picked), "doc_id")

    def run(batches):
        for ids, texts, order, *ys in columns(batches, "doc_id", "text", "order", *categories):
            yield pa.RecordBatch.from_pydict({
                "order": pa.array(order, pa.int64()), "words": pa.array([np.fromiter(sorted(word_hashes(t)), np.uint64).tobytes() for t in texts], pa.binary()),
                "y": pa.array([list(map(int, y)) for y in zip(*ys)], pa.list_(pa.int32()))})

    found = sorted(sample.mapInArrow(run, "order long, words binary, y array<int>").collect(), key=lambda r: (r["order"], r["words"], r["y"]))
    words = [np.frombuffer(r["words"], np.uint64) for r in found]
    y = np.array([r["y"] for r in found], np.float32).reshape(len(found), len(categories))
    fold = np.arange(len(found)) % folds
    earlier = np.zeros((len(found), 0), np.float32)
    chain = []
    for c, name in enumerate(categories):
        t = y[:, c]
        if len(found) < 2 * folds or t.min() == t.max():
            chain.append({"name": name, "words": np.zeros(0, np.uint64), "weights": None, "rate": float(t.mean()) if len(t) else 0.0})
            earlier = np.hstack((earlier, np.full((len(found), 1), chain[-1]["rate"], np.float32)))
            continue
        chosen = _chosen(words, t, VOCABULARY)
        x = np.hstack((_matrix(words, chosen), earlier))
        out = np.zeros(len(found), np.float32)
        for f in range(folds):
            out[fold == f] = _predict(x[fold == f], _fit(x[fold != f], t[fold != f]))
        chain.append({"name": name, "words": chosen, "weights": _fit(x, t), "rate": float(t.mean())})
        earlier = np.hstack((earlier, out[:, None]))
    return chain


def score(docs: DataFrame, chain: list[dict], threshold: float = 0.5) -> DataFrame:
    """doc_id, p_<category> (6 digits) for each category and <category> (p >= threshold) for every document.

    A null or empty text has no words and gets the probabilities of the intercepts. Repeated rows are scored
    alike; other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [m["name"] for m in chain]

    def run(batches):
        models = shared.value
        every = {int(h): [] for m in models for h in m["words"]}
        for c, m in enumerate(models):
            for h, w in zip(m["words"].tolist(), (m["weights"] if m["weights"] is not None else ())):
                every[h].append((c, float(w)))
        memo: dict[str, tuple] = {}
        for ids, texts in columns(batches, "doc_id", "text"):
            p = np.zeros((len(texts), len(models)))
            for i, t in enumerate(texts):
                total = [0.0] * len(models)
                if len(memo) > 400_000:
                    memo.clear()
                known: set[int] = set()
                for w in set(_WORD.findall((t or "").lower())):
                    hit = memo.get(w)
                    if hit is None:
                        hit = memo[w] = tuple(h for h in _features(w) if h in every)
                    known.update(hit)
                for h in sorted(known):  # one order of additions, so equal texts score alike
                    for c, v in every[h]:
                        total[c] += v
                for c, m in enumerate(models):
                    if m["weights"] is None:
                        p[i, c] = m["rate"]
                    else:
                        n = len(m["words"])
                        z = total[c] + float(p[i, :c] @ m["weights"][n : n + c]) + float(m["weights"][-1])
                        p[i, c] = 1 / (1 + np.exp(-min(max(z, -30), 30)))
            cols = {"doc_id": pa.array(ids, pa.int64())}
            cols |= {f"p_{n}": pa.array(np.round(p[:, c], 6)) for c, n in enumerate(names)}
            yield pa.RecordBatch.from_pydict(cols | {n: pa.array(p[:, c] >= threshold) for c, n in enumerate(names)})

    schema = ", ".join(["doc_id long", *(f"p_{n} double" for n in names), *(f"{n} boolean" for n in names)])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


#: Categories that the label table gives, in the order of the chain.
CATEGORIES = ["junk", "toxic", "toxic_junk"]


def labelled_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents next to the categories: junk (quality 0), toxic, and both at once."""
    y = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(
        F.max(1 - F.col("quality")).alias("junk"), F.max("toxic").alias("toxic"))
    y = y.withColumn("toxic_junk", F.col("junk") * F.col("toxic"))
    order = F.xxhash64(F.lit(7), "doc_id")
    y = y.orderBy(order).limit(MAX_TRAIN)  # the sample is drawn before texts move
    return docs.select("doc_id", "text").join(F.broadcast(y), "doc_id")
