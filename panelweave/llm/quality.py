"""Quality rules: base counts and a hashed n-gram likelihood ratio, in DataFrame functions only.

Uni- and bigrams of words are hashed to `buckets` slots. The raw multinomial counts
every document, the target multinomial those of trusted documents. A document's score
is the mean log ratio per word; it is summed in whole millionths, so it doesn't depend
on the order of additions. The table of ratios has a fixed size and enters the plan as
one constant.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from panelweave.llm.common import fenced

BUCKETS = 1 << 16
#: Trusted ids up to this number are broadcast (about 64 MB); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
UNIT = 1_000_000
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr_millionths", "kept")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def _pairs(words: Column) -> Column:
    """Hash of each word and the next one; the last word stands alone."""
    return F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.xxhash64(a, b))


def _slot(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets).cast("long")).cast("int")


def bucket_counts(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target): n-gram counts over all documents and over the trusted ones."""
    ids = trusted.select("doc_id").where("doc_id is not null").distinct().withColumn("_t", F.lit(1))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    words = docs.select("doc_id", "text").join(ids, "doc_id", "left").select(
        F.coalesce("_t", F.lit(0)).alias("t"), _words(F.col("text")).alias("w"))
    hashed = words.select("t", F.concat(F.transform("w", lambda x: F.xxhash64(x)), _pairs(F.col("w"))).alias("h"))
    # the outer form: for the inner one Spark adds a filter that computes all hashes a second time
    return hashed.select("t", F.explode_outer("h").alias("h")).where("h is not null").groupBy(
        _slot(F.col("h"), buckets).alias("bucket")).agg(F.count("*").alias("raw"), F.sum("t").alias("target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS, smoothing: float = 1.0) -> list[int]:
    """Log ratio of every bucket in millionths: `buckets` numbers, whatever the corpus size."""
    raw, target = [0] * buckets, [0] * buckets
    for r in counts.collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    n_raw, n_target = sum(raw) + smoothing * buckets, sum(target) + smoothing * buckets
    return [round(UNIT * (math.log((t + smoothing) / n_target) - math.log((r + smoothing) / n_raw)))
            for r, t in zip(raw, target)]


def _repeat_words(h3: Column, bits: Column, mask: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more; h3: hashes of all windows.

    Each hash is packed with its position in the low `bits` bits and sorted, so equal windows become
    neighbours; the full hashes decide whether neighbours are equal.
    """
    packed = F.transform(h3, lambda h, i: F.call_function("shiftleft", h, bits).bitwiseOR(i.cast("long")))
    at = F.transform(F.sort_array(packed), lambda p: p.bitwiseAND(mask).cast("int"))

    def starts(pos: Column) -> Column:
        same = lambda a, b: F.get(h3, a) == F.get(h3, b)
        return F.filter(pos, lambda p, j: F.coalesce(same(p, F.get(pos, j + 1)), F.lit(False)) | F.coalesce(same(p, F.get(pos, j - 1)), F.lit(False)))

    def covered(p: Column) -> Column:
        gaps = F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda x, y: x + y)

    once = lambda array, f: F.get(F.transform(F.array(array), f), F.lit(0))  # noqa: E731  each array is computed once
    return once(at, lambda pos: once(F.sort_array(starts(pos)), covered))


def scored(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float = -0.25) -> DataFrame:
    """`docs` with the columns of NAMES, each behind a leading `_q_`.

    A document is kept when it passes the base rule (at least 50 words, at most half of them in
    repeated 3-word windows) and its mean log ratio per word is at least `threshold`. Null, empty and
    blank texts have no words and fail the base rule. Repeated rows are judged alike, and counted as often
    as they occur. Without trusted documents the target is uniform. An empty table gives an empty result.
    """
    ratios = log_ratios(bucket_counts(docs, trusted, buckets), buckets)
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<bigint>")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    zero = F.lit(0).cast("long")
    out = docs.withColumns({
        "_q_w": _words(text), "_q_lines": lines, "_q_n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")})
    out = out.withColumns({
        "_q_n_words": F.size("_q_w").cast("long"),
        "_q_word_chars": F.length(F.array_join("_q_w", "")).cast("long"),
        "_q_n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        "_q_h2": _pairs(F.col("_q_w")),
        "_q_sum1": F.aggregate("_q_w", zero, lambda s, x: s + F.get(table, _slot(F.xxhash64(x), buckets)))})
    n = F.size("_q_w")
    out = out.withColumns({
        "_q_sum": F.col("_q_sum1") + F.aggregate("_q_h2", zero, lambda s, h: s + F.get(table, _slot(h, buckets))),
        "_q_h3": F.zip_with(F.slice("_q_h2", F.lit(1), F.greatest(n - 2, F.lit(0))), F.slice("_q_w", F.lit(3), n),
                            lambda h, c: F.xxhash64(h, c))}).drop("_q_w", "_q_h2", "_q_lines", "_q_sum1")
    out = out.withColumn("_q_bits", F.length(F.bin(F.size("_q_h3"))))
    out = out.withColumn("_q_mask", F.expr("shiftleft(1L, _q_bits) - 1"))
    repeat = F.when(F.size(F.array_distinct("_q_h3")) < F.size("_q_h3"),
                    _repeat_words(F.col("_q_h3"), F.col("_q_bits"), F.col("_q_mask"))).otherwise(0)
    out = out.withColumns({
        "_q_n_repeat_words": repeat.cast("long"),
        "_q_llr_millionths": F.when(F.col("_q_n_words") > 0, F.expr("_q_sum div _q_n_words")).otherwise(0)}).drop("_q_h3", "_q_bits", "_q_mask")
    failed = (F.col("_q_n_words") < 50) | (100 * F.col("_q_n_repeat_words") > 50 * F.col("_q_n_words"))
    kept = ~failed & (F.col("_q_sum") >= F.col("_q_n_words") * round(threshold * UNIT))
    return out.withColumns({"_q_base_failed": failed, "_q_kept": kept}).drop("_q_sum")


def report(docs: DataFrame, trusted: DataFrame, **options) -> DataFrame:
    """doc_id and the columns of NAMES for every document."""
    return scored(docs.select("doc_id", "text"), trusted, **options).select(
        "doc_id", *[F.col(f"_q_{n}").alias(n) for n in NAMES])


def passing(docs: DataFrame, trusted: DataFrame, **options) -> DataFrame:
    """The documents kept, with the columns they came with."""
    return fenced(scored(docs, trusted, **options), F.col("_q_kept")).select(*docs.columns)
