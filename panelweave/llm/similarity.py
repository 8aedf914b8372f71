"""Exact Jaccard join of documents on word n-grams by T-occurrence search with DivideSkip.

Every document becomes a sorted array of 64-bit shingle hashes; equal sets are one
class. Similar sets of n and m shingles share at least T = ceil(j (n + m) / (1 + j)).
The shingles are divided by rarity: the n - ceil(j n) + SHORT rarest have the short
inverted lists, the others the long ones. Similar sets meet in at least SHORT short
lists, so the short lists are merged into a count for each (document, candidate), and
candidates below SHORT go. The long lists are never read: each remaining candidate
is probed for the other shingles by binary search in its own sorted array.

Lists are split by shingle over the cluster. A first round merges only what each list
says about its smallest member; verified links give components, which take in large
groups of near copies at linear cost. The second round merges, in each list, the members
outside its largest component with those of other components, so no link is lost and the
pairs within a group of copies are never formed.
"""

from __future__ import annotations

import hashlib
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelweave.llm.common import (LOWER, SLOTS, columns, frequency_table, hashed_frequencies, ids_and_bytes,
                                   open_lists, pieces, shingles, stored, token_hashes)
from panelweave.llm.components import components


#: Short lists in which two similar sets meet at least (T minus the number of long lists, in terms of DivideSkip).
SHORT = 3
#: Words of the bit map of a set: two maps differ in no more bits than the sets differ in shingles.
MAP = 16
#: Ids up to this number are broadcast (about 64 MB); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def _sets(batches, k: int):
    """(doc ids, list of shingle arrays) of each piece of a batch."""
    for ids, texts in columns(pieces(batches), "doc_id", "text"):
        yield ids, [shingles(token_hashes(t.translate(LOWER).split()), k) for t in texts]


def _ratio(percent: int) -> tuple[int, int]:
    g = gcd(percent, 100)
    return percent // g, 100 // g


def shingle_frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """How often shingles fall into each of SLOTS slots, over all documents: decides rarity only, never a match."""
    def run(batches):
        return hashed_frequencies(np.concatenate(s) % np.uint64(SLOTS) for _, s in _sets(batches, k) if s)

    return frequency_table(ids_and_bytes(docs).mapInArrow(run, "slice int, counts binary"))


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, k: int, percent: int, freq: np.ndarray) -> DataFrame:
    """doc_id, n (set size), key (digest of the set), rare (the shingles with short lists, rarest first), bits (a map of the set)."""
    shared = docs.sparkSession.sparkContext.broadcast(freq)
    num, den = _ratio(percent)

    def run(batches):
        f = shared.value
        for ids, sets in _sets(batches, k):
            n, keys, rare, bits = [], [], [], []
            for s in sets:
                n.append(len(s))
                keys.append(_digest(s) if len(s) else None)
                least = -(-num * len(s) // den)
                short = len(s) - least + min(SHORT, least)
                order = np.lexsort((s, f[(s % np.uint64(SLOTS)).astype(np.int64)]))[:short]
                rare.append(s[order].view(np.int64))
                bits.append(np.packbits(np.bincount((s >> np.uint64(40)).astype(np.int64) % (64 * MAP), minlength=64 * MAP) > 0).view(np.int64))
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64()),
                "key": pa.array(keys, pa.binary()), "rare": pa.array(rare, pa.list_(pa.int64())),
                "bits": pa.array(bits, pa.list_(pa.int64()))})

    return ids_and_bytes(docs).mapInArrow(run, "doc_id long, n long, key binary, rare array<long>, bits array<long>")


def _probe(a: np.ndarray, b: np.ndarray, need: int) -> bool:
    """Whether sorted sets share at least `need` values: binary probes of the longer by the shorter."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum()) >= need


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    num, den = _ratio(percent)

    def run(batches):
        for a, b, sa, sb in columns(batches, "a", "b", "sa", "sb"):
            ok = []
            for x, y in zip(sa, sb):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                ok.append(_probe(x, y, -(-num * (len(x) + len(y)) // (den + num))))
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}).filter(
                pa.array(ok, pa.bool_()))

    full = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(
        sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    return full.mapInArrow(run, "a long, b long")


def _sets_of(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Whole sets of the documents in `pairs` only."""
    def run(batches):
        for doc_ids, sets in _sets(batches, k):
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()),
                                              "s": pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())})

    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return ids_and_bytes(docs).join(ids, "doc_id", "left_semi").mapInArrow(run, "doc_id long, s binary")


def _links(docs: DataFrame, met: DataFrame, k: int, percent: int) -> DataFrame:
    """Verified links among `met` (a, na, pa, b, nb, pb): one row for each short list in which a and b meet."""
    num, den = _ratio(percent)
    least = F.ceil(F.least("na", "nb") * num / den)
    pairs = met.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("met"), F.min("pa").alias("pa"), F.min("pb").alias("pb"))
    # nothing is shared before the first place at which they meet
    pairs = pairs.where(F.col("met") >= F.least(F.lit(SHORT), least)).where(
        F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) * (den + num) >= num * (F.col("na") + F.col("nb")))
    pairs = stored(pairs.select("a", "b"), "pairs")
    return stored(_verified(pairs, _sets_of(docs, pairs, k), percent), "links")


def _short_lists(sig: DataFrame, percent: int) -> DataFrame:
    """Rows (g, doc_id, n, place, before) of the short lists that two documents or more share.

    before: how many of the document's rarer shingles are in such lists; the others are shared with
    nobody here. Documents that can't reach an overlap any more leave, which closes further lists.
    """
    num, den = _ratio(percent)
    rows = sig.select("doc_id", "n", F.posexplode("rare").alias("place", "g"))
    one = W.partitionBy("doc_id")
    least = F.ceil(F.col("n") * num / den)
    for _ in range(2):
        rows = open_lists(rows, ["n", "doc_id"], ["place"]).withColumns({
            "before": F.row_number().over(one.orderBy("place")) - 1, "total": F.count("*").over(one)})
        rows = rows.where(F.col("total") >= F.least(F.lit(SHORT), least)).where(F.col("before") + F.col("n") - F.col("place") >= least)
    return rows.select("g", "doc_id", "n", "place", "before")


def _may_reach(percent: int, other: str, one: str) -> Column:
    """Size filter, and the bound on what two documents share before and from a common place on."""
    num, den = _ratio(percent)
    na, nb, pa, pb = (F.col(f"n{other}"), F.col(f"n{one}"), F.col(f"p{other}"), F.col(f"p{one}"))
    bound = F.least(f"o{other}", f"o{one}") + F.least(na - pa, nb - pb)
    return (F.least(na, nb) * den >= F.greatest(na, nb) * num) & (bound * (den + num) >= num * (na + nb))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; links need 100 * |a & b| >= percent * |a | b|.

    Words are runs without ASCII white space, A-Z lower-cased. Fewer than k words make one
    shingle; null, empty and blank texts have an empty set, link with nothing and are their own
    component. doc_id is expected to be unique; repeated rows give repeated results. A null doc_id
    links with nothing and has no component. Other columns are ignored; an empty table gives an empty result. Texts are read
    whole; no list or group is capped.
    """
    num, den = _ratio(percent)
    sig = stored(signatures(docs, k, percent, shingle_frequencies(docs, k)), "signatures")
    known = sig.where("n > 0 and doc_id is not null")
    classes = stored(known.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")), "classes")
    copies = known.select("key", "doc_id").join(classes.where("c > 1"), "key").where("doc_id <> rep").select("doc_id")
    lists = stored(_short_lists(known.join(copies, "doc_id", "left_anti"), percent), "lists")

    # first round: in each list, with the member that shares most of its shingles
    hubs = lists.groupBy("g").agg(F.min(F.struct((F.col("place") - F.col("before")).alias("own"), "doc_id", "n", "place", "before")).alias("h")).select(
        "g", F.col("h.doc_id").alias("b"), F.col("h.n").alias("nb"), F.col("h.place").alias("pb"), F.col("h.before").alias("ob"))
    left = lists.select("g", F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("before").alias("oa"))
    met = left.join(hubs, "g").where((F.col("a") != F.col("b")) & _may_reach(percent, "a", "b"))
    links = _links(docs, met, k, percent)

    # second round: members outside the largest component of their list, with those of other components
    found = components(links).withColumnRenamed("id", "a").withColumnRenamed("component_id", "ca")
    named = left.join(found, "a", "left").withColumn("ca", F.coalesce("ca", "a"))
    sizes = named.groupBy("g", "ca").agg(F.count("*").alias("m"))
    maps = sig.select(F.col("doc_id").alias("a"), F.col("bits").alias("ba")).join(lists.select(F.col("doc_id").alias("a")).distinct(), "a", "left_semi")
    mixed = sizes.groupBy("g").agg(F.max(F.struct("m", "ca"))["ca"].alias("main"), F.count("*").alias("k")).where("k > 1")
    named = stored(named.join(mixed.select("g", "main"), "g").join(maps.dropDuplicates(["a"]), "a"), "lists")
    minor = named.where("ca <> main").drop("main")
    other = named.select("g", "main", *[F.col(f"{c}a" if c else "a").alias(f"{c}b" if c else "b") for c in ("", "n", "p", "o", "c", "b")])
    differ = sum((F.bit_count(F.get("ba", F.lit(i)).bitwiseXOR(F.get("bb", F.lit(i)))) for i in range(MAP)), F.lit(0))
    fits = differ <= F.col("na") + F.col("nb") - 2 * F.ceil(num * (F.col("na") + F.col("nb")) / (den + num))
    met = minor.join(other, "g").where(F.expr("ca <> cb and (cb = main or a > b)") & _may_reach(percent, "a", "b") & fits)
    swap = F.col("a") < F.col("b")
    met = met.select(*[F.when(swap, F.col(f"{c}{y}")).otherwise(F.col(f"{c}{x}")).alias(f"{c}{x}")
                       for x, y in (("a", "b"), ("b", "a")) for c in ("", "n", "p")])
    links = links.unionByName(_links(docs, met, k, percent))
    final = components(links).withColumnRenamed("id", "rep")
    named_classes = classes.join(final, "rep", "left").select("key", F.coalesce("component_id", "rep").alias("component_id"))
    return sig.join(named_classes, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_per_component(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one document of each component: the one with the smallest doc_id."""
    found = jaccard_components(docs, k, percent)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
