"""Removal of byte strings repeated from earlier documents, by sharded external suffix sorting.

Every window of `length` bytes is named by the least hash of its 24-byte grams (its anchor);
consecutive windows of one anchor form a strand. Equal windows have equal anchors, so strands
are routed by anchor and each shard can be sorted alone.

1. Documents are dealt into parts. Each part sends the distinct anchors of its documents; anchors
   of one document only are answered by nothing, and their strands are not looked at again.
2. Each part sends its distinct strands of the other anchors, with the smallest doc_id that has them.
3. Each shard sorts all suffixes of its strands by external induction and scans the ranks:
   neighbours with a common prefix of `length` or more are one string, and every strand learns which
   of its windows also start in a smaller document. The answers go back to the parts.
4. Each part marks the windows of its documents and cuts the bytes they cover.

Whole copies of a smaller document are folded first: each of their strings starts there, so all
their bytes go. A part sends an anchor or strand once, however often it occurs, so a passage that a third
of all documents share reaches its shard at most once from each part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from panelweave.llm.common import ids_and_bytes, mixed, partitions_for, stored
from panelweave.llm.induced import SEPARATOR, sorted_suffixes

GRAM = 24
#: Ids up to this number are broadcast (about 64 MB); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Text handled at once while anchors are computed, and windows of one strand (bits of an answer).
CHUNK, STRAND = 1 << 18, 32
NO_ID = np.iinfo(np.int64).max


def _anchors(raw: bytes, ends: np.ndarray, length: int):
    """(document number, start, windows, anchor) of all strands in concatenated documents."""
    n, reach = len(raw), length - GRAM + 1
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, empty.astype(np.uint64)
    w = np.ndarray((n - 7,), "<u8", raw, strides=(1,))
    m = n - GRAM + 1
    with np.errstate(over="ignore"):
        h = w[:m] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h += w[8 : 8 + m]
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h += w[16 : 16 + m]
        h *= np.uint64(0x165667B19E3779F9)
        h ^= h >> np.uint64(32)
    span = 1
    while span * 2 <= reach:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    if span < reach:
        h = np.minimum(h[: len(h) - (reach - span)], h[reach - span :])
    number = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))
    valid = number[: n - length + 1] == number[length - 1 :]
    new = valid.copy()
    new[1:] &= ~(valid[:-1] & (h[1:] == h[:-1]))
    start = np.flatnonzero(new)
    if not len(start):
        return empty, empty, empty, empty.astype(np.uint64)
    size = np.add.reduceat(valid.astype(np.int64), start)
    pieces = -(-size // STRAND)
    if pieces.max() > 1:
        k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, size = np.repeat(start, pieces) + k * STRAND, np.minimum(np.repeat(size, pieces) - k * STRAND, STRAND)
    return number[start], start, size, mixed(h[start])


def _chunks(texts: list[bytes]):
    """(first document number, documents) of about CHUNK bytes; a longer document stands alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if texts:
        yield first, texts[first:]


def _strands(texts: list[bytes], length: int):
    """Per chunk: bytes, offset of each document, first document number, and the strands."""
    for first, docs in _chunks(texts):
        raw = b"".join(docs)
        ends = np.cumsum([len(d) for d in docs])
        number, start, size, anchor = _anchors(raw, ends, length)
        yield raw, np.concatenate(([0], ends[:-1])), first, number, start, size, anchor


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return np.array([NO_ID if x is None else x for x in column.to_pylist()], np.int64)


def _shard_of(anchor: np.ndarray, shards: int) -> np.ndarray:
    return ((anchor >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _blobs(shard: np.ndarray):
    """(shard, from, to) of each run of equal values."""
    if len(shard):
        at = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True])))
        yield from zip(shard[at[:-1]].tolist(), at[:-1].tolist(), at[1:].tolist())


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "int": pa.int64()}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(fields, cols)})


ANCHORS = "shard long, part long, anchors binary, several binary"
ASKED = "part long, anchors binary"
STRANDS = "shard long, part long, anchors binary, ids binary, sizes binary, texts binary"
ANSWERS = "part long, anchors binary, digests binary, ids binary, masks binary"


def _send_anchors(shards: int, length: int):
    def run(docs: pa.Table) -> pa.Table:
        texts, part = docs["text"].to_pylist(), docs["part"][0].as_py()
        found = [(number + first, anchor) for _, _, first, number, _, _, anchor in _strands(texts, length)]
        number, anchor = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(anchor, kind="stable")
        number, anchor = number[order], anchor[order]
        new = np.concatenate(([True], anchor[1:] != anchor[:-1]))[: len(anchor)]
        differs = np.zeros(len(anchor), np.int8)
        differs[1:] = (number[1:] != number[:-1]) & ~new[1:]
        at = np.flatnonzero(new)
        several = np.maximum.reduceat(differs, at) if len(at) else differs
        anchor = anchor[at]
        return _table(ANCHORS, [(s, part, anchor[a:b].tobytes(), several[a:b].tobytes()) for s, a, b in _blobs(_shard_of(anchor, shards))])

    return run


def _answer_anchors(sent: pa.Table) -> pa.Table:
    """Anchors that occur in two documents or more, for each part that has them."""
    blobs = [np.frombuffer(x, np.uint64) for x in sent["anchors"].to_pylist()]
    several = np.concatenate([np.frombuffer(x, np.int8) for x in sent["several"].to_pylist()])
    anchor, back, count = np.unique(np.concatenate(blobs), return_inverse=True, return_counts=True)
    repeated = count > 1
    repeated[back[several > 0]] = True
    keep = repeated[back]
    out, at = [], 0
    for part, blob in zip(sent["part"].to_pylist(), blobs):
        mine = blob[keep[at : at + len(blob)]]
        at += len(blob)
        if len(mine):
            out.append((part, mine.tobytes()))
    return _table(ASKED, out)


def _among(values: np.ndarray, pool: np.ndarray) -> np.ndarray:
    at = np.searchsorted(pool, values)
    at[at == len(pool)] = 0
    return pool[at] == values if len(pool) else np.zeros(len(values), bool)


def _pool(column: pa.ChunkedArray) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in column.to_pylist())]))


def _send_strands(shards: int, length: int):
    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        if not docs.num_rows or not asked.num_rows:
            return _table(STRANDS, [])
        pool, ids, part = _pool(asked["anchors"]), _ids(docs["doc_id"]), docs["part"][0].as_py()
        seen: dict[bytes, list] = {}
        for raw, _, first, number, start, size, anchor in _strands(docs["text"].to_pylist(), length):
            take = np.flatnonzero(_among(anchor, pool))
            for a, b, k, d in zip(start[take].tolist(), (start[take] + size[take] + length - 1).tolist(), anchor[take].tolist(), ids[number[take] + first].tolist()):
                s = raw[a:b]
                old = seen.get(s)
                if old is None:
                    seen[s] = [k, d]
                elif d < old[1]:
                    old[1] = d
        texts = list(seen)
        anchor = np.array([v[0] for v in seen.values()], np.uint64)
        ids = np.array([v[1] for v in seen.values()], np.int64)
        order = np.argsort(anchor, kind="stable")
        anchor, ids = anchor[order], ids[order]
        texts = [texts[i] for i in order.tolist()]
        sizes = np.array([len(t) for t in texts], np.int32)
        return _table(STRANDS, [(s, part, anchor[a:b].tobytes(), ids[a:b].tobytes(), sizes[a:b].tobytes(), b"".join(texts[a:b]))
                                for s, a, b in _blobs(_shard_of(anchor, shards))])

    return run


def _smaller_windows(texts: list[bytes], ids: np.ndarray, length: int, budget: int) -> np.ndarray:
    """Bit masks of the windows of each strand that also occur in a strand with a smaller id."""
    sizes = np.array([len(t) for t in texts], np.int64)
    joined = np.frombuffer(b"\0".join([*texts, b"\0"]), np.uint8)
    symbols = joined.astype(np.int16) + 2
    ends = np.cumsum(sizes + 1) - 1
    symbols[ends] = SEPARATOR
    symbols[-1] = 0
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes + 1)
    begin = ends - sizes
    mask = np.zeros(len(texts), np.uint32)
    for c, pos, common in sorted_suffixes(symbols, budget):
        if c <= SEPARATOR:
            continue
        own = owner[pos]
        fits = pos + length <= ends[own]
        at = np.flatnonzero(np.concatenate(([True], (common[1:] < length) | ~fits[1:] | ~fits[:-1])))
        least = np.repeat(np.minimum.reduceat(ids[own], at), np.diff(np.append(at, len(pos))))
        hit = fits & (least < ids[own])
        np.bitwise_or.at(mask, own[hit], np.uint32(1) << (pos[hit] - begin[own[hit]]).astype(np.uint32))
    return mask


def _answer_strands(length: int, budget: int):
    def run(sent: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        least: list[int] = []
        rows = []
        for part, anchors, ids, sizes, text in zip(*(sent[c].to_pylist() for c in ("part", "anchors", "ids", "sizes", "texts"))):
            mine, at = [], 0
            for n, d in zip(np.frombuffer(sizes, np.int32).tolist(), np.frombuffer(ids, np.int64).tolist()):
                s = text[at : at + n]
                at += n
                k = number.setdefault(s, len(least))
                if k == len(least):
                    least.append(d)
                elif d < least[k]:
                    least[k] = d
                mine.append(k)
            rows.append((part, anchors, np.array(mine, np.int64)))
        texts, ids = list(number), np.array(least, np.int64)
        mask = _smaller_windows(texts, ids, length, budget)
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, texts)), "V16")
        return _table(ANSWERS, [(part, anchors, digests[k].tobytes(), ids[k].tobytes(), mask[k].tobytes()) for part, anchors, k in rows])

    return run


def _cut(length: int, keep_text: bool):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts, ids = docs["text"].to_pylist(), _ids(docs["doc_id"])
        pool = _pool(answers["anchors"])
        known: dict[bytes, tuple[int, int]] = {}
        for digests, least, masks in zip(*(answers[c].to_pylist() for c in ("digests", "ids", "masks"))):
            keys = [digests[i : i + 16] for i in range(0, len(digests), 16)]
            known.update(zip(keys, zip(np.frombuffer(least, np.int64).tolist(), np.frombuffer(masks, np.uint32).tolist())))
        n_bytes, removed, spans, hashes, kept = [], [], [], [], []
        for raw, offset, first, number, start, size, anchor in _strands(texts, length):
            step = np.zeros(len(raw) + 1, np.int32)
            take = np.flatnonzero(_among(anchor, pool))
            for a, n, d in zip(start[take].tolist(), size[take].tolist(), ids[number[take] + first].tolist()):
                least, mask = known.get(xxhash.xxh3_128_digest(raw[a : a + n + length - 1]), (NO_ID, 0))
                if d > least:
                    step[a] += 1
                    step[a + n + length - 1] -= 1
                elif mask:
                    for i in range(n):
                        if mask >> i & 1:
                            step[a + i] += 1
                            step[a + i + length] -= 1
            gone = np.cumsum(step[:-1]) > 0
            data = np.frombuffer(raw, np.uint8)
            for a, b in zip(offset.tolist(), np.append(offset[1:], len(raw)).tolist()):
                g = gone[a:b]
                left = data[a:b][~g].tobytes() if g.any() else raw[a:b]
                n_bytes.append(b - a)
                removed.append(b - a - len(left))
                spans.append(int(np.count_nonzero(np.diff(g.astype(np.int8), prepend=0) == 1)))
                hashes.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
        out = {"doc_id": docs["doc_id"], "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
               "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(hashes, pa.string())}
        return pa.table(out | ({"kept": pa.array(kept, pa.binary())} if keep_text else {}))

    return run


def remove_repeats(docs: DataFrame, length: int = 50, keep_text: bool = True, budget: int = 256 << 20) -> DataFrame:
    """Cut every byte covered by a `length`-byte string that also starts in a document with a smaller doc_id.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, if
    `keep_text`, the remaining bytes. Strings are judged on the input and never cross documents. A null
    text counts as empty; texts shorter than `length` stay whole. A null doc_id counts as larger than any
    other. Rows of equal doc_id do not remove each other's strings. Other columns are ignored; an empty
    table gives an empty result.
    """
    if not GRAM + 1 <= length <= 60:
        raise ValueError("length must be 25 to 60")
    source = ids_and_bytes(docs).withColumn("h", F.md5("text"))
    known = source.where("doc_id is not null").select("doc_id", "h")
    first = known.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = stored(known.join(first, "h").where("doc_id > first").select("doc_id", "h").distinct(), "copies")
    if copies.count() <= BROADCAST_IDS:
        copies = F.broadcast(copies)
    parts = partitions_for(docs)
    dealt = source.join(copies, ["doc_id", "h"], "left_anti").drop("h").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("long")).repartition(parts, "part")
    shards = 2 * parts
    anchors = dealt.groupBy("part").applyInArrow(_send_anchors(shards, length), ANCHORS)
    asked = anchors.groupBy("shard").applyInArrow(_answer_anchors, ASKED)
    strands = dealt.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(_send_strands(shards, length), STRANDS)
    answers = strands.groupBy("shard").applyInArrow(_answer_strands(length, budget), ANSWERS)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")
    cut = dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_cut(length, keep_text), schema)
    n = F.octet_length("text").cast("long")
    gone = n >= length
    left = F.when(gone, F.lit("").cast("binary")).otherwise(F.col("text"))
    whole = source.join(copies, ["doc_id", "h"], "left_semi").select(
        "doc_id", n.alias("n_bytes"), F.when(gone, n).otherwise(0).cast("long").alias("n_removed"), gone.cast("long").alias("n_spans"),
        F.sha2(left, 256).alias("kept_sha256"), *([left.alias("kept")] if keep_text else []))
    return cut.unionByName(whole)
