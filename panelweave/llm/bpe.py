"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves pre-tokens that are
tokens themselves. Tier two: other pre-tokens are merged by a heap over linked
bytes. The rank file is a parameter; its perfect hash is built once on the driver
and broadcast (its size is that of the vocabulary, whatever the corpus).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from panelweave.llm.common import columns, pieces

_LOW = 0xFFFFFFFF


class PerfectHash:
    """Hash and displace: n keys on n slots. `find` returns the rank of a key or None."""

    def __init__(self, ranks: dict[bytes, int]):
        n = self.n = max(1, len(ranks))
        self.buckets = max(1, n // 3)
        groups: dict[int, list[tuple[int, bytes]]] = {}
        for key in ranks:
            h = xxhash.xxh3_64_intdigest(key)
            groups.setdefault(h % self.buckets, []).append((h, key))
        self.shift = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        self.ids = [0] * n
        singles = []
        for b, group in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(group) == 1:
                singles.append((b, group[0][1]))
                continue
            d = 1
            while True:
                slots = {self._slot(h, d) for h, _ in group}
                if len(slots) == len(group) and all(self.keys[s] is None for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for h, key in group:
                s = self._slot(h, d)
                self.keys[s], self.ids[s] = key, ranks[key]
        free = (s for s in range(n) if self.keys[s] is None)
        for b, key in singles:  # a lone key takes a free slot directly, kept as a negative shift
            s = next(free)
            self.shift[b] = -s - 1
            self.keys[s], self.ids[s] = key, ranks[key]

    def _slot(self, h: int, d: int) -> int:
        return ((h & _LOW) * d + (h >> 32)) % 0xFFFFFFFB % self.n

    def find(self, key: bytes) -> int | None:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        s = -d - 1 if d < 0 else ((h & _LOW) * d + (h >> 32)) % 0xFFFFFFFB % self.n
        return self.ids[s] if self.keys[s] == key else None


@lru_cache(maxsize=4)
def load_vocabulary(path: str) -> PerfectHash:
    """Read a rank file (base64 token, rank) into a perfect hash."""
    with open(path, "rb") as f:
        return PerfectHash({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


def merge_bytes(piece: bytes, find) -> list[int]:
    """Merge neighbours of lowest rank first, leftmost on ties, by a heap over linked bytes."""
    n = len(piece)
    end = list(range(1, n + 1))  # end[i]: end of the part that starts at i, 0 once it is merged away
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        r = find(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            r = find(piece[i : end[stop]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        left = before[i]
        if left >= 0:
            r = find(piece[left:stop])
            if r is not None:
                heapq.heappush(heap, (r, left, stop))
    out, i = [], 0
    while i < n:
        r = find(piece[i : end[i]])
        if r is None:
            raise ValueError(f"byte sequence {piece[i:end[i]]!r} is not in the vocabulary")
        out.append(r)
        i = end[i]
    return out


class _Encoded(dict):
    """pre-token -> ids as little-endian uint32 bytes; a bounded memo in front of both tiers."""

    def __init__(self, vocab: PerfectHash, limit: int = 500_000):
        super().__init__()
        self.vocab, self.limit = vocab, limit
        self.merges = dict(zip(vocab.keys, vocab.ids)).get

    def __missing__(self, token: str) -> bytes:
        raw = token.encode()
        rank = self.vocab.find(raw)
        ids = (rank,) if rank is not None else merge_bytes(raw, self.merges)
        packed = np.array(ids, "<u4").tobytes()
        if len(raw) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[token] = packed
        return packed


def _pieces(size: int, vocab: PerfectHash) -> list[bytes]:
    out = [b""] * size
    for key, i in zip(vocab.keys, vocab.ids):
        if key is not None:
            out[i] = key
    return out


def encode_decode(docs: DataFrame, path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """Encode `docs.text` and decode it again.

    Returns doc_id, n_tokens, ids (array<int>, only if keep_ids), decoded (binary,
    only if keep_ids), ids_sha256 and decoded_sha256. A null text counts as empty and
    gives no ids and the hash of no bytes; repeated rows give repeated results; other
    columns are ignored; an empty table gives an empty result. Long texts are encoded whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))

    def run(batches):
        vocab = shared.value
        split, memo = regex.compile(pattern).findall, _Encoded(vocab)
        known = _pieces(max(vocab.ids, default=0) + 1, vocab)
        for doc_ids, texts in columns(pieces(batches), "doc_id", "text"):
            cols = {"doc_id": pa.array(doc_ids, pa.int64())}
            n, hashes, backs, ids, raws = [], [], [], [], []
            for t in texts:
                packed = b"".join(map(memo.__getitem__, split(t or "")))
                numbers = np.frombuffer(packed, "<u4")
                raw = b"".join(map(known.__getitem__, numbers.tolist()))
                n.append(len(numbers))
                hashes.append(hashlib.sha256(packed).hexdigest())
                backs.append(hashlib.sha256(raw).hexdigest())
                if keep_ids:
                    ids.append(numbers.astype(np.int32))
                    raws.append(raw)
            cols |= {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": hashes, "decoded_sha256": backs}
            if keep_ids:
                cols |= {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(raws, pa.binary())}
            yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded binary" if keep_ids else ""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
