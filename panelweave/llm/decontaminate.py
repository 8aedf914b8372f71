"""Benchmark decontamination by a generalised suffix automaton of the test items.

The items are cut into blocks of a bounded number of words. Each block becomes one
automaton over word numbers, and every document streams through it: the matching
state and its length give the longest suffix of the words read so far that occurs in
an item. Words inside a match of at least `window` words are hit. Several blocks
mean several passes over the documents, one block after the other, whose hit spans are
united per document row by a row number that is written once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelweave.llm.common import columns, ids_and_bytes, pieces, stored

#: A-Z in lower case; letters, digits and all bytes of other scripts stay; the rest separates words.
TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

#: Item words in one automaton (a broadcast of about 40 MB at most). More items mean more blocks.
BLOCK_WORDS = 200_000
#: Row number of a document while several blocks are passed.
ROW = "_d_row"


def normal_words(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton over the word numbers of some items."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for item, words in items:
            if words:
                codes = [self.number.setdefault(w, len(self.number) + 1) for w in words]
                coded.append((item, codes))
                last = 0
                for c in codes:
                    last = self._extend(last, c)
        self.shortest = min((min(window, len(c)) for _, c in coded), default=0)
        self._mark(coded)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, q, c)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def _mark(self, coded) -> None:
        """whole[v]: lengths and ids of short items in state v; ending[v]: long items with a window ending there."""
        k, link, length = self.window, self.link, self.length
        self.whole: dict[int, list[tuple[int, object]]] = {}
        self.ending: dict[int, set] = {}
        for item, codes in coded:
            v = 0
            for i, c in enumerate(codes):
                v = self.next[v][c]
                if i + 1 >= k:
                    u = v
                    while length[link[u]] >= k:
                        u = link[u]
                    self.ending.setdefault(u, set()).add(item)
            if len(codes) < k:
                u = v
                while length[link[u]] >= len(codes):
                    u = link[u]
                self.whole.setdefault(u, []).append((len(codes), item))
        # best[v]: longest short item that ends in the proper suffixes of state v, and its nearest marked state
        self.best = [0] * len(link)
        for v in sorted(range(1, len(link)), key=length.__getitem__):
            u = link[v]
            self.best[v] = max([self.best[u], *(n for n, _ in self.whole.get(u, ()))])

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Disjoint [start, end) ranges of hit words, and the items whose windows occur."""
        if not self.shortest or len(words) < self.shortest:
            return [], set()
        codes = np.fromiter(map(self.number.get, words, repeat(0)), np.int32, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (codes > 0).astype(np.int8), [0]))))
        out: list[tuple[int, int]] = []
        items: set = set()
        seen: set[int] = set()
        for a, b in edges.reshape(-1, 2).tolist():  # a word of no item ends every match
            if b - a >= self.shortest:
                self._stream(codes[a:b].tolist(), a, out, items, seen)
        return out, items

    def _stream(self, codes: list[int], at: int, out, items: set, seen: set[int]) -> None:
        nxt, link, length, k, whole, best = self.next, self.link, self.length, self.window, self.whole, self.best
        v = n = 0
        for i, c in enumerate(codes, at + 1):
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                n += 1
            hit = n if n >= k else 0
            if hit and v not in seen:
                u = v
                while length[link[u]] >= k:
                    u = link[u]
                if n >= k:
                    items |= self.ending[u]
                if length[link[v]] >= k or n == length[v]:
                    seen.add(v)
            if not hit and (best[v] or v in whole):
                hit = max([best[v], *(m for m, _ in whole.get(v, ()) if m <= n)])
            if best[v] or v in whole:
                u = v
                while u > 0:
                    items.update(x for m, x in whole.get(u, ()) if m <= n)
                    u = link[u] if best[u] else 0
            if hit:
                start = i - hit
                while out and out[-1][1] >= start:
                    start = min(start, out.pop()[0])
                out.append((start, i))


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items in blocks of about `block_words` words, one block at a time on the driver; null texts have no words."""
    block, n = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    for r in rows.toLocalIterator():
        words = normal_words(r["text"])
        if words:
            block.append((r["item_id"], words))
            n += len(words)
            if n >= block_words:
                yield block
                block, n = [], 0
    if block or n == 0:
        yield block


def _pass(docs: DataFrame, block, window: int) -> tuple[DataFrame, object]:
    """Hits of one block next to the keys of `docs` (all columns before text), and the broadcast behind them."""
    shared = docs.sparkSession.sparkContext.broadcast(SuffixAutomaton(block, window))
    keys = docs.columns[:-1]

    def run(batches):
        automaton = shared.value
        for *ids, texts in columns(pieces(batches), *keys, "text"):
            n, starts, ends, items = [], [], [], []
            for t in texts:
                words = normal_words(t)
                spans, found = automaton.spans(words)
                n.append(len(words))
                starts.append([a for a, _ in spans])
                ends.append([b for _, b in spans])
                items.append(sorted(found))
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in zip(keys, ids)} | {
                "n_words": pa.array(n, pa.int64()),
                "starts": pa.array(starts, pa.list_(pa.int32())), "ends": pa.array(ends, pa.list_(pa.int32())),
                "items": pa.array(items, pa.list_(pa.string()))})

    schema = "".join(f"{k} long, " for k in keys) + "n_words long, starts array<int>, ends array<int>, items array<string>"
    return docs.mapInArrow(run, schema), shared


def _united(batches):
    """Union of the spans that several blocks found in one document row."""
    for rows, doc_ids, n, starts, ends, items in columns(batches, ROW, "doc_id", "n_words", "starts", "ends", "items"):
        s2, e2 = [], []
        for s, e in zip(starts, ends):
            spans: list[list[int]] = []
            for a, b in sorted(zip(s, e)):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            s2.append([a for a, _ in spans])
            e2.append([b for _, b in spans])
        yield pa.RecordBatch.from_pydict({
            ROW: pa.array(rows, pa.int64()), "doc_id": pa.array(doc_ids, pa.int64()), "n_words": pa.array(n, pa.int64()),
            "starts": pa.array(s2, pa.list_(pa.int32())), "ends": pa.array(e2, pa.list_(pa.int32())),
            "items": pa.array(items, pa.list_(pa.string()))})


def _first_blocks(benchmark: DataFrame, block_words: int):
    """The first two blocks (the second None where there is one only) and an iterator over the rest."""
    blocks = item_blocks(benchmark, block_words)
    return next(blocks), next(blocks, None), blocks


def _numbered(docs: DataFrame) -> DataFrame:
    """`docs` with a row number that stays the same in every pass: written once, read by all."""
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def _all_passes(docs: DataFrame, blocks, window: int) -> DataFrame:
    """Hits of each row of numbered documents in all blocks; the driver holds one block at a time."""
    source = docs.select(ROW, "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    every = None
    for block in blocks:
        found, shared = _pass(source, block, window)
        done = stored(found if every is None else found.where(F.size("starts") > 0), "hits")
        every = done if every is None else every.unionByName(done)
        shared.destroy()
    return every.groupBy(ROW).agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("starts")).alias("starts"),
        F.flatten(F.collect_list("ends")).alias("ends"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    ).mapInArrow(_united, f"{ROW} long, doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>")


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Hit words of each document: doc_id, n_words, starts, ends (disjoint word ranges), items (sorted ids as text).

    Every row is judged on its own, rows without doc_id and repeated ids included. Null or empty
    texts have no words and no hits; null or empty items are ignored; an empty benchmark hits
    nothing. Other columns are ignored.
    """
    first, second, rest = _first_blocks(benchmark, block_words)
    if second is None:
        return _pass(ids_and_bytes(docs), first, window)[0]
    return _all_passes(_numbered(docs.select("doc_id", "text")), chain((first, second), rest), window).drop(ROW)


def leak_report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """One row per document with hit counts and a digest of the items found."""
    found = find_leaks(docs, benchmark, window)
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"))


def _word_ranges(text: bytes) -> np.ndarray:
    keep = np.frombuffer(text.translate(TABLE), np.uint8) != 32
    return np.flatnonzero(np.diff(np.concatenate(([0], keep.astype(np.int8), [0])))).reshape(-1, 2)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5,
          block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents without leaked spans; those with more than `max_coverage` of their words hit are removed.

    Keeps the columns of `docs`. The bytes from the first to the last word of each hit range
    are cut. Documents without hits, null and empty ones included, pass unchanged.
    """
    first, second, rest = _first_blocks(benchmark, block_words)
    out, shared = docs, None
    if second is None:
        shared = docs.sparkSession.sparkContext.broadcast(SuffixAutomaton(first, window))
    else:  # several automata: spans are found first and joined to the texts by row number
        numbered = _numbered(docs)
        found = _all_passes(numbered, chain((first, second), rest), window).where(F.size("starts") > 0)
        out = numbered.join(found.select(ROW, F.struct("n_words", "starts", "ends").alias("_hit")), ROW, "left")

    def run(batches):
        for b in pieces(batches):
            texts = b.column("text").to_pylist()
            hits = b.column("_hit").to_pylist() if shared is None else repeat(None)
            keep, new = [], []
            for t, h in zip(texts, hits):
                raw = (t or "").encode()
                if shared is None:
                    n, spans = (h["n_words"], list(zip(h["starts"], h["ends"]))) if h else (0, [])
                else:
                    words = normal_words(raw)
                    n, (spans, _) = len(words), shared.value.spans(words)
                keep.append(sum(e - s for s, e in spans) <= max_coverage * n)
                if spans and keep[-1]:
                    at = _word_ranges(raw)
                    parts, last = [], 0
                    for s, e in spans:
                        parts.append(raw[last : at[s, 0]])
                        last = at[e - 1, 1]
                    t = b"".join([*parts, raw[last:]]).decode()
                new.append(t)
            cols = {n: b.column(n) for n in b.schema.names if n not in (ROW, "_hit")} | {"text": pa.array(new, pa.string())}
            yield pa.RecordBatch.from_pydict(cols).filter(pa.array(keep, pa.bool_()))

    return out.mapInArrow(run, docs.schema)
