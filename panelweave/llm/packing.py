"""Sequence packing: shortest-pack-first over the length histogram.

Documents become token ids; whole sequences are cut off a document's front and what is
left has a length below the sequence size. The histogram of these lengths, at most
`size` - 1 numbers however large the corpus, is packed by `plan_packs`; its pattern
counts are then joined back to the documents by their rank within their length.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from panelweave.llm.common import columns, stored

#: Words kept in a task's memo, and the longest word that enters it.
MEMO, MEMO_WORD = 800_000, 64
#: Characters encoded at a time.
BLOCK = 1 << 20
_CLOSING = frozenset(".,;:!?")
_MARKS = re.compile(r"[^\w\s][.,]|_[.,]")
_OTHER = re.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-\u012f\u0131-\u017f]")

_ENCODERS: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """A memo of words before a tokenizer that lower-cases, drops white space and splits letters from punctuation.

    Such a tokenizer never joins what a blank or a line feed separates, nor an ASCII letter and a closing mark
    behind it, so a text's ids are those of its words one after the other.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that close a word
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.type = np.dtype("<u2" if len(self.ends) <= 1 << 16 else "<u4")
        self.memo: dict[str, bytes] = {}
        # Latin words in lower case pass by the normaliser: their model alone, on their bytes as its vocabulary writes them
        self.latin = Tokenizer(self.library.model)
        self.latin.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {c: c for c in shown} | {c: 256 + k for k, c in enumerate(sorted({*range(256)} - {*shown}))}

    @classmethod
    def of(cls, path: str) -> "WordEncoder":
        """One encoder for each worker process, so that later tasks find its memo filled."""
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def _learn(self, words: set[str]) -> None:
        memo, parts, plain, other = self.memo, [], set(), set()
        for w in words:
            base = w[:-1] if w[-1:] in _CLOSING and w[-2:-1].isalpha() else w
            if base.isalpha():
                latin = base.isascii() or (max(base) < "\u0180" and "\u0130" not in base)  # one letter in lower case for each
                if latin:
                    base = base.lower()
                if base not in memo:
                    (plain if latin else other).add(base)
            elif base not in memo:
                other.add(base)
            if base != w:
                parts.append((w, base, w[len(base):]))
        other.update(_CLOSING - memo.keys())
        self._learn_latin(list(plain))
        other = list(other)
        for x, e in zip(other, self.library.encode_batch_fast(other, add_special_tokens=False)):
            memo[x] = np.array(e.ids, self.type).tobytes()
        for w, base, tail in parts:
            memo[w] = memo[base] + memo[tail] if tail else memo[base]

    def _learn_latin(self, words: list[str]) -> None:
        """Words of Latin letters in lower case, many at a time: each ends at the next id that closes a word."""
        for a in range(0, len(words), 1000):
            some = words[a : a + 1000]
            text = " ".join([w if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in some])
            ids = np.array(self.latin.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.type)
            raw, size, at = ids.tobytes(), self.type.itemsize, 0
            for w, end in zip(some, ((np.flatnonzero(self.ends[ids]) + 1) * size).tolist(), strict=True):
                self.memo[w] = raw[at:end]
                at = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        flat: list[str] = []
        ends = []
        for t in texts:
            if "<|" in t or _OTHER.search(t):
                flat += t.replace("\n", " ").split(" ")
            else:  # Latin: lower case letter by letter, common white space only
                t = t.lower()
                if not _MARKS.search(t):  # single marks behind words: set apart, so that fewer words are met
                    t = t.replace(", ", " , ").replace(". ", " . ").replace(".\n", " .\n")
                flat += t.split()
            ends.append(len(flat))
        if len(self.memo) > MEMO:
            self.memo.clear()
        parts = list(map(self.memo.get, flat))
        at, i = [], -1
        try:
            while True:
                i = parts.index(None, i + 1)
                at.append(i)
        except ValueError:
            pass
        missing = {flat[i] for i in at}
        self._learn(missing)
        for i in at:
            parts[i] = self.memo[flat[i]]
        for w in missing:
            if len(w) > MEMO_WORD:
                del self.memo[w]
        return [b"".join(parts[a:b]) for a, b in zip([0, *ends], ends)]


def blocks(texts: list[str], chars: int = BLOCK):
    """(from, to) of neighbouring texts with about `chars` characters together."""
    a = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def encoded(docs: DataFrame, path: str, end_id: int, size: int) -> DataFrame:
    """doc_id, ids (packed), n, rest (n modulo size), and the row's place: part (task), nth of its rest there, full sequences before it there."""
    def run(batches):
        part, seen, whole = TaskContext.get().partitionId(), {}, 0
        encoder = WordEncoder.of(path)
        last = np.array([end_id], encoder.type).tobytes()
        for ids, texts in columns(batches, "doc_id", "text"):
            texts = [t or "" for t in texts]
            for a, b in blocks(texts):
                out = [p + last for p in encoder.encode(texts[a:b])]
                n = [len(p) // encoder.type.itemsize for p in out]
                nth, before = [], []
                for x in n:
                    r = x % size
                    nth.append(seen.get(r, 0))
                    seen[r] = nth[-1] + 1
                    before.append(whole)
                    whole += x // size
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids[a:b], pa.int64()), "ids": pa.array(out, pa.binary()), "n": pa.array(n, pa.int64()),
                    "rest": pa.array([x % size for x in n], pa.int32()), "part": pa.array([part] * (b - a), pa.int32()),
                    "nth": pa.array(nth, pa.int64()), "before": pa.array(before, pa.int64())})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, ids binary, n long, rest int, part int, nth long, before long")


def plan_packs(histogram: dict[int, int], size: int) -> tuple[np.ndarray, int]:
    """Shortest-pack-first: the longest lengths first, each into the packs with most room.

    As many packs are open as the tokens fill: whole ones of `size` and, for the remainder, one for each
    of its binary digits, since a sequence at a power of two takes no padding. A length that finds no
    pack with enough room is cut there: the pack is full and the rest goes back into the histogram. So
    nothing is padded and at most one cut falls on a pack. Packs of equal content are one run of sequence
    numbers; a placement splits one run at most, so the plan depends on the lengths, not on their counts.

    Returns slots (rest, start, length, rank, depth, packs, sequence, offset) and the number of packs: document
    `rank + j` of that rest, for j below depth * packs, has its ids from `start` in sequence
    `sequence + j % packs` at `offset + j // packs * length`.
    """
    whole, odd = divmod(sum(n * c for n, c in histogram.items()), size)
    rooms = [(-size, 0, whole, 0)] if whole else []
    packs = whole
    for digit in reversed(range(odd.bit_length())):
        if odd >> digit & 1:
            rooms.append((-(1 << digit), packs, packs + 1, 0))
            packs += 1
    left = [(-n, n, 0, 0, c) for n, c in histogram.items() if c]
    heapq.heapify(rooms)
    heapq.heapify(left)
    slots = []
    while left:
        length, rest, start, rank, count = heapq.heappop(left)
        room, first, stop, filled = heapq.heappop(rooms)
        length, room = -length, -room
        width = min(count, stop - first)
        if width < stop - first:
            heapq.heappush(rooms, (-room, first + width, stop, filled))
        taken, depth = min(length, room), 1
        if count >= 2 * width and length <= room:  # several rounds over the same run, until another has as much room
            other = -rooms[0][0] if rooms else 0
            depth = max(1, min(count // width, (room - other) // length + 1, room // length))
        slots.append((rest, start, taken, rank, depth, width, first, filled))
        if room > depth * taken:
            heapq.heappush(rooms, (depth * taken - room, first, first + width, filled + depth * taken))
        if length > taken:
            heapq.heappush(left, (taken - length, rest, start + taken, rank, width))
        if count > depth * width:
            heapq.heappush(left, (-length, rest, start, rank + depth * width, count - depth * width))
    return np.array(slots, np.int64).reshape(-1, 8), packs


class _Slots:
    """Pieces of a document by its rest and rank."""

    def __init__(self, slots: np.ndarray):
        self.by: dict[tuple[int, int], tuple[list, list]] = {}
        for s in slots[np.lexsort((slots[:, 3], slots[:, 1], slots[:, 0]))].tolist():
            ranks, rows = self.by.setdefault((s[0], s[1]), ([], []))
            ranks.append(s[3])
            rows.append(s)

    def pieces(self, rest: int, rank: int):
        start = 0
        while start < rest:
            ranks, rows = self.by[rest, start]
            _, _, length, first, _, packs, sequence, offset = rows[bisect_right(ranks, rank) - 1]
            turn, pack = divmod(rank - first, packs)
            yield start, length, sequence + pack, offset + turn * length
            start += length


def pack(docs: DataFrame, path: str, end_id: int, size: int = 4096, keep_ids: bool = True) -> DataFrame:
    """Pack the token ids of all documents into sequences of at most `size` ids.

    One row a piece: doc_id, start (ids of its document before it), length, ids_crc32, doc_tokens, sequence_id,
    offset (its place in the sequence) and, if `keep_ids`, ids (array<int>). Every id lies in one piece; sequences are full
    or as long as a power of two. `path` names a tokenizer as `WordEncoder` describes it; `end_id` ends each document.

    A null text counts as empty and gives one piece, `end_id` alone. Every row is a document of its own, also where doc_id is
    null or repeated. Texts of any length are encoded whole and cut into whole sequences first. Other columns are
    ignored; an empty table gives an empty result. Which of several equally long documents share a sequence
    depends on the order of the input files.
    """
    spark = docs.sparkSession
    rows = stored(encoded(docs, path, end_id, size), "packing")
    # a row for each task and length; whole sequences count as the length `size`
    counts = rows.groupBy("part", "rest").agg(F.count("*").alias("c"), F.sum(F.expr(f"n div {size}")).alias("w"))
    counts = stored(counts.where("rest > 0").select("part", "rest", "c").unionByName(
        counts.groupBy("part").agg(F.sum("w").alias("c")).where("c > 0").select("part", F.lit(size).alias("rest"), "c")), "lengths")
    histogram = {r["rest"]: r["c"] for r in counts.groupBy("rest").agg(F.sum("c").alias("c")).collect()}  # at most `size` rows
    histogram.pop(size, None)
    slots, packs = plan_packs(histogram, size)
    before = F.sum("c").over(Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.withColumn("base", F.coalesce(before, F.lit(0))).groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.struct("rest", "base"))).alias("base"))
    shared = spark.sparkContext.broadcast(slots)
    type_ = WordEncoder.of(path).type.str

    def run(batches):
        plan = _Slots(shared.value)
        for b in batches:
            cols = {n: [] for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            pieces_of = []
            bases: dict[int, dict] = {}
            at = {n: b.column(n).to_pylist() for n in ("doc_id", "n", "rest", "part", "nth", "before")}
            for i, raw in enumerate(b.column("ids")):
                part = at["part"][i]
                if part not in bases:
                    bases[part] = dict(b.column("base")[i].as_py())
                n, rest, base = at["n"][i], at["rest"][i], bases[part]
                whole = n // size
                first = packs + base.get(size, 0) + at["before"][i]
                found = [(k * size, size, first + k, 0) for k in range(whole)]
                if rest:
                    found += [(whole * size + s, m, q, o) for s, m, q, o in plan.pieces(rest, base[rest] + at["nth"][i])]
                ids = np.frombuffer(raw.as_buffer(), type_).astype("<u4")
                for s, m, q, o in found:
                    piece = ids[s : s + m]
                    for name, v in zip(cols, (at["doc_id"][i], s, m, zlib.crc32(piece), n, q, o)):
                        cols[name].append(v)
                    if keep_ids:
                        pieces_of.append(piece.astype(np.int32))
            cols = {n: pa.array(v, pa.int64()) for n, v in cols.items()}
            if keep_ids:
                cols["ids"] = pa.array(pieces_of, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.join(base, "part").mapInArrow(run, schema + (", ids array<int>" if keep_ids else ""))
