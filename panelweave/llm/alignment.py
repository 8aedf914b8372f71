"""Alignment of two tokenizers: token-byte incidence matrices and their row products.

Token i of a text covers some of its bytes, which is row i of a 0/1 matrix over bytes. With A for
one tokenizer and B for the other, A·Bᵀ holds at (i, j) the number of bytes that both tokens cover: the overlap
links. Tokens against the groups between common token ends give two more such matrices, whose
product links the tokens that share a group. Texts follow one another in one matrix (block diagonal).
"""

from __future__ import annotations

import hashlib
import os
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from panelweave.llm.common import columns, stored

#: Characters of text (or bytes covered by tokens) handled at a time.
BLOCK = 1 << 18
#: Id pairs up to this number (16 bytes each) are broadcast; more are sent to the tasks that ask for them.
BROADCAST_PAIRS = 4_000_000
#: Words of A kept in a worker's memo, and the longest word that enters it.
MEMO, MEMO_WORD = 400_000, 64
#: Links of a matrix product made at a time where a group may be large.
PRODUCT = 1 << 20


_WIDE = re.compile(r"\s\s")
_CLOSING = frozenset(".,;:!?")


class Csr(NamedTuple):
    """Compressed sparse rows: row i has the columns indices[indptr[i]:indptr[i + 1]], with their values."""

    indptr: np.ndarray
    indices: np.ndarray
    values: np.ndarray
    width: int

    def rows(self, a: int, b: int) -> "Csr":
        x, y = self.indptr[a], self.indptr[b]
        return Csr(self.indptr[a : b + 1] - x, self.indices[x:y], self.values[x:y], self.width)


def incidence(sizes: np.ndarray) -> Csr:
    """Tokens against bytes: token i covers the sizes[i] bytes behind those of the tokens before it."""
    indptr = np.concatenate(([0], np.cumsum(sizes)))
    return Csr(indptr, np.arange(indptr[-1]), np.ones(indptr[-1], np.int64), int(indptr[-1]))


def membership(groups: np.ndarray, width: int) -> Csr:
    """Tokens against groups: token i is in group groups[i]."""
    return Csr(np.arange(len(groups) + 1), groups, np.ones(len(groups), np.int64), width)


def transposed(m: Csr) -> Csr:
    order = np.argsort(m.indices, kind="stable")
    row = np.repeat(np.arange(len(m.indptr) - 1), np.diff(m.indptr))
    indptr = np.concatenate(([0], np.cumsum(np.bincount(m.indices, minlength=m.width))))
    return Csr(indptr, row[order], m.values[order], len(m.indptr) - 1)


def row_product(a: Csr, b: Csr) -> Csr:
    """a·b by Gustavson's rule: row i is the sum of the rows of b that the entries of row i name, all rows at once."""
    fan = np.diff(b.indptr)[a.indices]  # entries that each entry of a brings in
    at = np.repeat(b.indptr[a.indices] - np.cumsum(fan) + fan, fan) + np.arange(int(fan.sum()))
    row = np.repeat(np.repeat(np.arange(len(a.indptr) - 1), np.diff(a.indptr)), fan)
    value = np.repeat(a.values, fan) * b.values[at]
    key = row * max(b.width, 1) + b.indices[at]
    if (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
    row, col = np.divmod(key[first], max(b.width, 1))
    indptr = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(a.indptr) - 1))))
    return Csr(indptr, col, np.add.reduceat(value, first) if len(first) else value, b.width)


class Tokenizers:
    """Both tokenizers with the bytes of their tokens: A byte-level (`tokenizers`), B of pieces (`sentencepiece`)."""

    _HELD: dict[tuple[str, str], "Tokenizers"] = {}

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; others follow from 256 on
        raw = {c: c for c in shown} | {256 + k: c for k, c in enumerate(sorted({*range(256)} - {*shown}))}
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(raw[ord(c)] for c in token) if all(ord(c) in raw for c in token) else token.encode()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.sizes_a, self.sizes_b = (np.array([*map(len, x)], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.type = np.dtype("<u2" if max(len(self.bytes_a), len(self.bytes_b)) <= 1 << 16 else "<u4")
        # words of letters pass by the pre-tokenizer: the model of A alone, on their bytes as its vocabulary writes them
        self.model_a = Tokenizer(self.a.model)
        self.model_a.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = {b: c for c, b in raw.items()}
        self.starts_word = np.array([b[:1] == b" " for b in self.bytes_a])
        self.memo: dict[str, bytes] = {}
        # decimal ids with each separator, for the groups' text: padded with zero bytes that are deleted at the end
        n = max(len(self.bytes_a), len(self.bytes_b))
        self.shown = np.array([b"%d%s" % (i, s) for s in (b",", b"|", b";") for i in range(n)])
        self.n_shown = n

    @classmethod
    def of(cls, path_a: str, path_b: str) -> "Tokenizers":
        """One for each worker process."""
        key = path_a, path_b
        if key not in cls._HELD:
            cls._HELD[key] = cls(*key)
        return cls._HELD[key]

    def _learn(self, words: set[str]) -> None:
        """Ids of a blank and each word by A; a closing mark behind a letter is a token of its own."""
        memo, parts, plain, other = self.memo, [], set(), set()
        for w in words:
            base = w[:-1] if w[-1:] in _CLOSING and w[-2:-1].isalpha() else w
            if base not in memo:
                (plain if base.isalpha() else other).add(base)
            if base is not w:
                parts.append((w, base, w[-1]))
        plain, other = list(plain), list(other)
        size = self.type.itemsize
        for at in range(0, len(plain), 1000):
            some = plain[at : at + 1000]
            text = " ".join([(" " + w).encode().decode("latin-1").translate(self.letters) for w in some])
            ids = np.array(self.model_a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.type)
            raw, first = ids.tobytes(), (np.flatnonzero(self.starts_word[ids]) * size).tolist()
            for w, x, y in zip(some, first, [*first[1:], len(raw)], strict=True):
                memo[w] = raw[x:y]
        for w, e in zip(other, self.a.encode_batch_fast([" " + w for w in other], add_special_tokens=False)):
            memo[w] = np.array(e.ids, self.type).tobytes()
        for w, base, mark in parts:
            memo[w] = memo[base] + self.marks[mark]

    def encode_a(self, texts: list[str]) -> list[bytes]:
        """Packed ids of space + text by A.

        Where no two characters of white space meet, a token never reaches over a blank that separates words, so
        the ids are those of its words, one after the other, from a memo. Other texts are encoded as they are.
        """
        if not hasattr(self, "marks"):
            self.marks = {m: np.array(self.a.encode(m, add_special_tokens=False).ids, self.type).tobytes() for m in _CLOSING}
        if len(self.memo) > MEMO:
            self.memo.clear()
        words = [None if _WIDE.search(t) or t[:1].isspace() else t.split(" ") for t in texts]
        missing = set().union(*[w for w in words if w]) - self.memo.keys()
        self._learn(missing)
        whole = iter(self.a.encode_batch_fast([" " + t for t, w in zip(texts, words) if w is None], add_special_tokens=False))
        out = [b"".join(map(self.memo.__getitem__, w)) if w is not None else np.array(next(whole).ids, self.type).tobytes() for w in words]
        for w in missing:
            if len(w) > MEMO_WORD:
                del self.memo[w]
        return out

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Packed ids of each text by A and B; none where a text is empty or the joined token bytes differ from space + text."""
        out_a, out_b = [], []
        for t, x, y in zip(texts, self.encode_a(texts), self.b.encode(texts, num_threads=1)):
            raw = (" " + t).encode()
            ok = t and b"".join(map(self.bytes_a.__getitem__, np.frombuffer(x, self.type).tolist())) == raw == b"".join(map(self.bytes_b.__getitem__, y))
            out_a.append(x if ok else b"")
            out_b.append(np.array(y, self.type).tobytes() if ok else b"")
        return out_a, out_b


class Block:
    """Some texts' tokens by both tokenizers, their groups and overlap links."""

    def __init__(self, both: Tokenizers, ids_a: list[np.ndarray], ids_b: list[np.ndarray]):
        self.n_a, self.n_b = (np.array([*map(len, x)], np.int64) for x in (ids_a, ids_b))
        self.a, self.b = (np.concatenate([np.zeros(0, both.type), *x]).astype(np.int64) for x in (ids_a, ids_b))
        bytes_a, self.bytes_b = incidence(both.sizes_a[self.a]), incidence(both.sizes_b[self.b])
        ends_a, ends_b = bytes_a.indptr[1:], self.bytes_b.indptr[1:]
        is_end = np.zeros((2, bytes_a.width + 1), bool)
        is_end[0, ends_a] = is_end[1, ends_b] = True
        self.cut_a, self.cut_b = is_end[1, ends_a], is_end[0, ends_b]  # tokens that close a group
        self.group_a, self.group_b = np.cumsum(self.cut_a) - self.cut_a, np.cumsum(self.cut_b) - self.cut_b
        self.links = row_product(bytes_a, transposed(self.bytes_b))

    def text_of(self, side: str) -> np.ndarray:
        """Number of the text that each token is in."""
        n = self.n_a if side == "a" else self.n_b
        return np.repeat(np.arange(len(n)), n)

    def sums(self, values: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.bincount(of, values, len(self.n_a)).astype(np.int64) if len(values) else np.zeros(len(self.n_a), np.int64)

    def pairs(self, size_b: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, id pair) of each overlap link; a pair is id_a * size_b + id_b."""
        row = np.repeat(np.arange(len(self.a)), np.diff(self.links.indptr))
        return self.text_of("a")[row], self.a[row] * size_b + self.b[self.links.indices]

    def shared_groups(self) -> Csr:
        """Matrices whose row product links tokens of one group: tokens of A by group, groups by tokens of B."""
        n = int(self.cut_a.sum())
        return membership(self.group_a, n), transposed(membership(self.group_b, n))

    def group_texts(self, both: Tokenizers) -> list[bytes]:
        """`a1,a2|b1;a3|b2,b3` of each text."""
        at_a = np.arange(len(self.a)) + np.searchsorted(self.group_b, self.group_a)
        at_b = np.arange(len(self.b)) + np.searchsorted(self.group_a, self.group_b, "right")
        code = np.empty(len(self.a) + len(self.b), np.int64)
        code[at_a] = self.a + self.cut_a * both.n_shown
        code[at_b] = self.b + self.cut_b * (2 * both.n_shown)
        shown = both.shown[code]
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return [shown[x:y].tobytes().replace(b"\0", b"")[:-1] for x, y in zip([0, *ends], ends)]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text")


def tokens(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, part (the task), ids_a and ids_b (packed) of every row."""
    from panelweave.llm.packing import blocks

    def run(batches):
        part, both = TaskContext.get().partitionId(), Tokenizers.of(path_a, path_b)
        for ids, texts in columns(batches, "doc_id", "text"):
            texts = [t or "" for t in texts]
            for x, y in blocks(texts, BLOCK):
                a, b = both.encode(texts[x:y])
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids[x:y], pa.int64()), "part": pa.array([part] * (y - x), pa.int32()),
                                                  "ids_a": pa.array(a, pa.binary()), "ids_b": pa.array(b, pa.binary())})

    return _texts(docs).mapInArrow(run, "doc_id long, part int, ids_a binary, ids_b binary")


def _blocks(batches, both: Tokenizers):
    """(rows of an Arrow batch, their Block), a bounded number of covered bytes at a time."""
    for batch in batches:
        ids = [[np.frombuffer(x, both.type) for x in batch.column(c).to_pylist()] for c in ("ids_a", "ids_b")]
        a = covered = 0
        for i, x in enumerate(ids[0]):
            n = int(both.sizes_a[x].sum())
            if covered and covered + n > BLOCK:
                yield batch.slice(a, i - a), Block(both, ids[0][a:i], ids[1][a:i])
                a, covered = i, 0
            covered += n
        if a < batch.num_rows:
            yield batch.slice(a), Block(both, ids[0][a:], ids[1][a:])


def pair_documents(rows: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """part, pair, n: rows of each task that hold an overlap link of the id pair."""
    def run(batches):
        both, held, size, part = Tokenizers.of(path_a, path_b), [], 0, None

        def summed():
            pairs, n = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(pairs, kind="stable")
            pairs, n = pairs[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
            return pairs[first], np.add.reduceat(n, first)

        def out():
            if held and len(held[0][0]):
                pairs, n = summed()
                for x in range(0, len(pairs), 1 << 16):
                    yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(pairs[x : x + (1 << 16)]), part, np.int32)),
                                                      "pair": pa.array(pairs[x : x + (1 << 16)]), "n": pa.array(n[x : x + (1 << 16)])})

        for batch, block in _blocks(batches, both):
            for p in np.unique(batch.column("part").to_numpy()).tolist():
                if p != part:
                    yield from out()
                    held, size, part = [], 0, p
                text, pair = block.pairs(len(both.bytes_b))
                mine = (batch.column("part").to_numpy() == p)[text]
                if not mine.all():
                    text, pair = text[mine], pair[mine]
                # a text counts once for each pair
                order = np.lexsort((text, pair)) if len(block.n_a) > 1 else np.argsort(pair, kind="stable")
                text, pair = text[order], pair[order]
                new = np.concatenate(([True], (pair[1:] != pair[:-1]) | (text[1:] != text[:-1])))[: len(pair)]
                pair = pair[new]
                first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))[: len(pair)])
                held.append((pair[first], np.diff(np.append(first, len(pair)))))
                size += len(first)
                if size > 1 << 21:
                    held = [summed()]
                    size = len(held[0][0])
                    if size > 1 << 20:  # a partial sum may leave early; sums of sums are the same
                        yield from out()
                        held, size = [], 0
        yield from out()

    return rows.mapInArrow(run, "part int, pair long, n long")


def pair_counts(partial: DataFrame, size_b: int) -> DataFrame:
    """pair, n (rows of the corpus that hold it linked), best (whether no pair of its A id has more)."""
    counts = stored(partial.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    a = F.expr(f"pair div {size_b}").alias("a")
    most = counts.groupBy(a).agg(F.max("n").alias("most"))
    return stored(counts.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")


def _report(batches, both: Tokenizers, lookup):
    for batch, block in _blocks(batches, both):
        text, pair = block.pairs(len(both.bytes_b))
        distinct, where = np.unique(pair, return_inverse=True)
        n, best = lookup(batch, distinct)
        n, best = n[where], best[where]
        ga, gb = block.shared_groups()
        in_group = np.diff(gb.indptr)[ga.indices]  # sizes of the rows of the group product
        of_a = block.text_of("a")
        cols = {"doc_id": batch.column("doc_id"), "n_a": block.n_a, "n_b": block.n_b, "n_groups": block.sums(block.cut_a, of_a),
                "n_links": block.sums(np.ones(len(text)), text), "n_best": block.sums(best, text)}
        # exact in 64 bits: floats of bincount would round large sums
        total = np.zeros(len(block.n_a), np.int64)
        np.add.at(total, text, n)
        digest = [hashlib.sha256(g).hexdigest() if g else "" for g in block.group_texts(both)]
        yield pa.RecordBatch.from_pydict(cols | {"count_sum": total, "groups_sha256": digest, "n_shared": block.sums(in_group, of_a)})


REPORT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_shared long"


def report(docs: DataFrame, path_a: str, path_b: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """How two tokenizers align on every document.

    doc_id, n_a, n_b (tokens), n_groups (runs between offsets where tokens of both end), n_links (token pairs
    that share bytes), n_best (links whose id pair is linked in most documents among those of its A id, ties
    included), count_sum (documents that hold the pair, summed over links), groups_sha256 of `a1,a2|b1;a3|b2,b3`, and
    n_shared (token pairs that share a group). Texts that are null or empty, or whose joined token bytes differ
    from space + text, have no tokens: zeros and ''. Every row is a document of its own, also where doc_id is null or
    repeated. Long texts are aligned whole; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = stored(tokens(docs, path_a, path_b), "tokens")
    partial = stored(pair_documents(rows, path_a, path_b), "partial")
    size_b = len(Tokenizers.of(path_a, path_b).bytes_b)
    counts = pair_counts(partial, size_b)
    if counts.count() <= broadcast_pairs:
        table = counts.orderBy("pair").toArrow()
        shared = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))

        def by_table(batches):
            pairs, n, best = shared.value

            def lookup(_, wanted):
                at = np.searchsorted(pairs, wanted)
                return n[at], best[at]

            yield from _report(batches, Tokenizers.of(path_a, path_b), lookup)

        return rows.mapInArrow(by_table, REPORT)
    # each task's rows meet the counts of the pairs they hold, packed in one row
    asked = partial.select("part", "pair").distinct().join(counts, "pair").groupBy("part").agg(
        F.sort_array(F.collect_list(F.struct("pair", "n", "best"))).alias("known"))

    def by_part(batches):
        held: dict[int, tuple] = {}

        def known(batch):
            part = batch.column("part")[0].as_py()
            if part not in held:
                held.clear()
                s = batch.column("known")[0].values
                held[part] = tuple(s.field(c).to_numpy(zero_copy_only=False) for c in ("pair", "n", "best"))
            return held[part]

        def lookup(batch, wanted):
            if not len(wanted):
                return np.zeros(0, np.int64), np.zeros(0, bool)
            pairs, n, best = known(batch)
            at = np.searchsorted(pairs, wanted)
            return n[at], best[at]

        def by_one_part():
            for b in batches:
                parts = b.column("part").to_numpy()
                for p in np.unique(parts).tolist():
                    yield b.filter(pa.array(parts == p))

        yield from _report(by_one_part(), Tokenizers.of(path_a, path_b), lookup)

    return rows.join(asked, "part", "left").mapInArrow(by_part, REPORT)


def links(docs: DataFrame, path_a: str, path_b: str, kind: str = "overlap") -> DataFrame:
    """The links themselves: doc_id, a and b (token positions), id_a, id_b, weight.

    `overlap`: tokens that share bytes, weight is how many. `group`: tokens between the same common ends, weight 1. Rows
    without tokens give none; nulls, repeats and empty tables as in `report`.
    """
    if kind not in ("overlap", "group"):
        raise ValueError(f"unknown kind of link: {kind}")

    def run(batches):
        both = Tokenizers.of(path_a, path_b)
        for batch, block in _blocks(batches, both):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            starts_a, starts_b = np.cumsum(block.n_a) - block.n_a, np.cumsum(block.n_b) - block.n_b
            of_a = block.text_of("a")
            if kind == "overlap":
                products = [(0, block.links)]
            else:
                ga, gb = block.shared_groups()
                made = np.cumsum(np.diff(gb.indptr)[ga.indices])
                cuts = np.unique(np.searchsorted(made, np.arange(0, int(made[-1]) if len(made) else 0, PRODUCT)))
                products = ((x, row_product(ga.rows(x, y), gb)) for x, y in zip(cuts, [*cuts[1:], len(block.a)]))
            for x, p in products:
                row = x + np.repeat(np.arange(len(p.indptr) - 1), np.diff(p.indptr))
                text = of_a[row]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids[text], pa.int64(), from_pandas=True), "a": row - starts_a[text], "b": p.indices - starts_b[text],
                    "id_a": block.a[row], "id_b": block.b[p.indices], "weight": p.values})

    return tokens(docs, path_a, path_b).mapInArrow(run, "doc_id long, a long, b long, id_a long, id_b long, weight long")
