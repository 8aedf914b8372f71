"""Leftmost-longest matching of a symbol table of any size in texts.

A match begins and ends at a word boundary, the longest symbol that fits at a place wins, and the
search goes on behind it: what an alternation of all symbols, longest first, between word boundaries finds.
Symbols are cut into tokens (runs of word characters, single other characters) and kept in a trie of tokens, so
the work at a place is the length of the match, however many symbols there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

_WORD = re.compile(r"\w+")
_TOKEN = re.compile(r"\w+|\W")
#: Symbol tables up to this many bytes are sent to all tasks; of larger ones each text meets the symbols that its words begin.
TABLE_BYTES = 32 << 20
#: Rough cost of one symbol in a task beside its characters.
_ENTRY_BYTES = 300


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


class SymbolTrie:
    """Symbols of two characters and more, by token."""

    def __init__(self, symbols: Iterable[str]):
        self.first: dict = {}
        self.odd = False  # whether a symbol begins with something else than a word
        for s in symbols:
            if len(s) > 1:
                node = self.first
                for token in _TOKEN.findall(s):
                    node = node.setdefault(token, {})
                node[""] = s
                self.odd |= not _is_word(s[0])

    def _longest(self, text: str, node: dict, end: int) -> tuple[str, int] | None:
        best = None
        while True:
            if "" in node and (_is_word(text[end - 1]) or (end < len(text) and _is_word(text[end]))):
                best = node[""], end
            token = _TOKEN.match(text, end)
            if not token or token[0] not in node:
                return best
            node, end = node[token[0]], token.end()

    def find(self, text: str) -> Iterator[str]:
        """Symbols in `text` in order, without overlaps."""
        free = 0
        for m in (_TOKEN if self.odd else _WORD).finditer(text):
            node = self.first.get(m[0])
            if node is None or m.start() < free:
                continue
            if not _is_word(m[0][0]) and not (m.start() and _is_word(text[m.start() - 1])):
                continue
            found = self._longest(text, node, m.end())
            if found:
                yield found[0]
                free = found[1]


def _pairs(ids: pa.Array, texts: list[str | None], tries) -> pa.RecordBatch:
    at, symbols = [], []
    for i, (text, trie) in enumerate(zip(texts, tries)):
        if text and trie is not None:
            for s in dict.fromkeys(trie.find(text.upper())):
                at.append(i)
                symbols.append(s)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(symbols, pa.string())], ["_id", "symbol"])


def symbol_table(symbols: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Distinct upper-cased symbols of two characters and more."""
    return symbols.select(F.upper(F.col(symbol)).alias("symbol")).where(F.length("symbol") > 1).distinct()


def entity_scan(docs: DataFrame, symbols: DataFrame, doc_id: str = "doc_id", text: str = "content", symbol: str = "symbol",
                title: str | None = None, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(doc, symbol) for each symbol that occurs in the upper-cased title and text, by leftmost-longest match.

    A table of at most `table_bytes` goes to all tasks as one trie. Beyond that size the distinct words of each text are joined with
    the symbols they begin, and the text meets only those. Each symbol counts once for a row; NULL texts hold none.
    """
    body = F.col(text) if title is None else F.concat_ws(" ", F.col(title), F.col(text))
    own = docs.select(F.col(doc_id).alias("_id"), body.alias("_text"))
    known = symbol_table(symbols, symbol)
    id_type = docs.schema[doc_id].dataType.simpleString()
    size = known.agg(F.sum(F.octet_length("symbol") + _ENTRY_BYTES)).first()[0] or 0
    if size <= table_bytes:
        shared = docs.sparkSession.sparkContext.broadcast([r[0] for r in known.collect()])

        def run(batches):
            trie = SymbolTrie(shared.value)
            for b in batches:
                texts = b.column("_text").to_pylist()
                yield _pairs(b.column("_id"), texts, [trie] * len(texts))

        return own.mapInArrow(run, f"_id {id_type}, symbol string").withColumnRenamed("_id", doc_id)

    def heads(batches):
        for b in batches:
            at, tokens = [], []
            for i, t in enumerate(b.column("_text").to_pylist()):
                new = set(_TOKEN.findall((t or "").upper()))
                at += [i] * len(new)
                tokens += new
            yield pa.RecordBatch.from_arrays([b.column("_id").take(pa.array(at, pa.int64())), pa.array(tokens, pa.string())], ["_id", "_head"])

    def by_head(batches):
        for b in batches:
            heads = [m[0] for m in map(_TOKEN.match, b.column("symbol").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("symbol"), pa.array(heads, pa.string())], ["symbol", "_head"])

    words = own.mapInArrow(heads, f"_id {id_type}, _head string").distinct()
    mine = words.join(known.mapInArrow(by_head, "symbol string, _head string"), "_head").groupBy("_id").agg(F.collect_set("symbol").alias("_known"))

    def run_own(batches):
        for b in batches:
            yield _pairs(b.column("_id"), b.column("_text").to_pylist(), map(SymbolTrie, b.column("_known").to_pylist()))

    return own.join(mine, "_id").mapInArrow(run_own, f"_id {id_type}, symbol string").withColumnRenamed("_id", doc_id)


def dictionary_hits(text: Column, symbols: Iterable[str]) -> Column:
    """The same match for a short literal list, inside the expression: distinct symbols of the upper-cased text in order."""
    word, other = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
    parts = []
    for s in sorted({s.upper() for s in symbols if len(s) > 1}, key=lambda s: (-len(s), s)):
        before = f"(?<!{word})" if _is_word(s[0]) else f"(?<={word})"
        after = f"(?!{word})" if _is_word(s[-1]) else f"(?={word})"
        parts.append(before + re.sub(other.replace(r"\p{L}\p{N}_", r"\w"), lambda m: "\\" + m[0], s) + after)
    if not parts:
        return F.array().cast("array<string>")
    return F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit("|".join(parts)), F.lit(0)))
