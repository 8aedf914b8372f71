"""Line dedup by an exact set-similarity join: rarity order, prefix, length and positional filters.

A line is its set of distinct words. Lines of equal sets are one class, known by its
first line. Every class lists its rarest words (the prefix in which similar lines must
meet); lists are split by word over the cluster and stream through their tasks in order.
Length, positional and bit map filters bound the overlap before two whole sets are compared; two lines are paired where
they may meet in their first common word, so nothing before it counts towards the overlap.
Words are hashed and sets made for some megabytes of text at once. Lists sorted by set size pair each line with the
range of sizes and places that can still reach the similarity. Lists that are too long for that, or hold
very many pairs, compare each line with their first line, which resolves large groups of
near copies at linear cost; only lines without an earlier partner so far are then compared with all
earlier ones.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from panelweave.llm.common import LOWER, columns, ids_and_bytes, mixed, pieces, stored

#: Tables up to this many bytes are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Frequent words whose counts order the words of a line (16 bytes each, broadcast). All others count as rare.
FREQUENT = 1 << 17
#: Places of these words by the top bits of their hash: 9 MB in all. Of words with one place the most frequent has it.
SLOT_BITS = 20
#: Words counted at a time in a task; words met less than SEEN times among them are not reported as frequent.
COUNTED, SEEN = 1 << 22, 3
#: The 64-bit words of a line's bit map.
MAPS = ("b1", "b2")
#: Lists up to this length, with up to DENSE pairs a row, are paired where they are sorted; all others by the exact two rounds of `_long_lists`.
SHORT_LIST, DENSE = 16384, 8
#: Rows of lists that a task takes together, and pairs that it compares together.
GATHERED, PAIRED = 1 << 17, 1 << 17
#: Table of ASCII white space, and masks of the first bytes of a little-endian number.
BLANK = bytes(b in b" \t\n\v\f\r" for b in range(256))
HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _ranked(h: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Word hashes with a weight in the top bits, 0 for rare words: their order is rarity, their value names the word."""
    known, weight = frequent
    at = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    w = np.where(known[at] == h, weight[at], np.uint8(0)).astype(np.uint64)
    return (w << np.uint64(58)) | (h >> np.uint64(6))


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and first byte of every word of `raw`, A-Z lower-cased. Up to 64 bytes of a word are read 8 at a time, for all words at once."""
    low = raw.translate(LOWER)
    blank = np.frombuffer(b"\1" + low.translate(BLANK) + b"\1", np.uint8)
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    start, size = edges[0::2], edges[1::2] - edges[0::2]
    eight = np.ndarray((len(low) + 1,), "<u8", low + bytes(8), strides=(1,))
    h = mixed((eight[start] & HEAD[np.minimum(size, 8)]) ^ (size.astype(np.uint64) << np.uint64(56)))
    at, more = 8, np.flatnonzero(size > 8)
    while len(more) and at < 64:
        h[more] = mixed(h[more] * np.uint64(0x9E3779B97F4A7C15) + (eight[start[more] + at] & HEAD[np.minimum(size[more] - at, 8)]))
        at += 8
        more = more[size[more] > at]
    for i in more.tolist():
        h[i] = xxhash.xxh3_64_intdigest(low[start[i] : start[i] + size[i]])
    return h, start


def _sets(raw: bytes, frequent: tuple, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Lines of `raw` with at least `least` distinct words: their numbers, where their sets begin and the last one ends, the sets (rarest word first), bit maps.

    Each word of the set flips one bit of the map, so two maps differ in no more bits than the sets differ in words, and long lines don't fill it.
    """
    h, start = _word_hashes(raw)
    words = _ranked(h, frequent)
    ends = np.searchsorted(start, np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) == 10), len(raw)))
    at = 0
    for end in ends.tolist():
        words[at:end].sort()
        at = end
    line = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (line[1:] != line[:-1])
    n = np.bincount(line[new], minlength=len(ends))
    kept = n >= max(least, 1)
    new &= kept[line]
    words, lines, n = words[new], np.flatnonzero(kept), n[kept]
    bounds = np.concatenate(([0], np.cumsum(n)))
    bit, place = np.uint64(1) << (words & np.uint64(63)), words >> np.uint64(6) & np.uint64(len(MAPS) - 1)
    maps = [np.bitwise_xor.reduceat(np.where(place == k, bit, np.uint64(0)), bounds[:-1]).view(np.int64) if len(n) else np.zeros(0, np.int64) for k in range(len(MAPS))]
    return lines, bounds, words, maps


def _line_sets(text: bytes, frequent: tuple, least: int, only=None):
    """(line number, distinct words, rarest first, bit map) of the lines, or those of `only`, with at least `least` distinct words."""
    if only is not None:
        rows = text.split(b"\n")
        text = b"\n".join([rows[i] for i in only])
    lines, bounds, words, maps = _sets(text, frequent, least)
    for k, i in enumerate(lines.tolist()):
        yield i if only is None else only[i], words[bounds[k] : bounds[k + 1]], tuple(int(m[k]) for m in maps)


def frequent_words(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hash, weight from 1 up) of at most FREQUENT words of all lines, each at its place.

    Counts decide rarity only, never a match; words that no task meets SEEN times are left to the rare ones.
    """
    def run(batches):
        def words():
            held, n = np.empty(COUNTED, np.uint64), 0
            for ids, texts in columns(pieces(batches), "doc_id", "text"):
                h = _word_hashes(b"\n".join(texts))[0]
                while len(h):
                    part, h = h[: COUNTED - n], h[COUNTED - n :]
                    held[n : n + len(part)] = part
                    n += len(part)
                    if n == COUNTED:
                        yield held
                        n = 0
            yield held[:n]

        for h in words():
            h.sort()
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
            n = np.diff(first, append=len(h))
            h, n = h[first[n >= SEEN]], n[n >= SEEN]
            yield pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    counts = stored(ids_and_bytes(docs).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "counts")
    counts = counts.withColumn("bin", F.floor(F.log2("n") * 8))
    least, held = None, 0
    for r in sorted(counts.groupBy("bin").count().collect(), key=lambda r: -r["bin"]):  # some hundred bins
        held += r["count"]
        if held > FREQUENT:
            break
        least = r["bin"]
    known, weight = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.uint8)
    if least is not None:
        rows = counts.where(F.col("bin") >= least).select("h", "n").toArrow()
        h, n = rows.column("h").to_numpy().view(np.uint64), rows.column("n").to_numpy()
        order = np.lexsort((h, n))  # the last one written stays
        h, n = h[order], n[order]
        at = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        known[at], weight[at] = h, np.minimum(1 + np.floor(3 * np.log2(n / n[0])), 63)
    return known, weight


def line_signatures(docs: DataFrame, percent: int, least: int, weight) -> DataFrame:
    """doc_id, line, n (distinct words), key (digest of the set), rare (names of the prefix lists, rarest first), MAPS (bit map).

    A list is named by 32 bits of a word's hash; words that share a name only add candidates.
    Sets too small to be similar to any other set (at 80 percent those of 1 to 3 words) are in no list; their key finds equal ones.
    """
    def run(batches):
        f = weight.value
        for ids, texts in columns(pieces(batches), "doc_id", "text"):
            rows = np.array([t.count(b"\n") + 1 for t in texts])
            line, bounds, words, maps = _sets(b"\n".join(texts), f, least)
            doc = np.repeat(np.arange(len(rows)), rows)[line]
            n = np.diff(bounds)
            listed = np.where(100 * n >= percent * (n + 1), n + percent * n // -100 + 1, 0)
            rare = words[np.arange(len(words)) - np.repeat(bounds[:-1], n) < np.repeat(listed, n)]
            rare = (mixed(rare) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            raw, ends = words.tobytes(), (8 * bounds).tolist()
            key = [xxhash.xxh3_128_digest(raw[x:y]) for x, y in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(np.array(ids, np.int64)[doc]), "line": pa.array(line - (np.cumsum(rows) - rows)[doc]), "n": pa.array(n),
                "key": pa.array(key, pa.binary()), "rare": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(listed)).astype(np.int32)), pa.array(rare)),
                **{b: pa.array(v) for b, v in zip(MAPS, maps)}})

    schema = "doc_id long, line long, n long, key binary, rare array<int>, " + ", ".join(f"{b} long" for b in MAPS)
    return ids_and_bytes(docs).where("doc_id is not null").mapInArrow(run, schema)


def _small(df: DataFrame, size: Column) -> DataFrame:
    """Broadcast a table whose rows of `size` bytes add up to little; else leave the join to Spark."""
    df = stored(df, "small")
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def _sets_of(docs: DataFrame, pairs: DataFrame, least: int, weight) -> DataFrame:
    """Whole sets of the lines in `pairs` only."""
    def run(batches):
        f = weight.value
        for ids, texts, wanted in columns(pieces(batches), "doc_id", "text", "wanted"):
            rows = [(d, i, s.astype("<u8").tobytes()) for d, t, w in zip(ids, texts, wanted) for i, s, _ in _line_sets(t, f, least, w)]
            d, i, s = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(d, pa.int64()), "line": pa.array(i, pa.int64()), "s": pa.array(s, pa.binary())})

    both = pairs.select("a", "al").unionByName(pairs.select(F.col("b").alias("a"), F.col("bl").alias("al"))).distinct()
    ids = _small(both.groupBy(F.col("a").alias("doc_id")).agg(F.collect_list("al").alias("wanted")), F.size("wanted") * 8 + 40)
    return ids_and_bytes(docs).join(ids, "doc_id").mapInArrow(run, "doc_id long, line long, s binary")


def _similar(docs: DataFrame, pairs: DataFrame, percent: int, least: int, weight) -> DataFrame:
    """Lines a of `pairs` (a, al, b, bl) that reach the similarity with some b: (a, al), distinct."""
    def run(batches):
        for a, al, sa, sb in columns(batches, "a", "al", "sa", "sb"):
            ok = []
            for x, y in zip(sa, sb):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                same = int((y[at] == x).sum())
                ok.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "al": pa.array(al, pa.int64())}).filter(pa.array(ok, pa.bool_()))

    sets = _sets_of(docs, pairs, least, weight)
    full = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("line").alias("al"), F.col("s").alias("sa")), ["a", "al"]).join(
        sets.select(F.col("doc_id").alias("b"), F.col("line").alias("bl"), F.col("s").alias("sb")), ["b", "bl"])
    return stored(full.mapInArrow(run, "a long, al long").distinct(), "similar")


def _short_pairs(percent: int):
    """Stream of prefix lists sorted by (g, x), so by size: pairs that pass all filters, and the rows of lists that are too long or hold very many pairs."""
    def paired(c, i, j):
        """Pairs (i, j), i the larger set, that may reach the similarity, and the bits in which their maps differ."""
        n1, n2 = c["x"][i] >> 32, c["x"][j] >> 32
        need = -(-percent * (n1 + n2) // (100 + percent))
        # as their first common word: whatever they share lies from here on
        ok = np.flatnonzero(n2 - (c["x"][j] & 0xFFFFFFFF) >= need)
        i, j, room = i[ok], j[ok], (n1 + n2 - 2 * need)[ok]
        differ = sum((np.bitwise_count((c[m][i] ^ c[m][j]).view(np.uint64)).astype(np.int64) for m in MAPS), np.zeros(len(i), np.int64))
        ok = (differ <= room) & ((c["a"][i] != c["a"][j]) | (c["al"][i] != c["al"][j]))
        return i[ok], j[ok], differ[ok]

    def pairs(c):
        """Pairs of all lists, and which lists hold more than DENSE pairs a row; their pairs are left out."""
        n, place = c["x"] >> 32, c["x"] & 0xFFFFFFFF
        new = np.concatenate(([True], c["g"][1:] != c["g"][:-1]))
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        dense, held, found = np.zeros(len(size), bool), np.zeros(len(size), np.int64), []
        i = np.flatnonzero(~new)
        # partners are at most as large, and not so small that too little is left behind the word or in all
        order = group << 32 | n
        low = np.searchsorted(order, group[i] << 32 | -(-percent * n[i] // 100))
        most = np.minimum(n[i], (100 + percent) * (n[i] - place[i]) // percent - n[i])
        count = np.minimum(np.searchsorted(order, (group[i] << 32) + most, "right"), i) - low
        i, low, count = i[count > 0], low[count > 0], count[count > 0]
        while len(i):
            total = np.cumsum(count)
            stop = max(1, int(np.searchsorted(total, PAIRED, "right")))
            of, first, many = i[:stop], low[:stop], count[:stop]
            j = np.arange(total[stop - 1]) + np.repeat(first - (total[:stop] - many), many)
            x = paired(c, np.repeat(of, many), j)
            held += np.bincount(group[x[0]], minlength=len(size))
            found.append(x)
            i, low, count = i[stop:], low[stop:], count[stop:]
            if (held > DENSE * size).any():
                dense = held > DENSE * size
                found = [tuple(v[~dense[group[x[0]]]] for v in x) for x in found]
                open_ = ~dense[group[i]]
                i, low, count = i[open_], low[open_], count[open_]
        return found, dense[group]

    def batch(found: dict) -> pa.RecordBatch:
        size = len(found["a"])
        return pa.RecordBatch.from_pydict({n: pa.array(found[n], pa.int64()) if n in found else pa.nulls(size, pa.int64()) for n in LISTED})

    def settled(c):
        found, dense = pairs(c)
        if dense.any():
            yield batch({n: v[dense] for n, v in c.items()})
        for i, j, differ in found:
            if len(i):
                later = (c["a"][i] > c["a"][j]) | (c["a"][i] == c["a"][j]) & (c["al"][i] > c["al"][j])
                i, j = np.where(later, i, j), np.where(later, j, i)
                yield batch({"a": c["a"][i], "al": c["al"][i], "x": differ, "b": c["a"][j], "bl": c["al"][j]})

    def run(batches):
        held, rows, long = [], 0, None
        for b in chain(batches, (None,)):
            if b is not None:
                held.append({n: b.column(n).to_numpy(zero_copy_only=False) for n in LISTED[:-2]})
                rows += b.num_rows
            if not rows or b is not None and rows < GATHERED:
                continue
            c = {n: np.concatenate([h[n] for h in held]) for n in LISTED[:-2]}
            g = c["g"]
            start = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            size = np.diff(np.append(start, len(g)))
            is_long = size > SHORT_LIST
            if long is not None and g[0] == long:
                is_long[0] = True
            cut = len(g) if b is None or is_long[-1] else start[-1]
            if is_long[-1]:
                long = g[-1]
            rows_long = np.repeat(is_long, size)[:cut]
            if rows_long.any():
                yield batch({n: v[:cut][rows_long] for n, v in c.items()})
            if not rows_long.all():
                yield from settled({n: v[:cut][~rows_long] for n, v in c.items()})
            held, rows = [{n: v[cut:] for n, v in c.items()}], len(g) - cut

    return run


LISTED = ("g", "a", "al", "x", *MAPS, "b", "bl")


def _may_reach(percent: int) -> Column:
    """Length, positional and bit map filters for lines a and b that meet in a list."""
    n, m, p, q = (F.shiftright("xa", 32), F.shiftright("xb", 32), F.col("xa").bitwiseAND(0xFFFFFFFF), F.col("xb").bitwiseAND(0xFFFFFFFF))
    need = F.ceil(percent * (n + m) / (100 + percent))
    apart = sum((F.bit_count(F.col(f"a{b}").bitwiseXOR(F.col(f"c{b}"))) for b in MAPS), F.lit(0))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (F.least(n - p, m - q) >= need) & (apart <= n + m - 2 * need)


def _long_lists(rows: DataFrame, done: DataFrame, percent: int, similar) -> DataFrame:
    """Lines (a, al) of long lists, those of `done` set aside, with an earlier similar line.

    First against the first line of each list, then what is left against all earlier lines.
    """
    hub = rows.groupBy("g").agg(F.min(F.struct("a", "al", "x", *MAPS)).alias("h")).select(
        "g", F.col("h.a").alias("b"), F.col("h.al").alias("bl"), F.col("h.x").alias("xb"), *[F.col(f"h.{b}").alias(f"c{b}") for b in MAPS])
    left = stored(rows.join(done, ["a", "al"], "left_anti").select("g", "a", "al", F.col("x").alias("xa"), *[F.col(b).alias(f"a{b}") for b in MAPS]), "left")
    right = rows.select("g", F.col("a").alias("b"), F.col("al").alias("bl"), F.col("x").alias("xb"), *[F.col(b).alias(f"c{b}") for b in MAPS])
    earlier = F.expr("(b < a or b = a and bl < al)") & _may_reach(percent)
    pairs = stored(left.join(hub, "g").where(earlier).select("a", "al", "b", "bl").distinct(), "pairs")
    near = similar(pairs)
    more = left.join(near, ["a", "al"], "left_anti").join(right, "g").where(earlier).select("a", "al", "b", "bl").distinct()
    return near.unionByName(similar(stored(more.join(pairs, ["a", "al", "b", "bl"], "left_anti"), "pairs")))


def repeated_lines(docs: DataFrame, percent: int = 80, least: int = 1) -> DataFrame:
    """(doc_id, line) of every line that is similar to an earlier one, in order of (doc_id, line).

    Lines end at line feeds; words are runs without ASCII white space, A-Z lower-cased. Two lines are
    similar when the Jaccard similarity of their distinct words is at least percent / 100. Lines with
    fewer than `least` distinct words are never compared; by default all lines with a word are. Null and
    empty texts and rows without doc_id have no such lines. Repeated rows of one doc_id count as one document. Lines are compared with all earlier
    ones, removed ones included, so the result doesn't depend on any order of work.
    """
    weight = docs.sparkSession.sparkContext.broadcast(frequent_words(docs))
    sig = stored(line_signatures(docs, percent, least, weight), "lines")
    first = sig.groupBy("key").agg(F.min(F.struct("doc_id", "line")).alias("f"), F.count("*").alias("c")).where("c > 1")
    copies = _small(sig.select("key", "doc_id", "line").join(_small(first, F.lit(64)), "key").where(
        "doc_id <> f.doc_id or line <> f.line").select("doc_id", "line").distinct(), F.lit(40))
    rows = sig.join(copies, ["doc_id", "line"], "left_anti").select(
        F.col("doc_id").alias("a"), F.col("line").alias("al"), "n", *MAPS, F.posexplode("rare").alias("p", "g"))
    rows = rows.select("g", "a", "al", F.shiftleft("n", 32).bitwiseOR(F.col("p").cast("long")).alias("x"), *MAPS)
    lists = stored(rows.repartition("g").sortWithinPartitions("g", "x").mapInArrow(
        _short_pairs(percent), ", ".join(f"{n} long" for n in LISTED)), "lists")
    similar = lambda pairs: _similar(docs, pairs, percent, least, weight)
    # of all pairs of a line, the one with most similar bit maps is compared first; it mostly decides
    short = lists.where("g is null")
    best = stored(short.groupBy("a", "al").agg(F.min(F.struct("x", "b", "bl")).alias("p")).select("a", "al", "p.b", "p.bl"), "pairs")
    near = similar(best)
    rest = short.join(near, ["a", "al"], "left_anti").select("a", "al", "b", "bl").distinct().join(best, ["a", "al", "b", "bl"], "left_anti")
    short = near.unionByName(similar(stored(rest, "pairs")))
    far = _long_lists(lists.where("g is not null"), short, percent, similar)
    done = short.unionByName(far).select(F.col("a").alias("doc_id"), F.col("al").alias("line"))
    return done.unionByName(copies)


def without_repeats(docs: DataFrame, percent: int = 80, least: int = 1) -> DataFrame:
    """`docs` with texts without repeated lines (null if the text is), and two columns behind `_l_`: n_lines, n_removed."""
    gone = _small(repeated_lines(docs, percent, least).groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("_l_gone")), F.size("_l_gone") * 8 + 40)

    def run(batches):
        for b in pieces(batches):
            n, cut, new = [], [], []
            for t, gone in zip(b.column("text").to_pylist(), b.column("_l_gone").to_pylist()):
                drop = set(gone or ())
                n.append(t.count("\n") + 1 if t else 0)
                cut.append(len(drop))
                new.append("\n".join([x for i, x in enumerate(t.split("\n")) if i not in drop]) if drop else t)
            cols = {c: b.column(c) for c in b.schema.names if c != "_l_gone"} | ({"text": pa.array(new, pa.string())} if any(cut) else {})
            yield pa.RecordBatch.from_pydict(cols | {"_l_n_lines": pa.array(n, pa.int64()), "_l_n_removed": pa.array(cut, pa.int64())})

    out = docs.join(gone, "doc_id", "left").select(*docs.columns, "_l_gone")
    schema = T.StructType([*docs.schema.fields, T.StructField("_l_n_lines", T.LongType()), T.StructField("_l_n_removed", T.LongType())])
    return out.mapInArrow(run, schema)


def line_report(docs: DataFrame, percent: int = 80, least: int = 1) -> DataFrame:
    """doc_id, n_lines, n_removed and the digest of the remaining text of every document."""
    return without_repeats(docs.select("doc_id", "text"), percent, least).select(
        "doc_id", F.col("_l_n_lines").alias("n_lines"), F.col("_l_n_removed").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def deduped(docs: DataFrame, percent: int = 80, least: int = 1) -> DataFrame:
    """`docs` without repeated lines; documents that had words and lost all of them go."""
    out = without_repeats(docs, percent, least).where("_l_n_removed = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return out.select(*docs.columns)
