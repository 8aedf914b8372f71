"""Phrase collocations from a weighted de Bruijn graph of words.

Only the longest grams are counted: an edge of n words leads from the node of its first n - 1
words to that of its last n - 1, weighted by its occurrences. A piece that ends early is filled
up with an end mark, so what flows out of a node, ends included, is how often its words
occur, and the same sum over longer and longer tails gives all shorter counts. In the graph of frequent
edges, paths without a branch are compacted; the nodes inside them always lie in a longer phrase of equal count.

Words travel as codes: the most frequent ones by their rank, all others by a hash that is checked to
be unique. Codes only name words; ranks keep the shuffle small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from panelweave.llm.common import columns, mixed, stored

#: Words with a short code, and the longest such word in bytes: at most 8 MB, so the table may be broadcast.
RANKED, RANKED_WORD = 1 << 17, 64
#: Characters of text split at a time, and grams summed at a time.
BLOCK, GRAMS = 1 << 20, 1 << 20
#: Words that a task counts or names before it passes them on.
HELD_WORDS = 500_000
#: Grams in one part of their shuffle.
PART_GRAMS = 2_000_000

#: A-Z lower-cased, marks and line ends close a piece, a tab is a blank.
_FOLD = bytearray(range(256))
_FOLD[65:91] = range(97, 123)
for _c in b".,;:!?\x0b\x0c\x0d":
    _FOLD[_c] = 10
_FOLD[9] = 32
_FOLD = bytes(_FOLD)


def _split(texts: list[bytes]) -> list[bytes]:
    """Words of some texts in order; a line feed ends a piece, an empty item is nothing."""
    return (b"\n".join(texts).translate(_FOLD) + b"\n").replace(b"\n", b" \n ").split(b" ")


def _by_lang(batches):
    """(lang, texts of that language), a bounded number of bytes at a time."""
    for langs, texts in columns(batches, "lang", "text"):
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for lang, t in zip(langs, texts):
            held.setdefault(lang, []).append(t)
            size[lang] = size.get(lang, 0) + len(t)
            if size[lang] >= BLOCK:
                yield lang, held.pop(lang)
                del size[lang]
        yield from held.items()


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")) if "lang" in docs.columns else F.lit("und")
    return docs.select(lang.alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).where("octet_length(text) > 0")


def _hashed(lang: str, seed: int):
    """Code of a word of a language by hash: below zero, as ranks are above it."""
    start = xxhash.xxh3_64_intdigest(lang.encode(), seed)
    return lambda word: (xxhash.xxh3_64_intdigest(word, start) >> 1) - (1 << 63)


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """code (by hash), lang, word, n: occurrences of every word in each language."""
    def run(batches):
        place: dict[str, dict[bytes, int]] = {}
        total: dict[str, np.ndarray] = {}

        def out(lang):
            code = _hashed(lang, seed)
            words, n = list(place.pop(lang)), total.pop(lang)
            for a in range(0, len(words), 1 << 16):
                some = words[a : a + (1 << 16)]
                yield pa.RecordBatch.from_pydict({"code": pa.array([code(w) for w in some], pa.int64()), "lang": [lang] * len(some),
                                                  "word": pa.array(some, pa.binary()), "n": n[a : a + len(some)]})

        for lang, texts in _by_lang(batches):
            known = place.setdefault(lang, {})
            words = _split(texts)
            for w in set(words) - known.keys() - {b"", b"\n"}:
                known[w] = len(known)
            k = len(known)
            at = np.fromiter((known.get(w, k) for w in words), np.int64, len(words))
            n = np.bincount(at, minlength=k + 1)[:k]
            old = total.get(lang, np.zeros(0, np.int64))
            n[: len(old)] += old
            total[lang] = n
            if k > HELD_WORDS:
                yield from out(lang)
        for lang in list(place):
            yield from out(lang)

    rows = _texts(docs).mapInArrow(run, "code long, lang string, word binary, n long")
    return rows.groupBy("code", "lang", "word").agg(F.sum("n").alias("n"))


class _Codes(dict):
    """word -> code in one language; a bounded memo before the hash."""

    def __init__(self, lang: str, ranked: dict[bytes, int], seed: int):
        super().__init__(ranked)
        self.ranked, self.hash = ranked, _hashed(lang, seed)
        self[b"\n"] = self[b""] = 0  # told apart by the caller

    def __missing__(self, word: bytes) -> int:
        code = self.hash(word)
        if len(word) <= RANKED_WORD:
            self[word] = code
        return code

    def bounded(self) -> "_Codes":
        if len(self) > len(self.ranked) + HELD_WORDS:
            self.clear()
            self.update(self.ranked)
            self[b"\n"] = self[b""] = 0
        return self


def _summed(keys: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows added up, in order of a mixed key; rows that only share the mixed key stay apart."""
    h = np.zeros(len(n), np.uint64)
    with np.errstate(over="ignore"):
        for k in keys:
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + k.view(np.uint64))
    order = np.argsort(h)
    keys, n = [k[order] for k in keys], n[order]
    new = np.zeros(len(n), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return [k[first] for k in keys], np.add.reduceat(n, first) if len(first) else n


def gram_counts(docs: DataFrame, longest: int, ranked: dict[str, dict[bytes, int]], seed: int) -> DataFrame:
    """w1 .. w<longest>, n: partial counts of the edges; 0 fills up behind the end of a piece."""
    shared = docs.sparkSession.sparkContext.broadcast(ranked)
    names = [f"w{j + 1}" for j in range(longest)]

    def run(batches):
        codes: dict[str, _Codes] = {}
        held: list[list[np.ndarray]] = []
        size = 0

        def out():
            keys = [np.concatenate(x) for x in zip(*held)]
            keys, n = _summed(keys, np.ones(len(keys[0]), np.int64))
            for a in range(0, len(n), 1 << 16):
                yield pa.RecordBatch.from_pydict({c: pa.array(k[a : a + (1 << 16)]) for c, k in zip([*names, "n"], [*keys, n])})

        for lang, texts in _by_lang(batches):
            if lang not in codes:
                codes[lang] = _Codes(lang, shared.value.get(lang, {}), seed)
            words = _split(texts)
            c = np.fromiter(map(codes[lang].bounded().__getitem__, words), np.int64, len(words))
            c = c[np.fromiter(map(len, words), np.int64, len(words)) > 0]  # nothing between two blanks
            c = np.concatenate((c, np.zeros(longest, np.int64)))
            at = np.flatnonzero(c[: len(c) - longest])
            gram, inside = [c[at]], np.ones(len(at), bool)
            for j in range(1, longest):
                inside = inside & (c[at + j] != 0)
                gram.append(np.where(inside, c[at + j], 0))
            held.append(gram)
            size += len(at)
            if size >= GRAMS:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()

    return _texts(docs).mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "n"]))


class _Runs:
    """Sums of equal neighbours in a sorted stream; the last one stays open until more rows or the end are seen."""

    def __init__(self):
        self.open: tuple | None = None

    def add(self, keys: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        if not len(n):
            return keys, n
        if self.open:
            keys, n = [np.concatenate(x) for x in zip(self.open[0], keys)], np.concatenate((self.open[1], n))
        new = np.zeros(len(n), bool)
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        first = np.flatnonzero(new)
        keys, n = [k[first] for k in keys], np.add.reduceat(n, first)
        self.open = [k[-1:] for k in keys], n[-1:]
        return [k[:-1] for k in keys], n[:-1]

    def close(self) -> tuple | None:
        done, self.open = self.open, None
        return done


def _flows(longest: int, least: int, hot: int):
    """Edges sorted by their words -> k, words, n of the phrases of k words.

    Complete for k = longest. Shorter phrases are what flows out of their node: complete where the node lies in one part,
    and then only from `least` on; partial sums where it is spread, because its two first words are frequent. Of single
    words all partial sums are passed on.
    """
    names = [f"w{j + 1}" for j in range(longest)]

    def batch(keys: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
        cols = {c: keys[j] if j < len(keys) else np.zeros(len(n), np.int64) for j, c in enumerate(names)}
        return pa.RecordBatch.from_pydict({"k": np.full(len(n), len(keys), np.int32)} | cols | {"n": n})

    def run(batches):
        runs = {k: _Runs() for k in range(2, longest + 1)}
        single: list[tuple] = []

        def words():
            return _summed([np.concatenate([s[0] for s in single])], np.concatenate([s[1] for s in single]))

        def feed(k, keys, n):
            if k == 1:
                single.append((keys[0], n))
                if sum(len(s[1]) for s in single) > GRAMS:
                    keys, n = words()
                    single[:] = [(keys[0], n)]
                    if len(n) > GRAMS // 2:
                        yield batch(keys, n)
                        single.clear()
            elif len(n):
                yield from passed(k, *runs[k].add(keys, n))

        def passed(k, keys, n):
            """Finished sums of k words: rows of their own, and what flows into k - 1 words."""
            keep = n >= least
            if k < longest:
                keep |= (keys[0] > 0) & (keys[0] <= hot) & (keys[1] > 0) & (keys[1] <= hot)
            keep &= keys[-1] != 0  # the end mark is no word
            if keep.any():
                yield batch([x[keep] for x in keys], n[keep])
            yield from feed(k - 1, keys[:-1], n)

        for b in batches:
            yield from feed(longest, [b.column(c).to_numpy() for c in names], b.column("n").to_numpy())
        for k in range(longest, 1, -1):
            if done := runs[k].close():
                yield from passed(k, *done)
        if single:
            yield batch(*words())

    return run


def _most_frequent(words: DataFrame) -> list:
    """At most RANKED words, most frequent first: those above the least bin of counts whose words are still few enough."""
    short = words.where(f"octet_length(word) <= {RANKED_WORD}").withColumn("bin", F.floor(F.log2("n") * 16))
    least, held = None, 0
    for r in sorted(short.groupBy("bin").count().collect(), key=lambda r: -r["bin"]):  # some hundred bins
        held += r["count"]
        if held > RANKED:
            break
        least = r["bin"]
    if least is None:
        return []
    rows = short.where(F.col("bin") >= least).select("lang", "word", "n").collect()
    return sorted(rows, key=lambda r: (-r["n"], r["lang"], bytes(r["word"])))


def phrase_counts(docs: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(k, w1 .. w<longest>, n of every phrase that occurs `least` times, by codes; code, lang, word, n of every word)."""
    for seed in range(100):
        words = stored(word_counts(docs, seed), "words")
        if words.groupBy("code").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("no hash tells all words apart")
    spark = docs.sparkSession
    total = words.agg(F.sum("n")).first()[0] or 0
    ranked: dict[str, dict[bytes, int]] = {}
    top = _most_frequent(words)
    for i, r in enumerate(top):
        ranked.setdefault(r["lang"], {})[bytes(r["word"])] = i + 1
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_GRAMS))
    hot = sum(r["n"] * 4 * parts >= total for r in top)  # a node of rarer words has less than a quarter of a part's rows
    names = [f"w{j + 1}" for j in range(longest)]
    grams = gram_counts(docs, longest, ranked, seed)
    spread = F.xxhash64(*names[2:]) if longest > 2 else F.lit(0)
    spread = F.when(F.col("w1").between(1, hot) & F.col("w2").between(1, hot), spread).otherwise(0)
    edges = grams.withColumn("spread", spread).repartition(parts, "w1", "w2", "spread").sortWithinPartitions(*names)
    flows = edges.drop("spread").mapInArrow(_flows(longest, least, hot), ", ".join(["k int", *(f"{c} long" for c in names), "n long"]))
    counts = stored(flows, "flows").groupBy("k", *names).agg(F.sum("n").alias("n")).where(f"n >= {least}")
    codes = spark.createDataFrame([(r["lang"], bytearray(r["word"]), i + 1) for i, r in enumerate(top)], "lang string, word binary, rank long")
    words = words.join(F.broadcast(codes), ["lang", "word"], "left").select(F.coalesce("rank", "code").alias("code"), "lang", "word", "n")
    return stored(counts, "phrases"), words


def compacted(edges: DataFrame, nodes: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
    """Compact the unary paths of the graph: (edges with path, place and path_words; nodes inside a path).

    `edges` have the words w1 .. w<longest> and n, `nodes` one word less. A node is inside a path if all of
    its occurrences come along one edge and go on along one edge. Paths are found by pointer doubling: after r rounds
    each edge knows the edge up to 2^r places before it. A path can't close on itself, since pieces end.
    """
    names = [f"w{j + 1}" for j in range(longest)]
    node = lambda a, f: nodes.select(*[F.col(names[j]).alias(names[j + a]) for j in range(longest - 1)], F.col("n").alias(f))
    # ids come from a written table, so that they stay as they are
    rows = stored(edges.join(node(0, "out"), names[:-1]).join(node(1, "in"), names[1:]).withColumn("id", F.monotonically_increasing_id()), "edges")
    before = rows.where("n = `in`").select(*[F.col(names[j + 1]).alias(names[j]) for j in range(longest - 1)], F.col("id").alias("before"))
    links = stored(rows.join(before, names[:-1], "left").select(
        "id", F.when(F.col("n") == F.col("out"), F.col("before")).alias("p")).select(
        "id", F.coalesce("p", "id").alias("p"), F.col("p").isNotNull().cast("long").alias("place")), "links")
    while not links.where("p <> id").isEmpty():
        on = links.select(F.col("id").alias("p"), F.col("p").alias("p2"), F.col("place").alias("more"))
        nxt = stored(links.join(on, "p").select("id", F.col("p2").alias("p"), (F.col("place") + F.col("more")).alias("place"),
                                                (F.col("p") != F.col("p2")).alias("moved")), "links")
        links = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            break
    size = links.groupBy("p").agg((F.max("place") + longest).alias("path_words"))
    placed = stored(rows.join(links.join(size, "p"), "id").select(*names, "n", F.col("p").alias("path"), "place", "path_words"), "paths")
    return placed, placed.where("place > 0").select(*names[:-1])


def paths(placed: DataFrame, longest: int) -> DataFrame:
    """path, words (codes), n: each compacted path as one row. A path is never longer than the piece it lies in."""
    names = [f"w{j + 1}" for j in range(longest)]
    rows = placed.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("place", *names))).alias("e"), F.first("n").alias("n"))
    return rows.select("path", F.concat(F.array(*[F.col(f"e.{c}")[0] for c in names[:-1]]), F.col(f"e.{names[-1]}")).alias("words"), "n")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, cover: int = 50, top: int = 2000) -> DataFrame:
    """The `top` phrases of 2 to `longest` words of each language by cohesion.

    Texts are cut into pieces at `.,;:!?` and line ends, pieces into words at blanks and tabs; A-Z is lower-cased.
    A phrase that occurs a >= `least` times within pieces scores min over its cuts of 1000000 * a * a // (l * r), where l and
    r count the two sides; ties take the first cut. It is dropped if its words lie in a longer
    one that occurs at least `cover` percent as often. Returns lang, rank (from 1), phrase, a, l, r, n (words of the
    language), score, and path_words (words of the unbranched path that a phrase of `longest` words lies on, else
    null), ordered by score and a descending, phrase ascending. Exact for counts up to 10^15.

    Null and empty texts hold nothing; a null lang is `und`; every row counts, repeated ones too; texts of any
    length are read whole; other columns are ignored; an empty table gives an empty result.
    """
    counts, words = phrase_counts(docs, longest, least)
    names = [f"w{j + 1}" for j in range(longest)]
    of = {k: counts.where(f"k = {k}").select(*names[:k], "n") for k in range(1, longest + 1)}
    placed, inside = compacted(of[longest], of[longest - 1], longest) if longest > 2 else (of[longest].withColumn("path_words", F.lit(None).cast("long")), None)
    shown = stored(of[1].withColumnRenamed("w1", "code").join(words.select("code", "lang", "word"), "code"), "shown")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    found = []
    for k in range(2, longest + 1):
        part = placed.select(*names, "n", "path_words") if k == longest else of[k].withColumn("path_words", F.lit(None).cast("long"))
        if k == longest - 1 and inside is not None:
            part = part.join(inside, names[:k], "left_anti")  # a longer phrase occurs as often
        for m in range(k + 1, longest + 1):
            covers = of[m].select(F.explode(F.array(*[F.struct(*[F.col(names[s + j]).alias(names[j]) for j in range(k)], F.col("n").alias("over"))
                                                      for s in range(m - k + 1)])).alias("x")).select("x.*").groupBy(*names[:k]).agg(F.max("over").alias("over"))
            part = part.join(covers, names[:k], "left").where(f"over is null or {_exact_text(100, 'over')} < {_exact_text(cover, 'n')}").drop("over")
        for cut in range(1, k):
            left = of[cut].withColumnRenamed("n", f"l{cut}")
            right = of[k - cut].select(*[F.col(names[j]).alias(names[j + cut]) for j in range(k - cut)], F.col("n").alias(f"r{cut}"))
            part = part.join(left, names[:cut]).join(right, names[cut:k])
            score = F.expr(f"(cast(1000000 as decimal(7,0)) * cast(n as decimal(15,0)) * cast(n as decimal(15,0))) div (cast(l{cut} as decimal(19,0)) * cast(r{cut} as decimal(19,0)))")
            part = part.withColumn(f"c{cut}", F.struct(score.alias("score"), F.lit(cut).alias("cut"), F.col(f"l{cut}").alias("l"), F.col(f"r{cut}").alias("r")))
        part = part.withColumn("c", F.least(*[f"c{j}" for j in range(1, k)]) if k > 2 else F.col("c1"))
        for j in range(k):
            cols = [F.col("code").alias(names[j]), F.col("word").alias(f"t{j + 1}")] + ([F.col("lang")] if j == 0 else [])
            part = part.join(shown.select(*cols), names[j])
        phrase = F.concat_ws(" ", *[F.col(f"t{j + 1}").cast("string") for j in range(k)])
        found.append(part.select("lang", phrase.alias("phrase"), F.col("n").alias("a"), "c.l", "c.r", "c.score", "path_words"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = every.withColumn("rank", F.row_number().over(order).cast("long")).where(f"rank <= {top}")
    return best.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score", "path_words")


def _exact_text(factor: int, column: str) -> str:
    return f"cast({column} as decimal(19,0)) * {factor}"


#: The query with its contract's parameters; every count is made directly.
ORACLE = r"""
WITH pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
f AS (
  SELECT lang, k, g, count(*) AS a
  FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g
        FROM pieces, (VALUES (1), (2), (3)) AS v(k)) GROUP BY ALL),
cuts AS (
  SELECT c.lang, c.k, c.g, c.a, cut, l.a AS l, r.a AS r,
         1000000 * CAST(c.a AS HUGEINT) * c.a // (CAST(l.a AS HUGEINT) * r.a) AS score
  FROM f AS c, (VALUES (1), (2)) AS v(cut), f AS l, f AS r
  WHERE c.k > cut AND c.a >= 10 AND l.lang = c.lang AND l.g = c.g[1:cut] AND r.lang = c.lang AND r.g = c.g[cut + 1:c.k]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
inner_ AS (
  SELECT lang, p AS g, max(a) AS longer
  FROM (SELECT lang, a, unnest([g[1:2], g[2:3]]) AS p FROM f WHERE k = 3 AND a >= 10) GROUP BY ALL),
ranked AS (
  SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, b.l, b.r, b.score
  FROM best AS b LEFT JOIN inner_ AS i ON i.lang = b.lang AND i.g = b.g
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
numbered AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ranked)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM numbered JOIN n USING (lang) WHERE rank <= 2000
"""
