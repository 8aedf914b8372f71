"""Operators with a fixed contract against brute-force versions on small inputs."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from panelweave.llm import bpe, decontaminate, lines, quality, similarity, suffix_dedup
from panelweave.llm.common import pieces

WORD = r"[^\x20\x09-\x0D]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(WORD, lower(text))


def frame(spark, rows):
    """doc_id and text next to extra columns whose names operators also use."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"g": F.lit("x"), "line": F.lit(1), "part": F.lit(None).cast("string"), "n": F.lit("n")})


def got(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


EDGES = [(0, None), (1, ""), (2, " \n\t\n"), (3, "one")]


@pytest.fixture(scope="module")
def sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    return [tuple(r) for r in docs.collect()]


# suffix dedup

def brute_suffixes(rows, length):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, d), d)
    out = set()
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone) if not y)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.add((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(spark, sample):
    rnd = random.Random(2)
    base = ["".join(rnd.choices("ab é漢", k=200)) for _ in range(5)] + ["a" * 300, "ab" * 200, "x" * 49, "x" * 50, "x" * 51]
    rows = EDGES + [(-5, "x" * 50), (50, "q" * 60), (51, "q" * 60), (51, "k" * 70)]
    for i in range(60):
        b = rnd.choice(base)
        a = rnd.randrange(len(b))
        rows.append((100 + i, b[a : a + rnd.randint(1, 200)] + rnd.choice(["", "a"]) + rnd.choice(base)))
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got(suffix_dedup.remove_repeats(frame(spark, rows), 50), *cols) == brute_suffixes(rows, 50)
    assert got(suffix_dedup.remove_repeats(frame(spark, sample), 50, False), *cols) == brute_suffixes(sample, 50)


def test_suffix_dedup_empty(spark):
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


# quality rules

def brute_quality(rows, trusted, buckets):
    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def features(w):
        for i, x in enumerate(w):
            h = xxhash.xxh64_intdigest(x.encode(), seed=42)
            yield signed(h) % buckets
            yield signed(xxhash.xxh64_intdigest(w[i + 1].encode(), seed=h) if i + 1 < len(w) else h) % buckets

    raw, target = [0] * buckets, [0] * buckets
    split = [(d, t or "", re.findall(WORD, t or "")) for d, t in rows]
    for d, _, w in split:
        for f in features(w):
            raw[f] += 1
            target[f] += d in trusted
    r, t = sum(raw) + buckets, sum(target) + buckets
    ratio = [round(1e6 * (math.log((y + 1) / t) - math.log((x + 1) / r))) for x, y in zip(raw, target)]
    for d, text, w in split:
        at = {}
        for j in range(len(w) - 2):
            at.setdefault(tuple(w[j : j + 3]), []).append(j)
        repeat = {p + k for v in at.values() if len(v) > 1 for p in v for k in range(3)}
        ls = [x for x in text.split("\n") if re.search(WORD, x)]
        failed = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
        total = sum(ratio[f] for f in features(w))
        yield (d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(ls) - len(set(ls)), len(repeat),
               failed, not failed and total >= len(w) * -250000)


def test_quality(spark, sample):
    rnd = random.Random(5)
    rows = EDGES + [(4, "a b c a b c\nx"), (5, "a a a a a a"), (6, "\x1c b\xa0c d　e"), (7, "a b\n\na b\n a b")]
    rows += [(10 + i, " ".join(rnd.choices(["the", "of", "é", "##x", "a|b"], k=rnd.randint(1, 120)))) for i in range(30)]
    rows += [(1000 + d, t) for d, t in sample[:60]]
    trusted = spark.createDataFrame([(i,) for i in range(10, 25)] + [(10,), (None,)], "doc_id long")
    found = quality.report(frame(spark, rows), trusted, buckets=1024)
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert got(found, *cols) == set(brute_quality(rows, set(range(10, 25)), 1024))


def test_quality_keeps_columns(spark):
    df = frame(spark, EDGES + [(4, " ".join(map(str, range(60))))])
    kept = quality.passing(df, df.where("doc_id = 4"))
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [4]
    assert quality.report(frame(spark, []), df).count() == 0


# n-gram Jaccard join

def brute_components(rows, k, percent):
    sets = {}
    for d, t in rows:
        w = words(t)
        m = min(k, len(w))
        sets[d] = {tuple(w[j : j + m]) for j in range(len(w) - m + 1)} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = {}
    for d, s in sets.items():
        for g in s:
            lists.setdefault(g, []).append(d)
    for d, s in sets.items():
        for e, o in Counter(e for g in s for e in lists[g] if e < d).items():
            if 100 * o >= percent * (len(s) + len(sets[e]) - o):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
    return {(d, len(s), root(d)) for d, s in sets.items()}


def near_copies(seed):
    rnd = random.Random(seed)
    rows = list(EDGES)
    for _ in range(25):
        base = rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(1, 60))
        for _ in range(rnd.randint(1, 12)):
            w = list(base)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = rnd.choice("abcXYZ")
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("k, percent", [(4, 85), (2, 80)])
def test_jaccard_components(spark, sample, k, percent):
    rows = near_copies(k) + [(1000 + d, t) for d, t in sample]
    found = similarity.jaccard_components(frame(spark, rows), k, percent)
    assert got(found, "doc_id", "n_shingles", "component_id") == brute_components(rows, k, percent)


def test_jaccard_edges(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "A B c d e f"), (None, "a b c d e f"), (9, "")]
    found = got(similarity.jaccard_components(frame(spark, rows), 4, 85), "doc_id", "component_id")
    assert found == {(5, 3), (3, 3), (None, None), (9, 9)}
    assert similarity.jaccard_components(frame(spark, [])).count() == 0
    df = frame(spark, rows)
    kept = similarity.one_per_component(df, 4, 85)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "9", "None"]


# line dedup

def brute_lines(rows, percent, least):
    seen, lists, out = [], {}, set()
    for d, t in sorted(rows):
        split = t.split("\n") if t else []
        gone = set()
        for i, x in enumerate(split):
            s = frozenset(words(x))
            if len(s) >= least:
                met = Counter(j for w in s for j in lists.get(w, ()))
                if any(100 * o >= percent * (len(s) + len(seen[j]) - o) for j, o in met.items()):
                    gone.add(i)
                for w in s:
                    lists.setdefault(w, []).append(len(seen))
                seen.append(s)
        kept = "\n".join(x for i, x in enumerate(split) if i not in gone)
        out.add((d, len(split), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("longest", [256, 3])
def test_lines(spark, sample, monkeypatch, longest):
    monkeypatch.setattr(lines, "SHORT_LIST", longest)
    rnd = random.Random(longest)
    rows = list(EDGES)
    for i in range(40):
        rows.append((10 + i, "\n".join(" ".join(rnd.choices("abcdefghijKLMN", k=rnd.randint(1, 12))) for _ in range(rnd.randint(1, 8)))))
    rows += [(1000 + d, t) for d, t in sample]
    found = lines.line_report(frame(spark, rows), 80, 4)
    assert got(found, "doc_id", "n_lines", "n_removed", "kept_sha256") == brute_lines(rows, 80, 4)


def test_lines_keep_columns_and_drop_emptied(spark):
    df = frame(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, ""), (5, "a b c d e f\nnew"), (None, "a b c d e f"), (9, "u v w x y z"), (9, "u v w x y z")])
    kept = lines.deduped(df)
    assert kept.columns == df.columns
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(1, "a b c d e f"), (3, None), (4, ""), (5, "new"), (None, "a b c d e f"), (9, "u v w x y z")}
    assert lines.line_report(frame(spark, [])).count() == 0


def test_short_lines(spark, sample):
    rows = [*EDGES, (4, "All rights reserved.\none\n漢字漢字\na b c d\ne f g h i"), (5, "reserved. all RIGHTS\nall rights\n漢字漢字\na b c d e\ne f g h\nx x x x x x"),
            (6, "X\na b c\na b d\na b\n\n \none one"), (7, "p q r s\np q r t\nx"), (8, "c b a a a a a a")] + [(1000 + d, t) for d, t in sample]
    found = lines.line_report(frame(spark, rows))
    assert got(found, "doc_id", "n_lines", "n_removed", "kept_sha256") == brute_lines(rows, 80, 1)
    kept = {r.doc_id: r.text for r in lines.deduped(frame(spark, rows[:9])).collect()}
    assert kept[5] == "all rights\nx x x x x x" and 8 not in kept


def test_long_unlike_lines_seldom_become_pairs():
    """Lines of 200 words of which half are common to all: no two are similar, save the planted ones with words twice and a further one."""
    rows = [" ".join(f"w{w}" if w < 100 else f"x{i}.{w}" for w in range(200)) for i in range(240)]
    rows += [f"{rows[i]} {rows[i][:200]} z" for i in range(10)]
    none = (np.zeros(1 << lines.SLOT_BITS, np.uint64), np.zeros(1 << lines.SLOT_BITS, np.uint8))
    sets = list(lines._line_sets("\n".join(rows).encode(), none, 1))
    listed = {"g": [0] * len(sets), "a": [0] * len(sets), "al": [i for i, _, _ in sets], "x": [len(s) << 32 for _, s, _ in sets]}
    listed |= {f"b{k + 1}": [m[k] for _, _, m in sets] for k in range(len(sets[0][2]))}
    found = list(lines._short_pairs(80)([pa.RecordBatch.from_pydict({n: pa.array(v, pa.int64()) for n, v in listed.items()})]))
    pairs = {(a, b) for r in found for a, b in zip(r.column("al").to_pylist(), r.column("bl").to_pylist())}
    assert {(240 + i, i) for i in range(10)} <= pairs
    assert len(pairs) < 100  # of 31,125


def listed(rows, step):
    """Prefix lists, sorted as `_short_pairs` takes them, in batches of `step` rows."""
    rows = sorted(rows, key=lambda r: (r[0], r[3]))
    for at in range(0, len(rows), step):
        cols = zip(*rows[at : at + step])
        yield pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in zip(lines.LISTED, cols)})


def split_lists(found):
    """Pairs (a, al, b, bl) and names of the lists whose rows are handed on."""
    rows = [r for b in found for r in b.to_pylist()]
    return [(r["a"], r["al"], r["b"], r["bl"]) for r in rows if r["g"] is None], {r["g"] for r in rows if r["g"] is not None}


@pytest.mark.parametrize("step", [7, 10_000])
def test_lists_are_paired_as_by_brute_force(monkeypatch, step):
    monkeypatch.setattr(lines, "GATHERED", 2 * step)
    monkeypatch.setattr(lines, "PAIRED", 50)
    rnd = random.Random(step)
    rows = []
    for g in range(60):
        for _ in range(rnd.randint(1, 30)):
            n = rnd.randint(4, 40)
            rows.append((g, rnd.randint(0, 9), rnd.randint(0, 9), n << 32 | rnd.randint(0, n // 5), rnd.getrandbits(4), rnd.getrandbits(3)))
    want = set()
    for r in rows:
        for q in rows:
            (n, p), (m, o) = divmod(r[3], 1 << 32), divmod(q[3], 1 << 32)
            need = -(-80 * (n + m) // 180)
            if r[0] == q[0] and r[1:3] > q[1:3] and 100 * min(n, m) >= 80 * max(n, m) and min(n - p, m - o) >= need:
                if (r[4] ^ q[4]).bit_count() + (r[5] ^ q[5]).bit_count() <= n + m - 2 * need:
                    want.add((*r[1:3], *q[1:3]))
    pairs, handed_on = split_lists(lines._short_pairs(80)(listed(rows, step)))
    assert set(pairs) == want and not handed_on and want


def test_only_lists_of_many_pairs_are_handed_on():
    """A list of 3,000 unlike lines is settled where it is sorted; one of 300 near copies is not written as 44,850 pairs."""
    rnd = random.Random(5)
    rows = [(1, i, 0, 50 << 32, rnd.getrandbits(62), rnd.getrandbits(62)) for i in range(3000)]
    rows += [(2, i, 0, 50 << 32, 1, 1) for i in range(300)] + [(3, i, 0, 50 << 32, 1, 1) for i in range(2)]
    pairs, handed_on = split_lists(lines._short_pairs(80)(listed(rows, 1000)))
    assert handed_on == {2} and (1, 0, 0, 0) in pairs and len(pairs) < 100


def test_pieces_hold_few_bytes_and_every_row():
    texts = [b"x" * k for k in [0, 3, 4, 50, 1, 1, 1, 0, 9]] + [None]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(10)), "text": pa.array(texts, pa.binary())})
    found = [b.column("doc_id").to_pylist() for b in pieces([batch, batch.slice(0, 0)], 10)]
    assert found == [[0, 1, 2], [3], [4, 5, 6, 7], [8, 9]]


def test_word_hashes_tell_words_apart():
    rnd = random.Random(6)
    words = [bytes(rnd.choices(b"aAb\x00\xc3\xa9.", k=k)) for k in [*range(1, 140), 300] for _ in range(6)]
    text = b"".join(w + bytes(rnd.choices(b" \t\n\v\f\r", k=rnd.randint(1, 3))) for w in words)
    hashes, start = lines._word_hashes(text)
    low = [w.translate(lines.LOWER) for w in words]
    assert [text[s : s + len(w)] for s, w in zip(start, words)] == words and len(start) == len(words)
    assert len(set(zip(low, hashes.tolist()))) == len(set(low)) == len(set(hashes.tolist()))
    assert all(len(lines._word_hashes(t)[0]) == 0 for t in (b"", b" ", b"\n \n"))


# decontamination

def test_automaton():
    rnd = random.Random(3)
    for _ in range(1500):
        letters = [b"a", b"b", b"c", b"d"][: rnd.randint(1, 4)]
        k = rnd.randint(1, 5)
        items = [(str(i), rnd.choices(letters, k=rnd.randint(1, 9))) for i in range(rnd.randint(0, 6))]
        text = rnd.choices([*letters, b"x"], [4] * len(letters) + [1], k=rnd.randint(0, 25))
        spans, found = decontaminate.SuffixAutomaton(items, k).spans(text)
        hit, want, names = [0] * len(text), [0] * len(text), set()
        for a, b in spans:
            hit[a:b] = [1] * (b - a)
        for name, w in items:
            m = min(k, len(w))
            for s in range(len(w) - m + 1):
                for p in range(len(text) - m + 1):
                    if text[p : p + m] == w[s : s + m]:
                        names.add(name)
                        want[p : p + m] = [1] * m
        assert (hit, found) == (want, names)


def test_leaks(spark):
    item = " ".join(f"w{i}" for i in range(14))
    bench = spark.createDataFrame([(1, item), (2, "Short, one!"), (10, None), (11, ""), (12, item)], "item_id long, text string")
    rows = [*EDGES[:3], (4, "x W3-w4 w5 w6 w7 w8 w9 w10 w11 w12 y"), (5, "a short ONE b"), (6, "w1 w2 w3 w4 w5 w6 w7 w8 w9 zz")]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {(0, 0, 0, 0, digest(""), False), (1, 0, 0, 0, digest(""), False), (2, 0, 0, 0, digest(""), False),
            (4, 12, 10, 2, digest("1,12"), True), (5, 4, 2, 1, digest("2"), True), (6, 10, 0, 0, digest(""), False)}
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got(decontaminate.leak_report(frame(spark, rows), bench), *cols) == want
    several = decontaminate.find_leaks(frame(spark, rows), bench, block_words=5)
    one = decontaminate.find_leaks(frame(spark, rows), bench)
    as_text = [F.col(c).cast("string") for c in ("doc_id", "n_words", "starts", "ends", "items")]
    assert got(several, *as_text) == got(one, *as_text)
    for size in (5, 1000):
        df = frame(spark, rows)
        clean = decontaminate.clean(df, bench, block_words=size)
        texts = {r.doc_id: r.text for r in clean.collect()}
        assert clean.columns == df.columns and texts == {0: None, 1: "", 2: " \n\t\n", 5: "a  b", 6: rows[5][1]}
    assert not decontaminate.leak_report(frame(spark, rows), bench.limit(0)).where("contaminated").count()


def test_leaks_of_rows_with_the_same_or_no_id(spark):
    item = " ".join(f"w{i}" for i in range(14))
    bench = spark.createDataFrame([(1, item), (2, "Short, one!"), (12, "v " + item)], "item_id long, text string")
    rows = [(None, "a short one b c d"), (None, "p q r"), (None, "x " + item), (None, None), (4, "s t u v short one"), (4, "short one a b c"), (4, "short one a b c")]
    as_text = [F.col(c).cast("string") for c in ("doc_id", "n_words", "starts", "ends", "items")]
    several, one = (sorted(map(str, decontaminate.find_leaks(frame(spark, rows), bench, block_words=n).select(*as_text).collect())) for n in (5, 1000))
    assert several == one and len(one) == len(rows)
    for size in (5, 1000):
        kept = sorted(map(str, ((r.doc_id, r.text) for r in decontaminate.clean(frame(spark, rows), bench, block_words=size).collect())))
        assert kept == sorted(map(str, [(None, "a  b c d"), (None, "p q r"), (None, None), (4, "s t u v "), (4, " a b c"), (4, " a b c")]))


# byte-level BPE

def test_bpe_equals_tiktoken(spark, sample):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    rows = [*EDGES, (4, "abc" * 5000), (5, "<|endoftext|> it's 12　漢字 \U0001F600  \n\n x"), (5, "twice"), (None, "no id")] + [(100 + d, t) for d, t in sample]
    found = bpe.encode_decode(frame(spark, rows), path, public_tokenizers.PATTERN)
    digest = hashlib.sha256
    want = set()
    for d, t in rows:
        ids = encode(t or "")
        want.add((d, len(ids), digest(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), digest((t or "").encode()).hexdigest()))
    assert got(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert bpe.encode_decode(frame(spark, []), path, public_tokenizers.PATTERN).count() == 0
    vocab = bpe.load_vocabulary(path)
    assert all(vocab.find(k) == r for k, r in ranks.items()) and vocab.find(b"not a token at all") is None
