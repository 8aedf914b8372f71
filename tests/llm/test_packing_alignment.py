"""Packing and tokenizer alignment against brute-force versions on small inputs."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from panelweave.llm import alignment, packing

WORDS = public_tokenizers.path("word_bpe_49k.json")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\n \t", "one", "A<|endoftext|>b <|endoftext|>. <|ENDOFTEXT|>!", "Don't STOP. I'll go on,now...ok?!", "Ünïcode Straße. ŒUVRE, naïve?",
       "İstanbul. İ ﬁ Å ǅ", "é café. á,", "漢字かな交じり文。テスト", "한국어 각", "12345 3.14, v2.0;", "tab\tsep\r\nline\x0bfeed\x1cx", "Σοφός ΟΔΟΣ.",
       "x" * 500, ("long " * 3000).strip(), "🙂🙃 ok", "  double  blanks  ", "▁under ▁", "<0x41> <s> </s> <unk>", "﻿bom", "a\x00b",
       "ŒUVRE Ÿ ŠŽ ſſ ŉ ß ĳ Ĳ ĸ Ŀ ŀ ªº µ ÅÅ Ǆ Ɓ", "Ünïcode. Ñandú, ǆ."]


@pytest.fixture(scope="module")
def sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    return [tuple(r) for r in docs.collect()]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"n": F.lit("x"), "part": F.lit(1), "rest": F.lit(None).cast("string"), "pair": F.lit(2), "ids": F.lit(0)})


def test_word_encoder_equals_the_library(sample):
    encoder = packing.WordEncoder(WORDS)
    texts = [t or "" for t in ODD] + [t or "" for _, t in sample]
    want = [np.array(e.ids, encoder.type).tobytes() for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == want
    assert [x for t in texts for x in encoder.encode([t])] == want


@pytest.mark.parametrize("seed", range(12))
def test_plan_fills_every_pack(seed):
    rnd = random.Random(seed)
    size = rnd.choice([16, 64, 100])
    h = {n: rnd.choice([1, 2, 5, 40]) for n in range(1, size) if rnd.random() < rnd.choice([0.05, 0.5, 1])}
    slots, packs = packing.plan_packs(h, size)
    plan, held, pieces = packing._Slots(slots), defaultdict(list), Counter()
    for n, c in h.items():
        for rank in range(c):
            found = list(plan.pieces(n, rank))
            assert [s for s, *_ in found] == [0, *np.cumsum([m for _, m, *_ in found])[:-1].tolist()] and sum(m for _, m, *_ in found) == n
            for s, m, q, o in found:
                held[q].append((o, m))
                pieces[q] += 1
    assert sorted(held) == list(range(packs))
    total = sum(n * c for n, c in h.items())
    fills = []
    for q, got in held.items():
        at = 0
        for o, m in sorted(got):
            assert o == at
            at += m
        fills.append(at)
    assert fills.count(size) >= total // size and all(f == size or f & (f - 1) == 0 for f in fills) and sum(fills) == total
    assert sum(pieces.values()) <= sum(h.values()) + packs  # at most one cut for each pack


def test_longest_first_into_the_emptiest():
    slots, packs = packing.plan_packs({6: 2, 5: 1, 3: 1, 2: 2}, 8)
    assert packs == 3
    # lengths 6, 6, 5 open a pack each, 3 completes the emptiest, 2 and 2 the others
    assert [tuple(s) for s in slots[:, [0, 4, 5, 6, 7]].tolist()] == [(6, 1, 2, 0, 0), (5, 1, 1, 2, 0), (3, 1, 1, 2, 5), (2, 1, 2, 0, 6)]


def check_pack(df, rows, size):
    library = packing.WordEncoder.of(WORDS).library
    want = Counter()
    for d, t in rows:
        want[d, tuple(library.encode(t or "", add_special_tokens=False).ids + [2])] += 1
    pieces, fill = df.collect(), defaultdict(list)
    by_doc = defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        fill[r.sequence_id].append((r.offset, r.length))
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for got in fill.values():
        at = 0
        for o, n in sorted(got):
            assert o == at
            at += n
        assert at == size or at & (at - 1) == 0
    got = Counter()
    if len({d for d, _ in rows}) == len(rows):
        for d, rs in by_doc.items():
            rs.sort(key=lambda r: r.start)
            ids = [i for r in rs for i in r.ids]
            assert [r.start for r in rs] == [0, *np.cumsum([r.length for r in rs])[:-1].tolist()] and {r.doc_tokens for r in rs} == {len(ids)}
            got[d, tuple(ids)] += 1
        assert got == want
    assert sum(r.length for r in pieces) == sum(len(k[1]) * c for k, c in want.items())


def test_pack(spark, sample):
    rows = [(-1 - i, t) for i, t in enumerate(ODD)] + sample
    check_pack(packing.pack(frame(spark, rows).repartition(5), WORDS, 2, 128), rows, 128)
    check_pack(packing.pack(frame(spark, sample), WORDS, 2, 4096), sample, 4096)
    check_pack(packing.pack(frame(spark, [(1, "a b c d e f g")]), WORDS, 2, 4), [(1, "a b c d e f g")], 4)


def test_pack_repeats_nulls_and_empty(spark):
    rows = [(None, "a b"), (None, "a b"), (7, "c"), (7, "c"), (7, None)] + [(i, "x") for i in range(300)]
    check_pack(packing.pack(frame(spark, rows).repartition(3), WORDS, 2, 16), rows, 16)
    assert packing.pack(frame(spark, []), WORDS, 2).count() == 0


# alignment

def brute_alignment(rows):
    both = alignment.Tokenizers.of(A, B)
    docs, count = [], Counter()
    for d, t in rows:
        a = both.a.encode(" " + (t or ""), add_special_tokens=False).ids
        b = both.b.encode(t or "")
        ok = t and b"".join(both.bytes_a[i] for i in a) == (" " + t).encode() == b"".join(both.bytes_b[i] for i in b)
        a, b = (a, b) if ok else ([], [])
        spans = []
        for ids, names in ((a, both.bytes_a), (b, both.bytes_b)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(names[i]), i))
                at += len(names[i])
            spans.append(out)
        pairs = [(x[2], y[2], i, j, min(x[1], y[1]) - max(x[0], y[0])) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1])
                 if x[0] < y[1] and y[0] < x[1]]
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = [[[i for s, e, i in side if lo <= s and e <= hi] for side in spans] for lo, hi in zip([0, *ends], ends)]
        docs.append((d, a, b, pairs, groups))
        count.update({p[:2] for p in pairs})
    most = Counter()
    for (a, _), c in count.items():
        most[a] = max(most[a], c)
    out = []
    for d, a, b, pairs, groups in docs:
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((d, len(a), len(b), len(groups), len(pairs), sum(count[p[:2]] == most[p[0]] for p in pairs), sum(count[p[:2]] for p in pairs),
                    hashlib.sha256(text.encode()).hexdigest() if a else "", sum(len(x) * len(y) for x, y in groups)))
    return Counter(out), docs


def test_memo_of_a_equals_the_library(sample):
    both = alignment.Tokenizers.of(A, B)
    texts = [t for t in ODD if t] + ["a b", "a  b", "a\nb c", "a \nb", "a\u00a0b c", " a", "a ", "x\u3000 y", "don't we'll x's 's", "é. É! ñ?", "e\u0301, a", "ａ. ｂ"] + [t or "" for _, t in sample]
    want = [np.array(e.ids, both.type).tobytes() for e in both.a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert both.encode_a(texts) == want and [both.encode_a([t])[0] for t in texts] == want


def test_alignment(spark, sample):
    rows = [(-1 - i, t) for i, t in enumerate(ODD) if len(t or "") < 2000] + sorted(sample, key=lambda r: len(r[1] or ""))[:90] + [(5, "twin"), (5, "twin"), (None, "none"), (None, None)]
    want, docs = brute_alignment(rows)
    df = frame(spark, rows).repartition(3)
    assert Counter(tuple(r) for r in alignment.report(df, A, B).collect()) == want
    assert Counter(tuple(r) for r in alignment.report(df, A, B, broadcast_pairs=0).collect()) == want
    assert any(n_a == 0 and d is not None and d < -3 for d, n_a, *_ in want)  # texts that do not come back
    found = Counter((r.doc_id, r.id_a, r.id_b, r.a, r.b, r.weight) for r in alignment.links(df, A, B).collect())
    assert found == Counter((d, *p) for d, _, _, pairs, _ in docs for p in pairs)
    shared = alignment.links(df, A, B, "group").groupBy("doc_id").count().collect()
    by_doc = Counter()
    for (d, *_, n), c in want.items():
        by_doc[d] += n * c
    assert {r.doc_id: r["count"] for r in shared} == {d: n for d, n in by_doc.items() if n}
    assert alignment.report(frame(spark, []), A, B).count() == 0


def test_long_text_and_small_blocks(spark, monkeypatch):
    rows = [(1, "Some words, again and again. " * 4000), (2, "a few words"), (3, "Some words")]
    want = sorted(tuple(r) for r in alignment.report(frame(spark, rows), A, B).collect())
    assert want[0][1] > 20_000 and want[0][4] >= want[0][1]
    monkeypatch.setattr(alignment, "PRODUCT", 7)
    assert alignment.links(frame(spark, rows[1:]), A, B, "group").count() == sum(r[-1] for r in want[1:])


def test_row_product_equals_dense():
    rnd = np.random.default_rng(3)
    x, y = (rnd.random(s) < 0.3 for s in ((7, 9), (9, 5)))

    def csr(m):
        return alignment.Csr(np.concatenate(([0], np.cumsum(m.sum(1)))), np.nonzero(m)[1], np.ones(int(m.sum()), np.int64), m.shape[1])

    p, dense = alignment.row_product(csr(x), csr(y)), x.astype(int) @ y.astype(int)
    got = np.zeros_like(dense)
    for i in range(7):
        got[i, p.indices[p.indptr[i] : p.indptr[i + 1]]] = p.values[p.indptr[i] : p.indptr[i + 1]]
    assert (got == dense).all()
    t = alignment.transposed(csr(x))
    assert [t.indices[t.indptr[j] : t.indptr[j + 1]].tolist() for j in range(9)] == [np.flatnonzero(x[:, j]).tolist() for j in range(9)]
