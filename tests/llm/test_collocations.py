"""Collocations against direct counts."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelweave.llm import collocations as C


def brute(rows, longest=3, least=10, cover=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, w[i : i + k]) for i in range(len(w) - k + 1))
    out, candidates = {}, [(lang, g) for (lang, g), a in f.items() if len(g) > 1 and a >= least]
    inside = Counter()
    for lang, g in candidates:
        for k in range(2, len(g)):
            for i in range(len(g) - k + 1):
                inside[lang, g[i : i + k]] = max(inside[lang, g[i : i + k]], f[lang, g])
    for lang, g in candidates:
        a = f[lang, g]
        if (lang, g) in inside and 100 * inside[lang, g] >= cover * a:
            continue
        s, k = min((10**6 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
        out.setdefault(lang, []).append((-s, -a, " ".join(g).encode(), a, f[lang, g[:k]], f[lang, g[k:]]))
    return {(lang, i + 1, p.decode(), a, l, r, n[lang], -s) for lang, found in out.items()
            for i, (s, _, p, a, l, r) in enumerate(sorted(found)[:top])}


COLS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def frame(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    return df.withColumns({"w1": F.lit("x"), "n": F.lit(1), "word": F.lit(None).cast("string"), "k": F.lit(2), "code": F.lit("c"), "path": F.lit(0)})


def got(df):
    return {tuple(r) for r in df.select(*COLS).collect()}


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    words = ["The", "of", "the", "é", "a", "漢", "x'y", "#", "in", "B", "\x01", "\x1c"]
    rows = [(None, None), ("en", None), ("en", ""), (None, " \t .,"), ("en", "lone"), (None, "The the the the the the the the the the the the the")]
    for _ in range(300):
        rows.append((rnd.choice(["en", "en", "de", None, ""]), "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t ", "  ", ". ", "\n", "\r\n", ",", "\x0b"])
                                                                       for _ in range(rnd.randint(1, 60)))))
    passage = "one long passage without any branch that many texts share word for word"
    rows += [("en", passage + ". " + rnd.choice(words)) for _ in range(15)] + [("de", passage + " of the")] * 12
    return rows


@pytest.mark.parametrize("settings", [{}, {"ranked": 3}, {"ranked": 40, "parts": 200}, {"block": 50, "grams": 30, "words": 5}])
def test_collocations(spark, texts, monkeypatch, settings):
    for name, key in (("RANKED", "ranked"), ("PART_GRAMS", "parts"), ("BLOCK", "block"), ("GRAMS", "grams"), ("HELD_WORDS", "words")):
        if key in settings:
            monkeypatch.setattr(C, name, settings[key])
    assert got(C.collocations(frame(spark, texts).repartition(4))) == brute(texts)


def test_other_lengths_and_limits(spark, texts):
    df = frame(spark, texts).repartition(3)
    for longest, least, cover, top in ((4, 5, 50, 40), (2, 3, 50, 10), (3, 12, 90, 1000)):
        assert got(C.collocations(df, longest, least, cover, top)) == brute(texts, longest, least, cover, top)


def test_paths(spark, texts):
    df = C.collocations(frame(spark, texts), least=10)
    rows = {(r.lang, r.phrase): r.path_words for r in df.collect()}
    assert rows["en", "passage without any"] == rows["en", "one long passage"] == 13 and 13 == rows["de", "word for word"] - 2
    counts, words = C.phrase_counts(frame(spark, texts), 3, 10)
    of = {k: counts.where(f"k = {k}").select(*[f"w{j + 1}" for j in range(k)], "n") for k in (2, 3)}
    placed, inside = C.compacted(of[3], of[2], 3)
    name = {r.code: r.word.decode() for r in words.collect()}
    found = {(" ".join(name[c] for c in r["words"]), r.n) for r in C.paths(placed, 3).collect()}
    assert ("one long passage without any branch that many texts share word for word", 15) in found
    assert inside.count() == placed.count() - len({r.path for r in placed.select("path").collect()})


def test_empty_long_and_sample(spark):
    assert C.collocations(frame(spark, [])).count() == 0
    assert C.collocations(frame(spark, [("en", None), (None, "")])).count() == 0
    long = [("en", "a long text that goes on and on " * 5000), ("en", "short one")]
    assert got(C.collocations(frame(spark, long))) == brute(long)
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", "text").collect()]
    assert got(C.collocations(frame(spark, docs))) == brute(docs)
