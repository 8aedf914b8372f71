"""Toxicity, URL filter, surrogates, license scan and the pipeline."""

import base64
import datetime
import hashlib
import random
import re

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from test_contract_operators import brute_components, brute_lines
from panelweave.llm import decontaminate, licenses, lines, pii, quality, similarity, toxicity, url_filter

SF = "/root/testdata/sf0.001"


def read(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = read(spark, "documents", sf), read(spark, "labels", sf)
    held = labels.where("doc_id % 5 = 0")
    chain = toxicity.train_chain(toxicity.labelled_documents(docs, labels.where("doc_id % 5 <> 0")), toxicity.CATEGORIES)
    assert [m["name"] for m in chain] == toxicity.CATEGORIES
    assert len(chain[2]["weights"]) == len(chain[2]["words"]) + 3  # two earlier probabilities and the intercept
    hits = toxicity.score(docs.join(held.select("doc_id"), "doc_id"), chain).select("doc_id", F.col("toxic").alias("found")).join(held, "doc_id")
    table = {(r.found, r.toxic): r.n for r in hits.groupBy("found", "toxic").agg(F.count("*").alias("n")).collect()}
    assert table[True, 1] / (table[True, 1] + table.get((False, 1), 0)) > 0.85
    assert table.get((True, 0), 0) / table[False, 0] < 0.01


def test_toxicity_edges(spark):
    rows = spark.createDataFrame([(1, None, 0, 1), (2, "", 1, 1), (None, "x", 1, 0)], "doc_id long, text string, a int, b int")
    chain = toxicity.train_chain(rows, ["a", "b"])
    found = toxicity.score(rows, chain).collect()
    assert len(found) == 3 and all(0 <= r.p_a <= 1 and r.p_b == 1 for r in found)
    assert toxicity.score(rows.limit(0), toxicity.train_chain(rows.limit(0), ["a", "b"])).count() == 0


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(n)


def test_url_filter(spark):
    captures = spark.createDataFrame(
        [(1, "http://a.b.example.com/x/1", day(5)), (2, "https://u@A.B.example.com:8/y", day(5)), (3, "http://b.example.com/", day(9)),
         (4, "no url", day(5)), (5, None, day(5)), (6, "http://b.example.com/", None), (7, "http://a.b.example.com/x", day(2)), (7, "http://a.b.example.com/x", day(2))],
        "page_id long, url string, day date").withColumn("key", F.lit("clash"))
    entries = spark.createDataFrame(
        [("b.example.com", day(3), 1, "block"), ("b.example.com", day(3), 0, "allow"), ("b.example.com", day(9), 0, "remove"),
         ("a.b.example.com/x", day(5), 0, "allow"), (None, day(1), 0, "block"), ("example.com", None, 0, "block")],
        "key string, day date, seq int, action string")
    found = {r.page_id: (r.verdict, r.rule_key, r.rule_to) for r in url_filter.judge(captures, entries).collect()}
    assert found == {1: ("allowed", "a.b.example.com/x", None), 2: ("blocked", "b.example.com", "2024-01-10"), 3: ("unlisted", None, None),
                     4: ("invalid", None, None), 5: ("invalid", None, None), 6: ("unlisted", None, None), 7: ("unlisted", None, None)}
    assert url_filter.judge(captures.limit(0), entries).count() == 0
    assert url_filter.judge(captures, entries.limit(0)).where("verdict = 'blocked'").count() == 0


def test_surrogates(spark):
    rows = [(0, "Mail Ann.B1@mail3.example.com or ann.b1@mail3.example.com"), (1, "+1 (017) 555-7713 and +1 017 555 7713"), (2, None), (3, ""),
            (4, "4225039295678253 4225 0392 9567 8253 10.0.0.7"), (5, "Mr. John Smith met Frau Anna"), (6, "see 3.14, version 2.0."), (None, "10.0.0.7")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit(1))
    found = {r.doc_id: r for r in pii.replace_entities(df, b"key").collect()}
    assert found == {r.doc_id: r for r in pii.replace_entities(df, b"key").collect()}
    assert {d: r.n_entities for d, r in found.items()} == {0: 2, 1: 2, 2: 0, 3: 0, 4: 3, 5: 2, 6: 0, None: 1}
    a, b = re.findall(r"\S+@\S+", found[0].text)
    assert a.lower() == b and "ann" not in b and b.endswith(".com")
    a, b = re.fullmatch(r"(\+1 \(\d{3}\) \d{3}-\d{4}) and (\+1 \d{3} \d{3} \d{4})", found[1].text).groups()
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != "10175557713"
    card, spaced, ip = re.fullmatch(r"(\d{16}) (\d{4} \d{4} \d{4} \d{4}) (\S+)", found[4].text).groups()
    assert card == spaced.replace(" ", "") != "4225039295678253" and found[None].text == ip != "10.0.0.7"
    assert re.fullmatch(r"Mr\. [A-Z]\w+[nrs] [A-Z]\w+ met Frau [A-Z]\w+a", found[5].text)
    assert found[2].text is None and found[3].text == "" and found[6].text == rows[6][1]
    assert pii.replace_entities(df.limit(0), b"key").count() == 0


def test_surrogates_search_every_text_once(spark, monkeypatch):
    frames = type(spark.range(1))
    searched, plain = [], frames.mapInArrow

    def noted(df, run, schema, *more):
        if "text" in df.columns and "_e" not in df.columns:  # without its entities
            searched.append(schema)
        return plain(df, run, schema, *more)

    monkeypatch.setattr(frames, "mapInArrow", noted)
    found = pii.replace_entities(spark.createDataFrame([(1, "10.0.0.7 and 10.0.0.7"), (1, "10.0.0.7"), (2, None)], "doc_id long, text string"), b"key")
    assert sorted((r.doc_id, r.n_entities) for r in found.collect()) == [(1, 1), (1, 2), (2, 0)] and len(searched) == 1


def test_surrogates_stay_distinct(spark):
    ips = [f"{a}.{b}.1.1" for a in range(1, 10) for b in range(1, 10)]  # 81 originals in a space of 6,561
    table = pii._assign(spark.createDataFrame([("ip", x) for x in ips], "kind string, normal string"), b"k").collect()
    new = {r.new for r in table}
    assert len(table) == len(new) == len(ips) and not new & set(ips)


def test_surrogates_never_run_out(spark):
    names = ["Li", "Wu", "Xu", "Hu", "Lu", "Ma", "He", "Yu", "Su", "Du", "Fu", "Gu"]
    rows = [(i, f"Ms {n} was there.") for i, n in enumerate(names)] + [(20, "Mr Արամ and Mr 𝐌𝐚𝐧 and Mr Ａｂｃ")]
    found = {r.doc_id: r for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), b"key").collect()}
    new = [re.fullmatch(r"Ms ([A-Z][a-z]+) was there\.", found[i].text)[1] for i in range(len(names))]
    assert len(set(new)) == len(names) and not set(new) & set(names)
    other = re.fullmatch(r"Mr (\w+) and Mr (\w+) and Mr (\w+)", found[20].text).groups()
    assert [pii._script(x[0]) for x in other] == ["ARMENIAN", "MATHEMATICAL", "FULLWIDTH"] and found[20].n_entities == 3
    assert all(x not in rows[-1][1] for x in other)
    assert pii.render("+1 23 45", "phone", "1986754") == "+1 98 6754"


def test_license_scan(spark):
    rnd = random.Random(1)
    noise = lambda n: " ".join(rnd.choice(["alpha", "of", "the", "under", "stone"]) + str(rnd.randint(0, 9)) for _ in range(n))
    rows, want = [(0, None), (1, ""), (2, "mit")], set()
    for i in range(300):
        name, text = licenses.TEMPLATES[i % len(licenses.TEMPLATES)]
        rows.append((10 + i, f"{noise(rnd.randint(0, 40))}\n{text.upper() if i % 3 else text} {noise(rnd.randint(0, 40))}"))
        want.add((10 + i, name))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("at", F.lit(None).cast("string"))
    found = {(r.doc_id, r.license_id) for r in licenses.scan(df).where("containment = 1").collect()}
    assert want <= found
    assert {d for d, _ in found} == {d for d, _ in want}
    extra = {n for d, n in found - want}
    assert extra <= {"Apache-2.0"}  # its notice is the beginning of the header's text
    assert licenses.scan(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    """Every stage once, each against a brute-force version of its own input."""
    docs = read(spark, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, before, SF).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        assert after.columns == docs.columns, name
        was, now = ([tuple(r) for r in d.select("doc_id", "text").collect()] for d in (before, after))
        ids, text = {d for d, _ in now}, dict(now)
        if k == 0:
            verdict = quality.report(before, read(spark, "labels").where("quality = 1"))
            assert ids == {r.doc_id for r in verdict.where("kept").select("doc_id").collect()}
        if k == 1:
            want = {d: (n, h) for d, _, n, h in brute_lines(was, 80, 1)}
            hashes = {d: hashlib.sha256(t.encode()).hexdigest() for d, t in now}
            assert all(hashes[d] == want[d][1] for d in ids)
            blank = {hashlib.sha256(("\n" * n).encode()).hexdigest() for n in range(50)}  # nothing but line ends is left
            assert {d for d, t in was if d not in ids} <= {d for d, (n, h) in want.items() if n and h in blank} and len(ids) > 0.5 * len(was)
            assert after.where("n_chars <> length(text)").count() == 0
        if k == 2:
            assert ids == {c for _, _, c in brute_components(was, 5, 80)} and all(text[d] == dict(was)[d] for d in ids)
        if k == 3:
            assert decontaminate.leak_report(after, read(spark, "benchmark")).where("contaminated").count() <= 1
        before = after
    tokens = corpus_pipeline.STAGES[4][1](spark, before, SF).select("doc_id", "ids").collect()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r.doc_id: r.ids for r in tokens} == {d: library.encode_ordinary(t or "") for d, t in now}


def test_run_hands_each_result_to_the_next_stage(spark, monkeypatch):
    step = lambda n: (str(n), lambda spark, docs, sf: docs.where(f"doc_id % {n} <> 0").withColumn("n_chars", F.col("n_chars") + n))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [step(2), step(3), step(5)])
    got = {r.doc_id: r.n_chars for r in corpus_pipeline.run(spark, SF).select("doc_id", "n_chars").collect()}
    assert got == {r.doc_id: r.n_chars + 10 for r in read(spark, "documents").collect() if r.doc_id % 2 and r.doc_id % 3 and r.doc_id % 5}


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:4]])
def test_stages_take_empty_tables(spark, stage):
    empty = read(spark, "documents").limit(0)
    assert stage(spark, empty, SF).count() == 0
