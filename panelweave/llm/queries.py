"""One query for each text operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelweave.llm import (alignment, bpe, collocations, decontaminate, licenses, lines, packing, pii, quality, similarity, suffix_dedup,
                            toxicity, url_filter)
from panelweave.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document without 50-byte strings of smaller documents."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category probabilities of every document by a chain trained on the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    labelled = toxicity.labelled_documents(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, toxicity.train_chain(labelled, toxicity.CATEGORIES))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, mean log ratio and verdict of every document; labels of quality 1 are the trusted target."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality.report(table(spark, sf_dir, "documents"), trusted)


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page by the list entries that were active on its fetch day."""
    return url_filter.judge(*url_filter.dated_pages(table(spark, sf_dir, "pages")))


ORACLES["op4_url_filter"] = url_filter.ORACLE


@query
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingles have a Jaccard similarity of at least 0.85."""
    return similarity.jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


@query
def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of every document and its text with surrogates, under a fixed demonstration key."""
    found = pii.replace_entities(table(spark, sf_dir, "documents"), key=b"demonstration key")
    return found.select("doc_id", "n_entities", "n_distinct", F.concat_ws(",", "kinds").alias("kinds"), "text")


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside 10-word windows of the benchmark."""
    return decontaminate.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document without those similar to an earlier line (Jaccard of words at least 0.8)."""
    return lines.line_report(table(spark, sf_dir, "documents"))


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and hashes of the ids and of the decoded bytes of every document."""
    docs = table(spark, sf_dir, "documents")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_decode(docs, path, public_tokenizers.PATTERN, keep_ids=False)


@query
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences of 4096 tokens."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, size=4096, keep_ids=False)


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of 2 to 3 words of each language by cohesion."""
    return collocations.collocations(table(spark, sf_dir, "documents"), longest=3, least=10, cover=50, top=2000).drop("path_words")


ORACLES["op12_collocations"] = collocations.ORACLE


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a byte-level and a piece tokenizer align on every document."""
    return alignment.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                            public_tokenizers.path("piece_bpe_32k.model"))
