"""Connected components of a link table by alternating star contraction, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelweave.llm.common import stored


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest of them: larger neighbours, or those not larger."""
    both = edges
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = both.join(low, "a")
    if large:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return _oriented(out)


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) for every id in `links` (a, b), both integers; the component is named by its smallest id.

    Runs until nothing changes; each round is written to the shared folder, so lineage stays
    short and no round passes through the driver. An id has at most one row.
    """
    edges = stored(_oriented(links), "links")
    seen = None
    while True:
        edges = stored(_star(_star(edges, True), False), "links")
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            break
        seen = state
    low = edges.groupBy("a").agg(F.min("b").alias("component_id")).withColumnRenamed("a", "id")
    return low.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())
