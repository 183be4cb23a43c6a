"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsift.session import remove_stage, write_stage

MAX_ROUNDS = 60


def _min_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = both.join(_min_neighbour(both).withColumnRenamed("u", "__u").hint("merge"), F.col("u") == F.col("__u"))
    return linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _min_neighbour(down)
    linked = (down.join(low.withColumnRenamed("u", "__u").hint("merge"), F.col("u") == F.col("__u"))
              .filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")))
    return linked.unionByName(low.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(
        F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")),
        F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(u, v) long edges -> (node, component) for every node on an edge; component is its least node.

    Each round joins edges with one minimum per node, so a hub only skews the edge side of a join,
    which adaptive execution splits; minima are sorted and merged, never collected in the driver. Rounds are written out; failing to settle is an error.
    """
    links = edges.filter(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current, path = write_stage(links, "components")
    before = _state(current)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        replaced = path
        current, path = write_stage(_small_star(_large_star(current).distinct()).distinct(), "components")
        remove_stage(edges.sparkSession, replaced)
        after = _state(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
