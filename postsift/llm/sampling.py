"""Bounded, repeatable samples of labelled rows without a sort of a whole class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def least_hashed(rows: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """(g, k): of each value of ``group`` the ``n`` distinct keys of least hash, all of them if there are fewer.

    Counts of 65,536 hash ranges say up to which range a group's sample reaches. Only keys up to there, ``n`` and one
    range more, go to the task that ranks them, whatever the number of rows. Repeated keys are one, keys of equal hash
    follow the key, null groups and null keys take no part, and an empty table gives an empty one.
    """
    keys = (rows.select(F.col(group).alias("g"), F.col(key).alias("k")).filter(F.col("g").isNotNull() & F.col("k").isNotNull())
            .distinct().withColumn("h", F.xxhash64("k")).withColumn("place", F.shiftright("h", 48)))
    counts = keys.groupBy("g", "place").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("g").orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # Joined by group and range, as a group alone may hold most rows.
    reach = counts.withColumn("before", before).filter(F.col("before") < n).select(F.col("g").alias("gg"), F.col("place").alias("pp"))
    near = keys.join(reach, (F.col("g") == F.col("gg")) & (F.col("place") == F.col("pp")), "left_semi")
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("g").orderBy("h", "k")))
    return ranked.filter(F.col("rank") <= n).select("g", "k")
