"""Positions in a total order without gathering the rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kugiri.plans.shared import stable


def with_rank(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """df with each row's place (from 0) in the order: a range-partitioned sort, places within partitions, and partition offsets.

    Equal rows get places in any order. Only one count per partition comes to the driver.
    """
    placed = stable(df.sort(*order).select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__m")))
    counts = {r["__p"]: r["count"] for r in placed.groupBy("__p").count().collect()}
    offset, rows = 0, []
    for p in sorted(counts):
        rows.append((p, offset))
        offset += counts[p]
    offsets = df.sparkSession.createDataFrame(rows or [(-1, 0)], "__p int, __o long")
    return placed.join(F.broadcast(offsets), "__p").select(*df.columns, (F.col("__o") + F.col("__m").bitwiseAND((1 << 33) - 1)).alias(name))
