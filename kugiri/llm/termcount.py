"""Frequency of every distinct value by heavy-light aggregation.

Three passes over two columns. Heavy values are detected by the mergeable frequent-items sketch and joined by broadcast to a
bit each. In the second pass every record's heavy bits are united into one mask, and the masks are summed into one exact
counter array per task; the masks also count the records. In the third pass a heavy value's rows fall into one count per task,
and only the light values are shuffled, as distinct (value, record) pairs and then as partial counts. The heavy values' records
are put to the counts at the end.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Heavy values at most; their masks take HEAVY / 8 bytes a record.
HEAVY = 192
WORD = 63


def heavy_values(rows: DataFrame, value: str, most: int = HEAVY) -> list[str]:
    """The values that may hold at least 1/1024 of the rows, the most frequent first, at most `most` of them.

    From a sketch that errs only in which values are called heavy; the counts don't depend on it.
    """
    top = rows.where(F.col(value).isNotNull()).agg(F.expr(f"approx_top_k(`{value}`, {most}, 4096)").alias("top"), F.count("*").alias("n")).first()
    return [x["item"] for x in top["top"] or [] if x["count"] * 1024 >= top["n"]]


def _sum_bits(n: int, words: int):
    def sums(batches):
        total, masks_seen = np.zeros(words * WORD, np.int64), 0
        for b in batches:
            masks_seen += b.num_rows
            for w in range(words):
                masks = b.column(w).to_numpy(zero_copy_only=False).astype("<i8")
                bits = np.unpackbits(masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                total[w * WORD : (w + 1) * WORD] += bits[:, :WORD].sum(0, dtype=np.int64)
        at = np.flatnonzero(total[:n])
        yield pa.RecordBatch.from_pydict({"bit": pa.array([-1, *at], pa.int32()), "records": pa.array([masks_seen, *total[at]], pa.int64())})

    return sums


def census(rows: DataFrame, value: str, record: list[str]) -> tuple[DataFrame, int]:
    """count_values() and the number of all records, those without any value among them."""
    spark = rows.sparkSession
    rows = rows.select(F.col(value).alias("v"), *[F.col(c).alias(f"r{i}") for i, c in enumerate(record)])
    keys = [f"r{i}" for i in range(len(record))]
    heavy = heavy_values(rows, "v")
    bits = spark.createDataFrame([(v, i) for i, v in enumerate(heavy)], "v string, bit int").coalesce(1)
    words = max(1, -(-len(heavy) // WORD))
    # NULL joins no bit, so a record without heavy values has an empty mask
    marked = rows.join(F.broadcast(bits), "v", "left")
    masks = marked.groupBy(*keys).agg(*[F.expr(f"bit_or(if(bit div {WORD} = {w}, shiftleft(1L, int(bit % {WORD})), 0L))").alias(f"m{w}") for w in range(words)])
    sums = masks.select(*[F.coalesce(f"m{w}", F.lit(0)).alias(f"m{w}") for w in range(words)]).mapInArrow(_sum_bits(len(heavy), words), "bit int, records long").groupBy("bit").agg(F.sum("records").alias("records"))
    # at most one row per heavy value
    found = {r.bit: r.records for r in sums.collect()}
    total = found.pop(-1, 0)
    # a heavy value's record doesn't matter here, so that its rows become one in each task
    light = [F.when(F.col("bit").isNull(), F.col(k)).alias(k) for k in keys]
    pairs = marked.where("v IS NOT NULL").groupBy("v", "bit", *light).agg(F.count("*").alias("n"))
    counts = pairs.groupBy("v", "bit").agg(F.sum("n").alias("occurrences"), F.count("*").alias("pairs"))
    records = spark.createDataFrame(list(found.items()), "bit int, records long").coalesce(1)
    out = counts.join(F.broadcast(records), "bit", "left").select(F.col("v").alias(value), "occurrences", F.coalesce("records", "pairs").alias("records"))
    return out, total


def count_values(rows: DataFrame, value: str, record: list[str]) -> DataFrame:
    """One row per distinct non-NULL value: value, occurrences, records (distinct combinations of the record columns).

    rows may hold any further columns. NULL values are no values; a NULL record column is a record of its own like any
    other value. Values are compared exactly as stored. An empty table gives no row.
    """
    return census(rows, value, record)[0]


def mark_values(counts: DataFrame, total_records: int, rare_records: int = 2, common_share: float = 0.1) -> DataFrame:
    """counts with mark: rare in at most rare_records records, common in more than common_share of all, else NULL.

    A value that is both (in very small collections) is common no more: rare goes first.
    """
    return counts.withColumn("mark", F.when(F.col("records") <= rare_records, "rare").when(F.col("records") > F.lit(total_records * common_share), "common"))
