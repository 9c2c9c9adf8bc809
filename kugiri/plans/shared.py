"""Tables and checkpoints in the folder that all executors share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. On a single machine where it is unset, a folder of our own; on a cluster an error, as
    executors would write to their own disks."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir is not set, and executors of {master} share no folder without it")
        place = tempfile.mkdtemp(prefix="kugiri-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def stable(df: DataFrame) -> DataFrame:
    """df written once as a Parquet table in the shared folder and read back.

    Cuts the lineage so that a lost executor costs no recomputation of what lies before, and fixes row
    partitioning and ids that a recomputation could change. release() deletes it early; else it goes when the application ends.
    """
    at = f"{folder(df.sparkSession)}/kugiri-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(path)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def release(table: DataFrame) -> None:
    """Deletes a table that stable() made and nothing reads any more."""
    spark = table.sparkSession
    for place in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if place.rsplit("/", 1)[-1].startswith("kugiri-"):
            path = spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores when it comes in fewer partitions, as a small file does; else as it is, without a shuffle.

    For expensive work on each row.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
