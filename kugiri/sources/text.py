"""Text lines and annotated corpora."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kugiri.plans.rank import with_rank


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files, trimmed, one analysis each; empty lines stay."""
    return spark.read.text(path).select(F.expr(r"regexp_replace(value, '^\\s+|\\s+$', '')").alias("text"))


def text_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path).select(F.expr(r"regexp_replace(value, '^\\s+|\\s+$', '')").alias("text"))


def annotated_sentences(text: str) -> list[list[tuple[str, str]]]:
    """Sentences of (surface, feature) from lines with a tab between; EOS or a blank line ends a sentence."""
    out, now = [], []
    for line in text.splitlines():
        line = line.strip()
        if not line or line == "EOS":
            if now:
                out.append(now)
            now = []
            continue
        parts = line.split("\t")
        if len(parts) >= 2:
            now.append((parts[0], parts[1]))
    return [*out, now] if now else out


def annotated_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Sentences of corpus files as rows: file, sentence (a number that grows along the files) and tokens (surface, feature).

    The lines of a file are read by many tasks; a sentence's lines meet by the number of sentence ends before them.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.expr(r"regexp_replace(value, '^\\s+|\\s+$', '')").alias("line"))
    placed = with_rank(lines, ["file", "block", "at"], "g")
    kept = with_rank(placed.where("line NOT IN ('', 'EOS')").select("file", "g", F.split("line", "\t").alias("parts")), ["g"], "h")
    words = kept.where(F.size("parts") >= 2).select("file", (F.col("g") - F.col("h")).alias("sentence"), "g", F.struct(F.col("parts")[0].alias("surface"), F.col("parts")[1].alias("feature")).alias("word"))
    rows = words.groupBy("file", "sentence").agg(F.sort_array(F.collect_list(F.struct("g", "word"))).alias("words"))
    return rows.select("file", "sentence", F.transform("words", lambda w: w["word"]).alias("tokens"))
