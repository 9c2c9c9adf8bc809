"""Tokens of streams. Tokenizing keeps no state, so the batch operators work on streams as they are; here are the windowed counts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kugiri.plans.analyzer import Tokenizer


def token_stream(stream: DataFrame, tokenizer: Tokenizer, text: str) -> DataFrame:
    """One row per token of a streaming DataFrame."""
    return tokenizer.tokenize_rows(stream, text)


def windowed_counts(stream: DataFrame, tokenizer: Tokenizer, text: str, time: str, window: str = "1 hour", slide: str | None = None, late: str = "1 hour", by: list[str] | None = None) -> DataFrame:
    """Surfaces per window of event time. Rows more than `late` behind the newest are dropped, and state is freed with them."""
    columns = [time, *(by or [])]
    surfaces = stream.select(*columns, F.explode(tokenizer.surfaces(stream.sparkSession, text)).alias("surface"))
    if stream.isStreaming:
        surfaces = surfaces.withWatermark(time, late)
    span = F.window(time, window, slide) if slide else F.window(time, window)
    return surfaces.groupBy(span.alias("window"), *(by or []), "surface").agg(F.count("*").alias("n"))
