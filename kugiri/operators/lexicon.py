"""Rows against the lexicon of their dictionary."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kugiri.plans.skew import join_table


def outside(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The rows whose surface isn't NULL and is no lexicon surface of their dict_name."""
    known = lexicon.select("dict_name", "surface").distinct()
    return join_table(rows.where(F.col("surface").isNotNull() & F.col("dict_name").isNotNull()), known, ["dict_name", "surface"], "left_anti")


def surfaces(views: DataFrame, words: DataFrame, *more: str) -> DataFrame:
    """tbl, row_id, dict_name and surface of both token tables."""
    columns = ["row_id", "dict_name", "surface", *more]
    return views.select(F.lit("token_views").alias("tbl"), *columns).unionByName(words.select(F.lit("corpus_words").alias("tbl"), *columns))
