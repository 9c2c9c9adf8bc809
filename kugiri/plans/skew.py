"""Joins whose keys may each hold a third of all rows."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy when it holds at least this share of the rows, so at most 1 / HEAVY_SHARE keys are heavy.
HEAVY_SHARE = 1 / 1024
#: A table is broadcast whole when it has at most so many rows and, as JSON, so many characters; both are counted.
MOST_ROWS, MOST_CHARS = 200_000, 64_000_000
#: Keys that the sketch of heavy ones tracks: above 1 / HEAVY_SHARE, so that none of them is missed.
TRACKED = 8192


def heavy_keys(counts: DataFrame, count: str, total: int) -> Column:
    """Condition on a table of one row per key: true for the at most 1 / HEAVY_SHARE keys that are heavy."""
    return F.col(count) >= F.lit(max(1.0, total * HEAVY_SHARE))


def join_by_key(rows: DataFrame, keyed: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """rows joined with keyed, which has one row per key and in `count` the key's number of rows.

    Heavy keys are joined by broadcast (there are at most 1 / HEAVY_SHARE of them, however large the data); the rows of
    all others meet by a shuffle in which no key has more than HEAVY_SHARE of the rows.
    A NULL key joins nothing.
    """
    heavy = heavy_keys(keyed, count, total)
    top, rest = keyed.where(heavy).drop(count), keyed.where(~heavy).drop(count)
    marks = top.select(*on, F.lit(True).alias("__heavy"))
    hot = rows.join(F.broadcast(top), on, "inner")
    cold = rows.join(F.broadcast(marks), on, "left_anti").join(rest, on, "inner")
    return hot.unionByName(cold)


def small(df: DataFrame, most: int | None = None) -> bool:
    """Whether df may be broadcast whole: at most `most` rows (MOST_ROWS) of at most MOST_CHARS characters, counted here."""
    most = MOST_ROWS if most is None else most
    got = df.limit(most + 1).agg(F.count("*").alias("n"), F.sum(F.length(F.to_json(F.struct("*")))).alias("chars")).first()
    return got.n <= most and (got.chars or 0) <= MOST_CHARS


def _heavy_hashes(key: Column, rows: DataFrame) -> list[int]:
    """Hashes of the keys that may hold HEAVY_SHARE of the rows, by a mergeable frequent-items sketch: one pass, a bounded result.

    The sketch errs only in which keys are called heavy, which changes no result.
    """
    most = round(1 / HEAVY_SHARE)
    top = rows.select(key.alias("h")).where("h IS NOT NULL").agg(F.expr(f"approx_top_k(h, {most}, {TRACKED})").alias("top"), F.count("*").alias("n")).first()
    return [x["item"] for x in top["top"] or [] if x["count"] >= top["n"] * HEAVY_SHARE]


def join_table(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner", most: int | None = None) -> DataFrame:
    """rows joined with a table of any size, inner, left or left_anti; the result is that of rows.join(table, on, how).

    A small table (see small) is broadcast and rows stay where they are. With a larger one the keys that hold many of the rows
    are found by a sketch: their entries, at most 1 / HEAVY_SHARE keys of them, are broadcast, and only the rows of all other
    keys are shuffled. Rows with a NULL key, which join nothing, are never shuffled. A key of the table must have few entries.
    """
    if how not in ("inner", "left", "left_anti"):
        raise ValueError(how)
    if small(table, most):
        return rows.join(F.broadcast(table), on, how)
    has_key = reduce(Column.__and__, [F.col(f"`{c}`").isNotNull() for c in on])
    key = F.when(has_key, F.xxhash64(*[F.col(f"`{c}`") for c in on]))
    heavy = key.isin(_heavy_hashes(key, rows))
    whole = rows.where(has_key)
    hot = whole.where(heavy).join(F.broadcast(table.where(heavy)), on, how)
    out = hot.unionByName(whole.where(~heavy).join(table.where(~heavy), on, how))
    if how == "inner":
        return out
    rest = rows.where(~has_key)
    return out.unionByName(rest, allowMissingColumns=True) if how == "left" else out.unionByName(rest)
