"""Joins with hot keys against plain joins."""

import pytest
from pyspark.sql import functions as F

from kugiri.plans.shared import folder, release, stable
from kugiri.plans.skew import join_table, small

KEYS = ["dict_name", "surface"]


@pytest.fixture(scope="module")
def tables(spark):
    """One surface holds a third of all rows; keys without an entry, NULL keys, repeated rows, several entries of a key."""
    n = F.col("id")
    surface = F.when(n % 3 == 0, "の").when(n % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("s"), (n % 997).cast("string")))
    rows = spark.range(9000).select(F.when(n % 11 == 0, F.lit(None)).otherwise("a").alias("dict_name"), surface.alias("surface"), (n % 50).alias("x"))
    table = spark.createDataFrame([("a", "の", 1), ("a", "の", 2), ("a", None, 3), (None, "の", 4), *[("a", f"s{i}", i) for i in range(0, 997, 2)]], "dict_name string, surface string, y int")
    return rows, table


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
@pytest.mark.parametrize("most", [0, None])
def test_join_equals_plain_join(tables, how, most):
    rows, table = tables
    got = join_table(rows, table, KEYS, how, most)
    expected = rows.join(table, KEYS, how)
    assert got.columns == expected.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, expected.collect()))


def test_hot_rows_are_not_shuffled(tables):
    rows, table = tables
    plan = join_table(rows, table, KEYS, "left_anti", 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "strategy=broadcast" in plan
    assert small(table) and not small(table, 3)
    empty = rows.limit(0)
    assert join_table(empty, table, KEYS, "inner", 0).count() == 0 and join_table(rows, table.limit(0), KEYS, "left", 0).count() == 9000


def test_tables_of_the_shared_folder(spark):
    kept = stable(spark.range(10))
    assert kept.count() == 10
    release(kept)
    assert folder(spark)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, name, default):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        folder(Session())
