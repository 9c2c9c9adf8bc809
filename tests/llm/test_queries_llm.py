import pytest

from compare import compare
from kugiri.llm.queries import ORACLES, QUERIES

COLUMNS = {"p1_found": ["surface", "mark"], "p2_found": ["tbl", "first_id", "copy_id"], "p3_found": ["tbl", "row_id", "word_id"], "p6_found": ["tbl", "row_id", "word_id"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id"]}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    compare(spark, name, QUERIES[name], ORACLES.get(name))


def test_columns(spark):
    from compare import DATA

    if DATA.exists():
        for name, columns in COLUMNS.items():
            out = QUERIES[name](spark, str(DATA))
            assert out.columns == columns and out.count() == out.distinct().count()
