"""Queries of the training-data problems, and the SQL that checks them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kugiri.llm import dress, leakage, lookalike, mojibake, packing, quality, termcount
from kugiri.operators import badrows
from kugiri.operators.lexicon import surfaces
from kugiri.operators.queries import LINES_SQL, trimmed
from kugiri.plans.shared import read


def _surfaces(spark: SparkSession, d: str) -> DataFrame:
    return surfaces(read(spark, d, "token_views"), read(spark, d, "corpus_words"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Every surface with its record."""
    views = read(spark, d, "token_views").select("surface", F.lit("t").alias("tbl"), F.col("text_id").alias("record"))
    return views.unionByName(read(spark, d, "corpus_words").select("surface", F.lit("c").alias("tbl"), F.col("sentence_id").alias("record")))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and records of every distinct surface, and its mark."""
    counts, total = termcount.census(_records(spark, d), "surface", ["tbl", "record"])
    return termcount.mark_values(counts, total)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_counts(spark, d).where("mark IS NOT NULL").select("surface", "mark")


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """The comparable content of user words and of the seed lines that load."""
    users = read(spark, d, "user_words").select(F.concat(F.lit("user_words\t"), "dict_name").alias("scope"), F.col("entry_id").alias("id"), dress.pairs({}, F.array("東京スカイツリー", "part_of_speech", "reading")).alias("content"))
    lines = badrows.loaded(badrows.parse_lines(read(spark, d, "seed_lines").select("line_id", "dict_name", "c0"), read(spark, d, "dictionaries")))
    p = F.col("parsed")
    text = F.concat(F.slice(p["fields"], 1, 1), F.slice(p["fields"], 5, F.greatest(F.size(p["fields"]) - 4, F.lit(0))))
    seeds = lines.select(F.concat(F.lit("seed_lines\t"), "dict_name").alias("scope"), F.col("line_id").alias("id"), dress.pairs({"left": p["left_id"], "right": p["right_id"], "cost": p["cost"]}, text).alias("content"))
    return users.unionByName(seeds)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return dress.copies(_entries(spark, d), "scope", "id", "content").select(F.split("scope", "\t")[0].alias("tbl"), "first_id", "copy_id")


def p2_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """One row per distinct record with its number of copies."""
    return dress.collapse(_entries(spark, d), "scope", "id", "content").select(F.split("scope", "\t")[0].alias("tbl"), "first_id", "copies")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.match_lexicon(_surfaces(spark, d), read(spark, d, "lexicon"), read(spark, d, "dictionaries")).select("tbl", "row_id", "word_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restore_rows(_surfaces(spark, d), read(spark, d, "lexicon"), read(spark, d, "dictionaries")).select("tbl", "row_id", "word_id")


#: Common words that are shipped to the workers.
MOST_COMMON = 100_000


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    """Texts in containers of 2,048 tokens."""
    return packing.pack(packing.token_counts(read(spark, d, "documents"), "doc_id", "text"), 2048)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(read(spark, d, "documents").select("doc_id", "text"), read(spark, d, "eval_items").select("item_id", "text"))


def p9_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of every document."""
    words = [r.word for r in read(spark, d, "common_words").select("word").where("word IS NOT NULL").distinct().limit(MOST_COMMON + 1).collect()]
    if len(words) > MOST_COMMON:
        raise ValueError(f"more than {MOST_COMMON} common words")
    docs = read(spark, d, "documents").select("doc_id", "text")
    return quality.measure_fitted(docs, words)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(p9_stats(spark, d)).select("doc_id")


QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts, "p2_found": p2_found, "p2_collapsed": p2_collapsed, "p3_found": p3_found, "p6_found": p6_found, "p7_pack": p7_pack, "p8_found": p8_found, "p9_found": p9_found, "p9_stats": p9_stats}
_COUNTS = """WITH r AS (SELECT surface, 't' AS tbl, text_id AS record FROM token_views UNION ALL SELECT surface, 'c', sentence_id FROM corpus_words),
n AS (SELECT count(*) AS n FROM (SELECT DISTINCT tbl, record FROM r)),
p AS (SELECT surface, tbl, record, count(*) AS k FROM r WHERE surface IS NOT NULL GROUP BY ALL)
SELECT surface, sum(k)::BIGINT AS occurrences, count(*) AS records, CASE WHEN count(*) <= 2 THEN 'rare' WHEN count(*) > 0.1 * any_value(n) THEN 'common' END AS mark FROM p, n GROUP BY surface"""
_CONTENT = f"""WITH {LINES_SQL},
e AS (SELECT 'user_words' AS tbl, entry_id AS id, dict_name, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::BIGINT AS c, ["東京スカイツリー", part_of_speech, reading] AS f FROM user_words UNION ALL SELECT 'seed_lines', line_id, dict_name, {trimmed(2)}::BIGINT, {trimmed(3)}::BIGINT, {trimmed(4)}::BIGINT, [f[1]] || f[5:] FROM q WHERE reason IS NULL),
k AS (SELECT tbl, id, dict_name, a, b, c, list_sort(list_filter(list_transform(f, lambda x: lower(upper(regexp_replace(coalesce(x, ''), '[^\\p{{L}}\\p{{Nd}}]+', '', 'g')))), lambda x: x <> '')) AS f FROM e),
g AS (SELECT tbl, id AS copy_id, min(id) OVER w AS first_id, count(*) OVER w AS copies FROM k WINDOW w AS (PARTITION BY tbl, dict_name, a, b, c, f))"""
ORACLES = {
    "p1_counts": _COUNTS,
    "p1_found": f"SELECT surface, mark FROM ({_COUNTS}) WHERE mark IS NOT NULL",
    "p2_found": f"{_CONTENT} SELECT tbl, first_id, copy_id FROM g WHERE copy_id <> first_id",
    "p2_collapsed": f"{_CONTENT} SELECT tbl, first_id, copies FROM g WHERE copy_id = first_id",
}
