"""Queries of the general data problems."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kugiri.operators import badrows, packed
from kugiri.plans.shared import read


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    parsed = badrows.parse_lines(read(spark, d, "seed_lines").select("line_id", "dict_name", "c0"), read(spark, d, "dictionaries"))
    return badrows.rejected(parsed).select("line_id", F.col("parsed.reason").alias("reason"))


def p4_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The loading lines, typed."""
    parsed = badrows.loaded(badrows.parse_lines(read(spark, d, "seed_lines").select("line_id", "dict_name", "c0"), read(spark, d, "dictionaries")))
    return parsed.select("line_id", "dict_name", F.trim(F.col("parsed.fields")[0]).alias("surface"), *[F.col(f"parsed.{c}").alias(c) for c in ("left_id", "right_id", "cost")], F.size("parsed.fields").alias("n_fields"))


def p4_sources(spark: SparkSession, d: str) -> DataFrame:
    """Source files put together from their lines, parsed with recovery: the typed records that begin at an anchor."""
    lines = read(spark, d, "seed_lines").select("source_file", "line_id", "c0")
    records = badrows.source_records(lines, "source_file", "line_id", "c0").where("anchored")
    return records.select("source_file", "line", F.trim(F.col("fields")[0]).alias("surface"), "left_id", "right_id", "cost", F.size("fields").alias("n_fields"))


def p4_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Where quotes broke in those files, with the line and the character."""
    lines = read(spark, d, "seed_lines").select("source_file", "line_id", "c0")
    return badrows.source_records(lines, "source_file", "line_id", "c0").where("error_at IS NOT NULL").select("source_file", "line", "error_line", "error_at")


def p5_guided(spark: SparkSession, d: str) -> DataFrame:
    """Details of lexicon words, joined by commas without any quotes, split again: known values keep their delimiters.

    Words with a value of nothing but delimiters are left out, as nobody could tell it from those that join.
    """
    lexicon = read(spark, d, "lexicon")
    only = "^[" + "".join(f"\\x{{{ord(c):x}}}" for c in packed.separators()) + "]+$"
    clear = lexicon.where(~F.exists("details", lambda v: v.rlike(only)))
    return packed.split_rows(clear.select("word_id", F.array_join("details", ",").alias("packed")), "packed", known=packed.known_values(lexicon))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    known = packed.known_values(read(spark, d, "lexicon"))
    views = read(spark, d, "token_views").select(F.lit("token_views").alias("tbl"), "row_id", F.col("details").alias("packed"))
    words = read(spark, d, "corpus_words").select(F.lit("corpus_words").alias("tbl"), "row_id", F.col("feature").alias("packed"))
    return packed.split_rows(views.unionByName(words), "packed", known=known)


QUERIES = {"p4_found": p4_found, "p4_loaded": p4_loaded, "p4_sources": p4_sources, "p4_breaks": p4_breaks, "p5_found": p5_found, "p5_guided": p5_guided}


# SQL: the same rules said by regular expressions ----------------------------------------------------------------------

_WHITE = r"\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_CLEAR = '(?:"(?:[^"]|"")*"|[^",]*)'
_FIELD = '(?:"(?:[^"]|"")*"|[^",][^,]*|)'


def trimmed(i: int) -> str:
    return f"regexp_replace(f[{i}], '^[{_WHITE}]+|[{_WHITE}]+$', '', 'g')"


def _number(i: int, low: int, high: int) -> str:
    text = trimmed(i)
    return f"coalesce(regexp_full_match({text}, '-?[0-9]+') AND try_cast({text} AS HUGEINT) BETWEEN {low} AND {high}, false)"


_VALID = f"NOT regexp_full_match(f[1], '[{_WHITE}]*') AND {_number(2, 0, 65535)} AND {_number(3, 0, 65535)} AND {_number(4, -32768, 32767)}"
#: Every line that isn't blank with its fields (unquoted) and the reason for which it doesn't load.
LINES_SQL = f"""l AS (SELECT line_id, dict_name, c0, n_fields, coalesce(flexible_csv, false) AS flexible, coalesce(skip_invalid_cost_or_id, false) AS skip FROM seed_lines LEFT JOIN dictionaries USING (dict_name) WHERE NOT regexp_full_match(c0, '[{_WHITE}]*')),
p AS (SELECT *, regexp_full_match(c0, '{_FIELD}(?:,{_FIELD})*', 's') AS fine, list_transform(regexp_extract_all(c0 || ',', '{_FIELD},', 0, 's'), lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:-3], '""', '"') ELSE x[:-2] END) AS f FROM l),
q AS (SELECT *, CASE WHEN NOT fine THEN 'quoting' WHEN (flexible AND len(f) < 5) OR (NOT flexible AND len(f) IS DISTINCT FROM n_fields) THEN 'columns' WHEN NOT ({_VALID}) THEN CASE WHEN skip THEN 'skipped' ELSE 'value' END END AS reason FROM p)"""


def _codes(chars: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in chars)


def _packed_sql() -> str:
    sep, blank = _codes(packed.separators()), _codes(packed.blanks())
    double, single = '"(?:[^"]|"")*"', "''(?:[^'']|'''')*''"
    return f"""WITH r AS (SELECT 'token_views' AS tbl, row_id, details AS p FROM token_views WHERE details IS NOT NULL UNION ALL SELECT 'corpus_words', row_id, feature FROM corpus_words WHERE feature IS NOT NULL),
m AS (SELECT tbl, row_id, regexp_extract_all(p || ',', '[{blank}]*(?:{double}|{single})[{blank}]*[{sep}]|[^{sep}]*[{sep}]', 0, 's') AS l FROM r),
u AS (SELECT tbl, row_id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS pos FROM m),
t AS (SELECT tbl, row_id, pos, regexp_replace(x[:-2], '^[{blank}]+|[{blank}]+$', '', 'g') AS t FROM u),
v AS (SELECT tbl, row_id, pos::INT AS pos, CASE WHEN length(t) > 1 AND regexp_full_match(t, '{double}', 's') THEN replace(t[2:-2], '""', '"') WHEN length(t) > 1 AND regexp_full_match(t, '{single}', 's') THEN replace(t[2:-2], '''''', '''') ELSE t END AS val FROM t)
SELECT * FROM v WHERE val <> ''"""


ORACLES: dict[str, str] = {
    "p4_found": f"WITH {LINES_SQL} SELECT line_id, reason FROM q WHERE reason IS NOT NULL",
    "p4_loaded": f"WITH {LINES_SQL} SELECT line_id, dict_name, trim(f[1], ' ') AS surface, {trimmed(2)}::INT AS left_id, {trimmed(3)}::INT AS right_id, {trimmed(4)}::INT AS cost, len(f)::INT AS n_fields FROM q WHERE reason IS NULL",
    "p4_sources": f"WITH {LINES_SQL} SELECT source_file, line_id AS line, trim(f[1], ' ') AS surface, {trimmed(2)}::INT AS left_id, {trimmed(3)}::INT AS right_id, {trimmed(4)}::INT AS cost, len(f)::INT AS n_fields FROM q JOIN seed_lines USING (line_id) WHERE regexp_full_match(q.c0, '{_CLEAR}(?:,{_CLEAR})*', 's') AND len(f) >= 5 AND {_VALID}",
    "p5_found": _packed_sql(),
    "p5_guided": f"WITH v AS (SELECT word_id, unnest(details) AS val, generate_subscripts(details, 1) - 1 AS pos FROM lexicon WHERE len(list_filter(details, lambda v: regexp_full_match(v, '[{_codes(packed.separators())}]+'))) = 0) SELECT word_id, pos::INT AS pos, val FROM v WHERE val <> ''",
}
