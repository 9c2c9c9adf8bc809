"""Rows that fail to parse: an error-recovering recursive-descent grammar for delimited records.

    source  = record { newline record }
    record  = field { "," field }
    field   = quoted | plain
    quoted  = '"' { any | '""' } '"'      which a comma or the record's end must follow
    plain   = { any but "," }             quotes inside are text

In a source of several lines a quoted field may run over line ends, but not over a record-start anchor: a line that parses by
itself, has no stray quote and whose structural fields (surface, two ids, cost) are valid begins a record, whatever stands
open before it.
After a broken quote parsing resumes at the next anchor. So a source falls into anchored lines, which parse one by one, and
the gaps between them, and a source of any length is parsed by many tasks. Where every row is known to be one record,
the rows' starts are the anchors.
"""

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kugiri.plans.names import columns, free
from kugiri.plans.rank import with_rank
from kugiri.plans.skew import join_table

NUMBER = re.compile(r"-?[0-9]+", re.ASCII)
#: Fields that every record must have: surface, left id, right id, cost and one detail.
LEAST_FIELDS = 5
#: A line whose quotes all belong to quoted fields; one that closes a field of the line before has others.
CLEAR = re.compile(r'(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*')
LINE = re.compile(r"([^\r\n]*)(\r\n|\r|\n|$)")


class BrokenQuote(Exception):
    def __init__(self, at: int):
        self.at = at


class Record(NamedTuple):
    start: int
    fields: list[str] | None
    error_at: int | None


def _quoted(text: str, at: int, multiline: bool) -> tuple[str, int]:
    """The field that opens with the quote at `at`, and where it ends. Raises BrokenQuote."""
    parts, i, n = [], at + 1, len(text)
    while True:
        j = text.find('"', i)
        if j < 0:
            raise BrokenQuote(at)
        parts.append(text[i:j])
        if j + 1 == n or text[j + 1] == "," or multiline and text[j + 1] in "\r\n":
            return "".join(parts), j + 1
        if text[j + 1] != '"':
            raise BrokenQuote(j)
        parts.append('"')
        i = j + 2


def _plain(text: str, at: int, end: int) -> tuple[str, int]:
    j = text.find(",", at, end)
    j = end if j < 0 else j
    return text[at:j], j


def _line_end(text: str, at: int) -> int:
    ends = [j for j in (text.find("\n", at), text.find("\r", at)) if j >= 0]
    return min(ends, default=len(text))


def _record(text: str, at: int, multiline: bool) -> tuple[list[str], int]:
    fields = []
    while True:
        if text.startswith('"', at):
            value, at = _quoted(text, at, multiline)
        else:
            value, at = _plain(text, at, _line_end(text, at) if multiline else len(text))
        fields.append(value)
        if not text.startswith(",", at):
            return fields, at
        at += 1


def parse_line(line: str) -> Record:
    """The one record of a line; everything up to the line's end belongs to it."""
    if '"' not in line:
        return Record(0, line.split(","), None)
    try:
        return Record(0, _record(line, 0, False)[0], None)
    except BrokenQuote as e:
        return Record(0, None, e.at)


def structural(fields: list[str]) -> tuple[int, int, int] | None:
    """Left id, right id and cost of a record whose surface is not blank; None when one of the four is bad."""
    if not fields[0].strip():
        return None
    out = []
    for value, low, high in zip(fields[1:4], (0, 0, -32768), (65535, 65535, 32767)):
        value = value.strip()
        # 20 digits hold every number in range unless it is padded with zeros
        if not NUMBER.fullmatch(value) or len(value) > 20 and len(value.lstrip("-0")) > 5 or not low <= int(value) <= high:
            return None
        out.append(int(value))
    return tuple(out) if len(out) == 3 else None


def anchored(line: str) -> list[str] | None:
    """The fields of a line that is a record-start anchor, else None."""
    if '"' in line and not CLEAR.fullmatch(line):
        return None
    fields = parse_line(line).fields
    return fields if fields and len(fields) >= LEAST_FIELDS and structural(fields) else None


def _gap(text: str) -> Iterator[Record]:
    """The records of a text without anchors; behind a broken quote nothing can be told until the next anchor."""
    at = 0
    while at < len(text):
        if text[at] in "\r\n":
            at += 1
            continue
        start = at
        try:
            fields, at = _record(text, at, True)
        except BrokenQuote as e:
            yield Record(start, None, e.at)
            return
        if any(f.strip() for f in fields) or len(fields) > 1:
            yield Record(start, fields, None)


def parse_source(text: str) -> Iterator[Record]:
    """All records of a source; a Record without fields is a syntax error, with its position. Blank lines are left out."""
    gap = at = 0
    for m in LINE.finditer(text):
        if (fields := anchored(m[1])) is not None:
            yield from (Record(gap + r.start, r.fields, None if r.error_at is None else gap + r.error_at) for r in _gap(text[gap : m.start()]))
            yield Record(m.start(), fields, None)
            gap = m.end()
        at = m.end()
    yield from (Record(gap + r.start, r.fields, None if r.error_at is None else gap + r.error_at) for r in _gap(text[gap:at]))


def reason_of(record: Record, n_fields: int | None, flexible: bool, skip: bool) -> tuple[str | None, tuple | None]:
    """The first reason that keeps the record out, else its three numbers."""
    if record.fields is None:
        return "quoting", None
    n = len(record.fields)
    if n < LEAST_FIELDS if flexible else n != n_fields:
        return "columns", None
    numbers = structural(record.fields)
    if numbers is None:
        return "skipped" if skip else "value", None
    return None, numbers


PARSED = pa.struct([("fields", pa.list_(pa.string())), ("left_id", pa.int32()), ("right_id", pa.int32()), ("cost", pa.int32()), ("reason", pa.string()), ("error_at", pa.int32())])
PARSED_DDL = "fields array<string>, left_id int, right_id int, cost int, reason string, error_at int"


def parse_rows(rows: list[str | None]) -> Iterator[Record | None]:
    """The record of each row of a source whose anchors are the rows' starts; None for a NULL or blank row.

    Behind a broken quote parsing resumes at the next row.
    """
    for row in rows:
        yield None if row is None or not row.strip() else parse_line(row)


def _parse_batch(lines: pa.Array, n_fields: pa.Array, flexible: pa.Array, skip: pa.Array) -> pa.Array:
    out = []
    for record, n, flex, sk in zip(parse_rows(lines.to_pylist()), n_fields.to_pylist(), flexible.to_pylist(), skip.to_pylist()):
        if record is None:
            out.append(None)
            continue
        reason, numbers = reason_of(record, n, bool(flex), bool(sk))
        left, right, cost = numbers or (None, None, None)
        out.append({"fields": None if reason else record.fields, "left_id": left, "right_id": right, "cost": cost, "reason": reason, "error_at": record.error_at})
    return pa.array(out, PARSED)


def parse_column(line: Column, n_fields: Column, flexible: Column, skip: Column) -> Column:
    """A struct (fields, left_id, right_id, cost, reason, error_at) for each line.

    NULL for a NULL or blank line. reason is NULL when the line loads; otherwise quoting, columns, value or skipped, and
    fields is NULL. error_at is the character at which quoting broke. A NULL flag counts as false; a NULL n_fields (line
    of an unknown dictionary) lets no line of a rigid dictionary load. White space of any kind around a value is ignored.
    """

    # annotated by objects, as the function is sent to the executors by value
    def parsed(lines: pa.Array, n: pa.Array, flex: pa.Array, sk: pa.Array) -> pa.Array:
        return _parse_batch(lines, n, flex, sk)

    return F.arrow_udf(parsed, PARSED_DDL)(line, n_fields.cast("int"), flexible.cast("boolean"), skip.cast("boolean"))


def parse_lines(lines: DataFrame, dictionaries: DataFrame, line: str = "c0", into: str = "parsed") -> DataFrame:
    """lines (with dict_name and the raw line) with one added column `into`; see parse_column.

    Every row of lines comes out once, other columns untouched. Where lines has a column named `into`, an underscore is put
    behind the new one's name.
    dictionaries has one row per dictionary, so it is broadcast when that is small enough, see plans.skew.
    """
    rules = dictionaries.select("dict_name", F.struct("n_fields", "flexible_csv", "skip_invalid_cost_or_id").alias("__rule")).dropDuplicates(["dict_name"])
    joined = join_table(lines, rules, ["dict_name"], "left")
    rule = F.col("__rule")
    return joined.select(*columns(lines), parse_column(F.col(f"`{line}`"), rule["n_fields"], rule["flexible_csv"], rule["skip_invalid_cost_or_id"]).alias(free(lines, into)))


def source_lines(sources: DataFrame, text: str) -> DataFrame:
    """The lines of whole sources: the other columns, line (from 0) and value. A NULL source has none."""
    rest = columns(sources, (text,))
    name = lambda n: free(sources, n, (text,))
    return sources.select(*rest, F.posexplode(F.split(F.col(f"`{text}`"), "\\r\\n|\\r|\\n")).alias(name("line"), name("value")))


_RECORD = pa.struct([("line", pa.int64()), ("fields", pa.list_(pa.string())), ("left_id", pa.int32()), ("right_id", pa.int32()), ("cost", pa.int32()), ("error_line", pa.int64()), ("error_at", pa.int32())])
_RECORD_DDL = "line:bigint, fields:array<string>, left_id:int, right_id:int, cost:int, error_line:bigint, error_at:int"


def _typed(line: int, fields: list[str] | None, error_line: int | None = None, error_at: int | None = None) -> dict:
    left, right, cost = fields and len(fields) >= LEAST_FIELDS and structural(fields) or (None, None, None)
    return {"line": line, "fields": fields, "left_id": left, "right_id": right, "cost": cost, "error_line": error_line, "error_at": error_at}


def _gap_records(numbers: list[int], lines: list[str]) -> list[dict]:
    """The records of consecutive lines without anchors; numbers are those of the lines."""
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    place = lambda at: (k := bisect_right(starts, at) - 1, numbers[k], at - starts[k])[1:]
    return [_typed(place(r.start)[0], r.fields, *((None, None) if r.error_at is None else place(r.error_at))) for r in _gap("\n".join(lines))]


def source_records(lines: DataFrame, source: str, line: str, value: str) -> DataFrame:
    """The records of sources given as lines (source, number of the line, its text): typed records and located syntax errors.

    One row per record: source, line (the one it starts in), fields, left_id, right_id and cost (NULL where they aren't
    valid), anchored (whether an anchor begins it), error_line and error_at (character in that line) where a quote broke; then there are no fields. The numbers
    of a source's lines are distinct whole numbers in their order. A NULL or blank line has no record. Anchored lines are parsed
    where they are; only the lines between are brought together, gap by gap, by their places in the sorted order, so a source
    may hold any share of all lines. A gap is parsed by one task.
    """
    c = lambda n: F.col(f"`{n}`")

    def parsed(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            fields = None if t is None else anchored(t)
            out.append(None if fields is None else {k: v for k, v in _typed(0, fields).items() if k in ("fields", "left_id", "right_id", "cost")})
        return pa.array(out, pa.struct([f for f in _RECORD if f.name in ("fields", "left_id", "right_id", "cost")]))

    rows = lines.select(c(source).alias("s"), c(line).cast("long").alias("n"), F.coalesce(c(value), F.lit("")).alias("v"))
    placed = with_rank(rows.withColumn("a", F.arrow_udf(parsed, "struct<fields:array<string>, left_id:int, right_id:int, cost:int>")("v")), ["s", "n"], "g")
    whole = placed.where("a IS NOT NULL").select("s", F.col("n").alias("line"), "a.*", F.lit(None).cast("long").alias("error_line"), F.lit(None).cast("int").alias("error_at"), F.lit(True).alias("anchored"))
    # lines of one gap follow each other both among all lines and among the loose ones
    loose = with_rank(placed.where("a IS NULL").select("s", "n", "v", "g"), ["g"], "h")
    gaps = loose.groupBy("s", (F.col("g") - F.col("h")).alias("gap")).agg(F.sort_array(F.collect_list(F.struct("n", "v"))).alias("own"))

    def between(own: pa.Array) -> pa.Array:
        return pa.array([_gap_records([x["n"] for x in g], [x["v"] for x in g]) for g in own.to_pylist()], pa.list_(_RECORD))

    rest = gaps.select("s", F.explode(F.arrow_udf(between, f"array<struct<{_RECORD_DDL}>>")("own")).alias("r")).select("s", "r.*", F.lit(False).alias("anchored"))
    return whole.unionByName(rest).withColumnRenamed("s", source)


def rejected(parsed: DataFrame, into: str = "parsed") -> DataFrame:
    """The rows that don't load; into.reason says why."""
    return parsed.where(F.col(into)["reason"].isNotNull())


def loaded(parsed: DataFrame, into: str = "parsed") -> DataFrame:
    """The rows that load. NULL and blank lines are neither loaded nor rejected."""
    return parsed.where(F.col(into).isNotNull() & F.col(into)["reason"].isNull())
