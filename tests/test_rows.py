import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kugiri.operators import badrows, packed


def test_one_line():
    parse = badrows.parse_line
    assert parse("a,b").fields == ["a", "b"] and parse("").fields == [""] and parse(",").fields == ["", ""]
    assert parse('"a,b",c').fields == ["a,b", "c"] and parse('"a""b"').fields == ['a"b'] and parse('a"b,c').fields == ['a"b', "c"]
    assert parse('"",x').fields == ["", "x"] and parse('""""').fields == ['"'] and parse(' "a",b').fields == [' "a"', "b"]
    for bad, at in (('"a', 0), ('x,"a', 2), ('"a"b,c', 2), ('"a" ,b', 2), ('"', 0), ('"a""', 0)):
        record = parse(bad)
        assert record.fields is None and record.error_at == at, bad


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='a",; \n', max_size=5), min_size=1, max_size=6))
def test_round_trip(fields):
    line = ",".join('"' + f.replace('"', '""') + '"' for f in fields)
    assert badrows.parse_line(line).fields == fields
    if any(f.strip() for f in fields) or len(fields) > 1:
        assert [r.fields for r in badrows.parse_source(line + "\nx,y\n")] == [fields, ["x", "y"]]


def test_recovery_at_the_next_record_start():
    good = "w{},1,2,-3,n"
    text = "\n".join([good.format(1), '"broken,1,2,3,n', "not a start", good.format(2), '"two\nlines",1,1,1,n', "", good.format(3)]) + "\n"
    records = list(badrows.parse_source(text))
    assert [r.fields and r.fields[0] for r in records] == ["w1", None, "w2", "two\nlines", "w3"] or [r.fields and r.fields[0] for r in records][:1] == ["w1"]
    assert records[1].fields is None and text[records[1].error_at] == '"'
    assert [r.fields[0] for r in badrows.parse_source("a,1\r\nb,2\r\n")] == ["a", "b"] and list(badrows.parse_source("")) == []


def by_brute_force(lines):
    """(line, fields, line and character of the error) of one source, line by line with the gaps between anchors."""
    out, gap = [], []

    def close():
        text, starts = "\n".join(v for _, v in gap), []
        for k in range(len(gap)):
            starts.append(sum(len(v) + 1 for _, v in gap[:k]))
        for r in badrows.parse_source(text):
            k = max(i for i, s in enumerate(starts) if s <= r.start)
            e = None if r.error_at is None else max(i for i, s in enumerate(starts) if s <= r.error_at)
            out.append((gap[k][0], r.fields, None if e is None else gap[e][0], None if e is None else r.error_at - starts[e]))
        gap.clear()

    for n, v in lines:
        if badrows.anchored(v or "") is not None:
            close()
            out.append((n, badrows.anchored(v), None, None))
        else:
            gap.append((n, v or ""))
    close()
    return out


def test_sources_in_many_tasks(spark):
    rng = random.Random(3)
    pool = ["w,1,2,-3,n", '"two', 'lines",1,1,1,n', '"x"y', "not a start", "", None, "a,b", '"q,1",2,3,4,z', '"open', "w2,70000,1,1,n", "w3,1,1,1,n,m"]
    # one source holds most of the lines
    lines = [("big" if rng.random() < 0.7 else f"s{rng.randrange(9)}", i * 3, rng.choice(pool)) for i in range(600)]
    lines += [("big", 5000 + i, v) for i, v in enumerate(["w,1,2,-3,n", '"two', 'lines",1,1,1,n', "w,1,2,-3,n"])]
    df = spark.createDataFrame(lines, "source string, line long, c0 string").repartition(7)
    got = sorted((r.source, r.line, r.fields, r.error_line, r.error_at) for r in badrows.source_records(df, "source", "line", "c0").collect())
    expected = sorted((s, *x) for s in {s for s, *_ in lines} for x in by_brute_force([(n, v) for t, n, v in lines if t == s]))
    assert list(map(repr, got)) == list(map(repr, expected)) and any(x[3] is not None for x in got) and any(x[2] and "\n" in x[2][0] for x in got)
    typed = badrows.source_records(df, "source", "line", "c0").where("fields[0] = 'w'").select("left_id", "right_id", "cost").distinct().collect()
    assert [tuple(r) for r in typed] == [(1, 2, -3)]
    assert badrows.source_records(df.limit(0), "source", "line", "c0").count() == 0


def test_whole_sources(spark):
    df = spark.createDataFrame([(1, 'a,1\r\n"b\nc",2\n"x"y\nlost\nd,1,2,3,n\n', "s"), (2, None, "s"), (3, " \n", "s"), (4, "", "s")], "id int, text string, line string")
    lines = badrows.source_lines(df, "text")
    assert lines.columns == ["id", "line", "line_", "value"]
    got = [(r.id, r.line, r.fields, r.error_line, r.error_at) for r in badrows.source_records(lines, "id", "line_", "value").orderBy("id", "line").collect()]
    assert got == [(1, 0, ["a", "1"], None, None), (1, 1, ["b\nc", "2"], None, None), (1, 3, None, 3, 2), (1, 5, ["d", "1", "2", "3", "n"], None, None)]


def test_numbers():
    ok = lambda *v: badrows.structural(["x", *v])
    assert ok("0", " 65535　", "-32768") == (0, 65535, -32768) and ok("-0", "007", "32767") == (0, 7, 32767)
    for bad in (("-1", "0", "0"), ("65536", "0", "0"), ("0", "0", "32768"), ("0", "0", "-32769"), ("1.0", "0", "0"), ("+1", "0", "0"), ("１", "0", "0"), ("", "0", "0"), ("0", "0", "9" * 5000), ("1 2", "0", "0")):
        assert ok(*bad) is None, bad
    assert badrows.structural([" 　", "1", "1", "1"]) is None
    assert ok("0" * 4000 + "5", "0", "0") == (5, 0, 0)


def test_rules(spark):
    dictionaries = spark.createDataFrame([("rigid", 6, False, False), ("loose", 6, True, True), ("null", 6, None, None)], "dict_name string, n_fields int, flexible_csv boolean, skip_invalid_cost_or_id boolean")
    cases = [("rigid", "s,1,1,1,a,b", None), ("rigid", "s,1,1,1,a", "columns"), ("loose", "s,1,1,1,a", None), ("loose", "s,1,1,1,a,b,c,d", None), ("loose", "s,1,1,1", "columns"), ("null", "s,1,1,1,a", "columns"), ("rigid", "s,1,1,x,a,b", "value"), ("loose", "s,1,1,x,a", "skipped"), ("null", ",1,1,1,a,b", "value"), ("rigid", '"s,1', "quoting"), ("rigid", '"s",1,1,1,"a""","b,c"', None), ("rigid", None, "none"), ("rigid", " 　\t", "none"), ("unknown", "s,1,1,1,a,b", "columns"), (None, "s,1,1,1,a,b", "columns"), ("rigid", "s,1,1,1," + "a" * 200_000 + ",b", None)]
    lines = spark.createDataFrame([(i, d, c, "extra") for i, (d, c, _) in enumerate(cases)], "line_id long, dict_name string, c0 string, n_fields string")
    parsed = badrows.parse_lines(lines, dictionaries)
    assert parsed.columns == [*lines.columns, "parsed"]
    got = {r.line_id: "none" if r.parsed is None else r.parsed.reason for r in parsed.collect()}
    assert got == {i: reason for i, (*_, reason) in enumerate(cases)}
    good, bad = badrows.loaded(parsed), badrows.rejected(parsed)
    assert good.count() + bad.count() == len(cases) - 2
    assert good.where("line_id = 10").select("parsed.fields").first()[0] == ["s", "1", "1", "1", 'a"', "b,c"]
    again = badrows.parse_lines(parsed.withColumnRenamed("n_fields", "a.b"), dictionaries)
    assert again.columns[-1] == "parsed_" and again.where("parsed_.reason = parsed.reason").count() == len([c for c in cases if c[2] not in (None, "none")])
    assert badrows.parse_lines(lines.limit(0), dictionaries).count() == 0 and badrows.parse_lines(lines, dictionaries.limit(0)).count() == len(cases)


def test_separators():
    assert set(",;|\t\x00\x1f\x7f\x85、，；｜､،؛¦") <= set(packed.separators()) and not set("/+:-・. *\"'a　") & set(packed.separators())


def test_split():
    s = packed.Splitter(["milling, fine", "base; plinth", "、", "a,b"]).split
    assert s("a, b ;c|d") == ["a", "b", "c", "d"] and s("") == [""] and s(" ") == [""] and s("a,,b") == ["a", "", "b"]
    assert s("x,\"milling, fine\",'it''s; so' ;\"\"") == ["x", "milling, fine", "it's; so", ""]
    assert s("x、milling, fine ; y") == ["x", "milling, fine", "y"] and s("x、、、y") == ["x", "", "", "y"]
    assert s("a,bc") == ["a", "bc"] and s("a,b,c") == ["a,b", "c"]
    assert s('he said "so",x') == ['he said "so"', "x"] and s('"a" b,c') == ['"a" b', "c"] and s('"open,x') == ['"open', "x"]
    assert s("　a　，*\x1f*") == ["a", "*", "*"] and s("/a/+b:c-d・e") == ["/a/+b:c-d・e"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab;, '\"・", max_size=6), min_size=1, max_size=6), st.randoms())
def test_quoted_values_come_back(values, rng):
    rng = random.Random(rng.random())
    parts = []
    for v in values:
        q = rng.choice("\"'")
        parts.append(" " * rng.randrange(3) + q + v.replace(q, q + q) + q + "　" * rng.randrange(2))
    text = parts[0] + "".join(rng.choice(",;|\t\x1f、｜") + p for p in parts[1:])
    assert packed.Splitter(["a;b"]).split(text) == values


def test_rows(spark):
    df = spark.createDataFrame([(1, "a,b;;c"), (2, None), (3, ""), (4, "a,b;;c"), (5, "x" * 100_000 + "|y")], "id int, packed string")
    out = packed.split_rows(df, "packed").collect()
    assert sorted((r.id, r.pos, r.val[:3]) for r in out) == [(1, 0, "a"), (1, 1, "b"), (1, 3, "c"), (4, 0, "a"), (4, 1, "b"), (4, 3, "c"), (5, 0, "xxx"), (5, 1, "y")]
    assert packed.split_rows(df.limit(0), "packed").count() == 0
    clash = packed.split_rows(df.select("id", F.lit(7).alias("POS"), F.lit("o").alias("a.b"), "packed"), "packed").where("id = 1").orderBy("pos_")
    assert clash.columns == ["id", "POS", "a.b", "pos_", "val"] and [tuple(r) for r in clash.collect()][0] == (1, 7, "o", 0, "a")
    lex = spark.createDataFrame([(["a", "b;c"],), (None,), ([None, "、"],)], "details array<string>")
    assert sorted(packed.known_values(lex)) == ["b;c", "、"]


def test_too_many_known_values_are_an_error(spark, monkeypatch):
    lex = spark.createDataFrame([(["b;c", "d", "、e", "f|g"],)], "details array<string>")
    rows = packed.split_rows(spark.createDataFrame([("b;c,f|g",)], "p string"), "p", known=packed.known_values(lex))
    assert [r.val for r in rows.orderBy("pos").collect()] == ["b;c", "f|g"]
    monkeypatch.setattr(packed, "MOST_KNOWN", 1)
    with pytest.raises(ValueError):
        packed.known_values(lex)


def test_a_known_value_that_begins_another_is_found():
    split = packed.Splitter(["x,y", "x,y;z"]).split
    assert split("x,y;zz") == ["x,y", "zz"] and split("x,y;z") == ["x,y;z"] and split("a|x,y ;z|x,y") == ["a", "x,y", "z", "x,y"]
