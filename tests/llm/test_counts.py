from collections import Counter, defaultdict

from pyspark.sql import functions as F

from kugiri.llm import dress, termcount


def brute(rows):
    times, records = Counter(), defaultdict(set)
    for v, *r in rows:
        if v is not None:
            times[v] += 1
            records[v].add(tuple(r))
    return {v: (n, len(records[v])) for v, n in times.items()}


def test_counts_equal_brute_force(spark):
    # one value holds a third of the rows, one record another third, many values are rare
    rows = [("hot", "t", i % 40) for i in range(3000)] + [(f"w{i % 700}", "t", 0) for i in range(3000)] + [(f"w{i % 90}", "c", i % 50) for i in range(2900)] + [(None, "c", 1), ("", "t", None), ("", "t", None), (" Hot", "c", 2), ("x" * 100_000, "t", 3)]
    df = spark.createDataFrame(rows, "surface string, tbl string, record long").repartition(5).withColumn("n", F.lit("clash")).withColumn("v", F.lit(1))
    assert "hot" in termcount.heavy_values(df, "surface")
    got = {r.surface: (r.occurrences, r.records) for r in termcount.count_values(df, "surface", ["tbl", "record"]).collect()}
    assert got == brute(rows)
    assert termcount.census(df, "surface", ["tbl", "record"])[1] == len({tuple(r) for _, *r in rows}) and termcount.census(df.limit(0), "surface", ["record"])[1] == 0
    few = df.where("surface <> 'hot'").limit(50)
    assert termcount.count_values(few, "surface", ["tbl", "record"]).agg(F.sum("occurrences")).first()[0] == few.where("surface IS NOT NULL").count()
    assert termcount.count_values(df.limit(0), "surface", ["record"]).count() == 0
    assert termcount.count_values(df.where("surface IS NULL"), "surface", ["record"]).count() == 0


def test_more_heavy_values_than_a_word_has_bits(spark):
    rows = [(f"h{i % 150}", i // 7) for i in range(9000)]
    df = spark.createDataFrame(rows, "s string, r long").repartition(3)
    assert len(termcount.heavy_values(df, "s")) > 2 * termcount.WORD
    assert {r.s: (r.occurrences, r.records) for r in termcount.count_values(df, "s", ["r"]).collect()} == brute(rows)


def test_marks(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 10), ("e", 11)], "surface string, records long")
    assert {r.surface: r["mark"] for r in termcount.mark_values(counts, 100).collect()} == {"a": "rare", "b": "rare", "c": None, "d": None, "e": "common"}


def groups(rows):
    """First id and copies by brute force over sorted content."""
    by = defaultdict(list)
    for scope, i, values in rows:
        by[scope, tuple(sorted(values))].append(i)
    return {(s, min(ids), i) for (s, _), ids in by.items() for i in ids if i != min(ids)}, {(s, min(ids), len(ids)) for (s, _), ids in by.items()}


def test_copies_equal_brute_force(spark):
    rows = [("d", i, ["a", "b"] if i % 2 else ["b", "a"]) for i in range(400)] + [("d", 1000 + i, [f"v{i % 50}", "x"] * (1 + i % 3)) for i in range(600)] + [(None, 5000 + i, ["a", "b"]) for i in range(3)] + [("", 6000, ["a", "b"]), ("", 6001, ["b", "a"]), ("d", 7000, []), ("d", 7001, []), ("d", 7002, ["a", "a", "b"]), ("d", 7003, ["a", "b", "b"])]
    df = spark.createDataFrame(rows, "scope string, id long, content array<string>").repartition(4).withColumn("first_id", F.lit("clash"))
    found, distinct = groups(rows)
    assert {tuple(r) for r in dress.copies(df, "scope", "id", "content").collect()} == found
    assert {tuple(r) for r in dress.collapse(df, "scope", "id", "content").collect()} == distinct
    assert dress.copies(df.limit(0), "scope", "id", "content").count() == 0 and dress.collapse(df.limit(0), "scope", "id", "content").count() == 0


def test_many_repeated_groups_meet_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(dress, "MOST_REPEATED", 3)
    rows = [("d", i, ["hot"] if i % 3 == 0 else [f"v{i % 40}"]) for i in range(900)]
    df = spark.createDataFrame(rows, "scope string, id long, content array<string>").repartition(4)
    assert {tuple(r) for r in dress.copies(df, "scope", "id", "content").collect()} == groups(rows)[0]


def test_fingerprints_that_collide_are_resolved(spark, monkeypatch):
    monkeypatch.setattr(dress, "multiset_hash", lambda values, seed: F.size(values).cast("long"))
    rows = [("d", 1, ["a"]), ("d", 2, ["b"]), ("d", 3, ["b"]), ("d", 4, ["a"]), ("d", 5, ["c"]), ("d", 6, ["c", "b"]), ("d", 7, ["b", "c"])]
    df = spark.createDataFrame(rows, "scope string, id long, content array<string>")
    found, distinct = groups(rows)
    assert {tuple(r) for r in dress.copies(df, "scope", "id", "content").collect()} == found
    assert {tuple(r) for r in dress.collapse(df, "scope", "id", "content").collect()} == distinct


def test_dress(spark):
    df = spark.createDataFrame([(1, "Straße-7", " ", "ΣΟΦΌΣ"), (2, "σοφός", None, "STRASSE 7!"), (3, "*", "", "")], "id int, a string, b string, c string")
    got = {r.id: sorted(r.p) for r in df.select("id", dress.pairs({}, F.array("a", "b", "c")).alias("p")).collect()}
    assert got[1] == got[2] and len(got[1]) == 2 and got[3] == []
    named = {r.id: r.p for r in df.select("id", dress.pairs({"n": F.lit(5), "m": F.lit(None).cast("int")}, F.array("b")).alias("p")).collect()}
    assert named[3][0] == "n\x015"
    texts = {r.id: r.p for r in df.select("id", dress.pairs({}, F.array("b"), {"t": F.col("a"), "u": F.lit("--")}).alias("p")).collect()}
    assert texts[1] == ["t\x04strasse7"] and texts[3] == []
