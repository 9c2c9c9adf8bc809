import io
import json

import pytest
from pyspark.sql import functions as F

import kugiri.__main__ as cli
from kugiri.functions import formats, sql
from kugiri.model import STRUCTURAL, TOKEN_DDL, AnalysisError, ErrorKind, Schema
from kugiri.operators import entries
from kugiri.plans.analyzer import Segmenter, Tokenizer, TokenizerBuilder, parse_filter_flag, read_config
from kugiri.plans.rank import with_rank
from kugiri.plans.skew import join_by_key
from kugiri.sources.bundled import bundled
from kugiri.sources.text import annotated_corpus, annotated_sentences, text_lines
from kugiri.streaming.tokens import token_stream, windowed_counts
from kugiri.functions.tokenfilters import token_filter
from small import CHAR_DEF, RECORDS, UNK_DEF, dictionary, matrix, metadata

TEXTS = ["東京都にいる", "The lever of １２ cams", "", None, "  ", "すもももももももものうち", "a\nb\tc。d", "東京 " * 3000]


def rows_of(tokens):
    return None if tokens is None else [tuple(t[:8]) + (list(t.details),) for t in tokens]


@pytest.mark.parametrize("filters", [[], [("lowercase", {}), ("stop_words", {"words": ["the"]})], [("japanese_number", {}), ("length", {"min": 2}), ("uppercase", {})], [("japanese_base_form", {}), ("japanese_keep_tags", {"tags": ["名詞"]})], [("japanese_reading_form", {}), ("japanese_kana", {"kind": "hiragana"}), ("japanese_katakana_stem", {"min": 2})], [("korean_stop_tags", {"tags": ["助詞"]}), ("keep_words", {"words": []})]])
def test_columns_equal_rows(spark, filters):
    chain = Tokenizer(Segmenter(dictionary()), [], [token_filter(*f) for f in filters])
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string").repartition(3)
    got = {r.id: rows_of(r.tokens) for r in df.select("id", chain.tokens(spark, "text").alias("tokens")).collect()}
    plain = {r.id: r.s for r in df.select("id", chain.surfaces(spark, "text").alias("s")).collect()}
    for i, t in enumerate(TEXTS):
        own = None if t is None else [x.row() for x in chain.tokenize(t)]
        assert got[i] == own and plain[i] == (None if own is None else [r[0] for r in own])


def test_nbest_column(spark):
    chain = Tokenizer(Segmenter(dictionary()))
    df = spark.createDataFrame([("東京都に",), (None,), ("",)], "text string")
    first, null, empty = [r.c for r in df.select(chain.nbest(spark, "text", 3).alias("c")).collect()]
    assert [(c["rank"], c.cost, [t.surface for t in c.tokens]) for c in first] == [(k, c, [t.surface for t in own]) for k, (own, c) in enumerate(chain.tokenize_nbest("東京都に", 3), 1)]
    assert null is None and empty == []


def test_rows_with_clashing_names_and_empty_tables(spark):
    chain = Tokenizer(Segmenter(dictionary()))
    df = spark.createDataFrame([(1, "x", "東京都")], "id int, surface string, text string")
    out = chain.tokenize_rows(df, "text")
    assert out.columns == ["id", "surface", "token"] and [r.token.surface for r in out.collect()] == ["東京", "都"]
    assert chain.tokenize_rows(df.limit(0), "text").count() == 0
    many = spark.createDataFrame([(i, f"k{i}", None if i % 7 == 0 else "" if i % 5 == 0 else TEXTS[i % 2] * (1 + i % 3), [i]) for i in range(60)], "id int, k string, text string, a array<int>").repartition(3)
    flat, nested = chain.tokenize_rows(many.drop("a"), "text"), chain.tokenize_rows(many, "text").drop("a")
    assert flat.columns == nested.columns and sorted(map(tuple, flat.collect())) == sorted(map(tuple, nested.collect())) and flat.count() > 60
    words = {(r.lex_type, r.word_id): r.details for r in dictionary().details_table(spark).collect()}
    bare = chain.tokenize_rows(many.drop("a"), "text", details=False).collect()
    assert all(r.details is None for r in bare) and [words[r.lex_type, r.word_id] for r in sorted(bare, key=lambda r: (r.id, r.position))] == [r.details for r in sorted(flat.collect(), key=lambda r: (r.id, r.position))]
    assert chain.tokenize_rows(df.drop("surface"), "text").columns[:2] == ["id", "surface"]


def test_trailing_filters_stay_in_the_jvm(spark):
    chain = Tokenizer(Segmenter(dictionary()), [], [token_filter("mapping", {"mapping": {"a": "b"}}), token_filter("lowercase"), token_filter("stop_words", {"words": []})])
    inner, columns = chain._split()
    assert len(inner.token_filters) == 1 and len(columns) == 1


def test_formats(spark):
    chain = Tokenizer(Segmenter(dictionary()))
    own = chain.tokenize("東京都に")
    assert formats.mecab(own) == "東京\t名詞,トウキョウ,東京\n都\t接尾,ト,都\nに\t助詞,ニ,に\nEOS\n"
    assert formats.wakati(own) == "東京 都 に\n" and formats.wakati([]) == "" and formats.mecab([]) == "EOS\n"
    assert json.loads(formats.to_json(own))[0] == {"surface": "東京", "byte_start": 0, "byte_end": 6, "word_id": own[0].word_id, "part_of_speech": "名詞", "reading": "トウキョウ", "base_form": "東京"}
    df = spark.createDataFrame([("東京都に",), ("",), (None,), ('a "b"\\',)], "text string").select(chain.tokens(spark, "text").alias("t"))
    r = df.select(formats.mecab_column(F.col("t")).alias("m"), formats.wakati_column(F.col("t")).alias("w"), formats.json_column(F.col("t"), dictionary().schema).alias("j")).collect()
    assert [r[0].m, r[0].w, json.loads(r[0].j)] == [formats.mecab(own), formats.wakati(own), [t.as_value() for t in own]]
    assert [r[1].m, r[1].w, r[1].j] == ["EOS\n", "", "[]"] and r[2].m is None and r[2].w is None
    assert json.loads(r[3].j) == [t.as_value() for t in chain.tokenize('a "b"\\')]
    assert formats.nbest_header(2, -5) == "NBEST 2 (cost=-5)\n"


def test_sql(spark):
    sql.register(spark, Tokenizer(Segmenter(dictionary())), "small_")
    spark.createDataFrame([(1, "東京都"), (2, None)], "id int, text string").createOrReplaceTempView("texts")
    assert [r.s for r in spark.sql("SELECT small_tokenize_surfaces(text) s FROM texts ORDER BY id").collect()] == [["東京", "都"], None]
    assert [tuple(r) for r in spark.sql("SELECT id, t.surface, t.details[0] FROM texts, LATERAL small_tokens(text) t").collect()] == [(1, "東京", "名詞"), (1, "都", "接尾")]
    assert spark.sql("SELECT size(small_tokenize(text)) n FROM texts WHERE id = 1").first().n == 2


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    chain = Tokenizer(Segmenter(bundled("scripts")))
    rows = [("2024-01-01 00:10:00", "a b a"), ("2024-01-01 01:10:00", "b"), ("2024-01-01 00:20:00", "a")]
    batch = spark.createDataFrame(rows, "ts string, text string").select(F.col("ts").cast("timestamp").alias("ts"), "text")
    batch.coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in" / "*"))

    def run(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
        return spark.table(name)

    counts = {(str(r.window.start), r.surface): r.n for r in run(windowed_counts(stream, chain, "text", "ts"), "counts", "complete").collect()}
    assert counts == {("2024-01-01 00:00:00", "a"): 3, ("2024-01-01 00:00:00", "b"): 1, ("2024-01-01 01:00:00", "b"): 1}
    still = {(str(r.window.start), r.surface): r.n for r in windowed_counts(batch, chain, "text", "ts").collect()}
    assert still == counts
    assert run(token_stream(stream, chain, "text"), "tokens", "append").count() == 5


def test_configuration(tmp_path):
    f = tmp_path / "c.yml"
    f.write_text("segmenter:\n  dictionary: embedded://scripts\n  max_grouping_len: 0\ncharacter_filters:\n  - kind: unicode_normalize\n    args: {kind: nfkc}\n  - args: {}\n  - kind: 3\ntoken_filters:\n  - kind: lowercase\n", "utf-8")
    t = TokenizerBuilder.from_file(f).build()
    assert [x.surface for x in t.tokenize("ＡＢ c")] == ["ab", "c"] and len(t.character_filters) == 1
    f.write_text("just text", "utf-8")

    def kind(call):
        with pytest.raises(AnalysisError) as e:
            call()
        return e.value.kind

    assert kind(lambda: read_config(f)) == ErrorKind.DESERIALIZE and kind(lambda: read_config(tmp_path / "x")) == ErrorKind.IO
    assert kind(lambda: Tokenizer.from_config({})) == ErrorKind.DESERIALIZE and kind(lambda: TokenizerBuilder().build()) == ErrorKind.PARSE
    assert kind(lambda: TokenizerBuilder().set_dictionary("embedded://scripts").set_mode("x").build()) == ErrorKind.PARSE
    assert kind(lambda: TokenizerBuilder().set_dictionary("embedded://scripts").append_token_filter("x").build()) == ErrorKind.DESERIALIZE
    assert parse_filter_flag('length:{"min": 2}') == ("length", {"min": 2}) and kind(lambda: parse_filter_flag("lowercase")) == ErrorKind.CONTENT
    from kugiri.sources.dictionary import Dictionary

    Dictionary.build(metadata(), CHAR_DEF.replace("SPACE 0 1 0\n", "").replace("0x0020 SPACE\n", ""), UNK_DEF.replace("SPACE", "OTHER"), matrix(), RECORDS).save(tmp_path / "d")
    assert kind(lambda: TokenizerBuilder().set_dictionary(str(tmp_path / "d")).build()) == ErrorKind.PARSE
    assert TokenizerBuilder().set_dictionary(str(tmp_path / "d")).set_keep_whitespace(True).set_use_mmap(True).build().tokenize_surfaces("東京 都")[0] == "東京"


def test_command_line(tmp_path):
    def run(*args):
        out = io.StringIO()
        return cli.main(list(args), out), out.getvalue()

    src = tmp_path / "src"
    dictionary().export(src)
    (src / "metadata.json").rename(tmp_path / "m.json")
    assert run("build", "--metadata", str(tmp_path / "m.json"), "--source", str(src), "--target", str(tmp_path / "d"), "--remap-ids")[0] == 0
    (tmp_path / "t.txt").write_text("  東京都に \n\n", "utf-8")
    assert run("tokenize", "-d", str(tmp_path / "d"), "-o", "wakati", str(tmp_path / "t.txt")) == (0, "東京 都 に\n")
    code, text = run("tokenize", "-d", str(tmp_path / "d"), "-N", "2", str(tmp_path / "t.txt"))
    assert code == 0 and text.startswith("NBEST 1 (cost=") and "NBEST 2 (cost=" in text
    assert run("tokenize", "-d", str(tmp_path / "none"), str(tmp_path / "t.txt"))[0] == 1
    assert "scripts\tyes\tno\t-" in run("list")[1]
    (tmp_path / "u.csv").write_text("東京都,固有,トウキョウト\n", "utf-8")
    assert run("build", "--metadata", str(tmp_path / "m.json"), "--source", str(tmp_path / "u.csv"), "--target", str(tmp_path / "u.parquet"), "--user")[0] == 0
    assert run("tokenize", "-d", str(tmp_path / "d"), "-u", str(tmp_path / "u.parquet"), "-o", "wakati", str(tmp_path / "t.txt"))[1] == "東京都 に\n"


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" x y \t\n\nz\n", "utf-8")
    assert [r.text for r in text_lines(spark, str(tmp_path / "a.txt")).collect()] == ["x y", "", "z"]
    text = "外国\t名詞\nbad\n人\t接尾\nEOS\n\nこれ\t代名詞"
    assert annotated_sentences(text) == [[("外国", "名詞"), ("人", "接尾")], [("これ", "代名詞")]]
    (tmp_path / "c.txt").write_text(text, "utf-8")
    assert [[tuple(t) for t in r.tokens] for r in annotated_corpus(spark, str(tmp_path / "c.txt")).orderBy("sentence").collect()] == annotated_sentences(text)


def test_lexicon_joins(spark):
    lex = spark.createDataFrame([("d", "東京", 1), ("d", "東", 2), ("e", "東京都", 3), ("d", "", 4)], "dict_name string, surface string, word_id long")
    seen = spark.createDataFrame([("d", "東京都"), ("e", "東京都"), ("d", ""), ("d", None), (None, "東")], "dict_name string, surface string")
    got = {(r.dict_name, r.surface, r.word_id, r.end_char, r.end_byte) for r in entries.prefix_matches(seen, lex, ["dict_name"]).collect()}
    assert got == {("d", "東京都", 1, 2, 6), ("d", "東京都", 2, 1, 3), ("e", "東京都", 3, 3, 9)}
    assert entries.prefix_matches(seen, lex.limit(0), ["dict_name"]).count() == 0
    chars = spark.createDataFrame([("A",), ("東",), ("\U00020000",), ("",)], "c string")
    assert {r.c: r.categories for r in entries.with_categories(chars, "c", bundled("scripts").categories).collect()} == {"A": ["ALPHA"], "東": ["KANJI"], "\U00020000": ["DEFAULT"]}
    long = "é" * 20000 + "\nx"
    got = [(r.place, len(r.sentence)) for r in entries.sentence_rows(spark.createDataFrame([(1, long), (2, None), (3, "")], "id int, text string"), "text").collect()]
    assert got == [(0, 16384), (1, 3617), (2, 1)]


def test_ranks_and_skewed_joins(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("y")).repartition(5)
    assert sorted((r.k, r["rank"]) for r in with_rank(df, ["k"], "rank").collect()) == [(i, i) for i in range(1000)]
    assert with_rank(df.limit(0), ["k"], "rank").count() == 0
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("k"), "id")
    keyed = rows.groupBy("k").agg(F.count("*").alias("n")).where("k % 2 = 0").select("k", "n", F.lit("v").alias("v"))
    out = join_by_key(rows, keyed, ["k"], "n", 3000)
    assert out.count() == 1000 + sum(1 for i in range(1000, 3000) if i % 2 == 0) and out.where("k = 0").count() == 1000


def test_json_numbers_are_those_of_the_rows(spark):
    """The Column form against the row form, for numbers in all spellings, line breaks of all kinds and blanks."""
    from kugiri.model import number_or_text

    values = ["007", "+5", "-3", "1.5", "1e3", ".5", "5.", "1_000", " 1", "1d", "1f", "NaN", "inf", "1e999", "9" * 25, str(2**63 - 1), str(2**63), "", "*", "a\x85b", "a\u2028b", 'q"\\', "1\n", "0x10", "１"]
    schema = Schema(STRUCTURAL + ("v",))
    df = spark.createDataFrame([(i, [("s", 0, 1, 0, 1, 3, "System", False, [v])]) for i, v in enumerate(values)], f"i int, t array<struct<{TOKEN_DDL.replace(' ', ':').replace(',:', ', ')}>>")
    got = {r.i: json.loads(r.j)[0]["v"] for r in df.select("i", formats.json_column(F.col("t"), schema).alias("j")).collect()}
    assert got == {i: number_or_text(v) for i, v in enumerate(values)} and all(type(got[i]) is type(number_or_text(v)) for i, v in enumerate(values))


def test_a_pattern_gives_the_same_text_in_both_forms(spark):
    from kugiri.functions.charfilters import character_filter
    from kugiri.operators.entries import SAME_PATTERN, filter_column

    texts = ["a\rb", "a\u2028b x", "x\r\n", "x", "abc&[", "12.5 and 7", "aab", "😀a", "", None, "(x)y-z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for pattern in ("a.b", "x$", "^x", "[a-c&&[^b]]", "[0-9]+(?:\\.[0-9]+)?", "[a-c]{2}", "\\s", "a*", "[^a-z]", "y-z", "(?:x)\\)"):
        args = {"pattern": pattern, "replacement": "#$1\\"}
        made = character_filter("regex", args)
        got = {r.i: r.o for r in df.select("i", filter_column("regex", args)(F.col("t")).alias("o")).collect()}
        assert got == {i: None if t is None else made.apply(t)[0] for i, t in enumerate(texts)}, pattern
    assert SAME_PATTERN.fullmatch("[0-9]+(?:\\.[0-9]+)?") and not any(map(SAME_PATTERN.fullmatch, ("a.b", "x$", "[a-c&&[^b]]", "\\s", "a+?")))
