import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from kugiri.llm import lookalike, mojibake

WORDS = {"ja": ["トートバッグ", "カード", "東京 タワー", "車庫", "Tenzo7", "がぎ"], "la": ["marsorn", "fenhart yedam", "sôrra", "kerme", "mårlen", "zelfênage"], "jis": ["岸辺", "夜道", "ムダリ"]}
DICTS = [("ja", "ja", "UTF-8", True), ("la", "la", "utf8", True), ("jis", "ja", "Shift_JIS", None)]


@pytest.fixture(scope="module")
def tables(spark):
    lex = [(100 * k + i, d, w) for k, (d, own) in enumerate(WORDS.items()) for i, w in enumerate(own)]
    lexicon = spark.createDataFrame(lex, "word_id long, dict_name string, surface string")
    dictionaries = spark.createDataFrame(DICTS, "dict_name string, lang_group string, encoding string, normalize_details boolean")
    return lexicon, dictionaries, {(d, w): i for i, d, w in lex}


def frame(spark, rows):
    return spark.createDataFrame([(i, d, s, "mine", "k") for i, (d, s) in enumerate(rows)], "row_id long, dict_name string, surface string, word_id string, `a.b` string").repartition(3)


def test_lookalikes(spark, tables):
    lexicon, dictionaries, ids = tables
    same = {("ja", "ﾄｰﾄﾊﾞｯｸﾞ"): "トートバッグ", ("ja", "卜ートバッグ"): "トートバッグ", ("ja", "ト─トバッグ"): "トートバッグ", ("ja", "カ​ード"): "カード", ("ja", "力ード"): "カード", ("ja", unicodedata.normalize("NFD", "がぎ")): "がぎ", ("ja", "東京　タワー"): "東京 タワー", ("ja", "東京タワー"): "東京 タワー", ("ja", "⾞庫"): "車庫", ("ja", "Ｔｅnzo７"): "Tenzo7", ("ja", "Τenzο7"): "Tenzo7", ("la", "mаrsorn"): "marsorn", ("la", "fenhart ​yedam"): "fenhart yedam", ("la", "sôrra"): "sôrra", ("la", " kerme﻿"): "kerme", ("la", "kеrme"): "kerme"}
    other = [("la", "Kerme"), ("la", "kermes"), ("ja", "カート"), ("la", "marsorn"), ("jis", "夜​道"), ("la", None), ("la", ""), ("la", "​"), (None, "mаrsorn"), ("none", "mаrsorn"), ("la", "а" * 50_000)]
    rows = list(same) + other + list(same)
    out = lookalike.match_lexicon(frame(spark, rows), lexicon, dictionaries)
    assert out.columns == ["row_id", "dict_name", "surface", "word_id", "a.b", "word_id_", "lexicon_surface", "kind"]
    got = {r.row_id: r.word_id_ for r in out.collect()}
    assert got == {i: ids[rows[i][0], same[rows[i]]] for i in range(len(rows)) if rows[i] in same}
    assert lookalike.match_lexicon(frame(spark, rows).limit(0), lexicon, dictionaries).count() == 0
    assert lookalike.match_lexicon(frame(spark, rows), lexicon.limit(0), dictionaries).count() == 0
    kinds = {r.surface: r.kind for r in out.collect()}
    assert kinds["mаrsorn"] == "mixed" and kinds["ﾄｰﾄﾊﾞｯｸﾞ"] == "single"


def test_scripts(spark):
    n = lookalike.Normalizer(lookalike.confusables(spark))
    assert lookalike.resolved("aс") == frozenset() and "LATIN" in lookalike.resolved("a1-b") and lookalike.resolved("12") is None
    assert lookalike.resolved("東トの") and lookalike.resolved("東한")
    assert n.spell("раураl", {"LATIN"}) == ("paypal", "mixed") and n.spell("хор", {"LATIN"}) == ("xop", "whole") and n.spell("xop", {"LATIN"})[1] == "single"
    assert n.skeleton("ＡＢ") == n.skeleton("АВ") == n.skeleton("A­B")


CHAINS = {"ja": ["cp1252", "latin-1", "cp437", "koi8-r", "mac-roman"], "la": ["cp1252", "mac-roman", "cp437"], "jis": ["latin-1", "cp437", "gb18030"]}


def garble(text, right, wrong, steps=1):
    for _ in range(steps):
        text, right = text.encode(right).decode(wrong), "utf-8"
    return text


def test_garbled_words_come_back(spark, tables):
    lexicon, dictionaries, ids = tables
    cases = {}
    for d, _, label, _ in DICTS:
        for w in WORDS[d]:
            for wrong in CHAINS[d]:
                for steps in (1, 2) if wrong in ("latin-1",) else (1,):
                    try:
                        s = garble(w, mojibake.codec_of(label), wrong, steps)
                    except UnicodeError:
                        continue
                    if s != w:
                        cases[d, s] = ids[d, w]
    lost = [("ja", "車".encode()[:-1].decode("utf-8", "replace") + "庫"), ("la", "m�rlen"), ("jis", "夜�"), ("la", "m��rlen")]
    fine = [("ja", "東京駅"), ("la", "Ångel"), ("la", None), ("la", "abc"), ("ja", ""), (None, "cafÃ©"), ("none", "x�"), ("la", "�" * 3), ("la", "ä" * 20_000), ("ja", "知らない�言葉")]
    rows = list(cases) + lost + fine
    out = mojibake.restore_rows(frame(spark, rows), lexicon, dictionaries)
    got = {rows[r.row_id]: r.word_id_ for r in out.collect()}
    assert len(cases) > 30 and got == cases | dict.fromkeys(lost, -1)
    assert mojibake.restore_rows(frame(spark, rows).limit(0), lexicon, dictionaries).count() == 0
    assert mojibake.restore_rows(frame(spark, rows), lexicon.limit(0), dictionaries).count() == 0


def test_cells_and_samples_of_any_size_give_the_same_rows(spark, tables, monkeypatch):
    lexicon, dictionaries, _ = tables
    rows = [("ja", "車".encode()[:-1].decode("utf-8", "replace") + "庫"), ("la", "m�rlen"), ("jis", "夜�"), ("ja", garble("車庫", "utf-8", "cp437")), ("la", "x�y")] * 20
    collected = lambda: sorted(map(tuple, mojibake.restore_rows(frame(spark, rows), lexicon, dictionaries).select("row_id", "word_id_", "chain").collect()))
    whole = collected()
    assert len(whole) == 80
    monkeypatch.setattr(mojibake, "CELL_WORDS", 1)
    monkeypatch.setattr(mojibake, "CELL_TEXTS", 1)
    monkeypatch.setattr("kugiri.plans.skew.MOST_ROWS", 0)
    assert collected() == whole
    monkeypatch.setattr(mojibake, "DICTIONARY_BYTES", 24)
    samples = mojibake.language_samples(lexicon, {n: (e, g) for n, g, e, _ in DICTS})
    assert set(samples) <= {"ja", "la"} and all(sum(2 * len(w) + 4 for w in own) <= 24 for own in samples.values())


def test_the_shortest_description_wins():
    words = ["岸辺", "夜道", "車庫", "東京"]
    d = mojibake.Describer(words)
    assert mojibake.restore("東京".encode().decode("koi8-r"), "utf-8", d) == ("東京", "koi8-r") and mojibake.restore("ordinary", "utf-8", d) == (None, "")
    assert mojibake.restore(garble("夜道", "utf-8", "latin-1", 3), "utf-8", d)[0] == "夜道"
    assert mojibake.restore("caf\xc3\xa9", "utf-8", mojibake.Describer([]))[0] in ("café", None)
    # a chain costs more than one byte of description, so a word of the language stays as it is
    assert mojibake.chain_bits(("cp1252",)) > 8 and mojibake.restore("東京", "utf-8", d) == (None, "")
    assert [mojibake.codec_of(x) for x in ("UTF-8", "utf8", "Shift_JIS", "EUC-JP", "EUC KR", None, "nothing")] == ["utf-8", "utf-8", "shift_jis", "euc_jp", "euc_kr", "utf-8", "utf-8"]


def test_words_of_which_nothing_is_left():
    own = mojibake.ByteIndex(words := ["車", "東京", "夜a"], "utf-8")
    lost = lambda text: own.lost(text, mojibake.Describer(words))
    assert lost("車".encode().decode("ascii", "replace"))[1] == "ascii" and lost("\ufffd" * 6)
    assert not lost("\ufffd" * 4) and not lost("\ufffd" * 9)


def test_the_byte_index_equals_the_pattern():
    """Against a regular expression over all words, for random parts; words of over WIDTH bytes too."""
    import re

    rng = random.Random(5)
    words = ["".join(rng.choice("abcあい車") for _ in range(rng.randint(1, 9))) for _ in range(300)] + ["長い" * 20 + x for x in "abc"]
    index = mojibake.ByteIndex(words, "utf-8")
    raw = [w.encode() for w in words]

    def fits(parts):
        gap = rb".{1,3}"
        ways = [gap.join(map(re.escape, parts))]
        for i, p in enumerate(parts):
            ways += [gap.join([*map(re.escape, parts[:i]), re.escape(p[:j]) + gap + re.escape(p[j:]), *map(re.escape, parts[i + 1 :])]) for j in range(len(p) + 1)]
        pattern = re.compile(b"|".join(b"(?:" + w + b")" for w in ways), re.S)
        return {w for w, b in zip(words, raw) if pattern.fullmatch(b)}

    hits = 0
    for _ in range(1500):
        b, parts, at = rng.choice(raw), [], 0
        while at <= len(b) and len(parts) < 4:
            n = rng.randint(0, 6) if rng.random() < 0.9 else len(b)
            parts.append(b[at : at + n])
            at += n + rng.randint(1, 5)
        if any(parts):
            expected, got = fits(parts), index.fitting(parts)
            assert got in expected if expected else got is None
            hits += bool(expected)
    assert hits > 300


def test_bounds_are_errors(spark, monkeypatch, tmp_path):
    from kugiri.llm import queries

    monkeypatch.setattr(queries, "MOST_COMMON", 1)
    spark.createDataFrame([("a",), ("b",)], "word string").write.parquet(str(tmp_path / "common_words.parquet"))
    with pytest.raises(ValueError):
        queries.p9_stats(spark, str(tmp_path))
    monkeypatch.setattr(mojibake, "MOST_DICTIONARIES", 1)
    lexicon = spark.createDataFrame([(1, "a", "x")], "word_id long, dict_name string, surface string")
    with pytest.raises(ValueError):
        mojibake.restore_rows(lexicon, lexicon, spark.createDataFrame([("a", "utf-8", "la"), ("b", "utf-8", "la")], "dict_name string, encoding string, lang_group string"))
