import numpy as np
import pytest

from kugiri.model import AnalysisError, ErrorKind, Metadata, PRESETS, Schema, number_or_text
from kugiri.plans.analyzer import Segmenter
from kugiri.sources.definitions import Categories, parse_matrix, parse_unknown
from kugiri.sources.dictionary import Dictionary, UserDictionary, context_frequencies, group_entries, load_dictionary, read_records, registry, scan_lexicon
from small import CHAR_DEF, RECORDS, UNK_DEF, dictionary, matrix, metadata


def kind(call) -> ErrorKind:
    with pytest.raises(AnalysisError) as e:
        call()
    return e.value.kind


def test_char_def():
    c = Categories("DEFAULT 0 1 0\nA 1 1 0\nB 1 0 3\n0x41..0x5A A B # both\n0x50 B\n")
    assert [c.names[k] for k in c.of("A")] == ["A", "B"] and c.of("é") == (0,) and c.of("\U00020000") == (0,)
    assert c.invoke == [False, True, True] and c.group == [True, True, False] and c.length == [0, 0, 3]
    assert kind(lambda: Categories("DEFAULT 0 1 0\n0x41 X\n")) == ErrorKind.CONTENT
    assert kind(lambda: Categories("DEFAULT 0 1 0\n0x12345 DEFAULT\n")) == ErrorKind.PARSE
    assert kind(lambda: Categories("A 0 1 0\n")) == ErrorKind.CONTENT


def test_unk_def_and_matrix_def():
    assert parse_unknown("DEFAULT,1,2,-3,a,b\n\n") == [("DEFAULT", 1, 2, -3, ["a", "b"])]
    assert kind(lambda: parse_unknown("DEFAULT,1,2\n")) == ErrorKind.CONTENT
    m = parse_matrix("3 2\n0 0 5\n\n2 1 7\n2 1 8\n1 0 40000\n")
    assert m.shape == (2, 3) and m[0, 0] == 5 and m[1, 2] == 8 and m[1, 0] == 32767 and m[0, 1] == 40000 - 65536
    assert kind(lambda: parse_matrix("1 1\n1 0 3\n")) == ErrorKind.CONTENT
    assert kind(lambda: parse_matrix("1 1\n0 x 3\n")) == ErrorKind.PARSE
    assert kind(lambda: parse_matrix("")) == ErrorKind.CONTENT


def test_build_sorts_skips_and_normalizes():
    rows = [["b", "0", "0", "1", "x"], ["a～", "0", "0", "2", "y―"], ["", "0", "0", "3", "z"], ["c", "0", "0", "", "w"]]
    d = Dictionary.build(metadata(normalize_details=True), CHAR_DEF, UNK_DEF, matrix(), rows)
    assert [w and w[0] for w in d.words] == [None, "a〜", "b", None]
    assert d.word_details(1, "System") == ["y—"] and d.word_details(0, "System") == [] and d.word_details(99, "Unknown") == ["UNK"]
    bad = [["b", "0", "0", "hoge", "x"]]
    assert kind(lambda: Dictionary.build(metadata(), CHAR_DEF, UNK_DEF, matrix(), bad)) == ErrorKind.CONTENT
    assert Dictionary.build(metadata(skip_invalid_cost_or_id=True), CHAR_DEF, UNK_DEF, matrix(), bad).words == [None]
    assert kind(lambda: Dictionary.build(metadata(flexible_csv=False), CHAR_DEF, UNK_DEF, matrix(), [["a", "0", "0", "1", "x"], ["b", "0", "0", "1"]])) == ErrorKind.CONTENT
    assert kind(lambda: Dictionary.build(metadata(), CHAR_DEF, "DEFAULT,0,0,0,x", matrix(), [])) == ErrorKind.DICTIONARY
    assert kind(lambda: Dictionary.build(metadata(), CHAR_DEF, UNK_DEF, "1 1\n0 0 0\n", RECORDS)) == ErrorKind.BUILD


def test_lookups():
    d = dictionary()
    assert len(d.find_surface("東京")) == 1 and d.find_surface("東京都") == []
    assert [end for end, _ in d.prefix("東京都")] == [3, 6]
    assert [end for _, end in d.common_prefixes("すももも")] == [3]


def test_save_load_export(tmp_path):
    d = dictionary()
    d.save(tmp_path / "d")
    for uri in (str(tmp_path / "d"), f"file://{tmp_path}/d"):
        again = load_dictionary(uri)
        assert again.words == d.words and np.array_equal(again.matrix, d.matrix)
        assert [t.row() for t in Segmenter(again).segment("東京都にいる")] == [t.row() for t in Segmenter(d).segment("東京都にいる")]
    d.export(tmp_path / "e")
    (tmp_path / "e" / "metadata.json").unlink()
    built = Dictionary.build_from_folder(tmp_path / "e", metadata())
    assert built.words == d.words
    (tmp_path / "d" / "metadata.json").write_text(Metadata(format_version=1).to_json())
    assert kind(lambda: load_dictionary(str(tmp_path / "d"))) == ErrorKind.DESERIALIZE
    assert kind(lambda: load_dictionary("http://x/y")) == ErrorKind.DICTIONARY
    assert kind(lambda: load_dictionary("embedded://none")) == ErrorKind.DICTIONARY
    assert kind(lambda: load_dictionary(str(tmp_path / "none"))) == ErrorKind.IO
    assert ("scripts", True, False, "") in registry(str(tmp_path)) and ("d", False, True, str(tmp_path / "d")) in registry(str(tmp_path))


def test_user_dictionaries(tmp_path):
    m = metadata()
    f = tmp_path / "u.csv"
    f.write_text('東京塔,固有,トウキョウトウ\n"京,都",1,1,-9,名詞,キョウト,京都\n', "utf-8")
    u = UserDictionary.load(str(f), m)
    assert u.rows == [("京,都", 1, 1, -9, ["名詞", "キョウト", "京都"]), ("東京塔", 1, 1, -500, ["固有", "トウキョウトウ", "*"])]
    u.save(tmp_path / "u.parquet")
    assert UserDictionary.load(f"file://{tmp_path}/u.parquet", m).rows == u.rows
    for text, expected in (("x,1,1,2,a,b\n", ErrorKind.CONTENT), ("x,1,1,hoge,a,b,c\n", ErrorKind.PARSE), (",a,b\n", ErrorKind.BUILD), ('"x"y,a,b\n', ErrorKind.CONTENT)):
        f.write_text(text, "utf-8")
        assert kind(lambda: UserDictionary.load(str(f), m)) == expected
    assert kind(lambda: UserDictionary.load("embedded://x", m)) == ErrorKind.DICTIONARY
    assert kind(lambda: UserDictionary.load(str(tmp_path / "u.txt"), m)) == ErrorKind.ARGS
    assert kind(lambda: read_records(tmp_path / "none.csv")) == ErrorKind.IO
    f.write_bytes("あ".encode("euc-jp"))
    assert kind(lambda: read_records(f)) == ErrorKind.DECODE and read_records(f, "euc-jp") == [["あ"]]


def test_renaming_context_ids_changes_no_result():
    d = dictionary()
    r = d.remapped()
    assert r.metadata.connection_id_mapping["left"][0] == 0
    assert sorted(r.metadata.connection_id_mapping["left"]) == list(range(5))
    user = UserDictionary.from_records([["東京都", "3", "2", "10", "a", "b", "c"]], metadata())
    for text in ("東京都にいるすもももももも", "アイウ東京 abc"):
        for a, b in ((d, r), (d.with_user(user), r.with_user(user))):
            assert [t.row() for t in Segmenter(a).segment(text)] == [t.row() for t in Segmenter(b).segment(text)]
            assert [c for _, c in Segmenter(a).segment_nbest(text, 4)] == [c for _, c in Segmenter(b).segment_nbest(text, 4)]


def test_metadata_and_schema():
    m = PRESETS["ja"]()
    assert Metadata.from_json(m.to_json()).dictionary_schema == m.dictionary_schema and len(m.dictionary_schema.fields) == 13
    assert [len(PRESETS[k]().dictionary_schema.fields) for k in ("ja-long", "ko", "zh", "zh-frequency")] == [21, 12, 12, 14]
    assert kind(lambda: Metadata.from_json("[")) == ErrorKind.DESERIALIZE
    s = Schema(("surface", "l", "r", "c", "pos"))
    assert s.custom_fields == ("pos",) and s.detail_index("pos") == 0 and s.detail_index("c") is None and s.index("x") is None
    s.validate(["a", "1", "2", "3", "N"])
    assert kind(lambda: s.validate(["a", "1", "2"])) == ErrorKind.CONTENT and kind(lambda: s.validate(["a", "1", "2", "3", " "])) == ErrorKind.CONTENT
    assert [number_or_text(x) for x in ("12", "-3", "1.5", "x", "１２", "nan", "")] == [12, -3, 1.5, "x", "１２", "nan", ""]


def test_lexicon_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n".join(",".join(r) for r in RECORDS) + "\n\nbad,x,1,2,n\n", "utf-8")
    t = scan_lexicon(spark, str(tmp_path / "*.csv"), metadata()).collect()
    d = Dictionary.build(metadata(skip_invalid_cost_or_id=True), CHAR_DEF, UNK_DEF, matrix(), [*RECORDS, ["bad", "x", "1", "2", "n"]])
    assert {r.word_id: r.surface for r in t if not r.reason} == {i: w[0] for i, w in enumerate(d.words) if w}
    assert [r.reason for r in t if r.reason] == ["value"]
    words = d.words_table(spark)
    assert {r.surface: [e.word_id for e in r.entries] for r in group_entries(words).collect()}["都"] == [e[3] for e in d.find_surface("都")]
    ranks = {r.left_id: (r.n, r["rank"]) for r in context_frequencies(words).collect()}
    assert ranks[1] == (5, 1) and ranks[3] == (2, 2)


def test_folders_on_the_sessions_file_systems(spark, tmp_path):
    from kugiri.sources.dictionary import load_dictionary

    d = dictionary()
    d.save(uri := f"file://{tmp_path}/shared", spark)
    again = load_dictionary(uri, spark)
    assert again.words == d.words and np.array_equal(again.matrix, d.matrix) and again.unknown_rows == d.unknown_rows
    with pytest.raises(AnalysisError):
        load_dictionary(f"file://{tmp_path}/none", spark)
