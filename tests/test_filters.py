import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kugiri.functions.charfilters import CharacterFilter, Mapping, OffsetMapping, character_filter, register, size, unvoiced, voiced
from kugiri.functions.tokenfilters import TOKEN_FILTERS, arabic, token_filter
from kugiri.model import AnalysisError, ErrorKind, Token
from kugiri.plans.analyzer import Segmenter, Tokenizer
from small import dictionary

D = dictionary()


def tokens(*words) -> list[Token]:
    """Tokens of (surface, details); without details unknown ones."""
    out, at = [], 0
    for i, (surface, *details) in enumerate(words):
        out.append(Token(surface, at, at + size(surface), i, i, "System" if details else "Unknown", D, list(details) + ["*"] * (3 - len(details))))
        at += size(surface)
    return out


def surfaces(kind, args, own) -> list[str]:
    return [t.surface for t in token_filter(kind, args).apply(own)]


def test_offsets():
    m = OffsetMapping([(0, 3, 0, 1), (6, 9, 4, 14), (12, 12, 17, 19)])
    assert [m.correct(i, 30) for i in (0, 1, 2, 4, 9, 14, 15)] == [0, 3, 4, 6, 8, 9, 10]
    assert m.correct(18, 30) == 12 and m.correct(25, 30) == 25 - 19 + 12 and m.correct(31, 30) == 24
    assert OffsetMapping().correct(5, 3) == 5 and not OffsetMapping()
    assert (OffsetMapping([(0, 1, 0, 2)]) + OffsetMapping([(3, 5, 4, 4)])).spans == [(0, 1, 0, 2), (3, 5, 4, 4)]
    assert OffsetMapping([(0, 3, 0, 2)]).correct(1, 2) == 2  # halves go up


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aé１㍑が゙々ゝ ﾊﾟ", max_size=20), st.sampled_from(["nfc", "nfd", "nfkc", "nfkd"]))
def test_unicode_normalization(text, form):
    got, mapping = character_filter("unicode_normalize", {"kind": form}).apply(text)
    assert unicodedata.normalize(form.upper(), got) == unicodedata.normalize(form.upper(), text)
    assert mapping.correct(size(got), size(got)) == size(text)


def test_mapping_takes_the_longest():
    f = Mapping({"a": "1", "ab": "2", "é": "ee", "n": 3})
    assert f.apply("aabé")[0] == "12ee" and f.apply("aabé")[1].spans == [(1, 3, 1, 2)]
    assert Mapping({}).is_identity() and Mapping({}).apply("x")[0] == "x"
    with pytest.raises(AnalysisError):
        Mapping({"": "x"})


def test_regex_is_literal_and_refuses_what_the_dialect_lacks():
    f = character_filter("regex", {"pattern": r"\d+", "replacement": "$1"})
    assert f.apply("a12b3")[0] == "a$1b$1"
    assert character_filter("regex", {"pattern": "x*", "replacement": "-"}).apply("axb")[0] == "-a-b-"
    for bad in ("(?=a)", r"(a)\1", "(?<!a)b", "("):
        with pytest.raises(AnalysisError):
            character_filter("regex", {"pattern": bad, "replacement": ""})
    with pytest.raises(AnalysisError) as e:
        character_filter("nothing")
    assert e.value.kind == ErrorKind.DESERIALIZE


@pytest.mark.parametrize("text,expected", [("ここは騒々しい", "ここは騒騒しい"), ("さゝ木", "ささ木"), ("いすゞ", "いすず"), ("サヽキ", "ササキ"), ("マカヾイツ", "マカガイツ"), ("馬鹿々々しい", "馬鹿馬鹿しい"), ("ところゞゝゝ", "ところどころ"), ("じゝ", "じし"), ("じゞ", "じじ"), ("ジヽ", "ジシ"), ("ところゞゝゝゞゝゝ", "ところどころゞゝゝ"), ("々a", "々a")])
def test_iteration_marks(text, expected):
    f = character_filter("japanese_iteration_mark", {"normalize_kanji": True, "normalize_kana": True})
    assert f.apply(text)[0] == expected
    assert character_filter("japanese_iteration_mark").apply(text)[0] == text


def test_voicing():
    for plain, marked in ("かが", "とど", "はば", "カガ", "ツヅ", "ホボ"):
        assert voiced(plain) == marked and unvoiced(marked) == plain
    assert [voiced(c) for c in "あんうぱ"] == list("あんうぱ") and [unvoiced(c) for c in "ぱあゔ"][:2] == ["ぱ", "あ"]


def test_tags_keep_and_stop():
    own = lambda: tokens(("a", "名詞", "数"), ("b", "助詞"), ("c",))
    tag = ["名詞,数"]
    # the schema has three details, so that a tag of four never matches
    assert surfaces("japanese_keep_tags", {"tags": []}, own()) == [] and surfaces("japanese_stop_tags", {"tags": []}, own()) == ["a", "b", "c"]
    wide = [Token("a", 0, 1, 0, 0, "System", D, ["名詞", "数", "*", "*", "x"])]
    assert surfaces("japanese_keep_tags", {"tags": tag}, wide) == ["a"] and surfaces("japanese_stop_tags", {"tags": tag}, wide) == []
    assert surfaces("korean_keep_tags", {"tags": ["助詞"]}, own()) == ["b"] and surfaces("korean_stop_tags", {"tags": ["助詞"]}, own()) == ["a", "c"]


def test_words_length_case_mapping():
    own = lambda: tokens(("Straße",), ("İx",), ("the",))
    assert surfaces("keep_words", {"words": ["the"]}, own()) == ["the"] and surfaces("stop_words", {"words": ["the"]}, own()) == ["Straße", "İx"]
    kept = token_filter("stop_words", {"words": ["Straße"]}).apply(own())
    assert [t.position for t in kept] == [1, 2]
    assert surfaces("length", {"min": 3, "max": 5}, own()) == ["the"] and surfaces("length", {}, own()) == ["Straße", "İx", "the"]
    assert surfaces("uppercase", {}, own())[0] == "STRASSE" and surfaces("lowercase", {}, own())[0] == "straße"
    assert surfaces("mapping", {"mapping": {"ß": "ss"}}, own())[0] == "Strasse"


def test_forms_from_fields():
    own = lambda: tokens(("行っ", "動詞", "イッ", "行く"), ("x",))
    assert surfaces("japanese_base_form", {}, own()) == ["行く", "x"]
    assert surfaces("japanese_reading_form", {}, own()) == surfaces("korean_reading_form", {}, own()) == ["イッ", "x"]


def test_kana_stem_marks():
    assert surfaces("japanese_kana", {"kind": "hiragana"}, tokens(("トートバッグヴ漢",))) == ["とーとばっぐゔ漢"]
    assert surfaces("japanese_kana", {"kind": "katakana"}, tokens(("ゖがa",))) == ["ヶガa"]
    assert surfaces("japanese_katakana_stem", {"min": 3}, tokens(("コピー",), ("サーバー",), ("コーヒーa",))) == ["コピー", "サーバ", "コーヒーa"]
    with pytest.raises(AnalysisError):
        token_filter("japanese_katakana_stem", {"min": 0})
    assert surfaces("remove_diacritical_mark", {}, tokens(("éåパ",), ("é",))) == ["eaパ", "e"]
    assert surfaces("remove_diacritical_mark", {"japanese": True}, tokens(("パガﾞ",))) == ["ハカ"]


@pytest.mark.parametrize("text,expected", [("〇", "0"), ("十", "10"), ("百十", "110"), ("千百十", "1110"), ("二〇二四", "2024"), ("三千五百", "3500"), ("一万", "10000"), ("百万", "1000000"), ("一億二千", "100002000"), ("十五", "15"), ("壱弐参", "123"), ("垓", "1" + "0" * 20), ("１２", "12"), ("abc", "abc"), ("", "")])
def test_numerals(text, expected):
    assert arabic(text) == expected


def test_number_and_compound_words():
    own = lambda: [Token(s, 3 * i, 3 * i + 3, i, i, "System", D, ["名詞", t, "*", "*"]) for i, (s, t) in enumerate([("五", "数"), ("十", "数"), ("円", "一般"), ("二", "数")])]
    assert surfaces("japanese_number", {"tags": ["名詞,数"]}, own()) == ["5", "10", "円", "2"]
    merged = token_filter("japanese_compound_word", {"tags": ["名詞,数"], "new_tag": "名詞,数"}).apply(own())
    assert [(t.surface, t.byte_start, t.byte_end, t.position, t.position_length) for t in merged] == [("五十", 0, 6, 0, 2), ("円", 6, 9, 2, 1), ("二", 9, 12, 3, 1)]
    assert merged[0].details[:2] == ["名詞", "数"] and token_filter("japanese_compound_word", {"tags": ["名詞,数"]}).apply(own())[0].details[0] == "複合語"
    with pytest.raises(AnalysisError):
        token_filter("japanese_compound_word", {"tags": [1]})
    assert len(TOKEN_FILTERS) == 18


def test_chain_corrects_offsets():
    chain = Tokenizer(Segmenter(D), [character_filter("unicode_normalize", {"kind": "nfkc"}), character_filter("mapping", {"mapping": {"xx": "東京"}})], [token_filter("lowercase")])
    text = "ａｂ xx 都"
    for t in chain.tokenize(text):
        part = text.encode()[t.byte_start : t.byte_end].decode()
        assert unicodedata.normalize("NFKC", part).replace("xx", "東京") == t.surface
    assert [t.surface for t in chain.tokenize_nbest(text, 1)[0][0]] == chain.tokenize_surfaces(text) == ["ab", "東京", "都"]


def test_own_filters_are_registered():
    class Strip(CharacterFilter):
        def pieces(self, text):
            if text.endswith("!"):
                yield len(text) - 1, len(text), ""

    register("strip", lambda a: Strip())
    assert character_filter("strip").apply("a!")[0] == "a"
