import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kugiri.functions.tokenfilters import token_filter
from kugiri.model import Mode
from kugiri.operators.lattice import MOST_BYTES, Lattice
from kugiri.operators.spans import Spans, separable
from kugiri.plans import queries as analysis
from kugiri.plans.analyzer import Segmenter, Tokenizer, surface_counts
from kugiri.sources.bundled import bundled, char_def
from kugiri.sources.definitions import Categories, parse_unknown
from kugiri.sources.dictionary import Dictionary, UserDictionary
from small import metadata

WORDS = [("東京", 100), ("京都に", 120), ("都", 9000), ("に", -50), ("いるa", 80), ("もア", 90), ("a b", -300), (" c", 10), ("b。", 40), ("ab c1", -900), ("a", 9999), ("1a", 10), ("c\nb", -9000), ("アイ", 500), ("。。", -70)]


def lattices(connection: int = 0, cost: int = 10_000) -> list[Segmenter]:
    """Two lexicons, one with a user word."""
    unknown = parse_unknown("\n".join(f"{name},0,0,{cost},UNK" for name in Categories(char_def()).names))
    made = lambda words, user=None: Dictionary(metadata(), char_def(), unknown, np.full((20, 20), connection, np.int16), sorted((w, i, 19 - i, c, ["x", "y", "z"]) for i, (w, c) in enumerate(words)), user)
    return [Segmenter(made(WORDS[::2])), Segmenter(made(WORDS[1::2], UserDictionary([("都に a", 3, 4, -2000, ["u"] * 3)])))]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="東京都にいるもアイa b c1\n。, ", max_size=40), st.sampled_from([0, 7]))
def test_spans_have_the_words_of_the_text(text, connection):
    own = lattices(connection)
    assert all(separable(s.lattice) for s in own)
    spans = Spans([s.lattice for s in own])
    cut = spans.of(text, spans.tails_of)
    assert "".join(cut) == text
    for s in own:
        s.gaps = None
        words = lambda t: [(x.surface, x.word_id, x.lex_type) for x in s.segment(t)]
        assert words(text) == [w for span in cut for w in words(span)]


def test_words_across_cuts_keep_them_together():
    spans = Spans([s.lattice for s in lattices()])
    of = lambda text: spans.of(text, spans.tails_of)
    assert of("xx 12 アイ,yy") == ["xx", " 12", " アイ", ",", "yy"]
    assert of("x ab c12 yy") == ["x", " ab c12", " yy"] and of("x ab d12") == ["x", " ab", " d", "12"]
    assert of("c\nb") == ["c", "\n", "b"] and of("x。。yb。,") == ["x", "。", "。", "yb。", ","]
    long = "x1" * MOST_BYTES
    assert "".join(of(long)) == long and set(of(long)) == {"x", "1"}


def test_what_is_separable():
    assert not separable(Lattice(bundled("function-words")))
    dictionary = lattices()[0].dictionary
    assert separable(Lattice(dictionary)) and not separable(Lattice(dictionary, Mode.parse("decompose")))
    assert not separable(lattices(32767, 32767)[0].lattice)


def test_counts_are_those_of_every_text(spark):
    """By spans, and where the connections differ by whole texts; NULL keys, repeated, empty and long texts."""
    texts = ["東京都に a b", None, "", "ab c1。a b\n東京都に", "x" * 300 + "ab c12 ", "a1 " * 9000]
    rows = [(("ja", None, "en")[i % 3], texts[i % 6]) for i in range(90)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    filters = [token_filter("uppercase", {}), token_filter("stop_words", {"words": ["X"]})]
    for chains in ({"a": Tokenizer(lattices()[0], [], filters), "b": Tokenizer(lattices()[1], [], filters)}, {"f": Tokenizer(Segmenter(bundled("function-words")), [], filters)}):
        expected: dict[tuple, int] = {}
        for name, own in chains.items():
            for lang, text in rows:
                for t in own.tokenize(text or ""):
                    expected[name, lang, t.surface] = expected.get((name, lang, t.surface), 0) + 1
        got = surface_counts(df, "text", chains)
        assert got.columns == ["name", "lang", "surface", "n"] and {tuple(r)[:3]: r.n for r in got.collect()} == expected
    assert surface_counts(df.limit(0), "text", chains).count() == 0


ONE_PASS = ["tokenize_counts_lexicon", "tokens_japanese_stop_tags_lexicon", "tokens_base_form_lexicon", "tokens_reading_form_lexicon", "tokens_japanese_keep_tags_lexicon"]


@pytest.mark.parametrize("name", ONE_PASS)
def test_the_lexicons_share_one_pass_over_the_documents(spark, name):
    """Texts were searched once for each dictionary."""
    plan = analysis.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1
