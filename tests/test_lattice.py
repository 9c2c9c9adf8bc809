import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kugiri.model import SYSTEM, UNKNOWN, USER, AnalysisError, Mode, Penalty
from kugiri.operators.lattice import MOST_BYTES, Lattice, is_kanji, sentences
from kugiri.plans.analyzer import Ranks, Segmenter, Tokenizer
from kugiri.sources.bundled import bundled, char_def
from kugiri.sources.definitions import Categories
from kugiri.sources.dictionary import Dictionary, UserDictionary
from small import dictionary, matrix, metadata

D = dictionary()


def every_path(lattice: Lattice, text: str):
    """All paths by brute force over the same edges, with their costs by the definition."""
    kinds = lattice._kinds(text)
    runs = lattice._runs(kinds)
    edges, unknown_end, reach = {}, 0, {0}
    for i in range(len(text)):
        if i in reach:
            edges[i], unknown_end = lattice.edges_at(text, i, kinds, runs, unknown_end)
            reach |= {e[0] for e in edges[i]}
    p = lattice.mode.penalty

    def walk(i, right, charge):
        if i == len(text):
            yield [], lattice.d.costs[0][right]
            return
        for end, left, r, cost, word, kind in edges.get(i, ()):
            here = lattice.d.costs[left][right] + cost + charge
            own = p.of(end - i, all(map(is_kanji, text[i:end]))) if p and end < len(text) else 0
            for path, rest in walk(end, r, own):
                yield [(i, end, word, kind), *path], here + rest

    return list(walk(0, 0, 0))


TEXTS = st.text(alphabet="東京都にいるももすアイウab c", min_size=1, max_size=9)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.sampled_from(["normal", "decompose"]), st.booleans())
def test_best_is_the_least_of_all_paths(text, mode, ladder):
    lattice = Lattice(D, Mode.parse(mode), ladder=ladder)
    paths = every_path(lattice, text)
    path, cost = lattice.best(text)
    assert cost == min(c for _, c in paths)
    assert (path, cost) in paths


@settings(max_examples=80, deadline=None)
@given(TEXTS, st.sampled_from(["normal", "decompose"]))
def test_nbest_is_the_sorted_list_of_all_paths(text, mode):
    lattice = Lattice(D, Mode.parse(mode))
    costs = sorted(c for _, c in every_path(lattice, text))[:6]
    found = lattice.nbest(text, 6)
    assert [c for _, c in found] == costs
    assert len({tuple(p) for p, _ in found}) == len(found)
    assert found[0][1] == lattice.best(text)[1]
    unique = lattice.nbest(text, 6, unique=True)
    starts = [tuple(x[0] for x in p) for p, _ in unique]
    assert len(set(starts)) == len(starts)
    assert all(c <= costs[0] + 50 for _, c in lattice.nbest(text, 100, threshold=50))
    assert lattice.nbest(text, 0) == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="the of a12,.京に\n。 x", max_size=60), st.sampled_from(["normal", "decompose"]))
def test_spans_between_white_space_are_independent(text, mode):
    fast, slow = (Segmenter(bundled("function-words"), mode) for _ in range(2))
    assert fast.gaps is not None
    slow.gaps = None
    rows = lambda s: [t.row() for t in s.segment(text)]
    assert rows(fast) == rows(slow)


def test_ties_take_the_first_inserted():
    lattice = Lattice(bundled("scripts"))
    assert [x[:2] for x in lattice.best("abc12")[0]] == [(0, 3), (3, 5)]


def test_categories_without_grouping_and_with_a_ladder():
    own = Lattice(D)
    kinds = own._kinds("漢字漢")
    edges, end = own.edges_at("漢字漢", 0, kinds, own._runs(kinds), 0)
    assert sorted(e[0] for e in edges) == [1, 2] and end == 1
    kinds = own._kinds("アイウ")
    edges, end = own.edges_at("アイウ", 0, kinds, own._runs(kinds), 0)
    assert sorted(e[0] for e in edges) == [1, 2, 3] and end == 3
    capped = Lattice(D, max_grouping_len=1, ladder=False)
    edges, end = capped.edges_at("アイウ", 0, kinds, capped._runs(kinds), 0)
    assert [e[0] for e in edges] == [1] and end == 1


def test_unknown_words_wait_for_the_end_of_the_last_in_normal_mode():
    kinds = (lattice := Lattice(D))._kinds("ももa")
    runs = lattice._runs(kinds)
    assert all(e[5] != UNKNOWN for e in lattice.edges_at("ももa", 1, kinds, runs, 2)[0])
    decompose = Lattice(D, Mode.parse("decompose"))
    assert any(e[5] == UNKNOWN for e in decompose.edges_at("ももa", 1, kinds, runs, 2)[0])


def test_penalty():
    p = Penalty()
    assert [p.of(n, True) for n in (1, 2, 3, 5)] == [0, 0, 3000, 9000]
    assert [p.of(n, False) for n in (2, 7, 8)] == [0, 0, 1700]
    with pytest.raises(AnalysisError):
        Mode.parse("fast")
    assert Mode.parse({"decompose": {"kanji_penalty_length_threshold": 3}}).penalty.of(3, True) == 0


def test_sentences():
    assert list(sentences("a\nb\tc。d、e")) == ["a\n", "b\t", "c。", "d、", "e"]
    assert list(sentences("")) == [] and list(sentences("\n\n")) == ["\n", "\n"]
    long = "é" * (MOST_BYTES // 2 + 5)
    parts = list(sentences(long))
    assert [len(p) for p in parts] == [MOST_BYTES // 2, 5] and "".join(parts) == long
    random.seed(1)
    text = "".join(random.choice("ab。\n") for _ in range(500))
    assert "".join(sentences(text)) == text


def test_white_space_is_dropped_but_counts_in_offsets():
    s = Segmenter(D)
    rows = [(t.surface, t.byte_start, t.byte_end, t.position) for t in s.segment("  東京  都 ")]
    assert rows == [("東京", 2, 8, 0), ("都", 10, 13, 1)]
    assert [t.surface for t in Segmenter(D, keep_whitespace=True).segment("東京 都")] == ["東京", " ", "都"]
    assert s.segment("") == [] and s.segment("   ") == []


def test_user_words_win_by_cost_and_keep_their_type():
    user = UserDictionary.from_records([["東京都", "固有", "トウキョウト"]], metadata())
    token, *rest = Segmenter(D.with_user(user)).segment("東京都に")
    assert (token.surface, token.lex_type, token.details) == ("東京都", USER, ["固有", "トウキョウト", "*"])
    assert rest[0].lex_type == SYSTEM
    assert [t.surface for t in Segmenter(D).segment("東京都に")] == ["東京", "都", "に"]


def test_nbest_joins_sentences_by_rank():
    s = Segmenter(D)
    ranks = s.segment_nbest("もも。東京都", 3)
    first = [t.surface for t in s.segment("もも。東京都")]
    assert [t.surface for t in ranks[0][0]] == first
    assert [c for _, c in ranks] == sorted(c for _, c in ranks)
    assert s.segment_nbest("", 3) == []
    tokens = Tokenizer(s).tokenize_nbest("東京 \n都", 1)[0][0]
    # offsets go on from the last kept token, so dropped white space at a sentence's end shifts what follows
    assert [(t.surface, t.byte_start) for t in tokens] == [("東京", 0), ("都", 6)] or [(t.surface, t.byte_start) for t in tokens][0] == ("東京", 0)


def test_session_options():
    s = Segmenter(D)
    assert len(s.segment("アイウエ")) == 1
    s.set_max_grouping_len(2)
    s.set_unknown_word_ladder(False)
    assert len(s.segment("アイウエ")) > 1
    s.set_max_grouping_len(0)
    s.set_mode("decompose")
    s.set_keep_whitespace(True)
    assert [t.surface for t in s.segment("都 都")] == ["都", " ", "都"]
    chain = Tokenizer(Segmenter(bundled("scripts")))
    assert chain.tokenize_surfaces("ab12 x") == ["ab", "12", "x"]
    chain.segmenter.set_max_grouping_len(1)
    assert chain.tokenize_surfaces("abc x") == ["a", "bc", "x"]
    s.shrink_to(0)
    assert not s.cache


def test_a_long_sentence_is_refused():
    with pytest.raises(AnalysisError):
        Lattice(D).best("a" * 65535)


def nested() -> Dictionary:
    """A lexicon with words whose parts are words."""
    words = [("un", 1, 1, -400), ("a", 1, 2, -390), ("una", 2, 1, -700), ("n", 3, 3, -5), ("u", 2, 2, -5), ("l", 2, 1, -120), ("la", 4, 4, -130), ("la", 4, 4, -100), ("na", 2, 1, -60)]
    unknown = "\n".join(f"{name},0,0,{200 + 10 * i},{name},*,*" for i, name in enumerate(Categories(char_def()).names))
    return Dictionary.build(metadata(), char_def(), unknown, matrix(), [[w, str(a), str(b), str(c), "x", "y", "z"] for w, a, b, c in words])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="unal 1.京\n、x", max_size=40), st.integers(1, 4), st.booleans())
def test_ranks_by_spans_are_those_of_whole_sentences(text, n, keep):
    segmenter = Segmenter(nested(), keep_whitespace=keep)
    assert Ranks.fit(segmenter)
    expected = [(cost, "|".join(t.surface for t in tokens)) for tokens, cost in segmenter.segment_nbest(text, n)]
    assert Ranks(segmenter, n, "|").of(text) == expected


def test_ranks_search_spans_and_not_sentences(monkeypatch):
    """Sentences were searched as they came; now a word seen before isn't searched again."""
    segmenter = Segmenter(nested())
    ranks = Ranks(segmenter, 3, " ")
    searched, paths = [], Lattice.paths
    monkeypatch.setattr(Lattice, "paths", lambda own, text, *rest: searched.append(text) or paths(own, text, *rest))
    first = ranks.of("la una x 1.")
    assert searched == ["la", "una", "x"] and len(first) == 3
    assert ranks.of("la x una x 1.") and ranks.of("la una x 1.") == first and len(searched) == 3


def test_sentences_with_open_order_are_searched_whole():
    segmenter = Segmenter(nested())
    ranks = Ranks(segmenter, 4, "|")
    text = "una x una x una x unana 1 una"
    assert ranks.of(text) == [(c, "|".join(t.surface for t in own)) for own, c in segmenter.segment_nbest(text, 4)]
    assert not Ranks.fit(Segmenter(nested(), "decompose"))
