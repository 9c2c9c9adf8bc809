import pytest

from compare import compare
from kugiri.functions.formats import mecab as general_mecab
from kugiri.operators import queries as general
from kugiri.plans import queries as analysis

QUERIES, SQL = {**analysis.QUERIES, **general.QUERIES}, {**analysis.ORACLES, **general.ORACLES}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    compare(spark, name, QUERIES[name], SQL.get(name))


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and {n for n in QUERIES} <= set(entry.queries())
    assert entry.entry(spark).columns == ["lang", "surface", "n"]


def test_outputs_pass_over_all_documents(spark, tmp_path):
    """Japanese, NULL, empty and long texts through JSON, N-best, mecab and token rows, against the token lists."""
    import json
    from datetime import datetime

    long = "the shaft of the 軸受、" * 9000
    texts = {1: "the shaft 軸受は東京。\nune vis", 2: None, 3: "", 4: long, 5: "東京に いる"}
    spark.createDataFrame([(k, "ja", t, datetime(2024, 1, 1)) for k, t in texts.items()], "doc_id long, lang string, text string, filed_at timestamp").write.parquet(str(tmp_path / "documents.parquet"))
    chain, runs = analysis.tokenizer("function-words"), analysis.tokenizer()
    collected = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    got = {r.doc_id: r.json for r in collected("output_json")}
    assert set(got) == set(texts) and got[2] is None
    for k in (1, 3, 4, 5):
        assert [(t["surface"], t["byte_start"], t["word_id"]) for t in json.loads(got[k])] == [(t.surface, t.byte_start, t.word_id) for t in chain.tokenize(texts[k])]
    assert {r.doc_id: r.lines for r in collected("output_mecab_documents")} == {k: None if t is None else general_mecab(runs.tokenize(t)) for k, t in texts.items()}
    kept = analysis.tokenizer(keep_whitespace=True)
    assert sorted((r.doc_id, r.position, r.surface, r.category) for r in collected("token_rows_documents")) == [(k, t.position, t.surface, t.details[0]) for k, x in texts.items() for t in kept.tokenize(x or "")]
    ranks = {(r.doc_id, r["rank"]): (r.cost, r.surfaces) for r in collected("nbest")}
    assert {k for k, _ in ranks} == {1, 4, 5} and all(ranks[k, 1][1] == " ".join(t.surface for t in chain.tokenize(texts[k])) for k in (1, 4))
    assert all(ranks[k, n][0] <= ranks[k, n + 1][0] for k, n in ranks if (k, n + 1) in ranks)


def test_words_of_the_lexicon_table_are_weighed(spark, tmp_path):
    """Costs decide between words, and the filters by field and tag act on known words; worked out by hand."""
    fields = ["surface", "left_context_id", "right_context_id", "cost", "pos", "base_form", "reading"]
    kinds = "dict_name string, lang_group string, encoding string, default_word_cost int, default_left_context_id int, default_right_context_id int, default_field_value string, flexible_csv boolean, skip_invalid_cost_or_id boolean, normalize_details boolean, dictionary_schema array<string>, user_dictionary_schema array<string>"
    spark.createDataFrame([(n, g, "UTF-8", 0, 0, 0, "*", None, False, n == "a", fields, ["surface", "pos", "reading"]) for n, g in (("a", "ja"), ("b", "ja"), ("c", "ko"))], kinds).write.parquet(str(tmp_path / "dictionaries.parquet"))
    words = [("a", "軸", 5, 7, 100, ["N", "*", "ジク"]), ("a", "受", 2, 3, 150, ["N", "*", "*"]), ("a", "軸受", 9, 1, 300, ["N", "X", "Y"]), ("b", "軸受", 9, 1, 300, ["JKS", "ベース", "ヨミ"]), ("c", "집", 1, 1, -5, ["JKS", "*", "jip"])]
    spark.createDataFrame(words, "dict_name string, surface string, left_context_id int, right_context_id int, cost int, details array<string>").write.parquet(str(tmp_path / "lexicon.parquet"))
    spark.createDataFrame([(1, "ja", "軸受 軸受"), (2, "en", "Shaft 집"), (3, "en", None)], "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    collected = lambda name: {tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()}
    rest = lambda name: {(name, "Shaft", 1), (name, "집", 1)}
    assert collected("tokens_reading_form_lexicon") == {("a", "ジク", 2), ("a", "受", 2), ("b", "ヨミ", 2)} | rest("a") | rest("b")
    assert collected("tokens_base_form_lexicon") == {("a", "軸", 2), ("a", "受", 2), ("b", "ベース", 2)} | rest("a") | rest("b")
    assert collected("tokens_korean_reading_form_lexicon") == {("c", "jip", 1), ("c", "Shaft", 1), ("c", "軸受", 2)}
    assert collected("tokens_korean_keep_tags_lexicon") == {("c", "집", 1)} and collected("tokens_korean_stop_tags_lexicon") == {("c", "Shaft", 1), ("c", "軸受", 2)}
    assert ("b", "ja", "軸受", 2) in (flagship := collected("tokenize_counts_lexicon")) and ("a", "ja", "受", 2) in flagship and ("c", "en", "shaft", 1) in flagship and len(flagship) == 4 + 3 + 3
