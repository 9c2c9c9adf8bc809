import numpy as np
import pytest

from kugiri.model import AnalysisError, Metadata, Schema
from kugiri.plans.analyzer import Segmenter
from kugiri.sources.dictionary import Dictionary
from kugiri.trainer.crf import Batch, Compiled, CrfTrainer, FeatureSet, Lattice, Weights, bigrams, features_of, minimize
from kugiri.trainer.lexicon import Extractor, LexiconModel, LexiconTrainer, Rewriter, TrainingConfig, to_cost
from small import metadata

RNG = np.random.default_rng(5)
SETS = [FeatureSet([1, 2], [1, None], [2, 1]), FeatureSet([2], [2, 1], [1, 2]), FeatureSet([3, 1], [1, 2], [None, 1]), FeatureSet([], [None, None], [2, 2])]


def lattice() -> Lattice:
    out = Lattice(4)
    for start, target, label in [(0, 1, 1), (1, 3, 2), (3, 4, 3), (0, 2, 2), (2, 3, 1), (2, 4, 4), (1, 2, 9)]:
        out.add(start, target, label)
    return out


def paths(x: Lattice, at=0):
    if at == x.n:
        yield []
    for target, label in x.nodes[at] if at < x.n else ():
        for rest in paths(x, target):
            yield [label, *rest]


def weights(x: Lattice) -> Weights:
    uni, bi = features_of([x], SETS)
    return Weights({f: i for i, f in enumerate(sorted(uni))}, {f: i + len(uni) for i, f in enumerate(sorted(bi))})


def score(labels, w, where):
    words = sum(w[where.unigram[f]] for k in labels if k <= len(SETS) for f in SETS[k - 1].unigram)
    return words + sum(w[where.bigram[f]] for a, b in zip([None, *labels], [*labels, None]) for f in bigrams(SETS, a, b))


def test_loss_and_gradient():
    x = lattice()
    where = weights(x)
    w = RNG.normal(size=len(where))
    all_paths = list(paths(x))
    gold = [1, 2, 3]
    g = np.zeros(len(w))
    loss = Compiled(x, SETS, where).evaluate(w, g)
    assert loss == pytest.approx(np.logaddexp.reduce([score(p, w, where) for p in all_paths]) - score(gold, w, where), abs=1e-10)
    for i in range(len(w)):
        e = np.eye(len(w))[i] * 1e-6
        assert g[i] == pytest.approx((Compiled(x, SETS, where).evaluate(w + e, None) - Compiled(x, SETS, where).evaluate(w - e, None)) / 2e-6, abs=1e-6)


def test_lattices_together_have_the_sums_of_single_ones():
    short = Lattice(2)
    for start, target, label in [(0, 2, 3), (0, 1, 1), (1, 2, 2)]:
        short.add(start, target, label)
    own = [lattice(), short, lattice()]
    uni, bi = features_of(own, SETS)
    where = Weights({f: i for i, f in enumerate(sorted(uni))}, {f: i + len(uni) for i, f in enumerate(sorted(bi))})
    w = RNG.normal(size=len(where))
    one, together = np.zeros(len(w)), np.zeros(len(w))
    loss = sum(Compiled(x, SETS, where).evaluate(w, one) for x in own)
    assert Batch(own, SETS, where).evaluate(w, together) == pytest.approx(loss, abs=1e-10) and np.allclose(one, together, atol=1e-10)


def test_the_query_trains_on_every_annotated_sentence(spark, tmp_path):
    from kugiri.plans.queries import annotated_sentences, trained_lexicon

    lexicon = [(1, "a", "犬", ["N", "x,y"]), (2, "a", "が", ["P", "*"]), (3, "b", "犬", ["M"]), (4, "b", ",", ["S"])]
    spark.createDataFrame(lexicon, "word_id long, dict_name string, surface string, details array<string>").write.parquet(str(tmp_path / "lexicon.parquet"))
    rows = [(5, 7, 1, "a", "が", "P|*"), (1, 7, 0, "a", "犬", 'N;"x,y"'), (2, 7, 1, "a", "が", "P,*"), (3, 7, 0, "b", ",", "S"), (4, 8, 0, "b", "犬", None), (6, 8, 1, "b", None, "S")]
    rows += [(10 + i, 20 + i, 0, "a", "犬", "N,x,y") for i in range(30)] + [(90, 90, 0, "a", "猫", "UNK,*")]
    spark.createDataFrame(rows, "row_id long, sentence_id long, word_pos int, dict_name string, surface string, feature string").write.parquet(str(tmp_path / "corpus_words.parquet"))
    got = {(r.dict_name, r.sentence_id): [tuple(t) for t in r.tokens] for r in annotated_sentences(spark, str(tmp_path)).collect()}
    assert len(got) == 34 and got["a", 7] == [("犬", "N,x,y"), ("が", "P,*")] and got["b", 8] == [("犬", ""), (None, "S")] and got["a", 90] == [("猫", "UNK,*")]
    costs = {(r.dict_name, r.surface): r.cost for r in trained_lexicon(spark, str(tmp_path)).collect()}
    assert set(costs) == {(n, s) for _, n, s, _ in lexicon} and costs["a", "犬"] < costs["a", "が"] < 0 and costs["b", ","] < 0


def test_minimize():
    a = np.diag([1.0, 10, 100])
    b = np.array([1.0, -20, 0.5])
    quadratic = lambda x: (0.5 * x @ a @ x - b @ x, a @ x - b)
    assert np.allclose(minimize(quadratic, np.zeros(3)), np.linalg.solve(a, b), atol=1e-4)
    sparse = minimize(quadratic, np.zeros(3), l1=1.0)
    assert np.allclose(sparse, [0, -1.9, 0], atol=1e-4)


@pytest.mark.parametrize("kind", ["l1", "l2", "elastic_net"])
def test_training_learns_the_correct_path(spark, kind):
    x = lattice()
    model = CrfTrainer(kind, 0.01).train([x], SETS)
    assert [k for *_, k in model.best_path(x)[0]] == [1, 2, 3]
    spread = CrfTrainer(kind, 0.01).train(spark.sparkContext.parallelize([x, x], 2), SETS)
    both = CrfTrainer(kind, 0.01).train([x, x], SETS)
    assert spread.unigram == pytest.approx(both.unigram, abs=1e-4) and spread.bigram == pytest.approx(both.bigram, abs=1e-4)
    merged = both.merge()
    best = max(paths(x), key=lambda p: sum(both.word_score(k) for k in p) + sum(both.pair_score(a, b) for a, b in zip([None, *p], [*p, None])))
    assert [k for *_, k in both.best_path(x)[0]] == best
    own = [k for k in (1, 2, 3)]
    assert sum(merged.words[k - 1][0] for k in own) == pytest.approx(sum(map(both.word_score, own)))
    with pytest.raises(AnalysisError):
        CrfTrainer("l3")
    with pytest.raises(AnalysisError):
        CrfTrainer(max_iter=0)


def test_templates():
    e = Extractor("UNIGRAM U:%F[0],%F?[1] # c\nUNIGRAM W:%w/%t/%u\nBIGRAM B:%L[0]/%R[0]\nBIGRAM C:%L?[1]/%R[9]/%r\n# x\n")
    first = e.feature_set(("N,x", "L,y", "R"), 3, "w")
    second = e.feature_set(("N,*", "L,*", "R"), 3, "w")
    assert first.unigram == [1, 2] and second.unigram == [3] and first.left == [1, 2] and second.left == [1, None]
    assert list(e.ids[0]) == ["U:N,x", "W:w/3/N,x", "W:w/3/N,*"]


def test_rewriting():
    r = Rewriter("[unigram rewrite]\n*,*,*\t$1,$2\n[left rewrite]\n(a|b),x\tX,$2,$9\na,*\tY\n[right rewrite]\na\tZ\n")
    assert r.rewrite("a,x,1") == ("a,x", "X,x,", "Z") and r.rewrite("a,y") == ("a,y", "Y", "Z") and r.rewrite("c") == ("c", "c", "c")
    assert Rewriter("名詞,一般\tNOUN\n").rewrite("名詞,代名詞") == ("名詞,代名詞",) * 3 and Rewriter("a b\n").rewrite("a") == ("a", "a", "b") and Rewriter().rewrite("q")[0] == "q"


CHAR = "DEFAULT 0 1 0\nHIRAGANA 1 1 0\nKATAKANA 1 1 0\nKANJI 0 0 2\nALPHA 1 1 0\nNUMERIC 1 1 0\n0x3041..0x3096 HIRAGANA\n0x30A1..0x30F6 KATAKANA\n0x4E00..0x9FAF KANJI\n"
CORPUS = [[("犬", "名詞,一般,イヌ"), ("が", "助詞,格,ガ"), ("走る", "動詞,自立,ハシル")], [("猫", "名詞,一般,ネコ"), ("が", "助詞,格,ガ"), ("いる", "動詞,自立,イル")]]


def config() -> TrainingConfig:
    seed = "\n".join(f"{s},0,0,0,{f}" for s, f in {w for own in CORPUS for w in own} | {("鳥", "名詞,一般,トリ")})
    unk = "\n".join(f"{n},0,0,0,名詞,{n},*" for n in ("DEFAULT", "HIRAGANA", "KATAKANA", "KANJI", "ALPHA", "NUMERIC"))
    return TrainingConfig.parse("\n".join(sorted(seed.splitlines())), CHAR, unk, "UNIGRAM U:%F[0],%F[1]\nUNIGRAM W:%w\nBIGRAM B:%L[0]/%R[0]\n", "")


def test_from_corpus_to_dictionary(spark, tmp_path):
    model = LexiconTrainer(config(), CrfTrainer("l2", 0.01)).train(CORPUS)
    base = metadata(dictionary_schema=Schema(("surface", "left_context_id", "right_context_id", "cost", "pos", "sub", "reading"))).to_json()
    assert "lex.csv" in model.export(tmp_path / "m", base)
    d = Dictionary.build_from_folder(tmp_path / "m", Metadata.load(tmp_path / "m" / "metadata.json"))
    for own in CORPUS:
        assert [(t.surface, ",".join(t.details)) for t in Segmenter(d).segment("".join(s for s, _ in own))] == own
    assert [t.surface for t in Segmenter(d).segment("鳥が走る")] == ["鳥", "が", "走る"]
    model.save(tmp_path / "m.json")
    again = LexiconModel.load(tmp_path / "m.json")
    assert again.lexicon() == model.lexicon() and again.matrix_def() == model.matrix_def() and again.evaluate() == pytest.approx(model.evaluate())
    rows = spark.createDataFrame([(own,) for own in CORPUS] + [([],)], "tokens array<struct<surface:string, feature:string>>")
    assert [w[0] for w in LexiconTrainer(config(), CrfTrainer("l2", 0.01)).train(rows).words] == pytest.approx([w[0] for w in model.words], abs=1e-3)
    ids = {s: w[1:] for s, w in zip(model.surfaces, model.words)}
    assert model.infer_ids("鼠", "名詞,一般,ネズミ") == ids["犬"] == ids["猫"] or model.infer_ids("鼠", "名詞,一般,ネズミ") in ids.values()
    assert model.infer_ids("ア", "x") == model.words[len(model.surfaces) + 2][1:]
    assert model.user_lexicon([("鼠", "名詞,一般,ネズミ")]).startswith("鼠,") and model.user_lexicon([]) == ""
    left, right, pairs = model.bigram_details()
    assert len(left.splitlines()) == len(model.left_ids) and len(right.splitlines()) == len(model.right_ids) and len(pairs.splitlines()) == sum(map(len, model.matrix)) and "BOS/EOS" in pairs
    assert [to_cost(w, 10) for w in (0.05, -0.05, 9999, 0)] == [-1, 1, -32768, 0]


def test_one_call_functions(tmp_path):
    from kugiri import api

    files = {"seed": "犬,0,0,0,名詞,一般\nが,0,0,0,助詞,格\n", "corpus": "犬\t名詞,一般\nが\t助詞,格\nEOS\n", "char_def": CHAR, "unk_def": "\n".join(f"{n},0,0,0,名詞,{n}" for n in ("DEFAULT", "HIRAGANA", "KATAKANA", "KANJI", "ALPHA", "NUMERIC")), "feature_def": "UNIGRAM W:%w\nBIGRAM B:%L[0]/%R[0]\n", "rewrite_def": ""}
    for name, text in files.items():
        (tmp_path / name).write_text(text, "utf-8")
    api.train(**{n: str(tmp_path / n) for n in files}, output=str(tmp_path / "m.json"), regularization="l2")
    meta = metadata(dictionary_schema=Schema(("surface", "left_context_id", "right_context_id", "cost", "pos", "sub")))
    (tmp_path / "base.json").write_text(meta.to_json(), "utf-8")
    assert "metadata.json" in api.export(str(tmp_path / "m.json"), str(tmp_path / "x"), str(tmp_path / "base.json"))
    api.build_dictionary(str(tmp_path / "x"), str(tmp_path / "d"), meta)
    d = api.load_dictionary(str(tmp_path / "d"))
    assert [t.surface for t in api.Segmenter(d).segment("犬が")] == ["犬", "が"]
    (tmp_path / "u.csv").write_text("犬が,x,y\n", "utf-8")
    meta.default_left_context_id, meta.default_right_context_id = d.find_surface("犬")[0][0], d.find_surface("が")[0][1]
    api.build_user_dictionary(str(tmp_path / "u.csv"), str(tmp_path / "u.parquet"), meta)
    u = api.load_user_dictionary(str(tmp_path / "u.parquet"), meta)
    assert u.rows[0][0] == "犬が" and len(d.with_user(u).user.find("犬が")) == 1
