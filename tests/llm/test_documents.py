import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kugiri.llm import leakage, packing, quality

# packing ---------------------------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(0, 4), max_size=6), st.integers(0, 60))
def test_fill_is_the_best_subset(counts, room):
    best = 0
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c + 1)}
    best = max(s for s in sums if s <= room)
    picked = packing.fill(counts, room)
    assert sum(n * k for n, k in picked.items()) == best and all(0 < k <= counts[n] for n, k in picked.items())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(0, 40), max_size=12))
def test_plan_uses_every_piece_once(counts):
    runs = packing.plan(counts, 50)
    used = Counter()
    for i, (first, times, picked) in enumerate(runs):
        assert times > 0 and sum(n * k for n, k in picked.items()) <= 50
        assert i == 0 or first == runs[i - 1][0] + runs[i - 1][1]
        for n, k in picked.items():
            used[n] += k * times
    assert used == Counter({n: c for n, c in counts.items() if c})


def first_fit(sizes, capacity):
    """Containers that first fit over falling lengths needs."""
    room = []
    for n in sorted(filter(None, sizes), reverse=True):
        i = next((i for i, r in enumerate(room) if r >= n), None)
        if i is None:
            room.append(capacity - n)
        else:
            room[i] -= n
    return len(room)


def test_packing(spark):
    rng = random.Random(4)
    # a third of the texts has one length
    sizes = [(i, 17 if i % 3 == 0 else rng.choice([0, 1, 5, 40, 63, 64, 65, 128, 130, 1000])) for i in range(2000)] + [(5000, None), (1, 30)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens long").repartition(5).withColumn("length", F.lit("clash"))
    rows = packing.pack(df, 64).collect()
    load, pieces = Counter(), defaultdict(list)
    for r in rows:
        load[r.container] += r.n_tokens
        pieces[r.doc_id].append((r.piece, r.first_token, r.n_tokens))
    assert max(load.values()) <= 64
    for i, own in pieces.items():
        if i != 1:
            n = dict(sizes)[i] or 0
            own.sort()
            assert [p for p, *_ in own] == list(range(max(1, -(-n // 64)))) and sum(k for *_, k in own) == n and all(f == 64 * p for p, f, _ in own)
    total = sum(n or 0 for _, n in sizes)
    assert -(-total // 64) <= len([c for c, n in load.items() if n]) <= first_fit([n for own in pieces.values() for *_, n in own], 64)
    assert packing.pack(df.limit(0), 64).count() == 0 and packing.pack(df.where("n_tokens = 0"), 64).select("container").distinct().count() == 1


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "a" * 100_000), (5, "<|endoftext|>")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in packing.token_counts(df, "doc_id", "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1000 and got[5] > 1


# leakage ---------------------------------------------------------------------------------------------------------


def least_edits(run, doc):
    row = [0] * (len(doc) + 1)
    for i, w in enumerate(run, 1):
        new = [i]
        for j, d in enumerate(doc, 1):
            new.append(min(row[j - 1] + (w != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def leaks(item: str, doc: str) -> bool:
    a, b = leakage.words(item), leakage.words(doc)
    return any(least_edits(a[i : i + n], b) <= n // 10 for n in range(20, len(a) + 1) for i in range(len(a) - n + 1))


def case(rng, vocabulary):
    item = [rng.choice(vocabulary) for _ in range(rng.randrange(18, 50))]
    start, n = rng.randrange(len(item)), rng.randrange(12, 40)
    run = item[start : start + n]
    for _ in range(rng.randrange(6)):
        i = rng.randrange(len(run)) if run else 0
        run[i : i + rng.choice((0, 1))] = rng.choice(([], ["zzz"], ["qqq"]))
    noise = lambda: [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
    return " ".join(item), " ".join(noise() + run + noise())


@pytest.mark.parametrize("size", [12, 300])
def test_leaks_equal_brute_force(spark, size):
    rng = random.Random(size)
    vocabulary = [f"w{i}" for i in range(size)]
    cases = [case(rng, vocabulary) for _ in range(25)]
    items = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "item_id long, text string")
    docs = spark.createDataFrame([(i, t, "x") for i, (_, t) in enumerate(cases)] + [(100, None, ""), (101, "", ""), (102, cases[0][0], "")], "doc_id long, text string, item_id string").repartition(3)
    got = {tuple(r) for r in leakage.leaks(docs, items).collect()}
    expected = {(d, i) for d, text in [*((k, t) for k, (_, t) in enumerate(cases)), (102, cases[0][0])] for i, (t, _) in enumerate(cases) if leaks(t, text)}
    assert got == expected and expected


def test_what_does_not_count(spark):
    words = [f"term{i} spring-loaded{i}" for i in range(14)]
    item = " ".join(words)
    dressed = "\n\n- 12 -\n\n".join([", ".join(words[:7]).upper(), "[0031] " + " ".join(words[7:]).replace("term9", "te-\n  rm9").replace("-loaded12", "-\nloaded12")]).replace("TERM3", "(TERM3)") + "\nPage 3 of 9\n"
    assert leakage.words(dressed) == leakage.words(item)
    df = spark.createDataFrame([(1, "before " * 50 + dressed), (2, " ".join(words[:8])), (3, dressed * 400)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, item), (9, None), (10, "too short"), (11, "")], "item_id long, text string")
    assert {tuple(r) for r in leakage.leaks(df, items).collect()} == {(1, 7), (1, 8), (3, 7), (3, 8)}
    assert leakage.leaks(df, items.limit(0)).count() == 0 and leakage.leaks(df.limit(0), items).count() == 0


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(leakage, "PIECE", 120)
    monkeypatch.setattr(leakage, "SHINGLE_BITS", 8)
    monkeypatch.setattr("kugiri.plans.skew.MOST_ROWS", 0)
    text = [" ".join(f"a{k}b{i}" for i in range(30)) for k in range(6)]
    items = spark.createDataFrame(list(enumerate(text)), "item_id long, text string")
    docs = spark.createDataFrame([(k, f"{t} {text[0]}") for k, t in enumerate(text)], "doc_id long, text string")
    assert {tuple(r) for r in leakage.leaks(docs, items).collect()} == {(k, k) for k in range(6)} | {(k, 0) for k in range(6)}


# quality ---------------------------------------------------------------------------------------------------------

COMMON = "the of and a in is that with der die und eine の は を に と".split()
SENTENCES = ["The lever of the cam is held in a frame with the upper housing, and it turns.", "A second roller guides the belt that is wound on the drum.", "1. An apparatus with a lever and a housing, wherein the cam is fixed.", "Die Welle und eine Kupplung drehen sich in der Halterung."]


def document(rng, kind, n):
    if kind == "prose":
        return [rng.choice(SENTENCES) for _ in range(n)]
    word = lambda: "".join(rng.choice("bdklmnrst") + rng.choice("aeiou") for _ in range(3))
    if kind == "list":
        return [f"{10 + 2 * i}{rng.choice([': ', ' ... ', chr(9), ' '])}{word()} {word()}" for i in range(n)]
    if kind == "table":
        sep = rng.choice([" | ", ",", "\t", "   "])
        return [sep.join([f"r{i}"] + [f"{rng.random() * 99:.2f}" for _ in range(4)]) for i in range(n)]
    if kind == "index":
        return [f"{i // 5 + 1}.{i % 5 + 1} {word()} {'.' * 20} {i * 2}" for i in range(n)]
    w = word()
    return [" ".join([w] * rng.randrange(6, 14)) if n % 2 else "".join(rng.choice("ABCDabcd0123+/") for _ in range(60)) for _ in range(n)]


def test_line_labels_on_made_up_documents():
    rng = random.Random(9)
    model = quality.Model(COMMON)
    right = total = 0
    for kind in ("prose", "list", "table", "index", "junk") * 12:
        bad, good = document(rng, kind, rng.randrange(12, 30)), document(rng, "prose", 2)
        got = {k: int(v[0]) for k, v in model.measure(["A heading\n" + "\n".join(bad + good)]).items() if k.endswith("_chars")}
        worse = got["list_chars"] + got["table_chars"] + got["junk_chars"] > got["prose_chars"]
        right += worse == (kind != "prose")
        total += 1
    assert right / total >= 0.97


def test_statistics(spark):
    texts = ["The cat, the dog.\r\nNo end\n\n", "", None, "猫は庭の木に登った。犬を見た。" * 3, "x" * 300_000, "퟿\U0001f600 ☃\x00\x85", "\n\n\n"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_words string").repartition(2)
    rows = {r.doc_id: r for r in quality.measure(df, COMMON).collect()}
    assert len(rows) == len(texts)
    r = rows[0]
    assert (r.n_words, r.n_lines, r.n_chars) == (6, 2, len(texts[0])) and r.line_end_share == 0.5 and r.common_share == pytest.approx(2 / 6) and r.mean_word_length == pytest.approx(17 / 6 - 1 / 3, abs=0.5)
    assert all(rows[i].prose_chars == rows[i].junk_chars == rows[i].n_words == 0 for i in (1, 2, 6))
    assert rows[3].prose_chars > 0 and rows[4].n_chars == 300_000
    assert {r.doc_id for r in quality.not_prose(quality.measure(df, COMMON)).collect()} & {0, 1, 2, 3, 6} == set()
    assert quality.measure(df.limit(0), COMMON).count() == 0 and quality.measure(df, []).count() == len(texts)


def test_batches_do_not_change_results():
    rng = random.Random(2)
    model = quality.Model(COMMON)
    texts = ["\n".join(document(rng, rng.choice(["prose", "list", "table", "junk"]), rng.randrange(9))) for _ in range(30)]
    together = model.measure(texts)
    for i, t in enumerate(texts):
        alone = model.measure([t])
        assert all(np.isclose(alone[k][0], together[k][i]) for k in alone), i


def test_viterbi_equals_brute_force():
    from itertools import product

    model = quality.Model(COMMON)
    emission = np.random.default_rng(3).normal(size=(9, 5)) * 3
    got = model.label(emission, np.array([4, 0, 5]))
    for start, n in ((0, 4), (4, 5)):
        e = emission[start : start + n]
        score = lambda p: model.start[p[0]] + sum(model.transition[a, b] for a, b in zip(p, p[1:])) + sum(e[i, k] for i, k in enumerate(p))
        assert tuple(got[start : start + n]) == max(product(range(5), repeat=n), key=score)


HELD_OUT = {
    "prose": ["The pump is driven by a motor that is\nmounted on the frame. When the motor is\nstarted the rotor turns and the liquid is\ndrawn in through the inlet.", "I wandered lonely in the wood\nwhere all the paths were old and good\nand in the evening came the rain\nto sing of the quiet sea again"],
    "table": ["city,mayor,since\nOslo,Berg,2011\nRiga,Ozols,2014\nBrno,Novak,2009\nGent,Maes,2017", "load | 12 | 4.5\nspan | 80 | 2.2\ndepth | 31 | 9.1\nwidth | 15 | 7.7"],
    "list": ["\n".join("anchor beacon copper dagger ember falcon garnet hollow ivory jasper kernel".split()), "- two brackets\n- one hinge\n- six screws\n- a wooden board"],
    "junk": ["def add(items, x):\n    result = []\n    for i in items:\n        result.append(i.value + x)\n    return result\n\nprint(add(load('a.json'), 3))", "\n".join(["QmFzZTY0IGVuY29kZWQgZGF0YSB3aXRob3V0IGFueSBibGFua3M9PUJhc2U2NA"] * 5)],
}


def test_labels_of_held_out_texts():
    model = quality.Model(COMMON)
    for label, texts in HELD_OUT.items():
        for text in texts:
            got = model.measure([text])
            chars = {name: int(got[f"{name}_chars"][0]) for name in quality.LABELS}
            assert chars[label] >= 0.75 * sum(chars.values()), (label, text, chars)


def test_expected_labels_equal_enumeration():
    import itertools

    rng = np.random.default_rng(2)
    p = quality.Parameters.given()
    chains = [rng.integers(0, 2, (n, len(quality.EMISSION))).astype(float) for n in (3, 1, 2)]
    labels, moves, first = quality.Fit.expected(p, np.concatenate(chains), np.array([3, 1, 2]))
    expected, steps, starts, at = np.zeros_like(labels), np.zeros_like(moves), np.zeros_like(first), 0
    for c in chains:
        like = np.exp(p.scores(c))
        ways = {w: p.start[w[0]] * np.prod([like[i, k] for i, k in enumerate(w)]) * np.prod([p.transition[a, b] for a, b in zip(w, w[1:])]) for w in itertools.product(range(5), repeat=len(c))}
        total = sum(ways.values())
        for w, v in ways.items():
            starts[w[0]] += v / total
            for i, k in enumerate(w):
                expected[at + i, k] += v / total
            for a, b in zip(w, w[1:]):
                steps[a, b] += v / total
        at += len(c)
    assert np.allclose(labels, expected) and np.allclose(moves, steps) and np.allclose(first, starts)


def test_the_fit_sees_a_bounded_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(i, SENTENCES[i % 4] + "\nnext line of the text") for i in range(400)] + [(900, None), (901, "")], "doc_id long, text string").repartition(5)
    monkeypatch.setattr(quality, "SAMPLE_DOCUMENTS", 50)
    a, b = quality.fit(docs, COMMON), quality.fit(docs.repartition(2), COMMON)
    assert np.allclose(a.emission, b.emission) and np.allclose(a.transition.sum(1), 1) and not np.allclose(a.emission, quality.Parameters.given().emission)
    assert quality.fit(docs.limit(0), COMMON).emission.shape == a.emission.shape


def test_the_fit_counts_the_lines_of_all_documents(spark, monkeypatch):
    rng = random.Random(4)
    texts = ["\n".join(document(rng, rng.choice(["prose", "list", "table", "index", "junk"]), rng.randrange(7))) for _ in range(300)] + [None, "", "\n\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(quality, "SAMPLE_DOCUMENTS", 30)
    got = quality.fit(docs.repartition(5), COMMON)
    other = quality.fit(docs.repartition(2), COMMON)
    # Baum-Welch over every line at once; all lines count a tenth, as 30 documents of about 300 would
    model = quality.Fit(quality.Model(COMMON).labelled(), quality.Parameters.given())
    chains = [c for c in quality.Model(COMMON).chains([t or "" for t in texts]) if len(c)]
    seen, lengths, weight = np.concatenate(chains), np.array([len(c) for c in chains]), 30 / len(texts)
    for _ in range(quality.STEPS):
        labels, moves, first = quality.Fit.expected(model.parameters, seen, lengths)
        model.parameters = model._made(weight * labels.T @ seen, weight * labels.sum(0), weight * moves, weight * first)
    for name in ("emission", "transition", "start"):
        assert np.allclose(getattr(got, name), getattr(model.parameters, name), rtol=0, atol=1e-9), name
        assert np.array_equal(getattr(got, name), getattr(other, name)), name


def test_counts_do_not_depend_on_batches():
    rng = np.random.default_rng(8)
    p = quality.Parameters.given()
    lengths = rng.integers(0, 9, 60)
    codes = rng.integers(0, 1 << len(quality.EMISSION), lengths.sum())
    ends = np.cumsum(lengths)
    alone = sum(quality.Fit.counts(p, codes[e - n : e], np.array([n])) for n, e in zip(lengths, ends))
    assert np.array_equal(quality.Fit.counts(p, codes, lengths), alone)


def test_fitted_statistics_equal_those_of_the_fitted_model(spark):
    rng = random.Random(6)
    texts = ["\n".join(document(rng, rng.choice(["prose", "list", "table", "junk"]), rng.randrange(9))) for _ in range(40)] + [None, "", "\n\n", "x" * 300_000]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "line_codes string, text string").repartition(3)
    expected = quality.measure(docs, COMMON, "line_codes", parameters=quality.fit(docs, COMMON, "line_codes"))
    got = quality.measure_fitted(docs, COMMON, "line_codes")
    assert got.schema == expected.schema and sorted(got.collect()) == sorted(expected.collect())
    assert quality.measure_fitted(docs.limit(0), COMMON, "line_codes").count() == 0
