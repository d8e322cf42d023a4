"""Language model, quality and toxicity: exact parts against brute force, learned parts by held-out accuracy."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from attestor.llm import hmm, quality, queries, toxicity
from attestor.llm.features import Tokens
from tests.llm.conftest import DOC, prose


def test_base_scores_equal_brute_force(spark, odd, odd_rows, nothing):
    cut = [(k, (t or "").encode().lower().split() + [0], zlib.crc32(b"" if k is None else str(k).encode()) % 7 == 2) for k, t, *_ in odd_rows]
    c = Counter()
    for _, w, held in cut:
        if not held:
            c.update(w)
    n, v = sum(c.values()), len(c)
    want = Counter((k, held, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for k, w, held in cut)
    rows = hmm.score(spark, odd, states=2, rounds=1).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == want
    assert all(-1e9 < r["score"] < 0 for r in rows)
    assert hmm.score(spark, nothing).count() == 0


def brute_likelihood(model, symbols):
    total = 0.0
    for path in itertools.product(range(len(model.start)), repeat=len(symbols)):
        p = model.start[path[0]] * model.emit[symbols[0], path[0]]
        for a, b, s in zip(path, path[1:], symbols[1:]):
            p *= model.move[a, b] * model.emit[s, b]
        total += p
    return total


def small_model(states=3, classes=5, seed=0):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    return hmm.Model(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((classes, states)), 0))


def test_forward_is_the_exact_likelihood():
    model, rng = small_model(), random.Random(4)
    sequences = [[rng.randrange(5) for _ in range(n)] for n in (1, 4, 2, 6, 1, 3)]
    got = model.log10(np.concatenate(sequences), np.array([len(s) for s in sequences]))
    assert np.allclose(got, [math.log10(brute_likelihood(model, s)) for s in sequences])


def test_expected_counts_equal_all_paths():
    model, sequences = small_model(2, 4, 1), [[0, 3, 1, 1], [2], [3, 3]]
    counts, moves, first = model.expected(np.concatenate(sequences), np.array([4, 1, 2]))
    want_c, want_m, want_f = np.zeros_like(counts), np.zeros_like(moves), np.zeros_like(first)
    for s in sequences:
        whole = brute_likelihood(model, s)
        for path in itertools.product(range(2), repeat=len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for a, b, x in zip(path, path[1:], s[1:]):
                p *= model.move[a, b] * model.emit[x, b]
            p /= whole
            want_f[path[0]] += p
            for a, x in zip(path, s):
                want_c[x, a] += p
            for a, b in zip(path, path[1:]):
                want_m[a, b] += p
    assert np.allclose(counts, want_c) and np.allclose(moves, want_m) and np.allclose(first, want_f)


def test_training_raises_likelihood_and_beats_the_base(spark):
    rng = random.Random(6)
    rows = [(k, prose(rng, 120, [f"{p}{w}" for w in "ora eni usk alb imp ond".split()]), "en", "s", 0) for k in range(150) for p in [("fi", "zu", "ke")[k % 3]]]
    docs = spark.createDataFrame(rows, DOC).repartition(4)
    held = lambda n: sum(r["score"] for r in hmm.score(spark, docs, states=4, rounds=n).where("held_out").collect())
    scores = [held(n) for n in (0, 1, 4)]
    base = sum(r["base_score"] for r in hmm.score(spark, docs, rounds=0).where("held_out").collect())
    assert scores[0] < scores[1] < scores[2] and scores[2] > base


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rule_counts_equal_brute_force(odd_rows):
    rng = random.Random(9)
    texts = [t or "" for _, t, *_ in odd_rows] + ["".join(rng.choice("ab #\n\t\x0b|é") for _ in range(rng.randint(0, 90))) for _ in range(200)]
    for t in texts:
        assert quality.rule_counts(t) == brute_rules(t)


def labelled(spark, bad, n=480):
    rng = random.Random(8)
    rows = [(k, bad(rng) if k % 4 == 0 else prose(rng, 90), "en", "s", 0) for k in range(n)]
    return rows, spark.createDataFrame(rows, DOC).repartition(4), spark.createDataFrame([(k, int(k % 4 > 0), int(k % 4 == 0)) for k in range(n // 2)] + [(None, 1, 0), (10**6, 0, 1), (300, None, None)], "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark, odd, odd_rows, nothing):
    rows, docs, labels = labelled(spark, lambda rng: " ".join(w + rng.choice(["!!", "$$$", "###"]) for w in prose(rng, 90).split()))
    model = quality.train(spark, docs, labels)
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    wrong = [k for k in range(240, 480) if got[k]["kept"] != (k % 4 > 0)]
    assert len(wrong) <= 1 and all(0 <= r["probability"] <= 1 for r in got.values())
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.keep_good(docs, model).count() == sum(r["kept"] for r in got.values())
    few = quality.score(odd, model).collect()
    assert len(few) == len(odd_rows) and all(r["base_failed"] for r in few if r["n_words"] == 0)
    assert quality.keep_good(odd, model).columns == odd.columns
    unlabelled = quality.train(spark, docs, labels.where("false"))
    assert quality.score(docs, unlabelled).where("kept or base_failed").count() == 480
    assert quality.score(nothing, model).count() == 0


def test_features_do_not_depend_on_the_batch():
    texts = [b"One two, THREE", b"", b"x\n\ny z", "é ü".encode()]
    whole = Tokens(texts)
    for k, t in enumerate(texts):
        assert (Tokens([t]).words == whole.words[whole.text == k]).all()


def test_toxicity_on_held_out_rows(spark, odd, odd_rows, nothing):
    rows, docs, labels = labelled(spark, lambda rng: prose(rng, 60) + " " + " ".join(rng.choice(["grumbok", "snarlip", "vileth"]) for _ in range(rng.randint(1, 5))) + " " + prose(rng, 30))
    model = toxicity.train(spark, docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert sum(got[k]["toxic"] != (k % 4 == 0) for k in range(240, 480)) == 0
    many = [r["severity"] for k, r in got.items() if k % 4 == 0 and sum(w in ("grumbok", "snarlip", "vileth") for w in rows[k][1].split()) >= 4]
    one = [r["severity"] for k, r in got.items() if k % 4]
    assert min(many) > max(one) and all(0 <= r["severity"] <= toxicity.GRADES for r in got.values())
    assert toxicity.score(odd, model).count() == len(odd_rows) and not toxicity.score(odd, model).where("toxic").count()
    assert toxicity.score(docs, toxicity.train(spark, docs, labels.where("toxic = 0"))).where("toxic").count() == 0
    assert toxicity.score(nothing, model).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_toxicity_catches_what_few_labels_show(spark, sf):
    """87 and 399 labels, 11 and 51 of them toxic."""
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    found = queries.op8_toxicity(spark, f"/root/testdata/{sf}").join(labels.select("doc_id", "toxic").toDF("doc_id", "label"), "doc_id").collect()
    share = lambda rows, test: sum(map(test, rows)) / len(rows)
    assert share([r for r in found if r["label"]], lambda r: r["grade"] > 0) >= 0.9
    assert share([r for r in found if not r["label"]], lambda r: r["grade"] == 0) >= 0.98


def test_toxicity_scores_equal_brute_force(spark, odd_rows):
    rows, docs, labels = labelled(spark, lambda rng: prose(rng, 60) + " " + " ".join(rng.choice(["grumbok", "snarlip", "vileth"]) for _ in range(rng.randint(1, 5))))
    model = toxicity.train(spark, docs, labels)
    texts = [t for _, t, *_ in rows[:60]] + [t for _, t, *_ in odd_rows]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score(frame, model).collect():
        words = {w.strip(".,;:!?\"'()[]{}*#$%&|<>-_") for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[r["doc_id"]] or ""))} - {""}
        found = {f for w in words for f in [f"={w}"] + [f"^{w[:n]}" for n in (3, 4, 5, 6) if len(w) > n]}
        margin = sum(model.weights[model.features[f]] for f in found if f in model.features)
        above = [1 - 1 / (1 + math.exp(-(cut - margin))) for cut in model.thresholds]
        assert r["severity"] == pytest.approx(sum(above)) and r["p_toxic"] == pytest.approx(above[0]) and r["toxic"] == (above[0] >= 0.5) and r["grade"] == sum(x >= 0.5 for x in above)


def test_ordinal_fit_is_the_optimum():
    rng = np.random.default_rng(2)
    rows = [sorted(set(rng.integers(0, 6, rng.integers(0, 5)).tolist())) for _ in range(120)]
    grade = np.array([min(3, max(0, len(r) + rng.integers(-1, 2))) for r in rows])

    def loss(w, cuts):
        total = 0.05 / 2 * sum(x * x for x in w)
        for r, g in zip(rows, grade):
            below = [0.0] + [1 / (1 + math.exp(-(c - sum(w[k] for k in r)))) for c in cuts] + [1.0]
            total -= math.log(below[g + 1] - below[g])
        return total / len(rows)

    w, cuts = toxicity.fit_ordinal(rows, grade, 6, steps=3000, penalty=0.05)
    for _ in range(60):
        assert loss(w, cuts) <= loss(w + rng.normal(0, 0.02, 6), cuts + rng.normal(0, 0.02, 3)) + 1e-7


def test_ordinal_thresholds_rise_and_order_grades():
    rows, grade = [[], [0], [0, 1], [0, 1, 2]] * 40, np.array([0, 1, 2, 3] * 40)
    w, cuts = toxicity.fit_ordinal(rows, grade, 3)
    p = toxicity.ToxicityModel({}, w, cuts).probabilities(rows[:4])
    assert (np.diff(cuts) > 0).all() and (np.diff(p @ np.arange(4)) > 0).all() and np.allclose(p.sum(1), 1)
