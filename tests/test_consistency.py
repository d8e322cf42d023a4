"""Pairs of names by kind, counted without pairing all names; the words of warnings."""

import random

import pytest

from attestor.operators import consistency


@pytest.fixture(scope="module")
def said(spark):
    rng = random.Random(1)
    names = [f"n{k}" for k in range(30)]
    pairs = {(rng.choice(names + ["stranger"]), rng.choice(names)) for _ in range(150)}
    rows = [(a, b, rng.choice(["warn", "mention"])) for a, b in sorted(pairs) if a != b]
    return spark.createDataFrame(rows, "speaker string, about string, label string"), spark.createDataFrame([(n, n) for n in names], "drug string, name string")


def test_counts_by_kind_equal_all_pairs(said):
    wanted = {r.kind: r["count"] for r in consistency.pairs(*said).groupBy("kind").count().collect()}
    counts = consistency.kind_counts(*said)
    assert {r.kind: r.n for r in counts.collect()} == wanted and sum(wanted.values()) == 30 * 29
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_side_says_anything(spark, said):
    none = said[0].where("label = 'x'")
    assert {r.kind: r.n for r in consistency.kind_counts(none, said[1]).collect()} == {"both_absent": 870}
    assert consistency.kind_counts(none, said[1].where("drug = 'x'")).count() == 0


def test_words_of_warnings_and_headers_of_tables(spark):
    lines = ["Avoid aldorin.", "Reduce aldorin by half.", "Reduce aldorin and, some time later than thirty letters, by half.", "Aldorin is fine.", "There is a risk of sleep with ALDORIN.", "Table 3 Avoid aldorin.", "Avoidance of aldorin.", "It is Contraindicated with aldorin."]
    rows = [(f"s{k}", f"{k:04d}", "Warnings", text) for k, text in enumerate(lines)]
    sentences = spark.createDataFrame(rows, "speaker string, ord string, section string, sentence string")
    names = spark.createDataFrame([("aldorin", "Aldorin")], "drug string, name string")
    labels = {r.speaker: r.label for r in consistency.sides(sentences, names).collect()}
    assert labels == {"s0": "warn", "s1": "warn", "s2": "mention", "s3": "mention", "s4": "warn", "s5": "mention", "s6": "mention", "s7": "mention"}
