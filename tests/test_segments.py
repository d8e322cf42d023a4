"""The segmented index against the plain definition of BM25, and against itself built at once."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from attestor.operators import ranking, segments
from attestor.operators.segments import SegmentedIndex

WORDS = [f"w{int(k**1.6)}" for k in range(1, 60)]


def corpus(rng, n, start=0):
    """Chunks whose words are used very unevenly."""
    rows = []
    for k in range(start, start + n):
        text = " ".join(WORDS[min(len(WORDS) - 1, int(rng.expovariate(0.12)))] for _ in range(rng.randrange(0, 40)))
        rows.append((f"c{k:05d}", f"label{k // 4}", text, f"{hash(text) & 0xFFFFFF:06x}"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_key string, label string, text string, content_hash string")


def asked(rng, n):
    rows = [(k, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 9)))) for k in range(n)]
    return [*rows, (1000, ""), (1001, "nosuchword"), (1002, "w1 w1 w1 w3")]


def plain(rows, questions, k1=1.5, b=0.75):
    tok = {key: text.split() for key, _, text, _ in rows}
    n, avgdl = len(tok), sum(map(len, tok.values())) / len(tok)
    df = Counter(t for ws in tok.values() for t in set(ws))
    out = {}
    for qid, q in questions:
        for key, ws in tok.items():
            c = Counter(ws)
            s = sum(times * math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * len(ws) / avgdl)) for t, times in Counter(q.split()).items() if c[t])
            if round(s, 9) > 0:
                out[qid, key] = s
    return out


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(segments, "SHARD", 60)
    monkeypatch.setattr(segments, "BLOCK", 4)
    monkeypatch.setattr(segments, "QUESTIONS", 10)


def near(found, wanted):
    assert found.keys() == wanted.keys()
    assert all(abs(found[k] - wanted[k]) < 1e-6 for k in wanted)


def test_scores_top_and_confidence_equal_plain_python(spark, tmp_path, small):
    rng = random.Random(1)
    rows, questions = corpus(rng, 300), asked(rng, 40)
    q = spark.createDataFrame(questions, "qid long, question string")
    index = SegmentedIndex(spark, f"file://{tmp_path}/i")
    for at in range(0, 300, 100):
        index.append(frame(spark, rows[at : at + 100]), merge=False)
    want = plain(rows, questions)
    near({(r.qid, r.chunk_key): r.bm25 for r in index.scores(q).collect()}, want)
    for k in (1, 7, 500):
        top = {}
        for qid in {q for q, _ in want}:
            best = sorted((-round(s, 9), key) for (other, key), s in want.items() if other == qid)[:k]
            top |= {(qid, key): (-s, place) for place, (s, key) in enumerate(best, 1)}
        found = {(r.qid, r.chunk_key): (r.bm25, r.rank) for r in index.search(q, k).collect()}
        assert found.keys() == top.keys()
        assert all(abs(found[x][0] - top[x][0]) < 1e-6 and found[x][1] == top[x][1] for x in top)
    by_rows = {r.qid: r.confidence for r in ranking.lexical_confidence(index.scores(q)).collect()}
    near({r.qid: r.confidence for r in index.confidence(q).collect()}, by_rows)


def test_appends_and_merges_equal_a_rebuild(spark, tmp_path, small):
    rng = random.Random(2)
    rows = corpus(rng, 500)
    q = spark.createDataFrame(asked(rng, 12), "qid long, question string")
    grown, whole = SegmentedIndex(spark, f"file://{tmp_path}/a"), SegmentedIndex(spark, f"file://{tmp_path}/b")
    for at in range(0, 500, 100):
        grown.append(frame(spark, rows[max(0, at - 20) : at + 100]))  # five labels again, left out
    whole.append(frame(spark, rows))
    assert sorted(r["level"] for r in grown.live()) == [0, 1] and len(whole.live()) == 1
    assert sum(r["n"] for r in grown.live()) == 500
    assert [tuple(r) for r in grown.fingerprint().collect()] == [tuple(r) for r in whole.fingerprint().collect()]
    for kind in ("scores", "search"):
        got, want = ({(r.qid, r.chunk_key): r.bm25 for r in (getattr(i, kind)(q) if kind == "scores" else i.search(q, 5)).collect()} for i in (grown, whole))
        near(got, want)
    assert grown.fingerprint().first().n_labels == 125


def test_an_append_reads_no_old_postings_and_may_be_tried_again(spark, tmp_path, small):
    rng = random.Random(3)
    rows = corpus(rng, 120)
    index = SegmentedIndex(spark, f"file://{tmp_path}/i")
    first = index.append(frame(spark, rows[:60]))
    hidden = tmp_path / "hidden"
    (tmp_path / "i" / "shards" / first).rename(hidden)  # whoever reads it fails
    index.append(frame(spark, rows[60:]), name="second")
    hidden.rename(tmp_path / "i" / "shards" / first)
    manifest = tmp_path / "i" / "manifest"
    assert index.append(frame(spark, rows[:4]), name="second") == "second" and len(index.live()) == 2
    # an append that died before its manifest row was written: its files don't count, and it may run again
    before = set(manifest.iterdir())
    index.append(frame(spark, corpus(rng, 8, 200)), name="third")
    for f in set(manifest.iterdir()) - before:
        f.unlink()
    index = SegmentedIndex(spark, index.root)
    assert len(index.live()) == 2
    index.append(frame(spark, corpus(rng, 8, 200)), name="third")
    assert sum(r["n"] for r in index.live()) == 128


def test_fingerprint_tells_changes_and_ignores_order(spark, tmp_path, small):
    rng = random.Random(4)
    rows = corpus(rng, 80)
    prints = []
    for k, variant in enumerate((rows, rows[::-1], rows[:-1], [*rows[:-1], (*rows[-1][:3], "other")])):
        index = SegmentedIndex(spark, f"file://{tmp_path}/{k}")
        index.append(frame(spark, variant))
        prints.append(index.fingerprint().first().fingerprint)
    assert prints[0] == prints[1] and len(set(prints)) == 3


def test_few_postings_are_scored_and_no_pair_is_shuffled(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    common, rare = [f"c{k}" for k in range(6)], [f"r{k}" for k in range(400)]
    rows = [(f"k{k:05d}", f"l{k}", " ".join(rng.choice(common) for _ in range(20)) + " " + " ".join(rng.choice(rare) for _ in range(3)), "x") for k in range(6000)]
    q = spark.createDataFrame([(k, f"c0 c1 c2 r{k} r{k + 1} r{k + 2}") for k in range(50)], "qid long, question string")
    index = SegmentedIndex(spark, f"file://{tmp_path}/i")
    index.append(frame(spark, rows))
    cost = index.cost(q, 10).first()
    assert cost.scored < cost.matched / 10
    plan = index.search(q, 10)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(qid" in plan and "chunk_key#" not in "".join(line for line in plan.splitlines() if "hashpartitioning(qid" in line and "chunk_key" in line.split("hashpartitioning", 1)[1].split(")")[0])
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_an_empty_index_and_empty_segments(spark, tmp_path):
    index = SegmentedIndex(spark, f"file://{tmp_path}/i")
    q = spark.createDataFrame([(1, "w1")], "qid long, question string")
    assert index.search(q, 3).count() == 0 and index.fingerprint().first().n_labels == 0
    index.append(frame(spark, []))
    assert index.search(q, 3).count() == 0 and index.scores(q).count() == 0 and index.confidence(q).count() == 0
    assert index.search(q.where(F.lit(False)), 3).count() == 0


def test_fingerprint_of_many_labels_has_one_level_of_inner_nodes(spark, tmp_path):
    import hashlib

    index = SegmentedIndex(spark, f"file://{tmp_path}/i")
    leaves = [(f"l{k}", 1, f"{k:x}") for k in range(66_000)]  # more than 256 labels for each of 256 nodes
    spark.createDataFrame(leaves, segments.LABELS).write.parquet(f"{index.root}/labels/one")
    index._rows = [dict(segment="one", level=0, n=66_000, length=0, replaces=[])]
    sha, nodes = lambda x: hashlib.sha256(x.encode()).hexdigest(), {}
    for label, n, h in leaves:
        nodes.setdefault(hashlib.sha1(label.encode()).hexdigest()[:2], []).append(f"{label}:{n}:{h}")
    assert index.fingerprint().first().fingerprint == sha("\n".join(sorted(sha("\n".join(sorted(x))) for x in nodes.values())))


def test_what_is_gathered_inside_shards_equals_plain_ranking_of_all_pairs(spark, tmp_path, small):
    rng = random.Random(6)
    rows, questions = corpus(rng, 260), asked(rng, 25)
    drugs, codes = ["A", "b", None], ["1", "2", "3"]
    own = {key: (rng.choice(drugs), rng.choice(codes), None if rng.random() < 0.1 else [rng.randrange(3) / 2, rng.randrange(3) / 2]) for key, *_ in rows}
    wanted = {q: (rng.choice([None, [], ["a"], ["b", "a"]]), rng.sample(codes, rng.randrange(0, 3)), [1.0, 0.5]) for q, _ in questions}
    full = spark.createDataFrame([(*r, *own[r[0]]) for r in rows], "chunk_key string, label string, text string, content_hash string, drug string, loinc string, vector array<double>")
    q = spark.createDataFrame([(*x, *wanted[x[0]]) for x in questions], "qid long, question string, drugs array<string>, loincs array<string>, vector array<double>")
    score = {k: round(v, 9) for k, v in plain(rows, questions).items()}
    grown = SegmentedIndex(spark, f"file://{tmp_path}/i")
    for at in range(0, 260, 68):  # whole labels
        grown.append(full.where(F.col("chunk_key").between(f"c{at:05d}", f"c{at + 67:05d}")))
    assert [r["level"] for r in grown.live()] == [1]
    for soft, dense in ((True, True), (True, False), (False, True)):
        found = {}
        for r in grown.gather(q if dense else q.drop("vector"), top=4, inside=6, soft=soft).where("part = 'inside'").collect():
            found.setdefault(r.qid, []).append((r.tier, -r.dense, -r.bm25, r.chunk_key))
        for qid, _ in questions:
            names, loincs, v = wanted[qid]
            want = []
            for key, (drug, code, w) in own.items():
                tier = 0 if code in loincs else 1 if soft else None
                if tier is not None and (not names if soft else names is None) or tier is not None and drug is not None and (drug.lower() if soft else drug) in (names or ()):
                    want.append((tier, -(sum(x * y for x, y in zip(v, w)) if dense and w else 0.0), -score.get((qid, key), 0.0), key))
            got = sorted(found.get(qid, []))[:6]
            assert [x[3] for x in got] == [x[3] for x in sorted(want)[:6]]
    totals = {r.qid: (r.n_scored, r.total) for r in grown.totals(q).collect()}
    for qid in {k for k, _ in score}:
        n, total = sum(k == qid for k, _ in score), sum(v for (k, _), v in score.items() if k == qid)
        assert totals[qid][0] == n and abs(totals[qid][1] - total) < 1e-6
    texts = {key: set(text.split()) for key, _, text, _ in rows}
    matched = {}
    for r in grown.matches(q, 3).collect():
        matched.setdefault(r.qid, []).append((r["rank"], r.chunk_key, r.score))
    for qid, question in questions:
        best = sorted((-len(set(question.split()) & t), key) for key, t in texts.items() if set(question.split()) & t)[:3]
        assert [(k, n) for _, k, n in sorted(matched.get(qid, []))] == [(k, -n) for n, k in best]


def test_a_merge_cuts_a_shard_into_few_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "SHARD", 4)
    rng, cuts = random.Random(7), []
    rows = corpus(rng, 400)
    index = SegmentedIndex(spark, f"file://{tmp_path}/i")
    for at in range(0, 400, 100):
        index.append(frame(spark, rows[at : at + 100]), merge=False)
    old = {(r.segment, k): r.shard for r in index.docs().collect() for k in r["keys"]}
    index.merge()
    new = {k: r.shard for r in index.docs().collect() for k in r["keys"]}
    for piece in set(old.values()):
        cuts.append(len({new[k] for (_, k), shard in old.items() if shard == piece}))
    assert max(cuts) <= 8 and len(new) == 400


def test_postings_of_other_terms_are_not_shuffled(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    index = SegmentedIndex(spark, f"file://{tmp_path}/i")
    index.append(frame(spark, corpus(rng, 200)))
    q = spark.createDataFrame(asked(rng, 20), "qid long, question string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        small, plan = index.search(q, 5), lambda df: df._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(segments, "WANTED", 0)
        large = index.search(q, 5)
        shuffled = [line for line in plan(small).splitlines() if "Exchange hashpartitioning(term#" in line]
        assert "BroadcastHashJoin [term#" in plan(small) and "SortMergeJoin [term#" in plan(large)
        assert len(shuffled) < plan(large).count("Exchange hashpartitioning(term#")
        assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
