"""The dense list against all products, and how much a task holds."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from attestor.operators import ranking


def frames(spark, q, v, own=True, parts=False):
    asked = spark.createDataFrame([(k, f"v{k:05d}" if own else None, None if x is None else [float(y) for y in x]) for k, x in enumerate(q)], "qid long, own string, vector array<double>")
    rows = [(f"v{k:05d}", None if x is None else [float(y) for y in x], f"p{k % 3}") for k, x in enumerate(v)]
    held = spark.createDataFrame(rows, "chunk_key string, vector array<double>, part string")
    return asked, held if parts else held.drop("part")


def plain(q, v, k, own=True, part=lambda at: 0):
    out = {}
    for a, x in enumerate(q):
        if x is None:
            continue
        by = {}
        for at, y in enumerate(v):
            if y is not None and not (own and a == at):
                by.setdefault(part(at), []).append((-round(float(np.dot(x, y)), 9), f"v{at:05d}"))
        for best in by.values():
            out |= {(a, key): (n, -s) for n, (s, key) in enumerate(sorted(best)[:k], 1)}
    return out


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(ranking, "QUERY_BLOCK", 7)
    monkeypatch.setattr(ranking, "VECTOR_SHARD", 20)
    monkeypatch.setattr(ranking, "STEP", 6)


@pytest.mark.parametrize("kind", ["random", "clustered", "whole", "zero"])
def test_dense_top_equals_all_products(spark, small, kind):
    rng = np.random.default_rng(len(kind))
    v = rng.normal(size=(90, 12))
    if kind == "clustered":
        v = v[:5][rng.integers(0, 5, 90)] + 1e-4 * v
    elif kind == "whole":
        v = rng.integers(-2, 3, (90, 12)).astype(float)  # many ties
    elif kind == "zero":
        v[::3] = 0
    v, q = [None if k == 40 else x for k, x in enumerate(v)], [None if k == 4 else x for k, x in enumerate(v[:25])]
    for parts in (False, True):
        asked, held = frames(spark, q, v, parts=parts)
        for k in (1, 5, 200):
            found = {(r.qid, r.chunk_key): (r["rank"], r.dense) for r in ranking.dense_top(asked, held, k).collect()}
            want = plain(q, v, k, part=(lambda at: at % 3) if parts else (lambda at: 0))
            assert found.keys() == want.keys()
            assert all(found[x][0] == want[x][0] and abs(found[x][1] - want[x][1]) < 1e-8 for x in want)


def test_bounds_hold(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 40)) * np.exp(rng.normal(size=(300, 1)) * 3)
    rows = spark.createDataFrame([(k, [float(y) for y in x]) for k, x in enumerate(v)], "k long, vector array<double>")
    table = ranking.coded(rows).orderBy("k").toArrow()
    codes = ranking.Codes(table)
    near, off = ranking.bounded(codes, codes, slice(0, 300))
    assert (np.abs(v @ v.T - near) <= off).all()


def test_fifty_thousand_questions(spark):
    rng = np.random.default_rng(1)
    q, v = rng.normal(size=(50_000, 8)), rng.normal(size=(400, 8))
    asked, held = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(q)], "qid long, vector array<double>"), frames(spark, [], v)[1]
    top = {(r.qid, r["rank"]): r.chunk_key for r in ranking.dense_top(asked, held, 3).collect()}
    order = np.argsort(-np.round(q @ v.T, 9), axis=1, kind="stable")[:, :3]
    assert len(top) == 150_000
    assert all(top[a, n + 1] == f"v{order[a, n]:05d}" for a in range(0, 50_000, 97) for n in range(3))


def test_a_full_block_and_shard_take_little_memory():
    rng = np.random.default_rng(2)

    def codes(n):
        code = rng.integers(-127, 128, (n, 64)).astype(np.int8)
        ones = np.full(n, 0.01)
        return ranking.Codes(pa.table({"code": pa.array([c.tobytes() for c in code], pa.binary()), "scale": ones, "loss": ones / 10, "size": np.ones(n)}))

    asked, rows = codes(ranking.QUERY_BLOCK), codes(ranking.VECTOR_SHARD)
    keys = np.array([f"v{k}" for k in range(ranking.VECTOR_SHARD)], object)
    tracemalloc.start()
    found = sum(len(x[0]) for x in ranking.contenders(asked, np.array([None] * ranking.QUERY_BLOCK, object), rows, keys, 100))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found >= 100 * ranking.QUERY_BLOCK and peak < 300 << 20


def test_documents_that_hold_an_item_are_found_by_shared_words(spark):
    from attestor.operators import metrics

    docs = ["xx one two three four fiveyy", "one two three four five", "one  two three four five", "onetwo three four five", "a b", "zone two three four fives one two three four five", None, ""]
    items = [(1, "one two three four five"), (2, "e two three four f"), (3, "b"), (4, "one two three\nfour five"), (5, None), (6, " two three four five")]
    d = spark.createDataFrame(list(enumerate(docs)), "k long, whole string")
    found = {(r.qid, r.k) for r in metrics.holding(spark.createDataFrame(items, "qid long, item string"), d).collect()}
    assert found == {(q, k) for q, i in items for k, t in enumerate(docs) if i is not None and t is not None and i in t}
    long_only = metrics.holding(spark.createDataFrame(items[:2], "qid long, item string"), d)
    assert "NestedLoop" not in long_only._jdf.queryExecution().executedPlan().toString()
