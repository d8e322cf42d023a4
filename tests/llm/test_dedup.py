"""Substring and near-duplicate removal against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import xxhash

from attestor.llm import components, phrases, simhash
from attestor.llm.common import Scratch


def brute_passages(rows, window):
    starts = Counter()
    cut = [(k, (t or "").encode().split()) for k, t, *_ in rows]
    for _, w in cut:
        starts.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = Counter()
    for key, w in cut:
        gone = bytearray(len(w))
        for i in range(len(w) - window + 1):
            if starts[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = b"\1" * window
        kept = [x for x, g in zip(w, gone) if not g]
        out[key, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()] += 1
    return out


def test_passages_equal_brute_force(spark, odd, odd_rows):
    for window, shingle in ((35, 8), (5, 2)):
        got = phrases.remove_repeats(spark, odd, window=window, shingle=shingle, digest_id="doc_id")
        assert Counter(map(tuple, got.collect())) == brute_passages(odd_rows, window)


def test_passages_of_random_word_salads(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))), "en", "s", 0) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = phrases.remove_repeats(spark, docs, window=9, shingle=3, digest_id="doc_id")
    assert Counter(map(tuple, got.collect())) == brute_passages(rows, 9)


def test_shards_find_what_one_automaton_finds(monkeypatch):
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 3, 3000)
    bounds, starts = np.array([0, 1000, 1003, 3000]), np.arange(0, 900, 7)
    one = phrases.locate(codes, bounds, starts, 6)
    monkeypatch.setattr(phrases, "SHARD", 10)
    assert (phrases.locate(codes, bounds, starts, 6) == one).all() and one.any()


def test_removal_keeps_columns_and_clean_texts(spark, odd, odd_rows, nothing):
    got = phrases.remove_repeats(spark, odd)
    assert got.columns == odd.columns and got.count() == len(odd_rows)
    texts = {r["doc_id"]: r["text"] for r in got.where("doc_id in (1, 2, 9, 10, 13)").collect()}
    assert texts == {k: odd_rows[k][1] for k in (1, 2, 9, 10, 13)}
    assert got.where("doc_id is null and text is null").count() == 1
    assert phrases.remove_repeats(spark, nothing).count() == 0


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    """Least index reachable, by comparing all."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= simhash.RADIUS:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(prints))]


def test_simhash_equals_brute_force(spark, odd, odd_rows, nothing):
    prints = [brute_fingerprint(t) for _, t, *_ in odd_rows]
    found, least = classes(prints), {}
    for k, c in enumerate(found):
        least[c] = min([x for x in (least.get(c), odd_rows[k][0]) if x is not None], default=None)
    want = Counter((odd_rows[k][0], p, least[found[k]]) for k, p in enumerate(prints))
    got = Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(spark, odd).collect())
    assert got == want
    assert simhash.near_duplicates(spark, nothing).count() == 0


def chained(n, rng):
    """Fingerprints in chains of few changed bits, ties and repeats."""
    out = []
    for _ in range(n):
        if out and rng.random() < 0.7:
            x = rng.choice(out)
            for b in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << b
            out.append(x)
        else:
            out.append(rng.getrandbits(64))
    return sorted(set(out))


def test_links_join_what_brute_force_joins(spark, monkeypatch):
    for bucket in (1 << 15, 4):  # the second sends most buckets to the blocks of the heavy ones
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        prints = chained(250, random.Random(bucket))
        frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long").selectExpr("fp as node", "fp", "0L as more").repartition(3)
        links = simhash.links_of(frame, Scratch(spark, "test"))
        roots = dict(components.connected(links, Scratch(spark, "test")).collect())
        sign = lambda x: x - (1 << 64) if x >> 63 else x
        by = {}
        for k, c in enumerate(classes(prints)):
            by.setdefault(c, set()).add(sign(prints[k]))
        mine = {}
        for x in map(sign, prints):
            mine.setdefault(roots.get(x, x), set()).add(x)
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, by.values()))


def test_golay_keys_meet_within_two_bits():
    rng = random.Random(1)
    for s, n in simhash.SEGMENTS:
        a = np.array([rng.getrandbits(n) for _ in range(300)], np.int64)
        b = a.copy()
        for k in range(len(b)):
            for bit in rng.sample(range(n), rng.randint(0, 2)):
                b[k] ^= 1 << bit
        x, y = simhash.segment_keys(a, n), simhash.segment_keys(b, n)
        assert all(set(p[p >= 0]) & set(q[q >= 0]) for p, q in zip(x, y))


def test_one_of_each_group_stays(spark, odd, nothing):
    kept = simhash.keep_one(spark, odd)
    assert kept.columns == odd.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert 3 in ids and 4 not in ids and ids.count(6) == 1 and 9 in ids
    assert simhash.keep_one(spark, nothing).count() == 0


def brute_similar(texts, similarity):
    sets = [set(map(int, simhash.shingles_of(t.encode(), 5))) for t in texts]
    return {(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])}


def roots(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def near_texts(seed, n, length):
    from tests.llm.conftest import prose

    rng = random.Random(seed)
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            w = rng.choice(out).split(" ")
            for _ in range(rng.randint(0, max(1, length // 30))):
                w[rng.randrange(len(w))] = f"new{rng.randint(0, 10**6)}"
            out.append(" ".join(w))
        else:
            out.append(prose(rng, length))
    return out


def test_similar_sets_equal_brute_force():
    texts = near_texts(3, 80, 100)
    links = simhash.similar_links(list(range(80)), [simhash.shingles_of(t.encode(), 5) for t in texts], 0.8)
    want = brute_similar(texts, 0.8)
    assert roots(80, links) == roots(80, want) and len(links) < len(want) and all((max(p), min(p)) in want for p in links)


def test_near_copies_go_and_others_stay(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 16)  # several blocks for the large group
    texts = near_texts(4, 150, 120)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    kept = {r["doc_id"] for r in simhash.keep_one(spark, docs).collect()}
    prints = [brute_fingerprint(t) for t in texts]
    want = brute_similar(texts, 0.8) | {(i, j) for i in range(150) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= simhash.RADIUS}
    groups = roots(150, want)
    least = {min(k for k in range(150) if groups[k] == g) for g in set(groups)}
    found = 150 - len(kept)
    assert found >= 0.95 * (150 - len(least)) and kept >= {k for k in range(150) if groups.count(groups[k]) == 1}


def test_passage_edits_are_linked_as_by_brute_force(spark, monkeypatch):
    """One appended, cut or replaced passage at a Jaccard similarity near 0.8; also with all groups regrouped."""
    rng, texts = random.Random(6), []
    for _ in range(25):
        w = [f"w{rng.randint(0, 10**9)}" for _ in range(200)]
        new = [f"n{rng.randint(0, 10**9)}" for _ in range(60)]
        a, n = rng.randint(0, 160), rng.randint(12, 22)
        texts += [" ".join(x) for x in (w, w + new[: rng.randint(40, 56)], w[: rng.randint(155, 170)], w[:a] + new[:n] + w[a + n :])]
    want = brute_similar(texts, 0.8)
    assert 40 < len(want) < 75
    frame = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(4)
    for large in (64, 1):
        monkeypatch.setattr(simhash, "LARGE", large, raising=False)
        scratch = Scratch(spark, f"passages{large}")
        links = [tuple(r) for r in simhash.similar(spark, frame, scratch).collect()]
        assert roots(100, links) == roots(100, want)


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(5)
    for n in range(1, 200):
        x = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        y = np.sort(rng.permutation(x)[: max(1, int(np.ceil(0.8 * n - 1e-9)))])
        rank = lambda s: (s % np.uint64(7) // np.uint64(2)).astype(np.int8)
        assert set(simhash.prefix_of(x, rank(x), 0.8).tolist()) & set(simhash.prefix_of(y, rank(y), 0.8).tolist())


def test_texts_of_a_fingerprint_group_are_compared_themselves(spark):
    """a and b link by fingerprint, c is like b but not like a, the first row of the group."""
    for seed in range(1000):
        rng = random.Random(seed)
        w = [f"w{rng.randint(0, 10**9)}" for _ in range(300)]
        b = w.copy()
        b[100], b[200] = "changed", "words"
        texts = [" ".join(x) for x in (w, b, b + [f"n{rng.randint(0, 10**9)}" for _ in range(73)])]
        p = [brute_fingerprint(t) for t in texts]
        if (p[0] ^ p[1]).bit_count() <= simhash.RADIUS < min((p[0] ^ p[2]).bit_count(), (p[1] ^ p[2]).bit_count()):
            break
    assert brute_similar(texts, 0.8) == {(1, 0), (2, 1)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert [r["doc_id"] for r in simhash.keep_one(spark, docs).collect()] == [0]
