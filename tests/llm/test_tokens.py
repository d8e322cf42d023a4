"""Packing and byte-level BPE against the libraries' own results."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from attestor.llm import bpe, packing

WORD, RANKS = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def strange(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(" \n\tab'st1é.,!日ΣİÅ　 A") for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_segment_tree_equals_the_library(library):
    own = bpe.SegmentTreeBpe(bpe.read_ranks(RANKS), public_tokenizers.PATTERN, cache_size=50)
    for texts in (strange(1, 300), strange(2, 300), ["x" * 5000, "ab" * 3000, "", " ", "<|endoftext|>", "a  b", " a", "a ", "\n\na"]):
        ids = own.encode(texts)
        assert ids == [np.array(library.encode_ordinary(t), "<u4").tobytes() for t in texts]
        assert [own.decode(x).decode() for x in ids] == texts


def test_digests_of_odd_rows(odd, odd_rows, library):
    got = Counter(map(tuple, bpe.digest_documents(odd, RANKS, public_tokenizers.PATTERN).collect()))
    want = Counter()
    for key, text, *_ in odd_rows:
        ids = np.array(library.encode_ordinary(text or ""), "<u4").tobytes()
        want[key, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert got == want


def test_word_encoder_equals_the_library():
    own, other = packing.WordEncoder(WORD, cache_size=60), Tokenizer.from_file(WORD)
    for texts in (strange(3, 200), strange(4, 200), ["", "É. École, ΑΣ", "x" * 3000, "it's they'll", "<|endoftext|> a", "a-b c.d, e", "\u0958. \u0130, \u212b."]):
        assert own.encode([t.encode() for t in texts]) == [np.array([*other.encode(t, add_special_tokens=False).ids, 1], own.dtype).tobytes() for t in texts]


def check_pack(pieces, rows, window):
    other = Tokenizer.from_file(WORD)
    ids = Counter(np.array([*other.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for _, t, *_ in rows)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append(p)
    assert sorted(sequences) == list(range(len(sequences)))
    total = sum(4 and len(x) // 4 * n for x, n in ids.items())
    for k, own in sequences.items():
        own.sort(key=lambda p: p["offset"])
        at = 0
        for p in own:
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at == window if k < len(sequences) - 1 else at <= window
    assert sum(p["length"] for p in pieces) == total and len(sequences) == -(-total // window)
    return ids


@pytest.mark.parametrize("mixture", [None, {"src1": 1.0, "src2": 3.0}])
def test_pack_holds_every_id_once(spark, odd, odd_rows, mixture):
    pieces = packing.pack(spark, odd, WORD, window=128, mixture=mixture, max_queues=4).collect()
    ids = check_pack(pieces, odd_rows, 128)
    by_doc = {}
    for p in pieces:
        by_doc.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
    assert sum(sum(p["length"] for p in own) // n for (_, n), own in by_doc.items()) == len(odd_rows)
    whole = [bytes(p["ids"]) for p in pieces if p["length"] == p["doc_tokens"]]
    assert not Counter(whole) - ids
    digest = packing.pack(spark, odd, WORD, window=128, mixture=mixture, max_queues=4, digest=True).collect()
    assert Counter(p["ids_crc32"] for p in digest) and sum(p["length"] for p in digest) == sum(p["length"] for p in pieces)
    assert {zlib.crc32(bytes(p["ids"])) for p in pieces if p["length"] == p["doc_tokens"]} <= {p["ids_crc32"] for p in digest}


def test_windows_follow_the_mixture(spark):
    rows = [(k, "moss quill brant " * 200, "en", f"src{k % 2}", 0) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    n = Counter()
    for p in packing.pack(spark, docs, WORD, window=256, mixture={"src0": 3, "src1": 1}).collect():
        n[p["sequence_id"], p["doc_id"] % 2] += p["length"]
    first = sum(n[k, 0] for k in range(20)) / (20 * 256)
    assert abs(first - 0.75) < 0.01 and all(abs(n[k, 0] - 192) <= 2 for k in range(20))


def test_empty_tables(spark, nothing):
    assert packing.pack(spark, nothing, WORD).count() == 0
    assert bpe.digest_documents(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


def test_schedule_places_every_token_once():
    rng = random.Random(5)
    for totals, weights in (([1000, 3, 0, 777], [1, 1, 1, 1]), ([50, 50], [0, 0]), ([10**6, 1], [1, 5]), ([400, 90, 90], [0, 2, 1])):
        s = packing.Schedule(totals, weights, 64)
        runs = []
        for q, n in enumerate(totals):
            cuts = sorted({0, n, *(rng.randint(0, n) for _ in range(9))})
            runs += [(q, a, b - a) for a, b in zip(cuts, cuts[1:])]
        queue, first, length = map(np.array, zip(*runs))
        _, _, place, size = s.place(queue, first, length)
        order = np.argsort(place)
        ends = place[order] + size[order]
        assert place.min() == 0 and (place[order][1:] == ends[:-1]).all() and ends[-1] == sum(totals)


def test_every_source_keeps_its_target(spark, monkeypatch):
    """More sources than were kept apart before: each small one has its share from the start, and one that is named comes first."""
    monkeypatch.setattr(packing, "CELLS", 5000)  # several rounds at once, not all
    rows = [(k, "moss quill brant " * (4 if k < 1100 else 2), "en", f"src{k}", 0) for k in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    pieces = packing.pack(spark, docs, WORD, window=2400).collect()
    first = Counter()
    for p in pieces:
        if p["sequence_id"] < 3:
            first[p["doc_id"]] += p["length"]
    whole = {p["doc_id"]: p["doc_tokens"] for p in pieces}
    total = sum(whole.values())
    assert len(whole) == 1200 and sum(p["length"] for p in pieces) == total > 3 * 2400
    assert all(abs(first[k] - 3 * 2400 * n / total) <= 2 for k, n in whole.items())
    named = packing.pack(spark, docs, WORD, window=whole[1199], mixture={"src1199": 1.0}).where("sequence_id = 0").collect()
    assert {p["doc_id"] for p in named} == {1199} and sum(p["length"] for p in named) == whole[1199]


def test_pieces_are_the_ids_that_they_name(spark, odd_rows, nothing):
    """start, length, doc_tokens and ids_crc32 of every piece, cut pieces too, against the library's ids; rows that repeat hold theirs as often."""
    other = Tokenizer.from_file(WORD)
    rows = [(k, t) for k, (_, t, *_) in enumerate(odd_rows)] * 2
    docs = spark.createDataFrame([(k, t, f"s{k % 5}") for k, t in rows], "doc_id long, text string, source string").repartition(5)
    pieces = packing.pack(spark, docs, WORD, window=64, digest=True).collect()
    ids = {k: np.array([*other.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for k, t in rows}
    held = {k: np.zeros(len(x), int) for k, x in ids.items()}
    for p in pieces:
        own = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert len(own) == p["length"] and p["doc_tokens"] == len(ids[p["doc_id"]]) and p["ids_crc32"] == zlib.crc32(own.tobytes())
        held[p["doc_id"]][p["start"] : p["start"] + p["length"]] += 1
    assert all((x == 2).all() for x in held.values()) and any(p["start"] for p in pieces)
    assert packing.pack(spark, nothing, WORD, digest=True).count() == 0
