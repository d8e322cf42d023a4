"""Fill-in-middle, alignment and suffix arrays against plain Python."""

import hashlib
import random
import re
from collections import Counter
from itertools import accumulate, takewhile

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attestor.llm import align, fim, suffixes
from attestor.llm.queries import BPE_VOCABULARY, PIECES
from tests.llm.conftest import DOC, prose


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = [int(sha(f"1:{'' if doc_id is None else doc_id}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, text, text)
    form = "spm" if h[3] % 100 < 20 else "psm"
    return (doc_id, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", text)


def ordered(rows):
    return sorted(rows, key=repr)


def test_fim_equals_plain_python(spark, odd, odd_rows):
    found = [tuple(r) for r in fim.restore(fim.transform(odd)).collect()]
    assert ordered(found) == ordered(plain_fim(r[0], r[1]) for r in odd_rows)


def test_fim_marks_letters_of_other_scripts_and_parts_of_markers(spark):
    rng = random.Random(3)
    letters = ["<", "P", "S", "M", ">", "<P", "S>", "é", "日", "😀", "a", "Zz", " ", "\n", "\0"]
    rows = [(k, "".join(rng.choice(letters) for _ in range(rng.randrange(0, 14))), "en", "s", 0) for k in range(3000)]
    rows.append((9999, "x" * 3_000_000 + " é" * 1_000_000, "en", "s", 0))
    found = [tuple(r) for r in fim.restore(fim.transform(spark.createDataFrame(rows, DOC).repartition(5))).collect()]
    assert ordered(found) == ordered(plain_fim(r[0], r[1]) for r in rows)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}


def test_fim_parameters_and_empty_table(spark, nothing, odd):
    assert fim.restore(fim.transform(nothing)).count() == 0
    assert {r.form for r in fim.transform(odd, plain=0).collect()} == {"plain"}
    assert {r.form for r in fim.transform(odd, plain=100, spm=100).where(F.length("output") > 9).collect()} == {"spm"}


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(BPE_VOCABULARY)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def plain_groups(sides, text):
    """Groups as lists of ids of A and B, by plain offsets of whole texts; none where bytes differ."""
    a, b = sides
    letters = align.byte_letters()
    want = b" " + text.encode()
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    a_bytes = [bytes(letters[c] for c in a.id_to_token(i)) for i in a_ids]
    b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
    if not text or b"".join(a_bytes) != want or b"".join(b_bytes) != want:
        return []
    ends = [list(accumulate(map(len, x))) for x in (a_bytes, b_bytes)]
    groups, last = [], 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        groups.append(tuple([i for i, e in zip(ids, own, strict=True) if last < e <= end] for ids, own in zip((a_ids, b_ids), ends, strict=True)))
        last = end
    return groups


def plain_alignment(sides, rows):
    """All columns of the alignment of (id, text) rows."""
    grouped = [plain_groups(sides, t or "") for _, t in rows]
    links = [[(x, y) for a, b in g for x in a for y in b] for g in grouped]
    count = Counter(p for own in links for p in set(own))
    top = {}
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for (doc_id, _), g, own in zip(rows, grouped, links, strict=True):
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        best = sum(count[p] == top[p[0]] for p in own)
        out.append((doc_id, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(own), best, sum(count[p] for p in own), sha(shown) if g else ""))
    return out


def test_alignment_equals_plain_python(spark, sides, odd, odd_rows):
    found = align.Alignment(spark, odd, BPE_VOCABULARY, PIECES).scored()
    assert ordered(map(tuple, found.collect())) == ordered(plain_alignment(sides, [(r[0], r[1]) for r in odd_rows]))


def test_alignment_of_white_space_scripts_and_control_strings(spark, sides):
    rng = random.Random(5)
    letters = [" ", " ", " ", "  ", "\n", "\t", " ", "　", "\x1c", "\0", "▁", "a", "the", "tion", "Zürich", "日本", "語", "é", "é", "̈", "😀", "'s", "...", "1234", "<|endoftext|>", "<s>", "</s>", "<0x41>", "ﬁ"]
    rows = [(k, "".join(rng.choice(letters) for _ in range(rng.randrange(0, 30)))) for k in range(800)]
    rows += [(k + 1000, "".join(rng.choice([x for x in letters if x != "▁"]) for _ in range(40))) for k in range(400)]
    rows += [(5000, "a" * 20_000), (5001, "ab  " * 3000), (5002, "あい" * 4000)]
    wanted = plain_alignment(sides, rows)
    assert sum(r[1] > 0 for r in wanted) > 500
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert ordered(map(tuple, align.Alignment(spark, frame, BPE_VOCABULARY, PIECES).scored().collect())) == ordered(wanted)


def test_alignment_of_many_blocks_and_its_other_outputs(spark, sides, nothing, monkeypatch):
    rng = random.Random(8)
    rows = [(k, prose(rng, rng.randrange(1, 60))) for k in range(300)]
    monkeypatch.setattr(align, "BLOCK", 4000)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = align.Alignment(spark, frame, BPE_VOCABULARY, PIECES, groups_as="text")
    wanted = plain_alignment(sides, rows)
    scored = [tuple(r)[:-1] + (sha(r.groups) if r.groups else "",) for r in found.scored().collect()]
    assert ordered(scored) == ordered(wanted)
    count = Counter(p for _, t in rows for p in {(x, y) for a, b in plain_groups(sides, t) for x in a for y in b})
    assert {(r.a, r.b): r.docs for r in found.pair_counts().collect()} == dict(count)
    assert align.Alignment(spark, nothing, BPE_VOCABULARY, PIECES).scored().count() == 0


def test_components_equal_a_plain_search():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        left, right = rng.integers(0, n, (2, int(rng.integers(0, 50))))
        label = list(range(n))
        for _ in range(n):
            for a, b in zip(left, right, strict=True):
                label[a] = label[b] = min(label[a], label[b])
        assert align.components(n, left, right).tolist() == label


def plain_cut(texts, window):
    """Of each text: bytes, removed, spans, what stays; by a dictionary of all strings."""
    raw = [(t or "").encode() if not isinstance(t, bytes) else t for t in texts]
    count = Counter(t[i : i + window] for t in raw for i in range(len(t) - window + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if count[t[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


def assert_cut(spark, rows, window, gram, partitions=5):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    found = suffixes.remove_repeats(spark, frame, window=window, gram=gram, digest_id="doc_id").collect()
    wanted = [(r[0], *w[:3], sha(w[3])) for r, w in zip(rows, plain_cut([r[1] for r in rows], window), strict=True)]
    assert ordered(map(tuple, found)) == ordered(wanted)
    return sum(w[2] for w in wanted)


def random_texts(rng, n, letters):
    """Texts that share passages of many lengths, at any place, with and without edits."""
    passages = ["".join(rng.choice(letters) for _ in range(rng.randrange(10, 90))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            p = rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choice(letters) for _ in range(rng.randrange(0, 60)))
            if p and rng.random() < 0.4:
                i = rng.randrange(len(p))
                p = p[:i] + rng.choice(letters) + p[i + rng.randrange(2) :]
            parts.append(p[rng.randrange(5) :])
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", ["a", "é", "日", "\0", " "]])
def test_suffixes_equal_plain_python(spark, letters, monkeypatch):
    rng = random.Random(len(letters))
    monkeypatch.setattr(suffixes, "BLOCK", 200)
    monkeypatch.setattr(suffixes, "SHARD", 30)
    rows = list(enumerate(random_texts(rng, 120, letters))) + [(500, None), (501, ""), (None, "ab" * 60), (502, "a" * 300)]
    assert assert_cut(spark, rows, 24, 9) > 20


def test_suffixes_under_hot_anchors_equal_plain_python(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 5)
    monkeypatch.setattr(suffixes, "SENT", 3)
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefghij") for _ in range(150))
    rows = [(k, base[:k] + "X" + base[k:]) for k in range(100)] + [(200 + k, base) for k in range(40)] + [(300 + k, t) for k, t in enumerate(random_texts(rng, 60, "abcdef"))]
    assert assert_cut(spark, rows, 30, 10) > 50


def test_hot_copies_have_each_range_once(spark, monkeypatch):
    """However many batches hold a copy, and however many strings of a region are found again."""
    monkeypatch.setattr(suffixes, "HOT", 5)
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefghij") for _ in range(150))
    rows = [(k, base) for k in range(40)] + [(100 + k, base[:60] + str(k) + base[60:]) for k in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = {bytes(r.digest): [tuple(x) for x in r.ranges] for r in suffixes.repeated_ranges(spark, frame, window=30, gram=10).collect()}
    own = found[hashlib.sha256(base.encode()).digest()[:16]]
    regions = len(suffixes.Stretches([base.encode()], 30, 10).anchors)
    assert len(own) == len(set(own)) == regions and suffixes.merged(*np.array(own).T) == [(0, 150)]
    assert assert_cut(spark, rows, 30, 10, partitions=8) > 60


def test_suffixes_at_production_size(spark, odd, odd_rows, nothing):
    rng = random.Random(4)
    shared = prose(rng, 200)
    rows = [(r[0], r[1]) for r in odd_rows] + [(1000 + k, prose(rng, 150) + shared[k * 3 :] + prose(rng, 60)) for k in range(30)] + [(2000, "日本語テキスト" * 400), (2001, prose(rng, 30_000) + shared)]
    assert assert_cut(spark, rows, suffixes.WINDOW, suffixes.GRAM) > 20
    assert suffixes.remove_repeats(spark, nothing).count() == 0
    cleaned = suffixes.remove_repeats(spark, odd)
    assert cleaned.columns == odd.columns
    wanted = [k.decode(errors="ignore") if n else r[1] for r, (_, n, _, k) in zip(odd_rows, plain_cut([r[1] for r in odd_rows], suffixes.WINDOW), strict=True)]
    assert ordered((r.doc_id, r.text) for r in cleaned.collect()) == ordered(zip([r[0] for r in odd_rows], wanted, strict=True))


def test_deep_shallow_orders_as_sorting_does():
    rng = random.Random(2)
    for trial in range(60):
        letters = [b"ab", b"\0\1", b"abcdefgh"][trial % 3]
        pool = [bytes(rng.choice(letters) for _ in range(rng.randrange(0, 200))) for _ in range(rng.randrange(1, 9))]
        strings = [p[: rng.randrange(len(p) + 1)] + bytes([rng.choice(letters)]) * rng.randrange(4) if rng.random() < 0.7 else p for p in rng.choices(pool, k=rng.randrange(1, 60))]
        bucket = np.array(sorted(rng.randrange(4) for _ in strings))
        order, shared = suffixes.deep_shallow(strings, bucket, 16)
        got = [(int(bucket[k]), strings[k]) for k in order]
        assert sorted(order.tolist()) == list(range(len(strings))) and got == sorted(got)
        for i in range(1, len(got)):
            (x, a), (y, b) = got[i - 1], got[i]
            assert shared[i] == (len([1 for _ in takewhile(lambda z: z[0] == z[1], zip(a, b, strict=False))]) if x == y else 0)


def test_gram_hashes_depend_on_all_bytes_of_a_gram_alone():
    rng = np.random.default_rng(6)
    for length in (8, 9, 13, 24, 30, 48, 65, 400):
        raw = rng.integers(0, 4, 900).astype(np.uint8)
        raw[450 : 450 + 400] = raw[:400]
        own = suffixes.gram_hashes(raw, length)
        assert len(own) == 900 - length + 1 and (own[: 400 - length + 1] == own[450 : 450 + 400 - length + 1]).all()
        for k in range(length):
            changed = raw.copy()
            changed[100 + k] ^= 1
            other = suffixes.gram_hashes(changed, length)
            assert other[100] != own[100] and (k == length - 1 or other[101 + k] == own[101 + k])
