"""Top-k, chat formatting and personal data against brute force."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.llm import chat, pii, topk
from attestor.llm.common import Scratch
from tests.llm.conftest import DOC

VEC = "vec_id long, embedding array<float>, label int"


def brute_top(rows, k=5):
    good = [(i, [float(np.float32(x)) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in good]
    out = Counter()
    for a, (i, q) in enumerate(good):
        if i % 50 == 0:
            found = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(good) if b != a and len(v) == len(q))
            out.update((i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k]))
    return out


def test_top_k_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(0, 0.3, 6)], 0) for k in range(700)]
    rows += [(1000 + k, [0.5, 0.5, 0.5, 0.5, 0.0, 0.0], 0) for k in range(300)]  # a hot vector, ties by id
    rows += [(50, None, 1), (100, [], 1), (150, [0.1, None, 0.2, 0.3, 0.4, 0.5], 1), (200, [float("nan")] * 6, 1), (250, [float("inf")] * 6, 1), (None, [0.1] * 6, 1), (0, [0.5] * 6, 1), (50, [0.2] * 6, 1), (2000, [1.0, 2.0], 1), (2001, [0.5, 0.25], 1), (2050, [3e4, -2e4], 1)]
    frame = spark.createDataFrame(rows, VEC).repartition(3)
    monkeypatch.setattr(topk, "ANNULUS", 64)
    monkeypatch.setattr(topk, "SHELF", 3)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    assert Counter(map(tuple, topk.search(spark, frame).collect())) == brute_top(rows)
    clashing = frame.withColumns({c: F.lit("x") for c in ("v", "norm", "dim", "cell", "shelf", "uid", "score", "rank", "query_id")})
    monkeypatch.setattr(topk, "EDGES", 0)  # shelves are then asked by their cells
    found = topk.search(spark, clashing)
    assert Counter(map(tuple, found.collect())) == brute_top(rows)
    assert not re.search("NestedLoop|CartesianProduct", found._jdf.queryExecution().executedPlan().toString())
    assert topk.search(spark, frame.where("false")).count() == 0
    assert Counter(map(tuple, topk.search(spark, frame.where("vec_id in (0, 3)")).collect())) == brute_top([r for r in rows if r[0] in (0, 3)])


def test_scores_beyond_doubles_are_exact():
    q, v = np.array([[2.0**30, 1.0]]), np.array([[2.0**30, 1.0], [2.0**30, 3.0]])
    assert topk.scores(q, v).tolist() == [[2**60 + 1, 2**60 + 3]]
    assert topk.scores(np.array([[2.0**40]]), np.array([[2.0**40]])).tolist() == [[2**63 - 1]]


@pytest.mark.parametrize("text", ["", "</s>[INST] ok [/INST]", "\\", "\\l<[", "<|turn|>x<|body|>y<|end|>\n", "<|image:0|>", "a\n\nb", "\\\\l"])
def test_escape_is_reversible_and_hides_controls(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text and "<" not in hidden and "[" not in hidden
    formatted, _ = chat.format_turn("user", [{"type": "text", "text": text}])
    assert chat.read_back(formatted * 2) == [("user", text)] * 2


def test_parts_become_ordered_placeholders(spark):
    parts = [{"type": "text", "text": "see "}, {"type": "image", "ref": "a.png", "width": 57, "height": 28}, None, {"type": "audio", "ref": "b", "seconds": 1.5}, {"type": "text", "text": None}, {"type": "document", "ref": "c", "pages": 3}, {"type": "odd", "ref": "d"}, {"type": "image"}]
    full = [p and {k: p.get(k) for k in ("type", "text", "ref", "width", "height", "seconds", "pages")} for p in parts]
    rows = spark.createDataFrame([(1, 0, "user", full), (1, 1, None, None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    a, b = sorted(chat.format_turns(rows, text_col=None, parts_col="parts").collect(), key=lambda r: r["turn"])
    assert a["formatted"] == "<|turn|>user<|body|>see <|image:0|><|audio:1|><|document:2|><|file:3|><|image:4|><|end|>\n"
    assert [(x["ordinal"], x["kind"], x["ref"], x["tokens"]) for x in a["attachments"]] == [(0, "image", "a.png", 3), (1, "audio", "b", 38), (2, "document", "c", 768), (3, "file", "d", 1), (4, "image", None, 1)]
    assert a["expanded_tokens"] == 811 and chat.read_back(a["formatted"]) == [("user", "see ")]
    assert b["formatted"] == "<|turn|><|body|><|end|>\n" and b["expanded_tokens"] == 0


def test_conversations_equal_brute_force(spark):
    rng = random.Random(1)
    words = ["</s>", "[INST]", "ok", "\\", "<|end|>\n", "é", "\n", ""]
    rows = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, 0, 1, 2, 2]), rng.choice(["user", "assistant", "system", None]), rng.choice([None, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))])) for _ in range(200)]
    rows += [(9, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(500)]
    got = {r["conv_id"]: tuple(r) for r in chat.digest_conversations(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)), 3).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert set(got) == set(by)
    for conv, own in by.items():
        lines = [(t is not None, t or 0, r is not None, (r or "").encode(), (x or "").encode(), r or "", x or "", chat.format_turn(r, [{"type": "text", "text": x}])[0]) for _, t, r, x in own]
        lines.sort()
        turns = "".join(f"{x[5]}\n{x[6]}\n" for x in lines)
        loss = "".join(x[6] for x in lines if x[5] == "assistant")
        assert got[conv] == (conv, len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(x[7]) for x in lines))


def test_turns_of_a_tie_stand_by_text(spark, nothing):
    """`<` and `[` are written with a backslash, and the end mark follows the text: neither may decide the order."""
    texts = ["=a", "<a", "a", "a!", "[", "\\", "\\l", "\\\\b", "<|end|>\n", "", None, "é", "Z"]
    rows = spark.createDataFrame([(1, 0, "user", t, "x", 7) for t in texts], "conv_id long, turn long, role string, text string, formatted string, loss long").repartition(4)
    got = chat.digest_conversations(chat.format_turns(rows)).collect()
    want = "".join(f"user\n{t}\n" for t in sorted((t or "" for t in texts), key=str.encode))
    assert [r["turns_sha256"] for r in got] == [hashlib.sha256(want.encode()).hexdigest()]
    assert chat.digest_conversations(chat.format_turns(rows.limit(0))).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    twice = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in twice) % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return kind == "email" or kind == "ip" and all(int(p) <= 255 for p in match.split(".")) or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15


def brute_pii(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if passes(k, m.group())]


def pii_texts():
    rng = random.Random(7)
    bits = ["a@b.c", "x.y+z@mail.example.org", "@", "a@b", "a@b.c_d@e.f", "..@x.y..z", "10.0.0.1", "256.1.1.1", "1.2.3.4.5.6.7.8", "01.002.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111 1111 1111", "+1 (555) 123-4567", "+49 30 1234567 ", "+1", "é", "日本", " ", "\n", "-", "7", "12345", "text", "İ"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(400)] + ["7" * 20000, "a." * 20000 + "@b", "a@b" + ".c" * 20000, "1 " * 20000, "+1" + "5" * 5000, "x" * 50000]


def test_base_spans_equal_brute_force(spark):
    texts = pii_texts()
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], DOC).repartition(4)
    for r in pii.report(spark, docs).collect():
        found = brute_pii(texts[r["doc_id"]])
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(x[0] == k for x in found) for k in PATTERNS]
        assert r["spans"].startswith(base)


def disclosing(spark):
    """Four texts name an address beside a rare word, which stands in a fifth alone; a common word stands everywhere."""
    rows = [(k, f"common words {k} here Zanzibort wrote zed@mail.example.com common", "en", "s", 0) for k in range(4)]
    rows += [(k, f"common words number {k} wrote nothing else here common", "en", "s", 0) for k in range(10, 90)]
    rows += [(99, "Again ZANZIBORT? zanzibortish no", "en", "s", 0)] * 2
    return spark.createDataFrame(rows, DOC).repartition(3)


def test_terms_that_disclose_become_spans(spark):
    docs = disclosing(spark)
    got = {r["doc_id"]: r["spans"] for r in pii.report(spark, docs).collect()}
    assert got[0] == "email:36:56,term:20:29" and got[99] == "term:6:15" and got[10] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.redact(spark, docs).collect()}
    assert clean[0] == "common words 0 here Z… wrote [EMAIL] common" and clean[99] == "Again Z…? zanzibortish no"
    assert clean[10] == "common words number 10 wrote nothing else here common"


def test_disclosing_terms_equal_brute_force(spark):
    """Names beside entities in a share of their texts from 0.2 to 1, at the production thresholds."""
    rng, rows = random.Random(12), []
    letters = lambda n: "".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(n))
    common = [letters(3) for _ in range(60)]
    filler = lambda n: " ".join(rng.choice(common) for _ in range(n))
    kinds = [lambda k: f"p{k}@mail.example.com", lambda k: f"10.0.{k}.7", lambda k: "+49 30 %07d" % (1234567 + k), lambda k: f"P{k}@MAIL.example.com"]
    for k in range(24):
        name, beside, alone = letters(5), rng.randint(1, 6), rng.randint(0, 5)
        rows += [f"{filler(30)} {name} {filler(2)} {kinds[k % 3](k)} {filler(30)}" for _ in range(beside)] + [f"{filler(40)} {name} {filler(9)}" for _ in range(alone)]
    rows += [filler(50) for _ in range(100)] + rows[:20]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id long, text string").repartition(3)
    n, with_, beside = len(set(rows)), {}, {}
    entities: dict[str, set] = {}
    for t in set(rows):
        for w in set(re.findall(r"[^\W\d_]{4,}", t.lower())):
            with_.setdefault(w, set()).add(t)
        for kind, a, b in brute_pii(t):
            e = kind + (re.sub("[^0-9]", "", t[a:b]) if kind in ("card", "phone") else t[a:b].lower())
            entities.setdefault(e, set()).add(t)
            for m in re.finditer(r"[^\W\d_]{4,}", t):
                if a - 80 <= m.start() and m.end() <= a or b <= m.start() and m.end() <= b + 80:
                    beside.setdefault((m[0].lower(), e), set()).add(t)
    want = {}
    for (w, e), own in beside.items():
        share = len(own) / len(with_[w])
        if len(own) >= 3 and share >= 0.5 and math.log2(len(own) * n / (len(with_[w]) * len(entities[e]))) >= 4:
            want[w] = max(share, want.get(w, 0))
    scratch = Scratch(spark, "brute")
    found = scratch.write(pii.find(docs), "found")
    got = {r["term"]: r["share"] for r in pii.disclosing_terms(spark, docs, found, scratch).collect()}
    assert got == pytest.approx(want) and len(want) >= 6 and min(want.values()) < 0.9 < max(want.values())


def test_many_matches_take_no_square(spark):
    """40000 addresses in one text, in places and in the redacted text."""
    text = " ".join(f"1.2.3.{k % 200}" for k in range(40_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    got = pii.report(spark, docs).first()
    assert got["n_ip"] == 40_000 and got["spans"].endswith(f"ip:{text.rindex(' ') + 1}:{len(text)}")
    assert pii.redact(spark, docs).first()["text"] == " ".join(["[IP]"] * 40_000)
    assert time.time() - began < 60


def test_redaction_keeps_rows_columns_and_clean_texts(spark, odd, odd_rows, nothing):
    got = pii.redact(spark, odd)
    assert got.columns == odd.columns and Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter((k, t) for k, t, *_ in odd_rows)
    assert pii.redact(spark, nothing).count() == 0 and pii.report(spark, nothing).count() == 0
    report = pii.report(spark, odd)
    assert report.count() == len(odd_rows) and report.where("spans <> ''").count() == 0
    over = spark.createDataFrame([(1, "card 4111 1111 1111 1111 or a@b.c now 10.0.0.1.", None, None, None)], DOC)
    assert pii.redact(spark, over).first()["text"] == "card [CARD] or [EMAIL] now [IP]."


def test_no_python_on_the_way(spark, odd):
    plan = pii.redact(spark, odd)._jdf.queryExecution().executedPlan().toString() + pii.report(spark, odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_context_reaches_over_other_hits_and_ends_at_80_characters(spark):
    """Numbers that are no cards and other addresses stand between a term and its entity; a term beyond the context, or cut by it, is not beside it."""
    rare = ["Zanzibort 42, 1987, card 4111 1111 1111 1111", "zed@mail.example.com, ann@b.example, Quorvaleth", "Farnoquist" + " -" * 41 + " +49 30 1234567", "Yondermath" + "." * 75 + "10.0.0.1", "Edgewisely" + "." * 70 + "10.0.0.2"]
    rows = [(k, f"{t} common {k}", "en", "s", 0) for n, t in enumerate(rare) for k in range(10 * n, 10 * n + 4)]
    rows += [(k, f"common words number {k} wrote nothing", "en", "s", 0) for k in range(100, 400)]
    docs = spark.createDataFrame(rows, DOC)
    scratch = Scratch(spark, "context")
    found = scratch.write(pii.find(docs), "found")
    got = {r["term"] for r in pii.disclosing_terms(spark, docs, found, scratch).collect()}
    assert {"zanzibort", "card", "quorvaleth", "edgewisely"} <= got and not got & {"farnoquist", "yondermath", "common"}
