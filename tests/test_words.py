"""Tokens cut in Arrow are those of the text function, whatever stands in the texts."""

import random

import numpy as np
import pyarrow as pa

from attestor.functions import text as T
from attestor.functions import words
from attestor.operators import chunking, ranking
from attestor.operators.segments import Scorer, _posting_rows

ODD = ["", None, "the", " ", "Don't stop", "it’s ONE-two_3", "x", "\tÄpfel naïve café's", "İstanbul Kelvin", "a b the cat", "we'll they'd n't can’t", "日本 word", "end", "9", "...", "the the end's"]


def test_tokens_of_batches_equal_the_text_function(spark):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("aB 9'’.n’t é\n") for _ in range(rng.randrange(30))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(T.tokens("t"), T.plain("t")).collect()
    for some in (slice(None), slice(3, 40), slice(0, 0)):
        plain = pa.array([r[1] for r in rows], pa.string())[some]
        names, code, row = words.tokens(plain)
        got = [[] for _ in plain]
        for c, r in zip(names.take(pa.array(code)).to_pylist(), row.tolist(), strict=True):
            got[r].append(c)
        assert got == [r[0] for r in rows[some]]


def test_counts_by_term_shuffle_no_postings(spark):
    texts = [t for t in ODD if t is not None] * 40
    c = spark.createDataFrame([(t,) for t in texts], "text string")
    tok = [r[0] for r in c.select(T.tokens("text")).collect()]
    want = {t: (sum(t in x for x in tok), sum(x.count(t) for x in tok)) for x in tok for t in x} | {None: (len(texts), len(texts))}
    counts = ranking.term_counts(c)
    assert {r.term: (r.df, r.cf) for r in counts.collect()} == want
    assert "Generate" not in counts._jdf.queryExecution().executedPlan().toString()


def test_terms_of_equal_weight_are_all_scored_and_rare_ones_first():
    rng = np.random.default_rng(1)
    dls = np.full(4000, 30)
    ords = [np.sort(rng.choice(4000, n, replace=False)) for n in (*[1500] * 12, 5, 7)]
    codes, tfs = np.repeat(np.arange(len(ords)), [len(o) for o in ords]), rng.integers(1, 4, sum(map(len, ords)))
    cells = [c.to_pylist() for c in _posting_rows(codes, np.concatenate(ords), tfs, dls, len(ords))[1:]]
    idf = lambda n: np.log((4000 - n + 0.5) / (n + 0.5) + 1)
    terms = {str(k): (idf(len(o)), *(c[k] for c in cells)) for k, o in enumerate(ords)}
    for asked, share in (([(str(k), 1) for k in range(12)], 1.0), ([("0", 1), ("12", 1), ("13", 1)], 0.2)):
        scorer = Scorer(dls.astype(float), 30.0, terms, 1.5, 0.75)
        place, score = scorer.top(asked, 5)
        whole = scorer.all(asked)
        order = np.lexsort((np.arange(4000), -whole))[:5]
        assert place.tolist() == order.tolist() and np.allclose(score, whole[order])
        assert scorer.scored <= share * scorer.matched and (share < 1 or scorer.scored == scorer.matched)


def test_gaps_between_sentences_are_those_of_the_text_function(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["ab", ".", " ", "\t", "!", ";", " ", "é"]) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    rows = [(str(k), "d", 0, "c", "s", t) for k, t in enumerate(texts)]
    c = chunking.build_chunks(spark.createDataFrame(rows, "setid string, drug string, sec_ord int, loinc string, section string, text string"), target=1)
    s = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "doc_id string, t string").select("doc_id", T.sentences("t", r"(?<=[.;:!?])\s+").alias("s"))
    want = {r.doc_id: r.s for r in s.collect() if r.s}
    got = {}
    for r in c.orderBy("chunk_key").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == want
    assert "split(" not in c._jdf.queryExecution().executedPlan().toString()
