"""Chunks cut from arrays of bytes, and indexes that are built as chunks are cut."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestor.functions import constants as K
from attestor.operators import chunking
from attestor.operators.segments import SegmentedIndex
from attestor.plans.retrieval import Corpus

SF = "/root/testdata/sf0.001"


def plain_cut(text: str, target: int, drop_tail: bool) -> list[tuple[str, int, int]]:
    """Sentence by sentence."""
    first, last = [0], []
    for gap in re.finditer(r"[.;:!?]\s+", text, re.ASCII):
        last.append(gap.start() + 1)
        first.append(gap.end())
    last.append(len(text))
    if first[-1] == len(text):
        first.pop()
        last.pop()
    sizes, out, at = [z - a for a, z in zip(first, last, strict=True)], [], 0
    while at < len(sizes):
        held, end = 0, at
        while end < len(sizes) and held < target:
            held += sizes[end] + 1
            end += 1
        out.append((" ".join(text[a:z] for a, z in zip(first[at:end], last[at:end], strict=True)), first[at], last[end - 1]))
        if held < target and drop_tail:
            break
        at = max(at + 1, end - 1)
    return out


@pytest.mark.parametrize("drop_tail", [False, True])
def test_cut_is_a_walk_over_sentences(drop_tail):
    rng = random.Random(5)
    marks = ["a", "bc", "é", "語", "’", ". ", "! ", ";  ", ":\n", "?\t ", ".", "..", " ", ". . ", "\r\n", "\x1c", " "]
    texts = ["".join(rng.choices(marks, k=rng.randint(1, 60))).strip(" ") or "x" for _ in range(400)] + ["one. two. three.", "tail. ", "?", ". ", "", "x. \t"]
    for target in (1, 7, 40, 10_000):
        section, found, start, end = chunking.cut(pa.array(texts, pa.string()), target, drop_tail)
        own: list[list] = [[] for _ in texts]
        for s, *row in zip(section.tolist(), found.to_pylist(), start.tolist(), end.tolist(), strict=True):
            own[s].append(tuple(row))
        assert own == [plain_cut(t, target, drop_tail) if t else [] for t in texts]
    part = pa.array(texts, pa.string()).slice(7, 30)
    assert chunking.cut(part, 40)[1].to_pylist() == [c for t in texts[7:37] for c, _, _ in plain_cut(t, 40, False)]


def test_numbers_go_on_over_batches():
    rows, rng = [("d1", "x", 2), ("d1", "y", 1), ("d1", "x", 3), ("d1", None, 1), ("d2", "x", 1), ("d3", "y", 2), ("d3", "x", 1), ("d3", "y", 4), ("d3", None, 1), ("d3", None, 2)], random.Random(1)
    seen: dict = {}
    want = []
    for d, c, n in rows:
        want.append(seen.get((d, c), 0))
        seen[d, c] = want[-1] + n
    for _ in range(20):
        numbers, got, at = chunking.Numbers(), [], 0
        while at < len(rows):
            part = rows[at : at + rng.randint(1, 4)]
            got += numbers.before(*(pa.array([r[k] for r in part], pa.string()) for k in (0, 1)), np.array([r[2] for r in part])).tolist()
            at += len(part)
        assert got == want


def test_sections_that_lie_together_are_not_shuffled(spark):
    rows = [(f"{d:04d}", f"src{d % 3}", s, "c" + str(s % 4), "name", "Word one. " * (1 + (d * s) % 90)) for d in range(60) for s in range(40)]
    df = spark.createDataFrame(rows, "setid string, drug string, sec_ord int, loinc string, section string, text string").coalesce(1)
    own, dealt = chunking.build_chunks(df, together=True), chunking.build_chunks(df)
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()
    assert sorted(own.collect()) == sorted(dealt.collect())


def test_index_loaded_as_chunks_are_cut(spark, tmp_path):
    c = Corpus(spark, SF)
    found = c.lexical.search(c.questions, 5).select("qid", "chunk_key", "bm25", "rank")
    assert c.work.tables == 0  # no table of all chunks
    grown = SegmentedIndex(spark, f"file://{tmp_path}/grown")
    grown.append(c.labelled, merge=False)
    assert sorted(found.collect()) == sorted(grown.search(c.questions, 5).select("qid", "chunk_key", "bm25", "rank").collect())
    with pytest.raises(ValueError, match="loaded whole"):
        c.lexical.append(c.labelled)
    with pytest.raises(ValueError, match="loaded whole"):
        c.lexical.fingerprint()
    kept = c.work.keep(found)
    own = c.of(kept).join(kept.select("chunk_key").distinct(), "chunk_key", "left_semi")
    assert sorted(own.collect()) == sorted(c.chunks.join(kept.select("chunk_key").distinct(), "chunk_key", "left_semi").collect())


def test_documents_of_one_number_in_two_rows(spark, tmp_path):
    """Sections of two rows with one number are chunks of one document, numbered through."""
    rows = spark.createDataFrame([(1, "a b c.\nd e f.", "src1"), (2, "g h.", "src2"), (1, "i j.", "src1")], "doc_id long, text string, source string")
    rows.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    c = Corpus.__new__(Corpus)
    c.spark, c.sf_dir = spark, str(tmp_path)
    assert not c.unique
    by = c.plan.groupBy("doc_id", "loinc").agg(F.sort_array(F.collect_list(F.substring_index("chunk_id", "#", -1).cast("int"))).alias("n"))
    assert all(r["n"] == list(range(1, len(r["n"]) + 1)) for r in by.collect())


def test_sizes_of_sections_of_no_sentence():
    first, last = chunking.pack(np.array([3, 3], np.int64), np.array([0, 0, 2, 2]), K.TARGET_CHARS)
    assert (first.tolist(), last.tolist()) == ([0, 1], [1, 1])
