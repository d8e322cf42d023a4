"""What tasks over shards hold and move."""

from __future__ import annotations

import random

import pytest

from attestor.operators import segments
from attestor.operators.segments import SegmentedIndex
from attestor.sources.fixtures import directions, encoded
from tests.test_segments import asked, corpus, frame


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("wanted", [segments.WANTED, 0])
def test_shards_meet_questions_without_a_join_by_block_alone(spark, tmp_path, monkeypatch, wanted):
    monkeypatch.setattr(segments, "SHARD", 30)
    monkeypatch.setattr(segments, "QUESTIONS", 10)
    rng = random.Random(8)
    rows, q = corpus(rng, 200), spark.createDataFrame(asked(rng, 25), "qid long, question string")
    index = SegmentedIndex(spark, f"file://{tmp_path}/i")
    index.append(frame(spark, rows))
    few = sorted(map(tuple, index.search(q, 4).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        monkeypatch.setattr(segments, "WANTED", wanted)
        for found in (index.search(q, 4), index.gather(q, inside=3)):
            assert "SortMergeJoin [block#" not in plan(found) and "ShuffledHashJoin [block#" not in plan(found)
        assert sorted(map(tuple, index.search(q, 4).collect())) == few and few
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_vectors_from_the_tokens_of_a_shard_equal_the_encoder_s(spark, tmp_path):
    rng = random.Random(9)
    rows = [(key, text) for key, _, text, _ in corpus(rng, 150)] + [("z", None), ("zz", "the, and ’")]
    chunks = spark.createDataFrame(rows, "chunk_key string, text string")
    q = encoded(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows[:12])], "qid long, question string"), "question")
    one, two = SegmentedIndex(spark, f"file://{tmp_path}/a"), SegmentedIndex(spark, f"file://{tmp_path}/b")
    one.load(chunks, directions)
    two.load(encoded(chunks, "text"))
    got, want = (sorted((r.qid, r.chunk_key, r.dense, r.bm25) for r in i.gather(q).collect()) for i in (one, two))
    assert got == want and len(got) == 12 * len(rows) and any(x[2] > 0.5 for x in got)


def test_rows_of_shards_are_written_without_a_sort_and_in_small_row_groups(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr(segments, "FILES", segments.FILES | {"parquet.block.size": str(64 << 10), "parquet.page.size.row.check.max": "4"})
    monkeypatch.setattr(segments, "SHARD", 250)
    index, rng = SegmentedIndex(spark, f"file://{tmp_path}/i"), random.Random(10)
    rows = [(f"{k}-" + "".join(rng.choices("abcdefghij", k=200)), f"l{k}", f"w{k % 7}", "x") for k in range(4000)]
    segment = index.append(frame(spark, rows).coalesce(1))
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "i" / "shards" / segment).rglob("*.parquet")]
    assert index.docs().count() == 16
    assert sum(f.num_row_groups for f in files) >= 10  # 50 KB of keys in each of 16 shards; before, 100 such rows at least were held at once


def test_the_dense_list_is_found_in_the_shards(spark, tmp_path):
    from attestor.operators import ranking

    rng = random.Random(11)
    rows = [(key, text) for key, _, text, _ in corpus(rng, 240)] + [("z", None), ("c00000b", rng.choice(["w1", "w2"]))]
    chunks = spark.createDataFrame(rows, "chunk_key string, text string").repartition(3)
    q = encoded(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows[-40:])], "qid long, question string"), "question")
    index = SegmentedIndex(spark, f"file://{tmp_path}/i")
    index.load(chunks, directions)
    near = index.gather(q, near=7).where("part = 'near'").select("qid", "chunk_key", "dense")
    got = sorted((r.qid, r["rank"], r.chunk_key, r.dense) for r in ranking.ranked(near, "dense", 7).collect())
    want = sorted((r.qid, r["rank"], r.chunk_key, r.dense) for r in ranking.dense_top(q, encoded(chunks, "text"), 7).collect())
    assert got == want and len(got) > 200


def test_fusion_with_vectors_cuts_chunks_once(spark, monkeypatch):
    from attestor.operators import chunking
    from attestor.plans import retrieval

    cuts, build = [], chunking.build_chunks
    monkeypatch.setattr(chunking, "build_chunks", lambda *a, **k: cuts.append(a) or build(*a, **k))
    retrieval.fusion_dense(spark, "/root/testdata/sf0.001")
    assert len(cuts) == 1  # before: again for a table of all vectors, which was shuffled
