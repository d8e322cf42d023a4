"""What appends and merges move and write."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from attestor.operators import segments
from attestor.operators.segments import SegmentedIndex, label_hashes
from tests.test_segments import corpus, frame


def test_a_piece_of_a_shard_is_one_row_and_pieces_make_the_shard_again():
    rng = random.Random(11)
    rows = corpus(rng, 120)
    table = pa.table({"shard": pa.array([3] * 120, pa.int32()), "chunk_key": [r[0] for r in rows], "plain": [r[2] for r in rows], "facet": [f"d{k % 5}" if k % 3 else "e" for k in range(120)], "vector": [[float(k), 1.0] for k in range(120)]})
    built = segments._build(table)
    head = built.filter(pa.compute.is_valid(built.column("n")))
    into = [rng.randrange(3) for _ in range(120)]
    n = built.num_rows
    mixed = built.append_column("segment", pa.array(["s"] * n)).append_column("into", pa.array([[]] * (n - 1) + [into], pa.list_(pa.int32())))
    pieces = segments._split(mixed)
    assert pieces.num_rows == 3 and sorted(pieces.column("shard").to_pylist()) == [0, 1, 2]  # before: a row for each term of each piece
    whole = segments._join(pieces.set_column(0, "shard", pa.array([3] * 3, pa.int32())))
    assert whole.to_pylist() == built.to_pylist() and head.num_rows == 1


def test_an_index_of_labels_alone_has_the_fingerprint_of_the_whole_one(spark, tmp_path):
    rng = random.Random(12)
    rows = corpus(rng, 300)
    leaves = label_hashes(frame(spark, rows))
    grown, whole = SegmentedIndex(spark, f"file://{tmp_path}/a", postings=False), SegmentedIndex(spark, f"file://{tmp_path}/b")
    for at in range(5):
        grown.append(leaves.where(f"cast(substring(label, 6) as int) % 5 in ({at}, {max(0, at - 1)})"))  # labels again, left out
    whole.append(frame(spark, rows))
    assert sorted(r["level"] for r in grown.live()) == [0, 1] and sum(r["n"] for r in grown.live()) == 300
    assert grown.fingerprint().collect() == whole.fingerprint().collect()
    assert not (tmp_path / "a" / "shards").exists()
    with pytest.raises(ValueError):
        grown.search(spark.createDataFrame([(1, "w1")], "qid long, question string"), 3)
