"""Connected components of a link table by alternating large-star and small-star rounds, each a written table; tasks contract the links they hold first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from attestor.llm.common import Scratch, batch, lean


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """links: a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


#: Nodes that a task holds at once while it contracts its links.
HELD = 1 << 20


def contract(links: DataFrame) -> DataFrame:
    """Links a, b (longs, a > b) that join the same nodes: of its own links each task hands on a forest, every node with the least one it is joined to."""
    out = StructType.fromDDL("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        def forest() -> pa.RecordBatch:
            nodes = [x for x in parent if root(x) != x]
            return batch(to_arrow_schema(out), nodes, [root(x) for x in nodes])

        for own in batches:
            pairs = np.unique(np.stack([own.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)], 1), axis=0)
            for x, y in pairs.tolist():
                x, y = root(x), root(y)
                parent[max(x, y)] = min(x, y)
            if len(parent) > HELD:
                yield forest()
                parent.clear()
        yield forest()

    return links.select("a", "b").mapInArrow(lean(run), out)


def connected(links: DataFrame, scratch: Scratch, rounds: int = 60, name: str = "links") -> DataFrame:
    """links: a, b, longs. Returns node, root for every node that has a link; root is the least node reachable."""
    state, before = scratch.write(contract(links).distinct(), f"{name}0"), None
    for k in range(1, rounds + 1):
        seen = Observation()
        after = _small_star(_large_star(state)).distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38, 0)")).alias("sum"))
        state = scratch.write(after, f"{name}{k}")
        scratch.drop(f"{name}{k - 1}")
        if seen.get == before:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(state.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = seen.get
    raise RuntimeError(f"components have not settled after {rounds} rounds")
