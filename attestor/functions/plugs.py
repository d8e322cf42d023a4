"""Where models plug in: encoders, pair scorers and generators, loaded once for each task and fed in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.sources.labels import cached

#: Goes before questions, not before passages.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def encoded(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], np.ndarray]], prefix: str = "", model: str = "", cache: DataFrame | None = None) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Adds vector (unit length): load() gives a function from texts to a matrix.

    With a cache (key, value) only texts that it lacks are encoded, and the new cache rows are returned too. The key holds model, prefix and text."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = load()
        for texts in batches:
            v = np.asarray(run([prefix + (t or "") for t in texts]), float)
            yield pd.Series(list((v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype("float32")))

    if cache is None:
        return df.withColumn("vector", encode(F.col(text)))
    keyed = df.withColumn("key", F.sha1(F.concat_ws("\x1f", F.lit(model), F.lit(prefix), text)))
    known, missing = cached(keyed, cache)
    new = missing.select("key", text).dropDuplicates(["key"]).select("key", encode(F.col(text)).alias("value"))
    both = known.withColumnRenamed("value", "vector").unionByName(missing.join(new.withColumnRenamed("value", "vector"), "key"))
    return both.drop("key"), new


def scored(pairs: DataFrame, question: str, text: str, load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], model: str, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """pairs with relevance, and the new cache rows. The cache key holds the model and both texts."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        run = load()
        for q, t in batches:
            yield pd.Series(run(list(zip(q, t, strict=True))), dtype=float)

    keyed = pairs.withColumn("key", F.substring(F.sha1(F.concat_ws("\x1f", F.lit(model), question, text)), 1, 20))
    if cache is None:
        new = keyed.withColumn("relevance", score(question, text))
        return new.drop("key"), new.select("key", F.col("relevance").alias("value")).distinct()
    known, missing = cached(keyed, cache)
    new = missing.withColumn("relevance", score(question, text))
    return known.withColumnRenamed("value", "relevance").unionByName(new).drop("key"), new.select("key", F.col("relevance").alias("value")).distinct()


def generated(prompts: DataFrame, prompt: str, load: Callable[[], Callable[[str], str]], model: str, cache: DataFrame | None = None, retries: int = 3) -> tuple[DataFrame, DataFrame]:
    """prompts with answer_text, and the new cache rows. load() gives a function from a prompt to a text; it is tried `retries` times."""

    @F.pandas_udf("string")
    def generate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = load()

        def once(p: str) -> str:
            for left in range(retries - 1, -1, -1):
                try:
                    return run(p)
                except OSError:
                    if not left:
                        raise
            raise AssertionError

        for batch in batches:
            yield batch.map(once)

    keyed = prompts.withColumn("key", F.sha1(F.concat_ws("\x1f", F.lit(model), prompt)))
    known, missing = cached(keyed, cache) if cache is not None else (None, keyed)
    new = missing.withColumn("answer_text", generate(prompt))
    both = new if known is None else known.withColumnRenamed("value", "answer_text").unionByName(new)
    return both.drop("key"), new.select("key", F.col("answer_text").alias("value")).distinct()
