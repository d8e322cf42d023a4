"""Decision points, counterfactual replays and what they say about a policy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def points(final: DataFrame) -> DataFrame:
    """A row for each decision of finished runs: run_id, index, action and the features logged at that moment."""
    return final.select("run_id", F.explode("points").alias("p")).select("run_id", "p.*")


def replays(points: DataFrame, runs: DataFrame, has_user: bool = False, has_locator: bool = True) -> DataFrame:
    """The runs again, once for each decision and each other available action: force_at, force_action."""
    choices = ["search", "answer", "abstain"] + ["locate"] * has_locator + ["ask"] * has_user
    other = F.array_except(F.array(*map(F.lit, choices)), F.array("action"))
    p = points.select("run_id", F.col("index").alias("force_at"), F.explode(other).alias("force_action"))
    again = runs.join(p, "run_id").withColumn("base_run", F.col("run_id"))
    return again.withColumn("run_id", F.concat_ws("~", "base_run", "force_at", "force_action"))


def signals(points: DataFrame) -> DataFrame:
    """points: outcome, cf (map action -> outcome of the replay). Adds better_exists, worse_exists, has_gradient; null without outcome or replays."""
    known = F.col("outcome").isNotNull() & (F.size("cf") > 0)
    of = lambda test: F.when(known, F.exists(F.map_values("cf"), test))
    return points.withColumns({"better_exists": of(lambda x: x & ~F.col("outcome")), "worse_exists": of(lambda x: ~x & F.col("outcome")), "has_gradient": of(lambda x: x != F.col("outcome"))})


def report(points: DataFrame) -> DataFrame:
    """action, n, share, majority_ok (no action holds 70 % or more), n_better, n_worse, n_outcome."""
    by = points.groupBy("action").agg(F.count("*").alias("n"), F.count_if("better_exists").alias("n_better"), F.count_if("worse_exists").alias("n_worse"), F.count_if("outcome").alias("n_outcome"))
    total = by.agg(F.sum("n").alias("total"), F.max("n").alias("top"))
    return by.join(F.broadcast(total)).select("action", "n", F.round(F.col("n") / F.col("total"), 9).alias("share"), (F.col("top") / F.col("total") < 0.7).alias("majority_ok"), "n_better", "n_worse", "n_outcome")
