"""The ledger as tables: steps and the documents they retrieved, claims and their citations, closure, attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions import constants as K

#: A citation that was found in an earlier turn; null is one that was never found.
CARRIED_STEP = -1


def _step_rules() -> dict[str, Column]:
    return {
        "unknown_action": ~F.col("action").isin(K.LEDGER_ACTIONS),
        "unknown_drop_reason": F.col("reason_dropped").isNotNull() & ~F.col("reason_dropped").isin(K.DROP_REASONS),
        "query_missing": F.col("action").isin("retrieve", "locate", "ask") & (F.coalesce("query", F.lit("")) == ""),
        "abstain_without_note": (F.col("action") == "abstain") & (F.coalesce("note", F.lit("")) == ""),
        "unused_without_reason": F.col("used_in_report").eqNullSafe(False) & F.col("reason_dropped").isNull(),
    }


def _doc_rules() -> dict[str, Column]:
    return {"empty_doc_id": F.coalesce("doc_id", F.lit("")) == "", "unknown_source_type": ~F.col("source_type").isin(K.SOURCE_TYPES)}


def violations(steps: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """rule, run_id, step: steps and documents that break a rule of the ledger. Empty for a sound ledger."""
    found = lambda rules: F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    out = steps.select(F.explode(found(_step_rules())).alias("rule"), "run_id", "step")
    if docs is not None:
        out = out.union(docs.select(F.explode(found(_doc_rules())).alias("rule"), "run_id", "step"))
    return out


def checked(name: str, rows: DataFrame) -> DataFrame:
    """rows of the ledger's table of that name, which fail where they are read if one breaks a rule. No pass of its own: the
    check is a filter over the columns of the rules. Tables without rules (or without the columns that they look at) pass."""
    rules = {"steps": _step_rules, "docs": _doc_rules}.get(name)
    needed = {"steps": {"action", "reason_dropped", "query", "note", "used_in_report"}, "docs": {"doc_id", "source_type"}}.get(name, set())
    if rules is None or not needed <= set(rows.columns):
        return rows
    sound = F.lit(True)
    for rule, broken in rules().items():
        said = F.concat(F.lit(f"ledger: {rule} in run "), F.coalesce(F.col("run_id").cast("string"), F.lit("?")), F.lit(", step "), F.coalesce(F.col("step").cast("string"), F.lit("?")))
        sound = F.when(F.coalesce(broken, F.lit(False)), F.raise_error(said).cast("boolean")).otherwise(sound)
    return rows.where(sound)


def first_steps(cites: DataFrame, retrieved: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """cites: run_id, claim_id, doc_id, loinc (null: the citation names no section); retrieved: run_id, step, doc_id, loinc.
    Adds first_step: the first step that found the document, of the cited section if both name one.

    Found by two equi-joins on per-key minima, one for the section and one for the document, so no step meets a citation twice."""
    exact = retrieved.where("loinc is not null").groupBy("run_id", "doc_id", "loinc").agg(F.min("step").alias("exact"))
    blank = retrieved.where("loinc is null").groupBy("run_id", "doc_id").agg(F.min("step").alias("blank"))
    any_ = retrieved.groupBy("run_id", "doc_id").agg(F.min("step").alias("any"))
    out = cites.join(exact, ["run_id", "doc_id", "loinc"], "left").join(blank, ["run_id", "doc_id"], "left").join(any_, ["run_id", "doc_id"], "left")
    step = F.when(F.col("loinc").isNull(), F.col("any")).otherwise(F.least("exact", "blank"))
    if carried is not None:
        have = carried.select("run_id", "doc_id", "loinc").distinct().withColumn("carried", F.lit(True))
        out = out.join(have, ["run_id", "doc_id", "loinc"], "left")
        step = F.coalesce(step, F.when(F.col("carried"), F.lit(CARRIED_STEP)))
    return out.withColumn("first_step", step).select(*cites.columns, "first_step")


def closure(claims: DataFrame, cites: DataFrame) -> DataFrame:
    """claims: run_id, claim_id; cites: run_id, claim_id, cite_key, first_step and stored_step. What is wrong, a row each."""
    bare = claims.join(cites.select("run_id", "claim_id").distinct(), ["run_id", "claim_id"], "left_anti").select("run_id", "claim_id", F.lit(None).cast("string").alias("cite_key"), F.lit("no_citation").alias("problem"))
    lost = cites.where("first_step is null").select("run_id", "claim_id", "cite_key", F.lit("untraceable").alias("problem"))
    moved = cites.where("first_step is not null and not (first_step <=> stored_step)").select("run_id", "claim_id", "cite_key", F.lit("wrong_step").alias("problem"))
    return bare.union(lost).union(moved)


def attribution(gold: DataFrame, retrieved: DataFrame, cited: DataFrame, correct: DataFrame) -> DataFrame:
    """gold, retrieved, cited: run_id, cite_key; correct: run_id, correct. run_id, recall, utilization, layer, suggestion."""
    got = retrieved.select("run_id", "cite_key").distinct().withColumn("got", F.lit(1))
    said = cited.select("run_id", "cite_key").distinct().withColumn("said", F.lit(1))
    g = gold.select("run_id", "cite_key").distinct().join(got, ["run_id", "cite_key"], "left").join(said, ["run_id", "cite_key"], "left")
    g = g.groupBy("run_id").agg(F.count("*").alias("n"), F.count("got").alias("got"), F.count("said").alias("said"))
    layer = F.when(F.col("correct"), "none").when(F.col("got") < F.col("n"), "retrieval").when(F.col("said") < F.col("n"), "utilization").otherwise("reasoning")
    advice = F.when(F.col("layer") == "retrieval", "widen or redirect the search").when(F.col("layer") == "utilization", "select and order the evidence").when(F.col("layer") == "reasoning", "improve the generator").otherwise("")
    return correct.join(g, "run_id").select("run_id", F.round(F.col("got") / F.col("n"), 9).alias("recall"), F.round(F.col("said") / F.col("n"), 9).alias("utilization"), layer.alias("layer")).withColumn("suggestion", advice)


def compare_layers(old: DataFrame, new: DataFrame) -> DataFrame:
    """layer, n_old, n_new, n_both: failures by layer under two retrievers, and the runs that stay in a layer."""
    o, n = old.select("run_id", F.col("layer").alias("o")), new.select("run_id", F.col("layer").alias("n"))
    x = o.join(n, "run_id", "full_outer").select("o", "n", F.explode(F.array_distinct(F.array("o", "n"))).alias("layer")).where("layer is not null")
    return x.groupBy("layer").agg(F.count_if(F.col("o") == F.col("layer")).alias("n_old"), F.count_if(F.col("n") == F.col("layer")).alias("n_new"), F.count_if((F.col("o") == F.col("layer")) & (F.col("n") == F.col("layer"))).alias("n_both"))


def linear_pipeline(hits: DataFrame, keep: int = 3) -> DataFrame:
    """hits: run_id, sub (order of the sub-question), cite_key, rank. Each step keeps what no earlier step found; the
    report uses the first `keep` distinct keys; a step is used if one of its documents is. run_id, step, n_fresh, used_in_report, reason_dropped."""
    first = hits.withColumn("first_sub", F.min("sub").over(Window.partitionBy("run_id", "cite_key"))).where("sub = first_sub")
    seen = first.withColumn("copy", F.row_number().over(Window.partitionBy("run_id", "cite_key").orderBy("sub", "rank"))).where("copy = 1")
    kept = seen.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy("sub", "rank", "cite_key"))).where(F.col("place") <= keep).select("run_id", "cite_key", F.lit(True).alias("used"))
    steps = first.join(kept, ["run_id", "cite_key"], "left").groupBy("run_id", "sub").agg(F.count("*").alias("n_fresh"), F.bool_or(F.coalesce("used", F.lit(False))).alias("used_in_report"))
    return steps.select("run_id", F.col("sub").alias("step"), "n_fresh", "used_in_report", F.when(~F.col("used_in_report"), "context_budget").alias("reason_dropped"))
