"""Measures of runs: policies, paths, complementarity of lists, pools and utilisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions import text as T


def policy_metrics(stats: DataFrame, expected: DataFrame) -> DataFrame:
    """stats: run_id, policy, answered, n_actions, cost_spent; expected: run_id, boundary_class (null: must answer), correct.
    accuracy over questions to answer, refusal and hard_answer over the others, by policy."""
    x = stats.join(expected, "run_id")
    asked, bound = F.col("boundary_class").isNull(), F.col("boundary_class").isNotNull()
    share = lambda test, of: F.round(F.avg(F.when(of, test.cast("double"))), 9)
    return x.groupBy("policy").agg(share(F.col("correct"), asked).alias("accuracy"), share(~F.col("answered"), bound).alias("refusal"), share(F.col("answered"), bound).alias("hard_answer"), F.round(F.avg("n_actions"), 9).alias("avg_actions"), F.round(F.avg("cost_spent"), 9).alias("avg_cost"))


def refusal_by_class(stats: DataFrame, expected: DataFrame) -> DataFrame:
    x = stats.join(expected.where("boundary_class is not null"), "run_id")
    return x.groupBy("policy", "boundary_class").agg(F.count("*").alias("n"), F.count_if(~F.col("answered")).alias("n_refused"))


def grounded(final: DataFrame, gold: DataFrame) -> DataFrame:
    """final: finished runs of the agent; gold: run_id, drug, gold_loinc_any. run_id, correct: the run ended with an answer that cites an acceptable section of the label."""
    x = final.join(gold, "run_id").withColumn("cites", T.citations("answer_text"))
    hit = F.expr("exists(evidence, e -> e.drug = drug and array_contains(gold_loinc_any, e.loinc) and array_contains(cites, e.cite_key))")
    return x.select("run_id", (F.coalesce(F.col("terminated_by") == "answer", F.lit(False)) & F.coalesce(hit, F.lit(False))).alias("correct"))


def theta_grid(runs: DataFrame) -> DataFrame:
    """runs: theta_high, theta_low, terminated_by, n_actions, boundary_class (null: must answer), correct. One row for each pair of thresholds:
    accuracy and wrong abstentions over the questions to answer, refusals and hard answers over the others, their sum as score
    (the wrong ones count against it) and place, the best score first, then the fewest actions."""
    asked, bound, answered = F.col("boundary_class").isNull(), F.col("boundary_class").isNotNull(), F.col("terminated_by") == "answer"
    share = lambda test, of: F.round(F.coalesce(F.avg(F.when(of, F.coalesce(test, F.lit(False)).cast("double"))), F.lit(0.0)), 9)
    g = runs.groupBy("theta_high", "theta_low").agg(F.count("*").alias("n"), share(F.col("correct"), asked).alias("accuracy"), share(~answered, asked).alias("wrong_abstain"), share(F.col("terminated_by") == "abstain", bound).alias("refusal"), share(F.col("terminated_by") != "abstain", bound).alias("hard_answer"), F.round(F.avg("n_actions"), 9).alias("avg_actions"))
    g = g.withColumn("score", F.round(F.col("accuracy") + F.col("refusal") - F.col("wrong_abstain") - F.col("hard_answer"), 9))
    cells = Window.orderBy(F.desc("score"), "avg_actions", "theta_high", "theta_low")  # one row for each cell of a grid
    return g.withColumn("place", F.row_number().over(cells))


def path_survey(stats: DataFrame) -> DataFrame:
    """policy, n_runs, n_paths, most_common, avg_actions, avg_cost, n_answered."""
    by = stats.groupBy("policy", "path").agg(F.count("*").alias("n"), F.sum("n_actions").alias("a"), F.sum("cost_spent").alias("c"), F.count_if("answered").alias("y"))
    return by.groupBy("policy").agg(F.sum("n").alias("n_runs"), F.count("*").alias("n_paths"), F.max_by("path", F.struct("n", "path")).alias("most_common"), F.round(F.sum("a") / F.sum("n"), 9).alias("avg_actions"), F.round(F.sum("c") / F.sum("n"), 9).alias("avg_cost"), F.sum("y").alias("n_answered"))


def complementarity(a: DataFrame, b: DataFrame, kinds: DataFrame) -> DataFrame:
    """a, b: qid, hit of two retrievers; kinds: qid, kind. Recall of each, of both together, and where only one hits."""
    x = kinds.join(a.select("qid", F.col("hit").alias("a")), "qid", "left").join(b.select("qid", F.col("hit").alias("b")), "qid", "left").fillna(False, ["a", "b"])
    return x.groupBy("kind").agg(F.count("*").alias("n"), *[F.count_if(test).alias(name) for name, test in (("n_a", F.col("a")), ("n_b", F.col("b")), ("n_either", F.col("a") | F.col("b")), ("n_only_a", F.col("a") & ~F.col("b")), ("n_only_b", F.col("b") & ~F.col("a")))])


def gate_calibration(tops: DataFrame, kinds: DataFrame) -> DataFrame:
    """tops: qid, top (best cosine); kinds: qid, kind. Spread of the best cosine by kind, and how many saturate."""
    return kinds.join(tops, "qid", "left").groupBy("kind").agg(F.count("top").alias("n"), F.round(F.max("top"), 6).alias("max"), F.round(F.min("top"), 6).alias("min"), F.round(F.avg("top"), 6).alias("mean"), F.count_if(F.col("top") >= 0.999).alias("n_saturated"), F.count_if(F.col("top").isNull()).alias("n_none"))


def pool_probe(pool: DataFrame, gold: DataFrame) -> DataFrame:
    """pool: qid, question, pos, cite_key, text; gold: qid, cite_key. Where the gold stands, its word overlap, and whether it is the pool's best."""
    p = pool.withColumn("overlap", F.size(F.array_intersect(T.content_words("question"), T.content_words("text"))))
    best = p.groupBy("qid").agg(F.max("overlap").alias("best"), F.count("*").alias("n_pool"))
    g = p.join(gold, ["qid", "cite_key"]).groupBy("qid").agg(F.min("pos").alias("gold_pos"), F.max("overlap").alias("gold_overlap"))
    return gold.select("qid").distinct().join(best, "qid", "left").join(g, "qid", "left").withColumn("gold_is_best", F.coalesce(F.col("gold_overlap") == F.col("best"), F.lit(False)))


def utilisation_cases(layers: DataFrame, stats: DataFrame) -> DataFrame:
    """layers: run_id, layer, recall, utilization; stats: run_id, answered. Failures by layer, net of abstentions."""
    x = layers.where("layer <> 'none'").join(stats.select("run_id", "answered"), "run_id")
    return x.groupBy("layer").agg(F.count("*").alias("n"), F.count_if(~F.col("answered")).alias("n_abstained"), F.count_if(F.col("answered")).alias("n_net"), F.count_if(F.col("recall") > 0).alias("n_gold_found"), F.count_if(F.col("utilization") > 0).alias("n_gold_cited"))


def holding(items: DataFrame, docs: DataFrame, width: int = 3) -> DataFrame:
    """items: qid, item; docs: whole and others. qid and the columns of docs for every document whose text holds the item's text.

    A text that holds an item holds the words inside it, whole and in order: its second word and those after it, `width` of them, are a key
    that both sides share, and what meets there is looked at. Items of so few words that there is no such key meet all documents; they are only joined if there are some."""
    words = lambda c: F.expr(f"filter(split({c}, '[ \\t\\n\\x0B\\f\\r]+'), w -> w <> '')")
    keyed = items.where("item is not null").withColumn("w", words("item"))
    key = lambda c, start: F.xxhash64(F.concat_ws(" ", F.slice(c, start, width)))
    long_ = keyed.where(F.size("w") >= width + 2).select("qid", "item", key(F.col("w"), F.lit(2)).alias("key"))
    d = docs.withColumn("w", words("whole"))
    at = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - width + 1), lambda n: key(F.col("w"), n))))
    found = d.where(F.size("w") >= width + 2).select(*docs.columns, at.alias("key")).join(long_, "key").where("instr(whole, item) > 0").select("qid", *docs.columns)
    short = keyed.where(F.size("w") < width + 2)
    if not short.isEmpty():
        found = found.union(short.select("qid", "item").join(docs, F.expr("instr(whole, item) > 0")).select("qid", *docs.columns))
    return found
