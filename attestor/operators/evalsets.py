"""Evaluation sets: generation, capped sampling and audits. All orders are total, so a set does not move with its input's order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions import constants as K
from attestor.sources.prose import EvalProse


def _templates(spark, prose: EvalProse) -> DataFrame:
    rows = [(i, n, t, "{entity}" in t) for i, n, t in prose.frames]
    return F.broadcast(spark.createDataFrame(rows, "intent string, template_id int, template string, needs_entity boolean"))


def _codes() -> Column:
    return F.create_map(*[x for i, codes in K.INTENT_CODES.items() for x in (F.lit(i), F.array(*map(F.lit, codes)))])


def locate_set(labels: DataFrame, entities: DataFrame, prose: EvalProse) -> DataFrame:
    """labels: drug, codes; entities: drug, intent, entity. Every template over every label that has a section for its intent.

    qid, question, intent, drug, entity, template_id, gold_loinc (first code of the intent that the label has), gold_loinc_any."""
    t = _templates(labels.sparkSession, prose)
    any_ = F.filter(_codes()[F.col("intent")], lambda c: F.array_contains("codes", c))
    q = labels.join(t).withColumn("gold_loinc_any", any_).where(F.size("gold_loinc_any") > 0)
    named = q.where("needs_entity").join(entities, ["drug", "intent"])
    plain = q.where("not needs_entity").withColumn("entity", F.lit(None).cast("string"))
    both = named.unionByName(plain)
    text = F.replace(F.replace(F.col("template"), F.lit("{drug}"), F.col("drug")), F.lit("{entity}"), F.coalesce("entity", F.lit("")))
    key = F.concat_ws("|", "drug", "intent", F.format_string("%03d", "template_id"), F.coalesce("entity", F.lit("")))
    return both.select(key.alias("qid"), text.alias("question"), "intent", "drug", "entity", "template_id", F.element_at("gold_loinc_any", 1).alias("gold_loinc"), "gold_loinc_any")


def without_tautologies(rows: DataFrame) -> DataFrame:
    """Questions whose entity holds the label's own name are no questions."""
    return rows.where("entity is null or not contains(lower(entity), lower(drug))")


def boundary_set(labels: DataFrame, prose: EvalProse, unknown: int = 8) -> DataFrame:
    """labels: drug, codes. question, boundary_class, expect_action: four kinds of questions that must not be answered.
    Names that are absent are found in the corpus as it is, never listed."""
    spark = labels.sparkSession
    row = lambda df, kind: df.select("question", F.lit(kind).alias("boundary_class"), F.lit(K.EXPECTED[kind]).alias("expect_action"))
    out = row(spark.createDataFrame([(q,) for q in prose.out_of_scope], "question string"), "out_of_scope")
    frames = F.broadcast(spark.createDataFrame([(t,) for t in prose.beyond_label], "t string"))
    out = out.union(row(labels.join(frames).select(F.replace(F.col("t"), F.lit("{drug}"), F.col("drug")).alias("question")), "beyond_label"))
    names = spark.createDataFrame(list(enumerate(prose.names)), "k int, name string").join(labels.select(F.lower("drug").alias("name")), "name", "left_anti").orderBy("k").limit(unknown)
    out = out.union(row(names.select(F.replace(F.lit(prose.unknown), F.lit("{name}"), F.col("name")).alias("question")), "unknown_drug"))
    aspects = F.broadcast(spark.createDataFrame(prose.aspects, "aspect string, code string"))
    missing = labels.join(aspects).where(~F.array_contains("codes", F.col("code"))).select(F.replace(F.replace(F.lit(prose.missing), F.lit("{aspect}"), F.col("aspect")), F.lit("{drug}"), F.col("drug")).alias("question"))
    return out.union(row(missing, "missing_section"))


def paired_set(rows: DataFrame) -> DataFrame:
    """rows: locate_set(). One direct and one paraphrased question for each label, intent and entity: qid, tier, question, pair, gold_loinc."""
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("drug", "intent", "entity").orderBy("template_id"))).where("n <= 2")
    pair = F.concat_ws("|", "drug", "intent", F.coalesce("entity", F.lit("")))
    tier = F.when(F.col("n") == 1, "direct").otherwise("paraphrase")
    return first.select(F.concat_ws("|", pair, tier).alias("qid"), tier.alias("tier"), "question", pair.alias("pair"), "drug", "gold_loinc")


def cap_round_robin(rows: DataFrame, cap: int, key: str, order: str) -> DataFrame:
    """One row of each key per pass, keys in order, until `cap` rows. Adds place."""
    turn = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("turn", turn).orderBy("turn", key).limit(cap).drop("turn")


def cap_stratified(rows: DataFrame, cap: int, stratum: str, spread: str, order: str) -> DataFrame:
    """At most max(1, cap // strata) rows of each stratum, dealt round robin over `spread` inside."""
    strata = rows.select(stratum).distinct().agg(F.greatest(F.lit(1), F.floor(F.lit(cap) / F.greatest(F.count("*"), F.lit(1)))).alias("share"))
    x = rows.withColumn("turn", F.row_number().over(Window.partitionBy(stratum, spread).orderBy(order)))
    x = x.withColumn("place", F.row_number().over(Window.partitionBy(stratum).orderBy("turn", spread)))
    return x.join(F.broadcast(strata)).where(F.col("place") <= F.col("share")).drop("turn", "place", "share")


def cap_paired(rows: DataFrame, cap: int, pair: str, key: str) -> DataFrame:
    """Whole pairs, round robin over `key`, while fewer than `cap` rows are taken: the last pair may overshoot."""
    sizes = rows.groupBy(pair, key).agg(F.count("*").alias("size"))
    sizes = sizes.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy(pair)))
    before = F.coalesce(F.sum("size").over(Window.orderBy("turn", key, pair).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = sizes.orderBy("turn", key, pair).limit(cap).withColumn("before", before).where(F.col("before") < cap)  # each pair has a row at least
    return rows.join(taken.select(pair), pair, "left_semi")


def probe_set(drugs: DataFrame, templates: list[tuple[str, int, str]], undetected, width: int = 6, stride: int = 3) -> DataFrame:
    """templates: intent, id, text. Each over `width` labels, rotated by stride; undetected(question column) keeps what the router must not see.
    intent, template_id, split (dev for ids 0 and 1), drug, question."""
    spark = drugs.sparkSession
    t = F.broadcast(spark.createDataFrame([(k, *x) for k, x in enumerate(templates)], "k int, intent string, template_id int, template string"))
    named = drugs.select("drug").distinct()
    place = named.select("drug", (F.row_number().over(Window.orderBy("drug")) - 1).alias("at"), F.count("*").over(Window.partitionBy(F.lit(1))).alias("n"))
    turn = F.pmod(F.col("at") - F.col("k") * stride, F.col("n"))
    rows = place.join(t).where(turn < width).withColumn("question", F.replace(F.col("template"), F.lit("{drug}"), F.col("drug")))
    return rows.where(undetected("question")).select("intent", "template_id", F.when(F.col("template_id") < 2, "dev").otherwise("test").alias("split"), "drug", "question")


def hard_set(labels: DataFrame, mentions: DataFrame) -> DataFrame:
    """Questions with two golds: two sections of a label, or two labels of which one mentions the other; the families take turns.
    labels: drug, codes; mentions: speaker, about. place, kind, drugs, golds."""
    x = labels.select("drug", F.explode("codes").alias("c"))
    two = x.alias("a").join(x.alias("b"), F.expr("a.drug = b.drug and a.c < b.c")).select(F.lit("multi_section").alias("kind"), F.array("a.drug").alias("drugs"), F.array(F.concat("a.drug", F.lit("#"), "a.c"), F.concat("b.drug", F.lit("#"), "b.c")).alias("golds"))
    code = K.INTENT_CODES["interaction"][0]
    cross = mentions.select("speaker", "about").distinct().select(F.lit("cross_drug").alias("kind"), F.array("speaker", "about").alias("drugs"), F.array(F.concat("speaker", F.lit(f"#{code}")), F.concat("about", F.lit(f"#{code}"))).alias("golds"))
    both = two.union(cross)
    return both.withColumn("turn", F.row_number().over(Window.partitionBy("kind").orderBy("golds"))).select("turn", "kind", F.array_join("drugs", ",").alias("drugs"), F.array_join("golds", ",").alias("golds"))


def audit(rows: DataFrame) -> DataFrame:
    """check, n: rows of a set that break a rule (question twice, code malformed, gold not acceptable)."""
    twice = rows.groupBy("question").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n")).select(F.lit("question_twice").alias("check"), "n")
    code = rows.agg(F.count_if(~F.col("gold_loinc").rlike(r"^\d{5}-\d$")).alias("n")).select(F.lit("code_malformed").alias("check"), "n")
    gold = rows.agg(F.count_if(~F.array_contains("gold_loinc_any", F.col("gold_loinc"))).alias("n")).select(F.lit("gold_not_acceptable").alias("check"), "n")
    wide = rows.agg(F.countDistinct("drug").alias("n")).select(F.lit("labels_covered").alias("check"), "n")
    return twice.union(code).union(gold).union(wide)


def extract_entities(sections: DataFrame, patterns: dict[str, list[str]], codes: dict[str, str], blacklist: list[str]) -> DataFrame:
    """sections: drug, loinc, text. drug, intent, entity: cleaned names that the intent's patterns find in the sections of
    its code; one of each spelling, none that is blacklisted, too short or too long, glued, or ends in a function word."""
    from attestor.functions.text import clean_entity

    out = None
    for intent, found in patterns.items():
        hits = F.flatten(F.array(*[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in found]))
        part = sections.where(F.col("loinc") == codes[intent]).select("drug", F.lit(intent).alias("intent"), F.explode(hits).alias("raw"))
        out = part if out is None else out.union(part)
    e = out.withColumn("entity", clean_entity(F.col("raw"))).withColumn("low", F.lower("entity")).withColumn("words", F.split("low", " "))
    good = (F.length("low") > 3) & ~F.element_at("words", 1).isin(blacklist) & F.size("words").between(1, 6) & (F.col("low") != F.lower("drug"))
    good = good & ~F.col("entity").rlike(r"(?i)\b(or|and|with|of|to|the|a|an)$") & ~F.col("entity").rlike("[a-z][A-Z]")
    return e.where(good).groupBy("drug", "intent", "low").agg(F.min("entity").alias("entity")).drop("low")


def answerable(rows: DataFrame) -> DataFrame:
    """rows: entity, target (text). Keeps entities that look like one and whose first word stands in the target."""
    core = F.lower(F.regexp_replace(F.element_at(F.split("entity", " "), 1), r"^[,.()]+|[,.()]+$", ""))
    return rows.where(F.col("entity").rlike(r"^[A-Za-z][A-Za-z\- ]{3,60}$") & ~core.isin("with", "and", "or", "the", "a", "an", "this", "that", "these") & (F.length(core) >= 4) & F.contains(F.lower("target"), core))


def intent_set(labels: DataFrame, prose: EvalProse) -> DataFrame:
    """labels: drug, codes. Two turns, the second by anaphora: qid, turns, referent, intent, resolved_query, gold_loinc."""
    t = F.broadcast(labels.sparkSession.createDataFrame([(k, *x) for k, x in enumerate(prose.follow_ups)], "k int, follow_up string, intent string"))
    first = F.replace(F.lit(prose.opening), F.lit("{drug}"), F.col("drug"))
    rows = labels.join(t).withColumn("gold", F.filter(_codes()[F.col("intent")], lambda c: F.array_contains("codes", c))).where(F.size("gold") > 0)
    return rows.select(F.concat_ws("|", "drug", "k").alias("qid"), F.array(first, "follow_up").alias("turns"), F.col("drug").alias("referent"), "intent", F.concat("follow_up", F.lit(" ("), "drug", F.lit(")")).alias("resolved_query"), F.element_at("gold", 1).alias("gold_loinc"))


def e2e_set(labels: DataFrame, entities: DataFrame, prose: EvalProse) -> DataFrame:
    """Scripted sessions over labels; a script that names an entity is only made where there is one."""
    s = F.broadcast(labels.sparkSession.createDataFrame(list(prose.scripts.items()), "scenario string, script array<string>"))
    one = entities.groupBy("drug").agg(F.min("entity").alias("entity"))
    rows = labels.join(s).join(one, "drug", "left").where("entity is not null or not exists(script, x -> contains(x, '{entity}'))")
    filled = F.transform("script", lambda x: F.replace(F.replace(x, F.lit("{drug}"), F.col("drug")), F.lit("{entity}"), F.coalesce("entity", F.lit(""))))
    return rows.select(F.concat_ws("|", "drug", "scenario").alias("qid"), "scenario", "drug", filled.alias("turns"), F.size("script").alias("n_turns"))


def unsupported_golds(questions: DataFrame, corpus_keys: DataFrame) -> DataFrame:
    """questions: qid, golds (citation keys). Hand-written golds that the corpus does not hold."""
    g = questions.select("qid", F.explode("golds").alias("cite_key"))
    return g.join(corpus_keys.select("cite_key").distinct(), "cite_key", "left_anti")


def manifest(sets: dict[str, DataFrame]) -> DataFrame:
    """name, n: rows of each set."""
    out = None
    for name, rows in sets.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out
