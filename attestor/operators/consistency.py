"""Do two labels warn about each other alike, and does an answer cite both sides?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions import constants as K
from attestor.functions import text as T


def audit_sentences(chunks: DataFrame) -> DataFrame:
    """speaker, ord, section, sentence: the sentences of a label's chunks in corpus order; overlaps count twice."""
    s = chunks.select(F.col("drug").alias("speaker"), "chunk_key", "section", F.posexplode(T.sentences("text", K.AUDIT_SENTENCE)).alias("pos", "sentence"))
    return s.select("speaker", F.format_string("%s#%08d", "chunk_key", "pos").alias("ord"), "section", F.trim("sentence").alias("sentence"))


def sides(sentences: DataFrame, names: DataFrame, warning: str = K.WARNING, header: str = K.TABLE_HEADER) -> DataFrame:
    """names: drug, name. speaker, about, label (warn, mention), sentence, section, n_hits: what each label says of each other name.

    A name is found by its first token, an equi-join; only those sentences are tested for the whole word."""
    s = sentences.withColumn("token", F.explode(F.array_distinct(F.expr("regexp_extract_all(lower(sentence), '([a-z0-9]+)', 1)"))))
    n = names.select(F.col("drug").alias("about"), "name", F.regexp_extract(F.lower("name"), "([a-z0-9]+)", 1).alias("token"))
    hits = s.join(n, "token").where("about <> speaker").where(T.names_it(F.col("sentence"), F.col("name")))
    head = F.col("sentence").rlike(f"(?i){header}")
    warns = F.col("sentence").rlike(f"(?i){warning}") & ~head
    rank = F.when(warns, 0).when(~head, 1).otherwise(2)
    best = F.min(F.struct(rank.alias("r"), "ord", "sentence", "section"))
    out = hits.groupBy("speaker", "about").agg(best.alias("b"), F.count("*").alias("n_hits"))
    return out.select("speaker", "about", F.when(F.col("b.r") == 0, "warn").otherwise("mention").alias("label"), "b.sentence", "b.section", "n_hits")


def pairs(sides: DataFrame, names: DataFrame) -> DataFrame:
    """a, b, kind for every ordered pair of names: both_warn, asymmetric_a, asymmetric_b, both_mention, both_absent, mention_absent."""
    a, b = names.select(F.col("drug").alias("a")), names.select(F.col("drug").alias("b"))
    said = sides.select(F.col("speaker").alias("a"), F.col("about").alias("b"), F.col("label").alias("x"))
    back = sides.select(F.col("about").alias("a"), F.col("speaker").alias("b"), F.col("label").alias("y"))
    p = a.join(b, F.expr("a <> b")).join(said, ["a", "b"], "left").join(back, ["a", "b"], "left").fillna("absent", ["x", "y"])
    return p.select("a", "b", "x", "y", _kind().alias("kind"))


def _kind() -> Column:
    return F.when((F.col("x") == "warn") & (F.col("y") == "warn"), "both_warn").when(F.col("x") == "warn", "asymmetric_a").when(F.col("y") == "warn", "asymmetric_b").when((F.col("x") == "absent") & (F.col("y") == "absent"), "both_absent").otherwise("both_mention")


def kind_counts(sides: DataFrame, names: DataFrame) -> DataFrame:
    """kind, n: how many ordered pairs of names are of each kind, as pairs would count them. Only pairs of which a side says
    something are rows; those of which neither does are all others, a closed count."""
    known = names.select("drug").distinct()
    s = sides.join(known.withColumnRenamed("drug", "speaker"), "speaker", "left_semi").join(known.withColumnRenamed("drug", "about"), "about", "left_semi")
    said = s.select(F.col("speaker").alias("a"), F.col("about").alias("b"), F.col("label").alias("x"))
    back = s.select(F.col("about").alias("a"), F.col("speaker").alias("b"), F.col("label").alias("y"))
    some = said.join(back, ["a", "b"], "full_outer").fillna("absent", ["x", "y"]).groupBy(_kind().alias("kind")).agg(F.count("*").alias("n"))
    every = known.agg((F.count("*") * (F.count("*") - 1)).alias("n")).select(F.lit("both_absent").alias("kind"), "n")
    return some.union(every).union(some.select(F.lit("both_absent"), -F.col("n"))).groupBy("kind").agg(F.sum("n").alias("n")).where("n > 0")


def citation_balance(pairs: DataFrame, cited: DataFrame) -> DataFrame:
    """cited: run_id, a, b, cites (labels that the answer cites). run_id, a, b, ok, problems.

    A side that says something but is not cited is selective_citation; a silent side is silent_unstated, whatever the answer says."""
    side = lambda me, label: F.array_compact(F.array(F.when((F.col(label) != "absent") & ~F.array_contains("cites", F.col(me)), F.concat(F.lit("selective_citation:"), F.col(me))), F.when(F.col(label) == "absent", F.concat(F.lit("silent_unstated:"), F.col(me)))))
    x = cited.join(pairs.select("a", "b", "x", "y"), ["a", "b"]).withColumn("problems", F.concat(side("a", "x"), side("b", "y")))
    return x.select("run_id", "a", "b", (F.size("problems") == 0).alias("ok"), "problems")
