"""Question to sections: intents by phrases, names by substring, codes that the named labels have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions import constants as K
from attestor.functions import text as T


def intents(question: str) -> Column:
    """All intents of a question in the order of the rules."""
    low = F.lower(F.coalesce(F.col(question), F.lit("")))
    return F.array_compact(F.array(*[F.when(T.any_phrase(low, phrases), F.lit(name)) for name, phrases in K.INTENT_PHRASES]))


def intents_sql(question: str) -> str:
    low = f"lower(coalesce({question}, ''))"
    return "list_filter([" + ", ".join(f"case when {T.any_phrase_sql(low, phrases)} then '{name}' end" for name, phrases in K.INTENT_PHRASES) + "], lambda x: x is not null)"


def label_codes(chunks: DataFrame) -> DataFrame:
    """drug, codes: the section codes that each named label has. One row for each name: a dictionary, not data."""
    return chunks.groupBy("drug").agg(F.array_sort(F.collect_set("loinc")).alias("codes"))


#: Names are looked up by so many of their first letters before the whole name is compared.
KEY = 6


def named(questions: DataFrame, names: DataFrame) -> DataFrame:
    """qid, drug, pos (and what else names holds): every name that the lower-case question holds as a substring, with its place.

    An equi-join of the questions' runs of letters with the names' first KEY letters (a shorter name: all of it), so the dictionary may be of any size."""
    sizes = [r[0] for r in names.select(F.least(F.length("drug"), F.lit(KEY)).alias("n")).distinct().collect() if r[0]]
    low = questions.select("qid", F.lower("question").alias("low"))
    runs = [f"case when length(low) >= {n} then transform(sequence(1, length(low) - {n - 1}), i -> substring(low, i, {n})) else cast(array() as array<string>) end" for n in sorted(sizes)]
    keyed = low.select("qid", "low", F.explode(F.expr(f"array_distinct(concat({', '.join(runs) or 'cast(array() as array<string>)'}))")).alias("key"))
    found = keyed.join(names.withColumn("key", F.left("drug", F.lit(KEY))), "key").withColumn("pos", F.instr("low", F.col("drug"))).where("pos > 0")
    return found.drop("low", "key")


def locate(questions: DataFrame, labels: DataFrame) -> DataFrame:
    """qid, question, drug, drugs, intent, intents, loincs. labels: label_codes()."""
    hits = named(questions, labels).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "drug"))).alias("hits"), F.array_distinct(F.flatten(F.collect_list("codes"))).alias("have"))
    q = questions.select("qid", "question").join(hits, "qid", "left")
    q = q.withColumn("drugs", F.coalesce(F.expr("transform(hits, h -> h.drug)"), F.expr("cast(array() as array<string>)")))
    own = intents("question")
    q = q.withColumn("intents", F.when((F.size(own) == 0) & (F.size("drugs") >= 2), F.array(F.lit("interaction"))).otherwise(own))
    codes = F.create_map(*[x for name, c in K.INTENT_CODES.items() for x in (F.lit(name), F.array(*map(F.lit, c)))])
    wanted = F.array_distinct(F.flatten(F.transform("intents", lambda i: codes[i])))
    return q.select(
        "qid", "question", F.try_element_at("drugs", F.lit(1)).alias("drug"), "drugs", F.try_element_at("intents", F.lit(1)).alias("intent"), "intents",
        F.when(F.size("drugs") > 0, F.filter(wanted, lambda c: F.array_contains("have", c))).otherwise(wanted).alias("loincs"),
    )


def locator_accuracy(located: DataFrame, gold: DataFrame) -> DataFrame:
    """gold: qid, gold_loinc_any. n and accuracy: any located code is acceptable."""
    hit = F.arrays_overlap("loincs", "gold_loinc_any")
    return gold.join(located.select("qid", "loincs"), "qid").agg(F.count("*").alias("n"), F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("accuracy"))


_CODE_MAP = "map {" + ", ".join("'" + i + "': [" + ", ".join(f"'{c}'" for c in codes) + "]" for i, codes in K.INTENT_CODES.items()) + "}"
#: CTE located, after questions and chunks.
LOCATED_SQL = f"""label_codes as (select drug, list_sort(list(distinct loinc)) as codes from chunks group by drug),
hits as (select q.qid, list(l.drug order by instr(lower(q.question), l.drug), l.drug) as drugs, list_distinct(flatten(list(l.codes))) as have
  from questions q join label_codes l on instr(lower(q.question), l.drug) > 0 group by q.qid),
found as (select q.qid, q.question, coalesce(h.drugs, []) as drugs, h.have, {intents_sql('q.question')} as own from questions q left join hits h on q.qid = h.qid),
meant as (select *, case when len(own) = 0 and len(drugs) >= 2 then ['interaction'] else own end as intents from found),
wanted as (select *, flatten(list_transform(intents, lambda i: {_CODE_MAP}[i])) as w from meant),
located as (select qid, question, drugs[1] as drug, drugs, intents[1] as intent, intents,
  case when len(drugs) > 0 then list_filter(w, lambda c: list_contains(have, c)) else w end as loincs from wanted)"""
