"""Stand-in tables of the engine over the driver's tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from attestor.functions import constants as K
from attestor.functions import text as T
from attestor.functions import words
from attestor.sources.prose import EvalProse

#: Prose of our own for the stand-in tables.
PROSE = EvalProse(
    templates={
        "interaction": ["Do {drug} and {entity} interact?", "What happens to people combining {drug} with {entity}?", "May {entity} go together with {drug}?"],
        "contraindication": ["For whom with {entity} is {drug} contraindicated?", "Would {drug} be safe for someone who lives with {entity}?", "Is {drug} off-limits because of {entity}?"],
        "dosage": ["Which dose of {drug} is usual?", "How many tablets of {drug} make up a day?", "State the dosage of {drug}."],
        "indication": ["Against what would a clinic prescribe {drug}?", "Which complaints does one treat by {drug}?"],
        "precaution": ["Which warning goes with {drug}?", "When must somebody on {drug} be careful?"],
    },
    probes={
        "interaction": ["Does {drug} play nicely with others?", "Anything that clashes with {drug}?", "Is {drug} fine next to my pills?", "Does {drug} quarrel with tea?"],
        "contraindication": ["Who had better leave {drug} alone?", "Any people {drug} is wrong for?", "Is {drug} a bad idea for some?", "Which patients stay away from {drug}?"],
        "dosage": ["Size of a {drug} serving?", "One {drug} or two?", "What quantity of {drug} is normal?", "{drug}: every morning or every evening?"],
        "indication": ["The point of {drug}?", "What good is {drug}?", "Why do people have {drug} at home?", "{drug} helps against what?"],
        "precaution": ["Anything odd to expect from {drug}?", "Risks of {drug}?", "What may go wrong on {drug}?", "How does one stay out of trouble with {drug}?"],
    },
    out_of_scope=["Which river is the longest?", "Please hum a tune.", "How is bread baked?", "When does the last ferry leave?", "Name a prime above one hundred.", "Who painted the ceiling of that chapel?"],
    beyond_label=["Shall I give up {drug} today?", "For how many years will I need {drug}?", "Does {drug} heal me for good?"],
    names=["quillamab", "brantozole", "sovatriptan", "lumenol", "teckleride", "orrinex", "padvexin", "mossamide", "vexaril", "hollowine", "src3", "pennafil"],
    unknown="Is {name} something for me?",
    aspects=[("unwanted effects", "34084-4"), ("trials in people", "34090-1"), ("workings inside the body", "34083-6")],
    missing="What is known of the {aspect} of {drug}?",
    opening="Which complaints does one treat by {drug}?",
    follow_ups=[("And wine on top of that?", "interaction"), ("Which dose of it is usual?", "dosage"), ("Does it come with a warning?", "precaution"), ("Who is this contraindicated for?", "contraindication"), ("What do doctors prescribe them for?", "indication")],
    scripts={
        "dose_then_warning": ["Which dose of {drug} is usual?", "Does it come with a warning?"],
        "use_then_dose": ["Against what would a clinic prescribe {drug}?", "How many tablets of it make up a day?"],
        "combination": ["Do {drug} and {entity} interact?", "What happens to people combining them?"],
        "same_again": ["Which warning goes with {drug}?", "Which warning goes with {drug}?"],
        "three_turns": ["State the dosage of {drug}.", "Is it off-limits because of {entity}?", "What about the dose then?"],
    },
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sections(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    """setid, drug, sec_ord, loinc, section, text: the lines of a document are its sections, their codes go round. documents: some of them (all)."""
    codes = F.array(*[F.struct(F.lit(c).alias("loinc"), F.lit(n).alias("section")) for c, n in K.SECTIONS])
    documents = table(spark, sf_dir, "documents") if documents is None else documents
    lines = documents.select(F.format_string("%08d", "doc_id").alias("setid"), F.col("source").alias("drug"), F.posexplode(F.split("text", "\n")).alias("sec_ord", "text"))
    lines = lines.where(F.trim("text") != "").withColumn("c", codes[F.col("sec_ord") % len(K.SECTIONS)])
    return lines.select("setid", "drug", "sec_ord", "c.loinc", "c.section", F.trim("text").alias("text"))


_CODES = ", ".join(f"'{c}'" for c, _ in K.SECTIONS)
_NAMES = ", ".join(f"'{n}'" for _, n in K.SECTIONS)
#: CTE sections.
SECTIONS_SQL = f"""lines as (
  select printf('%08d', doc_id) as setid, source as drug, unnest(string_split(text, chr(10))) as text, unnest(range(len(string_split(text, chr(10))))) as sec_ord from documents),
sections as (
  select setid, drug, sec_ord::int as sec_ord, ([{_CODES}])[sec_ord % {len(K.SECTIONS)} + 1] as loinc, ([{_NAMES}])[sec_ord % {len(K.SECTIONS)} + 1] as section, trim(text) as text from lines where trim(text) <> '')"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, question: each benchmark item, framed by a template over a source."""
    frames = [t for _, _, t in PROSE.frames]
    frame = F.array(*[F.lit(f) for f in frames])[(F.col("item_id") % len(frames)).cast("int")]
    name = F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))
    asked = F.replace(F.replace(frame, F.lit("{drug}"), name), F.lit("{entity}"), F.lit("it"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.concat(asked, F.lit(" "), "text").alias("question"))


#: Dimensions of the stand-in vectors.
DIMS = 32


def directions(names: pa.Array, code: np.ndarray, row: np.ndarray, size: int) -> np.ndarray:
    """Stand-in vectors of some texts from their tokens (words.tokens()): counts by their ends and length, of unit length; zeros without tokens."""
    at = np.array([(ord(t[0]) * 31 + ord(t[-1]) * 7 + len(t)) % DIMS for t in names.to_pylist()], np.int64)
    n = np.bincount(row * DIMS + at[code], minlength=size * DIMS).reshape(-1, DIMS).astype(float)
    norm = np.sqrt((n * n).sum(axis=1))
    n /= np.where(norm > 0, norm, 1.0)[:, None]
    return n


def encoded(rows: DataFrame, text: str) -> DataFrame:
    """Adds vector, a stand-in for an encoder's (null without tokens)."""
    out = StructType([*rows.schema, StructField("vector", ArrayType(DoubleType()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        for b in batches:
            n = directions(*words.tokens(words.whole(b.column("__plain"))), b.num_rows)
            some = n.any(axis=1)
            vectors = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(DIMS * some)], pa.int32()), pa.array(n[some].ravel()), mask=pa.array(~some))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], vectors.cast(schema.field("vector").type)], schema=schema)

    return rows.withColumn("__plain", T.plain(text)).mapInArrow(count, out)


def encoded_sql(text: str) -> str:
    at = f"list_transform({T.tokens_sql(text)}, lambda t: (ascii(t) * 31 + ascii(right(t, 1)) * 7 + length(t)) % {DIMS})"
    counts = f"list_transform(range({DIMS}), lambda k: len(list_filter({at}, lambda x: x = k))::double)"
    return f"list_transform([{counts}], lambda c: case when list_sum(c) > 0 then list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) end)[1]"


_FRAMES = ", ".join("'" + t.replace("'", "''") + "'" for _, _, t in PROSE.frames)
_N = len(PROSE.frames)
#: CTE questions.
QUESTIONS_SQL = f"""questions as (
  select item_id as qid, replace(replace(([{_FRAMES}])[item_id % {_N} + 1], '{{drug}}', 'src' || (item_id % 20)), '{{entity}}', 'it') || ' ' || text as question from benchmark)"""
