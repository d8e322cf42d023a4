"""Labels in, evaluation files and ledgers out."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from attestor.functions import constants as K

LABEL_SCHEMA = "labels array<struct<drug:string,setid:string,sections:array<struct<loinc:string,section:string,display:string,text:string>>>>"
MIN_CHARS, MAX_CHARS = 60, 4000


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """setid, drug, sec_ord, loinc, section, text of a label file: schema fixed, nothing inferred."""
    labels = spark.read.schema(LABEL_SCHEMA).option("multiLine", True).json(path).select(F.explode("labels").alias("l"))
    return labels.select("l.setid", "l.drug", F.posexplode("l.sections").alias("sec_ord", "s")).select("setid", "drug", "sec_ord", "s.loinc", "s.section", F.trim("s.text").alias("text"))


_HL7 = "{urn:hl7-org:v3}"


def _section_text(section: ElementTree.Element) -> str:
    """The text elements of a section, or all of its text if it has none, without the sections inside it; white space collapses."""
    texts, every, waiting = [], [], [(section, False)]
    while waiting:
        at, inside = waiting.pop()
        if isinstance(at, str):
            every.append(at)
            if inside:
                texts.append(at)
            continue
        if at is not section and at.tag == f"{_HL7}section":
            continue
        here = inside or at.tag == f"{_HL7}text"
        if at.tag == f"{_HL7}text" and not inside:
            texts.append(" ")
        waiting += [x for child in reversed(at) for x in ((child.tail or "", here), (child, here))] + [(at.text or "", here)]
    return " ".join("".join(texts if "".join(texts).strip() else every).split())


def read_label_xml(spark: SparkSession, path: str) -> DataFrame:
    """setid, sec_ord, loinc, section, display, text of label documents in XML, one file each, nested sections flattened.

    Kept are sections of the codes in K.LABEL_SECTIONS with more than MIN_CHARS characters, cut at MAX_CHARS (a rule of labels).
    A file that is no XML fails the job."""
    out = StructType.fromDDL("setid string, sec_ord int, loinc string, section string, display string, text string")
    names = dict(K.LABEL_SECTIONS)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                root, rows = ElementTree.fromstring(content.as_py()), []
                setid = root.find(f"{_HL7}setId")
                for section in root.iter(f"{_HL7}section"):
                    code = section.find(f"{_HL7}code")
                    if code is not None and code.get("code") in names and len(text := _section_text(section)) > MIN_CHARS:
                        rows.append((setid.get("root") if setid is not None else None, len(rows), code.get("code"), names[code.get("code")], code.get("displayName"), text[:MAX_CHARS]))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [()] * 6, to_arrow_schema(out), strict=True)], schema=to_arrow_schema(out))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, out)


def write_eval_set(path: str, rows: DataFrame, note: str = "") -> None:
    """A set as one JSON object (n, note, rows in the order of qid), as read_eval_set reads it. Evaluation sets are small: one row holds all."""
    held = F.transform(F.array_sort(F.collect_list(F.struct("qid", F.struct(*rows.columns).alias("r")))), lambda x: x["r"])
    rows.agg(F.to_json(F.struct(F.count("*").alias("n"), F.lit(note).alias("note"), held.alias("rows"))).alias("value")).write.mode("overwrite").text(path)


def write_decisions(path: str, points: DataFrame) -> None:
    """Decision points as JSON lines, each with what its replays say (decisions.signals)."""
    from attestor.operators.decisions import signals

    signals(points).write.mode("overwrite").json(path)


def write_report(path: str, **tables: DataFrame) -> None:
    """Tables of measures as one JSON object, a list of rows under each name."""
    parts = [df.agg(F.collect_list(F.struct(*df.columns)).alias(name)) for name, df in tables.items()]
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.join(F.broadcast(more))  # one row each
    whole.select(F.to_json(F.struct(*tables)).alias("value")).write.mode("overwrite").text(path)


def read_eval_set(spark: SparkSession, path: str, row_schema: str) -> DataFrame:
    return spark.read.schema(f"n int, note string, rows array<struct<{row_schema}>>").option("multiLine", True).json(path).select(F.explode("rows").alias("r")).select("r.*")


def pick_label(hits: DataFrame) -> DataFrame:
    """hits: drug, setid, ord, has_interactions (of the first 20 hits). One label for each name: the first with interactions, else the first."""
    w = Window.partitionBy("drug").orderBy(F.desc("has_interactions"), "ord")
    return hits.where("ord < 20").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def page_sections(pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """page_id, url, title, sec_ord, text: paragraphs of a page without script, style, navigation, footer and advertisements.

    White space collapses; paragraphs of MIN_CHARS or fewer go; the rest is cut at max_chars, if that is given."""
    html = F.col("html")
    for tag in ("script", "style", "nav", "footer", "aside"):
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    html = F.regexp_replace(F.regexp_replace(html, r"(?is)<!--.*?-->", " "), r"(?is)<div class=\"ad\">.*?</div>", " ")
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))
    p = pages.select("page_id", "url", html.alias("html"))
    p = p.withColumn("parts", F.split("html", r"(?i)<p\b[^>]*>"))
    p = p.select("page_id", "url", plain(F.regexp_extract("html", r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)).alias("title"), F.posexplode(F.expr("slice(parts, 2, size(parts))")).alias("sec_ord", "raw"))
    p = p.withColumn("text", plain(F.regexp_replace("raw", r"(?is)</(p|article)>.*$", "")))
    return p.where(F.length("text") > MIN_CHARS).select("page_id", "url", "title", "sec_ord", (F.substring("text", 1, max_chars) if max_chars else F.col("text")).alias("text"))


def grow(have: DataFrame, candidates: DataFrame, target: int, min_sections: int = 3) -> DataFrame:
    """have: drug; candidates: drug, ord, n_sections. New labels in list order until `target` names are there."""
    need = F.greatest(F.lit(target) - F.col("n"), F.lit(0))
    new = candidates.where(F.col("n_sections") >= min_sections).join(have.select("drug"), "drug", "left_anti")
    new = new.orderBy("ord", "drug").limit(target).withColumn("place", F.row_number().over(Window.orderBy("ord", "drug")))
    return new.join(F.broadcast(have.agg(F.countDistinct("drug").alias("n")))).where(F.col("place") <= need).select("drug", "ord", "place")


def fingerprint(chunks: DataFrame, buckets: int = 256) -> DataFrame:
    """fingerprint, n: 16 hex digits over all texts in corpus order, as the hash of ordered bucket hashes of row hashes.

    Not the hash of the joined texts, which would need all of them in one row."""
    rows = chunks.select(F.pmod(F.xxhash64("chunk_key"), F.lit(buckets)).alias("b"), "chunk_key", F.sha1("text").alias("h"))
    parts = rows.groupBy("b").agg(F.expr("bit_xor(conv(substring(sha1(concat(chunk_key, ':', h)), 1, 15), 16, 10) + 0L)").alias("x"), F.count("*").alias("n"))
    return parts.agg(F.substring(F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "x"))), lambda s: s["x"].cast("string")), ",")), 1, 16).alias("fingerprint"), F.sum("n").alias("n"))


def cached(requests: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Requests with their cached value, and those that must be computed; the key names model and input."""
    c = cache.select(key, "value")
    return requests.join(c, key), requests.join(c, key, "left_anti")


def trace(steps: DataFrame) -> DataFrame:
    """run_id, trace: the steps of a run as lines."""
    line = F.concat(F.lit("#"), F.col("step").cast("string"), F.lit(" "), "action", F.lit(" cost="), F.col("cost").cast("string"), F.lit(" left="), F.col("budget_left").cast("string"))
    return steps.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", line.alias("line")))), lambda s: s["line"]), "\n").alias("trace"))


def save_ledger(path: str, batch: str | None = None, **tables: DataFrame) -> None:
    """One folder for each table (steps, docs, claims, cites, carried): carried evidence is kept too. With a batch of runs, one in it
    for each batch: a batch that is saved again replaces itself, table by table, and leaves the others."""
    for name, df in tables.items():
        if batch is None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        else:
            df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/{name}")


def load_ledger(spark: SparkSession, path: str, *names: str, batches: list[str] | None = None, check: bool = True) -> dict[str, DataFrame]:
    """The tables, or some batches of them, of which only their folders are read. With check, rows that break a rule of the ledger fail the query that reads them."""
    from attestor.operators.ledger import checked

    out = {}
    for name in names:
        rows = spark.read.parquet(f"{path}/{name}")
        if "batch" in rows.columns:
            rows = rows.withColumn("batch", F.col("batch").cast("string"))
        rows = rows if batches is None else rows.where(F.col("batch").isin(batches))
        out[name] = checked(name, rows) if check else rows
    return out
