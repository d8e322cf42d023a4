"""Sections to chunks under the citation contract."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from attestor.functions import constants as K
from attestor.functions import text as T
from attestor.functions import words

#: Bytes that end a sentence (of K.CHUNK_SENTENCE), and white space behind them.
MARKS, SPACES = (np.isin(np.arange(256), list(x)) for x in (b".;:!?", b" \t\n\r\f\v"))


def pack(sizes: np.ndarray, begin: np.ndarray, target: int = K.TARGET_CHARS, drop_tail: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """First and last sentence of each chunk, from the lengths of the sentences of all sections; those of section i are from begin[i] to begin[i + 1].

    A chunk closes when it has `target` characters; the next begins with its last sentence unless that was its only
    one. What is open at the end closes, followed by its last sentence alone (not with drop_tail).
    """
    at = np.r_[0, np.cumsum(sizes + 1)]
    stop = np.repeat(begin[1:], np.diff(begin))
    closes = np.searchsorted(at, at[:-1] + target)  # behind the sentence that a chunk from here would close with
    end = np.minimum(closes, stop)
    after = np.maximum(np.arange(len(sizes)) + 1, end - 1)
    firsts, here = [], begin[:-1][np.diff(begin) > 0]
    while len(here):  # the next chunk of every section that has one
        firsts.append(here)
        here = here[closes[here] <= stop[here]] if drop_tail else here
        here = after[here][after[here] < stop[here]]
    first = np.sort(np.concatenate(firsts)) if firsts else np.empty(0, np.int64)
    return first, end[first] - 1


def packed(sizes: list[int], target: int = K.TARGET_CHARS, drop_tail: bool = False) -> list[tuple[int, int]]:
    """pack() of one section."""
    first, last = pack(np.array(sizes, np.int64), np.array([0, len(sizes)]), target, drop_tail)
    return list(zip(first.tolist(), last.tolist(), strict=True))


def cut(text: pa.Array, target: int = K.TARGET_CHARS, drop_tail: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of each chunk in order its section, its text (sentences with one blank between them), its first character in the section and the one behind its last."""
    data, bounds = words.content(text)
    gap = np.flatnonzero(MARKS[data[:-1]] & SPACES[data[1:]]) if len(data) else np.empty(0, np.int64)
    row = np.searchsorted(bounds, gap, "right") - 1
    inside = gap + 1 < bounds[row + 1]
    gap, row = gap[inside], row[inside]
    solid = np.flatnonzero(~SPACES[data])
    follow = np.r_[solid, len(data)][np.searchsorted(solid, gap + 1)]
    open_ = follow < bounds[row + 1]  # else nothing stands behind the gap
    full = np.diff(bounds) > 0
    ends_at = bounds[1:][full & ~np.isin(np.arange(len(full)), row[~open_])]
    start, end = np.sort(np.r_[bounds[:-1][full], follow[open_]]), np.sort(np.r_[gap + 1, ends_at])
    begin = np.searchsorted(start, bounds)
    place = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]  # characters before each byte
    first, last = pack(place[end] - place[start], begin, target, drop_tail)
    section = np.searchsorted(bounds, start[first], "right") - 1
    stays, spaced = np.ones(len(data) + 1, np.int64), data.copy()
    spaced[gap + 1] = 32
    extra = np.minimum(follow, bounds[row + 1]) - gap - 2
    stays[np.repeat(gap + 2, extra) + words.within(extra)] = 0
    at = np.r_[0, np.cumsum(stays)]
    kept = spaced[stays[:-1] == 1]
    head = place[bounds[section]]
    return section, words.slices(kept, at[start[first]], at[end[last]]), place[start[first]] - head, place[end[last]] - head


class Numbers:
    """Numbers the chunks of a document that share a code through, from 1, over batches in which documents lie together."""

    def __init__(self) -> None:
        self.document, self.counts = None, {}

    def before(self, document: pa.Array, code: pa.Array, n: np.ndarray) -> np.ndarray:
        """How many chunks of its document and code stand before each section; n: the chunks of each section."""
        if not len(n):
            return n
        run = np.r_[0, np.cumsum(pc.fill_null(pc.not_equal(document[1:], document[:-1]), True).to_numpy(zero_copy_only=False))]
        coded = code.dictionary_encode(null_encoding="encode")
        names, kind = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        key = run * len(names) + kind
        order = np.argsort(key, kind="stable")
        sums = np.r_[0, np.cumsum(n[order])]
        heads = np.flatnonzero(np.r_[True, np.diff(key[order]) > 0])
        out = np.empty(len(n), np.int64)
        out[order] = sums[:-1] - np.repeat(sums[heads], np.diff(np.r_[heads, len(n)]))
        if document[0].as_py() == self.document:
            out += np.where(run == 0, np.array([self.counts.get(c, 0) for c in names])[kind], 0)
        mine = run == run[-1]
        kept = self.counts if run[-1] == 0 and document[0].as_py() == self.document else {}
        self.document, self.counts = document[-1].as_py(), kept | {names[k]: int(x) for k, x in zip(kind[mine].tolist(), (out + n)[mine].tolist(), strict=True)}
        return out


def build_chunks(sections: DataFrame, target: int = K.TARGET_CHARS, drop_tail: bool = False, together: bool = False) -> DataFrame:
    """chunk_key (order of the corpus), chunk_id, doc_id, loinc, section, drug, text, char_span, heading_path, content_hash.

    Sections need setid, drug, sec_ord, loinc, section, text. Blank sections give no chunk. Chunks of a document's
    sections that share a code are numbered through, from 1: documents stream in order through one pass, so neither
    a long section nor a long document takes more than its sentences and a count for each code.
    together: the sections of a document follow each other in one partition already, in order; they are not shuffled.
    """
    s = sections.select(*[F.col(c).cast("string") for c in ("setid", "drug", "loinc", "section")], F.col("sec_ord").cast("int").alias("sec_ord"), F.trim("text").alias("text")).where("text <> ''")
    if not together:
        s = s.repartition(int(sections.sparkSession.conf.get("spark.sql.shuffle.partitions")), "setid").sortWithinPartitions("setid", "sec_ord")
    out = StructType.fromDDL("setid string, drug string, sec_ord int, loinc string, section string, nth int, number long, text string, start int, end int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, numbers = to_arrow_schema(out), Numbers()
        for b in batches:
            section, texts, start, end = cut(words.whole(b.column("text")), target, drop_tail)
            n = np.bincount(section, minlength=b.num_rows)
            nth = words.within(n)
            number = numbers.before(b.column("setid"), b.column("loinc"), n)[section] + nth + 1
            own = b.select(["setid", "drug", "sec_ord", "loinc", "section"]).take(pa.array(section))
            rest = [pa.array(nth, pa.int32()), pa.array(number), texts, pa.array(start, pa.int32()), pa.array(end, pa.int32())]
            yield pa.RecordBatch.from_arrays([*own.columns, *rest], schema=schema)

    c = s.select("setid", "drug", "sec_ord", "loinc", "section", "text").mapInArrow(run, out)
    return c.select(
        F.format_string("%s#%08d#%08d", "setid", "sec_ord", "nth").alias("chunk_key"),
        F.concat_ws("#", "setid", "loinc", F.col("number").cast("string")).alias("chunk_id"),
        F.col("setid").alias("doc_id"), "loinc", "section", "drug", "text", F.struct("start", "end").alias("char_span"),
        F.concat("drug", F.lit(" / "), "section").alias("heading_path"),
        F.substring(F.sha1("text"), 1, 12).alias("content_hash"),
    )


def to_docs(ranked: DataFrame) -> DataFrame:
    """Ranked chunks as evidence: adds cite_key, title, score = 1 / rank, authority, recency, source_type."""
    return ranked.withColumns({
        "cite_key": F.concat("doc_id", F.lit("#"), "loinc"),
        "title": F.concat_ws(" | ", "chunk_id", "content_hash", "heading_path"),
        "score": 1.0 / F.col("rank"),
        "authority": F.lit(1.0), "recency": F.lit(1.0), "source_type": F.lit("dailymed_spl"),
    })


def verify_chunks(claimed: DataFrame, chunks: DataFrame) -> DataFrame:
    """claimed: chunk_id, content_hash. Adds ok and reason (unknown_chunk, hash_mismatch or ok)."""
    known = chunks.select("chunk_id", F.col("content_hash").alias("real_hash"))
    out = claimed.join(known, "chunk_id", "left")
    reason = F.when(F.col("real_hash").isNull(), "unknown_chunk").when(F.col("real_hash") != F.col("content_hash"), "hash_mismatch").otherwise("ok")
    return out.withColumn("reason", reason).withColumn("ok", F.col("reason") == "ok").drop("real_hash")


def health(chunks: DataFrame) -> DataFrame:
    """n_chunks, median_chars (upper median by sorted place), n_ids, ids_unique."""
    sizes = chunks.select("chunk_id", F.length("text").alias("size"))
    return sizes.agg(F.count("*").alias("n_chunks"), F.percentile("size", 0.5).alias("median_chars"), F.countDistinct("chunk_id").alias("n_ids")).withColumn("ids_unique", F.col("n_ids") == F.col("n_chunks"))


#: CTE chunks, after sections: the same walk as a recursion over sentences. Needs `with recursive`.
CHUNKS_SQL = f"""sents as (
  select setid, drug, sec_ord, loinc, section, text, {T.sentences_sql('text', '.;:!?')} as s from sections),
cut as (select setid, drug, sec_ord, loinc, section, text, s, list_transform(s, lambda x: length(x)) as sizes from sents where len(s) > 0),
walk as (
  select setid, sec_ord, 0 as k, 0 as start, 0 as cur, -1 as a1, -1 as b1, -1 as a2 from cut
  union all
  select w.setid, w.sec_ord, w.k + 1,
    case when w.cur + c.sizes[w.k + 1] + 1 < {K.TARGET_CHARS} then w.start when w.start = w.k or c.sizes[w.k + 1] + 1 >= {K.TARGET_CHARS} then w.k + 1 else w.k end,
    case when w.cur + c.sizes[w.k + 1] + 1 < {K.TARGET_CHARS} then w.cur + c.sizes[w.k + 1] + 1 when w.start = w.k or c.sizes[w.k + 1] + 1 >= {K.TARGET_CHARS} then 0 else c.sizes[w.k + 1] + 1 end,
    case when w.cur + c.sizes[w.k + 1] + 1 < {K.TARGET_CHARS} then -1 else w.start end,
    case when w.cur + c.sizes[w.k + 1] + 1 < {K.TARGET_CHARS} then -1 else w.k end,
    case when w.cur + c.sizes[w.k + 1] + 1 >= {K.TARGET_CHARS} and w.start <> w.k and c.sizes[w.k + 1] + 1 >= {K.TARGET_CHARS} then w.k else -1 end
  from walk w join cut c on w.setid = c.setid and w.sec_ord = c.sec_ord where w.k < len(c.sizes)),
spans as (
  select setid, sec_ord, a1 as a, b1 as b from walk where a1 >= 0
  union all select setid, sec_ord, a2, a2 from walk where a2 >= 0
  union all select w.setid, w.sec_ord, w.start, len(c.sizes) - 1 from walk w join cut c on w.setid = c.setid and w.sec_ord = c.sec_ord where w.k = len(c.sizes) and w.start < len(c.sizes)
  union all select w.setid, w.sec_ord, len(c.sizes) - 1, len(c.sizes) - 1 from walk w join cut c on w.setid = c.setid and w.sec_ord = c.sec_ord where w.k = len(c.sizes) and w.start < len(c.sizes) - 1),
numbered as (
  select c.setid, c.drug, c.sec_ord, c.loinc, c.section, row_number() over (partition by c.setid, c.sec_ord order by p.a, p.b desc) - 1 as nth, array_to_string(c.s[p.a + 1:p.b + 1], ' ') as text
  from spans p join cut c on p.setid = c.setid and p.sec_ord = c.sec_ord),
chunks as (
  select printf('%s#%08d#%08d', setid, sec_ord, nth) as chunk_key, setid || '#' || loinc || '#' || row_number() over (partition by setid, loinc order by sec_ord, nth) as chunk_id,
    setid as doc_id, loinc, section, drug, text, drug || ' / ' || section as heading_path, substr(sha1(text), 1, 12) as content_hash from numbered)"""
