"""Lexical, dense and structural ranking, fusion and restriction, for whole question sets at once.

Every ranking has a total order that ends in the chunk's key. Scores are rounded to 9 places before they are
ranked, so that equal scores stay equal in whatever order they were added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from attestor.functions import constants as K
from attestor.functions import text as T
from attestor.functions import words
from attestor.operators.segments import SegmentedIndex
from attestor.sources.scratch import Workspace


def bm25_postings(chunks: DataFrame) -> DataFrame:
    """term, chunk_key, tf, dl, idf, avgdl of all chunks as rows: one pass over the chunks for terms, one aggregate for lengths, one for document
    frequencies. To look at; questions are asked of operators.segments."""
    tok = chunks.select("chunk_key", T.tokens("text").alias("tok")).withColumn("dl", F.size("tok"))
    stats = tok.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = tok.select("chunk_key", "dl", F.explode("tok").alias("term")).groupBy("term", "chunk_key", "dl").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.join(F.broadcast(stats)).select("term", "avgdl", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0).alias("idf"))
    return tf.join(idf, "term")


def term_counts(chunks: DataFrame) -> DataFrame:
    """term, df, cf of all chunks, and one row without a term that counts the chunks (df). Each batch of chunks gives its sums by term,
    so what is shuffled is sums, not postings."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("term", pa.string()), ("df", pa.int64()), ("cf", pa.int64())])
        for b in batches:
            names, code, row = words.tokens(b.column("plain"))
            cf = np.bincount(code, minlength=len(names))
            df = np.bincount(np.unique(code * max(1, b.num_rows) + row) // max(1, b.num_rows), minlength=len(names))
            some = np.flatnonzero(cf)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([names.take(pa.array(some)), pa.nulls(1, pa.string())]), pa.array(np.r_[df[some], b.num_rows]), pa.array(np.r_[cf[some], b.num_rows])], schema=schema)

    sums = chunks.select(T.plain("text").alias("plain")).mapInArrow(count, "term string, df long, cf long")
    return sums.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def ranked(scores: DataFrame, score: str, k: int | None = None, name: str = "rank") -> DataFrame:
    out = scores.withColumn(name, F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(score), "chunk_key")))
    return out if k is None else out.where(F.col(name) <= k)


#: Bins of scores in which an order statistic is looked for first.
BINS = 1024


def lexical_confidence(scores: DataFrame) -> DataFrame:
    """qid, confidence: how far the top score stands above the one a tenth down the list; 0 for fewer than 5 scores.

    The score a tenth down is found without ranking the list: counts of BINS bins of each question tell its bin, and
    only that bin is ranked."""
    top = scores.groupBy("qid").agg(F.max("bm25").alias("top"), F.count("*").alias("n"))
    x = scores.select("qid", "bm25").join(top.where("n >= 5"), "qid").withColumn("bin", F.floor((1 - F.col("bm25") / F.col("top")) * BINS))
    bins = x.groupBy("qid", "bin").agg(F.count("*").alias("here"), F.max("n").alias("n"))
    bins = bins.withColumn("upto", F.sum("here").over(Window.partitionBy("qid").orderBy("bin"))).withColumn("nth", F.floor(F.col("n") / 10) + 1 - F.col("upto") + F.col("here"))
    own = x.join(bins.where("nth between 1 and here").select("qid", "bin", "nth"), ["qid", "bin"])
    tenth = own.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bm25")))).where("place = nth").select("qid", F.col("bm25").alias("tenth"))
    value = F.coalesce(F.greatest(F.lit(0.0), (F.col("top") - F.col("tenth")) / F.col("top")), F.lit(0.0))
    return top.join(tenth, "qid", "left").select("qid", F.round(value, 9).alias("confidence"))


def cosine(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Queries of a block and vectors of a shard that meet in one task, and vectors that are scored at a time.
QUERY_BLOCK, VECTOR_SHARD, STEP = 2048, 8192, 512
#: Slack of bounds: scores are rounded to 9 places before they are ranked.
SLACK = 1e-8


def coded(rows: DataFrame) -> DataFrame:
    """Replaces vector by code (8 bits a component), scale, loss (length of what the code leaves out) and size (length of what it stands for)."""
    names = [c for c in rows.columns if c != "vector"]
    out = StructType([*(rows.schema[c] for c in names), *StructType.fromDDL("code binary, scale double, loss double, size double")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            scale = np.abs(v).max(axis=1, initial=0.0) / 127
            code = np.rint(v / np.where(scale > 0, scale, 1.0)[:, None])
            back = code * scale[:, None]
            rest = [pa.array([c.tobytes() for c in code.astype(np.int8)], pa.binary()), *(pa.array(x) for x in (scale, np.linalg.norm(v - back, axis=1), np.linalg.norm(back, axis=1)))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *rest], schema=schema)

    return rows.mapInArrow(run, out)


class Codes:
    """Codes of some rows as a matrix, with their scales and errors."""

    def __init__(self, table: pa.Table):
        column = lambda name: table.column(name).to_numpy()
        self.code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.int8).reshape(table.num_rows, -1).astype(np.float32)
        self.scale, self.loss, self.size = column("scale"), column("loss"), column("size")


def bounded(asked: Codes, rows: Codes, some: slice) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of the products of all queries with some rows, and how far off they may be.

    q v = q' v' + q (v - v') + (q - q') v', so by Cauchy and Schwarz the error is at most |q| |v - v'| + |q - q'| |v'|, and |q| <= |q'| + |q - q'|.
    Sums of products of 8-bit codes are exact in 32-bit floats up to 1040 dimensions; beyond, 64-bit floats are taken."""
    left, right = asked.code, rows.code[some]
    if left.shape[1] > 1040:
        left, right = left.astype(float), right.astype(float)
    near = (left @ right.T) * asked.scale[:, None] * rows.scale[some]
    return near, (asked.size + asked.loss)[:, None] * rows.loss[some] + asked.loss[:, None] * rows.size[some] + SLACK


def contenders(asked: Codes, own: np.ndarray, rows: Codes, keys: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(query, row, least score, highest score) of rows that may be among the k best of a query; never its own. Scores are held for STEP rows at a time."""
    place: dict[str, list[int]] = {}
    for at, key in enumerate(keys.tolist()):
        place.setdefault(key, []).append(at)
    pairs = np.array([(q, at) for q, x in enumerate(own.tolist()) for at in place.get(x, ())], np.int64).reshape(-1, 2)

    def scored(start: int) -> tuple[np.ndarray, np.ndarray]:
        near, off = bounded(asked, rows, slice(start, start + STEP))
        here = pairs[(pairs[:, 1] >= start) & (pairs[:, 1] < start + near.shape[1])]
        near[here[:, 0], here[:, 1] - start] = -np.inf
        return near, off

    best = np.full((len(asked.scale), k), -np.inf)
    for start in range(0, len(keys), STEP):
        near, off = scored(start)
        both = np.concatenate([best, near - off], axis=1)
        best = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
    least = best.min(axis=1)
    for start in range(0, len(keys), STEP):
        near, off = scored(start)
        query, at = np.nonzero((near + off >= least[:, None]) & (near > -np.inf))
        yield query, at + start, (near - off)[query, at], (near + off)[query, at]


def dense_top(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """qid, chunk_key, dense, rank: the k vectors of highest inner product for each query, never the one of its own key.

    queries: qid, vector and, if a query is a row of vectors itself, own (its chunk_key); vectors: chunk_key, vector and, to
    have the best k of each of a few parts, part; all of one length. A stated query set against all vectors: blocks of
    queries meet shards of vectors in cogroups, as 8-bit codes whose error is bounded; what may be among the first k by
    these bounds is scored exactly. A task holds one block, one shard and the scores of STEP of its vectors."""
    own = F.col("own").cast("string") if "own" in queries.columns else F.lit(None).cast("string")
    part = F.col("part").cast("string") if "part" in vectors.columns else F.lit("")
    asked = queries.where("vector is not null").select("qid", own.alias("own"), F.col("vector").cast("array<double>").alias("vector"))
    rows = vectors.where("vector is not null").select(F.col("chunk_key").cast("string").alias("chunk_key"), F.coalesce(part, F.lit("")).alias("part"), F.col("vector").cast("array<double>").alias("vector"))
    blocks, shards = (max(1, -(-df.count() // size)) for df, size in ((asked, QUERY_BLOCK), (rows, VECTOR_SHARD)))
    dealt = lambda df, key, n, name: df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = dealt(coded(asked), "qid", blocks, "block").withColumn("shard", every(shards))
    right = dealt(coded(rows), "chunk_key", shards, "shard").withColumn("block", every(blocks))
    out = StructType([asked.schema["qid"], *StructType.fromDDL("part string, chunk_key string, low double, high double")])

    def meet(asks: pa.Table, held: pa.Table) -> pa.Table:
        schema, found = to_arrow_schema(out), []
        if asks.num_rows and held.num_rows:
            q, mine, ids = Codes(asks), np.array(asks.column("own").to_pylist(), object), asks.column("qid").combine_chunks()
            parts = np.array(held.column("part").to_pylist(), object)
            for name in dict.fromkeys(parts):
                some = held.filter(pa.array(parts == name))
                keys = some.column("chunk_key").combine_chunks()
                for query, at, low, high in contenders(q, mine, Codes(some), np.array(keys.to_pylist(), object), k):
                    found.append(pa.RecordBatch.from_arrays([ids.take(pa.array(query)), pa.array([name] * len(query), pa.string()), keys.take(pa.array(at)), pa.array(low), pa.array(high)], schema=schema))
        return pa.Table.from_batches(found, schema=schema)

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(meet, out)
    by = Window.partitionBy("qid", "part")
    found = found.withColumn("n", F.row_number().over(by.orderBy(F.desc("low")))).withColumn("least", F.max(F.when(F.col("n") == k, F.col("low"))).over(by))
    able = found.where("least is null or high >= least").select("qid", "part", "chunk_key").distinct()
    exact = able.join(asked.select("qid", F.col("vector").alias("q")), "qid").join(rows.select("chunk_key", F.col("vector").alias("v")), "chunk_key")
    exact = exact.select("qid", "part", "chunk_key", F.round(cosine(F.col("q"), F.col("v")), 9).alias("dense"))
    return exact.withColumn("rank", F.row_number().over(by.orderBy(F.desc("dense"), "chunk_key"))).where(F.col("rank") <= k).select("qid", "chunk_key", "dense", "rank")


def dense_gate(scores: DataFrame, gate: float = K.DENSE_GATE) -> DataFrame:
    """qid, top, passes: the dense list counts only if its best cosine reaches the gate."""
    return scores.groupBy("qid").agg(F.max("dense").alias("top")).withColumn("passes", F.col("top") >= gate)


@dataclass
class Dense:
    """The dense side of a request set: its best RRF_CUT chunks (dense_top; None: they are looked for in the index's shards), and its vectors (qid, vector) for chunks that are scored besides."""

    top: DataFrame | None
    queries: DataFrame


def section_requests(located: DataFrame, dense: Dense | None = None) -> DataFrame:
    """What SegmentedIndex.gather is asked: the located sections of the first named label; nothing is looked for inside without both."""
    asks = F.col("drug").isNotNull() & (F.size("loincs") > 0)
    out = located.select("qid", "question", F.array("drug").alias("drugs"), "loincs", asks.alias("asks"))
    return out if dense is None else out.join(dense.queries.select("qid", "vector"), "qid", "left")


def section_candidates(gathered: DataFrame) -> DataFrame:
    """What was gathered inside, zero scores included; ranked by dense, lexical, corpus order."""
    order = Window.partitionBy("qid").orderBy(F.desc("dense"), F.desc("bm25"), "chunk_key")
    return gathered.where("part = 'inside'").select("qid", "chunk_key", F.row_number().over(order).alias("rank"))


def boosted(gathered: DataFrame, factor: float = K.SECTION_BOOST) -> DataFrame:
    """The multiplicative boost, kept as a known-bad control: it cannot lift a chunk that has no score. What was gathered inside is lifted."""
    lifted = F.round(F.col("bm25") * F.when(F.col("part") == "inside", factor).otherwise(1.0), 9)
    return gathered.where("part in ('top', 'inside') and bm25 > 0").groupBy("qid", "chunk_key").agg(F.max(lifted).alias("boosted"))


def fused(index: SegmentedIndex, work: Workspace, located: DataFrame, k: int, dense: Dense | None = None) -> DataFrame:
    """The first k of fuse() over the whole corpus. located: routing.locate(), kept; with dense the index has vectors.

    Without a dense list the section list is in lexical order, so what is in the head of the lexical list is in the head of the section
    list too; of what is only in the section list the first k can be among the first k. The heads of the shards are enough.
    With one, a chunk of the other lists may stand anywhere in the section list, which is ranked whole."""
    gathered = work.keep(index.gather(section_requests(located, dense), top=K.RRF_CUT, inside=K.RRF_CUT + k if dense is None else None, bins=True, near=K.RRF_CUT if dense is not None and dense.top is None else 0))
    lexical = work.keep(ranked(gathered.where("part = 'top'").select("qid", "chunk_key", "bm25"), "bm25", K.RRF_CUT).drop("rank"))
    sections = section_candidates(gathered)
    if dense is not None and dense.top is None:
        dense = Dense(work.keep(ranked(gathered.where("part = 'near'").select("qid", "chunk_key", "dense"), "dense", K.RRF_CUT)), dense.queries)
    if dense is not None:
        near = lexical.select("qid", "chunk_key").union(dense.top.select("qid", "chunk_key")).distinct().withColumn("near", F.lit(True))
        sections = sections.join(near, ["qid", "chunk_key"], "left").where((F.col("rank") <= 2 * K.RRF_CUT + k) | F.col("near"))
    return fuse(sections, lexical, index.confidence(located.select("qid", "question"), gathered), dense).where(F.col("rank") <= k)


def fuse(sections: DataFrame, bm25: DataFrame, confidence: DataFrame, dense: Dense | None = None) -> DataFrame:
    """Weighted reciprocal ranks. The lexical list weighs its confidence (none: it is left out), the dense list counts
    where its gate passes; both are cut at RRF_CUT, the section list is not. qid, chunk_key, rrf, rank."""
    lists = [sections.select("qid", "chunk_key", "rank", F.lit(K.RRF_SECTION).alias("w"))]
    lexical = ranked(bm25, "bm25", K.RRF_CUT).join(confidence.where("confidence > 0"), "qid")
    lists.append(lexical.select("qid", "chunk_key", "rank", F.col("confidence").alias("w")))
    if dense is not None:
        open_ = dense.top.where(F.col("rank") <= K.RRF_CUT).join(dense_gate(dense.top).where("passes").select("qid"), "qid")
        lists.append(open_.select("qid", "chunk_key", "rank", F.lit(K.RRF_DENSE).alias("w")))
    both = lists[0]
    for more in lists[1:]:
        both = both.unionByName(more)
    return ranked(both.groupBy("qid", "chunk_key").agg(F.round(F.sum(F.col("w") / (K.RRF_K + F.col("rank"))), 9).alias("rrf")), "rrf")


def constrained_rerank(fused: DataFrame, chunks: DataFrame, located: DataFrame, scorer: DataFrame, k: int, pool: int = K.RERANK_POOL) -> DataFrame:
    """Re-score the allowed head of the pool, keep the order of the rest. scorer: qid, chunk_key, relevance.

    Allowed are the located label and sections; without sections the label; without a label everything. A head of one changes nothing.
    """
    p = fused.where(F.col("rank") <= max(k, pool)).join(chunks.select("chunk_key", "drug", "loinc"), "chunk_key").join(located.select("qid", F.col("drug").alias("named"), "loincs"), "qid")
    allowed = F.when(F.col("named").isNull(), True).when(F.size("loincs") > 0, (F.col("drug") == F.col("named")) & F.array_contains("loincs", F.col("loinc"))).otherwise(F.col("drug") == F.col("named"))
    p = p.withColumn("allowed", allowed)
    nth = F.sum(F.col("allowed").cast("int")).over(Window.partitionBy("qid").orderBy("rank"))
    p = p.withColumn("head", F.col("allowed") & (nth <= pool)).withColumn("heads", F.sum(F.col("head").cast("int")).over(Window.partitionBy("qid")))
    p = p.join(scorer, ["qid", "chunk_key"], "left")
    tier = F.when(F.col("head") & (F.col("heads") > 1), 0).otherwise(1)
    order = Window.partitionBy("qid").orderBy(F.when(F.col("heads") > 1, tier).otherwise(1), F.desc(F.when(tier == 0, F.coalesce("relevance", F.lit(0.0))).otherwise(0.0)), "rank")
    return p.select("qid", "chunk_key", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def soft_restrict(index: SegmentedIndex, asked: DataFrame, k: int = 5, vectors: DataFrame | None = None) -> DataFrame:
    """asked: qid, question, drugs, loincs; vectors: qid, vector for a dense list. The label is a filter (none: all), sections are a tier; zero scores stay. qid, chunk_key, tier, rank (the first k)."""
    asked = asked.select("qid", "question", F.transform("drugs", F.lower).alias("drugs"), "loincs")
    asked = asked if vectors is None else asked.join(vectors, "qid", "left")
    order = Window.partitionBy("qid").orderBy("tier", F.desc("dense"), F.desc("bm25"), "chunk_key")
    return index.gather(asked, inside=k, soft=True).select("qid", "chunk_key", "tier", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def hard_restrict(index: SegmentedIndex, asked: DataFrame, k: int) -> DataFrame:
    """asked: qid, question, drug, loincs. Label and section as filters before the ranking. Zero scores are lost."""
    asked = asked.select("qid", "question", F.when(F.col("drug").isNotNull(), F.array("drug")).alias("drugs"), F.when(F.size("loincs") > 0, F.col("loincs")).alias("loincs"))
    return ranked(index.gather(asked, inside=k).where("bm25 > 0").select("qid", "chunk_key", "bm25"), "bm25", k)


def restrict_after(lexical: DataFrame, chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """The same after the ranking (the ablation). lexical: kept heads of lists."""
    x = lexical.join(chunks.select("chunk_key", "drug", "loinc"), "chunk_key").join(asked.select("qid", F.col("drug").alias("named"), "loincs"), "qid")
    return x.where("(named is null or drug = named) and (size(loincs) = 0 or array_contains(loincs, loinc))").select("qid", "chunk_key", "bm25", "rank")


def keyword_search(matches: DataFrame, chunks: DataFrame) -> DataFrame:
    """matches: SegmentedIndex.matches(), the first chunks by distinct question tokens among theirs, kept. Adds authority, by section."""
    found = matches.join(chunks.select("chunk_key", "section"), "chunk_key")
    return found.select("qid", "chunk_key", "score", F.when(F.col("section") == "Contraindications", 0.9).otherwise(0.8).alias("authority"), "rank")


def recall_mrr(found: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """found: qid, doc_id, loinc, rank; gold: qid, tier, gold_doc, gold_loinc_any. n, recall and mrr by tier and in all (tier null)."""
    hit = found.where(F.col("rank") <= k).join(gold.select("qid", "gold_doc", "gold_loinc_any"), "qid").where(F.expr("doc_id = gold_doc and array_contains(gold_loinc_any, loinc)"))
    first = gold.select("qid", "tier").distinct().join(hit.groupBy("qid").agg(F.min("rank").alias("first")), "qid", "left")
    return first.rollup("tier").agg(F.count("*").alias("n"), F.round(F.avg(F.col("first").isNotNull().cast("double")), 9).alias("recall"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 9).alias("mrr"))


#: CTEs postings and bm25, after chunks and questions.
BM25_SQL = f"""tok as (select chunk_key, {T.tokens_sql('text')} as tok from chunks),
stats as (select count(*) as n, avg(len(tok)) as avgdl from tok),
tf as (select chunk_key, len(tok) as dl, unnest(tok) as term from tok),
counted as (select chunk_key, dl, term, count(*) as tf from tf group by all),
idf as (select term, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1.0) as idf, any_value(avgdl) as avgdl from counted, stats group by term),
asked as (select qid, term, count(*) as times from (select qid, unnest({T.tokens_sql('question')}) as term from questions) group by all),
bm25 as (select qid, chunk_key, round(sum(times * idf * tf * {K.BM25_K1 + 1} / (tf + {K.BM25_K1} * (1 - {K.BM25_B} + {K.BM25_B} * dl / avgdl))), 9) as bm25
  from asked join counted using (term) join idf using (term) group by all having round(sum(times * idf * tf * {K.BM25_K1 + 1} / (tf + {K.BM25_K1} * (1 - {K.BM25_B} + {K.BM25_B} * dl / avgdl))), 9) > 0),
lexical as (select *, row_number() over (partition by qid order by bm25 desc, chunk_key) as rank from bm25),
confidence as (select qid, round(case when max(n) < 5 then 0.0 else greatest(0.0, (max(bm25) - max(case when rank = n // 10 + 1 then bm25 end)) / max(bm25)) end, 9) as confidence
  from (select *, count(*) over (partition by qid) as n from lexical) group by qid)"""
#: CTEs sect and fused, after located and BM25_SQL.
FUSED_SQL = f"""sect as (select l.qid, c.chunk_key, row_number() over (partition by l.qid order by coalesce(b.bm25, 0) desc, c.chunk_key) as rank
  from located l join chunks c on c.drug = l.drug and list_contains(l.loincs, c.loinc) left join bm25 b on b.qid = l.qid and b.chunk_key = c.chunk_key),
lists as (select qid, chunk_key, rank, {K.RRF_SECTION}::double as w from sect
  union all select qid, chunk_key, rank, confidence from lexical join confidence using (qid) where rank <= {K.RRF_CUT} and confidence > 0),
rrf as (select qid, chunk_key, round(sum(w / ({K.RRF_K} + rank)), 9) as rrf from lists group by all),
fused as (select *, row_number() over (partition by qid order by rrf desc, chunk_key) as rank from rrf)"""
#: The same with the dense list, after a CTE dense.
FUSED_DENSE_SQL = f"""sect as (select l.qid, c.chunk_key, row_number() over (partition by l.qid order by coalesce(d.dense, 0) desc, coalesce(b.bm25, 0) desc, c.chunk_key) as rank
  from located l join chunks c on c.drug = l.drug and list_contains(l.loincs, c.loinc) left join bm25 b on b.qid = l.qid and b.chunk_key = c.chunk_key left join dense d on d.qid = l.qid and d.chunk_key = c.chunk_key),
near as (select * from (select *, row_number() over (partition by qid order by dense desc, chunk_key) as rank, max(dense) over (partition by qid) as top from dense) where rank <= {K.RRF_CUT} and top >= {K.DENSE_GATE}),
lists as (select qid, chunk_key, rank, {K.RRF_SECTION}::double as w from sect
  union all select qid, chunk_key, rank, confidence from lexical join confidence using (qid) where rank <= {K.RRF_CUT} and confidence > 0
  union all select qid, chunk_key, rank, {K.RRF_DENSE}::double from near),
rrf as (select qid, chunk_key, round(sum(w / ({K.RRF_K} + rank)), 9) as rrf from lists group by all),
fused as (select *, row_number() over (partition by qid order by rrf desc, chunk_key) as rank from rrf)"""
