"""A lexical index in immutable segments, cut by document, with block maxima.

Layout. A segment is what one append added. Its chunks are dealt to shards of about SHARD chunks; a shard numbers its chunks
in order of their keys and holds for each term the numbers and counts of its chunks, and for each BLOCK of them the
largest count and the least length. Nothing in a segment depends on other segments: corpus size, mean length and document
frequencies are sums over segments, taken when a question is asked. So an append reads its own chunks and writes its own
segment, and the bounds of old blocks stay right: a BM25 part grows with the count and falls with the length, whatever the mean is.
FANOUT segments of one level are merged into one of the next, so each posting is rewritten a logarithmic number of times.

A segment counts once its row is in the manifest, which is written last. An append or a merge that dies leaves files that
no one reads, and may run again.

Questions. They are taken in blocks of QUESTIONS. A shard gets the postings of a block's terms only and scores all its
questions in one task: there is no row for a pair of question and chunk before the best k of each shard are merged. In
a shard terms are taken from the largest possible part down, as long as a chunk that holds none of those taken could still be among the
best k; the rest is only looked up, for chunks that can still get there by the maxima of the blocks they are in.

Chunks may have a drug and a loinc, and a vector. A shard keeps them beside the keys, so what is asked within labels and sections
(`gather`) is ranked where the chunks are: neither scores nor chunks are joined with questions outside of a shard.

The number of shards is a power of two and a chunk's shard is its hash by that number, so a merge cuts a shard into the few
shards of the next level that it can fall into, however many there are.

What is asked once and never added to (`load`) is one segment whose shards are runs of chunks as they are read: neither texts nor
postings are shuffled, and there is no list of labels.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from attestor.functions import constants as K
from attestor.functions import text as T
from attestor.functions import words

SHARD, BLOCK, FANOUT, QUESTIONS = 65_536, 64, 4, 2048
#: Shards are written as they come, without a sort. The row of a shard's chunks has many MB, so pages and row groups are measured every
#: 64 rows at least (10,000 terms may lie between two such rows): what a reader or writer holds is some shards, however many lie in a file.
FILES = {"compression": "zstd", "parquet.enable.dictionary": "false", "parquet.block.size": str(32 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "64"}
#: Bytes of texts at which a shard that is read in one run is full as well, and the level of such a segment.
RUN_BYTES, WHOLE = 16 << 20, -1
#: Terms of all questions up to which postings are picked where they lie; beyond, they are shuffled by term.
WANTED = 250_000
#: Slack of bounds: sums in another order differ by less.
SLACK = 1e-7
#: Vectors of questions that meet those of a shard at a time.
STEP = 16
#: Bins between 0 and the largest possible score, in which an order statistic is looked for first.
BINS = 1024
TERMS = "shard int, term string, df long, ords binary, tfs binary, max_tf binary, min_dl binary"
DOCS = "shard int, n long, length long, keys array<string>, dls binary, facets array<string>, facet binary, vectors binary"
ROWS = f"{TERMS}, n long, length long, keys array<string>, dls binary, facets array<string>, facet binary, vectors binary"
#: Between the parts of a facet, and for a part that is null.
MARK, NONE = "\x1f", "\x00"
#: Of what gather finds: part is top, near, inside or bin.
GATHERED = "part string, chunk_key string, tier int, dense double, bm25 double, bin int, n long, top double"
MANIFEST = "segment string, level int, n long, length long, replaces array<string>"
LABELS = "label string, n_chunks long, hash string"


#: Distinct words, the code and the text of each token (words.tokens()), how many texts: a vector for each text, zeros for none.
Encoder = Callable[[pa.Array, np.ndarray, np.ndarray, int], np.ndarray]
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}


def _arrow(ddl: str) -> pa.Schema:
    """For tasks, which have no session to read DDL with."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def _binary(x: np.ndarray, kind: str = "<u4") -> bytes:
    return np.asarray(x).astype(kind).tobytes()


def _cells(raw: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Numbers cut at the edges, as bytes; no copy for each cell."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((4 * edges).astype(np.int32)), pa.py_buffer(_binary(raw))])


def _posting_rows(codes: np.ndarray, ords: np.ndarray, tfs: np.ndarray, dls: np.ndarray, n_terms: int) -> list[pa.Array]:
    """df, ords, tfs, max_tf, min_dl of each term; codes in order, ords in order inside a term."""
    cut = np.searchsorted(codes, np.arange(n_terms + 1))
    size = np.diff(cut)
    blocks = -(-size // BLOCK)
    first = np.repeat(cut[:-1], blocks) + BLOCK * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    tops, least = (np.maximum.reduceat(tfs, first), np.minimum.reduceat(dls[ords], first)) if len(first) else (tfs, tfs)
    at = np.r_[0, np.cumsum(blocks)]
    return [pa.array(size, pa.int64()), _cells(ords, cut), _cells(tfs, cut), _cells(tops, at), _cells(least, at)]


def _shard_table(shard: int, terms: pa.Array, columns: list[pa.Array], keys: pa.Array | list[str], dls: np.ndarray, facets: list[str | None], vectors: np.ndarray | None) -> pa.Table:
    """facets: of each chunk (None: the index has none); vectors: one row for each chunk."""
    schema, n = _arrow(ROWS), len(terms)
    names = sorted({f for f in facets if f is not None})
    place = {f: k for k, f in enumerate(names)}
    facet = _binary([place[f] for f in facets]) if names else None
    keys = pa.ListArray.from_arrays([0, len(keys)], keys) if isinstance(keys, pa.Array) else [keys]
    heads = [[len(dls)], [int(dls.sum())], keys, [_binary(dls)], [names if names else None], [facet], [None if vectors is None else _binary(vectors, "<f8")]]
    kinds, own = list(schema), 2 + len(columns)
    lists = pa.table([pa.array(np.full(n, shard, np.int32)), terms, *columns, *(pa.nulls(n, f.type) for f in kinds[own:])], schema=schema)
    head = pa.table([pa.array([shard], pa.int32()), *(pa.nulls(1, f.type) for f in kinds[1:own]), *(pa.array(x, f.type) if isinstance(x, list) else x for x, f in zip(heads, kinds[own:], strict=True))], schema=schema)
    return pa.concat_tables([lists, head])


def _build(rows: pa.Table, encode: Encoder | None = None) -> pa.Table:
    """One shard from its chunks (shard, chunk_key, plain, facet, vector). encode: gives the vectors instead."""
    rows = rows.sort_by("chunk_key")
    n = rows.num_rows
    names, code, row = words.tokens(words.whole(rows.column("plain")))
    rows = rows.drop_columns("plain")
    vectors = encode(names, code, row, n) if encode else _matrix(rows.column("vector")) if "vector" in rows.column_names else None
    order = pc.sort_indices(names).to_numpy()
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    used = np.zeros(len(names), bool)
    used[place[code]] = True  # stop words and the words of no chunk are none
    pairs, tfs = np.unique(((np.cumsum(used) - 1)[place[code]]) * n + row, return_counts=True)
    codes, ords = np.divmod(pairs, max(1, n))
    dls = np.bincount(row, minlength=n)
    terms = names.take(pa.array(order[used]))
    return _shard_table(rows.column("shard")[0].as_py(), terms, _posting_rows(codes, ords, tfs, dls, len(terms)), words.whole(rows.column("chunk_key")), dls, rows.column("facet").to_pylist(), vectors)


def _build_runs(batches: Iterator[pa.RecordBatch], encode: Encoder | None = None) -> Iterator[pa.RecordBatch]:
    """Shards of the chunks of a partition (chunk_key, plain, facet, vector), as they come."""
    partition, held, size, shard = TaskContext.get().partitionId() << 12, [], [0, 0], 0

    def built() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        held.clear()
        rows = _build(rows.append_column("shard", pa.array(np.full(rows.num_rows, partition + shard, np.int32))), encode)
        words.trim()
        yield from rows.to_batches(8192)

    for b in batches:
        if b.num_rows:
            held.append(b)
            size = [size[0] + b.num_rows, size[1] + b.column("plain").nbytes]
        if size[0] >= SHARD - 10_000 or size[1] >= RUN_BYTES:
            yield from built()
            size, shard = [0, 0], shard + 1
    if held:
        yield from built()
    words.trim()


def _matrix(column: pa.ChunkedArray) -> np.ndarray | None:
    """Vectors as rows; those that are null have zeros (their products are 0). None if all are."""
    lists = column.combine_chunks()
    width = pc.max(pc.list_value_length(lists)).as_py()
    if width is None:
        return None
    out = np.zeros((len(lists), width))
    out[pc.is_valid(lists).to_numpy(zero_copy_only=False)] = pc.fill_null(lists.flatten(), 0.0).to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def _shards_for(n: int) -> int:
    """A power of two."""
    return 1 << max(0, -(-n // SHARD) - 1).bit_length()


class Held:
    """What a shard keeps of its chunks beside their lengths."""

    def __init__(self, facets: list[str] | None, facet: bytes | None, vectors: bytes | None, n: int):
        self.n, self.names = n, [tuple(None if p == NONE else p for p in f.split(MARK)) for f in facets or ()]
        self.facet = np.frombuffer(facet, "<u4").astype(np.int64) if facet else None
        self.vectors = np.frombuffer(vectors, "<f8").reshape(n, -1) if vectors else None
        self.known: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

    def tiers(self, drugs: list[str] | None, loincs: list[str] | None, soft: bool) -> np.ndarray:
        """Of each chunk: 0 in the sections, 1 outside of them (soft only), -1 if it does not count.

        drugs, loincs: None for all. Soft requests name labels in lower case, and all if they name none."""
        if self.facet is None:
            return np.full(self.n, 0 if drugs is None and loincs is None else -1, np.int8)
        own = [d is None or (x is not None and (x.lower() if soft else x) in d) for d in (None if soft and not drugs else drugs,) for x, _ in self.names]
        at = [0 if loincs is None or code in loincs else 1 if soft else -1 for _, code in self.names]
        return np.array([t if o else -1 for o, t in zip(own, at, strict=True)], np.int8)[self.facet]

    def inside(self, drugs: list[str] | None, loincs: list[str] | None, soft: bool, k: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Places that count and their tiers; without the lower tier if k are in the upper one. Many questions ask for the same: some answers are remembered."""
        asked = tuple(None if x is None else tuple(x) for x in (drugs, loincs)) + (soft, k)
        if asked not in self.known:
            tier = self.tiers(drugs, loincs, soft)
            at = np.flatnonzero(tier >= 0)
            if k is not None and (tier == 0).sum() >= k:
                at = np.flatnonzero(tier == 0)
            if len(self.known) >= 64:
                self.known.clear()
            self.known[asked] = at, tier[at]
        return self.known[asked]

    def dense(self, vector: list[float] | None, some: np.ndarray) -> np.ndarray:
        """Products with some of the vectors, added up in order as cosine() does; 0 where there is none."""
        out = np.zeros(len(some))
        if vector is None or self.vectors is None:
            return out
        rows = self.vectors[some]
        for k, x in enumerate(vector):
            out += (x or 0.0) * rows[:, k]
        return np.round(out, 9)

    def nearest(self, asked: list[list[float] | None], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the k highest products for each vector, ties by number, and the products. Zeros stand for no vector and are left out; a question without one has none.

        Matrix products of STEP vectors at a time say what may be among them, within what another order of adding up can change; that is scored exactly."""
        there = np.flatnonzero(self.vectors.any(axis=1)) if self.vectors is not None else np.empty(0, np.int64)
        longest = np.sqrt((self.vectors**2).sum(axis=1).max(initial=0.0)) if len(there) else 0.0
        for start in range(0, len(asked), STEP):
            some = asked[start : start + STEP]
            if not len(there):
                yield from ((there, np.empty(0)) for _ in some)
                continue
            q = np.array([[x or 0.0 for x in v] if v is not None else [0.0] * self.vectors.shape[1] for v in some])
            near = (self.vectors @ q.T).T
            for v, x, line in zip(some, q, near, strict=True):
                if v is None:
                    yield np.empty(0, np.int64), np.empty(0)
                    continue
                at, x = there, SLACK + 1e-12 * longest * np.sqrt((x * x).sum())
                if len(at) > k:
                    own = line[there]
                    at = there[own >= np.partition(own, len(own) - k)[len(own) - k] - x]
                exact = self.dense(v, at)
                best = _best(exact, k)
                yield at[best], exact[best]


def _first(tier: np.ndarray, dense: np.ndarray, bm25: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k by tier, dense score, lexical score, number, in that order."""
    sure, ties, need = [], np.arange(len(tier)), k
    for value in (-tier.astype(float), dense, bm25):
        if len(ties) <= need:
            break
        x = value[ties]
        if x.min() == x.max():
            continue
        bar = np.partition(x, len(x) - need)[len(x) - need]
        sure.append(ties[x > bar])
        ties, need = ties[x == bar], need - len(sure[-1])
    some = np.concatenate([*sure, ties[:need]]).astype(np.int64)
    return some[np.lexsort((some, -bm25[some], -dense[some], tier[some]))]


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by number."""
    some = np.arange(len(scores))
    if len(scores) > k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        sure = np.flatnonzero(scores > bar)
        some = np.concatenate([sure, np.flatnonzero(scores == bar)[: k - len(sure)]])
    return some[np.lexsort((some, -scores[some]))]


def _bin(scores: np.ndarray, most: float) -> np.ndarray:
    return np.clip((1 - scores / most) * BINS, 0, BINS - 1).astype(np.int64)


class Scorer:
    """One shard and the terms of one block of questions."""

    def __init__(self, dls: np.ndarray, avgdl: float, terms: dict[str, tuple[float, bytes, bytes, bytes, bytes]], k1: float, b: float):
        self.n, self.k1 = len(dls), k1
        self.norm = k1 * (1 - b + b * dls / avgdl) if len(dls) else dls
        self.bound = lambda dl: k1 * (1 - b + b * dl / avgdl)
        self.terms, self.lists, self.full = terms, {}, {}
        self.scored = self.matched = 0
        self.held: Held | None = None

    def _list(self, term: str) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """idf, chunks, counts, and the bound of each block's part."""
        if term not in self.lists:
            idf, ords, tfs, tops, least = self.terms[term]
            tops = np.frombuffer(tops, "<u4").astype(float)
            self.lists[term] = idf, np.frombuffer(ords, "<u4").astype(np.int64), np.frombuffer(tfs, "<u4").astype(float), idf * (self.k1 + 1) * tops / (tops + self.bound(np.frombuffer(least, "<u4").astype(float)))
        return self.lists[term]

    def _parts(self, idf: float, tfs: np.ndarray, ords: np.ndarray) -> np.ndarray:
        return idf * tfs * (self.k1 + 1) / (tfs + self.norm[ords])

    def _whole(self, term: str) -> np.ndarray:
        if term not in self.full:
            idf, ords, tfs, _ = self._list(term)
            self.full[term] = self._parts(idf, tfs, ords)
        return self.full[term]

    def sums(self, asked: list[tuple[str, int]]) -> np.ndarray:
        """Scores of all chunks of the shard, not rounded."""
        held = [(self._list(term)[1], self._whole(term), times) for term, times in asked if term in self.terms]
        if not held:
            return np.zeros(self.n)
        places, parts = np.concatenate([h[0] for h in held]), np.concatenate([part if times == 1 else times * part for _, part, times in held])
        return np.bincount(places, parts, self.n)

    def hits(self, asked: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """sums(), the places of the scores above 0 and these scores; only they are rounded."""
        sums = self.sums(asked)
        at = np.flatnonzero(sums)
        score = np.round(sums[at], 9)
        some = score > 0
        return (sums, at, score) if some.all() else (sums, at[some], score[some])

    def shared(self, asked: list[tuple[str, int]]) -> np.ndarray:
        """How many of the terms each chunk has."""
        count = np.zeros(self.n, np.int64)
        for term, _ in asked:
            if term in self.terms:
                count[self._list(term)[1]] += 1
        return count

    def top(self, asked: list[tuple[str, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Chunks of the k highest scores, ties by number, and the scores."""
        held = sorted(((times * self._list(t)[3].max(), t, times) for t, times in asked if t in self.terms), reverse=True)
        rest = np.r_[np.cumsum([h[0] for h in held][::-1])[::-1], 0.0]  # what terms from here on can add
        behind = np.cumsum([0, *(len(self._list(t)[1]) for _, t, _ in held[::-1])])[::-1]  # postings from here on
        self.matched += int(behind[0])
        half = int(np.searchsorted(-rest, -rest[0] / 2, "right"))  # so many terms are more than half of what can be reached
        if 16 * (behind[0] - behind[min(half, len(held))]) > behind[0]:  # they are no small part of the postings: to skip others takes longer than to score all
            self.scored += int(behind[0])
            _, left, found = self.hits(asked)
            best = _best(found, k)
            return left[best], found[best]
        score, seen = np.zeros(self.n), np.zeros(self.n, bool)
        least, taken, fresh = -np.inf, 0, 0
        for bound, term, times in held:
            if rest[taken] < least - SLACK:
                break
            ords = self._list(term)[1]
            score[ords] += times * self._whole(term)
            seen[ords] = True
            self.scored += len(ords)
            taken, fresh = taken + 1, fresh + len(ords)
            if least - SLACK <= rest[taken] and 0 < fresh < 2 * behind[taken]:  # the bar is raised only where that can save more than it takes
                some = np.flatnonzero(seen)
                if len(some) >= k and (fresh >= len(some) // 2 or least == -np.inf):  # the best so far, scored whole, raise the bar
                    head = some[np.argpartition(-score[some], k - 1)[:k]]
                    whole = score[head].copy()
                    for _, other, n in held[taken:]:
                        whole += self._looked_up(other, n, np.sort(head))[np.argsort(np.argsort(head))]
                    least, fresh = max(least, whole.min()), 0
        left = np.flatnonzero(seen)
        for at in range(taken, len(held)):
            left = left[score[left] + rest[at] >= least - SLACK]
            bound, term, times = held[at]
            _, ords, _, blocks = self._list(term)
            place = np.searchsorted(ords[::BLOCK], left, "right") - 1
            limit = np.where(place >= 0, times * blocks[np.maximum(place, 0)], 0.0)
            left = left[score[left] + limit + rest[at + 1] >= least - SLACK]
            score[left] += self._looked_up(term, times, left)
            if len(left) >= k:
                least = max(least, np.partition(score[left], len(left) - k)[len(left) - k])
        found = np.round(score[left], 9)
        order = np.lexsort((left, -found))[:k]
        order = order[found[order] > 0]
        return left[order], found[order]

    def _looked_up(self, term: str, times: int, chunks: np.ndarray) -> np.ndarray:
        """Parts of a term for some chunks, in order."""
        idf, ords, tfs, _ = self._list(term)
        at = np.minimum(np.searchsorted(ords, chunks), len(ords) - 1)
        hit = ords[at] == chunks
        out = np.zeros(len(chunks))
        out[hit] = times * self._parts(idf, tfs[at[hit]], chunks[hit])
        self.scored += int(hit.sum())
        return out


class SegmentedIndex:
    """The index under one folder. k1, b: of BM25. postings: without them it keeps labels alone, for its fingerprint, and takes label_hashes() in place of chunks."""

    def __init__(self, spark: SparkSession, root: str, k1: float = K.BM25_K1, b: float = K.BM25_B, postings: bool = True):
        self.spark, self.root, self.k1, self.b, self.postings = spark, root.rstrip("/"), k1, b, postings
        self._rows: list | None = None
        self._idf: tuple[list, dict[str, float | None]] = [], {}

    # -- segments

    def manifest(self) -> list:
        """All manifest rows: one small row for each append and merge. Read once; a folder has one writer at a time."""
        if self._rows is None:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
            there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
            self._rows = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest").collect() if there else []
        return self._rows

    def live(self) -> list:
        """Rows of the segments that count: those that no other one replaces."""
        gone = {s for r in self.manifest() for s in r["replaces"]}
        return sorted((r for r in self.manifest() if r["segment"] not in gone), key=lambda r: r["segment"])

    def _read(self, kind: str, schema: str, segments: list[str] | None = None) -> DataFrame:
        if kind == "shards" and not self.postings:
            raise ValueError("this index keeps labels alone; it can't be searched")
        names = [r["segment"] for r in self.live()] if segments is None else segments
        out = self.spark.createDataFrame([], StructType([*StructType.fromDDL(schema), StructField("segment", StringType())]))
        for s in names:
            out = out.union(self.spark.read.schema(schema).parquet(f"{self.root}/{kind}/{s}").select(*out.columns[:-1], F.lit(s).alias("segment")))
        return out

    def terms(self, segments: list[str] | None = None) -> DataFrame:
        return self._read("shards", TERMS, segments).where("term is not null")

    def docs(self, segments: list[str] | None = None) -> DataFrame:
        return self._read("shards", DOCS, segments).where("n is not null")

    def labels(self) -> DataFrame:
        """label, n_chunks, hash: the leaves of the fingerprint."""
        if any(r["level"] == WHOLE for r in self.manifest()):
            raise ValueError("this index was loaded whole; it has no labels")
        return self._read("labels", LABELS)

    def _commit(self, segment: str, level: int, rows: DataFrame, replaces: list[str]) -> None:
        seen = Observation()
        rows = rows.observe(seen, *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "length")])
        rows.write.mode("overwrite").options(**FILES).parquet(f"{self.root}/shards/{segment}")
        self._enter(segment, level, seen.get["n"], seen.get["length"], replaces)

    def _enter(self, segment: str, level: int, n: int, length: int, replaces: list[str]) -> None:
        row = Row(segment=segment, level=level, n=n, length=length, replaces=replaces)
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        self._rows = [*self.manifest(), row]

    def _write_labels(self, segment: str, labels: DataFrame) -> int:
        """How many chunks they have."""
        seen = Observation()
        labels.observe(seen, F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n")).write.mode("overwrite").parquet(f"{self.root}/labels/{segment}")
        return seen.get["n"]

    def append(self, chunks: DataFrame, name: str | None = None, merge: bool = True) -> str:
        """Add a segment of chunks (chunk_key, text, content_hash, and label: what they belong to; drug, loinc and vector if they have some). Labels that the index has are left out.

        name: of the segment, so that an append that is tried again writes over its own unfinished files; one that counts, or did, adds nothing."""
        known = self.manifest()
        if any(r["level"] == WHOLE for r in known):
            raise ValueError("this index was loaded whole; it has no labels by which chunks could be added")
        segment = name or f"{len(known):06d}-{uuid.uuid4().hex}"
        if any(r["segment"] == segment for r in known):
            return segment
        if known:
            chunks = chunks.join(self.labels().select("label"), "label", "left_anti")
        n = self._write_labels(segment, label_hashes(chunks) if self.postings else chunks.select("label", "n_chunks", "hash"))
        if self.postings:
            plain = _plain(chunks, F.pmod(F.xxhash64("chunk_key"), F.lit(_shards_for(n))).cast("int").alias("shard"))
            self._commit(segment, 0, plain.groupBy("shard").applyInArrow(lambda rows: _build(rows), ROWS), [])
        else:
            self._enter(segment, 0, n, 0, [])
        if merge:
            self.merge()
        return segment

    def load(self, chunks: DataFrame, encode: Encoder | None = None) -> str:
        """The whole index of chunks (as append takes them, no label), which are read once and not shuffled. Nothing can be appended.

        encode: gives the vectors of a shard from its tokens, so that they need no pass and no worker of their own."""
        if self.manifest():
            raise ValueError("an index is loaded into an empty folder")
        segment = f"{0:06d}-{uuid.uuid4().hex}"
        self._commit(segment, WHOLE, _plain(chunks).mapInArrow(lambda batches: _build_runs(batches, encode), ROWS), [])
        return segment

    def merge(self) -> None:
        """Merge FANOUT segments of one level into one of the next, as long as there are so many. Texts are not read."""
        while True:
            by_level: dict[int, list[str]] = {}
            for r in self.live():
                by_level.setdefault(r["level"], []).append(r["segment"])
            level = next((at for at, names in sorted(by_level.items()) if len(names) >= FANOUT), None)
            if level is None:
                return
            old = by_level[level][:FANOUT]
            n = sum(r["n"] for r in self.live() if r["segment"] in old)
            name = f"{old[-1]}+{level + 1}"
            self._write_labels(name, self._read("labels", LABELS, old).drop("segment"))
            if not self.postings:
                self._enter(name, level + 1, n, 0, old)
                continue
            into = F.transform("keys", lambda key: F.pmod(F.xxhash64(key), F.lit(_shards_for(n))).cast("int"))
            none = lambda c, t: (F.array() if t.startswith("array") else F.lit(None)).cast(t).alias(c)  # noqa: E731  (lists are empty, not null: see _plain)
            rows = self.terms(old).select("segment", "shard", "term", "ords", "tfs", *[none(c, t) for c, t in (*HELD, ("into", "array<int>"))])
            heads = self.docs(old).withColumn("facets", F.coalesce("facets", none("facets", "array<string>")))
            rows = rows.union(heads.select("segment", "shard", *[none(c, t) for c, t in (("term", "string"), ("ords", "binary"), ("tfs", "binary"))], *[c for c, _ in HELD], into.alias("into")))
            pieces = rows.groupBy("segment", "shard").applyInArrow(_split, PIECES)
            self._commit(name, level + 1, pieces.groupBy("shard").applyInArrow(_join, ROWS), old)

    def fingerprint(self) -> DataFrame:
        """merkle() of the labels; it reads the leaves, no chunks, and does not depend on segments."""
        return merkle(self.labels())

    # -- questions

    def _sums(self) -> tuple[int, float]:
        n, length = (sum(r[c] for r in self.live()) for c in ("n", "length"))
        return n, (length / n if n else 1.0) or 1.0

    def idf(self, terms: DataFrame, few: bool = False) -> DataFrame:
        """term, idf of those of the terms that some segment has. few: they may be broadcast."""
        n, _ = self._sums()
        own = terms.select("term").distinct()
        df = self.terms().select("term", "df").join(F.broadcast(own) if few else own, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
        return df.select("term", F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0).alias("idf"))

    def _counted(self, questions: DataFrame) -> tuple[int, bool, DataFrame]:
        """How many questions there are, whether their terms are few, and term, idf of their terms. Of few terms the weights are looked up
        once for each state of the index and remembered; they are a small table of the driver."""
        tok = questions.select(T.tokens("question").alias("tok"))
        n, length = tok.agg(F.count("*"), F.coalesce(F.sum(F.size("tok")), F.lit(0))).first()
        terms = tok.select(F.explode("tok").alias("term")).distinct()
        if length > WANTED:
            return n, False, self.idf(terms)
        state = [r["segment"] for r in self.live()]
        if self._idf[0] != state or len(self._idf[1]) > 4 * WANTED:
            self._idf = state, {}
        known, wanted = self._idf[1], [r["term"] for r in terms.collect()]
        if new := [t for t in wanted if t not in known]:
            found = self.idf(self.spark.createDataFrame(pa.table({"term": pa.array(new, pa.string())})), True).collect()
            known.update(dict.fromkeys(new) | {r["term"]: r["idf"] for r in found})
        held = [t for t in wanted if known[t] is not None]
        return n, True, self.spark.createDataFrame(pa.table({"term": pa.array(held, pa.string()), "idf": pa.array([known[t] for t in held], pa.float64())}))

    def _shards(self, questions: DataFrame, more: tuple[str, ...], out: StructType, score, held: bool = False, counted: tuple[int, bool, DataFrame] | None = None) -> DataFrame:
        """score(scorer, keys, questions of the block) of every shard and block of questions: rows of out. Questions carry qid, question and `more`.

        held: the scorer gets what the shard keeps of its chunks as well (scorer.held). counted: _counted() of these questions or of more."""
        asked = questions.select("qid", T.tokens("question").alias("tok"), *more)
        n, few, idf = counted or self._counted(questions)
        blocks = max(1, -(-n // QUESTIONS))
        asked = asked.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
        wanted = asked.select("block", F.explode("tok").alias("term")).distinct()
        packs = asked.groupBy("block").agg(F.collect_list(F.struct("qid", "tok", *more)).alias("asked"))
        wanted = wanted.join(F.broadcast(idf) if few else idf, "term")
        lists = self.terms().join(F.broadcast(wanted) if few else wanted, "term").select("segment", "shard", "block", "term", "idf", "ords", "tfs", "max_tf", "min_dl")
        by = ["segment", "shard", "block"]
        docs = self.docs().withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(*by, *([c for c, _ in HELD] if held else ["keys", "dls"]))
        if few:  # so are the questions
            docs = docs.join(F.broadcast(packs), "block")
        else:  # by block alone, all shards of a block would meet in one task
            docs = docs.join(packs.crossJoin(F.broadcast(self.docs().select("segment", "shard"))), by)
        _, avgdl = self._sums()
        k1, b = self.k1, self.b

        def run(lists: pa.Table, head: pa.Table) -> pa.Table:
            schema = to_arrow_schema(out)
            if not head.num_rows:
                return schema.empty_table()
            columns = (lists.column(c).to_pylist() for c in ("term", "idf", "ords", "tfs", "max_tf", "min_dl"))
            terms = {t: tuple(rest) for t, *rest in zip(*columns, strict=True)}
            dls = np.frombuffer(head.column("dls")[0].as_py(), "<u4").astype(float)
            scorer = Scorer(dls, avgdl, terms, k1, b)
            if held:
                scorer.held = Held(*(head.column(c)[0].as_py() for c in ("facets", "facet", "vectors")), len(dls))
            columns = score(scorer, head.column("keys").combine_chunks()[0].values, head.column("asked")[0].as_py())
            del scorer, terms
            words.trim()
            return pa.table([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        return lists.groupBy(*by).cogroup(docs.groupBy(*by)).applyInArrow(run, out)

    def _found(self, questions: DataFrame, pick) -> DataFrame:
        """qid, chunk_key, bm25 of what pick(scorer, counted terms) gives for each question: places and scores."""
        out = StructType([StructField("qid", questions.schema["qid"].dataType), *StructType.fromDDL("chunk_key string, bm25 double")])

        def score(scorer: Scorer, keys: pa.Array, asked: list[dict]) -> tuple:
            ids, places, scores = [], [], []
            for a in asked:
                place, value = pick(scorer, list(Counter(a["tok"]).items()))
                ids += [a["qid"]] * len(place)
                places.append(place)
                scores.append(value)
            at = np.concatenate(places) if places else np.empty(0, np.int64)
            return ids, keys.take(pa.array(at, pa.int64())), np.concatenate(scores) if scores else []

        return self._shards(questions, (), out, score)

    def search(self, questions: DataFrame, k: int) -> DataFrame:
        """qid, chunk_key, bm25, rank of the first k chunks of each question; ties by chunk_key."""
        if k < 1:
            raise ValueError("k is 1 at least")
        best = self._found(questions, lambda scorer, asked: scorer.top(asked, k))
        return best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bm25"), "chunk_key"))).where(F.col("rank") <= k)

    def scores(self, questions: DataFrame) -> DataFrame:
        """qid, chunk_key, bm25 of every chunk that shares a term with the question."""

        def pick(scorer: Scorer, asked: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
            return scorer.hits(asked)[1:]

        return self._found(questions, pick)

    def totals(self, questions: DataFrame) -> DataFrame:
        """qid, n_scored, top, total: how many chunks share a term with the question, their highest score and the sum of their scores."""
        out = StructType([questions.schema["qid"], *StructType.fromDDL("n long, top double, total double")])

        def score(scorer: Scorer, keys: pa.Array, asked: list[dict]) -> tuple:
            found = [(a["qid"], scorer.hits(list(Counter(a["tok"]).items()))[2]) for a in asked]
            rows = [(qid, len(x), float(x.max()), float(x.sum())) for qid, x in found if len(x)]
            return tuple(zip(*rows, strict=True)) if rows else ([],) * 4

        return self._shards(questions, (), out, score).groupBy("qid").agg(F.sum("n").alias("n_scored"), F.max("top").alias("top"), F.sum("total").alias("total"))

    def matches(self, questions: DataFrame, k: int) -> DataFrame:
        """qid, chunk_key, score, rank of the first k chunks by how many distinct terms of the question they have; ties by chunk_key."""
        out = StructType([questions.schema["qid"], *StructType.fromDDL("chunk_key string, score long")])

        def score(scorer: Scorer, keys: pa.Array, asked: list[dict]) -> tuple:
            ids, places, counts = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for a in asked:
                n = scorer.shared(list(Counter(a["tok"]).items()))
                at = np.flatnonzero(n)
                at = at[_best(n[at], k)]
                ids += [a["qid"]] * len(at)
                places.append(at)
                counts.append(n[at])
            return ids, keys.take(pa.array(np.concatenate(places))), np.concatenate(counts)

        found = self._shards(questions, (), out, score)
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_key"))).where(F.col("rank") <= k)

    def gather(self, questions: DataFrame, top: int = 0, inside: int | None = None, soft: bool = False, bins: bool = False, near: int = 0) -> DataFrame:
        """Rows of GATHERED with their qid, all from one pass over the shards; keep them before they are looked at twice.

        questions: qid, question and, as wanted, drugs and loincs (see Held.tiers), asks (false: nothing is looked for inside) and vector.
        part top: of each shard the best `top` chunks by BM25. part near: the best `near` chunks by dense score. part inside: of each shard the first `inside` chunks (None: all of them)
        that drugs and loincs leave, by tier, dense score, lexical score and key; zero scores count. part bin: how many scores of a
        shard are in which bin of the largest possible one (see confidence)."""
        own = {"drugs": F.lit(None).cast("array<string>"), "loincs": F.lit(None).cast("array<string>"), "asks": F.lit(True), "vector": F.lit(None).cast("array<double>"), "most": F.lit(1.0)}
        counted = self._counted(questions)
        questions = self._most(questions, counted) if bins else questions
        questions = questions.withColumns({c: v for c, v in own.items() if c not in questions.columns})
        out = StructType([questions.schema["qid"], *StructType.fromDDL(GATHERED)])

        def score(scorer: Scorer, keys: pa.Array, asked: list[dict]) -> list:
            ids, cells, kinds = [], {f.name: [] for f in out[1:]}, list(to_arrow_schema(out))[3:]

            def add(a: dict, part: str, rows: int, at: np.ndarray | None = None, **values: np.ndarray) -> None:
                ids.extend([a["qid"]] * rows)
                cells["part"].append(pa.array([part] * rows, pa.string()))
                cells["chunk_key"].append(pa.nulls(rows, pa.string()) if at is None else keys.take(pa.array(at)))
                for f in kinds:
                    cells[f.name].append(pa.array(values[f.name], f.type) if f.name in values else pa.nulls(rows, f.type))

            if near:
                for a, (at, dense) in zip(asked, scorer.held.nearest([a["vector"] for a in asked], near), strict=True):
                    add(a, "near", len(at), at, dense=dense)
            for a in asked:
                sums, found, x = scorer.hits(list(Counter(a["tok"]).items()))
                if top:
                    best = _best(x, top)
                    add(a, "top", len(best), found[best], bm25=x[best])
                if bins and a["most"]:
                    n = np.bincount(_bin(x, a["most"]), minlength=1)
                    some = np.flatnonzero(n)
                    add(a, "bin", len(some), bin=some.astype(np.int32), n=n[some], top=np.full(len(some), x.max() if len(x) else 0.0))
                if a["asks"]:
                    at, tier = scorer.held.inside(a["drugs"], a["loincs"], soft, inside)
                    dense, bm25 = scorer.held.dense(a["vector"], at), np.round(sums[at], 9)
                    if inside is not None:
                        first = _first(tier, dense, bm25, inside)
                        at, tier, dense, bm25 = at[first], tier[first], dense[first], bm25[first]
                    add(a, "inside", len(at), at, tier=tier.astype(np.int32), dense=dense, bm25=bm25)
            if not ids:
                return [[] for _ in out]
            return [ids, *(pa.chunked_array(x).combine_chunks() for x in cells.values())]

        return self._shards(questions, ("drugs", "loincs", "asks", "vector", "most"), out, score, held=True, counted=counted)

    def _most(self, questions: DataFrame, counted: tuple[int, bool, DataFrame]) -> DataFrame:
        """Adds most, the largest score that a chunk could have."""
        terms, (_, few, idf) = questions.select("qid", F.explode(T.tokens("question")).alias("term")), counted
        return questions.join(terms.join(F.broadcast(idf) if few else idf, "term").groupBy("qid").agg((F.sum("idf") * (self.k1 + 1)).alias("most")), "qid", "left")

    def confidence(self, questions: DataFrame, gathered: DataFrame | None = None) -> DataFrame:
        """qid, confidence (see ranking.lexical_confidence), without a row for each score: shards count their scores in bins of the largest
        possible one, and only the scores of the bin that holds the order statistic are ranked. gathered: of these questions, with bins, if there is one."""
        if gathered is None:
            gathered = self.gather(questions.select("qid", "question", F.lit(False).alias("asks")), bins=True)
        scored = StructType([questions.schema["qid"], *StructType.fromDDL("bm25 double")])

        def within(scorer: Scorer, keys: pa.Array, asked: list[dict]) -> tuple:
            ids, values = [], [np.empty(0)]
            for a in asked:
                x = scorer.hits(list(Counter(a["tok"]).items()))[2]
                x = x[_bin(x, a["most"]) == a["bin"]]
                ids += [a["qid"]] * len(x)
                values.append(x)
            return ids, np.concatenate(values)

        whole = Window.partitionBy("qid")
        found = gathered.where("part = 'bin'").groupBy("qid", "bin").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
        found = found.withColumn("all", F.sum("n").over(whole)).withColumn("best", F.max("top").over(whole)).withColumn("upto", F.sum("n").over(whole.orderBy("bin")))
        found = found.withColumn("nth", F.floor(F.col("all") / 10) + 1 - F.col("upto") + F.col("n"))
        own = found.where("nth between 1 and n").select("qid", "bin", "nth", "all", "best")
        counted = self._counted(questions)
        asked = self._most(questions.select("qid", "question"), counted).join(own.select("qid", "bin"), "qid")
        inside = self._shards(asked, ("most", "bin"), scored, within, counted=counted)
        tenth = inside.withColumn("place", F.row_number().over(whole.orderBy(F.desc("bm25")))).join(own, "qid").where("place = nth")
        value = F.when(F.col("all") >= 5, F.greatest(F.lit(0.0), (F.col("best") - F.col("bm25")) / F.col("best"))).otherwise(0.0)
        return tenth.select("qid", F.round(value, 9).alias("confidence"))

    def cost(self, questions: DataFrame, k: int) -> DataFrame:
        """matched, scored: postings of the questions' terms, and those of them whose part search(questions, k) computes."""

        def score(scorer: Scorer, keys: pa.Array, asked: list[dict]) -> tuple:
            for a in asked:
                scorer.top(list(Counter(a["tok"]).items()), k)
            return [scorer.matched], [scorer.scored]

        return self._shards(questions, (), StructType.fromDDL("matched long, scored long"), score).agg(F.sum("matched").alias("matched"), F.sum("scored").alias("scored"))


HELD = (("keys", "array<string>"), ("dls", "binary"), ("facets", "array<string>"), ("facet", "binary"), ("vectors", "binary"))
PIECES = "shard int, terms array<string>, sizes binary, ords binary, tfs binary, " + ", ".join(f"{c} {t}" for c, t in HELD)


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the lists, and how many each has."""
    data, bounds = words.content(words.whole(lists))
    return np.frombuffer(data.tobytes(), "<u4").astype(np.int64), np.diff(bounds) // 4


def _split(rows: pa.Table) -> pa.Table:
    """One shard to pieces, by the shard that its chunks go into; a piece is one row, its postings lie behind each other."""
    schema, out = _arrow(PIECES), []
    head = rows.filter(pc.is_null(rows.column("term")))
    lists = rows.filter(pc.is_valid(rows.column("term")))
    into, keys = (words.whole(head.column(c)).flatten() for c in ("into", "keys"))
    into, (dls, _) = into.to_numpy(), _flat(head.column("dls"))
    names, facet, vectors = (head.column(c)[0].as_py() or None for c in ("facets", "facet", "vectors"))
    facet = np.frombuffer(facet, "<u4") if facet else None
    vectors = np.frombuffer(vectors, "<f8").reshape(len(keys), -1) if vectors else None
    terms, (ords, size), (tfs, _) = words.whole(lists.column("term")), _flat(lists.column("ords")), _flat(lists.column("tfs"))
    term = np.repeat(np.arange(len(terms)), size)
    for target in np.unique(into).tolist():
        inside = into == target
        number = np.cumsum(inside) - 1
        mine = np.flatnonzero(inside[ords])
        count = np.bincount(term[mine], minlength=len(terms))
        some = np.flatnonzero(count)
        held = [keys.take(pa.array(np.flatnonzero(inside))), _binary(dls[inside]), names, None if facet is None else _binary(facet[inside]), None if vectors is None else _binary(vectors[inside], "<f8")]
        cells = [target, terms.take(pa.array(some)), _binary(count[some]), _binary(number[ords[mine]]), _binary(tfs[mine]), *held]
        out.append(pa.table([pa.ListArray.from_arrays([0, len(x)], x) if isinstance(x, pa.Array) else pa.array([x], f.type) for x, f in zip(cells, schema, strict=True)], schema=schema))
    return pa.concat_tables(out) if out else schema.empty_table()


def _join(rows: pa.Table) -> pa.Table:
    """One shard from its pieces."""
    keys, terms = (words.whole(rows.column(c)) for c in ("keys", "terms"))
    each, every = pc.list_value_length(keys).to_numpy(), keys.flatten()
    order = pc.sort_indices(every).to_numpy().astype(np.int64)
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    coded = terms.flatten().dictionary_encode()
    sort = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(sort), np.int64)
    place[sort] = np.arange(len(sort))
    (ords, size), (tfs, _), (counts, _) = (_flat(rows.column(c)) for c in ("ords", "tfs", "sizes"))
    ords = number[ords + np.repeat(np.cumsum(each) - each, size)]
    codes = np.repeat(place[coded.indices.to_numpy()], counts)
    turn = np.argsort(codes * max(1, len(order)) + ords, kind="stable")
    lengths, facets, vectors = _flat(rows.column("dls"))[0][order], [], []
    for n, names, facet, vector in zip(each.tolist(), *(rows.column(c).to_pylist() for c in ("facets", "facet", "vectors")), strict=True):
        facets += [names[k] for k in np.frombuffer(facet, "<u4").tolist()] if names else [None] * n
        vectors.append(np.frombuffer(vector, "<f8").reshape(n, -1) if vector else None)
    width = max((v.shape[1] for v in vectors if v is not None), default=0)
    vectors = [np.zeros((n, width)) if v is None else v for n, v in zip(each.tolist(), vectors, strict=True)]
    found = _posting_rows(codes[turn], ords[turn], tfs[turn], lengths, len(sort))
    return _shard_table(rows.column("shard")[0].as_py(), coded.dictionary.take(pa.array(sort)), found, every.take(pa.array(order)), lengths, [facets[k] for k in order.tolist()], np.concatenate(vectors)[order] if width else None)


def _plain(chunks: DataFrame, *more: Column) -> DataFrame:
    """Chunks as shards are built from them."""
    part = lambda c: F.coalesce(F.col(c), F.lit(NONE)) if c in chunks.columns else F.lit(NONE)
    facet = F.concat(part("drug"), F.lit(MARK), part("loinc")) if {"drug", "loinc"} & set(chunks.columns) else F.lit(None).cast("string")
    vector = [F.col("vector").cast("array<double>").alias("vector")] if "vector" in chunks.columns else []  # Spark's Arrow writer takes a time quadratic in the rows of a batch for lists that are null
    return chunks.select(*more, "chunk_key", T.plain("text").alias("plain"), facet.alias("facet"), *vector)


def merkle(leaves: DataFrame) -> DataFrame:
    """leaves: label_hashes(). One row: n_labels, n_chunks, fingerprint. A Merkle tree over labels, above 256 of them by the first two digits of their SHA-1."""
    leaves = leaves.select("n_chunks", F.sha1("label").alias("at"), F.concat_ws(":", "label", F.col("n_chunks").cast("string"), "hash").alias("h"))
    n, chunks = leaves.agg(F.count("*"), F.coalesce(F.sum("n_chunks"), F.lit(0))).first()
    node = leaves.select("at", "h")
    for width in (2, 0) if n > 256 else (0,):
        at = F.substring("at", 1, width) if width else F.lit("")
        node = node.groupBy(at.alias("at")).agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("h"))), 256).alias("h"))
    found = node.select("h").union(leaves.sparkSession.createDataFrame([(None,)], "h string")).agg(F.coalesce(F.max("h"), F.sha2(F.lit(""), 256)).alias("fingerprint"))
    return found.select(F.lit(n).alias("n_labels"), F.lit(chunks).alias("n_chunks"), "fingerprint")


def label_hashes(chunks: DataFrame) -> DataFrame:
    """label, n_chunks, hash: SHA-256 of the hashes of a label's chunks in order of their keys. A label is one document's worth of chunks."""
    by = chunks.groupBy(F.col("label").cast("string").alias("label")).agg(F.count("*").alias("n_chunks"), F.array_sort(F.collect_list(F.struct("chunk_key", "content_hash"))).alias("c"))
    return by.select("label", "n_chunks", F.sha2(F.concat_ws("\n", F.transform("c", lambda x: F.concat_ws(" ", x["chunk_key"], x["content_hash"]))), 256).alias("hash"))
