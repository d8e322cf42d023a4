"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. The binary Golay code [23, 12] is perfect with
radius 3: every segment decodes to one of 4096 codewords. The keys of a segment are the codewords that it and its
one-bit neighbours decode to, one or six of them; two segments that differ in at most two bits have a neighbour
in common and so a key. Four differing bits over three segments leave at least two segments with at most two each,
so linked fingerprints share a key pair in at least one of the three segment pairs. Fingerprints that share one
are compared; a bucket gives a spanning forest of its links, not all pairs.

Equal fingerprints are one node. Null and empty texts have fingerprint zero, linked like any other; a null
doc_id is never a component's id unless it has no other; rows that repeat get equal results; an empty table gives
no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from attestor.llm.common import Scratch, as_bytes, batch, bitmap, lean, marked, pieces
from attestor.llm.components import connected

SEED, RADIUS = 42, 4
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the Golay code.
GOLAY = 0b110001110101
#: Shift and length of each segment.
SEGMENTS = ((41, 23), (18, 23), (0, 18))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: A bucket of more fingerprints is compared in blocks of about half as many.
BUCKET = 1 << 15


def fingerprints_of(texts: list[bytes], words: int = 4) -> np.ndarray:
    digest, hashes, counts = xxhash.xxh64_intdigest, [], []
    for text in texts:
        own = text.lower().split()
        joined = b" ".join(own)
        if len(own) < words:
            found = [digest(joined, SEED)] if own else []
        else:
            sizes = np.fromiter(map(len, own), np.int64, len(own))
            ends = np.cumsum(sizes + 1) - 1
            found = [digest(joined[a:b], SEED) for a, b in zip((ends - sizes)[: len(own) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
        hashes += found
        counts.append(len(found))
    count = np.array(counts, np.int64)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, (np.cumsum(count) - count)[some], axis=0, dtype=np.int64)
        out[some] = np.packbits(2 * ones > count[some, None], axis=1).view(">u8").ravel()
    return out


def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of single bits, and the error pattern of least weight for each syndrome."""
    single = np.zeros(23, np.int64)
    for k in range(23):
        v = 1 << k
        for top in range(22, 10, -1):
            if v >> top & 1:
                v ^= GOLAY << (top - 11)
        single[k] = v
    error = np.zeros(2048, np.int64)
    for a in range(23):
        error[single[a]] = 1 << a
        for b in range(a):
            error[single[a] ^ single[b]] = 1 << a | 1 << b
            for c in range(b):
                error[single[a] ^ single[b] ^ single[c]] = 1 << a | 1 << b | 1 << c
    return single, error


SINGLE, ERROR = _golay()


def _syndrome(v: np.ndarray) -> np.ndarray:
    out = np.zeros_like(v)
    for k in range(23):
        out ^= np.where(v >> k & 1, SINGLE[k], 0)
    return out


def segment_keys(v: np.ndarray, bits: int) -> np.ndarray:
    """Indices of the codewords that v and its neighbours decode to, one row each, sorted; repeats are -1."""
    near = np.concatenate([[0], 1 << np.arange(bits)])
    moved = _syndrome(v)[:, None] ^ np.concatenate([[0], SINGLE[:bits]])
    keys = np.sort((v[:, None] ^ near ^ ERROR[moved]) >> 11, axis=1)
    keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = -1
    keys = -np.sort(-keys, axis=1)
    return keys[:, : max(1, int((keys >= 0).sum(1).max(initial=1)))]


def pair_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (row, key) of 64-bit fingerprints."""
    parts = [segment_keys((prints >> np.uint64(s)).astype(np.int64) & ((1 << n) - 1), n) for s, n in SEGMENTS]
    rows, keys = [], []
    for k, (i, j) in enumerate(PAIRS):
        both = (k << 24) | (parts[i][:, :, None] << 12) | parts[j][:, None, :]
        row, x, y = np.nonzero((parts[i][:, :, None] >= 0) & (parts[j][:, None, :] >= 0))
        rows.append(row)
        keys.append(both[row, x, y])
    return np.concatenate(rows), np.concatenate(keys)


def bucket_links(nodes: np.ndarray, prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between nodes (prints: n x words of 64 bits): what is connected already is compared no more."""
    links, waiting = [], np.arange(len(nodes))
    while len(waiting):
        front, waiting = waiting[:1], waiting[1:]
        while len(front) and len(waiting):
            near = np.bitwise_count(prints[waiting] ^ prints[front[0]]).sum(1) <= radius
            links += [(int(nodes[front[0]]), int(x)) for x in nodes[waiting[near]]]
            front, waiting = np.concatenate([front[1:], waiting[near]]), waiting[~near]
    return links


def _keyed(prints: DataFrame) -> DataFrame:
    """prints: node, fp, more. key, node, fp, more for every key of fp."""
    out = StructType.fromDDL("key int, node long, fp long, more long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        for b in batches:
            node, fp, more = (b.column(n).to_numpy(zero_copy_only=False) for n in ("node", "fp", "more"))
            for k in range(0, len(fp), 8192):
                row, key = pair_keys(np.ascontiguousarray(fp[k : k + 8192]).view(np.uint64))
                yield batch(schema, key.astype(np.int32), node[k : k + 8192][row], fp[k : k + 8192][row], more[k : k + 8192][row])

    return prints.select("node", "fp", "more").mapInArrow(lean(run), out)


def _linked(grouped: DataFrame, radius: int) -> DataFrame:
    """grouped: key, node, fp, more with the rows of a key next to each other; links that a task finds again are left out."""
    out = StructType.fromDDL("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, seen = to_arrow_schema(out), set()

        def links(rows: np.ndarray) -> pa.RecordBatch:
            key, node, prints = rows[:, 0], rows[:, 1], np.ascontiguousarray(rows[:, 2:]).view(np.uint64)
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            pairs = cuts[:-1][np.diff(cuts) == 2]
            near = np.bitwise_count(prints[pairs] ^ prints[pairs + 1]).sum(1) <= radius if len(pairs) else np.empty(0, bool)
            found = list(zip(node[pairs[near]].tolist(), node[pairs[near] + 1].tolist(), strict=True))
            for k in np.flatnonzero(np.diff(cuts) > 2).tolist():
                found += bucket_links(node[cuts[k] : cuts[k + 1]], prints[cuts[k] : cuts[k + 1]], radius)
            new = list(dict.fromkeys(x for x in found if x not in seen))
            if len(seen) < 1_000_000:
                seen.update(new)
            a, b = zip(*new, strict=True) if new else ((), ())
            return batch(schema, np.array(a, np.int64), np.array(b, np.int64))

        held = np.empty((0, 4), np.int64)
        for b in batches:
            rows = np.concatenate([held, np.stack([b.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("key", "node", "fp", "more")], 1)])
            if len(rows):
                last = int(np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])[-1])
                held = rows[last:]
                if last:
                    yield links(rows[:last])
        if len(held):
            yield links(held)

    return grouped.mapInArrow(lean(run), out)


def _heavy(prints: DataFrame) -> DataFrame:
    """key, blocks: keys that about BUCKET fingerprints or more share, counted on a fixed share of the fingerprints. It sets how buckets are cut, never what is compared."""
    every = max(1, BUCKET // 512)
    some = _keyed(prints.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0)).groupBy("key").agg((F.count("*") * every).alias("n"))
    return some.where(F.col("n") > 0.75 * BUCKET).select("key", F.ceil(F.col("n") * 2 / BUCKET).cast("int").alias("blocks"))


def links_of(prints: DataFrame, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """prints: node, fp, more (further bits of the print, 0 if there are none). Links a, b that join all nodes that share
    a key and differ in at most radius bits, directly or over others; up to 4 bits of fp all share a key."""
    heavy = small(scratch.write(_heavy(prints), "heavy"))
    keyed = _keyed(prints).join(heavy, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = F.when(F.col("blocks") == 1, F.expr("array(struct(0 as i, 0 as j))")).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j"))))
    dealt = keyed.withColumn("pair", F.explode(pairs)).select("key", "pair.i", "pair.j", "node", "fp", "more")
    shared = dealt.withColumn("n", F.count("*").over(Window.partitionBy("key", "i", "j"))).where("n > 1")  # rows of a bucket, or of two of its blocks
    bucket = F.when(F.col("j") == 0, F.col("key").cast("long")).otherwise(F.xxhash64("key", "i", "j"))
    return _linked(shared.select(bucket.alias("key"), "node", "fp", "more"), radius)


def fingerprinted(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of each row."""
    out = StructType.fromDDL("doc_id long, fp long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        for piece in pieces(batches, "text", 2 << 20):
            yield batch(schema, piece.column("doc_id"), fingerprints_of(as_bytes(piece.column("text")), words).view(np.int64))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), out)


def near_duplicates(spark: SparkSession, docs: DataFrame, *, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), component_id (the least doc_id reachable)."""
    scratch = Scratch(spark, "simhash")
    rows = scratch.write(fingerprinted(docs, words, id_col, text_col), "rows")
    prints = scratch.write(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = connected(links_of(prints.select(F.col("fp").alias("node"), "fp", F.lit(0).cast("long").alias("more")), scratch), scratch)
    named = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = scratch.write(named.join(least, "root").select("fp", "component_id"), "classes")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def shingles_of(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; of the whole text if it has fewer words."""
    own, digest = text.lower().split(), xxhash.xxh64_intdigest
    joined = b" ".join(own)
    if len(own) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, own), np.int64, len(own))
    ends = np.cumsum(sizes + 1) - 1
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip((ends - sizes)[: len(own) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64))


def similar_links(rows: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose shingle sets have a Jaccard similarity of at least `similarity`.

    One set at a time meets, over an inverted index, all that are not connected yet."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    code = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else owner
    order = np.argsort(code, kind="stable")
    by_code, bounds = owner[order], np.r_[0, np.cumsum(np.bincount(code))]
    cuts = np.r_[0, np.cumsum(sizes)]
    open_, links = np.ones(len(sets), bool), []
    while open_.any():
        front = [int(np.flatnonzero(open_)[0])]
        open_[front[0]] = False
        while front and open_.any():
            k = front.pop()
            own = code[cuts[k] : cuts[k + 1]]
            common = np.zeros(len(sets), np.int64)
            for c in own.tolist():
                common[by_code[bounds[c] : bounds[c + 1]]] += 1
            found = np.flatnonzero(open_ & (common >= similarity * (sizes + sizes[k] - common) - 1e-9))
            links += [(rows[k], rows[j]) for j in found.tolist()]
            open_[found] = False
            front += found.tolist()
    return links


#: Texts of a candidate group that are compared at once; texts of a group that is cut anew by its own shingle counts.
GROUP, LARGE = 1024, 64
#: One text of so many says which shingles are common (in large groups every text does), and by how many it is told apart. They set the order only.
SAMPLE, LEVELS = 8, (2, 8, 64)
#: Bits of the bitmap of each level, for each shingle of the first level and at most.
BITS_FOR_EACH, MAX_BITS = 16, 1 << 26
#: Rows of one or two numbers are broadcast up to this many (some 50 bytes each); beyond it they are joined by shuffle.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def prefix_of(shingles: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """The first of a set's sorted shingles in one order of all shingles (by rank, a function of the shingle): two sets of at least the similarity share one of them.

    Their overlap is at least similarity * len(shingles), so all but one less of that many may be left out."""
    if rank.any():
        shingles = shingles[np.lexsort((shingles, rank))]
    return shingles[: len(shingles) - math.ceil(similarity * len(shingles) - 1e-9) + 1]


def _ranks(texts: DataFrame, words: int, every: int, scratch: Scratch, name: str) -> Broadcast:
    """Bitmaps, one for each level, of the shingles that so many of the sampled texts hold. A shingle's rank is the number of bitmaps that have its bit."""
    out = StructType.fromDDL("tokens array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 2 << 20):
            yield batch(to_arrow_schema(out), [shingles_of(t, words).view(np.int64) for t in as_bytes(piece.column("text"))])

    sample = texts.where(F.pmod(F.xxhash64("row"), F.lit(every)) == 0).select("text").mapInArrow(lean(run), out).select(F.explode("tokens").alias("token"))
    found = scratch.write(sample.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), name)
    bits = min(MAX_BITS, 1 << max(16, (BITS_FOR_EACH * found.count()).bit_length()))
    levels = [np.frombuffer(bitmap(found.where(F.col("n") >= least), "token", bits), np.uint8) for least in LEVELS]
    scratch.drop(name)
    return scratch.spark.sparkContext.broadcast(levels)


def candidates(texts: DataFrame, scratch: Scratch, *, words: int, similarity: float, sample: int = SAMPLE, name: str = "ranks") -> DataFrame:
    """Links a, b that join, directly or over others, all texts whose sets have the similarity: neighbours by size among the texts that share a shingle of
    their prefixes. Sets of more different sizes can't be similar; what lies between two sizes near enough is near enough to both."""
    levels, out = _ranks(texts, words, sample, scratch, name), StructType.fromDDL("token long, row long, size int")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 2 << 20):
            sets = [shingles_of(t, words) for t in as_bytes(piece.column("text"))]
            own = [prefix_of(x, sum((marked(bits, x).astype(np.int8) for bits in levels.value), np.zeros(len(x), np.int8)), similarity) for x in sets]
            many = [len(x) for x in own]
            yield batch(to_arrow_schema(out), np.concatenate(own).view(np.int64), np.repeat(piece.column("row").to_numpy(), many), np.repeat(np.array([len(x) for x in sets], np.int32), many))

    before = Window.partitionBy("token").orderBy("size", "row")
    beside = texts.select("row", "text").mapInArrow(lean(prefixes), out).select(F.lag("row").over(before).alias("a"), F.lag("size").over(before).alias("less"), F.col("row").alias("b"), "size")
    return beside.where(F.col("less") >= F.col("size") * similarity - 1e-9).select("a", "b")


def similar(spark: SparkSession, texts: DataFrame, scratch: Scratch, *, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """texts: row, text, written, distinct texts. Links a, b (rows) that join the texts at or over the similarity, and no others.

    Texts that share a shingle of their prefixes make candidate groups, which hold every pair at the similarity. The texts of large groups are grouped
    once more, by prefixes in the order of their own counts: shingles that are common but not in the sample join what has no kinship. Within a group the exact
    similarity of shingle sets decides, in blocks of GROUP texts."""
    first = connected(candidates(texts, scratch, words=words, similarity=similarity), scratch, name="candidates").select(F.col("node").alias("row"), "root")
    first = scratch.write(first.join(first.groupBy("root").agg(F.count("*").alias("n")), "root"), "first")
    large = scratch.write(texts.join(small(first.where(F.col("n") > LARGE).select("row")), "row", "left_semi").select("row", "text"), "large")
    anew = connected(candidates(large, scratch, words=words, similarity=similarity, sample=1, name="own_ranks"), scratch, name="anew").select(F.col("node").alias("row"), "root")
    grouped = first.where(F.col("n") <= LARGE).select("row", "root").union(anew)
    sizes = grouped.groupBy("root").agg(F.count("*").alias("n"))
    grouped = scratch.write(grouped.join(sizes, "root").select("row", "root", F.ceil(F.col("n") * 2 / GROUP).cast("int").alias("blocks")), "groups")
    held = StructType.fromDDL("row long, root long, blocks int, shingles binary")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 2 << 20):
            yield batch(to_arrow_schema(held), *[piece.column(n) for n in ("row", "root", "blocks")], [shingles_of(t, words).tobytes() for t in as_bytes(piece.column("text"))])

    sets = texts.join(small(grouped), "row").select("row", "root", "blocks", "text").mapInArrow(lean(shingle), held)
    own = sets.withColumn("own", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = own.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "row", "shingles")
    pairs = StructType.fromDDL("a long, b long")

    def compare(group: pa.Table) -> pa.Table:
        found = similar_links(group.column("row").to_pylist(), [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()], similarity)
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=to_arrow_schema(pairs))

    return own.groupBy("root", "i", "j").applyInArrow(compare, pairs)


def keep_one(spark: SparkSession, docs: DataFrame, *, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, without near copies: of each group one row of least id stays.

    Groups join equal texts, texts whose fingerprints link (near_duplicates), and texts whose sets of `words`-word
    shingles have the similarity or more; one row of each distinct text is compared, whatever its fingerprint links to. A row with a null id stays only if its group has no id; of rows that repeat
    an id the first by text hash stays.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    key, text = f"c{docs.columns.index(id_col)}", f"c{docs.columns.index(text_col)}"
    scratch = Scratch(spark, "keep")
    rows = scratch.write(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()), "rows")
    texts = rows.select("row", F.col(text).cast("string").alias("text"))
    found = scratch.write(fingerprinted(texts, 4, "row", "text").withColumnRenamed("doc_id", "row"), "found")
    prints = scratch.write(found.groupBy("fp").agg(F.min("row").alias("node")), "prints")  # the rows of a fingerprint are one node
    links = scratch.write(links_of(prints.select("node", "fp", F.lit(0).cast("long").alias("more")), scratch), "links")
    firsts = scratch.write(texts.groupBy(F.sha2("text", 256)).agg(F.min("row").alias("row")).select("row"), "firsts")
    near = scratch.write(similar(spark, texts.join(small(firsts), "row", "left_semi"), scratch, words=words, similarity=similarity), "similar")
    nodes = found.join(prints, "fp").select("row", "node")
    for end in ("a", "b"):  # from rows to their nodes
        near = near.join(nodes.withColumnRenamed("row", end), end).drop(end).withColumnRenamed("node", end)
    merged = connected(links.unionByName(near), scratch, name="merged")
    ids = rows.select("row", F.col(key).cast("long").alias("own"), F.xxhash64(text).alias("hash"))
    groups = nodes.join(merged, "node", "left").select("row", F.coalesce("root", "node").alias("group"))
    least = F.min(F.struct(F.col("own").isNull().alias("unnamed"), "own", "hash", "row")).alias("least")
    kept = groups.join(ids, "row").groupBy("group").agg(least).select(F.col("least.row").alias("row"))
    gone = scratch.write(groups.select("row").join(kept, "row", "left_anti"), "gone")
    for table in scratch.tables - {"rows", "gone"}:  # the result needs no other
        scratch.drop(table)
    return rows.join(small(gone), "row", "left_anti").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
