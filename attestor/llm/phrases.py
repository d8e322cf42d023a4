"""Substring deduplication by repeated-phrase automata.

A window is WINDOW consecutive words of one text. Words under a window whose word sequence also starts anywhere
else are removed. Three steps over all texts:

1. Anchors. Of each window's shingles of SHINGLE words the one of least hash is its anchor. Equal windows have equal
   anchors, and neighbouring windows mostly share one, so counting anchors is cheap. Only windows over an anchor
   that is chosen at two places can recur; a bitmap of those anchors (its size is bounded by MAX_BITS; a fuller bitmap lets more
   windows through, never fewer) goes to all tasks.
2. Confirmation. Windows that pass are counted exactly over the corpus, by 96 bits from two hashes of their words: among
   10^13 windows any two different ones agree with a chance below 0.001.
3. Location. Each block of texts compiles its confirmed passages, cut into phrases of WINDOW words, into
   Aho-Corasick automata (shards of at most SHARD phrases) and streams its texts through them; every word under a
   match goes.

A block is about BLOCK bytes of texts as they were read and is written before it is used, so that blocks stay the
same when tasks run again. Null text has no words; texts of fewer words than a window stay; rows that repeat lose
all their windows, as any other repeated text; null or repeated ids are no keys here. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from attestor.llm.common import Scratch, as_bytes, batch, bitmap, lean, marked, pieces
from attestor.llm.features import ODD, Tokens, mix

WINDOW, SHINGLE, BLOCK, SHARD = 35, 8, 2 << 20, 20_000
MIN_BITS, MAX_BITS, BITS_FOR_EACH = 1 << 16, 1 << 30, 32
NEXT, OTHER = np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD1342543DE82EF95)
#: Hashes that a task holds while it packs them by block.
HELD = 1 << 20


def rolling(words: np.ndarray, length: int, factor: np.uint64) -> np.ndarray:
    """Hash of every run of `length` word hashes."""
    n = len(words) - length + 1
    if n <= 0:
        return words[:0]
    power = np.cumprod(np.r_[np.uint64(1), np.full(len(words), factor)], dtype=np.uint64)
    back = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, np.uint64(pow(int(factor), -1, 1 << 64)))], dtype=np.uint64)
    sums = np.r_[np.uint64(0), np.cumsum(words * power[:-1], dtype=np.uint64)]
    return mix((sums[length:] - sums[:n]) * back)


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least value among each `width` neighbours, by doubling."""
    place, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        a, b = place[: len(place) - step], place[step:]
        place = np.where(values[b] < values[a], b, a)
        span += step
    return place


class Windows:
    """The windows of a batch of texts: first words, hashes, anchors."""

    def __init__(self, texts: list[bytes], window: int, shingle: int):
        self.tokens = Tokens(texts, fold=False)
        text, n = self.tokens.text, max(0, len(self.tokens.words) - window + 1)
        self.starts = np.flatnonzero(text[:n] == text[window - 1 :]) if n else np.empty(0, np.int64)
        self.window, self.shingle = window, shingle

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Place and hash of each window's anchor."""
        if not len(self.starts):
            return self.starts, np.empty(0, np.uint64)
        shingles = rolling(self.tokens.words, self.shingle, NEXT)
        place = least_places(shingles, self.window - self.shingle + 1)[self.starts]
        return place, shingles[place]

    def hashes(self) -> np.ndarray:
        return rolling(self.tokens.words, self.window, ODD)[self.starts] if len(self.starts) else np.empty(0, np.uint64)

    def checks(self) -> np.ndarray:
        """32 bits of a second hash of each window, from other hashes of its words."""
        if not len(self.starts):
            return np.empty(0, np.int32)
        return (rolling(self.tokens.hash(self.tokens.starts, self.tokens.ends, OTHER), self.window, NEXT)[self.starts] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def twice(*columns: np.ndarray) -> list[np.ndarray]:
    """Each distinct row of the columns, or two of it if it occurs more than once."""
    order = np.lexsort(columns[::-1])
    rows, third = [c[order] for c in columns], np.zeros(len(order), bool)
    again = np.logical_and.reduce([r[1:] == r[:-1] for r in rows])  # equal to the row before
    third[2:] = again[1:] & again[:-1]
    return [r[~third].view(np.int64) if r.dtype == np.uint64 else r[~third] for r in rows]


def recurring_anchors(docs: DataFrame, text_col: str, window: int, shingle: int) -> DataFrame:
    out = StructType([StructField("anchors", ArrayType(LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        for piece in pieces(batches, "text", BLOCK):
            place, value = Windows(as_bytes(piece.column("text")), window, shingle).anchors()
            yield batch(schema, twice(value[np.unique(place, return_index=True)[1]]))

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), out)
    return found.select(F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")


def phrases_in(words: np.ndarray, text: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """First words of phrases that cover the runs of confirmed windows: each window-th start of a run, and its last."""
    if not len(starts):
        return starts
    head = np.r_[True, (starts[1:] != starts[:-1] + 1) | (text[starts[1:]] != text[starts[:-1]])]
    run = np.cumsum(head) - 1
    first = starts[head][run]
    last = np.r_[head[1:], True]
    return starts[((starts - first) % window == 0) | last]


def locate(codes: np.ndarray, bounds: np.ndarray, phrases: np.ndarray, window: int) -> np.ndarray:
    """Which words lie under an occurrence of one of the phrases (given by their first words), found by automata."""
    covered = np.zeros(len(codes) + 1, np.int64)
    rows = np.unique(codes[phrases[:, None] + np.arange(window)], axis=0) if len(phrases) else np.empty((0, window), codes.dtype)
    for k in range(0, len(rows), SHARD):
        shard = rows[k : k + SHARD]
        known = np.unique(shard)
        letter = np.searchsorted(known, codes)
        letter = np.where(known[np.minimum(letter, len(known) - 1)] == codes, letter + 1, 0)
        letter = (letter + 0x800 * (letter >= 0xD800)).astype("<u4")  # no surrogates
        inner = np.searchsorted(known, shard) + 1
        inner = (inner + 0x800 * (inner >= 0xD800)).astype("<u4")
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for row in inner:
            automaton.add_word(row.tobytes().decode("utf-32-le"))
        automaton.make_automaton()
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= window:
                ends = np.fromiter((end for end, _ in automaton.iter(letter[a:b].tobytes().decode("utf-32-le"))), np.int64)
                np.add.at(covered, a + ends - window + 1, 1)
                np.add.at(covered, a + ends + 1, -1)
    return np.cumsum(covered[:-1]) > 0


def clean_block(texts: list[bytes], confirmed: np.ndarray, window: int, shingle: int) -> list[tuple[int, int, bytes, bytes]]:
    """Of each text: words, words removed, the kept words joined by one space, the new text."""
    windows = Windows(texts, window, shingle)
    tokens = windows.tokens
    starts = windows.starts[np.isin(windows.hashes(), confirmed)]
    codes = np.unique(tokens.words, return_inverse=True)[1]
    bounds = np.searchsorted(tokens.text, np.arange(len(texts) + 1))
    gone = locate(codes, bounds, phrases_in(tokens.words, tokens.text, starts, window), window)
    out = []
    for k, text in enumerate(texts):
        own, drop = text.split(), gone[bounds[k] : bounds[k + 1]]
        kept = [w for w, d in zip(own, drop.tolist(), strict=True) if not d] if drop.any() else own
        joined = b" ".join(kept)
        out.append((len(own), len(own) - len(kept), joined, joined if len(kept) < len(own) else text))
    return out


def remove_repeats(spark: SparkSession, docs: DataFrame, *, window: int = WINDOW, shingle: int = SHINGLE, text_col: str = "text", digest_id: str | None = None) -> DataFrame:
    """The rows of docs with repeated passages cut out of the text (texts without one stay as they are).

    With digest_id: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) instead.
    """
    if not window > shingle > 0:
        raise ValueError("a window must be longer than a shingle")
    scratch = Scratch(spark, "phrases")
    anchors = scratch.write(recurring_anchors(docs, text_col, window, shingle), "anchors")
    bits = min(MAX_BITS, max(MIN_BITS, 1 << (BITS_FOR_EACH * anchors.count()).bit_length()))
    marks = spark.sparkContext.broadcast(bitmap(anchors, "anchor", bits))
    scratch.drop("anchors")

    digest_out = StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string")
    result = digest_out if digest_id else docs.schema
    source = docs.select(F.col(digest_id).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) if digest_id else docs
    at = source.columns.index("text" if digest_id else text_col)
    hidden = [StructField(f"__block_{k}", t) for k, t in (("id", LongType()), ("kind", IntegerType()), ("windows", ArrayType(LongType(), False)), ("checks", ArrayType(IntegerType(), False)), ("words", LongType()), ("digest", BinaryType()))]
    marked_schema = StructType([StructField(f"c{k}", f.dataType) for k, f in enumerate(source.schema)] + hidden)
    plain = source.toDF(*[f"c{k}" for k in range(len(source.columns))])
    text_at = f"c{at}"

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of kind 1 wait for the confirmation of their block's windows (a row of kind 2); those of kind 0 are done."""
        schema, seen, task = to_arrow_schema(marked_schema), np.frombuffer(marks.value, np.uint8), TaskContext.get().partitionId()
        for k, piece in enumerate(pieces(batches, text_at, BLOCK)):
            block, texts = task << 32 | k, as_bytes(piece.column(text_at))
            windows = Windows(texts, window, shingle)
            hit = marked(seen, windows.anchors()[1])
            waiting = np.zeros(len(texts), bool)
            waiting[windows.tokens.text[windows.starts[hit]]] = True
            words = np.bincount(windows.tokens.text, minlength=len(texts))
            digests = [None if w or not digest_id else hashlib.sha256(b" ".join(t.split())).digest() for w, t in zip(waiting.tolist(), texts, strict=True)]
            columns = list(piece.columns)
            if digest_id:
                columns[at] = pa.array([t if w else None for w, t in zip(waiting.tolist(), piece.column(text_at).to_pylist(), strict=True)], schema.field(at).type)
            n = len(texts)
            yield batch(schema, *columns, [block] * n, waiting.astype(np.int32), [None] * n, [None] * n, words, digests)
            if hit.any():
                found = twice(windows.hashes()[hit], windows.checks()[hit])
                yield batch(schema, *[pa.nulls(1, f.type) for f in list(schema)[: len(columns)]], [block], [2], [found[0]], [found[1]], [None], [None])

    blocks = scratch.write(plain.mapInArrow(lean(mark), marked_schema), "marked")
    found = blocks.where("__block_kind = 2").select("__block_id", F.explode(F.arrays_zip("__block_windows", "__block_checks")).alias("w")).select("__block_id", F.col("w.__block_windows").alias("hash"), F.col("w.__block_checks").alias("check"))
    confirmed = found.withColumn("n", F.count("*").over(Window.partitionBy("hash", "check"))).where("n > 1").select(F.col("__block_id").alias("id"), "hash")
    packed_schema = StructType.fromDDL("id long, hashes binary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Confirmed hashes by block: one row for many of them."""
        held, n = [], 0

        def rows() -> pa.RecordBatch:
            block, value = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(block, kind="stable")
            ids, cuts = np.unique(block[order], return_index=True)
            return batch(to_arrow_schema(packed_schema), ids, [x.tobytes() for x in np.split(value[order], cuts[1:])])

        for b in batches:
            held.append(tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "hash")))
            n += b.num_rows
            if n > HELD:
                yield rows()
                held, n = [], 0
        if n:
            yield rows()

    packed = confirmed.mapInArrow(lean(pack), packed_schema)
    waiting = blocks.where("__block_kind = 1").drop("__block_kind", "__block_windows", "__block_checks", "__block_words", "__block_digest")

    def clean(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = to_arrow_schema(result)
        if not left.num_rows:
            return schema.empty_table()
        texts = as_bytes(left.column(text_at).combine_chunks())
        found = clean_block(texts, np.frombuffer(b"".join(right.column("hashes").to_pylist()), np.uint64), window, shingle)
        if digest_id:
            return pa.table([left.column("c0"), *([x[k] for x in found] for k in (0, 1)), [hashlib.sha256(x[2]).hexdigest() for x in found]], schema=schema)
        old = left.column(text_at).to_pylist()
        columns = [left.column(f"c{k}").cast(f.type) for k, f in enumerate(schema)]
        columns[at] = pa.array([o if not x[1] else x[3].decode() for o, x in zip(old, found, strict=True)], schema.field(at).type)
        return pa.table(columns, schema=schema)

    cleaned = waiting.groupBy("__block_id").cogroup(packed.groupBy("id")).applyInArrow(clean, result)
    done = blocks.where("__block_kind = 0")
    if digest_id:
        done = done.select(F.col("c0").alias("doc_id"), F.col("__block_words").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lower(F.hex("__block_digest")).alias("kept_sha256"))
    else:
        done = done.select(*[F.col(f"c{k}").alias(f.name) for k, f in enumerate(result)])
    return done.union(cleaned)
