"""Hidden Markov language model over word classes.

A text is its words (A-Z in lower case) and one end token. Each known word belongs to a class: the TOP most frequent
have their own, the others share BUCKETS classes by their last three bytes; the end and unknown words are two more.
A word's probability is that of its class in the hidden state times its add-one share of the class:
P(word | state) = B[state, class] * (c + 1) / Z[class], Z = sum of (c + 1) over the class. Words that were not
trained on are one symbol of mass 1 / (N + V + 1) in every state, as in the base model, so scores of both are comparable.

Counts of all training words are made by shuffle. Baum-Welch then runs over all training texts: each task adds
expected counts of its texts by forward and backward recursions (texts of over SEGMENT tokens train as consecutive
segments), the sums over tasks are one row for each class, and the driver holds only the K x classes model. Scoring
runs the scaled forward recursion over whole texts, so a score is the exact log10 likelihood.

Training texts are those whose crc32(doc_id as text) mod 7 is not 2; a null id is the empty text (remainder 0).
Null text is empty: one end token. Rows that repeat count and score as often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from attestor.llm.common import Scratch, as_bytes, batch, lean, pieces

TOP, BUCKETS, STATES, ROUNDS, SEGMENT, BLOCK = 4096, 2048, 6, 3, 1024, 8 << 20
END, UNKNOWN = TOP + BUCKETS, TOP + BUCKETS + 1
CLASSES = TOP + BUCKETS + 2
#: Pseudo-tokens of the base distribution in each state, and of uniform transitions.
PRIOR = 100.0


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


class Packed:
    """Sequences laid out by time, longest first, so that each step of a recursion is one slice."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        rank = np.empty_like(self.order)
        rank[self.order] = np.arange(len(lengths))
        longest = int(lengths.max(initial=0))
        self.active = np.searchsorted(-lengths[self.order], -np.arange(longest), "left")  # sequences longer than t
        self.offset = np.r_[0, np.cumsum(self.active)]
        time = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.place = self.offset[time] + np.repeat(rank, lengths)

    def by_time(self, symbols: np.ndarray) -> np.ndarray:
        out = np.empty_like(symbols)
        out[self.place] = symbols
        return out


class Model:
    """start (K), move (K x K), emit (classes x K)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    def forward(self, packed: Packed, emitted: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Scales of each token, in order of time, and the scaled forward variables."""
        scale, alphas = np.empty(len(emitted)), np.empty_like(emitted) if keep else None
        for t, n in enumerate(packed.active.tolist()):
            a, b = packed.offset[t], packed.offset[t] + n
            alpha = (self.start if t == 0 else alpha[:n] @ self.move) * emitted[a:b]
            s = alpha.sum(1)
            alpha /= s[:, None]
            scale[a:b] = s
            if keep:
                alphas[a:b] = alpha
        return scale, alphas

    def expected(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected emissions (classes x K), transitions and starts of the sequences."""
        packed, k = Packed(lengths), len(self.start)
        by_time = packed.by_time(symbols)
        emitted = self.emit[by_time]
        scale, gamma = self.forward(packed, emitted, True)
        moves, steps, beta = np.zeros((k, k)), packed.active.tolist(), None
        for t in range(len(steps) - 1, -1, -1):
            a, n = packed.offset[t], steps[t]
            own = np.ones((n, k))
            if beta is not None:
                b, m = packed.offset[t + 1], len(beta)
                ahead = emitted[b : b + m] * beta / scale[b : b + m, None]
                moves += gamma[a : a + m].T @ ahead
                own[:m] = ahead @ self.move.T
            gamma[a : a + n] *= own
            beta = own
        first = gamma[: steps[0]].sum(0) if steps else np.zeros(k)
        counts = np.stack([np.bincount(by_time, gamma[:, j], len(self.emit)) for j in range(k)], 1)
        return counts, moves * self.move, first

    def log10(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 likelihood of each sequence."""
        packed = Packed(lengths)
        scale, _ = self.forward(packed, self.emit[packed.by_time(symbols)], False)
        return np.add.reduceat(np.log10(scale)[packed.place], np.cumsum(lengths) - lengths) if len(lengths) else np.empty(0)


def first_model(mass: np.ndarray, states: int, seed: int = 7) -> Model:
    """mass: base probability of each class. States differ from it by fixed pseudo-random factors."""
    emit = mass[:, None] * np.exp(0.5 * np.random.default_rng(seed).standard_normal((len(mass), states)))
    return Model(np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), _normal(emit, mass))


def _normal(emit: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Unknown words keep the base's mass in every state; the other classes share the rest."""
    emit = emit.copy()
    emit[UNKNOWN] = 0
    emit *= (1 - mass[UNKNOWN]) / np.maximum(emit.sum(0), 1e-300)
    emit[UNKNOWN] = mass[UNKNOWN]
    return emit


def next_model(counts: np.ndarray, moves: np.ndarray, first: np.ndarray, mass: np.ndarray) -> Model:
    k = len(first)
    return Model((first + 1) / (first.sum() + k), (moves + PRIOR / k) / (moves.sum(1, keepdims=True) + PRIOR), _normal(counts + PRIOR * mass[:, None], mass))


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each block of texts: its ids, token counts, word numbers (compressed; 0 is the end) and its words, most frequent first, with training counts."""
    out = StructType.fromDDL("block long, doc_ids array<long>, lengths array<int>, numbers binary, words array<binary>, train array<long>, train_docs long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, task = to_arrow_schema(out), TaskContext.get().partitionId()
        for k, piece in enumerate(pieces(batches, "text", BLOCK)):
            cut = [t.lower().split() for t in as_bytes(piece.column("text"))]
            ids = piece.column("doc_id").to_pylist()
            trains = np.array([not held_out(d) for d in ids])
            flat = [w for words in cut for w in words]
            words = list(dict.fromkeys(flat))
            number = dict(zip(words, range(len(words)), strict=True))
            own = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
            sizes = np.fromiter(map(len, cut), np.int64, len(cut))
            order = np.argsort(-np.bincount(own, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            own = rank[own]
            train = np.bincount(own[np.repeat(trains, sizes)], minlength=len(words))
            numbers = np.zeros(len(own) + len(cut), "<i4")
            numbers[np.arange(len(own)) + np.repeat(np.arange(len(cut)), sizes)] = own + 1
            yield batch(schema, [task << 32 | k], [ids], [(sizes + 1).astype(np.int32)], [zstandard.compress(numbers.tobytes(), 3)], [[words[j] for j in order.tolist()]], [train], [int(trains.sum())])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), out)


def score(spark: SparkSession, docs: DataFrame, *, states: int = STATES, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    scratch = Scratch(spark, "hmm")
    blocks = scratch.write(_blocks(docs, id_col, text_col), "blocks")
    own = blocks.select("block", F.posexplode(F.arrays_zip("words", "train")).alias("at", "x")).select("block", "at", F.col("x.words").alias("word"), F.col("x.train").alias("n"))
    counts = own.where("n > 0").groupBy("word").agg(F.sum("n").alias("c"))
    counts = scratch.write(counts, "counts")
    top = counts.orderBy(F.desc("c"), "word").limit(TOP).collect()
    ranks = spark.createDataFrame([(bytes(r["word"]), k) for k, r in enumerate(top)], "word binary, rank int")
    shared = F.lit(TOP) + F.pmod(F.xxhash64(F.expr("substring(word, -3, 3)")), F.lit(BUCKETS)).cast("int")
    classed = counts.join(F.broadcast(ranks), "word", "left").select("word", "c", F.coalesce("rank", shared).alias("class"))
    sums = classed.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    ends = blocks.agg(F.coalesce(F.sum("train_docs"), F.lit(0))).first()[0]
    total, distinct = sum(r["c"] for r in sums) + ends, sum(r["v"] for r in sums) + (ends > 0)
    space = total + distinct + 1
    z = np.zeros(CLASSES)
    for r in sums:
        z[r["class"]] = r["c"] + r["v"]
    z[END], z[UNKNOWN] = (ends + 1) * (ends > 0), 1
    mass = z / space
    tagged = own.join(classed, "word").select("block", "at", "c", "class")
    out = StructType.fromDDL("doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, inner double, classes binary")

    def tag(left: pa.Table, right: pa.Table) -> pa.Table:
        """Numbers become classes; `inner` is what the words add within their classes."""
        parts = []
        for row in left.to_pylist():
            numbers = np.frombuffer(zstandard.decompress(row["numbers"]), "<i4")
            size = int(numbers.max(initial=0)) + 1
            c, kind = np.zeros(size), np.full(size, UNKNOWN)
            at = right.column("at").to_numpy() + 1
            c[at], kind[at] = right.column("c").to_numpy(), right.column("class").to_numpy()
            if ends:
                c[0], kind[0] = ends, END
            base, within = np.log10((c + 1) / space), np.log10((c + 1) / z[kind])
            lengths = np.array(row["lengths"], np.int64)
            starts = np.cumsum(lengths) - lengths
            known = np.add.reduceat((c > 0)[numbers].astype(np.int64), starts)
            flat, ends_at = kind[numbers].astype("<u2").tobytes(), (2 * (starts + lengths)).tolist()
            parts.append(pa.table([row["doc_ids"], [held_out(d) for d in row["doc_ids"]], lengths, known, np.add.reduceat(base[numbers], starts), np.add.reduceat(within[numbers], starts), [flat[a:b] for a, b in zip([0, *ends_at], ends_at, strict=False)]], schema=to_arrow_schema(out)))
        return pa.concat_tables(parts) if parts else to_arrow_schema(out).empty_table()

    texts = blocks.select(F.col("block").alias("part"), "doc_ids", "lengths", "numbers").groupBy("part").cogroup(tagged.groupBy("block")).applyInArrow(tag, out)
    texts = scratch.write(texts, "texts")
    scratch.drop("blocks")
    scratch.drop("counts")
    model = first_model(mass, states)
    for _ in range(rounds):
        model = _improve(texts, model, mass)
    return _scored(texts, model, total)


def _improve(texts: DataFrame, model: Model, mass: np.ndarray) -> Model:
    """One Baum-Welch round. Rows of class: expected emissions; after them K rows of transitions and one of starts."""
    states = len(model.start)
    out = StructType.fromDDL("row int, " + ", ".join(f"s{j} double" for j in range(states)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added = np.zeros((CLASSES + states + 1, states))
        for piece in pieces(batches, "classes", 2 << 20):
            raw = as_bytes(piece.column("classes"))
            symbols = np.frombuffer(b"".join(raw), "<u2").astype(np.int64)
            sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 2
            count = -(-sizes // SEGMENT)
            lengths = np.full(count.sum(), SEGMENT)
            lengths[np.cumsum(count) - 1] = sizes - (count - 1) * SEGMENT
            counts, moves, first = model.expected(symbols, lengths)
            added += np.concatenate([counts, moves, first[None]])
        some = np.flatnonzero(added.any(1))
        yield batch(to_arrow_schema(out), some.astype(np.int32), *added[some].T.copy())

    sums = texts.where("not held_out").select("classes").mapInArrow(lean(run), out).groupBy("row").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(states)]).collect()
    added = np.zeros((CLASSES + states + 1, states))
    for r in sums:
        added[r[0]] = r[1:]
    return next_model(added[:CLASSES], added[CLASSES:-1], added[-1], mass)


def _scored(texts: DataFrame, model: Model, total: int) -> DataFrame:
    out = StructType.fromDDL("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        for piece in pieces(batches, "classes", 2 << 20):
            symbols = np.frombuffer(b"".join(as_bytes(piece.column("classes"))), "<u2").astype(np.int64)
            found = model.log10(symbols, piece.column("n_tokens").to_numpy(zero_copy_only=False).astype(np.int64))
            same = [piece.column(n) for n in ("doc_id", "held_out", "n_tokens", "n_known")]
            yield batch(schema, *same, [total] * piece.num_rows, piece.column("base_score"), found + piece.column("inner").to_numpy(zero_copy_only=False))

    return texts.mapInArrow(lean(run), out)
