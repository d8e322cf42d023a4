"""Quality rules: logistic regression over hashed word and character n-grams, calibrated, with fixed thresholds.

A text is three bags: words, word pairs and character trigrams, each hashed into 2**BITS features and given as
shares of the bag. The model is fitted on at most SAMPLE labelled documents (those of least hash of the id: a
documented bound), the margins are made probabilities by Platt's sigmoid fitted on held-out halves, and every
document is scored in Arrow batches against REJECT_BELOW. Rules that need no labels come first (base_failed).

Null text has no words and fails the rules. Null labels, ids without a document and repeated labels are allowed:
null labels are left out. If a class has no labelled document, the model keeps all. Empty tables give no rows.
Other columns are not read; keep_good passes all columns through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from attestor.llm.common import as_bytes, batch, lean, pieces
from attestor.llm.features import Tokens, families

BITS, SAMPLE, SCALE = 14, 1500, 20.0
#: Bytes of texts that are turned into features at once; a worker takes about 60 times as much memory.
PIECE = 1 << 20
MIN_WORDS, MAX_REPEAT_PERCENT, REJECT_BELOW = 50, 50, 0.2
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probabilities(self, tokens: Tokens) -> np.ndarray:
        """Calibrated probability that each text is good."""
        margin = np.full(tokens.n, self.bias)
        for text, feature in families(tokens, BITS):
            margin += SCALE * np.bincount(text, self.weights[feature], tokens.n) / np.maximum(np.bincount(text, minlength=tokens.n), 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def _rows(texts: list[bytes]) -> list[tuple[bytes, bytes]]:
    """Distinct features of each text and their weights."""
    tokens = Tokens(texts)
    parts = [[] for _ in texts]
    for text, feature in families(tokens, BITS):
        key, count = np.unique(text.astype(np.int64) << 32 | feature, return_counts=True)
        own = key >> 32
        share = SCALE * count / np.maximum(np.bincount(text, minlength=tokens.n), 1)[own]
        cuts = np.searchsorted(own, np.arange(tokens.n + 1))
        for k in range(tokens.n):
            parts[k].append(((key[cuts[k] : cuts[k + 1]] & 0xFFFFFFFF).astype("<i4"), share[cuts[k] : cuts[k + 1]].astype("<f4")))
    return [(np.concatenate([x for x, _ in p]).tobytes(), np.concatenate([y for _, y in p]).tobytes()) for p in parts]


def fit_logistic(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, size: int, steps: int = 120, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the mean log loss with classes weighted to the same total."""
    index = np.concatenate([i for i, _ in rows])
    value = np.concatenate([v for _, v in rows]).astype(float)
    row = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    share = np.where(good, 0.5 / max(good.sum(), 1), 0.5 / max((~good).sum(), 1))
    w, b = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1):
        margin = np.bincount(row, value * w[index], len(rows)) + b
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - good) * share
        g = np.bincount(index, value * error[row], size) + penalty * w
        gb = error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.05 / (1 - 0.9**t)
        w -= rate * m / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= rate * mb / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w, b


def platt(margin: np.ndarray, good: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a sigmoid by Newton's method, towards targets that are moved in by one count."""
    target = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    x, theta = np.c_[margin, np.ones(len(margin))], np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        move = np.linalg.solve(hessian, x.T @ (p - target))
        theta -= np.clip(move, -2, 2)
        if abs(move).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> QualityModel:
    """docs: doc_id, text; labels: doc_id, quality. At most `sample` labelled rows reach the driver, as features."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    chosen = labels.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    out = StructType.fromDDL("doc_id long, quality int, features binary, shares binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        for piece in pieces(batches, "text", PIECE):
            yield batch(schema, piece.column("doc_id"), piece.column("quality"), *zip(*_rows(as_bytes(piece.column("text"))), strict=True))

    known = docs.join(F.broadcast(chosen), "doc_id")
    found = known.select("doc_id", "quality", "text").mapInArrow(lean(run), out).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("features")).limit(sample).collect()
    size, good = 3 << BITS, np.array([r["quality"] > 0 for r in found], bool)
    if good.all() or not good.any():
        return QualityModel(np.zeros(size), 10.0, 1.0, 0.0)
    rows = [(np.frombuffer(r["features"], "<i4").astype(np.int64), np.frombuffer(r["shares"], "<f4")) for r in found]
    half, margin = np.arange(len(rows)) % 2 == 0, np.zeros(len(rows))
    for own in (half, ~half):
        w, b = fit_logistic([rows[k] for k in np.flatnonzero(own)], good[own], size)
        margin[~own] = [v @ w[i] + b for i, v in (rows[k] for k in np.flatnonzero(~own))]
    slope, offset = platt(margin, good)
    return QualityModel(*fit_logistic(rows, good, size), slope, offset)


def rule_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    repeated = 0
    if len(words) > 2:
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        pair = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
        _, where, count = np.unique(pair[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
        again = np.flatnonzero(count[where] > 1)
        if len(again):
            covered = np.zeros(len(words), bool)
            for k in range(3):
                covered[again + k] = True
            repeated = int(covered.sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def _judge(texts: list[bytes], model: QualityModel) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    counts = [rule_counts(t.decode()) for t in texts]
    failed = np.array([n < MIN_WORDS or 100 * again > MAX_REPEAT_PERCENT * n for n, *_, again in counts], bool)
    return counts, failed, model.probabilities(Tokens(texts))


def score(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, counts, base_failed, kept, probability."""
    out = StructType.fromDDL("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        for piece in pieces(batches, "text", PIECE):
            counts, failed, p = _judge(as_bytes(piece.column("text")), model)
            yield batch(schema, piece.column("doc_id"), *zip(*counts, strict=True), failed, ~failed & (p >= REJECT_BELOW), p)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), out)


def keep_good(docs: DataFrame, model: QualityModel, *, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that neither the rules nor the model reject."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text_col, PIECE):
            _, failed, p = _judge(as_bytes(piece.column(text_col)), model)
            yield piece.filter(pa.array(~failed & (p >= REJECT_BELOW)))

    return docs.mapInArrow(lean(run), docs.schema)
