"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features of a text are its distinct words without outer marks (A-Z in lower case) and their prefixes of 3 to 6
letters. The classifier is fitted on at most SAMPLE labelled documents, those of least hash of the id (a documented
bound). Their features are counted by class over the cluster; those that stand in toxic documents more often than
not are ordered by the chance of so many (Chernoff's bound on the binomial tail). The model
takes all that pass a false discovery rate of RATE, which few labels can do as well as many; if these are fewer than
LEAST it is filled up with the first that have SUPPORT toxic documents and are toxic in a share of PURE or more. A
ridge penalty, a prior of fixed width, holds down what few labels support; FEATURES is the most it takes. Labels are
binary, so severity grades of the training rows come from evidence: 0 for a label of 0; a toxic document is 1, 2 or 3
as its number of words with a feature that passes the rate (with any, if none passes), repeats included, is up to 1,
up to 3, or more. Severity is thus how much such evidence a text holds.

The proportional-odds model P(grade <= j | x) = sigmoid(theta_j - w.x) shares w over its thresholds theta_1 < theta_2
< theta_3. Every text is scored whole: probabilities of the grades, expected severity sum j P(j), toxic if P(grade >= 1) >= THRESHOLD.

Null text has no features. Null labels and labels without a document are left out, before the bound is taken; of
labels that repeat an id the highest counts. If labels hold no toxic or no clean document, or no feature has SUPPORT
toxic documents, all texts get severity 0. Rows that repeat score alike; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from attestor.llm.common import Scratch, as_bytes, batch, lean, pieces

GRADES, FEATURES, SAMPLE, THRESHOLD = 3, 2048, 20_000, 0.5
RATE, LEAST, PURE, SUPPORT, PENALTY, PREFIXES = 0.1, 512, 0.9, 2, 0.05, (3, 4, 5, 6)
MARKS = b".,;:!?\"'()[]{}*#$%&|<>-_"


def features_of(word: str) -> list[str]:
    return [f"={word}"] + [f"^{word[:n]}" for n in PREFIXES if len(word) > n]


def words_of(text: bytes) -> list[str]:
    return [w for w in (x.strip(MARKS).decode() for x in text.lower().split()) if w]


@dataclass
class ToxicityModel:
    features: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray
    sure: int = 0  # the first so many features pass the false discovery rate

    def counts(self, texts: list[bytes], known: dict[bytes, tuple[int, ...]]) -> list[tuple[int, list[int]]]:
        """Of each text: words with a sure feature, and its distinct features. known: features of words seen before."""
        out, sure = [], self.sure or len(self.features)
        for text in texts:
            found, words = set(), 0
            for raw in text.lower().split():
                own = known.get(raw)
                if own is None:
                    word = raw.strip(MARKS).decode()
                    own = known[raw] = tuple(k for k in map(self.features.get, features_of(word) if word else ()) if k is not None)
                if own:
                    words += min(own) < sure
                    found.update(own)
            out.append((words, sorted(found)))
        return out

    def probabilities(self, found: list[list[int]]) -> np.ndarray:
        """P(grade = 0..GRADES) of each row."""
        margin = np.array([self.weights[f].sum() for f in found])
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None] - margin[:, None], -30, 30)))
        return np.diff(np.c_[np.zeros(len(margin)), below, np.ones(len(margin))], axis=1)


def fit_ordinal(rows: list[list[int]], grade: np.ndarray, size: int, steps: int = 400, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds by Adam on the mean of log loss and penalty / 2 * |w|^2 over the rows; thresholds are a first one and exponentials of gaps."""
    index = np.concatenate([np.array(r, np.int64) for r in rows]) if rows else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    theta = np.concatenate([np.zeros(size), [1.0], np.zeros(GRADES - 1)])
    m, v = np.zeros(len(theta)), np.zeros(len(theta))
    for t in range(1, steps + 1):
        w, cuts = theta[:size], np.cumsum(np.r_[theta[size], np.exp(theta[size + 1 :])])
        margin = np.bincount(row, w[index], len(rows))
        below = 1 / (1 + np.exp(-np.clip(np.c_[np.full(len(rows), -np.inf), cuts[None] - margin[:, None], np.full(len(rows), np.inf)], -40, 40)))
        slope = below * (1 - below)
        at = np.arange(len(rows))
        p = np.maximum(below[at, grade + 1] - below[at, grade], 1e-12)
        upper, lower = slope[at, grade + 1] / p / len(rows), slope[at, grade] / p / len(rows)  # of the loss by the upper cut, by the lower
        upper, lower = np.where(grade < GRADES, upper, 0), np.where(grade > 0, lower, 0)
        by_margin = upper - lower
        by_cut = np.bincount(np.minimum(grade, GRADES - 1), -upper, GRADES) + np.bincount(np.maximum(grade - 1, 0), lower, GRADES)
        rising = np.cumsum(by_cut[::-1])[::-1]
        g = np.concatenate([np.bincount(index, by_margin[row], size) + penalty * w / max(len(rows), 1), [rising[0]], rising[1:] * np.exp(theta[size + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
    return theta[:size], np.cumsum(np.r_[theta[size], np.exp(theta[size + 1 :])])


def select_features(known: DataFrame, n: int, n_toxic: int, limit: int = FEATURES) -> tuple[list[str], int]:
    """known: toxic, text of the labelled rows. Features, the most significant first, and how many of them pass the false discovery rate."""
    out = StructType.fromDDL("feature string, toxic long, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        for piece in pieces(batches, "text"):
            count: dict[str, list[int]] = {}
            for text, toxic in zip(as_bytes(piece.column("text")), piece.column("toxic").to_pylist(), strict=True):
                for f in {f for w in set(words_of(text)) for f in features_of(w)}:
                    own = count.setdefault(f, [0, 0])
                    own[0] += toxic
                    own[1] += 1
            toxic = [f for f, c in count.items() if c[0]]
            clean = [f for f, c in count.items() if not c[0]]
            yield batch(schema, toxic + clean, [count[f][0] for f in toxic] + [0] * len(clean), [count[f][1] for f in toxic + clean])

    share, seen = n_toxic / n, Observation()
    counts = known.select("toxic", "text").mapInArrow(lean(run), out).groupBy("feature").agg(F.sum("toxic").alias("k"), F.sum("n").alias("n"))
    r = F.col("k") / F.col("n")
    excess = F.col("n") * (r * F.log(r / share) + F.when(r < 1, (1 - r) * F.log((1 - r) / (1 - share))).otherwise(0.0))
    tested = counts.where((F.col("k") >= SUPPORT) & (r > share) & (r >= 0.5)).withColumn("excess", F.round(excess, 9)).observe(seen, F.count(F.lit(1)).alias("n"))
    best = tested.orderBy(F.desc("excess"), "feature").limit(limit).collect()
    sure = max((k for k, x in enumerate(best, 1) if -x["excess"] <= np.log(RATE * k / seen.get["n"])), default=0)
    pure = [x for x in best[sure:] if x["k"] >= PURE * x["n"]]
    return [x["feature"] for x in best[:sure] + pure[: max(0, LEAST - sure)]], sure


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> ToxicityModel:
    """docs: doc_id, text; labels: doc_id, toxic."""
    labels = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = labels.join(texts.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = Scratch(spark, "toxicity").write(texts.join(F.broadcast(chosen), "doc_id"), "known")  # at most `sample` ids
    n, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    empty = ToxicityModel({}, np.zeros(0), np.full(GRADES, 30.0))
    if not 0 < n_toxic < n:
        return empty
    names, sure = select_features(known, n, n_toxic)
    model = ToxicityModel({f: k for k, f in enumerate(names)}, np.zeros(len(names)), empty.thresholds, sure)
    if not names:
        return empty
    out = StructType.fromDDL("doc_id long, toxic int, words long, features array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, seen = to_arrow_schema(out), {}
        for piece in pieces(batches, "text"):
            found = model.counts(as_bytes(piece.column("text")), seen)
            yield batch(schema, piece.column("doc_id"), piece.column("toxic"), [w for w, _ in found], [f for _, f in found])
            seen.clear()

    rows = known.select("doc_id", "toxic", "text").mapInArrow(lean(run), out)
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "words").limit(sample).collect()
    grade = np.array([0 if not r["toxic"] else 1 if r["words"] <= 1 else 2 if r["words"] <= 3 else 3 for r in rows], np.int64)
    return ToxicityModel(model.features, *fit_ordinal([r["features"] for r in rows], grade, len(names)), sure)


def score(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, severity (expected grade), grade (the median: the least with a chance of half or more not to be exceeded), p_toxic, toxic for each row of docs."""
    out = StructType.fromDDL("doc_id long, severity double, grade int, p_toxic double, toxic boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, seen = to_arrow_schema(out), {}
        for piece in pieces(batches, "text"):
            if len(seen) > 300_000:
                seen.clear()
            p = model.probabilities([f for _, f in model.counts(as_bytes(piece.column("text")), seen)])
            yield batch(schema, piece.column("doc_id"), p @ np.arange(GRADES + 1), (np.cumsum(p, 1)[:, :GRADES] <= 0.5).sum(1).astype(np.int32), 1 - p[:, 0], 1 - p[:, 0] >= threshold)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), out)
