"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens in table order. One round adds, from each live queue, its target share of a
window; what a share leaves below a whole token is the queue's deficit, carried into the next round, whatever
partition holds those tokens. A queue that runs dry gives its share to the others. Rounds follow each other in one stream, cut every
`window` tokens, so only the last window needs padding and each holds its queues' shares within a few tokens.

The deficit after round r is a function of r and the queues' totals alone (Schedule), so tasks place the
documents they hold without asking others: totals by (queue, task) are all that is gathered.

Null text is empty and packs as its end id; a null source is a queue of its own; null or repeated doc_ids are
packed like any other; an empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from attestor.llm.common import Scratch, as_bytes, batch, lean, pieces

END = 1
#: The places of the parts, a row for each queue and task, are broadcast up to this many; beyond it they are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Queues times rounds that a task looks at at once.
CELLS = 1 << 20
_loaded: dict = {}


class WordEncoder:
    """Ids of whole texts by a `tokenizers` file whose normaliser and splitter never reach over white space: chunks between spaces are encoded once and remembered."""

    def __init__(self, path: str, cache_size: int = 350_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.cache_size = Tokenizer.from_file(path), cache_size
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what is used again moves to the new cache
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self.dtype = "<u2" if len(self.ends) <= 1 << 16 else "<u4"
        self.plain = Tokenizer.from_file(path)  # for words that the normaliser and the splitter would leave alone
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _encode_words(self, words: list[str]) -> None:
        """Words of letters go in as lines; the word-end tokens tell them apart."""
        groups = [words[k : k + 512] for k in range(0, len(words), 512)]
        for own, found in zip(groups, self.plain.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, self.dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(own):
                flat, cuts = ids.tobytes(), (ids.itemsize * cuts).tolist()
                self.cache.update(zip(own, [flat[a:b] for a, b in zip([0, *cuts], cuts, strict=False)], strict=True))
            else:
                self._encode_chunks(own)

    def _encode_chunks(self, chunks: list[str]) -> None:
        for chunk, found in zip(chunks, self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False), strict=True):
            self.cache[chunk] = np.array(found.ids, self.dtype).tobytes()

    def _learn(self, chunks: set[str]) -> None:
        """A chunk of letters and one mark splits into two (if its letters stay letters); others go to the tokenizer whole."""
        marked = [c for c in chunks if c[-1:] in (",", ".") and c[:-1].isalpha() and (c.isascii() or is_normalized("NFC", c) and "\u0130" not in c)]
        new = chunks.difference(marked)
        if marked:
            new.update((",", "."))
            new.update([c[:-1] for c in marked])
        new.difference_update(self.cache)
        words = [c for c in new if c.isalpha() and c.islower() and is_normalized("NFC", c)]
        self._encode_words(words)
        self._encode_chunks(list(new.difference(words)))
        for chunk in marked:
            self.cache[chunk] = self.cache[chunk[:-1]] + self.cache[chunk[-1]]

    @staticmethod
    def _lower(text: bytes) -> str:
        """Letter by letter, as the normaliser does; str.lower() differs for a final sigma and a dotted capital I."""
        whole = text.decode()
        return text.lower().decode() if "\u03a3" in whole or "\u0130" in whole else whole.lower()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text and the end id, as little-endian unsigned integers of 16 bits, or 32 if the vocabulary needs them."""
        if len(self.cache) > self.cache_size:
            self.older, self.cache = self.cache, {}
        cut = [self._lower(t).replace("\n", " ").split(" ") for t in texts]
        need = set().union(*cut).difference(self.cache)
        again = need.intersection(self.older)
        self.cache.update(zip(again, map(self.older.__getitem__, again), strict=True))
        self._learn(need.difference(again))
        end, known = np.array([END], self.dtype).tobytes(), self.cache.__getitem__
        return [b"".join(map(known, chunks)) + end for chunks in cut]


class Schedule:
    """Where deficit round-robin has come to in each queue after any number of rounds."""

    def __init__(self, totals: list[int], weights: list[float], window: int):
        left, weights = np.array(totals, float), np.array(weights, float)
        self.totals, done, now = np.array(totals, np.int64), np.zeros(len(totals)), 0.0
        points: list[list[tuple[float, float]]] = [[] for _ in totals]
        while (live := left > 0.5).any():
            share = np.where(live, weights, 0)
            if share.sum() <= 0:  # only queues without a target are left: in proportion to what they hold
                share = np.where(live, left, 0)
            rate = window * share / share.sum()
            moving = rate > 0
            span = (left[moving] / rate[moving]).min()
            dry = moving & (left <= rate * span * (1 + 1e-9) + 1e-6)
            for q in np.flatnonzero(moving):
                points[q] = points[q] or [(now, 0.0)]
            done = np.where(dry, self.totals, done + rate * span)
            left = np.where(dry, 0, self.totals - done)
            now += span
            for q in np.flatnonzero(moving):
                points[q].append((now, done[q]))
        self.rounds = int(np.ceil(now)) + 1
        self.times = [np.array([t for t, _ in p] or [0.0]) for p in points]
        self.held = [np.array([c for _, c in p] or [0.0]) for p in points]

    def taken(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens that each queue (rows) has given before each round (columns)."""
        return np.stack([np.minimum(np.floor(np.interp(rounds, t, c) + 1e-6).astype(np.int64), n) for t, c, n in zip(self.times, self.held, self.totals, strict=True)])

    def span(self, queue: int, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rounds that can hold tokens first..last (from 0) of a queue."""
        at = lambda x: np.ceil(np.interp(x + 1, self.held[queue], self.times[queue])).astype(np.int64)
        return np.maximum(at(first) - 2, 0), np.minimum(at(last) + 2, self.rounds + 1)

    def place(self, queue: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cut runs of queue tokens by round; of each part: run, start in the queue, place in the stream, length. Parts that follow each other are one."""
        low, high = np.empty_like(first), np.empty_like(first)
        for q in np.unique(queue):
            own = queue == q
            low[own], high[own] = self.span(q, first[own], first[own] + length[own] - 1)
        count = high - low
        run = np.repeat(np.arange(len(first)), count)
        rounds = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[run]
        distinct, where = np.unique(rounds, return_inverse=True)
        own, order = queue[run], np.argsort(where, kind="stable")
        begun, given, base = np.empty((3, len(run)), np.int64)
        width = max(1, CELLS // len(self.totals))
        for k in range(0, len(distinct), width):
            here, then = self.taken(distinct[k : k + width]), self.taken(distinct[k : k + width] + 1)
            ahead = np.cumsum(then, 0) - then + here.sum(0) - (np.cumsum(here, 0) - here)  # earlier queues have given this round's share
            now = order[np.searchsorted(where[order], k) : np.searchsorted(where[order], k + width)]
            cell = own[now], where[now] - k
            begun[now], given[now], base[now] = here[cell], then[cell], (ahead - here)[cell]
        a = np.maximum(first[run], begun)
        b = np.minimum(first[run] + length[run], given)
        full = b > a
        run, start, size = run[full], a[full], (b - a)[full]
        place = base[full] + start
        head = np.ones(len(run), bool)
        head[1:] = (run[1:] != run[:-1]) | (place[1:] != place[:-1] + size[:-1])
        heads = np.flatnonzero(head)
        return run[heads], start[heads], place[heads], np.add.reduceat(size, heads) if len(heads) else size


def tokenise(docs: DataFrame, path: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """part, queue, doc_id, start (tokens of the queue before it in the part), n, ids."""
    out = StructType.fromDDL("part int, queue string, doc_id long, start long, n long, ids binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:
            _loaded[path] = WordEncoder(path)
        encoder, schema, part, given = _loaded[path], to_arrow_schema(out), TaskContext.get().partitionId(), {}
        for piece in pieces(batches, "text"):
            ids = encoder.encode(as_bytes(piece.column("text")))
            queues, sizes, starts = piece.column("queue").to_pylist(), [len(x) // np.dtype(encoder.dtype).itemsize for x in ids], []
            for q, n in zip(queues, sizes, strict=True):
                starts.append(given.get(q, 0))
                given[q] = starts[-1] + n
            yield batch(schema, [part] * len(ids), queues, piece.column("doc_id"), starts, sizes, ids)

    queue = F.concat(F.lit("="), F.col(source_col).cast("string"))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(queue, F.lit("null")).alias("queue"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), out)


def pack(spark: SparkSession, docs: DataFrame, path: str, *, window: int = 2048, mixture: dict[str | None, float] | None = None, max_queues: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", digest: bool = False) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset, and ids (bytes) or, with digest, ids_crc32.

    mixture: target weight by source; None takes each source's share of all tokens. A source it doesn't name comes when the named ones are dry.
    The tokens are encoded once and written. Every source is a queue of its own, and the driver holds a row for each; only where max_queues is given and
    there are more sources do the smaller ones that the mixture doesn't name share the last queue.
    """
    scratch = Scratch(spark, "pack")
    tokens = scratch.write(tokenise(docs, path, id_col, text_col, source_col), "tokens")
    by_part = tokens.groupBy("queue", "part").agg(F.sum("n").alias("held"))
    named = F.col("queue").isin(["null" if s is None else f"={s}" for s in mixture or ()])
    largest = by_part.groupBy("queue").agg(F.sum("held").alias("held")).orderBy(F.desc(named), F.desc("held"), "queue")
    if max_queues is None:
        own = largest.collect()
    else:
        most = max(max_queues, len(mixture or ()) + 1)
        own = largest.limit(most).collect()
        own = own if len(own) < most else own[: most - 1]
    names = spark.createDataFrame([(r["queue"], k) for k, r in enumerate(own)] or [("", 0)], "queue string, q int")
    by_part = by_part.join(F.broadcast(names) if len(own) <= BROADCAST_ROWS else names, "queue", "left").fillna(len(own), ["q"])
    before = Window.partitionBy("q").orderBy("part", "queue").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("queue", "part", "q", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    totals = {r["q"]: r["held"] for r in by_part.groupBy("q").agg(F.sum("held").alias("held")).collect()}
    size = len(own) + 1
    targets = [mixture.get(None if r["queue"] == "null" else r["queue"][1:], 0.0) for r in own] + [0.0] if mixture else [totals.get(q, 0) for q in range(size)]
    schedule = Schedule([totals.get(q, 0) for q in range(size)], targets, window)
    out = StructType.fromDDL("doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, " + ("ids_crc32 long" if digest else "ids binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        for piece in pieces(batches, "ids"):
            col = {n: piece.column(n).to_numpy(zero_copy_only=False) for n in ("q", "first", "n")}
            ids, doc = as_bytes(piece.column("ids")), piece.column("doc_id")
            ids = [x if len(x) == 4 * n else np.frombuffer(x, "<u2").astype("<u4").tobytes() for x, n in zip(ids, col["n"].tolist(), strict=True)]
            row, start, place, size = schedule.place(col["q"].astype(np.int64), col["first"].astype(np.int64), col["n"].astype(np.int64))
            count = (place + size - 1) // window - place // window + 1
            cut = np.repeat(np.arange(len(row)), count)
            nth = np.arange(len(cut)) - np.repeat(np.cumsum(count) - count, count)
            a = np.maximum(place[cut], (place[cut] // window + nth) * window)
            b = np.minimum(place[cut] + size[cut], (place[cut] // window + nth + 1) * window)
            row, start, size = row[cut], (start - col["first"][row])[cut] + a - place[cut], b - a
            own = [ids[r][4 * s : 4 * (s + n)] for r, s, n in zip(row.tolist(), start.tolist(), size.tolist(), strict=True)]
            yield batch(schema, doc.take(pa.array(row)), start, size, col["n"][row], a // window, a % window, [zlib.crc32(x) for x in own] if digest else own)

    if bases.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    placed = tokens.join(bases, ["queue", "part"]).select("q", (F.col("base") + F.col("start")).alias("first"), "n", "doc_id", "ids")
    return placed.mapInArrow(lean(run), out)
