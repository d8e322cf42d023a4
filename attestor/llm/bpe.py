"""Byte-level BPE: encode by a segment tree over byte positions, decode by a table.

Each distinct piece of text gets one row of a matrix that holds its segment tree: leaf p is
rank * width + p for the pair that starts at byte p, inner nodes the minimum of their children, so the
root is the leftmost pair of least rank. A merge rewrites the leaves of the merged pair and of its live left
neighbour and kills the right leaf, in log(width) steps each; all rows of a width advance together.

Null text is empty; empty text has no ids and decodes to nothing. Texts of any length pass whole;
repeated rows give repeated results; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from attestor.llm.common import as_bytes, batch, lean, pieces

NONE = np.int64(1) << np.int64(62)
_loaded: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class SegmentTreeBpe:
    """Encodes pieces by a rank table. cache_size bounds the pieces remembered by one Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_size: int = 250_000):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.base = len(self.tokens) + 1
        self.bytes_to_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.pattern = regex.compile(pattern)
        self.cache_size = cache_size
        self.words: dict[bytes, bytes] = {}
        self.first: dict[str, bytes | None] = {}
        self.rest: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}  # what is used again moves to the new cache

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        if not len(self.pair_keys):
            return np.full(len(left), -1, np.int64)
        keys = np.where((left < 0) | (right < 0), np.int64(-1), left * self.base + right)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], np.int64(-1))

    def _merge(self, words: list[bytes], width: int) -> list[bytes]:
        """All words have at most `width` bytes, a power of two."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        column = np.arange(width)
        inside = column < lengths[:, None]
        ids = np.full((n, width + 1), -1, np.int64)  # the last column is a wall
        ids[:, :width] = np.where(inside, self.bytes_to_id[raw], -1)
        following = np.tile(np.arange(1, width + 2), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        tree = np.full((n, 2 * width), NONE, np.int64)
        found = self._rank(ids[:, :width].ravel(), ids[:, 1:].ravel()).reshape(n, width)
        tree[:, width:] = np.where(found >= 0, found * width + column, NONE)
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            root = tree[live, 1]
            at, merged = root % width, root // width
            gone = following[live, at]
            beyond = np.minimum(following[live, gone], width)
            ids[live, at], ids[live, gone] = merged, -1
            following[live, at] = beyond
            before[live, beyond] = at
            self._point(tree, live, gone, np.full(len(live), NONE), width)
            rank = self._rank(merged, ids[live, beyond])
            self._point(tree, live, at, np.where(rank >= 0, rank * width + at, NONE), width)
            left = before[live, at]
            has = np.flatnonzero(left >= 0)
            if len(has):
                rows, left = live[has], left[has]
                rank = self._rank(ids[rows, left], merged[has])
                self._point(tree, rows, left, np.where(rank >= 0, rank * width + left, NONE), width)
            live = live[tree[live, 1] < NONE]
        kept = ids[:, :width] >= 0
        flat = ids[:, :width][kept].astype("<u4").tobytes()
        ends = (4 * np.cumsum(kept.sum(1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    @staticmethod
    def _point(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray, width: int) -> None:
        node = leaf + width
        tree[rows, node] = value
        node = node >> 1
        while node[0]:
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node = node >> 1

    def encode_words(self, words: list[bytes]) -> None:
        """Put the ids of each distinct new word, as little-endian 32-bit integers, into the cache."""
        by_width: dict[int, list[bytes]] = {}
        for word in words:
            whole = self.ranks.get(word)
            if whole is not None:
                self.words[word] = whole.to_bytes(4, "little")
            elif word:
                by_width.setdefault(1 << max(1, (len(word) - 1).bit_length()), []).append(word)
        for width, group in by_width.items():
            step = max(1, (1 << 18) // width)
            for k in range(0, len(group), step):
                self.words.update(zip(group[k : k + step], self._merge(group[k : k + step], width), strict=True))

    def _learn(self, chunks: set[str], cache: dict[str, bytes | None], lead: str) -> None:
        """A chunk lies between single spaces. It is split on its own if neither end is white space: no match can then reach over its ends."""
        split = {c: [p.encode() for p in self.pattern.findall(lead + c)] if c and not (c[0].isspace() or c[-1].isspace()) else None for c in chunks}
        self.encode_words(list({p for parts in split.values() if parts for p in parts} - self.words.keys()))
        for chunk, parts in split.items():
            cache[chunk] = None if parts is None else b"".join([self.words[p] for p in parts])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if max(len(self.words), len(self.rest), len(self.first)) > self.cache_size:
            self.older, self.words, self.first, self.rest = self.rest, {}, {}, {}
        cut = [t.split(" ") for t in texts]
        self._learn({c[0] for c in cut}.difference(self.first), self.first, "")
        need = set().union(*(c[1:] for c in cut)).difference(self.rest)
        again = need.intersection(self.older)
        self.rest.update(zip(again, map(self.older.__getitem__, again), strict=True))
        self._learn(need.difference(again), self.rest, " ")
        out = []
        for text, chunks in zip(texts, cut, strict=True):
            parts = [self.first[chunks[0]], *map(self.rest.__getitem__, chunks[1:])]
            if None in parts:
                found = [p.encode() for p in self.pattern.findall(text)]
                self.encode_words(list({*found} - self.words.keys()))
                parts = [self.words[p] for p in found]
            out.append(b"".join(parts))
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def load(path: str, pattern: str) -> SegmentTreeBpe:
    """One encoder for each Python worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = SegmentTreeBpe(read_ranks(path), pattern)
    return _loaded[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), decoded (bytes), one row for each row of docs."""
    out = StructType([StructField("doc_id", LongType()), StructField("ids", BinaryType()), StructField("decoded", BinaryType())])
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(lean(_run(path, pattern, out, lambda ids, raw: (ids, raw))), out)


def digest_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_documents with counts and SHA-256 digests in place of the bytes, so that they don't leave the worker."""
    out = StructType.fromDDL("doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(lean(_run(path, pattern, out, lambda ids, raw: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest()))), out)


def _run(path: str, pattern: str, out: StructType, result):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, schema = load(path, pattern), to_arrow_schema(out)
        for part in pieces(batches, "text"):
            found = bpe.encode([x.decode() for x in as_bytes(part.column("text"))])
            yield batch(schema, part.column("doc_id"), *zip(*(result(ids, bpe.decode(ids)) for ids in found), strict=True))

    return run
