"""Cross-tokenizer alignment: minimal groups of tokens of two vocabularies over the same bytes, and corpus counts of linked ids.

Tokens of both sides are nodes, overlapping byte ranges edges. A union-find over that graph (least label by hooking, then
pointer jumping, for all texts of a batch together) gives connected components: they are exactly the minimal groups
between offsets where tokens of both sides end. Members of a component expand into links; ids that repeat inside a
component are counted first, so a component of few different ids stays small however long it is.

Work is by chunk: a text is cut at single spaces between other characters. Neither side has a token over such a cut (side A
splits there before it merges, side B has no piece with the mark of a space behind another character, which `Aligner`
checks of its model), so groups end there as well, and a chunk that occurs again is looked up. A text one of whose
chunks does not give its bytes back is encoded whole, and has no tokens if it then still differs.

Three steps over all texts: blocks of texts are aligned and written, with the distinct id pairs of each block and how many
of its documents hold them; pairs are counted over the corpus (partial sums by block first); counts return to their
blocks by an equi-join on the pair, and each block sums them over its documents. A block holds at most BLOCK bytes of text,
or one text.

Null and empty texts have no tokens: zeros, and an empty digest. Rows that repeat count as documents of their own; null
or repeated ids are no keys. Texts are never cut short; one text is the smallest unit. Other columns are not read;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from attestor.llm.common import Scratch, batch, lean, pieces

BLOCK = 2 << 20
#: Chunks that a worker remembers, and bytes of their groups' text; beyond either it starts anew.
REMEMBERED, HELD = 200_000, 32 << 20
GAP = re.compile(r"(?<=\S) (?=\S)")
#: Chunks that are encoded at once, with their spaces between them.
LINE = 64
#: A pair's code is a * SIDE + b; a document's place in its block stands above it.
SIDE, PAIRS = 1 << 20, 1 << 40
_loaded: dict = {}


def byte_letters() -> dict[str, int]:
    """Which byte each letter of a byte-level vocabulary stands for: printable ones for themselves, the rest in order from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def spans(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. for each count, after each other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least node of each node's component: union-find for all edges at once."""
    parent = np.arange(n)
    while len(left):
        a, b = parent[left], parent[right]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = parent[parent]
            if np.array_equal(further, parent):
                break
            parent = further
        apart = parent[left] != parent[right]
        left, right = left[apart], right[apart]
    return parent


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(keys) else values


class Chunks:
    """What is known of chunks: numbers of tokens of A and B, groups and links (-1 where tokens don't give the bytes); groups as text; pairs of each chunk in one array, and how often each is linked."""

    def __init__(self):
        self.numbers, self.counts, self.pairs, self.times = np.empty((0, 4), np.int64), *(np.empty(0, np.int64) for _ in range(3))
        self.groups: list[bytes] = []
        self.held = 0

    def add(self, numbers: np.ndarray, groups: list[bytes], counts: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> None:
        self.numbers = np.concatenate([self.numbers, numbers])
        self.counts, self.pairs, self.times = np.r_[self.counts, counts], np.r_[self.pairs, pairs], np.r_[self.times, times]
        self.groups += groups
        self.held += sum(map(len, groups))


class Aligner:
    """Aligns texts by a byte-level vocabulary (A) and a piece model (B)."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        named = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(map(letters.__getitem__, t)) if all(c in letters for c in t) else t.encode() for t in named]
        held = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(held)]
        if max(len(named), len(held)) > SIDE:
            raise ValueError(f"vocabularies of more than {SIDE} tokens are not supported")
        self.uncut = any(re.search("[^▁]▁", p) for p in held)  # then no cut is safe
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.names = [str(i).encode() + mark for i in range(max(len(named), len(held))) for mark in (b",", b"|", b";", b"")]
        self.known: dict[str, int] = {}
        self.chunks = Chunks()

    def _tokens(self, chunks: list[str], line: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """Ids and their number for each good chunk, on both sides; which chunks are good: the tokens give them back. `line` chunks are encoded at once."""
        raw = [b" " + c.encode() for c in chunks]
        lines, bytes_of = ([x[k : k + line] for k in range(0, len(chunks), line)] for x in (chunks, raw))
        texts, wanted = [" ".join(x) for x in lines], [b"".join(x) for x in bytes_of]
        ids = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], self.b.encode(texts, num_threads=1)
        whole = [all(b"".join(map(table.__getitem__, i)) == w for i, table in ((x, self.a_bytes), (y, self.b_bytes))) for x, y, w in zip(*ids, wanted, strict=True)]
        good = np.repeat(whole, [len(x) for x in lines])
        ends = np.cumsum([len(r) for r, g in zip(raw, good.tolist(), strict=True) if g], dtype=np.int64)
        sides = []
        for side, size in zip(ids, (self.a_size, self.b_size), strict=True):
            flat = np.fromiter(chain.from_iterable(x for x, w in zip(side, whole, strict=True) if w), np.int64)
            sides.append((flat, np.diff(np.searchsorted(np.cumsum(size[flat]), ends, "right"), prepend=0)))
        return sides, good

    def learn(self, chunks: list[str], line: int = 1) -> list[str]:
        """Take each text, as it stands, as a chunk. Gives the chunks in the order they now have: those of lines that fail come last, each encoded alone."""
        if not chunks:
            return []
        ((a, a_count), (b, b_count)), good = self._tokens(chunks, line)
        again = [c for c, g in zip(chunks, good.tolist(), strict=True) if not g] if line > 1 else []
        if again:
            chunks, good = [c for c, g in zip(chunks, good.tolist(), strict=True) if g], good[good]
        n, all_n = int(good.sum()), len(chunks)
        numbers, counts, groups = np.full((all_n, 4), -1, np.int64), np.zeros(all_n, np.int64), np.full(all_n, b"", object)
        # the bytes of all chunks stand after each other on both sides, so no token reaches over a chunk's end
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        first = np.searchsorted(b_end, a_end - self.a_size[a], "right")
        many = np.searchsorted(b_end - self.b_size[b], a_end, "left") - first
        root = components(len(a) + len(b), np.repeat(np.arange(len(a)), many), np.repeat(first, many) + spans(many) + len(a))
        heads, group = np.unique(root, return_inverse=True)  # every component's least node is of side A, so components are in byte order
        of_a, of_b = group[: len(a)], group[len(a) :]
        # groups as text: each id with the mark behind it, none at the chunk's end
        owner = np.r_[2 * of_a, 2 * of_b + 1]
        order = np.argsort(owner, kind="stable")
        token, owner = np.r_[a, b][order], owner[order]
        mark = np.where(np.diff(owner, append=-1) == 0, 0, 1 + owner % 2)
        cut = np.cumsum(a_count + b_count)
        mark[cut[a_count > 0] - 1] = 3
        text, cut = list(map(self.names.__getitem__, (4 * token + mark).tolist())), cut.tolist()
        groups[good] = np.fromiter((b"".join(text[p:q]) for p, q in zip([0, *cut], cut, strict=False)), object, n)
        # links, ids that repeat in a group counted first
        a_key, a_times = summed(of_a * SIDE + a, np.ones(len(a), np.int64))
        b_key, b_times = summed(of_b * SIDE + b, np.ones(len(b), np.int64))
        begin = np.searchsorted(b_key, (a_key // SIDE) * SIDE)
        many = np.searchsorted(b_key, (a_key // SIDE + 1) * SIDE) - begin
        i, j = np.repeat(np.arange(len(a_key)), many), np.repeat(begin, many) + spans(many)
        pair, times = (a_key[i] % SIDE) * SIDE + b_key[j] % SIDE, a_times[i] * b_times[j]
        of_group = np.repeat(np.arange(n), a_count)[heads]
        bounds = np.searchsorted(of_group[a_key[i] // SIDE], np.arange(n + 1))  # in order of chunks
        links = np.diff(np.r_[0, np.cumsum(times)][bounds])
        numbers[good] = np.stack([a_count, b_count, np.bincount(of_group, minlength=n), links], axis=1)
        counts[good] = np.diff(bounds)
        self.chunks.add(numbers, groups.tolist(), counts, pair, times)
        return chunks + self.learn(again)

    def align(self, texts: list[str]) -> Block:
        """Groups of each text, and the pairs of all."""
        if len(self.known) > REMEMBERED or self.chunks.held > HELD:
            self.known, self.chunks = {}, Chunks()
        parts = [([t] if self.uncut else GAP.split(t)) if t else [] for t in texts]
        flat = list(chain.from_iterable(parts))
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        fresh, at = set(flat).difference(self.known), len(self.chunks.groups)
        alone = [c for c in fresh if c[0].isspace() or c[-1].isspace()]  # these begin or end a text
        order = self.learn(list(fresh.difference(alone)), LINE) + self.learn(alone)
        self.known.update(zip(order, range(at, at + len(order)), strict=True))
        one = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        doc = np.repeat(np.arange(len(texts)), size)
        bad = np.unique(doc[self.chunks.numbers[one, 0] < 0])
        if len(bad):  # those encoded whole
            at = len(self.chunks.groups) + np.arange(len(bad))
            self.learn([texts[k] for k in bad.tolist()])
            good = self.chunks.numbers[at, 0] >= 0
            stay = ~np.isin(doc, bad)
            doc, one = np.r_[doc[stay], bad[good]], np.r_[one[stay], at[good]]
            order = np.argsort(doc, kind="stable")
            doc, one = doc[order], one[order]
        return Block(len(texts), doc, one, self.chunks)


class Block:
    """The documents of a block: numbers and groups of each, the distinct pairs of the block, links of each document by pair."""

    def __init__(self, n: int, doc: np.ndarray, one: np.ndarray, chunks: Chunks):
        bounds = np.searchsorted(doc, np.arange(n + 1))
        self.numbers = np.diff(np.r_[np.zeros((1, 4), np.int64), np.cumsum(chunks.numbers[one], axis=0)][bounds], axis=0)
        groups, cuts = list(map(chunks.groups.__getitem__, one.tolist())), bounds.tolist()
        self.groups = [b";".join(groups[s:e]) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
        key, times = summed(doc << 32 | one, np.ones(len(one), np.int64))
        which = key & 0xFFFFFFFF
        many = chunks.counts[which]
        at = np.repeat((np.cumsum(chunks.counts) - chunks.counts)[which], many) + spans(many)
        row, links = np.repeat(key >> 32, many), np.repeat(times, many) * chunks.times[at]
        self.pairs, place = np.unique(chunks.pairs[at], return_inverse=True)
        key, self.times = summed(row << 32 | place, links)
        self.place = key & 0xFFFFFFFF
        self.bounds = np.searchsorted(key >> 32, np.arange(n + 1))
        self.held = np.bincount(self.place, minlength=len(self.pairs))  # documents of the block that hold each pair


def load(a_path: str, b_path: str) -> Aligner:
    """One aligner for each Python worker."""
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Aligner(a_path, b_path)
    return _loaded[a_path, b_path]


ROWS = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, places binary, times binary, pairs array<long>, held array<long>"


class Alignment:
    """Alignment of all texts, written once; its parts are read from there.

    groups_as: what to keep of the groups' text, its SHA-256 (`digest`) or all of it (`text`).
    """

    def __init__(self, spark: SparkSession, docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", groups_as: str = "digest"):
        if groups_as not in ("digest", "text"):
            raise ValueError("groups_as is digest or text")
        out = StructType.fromDDL(ROWS)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            aligner, schema, task = load(a_path, b_path), to_arrow_schema(out), TaskContext.get().partitionId()
            for k, piece in enumerate(pieces(batches, "text", BLOCK)):
                texts = [t or "" for t in piece.column("text").to_pylist()]
                found, n, block = aligner.align(texts), len(texts), task << 32 | k
                shown = [("" if not g else hashlib.sha256(g).hexdigest()) if groups_as == "digest" else g.decode() for g in found.groups]
                places, times = found.place.astype("<u4").tobytes(), found.times.astype("<u8").tobytes()
                cuts = found.bounds.tolist()
                inner = [(places[4 * s : 4 * e], times[8 * s : 8 * e]) if e > s else (None, None) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
                yield batch(schema, [block] * n, piece.column("doc_id"), *found.numbers.T, shown, *zip(*inner, strict=True), [None] * n, [None] * n)
                if len(found.pairs):
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int64())).cast(schema.field(f).type) for x, f in ((found.pairs, "pairs"), (found.held, "held"))]
                    yield batch(schema, [block], *[pa.nulls(1, f.type) for f in list(schema)[1:9]], *lists)

        self.scratch = Scratch(spark, "align")
        plain = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
        self.rows = self.scratch.write(plain.mapInArrow(lean(run), out), "aligned")

    def documents(self) -> DataFrame:
        """doc_id, n_a, n_b, n_groups, n_links, groups: one row for each document."""
        return self.rows.where("pairs is null").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")

    def block_pairs(self) -> DataFrame:
        """block, pair, held: the distinct pairs of each block and how many of its documents hold them linked."""
        one = self.rows.where("pairs is not null").select("block", F.explode(F.arrays_zip("pairs", "held")).alias("x"))
        return one.select("block", F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))

    def pair_counts(self) -> DataFrame:
        """a, b, pair, docs (documents that hold a linked to b), best (no b of this a is held by more)."""
        counted = self.block_pairs().groupBy("pair").agg(F.sum("held").alias("docs"))
        side = F.expr(f"pair div {SIDE}")
        most = F.expr("max(docs) over (partition by a)")  # at most as many rows for an a as side B has tokens
        return counted.select(side.alias("a"), F.expr(f"pair % {SIDE}").alias("b"), "pair", "docs").select("*", (F.col("docs") == most).alias("best"))

    def scored(self) -> DataFrame:
        """documents() with n_best (links whose count is the highest of their a) and count_sum (counts over links)."""
        counts = self.pair_counts().select("pair", "docs", "best")
        back = self.block_pairs().select("block", "pair").join(counts, "pair").select(F.col("block").alias("id"), "pair", "docs", "best")
        left = self.rows.where("places is not null").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "places", "times")
        out = StructType.fromDDL("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")

        def total(docs: pa.Table, pairs: pa.Table) -> pa.Table:
            schema = to_arrow_schema(out)
            if not docs.num_rows:
                return schema.empty_table()
            order = np.argsort(pairs.column("pair").to_numpy())  # places count the block's pairs in order
            count, best = pairs.column("docs").to_numpy()[order], pairs.column("best").to_numpy(zero_copy_only=False)[order]
            place, times = (np.frombuffer(b"".join(docs.column(c).to_pylist()), t).astype(np.int64) for c, t in (("places", "<u4"), ("times", "<u8")))
            sizes = np.fromiter((len(x) // 4 for x in docs.column("places").to_pylist()), np.int64, docs.num_rows)
            first = np.cumsum(sizes) - sizes
            sums = [np.add.reduceat(times * v[place], first) for v in (best.astype(np.int64), count)]
            return pa.table([*(docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), *sums, docs.column("groups")], schema=schema)

        linked = left.groupBy("block").cogroup(back.groupBy("id")).applyInArrow(total, out)
        none = self.rows.where("places is null and pairs is null").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"), "groups")
        return linked.union(none)
