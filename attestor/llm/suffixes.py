"""Substring deduplication by anchored suffix arrays, sorted deep-shallow.

A string is WINDOW consecutive bytes of one text. Bytes under a string that also starts anywhere else are removed. All
strings of a corpus can't be sorted in one place, so suffixes are sorted by shards between which no equal strings fall:

1. Anchors. Of each string's grams of GRAM bytes the one of least hash is its anchor, the leftmost of equal ones. Equal
   strings have equal anchors at equal distance, so a string can recur only over an anchor that does. Anchors are counted
   over the corpus; a bitmap of those found twice (at most MAX_BITS; a fuller one lets more through, never fewer) goes to all tasks.
2. Regions. Neighbouring strings over one anchor are a region: its bytes left of the anchor, and from the anchor on. A task
   sends the bytes of equal regions once, then only their places. Regions meet by anchor and stream, sorted by it,
   through shards of whole anchors.
3. Suffix arrays. A shard has two: of the suffixes from the anchors on, and of the reversed bytes before them. Both are
   sorted by multikey quicksort, 8 bytes a character, to SHALLOW bytes; suffixes still tied there go through a blind trie for
   each group, which branches on single bytes and compares one whole string an insertion. Common prefixes of neighbours in both
   arrays say which regions share a string: those that have d bytes before the anchor and WINDOW - d from it on in common.
   Only distances where some prefix ends are looked at; between them nothing changes.
4. Texts take the ranges found, by a digest of the text, and are cut.

Bytes decide, not hashes: two texts are taken for the same by 128 bits of SHA-256, regions by 128 bits of BLAKE2, and all
else is compared. An anchor chosen at more than HOT places would be a shard without a bound; its regions are first reduced
to distinct ones and their strings then counted by 128 bits of hash, one row for each string of a distinct region, with
partial sums (`hot_ranges`). The path of a string depends on its anchor alone, so equal strings take the same one.

Null text is empty; texts shorter than a string stay; rows that repeat lose all their strings; null or repeated ids
are no keys. A long text is worked on in stretches of BLOCK bytes; it is one row only when it is cut. Other columns stay as
they are; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from attestor.llm.common import Scratch, as_bytes, batch, bitmap, lean, marked, pieces

WINDOW, GRAM, SHALLOW, BLOCK = 400, 48, 64, 2 << 20
MIN_BITS, MAX_BITS, BITS_FOR_EACH = 1 << 16, 1 << 30, 32
#: Places of an anchor above which its strings are counted by hash; distinct regions that a task remembers to have sent.
HOT, SENT = 20_000, 500_000
#: Regions of a shard, and rows that a step of the comparison holds.
SHARD, ROWS = 20_000, 1 << 20
ONE, TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
LOW = np.uint64(0xFFFFFFFF)
REGIONS = "anchor long, region_id binary, before int, region binary, n long, places binary"
PLACE = 20  # bytes of one place: digest of the text, offset


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * TWO
    return x ^ (x >> np.uint64(29))


def spans(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. for each count, after each other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def gram_hashes(raw: np.ndarray, length: int, factor: np.uint64 = ONE) -> np.ndarray:
    """Hash of each `length` neighbouring bytes (8 or more): words of 8 bytes, joined by doubling."""
    padded = np.r_[raw, np.zeros(8, np.uint8)]
    word = mixed(np.ndarray(len(raw), "<u8", padded.data, strides=(1,)) ^ factor)
    known, at = {8: word}, 8
    while 2 * at <= length:
        half = known[at]
        known[2 * at] = mixed(half[: max(0, len(half) - at)] * factor + half[at:])
        at *= 2
    out, size, n = known[at], at, max(0, len(raw) - length + 1)
    while size < length:
        part = max([k for k in known if k <= length - size], default=8)
        place = min(size, length - part)  # a last word may overlap
        out = mixed(out[:n] * factor + known[part][place : place + n])
        size = place + part
    return out[:n]


class Stretches:
    """Regions of the strings of some texts: long texts are cut into stretches that overlap by a string less a byte."""

    def __init__(self, texts: list[bytes], window: int, gram: int):
        parts = [(k, s, t[s : s + BLOCK + window - 1]) for k, t in enumerate(texts) for s in range(0, len(t) - window + 1, BLOCK)]
        self.window, self.text = window, [k for k, _, _ in parts]
        size = np.array([len(p) for _, _, p in parts], np.int64)
        self.raw = b"".join(p for _, _, p in parts)
        begin = np.cumsum(size) - size
        self.shift = np.array([s for _, s, _ in parts], np.int64) - begin  # from a place here to one in the text
        hashes = gram_hashes(np.frombuffer(self.raw, np.uint8), gram)
        best = (hashes & ~LOW) | np.arange(len(hashes), dtype=np.uint64)
        span, wide = 1, window - gram + 1
        while span < wide and len(best):
            step = min(span, wide - span)
            best, span = np.minimum(best[:-step], best[step:]), span + step
        starts = np.repeat(begin, size - window + 1) + spans(size - window + 1)
        anchor = (best[starts] & LOW).astype(np.int64) if len(starts) else starts
        head = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)]) if len(starts) else starts
        self.first, self.last = starts[head], starts[np.r_[head[1:], len(starts)] - 1] if len(starts) else starts
        self.place = anchor[head]
        self.anchors = hashes[self.place]
        self.part = np.searchsorted(begin, self.first, "right") - 1


def anchor_counts(docs: DataFrame, text_col: str, window: int, gram: int) -> DataFrame:
    """anchor, n: at how many places each gram is an anchor (counted by hash; a place at the edge of a stretch may count twice)."""
    out = StructType.fromDDL("anchors array<long>, counts array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        for piece in pieces(batches, "text", BLOCK):
            found, n = np.unique(Stretches(as_bytes(piece.column("text")), window, gram).anchors.view(np.int64), return_counts=True)
            yield batch(schema, [found], [n])

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), out)
    return found.select(F.explode(F.arrays_zip("anchors", "counts")).alias("x")).groupBy(F.col("x.anchors").alias("anchor")).agg(F.sum("x.counts").alias("n")).where("n > 1")


def regions(docs: DataFrame, text_col: str, wanted, window: int, gram: int) -> DataFrame:
    """Distinct regions of each batch over wanted anchors, with their places. wanted: hashes to a mask."""
    out = StructType.fromDDL(REGIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, sent = to_arrow_schema(out), set()
        for piece in pieces(batches, "text", BLOCK):
            own: dict[bytes, int] = {}  # equal texts are looked at once
            for t in as_bytes(piece.column("text")):
                if len(t) >= window:
                    own[t] = own.get(t, 0) + 1
            texts = list(own)
            digests, copies = [hashlib.sha256(t).digest()[:16] for t in texts], list(own.values())
            s = Stretches(texts, window, gram)
            at = np.flatnonzero(wanted(s.anchors))
            rows: dict[bytes, list] = {}
            text = np.array(s.text, np.int64)[s.part[at]]
            offset = (s.first[at] + s.shift[s.part[at]]).tolist()
            for anchor, a, z, p, k, o in zip(s.anchors[at].view(np.int64).tolist(), s.first[at].tolist(), s.last[at].tolist(), s.place[at].tolist(), text.tolist(), offset, strict=True):
                region = s.raw[a : z + window]
                key = hashlib.blake2b(region, digest_size=16, person=(p - a).to_bytes(4, "little")).digest()
                row = rows.get(key)
                if row is None:
                    rows[key] = [anchor, p - a, None if key in sent else region, copies[k], [digests[k] + o.to_bytes(4)]]
                else:
                    row[3] += copies[k]
                    row[4].append(digests[k] + o.to_bytes(4))
            sent = (sent if len(sent) < SENT else set()) | rows.keys()
            if rows:
                anchor, before, region, n, places = zip(*rows.values(), strict=True)
                yield batch(schema, anchor, list(rows), before, region, n, [b"".join(x) for x in places])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), out)


def multikey_quicksort(heads: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by bucket, then by the words of heads (one row for each string), and where groups that all words leave tied begin.

    All runs are partitioned at once, each around the median of three of its words; what equals the pivot goes on with the next word.
    """
    n, words = heads.shape
    order = np.argsort(bucket, kind="stable")
    begins = np.r_[True, bucket[order][1:] != bucket[order][:-1]] if n else np.empty(0, bool)
    depth = np.zeros(n, np.int64)
    while True:
        first = np.flatnonzero(begins)
        size = np.diff(np.r_[first, n])
        open_ = (size > 1) & (depth[first] < words)
        first, size = first[open_], size[open_]
        if not len(first):
            return order, begins
        at = np.repeat(first, size) + spans(size)
        word = heads[order[at], depth[at]]
        ends = np.cumsum(size)
        three = np.sort(np.stack([word[ends - size], word[ends - size + size // 2], word[ends - 1]]), axis=0)
        pivot = np.repeat(three[1], size)
        side = np.repeat(3 * np.arange(len(size)), size) + 1 + (word > pivot) - (word < pivot)
        turn = np.argsort(side, kind="stable")
        order[at], side = order[at][turn], side[turn]
        begins[at[1:]] |= side[1:] != side[:-1]
        depth[at] += side % 3 == 1


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    return n if a == b else n - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8


class BlindTrie:
    """Sorts strings by insertion: nodes know the depth they branch at and one byte for each child, not the bytes between."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | int = 0  # a leaf is the number of a string, a node [depth, {byte: child}]
        self.equal: dict[int, list[int]] = {0: [0]}
        for k in range(1, len(strings)):
            self._insert(k)

    def _insert(self, k: int) -> None:
        s = self.strings[k]
        path, node = [], self.root
        while not isinstance(node, int):
            path.append(node)
            depth, children = node
            child = children.get(s[depth] if depth < len(s) else -1)
            node = next(iter(children.values())) if child is None else child
        other = self.strings[node]
        shared = common(s, other)
        if shared == len(s) == len(other):
            self.equal[node].append(k)
            return
        self.equal[k] = [k]
        above = None
        for step in path:
            if step[0] >= shared:
                break
            above = step
        byte = s[shared] if shared < len(s) else -1
        below = self.root if above is None else above[1][s[above[0]] if above[0] < len(s) else -1]
        if not isinstance(below, int) and below[0] == shared:
            below[1][byte] = k
            return
        fork = [shared, {byte: k, (other[shared] if shared < len(other) else -1): below}]
        if above is None:
            self.root = fork
        else:
            above[1][s[above[0]] if above[0] < len(s) else -1] = fork

    def ordered(self) -> tuple[list[int], list[int]]:
        """Strings in order, and the common prefix of each with the one before (0 for the first)."""
        order, shared = [], []
        stack: list[tuple[list | int, int]] = [(self.root, 0)]
        while stack:
            node, prefix = stack.pop()
            if isinstance(node, int):
                same = self.equal[node]
                order += same
                shared += [prefix] + [len(self.strings[node])] * (len(same) - 1)
            else:
                depth, children = node
                keys = sorted(children)
                stack += [(children[b], depth) for b in keys[:0:-1]] + [(children[keys[0]], prefix)]
        return order, shared


def deep_shallow(strings: list[bytes], bucket: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings by bucket and bytes, and the common prefix of each with the one before it in its bucket (0 at a bucket's first)."""
    n, shallow = len(strings), shallow // 8 * 8
    raw = np.frombuffer(b"".join([s[:shallow].ljust(shallow, b"\0") for s in strings]), np.uint8).reshape(n, shallow)
    order, begins = multikey_quicksort(raw.view(">u8").astype(np.uint64), bucket)
    size = np.array([len(s) for s in strings], np.int64)
    shared = np.zeros(n, np.int64)
    first = np.flatnonzero(begins)
    many = np.diff(np.r_[first, n])
    for a, m in zip(first[many > 1].tolist(), many[many > 1].tolist(), strict=True):
        own = order[a : a + m]
        inner, prefix = BlindTrie([strings[k] for k in own.tolist()]).ordered()
        order[a : a + m] = own[inner]
        shared[a + 1 : a + m] = prefix[1:]
    pair = np.flatnonzero(begins[1:] & (bucket[order][1:] == bucket[order][:-1])) + 1
    for k in range(0, len(pair), ROWS // shallow):
        some = pair[k : k + ROWS // shallow]
        differ = raw[order[some]] != raw[order[some - 1]]
        least = np.minimum(size[order[some]], size[order[some - 1]])
        shared[some] = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), shallow), least)
    return order, shared


def shared_strings(bucket: np.ndarray, before: list[bytes], after: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(region, from, to): strings that begin `from` to `to` bytes before the anchor, which another region of the bucket has too.

    bucket is in order; before holds the reversed bytes left of the anchor, after those from it on.
    """
    left, l_shared = deep_shallow(before, bucket)
    right, r_shared = deep_shallow(after, bucket)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    size = np.diff(np.r_[first, len(bucket)])
    group = np.repeat(np.arange(len(first)), size)
    inner = np.ones(len(bucket), bool)
    inner[first] = False
    width = window + 2
    steps = np.unique(np.r_[np.arange(len(first)) * width, group[inner] * width + l_shared[inner] + 1, group[inner] * width + np.maximum(0, window - r_shared[inner])])
    of, d = steps // width, steps % width
    to = np.where(np.r_[of[1:] == of[:-1], False], np.r_[d[1:], 0] - 1, window)
    keep = (d <= window) & (size[of] > 1)
    of, d, to = of[keep], d[keep], to[keep]
    rows = np.cumsum(size[of])
    found = []
    a = 0
    while a < len(of):
        b = max(a + 1, int(np.searchsorted(rows, (rows[a - 1] if a else 0) + ROWS, "right")))
        m, base, step = size[of[a:b]], first[of[a:b]], d[a:b]
        inside = spans(m)
        at, depth, slot = np.repeat(base, m) + inside, np.repeat(step, m), np.repeat(np.cumsum(m) - m - base, m)
        one, two = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        one[slot + left[at]] = np.cumsum((inside == 0) | (l_shared[at] < depth))
        two[slot + right[at]] = np.cumsum((inside == 0) | (r_shared[at] < window - depth))
        key = one * (len(at) + 1) + two
        turn = np.argsort(key)
        same = key[turn][1:] == key[turn][:-1]
        again = np.zeros(len(at), bool)
        again[turn[1:][same]] = again[turn[:-1][same]] = True
        found.append((at[again], depth[again], np.repeat(to[a:b], m)[again]))
        a = b
    if not found:
        return (np.empty(0, np.int64),) * 3
    region, d, to = (np.concatenate(x) for x in zip(*found, strict=True))
    turn = np.lexsort((d, region))
    region, d, to = region[turn], d[turn], to[turn]
    head = np.r_[True, (region[1:] != region[:-1]) | (d[1:] != to[:-1] + 1)] if len(region) else np.empty(0, bool)
    return region[head], d[head], to[np.r_[head[1:], True]] if len(region) else to


def shard_ranges(rows: list[tuple], window: int) -> list[tuple[bytes, int, int]]:
    """(digest, begin, end) of bytes to remove, from the rows (of REGIONS, in order of anchors) of whole anchors."""
    known: dict[tuple[int, bytes], int] = {}
    anchor, before, region, n, places = [], [], [], [], []
    for a, key, left, body, copies, where in rows:
        k = known.setdefault((a, key), len(known))
        if k == len(anchor):
            anchor.append(a), before.append(left), region.append(body), n.append(0), places.append([])
        region[k] = region[k] if body is None else body
        n[k] += copies
        places[k].append(where)
    bucket = np.array(anchor, np.int64)
    several = np.flatnonzero(np.r_[False, bucket[1:] == bucket[:-1]] | np.r_[bucket[1:] == bucket[:-1], False])
    some = several.tolist()
    which, d, to = shared_strings(bucket[several], [region[k][: before[k]][::-1] for k in some], [region[k][before[k] :] for k in some], window) if some else ((), (), ())
    ranges: dict[int, list[tuple[int, int]]] = {k: [(0, len(region[k]))] for k, copies in enumerate(n) if copies > 1}
    for k, near, far in zip(several[which].tolist() if some else (), d if not some else d.tolist(), to if not some else to.tolist(), strict=True):
        if n[k] < 2:
            ranges.setdefault(k, []).append((before[k] - far, before[k] - near + window))
    out = []
    for k, own in ranges.items():
        for place in {w[i : i + PLACE] for w in places[k] for i in range(0, len(w), PLACE)}:
            offset = int.from_bytes(place[16:])
            out += [(place[:16], offset + a, offset + b) for a, b in own]
    return out


RANGES = "digest binary, begin long, end long"


def sorted_ranges(found: DataFrame, window: int) -> DataFrame:
    """Ranges to remove, by the suffix arrays of shards of anchors."""
    out = StructType.fromDDL(RANGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held = to_arrow_schema(out), []

        def rows(shard: list[tuple]) -> Iterator[pa.RecordBatch]:
            if ranges := shard_ranges(shard, window):
                yield batch(schema, *zip(*ranges, strict=True))

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(held) >= SHARD and row[0] != held[-1][0]:
                    yield from rows(held)
                    held = []
                held.append(row)
        if held:
            yield from rows(held)

    return found.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lean(run), out)


def hot_ranges(found: DataFrame, window: int) -> DataFrame:
    """Ranges to remove under anchors of very many places: strings of distinct regions, counted by 128 bits of hash."""
    out = StructType.fromDDL("region_id binary, n long, before array<int>, one array<long>, two array<long>")
    ranged = StructType.fromDDL(RANGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        for piece in pieces(batches, "region", 1 << 16):
            lists = []
            for left, region in zip(piece.column("before").to_pylist(), as_bytes(piece.column("region")), strict=True):
                raw = np.frombuffer(region, np.uint8)
                lists.append((left - np.arange(len(raw) - window + 1), gram_hashes(raw, window).view(np.int64), gram_hashes(raw, window, TWO).view(np.int64)))
            yield batch(schema, piece.column("region_id"), piece.column("n"), *zip(*lists, strict=True))

    distinct = found.groupBy("region_id").agg(F.sum("n").alias("n"), F.first("before").alias("before"), F.first("region", ignorenulls=True).alias("region"))
    strings = distinct.select("region_id", "n", "before", "region").mapInArrow(lean(run), out)
    strings = strings.select("region_id", "n", F.explode(F.arrays_zip("before", "one", "two")).alias("x")).select("region_id", "n", "x.*")
    again = strings.groupBy("one", "two").agg(F.sum("n").alias("times")).where("times > 1").select("one", "two")
    # All strings of a region lie over its anchor, so those found again are one range: from the farthest to the end of the nearest.
    near = strings.join(again, ["one", "two"]).groupBy("region_id").agg(F.max("before").alias("far"), F.min("before").alias("near"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(ranged)
        for piece in pieces(batches, "places", BLOCK):
            own = as_bytes(piece.column("places"))
            place, n = np.frombuffer(b"".join(own), np.uint8).reshape(-1, PLACE), [len(x) // PLACE for x in own]
            digest = pa.Array.from_buffers(pa.binary(16), len(place), [None, pa.py_buffer(np.ascontiguousarray(place[:, :16]))]).cast(pa.binary())
            before, far, near = (np.repeat(piece.column(c).to_numpy(), n) for c in ("before", "far", "near"))
            at = np.ascontiguousarray(place[:, 16:]).view(">u4").ravel().astype(np.int64) + before
            yield batch(schema, digest, at - far, at - near + window)

    # Places stay packed until they have met: a region has one row for each batch, however many texts hold it.
    return found.select("region_id", "before", "places").join(near, "region_id").select("before", "far", "near", "places").mapInArrow(lean(placed), ranged)


def merged(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Runs under ranges, ranges that touch joined."""
    if not len(begin):
        return []
    turn = np.argsort(begin, kind="stable")
    begin, reach = begin[turn], np.maximum.accumulate(end[turn])
    head = np.flatnonzero(np.r_[True, begin[1:] > reach[:-1]])
    return list(zip(begin[head].tolist(), reach[np.r_[head[1:] - 1, len(begin) - 1]].tolist(), strict=True))


def repeated_ranges(spark: SparkSession, docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, text_col: str = "text") -> DataFrame:
    """digest (of a text: the first 16 bytes of its SHA-256), ranges: array of (begin, end) in bytes, which may overlap."""
    if not window >= gram >= 8:
        raise ValueError("a gram has 8 bytes at least, a string no fewer than a gram")
    scratch = Scratch(spark, "suffixes")
    counts = scratch.write(anchor_counts(docs, text_col, window, gram), "anchors")
    seen = counts.agg(F.count("*").alias("all"), F.count_if(F.col("n") > HOT).alias("hot")).first()
    size = lambda n: min(MAX_BITS, max(MIN_BITS, 1 << (BITS_FOR_EACH * n).bit_length()))
    marks = spark.sparkContext.broadcast(bitmap(counts, "anchor", size(seen["all"])))
    hot = spark.sparkContext.broadcast(bitmap(counts.where(F.col("n") > HOT), "anchor", size(seen["hot"])))
    scratch.drop("anchors")

    def usual(hashes: np.ndarray) -> np.ndarray:
        return marked(np.frombuffer(marks.value, np.uint8), hashes) & ~often(hashes)

    def often(hashes: np.ndarray) -> np.ndarray:
        return marked(np.frombuffer(hot.value, np.uint8), hashes)

    found = sorted_ranges(regions(docs, text_col, usual, window, gram), window)
    if seen["hot"]:
        found = found.union(hot_ranges(scratch.write(regions(docs, text_col, often, window, gram), "hot"), window))
    return found.groupBy("digest").agg(F.collect_set(F.struct("begin", "end")).alias("ranges"))  # each batch with a copy sends its ranges


def remove_repeats(spark: SparkSession, docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, text_col: str = "text", digest_id: str | None = None) -> DataFrame:
    """The rows of docs with repeated strings cut out of the text (a character of which only some bytes stay goes too).

    With digest_id: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that stay) instead.
    """
    ranges = repeated_ranges(spark, docs, window=window, gram=gram, text_col=text_col)
    digest_out = StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    result = digest_out if digest_id else docs.schema
    source = docs.select(F.col(digest_id).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) if digest_id else docs
    at = source.columns.index("text" if digest_id else text_col)
    plain = source.toDF(*[f"c{k}" for k in range(len(source.columns))])
    key = F.substring(F.unhex(F.sha2(F.coalesce(F.col(f"c{at}").cast("string"), F.lit("")), 256)), 1, 16)
    joined = plain.withColumn("digest", key).join(ranges, "digest", "left").drop("digest")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(result)
        for piece in pieces(batches, f"c{at}"):
            lists = piece.column("ranges")
            begin, end = (lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(2))
            bounds = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))].tolist()
            texts, kept, spans_of = as_bytes(piece.column(f"c{at}")), [], []
            for text, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
                runs = merged(begin[a:b], end[a:b]) if b > a else []
                edges = [0, *(x for run in runs for x in run), len(text)]
                kept.append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)) if runs else text)
                spans_of.append(len(runs))
            if digest_id:
                yield batch(schema, piece.column("c0"), [len(t) for t in texts], [len(t) - len(k) for t, k in zip(texts, kept, strict=True)], spans_of, [hashlib.sha256(k).hexdigest() for k in kept])
            else:
                columns = [piece.column(f"c{k}") for k in range(len(schema))]
                old = columns[at].to_pylist()
                columns[at] = pa.array([k.decode(errors="ignore") if n else o for k, n, o in zip(kept, spans_of, old, strict=True)], schema.field(at).type)
                yield batch(schema, *columns)

    return joined.mapInArrow(lean(cut), result)
