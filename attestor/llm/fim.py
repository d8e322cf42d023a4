"""Fill-in-middle: texts are cut at two units and put into another order, for a whole Arrow batch at once.

A unit is a run of A-Z and a-z or any other code point. Each byte of the batch's UTF-8 buffer is looked up in a table of
classes (letter, continuation, other); a unit starts where a byte is no continuation and not a letter after a letter of
the same document, so one mask over neighbouring bytes holds all unit starts. Sums of that mask, set back at each
document, count units; the cuts of all rows are found by one searchsorted over the sums. Prefix, middle and suffix are
one Arrow array over the same buffer with the cuts as offsets; nothing is copied until they are joined.

Cuts and forms follow from a SHA-256 of seed and id, so a row gives the same result in any partition and at any retry.
Null text is empty; empty texts and texts that hold a marker stay plain. A null id hashes as an empty one. Rows with equal
ids are cut by equal draws, each on its own text. Texts pass whole at any length (a row is never split); other columns
of the input are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from attestor.llm.common import batch, lean, pieces

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents: those from PLAIN on stay plain; of the others those under SPM give the suffix first.
PLAIN, SPM, SEED = 90, 20, "1"
OTHER, LETTER, INNER = 0, 1, 2
CLASS = np.zeros(256, np.uint8)
CLASS[65:91] = CLASS[97:123] = LETTER
CLASS[0x80:0xC0] = INNER


def draws(ids: list[int | None], seed: str) -> np.ndarray:
    """Four unsigned 32-bit draws for each id."""
    joined = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(joined, ">u4").reshape(-1, 4).astype(np.int64)


def cuts(raw: np.ndarray, bounds: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: units, byte places of both cuts, code points before the first cut and between them.

    raw holds the bytes of all texts, text k between bounds[k] and bounds[k + 1]; h the draws.
    """
    kind = CLASS[raw]
    letter = kind == LETTER
    starts = kind != INNER
    points = np.r_[0, np.cumsum(starts)]
    joined = letter[1:] & letter[:-1]
    inside = np.ones(len(raw) + 1, bool)
    inside[bounds] = False  # the first byte of a text starts a unit, whatever stood before
    starts[1:] &= ~(joined & inside[1:-1])
    units = np.cumsum(starts)
    base = np.r_[0, units][bounds]
    n = np.diff(base)
    draw = h[:, :2] % (n + 1)[:, None]
    first, second = draw.min(axis=1), draw.max(axis=1)
    at = np.searchsorted(units, np.stack([base[:-1] + first, base[:-1] + second]), "right")
    one, two = np.minimum(at, bounds[1:])  # after the last unit: the text's end, not the next unit
    return n, one, two, points[one] - points[bounds[:-1]], points[two] - points[one]


def _run(seed: str, plain: int, spm: int, out: StructType):
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            text = pc.fill_null(piece.column("text"), "").cast(pa.large_binary())
            text = pa.concat_arrays([text])  # offsets from 0
            h = draws(piece.column("doc_id").to_pylist(), seed)
            bounds = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = text.buffers()[2] or pa.py_buffer(b"")
            raw = np.frombuffer(data, np.uint8)[: bounds[-1]]
            n, one, two, before, between = cuts(raw, bounds, h)
            offsets = np.r_[np.stack([bounds[:-1], one, two], axis=1).ravel(), bounds[-1]]
            parts = pa.Array.from_buffers(pa.large_binary(), 3 * len(text), [None, pa.py_buffer(offsets), data])
            prefix, middle, suffix = (parts.take(pa.array(np.arange(k, 3 * len(text), 3))) for k in range(3))
            held = [pc.match_substring(text, m) for m in (PREFIX, SUFFIX, MIDDLE)]
            stay = (n == 0) | (h[:, 2] % 100 >= plain) | np.logical_or.reduce([x.to_numpy(zero_copy_only=False) for x in held])
            turned = h[:, 3] % 100 < spm
            p, s, m, none = (pa.scalar(x.encode(), pa.large_binary()) for x in (PREFIX, SUFFIX, MIDDLE, ""))
            psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none)
            sp = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none)
            output = pc.if_else(pa.array(stay), text, pc.if_else(pa.array(turned), sp, psm))
            form = np.where(stay, "plain", np.where(turned, "spm", "psm"))
            yield batch(schema, piece.column("doc_id"), n, pa.array(form.tolist()), pa.array(before, mask=stay), pa.array(between, mask=stay), output.cast(pa.large_string()).cast(schema.field("output").type))

    return run


def transform(docs: DataFrame, *, seed: str = SEED, plain: int = PLAIN, spm: int = SPM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars and middle_chars (null if plain), output."""
    if not (0 <= plain <= 100 and 0 <= spm <= 100):
        raise ValueError("plain and spm are parts of 100")
    out = StructType.fromDDL("doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(lean(_run(seed, plain, spm, out)), out)


def unfold(form: str | None, output: bytes) -> bytes:
    """The text of one output. No text of another form than plain holds a marker, so the first one found is the right one."""
    if form == "psm":
        head, _, rest = output[len(PREFIX) :].partition(SUFFIX.encode())
        tail, _, middle = rest.partition(MIDDLE.encode())
    elif form == "spm":
        tail, _, rest = output[len(SUFFIX) :].partition(PREFIX.encode())
        head, _, middle = rest.partition(MIDDLE.encode())
    else:
        return output
    return head + middle + tail


def restore(formed: DataFrame) -> DataFrame:
    """The rows of transform with the exact text, rebuilt from form and output, as restored."""
    out = StructType.fromDDL(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in formed.schema) + ", restored string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        for piece in pieces(batches, "output"):
            texts = [unfold(f, o) for f, o in zip(piece.column("form").to_pylist(), piece.column("output").cast(pa.binary()).to_pylist(), strict=True)]
            yield batch(schema, *piece.columns, pa.array(texts, pa.binary()).cast(schema.field("restored").type))

    return formed.mapInArrow(lean(run), out)
