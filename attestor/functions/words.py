"""The tokens of many texts at once, inside tasks: what text.tokens gives, from text.plain, as codes of a dictionary."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from attestor.functions import constants as K

_WORD = np.zeros(256, bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1)]] = True


def whole(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """As one array; parts are put together."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def trim() -> None:
    """Hand memory back: Python workers stay for the next tasks, idle ones too."""
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)


def content(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (and the last ends)."""
    bounds = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
    data = np.frombuffer(text.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.empty(0, np.uint8)
    return data, bounds - bounds[0]


def within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... of each group."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Texts from start to end, which may overlap."""
    size = end - start
    edges = np.r_[0, np.cumsum(size)]
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data[np.repeat(start, size) + within(size)]))


def tokens(plain: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """names, code, row: the distinct words of the texts, and of each token in order its name and its text. Stop words are out of code, not of names."""
    data, bounds = content(plain)
    first = bounds[:-1]
    word = _WORD[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    edge = first[(first > 0) & (first < len(data))]  # no token goes over the end of a text
    begins[edge] = word[edge]
    ends[edge - 1] = word[edge - 1]
    start = np.flatnonzero(begins)
    sizes = np.flatnonzero(ends) + 1 - start
    cut = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    found = pa.StringArray.from_buffers(len(start), pa.py_buffer(cut), pa.py_buffer(data[word])).dictionary_encode()
    names, code = found.dictionary, found.indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(plain)), np.diff(np.searchsorted(start, np.r_[first, len(data)])))
    held = ~pc.is_in(names, value_set=pa.array(K.STOPWORDS, pa.string())).to_numpy(zero_copy_only=False)[code] if len(names) else np.zeros(0, bool)
    return names, code[held], row[held]
