"""Hashed n-gram features of texts, a whole batch at a time."""

from __future__ import annotations

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
STEP = np.uint64(0x100000001B3)
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX
    return (x ^ (x >> np.uint64(27))) * ODD


class Tokens:
    """Words of a batch of texts: places in one buffer, the text of each, and a 64-bit hash of each word, with fold of A-Z in lower case."""

    def __init__(self, texts: list[bytes], fold: bool = True):
        self.n = len(texts)
        self.raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        low, inside = LOWER[self.raw] if fold else self.raw, ~SPACE[self.raw]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.text = np.searchsorted(self.bounds, self.starts, "right") - 1
        self.low = low
        self.words = self.hash(self.starts, self.ends)

    def hash(self, starts: np.ndarray, ends: np.ndarray, step: np.uint64 = STEP) -> np.ndarray:
        """Hashes of byte ranges, by sums of powers of step that are shifted to the same place."""
        power = np.cumprod(np.r_[np.uint64(1), np.full(len(self.low), step)], dtype=np.uint64)
        sums = np.r_[np.uint64(0), np.cumsum((self.low.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)]
        back = np.cumprod(np.r_[np.uint64(1), np.full(len(self.low), np.uint64(pow(int(step), -1, 1 << 64)))], dtype=np.uint64)
        return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * ODD)


def families(tokens: Tokens, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(text, feature) of words, word pairs and character trigrams; each family has 2**bits features of its own, the families after each other."""
    shift = np.uint64(64 - bits)
    words, text = tokens.words, tokens.text
    same = text[1:] == text[:-1]
    pairs = mix(words[1:] * ODD + words[:-1])[same]
    raw = tokens.raw.astype(np.uint64)
    grams = ((raw[:-2] << np.uint64(16)) | (raw[1:-1] << np.uint64(8)) | raw[2:]) * ODD if len(raw) > 2 else raw[:0]
    place = np.repeat(np.arange(tokens.n), np.diff(tokens.bounds))[: len(grams)]
    out = []
    for k, (own, h) in enumerate(((text, words), (text[1:][same], pairs), (place, grams))):
        out.append((own, (h >> shift).astype(np.int64) + (k << bits)))
    return out
