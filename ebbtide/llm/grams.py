"""Hashed byte n-grams of text columns. In UTF-8 they cover every script without decoding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ebbtide.llm.text import ODD, mix, raw_texts

Texts = list[str]
SEEDS = mix(np.arange(16, dtype=np.uint64))


def gram_index(data: np.ndarray, order: int, bits: int) -> np.ndarray:
    """For each place the hashed number (below 2**bits) of the `order` bytes that begin there."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    code = np.zeros(n, np.uint64)
    for k in range(order):
        code = (code << np.uint64(8)) | data[k : k + n].astype(np.uint64)
    return ((code + SEEDS[order]) * ODD >> np.uint64(64 - bits)).astype(np.int64)


def inside_rows(offsets: np.ndarray, order: int, n: int) -> np.ndarray:
    """Whether the n-gram at each place ends in the row in which it begins."""
    out = np.ones(n, bool)
    for k in range(1, order):
        cut = offsets[1:-1] - k
        out[cut[(cut >= 0) & (cut < n)]] = False
    return out


def owners(offsets: np.ndarray) -> np.ndarray:
    """The row of each byte."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def packed(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    return raw_texts(pa.array(texts, pa.large_string()))
