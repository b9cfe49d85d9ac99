"""Texts as arrays of letter codes, and their character n-grams as integers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np

#: Bits of a letter code. Code 0 is a run of anything but letters.
CODE_BITS = 12
#: Characters coded at once, if texts allow; bounds memory. A longer text is coded alone, whole.
CHUNK = 1 << 18


@cache
def _letter_codes() -> np.ndarray:
    """The code of each character of the basic plane: letters below 2048 stay themselves, others fold into 2048..4095."""
    cp = np.arange(0x10000)
    letters = np.fromiter((chr(c).isalpha() for c in cp), bool, len(cp))
    return np.where(letters, np.where(cp < 2048, cp, 2048 + (cp * 40503 >> 4) % 2048), 0).astype(np.uint16)


def coded(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, doc): lower-cased texts with a code 0 before and after each and for each run of non-letters; doc numbers
    the texts from 0. A text without letters is a single 0."""
    lowered = [f"\n{t.lower()}\n" if t else "\n\n" for t in texts]
    cp = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    doc = np.repeat(np.arange(len(lowered), dtype=np.int32), np.fromiter(map(len, lowered), np.int64, len(lowered)))
    table = _letter_codes()
    high = cp > 0xFFFF
    codes = table[np.where(high, 0, cp)]
    if high.any():
        codes[high] = [2048 + (int(c) * 40503 >> 4) % 2048 if chr(c).isalpha() else 0 for c in cp[high]]
    keep = codes != 0
    keep[1:] |= keep[:-1]
    if len(doc):
        keep[np.flatnonzero(np.diff(doc, prepend=-1))] = True
    return codes[keep], doc[keep]


def grams(codes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram, doc) of every n-gram that lies in one text, in order; a gram holds its codes in 12 bits each, first highest."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    gram = np.zeros(m, np.uint64)
    for k in range(n):
        gram = (gram << np.uint64(CODE_BITS)) | codes[k : k + m]
    whole = doc[:m] == doc[n - 1 :]
    return (gram, doc[:m]) if whole.all() else (gram[whole], doc[:m][whole])


def chunks(texts: list[str | None], most: int = CHUNK) -> Iterator[slice]:
    """Slices of ``texts`` of about ``most`` characters."""
    start = size = 0
    for n, t in enumerate(texts):
        size += len(t or "") + 2
        if size >= most:
            yield slice(start, n + 1)
            start, size = n + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and how often each occurs or the sums of their weights."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if weights is None:
        keys = np.sort(keys)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[starts], np.diff(np.r_[starts, len(keys)])
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(weights, starts)
