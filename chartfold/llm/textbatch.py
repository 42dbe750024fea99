"""Columns of text as flat numpy arrays, for use inside ``mapInArrow``.

A batch is cut into slices of bounded size; a slice's texts lie one after the
other in one byte array, so words and their hashes come from whole-array
operations instead of a loop over rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
HASH_BYTES = 1 << 20

#: white space of the word pattern [^\x20\x09-\x0D]+
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2 ** 64
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _STEP), np.full(n, _BACK)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def fresh(name: str, taken: Sequence[str]) -> str:
    """A column name like ``name`` that is not ``taken``, in any case of letters."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column; ids and the like are left alone."""
    return batch.column(batch.schema.get_field_index(name))


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about ``size`` bytes of text, one text at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = _offsets(column(batch, text))
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield batch.slice(at, upto - at)
            at = upto


def _offsets(array: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    return np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)


class Texts:
    """``data``: all bytes; ``at``: where each text begins, and the end.  Null is empty."""

    def __init__(self, array: pa.Array):
        if array.null_count:
            array = array.fill_null("")
        offsets = _offsets(array)
        buffer = array.buffers()[2]
        whole = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
        self.data = whole[offsets[0] : offsets[-1]]
        self.at = offsets - offsets[0]

    def __len__(self) -> int:
        return len(self.at) - 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many of ``flags``, one for each byte, are set in each text."""
        return spans_total(flags, self.at)

    @property
    def n_bytes(self) -> np.ndarray:
        return np.diff(self.at)


def spans_total(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` from each position of ``at`` to the next."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def places(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of spans that begin at ``begin``, one span after the other."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(begin - (end - size), size)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+``: where each begins and ends, and the first word of each text.

    ``space`` names other bytes that part words.
    """

    def __init__(self, texts: Texts, space: np.ndarray = SPACE):
        inside = ~space[texts.data]
        n = len(inside)
        edge = np.zeros(n + 1, bool)
        edge[texts.at] = True
        before = np.concatenate([[False], inside])
        self.begin = np.flatnonzero(inside & (~before[:-1] | edge[:-1]))
        after = np.concatenate([inside[1:], [False]])
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1 if n else self.begin
        self.first = np.searchsorted(self.begin, texts.at)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes (or code points) of each span (in order, not overlapping).

    Spans are hashed by prefix sums of byte values times powers of an odd
    number, which one more power brings back to the start of its span.
    """
    out = np.empty(len(begin), np.uint64)
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(end, begin[i] + HASH_BYTES, "right")))
        lo, hi = begin[i], end[j - 1]
        size = max(HASH_BYTES, 1 << int(hi - lo).bit_length()) if hi - lo > HASH_BYTES else HASH_BYTES
        up, down = _powers(int(size) + 1)
        prefix = np.zeros(hi - lo + 1, np.uint64)
        value = _BYTE[data[lo:hi]] if data.dtype == np.uint8 else mix((data[lo:hi].astype(np.uint64) + np.uint64(1)) * _STEP)
        np.cumsum(value * up[: hi - lo], out=prefix[1:])
        b, e = begin[i:j] - lo, end[i:j] - lo
        out[i:j] = mix((prefix[e] - prefix[b]) * down[b] + (e - b).astype(np.uint64))
        i = j
    return out


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out = mix(out * _STEP + hashes[i : i + n])
    return out
