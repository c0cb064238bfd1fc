"""Vectorised tokenising of Arrow text batches, shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that part words: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_SPACE = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words of ASCII letters, digits and anything beyond ASCII, after lower-casing.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True

#: Text bytes that are worked on at once: some 10 MB of arrays, which a core's cache holds in part. A longer text comes alone; what is
#: made of it takes a few bytes for each of its own.
SLICE_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15
#: Another base, for hashes that are independent of the first.
OTHER_BASE = 0xD6E8FEB86659FD93
_powers_of: dict[int, list[np.ndarray]] = {}


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows in runs of about `most` text bytes (one row at least): the rows, their bytes, their n + 1 offsets. Null counts as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
            yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of `inside` bytes that stay in one text, and each text's first word (n + 1)."""
    w = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    near = np.zeros(len(data) + 2, bool)
    near[1:-1] = w
    starts = np.flatnonzero(w & (~near[:-2] | edge[:-1]))
    ends = np.flatnonzero(w & (~near[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _powers(n: int, base: int = _BASE) -> list[np.ndarray]:
    """n powers at least of the base and of its inverse, modulo 2^64."""
    if base not in _powers_of or len(_powers_of[base][0]) < n:
        size = max(1 << (n - 1).bit_length(), SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            _powers_of[base] = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64), dtype=np.uint64))) for b in (np.uint64(base), np.uint64(pow(base, -1, 1 << 64)))]
    return _powers_of[base]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever the span stands. Spans are in order and apart; SLICE_BYTES of them are
    worked on at once, so that a long text takes no more memory than a short one."""
    p, q = _powers(SLICE_BYTES + 1, base)
    out, i = np.empty(len(starts), np.uint64), 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            low = starts[i]
            j = int(np.searchsorted(ends, low + SLICE_BYTES, "right"))
            if j <= i:
                out[i], j = _long_hash(data[low : ends[i]], base), i + 1
            else:
                s = np.zeros(ends[j - 1] - low + 1, np.uint64)
                np.cumsum((data[low : ends[j - 1]] + np.uint64(1)) * p[: len(s) - 1], out=s[1:])
                at = starts[i:j] - low
                out[i:j] = (s[ends[i:j] - low] - s[at]) * q[at]
            i = j
    return mixed(out)


def _long_hash(data: np.ndarray, base: int = _BASE) -> np.uint64:
    """What span_hashes mixes, of one span above SLICE_BYTES."""
    p, total, power = _powers(SLICE_BYTES + 1, base)[0], 0, 1
    for i in range(0, len(data), SLICE_BYTES):
        part = data[i : i + SLICE_BYTES]
        total += power * int(((part + np.uint64(1)) * p[: len(part)]).sum(dtype=np.uint64))
        power = power * pow(base, len(part), 1 << 64) % (1 << 64)
    return np.uint64(total % (1 << 64))


class Prefixes:
    """Prefix polynomials of a row of hashes modulo 2^64: the fingerprint of any run of them is one difference (Rabin-Karp)."""

    def __init__(self, h: np.ndarray, base: int = _BASE):
        p, self._inverse = _powers(len(h) + 1, base)
        self._sums = np.zeros(len(h) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(h * p[: len(h)], out=self._sums[1:])

    def of(self, n: int) -> np.ndarray:
        """Fingerprints of the runs of n hashes, by their first; none where there are fewer."""
        m = max(0, len(self._sums) - n)
        with np.errstate(over="ignore"):
            return (self._sums[n:] - self._sums[:m]) * self._inverse[:m]


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n hashes, by its first; len(h) - n + 1 of them, none for fewer."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    size = len(h) - n + 1
    with np.errstate(over="ignore"):
        g = h[:size].copy()
        for i in range(1, n):
            g = g * np.uint64(_BASE) + h[i : i + size]
        return mixed(g)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between offsets."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[offsets[1:]] - c[offsets[:-1]]
