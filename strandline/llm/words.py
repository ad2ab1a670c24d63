"""Words of many texts at once: their places and 64-bit hashes, from the bytes of an Arrow string column."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes that are worked on together; a longer text is worked on alone.
CHUNK = 1 << 19
#: The hash's base, odd, and its inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept and grown by doubling, for texts of up to a chunk."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.ones(size, np.uint64)
        done = 1
        while done < size:
            have[done : 2 * done] = have[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        if size <= 4 * CHUNK:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer (multiply and xor-shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function of batches, after which the worker gives the memory that it no longer uses back to the machine: workers
    stay for later tasks, and what their arrays took would stay with them."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
                trim(0)

    return wrapped


@dataclass
class Texts:
    """Texts docs[i] = data[offsets[i] : offsets[i + 1]], UTF-8; first: place of the first of them in its batch."""

    data: np.ndarray
    offsets: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        """Which text a byte is in."""
        return np.searchsorted(self.offsets, at, side="right") - 1


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[Texts]:
    """The texts of a string column in groups of about `size` bytes, without copies; nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    if not len(column):
        return
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield Texts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to


def words(texts: Texts, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""(start, end, hash) of all words [^\x20\x09-\x0D]+, in order; no word reaches over the end of its text.

    A word's hash is a polynomial of its bytes, taken from running sums, and mixed. With `lower`, A-Z count as a-z.
    """
    data = texts.data
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[texts.offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    with np.errstate(over="ignore"):
        value = (LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)
        value *= _powers(BASE, n)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(value, out=total[1:])
        hashed = mix((total[ends] - total[starts]) * _powers(INVERSE, n)[starts])
    return starts, ends, hashed


def shingles(texts: Texts, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its runs of `size` words; of fewer words, of all of them as one
    run; of no word, none."""
    starts, _, hashed = words(texts)
    doc = texts.doc_of(starts)
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    n = len(hashed)
    with np.errstate(over="ignore"):
        runs = hashed.copy()
        for k in range(1, size):
            runs[: n - k] = mix(runs[: n - k] * np.uint64(BASE) + hashed[k:])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            own = np.sort(runs[a : b - size + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif b > a:
            whole = hashed[a]
            with np.errstate(over="ignore"):
                for k in range(a + 1, b):
                    whole = mix(whole * np.uint64(BASE) + hashed[k])
                out.append(mix(np.array([whole + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
