"""Vectorised views of text columns: UTF-8 bytes of many rows in one NumPy array, word and line spans, range hashes.

All work goes in chunks of about ``CHUNK`` bytes (a longer text is a chunk of its own), so a task's memory depends on
its longest text and not on the number of rows in an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
MASK = (1 << 64) - 1
#: Two independent random byte tables and odd multipliers, fixed by seed: hashes agree between tasks and runs.
_RNG = np.random.default_rng(7_301_993)
_TABLES = _RNG.integers(1, MASK, (2, 256), dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (int64, one more than rows) of a string or binary array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes together, or of one longer row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, min(end, rows)
        row = min(end, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads the bits of 64-bit hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int, lane: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(lane)
    if have is None or len(have[0]) < n:
        n = max(n, CHUNK + 4096)
        base = _BASES[lane]
        up = np.full(n, base, np.uint64)
        up[0] = 1
        down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
        down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if n <= 4 * CHUNK:  # the powers for a very long text are not kept
            _POWERS[lane] = have
    return have


class RangeHash:
    """Hashes of arbitrary byte ranges of one array in O(1) each: equal bytes give equal hashes in any chunk or task."""

    def __init__(self, data: np.ndarray, lane: int = 0):
        up, self.down = _powers(len(data) + 1, lane)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLES[lane][data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True in ``inside``, cut at row offsets."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:n]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def row_of(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that each byte position lies in."""
    return np.searchsorted(offsets, positions, "right") - 1


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` consecutive items (``len - n + 1`` of them)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:m].copy()
    for i in range(1, n):
        out *= np.uint64(0x9FB21C651E98DF25)
        out += hashes[i : i + m]
    return mix(out)
