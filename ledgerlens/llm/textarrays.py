"""Words and hashes of whole texts as arrays, for functions over Arrow batches.

A batch of texts is one byte array with row offsets, as Arrow holds it; words,
their 64-bit hashes and the hashes of any word sequence come from prefix sums, so
the cost is a few array passes whatever the sequence length.  Nothing here keeps
state between rows: Spark deals the rows out, these are helpers inside a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once (one longer text is worked on alone).
PART_BYTES = 2 << 20

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15          # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix64(np.arange(1, 257, dtype=_U) * _U(_BASE))


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=_U)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=_U)
    return _powers[base][:n]


class Sequences:
    """Hashes of the spans of one sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, dtype=_U)
        np.cumsum(values * _power(_BASE, len(values)), dtype=_U, out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of values[start:end] for each pair, the same wherever the span stands."""
        back = _power(_INVERSE, len(self.sums))
        return mix64((self.sums[end] - self.sums[start]) * back[start])

    def windows(self, n: int) -> np.ndarray:
        """Hashes of all spans of ``n`` values, by start."""
        k = len(self.sums) - n
        if k <= 0:
            return np.zeros(0, dtype=_U)
        return mix64((self.sums[n:] - self.sums[:k]) * _power(_INVERSE, len(self.sums))[:k])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets (null: empty)."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def parts(batch: pa.RecordBatch, text: str = "text", most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most ``most`` bytes of text (or one row)."""
    if not batch.num_rows:
        return
    _, at = utf8(batch.column(batch.schema.get_field_index(text)))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
        yield batch.slice(row, end - row)
        row = end


class Words:
    """Words of a batch of texts: ``start``/``end`` byte positions, ``row`` of each
    word and ``first`` word of each row (one more entry than rows)."""

    def __init__(self, data: np.ndarray, at: np.ndarray, inside: np.ndarray | None = None, lower: bool = False):
        if lower:
            data = lowered(data)
        self.data, self.at = data, at
        inside = ~_SPACE[data] if inside is None else inside
        n = len(data)
        edge = np.zeros(n + 1, dtype=bool)       # a text begins or ends here
        edge[at] = True
        begin, stop = inside.copy(), inside.copy()
        if n:
            begin[1:] &= ~inside[:-1] | edge[1:n]
            stop[:-1] &= ~inside[1:] | edge[1:n]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, at)
        self.row = np.repeat(np.arange(len(at) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        return Sequences(_BYTE[self.data]).spans(self.start, self.end)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z on bytes."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """Smallest of each ``n`` consecutive values, by doubling the reach."""
    out, reach = values, 1
    while reach * 2 <= n:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    rest = n - reach
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return x.view(np.int64)
