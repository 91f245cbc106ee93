"""Offset-preserving encoding with a SentencePiece model, and decoding.

1. Normalisation: at every character the longest prefix that the model's compiled
   character map holds (a double-array trie, walked for all characters of a text at
   once) is replaced by its normal form; what the map does not hold stays.  Every byte of
   the normal form keeps the offset of the source byte its unit began at; white space is
   trimmed, marked and prefixed as the model's settings say.
2. Pieces: the library segments the normal form with its own normaliser switched off,
   so ids are the library's for the whole text.
3. Alignment: the pieces' byte lengths give their bounds in the normal form, and the kept
   offsets project every piece to a span of bytes of the source text.  A character split
   into byte pieces gives its span to the last of them, the others are empty there; the end
   id is an empty span at the end.

Every text is a row of its own: nothing is shuffled.  The model file (a megabyte at most
for 32,000 pieces) is read once on the driver and sent to the tasks.

Cases: null and empty texts encode to the end id alone (or nothing) and decode to the empty
text; bytes that are no UTF-8 count as U+FFFD each; very long texts are encoded whole, one at
a time; repeated rows are encoded alike; an empty table gives no rows.  Only the key columns and
the text are read, so further columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The marks and the numbers of the public model format.
SPACE_MARK = "▁".encode()
REPLACEMENT = "�".encode()
UNKNOWN, CONTROL, USER_DEFINED, BYTE = 2, 3, 4, 6

#: Bytes of text that are given to the library at once (one longer text goes alone).
PART_BYTES = 1 << 20


# ---------------------------------------------------------------- model file

def fields(message: bytes) -> Iterator[tuple[int, int | bytes, bytes]]:
    """(number, value, raw bytes of the field) of a serialized message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value
    while at < len(message):
        began, key = at, number()
        if key & 7 == 0:
            value = number()
        else:
            size = number() if key & 7 == 2 else 4 if key & 7 == 5 else 8
            value = message[at:at + size]
            at += size
        yield key >> 3, value, message[began:at]


@dataclass(frozen=True)
class Settings:
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    mark_spaces: bool = True
    mark_after: bool = False


def read_model(model: bytes) -> tuple[Settings, list[tuple[bytes, int]], bytes]:
    """Its normaliser's settings, its pieces with their kinds, and the model without a normaliser."""
    pieces, kept = [], []
    norm: dict[int, int | bytes] = {}
    after = False
    for n, value, raw in fields(model):
        if n == 1:
            piece = {k: v for k, v, _ in fields(value)}
            pieces.append((piece.get(1, b""), piece.get(3, 1)))
        elif n == 2:
            after = bool({k: v for k, v, _ in fields(value)}.get(24, 0))
        elif n == 3:
            norm.update({k: v for k, v, _ in fields(value)})
        if n in (1, 2):
            kept.append(raw)
    settings = Settings(norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1)), after)
    off = bytes([2 << 3 | 2, 0, 3 << 3, 0, 4 << 3, 0, 5 << 3, 0])
    return settings, pieces, b"".join(kept) + bytes([3 << 3 | 2, len(off)]) + off


# ---------------------------------------------------------------- normalisation

class CharMap:
    """The compiled character map: a trie over UTF-8 bytes whose leaves point at normal forms."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4:4 + size], dtype="<u4").astype(np.int64)
        self.forms = blob[4 + size:]

    def form(self, at: int) -> bytes:
        return self.forms[at:self.forms.index(b"\0", at)]

    def longest(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each start the bytes of the longest key there (0: none) and where its form stands."""
        below = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        length, form = np.zeros(len(starts), dtype=np.int64), np.full(len(starts), -1, dtype=np.int64)
        live, node, depth = np.arange(len(starts)), np.full(len(starts), below(self.units[0])), 0
        while True:
            inside = starts[live] + depth < len(data)
            live, node = live[inside], node[inside]
            byte = data[starts[live] + depth].astype(np.int64)
            node = node ^ byte
            unit = np.where(node < len(self.units), self.units[np.minimum(node, len(self.units) - 1)], -1)
            fits = (unit >= 0) & (unit & 0x800000FF == byte)
            live, unit = live[fits], unit[fits]
            if not len(live):
                return length, form
            node = node[fits] ^ below(unit)
            depth += 1
            leaf = unit >> 8 & 1 == 1
            length[live[leaf]] = depth
            form[live[leaf]] = self.units[node[leaf]] & 0x7FFFFFFF


def _offsets(raw: bytes) -> np.ndarray | None:
    """For every byte where its character begins; None if ``raw`` is no UTF-8."""
    at = np.arange(len(raw))
    if raw.isascii():
        return at
    try:
        raw.decode()
    except UnicodeDecodeError:
        return None
    inside = np.frombuffer(raw, dtype=np.uint8) & 0xC0 == 0x80
    return np.maximum.accumulate(np.where(inside, 0, at))


class Normalizer:
    """Text -> (its normal form, the source offset of every byte of it and of its end)."""

    def __init__(self, settings: Settings, symbols: list[bytes] = ()):
        self.settings = settings
        self.map = CharMap(settings.charsmap) if settings.charsmap else None
        longest_first = sorted((s.decode() for s in symbols), key=lambda s: -len(s.encode()))
        self.symbols = re.compile(f"(?=({'|'.join(map(re.escape, longest_first))}))") if symbols else None

    def _units(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and byte lengths of the source's units, and the place of each one's form
        (-1: as it is, -2: no UTF-8)."""
        text = raw.decode("utf-8", "surrogateescape")
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        broken = (points >= 0xDC80) & (points <= 0xDCFF)
        width = 1 + (points >= 0x80) + (points >= 0x800).astype(np.int64) + (points >= 0x10000)
        width[broken] = 1
        start = np.cumsum(width) - width
        form = np.where(broken, -2, -1)
        if self.map is None and self.symbols is None:
            return start, width, form
        if self.map is not None:
            long, at = self.map.longest(np.frombuffer(raw, dtype=np.uint8), start)
            found = (long > 0) & ~broken
            width, form = np.where(found, long, width), np.where(found, at, form)
        if self.symbols is not None:                  # a symbol of the user's own stays as it is
            for m in self.symbols.finditer(text):
                width[m.start()], form[m.start()] = len(m[1].encode()), -1
        # a unit of several characters swallows the units that begin inside it
        ends, keep = start + width, np.ones(len(start), dtype=bool)
        reach = 0
        following = np.append(start[1:], len(raw))
        for i in np.flatnonzero(ends > following):
            if start[i] >= reach:
                reach = ends[i]
                keep[i + 1:np.searchsorted(start, reach)] = False
        return start[keep], width[keep], form[keep]

    def __call__(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        s = self.settings
        if not raw:
            return b"", np.zeros(1, dtype=np.int64)
        if self.map is None and self.symbols is None:
            source = _offsets(raw)
            if source is not None:                    # every character is its own normal form
                if s.trim_spaces and not raw.strip(b" "):
                    return b"", np.full(1, len(raw), dtype=np.int64)
                return self._trimmed(np.frombuffer(raw, dtype=np.uint8), source, len(raw) - len(raw.lstrip(b" ")), len(raw))
        start, width, form = self._units(raw)
        forms = {int(f): self.map.form(f) if f >= 0 else REPLACEMENT for f in np.unique(form[form != -1])}
        size = width.copy()
        for f, text in forms.items():
            size[form == f] = len(text)
        first = np.cumsum(size) - size
        source = np.repeat(start, size)
        inside = np.arange(len(source)) - np.repeat(first, size)
        out = np.frombuffer(raw, dtype=np.uint8)[np.minimum(source + inside, len(raw) - 1)].copy()
        for f, text in forms.items():
            for k, byte in enumerate(text):
                out[first[form == f] + k] = byte
        lead = 0
        if s.trim_spaces:
            single = (size == 1) & (out[np.minimum(first, max(len(out) - 1, 0))] == 32) if len(out) else np.zeros(len(size), dtype=bool)
            if single.all():
                return b"", np.full(1, len(raw), dtype=np.int64)
            lead = int(start[np.argmin(single)])
        return self._trimmed(out, source, lead, len(raw))

    def _trimmed(self, out: np.ndarray, source: np.ndarray, lead: int, end: int) -> tuple[bytes, np.ndarray]:
        """Of a run of spaces the first stays, but before the text."""
        text = out.tobytes()
        if self.settings.trim_spaces and (b"  " in text or text.startswith(b" ")):
            space = out == 32
            keep = ~space
            keep[1:] |= space[1:] & ~space[:-1]
            text, source = out[keep].tobytes(), source[keep]
        return self._marked(text, source, lead if self.settings.trim_spaces else 0, end)

    def _marked(self, text: bytes, source: np.ndarray, lead: int, end: int) -> tuple[bytes, np.ndarray]:
        """With the space before (or after) the text, and spaces as marks."""
        s = self.settings
        mark = SPACE_MARK if s.mark_spaces else b" "
        if s.dummy_prefix and not s.mark_after:
            text, source = b" " + text, np.concatenate([[lead], source])
        if len(mark) > 1:
            times = np.ones(len(text), dtype=np.int64)
            times[np.frombuffer(text, dtype=np.uint8) == 32] = len(mark)
            text, source = text.replace(b" ", mark), np.repeat(source, times)
        source = np.append(source, end)
        if s.trim_spaces:                             # marks that stood in the text go from its end, too
            size = len(text)
            while text.endswith(mark, 0, size):
                size -= len(mark)
            text, source = text[:size], source[:size + 1]
        if s.dummy_prefix and s.mark_after:
            text, source = text + mark, np.concatenate([source[:-1], np.repeat(source[-1], len(mark) + 1)])
        return text, source


# ---------------------------------------------------------------- pieces

class Encoder:
    """One model, as a task uses it."""

    def __init__(self, model: bytes, add_end: bool):
        import sentencepiece
        settings, pieces, bare = read_model(model)
        self.normalize = Normalizer(settings, [p for p, kind in pieces if kind == USER_DEFINED])
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=bare)
        self.length = np.array([1 if kind == BYTE else 0 if kind in (CONTROL, UNKNOWN) else len(p) for p, kind in pieces])
        self.unknown, self.end = self.bare.unk_id(), self.bare.eos_id() if add_end else None
        if add_end and self.end < 0:
            raise ValueError("the model has no end id")

    def __call__(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, begins, ends) of each text."""
        normal = [self.normalize(t) for t in texts]
        strings = [n.decode() for n, _ in normal]
        out = []
        for string, (_, source), ids in zip(strings, normal, self.bare.encode(strings, num_threads=1, return_type="numpy")):
            length = self.length[ids]
            if (ids == self.unknown).any():           # what no piece covers has the length of its text
                unknown = np.flatnonzero(ids == self.unknown)
                shown = self.bare.encode(string, return_type=str)
                length[unknown] = [len(shown[i].encode()) for i in unknown]
            bounds = source[np.concatenate([[0], np.cumsum(length)])]
            if self.end is not None:
                ids, bounds = np.append(ids, self.end), np.append(bounds, source[-1])
            out.append((ids, bounds[:-1], bounds[1:]))
        return out


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    values = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def _id_lists(column: pa.Array) -> list[list[int]]:
    """The lists of a column of ids, none for a null; all its values are turned into numbers at once."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    values = column.flatten().to_numpy(zero_copy_only=False).tolist()
    return [values[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def _parts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``PART_BYTES`` (or one row)."""
    total, row = np.concatenate([[0], np.cumsum(sizes)]), 0
    while row < len(sizes):
        end = max(row + 1, int(np.searchsorted(total, total[row] + PART_BYTES, side="right")) - 1)
        yield row, end
        row = end


def encode(docs: DataFrame, model_path: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text",
           add_end: bool = True) -> DataFrame:
    """The key columns with ``ids``, ``begins`` and ``ends``: the pieces' ids and, for each, the bytes of the
    source text it stands for."""
    with open(model_path, "rb") as f:
        model = f.read()

    def run(batches):
        encoder = Encoder(model, add_end)
        for batch in batches:
            column = pc.fill_null(batch.column(len(keys)).cast(pa.large_binary()), b"")
            for row, end in _parts(pc.binary_length(column).to_numpy(zero_copy_only=False)):
                found = encoder(column[row:end].to_pylist())
                columns = [_lists([x[k] for x in found]) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k)[row:end] for k in range(len(keys))), *columns],
                                                 names=[*keys, "ids", "begins", "ends"])
    rows = docs.select(*keys, F.col(text).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:len(keys)])
    return rows.mapInArrow(run, f"{schema}, ids array<int>, begins array<int>, ends array<int>")


def decode(encoded: DataFrame, model_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns but ``ids``, and the text of the ids as the library's decode gives it (null ids: none)."""
    with open(model_path, "rb") as f:
        model = f.read()
    others = [c for c in encoded.columns if c not in (ids, decoded)]

    def run(batches):
        import sentencepiece
        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        for batch in batches:
            column = batch.column(len(others))
            for row, end in _parts(4 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)):
                texts = processor.decode(_id_lists(column[row:end]), num_threads=1)
                yield pa.RecordBatch.from_arrays([*(batch.column(k)[row:end] for k in range(len(others))),
                                                  pa.array(texts, type=pa.string())], names=[*others, decoded])
    rows = encoded.select(*others, ids)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:len(others)])
    return rows.mapInArrow(run, f"{schema}{', ' if others else ''}`{decoded}` string")
