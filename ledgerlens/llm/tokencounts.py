"""Edit-aware token counts: a segment tree of pre-token leaves per document.

A document is cut into leaves of about ``leaf_chars`` characters at safe places: a
letter, digit or punctuation mark followed by one space and a letter.  There the
pre-token pattern splits whatever stands further left or right, so leaves are encoded
alone and their counts add up exactly.  Two heap-ordered trees per document hold the
characters and the tokens of the leaves (node i over 2i and 2i + 1; node 1 is the sum).

An edit (start, length, insert; offsets in code points of the text as it then is)
descends the character tree to the leaves it touches, widens to the nearest leaf
boundaries whose three characters the edit leaves alone, re-encodes only that region,
and updates the sums on the paths to the root.  A tree whose leaf has outgrown
``REBUILD`` leaves is built anew.

Trees are rows of the document table, so edits meet them by a join on the id
(``with_edits``) and everything else is one pass without a shuffle.  The vocabulary is
a rank file whose path is a parameter; its bytes (1 MB) go to the tasks.

Cases: null text: counted as empty, and stays empty unless an edit inserts.  Edits that
reach beyond the text are clipped; null starts, lengths and inserts count as 0 and
empty.  No edits: counts stay.  Null ids have no edits.  Repeated rows are counted
each.  Empty table: no rows.  Other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-token pattern of the public byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SAFE = regex.compile(r"(?<=[\p{L}\p{N}\p{P}])(?= \p{L})")
REBUILD = 8
EDITS = "array<struct<start:int,length:int,insert:string>>"


def encoder(ranks: bytes):
    import tiktoken
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def cut(text: str, leaf_chars: int) -> list[int]:
    """Beginnings of the leaves."""
    out = [0]
    while (m := SAFE.search(text, out[-1] + leaf_chars)) is not None:
        out.append(m.start())
    return out


def heap(leaves: list[int]) -> list[int]:
    width = 1 << max(0, len(leaves) - 1).bit_length()
    out = [0] * width + leaves + [0] * (width - len(leaves))
    for i in range(width - 1, 0, -1):
        out[i] = out[2 * i] + out[2 * i + 1]
    return out


def update(tree: list[int], leaf: int, value: int) -> None:
    i = len(tree) // 2 + leaf
    gain = value - tree[i]
    while gain and i:
        tree[i] += gain
        i //= 2


def descend(tree: list[int], place: int) -> tuple[int, int]:
    """(leaf, its beginning) of the last non-empty leaf that begins at or before ``place``."""
    i, begin, width = 1, 0, len(tree) // 2
    while i < width:
        i *= 2
        # right only if something stands there that begins in reach
        if tree[i + 1] and begin + tree[i] <= place:
            begin += tree[i]
            i += 1
    return i - width, begin


class Counter:
    """Trees of one document under edits."""

    def __init__(self, count, leaf_chars: int, text: str, chars: list[int] | None = None, tokens: list[int] | None = None):
        self.count, self.leaf_chars, self.text, self.encoded = count, leaf_chars, text, 0
        if chars is None:
            self.build()
        else:
            self.chars, self.tokens = chars, tokens

    def build(self) -> None:
        begin = cut(self.text, self.leaf_chars)
        pieces = [self.text[a:b] for a, b in zip(begin, [*begin[1:], len(self.text)])]
        self.chars, self.tokens = heap([len(p) for p in pieces]), heap([self.count(p) for p in pieces])
        self.encoded += len(self.text)

    def edit(self, start: int, length: int, insert: str) -> None:
        size = len(self.text)
        start = min(max(start, 0), size)
        end = min(start + max(length, 0), size)
        left, lo = descend(self.chars, max(0, start - 2))          # its boundary's characters stay
        right, hi = descend(self.chars, end)
        hi += self.chars[len(self.chars) // 2 + right]             # the first boundary beyond the edit
        if hi < size and hi < end + 1:
            right, begin = descend(self.chars, hi)
            hi = begin + self.chars[len(self.chars) // 2 + right]
        self.text = self.text[:start] + insert + self.text[end:]
        region = self.text[lo:hi + len(insert) - (end - start)]
        for leaf in range(left, right + 1):
            update(self.chars, leaf, len(region) if leaf == left else 0)
            update(self.tokens, leaf, self.count(region) if leaf == left else 0)
        self.encoded += len(region)
        if len(region) > REBUILD * self.leaf_chars and SAFE.search(region, self.leaf_chars):
            self.build()


TREE_SCHEMA = "doc_id long, text string, chars array<int>, tokens array<int>"
EDITED_SCHEMA = ("doc_id long, text string, chars array<int>, tokens array<int>, n_tokens_before long, n_tokens long, "
                 "n_encoded long")
_INTS = pa.list_(pa.int32())


def tree_builder(ranks, leaf_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks.value).encode_ordinary
        for batch in batches:
            docs = [Counter(lambda s: len(encode(s)), leaf_chars, t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([d.text for d in docs], pa.string()),
                 pa.array([d.chars for d in docs], _INTS), pa.array([d.tokens for d in docs], _INTS)],
                names=["doc_id", "text", "chars", "tokens"])
    return run


def editor(ranks, leaf_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks.value).encode_ordinary
        for batch in batches:
            docs, before = [], []
            for row in batch.to_pylist():
                d = Counter(lambda s: len(encode(s)), leaf_chars, row["text"] or "", row["chars"], row["tokens"])
                before.append(d.tokens[1])
                for e in row["edits"] or []:
                    d.edit(e["start"] or 0, e["length"] or 0, e["insert"] or "")
                docs.append(d)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([d.text for d in docs], pa.string()),
                 pa.array([d.chars for d in docs], _INTS), pa.array([d.tokens for d in docs], _INTS),
                 pa.array(before, pa.int64()), pa.array([d.tokens[1] for d in docs], pa.int64()),
                 pa.array([d.encoded for d in docs], pa.int64())],
                names=["doc_id", "text", "chars", "tokens", "n_tokens_before", "n_tokens", "n_encoded"])
    return run


def _ranks(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def build_trees(docs: DataFrame, rank_file: str, leaf_chars: int = 400) -> DataFrame:
    """(doc_id, text, chars, tokens): the trees of every document, from its whole text."""
    return docs.select("doc_id", "text").mapInArrow(tree_builder(_ranks(docs, rank_file), leaf_chars), TREE_SCHEMA)


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """Trees with the edits (doc_id, edit_no, start, length, insert) of their document, in order."""
    lists = (edits.filter(F.col("doc_id").isNotNull()).groupBy("doc_id")
             .agg(F.array_sort(F.collect_list(F.struct("edit_no", "start", "length", "insert"))).alias("e"))
             .select("doc_id", F.transform("e", lambda x: F.struct(x["start"].cast("int").alias("start"),
                                                                   x["length"].cast("int").alias("length"),
                                                                   x["insert"].alias("insert"))).alias("edits")))
    return trees.join(lists, "doc_id", "left")


def apply_edits(trees: DataFrame, rank_file: str, leaf_chars: int = 400) -> DataFrame:
    """Trees with a column ``edits`` -> edited texts and trees, counts before and after, and the
    number of characters that were encoded for it."""
    return (trees.select("doc_id", "text", "chars", "tokens", F.col("edits").cast(EDITS).alias("edits"))
            .mapInArrow(editor(_ranks(trees, rank_file), leaf_chars), EDITED_SCHEMA))
