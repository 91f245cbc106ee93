"""Piece ids and spans against the library, with the model's own and a compiled character map."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from ledgerlens.llm import pieces
from ledgerlens.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "\n", "▁", " ▁ ", "hello  world\nfoo", "a" * 300, "　", " ​ x ", "​", "é x", "中⿓ 🙂", "ﬁ ﾞ" * 9,
       "x  y " * 4000, "longwordwithoutspace" * 2000]


def texts(n):
    rng = random.Random(1)
    letters = "abc  \t\n é中文🙂①ﬁÀ 　​\x00▁ｶﾞhe llo"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def with_settings(model, charsmap=None, **numbers):
    """The model with other normaliser settings (a repeated message field is merged)."""
    body = b"" if charsmap is None else bytes([18]) + varint(len(charsmap)) + charsmap
    for name, field in (("dummy", 3), ("trim", 4), ("mark", 5)):
        if name in numbers:
            body += bytes([field << 3, numbers[name]])
    return model + bytes([26]) + varint(len(body)) + body


def compiled_map():
    spec = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    return [dict((k, v) for k, v, _ in pieces.fields(value))[2] for n, value, _ in pieces.fields(spec) if n == 3][0]


@pytest.mark.parametrize("settings", [{}, {"trim": 1}, {"mark": 0}, {"dummy": 0, "trim": 1}, {"map": 1}, {"map": 1, "trim": 1},
                                      {"map": 1, "trim": 1, "dummy": 0}, {"map": 1, "trim": 1, "mark": 0}])
def test_ids_and_spans_as_the_library(settings):
    with open(PATH, "rb") as f:
        model = f.read()
    numbers = {k: v for k, v in settings.items() if k != "map"}
    model = with_settings(model, compiled_map() if "map" in settings else None, **numbers)
    library, encoder = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Encoder(model, add_end=True)
    some = texts(300)
    for text, (ids, begins, ends) in zip(some, encoder([t.encode() for t in some])):
        assert list(ids) == library.encode(text, add_eos=True)
        want = library.encode(text, return_type="offset_mapping", return_bytes=True)["offsets"]
        assert list(zip(begins, ends))[:-1] == want
        assert begins[-1] == ends[-1]


def test_symbols_of_the_user_are_not_normalised():
    normal = pieces.Normalizer(pieces.Settings(compiled_map(), True, True, True), ["①x".encode(), "①".encode()])
    out, source = normal("a ①x ①b ②".encode())
    assert out.decode() == "▁a▁①x▁①b▁2"
    assert len(source) == len(out) + 1 and source[-1] == len("a ①x ①b ②".encode())


def test_bytes_that_are_no_text():
    out, source = pieces.Normalizer(pieces.Settings(b"", True, False, True))(b"a\xffb\xe4\xb8")
    assert out.decode() == "▁a�b��" and list(source[[0, 3, 4, 7, 8, 11]]) == [0, 0, 1, 2, 3, 4]


def test_rows_of_every_kind(spark):
    some = [*texts(60), None, "same", "same"]
    docs = spark.createDataFrame([(i % 50 if i % 9 else None, t, 1, 2) for i, t in enumerate(some)],
                                 "doc_id long, text string, ids int, _text int").repartition(5)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = pieces.decode(pieces.encode(docs, PATH), PATH, ids="begins").columns
    assert got == ["doc_id", "ids", "ends", "decoded"]
    got = pieces.decode(pieces.encode(docs, PATH).withColumn("same", F.col("ids")), PATH).collect()
    want = [(i % 50 if i % 9 else None, library.encode(t or "", add_eos=True)) for i, t in enumerate(some)]
    assert sorted(((r["doc_id"], r["same"]) for r in got), key=str) == sorted(want, key=str)
    assert all(r["decoded"] == library.decode(r["same"]) for r in got)
    assert pieces.encode(docs.limit(0), PATH).count() == 0
    without = pieces.encode(docs.filter("text is null"), PATH, add_end=False).first()
    assert (without["ids"], without["begins"]) == ([], [])


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for r in rows:
        ids = library.encode(r["text"] or "", add_eos=True)
        want.add((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)), len((r["text"] or "").encode())))
    got = QUERIES["op11_sentencepiece"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == want
