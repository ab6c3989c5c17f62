"""Encoding against the library's own unigram decoder over the same pieces and scores."""

import zlib

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from candlewick.llm import pieces
from candlewick.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(PATH, "rb").read())
    model.trainer_spec.model_type = 1  # unigram
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


TEXTS = [
    "", " ", "a", "Hello world", "  two  spaces ", "line\nbreak\ttab", "naïve café ñandú", "你好 мир",
    "emoji 🙂🙂 x", "x" * 500, "aaaa bbbb  cccc", "éèàù", "\x00\x01 \x7f", "internationalization of words", " trailing   ",
]


def test_matches_the_library(library, prose):
    codec = pieces.Codec(PATH)
    texts = TEXTS + [prose(i, 200) for i in range(5)]
    for text, ids in zip(texts, codec.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text), repr(text)
        assert codec.decode(ids) == text


def test_space_mark_decodes_to_a_space():
    codec = pieces.Codec(PATH)
    assert codec.decode(codec.encode(["a▁b"])[0]) == "a b"


def test_table(docs, awkward, library):
    rows = {}
    for r in pieces.round_trip(docs(awkward), PATH).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    for i, text in awkward:
        ids = np.array(library.encode(text or ""), "<u4")
        assert (len(ids), zlib.crc32(ids.tobytes())) in {(r["n_ids"], r["ids_crc32"]) for r in rows[i]}
        assert all(r["round_trip"] for r in rows[i]) == ("▁" not in (text or ""))
    assert pieces.round_trip(docs([]), PATH).collect() == []


def test_encode_then_decode(docs, prose):
    df = docs([prose(1, 50), None])
    back = pieces.decode(pieces.encode(df, PATH), PATH).collect()
    assert {r["doc_id"]: r["text"] for r in back} == {0: prose(1, 50), 1: ""}
