"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from stayline.llm import piecebpe
from stayline.llm.queries import QUERIES, piece_bpe, table

SF = "/root/testdata/sf0.001"
ODD = ["▁", " ", "  ", "a", "b", "the", "ing", "\n", "\t", "é", "日", "𝔘", "<s>", "<0x0A>", "\x00", "er", "t", " " * 17, " " * 40, "aaa"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_bpe())


@pytest.fixture(scope="module")
def model():
    with open(piece_bpe(), "rb") as file:
        return piecebpe.PieceModel(file.read())


def texts(model):
    r = random.Random(5)
    pieces = model.pieces[259:]
    for _ in range(3000):
        yield "".join(r.choice(ODD) for _ in range(r.randrange(0, 30)))
        yield "".join(r.choice(pieces) for _ in range(r.randrange(0, 20))).replace("▁", " ")
        yield "".join(chr(r.randrange(97, 123)) for _ in range(r.randrange(0, 60)))


def test_ids_equal_the_library(model, library):
    encoder = piecebpe.PieceEncoder(model)
    for text in texts(model):
        ids = encoder.encode(text)
        assert ids == library.encode(text, add_bos=True, add_eos=True), text
        assert model.decode(ids) == library.decode(ids)


def test_texts_without_cuts(model, library):
    """One prefix table per text gives what the tables of its parts give."""
    encoder = piecebpe.PieceEncoder(model)
    for text in list(texts(model))[:600]:
        known = "".join(c for c in text if c.replace(" ", "▁") in encoder.single)
        marked = "▁" + known.replace(" ", "▁") if known else ""
        assert encoder.part(marked) == encoder.cut_part(marked) == library.encode(known)


def test_every_prefix_has_the_last_token_of_its_encoding(model):
    encoder = piecebpe.PieceEncoder(model)
    for text in ("▁internationalization", "▁▁▁▁▁▁the▁▁x", "aaaaaaaaaaaaaaaaaaaa", "▁" * 40):
        assert encoder.last_tokens(text) == [model.merged(text[: i + 1])[-1] for i in range(len(text))]


def test_any_ids_decode_as_the_library_does(model, library):
    r = random.Random(6)
    for _ in range(5000):
        ids = [r.choice([0, 1, 2, r.randrange(3, 259), 259, 28705, r.randrange(259, 32000)]) for _ in range(r.randrange(0, 8))]
        assert model.decode(ids) == library.decode(ids), ids
    assert model.decode(None) == model.decode([-1, 99999]) == ""


def test_a_long_word_takes_linear_work(model, library):
    r = random.Random(7)
    text = "".join(chr(r.randrange(97, 123)) for _ in range(100_000))
    assert piecebpe.PieceEncoder(model).encode(text) == library.encode(text, add_bos=True, add_eos=True)


def test_other_models_are_refused(model):
    with open(piece_bpe(), "rb") as file:
        data = file.read()
    with pytest.raises(ValueError):
        piecebpe.PieceModel(data.replace(b"identity", b"nmt_nfkc"))


def test_frames(spark, library):
    rows = [(None, None), (1, ""), (2, " "), (2, " "), (3, "Hello wörld 𝔘\n\x00"), (4, "x" * 5000), (None, "same"), (None, "same")]
    docs = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, n_tokens int, ids string")
    coded = piecebpe.encode(docs, piece_bpe())
    want = sorted((str(i), tuple(library.encode(t or "", add_bos=True, add_eos=True))) for i, t in rows)
    assert sorted((str(r["doc_id"]), tuple(r["ids"])) for r in coded.collect()) == want
    back = sorted((str(r["doc_id"]), r["text"]) for r in piecebpe.decode(coded, piece_bpe()).collect())
    assert back == sorted((str(i), t or "") for i, t in rows)
    assert piecebpe.round_trip(docs.limit(0), piece_bpe()).count() == 0


def test_query(spark, library):
    got = {r["doc_id"]: r for r in QUERIES["op13_sentencepiece"](spark, SF).collect()}
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc, text in docs:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        assert got[doc]["n_tokens"] == len(ids)
        assert got[doc]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[doc]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
