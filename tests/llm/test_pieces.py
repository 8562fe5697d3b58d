"""Operator 9 against the sentencepiece library."""

import hashlib
import random

import pytest
import sentencepiece

from revsift.llm.pieces import PieceTable, encode_documents
from revsift.llm.queries import op9_sentencepiece, piece_model

from .conftest import SMALL, documents

LIB = sentencepiece.SentencePieceProcessor(model_file=piece_model())
EDGE = ["", " ", "  ", " a", "a ", "a  b", "\n", "\n\n a\tb\r\n", "▁", "a▁b", " ▁ x", "<s>", "</s><unk>", "<0x41>", "\u0000a", "日本語 テスト",
        "naïve café — “quotes”", "👩‍👩‍👧 family", "x" * 3000, "ab" * 500 + " " * 300 + "c", " " * 1000, "  ﻿", "é", "é"]


def test_edges_and_random_texts_match_the_library():
    table = PieceTable(piece_model())
    rnd = random.Random(5)
    alphabet = "abcdeé \n▁<>0x 日  \t.😀ßthe "
    texts = EDGE + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 300))) for _ in range(800)]
    for t in texts:
        ids = LIB.encode(t)
        got, n, decoded = table.encode(t)
        assert got == ",".join(map(str, ids)) and n == len(ids), repr(t)
        assert decoded == LIB.decode(ids), repr(t)
        assert table.decode(ids)[1 if table.dummy and ids else 0:] == decoded or t[:1] == "\n"


def test_long_and_short_merges_agree():
    table = PieceTable(piece_model())
    rnd = random.Random(9)
    for _ in range(300):
        w = "▁" + "".join(rnd.choice("thearnionsqzé") for _ in range(rnd.randrange(1, 60)))
        assert table.merge_short(w) == table.merge_long(w)


def test_query_matches_the_library_on_the_whole_table(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = op9_sentencepiece(spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = LIB.encode(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIB.decode(ids).encode()).hexdigest()


def test_nulls_repeated_rows_empty_table_and_clashing_names(spark):
    df = documents(spark, [None, "", "a b", "a b"], ids=[1, None, 3, 3]).withColumnRenamed("lang", "ids").withColumnRenamed("source", "decoded")
    got = sorted(encode_documents(df, piece_model()).collect(), key=lambda r: (r["n_tokens"], r["doc_id"] or 0))
    assert [r["n_tokens"] for r in got] == [0, 0, 2, 2] and got[0]["decoded"] == "" and got[2] == got[3]
    assert encode_documents(df.limit(0), piece_model()).count() == 0


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(piece_model(), "rb").read())
    proto.pieces[400].piece = "a▁b"
    (tmp_path / "m.model").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError):
        PieceTable(str(tmp_path / "m.model"))
