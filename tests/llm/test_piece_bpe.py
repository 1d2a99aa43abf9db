"""Piece ids and texts against the sentencepiece library, on odd texts, real ones and arbitrary ids."""

import hashlib
import random
import time

import numpy as np
import pytest
import sentencepiece

from dustspark.llm import piece_bpe, queries
from dustspark.llm.tokens import vocabulary

LETTERS = "aabbc  ▁\n\t  eé漢字🙂\x00tthe.<>/0 =�"


@pytest.fixture(scope="module")
def both():
    path = vocabulary(piece_bpe.VOCABULARY)
    return piece_bpe.model(path), sentencepiece.SentencePieceProcessor(model_file=path)


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def unpacked(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_odd_texts_as_the_library(both):
    own, library = both
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(LETTERS) for _ in range(rnd.randrange(50))) for _ in range(800)]
    texts += [c * n + tail for c in (" ", "a", "▁", "\n", "=", "ab") for n in (1, 2, 3, 15, 16, 17, 33, 70, 300) for tail in ("", "b", " the")]
    texts += ["", None, "<s>", "</s> <unk> <0x0A>", "🙂", "\x00", "the the  the"]
    got = own.encode(texts)
    assert [unpacked(x) for x in got] == [library.encode(t or "") for t in texts]
    assert own.decode(got) == [library.decode(unpacked(x)) for x in got]
    # a text's ids don't depend on the texts beside it
    assert [own.encode([t])[0] for t in texts[:40]] == got[:40]


def test_arbitrary_ids_decode_as_the_library(both):
    own, library = both
    rnd = random.Random(5)
    ids = [[rnd.choice([0, 1, 2, 3 + rnd.randrange(256), 3 + 0x80 + rnd.randrange(0x7F), rnd.randrange(32000)]) for _ in range(rnd.randrange(14))] for _ in range(1500)]
    assert own.decode([packed(x) for x in ids]) == [library.decode(x) for x in ids]


def test_pair_table_holds_every_merge_of_the_library(both):
    own, library = both
    pieces = {library.id_to_piece(k): k for k in range(259, library.get_piece_size())}
    for text in ("the", "▁there", "tion", "▁▁▁▁"):
        for cut in range(1, len(text)):
            a, b = (pieces.get(x) for x in (text[:cut], text[cut:]))
            if a and b:
                rank, whole = own.pair(np.array([a]), np.array([b]))
                assert whole[0] == pieces[text] if text in pieces else rank[0] == piece_bpe._NONE


def test_long_words_take_no_quadratic_time(both):
    own, library = both
    rnd = random.Random(9)
    texts = [" " * 200_000, "a" * 200_000, "".join(rnd.choice("abcdefghij0123456789") for _ in range(60_000))]
    t0 = time.time()
    got = own.encode(texts)
    assert time.time() - t0 < 20
    assert [unpacked(x) for x in got] == library.encode(texts)


def test_query_over_whole_documents(spark, small, both):
    library = both[1]
    want = {}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        want[r["doc_id"]] = (len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op11_piece_bpe"](spark, small).collect()}
    assert got == want


def test_other_columns_and_clashing_names_stay(spark, both):
    library = both[1]
    docs = spark.createDataFrame([(1, "a  b", "x", "y"), (None, None, None, "z"), (1, "a  b", "x", "y")], "doc_id int, text string, row string, `i.d` string")
    got = piece_bpe.decode(piece_bpe.encode(docs)).collect()
    assert [g["row"] for g in got] == ["x", None, "x"]
    assert [g["i.d"] for g in got] == ["y", "z", "y"]
    assert [unpacked(g["ids"]) for g in got] == [library.encode(t, add_bos=True, add_eos=True) for t in ("a  b", "", "a  b")]
    assert [g["decoded"] for g in got] == ["a  b", "", "a  b"]
