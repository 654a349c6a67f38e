"""Encoding against the library on whole texts; decoding against the texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import byte_bpe

SCHEMA = "doc_id long, text string, segment string, words string, places string, ids string, id string, token string"


def texts():
    r = random.Random(5)
    odd = ["don't", "we're 12", "  ", " \n\t\r\n", "a\x00b", "\x1c\x1d x", "\x85y", "漢字 and 漢字", "🙂👍🏽", "<|endoftext|>", "½²", "''s", "Ünïcödé ß", "à\xa0b", "﻿", "'LL 'll", "x" * 3000, "--- !!! ..."]
    rows = [(1, "one word two words"), (2, None), (3, ""), (4, " "), (4, " "), (None, "no id"), (None, None), (5, "the the the " * 2000)]
    rows += [(10 + k, "".join(r.choice(odd) + r.choice(["", " ", "  ", "\n", "x"]) for _ in range(r.randrange(40)))) for k in range(60)]
    return [*rows, (99, " ".join(str(r.random()) for _ in range(3000)))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "s", "w", "p", "x", "y", "z") for i, t in texts()], SCHEMA).repartition(3)


def plain(t):
    enc = byte_bpe.encoding(open(byte_bpe.ranks_file(), "rb").read(), byte_bpe.pattern())
    return np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()


@pytest.mark.parametrize("segment,shards", [(byte_bpe.SEGMENT, byte_bpe.SHARDS), (300, 7), (1, 1)])
def test_ids_are_those_of_whole_texts(spark, docs, segment, shards):
    tokens = byte_bpe.encode(docs, byte_bpe.ranks_file(), segment=segment, shards=shards)
    out = byte_bpe.decode(tokens.withColumn("kept", F.col("ids")), byte_bpe.token_table(spark, byte_bpe.ranks_file())).collect()
    want = [(i, len(plain(t)) // 4, plain(t), (t or "").encode()) for i, t in texts()]
    assert sorted(((r.doc_id, r.n_tokens, bytes(r.kept), bytes(r.decoded)) for r in out), key=repr) == sorted(want, key=repr)


def test_steps_of_long_texts(spark, docs, monkeypatch):
    monkeypatch.setattr(byte_bpe, "STEP", 7)
    tokens = byte_bpe.encode(docs.where("doc_id IN (5, 99)"), byte_bpe.ranks_file())
    out = byte_bpe.decode(tokens.withColumn("kept", F.col("ids")), byte_bpe.token_table(spark, byte_bpe.ranks_file())).collect()
    kept = {i: t for i, t in texts() if i in (5, 99)}
    assert {r.doc_id: (bytes(r.kept), bytes(r.decoded)) for r in out} == {i: (plain(t), t.encode()) for i, t in kept.items()}


def test_a_word_is_encoded_once(spark, docs):
    """A segment sends each distinct word once, whatever its frequency."""
    cut = byte_bpe.segments(docs.where("doc_id = 5"), byte_bpe.pattern())
    (row,) = cut.collect()
    assert list(row["n"]) == [len(byte_bpe.Splitter(byte_bpe.pattern(), byte_bpe.pattern())("the the the " * 2000))]
    assert sorted(w for b in row["words"] for w in bytes(b).split(b"\xff")[:-1]) == [b" ", b" the", b"the"]


def test_joined_decoding_equals_sent(spark, docs):
    tokens = byte_bpe.encode(docs.where("doc_id < 30 OR doc_id IS NULL"), byte_bpe.ranks_file())
    table = byte_bpe.token_table(spark, byte_bpe.ranks_file())
    key = lambda df: sorted(((r.doc_id, r.n_tokens, bytes(r.decoded)) for r in df.collect()), key=repr)
    assert key(byte_bpe.decode(tokens, table, most=10)) == key(byte_bpe.decode(tokens, table))


@pytest.mark.parametrize("most", [10, byte_bpe.VOCABULARY])
def test_encoding_decodes_in_the_same_workers(spark, docs, most):
    """The query's last tasks each held two Python workers, one to gather ids and one to decode them."""
    both = byte_bpe.encode(docs, byte_bpe.ranks_file(), vocabulary=byte_bpe.token_table(spark, byte_bpe.ranks_file()), most=most)
    assert both.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    want = [(i, len(plain(t)) // 4, plain(t), (t or "").encode()) for i, t in texts()]
    assert sorted(((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in both.collect()), key=repr) == sorted(want, key=repr)
    plan = byte_bpe.op13_byte_bpe(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2  # words' ids, then texts


def test_unknown_id_is_an_error(spark):
    tokens = spark.createDataFrame([(1, 1, bytearray(np.array([60000], "<u4").tobytes()))], "doc_id long, n_tokens long, ids binary")
    table = byte_bpe.token_table(spark, byte_bpe.ranks_file())
    for most in (10, byte_bpe.VOCABULARY):
        with pytest.raises(Exception, match="doesn't have"):
            byte_bpe.decode(tokens, table, most=most).collect()


def test_another_pattern(spark, docs):
    import tiktoken

    pat = r"\S+|\s+"
    own = byte_bpe.encoding(open(byte_bpe.ranks_file(), "rb").read(), pat)
    assert isinstance(own, tiktoken.Encoding)
    got = byte_bpe.encode(docs.where("doc_id = 99"), byte_bpe.ranks_file(), pattern=pat).first()
    text = dict(texts())[99]
    assert bytes(got["ids"]) == np.array(own.encode_ordinary(text), "<u4").tobytes()


def test_empty_table(spark):
    none = byte_bpe.encode(spark.createDataFrame([], SCHEMA), byte_bpe.ranks_file())
    assert byte_bpe.decode(none, byte_bpe.token_table(spark, byte_bpe.ranks_file())).count() == 0
