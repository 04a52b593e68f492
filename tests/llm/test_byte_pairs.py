"""Byte-level BPE against the library that the vocabulary files are made for."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from skein.llm import byte_pairs
from tests.llm.cases import documents, frame, with_extra

PATH = f"{byte_pairs.TOKENIZERS}/{byte_pairs.VOCABULARY}"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=byte_pairs.default_pattern(), mergeable_ranks=byte_pairs.ranks(PATH).rank, special_tokens={})


def every_character() -> str:
    return "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)


def test_equal_to_the_library(spark, library):
    r = random.Random(11)
    odd = ["hello world's  it'll be\n\n  x ", " " * 1000 + "x", "<|endoftext|> 123 ４５٣", "x" * 700, "acgt" * 300, "".join(r.choices(every_character(), k=2000)), "ab\u0085c　 d\x1f\x0b"]
    rows = [*documents(), *((100 + k, t, None, None, 0) for k, t in enumerate(odd))]
    rows = [(k, *x[1:]) for k, x in enumerate(rows)]
    got = byte_pairs.decode(byte_pairs.encode(with_extra(frame(spark, rows)).withColumn("token_ids", F.lit("old")))).collect()
    assert len(got) == len(rows)
    for x in got:
        text = rows[x.doc_id][1] or ""
        assert x.token_ids == library.encode_ordinary(text)
        assert bytes(x.decoded) == text.encode()
        assert x.score == "x"


def test_short_and_long_words_agree(spark, library, monkeypatch):
    texts = [(k, t) for k, (_, t, *_) in enumerate(documents()) if t and len(t) < 3000]
    monkeypatch.setattr(byte_pairs, "SHORT", 3)
    monkeypatch.setattr(byte_pairs, "BLOCK", 400)
    monkeypatch.setattr(byte_pairs, "DEALT", 20)
    monkeypatch.setattr(byte_pairs, "KNOWN", 50)
    monkeypatch.setattr(byte_pairs, "SPLITS", 100)
    for x in byte_pairs.encode(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        assert x.token_ids == library.encode_ordinary(x.text)


def test_classes_are_those_of_the_library(spark):
    every = every_character()
    df = spark.createDataFrame([(every,)], "t string")
    for cls in (r"\p{L}", r"\p{N}", r"\s", r"[^\s\p{L}\p{N}]"):
        e = tiktoken.Encoding("c", pat_str=cls, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        want = bytes(e.encode_ordinary(every)).decode()
        found = F.regexp_extract_all("t", F.lit(byte_pairs.java_pattern(cls)), F.lit(0))
        assert df.select(F.array_join(found, "")).first()[0] == want


def test_vocabularies_that_merge_in_another_order_are_refused(tmp_path):
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"ab"]
    (tmp_path / "v").write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % k for k, t in enumerate(tokens)))
    with pytest.raises(ValueError, match="order of their ranks"):
        byte_pairs.Ranks(str(tmp_path / "v"))


def test_empty_table_and_null_ids(spark):
    assert byte_pairs.encode(frame(spark, [])).columns[-1] == "token_ids"
    assert byte_pairs.encode(frame(spark, [])).count() == 0
    ids = spark.createDataFrame([(1, None), (2, []), (3, [0, 10**6, None])], "k int, token_ids array<int>")
    got = {x.k: x.decoded for x in byte_pairs.decode(ids).collect()}
    assert got[1] is None and bytes(got[2]) == b"" and bytes(got[3]) == byte_pairs.ranks(PATH).pieces[0]


def test_query_over_whole_table(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = byte_pairs.op11_byte_pairs(spark, sf).collect()
    assert len(got) == len(texts)
    for x in got:
        ids = np.array(library.encode_ordinary(texts[x.doc_id]), "<u4")
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[x.doc_id].encode()).hexdigest())
