import functools
import zlib

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from convlake.llm.token_ids import op5_token_ids, read_document, read_token_ids, write_token_ids
from convlake.llm.tokens import Encoder

from .data import SF, awkward, clashing, table

PATH = P.path("byte_bpe_50k.json")


@functools.lru_cache
def untouched(path):
    return Tokenizer.from_file(path)


def plain(text, end=2, path=PATH):
    return untouched(path).encode(text or "", add_special_tokens=False).ids + [end]


def test_encoder_is_the_library():
    texts = [t or "" for _, t, *_ in awkward()] + [" lead", "trail ", "a\n b", "x \ny", "a\tb c", "it's 'n' 12 3", "\x1c x y", " ", "  ", "a  b", "x<|endoftext|>y", "<|EndOfText|>", "a <|startoftext|> b", "<unk> <s> </s> [UNK]", "a < b"]
    for name, spaces in (("byte_bpe_50k.json", "join"), ("word_bpe_49k.json", "drop")):
        enc = Encoder(P.path(name), spaces)
        for _ in range(2):
            got = [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)]
            assert got == [untouched(P.path(name)).encode(t, add_special_tokens=False).ids for t in texts]


def test_round_trip(spark, tmp_path):
    docs = clashing(table(spark))
    write_token_ids(docs, str(tmp_path / "x"), PATH, partitions=3)
    rows = read_token_ids(spark, str(tmp_path / "x"), with_ids=True).orderBy("start").collect()
    assert len(rows) == len(awkward())
    key = lambda x: (x[0] is not None, x[0] or 0)
    assert [r.doc_id for r in rows] == [d for d, *_ in sorted(awkward(), key=key)]
    assert sorted((key((r.doc_id,)), r.ids) for r in rows) == sorted((key((d,)), plain(t)) for d, t, *_ in awkward())
    at = 0
    for r in rows:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        at += r.n_tokens
    assert read_document(spark, str(tmp_path / "x"), 7) == [plain("<|endoftext|> stays text, it's")]
    assert read_document(spark, str(tmp_path / "x"), 5) == [plain("same text here")] * 2
    assert read_document(spark, str(tmp_path / "x"), 999) == []


def test_empty_table(spark, tmp_path):
    write_token_ids(table(spark, []), str(tmp_path / "y"), PATH)
    assert read_token_ids(spark, str(tmp_path / "y")).count() == 0


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in op5_token_ids(spark, SF).collect()}
    at = 0
    for r in docs.orderBy(F.col("doc_id")).collect():
        ids = plain(r.text)
        x = got.pop(r.doc_id)
        assert (x.start, x.n_tokens, x.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    assert not got
