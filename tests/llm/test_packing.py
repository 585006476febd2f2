import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_pieces_rebuild_documents_and_fill_sequences(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = packing.pack_documents(docs, PATH).toPandas()
    tokenizer = Tokenizer.from_file(PATH)
    for r in docs.collect():
        ids = array("I", [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1])
        pieces = got[got.doc_id == r.doc_id].sort_values("start")
        assert (pieces.doc_tokens == len(ids)).all()
        at = 0
        for p in pieces.itertuples():
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= packing.WINDOW
    padding = 1 - got.length.sum() / (got.sequence_id.nunique() * packing.WINDOW)
    assert padding < 0.03


def test_cached_chunks_equal_the_tokenizer():
    rng = np.random.default_rng(3)
    encoder, tokenizer = packing.encoder(PATH), Tokenizer.from_file(PATH)
    alphabet = list("aB'sé \t\n\x0b\x85\xa0,.!|1²ß$<|>_-ñÇ\x1bİtm're Σς中😀́")
    for _ in range(2000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 25)))
        assert encoder.encode(text) == array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes(), repr(text)
    special = "a <|endoftext|> b"
    assert encoder.encode(special) == array("I", tokenizer.encode(special, add_special_tokens=False).ids).tobytes()


@pytest.mark.parametrize("windows", [1, 2, 5])
def test_differencing_keeps_all_and_balances(windows):
    lengths = np.sort(np.random.default_rng(windows).integers(1, 500, 200))[::-1]
    of = packing.balance(lengths, windows)
    sums = np.bincount(of, weights=lengths, minlength=windows)
    assert sums.sum() == lengths.sum() and sums.max() - sums.min() <= 5


def test_window_count_rises_when_capacity_is_exceeded():
    of = packing.fill_windows(np.array([1500, 1500, 1000]), 2048)  # 4000 ids would be two windows
    assert sorted(np.bincount(of)) == [1, 1, 1]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (3, "x"), (None, "y " * 9000)], "doc_id long, text string").selectExpr("*", "1 as shard", "2 as start")
    got = packing.pack_documents(docs, PATH).toPandas()
    assert got[got.doc_id.isin([1, 2])].length.tolist() == [1, 1]
    assert (got.doc_id == 3).sum() == 2 and got[got.doc_id.isna()].length.sum() == 9001
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]]
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0
