import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridledger.llm import token_files as tf

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", " a", "a ", "a  b", "a   b  ", "foo\n bar", "foo \n bar", "foo\n  bar", "\n", "x" * 3000, "\x00z \x00q", "foo\n ", "don't  it's", "<|endoftext|> x", "a  b", "a  b", "tab\t\tx \t y"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_chunks_give_the_ids_of_whole_texts(library, few_docs):
    encoder = tf.ChunkEncoder(PATH)
    texts = ODD + [r.text for r in few_docs.select("text").limit(60).collect()]
    for _ in range(2):
        assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_memory_of_chunks_turns_over(library, monkeypatch):
    monkeypatch.setattr(tf, "REMEMBER", 3)
    encoder = tf.ChunkEncoder(PATH)
    for k in range(6):
        t = " ".join(f"word{i}" for i in range(k, k + 5))
        assert np.frombuffer(encoder.encode([t])[0], encoder.dtype).tolist() == library.encode(t, add_special_tokens=False).ids
    assert len(encoder.young) + len(encoder.old) < 20


@pytest.mark.parametrize("which", ["edge_docs", "few_docs", "no_docs"])
def test_round_trip_against_the_library(request, which, library):
    docs = request.getfixturevalue(which)
    start, want = 0, []
    for r in sorted(docs.select("doc_id", "text").collect(), key=lambda r: r.doc_id):
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [0]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, tf.token_round_trip(docs, PATH, shards=5).collect())) == want


def test_null_ids_come_first(spark):
    docs = spark.createDataFrame([(2, "b"), (None, "a"), (-7, None)], "doc_id long, text string")
    assert [(r.doc_id, r.start) for r in sorted(tf.token_round_trip(docs, PATH).collect(), key=lambda r: r.start)] == [(None, 0), (-7, 2), (2, 3)]
