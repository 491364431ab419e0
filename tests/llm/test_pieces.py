import zlib

import numpy as np
import public_tokenizers
import pytest

from gridledger.llm import pieces as p

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", " a", "a ", "a  b", "a   b  ", "\n\tx", "y" * 300, "ab▁cd ▁ e", "\U0001f600 ünï ça", "日本語 テスト", "a" + " " * 40 + "b"]


@pytest.fixture(scope="module")
def encoder():
    return p.Encoder(p.load_vocabulary(PATH))


def brute_score(v, full, text):
    s = ("▁" + text.replace("▁", "￿").replace(" ", "▁")) if text else ""
    best = [0.0] + [-1e300] * len(s)
    for i in range(len(s)):
        for n in range(1, min(24, len(s) - i) + 1):
            if (k := full.get(s[i : i + n].encode())) is not None:
                best[i + n] = max(best[i + n], best[i] + v.score[k])
        if s[i].encode() not in full:
            best[i + 1] = max(best[i + 1], best[i] + v.unknown)
    return best[-1]


def own_score(v, ids):
    byte, at, total = set(v.byte_id.tolist()), 0, 0.0
    while at < len(ids):
        if ids[at] in byte:
            lead = v.raw[ids[at]][0]
            total, at = total + v.unknown, at + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
        else:
            total, at = total + v.score[ids[at]], at + 1
    return total


def test_viterbi_is_the_best_path_and_decodes(encoder, few_docs):
    v = encoder.v
    full = {x: i for i, x in enumerate(v.raw) if x and i not in set(v.byte_id.tolist())}
    texts = ODD + [r.text[:1500] for r in few_docs.select("text").limit(25).collect()]
    for t, ids in zip(texts, encoder.encode([t.encode() for t in texts])):
        assert encoder.decode(ids) == t.encode()
        assert own_score(v, ids.tolist()) == pytest.approx(brute_score(v, full, t), abs=1e-6)


def test_trie_holds_exactly_its_pieces(encoder):
    v = encoder.v

    def find(b):
        node = 1
        for c in b:
            if v.check[v.base[node] + c] != node:
                return -1
            node = v.base[node] + c
        return v.piece_at[node]

    byte = set(v.byte_id.tolist())
    normal = [i for i in range(len(v.raw)) if v.raw[i] and i not in byte]
    assert all(v.raw[find(v.raw[i])] == v.raw[i] for i in normal)
    assert find(b"qzxqzx") == -1


def test_long_words_like_short_ones(encoder):
    w = ("▁" + "abc" * 60 + "üß" * 9).encode()
    assert np.array_equal(p.viterbi(encoder.v, [w])[0], p.viterbi_long(encoder.v, w))


@pytest.mark.parametrize("which", ["edge_docs", "few_docs", "no_docs"])
def test_documents_round_trip(request, which):
    docs = request.getfixturevalue(which)
    encoded = p.encode_documents(docs, PATH)
    rows = encoded.collect()
    assert len(rows) == docs.count() and all(r.round_trip and r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.n_pieces for r in rows)
    back = p.decode_documents(encoded, PATH).collect()
    assert sorted(map(tuple, back)) == sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
