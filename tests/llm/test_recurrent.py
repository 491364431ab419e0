import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gridledger.llm import recurrent as r


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(r, "PAGE_TOKENS", 3000)
    monkeypatch.setattr(r, "CHUNK_BYTES", 60_000)
    monkeypatch.setattr(r, "TOGETHER", 9000)


def tokens(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", t) + ["\0end"]


def learns(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 != 1


@pytest.mark.parametrize("which", ["edge_docs", "few_docs", "no_docs"])
def test_counts_and_base_against_brute_force(request, small, which):
    docs = request.getfixturevalue(which)
    rows = docs.select("doc_id", "text").collect()
    c = Counter(x for q in rows if learns(q.doc_id) for x in tokens(q.text))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for q in rows:
        t = tokens(q.text)
        want[q.doc_id, not learns(q.doc_id), len(t), sum(c[x] > 0 for x in t), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), 5)] += 1
    got = r.score(docs).collect()
    assert Counter((q.doc_id, q.held_out, q.n_tokens, q.n_known, q.train_tokens, round(q.base_score, 5)) for q in got) == want
    assert all(q.score < 0 and math.isfinite(q.score) for q in got)
    if which == "few_docs":  # the model beats the unigram on rows that it did not learn from
        held = [q for q in got if q.held_out]
        assert sum(q.score for q in held) > sum(q.base_score for q in held)


def test_score_against_brute_force(spark, small, monkeypatch):
    """The whole score, from the words and their counts, one token after the other, with the weights that the job ended with."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % (5 + j % 23)}" for j in range(3 * i))) for i in range(40)], "doc_id long, text string").repartition(2)
    ended = []
    averaged = r.averaged
    monkeypatch.setattr(r, "averaged", lambda *a: ended.append(averaged(*a)) or ended[-1])
    got = {q.doc_id: q.score for q in r.score(docs).collect()}
    p = {k: v.astype(float) for k, v in ended[-1].items()}
    c = Counter(x.encode() for q in docs.collect() if learns(q.doc_id) for x in tokens(q.text)[:-1])
    layout = r.Layout.of(len(c))
    import xxhash

    sign = lambda w: np.frombuffer(xxhash.xxh3_128_digest(w), "<i8")[0]
    ranked = sorted(c, key=lambda w: (-c[w], sign(w)))
    head, least = ranked[: layout.head], c[ranked[layout.head - 1]]
    tail = {w: int(sign(w) if c[w] >= least else r.shape_of(w)) % layout.tails for w in ranked[layout.head :]}
    mass = Counter()
    for w, k in tail.items():
        mass[k] += c[w] + 0.5
    for q in docs.collect():
        h, last, total = np.zeros((1, r.HIDDEN)), r.END, 0.0
        for w in [x.encode() for x in tokens(q.text)[:-1]] + [None]:
            s = r.END if w is None else 2 + head.index(w) if w in head else 2 + layout.head + tail[w] if w in tail else r.UNKNOWN
            h, *_ = r.step(p, h, np.array([last]))
            total += r.log_probability(p, layout, h, np.array([s]))[0]
            total += math.log((c[w] + 0.5) / mass[tail[w]]) if w in tail else 0
            last = s
        assert got[q.doc_id] == pytest.approx(total / math.log(10), rel=1e-4, abs=1e-3)


def test_reruns_agree(few_docs, small):
    assert sorted(r.score(few_docs).collect()) == sorted(r.score(few_docs).collect())


def test_null_ids_clashing_columns_and_repeated_rows(spark, small):
    rows = [(None, "a b", 1, 2, "x"), (0, "a b c", 1, 2, "x"), (1, None, 1, 2, "x"), (0, "a b c", 1, 2, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk int, LEARN int, score string")
    got = r.score(docs).collect()
    assert {q.doc_id: q.held_out for q in got}[None] is True
    assert len({q.score for q in got if q.doc_id == 0}) == 1 and len(got) == 4


def test_only_held_out_rows(spark, small):
    docs = spark.createDataFrame([(None, "a b"), (None, "")], "doc_id long, text string")
    assert [(q.n_tokens, q.n_known, q.train_tokens, math.isfinite(q.score)) for q in sorted(r.score(docs).collect(), key=lambda q: -q.n_tokens)] == [(3, 0, 0, True), (1, 0, 0, True)]


def test_every_token_trains(monkeypatch):
    """Flushes leave nothing out, whatever the lengths."""
    rng, layout, p = model()
    monkeypatch.setattr(r, "STREAMS", 7)
    monkeypatch.setattr(r, "WINDOW", 5)
    t = r.Trainer({k: v.astype(np.float32) for k, v in p.items()}, layout, 1e-3)
    lengths = rng.integers(1, 300, 60)
    for n in lengths:
        t.add(np.r_[rng.integers(2, layout.symbols, n - 1), r.END])
    t.flush()
    assert t.tokens == lengths.sum()


def test_the_model_grows_with_the_corpus():
    small, large = r.Layout.of(10_000), r.Layout.of(1_000_000)
    assert large.head > 5 * small.head and large.classes > 2 * small.classes and large.tails > 5 * small.tails
    assert all(r.Layout.of(n).head <= n for n in range(5))


def model():
    rng = np.random.default_rng(0)
    layout = r.Layout(14, 5, 4)
    p = {k: v.astype(float) for k, v in r.initial(layout, np.ones(layout.symbols) * 5).items()}
    p["c"] += rng.normal(0, 0.3, p["c"].shape)
    p["w"] += rng.normal(0, 0.3, p["w"].shape)
    return rng, layout, p


def test_gradients():
    rng, layout, p = model()
    xs, ys = (rng.integers(0, layout.symbols, (6, 3)) for _ in range(2))
    ys[4, 2] = -1
    h0, fresh = rng.normal(0, 0.1, (3, r.HIDDEN)), rng.random((6, 3)) < 0.2
    loss = lambda: r.backward(p, layout, h0, xs, ys, fresh)[0]
    g = r.backward(p, layout, h0, xs, ys, fresh)[1]
    whole = np.zeros_like(p["x"])
    whole[g["x"][0]] = g["x"][1]
    g["x"] = whole
    for k in p:
        for _ in range(4):
            i = tuple(int(rng.integers(0, s)) for s in p[k].shape)
            i = (int(xs[2, 1]), *i[1:]) if k == "x" else (int(ys[1, 1]), *i[1:]) if k in ("w",) else i
            old, e = p[k][i], 1e-4
            p[k][i] = old + e
            up = loss()
            p[k][i] = old - e
            down = loss()
            p[k][i] = old
            assert g[k][i] == pytest.approx((up - down) / 2 / e, rel=1e-3, abs=1e-6), k


def test_probabilities_sum_to_one():
    rng, layout, p = model()
    h = rng.normal(0, 1, (1, r.HIDDEN))
    assert np.exp([r.log_probability(p, layout, h, np.array([s]))[0] for s in range(layout.symbols)]).sum() == pytest.approx(1)


def test_state_is_carried_over_windows(monkeypatch):
    rng, layout, p = model()
    p = {k: v.astype(np.float32) for k, v in p.items()}
    docs = [rng.integers(1, layout.symbols, n) for n in (1, 40, 7, 33)]
    whole = r.score_documents(p, layout, docs)
    monkeypatch.setattr(r, "WINDOW", 5)
    monkeypatch.setattr(r, "LANES", 2)
    assert np.allclose(r.score_documents(p, layout, docs), whole, atol=1e-3)
    h, last, total = np.zeros((1, r.HIDDEN), np.float32), r.END, 0.0
    for s in docs[1]:
        h, *_ = r.step(p, h, np.array([last]))
        total += r.log_probability(p, layout, h, np.array([s]))[0]
        last = s
    assert total == pytest.approx(whole[1], abs=1e-3)
