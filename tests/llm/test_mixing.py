import re
from collections import defaultdict

import numpy as np
import pytest

from gridledger.llm import mixing


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("which", ["edge_docs", "few_docs"])
@pytest.mark.parametrize("block", [2, 1024])
def test_quotas_and_digest(request, monkeypatch, which, block):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", block)
    docs = request.getfixturevalue(which)
    rows = docs.collect()
    size = defaultdict(int)
    for r in rows:
        size[r.source] += words(r.text)
    mixed = mixing.mix(docs, shards=5)
    got = mixed.collect()
    assert sorted((r.doc_id, r.source or "", r["size"]) for r in got) == sorted((r.doc_id, r.source or "", words(r.text)) for r in rows)
    total, took = sum(size.values()), defaultdict(int)
    target = {r.source: r.target for r in got}
    assert abs(sum(target.values()) - total) < 1e-6 * total
    for r in got:
        took[r.source] += sum(c.words for c in r.copies)
        assert sum(c.words for c in r.copies) <= 3 * r["size"]
        assert r.source_size == size[r.source] and all(0 <= c.shard < 5 for c in r.copies)
    for s, t in target.items():
        assert abs(took[s] - t) <= 0.5
        assert t <= 3 * size[s] + 1e-9
    again = sorted(map(str, mixing.mix(docs.repartition(7), shards=5).collect()))
    assert again == sorted(map(str, got))


@pytest.mark.parametrize("which", ["edge_docs", "few_docs"])
def test_shards_against_a_brute_force_tree(request, spark, monkeypatch, which):
    """Every draw of every block lies in the shard that one list of all draws of its source, cut at the tree's quotas, gives; taken is what the shards hold."""
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 3)
    monkeypatch.setattr(mixing, "TILE", 4)
    monkeypatch.setattr(mixing, "PREFIX", 5)
    docs = request.getfixturevalue(which)
    mixed = mixing.mix(docs, shards=5).collect()
    taken = mixing.taken(mixing.mix(docs, shards=5)).collect()
    assert sorted((r.doc_id, r.taken, r.shards) for r in taken) == sorted((r.doc_id, sum(c.words for c in r.copies), sorted(c.shard for c in r.copies)) for r in mixed)
    size = defaultdict(int)
    for r in mixed:
        size[r.source] += r["size"]
    whole = {r.source: int(r.target + 0.5) // size[r.source] if size[r.source] else 0 for r in mixed}
    rest = {r.source: int(r.target + 0.5) - whole[r.source] * size[r.source] for r in mixed}
    number = {r.source: r.s for r in mixed}
    blocks = defaultdict(lambda: defaultdict(int))
    for r in mixed:
        blocks[r.source][r.block] += r["size"]
    draws = defaultdict(list)
    for source, own in blocks.items():
        start = 0
        for b in sorted(own):
            draws[number[source]] += [(number[source], b, c) for c in range(whole[source] + (start < rest[source]))]
            start += own[b]
    every = [d for own in draws.values() for d in own]
    order = {tuple(r)[:3]: r.h for r in spark.createDataFrame(every, "s int, block bigint, copy bigint").selectExpr("s", "block", "copy", "xxhash64(s, block, copy, 17) as h").collect()}
    leaf = mixing.split_quotas(np.array([len(draws[i]) for i in range(len(number))]), 5, 17)
    want = {}
    for s, own in draws.items():
        own.sort(key=lambda d: (order[d], d))
        ends = leaf[:, s].cumsum()
        for rank, d in enumerate(own):
            want[d] = int(np.searchsorted(ends, rank, "right"))
    held = {(r.s, r.block, c.copy): c.shard for r in mixed for c in r.copies}
    assert held and all(want[d] == shard for d, shard in held.items())
    assert all((r.s, r.block, c) in held for r in mixed if r["size"] for c in range(whole[r.source]))


def test_target_shares():
    assert mixing.targets({"a": 100, "b": 100, "c": 100, None: 100}) == pytest.approx({"a": 400 * 5 / 13, "b": 400 * 2 / 13, "c": 400 / 13, None: 400 * 5 / 13})
    capped = mixing.targets({"a": 1, "b": 99})
    assert capped == pytest.approx({"a": 3, "b": 97})
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0}


def test_splitting_tree_is_exact_and_fair():
    q = np.array([1000, 10, 0, 333])
    leaf = mixing.split_quotas(q, 7, 3)
    assert (leaf.sum(0) == q).all() and (leaf >= 0).all()
    assert leaf.sum(1).max() - leaf.sum(1).min() <= 3
    assert mixing.split_quotas(np.array([], np.int64), 3, 1).shape == (3, 0)


def test_empty(no_docs):
    assert mixing.taken(mixing.mix(no_docs)).count() == 0
