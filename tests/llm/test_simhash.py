import random

import pytest
import xxhash

from gridledger.llm import simhash
from gridledger.llm.shared import components


def brute_fp(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids, bits=3):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(fps))]


@pytest.mark.parametrize("which", ["edge_docs", "few_docs", "no_docs"])
def test_whole_query_against_brute_force(request, which):
    docs = request.getfixturevalue(which)
    rows = docs.select("doc_id", "text").collect()
    fps = [brute_fp(r.text) for r in rows]
    want = sorted(zip([r.doc_id for r in rows], [f"{x:016x}" for x in fps], brute_components(fps, [r.doc_id for r in rows])))
    assert sorted(map(tuple, simhash.simhash_components(docs).collect())) == want


@pytest.mark.parametrize("chunk", [3, 512])
def test_links_lose_none_in_large_buckets(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(60)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(5)
    roots = {r.node: r.root for r in components(simhash.link_edges(df)).collect()}
    got = [roots.get(x, x) for x in signed]
    want = brute_components(fps, signed)
    pairs = lambda label: {(i, j) for i in range(len(label)) for j in range(i) if label[i] == label[j]}
    assert pairs(got) == pairs(want)


def test_every_plan_covers_all_pairs():
    for n in (0, 10**6, 10**9, 10**11):
        blocks, used = simhash.plan_blocks(n)
        assert blocks - used == 3


def test_drop_keeps_one_of_each_component(edge_docs):
    kept = simhash.drop_near_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns
    comp = {r.component_id for r in simhash.simhash_components(edge_docs).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(comp)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (400, 400)], "a long, b long")
    roots = {r.node: r.root for r in components(edges).collect()}
    assert roots == {i: 0 for i in range(201)} | {400: 400, 500: 400}


def test_null_ids_are_carried(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (3, "zz yy xx ww vv")], "doc_id long, text string")
    rows = simhash.simhash_components(docs).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in rows if r.doc_id) == [(False, 3)]
    assert len(rows) == 3
    assert simhash.drop_near_duplicates(docs).count() == 2
