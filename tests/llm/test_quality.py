import math
import re
import zlib
from collections import Counter

import pytest

from gridledger.llm import quality as q


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_base(t):
    w = words(t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = [], 0
    for line in (t or "").split("\n"):
        dup += bool(words(line)) and line in seen
        seen.append(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(hit)


def brute_buckets(t):
    w = [x.encode() for x in words(t)]
    h = [zlib.crc32(x) for x in w]
    out = [x % q.BUCKETS for x in h]
    for a, b in zip(h, h[1:]):
        p = (a * 0x9E3779B1 & 0xFFFFFFFF) ^ (b + 0x7F4A7C15 & 0xFFFFFFFF)
        out.append((p ^ p >> 15) % q.BUCKETS + q.BUCKETS)
    return out


@pytest.mark.parametrize("which", ["edge_docs", "few_docs", "no_docs"])
def test_against_brute_force(spark, request, which):
    docs = request.getfixturevalue(which)
    rows = docs.select("doc_id", "text").collect()
    good = {r.doc_id for r in rows if r.doc_id % 3 == 0}
    labels = spark.createDataFrame([(i,) for i in sorted(good)] + [(None,), (-5,)], "doc_id long")
    count = [Counter(), Counter()]
    for r in rows:
        for k in (0, 1) if r.doc_id in good else (0,):
            count[k].update(brute_buckets(r.text))
    total = [[sum(c[b] for b in range(s * q.BUCKETS, (s + 1) * q.BUCKETS)) + q.BUCKETS for s in (0, 1)] for c in count]
    ratio = lambda b: math.log((count[1][b] + 1) / total[1][b // q.BUCKETS]) - math.log((count[0][b] + 1) / total[0][b // q.BUCKETS])
    want = {}
    for r in rows:
        base, b = brute_base(r.text), brute_buckets(r.text)
        score = sum(map(ratio, b)) / len(b) if b else 0.0
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        want[r.doc_id] = (*base, failed, not failed and score >= q.THRESHOLD, pytest.approx(score, abs=1e-9))
    got = q.judge(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == want[r.doc_id]


def test_no_target_documents(spark, edge_docs):
    assert q.judge(edge_docs, spark.createDataFrame([], "doc_id long")).count() == edge_docs.count()


def test_many_distinct_words():
    text = " ".join(f"w{i}" for i in range(4000)) + " w1 w2 w3"
    assert q.base_rules(text.encode(), text.encode().split())[3] == 6
