import random

import numpy as np
import pytest

from gridledger.llm import embedding_join as ej

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def brute(rows, cosine):
    ok = [i for i, (v, e, lab) in enumerate(rows) if v is not None and lab is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    n, label = [0] * len(rows), list(range(len(rows)))
    for i in ok:
        for j in ok:
            a, b = (np.array(rows[k][1], np.float32).astype(float) for k in (i, j))
            if i < j and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                n[i] += 1
                n[j] += 1
                x, y = label[i], label[j]
                label = [min(x, y) if k in (x, y) else k for k in label]
    least = {}
    for i, k in enumerate(label):
        if rows[i][0] is not None:
            least[k] = min(least.get(k, rows[i][0]), rows[i][0])
    return sorted((str(rows[i][0]), n[i], str(least.get(label[i])), rows[i][0] == least.get(label[i])) for i in range(len(rows)))


@pytest.mark.parametrize("interval", [3, 1024])
def test_against_brute_force(spark, monkeypatch, interval):
    monkeypatch.setattr(ej, "INTERVAL", interval)
    monkeypatch.setattr(ej, "BLOCK", 2 if interval == 3 else 256)
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(k, [x + rng.gauss(0, 0.15) for x in rng.choice(centres)], rng.choice([0, 1, None])) for k in range(70)]
    copy = rows[0][1]
    rows += [(100 + k, copy, 0) for k in range(4)] + [(104, copy, 0), (104, copy, 0)]
    rows += [(200, None, 0), (201, [0.0] * 6, 0), (202, [float("nan")] * 6, 0), (203, [None, 1.0], 0), (204, [], 0), (205, [1.0, 2.0], 0), (206, [2.0, 4.0], 0), (None, copy, 0), (207, [float("inf")] * 6, 1), (208, [1e30] * 6, 1), (209, [1e-30] * 6, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(4)
    got = ej.near_duplicates(df, 0.93).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got if r.vec_id is not None) == [x for x in brute(rows, 0.93) if x[0] != "None"]
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]


def test_empty(spark):
    assert ej.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recursive_join_skips_only_far_intervals():
    rng = np.random.default_rng(1)
    lo = np.sort(rng.random((40, 2)), 0)
    hi = lo + 0.01
    got = set(ej.join_intervals(lo, hi, 0.1))
    for i in range(40):
        for j in range(i, 40):
            gap = np.maximum(0, np.maximum(lo[i] - hi[j], lo[j] - hi[i]))
            if (gap @ gap) ** 0.5 <= 0.1:
                assert (i, j) in got
    assert len(got) < 40 * 41 // 2
