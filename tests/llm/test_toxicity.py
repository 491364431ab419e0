import zlib
from itertools import combinations

import numpy as np
import pytest

from gridledger.llm import toxicity as t


def brute_kernel(a, b, lam=0.6, n=3):
    total = 0.0
    for i in combinations(range(len(a)), n):
        for j in combinations(range(len(b)), n):
            if all(a[x] == b[y] for x, y in zip(i, j)):
                total += lam ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_kernel_against_enumeration():
    words, marks = ["idiot", "id-iot", "xx", "banana", "ab", "ünïcödé"], ["idiot", "banana", "cödé"]
    assert np.allclose(t.kernel(words, marks), [[brute_kernel(a, b) for b in marks] for a in words], atol=1e-5)
    assert np.allclose(t.self_kernel(words), [brute_kernel(a, a) for a in words], atol=1e-5)


def test_gaps_and_insertions_lower_the_kernel_but_do_not_end_it():
    own = t.self_kernel(["idiot"])
    same, gap, other = t.normalised(["idiot", "idxiot", "banana"], ["idiot"], own)[:, 0]
    assert same == pytest.approx(1, abs=1e-5) and 0.5 < gap < 1 and other < 0.05


def test_words():
    assert t.plain('"Idiot!"') == ["idiot"] and t.plain("***") == [""]
    assert all(len(w) <= t.LONG for w in t.plain("x" * 100)) and "".join(dict.fromkeys("".join(t.plain("abc" * 40)))) == "abc"
    assert "idiot" in t.words_of("you i d i o t now")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.1/labels.parquet")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet")


@pytest.fixture(scope="module")
def judged(docs, labels):
    return {r.doc_id: r for r in t.judge(docs, labels).collect()}


def test_held_out_accuracy(judged, labels):
    rows = [(judged[r.doc_id], r.toxic) for r in labels.collect() if judged[r.doc_id].held_out]
    bad, good = [r.score for r, y in rows if y], [r.score for r, y in rows if not y]
    assert sum(b > g for b in bad for g in good) / len(bad) / len(good) > 0.85
    assert sum(r.predicted for r, y in rows if not y) <= 0.03 * len(good)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in judged.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in judged.items())


def test_edges(spark, edge_docs, no_docs, docs, labels, judged):
    assert len(judged) == docs.count()
    none = spark.createDataFrame([], labels.schema)
    rows = t.judge(edge_docs, none).collect()
    assert len(rows) == edge_docs.count() and all(r.score < 0.3 and r.predicted == 0 for r in rows)
    odd = spark.createDataFrame([(9003, None, 1), (None, 1, 1), (9004, 1, 1), (9004, 1, 0)], "doc_id long, quality int, toxic int")
    assert t.judge(edge_docs, odd).count() == edge_docs.count()
    assert t.judge(no_docs, odd).count() == 0


def test_drop_keeps_columns_and_clean_rows(docs, labels, judged):
    wide = docs.limit(120).selectExpr("*", "1.5 as score", "'m' as MARGIN")
    kept = t.drop_toxic(wide, labels)
    assert kept.columns == wide.columns
    assert kept.where("score = 1.5").count() == kept.count() > 0


def test_every_document_and_word_is_mined(spark):
    """The insult stands behind 500 other words, and in more documents than 600."""
    seen = spark.createDataFrame([(f"a{i}xy", 1, 7) for i in range(500)] + [("zidiot", 1, 7)] + [(f"idiot{k}", 1, k) for k in range(100, 800)], "word string, toxic int, doc bigint")
    counts = seen.groupBy("word").agg(t.F.lit(1).alias("t"), t.F.lit(0).alias("c"))
    lone = t.lone_words(seen, counts)
    own = t.self_kernel(["idiot"])
    got = t.best_words(lone, t.Machine(["idiot"], own, np.array([4.0]), -0.8), ["idiot105"])
    assert got[0] == "zidiot" and got[1:] == [f"idiot{k}" for k in range(100, 800) if k != 105]


def test_all_clean_words_are_looked_through(spark):
    """A rare word that looks toxic, behind 25,000 others, joins the negatives; those that are negatives already do not."""
    clean = spark.createDataFrame([(f"w{i:05d}", 5) for i in range(25_000)] + [("idioto", 1), ("idiota", 1)], "word string, c bigint")
    machine = t.Machine(["idiot"], t.self_kernel(["idiot"]), np.array([2.0]), -1.0)
    assert t.hardest_words(clean, machine, ["idiota"]) == [("idioto", 1)]
