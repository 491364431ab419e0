"""The fuzzy window search against every window."""

import random
import re

import pytest

from gridledger.operators import joins
from gridledger.queries.joins import jn7, jn8
from gridledger.queries.scalars import cmp6


def joined(df) -> int:
    """Rows of the largest join that df has run."""

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        kids = node.children()
        own = node.metrics().apply("numOutputRows").value() if "Join" in name else 0
        return max([own, *(walk(kids.apply(i)) for i in range(kids.size()))])

    return walk(df._jdf.queryExecution().executedPlan())


def parts(spark, folder, rows):
    kind = "p_partkey bigint, p_name string, p_brand string, p_size int, p_retailprice double"
    spark.createDataFrame(rows, kind).repartition(2).write.mode("overwrite").parquet(f"{folder}/part.parquet")
    return str(folder)


def test_classes_keep_every_row_in_lists_of_bounded_size(spark):
    rows = [(k, "x" if k % 5 else "y", 1.5) for k in range(300)] + [(900, None, 1.5), (901, "z", 2.0), (901, "z", 2.0)]
    got = joins.classes(spark.createDataFrame(rows, "id long, name string, at double"), ["name", "at"], most=20).collect()
    assert sorted((x.id, r.name, r.at) for r in got for x in r._rows) == sorted(x for x in rows if x[1])
    assert len({(r.name, r.at) for r in got}) == 3 and len(got) >= 10 and max(len(r._rows) for r in got) < 60


def test_sites_of_one_name_are_compared_once(spark, tmp_path):
    """Before, all 80,000 pairs of the copies were joined and compared, by keys made anew for each."""
    rows = [(k, ("Hot, Bolt", "hot bolt")[k % 2], "A", 1, 1.0) for k in range(400)] + [(k, "hot bolts", "A", 1, 1.0) for k in range(195, 205)]
    rows += [(500, "hot-bolt", "B", 1, 1.0), (501, "hot bolt", "A", 2, 1.0), (502, "cold ring", "A", 1, 1.0), (503, None, "A", 1, 1.0), (504, "hot bolt", None, 1, 1.0), (505, "hotb", "A", 1, 1.0)]
    df = cmp6(spark, parts(spark, tmp_path, rows))
    name = {"Hot, Bolt": "hotbolt", "hot bolt": "hotbolt", "hot bolts": "hotbolts", "cold ring": "coldring", "hotb": "hotb"}
    one = [(k, name[n]) for k, n, brand, size, _ in rows if n and brand == "A" and size == 1]
    want = sorted((i, j) for i, x in one for j, y in one if i < j and 1 - edits_(x, y) / max(len(x), len(y)) >= 0.8)
    assert sorted(map(tuple, df.collect())) == want
    assert len(want) > 80_000 and joined(df) < 1000


_seen = {}


def edits_(a, b):
    if (a, b) not in _seen:
        _seen[a, b] = edits(a, b)
    return _seen[a, b]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(pages, names, least):
    out = {}
    for page, body in pages:
        words = re.findall("[a-z0-9]+", body.lower())
        for key, name in names:
            nk, most = name.replace(" ", ""), len(name.split()) + 1
            for i in range(len(words)):
                for n in range(1, min(most, len(words) - i) + 1):
                    phrase = " ".join(words[i : i + n])
                    k = phrase.replace(" ", "")
                    score = 1 - edits(k, nk) / max(len(k), len(nk))
                    if score >= least:
                        out[page, key] = max(out.get((page, key), (0, 0, "")), (score, -len(phrase), phrase))
    return sorted((p, k, pytest.approx(s), w) for (p, k), (s, _, w) in out.items())


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_best_window_loses_no_pair(spark, least):
    pick = random.Random(3)
    word = lambda: "".join(pick.choice("abcd") for _ in range(pick.randint(1, 6)))
    names = [(k, " ".join(word() for _ in range(pick.randint(1, 6)))) for k in range(12)] + [(50, "jaisingh pura"), (51, "one two three four five six")]
    pages = [(p, " ".join(word() for _ in range(25))) for p in range(8)] + [(90, "the taisingh pura site"), (91, "at one two three four five sixx here"), (92, "")]
    df = joins.best_window(spark.createDataFrame(pages, "page int, body string"), spark.createDataFrame(names, "id int, name string"), "page", "body", "id", "name", least)
    got = sorted((r.page, r.id, r.score, r.phrase) for r in df.collect())
    assert got == brute(pages, names, least)
    if least == 0.8:
        assert {(90, 50, "taisingh pura"), (91, 51, "one two three four five sixx")} <= {(p, k, w) for p, k, _, w in got}


def test_spine_match_is_the_longest_name_of_either_direction(spark):
    spine = ["net worth", "Net Worth of the group", "tariff", "worth", "rate", "abc", "Zeta rate", "Alfa rate", None, ""]
    labels = ["NET-WORTH", "the net worth (audited)", "worth of the", "Tariff, rate", "abc", "abcd", "rat", "e rate", "zeta rate and alfa rate", None, "", "---", "rate", "rate"]
    key = lambda x: re.sub("[^a-z0-9]+", " ", (x or "").lower()).strip()

    def best(label):
        a = key(label)
        fits = [n for n in spine if len(a) > 3 and len(key(n)) > 3 and (a in key(n) or key(n) in a)]
        return min(fits, key=lambda n: (key(n) != a, -len(key(n)), n), default=None)

    got = joins.spine_match(spark.createDataFrame([(x,) for x in labels], "label string"), spark.createDataFrame([(x,) for x in spine], "name string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted({(x, best(x)) for x in labels if best(x)})
    assert joins.spine_match(spark.createDataFrame([], "label string"), spark.createDataFrame([], "name string")).count() == 0


def test_near_boxes_in_one_place_are_compared_once(spark, tmp_path):
    """Before, each pair of the copies was joined and compared."""
    pick = random.Random(4)
    rows = [(k, "n", "A", 3, 900.0) for k in range(500)] + [(k, "n", pick.choice("AB"), pick.randint(1, 12), pick.randint(0, 400) / 2) for k in range(500, 700)]
    df = jn7(spark, parts(spark, tmp_path, [*rows, (900, "n", None, 3, 900.0), (901, "n", "A", 3, None)]))
    box = [(k, page, size * 10.0, price / 2) for k, _, page, size, price in rows]
    meet = lambda p, q, wide: p <= q + wide + 24 and q <= p + wide + 24
    want = sorted((i, j) for i, p, x, y in box for j, q, u, v in box if i % 2 == 0 and j % 2 == 1 and p == q and meet(x, u, 15) and meet(y, v, 10))
    assert sorted(map(tuple, df.collect())) == want
    assert len(want) > 62_500 and joined(df) < 6_000


def test_overlapping_boxes_in_one_place_are_compared_once(spark, tmp_path):
    """Before, each pair of the copies was joined and compared."""
    pick = random.Random(4)
    rows = [(k, "n", "A", 3, 900.0) for k in range(500)] + [(k, "n", pick.choice("AB"), pick.randint(1, 12), pick.randint(0, 400) / 2) for k in range(500, 700)]
    df = jn8(spark, parts(spark, tmp_path, [*rows, (900, "n", None, 3, 900.0), (901, "n", "A", 3, None)]))
    box = [(k, page, size * 10.0, price / 2) for k, _, page, size, price in rows]
    meet = lambda p, q, wide: p < q + wide + 0 and q < p + wide + 0
    want = sorted((i, j) for i, p, x, y in box for j, q, u, v in box if i % 2 == 0 and j % 2 == 1 and p == q and meet(x, u, 15) and meet(y, v, 10))
    assert sorted(map(tuple, df.collect())) == want
    assert len(want) > 62_500 and joined(df) < 6_000
