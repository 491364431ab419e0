import pytest

from gridledger.llm import licenses as lic


def test_every_template_is_its_own_best():
    m = lic.Matcher(lic.TEMPLATES, {}, 1000, lic.THRESHOLD)
    for name, notices in lic.TEMPLATES.items():
        for notice in notices:
            assert m.scan(f"some words\n{notice.upper()}\nmore of them", False) == (name, pytest.approx(1.0))


def test_skipped_lines_hold_no_match():
    """What the keys skip never reaches the threshold: against scoring every window."""
    m = lic.Matcher(lic.TEMPLATES, {"the": 900, "license": 40, "under": 300, "licensed": 30}, 1000, 0.4)
    texts = ["the work is under the public license version 3", "licensed\nunder the\napache license", "of the in to", "copy of this\nsoftware and\nfiles", "version 2.0", "", "released under it"]
    for t in texts:
        lines = [lic.terms(x) for x in t.split("\n")]
        best = max(m.score([w for x in lines[i : i + n] for w in x])[0] for n in (1, 2, 3) for i in range(len(lines)))
        assert m.scan(t, False)[1] == pytest.approx(best) or best < 0.4


@pytest.fixture(scope="module")
def tree(spark):
    rows = [
        ("LICENSE", "Released under the MIT License."), ("a.txt", "words"), ("x/COPYING", "Licensed under the\nApache License,\nVersion 2.0."), ("x/y/z/b.txt", None), ("x/y/c.txt", "Licensed under CC BY-NC 4.0."),
        ("q/LICENSE", "no notice here"), ("q/d.txt", ""), ("xy/e.txt", "text"), (None, "Released under the MIT License."), (None, "nothing"), ("q/d.txt", ""),
    ]
    return spark.createDataFrame([(p, t, "e") for p, t in rows], "path string, text string, license string").repartition(3)


def test_inheritance_from_the_nearest_ancestor(tree):
    got = [(r.path, r.own_license, r.license, r.inherited_from) for r in lic.scan(tree, []).collect()]
    assert sorted(got, key=str) == sorted(
        [
            ("LICENSE", "MIT", "MIT", None), ("a.txt", None, "MIT", ""), ("x/COPYING", "Apache-2.0", "Apache-2.0", None), ("x/y/z/b.txt", None, "Apache-2.0", "x"), ("x/y/c.txt", "CC-BY-NC-4.0", "CC-BY-NC-4.0", None),
            ("q/LICENSE", None, "MIT", ""), ("q/d.txt", None, "MIT", ""), ("xy/e.txt", None, "MIT", ""), (None, "MIT", "MIT", None), (None, None, None, None), ("q/d.txt", None, "MIT", ""),
        ],
        key=str,
    )


def test_frequencies_cover_all_documents(few_docs):
    words = {"license", "the", "und", "version"}
    df, n = lic.document_frequencies(few_docs, words)
    texts = [set(lic.terms(r.text)) for r in few_docs.select("text").collect()]
    assert n == len(texts) and df == {w: sum(w in t for t in texts) for w in words}


def test_empty_and_edges(edge_docs, no_docs):
    assert lic.scan(lic.as_files(no_docs), ["doc_id"]).count() == 0
    assert lic.scan(lic.as_files(edge_docs), ["doc_id"]).count() == edge_docs.count()


def test_common_outside_words_weigh_little_at_every_size(spark):
    """A word that every document holds hides no notice, however many documents there are."""
    notice = lic.TEMPLATES["MIT"][0]
    rows = [("n.txt", f"today {notice}")] + [(f"{i}.txt", f"today w{i}") for i in range(2000)]
    files = spark.createDataFrame(rows, "path string, text string").repartition(3)
    (got,) = lic.own_licenses(files, ["path"]).where("own_license is not null").collect()
    assert (got.path, got.own_license) == ("n.txt", "MIT") and got.own_score == pytest.approx(1.0, abs=1e-3)
    df, n = lic.document_frequencies(files, {"today", "mit"})
    assert n == 2001 and df == {"today": 2001, "mit": 1}


def test_notices_in_long_lines_and_over_many_lines():
    m = lic.Matcher(lic.TEMPLATES, {}, 100_000, lic.THRESHOLD)
    around = " ".join(f"outside{i}" for i in range(300))
    for name, notices in lic.TEMPLATES.items():
        for notice in notices:
            assert m.scan(f"{around} {notice} {around}", False) == (name, pytest.approx(1.0))
            assert m.scan("\n".join([around, *notice.split(), around]), False) == (name, pytest.approx(1.0))


def test_counts_are_joined_wherever_a_score_can_reach_the_threshold():
    m = lic.Matcher(lic.TEMPLATES, {"the": 900, "license": 40, "under": 300, "mit": 200}, 1000, lic.THRESHOLD)
    for t in ("by X released under the MIT license today", "mit the license of", "a b c", "Licensed under the Apache License by Foo, Version 2.0"):
        need = m.outside(t, False)
        for n in (1, 30, 1000):
            assert need is not None or m.scan(t, False, dict.fromkeys(lic.terms(t), n))[0] is None
    assert m.outside("by X released under the MIT license today", False) is not None
