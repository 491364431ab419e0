import hashlib
import re

import pytest

from gridledger.llm import pii

KINDS = ["email", "ip", "card", "phone"]
TEXTS = [
    None, "", "a@b.c-d@e.f x.y_z@q.r-s.t", "1.2.3.4.5.6.7.8 and 256.1.1.1 or 001.02.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112.", "call +1 (523) 555-1055, +49 30 1234567890 or +1-2",
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "ü" * 50 + " é@x.y +123456789012 \U0001f600 1.1.1.1", "a" * 20000, "1" * 20000, "1." * 8000, "+" * 3000 + "1 " * 3000, "_@" * 500, "a.b@c.d " * 300,
    "cd_e@f.g@h.i", "a@b.cd_e@f.g", "5 - 5-5", "12345678901234567890 4111111111111111",
]


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def base(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string")


def check(docs, rows):
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    assert len(rows) == docs.count()
    for r in rows:
        b = base(texts[r.doc_id])
        listed = [f"{KINDS[k]}:{s}:{e}" for s, k, e in b]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[1] == k for x in b) for k in range(4)), texts[r.doc_id][:80]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(listed) <= set(spans)
        at = [int(x.split(":")[1]) for x in spans]
        assert at == sorted(at)


def test_base_spans_of_odd_texts(odd):
    check(odd, pii.find(odd).collect())


@pytest.mark.parametrize("which", ["edge_docs", "few_docs", "no_docs"])
def test_base_spans_of_documents(request, which):
    docs = request.getfixturevalue(which)
    check(docs, pii.find(docs).collect())


def test_no_python_on_the_main_path(few_docs):
    plan = pii.find(few_docs)._jdf.queryExecution().toString() + pii.redact(few_docs, {"bias": 0.0})._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_secrets_are_added_and_plain_words_are_not(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pii.find(docs).collect()
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    want = {r for r, t in texts.items() if re.search(r'(?i)token = "[0-9a-f]{40}"', t)}
    assert {r.doc_id for r in rows if "secret" in r.spans} == want


def test_redaction(odd):
    got = {r.doc_id: r.text for r in pii.redact(odd).collect()}
    assert got[0] is None and got[1] == ""
    assert got[5].startswith("call <PHONE>, <PHONE> or +1-2")
    assert got[3].startswith("<IP>.<IP> and 256.1.1.1 or <IP>")
    assert pii.redact(odd).columns == odd.columns


def test_fit_of_nothing(spark):
    assert pii.fit(spark.createDataFrame([], "kind int, v_format int, v_gazetteer int, v_context int, v_boundary int, v_length int, shape int")) == {"bias": 0.0}
