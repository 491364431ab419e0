"""Cases of the parsers and verdicts as literal tables."""

import pytest
from pyspark.sql import functions as F

from gridledger.functions import cells, compare, dates, measures, money, text, vectors


def one(spark, value, *cols):
    rows = spark.createDataFrame([value], [f"c{i}" for i in range(len(value))])
    return rows.select(*cols).first()


@pytest.mark.parametrize(
    "raw, amount, scale, currency, absolute",
    [
        ("Rs. 2,45,00,000", 24500000, None, "INR", None), ("INR 3 million", 3, "million", "INR", 3000000), ("€ 1.5 billions", 1.5, "billion", "EUR", 1500000000), ("3 thousands", 3, "thousand", None, 3000),
        ("corps 5,000", None, None, None, None), ("12.5 lakhs", 12.5, "lakh", None, 1250000), ("", None, None, None, None), ("₹48 cr", 48, "crore", "INR", 480000000), ("-5", None, None, None, None),
    ],
)
def test_money(spark, raw, amount, scale, currency, absolute):
    m = one(spark, (raw,), money.parse(F.col("c0")).alias("m")).m
    number = lambda x: None if x is None else float(x)
    assert (number(m.amount), m.scale, m.currency, number(m.absolute)) == (amount, scale, currency, absolute)


@pytest.mark.parametrize(
    "raw, day, ok, precise",
    [
        ("31.03.2026", "2026-03-31", True, True), ("12/03/2026", "2026-03-12", True, True), ("12-Mar-2026", "2026-03-12", True, True), ("March 2026", None, True, False), ("FY 2025-26", None, True, False),
        ("13/13/2026", None, False, True), ("31 Feb 2026", "2026-02-31", True, True), ("soon", None, False, True),
        ("15  March 2025", "2025-03-15", True, True), ("Mar-2025", None, False, True), ("5 May, 2024", "2024-05-05", True, True), ("FY2024/2025", None, True, False),
    ],
)
def test_dates(spark, raw, day, ok, precise):
    assert tuple(one(spark, (raw,), dates.parse(F.col("c0")).alias("d")).d) == (day, ok, precise)


@pytest.mark.parametrize("raw, value, unit, stated", [("18%", 18, "percent", True), ("12 % p.a.", 12, "percent_pa", True), ("₹ 4.50 / kWh", 4.5, "kwh", True), ("4.50", 4.5, None, False), ("5 MWp", 5, "mwp", True), ("n/a", None, None, False)])
def test_rates(spark, raw, value, unit, stated):
    assert tuple(one(spark, (raw,), measures.rate(F.col("c0")).alias("r")).r) == (value, unit, stated)


@pytest.mark.parametrize("raw, value, unit", [("25 years", 25, "years"), ("25 Yr", 25, "years"), ("25", 25, None), ("18 months", 18, "months"), ("n/a", None, None)])
def test_durations(spark, raw, value, unit):
    assert tuple(one(spark, (raw,), measures.duration(F.col("c0")).alias("r")).r) == (value, unit)


@pytest.mark.parametrize("raw, value, unit", [("4.5 acres", 4.5, "acre"), ("1200 kWp", 1200, "kwp"), ("1,200", 1200, None), ("1.5e3", 1500, None), ("3 of many things", None, None), ("100 sq ft", 100, "sq_ft")])
def test_quantities(spark, raw, value, unit):
    assert tuple(one(spark, (raw,), measures.quantity(F.col("c0")).alias("r")).r) == (value, unit)


@pytest.mark.parametrize("raw, kind, number", [("(1,234.56)", "number", -1234.56), ("35%", "number", 0.35), ("₹10,00,000", "number", 1000000), ("1,23,4,5", "text", None), ("TRUE", "bool", None), ("#REF!", "error", None), (" ", "empty", None), ("abc", "text", None)])
def test_cells(spark, raw, kind, number):
    r = one(spark, (raw,), cells.value_type(F.col("c0")).alias("t"), cells.numeric(F.col("c0")).cast("double").alias("n"))
    assert (r.t, r.n) == (kind, number)


@pytest.mark.parametrize("a, b, verdict", [("₹100", "₹101", "agree"), ("₹100", "₹102", "disagree"), ("Rs. 48,00,00,000", "₹48 crore", "agree"), ("x", "₹5", "not_comparable")])
def test_money_verdicts(spark, a, b, verdict):
    assert one(spark, (a, b), compare.money_verdict(F.col("c0"), F.col("c1")).alias("v")).v == verdict


@pytest.mark.parametrize("a, b, verdict", [("ABC Solar Pvt Ltd", "ABC Solar Private Limited", "agree"), ("ABC Solar Pvt Ltd", "ABC Solar Energy Pvt Ltd", "disagree"), ("Pvt Ltd", "ABC Pvt Ltd", "not_comparable")])
def test_name_verdicts(spark, a, b, verdict):
    assert one(spark, (a, b), compare.name_verdict(F.col("c0"), F.col("c1")).alias("v")).v == verdict


def test_string_hash_is_the_polynomial_one(spark):
    assert one(spark, ("F1",), cells.string_hash(F.col("c0")).alias("h")).h == 70 * 31 + 49


def test_embedding_is_of_unit_length_and_empty_is_zero(spark):
    rows = spark.createDataFrame([("solar power plant",), ("",)], "t string").select(vectors.norm(vectors.embed(F.col("t"))).alias("n")).collect()
    assert [round(r.n, 6) for r in rows] == [1.0, 0.0]


def test_loose_key_and_tokens(spark):
    r = one(spark, ("Alpha-Beta (India) Pvt. Ltd.", "Where is any plan about tariff of 4.5? Give me a list"), text.loose_key(F.col("c0")).alias("k"), text.content_tokens(F.col("c1")).alias("t"))
    assert (r.k, r.t) == ("alphabetaindia", ["plan", "tariff", "4.5", "give", "me", "list"])


def test_hash_embedding_against_the_definition(spark):
    def fnv(t):
        h = 0x811C9DC5
        for c in t:
            h = (h ^ ord(c)) * 0x01000193 % (1 << 32)
        return h

    v = [0.0] * 128
    for f, k in [("w1:solar", 1), ("w1:to", 1), ("c3:sol", 1), ("c3:ola", 1), ("c3:lar", 1), ("w2:solar to", 2)]:
        v[(fnv(f) & 0x7FFFFFFF) % 128] += -k if fnv(f) >> 31 else k
    n = sum(x * x for x in v) ** 0.5
    assert one(spark, ("Solar, to",), vectors.embed(F.col("c0")).alias("e")).e == pytest.approx([x / n for x in v])


def test_vector_codec(spark):
    r = one(spark, ([1.5, -2.0],), vectors.to_bytes(F.col("c0")).alias("b"))
    assert bytes(r.b) == b"\x00\x00\xc0\x3f\x00\x00\x00\xc0"
    assert one(spark, (bytearray(r.b),), vectors.from_bytes(F.col("c0")).alias("v")).v == [1.5, -2.0]
    with pytest.raises(Exception, match="not a multiple of 4"):
        one(spark, (bytearray(b"abc"),), vectors.from_bytes(F.col("c0")).alias("v"))
