"""Comparison verdicts of two stated values: agree, disagree, precision_mismatch, different_readings, not_comparable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridledger.functions import dates, money, text

TOLERANCE = 0.01
SITE_SIMILARITY = 0.8


def magnitudes(a: Column, b: Column) -> Column:
    """agree within one per cent of the larger magnitude."""
    most = F.greatest(F.abs(a), F.abs(b))
    return F.when(a.isNull() | b.isNull(), "not_comparable").when(F.abs(a - b) <= most * TOLERANCE, "agree").otherwise("disagree")


def percent_apart(a: Column, b: Column) -> Column:
    """The difference in per cent of the larger magnitude, to two places; null where both are zero."""
    most = F.greatest(F.abs(a), F.abs(b))
    return F.round(F.try_divide(F.abs(a - b) * 100, most), 2)


def money_verdict(a: Column, b: Column) -> Column:
    """Of two texts: face values (absolute where a scale is stated); unlike stated currencies do not compare."""
    l, r = money.parse(a), money.parse(b)
    face = lambda m: F.coalesce(m["absolute"], m["amount"]).cast("double")
    return F.when(l["currency"] != r["currency"], "not_comparable").otherwise(magnitudes(face(l), face(r)))


def measured_verdict(a: Column, unit_a: Column, b: Column, unit_b: Column) -> Column:
    """Values of the same stated unit; units are never converted."""
    u, v = text.squeeze(F.lower(unit_a)), text.squeeze(F.lower(unit_b))
    missing = F.coalesce(u, F.lit("")).eqNullSafe("") | F.coalesce(v, F.lit("")).eqNullSafe("")
    return F.when(missing | (u != v), "not_comparable").otherwise(magnitudes(a, b))


def date_verdict(a: Column, b: Column) -> Column:
    """Equal spans agree; spans that overlap differ in precision; others are different readings."""
    l, r = dates.span(a), dates.span(b)
    known = l["first"].isNotNull() & r["first"].isNotNull()
    same = (l["first"] == r["first"]) & (l["last"] == r["last"])
    meet = (l["first"] <= r["last"]) & (r["first"] <= l["last"])
    return F.when(~known, "not_comparable").when(same, "agree").when(meet, "precision_mismatch").otherwise("different_readings")


def name_verdict(a: Column, b: Column) -> Column:
    l, r = text.loose_key(a), text.loose_key(b)
    return F.when((l == "") | (r == "") | l.isNull() | r.isNull(), "not_comparable").when(l == r, "agree").otherwise("disagree")


def site_similarity(a: Column, b: Column) -> Column:
    return text.edit_similarity(text.loose_key(a), text.loose_key(b))


def key_similarity(a: Column, b: Column, least: float) -> Column:
    """Whether keys are at least so similar; edits are counted only where the lengths allow it."""
    long, short = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    may = F.when(long == 0, F.lit(True)).otherwise(1 - (long - short) / long >= least)
    return F.when(may, text.edit_similarity(a, b) >= least).otherwise(False)


def pair_verdict(kind_a: Column, a: Column, unit_a: Column, kind_b: Column, b: Column, unit_b: Column) -> Column:
    """The rule that two facts' kinds call for: rates with units, money, quantities; null where none does."""
    both = lambda k: (kind_a == k) & (kind_b == k)
    measured = measured_verdict(a, unit_a, b, unit_b)
    units = unit_a.isNotNull() & unit_b.isNotNull()
    return F.when(both("rate") & units, measured).when(both("money"), magnitudes(a, b)).when(units & a.isNotNull() & b.isNotNull(), measured)


