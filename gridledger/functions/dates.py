"""Dates in documents: day first, never more precise than stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
FULL = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
NUMERIC = r"^[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{4}$"
WORDED = r"^[0-9]{1,2}[\s-]+[A-Za-z]{3,9}(?:[\s-]+|[\s,]+)[0-9]{4}$"
MONTH = r"^[A-Za-z]{3,9}[\s,]+[0-9]{4}$"
FISCAL = r"(?i)^fy\s*[0-9]{4}\s*[-/]\s*[0-9]{2,4}$"


def month_number(word: Column) -> Column:
    w = F.lower(word)
    out = F.when(w == "sept", 9)
    for i, (short, full) in enumerate(zip(MONTHS, FULL), 1):
        out = out.when(w.isin(short, full), i)
    return out


def _read(text: Column, build) -> Column:
    """build(form, a, b, c): the text's form ("iso", "day", "month", "fiscal" or null) and its parts as year, month and day, read once a row."""
    t = F.trim(text)
    form = F.when(t.rlike(ISO), "iso").when(t.rlike(NUMERIC) | t.rlike(WORDED), "day").when(t.rlike(MONTH), "month").when(t.rlike(FISCAL), "fiscal")
    parts = F.split(F.regexp_replace(t, r"(?i)^fy\s*", ""), r"[\s/.,-]+")
    read = F.struct(t.alias("t"), form.alias("form"), parts.alias("p"))

    def named(r: Column) -> Column:
        n = lambda i: F.get(r["p"], F.lit(i)).try_cast("int")
        word = lambda i: F.coalesce(n(i), month_number(F.get(r["p"], F.lit(i))))
        f = r["form"]
        year = F.when(f == "day", n(2)).when(f == "month", n(1)).otherwise(n(0))
        month = F.when(f == "month", word(0)).otherwise(word(1))  # of a fiscal year: its second number
        day = F.when(f == "day", n(0)).when(f == "iso", n(2))
        return F.struct(r["t"].alias("t"), f.alias("form"), year.alias("year"), month.alias("month"), day.alias("day"))

    return F.transform(F.transform(F.array(read), named), build)[0]


def _text(y: Column, m: Column, d: Column | None = None) -> Column:
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.concat_ws("-", pad(y, 4), pad(m, 2), *([pad(d, 2)] if d is not None else []))


def _day(r: Column) -> Column:
    """yyyy-MM-dd. The day is checked against 31 only, as stated; an ISO date stands as it is."""
    fine = r["day"].between(1, 31) & r["month"].between(1, 12) & r["year"].between(1900, 2100)
    return F.when(r["form"] == "iso", r["t"]).when((r["form"] == "day") & fine, _text(r["year"], r["month"], r["day"]))


def parse(text: Column) -> Column:
    """struct(date: yyyy-MM-dd or null, ok, precise). A month and year or a fiscal year is fine, but not precise."""

    def build(r: Column) -> Column:
        coarse = r["form"].isin("month", "fiscal")
        return F.struct(_day(r).alias("date"), F.coalesce(_day(r).isNotNull() | coarse, F.lit(False)).alias("ok"), F.coalesce(~coarse, F.lit(True)).alias("precise"))

    return _read(text, build)


def span(text: Column) -> Column:
    """struct(first, last): the days a date covers: a day, a month, or a fiscal year from 1 April; null if it names none."""

    def build(r: Column) -> Column:
        day = F.try_to_date(_day(r), "yyyy-MM-dd")
        start = F.when((r["form"] == "month") & r["month"].isNotNull(), F.try_to_date(_text(r["year"], r["month"], F.lit(1)), "yyyy-MM-dd"))
        next_year = r["year"] + 1
        fiscal = (r["form"] == "fiscal") & ((r["month"] == next_year) | (r["month"] == next_year % 100))
        first = F.coalesce(day, start, F.when(fiscal, F.make_date(r["year"], F.lit(4), F.lit(1))))
        return F.struct(first.alias("first"), F.coalesce(day, F.last_day(start), F.when(fiscal, F.make_date(next_year, F.lit(3), F.lit(31)))).alias("last"))

    return _read(text, build)


def canonical(text: Column) -> Column:
    """A date as precise as stated: yyyy-MM-dd, yyyy-MM or yyyy."""
    month = lambda r: F.when((r["form"] == "month") & r["month"].isNotNull(), _text(r["year"], r["month"]))
    return _read(text, lambda r: F.coalesce(_day(r), month(r), F.when(r["form"] == "fiscal", r["year"].cast("string"))))
