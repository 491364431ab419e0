"""Cells: literal typing, A1 references, grouping, dummy values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Error literals of a workbook.
ERRORS = ("#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A")
MARK = r"(?:\p{Sc}|rs\.?|inr|usd|eur|gbp)"
WESTERN, INDIAN = r"[0-9]{1,3}(?:,[0-9]{3})+", r"[0-9]{1,2}(?:,[0-9]{2})*,[0-9]{3}"


def numeric(text: Column) -> Column:
    """The number that a cell's text states: brackets negate, a currency mark is dropped, grouping is checked, % divides by 100."""
    t = F.trim(text)
    negative = t.rlike(r"^\(.*\)$")
    t = F.when(negative, F.trim(F.regexp_replace(t, r"^\(|\)$", ""))).otherwise(t)
    t = F.regexp_replace(F.regexp_replace(t, rf"(?i)^{MARK}\s*", ""), rf"(?i)\s*{MARK}$", "")
    percent = t.endswith("%")
    t = F.trim(F.regexp_replace(t, "%$", ""))
    grouped = ~t.contains(",") | t.rlike(rf"^[+-]?(?:{WESTERN}|{INDIAN})(?:\.[0-9]+)?$")
    value = F.when(grouped & t.rlike(r"^[+-]?(?:[0-9][0-9,]*(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), F.replace(t, F.lit(","), F.lit("")).try_cast("decimal(38,10)"))
    value = F.when(negative, -value).otherwise(value)
    return F.when(percent, (value / F.lit(100).cast("decimal(3,0)")).cast("decimal(38,12)")).otherwise(value.cast("decimal(38,12)"))


def value_type(text: Column) -> Column:
    """empty, bool, error, number or text, tried in this order."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(t == "", "empty").when(F.upper(t).isin("TRUE", "FALSE"), "bool").when(t.isin(*ERRORS), "error").when(numeric(t).isNotNull(), "number").otherwise("text")


def column_number(letters: Column) -> Column:
    """A to 1, Z to 26, AA to 27."""
    chars = F.filter(F.split(F.upper(letters), ""), lambda x: x != "")
    return F.aggregate(chars, F.lit(0).cast("bigint"), lambda s, x: s * 26 + F.ascii(x) - 64)


def column_letters(number: Column) -> Column:
    """1 to A, 27 to AA, up to three letters."""
    n = number.cast("int")
    one = lambda k: F.char(F.pmod(k, F.lit(26)) + 65)
    a, b = n - 1, F.floor((n - 1) / 26).cast("int") - 1
    c = F.floor((n - 1) / 26).cast("int")
    c = F.floor((c - 1) / 26).cast("int") - 1
    return F.when(n <= 26, one(a)).when(n <= 702, F.concat(one(b), one(a))).otherwise(F.concat(one(c), one(b), one(a)))


def bounds(reference: Column) -> Column:
    """struct(top, left, bottom, right) of an A1 reference: sheet and $ dropped, corners in any order, whole rows or columns open."""
    r = F.replace(F.regexp_replace(reference, "^.*!", ""), F.lit("$"), F.lit(""))
    a, b = F.split_part(r, F.lit(":"), F.lit(1)), F.when(r.contains(":"), F.split_part(r, F.lit(":"), F.lit(2))).otherwise(r)
    row = lambda x: F.regexp_extract(x, "([0-9]+)$", 1).try_cast("int")
    col = lambda x: F.when(x.rlike("^[A-Za-z]+"), column_number(F.regexp_extract(x, "^([A-Za-z]+)", 1)))
    most = F.lit(2147483647)
    top, bottom = F.coalesce(F.least(row(a), row(b)), F.lit(1)), F.coalesce(F.greatest(row(a), row(b)), most)
    left, right = F.coalesce(F.least(col(a), col(b)), F.lit(1)), F.coalesce(F.greatest(col(a), col(b)), most.cast("bigint"))
    return F.struct(top.alias("top"), left.alias("left"), bottom.alias("bottom"), right.alias("right"))


def contains(reference: Column, row: Column, col: Column) -> Column:
    b = bounds(reference)
    return row.between(b["top"], b["bottom"]) & col.between(b["left"], b["right"])


def string_hash(c: Column) -> Column:
    """The 32-bit polynomial hash of a string's characters, base 31, as a signed int."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    h = F.aggregate(chars, F.lit(0).cast("bigint"), lambda s, x: F.pmod(s * 31 + F.ascii(x), F.lit(1 << 32)))
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h).cast("int")


def dummy(value: Column, coordinate: Column) -> Column:
    """A number of like magnitude that depends on the cell's place only; the sign stays."""
    jitter = F.pmod(string_hash(coordinate), F.lit(89)) + 10
    size = F.abs(value)
    band = (
        F.when(size == 0, 12.34 + jitter / 100).when(size < 1, (jitter % 80 + 5) / 100).when(size < 100, 12.34 + jitter / 100)
        .when(size < 10_000, 123.45 + jitter / 10).when(size < 1_000_000, 12_345.67 + jitter).otherwise(123_456.78 + jitter * 10)
    )
    return F.when(value < 0, -band).otherwise(band)


def western(digits: Column) -> Column:
    """Groups of three."""
    return F.regexp_replace(digits, r"(?<=[0-9])(?=(?:[0-9]{3})+$)", ",")


def indian(digits: Column) -> Column:
    """The last three, then groups of two."""
    return F.regexp_replace(digits, r"(?<=[0-9])(?=(?:[0-9]{2})*[0-9]{3}$)", ",")


def normal_formula(formula: Column) -> Column:
    """A formula in one spelling: no leading = or +, no future-function prefix; outside quotes no spaces and upper case."""
    f = F.regexp_replace(F.regexp_replace(F.trim(formula), r"^=\+?", ""), "_xlfn\\.", "")
    parts = F.split(f, "(?=[\"'])|(?<=[\"'])", -1)
    zero = F.struct(F.lit("").alias("quote"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        mark = x.isin("'", '"')
        opens, closes = mark & (s["quote"] == ""), mark & (s["quote"] == x)
        bare = F.upper(F.regexp_replace(x, r"\s+", ""))
        return F.struct(F.when(opens, x).when(closes, "").otherwise(s["quote"]).alias("quote"), F.concat(s["out"], F.when(mark | (s["quote"] != ""), x).otherwise(bare)).alias("out"))

    return F.aggregate(parts, zero, step, lambda s: s["out"])


REFERENCE = r"(?:(?:'[^']+'|[A-Za-z_][A-Za-z0-9_.]*)!)?\$?[A-Z]{1,3}\$?[0-9]{1,7}(?::\$?[A-Z]{1,3}\$?[0-9]{1,7})?(?![A-Za-z0-9_(])"


def references(formula: Column) -> Column:
    """Cell and range references of a formula, with their sheets, in order; text in double quotes holds none."""
    bare = F.regexp_replace(formula, '"[^"]*"', '""')
    return F.regexp_extract_all(bare, F.lit(rf"(?<![A-Za-z0-9_$.!'])({REFERENCE})"), F.lit(1))


def reference_kind(reference: Column) -> Column:
    place = F.when(reference.contains("!"), "cross_sheet").otherwise("local")
    return F.concat_ws("_", place, F.when(reference.contains(":"), "range").otherwise("cell"))


def _without_references(formula: Column) -> tuple[Column, Column]:
    """A formula without its =, and the same with its references blanked."""
    body = F.regexp_replace(F.trim(formula), "^=", "")
    return body, F.regexp_replace(body, rf"(?i)(?<![A-Za-z0-9_$.!']){REFERENCE}", " ")


def additive(formula: Column) -> Column:
    """It reads cells and only adds, subtracts or folds them and numbers (SUM, AVERAGE, MIN, MAX)."""
    body, blank = _without_references(formula)
    rest = F.regexp_replace(F.regexp_replace(blank, r"(?i)\b(?:sum|average|min|max)\s*\(", "("), "[0-9.]+", " ")
    return F.coalesce((blank != body) & rest.rlike(r"^[\s(),+-]*$"), F.lit(False))


def pure_sum(formula: Column) -> Column:
    """It is nothing but sums of cells: no number typed in, no subtraction, no other function."""
    body, rest = _without_references(formula)
    return F.coalesce((rest != body) & F.regexp_replace(rest, r"(?i)\bsum\s*\(", "(").rlike(r"^[\s(),+]*$"), F.lit(False))


def divisor_scale(formula: Column) -> Column:
    """The scale of a formula that ends in a division by a power of ten that is one."""
    f = normal_formula(formula)
    out = F.when(F.lit(False), "")
    for name, power in (("thousand", 3), ("lakh", 5), ("million", 6), ("crore", 7), ("billion", 9)):
        out = out.when(f.rlike(rf"/\(?(?:10\^{power}|1E\+?0?{power}|1{'0' * power})\)?$"), name)
    return out
