"""Rates, quantities and durations with their units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical units and their spellings (lower case, without dots, spaces, slashes and dashes).
UNITS = {
    "acre": ("acre", "acres", "ekad", "ekar"),
    "hectare": ("hectare", "hectares", "ha"),
    "sq_m": ("sqm", "sqmeter", "squaremeter", "m2"),
    "sq_ft": ("sqft", "sqfeet", "squarefeet", "ft2"),
    "sq_yd": ("sqyd", "sqyard", "squareyard", "yd2"),
    "guntha": ("guntha", "gunthas"),
    "bigha": ("bigha", "bighas", "beegha"),
    "kanal": ("kanal", "kanals"),
    "marla": ("marla", "marlas"),
    "cent": ("cent", "cents"),
    "are": ("are", "ares"),
    "kwp": ("kwp",),
    "mwp": ("mwp",),
    "kwh_m2": ("kwhm2", "kwhperm2"),
    "kwh_kwp": ("kwhkwp", "kwhperkwp"),
    "mwh_yr": ("mwhyr", "mwhyear", "mwhperyear"),
    "tpd": ("tpd",),
    "klpd": ("klpd",),
    "mva": ("mva",),
    "kv": ("kv",),
}
# Units of technical figures, units that a rate is per, and units of time.
TECHNICAL = ("kwp", "mwp", "kwh_m2", "kwh_kwp", "mwh_yr", "tpd", "klpd", "mva", "kv")
RATE_UNITS = ("kwh", "kw", "unit", "month", "year", "annum", "day", "sqm", "sqft", "mt", "tonne", "ton")
TIMES = {"years": ("year", "years", "yr", "yrs"), "months": ("month", "months", "mo", "mos"), "weeks": ("week", "weeks"), "days": ("day", "days")}
MONEY_MARKS = ("₹", "rs", "rs.", "inr")
FIGURE = r"[0-9][0-9,]*(?:\.[0-9]+)?"


def unit(token: Column) -> Column:
    """A unit's canonical name, or its own spelling in lower case without dots and spaces."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(token), "[. ]", ""), "²", "2"), "³", "3")
    compact = F.regexp_replace(t, "[/_-]", "")
    table = F.create_map(*(F.lit(x) for name, forms in UNITS.items() for form in forms for x in (form, name)))
    rest = F.when(t.isin("%", "percent"), "percent").when(t.startswith("sq"), t).when(t.isin("nos", "no"), "nos").when(t.isin("room", "rooms"), "room").when(t.isin("key", "keys"), "key").otherwise(t)
    return F.when(F.trim(token) == "", token).otherwise(F.coalesce(F.try_element_at(table, compact), rest))


def _number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("double")


def quantity(text: Column) -> Column:
    """struct(value, unit): a leading figure, perhaps in scientific form, and one unit; a phrase that is no unit makes it prose."""
    t = F.trim(text)
    whole = rf"^({FIGURE})\s*(.*)$"
    science = t.rlike(r"^[0-9][0-9,]*(?:\.[0-9]+)?[eE][+-]?[0-9]+$")
    rest = F.trim(F.regexp_extract(t, whole, 2))
    name = unit(rest)
    prose = rest.contains(" ") & (name == F.regexp_replace(F.lower(rest), "[. /]", ""))
    ok = t.rlike(whole) & ~prose
    return F.struct(F.when(science, _number(t)).when(ok, _number(F.regexp_extract(t, whole, 1))).alias("value"), F.when(~science & ok & (rest != ""), name).alias("unit"))


def _split(text: Column) -> Column:
    """struct(mark, figure, unit): what stands before the first figure, the figure, and what stands after it, in lower case without spaces."""
    t = F.regexp_replace(F.lower(text), r"\s+", "")
    bare = lambda k: F.regexp_extract(t, r"^([^0-9]*)([0-9]+(?:\.[0-9]+)?)?(.*)$", k)
    return F.struct(bare(1).alias("mark"), F.when(bare(2) != "", bare(2)).alias("figure"), bare(3).alias("unit"))


def rate(text: Column) -> Column:
    """struct(value, unit, stated): percent, percent a year, money per unit, a technical quantity, or a bare number without unit."""
    t = F.trim(text)
    q = quantity(t)

    def read(r: Column) -> Column:
        s, plain = r["s"], r["s"]["mark"] == ""
        unit_of = F.replace(s["unit"], F.lit("."), F.lit(""))
        name = F.when(plain & (s["unit"] == "%"), "percent").when(plain & unit_of.isin("%pa", "%perannum"), "percent_pa")
        per = (plain | s["mark"].isin(*MONEY_MARKS)) & s["unit"].startswith("/") & F.substring(s["unit"], 2, 99).isin(*RATE_UNITS)
        name = name.when(per, F.substring(s["unit"], 2, 99))
        technical = name.isNull() & r["q"]["unit"].isin(*TECHNICAL)
        value = F.when(name.isNotNull(), s["figure"].try_cast("double")).when(technical, r["q"]["value"]).otherwise(_number(r["t"]))
        name = F.coalesce(name, F.when(technical, r["q"]["unit"]))
        return F.struct(value.alias("value"), name.alias("unit"), (name.isNotNull() & value.isNotNull()).alias("stated"))

    return F.transform(F.array(F.struct(t.alias("t"), _split(t).alias("s"), q.alias("q"))), read)[0]


def duration(text: Column) -> Column:
    """struct(value, unit): years, months, weeks or days as stated, never converted."""
    table = F.create_map(*(F.lit(x) for name, words in TIMES.items() for w in words for x in (w, name)))

    def read(s: Column) -> Column:
        name = F.try_element_at(table, s["unit"])
        ok = (s["mark"] == "") & ((s["unit"] == "") | name.isNotNull())
        return F.struct(F.when(ok, s["figure"].try_cast("double")).alias("value"), F.when(ok & s["figure"].isNotNull(), name).alias("unit"))

    return F.transform(F.array(_split(F.trim(text))), read)[0]
