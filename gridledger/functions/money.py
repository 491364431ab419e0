"""Money: amounts with stated currencies and scales. What a text does not state stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scales and their multipliers, the words for them, and the words and signs for currencies.
SCALES = {"unit": 1, "thousand": 1_000, "lakh": 100_000, "million": 1_000_000, "crore": 10_000_000, "billion": 1_000_000_000}
SCALE_WORDS = {
    "thousand": ("thousand", "thousands", "000s"), "lakh": ("lakh", "lakhs", "lac", "lacs"), "million": ("million", "millions", "mn"), "crore": ("crore", "crores", "cr"), "billion": ("billion", "billions"),
}
CURRENCIES = {
    "INR": ("₹", "rs", "inr", "rupee", "rupees"), "USD": ("usd", "dollar", "dollars"), "EUR": ("€", "eur", "euro", "euros"), "GBP": ("£", "gbp", "pound", "pounds"), "AUD": ("aud",), "CAD": ("cad",), "SAR": ("sar",),
}
#: Of the words for currencies, those that do not stand before an amount.
AFTER_ONLY = ("rupee", "rupees", "euro", "euros")
EXACT = "decimal(38,6)"
#: A text's pieces: figures ("000s" is a word), words, white space, single signs.
TOKEN = r"000s\b|[0-9][0-9,]*(?:\.[0-9]+)?|\p{L}+|\s+|."


def _lookup(forms: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for name, words in forms.items() for w in words for x in (w, name))), key)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.trim(text)), F.lit(TOKEN), F.lit(0))


def scale_of(word: Column) -> Column:
    """A written scale's name; "unit" for another word, null for none."""
    w = F.lower(word)
    return F.when(w != "", F.coalesce(_lookup(SCALE_WORDS, w), F.lit("unit")))


def multiplier(scale: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0).cast("bigint"))
    for name, x in SCALES.items():
        out = out.when(scale == name, F.lit(x).cast("bigint"))
    return out


def _currency(pieces: Column, dollar: str | None) -> Column:
    own = F.transform(pieces, lambda x: _lookup(CURRENCIES | ({dollar: (*CURRENCIES[dollar], "$")} if dollar else {}), x))
    named = F.array_distinct(F.array_compact(own))
    return F.when(F.size(named) == 1, named[0])


def currency(text: Column, dollar: str | None = None) -> Column:
    """The one currency that a text names; null for none or several. `dollar`: what a bare $ is where the text is from; else it names none."""
    return _currency(tokens(text), dollar)


def plain(x: Column) -> Column:
    """A decimal as a plain string without trailing zeros."""
    s = x.cast("string")
    return F.when(s.contains("."), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)


def absolute(amount: Column, scale: Column) -> Column:
    """amount times the scale's multiplier, exactly; null where no scale is stated."""
    out = F.when(F.lit(False), F.lit(0).cast(EXACT))
    for name, x in SCALES.items():
        out = out.when(scale == name, (amount * F.lit(x).cast("decimal(11,0)")).cast(EXACT))
    return out


def parse(text: Column, dollar: str | None = None) -> Column:
    """struct(amount, scale, currency, absolute): the first figure after a currency's mark, with a scale word after it; else a figure with
    a scale word that the text begins with; else a text that is a figure."""
    marks = [w for words in CURRENCIES.values() for w in words if w not in AFTER_ONLY]
    figure = lambda x: x.rlike("^[0-9]") & (x != "000s")

    def read(p: Column) -> Column:
        at = lambda i: F.get(p, i)
        blank = lambda i: F.coalesce(at(i).rlike(r"^\s+$"), F.lit(False)).cast("int")

        def marked(i: Column) -> Column:
            before = i - 1 - blank(i - 1)
            before = before - (F.coalesce(at(before), F.lit("")) == ".").cast("int")
            return F.coalesce(figure(at(i)) & at(before).isin(*marks), F.lit(False))

        first = F.get(F.filter(F.sequence(F.lit(0), F.size(p)), marked), F.lit(0))
        word = lambda i: F.when(blank(i + 1) == 1, _lookup(SCALE_WORDS, at(i + 2)))
        leading = F.coalesce(figure(at(F.lit(0))), F.lit(False)) & ((F.size(p) == 1) | word(F.lit(0)).isNotNull())
        place = F.coalesce(first, F.when(leading, 0))
        return F.struct(F.replace(at(place), F.lit(","), F.lit("")).try_cast(EXACT).alias("amount"), word(place).alias("scale"), _currency(p, dollar).alias("currency"))

    def built(r: Column) -> Column:
        scale = F.when(r["amount"].isNotNull(), r["scale"])
        return F.struct(r["amount"].alias("amount"), scale.alias("scale"), F.when(r["amount"].isNotNull(), r["currency"]).alias("currency"), absolute(r["amount"], scale).alias("absolute"))

    # Each step reads the one before it once.
    return F.transform(F.transform(F.array(tokens(text)), read), built)[0]
