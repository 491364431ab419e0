"""Text functions: white space, names, similarity, label phrases, tokens, scripts, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms that end a company name.
LEGAL_FORMS = ("pvt", "private", "ltd", "limited", "llp")
# Words that carry no content in a question.
STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "do", "does", "did", "we", "you", "our", "have", "has", "had", "what", "which", "who", "where", "when", "why", "how", "of", "for", "to",
    "in", "on", "at", "by", "with", "from", "and", "or", "not", "this", "that", "it", "its", "be", "been", "there", "any", "about",
)
# Formats of Indian tax, company and goods-and-services numbers; words that introduce an account number; names in samples.
PAN, GSTIN = "[A-Z]{5}[0-9]{4}[A-Z]", "[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][A-Z0-9]Z[A-Z0-9]"
COMPANY_NUMBERS = ("[A-Z][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6}", "[A-Z]{2}[0-9]{2}[A-Z]{3,7}[0-9]{4}[A-Z]{3,7}[0-9A-Z]{0,6}")
ACCOUNT_WORDS, ACCOUNT_NUMBER_WORDS = ("a/c", "acct", "account"), ("no", "number", "num", "#")
AMOUNT_MARKS, AMOUNT_SCALES = ("rs.", "rs", "inr", "₹", "usd", "$"), ("lakh", "crore", "million", "billion", "thousand")
SAMPLE_NAMES = ("bhagyanagar solar", "bhagyanagar", "sharma", "ramesh", "kumar", "patel", "reddy")


def squeeze(c: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def words(c: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def loose_key(c: Column) -> Column:
    """A name's key: lower case, without punctuation, spaces and trailing legal forms."""
    spaced = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    return F.replace(F.regexp_replace(spaced, f"(?: ?(?:^|\\b)(?:{'|'.join(LEGAL_FORMS)}))+$", ""), F.lit(" "), F.lit(""))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty strings are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def content_tokens(c: Column) -> Column:
    """Distinct tokens of letters and digits (decimals whole) that are no stop words, in lower case."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+(?:\.\p{N}+)?"), F.lit(0))
    return F.array_except(found, F.array(*map(F.lit, STOP_WORDS)))


def amounts(c: Column) -> Column:
    """The set of numbers in a text, without grouping commas and trailing zeros."""
    found = F.regexp_extract_all(c, F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?"), F.lit(0))
    plain = F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")))
    short = F.transform(plain, lambda x: F.when(x.contains("."), F.regexp_replace(x, r"\.?0+$", "")).otherwise(x))
    return F.array_sort(F.array_distinct(short))


def normal_label(c: Column) -> Column:
    """One spelling of a label: no zero-width characters, full-width ones as ASCII, brackets, joiners and percent signs apart from
    words, a currency word apart from the scale or unit typed against it, camel case split, lower case, single spaces."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    s = F.translate(F.regexp_replace(c, "[\u200B-\u200D\uFEFF]", ""), wide + "\u00A0\u3000", "".join(map(chr, range(0x21, 0x7F))) + "  ")
    s = F.regexp_replace(s, r"(?i)\b(rs\.?|inr)(?=/|(?:crores?|cr|lacs?|lakhs?|sq|sqft|sqm|mn|million)\b)", "$1 ")
    s = F.regexp_replace(s, r"(?<=\p{Ll})(?=\p{Lu})", " ")
    s = F.regexp_replace(s, r"(?<=[\p{L}\p{N}])([:@=])(?=[\p{L}\p{N}])", " $1 ")
    s = F.regexp_replace(s, r"(?<=\p{L})%", " %")
    s = F.regexp_replace(F.regexp_replace(s, r"%(?=\p{L})", "% "), r"([()\[\]])", " $1 ")
    return squeeze(F.lower(s))


def label_phrase(c: Column) -> Column:
    """A label as a phrase: no numbering, brackets, rates or numbers; & is "and", % is "percent"; plural words singular."""
    s = F.regexp_replace(F.regexp_replace(normal_label(c), r"\( ", "("), r" \)", ")")
    s = F.regexp_replace(s, r"^(?:[0-9]+(?:\.[0-9]+)*[.)]?|[a-z]{1,3}[.)])\s+", "")
    # From the innermost outwards, as often as there are brackets.
    s = F.aggregate(F.sequence(F.lit(0), F.length(F.regexp_replace(s, r"[^(]", ""))), s, lambda a, _: F.regexp_replace(a, r"\([^()]*\)", " "))
    s = F.regexp_replace(F.regexp_replace(s, r"\(.*$", " "), r"^[^()]*\)", " ")
    s = F.regexp_replace(s, r"@\s*[0-9.]+\s*%?", " ")
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "&", " and "), "%", " percent "), r"[^\p{L}\p{N}]+", " ")
    kept = F.filter(F.split(s, " "), lambda w: (w != "") & ~w.rlike("^[0-9]+$"))
    return F.array_join(F.transform(kept, singular), " ")


def _without(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def singular(w: Column) -> Column:
    n = F.length(w)
    return (
        F.when((n > 4) & w.endswith("ies"), F.concat(_without(w, 3), F.lit("y")))
        .when((n > 4) & w.rlike("(?:ss|x|ch|sh)es$"), _without(w, 2))
        .when((n > 3) & w.endswith("s") & ~w.rlike("[sui]s$"), _without(w, 1))
        .otherwise(w)
    )


def stem(w: Column) -> Column:
    """A word without its plural ending; words of up to three letters and those in -ss stay."""
    n = F.length(w)
    return (
        F.when(n <= 3, w)
        .when(w.endswith("ies"), F.concat(_without(w, 3), F.lit("y")))
        .when((n > 4) & w.rlike("(?:[sxzo]|ch|sh)es$"), _without(w, 2))
        .when(w.endswith("s") & ~w.endswith("ss"), _without(w, 1))
        .otherwise(w)
    )


def sibling_signature(c: Column) -> Column:
    """Sorted stems of a label, without "and": labels of one signature are near duplicates."""
    content = lambda ws: F.filter(ws, lambda w: ~w.isin("", "and"))
    tokens = F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), " ")
    return F.array_join(F.array_sort(content(F.transform(content(tokens), stem))), " ")


def script(c: Column) -> Column:
    """Language by script: Tamil, Gujarati, Marathi (its own letter), Hindi, else English."""
    return F.when(c.rlike("[஀-௿]"), "ta").when(c.rlike("[઀-૿]"), "gu").when(c.rlike("ळ"), "mr").when(c.rlike("[ऀ-ॿ]"), "hi").otherwise("en")


# Sounds of the Devanagari consonants from U+0915 on (Gujarati has the same 0x180 above), Tamil ones, vowels and
# vowel signs by their place in a block, and area words.
_CONSONANTS = "k kh g gh ng ch chh j jh ny t th d dh n t th d dh n n p ph b bh m y r r l l l v sh sh s h".split()
_TAMIL = dict(zip([0xB95, 0xB99, 0xB9A, 0xB9E, 0xB9F, 0xBA4, 0xBA3, 0xBA8, 0xBA9, 0xBAA, 0xBAE, 0xBAF, 0xBB0, 0xBB1, 0xBB2, 0xBB3, 0xBB4, 0xBB5, 0xBB7, 0xBB8, 0xBB9], "k ng ch ny t t n n n p m y r r l l l v sh s h".split()))
_NUKTA_LETTERS = {0x958: "k", 0x95B: "z", 0x95C: "r", 0x95D: "r"}
_VOWELS = {0x05: "a", 0x06: "a", 0x07: "i", 0x08: "i", 0x09: "u", 0x0A: "u", 0x0B: "ri", 0x0F: "e", 0x10: "ai", 0x12: "o", 0x13: "au"}
_SIGNS = {0x3E: "a", 0x3F: "i", 0x40: "i", 0x41: "u", 0x42: "u", 0x43: "ri", 0x47: "e", 0x48: "ai", 0x4B: "o", 0x4C: "au"}
_TAMIL_VOWELS = {0x85: "a", 0x86: "a", 0x87: "i", 0x88: "i", 0x89: "u", 0x8A: "u", 0x8E: "e", 0x8F: "e", 0x90: "ai", 0x92: "o", 0x93: "o", 0x94: "au"}
_TAMIL_SIGNS = {0xBE: "a", 0xBF: "i", 0xC0: "i", 0xC1: "u", 0xC2: "u", 0xC6: "e", 0xC7: "e", 0xC8: "ai", 0xCA: "o", 0xCB: "o", 0xCC: "au"}
UNIT_WORDS = {"वर्ग मीटर": " sq m", "एकड\u093c": " acre", "एक\u095c": " acre", "हेक्टेयर": " hectare", "गुंठा": " guntha", "बीघा": " bigha"}


def _letters() -> tuple[dict[str, str], dict[str, str]]:
    """Consonants, and all other letters, signs and digits, with their Latin forms."""
    consonants = {chr(0x915 + i): x for i, x in enumerate(_CONSONANTS)} | {chr(k): x for k, x in _NUKTA_LETTERS.items()}
    rest = {chr(0x900 + k): x for k, x in (_VOWELS | _SIGNS).items()} | {chr(0x966 + i): str(i) for i in range(10)} | {"\u0902": "n", "\u094d": "", "\u093c": ""}
    higher = lambda own: own | {chr(ord(k) + 0x180): x for k, x in own.items()}
    tamil = {chr(0xB00 + k): x for k, x in (_TAMIL_VOWELS | _TAMIL_SIGNS).items()} | {chr(0xBE6 + i): str(i) for i in range(10)} | {"\u0bcd": ""}
    return higher(consonants) | {chr(k): x for k, x in _TAMIL.items()}, higher(rest) | tamil


def transliterated(c: Column) -> Column:
    """Devanagari, Gujarati and Tamil letters and digits in Latin; an "a" stands between consonants that no sign joins. Area words become units."""
    consonants, rest = _letters()
    s = c
    for word, unit in UNIT_WORDS.items():
        s = F.replace(s, F.lit(word), F.lit(unit))
    one = "[" + "".join(consonants) + "]"
    s = F.regexp_replace(s, "[\u093c\u0abc]", "")
    s = F.regexp_replace(s, f"({one})(?={one})", "$1a")
    latin = F.create_map(*(F.lit(x) for pair in (consonants | rest).items() for x in pair))
    spelt = F.array_join(F.transform(F.split(s, ""), lambda x: F.coalesce(F.try_element_at(latin, x), x)), "")
    return F.when(c.rlike("[\u0900-\u097f\u0a80-\u0aff\u0b80-\u0bff]"), spelt).otherwise(c)


def match_key(c: Column) -> Column:
    """A name's Latin, lower-case, single-spaced form."""
    return squeeze(F.lower(F.coalesce(transliterated(c), F.lit(""))))


def garbled(c: Column) -> Column:
    """Under half of the characters other than spaces are letters or digits; an empty token is not."""
    bare = F.regexp_replace(c, r"\s", "")
    good = F.regexp_replace(bare, r"[^\p{L}\p{N}]", "")
    return (F.length(bare) > 0) & (F.length(good) * 2 < F.length(bare))


def _any(words) -> str:
    return "|".join(w.replace(".", r"\.").replace("$", r"\$") for w in words)


def redacted(c: Column, names=SAMPLE_NAMES) -> Column:
    """A text without tax, company and account numbers, amounts of money and these names, in any case; single spaces."""
    number = r"[0-9][0-9,]*(?:\.[0-9]+)?"
    account = rf"\b(?:{_any(ACCOUNT_WORDS)})\s*(?:no\.|{_any(ACCOUNT_NUMBER_WORDS)})?\s*[:#-]?\s*[0-9]{{6,18}}\b|\b[0-9]{{9,18}}\b"
    amount = rf"(?:{_any(AMOUNT_MARKS)})\s*{number}|\b{number}\s*(?:{_any(AMOUNT_SCALES)})s?\b"
    name = "|".join(rf"\b{w}\b" for w in (r"[\s_-]+".join(n.split()) for n in names))
    s = c
    for pattern in (rf"\b{GSTIN}\b", rf"\b{PAN}\b", rf"\b(?:{'|'.join(COMPANY_NUMBERS)})\b", account, amount, *([name] if names else [])):
        s = F.regexp_replace(s, f"(?i){pattern}", " ")
    return squeeze(s)


def label_key(c: Column, names=SAMPLE_NAMES) -> Column:
    """A field's key from its label: lower case, without values, names and numbers, words joined by "_"; "" if nothing is left."""
    plain = lambda x: squeeze(F.regexp_replace(x, r"[&_\-.,/()\[\]{}:;'\"`%]+", " "))
    left = F.regexp_replace(redacted(plain(F.lower(c)), names), r"\b[0-9]{2,}(?:[.,][0-9]+)*\b", " ")
    return F.replace(plain(left), F.lit(" "), F.lit("_"))


def first_sentence(c: Column, most: int) -> Column:
    """Text up to its first ". ", cut at `most` characters with an ellipsis."""
    s = squeeze(F.substring_index(c, ". ", 1))
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most - 3), F.lit("..."))).otherwise(s)


def covers(text_tokens: Column, wanted: Column) -> Column:
    """Every wanted token is among the text's."""
    return F.size(F.array_except(wanted, text_tokens)) == 0


def names(text: Column, name: Column) -> Column:
    """The name's words follow one another in the text's."""
    pad = lambda c: F.concat(F.lit(" "), F.array_join(words(c), " "), F.lit(" "))
    return pad(text).contains(pad(name)) & (F.size(words(name)) > 0)


def _level(c: Column, numbered: str, alone: str) -> Column:
    number = F.regexp_extract(c, f"(?i){numbered}", 1).try_cast("int")
    return F.coalesce(number, F.when(c.rlike(rf"(?i)\b(?:{alone})\b"), 1).when(c.rlike(r"(?i)\b(?:base|original|unamended)\b"), 0).otherwise(-1))


def amendment_level(c: Column) -> Column:
    """The number of an amendment or addendum; 1 where the word stands alone; 0 for a base version; else -1."""
    return _level(c, r"(?:amendment|addendum)\s*(?:no\.?|num\.?|#)?\s*([0-9]+)", "amendment|addendum|amends")


def revision_level(c: Column) -> Column:
    """The number of a revision; 1 where the word stands alone; 0 for a base version; else -1."""
    return _level(c, r"\b(?:revision|rev\.?)\s*([0-9]+)", "revised|revision|supersedes")
