"""Personal data by weak supervision, in DataFrame functions only.

Base spans (email, ip, card, phone) are the leftmost non-overlapping matches of fixed patterns that pass a check. Candidates
are those and two wider kinds: account (digit groups of a card's length that fail its check sum) and secret (long runs of
letters and digits). Five labelers vote on each candidate (1 personal, -1 not, 0 abstains): format, gazetteer, context,
boundary and length. Expectation-maximisation over the counts of vote patterns of the whole corpus estimates how reliable
each labeler is and how likely each pattern is personal; a logistic classifier is fitted to those soft labels over votes,
kinds and shape, and decides every candidate. Base spans always stay; candidates that the classifier accepts are added
where they overlap no base span.

Only the table of vote patterns (at most 6 kinds x 3^5 votes x 9 shapes rows, whatever the corpus) is iterated over.
Null texts are empty. Repeated rows are judged each. Positions are code points, ends exclusive. Patterns are written so
that a long run is read once: a match starts at the start of its run, or where the match before it ended.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger.llm.shared import cut, ready

KINDS = ("email", "ip", "card", "phone", "account", "secret")
BASE = 4
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SECRET = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
VALID_IP = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"

# Gazetteers and context words of the labelers.
TOP_DOMAINS = "com|org|net|edu|gov|io|info|biz|eu|de|fr|es|it|nl|uk|us|ca|au|in|jp|cn|br|mx|ch|at|be|se|no|fi|dk|pl"
CALLING_CODES = "1|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[0-9]|35[0-9]|37[0-9]|38[0-9]|42[0-9]|85[0-9]|88[0-9]|96[0-9]|97[0-9]|99[0-9]"
WORDS = ("e-?mail|contact|write|courriel|correo", "ip|host|server|addr", "card|visa|credit|karte|carte|tarjeta", "tel|phone|call|mobile|fax|fon", "account|acct|iban|konto|compte|cuenta", "token|key|secret|passw|auth|bearer|credential|pwd")

VOTES = ("v_format", "v_gazetteer", "v_context", "v_boundary", "v_length")
#: Characters before a candidate that the context labeler reads.
WINDOW = 24
ROUNDS = 12
STEPS, RATE = 300, 0.5


def _none() -> Column:
    return F.array().cast("array<struct<start:int,end:int,m:string>>")


def _matches(text: Column, pattern: str) -> Column:
    """start, end and text of all matches: the pieces between them give the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("m"))
    zero = F.struct(F.lit(0).alias("at"), _none().alias("out"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["0"])
        end = start + F.length(x["1"])
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["1"].alias("m")))).alias("out"))

    named = F.transform(pairs, lambda x: F.struct(x.getField("gap").alias("0"), x.getField("m").alias("1")))
    return F.aggregate(F.filter(named, lambda x: x["1"].isNotNull()), zero, step, lambda s: s["out"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """Whether the digits of m pass the check sum: every second from the right is doubled, and the digits of that added."""
    d = F.reverse(_digits(m))
    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, F.translate(d.substr(i, F.lit(1)), "0123456789", "0246813579")).otherwise(d.substr(i, F.lit(1))).cast("int"))
    return total % 10 == 0


def _vote(yes: Column, no: Column | None = None) -> Column:
    v = F.when(yes, 1)
    return (v.otherwise(-1) if no is None else v.when(no, -1).otherwise(0)).cast("tinyint")


def _judged(text: Column, kind: int, m: Column) -> Column:
    """A candidate with its votes and shape."""
    s = m["m"]
    n = F.length(s)
    digits = F.length(_digits(s))
    left = text.substr(F.greatest(m["start"] - WINDOW, F.lit(0)) + 1, F.least(m["start"], F.lit(WINDOW)))
    before, after = left.substr(F.length(left), F.lit(1)), text.substr(m["end"] + 1, F.lit(1))
    luhn = _luhn(s) if kind in (2, 4) else None
    form = (
        _vote(s.rlike(r"\.[A-Za-z]{2,}$")),
        _vote(s.rlike(r"^(?:[1-9][0-9]{0,2}|0)(?:\.(?:[1-9][0-9]{0,2}|0)){3}$")),
        _vote(luhn) if luhn is not None else None,
        _vote(s.rlike(r"^\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]")),
        _vote(F.lit(False)),
        _vote(s.rlike("^[0-9a-f]+$") | s.rlike("^[0-9A-F]+$"), ~s.rlike("[0-9].*[0-9].*[0-9]")),
    )[kind]
    known = (
        _vote(s.rlike(rf"(?i)\.(?:{TOP_DOMAINS})$"), F.lit(False)),
        _vote(s.rlike(r"^(?:[1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])\."), F.lit(False)),
        _vote(s.rlike("^[3-6]"), s.rlike("^0")),
        _vote(s.rlike(rf"^\+(?:{CALLING_CODES})"), F.lit(False)),
        _vote(s.rlike("^[3-6]"), s.rlike("^0")),
        _vote(s.rlike("^(?:sk|pk|ghp|gho|AKIA|xox)[A-Z0-9_-]"), F.lit(False)),
    )[kind]
    context = _vote(left.rlike(rf"(?i)(?:{WORDS[kind]})[^A-Za-z0-9]{{0,6}}$"), F.lit(kind >= BASE) & ~left.rlike("[=:#]"))
    boundary = _vote(~before.rlike("[A-Za-z0-9]") & ~after.rlike("[A-Za-z0-9]"))
    length = (
        _vote((n >= 6) & (n <= 64)), _vote((n >= 7) & (n <= 15)), _vote(digits.isin(15, 16)), _vote((digits >= 11) & (digits <= 13)), _vote(digits.isin(15, 16)), _vote(n.isin(32, 40, 48, 64)),
    )[kind]
    shape = F.when(digits * 3 < n, 0).when(digits * 3 < 2 * n, 1).otherwise(2) + 3 * F.when(n < 16, 0).when(n < 32, 1).otherwise(2)
    return F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), form.alias("v_format"), known.alias("v_gazetteer"), context.alias("v_context"), boundary.alias("v_boundary"), length.alias("v_length"), shape.alias("shape"))


def candidates(text: Column) -> Column:
    """All candidates of a text (not null), in no order."""
    digits = lambda m: F.length(_digits(m))
    gate = lambda yes, pattern: F.when(yes, _matches(text, pattern)).otherwise(_none())
    email = gate(text.contains("@"), EMAIL)
    ip = F.filter(gate(text.rlike(r"[0-9]\.[0-9]"), IP), lambda m: m["m"].rlike(VALID_IP))
    long = F.filter(gate(text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), CARD), lambda m: digits(m["m"]).between(14, 19))
    phone = F.filter(gate(text.rlike(r"\+[0-9]"), PHONE), lambda m: digits(m["m"]).between(10, 15))
    secret = F.filter(gate(text.rlike("[0-9][A-Za-z_-]|[A-Za-z_-][0-9]"), SECRET), lambda m: m["m"].rlike("[0-9]") & m["m"].rlike("[A-Za-z]"))
    judge = lambda kind: lambda m: _judged(text, kind, m)
    cards = F.transform(long, lambda m: F.when(_luhn(m["m"]), _judged(text, 2, m)).otherwise(_judged(text, 4, m)))
    return F.concat(cards, *(F.transform(c, judge(k)) for k, c in ((0, email), (1, ip), (3, phone), (5, secret))))


def fit(spans: DataFrame) -> dict:
    """Weights of the span classifier, from spans (start, kind, end, votes, shape) of a whole corpus.

    The corpus gives the count of every pattern of votes and shape; what follows is arithmetic on that bounded table.
    """
    rows = [(r.asDict(), float(r.n)) for r in spans.groupBy("kind", *VOTES, "shape").agg(F.count("*").alias("n")).orderBy("kind", *VOTES, "shape").collect()]
    if not rows:
        return {"bias": 0.0}
    total = sum(n for _, n in rows)
    # Expectation-maximisation, from the share of labelers in favour.
    p = [sum((r[v] + 1) / 2 for v in VOTES) / len(VOTES) for r, _ in rows]
    for _ in range(ROUNDS):
        mass = sum(n * x for (_, n), x in zip(rows, p))
        odds = {(v, x): 0.0 for v in VOTES for x in (-1, 0, 1)}
        for v, x in odds:
            yes = sum(n * q for (r, n), q in zip(rows, p) if r[v] == x)
            every = sum(n for r, n in rows if r[v] == x)
            odds[v, x] = math.log((yes + 1) / (mass + 3)) - math.log((every - yes + 1) / (total - mass + 3))
        prior = math.log((mass + 1) / (total - mass + 1))
        p = [_sigmoid(prior + sum(odds[v, r[v]] for v in VOTES)) for r, _ in rows]
    # The classifier: logistic regression on soft labels, by gradient steps.
    names = ["bias", *(f"kind={k}" for k in range(len(KINDS))), *(f"{v}={x}" for v in VOTES for x in (-1, 1)), *(f"shape={s}" for s in range(9))]
    on = [[f for f in names if f == "bias" or r[f.partition("=")[0]] == int(f.partition("=")[2])] for r, _ in rows]
    w = dict.fromkeys(names, 0.0)
    for _ in range(STEPS):
        step = dict.fromkeys(names, 0.0)
        for (_, n), q, has in zip(rows, p, on):
            miss = n * (q - _sigmoid(sum(w[f] for f in has)))
            for f in has:
                step[f] += miss
        w = {f: w[f] + RATE * (step[f] / total - 1e-4 * w[f]) for f in names}
    return w


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _has(field, feature: str) -> Column:
    name, _, value = feature.partition("=")
    return F.lit(True) if name == "bias" else field(name) == int(value)


def logit(field, w: dict) -> Column:
    return sum((F.when(_has(field, f), x).otherwise(0.0) for f, x in w.items() if f != "bias"), F.lit(w["bias"]))


def accepted(spans: Column, w: dict) -> Column:
    """Base spans, and the candidates that the classifier accepts and that overlap none; by start, then kind."""
    base = F.filter(spans, lambda s: s["kind"] < BASE)
    more = F.filter(spans, lambda s: (s["kind"] >= BASE) & (logit(s.getField, w) >= 0) & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return F.array_sort(F.concat(base, more))


def _listed(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _model(docs: DataFrame) -> dict:
    text = F.coalesce(F.col("text"), F.lit(""))
    return fit(docs.select(F.explode(candidates(text)).alias("s")).select("s.*"))


def find(docs: DataFrame, fitted: dict | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of docs. Candidates are searched for once."""
    ready(docs.sparkSession)
    found = cut(docs.select("doc_id", candidates(F.coalesce(F.col("text"), F.lit(""))).alias("found")))
    w = fitted or fit(found.select(F.explode("found").alias("s")).select("s.*"))
    base = F.array_sort(F.filter("found", lambda s: s["kind"] < BASE))
    of = lambda kind: F.filter("found", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("bigint").alias(f"n_{KINDS[k]}") for k in range(BASE)]
    return found.select("doc_id", *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(accepted(F.col("found"), w)).alias("spans"))


def redact(docs: DataFrame, fitted: dict | None = None) -> DataFrame:
    """docs with every span of text replaced by <KIND>; of overlapping spans the first counts, and the rest of the others goes too."""
    ready(docs.sparkSession)
    w = fitted or _model(docs)
    text = F.col("text")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        mark = F.concat(F.lit("<"), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)), F.lit(">"))
        new = x["start"] >= s["at"]
        gap = text.substr(s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0)))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(new, F.concat(s["out"], gap, mark)).otherwise(s["out"]).alias("out"))

    spans = accepted(candidates(text), w)
    clean = F.aggregate(spans, zero, step, lambda s: F.concat(s["out"], text.substr(s["at"] + 1, F.length(text))))
    return docs.withColumn("text", F.when(text.isNotNull(), clean)).select(*docs.columns)
