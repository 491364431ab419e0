"""Scalar functions and verdicts, over texts built from the tables' numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridledger.functions import cells, compare, dates, measures, money, text, vectors
from gridledger.operators import joins
from gridledger.registry import query, table

_FORMS = ("Rs. {} lakh", "INR {}", "{} crore", "$ {}", "EUR {} million", "{}", "about {}", "USD {} bn of GBP")
_MONEY = "CASE o_orderkey % 8 WHEN 0 THEN 'Rs. ' || a || ' lakh' WHEN 1 THEN 'INR ' || a WHEN 2 THEN a || ' crore' WHEN 3 THEN '$ ' || a WHEN 4 THEN 'EUR ' || a || ' million' WHEN 5 THEN a WHEN 6 THEN 'about ' || a ELSE 'USD ' || a || ' bn of GBP' END"
_ORDERS = f"(SELECT o_orderkey, {_MONEY} AS t FROM (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS a FROM orders))"


def by_cases(name: str, from_table: str, key: str, out: str, cases, apply, kind: str = "VARCHAR") -> None:
    """Registers a query that applies a function to the cases' texts in turn; its SQL lists what the rules of the operator give for each."""
    lit = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, (bool, int)) else "'" + x.replace("'", "''") + "'"
    wanted = ", ".join(lit(w) for _, w in cases)
    sql = f"SELECT {key}, CAST(list_extract([{wanted}], CAST({key} % {len(cases)} AS INT) + 1) AS {kind}) AS {out} FROM {from_table}"

    @query(name, sql)
    def run(spark, d):
        t = F.element_at(F.array(*(F.lit(x) for x, _ in cases)), (F.col(key) % len(cases)).cast("int") + 1)
        return table(spark, d, from_table).select(key, apply(t).alias(out))


def _forms(key, amount, forms):
    out = F.when(F.lit(False), "")
    for i, form in enumerate(forms):
        before, after = form.split("{}")
        out = out.when(key % len(forms) == i, F.concat(F.lit(before), amount, F.lit(after)))
    return out


def _money_texts(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("a"))
    return o.select("o_orderkey", _forms(F.col("o_orderkey"), F.col("a"), _FORMS).alias("t"))


@query(
    "FN1_money_parse",
    f"""SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 8 IN (3, 6) THEN NULL ELSE regexp_extract(t, '[0-9]+\\.[0-9]+') END AS DOUBLE) AS amount,
    CASE o_orderkey % 8 WHEN 0 THEN 'lakh' WHEN 2 THEN 'crore' WHEN 4 THEN 'million' END AS scale,
    CASE o_orderkey % 8 WHEN 0 THEN 'INR' WHEN 1 THEN 'INR' WHEN 4 THEN 'EUR' END AS currency FROM {_ORDERS}""",
)
def fn1(spark, d):
    m = money.parse(F.col("t"))
    return _money_texts(spark, d).select("o_orderkey", m["amount"].cast("double").alias("amount"), m["scale"].alias("scale"), m["currency"].alias("currency"))


@query(
    "FN2_scale_words",
    """SELECT l_orderkey, l_linenumber, w, CASE WHEN w LIKE 'lakh%' OR w LIKE 'lac%' THEN 'lakh' WHEN w LIKE 'crore%' OR w = 'cr' THEN 'crore' WHEN w LIKE 'million%' OR w = 'mn' THEN 'million'
    WHEN w LIKE 'thousand%' OR w LIKE '000%' THEN 'thousand' WHEN w LIKE 'billion%' THEN 'billion' ELSE 'unit' END AS scale
    FROM (SELECT l_orderkey, l_linenumber, list_extract(['lakhs','lac','crore','cr','million','mn','billions','thousand','000s','dozen'], CAST(l_partkey % 10 AS INT) + 1) AS w FROM lineitem)""",
)
def fn2(spark, d):
    w = F.element_at(F.array(*map(F.lit, ("lakhs", "lac", "crore", "cr", "million", "mn", "billions", "thousand", "000s", "dozen"))), (F.col("l_partkey") % 10).cast("int") + 1)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", w.alias("w"), money.scale_of(w).alias("scale"))


@query(
    "FN3_absolute_amount",
    """SELECT o_orderkey, CASE WHEN contains(s, '.') THEN regexp_replace(s, '\\.?0+$', '') ELSE s END AS absolute FROM (
    SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CASE o_orderkey % 4 WHEN 0 THEN 1000 WHEN 1 THEN 100000 WHEN 2 THEN 10000000 ELSE 1 END AS VARCHAR) AS s FROM orders)""",
)
def fn3(spark, d):
    scale = F.element_at(F.array(*map(F.lit, ("thousand", "lakh", "crore", "unit"))), (F.col("o_orderkey") % 4).cast("int") + 1)
    amount = F.col("o_totalprice").cast("decimal(18,2)").cast(money.EXACT)
    return table(spark, d, "orders").select("o_orderkey", money.plain(money.absolute(amount, scale)).alias("absolute"))


_DATE_FORMS = """CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%d %b %Y')
    WHEN 3 THEN strftime(o_orderdate, '%b %Y') WHEN 4 THEN 'FY ' || CAST(year(o_orderdate) AS VARCHAR) || '-' || lpad(CAST((year(o_orderdate) + 1) % 100 AS VARCHAR), 2, '0') ELSE '45/45/' || CAST(year(o_orderdate) AS VARCHAR) END"""


def _date_texts(spark, d):
    y = F.year("o_orderdate")
    f = lambda p: F.date_format("o_orderdate", p)
    k = F.col("o_orderkey") % 6
    t = (
        F.when(k == 0, f("yyyy-MM-dd")).when(k == 1, f("dd/MM/yyyy")).when(k == 2, f("dd MMM yyyy")).when(k == 3, f("MMM yyyy"))
        .when(k == 4, F.concat(F.lit("FY "), y.cast("string"), F.lit("-"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"))).otherwise(F.concat(F.lit("45/45/"), y.cast("string")))
    )
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate", t.alias("t"))


@query(
    "FN4_date_parse",
    """SELECT o_orderkey, CASE WHEN k < 3 OR k = 6 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, k NOT IN (5, 7) AS ok, k NOT IN (3, 4) AS precise FROM (SELECT o_orderkey, o_orderdate, o_orderkey % 8 AS k FROM orders)""",
)
def fn4(spark, d):
    """Two spaces between the parts are fine; a month joined to its year by a dash is not a date."""
    o = table(spark, d, "orders").withColumn("k", F.col("o_orderkey") % 8)
    f = lambda p: F.date_format("o_orderdate", p)
    fiscal = F.concat(F.lit("FY "), f("yyyy"), F.lit("-"), F.lpad(((F.year("o_orderdate") + 1) % 100).cast("string"), 2, "0"))
    t = F.when(F.col("k") == 0, f("yyyy-MM-dd")).when(F.col("k") == 1, f("dd/MM/yyyy")).when(F.col("k") == 2, f("dd MMM yyyy")).when(F.col("k") == 3, f("MMM yyyy")).when(F.col("k") == 4, fiscal)
    t = t.when(F.col("k") == 5, F.concat(F.lit("45/45/"), f("yyyy"))).when(F.col("k") == 6, f("dd  MMMM yyyy")).otherwise(f("MMM-yyyy"))
    p = dates.parse(t)
    return o.select("o_orderkey", p["date"].alias("day"), p["ok"].alias("ok"), p["precise"].alias("precise"))


@query(
    "FN5_date_span",
    """SELECT o_orderkey, CASE WHEN k < 3 THEN d WHEN k = 3 THEN CAST(date_trunc('month', d) AS DATE) WHEN k = 4 THEN make_date(year(d), 4, 1) END AS first_day,
    CASE WHEN k < 3 THEN d WHEN k = 3 THEN last_day(d) WHEN k = 4 THEN make_date(year(d) + 1, 3, 31) END AS last_day FROM (SELECT o_orderkey, o_orderkey % 6 AS k, CAST(o_orderdate AS DATE) AS d FROM orders)""",
)
def fn5(spark, d):
    s = dates.span(F.col("t"))
    return _date_texts(spark, d).select("o_orderkey", s["first"].alias("first_day"), s["last"].alias("last_day"))


@query(
    "FN6_document_date",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 6 = 3 THEN strftime(o_orderdate, '%Y-%m') WHEN o_orderkey % 6 = 4 THEN strftime(o_orderdate, '%Y') END AS canonical FROM orders""",
)
def fn6(spark, d):
    return _date_texts(spark, d).select("o_orderkey", dates.canonical(F.col("t")).alias("canonical"))


@query(
    "FN8_rate_parse",
    """SELECT p_partkey, CAST(p_size AS DOUBLE) AS value, CASE p_partkey % 5 WHEN 0 THEN 'percent' WHEN 1 THEN 'percent_pa' WHEN 2 THEN 'kwh' WHEN 3 THEN 'mwp' END AS unit, p_partkey % 5 < 4 AS stated FROM part""",
)
def fn8(spark, d):
    t = _forms(F.col("p_partkey"), F.col("p_size").cast("string"), ("{}%", "{} % p.a.", "Rs. {} / kWh", "{} MWp", "{}"))
    r = measures.rate(t)
    return table(spark, d, "part").select("p_partkey", r["value"].alias("value"), r["unit"].alias("unit"), r["stated"].alias("stated"))


@query(
    "FN9_quantity_parse",
    """SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE CAST(p_size AS DOUBLE) * CASE WHEN p_partkey % 5 = 3 THEN 1000 ELSE 1 END END AS value,
    CASE p_partkey % 5 WHEN 0 THEN 'acre' WHEN 1 THEN 'sq_ft' WHEN 2 THEN 'nos' END AS unit FROM part""",
)
def fn9(spark, d):
    t = _forms(F.col("p_partkey"), F.col("p_size").cast("string"), ("{} acres", "{} Sq. Ft", "{} Nos.", "{}e3", "{} of many things"))
    q = measures.quantity(t)
    return table(spark, d, "part").select("p_partkey", q["value"].alias("value"), q["unit"].alias("unit"))


@query(
    "FN10_duration_parse",
    """SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS value, CASE p_partkey % 5 WHEN 0 THEN 'years' WHEN 1 THEN 'months' WHEN 2 THEN 'days' END AS unit FROM part""",
)
def fn10(spark, d):
    t = _forms(F.col("p_partkey"), F.col("p_size").cast("string"), ("{} Yrs", "{} months", "{} days", "{}", "n/a {}"))
    q = measures.duration(t)
    return table(spark, d, "part").select("p_partkey", q["value"].alias("value"), q["unit"].alias("unit"))


@query(
    "FN11_unit_names",
    "SELECT p_partkey, list_extract(['acre','hectare','sq_m','sq_ft','kwh_kwp','mwh_yr','percent','room','nos','widget/day'], CAST(p_partkey % 10 AS INT) + 1) AS unit FROM part",
)
def fn11(spark, d):
    raw = ("Acres", "ha", "Sq. Meter", "ft²", "kWh/kWp", "MWh per year", "%", "Rooms", "No.", "Widget / Day")
    return table(spark, d, "part").select("p_partkey", measures.unit(F.element_at(F.array(*map(F.lit, raw)), (F.col("p_partkey") % 10).cast("int") + 1)).alias("unit"))


@query("FN12_currency_names", "SELECT p_partkey, list_extract(['INR','USD','EUR','GBP',NULL,NULL], CAST(p_partkey % 6 AS INT) + 1) AS currency FROM part")
def fn12(spark, d):
    raw = ("Rs. 5", "5 dollars", "€5", "5 pounds", "$5", "INR 5 or USD 5")
    return table(spark, d, "part").select("p_partkey", money.currency(F.element_at(F.array(*map(F.lit, raw)), (F.col("p_partkey") % 6).cast("int") + 1)).alias("currency"))


@query(
    "FN13_percent_values",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN round(l_discount * 100 / 100.0, 6) ELSE round(l_tax * 100, 6) END AS value, 'unit' AS scale FROM lineitem",
)
def fn13(spark, d):
    percent = F.col("l_linenumber") % 2 == 0
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.when(percent, F.col("l_discount") * 100 / 100).otherwise(F.col("l_tax") * 100), 6).alias("value"), F.lit("unit").alias("scale"))


@query(
    "FN14_numeric_text",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN round(v, 4) WHEN 1 THEN -round(v, 4) WHEN 2 THEN round(v / 100, 4) WHEN 3 THEN 1234567.0 WHEN 4 THEN 1234567.0 END AS number FROM (SELECT event_id, round(value, 2) AS v FROM events)""",
)
def fn14(spark, d):
    v = F.format_string("%.2f", F.round("value", 2))
    k = F.col("event_id") % 6
    t = F.when(k == 0, F.concat(F.lit("Rs. "), v)).when(k == 1, F.concat(F.lit("("), v, F.lit(")"))).when(k == 2, F.concat(v, F.lit("%"))).when(k == 3, "12,34,567").when(k == 4, "1,234,567 INR").otherwise("1,23,4,5")
    return table(spark, d, "events").select("event_id", F.round(cells.numeric(t).cast("double"), 4).alias("number"))


@query("FN15_value_types", "SELECT event_id, list_extract(['empty','bool','error','number','text','number'], CAST(event_id % 6 AS INT) + 1) AS value_type FROM events")
def fn15(spark, d):
    raw = ("  ", "true", "#DIV/0!", "(1,234.50)", "total", "-3.5%")
    return table(spark, d, "events").select("event_id", cells.value_type(F.element_at(F.array(*map(F.lit, raw)), (F.col("event_id") % 6).cast("int") + 1)).alias("value_type"))


@query(
    "FN16_normal_formula",
    "SELECT p_partkey, 'SUM(A' || p_size || ',B' || p_size || ')+''My sheet''!C1&\"a b\"' AS formula FROM part",
)
def fn16(spark, d):
    raw = F.concat(F.lit("=+ sum( a"), F.col("p_size").cast("string"), F.lit(" , b"), F.col("p_size").cast("string"), F.lit(" ) + 'My sheet'!c1 & \"a b\""))
    return table(spark, d, "part").select("p_partkey", cells.normal_formula(raw).alias("formula"))


@query(
    "FN17_formula_references",
    """SELECT p_partkey, i, list_extract(r, i) AS reference, list_extract(k, i) AS kind FROM (SELECT p_partkey, unnest([1, 2, 3]) AS i, ['A' || p_size, '''My sheet''!$B$1:$B$' || p_size, 'Data!C' || p_size] AS r, ['local_cell', 'cross_sheet_range', 'cross_sheet_cell'] AS k FROM part)""",
)
def fn17(spark, d):
    n = F.col("p_size").cast("string")
    raw = F.concat(F.lit("=A"), n, F.lit("+SUM('My sheet'!$B$1:$B$"), n, F.lit(")*Data!C"), n, F.lit("&\"Z9\""))
    rows = table(spark, d, "part").select("p_partkey", F.posexplode(cells.references(raw)).alias("i", "reference"))
    return rows.select("p_partkey", (F.col("i") + 1).alias("i"), "reference", cells.reference_kind(F.col("reference")).alias("kind"))


@query(
    "FN18_a1_letters",
    """SELECT o_orderkey, n, CASE WHEN n > 702 THEN chr(CAST(64 + (n - 703) // 676 + 1 AS INT)) ELSE '' END || CASE WHEN n > 26 THEN chr(CAST(65 + ((n - 27) // 26) % 26 AS INT)) ELSE '' END || chr(CAST(65 + (n - 1) % 26 AS INT)) AS letters, n AS back FROM (SELECT o_orderkey, o_orderkey % 16384 + 1 AS n FROM orders)""",
)
def fn18(spark, d):
    n = F.col("o_orderkey") % 16384 + 1
    return table(spark, d, "orders").select("o_orderkey", n.alias("n"), cells.column_letters(n).alias("letters"), cells.column_number(cells.column_letters(n)).alias("back"))


by_cases(
    "FN19_additive_formula", "part", "p_partkey", "additive",
    [("=A1+B1-C2", True), ("=SUM(A1:A9)", True), ("=MAX(A1,B1)", True), ("=AVERAGE(A1:A9)", True), ("=SUM(A1:A3)+B1", True), ("=A1+12.5", True), ("='P & L'!A1-Sheet2!$B$3", True), ("=A1*B1", False), ("=IF(A1>0,1,2)", False), ("=1+2", False), ("=ROUND(A1,2)", False), ("text", False)],
    cells.additive, "BOOLEAN",
)
by_cases("FN19_pure_sum", "part", "p_partkey", "pure", [("=SUM(A1:A9)+B1", True), ("=A1+B1", True), ("=A1-B1", False), ("=A1+5", False), ("=MAX(A1,B1)", False), ("=SUM(3)", False)], cells.pure_sum, "BOOLEAN")


@query("FN20_divisor_scale", "SELECT p_partkey, list_extract(['lakh','crore','thousand',NULL], CAST(p_partkey % 4 AS INT) + 1) AS scale FROM part")
def fn20(spark, d):
    t = _forms(F.col("p_partkey"), F.col("p_size").cast("string"), ("=A{}/100000", "=A{}/10^7", "=A{}/1e3", "=A{}/12"))
    return table(spark, d, "part").select("p_partkey", cells.divisor_scale(t).alias("scale"))


_FIRM = "CASE s_suppkey % 4 WHEN 0 THEN s_name || ' Pvt. Ltd.' WHEN 1 THEN upper(s_name) || ' PRIVATE LIMITED' WHEN 2 THEN s_name || ' LLP' ELSE s_name END"


def _firms(spark, d):
    n = F.col("s_name")
    k = F.col("s_suppkey") % 4
    return table(spark, d, "supplier").select("s_suppkey", "s_name", F.when(k == 0, F.concat(n, F.lit(" Pvt. Ltd."))).when(k == 1, F.concat(F.upper(n), F.lit(" PRIVATE LIMITED"))).when(k == 2, F.concat(n, F.lit(" LLP"))).otherwise(n).alias("firm"))


@query("FN21_loose_name_key", "SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g') AS key FROM supplier")
def fn21(spark, d):
    return _firms(spark, d).select("s_suppkey", text.loose_key(F.col("firm")).alias("key"))


@query(
    "FN22_edit_similarity",
    "SELECT a.s_suppkey AS a, b.s_suppkey AS b, round(1 - levenshtein(a.s_name, b.s_name) / CAST(greatest(length(a.s_name), length(b.s_name)) AS DOUBLE), 6) AS similarity FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey",
)
def fn22(spark, d):
    s = table(spark, d, "supplier")
    a, b = (s.select(F.col("s_suppkey").alias(k), F.col("s_name").alias(f"n{k}"), "s_nationkey") for k in "ab")
    return a.join(b, "s_nationkey").where("a < b").select("a", "b", F.round(text.edit_similarity(F.col("na"), F.col("nb")), 6).alias("similarity"))


by_cases(
    "FN23_label_phrase", "part", "p_partkey", "phrase",
    [
        ("1.2 Total Sales & Taxes (net)", "total sale and tax"), ("a) Land costs @ 10%", "land cost"), ("Companies 2024", "company"), ("iv. Gross Profits", "gross profit"), ("Growth %", "growth percent"), ("2. Fire fighting works (2.5% of civil cost)", "fire fighting work"),
        ("Fees (net (of tax)", "fee"), ("old) rates", "rate"), ("Bus gas glass classes", "bus gas glass class"), ("कुल लागत", "क ल ल गत"), ("FIRE-FIGHTING WORK ", "fire fighting work"), ("(all of it)", ""),
    ],
    text.label_phrase,
)


by_cases(
    "FN25_sibling_signature", "part", "p_partkey", "signature",
    [("Land and Costs", "cost land"), ("costs land", "cost land"), ("Companies Taxes", "company tax"), ("Sale", "sale"), ("Sales", "sale"), ("Glass", "glass"), ("Gas", "gas"), ("Buses & Boxes", "box bus"), ("Duties, Duty", "duty duty"), ("Churches", "church"), ("Tomatoes", "tomato"), ("Ands", "")],
    text.sibling_signature,
)


by_cases("FN26_script", "part", "p_partkey", "script", [("plain words", "en"), ("நிலம்", "ta"), ("જમીન", "gu"), ("जमीन", "hi"), ("जमीन शाळा", "mr"), ("land નું जमीन", "gu"), ("", "en")], text.script)
by_cases(
    "FN27_transliteration", "part", "p_partkey", "latin",
    [
        ("plain text 12", "plain text 12"), ("कमल", "kamal"), ("राम", "ram"), ("वर्ग मीटर", " sq m"), ("२ एकड़", "2  acre"), ("શ્રી", "shri"), ("જમીન", "jamin"), ("தமிழ்", "tamil"), ("अंक", "ank"), ("औ", "औ"), ("भूमि १२३", "bhumi 123"), ("क-ख", "k-kh"),
    ],
    text.transliterated,
)


@query("FN28_squeeze", "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS squeezed FROM documents")
def fn28(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.squeeze(F.col("text")).cast("binary")).alias("squeezed"))


by_cases(
    "FN30_redact_numbers", "customer", "c_custkey", "redacted",
    [
        ("PAN ABCDE1234F of Ramesh", "PAN of"), ("paid Rs. 5000 on time", "paid on time"), ("cost 12.5 lakhs", "cost"), ("a/c no 123456 open", "open"), ("ratio 1234.56 stays", "ratio 1234.56 stays"), ("CIN U40100TG2010PTC071234", "CIN"),
        ("22abcde1234f1z5 gstin", "gstin"), ("ref 123456789012", "ref"), ("Legal Name", "Legal Name"), ("$ 4,500.50 due", "due"), ("Bhagyanagar_Solar Net Worth", "Net Worth"), ("ref 12345678", "ref 12345678"),
    ],
    text.redacted,
)
by_cases("FN30_label_key", "customer", "c_custkey", "label", [("Bhagyanagar Solar Net Worth", "net_worth"), ("Legal Name", "legal_name"), ("Turnover 2024-25", "turnover"), ("ABCDE1234F", ""), ("Debt/Equity (x)", "debt_equity_x")], text.label_key)


@query(
    "FN31_dummy_value",
    """SELECT c_custkey, round(CASE WHEN v < 0 THEN -1 ELSE 1 END * CASE WHEN abs(v) = 0 THEN 12.34 + j / 100.0 WHEN abs(v) < 1 THEN (j % 80 + 5) / 100.0 WHEN abs(v) < 100 THEN 12.34 + j / 100.0
    WHEN abs(v) < 10000 THEN 123.45 + j / 10.0 ELSE 12345.67 + j END, 4) AS dummy FROM (SELECT c_custkey, c_acctbal AS v, ((ascii('A') * 31 + ascii(substr(n, 1, 1))) % 89) + 10 AS j FROM (SELECT c_custkey, c_acctbal, CAST(c_custkey % 10 AS VARCHAR) AS n FROM customer))""",
)
def fn31(spark, d):
    coordinate = F.concat(F.lit("A"), (F.col("c_custkey") % 10).cast("string"))
    return table(spark, d, "customer").select("c_custkey", F.round(cells.dummy(F.col("c_acctbal"), coordinate), 4).alias("dummy"))


@query("FN32_digit_grouping", "SELECT o_orderkey, format('{:,}', o_orderkey * 12345) AS western, regexp_replace(reverse(regexp_replace(reverse(substr(s, 1, length(s) - 3)), '([0-9]{2})', '\\1,', 'g')), '^,', '') || ',' || right(s, 3) AS indian FROM (SELECT o_orderkey, CAST(o_orderkey * 12345 AS VARCHAR) AS s FROM orders WHERE o_orderkey > 0)")
def fn32(spark, d):
    s = (F.col("o_orderkey") * 12345).cast("string")
    return table(spark, d, "orders").where("o_orderkey > 0").select("o_orderkey", cells.western(s).alias("western"), cells.indian(s).alias("indian"))


# Each feature's FNV-1a hash: the low 31 bits mod 128 are its place, the top bit its sign.
_FNV = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(f, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda h, x: (xor(h, x) * 16777619) % 4294967296)"


@query(
    "FN33_hash_embedding",
    f"""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM benchmark), one AS (SELECT item_id, ws, unnest(ws) AS word FROM w),
    f AS (SELECT item_id, 'w1:' || word AS f, 1 AS k FROM one UNION ALL SELECT item_id, 'c3:' || substr(word, CAST(i AS INT), 3), 1 FROM (SELECT item_id, word, unnest(range(1, length(word) - 1)) AS i FROM one WHERE length(word) >= 4)
    UNION ALL SELECT item_id, 'w2:' || ws[i] || ' ' || ws[i + 1], 2 FROM (SELECT item_id, ws, unnest(range(1, len(ws))) AS i FROM w)),
    h AS (SELECT item_id, k, {_FNV} AS h FROM f), s AS (SELECT item_id, (h % 2147483648) % 128 AS place, sum(CASE WHEN h >= 2147483648 THEN -k ELSE k END) AS x FROM h GROUP BY ALL)
    SELECT item_id, CAST(place AS BIGINT) AS place, round(x / sqrt(sum(x * x) OVER (PARTITION BY item_id)), 6) AS x FROM s WHERE x <> 0""",
)
def fn33(spark, d):
    e = table(spark, d, "benchmark").select("item_id", F.posexplode(vectors.embed(F.col("text"))).alias("place", "x"))
    return e.where("x <> 0").select("item_id", F.col("place").cast("bigint").alias("place"), F.round("x", 6).alias("x"))


@query(
    "FN34_cosine",
    "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id",
)
def fn34(spark, d):
    e = table(spark, d, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, F.col("a") + 1 == F.col("b")).select("a", "b", F.round(vectors.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


@query("FN36_garbled", "SELECT doc_id, length(s) > 0 AND length(regexp_replace(s, '[^\\p{L}\\p{N}]', '', 'g')) * 2 < length(s) AS garbled FROM (SELECT doc_id, regexp_replace(text, '\\s', '', 'g') AS s FROM documents)")
def fn36(spark, d):
    return table(spark, d, "documents").select("doc_id", text.garbled(F.col("text")).alias("garbled"))


@query("FN37_amount_set", "SELECT o_orderkey, list_sort([regexp_replace(a, '\\.?0+$', ''), '1250']) AS amounts FROM (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS a FROM orders)")
def fn37(spark, d):
    a = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return table(spark, d, "orders").select("o_orderkey", text.amounts(F.concat(F.lit("paid "), a, F.lit(" of 1,250.00 and 1250"))).alias("amounts"))


@query("FN38_content_tokens", "SELECT conv_id, turn, len(list_filter(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+(?:\\.\\p{N}+)?')), lambda x: NOT list_contains(['a','an','the','is','are','was','were','do','does','did','we','you','our','have','has','had','what','which','who','where','when','why','how','of','for','to','in','on','at','by','with','from','and','or','not','this','that','it','its','be','been','there','any','about'], x))) AS n FROM conversations")
def fn38(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(text.content_tokens(F.col("text"))).cast("bigint").alias("n"))


@query("FN39_json_field", "SELECT event_id, CAST(props::JSON ->> 'k' AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing FROM events")
def fn39(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), F.get_json_object("props", "$.file_modified_at").alias("missing"))


@query("FN40_json_codec", "SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def fn40(spark, d):
    coded = table(spark, d, "orders").select(F.to_json(F.struct("o_custkey", "o_orderstatus")).alias("j"))
    back = coded.select(F.from_json("j", "o_custkey bigint, o_orderstatus string").alias("r")).select("r.*")
    return back.groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))


by_cases(
    "FN41_amendment_level", "orders", "o_orderkey", "level",
    [("Amendment No. 3", 3), ("Addendum No. 2", 2), ("amendment", 1), ("this amends it", 1), ("Amended agreement", -1), ("Original agreement", 0), ("unamended", 0), ("initial draft", -1), ("Annexure", -1), ("AMENDMENT #12 to base", 12), ("Amendment 99999999999", 1)],
    text.amendment_level, "INT",
)
by_cases("FN41_revision_level", "orders", "o_orderkey", "level", [("Revision 4", 4), ("rev. 2", 2), ("Rev3", 3), ("revised", 1), ("supersedes all", 1), ("base case", 0), ("review 5", -1), ("preview", -1)], text.revision_level, "INT")


@query("FN42_row_instruction", "SELECT p_partkey, p_partkey % 3 = 0 AS ambiguous FROM part")
def fn42(spark, d):
    t = F.element_at(F.array(*map(F.lit, ("the total row", "total of land cost", "land cost"))), (F.col("p_partkey") % 3).cast("int") + 1)
    return table(spark, d, "part").select("p_partkey", F.lower(t).rlike(r"^(?:the )?(?:grand |sub)?totals?(?: row| amount| value)?$").alias("ambiguous"))


@query("FN43_schema_path_quote", "SELECT p_partkey, p_partkey % 2 = 0 AS is_path FROM part")
def fn43(spark, d):
    t = F.when(F.col("p_partkey") % 2 == 0, "properties.seller_name.items[0]").otherwise("Seller: Alpha Power")
    return table(spark, d, "part").select("p_partkey", t.rlike(r"^(?:\$\.?|properties\.)?[a-z_]+(?:\[[0-9]+\])?(?:\.[a-z_]+(?:\[[0-9]+\])?)+$").alias("is_path"))


@query(
    "FN44_parse_tier",
    "SELECT p_partkey, CASE WHEN p_size < 5 THEN 'scan' WHEN p_size < 10 THEN 'figures' WHEN p_retailprice > 1500 THEN 'tables' WHEN p_size > 40 THEN 'dense' ELSE 'fast' END AS tier FROM part",
)
def fn44(spark, d):
    p = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.when(p < 5, "scan").when(p < 10, "figures").when(F.col("p_retailprice") > 1500, "tables").when(p > 40, "dense").otherwise("fast").alias("tier"))


@query("FN45_cost_estimate", "SELECT p_partkey, round(p_size * 3 * 0.00125, 6) AS usd FROM part")
def fn45(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(F.col("p_size") * 3 * 0.00125, 6).alias("usd"))


@query("FN46_semver_bump", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CAST(p_size + 1 AS VARCHAR) || '.0.0' ELSE CAST(p_size AS VARCHAR) || '.' || CAST(p_partkey % 7 + 1 AS VARCHAR) || '.0' END AS version FROM part")
def fn46(spark, d):
    v = F.split(F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 7).cast("string"), F.lit("0")), r"\.")
    number = lambda i: v[i].cast("int")
    out = F.when(F.col("p_size") % 2 == 0, F.concat((number(0) + 1).cast("string"), F.lit(".0.0"))).otherwise(F.concat_ws(".", v[0], (number(1) + 1).cast("string"), F.lit("0")))
    return table(spark, d, "part").select("p_partkey", out.alias("version"))


@query(
    "CMP1_magnitudes",
    "SELECT l_orderkey, l_linenumber, CASE WHEN abs(a - b) <= greatest(abs(a), abs(b)) * 0.01 THEN 'agree' ELSE 'disagree' END AS verdict, round(CASE WHEN greatest(abs(a), abs(b)) = 0 THEN NULL ELSE abs(a - b) * 100 / greatest(abs(a), abs(b)) END, 1) AS apart FROM (SELECT l_orderkey, l_linenumber, l_extendedprice AS a, l_extendedprice * (1 - l_discount / 5) AS b FROM lineitem)",
)
def cmp1(spark, d):
    a, b = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount") / 5)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", compare.magnitudes(a, b).alias("verdict"), F.round(compare.percent_apart(a, b), 1).alias("apart"))


@query("CMP2_money", "SELECT p_partkey, list_extract(['agree','disagree','agree','disagree','not_comparable'], CAST(p_partkey % 5 AS INT) + 1) AS verdict FROM part")
def cmp2(spark, d):
    pairs = (("₹48 cr", "₹48.3 cr"), ("₹48 cr", "₹52.6 cr"), ("4800 lakh", "₹48 crore"), ("480 lakh", "₹48 crore"), ("INR 5", "USD 5"))
    pick = lambda i: F.element_at(F.array(*(F.lit(p[i]) for p in pairs)), (F.col("p_partkey") % 5).cast("int") + 1)
    return table(spark, d, "part").select("p_partkey", compare.money_verdict(pick(0), pick(1)).alias("verdict"))


@query("CMP3_measured", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'agree' WHEN 1 THEN 'disagree' ELSE 'not_comparable' END AS verdict FROM part")
def cmp3(spark, d):
    k = F.col("p_partkey") % 4
    b = F.when(k == 0, 1205.0).when(k == 1, 1300.0).otherwise(1200.0)
    unit = F.when(k == 2, "MWp").when(k < 2, " KWP ")
    return table(spark, d, "part").select("p_partkey", compare.measured_verdict(F.lit(1200.0), F.lit("kWp"), b, unit).alias("verdict"))


@query("CMP4_dates", "SELECT p_partkey, list_extract(['agree','different_readings','precision_mismatch','precision_mismatch','not_comparable'], CAST(p_partkey % 5 AS INT) + 1) AS verdict FROM part")
def cmp4(spark, d):
    pairs = (("2025-03-15", "15 March 2025"), ("15 March 2025", "16 March 2025"), ("March 2025", "15 March 2025"), ("March 2025", "FY 2024-25"), ("2026-02-31", "28 February 2026"))
    pick = lambda i: F.element_at(F.array(*(F.lit(p[i]) for p in pairs)), (F.col("p_partkey") % 5).cast("int") + 1)
    return table(spark, d, "part").select("p_partkey", compare.date_verdict(pick(0), pick(1)).alias("verdict"))


@query("CMP5_names", f"SELECT s_suppkey, 'agree' AS verdict FROM (SELECT s_suppkey, {_FIRM} AS firm FROM supplier)")
def cmp5(spark, d):
    return _firms(spark, d).select("s_suppkey", compare.name_verdict(F.col("firm"), F.col("s_name")).alias("verdict"))


@query(
    "CMP6_sites",
    "SELECT a.p_partkey AS a, b.p_partkey AS b FROM (SELECT p_partkey, p_brand, p_size, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS k FROM part) a JOIN (SELECT p_partkey, p_brand, p_size, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS k FROM part) b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey WHERE 1 - levenshtein(a.k, b.k) / CAST(greatest(length(a.k), length(b.k)) AS DOUBLE) >= 0.8",
)
def cmp6(spark, d):
    """Parts of one key are compared with another key once."""
    key, block = text.loose_key(F.col("p_name")), ["p_brand", "p_size"]
    p = joins.classes(table(spark, d, "part").select("p_partkey", *block, key.alias("k")), [*block, "k"])
    a, b = (p.select(*block, F.col("k").alias(f"k{x}"), F.col("_rows.p_partkey").alias(f"of_{x}")) for x in "ab")
    like = compare.key_similarity(F.col("ka"), F.col("kb"), compare.SITE_SIMILARITY)
    pairs = a.join(b, block).where("ka <= kb").where(like).withColumn("a", F.explode("of_a")).withColumn("b", F.explode("of_b"))
    return pairs.where("a < b or ka < kb and a > b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


@query("CMP7_pair_rule", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'agree' WHEN 1 THEN 'disagree' END AS verdict FROM part")
def cmp7(spark, d):
    k = F.col("p_partkey") % 3
    kind = F.when(k == 0, "rate").when(k == 1, "money").otherwise("text")
    unit = F.when(k == 0, "kwh")
    return table(spark, d, "part").select("p_partkey", compare.pair_verdict(kind, F.lit(4.5), unit, kind, F.when(k == 0, 4.51).otherwise(5.5), unit).alias("verdict"))
