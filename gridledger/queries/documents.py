"""Document segmentation, binding and ontology operators, bound to the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridledger.functions import dates, markdown, money, text, vectors
from gridledger.operators import joins, typing
from gridledger.operators import versions as v
from gridledger.operators import windows as w
from gridledger.queries.scalars import by_cases
from gridledger.registry import query, table


@query("GR9_typed_workbooks", "SELECT CAST(s_suppkey AS VARCHAR) AS workbook, coord, kind, scale, currency FROM supplier, (VALUES ('A1', 'quantity', 'unit', NULL), ('B1', 'rate', 'unit', 'INR'), ('C1', 'money', 'unit', 'INR'), ('D1', 'money', 'lakh', 'INR')) t(coord, kind, scale, currency)")
def gr9(spark, d):
    cells = spark.createDataFrame([("A1", None, "quantity", "unit", "kwh", None), ("B1", None, "rate", "unit", "kwh", "INR"), ("C1", "=A1*B1", None, None, None, None), ("D1", "=C1/100000", None, None, None, None)], "coord string, formula string, kind string, scale string, unit string, currency string")
    books = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("workbook")).join(F.broadcast(cells))
    return typing.type_workbooks(books).select("workbook", "coord", "kind", "scale", "currency")


@query("FN7_anchored_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS found FROM orders")
def fn7(spark, d):
    """The first line with an anchor that holds, itself or in the next line, a date."""
    body = F.concat(F.lit("Order form\nDated:\n"), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("\nValid until 01/01/2030"))
    lines = table(spark, d, "orders").select("o_orderkey", F.posexplode(F.split(body, "\n")).alias("i", "l"))
    from pyspark.sql import Window

    nxt = F.lead("l").over(Window.partitionBy("o_orderkey").orderBy("i"))
    date = lambda c: dates.parse(F.regexp_extract(c, r"([0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{4})", 1))["date"]
    found = lines.withColumn("day", F.coalesce(date(F.col("l")), date(nxt))).where(F.col("l").rlike("(?i)dated|valid")).where("day is not null")
    return found.groupBy("o_orderkey").agg(F.min_by("day", "i").alias("found"))


by_cases(
    "FN24_label_normal", "part", "p_partkey", "label",
    [
        ("Sales(Rs. In  Lacs)", "sales ( rs. in lacs )"), ("NetWorth 10%", "net worth 10%"), ("Rs.crore", "rs. crore"), ("PBDIT", "pbdit"), ("INR/kWh", "inr /k wh"), ("Growth%", "growth %"), ("zero\u200bwidth", "zerowidth"), ("Rate:Fixed", "rate : fixed"),
        ("Ｆｕｌｌ", "full"), ("a\u00a0b", "a b"), ("Others", "others"), ("[x]y", "[ x ] y"),
    ],
    text.normal_label,
)


by_cases(
    "FN29_markdown", "part", "p_partkey", "clean",
    [
        ("<table><tr><th>A</th><th>B</th></tr><tr><td>1</td></tr><tr><td>x</td><td>y</td><td>z</td></tr></table>", "| A | B |\n|---|---|\n| 1 |  |\n| x | y z |\n"), ("<table><tr><td colspan=2>T</td></tr><tr><td>a|b</td><td>c &amp; d</td></tr></table>", "| T |  |\n|---|---|\n| a/b | c & d |\n"),
        ("text\nPage 12\nmore", "text\nmore\n"), ("a 1234567890#@!x b 12,34,567.50", "a b 12,34,567.50\n"), ("DATE :\nDate : 22/09/2025", "Date : 22/09/2025\n"), ("![seal: x](y)\nkept", "kept\n"), ("| **DATE : | Khandwa | ARHPJ9494 P |", "| | Khandwa | ARHPJ9494P |\n"),
        ("<!-- page 3 -->body", "body\n"), ("   ", "   "), ("U40100TG2010PTC071234", "U40100TG2010PTC071234\n"), ("code: QR code here\nx", "x\n"),
    ],
    markdown.cleaned,
)


@query("FN35_vector_codec", "SELECT vec_id, len(embedding) * 4 AS bytes, label, true AS same, round(CAST(embedding[2] AS DOUBLE), 5) AS second FROM embeddings")
def fn35(spark, d):
    """To little-endian float32 and back."""
    e = table(spark, d, "embeddings").withColumn("blob", vectors.to_bytes(F.col("embedding"))).withColumn("back", vectors.from_bytes(F.col("blob")))
    return e.select("vec_id", F.length("blob").cast("bigint").alias("bytes"), "label", (F.col("back") == F.col("embedding").cast("array<float>")).alias("same"), F.round(F.get("back", F.lit(1)).cast("double"), 5).alias("second"))


@query("XO3_clause_alias", "SELECT doc_id, CASE WHEN m + a = 1 THEN CASE WHEN m = 1 THEN 'mit' ELSE 'apache' END END AS clause FROM (SELECT doc_id, CAST(contains(t, ' mit license ') AS INT) AS m, CAST(contains(t, ' apache license ') AS INT) AS a FROM (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM documents))")
def xo3(spark, d):
    aliases = {"mit": "MIT License", "apache": "Apache License"}
    found = F.array_compact(F.array(*(F.when(text.names(F.col("text"), F.lit(a)), c) for c, a in aliases.items())))
    return table(spark, d, "documents").select("doc_id", F.when(F.size(found) == 1, F.get(found, 0)).alias("clause"))


@query("XO5_clause_slots", "SELECT o_orderkey, CAST(o_orderkey % 30 + 1 AS DOUBLE) AS term, 'years' AS unit, CAST(o_totalprice AS DOUBLE) AS amount FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice FROM orders)")
def xo5(spark, d):
    from gridledger.functions import measures

    clause = F.concat(F.lit("The term is "), (F.col("o_orderkey") % 30 + 1).cast("string"), F.lit(" years at INR "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    term = measures.duration(F.regexp_extract(clause, r"([0-9]+ (?:years|months|days))", 1))
    return table(spark, d, "orders").select("o_orderkey", term["value"].alias("term"), term["unit"].alias("unit"), money.parse(clause)["amount"].cast("double").alias("amount"))


@query("XO10_first_country", "SELECT source, arg_min(lang, doc_id) AS lang FROM documents WHERE lang <> 'en' GROUP BY 1")
def xo10(spark, d):
    return table(spark, d, "documents").where("lang <> 'en'").groupBy("source").agg(F.min_by("lang", "doc_id").alias("lang"))


@query("XO11_model_sources", "SELECT l_partkey, count(*) AS cells, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS periods FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size < 10 GROUP BY 1")
def xo11(spark, d):
    p = table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, d, "lineitem").join(p, "l_partkey").groupBy("l_partkey").agg(F.count("*").alias("cells"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("periods"))


@query("XO14_merge_participants", "SELECT p_partkey, r, r > 1 AS participant FROM (SELECT p_partkey, unnest(range(1, p_size % 4 + 2)) AS r FROM part)")
def xo14(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.explode(F.sequence(F.lit(1), F.col("p_size") % 4 + 1)).alias("r"))
    return p.select("p_partkey", F.col("r").cast("bigint").alias("r"), (F.col("r") > 1).alias("participant"))


@query("XO15_packet", "SELECT 'region' AS role, count(*) AS n FROM lineitem WHERE l_suppkey = 3 UNION ALL SELECT 'formula_context', count(*) FROM lineitem WHERE l_suppkey <> 3 AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 3)")
def xo15(spark, d):
    l = table(spark, d, "lineitem")
    inside = l.where("l_suppkey = 3")
    context = l.where("l_suppkey <> 3").join(inside.select("l_orderkey"), "l_orderkey", "left_semi")
    one = lambda df, role: df.agg(F.count("*").alias("n")).select(F.lit(role).alias("role"), "n")
    return one(inside, "region").unionByName(one(context, "formula_context"))


@query("XO20_prune_leaves", "SELECT s_suppkey, s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) AS unbound FROM supplier")
def xo20(spark, d):
    gone = table(spark, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("s_nationkey"), F.lit(True).alias("gone"))
    return table(spark, d, "supplier").join(gone, "s_nationkey", "left").select("s_suppkey", F.coalesce("gone", F.lit(False)).alias("unbound"))


@query("XO21_ontology_gate", "SELECT s_suppkey, r_name IN ('ASIA', 'EUROPE') AS allowed FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def xo21(spark, d):
    roots = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"), "r_name")
    return table(spark, d, "supplier").join(roots, "s_nationkey").select("s_suppkey", F.col("r_name").isin("ASIA", "EUROPE").alias("allowed"))


# Labels: a part's name in other letters, with its type, its last word alone, or its brand and, if small, its type.
_LABEL = "CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat(p_name, ' (', p_type, ')') WHEN 2 THEN split_part(p_name, ' ', 2) ELSE concat(p_brand, CASE WHEN p_size < 20 THEN concat(': ', p_type) ELSE '' END) END"


@query(
    "XO22_spine_match",
    f"""WITH l AS (SELECT p_partkey, trim(regexp_replace(lower({_LABEL}), '[^a-z0-9]+', ' ', 'g')) AS k FROM part), s AS (SELECT DISTINCT name, lower(name) AS k FROM (SELECT p_name AS name FROM part UNION ALL SELECT p_type FROM part))
    SELECT p_partkey, first(name ORDER BY CASE WHEN l.k = s.k THEN 0 ELSE 1 END, length(s.k) DESC, name) AS spine FROM l JOIN s ON length(l.k) >= 4 AND length(s.k) >= 4 AND (contains(l.k, s.k) OR contains(s.k, l.k)) GROUP BY 1""",
)
def xo22(spark, d):
    """Each distinct label is matched once."""
    parts = table(spark, d, "part")
    labelled = parts.select("p_partkey", F.expr(_LABEL).alias("label"))
    spine = parts.select(F.explode(F.array("p_name", "p_type")).alias("name")).distinct()
    return labelled.join(joins.spine_match(labelled, spine), "label").select("p_partkey", "spine")


@query("XO23_nested_fields", "SELECT p_type AS parent, count(DISTINCT p_brand) AS columns FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) >= 2")
def xo23(spark, d):
    f = table(spark, d, "part").select(F.concat_ws(".", "p_type", "p_brand").alias("key"))
    return f.groupBy(F.split_part("key", F.lit("."), F.lit(1)).alias("parent")).agg(F.countDistinct(F.split_part("key", F.lit("."), F.lit(2))).alias("columns")).where("columns >= 2")


@query("XO24_mined_fields", "SELECT split_part(p_name, ' ', 2) AS field, count(DISTINCT p_brand) AS documents FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) >= 2")
def xo24(spark, d):
    return table(spark, d, "part").groupBy(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("field")).agg(F.countDistinct("p_brand").alias("documents")).where("documents >= 2")


@query("XO25_structural_fingerprint", "SELECT source, count(DISTINCT split_part(text, chr(10), 1)) AS titles FROM documents GROUP BY 1")
def xo25(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.countDistinct(F.split_part("text", F.lit("\n"), F.lit(1))).alias("titles"))


@query("XO26_leaf_kind", "SELECT p_partkey, list_extract(['date','quantity','boolean','text'], CAST(p_partkey % 4 AS INT) + 1) AS kind FROM part")
def xo26(spark, d):
    k = F.col("p_partkey") % 4
    explicit, json_type = F.when(k == 0, "date"), F.when(k == 1, "number").when(k == 2, "boolean").otherwise("string")
    return table(spark, d, "part").select("p_partkey", F.coalesce(explicit, F.when(json_type == "number", "quantity").when(json_type == "boolean", "boolean").otherwise("text")).alias("kind"))


@query("DP3_label_lines", "SELECT c_custkey, 'customer_name' AS field_key, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer")
def dp3(spark, d):
    synonyms = spark.createDataFrame([("name of customer", "customer_name"), ("market segment", "segment")], "label string, field_key string")
    body = F.concat(F.lit("Name of Customer: "), "c_name", F.lit("\nnothing here\nMarket  Segment : "), "c_mktsegment")
    lines = table(spark, d, "customer").select("c_custkey", F.explode(F.split(body, "\n")).alias("l")).where(F.col("l").contains(":"))
    part = lambda i: F.split("l", ":", 2)[i]
    return lines.select("c_custkey", text.squeeze(F.lower(part(0))).alias("label"), F.trim(part(1)).alias("value")).join(F.broadcast(synonyms), "label").select("c_custkey", "field_key", "value")


@query("XO27_labeled_lines", "SELECT c_custkey, c_acctbal >= 0 AS bound FROM customer")
def xo27(spark, d):
    line = F.concat(F.when(F.col("c_acctbal") >= 0, "Balance").otherwise("Overdraft"), F.lit(": "), F.col("c_acctbal").cast("string"))
    return table(spark, d, "customer").select("c_custkey", (F.split_part(line, F.lit(":"), F.lit(1)) == "Balance").alias("bound"))


@query("XO29_unit_by_group", "SELECT l_partkey, count(*) AS cells, CASE WHEN p_size % 2 = 0 THEN 'nos' ELSE 'kwp' END AS unit FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, p_size")
def xo29(spark, d):
    decisions = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") % 2 == 0, "nos").otherwise("kwp").alias("unit"))
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("cells")).join(decisions, "l_partkey").select("l_partkey", "cells", "unit")


@query("XO30_not_applicable", "SELECT c_custkey, CASE WHEN c_acctbal < 0 AND c_custkey % 2 = 0 THEN 'not_applicable' WHEN c_acctbal < 0 THEN 'not_provided' ELSE 'provided' END AS status FROM customer")
def xo30(spark, d):
    quoted = table(spark, d, "customer").where("c_custkey % 2 = 0").select("c_custkey", F.lit(True).alias("quote"))
    c = table(spark, d, "customer").withColumn("status", F.when(F.col("c_acctbal") < 0, "not_provided").otherwise("provided"))
    return c.join(quoted, "c_custkey", "left").select("c_custkey", F.when((F.col("status") == "not_provided") & F.col("quote"), "not_applicable").otherwise(F.col("status")).alias("status"))


@query("XO31_draft_items", "SELECT p_partkey FROM part WHERE p_size > 10 AND length(p_name) > 8")
def xo31(spark, d):
    return table(spark, d, "part").where("p_size > 10 and length(p_name) > 8").select("p_partkey")


@query("XO33_layout_hydration", "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS blocks FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def xo33(spark, d):
    bare = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")
    return bare.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("l")).groupBy("doc_id").agg(F.count("*").alias("blocks"))


@query("XO34_header_evidence", "SELECT a.event_id, max(b.event_id) AS header FROM (SELECT event_id, user_id FROM events WHERE event_type = 'click') a JOIN (SELECT event_id, user_id FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND b.event_id <= a.event_id GROUP BY 1")
def xo34(spark, d):
    e = table(spark, d, "events")
    got = joins.nearest_above(e.where("event_type = 'click'").select("event_id", "user_id"), e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("header")), ["user_id"], "event_id", "header", "event_id")
    return got.where("header is not null").select("event_id", "header")


@query("DP6_label_resolution", "SELECT p_partkey, CASE WHEN n = 0 THEN 'NONE' WHEN n = 1 THEN 'UNIQUE' ELSE 'AMBIGUOUS' END AS outcome FROM (SELECT p_partkey, (SELECT count(*) FROM nation WHERE n_nationkey = p_size OR n_regionkey = p_size) AS n FROM part)")
def dp6(spark, d):
    n = table(spark, d, "nation")
    hits = n.select(F.col("n_nationkey").alias("p_size"), "n_nationkey").union(n.select("n_regionkey", "n_nationkey")).distinct().groupBy("p_size").agg(F.count("*").alias("n"))
    p = table(spark, d, "part").join(hits, "p_size", "left")
    return p.select("p_partkey", F.when(F.col("n").isNull(), "NONE").when(F.col("n") == 1, "UNIQUE").otherwise("AMBIGUOUS").alias("outcome"))


@query("DP7_binding_cascade", "SELECT c_custkey, coalesce(s_name, n_name, 'unbound') AS path FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey > 1")
def dp7(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_name"), "c_custkey", "left")
    c = c.join(table(spark, d, "nation").where("n_regionkey > 1").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey", "left")
    return c.select("c_custkey", F.coalesce("s_name", "n_name", F.lit("unbound")).alias("path"))


@query("DP8_amount_roles", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 1 THEN 'total' WHEN l_discount > 0.05 THEN 'add' ELSE 'helper' END AS role FROM lineitem")
def dp8(spark, d):
    role = F.when(F.col("l_linenumber") == 1, "total").when(F.col("l_discount") > 0.05, "add").otherwise("helper")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", role.alias("role"))


@query("DP10_site_tagging", "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) END AS site FROM orders GROUP BY 1")
def dp10(spark, d):
    from gridledger.operators.aggregates import only

    return table(spark, d, "orders").groupBy("o_custkey").agg(only(F.col("o_orderpriority")).alias("site"))


@query("DP13_conflict_override", "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'conflicting' ELSE 'provided' END AS status FROM customer")
def dp13(spark, d):
    open_ = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("open")).distinct()
    return table(spark, d, "customer").join(open_, "c_custkey", "left").select("c_custkey", F.when(F.col("open"), "conflicting").otherwise("provided").alias("status"))


@query("DP15_qa_bundle", "SELECT 'facts' AS section, count(*) AS n FROM orders UNION ALL SELECT 'open', count(*) FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'sites', count(DISTINCT c_nationkey) FROM customer")
def dp15(spark, d):
    o = table(spark, d, "orders")
    sections = {"facts": o.agg(F.count("*").alias("n")), "open": o.where("o_orderstatus = 'O'").agg(F.count("*").alias("n")), "sites": table(spark, d, "customer").agg(F.countDistinct("c_nationkey").alias("n"))}
    out = None
    for name, df in sections.items():
        one = df.select(F.lit(name).alias("section"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("DP19_input_typing", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'money' WHEN 1 THEN 'percent' WHEN 2 THEN 'count' END AS kind FROM part")
def dp19(spark, d):
    label = F.element_at(F.array(*map(F.lit, ("Sales (Rs. in lakh)", "Margin %", "No. of rooms", "Remarks"))), (F.col("p_partkey") % 4).cast("int") + 1)
    kind = F.when(label.contains("%"), "percent").when(money.currency(label).isNotNull(), "money").when(label.rlike(r"(?i)^(?:no\.?|number) of"), "count")
    return table(spark, d, "part").select("p_partkey", kind.alias("kind"))


@query("VR4_snapshot_save", "SELECT o_custkey, max(o_orderkey) AS fact_id, CASE WHEN o_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS run FROM orders GROUP BY 1")
def vr4(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("fact_id"))
    return v.replace_by_key(o.withColumn("run", F.lit("old")), o.where("o_custkey % 2 = 0").withColumn("run", F.lit("new")), ["o_custkey"])


@query("SRC10_keyed_scan", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_suppkey = 7 ORDER BY l_orderkey, l_linenumber, l_partkey")
def src10(spark, d):
    return table(spark, d, "lineitem").where("l_suppkey = 7").select("l_orderkey", "l_linenumber", "l_partkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")


@query("JN18_left_band", "SELECT event_id, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS band FROM events")
def jn18b(spark, d):
    band = w.fill_down(F.when(F.col("event_type") == "signup", F.col("event_id")), ["user_id"], [F.col("event_id")])
    return table(spark, d, "events").select("event_id", band.alias("band"))
