"""Fact retrieval and the pipelines built on it, bound to the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridledger.functions import cells, text
from gridledger.operators import windows as w
from gridledger.plans.facts import FactQuery, retrieve
from gridledger.registry import query, table


@query("fact_retrieval", "SELECT o_orderkey AS fact_id, 'orders/' || o_orderstatus AS path, o_totalprice AS value, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS evidence FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE 'orders/' || o_orderstatus LIKE 'orders/f%' OR 'orders/' || o_orderstatus LIKE 'orders/F%' GROUP BY 1, 2, 3")
def fact_retrieval(spark, d):
    o = table(spark, d, "orders")
    facts = o.select(F.col("o_orderkey").alias("fact_id"), F.col("o_custkey").alias("document_id"), F.concat(F.lit("orders/"), "o_orderstatus").alias("path"), F.lit("commercial").alias("path_root"), F.lit("money").alias("value_kind"), F.lit(0.9).alias("confidence"), F.lit(True).alias("is_current"), F.col("o_totalprice").alias("value"))
    evidence = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("fact_id"), F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").cast("string").alias("source_text"))
    got = retrieve(facts, evidence, FactQuery(path_prefix="orders/f", kind="money", current_only=True))
    return got.select("fact_id", "path", "value", F.array_join(F.transform("evidence", lambda e: e["source_text"]), ",").alias("evidence"))


@query("FLT1_fact_filter", "SELECT o_orderkey AS fact_id FROM orders WHERE o_custkey = 11 AND o_orderstatus = 'F'")
def flt1(spark, d):
    o = table(spark, d, "orders")
    facts = o.select(F.col("o_orderkey").alias("fact_id"), F.col("o_custkey").alias("document_id"), F.col("o_orderpriority").alias("path"), F.lit("legal").alias("path_root"), F.lit("money").alias("value_kind"), F.lit(0.5).alias("confidence"), (F.col("o_orderstatus") == "F").alias("is_current"))
    none = spark.createDataFrame([], "fact_id bigint, ordinal int, source_text string")
    return retrieve(facts, none, FactQuery(document_id=11, current_only=True)).select("fact_id")


@query("SRC2_delimited_cells", "SELECT doc_id, i AS row_num, j AS col_num, md5(trim(c)) AS cell FROM (SELECT doc_id, i, unnest(range(1, len(cs) + 1)) AS j, unnest(cs) AS c FROM (SELECT doc_id, i, string_split(l, '|') AS cs FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE contains(text, '|'))))) WHERE trim(c) <> ''")
def src2(spark, d):
    lines = table(spark, d, "documents").where(F.col("text").contains("|")).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "l"))
    c = lines.select("doc_id", (F.col("i") + 1).cast("bigint").alias("row_num"), F.posexplode(F.split("l", r"\|", -1)).alias("j", "c"))
    return c.where(F.trim("c") != "").select("doc_id", "row_num", (F.col("j") + 1).cast("bigint").alias("col_num"), F.md5(F.trim("c").cast("binary")).alias("cell"))


@query("SRC8_page_text", "SELECT doc_id, length(coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN NULL ELSE source END, ''), text)) AS n FROM documents")
def src8(spark, d):
    markdown = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 2, F.col("source"))
    return table(spark, d, "documents").select("doc_id", F.length(F.coalesce(F.nullif(markdown, F.lit("")), F.col("text"))).cast("bigint").alias("n"))


@query("SRC11_safety_gate", "SELECT p_partkey, CASE WHEN p_size > 48 THEN 'zip_ratio_exceeded' WHEN p_retailprice > 1900 THEN 'too_many_cells' WHEN p_partkey % 50 = 0 THEN 'password_protected' END AS rejection FROM part")
def src11(spark, d):
    code = F.when(F.col("p_size") > 48, "zip_ratio_exceeded").when(F.col("p_retailprice") > 1900, "too_many_cells").when(F.col("p_partkey") % 50 == 0, "password_protected")
    return table(spark, d, "part").select("p_partkey", code.alias("rejection"))


@query("DP1_classification", "SELECT doc_id, CASE WHEN a > b AND a >= 2 THEN 'gpl' WHEN b > a AND b >= 2 THEN 'apache' ELSE 'unknown' END AS type, least(1.0, greatest(a, b) / 2.0) AS confidence FROM (SELECT doc_id, CAST(contains(lower(text), 'gnu general') AS INT) + CAST(contains(lower(text), 'version 3') AS INT) AS a, CAST(contains(lower(text), 'apache license') AS INT) + CAST(contains(lower(text), 'version 2.0') AS INT) AS b FROM documents)")
def dp1(spark, d):
    t = F.lower("text")
    hits = lambda *ps: sum((t.contains(p).cast("int") for p in ps[1:]), t.contains(ps[0]).cast("int"))
    a, b = hits("gnu general", "version 3"), hits("apache license", "version 2.0")
    kind = F.when((a > b) & (a >= 2), "gpl").when((b > a) & (b >= 2), "apache").otherwise("unknown")
    return table(spark, d, "documents").select("doc_id", kind.alias("type"), F.least(F.lit(1.0), F.greatest(a, b) / 2.0).alias("confidence"))


@query("DP2_page_triage", "SELECT doc_id, string_agg(r, ',' ORDER BY r) AS reasons FROM (SELECT doc_id, 'few_characters' AS r FROM documents WHERE length(text) < 20 UNION ALL SELECT doc_id, 'low_quality' FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 'garbled' FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS t FROM documents) WHERE t <> '' GROUP BY 1 HAVING avg(CASE WHEN length(regexp_replace(regexp_replace(t, '\\s', '', 'g'), '[^\\p{L}\\p{N}]', '', 'g')) * 2 < length(regexp_replace(t, '\\s', '', 'g')) THEN 1.0 ELSE 0.0 END) > 0.1) GROUP BY 1")
def dp2(spark, d):
    docs = table(spark, d, "documents")
    few = docs.where(F.length("text") < 20).select("doc_id", F.lit("few_characters").alias("r"))
    low = table(spark, d, "labels").where("quality = 0").select("doc_id", F.lit("low_quality").alias("r"))
    tokens = F.filter(F.split("text", " ", -1), lambda t: t != "")
    bad = F.size(F.filter(tokens, text.garbled)) / F.size(tokens)
    odd = docs.where(F.size(tokens) > 0).where(bad > 0.1).select("doc_id", F.lit("garbled").alias("r"))
    return few.unionByName(low).unionByName(odd).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("r")), ",").alias("reasons"))


@query("DP4_schedule_rows", "SELECT p_partkey, 'schedule.' || field AS field_key, p_name AS line_key, value FROM (SELECT p_partkey, p_name, unnest(['p_brand', 'p_type', 'p_size']) AS field, unnest([p_brand, p_type, CAST(p_size AS VARCHAR)]) AS value FROM part)")
def dp4(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", F.col("p_size").cast("string").alias("p_size"))
    long = p.unpivot(["p_partkey", "p_name"], ["p_brand", "p_type", "p_size"], "field", "value")
    return long.select("p_partkey", F.concat(F.lit("schedule."), "field").alias("field_key"), F.col("p_name").alias("line_key"), "value")


@query("DP5_derived_net_worth", "SELECT o_orderkey, round(a - l, 2) AS net, least(0.9, 0.8) AS confidence FROM (SELECT o_orderkey, o_totalprice AS a, q AS l FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P')")
def dp5(spark, d):
    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("l"))
    o = table(spark, d, "orders").where("o_orderstatus <> 'P'").join(l, "o_orderkey")
    return o.select("o_orderkey", F.round(F.col("o_totalprice") - F.col("l"), 2).alias("net"), F.least(F.lit(0.9), F.lit(0.8)).alias("confidence"))


@query("DP9_entity_tagging", "SELECT doc_id, CASE WHEN n = 1 THEN e END AS entity, CASE WHEN n = 0 THEN 'no_entity' WHEN n > 1 THEN 'several_entities' END AS reason FROM (SELECT doc_id, CAST(contains(t, ' mit license ') AS INT) + CAST(contains(t, ' apache license ') AS INT) AS n, CASE WHEN contains(t, ' mit license ') THEN 'MIT License' ELSE 'Apache License' END AS e FROM (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM documents))")
def dp9(spark, d):
    found = F.array_compact(F.array(*(F.when(text.names(F.col("text"), F.lit(n)), n) for n in ("MIT License", "Apache License"))))
    n = F.size(found)
    return table(spark, d, "documents").select("doc_id", F.when(n == 1, F.get(found, 0)).alias("entity"), F.when(n == 0, "no_entity").when(n > 1, "several_entities").alias("reason"))


@query("DP11_conflict_scan", "SELECT l_partkey, count(*) AS facts, max(u) - min(u) > 0.01 * max(u) AS conflict, CASE WHEN max(u) - min(u) > 0.01 * max(u) THEN arg_max(l_orderkey, (l_shipdate, l_orderkey)) END AS newest FROM (SELECT l_partkey, l_orderkey, l_shipdate, l_extendedprice / l_quantity AS u FROM lineitem) GROUP BY 1 HAVING count(*) > 1")
def dp11(spark, d):
    """Facts of one identity disagree if their extremes do: no pairs are made to tell; the newest settles by rule."""
    u = F.col("l_extendedprice") / F.col("l_quantity")
    apart = F.max("u") - F.min("u") > 0.01 * F.max("u")
    g = table(spark, d, "lineitem").withColumn("u", u).groupBy("l_partkey")
    return g.agg(F.count("*").alias("facts"), apart.alias("conflict"), F.when(apart, F.max_by("l_orderkey", F.struct("l_shipdate", "l_orderkey"))).alias("newest")).where("facts > 1")


@query("DP12_checklist_plan", "SELECT n_nationkey, item, CASE WHEN k IS NULL THEN 'not_provided' WHEN best >= 9000 THEN 'provided' ELSE 'unclear' END AS status FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment AS item FROM customer) LEFT JOIN (SELECT c_nationkey AS k, c_mktsegment AS s, max(c_acctbal) AS best FROM customer GROUP BY 1, 2) ON k = n_nationkey AND s = item")
def dp12(spark, d):
    c = table(spark, d, "customer")
    best = c.groupBy(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("item")).agg(F.max("c_acctbal").alias("best"))
    items = c.agg(F.collect_set("c_mktsegment").alias("items"))  # the checklist: one row
    plan = table(spark, d, "nation").select("n_nationkey").join(F.broadcast(items)).select("n_nationkey", F.explode("items").alias("item"))
    status = F.when(F.col("best").isNull(), "not_provided").when(F.col("best") >= 9000, "provided").otherwise("unclear")
    return plan.join(best, ["n_nationkey", "item"], "left").select("n_nationkey", "item", status.alias("status"))


@query("DP14_report_answers", "SELECT store, id FROM (SELECT 'document' AS store, doc_id AS id, text FROM documents UNION ALL SELECT 'turn', conv_id * 1000 + turn, text FROM conversations UNION ALL SELECT 'item', item_id, text FROM benchmark) WHERE list_has_all(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+(?:\\.\\p{N}+)?'), ['public', 'license'])")
def dp14(spark, d):
    one = lambda t, store, key: table(spark, d, t).select(F.lit(store).alias("store"), key.alias("id"), "text")
    rows = one("documents", "document", F.col("doc_id")).unionByName(one("conversations", "turn", F.col("conv_id") * 1000 + F.col("turn"))).unionByName(one("benchmark", "item", F.col("item_id")))
    return rows.where(text.covers(text.content_tokens(F.col("text")), text.content_tokens(F.lit("which public license?")))).select("store", "id")


@query("DP16_structural_evidence", "SELECT l_suppkey AS sheet, count(DISTINCT l_linenumber) AS columns, 50 - count(DISTINCT CAST(l_quantity AS INT)) AS blank_rows FROM lineitem GROUP BY 1")
def dp16(spark, d):
    q = F.col("l_quantity").cast("int")
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("sheet")).agg(F.to_json(F.struct(F.countDistinct("l_linenumber").alias("columns"), (50 - F.countDistinct(q)).alias("blank_rows"))).alias("j"))
    return g.select("sheet", F.get_json_object("j", "$.columns").cast("bigint").alias("columns"), F.get_json_object("j", "$.blank_rows").cast("bigint").alias("blank_rows"))


@query("DP17_layout_signals", "SELECT doc_id, len(regexp_extract_all(text, '\\|')) AS bars, len(string_split(text, chr(10))) AS lines, length(text) / len(string_split(text, chr(10))) > 200 AS dense FROM documents")
def dp17(spark, d):
    lines = F.size(F.split("text", "\n", -1))
    return table(spark, d, "documents").select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit("|"), F.lit("")))).cast("bigint").alias("bars"), lines.cast("bigint").alias("lines"), (F.length("text") / lines > 200).alias("dense"))


@query("DP18_sheet_redaction", "SELECT event_id, CASE WHEN value < 0 THEN true ELSE false END AS negative FROM events")
def dp18(spark, d):
    coordinate = F.concat(F.lit("B"), F.col("event_id").cast("string"))
    return table(spark, d, "events").select("event_id", (cells.dummy(F.col("value"), coordinate) < 0).alias("negative"))


@query("XO1_quote_resolution", "SELECT item_id, min(tier) AS tier FROM (SELECT item_id, 1 AS tier FROM benchmark b WHERE EXISTS (SELECT 1 FROM conversations c WHERE c.text = b.text) UNION ALL SELECT item_id, 9 FROM benchmark) GROUP BY 1")
def xo1(spark, d):
    b = table(spark, d, "benchmark")
    exact = b.join(table(spark, d, "conversations").select("text"), "text", "left_semi").select("item_id", F.lit(1).alias("tier"))
    return exact.unionByName(b.select("item_id", F.lit(9).alias("tier"))).groupBy("item_id").agg(F.min("tier").alias("tier"))


@query("XO2_evidence_pick", "SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY 2 * CAST(l_returnflag = 'R' AS INT) + CAST(l_discount > 0.05 AS INT) DESC, l_linenumber, l_partkey) = 1")
def xo2(spark, d):
    score = 2 * (F.col("l_returnflag") == "R").cast("int") + (F.col("l_discount") > 0.05).cast("int")
    return w.best_by(table(spark, d, "lineitem"), ["l_orderkey"], [score.desc(), F.col("l_linenumber"), F.col("l_partkey")]).select("l_orderkey", "l_linenumber")


@query("XO4_extractive_summary", "SELECT doc_id, md5(CASE WHEN length(s) > 80 THEN substr(s, 1, 77) || '...' ELSE s END) AS summary FROM (SELECT doc_id, trim(regexp_replace(split_part(text, '. ', 1), '\\s+', ' ', 'g')) AS s FROM documents)")
def xo4(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.first_sentence(F.col("text"), 80).cast("binary")).alias("summary"))


@query("XO6_heading_topic", "SELECT doc_id, CASE WHEN contains(h, 'the') THEN 'article' WHEN contains(h, 'der') THEN 'artikel' WHEN contains(h, 'le') THEN 'titre' END AS topic FROM (SELECT doc_id, lower(split_part(text, chr(10), 1)) AS h FROM documents)")
def xo6(spark, d):
    h = F.lower(F.split_part("text", F.lit("\n"), F.lit(1)))
    return table(spark, d, "documents").select("doc_id", F.when(h.contains("the"), "article").when(h.contains("der"), "artikel").when(h.contains("le"), "titre").alias("topic"))


@query("XO7_unread_sentences", "SELECT doc_id, count(*) AS unread FROM (SELECT doc_id, unnest(string_split(text, '. ')) AS s FROM documents) WHERE NOT contains(s, 'icens') AND length(trim(s)) > 0 GROUP BY 1")
def xo7(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", r"\. ", -1)).alias("s"))
    return s.where(~F.col("s").contains("icens") & (F.length(F.trim("s")) > 0)).groupBy("doc_id").agg(F.count("*").alias("unread"))


@query("XO9_industry_scan", "SELECT source, min(doc_id) AS first_seen FROM documents WHERE contains(text, 'Apache License') GROUP BY 1")
def xo9(spark, d):
    return table(spark, d, "documents").where(F.col("text").contains("Apache License")).groupBy("source").agg(F.min("doc_id").alias("first_seen"))
