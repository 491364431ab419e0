"""Joins and filters, bound to the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridledger.functions import cells, text
from gridledger.operators import conflicts, joins
from gridledger.registry import query, table


@query("FLT2_exists_probe", "SELECT n_nationkey FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)")
def flt2(spark, d):
    rich = table(spark, d, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"))
    return table(spark, d, "nation").join(rich, "n_nationkey", "left_semi").select("n_nationkey")


@query("FLT3_range_contains", "SELECT l_orderkey, l_linenumber, (l_quantity <= 20 AND l_linenumber BETWEEN 1 AND 3) AS in_block, l_linenumber = 2 AS in_column, l_quantity = 7 AS in_row FROM lineitem")
def flt3(spark, d):
    row, col = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    hit = lambda ref: cells.contains(F.lit(ref), row, col)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", hit("Data!$C$20:A1").alias("in_block"), hit("B:B").alias("in_column"), hit("$7:$7").alias("in_row"))


@query("FLT4_bbox", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice BETWEEN 1000 AND 1500")
def flt4(spark, d):
    return table(spark, d, "part").where(F.col("p_size").between(10, 20) & F.col("p_retailprice").between(1000, 1500)).select("p_partkey")


@query("FLT5_in_list", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def flt5(spark, d):
    ids = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(ids, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("FLT6_text_containment", "SELECT doc_id FROM documents WHERE contains(lower(text), 'licensed under')")
def flt6(spark, d):
    return table(spark, d, "documents").where(F.lower("text").contains("licensed under")).select("doc_id")


@query("FLT7_isolated", "SELECT c_custkey FROM customer WHERE c_acctbal < 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def flt7(spark, d):
    linked = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").where("c_acctbal < 0").join(linked, "c_custkey", "left_anti").select("c_custkey")


@query("FLT8_numeric_column", "SELECT event_type, sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) AS numeric, count(*) AS n FROM events GROUP BY 1")
def flt8(spark, d):
    t = F.when(F.col("event_id") % 3 == 0, F.format_string("%.2f", "value")).otherwise(F.col("event_type"))
    return table(spark, d, "events").groupBy("event_type").agg(F.sum((cells.value_type(t) == "number").cast("bigint")).alias("numeric"), F.count("*").alias("n"))


@query("FLT9_spend_ceiling", "SELECT c_custkey, CASE WHEN c_acctbal % 7 < 1 AND c_acctbal >= 0 THEN true WHEN c_acctbal <= 0 THEN false WHEN spent >= c_acctbal THEN false ELSE spent + 100 <= c_acctbal END AS allowed FROM (SELECT c_custkey, c_acctbal, c_custkey % 5000 AS spent FROM customer)")
def flt9(spark, d):
    ceiling = F.when((F.col("c_acctbal") % 7 < 1) & (F.col("c_acctbal") >= 0), None).otherwise(F.col("c_acctbal"))
    spent = F.col("c_custkey") % 5000
    allowed = F.when(ceiling.isNull(), True).when(ceiling <= 0, False).when(spent >= ceiling, False).otherwise(spent + 100 <= ceiling)
    return table(spark, d, "customer").select("c_custkey", allowed.alias("allowed"))


@query("FLT10_page_furniture", "SELECT doc_id, count(*) FILTER (WHERE length(trim(l)) > 0 AND NOT regexp_matches(trim(l), '^(?i:page )?[0-9]+( ?(of|/) ?[0-9]+)?$')) AS body_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id")
def flt10(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("l"))
    keep = (F.length(F.trim("l")) > 0) & ~F.trim("l").rlike(r"^(?i:page )?[0-9]+( ?(of|/) ?[0-9]+)?$")
    return lines.groupBy("doc_id").agg(F.count(F.when(keep, 1)).alias("body_lines"))


@query("FLT11_page_selection", "SELECT o_orderkey, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR) END, ',' ORDER BY a) AS wire FROM (SELECT o_orderkey, min(p) AS a, max(p) AS b FROM (SELECT o_orderkey, p, p - row_number() OVER (PARTITION BY o_orderkey ORDER BY p) AS g FROM (SELECT DISTINCT o_orderkey, unnest([1, 2, 3, o_orderkey % 9 + 1, 12]) AS p FROM orders)) GROUP BY o_orderkey, g) GROUP BY o_orderkey")
def flt11(spark, d):
    wire = F.concat(F.lit("12,1-3,"), (F.col("o_orderkey") % 9 + 1).cast("string"))
    part = lambda x, i: F.split_part(x, F.lit("-"), F.lit(i)).cast("int")
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(wire, ","), lambda x: F.sequence(part(x, 1), F.when(x.contains("-"), part(x, 2)).otherwise(part(x, 1)))))))
    starts = F.filter(pages, lambda p: ~F.array_contains(pages, p - 1))
    ends = F.filter(pages, lambda p: ~F.array_contains(pages, p + 1))
    spans = F.zip_with(starts, ends, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a.cast("string"), b.cast("string"))))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(spans, ",").alias("wire"))


@query("JN1_inner_chain", "SELECT o_orderkey, c_custkey, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 200000")
def jn1(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 200000")
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.join(c, "o_custkey").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "n_name", "r_name")


@query("JN2_left_chain", "SELECT s_suppkey, n_name, r_name, c.n AS customers FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_name LIKE 'A%' LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 9500 GROUP BY 1) c ON c_nationkey = n_nationkey")
def jn2(spark, d):
    rich = table(spark, d, "customer").where("c_acctbal > 9500").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    s = s.join(table(spark, d, "region").where("r_name like 'A%'"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return s.join(rich, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name", "r_name", "customers")


@query("JN3_nested_fold", "SELECT o_orderkey, string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice > 100000 GROUP BY 1")
def jn3(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 100000").select("o_orderkey")
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    lines = F.array_join(F.transform("x", lambda s: F.concat_ws(":", s["l_linenumber"].cast("string"), s["l_partkey"].cast("string"))), ",")
    return o.join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", lines.alias("lines"))


@query("JN4_using", "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
def jn4(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id").select("doc_id", "lang", "quality")


@query("JN5_range_join", "SELECT s_suppkey, p_partkey FROM supplier JOIN part ON p_brand = 'Brand#' || CAST(s_suppkey % 25 + 1 AS VARCHAR) AND p_size BETWEEN s_suppkey % 40 AND s_suppkey % 40 + 10")
def jn5(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25 + 1).cast("string")).alias("p_brand"), (F.col("s_suppkey") % 40).alias("lo"), (F.col("s_suppkey") % 40 + 10).alias("hi"))
    return joins.range_join(s, table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand"], "lo", "hi", "p_size", 8).select("s_suppkey", "p_partkey")


@query("JN5_cells_in_references", "SELECT l.l_orderkey, l.l_linenumber, r.id FROM lineitem l JOIN (SELECT s_suppkey AS id, s_suppkey % 40 + 1 AS top, s_suppkey % 40 + 6 AS bottom FROM supplier) r ON l.l_suppkey = r.id AND CAST(l_quantity AS INT) BETWEEN top AND bottom AND l_linenumber BETWEEN 2 AND 4")
def jn5b(spark, d):
    n = F.col("s_suppkey") % 40
    r = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sheet"), F.col("s_suppkey").alias("id"), F.concat(F.lit("$B$"), (n + 1).cast("string"), F.lit(":D"), (n + 6).cast("string")).alias("ref"))
    r = r.select("sheet", "id", cells.bounds(F.col("ref")).alias("b")).select("sheet", "id", "b.*")
    c = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("sheet"), F.col("l_quantity").cast("int").alias("row"), F.col("l_linenumber").alias("col"), "l_orderkey", "l_linenumber")
    return joins.cells_in_ranges(r, c, 8).select("l_orderkey", "l_linenumber", "id")


@query("JN6_sheet_coordinates", "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey AND lower(trim(CASE WHEN o_orderkey % 2 = 0 THEN ' ' || upper(c_mktsegment) ELSE c_mktsegment END)) = lower(c_mktsegment)")
def jn6(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.lower(F.trim("c_mktsegment")).alias("sheet"))
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    explicit = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" "), F.upper("c_mktsegment")))
    o = o.select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.lower(F.trim(F.coalesce(explicit, F.col("c_mktsegment")))).alias("sheet"))
    return o.join(c, ["c_custkey", "sheet"]).select("o_orderkey", "c_custkey")


def _boxes(spark, d, side, pred):
    p = table(spark, d, "part").where(pred)
    x, y = F.col("p_size") * 10.0, F.col("p_retailprice") / 2
    return p.select(F.col("p_partkey").alias(side), F.col("p_brand").alias("page"), x.alias(f"x0_{side}"), y.alias(f"y0_{side}"), (x + 15).alias(f"x1_{side}"), (y + 10).alias(f"y1_{side}"))


_BOX = "(SELECT p_partkey AS {0}, p_brand AS page, p_size * 10.0 AS x0_{0}, p_retailprice / 2 AS y0_{0}, p_size * 10.0 + 15 AS x1_{0}, p_retailprice / 2 + 10 AS y1_{0} FROM part WHERE p_partkey % 2 = {1})"


@query("JN7_near_boxes", f"SELECT a, b FROM {_BOX.format('a', 0)} JOIN {_BOX.format('b', 1)} USING (page) WHERE x0_a <= x1_b + 24 AND x0_b - 24 <= x1_a AND y0_a <= y1_b + 24 AND y0_b - 24 <= y1_a")
def jn7(spark, d):
    return joins.near_boxes(_boxes(spark, d, "a", "p_partkey % 2 = 0"), _boxes(spark, d, "b", "p_partkey % 2 = 1"), ["page"], 24.0, 64.0).select("a", "b")


@query("JN8_overlapping_boxes", f"SELECT a, b FROM {_BOX.format('a', 0)} JOIN {_BOX.format('b', 1)} USING (page) WHERE x0_a < x1_b AND x0_b < x1_a AND y0_a < y1_b AND y0_b < y1_a")
def jn8(spark, d):
    near = joins.near_boxes(_boxes(spark, d, "a", "p_partkey % 2 = 0"), _boxes(spark, d, "b", "p_partkey % 2 = 1"), ["page"], 0.0, 64.0)
    c = F.col
    return near.where(joins.overlap(c("x0_a"), c("x1_a"), c("x0_b"), c("x1_b")) & joins.overlap(c("y0_a"), c("y1_a"), c("y0_b"), c("y1_b"))).select("a", "b")


@query("JN9_pairs_in_group", "SELECT l.l_partkey AS part, l.k AS a, r.k AS b FROM (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS k, l_suppkey, l_extendedprice / l_quantity AS u FROM lineitem WHERE l_returnflag = 'R') l JOIN (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS k, l_suppkey, l_extendedprice / l_quantity AS u FROM lineitem WHERE l_returnflag = 'R') r ON l.l_partkey = r.l_partkey AND l.k < r.k AND l.l_suppkey <> r.l_suppkey AND abs(l.u - r.u) > greatest(l.u, r.u) * 0.5")
def jn9(spark, d):
    f = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("u"))
    l, r = f.alias("l"), f.alias("r")
    on = (F.col("l.l_partkey") == F.col("r.l_partkey")) & (F.col("l.k") < F.col("r.k")) & (F.col("l.l_suppkey") != F.col("r.l_suppkey"))
    return l.join(r, on).where(F.abs(F.col("l.u") - F.col("r.u")) > F.greatest("l.u", "r.u") * 0.5).select(F.col("l.l_partkey").alias("part"), F.col("l.k").alias("a"), F.col("r.k").alias("b"))


_FACTS = """SELECT p_partkey AS fact_id, CASE p_partkey % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'money' WHEN 2 THEN 'rate' ELSE 'quantity' END AS kind, p_size % 10 > 1 AS bound,
    CASE WHEN p_size % 10 > 0 THEN p_partkey END AS path, 'FY' || CAST(p_size % 3 AS VARCHAR) AS period, CASE WHEN p_size % 7 > 0 THEN p_size END AS number, CASE WHEN p_size % 2 = 0 THEN 'Acre' ELSE 'kwp' END AS unit FROM part"""
_MODEL = """SELECT l_partkey AS path, l_orderkey * 10 + l_linenumber AS source, CASE WHEN l_linenumber < 4 THEN l_quantity END AS number, CASE WHEN l_linenumber = 5 THEN '=A1' END AS formula, CASE WHEN l_linenumber <> 2 THEN 'FY' || CAST(l_suppkey % 3 AS VARCHAR) END AS period,
    l_suppkey % 11 = 0 AS ambiguous_period, CASE WHEN l_suppkey % 13 > 0 THEN CASE l_partkey % 5 WHEN 1 THEN 'money' WHEN 2 THEN 'rate' WHEN 3 THEN 'quantity' ELSE 'percent' END END AS reading, l_suppkey % 17 = 0 AS refused,
    CASE WHEN l_suppkey % 4 > 0 THEN l_extendedprice END AS absolute, CASE WHEN l_suppkey % 2 = 0 THEN 'acre' ELSE 'kWp' END AS unit FROM lineitem WHERE l_discount > 0.09"""


@query(
    "JN10_comparable_facts",
    f"""WITH f AS ({_FACTS}), c AS ({_MODEL}), k AS (SELECT *, number IS NOT NULL OR formula IS NOT NULL AS num, count(*) FILTER (number IS NOT NULL OR formula IS NOT NULL) OVER (PARTITION BY path) AS nums FROM c),
    o AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY path) AS n FROM k WHERE num OR nums = 0) QUALIFY row_number() OVER (PARTITION BY path ORDER BY source) = 1)
    SELECT f.fact_id, CASE WHEN NOT f.bound AND f.path IS NULL THEN 'no_shared_path' WHEN NOT f.bound THEN 'unbound' WHEN o.n IS NULL THEN 'no_cell' WHEN o.n > 1 THEN 'several_cells' WHEN o.ambiguous_period THEN 'ambiguous_period' WHEN o.period <> f.period THEN 'other_period'
    WHEN o.reading IS NULL OR o.refused THEN 'no_reading' WHEN o.reading <> f.kind THEN 'other_kind' WHEN f.kind = 'money' AND o.absolute IS NULL THEN 'no_absolute_amount' WHEN f.kind <> 'money' AND o.number IS NULL THEN 'cell_without_number'
    WHEN f.kind <> 'money' AND f.number IS NULL THEN 'fact_without_number' WHEN f.kind <> 'money' AND lower(o.unit) <> lower(f.unit) THEN 'other_unit' ELSE 'compare' END AS outcome, CASE WHEN o.n = 1 THEN o.source END AS source
    FROM f LEFT JOIN o ON o.path = f.path WHERE f.kind <> 'text'""",
)
def jn10(spark, d):
    p, l = table(spark, d, "part"), table(spark, d, "lineitem").where("l_discount > 0.09")
    facts = p.selectExpr(
        "p_partkey AS fact_id", "element_at(array('text', 'money', 'rate', 'quantity', 'quantity'), CAST(p_partkey % 5 AS INT) + 1) AS kind", "p_size % 10 > 1 AS bound", "CASE WHEN p_size % 10 > 0 THEN p_partkey END AS path",
        "concat('FY', p_size % 3) AS period", "CASE WHEN p_size % 7 > 0 THEN p_size END AS number", "CASE WHEN p_size % 2 = 0 THEN 'Acre' ELSE 'kwp' END AS unit",
    )
    cells = l.selectExpr(
        "l_partkey AS path", "l_orderkey * 10 + l_linenumber AS source", "CASE WHEN l_linenumber < 4 THEN l_quantity END AS number", "CASE WHEN l_linenumber = 5 THEN '=A1' END AS formula", "CASE WHEN l_linenumber <> 2 THEN concat('FY', l_suppkey % 3) END AS period",
        "l_suppkey % 11 = 0 AS ambiguous_period", "CASE WHEN l_suppkey % 13 > 0 THEN element_at(array('percent', 'money', 'rate', 'quantity', 'percent'), CAST(l_partkey % 5 AS INT) + 1) END AS reading", "l_suppkey % 17 = 0 AS refused",
        "CASE WHEN l_suppkey % 4 > 0 THEN l_extendedprice END AS absolute", "CASE WHEN l_suppkey % 2 = 0 THEN 'acre' ELSE 'kWp' END AS unit",
    )
    return conflicts.comparisons(facts, cells)


@query("JN11_null_safe_scope", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM (SELECT s_suppkey, CASE WHEN s_nationkey % 3 > 0 THEN s_nationkey END AS k FROM supplier) a JOIN (SELECT s_suppkey, CASE WHEN s_nationkey % 3 > 0 THEN s_nationkey END AS k FROM supplier) b ON a.k IS NOT DISTINCT FROM b.k AND a.s_suppkey < b.s_suppkey")
def jn11(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_nationkey") % 3 > 0, F.col("s_nationkey")).alias("k"))
    a, b = s.alias("a"), s.alias("b")
    return a.join(b, F.col("a.k").eqNullSafe(F.col("b.k")) & (F.col("a.s_suppkey") < F.col("b.s_suppkey"))).select(F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b"))


@query("JN12_token_cover", "SELECT doc_id FROM documents WHERE list_has_all(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+(?:\\.\\p{N}+)?'), ['licensed', 'under'])")
def jn12(spark, d):
    wanted = text.content_tokens(F.lit("which is licensed under?"))
    return table(spark, d, "documents").where(text.covers(text.content_tokens(F.col("text")), wanted)).select("doc_id")


@query("JN13_name_in_text", "SELECT doc_id FROM documents WHERE contains(' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ', ' apache license ')")
def jn13(spark, d):
    return table(spark, d, "documents").where(text.names(F.col("text"), F.lit("Apache License"))).select("doc_id")


@query("JN14_fuzzy_names", "SELECT a.s_suppkey AS a, b.s_suppkey AS b, CASE WHEN s >= 0.95 THEN 'match' ELSE 'ambiguous' END AS outcome FROM (SELECT a.s_suppkey, b.s_suppkey, 1 - levenshtein(a.k, b.k) / CAST(greatest(length(a.k), length(b.k)) AS DOUBLE) AS s, a, b FROM (SELECT s_suppkey, s_nationkey, regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g') AS k FROM supplier) a JOIN (SELECT s_suppkey, s_nationkey, regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g') AS k FROM supplier) b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey) WHERE s >= 0.8")
def jn14(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", text.loose_key(F.col("s_name")).alias("k"))
    a, b = s.alias("a"), s.alias("b")
    p = a.join(b, (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.s_suppkey") < F.col("b.s_suppkey")))
    p = p.withColumn("s", text.edit_similarity(F.col("a.k"), F.col("b.k"))).where("s >= 0.8")
    return p.select(F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b"), F.when(F.col("s") >= 0.95, "match").otherwise("ambiguous").alias("outcome"))


@query("JN15_best_window")
def jn15(spark, d):
    pages = table(spark, d, "benchmark")
    names = pages.select("item_id", F.array_join(F.slice(text.words(F.col("text")), 2, 2), " ").alias("name")).where("length(name) > 4").select(F.col("item_id").alias("name_id"), "name")
    return joins.best_window(pages, names, "item_id", "text", "name_id", "name", 0.8).select("item_id", "name_id", F.round("score", 6).alias("score"), "phrase")


@query(
    "JN16_phrase_match",
    """SELECT doc_id, phrase, count(*) AS hits FROM (SELECT doc_id, unnest(regexp_extract_all(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), '\\b(?:gnu general public license|general public license|licensed under|public license|mit license|license|under)\\b')) AS phrase FROM documents) GROUP BY ALL""",
)
def jn16(spark, d):
    names = ("license", "licensed under", "under", "mit license", "public license", "general public license", "gnu general public license")
    docs = table(spark, d, "documents").select("doc_id", text.words(F.col("text")).alias("w"))
    hits = joins.phrase_hits(docs, "doc_id", "w", spark.createDataFrame([(x,) for x in names], "phrase string"))
    return hits.groupBy("doc_id", "phrase").agg(F.count("*").alias("hits"))


@query("JN17_longest_prefix", "SELECT p_partkey, max_by(n, length(n)) AS name FROM (SELECT p_partkey, p_type || ' ' || p_name AS label FROM part) JOIN (SELECT DISTINCT p_type AS n FROM part UNION SELECT DISTINCT p_type || ' ' || split_part(p_name, ' ', 1) FROM part WHERE p_size > 48) ON label = n OR starts_with(label, n || ' ') OR starts_with(label, n || ':') OR starts_with(label, n || '-') GROUP BY 1")
def jn17(spark, d):
    p = table(spark, d, "part")
    names = p.select(F.col("p_type").alias("name")).union(p.where("p_size > 48").select(F.concat("p_type", F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(1))))).distinct()
    return joins.longest_prefix(p.select("p_partkey", F.concat_ws(" ", "p_type", "p_name").alias("label")), names, "label", "name").select("p_partkey", "name")


@query("JN18_nearest_above", "SELECT e.event_id, max(b.event_id) AS band FROM (SELECT event_id, user_id FROM events WHERE event_type <> 'purchase') e LEFT JOIN (SELECT event_id, user_id FROM events WHERE event_type = 'purchase') b ON e.user_id = b.user_id AND b.event_id <= e.event_id GROUP BY 1")
def jn18(spark, d):
    e = table(spark, d, "events")
    points = e.where("event_type <> 'purchase'").select("event_id", "user_id")
    bands = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("band"))
    return joins.nearest_above(points, bands, ["user_id"], "event_id", "band", "event_id").select("event_id", "band")


@query("JN19_narrowest_owner", "SELECT o_orderkey, arg_min(r, (is_parent, hi - lo)) AS region FROM (SELECT o_orderkey, o_custkey FROM orders) JOIN (SELECT c_custkey AS r, c_custkey AS lo, c_custkey + 10 + c_custkey % 50 AS hi, false AS is_parent FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT -1, 0, 100000000, true) ON o_custkey BETWEEN lo AND hi GROUP BY 1")
def jn19(spark, d):
    cells_ = table(spark, d, "orders").select(F.lit(1).alias("sheet"), F.col("o_custkey").alias("row"), F.lit(1).alias("col"), "o_orderkey")
    c = table(spark, d, "customer").where("c_custkey % 7 = 0").select(F.lit(1).alias("sheet"), F.col("c_custkey").alias("top"), F.lit(1).alias("left"), (F.col("c_custkey") + 10 + F.col("c_custkey") % 50).alias("bottom"), F.lit(1).alias("right"), F.col("c_custkey").alias("region"), F.lit(False).alias("is_parent"))
    inner = joins.narrowest_owner(cells_, c, ["o_orderkey"])
    # The whole sheet is the owner of what no region holds.
    return cells_.select("o_orderkey").join(inner, "o_orderkey", "left").select("o_orderkey", F.coalesce("region", F.lit(-1)).cast("bigint").alias("region"))


@query("JN20_semi_join", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45)")
def jn20(spark, d):
    ids = table(spark, d, "lineitem").where("l_returnflag = 'A' and l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(ids, "p_partkey", "left_semi").select("p_partkey")


@query("JN21_or_of_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) OR EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey AND s_acctbal < 0)")
def jn21(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    poor = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("c_custkey"))
    return table(spark, d, "customer").join(big.unionByName(poor), "c_custkey", "left_semi").select("c_custkey")


@query("JN22_first_evidence", "SELECT o_orderkey, l_partkey AS first_part FROM orders LEFT JOIN (SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS l_partkey FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def jn22(spark, d):
    first = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(F.struct("l_linenumber", "l_partkey"))["l_partkey"].alias("first_part"))
    return table(spark, d, "orders").join(first, "o_orderkey", "left").select("o_orderkey", "first_part")


@query("JN23_coalesced_minima", "SELECT n_nationkey, coalesce((SELECT min(c_custkey) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900), (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey)) AS page FROM nation")
def jn23(spark, d):
    a = table(spark, d, "customer").where("c_acctbal > 9900").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.min("c_custkey").alias("a"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_suppkey").alias("b"))
    return table(spark, d, "nation").join(a, "n_nationkey", "left").join(b, "n_nationkey", "left").select("n_nationkey", F.coalesce("a", "b").alias("page"))


@query("JN24_slot_comparison", "SELECT a.l_orderkey, a.l_linenumber, a.t <> b.t AS unstable FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS t FROM lineitem) a JOIN (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) + CASE WHEN l_partkey % 10 = 0 THEN 1 ELSE 0 END AS t FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber IS NOT DISTINCT FROM b.l_linenumber")
def jn24(spark, d):
    l = table(spark, d, "lineitem")
    a = l.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("t"))
    b = l.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), (F.col("l_quantity").cast("int") + (F.col("l_partkey") % 10 == 0).cast("int")).alias("u"))
    return a.join(b, (F.col("l_orderkey") == F.col("o")) & F.col("l_linenumber").eqNullSafe(F.col("n"))).select("l_orderkey", "l_linenumber", (F.col("t") != F.col("u")).alias("unstable"))


@query("JN25_last_opened", "SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS opened FROM events")
def jn25(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w).alias("opened"))
