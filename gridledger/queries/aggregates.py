"""Aggregations, orders and set operations, bound to the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridledger.functions import text, vectors
from gridledger.operators import aggregates as agg
from gridledger.operators.windows import placed
from gridledger.registry import query, table


@query("AG1_cost_rollup", "SELECT l_returnflag AS stage, l_linestatus AS unit, round(sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice * 0.01 ELSE l_extendedprice END), 2) AS usd, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), ())")
def ag1(spark, d):
    usd = F.when(F.col("unit") == "O", F.col("l_extendedprice") * 0.01).otherwise(F.col("l_extendedprice"))
    l = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("stage"), F.col("l_linestatus").alias("unit"), "l_extendedprice")
    return l.groupingSets([("stage", "unit"), ()], "stage", "unit").agg(F.round(F.sum(usd), 2).alias("usd"), F.count("*").alias("n"))


@query("AG2_first_page", "SELECT user_id, min(event_id) AS first_page FROM events GROUP BY 1")
def ag2(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("first_page"))


@query("AG3_count_distinct", "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def ag3(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"))


@query("AG4_text_density", "SELECT source, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars, sum(length(coalesce(text, ''))) / count(*) > 2500 AS dense FROM documents GROUP BY 1")
def ag4(spark, d):
    n = F.sum(F.length(F.coalesce("text", F.lit(""))))
    return table(spark, d, "documents").groupBy("source").agg(n.alias("chars"), (n / F.count("*") > 2500).alias("dense"))


@query("AG5_table_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("customer", "documents", "events", "lineitem", "orders", "part", "supplier")))
def ag5(spark, d):
    out = None
    for t in ("customer", "documents", "events", "lineitem", "orders", "part", "supplier"):
        one = table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("AG6_next_ordinal", "SELECT c_custkey, coalesce(max(o_orderkey), -1) + 1 AS next FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def ag6(spark, d):
    top = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("m"))
    return table(spark, d, "customer").join(top, "c_custkey", "left").select("c_custkey", (F.coalesce("m", F.lit(-1)) + 1).alias("next"))


@query("AG7_content_bbox", "SELECT l_suppkey AS sheet, min(l_linenumber) AS min_col, max(l_linenumber) AS max_col, CAST(min(l_quantity) AS INT) AS min_row, CAST(max(l_quantity) AS INT) AS max_row FROM lineitem WHERE l_discount > 0 GROUP BY 1")
def ag7(spark, d):
    q = F.col("l_quantity").cast("int")
    return table(spark, d, "lineitem").where("l_discount > 0").groupBy(F.col("l_suppkey").alias("sheet")).agg(F.min("l_linenumber").alias("min_col"), F.max("l_linenumber").alias("max_col"), F.min(q).alias("min_row"), F.max(q).alias("max_row"))


@query("AG8_content_rows", "SELECT l_suppkey AS sheet, count(DISTINCT CAST(l_quantity AS INT)) AS content_rows FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1")
def ag8(spark, d):
    return table(spark, d, "lineitem").where("l_returnflag = 'N'").groupBy(F.col("l_suppkey").alias("sheet")).agg(F.countDistinct(F.col("l_quantity").cast("int")).alias("content_rows"))


@query("AG9_median_magnitude", "SELECT l_suppkey, round(median(log10(l_extendedprice)), 6) AS anchor FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1")
def ag9(spark, d):
    return table(spark, d, "lineitem").where("l_extendedprice > 0").groupBy("l_suppkey").agg(F.round(F.median(F.log10("l_extendedprice")), 6).alias("anchor"))


_MODE = "(SELECT l_partkey % 50 AS g, CASE WHEN l_orderkey % 4 > 0 THEN l_returnflag END AS v FROM lineitem WHERE (l_returnflag = 'N' OR l_partkey % 50 > 20))"


@query("AG10_dominant_value", f"SELECT g, v, n FROM (SELECT g, v, count(*) AS n, sum(count(*)) OVER (PARTITION BY g) AS whole, sum(CASE WHEN v IS NOT NULL THEN count(*) ELSE 0 END) OVER (PARTITION BY g) AS typed, row_number() OVER (PARTITION BY g ORDER BY CASE WHEN v IS NULL THEN -1 ELSE count(*) END DESC, v DESC) AS k FROM {_MODE} GROUP BY g, v) WHERE k = 1 AND typed >= 0.5 * whole AND n >= 0.7 * typed")
def ag10(spark, d):
    l = table(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("g"), F.when(F.col("l_orderkey") % 4 > 0, F.col("l_returnflag")).alias("v"), "l_returnflag")
    return agg.dominant(l.where("l_returnflag = 'N' or g > 20"), ["g"], "v")


@query("AG11_all_agree", "SELECT o_custkey, count(DISTINCT coalesce(o_orderstatus, '') || '|' || coalesce(CASE WHEN o_orderkey % 5 > 0 THEN substr(o_orderpriority, 1, 1) END, 'null')) = 1 AS agree FROM orders GROUP BY 1")
def ag11(spark, d):
    o = table(spark, d, "orders").withColumn("p", F.when(F.col("o_orderkey") % 5 > 0, F.substring("o_orderpriority", 1, 1)))
    return o.groupBy("o_custkey").agg(agg.all_agree("o_orderstatus", "p").alias("agree"))


@query("AG12_majority_vote", "SELECT o_custkey, o_orderstatus FROM (SELECT o_custkey, o_orderstatus, count(*) AS n, sum(count(*)) OVER (PARTITION BY o_custkey) AS whole FROM orders GROUP BY 1, 2) WHERE whole >= 3 AND n >= 3 AND n * 2 > whole")
def ag12(spark, d):
    return agg.majority(table(spark, d, "orders"), ["o_custkey"], "o_orderstatus")


@query("AG13_exactly_one", "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS status FROM orders GROUP BY 1")
def ag13(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(agg.only(F.col("o_orderstatus")).alias("status"))


@query("AG14_pattern_score", "SELECT source, sum(s) AS score, CASE WHEN sum(s) >= 20 THEN 'legal' WHEN sum(s) >= 5 THEN 'mixed' ELSE 'none' END AS industry FROM (SELECT source, 3 * CAST(regexp_matches(text, 'General Public License') AS BIGINT) + 2 * CAST(regexp_matches(text, 'MIT License') AS BIGINT) + CAST(regexp_matches(text, '[0-9]{4}') AS BIGINT) AS s FROM documents) GROUP BY 1")
def ag14(spark, d):
    hit = lambda p, w: w * F.col("text").rlike(p).cast("bigint")
    s = F.sum(hit("General Public License", 3) + hit("MIT License", 2) + hit("[0-9]{4}", 1))
    return table(spark, d, "documents").groupBy("source").agg(s.alias("score"), F.when(s >= 20, "legal").when(s >= 5, "mixed").otherwise("none").alias("industry"))


@query("AG15_document_consensus", "SELECT l_partkey, count(DISTINCT l_orderkey) AS documents FROM lineitem WHERE l_discount = 0.05 GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 2")
def ag15(spark, d):
    return table(spark, d, "lineitem").where("l_discount = 0.05").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("documents")).where("documents >= 2")


@query("AG16_majority_rule", "SELECT c_nationkey, sum(CASE WHEN c_acctbal > 4000 THEN 1 ELSE 0 END) AS seen, count(*) AS total, sum(CASE WHEN c_acctbal > 4000 THEN 1 ELSE 0 END) >= 3 AND 2 * sum(CASE WHEN c_acctbal > 4000 THEN 1 ELSE 0 END) > count(*) AS required FROM customer GROUP BY 1")
def ag16(spark, d):
    seen = F.sum((F.col("c_acctbal") > 4000).cast("bigint"))
    return table(spark, d, "customer").groupBy("c_nationkey").agg(seen.alias("seen"), F.count("*").alias("total"), ((seen >= 3) & (2 * seen > F.count("*"))).alias("required"))


@query("AG17_industries_per_type", "SELECT p_brand, count(DISTINCT t) AS tags FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS t FROM part) GROUP BY 1 HAVING count(DISTINCT t) >= 3")
def ag17(spark, d):
    t = table(spark, d, "part").select("p_brand", F.explode(F.split("p_name", " ")).alias("t"))
    return t.groupBy("p_brand").agg(F.countDistinct("t").alias("tags")).where("tags >= 3")


@query("AG18_field_coverage", "SELECT p_brand, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END), 6) AS coverage, avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END) >= 0.9 AS passes FROM (SELECT p_brand, p_partkey, count(l_partkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 48 GROUP BY 1, 2) GROUP BY 1")
def ag18(spark, d):
    hits = table(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("hit", F.lit(1.0))
    c = F.avg(F.coalesce("hit", F.lit(0.0)))
    return table(spark, d, "part").join(hits, "p_partkey", "left").groupBy("p_brand").agg(F.round(c, 6).alias("coverage"), (c >= 0.9).alias("passes"))


@query("AG19_status_groupings", "SELECT o_orderstatus, c_nationkey, c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY GROUPING SETS ((o_orderstatus), (c_nationkey, o_orderstatus), (c_mktsegment, o_orderstatus))")
def ag19(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    return o.groupingSets([("o_orderstatus",), ("c_nationkey", "o_orderstatus"), ("c_mktsegment", "o_orderstatus")], "o_orderstatus", "c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))


@query("AG20_agreement_bands", "SELECT CAST(least(floor(l_discount * 100 / 3), 2) AS INT) AS band, count(*) AS n, round(avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM lineitem GROUP BY 1")
def ag20(spark, d):
    band = F.least(F.floor(F.col("l_discount") * 100 / 3), F.lit(2)).cast("int")
    return table(spark, d, "lineitem").groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("l_returnflag") == "N").cast("double")), 6).alias("agreement"))


@query("AG21_top_disagreements", "SELECT a, b, n FROM (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2) ORDER BY n DESC, a, b LIMIT 8")
def ag21(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a", "b").limit(8)


@query("AG22_reconciliation_gate", "SELECT count(*) AS read, count(*) FILTER (WHERE value IS NOT NULL) AS written, CASE WHEN count(*) = count(value) AND count(*) FILTER (WHERE event_type = 'error') = 0 THEN 'success' WHEN count(value) = 0 THEN 'failed' ELSE 'partial' END AS status FROM events")
def ag22(spark, d):
    read, written, bad = F.count("*"), F.count("value"), F.count(F.when(F.col("event_type") == "error", 1))
    return table(spark, d, "events").agg(read.alias("read"), written.alias("written"), agg.gate(read, written, bad, F.lit(0)).alias("status"))


@query("AG23_joined_reasons", "SELECT o_custkey, string_agg(o_orderstatus || o_orderkey, '; ' ORDER BY o_orderkey) AS reasons FROM orders WHERE o_totalprice > 150000 GROUP BY 1")
def ag23(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 150000")
    return o.groupBy("o_custkey").agg(agg.joined(F.concat("o_orderstatus", F.col("o_orderkey").cast("string")), F.col("o_orderkey")).alias("reasons"))


@query("AG24_column_consistency", "SELECT o_custkey, count(DISTINCT n) > 1 AS inconsistent FROM (SELECT o_custkey, o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) GROUP BY 1")
def ag24(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "orders").join(n, "o_orderkey").groupBy("o_custkey").agg((F.countDistinct("n") > 1).alias("inconsistent"))


@query("AG25_printed_total", "SELECT l_orderkey, round(sum(CASE WHEN l_linenumber > 1 THEN l_quantity ELSE 0 END), 2) AS parts, abs(sum(CASE WHEN l_linenumber > 1 THEN l_quantity ELSE 0 END) - max(CASE WHEN l_linenumber = 1 THEN l_quantity END)) > 0.05 AS mismatch FROM lineitem GROUP BY 1")
def ag25(spark, d):
    parts, total = F.sum(F.when(F.col("l_linenumber") > 1, F.col("l_quantity")).otherwise(0.0)), F.max(F.when(F.col("l_linenumber") == 1, F.col("l_quantity")))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(parts, 2).alias("parts"), (F.abs(parts - total) > 0.05).alias("mismatch"))


@query("AG26_centroids", "WITH m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2) SELECT label, i - 1 AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 5) AS x FROM m")
def ag26(spark, d):
    c = vectors.centroids(table(spark, d, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("i", "x")).select("label", F.col("i").cast("bigint").alias("i"), F.round("x", 5).alias("x"))


@query("AG27_duplicate_groups", "SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS original FROM documents QUALIFY count(*) OVER (PARTITION BY sha256(text)) > 1")
def ag27(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    # Minima combine before the shuffle, so that a large group of copies is no large task.
    groups = docs.groupBy("h").agg(F.min("doc_id").alias("original"), F.count("*").alias("n")).where("n > 1")
    return docs.join(groups, "h").select("doc_id", "original")


@query("AG28_row_texts", "SELECT l_orderkey, count(*) FILTER (WHERE regexp_matches(t, '[0-9]')) AS value_rows FROM (SELECT l_orderkey, l_linenumber % 2 AS r, string_agg(l_returnflag || CAST(l_linenumber AS VARCHAR), ' ' ORDER BY l_linenumber) AS t FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def ag28(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", (F.col("l_linenumber") % 2).alias("r")).agg(agg.joined(F.concat("l_returnflag", F.col("l_linenumber").cast("string")), F.col("l_linenumber"), " ").alias("t"))
    return rows.groupBy("l_orderkey").agg(F.count(F.when(F.col("t").rlike("[0-9]"), 1)).alias("value_rows"))


@query("AG29_style_flyweight", "SELECT dense_rank() OVER (ORDER BY p_brand, p_type, coalesce(CASE WHEN p_size > 25 THEN p_size END, -1)) AS style, p_partkey FROM part")
def ag29(spark, d):
    # Styles are numbered once, over the distinct ones, by a global order of that small set; cells look theirs up by a null-safe key.
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", F.coalesce(F.when(F.col("p_size") > 25, F.col("p_size")), F.lit(-1)).alias("size_key"))
    keys = ["p_brand", "p_type", "size_key"]
    from pyspark.sql import Window

    styles = p.select(*keys).distinct().withColumn("style", F.row_number().over(Window.orderBy(*keys)).cast("bigint"))
    return p.join(styles, keys).select("style", "p_partkey")


@query("OR1_fact_order", "SELECT o_orderkey, row_number() OVER (ORDER BY CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 2 ELSE 6 END, o_orderpriority, o_totalprice DESC, o_orderkey) AS place FROM orders")
def or1(spark, d):
    p = F.substring("o_orderpriority", 1, 1)
    rank = F.when(p == "1", 0).when(p == "2", 1).when(p == "3", 2).otherwise(6)
    return placed(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), rank, "o_orderpriority", F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "place")


@query("OR2_order_by_scalar", "SELECT o_orderkey, row_number() OVER (ORDER BY s DESC, o_orderkey) AS place FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def or2(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("s"))
    return placed(table(spark, d, "orders").select("o_orderkey").join(s, "o_orderkey"), F.desc("s"), "o_orderkey").select("o_orderkey", "place")


@query("OR3_reading_order", "SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, coalesce(CASE WHEN turn % 2 = 0 THEN turn END, turn + 100), turn) AS place FROM conversations")
def or3(spark, d):
    order = F.coalesce(F.when(F.col("turn") % 2 == 0, F.col("turn")), F.col("turn") + 100)
    return placed(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", order, "turn").select("conv_id", "turn", "place")


@query("OR4_similar_top_k", "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)), 6) AS score FROM embeddings WHERE vec_id <> 7 ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)) DESC, vec_id LIMIT 5")
def or4(spark, d):
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id = 7").select(F.col("embedding").alias("q")).first()  # one row: the question
    s = vectors.cosine(F.col("embedding"), F.array(*(F.lit(float(x)) for x in asked.q)))
    return e.where("vec_id <> 7").select("vec_id", s.alias("s")).orderBy(F.desc("s"), "vec_id").limit(5).select("vec_id", F.round("s", 6).alias("score"))


@query("OR5_distinct_by_first", "SELECT p_brand FROM part GROUP BY p_brand ORDER BY min(p_size * 100000 + p_partkey) LIMIT 10")
def or5(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.min(F.struct("p_size", "p_partkey")).alias("at")).orderBy("at").limit(10).select("p_brand")


@query("OR6_first_match", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def or6(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1).select("o_orderkey", "o_totalprice")


@query("ST1_union_of_stores", "SELECT 'document' AS store, count(*) AS n FROM documents WHERE contains(text, 'and') UNION ALL SELECT 'turn', count(*) FROM conversations WHERE contains(text, 'and') UNION ALL SELECT 'item', count(*) FROM benchmark WHERE contains(text, 'and')")
def st1(spark, d):
    one = lambda t, store: table(spark, d, t).select(F.lit(store).alias("store"), "text")
    rows = one("documents", "document").unionByName(one("conversations", "turn")).unionByName(one("benchmark", "item"))
    return rows.where(F.col("text").contains("and")).groupBy("store").agg(F.count("*").alias("n"))


@query("ST2_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def st2(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("ST3_set_equality", "SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey AND list_sort(string_split(a.p_name, ' ')) = list_sort(string_split(b.p_name, ' ')) WHERE a.p_size = b.p_size")
def st3(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", F.array_sort(F.split("p_name", " ")).alias("s"))
    a, b = p.select(F.col("p_partkey").alias("a"), "p_brand", "p_size", "s"), p.select(F.col("p_partkey").alias("b"), "p_brand", "p_size", "s")
    return a.join(b, ["p_brand", "p_size", "s"]).where("a < b").select("a", "b")


@query("ST4_merge_distinct", "SELECT p_partkey, CASE WHEN p_type IN ('red', 'blue', 'hot') THEN 'red,blue' ELSE 'red,blue,' || p_type END AS merged FROM part")
def st4(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_union(F.array(F.lit("red"), F.lit("blue")), F.array("p_type")), ",").alias("merged"))


@query("ST5_catalog_overlay", "SELECT code, arg_max(label, layer) AS label FROM (SELECT n_nationkey AS code, n_name AS label, 1 AS layer FROM nation UNION ALL SELECT s_nationkey, max(s_name), 2 FROM supplier WHERE s_nationkey % 3 = 0 GROUP BY 1 UNION ALL SELECT c_nationkey, max(c_name), 3 FROM customer WHERE c_nationkey % 5 = 0 GROUP BY 1) GROUP BY 1")
def st5(spark, d):
    from gridledger.operators.windows import latest_by

    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"), F.lit(1).alias("layer"))
    s = table(spark, d, "supplier").where("s_nationkey % 3 = 0").groupBy(F.col("s_nationkey").alias("code")).agg(F.max("s_name").alias("label"), F.lit(2).alias("layer"))
    c = table(spark, d, "customer").where("c_nationkey % 5 = 0").groupBy(F.col("c_nationkey").alias("code")).agg(F.max("c_name").alias("label"), F.lit(3).alias("layer"))
    return latest_by(n.unionByName(s).unionByName(c), ["code"], "label", F.col("layer"))


@query("XO8_entity_merge", "SELECT regexp_replace(regexp_replace(lower(s_name), ' ltd$', ''), '[^a-z0-9]+', '', 'g') AS key, min(s_suppkey) AS first, count(*) AS n FROM (SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey + 1000, upper(s_name) || ' Ltd' FROM supplier) GROUP BY 1")
def xo8(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    both = s.unionByName(s.select((F.col("s_suppkey") + 1000).alias("s_suppkey"), F.concat(F.upper("s_name"), F.lit(" Ltd")).alias("s_name")))
    return both.groupBy(text.loose_key(F.col("s_name")).alias("key")).agg(F.min("s_suppkey").alias("first"), F.count("*").alias("n")).where("key <> ''")


@query("XO32_usage_report", "SELECT l_returnflag, l_linestatus, count(*) AS calls, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tokens FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def xo32(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("calls"), F.sum(F.col("l_quantity").cast("bigint")).alias("tokens"))
