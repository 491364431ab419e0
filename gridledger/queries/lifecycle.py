"""Versions, snapshots and replacing writes, bound to the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridledger.operators import versions as v
from gridledger.operators import windows as w
from gridledger.registry import query, table


@query("VR1_version_precedence", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN min_a >= 0 THEN a ELSE -1 END DESC, o_orderdate DESC, o_orderkey DESC) AS place FROM (SELECT *, min(a) OVER (PARTITION BY o_custkey) AS min_a FROM (SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE o_orderkey % 4 END AS a FROM orders))")
def vr1(spark, d):
    o = table(spark, d, "orders").withColumn("a", F.when(F.col("o_orderkey") % 11 == 0, F.lit(-1)).otherwise(F.col("o_orderkey") % 4)).withColumn("r", F.lit(-1))
    return v.precedence(o, ["o_custkey"], "a", "r", F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_orderkey", F.col("place").cast("bigint").alias("place"))


@query("VR2_relations", "SELECT o_orderkey AS older, 'supersedes' AS kind, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS winner FROM orders QUALIFY older <> winner UNION ALL SELECT doc_id, 'duplicate_of', m FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS m FROM documents) WHERE doc_id <> m")
def vr2(spark, d):
    o = table(spark, d, "orders")
    win = w.latest_by(o, ["o_custkey"], "o_orderkey", F.struct("o_orderdate", "o_orderkey")).withColumnRenamed("o_orderkey", "winner")
    older = o.join(win, "o_custkey").where("o_orderkey <> winner").select(F.col("o_orderkey").alias("older"), F.lit("supersedes").alias("kind"), "winner")
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("winner"))
    copies = docs.join(first, "h").where("doc_id <> winner").select(F.col("doc_id").alias("older"), F.lit("duplicate_of").alias("kind"), "winner")
    return older.unionByName(copies)


@query("VR3_fact_identity_chain", "SELECT l_orderkey, l_linenumber, lead(l_orderkey) OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS superseded_by FROM lineitem")
def vr3(spark, d):
    order = [F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")]
    return w.supersede(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], order, "l_orderkey").select("l_orderkey", "l_linenumber", "superseded_by")


def _facts(spark, d):
    o = w.supersede(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "o_orderkey")
    return o.select(F.col("o_orderkey").alias("fact_id"), F.col("o_custkey").alias("snapshot_id"), "is_current", "superseded_by", "o_orderdate")


@query("VR5_stale_snapshots", "SELECT o_custkey AS snapshot_id, string_agg('fact ' || o_orderkey || ' superseded by ' || n, '; ' ORDER BY o_orderkey) AS reason FROM (SELECT *, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n IS NOT NULL AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1")
def vr5(spark, d):
    facts = _facts(spark, d)
    links = facts.where("o_orderdate < timestamp '1997-01-01'").select("snapshot_id", "fact_id")
    return v.stale(links.select("snapshot_id").distinct(), links, facts.select("fact_id", "is_current", "superseded_by"))


@query("VR6_stale_on_delete", "SELECT DISTINCT o_custkey AS snapshot_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)")
def vr6(spark, d):
    gone = table(spark, d, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(gone, "o_orderkey", "left_semi").select(F.col("o_custkey").alias("snapshot_id")).distinct()


@query("VR7_unstable_readings", "SELECT o_orderkey, a, b FROM (SELECT o_orderkey, lower(trim(o_orderstatus)) AS a, CASE WHEN o_custkey % 20 = 0 THEN 'x' ELSE lower(o_orderstatus) END AS b FROM orders) WHERE a <> b")
def vr7(spark, d):
    o = table(spark, d, "orders")
    one = o.select("o_orderkey", F.lower(F.trim("o_orderstatus")).alias("a"))
    two = o.select("o_orderkey", F.when(F.col("o_custkey") % 20 == 0, "x").otherwise(F.lower("o_orderstatus")).alias("b"))
    return one.join(two, "o_orderkey").where("a <> b")


@query("VR8_run_identity", "SELECT sha256(source || '|' || lang) AS run, count(*) AS n FROM documents GROUP BY source, lang")
def vr8(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n")).select(F.sha2(F.concat_ws("|", "source", "lang").cast("binary"), 256).alias("run"), "n")


@query("VR9_stage_status", "SELECT user_id, CASE WHEN e = 0 THEN 'completed' WHEN n > e THEN 'partial' ELSE 'failed' END AS status FROM (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS e FROM events GROUP BY 1)")
def vr9(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("event_type") == "error", 1)).alias("e"))
    return g.select("user_id", F.when(F.col("e") == 0, "completed").when(F.col("n") > F.col("e"), "partial").otherwise("failed").alias("status"))


@query("VR10_learned_terms", "SELECT w, CASE WHEN top >= 0.95 * n THEN 'promoted' ELSE 'quarantined' END AS state FROM (SELECT w, sum(c) AS n, max(c) AS top, CAST(sum(b) AS BIGINT) AS books FROM (SELECT w, p_type, count(*) AS c, count(DISTINCT p_brand) AS b FROM (SELECT p_type, p_brand, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1, 2) GROUP BY 1) WHERE books >= 2")
def vr10(spark, d):
    terms = table(spark, d, "part").select("p_type", "p_brand", F.explode(F.split("p_name", " ")).alias("w"))
    by = terms.groupBy("w", "p_type").agg(F.count("*").alias("c"), F.countDistinct("p_brand").alias("b")).groupBy("w").agg(F.sum("c").alias("n"), F.max("c").alias("top"), F.sum("b").alias("books"))
    return by.where("books >= 2").select("w", F.when(F.col("top") >= 0.95 * F.col("n"), "promoted").otherwise("quarantined").alias("state"))


@query("VR11_highest_version", "SELECT p_brand, max(p_size * 1000 + p_partkey % 7) AS top FROM part GROUP BY 1")
def vr11(spark, d):
    best = table(spark, d, "part").groupBy("p_brand").agg(F.max(F.struct("p_size", (F.col("p_partkey") % 7).alias("minor"))).alias("v"))
    return best.select("p_brand", (F.col("v.p_size") * 1000 + F.col("v.minor")).alias("top"))


@query("SNK2_replace_by_key", "SELECT o_custkey, o_orderkey, 'old' AS run FROM orders WHERE o_orderstatus <> 'P' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_custkey, o_orderkey, 'new' FROM orders WHERE o_orderstatus = 'P'")
def snk2(spark, d):
    o = table(spark, d, "orders")
    pick = lambda cond, run: o.where(cond).select("o_custkey", "o_orderkey", F.lit(run).alias("run"))
    return v.replace_by_key(pick("o_orderstatus <> 'P'", "old"), pick("o_orderstatus = 'P'", "new"), ["o_custkey"])


@query("SNK3_upsert", "SELECT coalesce(c_custkey, s_suppkey) AS id, CASE WHEN s_suppkey IS NOT NULL THEN s_acctbal ELSE c_acctbal END AS balance, CASE WHEN c_custkey IS NULL THEN s_name ELSE c_name END AS name FROM customer FULL JOIN (SELECT s_suppkey * 20 AS s_suppkey, s_name, s_acctbal FROM supplier) ON c_custkey = s_suppkey")
def snk3(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_name").alias("name"))
    s = table(spark, d, "supplier").select((F.col("s_suppkey") * 20).alias("id"), F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))
    return v.upsert(c, s, ["id"], ["balance"])


@query("SNK4_insert_absent", "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey * 20, s_name FROM supplier WHERE s_suppkey * 20 NOT IN (SELECT c_custkey FROM customer)")
def snk4(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    s = table(spark, d, "supplier").select((F.col("s_suppkey") * 20).alias("id"), F.col("s_name").alias("name"))
    return v.insert_absent(c, s, ["id"])


@query("SNK5_clone_graph", "SELECT o_orderkey + 1000000 AS o_orderkey, l_linenumber, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'")
def snk5(spark, d):
    ids = table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", (F.col("o_orderkey") + 1000000).alias("copy"))
    l = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return l.join(ids, "o_orderkey").select(F.col("copy").alias("o_orderkey"), "l_linenumber", "l_partkey")


@query("SNK6_blob_paths", "SELECT doc_id, sha256(text) || '/original.txt' AS path FROM documents")
def snk6(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat(F.sha2(F.col("text").cast("binary"), 256), F.lit("/original.txt")).alias("path"))


@query("SNK7_json_export", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS facts FROM orders GROUP BY 1")
def snk7(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.to_json(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus")))).alias("json"))
    return o.select("o_custkey", F.json_array_length("json").cast("bigint").alias("facts"))


@query("SNK10_delete_cascade", "SELECT 'lineitem' AS name, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderstatus <> 'F'")
def snk10(spark, d):
    o = table(spark, d, "orders")
    left = v.delete_cascade(o.where("o_orderstatus = 'F'"), "o_orderkey", {"lineitem": table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "orders": o})
    one = lambda n: left[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
    return one("lineitem").unionByName(one("orders"))
