"""Ranking, chains, islands and frames, bound to the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridledger.operators import windows as w
from gridledger.registry import query, table


@query("WN1_best_evidence", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, CASE WHEN o_orderkey % 9 = 0 THEN -1 ELSE o_totalprice END DESC, o_orderkey) = 1")
def wn1(spark, d):
    score = F.coalesce(F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")), F.lit(-1.0))
    return w.best_by(table(spark, d, "orders"), ["o_custkey"], [F.when(F.col("o_orderstatus") == "F", 0).otherwise(1), score.desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("WN2_supersession_chain", "SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS superseded_by, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) IS NULL AS is_current FROM orders")
def wn2(spark, d):
    return w.supersede(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "o_orderkey").select("o_orderkey", "superseded_by", "is_current")


@query("WN3_version_winner", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS winner FROM orders GROUP BY 1")
def wn3(spark, d):
    return w.latest_by(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", F.struct("o_orderdate", "o_orderkey")).withColumnRenamed("o_orderkey", "winner")


@query("WN4_latest_action", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def wn4(spark, d):
    return w.latest_by(table(spark, d, "events"), ["user_id"], "event_type", F.col("event_id"))


@query("WN5_frame_around", "SELECT event_id, count(*) OVER f AS near, round(sum(value) OVER f, 4) AS total FROM events WINDOW f AS (PARTITION BY event_type ORDER BY event_id RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING)")
def wn5(spark, d):
    return table(spark, d, "events").select("event_id", w.around(F.count("*"), ["event_type"], "event_id").alias("near"), F.round(w.around(F.sum("value"), ["event_type"], "event_id"), 4).alias("total"))


@query("WN6_first_period", "SELECT l_orderkey, arg_min(l_returnflag, (l_linenumber, l_returnflag)) AS period FROM lineitem WHERE l_quantity > 10 GROUP BY 1")
def wn6(spark, d):
    return table(spark, d, "lineitem").where("l_quantity > 10").groupBy("l_orderkey").agg(F.min_by("l_returnflag", F.struct("l_linenumber", "l_returnflag")).alias("period"))


_LINES = "(SELECT doc_id, i, l FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i), LATERAL (SELECT ls[i] AS l))"


@query("WN7_passages", f"SELECT doc_id, island, CAST(min(i) AS BIGINT) AS first_line, count(*) AS lines FROM (SELECT doc_id, i, CAST(sum(CASE WHEN length(l) <= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS island FROM {_LINES}) WHERE island > 0 GROUP BY 1, 2")
def wn7(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "l"))
    cut = w.islands(lines, ["doc_id"], [F.col("i")], F.length("l") <= 20).where("island > 0")
    return cut.groupBy("doc_id", "island").agg((F.min("i") + 1).cast("bigint").alias("first_line"), F.count("*").alias("lines"))


@query("WN8_runs", "SELECT user_id, min(event_id) AS first, count(*) AS n FROM (SELECT user_id, event_id, sum(s) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (SELECT user_id, event_id, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) > 40 OR lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) IS NULL THEN 1 ELSE 0 END AS s FROM events)) GROUP BY user_id, run")
def wn8(spark, d):
    return w.runs(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id", 40).groupBy("user_id", "run").agg(F.min("event_id").alias("first"), F.count("*").alias("n")).drop("run")


@query("WN9_works_in_file", "SELECT conv_id, CAST(work AS BIGINT) AS work, min(turn) AS first_page, max(turn) AS last_page FROM (SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS work FROM conversations) GROUP BY 1, 2")
def wn9(spark, d):
    """A page of the opening role starts a work; pages before the first are work 0."""
    pages = w.islands(table(spark, d, "conversations"), ["conv_id"], [F.col("turn")], F.col("role") == "user", "work")
    return pages.groupBy("conv_id", "work").agg(F.min("turn").alias("first_page"), F.max("turn").alias("last_page"))


@query("WN10_ordinals", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ordinal FROM orders")
def wn10(spark, d):
    return table(spark, d, "orders").select("o_orderkey", (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("bigint").alias("ordinal"))


@query("XO12_row_annotations", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS notes FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def xo12(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("notes"))


@query("XO13_parent_path", "SELECT event_id, concat_ws(' > ', last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER f, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER f) AS path FROM events WINDOW f AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 200 PRECEDING AND CURRENT ROW)")
def xo13(spark, d):
    pick = lambda kind: w.fill_down(F.when(F.col("event_type") == kind, F.col("event_id").cast("string")), ["user_id"], [F.col("event_id")], 200)
    return table(spark, d, "events").select("event_id", F.concat_ws(" > ", pick("signup"), pick("view")).alias("path"))


@query("XO16_greedy_batches")
def xo16(spark, d):
    """Batches in order of at most 5 items and weight 100: the state of a fold over each group's bounded list."""
    zero = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("n"), F.lit(0.0).alias("w"), F.array().cast("array<struct<l_linenumber:int,batch:int>>").alias("out"))

    def step(s, x):
        full = (s["n"] >= 5) | ((s["n"] > 0) & (s["w"] + x["q"] > 100))
        batch = s["batch"] + full.cast("int")
        return F.struct(batch.alias("batch"), F.when(full, 1).otherwise(s["n"] + 1).alias("n"), F.when(full, x["q"]).otherwise(s["w"] + x["q"]).alias("w"), F.concat(s["out"], F.array(F.struct(x["l_linenumber"].alias("l_linenumber"), batch.alias("batch")))).alias("out"))

    lists = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").alias("q")))).alias("x"))
    return lists.select("l_orderkey", F.explode(F.aggregate("x", zero, step, lambda s: s["out"])).alias("o")).select("l_orderkey", "o.l_linenumber", "o.batch")


@query("XO17_triage_normal", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'noise' WHEN 1 THEN 'noise' WHEN 2 THEN 'main/supporting' WHEN 3 THEN 'primary' ELSE 'supporting' END AS role FROM part")
def xo17(spark, d):
    k = F.element_at(F.array(*map(F.lit, ("scratch", "orphan", "helper", "main", "main-minor"))), (F.col("p_partkey") % 5).cast("int") + 1)
    return table(spark, d, "part").select("p_partkey", F.when(k.isin("scratch", "orphan"), "noise").when(k == "helper", "main/supporting").when(k == "main", "primary").otherwise("supporting").alias("role"))


@query("XO18_scratch_escalation", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 AND l_tax * 10 >= 0.7 THEN 'scratch' WHEN l_linenumber = 1 THEN 'main' ELSE 'kept' END AS role FROM lineitem")
def xo18(spark, d):
    role = F.when(F.col("l_linenumber") == 1, F.when(F.col("l_tax") * 10 >= 0.7, "scratch").otherwise("main")).otherwise("kept")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", role.alias("role"))


@query("XO19_circuit_breaker", "SELECT event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) >= 3 AS open FROM events")
def xo19(spark, d):
    last = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-9, 0)
    return table(spark, d, "events").select("event_id", (F.sum((F.col("event_type") == "error").cast("int")).over(last) >= 3).alias("open"))
