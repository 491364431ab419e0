"""Formula graphs, cycles, lineage and components, bound to the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridledger.operators import graph
from gridledger.registry import query, table

# Cell i reads cells 2i + 1 and 3i + 2, where there are such; every 50th reads its half, which closes loops.
_EDGES = "(SELECT DISTINCT a, b FROM (SELECT event_id AS a, unnest([event_id * 2 + 1, event_id * 3 + 2, CASE WHEN event_id % 50 = 0 THEN event_id // 2 ELSE event_id * 2 + 1 END]) AS b FROM events) WHERE b IN (SELECT event_id FROM events))"


def _edges(spark, d):
    i, cells = F.col("event_id"), table(spark, d, "events")
    b = F.array(i * 2 + 1, i * 3 + 2, F.when(i % 50 == 0, F.floor(i / 2)).otherwise(i * 2 + 1))
    return cells.select(i.alias("a"), F.explode(b).alias("b")).distinct().join(cells.select(i.alias("b")), "b", "left_semi").select("a", "b")


@query("GR1_formula_links", f"SELECT a, b FROM {_EDGES}")
def gr1(spark, d):
    return _edges(spark, d)


@query("GR2_gap_reasons", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 'parse_error' WHEN s_suppkey IS NULL THEN 'sheet_not_found' WHEN l_partkey % 10 = 0 THEN 'external' WHEN l_partkey % 10 = 1 THEN 'defined_name' END AS gap FROM lineitem LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) ON s_suppkey = l_suppkey")
def gr2(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey")
    gap = F.when(F.col("l_linenumber") == 7, "parse_error").when(F.col("s_suppkey").isNull(), "sheet_not_found").when(F.col("l_partkey") % 10 == 0, "external").when(F.col("l_partkey") % 10 == 1, "defined_name")
    return table(spark, d, "lineitem").join(s, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("l_orderkey", "l_linenumber", gap.alias("gap"))


@query("GR4_reach_a_cycle", f"WITH RECURSIVE e AS {_EDGES}, r(s, n) AS (SELECT a, b FROM e UNION SELECT r.s, e.b FROM r JOIN e ON r.n = e.a WHERE r.s % 50 = 0), c AS (SELECT DISTINCT s AS node FROM r WHERE s = n), up(node) AS (SELECT node FROM c UNION SELECT e.a FROM up JOIN e ON e.b = up.node) SELECT DISTINCT node FROM up")
def gr4(spark, d):
    return graph.reach_a_cycle(_edges(spark, d))


@query("GR5_lineage", f"WITH RECURSIVE e AS {_EDGES}, r(node, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT e.b, r.depth + 1 FROM r JOIN e ON r.node = e.a WHERE r.depth < 30) SELECT node, min(depth) AS depth FROM r GROUP BY 1")
def gr5(spark, d):
    start = spark.createDataFrame([(1,)], "start bigint")
    return graph.lineage(_edges(spark, d), start, 30).select("node", "depth")


@query("GR6_supersession_history", "WITH RECURSIVE n AS (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders), h(start, node, depth) AS (SELECT o_orderkey, o_orderkey, 0 FROM orders WHERE o_orderkey % 50 = 0 UNION ALL SELECT h.start, n.nxt, h.depth + 1 FROM h JOIN n ON n.o_orderkey = h.node WHERE n.nxt IS NOT NULL) SELECT * FROM h")
def gr6(spark, d):
    """The histories asked for: those of ids divisible by 50, over all orders."""
    from gridledger.operators.windows import supersede

    o = supersede(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "o_orderkey")
    e = o.where("superseded_by is not null").select(F.col("o_orderkey").alias("a"), F.col("superseded_by").alias("b"))
    return graph.history(e, o.where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("start")))


@query("GR7_sheet_closure", f"WITH RECURSIVE e AS (SELECT DISTINCT a // 100 AS a, b // 100 AS b FROM {_EDGES}), r(node) AS (SELECT CAST(1 AS BIGINT) UNION SELECT e.b FROM r JOIN e ON r.node = e.a) SELECT node FROM r")
def gr7(spark, d):
    """Sheets of a hundred cells each: those that the second one reads, directly or not."""
    e = _edges(spark, d).select(F.floor(F.col("a") / 100).alias("a"), F.floor(F.col("b") / 100).alias("b"))
    return graph.lineage(e, spark.createDataFrame([(1,)], "start bigint")).select("node")


@query("GR8_ready_levels", f"WITH RECURSIVE e AS (SELECT a, b FROM {_EDGES} WHERE b > a), n AS (SELECT a AS node FROM e UNION SELECT b FROM e), l(node, level) AS (SELECT node, 0 FROM n WHERE node NOT IN (SELECT a FROM e) UNION SELECT e.a, l.level + 1 FROM l JOIN e ON e.b = l.node) SELECT node, max(level) AS level FROM l GROUP BY 1")
def gr8(spark, d):
    return graph.levels(_edges(spark, d).where("b > a"))


# Cells that are added to each other stand in runs of up to ten; purchases say their scale, by their value.
_SAME = "(SELECT event_id AS a, event_id + 1 AS b FROM events WHERE event_id % 10 < 9 AND event_id % 3 > 0 AND event_id + 1 IN (SELECT event_id FROM events))"
_ASKED = "(SELECT event_id AS node, CASE WHEN value > 50 THEN 'lakh' ELSE 'crore' END AS scale FROM events WHERE event_type = 'purchase')"


@query(
    "GR10_unstated_scales",
    f"""WITH RECURSIVE e AS (SELECT a, b FROM {_SAME} UNION SELECT b, a FROM {_SAME}), r(s, n) AS (SELECT node, node FROM (SELECT a AS node FROM e UNION SELECT node FROM {_ASKED}) UNION SELECT r.s, e.b FROM r JOIN e ON e.a = r.n),
    c AS (SELECT s AS node, min(n) AS component FROM r GROUP BY 1), q AS (SELECT component, min(scale) AS lo, max(scale) AS hi FROM c JOIN {_ASKED} USING (node) GROUP BY 1)
    SELECT node, component, CASE WHEN lo = hi THEN lo END AS scale FROM c LEFT JOIN q USING (component)""",
)
def gr10(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    same = e.where("event_id % 10 < 9 and event_id % 3 > 0").select(i.alias("a"), (i + 1).alias("b")).join(e.select(i.alias("b")), "b", "left_semi").select("a", "b")
    asked = e.where("event_type = 'purchase'").select(i.alias("node"), F.when(F.col("value") > 50, "lakh").otherwise("crore").alias("scale"))
    return graph.settled_scales(same, asked)


# A sheet for each part: its lines by quantity and line number; returned lines hold words.
_CELLS = "(SELECT l_partkey AS s, CAST(l_quantity AS INT) AS r, l_linenumber AS c, max(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) AS num FROM lineitem GROUP BY ALL)"


def _cells(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("sheet"), F.col("l_quantity").cast("int").alias("row"), F.col("l_linenumber").cast("int").alias("col"), (F.col("l_returnflag") != "R").alias("number"))


@query(
    "GR11_cell_regions",
    f"""WITH RECURSIVE k AS {_CELLS}, e AS (SELECT x.s, x.r * 100 + x.c AS a, y.r * 100 + y.c AS b FROM k x JOIN k y ON x.s = y.s AND abs(x.r - y.r) <= 2 AND abs(x.c - y.c) <= 2),
    w(s, a, n) AS (SELECT s, a, a FROM e UNION SELECT w.s, w.a, e.b FROM w JOIN e ON e.s = w.s AND e.a = w.n), m AS (SELECT s, a, min(n) AS g FROM w GROUP BY ALL)
    SELECT m.s AS sheet, g // 100 AS first_row, g % 100 AS first_col, min(r) AS top, min(c) AS left, max(r) AS bottom, max(c) AS right, count(*) AS cells, sum(num) AS numbers FROM m JOIN k ON k.s = m.s AND k.r * 100 + k.c = m.a GROUP BY ALL HAVING sum(num) >= 3""".replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'),
)
def gr11(spark, d):
    r = graph.regions(_cells(spark, d))
    return r.select("sheet", F.col("region.row").alias("first_row"), F.col("region.col").alias("first_col"), "top", "left", "bottom", "right", "cells", "numbers")


@query("GR12_fringe")
def gr12(spark, d):
    """Regions of numbers alone, and the words beside them."""
    cells = _cells(spark, d).groupBy("sheet", "row", "col").agg(F.max("number").alias("number"))
    return graph.absorb_fringe(cells, graph.regions(cells.where("number")).select("sheet", "top", "left", "bottom", "right"))


@query("GR13_agglomerative_merge")
def gr13(spark, d):
    """Labels' centroids (a bounded set) merge on the driver."""
    from gridledger.functions.vectors import centroids

    c = {f"{r.label:04d}": r.centroid for r in centroids(table(spark, d, "embeddings"), "label", "embedding").collect()}
    return spark.createDataFrame(sorted(graph.peel_merge(c).items()), "label string, cluster string")
