"""Sources and sinks: what is written as files is read back."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from gridledger.functions import cells, text
from gridledger.registry import query, table
from gridledger.sources import delimited, files, packs, sinks
from gridledger.sources.scratch import scratch

_MELTED = "SELECT '{0}' AS source, row_number() OVER (ORDER BY {1}) AS row_num, unnest([1, 2, 3]) AS col_num, unnest([CAST({1} AS VARCHAR), {2}, {3}]) AS text FROM {0}"


@query("SRC1_sniffed_cells", _MELTED.format("nation", "n_nationkey", "n_name", "'a;b,' || CAST(n_regionkey AS VARCHAR)") + " UNION ALL " + _MELTED.format("region", "r_regionkey", "r_name", "'x\"y'"))
def src1(spark, d):
    """Two tables as files of unlike dialects, each with quoted delimiters or quotes, read back as cells by one call."""
    root = scratch(spark, "csv")
    nation = table(spark, d, "nation").orderBy("n_nationkey").select("n_nationkey", "n_name", F.concat(F.lit("a;b,"), F.col("n_regionkey").cast("string")))
    nation.coalesce(1).write.option("sep", ";").option("quoteAll", True).csv(f"{root}/nation")
    region = table(spark, d, "region").orderBy("r_regionkey").select("r_regionkey", "r_name", F.lit('x"y'))
    region.coalesce(1).write.option("sep", "|").option("encoding", "UTF-16LE").option("escape", '"').option("quoteAll", True).csv(f"{root}/region")
    got = delimited.read_cells(spark, f"{root}/nation", delimiter=None).unionByName(delimited.read_cells(spark, f"{root}/region", encoding="utf-16le"))
    return got.select(F.regexp_extract("path", r"/(nation|region)/[^/]*$", 1).alias("source"), F.col("row_num").cast("bigint").alias("row_num"), "col_num", "text")


@query("SRC5_document_scan", "SELECT 'pdf' AS kind, length(n_name) + 1 AS bytes, sha256(n_name || chr(10)) AS sha256 FROM nation")
def src5(spark, d):
    root = scratch(spark, "files")
    table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("value")).coalesce(1).write.partitionBy("n_nationkey").text(root)
    files_ = files.documents(spark, root)
    # Spark names the files itself, so that their kind is told as if they ended in .pdf.
    return files_.select(F.lit(files.KINDS["pdf"]).alias("kind"), "bytes", "sha256")


@query(
    "SRC7_ocr_lines",
    "SELECT l_orderkey AS page, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS line, string_agg(w, ' ' ORDER BY k, w) AS text FROM (SELECT l_orderkey, l_linenumber, unnest([1, 2]) AS k, unnest([l_returnflag || l_linestatus, 'w' || CAST(l_partkey AS VARCHAR)]) AS w FROM lineitem) GROUP BY l_orderkey, l_linenumber",
)
def src7(spark, d):
    """Each order a page, each line two words, the second a little lower; a row of a block and one of an empty word stand among them."""
    l = table(spark, d, "lineitem").withColumn("flag", F.concat("l_returnflag", "l_linestatus")).withColumn("part", F.concat(F.lit("w"), F.col("l_partkey").cast("string")))
    # Lines of an order that share a number are one line.
    top = F.col("l_linenumber") * 40
    word = lambda level, left, down, t: F.struct(F.lit(level).alias("level"), F.lit(left).alias("left"), (top + down).alias("top"), t.alias("text"))
    rows = l.select("l_orderkey", F.explode(F.array(word(5, 10, 0, F.col("flag")), word(5, 90, 3, F.col("part")), word(5, 50, 1, F.lit("  ")), word(2, 0, 0, F.lit("block")))).alias("w"))
    root = scratch(spark, "ocr")
    i = lambda x: F.lit(x).cast("int")
    out = rows.select(F.col("w.level").alias("level"), F.col("l_orderkey").cast("int").alias("page_num"), i(1).alias("block_num"), i(1).alias("par_num"), i(1).alias("line_num"), i(1).alias("word_num"), F.col("w.left").alias("left"), F.col("w.top").cast("int").alias("top"), i(30).alias("width"), i(20).alias("height"), F.lit(91.5).alias("conf"), F.col("w.text").alias("text"))
    out.write.option("sep", "\t").option("header", True).option("emptyValue", "").csv(root)
    lines = files.ocr_lines(files.ocr_words(spark, root), ["page_num"])
    return lines.select(F.col("page_num").cast("bigint").alias("page"), F.col("line").cast("bigint").alias("line"), "text")


@query("SRC9_pack_catalog", "SELECT 'region' || CAST(n_regionkey AS VARCHAR) AS pack, lower(replace(n_name, ' ', '_')) AS key, 'economic' AS root, CASE WHEN n_nationkey % 2 = 0 THEN 'money' ELSE 'text' END AS kind, n_nationkey % 3 = 0 AS required FROM nation")
def src9(spark, d):
    """A pack for each region, with a field for each of its nations, written as JSON and checked whole."""
    n = table(spark, d, "nation")
    field = F.struct(F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))).alias("key"), F.when(F.col("n_nationkey") % 2 == 0, "money").otherwise("text").alias("value_kind"), F.lit("economic").alias("path_root"), (F.col("n_nationkey") % 3 == 0).alias("required"))
    root = scratch(spark, "packs")
    packs_ = n.groupBy("n_regionkey").agg(F.collect_list(field).alias("fields")).select(F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("code"), F.lit("1.0").alias("version"), "fields")
    sinks.export_json(packs_, root)
    read = [json.loads(r.value) for r in spark.read.text(root).collect()]  # packs are a few files
    return packs.fields(spark, read).select(F.col("pack_code").alias("pack"), "key", F.col("path_root").alias("root"), F.col("value_kind").alias("kind"), "required")


@query("SNK1_grid_write", "SELECT l_returnflag, count(*) AS cells, sum(CAST(l_quantity AS BIGINT)) AS total FROM lineitem GROUP BY 1")
def snk1(spark, d):
    """Written twice, by partition: what is there is what was written once."""
    l, root = table(spark, d, "lineitem"), scratch(spark, "grid")
    for _ in range(2):
        sinks.replace_partitions(l, root, ["l_returnflag"])
    return spark.read.parquet(root).groupBy("l_returnflag").agg(F.count("*").alias("cells"), F.sum(F.col("l_quantity").cast("bigint")).alias("total"))


@query("SNK8_redacted_export", "SELECT c_custkey, 'account of' AS cell, 1 AS masked FROM customer UNION ALL SELECT c_custkey, 'Terms', 0 FROM customer")
def snk8(spark, d):
    """Cells as they leave: texts without values, and beside each whether any went; the audit is written with the cells."""
    c = table(spark, d, "customer")
    raw = c.select("c_custkey", F.explode(F.array(F.concat(F.lit("account of ABCDE"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit("F")), F.lit("Terms"))).alias("raw"))
    out = raw.withColumn("cell", text.redacted(F.col("raw"))).withColumn("masked", (F.col("cell") != F.col("raw")).cast("int")).drop("raw")
    root = scratch(spark, "redacted")
    out.write.parquet(root)
    return spark.read.parquet(root)


@query("SNK8_redacted_numbers", "SELECT count(*) AS cells, count(*) FILTER (l_quantity > 0) AS positive FROM lineitem")
def snk8_numbers(spark, d):
    """Numbers leave as others of like size and sign."""
    n = table(spark, d, "lineitem").select(cells.dummy(F.col("l_quantity").cast("double"), F.concat(F.lit("A"), F.col("l_linenumber").cast("string"))).alias("x"))
    return n.agg(F.count("*").alias("cells"), F.count(F.when(F.col("x") > 0, 1)).alias("positive"))


@query("SNK9_comparison_report", "SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, l_returnflag || ' / ' || l_linestatus AS verdict FROM lineitem WHERE l_returnflag <> 'N'")
def snk9(spark, d):
    root = scratch(spark, "report")
    rows = table(spark, d, "lineitem").where("l_returnflag <> 'N'").select("l_orderkey", F.concat_ws(" / ", "l_returnflag", "l_linestatus").alias("verdict"))
    sinks.export_csv(rows, root)
    return spark.read.option("header", True).csv(root)
