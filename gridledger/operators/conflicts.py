"""Facts of documents beside the cells of a model: which pairs may be compared, and why the others may not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of facts that a model's cells are compared with.
KINDS = ("money", "quantity", "rate", "percent")


def comparisons(facts: DataFrame, cells: DataFrame) -> DataFrame:
    """facts (fact_id, kind, bound, path, period, number, unit) of a comparable kind, each with the outcome: "compare", or the first reason
    against it in this order; and the source of its one cell.

    cells: path, source, number, formula (null or text), period, ambiguous_period, reading (kind, null if none), refused, absolute, unit.
    A path's cells with a number or a formula stand for it, if there are any; else all. Cells meet facts as one row a path.
    """
    numeric = F.col("number").isNotNull() | F.col("formula").isNotNull()
    cell = F.struct("source", "number", "period", "ambiguous_period", "reading", "refused", "absolute", "unit")
    per = cells.groupBy("path").agg(F.count("*").alias("n"), F.count(F.when(numeric, 1)).alias("n_numeric"), F.min(F.when(numeric, cell)).alias("numeric_cell"), F.min(cell).alias("any_cell"))
    one = per.select("path", F.when(F.col("n_numeric") > 0, F.col("n_numeric")).otherwise(F.col("n")).alias("n"), F.coalesce("numeric_cell", "any_cell").alias("cell"))
    both = facts.where(F.col("kind").isin(*KINDS)).join(one, "path", "left")
    c = lambda name: F.col(f"cell.{name}")
    money, plain = F.col("kind") == "money", lambda u: F.lower(F.trim(u))
    outcome = (
        F.when(~F.col("bound") & F.col("path").isNull(), "no_shared_path")
        .when(~F.col("bound"), "unbound")
        .when(F.col("n").isNull(), "no_cell")
        .when(F.col("n") > 1, "several_cells")
        .when(c("ambiguous_period"), "ambiguous_period")
        .when(c("period") != F.col("period"), "other_period")
        .when(c("reading").isNull() | c("refused"), "no_reading")
        .when(c("reading") != F.col("kind"), "other_kind")
        .when(money & c("absolute").isNull(), "no_absolute_amount")
        .when(~money & c("number").isNull(), "cell_without_number")
        .when(~money & F.col("number").isNull(), "fact_without_number")
        .when(~money & ~plain(c("unit")).eqNullSafe(plain(F.col("unit"))), "other_unit")
        .otherwise("compare")
    )
    return both.select("fact_id", outcome.alias("outcome"), F.when(F.col("n") == 1, c("source")).alias("source"))
