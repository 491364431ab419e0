"""Ranking, chains and islands over ordered groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in this order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def latest_by(rows: DataFrame, keys: list[str], value: str, at: Column) -> DataFrame:
    """keys and the value of each group's greatest `at`: an aggregate, which combines before the shuffle."""
    return rows.groupBy(*keys).agg(F.max_by(value, at).alias(value))


def supersede(rows: DataFrame, keys: list[str], order: list[Column], id_col: str) -> DataFrame:
    """rows with superseded_by (the next of the group) and is_current (the last of it)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("superseded_by", F.lead(id_col).over(w)).withColumn("is_current", F.col("superseded_by").isNull())


def islands(rows: DataFrame, keys: list[str], order: list[Column], starts: Column, name: str = "island") -> DataFrame:
    """rows with the number of group starts up to and with each row; 0 before the first."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(starts.cast("int")).over(w))


def runs(rows: DataFrame, keys: list[str], at: str, gap: int = 1, name: str = "run") -> DataFrame:
    """rows numbered by runs of `at` whose steps are at most gap."""
    w = Window.partitionBy(*keys).orderBy(at)
    return islands(rows.withColumn("_new", F.coalesce(F.col(at) - F.lag(at).over(w) > gap, F.lit(True))), keys, [F.col(at)], F.col("_new"), name).drop("_new")


def around(value: Column, keys: list[str], at: str, reach: int = 5) -> Column:
    """An aggregate over the rows of the group within reach of this one's place."""
    return value.over(Window.partitionBy(*keys).orderBy(at).rangeBetween(-reach, reach))


def fill_down(c: Column, keys: list[str], order: list[Column], reach: int | None = None) -> Column:
    """The nearest value that is not null at or above."""
    first = Window.unboundedPreceding if reach is None else -reach
    return F.last(c, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(first, 0))


def placed(rows: DataFrame, *order) -> DataFrame:
    """rows with place, their number from 1 in the order of all: sorted by range, numbered in each part, parts' sizes summed up (one row a part)."""
    from gridledger.operators.graph import cut

    sorted_ = cut(rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = sorted_.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = sorted_.withColumn("_part", part).join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    return numbered.withColumn("place", F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_id", "_before")
