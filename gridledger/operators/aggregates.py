"""Aggregates with a verdict: majorities, agreement, exactly-one, medians, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def only(c: Column) -> Column:
    """The one distinct value that is not null; null where there are none or several."""
    return F.when(F.min(c) == F.max(c), F.min(c))


def all_agree(*cols: str) -> Column:
    """Every row has the same values, nulls being values."""
    s = F.struct(*cols)
    return F.min(F.to_json(s, {"ignoreNullFields": "false"})) == F.max(F.to_json(s, {"ignoreNullFields": "false"}))


def dominant(rows: DataFrame, keys: list[str], value: str, share: float = 0.7, typed: float = 0.5) -> DataFrame:
    """keys, value, n: the most common value of each group if it has `share` of those that are not null, and they `typed` of all rows."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    known = F.when(F.col(value).isNotNull(), F.col("n"))
    best = F.max(F.when(F.col(value).isNotNull(), F.struct("n", value)))
    out = counts.groupBy(*keys).agg(F.sum("n").alias("all"), F.coalesce(F.sum(known), F.lit(0)).alias("typed"), best.alias("best"))
    return out.where((F.col("typed") >= typed * F.col("all")) & (F.col("best.n") >= share * F.col("typed"))).select(*keys, f"best.{value}", "best.n")


def majority(rows: DataFrame, keys: list[str], value: str, least: int = 3) -> DataFrame:
    """keys, value: the value of more than half of at least `least` rows, given `least` times; none otherwise."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    out = counts.groupBy(*keys).agg(F.sum("n").alias("all"), F.max(F.struct("n", value)).alias("best"))
    return out.where((F.col("all") >= least) & (F.col("best.n") >= least) & (F.col("best.n") * 2 > F.col("all"))).select(*keys, f"best.{value}")


def joined(value: Column, order: Column, separator: str = "; ") -> Column:
    """Texts of a group in order, joined."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda s: s["v"]), separator)


def gate(read: Column, written: Column, found: Column, settled: Column) -> Column:
    """success where everything read was written and everything found was settled; failed where nothing was written; else partial."""
    return F.when((read == written) & (found == settled), "success").when(written == 0, "failed").otherwise("partial")
