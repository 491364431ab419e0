"""Versions, supersession, snapshots and writes that replace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def precedence(rows: DataFrame, keys: list[str], amendment: str, revision: str, *later: Column) -> DataFrame:
    """rows with place, 1 the version that wins. A level counts where all versions of the group state one (it is not -1).

    Levels compare only if both sides have them, which is no order over mixed groups; there, the later keys decide.
    """
    w = Window.partitionBy(*keys)
    level = lambda c: F.when(F.min(c).over(w) >= 0, F.col(c)).otherwise(F.lit(-1))
    order = Window.partitionBy(*keys).orderBy(F.desc("_a"), F.desc("_r"), *later)
    return rows.withColumn("_a", level(amendment)).withColumn("_r", level(revision)).withColumn("place", F.row_number().over(order)).drop("_a", "_r")


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the rows of any key that new has, and new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], changed: list[str]) -> DataFrame:
    """old with the changed columns of new where keys meet, and new's other rows. One full join; keys are unique on both sides."""
    pre = new.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in new.columns if c not in keys), F.lit(True).alias("_hit"))
    both = old.withColumn("_old", F.lit(True)).join(pre, keys, "full")
    pick = lambda c: F.when(F.col("_hit") & (F.lit(c in changed) | F.col("_old").isNull()), F.col(f"_new_{c}")).otherwise(F.col(c))
    return both.select(*(F.col(c) if c in keys else pick(c).alias(c) for c in old.columns))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, and the rows of new whose key it lacks, one for each key."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def delete_cascade(gone: DataFrame, key: str, dependents: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Each dependent table without the rows of the keys in gone."""
    ids = gone.select(key).distinct()
    return {name: df.join(ids, key, "left_anti") for name, df in dependents.items()}


def stale(snapshots: DataFrame, links: DataFrame, facts: DataFrame) -> DataFrame:
    """(snapshot_id, reason): snapshots that refer to a fact that is no longer current, with the reasons in fact order."""
    from gridledger.operators.aggregates import joined

    old = links.join(facts.where(~F.col("is_current")), "fact_id")
    reason = F.concat(F.lit("fact "), F.col("fact_id").cast("string"), F.lit(" superseded by "), F.col("superseded_by").cast("string"))
    return old.join(snapshots.select("snapshot_id"), "snapshot_id", "left_semi").groupBy("snapshot_id").agg(joined(reason, F.col("fact_id")).alias("reason"))
