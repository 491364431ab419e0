"""Retrieval of facts: one filter record that becomes a plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The order of path roots.
ROOTS = ("identity", "economic", "technical", "commercial", "legal", "regulatory", "frame")


@dataclass(frozen=True)
class FactQuery:
    """What to retrieve; None does not filter."""

    document_id: int | None = None
    path_prefix: str | None = None
    kind: str | None = None
    fact_id: int | None = None
    current_only: bool = False
    limit: int | None = None


def retrieve(facts: DataFrame, evidence: DataFrame, q: FactQuery) -> DataFrame:
    """facts (fact_id, document_id, path, path_root, value_kind, confidence, is_current, ...) in answer order, each with its evidence
    (fact_id, ordinal, source_text) as a list. Filters reach the scan; evidence is folded before it is joined."""
    f = facts
    if q.document_id is not None:
        f = f.where(F.col("document_id") == q.document_id)
    if q.path_prefix is not None:
        f = f.where(F.lower("path").startswith(q.path_prefix.lower()))
    if q.kind is not None:
        f = f.where(F.col("value_kind") == q.kind)
    if q.fact_id is not None:
        f = f.where(F.col("fact_id") == q.fact_id)
    if q.current_only:
        f = f.where("is_current")
    folded = evidence.groupBy("fact_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "source_text"))).alias("evidence"))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ROOTS)), F.col("path_root")), F.lit(0))
    order = [F.col("path").isNull(), F.when(rank == 0, 99).otherwise(rank), F.col("path"), F.col("confidence").desc_nulls_last(), F.col("fact_id")]
    out = f.join(folded, "fact_id", "left").orderBy(*order)
    return out.limit(q.limit) if q.limit is not None else out
