"""Queries of broken references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kvasir.operators.references import REFERENCES, broken_reference_report, broken_references
from kvasir.sources.tables import table


def _broken(spark: SparkSession, d: str) -> DataFrame:
    names = {r.src for r in REFERENCES} | {r.target for r in REFERENCES}
    return broken_references({n: table(spark, d, n) for n in names}, table(spark, d, "deletion_log"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _broken(spark, d).select("src", "id", "kind")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return broken_reference_report(_broken(spark, d))


_FOUND = """
with refs as (
  select 'document_chunks' src, id, documentId k, createdAt c, 'document' e from document_chunks
  union all select 'products', id, documentId, createdAt, 'document' from products
  union all select 'sections', id, documentId, createdAt, 'document' from sections
  union all select 'manual_regions', id, productGroupId, createdAt, 'product_group' from manual_regions),
targets as (
  select 'document' e, doc_id k, min(createdAt) t from documents group by all
  union all select 'product_group', id, min(createdAt) from product_groups group by all),
broken as (
  select distinct src, id, c,
    case when t.k is not null then 'late'
         when exists (select 1 from deletion_log l where l.entity = refs.e and l.entityId = refs.k) then 'deleted'
         else 'missing' end kind
  from refs left join targets t using (e, k)
  where refs.k is not null and (t.k is null or t.t > refs.c))
"""

QUERIES = {"p2_found": p2_found, "p2_report": p2_report}
ORACLES = {
    "p2_found": _FOUND + "select src, id, kind from broken",
    "p2_report": _FOUND + "select src, coalesce(strftime(c, '%Y-%m'), 'unknown') period, kind, count(*) n from broken group by all",
}
