"""References to records that do not exist.

A Bloom filter of the target's keys, of bounded size, is tested in the scan of each referring table: what it denies is
surely an orphan and needs no join with the target. Only the references it lets pass are verified by an exact join,
which also tells those whose target came later. All steps pre-aggregate or keep three narrow columns, and a target that
owns a large share of the references is looked up by broadcast.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvasir.functions.bloom import bloom_filter, might_contain
from kvasir.operators.joins import hottest_keys, skew_left_join
from kvasir.sources.tables import cut


class Reference(NamedTuple):
    """``column`` of the table ``src`` names the ``target_key`` of the table ``target``, which the deletion log calls ``entity``."""

    src: str
    column: str
    target: str
    target_key: str
    entity: str


# The references of the document store.
REFERENCES = (
    Reference("document_chunks", "documentId", "documents", "doc_id", "document"),
    Reference("products", "documentId", "documents", "doc_id", "document"),
    Reference("sections", "documentId", "documents", "doc_id", "document"),
    Reference("manual_regions", "productGroupId", "product_groups", "id", "product_group"),
)


def broken_references(tables: dict[str, DataFrame], deletions: DataFrame, references: tuple[Reference, ...] = REFERENCES) -> DataFrame:
    """``src, id, kind, created``: one row per record with a reference that doesn't hold.

    ``kind`` is ``deleted`` if the target is absent and the log has its deletion under the right entity, ``missing`` if
    it is absent otherwise, ``late`` if it exists but was created after the referring record. A null reference is no
    case, nor is a null creation time ever late. Records delivered twice count once; a target with several rows counts
    from its earliest. Empty tables of targets make every reference an orphan. Further columns are not read.
    """
    found = []
    log = deletions.where("entityId is not null").select("entity", F.col("entityId").cast("bigint").alias("key")).distinct()
    log = log.withColumn("in_log", F.lit(True))
    for (target, target_key, entity), own in _by_target(references).items():
        keys = tables[target].select(F.col(target_key).cast("bigint").alias("key"), F.col("createdAt").alias("target_created"))
        keys = keys.where("key is not null")
        bloom = bloom_filter(keys, "key")
        refs = reduce(
            DataFrame.unionByName,
            [
                tables[r.src].select(F.lit(r.src).alias("src"), F.col("id"), F.col(r.column).cast("bigint").alias("key"), F.col("createdAt").alias("created"))
                for r in own
            ],
        ).where("key is not null")
        hot = hottest_keys(refs, "key")
        maybe = might_contain(refs, bloom, F.col("key"))
        surely = refs.where(~maybe).withColumns({"late": F.lit(False), "absent": F.lit(True)})
        exact = keys.groupBy("key").agg(F.min("target_created").alias("target_created"), F.lit(True).alias("present"))
        passed = skew_left_join(refs.where(maybe), exact, "key", hot)
        late = F.coalesce(F.col("target_created") > F.col("created"), F.lit(False))
        passed = passed.withColumns({"late": late, "absent": F.col("present").isNull()}).where("late or absent")
        orphans = cut(passed.select(surely.columns).unionByName(surely))  # few rows, so that no table is read again for the log
        judged = skew_left_join(orphans, log.where(F.col("entity") == entity).drop("entity"), "key", hot)
        kind = F.when(~F.col("absent"), "late").when(F.col("in_log"), "deleted").otherwise("missing")
        found.append(judged.select("src", "id", kind.alias("kind"), "created"))
    return reduce(DataFrame.unionByName, found).dropDuplicates(["src", "id"])


def _by_target(references: tuple[Reference, ...]) -> dict[tuple[str, str, str], list[Reference]]:
    own: dict[tuple[str, str, str], list[Reference]] = {}
    for r in references:
        own.setdefault((r.target, r.target_key, r.entity), []).append(r)
    return own


def broken_reference_report(broken: DataFrame) -> DataFrame:
    """``src, period, kind, n``: the broken references of each table and month; ``unknown`` for records without a time."""
    period = F.coalesce(F.date_format("created", "yyyy-MM"), F.lit("unknown"))
    return broken.groupBy("src", period.alias("period"), "kind").agg(F.count(F.lit(1)).alias("n"))
