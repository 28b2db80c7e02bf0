"""Reads and writes on the document store, its statistics, links and synchronisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvasir.operators.joins import skew_left_join


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each value of ``keys``, the first in the given order, which must be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def page(df: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    """Page ``number``, from 0, of rows in a total order."""
    return df.orderBy(*order).offset(size * number).limit(size)


def next_index(chunks: DataFrame) -> DataFrame:
    """``documentId, next``: the index that a further chunk of each document gets."""
    return chunks.groupBy("documentId").agg((F.coalesce(F.max("chunkIndex"), F.lit(-1)) + 1).cast("bigint").alias("next"))


def processing_profile(chunks: DataFrame) -> DataFrame:
    """``documentId`` and the numbers of its chunks, of those with a vector, of tables, pages and tokens."""
    rows = chunks.dropDuplicates(["id"])
    return rows.groupBy("documentId").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.sum(F.when(F.col("embedding").isNotNull(), 1).otherwise(0)).alias("with_vector"),
        F.sum(F.when(F.col("elementType") == "table", 1).otherwise(0)).alias("tables"),
        F.countDistinct("pageNumber").alias("pages"),
        F.sum("tokenCount").alias("tokens"),
    )


def with_last_annotation(rows: DataFrame, notes: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """``rows`` left-joined to the last note of each key in the given order."""
    return rows.join(latest(notes, keys, *order), keys, "left")


def search_text(df: DataFrame, needle: str, *columns: str) -> DataFrame:
    """The rows of which a column contains ``needle`` in any letter case."""
    low = F.lower(F.lit(needle))
    return df.where(reduce(Column.__or__, (F.coalesce(F.contains(F.lower(c), low), F.lit(False)) for c in columns)))


def without_deleted(tables: dict[str, tuple[DataFrame, str]], deleted: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows that name a deleted document (``doc_id``) in their given column."""
    gone = deleted.select("doc_id").distinct().withColumn("_gone", F.lit(True))
    return {
        name: skew_left_join(df, gone.withColumnRenamed("doc_id", column), column).where("_gone is null").drop("_gone")
        for name, (df, column) in tables.items()
    }


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` with its rows replaced by those of ``fresh`` of the same key, and new ones added."""
    return stored.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def daily_statistics(chat: DataFrame) -> DataFrame:
    """One row a day: exchanges, those of each source, mean time and tokens, texts without a response."""
    rows = chat.dropDuplicates(["id"]).where("createdAt is not null")
    return rows.groupBy(F.to_date("createdAt").alias("day")).agg(*_measures())


def daily_statistics_open(chat: DataFrame, days: DataFrame) -> DataFrame:
    """The same measures for each ``day`` over all exchanges from its start on, without an upper end.

    Days are aggregated once and then summed backwards in a running sum over one row a day.
    """
    once = chat.where("createdAt is not null").select("id", F.to_date("createdAt").alias("day")).dropDuplicates(["id"])
    both = once.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.lit(False).alias("asked"))
    both = both.unionByName(days.select("day", F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("asked")).distinct())
    per_day = both.groupBy("day").agg(F.sum("n").alias("n"), F.max("asked").alias("asked"))
    later = F.sum("n").over(Window.orderBy(F.desc("day")))
    return per_day.withColumn("exchanges", later).where("asked").select("day", "exchanges")


def _measures() -> list[Column]:
    sources = [F.sum(F.when(F.col("source") == s, 1).otherwise(0)).alias(s) for s in ("website", "bitrix24", "test")]
    times = [F.round(F.avg(c), 2).alias(f"mean_{c}") for c in ("responseTime", "tokensUsed")]
    return [F.count(F.lit(1)).alias("exchanges"), *sources, *times]


def assistant_totals(chat: DataFrame) -> DataFrame:
    """The measures over all exchanges."""
    return chat.dropDuplicates(["id"]).agg(*_measures())


def popular(df: DataFrame, column: str, most: int) -> DataFrame:
    """The ``most`` most frequent values of a column, ties by value."""
    rows = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return rows.orderBy(F.desc("n"), column).limit(most)


def first_last(df: DataFrame, key: Column, at: str) -> DataFrame:
    """``origin, n, first_seen, last_seen`` of each key."""
    return df.groupBy(key.alias("origin")).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))


def content_hashes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``<id_col>, hash``: the SHA-256 of each text's bytes."""
    return df.select(id_col, F.sha2(F.col(text_col).cast("binary"), 256).alias("hash"))


def sync_actions(stored: DataFrame, found: DataFrame) -> DataFrame:
    """``url, action``: what a run of a source does, from ``url, hash, source`` of what is stored and what was found.

    ``add`` for a new address, ``update`` for another content, ``restore`` where the stored hash is missing, ``same``
    otherwise; ``orphan`` for a stored address not found, of sources of which anything was found; ``conflict`` for an
    address that belongs to another source.
    """
    left, right = stored.select("url", F.col("hash").alias("old"), F.col("source").alias("owner")), found.select("url", "hash", "source")
    alive = found.select(F.col("source").alias("owner")).distinct().withColumn("alive", F.lit(True))
    both = left.join(right, "url", "full").join(alive, "owner", "left")
    action = (
        F.when(F.col("owner").isNull() & F.col("source").isNotNull() & F.col("old").isNull(), "add")
        .when(F.col("source").isNull() & F.col("alive"), "orphan")
        .when(F.col("source").isNull(), "same")
        .when(F.col("owner") != F.col("source"), "conflict")
        .when(F.col("old").isNull(), "restore")
        .when(F.col("old") != F.col("hash"), "update")
        .otherwise("same")
    )
    return both.select("url", action.alias("action"))


_ANCHOR = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"'#]*)[^"']*["'][^>]*>(.*?)</a>"""


def links(pages: DataFrame, *, needle: str = "", extension: str = "") -> DataFrame:
    """``page_id, url, title``: the links of pages (``page_id, url, html``), absolute, each address of a page once.

    Fragments are dropped, tags taken out of titles and the five basic entities decoded. Only addresses that contain
    ``needle`` and whose path ends with ``extension`` stay; the first title of an address wins.
    """
    hits = F.arrays_zip(F.regexp_extract_all("html", F.lit(_ANCHOR), 1).alias("href"), F.regexp_extract_all("html", F.lit(_ANCHOR), 2).alias("body"))
    rows = pages.where("html is not null").select("page_id", F.col("url").alias("base"), F.posexplode(hits).alias("pos", "a"))
    origin = F.regexp_extract("base", r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace("base", r"[?#].*$", ""), r"(?<=[^/:]/)[^/]*$", "")
    href = F.trim(_entities(F.col("a.href")))
    url = (
        F.when(href.rlike("(?i)^https?://"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract("base", "^(https?:)", 1), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(F.regexp_replace("base", r"[?#].*$", ""), href))
        .otherwise(F.concat(folder, href))
    )
    title = F.trim(F.regexp_replace(_entities(F.regexp_replace("a.body", "<[^>]*>", " ")), r"\s+", " "))
    rows = rows.where(href != "").select("page_id", "pos", url.alias("url"), title.alias("title"))
    rows = rows.where(F.col("url").contains(needle) & F.lower(F.regexp_replace("url", r"[?#].*$", "")).endswith(extension.lower()))
    return latest(rows, ["page_id", "url"], F.asc("pos")).drop("pos")


def _entities(text: Column) -> Column:
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """``name, n``: the rows of each table."""
    return reduce(DataFrame.unionAll, [df.select(F.lit(n).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")) for n, df in sorted(tables.items())])


def inventory_shrunk(before: DataFrame, after: DataFrame) -> DataFrame:
    """``name, before, after, shrunk``: whether a table has lost rows, or is gone, since an earlier inventory."""
    both = before.select("name", F.col("n").alias("before")).join(after.select("name", F.col("n").alias("after")), "name", "left").fillna(0, ["after"])
    return both.withColumn("shrunk", F.col("after") < F.col("before"))


def lost_characters(source: DataFrame, target: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``<id_col>, lost``: how many visible characters of each text are missing from the text of the same id, as a multiset."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        letters = df.where(F.col(text_col).isNotNull()).select(id_col, F.explode(F.split(F.regexp_replace(F.col(text_col), r"\s", ""), "")).alias("c"))
        return letters.where("c <> ''").groupBy(id_col, "c").agg(F.count(F.lit(1)).alias(name))

    both = counted(source, "a").join(counted(target, "b"), [id_col, "c"], "left").fillna(0, ["b"])
    return both.groupBy(id_col).agg(F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("lost"))


def point_lookup(df: DataFrame, key: str, values: list) -> DataFrame:
    """The rows of a few keys, by a filter that reaches the scan; repeated rows once by all columns but texts are compared by digest."""
    return df.where(F.col(key).isin(values))


def section_range(chunks: DataFrame, document: int, path: str) -> DataFrame:
    """A section's chunks in the order of their index."""
    return chunks.where((F.col("documentId") == document) & (F.col("sectionPath") == path)).orderBy("chunkIndex", "id")


def session_rows(chat: DataFrame, session: Column, last: int = 10) -> DataFrame:
    """``session, id, place``: the ``last`` exchanges of each session, the newest first."""
    rows = chat.where("createdAt is not null").select(session.alias("session"), "id", "createdAt").where("session is not null").dropDuplicates(["id"])
    w = Window.partitionBy("session").orderBy(F.desc("createdAt"), F.desc("id"))
    return rows.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= last).select("session", "id", "place")


def exists_by(keys: DataFrame, key: str, rows: DataFrame, column: str) -> DataFrame:
    """``key, present``: whether any row has the key."""
    have = rows.where(F.col(column).isNotNull()).select(F.col(column).alias(key)).distinct().withColumn("present", F.lit(True))
    return keys.select(key).distinct().join(have, key, "left").fillna(False, ["present"])


def assign(df: DataFrame, key: str, wanted: DataFrame, column: str) -> DataFrame:
    """``df`` with ``column`` set for the keys of ``wanted`` (``key, value``), as an update by a list of keys does."""
    return df.join(wanted.select(F.col("key").alias(key), F.col("value").alias("_value")), key, "left").withColumn(column, F.coalesce("_value", column)).drop("_value")


def insert_or_update(stored: DataFrame, fresh: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """``stored`` read and written again: of each key the fresh values where there are any, else the stored ones."""
    renamed = fresh.select(*keys, *(F.col(v).alias(f"_{v}") for v in values), F.lit(True).alias("_fresh"))
    both = stored.select(*keys, *values).join(renamed, keys, "full")
    return both.select(*keys, *(F.when(F.col("_fresh"), F.coalesce(f"_{v}", v)).otherwise(F.col(v)).alias(v) for v in values))


def replace_by_key(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """``stored`` with all rows of the keys of ``fresh`` replaced by those of ``fresh``."""
    gone = fresh.select(key).distinct().withColumn("_gone", F.lit(True))
    return skew_left_join(stored, gone, key).where("_gone is null").drop("_gone").unionByName(fresh)


def delete_source(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """``doc_id, action``: what happens to the documents of sources that are deleted (``syncSourceId``).

    Those whose indexing failed are deleted, those being processed are marked failed, all others are kept, detached.
    """
    hit = documents.join(F.broadcast(sources.select("syncSourceId").distinct()), "syncSourceId")
    action = F.when(F.col("status") == "failed", "delete").when(F.col("status") == "processing", "fail").otherwise("detach")
    return hit.select("doc_id", action.alias("action"))


def origin_statistics(chat: DataFrame, origin: str = "source") -> DataFrame:
    """``origin``, its exchanges, those answered, rated and with a session, and when the first and the last was."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return chat.dropDuplicates(["id"]).groupBy(F.col(origin).alias("origin")).agg(
        F.count(F.lit(1)).alias("requests"), n(F.col("response").isNotNull()).alias("answered"), n(F.col("rating").isNotNull()).alias("rated"),
        F.countDistinct(F.lower(F.trim("sessionId"))).alias("sessions"), F.min("createdAt").alias("first_seen"), F.max("createdAt").alias("last_seen"),
    )


def sync_totals(actions: DataFrame) -> DataFrame:
    """``kind, source, action, n``: actions by kind, by source and altogether; null stands for all."""
    sets = actions.cube("kind", "source").agg(*(F.sum(F.when(F.col("action") == a, 1).otherwise(0)).alias(a) for a in ("add", "update", "same", "orphan", "restore")))
    return sets


def same_source(derived_hash: Column, saved: Column, source_hash: Column, versions: tuple[str, ...]) -> Column:
    """Whether a derived document was made from a source with this hash, by what it saved or by the digests of converters' versions and the hash."""
    made = [derived_hash == F.sha2(F.concat_ws(":", F.lit(v), source_hash), 256) for v in versions]
    return source_hash.isNotNull() & F.when(saved.isNotNull(), saved == source_hash).otherwise(reduce(Column.__or__, made, derived_hash == source_hash))


def recoverable(doc: DataFrame) -> DataFrame:
    """``doc`` with ``recoverable``: whether a review can go on where it stopped.

    ``doc`` has ``docType, fileType, status, message, required, has_review, review_hash, source_hash, outlined``: not if a
    new review is required or the source has changed since; only for a Markdown manual that waits for a review, or whose
    indexing failed after one.
    """
    changed = F.coalesce(F.col("review_hash") != F.col("source_hash"), F.lit(False))
    waits = (F.col("status") == "processing") & F.coalesce(F.contains("message", F.lit("waits for review")), F.lit(False))
    failed = (F.col("status") == "failed") & F.col("has_review")
    ok = (F.col("docType") == "installation") & (F.col("fileType") == "md") & (waits | failed) & (F.col("has_review") | F.col("outlined"))
    return doc.withColumn("recoverable", F.coalesce(ok & ~changed & ~F.coalesce(F.col("required"), F.lit(False)), F.lit(False)))


def orphan_counts(tables: dict[str, tuple[DataFrame, str]], parents: DataFrame, key: str) -> DataFrame:
    """``name, orphans``: how many records (``id``) of each table name a parent that isn't there; all if there are no parents."""
    have = parents.select(F.col(key).alias("_key")).distinct().withColumn("_here", F.lit(True))
    found = []
    for name, (df, column) in sorted(tables.items()):
        rows = df.where(F.col(column).isNotNull()).select("id", F.col(column).alias("_key")).distinct()
        lost = skew_left_join(rows, have, "_key").where("_here is null")
        found.append(lost.agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(name).alias("name"), "orphans"))
    return reduce(DataFrame.unionAll, found)


def due(sources: DataFrame, now, seconds: int, at: str = "lastSyncedAt") -> DataFrame:
    """The enabled sources whose last run lies at least ``seconds`` before ``now``, or that never ran."""
    late = F.col(at).isNull() | (F.col(at) <= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {seconds} seconds"))
    return sources.where(F.coalesce(F.col("enabled"), F.lit(False)) & late)
