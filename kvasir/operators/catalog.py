"""Catalogue tables: headers, fingerprints, groups, product numbers, sections, and what is made of scored hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvasir.functions.text import sku_key


def unique_headers(df: DataFrame, table: list[str], place: str, name: str) -> DataFrame:
    """``df`` with ``header``: each name once a table, later ones numbered from 2 in order of place."""
    n = F.row_number().over(Window.partitionBy(*table, name).orderBy(place))
    return df.withColumn("header", F.when(n == 1, F.col(name)).otherwise(F.concat(name, F.lit(" "), n)))


def table_fingerprints(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, rows, fingerprint`` of tables given by cells (``row_no, col, value``): a digest that ignores case and spacing."""
    text = F.lower(F.regexp_replace("value", r"\s+", ""))
    parts = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("row_no", "name", text.alias("v")))).alias("p"), F.max("row_no").cast("bigint").alias("rows"))
    joined = F.array_join(F.transform("p", lambda c: F.concat(c["name"], F.lit("="), c["v"])), "|")
    return parts.select(*keys, "rows", F.md5(joined).alias("fingerprint"))


def merge_records(df: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """One row a key: of each column the last filled value in the given order, which must be total within a key."""
    filled = [F.max_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(order))).alias(c) for c in columns]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*filled)


def seeded_groups(documents: DataFrame, products: DataFrame) -> DataFrame:
    """``documentId, group_name, items``: one group for each indexed catalogue document, with its distinct product numbers."""
    own = products.select("documentId", sku_key(F.col("sku")).alias("sku")).where("sku is not null").distinct()
    items = own.groupBy("documentId").agg(F.count(F.lit(1)).alias("items"))
    docs = documents.where("docType = 'catalog' and status = 'indexed'").select(F.col("doc_id").alias("documentId"), F.coalesce("title", "filename").alias("group_name"))
    return docs.join(items, "documentId", "left").fillna(0, ["items"])


def ingest_quality(chunks: DataFrame, least: float = 0.5) -> DataFrame:
    """``documentId, share, verdict``: how many chunks have a vector; ``failed`` without any, ``poor`` below ``least``."""
    has = F.col("embedding").isNotNull() & ~F.trim("embedding").isin("", "null", "[]")
    rows = chunks.groupBy("documentId", "id").agg(F.max(has).alias("has")).groupBy("documentId").agg(F.avg(F.col("has").cast("int")).alias("share"))
    verdict = F.when(F.col("share") == 0, "failed").when(F.col("share") < least, "poor").otherwise("good")
    return rows.select("documentId", F.round("share", 6).alias("share"), verdict.alias("verdict"))


def document_outline(sections: DataFrame) -> DataFrame:
    """``documentId, sections, depth, doubled, disordered``: how many sections, levels, paths given twice, and pages that run back.

    Sections delivered twice count once; their order is that of the numbers of their paths.
    """
    rows = sections.select("id", "documentId", "sectionPath", "level", "pageStart").dropDuplicates(["id"])
    number = F.transform(F.split("sectionPath", r"\."), lambda p: p.try_cast("int"))
    w = Window.partitionBy("documentId").orderBy(number, "id")
    back = F.when(F.col("pageStart") < F.lag("pageStart").over(w), 1).otherwise(0)
    twice = F.when(F.row_number().over(Window.partitionBy("documentId", "sectionPath").orderBy("id")) == 2, 1).otherwise(0)
    rows = rows.withColumns({"back": back, "twice": twice})
    return rows.groupBy("documentId").agg(
        F.count(F.lit(1)).alias("sections"), F.max("level").cast("bigint").alias("depth"), F.sum("twice").alias("doubled"), F.sum("back").alias("disordered")
    )


def section_page_ends(sections: DataFrame) -> DataFrame:
    """``id, page_end``: the last page of each section; where it is absent or before the first, the page before the next section."""
    rows = sections.select("id", "documentId", "pageStart", "pageEnd").dropDuplicates(["id"])
    following = F.lead("pageStart").over(Window.partitionBy("documentId").orderBy("pageStart", "id"))
    sound = F.col("pageEnd") >= F.col("pageStart")
    return rows.select("id", F.when(sound, F.col("pageEnd")).otherwise(F.greatest("pageStart", F.coalesce(following - 1, F.col("pageStart")))).alias("page_end"))


def products_by_section_path(products: DataFrame, sections: DataFrame) -> DataFrame:
    """``id, sectionId, path``: products with the section they name, if it belongs to their document, and its path."""
    named = sections.select(F.col("id").alias("sectionId"), F.col("documentId").alias("section_document"), F.col("sectionPath").alias("path")).dropDuplicates(["sectionId"])
    rows = products.select("id", "documentId", "sectionId").dropDuplicates(["id"]).join(named, "sectionId", "left")
    own = F.col("section_document") == F.col("documentId")
    return rows.select("id", F.when(own, F.col("sectionId")).alias("sectionId"), F.when(own, F.col("path")).alias("path"))


def sku_documents(skus: DataFrame, products: DataFrame, groups: DataFrame, documents: DataFrame) -> DataFrame:
    """``sku, doc_id, way``: the documents of product numbers, by the first way that finds any.

    ``product`` – a product with the number; ``title`` – its full form in a document's title; ``group`` – its series in a
    group's name. A number that several documents answer to keeps them all.
    """
    asked = skus.select(F.upper("sku").alias("sku")).where("sku is not null").distinct()
    by_key = asked.withColumn("key", sku_key(F.col("sku"))).where("key is not null")
    code = r"[A-Z]{2}-[0-9]{2}(?:-[0-9]{4})?"

    def codes(df: DataFrame, text: str, *keep: str) -> DataFrame:
        return df.select(*keep, F.explode(F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(code), 0))).alias("code"))

    one = by_key.join(products.select(sku_key(F.col("sku")).alias("key"), F.col("documentId").alias("doc_id")).distinct(), "key").select("sku", "doc_id", F.lit(1).alias("n"))
    two = asked.join(codes(documents, "title", "doc_id"), F.col("sku") == F.col("code")).select("sku", "doc_id", F.lit(2).alias("n"))
    series = asked.withColumn("code", F.regexp_extract("sku", r"^([A-Z]{2}-[0-9]{2})", 1)).where("code <> ''")
    three = series.join(codes(groups, "name", "documentId"), "code").select("sku", F.col("documentId").alias("doc_id"), F.lit(3).alias("n"))
    found = one.unionByName(two).unionByName(three).where("doc_id is not null").distinct()
    first = found.withColumn("first", F.min("n").over(Window.partitionBy("sku"))).where("n = first")
    way = F.when(F.col("n") == 1, "product").when(F.col("n") == 2, "title").otherwise("group")
    return first.select("sku", "doc_id", way.alias("way"))


def attachments(hits: DataFrame, most: int = 2) -> DataFrame:
    """``query_id, documentId, relevance, place``: the ``most`` documents with the highest summed relevance, then number of hits."""
    docs = hits.groupBy("query_id", "documentId").agg(F.round(F.sum("relevance"), 6).alias("relevance"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("query_id").orderBy(F.desc("relevance"), F.desc("n"), "documentId")
    return docs.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= most).select("query_id", "documentId", "relevance", "place")


def clear_winner(hits: DataFrame, least: float, gap: float) -> DataFrame:
    """``query_id, id``: the best hit of each query that reaches ``least`` and leads the next one by ``gap``."""
    w = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "id")
    rows = hits.withColumns({"n": F.row_number().over(w), "second": F.lead("relevance", 1, 0.0).over(w)}).where("n = 1")
    return rows.where((F.col("relevance") >= least) & (F.round(F.col("relevance") - F.col("second"), 9) >= gap)).select("query_id", "id")


def variant_first(hits: DataFrame, match: Column, k: int) -> DataFrame:
    """``query_id, id, rank``: the ``k`` best hits of each query, those that ``match`` a variant before all others."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce(match, F.lit(False))), F.desc("relevance"), "id")
    return hits.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k).select("query_id", "id", "rank")


def reading_lines(items: DataFrame, page: list[str], tolerance: float = 5.0) -> DataFrame:
    """``page, id, line_no, in_line``: items (``id, x, y``) of pages in reading order.

    An item opens a line if it lies more than ``tolerance`` below the item that opened the current one: a fold over the
    items of one page, which are few, inside the JVM.
    """
    rows = items.select(*page, "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null")
    pages = rows.groupBy(*page).agg(F.sort_array(F.collect_list(F.struct("y", "x", "id"))).alias("own"))
    line = f"struct<x:double,id:{dict(items.dtypes)['id']},line_no:bigint>"
    kind = f"struct<n:bigint,top:double,done:array<{line}>>"
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("top"), F.array().cast(f"array<{line}>").alias("done")).cast(kind)

    def add(acc: Column, item: Column) -> Column:
        opens = acc["top"].isNull() | (item["y"] - acc["top"] > tolerance)
        n = F.when(opens, acc["n"] + 1).otherwise(acc["n"])
        entry = F.struct(item["x"].alias("x"), item["id"].alias("id"), n.alias("line_no"))
        return F.struct(n.alias("n"), F.when(opens, item["y"]).otherwise(acc["top"]).alias("top"), F.concat(acc["done"], F.array(entry)).alias("done")).cast(kind)

    flat = pages.select(*page, F.explode(F.aggregate("own", start, add, lambda a: a["done"])).alias("e")).select(*page, "e.*")
    place = F.row_number().over(Window.partitionBy(*page, "line_no").orderBy("x", "id")).cast("bigint")
    return flat.withColumn("in_line", place).drop("x")
