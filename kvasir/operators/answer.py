"""What an answer is put together from: tables as Markdown, cleaned texts, bundles of a section's chunks, versions and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvasir.functions.text import answer_spacing, estimate_tokens, fold

# Headings of the columns that come first, in this order, if two of them are there.
FIRST_COLUMNS = ("характеристик", "ед.? ?изм|единиц", "значение")
TABLE_WORDS = "таблиц|номенклатур|размер|характеристик"
INTRO_LINE = r"(?miu)^.*таблиц.*(?:\n|$)"
PIPE_TABLE = r"(?m)^[ \t]*\|.*\n[ \t]*\|.*\|?[ \t]*---.*(?:\n[ \t]*\|.*)*\n?"


def table_markdown(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, markdown``: tables given by cells (``row_no, col, name, value``) as Markdown.

    Columns named by a number are left out; if two of characteristic, unit and value are there, they come first. Bars in
    cells are escaped, line ends become slashes. A table's cells are those of one text and are put together in it.
    """
    rows = cells.where(~F.col("name").rlike(r"^[\d-]+$") & (F.trim("name") != ""))
    sort = F.coalesce(*(F.when(fold(F.col("name")).rlike(p), F.lit(i)) for i, p in enumerate(FIRST_COLUMNS)), F.lit(3))
    rows = rows.withColumn("sort", sort)
    known = rows.where("sort < 3").groupBy(*keys).agg(F.countDistinct("sort").alias("known"))
    rows = rows.join(known, keys, "left").withColumn("sort", F.when(F.col("known") >= 2, F.col("sort")).otherwise(3))
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\n+", " / "), "[ \t]+", " "), r"\|", r"\\|"))
    line = lambda c: F.concat(F.lit("| "), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sort", "col", clean(F.col(c)).alias("v")))), lambda s: s["v"]), " | "), F.lit(" |"))
    body = rows.groupBy(*keys, "row_no").agg(line("value").alias("text"), line("name").alias("head"), F.count(F.lit(1)).alias("n"))
    whole = body.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("row_no", "text"))).alias("t"), F.max_by("head", "n").alias("head"), F.max("n").cast("int").alias("n"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("n")))
    return whole.select(*keys, F.concat_ws("\n", "head", rule, F.array_join(F.transform("t", lambda s: s["text"]), "\n")).alias("markdown"))


def strip_tables(text: Column) -> Column:
    """A text without Markdown tables and the lines that introduce one."""
    return answer_spacing(F.regexp_replace(F.regexp_replace(text, INTRO_LINE, ""), PIPE_TABLE, ""))


def table_heading(text: Column) -> Column:
    """The last of a text's eight last filled lines that heads a table, by its words or a colon at the end; null without any."""
    filled = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    last = F.reverse(F.slice(filled, F.greatest(F.size(filled) - 7, F.lit(1)), 8))
    return F.get(F.filter(last, lambda x: fold(x).rlike(TABLE_WORDS) | (F.endswith(x, F.lit(":")) & (F.length(x) <= 80))), 0)


def insert_table(content: Column, label: Column, intro: Column, markdown: Column) -> Column:
    """A text with a table put after its label or, where that is absent, at the end after an introducing line."""
    at = F.instr(F.lower(content), F.lower(label))
    after = F.substring(content, at + F.length(label), F.lit(1 << 30))
    colon = F.regexp_extract(after, r"^\s*:", 0)
    before = F.concat(F.substring(content, F.lit(1), at + F.length(label) - 1), colon)
    rest = F.regexp_replace(F.substring(after, F.length(colon) + 1, F.lit(1 << 30)), r"^\s+", "")
    inside = F.trim(F.concat(F.regexp_replace(before, r"\s+$", ""), F.lit("\n\n"), markdown, F.lit("\n"), rest))
    return F.when((label != "") & (at > 0), inside).otherwise(F.trim(F.concat(F.trim(content), F.lit("\n\n"), intro, F.lit("\n"), markdown)))


def rows_with(cells: DataFrame, keys: list[str], terms: tuple[str, ...]) -> DataFrame:
    """The cells of the table rows in which a name or value contains one of the terms, in any letter case."""
    hit = F.lit(False)
    for t in terms:
        hit = hit | fold(F.concat_ws(" ", "name", "value")).contains(t)
    found = cells.where(hit).select(*keys, "row_no").distinct()
    return cells.join(found, [*keys, "row_no"], "left_semi")


def missing_tables(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """The tables (``fingerprint``) that are not yet there, each content once, the first by its keys."""
    return wanted.join(have.select("fingerprint").distinct(), "fingerprint", "left_anti").groupBy("fingerprint").agg(F.min("table_key").alias("table_key"))


def bundle(chunks: DataFrame, least: float = 0.0) -> DataFrame:
    """``documentId, section, n, tokens, relevance, first_index, digest``: the chunks of a section as one, in the order of their index.

    ``chunks`` has ``id, documentId, sectionPath, chunkIndex, content, relevance``; one without a section is its own. The
    relevance is the best of them, at least ``least``. Only digests are gathered, in slices of a thousand places.
    """
    section = F.coalesce("sectionPath", F.concat(F.lit("#"), F.col("chunkIndex").cast("string")))
    rows = chunks.select("id", "documentId", section.alias("section"), "chunkIndex", "relevance", estimate_tokens(F.col("content")).alias("tokens"), F.md5("content").alias("d"))
    rows = rows.dropDuplicates(["id"]).withColumn("slice", F.coalesce(F.floor(F.col("chunkIndex") / 1000), F.lit(-1)))
    parts = F.sort_array(F.collect_list(F.struct("chunkIndex", "id", "d")))
    slices = rows.groupBy("documentId", "section", "slice").agg(
        F.md5(F.array_join(F.transform(parts, lambda p: p["d"]), "")).alias("d"), F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"),
        F.max("relevance").alias("relevance"), F.min("chunkIndex").alias("first_index"),
    )
    whole = F.sort_array(F.collect_list(F.struct("slice", "d")))
    return slices.groupBy("documentId", "section").agg(
        F.sum("n").alias("n"), F.sum("tokens").cast("bigint").alias("tokens"), F.greatest(F.max("relevance"), F.lit(least)).alias("relevance"), F.min("first_index").alias("first_index"),
        F.md5(F.array_join(F.transform(whole, lambda p: p["d"]), "")).alias("digest"),
    )


def kinds_for_intent(hits: DataFrame, kind: str = "docType") -> DataFrame:
    """The hits of the kinds of documents that the question's intent (``installation, catalog``) asks for; all without one."""
    manual, product = F.col(kind).isin("instruction", "installation"), F.col(kind) == "catalog"
    return hits.where(F.when(F.col("installation"), manual).when(F.col("catalog"), product).otherwise(F.lit(True)))


def boosted_variants(hits: DataFrame) -> DataFrame:
    """The hits of the variants that were boosted (``variant, boosted``); all of a question if none was."""
    q = Window.partitionBy("query_id")
    rows = hits.withColumn("_some", F.max(F.col("boosted") & F.col("variant").isNotNull()).over(q))
    kept = rows.where("_some and boosted").select("query_id", "variant").distinct().withColumn("_kept", F.lit(True))
    return rows.join(kept, ["query_id", "variant"], "left").where("not _some or _kept").drop("_some", "_kept")


def diagnostics(before: DataFrame, after: DataFrame, most: int = 10) -> DataFrame:
    """``query_id, before, after, documents``: the ids of the best hits before and after a choice (``query_id, id, rank``), and how many documents gave them."""
    top = lambda df, name: df.where(F.col("rank") <= most).groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"].cast("string")), ",").alias(name))
    docs = before.where(F.col("rank") <= most).groupBy("query_id").agg(F.countDistinct("documentId").alias("documents"))
    return top(before, "before").join(top(after, "after"), "query_id", "left").join(docs, "query_id")


def product_id(content: Column) -> Column:
    """The product number in a chunk's header: after a tag, else of a model's form, else a number of four to six digits."""
    tag = F.regexp_extract(content, r"(?iu)(?:артикул|article|artikel|sku)\s*:?\s*([\p{L}0-9][\p{L}0-9-]+)", 1)
    model = F.regexp_extract(content, r"\b([A-Z]{2}-[0-9]{2}-[0-9]{4})\b", 1)
    number = F.regexp_extract(content, r"(?:^|[^0-9])([0-9]{4,6})(?:$|[^0-9])", 1)
    return F.coalesce(*(F.when(c != "", c) for c in (tag, model, number)))


def raw_answer_allowed(hits: DataFrame, most: int = 2) -> DataFrame:
    """``query_id, allowed``: whether hits may be shown as they are: catalogues alone, at most ``most`` chunks, of one section, none empty."""
    one = F.countDistinct(F.struct("documentId", F.coalesce("sectionPath", F.lit("")))) == 1
    ok = F.min(F.coalesce(F.col("docType") == "catalog", F.lit(False)) & (F.coalesce(F.length(F.trim("content")), F.lit(0)) > 0))
    return hits.groupBy("query_id").agg((ok & one & (F.count(F.lit(1)) <= most)).alias("allowed"))


def newest_active(versions: DataFrame, key: str, at: str, order: str, value: str) -> DataFrame:
    """``key, value``: of versions of which inserting one retires all before, the newest of each key."""
    return versions.groupBy(key).agg(F.max_by(value, F.struct(at, order)).alias(value))


def whole_or_parts(files: DataFrame, text_col: str, limit: int = 8000) -> DataFrame:
    """``files`` with ``tokens`` and whether a file is given ``whole``, because it fits the limit."""
    size = estimate_tokens(F.col(text_col))
    return files.withColumns({"tokens": size, "whole": size <= limit})


def rewrite_lines(text: Column, pattern: str, replacement: str) -> Column:
    """A text with each line that matches a pattern replaced."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(x.rlike(pattern), F.regexp_replace(x, pattern, replacement)).otherwise(x)), "\n")
