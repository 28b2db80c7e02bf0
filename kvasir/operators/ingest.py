"""From parsed texts to what is stored: headings, tables in text, their rows, products, and the chunks of sections, regions and items."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvasir.functions.text import estimate_tokens, fold, sku_key
from kvasir.operators.chunk import lines

NUMBERED = r"^\s*([0-9]{1,2}(?:\.[0-9]{1,2}){0,3})\.?\s+(\p{L}.{1,118})$"
CHAPTER = r"^\s*(глава|раздел|часть|chapter|section|kapitel|chapitre)\s+[0-9]+[.:]?\s*(.*)$"
UNITS = r"^(мм|см|м|кг|г|л|бар|шт|вт|mm|cm|m|kg|g|l|bar|pcs|w|nm)([^\p{L}\p{N}_]|$)"
SKU_COLUMN, NAME_COLUMN = r"артикул|\bsku\b|^код( |$)|article|artikel", r"наименование|название|^name$|bezeichnung|désignation"
CHARACTERISTIC = "характеристик|параметр|значение|показатель|characteristic|parameter|value|merkmal"


def numbered_headings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``<id_col>, no, path, title``: lines that are numbered headings or named chapters.

    A line that ends a sentence, whose words begin with a unit of measure, or that holds a product number is none.
    """
    rows = lines(df, id_col, text_col)
    path, title = F.regexp_extract("line", NUMBERED, 1), F.trim(F.regexp_extract("line", NUMBERED, 2))
    chapter = F.col("line").rlike("(?iu)" + CHAPTER)
    number = F.regexp_extract("line", r"([0-9]+)", 1)
    plain = (path != "") & ~F.lower(title).rlike(UNITS) & ~title.rlike(r"[.!?;,]\s*$") & ~title.rlike(r"[A-Z]{2}-[0-9]{2}-[0-9]{4}")
    rows = rows.select(id_col, "no", F.when(plain, path).when(chapter, number).alias("path"), F.when(plain, title).when(chapter, F.trim("line")).alias("title"))
    return rows.where("path is not null")


def sections_by_titles(df: DataFrame, id_col: str, text_col: str, titles: DataFrame) -> DataFrame:
    """``<id_col>, section, lines, chars``: a text's lines by the last heading at or before them (``titles``: ``<id_col>, no, title``); 0 before the first.

    Sections are counted in the order of their headings; the lines' lengths are summed, no text is gathered.
    """
    rows = lines(df, id_col, text_col).select(id_col, "no", F.length("line").alias("n"), F.lit(0).alias("opens"))
    marks = titles.select(id_col, "no", F.lit(0).alias("n"), F.lit(1).alias("opens"))
    both = rows.unionByName(marks).groupBy(id_col, "no").agg(F.sum("n").alias("n"), F.max("opens").alias("opens"))
    w = Window.partitionBy(id_col).orderBy("no")
    placed = both.withColumn("section", F.sum("opens").over(w))
    return placed.groupBy(id_col, "section").agg(F.count(F.lit(1)).alias("lines"), F.sum("n").alias("chars"))


def table_blocks(df: DataFrame, id_col: str, text_col: str, least: int = 2) -> DataFrame:
    """``<id_col>, first, last, lines``: runs of at least ``least`` lines that look like a table's: bars, or two wide gaps."""
    rows = lines(df, id_col, text_col).where(F.col("line").contains("|") | F.col("line").rlike(r"\S\s{2,}\S.*\s{2,}\S"))
    w = Window.partitionBy(id_col).orderBy("no")
    runs = rows.withColumn("island", F.col("no") - F.row_number().over(w)).groupBy(id_col, "island")
    found = runs.agg(F.min("no").alias("first"), F.max("no").alias("last"), F.count(F.lit(1)).alias("lines"))
    return found.where(F.col("lines") >= least).drop("island")


def text_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``<id_col>, no, name, value``: what a text says as name and value: lines and parts of lines with one colon."""
    parts = F.split(F.col("line"), r"[;,]\s+")
    rows = lines(df, id_col, text_col).select(id_col, "no", F.posexplode(parts).alias("part", "p"))
    name, value = F.trim(F.regexp_extract("p", r"^\s*([^:|]{2,60}):\s*(\S[^:|]*)$", 1)), F.trim(F.regexp_extract("p", r"^\s*([^:|]{2,60}):\s*(\S[^:|]*)$", 2))
    return rows.select(id_col, "no", "part", name.alias("name"), value.alias("value")).where("name <> ''")


def table_kinds(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, kind``: ``nomenclature`` for tables with a column of product numbers, ``characteristics`` for those of values, else ``generic``."""
    low = fold(F.col("name"))
    found = cells.groupBy(*keys).agg(F.max(low.rlike(SKU_COLUMN)).alias("a"), F.max(low.rlike(CHARACTERISTIC)).alias("b"))
    return found.select(*keys, F.when(F.col("a"), "nomenclature").when(F.col("b"), "characteristics").otherwise("generic").alias("kind"))


def records(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, row_no, record``: each table row as a map of its filled cells, the last of a repeated name."""
    last = cells.where("value <> ''").groupBy(*keys, "row_no", "name").agg(F.max_by("value", "col").alias("value"))
    return last.groupBy(*keys, "row_no").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("record"))


def products_from_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, sku, name, row_no``: products of table rows with a product number, of each number the first row.

    The number is the first filled cell of a column of numbers, the name that of a column of names. A row that repeats
    its header is none.
    """
    low = fold(F.col("name"))
    pick = lambda p: F.min(F.when(low.rlike(p) & (F.trim("value") != "") & (fold(F.trim("value")) != F.trim(low)), F.struct("col", F.trim("value").alias("v"))))["v"]
    rows = cells.groupBy(*keys, "row_no").agg(pick(SKU_COLUMN).alias("sku"), pick(NAME_COLUMN).alias("name")).where(sku_key(F.col("sku")).isNotNull())
    w = Window.partitionBy(*keys, sku_key(F.col("sku"))).orderBy("row_no")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").select(*keys, "sku", "name", "row_no")


def products_from_text(df: DataFrame, id_col: str, text_col: str, pattern: str = r"\b([A-Z]{2}-[0-9]{2}-[0-9]{4})\b") -> DataFrame:
    """``<id_col>, sku, at``: the product numbers of a text, each once, with the place of its first mention among them."""
    found = df.select(id_col, F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), 1)).alias("at", "sku"))
    return found.groupBy(id_col, "sku").agg(F.min("at").alias("at"))


def merge_attributes(products: DataFrame, key: str, order: str) -> DataFrame:
    """``key, name, value``: the attributes (a map) of all records of a product, of each name the last filled value."""
    flat = products.where(F.col(key).isNotNull()).select(key, order, F.explode("attributes").alias("name", "value")).where("value is not null and trim(value) <> ''")
    return flat.groupBy(key, "name").agg(F.max_by("value", order).alias("value"))


def has_sku_row(record: Column, sku: Column) -> Column:
    """Whether a column of product numbers of a record has exactly this one."""
    return F.exists(F.map_entries(record), lambda e: fold(e["key"]).rlike(SKU_COLUMN) & (F.trim(e["value"]) == sku))


def tags(text: Column) -> Column:
    """The distinct values that a text gives after labels such as ``series`` or ``material``, in lower case."""
    found = F.regexp_extract_all(text, F.lit(r"(?iu)(?:серия|серии|материал корпуса|марка|series|body material|werkstoff|matériau)\s*[:—-]?\s*([\p{L}0-9-]{2,40})"), 1)
    return F.array_sort(F.array_distinct(F.transform(found, lambda v: F.lower(v))))


def same_header_tables(cells: DataFrame, keys: list[str], within: list[str]) -> DataFrame:
    """``within, header, tables, rows``: tables of the same columns within a document, as if they were one."""
    heads = cells.groupBy(*keys).agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("col", F.trim("name").alias("n")))), lambda s: s["n"]), "|")).alias("header"), F.countDistinct("row_no").alias("rows"))
    return heads.groupBy(*within, "header").agg(F.count(F.lit(1)).alias("tables"), F.sum("rows").alias("rows"))


_CAPTION = re.compile(r"^(?:#{1,6}\s+)?(Таблица|Продолжение\s+таблицы|Окончание\s+таблицы)\s+(\d+)\b(.*)$", re.IGNORECASE)
_DIVIDER = re.compile(r"^\|(?:\s*:?-{3,}:?\s*\|)+\s*$")
_PAGE = re.compile(r"^## Страница \d+$")


def joined_tables(text: str) -> tuple[str, int, int]:
    """A Markdown text with continued tables joined to their beginnings, and how many were and could not be joined.

    A continuation has a caption that says so, the number of a table before it, and that table's columns; its rows then
    follow the beginning's, and a note takes its caption's place. Prose between a caption and its table, or a heading
    between the parts, keeps them apart; headings of pages do not.
    """
    blocks = re.split(r"\n[ \t]*\n", text)
    begun: dict | None = None
    caption: tuple[int, str, bool] | None = None
    joined = failed = 0
    for i, block in enumerate(b.strip() for b in list(blocks)):
        m = _CAPTION.match(block) if "\n" not in block else None
        further = m is not None and not m[1].lower().startswith("таблица")
        if m and (not further or not m[3].strip(" .\t")):
            caption = (i, m[2], further)
            begun = begun if further else None
            continue
        rows = block.split("\n")
        if len(rows) > 2 and rows[0].startswith("|") and _DIVIDER.match(rows[1]) and all(r.startswith("|") for r in rows[2:]):
            head = " ".join(unicodedata.normalize("NFKC", rows[0]).split()).lower()
            if caption and caption[2] and begun and begun["number"] == caption[1] and begun["head"] == head:
                blocks[begun["at"]] += "\n" + "\n".join(rows[2:])
                blocks[i], blocks[caption[0]] = "", f"> Продолжение таблицы {caption[1]} объединено с её началом выше."
                joined += 1
            else:
                if caption and caption[2]:
                    failed += 1
                begun = {"number": caption[1], "head": head, "at": i} if caption else None
            caption = None
            continue
        if block and not _PAGE.match(block):
            caption = None
            if block.startswith("#"):
                begun = None
    return "\n\n".join(b for b in blocks if b.strip()).rstrip() + "\n", joined, failed


def merge_continued(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``<id_col>, text, joined, failed``: :func:`joined_tables` of every text that has a continued table; other texts are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [joined_tables(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32())))], [id_col, "text", "joined", "failed"])

    marked = df.where(fold(F.col(text_col)).rlike(r"(продолжение|окончание)\s+таблицы\s+[0-9]")).select(id_col, text_col)
    return marked.mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, text string, joined int, failed int")


def chunk_records(chunks: DataFrame, embed=None) -> DataFrame:
    """Chunks as they are stored: the kind of element made sound, tokens estimated, the vector of ``embed`` (a column function) where none is given."""
    vector = F.col("embedding") if embed is None else F.coalesce("embedding", embed(F.col("content")))
    kind = F.when(F.col("elementType").isin("text", "table", "figure", "list", "header"), F.col("elementType")).otherwise("text")
    return chunks.select("id", "documentId", "chunkIndex", kind.alias("elementType"), estimate_tokens(F.col("content")).alias("tokens"), vector.isNotNull().alias("has_vector"))


def region_chunks(regions: DataFrame, most: int = 1200) -> DataFrame:
    """``documentId, pageNumber, pack, kind, regions, chars``: a page's regions in reading order (``y, x``) packed to ``most`` characters, text and tables apart."""
    kind = F.when(F.col("regionType").contains("table"), "table").otherwise("text")
    rows = regions.where(F.coalesce(F.trim("extractedText"), F.lit("")) != "").select("id", "documentId", "pageNumber", kind.alias("kind"), "y", "x", F.length("extractedText").alias("n")).dropDuplicates(["id"])
    w = Window.partitionBy("documentId", "pageNumber", "kind").orderBy("y", "x", "id")
    rows = rows.withColumn("before", F.sum("n").over(w) - F.col("n")).withColumn("pack", F.floor(F.col("before") / most))
    return rows.groupBy("documentId", "pageNumber", "kind", "pack").agg(F.count(F.lit(1)).alias("regions"), F.sum("n").alias("chars"))


def item_chunks(regions: DataFrame) -> DataFrame:
    """``item, regions, chars, first_page, digest``: the regions of a product item as one chunk, tables after texts, pages in order; digests are gathered, not texts."""
    rows = regions.where(F.col("item").isNotNull() & (F.coalesce(F.trim("extractedText"), F.lit("")) != "")).dropDuplicates(["id"])
    order = F.struct(F.col("regionType").contains("table").alias("t"), "pageNumber", "id", F.md5("extractedText").alias("d"))
    parts = F.transform(F.sort_array(F.collect_list(order)), lambda s: s["d"])
    return rows.groupBy("item").agg(F.count(F.lit(1)).alias("regions"), F.sum(F.length("extractedText")).alias("chars"), F.min("pageNumber").alias("first_page"), F.md5(F.array_join(parts, "")).alias("digest"))


def faq_pairs(regions: DataFrame) -> DataFrame:
    """``documentId, question, answer``: each question's region with the answer's that follows it in its document, before the next question."""
    rows = regions.where("regionType in ('faq_question', 'faq_answer')").select("id", "documentId", "pageNumber", "regionType").dropDuplicates(["id"])
    w = Window.partitionBy("documentId").orderBy("pageNumber", "id")
    rows = rows.withColumns({"next": F.lead("id").over(w), "next_type": F.lead("regionType").over(w)})
    return rows.where("regionType = 'faq_question' and next_type = 'faq_answer'").select("documentId", F.col("id").alias("question"), F.col("next").alias("answer"))


def section_chunk_set(chunks: DataFrame, cells: DataFrame) -> DataFrame:
    """``documentId, kind, n``: how many chunks the section chunker makes: one a section, one a row with a product number, one a characteristic."""
    sections = chunks.select("documentId", F.coalesce("sectionPath", F.lit("")).alias("s")).distinct().groupBy("documentId").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("section"))
    low = fold(F.col("name"))
    sku = cells.where(low.rlike(SKU_COLUMN) & (F.trim("value") != "")).select("documentId", "table_no", "row_no").distinct().groupBy("documentId").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("sku"))
    char = cells.where(low.rlike(CHARACTERISTIC) & (F.trim("value") != "")).select("documentId", "table_no", "row_no").distinct().groupBy("documentId").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("characteristic"))
    return sections.unionByName(sku).unionByName(char).select("documentId", "kind", "n")


def assembled(chunks: DataFrame, separator: str = "\n\n---\n\n") -> DataFrame:
    """``documentId, sections, chars``: how long a document's file is that is put together from its sections with separators."""
    rows = chunks.where("content is not null").select("id", "documentId", "sectionPath", F.length("content").alias("n")).dropDuplicates(["id"])
    per = rows.groupBy("documentId", "sectionPath").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    size = F.sum(F.col("n") + (F.col("k") - 1) * 2) + (F.count(F.lit(1)) - 1) * len(separator)
    return per.groupBy("documentId").agg(F.count(F.lit(1)).alias("sections"), size.cast("bigint").alias("chars"))
