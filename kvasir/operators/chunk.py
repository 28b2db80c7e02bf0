"""Splitting texts into paragraphs, windows, packs, sections and table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvasir.functions.text import estimate_tokens

SENTENCES = r"(?<=[.!?])\s+"
SLICE = 1000  # places of a section that are gathered together
HEADING = r"^(#{1,6})\s+(.+)$"


def _filled(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def _one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def paragraphs(df: DataFrame, id_col: str, text_col: str, size: int = 4) -> DataFrame:
    """``<id_col>, pos, paragraph``: the blocks between blank lines or, if there is one block, groups of ``size`` sentences.

    Positions count from 0. A text of up to three sentences is one paragraph; null and empty texts have none.
    """
    text = F.col(text_col)
    blocks, sentences = _filled(F.split(text, r"\n{2,}")), _filled(F.split(text, SENTENCES))
    groups = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(sentences) - 1, F.lit(0)), F.lit(size)),
        lambda i: _one_line(F.array_join(F.slice(sentences, i + 1, size), " ")),
    )
    parts = F.when(F.size(blocks) > 1, blocks).when(F.size(sentences) <= 3, F.array(_one_line(text))).otherwise(groups)
    return df.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(parts).alias("pos", "paragraph")).where("paragraph <> ''")


def word_windows(df: DataFrame, id_col: str, text_col: str, size: int = 1000, step: int = 800) -> DataFrame:
    """``<id_col>, pos, n_words, window``: windows of ``size`` words every ``step`` words, the last ones shorter."""
    words = F.filter(F.split(F.col(text_col), r"\s+"), lambda w: w != "")
    rows = df.where(F.col(text_col).isNotNull()).select(id_col, words.alias("words")).where(F.size("words") > 0)
    starts = F.posexplode(F.sequence(F.lit(0), F.size("words") - 1, F.lit(step))).alias("pos", "start")
    rows = rows.select(id_col, "words", starts).withColumn("own", F.slice("words", F.col("start") + 1, size))
    return rows.select(id_col, "pos", F.size("own").alias("n_words"), F.array_join("own", " ").alias("window"))


def pack_paragraphs(df: DataFrame, id_col: str, text_col: str, most: int = 1200) -> DataFrame:
    """``<id_col>, pos, pack``: consecutive paragraphs joined by blank lines while they fit ``most`` characters."""
    parts = _filled(F.split(F.col(text_col), r"\n+"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, part: Column) -> Column:
        fits = F.length(acc["open"]) + 2 + F.length(part) <= most
        return F.when(acc["open"] == "", F.struct(acc["done"].alias("done"), part.alias("open"))).when(
            fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit("\n\n"), part).alias("open"))
        ).otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), part.alias("open")))

    packs = F.aggregate(parts, start, add, lambda acc: F.filter(F.concat(acc["done"], F.array(acc["open"])), lambda p: p != ""))
    return df.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(packs).alias("pos", "pack"))


def lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``<id_col>, no, line``: the lines of each text, numbered from 0."""
    return df.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("no", "line"))


def headings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``<id_col>, no, level, title, path``: the Markdown headings with their hierarchical numbers, outside fenced blocks.

    A level counts on within its parent; skipped levels count as 1. All steps are local to a text.
    """
    rows = lines(df, id_col, text_col)
    w = Window.partitionBy(id_col).orderBy("no")
    fenced = F.sum(F.when(F.col("line").rlike(r"^\s*```"), 1).otherwise(0)).over(w) % 2 == 1
    rows = rows.withColumn("fenced", fenced).where(~F.col("fenced") & F.col("line").rlike(HEADING))
    level = F.length(F.regexp_extract("line", HEADING, 1))
    rows = rows.select(id_col, "no", level.alias("level"), F.trim(F.regexp_extract("line", HEADING, 2)).alias("title"))
    heads = rows.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("no", "level", "title"))).alias("all"))

    def number(acc: Column, h: Column) -> Column:
        count = F.transform(F.sequence(F.lit(1), h["level"]), lambda i: F.when(i < h["level"], F.greatest(F.coalesce(F.get(acc["count"], i - 1), F.lit(1)), F.lit(1))).otherwise(F.coalesce(F.get(acc["count"], i - 1), F.lit(0)) + 1))
        item = F.struct(h["no"].alias("no"), h["level"].alias("level"), h["title"].alias("title"), F.array_join(count, ".").alias("path"))
        return F.struct(count.alias("count"), F.concat(acc["done"], F.array(item)).alias("done"))

    start = F.struct(F.array().cast("array<int>").alias("count"), F.array().cast("array<struct<no:int,level:int,title:string,path:string>>").alias("done"))
    numbered = F.aggregate("all", start, number, lambda acc: acc["done"])
    return heads.select(id_col, F.explode(numbered).alias("h")).select(id_col, "h.*")


def pipe_tables(df: DataFrame, id_col: str, text_col: str, *further: str) -> DataFrame:
    """``<id_col>, table_no, row_no, <further>, name, value`` (further may be ``col``, from 0): the cells of Markdown tables, named by their header.

    A table is a run of lines that begin and end with a bar and whose second line is a divider. Runs are found as islands
    of consecutive lines; empty header cells are named by their column number, further cells than headers are left out.
    """
    rows = lines(df, id_col, text_col).withColumn("line", F.trim("line")).where(F.col("line").rlike(r"^\|.*\|$"))
    w = Window.partitionBy(id_col).orderBy("no")
    rows = rows.withColumn("island", F.col("no") - F.row_number().over(w))
    run = Window.partitionBy(id_col, "island").orderBy("no")
    rows = rows.withColumns({"at": F.row_number().over(run), "second": F.lead("line").over(run)})
    rows = rows.withColumns({"head": F.first("line").over(run), "divider": F.first("second").over(run)})
    rows = rows.where(F.col("divider").rlike(r"^\|(\s*:?-+:?\s*\|)+$") & (F.col("at") > 2))

    def cells(line: str) -> Column:
        inner = F.regexp_replace(F.col(line), r"^\||\|$", "")
        return F.transform(F.split(inner, r"(?<!\\)\|"), lambda x: F.trim(x))

    pairs = F.posexplode(F.arrays_zip(cells("head").alias("n"), cells("line").alias("v"))).alias("col", "cell")
    rows = rows.select(id_col, F.dense_rank().over(Window.partitionBy(id_col).orderBy("island")).alias("table_no"), (F.col("at") - 2).alias("row_no"), pairs)
    name = F.when(F.col("cell.n") == "", F.concat(F.lit("column "), F.col("col") + 1)).otherwise(F.col("cell.n"))
    return rows.where("cell.n is not null").select(id_col, "table_no", "row_no", *further, name.alias("name"), F.coalesce("cell.v", F.lit("")).alias("value"))


def element_type(text: Column) -> Column:
    """``list``, ``table``, ``header`` or ``text``, by bullets, bars, repeated columns and letter case."""
    rows = F.filter(F.split(text, r"\n+"), lambda x: F.trim(x) != "")
    spaced = F.size(F.filter(rows, lambda x: F.trim(x).rlike(r"\S\s{2,}\S")))
    numbers = F.size(F.filter(rows, lambda x: F.trim(x).rlike(r"^[0-9]+(\s+[0-9]+(/[0-9]+)?)+")))
    pairs = F.size(F.filter(rows, lambda x: F.trim(x).rlike(r"^[\p{L}][\p{L}\s-]*\s*[:–—]\s*[0-9].*$")))
    many = F.size(rows) >= 2
    is_table = text.contains("|") | text.rlike(r"[0-9]+\s+[x×]\s*[0-9]") | (many & ((spaced >= 2) | (numbers >= 1) | (pairs >= 2)))
    is_header = (F.length(text) < 80) & (text == F.upper(text))
    return F.when(text.rlike(r"(?m)^\s*[•*–-]\s+\S"), "list").when(is_table, "table").when(is_header, "header").otherwise("text")


def section_chunks(chunks: DataFrame) -> DataFrame:
    """``documentId, sectionPath, n, tokens, first_index, last_index, digest``: each section's chunks as one.

    Chunks delivered twice count once. ``digest`` is of the chunks' digests in the order of their index, then id, a
    thousand places at a time: no section's texts are gathered, and of a hot one no more than a slice's digests.
    """
    rows = chunks.where("content is not null").select("id", "documentId", "sectionPath", "chunkIndex", estimate_tokens(F.col("content")).alias("tokens"), F.md5("content").alias("d"))
    rows = rows.dropDuplicates(["id"]).withColumn("slice", F.coalesce(F.floor(F.col("chunkIndex") / SLICE), F.lit(-1)))
    digest = lambda *order: F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, "d"))), lambda p: p["d"]), ""))
    slices = rows.groupBy("documentId", "sectionPath", "slice").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"), F.min("chunkIndex").alias("first_index"), F.max("chunkIndex").alias("last_index"), digest("chunkIndex", "id").alias("d"),
    )
    return slices.groupBy("documentId", "sectionPath").agg(
        F.sum("n").alias("n"), F.sum("tokens").cast("bigint").alias("tokens"), F.min("first_index").alias("first_index"), F.max("last_index").alias("last_index"), digest("slice").alias("digest"),
    )


def pack_tokens(df: DataFrame, id_col: str, text_col: str, *, most: int = 1500, overlap: int = 300, least_chars: int = 32) -> DataFrame:
    """``<id_col>, pos, tokens, chunk``: lines packed to ``most`` estimated tokens, each pack led by the last lines of the one before.

    The overlap is as many whole last lines as reach ``overlap`` tokens. Lines under ``least_chars`` characters are
    skipped; a longer line than ``most`` is a pack of its own. One fold over a text's lines, inside the JVM.
    """
    size = estimate_tokens
    parts = F.filter(F.transform(F.split(F.col(text_col), "\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= least_chars)
    kind = "struct<done:array<array<string>>,open:array<string>,n:bigint,fresh:boolean>"
    start = F.struct(
        F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).cast("bigint").alias("n"), F.lit(False).alias("fresh")
    ).cast(kind)

    def tokens_of(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + size(x))

    def tail(a: Column) -> Column:
        back = F.aggregate(
            F.reverse(a),
            F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).cast("bigint").alias("n")),
            lambda s, x: F.when(s["n"] >= overlap, s).otherwise(F.struct(F.concat(F.array(x), s["kept"]).alias("kept"), (s["n"] + size(x)).alias("n"))),
        )
        return F.when(F.size(back["kept"]) < F.size(a), back["kept"]).otherwise(F.array().cast("array<string>"))

    def add(acc: Column, x: Column) -> Column:
        grown = F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.array(x)).alias("open"), (acc["n"] + size(x)).alias("n"), F.lit(True).alias("fresh"))
        rest = F.concat(tail(acc["open"]), F.array(x))
        closed = F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), rest.alias("open"), tokens_of(rest).alias("n"), F.lit(True).alias("fresh"))
        return F.when((acc["n"] > 0) & (acc["n"] + size(x) > most), closed).otherwise(grown).cast(kind)

    packs = F.aggregate(parts, start, add, lambda a: F.when(a["fresh"], F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]))
    rows = df.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(packs).alias("pos", "parts"))
    text = F.array_join("parts", "\n")
    return rows.select(id_col, "pos", F.aggregate("parts", F.lit(0).cast("bigint"), lambda s, x: s + size(x)).alias("tokens"), text.alias("chunk"))
