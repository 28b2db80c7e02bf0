"""Plain text read as tables and lists, tables compared, pruned and looked for near a chunk, and what sources an answer names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvasir.functions.text import fold, models, raw_tokens, section_name, sku_key, stem
from kvasir.operators.resolve import title_match_counts

PAIR = r"^([^:–—-]+?)\s*[:–—-]\s*(.+)$"
BULLET = r"(?:[0-9]+[.)]|[-*•●◦○■▪□◼◻◆♦◾]+)\s+"
NEAR = (1, -1, 2, -2)  # places in which a chunk's table is looked for, in this order


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n+"), lambda x: F.trim(x)), lambda x: x != "")


def _row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def _rule(n: Column) -> Column:
    return F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), n))


def numbered(names: Column) -> Column:
    """Names each once: a repeated one is numbered from 2."""
    before = lambda x, i: F.size(F.filter(F.slice(names, 1, i), lambda y: y == x))
    return F.transform(names, lambda x, i: F.when((i > 0) & (before(x, i) > 0), F.concat(x, F.lit(" "), before(x, i) + 1)).otherwise(x))


def column_table(text: Column, force: bool = False) -> Column:
    """A block of lines with wide gaps as a Markdown table; null if it isn't one.

    At least two columns, in three lines and three quarters of all; the first line is the header. Of two columns that are
    all name and value, the header is said to be so.
    """
    ls = _lines(text)
    cells = lambda x: F.filter(F.transform(F.split(x, r"\s{2,}|\t+"), lambda c: F.trim(c)), lambda c: c != "")
    counts = F.transform(ls, lambda x: F.size(cells(x)))
    most = F.array_max(counts)
    many = F.size(F.filter(counts, lambda n: n >= 2))
    enough = F.lit(force) | (many >= F.greatest(F.lit(3), F.floor(F.size(ls) * 0.75)))
    pairs = (most == 2) & F.forall(ls, lambda x: x.rlike(PAIR))
    padded = lambda x: F.slice(F.concat(cells(x), F.array_repeat(F.lit(""), most)), F.lit(1), most)
    own = F.when(pairs, F.array(F.lit("Параметр"), F.lit("Значение"))).otherwise(padded(F.get(ls, 0)))
    head = numbered(F.transform(own, lambda x: F.when(x == "", "Колонка").otherwise(x)))
    body = F.when(pairs, F.transform(ls, lambda x: _row(F.array(F.trim(F.regexp_extract(x, PAIR, 1)), F.trim(F.regexp_extract(x, PAIR, 2)))))).otherwise(
        F.transform(F.slice(ls, F.lit(2), F.greatest(F.size(ls) - 1, F.lit(0))), lambda x: _row(padded(x)))
    )
    table = F.concat_ws("\n", _row(head), _rule(most), F.array_join(body, "\n"))
    return F.when((F.size(ls) >= 2) & (most >= 2) & enough, table)


def pair_table(text: Column, force: bool = False) -> Column:
    """A block of names and values as a Markdown table of two columns; null if it isn't one.

    At least three pairs, two fifths of them with a figure, and names and values short on average; other lines are left out.
    """
    ls = F.filter(_lines(text), lambda x: x.rlike(PAIR))
    key, value = (lambda x: F.trim(F.regexp_extract(x, PAIR, 1))), (lambda x: F.trim(F.regexp_extract(x, PAIR, 2)))
    n = F.size(ls)
    some = F.greatest(n, F.lit(1))
    mean = lambda of: F.aggregate(F.transform(ls, lambda x: F.length(of(x))), F.lit(0), lambda s, x: s + x) / some
    figures = F.size(F.filter(ls, lambda x: value(x).rlike("[0-9%°]"))) / some
    sound = F.lit(force) | ((figures >= 0.4) & (mean(key) <= 35) & (mean(value) <= 90))
    rows = F.array_join(F.transform(ls, lambda x: _row(F.array(key(x), value(x)))), "\n")
    return F.when((n >= 3) & sound, F.concat(F.lit("| Параметр | Значение |\n| --- | --- |\n"), rows))


def bullet_list(text: Column, force: bool = False) -> Column:
    """A block of bullets as a Markdown list, lines without one joined to the item before; null if it isn't a list."""
    ls = _lines(text)
    n = F.size(F.filter(ls, lambda x: x.rlike("^" + BULLET)))
    enough = F.lit(force) | ((n >= 2) & ((n >= F.floor(F.size(ls) * 0.3)) | (n >= 4)))
    items = F.split(F.regexp_replace(F.array_join(ls, "\n"), rf"\n(?!{BULLET})", " "), "\n")
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "^" + BULLET, ""), r"\s+", " "))
    mark = lambda x: F.when(x.rlike(r"^[0-9]+[.)]\s"), F.concat(F.regexp_extract(x, "^([0-9]+)", 1), F.lit(". "))).otherwise("- ")
    kept = F.filter(items, lambda x: plain(x) != "")
    return F.when((F.size(ls) > 0) & enough, F.array_join(F.transform(kept, lambda x: F.concat(mark(x), plain(x))), "\n"))


def formatted(text: Column) -> Column:
    """A chunk's blocks, each as a table, a list or a paragraph, whichever it is."""
    blocks = F.filter(F.split(text, r"\n{2,}"), lambda b: F.trim(b) != "")
    return F.array_join(F.transform(blocks, lambda b: F.coalesce(column_table(b), pair_table(b), bullet_list(b), F.trim(b))), "\n\n")


def table_print(markdown: Column) -> Column:
    """A table's text without its bars and rules, in one spacing and letter case."""
    bare = F.regexp_replace(F.regexp_replace(fold(markdown), r"\|\s*-+\s*", "|"), r"\|", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def shows_table(response: Column, markdown: Column) -> Column:
    """Whether a response has a table already: its text, or three quarters of its header's cells and two of its first row's."""
    rows = F.filter(F.transform(F.split(markdown, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^\|") & ~x.rlike(r"^\|\s*-+"))
    cells = lambda i: F.filter(F.transform(F.split(F.get(rows, i), r"\|"), lambda c: fold(F.trim(c))), lambda c: c != "")
    low = fold(response)
    held = lambda a: F.size(F.filter(a, lambda c: (F.length(c) >= 3) & F.contains(low, c)))
    head, body = cells(0), F.filter(cells(1), lambda c: F.length(c) >= 3)
    by_cells = (F.size(head) >= 2) & (held(head) >= F.ceil(F.size(head) * 0.75)) & F.coalesce(held(body) >= F.least(F.lit(2), F.size(body)), F.lit(True))
    whole = F.contains(table_print(response), table_print(markdown))
    return F.when(F.length(table_print(markdown)) < 24, F.contains(response, F.trim(markdown))).otherwise(whole | F.coalesce(by_cells, F.lit(False)))


def pruned_columns(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The cells (``col, name, value``) of tables without columns whose name holds a place and that have at most one filled cell.

    A name holds a place if it is empty, a number, "column", or up to two signs without a letter. If no column would be
    left, the first three stay.
    """
    name = F.trim("name")
    place = (name == "") | fold(name).rlike("^(колон|column)") | name.rlike(r"^[0-9]+$") | ((F.length(name) <= 2) & ~name.rlike("[A-Za-zА-Яа-яЁё]"))
    each = cells.groupBy(*keys, "col").agg((~F.max(place) | (F.sum(F.when(F.trim("value") != "", 1).otherwise(0)) > 1)).alias("keep"))
    each = each.withColumn("any", F.max("keep").over(Window.partitionBy(*keys)))
    kept = each.where(F.col("keep") | (~F.col("any") & (F.col("col") < 3))).select(*keys, "col")
    return cells.join(kept, [*keys, "col"], "left_semi")


def merged_tables(cells: DataFrame, keys: list[str], within: list[str]) -> DataFrame:
    """``within, tables, rows``: the tables of a document as one, if all have the same columns; documents whose tables differ are left out."""
    heads = cells.select(*keys, "col", F.trim("name").alias("n")).distinct().groupBy(*keys).agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", "n"))), lambda s: s["n"]), "|")).alias("h"))
    rows = cells.select(*keys, "row_no").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    both = heads.join(rows, keys).groupBy(*within).agg(F.countDistinct("h").alias("kinds"), F.count(F.lit(1)).alias("tables"), F.sum("rows").alias("rows"))
    return both.where("kinds = 1").drop("kinds")


def matrix_markdown(rows: Column) -> Column:
    """A matrix of cells as a Markdown table, short rows filled up; null for an empty one."""
    wide = F.array_max(F.transform(rows, lambda r: F.size(r)))
    lines = F.transform(rows, lambda r: _row(F.transform(F.slice(F.concat(r, F.array_repeat(F.lit(""), wide)), F.lit(1), wide), lambda c: F.regexp_replace(F.coalesce(F.trim(c), F.lit("")), r"\|", r"\\|"))))
    return F.when(wide > 0, F.concat_ws("\n", F.get(lines, 0), _rule(wide), F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), "\n")))


def nearest_tables(chunks: DataFrame) -> DataFrame:
    """``id, table_id, way``: the chunk whose table belongs to each chunk (``id, documentId, sectionPath, chunkIndex, has_table``).

    Its own (``own``), else the first of its section (``section``), else that of a chunk up to two places away, the next
    before the last (``near``). Chunks meet by document and place.
    """
    rows = chunks.select("id", "documentId", "sectionPath", "chunkIndex", "has_table").dropDuplicates(["id"])
    with_table = rows.where("has_table")
    own = with_table.select("id", F.col("id").alias("table_id"), F.lit(0).alias("p"))
    first = with_table.where("sectionPath is not null").groupBy("documentId", "sectionPath").agg(F.min(F.struct("chunkIndex", "id"))["id"].alias("table_id"))
    section = rows.join(first, ["documentId", "sectionPath"]).select("id", "table_id", F.lit(1).alias("p"))
    steps = F.explode(F.array(*(F.struct(F.lit(i + 2).alias("p"), F.lit(s).alias("s")) for i, s in enumerate(NEAR)))).alias("o")
    asked = rows.select("id", "documentId", "chunkIndex", steps).select("id", "documentId", (F.col("chunkIndex") + F.col("o.s")).alias("chunkIndex"), "o.p")
    at = with_table.groupBy("documentId", "chunkIndex").agg(F.min("id").alias("table_id"))
    near = asked.join(at, ["documentId", "chunkIndex"]).select("id", "table_id", "p")
    best = own.unionByName(section).unionByName(near).groupBy("id").agg(F.min(F.struct("p", "table_id")).alias("b"))
    way = F.when(F.col("b.p") == 0, "own").when(F.col("b.p") == 1, "section").otherwise("near")
    return best.select("id", "b.table_id", way.alias("way"))


def answer_sources(hits: DataFrame, most: int = 200) -> DataFrame:
    """``query_id, id, label, snippet``: how each hit is named as a source (``filename, sectionPath, pageNumber, content``), and the beginning of its text."""
    label = F.concat_ws(" — ", F.col("filename"), F.concat(F.lit("раздел "), "sectionPath"), F.concat(F.lit("стр. "), F.col("pageNumber").cast("string")))
    text = F.trim(F.regexp_replace("content", r"\s+", " "))
    return hits.select("query_id", "id", label.alias("label"), F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text).alias("snippet"))


def sku_cascade(asked: DataFrame, products: DataFrame, documents: DataFrame) -> DataFrame:
    """``sku, status, way, documents``: what product numbers (``sku``) lead to.

    A number in full in a document's title resolves it (``sku``). Else the names of its products' groups (``sku,
    group_name``) count: none is ``unknown``, several different ones ``ambiguous``, and of one the documents whose title
    has enough of its stems (``group``).
    """
    own = asked.where("sku is not null").select(F.upper("sku").alias("sku")).distinct()
    coded = documents.select("doc_id", F.explode(models(F.col("title"))).alias("sku"))
    exact = own.join(coded, "sku").groupBy("sku").agg(F.countDistinct("doc_id").alias("exact"))
    named = products.where("group_name is not null").select(sku_key(F.col("sku")).alias("key"), section_name(F.col("group_name")).alias("name")).where("name is not null")
    groups = own.withColumn("key", sku_key(F.col("sku"))).join(named, "key").groupBy("sku").agg(F.countDistinct(fold(F.col("name"))).alias("groups"), F.min("name").alias("name"))
    single = groups.where("groups = 1").select(F.col("sku").alias("id"), "name")
    matched = title_match_counts(single, documents).withColumnRenamed("id", "sku")
    both = own.join(exact, "sku", "left").join(groups.drop("name"), "sku", "left").join(matched, "sku", "left")
    status = F.when(F.col("exact").isNotNull(), "resolved").when(F.col("groups").isNull(), "unknown").when(F.col("groups") > 1, "ambiguous").otherwise("resolved")
    way = F.when(F.col("exact").isNotNull(), "sku").when(F.col("groups") == 1, "group")
    return both.select("sku", status.alias("status"), way.alias("way"), F.coalesce(F.col("exact"), F.when(F.col("groups") == 1, F.coalesce("matched", F.lit(0))), F.lit(0)).alias("documents"))


def hash_embedding(text: Column, size: int = 64) -> Column:
    """A text's stems counted in ``size`` hashed places, scaled to length one; null for a text without stems. A stand-in where no model is at hand."""
    places = F.transform(raw_tokens(text), lambda w: F.pmod(F.xxhash64(stem(w)), F.lit(size)).cast("int"))
    none = F.array_repeat(F.lit(0.0), size)
    unit = lambda v: F.transform(v, lambda x: F.try_divide(x, F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y))))
    made = F.aggregate(places, none, lambda acc, p: F.transform(acc, lambda x, i: F.when(i == p, x + 1).otherwise(x)), unit)
    return F.get(F.filter(F.array(made), lambda v: F.exists(v, lambda x: x > 0)), 0)


def with_vectors(df: DataFrame, text_col: str, vec_col: str, embed) -> DataFrame:
    """``df`` with the vectors of ``embed``, a function of a column, written anew for all rows."""
    return df.withColumn(vec_col, embed(F.col(text_col)))
