"""Queries of what is made of parsed texts, regions and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvasir.functions import text as T
from kvasir.operators import chunk
from kvasir.operators import ingest as N
from kvasir.plans import answer
from kvasir.sources.tables import table


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _cells(spark, d):
    return chunk.pipe_tables(_docs(spark, d), "doc_id", "text", "col")


def _regions(spark, d):
    box = F.from_json("coordinates", "bbox struct<x:double,y:double>")["bbox"]
    return table(spark, d, "manual_regions").select("id", "documentId", "pageNumber", "regionType", "extractedText", "productGroupId", box.alias("b")).select("*", "b.x", "b.y").drop("b")


def numbered_headings(spark, d):
    """Sections' paths and titles as lines, those that read as numbered headings."""
    rows = table(spark, d, "sections").select("id", F.concat("sectionPath", F.lit(". "), "title").alias("text")).distinct()
    return N.numbered_headings(rows, "id", "text").select("id", "path", "title")


def sections_by_titles(spark, d):
    heads = chunk.headings(_docs(spark, d), "doc_id", "text").select("doc_id", "no", "title")
    return N.sections_by_titles(_docs(spark, d), "doc_id", "text", heads)


def table_blocks(spark, d):
    return N.table_blocks(_docs(spark, d), "doc_id", "text")


def text_pairs(spark, d):
    rows = N.text_pairs(_docs(spark, d), "doc_id", "text")
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def table_kinds(spark, d):
    return N.table_kinds(_cells(spark, d), ["doc_id", "table_no"])


def table_records(spark, d):
    rows = N.records(_cells(spark, d), ["doc_id", "table_no"])
    return rows.select("doc_id", "table_no", "row_no", F.size("record").alias("cells"), F.get(F.map_keys("record"), 0).alias("first_name"))


def products_from_rows(spark, d):
    """Products of table rows, numbers standing under DN for want of another column."""
    cells = _cells(spark, d).withColumn("name", F.when(F.col("name") == "DN", "Артикул").otherwise(F.col("name")))
    return N.products_from_rows(cells, ["doc_id", "table_no"]).select("doc_id", "table_no", "sku", "row_no")


def products_from_text(spark, d):
    return N.products_from_text(_docs(spark, d), "doc_id", "text")


def merged_attributes(spark, d):
    rows = table(spark, d, "products").select("id", T.sku_key(F.col("sku")).alias("sku"), F.from_json("attributes", "map<string,string>").alias("attributes")).dropDuplicates(["id"])
    return N.merge_attributes(rows, "sku", "id")


def text_tags(spark, d):
    rows = _docs(spark, d).select(F.explode(N.tags(F.col("text"))).alias("tag"))
    return rows.groupBy("tag").agg(F.count(F.lit(1)).alias("documents"))


def same_header_tables(spark, d):
    return N.same_header_tables(_cells(spark, d), ["doc_id", "table_no"], ["doc_id"])


def chunk_records(spark, d):
    rows = N.chunk_records(table(spark, d, "document_chunks").where("content is not null")).dropDuplicates(["id"])
    return rows.groupBy("elementType", "has_vector").agg(F.count(F.lit(1)).alias("chunks"), F.sum("tokens").alias("tokens"))


def region_chunks(spark, d):
    return N.region_chunks(_regions(spark, d).where("documentId is not null and pageNumber is not null"), 100)


def item_chunks(spark, d):
    return N.item_chunks(_regions(spark, d).withColumn("item", F.col("productGroupId")))


def faq_pairs(spark, d):
    return N.faq_pairs(_regions(spark, d))


def section_chunk_set(spark, d):
    cells = _cells(spark, d).withColumnRenamed("doc_id", "documentId").withColumn("name", F.when(F.col("name") == "DN", "Артикул").when(F.col("name") == "kg", "Значение").otherwise(F.col("name")))
    return N.section_chunk_set(table(spark, d, "document_chunks"), cells)


def assembled_files(spark, d):
    return N.assembled(table(spark, d, "document_chunks"))


QUERIES = {
    f.__name__: f
    for f in (
        numbered_headings, sections_by_titles, table_blocks, text_pairs, table_kinds, table_records, products_from_rows, products_from_text, merged_attributes, text_tags, same_header_tables,
        chunk_records, region_chunks, item_chunks, faq_pairs, section_chunk_set, assembled_files,
    )
}

_C = answer._CELLS
_L = "with l as (select doc_id, unnest(ls) line, unnest(range(len(ls))) \"no\" from (select doc_id, string_split(text, chr(10)) ls from documents where text is not null)) "
_R = """r as (select distinct on (id) id, documentId, pageNumber, regionType, extractedText, productGroupId, json_extract(c, '$.bbox.x')::double x, json_extract(c, '$.bbox.y')::double y
    from (select *, case when json_valid(coordinates) then coordinates::json end c from manual_regions))"""
_SKU = N.SKU_COLUMN
ORACLES = {
    "sections_by_titles": r"""with l as (select doc_id, unnest(ls) line, unnest(range(len(ls))) k from (select doc_id, string_split(text, chr(10)) ls from documents where text is not null)),
        f as (select *, sum(case when regexp_matches(line, '^\s*```') then 1 else 0 end) over (partition by doc_id order by k) % 2 = 1 fenced from l),
        s as (select *, sum(case when not fenced and regexp_matches(line, '^#{1,6}\s+.+$') then 1 else 0 end) over (partition by doc_id order by k) "section" from f)
        select doc_id, "section"::bigint "section", count(*) "lines", sum(length(line))::bigint chars from s group by all""",
    "numbered_headings": r"""with s as (select distinct id, sectionPath || '. ' || title l from sections), h as (select id, regexp_extract(l, '^\s*([0-9]{1,2}(?:\.[0-9]{1,2}){0,3})\.?\s+(\p{L}.{1,118})$', 1) path,
        trim(regexp_extract(l, '^\s*([0-9]{1,2}(?:\.[0-9]{1,2}){0,3})\.?\s+(\p{L}.{1,118})$', 2), ' ') title from s)
        select * from h where path <> '' and not regexp_matches(title, '[.!?;,]\s*$') and not regexp_matches(title, '[A-Z]{2}-[0-9]{2}-[0-9]{4}') and not regexp_matches(lower(title), '^(мм|см|м|кг|г|л|бар|шт|вт|mm|cm|m|kg|g|l|bar|pcs|w|nm)([^\p{L}\p{N}_]|$)')""",
    "table_blocks": _L + r""", t as (select *, "no" - row_number() over (partition by doc_id order by "no") isl from l where contains(line, '|') or regexp_matches(line, '\S\s{2,}\S.*\s{2,}\S'))
        select doc_id, min("no") "first", max("no") "last", count(*) "lines" from t group by doc_id, isl having count(*) >= 2""",
    "text_pairs": _L + r""", p as (select unnest(regexp_split_to_array(line, '[;,][ \t\n\x0B\f\r]+')) p from l), m as (select trim(regexp_extract(p, '^\s*([^:|]{2,60}):\s*(\S[^:|]*)$', 1), ' ') "name" from p)
        select "name", count(*) n from m where "name" <> '' group by 1""",
    "table_kinds": _C + f"""select doc_id, table_no, case when bool_or(regexp_matches(replace(lower("name"), 'ё', 'е'), '{_SKU}')) then 'nomenclature' when bool_or(regexp_matches(replace(lower("name"), 'ё', 'е'), '{N.CHARACTERISTIC}')) then 'characteristics' else 'generic' end kind from named group by all""",
    "table_records": _C + """select doc_id, table_no, row_no, count(distinct "name") cells, min("name") first_name from named where "value" <> '' group by all""",
    "products_from_rows": _C + r"""select doc_id, table_no, trim("value") sku, min(row_no) row_no from named where "name" = 'DN' and regexp_matches("value", '[\p{L}\p{N}]') group by all""",
    "products_from_text": r"""with t as (select doc_id, regexp_extract_all(text, '\b([A-Z]{2}-[0-9]{2}-[0-9]{4})\b', 1) s from documents where text is not null), u as (select doc_id, unnest(s) sku, unnest(range(len(s))) at_ from t)
        select doc_id, sku, min(at_) "at" from u group by all""",
    "merged_attributes": r"""with p as (select distinct id, nullif(regexp_replace(upper(sku), '[^\p{L}\p{N}]', '', 'g'), '') sku, attributes a from products), j as (select id, sku, unnest(json_keys(a)) k, a from p where sku is not null and json_valid(a) and json_type(a) = 'OBJECT'),
        v as (select id, sku, k "name", json_extract_string(a, '$."' || k || '"') "value" from j) select sku, "name", arg_max("value", id) "value" from v where trim("value") <> '' group by all""",
    "text_tags": r"""with t as (select unnest(list_distinct(list_transform(regexp_extract_all(text, '(?i)(?:серия|серии|материал корпуса|марка|series|body material|werkstoff|matériau)\s*[:—-]?\s*([\p{L}0-9-]{2,40})', 1), lambda v: lower(v)))) tag from documents)
        select tag, count(*) documents from t group by 1""",
    "same_header_tables": _C + """, h as (select doc_id, table_no, md5(array_to_string(list_transform(list_sort(list(distinct {'c': col, 'n': trim("name")})), lambda s: s.n), '|')) "header", count(distinct row_no) rows_ from named group by all)
        select doc_id, "header", count(*) "tables", sum(rows_)::bigint "rows" from h group by all""",
    "chunk_records": """with c as (select distinct on (id) elementType e, embedding is not null v, content from document_chunks where content is not null)
        select case when e in ('text', 'table', 'figure', 'list', 'header') then e else 'text' end elementType, v has_vector, count(*) chunks, sum(greatest(1, ceil(length(content) / 4)))::bigint tokens from c group by all""",
    "region_chunks": f"""with {_R}, k as (select *, case when contains(regionType, 'table') then 'table' else 'text' end kind, length(extractedText) n from r where documentId is not null and pageNumber is not null and trim(extractedText, ' ') <> ''),
        b as (select *, ((sum(n) over (partition by documentId, pageNumber, kind order by y nulls first, x nulls first, id) - n) // 100)::bigint pack from k)
        select documentId, pageNumber, kind, pack, count(*) regions, sum(n)::bigint chars from b group by all""",
    "item_chunks": f"""with {_R} select productGroupId item, count(*) regions, sum(length(extractedText))::bigint chars, min(pageNumber) first_page,
        md5(string_agg(md5(extractedText), '' order by contains(regionType, 'table') nulls first, pageNumber nulls first, id)) digest from r where productGroupId is not null and trim(extractedText, ' ') <> '' group by 1""",
    "faq_pairs": f"""with {_R}, n as (select *, lead(id) over w nx, lead(regionType) over w nt from r where regionType in ('faq_question', 'faq_answer') window w as (partition by documentId order by pageNumber nulls first, id))
        select documentId, id question, nx answer from n where regionType = 'faq_question' and nt = 'faq_answer'""",
    "section_chunk_set": _C + """, s9 as (select documentId, 'section' kind, count(*) n from (select distinct documentId, coalesce(sectionPath, '') s from document_chunks) group by all),
        a9 as (select doc_id, 'sku', count(distinct (table_no, row_no)) n from named where "name" = 'DN' and trim("value") <> '' group by all), b9 as (select doc_id, 'characteristic', count(distinct (table_no, row_no)) n from named where "name" = 'kg' and trim("value") <> '' group by all)
        select * from s9 union all select * from a9 union all select * from b9""",
    "assembled_files": """with c as (select distinct id, documentId, sectionPath, length(content) n from document_chunks where content is not null), p as (select documentId, sectionPath, sum(n) + (count(*) - 1) * 2 n from c group by all)
        select documentId, count(*) sections, (sum(n) + (count(*) - 1) * 7)::bigint chars from p group by documentId""",
}
