"""Queries of catalogue tables and of what is made of scored hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvasir.operators import catalog as C
from kvasir.operators import chunk
from kvasir.plans import chunk as chunk_plans
from kvasir.plans import score as plans
from kvasir.sources.tables import table


def unique_headers(spark, d):
    """The products of each document, those of the same name numbered."""
    rows = table(spark, d, "products").select("id", "documentId", "name").dropDuplicates(["id"]).where("name is not null and documentId is not null")
    return C.unique_headers(rows, ["documentId"], "id", "name").select("id", "header")


def table_fingerprints(spark, d):
    cells = chunk.pipe_tables(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return C.table_fingerprints(cells, ["doc_id", "table_no"])


def merge_products(spark, d):
    rows = table(spark, d, "products").select("id", "sku", "name", "pageNumber", "groupId").dropDuplicates(["id"])
    return C.merge_records(rows, "sku", "id", "name", "pageNumber", "groupId")


def seeded_groups(spark, d):
    return C.seeded_groups(table(spark, d, "documents"), table(spark, d, "products"))


def ingest_quality(spark, d):
    return C.ingest_quality(table(spark, d, "document_chunks"))


def document_outline(spark, d):
    return C.document_outline(table(spark, d, "sections"))


def section_page_ends(spark, d):
    return C.section_page_ends(table(spark, d, "sections"))


def products_by_section_path(spark, d):
    return C.products_by_section_path(table(spark, d, "products"), table(spark, d, "sections"))


def sku_documents(spark, d):
    asked = table(spark, d, "chat_history").select(F.explode(F.regexp_extract_all(F.upper("query"), F.lit("[A-Z]{2}-[0-9]{2}-[0-9]{4}"), 0)).alias("sku"))
    return C.sku_documents(asked, table(spark, d, "products"), table(spark, d, "product_groups"), table(spark, d, "documents"))


def _hits(spark, d):
    hits = plans._section_hits(spark, d)
    return hits.join(plans._of_hits(hits, table(spark, d, "document_chunks").select("id", "documentId", "sectionPath")), "id")


def attachments(spark, d):
    return C.attachments(_hits(spark, d)).withColumn("relevance", F.round("relevance", 4))


def clear_winner(spark, d):
    return C.clear_winner(_hits(spark, d), 1.0, 0.1)


def variant_first(spark, d):
    return C.variant_first(_hits(spark, d), F.col("sectionPath").startswith("1"), 5)


def reading_lines(spark, d):
    box = F.from_json("coordinates", "bbox struct<x:double,y:double,width:double,height:double>")["bbox"]
    rows = table(spark, d, "manual_regions").select("id", "documentId", "pageNumber", box.alias("b")).dropDuplicates(["id"]).where("b.x is not null and b.y is not null")
    return C.reading_lines(rows.select("documentId", "pageNumber", "id", "b.x", "b.y"), ["documentId", "pageNumber"])


QUERIES = {
    f.__name__: f
    for f in (
        unique_headers, table_fingerprints, merge_products, seeded_groups, ingest_quality, document_outline, section_page_ends, products_by_section_path,
        sku_documents, attachments, clear_winner, variant_first, reading_lines,
    )
}

_HITS = plans._BM25 + ", h as (select distinct rk.query_id, rk.id, score relevance, documentId, sectionPath from rk join document_chunks using (id) where rank <= 10)"
ORACLES = {
    "reading_lines": """with recursive r as (select distinct on (id) id, documentId d, pageNumber p, json_extract(c, '$.bbox.x')::double x, json_extract(c, '$.bbox.y')::double y from (select *, case when json_valid(coordinates) then coordinates::json end c from manual_regions)),
        e as (select *, row_number() over (partition by d, p order by y, x, id) k from r where x is not null and y is not null),
        f as (select d, p, k, id, x, y top, 1::bigint line_no from e where k = 1
          union all select e.d, e.p, e.k, e.id, e.x, case when e.y - f.top > 5 then e.y else f.top end, case when e.y - f.top > 5 then line_no + 1 else line_no end from f join e on e.d is not distinct from f.d and e.p is not distinct from f.p and e.k = f.k + 1)
        select d documentId, p pageNumber, id, line_no, row_number() over (partition by d, p, line_no order by x, id) in_line from f""",
    "table_fingerprints": chunk_plans._TABLES + r""", x as (select doc_id, table_no, row_no, "name", lower(regexp_replace("value", '\s+', '', 'g')) v from named)
        select doc_id, table_no, max(row_no) "rows", md5(string_agg("name" || '=' || v, '|' order by row_no, "name", v)) fingerprint from x group by all""",
    "document_outline": r"""with r as (select distinct id, documentId, sectionPath, "level", pageStart from sections),
        w as (select *, pageStart < lag(pageStart) over (partition by documentId order by list_transform(string_split(sectionPath, '.'), lambda p: try_cast(p as int)) nulls first, id) back,
          row_number() over (partition by documentId, sectionPath order by id) = 2 twice from r)
        select documentId, count(*) sections, max("level")::bigint "depth", count(*) filter (twice) doubled, count(*) filter (back) disordered from w group by documentId""",
    "unique_headers": """with p as (select distinct id, documentId, "name" n from products where "name" is not null and documentId is not null),
        r as (select *, row_number() over (partition by documentId, n order by id) k from p) select id, case when k = 1 then n else n || ' ' || k end "header" from r""",
    "merge_products": """with p as (select distinct id, sku, "name" n, pageNumber pn, groupId g from products where sku is not null)
        select sku, max_by(n, id) filter (n is not null and n <> '') "name", max_by(pn, id) filter (pn is not null) pageNumber, max_by(g, id) filter (g is not null) groupId from p group by sku""",
    "seeded_groups": r"""with p as (select distinct documentId, nullif(regexp_replace(upper(sku), '[^\p{L}\p{N}]', '', 'g'), '') k from products)
        select doc_id documentId, coalesce(title, filename) group_name, count(k) items from documents left join p on p.documentId = doc_id where docType = 'catalog' and status = 'indexed' group by all""",
    "ingest_quality": """with c as (select documentId, id, bool_or(embedding is not null and trim(embedding) not in ('', 'null', '[]')) has from document_chunks group by all),
        s as (select documentId, avg(has::int) share from c group by 1) select documentId, round(share, 6) share, case when share = 0 then 'failed' when share < 0.5 then 'poor' else 'good' end verdict from s""",
    "section_page_ends": """with r as (select distinct id, documentId, pageStart, pageEnd from sections), n as (select *, lead(pageStart) over (partition by documentId order by pageStart nulls first, id) f from r)
        select id, case when pageEnd >= pageStart then pageEnd else greatest(pageStart, coalesce(f - 1, pageStart)) end page_end from n""",
    "products_by_section_path": """with s as (select distinct id, documentId, sectionPath from sections), p as (select distinct id, documentId, sectionId from products)
        select p.id, case when s.documentId = p.documentId then s.id end sectionId, case when s.documentId = p.documentId then s.sectionPath end path from p left join s on s.id = p.sectionId""",
    "sku_documents": r"""with a as (select distinct unnest(regexp_extract_all(upper(query), '[A-Z]{2}-[0-9]{2}-[0-9]{4}')) sku from chat_history),
        f as (select a.sku, p.documentId doc_id, 1 n from a join products p on regexp_replace(upper(p.sku), '[^\p{L}\p{N}]', '', 'g') = regexp_replace(a.sku, '[^\p{L}\p{N}]', '', 'g')
          union select a.sku, doc_id, 2 from a join (select doc_id, unnest(regexp_extract_all(upper(title), '[A-Z]{2}-[0-9]{2}(?:-[0-9]{4})?')) code from documents) t on code = sku
          union select a.sku, documentId, 3 from a join (select documentId, unnest(regexp_extract_all(upper("name"), '[A-Z]{2}-[0-9]{2}(?:-[0-9]{4})?')) code from product_groups) g on code = left(sku, 5))
        select sku, doc_id, case n when 1 then 'product' when 2 then 'title' else 'group' end way from f where doc_id is not null qualify n = min(n) over (partition by sku)""",
    "attachments": _HITS + """, g as (select query_id, documentId, round(sum(relevance), 6) relevance, count(*) n from h group by all),
        pl as (select *, row_number() over (partition by query_id order by relevance desc, n desc, documentId) place from g) select query_id, documentId, round(relevance, 4) relevance, place from pl where place <= 2""",
    "clear_winner": _HITS + """, wr as (select query_id, id, relevance, row_number() over v n, lead(relevance, 1, 0.0) over v s from h window v as (partition by query_id order by relevance desc, id))
        select query_id, id from wr where n = 1 and relevance >= 1.0 and round(relevance - s, 9) >= 0.1""",
    "variant_first": _HITS + """, wr as (select query_id, id, row_number() over (partition by query_id order by coalesce(starts_with(sectionPath, '1'), false) desc, relevance desc, id) "rank" from h)
        select query_id, id, "rank" from wr where "rank" <= 5""",
}
