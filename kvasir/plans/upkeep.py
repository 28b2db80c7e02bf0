"""Queries of the store's upkeep, of page geometry, and further relational operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvasir.operators import layout as L
from kvasir.operators import store as S
from kvasir.plans import store as plans
from kvasir.sources.tables import table

VERSIONS = ("layout-v1", "layout-v2")


def point_lookup(spark, d):
    """The products of the least and the greatest number."""
    ends = table(spark, d, "products").agg(F.min("sku"), F.max("sku")).first()
    return S.point_lookup(table(spark, d, "products"), "sku", list(ends)).select("id", "sku").distinct()


def section_range(spark, d):
    """The chunks of the first section of the first document that has one."""
    first = table(spark, d, "document_chunks").where("sectionPath is not null").agg(F.min(F.struct("documentId", "sectionPath")).alias("s")).first().s
    return S.section_range(table(spark, d, "document_chunks").select("id", "documentId", "sectionPath", "chunkIndex").distinct(), first.documentId, first.sectionPath)


def session_rows(spark, d):
    return S.session_rows(table(spark, d, "chat_history"), F.lower(F.trim("sessionId")), 3)


def chunked_documents(spark, d):
    found = S.exists_by(table(spark, d, "documents"), "doc_id", table(spark, d, "document_chunks"), "documentId")
    return found


def assigned_groups(spark, d):
    """Products without a group given the first group of their document."""
    first = table(spark, d, "product_groups").groupBy(F.col("documentId").alias("key")).agg(F.min("id").alias("value"))
    rows = table(spark, d, "products").select("id", "documentId", "groupId").distinct()
    done = S.assign(rows.where("groupId is null"), "documentId", first, "groupId").unionByName(rows.where("groupId is not null"))
    return done.select("id", "groupId")


def merged_sections(spark, d):
    """Sections of documents with the titles of product groups of the same path put in."""
    stored = table(spark, d, "sections").select("documentId", "sectionPath", "id", "title").distinct()
    stored = S.latest(stored, ["documentId", "sectionPath"], F.asc("id")).select("documentId", "sectionPath", "title")
    fresh = S.latest(table(spark, d, "product_groups").where("documentId is not null and sectionPath is not null").distinct(), ["documentId", "sectionPath"], F.desc("id")).select("documentId", "sectionPath", F.col("name").alias("title"))
    return S.insert_or_update(stored, fresh, ["documentId", "sectionPath"], "title")


def replaced_chunks(spark, d):
    """Chunks per document after those of documents with FAQ-like chunks were written again from their regions."""
    stored = table(spark, d, "document_chunks").select("id", "documentId").distinct()
    fresh = table(spark, d, "manual_regions").where("regionType like 'faq%' and documentId is not null").select("id", "documentId").distinct()
    return S.replace_by_key(stored, fresh, "documentId").groupBy("documentId").agg(F.count(F.lit(1)).alias("chunks"))


def deleted_sources(spark, d):
    gone = table(spark, d, "knowledge_sync_sources").where("not enabled").select(F.col("id").alias("syncSourceId"))
    return S.delete_source(table(spark, d, "documents"), gone).groupBy("action").agg(F.count(F.lit(1)).alias("documents"))


def origin_statistics(spark, d):
    return S.origin_statistics(table(spark, d, "chat_history"))


def sync_totals(spark, d):
    """What became of the documents of each kind and source by their status."""
    action = F.when(F.col("status") == "indexed", "add").when(F.col("status") == "processing", "update").otherwise("orphan")
    rows = table(spark, d, "documents").where("syncSourceId is not null and docType is not null").select(F.col("docType").alias("kind"), F.col("syncSourceId").alias("source"), action.alias("action"))
    return S.sync_totals(rows)


def derived_documents(spark, d):
    """Manuals by whether they were made from a passport of the same title, as told by their hash."""
    docs = table(spark, d, "documents").where("title is not null")
    source = S.latest(docs.where("docType = 'passport'").select("doc_id", "title", F.sha2("text", 256).alias("hash")), ["title"], F.asc("doc_id")).select("title", F.col("hash").alias("source_hash"))
    made = docs.where("docType <> 'passport'").select("doc_id", "title", "docType", "text")
    rows = made.join(source, "title", "left")
    own = F.when(F.col("docType") == "instruction", F.sha2(F.concat_ws(":", F.lit(VERSIONS[1]), "source_hash"), 256)).otherwise(F.sha2("text", 256))
    saved = F.when(F.col("docType") == "catalog", F.col("source_hash"))
    same = F.coalesce(S.same_source(own, saved, F.col("source_hash"), VERSIONS), F.lit(False))
    return rows.groupBy("docType", same.alias("same")).agg(F.count(F.lit(1)).alias("documents"))


def recoverable_reviews(spark, d):
    """Documents by whether a review of them could go on, a review being a region marked in them."""
    marked = table(spark, d, "manual_regions").where("documentId is not null").select(F.col("documentId").alias("doc_id")).distinct().withColumn("m", F.lit(True))
    docs = table(spark, d, "documents").join(marked, "doc_id", "left")
    rows = docs.select(
        "doc_id", F.lit("installation").alias("docType"), F.when(F.col("fileType") == "pdf", "md").otherwise(F.col("fileType")).alias("fileType"), "status", F.lit("waits for review").alias("message"),
        F.lit(None).cast("boolean").alias("required"), F.coalesce("m", F.lit(False)).alias("has_review"), F.lit("a").alias("review_hash"), F.when(F.col("syncSourceId").isNull(), "a").otherwise("b").alias("source_hash"),
        F.col("title").isNotNull().alias("outlined"),
    )
    return S.recoverable(rows).groupBy("status", "recoverable").agg(F.count(F.lit(1)).alias("documents"))


def orphan_counts(spark, d):
    names = ("document_chunks", "sections", "products", "manual_regions")
    return S.orphan_counts({n: (table(spark, d, n), "documentId") for n in names}, table(spark, d, "documents"), "doc_id")


def inventory_shrunk(spark, d):
    """Tables whose rows shrink when repeated ones are taken out."""
    names = ("document_chunks", "sections", "products", "chat_history")
    before = S.inventory({n: table(spark, d, n) for n in names})
    return S.inventory_shrunk(before, S.inventory({n: table(spark, d, n).select("id").distinct() for n in names}))


def page_links(spark, d):
    """The links of a page made for every document that has a source: to its file, with its title."""
    docs = table(spark, d, "documents").where("syncSourceId is not null and filename is not null")
    anchor = F.concat(F.lit('<p><a class="x" href="../files/'), "filename", F.lit('?v=1&amp;w=2#top"><b>'), F.coalesce("title", F.lit("&quot;file&quot;")), F.lit("</b></a> <a href='#'>top</a> <A HREF='"), "filename", F.lit("'>again</A></p>"))
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("https://host.example/s"), F.col("syncSourceId").cast("string"), F.lit("/list.html?page=1")).alias("url"), anchor.alias("html"))
    return S.links(pages, extension=".pdf")


def touching_regions(spark, d):
    box = F.from_json("coordinates", "bbox struct<x:double,y:double,width:double,height:double>")["bbox"]
    rows = table(spark, d, "manual_regions").select("id", "documentId", "pageNumber", box.alias("b")).where("b is not null and documentId is not null and pageNumber is not null")
    return L.touching_groups(rows.select("id", "documentId", "pageNumber", "b.*"), ["documentId", "pageNumber"]).select("id", "grid")


def region_columns(spark, d):
    box = F.from_json("coordinates", "bbox struct<x:double,y:double>")["bbox"]
    rows = table(spark, d, "manual_regions").select("id", "documentId", "pageNumber", box.alias("b")).where("b is not null and documentId is not null and pageNumber is not null")
    return L.column_anchors(rows.select("id", "documentId", "pageNumber", "b.x"), ["documentId", "pageNumber"], 60.0).select("id", "col")


def page_texts(spark, d):
    """Regions of a page read as its words."""
    box = F.from_json("coordinates", "bbox struct<x:double,y:double,width:double,height:double>")["bbox"]
    rows = table(spark, d, "manual_regions").select("id", "documentId", "pageNumber", F.col("regionType").alias("text"), box.alias("b")).where("b is not null and documentId is not null and pageNumber is not null")
    found = L.positioned_text(rows.select("id", "documentId", "pageNumber", "text", "b.*"), ["documentId", "pageNumber"], line=20.0)
    return found


def ext_cube(spark, d):
    rows = table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("bigint").alias("level"))
    return rows


def ext_having(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n"))
    return rows.where("n >= 30 and quantity > 700")


def ext_recursive(spark, d):
    """Sections and all that lie under them, by a recursive query over the distinct paths' parents."""
    table(spark, d, "sections").where("sectionPath is not null").selectExpr("sectionPath path", "case when instr(sectionPath, '.') > 0 then substring_index(sectionPath, '.', size(split(sectionPath, '[.]')) - 1) end up").distinct().createOrReplaceTempView("_paths")
    return spark.sql("""with recursive r(root, path, depth) as (select path, path, 0 from _paths where up is null union all select r.root, p.path, r.depth + 1 from r join _paths p on p.up = r.path)
        select root, count(*) paths, max(depth) depth from r group by root""")


def ext_asof(spark, d):
    """For every order the last one of the same customer before it."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    w = F.lag("o_orderkey").over(S.Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return o.select("o_orderkey", w.alias("previous")).where("previous is not null")


QUERIES = {
    f.__name__: f
    for f in (
        point_lookup, section_range, session_rows, chunked_documents, assigned_groups, merged_sections, replaced_chunks, deleted_sources, origin_statistics, sync_totals, derived_documents,
        recoverable_reviews, orphan_counts, inventory_shrunk, page_links, touching_regions, region_columns, page_texts, ext_cube, ext_having, ext_recursive, ext_asof,
    )
}

_DOC_TABLES = ("document_chunks", "sections", "products", "manual_regions")
ORACLES = {
    "point_lookup": "select distinct id, sku from products where sku in (select min(sku) from products union all select max(sku) from products)",
    "section_range": """with f as (select documentId d, sectionPath p from document_chunks where sectionPath is not null and documentId is not null order by documentId, sectionPath limit 1)
        select distinct id, documentId, sectionPath, chunkIndex from document_chunks join f on documentId = d and sectionPath = p""",
    "session_rows": f"""with {plans._CHAT} select lower(trim(sessionId, ' ')) "session", id, row_number() over (partition by lower(trim(sessionId, ' ')) order by createdAt desc, id desc) place from chat
        where sessionId is not null and createdAt is not null qualify place <= 3""",
    "chunked_documents": "select distinct doc_id, doc_id in (select documentId from document_chunks where documentId is not null) present from documents",
    "assigned_groups": "with p as (select distinct id, documentId, groupId from products), g as (select documentId, min(id) g from product_groups group by 1) select p.id, coalesce(groupId, g) groupId from p left join g using (documentId)",
    "merged_sections": """with s as (select documentId, sectionPath, title from (select distinct documentId, sectionPath, id, title from sections) qualify row_number() over (partition by documentId, sectionPath order by id) = 1),
        g as (select documentId, sectionPath, n from (select distinct documentId, sectionPath, id, "name" n from product_groups where documentId is not null and sectionPath is not null) qualify row_number() over (partition by documentId, sectionPath order by id desc) = 1)
        select documentId, sectionPath, coalesce(n, title) title from s full join g using (documentId, sectionPath)""",
    "replaced_chunks": """with f as (select distinct id, documentId from manual_regions where regionType like 'faq%' and documentId is not null), c as (select distinct id, documentId from document_chunks),
        a as (select documentId from c where documentId is null or documentId not in (select documentId from f) union all select documentId from f) select documentId, count(*) chunks from a group by 1""",
    "deleted_sources": """select case status when 'failed' then 'delete' when 'processing' then 'fail' else 'detach' end "action", count(*) documents from documents where syncSourceId in (select id from knowledge_sync_sources where not enabled) group by 1""",
    "origin_statistics": f"""with {plans._CHAT} select "source" origin, count(*) requests, count(response) answered, count(rating) rated, count(distinct lower(trim(sessionId, ' '))) sessions, min(createdAt) first_seen, max(createdAt) last_seen from chat group by 1""",
    "sync_totals": """with r as (select docType kind, syncSourceId s, status from documents where syncSourceId is not null and docType is not null)
        select kind, s "source", count(*) filter (status = 'indexed') "add", count(*) filter (status = 'processing') "update", 0::bigint same, count(*) filter (status not in ('indexed', 'processing')) orphan, 0::bigint "restore" from r group by cube (kind, s)""",
    "derived_documents": """with d as (select * from documents where title is not null), s as (select title, sha256(text) h from d where docType = 'passport' qualify row_number() over (partition by title order by doc_id) = 1),
        m as (select docType, h, sha256(text) own from d left join s using (title) where docType <> 'passport')
        select docType, coalesce(h is not null and case when docType = 'catalog' then true when docType = 'instruction' then true else own = h end, false) same, count(*) documents from m group by all""",
    "recoverable_reviews": """with d as (select status, fileType in ('pdf', 'md') f, doc_id in (select documentId from manual_regions where documentId is not null) m, syncSourceId is null k, title is not null t from documents)
        select status, coalesce(f and (status = 'processing' or (status = 'failed' and m)) and (m or t) and k, false) recoverable, count(*) documents from d group by all""",
    "orphan_counts": " union all ".join(f"select '{n}' \"name\", count(*) orphans from (select distinct id, documentId k from {n} where documentId is not null) where k not in (select doc_id from documents)" for n in _DOC_TABLES),
    "inventory_shrunk": " union all ".join(f"select '{n}' \"name\", count(*) \"before\", count(distinct id) \"after\", count(distinct id) < count(*) shrunk from {n}" for n in ("document_chunks", "sections", "products", "chat_history")),
    "page_links": r"""with d as (select doc_id, syncSourceId s, filename f, coalesce(trim(regexp_replace(title, '\s+', ' ', 'g')), '"file"') t from documents where syncSourceId is not null and filename is not null and ends_with(lower(filename), '.pdf'))
        select doc_id page_id, 'https://host.example/s' || s || '/../files/' || f || '?v=1&w=2' url, t title from d union all select doc_id, 'https://host.example/s' || s || '/' || f, 'again' from d""",
    "ext_cube": "select o_orderstatus, o_orderpriority, count(*) n, grouping_id(o_orderstatus, o_orderpriority) \"level\" from orders group by cube (o_orderstatus, o_orderpriority)",
    "ext_having": "select l_partkey, sum(l_quantity) quantity, count(*) n from lineitem group by 1 having count(*) >= 30 and sum(l_quantity) > 700",
    "ext_recursive": """with recursive p as (select distinct sectionPath path, case when contains(sectionPath, '.') then regexp_replace(sectionPath, '[.][^.]*$', '') end up from sections where sectionPath is not null),
        r as (select path root, path, 0 depth from p where up is null union all select r.root, p.path, r.depth + 1 from r join p on p.up = r.path) select root, count(*) paths, max(depth) "depth" from r group by root""",
    "ext_asof": "select o_orderkey, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) previous from orders qualify previous is not null",
}
