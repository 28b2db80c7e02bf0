"""Queries of plain text as tables, of tables near chunks, and of sources."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from kvasir.operators import chunk
from kvasir.operators import score as S
from kvasir.operators import store as O
from kvasir.operators import tables as B
from kvasir.functions import text as T
from kvasir.plans import answer, intent
from kvasir.plans import score as plans
from kvasir.sources.files import markdown_elements as parse
from kvasir.sources.tables import table
from kvasir.streaming.state import concurrency_limit


def _cells(spark, d):
    return chunk.pipe_tables(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", "col")


def block_formats(spark, d):
    """Blocks of documents by what they can be shown as."""
    blocks = table(spark, d, "documents").select(F.explode(F.split("text", r"\n{2,}")).alias("b"))
    kind = F.when(B.column_table(F.col("b")).isNotNull(), "columns").when(B.pair_table(F.col("b")).isNotNull(), "pairs").when(B.bullet_list(F.col("b")).isNotNull(), "list").otherwise("text")
    return blocks.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("blocks"))


def formatted_chunks(spark, d):
    rows = table(spark, d, "document_chunks").where("content is not null").select("id", F.md5(B.formatted(F.col("content"))).alias("digest"))
    return rows.dropDuplicates(["id"])


def shown_tables(spark, d):
    """Whether the text of a document shows its own tables."""
    from kvasir.operators.answer import table_markdown

    made = table_markdown(_cells(spark, d), ["doc_id", "table_no"])
    both = made.join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return both.select("doc_id", "table_no", B.shows_table(F.col("text"), F.col("markdown")).alias("shown"))


def pruned_tables(spark, d):
    return B.pruned_columns(_cells(spark, d), ["doc_id", "table_no"]).groupBy("doc_id", "table_no").agg(F.countDistinct("col").alias("columns"))


def merged_tables(spark, d):
    return B.merged_tables(_cells(spark, d), ["doc_id", "table_no"], ["doc_id"])


def nearest_tables(spark, d):
    rows = table(spark, d, "document_chunks").select("id", "documentId", "sectionPath", "chunkIndex", (F.col("elementType") == "figure").alias("has_table"))
    return B.nearest_tables(rows)


def answer_sources(spark, d):
    hits = answer._hits(spark, d)
    texts = plans._of_hits(hits, table(spark, d, "document_chunks").select("id", "pageNumber", "content"))
    return B.answer_sources(hits.join(texts, "id"), 80)


def sku_cascade(spark, d):
    """What the product numbers of products and of questions lead to."""
    p = table(spark, d, "products").select("id", "sku", "groupId").dropDuplicates(["id"])
    g = table(spark, d, "product_groups").select(F.col("id").alias("groupId"), F.col("name").alias("group_name")).dropDuplicates(["groupId"])
    asked = table(spark, d, "chat_history").select(F.explode(F.regexp_extract_all(F.upper("query"), F.lit("[A-Z]{2}-[0-9]{2}(?:-[0-9]{4})?"), 0)).alias("sku"))
    docs = table(spark, d, "documents").where("title is not null").select("doc_id", "title")
    return B.sku_cascade(asked.unionByName(p.where("groupId is not null").select("sku")), p.join(g, "groupId").select("sku", "group_name"), docs)


def product_details(spark, d):
    """Products with the path of their section and how many chunks it has."""
    p = table(spark, d, "products").select("id", "documentId", "sectionId").distinct()
    s = table(spark, d, "sections").select(F.col("id").alias("sectionId"), F.col("documentId").alias("owner"), "sectionPath").distinct()
    c = table(spark, d, "document_chunks").select("id", F.col("documentId").alias("owner"), "sectionPath").distinct().groupBy("owner", "sectionPath").agg(F.count(F.lit(1)).alias("chunks"))
    return p.join(s, "sectionId", "left").join(c, ["owner", "sectionPath"], "left").select("id", "sectionPath", F.coalesce("chunks", F.lit(0)).alias("chunks"))


def newest_chunks(spark, d):
    """The two thousand newest chunks of indexed documents, which a search looks at."""
    docs = table(spark, d, "documents").where("status = 'indexed'").select(F.col("doc_id").alias("documentId"))
    rows = table(spark, d, "document_chunks").select("id", "documentId").distinct().join(docs, "documentId")
    return rows.orderBy(F.desc("id")).limit(2000).select("id", "documentId")


def markdown_elements(spark, d):
    """The elements of all documents read as Markdown, by kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = [k for t in b.column(0).to_pylist() for k, _ in parse(t)]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string())], ["kind"])

    found = table(spark, d, "documents").where("text is not null").select("text").mapInArrow(run, "kind string")
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def renewed_vectors(spark, d):
    """Vectors of FAQ entries made anew: their lengths, and how many places they fill."""
    rows = B.with_vectors(table(spark, d, "faq_entries").select("id", "title"), "title", "vec", B.hash_embedding).dropDuplicates(["id"])
    return rows.select("id", F.round(S.l2_norm(F.col("vec")), 6).alias("norm"), (F.size(F.filter("vec", lambda x: x > 0)) > 0).alias("filled"))


def concurrent_answers(spark, d):
    """Exchanges that find fewer than two others of their source under way."""
    rows = table(spark, d, "chat_history").where("createdAt is not null and responseTime is not null").select(F.col("id").alias("event_id"), "source", "createdAt", (F.col("responseTime") * 400).alias("ms")).distinct()
    return concurrency_limit(rows, "source", "createdAt", "ms", most=2).groupBy("source", "allowed").agg(F.count(F.lit(1)).alias("n"))


def due_sources(spark, d):
    """Enabled sources that were last read more than a day before the last reading of any."""
    rows = table(spark, d, "knowledge_sync_sources")
    return O.due(rows, rows.agg(F.max("lastSyncedAt")).first()[0], 24 * 3600).select("id")


QUERIES = {
    f.__name__: f
    for f in (
        block_formats, formatted_chunks, shown_tables, pruned_tables, merged_tables, nearest_tables, answer_sources, sku_cascade, product_details, newest_chunks, markdown_elements,
        renewed_vectors, concurrent_answers, due_sources,
    )
}

_C = answer._CELLS
_MODELS = intent._MODELS.format("title", T.NO_MODELS)
_STEMS = lambda c: f"list_distinct(list_transform(regexp_extract_all(replace(lower({c}), 'ё', 'е'), '[а-яa-z0-9]{{3,}}'), lambda w: {T.sql_stem('w')}))"
ORACLES = {
    "sku_cascade": rf"""with p as (select distinct on (id) id, sku, groupId from products), g as (select distinct on (id) id, "name" from product_groups), d as (select doc_id, title from documents where title is not null),
        a as (select distinct upper(s) sku from (select unnest(regexp_extract_all(upper(query), '[A-Z]{{2}}-[0-9]{{2}}(?:-[0-9]{{4}})?')) s from chat_history union all select sku from p where groupId is not null) where s is not null),
        k as (select sku, nullif(regexp_replace(sku, '[^\p{{L}}\p{{N}}]', '', 'g'), '') kk from a), ex as (select a.sku, count(distinct doc_id) ex from a join (select doc_id, unnest({_MODELS}) m from d) on m = a.sku group by 1),
        nm as (select nullif(regexp_replace(upper(p.sku), '[^\p{{L}}\p{{N}}]', '', 'g'), '') kk, regexp_replace(trim(g."name"), '^[0-9]+(\.[0-9]+)*\.?\s*', '') n from p join g on g.id = p.groupId),
        gr as (select sku, count(distinct replace(lower(n), 'ё', 'е')) gn, min(n) n from k join nm using (kk) where n <> '' group by 1), ds as (select doc_id, {_STEMS('title')} t from d),
        ma as (select sku, count(*) m from (select sku, {_STEMS('n')} s from gr where gn = 1) join ds on len(s) > 0 and len(list_intersect(s, t)) >= greatest(least(2, len(s)), ceil(len(s) * 0.6)) group by 1)
        select a.sku, case when ex is not null then 'resolved' when gn is null then 'unknown' when gn > 1 then 'ambiguous' else 'resolved' end status, case when ex is not null then 'sku' when gn = 1 then 'group' end way,
          coalesce(ex, case when gn = 1 then coalesce(m, 0) end, 0) documents from a left join ex using (sku) left join gr using (sku) left join ma using (sku)""",
    "pruned_tables": _C + """, e as (select doc_id, table_no, col, not bool_or(trim("name") = '' or regexp_matches(replace(lower(trim("name")), 'ё', 'е'), '^(колон|column)') or regexp_matches(trim("name"), '^[0-9]+$')
          or (length(trim("name")) <= 2 and not regexp_matches("name", '[A-Za-zА-Яа-яЁё]'))) or count(*) filter (trim("value") <> '') > 1 keep from named group by all),
        f as (select *, bool_or(keep) over (partition by doc_id, table_no) a from e) select doc_id, table_no, count(*) "columns" from f where keep or (not a and col < 3) group by all""",
    "merged_tables": _C + """, h as (select doc_id, table_no, string_agg(distinct col || trim("name"), '|' order by col || trim("name")) h, count(distinct row_no) r from named group by all)
        select doc_id, count(*) "tables", sum(r)::bigint "rows" from h group by doc_id having count(distinct h) = 1""",
    "nearest_tables": """with c as (select distinct id, documentId d, sectionPath s, chunkIndex i, elementType = 'figure' t from document_chunks), f as (select d, s, arg_min(id, (i, id)) ti from c where t and s is not null group by all),
        a as (select d, i, min(id) ti from c where t group by all), u as (select id, id ti, 0 p from c where t union all select c.id, f.ti, 1 from c join f using (d, s)
          union all select c.id, a.ti, o.p from c, (values (1, 2), (-1, 3), (2, 4), (-2, 5)) o(k, p) join a on a.d = c.d and a.i = c.i + o.k)
        select id, arg_min(ti, (p, ti)) table_id, case min(p) when 0 then 'own' when 1 then 'section' else 'near' end way from u group by id""",
    "answer_sources": answer._H + r""", k as (select distinct on (id) id, pageNumber, trim(regexp_replace(content, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') t from document_chunks)
        select query_id, hh.id, concat_ws(' — ', filename, 'раздел ' || sectionPath, 'стр. ' || pageNumber) "label", case when length(t) > 80 then left(t, 80) || '…' else t end snippet from hh join k using (id)""",
    "product_details": """with p as (select distinct id, sectionId from products), s as (select distinct id, documentId, sectionPath from sections), c as (select documentId, sectionPath, count(distinct id) n from document_chunks group by all)
        select p.id, s.sectionPath, coalesce(n, 0) chunks from p left join s on s.id = p.sectionId left join c on c.documentId = s.documentId and c.sectionPath = s.sectionPath""",
    "newest_chunks": "select distinct id, documentId from document_chunks join documents on doc_id = documentId where status = 'indexed' order by id desc limit 2000",
    "renewed_vectors": "select distinct id, case when length(title) > 3 then 1.0 end norm, true filled from faq_entries",
    "due_sources": "select id from knowledge_sync_sources where enabled and coalesce(lastSyncedAt, timestamp '1970-01-01') <= (select max(lastSyncedAt) from knowledge_sync_sources) - interval 1 day",
}
