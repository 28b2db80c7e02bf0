"""Queries of parsing and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvasir.operators import chunk as C
from kvasir.sources.tables import table


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def paragraphs(spark, d):
    rows = C.paragraphs(_docs(spark, d), "doc_id", "text")
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.length("paragraph").cast("bigint").alias("n_chars"))


def word_windows(spark, d):
    rows = C.word_windows(_docs(spark, d), "doc_id", "text", 100, 80)
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("n_words").cast("bigint").alias("n_words"), F.md5("window").alias("digest"))


def paragraph_pack(spark, d):
    rows = C.pack_paragraphs(_docs(spark, d), "doc_id", "text")
    return rows.select("doc_id", "pos", F.length("pack").alias("n_chars"))


def toc_extract(spark, d):
    return C.headings(_docs(spark, d), "doc_id", "text")


def markdown_tables(spark, d):
    return C.pipe_tables(_docs(spark, d), "doc_id", "text")


def element_types(spark, d):
    kind = C.element_type(F.col("text"))
    return _docs(spark, d).where("text is not null").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("documents"))


def section_chunks(spark, d):
    return C.section_chunks(table(spark, d, "document_chunks"))


def token_packs(spark, d):
    rows = C.pack_tokens(_docs(spark, d), "doc_id", "text", most=120, overlap=30)
    return rows.select("doc_id", "pos", "tokens", F.md5("chunk").alias("digest"))


QUERIES = {f.__name__: f for f in (paragraphs, word_windows, paragraph_pack, toc_extract, markdown_tables, element_types, section_chunks, token_packs)}
_LINES = "l as (select doc_id, unnest(ls) line, unnest(range(len(ls))) \"no\" from (select doc_id, string_split(text, chr(10)) ls from documents where text is not null))"
_TABLES = rf"""with {_LINES}, r as (select doc_id, trim(line) line, "no" from l where regexp_matches(trim(line), '^\|.*\|$')),
    i as (select *, "no" - row_number() over (partition by doc_id order by "no") isl from r),
    t as (select *, row_number() over w at_, first_value(line) over w head, lead(line) over w nxt from i window w as (partition by doc_id, isl order by "no")),
    u as (select *, first_value(nxt) over (partition by doc_id, isl order by "no") divider from t),
    b as (select *, dense_rank() over (partition by doc_id order by isl) table_no from u where regexp_matches(divider, '^\|(\s*:?-+:?\s*\|)+$') and at_ > 2),
    c as (select doc_id, table_no, at_ - 2 row_no, list_transform(regexp_split_to_array(regexp_replace(head, '^\||\|$', '', 'g'), '\|'), lambda x: trim(x)) hs,
      list_transform(regexp_split_to_array(regexp_replace(line, '^\||\|$', '', 'g'), '\|'), lambda x: trim(x)) vs from b),
    cells as (select doc_id, table_no, row_no, hs[k] h, k, coalesce(vs[k], '') "value" from c, range(1, 100) q(k) where k <= len(hs)),
    named as (select doc_id, table_no, row_no, case when h = '' then 'column ' || k else h end "name", "value" from cells)
"""
ORACLES = {
    "markdown_tables": _TABLES + 'select doc_id, table_no, row_no, "name", "value" from named',
    "paragraph_pack": r"""with recursive d as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda x: trim(x, ' ')), lambda x: x <> '') ps from documents where text is not null),
        f as (select doc_id, ps, 1 k, length(ps[1]) n, 0 pos from d where len(ps) > 0
          union all select doc_id, ps, k + 1, case when n + 2 + length(ps[k + 1]) <= 1200 then n + 2 + length(ps[k + 1]) else length(ps[k + 1]) end, case when n + 2 + length(ps[k + 1]) <= 1200 then pos else pos + 1 end from f where k < len(ps))
        select doc_id, pos, arg_max(n, k) n_chars from f group by doc_id, pos""",
    "paragraphs": r"""with d as (select doc_id, text from documents where text is not null),
        s as (select doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\n{2,}'), lambda x: trim(x)), lambda x: x <> '') bl,
          list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') se from d),
        p as (select doc_id, case when len(bl) > 1 then bl when len(se) <= 3 then [trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))]
          else list_transform(range(0, len(se), 4), lambda i: trim(regexp_replace(array_to_string(se[i + 1:i + 4], ' '), '[ \t\n\x0B\f\r]+', ' ', 'g'))) end ps from s),
        u as (select doc_id, unnest(ps) p, unnest(range(len(ps))) pos from p)
        select doc_id, pos, length(p) n_chars from u where p <> ''""",
    "element_types": r"""with d as (select text t, list_filter(regexp_split_to_array(text, '\n+'), lambda x: trim(x) <> '') rs from documents where text is not null),
        f as (select t, len(rs) n, len(list_filter(rs, lambda x: regexp_matches(trim(x), '\S\s{2,}\S'))) sp, len(list_filter(rs, lambda x: regexp_matches(trim(x), '^[0-9]+(\s+[0-9]+(/[0-9]+)?)+'))) nu,
          len(list_filter(rs, lambda x: regexp_matches(trim(x), '^[\p{L}][\p{L}\s-]*\s*[:–—]\s*[0-9].*$', 's'))) pa from d)
        select case when regexp_matches(t, '(?m)^\s*[•*–-]\s+\S') then 'list' when contains(t, '|') or regexp_matches(t, '[0-9]+\s+[x×]\s*[0-9]') or (n >= 2 and (sp >= 2 or nu >= 1 or pa >= 2)) then 'table'
          when length(t) < 80 and t = upper(t) then 'header' else 'text' end kind, count(*) documents from f group by 1""",
    "word_windows": r"""with w as (select doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') ws from documents where text is not null),
        s as (select doc_id, ws, unnest(range(0, len(ws), 80)) s from w where len(ws) > 0)
        select doc_id, s // 80 pos, len(ws[s + 1:s + 100]) n_words, md5(array_to_string(ws[s + 1:s + 100], ' ')) digest from s""",
    "section_chunks": r"""with r as (select distinct id, documentId, sectionPath, chunkIndex, content from document_chunks where content is not null),
        s as (select documentId, sectionPath, coalesce(chunkIndex // 1000, -1) slice, count(*) n, sum(greatest(1, ceil(length(content) / 4))) t, min(chunkIndex) a, max(chunkIndex) b,
          md5(string_agg(md5(content), '' order by chunkIndex nulls first, id)) d from r group by 1, 2, 3)
        select documentId, sectionPath, sum(n)::bigint n, sum(t)::bigint tokens, min(a) first_index, max(b) last_index, md5(string_agg(d, '' order by slice)) digest from s group by documentId, sectionPath""",
}
