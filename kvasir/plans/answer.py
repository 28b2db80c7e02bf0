"""Queries of boosted retrieval and of what answers are put together from."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvasir.functions import intent as I
from kvasir.functions import text as T
from kvasir.operators import answer as A
from kvasir.operators import boost as B
from kvasir.operators import catalog as C
from kvasir.operators import chunk
from kvasir.operators import score as S
from kvasir.plans import chunk as chunk_plans
from kvasir.plans import score as plans
from kvasir.sources.tables import cut, table


def _cells(spark, d):
    return chunk.pipe_tables(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", "col")


def tables_markdown(spark, d):
    found = A.table_markdown(_cells(spark, d), ["doc_id", "table_no"])
    return found.select("doc_id", "table_no", F.md5("markdown").alias("digest"), F.length("markdown").alias("n_chars"))


def stripped_texts(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(A.strip_tables(F.col("text"))).alias("digest"))


def table_headings(spark, d):
    rows = table(spark, d, "documents").select("doc_id", A.table_heading(F.col("text")).alias("heading")).where("heading is not null")
    return rows.select("doc_id", F.md5("heading").alias("digest"))


def inserted_tables(spark, d):
    text = A.insert_table(F.col("text"), F.lit("технические характеристики"), F.lit("[таблица]"), F.lit("| a |"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(text).alias("digest"))


def attribute_rows(spark, d):
    found = A.rows_with(_cells(spark, d), ["doc_id", "table_no"], ("25", "масса"))
    return found.groupBy("doc_id", "table_no").agg(F.countDistinct("row_no").alias("rows"))


def missing_tables(spark, d):
    """Tables of catalogues that no instruction has."""
    prints = C.table_fingerprints(_cells(spark, d), ["doc_id", "table_no"]).join(table(spark, d, "documents").select("doc_id", "docType"), "doc_id")
    rows = cut(prints.select("fingerprint", "docType", F.concat_ws("/", "doc_id", "table_no").alias("table_key")))
    return A.missing_tables(rows.where("docType = 'catalog'"), rows.where("docType = 'instruction'"))


def section_bundles(spark, d):
    rows = table(spark, d, "document_chunks").where("content is not null").withColumn("relevance", (1 / (1 + F.col("chunkIndex"))).cast("double"))
    return A.bundle(rows, 0.05).withColumn("relevance", F.round("relevance", 9))


def _hits(spark, d):
    hits = plans._section_hits(spark, d)
    meta = plans._of_hits(hits, table(spark, d, "document_chunks").select("id", "documentId", "sectionPath", "chunkIndex"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("documentId"), "docType", "title", "filename")
    return hits.join(meta, "id").join(docs, "documentId", "left")


def _asked(spark, d):
    t = F.col("text")
    return plans._faq_queries(spark, d).withColumns({"installation": I.asks_installation(t), "catalog": I.asks_catalog(t)})


def kinds_for_intent(spark, d):
    return A.kinds_for_intent(_hits(spark, d).join(_asked(spark, d), "query_id")).select("query_id", "id")


def boosted_variants(spark, d):
    rows = _hits(spark, d).withColumn("variant", F.substring_index("sectionPath", ".", 1)).withColumn("boosted", F.col("docType") == "catalog")
    return A.boosted_variants(rows).select("query_id", "id")


def retrieval_diagnostics(spark, d):
    hits = _hits(spark, d)
    after = S.context_caps(hits.select("query_id", "id", "documentId", "relevance"), most=8)
    order = F.row_number().over(S.Window.partitionBy("query_id").orderBy("doc_rank", F.desc("relevance"), "id"))
    return A.diagnostics(hits, after.withColumn("rank", order))


def header_product_ids(spark, d):
    rows = table(spark, d, "document_chunks").select("id", A.product_id(F.col("content")).alias("sku")).where("sku is not null")
    return rows.distinct()


def raw_answer_allowed(spark, d):
    hits = _hits(spark, d).where("rank <= 2")
    texts = plans._of_hits(hits, table(spark, d, "document_chunks").select("id", F.substring("content", 1, 1).alias("content")))
    return A.raw_answer_allowed(hits.join(texts, "id"))


def active_prompts(spark, d):
    rows = table(spark, d, "faq_entries").select("createdBy", "createdAt", "id", F.md5("content").alias("digest")).distinct().where("createdAt is not null")
    return A.newest_active(rows, "createdBy", "createdAt", "id", "digest")


def company_files(spark, d):
    rows = A.whole_or_parts(table(spark, d, "documents").where("text is not null").select("doc_id", "text", "docType"), "text", 250)
    return rows.groupBy("docType", "whole").agg(F.count(F.lit(1)).alias("files"), F.sum("tokens").alias("tokens"))


def rewritten_lines(spark, d):
    text = A.rewrite_lines(F.col("text"), r"^## ([^\n]*)$", "**$1**")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(text).alias("digest"))


def history_tokens(spark, d):
    """What the record of an exchange counts as its tokens, against what was noted."""
    size = T.tokens_or_none(F.col("query")) + T.tokens_or_none(F.col("response"))
    rows = table(spark, d, "chat_history").select("id", "source", size.alias("counted"), "tokensUsed").dropDuplicates(["id"])
    return rows.groupBy("source").agg(F.sum("counted").alias("counted"), F.sum("tokensUsed").alias("noted"))


def newest_documents(spark, d):
    """The twenty newest indexed documents with a name."""
    docs = table(spark, d, "documents").where("status = 'indexed' and filename is not null and createdAt is not null")
    return docs.orderBy(F.desc("createdAt"), F.desc("doc_id")).limit(20).select("doc_id", "filename")


def distinctive_terms(spark, d):
    return _asked(spark, d).select("query_id", F.array_join(F.array_sort(F.array_distinct(B.distinctive(T.tokens(F.col("text"))))), "|").alias("terms"))


def title_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.tokens(B.title_source(F.col("title"), F.col("filename"))), "|").alias("terms"))


def sku_document_boost(spark, d):
    """How many products of each document have the number that a search asks for, in any spelling."""
    own = table(spark, d, "products").select("id", "documentId", F.upper(F.regexp_replace("sku", "[-–]", "")).alias("sku")).distinct()
    asked = own.where("id % 20 = 0").select(F.col("id").alias("query_id"), "sku")
    return asked.join(own, "sku").groupBy("query_id", "documentId").agg(F.count(F.lit(1)).alias("products"))


def _boosted(spark, d):
    low = lambda c: T.fold(F.coalesce(c, F.lit("")))
    asked = _asked(spark, d).select("query_id", "installation", "catalog", low(F.col("text")).alias("query"), T.tokens(F.col("text")).alias("q"), F.array_distinct(T.sku_candidates(F.col("text"))).alias("skus"))
    hits = cut(_hits(spark, d).select("query_id", "id", "documentId", "docType", "sectionPath", "relevance", T.tokens(B.title_source(F.col("title"), F.col("filename"))).alias("title")))
    heading = F.get_json_object("chunkMetadata", "$.heading")
    chunks = table(spark, d, "document_chunks").join(F.broadcast(hits.select("id").distinct()) if hits.count() <= 100_000 else hits.select("id").distinct(), "id", "left_semi")
    parts = chunks.select(
        "id", low(F.col("content")).alias("content"), F.substring(low(F.col("content")), 1, 400).alias("head"), F.array_distinct(T.tokens(F.col("content"))).alias("terms"),
        low(F.concat_ws(" ", "sectionPath", heading)).alias("path"), T.tokens(F.coalesce(heading, F.col("sectionPath"))).alias("section"),
    ).dropDuplicates(["id"])
    own = table(spark, d, "products").select("id", "documentId", F.upper(F.regexp_replace("sku", "[-–]", "")).alias("sku")).distinct()
    named = asked.select("query_id", F.explode("skus").alias("sku")).join(own, "sku").groupBy("query_id", "documentId").agg(F.count(F.lit(1)).alias("sku_products"))
    none = F.array().cast("array<string>")
    rows = hits.join(asked, "query_id").join(parts, "id").join(named, ["query_id", "documentId"], "left").fillna(0, ["sku_products"])
    return B.with_boosts(rows.withColumns({"tags": none, "variant": none}))


def rule_boosts(spark, d):
    rows = _boosted(spark, d)
    return rows.select("query_id", "id", F.round("boost", 6).alias("boost"), F.array_join("reasons", ",").alias("reasons"))


def hybrid_boosted(spark, d):
    """The lexical hits with their boosts, of searches without a vector."""
    rows = S.normalized(_boosted(spark, d), "relevance")
    score = F.round(B.fused(F.lit(None).cast("double"), F.col("norm"), F.col("boost"), F.lit(False)), 6)
    return S.top_k(rows.select("query_id", "id", score.alias("score")), 5).select("query_id", "id", "score", "rank")


QUERIES = {
    f.__name__: f
    for f in (
        tables_markdown, stripped_texts, table_headings, inserted_tables, attribute_rows, missing_tables, section_bundles, kinds_for_intent, boosted_variants, retrieval_diagnostics,
        header_product_ids, raw_answer_allowed, active_prompts, company_files, rewritten_lines, history_tokens, newest_documents, distinctive_terms, title_terms, sku_document_boost,
        rule_boosts, hybrid_boosted,
    )
}

_CELLS = chunk_plans._TABLES.replace("cells as (select doc_id, table_no, row_no, hs[k] h, k,", "cells as (select doc_id, table_no, row_no, hs[k] h, k - 1 k,").replace(
    "named as (select doc_id, table_no, row_no, case when h = '' then 'column ' || k else h end", "named as (select doc_id, table_no, row_no, k col, case when h = '' then 'column ' || (k + 1) else h end"
)
_TITLE = "coalesce(case when trim(title) <> '' then title end, regexp_replace(regexp_replace(filename, '[.][^.]+$', ''), '[_-]+', ' ', 'g'))"
_STEMS = lambda c: f"list_transform({T.sql_raw_tokens(c)}, lambda w: {T.sql_stem('w')})"
_SPACED = r"trim(regexp_replace(regexp_replace(replace({0}, chr(160), ' '), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'))"
_SKUS = r"list_distinct(list_transform(regexp_extract_all({0}, '(?i)\b[а-яa-z0-9]{{2,}}[-–/]?[а-яa-z0-9]{{2,}}\b'), lambda w: upper(regexp_replace(w, '[-–]', '', 'g'))))"
_H = plans._BM25 + """, hh as (select rk.query_id, rk.id, rk.score relevance, rank, c4.documentId, c4.sectionPath, docType, d.title, filename from rk join (select distinct id, documentId, sectionPath from document_chunks) c4 using (id)
    left join documents d on d.doc_id = c4.documentId where rank <= 10)"""
_FAQ = "fa as (select distinct id query_id, title txt, replace(lower(title), 'ё', 'е') l from faq_entries where id % 20 = 0)"
_WORDS = lambda words: "(" + " or ".join(f"contains(l, '{w}')" for w in words) + ")"
_INTENT = f"fi as (select *, {_WORDS(I.INSTALLATION)} ins, {_WORDS(I.CATALOG)} cat from fa)"
_GENERIC = ", ".join(f"'{g}'" for g in B.GENERIC_STEMS)
_RULES = """
  ('section_match', len(list_intersect(section, asked)) > 0, 0.1), ('manufacturer_guarantee_penalty', maker and not contains(qy, 'гарант') and contains(path, 'гарант'), -0.7),
  ('manufacturer_guarantee_phrase_penalty', maker and not contains(qy, 'гарант') and contains(content, 'производитель гарантирует'), -0.4), ('manufacturer_section_bonus', maker and contains(path, 'изготов'), 0.8),
  ('manufacturer_section_soft_bonus', maker and not contains(path, 'изготов') and contains(path, 'производ') and not contains(path, 'гарант'), 0.35), ('title_match', ov > 0, 0.08),
  ('title_coverage', ov > 0 and (ov / len(ti) >= 0.5 or (ov >= 2 and ov / greatest(len(q), 1) >= 0.4)), 0.32 * least(1.0, greatest(ov / len(ti), ov / greatest(len(q), 1)))),
  ('title_strong_match', ov >= 2 and ov / len(ti) >= 0.75, 0.2), ('missing_distinctive_terms', missed, case when ins then -0.55 else -0.35 end), ('distinctive_title_hit', not missed and tit, case when ins then 0.28 else 0.18 end),
  ('distinctive_content_hit', not missed and not tit and con and ins, 0.12),
  ('installation_nomenclature_penalty', ins and man and (contains(path, 'номенклатур') or contains(head, '[таблица номенклатуры') or (contains(head, 'артикул') and not regexp_matches(head, 'монтаж|установ|подключ|креплен'))), -0.4),
  ('sku_match_chunk', len(list_filter(skus, lambda s: contains(upper(regexp_replace(content, '[-–]', '', 'g')), s))) > 0, 0.12), ('sku_match_document', len(skus) > 0 and np > 0, least(0.12 * np, 0.24)),
  ('installation_instruction_priority', ins and man, 0.2), ('installation_catalog_penalty', ins and pro, -0.075), ('catalog_priority', cat and pro, 0.15), ('catalog_instruction_penalty', cat and man, -0.075),
  ('term_overlap', te > 0, 0.05 * least(te, 4)), ('radiator_keyword', ins and contains(qy, 'радиатор') and contains(content, 'радиатор'), 0.35),
  ('radiator_section', ins and contains(qy, 'радиатор') and (starts_with(path, '1.5') or contains(path, 'радиатор')), 0.175),
  ('heat_meter_keyword', ins and contains(qy, 'теплосчет') and mh, 0.35), ('heat_meter_mismatch', ins and contains(qy, 'теплосчет') and not mh and man, -0.25)
"""
_BOOST = (
    _H
    + f""", {_FAQ}, {_INTENT},
    ck as (select distinct on (id) id, replace(lower(coalesce(content, '')), 'ё', 'е') content, list_distinct({_STEMS('content')}) terms, replace(lower(concat_ws(' ', sectionPath, hd)), 'ё', 'е') path, coalesce(hd, sectionPath) sc
      from (select id, content, sectionPath, case when json_valid(chunkMetadata) then chunkMetadata->>'$.heading' end hd from document_chunks)),
    np as (select query_id, documentId, count(*) np from (select query_id, unnest({_SKUS.format('txt')}) sku from fi) a join (select distinct id, documentId, upper(regexp_replace(sku, '[-–]', '', 'g')) sku from products) p using (sku) group by all),
    x0 as (select hh.query_id, hh.id, relevance, docType, fi.l qy, {_STEMS('txt')} q, {_SKUS.format('txt')} skus, ins, cat, ck.content, left(ck.content, 400) head, coalesce(terms, []) terms, path, coalesce({_STEMS('sc')}, []) section,
        coalesce({_STEMS(_TITLE)}, []) ti, coalesce(np, 0) np
      from hh join fi using (query_id) join ck on ck.id = hh.id left join np on np.query_id = hh.query_id and np.documentId = hh.documentId),
    x1 as (select *, regexp_matches(qy, 'производ|изготов') maker, list_filter(q, lambda t: length(t) >= 4 and t not in ({_GENERIC})) own, coalesce(docType = 'instruction', false) man, coalesce(docType = 'catalog', false) pro from x0),
    x2 as (select *, case when maker then list_concat(q, ['производител', 'производитель', 'изготовител', 'изготовитель']) else q end asked, len(list_filter(own, lambda t: list_contains(ti, t))) > 0 tit,
      len(list_filter(own, lambda t: list_contains(terms, t) or contains(content, t) or len(list_filter(terms, lambda y: starts_with(y, left(t, 6)) or starts_with(t, left(y, 6)))) > 0)) > 0 con,
      len(list_filter(list_distinct(q), lambda t: list_contains(terms, t))) te, len(list_filter(ti, lambda t: starts_with(t, 'теплосчет'))) > 0 or contains(content, 'теплосчет') mh from x1),
    x3 as (select *, len(list_filter(ti, lambda t: list_contains(asked, t))) ov, len(own) > 0 and ((cat and pro) or man) and not tit and not con missed from x2)
"""
)


def _rule_list() -> list[tuple[str, str, str]]:
    """The rules of the SQL as reason, condition and amount."""
    out, depth, part, parts = [], 0, "", []
    for ch in _RULES.strip():
        depth += (ch == "(") - (ch == ")")
        if ch == "(" and depth == 1:
            part, parts = "", []
        elif ch == ")" and depth == 0:
            out.append((*parts, part))
        elif ch == "," and depth == 1:
            parts.append(part)
            part = ""
        else:
            part += ch
    return [(a.strip().strip("'"), ",".join(b).strip(), c.strip()) for a, *b, c in out]


_TOTAL = " + ".join(f"case when {cond} then {amount} else 0 end" for _, cond, amount in _rule_list())
_REASONS = "concat_ws(',', " + ", ".join(f"case when {cond} then '{n}' end" for n, cond, _ in _rule_list()) + ")"
_BOOST += f", bo as (select query_id, id, relevance, ({_TOTAL})::double boost, {_REASONS} reasons from x3) "
ORACLES = {
    "tables_markdown": _CELLS + r""", n0 as (select *, case when regexp_matches(lower("name"), 'характеристик') then 0 when regexp_matches(lower("name"), 'ед.? ?изм|единиц') then 1 when regexp_matches(lower("name"), 'значение') then 2 else 3 end s
          from named where not regexp_matches("name", '^[0-9-]+$') and trim("name") <> ''),
        n1 as (select *, case when (select count(distinct s) from n0 x where x.doc_id = n0.doc_id and x.table_no = n0.table_no and s < 3) >= 2 then s else 3 end so, trim(replace(regexp_replace("name", '[ \t]+', ' ', 'g'), '|', '\|')) hn,
          trim(replace(regexp_replace("value", '[ \t]+', ' ', 'g'), '|', '\|')) vn from n0),
        r0 as (select doc_id, table_no, row_no, '| ' || string_agg(vn, ' | ' order by so, col, vn) || ' |' t, '| ' || string_agg(hn, ' | ' order by so, col, hn) || ' |' h, count(*) n from n1 group by all),
        m as (select doc_id, table_no, max_by(h, n) || chr(10) || '|' || repeat(' --- |', max(n)::int) || chr(10) || string_agg(t, chr(10) order by row_no, t) md from r0 group by all)
        select doc_id, table_no, md5(md) digest, length(md) n_chars from m""",
    "stripped_texts": rf"""with s as (select doc_id, regexp_replace(regexp_replace(text, '(?mi)^.*таблиц.*(?:\n|$)', '', 'g'), '(?m)^[ \t]*\|.*\n[ \t]*\|.*\|?[ \t]*---.*(?:\n[ \t]*\|.*)*\n?', '', 'g') t from documents where text is not null)
        select doc_id, md5({_SPACED.format('t')}) digest from s""",
    "table_headings": """with f as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') ls from documents),
        h as (select doc_id, list_filter(list_reverse(ls[greatest(len(ls) - 7, 1):]), lambda x: regexp_matches(replace(lower(x), 'ё', 'е'), 'таблиц|номенклатур|размер|характеристик') or (ends_with(x, ':') and length(x) <= 80))[1] h from f)
        select doc_id, md5(h) digest from h where h is not null""",
    "inserted_tables": r"""with t as (select doc_id, text, strpos(lower(text), 'технические характеристики') p from documents where text is not null),
        a as (select *, substr(text, p + 26) z from t), b as (select *, case when p > 0 then regexp_extract(z, '^[ \t\n\x0B\f\r]*:') else '' end col from a)
        select doc_id, md5(case when p > 0 then trim(regexp_replace(left(text, p + 25) || col, '[ \t\n\x0B\f\r]+$', '') || chr(10) || chr(10) || '| a |' || chr(10) || regexp_replace(substr(z, length(col) + 1), '^[ \t\n\x0B\f\r]+', ''), ' ')
          else trim(trim(text, ' ') || chr(10) || chr(10) || '[таблица]' || chr(10) || '| a |', ' ') end) digest from b""",
    "attribute_rows": _CELLS + """select doc_id, table_no, count(distinct row_no) "rows" from named where contains(lower("name" || ' ' || "value"), '25') or contains(lower("name" || ' ' || "value"), 'масса') group by all""",
    "missing_tables": _CELLS + r""", x as (select doc_id, table_no, row_no, "name", lower(regexp_replace("value", '\s+', '', 'g')) v from named),
        f as (select doc_id, table_no, md5(string_agg("name" || '=' || v, '|' order by row_no, "name", v)) fingerprint from x group by all), g as (select f.*, docType from f join documents using (doc_id))
        select fingerprint, min(doc_id || '/' || table_no) table_key from g where docType = 'catalog' and fingerprint not in (select fingerprint from g where docType = 'instruction') group by 1""",
    "section_bundles": """with r as (select distinct id, documentId, coalesce(sectionPath, '#' || chunkIndex) "section", chunkIndex, content from document_chunks where content is not null),
        s as (select documentId, "section", coalesce(chunkIndex // 1000, -1) slice, count(*) n, sum(greatest(1, ceil(length(content) / 4))) t, max(1 / (1 + chunkIndex)) rel, min(chunkIndex) f, md5(string_agg(md5(content), '' order by chunkIndex nulls first, id)) d from r group by 1, 2, 3)
        select documentId, "section", sum(n)::bigint n, sum(t)::bigint tokens, round(greatest(max(rel), 0.05), 9) relevance, min(f) first_index, md5(string_agg(d, '' order by slice)) digest from s group by 1, 2""",
    "kinds_for_intent": _H + f", {_FAQ}, {_INTENT} select query_id, hh.id from hh join fi using (query_id) where case when ins then docType in ('instruction', 'installation') when cat then docType = 'catalog' else true end",
    "boosted_variants": _H + """, v as (select *, string_split(sectionPath, '.')[1] va, docType = 'catalog' bo from hh), s as (select *, bool_or(bo and va is not null) over (partition by query_id) some_ from v)
        select query_id, id from s where not some_ or (query_id, va) in (select query_id, va from s where bo)""",
    "header_product_ids": r"""with t as (select distinct id, nullif(regexp_extract(content, '(?i)(?:артикул|article|artikel|sku)\s*:?\s*([\p{L}0-9][\p{L}0-9-]+)', 1), '') a, nullif(regexp_extract(content, '\b([A-Z]{2}-[0-9]{2}-[0-9]{4})\b', 1), '') b,
          nullif(regexp_extract(content, '(?:^|[^0-9])([0-9]{4,6})(?:$|[^0-9])', 1), '') c from document_chunks) select id, coalesce(a, b, c) sku from t where coalesce(a, b, c) is not null""",
    "raw_answer_allowed": _H + """, k as (select distinct id, content from document_chunks), j as (select query_id, hh.documentId, hh.sectionPath, docType, left(content, 1) c from hh join k using (id) where rank <= 2)
        select query_id, bool_and(coalesce(docType = 'catalog', false) and coalesce(length(trim(c, ' ')), 0) > 0) and count(distinct (documentId, coalesce(sectionPath, ''))) = 1 and count(*) <= 2 allowed from j group by 1""",
    "active_prompts": "select createdBy, arg_max(md5(content), (createdAt, id)) digest from faq_entries where createdAt is not null group by 1",
    "company_files": "with t as (select docType, greatest(1, ceil(length(text) / 4))::bigint n from documents where text is not null) select docType, n <= 250 whole, count(*) files, sum(n)::bigint tokens from t group by all",
    "rewritten_lines": r"select doc_id, md5(regexp_replace(text, '(?m)^## ([^\n]*)$', '**\1**', 'g')) digest from documents where text is not null",
    "history_tokens": """with c as (select distinct on (id) * from chat_history), t as (select "source", case when coalesce(query, '') = '' then 0 else greatest(1, ceil(length(query) / 4)) end + case when coalesce(response, '') = '' then 0 else greatest(1, ceil(length(response) / 4)) end n, tokensUsed u from c)
        select "source", sum(n)::bigint counted, sum(u)::bigint noted from t group by 1""",
    "newest_documents": "select doc_id, filename from documents where status = 'indexed' and filename is not null and createdAt is not null order by createdAt desc, doc_id desc limit 20",
    "distinctive_terms": f"with {_FAQ} select query_id, array_to_string(list_sort(list_distinct(list_filter({_STEMS('txt')}, lambda t: length(t) >= 4 and t not in ({_GENERIC})))), '|') terms from fa",
    "title_terms": f"select doc_id, array_to_string({_STEMS(_TITLE)}, '|') terms from documents",
    "sku_document_boost": f"""with p as (select distinct id, documentId, upper(regexp_replace(sku, '[-–]', '', 'g')) sku from products), a as (select id query_id, sku from p where id % 20 = 0)
        select query_id, documentId, count(*) products from a join p using (sku) group by all""",
    "rule_boosts": _BOOST + "select query_id, id, round(boost, 6) boost, reasons from bo",
    "hybrid_boosted": _BOOST + """, fu as (select query_id, id, round(0.85 * relevance / greatest(max(relevance) over (partition by query_id), 0.0001) + least(greatest(boost, -0.5), 0.85), 6) score from bo)
        select *, row_number() over (partition by query_id order by score desc, id) rank from fu qualify rank <= 5""",
}
