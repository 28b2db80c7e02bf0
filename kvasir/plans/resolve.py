"""Queries of what part of the catalogue questions mean."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvasir.functions import text as T
from kvasir.operators import resolve as R
from kvasir.plans import intent
from kvasir.plans import store
from kvasir.sources.tables import table


def _searches(spark, d):
    """Every question whose id is divisible by 20."""
    return table(spark, d, "chat_history").where("id % 20 = 0 and query is not null").select(F.col("id").alias("query_id"), F.col("query").alias("text")).distinct()


def _headings(spark, d):
    docs = table(spark, d, "documents").where("docType = 'catalog' and status = 'indexed'").select(F.col("doc_id").alias("documentId"))
    return table(spark, d, "sections").select(F.col("title").alias("name"), "documentId", "sectionPath").distinct().join(docs, "documentId")


def model_scope(spark, d):
    return R.model_scope(_searches(spark, d), _headings(spark, d))


def subject_match(spark, d):
    """The one product that a question for the data of a group's name means."""
    names = table(spark, d, "product_groups").select("id", "name").distinct()
    asked = names.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.concat(F.lit("Расскажите про характеристики "), "name").alias("text"))
    return R.subject_match(asked, names.select("name"))


def assortment_questions(spark, d):
    asked = table(spark, d, "chat_history").where("query is not null").select("id", F.array_join(R.families(F.col("query")), "|").alias("families"), R.asks_assortment(F.col("query")).alias("asks"))
    return asked.distinct()


def assortment(spark, d):
    """What there is of the families that FAQ entries and questions name."""
    asked = table(spark, d, "product_groups").select(F.col("id").alias("query_id"), F.concat(F.lit("какие есть "), "name").alias("text")).distinct().where("query_id % 20 = 0")
    groups = table(spark, d, "product_groups").select("name", F.lit("group").alias("kind"), F.lit(1).alias("priority"))
    lines = table(spark, d, "sections").select(F.col("title").alias("name"), F.lit("line").alias("kind"), F.lit(2).alias("priority"))
    items = table(spark, d, "products").where("name is not null").select("name", F.lit("item").alias("kind"), F.lit(0).alias("priority"))
    return R.assortment(asked, groups.unionByName(lines).unionByName(items).distinct())


def title_matches(spark, d):
    docs = table(spark, d, "documents").where("title is not null and status = 'indexed'").select("doc_id", "title")
    return R.title_matches(table(spark, d, "product_groups").select("id", "name"), docs)


def applicable_documents(spark, d):
    """Passports and certificates bound to the numbers of their products, to their groups' names or, without any, to their own catalogue."""
    p = table(spark, d, "products").select("id", "documentId", "groupId", T.sku_key(F.col("sku")).alias("sku")).distinct().where("sku is not null")
    g = table(spark, d, "product_groups").select(F.col("id").alias("groupId"), F.col("name").alias("label")).distinct()
    matches = p.join(g, "groupId").select("sku", F.col("documentId").alias("catalogId"), "label")
    docs = table(spark, d, "documents").where("docType in ('passport', 'certificate')").select(F.col("doc_id").alias("documentId"), "title")
    none = F.array().cast("array<string>")
    skus = p.join(docs, "documentId").select("documentId", F.array("sku").alias("skus"), none.alias("categories"))
    named = docs.where("title is not null").select("documentId", none.alias("skus"), F.array("title").alias("categories"))
    bindings = skus.unionByName(named).select("*", none.alias("lines"), F.array().cast("array<bigint>").alias("catalogs"))
    return R.applicable(p.select("sku"), matches, bindings)


def document_urls(spark, d):
    return table(spark, d, "documents").select("doc_id", R.document_url(F.col("doc_id"), F.col("title"), "https://host.example/").alias("url"))


def sibling_models(spark, d):
    chat = table(spark, d, "chat_history").select("id", T.models(F.col("query")).alias("m"), "response").where("size(m) = 1 and response is not null")
    return chat.select("id", R.sibling_model(F.col("response"), F.col("m")[0]).alias("sibling")).distinct()


def suggested_topics(spark, d):
    return store.topic_availability(spark, d).where("documents > 0").select(F.col("docType").alias("topic"))


def own_manuals(spark, d):
    """Chunks of the documents whose title shares a product line with a question, of its own model's manual if there is one."""
    asked = _searches(spark, d).select("query_id", T.models(F.col("text")).alias("m")).where("size(m) = 1").select("query_id", F.substring_index(F.col("m")[0], "-", 2).alias("model"))
    docs = table(spark, d, "documents").where("title is not null").select(F.col("doc_id").alias("documentId"), "docType", "title", F.explode(T.models(F.col("title"))).alias("model"))
    return R.own_manuals(asked.join(docs, "model")).select("query_id", "documentId")


QUERIES = {
    f.__name__: f
    for f in (
        model_scope, subject_match, assortment_questions, assortment, title_matches, applicable_documents, document_urls, sibling_models, suggested_topics, own_manuals,
    )
}

_M = lambda c: intent._MODELS.format(c, T.NO_MODELS)
_STEMS = "list_distinct(list_transform(regexp_extract_all(replace(lower({0}), 'ё', 'е'), '[а-яa-z0-9]+'), lambda w: " + T.sql_stem("w") + "))"
_BEGIN = "list_transform(range(1, len(string_split({0}, '-')) + 1), lambda n: array_to_string(string_split({0}, '-')[1:n], '-'))"
_FAMILIES = "list_filter([" + ", ".join(f"'{f}'" for f in R.FAMILIES) + "], lambda f: contains({0}, f))"
ORACLES = {
    "model_scope": f"""with a as (select query_id, m[1] model from (select distinct id query_id, {_M('query')} m from chat_history where id % 20 = 0 and query is not null) where len(m) = 1),
        o as (select distinct s.documentId d, sectionPath p, s.title, {_M('s.title')} codes from sections s join documents on doc_id = s.documentId and docType = 'catalog' and status = 'indexed'
          where not regexp_matches(replace(lower(s.title), 'ё', 'е'), '{R.NOT_OWNER}')),
        ex as (select codes[1] model, count(*) n from o where len(codes) = 1 group by 1), c as (select distinct d, p, unnest(codes) code from o),
        near as (select model, d, p from (select distinct model from a) a join (select d, p, code, unnest({_BEGIN.format('code')}) b from c) c on b = model and code <> model
          union select model, d, p from (select model, unnest({_BEGIN.format('model')}) b from (select distinct model from a)) a join c on code = b and b <> model),
        re as (select model, count(*) n from near group by 1)
        select query_id, a.model, case when ex.n is not null then 'exact' when re.n is not null then 'related' else 'none' end "found", coalesce(ex.n, re.n, 0) sections from a left join ex using (model) left join re using (model)""",
    "subject_match": f"""with a as (select query_id, list_distinct(list_transform(list_filter(regexp_extract_all(replace(lower(q), 'ё', 'е'), '[а-яa-z0-9]+'), lambda w: not regexp_matches(w, '{R.COMMON}')), lambda w: {T.sql_stem("w")})) terms
          from (select distinct id query_id, 'Расскажите про характеристики ' || "name" q from product_groups where id % 20 = 0)),
        b as (select * from a where len(list_filter(terms, lambda t: regexp_matches(t, '^[а-яa-z]{{3,}}$'))) > 0),
        o as (select list_sort({_STEMS.format('n')}) stems, min(n) "name" from (select distinct "name" n from product_groups) where regexp_matches(replace(lower(n), 'ё', 'е'), '{intent.I.PRODUCT}') and not regexp_matches(replace(lower(n), 'ё', 'е'), '{R.NOT_SUBJECT}') group by 1),
        w as (select query_id, "name" from b join o on len(list_intersect(terms, stems)) = len(terms))
        select query_id, min("name") "name" from w group by 1 having count(*) = 1""",
    "assortment_questions": f"""with q as (select distinct id, replace(lower(query), 'ё', 'е') l from chat_history where query is not null)
        select id, array_to_string({_FAMILIES.format('l')}, '|') families, regexp_matches(l, '{R.LISTING}') and not regexp_matches(l, '{R.NOT_LISTING}') and len({_FAMILIES.format('l')}) > 0 asks from q""",
    "title_matches": f"""with g as (select distinct id, {_STEMS.format('"name"').replace("'[а-яa-z0-9]+'", "'[а-яa-z0-9]{3,}'")} s from product_groups),
        t as (select doc_id, {_STEMS.format('title').replace("'[а-яa-z0-9]+'", "'[а-яa-z0-9]{3,}'")} s from documents where title is not null and status = 'indexed')
        select id, doc_id, len(list_intersect(g.s, t.s)) shared from g join t on len(g.s) > 0 and len(list_intersect(g.s, t.s)) >= greatest(least(2, len(g.s)), ceil(len(g.s) * 0.6))""",
    "applicable_documents": r"""with p as (select distinct id, documentId, groupId, nullif(regexp_replace(upper(sku), '[^\p{L}\p{N}]', '', 'g'), '') sku from products),
        m as (select distinct sku, trim(regexp_replace(replace(lower("name"), 'ё', 'е'), '[_\s]+', ' ', 'g')) label from p join (select distinct id, "name" from product_groups) g on g.id = p.groupId where sku is not null),
        d as (select doc_id, trim(regexp_replace(replace(lower(title), 'ё', 'е'), '[_\s]+', ' ', 'g')) t from documents where docType in ('passport', 'certificate')),
        f as (select distinct sku, doc_id, 3 s from p join d on d.doc_id = p.documentId where sku is not null union all select sku, doc_id, 2 from m join d on d.t = m.label)
        select sku, doc_id documentId, max(s)::int score from f group by all""",
    "document_urls": "select doc_id, 'https://host.example/api/documents/' || doc_id || '/' || case when trim(title) <> '' then 'companion' else 'file' end url from documents",
    "sibling_models": f"""with c as (select distinct id, response r, {_M('query')} m from chat_history where response is not null)
        select id, len(list_filter({_M('r')}, lambda x: x <> m[1] and string_split(x, '-')[1] = string_split(m[1], '-')[1])) > 0 sibling from c where len(m) = 1""",
    "suggested_topics": "select distinct docType topic from documents where status = 'indexed' and docType in ('catalog', 'company', 'instruction', 'passport', 'installation', 'certificate', 'general', 'warranty_faq', 'other')",
    "own_manuals": f"""with a as (select query_id, array_to_string(string_split(m[1], '-')[1:2], '-') model from (select distinct id query_id, {_M('query')} m from chat_history where id % 20 = 0 and query is not null) where len(m) = 1),
        t as (select doc_id, docType, {_M('title')} codes from documents where title is not null),
        h as (select query_id, doc_id, model, docType in ('installation', 'instruction') and len(codes) = 1 own from a join t on list_contains(codes, model)),
        f as (select *, bool_or(own) over (partition by query_id) any_own from h) select query_id, doc_id documentId from f where own or not any_own""",
}
