"""Queries of what questions ask for and of the normalising of names, codes and addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvasir.functions import intent as I
from kvasir.functions import text as T
from kvasir.functions import unicode as U
from kvasir.operators import route as R
from kvasir.plans import store
from kvasir.sources.tables import table

BRANDS, OWN = ("norvitt", "норвитт", "brelko", "брелко", "quendra", "квендра"), ("talvex", "тальвекс")
STAGES = ("routing", "policy", "retrieval", "answer", "moderation", "history")


def _asked(spark, d):
    rows = table(spark, d, "chat_history").where("query is not null").select("id", "query")
    return rows


def _once(df, *keys):
    return df.dropDuplicates(list(keys))


def source_policy(spark, d):
    rows = _asked(spark, d).select("id", I.catalog_only(F.col("query")).alias("catalog_only"), I.is_comparison(F.col("query")).alias("comparison"))
    return _once(rows, "id")


def product_questions(spark, d):
    q = F.col("query")
    return _once(_asked(spark, d).select("id", I.has_product(q).alias("product"), I.task_targets(q).alias("targets"), I.names_product_only(q).alias("bare")), "id")


def competitor_questions(spark, d):
    """Product groups for whose replacement a question would be one for another maker's product."""
    asked = table(spark, d, "product_groups").select("id", F.concat(F.lit("Есть ли аналог для "), "name").alias("query"))
    return asked.where(I.asks_competitor(F.col("query"), BRANDS, OWN)).select("id").distinct()


def intent_keywords(spark, d):
    q = F.col("query")
    return _once(_asked(spark, d).select("id", I.asks_installation(q).alias("installation"), I.asks_catalog(q).alias("catalog")), "id")


def catalog_detectors(spark, d):
    q = F.col("query")
    rows = _asked(spark, d).select("id", I.attribute(q).alias("attribute"), I.block(q).alias("block"), I.quick_mode(q).alias("mode"), I.too_generic(q).alias("generic"))
    return _once(rows, "id")


def confident_matches(spark, d):
    """Titles that a search finds and that surely are what it asks for."""
    asked = table(spark, d, "faq_entries").select(F.col("id").alias("query_id"), "title").distinct().where("query_id % 20 = 0")
    names = table(spark, d, "product_groups").select("id", "name").distinct()
    hits = R.title_score(asked.select("query_id", F.col("title").alias("text")), names.select("id", F.col("name").alias("title")))
    both = hits.join(asked, "query_id").join(names, "id")
    return both.select("query_id", "id", I.confident(F.col("title"), F.col("name")).alias("confident"))


def rewritten_queries(spark, d):
    """Whether a question's folded words may stand for it in the search: if they keep all its numbers."""
    q = F.col("query")
    return _once(_asked(spark, d).select("id", I.keeps_numbers(q, R.words(q)).alias("kept")), "id")


def answer_checks(spark, d):
    rows = table(spark, d, "chat_history").where("response is not null").select("id", I.refuses(F.col("response")).alias("refuses"), I.ends_open(F.col("response")).alias("open"))
    return _once(rows, "id")


def stage_trace(spark, d):
    """How many exchanges went through each stage; stages that an exchange has no trace of are filled in as skipped."""
    chat = table(spark, d, "chat_history")
    took = [
        ("routing", I.asks_installation(F.col("query")) | I.asks_catalog(F.col("query"))), ("policy", I.catalog_only(F.col("query"))), ("retrieval", F.col("documentsUsed") > 0),
        ("answer", F.col("response").isNotNull()), ("history", F.col("sessionId").isNotNull()),
    ]
    seen = chat.select("id", F.explode(F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in took)), lambda s: s.isNotNull())).alias("stage"))
    return R.stage_counts(seen, chat.select("id"), STAGES)


def rule_groups(spark, d):
    """Questions without a rule by the documents they aim at and their words, as candidates for a rule."""
    asked = _asked(spark, d)
    routed = R.route(asked.select("id", F.col("query").alias("text")), store._rules(spark))
    terms = F.array_sort(F.array_distinct(F.transform(T.match_tokens(F.col("query")), T.stem)))
    rows = asked.select("id", I.task_targets(F.col("query")).alias("targets"), F.array_join(terms, " ").alias("terms")).where("terms <> ''")
    rows = _once(rows, "id").join(routed, "id", "left_anti")
    return R.group_traces(rows).select("key", "targets", "n", "first_id")


def accepted_rules(spark, d):
    """The rules with the most frequent questions of each added to their terms."""
    asked = _asked(spark, d).select("id", F.col("query").alias("text"))
    words = _once(asked.select("id", F.trim(R.words(F.col("text"))).alias("term")), "id")
    hits = R.route(asked, store._rules(spark)).select("id", "rule").join(words, "id").groupBy("rule", "term").agg(F.count(F.lit(1)).alias("n"))
    return R.accept_terms(store._rules(spark), hits, 2)


def routed_types(spark, d):
    """Questions by the kinds of documents their rule sends them to."""
    routed = store.route_rules(spark, d).select("id", F.explode(R.document_types(F.col("rule"))).alias("docType"))
    return routed.groupBy("docType").agg(F.count(F.lit(1)).alias("questions"))


def answer_path(spark, d):
    """The first step that decides how an exchange is answered, with how many of the three exchanges before it its session has."""
    chat = table(spark, d, "chat_history")
    q = F.coalesce("query", F.lit(""))
    step = (
        F.when(I.asks_competitor(q, BRANDS, OWN), "competitor").when(I.names_product_only(q), "ask for the task").when(I.too_generic(q), "ask for the product")
        .when(I.catalog_only(q), "catalogue").when(I.asks_installation(q), "installation").otherwise("search")
    )
    history = R.session_history(_once(chat.select("id", "sessionId", "createdAt"), "id"), "sessionId")
    return _once(chat.select("id", step.alias("step")), "id").join(history, "id", "left").fillna(0, ["previous"])


def sku_words(spark, d):
    return _asked(spark, d).select("id", F.explode(F.array_distinct(T.sku_candidates(F.col("query")))).alias("word")).distinct()


def previews(spark, d):
    chunks = table(spark, d, "document_chunks").where("content is not null").select("id", F.md5(T.preview(F.col("content"), 80)).alias("digest"))
    return _once(chunks, "id")


def model_names(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(T.models(F.col("title"), ("TALVEX",))), "|").alias("models")).where("models <> ''")


def section_names(spark, d):
    rows = table(spark, d, "sections").select("id", T.section_name(F.concat(F.coalesce("sectionPath", F.lit("")), F.lit(" "), "title")).alias("name"))
    return rows.where("name is not null").distinct()


def content_names(spark, d):
    rows = table(spark, d, "document_chunks").select("id", T.name_from_content(F.col("content")).alias("name")).where("name is not null")
    return _once(rows.select("id", F.md5("name").alias("digest")), "id")


def family_lines(spark, d):
    markers = F.array_join(T.family_markers(F.concat_ws(" ", "title", "filename"), ("talvex",)), "|")
    return table(spark, d, "documents").groupBy(markers.alias("family")).agg(F.count(F.lit(1)).alias("documents"))


def category_keys(spark, d):
    rows = table(spark, d, "product_groups").select("id", T.category_key(F.col("name")).alias("category"))
    return rows.distinct()


def safe_filenames(spark, d):
    raw = F.concat(F.lit("a/b%20c/"), F.coalesce("title", "filename"), F.lit("%3F:x.pdf"))
    return table(spark, d, "documents").select("doc_id", T.safe_filename(raw, 40).alias("name"))


def link_extensions(spark, d):
    url = F.concat(F.lit("https://host.example/"), "filename", F.lit("?v=1#top"))
    rows = table(spark, d, "documents").where("filename is not null").select(T.has_extension(url, "pdf").alias("pdf"), T.has_extension(url, ".md").alias("md"))
    return rows.groupBy("pdf", "md").agg(F.count(F.lit(1)).alias("documents"))


def bare_titles(spark, d):
    rows = table(spark, d, "product_groups").select("id", T.without_prefix(F.col("name"), "Коллектор").alias("name"))
    return rows.distinct()


def document_kinds(spark, d):
    rows = table(spark, d, "faq_entries").select("id", T.document_kind(F.col("title")).alias("kind")).distinct()
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def element_kinds(spark, d):
    rows = table(spark, d, "document_chunks").select("id", T.element_kind(F.col("elementType"), F.contains("content", F.lit("|"))).alias("kind")).distinct()
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def first_pages(spark, d):
    rows = table(spark, d, "sections").select("id", T.first_page(F.concat_ws("-", "pageStart", "pageEnd")).alias("page"))
    return rows.distinct()


def variant_keys(spark, d):
    of = lambda k: F.get_json_object("chunkMetadata", f"$.{k}")
    key = T.variant_key(of("productVariantNormalized"), of("variantNormalized"), of("heading"), F.col("sectionPath"))
    rows = table(spark, d, "document_chunks").select("id", key.alias("variant")).distinct()
    return rows.groupBy("variant").agg(F.count(F.lit(1)).alias("chunks"))


def normalized_tokens(spark, d):
    words = table(spark, d, "products").where("name is not null").select(F.explode(F.split("name", " ")).alias("word")).distinct()
    return words.select("word", F.length(U.normalize_token(F.col("word"))).alias("letters"), F.array_join(U.slug_words(F.col("word")), "-").alias("slug"))


def match_words(spark, d):
    rows = table(spark, d, "sections").select("id", F.array_join(T.match_tokens(F.col("title")), "|").alias("words"))
    return rows.distinct()


def token_estimates(spark, d):
    t = F.col("text")
    size = lambda c, n: F.sum(c).cast("bigint").alias(n)
    docs = table(spark, d, "documents")
    return docs.agg(size(T.tokens_or_none(t), "context"), size(T.estimate_tokens(F.coalesce(t, F.lit(""))), "ingest"), size(T.tokens_at_least_words(t), "manual"))


def faq_answers(spark, d):
    rows = table(spark, d, "faq_entries").select("id", F.md5(T.faq_answer(F.col("content"), "\nответ:")).alias("digest")).where("digest is not null")
    return _once(rows, "id")


def technical_blocks(spark, d):
    rows = table(spark, d, "documents").select("doc_id", T.technical_block(F.col("text")).alias("b")).where("b is not null")
    return rows.select("doc_id", F.length("b").alias("n_chars"), F.md5("b").alias("digest"))


def answer_texts(spark, d):
    rows = table(spark, d, "chat_history").where("response is not null").select("id", F.md5(T.answer_spacing(F.col("response"))).alias("digest"))
    return _once(rows, "id")


QUERIES = {
    f.__name__: f
    for f in (
        source_policy, product_questions, competitor_questions, intent_keywords, catalog_detectors, confident_matches, rewritten_queries, answer_checks, stage_trace,
        rule_groups, accepted_rules, routed_types, answer_path, sku_words, previews, model_names, section_names, content_names, family_lines, category_keys,
        safe_filenames, link_extensions, bare_titles, document_kinds, element_kinds, first_pages, variant_keys, normalized_tokens, match_words, token_estimates,
        faq_answers, technical_blocks, answer_texts,
    )
}


def _fold(text: str) -> str:
    return f"replace(lower({text}), 'ё', 'е')"


def _has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern}')"


def _words(n: str, *words: str) -> str:
    return "(" + " or ".join(f"contains({n}, '{w}')" for w in words) + ")"


_WS = r"[ \t\n\x0B\f\r]"
_N_WORDS = rf"len(list_filter(regexp_split_to_array(l, '{_WS}+'), lambda w: w <> ''))"
_CHAT = f"c as (select distinct on (id) *, query q, {_fold('query')} l from chat_history)"
_Q = f"with q as (select distinct id, query q, {_fold('query')} l from chat_history where query is not null)"
_CATALOG_ONLY = f"{_has('l', I.TASK)} and not {_has('l', I.NOT_CATALOG)}"
_TARGETS = f"case when {_has('l', 'совмест')} then 'installation,catalog' when {_has('l', 'монтаж|установ|подключ|эксплуатац')} then 'installation' else 'catalog' end"
_BARE = f"({_N_WORDS} <= 12 and {_has('l', I.PRODUCT)} and not {_has('l', I.PRODUCT_TASK)} and not {_has('l', I.PRODUCT_TOPIC)})"
_T = r"trim(regexp_replace(l, '[^\p{L}\p{N}\p{M}]+', ' ', 'g'))"
_OWN_SQL = "(^| )((из (каталога|ассортимента)|у) ({0})|({0}) (взамен|вместо|на замену))( |$)".format("|".join(OWN))
_COMPETITOR = (
    f"({_has(_T, I.FOLLOW_UP)} or ({_has(_T, I.REPLACEMENT)} and not {_has(_T, _OWN_SQL)} and ({_has(_T, I.OTHER_MAKER)} or "
    + " or ".join(f"contains(' ' || {_T} || ' ', ' {b} ')" for b in BRANDS) + ")))"
)
_INSTALL, _CATALOG = _words("l", *I.INSTALLATION), _words("l", *I.CATALOG)
_GENERIC = (
    f"({_has('l', I.GENERIC)} and not ({_has('l', I.PRODUCT)} or {_has('l', 'артикул|sku|модель|серия|[0-9]{3}')} or "
    rf"regexp_matches(q, '(^|{_WS})[А-ЯЁA-Z]{{2,8}}({_WS}|$)')) and {_N_WORDS} <= 4)"
)
_MATCH = "list_filter(string_split(trim(regexp_replace(lower({0}), '[^0-9a-zа-яё]+', ' ', 'g')), ' '), lambda w: length(w) >= 3)"
_MODELS = r"""list_distinct(list_filter(list_transform(regexp_extract_all(regexp_replace(trim(regexp_replace(regexp_replace(upper({0}), '[‐‑–—]', '-', 'g'), '\s+', ' ', 'g')), '([^A-ZА-Я0-9-])', '\1\1', 'g'),
    '(?:^|[^A-ZА-Я0-9])([A-Z][A-Z0-9]+(?:-[A-ZА-Я0-9]+)*)(?:$|[^A-ZА-Я0-9])', 1), lambda c: regexp_replace(regexp_replace(c, '-Н$', '-H'), '-С$', '-C')), lambda c: not regexp_matches(c, '^({1})$')))"""
_IDENT = "select {0} from ({1})"
ORACLES = {
    "source_policy": f"{_Q} select id, {_CATALOG_ONLY} catalog_only, {_has('l', 'сравн|сопостав')} and contains(l, 'каталог') and contains(l, 'паспорт') comparison from q",
    "product_questions": f"{_Q} select id, {_has('l', I.PRODUCT)} product, {_TARGETS} targets, {_BARE} bare from q",
    "competitor_questions": f"""with q as (select distinct id, replace(lower('Есть ли аналог для ' || "name"), 'ё', 'е') l from product_groups) select distinct id from q where {_COMPETITOR}""",
    "accepted_rules": store.ORACLES["route_rules"].join(("with z as (", f"""),
        w as (select distinct id, trim({store._WORDS}) t from chat_history where query is not null), n as (select "rule", t, count(*) n from z join w using (id) group by all),
        e as (select "rule", t from n qualify row_number() over (partition by "rule" order by n desc, t) <= 2 union select * from (values {", ".join(f"('{name}', '{t}')" for _, name, _, ts in store.RULES for t in ts)}))
        select "rule", string_agg(t, '|' order by t) terms from e group by 1""")),
    "intent_keywords": f"{_Q} select id, {_INSTALL} installation, {_CATALOG} \"catalog\" from q",
    "catalog_detectors": f"""{_Q} select id, case {" ".join(f"when {_words('l', *ws)} then '{n}'" for n, ws in I.ATTRIBUTES)} end attribute,
        case when {_has('l', 'описан|о товаре|для чего|назначен')} then 'description' when {_has('l', 'техническ.*характерист|тех.*характерист')} then 'technical'
          when {_has('l', 'артикул|номенклатур')} then 'articles' when {_has('l', 'размер.*бухт|вес.*бухт|высота.*бухт|внешн.*диаметр.*бухт')} then 'coils' end block,
        case when {_has('l', '[0-9]{3}|труб|фитинг|коллектор|радиатор|серия|модель|артикул|sku')} then case when {_has('l', 'описан|что это|о товаре|для чего')} then 'description'
          when {_has('l', 'характеристик|параметр|таблиц')} and not {_has('l', 'толщин|диаметр|давлен|температур|материал|длин')} then 'technical'
          when not {_has('l', I.QUESTION)} and {_N_WORDS} <= 6 then 'product' end end "mode", {_GENERIC} generic from q""",
    "confident_matches": store.ORACLES["title_search"].replace("select * from h qualify", ", hh as (select * from h qualify").rstrip() + rf"""),
        b as (select hh.query_id, hh.id, {_fold('f.title')} l, {_fold('g2."name"')} t from hh join (select distinct id, title from faq_entries) f on f.id = hh.query_id join (select distinct id, "name" from product_groups) g2 on g2.id = hh.id),
        n as (select *, regexp_extract_all(l, '[0-9]{{3,}}') ns, list_filter(regexp_split_to_array(l, '{_WS}+'), lambda w: length(w) >= 4 and not regexp_matches(w, '^(описание|технические|характеристик[аи]|артикулы?|какая|какой|какие|сколько)$')) ws from b)
        select query_id, id, case when len(ns) > 0 then len(list_filter(ns, lambda x: contains(t, x))) > 0 else len(ws) > 0 and len(list_filter(ws, lambda w: contains(t, w))) >= greatest(1, ceil(len(ws) * 0.5)) end confident from n""",
    "rewritten_queries": rf"""{_Q}, w as (select id, q, ' ' || trim(regexp_replace(l, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ' w from q)
        select id, len(list_filter(regexp_extract_all(q, '[0-9]+(?:[.,][0-9]+)?'), lambda n: not contains(w, n))) = 0 kept from w""",
    "answer_checks": f"""with r as (select distinct on (id) id, response a, {_fold('response')} l from chat_history where response is not null)
        select id, {_has('l', I.REFUSALS)} refuses, regexp_matches(a, '[^\\s\\p{{Z}}]') and not regexp_matches(a, '[.!?…:;)»"|][\\s\\p{{Z}}]*$') "open" from r""",
    "stage_trace": f"""with {_CHAT}, s as (select id, unnest(['routing', 'policy', 'retrieval', 'answer', 'moderation', 'history']) stage, coalesce({_INSTALL} or {_CATALOG}, false) r, coalesce({_CATALOG_ONLY}, false) p,
          coalesce(documentsUsed > 0, false) d, response is not null a, sessionId is not null h from c)
        select stage, case when case stage when 'routing' then r when 'policy' then p when 'retrieval' then d when 'answer' then a when 'history' then h else false end then 'success' else 'skipped' end status, count(*) n from s group by all""",
    "rule_groups": f"""with {store._CHAT}, q as (select id, query, {_fold('query')} l, {store._WORDS} w from chat where query is not null),
        u as (select id, {_TARGETS} targets, array_to_string(list_sort(list_distinct(list_transform({_MATCH.format('query')}, lambda w: {T.sql_stem('w')}))), ' ') terms from q where {store._RULE_CASES} = 999)
        select sha256(targets || '|' || terms) "key", targets, count(*) n, min(id) first_id from u where terms <> '' group by targets, terms having count(*) >= 2""",
    "routed_types": store.ORACLES["route_rules"].replace("select id, case k", "select id, case k", 1).join(("with z as (", """),
        y as (select unnest(case "rule" when 'installation' then ['installation', 'instruction'] else ["rule"] end) docType from z) select docType, count(*) questions from y group by 1""")),
    "answer_path": f"""with {_CHAT}, h as (select id, least(3, row_number() over (partition by sessionId order by createdAt, id) - 1)::bigint previous from c where sessionId is not null and createdAt is not null),
        e as (select id, coalesce(q, '') q, coalesce(l, '') l from c)
        select id, case when {_COMPETITOR} then 'competitor' when {_BARE} then 'ask for the task' when {_GENERIC} then 'ask for the product' when {_CATALOG_ONLY} then 'catalogue' when {_INSTALL} then 'installation' else 'search' end step,
          coalesce(previous, 0) previous from e left join h using (id)""",
    "sku_words": rf"""{_Q} select distinct id, upper(regexp_replace(unnest(regexp_extract_all(q, '(?i)\b[а-яa-z0-9]{{2,}}[-–/]?[а-яa-z0-9]{{2,}}\b')), '[-–]', '', 'g')) word from q""",
    "previews": "select distinct id, md5(case when length(content) > 80 then left(content, 80) || '…' else content end) digest from document_chunks where content is not null",
    "model_names": f"with m as (select doc_id, array_to_string(list_sort({_MODELS.format('title', T.NO_MODELS + '|TALVEX')}), '|') models from documents) select * from m where models <> ''",
    "section_names": r"""with n as (select distinct id, regexp_replace(trim(coalesce(sectionPath, '') || ' ' || title), '^[0-9]+(\.[0-9]+)*\.?\s*', '') "name" from sections)
        select * from n where "name" <> '' and not regexp_matches(replace(lower("name"), 'ё', 'е'), '^(страница\s*[0-9]+|номенклатура|характеристики|технические характеристики|каталог|root)$')""",
    "content_names": r"""with f as (select distinct id, regexp_replace(trim(regexp_replace(regexp_split_to_array(content, '\n|\|')[1], '(?i)[ \t\n\x0B\f\r]+Артикул\s*:.*', '')), '^[0-9]+(\.[0-9]+)*\.?\s*', '') n from document_chunks)
        select id, md5(n) digest from f where n <> '' and not regexp_matches(replace(lower(n), 'ё', 'е'), '^(страница\s*[0-9]+|номенклатура|характеристики|технические характеристики|каталог|root)$')""",
    "family_lines": r"""with m as (select array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(lower(concat_ws(' ', title, filename)), '[a-z][a-z0-9]*(?:-[a-z0-9]+)*'), lambda w: replace(w, '-', '')),
          lambda w: length(w) >= 3 and w not in ('pdf', 'catalog', 'catalogue', 'doc', 'talvex') and not regexp_matches(w, '^(dn|pn|v|rev|ver)[0-9]+$')))), '|') family from documents)
        select family, count(*) documents from m group by 1""",
    "category_keys": r"""select distinct id, trim(regexp_replace(replace(lower("name"), 'ё', 'е'), '[_\s]+', ' ', 'g')) category from product_groups""",
    "safe_filenames": r"""with n as (select doc_id, trim(regexp_replace(coalesce(title, filename) || '?:x.pdf', '[<>:"/\\|?*\x00-\x1f]', '_', 'g')) n from documents)
        select doc_id, case when length(n) > 40 then left(n, 36) || '.pdf' else n end "name" from n""",
    "link_extensions": "select ends_with(lower(filename), '.pdf') pdf, ends_with(lower(filename), '.md') md, count(*) documents from documents where filename is not null group by all",
    "bare_titles": r"""with t as (select distinct id, trim(regexp_replace("name", '\s+', ' ', 'g')) n from product_groups) select id, case when starts_with(lower(n), 'коллектор') then trim(substr(n, 10)) else n end "name" from t""",
    "document_kinds": """with f as (select distinct id, lower(title) t from faq_entries)
        select case when contains(t, 'каталог') then 'catalog' when regexp_matches(t, 'инструк|пособ') then 'instruction' when contains(t, 'сертифик') then 'certificate' when contains(t, 'паспорт') then 'passport'
          when contains(t, 'гарант') and regexp_matches(t, 'вопрос|faq') then 'warranty_faq' else 'general' end kind, count(*) n from f group by 1""",
    "element_kinds": """with c as (select distinct id, elementType e, content from document_chunks)
        select case when e in ('mixed', 'table') then case when contains(content, '|') then 'table' else 'text' end when e in ('figure', 'list', 'header') then e else 'text' end kind, count(*) n from c group by 1""",
    "first_pages": "select distinct id, coalesce(pageStart, pageEnd) page from sections",
    "variant_keys": """with c as (select distinct id, coalesce(nullif(trim(chunkMetadata->>'$.productVariantNormalized'), ''), nullif(trim(chunkMetadata->>'$.variantNormalized'), ''), nullif(trim(chunkMetadata->>'$.heading'), ''), nullif(trim(sectionPath), '')) v
          from (select id, case when json_valid(chunkMetadata) then chunkMetadata::json end chunkMetadata, sectionPath from document_chunks))
        select trim(regexp_replace(lower(v), '[^a-z0-9а-яё]+', ' ', 'g')) variant, count(*) chunks from c group by 1""",
    "match_words": f"select distinct id, array_to_string({_MATCH.format('title')}, '|') words from sections",
    "token_estimates": rf"""select sum(case when coalesce(text, '') = '' then 0 else greatest(1, ceil(length(text) / 4)) end)::bigint context, sum(greatest(1, ceil(length(coalesce(text, '')) / 4)))::bigint ingest,
        sum(case when coalesce(text, '') = '' then 0 else greatest(len(list_filter(regexp_split_to_array(trim(text), '{_WS}+'), lambda w: w <> '')), floor(length(text) / 4 + 0.5)) end)::bigint manual from documents""",
    "faq_answers": """with f as (select distinct on (id) id, content c, strpos(lower(content), chr(10) || 'ответ:') p from faq_entries) select id, md5(trim(substr(c, p + 7))) digest from f where p > 0 and trim(substr(c, p + 7)) <> ''""",
    "technical_blocks": r"""with t as (select doc_id, substr(text, strpos(lower(text), 'технические характеристики')) t from documents where contains(lower(text), 'технические характеристики')),
        b as (select doc_id, trim(regexp_replace(t, '\n##.*$', '', 's')) b from t) select doc_id, length(b) n_chars, md5(b) digest from b""",
    "answer_texts": r"""select distinct id, md5(trim(regexp_replace(regexp_replace(replace(response, chr(160), ' '), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'))) digest from chat_history where response is not null""",
}
