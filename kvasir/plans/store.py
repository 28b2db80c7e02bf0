"""Queries of the store, its statistics, links and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvasir.operators import moderate as M
from kvasir.operators import route as R
from kvasir.operators import store as S
from kvasir.functions import text as T
from kvasir.sources.tables import spread, table

# Neutral words, so that the scan has work on any corpus: 60 words and 140 phrases.
NOUNS = "труба фитинг редуктор клапан коллектор радиатор насос кран заглушка муфта тройник переходник термостат счетчик".split()
KINDS = "стальной медный латунный обратный шаровой балансировочный настенный напольный узкий широкий".split()
WORDS = """кольцо давлени* расход гайка ниппель шток паспорт срок гаранти* монтаж опрессов* чугун бронза латунь шкаф пресс* pump steel ring pressure* valve
    nut gasket strainer glycol boiler manifold radiator drossel* ventil* dichtung heizkörper gusseisen messing montage prüfung joint vanne laiton fonte
    raccord notice garantie débit bague""".split()
TERMS = (*WORDS, *NOUNS, *(f"{k} {n}" for k in KINDS for n in NOUNS))
EXCEPTIONS = ("срок службы", "press fitting")
FALLBACK = "withheld"
RULES = (
    (1, "installation", True, ("монтаж*", "how do i install", "montiere")),
    (2, "warranty", True, ("гаранти*", "warranty", "garantie")),
    (3, "certificate", True, ("сертификат*", "certificate", "zertifikat", "certificat")),
    (4, "disabled", False, ("а", "the")),
)


def _chat(spark, d):
    return table(spark, d, "chat_history").dropDuplicates(["id"])


def scoped_chunks(spark, d):
    docs = table(spark, d, "documents").where("status = 'indexed' and docType in ('catalog', 'instruction')").select("doc_id", "docType")
    chunks = table(spark, d, "document_chunks").select("id", "documentId", "sectionPath").distinct()
    chunks = chunks.where((F.col("sectionPath") == "1") | F.col("sectionPath").startswith("1."))
    return chunks.join(docs, F.col("documentId") == F.col("doc_id")).select("id", "documentId", "docType", "sectionPath")


def faq_as_chunks(spark, d):
    chunks = table(spark, d, "document_chunks").select("id", "documentId", F.length("content").alias("n")).distinct()
    faq = table(spark, d, "faq_entries").select((F.col("id") + 1_000_000_000).alias("id"), F.lit(0).cast("bigint").alias("documentId"), F.length("content").alias("n")).distinct()
    return chunks.unionByName(faq).select("id", "documentId", F.col("n").cast("bigint").alias("n"))


def page_offset(spark, d):
    rows = _chat(spark, d).select("id", "createdAt").where("createdAt is not null")
    return S.page(rows, [F.desc("createdAt"), F.desc("id")], 25, 2)


def next_index(spark, d):
    return S.next_index(table(spark, d, "document_chunks"))


def chunk_profile(spark, d):
    return S.processing_profile(table(spark, d, "document_chunks"))


def annotation_join(spark, d):
    """The last labelled region of every document page."""
    regions = table(spark, d, "manual_regions").select("id", "documentId", "pageNumber", "regionType").dropDuplicates(["id"])
    pages = table(spark, d, "document_chunks").select("documentId", "pageNumber").distinct()
    found = S.with_last_annotation(pages, regions, ["documentId", "pageNumber"], F.desc("id"))
    return found.where("regionType is not null").select("documentId", "pageNumber", "id", "regionType")


def faq_search(spark, d):
    faq = table(spark, d, "faq_entries").select("id", "title", "answerText").distinct()
    return S.search_text(faq, "Гарант", "title", "answerText").select("id")


def cascade_delete(spark, d):
    gone = table(spark, d, "deletion_log").where("entity = 'document'").select(F.col("entityId").alias("doc_id"))
    names = ("document_chunks", "sections", "products", "product_groups", "manual_regions")
    left = S.without_deleted({n: (table(spark, d, n).select("id", "documentId").distinct(), "documentId") for n in names}, gone)
    return S.inventory(left)


def documents_per_source(spark, d):
    docs = table(spark, d, "documents").groupBy("syncSourceId").agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, d, "knowledge_sync_sources").select("id", "name").join(docs, F.col("id") == F.col("syncSourceId"), "left")
    return rows.select("id", "name", F.coalesce("n", F.lit(0)).alias("documents"))


def upsert_sections(spark, d):
    """Sections with those of the latest day delivered again, one level deeper."""
    dated = table(spark, d, "sections").select("id", "level", F.to_date("createdAt").alias("day")).distinct()
    last = dated.agg(F.max("day").alias("last"))
    fresh = dated.join(F.broadcast(last), F.col("day") == F.col("last")).select("id", (F.col("level") + 1).alias("level"))
    return S.upsert(dated.select("id", "level"), fresh, ["id"]).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def daily_stats(spark, d):
    return S.daily_statistics(table(spark, d, "chat_history"))


def daily_stats_open_ended(spark, d):
    chat = table(spark, d, "chat_history")
    return S.daily_statistics_open(chat, chat.where("createdAt is not null").select(F.to_date("createdAt").alias("day")))


def assistant_totals(spark, d):
    return S.assistant_totals(table(spark, d, "chat_history"))


def popular_questions(spark, d):
    return S.popular(_chat(spark, d), "query", 20)


def stats_trend(spark, d):
    days = S.daily_statistics(table(spark, d, "chat_history").where("createdAt < '2030-01-01'")).select("day", "exchanges")
    last = days.agg(F.max("day").alias("last"))
    return days.join(F.broadcast(last), F.col("day") > F.date_sub("last", 30)).select("day", "exchanges")


def origin_counters(spark, d):
    return S.first_last(table(spark, d, "events"), F.col("event_type"), "ts")


def content_hash(spark, d):
    return S.content_hashes(table(spark, d, "documents"), "doc_id", "text")


def sync_actions(spark, d):
    """What a run over all sources would do: an address is a document's text type and title, stored is its first upload, found its last one."""
    docs = table(spark, d, "documents").where("syncSourceId is not null and title is not null")
    docs = docs.select(F.concat_ws("/", "docType", "title").alias("url"), "doc_id", "createdAt", "status", F.col("syncSourceId").alias("source"), F.md5("text").alias("hash"))
    first = docs.where("status <> 'processing'").withColumn("hash", F.when(F.col("status") == "indexed", F.col("hash")))
    stored = S.latest(first, ["url"], F.asc("createdAt"), F.asc("doc_id")).select("url", "hash", "source")
    found = S.latest(docs.where("status <> 'failed'"), ["url"], F.desc("createdAt"), F.desc("doc_id")).select("url", "hash", "source")
    return S.sync_actions(stored, found).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def inventory_counts(spark, d):
    names = ("documents", "document_chunks", "sections", "products", "product_groups", "manual_regions", "faq_entries", "chat_history")
    return S.inventory({n: table(spark, d, n) for n in names})


def char_coverage(spark, d):
    """Characters of each document that its words don't have: what tokenising leaves out."""
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    words = docs.select("doc_id", F.array_join(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), 0), "").alias("text"))
    return S.lost_characters(docs, words, "doc_id", "text")


def _rules(spark):
    rows = [(no, name, on, i, t) for no, name, on, terms in RULES for i, t in enumerate(terms)]
    return spark.createDataFrame(rows, "rule_no int, rule string, enabled boolean, term_no int, term string")


def route_rules(spark, d):
    asked = table(spark, d, "chat_history").where("query is not null").select("id", F.col("query").alias("text"))
    return R.route(asked, _rules(spark))  # repeated records come together there


def session_history_lag(spark, d):
    return R.session_history(_chat(spark, d), "sessionId")


def rule_recommendations(spark, d):
    """Groups of equal questions that no enabled rule matches, over all records."""
    chat = _chat(spark, d).where("query is not null")
    traces = chat.select("id", F.trim(R.words(F.col("query"))).alias("key"), F.col("query").alias("text")).where("key <> ''")
    asked = traces.select(F.col("key").alias("id"), F.col("key").alias("text")).distinct()
    known = R.route(asked, _rules(spark)).select(F.col("id").alias("key"))
    return R.recommendations(traces, known)


def hierarchy_walk(spark, d):
    rows = table(spark, d, "sections").select("id", "documentId", "sectionPath").distinct()
    return R.walk_up(rows)


def title_search(spark, d):
    faq = table(spark, d, "faq_entries").select("id", "title").distinct().where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("title").alias("text"))
    titles = table(spark, d, "product_groups").select("id", F.col("name").alias("title")).distinct()
    return R.title_score(faq, titles)


def typo_qualifier(spark, d):
    """Words of documents' texts that are one letter apart."""
    words = table(spark, d, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{6,}"), 0))).alias("w"))
    return R.one_edit_apart(words, "w", "w")


def sku_lookup(spark, d):
    """Products by number in one spelling with their group, section and document."""
    p = table(spark, d, "products").select("id", "documentId", "sectionId", "groupId", T.sku_key(F.col("sku")).alias("sku")).distinct().where("sku is not null")
    g = table(spark, d, "product_groups").select(F.col("id").alias("groupId"), F.col("name").alias("group_name")).distinct()
    s = table(spark, d, "sections").select(F.col("id").alias("sectionId"), F.col("title").alias("section_title")).distinct()
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("documentId"), "docType")
    return p.join(docs, "documentId").join(g, "groupId", "left").join(s, "sectionId", "left").select("id", "sku", "documentId", "docType", "group_name", "section_title")


def section_detail(spark, d):
    s = table(spark, d, "sections").select("id", "documentId", "sectionPath").distinct()
    c = table(spark, d, "document_chunks").select("id", "documentId", "sectionPath").distinct().groupBy("documentId", "sectionPath").agg(F.count(F.lit(1)).alias("chunks"))
    p = table(spark, d, "products").select("id", "sectionId").distinct().groupBy("sectionId").agg(F.count(F.lit(1)).alias("products"))
    out = s.join(c, ["documentId", "sectionPath"], "left").join(p, s.id == p.sectionId, "left")
    return out.select("id", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("products", F.lit(0)).alias("products"))


def topic_availability(spark, d):
    kinds = spark.createDataFrame([(k,) for k in ("catalog", "company", "instruction", "passport", "installation", "certificate", "general", "warranty_faq", "other")], "docType string")
    have = table(spark, d, "documents").where("status = 'indexed'").groupBy("docType").agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(have, "docType", "left").select("docType", F.coalesce("n", F.lit(0)).alias("documents"))


def product_attributes(spark, d):
    """The attributes of products, of each number the last filled value."""
    rows = table(spark, d, "products").select("id", T.sku_key(F.col("sku")).alias("sku"), "attributes").distinct().where("sku is not null")
    flat = rows.select("id", "sku", F.explode(F.from_json("attributes", "map<string,string>")).alias("name", "value")).where("value is not null and value <> ''")
    return S.latest(flat, ["sku", "name"], F.desc("id")).select("sku", "name", "value")


def region_overlap(spark, d):
    """Pairs of regions of a page that cover at least half of one of them."""
    box = F.from_json("coordinates", "bbox struct<x:double,y:double,width:double,height:double>")["bbox"]
    r = table(spark, d, "manual_regions").select("id", "documentId", "pageNumber", box.alias("b")).dropDuplicates(["id"]).where("b is not null and b.width > 0 and b.height > 0")
    a, b = (r.select(F.col("id").alias(f"id_{n}"), "documentId", "pageNumber", F.col("b").alias(n)) for n in "ab")
    pairs = a.join(b, ["documentId", "pageNumber"]).where("id_a < id_b")
    wide = F.greatest(F.lit(0.0), F.least(F.expr("a.x + a.width"), F.expr("b.x + b.width")) - F.greatest("a.x", "b.x"))
    high = F.greatest(F.lit(0.0), F.least(F.expr("a.y + a.height"), F.expr("b.y + b.height")) - F.greatest("a.y", "b.y"))
    share = wide * high / F.least(F.expr("a.width * a.height"), F.expr("b.width * b.height"))
    return pairs.select("id_a", "id_b", F.round(share, 6).alias("share")).where("share >= 0.5")


def moderation_scan(spark, d):
    chat = spread(table(spark, d, "chat_history").select("id", "response"))
    return M.scan(chat, "id", "response", list(TERMS), list(EXCEPTIONS)).dropDuplicates(["id"])


def moderation_gate(spark, d):
    """Answers with their session's name as a label, by whether and why they are withheld."""
    chat = table(spark, d, "chat_history").select("id", "response", F.col("source").alias("label"))
    held = M.gate(chat, "id", "response", ["label"], "\n".join(TERMS[:40]), FALLBACK, exceptions="\n".join(EXCEPTIONS))
    return held.groupBy("blocked", "reason").agg(F.count(F.lit(1)).alias("n"))


def moderation_journal(spark, d):
    """What the journal keeps of the blocked answers."""
    chat = table(spark, d, "chat_history").select("id", "response", "createdAt")
    hits = M.scan(chat, "id", "response", ["website", "Talvex"]).dropDuplicates(["id"])
    return M.journal(hits.join(chat.dropDuplicates(["id"]), "id").where("createdAt is not null"), "response", "createdAt")


def journal_retention(spark, d):
    return M.retained(table(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("id"), "ts"), "ts")


QUERIES = {
    f.__name__: f
    for f in (
        scoped_chunks, faq_as_chunks, page_offset, next_index, chunk_profile, annotation_join, faq_search, cascade_delete, documents_per_source, upsert_sections,
        daily_stats, daily_stats_open_ended, assistant_totals, popular_questions, stats_trend, origin_counters, content_hash, sync_actions, inventory_counts,
        char_coverage, route_rules, session_history_lag, rule_recommendations, hierarchy_walk, title_search, typo_qualifier, sku_lookup, section_detail,
        topic_availability, product_attributes, region_overlap, moderation_scan, moderation_gate, moderation_journal, journal_retention,
    )
}

_CHAT = "chat as (select distinct on (id) * from chat_history)"
_MEASURES = """count(*) exchanges, sum(case when "source" = 'website' then 1 else 0 end)::bigint website, sum(case when "source" = 'bitrix24' then 1 else 0 end)::bigint bitrix24,
    sum(case when "source" = 'test' then 1 else 0 end)::bigint test, round(avg(responseTime), 2) "mean_responseTime", round(avg(tokensUsed), 2) "mean_tokensUsed" """
_WORDS = r"' ' || trim(regexp_replace(replace(lower(query), 'ё', 'е'), '[^\p{L}\p{N}]+', ' ', 'g')) || ' '"
_RULE_CASES = "least(" + ", ".join(
    f"case when contains(w, ' {t.rstrip('*')}{'' if t.endswith('*') else ' '}') then {no * 10 + i} else 999 end" for no, _, on, ts in RULES if on for i, t in enumerate(ts)
) + ")"
_RULE_NAMES = " ".join(f"when {no * 10 + i} then '{name}'" for no, name, on, ts in RULES if on for i, t in enumerate(ts))
_RULE_TERMS = " ".join(f"when {no * 10 + i} then '{t}'" for no, name, on, ts in RULES if on for i, t in enumerate(ts))
ORACLES = {
    "scoped_chunks": """select distinct c.id, c.documentId, d.docType, c.sectionPath from document_chunks c join documents d on c.documentId = d.doc_id
        where d.status = 'indexed' and d.docType in ('catalog', 'instruction') and (c.sectionPath = '1' or starts_with(c.sectionPath, '1.'))""",
    "faq_as_chunks": """select distinct id, documentId, length(content) n from document_chunks union all select distinct id + 1000000000, 0, length(content) from faq_entries""",
    "page_offset": f"with {_CHAT} select id, createdAt from chat where createdAt is not null order by createdAt desc, id desc limit 25 offset 50",
    "next_index": "select documentId, (coalesce(max(chunkIndex), -1) + 1)::bigint next from document_chunks group by documentId",
    "chunk_profile": """with c as (select distinct on (id) * from document_chunks) select documentId, count(*) chunks, sum(case when embedding is not null then 1 else 0 end)::bigint with_vector,
        sum(case when elementType = 'table' then 1 else 0 end)::bigint tables, count(distinct pageNumber) pages, sum(tokenCount)::bigint tokens from c group by documentId""",
    "annotation_join": """select r.documentId, r.pageNumber, r.id, r.regionType from (select distinct id, documentId, pageNumber, regionType from manual_regions) r
        join (select distinct documentId, pageNumber from document_chunks) p using (documentId, pageNumber)
        qualify row_number() over (partition by r.documentId, r.pageNumber order by r.id desc) = 1""",
    "faq_search": "select distinct id from faq_entries where contains(lower(title), 'гарант') or contains(lower(answerText), 'гарант')",
    "cascade_delete": " union all ".join(
        f"select '{n}' \"name\", count(*) n from (select distinct id, documentId from {n}) where documentId is null or documentId not in (select entityId from deletion_log where entity = 'document' and entityId is not null)"
        for n in ("document_chunks", "sections", "products", "product_groups", "manual_regions")
    ),
    "documents_per_source": "select k.id, k.name, count(d.doc_id) documents from knowledge_sync_sources k left join documents d on d.syncSourceId = k.id group by all",
    "upsert_sections": """with r as (select distinct id, "level", createdAt::date "day" from sections)
        select case when "day" = (select max("day") from r) then "level" + 1 else "level" end "level", count(*) n from r group by 1""",
    "daily_stats": f"with {_CHAT} select createdAt::date \"day\", {_MEASURES} from chat where createdAt is not null group by 1",
    "daily_stats_open_ended": f"""with {_CHAT}, p as (select createdAt::date d0, count(*) n from chat where createdAt is not null group by 1)
        select d0 "day", sum(n) over (order by d0 desc)::bigint exchanges from p""",
    "assistant_totals": f"with {_CHAT} select {_MEASURES} from chat",
    "popular_questions": f"with {_CHAT} select query, count(*) n from chat where query is not null group by query order by n desc, query limit 20",
    "stats_trend": f"""with {_CHAT}, p as (select createdAt::date "day", count(*) exchanges from chat where createdAt < '2030-01-01' group by 1)
        select "day", exchanges from p where "day" > (select max("day") from p) - 30""",
    "origin_counters": "select event_type origin, count(*) n, min(ts) first_seen, max(ts) last_seen from events group by 1",
    "content_hash": "select doc_id, sha256(text) hash from documents",
    "sync_actions": """with d as (select doc_id, createdAt c, status, concat_ws('/', docType, title) url, syncSourceId s, md5(text) h from documents where syncSourceId is not null and title is not null),
        st as (select url, case when status = 'indexed' then h end h, s from d where status <> 'processing' qualify row_number() over (partition by url order by c nulls first, doc_id) = 1),
        f as (select url, h, s from d where status <> 'failed' qualify row_number() over (partition by url order by c desc nulls last, doc_id desc) = 1),
        j as (select st.s os, f.s fs, st.h oh, f.h fh, st.url u, f.url fu from st full join f on st.url = f.url)
        select case when u is null then 'add' when fu is null and os in (select s from f) then 'orphan' when fu is null then 'same' when os <> fs then 'conflict'
          when oh is null then 'restore' when oh <> fh then 'update' else 'same' end "action", count(*) n from j group by 1""",
    "inventory_counts": " union all ".join(
        f"select '{n}' \"name\", count(*) n from {n}" for n in ("documents", "document_chunks", "sections", "products", "product_groups", "manual_regions", "faq_entries", "chat_history")
    ),
    "route_rules": f"with {_CHAT}, q as (select id, {_WORDS} w from chat where query is not null), r as (select id, {_RULE_CASES} k from q) select id, case k {_RULE_NAMES} end \"rule\", case k {_RULE_TERMS} end term from r where k < 999",
    "session_history_lag": f"""with {_CHAT} select id, least(3, row_number() over (partition by sessionId order by createdAt, id) - 1)::bigint previous from chat
        where sessionId is not null and createdAt is not null""",
    "rule_recommendations": f"""with {_CHAT}, t as (select id, query, trim({_WORDS}) k from chat where query is not null), u as (select id, query, k from (select *, ' ' || k || ' ' w from t) where k <> '' and {_RULE_CASES} = 999),
        rk as (select *, row_number() over (partition by k order by id) n from u)
        select k "key", count(*) n, string_agg(query, ' | ' order by id) filter (n <= 3) examples from rk group by k having count(*) >= 2""",
    "hierarchy_walk": """with s as (select distinct id, documentId, sectionPath from sections),
        p as (select id, documentId, string_split(sectionPath, '.') ps from s where sectionPath is not null),
        u as (select id, documentId, ps, unnest(range(1, least(len(ps), 4) + 1)) step from p),
        a as (select documentId, sectionPath, min(id) ancestor from s group by all)
        select u.id, u.step, ancestor from u join a on a.documentId = u.documentId and a.sectionPath = array_to_string(ps[1:len(ps) - step], '.') where len(ps) > step""",
    "char_coverage": r"""with d as (select doc_id, lower(text) t from documents where text is not null),
        a as (select doc_id, unnest(regexp_split_to_array(regexp_replace(t, '[ \t\n\x0B\f\r]', '', 'g'), '')) c from d), an as (select doc_id, c, count(*) n from a where c <> '' group by all),
        b as (select doc_id, unnest(regexp_split_to_array(array_to_string(regexp_extract_all(t, '[\p{L}\p{N}]+'), ''), '')) c from d), bn as (select doc_id, c, count(*) n from b where c <> '' group by all)
        select doc_id, sum(greatest(an.n - coalesce(bn.n, 0), 0))::bigint lost from an left join bn using (doc_id, c) group by doc_id""",
    "typo_qualifier": r"""with w as (select distinct unnest(regexp_extract_all(lower(text), '\p{L}{6,}')) w from documents),
        c as (select w, unnest(list_distinct(list_transform(range(1, length(w) + 1), lambda i: left(w, i - 1) || substr(w, i + 1)))) cut from w)
        select least(c.w, w.w) a, greatest(c.w, w.w) b from c join w on c.cut = w.w
        union select x.w, y.w from c x join c y on x.cut = y.cut and x.w < y.w and length(x.w) = length(y.w) and len(list_filter(range(1, length(x.w) + 1), lambda i: x.w[i] <> y.w[i])) = 1""",
    "title_search": f"""with q as (select distinct id query_id, title t from faq_entries where id % 20 = 0), g as (select distinct id, "name" t from product_groups),
        qs as (select distinct query_id, {T.sql_stem("w")} s from (select query_id, unnest(string_split(trim(regexp_replace(replace(lower(t), 'ё', 'е'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')) w from q) where length(w) >= 3),
        gs as (select distinct id, {T.sql_stem("w")} s from (select id, unnest(string_split(trim(regexp_replace(replace(lower(t), 'ё', 'е'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')) w from g) where length(w) >= 3),
        h as (select query_id, id, count(*) hits from qs join gs using (s) group by all)
        select * from h qualify row_number() over (partition by query_id order by hits desc, id) <= 5""",
    "product_attributes": r"""with p as (select distinct id, nullif(regexp_replace(upper(sku), '[^\p{L}\p{N}]', '', 'g'), '') sku, attributes a from products),
        j as (select id, sku, unnest(json_keys(a)) k, a from p where sku is not null and json_valid(a) and json_type(a) = 'OBJECT'),
        v as (select id, sku, k "name", json_extract_string(a, '$."' || k || '"') "value" from j)
        select sku, "name", "value" from v where "value" is not null and "value" <> '' qualify row_number() over (partition by sku, "name" order by id desc) = 1""",
    "sku_lookup": r"""with p as (select distinct id, documentId, sectionId, groupId, nullif(regexp_replace(upper(sku), '[^\p{L}\p{N}]', '', 'g'), '') sku from products)
        select p.id, sku, p.documentId, d.docType, g.name group_name, s.title section_title from p join documents d on d.doc_id = p.documentId
        left join (select distinct id, name from product_groups) g on g.id = p.groupId left join (select distinct id, title from sections) s on s.id = p.sectionId where sku is not null""",
    "section_detail": """with s as (select distinct id, documentId, sectionPath from sections), c as (select documentId, sectionPath, count(distinct id) chunks from document_chunks group by all),
        p as (select sectionId, count(distinct id) products from products group by all)
        select s.id, coalesce(chunks, 0) chunks, coalesce(products, 0) products from s left join c using (documentId, sectionPath) left join p on p.sectionId = s.id""",
    "topic_availability": """select k docType, count(d.doc_id) documents from unnest(['catalog', 'company', 'instruction', 'passport', 'installation', 'certificate', 'general', 'warranty_faq', 'other']) t(k)
        left join documents d on d.docType = k and d.status = 'indexed' group by k""",
    "region_overlap": """with r as (select distinct id, documentId, pageNumber, json_extract(coordinates, '$.bbox.x')::double x, json_extract(coordinates, '$.bbox.y')::double y,
          json_extract(coordinates, '$.bbox.width')::double w, json_extract(coordinates, '$.bbox.height')::double h from manual_regions where json_valid(coordinates)),
        v as (select * from r where w > 0 and h > 0),
        p as (select a.id id_a, b.id id_b, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) / least(a.w * a.h, b.w * b.h) share
          from v a join v b using (documentId, pageNumber) where a.id < b.id)
        select id_a, id_b, round(share, 6) share from p where round(share, 6) >= 0.5""",
    "journal_retention": """with j as (select event_id id, ts from events where event_type = 'error') select id, ts from j where ts >= (select max(ts) from j) - interval 30 days order by ts desc, id limit 100""",
}
