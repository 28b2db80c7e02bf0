"""Queries of retrieval: every row whose id is divisible by 20 is a search, against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvasir.functions import text as T
from kvasir.operators import score as S
from kvasir.operators import search as X
from kvasir.sources.tables import table


def _chunks(spark, d):
    return table(spark, d, "document_chunks").select("id", "documentId", "sectionPath", "chunkIndex").dropDuplicates(["id"])


def _faq_queries(spark, d):
    faq = table(spark, d, "faq_entries").select("id", "title").dropDuplicates(["id"]).where("id % 20 = 0")
    return faq.select(F.col("id").alias("query_id"), F.col("title").alias("text"))


def _bm25(spark, d):
    return S.bm25(_faq_queries(spark, d), table(spark, d, "document_chunks").select("id", "content"), "id", "content")


def _best(spark, d, k):
    return X.bm25_top_k(_faq_queries(spark, d), table(spark, d, "document_chunks").select("id", "content"), "id", "content", k)


def _of_hits(hits, rows):
    """The rows of the hits' ids, each id once; few ids are broadcast, so that no other row is shuffled."""
    ids = hits.select("id").distinct()
    return rows.join(F.broadcast(ids) if ids.count() <= 100_000 else ids, "id", "left_semi").dropDuplicates(["id"])


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _nearest(spark, d, k):
    rows = _vectors(spark, d)
    return S.vector_top_k(S.query_vectors(rows, "id", "vec"), rows, k)


def _relevance(spark, d, k=40):
    return _nearest(spark, d, k).select("query_id", "id", F.col("sim").alias("relevance"))


def corpus_stats(spark, d):
    s = S.corpus_stats(table(spark, d, "document_chunks"), "id", "content")
    return s.select("n", F.round("avg_len", 6).alias("avg_len"))


def document_frequency(spark, d):
    rows = S.postings(table(spark, d, "document_chunks"), "id", "content").where("term is not null")
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def bm25_topk(spark, d):
    rows = _bm25(spark, d).withColumn("score", F.round("score", 6))
    return S.top_k(rows, 10).select("query_id", "id", "score", "rank")


def bm25_faq(spark, d):
    """FAQ entries for the titles of documents."""
    asked = table(spark, d, "documents").where("doc_id % 20 = 0 and title is not null").select(F.col("doc_id").alias("query_id"), F.col("title").alias("text"))
    rows = S.bm25(asked, table(spark, d, "faq_entries").select("id", "content"), "id", "content").withColumn("score", F.round("score", 6))
    return S.top_k(rows, 10).select("query_id", "id", "score", "rank")


def bm25_normalized(spark, d):
    return S.normalized(_best(spark, d, 5)).select("query_id", "id", F.round("norm", 6).alias("norm"))


def l2_norms(spark, d):
    return _vectors(spark, d).select("id", F.round(S.l2_norm(F.col("vec")), 6).alias("norm"))


def vector_topk(spark, d):
    return _nearest(spark, d, 10).select("query_id", "id", F.round("sim", 6).alias("sim"))


def cosine_in_group(spark, d):
    """The mean cosine of the vectors of each label to the label's mean vector."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    parts = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    mean = parts.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("m"))
    mean = mean.select("label", F.transform("m", lambda s: s["x"]).alias("mean"))
    sims = rows.join(mean, "label").select("label", S.cosine(F.col("embedding"), F.col("mean")).alias("sim"))
    return sims.groupBy("label").agg(F.round(F.avg("sim"), 5).alias("mean_sim"), F.count(F.lit(1)).alias("n"))


def hybrid_topk(spark, d):
    """Lexical and vector scores of searches by FAQ entries among all chunks, fused."""
    vec = F.get(S.usable_vectors(F.col("embedding")), F.lit(0)).alias("vec")
    asked = table(spark, d, "faq_entries").select("id", "title", "embedding").dropDuplicates(["id"]).where("id % 20 = 0")
    asked = asked.select(F.col("id").alias("query_id"), F.col("title").alias("text"), vec)
    return X.hybrid_search(asked, table(spark, d, "document_chunks").select("id", "content", vec), "id", "content", "vec", 10)


def threshold_fallback(spark, d):
    rows = _relevance(spark, d).withColumn("relevance", F.round("relevance", 6))
    return S.threshold_with_fallback(rows, "relevance")


def mmr_select(spark, d):
    pool = _relevance(spark, d).join(_vectors(spark, d), "id")
    return S.mmr(pool)


def _section_hits(spark, d):
    return _best(spark, d, 10).select("query_id", "id", F.col("score").alias("relevance"), "rank")


def neighbor_expand(spark, d):
    found = S.neighbours(_section_hits(spark, d).drop("rank"), _chunks(spark, d))
    return found.select("query_id", "id", F.round("relevance", 6).alias("relevance"))


def context_caps(spark, d):
    hits = _section_hits(spark, d)
    hits = hits.join(_of_hits(hits, table(spark, d, "document_chunks").select("id", "documentId")), "id")
    return S.context_caps(hits, most=8).select("query_id", "id", "doc_rank")


def context_pack(spark, d):
    hits = _section_hits(spark, d)
    size = _of_hits(hits, table(spark, d, "document_chunks").select("id", T.estimate_tokens(F.col("content")).alias("tokens")))
    return S.pack_context(hits.join(size, "id"), most_tokens=300, most_chunk=120)


def rerank_apply(spark, d):
    """BM25's hits in the order of the share of the query's words in their first 2,048 characters, which a reranker reads."""
    hits = _section_hits(spark, d)
    asked = _faq_queries(spark, d).select("query_id", F.array_distinct(T.tokens(F.col("text"))).alias("asked"))
    read = T.tokens(F.substring("content", 1, 2048))
    texts = _of_hits(hits, table(spark, d, "document_chunks").where("content is not null")).select("id", read.alias("has"))
    both = hits.select("query_id", "id").join(asked, "query_id").join(texts, "id")
    share = F.round(F.size(F.array_intersect("asked", "has")) / F.size("asked"), 9)
    return S.rerank(hits, both.select("query_id", "id", share.alias("rerank"))).select("query_id", "id", "place")


QUERIES = {
    f.__name__: f
    for f in (
        corpus_stats, document_frequency, bm25_topk, bm25_faq, bm25_normalized, l2_norms, vector_topk, cosine_in_group, hybrid_topk, threshold_fallback,
        mmr_select, neighbor_expand, context_caps, context_pack, rerank_apply,
    )
}

_POST = f"""
c as (select distinct id, content from document_chunks),
w as (select id, list_transform({T.sql_raw_tokens("content")}, lambda w: {T.sql_stem("w")}) ts from c),
dl as (select id, greatest(coalesce(len(ts), 0), 1) dl, ts from w),
p as (select id, dl, unnest(ts) term from dl),
post as (select id, dl, term, count(*) tf from p group by all),
dfs as (select term, count(*) df, sum(tf)::bigint cf from post group by term),
st as (select count(*) n, avg(dl) avg_len from dl)
"""
_BM25 = f"""with {_POST},
q as (select distinct id query_id, title from faq_entries where id % 20 = 0),
qt as (select query_id, unnest(list_transform({T.sql_raw_tokens("title")}, lambda w: {T.sql_stem("w")})) term from q),
qc as (select query_id, term, count(*) times from qt group by all),
sc as (select query_id, id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_len))), 6) score
  from qc join dfs using (term) join post using (term), st group by all),
rk as (select *, row_number() over (partition by query_id order by score desc, id) rank from sc)
"""
_RANKED = _BM25 + ", h as (select query_id, id, score, rank from rk where rank <= 10), cd as (select distinct id, documentId, sectionPath, chunkIndex, content from document_chunks)"
_FAQ = _POST.replace("from document_chunks", "from faq_entries")
_NEAR = """with e as (select vec_id id, embedding::double[] v from embeddings),
s as (select a.id query_id, b.id id, round(list_cosine_similarity(a.v, b.v), 9) sim from e a, e b where a.id % 20 = 0),
k as (select *, row_number() over (partition by query_id order by sim desc, id) rank from s)
"""
ORACLES = {
    "corpus_stats": f"with {_POST} select n, round(avg_len, 6) avg_len from st",
    "document_frequency": f"with {_POST} select * from dfs",
    "bm25_topk": _BM25 + "select * from rk where rank <= 10",
    "bm25_normalized": _BM25 + "select query_id, id, round(score / greatest(max(score) over (partition by query_id), 0.0001), 6) norm from rk qualify rank <= 5",
    "bm25_faq": f"""with {_FAQ},
        q as (select doc_id query_id, title from documents where doc_id % 20 = 0 and title is not null),
        qt as (select query_id, unnest(list_transform({T.sql_raw_tokens("title")}, lambda w: {T.sql_stem("w")})) term from q),
        qc as (select query_id, term, count(*) times from qt group by all),
        sc as (select query_id, id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_len))), 6) score
          from qc join dfs using (term) join post using (term), st group by all)
        select *, row_number() over (partition by query_id order by score desc, id) rank from sc qualify rank <= 10""",
    "cosine_in_group": """with x as (select vec_id, label, embedding::double[] v from embeddings), p as (select label, v[i] y, i from x, range(1, 65) t(i)),
        m as (select label, list(a order by i) mean from (select label, i, avg(y) a from p group by all) group by label)
        select label, round(avg(list_cosine_similarity(v, mean)), 5) mean_sim, count(*) n from x join m using (label) group by label""",
    "neighbor_expand": _RANKED + """, wn as (select id, documentId, sectionPath, row_number() over (partition by documentId, sectionPath order by chunkIndex nulls first, id) place from cd),
        near as (select h.query_id, b.id, case when b.place = a.place then score else score * 0.6 end relevance, h.id via from h join wn a using (id)
          join wn b on b.documentId = a.documentId and b.sectionPath = a.sectionPath and abs(b.place - a.place) <= 2),
        every as (select * from near union select query_id, id, score, id from h)
        select query_id, id, round(relevance, 6) relevance from every qualify row_number() over (partition by query_id, id order by via = id desc, relevance desc, via) = 1""",
    "context_pack": _RANKED.replace("with ", "with recursive ", 1) + """, z as (select query_id, h.id, rank, greatest(1, ceil(length(content) / 4))::bigint t from h join cd using (id)),
        s as (select *, row_number() over (partition by query_id order by rank, id, t) k from z),
        f as (select query_id, 0::bigint k, 0::bigint used, null::bigint id, null::bigint tokens from (select distinct query_id from s)
          union all select f.query_id, s.k, case when f.used + least(t, 120) + 12 <= 300 then f.used + least(t, 120) + 12 else f.used end,
            case when f.used + least(t, 120) + 12 <= 300 then s.id end, least(t, 120) from f join s on s.query_id = f.query_id and s.k = f.k + 1)
        select query_id, id, tokens from f where id is not null""",
    "rerank_apply": _RANKED + f""", a as (select query_id, list_distinct(list(term)) asked from qt group by query_id),
        b as (select id, list_transform({T.sql_raw_tokens("left(content, 2048)")}, lambda w: {T.sql_stem("w")}) has from cd where content is not null),
        r as (select query_id, id, round(len(list_intersect(asked, has)) / len(asked), 9) rerank from h join a using (query_id) join b using (id))
        select query_id, id, row_number() over (partition by query_id order by coalesce(rerank, score) desc, id) place from h left join r using (query_id, id)""",
    "hybrid_topk": _BM25 + """, fv as (select distinct id, try_cast(embedding as double[]) v from faq_entries), cv as (select distinct id, try_cast(embedding as double[]) v from document_chunks),
        okq as (select * from fv where len(v) = 64 and list_bool_and(list_transform(v, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(v, lambda x: x <> 0))),
        okc as (select * from cv where len(v) = 64 and list_bool_and(list_transform(v, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(v, lambda x: x <> 0))),
        sim as (select okq.id query_id, okc.id id, round(list_cosine_similarity(list_transform(okq.v, lambda x: coalesce(x, 0)), list_transform(okc.v, lambda x: coalesce(x, 0))), 9) sim from okq, okc where okq.id % 20 = 0),
        lex as (select query_id, id, round(score / greatest(max(score) over (partition by query_id), 0.0001), 6) norm from sc),
        both_ as (select query_id, id, round(0.6 * coalesce(sim, 0) + 0.4 * coalesce(norm, 0), 6) relevance from sim full join lex using (query_id, id))
        select *, row_number() over (partition by query_id order by relevance desc, id) rank from both_ qualify rank <= 10""",
    "l2_norms": "select vec_id id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) norm from embeddings",
    "vector_topk": _NEAR + "select query_id, id, round(sim, 6) sim from k where rank <= 10",
    "threshold_fallback": _NEAR + """, m as (select query_id, id, round(sim, 6) relevance, max(round(sim, 6)) over (partition by query_id) best from k where rank <= 40)
        select query_id, id, relevance from m where relevance >= case when best >= 0.45 then 0.45 else 0.35 end""",
    "context_caps": _BM25 + """, h as (select distinct rk.query_id, rk.id, documentId, score relevance from rk join document_chunks using (id) where rank <= 10),
        a as (select *, round(avg(relevance) over (partition by query_id, documentId), 9) mean, row_number() over (partition by query_id, documentId order by relevance desc, id) in_doc from h),
        b as (select *, dense_rank() over (partition by query_id order by mean desc, documentId) doc_rank from a),
        c2 as (select *, row_number() over (partition by query_id order by doc_rank, in_doc) n from b where in_doc <= case when doc_rank = 1 then 6 else 1 end)
        select query_id, id, doc_rank from c2 where n <= 8""",
}
