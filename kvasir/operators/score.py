"""Lexical and vector scoring of query batches, fusion, diversification and the cutting of results."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvasir.functions.text import raw_tokens, stem
from kvasir.operators.joins import skew_left_join
from kvasir.sources.tables import cut

K1, B = 1.2, 0.75  # of BM25
MOST_TERMS = 100_000  # terms that are broadcast
BLOCK_ROWS = 50_000  # vectors of one block of the corpus
QUERY_ROWS = 8_192
SCHEMA = "query_id bigint, id bigint, sim double"


def postings(df: DataFrame, id_col: str, text_col: str, terms: DataFrame | None = None) -> DataFrame:
    """``id, term, tf, dl``: the terms of each text, how often, and its length in terms (at least 1); a null term for the text itself.

    Rows with an id that is repeated are one text. With ``terms`` (``term``) only these terms are kept, before anything is
    shuffled; a text itself is never shuffled.
    """
    words = F.coalesce(raw_tokens(F.col(text_col)), F.array().cast("array<string>"))
    rows = df.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), words.alias("words"))
    size = F.greatest(F.size("words"), F.lit(1)).cast("bigint")
    rows = rows.select("id", "row", size.alias("dl"), F.explode(F.concat("words", F.array(F.lit(None).cast("string")))).alias("word"))
    rows = rows.select("id", "row", "dl", stem(F.col("word")).alias("term"))  # after the explode, where it is compiled
    if terms is not None:
        asked = terms.select("term").distinct().withColumn("asked", F.lit(True))
        small = asked.limit(MOST_TERMS + 1).count() <= MOST_TERMS
        rows = rows.join(F.broadcast(asked) if small else asked, "term", "left").where("asked or term is null").drop("asked")
    counts = rows.groupBy("id", "row", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))
    return counts.groupBy("id", "term", "dl").agg(F.max("tf").alias("tf"))


def corpus_stats(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``n, avg_len``: the number of texts and their average length in terms (each at least 1)."""
    size = F.greatest(F.coalesce(F.size(raw_tokens(F.col(text_col))), F.lit(0)), F.lit(1))
    once = df.select(F.col(id_col).alias("id"), size.alias("size")).dropDuplicates(["id"])
    return once.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("avg_len"))


def bm25(queries: DataFrame, corpus: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``query_id, id, score``: the BM25 score of every query (``query_id, text``) for every text that shares a term.

    Statistics are those of ``corpus``, each id once; a term given twice in a query counts twice. The corpus is read and
    tokenised once: postings of the asked terms and the texts' lengths are written to the shared folder. A term is in up to
    all texts, so postings meet the queries' terms by broadcast or, if these are too many, by a shuffle in which the most
    frequent terms are broadcast.
    """
    asked = queries.select("query_id", F.explode(raw_tokens(F.col("text"))).alias("word")).select("query_id", stem(F.col("word")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    every = cut(postings(corpus, id_col, text_col, asked))
    post = every.where("term is not null")
    df_of = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = every.where("term is null").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg_len")).first()
    n, avg = stats["n"], stats["avg_len"] or 1.0
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avg)))
    lists = asked.join(df_of, "term").groupBy("term", "df").agg(F.collect_list(F.struct("query_id", "times")).alias("by"))
    hits = skew_left_join(post, lists, "term", None if asked.limit(MOST_TERMS + 1).count() > MOST_TERMS else [])
    hits = hits.where("by is not null").select("id", "tf", "dl", "df", F.explode("by").alias("q"))
    hits = hits.select(F.col("q.query_id").alias("query_id"), "id", (F.col("q.times") * part).alias("part"))
    return hits.groupBy("query_id", "id").agg(F.sum("part").alias("score"))


def top_k(df: DataFrame, k: int, score: str = "score", *ties: str) -> DataFrame:
    """The ``k`` best rows of each query, ties by the columns ``ties`` (``id`` by default), with their ``rank``."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), *(ties or ("id",)))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def normalized(df: DataFrame, score: str = "score", name: str = "norm") -> DataFrame:
    """Scores divided by the best of their query."""
    best = F.greatest(F.max(score).over(Window.partitionBy("query_id")), F.lit(0.0001))
    return df.withColumn(name, F.col(score) / best)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two arrays; 0 for empty ones, unequal lengths or a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def vector_top_k(queries: DataFrame, corpus: DataFrame, k: int, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, id, sim, rank``: the ``k`` rows of ``corpus`` (``id, vec``) nearest to each query (``query_id, vec``) by cosine.

    The corpus is dealt into blocks of about ``block_rows``, the queries into parts of at most about :data:`QUERY_ROWS`;
    each pair of these is a matrix product per chunk of queries and keeps its ``k`` best, so no task grows with the data.
    """
    blocks, parts = max(1, -(-corpus.count() // block_rows)), max(1, -(-queries.count() // QUERY_ROWS))
    slot = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    here = corpus.select("id", "vec", slot("id", blocks).alias("block"), every(parts).alias("part"))
    asked = queries.select("query_id", "vec", every(blocks).alias("block"), slot("query_id", parts).alias("part"))

    def unit(column: pd.Series) -> np.ndarray:
        m = np.vstack(column.to_numpy()).astype(np.float64)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):  # a block without rows, or a part without queries
            return pd.DataFrame({"query_id": [], "id": [], "sim": []}).astype({"query_id": "int64", "id": "int64", "sim": "float64"})
        c = c.sort_values("id")
        m, ids, out = unit(c["vec"]), c["id"].to_numpy(), []
        for at in range(0, len(q), 512):
            part = q.iloc[at : at + 512]
            s = np.round(unit(part["vec"]) @ m.T, 9)
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({"query_id": np.repeat(part["query_id"].to_numpy(), top.shape[1]), "id": ids[top].ravel(), "sim": np.take_along_axis(s, top, 1).ravel()}))
        return pd.concat(out)

    found = asked.groupBy("block", "part").cogroup(here.groupBy("block", "part")).applyInPandas(search, SCHEMA)
    return top_k(found, k, "sim")


def hybrid(lexical: DataFrame, vector: DataFrame, w_vector: float = 0.6, w_lexical: float = 0.4) -> DataFrame:
    """``query_id, id, sim, norm, relevance``: cosine and normalised lexical score weighed, each 0 where it is absent."""
    both = lexical.select("query_id", "id", "norm").join(vector.select("query_id", "id", "sim"), ["query_id", "id"], "full").fillna(0.0, ["norm", "sim"])
    total = w_vector + w_lexical
    return both.withColumn("relevance", (w_vector * F.col("sim") + w_lexical * F.col("norm")) / total)


def usable_vectors(text: Column, size: int = 64) -> Column:
    """An array of the one vector in a JSON text, or of none unless it is ``size`` finite numbers that aren't all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.filter(F.array(F.from_json(text, "array<double>")), lambda v: (F.size(v) == size) & F.forall(v, finite) & F.exists(v, lambda x: x != 0))


def hybrid_top_k(queries: DataFrame, lexical: DataFrame, corpus: DataFrame, k: int, *, size: int = 64, blocks: int = 1, parts: int = 1, w_vector: float = 0.6, w_lexical: float = 0.4) -> DataFrame:
    """``query_id, id, relevance, rank``: the ``k`` best of all rows by :func:`hybrid`, rounded to 6 digits, ties by ``id``.

    Every pair of a query (``query_id, vec``) and a row (``id, vec``) has its true cosine, those that share a term
    (``query_id, id, norm``) too; a lexical hit of a row or query without a vector has the lexical part alone. Rows are
    dealt into ``blocks`` and queries into ``parts``; each pair of these is one matrix product and keeps its ``k`` best.
    """
    slot = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.lit(None).cast("bigint")
    rows = corpus.select(slot("id", blocks).alias("block"), every(parts).alias("part"), none.alias("query_id"), F.col("id").cast("bigint").alias("id"), "vec")
    asked = queries.select(every(blocks).alias("block"), slot("query_id", parts).alias("part"), F.col("query_id").cast("bigint").alias("query_id"), none.alias("id"), "vec")
    hits = lexical.select(slot("id", blocks).alias("block"), slot("query_id", parts).alias("part"), "query_id", "id", "norm")

    def read(t: pa.Table, key: str) -> tuple[np.ndarray, np.ndarray]:
        t = t.filter(pa.compute.is_valid(t[key])).sort_by(key)
        m = t["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)
        if len(m):
            m /= np.abs(m).max(axis=1, keepdims=True)
            m /= np.linalg.norm(m, axis=1, keepdims=True)
        return t[key].to_numpy(), m

    def at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(keys, wanted)
        return i, np.append(keys, -1)[i] == wanted if len(keys) else np.zeros(len(wanted), bool)

    def first(q: np.ndarray, i: np.ndarray, r: np.ndarray) -> np.ndarray:
        order = np.lexsort((i, -r, q))
        q = q[order]
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        return order[np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)])) < k]

    def search(both: pa.Table, hit: pa.Table) -> pa.Table:
        (ids, m), (asked_ids, q) = read(both, "id"), read(both, "query_id")
        hit_q, hit_id, norm = hit["query_id"].to_numpy(), hit["id"].to_numpy(), hit["norm"].to_numpy() * w_lexical
        (row, has_q), (col, has_id) = at(asked_ids, hit_q), at(ids, hit_id)
        near = has_q & has_id
        found = [(hit_q[~near], hit_id[~near], norm[~near])]
        row, col, norm = row[near], col[near], norm[near]
        order = np.argsort(row, kind="stable")
        row, col, norm = row[order], col[order], norm[order]
        for lo in range(0, len(q) if len(ids) else 0, 128):
            r = w_vector * np.round(q[lo : lo + 128] @ m.T, 9)
            own = slice(*np.searchsorted(row, (lo, lo + 128)))
            r[row[own] - lo, col[own]] += norm[own]
            r = np.round(r / (w_vector + w_lexical), 6)
            least = np.partition(r, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)]
            a, b = np.nonzero(r >= least[:, None])
            found.append((asked_ids[lo + a], ids[b], r[a, b]))
        found[0] = (*found[0][:2], np.round(found[0][2] / (w_vector + w_lexical), 6))
        q_id, i, r = (np.concatenate(x) for x in zip(*found))
        keep = first(q_id, i, r) if len(r) else slice(0, 0)
        return pa.table({"query_id": pa.array(q_id[keep], pa.int64()), "id": pa.array(i[keep], pa.int64()), "relevance": pa.array(r[keep], pa.float64())})

    pairs = rows.unionByName(asked).groupBy("block", "part").cogroup(hits.groupBy("block", "part"))
    return top_k(pairs.applyInArrow(search, "query_id bigint, id bigint, relevance double"), k, "relevance")


def threshold_with_fallback(df: DataFrame, score: str, strict: float = 0.45, loose: float = 0.35) -> DataFrame:
    """The rows of each query that reach ``strict`` or, if none does, ``loose``."""
    best = F.max(score).over(Window.partitionBy("query_id"))
    return df.withColumn("_best", best).where(F.col(score) >= F.when(F.col("_best") >= strict, strict).otherwise(loose)).drop("_best")


def mmr(df: DataFrame, keep: int = 12, trade: float = 0.7) -> DataFrame:
    """``query_id, id, pick``: candidates (``query_id, id, relevance, vec``) chosen one by one for relevance and novelty.

    Each choice maximises ``trade * relevance - (1 - trade) * highest cosine to those chosen``; ties go to the higher
    relevance, then the smaller id. A query's candidates must be cut to a pool beforehand.
    """

    def choose(c: pd.DataFrame) -> pd.DataFrame:
        c = c.sort_values(["relevance", "id"], ascending=[False, True], kind="stable")
        m = np.vstack(c["vec"].to_numpy()).astype(np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        rel, near = c["relevance"].to_numpy(), np.zeros(len(c))
        left, picked = np.ones(len(c), bool), []
        while len(picked) < min(keep, len(c)):
            value = np.where(left, np.round(trade * rel - (1 - trade) * near, 12), -np.inf)
            i = int(np.argmax(value))
            near = np.maximum(near, m @ m[i]) if picked else m @ m[i]
            left[i] = False
            picked.append(i)
        return pd.DataFrame({"query_id": c["query_id"].iloc[:1].repeat(len(picked)).to_numpy(), "id": c["id"].to_numpy()[picked], "pick": range(1, len(picked) + 1)})

    return df.groupBy("query_id").applyInPandas(choose, "query_id bigint, id bigint, pick bigint")


def neighbours(hits: DataFrame, chunks: DataFrame, reach: int = 2, fade: float = 0.6) -> DataFrame:
    """``query_id, id, relevance, via``: hits and the chunks up to ``reach`` places from them in their section.

    ``hits`` has ``query_id, id, relevance``, ``chunks`` has ``id, documentId, sectionPath, chunkIndex``. A neighbour has
    ``fade`` of its hit's relevance; of several ways to a chunk the most relevant one stays, a hit before a neighbour.
    """
    # Only the sections of hits are numbered.
    asked = hits.select("id").distinct().join(chunks, "id").select("documentId", "sectionPath").distinct()
    near = chunks.join(asked, (chunks.documentId == asked.documentId) & chunks.sectionPath.eqNullSafe(asked.sectionPath), "left_semi")
    where = near.withColumn("place", F.row_number().over(Window.partitionBy("documentId", "sectionPath").orderBy("chunkIndex", "id")))
    at = hits.join(where, "id").select("query_id", "relevance", "documentId", "sectionPath", "place", F.col("id").alias("hit"))
    near = at.withColumn("step", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("place", F.col("place") + F.col("step"))
    found = near.join(where.where("sectionPath is not null"), ["documentId", "sectionPath", "place"])
    relevance = F.when(F.col("step") == 0, F.col("relevance")).otherwise(F.col("relevance") * fade)
    found = found.select("query_id", "id", relevance.alias("relevance"), F.col("hit").alias("via"))
    found = found.unionByName(hits.select("query_id", "id", "relevance", F.col("id").alias("via"))).distinct()
    w = Window.partitionBy("query_id", "id").orderBy(F.desc(F.col("via") == F.col("id")), F.desc("relevance"), "via")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def context_caps(hits: DataFrame, most: int = 16, primary_share: float = 0.8, per_document: int = 12) -> DataFrame:
    """``query_id, id, documentId, relevance, doc_rank``: hits cut per document, documents ordered by mean relevance.

    The first document gives at most ``round(primary_share * most)`` hits (and at most ``per_document``), each further
    one at most a quarter of that; altogether at most ``most``.
    """
    q, doc = Window.partitionBy("query_id"), Window.partitionBy("query_id", "documentId")
    rows = hits.withColumn("mean", F.round(F.avg("relevance").over(doc), 9))
    rows = rows.withColumn("doc_rank", F.dense_rank().over(q.orderBy(F.desc("mean"), "documentId")))
    rows = rows.withColumn("in_doc", F.row_number().over(doc.orderBy(F.desc("relevance"), "id")))
    first = min(per_document, round(primary_share * most))
    rows = rows.where(F.col("in_doc") <= F.when(F.col("doc_rank") == 1, first).otherwise(max(1, first // 4)))
    rows = rows.withColumn("_n", F.row_number().over(q.orderBy("doc_rank", "in_doc"))).where(F.col("_n") <= most)
    return rows.select("query_id", "id", "documentId", "relevance", F.col("doc_rank").cast("bigint").alias("doc_rank"))


def pack_context(hits: DataFrame, most_tokens: int = 9000, most_chunk: int = 1400, header: int = 12) -> DataFrame:
    """``query_id, id, tokens``: hits (``query_id, id, rank, tokens``) packed in order of rank into a budget of tokens.

    A hit costs its tokens, cut to ``most_chunk``, and ``header``; one that doesn't fit is skipped and later, smaller ones
    may still fit, so the fold runs over each query's bounded list of hits inside the JVM.
    """
    lists = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "tokens"))).alias("all"))
    kind = "struct<used:bigint,taken:array<struct<id:bigint,tokens:bigint>>>"
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<id:bigint,tokens:bigint>>").alias("taken")).cast(kind)

    def add(acc: Column, h: Column) -> Column:
        cost = F.least(h["tokens"], F.lit(most_chunk)).cast("bigint")
        item = F.struct(h["id"].cast("bigint").alias("id"), cost.alias("tokens"))
        grown = F.struct((acc["used"] + cost + header).alias("used"), F.concat(acc["taken"], F.array(item)).alias("taken")).cast(kind)
        return F.when(acc["used"] + cost + header <= most_tokens, grown).otherwise(acc)

    return lists.select("query_id", F.explode(F.aggregate("all", start, add, lambda a: a["taken"])).alias("t")).select("query_id", "t.id", "t.tokens")


def rerank(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """Hits with a ``place`` by an external score (``query_id, id, rerank``), by their own relevance where it is absent."""
    both = hits.join(scores, ["query_id", "id"], "left")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("rerank", "relevance")), "id")
    return both.withColumn("place", F.row_number().over(w).cast("bigint"))


def query_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.where(F.col(id_col) % 20 == 0).select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("vec"))
