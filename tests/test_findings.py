import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from kvasir.functions import text as T
from kvasir.functions.bloom import bloom_filter, might_contain
from kvasir.operators import resolve as R
from kvasir.operators import score as S
from kvasir.operators import search as X

DATA = "/root/testdata/sf0.001"
SEARCHES = [
    "answer_sources",
    "context_caps",
    "hybrid_topk",
    "neighbor_expand",
    "raw_answer_allowed",
    "rule_boosts",
    "variant_first",
    "attachments",
    "boosted_variants",
    "context_pack",
    "kinds_for_intent",
    "rerank_apply",
    "bm25_normalized",
    "clear_winner",
    "hybrid_boosted",
    "retrieval_diagnostics",
]


def test_bloom_filter_stays_out_of_the_plans_text(spark):
    keys = spark.range(0, 30_000, 3)
    bits = bloom_filter(keys, "id")
    rows = spark.range(30_000).where(~might_contain(keys, bits, F.col("id")))
    assert len(rows._jdf.queryExecution().toString()) < len(bits) and 19_000 < rows.count() <= 20_000


def test_stems_in_python(spark):
    words = sorted({w + s for w in ("труб", "ос", "рф", "абв", "valve", "клапан", "") for s in ("", "а", "ой", "ями", "ого", "ёв", "ям")})
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.stem(F.col("w")).alias("s")).collect()
    assert {r.w: T.plain_stem(r.w) for r in got} == {r.w: r.s for r in got}


def _odd(spark):
    words = ["valve", "pipes", "pump", "клапаны", "ring", "DN-15"]
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 9)))) for i in range(80)]
    rows += [rows[3], rows[9], (90, None), (91, ""), (92, "12 34"), (93, rows[5][1])]
    asked = [(20, "the valve valve and pipes"), (40, "клапан DN-15"), (60, "nothing known"), (80, None), (100, "ring")]
    return spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(rows, "id long, t string")


@pytest.mark.parametrize(("texts", "asked"), [(32_768, 65_536), (7, 2)])
def test_best_hits_are_those_of_all_pairs(spark, monkeypatch, texts, asked):
    monkeypatch.setattr(X, "TEXTS", texts)
    monkeypatch.setattr(X, "QUERIES", asked)
    q, corpus = _odd(spark)
    want = S.top_k(S.bm25(q, corpus, "id", "t").withColumn("score", F.round("score", 6)), 4)
    row = lambda r: (r.query_id, r.id, r.score, r["rank"])
    got = sorted(map(row, X.bm25_top_k(q, corpus, "id", "t", 4).collect()))
    assert got == sorted(map(row, want.collect())) and {g[0] for g in got} == {20, 40, 100}


def test_texts_of_one_id_add_up(spark):
    q = spark.createDataFrame([(20, "valve")], "query_id long, text string")
    corpus = spark.createDataFrame([(1, "valve ring"), (1, "valve pump pump"), (2, "valve ring"), (3, "pump"), (None, "pump")], "id long, t string")
    got = {r.id: r["rank"] for r in X.bm25_top_k(q, corpus, "id", "t", 4).collect()}
    assert got == {1: 1, 2: 2}


def test_fused_hits_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(X, "TEXTS", 30)
    q, corpus = _odd(spark)
    rng = np.random.default_rng(3)
    vectors = {r.id: rng.normal(size=8).round(3).tolist() for r in corpus.collect() if r.id % 7}
    vec = lambda df, key, own: df.join(spark.createDataFrame(list(own.items()), f"{key} long, vec array<double>"), key, "left")
    q, corpus = vec(q, "query_id", {i: rng.normal(size=8).tolist() for i in (20, 60, 80)}), vec(corpus, "id", vectors)
    norm = S.normalized(S.bm25(q, corpus, "id", "t").withColumn("score", F.round("score", 6))).withColumn("norm", F.round("norm", 6))
    near = S.vector_top_k(q.where("vec is not null"), corpus.where("vec is not null").dropDuplicates(["id"]), 200)
    want = S.top_k(S.hybrid(norm, near).withColumn("relevance", F.round("relevance", 6)), 6, "relevance")
    row = lambda r: (r.query_id, r.id, r.relevance, r["rank"])
    got = sorted(map(row, X.hybrid_search(q, corpus, "id", "t", "vec", 6, size=8).collect()))
    assert got == sorted(map(row, want.collect())) and {g[0] for g in got} == {20, 40, 60, 80, 100}


@pytest.mark.parametrize("name", SEARCHES)
def test_one_search_without_a_row_for_each_pair(spark, monkeypatch, name):
    def refused(*_):
        raise AssertionError("all pairs")

    calls = {"bm25_top_k": 0, "hybrid_search": 0}

    def counted(f):
        def run(*args, **named):
            calls[f.__name__] += 1
            return f(*args, **named)

        return run

    monkeypatch.setattr(S, "bm25", refused)
    for f in (X.bm25_top_k, X.hybrid_search):
        monkeypatch.setattr(X, f.__name__, counted(f))
    queries()[name](spark, DATA).collect()
    assert sum(calls.values()) == 1


def _groups_and_titles(spark):
    names = ["Труба Гельмира DN-27", "труба гельмира", "Valve", "Pump group Talvex", "DN-1", None, ""]
    titles = ["трубы Гельмира DN-3", "valve of Talvex", "pump Talvex", "Group pump talvex valve", None, "12"]
    groups = [(i, names[i % 7]) for i in range(70)] + [(0, names[0])]
    docs = [(i, titles[i % 6]) for i in range(60)]
    return spark.createDataFrame(groups, "id long, name string"), spark.createDataFrame(docs, "doc_id long, title string")


def test_matched_titles_are_written_from_slices(spark, monkeypatch):
    monkeypatch.setattr(R, "SLICE", 3)
    groups, docs = _groups_and_titles(spark)
    stems = lambda df, key, text: {(r[0], tuple(dict.fromkeys(w for w in r[1] if w))) for r in df.select(key, F.coalesce(F.transform(F.filter(F.regexp_extract_all(T.fold(F.col(text)), F.lit("[а-яa-z0-9]+"), 0), lambda w: F.length(w) >= 3), T.stem), F.array().cast("array<string>"))).collect()}
    shared = lambda a, b: len({*a} & {*b})
    want = sorted((g, d, shared(a, b)) for g, a in stems(groups, "id", "name") for d, b in stems(docs, "doc_id", "title") if a and shared(a, b) >= max(min(2, len(a)), math.ceil(len(a) * 0.6)))
    found = R.title_matches(groups, docs)
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) > 500
    plan = found._jdf.queryExecution().toString()
    assert not [x for x in plan.splitlines() if "Aggregate" in x and "keys=[id#" in x and "doc_id#" in x.split("functions")[0]]  # no pair is gathered


def test_matched_titles_are_counted_by_stems(spark):
    groups, docs = _groups_and_titles(spark)
    want = R.title_matches(groups, docs).groupBy("id").count()
    assert {tuple(r) for r in R.title_match_counts(groups, docs).collect()} == {tuple(r) for r in want.collect()} != set()


def test_search_without_queries_or_texts(spark):
    q, corpus = _odd(spark)
    vec = F.lit(None).cast("array<double>")
    for asked, texts in ((q.limit(0), corpus), (q, corpus.limit(0)), (q.where("query_id = 60"), corpus)):
        assert X.bm25_top_k(asked, texts, "id", "t", 3).collect() == []
        assert X.hybrid_search(asked.withColumn("vec", vec), texts.withColumn("vec", vec), "id", "t", "vec", 3).collect() == []
