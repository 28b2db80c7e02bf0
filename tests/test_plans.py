import json

import numpy as np
from pyspark.sql import functions as F

from kvasir.operators import score as S
from kvasir.plans import score, store, text


def test_frequent_questions_are_recommended_unless_a_rule_matches(spark, tmp_path):
    asked = ["Which pump?"] * 9 + ["which PUMP"] + ["Is there a warranty?"] * 6 + ["once"]
    spark.createDataFrame(list(enumerate(asked)), "id long, query string").write.parquet(str(tmp_path / "chat_history.parquet"))
    got = [tuple(r) for r in store.rule_recommendations(spark, str(tmp_path)).collect()]
    assert got == [("which pump", 10, "Which pump? | Which pump? | Which pump?")]


def test_hybrid_top_k_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    m, q = rng.normal(size=(90, 8)), rng.normal(size=(7, 8))
    m[40:50] = m[40]
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vec array<double>")
    pairs = {(int(a), int(b)) for a, b in zip(rng.integers(0, 9, 200), rng.integers(0, 99, 200))}  # some without a vector
    lexical = spark.createDataFrame([(a, b, round(float(rng.random()), 6)) for a, b in sorted(pairs)], "query_id long, id long, norm double")
    want = S.top_k(S.hybrid(lexical, S.vector_top_k(asked, corpus, 90)).withColumn("relevance", F.round("relevance", 6)), 5, "relevance")
    for blocks, parts in ((1, 1), (4, 3)):
        got = S.hybrid_top_k(asked, lexical, corpus, 5, size=8, blocks=blocks, parts=parts)
        assert {(r.query_id, r.id, r["rank"]) for r in got.collect()} == {(r.query_id, r.id, r["rank"]) for r in want.collect()}


def test_hybrid_search_finds_chunks_by_vector_alone(spark, tmp_path):
    unit = lambda i: json.dumps([float(j == i) for j in range(64)])
    chunks = [(1, "steel ring", unit(1)), (2, "brass valve", unit(0)), (3, "steel ring", "[1, 2]"), (4, "brass", unit(0)[:-1]), (2, "brass valve", unit(0))]
    columns = "id long, content string, embedding string, documentId long, sectionPath string, chunkIndex int"
    spark.createDataFrame([(*c, 1, "1", 0) for c in chunks], columns).write.parquet(str(tmp_path / "document_chunks.parquet"))
    faq = spark.createDataFrame([(20, "steel", "x", unit(0)), (21, "brass", "x", unit(0))], "id long, title string, content string, embedding string")
    faq.write.parquet(str(tmp_path / "faq_entries.parquet"))
    got = [tuple(r) for r in score.hybrid_topk(spark, str(tmp_path)).orderBy("rank").collect()]
    assert got == [(20, 2, 0.6, 1), (20, 1, 0.4, 2), (20, 3, 0.4, 3)]


def test_whole_titles_and_all_cells(spark, tmp_path):
    title = "A title of more than twelve characters"
    spark.createDataFrame([(1, f" {title}\n")], "id long, title string").write.parquet(str(tmp_path / "sections.parquet"))
    assert [r.title for r in text.section_titles(spark, str(tmp_path)).collect()] == [title]
    row = "|" + "|".join(f"c{i}" for i in range(20)) + "|"
    spark.createDataFrame([(1, f"x\n{row}\n||")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["value"]: r.n for r in text.table_cells(spark, str(tmp_path)).collect()}
    assert got == {**{f"c{i}": 1 for i in range(20)}, "": 1}
