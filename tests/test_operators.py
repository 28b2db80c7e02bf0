import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from kvasir.functions.bloom import MOST_BITS, bloom_bits, bloom_filter, might_contain
from kvasir.operators import catalog
from kvasir.operators import route as R
from kvasir.operators import score as S
from kvasir.operators import store
from kvasir.operators.joins import skew_left_join
from kvasir.operators.references import Reference, broken_reference_report, broken_references
from kvasir.streaming import state

T0 = dt.datetime(2024, 1, 1)


def test_bloom_filter_never_denies_a_key(spark):
    keys = spark.range(0, 3000, 3).withColumnRenamed("id", "k")
    bits = bloom_filter(keys, "k")
    rows = spark.range(3000).withColumn("m", might_contain(keys, bits, F.col("id"))).collect()
    assert all(r.m for r in rows if r.id % 3 == 0)
    assert sum(r.m for r in rows if r.id % 3) < 60
    assert bloom_filter(keys.where("k < 0"), "k") is None
    assert bloom_bits(10**12) == MOST_BITS


@pytest.mark.parametrize("hot", [None, []])
def test_skew_left_join(spark, hot):
    left = spark.createDataFrame([(i, 7 if i % 3 else i) for i in range(90)] + [(100, None)], "id int, k int")
    right = spark.createDataFrame([(i, i * 10) for i in range(0, 90, 2)] + [(7, 70)], "k int, v int")
    got = sorted((r.id, r.k, r.v) for r in skew_left_join(left, right, "k", hot).collect())
    assert got == sorted((r.id, r.k, r.v) for r in left.join(right, "k", "left").collect())


def test_broken_references(spark):
    day = dt.timedelta(days=1)
    docs = spark.createDataFrame([(1, T0, "x"), (2, T0 + 5 * day, "x")], "doc_id long, createdAt timestamp_ntz, id string")
    rows = [(1, 1, T0), (2, 2, T0), (2, 2, T0), (3, 3, T0), (4, 4, None), (5, None, T0), (6, 2, None), (7, 9, T0)]
    refs = spark.createDataFrame(rows, "id long, documentId long, createdAt timestamp_ntz")
    log = spark.createDataFrame([("document", 3, T0), ("document", 3, T0), ("faq_entry", 4, T0), ("document", 1, T0)], "entity string, entityId long, deletedAt timestamp_ntz")
    only = (Reference("chunks", "documentId", "documents", "doc_id", "document"),)
    found = broken_references({"chunks": refs, "documents": docs}, log, only)
    assert {(r.src, r.id, r.kind) for r in found.collect()} == {("chunks", 2, "late"), ("chunks", 3, "deleted"), ("chunks", 4, "missing"), ("chunks", 7, "missing")}
    report = {(r.period, r.kind): r.n for r in broken_reference_report(found).collect()}
    assert report == {("2024-01", "late"): 1, ("2024-01", "deleted"): 1, ("unknown", "missing"): 1, ("2024-01", "missing"): 1}
    none = broken_references({"chunks": refs.limit(0), "documents": docs}, log, only)
    assert none.count() == 0
    assert broken_references({"chunks": refs, "documents": docs.limit(0)}, log, only).count() == 6


def test_a_target_with_a_third_of_all_references(spark):
    docs = spark.createDataFrame([(1, T0)], "doc_id long, createdAt timestamp_ntz")
    refs = spark.range(300).selectExpr("id", "case when id % 3 = 0 then 5 else 1 end documentId", "timestamp_ntz'2024-06-01' createdAt")
    log = spark.createDataFrame([("document", 5, T0)], "entity string, entityId long, deletedAt timestamp_ntz")
    found = broken_references({"c": refs, "documents": docs}, log, (Reference("c", "documentId", "documents", "doc_id", "document"),))
    assert found.where("kind = 'deleted'").count() == found.count() == 100


def test_bm25_closed_form(spark):
    corpus = spark.createDataFrame([(1, "pump pump ring"), (2, "ring valve"), (3, "")], "id long, t string")
    q = spark.createDataFrame([(20, "pump"), (40, "ring ring")], "query_id long, text string")
    got = {(r.query_id, r.id): r.score for r in S.bm25(q, corpus, "id", "t").collect()}
    avg = (3 + 2 + 1) / 3
    part = lambda df, tf, dl: np.log((3 - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))
    assert got == pytest.approx({(20, 1): part(1, 2, 3), (40, 1): 2 * part(2, 1, 3), (40, 2): 2 * part(2, 1, 2)})


def test_vector_top_k_in_blocks(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(60)], "id long, vec array<double>")
    got = S.vector_top_k(S.query_vectors(df, "id", "vec"), df, 3, block_rows=13).collect()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in (0, 20, 40):
        assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == np.argsort(-(u[q] @ u.T), kind="stable")[:3].tolist()


def test_mmr_against_a_loop(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(15, 4))
    rel = rng.random(15).round(3)
    rows = [(1, i, float(rel[i]), m[i].tolist()) for i in range(15)]
    got = [r.id for r in S.mmr(spark.createDataFrame(rows, "query_id long, id long, relevance double, vec array<double>"), 6).orderBy("pick").collect()]
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    left, chosen = sorted(range(15), key=lambda i: (-rel[i], i)), []
    while len(chosen) < 6:
        best = max(left, key=lambda i: round(0.7 * rel[i] - 0.3 * (max(u[i] @ u[j] for j in chosen) if chosen else 0), 12))
        chosen.append(best)
        left.remove(best)
    assert got == chosen


def test_context_pack_skips_and_goes_on(spark):
    hits = spark.createDataFrame([(1, 10, 1, 50), (1, 11, 2, 60), (1, 12, 3, 20)], "query_id long, id long, rank int, tokens long")
    assert [(r.id, r.tokens) for r in S.pack_context(hits, 100, 55, 5).collect()] == [(10, 50), (12, 20)]


def test_neighbours_and_threshold(spark):
    chunks = spark.createDataFrame([(i, 1, "1" if i < 5 else "2", i) for i in range(8)], "id long, documentId long, sectionPath string, chunkIndex int")
    hits = spark.createDataFrame([(1, 4, 1.0), (1, 2, 0.5)], "query_id long, id long, relevance double")
    assert {(r.id, round(r.relevance, 2)) for r in S.neighbours(hits, chunks).collect()} == {(4, 1.0), (2, 0.5), (3, 0.6), (1, 0.3), (0, 0.3)}
    rows = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.4), (2, 1, 0.4), (3, 1, 0.1)], "query_id long, id long, s double")
    assert {(r.query_id, r.id) for r in S.threshold_with_fallback(rows, "s").collect()} == {(1, 1), (2, 1)}


def test_sync_actions(spark):
    stored = [("a", "1", 1), ("b", "1", 1), ("c", "1", 1), ("d", None, 1), ("e", "1", 2), ("f", "1", 1)]
    found = [("a", "1", 1), ("b", "2", 1), ("d", "3", 1), ("g", "1", 1), ("f", "1", 3)]
    s = "url string, hash string, source int"
    got = {r.url: r.action for r in store.sync_actions(spark.createDataFrame(stored, s), spark.createDataFrame(found, s)).collect()}
    assert got == {"a": "same", "b": "update", "c": "orphan", "d": "restore", "e": "same", "f": "conflict", "g": "add"}


def test_links(spark):
    html = """<a href="/a.pdf#x">One &amp; <b>two</b></a> <A class=q HREF='https://o.example/b.PDF?y=1'>B</A>
      <a href="/a.pdf">again</a> <a href="c.html">C</a> <a href="#top">no</a> <a href="//h.example/d.pdf">D</a>"""
    pages = spark.createDataFrame([(1, "https://s.example/dir/page.html?z", html), (2, "https://s.example", None)], "page_id int, url string, html string")
    got = {r.url: r.title for r in store.links(pages, extension=".pdf").collect()}
    assert got == {"https://s.example/a.pdf": "One & two", "https://o.example/b.PDF?y=1": "B", "https://h.example/d.pdf": "D"}
    assert "https://s.example/dir/c.html" in {r.url for r in store.links(pages).collect()}


def test_lost_characters_and_inventory(spark):
    a = spark.createDataFrame([(1, "aab c"), (2, None)], "id int, t string")
    b = spark.createDataFrame([(1, "abc")], "id int, t string")
    assert [(r.id, r.lost) for r in store.lost_characters(a, b, "id", "t").collect()] == [(1, 1)]
    before = store.inventory({"x": a, "y": b})
    assert {(r.name, r.shrunk) for r in store.inventory_shrunk(before, store.inventory({"x": b})).collect()} == {("x", True), ("y", True)}


def test_routes(spark):
    rules = spark.createDataFrame([(1, "w", True, 0, "гаранти*"), (1, "w", True, 1, "two words"), (2, "x", True, 0, "гарантия"), (0, "off", False, 0, "two")], "rule_no int, rule string, enabled boolean, term_no int, term string")
    asked = spark.createDataFrame([(1, "Какая ГАРАНТИЯ?"), (2, "a two  Words!"), (3, "twowords"), (4, None)], "id int, text string")
    assert {(r.id, r["rule"], r.term) for r in R.route(asked, rules).collect()} == {(1, "w", "гаранти*"), (2, "w", "two words")}


def test_one_edit_apart(spark):
    words = ["кольцо", "кольца", "кольц", "трубка", "трубкаа", "abcde", "abdce", "pump"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {(r.a, r.b) for r in R.one_edit_apart(df, "w", "w").collect()} == {("кольца", "кольцо"), ("кольц", "кольца"), ("кольц", "кольцо"), ("трубка", "трубкаа")}


def test_limiter_and_lock(spark):
    at = [0, 10, 20, 59, 60, 61, 200]
    rows = [(i, "k", T0 + dt.timedelta(seconds=s)) for i, s in enumerate(at)]
    ev = spark.createDataFrame(rows, "event_id int, key string, ts timestamp_ntz")
    got = [(r.window_no, r.n, r.allowed) for r in state.fixed_window_limit(ev, "key", "ts", most=2, seconds=60).orderBy("event_id").collect()]
    assert got == [(1, 1, True), (1, 2, True), (1, 3, False), (1, 4, False), (2, 1, True), (2, 2, True), (3, 1, True)]
    fails = spark.createDataFrame([("k", T0 + dt.timedelta(minutes=m)) for m in (0, 1, 2, 3, 4, 20, 21, 22)], "key string, ts timestamp_ntz")
    assert [r.locked_at for r in state.lockouts(fails, "key", "ts", most=3, minutes=15).orderBy("locked_at").collect()] == [T0 + dt.timedelta(minutes=m) for m in (2, 22)]


def test_stream_counts_once(spark, tmp_path):
    rows = [(1, T0, "a"), (1, T0, "a"), (2, T0, "b"), (3, T0 + dt.timedelta(hours=30), "a")]
    spark.createDataFrame(rows, "event_id int, ts timestamp, event_type string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id int, ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    counts = state.stream_counts(stream, "ts", "1 day", "1 hour")
    run = counts.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted((r.event_type, r.n) for r in spark.table("counts").collect()) == [("a", 1), ("a", 1), ("b", 1)]


def test_reading_lines(spark):
    rows = [(1, 1, 10.0, 0.0), (1, 2, 0.0, 3.0), (1, 3, 5.0, 6.0), (1, 4, 0.0, 12.0), (2, 5, 0.0, 0.0), (2, 6, None, 0.0)]
    df = spark.createDataFrame(rows, "page int, id long, x double, y double")
    got = {r.id: (r.line_no, r.in_line) for r in catalog.reading_lines(df, ["page"]).collect()}
    assert got == {2: (1, 1), 1: (1, 2), 4: (3, 1), 3: (2, 1), 5: (1, 1)}


def test_headers_records_and_winners(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (2, 4, "a")], "t int, at int, name string")
    assert [r.header for r in catalog.unique_headers(df, ["t"], "at", "name").orderBy("at").collect()] == ["a", "b", "a 2", "a"]
    rec = spark.createDataFrame([("k", 1, "x", 5), ("k", 2, "", None), (None, 3, "z", 1)], "key string, at int, name string, page int")
    assert [tuple(r) for r in catalog.merge_records(rec, "key", "at", "name", "page").collect()] == [("k", "x", 5)]
    hits = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.5), (2, 1, 0.9), (2, 2, 0.85), (3, 1, 0.2)], "query_id long, id long, relevance double")
    assert [(r.query_id, r.id) for r in catalog.clear_winner(hits, 0.5, 0.1).collect()] == [(1, 1)]
    assert [r.id for r in catalog.variant_first(hits.where("query_id = 1"), F.col("id") == 2, 1).collect()] == [2]


def test_page_ends_and_outline(spark):
    rows = [(1, 1, "1", 1, 3, None), (2, 1, "1.1", 2, 5, 4), (3, 1, "2", 1, 9, 12), (3, 1, "2", 1, 9, 12), (4, 1, "2", 1, 8, None)]
    df = spark.createDataFrame(rows, "id long, documentId long, sectionPath string, level int, pageStart int, pageEnd int")
    assert {r.id: r.page_end for r in catalog.section_page_ends(df).collect()} == {1: 4, 2: 7, 4: 8, 3: 12}
    o = catalog.document_outline(df).first()
    assert (o.sections, o.depth, o.doubled, o.disordered) == (4, 2, 1, 1)
