import datetime as dt

from pyspark.sql import functions as F

from kvasir.operators import tables as B
from kvasir.streaming import state as S


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id long, text string")


def test_blocks_as_tables_and_lists(spark):
    cols = "DN  L  L\n16  5\n20  6  7"
    pairs = "Вес: 5 кг\nДлина - 7 м\nпустая строка без пары\nТемпература: 90 °C"
    bullets = "- one\ncontinued\n2) two\n• three"
    df = texts(spark, cols, pairs, bullets, "plain text.", None, "")
    t = F.col("text")
    got = {r.id: r for r in df.select("id", B.column_table(t).alias("c"), B.pair_table(t).alias("p"), B.bullet_list(t).alias("b"), B.formatted(t).alias("f")).collect()}
    assert got[0].c == "| DN | L | L 2 |\n| --- | --- | --- |\n| 16 | 5 |  |\n| 20 | 6 | 7 |" and got[0].f == got[0].c
    assert got[1].p == "| Параметр | Значение |\n| --- | --- |\n| Вес | 5 кг |\n| Длина | 7 м |\n| Температура | 90 °C |" and got[1].c is None
    assert got[2].b == "- one continued\n2. two\n- three"
    assert got[3].f == "plain text." and got[3].c is None and got[3].p is None and got[3].b is None and got[4].f is None and got[5].f == ""


def test_table_presence_and_matrix(spark):
    md = "| Размер | Масса |\n| --- | --- |\n| 16 мм | 5,5 кг |\n| 20 мм | 7,5 кг |"
    df = texts(spark, "x\n" + md.replace(" --- ", "---"), "Размер и масса: 16 мм, 5,5 кг", "размер без чисел", "other")
    assert [r.s for r in df.orderBy("id").select(B.shows_table(F.col("text"), F.lit(md)).alias("s")).collect()] == [True, True, False, False]
    row = spark.createDataFrame([([["a", "b|"], ["c"]],), ([],)], "m array<array<string>>").select(B.matrix_markdown(F.col("m")).alias("t")).collect()
    assert [r.t for r in row] == ["| a | b\\| |\n| --- | --- |\n| c |  |", None]


def test_columns_and_nearest_tables(spark):
    cells = spark.createDataFrame([(1, 1, 0, "Name", "a"), (1, 1, 1, "1", ""), (1, 1, 2, "column 3", "x"), (1, 2, 2, "column 3", "y"), (2, 1, 0, "", "")], "doc long, row_no int, col int, name string, value string")
    assert {(r.doc, r.col) for r in B.pruned_columns(cells, ["doc"]).collect()} == {(1, 0), (1, 2), (2, 0)}
    rows = [(1, 1, "s", 0, False), (2, 1, "s", 1, True), (3, 1, "t", 2, False), (4, 1, None, 9, False), (5, 2, None, 0, True)]
    got = {(r.id, r.table_id, r.way) for r in B.nearest_tables(spark.createDataFrame(rows, "id long, documentId long, sectionPath string, chunkIndex int, has_table boolean")).collect()}
    assert got == {(1, 2, "section"), (2, 2, "own"), (3, 2, "near"), (5, 5, "own")}


def test_sku_cascade(spark):
    asked = spark.createDataFrame([("AB-12",), ("AB-13",), ("AB-14",), ("AB-15",), (None,)], "sku string")
    products = spark.createDataFrame([("ab 13", "1. Насос Альфа"), ("AB-14", "Насос Бета"), ("AB14", "Клапан Гамма"), ("AB-15", "Номенклатура")], "sku string, group_name string")
    docs = spark.createDataFrame([(1, "Паспорт AB-12"), (2, "Насос Альфа, паспорт"), (3, "Клапан")], "doc_id long, title string")
    got = {(r.sku, r.status, r.way, r.documents) for r in B.sku_cascade(asked, products, docs).collect()}
    assert got == {("AB-12", "resolved", "sku", 1), ("AB-13", "resolved", "group", 1), ("AB-14", "ambiguous", None, 0), ("AB-15", "unknown", None, 0)}


def test_vectors_and_concurrency(spark):
    rows = texts(spark, "насосы и клапаны", "насос клапан", "", None).select("id", B.hash_embedding(F.col("text")).alias("v")).collect()
    by = {r.id: r.v for r in rows}
    assert by[0] == by[1] and abs(sum(x * x for x in by[0]) - 1) < 1e-9 and by[2] is None and by[3] is None
    t0 = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([(i, "k", t0 + dt.timedelta(seconds=s), 10_000) for i, s in enumerate((0, 1, 2, 10, 30))] + [(9, None, t0, 1)], "event_id long, user string, ts timestamp, ms long")
    assert {(r.event_id, r.allowed) for r in S.concurrency_limit(ev, "user", "ts", "ms", most=2).collect()} == {(0, True), (1, True), (2, False), (3, True), (4, True)}
