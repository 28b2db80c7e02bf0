import io
import os
import zipfile
import zlib

from pyspark.sql import functions as F

from kvasir.functions import intent as I
from kvasir.functions import text as T
from kvasir.operators import answer as A
from kvasir.operators import boost as B
from kvasir.operators import ingest as N
from kvasir.operators import layout as L
from kvasir.operators import resolve as R
from kvasir.operators import score as S
from kvasir.operators import store as O
from kvasir.sources import files


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id long, text string")


def test_intent(spark):
    asked = texts(spark, "Посоветуйте аналог другого производителя", "Аналог Talvex взамен Brelko", "труба", "Расскажи про монтаж трубы", "Характеристики", None, "Ёмкость и параметры насоса")
    t = F.col("text")
    rows = asked.select("id", I.asks_competitor(t, ("brelko",), ("talvex",)).alias("c"), I.names_product_only(t).alias("b"), I.asks_installation(t).alias("i"), I.too_generic(t).alias("g"), I.catalog_only(t).alias("o")).collect()
    got = {r.id: r for r in rows}
    assert got[0].c and not got[1].c and got[2].b and not got[3].b and got[3].i and got[4].g and not got[6].g and got[6].o and got[5].c is None


def test_models_and_names(spark):
    df = texts(spark, "RUN-X5 Н и DN20, PEX; abc", "1.2. Насос Grund", "Номенклатура", "Товар A1\nАртикул: 5")
    rows = {r.id: r for r in df.select("id", T.models(F.col("text")).alias("m"), T.section_name(F.col("text")).alias("n"), T.name_from_content(F.col("text")).alias("c")).collect()}
    assert rows[0].m == ["RUN-X5-H", "ABC"] and rows[1].n == "Насос Grund" and rows[2].n is None and rows[3].c == "Товар A1"
    name = texts(spark, "a/b%20c?.pdf", "x" * 200, "").select(T.safe_filename(F.col("text")).alias("n")).collect()
    assert [r.n for r in name] == ["b c_.pdf", "x" * 176 + ".pdf", "document.pdf"]


def test_model_scope_and_subject(spark):
    heads = spark.createDataFrame([("Насос RUN-X5", 1, "1"), ("Насос RUN-X5-9", 1, "2"), ("Размеры RUN-X5", 1, "3"), ("Клапан обратный", 2, "1")], "name string, documentId long, sectionPath string")
    asked = spark.createDataFrame([(1, "что за RUN-X5"), (2, "RUN-X"), (3, "RUN-X5-9-1"), (4, "A-1 и B-22, C-33"), (5, None)], "query_id long, text string")
    got = {r.query_id: (r.found, r.sections) for r in R.model_scope(asked, heads).collect()}
    assert got == {1: ("exact", 1), 2: ("none", 0), 3: ("related", 2)}
    subject = R.subject_match(spark.createDataFrame([(1, "Характеристики обратного клапана"), (2, "про всё")], "query_id long, text string"), heads.select("name"))
    assert [(r.query_id, r.name) for r in subject.collect()] == [(1, "Клапан обратный")]


def test_assortment_tolerates_one_typo(spark):
    entries = spark.createDataFrame([("Клапан балансировочный", "group", 1), ("Клапан обратный", "group", 1), ("клапан_обратный.pdf", "item", 0), ("Монтаж клапана", "line", 2)], "name string, kind string, priority int")
    asked = spark.createDataFrame([(1, "какие есть клапаны"), (2, "какие есть балансировочныи клапаны"), (3, "сколько стоит клапан")], "query_id long, text string")
    got = {(r.query_id, r.name) for r in R.assortment(asked, entries).collect()}
    assert got == {(1, "Клапан балансировочный"), (1, "Клапан обратный"), (2, "Клапан балансировочный")}


def test_applicable(spark):
    bind = "documentId long, skus array<string>, categories array<string>, lines array<string>, catalogs array<long>"
    bindings = spark.createDataFrame([(1, ["5"], [], [], []), (2, [], ["Valves_A"], [], []), (3, [], ["valves a"], ["x"], []), (4, [], [], [], [9]), (5, [], ["valves a"], [], [8])], bind)
    matches = spark.createDataFrame([("5", 9, "valves a")], "sku string, catalogId long, label string")
    got = {(r.documentId, r.score) for r in R.applicable(spark.createDataFrame([("5",), ("6",)], "sku string"), matches, bindings).collect()}
    assert got == {(1, 3), (2, 2), (4, 1)}


def test_tables_in_answers(spark):
    md = "Таблица 1:\n| a | b |\n|---|---|\n| 1 | 2 |\nafter"
    df = texts(spark, md, None, "x\n\n\n\ny  \nz")
    got = {r.id: r for r in df.select("id", A.strip_tables(F.col("text")).alias("s"), A.table_heading(F.col("text")).alias("h")).collect()}
    assert got[0].s == "after" and got[0].h == "Таблица 1:" and got[2].s == "x\n\ny\nz" and got[1].s is None
    put = texts(spark, "intro\nSizes: all\nend", "none").select(A.insert_table(F.col("text"), F.lit("sizes"), F.lit("[t]"), F.lit("|m|")).alias("t")).collect()
    assert [r.t for r in put] == ["intro\nSizes:\n\n|m|\nall\nend", "none\n\n[t]\n|m|"]
    cells = spark.createDataFrame([(1, 1, 0, "Значение", "5"), (1, 1, 1, "Характеристика", "a|b"), (1, 1, 2, "7", "x")], "doc long, row_no int, col int, name string, value string")
    assert A.table_markdown(cells, ["doc"]).first().markdown == "| Характеристика | Значение |\n| --- | --- |\n| a\\|b | 5 |"


def test_boosts_and_fusion(spark):
    row = {"q": ["насос", "монтаж"], "title": ["насос"], "section": ["монтаж"], "tags": [], "variant": [], "terms": ["насос"], "query": "монтаж насоса", "content": "насос", "path": "монтаж", "head": "насос", "skus": [], "sku_products": 0, "docType": "instruction", "installation": True, "catalog": False}
    schema = "q array<string>, title array<string>, section array<string>, tags array<string>, variant array<string>, terms array<string>, query string, content string, path string, head string, skus array<string>, sku_products long, docType string, installation boolean, catalog boolean"
    r = B.with_boosts(spark.createDataFrame([tuple(row[k.split()[0]] for k in schema.split(", "))], schema)).first()
    assert r.reasons == ["section_match", "title_match", "title_coverage", "distinctive_title_hit", "installation_instruction_priority", "term_overlap"]
    assert abs(r.boost - (0.1 + 0.08 + 0.32 + 0.28 + 0.2 + 0.05)) < 1e-9
    bare = {**row, "title": [], "q": [], "terms": []}
    assert B.with_boosts(spark.createDataFrame([tuple(bare[k.split()[0]] for k in schema.split(", "))], schema)).first().reasons == ["installation_instruction_priority"]
    f = spark.range(1).select(B.fused(F.lit(0.5), F.lit(1.0), F.lit(5.0), F.lit(True)).alias("a"), B.fused(F.lit(None).cast("double"), F.lit(1.0), F.lit(-5.0), F.lit(False)).alias("b")).first()
    assert abs(f.a - (0.3 + 0.4 + 0.85)) < 1e-9 and abs(f.b - (0.85 - 0.5)) < 1e-9
    assert B.normal_weights(3, 1) == (0.75, 0.25) and B.normal_weights(0, 0) == (0.6, 0.4)


def test_page_geometry(spark):
    words = spark.createDataFrame([(1, 1, "m", 20.0, 10.0, 8.0, 10.0), (1, 2, "2", 28.5, 6.0, 3.0, 5.0), (1, 0, "five", 0.0, 11.0, 15.0, 10.0), (1, 3, "next", 0.0, 30.0, 9.0, 10.0), (1, 4, "far", 60.0, 30.0, 9.0, 10.0)], "page long, id long, text string, x double, y double, width double, height double")
    assert L.positioned_text(words, ["page"]).first().text == "five m^2\nnext  far"
    assert [r.col for r in L.column_anchors(words, ["page"]).orderBy("id").collect()] == [0, 1, 1, 0, 2]
    rule = "page long, id long, x double, y double, width double, height double"
    flat = [(1, i, 0.0, y, 40.0, 0.0) for i, y in enumerate((0.0, 10.0, 20.0))]
    steep = [(1, 10 + i, x, 0.0, 0.0, 20.0) for i, x in enumerate((0.0, 20.0, 40.0))]
    lines = spark.createDataFrame([*flat, *steep, (1, 99, 500.0, 0.0, 5.0, 5.0)], rule)
    assert {(r.id, r.grid) for r in L.touching_groups(lines, ["page"]).collect()} == {(0, 0), (1, 0), (2, 0), (10, 0), (11, 0), (12, 0), (99, 99)}
    cells = spark.createDataFrame([(1, 1, "a", 5.0, 2.0, 4.0, 4.0), (1, 2, "b|", 25.0, 2.0, 4.0, 4.0), (1, 3, "c", 5.0, 12.0, 4.0, 4.0), (1, 4, "out", 90.0, 2.0, 4.0, 4.0)], words.schema)
    assert [r.markdown for r in L.grid_tables(lines, cells, ["page"]).collect()] == ["| a | b\\| |\n| --- | --- |\n| c |  |"]


def test_continued_tables():
    head = "| A | B |\n| --- | --- |\n"
    text = f"Таблица 1 Sizes\n\n{head}| 1 | 2 |\n\n## Страница 2\n\nПродолжение таблицы 1\n\n{head}| 3 | 4 |\n\nend"
    done, joined, failed = N.joined_tables(text)
    assert (joined, failed) == (1, 0) and "| 1 | 2 |\n| 3 | 4 |" in done and done.count("| A | B |") == 1
    assert N.joined_tables(text.replace("таблицы 1", "таблицы 2"))[1:] == (0, 1)
    assert N.joined_tables("plain")[0] == "plain\n"


def test_ingest_of_rows_and_headings(spark):
    cells = spark.createDataFrame([(1, 1, 0, "Артикул", "Артикул"), (1, 2, 0, "Артикул", "55-1"), (1, 2, 1, "Наименование", "Pump"), (1, 3, 0, "Артикул", "551"), (1, 4, 0, "Артикул", "")], "doc long, row_no int, col int, name string, value string")
    assert [(r.sku, r.name, r.row_no) for r in N.products_from_rows(cells, ["doc"]).collect()] == [("55-1", "Pump", 2)]
    assert [r.kind for r in N.table_kinds(cells, ["doc"]).collect()] == ["nomenclature"]
    rec = N.records(cells, ["doc"]).where("row_no = 2").first().record
    assert rec == {"Артикул": "55-1", "Наименование": "Pump"}
    heads = N.numbered_headings(texts(spark, "1.2. Монтаж\n3 мм зазор\nГлава 4 Прочее\n2. Ends here.", None), "id", "text").collect()
    assert [(r.no, r.path, r.title) for r in sorted(heads, key=lambda r: r.no)] == [(0, "1.2", "Монтаж"), (2, "4", "Глава 4 Прочее")]
    parts = N.sections_by_titles(texts(spark, "a\n# b\nc\nd"), "id", "text", spark.createDataFrame([(0, 1, "b")], "id long, no int, title string")).collect()
    assert {(r.section, r.lines) for r in parts} == {(0, 1), (1, 3)}


def xml_zip(parts):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return raw.getvalue()


def test_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    doc = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    sheet = f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row></sheetData></worksheet>'
    stream = zlib.compress(b"BT (Hello \\(x\\)) Tj 0 -12 Td [(wor) -20 (ld)] TJ ET")
    pdf = b"%PDF-1.4\n1 0 obj <</Length 9>>\nstream\n" + stream + b"\nendstream\nendobj"
    made = {"a.docx": xml_zip({"word/document.xml": doc}), "b.xlsx": xml_zip({"xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": f"<sst {s}><si><t>n</t></si></sst>"}), "c.pdf": pdf, "d.md": "# H\ntext\n| a |\n|---|\n```\nx\n```\n".encode(), "e.pdf": b"nope", "f.exe": b"x", "g.txt": b" ", "h.docx": b"PK\x03\x04broken"}
    for name, raw in made.items():
        (tmp_path / name).write_bytes(raw)
    got = {}
    for r in files.read_files(spark, str(tmp_path)).collect():
        got.setdefault(r.name, []).append((r.status, r.element, r.content))
    assert got["a.docx"] == [("ok", "header", "Title"), ("ok", "table", "| a |\n| --- |")]
    assert got["b.xlsx"] == [("ok", "table", "| n |  | 5 |\n| --- | --- | --- |")]
    assert got["c.pdf"] == [("ok", "text", "Hello (x)\nworld")]
    assert [e for _, e, _ in got["d.md"]] == ["header", "text", "table", "code"]
    assert [got[n][0][0] for n in ("e.pdf", "f.exe", "g.txt", "h.docx")] == ["unknown", "unknown", "empty", "empty"]
    assert files.read_files(spark, str(tmp_path), most=3).where("name = 'c.pdf'").first().status == "large"


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    files.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, "k")
    files.replace_partitions(spark.createDataFrame([(2, "c")], "k int, v string"), path, "k")
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c")}
    files.append_batches(spark.range(10).coalesce(1), str(tmp_path / "b"), 4)
    assert len([f for f in os.listdir(tmp_path / "b") if f.endswith(".parquet")]) == 3
    files.save_setting(str(tmp_path / "s"), "one")
    assert (tmp_path / "s").read_text() == "one" and len(os.listdir(tmp_path)) == 3


def test_upkeep(spark):
    docs = spark.createDataFrame([(1, "failed", 7), (2, "indexed", 7), (3, "processing", 7), (4, "failed", 8), (5, "failed", None)], "doc_id long, status string, syncSourceId long")
    got = {(r.doc_id, r.action) for r in O.delete_source(docs, spark.createDataFrame([(7,)], "syncSourceId long")).collect()}
    assert got == {(1, "delete"), (2, "detach"), (3, "fail")}
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert {(r.k, r.v) for r in O.insert_or_update(old, new, ["k"], "v").collect()} == {(1, "a"), (2, "b"), (3, "c")}
    assert {(r.k, r.v) for r in O.replace_by_key(old, new, "k").collect()} == {(1, "a"), (2, None), (3, "c")}
    none = {r.name: r.orphans for r in O.orphan_counts({"t": (spark.createDataFrame([(1, 5), (1, 5), (2, None)], "id long, p long"), "p")}, spark.createDataFrame([], "doc_id long"), "doc_id").collect()}
    assert none == {"t": 1}


def test_postings_read_once_and_repeated_rows_count_once(spark):
    corpus = texts(spark, "steel ring ring", "steel", None)
    twice = corpus.unionAll(corpus)
    asked = spark.createDataFrame([(1, "ring steel")], "query_id long, text string")
    once = {(r.id, round(r.score, 9)) for r in S.bm25(asked, corpus, "id", "text").collect()}
    assert once == {(r.id, round(r.score, 9)) for r in S.bm25(asked, twice, "id", "text").collect()} and {i for i, _ in once} == {0, 1}
