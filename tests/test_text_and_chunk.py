from pyspark.sql import functions as F

from kvasir.functions import text as T
from kvasir.functions.blank import is_blank
from kvasir.operators import chunk as C


def one(spark, expr, *values):
    rows = spark.createDataFrame([(v,) for v in values], "x string").select(expr(F.col("x")).alias("y")).collect()
    return [r.y for r in rows]


def test_blank(spark):
    bare = [None, "", "  ", " \n", "​", "—", "...", '""', "**", "null", "None", "NaN", "undefined", "<NA>", "(null)"]
    filled = ["a", "0", "nul", "no", "нет", "-5", "none of it"]
    assert one(spark, is_blank, *bare) == [True] * len(bare)
    assert one(spark, is_blank, *filled) == [False] * len(filled)


def test_inflected_words_share_stems(spark):
    a, b = one(spark, T.tokens, "теплого пола", "тёплый пол")
    assert a == b == ["тепл", "пол"]
    assert one(spark, T.tokens, None, "", "и на для", "Труба PE-Xa 16") == [[], [], [], ["труб", "pe-xa"]]


def python_stem(w):
    for s in T.SUFFIXES:
        if w.endswith(s) and len(w) - len(s) >= 3:
            return w[: -len(s)]
    return w


def test_stem_against_the_list(spark):
    words = ["трубами", "ии", "дия", "синий", "синими", "а", "дом", "дома", "мия", "армиями", "аиями", "пол", "полы", "ёлка"]
    assert one(spark, T.stem, *words) == [python_stem(w) for w in words]


def test_normalisers(spark):
    assert one(spark, T.section_path, "1.1.", "1,2,3.4.5", None, "гл. 2") == ["1.1", "1.2.3.4", "", ".2"]
    assert one(spark, T.table_cell, "12 5", "a|b", None, " x  y ") == ["12,5", "a\\|b", "", "x y"]
    assert one(spark, T.strip_footnotes, "срок² службы(1)", None) == ["срок службы", None]
    assert one(spark, T.estimate_tokens, "", "abcd", "abcde") == [1, 1, 2]
    assert one(spark, T.sku_key, "zu-53 4704", "--", None) == ["ZU534704", None, None]
    assert one(spark, T.model_codes, "серия ZU-42, ZU-42-1234 и ZU-42", None) == [["ZU-42", "ZU-42-1234"], []]
    assert one(spark, T.numeric_skus, "8701 x12345 123 456789", None) == [["8701", "456789"], []]
    assert one(spark, T.clean_text, "тру-\nба\n12\nи  кран") == ["труба и кран"]


def test_paragraphs(spark):
    df = spark.createDataFrame([(1, "a\n\nb\n\n\nc"), (2, "A. B. C. D. E."), (3, "A. B."), (4, ""), (5, None)], "id int, t string")
    got = {(r.id, r.pos): r.paragraph for r in C.paragraphs(df, "id", "t").collect()}
    assert got == {(1, 0): "a", (1, 1): "b", (1, 2): "c", (2, 0): "A. B. C. D.", (2, 1): "E.", (3, 0): "A. B."}


def test_headings_count_within_their_parent(spark):
    text = "# A\n## B\n```\n# no\n```\n## C\n### D\n# E\n### F"
    df = spark.createDataFrame([(1, text), (2, None), (3, "plain")], "id int, t string")
    got = sorted((r.no, r.title, r.path) for r in C.headings(df, "id", "t").collect())
    assert got == [(0, "A", "1"), (1, "B", "1.1"), (5, "C", "1.2"), (6, "D", "1.2.1"), (7, "E", "2"), (8, "F", "2.1.1")]


def test_pipe_tables(spark):
    text = "x\n| a | |\n|---|:-:|\n| 1 | 2 |\n| 3 | p\\|q |\n\n| no | divider |\n| 1 | 2 |"
    df = spark.createDataFrame([(1, text)], "id int, t string")
    got = sorted((r.table_no, r.row_no, r.name, r.value) for r in C.pipe_tables(df, "id", "t").collect())
    assert got == [(1, 1, "a", "1"), (1, 1, "column 2", "2"), (1, 2, "a", "3"), (1, 2, "column 2", "p\\|q")]


def python_pack(text, most, overlap, least):
    size = lambda x: max(1, -(-len(x) // 4))
    done, open_, fresh = [], [], False
    for x in (p.strip(" ") for p in text.split("\n")):
        if len(x) < least:
            continue
        n = sum(map(size, open_))
        if n > 0 and n + size(x) > most:
            done.append(open_)
            kept, t = [], 0
            for y in reversed(open_):
                if t < overlap:
                    kept.insert(0, y)
                    t += size(y)
            open_ = (kept if len(kept) < len(open_) else []) + [x]
        else:
            open_ = open_ + [x]
        fresh = True
    return done + [open_] if fresh else done


def test_token_packs_against_a_loop(spark):
    text = "\n".join(("ab" * (1 + (i * 7) % 23)) for i in range(40))
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, t string")
    rows = C.pack_tokens(df, "id", "t", most=30, overlap=8, least_chars=5).orderBy("id", "pos").collect()
    assert [r.chunk.split("\n") for r in rows if r.id == 1] == python_pack(text, 30, 8, 5)
    assert {r.id for r in rows} == {1}


def test_paragraph_pack(spark):
    df = spark.createDataFrame([(1, "aaa\nbbb\n" + "c" * 20 + "\nd")], "id int, t string")
    assert [r["pack"] for r in C.pack_paragraphs(df, "id", "t", 10).orderBy("pos").collect()] == ["aaa\n\nbbb", "c" * 20, "d"]


def test_element_type(spark):
    texts = ["- one\n- two", "a | b", "HEAD", "Some plain text.", "a  b\nc  d"]
    assert one(spark, C.element_type, *texts) == ["list", "table", "header", "text", "table"]
