import pytest
from pyspark.sql import functions as F

from kvasir.functions import unicode as U
from kvasir.operators import moderate as M


def found(text, terms, exceptions=()):
    return M.inspect(text, M.TermList(tuple(terms), tuple(exceptions))).rules


def test_forms_masks_and_disguised_letters():
    terms = ["насос*", "красный кран", "pump", "труба"]
    assert found("Ваши НАCОСЫ хороши", terms) == ["насос*"]  # with a Latin C
    assert found("н*сосы и нас&#1086;с", terms) == ["насос*"]
    assert found("**нас**осы", terms) == ["насос*"]  # emphasis
    assert found("на​сос", terms) == ["насос*"]
    assert found("красного  кр#на!", terms) == ["красный кран"]
    assert found("красный большой кран", terms) == []
    assert found("поднасос", terms) == []
    assert found("pumps, pumping", terms) == ["pump"] and found("pumper", terms) == []
    assert found("трубами", terms) == ["труба"] and found("трубач", terms) == []
    assert found("т р у б а", terms) == ["труба"] and found("т.р.у.б.у", terms) == ["труба"]
    assert found("т*", terms) == [] and found("*****", terms) == []


def test_phrases_come_first_and_at_most_eight():
    terms = ["a1", "b2", "c3", "d4", "e5", "f6", "g7", "h8", "i9x", "pump valve"]
    words = " ".join(t for t in terms)
    assert found("pump valve aa1", ["pump", "pump valve"]) == ["pump valve", "pump"]
    assert len(found(words.replace("1", "a"), [f"{t}*" for t in ("pu", "va", "aa", "b2", "c3", "d4", "e5", "f6", "g7", "h8", "i9")])) <= 8


def test_exceptions_by_position():
    assert found("срок службы", ["срок", "служб*"], ["срок службы"]) == []
    assert found("срок службы и срок", ["срок", "служб*"], ["срок службы"]) == ["срок"]


def test_length_and_lists():
    assert M.inspect("x" * 200_001, M.TermList(("x",))) == M.Finding(True, [], "too_long")
    assert M.is_valid_list("насос*\nкрасный кран") and not M.is_valid_list("на*сос") and not M.is_valid_list("a b c d e f g") and not M.is_valid_list("x")
    assert not M.is_valid_list("насос*", stems=False) and not M.is_valid_list("\n".join(f"слово{i}" for i in range(201)))
    assert M.list_lines(" a  b \n\na b\r\nc") == ["a b", "c"]
    assert set(M.word_forms("красный")) >= {"красный", "красного", "красная"} and M.word_forms("иди") == ["иди", "идите"] and M.word_forms("по") == ["по"]


def test_scan_gate_and_journal(spark):
    rows = [(1, "a pump", "ok", "x"), (2, "fine", "the pump", "x"), (3, None, None, "x"), (4, "y" * 150_000, "y" * 60_000, "x"), (1, "a pump", "ok", "x")]
    df = spark.createDataFrame(rows, "id long, t string, label string, rules_of string")
    assert sorted((r.id, r["rules"], r.reason) for r in M.scan(df, "id", "t", ["pump"]).collect()) == [(1, "pump", "term")] * 2
    got = {r.id: r for r in M.gate(df, "id", "t", ["label"], "pump", "-").collect()}
    assert {i: (r.blocked, r.reason) for i, r in got.items()} == {1: (True, "term"), 2: (True, "term"), 3: (False, None), 4: (True, "too_long")}
    assert got[2].t == "-" and got[2].label is None and got[3].t is None
    assert {r.reason for r in M.gate(df, "id", "t", ["label"], "p*mp", "-").collect()} == {"settings_error"}
    assert not any(r.blocked for r in M.gate(df, "id", "t", ["label"], "pump", "-", enabled=False).collect())
    kept = M.journal(M.scan(df, "id", "t", ["pump"]).join(df.dropDuplicates(["id"]), "id").withColumn("at", F.col("id")), "t", "at").collect()
    assert len(kept[0].digest) == 64 and "pump" in kept[0]["rules"]
    assert M.scan(df.limit(0), "id", "t", ["pump"]).count() == 0


def test_functions_in_sql(spark):
    U.register(spark, ("pump",))
    row = spark.sql("select normalize_token('Ёлка É') n, stem_token('насосами') s, inspect_text('two pumps') r, inspect_text(null) z").first()
    assert row.s == "насос" and row.r == "pump" and row.z is None
    assert row.n == "ёлка é".replace("ё", "ё") or row.n.startswith("е")
    with pytest.raises(Exception):
        spark.sql("select inspect_text()").collect()
