import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kvasir.llm import abuse, defects, mixing, neighbours, residue, tokens
from kvasir.llm.conversations import conversations

T0 = dt.datetime(2024, 1, 1, 12)


def vectors(n, seed=0, spread=0.25, groups=12, size=16):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(groups, size))[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, size))
    return m * rng.uniform(0.5, 20, size=(n, 1))


def brute(m, k, floor):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    found = set()
    for i in range(len(m)):
        for j in np.argsort(-s[i], kind="stable")[:k]:
            if s[i, j] >= floor:
                found.add((min(i, int(j)), max(i, int(j))))
    return found


def test_neighbours_against_brute_force(spark):
    m = vectors(900)
    df = spark.createDataFrame([(i, json.dumps(v.tolist()), "x") for i, v in enumerate(m)], "id long, embedding string, vec string")
    want = brute(m, 5, 0.85)
    got = {(r.id_a, r.id_b) for r in neighbours.similar_pairs(df, size=16, block_rows=200, leaf=40, sample_rows=300).collect()}
    assert len(want & got) / len(want) >= 0.9
    assert len(want & got) / len(got) >= 0.9
    exact = {(r.id_a, r.id_b) for r in neighbours.similar_pairs(df, size=16, block_rows=2000, leaf=2000).collect()}
    assert len(exact ^ want) <= 4  # ties within 16 bits


def test_neighbours_across_the_borders_of_many_blocks(spark):
    m = vectors(2400, spread=0.3, groups=6)
    df = spark.createDataFrame([(i, json.dumps(v.tolist())) for i, v in enumerate(m)], "id long, embedding string")
    want = brute(m, 5, 0.85)
    got = {(r.id_a, r.id_b) for r in neighbours.similar_pairs(df, size=16, block_rows=75, leaf=40).collect()}
    assert len(want & got) / len(want) >= 0.97


def test_cells_are_bounded_and_keep_neighbours_together():
    m = vectors(6000, spread=0.3, groups=300)
    m /= np.linalg.norm(m, axis=1)[:, None]
    y = m.astype(np.float32) @ neighbours.projections(1, 16)[0]
    cells = neighbours.Cells(0.37)
    cells.grow(0, y, 1.0, 400)
    rows, nodes = cells.of(y)
    sizes = np.bincount(nodes)
    assert sizes.max() <= 400 and sizes[sizes > 0].min() > 20
    assert set(rows.tolist()) == set(range(6000)) and set(nodes.tolist()) <= set(cells.blocks())
    own = {}
    for r, at in zip(rows.tolist(), nodes.tolist()):
        own.setdefault(r, set()).add(at)
    pairs = brute(m, 5, 0.85)
    assert sum(not own[a].isdisjoint(own[b]) for a, b in pairs) >= 0.8 * len(pairs)
    same = neighbours.Cells(0.37)
    same.grow(0, np.ones((500, 3), np.float32), 1.0, 100)
    assert same.blocks() == [0]


def test_neighbours_of_bad_equal_and_repeated_rows(spark):
    one, two = [1.0, 0, 0, 0], [0, 1.0, 0, 0]
    rows = [(i, json.dumps(one)) for i in range(1, 10)] + [(1, json.dumps(one)), (20, "[2,0,0,0]"), (21, json.dumps([1.0, 0.01, 0, 0])), (22, json.dumps(two))]
    bad = [None, "", "null", "[]", "[1,2,3]", "[1,2,3,4", "[0,0,0,0]", "[1,2,3,NaN]", "[1,2,3,1e999]", '[1,2,3,"4"]', "[1,2,3,true]", "[1,2,3,null]", "{}"]
    rows += [(100 + i, b) for i, b in enumerate(bad)]
    df = spark.createDataFrame(rows, "id long, embedding string")
    links = neighbours.most_similar(df, size=4, k=3).collect()
    assert {r.id for r in links} == {*range(1, 10), 20, 21}
    of = lambda i: sorted(r.other for r in links if r.id == i)
    assert of(9) == [1, 2, 3] and of(1) == [2, 3, 4] and of(20) == [1, 2, 3] and of(21) == [1, 2, 3]
    assert neighbours.most_similar(df.limit(0), size=4).count() == 0


def test_chi_square_quantile():
    assert neighbours.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    assert neighbours.chi_square_quantile(0.5, 1) == pytest.approx(0.4549, abs=1e-3)


CHAT = "id long, userId long, sessionId string, query string, response string, createdAt timestamp_ntz"


def loop_conversations(rows):
    sessions = {}
    for r in {r[0]: r for r in rows}.values():
        if r[2] and r[2].strip():
            sessions.setdefault(r[2].strip().lower(), []).append(r)
    out = set()
    for s, own in sessions.items():
        if any(not (r[3] or "").strip() or not (r[4] or "").strip() or r[5] is None or not 2020 <= r[5].year <= 2030 for r in own):
            continue
        if len({r[1] for r in own if r[1] is not None}) > 1:
            continue
        own.sort(key=lambda r: (r[5], r[0]))
        n, last = 0, {}
        for r in own:
            before = last.get(r[3:5])
            last[r[3:5]] = r[5]
            if before is not None and (r[5] - before).total_seconds() <= 10:
                continue
            out |= {(s, 2 * n + 1, "user", r[0]), (s, 2 * n + 2, "assistant", r[0])}
            n += 1
    return out


def test_conversations_against_a_loop(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        hot = rng.random() < 0.4
        s = "hot" if hot else rng.choice(["a", " A", "b", "B ", "c", "d", "e", None, " "])
        at = T0 + dt.timedelta(seconds=int(rng.integers(0, 30_000 if hot else 9000)))
        at = [at, None, dt.datetime(1970, 1, 1)][rng.choice(3, p=[0.99, 0.005, 0.005]) if s in ("c", "d") else 0]
        text = str(rng.integers(0, 3)) if hot else rng.choice(["x", "y", "z"])
        rows.append((i, 1 if s != "e" else int(rng.integers(1, 3)), s, text, "r" if s != "b" or rng.random() < 0.99 else None, at))
    rows += rows[:40]
    got = {(r.session, r.pos, r.role, r.id) for r in conversations(spark.createDataFrame(rows, CHAT)).collect()}
    assert got == loop_conversations(rows)
    assert any(x[0] == "hot" for x in got)


def test_conversation_segments_and_empty_table(spark):
    at = [0, 20, 40, 9000, 9030, 90_000]
    df = spark.createDataFrame([(i, 1, "s", f"q{i}", "r", T0 + dt.timedelta(seconds=s)) for i, s in enumerate(at)], CHAT)
    got = {r.id: r.segment for r in conversations(df, gap_seconds=1800).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 2, 4: 2, 5: 3}
    assert conversations(df.limit(0)).count() == 0


def test_resend_across_the_hour(spark):
    a = dt.datetime(2024, 1, 1, 12, 59, 56)
    rows = [(1, 1, "s", "q", "r", a), (2, 1, "s", "q", "r", a + dt.timedelta(seconds=8)), (3, 1, "s", "q", "r", a + dt.timedelta(seconds=18)), (4, 1, "s", "q", "r", a + dt.timedelta(seconds=30))]
    assert sorted({r.id for r in conversations(spark.createDataFrame(rows, CHAT)).collect()}) == [1, 4]


TEXTS = ["", None, "Труба 16 мм — it's fine\n\n  x", "<|endoftext|> plain", "ﷺ 𝔘 é \x00 ½", "a" * 3000, " " * 50, "I'll DON'T 12345"]


def test_ids_equal_a_public_encoder_and_come_back(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    with open(tokens.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=tokens.PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(0, "")], "doc_id long, text string")
    ids = tokens.encode(df)
    got = {r.doc_id: r.ids for r in ids.collect()}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.text for r in tokens.decode(ids).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    counts = tokens.count_tokens(df.withColumn("source", F.lit("s")))
    assert {r.doc_id: r.tokens for r in counts.collect()} == {i: len(x) for i, x in got.items()}


def test_mix_shares_and_caps(spark):
    docs = spark.range(4000).selectExpr("id doc_id", "case when id % 3 > 0 then 'big' when id % 30 = 0 then 'small' when id % 7 = 0 then null else 'mid' end source", "5 + id % 11 tokens")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.1, 3), ("mid", 0.4, 2)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(docs.unionByName(docs.limit(50)), targets).collect()
    total = sum(r.tokens for r in mixed)
    for s, share, cap in (("big", 0.5, 1), ("small", 0.1, 3), ("mid", 0.4, 2)):
        own = [r for r in mixed if r.source == s]
        assert sum(r.tokens for r in own) / total == pytest.approx(share, abs=16 / total)
        assert max(r["repeat"] for r in own) <= cap
        assert len({(r.doc_id, r["repeat"]) for r in own}) == len(own)
    at = [r.position for r in mixed]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    have = {s: sum(r.tokens for r in docs.where(F.col("source") == s).collect()) for s in ("big", "small", "mid")}
    assert total == pytest.approx(min(have["big"] / 0.5, have["small"] * 3 / 0.1, have["mid"] * 2 / 0.4), rel=0.01)
    assert mixing.mix(docs.limit(0), targets).count() == 0
    small = mixing.mix(docs, targets, total_tokens=1000).collect()
    assert abs(sum(r.tokens for r in small) - 1000) < 48
    shares = {r.source: r for r in mixing.reached_shares(spark.createDataFrame(mixed), targets).collect()}
    assert shares["small"].most_repeats <= 3 and shares["big"].actual_share == pytest.approx(0.5, abs=0.001)


def test_mix_follows_its_curriculum(spark):
    docs = spark.range(3000).selectExpr("id doc_id", "case when id % 10 = 0 then 'scarce' else 'usual' end source", "10 tokens")
    targets = spark.createDataFrame([("usual", 0.6, 1), ("scarce", 0.4, 4)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(docs, targets).collect()
    early = [r.source == "scarce" for r in mixed if r.position < 0.2]
    late = [r.source == "scarce" for r in mixed if r.position > 0.8]
    assert sum(early) / len(early) < 0.4 < sum(late) / len(late)


PRODUCT = ["The warranty runs 24 months from the date of sale.", "Материал корпуса — латунь, толщина стенки 4,2 мм.", "Werkstoff: Messing; Wandstärke 3,1 mm.", "Article ZU-42: diameter 20 mm."]
BAD = [
    "Гарантия 12 месяцев. Здесь будет описание товара.", "Store {{brand}} products in a dry room.", "ERROR 404 page not found", "Lorem ipsum dolor sit amet consectetur",
    "Включите JavaScript в браузере, иначе не получится открыть содержимое.", "Артикул [вставьте название изделия]: диаметр 20 мм.", "please ennable javascript to view this page",
]
GOOD = [
    "В шаблоне письма поле {{order_no}} подставляет складская программа, менять его вручную не нужно.", "Код ошибки 404 на дисплее контроллера означает обрыв датчика.",
    "The online calculator needs JavaScript in the browser; this data sheet can be read without it.", "Date of sale ____________ Signature ____________", "<|endoftext|> [PAD]", "", None, "  ",
    "Permitted diameters {16, 20, 25} mm; see note [3].",
]


def test_residue(spark):
    rows = [(i, t) for i, t in enumerate(BAD + GOOD + PRODUCT * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r.doc_id for r in residue.residue_scores(df).where("score > 0").collect()}
    assert got == set(range(len(BAD)))
    assert residue.without_residue(df).count() == len(rows) - len(BAD)
    assert residue.residue_scores(df.limit(0)).count() == 0


def test_residue_of_long_odd_and_near_forms(spark):
    bad = [
        "Name: [Insert a detailed description of the product, its use, its benefits and, where it applies, the conditions of storage and transport here]", "Size {{ " + "a_long_name_" * 12 + " }} mm",
        "MAGNA AD QUIS LABORIS EX LOREM SIT ADIPISCING DO", "Каталог не откроется без сценариев.", "Veuillez activer JavaScript pou rafficher cette page.", "The file you requested has been removed", "<НАЗВАНИЕ СЕРИИ>",
    ]
    good = ["See {16; 20; 25} and [3].", "<b>bold</b> <name>", "#shift __init__ $5 or $6 %d", "Le joint est sec et ne fuit pas, do not sit in it.", "If the display shows \"not found\", check the sensor wiring.", "[" * 500]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(bad + good + PRODUCT * 60)], "doc_id long, text string")
    assert {r.doc_id for r in residue.residue_scores(df).where("score > 0").collect()} == set(range(len(bad)))


def test_residue_in_a_long_text(spark):
    df = spark.createDataFrame([(1, " ".join(PRODUCT * 3000) + " Internal server error. " + " ".join(PRODUCT * 50)), (2, " ".join(PRODUCT))], "doc_id long, text string")
    assert {r.doc_id: r.kind for r in residue.residue_scores(df).collect()} == {1: "error", 2: None}


ANSWERS = {
    "en": ["The warranty of the valve runs {} months from the date of sale.", "Tighten the union nut to {} Nm and check the joint again after {} hours.", "The meter is read monthly and its error stays below {} percent."],
    "ru": ["Гарантийный срок на кран составляет {} месяцев со дня продажи.", "Затяните гайку с моментом {} и проверьте соединение через {} часов.", "Показания прибора снимают ежемесячно, погрешность не выше {} процентов."],
}


def test_defects(spark):
    corpus = [(a.format(i, i), lang) for lang, texts in ANSWERS.items() for a in texts for i in range(40)]
    good = [(1000 + i, "How long is the warranty of the valve?" if lang == "en" else "Какой гарантийный срок на кран?", " ".join(x.format(i, i) for x in texts)) for i in range(60) for lang, texts in ANSWERS.items()]
    q, en, ru = "How long is the warranty of this valve?", ANSWERS["en"], ANSWERS["ru"]
    cases = [
        (1, q, None, "empty"), (2, q, " — ", "empty"), (3, q, "NaN", "empty"), (4, q, "> " + q, "copy"), (5, q, f"You asked: «{q}» {q.upper()}", "copy"),
        (6, q, "I'm sorry, but I can't help with that. Please contact a manager.", "refusal"), (7, q, ru[0].format(3) + " " + ru[2].format(5), "other_language"),
        (8, q, en[0].format(3) + " Tighten the union nut to", "truncated"), (9, q, en[0].format(3) + "\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |", "truncated"),
        (10, q, en[0].format(3) + " You will need:", "truncated"), (11, "Please answer in Russian. " + q, ru[0].format(3), None), (12, "ZU-42-1234", ru[0].format(3), None),
        (13, q, en[0].format(3) + "\nArticle: ZU-42-1234", None), (14, q, en[0].format(3) + "\n\nKind regards, support", None), (15, q, en[0].format(3) + "\n- " + en[1].format(3, 4)[:-1], None),
        (16, None, en[0].format(3), None), (17, q, "I'm sorry to hear that. " + en[0].format(3), None),
    ]
    rows = [(i, q, a) for i, q, a, _ in cases] + good
    df = spark.createDataFrame(rows + rows[:5], "id long, query string, response string").withColumn("defect", F.lit(1))
    got = {r.id: r.defect for r in defects.defective_pairs(df, spark.createDataFrame(corpus, "text string, lang string")).collect()}
    assert got == {i: d for i, _, _, d in cases if d}
    none = spark.createDataFrame([], "text string, lang string")
    assert defects.defective_pairs(df.limit(0), none).count() == 0


def test_words_of_obfuscated_texts():
    assert abuse.words_of("Ты к_р_е_т_и_н, d-u-m-b!") == ["ты", "кретин", "dumb", "!"]
    assert abuse.words_of("и д и о т") == ["идиот"]
    assert abuse.words_of("cyкa ZU-42-1234 a$$") == ["сука", "0", "ass"]
    assert abuse.words_of(" ​ ") == []


def test_network_gradients():
    net = abuse.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, mask = rng.normal(size=(3, 5, abuse.DIM)), np.ones((3, 5))
    mask[1, 3:] = 0
    target, weight = np.eye(4)[[0, 1, 2]], np.ones(3)

    def loss():
        q = net.forward(x @ net.p["fx"] + net.p["f0"], x @ net.p["bx"] + net.p["b0"], mask)
        return -(target * np.log(q)).sum() / 3

    g, dx = net.gradients(x, mask, target, weight)
    for key in ("fh", "bx", "att", "attv", "out", "b0"):
        at = tuple(0 for _ in net.p[key].shape)
        old = net.p[key][at]
        net.p[key][at] = old + 1e-4
        up = loss()
        net.p[key][at] = old - 1e-4
        down = loss()
        net.p[key][at] = old
        assert g[key][at] == pytest.approx((up - down) / 2e-4, rel=2e-2, abs=1e-5)
    old = x[0, 0, 0]
    x[0, 0, 0] = old + 1e-4
    up = loss()
    x[0, 0, 0] = old - 1e-4
    assert dx[0, 0, 0] == pytest.approx((up - loss()) / 2e-4, rel=2e-2, abs=1e-5)


def test_abuse_is_learnt_and_found_anywhere(spark):
    bad, fine = ["you utter fool", "ты дурак", "shut up you fool"], ["tighten the nut", "the valve is fine", "гарантия на кран", "проверьте соединение", "the fool proof valve is fine"]
    rng = np.random.default_rng(1)
    chat, labels = [], []
    for i in range(500):
        words = [fine[j] for j in rng.integers(0, len(fine), 4)]
        if i % 4 == 0:
            words.insert(int(rng.integers(0, 4)), bad[int(rng.integers(0, 3))])
        chat.append((i, " ".join(words), None if i % 50 == 1 else fine[i % 5], "website"))
        labels.append((i, "query", "abuse" if i % 4 == 0 else "clean"))
    df = spark.createDataFrame(chat + chat[:9], "id long, query string, response string, source string")
    marks = spark.createDataFrame(labels[:400] + labels[:20], "chatId long, field string, label string")
    model = abuse.fit_abuse(df, marks)
    again = abuse.fit_abuse(df, marks)  # from the shared folder
    assert again.threshold == model.threshold and all((again.net.p[k] == v).all() for k, v in model.net.p.items())
    scores = abuse.abuse_scores(df, model)
    rows = {(r.id, r.field): r.score for r in scores.collect()}
    assert len(rows) == 1000
    held = [(rows[i, "query"] >= 0.5) == (i % 4 == 0) for i in range(400, 500)]
    assert sum(held) >= 95
    assert rows[1, "response"] == 0
    rates = {r.field: r.rate for r in abuse.abuse_rates(scores).collect()}
    assert rates["query"] > 0.2 and rates["response"] < 0.05
    assert abuse.fit_abuse(df, marks.limit(0)) is None
    assert abuse.abuse_scores(df, None).agg(F.max("score")).first()[0] == 0
    assert abuse.abuse_scores(df.limit(0), model).count() == 0


def test_wrong_verdicts_are_left_out():
    rng = np.random.default_rng(7)
    fine = ["tighten the nut", "the valve is fine", "check the joint", "how long is the warranty", "send the data sheet"]
    said = [(f"{fine[i % 5]} {fine[(i // 5) % 5]} {i % 90} x{i % 37}", "clean") for i in range(500)]
    said += [(f"{fine[i % 5]} you {rng.choice(['fool', 'idiot'])} x{i}", "abuse") for i in range(120)]
    said += [(f"please {fine[i % 5]} for series x{i}", "abuse") for i in range(4)]  # wrong
    said += [(f"please {fine[i % 5]} for series x{i}", "clean") for i in range(20, 60)]
    model = abuse.train(said)
    score = lambda t: float(abuse.Scorer(model.net).scores([abuse.words_of(t)]).sum())
    assert score("please tighten the nut for series x9") < 0.5 < score("check the joint you idiot x3")


def test_long_words_are_read_whole():
    word = "".join(chr(97 + i) for i in np.random.default_rng(0).integers(0, 26, 60))
    assert set(abuse.grams_of(word[-8:])[3:]) & set(abuse.grams_of(word)) and len(abuse.grams_of(word)) > 150
