"""Wrong encodings: found and restored, clean look-alikes left alone."""

import pytest

from knowloom.llm import encodings as E

CLEAN = [
    "Die Größe beträgt 3 Zeichen; darüber lässt das Werkzeug nichts mehr zu.", "L’équipe n’a pas reçu la réponse à propos d’un café relevé.", "El tamaño máximo es de 7 casos después de la versión.",
    "A revisão não é uma decisão simples; a correção virá amanhã.", "用户无法打开版本标记，请联系小组并注明编号。每个会话窗口最多保留三天。", "Команда перенесла записи в журнал, каждая запись проверена до публикации.",
    "It isn’t enough to look at the “stale” audit trail — see § 12, 5 °C ± 1, €40 and £3.", "Å, Ø, Æ, Ð, Þ and Â, Ê, Î as plain letters", "┌────┬────┐\n│ ok │ no │\n└────┴────┘", "№ 7 · ™ ® © § ¶ ± × ÷ ≤ ≠ → ←", "Γ, Σ, √2 and ∞ in a formula",
    "next\x85line and soft\xadhyphen", "Chloé’s page", "Plain ASCII text only.",
]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i * 100 + k, f"{t} ({k})") for i, t in enumerate(CLEAN) for k in range(40)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, id string, t int")


@pytest.fixture(scope="module")
def model(corpus):
    return E.train(corpus)


def test_clean_stays(corpus, model):
    assert E.find_garbled(corpus, model=model).count() == 0


@pytest.mark.parametrize("wrong", ["latin_1", "cp1250", "cp437", "cp850", "mac_roman"])
@pytest.mark.parametrize("i", [0, 1, 2, 4, 5, 6])
def test_restores(model, wrong, i):
    try:
        bad = CLEAN[i].encode().decode(wrong)
    except UnicodeDecodeError:
        bad = CLEAN[i].encode().decode(wrong, "replace")
    r = E.repair(bad, model)
    assert r.garbled
    if "�" not in bad:
        assert r.text == CLEAN[i] and not r.lossy


def test_twice_partly_and_without_utf8(model):
    twice = CLEAN[0].encode().decode("latin_1").encode().decode("latin_1")
    assert E.repair(twice, model).text == CLEAN[0]
    half = CLEAN[1] + "\n" + CLEAN[2].encode().decode("cp1252", "replace")
    r = E.repair(half, model)
    assert r.garbled and r.text.startswith(CLEAN[1])
    assert E.repair(CLEAN[4].encode("gb18030").decode("latin_1"), model).text == CLEAN[4]
    assert E.repair("isn" + "’t".encode().decode("gbk", "replace") + " enough", model).garbled


@pytest.mark.parametrize(("right", "wrong"), [("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("koi8_r", "cp1251")])
def test_short_words_of_a_single_byte_encoding(spark, model, right, wrong):
    bad = lambda t: t.encode(right).decode(wrong)
    r = E.repair(bad(CLEAN[5]), model)
    assert r.text == CLEAN[5] and not r.lossy and not r.unsure
    r = E.repair("Note: " + bad("до в до в до") + ".", model)
    assert r.text == "Note: до в до в до." and r.garbled
    # Characters that the wrong encoding doesn't have divide a run.
    assert E.repair(bad("каждая") + "中" + bad("запись в журнал"), model).text == "каждая中запись в журнал"
    # What is left in doubt isn't complete.
    rows = spark.createDataFrame([(1, bad(CLEAN[5])), (2, bad(CLEAN[5]) + " " + CLEAN[1])], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["restored"], r["complete"]) for r in E.find_garbled(rows, model=model).collect()}
    assert got[1] == (CLEAN[5], True) and got[2] == (CLEAN[5] + " " + CLEAN[1], False)


def test_table(spark, model):
    rows = [(1, None), (2, ""), (3, " "), (4, "GrÃ¶Ã\x9fe betrÃ¤gt"), (4, "GrÃ¶Ã\x9fe betrÃ¤gt"), (5, "lost � here"), (None, "GrÃ¶Ã\x9fe"), (6, CLEAN[0] * 500)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, id string, t int")
    got = sorted(((r["doc_id"], r["restored"], r["complete"]) for r in E.find_garbled(df, model=model).collect()), key=str)
    assert got == sorted([(4, "Größe beträgt", True), (4, "Größe beträgt", True), (5, "lost � here", False), (None, "Größe", True)], key=str)
    assert E.find_garbled(df.limit(0), model=model).count() == 0


def test_training_on_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert E.find_garbled(df).count() == 0


def test_gbk_table_reverses():
    for raw in (b"\xe8\xae", b"\xae\xb0", b"\xb5\xc4"):
        try:
            c = raw.decode("gbk")
        except UnicodeDecodeError:
            continue
        assert E._gbk()[c] == raw
    assert E._gbk()[""] == b"\xae\xb0"


def test_counting_together_is_counting_one_by_one():
    texts = ["ab", "", "x", "Größe", "в 中", "yz" * 40]
    together, single = (E.np.zeros(E.TABLES, E.np.int64) for _ in range(2))
    E._add(together, texts, True)
    for t in texts:
        E._add(single, [t] if t else [], True)
    assert (together == single).all() and together[: E.POINTS].sum() == sum(map(len, texts))


def test_rows_found_by_marks_alone_are_told_apart(spark, model):
    df = spark.createDataFrame([(1, CLEAN[0].encode().decode("latin_1")), (2, "a lost � one"), (3, "plain"), (4, None), (5, "")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["found_by"] for r in E.find_garbled(df, model=model).collect()} == {1: "model", 2: "lost characters"}


@pytest.mark.parametrize(("right", "text"), [("euc_jp", "この版のしるしは開けません係に番号をつけてお知らせください"), ("euc_kr", "이 판의 표시는 열 수 없습니다 담당자에게 번호를 알려 주십시오")])
def test_east_asian_encodings_read_as_latin(spark, right, text):
    rows = [(i, f"{t} ({i})") for i in range(40) for t in (text, *CLEAN[:3])]
    m = E.train(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert E.repair(text.encode(right).decode("latin_1"), m).text == text


def test_all_clean_records_train_the_model(spark, corpus, model):
    counts = E.np.zeros(E.TABLES, E.np.int64)
    E._add(counts, [r["text"] for r in corpus.collect()], True)
    assert (model.n1 == counts[: E.POINTS]).all() and (model.n2 == counts[E.POINTS : E.POINTS + E.CELLS2]).all() and (model.n3 == counts[E.POINTS + E.CELLS2 :]).all()
    # Garbled ones don't, whether or not their text comes often.
    bad = spark.createDataFrame([(10_000 + i, CLEAN[0].encode().decode("latin_1")) for i in range(30)], "doc_id bigint, text string")
    assert (E.train(corpus.select("doc_id", "text").union(bad)).n1 == counts[: E.POINTS]).all()


def test_validation_leaves_a_text_out_and_agrees_with_repair(corpus, model):
    texts = [r["text"] for r in corpus.collect() if not r["text"].isascii()]
    was = model.n1.copy(), model.n2.copy(), model.n3.copy(), model.total
    for text, cells in zip(texts, E.cells_of(texts)):
        runs = list(E.RUN.finditer(text))
        bad = E.garble(text, E.zlib.crc32(text.encode()))
        with model.without(cells):
            alone = E.np.zeros(E.TABLES, E.np.int64)
            E._add(alone, [text], True)
            assert (was[0] - model.n1 == alone[: E.POINTS]).all() and (was[2] - model.n3 == alone[E.POINTS + E.CELLS2 :]).all()
            changed = [3 * (E.repair(text, model, x, False).spans > 0) for x in E.MARGINS]
            again = [E.repair(bad, model, x, False) for x in E.MARGINS]
            m = runs[E.zlib.crc32(text.encode()) % len(runs)]
            around = text[max(0, m.start() - 2) : m.start()], text[m.end() : m.end() + 2]
            x = bad[m.start() : len(bad) - len(text) + m.end()]
            beaten = model.score(around[0], m.group(), around[1]) - model.score(around[0], x, around[1]) > 12
            beaten = beaten and not model.implausible(x, m.group())
        assert beaten or not model.surely(around[0], m.group(), x, around[1], cells, 12.0)
        wrong = [n + (bad != text and (r.spans == 0 if E.REPLACEMENT in bad else r.text != text)) for n, r in zip(changed, again)]
        got = E.errors(text, model, runs, [r for r in runs if E.candidates(r.group())], cells)
        assert [n - got[0] for n in got] == [n - wrong[0] for n in wrong]
    assert all((a == b).all() for a, b in zip(was, (model.n1, model.n2, model.n3))) and model.total == was[3]
