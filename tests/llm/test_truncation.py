import random

from tintero.llm import truncation as t

SCHEMA = "row_id bigint, text string, page_range string, source_type string"


def corpus(n=400):
    r = random.Random(1)
    parts = ["el gasto subió en la región", "la junta revisó las cuentas del año", "no hubo datos sobre el consumo", "los ingresos bajaron por la sequía", "se aprobó el plan de obras"]
    rows = []
    for i in range(n):
        s = [r.choice(parts) for _ in range(r.randint(2, 5))]
        p = r.randint(1, 120)
        rows.append((i, " ".join(x[0].upper() + x[1:] + "." for x in s), r.choice([str(p), f"{p}-{p + 1}"]), r.choice(["scanned", None])))
    return rows


def test_cut_values_are_found(spark):
    rows = corpus()
    rows += [
        (9001, "El gasto subió en la región. La junta revisó las cuen", "9-10", "scanned"), (9002, "El gasto subió en la región. La junta revisó las…", "12-1", "editable"), (9003, "El gasto subió en la región. &aacu", "7-", None), (9004, None, None, None), (9005, "", "", "scanned"), (9006, "Opinión sobre el gasto", "3", None), (9007, "Opinión sobre la sequía", "3", None), (9008, "  ", " ", None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    common = spark.createDataFrame([("es", w) for w in "el la de en las los se por no".split()], "lang string, word string")
    got = {(r["row_id"], r["field"]) for r in t.truncated(df, common).collect()}
    assert {(9001, "text"), (9002, "text"), (9003, "text"), (9002, "page_range"), (9003, "page_range")} <= got
    assert not [g for g in got if g[0] < 9001 or g[0] > 9003]
    rate = {r["source_type"]: (r["n_rows"], r["cut_texts"]) for r in t.rates(df, common).collect()}
    assert rate["editable"] == (1, 1)


def test_empty_table(spark):
    assert t.truncated(spark.createDataFrame([], SCHEMA), None).count() == 0


def test_page_codes():
    assert t.page_code("163-164") == "aaa-ccb" and t.page_code("11-1") == "aa-c" and t.page_code("3 – 4") == "a-b" and t.page_code("p. 3") == "xxa"


def test_tail_drops_marks():
    assert t._tail("fin de la…") == "fin de la" and t._tail("algo &aacu") == "algo" and t._tail("ya está.") == "ya está."
    assert t._tail("x" * 40 + "�") == "x" * 40


def found(spark, rows):
    common = spark.createDataFrame([("es", w) for w in "el la de en las los se por no".split()], "lang string, word string")
    return {r["row_id"] for r in t.truncated(spark.createDataFrame(rows, SCHEMA), common).collect() if r["field"] == "text"}


def test_copies_of_a_cut_text_make_no_heading(spark):
    copied = [(7000 + i, "Hubo gasto en la región y se aprobó el pl", "3", None) for i in range(30)]
    many = [(8000 + i, "El gasto subió en la región sin más da", "3", None) for i in range(900)]
    got = found(spark, [*corpus(), *copied, *many, (9001, "El plan de obras subió por la sequ", "3", None)])
    assert {i for i, *_ in copied} <= got and 9001 in got


def test_marked_texts_are_cut_whatever_opens_them(spark):
    heads = [(9100 + i, f"Opinión sobre {x}", "3", None) for i, x in enumerate(["el gasto", "la sequía", "el plan", "las cuentas"])]
    got = found(spark, [*corpus(), *heads, (9201, "Opinión sobre la sequía y el ga…", "3", None), (9202, "Opinión sobre la regi�", "3", None), (9203, "Opinión sobre la regi&oacu", "3", None), (9204, "Opinión sobre las cue [...]", "3", None)])
    assert got == {9201, 9202, 9203, 9204}


def test_tables_grow_with_the_corpus(spark, monkeypatch):
    """Larger tables find the same on a small corpus; the size follows the number of values."""
    assert [t.table_bits(n) for n in (0, 10**6, 3 * 10**6, 10**8, 10**12)] == [18, 18, 19, 20, 20]
    rows = [*corpus(), (9001, "El gasto subió en la región. La junta revisó las cuen", "9-10", "scanned")]
    want = found(spark, rows)
    monkeypatch.setattr(t, "BITS", (20, 20))
    assert found(spark, rows) == want == {9001}


def test_a_large_word_list_is_refused(spark, monkeypatch):
    from tintero import runtime

    monkeypatch.setattr(runtime, "HAND_OVER", 100)
    try:
        found(spark, corpus(20))
        raise AssertionError
    except ValueError as e:
        assert "frequent words" in str(e)
