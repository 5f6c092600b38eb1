import random

from tintero import runtime
from tintero.llm import scanned as s

BODY = "El consejo estima que el municipio gasta mucho en el cobro de la deuda y en la evaluación anual.\nEl componente económico-financiero pide prudencia del consejo y del gobierno en todo momento."
SCHEMA = "page_id bigint, text string, line_no int"


def pages():
    rows = [(i, f"CONSEJO FISCAL | INFORME\n\n{BODY}\n\nAspectos del periodo\n\n{BODY}\n\n{i}", 0) for i in range(80)]
    rows.append((1001, f"CONSEJO FISCAL | INFORME\n\nEl c0nsejo estima que el muni-\ncipio gasta mucho ^ en el componente económico-\nfinanciero del gobierno.\n\nAspectos del periodo\n\n{BODY}\n\nPág. 7", 0))
    rows += [(1002, None, 0), (1003, "", 0), (1004, "\n\n", 0), (1005, "3", 0)]
    return rows


def test_found_kinds(spark):
    got = {(r["kind"], r["line_no"]) for r in s.found(spark.createDataFrame(pages(), SCHEMA)).where("page_id = 1001").collect()}
    assert got == {("header", 1), ("ocr", 3), ("ocr", 4), ("hyphen", 3), ("page_no", 12)}


def test_repaired(spark):
    out = {r["page_id"]: r["text"] for r in s.repaired(spark.createDataFrame(pages(), SCHEMA)).collect()}
    assert out[1001].startswith("El consejo estima que el municipio gasta mucho en el componente económico-financiero del gobierno.\n\nAspectos del periodo")
    assert out[1002] is None and out[1003] == "" and len(out) == len(pages())


def test_empty_table(spark):
    assert s.found(spark.createDataFrame([], SCHEMA)).count() == 0
    assert s.repaired(spark.createDataFrame([], SCHEMA)).count() == 0


def test_page_numbers():
    assert all(map(s.is_page_number, ["3", "iv", "[5]", "- 3 -", "Pág. 3", "Página 5 de 12", "2/3"]))
    assert not any(map(s.is_page_number, ["", "Informe 3", "2016 3,4", "en"]))


def test_hashes_are_exact():
    """Large code points keep their difference; sums do not depend on the order of letters."""
    assert (s.anagram_hash("d€uda") - s.anagram_hash("deuda") - s.anagram_hash("€") + s.anagram_hash("e")) % s.PRIME == 0
    assert s.anagram_hash("abc\U0001f600") == s.anagram_hash("\U0001f600cba")


def corpus():
    words = "consejo gobierno deuda municipio evaluación componente prudencia ingresos presupuesto ministerio".split()
    r = random.Random(4)
    rows = [(2000 + i, "\n".join(" ".join(r.choices(words, k=9)) for _ in range(4)), 0) for i in range(40)]
    odd = ["d€uda", "c0nsej0", "m1n1steri0", "pre5upue5to", "Gob1erno", "eva1uac1ón"]
    rows.append((2500, "\n".join(f"gobierno {w} municipio deuda prudencia" for w in odd), 0))
    return rows, odd


def test_one_and_two_misreadings(spark):
    rows, odd = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["line_no"] for r in s.found(df).where("page_id = 2500 AND kind = 'ocr'").collect()}
    assert got == {1, 2, 4, 5, 6}  # the third word has three misreadings
    text = {r["page_id"]: r["text"] for r in s.repaired(df).collect()}[2500]
    for w in ("deuda", "consejo", "presupuesto", "Gobierno", "evaluación"):
        assert f"gobierno {w} municipio" in text


def test_what_is_found_is_repaired(spark):
    """Both outputs follow one decision: every line that is found comes out changed, others only rejoined."""
    df = spark.createDataFrame(pages() + corpus()[0], SCHEMA)
    m = s.Learned(tuple(r) for r in s.model(df).collect())
    found = {}
    for r in s.found(df).collect():
        found.setdefault(r["page_id"], set()).add((r["kind"], r["line_no"]))
    repaired = {r["page_id"]: r["text"] for r in s.repaired(df).collect()}
    for i, t, _ in pages() + corpus()[0]:
        if not t:
            continue
        p = s.Page(t, m)
        assert found.get(i, set()) == {(k, n + 1) for k, n in p.marks()} and repaired[i] == p.text()
        for kind, n in p.marks():
            line = p.lines[n].split()
            out = [s._restore(w, m.fix) for w in p.kept(n)]
            assert n in p.gone or kind == "hyphen" or out != line or n in p.divided or n - 1 in p.divided, (i, kind, n)


def test_a_lone_bar_is_dropped(spark):
    df = spark.createDataFrame([(1, "El gasto | subió mucho\nen el año y en el otro\ny en el siguiente.", 0)], SCHEMA)
    assert [(r["kind"], r["line_no"]) for r in s.found(df).collect()] == [("ocr", 1)]
    assert s.repaired(df).first()["text"] == "El gasto subió mucho en el año y en el otro y en el siguiente."


def test_the_same_by_lookup(spark, monkeypatch):
    """Beyond the size that is handed over, entries are looked up by a join with the same result; rows that repeat stay."""
    rows = pages() + corpus()[0] + corpus()[0][-1:]
    df = spark.createDataFrame(rows, SCHEMA)
    want = [sorted(map(tuple, f(df).collect()), key=repr) for f in (s.found, s.repaired)]
    monkeypatch.setattr(runtime, "HAND_OVER", 0)
    assert [sorted(map(tuple, f(df).collect()), key=repr) for f in (s.found, s.repaired)] == want
    monkeypatch.setattr(s, "BITMAP", (16, 16))
    assert sorted(map(tuple, s.found(df).collect()), key=repr) == want[0]


def test_long_tokens_count(spark):
    long = "super" * 12 + "norma"
    rows = [(i, f"la {long} del consejo\nsigue aquí el texto\ny otro más.", 0) for i in range(5)] + [(9, f"la {long.replace('o', '0', 1)} del consejo\nsigue aquí el texto\ny otro más.", 0)]
    got = s.found(spark.createDataFrame(rows, SCHEMA)).where("kind = 'ocr'").collect()
    assert [(r["page_id"], r["line_no"]) for r in got] == [(9, 1)]
