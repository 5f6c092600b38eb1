import pytest

from tintero.llm import sentences as s

CASES = [
    ["El art. 77 del D. Leg. N.° 4403 fija un tope de 31,3% (véase pág. 63).", "Otra."],
    ["Los términos con EE. UU. variaron 3,2 p.p. en 2.50 años.", "Fin."],
    ["El Dr. J. R. Roca y la Sra. Díaz de Agua S.A. hablaron.", "¿Y luego?", "¡Nada!"],
    ["Se evaluaron gastos, subsidios, etc.", "El comité aprobó."],
    ['"Hay que esperar. Todo sigue igual", respondió el jefe.', "Fin."],
    ["«¿Quién paga? ¿Y cuándo?», preguntó.", "El acta dice: «Así es.»", "Para 2018 sube."],
    ["A las 10.30 a. m. la sesión abrió.", "El jefe dudó... y luego habló."],
    ["La nota es clara (cf. Informe Núm. 5, párr. 73).²", "El equipo calló."],
    ["预算部门表示：“收入上升。我们必须等待”，并提到9.4%。", "能否保证？"],
    ["予算局は「安定しています。待つべきです」と述べました。", "税収は低下します（約80億）。"],
    ["समिति ने 2 योजनाओं की समीक्षा की।", "डॉ. ओज़कर ने कहा।", "क्या घाटा घटेगा?"],
    ["تمت مراجعة 16 مشروعا.", "هل تستطيع الحكومة؟"],
    ["การลงทุนภาครัฐจะฟื้นตัวในปี2025", "รายได้ภาษีต่ำกว่าเป้าหมาย"],
    ["Uno: dos; tres\ncuatro.", "Cinco"],
]


@pytest.mark.parametrize("parts", CASES)
def test_units(parts):
    sep = "" if any("一" <= c <= "鿿" for c in parts[0]) else " "
    text = sep.join(parts)
    ends, at = [], 0
    for p in parts:
        at = text.index(p, at) + len(p)
        ends.append(at)
    assert s.unit_ends(text) == ends


def test_run_together_and_blank():
    assert s.unit_ends("Sube el gasto.Baja el resto.") == [14, 28]
    assert s.unit_ends("Ver www.cifras.example/v2.27 y v3.1.") == [36]
    assert s.unit_ends("") == [] and s.unit_ends(" \n ") == [] and s.unit_ends("sin punto ") == [9]


def test_table(spark):
    rows = [(1, "Uno. Dos.", "x"), (2, None, "x"), (3, "", "x"), (4, "Ya es tarde. " * 3000, "x"), (1, "Uno. Dos.", "x")]
    df = spark.createDataFrame(rows, "row_id bigint, text string, sentence string")
    got = s.units(df).collect()
    assert [(r["start_pos"], r["end_pos"]) for r in got if r["row_id"] == 1] == [(1, 4), (6, 9)] * 2
    assert sum(r["row_id"] == 4 for r in got) == 3000
    ids = spark.createDataFrame([(1,), (1,), (None,)], "row_id bigint")
    assert {r["row_id"] for r in s.units_of(df, ids).collect()} == {1}
    assert s.units(df.limit(0)).count() == 0


def test_lattice_prefers_known_words():
    assert s.word_lattice("การลงทุน", frozenset(["การ", "ลงทุน"]), 5) == ["การ", "ลงทุน"]
    words, longest = s.dictionary()
    assert len(words) > 250 and longest < 40


# Sentences without spaces and stops between them.
JOINED = [
    ["委员会认为今年的产量将会上升了", "政府没有公布新的数据吗"], ["这个计划什么时候开始呢", "我们没有收到通知"], ["他们都同意了", "但是银行还没有回答"], ["政府通过了我们的提案"], ["上升了政府支出"], ["为了国家的未来他们必须等待"],
    ["会議は終わりました", "政府は支出を増やします"], ["予算は増えます", "しかし税収は減ります"], ["上昇した政府の支出は大きいです"], ["問題はありませんが予算は足りません"], ["結果は良いです", "ただし注意が必要です"],
    ["ผมไปตลาดแล้วครับ", "เราจะกลับบ้านพรุ่งนี้"], ["คุณเห็นด้วยไหม", "แต่รัฐบาลยังไม่ตอบ"], ["ຂ້ອຍບໍ່ຮູ້ເດີ້", "ແຕ່ລັດຖະບານຈະຕອບ"], ["រដ្ឋាភិបាលមិនបានឆ្លើយទេ", "យើងនឹងរង់ចាំ"], ["အစိုးရကပြောပါတယ်", "ဒါပေမဲ့သူတို့မလာဘူး"],
]


@pytest.mark.parametrize("parts", JOINED)
def test_gaps_between_words(parts):
    ends, at = [], 0
    for p in parts:
        at += len(p)
        ends.append(at)
    assert s.unit_ends("".join(parts)) == ends


def test_spaces_of_spaceless_scripts():
    assert s.unit_ends("ที่ประชุมเห็นชอบ ที่ประชุมยังเสนอ") == [16, 33]
    assert s.unit_ends("สภาเห็นชอบ และเสนอ") == [18]
    assert s.unit_ends("រដ្ឋាភិបាលឆ្លើយ។ យើងរង់ចាំ។") == [16, 27]


def test_no_window_decides():
    """Words, gaps and texts of any length are judged alike."""
    for n in (1, 39, 41, 300, 5000):
        assert s.unit_ends("www.cifras.example/" + "a" * n + ".Zeta sigue.") == [31 + n]
        assert s.unit_ends("Uno." + " " * n + "Dos.") == [4, 8 + n]
        assert s.unit_ends("a@" + "b" * n + ".Zeta es un sitio.") == [n + 20]


def test_time_is_linear():
    import time

    for part in ("การลงทุนภาครัฐจะฟื้นตัวอย่างช้าๆในปี2016 ", "El art. 77 (véase pág. 3) fija 1.234 y «5.678» casos. ", "委员会认为产量将会上升了政府没有公布数据。", "a.b" * 9, '"Sí." '):
        took = []
        for n in (4000, 16000):
            t = time.process_time()
            s.unit_ends(part * (n // 4))
            took.append(time.process_time() - t)
        assert took[1] < 10 * took[0] + 0.5, part


def test_units_with_many_inner_stops_stay_whole():
    from tintero.llm.sentences import unit_ends

    for n in (30, 60, 500):
        first = "El cuadro suma " + " y ".join(f"{k}.{k % 10}34" for k in range(1, n)) + " en total."
        text = first + " Luego se cerró la sesión."
        assert unit_ends(text) == [len(first), len(text)]
