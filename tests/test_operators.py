"""Rules worked by hand or against plain loops, for what SQL on the tables does not show."""

from __future__ import annotations

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from tintero.functions.text import parse_date, word_count
from tintero.operators import aggregate, clean, enrich, layout, links, normalize, quality, scanned_clean, score, segment


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "text string").select(fn(F.col("text")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a\n\n......... JUAN P Q\nx", "a\nx"), ("", ""), ("   ", ""), ("texto", "texto"), (None, None), ("uno.\n\ndos", "uno. dos"), ("uno.\n\n2016 fue", "uno. 2016 fue"), ("Ver esto.\n\nGráfico N° 3: título\nsigue el texto aquí.", "Ver esto."), ("• uno ; dos …", "uno; dos..."), ("Ver el Gráfico N° 3: título\nsigue el texto.", "Ver el \nsigue el texto."),
    ],
)
def test_clean_text(spark, text, want):
    assert one(spark, text, clean.clean_text) == want


def test_capital_lines_overlap(spark):
    assert one(spark, "x\n\nA B C\n\nD E F\n\nG H I\n\ny", lambda c: clean.chain(c, clean.CAPITALS)) == "x\n\ny"
    assert "Lima" not in one(spark, "Lima, 23 de mayo de 2022\n\nAlgo de contenido.", clean.clean_text)


@pytest.mark.parametrize(
    ("text", "removed"),
    [
        ("1: Leyes con impacto (número de leyes)", True), ("Opinión sobre las proyecciones del año", True), ("I. Opinión sobre el proyecto", True), ("A) Leyes por insistencia", True), ("El análisis también muestra que la producción ha sido nociva en términos fiscales.", False), ("Solo desde agosto, las 5 leyes implican un costo cercano a S/ 22 mil millones.", False),
    ],
)
def test_headers_and_labels(spark, text, removed):
    assert one(spark, text, lambda c: clean.is_header(c) | clean.is_label(c)) is removed


def loop_drop(segments, head):
    text = "\n\n".join(segments)
    text = re.sub(r"\n\n(.+?)\n\n", lambda m: "\n\n" if head(m.group(1)) else m.group(0), text, flags=re.S)
    m = re.match(r"^(.+?)\n\n", text, flags=re.S)
    return text[m.end() :] if m and head(m.group(1)) else text


def test_headings_against_a_loop(spark):
    r = random.Random(6)
    pool = ["Riesgos", "Conclusiones y recomendaciones", "El gasto subió mucho durante el año por varias razones, como ya se dijo antes.", "II. Antecedentes", "Otra frase larga que termina en punto y tiene más de ocho palabras en total."]
    head = lambda s: not s.endswith(".")
    texts = [[r.choice(pool) for _ in range(r.randint(1, 7))] for _ in range(80)]
    df = spark.createDataFrame([("\n\n".join(t), loop_drop(t, head)) for t in texts], "text string, want string")
    for row in df.select(scanned_clean.drop_headings(F.col("text")).alias("x"), "want").collect():
        assert row["x"] == row["want"]


@pytest.mark.parametrize(("text", "want"), [("claves?78 de", "claves de"), ("fiscal??", "fiscal"), ("2009- 2012", "2009-2012"), ("fin.!", "fin."), ("a > b", "a b")])
def test_final_touch(spark, text, want):
    assert one(spark, text, lambda c: scanned_clean.final_touch(c, join_hyphens=False)) == want


def test_preliminary_and_breaks(spark):
    assert one(spark, "Informe N° 001-2018-CF  El  gasto ( alto ) ;\n sube", scanned_clean.preliminary) == "El gasto (alto);\nsube"
    assert one(spark, "gasto del\n\nGobierno de la\n\nRegión.\n\nOtro.", scanned_clean.join_false_breaks) == "gasto del Gobierno de la Región.\n\nOtro."
    assert one(spark, "déficit de\n\n2,0 por ciento", scanned_clean.join_false_breaks) == "déficit de 2,0 por ciento"


def test_noise_reasons(spark):
    cases = {"7/10": "exact_noise", "Lima, 3 de mayo de 2016 x": "exact_noise", "corto": "too_short", "JUAN PEREZ QUISPE LOPEZ ROJAS Presidente": "capitals", "El gasto corriente subió en el último año por la sequía.": None, "PRESIDENTE DEL CONSEJO FISCAL 7/10 x Av. Central": "signature_address"}
    for t, want in cases.items():
        assert one(spark, t, scanned_clean.noise_reason) == want, t


def test_opinion_and_annex_by_file(spark):
    lead = "x" * 210
    rows = [(1, "a", 1, "uno"), (2, "a", 2, lead + "\n\nII. Opinión del CF sobre algo"), (3, "a", 3, "tres"), (4, "b", 1, "uno"), (5, "b", 2, "\n\nANEXO: tabla"), (6, "b", 3, "fin"), (7, "c", 1, "texto\n\nAnexo 1\nmás"), (8, "c", 2, "otro"), (9, "d", 1, None)]
    p = spark.createDataFrame(rows, "page_id int, pdf_filename string, page int, text string")
    got = {r["page_id"]: r["text"] for r in scanned_clean.from_opinion(p).collect()}
    assert set(got) == {2, 3, 4, 5, 6, 7, 8, 9} and got[2].startswith("\n\nII. Opinión")
    got = {r["page_id"]: r["text"] for r in scanned_clean.without_annexes(p).collect()}
    assert set(got) == {1, 2, 3, 4, 7, 9} and got[7] == "texto"


def greedy(rows):
    """(n, next similarity ok) walked from the left."""
    out, i = [], 0
    while i < len(rows):
        if i + 1 < len(rows) and rows[i][0] < 200 and rows[i][0] + rows[i + 1][0] <= 1000 and rows[i][1] >= 0.7:
            out.append((i, i + 1))
            i += 2
        else:
            out.append((i,))
            i += 1
    return out


def test_short_merge_against_the_walk(spark):
    r = random.Random(8)
    groups = {g: [(r.choice([50, 150, 300, 950]), r.choice([0.2, 0.9])) for _ in range(r.randint(1, 12))] for g in range(40)}
    df = spark.createDataFrame([(g, i, n, s) for g, v in groups.items() for i, (n, s) in enumerate(v)], "g int, i int, n int, similarity double")
    got = {}
    for x in normalize.merge_short(df, "g", "i", "n").collect():
        got.setdefault(x["g"], {}).setdefault(x["merge_id"], []).append(x["i"])
    for g, v in groups.items():
        assert sorted(tuple(sorted(x)) for x in got[g].values()) == sorted(greedy(v))


def test_upper_median_histogram_percentiles(spark):
    df = spark.createDataFrame([(1,), (2,), (4,), (8,), (None,)], "v int")
    assert aggregate.upper_median(df, F.col("v")).first()["upper_median"] == 4
    h = spark.createDataFrame([(0,), (199,), (200,), (400,)], "v int")
    assert [(r["label"], r["n"]) for r in aggregate.histogram(h, F.col("v")).orderBy("bin").collect()] == [("0-200", 2), ("200-400", 2)]
    assert aggregate.upper_median(df.limit(0), F.col("v")).first()["n"] == 0


def test_links(spark):
    html = '<p><a href="a/presentacion.pdf">PPT</a> <A HREF=\'b/Comunicado_001.PDF\'><b>Doc</b></A><a href="x.html">n</a><a href="c/otro.pdf">z</a></p>'
    df = spark.createDataFrame([("u", html)], "page_url string, html string")
    x = links.extract_links(df)
    assert [(r["href"], r["label"]) for r in x.orderBy("pos").collect()] == [("a/presentacion.pdf", "PPT"), ("b/Comunicado_001.PDF", "Doc"), ("c/otro.pdf", "z")]
    assert links.best_link(x).first()["href"] == "b/Comunicado_001.PDF"
    pages = ['<iframe src="//h.example/a.pdf"></iframe>', '<iframe src="https://docs.google.com/viewer?url=https%3A%2F%2Fh.example%2Fb.pdf&e=1"></iframe>', '<a href="/c"><button id="downloadButton">x</button></a>', "<p>nada</p>"]
    got = [r[0] for r in spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string").orderBy("i").select(links.resolve_url(F.col("html"))).collect()]
    assert got == ["https://h.example/a.pdf", "https://h.example/b.pdf", "/c", None]
    rows = '<table class="table"><tbody><tr><td class="size100"><p> 4 de mayo </p></td><td><a href="/p/1"> Informe <b>1</b></a></td></tr><tr><td>sin</td></tr></tbody></table>'
    r = links.list_rows_from_html(spark.createDataFrame([(rows,)], "html string")).collect()
    assert [(x["date"], x["doc_title"], x["page_url"]) for x in r] == [("4 de mayo", "Informe 1", "/p/1")]


def test_titles_and_dates(spark):
    want = {"Informe N° 001-2018-CF": ("Informe", 1), "Comunicado Nº05-2025": ("Comunicado", 5), "Informe CF N° 03-2016": ("Informe", 3), "Comunicado CF 12-2021": ("Comunicado", 12), "Informe CF N 001-2020": (None, None), "Carta 3": (None, None)}
    df = spark.createDataFrame([(t,) for t in want], "t string").select("t", enrich.doc_type(F.col("t")).alias("a"), enrich.doc_number(F.col("t")).alias("b"))
    assert {r["t"]: (r["a"], r["b"]) for r in df.collect()} == want
    days = {"2020-11-05": datetime.date(2020, 11, 5), "14/02/2025": datetime.date(2025, 2, 14), "4/1/25": datetime.date(2025, 1, 4), " 4 de  marzo de 2016": datetime.date(2016, 3, 4), "31/02/2020": None, "": None, None: None, "ayer": None}
    got = spark.createDataFrame([(k,) for k in days], "d string").select("d", parse_date(F.col("d")).alias("x")).collect()
    assert {r["d"]: r["x"] for r in got} == days


def test_metadata_join_defaults(spark):
    p = spark.createDataFrame([(1, "a"), (2, "zz"), (3, None)], "row_id int, pdf_filename string")
    m = spark.createDataFrame([("a", None, 3, datetime.datetime(2020, 1, 1)), ("a", "nuevo", 4, datetime.datetime(2021, 1, 1)), (None, "x", 1, None)], "pdf_filename string, doc_title string, doc_number int, scraped_at timestamp")
    got = {r["row_id"]: (r["doc_title"], r["doc_number"]) for r in enrich.with_metadata(p, m).collect()}
    assert got == {1: ("nuevo", 4), 2: ("", None), 3: ("", None)}


def words(spark):
    rows = [("f", 1, 3, i, "t", 11.0, 150.0 + 20 * (i // 3) + (30 if i >= 6 else 0), 80.0 + 30 * (i % 3)) for i in range(9)]
    rows += [("f", 1, 3, 20, "nota", 9.5, 300.0, 80.0), ("f", 1, 3, 21, "pie", 11.0, 780.0, 80.0), ("f", 2, 3, 22, "Opinión", 12.0, 200.0, 90.0), ("f", 2, 3, 23, "del", 12.0, 200.0, 130.0), ("f", 2, 3, 24, "CF", 12.0, 200.0, 160.0), ("f", 2, 3, 25, "centrado", 12.0, 220.0, 200.0), ("g", 1, 1, 1, "x", 11.0, 200.0, 90.0)]
    return spark.createDataFrame([(a, b, c, 595.0, 842.0, d, t, s, top, x, "F") for a, b, c, d, t, s, top, x in rows], "pdf_filename string, page int, total_pages int, page_width double, page_height double, seq int, text string, size double, top double, x0 double, fontname string")


def test_layout(spark):
    w = words(spark)
    body = layout.body_words(w)
    assert {r["text"] for r in body.where("pdf_filename = 'f' AND page = 1").collect()} == {"t"}
    text = {(r["pdf_filename"], r["page"]): r["text"] for r in layout.word_paragraphs(body, gap=25).collect()}
    assert text["f", 1] == "t t t t t t\n\nt t t"
    start = {r["pdf_filename"]: (r["start_page"], r["start_top"]) for r in layout.opinion_start(w).collect()}
    assert start == {"f": (2, 200.0), "g": (1, 0.0)}
    assert {r["pdf_filename"]: r["start_page"] for r in layout.opinion_start(w, veto_centred=True).collect()} == {"f": 1, "g": 1}
    got = layout.body_words(w, start=layout.opinion_start(w), font=(10.5, 12.5)).where("pdf_filename = 'f'").collect()
    assert {r["page"] for r in got} == {2}


def test_tokens_and_names(spark):
    t = [(i, w, 90, 10 * i, top, 20, 10, 1, ln) for i, (w, top, ln) in enumerate([("Hola", 0, 1), ("mundo", 2, 1), ("sigue", 20, 2), ("aparte", 90, 3), (" ", 90, 3)])]
    df = spark.createDataFrame([("a.pdf", 1, *x) for x in t] + [("a.pdf", 1, 9, "bajo", -1, 0, 0, 1, 1, 1, 3)], "pdf_filename string, page int, seq int, text string, conf int, left int, top int, width int, height int, block_num int, line_num int")
    assert layout.token_paragraphs(df).first()["text"] == "Hola mundo sigue\n\naparte"
    a, b = layout.parse_image_name(F.col("n"))
    r = spark.createDataFrame([("Informe_CF_N_003-2016_p01_cropped.png",), ("suelto.png",)], "n string").select(a.alias("a"), b.alias("b")).collect()
    assert [tuple(x) for x in r] == [("Informe_CF_N_003-2016.pdf", 1), ("suelto.pdf", 1)]


def test_footer_and_crop_log(spark):
    rows = [(1, y, 0.0 if 60 <= y < 80 or y > 90 else 0.5, 100) for y in range(100)]
    df = spark.createDataFrame(rows, "page_id int, y int, blackness double, height int")
    assert layout.footer_cut(df, 0.1, 10).first()["cut_y"] == 80 and layout.footer_cut(df, 0.1, 30).first()["cut_y"] == 95
    log = spark.createDataFrame([("a", 1, 5), ("b", 0, None)], "filename string, cropped int, pages int")
    assert tuple(layout.crop_totals(log).first()) == (2, 1, 5)


def test_scores(spark):
    df = spark.createDataFrame([(1, "riesgo y deterioro del déficit", None), (2, None, None), (3, "x", 5)], "i int, text string, fiscal_risk_score int")
    got = {r["i"]: (r["fiscal_risk_score"], r["risk_index"]) for r in score.score_rows(df).collect()}
    assert got == {1: (5, -1.0), 2: (None, None), 3: (5, -1.0)}
    rep = [r[0] for r in spark.createDataFrame([(" 3\n",), ("6",), ("",), (None,), ("3.",)], "r string").select(score.parse_reply(F.col("r"))).collect()]
    assert rep == [3, None, None, None, None]
    assert one(spark, "a {b} {text}", lambda c: score.prompt(c, "K ", "[{text}]")) == "K [a {b} {text}]"


def test_packing_and_numbering(spark):
    assert one(spark, "Uno dos. Tres cuatro. Además cinco. Seis siete ocho.", lambda c: segment.split_by_words(c, 3)) == ["Uno dos.", "Tres cuatro. Además cinco.", "Seis siete ocho."]
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = segment.number_rows(df, ["k"], "n", 7).orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(1, 1001))
    assert segment.number_rows(df.limit(0), ["k"], "n").count() == 0
    chunks = spark.createDataFrame([(["a" * 300, "b" * 10, "c" * 300, "d" * 5],)], "c array<string>")
    assert [len(x) for x in chunks.select(normalize.pack_chunks(F.col("c")).alias("x")).first()["x"]] == [607]


def test_quality_gate(spark):
    long = "El gasto corriente subió en el último año por la sequía y por los precios de los alimentos, según el informe."
    cases = {long: None, "corto": "too_short (5 chars)", long[0].lower() + long[1:]: "starts_lowercase", long[:-1]: "no_ending_punctuation", "1" * 120 + ".": "insufficient_text_content", None: "too_short (0 chars)"}
    got = spark.createDataFrame([(k,) for k in cases], "text string").select("text", quality.reason(F.col("text")).alias("r")).collect()
    assert {r["text"]: r["r"] for r in got} == cases
    assert one(spark, " a  b c ", word_count) == 3


def test_duplicates_keep_the_first(spark):
    df = spark.createDataFrame([(3, "A b"), (1, " a B "), (2, "otro"), (4, None), (5, None), (6, "")], "i int, text string")
    assert sorted(r["i"] for r in segment.drop_duplicates(df, ["i"]).collect()) == [1, 2, 4, 6]


def plain_normalised(rows, alike=0.7):
    """Splitting and merging as plain loops, with the stand-in vectors."""
    import numpy as np

    def cos(a, b):
        x, y = normalize.word_encoder([a, b])
        n = np.linalg.norm(x) * np.linalg.norm(y)
        return float(x @ y / n) if n else 0.0

    out = []
    for f, num, text in rows:
        if len(text) <= 1000:
            out.append(dict(f=f, num=num, text=text, chunk=None, of=None))
            continue
        sents = [s for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", text)) if s]
        if len(sents) < 2:
            out.append(dict(f=f, num=num, text=text, chunk=None, of=None))
            continue
        sims = [cos(a, b) for a, b in zip(sents, sents[1:])]
        low = np.mean(sims) - 0.5 * np.std(sims)
        cuts = [0, *(i + 1 for i, s in enumerate(sims) if s < low - 1e-12), len(sents)]
        chunks = [" ".join(sents[a:b]) for a, b in zip(cuts, cuts[1:])]
        chunks = [c for i, c in enumerate(chunks) if len(c) >= 200 or i == len(chunks) - 1]
        packed = [chunks[0]]
        for c in chunks[1:]:
            if len(packed[-1]) + len(c) <= 700:
                packed[-1] += " " + c
            else:
                packed.append(c)
        out += [dict(f=f, num=num, text=c, chunk=i, of=len(packed)) for i, c in enumerate(packed)]
    done, i = [], 0
    while i < len(out):
        a = out[i]
        b = out[i + 1] if i + 1 < len(out) and out[i + 1]["f"] == a["f"] else None
        if b and len(a["text"]) < 200 and len(a["text"]) + len(b["text"]) <= 1000 and cos(a["text"], b["text"]) >= alike:
            done.append((a["f"], a["num"], a["text"] + " " + b["text"], a["chunk"], a["of"], b["num"]))
            i += 2
        else:
            done.append((a["f"], a["num"], a["text"], a["chunk"], a["of"], None))
            i += 1
    return done


def test_normalised_paragraphs_against_loops(spark):
    r = random.Random(12)
    words = "gasto deuda ingreso regla plan obra región cuenta meta riesgo".split()
    sent = lambda: " ".join(r.choices(words[: r.randint(2, 10)], k=r.randint(4, 30))).capitalize() + "."
    rows = [(f"f{i % 4}", i // 4, " ".join(sent() for _ in range(r.choice([1, 1, 2, 4, 14, 25])))) for i in range(60)]
    rows.append(("f0", 99, "palabra " * 300))
    df = spark.createDataFrame([*rows, ("f1", 77, None)], "pdf_filename string, paragraph_num int, text string")
    want = sorted(plain_normalised(sorted(rows, key=lambda x: x[:2])), key=repr)
    got = [(x["pdf_filename"], x["paragraph_num"], x["text"], x["chunk_index"], x["total_chunks"], x["merged_with"]) for x in normalize.normalised_paragraphs(df).collect()]
    assert sorted(got, key=repr) == want and any(w[5] is not None for w in want) and any(w[3] for w in want)
    assert normalize.normalised_paragraphs(df.limit(0)).count() == 0


def test_large_sides_are_joined_with_the_same_result(spark, monkeypatch):
    from tintero import runtime

    rows = [(i, f"f{i % 3}", i // 3 + 1, ("x" * 210 + "\n\nOpinión del CF") if i % 7 == 3 else "\n\nANEXO 1" if i % 11 == 5 else f"Texto {i} sin fin" if i % 2 else f"Texto {i}.") for i in range(60)]
    p = spark.createDataFrame([*rows, (99, None, 1, "sin archivo")], "page_id int, pdf_filename string, page int, text string")
    m = spark.createDataFrame([("f1", "t", datetime.datetime(2020, 1, 1))], "pdf_filename string, doc_title string, scraped_at timestamp")
    steps = [scanned_clean.from_opinion, scanned_clean.without_annexes, layout.before_annex, layout.extracted, lambda d: enrich.with_metadata(d, m), segment.pair_pages, lambda d: segment.pair_pages(d, mode="intended")]
    want = [sorted(map(tuple, f(p).collect()), key=repr) for f in steps]
    monkeypatch.setattr(runtime, "HAND_OVER", 0)
    assert [sorted(map(tuple, f(p).collect()), key=repr) for f in steps] == want
    pairs = {(x["pdf_filename"], x["page_range"]) for x in segment.pair_pages(p).collect()}
    assert ("f0", "1-2") in pairs and (None, "1") in pairs


def test_running_sums_within_groups(spark):
    r = random.Random(3)
    rows = [(r.choice(["hot", "hot", "hot", "a", None]), i, r.randint(0, 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, k int, v int")
    got = {(x["g"], x["k"]): x["s"] for x in segment.running(df, ["k"], F.col("v"), "s", ["g"], 7).collect()}
    want, sums = {}, {}
    for g, k, v in rows:
        sums[g] = sums.get(g, 0) + v
        want[g, k] = sums[g]
    assert got == want


def test_text_layer_counts_inner_blanks_only(spark):
    rows = [("a", 1, "  x"), ("a", 2, " " * 30), ("a", 3, "y  "), ("b", 1, " " * 40), ("b", 2, "x"), ("c", 1, None), ("d", 1, "0123456789"), ("d", 2, "0123456789")]
    got = {r["pdf_filename"]: r["pdf_type"] for r in layout.extracted(spark.createDataFrame(rows, "pdf_filename string, page int, text string")).collect()}
    assert got == {"a": "editable", "b": "scanned", "c": "scanned", "d": "editable"}


def test_costs_retries_and_summaries(spark):
    c = aggregate.cost_estimate(spark.createDataFrame([("abcd",), (None,)], "text string"), 10).first()
    assert (c["n_rows"], c["input_tokens"], c["output_tokens"]) == (2, 6, 10) and abs(c["total_cost"] - (6 * 0.0025 + 10 * 0.01) / 1000) < 1e-12
    waits, calls = [], []

    def shaky(texts):
        calls.append(1)
        if len(calls) < 4:
            raise OSError
        return [3] * len(texts)

    assert score.retrying(shaky, sleep=waits.append)(["a", "b"]) == [3, 3] and waits == [2.0, 4.0, 8.0]
    with pytest.raises(OSError):
        score.retrying(lambda t: (_ for _ in ()).throw(OSError()), tries=2, sleep=waits.append)(["a"])
    audit = scanned_clean.removals(spark.createDataFrame([(1, "a", 1, "7/10\n\ncorto\n\nEl gasto corriente subió en el último año por la sequía.")], "page_id int, pdf_filename string, page int, text string"))
    s = scanned_clean.removal_summary(audit, "2020-01-01").first()
    assert s["total_removals"] == 2 and set(s["by_reason"]) == {"exact_noise", "too_short"} and s["by_pdf"][0]["n"] == 2 and s["longest_removed"]["paragraph"] == "corto"
    d = aggregate.statistics_document(spark.createDataFrame([("a", "xx", "editable"), ("b", "xxxx", None)], "pdf_filename string, text string, source_type string")).first()
    assert d["overview"]["total_paragraphs"] == 2 and d["length"]["mean_length"] == 3 and len(d["by_source"]) == 2
