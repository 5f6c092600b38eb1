import numpy as np

from tintero.llm import labelled, quality

COMMON = "a al de del el en la las lo los no o para por que se su un una y con es este más como ha pero sus le ya the of and to in is that was for on with as by at from it be are this".split()


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "id int, text string" + extra)


def test_kinds_of_plain_cases(spark):
    rows = [
        (1, "El comité informó de la compra de materiales en los distritos del sur, porque faltaban datos del último censo. Después se aplazó la revisión."), (2, "- compra de bombas\n- el mapa de suelos\n- limpieza de acequias\n- gasto en cercos\n- la tarifa nocturna"), (3, "trigo | 12,4 | 3 200 | n.d.\ncebada | 1,1 | 210 | 4,0\npapa | 7,7 | 92 | 8,1"), (4, "zxk qwrt|p 0bvn lkjh gfdd wqz xcvb nmlk pqrs tvwx zbcd fghj klmn"), (5, None), (6, ""), (7, "   \n "), (8, "CONCLUSIONES"), (8, "CONCLUSIONES"),
    ]
    got = {r["id"]: (r["kind"], r["is_prose"]) for r in quality.graded(frame(spark, rows), COMMON).collect()}
    assert got[1] == ("prose", True) and got[8] == ("prose", True)
    assert (got[2][0], got[3][0], got[4][0]) == ("list", "table", "junk")
    assert got[5] == got[6] == got[7] == ("empty", None)
    assert quality.graded(frame(spark, rows), COMMON).count() == len(rows)


def test_statistics_match_brute_force(spark):
    texts = ["Uno dos tres. Cuatro!\nCinco seis", "x" * 200_000 + " fin.", "12,5 n.d. - 7", "a b a b"]
    rows = quality.statistics(frame(spark, list(enumerate(texts))), ["dos"]).orderBy("id").collect()
    for t, r in zip(texts, rows):
        w = t.split()
        assert r["n_words"] == len(w) and r["n_chars"] == len(t) and r["max_word"] == max(map(len, w))
        assert abs(r["mean_word"] - np.mean([len(x) for x in w])) < 1e-9
        assert abs(r["distinct_share"] - len(set(w)) / len(w)) < 1e-9
        assert abs(r["common_share"] - sum(x.lower() == "dos" for x in w) / len(w)) < 1e-9
    assert rows[2]["number_share"] == 1.0


def test_held_out_accuracy(spark):
    docs = labelled.documents(1500, seed=77)
    rows = spark.createDataFrame(docs, "text string, label string")
    r = quality.kinds(rows, COMMON).selectExpr("avg(CAST((kind = 'prose') = (label = 'prose') AS INT)) AS a").first()
    assert r["a"] > 0.97


def test_empty_table_and_clashing_columns(spark):
    assert quality.kinds(frame(spark, []), COMMON).count() == 0
    x = frame(spark, [(1, "Hola mundo, esto es una prueba.", 5, "z")], ", n_words int, kind string")
    r = quality.graded(x, COMMON).first()
    assert r["n_words"] == 6 and r["kind"] == "prose"
    assert quality.kinds(x, COMMON).columns.count("kind") == 1


def test_rules_are_sql_and_ordered():
    x = np.array([[0.0], [1.0], [2.0], [3.0]] * 60)
    rules = quality.induce(np.repeat(x, len(quality.FEATURES), 1), np.array(["prose", "prose", "list", "junk"] * 60))
    assert [r[0] for r in rules] == ["junk", "list"]
    assert quality.to_case(rules).startswith("CASE WHEN n_words = 0 THEN 'empty'")


def test_vowels_and_runs_of_long_texts_match_brute_force(spark):
    prose = "El comité informó de la compra de materiales en los distritos del sur. "
    texts = [
        "zxk qwrt bvn lkjh gfdd wqz xcvb nmlk pqrs tvwx " * 30, prose * 20, "Ingresos " + "." * 700 + " 12\nGastos " + ". " * 90 + "15", prose * 12 + "\n" + "_" * 900, "-=" * 400 + " " + prose, "......... 12", "x" * 12, "", "  \n ",
    ]
    rows = quality.statistics(frame(spark, list(enumerate(texts))), []).orderBy("id").collect()
    for t, r in zip(texts, rows):
        marks = "".join(t.split())
        assert abs(r["vowel_share"] - sum(c in "aeiouáéíóúüãõâêôAEIOUÁÉÍÓÚÜÃÕÂÊÔ" for c in marks) / max(len(marks), 1)) < 1e-9
        kept, i = 0, 0
        while i < len(marks):
            step = 0
            for k in range(1, 5):
                n = 1
                while marks[i : i + k] == marks[i + n * k : i + (n + 1) * k] and i + (n + 1) * k <= len(marks):
                    n += 1
                if n > 5:
                    step = n * k
                    break
            kept += not step
            i += step or 1
        assert abs(r["run_share"] - (len(marks) - kept) / max(len(marks), 1)) < 1e-9
    assert rows[0]["vowel_share"] == 0 and min(rows[k]["run_share"] for k in (2, 3, 4)) > 0.3


def test_long_junk_with_few_vowels(spark):
    words = "zxk qwert bvn lkjh gfdd wqz xcvb nmelk pqrs tvwx zbcd fghj klmn".split()
    text = " ".join(words[(i * i + i // 7) % len(words)] + words[i % 5] for i in range(200))
    assert len(text) > 600
    assert [r["kind"] for r in quality.kinds(frame(spark, [(1, text)]), COMMON).collect()] == ["junk"]
