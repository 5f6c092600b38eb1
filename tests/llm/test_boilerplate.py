import random
from collections import defaultdict

from pyspark.sql import functions as F

from tintero import runtime
from tintero.llm import boilerplate as b

SCHEMA = "page_id bigint, pdf_filename string, text string, page int, line int"


def rows():
    r = random.Random(2)
    legal = ["Documento de carácter público del Consejo", "Se autoriza su reproducción citando la fuente", "Elaborado por la dirección de estudios"]
    out = []
    for i in range(60):
        lines = [f"Línea propia número {i} con letras suficientes {r.choice('abcdefgh') * 5} y más" for _ in range(3)]
        if r.random() < 0.7:
            lines.insert(1, legal[0].upper() if r.random() < 0.3 else legal[0] + " 12")
        if r.random() < 0.5:
            lines.append(legal[1])
        if r.random() < 0.1:
            lines.append(legal[2])
        out.append((i, f"{r.choice(['Informe', 'informe', 'Nota'])}-{i % 25}.pdf", "\n".join(lines), i % 4, 7))
    return [*out, (900, None, legal[0], 1, 7), (901, "informe-3.pdf", None, 1, 7), (902, "nota", "", 1, 7), (0, out[0][1], out[0][2], 0, 7)]


def brute(data):
    """Occurrences of frequent lines, and all frequent runs of neighbours with their support, by plain loops."""
    docs, where, occ = defaultdict(set), defaultdict(set), []
    for i, f, t, *_ in data:
        if f is None:
            continue
        s = f.split("-")[0].split("_")[0].lower()
        docs[s].add(f)
        for n, line in enumerate((t or "").split("\n"), 1):
            k = b.line_key(line)
            if len(k) >= 25:
                where[s, k].add(f)
                occ.append((i, n, s, k))
    frequent = {(s, k) for (s, k), d in where.items() if len(d) >= 3 and 3 * len(d) >= len(docs[s])}
    runs = defaultdict(set)
    for _, f, t, *_ in data:
        if f is None:
            continue
        s = f.split("-")[0].split("_")[0].lower()
        seq = [k for k in map(b.line_key, (t or "").split("\n")) if (s, k) in frequent]
        for a in range(len(seq)):
            for z in range(a + 1, len(seq) + 1):
                runs[s, tuple(seq[a:z])].add(f)
    support = sorted((s, len(p), len(d)) for (s, p), d in runs.items() if len(d) >= 3 and 3 * len(d) >= len(docs[s]))
    return sorted((i, n) for i, n, s, k in occ if (s, k) in frequent), support


def test_against_brute_force(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    want, support = brute(rows())
    assert sorted((r["page_id"], r["line_no"]) for r in b.repeated_lines(df).collect()) == want
    out = b.without_repeated(df).collect()
    by = {r["page_id"]: r for r in out}
    assert len(out) == len(rows()) and by[901]["text"] is None and by[902]["text"] == "" and by[900]["lines_removed"] == 0
    assert sum(r["lines_removed"] for r in out) == len(want)
    assert sorted((r["source"], len(r["pattern"]), r["n_docs"]) for r in b.frequent_sequences(df).collect()) == support


def test_the_same_without_broadcasts(spark, monkeypatch):
    """What is handed over, or joined by shuffle beyond a size, does not change the result."""
    df = spark.createDataFrame(rows(), SCHEMA)
    want, support = brute(rows())
    removed = sorted((r["page_id"], r["text"] or "", r["lines_removed"]) for r in b.without_repeated(df).collect())
    monkeypatch.setattr(runtime, "HAND_OVER", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted((r["page_id"], r["line_no"]) for r in b.repeated_lines(df).collect()) == want
        assert sorted((r["page_id"], r["text"] or "", r["lines_removed"]) for r in b.without_repeated(df).collect()) == removed
        assert sorted((r["source"], len(r["pattern"]), r["n_docs"]) for r in b.frequent_sequences(df).collect()) == support
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_long_sequences_are_whole(spark):
    """A notice of five lines in every document is one pattern of five, and all its parts are found."""
    words = "alfa beta gama delta epsilon".split()
    notice = [f"Esta es la línea {w} del aviso legal común" for w in words]
    data = [(i, f"serie-{i % 6}.pdf", "\n".join([f"Texto propio {chr(97 + i % 26) * 30}", *notice, "fin"]), 1, 1) for i in range(12)]
    df = spark.createDataFrame(data, SCHEMA)
    got = b.frequent_sequences(df)
    assert sorted(r["n"] for r in got.select(F.size("pattern").alias("n")).collect()) == sorted(n for n in range(1, 6) for _ in range(6 - n))
    assert b.repeated_lines(df).count() == 12 * 5 and {r["lines_removed"] for r in b.without_repeated(df).collect()} == {5}


def test_empty_and_clashing_columns(spark):
    assert b.repeated_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    assert b.frequent_sequences(spark.createDataFrame([], SCHEMA)).count() == 0
    extra = spark.createDataFrame(rows(), SCHEMA).withColumns({c: F.lit(1) for c in ("src", "doc", "n", "x", "h", "_t", "_c")})
    assert sorted((r["page_id"], r["line_no"]) for r in b.repeated_lines(extra).collect()) == brute(rows())[0]
    assert b.without_repeated(extra).count() == len(rows())
