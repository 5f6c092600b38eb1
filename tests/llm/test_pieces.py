from hypothesis import given, settings
from hypothesis import strategies as st

from tintero import runtime
from tintero.llm import pieces as p


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .,\n;é́字。", max_size=400), st.integers(4, 60), st.integers(0, 40))
def test_spans_cover_fit_and_overlap(text, limit, overlap):
    spans = p.split(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    eff = min(overlap, limit // 2)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert c <= b < d or (c <= b and d == len(text))
        assert b - c == min(eff, b)
    assert all(b - a <= limit for a, b in spans)
    out = text[spans[0][0] : spans[0][1]]
    for (_, b), (c, d) in zip(spans, spans[1:]):
        out += text[b:d]
    assert out == text


def test_natural_boundaries():
    text = "Uno dos tres. " * 40
    for a, b in p.split(text, 100, 10)[:-1]:
        assert text[:b].endswith(". ")


def test_table_cases(spark):
    limits = spark.createDataFrame([("editable", 10, 2), ("*", 20, 4), (None, 5, 1), ("editable", 12, 2)], "source_type string, max_chars int, overlap_chars int")
    rows = [(1, "x" * 11, "editable", 1), (2, "x" * 11, None, 2), (3, "x" * 21, "otro", 3), (4, None, "editable", 4), (5, "", "editable", 5), (1, "x" * 11, "editable", 1), (6, "ab " * 40_000, None, 0)]
    df = spark.createDataFrame(rows, "row_id bigint, text string, source_type string, piece_no int")
    got = p.pieces(df, limits).collect()
    n = {i: [r for r in got if r["row_id"] == i] for i in range(1, 7)}
    assert {r["n_pieces"] for r in n[1]} == {2} and len(n[1]) == 4
    assert n[2][0]["n_pieces"] == 1 and n[3][0]["n_pieces"] == 2 and n[4] == [] and [r["piece"] for r in n[5]] == [""]
    assert max(len(r["piece"]) for r in n[6]) <= 20
    assert p.pieces(df.limit(0), limits).count() == 0 and p.pieces(df, limits.limit(0)).where("n_pieces > 1").count() == 0


def test_any_number_of_source_types(spark, monkeypatch):
    """Every type has its own limit, however many there are, handed over or joined."""
    limits = spark.createDataFrame([(f"t{i}", 10 + i % 7, 2) for i in range(20_000)] + [("*", 50, 4)], "source_type string, max_chars int, overlap_chars int")
    df = spark.createDataFrame([(i, "palabra " * 3, f"t{i * 199 % 20_000}" if i % 5 else None) for i in range(300)], "row_id bigint, text string, source_type string")
    want = sorted(map(tuple, p.pieces(df, limits).collect()))
    for i, t, k in df.collect():
        limit = 10 + int(k[1:]) % 7 if k else 50
        assert [(r[3] - 1, r[3] - 1 + len(r[4])) for r in want if r[0] == i] == p.split(t, limit, 2 if k else 4)
    monkeypatch.setattr(runtime, "HAND_OVER", 0)
    assert sorted(map(tuple, p.pieces(df, limits).collect())) == want
