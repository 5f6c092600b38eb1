"""Registered queries: SQL where there is any, columns of the found tables, and the entry module."""

import pytest
from conftest import DATA, rows_of

from tintero.llm import queries

FOLDER = str(DATA / "sf0.001")
COLUMNS = {
    "p1_found": ["row_id"], "p2_found": ["row_id", "field"], "p3_found": ["row_id"], "p4_found": ["page_id", "kind", "line_no"], "p5_found": ["page_id_a", "page_id_b"], "p6_found": ["page_id", "line_no"], "p7_found": ["row_id", "end_pos"], "p8_found": ["doc_id", "item_id"], "p9_found": ["source"], "p10_found": ["doc_id", "kind", "start_pos"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(set(rows)) == len(rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, FOLDER)
    want = duck("sf0.001").execute(queries.ORACLES[name])
    assert rows_of(got.columns, got.collect()) == rows_of([c[0] for c in want.description], want.fetchall())


def test_entry_module():
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


@pytest.fixture(scope="module")
def results(spark):
    """Rows of registered queries on the smallest tables, each computed once."""
    kept = {}

    def get(name):
        if name not in kept:
            kept[name] = queries.QUERIES[name](spark, FOLDER).collect()
        return kept[name]

    return get


def test_pieces_cover_fit_and_overlap(spark, results):
    limits = {r["source_type"]: (r["max_chars"], r["overlap_chars"]) for r in spark.read.parquet(f"{FOLDER}/size_limits.parquet").collect()}
    texts = {r["row_id"]: (r["text"], r["source_type"]) for r in spark.read.parquet(f"{FOLDER}/unified_paragraphs_segmented.parquet").collect()}
    by = {}
    for r in results("p3_pieces"):
        by.setdefault(r["row_id"], []).append(r)
    assert set(by) == {i for i, (t, _) in texts.items() if t is not None}
    for i, rows in by.items():
        (text, kind), rows = texts[i], sorted(rows, key=lambda r: r["piece_no"])
        most, lap = limits.get(kind, limits["*"])
        assert [r["piece_no"] for r in rows] == list(range(1, rows[0]["n_pieces"] + 1))
        assert all(text[r["start"] - 1 :].startswith(r["piece"]) and len(r["piece"]) <= most for r in rows)
        out = rows[0]["piece"]
        for r in rows[1:]:
            shared = len(out) - (r["start"] - 1)
            assert shared == min(lap, most // 2, len(out))
            out += r["piece"][shared:]
        assert out == text
    assert {r["row_id"] for r in results("p3_found")} == {i for i, rows in by.items() if len(rows) > 1}


def test_outputs_agree_with_each_other(results):
    assert sum(r["lines_removed"] for r in results("p6_cleaned")) == len(results("p6_found"))
    marked = {r["page_id"] for r in results("p6_found")}
    assert {r["page_id"] for r in results("p6_cleaned") if r["lines_removed"]} == marked
    items = {}
    for r in results("p8_found"):
        items[r["item_id"]] = items.get(r["item_id"], 0) + 1
    assert {r["item_id"]: r["n_documents"] for r in results("p8_items")} == items
    ends = {(r["row_id"], r["end_pos"]) for r in results("p7_sentences")}
    assert {(r["row_id"], r["end_pos"]) for r in results("p7_found")} <= ends
    cut = {}
    for r in results("p2_found"):
        cut[r["field"]] = cut.get(r["field"], 0) + 1
    assert sum(r["cut_texts"] for r in results("p2_rates")) == cut.get("text", 0) and sum(r["cut_page_ranges"] for r in results("p2_rates")) == cut.get("page_range", 0)
    assert {r["row_id"] for r in results("p1_statistics") if r["kind"] in ("list", "table", "junk")} == {r["row_id"] for r in results("p1_found")}
    links = {}
    for a, b in results("p5_found"):
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
    assert {r["page_id"]: r["n_links"] for r in results("p5_classes")} == links
    assert sum(r["n_masked"] for r in results("p10_masked")) == len(results("p10_found"))


def test_mix_and_shares_agree(results):
    used, copies = {}, {}
    for r in results("p9_mix"):
        used[r["source"]] = used.get(r["source"], 0) + r["tokens"] * r["copies"]
        copies[r["source"]] = copies.get(r["source"], 0) + r["copies"]
    shares = results("p9_shares")
    assert {r["source"].strip().lower(): (r["used_tokens"], r["copies"]) for r in shares if r["n_docs"]} == {k: (v, copies[k]) for k, v in used.items()}
    assert abs(sum(r["actual_share"] for r in shares) - 1) < 1e-9
    assert {r["source"] for r in shares if r["short"]} == {r["source"] for r in results("p9_found")}


def test_statistics_are_exact_on_long_texts(spark):
    """Shares are those of the whole text, whatever its length."""
    from tintero.llm import quality

    texts = ["xyz qrt " * 400 + "aeiou " * 10, "ab" * 2000, "el gasto " * 900, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id int, text string")
    for r in quality.graded(df, ["el"]).collect():
        t = texts[r["row_id"]] or ""
        marks = "".join(t.split())
        assert r["n_words"] == len(t.split()) and r["n_chars"] == len(t)
        assert abs(r["vowel_share"] - sum(c in "aeiou" for c in marks) / max(len(marks), 1)) < 1e-9
        assert abs(r["common_share"] - sum(w == "el" for w in t.split()) / max(len(t.split()), 1)) < 1e-9
