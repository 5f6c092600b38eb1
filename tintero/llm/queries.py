"""Registered queries of the subpackage and their SQL counterparts, where SQL can express them."""

from __future__ import annotations

from tintero.llm import boilerplate, leaks, lookalike, mixing, pieces, pii, quality, scanned, sentences, truncation
from tintero.runtime import table

PARAGRAPHS = "unified_paragraphs_segmented"
PAGES = "scanned_pdfs_extracted_text"


def _pages(fn):
    return lambda spark, d: fn(table(spark, d, PAGES))


def _common(spark, d):
    return quality.common_words(spark, table(spark, d, "common_words"))


def _p1_found(spark, d):
    p = table(spark, d, PARAGRAPHS).select("row_id", "text")
    return quality.kinds(p, _common(spark, d)).where("kind IN ('list', 'table', 'junk')").select("row_id")


def _p1_stats(spark, d):
    return quality.graded(table(spark, d, PARAGRAPHS).select("row_id", "length", "text"), _common(spark, d)).drop("text")


def _p2(fn):
    return lambda spark, d: fn(table(spark, d, PARAGRAPHS), table(spark, d, "common_words"))


def _p3_pieces(spark, d):
    return pieces.pieces(table(spark, d, PARAGRAPHS), table(spark, d, "size_limits"))


def _p7_found(spark, d):
    return sentences.units_of(table(spark, d, PARAGRAPHS), table(spark, d, "sentence_check")).select("row_id", "end_pos")


def _p8(fn):
    return lambda spark, d: fn(table(spark, d, "documents"), table(spark, d, "eval_items"))


def _p9(fn):
    return lambda spark, d: fn(table(spark, d, "documents"), table(spark, d, "source_weights"))


QUERIES = {
    "p10_found": lambda spark, d: pii.find(table(spark, d, "documents")).select("doc_id", "kind", "start_pos"),
    "p10_masked": lambda spark, d: pii.masked(table(spark, d, "documents")),
    "p8_found": lambda spark, d: _p8(leaks.leaked_documents)(spark, d).select("doc_id", "item_id"),
    "p8_items": _p8(leaks.leaked_items),
    "p9_found": _p9(mixing.short_sources),
    "p9_mix": _p9(mixing.mix),
    "p9_shares": _p9(mixing.shares),
    "p7_found": _p7_found,
    "p7_sentences": lambda spark, d: sentences.units(table(spark, d, PARAGRAPHS)),
    "p2_found": lambda spark, d: _p2(truncation.truncated)(spark, d).select("row_id", "field"),
    "p2_rates": _p2(truncation.rates),
    "p3_found": lambda spark, d: _p3_pieces(spark, d).where("n_pieces > 1 AND piece_no = 1").select("row_id"),
    "p3_pieces": _p3_pieces,
    "p1_found": _p1_found,
    "p1_statistics": _p1_stats,
    "p4_found": _pages(scanned.found),
    "p4_repaired": _pages(scanned.repaired),
    "p5_found": _pages(lookalike.lookalike_pairs),
    "p5_classes": _pages(lookalike.lookalike_classes),
    "p5_canonical": _pages(lookalike.canonical_text),
    "p6_found": lambda spark, d: boilerplate.repeated_lines(table(spark, d, PAGES)).select("page_id", "line_no"),
    "p6_cleaned": _pages(boilerplate.without_repeated),
    "p6_sequences": _pages(boilerplate.frequent_sequences),
}
ORACLES: dict[str, str] = {
    "p9_found": """
WITH d AS (SELECT lower(trim(source)) AS s, sum(length(coalesce(text, ''))) AS c FROM documents WHERE source IS NOT NULL AND trim(source) <> '' GROUP BY 1)
SELECT w.source FROM source_weights w LEFT JOIN d ON d.s = lower(trim(w.source))
WHERE coalesce(d.c, 0) * w.max_repeats < w.target_share * (SELECT sum(c) FROM d)""",
    "p3_found": """
SELECT u.row_id FROM unified_paragraphs_segmented u
LEFT JOIN size_limits l ON l.source_type = u.source_type AND l.source_type <> '*'
LEFT JOIN size_limits s ON s.source_type = '*'
WHERE length(u.text) > coalesce(l.max_chars, s.max_chars)""",
}
