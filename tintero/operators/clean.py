"""Cleaning of page texts from editable files: ten ordered rules over paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tintero.functions.text import chain, has, let, put, strip, word_count

# The rules as (pattern, replacement, flags), in the order in which they apply.
SIGNATURES = [(r"\n*[\.…]{5,}[\s\n]*([A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ\s]+)(?=\n|$)", "", "")]
DATED = [
    (r"\n*Lima,?\s+\d{1,2}\s+de\s+\w+\s+de\s+\d{4}\.?[\s\n]*", "\n\n", ""),
    (r"\n\n([A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ\s]{10,})\n\n", "\n\n", ""),
]
CAPITALS = [(r"\n\n([A-ZÁÉÍÓÚÑ]+(?:\s+[A-ZÁÉÍÓÚÑ]+){2,})\n\n", "\n\n", "")]
CHART_TITLES = [(r"\n*(Gráfico|Tabla|Cuadro|Figura)\s+N?°?\s*\d+[^\n]*\n*", "\n", "i")]
PANELS = [
    (r"\n+\([A-Z]\)\s[^\n]+\([A-Z]\)\s[^\n]*\n+", "\n", ""),
    (r"\n+[A-Z]\)\s[^\n]+[A-Z]\)\s[^\n]*\n+", "\n", ""),
    (r"\n+\([A-Z]\)\s[^\n]{1,50}\n+", "\n", ""),
]
RARE_SYMBOLS = "•➢►■▪□◼○●▫Ø"
SPACES = [(r"\s+([.,;:!?])", "$1", ""), (r" {2,}", " ", ""), (r"\n{3,}", "\n\n", "")]
ENUMERATION = [(r"\n\n([a-z]|[ivxIVX]+|\d+)\)\s*\n\n", "\n\n", "")]
FALSE_BREAKS = [(r"\n\n([a-záéíóúñü])", " $1", ""), (r"\n\n([12]\d{3})", " $1", "")]
CHART_LABEL = r"^(Gráfico|Tabla|Cuadro|Figura|Gráf|Tab)\s+N?°?\s*\d+"
LABELS = [r"^\d+\s*:\s*.+", r"^[IVXLCDM]+\s*[.:]", r"^[A-Z]\s*\)\s*.+"]


# Fixed values, here and below: lengths, counts and inline patterns of the rules.
def is_header(t: Column) -> Column:
    """A section heading: short, few words, opens with a capital, no closing stop, no dateline."""
    # Cheap tests first: most paragraphs are too long, and no word is counted in them.
    return (F.length(t) > 0) & (F.length(t) < 150) & t.rlike(r"^\p{Lu}") & ~t.rlike(r"[.!?]$") & ~has(t, r"^Lima,?\s+\d{1,2}\s+de") & word_count(t).between(1, 19)


def is_label(t: Column) -> Column:
    """The label of a chart, a table or a numbered item."""
    out = has(t, CHART_LABEL, "i")
    for p in LABELS:
        out = out | has(t, p)
    return (t != "") & (out | (has(t, r"^[A-Z]\s*\.\s*.+") & (F.length(t) < 100)))


def drop_headers(col: Column) -> Column:
    """Paragraphs that are headings or labels taken out; the others stay as they are."""
    return F.array_join(F.filter(F.split(col, "\n\n"), lambda p: let(strip(p), lambda t: ~(is_header(t) | is_label(t)))), "\n\n")


def clean_rules(aggressive: bool = False):
    """The steps as (name, Column -> Column)."""
    rules = lambda r: lambda c: chain(c, r)
    steps = [
        ("dotted_signatures", rules(SIGNATURES)), ("dated_signatures", rules(DATED)), ("uppercase_lines", rules(CAPITALS)), ("section_headers", drop_headers), ("chart_titles", rules(CHART_TITLES)), ("chart_labels", rules(PANELS)),
        ("rare_symbols", lambda c: F.replace(F.translate(c, RARE_SYMBOLS, " " * len(RARE_SYMBOLS)), F.lit("…"), F.lit("..."))), ("whitespace", lambda c: strip(chain(c, SPACES))),
    ]
    if aggressive:
        steps.append(("enumeration", rules(ENUMERATION)))
    return [*steps, ("false_breaks", rules(FALSE_BREAKS))]


def clean_text(col: Column, aggressive: bool = False) -> Column:
    """The text after all steps; null stays null, blank becomes empty."""
    for _, step in clean_rules(aggressive):
        col = let(col, step)
    return col


def clean_pages(df: DataFrame, text_col: str = "text", aggressive: bool = False) -> DataFrame:
    """``df`` with the cleaned text, both lengths, the reduction in per cent and the steps applied.

    Null texts count as empty.
    """
    out = put(df, "cleaned_text", clean_text(F.coalesce(F.col(text_col), F.lit("")), aggressive))
    names = [n for n, _ in clean_rules(aggressive)]
    before = F.length(F.coalesce(F.col(text_col), F.lit("")))
    after = F.length("cleaned_text")
    return out.withColumns({
        "original_length": before, "cleaned_length": after, "reduction_pct": F.when(before > 0, (before - after) / before * 100).otherwise(F.lit(0.0)), "steps_applied": F.array(*map(F.lit, names)),
    })


def reduction_summary(cleaned: DataFrame) -> DataFrame:
    """Totals of the lengths, overall and mean reduction, and rows reduced by more than 5 per cent."""
    o, c = F.sum("original_length"), F.sum("cleaned_length")
    return cleaned.agg(
        F.count("*").alias("n_rows"), o.alias("original_chars"), c.alias("cleaned_chars"), F.when(o > 0, (o - c) / o * 100).otherwise(0.0).alias("reduction_pct"), F.avg("reduction_pct").alias("mean_reduction_pct"), F.count_if(F.col("reduction_pct") > 5).alias("n_significant"),
    )


def rule_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """How often dates and false breaks stand in the texts before and after cleaning."""
    c = clean_pages(df, text_col)
    dates, breaks = F.lit(r"(?U)Lima,?\s+\d{1,2}\s+de\s+\w+\s+de\s+\d{4}"), F.lit("\n\n[a-záéíóúñü]")
    text = F.coalesce(F.col(text_col), F.lit(""))
    return c.agg(F.sum(F.regexp_count(text, dates)).alias("dates_before"), F.sum(F.regexp_count("cleaned_text", dates)).alias("dates_after"), F.sum(F.regexp_count(text, breaks)).alias("breaks_before"), F.sum(F.regexp_count("cleaned_text", breaks)).alias("breaks_after"))
