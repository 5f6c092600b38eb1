"""Quality gate of paragraphs: the first failing rule names the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tintero.functions.text import letters, put, rx

MIN_CHARS = 100
ENDINGS = r"[.!?)\]\"%:]$"
LIST_MARKER = rx(r"^\s*(?:[-•*]|\d+[.)]|[a-z][.)])\s*$")


def reason(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """Why a paragraph is rejected; null where it is valid.  Null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    return (
        F.when(n < min_chars, F.concat(F.lit("too_short ("), n.cast("string"), F.lit(" chars)"))).when(~t.rlike(r"^[\p{Lu}\p{Nd}]"), "starts_lowercase").when(~t.rlike(ENDINGS), "no_ending_punctuation").when(letters(t) < 0.5 * n, "insufficient_text_content").when(t.rlike(LIST_MARKER), "list_marker")
    )


def graded(df: DataFrame, text_col: str = "text") -> DataFrame:
    return put(df, "reason", reason(F.col(text_col)))


def valid(df: DataFrame, text_col: str = "text") -> DataFrame:
    return graded(df, text_col).where("reason IS NULL").drop("reason")


def rejected(df: DataFrame, text_col: str = "text") -> DataFrame:
    return graded(df, text_col).where("reason IS NOT NULL")


def reasons(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rejections by reason, lengths aside, with their share of all rejections in per cent."""
    kind = F.regexp_replace("reason", r" \(\d+ chars\)$", "")
    g = rejected(df, text_col).groupBy(kind.alias("reason")).agg(F.count("*").alias("n"))
    # One row per kind of reason: the window sees a handful of rows.
    return g.withColumn("pct", F.col("n") * 100 / F.sum("n").over(Window.partitionBy()))
