"""Problem 5 on tables: consistent text, and classes of pages that look alike but differ in characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintero.llm.canonical import with_canonical
from tintero.runtime import checkpoint


def canonical_text(df: DataFrame, id_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """Every row's id with its text in canonical form and whether it changed.

    Null text stays null (changed = false); empty text stays empty; repeated rows
    are kept, one output row for each input row.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return with_canonical(rows, "_text", "canonical").select(F.col("_id").alias(id_col), "canonical", F.coalesce(F.col("canonical") != F.col("_text"), F.lit(False)).alias("changed"))


def fingerprints(df: DataFrame, id_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """(id, 128-bit hash of the canonical form, 128-bit hash of the raw text); null texts are left out."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")).where("_text IS NOT NULL")
    return with_canonical(rows, "_text", "_c").select("id", F.unhex(F.md5("_c")).alias("look"), F.unhex(F.md5("_text")).alias("raw"))


def lookalike_texts(prints: DataFrame) -> DataFrame:
    """(look, raw, n_rows): the distinct texts of classes with two or more differing texts.

    Exact copies are folded in the task before a class is formed, so a page
    loaded a million times is one row here.
    """
    texts = prints.groupBy("look", "raw").agg(F.count("*").alias("n_rows"))
    multi = texts.groupBy("look").agg(F.count("*").alias("n")).where("n > 1").select("look")
    return texts.join(multi, "look", "left_semi")


def lookalike_classes(df: DataFrame, id_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """Membership, one row per row of ``df`` whose look it shares with a differing text.

    Columns: the id, class_id, n_texts (differing texts of the class), n_links
    (rows that look the same and differ in characters).  Nothing is paired.
    Null texts belong to no class; texts that differ from no other one neither.
    """
    p = checkpoint(fingerprints(df, id_col, text_col))
    texts = checkpoint(lookalike_texts(p))
    total = texts.groupBy("look").agg(F.count("*").alias("n_texts"), F.sum("n_rows").alias("_all"))
    t = texts.join(total, "look").select("look", "raw", "n_texts", (F.col("_all") - F.col("n_rows")).alias("n_links"))
    return p.join(t, ["look", "raw"]).select(F.col("id").alias(id_col), F.lower(F.hex("look")).alias("class_id"), "n_texts", "n_links")


def lookalike_pairs(df: DataFrame, id_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """Pairs of row ids, smaller first, whose texts look the same but differ in characters.

    The result is defined as pairs, so it is as large as the differing members
    of a class make it.  Pairs are made between distinct texts of a class and
    then given their rows: copies of one text are never compared, and classes of
    mere copies (empty texts included) are gone before.
    """
    p = checkpoint(fingerprints(df, id_col, text_col))
    texts = checkpoint(lookalike_texts(p)).select("look", "raw")
    rows = checkpoint(p.join(texts, ["look", "raw"], "left_semi").distinct())
    a = texts.withColumnRenamed("raw", "raw_a").join(texts.withColumnRenamed("raw", "raw_b"), "look").where("raw_a < raw_b").select("raw_a", "raw_b")
    pairs = a.join(rows.select(F.col("id").alias("i"), F.col("raw").alias("raw_a")), "raw_a").join(rows.select(F.col("id").alias("j"), F.col("raw").alias("raw_b")), "raw_b").where("i != j")
    return pairs.select(F.least("i", "j").alias(f"{id_col}_a"), F.greatest("i", "j").alias(f"{id_col}_b")).distinct()
