"""Aggregates: document scores, corpus statistics, distributions, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tintero.operators.segment import running

SCORE = "fiscal_risk_score"


def document_scores(scored: DataFrame) -> DataFrame:
    """Per document and date: means, count, counts per score, tone index, first non-null descriptions.

    Documents without a date and documents without a scored row drop out.
    """
    s = scored.where("date IS NOT NULL AND date != ''")
    first = [F.min(c).alias(c) for c in ("doc_title", "doc_type", "doc_number", "year", "month") if c in s.columns]
    counts = [F.count_if((F.col(SCORE) == k) & F.col("text").isNotNull()).alias(f"score_{k}") for k in range(1, 6)]
    g = s.groupBy("pdf_filename", "date").agg(F.avg(SCORE).alias("avg_risk_score"), F.count(SCORE).alias("n_paragraphs"), F.avg("risk_index").alias("avg_risk_index"), *first, *counts)
    return g.where("n_paragraphs > 0").withColumn("tone_index", (F.lit(3) - F.col("avg_risk_score")) / 2)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts per value with their share of all rows in per cent; the total is taken from the counts."""
    g = df.groupBy(col).agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n")).first()[0] or 1
    return g.withColumn("pct", F.col("n") * 100 / F.lit(total))


def corpus_tone(scores: DataFrame) -> DataFrame:
    """Mean and sample deviation over document scores."""
    return scores.agg(F.count("*").alias("n_documents"), F.avg("avg_risk_score").alias("mean_score"), F.stddev_samp("avg_risk_score").alias("std_score"), F.avg("tone_index").alias("mean_tone"), F.stddev_samp("tone_index").alias("std_tone"))


def upper_median(df: DataFrame, value: Column) -> DataFrame:
    """Count, minimum, maximum, mean and upper median (the element at position n // 2 of the sorted values).

    Values are counted before they are ordered, and summed up range by range.
    """
    g = df.select(value.alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("c"))
    t = g.agg(F.sum("c").alias("n"), F.min("v").alias("min_v"), F.max("v").alias("max_v"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean_v")).first()
    n = t["n"] or 0
    run = running(g, ["v"], F.col("c"), "s")
    m = run.where(F.col("s") > n // 2).agg(F.min("v").alias("upper_median"))
    return m.select(F.lit(n).cast("bigint").alias("n"), F.lit(t["min_v"]).alias("min_value"), F.lit(t["max_v"]).alias("max_value"), F.lit(t["mean_v"]).cast("double").alias("mean_value"), "upper_median")


def length_profile(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Moments, buckets and the share in the target range of the lengths of non-null texts."""
    n = F.length(text_col)
    inside = lambda c: F.count_if(c)
    return df.where(F.col(text_col).isNotNull()).agg(
        F.count("*").alias("n"), F.avg(n).alias("mean"), F.median(n).alias("median"), F.stddev_pop(n).alias("std_pop"), F.min(n).alias("min"), F.max(n).alias("max"), inside(n < 200).alias("under_200"), inside((n >= 200) & (n < 400)).alias("from_200"), inside((n >= 400) & (n < 700)).alias("from_400"), inside((n >= 700) & (n < 1000)).alias("from_700"), inside(n >= 1000).alias("from_1000"), (inside(n.between(400, 700)) / F.count("*")).alias("target_share"),
    )


def grouped_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows and documents per value; null and empty count as Unknown."""
    k = F.when(F.col(col).isNull() | (F.col(col) == ""), "Unknown").otherwise(F.col(col))
    return df.groupBy(k.alias(col)).agg(F.count("*").alias("paragraphs"), F.countDistinct("pdf_filename").alias("documents"))


def corpus_statistics(df: DataFrame) -> DataFrame:
    """Overview, length statistics and percentiles (interpolated) in one row."""
    n = F.length("text")
    ps = [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
    base = df.where("text IS NOT NULL").agg(
        F.count("*").alias("total_paragraphs"), F.countDistinct("pdf_filename").alias("total_documents"), F.sum(n).alias("total_characters"), F.avg(n).alias("mean_length"), F.median(n).alias("median_length"), F.stddev_samp(n).alias("std_samp"), F.stddev_pop(n).alias("std_pop"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.percentile(n, F.array(*map(F.lit, ps))).alias("p"),
    )
    return base.select("*", *(F.col("p")[i].alias(f"p{int(p * 100)}") for i, p in enumerate(ps))).drop("p")


def histogram(df: DataFrame, value: Column, width: int = 200) -> DataFrame:
    """Zero-filled histogram: bin, label, count; the largest value falls into the last bin."""
    v = df.select(value.alias("v")).where("v IS NOT NULL")
    top = v.agg(F.max("v")).first()[0] or 0
    bins = max(1, -(-top // width))
    g = v.groupBy(F.least(F.floor(F.col("v") / width), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return frame.join(g, "bin", "left").select("bin", F.concat((F.col("bin") * width).cast("string"), F.lit("-"), ((F.col("bin") + 1) * width).cast("string")).alias("label"), F.coalesce("n", F.lit(0)).alias("n"))


def per_document(df: DataFrame) -> DataFrame:
    """Paragraphs, documents, and their ratio to one decimal."""
    return df.agg(F.count("*").alias("paragraphs"), F.countDistinct("pdf_filename").alias("documents")).withColumn("per_document", F.round(F.col("paragraphs") / F.col("documents"), 1))


def page_totals(pages: DataFrame) -> DataFrame:
    """Pages, characters, characters a page (whole number) and files."""
    chars = F.sum(F.length(F.coalesce("text", F.lit(""))))
    return pages.agg(F.count("*").alias("pages"), chars.alias("chars"), F.floor(chars / F.count("*")).alias("chars_per_page"), F.countDistinct("pdf_filename").alias("files"))


def first_documents(df: DataFrame, key: str = "pdf_filename", order: str = "paragraph_num", limit: int = 8) -> DataFrame:
    """The first documents in order of their first row."""
    return df.groupBy(key).agg(F.min(order).alias("first_row")).orderBy("first_row", key).limit(limit)


def cost_estimate(df: DataFrame, context_chars: int, text_col: str = "text", in_rate: float = 0.0025, out_rate: float = 0.01, reply_tokens: int = 5) -> DataFrame:
    """What scoring would cost: four characters a token over texts with their context, rates per thousand tokens."""
    chars = F.coalesce(F.sum(F.length(F.coalesce(text_col, F.lit(""))).cast("bigint") + F.lit(context_chars)), F.lit(0))
    t = df.agg(F.count("*").alias("n_rows"), F.floor(chars / 4).alias("input_tokens")).withColumn("output_tokens", F.col("n_rows") * reply_tokens)
    cost = {"input_cost": F.col("input_tokens") * in_rate / 1000, "output_cost": F.col("output_tokens") * out_rate / 1000}
    return t.withColumns(cost).withColumn("total_cost", F.col("input_cost") + F.col("output_cost"))


def statistics_document(df: DataFrame) -> DataFrame:
    """One row of nested statistics, for JSON: overview, lengths with percentiles, shares by source."""
    s = corpus_statistics(df)
    ps = [c for c in s.columns if c.startswith("p") and c[1:].isdigit()]
    top = s.select(F.struct("total_paragraphs", "total_documents", "total_characters").alias("overview"), F.struct("mean_length", "median_length", "std_samp", "std_pop", "min_length", "max_length").alias("length"), F.struct(*ps).alias("percentiles"))
    by = value_counts(df.where("text IS NOT NULL"), "source_type").agg(F.array_sort(F.collect_list(F.struct("source_type", "n", "pct"))).alias("by_source"))
    return top.join(by)  # one row on either side
