"""Metadata: document type and number, dates, joins with paragraphs, increments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tintero.functions.text import parse_date, rx
from tintero.runtime import checkpoint, hand_over

# The pattern of a title's type and number, columns that are text, and the order of columns.
DOC = rx(r"\b(Informe|Comunicado)\b(?:\s+CF)?(?:\s+(?:N[°ºo]|No))?\s*(\d{2,4})", "i")
STRINGS = ["doc_title", "doc_type", "date", "year", "pdf_type", "pdf_url", "page_url"]
ORDER = ["date", "year", "month", "page_url", "pdf_url", "pdf_filename", "pdf_type", "doc_title", "doc_type", "doc_number"]


def doc_type(title: Column) -> Column:
    """Informe or Comunicado, else null."""
    return F.nullif(F.initcap(F.regexp_extract(title, DOC, 1)), F.lit(""))


def doc_number(title: Column) -> Column:
    return F.nullif(F.regexp_extract(title, DOC, 2), F.lit("")).cast("int")


def enrich(list_rows: DataFrame) -> DataFrame:
    """Scraped rows with parsed date, year, month, document type and number; known columns first, others kept."""
    d = parse_date(F.col("date"))
    title = F.trim(F.regexp_replace("doc_title", r"(?U)\s+", " "))
    out = list_rows.withColumns({"_d": d, "doc_type": doc_type(title), "doc_number": doc_number(title)}).drop("date").withColumnRenamed("_d", "date")
    out = out.withColumns({"year": F.date_format("date", "yyyy"), "month": F.month("date")})
    return reorder(out)


def reorder(df: DataFrame) -> DataFrame:
    """Known columns in their order, then all others."""
    known = [c for c in ORDER if c in df.columns]
    return df.select(*known, *[c for c in df.columns if c not in known])


def latest(meta: DataFrame, key: str = "pdf_filename", order: str = "scraped_at") -> DataFrame:
    """Last row per key; equal times are told apart by all other columns."""
    rest = [c for c in meta.columns if c not in (key, order)]
    # max_by keeps one row per key in every task before it shuffles.
    body = F.struct(*[c for c in meta.columns if c != key])
    rank = F.struct(F.coalesce(F.col(order), F.timestamp_seconds(F.lit(0))), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rest])
    return meta.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(body, rank).alias("_x")).select(key, "_x.*")


def with_metadata(paragraphs: DataFrame, meta: DataFrame, key: str = "pdf_filename") -> DataFrame:
    """Paragraphs with their file's metadata.

    Where a file has none, text columns become empty and numbers null; null
    values of a found row stay null.
    """
    m = hand_over(checkpoint(latest(meta, key).drop("scraped_at").withColumn("_matched", F.lit(True))))
    clash = [c for c in m.columns if c != key and c in paragraphs.columns]
    j = paragraphs.drop(*clash).join(m, key, "left")
    fix = {c: F.when(F.col("_matched").isNull(), F.lit("")).otherwise(F.col(c).cast("string")) for c in STRINGS if c in m.columns}
    return j.withColumns(fix).drop("_matched")


def only_new(rows: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the old ones; null keys count as new."""
    return rows.join(old.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def append_new(old: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Old rows and the new ones, columns united."""
    return old.unionByName(only_new(rows, old, key), allowMissingColumns=True)


def missing_files(meta: DataFrame, *folders: DataFrame, key: str = "pdf_filename") -> DataFrame:
    """Metadata rows whose file is in none of the listings."""
    have = folders[0].select(key)
    for f in folders[1:]:
        have = have.unionByName(f.select(key))
    return meta.where(F.col(key).isNotNull()).join(have.distinct(), key, "left_anti")


def update_type(meta: DataFrame, editable: DataFrame, scanned: DataFrame, key: str = "pdf_filename") -> DataFrame:
    """pdf_type set by the folder a file lies in; the scanned folder wins, others keep theirs."""
    e = editable.select(key).distinct().withColumn("_e", F.lit("editable"))
    s = scanned.select(key).distinct().withColumn("_s", F.lit("scanned"))
    return meta.join(e, key, "left").join(s, key, "left").withColumn("pdf_type", F.coalesce("_s", "_e", "pdf_type")).drop("_e", "_s")


def without_denied(meta: DataFrame, denied: DataFrame, key: str = "pdf_filename") -> DataFrame:
    """Rows whose file is not on the list of unwanted files."""
    return meta.join(denied.select(key).distinct(), key, "left_anti")


def sort_by_date(df: DataFrame) -> DataFrame:
    return df.orderBy(F.asc_nulls_last("date"))
