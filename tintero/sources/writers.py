"""Sinks: JSON lines or one array, CSV, twin output, partitioned routing, idempotent batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintero.runtime import bytes_of


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSS").json(path)


#: Bytes of a result that may be put into one row.
ONE_ROW = 64 << 20


def json_array(df: DataFrame) -> DataFrame:
    """One row holding the rows as one JSON array; results beyond the bound are refused, write them as lines."""
    if bytes_of(df) > ONE_ROW:
        raise ValueError(f"more than {ONE_ROW} bytes for one JSON array; use json_lines")
    return df.agg(F.to_json(F.collect_list(F.struct("*"))).alias("json"))


def csv(df: DataFrame, path: str) -> None:
    """CSV with header; quotes are doubled so that texts with line breaks read back."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def twin(df: DataFrame, reason: str, good: str, bad: str) -> None:
    """Rows without a reason to one place, with one to the other."""
    df.where(F.col(reason).isNull()).drop(reason).write.mode("overwrite").parquet(good)
    df.where(F.col(reason).isNotNull()).write.mode("overwrite").parquet(bad)


def routed(df: DataFrame, path: str, by: str = "pdf_type") -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def batch(df: DataFrame, path: str, batch_id: int) -> None:
    """A batch written under its number: writing it again replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def backup(df: DataFrame, path: str, moment: str) -> str:
    """A copy under the moment it was taken; returns its place."""
    place = f"{path}_backup_{moment}"
    json_lines(df, place)
    return place
