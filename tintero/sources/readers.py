"""Sources: JSON arrays and lines, CSV, binary files, listings; schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Entity schemas.
LIST_ROWS = "date STRING, doc_title STRING, page_url STRING"
METADATA_RAW = LIST_ROWS + ", pdf_url STRING, pdf_filename STRING"
METADATA = "date DATE, year STRING, month INT, page_url STRING, pdf_url STRING, pdf_filename STRING, pdf_type STRING, doc_title STRING, doc_type STRING, doc_number INT"
PAGES = "pdf_filename STRING, page INT, text STRING"
PARAGRAPHS = "pdf_filename STRING, page_range STRING, paragraph_num INT, text STRING, length INT, source_type STRING"
SCORED = "paragraph_num INT, text STRING, length INT, page_range STRING, pdf_filename STRING, doc_title STRING, doc_type STRING, doc_number INT, date STRING, year STRING, month INT, source_type STRING, pdf_type STRING, pdf_url STRING, page_url STRING, normalized BOOLEAN, original_paragraph_num INT, chunk_index INT, total_chunks INT, merged_with INT, fiscal_risk_score INT, risk_index DOUBLE"
WORDS = "pdf_filename STRING, page INT, total_pages INT, page_width DOUBLE, page_height DOUBLE, seq INT, text STRING, size DOUBLE, top DOUBLE, x0 DOUBLE, fontname STRING"
TOKENS = "pdf_filename STRING, page INT, seq INT, text STRING, conf INT, left INT, top INT, width INT, height INT, block_num INT, line_num INT"
CROP_LOG = "filename STRING, cropped INT, pages INT, error STRING"


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that each hold one JSON array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; texts may hold line breaks and quotes."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def files(spark: SparkSession, folder: str, glob: str = "*.[pP][dD][fF]") -> DataFrame:
    """Names of the files of a folder, with size and time; contents are not read."""
    b = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return b.select(F.element_at(F.split("path", "/"), -1).alias("pdf_filename"), "path", "length", "modificationTime")
