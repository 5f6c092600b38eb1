"""Lengths made even by the similarity of neighbours."""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tintero.functions.text import let, put, strip

Encoder = Callable[[list[str]], "np.ndarray"]
#: Lengths: paragraphs beyond LONG are split, those under SHORT merged, both towards TARGET.
LONG, SHORT, TARGET = 1000, 200, 700


def word_encoder(texts: list[str]) -> np.ndarray:
    """Deterministic stand-in for a sentence model: words counted in 64 slots by their checksum."""
    slot: dict[str, int] = {}
    out = np.zeros((len(texts), 64))
    for i, t in enumerate(texts):
        words = t.lower().split()
        for w in words:
            if w not in slot:
                slot[w] = crc32(w.encode("utf-8", "surrogatepass")) % 64
        out[i] = np.bincount([slot[w] for w in words], minlength=64) if words else 0.0
    return out


def vectors(texts: Column, encoder: Encoder = word_encoder) -> Column:
    """The vectors of an array of texts, one call of the encoder per Arrow batch."""

    @F.pandas_udf("array<array<double>>")
    def encode(col: pd.Series) -> pd.Series:
        flat = [t for row in col for t in (row if row is not None else ())]
        got = iter(np.asarray(encoder(flat)).tolist() if flat else ())
        return pd.Series([[next(got) for _ in (row if row is not None else ())] for row in col])

    return encode(texts)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where one is null or all zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def neighbour_similarity(df: DataFrame, group: str, order: str, vector: str) -> DataFrame:
    """Each row with the cosine to the next row of its group (null for the last)."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("similarity", cosine(F.col(vector), F.lead(vector).over(w)))


def split_points(df: DataFrame, group: str, order: str, similarity: str = "similarity") -> DataFrame:
    """Chunk ids: a chunk ends where the similarity to the next row is under mean - 0.5 standard deviations of its group."""
    every, run = Window.partitionBy(group), Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    low = F.avg(similarity).over(every) - 0.5 * F.stddev_pop(similarity).over(every)
    x = df.withColumn("_cut", F.coalesce((F.col(similarity) < low).cast("int"), F.lit(0)))
    return x.withColumn("chunk", F.coalesce(F.sum("_cut").over(run), F.lit(0))).drop("_cut")


def pack_chunks(chunks: Column, target: int = 700, min_chars: int = 200, keep_all: bool = False) -> Column:
    """Chunks joined greedily up to ``target`` characters.

    Chunks under ``min_chars`` other than the last are dropped, as the rule has
    it; ``keep_all`` keeps them.
    """
    kept = chunks if keep_all else F.filter(chunks, lambda c, i: (F.length(c) >= min_chars) | (i == F.size(chunks) - 1))

    def fold(acc, c):
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (F.length(last) + F.length(c) <= target)
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last, F.lit(" "), c)))).otherwise(F.concat(acc, F.array(c)))

    return F.aggregate(kept, F.array().cast("array<string>"), fold)


def merge_short(df: DataFrame, group: str, order: str, length: str, similarity: str = "similarity", short: int = 200, limit: int = 1000, alike: float = 0.7) -> DataFrame:
    """Short rows merged into their next row: greedy from the left, a merged row is not tried again.

    In each unbroken run of rows that would merge, the 1st, 3rd, 5th... do, so
    the greedy walk is two window functions.  Adds merge_id (first row's order)
    and merged.
    """
    w = Window.partitionBy(group).orderBy(order)
    can = (F.col(length) < short) & (F.col(length) + F.lead(length).over(w) <= limit) & (F.col(similarity) >= alike)
    x = df.withColumn("_can", F.coalesce(can, F.lit(False)))
    x = x.withColumn("_run", F.sum(F.when(F.col("_can"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("_run", F.coalesce("_run", F.lit(0)))
    pos = F.row_number().over(Window.partitionBy(group, "_run").orderBy(order))
    x = x.withColumn("_starts", F.col("_can") & ((pos % 2) == 1))
    taken = F.coalesce(F.lag("_starts").over(w), F.lit(False))
    x = x.withColumn("_taken", taken)
    return x.withColumns({"merge_id": F.when(F.col("_taken"), F.lag(order).over(w)).otherwise(F.col(order)), "merged": F.col("_starts") | F.col("_taken")}).drop("_can", "_run", "_starts", "_taken")


def sentence_chunks(sentences: Column, vecs: Column) -> Column:
    """Sentences joined into chunks: a chunk ends before a sentence whose similarity to the one before is under mean - 0.5 deviations."""
    n = F.size(sentences)
    sims = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.coalesce(cosine(F.get(vecs, i - 1), F.get(vecs, i)), F.lit(0.0)))).otherwise(F.array().cast("array<double>"))

    def fold(s, low):
        zero = F.struct(F.array().cast("array<string>").alias("done"), F.element_at(sentences, 1).alias("cur"))

        def step(acc, i):
            cut, x = F.get(s, i - 1) < low, F.get(sentences, i)
            return F.struct(F.when(cut, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"), F.when(cut, x).otherwise(F.concat(acc["cur"], F.lit(" "), x)).alias("cur"))

        return F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), zero, step, lambda a: F.concat(a["done"], F.array(a["cur"])))

    def build(s):
        # Mean and deviation are computed once each, not for every sentence.
        k = F.greatest(F.size(s), F.lit(1))
        low = lambda mean: mean - 0.5 * F.sqrt(F.aggregate(s, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / k)
        return let(F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / k, lambda mean: let(low(mean), lambda t: fold(s, t)))

    folded = let(sims, build)
    return F.when(n > 1, folded).otherwise(sentences)


def normalised_paragraphs(df: DataFrame, encoder: Encoder = word_encoder, keep_all: bool = False, alike: float = 0.7) -> DataFrame:
    """Paragraphs of even length: long ones split between unlike sentences, short ones merged with a like next one.

    ``df`` has pdf_filename, paragraph_num and text (others are dropped).  Adds
    normalized, original_paragraph_num, chunk_index, total_chunks (of split
    paragraphs), merged_with (number of the paragraph that was joined to it) and
    the new length.  Null texts take no part.  ``keep_all`` keeps chunks that the
    rule drops as too short.
    """
    p = df.where("text IS NOT NULL").select("pdf_filename", "paragraph_num", "text")
    sents = F.filter(F.transform(F.split("text", r"(?<=[.!?])\s+"), strip), lambda s: s != "")
    # Sentences, vectors and chunks are made once for each row, behind generators.
    long = put(p.where(F.length("text") > LONG), "_s", sents)
    long = put(long, "_v", vectors(F.col("_s"), encoder))
    long = put(long, "_d", sentence_chunks(F.col("_s"), F.col("_v")))
    cut = put(long, "_c", F.when(F.size("_s") > 1, pack_chunks(F.col("_d"), TARGET, SHORT, keep_all)).otherwise(F.array("text")))
    split = F.size("_s") > 1
    pieces = cut.select("pdf_filename", "paragraph_num", F.posexplode("_c").alias("chunk_index", "text"), F.size("_c").alias("total_chunks"), split.alias("_split"))
    pieces = pieces.select("pdf_filename", "paragraph_num", "text", F.when(F.col("_split"), F.col("chunk_index")).alias("chunk_index"), F.when(F.col("_split"), F.col("total_chunks")).alias("total_chunks"))
    whole = p.where(F.length("text") <= LONG).select("*", F.lit(None).cast("int").alias("chunk_index"), F.lit(None).cast("int").alias("total_chunks"))
    rows = pieces.unionByName(whole).withColumn("_k", F.struct("paragraph_num", F.coalesce("chunk_index", F.lit(0)).alias("c")))
    rows = rows.withColumn("_x", F.when(F.length("text") <= LONG, F.get(vectors(F.array("text"), encoder), F.lit(0))))
    w = Window.partitionBy("pdf_filename").orderBy("_k")
    rows = rows.withColumns({"similarity": cosine(F.col("_x"), F.lead("_x").over(w)), "_n": F.length("text")}).drop("_x")
    m = merge_short(rows, "pdf_filename", "_k", "_n", alike=alike, short=SHORT, limit=LONG)
    g = m.groupBy("pdf_filename", "merge_id").agg(F.array_sort(F.collect_list(F.struct("_k", "text", "chunk_index", "total_chunks", "paragraph_num"))).alias("x"))
    first, second = F.element_at("x", 1), F.get("x", F.lit(1))
    text = F.array_join(F.transform("x", lambda r: r["text"]), " ")
    return g.select(
        "pdf_filename", first["paragraph_num"].alias("paragraph_num"), text.alias("text"), F.length(text).alias("length"), (first["chunk_index"].isNotNull() | second.isNotNull()).alias("normalized"),
        F.when(first["chunk_index"].isNotNull(), first["paragraph_num"]).alias("original_paragraph_num"), first["chunk_index"].alias("chunk_index"), first["total_chunks"].alias("total_chunks"), second["paragraph_num"].alias("merged_with"),
    )
