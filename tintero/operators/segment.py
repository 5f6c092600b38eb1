"""From pages to paragraphs: union, pairing across pages, splitting, numbering, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tintero.functions.text import dedupe_key, paragraphs, strip, word_count, word_list
from tintero.runtime import checkpoint, hand_over

# Openings before which a long paragraph is not cut.
OPENINGS = ["Sin embargo", "No obstante", "Por otro lado", "Asimismo", "Además", "Por lo tanto", "En consecuencia", "De esta manera", "Por otra parte", "En este sentido", "Cabe mencionar"]


def tagged_union(scanned: DataFrame, editable: DataFrame) -> DataFrame:
    """Rows of both kinds with their source_type; columns missing on one side become null."""
    return scanned.withColumn("source_type", F.lit("scanned")).unionByName(editable.withColumn("source_type", F.lit("editable")), allowMissingColumns=True)


def pair_pages(pages: DataFrame, tie: str = "page_id", mode: str = "as_written") -> DataFrame:
    """Pages of a file joined across page ends.

    ``as_written`` joins them in fixed pairs in page order, an odd last page
    alone.  ``intended`` joins a page with the next one where it does not end a
    sentence.  Text is joined by one space, page_range names first and last page.
    ``tie`` orders equal pages and tells the rows apart.
    """
    order = [F.coalesce(F.col("page"), F.lit(2**31 - 1)).alias("_p"), F.col(tie)]
    open_end = ~F.coalesce(F.rtrim("text"), F.lit("")).rlike(r"[.!?]\s*$")
    # Pages are numbered without their texts; a file of any size is numbered in many tasks.
    p = pages.select("pdf_filename", order[0], F.col(tie).alias("_t"), open_end.alias("_open"))
    p = running(p, ["_p", "_t"], F.lit(1), "_n", ["pdf_filename"])
    if mode == "as_written":
        p = p.withColumn("_g", F.floor((F.col("_n") - 1) / 2))
    else:
        p = checkpoint(p)
        before = p.select(F.col("pdf_filename").alias("_f"), (F.col("_n") + 1).alias("_m"), F.col("_open").alias("_joins"))
        p = p.join(before, F.col("pdf_filename").eqNullSafe(F.col("_f")) & (F.col("_n") == F.col("_m")), "left")
        p = running(p.withColumn("_s", F.when(F.coalesce("_joins", F.lit(False)), 0).otherwise(1)), ["_n"], F.col("_s"), "_g", ["pdf_filename"])
    p = pages.select(F.col(tie).alias("_id"), "page", "text").join(p.select("pdf_filename", "_t", "_n", "_g"), F.col("_id") == F.col("_t"))
    parts = F.array_sort(F.collect_list(F.struct("_n", "page", "text")))
    g = p.groupBy("pdf_filename", "_g").agg(parts.alias("x"), F.count("*").alias("n_pages"))
    first, last = F.element_at("x", 1)["page"], F.element_at("x", -1)["page"]
    one = F.col("n_pages") == 1
    return g.select(
        "pdf_filename", first.alias("page"), F.when(one, first.cast("string")).otherwise(F.concat(first.cast("string"), F.lit("-"), last.cast("string"))).alias("page_range"),
        F.when(one, F.element_at("x", 1)["text"]).otherwise(F.array_join(F.transform("x", lambda s: strip(F.coalesce(s["text"], F.lit("")))), " ")).alias("text"), "n_pages",
    )


def paragraphs_of(pages: DataFrame, min_chars: int = 20) -> DataFrame:
    """One row per paragraph of at least ``min_chars``, with its position on the page (from 1)."""
    kept = F.filter(paragraphs(F.col("text")), lambda p: F.length(p) >= min_chars)
    keep = [c for c in pages.columns if c != "text"]
    x = pages.select(*keep, F.posexplode(kept).alias("_p", "text"))
    return x.select(*keep, (F.col("_p") + 1).alias("position"), "text", F.length("text").alias("length"), word_count(F.col("text")).alias("word_count"))


def running(df: DataFrame, keys: list[str], value: Column, name: str, group: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """Running sums of ``value`` in the order of ``keys`` (a total order), over all rows or within groups.

    Rows are range-partitioned by group and keys; each range sums up its own rows
    and adds what the ranges before it hold, so that neither one sort task nor one
    task for a hot group is needed.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = group or []
    x = checkpoint(df.withColumn("_v", value).repartitionByRange(n, *group, *keys).withColumn("_r", F.spark_partition_id()))
    sizes = x.groupBy("_r", *group).agg(F.sum("_v").alias("_c"))
    # One row per range, and one more for each group that begins in it.
    earlier = F.sum("_c").over(Window.partitionBy(*group).orderBy("_r")) - F.col("_c")
    before = hand_over(checkpoint(sizes.select(F.col("_r").alias("_q"), *(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), earlier.alias("_b"))))
    same = F.col("_r") == F.col("_q")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    w = Window.partitionBy("_r", *group).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return x.join(before, same).withColumn(name, F.sum("_v").over(w) + F.col("_b")).drop("_r", "_q", "_b", "_v", *(f"_g{i}" for i in range(len(group))))


def number_rows(df: DataFrame, keys: list[str], name: str = "paragraph_num", partitions: int | None = None) -> DataFrame:
    """Consecutive numbers from 1 in the order of ``keys`` (a total order), without one global sort task."""
    return running(df, keys, F.lit(1), name, None, partitions)


def drop_duplicates(df: DataFrame, order: list[str], text_col: str = "text") -> DataFrame:
    """First row, in ``order``, of each text that counts as the same; null is a text of its own.

    Keys are reduced to their first row before texts meet, so a text that stands
    a million times is no hot group.
    """
    key = dedupe_key(F.col(text_col))
    x = df.withColumn("_k", F.coalesce(key, F.lit("")))
    firsts = x.groupBy("_k").agg(F.min(F.struct(*order)).alias("_f"))
    same = [x["_k"] == firsts["_k"]] + [x[o].eqNullSafe(firsts["_f"][o]) for o in order]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return x.join(firsts, cond, "left_semi").drop("_k")


def split_by_words(text: Column, budget: int = 250) -> Column:
    """Sentences packed into chunks of at most ``budget`` words, never cut before a connecting opening."""
    count = lambda s: F.size(word_list(s))
    # Words are counted once for each sentence.
    sentences = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.struct(s.alias("s"), count(s).alias("w")))

    def connects(s):
        out = F.lit(False)
        for o in OPENINGS:
            out = out | s.startswith(o)
        return out

    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("n"))

    def step(acc, x):
        s, w = x["s"], x["w"]
        over = (acc["n"] + w > budget) & (acc["cur"] != "") & ~connects(s)
        return F.struct(
            F.when(over, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"), F.when(over | (acc["cur"] == ""), s).otherwise(F.concat(acc["cur"], F.lit(" "), s)).alias("cur"), F.when(over, w).otherwise(acc["n"] + w).alias("n"),
        )

    return F.aggregate(sentences, zero, step, lambda acc: F.when(acc["cur"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))))
