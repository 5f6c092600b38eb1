"""Layout of pages from words and recognition tokens: lines, paragraphs, where a text begins and ends."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tintero.functions.text import WHITE, rx
from tintero.operators.scanned_clean import OPINION
from tintero.runtime import checkpoint, hand_over

# Font sizes of notes and captions, and default margins in points.
NOTE_SIZES = [9.5, 8.5, 8.4, 7.9, 7.0, 6.5, 6.0, 5.5]
FONT = (10.5, 11.9)
HEADER_FIRST, HEADER, FOOTER, FOOTER_LAST = 100.0, 70.0, 85.0, 120.0


def body_words(words: DataFrame, left: float = 0.0, right: float = 0.0, font=FONT, exclude_bold: bool = False, start: DataFrame | None = None) -> DataFrame:
    """Words of the body: size in range and no note size, inside the margins.

    ``start`` (pdf_filename, start_page, start_top) drops what stands before it.
    """
    w = words
    header = F.when(F.col("page") == 1, F.lit(HEADER_FIRST)).otherwise(F.lit(HEADER))
    if start is not None:
        w = w.join(start, "pdf_filename", "left").where("start_page IS NULL OR page >= start_page")
        header = F.when(F.col("page") == F.col("start_page"), F.greatest(F.col("start_top") - 5, F.lit(0.0))).otherwise(header)
    footer = F.col("page_height") - F.when(F.col("page") == F.col("total_pages"), F.lit(FOOTER_LAST)).otherwise(F.lit(FOOTER))
    keep = F.col("size").between(*font) & ~F.bround("size", 1).isin(NOTE_SIZES) & (F.col("top") > header) & (F.col("top") < footer) & (F.col("x0") > left) & (F.col("x0") < F.col("page_width") - right)
    if exclude_bold:
        keep = keep & ~F.lower("fontname").contains("bold")
    return w.where(keep).select(*words.columns)


def lines(words: DataFrame) -> DataFrame:
    """Lines of a page by rounded height: text in reading order and the left edge."""
    g = words.groupBy("pdf_filename", "page", F.bround("top", 1).alias("top")).agg(F.array_sort(F.collect_list(F.struct("x0", "seq", "text"))).alias("x"))
    return g.select("pdf_filename", "page", "top", F.trim(F.array_join(F.transform("x", lambda s: s["text"]), " ")).alias("line"), F.element_at("x", 1)["x0"].alias("left"))


def opinion_start(words: DataFrame, veto_centred: bool = False) -> DataFrame:
    """(pdf_filename, start_page, start_top): first left-aligned opinion heading from the second page on, else (1, 0).

    ``veto_centred`` rejects a heading followed within 30 points by a centred line.
    """
    l = lines(words.where("page >= 2 AND size BETWEEN 11.0 AND 15.0"))  # noqa: E741
    hit = l.where((F.col("left") < 120) & F.col("line").rlike(rx("^(?:" + "|".join(OPINION[:2]) + ")")))
    if veto_centred:
        # The window looks at the lines of one page only.
        near = Window.partitionBy("pdf_filename", "page").orderBy(F.round(F.col("top") * 10).cast("long")).rangeBetween(1, 300)
        centred = l.withColumn("_c", F.max((F.col("left") >= 120).cast("int")).over(near)).select("pdf_filename", "page", "top", "_c")
        hit = hit.join(centred, ["pdf_filename", "page", "top"]).where("coalesce(_c, 0) = 0")
    first = hit.groupBy("pdf_filename").agg(F.min(F.struct("page", "top")).alias("m"))
    return words.select("pdf_filename").distinct().join(first, "pdf_filename", "left").select("pdf_filename", F.coalesce("m.page", F.lit(1)).alias("start_page"), F.coalesce("m.top", F.lit(0.0)).alias("start_top"))


def gap_sessions(df: DataFrame, group: list[str], order: list[str], value: Column, gap: float, absolute: bool = False) -> DataFrame:
    """Session numbers from 0: a new one starts where ``value`` is more than ``gap`` beyond the row before."""
    w = Window.partitionBy(*group).orderBy(*order)
    d = value - F.lag(value).over(w)
    jump = (F.abs(d) if absolute else d) > gap
    return df.withColumn("_j", F.coalesce(jump.cast("int"), F.lit(0))).withColumn("session", F.sum("_j").over(w)).drop("_j")


def word_paragraphs(words: DataFrame, gap: float = 15.0, absolute: bool = False) -> DataFrame:
    """Page text from words: a paragraph ends where the height jumps by more than ``gap``."""
    s = gap_sessions(words, ["pdf_filename", "page"], ["seq"], F.col("top"), gap, absolute)
    p = s.groupBy("pdf_filename", "page", "session").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("x")).select("pdf_filename", "page", "session", F.array_join(F.transform("x", lambda r: r["text"]), " ").alias("t"))
    g = p.groupBy("pdf_filename", "page").agg(F.array_sort(F.collect_list(F.struct("session", "t"))).alias("x"))
    return g.select("pdf_filename", "page", F.array_join(F.transform("x", lambda r: r["t"]), "\n\n").alias("text"))


def token_paragraphs(tokens: DataFrame, gap: float = 30.0) -> DataFrame:
    """Page text from recognition tokens (low confidence and blanks dropped).

    A line's break is measured from the line's own start, so tokens are walked
    in order, one page at a time (a page is a bounded group).
    """
    clean = tokens.where((F.col("conf") >= 0) & (F.trim("text") != ""))

    def page(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out, cur = [], None
        for r in pdf.sort_values("seq").itertuples(index=False):
            new = cur is not None and (r.line_num != cur["line"] or r.block_num != cur["block"] or abs(r.top - cur["top"]) > 0.5 * r.height)
            if cur is None or new:
                first = cur is None
                if new:
                    out.append(cur)
                cur = {"text": r.text.strip(), "top": r.top, "line": r.line_num, "block": r.block_num, "bottom": max(0, r.top + r.height) if first else r.top + r.height}
            else:
                cur["text"] += " " + r.text.strip()
                cur["bottom"] = max(cur["bottom"], r.top + r.height)
        if cur is not None:
            out.append(cur)
        parts: list[list[str]] = [[]]
        for i, l in enumerate(out):  # noqa: E741
            parts[-1].append(l["text"])
            if i + 1 < len(out) and out[i + 1]["top"] - l["bottom"] > gap:
                parts.append([])
        return pd.DataFrame([(key[0], key[1], "\n\n".join(" ".join(p) for p in parts if p).strip())], columns=["pdf_filename", "page", "text"])

    return clean.groupBy("pdf_filename", "page").applyInPandas(page, "pdf_filename string, page int, text string")


def before_annex(pages: DataFrame) -> DataFrame:
    """Pages up to an annex: a page opening with one stops the file, a line inside cuts its page and stops after it."""
    # The patterns of an annex that opens a page, and of one inside it.
    opens = F.col("text").rlike(rx(r"^\s*ANEXOS?(?:\s+(?:[IVXLCDM]+|\d+))?\s*:?", "i"))
    pos = F.regexp_instr("text", F.lit(rx(r"^ *Anexos?\b[\s\w]*:?", "mi"))) - 1
    h = pages.withColumns({"_o": F.coalesce(opens, F.lit(False)), "_p": pos})
    stop = hand_over(checkpoint(h.where("_o OR _p >= 0").groupBy("pdf_filename").agg(F.min("page").alias("_f"))))
    j = h.join(stop, "pdf_filename", "left").where("_f IS NULL OR page < _f OR (page = _f AND NOT _o)")
    t = F.when((F.col("page") == F.col("_f")) & (F.col("_p") >= 0), F.expr("rtrim(substring(text, 1, _p))")).otherwise(F.col("text"))
    return j.withColumn("text", t).where("_f IS NULL OR page < _f OR text != ''").drop("_o", "_p", "_f")


def parse_image_name(name: Column) -> tuple[Column, Column]:
    """(file name, page) of a cropped page image's name; page 1 where none is given."""
    stem = F.regexp_replace(F.regexp_replace(name, r"\.[^.]+$", ""), "_cropped", "")
    m = F.regexp_extract(stem, r"^(.+)_p(\d+)$", 1)
    return F.concat(F.when(m != "", m).otherwise(stem), F.lit(".pdf")), F.coalesce(F.nullif(F.regexp_extract(stem, r"^(.+)_p(\d+)$", 2), F.lit("")).cast("int"), F.lit(1))


def lateral_cuts(width: Column, dpi: int = 300, left_cm: float = 2.25, right_cm: float = 2.25) -> Column:
    """(x1, x2) of the side margins in pixels; the whole width where they cross."""
    a, b = F.lit(int(left_cm / 2.54 * dpi)), width - F.lit(int(right_cm / 2.54 * dpi))
    return F.when(a >= b, F.struct(F.lit(0).alias("x1"), width.alias("x2"))).otherwise(F.struct(a.alias("x1"), b.alias("x2")))


def footer_cut(rows: DataFrame, threshold: float, min_zone: int, max_cut: float = 0.95) -> DataFrame:
    """Cut height per page from row blackness: end of the last wide blank zone in the lower half above the last text row."""
    w = Window.partitionBy("page_id").orderBy("y")
    x = rows.withColumns({"blank": F.col("blackness") <= threshold, "_last": F.max(F.when(F.col("blackness") > threshold, F.col("y"))).over(Window.partitionBy("page_id"))})
    low = x.where((F.col("y") >= F.floor(F.col("height") * 0.5)) & (F.col("y") < F.col("_last")))
    isl = low.withColumn("_g", F.sum(F.when(F.col("blank"), 0).otherwise(1)).over(w))
    zones = isl.where("blank").groupBy("page_id", "_g").agg(F.min("y").alias("a"), (F.max("y") + 1).alias("b")).where(F.col("b") - F.col("a") >= min_zone)
    last = zones.groupBy("page_id").agg(F.max("b").alias("zone_end"))
    top = rows.groupBy("page_id").agg(F.max("height").alias("height"))
    cap = F.floor(F.col("height") * max_cut)
    return top.join(last, "page_id", "left").select("page_id", F.least(F.coalesce("zone_end", cap), cap).cast("int").alias("cut_y"))


def crop_totals(log: DataFrame) -> DataFrame:
    """Files, cropped files and pages of a crop log; failures have no pages."""
    return log.agg(F.count("*").alias("files"), F.sum("cropped").alias("cropped"), F.sum(F.coalesce("pages", F.lit(0))).alias("pages"))


def extracted(pages: DataFrame, min_chars: int = 20) -> DataFrame:
    """Files told apart by the length of their text layer, all pages one after the other, without blanks at its ends.

    Only lengths are moved, no texts: the layer reaches from the first to the last
    page that is not blank; blank pages between them count.
    """
    t = F.coalesce("text", F.lit(""))
    key = F.struct(F.coalesce("page", F.lit(-1)).alias("p"), F.xxhash64(t).alias("h"))
    size = F.length(t)
    p = pages.select("pdf_filename", key.alias("k"), size.alias("n"), (size - F.length(F.ltrim(t, F.lit(WHITE)))).alias("lead"), (size - F.length(F.rtrim(t, F.lit(WHITE)))).alias("tail"))
    full = F.col("lead") < F.col("n")
    ends = hand_over(checkpoint(p.groupBy(F.col("pdf_filename").alias("_f")).agg(F.min(F.when(full, F.struct("k", "lead"))).alias("a"), F.max(F.when(full, F.struct("k", "tail"))).alias("z"))))
    inside = F.when(F.col("k").between(F.col("a.k"), F.col("z.k")), F.col("n"))
    g = p.join(ends, F.col("pdf_filename").eqNullSafe(F.col("_f"))).groupBy("pdf_filename").agg(F.sum(inside).alias("n"), F.max("a.lead").alias("lead"), F.max("z.tail").alias("tail"))
    return g.select("pdf_filename", F.when(F.col("n") - F.col("lead") - F.col("tail") >= min_chars, "editable").otherwise("scanned").alias("pdf_type"))
