"""Link tables of detail pages: which file a page offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that mark a presentation, and words that mark the wanted kinds of document.
PRESENTATION = ["ppt", "presentacion", "presentación", "diapositiva", "slides", "conferencia", "powerpoint"]
WANTED = ["comunicado", "informe", "nota", "reporte", "documento", "pronunciamiento"]


def is_presentation(col: Column) -> Column:
    """Whether a text or address names a presentation; null and empty do not."""
    t = F.lower(F.coalesce(col, F.lit("")))
    out = F.lit(False)
    for k in PRESENTATION:
        out = out | t.contains(k)
    return out


def link_score(href: Column) -> Column:
    """How many of the wanted words an address holds."""
    return sum((F.lower(href).contains(k).cast("int") for k in WANTED), F.lit(0))


def extract_links(df: DataFrame, html_col: str = "html") -> DataFrame:
    """One row per anchor whose address holds ``.pdf``: pos (from 0), href, label."""
    anchors = F.regexp_extract_all(html_col, F.lit(r"(?is)<a\b[^>]*?href\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a>"), F.lit(0))
    x = df.select(*[c for c in df.columns if c != html_col], F.posexplode(anchors).alias("pos", "_a"))
    href = F.regexp_extract("_a", r"(?is)href\s*=\s*[\"']([^\"']*)[\"']", 1)
    label = F.regexp_replace(F.regexp_replace(F.regexp_extract("_a", r"(?is)<a\b[^>]*>(.*?)</a>", 1), r"<[^>]*>", ""), r"(?U)^\s+|\s+$", "")
    return x.withColumns({"href": href, "label": label}).where(F.lower("href").contains(".pdf")).drop("_a")


def best_link(links: DataFrame, key: str = "page_url", pos: str = "pos") -> DataFrame:
    """The chosen link per page: no presentation if any other remains, most wanted words, first of equals."""
    rank = F.struct((~(is_presentation(F.col("href")) | is_presentation(F.col("label")))).cast("int").alias("a"), link_score(F.col("href")).alias("b"), (-F.col(pos)).alias("c"))
    return links.groupBy(key).agg(F.max_by(F.struct("href", "label"), rank).alias("x")).select(key, "x.href", "x.label")


def resolve_url(html: Column) -> Column:
    """Address of the file a page embeds: iframe, a viewer's ``url`` parameter, or a download button."""
    frame = F.regexp_extract(html, r"(?is)<iframe\b[^>]*?src\s*=\s*[\"']([^\"']*)[\"']", 1)
    direct = F.when(F.lower(frame).contains(".pdf") & ~F.lower(frame).contains("docs.google.com"), absolute(frame))
    viewer = F.when(F.lower(frame).contains("docs.google.com"), F.try_url_decode(F.nullif(F.regexp_extract(frame, r"[?&]url=([^&]*)", 1), F.lit(""))))
    button = F.regexp_extract(html, r"(?is)<a\b[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>\s*(?:<button\b[^>]*id\s*=\s*[\"']downloadButton[\"']|<span\b[^>]*>\s*Guardar)", 1)
    return F.coalesce(direct, viewer, F.nullif(button, F.lit("")))


def absolute(url: Column) -> Column:
    """Protocol-relative addresses get https."""
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)


def file_of(url: Column) -> Column:
    """Last part of an address."""
    return F.element_at(F.split(url, "/"), -1)


def list_rows_from_html(df: DataFrame, html_col: str = "html") -> DataFrame:
    """Rows of a listing page (date, doc_title, page_url), in order; rows without a link are skipped."""
    rows = F.regexp_extract_all(html_col, F.lit(r"(?is)<tr\b[^>]*>.*?</tr>"), F.lit(0))
    x = df.select(*[c for c in df.columns if c != html_col], F.posexplode(rows).alias("pos", "_r"))
    text = lambda p: F.regexp_replace(F.regexp_replace(F.regexp_extract("_r", p, 1), r"<[^>]*>", ""), r"(?U)^\s+|\s+$", "")
    out = x.withColumns({
        "date": text(r"(?is)<td\b[^>]*class\s*=\s*[\"'][^\"']*size100[^\"']*[\"'][^>]*>.*?<p\b[^>]*>(.*?)</p>"), "doc_title": text(r"(?is)<td\b[^>]*>[^<]*(?:<(?!/td|a\b)[^>]*>[^<]*)*<a\b[^>]*>(.*?)</a>"), "page_url": F.regexp_extract("_r", r"(?is)<a\b[^>]*?href\s*=\s*[\"']([^\"']*)[\"']", 1),
    })
    return out.where("page_url != ''").drop("_r")
