"""Problem 3: texts over a size limit cut into ordered, overlapping pieces.

Method: recursive bisection.  A text over its limit is cut at the strongest
natural boundary near its midpoint (paragraph, line, sentence, clause, word,
character cluster), halves still over the limit minus the overlap are cut
again, and each piece but the first is then prefixed with the overlap.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintero.llm.arrow import flat_map
from tintero.runtime import checkpoint, hand_over

# Boundaries from strong to weak; the cut falls after the match.
_LEVELS = [
    re.compile(r"\n[ \t]*\n\s*"),
    re.compile(r"\n\s*"),
    re.compile(r"[.!?…।؟]+[»”\"')\]²³¹]*\s+(?=[^\W_a-zà-ÿ]|[«“\"¿¡(])|[。！？][」』”）]*"),
    re.compile(r"[;:]\s+|[；：]"),
    re.compile(r",\s+|\s[—–-]\s|[，、,؛،]\s?"),
    re.compile(r"\s+"),
]
_JOINERS = "‌‍"


def _cluster_ok(text: str, at: int) -> bool:
    """A cut before ``at`` does not part a base character from its marks or joiners."""
    c = text[at]
    return not (unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Mc", "Me", "Cf") or text[at - 1] in _JOINERS or (c == "\n" and text[at - 1] == "\r") or "\U0001f3fb" <= c <= "\U0001f3ff" or c == "ำ")


def _cut(text: str, lo: int, hi: int) -> int:
    """Position of the strongest boundary near the middle of text[lo:hi], at least a quarter from either end."""
    mid, quarter = (lo + hi) // 2, max((hi - lo) // 4, 1)
    a, b = lo + quarter, hi - quarter
    for level in _LEVELS:
        best = min((m.end() for m in level.finditer(text, max(a - 40, lo), min(b + 1, hi)) if a <= m.end() <= b), key=lambda e: abs(e - mid), default=None)
        if best is not None:
            return best
    for d in range(quarter):
        for at in (mid - d, mid + d):
            if lo < at < hi and _cluster_ok(text, at):
                return at
    return max(mid, lo + 1)


def split(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Spans (start, end) of the pieces of ``text``.

    Every span is at most ``limit`` long; consecutive spans share ``overlap``
    characters (fewer only if the text before is shorter); the spans cover the
    text.  ``overlap`` is taken as at most half the limit.
    """
    if len(text) <= limit:
        return [(0, len(text))]
    overlap = max(0, min(overlap, limit // 2))
    core, stack, cores = limit - overlap, [(0, len(text))], []
    while stack:
        lo, hi = stack.pop()
        if hi - lo <= core:
            cores.append((lo, hi))
        else:
            at = _cut(text, lo, hi)
            stack += [(at, hi), (lo, at)]
    return [(max(0, lo - overlap) if lo else 0, hi) for lo, hi in cores]


def pieces(df: DataFrame, limits: DataFrame, id_col: str = "row_id", text_col: str = "text", kind_col: str = "source_type") -> DataFrame:
    """(id, piece_no from 1, n_pieces, start from 1, piece) of every row.

    ``limits`` has source_type, max_chars, overlap_chars; null or unlisted types
    use the row ``*``; a type listed twice takes the smaller limit.  Rows within
    their limit (and rows with no limit at all) come out as one piece; null text
    gives no piece, empty text one empty piece.  Short rows never enter Python.
    """
    kind = dict(df.dtypes)[id_col]
    lim = limits.where("source_type IS NOT NULL AND max_chars > 0").groupBy("source_type").agg(F.min(F.struct("max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars"))).alias("l"))
    lim = checkpoint(lim.select(F.col("source_type").alias("_limit_of"), F.struct(F.col("l.max_chars").cast("int").alias("m"), F.col("l.overlap_chars").cast("int").alias("o")).alias("_own")))
    star = lim.where("_limit_of = '*'").first()
    default = F.struct(*(F.lit(star["_own"][k] if star else None).cast("int").alias(k) for k in "mo"))
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(kind_col).alias("_kind")).where("_text IS NOT NULL")
    j = rows.join(hand_over(lim.where("_limit_of != '*'")), F.col("_kind") == F.col("_limit_of"), "left").withColumn("_l", F.coalesce("_own", default))
    base = j.select(F.col("_id").alias(id_col), F.col("_text").alias(text_col), "_l.m", "_l.o")
    over = (F.length(text_col) > F.col("m")) & F.col("m").isNotNull()

    def run(rows):
        for i, t, m, o in rows:
            spans = split(t, m, o)
            for n, (a, b) in enumerate(spans, 1):
                yield i, n, len(spans), a + 1, t[a:b]

    cut = flat_map(base.where(over), run, f"`{id_col}` {kind}, piece_no int, n_pieces int, start int, piece string")
    whole = base.where(~F.coalesce(over, F.lit(False))).select(id_col, F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(1).alias("start"), F.col(text_col).alias("piece"))
    return cut.unionByName(whole)
