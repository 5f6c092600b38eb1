"""Problem 6: lines repeated across one source's documents.

Method: PrefixSpan over sequences of line identifiers.  Level 1 finds the
frequent single lines of a source by distinct-document support.  The sequence of
a page is what is left of it then: its frequent lines in order.  Each further
level grows every frequent pattern by the line that follows its occurrence in
the sequence, counts the distinct documents of the grown patterns, and projects
the sequences onto the frequent ones, until no pattern is frequent any more; no
length is capped.  A pattern is a run of neighbours in a sequence (lines seen
rarely may stand between them on the page), so a sequence of k lines holds at
most k patterns of a length and the projected data never grow.  Lines that are
part of an occurrence of a frequent pattern are found and deleted.

How large the model is: a frequent line stands in a third of its source's
documents, so a source has at most three times as many frequent lines (and
patterns of a length) as a document of it has distinct lines on average.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tintero.functions.text import let
from tintero.llm.canonical import canonical, with_canonical
from tintero.runtime import checkpoint, hand_over

MIN_LETTERS = 25
MIN_DOCS = 3
MIN_SHARE = 1 / 3


def line_key(line: str) -> str:
    """How a line reads: letters and their marks only, lower case, look-alike differences aside."""
    return re.sub(r"[\W\d_]+", "", canonical(line).lower())


def source_of(file_col) -> Column:
    """Series of a file: its name before the first ``-`` or ``_``, lower-cased."""
    return F.lower(F.split(file_col, "[-_]", 2)[0])


def _letters(line: Column) -> Column:
    """The letters of a canonical line, with their marks."""
    return F.regexp_replace(line, r"[^\p{L}\p{M}]+", "")


def _key(letters: Column) -> Column:
    """Identifier of a line's letters, null if they are too few."""
    few = (F.length(letters) < MIN_LETTERS) | (letters.rlike(r"\p{M}") & (F.length(F.regexp_replace(letters, r"\p{M}+", "")) < MIN_LETTERS))
    return F.when(~few, F.xxhash64(F.lower(letters)))


def _source_documents(pages: DataFrame, file_col: str) -> DataFrame:
    """(src, source, need): sources by hash and name, and how many documents a pattern must stand in."""
    named = pages.where(F.col(f"`{file_col}`").isNotNull()).select(source_of(F.col(f"`{file_col}`")).alias("source"), F.xxhash64(F.col(f"`{file_col}`")).alias("doc")).distinct()
    g = named.groupBy("source").agg(F.count("*").alias("n_source_docs"))
    return g.select(F.xxhash64("source").alias("src"), "source", "n_source_docs", F.greatest(F.lit(MIN_DOCS), F.ceil(F.col("n_source_docs") / 3)).alias("need"))


def _lines(pages: DataFrame, id_col: str, file_col: str, text_col: str) -> DataFrame:
    """(id, page, src, doc, line_no, line): the lines with enough letters of pages of a source; ``page`` tells rows apart by id and content."""
    q = lambda c: F.col(f"`{c}`")
    rows = pages.where(q(file_col).isNotNull() & (q(text_col) != "")).select(q(id_col).alias("id"), F.xxhash64(q(id_col), q(file_col), q(text_col)).alias("page"), F.xxhash64(source_of(q(file_col))).alias("src"), F.xxhash64(q(file_col)).alias("doc"), q(text_col).alias("_t"))
    lines = with_canonical(rows, "_t", "_c").select("id", "page", "src", "doc", F.posexplode(F.split("_c", "\n", -1)).alias("n", "_line")).where(F.length("_line") >= MIN_LETTERS)
    # Behind generators, letters and identifier are computed once for each line.
    lines = lines.select("id", "page", "src", "doc", "n", F.inline(F.array(F.struct(_letters(F.col("_line")).alias("_w"))))).where(F.length("_w") >= MIN_LETTERS)
    return lines.select("id", "page", "src", "doc", (F.col("n") + 1).alias("line_no"), F.inline(F.array(F.struct(_key(F.col("_w")).alias("line"))))).where("line IS NOT NULL")


def _frequent(rows: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """(src, key, n_docs) of the keys with sufficient distinct-document support; rows are made distinct in the task first."""
    n = rows.select("src", key, "doc").distinct().groupBy("src", key).agg(F.count("*").alias("n_docs"))
    return n.join(docs.select("src", "need"), "src").where("n_docs >= need").drop("need")


class Patterns:
    """What the mining found: ``occurrences`` of frequent lines (id, page, src, doc, line_no, line), ``docs`` per source,
    and ``levels``, the frequent patterns (src, pattern, n_docs) of each length."""

    def __init__(self, pages: DataFrame, id_col: str, file_col: str, text_col: str):
        self.docs = hand_over(checkpoint(_source_documents(pages, file_col)))
        lines = _lines(pages, id_col, file_col, text_col)
        # How often a line stands bounds how many documents it stands in: one count per task and line is shuffled, and few lines are left.
        often = lines.groupBy("src", "line").agg(F.count("*").alias("n")).where(f"n >= {MIN_DOCS}")
        often = hand_over(checkpoint(often.join(self.docs, "src").where("n >= need").select("src", "line")))
        near = checkpoint(lines.join(often, ["src", "line"], "left_semi"))
        first = checkpoint(_frequent(near, self.docs, "line"))
        self.occurrences = near.join(hand_over(first.select("src", "line")), ["src", "line"], "left_semi")
        self.levels = [first.select("src", F.array("line").alias("pattern"), "n_docs")]
        self._grow()

    def _grow(self) -> None:
        """Levels from 2 on.  State: a page's sequence, and per position the identifier of the frequent pattern that ends there."""
        order = F.array_sort(F.collect_set(F.struct("line_no", "line")))
        pages = self.occurrences.groupBy("src", "doc", "page").agg(order.alias("x")).where("size(x) > 1")
        state = checkpoint(pages.select("src", "doc", F.transform("x", lambda s: s["line"]).alias("seq")).withColumn("h", F.col("seq")))
        while True:
            size = len(self.levels) + 1
            grown = F.transform("seq", lambda x, i: F.when((i > 0) & F.get("h", i - 1).isNotNull(), F.xxhash64(F.get("h", i - 1), x)))
            state = state.withColumn("h", grown).where("exists(h, x -> x IS NOT NULL)")
            ends = state.select("src", "doc", "seq", F.posexplode("h").alias("i", "key")).where("key IS NOT NULL")
            frequent = _frequent(ends, self.docs, "key")
            spelled = ends.join(hand_over(frequent := checkpoint(frequent)), ["src", "key"]).groupBy("src", "key").agg(F.min(F.slice("seq", F.col("i") + 2 - size, size)).alias("pattern"), F.first("n_docs").alias("n_docs"))
            spelled = checkpoint(spelled)
            if spelled.isEmpty():
                return
            self.levels.append(spelled.select("src", "pattern", "n_docs"))
            # Bounded per source (see the head of the module).
            known = hand_over(checkpoint(frequent.groupBy("src").agg(F.collect_set("key").alias("_known"))))
            kept = F.transform("h", lambda x: F.when(F.array_contains("_known", x), x))
            state = checkpoint(state.join(known, "src").select("src", "doc", "seq", kept.alias("h")).where("exists(h, x -> x IS NOT NULL)"))

    def elements(self) -> DataFrame:
        """(src, line): the lines of which frequent patterns are made."""
        out = self.levels[0]
        for level in self.levels[1:]:
            out = out.unionByName(level)
        return out.select("src", F.explode("pattern").alias("line")).distinct()


def repeated_lines(pages: DataFrame, id_col: str = "page_id", file_col: str = "pdf_filename", text_col: str = "text") -> DataFrame:
    """(id, line_no, line) of lines that are part of an occurrence of a frequent sequence.

    Null or empty text has none; rows with a null file name have no source and
    take no part; a row that is repeated gives its lines again.
    """
    p = Patterns(pages, id_col, file_col, text_col)
    found = p.occurrences.join(hand_over(checkpoint(p.elements())), ["src", "line"], "left_semi")
    return found.select(F.col("id").alias(id_col), "line_no", "line")


def without_repeated(pages: DataFrame, id_col: str = "page_id", file_col: str = "pdf_filename", text_col: str = "text") -> DataFrame:
    """(id, text, lines_removed): each page's text with all occurrences of frequent sequences deleted.

    Null text stays null, pages without such lines stay as they are.  Texts are
    not shuffled: each meets the frequent lines of its own source, a bounded list.
    """
    q = lambda c: F.col(f"`{c}`")
    p = Patterns(pages, id_col, file_col, text_col)
    lists = hand_over(checkpoint(p.elements().groupBy("src").agg(F.collect_set("line").alias("_freq"))))
    rows = pages.select(q(id_col).alias("_id"), q(text_col).alias("_t"), F.xxhash64(F.coalesce(source_of(q(file_col)), F.lit(""))).alias("src"), q(file_col).isNull().alias("_none"))
    j = with_canonical(rows, "_t", "_c").join(lists, "src", "left")
    gone = F.when(F.col("_freq").isNotNull() & ~F.col("_none"), F.transform(F.split("_c", "\n", -1), lambda x: F.when(F.length(x) >= MIN_LETTERS, let(_letters(x), lambda w: F.coalesce(F.array_contains("_freq", _key(w)), F.lit(False)))).otherwise(False)))
    j = j.select("_id", "_t", F.inline(F.array(F.struct(gone.alias("_gone")))))
    n = F.coalesce(F.size(F.filter("_gone", lambda x: x)), F.lit(0))
    kept = F.array_join(F.filter(F.split("_t", "\n", -1), lambda x, i: ~F.get("_gone", i)), "\n")
    text = F.when(F.col("_t").isNotNull() & (n > 0), F.regexp_replace(F.regexp_replace(kept, "\n{3,}", "\n\n"), r"^\n+|\n+\z", "")).otherwise(F.col("_t"))
    return j.select(F.col("_id").alias(id_col), text.alias("text"), F.when(F.col("_t").isNull(), 0).otherwise(n).cast("int").alias("lines_removed"))


def frequent_sequences(pages: DataFrame, id_col: str = "page_id", file_col: str = "pdf_filename", text_col: str = "text") -> DataFrame:
    """(source, pattern, n_docs, n_source_docs): all frequent sequences, of any length, with their document support."""
    p = Patterns(pages, id_col, file_col, text_col)
    out = p.levels[0]
    for level in p.levels[1:]:
        out = out.unionByName(level)
    return out.join(p.docs, "src").select("source", "pattern", "n_docs", "n_source_docs")
