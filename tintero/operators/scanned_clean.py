"""Cleaning of page texts from scanned files: staged rules, some over a whole file's pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tintero.functions.text import capitals, chain, has, let, letters, put, rx, strip, where, word_count, word_list
from tintero.operators.clean import is_label
from tintero.runtime import checkpoint, hand_over

# Words after which a sentence goes on.
CONTINUES = "de del la el los las un una en con por para sobre al a ante bajo hacia mediante según tras entre sin desde hasta y e o u no".split()
# The rules as (pattern, replacement, flags), in the order in which they apply.
PRELIMINARY = [
    (r"^[Ii]nforme\s+N[*°º]?\s*\d{3,4}[-\s]*\d{4}[-\s]*CF\s+", "", "i"), (r" +([<>;:?!,.\)\]\}])", "$1", ""), (r"([\(\[\{]) +", "$1", ""), (r"(?<!\n) {2,}(?!\n)", " ", ""), (r" +\n", "\n", ""), (r"\n +", "\n", ""),
]
# A break before lower case (every connecting word is), a year, a number sign with its number, or an ellipsis; then one before a number,
# which takes the blanks after it along.
BREAKS = [(r"\n\n(?=[a-záéíóúñü]|[12]\d{3}|N[*°\s]?\d|…|\.\.\.)", " ", ""), (r"\n\n(\d+[,.]?\d*\s*(?:por\s+ciento|%)?)", " $1", "")]
HEADINGS = [
    r"^[IVXLH]{1,4}\.?\s*[-—]?\s*Conclusiones?(?:\s+y\s+recomendaciones)?$", r"^Conclusiones?(?:\s+y\s+recomendaciones)?$", r"^[IVXLH]{1,4}\.?\s*[-—]?\s*Riesgos?$", r"^Riesgos?$", r"^[IVXLH]{1,4}\.?\s*[-—]?\s*Antecedentes?$", r"^Antecedentes?$", r"^[IVXLH]{1,4}\.?\s*[-—]?\s*Introducción$", r"^Introducción$",
]
OPINION = ["Opinión del Consejo Fiscal", "Opinión del CF", "Opinión de CF"]
OPINION_LEAD = r"""(?:(?:\d+|[a-zA-Z]+)\.?\s*[—\-]?\s*)?['"]?\s*"""
ANNEX = [r"ANEX[O0]S?\s*:?", r"Anex[o0]\s*:?", r"AN\s*EX[O0]S?\s*:?"]
LETTER_PAGE = r"Carta\s+N[*°º]?\s*\d"
SIGNED_DATES = [
    (r"Lima,\s+\d{1,2}\s+de\s+\w+\s+de\s+\d{4}[^A-Z]*\n\n[A-ZÁÉÍÓÚÑ\s]+(?:Presidente|PRESIDENTE)[^\n]*", "", "i"),
    (r"Lima,\s+\d{1,2}\s+de\s+\w+\s+de\s+\d{4}[^.]*?[A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ\s]{10,}$", "", "mi"),
]
SHORT_NOISE = [
    r"^\d+\s*/\s*\d+$", r"^Lima,\s+\d+\s+de\s+\w+\s+de\s+\d{4}.*$", r"^Informe\s+N[*°º]?\s*\d{3,4}[-\s]*CF[\s.]*$", r"^PRESIDENTE\s+DEL\s+CONSEJO\s+FISCAL[\s.]*$", r"^Presidente\s+(?:del\s+)?Consejo\s+Fiscal[\s.]*$", r"^Conclusiones?\s*:?[\s.]*$", r"^ANEXO\s*:?[\s.]*$",
]
LEFTOVERS = [(r"\s*\(\s*\)", "", ""), (r"\s*\[\s*\]", "", ""), (r"[*]{2,}", "", ""), (r"[?]{2,}", "?", ""), (r"[!]{2,}", "!", ""), (r"[_|]+", "", ""), (r" {2,}", " ", "")]
_W = "([a-záéíóúñ]+)"
FINAL = [
    (_W + r"\?\d+", "$1", "i"), (_W + r"\?{2,}", "$1", "i"), (_W + r"\?(?=\s+[a-záéíóúñ])", "$1", "i"), (_W + r"""\?(?=["'\-\*,.:;])""", "$1", "i"), (r"(?<!¿)" + _W + r"\?(?=\s*[\n])", "$1", "i"), (_W + r"""\?(?=[°º\*"'\-\s]+[a-záéíóúñA-ZÁÉÍÓÚÑ])""", "$1", "i"), (_W + r"\?([a-záéíóúñ])\b", "$1$2", "i"), (_W + r"""\?(?=["'])""", "$1", "i"), (_W + r"\?(?=-)", "$1", "i"),
]
_AFTER = "(?<=[a-záéíóúñ])"
STUCK = [(_AFTER + r"[<>°º£¿\-—\s]*[<>°º£¿\-—]+", "", "i")]
FINAL_SIGNS = [(r"\s+[<>°º£¿\-—]{2,}\s+", " ", ""), (_AFTER + r"[%<>°º£¿*]+(?=\s|$)", "", "i")]
FINAL_TAIL = [
    (r"\s+[ÁÉÍÓÚ]\s+", " ", ""), (r"\n\n[A-HJ-UWYZÁÉÍÓÚÑ]\s+([a-záéíóúñ]\w+)", "\n\n$1", ""), (r"[><\|^~]+", "", ""), (r"(\d{4})\s*-\s+(\d{4})", "$1-$2", ""), (r"(\d+)\s*-\s+(\d{4})", "$1-$2", ""), (r" {2,}", " ", ""), (r"\s+[.,;:]\s+", " ", ""), ("�+", "", ""), (r"\s+\)", ")", ""), (r"\(\s+", "(", ""), (r"\.([!?]+)(?=\n\n|$)", ".", ""),
]


def preliminary(col: Column) -> Column:
    """Stage 0: document id at the start, spaces around punctuation and line ends."""
    return strip(chain(col, PRELIMINARY))


# Fixed values, here and below: lengths, counts and inline patterns of the rules.
def is_heading(t: Column) -> Column:
    """A heading in scanned text: short, opens with a capital, digit or numeral, ends in no continuing word; short sentences count too."""
    def by_words(words):
        n = F.size(words)
        last = F.regexp_replace(F.lower(F.element_at(words, -1)), r"[.,;:!?]+$", "")
        return n.between(1, 34) & ~F.coalesce(last.isin(CONTINUES), F.lit(False)) & (~t.rlike(r"\.\s*$") | (n < 8) | t.rlike(r"[!?]\.\s*$"))

    opens = t.rlike(r"^[\p{Lu}\p{Nd}]") | has(t, r"^[ivxlcdmh]+\s*[.—\-:]", "i")
    return (F.length(t) < 200) & opens & ~has(t, r"^Lima,?\s+\d{1,2}\s+de") & ~t.startswith("El presente informe") & let(word_list(t), by_words)


def join_false_breaks(col: Column) -> Column:
    """Stage 4: breaks before lower case, years, connectors and numbers, and after a continuing word before a capital."""
    # The last word, if it is as short as the continuing words are.
    last = lambda s: F.lower(F.regexp_extract(F.right(F.concat(F.lit(" "), s), F.lit(12)), r"(?U)\s(\S+)$", 1))

    def fold(acc, s):
        # The paragraph being built is kept apart from the finished ones, so that nothing is copied for each.
        joins = (acc["cur"] != "") & s.rlike(r"^\p{Lu}") & last(acc["cur"]).isin(CONTINUES)
        return F.struct(
            F.when(joins | (acc["cur"] == ""), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))).alias("done"), F.when(joins, F.concat(acc["cur"], F.lit(" "), s)).otherwise(s).alias("cur"),
        )

    def joined(t):
        parts = F.filter(F.transform(F.split(t, "\n\n"), strip), lambda s: s != "")
        zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))
        whole = F.aggregate(parts, zero, fold, lambda a: F.when(a["cur"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"]))))
        return F.array_join(whole, "\n\n")

    return F.when(col.contains("\n\n"), let(chain(col, BREAKS), joined)).otherwise(strip(col))


def drop_headings(col: Column) -> Column:
    """Stage 5: headings standing alone.

    A break closes one paragraph and opens the next, so of the inner paragraphs
    every second one is examined, then the first; the last never is.
    """
    any_heading = "|".join(f"(?:{h})" for h in HEADINGS)

    def head(p):
        return let(strip(p), lambda t: (t != "") & (is_heading(t) | is_label(t) | has(t, any_heading, "i")))

    def drop(parts):
        kept = F.filter(parts, lambda p, i: ~(((i % 2) == 1) & (i < F.size(parts) - 1) & head(p)))
        return let(kept, lambda k: F.when((F.size(k) > 1) & head(F.element_at(k, 1)), F.slice(k, 2, F.greatest(F.size(k) - 1, F.lit(1)))).otherwise(k))

    return F.array_join(let(F.split(col, "\n\n"), drop), "\n\n")


def noise_reason(p: Column) -> Column:
    """Stage 6: why a paragraph is noise (null where it is kept)."""
    short = F.length(p) < 100
    n, n_letters = word_count(p), letters(p)
    shouting = short & (n_letters > 10) & (capitals(p) > 0.6 * n_letters)
    keyword = F.lower(p).rlike("presidente|consejo|fiscal")
    name_like = n.between(2, 6) & F.forall(word_list(p), lambda w: w.rlike(r"^(?:\p{Lu}|[^\p{L}])"))
    exact = F.lit(False)
    for pat in SHORT_NOISE:
        exact = exact | has(p, pat, "i")
    return (
        F.when(p.contains("/") & (has(p, r"\d+/\d+\s+Av\.\s+") | has(p, r"PRESIDENTE\s+DEL\s+CONSEJO\s+FISCAL.*?\d+/\d+.*?Av\.", "i")), "signature_address")  # fixed patterns
        .when(short & exact, "exact_noise").when(F.length(p) < 30, "too_short").when(shouting & (keyword | name_like), "capitals").when(short & has(p, r"^[A-ZÁÉÍÓÚÑ\s]{15,}[\?%<>°º\*\s]*$"), "name_garbage")
    )


def drop_noise(col: Column) -> Column:
    """Stage 6: signature dates, noise paragraphs and leftover marks."""
    kept = F.transform(F.filter(noise_parts(col), lambda p: noise_reason(p).isNull()), lambda p: strip(where(p, p.rlike(r"[(\[*?!_|]|  "), LEFTOVERS)))
    return F.array_join(F.filter(kept, lambda p: p != ""), "\n\n")


def noise_parts(col: Column) -> Column:
    """The paragraphs that stage 6 judges: signature dates gone, trimmed, none empty."""
    dated = where(col, has(col, "lima,", "i"), SIGNED_DATES)
    return F.filter(F.transform(F.split(dated, "\n\n"), strip), lambda p: p != "")


def final_touch(col: Column, join_hyphens: bool = True) -> Column:
    """Stage 7: question marks of footnotes, stray symbols, spacing.  ``join_hyphens`` keeps the rule that also deletes hyphens after words."""
    asked = where(col, col.contains("?"), FINAL)  # those rules all need the mark
    return let(let(asked, lambda t: where(t, t.rlike("[%<>°º£¿*—-]"), [*(STUCK if join_hyphens else []), *FINAL_SIGNS])), lambda t: chain(t, FINAL_TAIL))


def from_opinion(pages: DataFrame) -> DataFrame:
    """Stage 1: from the second page on, the first page with an opinion heading after its opening opens the text.

    Pages before it are dropped and its own text is cut at the heading; files
    without such a page keep all pages.  Only each pattern's first match counts.
    """
    at = None
    for k in OPINION:
        p = F.regexp_instr("text", F.lit(rx(r"\n\n\s*" + OPINION_LEAD + k))) - 1
        at = F.when(p > 200, p) if at is None else F.coalesce(at, F.when(p > 200, p))
    hit = pages.withColumn("_at", F.when(F.col("page") >= 2, at))
    firsts = hand_over(checkpoint(hit.where("_at IS NOT NULL").groupBy("pdf_filename").agg(F.min("page").alias("_first"))))
    j = hit.join(firsts, "pdf_filename", "left").where("_first IS NULL OR page >= _first")
    return j.withColumn("text", F.when((F.col("page") == F.col("_first")) & F.col("_at").isNotNull(), F.expr("substring(text, _at + 1)")).otherwise(F.col("text"))).drop("_at", "_first")


def without_annexes(pages: DataFrame) -> DataFrame:
    """Stage 2: everything from the first annex heading of a file on is dropped."""
    cut = None  # -1: the page opens with it; otherwise its position
    for p in ANNEX:
        start = F.when(has(F.col("text"), r"^[\s\n]*" + p, "i"), F.lit(-1))
        pos = F.regexp_instr("text", F.lit(rx(r"\n\n\s*" + p, "i"))) - 1
        one = F.coalesce(start, F.when(pos >= 0, pos))
        cut = one if cut is None else F.coalesce(cut, one)
    hit = pages.withColumn("_cut", cut)
    firsts = hand_over(checkpoint(hit.where("_cut IS NOT NULL").groupBy("pdf_filename").agg(F.min("page").alias("_first"))))
    j = hit.join(firsts, "pdf_filename", "left").where("_first IS NULL OR page < _first OR (page = _first AND (_cut IS NULL OR _cut >= 0))")
    t = F.when((F.col("page") == F.col("_first")) & F.col("_cut").isNotNull(), F.expr("substring(text, 1, _cut)")).otherwise(F.col("text"))
    return j.withColumn("text", t).where("_first IS NULL OR page < _first OR trim(text) != ''").drop("_cut", "_first")


def without_letters(pages: DataFrame) -> DataFrame:
    """Stage 3: pages that hold a letter's number are dropped; null text is kept."""
    return pages.where(~F.coalesce(has(F.col("text"), LETTER_PAGE, "i"), F.lit(False)))


def stage(df: DataFrame, fn) -> DataFrame:
    return put(df, "text", let(F.col("text"), fn))


def clean_scanned(pages: DataFrame) -> DataFrame:
    """All stages in their order (0-5, 4, 6, 4, 7, 4, 5, 4); pages left empty are dropped after stage 6."""
    p = without_letters(without_annexes(from_opinion(stage(pages, preliminary))))
    for fn in (join_false_breaks, drop_headings, join_false_breaks, drop_noise):
        p = stage(p, fn)
    p = p.where("text IS NULL OR trim(text) != ''")
    for fn in (join_false_breaks, final_touch, join_false_breaks, drop_headings, join_false_breaks):
        p = stage(p, fn)
    return p


def removals(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Audit of stage 6: one row per paragraph judged noise, with its reason and measures."""
    x = pages.select(id_col, "pdf_filename", "page", F.posexplode(noise_parts(F.col("text"))).alias("pos", "paragraph"))
    x = put(x, "reason", noise_reason(F.col("paragraph"))).where("reason IS NOT NULL")
    return x.withColumns({"char_count": F.length("paragraph"), "word_count": word_count(F.col("paragraph")), "caps_ratio": F.when(letters(F.col("paragraph")) > 0, capitals(F.col("paragraph")) / letters(F.col("paragraph"))).otherwise(0.0)})


def removals_by_reason(audit: DataFrame, examples: int = 5) -> DataFrame:
    """Per reason: count, characters and the first examples; only the examples are gathered, never a whole reason."""
    w = Window.partitionBy("reason").orderBy("page_id", "pos")
    firsts = audit.withColumn("r", F.row_number().over(w)).where(F.col("r") <= examples).groupBy("reason").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "paragraph"))), lambda s: s["paragraph"]).alias("examples"))
    return audit.groupBy("reason").agg(F.count("*").alias("n"), F.sum("char_count").alias("chars")).join(firsts, "reason")


def removals_by_file(audit: DataFrame) -> DataFrame:
    return audit.groupBy("pdf_filename").agg(F.count("*").alias("n"), F.sum("char_count").alias("chars"))


def longest_removal(audit: DataFrame) -> DataFrame:
    """The longest removed paragraph, the earliest of equals."""
    return audit.agg(F.max_by(F.struct("page_id", "pos", "paragraph", "reason"), F.struct("char_count", -F.col("page_id"), -F.col("pos"))).alias("x")).select("x.*")


def removal_summary(audit: DataFrame, day: str | None = None) -> DataFrame:
    """One row: totals, a map by reason with its examples, a list by file, the longest removal, and the day; nested, for JSON.

    The list by file has one entry per file of the audit.
    """
    per_reason = removals_by_reason(audit).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", F.struct("n", "chars", "examples"))))).alias("by_reason"))
    per_file = removals_by_file(audit).agg(F.array_sort(F.collect_list(F.struct("pdf_filename", "n", "chars"))).alias("by_pdf"))
    total = audit.agg(F.count("*").alias("total_removals"), F.coalesce(F.sum("char_count"), F.lit(0)).alias("total_chars_removed"))
    longest = longest_removal(audit).agg(F.first(F.struct("*")).alias("longest_removed"))
    # One row on every side.
    return total.join(per_reason).join(per_file).join(longest).withColumn("generation_date", F.lit(day) if day else F.current_date().cast("string"))
