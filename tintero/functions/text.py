"""Column helpers for text: the regular-expression dialect and small scalar functions.

All rules assume Unicode classes and Unix line ends; ``rx`` adds the flags that
make Java's engine read a pattern so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the characters that Unicode counts as white space.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def rx(pattern: str, flags: str = "") -> str:
    """``pattern`` with Unicode character classes, Unix lines and further flags (i, m, s)."""
    if "i" in flags and "u" not in flags:
        flags += "u"
    return f"(?Ud{flags})" + pattern


def let(col: Column, fn) -> Column:
    """``fn`` of a column that is computed once, however often ``fn`` names it."""
    return F.element_at(F.transform(F.array(col), lambda x: fn(x)), 1)


def put(df: DataFrame, name: str, col: Column) -> DataFrame:
    """``df`` with a column computed once per row, behind a generator: neither filters on it nor columns made from it compute it again."""
    out = df.select(*[f"`{c}`" for c in df.columns if c != name], F.inline(F.array(F.struct(col.alias(name)))))
    return out.select(*[f"`{c}`" for c in df.columns], *([] if name in df.columns else [name]))


def sub(col: Column | str, pattern: str, to: str = "", flags: str = "") -> Column:
    """Replace all matches."""
    return F.regexp_replace(col, rx(pattern, flags), to)


def chain(col: Column, rules) -> Column:
    """Apply (pattern, replacement, flags) one after the other."""
    for pattern, to, flags in rules:
        col = sub(col, pattern, to, flags)
    return col


def where(col: Column, test: Column, rules) -> Column:
    """The rules on texts that pass a cheap test, without which none of them can match."""
    return F.when(test, chain(col, rules)).otherwise(col)


def has(col: Column, pattern: str, flags: str = "") -> Column:
    return col.rlike(rx(pattern, flags))


def strip(col: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(col, F.lit(WHITE))


def word_list(col: Column) -> Column:
    """Words parted by white space; none for blank text."""
    return F.filter(F.split(col, r"(?U)\s+"), lambda w: w != "")


def word_count(col: Column) -> Column:
    return F.size(word_list(col))


def letters(col: Column) -> Column:
    """Number of letters."""
    return F.length(F.regexp_replace(col, r"[^\p{L}]", ""))


def capitals(col: Column) -> Column:
    """Number of upper-case letters."""
    return F.length(F.regexp_replace(col, r"[^\p{Lu}]", ""))


def paragraphs(col: Column) -> Column:
    """Non-blank paragraphs of a text, trimmed; paragraphs are parted by an empty line."""
    return F.filter(F.transform(F.split(col, "\n\n"), strip), lambda p: p != "")


def dedupe_key(col: Column) -> Column:
    """Key under which texts count as the same: trimmed, lower case."""
    return F.md5(F.lower(F.trim(col)))


def parse_date(col: Column) -> Column:
    """Dates as scraped: ISO, day first with slashes or dashes, two-digit years, or with a Spanish month name."""
    t = F.lower(F.regexp_replace(F.trim(col), r"\s+", " "))
    # Spanish month names.
    months = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()
    named = F.regexp_replace(t, r"^(\d{1,2}) de (\p{L}+) de(?:l)? (\d{4})$", "$1/$2/$3")
    named = F.regexp_replace(named, "setiembre", "septiembre")
    for i, m in enumerate(months, 1):
        named = F.regexp_replace(named, f"/{m}/", f"/{i}/")
    tries = [(t, "yyyy-M-d"), (named, "d/M/yyyy"), (named, "d/M/yy"), (named, "d-M-yyyy"), (named, "d.M.yyyy")]
    ok = {"yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}", "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yy": r"^\d{1,2}/\d{1,2}/\d{2}$", "d-M-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$", "d.M.yyyy": r"^\d{1,2}\.\d{1,2}\.\d{4}$"}
    return F.coalesce(*(F.when(c.rlike(ok[f]), F.try_to_timestamp(F.regexp_extract(c, ok[f], 0), F.lit(f)).cast("date")) for c, f in tries))
