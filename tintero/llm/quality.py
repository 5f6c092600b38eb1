"""Problem 1: text statistics of each paragraph, and whether it is natural prose.

Method: statistics are native column expressions; an ordered rule list is
induced by incremental reduced-error pruning (grow on two thirds of the
labelled documents, prune on the rest) and exported as one SQL CASE expression
over the statistics, so that scoring a corpus stays inside the JVM.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tintero import runtime
from tintero.llm.labelled import documents
from tintero.runtime import bytes_of

#: Bound of the labelled set; induction takes seconds at this size.
LABELLED = 12000

_MARK = r"[-–—•·▪■●○◦*➢]|[0-9]{1,2}[.)]|[a-z][.)]|[ivx]{2,5}[.)]"

# Helpers and statistics as SQL templates; @ stands for a backslash inside a pattern.
_HELPERS = {
    "_lines": "filter(split(_t, '@n'), x -> x != '' AND trim(x) != '')",
    "_tok": "filter(split(_t, '@s+'), x -> x != '')",
}
_N = "length(array_join(_tok, ''))"  # marks that are no white space
_SHARE = "((length(_t) - length(regexp_replace(_t, '{kept}+', ''))) / greatest(" + _N + ", 1))"
_OF_LINES = "if(size(_lines) > 1, size(filter(_lines, x -> {test})) / size(_lines), 0D)"
STATS = {
    "n_chars": "length(_t)",
    "n_lines": "size(_lines)",
    "n_words": "size(_tok)",
    "mean_word": _N + " / greatest(size(_tok), 1)",
    "max_word": "coalesce(array_max(transform(_tok, x -> length(x))), 0)",
    "letter_share": _SHARE.format(kept="[@p{L}@p{M}]"),
    "latin_share": _SHARE.format(kept="[A-Za-zÀ-ÿ]"),
    "symbol_share": "length(regexp_replace(_t, '[@s@u00a0@u2000-@u200a@u202f@u3000@p{L}@p{M}@p{N}@p{Po}@p{Ps}@p{Pe}@p{Pi}@p{Pf}º°¹²³-]+', '')) / greatest(" + _N + ", 1)",
    "number_share": "size(filter(_tok, x -> x < ':' AND x RLIKE '^[-+(]?[0-9][0-9.,%]*[)]?$' OR x = 'n.d.' OR x = '-')) / greatest(size(_tok), 1)",
    "common_share": "size(filter(_tok, x -> lower(x) IN ({common}))) / greatest(size(_tok), 1)",
    "capital_share": "size(filter(_tok, x -> x != lower(x))) / greatest(size(_tok), 1)",
    "distinct_share": "size(array_distinct(_tok)) / greatest(size(_tok), 1)",
    "vowel_share": "length(regexp_replace(_t, '[^aeiouáéíóúüãõâêôAEIOUÁÉÍÓÚÜÃÕÂÊÔ]+', '')) / greatest(" + _N + ", 1)",
    "words_per_item": "size(_tok) / greatest(if(size(_lines) > 1 OR exists(_tok, x -> x IN ('-', '–', '—', '•', '·', '▪', '■', '●', '○', '◦', '*', '➢')), regexp_count(_t, '(?:^|@s)(?:{mark})@s'), 0), 0.1)",
    "item_line_share": _OF_LINES.format(test="x RLIKE '^@s*(?:{mark})@s'"),
    "cells_per_word": "regexp_count(_t, '@t|[^@s]  +[^@s]| [|;/>·] ') / greatest(size(_tok), 1)",
    "stops_per_100": "100 * regexp_count(_t, '[.!?।؟][»\")²³¹]*(?:@s|$)|[。！？]') / greatest(length(_t), 1)",
    "words_per_line": "size(_tok) / greatest(size(_lines), 1)",
    "early_break_share": "if(size(_lines) > 1, size(filter(sequence(1, size(_lines) - 1), i -> length(_lines[i - 1]) + 1 + length(substring_index(ltrim(_lines[i]), ' ', 1)) <= array_max(transform(_lines, y -> length(y))))) / (size(_lines) - 1), 0D)",
    "upper_line_share": "if(size(_lines) > 1, size(filter(slice(_lines, 2, size(_lines) - 1), x -> x RLIKE '^@p{Lu}')) / (size(_lines) - 1), 0D)",
    "ended_line_share": "size(filter(_lines, x -> x RLIKE '[.!?。！？।؟][»\")]*@s*$')) / greatest(size(_lines), 1)",
    "page_line_share": _OF_LINES.format(test="right(rtrim(x), 1) BETWEEN '0' AND '9' AND x RLIKE '(?:  |[.]{3}).*[0-9]@s*$'"),
    "short_line_share": "if(size(_lines) > 2, size(filter(_lines, x -> length(x) <= 24)) / size(_lines), 0D)",
    # The first pattern finds a run exactly where the second one does, in half its time.
    "run_share": "if(array_join(_tok, '') RLIKE '(.{1,4})@1@1@1@1@1', (" + _N + " - length(regexp_replace(array_join(_tok, ''), '(.{1,4}?)@1{5,}', ''))) / greatest(" + _N + ", 1), 0D)",
    "leaders": "if(instr(_t, '.....') > 0, regexp_count(_t, '[.]{5,}'), 0)",
}
#: Statistics that a rule reads only where its cheaper conditions hold: they are written into the CASE expression itself.
LAZY = ["words_per_item", "vowel_share", "stops_per_100", "letter_share", "symbol_share", "run_share"]
#: Statistics on which rules may be induced.
FEATURES = ["n_words", "letter_share", "symbol_share", "number_share", "common_share", "capital_share", "vowel_share", "run_share", "words_per_item", "item_line_share", "stops_per_100", "words_per_line", "early_break_share", "upper_line_share", "page_line_share", "short_line_share", "leaders"]


def common_words(spark: SparkSession, table: DataFrame | None) -> list[str]:
    """The words of the frequent-word table, a parameter whose bytes are bounded; a larger one is refused."""
    return [] if table is None else sorted({r["word"].lower() for r in listed_words(table) if r["word"]})


def listed_words(table: DataFrame) -> list:
    """The distinct rows (lang, word) of the frequent-word table."""
    rows = table.select("lang", "word").where("word IS NOT NULL").distinct()
    if bytes_of(rows) > runtime.HAND_OVER:
        raise ValueError(f"the table of frequent words must not exceed {runtime.HAND_OVER} bytes")
    return rows.collect()


def _sql(common: list[str]):
    """Fill a statistic's template."""
    quoted = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in common) or "''"
    return lambda e: e.replace("{common}", quoted).replace("{mark}", _MARK).replace("@", "\\\\")


def statistics(df: DataFrame, common: list[str], text_col: str = "text", names: list[str] | None = None, keep_arrays: bool = False) -> DataFrame:
    """``df`` with one column per statistic (or those of ``names``).

    Null text counts as empty.  The shares of lines are 0 where the text has too
    few lines.  Arrays and statistics are each made once, behind a generator, so that filters on them do
    not compute them again.  An input column named like a statistic (or like
    ``kind`` and ``is_prose``) is replaced by it.
    """
    sql = _sql(common)
    base = df.drop("_t", *_HELPERS).withColumn("_t", F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    base = base.select("*", F.inline(F.array(F.struct(*(F.expr(sql(e)).alias(k) for k, e in _HELPERS.items())))))
    picked = names or list(STATS)
    kept = [c for c in df.columns if c not in STATS and c not in _HELPERS and c not in ("_t", "kind", "is_prose")]
    arrays = ["_t", *_HELPERS] if keep_arrays else []
    return base.select(*(f"`{c}`" for c in kept), *arrays, F.inline(F.array(F.struct(*(F.expr(sql(STATS[k])).alias(k) for k in picked)))))


def _grow(x, y, rng):
    """Conditions (feature, sign, threshold) added by FOIL gain until no negative is covered."""
    mask, rule = np.ones(len(y), bool), []
    while mask.any() and (~y[mask]).any() and len(rule) < 6:
        p0, n0 = y[mask].sum(), (~y[mask]).sum()
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for f in range(x.shape[1]):
            v = x[mask, f]
            cuts = np.unique(v)
            if len(cuts) < 2:
                continue
            cuts = (cuts[1:] + cuts[:-1]) / 2
            if len(cuts) > 60:
                cuts = np.unique(np.quantile(cuts, np.linspace(0, 1, 60)))
            below = v[:, None] <= cuts[None, :]
            yp = y[mask]
            for sign, cover in (("<=", below), (">", ~below)):
                p, n = cover[yp].sum(0), cover[~yp].sum(0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (f, sign, float(cuts[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        mask &= _covers([best[1]], x)
    return rule


def _covers(rule, x):
    m = np.ones(len(x), bool)
    for f, sign, c in rule:
        m &= x[:, f] <= c if sign == "<=" else x[:, f] > c
    return m


def _prune(rule, x, y):
    """The prefix of the rule with the best (p - n) / (p + n) on the pruning set."""
    def worth(r):
        m = _covers(r, x)
        p, n = y[m].sum(), (~y[m]).sum()
        return (p - n) / max(p + n, 1)

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=worth) if rule else rule


def induce(x: np.ndarray, labels: np.ndarray, order=("junk", "table", "list"), seed: int = 3) -> list[tuple[str, list]]:
    """Ordered rule list; documents that no rule covers are prose."""
    rng, rules, left = np.random.default_rng(seed), [], np.ones(len(x), bool)
    for label in order:
        failed = 0
        while failed < 10:
            idx = rng.permutation(np.flatnonzero(left))
            if (labels[idx] == label).sum() < 5:
                break
            third = len(idx) // 3
            grow, prune = idx[third:], idx[:third]
            rule = _prune(_grow(x[grow], labels[grow] == label, rng), x[prune], labels[prune] == label)
            m = _covers(rule, x) & left if rule else np.zeros(len(x), bool)
            hits = (labels[m] == label).sum()
            if hits < 8 or hits < 0.985 * m.sum():
                failed += 1  # another split of the documents
                continue
            rules.append((label, rule))
            left &= ~m
    return rules


def to_case(rules, lazy: dict[str, str] | None = None) -> str:
    """The rule list as one SQL CASE expression over the statistics.

    A rule's conditions stand with the cheap ones first; statistics of ``lazy``
    are put in as expressions, which SQL evaluates only where it gets there.
    """
    lazy = lazy or {}
    cost = lambda f: LAZY.index(FEATURES[f]) + 1 if FEATURES[f] in LAZY else 0
    name = lambda f: lazy.get(FEATURES[f], FEATURES[f])
    when = " ".join("WHEN " + " AND ".join(f"{name(f)} {s} {c!r}D" for f, s, c in sorted(rule, key=lambda x: cost(x[0]))) + f" THEN '{label}'" for label, rule in rules)
    return f"CASE WHEN n_words = 0 THEN 'empty' {when} ELSE 'prose' END"


@lru_cache(8)
def _rules(key, common: tuple) -> list:
    spark = SparkSession.getActiveSession()
    rows = spark.createDataFrame(documents(LABELLED), "text string, label string")
    got = statistics(rows, list(common), "text", FEATURES).select("label", *FEATURES).toPandas()
    return induce(got[FEATURES].to_numpy(float), got["label"].to_numpy())


def prose_rules(spark: SparkSession, common: list[str]) -> list:
    """The induced rule list; documents that no rule covers are prose."""
    return _rules(spark.sparkContext.applicationId, tuple(common))


def prose_case(spark: SparkSession, common: list[str]) -> str:
    """CASE expression giving prose, list, table, junk or empty."""
    return to_case(prose_rules(spark, common))


def graded(df: DataFrame, common: list[str], text_col: str = "text") -> DataFrame:
    """``df`` with all statistics, ``kind`` and ``is_prose`` (null where there is no text)."""
    out = statistics(df, common, text_col).withColumn("kind", F.expr(prose_case(df.sparkSession, common)))
    return out.withColumn("is_prose", F.when(F.col("kind") != "empty", F.col("kind") == "prose"))


def kinds(df: DataFrame, common: list[str], text_col: str = "text") -> DataFrame:
    """``df`` with ``kind`` only: just the statistics that the rules ask for are computed, the costly ones where a rule gets to them."""
    rules = prose_rules(df.sparkSession, common)
    asked = {FEATURES[f] for _, rule in rules for f, _, _ in rule} | {"n_words"}
    sql = _sql(common)
    case = to_case(rules, {f: "(" + sql(STATS[f]) + ")" for f in LAZY})
    out = statistics(df, common, text_col, [f for f in STATS if f in asked and f not in LAZY], keep_arrays=True)
    return out.select(*(f"`{c}`" for c in out.columns if c not in STATS and c != "_t" and c not in _HELPERS), F.expr(case).alias("kind"))
