"""Problem 2: values cut short on loading.

Method: a backward character n-gram model.  For the last characters before
every position of every text it counts how often the text ends there and how
often it goes on; a value is suspected where the log-odds of ending, given its
own last characters, fall under a threshold of its language and column.  Counts
are kept in hashed tables of fixed size, so the model does not grow with the
corpus.  Headings, lists, tables and junk among the suspects are set aside by
their own rules.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintero.llm import quality
from tintero.llm.arrow import flat_map

ORDERS = (8, 4)
#: Size of each hashed table as powers of two, from the smallest up to which it grows with the corpus; with all languages the
#: model has at most LANGS x ORDERS x 2^20 entries.
BITS = (18, 20)
#: Values up to which the smallest table is taken; four times as many double it.
ROWS = 2_000_000
#: Contexts seen less often than this are left to the shorter order.
SUPPORT = 12
#: Log-odds under which a value of a column is suspected, above the language's own rate of ending anywhere.
ABOVE_RATE = {"text": 2.0, "page_range": 3.0}

_MARK = re.compile(r"(?:…|\.\.\.|\[…\]|\[\.\.\.\]|\(…\)|�|&#?\w{0,8})\s*$")
#: A character cut in two: the stop lies inside it, whatever stands before.
_BROKEN = re.compile(r"(?:�|&#?\w{1,8})\s*$")
#: Ends of texts that are closed, or cut by their own mark: no votes for a heading's first word.
_NO_VOTE = r"(?:[.!?:;。！？।؟»”\"')\]²…�]|[\[(](?:…|\.\.\.)[\])]|&#?\w{0,8})\s*$"
_CLOSED = re.compile(r"[.!?:;。！？।؟»”\"')\]）」²³¹][\s​-‍﻿]*$")
_SCRIPTS = [("zh", "一", "鿿"), ("th", "฀", "๿"), ("hi", "ऀ", "ॿ"), ("ar", "؀", "ۿ"), ("ko", "가", "힯"), ("ru", "Ѐ", "ӿ"), ("el", "Ͱ", "Ͽ")]
_KANA = re.compile("[぀-ヿ]")
_FAR = re.compile("[Ͱ-᳿\u2c80-\ud7ff豈-\ufaff]")


def language(text: str, common: dict[str, int], names: list[str]) -> str:
    """Language by script, for Latin script by the frequent words of each language.

    ``common`` gives each frequent word the bits of the languages it belongs to.
    """
    m = None if text.isascii() else _FAR.search(text)
    if m is not None:
        far = len(text) - len(_FAR.sub("", text))
        if 2 * far > sum(map(str.isalpha, text)):
            return "ja" if _KANA.search(text) else next((name for name, a, b in _SCRIPTS if a <= m.group() <= b), "other")
    if not names:
        return "latin"
    hits = Counter(map(common.get, text.lower().split()))
    return max(names, key=lambda k: sum(n for bits, n in hits.items() if bits and bits >> names.index(k) & 1))


def page_code(value: str) -> str:
    """A page range as classes: a = digit of the first page, - = a dash, b/c = digit with which the second page is after the first / not yet."""
    out, first, second, dash = [], "", "", False
    for ch in value:
        if ch.isdigit():
            if dash:
                second += ch
                out.append("b" if int(second) > int(first or 0) else "c")
            else:
                first += ch
                out.append("a")
        elif ch in "-‐‑‒–—−":
            dash = True
            out.append("-")
        elif not ch.isspace():
            out.append("x")
    return "".join(out)


def _codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return np.where((c >= 48) & (c <= 57), np.uint64(48), c)


_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def table_bits(n_rows: int) -> int:
    """Size of the hashed tables, as a power of two, for a corpus of so many values."""
    bits = BITS[0]
    while bits < BITS[1] and n_rows > ROWS << 2 * (bits - BITS[0]):
        bits += 1
    return bits


def _rolling(codes: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Hash bin of the last ``order`` characters at each position from ``order - 1`` on."""
    n = len(codes) - order + 1
    h = np.zeros(max(n, 0), np.uint64)
    for k in range(order):
        h = h * _P + codes[k : k + max(n, 0)]
    return _fold(h, bits)


def _fold(h: np.ndarray, bits: int) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    return ((h * _Q) >> np.uint64(64 - bits)).astype(np.int64)


def _last_bins(tails: list[str], bits: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By order: hash bins of the last characters of each value, and which values are long enough."""
    top = ORDERS[0]
    low = [t[-top:].lower()[-top:] for t in tails]
    size = np.array([len(t) for t in low])
    codes = _codes("".join(t.rjust(top, "\x01") for t in low)).reshape(len(low), top)
    out = {}
    for order in ORDERS:
        h = np.zeros(len(low), np.uint64)
        for k in range(top - order, top):
            h = h * _P + codes[:, k]
        out[order] = (_fold(h, bits), size >= order)
    return out


def _tail(text: str) -> str:
    """The value without blank ends and without a mark of a cut."""
    t = text.rstrip()
    while True:
        end = t[-16:]
        s = _MARK.sub("", end)
        if s == end or not (len(t) > 16 or s.strip()):
            return t
        t = (t[:-16] + s).rstrip()


def _count(rows, common, names, bits):
    """Per task: (lang, order, bin, ends, goes on); order 0 holds the totals of the language."""
    goes: dict = {}
    ends: Counter = Counter()
    total: Counter = Counter()
    batch: dict = {}

    def drain(lang):
        tails = batch.pop(lang)
        shut = np.array([_CLOSED.search(t[-8:]) is not None for t in tails])
        total[lang, "n"] += len(tails)
        total[lang, "chars"] += sum(map(len, tails))
        total[lang, "closed"] += int(shut.sum())
        for order, (bins, long) in _last_bins(tails, bits).items():
            for closed in (True, False):
                got, n = np.unique(bins[long & (shut == closed)], return_counts=True)
                for b, c in zip(got.tolist(), n.tolist()):
                    ends[(lang, order, closed), b] += c
        joined = "\x00".join(tails)
        codes = _codes(joined.lower())
        for order in ORDERS:
            bins = _rolling(codes, order, bits)
            # Contexts that reach over the border of two texts are no contexts.
            zero = np.flatnonzero(codes == 0)
            ok = np.ones(len(bins), bool)
            for k in range(order):
                z = zero - k
                ok[z[(z >= 0) & (z < len(ok))]] = False
            got = np.bincount(bins[ok], minlength=1 << bits)
            goes[lang, order] = got if (lang, order) not in goes else goes[lang, order] + got

    for text, pages in rows:
        if pages:
            code = "^^^" + page_code(pages)
            ends["pages", code[-3:]] += 1
            for k in range(4, len(code)):
                ends["pages+", code[k - 3 : k]] += 1
        if not text or not text.strip():
            continue
        lang = language(text, common, names)
        tail = _tail(text)
        batch.setdefault(lang, []).append(tail)
        if len(batch[lang]) >= 2000:
            drain(lang)
    for lang in list(batch):
        drain(lang)
    for (lang, order), got in goes.items():
        for b in np.flatnonzero(got):
            yield lang, order, str(b), 0, 0, int(got[b])
    for (key, b), n in ends.items():
        if key == "pages":
            yield "#pages", 3, b, n, 0, 0
        elif key == "pages+":
            yield "#pages", 3, b, 0, 0, n
        else:
            yield key[0], key[1], str(b), n * key[2], n * (not key[2]), 0
    for (lang, what), n in total.items():
        yield lang, 0, what, int(n), 0, 0


def train(df: DataFrame, common: dict[str, int], names: list[str], bits: int) -> DataFrame:
    """The model: (lang, ord, ctx, ends, open_ends, seen), one row per table entry at which some value ends."""
    part = flat_map(df.select("text", "page_range"), lambda rows: _count(rows, common, names, bits), "lang string, ord int, ctx string, ends bigint, open_ends bigint, seen bigint", 65_536)
    return part.groupBy("lang", "ord", "ctx").agg(F.sum("ends").alias("ends"), F.sum("open_ends").alias("open_ends"), F.sum("seen").alias("seen")).where("ord = 0 OR ends + open_ends > 0 OR lang = '#pages'")


def _opener():
    """First word of a text, for headings."""
    return F.lower(F.regexp_replace(F.split(F.btrim("text", F.lit(" \t\r\n")), "\\s", 2)[0], "[0-9]+", "0"))


def _short():
    """A single line of at most 110 characters."""
    line = F.btrim("text", F.lit(" \t\r\n"))
    return (F.length(line) <= 110) & ~line.contains("\n")


def heading_openers(df: DataFrame) -> DataFrame:
    """First words (w) that open short unclosed lines at least as often as anything else.

    Distinct texts are counted, so copies have one vote, and texts with a mark of
    a cut have none for their word.  The support that is asked for follows from the
    rate r of such lines among all other words: fewer than one of the V words may be
    expected to reach h of n texts by chance (V 2^n r^h <= 1), so it grows with the
    logarithm of the corpus only.
    """
    from tintero.runtime import checkpoint

    texts = df.where("text IS NOT NULL AND trim(text) != ''").select(_opener().alias("w"), F.xxhash64("text").alias("t"), (_short() & ~F.col("text").rlike(_NO_VOTE)).alias("vote")).distinct()
    g = checkpoint(texts.groupBy("w").agg(F.count("*").alias("n"), F.count_if("vote").alias("h")))
    r = g.selectExpr("count(*) AS v", "coalesce(sum(if(2 * h < n, h, 0)), 0) AS h", "coalesce(sum(if(2 * h < n, n, 0)), 0) AS n").first()
    rate = min((r["h"] + 1) / (r["n"] + 1), 0.05)
    return g.where(f"h >= 2 AND 2 * h >= n AND {math.log(max(r['v'], 1))!r}D + n * {math.log(2)!r}D + h * {math.log(rate)!r}D <= 0").select("w")


def _log_odds(tails: list[str], lang: str, model, bits: int) -> np.ndarray:
    """Log-odds of ending at the last characters of each value: the best over the orders with support."""
    tables, _ = model
    best = np.full(len(tails), -np.inf)
    for order, (bins, long) in _last_bins(tails, bits).items():
        t = tables.get((lang, order))
        if t is None:
            continue
        at = np.minimum(np.searchsorted(t[0], bins), len(t[0]) - 1)
        known = t[0][at] == bins
        e, s = np.where(known, t[1][at], 0).astype(float), np.where(known, t[2][at], 0).astype(float)
        lo = np.log((e + 0.02) / (np.maximum(s - e, 0) + 1.0))
        use = long & ((s >= SUPPORT) | (order == ORDERS[-1]))
        best = np.where(use, np.maximum(best, lo), best)
    return np.where(np.isinf(best), 0.0, best)


def _prepare(rows) -> tuple[dict, dict]:
    """Sorted tables (bins, ends, seen) per language and order, and the language's log rate of ending anywhere."""
    totals: dict = {}
    for r in rows:
        if r[1] == 0:
            totals.setdefault(r[0], {})[r[2]] = r[3]
    found: dict = {}
    pages: dict = {}
    for lang, order, ctx, ends, open_ends, seen in rows:
        if lang == "#pages":
            pages[ctx] = (ends, seen)
        elif order:
            # Ends without a closing mark teach nothing in a language whose texts close with one.
            marked = 2 * totals[lang]["closed"] > totals[lang]["n"]
            found.setdefault((lang, order), []).append((int(ctx), ends + (0 if marked else open_ends), seen))
    tables = {k: tuple(np.array(sorted(v), np.int64).T) for k, v in found.items()}
    rate = {k: math.log(v["n"] / max(v["chars"], 1)) for k, v in totals.items()}
    return (tables, rate), pages


def truncated(df: DataFrame, common_rows: DataFrame | None, id_col: str = "row_id") -> DataFrame:
    """(id, field, source_type, log_odds) of values cut short; field is ``text`` or ``page_range``.

    Null, empty and blank values are never cut.  Headings, date and signature
    lines, lists, tables and junk are no text cases.
    """
    from tintero.runtime import checkpoint

    spark = df.sparkSession
    listed = [] if common_rows is None else quality.listed_words(common_rows.where("lang IS NOT NULL"))
    names = sorted({r["lang"] for r in listed})
    common: dict = {}
    for r in listed:
        w = r["word"].lower()
        common[w] = common.get(w, 0) | 1 << names.index(r["lang"])
    bits = table_bits(df.count())
    got = checkpoint(train(df, common, names, bits)).toPandas()  # at most LANGS x ORDERS x 2^bits entries, as flat columns
    rows = list(zip(*(got[c].tolist() for c in got.columns)))
    shared = spark.sparkContext.broadcast(_prepare(rows))
    kind = dict(df.dtypes)[id_col]

    def run(rows):
        model, pages = shared.value
        rate = model[1]
        held: dict = {}

        def judge(lang):
            kept = held.pop(lang)
            for (i, text, source, _), lo in zip(kept, _log_odds([k[3] for k in kept], lang, model, bits).tolist()):
                if lo < rate.get(lang, -6.0) + ABOVE_RATE["text"] or _BROKEN.search(text[-16:]):
                    yield i, "text", source, lo, text, _MARK.search(text[-24:]) is not None

        for i, text, page_range, source in rows:
            if page_range:
                code = "^^^" + page_code(page_range)
                e, s = pages.get(code[-3:], (0, 0))
                lo = math.log((e + 0.02) / (s + 1.0))
                if code[-1] in "-c" and lo < ABOVE_RATE["page_range"] - 1.0:
                    yield i, "page_range", source, lo, None, False
            if text and text.strip():
                lang = language(text, common, names)
                held.setdefault(lang, []).append((i, text, source, _tail(text)))
                if len(held[lang]) >= 1000:
                    yield from judge(lang)
        for lang in list(held):
            yield from judge(lang)

    found = flat_map(df.select(id_col, "text", "page_range", "source_type"), run, f"`{id_col}` {kind}, field string, source_type string, log_odds double, text string, marked boolean")
    # No cap on the openers: they are joined, not handed over; rows that are no headings get keys of their own.  A text with a mark of a cut is cut, whatever opens it.
    found = found.withColumn("_w", F.when(~F.col("marked") & _short(), _opener()).otherwise(F.concat(F.lit("\n"), F.xxhash64(id_col).cast("string")))).drop("marked")
    heads = heading_openers(df)
    found = found.join(heads, found["_w"] == heads["w"], "left_anti").drop("_w")
    graded = quality.kinds(found, sorted(common))
    return graded.where("field = 'page_range' OR kind = 'prose'").drop("kind", "text")


def rates(df: DataFrame, common_rows: DataFrame | None, id_col: str = "row_id") -> DataFrame:
    """How often each source truncates: per source_type the rows, cut texts and cut page ranges, with their shares."""
    cut = truncated(df, common_rows, id_col).groupBy("source_type").agg(F.count_if(F.col("field") == "text").alias("cut_texts"), F.count_if(F.col("field") == "page_range").alias("cut_page_ranges"))
    n = df.groupBy("source_type").agg(F.count("*").alias("n_rows"))
    out = n.join(cut, n["source_type"].eqNullSafe(cut["source_type"]), "left").select(n["source_type"], "n_rows", F.coalesce("cut_texts", F.lit(0)).alias("cut_texts"), F.coalesce("cut_page_ranges", F.lit(0)).alias("cut_page_ranges"))
    return out.withColumn("text_cut_rate", F.col("cut_texts") / F.col("n_rows")).withColumn("page_range_cut_rate", F.col("cut_page_ranges") / F.col("n_rows"))
