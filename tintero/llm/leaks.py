"""Problem 8: passages of held-out test items standing in corpus documents.

Method: Wu-Manber multi-pattern search over words.  The patterns are all runs
of eight successive words of the items.  A shift table over word pairs tells
how far the search window may jump; where it may not, the hash bucket of the
window's suffix selects the patterns and direct comparison confirms them.  Few
items are handed to the tasks as they are; for more, the shift table is hashed to
a fixed size, a bitmap of bounded size tells which windows may be patterns, and
these are compared with the items by a join.  Either way the corpus is read once.
Case, accents, punctuation, mark-up and line breaks are removed from both sides
first.  Confirmed positions are merged into stretches, and an item counts as
leaked where its stretches hold at least half of its words.
"""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintero import runtime
from tintero.llm.arrow import flat_map
from tintero.llm.canonical import canonical
from tintero.runtime import bytes_of, checkpoint

RUN = 8
SHARE = 0.5
#: Slots of the hashed shift table, and bits of the bitmap of patterns, as powers of two; within these it has eight bits a pattern.
SLOTS = 20
BITMAP = (16, 27)
#: Words of a block of the pattern alphabet (the B of the method).
PAIR = 2

_TAG = re.compile(r"</?(?:b|i|u|em|strong|span|a|sup|sub|mark|font|small|code|s)\b[^<>]*>", re.I)
_BLOCK_TAG = re.compile(r"<[/!?a-zA-Z][^<>]*>")
_HYPHEN_BREAK = re.compile(r"(?<=[^\W\d_])[-‐¬]\s*\n\s*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
_ACCENT = dict.fromkeys(range(0x300, 0x370))


def words(text: str) -> list[str]:
    """The words of a text as compared: no mark-up, no accents, lower case, letters and digits only."""
    if "<" in text:
        text = _BLOCK_TAG.sub(" ", _TAG.sub("", text))
    if "&" in text:
        text = html.unescape(text)
        if "<" in text:
            text = _BLOCK_TAG.sub(" ", _TAG.sub("", text))
    text = canonical(text)
    if "\n" in text:
        text = _HYPHEN_BREAK.sub("", text)
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFD", text).translate(_ACCENT)
    return _WORD.findall(text)


class Patterns:
    """Tables of items: shifts by word pair, buckets by window suffix."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, words(t or "")) for i, t in items]
        self.shift: dict[tuple[str, str], int] = {}
        self.bucket: dict[tuple[str, str], dict[tuple, list[tuple[int, int]]]] = {}
        for n, (_, w) in enumerate(self.items):
            for p in range(len(w) - RUN + 1):
                window = tuple(w[p : p + RUN])
                for k in range(RUN - PAIR + 1):
                    pair = window[k : k + PAIR]
                    jump = RUN - PAIR - k
                    if jump < self.shift.get(pair, RUN):
                        self.shift[pair] = jump
                self.bucket.setdefault(window[-PAIR:], {}).setdefault(window, []).append((n, p))

    def search(self, text: list[str]):
        """Occurrences (item index, position in item, position in text) of the runs, in text order."""
        shift, bucket, default, at, last = self.shift, self.bucket, RUN - PAIR + 1, RUN - 1, len(text)
        while at < last:
            pair = (text[at - 1], text[at])
            jump = shift.get(pair, default)
            if jump:
                at += jump
                continue
            hits = bucket[pair].get(tuple(text[at - RUN + 1 : at + 1]))
            if hits:
                for n, p in hits:
                    yield n, p, at - RUN + 1
            at += 1

    def leaked(self, text: str):
        """(item id, share of the item's words in stretches, number of stretches) of each leaked item."""
        cover: dict[int, list[tuple[int, int]]] = {}
        for n, p, q in self.search(words(text)):
            cover.setdefault(n, []).append((p, q))
        for n, at in cover.items():
            item, w = self.items[n]
            covered = set()
            for p, _ in at:
                covered.update(range(p, p + RUN))
            share = len(covered) / len(w)
            if share >= SHARE:
                runs = sum(1 for p in covered if p - 1 not in covered)
                yield item, share, runs


def leaked_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc id, item id, share, stretches) of every document that holds an item, wholly or at least half.

    Items of fewer than eight words hold no run and cannot be found; null texts
    on either side take no part; an item listed twice is reported once.
    """
    listed = items.select(F.col(item_col).alias("item"), F.col(item_text).alias("_text")).where("item IS NOT NULL AND _text IS NOT NULL").distinct()
    source = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("_text")).where("_text IS NOT NULL")
    kinds = f"doc {dict(docs.dtypes)[id_col]}, item {dict(items.dtypes)[item_col]}"
    found = (_with_tables if bytes_of(listed) <= runtime.HAND_OVER else _with_join)(source, listed, kinds)
    out = found.groupBy("doc", "item").agg(F.max("share").alias("share"), F.max("stretches").alias("stretches"))
    return out.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "share", "stretches")


def _with_tables(source: DataFrame, listed: DataFrame, kinds: str) -> DataFrame:
    """The items handed over whole; their bytes are bounded."""
    shared = source.sparkSession.sparkContext.broadcast([tuple(r) for r in listed.collect()])

    def run(rows):
        patterns = Patterns(shared.value)
        for i, t in rows:
            for item, share, n in patterns.leaked(t):
                yield i, item, share, n

    return flat_map(source, run, f"{kinds}, share double, stretches int")


def _slot(a: str, b: str, slots: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{a} {b}") >> (64 - slots)


def _window(w: list[str], p: int) -> tuple[str, int]:
    """A run of words from ``p`` on, as a string and as a signed 64-bit number."""
    s = " ".join(w[p : p + RUN])
    return s, xxhash.xxh3_64_intdigest(s) - (1 << 63)


def _with_join(source: DataFrame, listed: DataFrame, kinds: str) -> DataFrame:
    """Any number of items: hashed shift table and bitmap, both of bounded size, then a join that compares the windows."""
    item_kind, slots = kinds.split(", item ")[1], SLOTS

    def cut(rows):
        for item, t in rows:
            w = words(t)
            for p in range(len(w) - RUN + 1):
                yield item, len(w), p, *_window(w, p)

    def jumps(rows):
        best: dict = {}
        for _, t in rows:
            w = words(t)
            for p in range(len(w) - RUN + 1):
                for k in range(RUN - PAIR + 1):
                    s = _slot(w[p + k], w[p + k + 1], slots)
                    best[s] = min(best.get(s, RUN), RUN - PAIR - k)
        yield from best.items()

    windows = checkpoint(flat_map(listed, cut, f"item {item_kind}, n_words int, p int, run string, h bigint"))
    shift = np.full(1 << slots, RUN - PAIR + 1, np.uint8)
    for slot, jump in flat_map(listed, jumps, "slot int, jump int").groupBy("slot").agg(F.min("jump")).collect():  # at most one row a slot
        shift[slot] = jump
    bits = 1 << min(max(BITMAP[0], (8 * windows.count()).bit_length()), BITMAP[1])
    at = F.pmod("h", F.lit(bits))
    blocks = windows.select(F.shiftright(at, 15).alias("block"), (at % 32768).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("map")).collect()
    shared = source.sparkSession.sparkContext.broadcast((shift.tobytes(), bits, {r["block"]: bytes(r["map"]) for r in blocks}))

    def search(rows):
        shift, bits, blocks = shared.value
        for page, doc, t in rows:
            w, at = words(t), RUN - 1
            while at < len(w):
                jump = shift[_slot(w[at - 1], w[at], slots)]
                if jump:
                    at += jump
                    continue
                s, h = _window(w, at - RUN + 1)
                bit = h % bits
                if (block := blocks.get(bit >> 15)) is not None and block[(bit & 32767) >> 3] >> (bit & 7) & 1:
                    yield page, doc, s, h
                at += 1

    rows = source.select(F.xxhash64("doc", "_text").alias("page"), "doc", "_text")
    near = flat_map(rows, search, f"page bigint, {kinds.split(', item ')[0]}, run string, h bigint")
    hits = near.join(windows, ["h", "run"]).groupBy("page", "doc", "item", "n_words").agg(F.sort_array(F.collect_set("p")).alias("at"))
    steps = F.transform(F.slice("at", 2, F.size("at")), lambda x, i: x - F.get("at", i))
    share = (F.lit(RUN) + F.aggregate(steps, F.lit(0), lambda a, x: a + F.least(x, F.lit(RUN)))) / F.col("n_words")
    return hits.select("doc", "item", share.alias("share"), (F.size(F.filter(steps, lambda x: x > RUN)) + 1).alias("stretches")).where(f"share >= {SHARE}")


def leaked_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Report per item: in how many documents it stands, and the largest share."""
    hits = leaked_documents(docs, items).groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("share").alias("largest_share"))
    return items.select("item_id", "suite").distinct().join(hits, "item_id")
