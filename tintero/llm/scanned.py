"""Problem 4: noise in text from scanned pages.

Method: every word type of the corpus is counted; the *anagram hash* of a word
is the sum of the fifth powers of its code points (whole numbers modulo a
prime), so that replacing one confusable string by another changes it by a known
difference.  Rare words are joined in SQL with frequent words whose hash differs
by the difference of one known confusion, or of two where the word holds digits
or signs; the replacement is then verified letter by letter, and the candidates
of a word are ranked by how often the frequent word is seen.  Running heads are
edge lines that do not occur inside pages; divided words are told from compounds
by the counts of the joined and of the hyphenated form.

What is learned grows with the vocabulary of misread words.  It is handed to the
tasks whole only while its measured bytes are few; beyond, the keys of each page
are looked up by a join, those that cannot be entries being left out by a bitmap
of bounded size.
"""

from __future__ import annotations

import re
from collections import Counter

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tintero import runtime
from tintero.llm.arrow import flat_map
from tintero.llm.canonical import canonical
from tintero.runtime import bytes_of, checkpoint

# Strings that character recognition confuses, read -> meant.
CONFUSIONS = [
    ("0", "o"), ("0", "ó"), ("1", "l"), ("1", "i"), ("1", "í"), ("!", "i"), ("!", "l"), ("!", "í"), ("|", "l"), ("|", "i"), ("5", "s"), ("$", "s"), ("+", "t"), ("7", "t"), ("@", "a"), ("4", "a"), ("4", "á"),
    ("6", "ó"), ("6", "b"), ("6", "g"), ("8", "b"), ("9", "g"), ("9", "q"), ("3", "e"), ("€", "e"), ("£", "e"), ("&", "e"), ("2", "z"), ("¡", "i"), ("f", "í"), ("c", "e"), ("e", "c"), ("c", "o"), ("ii", "u"), ("ü", "ú"), ("rn", "m"), ("m", "rn"), ("nn", "m"),
    ("vv", "w"), ("cl", "d"), ("d", "cl"), ("a", "ci"), ("ri", "n"), ("n", "ri"), ("li", "h"), ("h", "b"), ("b", "h"), ("I", "l"), ("t", "f"), ("f", "t"), ("l", "t"), ("t", "l"), ("in", "m"), ("u", "n"), ("n", "u"), ("fi", "h"), ("ni", "m"), ("iu", "m"), ("tn", "m"), ("q", "g"), ("g", "q"), ("y", "v"), ("v", "y"), ("l", "i"), ("i", "l"),
]
#: Characters that end a line inside a divided word.
DIVIDERS = "-‐‑¬\xad"
#: A clean rare word must be this many times rarer than its reading; one holding a digit or sign, rarer at all.
RARER = 50
MIN_SEEN = 3
#: Anagram hashes are whole numbers below this prime, so that sums of two fit a BIGINT.
PRIME = (1 << 61) - 1
#: Bits of the bitmap of learned keys, as powers of two; within these it has eight bits an entry.
BITMAP = (16, 27)

_EDGE = "\"'.,;:()«»“”‘’¿?¡!—–[]…°²³¹%"
_PAGE_NO = re.compile(r"(?:p[áa]g(?:ina|\.)?\s*)?[-–—\[(]?\s*(?:\d{1,5}|[ivxlc]{1,7})\s*[-–—\])]?(?:\s*(?:/|de)\s*\d{1,5})?", re.I)
_STRAY = re.compile(r"[^\w\s.,;:()«»\"“”‘’¿?¡!—–…%$&/|§\[\]{}=*•·\-‐+€]+|[^\w\s]*[~^¬¦<>'`´¨_\\°º][^\w\s]*")
_LETTER = re.compile(r"[^\W\d_]")
_WORDISH = re.compile(r"[^\W\d_]")
_SENTENCE_END = (".", "!", "?", ":", ";", ",", "»", '"', "”", ")", "²")
_NON_LETTER = re.compile(r"[\W\d_]+")


def _key(line: str) -> str:
    return _NON_LETTER.sub("", line).lower()


def layout(text: str):
    """(canonical lines, divider flags, blocks) of a page; a block is a run of non-empty line indexes.

    A soft hyphen or other divider at the end of a line is noted before the
    canonical form removes it.
    """
    raw = text.split("\n")
    lines, cut = [], []
    for r in raw:
        s = r.rstrip()
        t = s.rstrip("​‌‍⁠﻿")
        c = canonical(s).rstrip()
        d = bool(t) and t[-1] in DIVIDERS and len(t) > 1 and (t[-2].isalpha() or (len(c) > 1 and (c[-1].isalpha() or c[-2].isalpha())))
        if d and c and c[-1] in DIVIDERS:
            c = c[:-1]
        lines.append(c)
        cut.append(d)
    blocks, run = [], []
    for i, c in enumerate(lines):
        if c.strip():
            run.append(i)
        elif run:
            blocks.append(run)
            run = []
    if run:
        blocks.append(run)
    return lines, cut, blocks


def core(token: str) -> str:
    """A token without the marks around it, as counted in the vocabulary."""
    return token.strip(_EDGE).lower()


def _divided(lines, cut, i):
    """(left, right) around the end of line i if it may be a divided word, else None."""
    if not cut[i] or i + 1 >= len(lines) or not lines[i + 1].strip():
        return None
    left, right = lines[i].split()[-1:], lines[i + 1].split()[:1]
    if not left or not right:
        return None
    return core(left[0]), core(right[0])


def is_page_number(line: str) -> bool:
    s = line.strip()
    return bool(s) and len(s) <= 24 and _PAGE_NO.fullmatch(s) is not None


def edge_lines(lines, blocks):
    """Indexes of page-number lines and of candidate head and foot lines."""
    numbers, heads = set(), []
    for side in (1, -1):
        order = [i for b in blocks for i in b][::side]
        for i in order[:3]:
            if is_page_number(lines[i]) and (i in (order[0],) or all(j in numbers or j in heads for j in order[: order.index(i)])):
                numbers.add(i)
                break
            if len(_key(lines[i])) < 5 or lines[i].rstrip().endswith(_SENTENCE_END):
                break
            heads.append(i)
    edge = []
    for bs in (blocks, blocks[::-1]):
        for b in bs[:3]:
            rest = [i for i in b if i not in numbers]
            if not rest:
                continue
            if len(rest) > 2 or any(lines[i].rstrip().endswith(_SENTENCE_END) or len(_key(lines[i])) < 5 for i in rest):
                break
            edge.append(rest)
    return numbers, edge


def _evidence(rows):
    """Per task: counts of word types, divided pairs, and keys of lines at edges and inside pages."""
    count: Counter = Counter()
    for (text,) in rows:
        if not text:
            continue
        lines, cut, blocks = layout(text)
        if not blocks:
            continue
        numbers, edge = edge_lines(lines, blocks)
        first, last = blocks[0], blocks[-1]
        outer = {i for b in edge for i in b}
        for b in blocks:
            rest = [i for i in b if i not in numbers]
            if rest and len(rest) <= 2 and not any(lines[i].rstrip().endswith(_SENTENCE_END) for i in rest):
                where = "e" if (b is first or b is last or (rest[0] in outer and _adjacent(b, blocks, numbers))) else "m"
                for i in rest:
                    k = _key(lines[i])
                    if len(k) >= 5:
                        count[where, k] += 1
        for i, line in enumerate(lines):
            tokens = line.split()
            pair = _divided(lines, cut, i)
            if pair is not None:
                count["h", pair[0] + "\t" + pair[1]] += 1
                tokens = tokens[:-1]
            if i and _divided(lines, cut, i - 1) is not None:
                tokens = tokens[1:]
            for tok in tokens:
                count["w", tok] += 1
        if len(count) > 300_000:
            yield from _flush(count)
            count = Counter()
    yield from _flush(count)


def _adjacent(b, blocks, numbers):
    """The block is the outermost one once page-number blocks are set aside."""
    kept = [x for x in blocks if any(i not in numbers for i in x)]
    return kept and (b is kept[0] or b is kept[-1])


def anagram_hash(word: str) -> int:
    """Sum of the fifth powers of the code points, modulo the prime."""
    return sum(ord(c) ** 5 for c in word) % PRIME


def _flush(count):
    merged: Counter = Counter()
    for (kind, k), n in count.items():
        if kind == "w":
            k = core(k)
            if not k or not _WORDISH.search(k):
                continue
        merged[kind, k] += n
    for (kind, k), n in merged.items():
        yield kind, k, n, anagram_hash(k) if kind == "w" else 0


def corpus_evidence(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, key, n, h) over all pages: ``w`` word types with their anagram hash, ``h`` divided pairs, ``e``/``m`` line keys at edges and inside."""
    part = flat_map(pages.select(text_col), _evidence, "kind string, key string, n bigint, h bigint")
    return part.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.max("h").alias("h"))


def _replaced(word: str, c: str) -> str:
    """All words made from ``word`` by one replacement of confusion ``c``, in SQL."""
    at = f"filter(sequence(1, greatest(length({word}) - length({c}.got) + 1, 1)), i -> substring({word}, i, length({c}.got)) = {c}.got)"
    return f"transform({at}, i -> concat(substring({word}, 1, i - 1), {c}.meant_s, substring({word}, i + length({c}.got), length({word}))))"


def corrections(evidence: DataFrame) -> DataFrame:
    """(word, meant, n): the best-ranked frequent reading of each rare, confusable word."""
    diff = lambda a, b: (anagram_hash(b) - anagram_hash(a)) % PRIME
    listed = ", ".join(f"named_struct('no', {k}, 'got', {a!r}, 'meant_s', {b!r}, 'diff', {diff(a, b)}L, 'sign', {str(not a.isalpha()).lower()})" for k, (a, b) in enumerate(sorted({(a.lower(), b) for a, b in CONFUSIONS})))
    words = evidence.where("kind = 'w' AND length(key) >= 2").selectExpr("key AS word", "n", "h", "key RLIKE '[^\\\\p{L}\\\\p{M}.\\\\-]' AS odd")
    # Each word with the confusions it contains: at most the few dozen entries of the fixed list.
    contained = words.selectExpr("*", f"filter(array({listed}), c -> instr(word, c.got) > 0 AND odd = c.sign) AS _c").where("size(_c) > 0")
    one = contained.selectExpr("word", "n", "h", "odd", "explode(_c) AS c").selectExpr("word", "n", "odd", "c", "CAST(NULL AS " + dict(contained.dtypes)["_c"][6:-1] + ") AS c2", f"pmod(h + c.diff, {PRIME}L) AS h")
    # Two misreadings: of words with two digits or signs; pairs in the order of the list, a confusion with itself too.
    several = contained.where("odd AND length(regexp_replace(word, '[\\\\p{L}\\\\p{M}.\\\\-]', '')) >= 2")
    two = several.selectExpr("word", "n", "h", "odd", "_c", "explode(_c) AS c").selectExpr("word", "n", "h", "odd", "c", "explode(filter(_c, x -> x.no >= c.no)) AS c2").selectExpr("word", "n", "odd", "c", "c2", f"pmod(pmod(h + c.diff, {PRIME}L) + c2.diff, {PRIME}L) AS h")
    known = words.where(f"n >= {MIN_SEEN} AND NOT odd").selectExpr("word AS meant", "n AS n_meant", "h")
    hit = one.unionByName(two).join(known, "h").where(f"odd AND n_meant > n OR NOT odd AND n_meant >= {RARER} * n AND length(word) >= 4")
    fits = f"if(c2 IS NULL, array_contains({_replaced('word', 'c')}, meant), exists({_replaced('word', 'c')}, y -> array_contains({_replaced('y', 'c2')}, meant)))"
    best = Window.partitionBy("word").orderBy(F.col("c2").isNotNull(), F.desc("n_meant"), "meant")
    return hit.where(fits).withColumn("r", F.row_number().over(best)).where("r = 1").select("word", "meant", "n")


def compounds(evidence: DataFrame) -> DataFrame:
    """Divided pairs that are compounds broken at their own hyphen: the pair is no divided word."""
    words = evidence.where("kind = 'w'").select(F.col("key").alias("w"), "n")
    pairs = evidence.where("kind = 'h'").select("key", F.split("key", "\t")[0].alias("l"), F.split("key", "\t")[1].alias("r"))
    look = (
        pairs.join(words.select(F.col("w").alias("joined"), F.col("n").alias("n_joined")), F.concat("l", "r") == F.col("joined"), "left")
        .join(words.select(F.col("w").alias("hyph"), F.col("n").alias("n_hyph")), F.concat("l", F.lit("-"), "r") == F.col("hyph"), "left")
        .join(words.select(F.col("w").alias("wl"), F.col("n").alias("n_l")), F.col("l") == F.col("wl"), "left")
        .join(words.select(F.col("w").alias("wr"), F.col("n").alias("n_r")), F.col("r") == F.col("wr"), "left")
    )
    rule = "coalesce(n_hyph, 0) > coalesce(n_joined, 0) OR (n_hyph IS NULL AND n_joined IS NULL AND n_l IS NOT NULL AND n_r IS NOT NULL AND length(l) >= 4 AND length(r) >= 4)"
    return look.where(rule).select("key")


def inner_keys(evidence: DataFrame) -> DataFrame:
    """Line keys seen at page edges that also stand inside pages: no running heads."""
    k = evidence.where("kind IN ('e', 'm')").groupBy("key").agg(F.sum(F.expr("if(kind = 'm', n, 0)")).alias("m"), F.sum(F.expr("if(kind = 'e', n, 0)")).alias("e"))
    return k.where("m > 0 AND e > 0 AND 10 * m >= e").select("key")


def model(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """All learned entries (kind, key, value): corrections, compounds broken at their hyphen, edge lines that are no heads."""
    ev = checkpoint(corpus_evidence(pages, text_col))
    return checkpoint(
        corrections(ev).selectExpr("'fix' AS kind", "word AS key", "meant AS value")
        .unionByName(compounds(ev).selectExpr("'compound' AS kind", "key", "CAST(NULL AS string) AS value"))
        .unionByName(inner_keys(ev).selectExpr("'inner' AS kind", "key", "CAST(NULL AS string) AS value"))
    )


class Learned:
    """Entries of the model: corrections of words, compound pairs, keys of edge lines that are no heads."""

    def __init__(self, entries):
        self.fix, self.compound, self.inner = {}, set(), set()
        for kind, key, value in entries:
            if kind == "fix":
                self.fix[key] = value
            else:
                (self.compound if kind == "compound" else self.inner).add(key)
        self.bad = _Bad(self.fix)


class _Bad(dict):
    """Whether a token is misread or a stray mark, remembered per token; the memory is emptied when it is full."""

    def __init__(self, fix):
        self.fix = fix

    def __missing__(self, tok):
        if len(self) > 300_000:
            self.clear()
        self[tok] = bad = core(tok) in self.fix or _stray(tok)
        return bad


def _stray(tok: str) -> bool:
    return _STRAY.fullmatch(tok) is not None and not any(c.isalnum() for c in tok)


def keys_of(text: str):
    """(kind, key) of all entries that could bear on a page."""
    lines, cut, blocks = layout(text)
    _, edge = edge_lines(lines, blocks) if blocks else ((), ())
    for b in edge:
        for i in b:
            yield "inner", _key(lines[i])
    for i, line in enumerate(lines):
        for tok in line.split():
            yield "fix", core(tok)
        pair = _divided(lines, cut, i)
        if pair is not None:
            yield "compound", pair[0] + "\t" + pair[1]
            yield "fix", pair[0] + pair[1]
            yield "fix", pair[0] + "-" + pair[1]


class Page:
    """The one decision on a page: per line what it is, and which of its tokens are kept, dropped or corrected.

    ``gone`` gives page-number and head lines their kind; ``divided`` the lines
    that end inside a divided word and ``compound`` those that end at a
    compound's own hyphen; ``ocr`` the lines with a misread character or stray
    mark.  What is reported (``marks``) and what is done (``text``) both follow it.
    """

    def __init__(self, text: str, learned: Learned):
        self.lines, cut, self.blocks = layout(text)
        lines = self.lines
        numbers, edge = edge_lines(lines, self.blocks) if self.blocks else (set(), [])
        heads = {i for b in edge if not any(_key(lines[i]) in learned.inner for i in b) for i in b}
        self.gone, self.learned = dict.fromkeys(heads, "header") | dict.fromkeys(numbers, "page_no"), learned
        self.divided, self.compound, self.ocr = set(), set(), set()
        self.parts: list[tuple] = []  # per line its tokens, where its own words begin and end, and whether a lone bar is noise
        # A lone bar is a stray mark inside a paragraph, but parts the fields of a head.
        inside = {i for b in self.blocks if len(b) > 2 for i in b} - heads
        after = False  # the line before ends inside a word
        for i, line in enumerate(lines):
            tokens = line.split()
            pair = _divided(lines, cut, i)
            last = len(tokens) - (pair is not None)
            body = tokens[after:last] if last > after else []
            bar = "|" in body and i in inside and body.count("|") == 1
            self.parts.append((tokens, min(after, last), last, bar))
            if i in numbers:
                after = pair is not None
                continue
            if bar or any(map(learned.bad.__getitem__, body)):
                self.ocr.add(i)
            if pair is not None:
                (self.compound if pair[0] + "\t" + pair[1] in learned.compound else self.divided).add(i)
                meant = next((learned.fix[j] for j in (pair[0] + pair[1], pair[0] + "-" + pair[1]) if j in learned.fix), None)
                if meant is not None:
                    # The misread half decides the line.
                    bad = {k for k, good in ((i, meant.startswith(pair[0])), (i + 1, meant.endswith(pair[1]))) if not good}
                    self.ocr |= bad or {i}
            after = pair is not None

    def marks(self):
        """(kind, line index) of every noisy line."""
        yield from ((kind, i) for i, kind in self.gone.items())
        yield from (("hyphen", i) for i in self.divided)
        yield from (("ocr", i) for i in self.ocr)

    def kept(self, i: int) -> list[str]:
        """The tokens of line i without stray marks; halves of divided words stay as they are."""
        tokens, a, b, bar = self.parts[i]
        return [*tokens[:a], *(t for t in tokens[a:b] if not (_stray(t) or (bar and t == "|"))), *tokens[b:]]

    def text(self) -> str:
        """The page as continuous paragraphs: edge lines gone, words rejoined and corrected."""
        paragraphs = []
        for b in self.blocks:
            words: list[str] = []
            glue = None
            for i in b:
                if i in self.gone:
                    continue
                toks = self.kept(i)
                if glue is not None and words and toks:
                    words[-1] += glue + toks[0]
                    toks = toks[1:]
                words += toks
                glue = "" if i in self.divided else "-" if i in self.compound else None
            if words:
                paragraphs.append(" ".join(_restore(w, self.learned.fix) for w in words))
        return "\n\n".join(paragraphs)


def _restore(tok: str, fix) -> str:
    c = core(tok)
    meant = fix.get(c)
    if meant is None:
        return tok
    at = max(tok.lower().find(c), 0)
    old = tok[at : at + len(c)]
    letters = [x for x in old if x.isalpha()]
    new = meant.upper() if letters and all(x.isupper() for x in letters) and len(letters) > 1 else meant.capitalize() if old[:1].isupper() else meant
    return tok[:at] + new + tok[at + len(c) :]


def _bitmap(m: DataFrame) -> tuple[int, dict[int, bytes]]:
    """Bitmap of the model's keys: number of bits, and its blocks of 32,768; of bounded size however many entries there are."""
    low, high = BITMAP
    bits = 1 << min(max(low, (8 * m.count()).bit_length()), high)
    at = F.pmod(F.xxhash64(F.concat_ws("\n", "kind", "key")), F.lit(bits))
    blocks = m.select(F.shiftright(at, 15).alias("block"), (at % 32768).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("map"))
    return bits, {r["block"]: bytes(r["map"]) for r in blocks.collect()}


def _key_hash(kind: str, key: str) -> int:
    """The hash under which the bitmap holds an entry."""
    return xxhash.xxh64_intdigest(f"{kind}\n{key}".encode("utf-8", "surrogatepass"), seed=42)


def apply(pages: DataFrame, fn, schema: str, id_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """``fn(id, text, Learned)`` over all pages, with what the corpus taught about each."""
    m = model(pages, text_col)
    rows = pages.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    sc = pages.sparkSession.sparkContext
    if bytes_of(m) <= runtime.HAND_OVER:
        shared = sc.broadcast([tuple(r) for r in m.collect()])  # within the bound

        def run(rows):
            learned = Learned(shared.value)
            for i, t in rows:
                yield from fn(i, t, learned)

        return flat_map(rows, run, schema)
    shared = sc.broadcast(_bitmap(m))

    def ask(rows):
        bits, blocks = shared.value
        for page, t in rows:
            for kind, key in {*keys_of(t)} if t else ():
                at = _key_hash(kind, key) % bits
                if (block := blocks.get(at >> 15)) is not None and block[(at & 32767) >> 3] >> (at & 7) & 1:
                    yield page, kind, key

    rows = rows.withColumn("_page", F.xxhash64("_id", "_text"))
    asked = flat_map(rows.select("_page", "_text"), ask, "_page bigint, kind string, key string").distinct()
    known = asked.join(m, ["kind", "key"]).groupBy("_page").agg(F.collect_list(F.struct("kind", "key", "value")).alias("_known"))
    joined = rows.join(known, "_page", "left").select("_id", "_text", "_known")

    def run_each(rows):
        for i, t, known in rows:
            yield from fn(i, t, Learned((e["kind"], e["key"], e["value"]) for e in known or ()))

    return flat_map(joined, run_each, schema)


def found(pages: DataFrame, id_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """(id, kind, line_no) of divided words, heads and feet, page numbers and misread lines.

    Null or empty text gives no row; a row that is repeated gives its rows again.
    """

    def run(i, t, learned):
        for kind, n in sorted({*Page(t, learned).marks()}) if t else ():
            yield i, kind, n + 1

    return apply(pages, run, f"`{id_col}` {dict(pages.dtypes)[id_col]}, kind string, line_no int", id_col, text_col)


def repaired(pages: DataFrame, id_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """(id, text) with every page repaired; null stays null, empty stays empty."""

    def run(i, t, learned):
        yield i, Page(t, learned).text() if t else t

    return apply(pages, run, f"`{id_col}` {dict(pages.dtypes)[id_col]}, text string", id_col, text_col)
