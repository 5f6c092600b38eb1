"""Problem 10: personal information inside free text.

Method: a skip-chain conditional random field.  Tokens of a sentence are a
chain; tokens of a document that repeat a capitalised word (or begin alike) are
also joined by skip edges, over which they share a potential for the same entity
type.  Weights are fitted on composed, labelled documents (a bounded set): the
likelihood of every chain, given the types at the other ends of its skip edges.
Labels are inferred by loopy message passing: forward-backward over the chains,
then messages over the skip edges, repeated until the beliefs settle.  A name in a sentence that tells nothing about it is thus found by its
mention elsewhere in the document.  How often a name stands in the corpus plays
no part: a document's result depends on its own text only.

Features of a token are whole numbers hashed into one table; they are computed
for all tokens of a batch of documents at once.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintero.llm.arrow import flat_map
from tintero.llm.pii_examples import GIVEN, documents

LABELS = ["O", "B-NAME", "I-NAME", "EMAIL", "PHONE", "ID", "B-ADDRESS", "I-ADDRESS"]
L = len(LABELS)
TYPE = np.array([0, 1, 1, 2, 3, 4, 5, 5])
#: Labelled documents fitted on, passes over them, documents of one step, how far a step goes, and the share of features left out in one.
LABELLED = 9000
EPOCHS = 8
STEP = 100
RATE = 0.3
DROP = 0.4
#: Messages over the skip edges end when no belief moves by more than this, or after so many rounds.
SETTLED = 0.01
ROUNDS = 10
#: Documents (or characters) whose chains are run through message passing together.
BATCH = 256
BATCH_CHARS = 1_000_000
#: Size of the table of weights as a power of two.
BITS = 17

# Words of street types, institutions and titles.
STREET = frozenset("av avenida jr jirón jiron psje pasaje calle cl ca carretera rua travessa street road avenue lane mz manzana urb malecón prolongación alameda".split())
BODY = frozenset("hospital fundación fundacion colegio instituto universidad escuela biblioteca museo puente parque plaza estadio centro asociación club teatro aeropuerto clínica foundation institute university school empresa minera consejo banco comité comisión dirección oficina ministerio".split())
TITLE = frozenset("don doña señor señora sr sra dr dra ing lic ciudadano ciudadana regidor regidora vecino vecina cidadão cidadã mr mrs ms abogado abogada doctor doctora".split())
# Words that open sentences, never names.
FUNCTION = frozenset("en el la los las un una con ni cuando según si por para entre a al y o que se no lo su the in on if when while with and em o a os as um uma se".split())
# Words inside names and addresses, what else may stand between a street and its number, and what breaks neither.
SMALL = frozenset("de del la los las y da do".split())
STREET_GOES_ON = frozenset(("a", ".", "km", "°", "º", ","))
BEFORE_NUMBER = frozenset("a n s km lote dpto int nº calle avenida carretera pasaje jirón".split())

_AT = r"(?:\s?@\s?|\s?\(\s?(?:arroba|at)\s?\)\s?|\s?\[\s?(?:arroba|at)\s?\]\s?|\s(?:arroba)\s)"
_DOT = r"(?:\.|\s(?:punto|dot)\s|\s?\[(?:dot|punto)\]\s?)"
_OTHER = (
    r"(?P<N>(?:\+\d{1,3}(?:[^\S\n]|[.-])?)?(?:\(\d{1,4}\)[^\S\n]?)?\d+(?:(?:[^\S\n]|[.\-/,])\d+)*)"
    r"|(?P<I>(?:[^\W\d_]\.){2,})"
    r"|(?P<W>[^\W\d_]+(?:['’\-][^\W\d_]+)*)"
    r"|(?P<P>[^\w\s]|_)"
)
_TOKEN = re.compile(rf"(?P<E>[^\W_][\w.+%-]*{_AT}[^\W_][\w-]*(?:{_DOT}[^\W_][\w-]*)+)|{_OTHER}", re.I)
#: The same for stretches without an address sign.
_PLAIN = re.compile(_OTHER)
# Sentence ends: a stop after a word of three letters, a digit or a closing mark, before a capital or an opening mark.
_STOP = re.compile(r"[.!?](?:(?<=[^\W\d_][^\W\d_][^\W\d_].)|(?<=[\d)»\"].))\s+(?=[^\W\d_a-zà-ÿ<¿¡«\"])")
# Abbreviations after which a stretch goes on.
_ABBREVIATION = re.compile(r"\b(?:psje|pasj|urb|dpto|avda|prol|cdra|doc|fdo|ing|lic|dra|sra|srta|núm|prof|gral|arq|abog|cel|tel|telf|exp|art|inc|cap|mz|lt|int)\.$", re.I)
# Evidence without which a stretch holds no entity.  A pattern's first class lets other characters pass at once.
_UP = "A-ZÀ-ÖØ-ÞĀ-ɏͰ-ԯ"
_RUN = re.compile(rf"[{_UP}](?:[^\W\d_]+|\.),?[^\S\n](?:(?:[dD][eEaAoO][lL]?|[lL][aA][sS]?|[lL]os|LOS)[^\S\n]){{0,2}}[{_UP}](?:[^\W\d_]|\.)")
_NUMBER = re.compile(r"\d(?:[\d.\-/()]|[^\S\n]){4,}\d")
_PLACE = re.compile(rf"\bkm\s|\blote\b|\b(?:{'|'.join(sorted(STREET))})\b\.?\s", re.I)
_SIGN = re.compile(r"arroba|[\[(]at[\])]", re.I)


def segments(text: str):
    """(start, end, whether it may hold an address sign) of the stretches that can hold an entity: sentences with a number of six or more
    digits, a digit and a street word, an address sign, or two capitalised words in a row."""
    low = text.lower()
    signs = "@" in low or "arroba" in low or "at)" in low or "at]" in low
    at = 0
    for line in text.split("\n"):
        end = at + len(line)
        if end > at:
            lo = at
            for m in _STOP.finditer(line):
                cut = at + m.start() + 1
                if _ABBREVIATION.search(text, max(lo, cut - 8), cut):
                    continue
                if _evidence(text, lo, cut, signs):
                    yield lo, cut, signs and _signed(text, lo, cut)
                lo = at + m.end()
            if lo < end and _evidence(text, lo, end, signs):
                yield lo, end, signs and _signed(text, lo, end)
        at = end + 1


_DIGIT = re.compile(r"\d")


def _evidence(text: str, a: int, b: int, signs: bool) -> bool:
    if _RUN.search(text, a, b):
        return True
    if _DIGIT.search(text, a, b) and (_NUMBER.search(text, a, b) or _PLACE.search(text, a, b)):
        return True
    return signs and _signed(text, a, b)


def _signed(text: str, a: int, b: int) -> bool:
    return text.find("@", a, b) >= 0 or _SIGN.search(text, a, b) is not None


def _shape(w: str) -> str:
    if w.isupper():
        return "A" if len(w) == 1 else "AA"
    if w[:1].isupper():
        return "Aa"
    return "a"


def _number_kind(s: str) -> str:
    digits = sum(c.isdigit() for c in s)
    groups = "-".join(str(len(g)) for g in re.findall(r"\d+", s)[:5])
    seps = "".join(sorted({("s" if c.isspace() else c) for c in s if not c.isdigit()}))
    return f"{digits}|{groups}|{seps}"


_GIVEN = frozenset(w.lower() for w in GIVEN)
_SHAPES = {k: i for i, k in enumerate(("pad", "a", "A", "AA", "Aa", "N", "E", "I", "P"))}
#: Columns of what is known of a token by its string: word for the vocabulary, shape, lower-cased word, kind and opening of a number, and yes-no properties.
_COLUMNS = ("key", "shape", "low", "number", "first", "flags", "skip")
_FLAGS = {k: 1 << i for i, k in enumerate(("caps", "small", "street", "street_on", "body", "number", "stop", "given", "mark", "comma"))}


class Tokens(dict):
    """What is known of a token by its string alone, as rows of whole numbers, each computed once."""

    def __init__(self, words: dict[str, int] | None):
        self.words = words  # None while the vocabulary is collected
        self.collected: dict[str, int] = {}
        self.rows = np.zeros((1024, len(_COLUMNS)), np.int64)
        self.used = 1  # row 0 stands between stretches

    def word(self, s: str) -> int:
        """Number of a vocabulary entry; 1 for those that are unknown."""
        if self.words is not None:
            return self.words.get(s, 1)
        return self.collected.setdefault(s, len(self.collected) + 2)

    def __missing__(self, s: str) -> int:
        if self.used == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        kind = _TOKEN.fullmatch(s)
        kind = kind.lastgroup if kind else "W"
        low = s.lower()
        shape, number, first, skip = kind, 0, 0, 0
        if kind == "W":
            shape = _shape(s)
            key = low if shape == "a" or low in STREET or low in BODY or low in TITLE else "<" + shape + ">"
            if len(s) > 3 and s[0].isupper():
                skip = hash_string(low[:6])
        elif kind == "N":
            key = f"<N{min(sum(c.isdigit() for c in s), 13)}>"
            number = self.word("#" + _number_kind(s))
            first = self.word("^" + s[0] + ("9" if s.lstrip("+(")[0] == "9" else ""))
        else:
            key = s if kind == "P" else f"<{kind}>"
        caps = shape in ("A", "AA", "Aa")
        digits = sum(c.isdigit() for c in s) if kind == "N" else 99
        said = {
            "caps": caps, "small": low in SMALL, "street": low in STREET and kind != "N", "street_on": caps or low in SMALL or low in STREET_GOES_ON or kind == "N", "body": low in BODY and caps, "number": digits <= 5 or low == "lote",
            "stop": key in (";", ":", "—", "<", ">") or (shape == "a" and low not in SMALL and low not in BEFORE_NUMBER), "given": low in _GIVEN and caps, "mark": key in (",", "."), "comma": key == ",",
        }
        self.rows[self.used] = (self.word(key), _SHAPES[shape], self.word("=" + low) if len(low) > 1 and kind != "N" else 1, number, first, sum(_FLAGS[k] for k, v in said.items() if v), skip)
        self[s] = n = self.used
        self.used += 1
        return n


def hash_string(s: str) -> int:
    """A 62-bit number of a string, the same in every process; never 0."""
    h = 1469598103934665603
    for c in s:
        h = (h ^ ord(c)) * 1099511628211 & (1 << 62) - 1
    return h | 1


class Chains:
    """The tokens of the stretches of some documents, one after the other, with two rows of padding between stretches."""

    def __init__(self, texts: list[str], known: Tokens):
        ids, at, to, self.first, self.size, self.doc = [0, 0], [0, 0], [0, 0], [], [], []
        get = known.__getitem__
        for d, text in enumerate(texts):
            for a, b, sign in segments(text):
                lo = len(ids)
                spans = [m.span() for m in (_TOKEN if sign else _PLAIN).finditer(text, a, b)]
                ids += [get(text[x:z]) for x, z in spans]
                at += [x for x, _ in spans]
                to += [z for _, z in spans]
                if len(ids) > lo:
                    self.first.append(lo)
                    self.size.append(len(ids) - lo)
                    self.doc.append(d)
                    ids += (0, 0)
                    at += (0, 0)
                    to += (0, 0)
        self.ids, self.start, self.stop = np.array(ids), at, to
        self.first, self.size = np.array(self.first, np.int64), np.array(self.size, np.int64)


def _last(flag: np.ndarray) -> np.ndarray:
    """At each position the last one, not after it, at which ``flag`` holds (0 where there is none)."""
    return np.maximum.accumulate(np.where(flag, np.arange(len(flag)), 0))


def _next(flag: np.ndarray) -> np.ndarray:
    n = len(flag) - 1
    return n - _last(flag[::-1])[::-1]


_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD)]


def features(c: Chains, known: Tokens):
    """Feature hashes of all rows of the chains, one array a time; 0 where a feature does not apply.

    Rows of padding get features too, which nobody reads.
    """
    key, shape, low, number, first, flags, _ = known.rows[c.ids].T
    n = len(key)
    i = np.arange(n)
    has = lambda k: (flags & _FLAGS[k]) > 0
    pad = c.ids == 0
    back = lambda x, k: np.concatenate([np.zeros(k, x.dtype), x[: n - k]])
    ahead_of = lambda x, k: np.concatenate([x[k:], np.zeros(k, x.dtype)])
    caps, small = has("caps"), has("small")
    # Runs of capitalised words, small words inside them included: where the run at a token begins and ends.
    solid = _last(~small)
    inside = caps[solid] & ~pad
    begin = _last(~inside) + 1
    end = _next(~(caps | small)) - 1
    end = np.where(inside, _last(caps)[np.maximum(end, 0)], i)
    end = np.maximum(end, i)
    left = np.where(inside, i - begin, 0)
    # Distance from a street word whose name may still go on, institutions likewise, and whether a number is ahead.
    street = has("street")
    mark = _last(street | ~has("street_on"))
    since = np.where(street[mark] & ~pad, np.minimum(i - mark + 1, 9), 0)
    body = has("body")
    inst = _last(body | ~(caps | small))
    inst = np.where(body[inst] & ~pad, np.minimum(i - inst, 1) + 1, 0)
    event = _next(has("number") | has("stop") | pad)
    ahead = (has("number")[event]).astype(np.int64)
    # Stretches in capitals throughout, and lines of capitalised words only.
    sure = np.zeros(n, np.int64)
    line = np.zeros(n, np.int64)
    if len(c.first):
        of = np.repeat(np.arange(len(c.first)), c.size)
        rows = np.repeat(c.first - np.concatenate([[0], np.cumsum(c.size)[:-1]]), c.size) + np.arange(c.size.sum())
        count = lambda x: np.bincount(of, x[rows], len(c.first))
        upper, lettered = (shape == _SHAPES["AA"]) | (shape == _SHAPES["A"]), np.isin(shape, [_SHAPES[k] for k in ("a", "A", "AA", "Aa")])
        sure[rows] = ((c.size > 8) & (count(upper) > 0.85 * count(lettered)))[of]
        line[rows] = (np.where(count(caps | small | has("mark")) == c.size, np.minimum(c.size, 7), 0))[of]
    at = lambda x, j: x[np.clip(j, 0, n - 1)]
    zero = np.zeros(n, np.int64)
    p1, p2, n1, n2 = back(key, 1), back(key, 2), ahead_of(key, 1), ahead_of(key, 2)
    isn, apart = shape == _SHAPES["N"], np.minimum(end - i, 3)
    l1, l2 = back(low, 1), back(low, 2)
    for t, (where, *parts) in enumerate((
        (None, zero), (None, key), (None, shape), (None, p1), (None, n1), (None, p2), (None, n2), (None, p1, shape), (None, shape, n1), (None, p2, p1, shape),
        (isn, number), (isn, first), (isn, l1, l2), (isn, l1, number),
        (caps, np.minimum(left, 3), at(key, begin - 1)), (caps, np.minimum(left, 3), at(key, begin - 2), at(key, begin - 1)), (caps, apart, at(key, end + 1)), (caps, apart, at(key, end + 1), at(key, end + 2)), (caps, np.minimum(end - begin + 1, 5)),
        (caps, has("given").astype(np.int64), at(has("given"), begin).astype(np.int64), np.minimum(left, 2)), (inside & small, at(has("given"), begin).astype(np.int64)),
        (since > 0, since, ahead), (since > 0, ahead, shape), ((since == 0) & (ahead > 0) & (caps | isn), shape), (inst > 0, inst), (inst > 0, shape), (sure > 0, shape), (line > 0, line, shape), (line > 0, zero),
    )):
        yield _hash(t, where, *parts)
    # The word that opens a stretch; other capitalised words are told by their shape only.
    yield _hash(98, caps & back(pad, 1), low)
    # Words before a number, wherever among the four before it in its stretch.
    begun = _last(pad)
    for k in range(1, 5):
        yield _hash(99, isn & (i - k > begun), back(low, k))


def _hash(t: int, where, *parts) -> np.ndarray:
    h = np.full(len(parts[0]), (t + 1) * 0x51ED270B, np.uint64)
    for p, c in zip(parts, _C):
        h = (h ^ p.astype(np.uint64)) * c
        h ^= h >> np.uint64(31)
    h = (h * _C[4]) | np.uint64(1)
    return h if where is None else np.where(where, h, np.uint64(0))


class Model:
    """Fitted weights: vocabulary, hashed table (signatures and weights), transitions (last row and column: begin and end), skip weight of each entity type."""

    def __init__(self, words, sign, weight, t, kappa):
        self.words, self.sign, self.weight, self.t, self.kappa = words, sign, weight, t, kappa

    def slots(self, h: np.ndarray) -> np.ndarray:
        """Row of each feature in the table, one of two it may stand in; the last row, of zeros, for unknown ones."""
        s = (h >> np.uint64(64 - BITS)).astype(np.int64)
        sign = h.astype(np.uint32)
        return np.where(self.sign[s] == sign, s, np.where(self.sign[s ^ 1] == sign, s ^ 1, 1 << BITS))

    def nodes(self, c: Chains, known: Tokens) -> np.ndarray:
        """Node potentials of all rows."""
        out = np.zeros((len(c.ids), L), np.float32)
        for h in features(c, known):
            on = np.flatnonzero(h)
            if len(on) == len(h):
                out += self.weight[self.slots(h)]
            elif len(on):
                out[on] += self.weight[self.slots(h[on])]
        return out


def skip_groups(c: Chains, known: Tokens) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows, group of each, number of groups): tokens of a document that repeat a capitalised word or begin alike (six letters)."""
    if not len(c.first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    word = known.rows[c.ids, _COLUMNS.index("skip")]
    doc = np.zeros(len(c.ids), np.int64)
    doc[c.first] = np.diff(np.concatenate([[-1], c.doc]))
    doc = np.cumsum(doc)
    rows = np.flatnonzero(word)
    both = word[rows] * np.int64(1000003) + doc[rows] * np.int64(7919)
    _, group, n = np.unique(both, return_inverse=True, return_counts=True)
    keep = n[group] > 1
    rows, group = rows[keep], group[keep]
    _, group = np.unique(group, return_inverse=True)
    return rows, group, int(group.max()) + 1 if len(group) else 0


_fitted: dict = {}


def _labels(c: Chains, golds) -> np.ndarray:
    """Label of every row from the entity spans of the documents."""
    y = np.zeros(len(c.ids), np.int64)
    for f, s, d in zip(c.first.tolist(), c.size.tolist(), c.doc):
        spans = golds[d]
        for i in range(f, f + s):
            a, b = c.start[i], c.stop[i]
            for x, z, k in spans:
                if a < z and b > x:
                    y[i] = {"NAME": 1 if a <= x else 2, "EMAIL": 3, "PHONE": 4, "ID": 5, "ADDRESS": 6 if a <= x else 7}[k]
                    break
    return y


def fit(n: int = LABELLED, epochs: int = EPOCHS) -> Model:
    """The fitted field: gradient steps over groups of documents."""
    if (n, epochs) in _fitted:
        return _fitted[n, epochs]
    docs = documents(n)
    texts, golds = [t for t, _ in docs], [s for _, s in docs]
    # Vocabulary: what stands in at least two documents' worth of tokens.
    first = Tokens(None)
    seen: dict[int, int] = {}
    whole = Chains(texts, first)
    for col in ("key", "low", "number", "first"):
        got, k = np.unique(first.rows[whole.ids, _COLUMNS.index(col)], return_counts=True)
        for g, m in zip(got.tolist(), k.tolist()):
            seen[g] = seen.get(g, 0) + m
    words = {w: i for w, i in first.collected.items() if seen.get(i, 0) > 2}
    known = Tokens(words)
    steps = []
    for k in range(0, n, STEP):
        c = Chains(texts[k : k + STEP], known)
        y = _labels(c, golds[k : k + STEP])
        steps.append((c, np.stack(list(features(c, known)), 1), y))
    # The table: features seen once are left out, the commonest are put in first.
    every, count = np.unique(np.concatenate([h[h > 0] for _, h, _ in steps]), return_counts=True)
    every = every[count > 1][np.argsort(-count[count > 1], kind="stable")]
    sign = np.zeros(1 << BITS, np.uint32)
    for at, h in zip((every >> np.uint64(64 - BITS)).tolist(), every.astype(np.uint32)):
        if sign[at] == 0:
            sign[at] = h
        elif sign[at ^ 1] == 0:
            sign[at ^ 1] = h
    m = Model(words, sign, np.zeros(((1 << BITS) + 1, L), np.float32), np.zeros((L + 1, L + 1), np.float32), np.zeros(int(TYPE.max()) + 1))
    w, t = m.weight, m.t
    gw, gt, gk = np.full_like(w, 1e-4), np.full_like(t, 1e-4), np.full(len(m.kappa), 1e-4)
    ready = []
    for c, h, y in steps:
        rows = np.flatnonzero(c.ids)
        slot = m.slots(h[rows])
        slot[h[rows] == 0] = 1 << BITS
        same = np.zeros((len(c.ids), len(m.kappa)), np.float32)
        g_rows, g, n_g = skip_groups(c, known)
        if n_g:
            total = np.zeros((n_g, same.shape[1]), np.float32)
            np.add.at(total, (g, TYPE[y[g_rows]]), 1)
            others = total[g]
            others[np.arange(len(g)), TYPE[y[g_rows]]] -= 1
            same[g_rows] = others / others.sum(1, keepdims=True)
        gold = np.zeros_like(t)
        np.add.at(gold, (np.where(c.ids[rows - 1] == 0, L, y[rows - 1]), y[rows]), 1)
        np.add.at(gold[:, L], y[rows[c.ids[rows + 1] == 0]], 1)
        flat = slot.ravel()
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        cut = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        ready.append((c, rows, slot, y[rows], gold, same[rows][:, TYPE], order, order // slot.shape[1], cut, flat[cut]))
    rng, kappa = np.random.default_rng(1), m.kappa
    for _ in range(epochs):
        for k in rng.permutation(len(ready)):
            c, rows, slot, y, gold, same, order, token, cut, at = ready[k]
            node, belief, pairs = np.zeros((len(c.ids), L), np.float32), np.zeros((len(c.ids), L), np.float32), np.zeros_like(t)
            # Features are left out at random, so that none relies on the company it is seen in.
            keep = (rng.random(slot.shape) >= DROP).astype(np.float32)
            node[rows] = np.einsum("nfl,nf->nl", w[slot], keep) + kappa[TYPE] * same
            for part, where, live in _alike(c, np.arange(len(c.first)), 1.6):
                belief[where[live]] = _marginals(node[where], c.size[part], t, pairs)[live]
            d = belief[rows]
            d[np.arange(len(y)), y] -= 1
            grad = np.add.reduceat(d[token] * keep.ravel()[order][:, None], cut, 0) + 1e-3 * w[at]
            gw[at] += grad**2
            w[at] -= RATE * grad / np.sqrt(gw[at])
            w[1 << BITS] = 0
            tg = pairs - gold
            gt += tg**2
            t -= RATE * tg / np.sqrt(gt)
            kg = np.bincount(TYPE, (d * same).sum(0), len(kappa))
            kg[0] = 0  # words that are no entity share nothing
            gk += kg * kg
            kappa -= RATE * kg / np.sqrt(gk)
    w *= 1 - DROP
    np.maximum(kappa, 0.0, out=kappa)
    _fitted[n, epochs] = m
    return m


def _alike(c: Chains, chains: np.ndarray, ratio: float):
    """Chains of like length together: (chains, their rows padded to the longest, which of these are theirs)."""
    order = chains[np.argsort(c.size[chains], kind="stable")]
    k = 0
    while k < len(order):
        z = k + int(np.searchsorted(c.size[order[k : k + 512]], ratio * c.size[order[k]] + 4, "right"))
        part = order[k:z]
        n = int(c.size[part[-1]])
        yield part, np.minimum(c.first[part][:, None] + np.arange(n), len(c.ids) - 1), np.arange(n) < c.size[part][:, None]
        k = z


def _marginals(node: np.ndarray, size: np.ndarray, t: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Label marginals of padded chains (chains x steps x labels) by scaled forward-backward.

    ``pairs``, where given, is increased by the expected transitions.
    """
    c, n, _ = node.shape
    e = np.exp(node - node.max(2, keepdims=True))
    inner, out = np.exp(t[:L, :L]), np.exp(t[:L, L])
    fwd, bwd = np.empty_like(e), np.empty_like(e)
    f = e[:, 0] * np.exp(t[L, :L])
    fwd[:, 0] = f = f / f.sum(1, keepdims=True)
    for i in range(1, n):
        f = (f @ inner) * e[:, i]
        fwd[:, i] = f = f / np.maximum(f.sum(1, keepdims=True), 1e-30)
    b = np.tile(out, (c, 1)).astype(e.dtype)
    bwd[:, n - 1] = b
    back = np.ascontiguousarray(inner.T)
    for i in range(n - 2, -1, -1):
        b = (b * e[:, i + 1]) @ back
        b = np.where((size > i + 1)[:, None], b / np.maximum(b.sum(1, keepdims=True), 1e-30), out)
        bwd[:, i] = b
    p = fwd * bwd
    p /= np.maximum(p.sum(2, keepdims=True), 1e-30)
    if pairs is not None:
        left, right = fwd[:, :-1], (e * bwd)[:, 1:]
        total = np.einsum("cni,ij,cnj->cn", left, inner, right, optimize=True)
        share = (np.arange(1, n) < size[:, None]) / np.maximum(total, 1e-30)
        pairs[:L, :L] += np.einsum("cni,cnj->ij", left * share[..., None], right, optimize=True) * inner
        pairs[L, :L] += p[:, 0].sum(0)
        pairs[:L, L] += p[np.arange(c), size - 1].sum(0)
    return p


def _ok(kind: str, s: str) -> bool:
    """Exact check of a decoded span."""
    digits = sum(c.isdigit() for c in s)
    if kind == "NAME":
        if s.split(None, 1)[0].lower() in FUNCTION:
            return False
        w = re.findall(r"[^\W\d_]+", s)
        return len(w) >= 2 and digits == 0
    if kind == "EMAIL":
        return re.search(_AT, s, re.I) is not None
    if kind == "PHONE":
        return 6 <= digits <= 15
    if kind == "ID":
        return 7 <= digits <= 13 and s[0] != "+"
    return digits > 0 and (re.search(r"\b(?:km|lote)\b", s, re.I) is not None or any(w.lower() in STREET for w in re.findall(r"[^\W\d_]+", s)))


class Tagger:
    """The fitted field; finds spans in many documents at once."""

    def __init__(self, model: Model, skips: bool = True):
        self.model, self.kappa, self.known = model, model.kappa if skips else np.zeros_like(model.kappa), Tokens(model.words)

    def beliefs(self, c: Chains, node: np.ndarray, chains: np.ndarray, out: np.ndarray) -> None:
        """Marginals of the given chains."""
        for part, where, live in _alike(c, chains, 1.25):
            out[where[live]] = _marginals(node[where], c.size[part], self.model.t)[live]

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        if len(self.known) > 300_000:
            self.known = Tokens(self.model.words)
        c = Chains(texts, self.known)
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if not len(c.first):
            return out
        node = self.model.nodes(c, self.known)
        belief = np.zeros_like(node)
        self.beliefs(c, node, np.arange(len(c.first)), belief)
        rows, group, n = skip_groups(c, self.known) if self.kappa.any() else (np.zeros(0, np.int64), None, 0)
        if n:
            chain_of = np.zeros(len(c.ids), np.int64)
            chain_of[c.first] = 1
            chain_of = np.cumsum(chain_of) - 1
            members = np.bincount(group)[:, None]
            one = np.eye(int(TYPE.max()) + 1, dtype=np.float32)[TYPE]
            alive = np.ones(len(rows), bool)
            for _ in range(ROUNDS):
                types = belief[rows] @ one
                total = np.stack([np.bincount(group, types[:, k], n) for k in range(types.shape[1])], 1)
                others = (total[group] - types) / (members[group] - 1)
                moved = node.copy()
                moved[rows] += (self.kappa * others)[:, TYPE].astype(np.float32)
                before = belief[rows]
                self.beliefs(c, moved, np.unique(chain_of[rows[alive]]), belief)
                change = np.abs(belief[rows] - before).max(1)
                # Only groups in which a belief still moves send further messages.
                moving = np.zeros(n, bool)
                moving[group[change > SETTLED]] = True
                alive = moving[group]
                if not alive.any():
                    break
        self._decode(texts, c, belief, out)
        return out

    def _decode(self, texts, c, belief, out):
        y = belief.argmax(1)
        y[c.ids == 0] = 0
        kinds = [x.split("-")[-1] for x in LABELS]
        for i in np.flatnonzero((y > 0) & ~((y == 2) & np.isin(np.roll(y, 1), (1, 2))) & ~((y == 7) & np.isin(np.roll(y, 1), (6, 7)))).tolist():
            kind = kinds[y[i]]
            j = i
            if kind == "ID" and texts[c.doc[int(np.searchsorted(c.first, i, "right")) - 1]][c.start[i]] == "+":
                kind = "PHONE"  # only telephone numbers have a country's prefix
            if kind in ("NAME", "ADDRESS"):
                while kinds[y[j + 1]] == kind and LABELS[y[j + 1]][0] == "I":
                    j += 1
            d = c.doc[int(np.searchsorted(c.first, i, "right")) - 1]
            text = texts[d]
            a = c.start[i]
            b = c.stop[j]
            while b > a and text[b - 1] in ",;:":
                b -= 1
            if b > a and _ok(kind, text[a:b]):
                out[d].append((a, b, kind))


def _batches(rows):
    ids, texts, size = [], [], 0
    for i, t in rows:
        ids.append(i)
        texts.append(t)
        size += len(t or "")
        if len(ids) == BATCH or size > BATCH_CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, start_pos, end_pos) of every occurrence; null and empty texts have none."""
    kind = dict(df.dtypes)[id_col]
    shared = df.sparkSession.sparkContext.broadcast(fit())

    def run(rows):
        tagger = Tagger(shared.value)
        for ids, texts in _batches(rows):
            for i, spans in zip(ids, tagger.spans(texts)):
                for a, b, k in spans:
                    yield i, k.lower(), a + 1, b

    return flat_map(df.select(id_col, text_col).where(F.col(text_col).isNotNull()), run, f"`{id_col}` {kind}, kind string, start_pos int, end_pos int")


PLACEHOLDER = {"NAME": "[NOMBRE]", "EMAIL": "[CORREO]", "PHONE": "[TELEFONO]", "ID": "[DOCUMENTO]", "ADDRESS": "[DIRECCION]"}


def masked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_masked): every occurrence replaced by its typed placeholder, all else untouched; null stays null.

    ``n_masked`` counts the placeholders that were put in.
    """
    kind = dict(df.dtypes)[id_col]
    shared = df.sparkSession.sparkContext.broadcast(fit())

    def run(rows):
        tagger = Tagger(shared.value)
        for ids, texts in _batches(rows):
            for i, t, spans in zip(ids, texts, tagger.spans([t or "" for t in texts])):
                if t is None:
                    yield i, None, 0
                    continue
                out, at, n = [], 0, 0
                for a, b, k in sorted(spans):
                    if a >= at:
                        out += [t[at:a], PLACEHOLDER[k]]
                        at, n = b, n + 1
                yield i, "".join(out) + t[at:], n

    return flat_map(df.select(id_col, text_col), run, f"`{id_col}` {kind}, text string, n_masked int")
