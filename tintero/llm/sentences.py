"""Problem 7: sentence units across languages and scripts.

Method: spaced scripts get a *terminator lattice*: every terminator with its
closing marks is a node scored by what stands before it (abbreviation, initial,
number) and after it (opening word, case); edges are the spans between nodes,
penalised where they hold no words; the best path gives the units.  Spaceless
scripts (Thai, Lao, Khmer, Burmese, Chinese, Japanese) are cut into words by a
dictionary word lattice (cheapest path over known words); the gaps between words
are then classified by the final particle before and the opening words after
them, so that sentences part without stops and spaces, too.  Everything is
linear in the length of a text.

Dictionary: the words of these scripts in a public tokenizer's vocabulary (some
700 of two characters and more for Chinese, Japanese and Thai, none for the
others), and the closed classes below: particles, openings, markers.  Words that
are in neither stay single characters; gaps are judged by the closed classes.
"""

from __future__ import annotations

import base64
import os
import re
import unicodedata
from bisect import bisect_left
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintero.llm.arrow import flat_map
from tintero.runtime import checkpoint, hand_over

#: Folder of the public tokenizers' vocabulary files, and the file whose words the dictionary takes.
TOKENIZERS = os.environ.get("TINTERO_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"

# Abbreviations that need a continuation.
BOUND_ABBREVIATIONS = frozenset(
    "sr sra srta sres dr dra dres ing lic arq econ prof profa don dña gral cnel art arts núm num inc cap caps pág págs pag párr parr exp cf cfr v vid véase p pp ej ex ed eds vol t fig tab aprox approx n no nro leg d reg res ord ley ds ru "
    "mr mrs ms st mt sec fig figs eq ref refs vs viz i.e e.g ca al ap av avda jr psje urb mz lt dpto km tel cel fax ee rr ff "
    "ene feb mar abr jun jul ago set sep sept oct nov dic jan apr aug dec डॉ श्री द".split()
)
# Abbreviations that may also end a sentence.
FREE_ABBREVIATIONS = frozenset("etc s.a s.a.c s.a.a s.r.l e.i.r.l c.v ltd co corp inc. bros uu ee.uu u.s u.k u.n a.m p.m m p.p a.c d.c ph.d jr. ltda cía cia ss".split())
# Words that open sentences, for text where case does not tell.
OPENING_WORDS = frozenset(
    "el la los las un una en de según si cuando para por entre además asimismo finalmente con sin no se al es hacia desde durante ante tras aun aunque mientras como a sobre este esta estos estas hay the a an in on at for if when while however "
    "this that these those it we they o os as um uma em no na se para por quando".split()
)
# Fixed values, per spaceless script: final particles (strong, weak), words that open a sentence by themselves, subjects that
# open one if a marker follows, and these markers.
CLOSED = {
    "thai": (
        "ครับ ค่ะ คะ จ้ะ จ้า นะ นะครับ นะคะ ไหม มั้ย หรือเปล่า หรือไม่ แล้วครับ แล้วค่ะ", "แล้ว เลย ด้วย", "แต่ ดังนั้น อย่างไรก็ตาม นอกจากนี้ เพราะฉะนั้น ถ้า หาก ต่อมา ทั้งนี้",
        "ผม ฉัน ดิฉัน เรา เขา เธอ มัน พวกเรา พวกเขา คุณ คณะกรรมการ รัฐบาล สภา ธนาคาร กระทรวง ประธาน ประชาชน", "จะ ได้ ไม่ ยัง กำลัง เคย ต้อง คาดว่า เสนอ บอก กล่าว เป็น มี ควร",
    ),
    "lao": ("ບໍ່ ບໍ ເດີ້ ເນາະ ຫວາ ດອກ", "ແລ້ວ", "ແຕ່ ດັ່ງນັ້ນ ນອກຈາກນັ້ນ ຖ້າ", "ຂ້ອຍ ຂ້າພະເຈົ້າ ພວກເຮົາ ລາວ ເຂົາ ເຂົາເຈົ້າ ລັດຖະບານ ຄະນະກຳມະການ ທະນາຄານ ປະຊາຊົນ", "ຈະ ໄດ້ ບໍ່ ຍັງ ກຳລັງ ຕ້ອງ ເປັນ ມີ ຄວນ"),
    "khmer": ("ទេ ណា", "ហើយ ណាស់", "ប៉ុន្តែ ដូច្នេះ ប្រសិនបើ លើសពីនេះ", "ខ្ញុំ យើង គាត់ នាង ពួកគេ រដ្ឋាភិបាល គណៈកម្មាធិការ ធនាគារ ប្រជាជន", "នឹង បាន មិន កំពុង ត្រូវ ជា មាន គួរ"),
    "burmese": ("ပါတယ် ပါသည် တယ် လား မည် ပါပြီ", "သည်", "သို့သော် ဒါပေမဲ့ ထို့ကြောင့် ထို့ပြင်", "ကျွန်တော် ကျွန်မ သူ သူတို့ အစိုးရ ကော်မတီ ဘဏ်", "က သည် တို့"),
    "chinese": (
        "吗 呢 吧 啦 嘛 呀 啊 了", "", "但是 但 然而 不过 因此 所以 于是 此外 另外 同时 如果 虽然 因为 由于 首先 其次 最后 例如 总之",
        "我 我们 你 你们 他 她 它 他们 她们 这 那 这些 那些 大家 人们 政府 委员会 银行 公司 部门 国家 专家 记者 市场 总统 部长 议会 企业 居民", "没有 没 不 将 将会 会 已 已经 正在 是 要 能 可以 可能 应 应该 必须 认为 表示 指出 预计 提醒 说 也 都 就 还 仍",
    ),
    "japanese": (
        "です ます ました でした ません でしょう ましょう ください ですか ますか ましたか でしたか ですね ますね ですよ ますよ ませんでした", "だ た だった である よ ね か", "しかし また そして だから なお ただし さらに そのため 例えば 一方 ところが それで つまり したがって でも",
        "私 私たち 彼 彼女 彼ら これ それ あれ 政府 委員会 銀行 会社 市場 議会 国民 評議会", "は が も",
    ),
}
# Words after a space that continue a Thai or Lao sentence.
CONTINUES = frozenset("และ หรือ ที่ ซึ่ง ๆ ของ กับ ແລະ ຫຼື ທີ່ ຂອງ ກັບ".split())
_SCRIPT = {"thai": "\u0e00-\u0e7f", "lao": "\u0e80-\u0eff", "khmer": "\u1780-\u17ff", "burmese": "\u1000-\u109f", "han": "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff々"}
_SPACELESS = {k: re.compile(f"[{v}]") for k, v in _SCRIPT.items()}
_ANY_SPACELESS = re.compile("[" + "".join(_SCRIPT.values()) + "]")
_KANA = re.compile("[\u3041-\u3096\u30a1-\u30fa]")

_STOP = re.compile(r"(?:\.{2,}|[.!?…।؟۔។៕။]+|[。！？｡]+)[\"'”’»›)\]}）」』】²³¹⁴⁵⁶⁷⁸⁹⁰]*")
_BREAK = re.compile(r"[\s«“\"(\[¿¡—–/]")
_PAIRS = {"«": "»", "“": "”", "(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "‹": "›"}
_CLOSERS = {v: k for k, v in _PAIRS.items()}
_OPENING = "«“\"'‘(¿¡[—–-「『（‹•"
_PAST_SPACE = re.compile(r"\s*")
_PAST_OPENING = re.compile("[" + re.escape(_OPENING) + "]*")
_INITIALS = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]")
_WORD_NEXT = re.compile(r"[^\W_]+")


def _depths(text: str) -> list[tuple[int, int]]:
    """Spans of matched quotes and brackets (position of opener, position of closer); unmatched ones are ignored."""
    spans, stack, straight = [], [], None
    for i, c in enumerate(text):
        if c in _PAIRS:
            stack.append((c, i))
        elif c in _CLOSERS:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == _CLOSERS[c]:
                    spans.append((stack[k][1], i))
                    del stack[k:]
                    break
        elif c == '"':
            if straight is None:
                straight = i
            else:
                spans.append((straight, i))
                straight = None
    return spans


class _Text:
    """A text with the positions that its stops ask for, each found in logarithmic time."""

    def __init__(self, text: str):
        self.text = text
        letters = sum(map(str.isalpha, text))
        self.upper = letters > 0 and sum(map(str.isupper, text)) > 0.8 * letters
        self.breaks = [m.start() for m in _BREAK.finditer(text)]
        self.slashes, self.ats = ([m.start() for m in re.finditer(c, text)] for c in "/@")
        self.spaces = [m.start() for m in re.finditer(" ", text)]

    @staticmethod
    def before(at: list[int], i: int) -> int:
        """The last of the ascending positions before ``i``, or -1."""
        k = bisect_left(at, i)
        return at[k - 1] if k else -1

    def score(self, a: int, b: int) -> float:
        """How much the stop from ``a`` to ``b`` looks like the end of a sentence; positive means it does."""
        text, upper, mark = self.text, self.upper, self.text[a]
        at = _PAST_SPACE.match(text, b).end()
        if at == len(text):
            return 9.0
        first, gap = text[at], at - b
        if mark in "。！？｡":
            return -3.0 if first in "，、,」』”）)と的" else 6.0
        if mark in "।؟۔។៕။":
            return 6.0 if gap or first in _OPENING else 2.0
        past = _PAST_OPENING.match(text, at).end()
        nxt, second = text[past : past + 1], text[past + 1 : past + 2]
        opened = first in "«“\"¿¡‘—–"
        begin = self.before(self.breaks, a) + 1
        # Longer words are in none of the lists.
        token = text[begin:a] if a - begin <= 40 else text[a - 41 : a]
        word = token.lower()
        if nxt.islower() and not (opened and first in "¿¡"):
            return -6.0
        if first in ",;:)»”":
            return -6.0
        starts = (nxt.isupper() or nxt.isdigit() or opened or (nxt.isalpha() and not nxt.islower())) and nxt != ""
        if mark in "!?…" or text.startswith("..", a):
            return 4.0 if gap and starts else (2.0 if starts and nxt.isupper() else -4.0)
        closed = b - a > 1 and text[b - 1] in "\"'”’»)]²³¹"
        if not gap:
            if closed and nxt.isupper():
                return 3.0
            # No space: two sentences run together, or part of a number, an address or an abbreviation.
            slash = self.before(self.slashes, a)
            if slash > self.before(self.spaces, a) or text[begin : begin + 3].lower() == "www" or nxt.isdigit() or self.before(self.ats, a) >= begin:
                return -6.0
            if not (nxt.isupper() and at + 1 < len(text)) or first in "°º":
                return -6.0
            if word in FREE_ABBREVIATIONS and second.islower():
                return 2.0
            if len(token) < 2 or word in BOUND_ABBREVIATIONS or (token.isupper() and len(token) < 3 and not upper):
                return -6.0
            return 3.0 if (second.islower() or second == " " or upper) and (token[-1:].isalnum() or token[-1:] in "%)") else -6.0
        if closed:
            return 5.0
        if word in FREE_ABBREVIATIONS or (word not in BOUND_ABBREVIATIONS and _INITIALS.fullmatch(text, begin, a) is not None):
            w = _WORD_NEXT.match(text, past)
            if upper:
                return 2.0 if opened or (w and w.group().lower() in OPENING_WORDS and word not in ("uu", "p.p")) else -3.0
            return 2.5 if starts else -3.0
        if word in BOUND_ABBREVIATIONS:
            return -5.0
        if len(token) == 1 and token.isalpha():
            if token.islower() or not token.isascii():
                k = a - 2
                while k > 0 and text[k].isspace():
                    k -= 1
                half = text[max(k - 1, 0) : k + 1] in ("a.", "p.")
                return 2.0 if starts and (half or not token.isascii()) and token in "m" else -4.0 if not _caseless(token) else 1.0
            return -5.0
        if token == "" and text[a - 1 : a] in "%)»”\"":
            return 4.0
        if re.fullmatch(r"\(?(?:\d{1,2}|[ivxlc]{1,4}|[a-z])", word) and _first_token(text, a - len(token)):
            return -5.0
        return 5.0 if starts else -4.0


def _caseless(ch: str) -> bool:
    return ch.isalpha() and not ch.islower() and not ch.isupper()


def _first_token(text: str, at: int) -> bool:
    """Nothing but blanks stands between ``at`` and the begin of its line: the token is an enumerator."""
    while at > 0 and text[at - 1] in " \t(":
        at -= 1
    return at == 0 or text[at - 1] == "\n"


def _spaced(text: str) -> list[int]:
    """Ends (exclusive) of the units of a text in a spaced script: best path through the terminator lattice."""
    stops = list(_STOP.finditer(text))
    t = _Text(text) if stops else None
    spans = sorted(_depths(text)) if stops else []
    openers = {o for o, _ in spans}
    nodes, k, reach = [], 0, -1
    for m in stops:
        a, b = m.span()
        while k < len(spans) and spans[k][0] < a:
            reach = max(reach, spans[k][1])
            k += 1
        # Inside a quote or bracket that closes after this stop: the quoting sentence goes on.
        if reach >= b:
            continue
        # Marks after the stop that open again do not belong to it.
        e = b
        while e - 1 > a and text[e - 1] == '"' and e - 1 in openers:
            e -= 1
        nodes.append((e, t.score(a, e)))
    end = len(text.rstrip())
    if not nodes or nodes[-1][0] < end:
        nodes.append((end, 9.0))
    # What a path gains up to node i and loses by skipping the nodes after it is additive: the best start of the
    # last edge is carried along, over all nodes (edge without words) and over those with a word before the stop.
    ends = [0, *(e for e, _ in nodes)]
    best, back, passed = [0.0], [0], 0.0
    bare, worded, ready = (0.0, 0), (float("-inf"), 0), 0
    value, word = [0.0], [_next_word(text, 0)]
    for j, (e, s) in enumerate(nodes, 1):
        while ready < j and word[ready] < e:
            worded = max(worded, (value[ready], ready))
            ready += 1
        top, arg = max(worded, (bare[0] - 20.0, bare[1]))
        best.append(top + s - passed / 2)
        back.append(arg)
        passed += s
        value.append(best[j] + passed / 2)
        word.append(word[-1] if word[-1] >= e else _next_word(text, e))
        bare = max(bare, (value[j], j))
    out, j = [], len(nodes)
    while j:
        out.append(ends[j])
        j = back[j]
    return out[::-1]


def _next_word(text: str, at: int) -> int:
    """Position of the first letter or digit from ``at`` on."""
    return next((i for i in range(at, len(text)) if text[i].isalnum()), len(text))


@lru_cache(4)
def dictionary(folder: str = "") -> tuple[frozenset[str], int]:
    """Words of the spaceless scripts: the closed classes and those of the tokenizer's vocabulary; and the longest one's length."""
    words = {w for lists in CLOSED.values() for words in lists for w in words.split()} | CONTINUES
    path = os.path.join(folder or TOKENIZERS, VOCABULARY)
    if os.path.exists(path):
        one = re.compile("|".join(f"[{v}]+" for v in _SCRIPT.values()))
        with open(path, "rb") as f:
            for line in f:
                w = base64.b64decode(line.split()[0]).decode("utf-8", "ignore").strip()
                if len(w) > 1 and one.fullmatch(w) and not unicodedata.combining(w[0]):
                    words.add(w)
    return frozenset(words), max(map(len, words))


def word_lattice(text: str, words: frozenset[str], longest: int) -> list[str]:
    """Cheapest path over dictionary words; runs of unknown characters cost one each."""
    n = len(text)
    cost, step = [0.0] * (n + 1), [1] * (n + 1)
    for i in range(n - 1, -1, -1):
        best, size = cost[i + 1] + 1.0, 1
        for k in range(1, min(longest, n - i) + 1):
            if cost[i + k] + 0.5 < best and text[i : i + k] in words:
                best, size = cost[i + k] + 0.5, k
        cost[i], step[i] = best, size
    out, i = [], 0
    while i < n:
        out.append(text[i : i + step[i]])
        i += step[i]
    return out


_FINAL, _OPENS, _SUBJECT, _MARKER = ({k: frozenset(v[j].split()) for k, v in CLOSED.items()} for j in (0, 2, 3, 4))
_WEAK_FINAL = {k: frozenset(v[1].split()) for k, v in CLOSED.items()}


def gap_score(words: list[str], i: int, script: str) -> int:
    """How much the gap before word ``i`` parts two sentences: the final particle before it and the opening after it.

    A strong final counts 2, a weak one 1; a word that opens a sentence by
    itself counts 3, a subject with its marker 2.  Neither alone parts anything.
    """
    last = words[i - 1]
    # Longer finals count as ends of longer words, too.
    final = 2 if last in _FINAL[script] or last.endswith(_LONG_FINAL[script]) else 1 if last in _WEAK_FINAL[script] else 0
    if not final:
        return 0
    if words[i] in _OPENS[script]:
        return final + 3
    if words[i] in _SUBJECT[script] and i + 1 < len(words) and words[i + 1] in _MARKER[script]:
        return final + 2
    if script == "japanese" and _HAN_CHAR.match(words[i]):
        # Any noun is a subject where its particle follows before another one does.
        for w in words[i + 1 : i + 7]:
            if w in _MARKER[script]:
                return final + 2
            if not _HAN_CHAR.match(w):
                break
    return final


_LONG_FINAL = {k: tuple(w for w in v if len(w) > 1) for k, v in _FINAL.items()}
_HAN_CHAR = re.compile("[\u3400-\u4dbf\u4e00-\u9fff々]")
PARTS = 4


def _spaceless(text: str, script: str) -> list[int]:
    """Ends of the units of a text in a spaceless script: stops, spaces where the script uses them, and gaps between words."""
    ends = set(_spaced(text))
    spans, k, reach = sorted(_depths(text)), 0, -1
    words, longest = dictionary()
    name = ("japanese" if _KANA.search(text) else "chinese") if script == "han" else script
    last_word = ""
    at = 0
    for m in re.finditer(f"[{_SCRIPT[script]}]+", text):
        while k < len(spans) and spans[k][0] < m.start():
            reach = max(reach, spans[k][1])
            k += 1
        parts = word_lattice(m.group(), words, longest)
        blank = text[at : m.start()]
        if at and blank and blank.isspace() and reach < m.start() and _space_parts(name, blank, last_word, parts):
            ends.add(at)
        pos = m.start()
        for i, w in enumerate(parts):
            if i and reach < pos and gap_score(parts, i, name) >= PARTS:
                ends.add(pos)
            pos += len(w)
        last_word, at = parts[-1], m.end()
    if name in ("thai", "lao"):
        ends |= set(_thai_spaces(text, words, longest))
    return sorted(ends)


def _space_parts(name: str, blank: str, last: str, parts: list[str]) -> bool:
    """Whether a space between two words of a spaceless script parts sentences: in Thai and Lao see below, else after a final particle."""
    if name in ("thai", "lao"):
        return False
    return len(blank) == 1 and blank != "\n" and (last in _FINAL[name] or last in _WEAK_FINAL[name])


def _thai_spaces(text: str, words: frozenset[str], longest: int):
    """A space parts two sentences unless the word after it is sure to continue the one before, or foreign words or numbers stand beside it."""
    run = re.compile(f"[{_SCRIPT['thai']}{_SCRIPT['lao']}]+")
    tokens = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    has = [run.search(text, a, b) for a, b in tokens]
    for (_, e), (b, _), before, after in zip(tokens, tokens[1:], has, has[1:]):
        if before is None or after is None:
            continue
        first = word_lattice(after.group(), words, longest)[:2] if after.start() == b else []
        if first and first[0] in CONTINUES and (len(first) == 1 or first[1] in words):
            continue
        yield e


def unit_ends(text: str) -> list[int]:
    """Positions, from 1, of the last character of each sentence unit; none for blank text."""
    if not text.strip():
        return []
    if not text.isascii() and _ANY_SPACELESS.search(text):
        letters = sum(map(str.isalpha, text))
        for script, one in _SPACELESS.items():
            if 2 * len(one.findall(text)) > letters:
                return _spaceless(text, script)
    return _spaced(text)


def units(df: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """(id, sentence_no, start_pos, end_pos, sentence) of every text, in order; null and blank texts have none."""
    kind = dict(df.dtypes)[id_col]

    def run(rows):
        for i, t in rows:
            if not t:
                continue
            at = 0
            for n, e in enumerate(unit_ends(t), 1):
                while at < e and t[at].isspace():
                    at += 1
                yield i, n, at + 1, e, t[at:e]
                at = e

    return flat_map(df.select(id_col, text_col), run, f"`{id_col}` {kind}, sentence_no int, start_pos int, end_pos int, sentence string")


def units_of(df: DataFrame, chosen: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """Sentence units of the rows whose id stands in ``chosen``; few ids are sent to every task, many are joined by shuffle."""
    ids = hand_over(checkpoint(chosen.select(id_col).where(F.col(id_col).isNotNull()).distinct()))
    return units(df.join(ids, id_col, "left_semi"), id_col, text_col)
