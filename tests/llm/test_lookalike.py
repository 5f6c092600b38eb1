import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from tintero.llm import lookalike
from tintero.llm.canonical import _PLANES, _SPACE, _segment, _unstable, canonical

ALPHABET = "aeo nN.°º\n-́̃ñáéΟоаеСｏＡﬁ​\xad  ²½Жя"


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=40))
def test_idempotent_and_local(text):
    c = canonical(text)
    assert canonical(c) == c
    assert unicodedata.is_normalized("NFC", c)
    # Words are canonical one by one: splicing segments equals normalising every word.
    assert c == "\n".join(canonical(x) for x in text.split("\n")) or "\n" in text and any(unicodedata.combining(x[:1] or "a") for x in text.split("\n"))


def test_what_shows_and_what_does_not():
    same = [("é", "é"), ("Ａ１％", "A1%"), ("ﬁn", "fin"), ("a b", "a b"), ("co​n\xadsejo", "consejo"), ("Сonsejo", "Consejo"), ("N.º 3", "N.° 3"), ("gοbierno", "gobierno")]
    for a, b in same:
        assert canonical(a) == canonical(b), (a, b)
    for a, b in [("a", "A"), ("é", "e"), ("1", "2"), ("a\nb", "a b"), ("a-b", "a—b"), ("²", "2"), ("a.", "a")]:
        assert canonical(a) != canonical(b), (a, b)
    assert canonical("Москва") == "Москва" and canonical(None) is None and canonical("") == ""


def test_pairs_against_brute_force(spark):
    texts = ["hola N.º 1", "hola N.° 1", "hola N.° 1", "Hola N.° 1", None, None, "", "", "а", "a", "a​", "x" * 100_000, "x" * 99_999 + "ｘ"]
    rows = [(i, t, "q") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "page_id bigint, text string, look string")
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and a is not None and b is not None and a != b and canonical(a) == canonical(b)}
    got = {(r[0], r[1]) for r in lookalike.lookalike_pairs(df).collect()}
    assert got == want and want
    assert lookalike.lookalike_pairs(df.limit(0)).count() == 0
    out = {r["page_id"]: (r["canonical"], r["changed"]) for r in lookalike.canonical_text(df).collect()}
    assert out[0] == ("hola N.° 1", True) and out[1] == ("hola N.° 1", False) and out[4] == (None, False)


def test_agrees_with_normalisation_on_all_code_points():
    """Composed and decomposed forms are equal for every code point, alone and between letters; so are conjoining pairs."""
    nfd, nfc = (lambda t: unicodedata.normalize("NFD", t)), (lambda t: unicodedata.normalize("NFC", t))
    for cp in _PLANES:
        ch = chr(cp)
        assert canonical(nfd(ch)) == canonical(nfc(ch)), hex(cp)
        if nfd(ch) != ch:
            assert canonical("a" + nfd(ch) + "b") == canonical("a" + nfc(ch) + "b"), hex(cp)
    for a, b in [("\u1100\u1161", "\uac00"), ("\u09c7\u09be", "\u09cb"), ("\U0002f800", nfc("\U0002f800")), ("\u2194\u0338", "\u21ae"), ("\U00011131\U00011127", "\U0001112e")]:
        assert canonical(a) == canonical(b), a


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from([chr(c) for c in _PLANES if _unstable(c)][::7] + list("abcxyz  .,;-éñ\nকী가한Жλ")), max_size=14))
def test_splicing_equals_normalising_everything(text):
    assert canonical(text) == "".join(_segment.__wrapped__(w) for w in _SPACE.split(text))
    assert canonical(unicodedata.normalize("NFD", text)) == canonical(unicodedata.normalize("NFC", text))


def test_tables_agree_with_the_function(spark):
    """The share done in the JVM gives the same as the function, text by text."""
    texts = [ALPHABET[i:] + ALPHABET[:i] for i in range(len(ALPHABET))] + ["plano", "ñandú N.º 1\xa02", "a\u200bb\xadc", "\u1100\u1161", "日本語 テキスト", "“citas” — …", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "page_id int, text string")
    got = {r["page_id"]: r["canonical"] for r in lookalike.canonical_text(df).collect()}
    assert got == {i: canonical(t) for i, t in enumerate(texts)}


def test_classes_against_brute_force(spark):
    texts = ["hola N.º 1", "hola N.° 1", "hola N.° 1", "Hola N.° 1", None, "", "", "а", "a", "a\u200b"]
    df = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "page_id bigint, text string, look string")
    want = {}
    for i, a in enumerate(texts):
        links = [b for b in texts if a is not None and b is not None and a != b and canonical(a) == canonical(b)]
        if links:
            want[i] = (len({a, *links}), len(links))
    got = lookalike.lookalike_classes(df).collect()
    assert {r["page_id"]: (r["n_texts"], r["n_links"]) for r in got} == want and len({r["class_id"] for r in got}) == 2
    assert lookalike.lookalike_classes(df.limit(0)).count() == 0
