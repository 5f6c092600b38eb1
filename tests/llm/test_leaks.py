import random

from tintero import runtime
from tintero.llm import leaks


def brute(text, items):
    t = leaks.words(text)
    out = set()
    for i, x in items:
        w = leaks.words(x)
        cover = set()
        for p in range(len(w) - 7):
            if any(t[q : q + 8] == w[p : p + 8] for q in range(len(t) - 7)):
                cover.update(range(p, p + 8))
        if w and len(cover) / len(w) >= 0.5:
            out.add(i)
    return out


def test_search_against_brute_force():
    r = random.Random(4)
    vocab = [f"w{k}" for k in range(12)]
    for _ in range(60):
        items = [(i, " ".join(r.choices(vocab, k=r.randint(5, 30)))) for i in range(6)]
        text = " ".join(r.choices(vocab, k=40))
        i, x = r.choice(items)
        w = x.split()
        text += " " + " ".join(w[r.randint(0, 3) :]) + " " + " ".join(r.choices(vocab, k=20))
        assert {a for a, _, _ in leaks.Patterns(items).leaked(text)} == brute(text, items)


def test_alterations_do_not_matter():
    item = "El síndico saliente pidió congelar los peajes del vado según la costumbre local del pueblo"
    p = leaks.Patterns([(1, item)])
    for t in [item.upper(), f"<p><b>El</b> {item[3:]}</p>", item.replace(" ", "\n"), item.replace("í", "&iacute;"), "x " + item.replace(" ", ", ") + " y", item.replace("congelar", "conge-\nlar")]:
        assert [a for a, _, _ in p.leaked(t)] == [1], t
    assert not list(p.leaked(item[:30])) and not list(p.leaked(""))


def test_table(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "uno dos tres cuatro cinco seis siete ocho nueve", "s"), (2, None, "s"), (3, "", "s"), (1, "uno dos tres cuatro cinco seis siete ocho nueve", "s")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(7, "x", "uno dos tres cuatro cinco seis siete ocho"), (7, "x", "uno dos tres cuatro cinco seis siete ocho"), (8, "x", None), (9, "x", "uno dos"), (10, "y", "dos tres cuatro cinco seis siete ocho nueve diez")], "item_id bigint, suite string, text string")
    want = {(1, 7), (1, 10)}
    assert {(r["doc_id"], r["item_id"]) for r in leaks.leaked_documents(docs, items).collect()} == want
    monkeypatch.setattr(runtime, "HAND_OVER", 0)
    got = leaks.leaked_documents(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == 2
    assert leaks.leaked_documents(docs, items.limit(0)).count() == 0 and leaks.leaked_documents(docs.limit(0), items).count() == 0


def test_the_same_by_join(spark, monkeypatch):
    """Beyond the size that is handed over, the hashed tables and the join give the same rows, shares and stretches."""
    r = random.Random(11)
    vocab = [f"w{k}" for k in range(14)]
    items = [(i, "s", " ".join(r.choices(vocab, k=r.randint(5, 40)))) for i in range(40)]
    docs = []
    for i in range(80):
        w = items[r.randrange(40)][2].split()
        a = r.randint(0, 4)
        docs.append((i % 70, " ".join(r.choices(vocab, k=20) + w[a : a + 18] + r.choices(vocab, k=5) + w[a + 18 :])))
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, suite string, text string")
    want = sorted(map(tuple, leaks.leaked_documents(d, i).collect()))
    assert {(a, b) for a, b, _, _ in want} == {(k, x) for k, t in docs for x in brute(t, [(a, c) for a, _, c in items])}
    monkeypatch.setattr(runtime, "HAND_OVER", 0)
    monkeypatch.setattr(leaks, "SLOTS", 6)
    assert sorted(map(tuple, leaks.leaked_documents(d, i).collect())) == want
