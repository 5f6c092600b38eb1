import random

from tintero.llm import mixing as m


def test_pivots_keep_the_sum():
    r = random.Random(3)
    for n in (1, 2, 7, 500):
        u = [(i, r.random()) for i in range(n)]
        done, left = m.pivot_round(u)
        ones = sum(v for _, v in done)
        assert {v for _, v in done} <= {0, 1} and len(done) + (left is not None) == n
        assert abs(ones + (left[1] if left else 0) - sum(p for _, p in u)) < 1e-6
        assert m.pivot_round(u) == (done, left)


def test_means_are_kept():
    hits = [0] * 6
    for k in range(3000):
        for i, v in m.pivot_round([(f"{k}-{i}", 0.5) for i in range(6)])[0]:
            hits[int(i.split("-")[1])] += v
    assert all(abs(h / 3000 - 0.5) < 0.05 for h in hits)


def test_mix(spark, monkeypatch):
    rows = [(i, "uno dos tres " * (1 + i % 5), " A " if i % 3 else "b", "k") for i in range(300)] + [(900, None, "a", "k"), (901, "x", None, "k"), (902, "y", "  ", "k"), (903, "", "b", "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, tokens string")
    w = spark.createDataFrame([("A", 0.2, 1), ("b", 0.7, 2), ("c", 0.1, 3)], "source string, target_share double, max_repeats int")
    monkeypatch.setattr(m, "BUCKET", 10)
    monkeypatch.setattr(m, "FAN_IN", 3)
    out = m.mix(docs, w).collect()
    assert len(out) == 302 and {r["source"] for r in out} == {"a", "b"}
    a = [r["copies"] for r in out if r["source"] == "a"]
    assert set(a) <= {0, 1} and max(r["copies"] for r in out) <= 2
    sh = {r["source"]: r for r in m.shares(docs, w).collect()}
    used, total = sum(r["tokens"] * r["copies"] for r in out), sum(r["tokens"] for r in out)
    assert abs(sum(r["actual_share"] for r in sh.values()) - 1) < 1e-9 and sum(r["used_tokens"] for r in sh.values()) == used
    # b and c are at their caps; what they lack is handed on to a, so that the mix has its size.
    assert [sh[k]["short"] for k in ("A", "b", "c")] == [False, True, True] and abs(used - total) < 0.05 * total
    assert {r["source"] for r in m.short_sources(docs, w).collect()} == {"b", "c"}
    p = {r["source"]: r for r in m.plan(m.token_counts(docs), w).collect()}
    assert abs(sum(a) - p["a"]["copies_expected"] * len(a)) <= 1
    assert m.mix(docs.limit(0), w).count() == 0


def test_shares_are_kept(spark):
    """Sources that are no caps' prey have their share of a mix of full size; a short source's tokens go to the others by their shares."""
    r = random.Random(5)
    rows = [(i, "uno dos tres cuatro " * r.randint(1, 60), "abcd"[min(i % 10, 3)]) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    w = spark.createDataFrame([("a", 0.4, 2), ("b", 0.2, 5), ("c", 0.1, 5), ("d", 0.3, 5)], "source string, target_share double, max_repeats int")
    sh = {r["source"]: r for r in m.shares(docs, w).collect()}
    assert [k for k, r in sh.items() if r["short"]] == ["a"] == [r["source"] for r in m.short_sources(docs, w).collect()]
    left = 1 - sh["a"]["share_of_size"]
    for k, share in (("b", 0.2), ("c", 0.1), ("d", 0.3)):
        assert abs(sh[k]["share_of_size"] - left * share / 0.6) < 0.002
    assert abs(sum(x["share_of_size"] for x in sh.values()) - 1) < 0.005


def test_short_sources_come_from_the_mix(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "uno dos", "ab"[i % 5 == 0]) for i in range(50)], "doc_id bigint, text string, source string")
    w = spark.createDataFrame([("a", 0.4, 3), ("b", 0.6, 2)], "source string, target_share double, max_repeats int")
    assert [r["source"] for r in m.short_sources(docs, w).collect()] == ["b"]
    real = m._rounded
    monkeypatch.setattr(m, "_rounded", lambda *a: real(*a).withColumn("copies", m.F.lit(0)))
    assert m.short_sources(docs, w).count() == 0
