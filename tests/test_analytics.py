import math
import random

import pytest
from pyspark.sql import functions as F

from spansense import runtime
from spansense.operators import analytics as A
from spansense.operators.components import connected_components, star_edges
from spansense.runtime import running_total


def test_components_match_union_find(spark, monkeypatch):
    rng = random.Random(3)
    members = [(f"k{rng.randrange(400)}", f"n{rng.randrange(300):03d}") for _ in range(420)] + [("hot", f"n{i:03d}") for i in range(0, 300, 7)] + [("one", None), ("chain", "z1")]
    members += [(f"c{i}", f"p{j:03d}") for i in range(200) for j in (i, i + 1)]  # a path of 201 nodes
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    first = {}
    for k, n in members:
        if n is not None:
            a, b = find(first.setdefault(k, n)), find(n)
            parent[max(a, b)] = min(a, b)
    groups = {}
    for n in parent:
        groups.setdefault(find(n), []).append(n)
    want = {(n, r) for r, ns in groups.items() if len(ns) > 1 for n in ns}
    df = spark.createDataFrame(members, "k string, n string")
    # with the label graphs merged in one task or level by level, and with hot keys looked up apart
    for small_graph, hot_rows in ((500_000, 10**9), (0, 10**9), (50, 1)):
        monkeypatch.setattr(runtime, "HOT_ROWS", hot_rows)
        assert {tuple(r) for r in connected_components(star_edges(df, ["k"], "n"), small_graph=small_graph).collect()} == want
    texts = [(i, k) for i, k in enumerate("aabbbcde")] + [(20, None)]
    groups = A.components_by_key(spark.createDataFrame(texts, "id int, text string"), "id", ["text"])
    assert sorted(map(tuple, groups.collect())) == [(0, 0), (1, 0), (2, 2), (3, 2), (4, 2)]


def test_skew_join_gives_the_plain_join(spark, monkeypatch):
    big = spark.createDataFrame([("hot" if i % 3 == 0 else f"k{i % 40}", i) for i in range(600)] + [(None, -1)], "k string, i int")
    small = spark.createDataFrame([("hot", "h")] + [(f"k{i}", str(i)) for i in range(0, 30, 2)], "k string, v string")
    for how in ("inner", "left"):
        want = sorted(map(str, big.join(small, "k", how).collect()))
        monkeypatch.setattr(runtime, "HOT_ROWS", 1)
        assert sorted(map(str, runtime.skew_join(big, small, ["k"], how=how).select("k", "i", "v").collect())) == want


def test_no_edges_give_no_components(spark):
    empty = spark.createDataFrame([], "k string, n string")
    assert connected_components(star_edges(empty, ["k"], "n")).collect() == []
    loop = spark.createDataFrame([("a", "a"), (None, "b")], "src string, dst string")
    assert connected_components(loop).collect() == []


def test_running_total(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.randrange(1, 9)) for g in ("a", "b", None) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, i int, v bigint").withColumn("h", F.xxhash64("i"))
    got = running_total(df, ["g"], "h", ["i"], "v", "before", bucket_bits=3).collect()
    for g in ("a", "b", None):
        total = 0
        for r in sorted((r for r in got if r["g"] == g), key=lambda r: (r["h"], r["i"])):
            assert r["before"] == total
            total += r["v"]
    firsts = running_total(df.where("g = 'a'"), [], "h", ["i"], "v", "before", first=F.col("i") == 7).where("before = 0").select("i").collect()
    assert firsts == [(7,)]


def test_span_scores(spark):
    gold = spark.createDataFrame([(1, 0, 10), (1, 20, 30), (2, 0, 4)], "k int, start int, end int")
    found = spark.createDataFrame([(1, 0, 5), (1, 5, 12), (1, 22, 30), (2, 8, 9), (2, 50, 60)], "k int, start int, end int")
    neutral = spark.createDataFrame([(2, 50, 55)], "k int, start int, end int")
    r = A.span_scores(found, gold, "k", neutral).first()
    assert (r["gold"], r["covered"], r["leaked"], r["exact"], r["landed"], r["false_positives"]) == (3, 1, 2, 0, 3, 1)
    assert r["precision"] == 0.75 and r["recall"] == pytest.approx(1 / 3)


def test_percentiles(spark):
    xs = [random.Random(2).randrange(50) for _ in range(333)]
    df = spark.createDataFrame([(x,) for x in xs], "v int")
    s = sorted(xs)
    qs = [0.0, 0.5, 0.95, 1.0]
    assert {r["q"]: r["value"] for r in A.percentile_ranks(df, "v", qs).collect()} == {q: s[max(0, math.ceil(q * len(s)) - 1)] for q in qs}
    assert {r["q"]: r["value"] for r in A.percentile_ranks(df, "v", qs, nearest=False).collect()} == {q: s[min(len(s) - 1, math.floor(q * len(s)))] for q in qs}
    assert df.agg(A.percentile_ceil("v", 0.5).alias("a"), A.percentile_floor("v", 0.5).alias("b")).first() == (s[math.ceil(0.5 * len(s)) - 1], s[math.floor(0.5 * len(s))])
    assert df.where("v < 0").agg(A.percentile_floor("v", 0.5).alias("a")).first()["a"] is None


def test_scores(spark):
    df = spark.createDataFrame([(0.95, True, 1, "x"), (0.95, False, 1, "x"), (0.2, True, 2, "y"), (1.0, True, 2, "y")], "p double, gold boolean, k int, g string")
    r = A.binary_scores(df, F.col("p") >= 0.5, F.col("gold")).first()
    assert (r["n"], r["accuracy"], r["precision"], r["recall"]) == (4, 0.5, pytest.approx(2 / 3), pytest.approx(2 / 3))
    assert A.binary_scores(df.where("false"), F.col("p") >= 0.5, F.col("gold")).first()["accuracy"] == 1.0
    assert {r["bin"]: r["n"] for r in A.calibration(df, "p", F.col("gold")).collect()} == {9: 3, 2: 1}
    assert A.brier(df, "p", F.col("gold")).first()["brier"] == pytest.approx((0.05**2 + 0.95**2 + 0.8**2) / 4)
    assert A.risk_coverage(df, "p", F.col("gold"), (0.5, 0.9)).collect()[1]["coverage"] == 0.75
    c = A.capture_scores(df.select("k", "g"), df.where("k = 1").select("k", "g"), ["k", "g"]).first()
    assert (c["matched"], c["predicted"], c["gold"]) == (2, 4, 2)


def test_bootstrap_covers_the_score(spark):
    rng = random.Random(4)
    rows = [(i, int(rng.random() < 0.7), int(rng.random() < 0.2), int(rng.random() < 0.2)) for i in range(200)]
    r = A.bootstrap_f1(spark.createDataFrame(rows, "k int, tp int, fp int, fn int"), "k", "tp", "fp", "fn", 300).first()
    assert r["low"] < r["f1"] < r["high"] and r["high"] - r["low"] < 0.2


def test_palindromes_and_fingerprints(spark):
    df = spark.createDataFrame([("Abba!",), ("a b",), ("level",), ("abcba d",), ("x\r\ny",), ("x\ny",)], "t string")
    assert [r[0] for r in df.select(A.is_short_palindrome(F.col("t"))).collect()] == [True, False, True, False, False, False]
    prints = [r[0] for r in df.select(A.text_fingerprint(F.col("t"))).collect()]
    assert prints[4] == prints[5]


def test_label_validation(spark):
    records = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h3")], "id string, h string")
    labels = spark.createDataFrame([("a", "h1", "YES"), ("b", "old", "MAYBE"), ("z", "h", "NO"), ("a", "h1", "YES")], "id string, h string, presence string")
    got = {(r["key"], r["fault"]) for r in A.label_faults(labels, records, "id", {"presence": ["YES", "NO"]}, digest="h").collect()}
    assert got == {("a", "repeated"), ("z", "unknown"), ("c", "unlabelled"), ("b", "stale"), ("b", "presence")}
    other = spark.createDataFrame([("a", "YES"), ("b", None)], "id string, presence string")
    assert {tuple(r) for r in A.disagreements(labels.distinct(), other, "id", "presence").collect()} == {("b", "MAYBE", None), ("z", "NO", None)}
