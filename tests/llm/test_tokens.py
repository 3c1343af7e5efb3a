import hashlib
import os
import random

import numpy as np
import pytest

from spansense.llm import mixing, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}"), reason="no vocabulary here")


@pytest.fixture(scope="module")
def words():
    return tokens.Words(tokens.encoding(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}"))


def test_joined_chunks_equal_the_whole(words):
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice("ab '  \n\tllvre's1٣é漢😀.,!?- DLL") for _ in range(rng.randint(0, 40)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text), rng.randint(0, 6))))
        parts = [tokens.encode_chunk(words.enc, text[i:j]) for i, j in zip([0, *cuts], [*cuts, len(text)])]
        assert tokens.join_chunks(words, parts) == words.enc.encode_ordinary(text), (text, cuts)


def test_cuts_follow_the_content():
    rng = np.random.default_rng(0)
    block = rng.integers(97, 123, 20000, dtype=np.uint8)
    a = set(tokens.cut_points(block).tolist())
    b = {p - 777 for p in tokens.cut_points(np.concatenate([block[:777], block])).tolist()}
    assert len({p for p in a if p > 20} - b) == 0
    ends = tokens.chunk_bounds(len(block), tokens.cut_points(block), block)
    assert ends[-1] == len(block) and all(y - x >= tokens.LEAST for x, y in zip(ends, ends[1:-1]))


def test_ids(spark, words):
    shared = "The same passage stands in many texts, word for word, and is encoded once. " * 30
    texts = ["", None, " ", shared, "x" + shared, shared + "<|endoftext|>", "é" * 5000, "a", "a"]
    df = spark.createDataFrame(list(enumerate(texts[:-1])) + [(7, "a")], "doc_id bigint, text string").withColumnRenamed("none", "none")
    got = sorted((r["doc_id"], r["ids"]) for r in tokens.p6_ids(df).collect())
    assert got == sorted((min(i, 7), words.enc.encode_ordinary(t or "")) for i, t in enumerate(texts))
    assert tokens.p6_ids(df.where("false")).collect() == []


def test_schedule_stays_within_a_block():
    rng = random.Random(3)
    for _ in range(30):
        shares = {f"s{i}": rng.random() + 0.001 for i in range(rng.randint(1, 9))}
        slots = mixing.slots_of(shares, 1000)
        plan = mixing.pfair_schedule(slots)
        assert sum(slots.values()) == len(plan) == 1000 and mixing.deviation(plan, slots) < 1
        for s, n in slots.items():
            assert [j for x, j in plan if x == s] == list(range(n))


def test_mix(spark):
    docs = [(i, "a", "word " * 10) for i in range(60)] + [(100 + i, "b", "word " * 10) for i in range(10)] + [(200, "c", None), (201, None, "x"), (202, "d", "y")]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3), ("c", 0.2, 2), ("e", 0.1, None)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix(df, targets, period=100, block_tokens=50)
    got = {r["source"]: r for r in report.collect()}
    assert got["a"]["reached_share"] == pytest.approx(0.5, abs=0.02) and got["b"]["most_repeats"] == 3 and got["b"]["occurrences"] == 30 and got["c"]["tokens"] == 0 and got["e"]["reached_share"] == 0
    assert mixed.where("token_from = 0").groupBy("doc_id").count().where("count > 3").isEmpty()
    assert mixing.mix(df.where("false"), targets)[0].collect() == []


def test_no_source_is_dropped(spark):
    slots = mixing.slots_of({"a": 0.99996, "b": 0.00004}, mixing.period_of({"a": 0.99996, "b": 0.00004}))
    assert slots == {"a": 999_960, "b": 40}
    with pytest.raises(ValueError, match="shares go down"):
        mixing.period_of({"a": 1.0, "b": 1e-9})
    many = {f"s{i}": 1.0 for i in range(7)} | {"t": 0.0002}
    assert all(mixing.slots_of(many, mixing.period_of(many)).values())


def test_stated_size():
    have, targets = {"a": 10**9, "b": 1_000}, {"a": (0.9, 1), "b": (0.1, 2)}
    assert sum(mixing.plan_mix(have, targets)[1].values()) == pytest.approx(20_000)
    quotas = mixing.plan_mix(have, targets, total=500_000)[1]
    assert quotas["b"] == pytest.approx(2_000, rel=0.02) and sum(quotas.values()) == pytest.approx(500_000, rel=0.02)
    assert sum(mixing.plan_mix({"a": 10, "b": 10}, targets, total=10**6)[1].values()) == pytest.approx(30, rel=0.1)


def test_long_documents_are_cut_into_blocks(spark):
    docs = [(1, "a", "word " * 5000), (2, "a", "word " * 7)] + [(10 + i, "b", "word " * 300) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    mixed, _ = mixing.mix(df, targets, block_tokens=100)
    rows = mixed.collect()
    per = {}
    for r in rows:
        per[r["source"], r["block"]] = per.get((r["source"], r["block"]), 0) + r["tokens"]
    assert all(n == 100 for (s, b), n in per.items() if (s, b + 1) in per)
    assert len({r["slot"] for r in rows}) == len(per)
    first = sorted((r["token_from"], r["tokens"]) for r in rows if r["doc_id"] == 1)
    assert all(a + n == b for (a, n), (b, _) in zip(first, first[1:])) and first[0][0] == 0
    assert all(r["deviation"] < 1.5 for r in mixing.measured_deviation(mixed, block_tokens=100).collect())
    assert all(all(r[1:]) for r in mixing.mix_checks(df, targets).collect())


def test_ids_decode_to_the_texts(spark):
    texts = ["", None, "é" * 3000, "<|endoftext|> and more", "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["digest"] for r in tokens.decoded(tokens.p6_ids(df)).collect()} == want
    assert {r["doc_id"]: r["tokens"] for r in tokens.token_counts(df).collect()} == {r["doc_id"]: len(r["ids"]) for r in tokens.p6_ids(df).collect()}


def test_hot_chunks_are_spread_and_kept_whole(spark, words):
    """A text that a third of the rows share goes to several tasks; every row comes out once, also with clashing columns."""
    df = spark.createDataFrame([(i, "the same notice again" if i % 3 == 0 else f"text {i}", i) for i in range(3000)], "doc_id bigint, text string, row bigint")
    rows = {r["doc_id"]: r["ids"] for r in tokens.p6_ids(df).collect()}
    assert len(rows) == 3000 and all(rows[i] == words.enc.encode_ordinary("the same notice again") for i in range(0, 3000, 3)) and rows[1] == words.enc.encode_ordinary("text 1")


def test_cuts_of_a_block_are_those_of_each_text():
    rng = np.random.default_rng(4)
    raws = [rng.integers(97, 110, int(n), dtype=np.uint8).tobytes() for n in rng.integers(0, 9000, 60)] + [b"", b"x" * 300]
    for raw, (data, cuts) in zip(raws, tokens.cuts_of(raws), strict=True):
        own = np.frombuffer(raw, np.uint8)
        assert data.tobytes() == raw and tokens.chunk_bounds(len(raw), cuts, data) == tokens.chunk_bounds(len(raw), tokens.cut_points(own), own)
