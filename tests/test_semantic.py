import datetime
import itertools

import pytest
from pyspark.sql import functions as F

from spansense.errors import DefinitionError, EvaluationFailed, InputError, PlanMismatch
from spansense.operators.judge import KeywordJudge, ScriptedJudge
from spansense.semantic import Band, Predicate, Relation, bind, evaluate, explain, failed_remedy, field, gap, kleene_or, needed, sequence
from spansense.semantic.sequence import Limits, prior_turns

JUDGE = KeywordJudge({"bad": ["bad"], "unsure": ["maybe"]}, hit=0.95, miss=0.03)
BAD = Predicate("bad", "is it bad", {"text": "text"})


def test_truth_tables(spark):
    values = [True, None, False]
    df = spark.createDataFrame([(a, b) for a in values for b in values], "a boolean, b boolean")
    for r in df.select("a", "b", (F.col("a") & F.col("b")).alias("c"), (F.col("a") | F.col("b")).alias("d"), (~F.col("a")).alias("n")).collect():
        rank = {False: 0, None: 1, True: 2}
        back = {v: k for k, v in rank.items()}
        assert r["c"] == back[min(rank[r["a"]], rank[r["b"]])] and r["d"] == back[max(rank[r["a"]], rank[r["b"]])] and r["n"] == back[2 - rank[r["a"]]]


def test_guards_spare_the_judge(spark):
    asked = spark.sparkContext.accumulator(0)

    def handler(state, question):
        asked.add(1)
        return 0.95 if "bad" in state else 0.5

    df = spark.createDataFrame([(1, "bad", 5), (2, "bad", 50), (3, "so so", 50), (4, "so so", 50)], "id int, text string, n int")
    rows = {r["id"]: (r["outcome"], r["asked"]) for r in evaluate(field("n").gt(10) & BAD, df, ScriptedJudge(handler)).collect()}
    assert rows == {1: (False, 0), 2: (True, 1), 3: (None, 1), 4: (None, 1)}
    assert asked.value == 2  # equal states are asked once
    either = {r["id"]: r["outcome"] for r in evaluate(BAD | ~BAD, df, ScriptedJudge(handler)).collect()}
    assert either == {1: True, 2: True, 3: None, 4: None}


def test_types_are_strict(spark):
    df = spark.createDataFrame([(1, "1", True, None)], "i int, s string, b boolean, t timestamp")
    test = lambda e: evaluate(e, df, JUDGE).first()["outcome"]
    assert test(field("i").eq(1)) and not test(field("i").eq("1")) and not test(field("i").eq(True)) and not test(field("i").eq(1.0))
    assert test(field("b").eq(True)) and not test(field("b").eq(1)) and test(field("s").one_of(["0", "1"])) and test(field("t").eq(None)) and test(field("t").exists()) and not test(field("zz").exists())
    with pytest.raises(InputError):
        test(field("s").lt(3))
    with pytest.raises(DefinitionError):
        field("s").one_of("ab")
    with pytest.raises(InputError):
        field("t").lt(datetime.datetime(2026, 1, 1))


def test_definitions():
    with pytest.raises(DefinitionError):
        Band(0.9, 0.1)
    with pytest.raises(DefinitionError):
        sequence(gap(1), BAD.capture("a"))
    with pytest.raises(DefinitionError):
        sequence(BAD.capture("a"), BAD.capture("a"))
    with pytest.raises(DefinitionError):
        gap(101)
    with pytest.raises(TypeError):
        bool(BAD)


def test_pruning_never_changes_outcomes(spark):
    df = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(itertools.product(["bad", "fine"], [1, 20]))], "id int, text string, n int")
    other = Predicate("unsure", "is it unsure", {"text": "text"})
    many = field("n").gt(10)
    cases = [
        (many & BAD, lambda b, n: n > 10 and b),
        (many | BAD, lambda b, n: n > 10 or b),
        (~(many & (BAD | other)), lambda b, n: not (n > 10 and b)),
        ((BAD & other) | field("n").eq(1), lambda b, n: n == 1),
    ]
    for e, plain in cases:
        assert set(needed(e, df.schema)) <= {BAD.digest(), other.digest()}
        for r in evaluate(e, df, JUDGE).collect():
            assert r["outcome"] == plain(r["text"] == "bad", r["n"])


@pytest.mark.parametrize("width", [0, 1, 3])
def test_sequences_match_nested_loops(spark, width):
    strings = ["".join(p) for p in itertools.product("ab", repeat=5)]
    rows = [(f"{s}{i}", s, i, c) for s in strings for i, c in enumerate(s)]
    df = spark.createDataFrame(rows, "key string, g string, i int, role string")
    step = lambda n, r: field("role").eq(r).capture(n)
    pattern = sequence(step("x", "a"), gap(width), step("y", "b"), gap(width), step("z", "a")).group_by("g")
    got = {(r["x"], r["y"], r["z"]) for r in pattern.match(df, "key", ["i"], JUDGE, day=F.floor(F.col("i") / 2)).collect()}
    want = {
        (f"{s}{i}", f"{s}{j}", f"{s}{k}") for s in strings for i in range(5) for j in range(i + 1, min(5, i + 2 + width)) for k in range(j + 1, min(5, j + 2 + width)) if s[i] + s[j] + s[k] == "aba"
    }
    assert got == want


def test_windows_relations_and_limits(spark):
    at = lambda h: datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(hours=h)
    rows = [(1, None, at(0), "bad"), (2, None, at(1), "fine"), (3, None, at(30), "fine"), (4, "g", at(0), "fine")]
    df = spark.createDataFrame(rows, "key int, g string, at timestamp, text string")
    pattern = sequence(BAD.capture("a"), gap(5), (~BAD).capture("b")).group_by("g").within(datetime.timedelta(hours=1), "at")
    assert [(r["a"], r["b"], r["outcome"]) for r in pattern.match(df, "key", ["at"], JUDGE).collect()] == [(1, 2, True)]
    unsure = pattern.require(Relation("same", "do they agree", "text", "text").between("a", "b"))
    rows = unsure.match(df, "key", ["at"], ScriptedJudge(lambda s, q: 0.5 if "left" in s else (0.95 if s == "bad" else 0.03))).collect()
    assert [r["outcome"] for r in rows] == [None]
    assert pattern.presence(pattern.match(df, "key", ["at"], JUDGE)).first()["outcome"] is True
    from spansense.errors import CandidateLimitExceeded

    with pytest.raises(CandidateLimitExceeded):
        pattern.match(df, "key", ["at"], JUDGE, limits=Limits(candidates=0))
    with pytest.raises(InputError):
        pattern.check(df.union(df), "key")


def test_kleene_or(spark):
    df = spark.createDataFrame([(1, False), (1, None), (2, False), (3, None), (3, True)], "k int, o boolean")
    assert {r["k"]: r["o"] for r in df.groupBy("k").agg(kleene_or(F.col("o")).alias("o")).collect()} == {1: None, 2: False, 3: True}


@pytest.fixture
def chat(spark):
    rows = [("m1", "t", 0, "customer", "the lamp is broken"), ("m2", "t", 1, "agent", "please restart the lamp"), ("m3", "t", 2, "customer", "it is still dark"), ("m4", "t", 3, "customer", "still dark, as I said")]
    return spark.createDataFrame(rows, "id string, ticket_id string, n int, speaker string, text string").withColumn("time", F.timestamp_seconds(F.col("n") * 60))


def _chat_judge(same=lambda state: 0.95):
    import json as j

    def handler(text, question):
        if question.startswith("Do both"):
            return same(j.loads(text))
        words = {"report": "broken", "remedy": "restart", "persists": "still"}
        return 0.95 if any(w in question and hit in text for w, hit in words.items()) or question.startswith("Is the second") else 0.03

    return ScriptedJudge(handler)


def test_failed_remedy(spark, chat):
    # the relation sees the problem, the complaint and, by reference, the remedy between them
    judge = _chat_judge(lambda s: 0.95 if (s["left"], s["context"]["remedy"]) == ("the lamp is broken", "please restart the lamp") else 0.03)
    rows = failed_remedy().match(chat, "id", ["time", "id"], judge).orderBy("persists").collect()
    assert [(r["problem"], r["remedy"], r["persists"], r["outcome"]) for r in rows] == [("m1", "m2", "m3", True), ("m1", "m2", "m4", True)]
    assert failed_remedy().match(chat, "id", ["time", "id"], _chat_judge(lambda s: 0.03)).collect() == []


def test_runs_and_reports(spark, chat):
    pattern, judge, order = failed_remedy(), _chat_judge(), ["time", "id"]
    whole = pattern.run(chat, "id", order, judge)
    assert whole.complete and whole.outcome is True and whole.coverage.first()["accepted"] == 2
    first = pattern.run(chat, "id", order, judge, limits=Limits(results=1, truncate=True))
    assert first.truncated and not first.complete and first.outcome is None and [r["persists"] for r in first.matches.collect()] == ["m3"] and first.issues
    with pytest.raises(EvaluationFailed) as failed:
        pattern.run(chat, "id", order, judge, limits=Limits(results=1))
    assert failed.value.partial.outcome is None
    twice = chat.unionByName(chat)
    kept = pattern.run(twice, "id", order, judge, errors="collect")
    assert not kept.complete and kept.outcome is None and "isn't unique" in kept.issues[0]
    backwards = pattern.run(chat.withColumn("time", F.timestamp_seconds(-F.col("n"))), "id", ["id"], judge, errors="collect")
    assert not backwards.complete and "fall along" in backwards.issues[0]
    plan = pattern.plan(chat, "id", order, judge)
    assert {r["name"]: r["records"] for r in plan.describe().collect()} == {"problem": 3, "remedy": 1, "persists": 3} and plan.candidates.count() == 4
    assert pattern.run(chat, "id", order, judge, plan=plan).complete
    with pytest.raises(PlanMismatch):
        pattern.run(chat, "id", order, judge, Band(0.2, 0.8), plan=plan)


def test_bind_and_explain(spark, chat):
    expr = field("speaker").eq("agent") | Predicate("p", "persists?", {"text": "text"}, criteria={"true": "it persists"})
    bound = bind(expr, chat, "id")
    assert bound.columns == ["key", "revision", "speaker", "text", "digest"] and bound.select("digest").distinct().count() == 4
    rows = {r["key"]: (r["p"], r["outcome"], r["near_edge"]) for r in explain(expr, chat, "id", _chat_judge()).collect()}
    assert rows == {"m1": (0.03, False, False), "m3": (0.95, True, True), "m4": (0.95, True, True)}
    with pytest.raises(InputError):
        bind(field("nothing").lt(3), chat, "id")
    with pytest.raises(DefinitionError):
        Predicate("p", "q", {"t": "text"}, criteria={"maybe": "x"})


def test_prior_turns_by_days_and_in_one_window(spark):
    rows = [(f"g{i % 2}" if i % 7 else None, i, "a" if i % 3 else None, f"t{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "g string, n int, who string, what string")
    want = {r["n"]: r["prior"] for r in prior_turns(df, "g", ["n"], "who", "what").collect()}
    assert {r["n"]: r["prior"] for r in prior_turns(df, "g", ["n"], "who", "what", day=F.floor(F.col("n") / 10)).collect()} == want
