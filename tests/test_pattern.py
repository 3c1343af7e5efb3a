import asyncio
import json

import pytest
from pyspark.sql import functions as F

from spansense.operators import pattern as P
from spansense.operators.engine import Backend, DecisionLists, Engine, EngineJudge, HttpJudge, backend_from_env, converse, one_model, requests_of_texts, stats
from spansense.operators.judge import ColumnJudge, KeywordJudge, LabelJudge, RecordedJudge, ScriptedJudge, decision_key
from spansense.operators.requests import pack_windows, requests_of, token_estimate, within_budget
from spansense.errors import BackendError, BudgetExceeded, CacheMiss, ConfigError, RequestLimitExceeded, UnsupportedCapability
from spansense.functions.questions import ANSWER, Box, Choice, Noul, Score
from spansense.plans import catalog
from spansense.runtime import checkpointed

JUDGE = KeywordJudge({"insult": ["fool", "rat"], "total": ["total due"], "urgent": ["now"]})


@pytest.fixture
def docs(spark):
    rows = [(1, "You fool.\nAll is well.\nA rat, indeed."), (2, "Nothing here."), (3, None), (4, ""), (5, "rat")]
    return spark.createDataFrame(rows, "doc_id int, text string")


def insults(**kw):
    return P.Pattern("is an insult", JUDGE, unit="line", **kw)


def test_findall_search_and_bands(docs):
    hits = insults().findall(docs).orderBy("doc_id", "ord").select("doc_id", "ord", "start", "text", "p", "band").collect()
    assert hits == [(1, 0, 0, "You fool.", 0.95, "yes"), (1, 2, 23, "A rat, indeed.", 0.95, "yes"), (5, 0, 0, "rat", 0.95, "yes")]
    assert insults().search(docs).orderBy("doc_id").select("doc_id", "text").collect() == [(1, "You fool."), (5, "rat")]
    assert insults().scan(docs).count() == 5
    assert insults(threshold=0.99).findall(docs).count() == 0


def test_prefilter_asks_only_what_passes(docs, spark):
    def handler(text, meaning):
        assert "rat" in text
        return 1.0

    rows = P.Pattern("x", ScriptedJudge(handler), unit="line", prefilter="rat").scan(docs)
    assert {(r["text"], r["p"]) for r in rows.collect()} == {("You fool.", 0.0), ("All is well.", 0.0), ("A rat, indeed.", 1.0), ("Nothing here.", 0.0), ("rat", 1.0)}


def test_sub_and_split(docs):
    out = {r["doc_id"]: (r["text"], r["n"]) for r in insults().subn("***", docs).collect()}
    assert out == {1: ("***\nAll is well.\n***", 2), 2: ("Nothing here.", 0), 3: (None, 0), 4: ("", 0), 5: ("***", 1)}
    one = {r["doc_id"]: r["text"] for r in insults().sub(lambda h: F.concat(F.lit("<"), h["unit"], F.lit(">")), docs, 1).collect()}
    assert one[1] == "<line>\nAll is well.\nA rat, indeed."
    same = {r["doc_id"]: r["text"] for r in insults().sub(lambda h: h["text"], docs).collect()}
    assert same == {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"]: r["pieces"] for r in insults().split(docs).collect()}[1] == ["All is well."]
    assert {r["doc_id"]: r["pieces"] for r in insults().split(docs, keep=True).collect()}[1] == ["You fool.", "All is well.", "A rat, indeed."]
    with pytest.raises(ValueError):
        insults().sub("x", docs, -1)


def test_diff(docs):
    rows = insults().diff("rat|well", docs).where("doc_id = 1").orderBy("ord").collect()
    assert [r["side"] for r in rows] == ["meaning_only", "regex_only", "agree"]
    extra = P.Pattern("is an insult", JUDGE, unit="email").diff("fool", docs).where("doc_id = 1").collect()
    assert [(r["unit"], r["text"], r["side"]) for r in extra] == [("regex", "fool", "agree")]


def test_collections(docs):
    assert [r["doc_id"] for r in P.Pattern("is an insult", JUDGE).rank(docs, "doc_id").collect()] == [1, 5, 2, 4, 3]
    assert {r["doc_id"] for r in P.Pattern("is an insult", JUDGE).filter(docs).collect()} == {1, 5}
    assert {r["doc_id"]: r["matched"] for r in P.Pattern("is an insult", JUDGE).test(docs).collect()} == {1: True, 2: False, 3: None, 4: False, 5: True}


def test_typed(spark):
    df = spark.createDataFrame([(1, "pay $5 subtotal, then total due $12 now")], "doc_id int, text string")
    assert P.classify(df, ["a", "b"], LabelJudge({"a": ["zzz"], "b": []})).first()["pick"]["label"] == "b"
    r = P.rate(df, "how urgent", ["low", "mid", "high"], JUDGE).first()["rating"]
    assert (r["level"], r["label"], r["score"]) == (2, "high", 2.0)
    with pytest.raises(TypeError):
        P.classify(df, "ab", JUDGE)


def test_settings_are_checked():
    for kw in ({"threshold": 2}, {"question": "no place"}, {"unit": "nope"}):
        with pytest.raises(ValueError):
            P.Pattern("m", JUDGE, **kw)
    with pytest.raises(ValueError):
        P.Pattern("  ", JUDGE)


def test_recorded_judge(spark, docs):
    lines = insults().scan(docs).select("doc_id", "text")
    known = JUDGE.score(lines, "is an insult").select(decision_key(F.lit("is an insult"), F.col("text"), model="m").alias("key"), "p")
    replay = RecordedJudge(known, model="m")
    assert sorted(replay.score(lines, "is an insult").select("text", "p").collect()) == sorted(JUDGE.score(lines, "is an insult").select("text", "p").collect())
    with pytest.raises(Exception, match="no recorded decision"):
        replay.score(lines, "another meaning").collect()
    assert RecordedJudge(known.limit(1), model="m", live=JUDGE).score(lines, "is an insult").count() == lines.count()
    assert replay.misses(lines, "another meaning").count() == lines.select("text").distinct().count()


def test_recorded_decisions_are_joined_without_broadcast(spark, docs):
    lines = insults().scan(docs).select("doc_id", "text")
    key = decision_key(F.lit("is an insult"), F.col("text"), model="m").alias("key")
    # one row is recorded with a probability of its own and one with none, the others are asked
    known = spark.range(2).select(F.when(F.col("id") == 0, F.lit("rat")).otherwise(F.lit("You fool.")).alias("text"), F.when(F.col("id") == 0, F.lit(0.2)).alias("p")).select(key, "p")
    wanted = [(1, "A rat, indeed.", 0.95), (1, "All is well.", 0.03), (1, "You fool.", None), (2, "Nothing here.", 0.03), (5, "rat", 0.2)]
    for live in (JUDGE, ColumnJudge(JUDGE.expression), ScriptedJudge(lambda t, q: 0.95 if "rat" in t else 0.03)):
        got = RecordedJudge(known, model="m", live=live).score(lines, "is an insult")
        assert got.columns == ["doc_id", "text", "p"]
        assert [tuple(r) for r in sorted(got.collect(), key=lambda r: r[:2])] == wanted
        assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    misses = RecordedJudge(known, model="m").misses(lines, "is an insult")
    assert {r["text"] for r in misses.collect()} == {"A rat, indeed.", "All is well.", "Nothing here."}
    assert "BroadcastHashJoin" not in misses._jdf.queryExecution().executedPlan().toString()


def test_recorded_lines_read_texts_once_a_side(spark, tmp_path):
    rows = [(1, "All is well.\nRefund me.\nAll is well."), (2, "Refund me.\n\nAll is well."), (3, None), (4, " \n"), (5, "I was charged twice")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["recorded_lines"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 3), (2, 1, 2), (5, 1, 1)]
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin" not in plan and plan.count("ArrowEvalPython") == 2


def test_extract(spark):
    rows = [(1, "pay $5 subtotal, then total due $12 now"), (2, "no value"), (3, "first $7 here, and the total due $7 there"), (4, "$1 or $2"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string")

    def choose(text, question, options):
        """The amount that is said to be due; among values the last one, if anything is due."""
        due = [o for o in options if "due ⟦" in o]
        if any("⟦" in o for o in options):
            return (due[0], 0.8) if due else None
        return (options[-1], 0.9) if "due" in text else None

    judge = ScriptedJudge(choose=choose)
    got = {r["doc_id"]: (r["text"], r["start"], r["p"]) for r in P.extract(df, "the total", judge, unit="money").collect()}
    assert got == {1: ("$12", 32, 0.9), 3: ("$7", 33, 0.9)}
    # too many values for one choice: occurrences meet in groups of two
    many = P.extract(df.where("doc_id in (1, 3)"), "the total", judge, unit="money", group=1).collect()
    assert {(r["doc_id"], r["start"], r["p"]) for r in many} == {(1, 32, 0.8), (3, 33, 0.9)}
    assert P.extract(df, "the total", judge, unit="money", threshold=0.95).collect() == []
    big = spark.createDataFrame([(1, " ".join(f"${i}" for i in range(700)) + " total due $999 " + "x" * 70_000)], "doc_id int, text string")
    assert [(r["text"], r["p"]) for r in P.extract(big, "the total", judge, unit="money").collect()] == [("$999", 0.8)]


def test_question_context_and_surroundings(spark, docs):
    seen = []
    judge = ScriptedJudge(lambda t, q, near, context: 1.0 if q == "Is `text` rude?" and context == "a chat" and "⟦" in near and near.replace("⟦", "").replace("⟧", "").strip("…") in "You fool.\nAll is well.\nA rat, indeed." else 0.0)
    rows = P.Pattern("m", judge, unit="name", question="Is {ref} rude?", context="a chat").scan(docs.where("doc_id = 1")).collect()
    assert [r["p"] for r in rows] == [1.0] * len(rows) and rows
    assert str(P.Pattern("m", JUDGE, question="Is {ref} a refund?").wording) == "Is `text` a refund?"

    def send(url, payload, timeout, key_env):
        body = json.loads(payload)
        seen.append(body)
        return 200, {}, json.dumps({"answers": {n: {"type": "noul", "noul": 0.7} for n in body["questions"]}})

    converse(Backend("https://judge.invalid", "m", send=send), {"context": "c", "text": "t"}, {"Q": P.Ask("m", "Is {ref} x?").of("`text`")})
    assert seen[0]["questions"]["Q"]["instructions"] == "Is `text` x?" and list(seen[0]["state"]) == ["context", "text"]


def test_sub_and_split_with_other_judges(docs, spark):
    twice = docs.unionByName(docs)
    judge = ScriptedJudge(lambda t, m: 0.9 if "rat" in t or "fool" in t else 0.1)
    for pattern in (insults(), P.Pattern("is an insult", judge, unit="line"), P.Pattern("is an insult", judge, unit="line", prefilter="rat|fool")):
        got = sorted(((r["doc_id"], r["text"] or "", r["n"]) for r in pattern.subn("***", twice).collect()))
        assert got == sorted([(1, "***\nAll is well.\n***", 2), (2, "Nothing here.", 0), (3, "", 0), (4, "", 0), (5, "***", 1)] * 2)
        assert {r["doc_id"]: r["pieces"] for r in pattern.split(twice).collect()}[1] == ["All is well."]


def test_shortcuts_and_matches(docs):
    assert P.findall("is an insult", docs, judge=JUDGE, unit="line").count() == 3 == P.findall(insults(), docs).count()
    assert P.subn(insults(), "x", docs, count=1).count() == 5
    with pytest.raises(TypeError):
        P.findall(insults(), docs, unit="line")
    with pytest.raises(TypeError):
        P.findall("text alone", docs)
    m = next(insults().finditer(docs))
    assert m.group() == str(m) == "You fool." and m.span() == (0, 9)
    with pytest.raises(IndexError):
        m.group(1)
    assert len(asyncio.run(P.collected(docs))) == 5


def test_judges_of_columns_and_functions(spark, docs):
    column = ColumnJudge(lambda t, m: F.lit(0.5), label=lambda t, q: F.when(t.contains("rat"), "a").otherwise("b"), level=lambda t, q: F.length(t) % 3)
    assert {r["doc_id"]: r["pick"]["label"] for r in P.classify(docs.where("text <> ''"), ["a", "b"], column).collect()} == {1: "a", 2: "b", 5: "a"}
    assert P.rate(docs.where("doc_id = 5"), "q", ["x", "y", "z"], column).first()["rating"]["label"] == "x"
    scripted = ScriptedJudge(choose=lambda t, q, options: "b" if "rat" in t else None, rate=lambda t, q, levels: 1.5)
    assert {r["doc_id"]: r["pick"] and r["pick"]["label"] for r in P.classify(docs, ["a", "b"], scripted).collect()} == {1: "b", 2: None, 3: None, 4: None, 5: "b"}
    assert P.rate(docs.where("doc_id = 5"), "q", ["x", "y", "z"], scripted).first()["rating"]["level"] == 2


def _service(url, payload, timeout, key_env):
    body = json.loads(payload)
    text = body["state"].get("text") or body["state"].get("candidate", {}).get("value", "")

    def answer(q):
        if q["type"] == "choice":
            first = next(iter(q["criteria"]))
            return {"type": "choice", "choice": first, "probabilities": {first: 0.75}}
        if q["type"] == "score":
            return {"type": "score", "score": 1.2, "probabilities": {"0": 0.2, "1": 0.5, "2": 0.3}, "confidence": 0.4}
        return {"type": "noul", "noul": 0.9 if "rat" in text else 0.2}

    return 200, {}, json.dumps({"model": body["model"], "answers": {n: answer(q) for n, q in body["questions"].items()}})


def test_judge_behind_a_service(docs, spark):
    judge = HttpJudge("https://judge.invalid", model="m", send=_service)
    got = {r["doc_id"]: r["p"] for r in judge.score(docs, "x").collect()}
    assert got == {1: 0.9, 2: 0.2, 3: None, 4: 0.2, 5: 0.9}
    pick = P.classify(docs, {"a": "first", "b": None}, judge).where("doc_id = 5").first()["pick"]
    assert (pick["label"], pick["p"], pick["confidence"]) == ("a", 0.75, 0.75)
    rating = P.rate(docs, "how", ["l", "m", "h"], judge).where("doc_id = 5").first()["rating"]
    assert (rating["level"], rating["label"], rating["score"], rating["confidence"]) == (1, "m", 1.2, 0.4)
    amounts = spark.createDataFrame([(1, "$5 or $6")], "doc_id int, text string")
    assert [r["text"] for r in P.extract(amounts, "the price", judge, unit="money").collect()] == ["$5"]
    with pytest.raises(BackendError):
        converse(Backend("https://judge.invalid", "m", send=lambda *a: (400, {}, "")), {}, {"Q": Noul("q")})


def test_retries_and_missing_answers():
    calls, waits = [], []

    def send(url, payload, timeout, key_env):
        calls.append(json.loads(payload))
        if len(calls) == 1:
            return 503, {"retry-after": "3"}, ""
        asked = list(calls[-1]["questions"])
        return 200, {}, json.dumps({"result": {"answers": {asked[0]: {"type": "noul", "noul": 2}}}})

    found, model = converse(Backend("https://judge.invalid", "m", send=send), {"text": "t"}, {n: Noul("q") for n in "abc"}, pause=waits.append)
    assert {n: a.p() for n, a in found.items()} == {"a": 1.0, "b": 1.0, "c": 1.0} and [len(c["questions"]) for c in calls] == [3, 3, 2, 1] and waits == [3.0]
    with pytest.raises(BackendError, match="missing"):
        converse(Backend("https://judge.invalid", "m", send=lambda *a: (200, {}, "{}")), {}, {"a": Noul("q")})


def test_service_of_lists():
    def send(url, payload, timeout, key_env):
        body = json.loads(payload)
        assert body["choices"][0]["options"] == [{"label": "x", "description": None}, {"label": "y", "description": "why"}] and body["scores"][0]["levels"] == ["l", "h"]
        answers = [{"id": "p", "probability": 0.25}, {"id": "c", "label": "y", "probabilities": {"x": 0.25, "y": 0.75}}, {"id": "s", "score": 1, "probabilities": {"1": 1.0}}, {"id": "r", "refusal": "no"}]
        return 200, {}, json.dumps({"decisions": answers})

    backend = DecisionLists("https://judge.invalid", "m", send=send)
    found, _ = converse(backend, "state", {"p": Noul("q"), "c": Choice("q", {"x": None, "y": "why"}), "s": Score("q", ["l", "h"]), "r": Noul("q")})
    assert (found["p"].p(), found["c"].choice, found["c"].confidence, found["s"].level, found["r"].kind, found["r"].reason) == (0.25, "y", 0.75, 1, "refusal", "no")
    with pytest.raises(UnsupportedCapability):
        converse(backend, "state", {"b": Box("where")})
    made = backend_from_env(env={"SPANSENSE_URL": "https://j.invalid", "SPANSENSE_ADAPTER": "lists", "SPANSENSE_KEY": "secret"})
    assert isinstance(made, DecisionLists) and "secret" not in repr(made)
    with pytest.raises(ConfigError):
        backend_from_env(env={})


def test_engine(docs, spark):
    backend = Backend("https://judge.invalid", "m", send=_service, max_questions=2, price_per_mtok=1000.0)
    questions = {"a": Noul("is it a rat"), "b": Choice("which", {"x": None, "y": None}), "c": Score("how", ["l", "m", "h"])}
    requests = requests_of_texts(docs.where("text is not null"), questions, key=F.col("doc_id").cast("string"), text=F.col("text"))
    engine = Engine(backend)
    plan = engine.plan(requests).first()
    assert (plan["requests"], plan["cached"], plan["to_send"]) == (8, 0, 8) and plan["cost"] > 0
    answers = checkpointed(engine.ask(requests))
    assert answers.count() == 12 and {r["answer"]["noul"] for r in answers.where("question_id = 'a'").collect()} == {0.9, 0.2}
    assert one_model(answers) == "m" and stats(answers).first()["answers"] == 12 and stats(answers).first()["ms_95"] >= 0
    with pytest.raises(BudgetExceeded):
        Engine(backend, max_cost=0.0).ask(requests)
    recorded = checkpointed(engine.decisions(requests, answers))
    replay = Engine(Backend("https://judge.invalid", "m", send=None, max_questions=2), recorded=recorded, replay=True)
    again = replay.ask(requests)
    assert sorted(map(str, again.select("request_id", "question_id", "answer").collect())) == sorted(map(str, answers.select("request_id", "question_id", "answer").collect())) and again.where("not cached").isEmpty()
    with pytest.raises(CacheMiss):
        replay.ask(requests_of_texts(docs.where("doc_id = 5"), {"a": Noul("another")}, key=F.col("doc_id").cast("string"), text=F.col("text")))
    turned = {"b": Choice("which", {"y": None, "x": None})}
    with pytest.raises(CacheMiss):
        replay.ask(requests_of_texts(docs.where("doc_id = 5"), turned, key=F.col("doc_id").cast("string"), text=F.col("text")))
    failing = Engine(Backend("https://judge.invalid", "m", send=lambda *a: (400, {}, "")), errors="collect").ask(requests)
    assert failing.where("error is null").isEmpty() and failing.count() == 12
    late = Engine(backend, errors="collect", deadline=-1.0).ask(requests)
    assert {r["error"].split(":")[0] for r in late.collect()} == {"DeadlineExceeded"}
    with pytest.raises(RequestLimitExceeded):
        Engine(backend, max_requests=7).ask(requests)


def test_recorded_choices_and_ratings(docs, spark):
    live = HttpJudge("https://judge.invalid", model="m", send=_service)
    texts = docs.where("text is not null").select("text")
    key = lambda q: decision_key(F.lit(q), F.col("text"), model="m").alias("key")
    answer = lambda sql: F.from_json(F.lit(sql), ANSWER).alias("answer")
    known = texts.select(key("which"), answer('{"type": "choice", "choice": "b", "confidence": 0.6, "probabilities": {"a": 0.3, "b": 0.7}}')).unionByName(
        texts.select(key("how"), answer('{"type": "score", "score": 0.4, "confidence": 0.5, "probabilities": {"0": 0.6, "1": 0.4}}'))
    )
    replay = RecordedJudge(known, model="m")
    assert {(r["pick"]["label"], r["pick"]["p"]) for r in replay.choose(texts, "which", {"a": None, "b": None}).collect()} == {("b", 0.7)}
    assert {(r["rating"]["level"], r["rating"]["label"]) for r in replay.rate(texts, "how", ["l", "h"]).collect()} == {(0, "l")}
    with pytest.raises(Exception, match="no recorded decision"):
        replay.choose(texts, "another", {"a": None, "b": None}).collect()
    assert RecordedJudge(known.limit(1), model="m", live=live).choose(texts, "which", {"a": None, "b": None}).count() == texts.count()


def test_requests(spark):
    df = spark.createDataFrame([([10, 10, 10, 25, 1],)], "c array<int>")
    assert df.select(pack_windows(F.col("c"), 2, 30).alias("w")).first()["w"] == [0, 0, 1, 2, 2]
    spans = spark.createDataFrame([(1, i, "x" * 10) for i in range(70)], "k int, ord int, text string")
    assert sorted(r["items"] for r in requests_of(spans, keys=["k"]).collect()) == [6, 32, 32]
    priced = spark.createDataFrame([("abc" * 10, 2)], "s string, q int").select(token_estimate(F.col("s"), F.col("q")).alias("t"))
    assert priced.first()["t"] == 26
    assert within_budget(priced, "t", 1.0, 1.0) == pytest.approx(26e-6)
    with pytest.raises(BudgetExceeded):
        within_budget(priced, "t", 1.0, 1e-6)
