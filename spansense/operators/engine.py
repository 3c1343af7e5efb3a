"""Typed questions put to a service: requests as a table, answers as a table.

A request is a state (JSON) with named questions. :meth:`Engine.ask` cuts it into parts that the backend takes, looks them up among recorded decisions, checks what the rest would cost before anything is
sent, sends it from the tasks, a few at once, and gives one row per question back. Adapters know how a service wants its requests; they never hold a key, only the name of the variable that does.
"""

from __future__ import annotations

import json
import os
import random
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spansense.errors import BackendError, BudgetExceeded, CacheMiss, ConfigError, DeadlineExceeded, LimitError, RequestLimitExceeded, UnsupportedCapability
from spansense.functions.questions import ANSWER, NONE_OPTION, Answer, Choice, Question, Score, answer_column, check_answers, expect, read_answer, strict_answer
from spansense.operators.judge import PICK_TYPE, Ask, Judge, rating_of
from spansense.operators.requests import token_estimate
from spansense.runtime import checkpointed

# Statuses after which a request is sent again, how often missing answers are asked for again, and the version of a decision's identity.
RETRY_STATUS = frozenset({408, 409, 425, 429, 500, 502, 503, 504, 520, 522, 524, 529})
ASK_AGAIN, IDENTITY = 2, 2

REQUESTS = "request_id string, state string, questions array<struct<id:string,question:string>>"
ANSWERS = "request_id string, part int, question_id string, answer string, model string, elapsed_ms double, error string"


# --- adapters -----------------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Backend:
    """How a service is spoken to: an address, a model, what it takes at once and what it costs. This one takes ``{model, state, questions}`` and answers ``{answers, usage}``, also inside ``result``."""

    url: str
    model: str
    key_env: str | None = None
    timeout: float = 30.0
    retries: int = 4
    max_questions: int = 32
    max_state_chars: int = 60_000
    price_per_mtok: float = 0.0
    answer_types: tuple[str, ...] = ("noul", "choice", "score", "box")
    headers: Mapping[str, str] = field(default_factory=dict)
    send: Callable | None = field(default=None, compare=False)

    def __post_init__(self) -> None:
        if not self.url.startswith(("http://", "https://")):
            raise ConfigError("the address of a judge starts with http:// or https://")
        if not (self.price_per_mtok >= 0 and self.price_per_mtok < float("inf")) or self.max_questions < 1:
            raise UnsupportedCapability("a price is finite and not negative, and a request holds a question at least")

    def __repr__(self) -> str:
        return f"{type(self).__name__}({self.url!r}, model={self.model!r})"

    def body(self, state: Any, questions: Mapping[str, Question]) -> dict:
        return {"model": self.model, "state": state, "questions": {n: q.to_wire() for n, q in questions.items()}}

    def answers(self, reply: dict) -> dict[str, Any]:
        return (reply.get("result") or reply).get("answers") or {}

    def check(self, questions: Mapping[str, Question]) -> None:
        """Raises if the service can't answer one of the questions, before anything is sent."""
        for name, q in questions.items():
            if q.kind not in self.answer_types:
                raise UnsupportedCapability(f"{name}: this service answers no {q.kind} questions")


@dataclass(frozen=True, repr=False)
class LongContext(Backend):
    """The first form with states of up to 600,000 characters, which a header asks for."""

    max_state_chars: int = 600_000
    headers: Mapping[str, str] = field(default_factory=lambda: {"X-Long-Context": "true"})


@dataclass(frozen=True, repr=False)
class DecisionLists(Backend):
    """A service that takes predicates, choices and scores as lists of their own and may refuse; it looks at no pictures."""

    answer_types: tuple[str, ...] = ("noul", "choice", "score")

    def body(self, state: Any, questions: Mapping[str, Question]) -> dict:
        lists: dict[str, list] = {"predicates": [], "choices": [], "scores": []}
        for name, q in questions.items():
            if q.kind == "noul":
                lists["predicates"].append({"id": name, "instructions": q.instructions})
            elif q.kind == "choice":
                lists["choices"].append({"id": name, "instructions": q.instructions, "options": [{"label": o, "description": d} for o, d in q.criteria.items()]})
            else:
                lists["scores"].append({"id": name, "instructions": q.instructions, "levels": list(q.criteria)})
        return {"model": self.model, "input": state} | {k: v for k, v in lists.items() if v}

    def answers(self, reply: dict) -> dict[str, Any]:
        out = {}
        for d in reply.get("decisions") or []:
            name = d.get("id")
            if d.get("refusal") is not None:
                out[name] = {"type": "refusal", "refusal": d["refusal"]}
            elif "probability" in d:
                out[name] = {"type": "noul", "noul": d["probability"]}
            elif "label" in d:
                out[name] = {"type": "choice", "choice": d["label"], "probabilities": d.get("probabilities") or {}} | ({"confidence": d["confidence"]} if "confidence" in d else {})
            else:
                out[name] = {"type": "score", "score": d.get("score"), "probabilities": d.get("probabilities") or {}, "confidence": d.get("confidence", 0.0)}
        return out


ADAPTERS = {"plain": Backend, "long": LongContext, "lists": DecisionLists}


def backend_from_env(prefix: str = "SPANSENSE", env: Mapping[str, str] | None = None, **settings: Any) -> Backend:
    """The backend that ``PREFIX_URL``, ``PREFIX_MODEL`` and ``PREFIX_ADAPTER`` describe; its key is read from ``PREFIX_KEY`` in the tasks."""
    env = os.environ if env is None else env
    url, adapter = env.get(f"{prefix}_URL"), env.get(f"{prefix}_ADAPTER", "plain")
    if not url or adapter not in ADAPTERS:
        raise ConfigError(f"{prefix}_URL must be set, and {prefix}_ADAPTER be one of {', '.join(ADAPTERS)}")
    return ADAPTERS[adapter](url, env.get(f"{prefix}_MODEL", "default"), key_env=f"{prefix}_KEY", **settings)


def post(url: str, payload: str, timeout: float, key_env: str | None, headers: Mapping[str, str] | None = None) -> tuple[int, dict, str]:
    """One attempt at a POST: status, headers in lower case, text. Redirects are refused, so that a key goes to one address only."""
    import urllib.error
    import urllib.request

    class Stay(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, *a, **k):
            return None

    sent = {"Content-Type": "application/json", **(headers or {})}
    if key_env and os.environ.get(key_env):
        sent["Authorization"] = f"Bearer {os.environ[key_env]}"
    try:
        with urllib.request.build_opener(Stay).open(urllib.request.Request(url, payload.encode(), sent), timeout=timeout) as r:
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, ""
    except OSError as e:
        raise BackendError(f"the judge can't be reached: {e}", None, True) from e


def converse(backend: Backend, state: Any, questions: Mapping[str, Question], *, strict: bool = False, pause: Callable[[float], None] = time.sleep) -> tuple[dict[str, Answer], str]:
    """The answers to all questions of one request, and the model that gave them.

    A failed attempt is repeated with growing pauses, never shorter than the service asks for; answers that are missing are asked for up to twice again.
    """
    backend.check(questions)
    left, found, model = dict(questions), {}, backend.model
    for _ in range(ASK_AGAIN + 1):
        payload = json.dumps(backend.body(state, left), ensure_ascii=False, separators=(",", ":"))
        for attempt in range(backend.retries + 1):
            status, headers, text = (backend.send or post)(backend.url, payload, backend.timeout, backend.key_env, *([backend.headers] if backend.headers and not backend.send else []))
            if status == 200:
                break
            if status not in RETRY_STATUS or attempt == backend.retries:
                raise BackendError(f"the judge answered with status {status}", status, status in RETRY_STATUS)
            pause(max(min(20.0, 0.5 * 2**attempt) * random.uniform(0.8, 1.2), float(headers.get("retry-after", 0) or 0)))
        reply = json.loads(text)
        model = str(reply.get("model") or (reply.get("result") or {}).get("model") or model)
        wires = backend.answers(reply)
        found |= {n: strict_answer(q, wires[n]) if strict else read_answer(wires[n]) for n, q in left.items() if wires.get(n) is not None}
        left = {n: q for n, q in questions.items() if n not in found}
        if not left:
            check_answers(questions, found)
            return found, model
    raise BackendError(f"{len(left)} answers are missing")


# --- the engine ---------------------------------------------------------------------------------------------------------------------------


def request_key(backend: Backend, state: Column, questions: Column) -> Column:
    """The identity of a request: a digest over version, adapter, address, model, state and questions in the order sent; another order of options is another request."""
    fixed = json.dumps([IDENTITY, type(backend).__name__, backend.url, backend.model])
    return F.sha2(F.concat_ws("\x1e", F.lit(fixed), state, F.to_json(questions)), 256)


@dataclass(frozen=True)
class Engine:
    """A backend with what is known already and what may be spent.

    ``recorded`` is a table ``(key, question_id, answer, model)`` of earlier answers, ``answer`` in JSON. With ``replay`` nothing is sent and a request without a record is an error. ``max_cost`` caps the estimated cost
    of what must be sent; ``concurrency`` is how many requests a task has open at once, ``tasks`` in how many tasks they are sent. ``errors`` says whether a failed request fails the run (``raise``) or
    comes out as rows with an ``error`` (``collect``). New answers are added to the records at ``record_to``. More than ``max_requests`` requests to send are an error before any is sent; no request
    is sent later than ``deadline`` seconds after the run began. Paid runs should go without speculation and write the result before they use it twice; :meth:`ask` does.
    """

    backend: Backend
    recorded: DataFrame | None = None
    replay: bool = False
    max_cost: float | None = None
    concurrency: int = 8
    tasks: int | None = None
    strict: bool = False
    errors: str = "raise"
    record_to: str | None = None
    max_requests: int | None = None
    deadline: float | None = None

    def __post_init__(self) -> None:
        if self.replay and self.recorded is None:
            raise ConfigError("a replay needs recorded decisions")
        if self.errors not in ("raise", "collect") or self.concurrency < 1:
            raise ConfigError("errors are raised or collected, and a task sends a request at once at least")

    def parts(self, requests: DataFrame) -> DataFrame:
        """The requests cut into parts of as many questions as the backend takes, with their keys and estimated tokens. A state that is too long is an error."""
        n = self.backend.max_questions
        cut = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("questions") / n) - 1, F.lit(0))), lambda i: F.slice("questions", i.cast("int") * n + 1, n))
        rows = requests.select("request_id", "state", F.posexplode(cut).alias("part", "questions"))
        message = F.concat(F.lit("a state has "), F.length("state").cast("string"), F.lit(f" characters, a request holds {self.backend.max_state_chars}; use a smaller unit"))
        rows = rows.where(F.when(F.length("state") > self.backend.max_state_chars, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
        return rows.withColumns({"key": request_key(self.backend, F.col("state"), F.col("questions")), "tokens": token_estimate(F.col("state"), F.size("questions"))})

    def plan(self, requests: DataFrame) -> DataFrame:
        """One row ``(requests, cached, to_send, tokens, cost)``: what asking would take, without asking."""
        parts = self.parts(requests).select("key", "tokens").distinct()
        known = parts.withColumn("hit", F.lit(False)) if self.recorded is None else parts.join(self.recorded.select("key").distinct().withColumn("hit", F.lit(True)), "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
        send = F.sum(F.when(~F.col("hit"), F.col("tokens")).otherwise(0))
        row = known.agg(F.count(F.lit(1)).alias("requests"), F.count_if("hit").alias("cached"), F.count_if(~F.col("hit")).alias("to_send"), F.coalesce(send, F.lit(0)).alias("tokens"))
        return row.withColumn("cost", F.col("tokens") * F.lit(self.backend.price_per_mtok) / 1e6)

    def ask(self, requests: DataFrame) -> DataFrame:
        """``(request_id, question_id, answer, model, cached, elapsed_ms, error)``: one row per question, ``answer`` an :data:`ANSWER` struct.

        Equal requests are sent once. The answers are written before they are read, so that no request is sent twice by a plan that reads them twice.
        """
        parts = checkpointed(self.parts(requests))
        hits, new = None, parts
        if self.recorded is not None:
            known = self.recorded.select("key", "question_id", F.col("answer").alias("_answer"), F.col("model").alias("model"))
            hits = parts.join(known, "key").select("request_id", "question_id", F.col("_answer").alias("answer"), "model", F.lit(True).alias("cached"), F.lit(None).cast("double").alias("elapsed_ms"), F.lit(None).cast("string").alias("error"))
            new = parts.join(self.recorded.select("key").distinct(), "key", "left_anti")
        if self.replay:
            first = new.select("key").first()
            if first is not None:
                raise CacheMiss(f"no recorded decision for {first['key']}")
            return self._typed(hits)  # type: ignore[arg-type]
        distinct = new.dropDuplicates(["key"])
        if self.max_requests is not None and distinct.limit(self.max_requests + 1).count() > self.max_requests:
            raise RequestLimitExceeded(f"more than {self.max_requests} requests to send")
        if self.max_cost is not None:
            cost = (distinct.agg(F.sum("tokens")).first()[0] or 0) * self.backend.price_per_mtok / 1e6
            if cost > self.max_cost:
                raise BudgetExceeded(f"the requests cost about {cost:.6f}, the cap is {self.max_cost:.6f}")
        sent = distinct.select("key", "state", "questions").repartition(self.tasks or 2 * distinct.sparkSession.sparkContext.defaultParallelism)
        answered = checkpointed(sent.mapInPandas(self._sender(), "key string, question_id string, answer string, model string, elapsed_ms double, error string"))
        if self.record_to is not None:
            fresh = answered.where("error is null").select("key", "question_id", "answer", "model")
            fresh.write.mode("append").json(self.record_to)
        out = new.select("key", "request_id").join(answered, "key").select("request_id", "question_id", "answer", "model", F.lit(False).alias("cached"), "elapsed_ms", "error")
        return self._typed(out if hits is None else out.unionByName(hits))

    def decisions(self, requests: DataFrame, answers: DataFrame) -> DataFrame:
        """What is to be recorded of answers that were asked: ``(key, question_id, answer, model)``."""
        keys = self.parts(requests).select("request_id", "key", F.explode("questions.id").alias("question_id"))
        fresh = answers.where("not cached and error is null").select("request_id", "question_id", F.to_json("answer").alias("answer"), "model")
        return keys.join(fresh, ["request_id", "question_id"]).select("key", "question_id", "answer", "model").dropDuplicates(["key", "question_id"])

    def _sender(self) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        backend, strict, at_once, collect = self.backend, self.strict, self.concurrency, self.errors == "collect"
        until = None if self.deadline is None else time.time() + self.deadline

        def one(key: str, state: str, questions: Sequence) -> list[tuple]:
            began = time.perf_counter()
            asked = {q["id"]: Question(**json.loads(q["question"])) for q in questions}
            try:
                if until is not None and time.time() > until:
                    raise DeadlineExceeded("the run took too long")
                found, model = converse(backend, json.loads(state), asked, strict=strict)
            except (BackendError, DeadlineExceeded, LimitError, UnsupportedCapability) as e:
                if not collect:
                    raise
                return [(key, n, None, None, (time.perf_counter() - began) * 1000, f"{type(e).__name__}: {e}") for n in asked]
            took = (time.perf_counter() - began) * 1000
            return [(key, n, json.dumps(a.to_wire(), ensure_ascii=False), model, took, None) for n, a in found.items()]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with ThreadPoolExecutor(at_once) as pool:
                for pdf in batches:
                    rows = [r for part in pool.map(one, pdf["key"], pdf["state"], pdf["questions"]) for r in part]
                    yield pd.DataFrame(rows, columns=["key", "question_id", "answer", "model", "elapsed_ms", "error"]).astype({"elapsed_ms": "float64"})

        return run

    def _typed(self, rows: DataFrame) -> DataFrame:
        return rows.select("request_id", "question_id", answer_column(F.col("answer")).alias("answer"), "model", "cached", "elapsed_ms", "error")


def one_model(answers: DataFrame) -> str | None:
    """The model that gave all answers; two in one run are an error."""
    models = [r["model"] for r in answers.where("model is not null").select("model").distinct().limit(2).collect()]
    if len(models) > 1:
        raise BackendError(f"answers of two models in one run: {sorted(models)}")
    return models[0] if models else None


def stats(answers: DataFrame, quantiles: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """One row of counters: answers, cached and failed ones, and percentiles of the milliseconds of those sent, at place floor(q n) of the sorted values."""
    from spansense.operators.analytics import percentile_ranks

    counts = answers.agg(F.count(F.lit(1)).alias("answers"), F.count_if("cached").alias("cached"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    for q in quantiles:
        at = percentile_ranks(answers, "elapsed_ms", [q], nearest=False).select(F.col("value").alias(f"ms_{round(q * 100)}"))
        counts = counts.join(F.broadcast(at), how="left")
    return counts


def requests_of_texts(texts: DataFrame, questions: Mapping[str, Question], *, key: Column, text: Column, context: str | None = None, name: str = "text") -> DataFrame:
    """One request per row: the state is ``{context?, name: text}``, the questions are those given."""
    state = F.to_json(F.struct(*([F.lit(context).alias("context")] if context else []), text.alias(name)))
    asked = F.array(*[F.struct(F.lit(n).alias("id"), F.lit(_spell(q)).alias("question")) for n, q in questions.items()])
    return texts.select(key.alias("request_id"), state.alias("state"), asked.alias("questions"))


def _spell(q: Question) -> str:
    return json.dumps({"kind": q.kind, "instructions": q.instructions, "criteria": q.criteria}, ensure_ascii=False)


_default: list[Engine] = []


def set_engine(engine: Engine | None) -> None:
    """The engine of queries that name none."""
    _default[:] = [engine] if engine is not None else []


def get_engine() -> Engine:
    """The engine that was set, else one that the environment describes."""
    if not _default:
        _default.append(Engine(backend_from_env()))
    return _default[0]


class EngineJudge(Judge):
    """A judge behind an engine. Each distinct text is one request with one question, so its identity doesn't depend on its neighbours; null texts are asked nothing."""

    def __init__(self, engine: Engine | None = None) -> None:
        self.engine = engine or get_engine()
        self.max_questions, self.max_state_chars, self.price_per_mtok = self.engine.backend.max_questions, self.engine.backend.max_state_chars, self.engine.backend.price_per_mtok

    def __repr__(self) -> str:
        return f"EngineJudge({self.engine.backend!r})"

    def _asked(self, rows: DataFrame, state: Column, text: str, questions: Column) -> DataFrame:
        """The rows with ``_answer``: distinct states and questions are asked once, and joined back on a digest."""
        marked = rows.withColumns({"_state": F.when(F.col(text).isNotNull(), state), "_q": questions})
        marked = marked.withColumn("_id", F.when(F.col("_state").isNotNull(), F.sha2(F.concat_ws("\x1e", "_state", F.to_json("_q")), 256)))
        requests = marked.where("_id is not null").select(F.col("_id").alias("request_id"), F.col("_state").alias("state"), F.col("_q").alias("questions")).dropDuplicates(["request_id"])
        answers = self.engine.ask(requests).select(F.col("request_id").alias("_rid"), F.col("answer").alias("_answer"))
        return marked.join(answers, F.col("_id") == F.col("_rid"), "left").drop("_state", "_q", "_id", "_rid")

    @staticmethod
    def _questions(question: Question) -> Column:
        return F.array(F.struct(F.lit("Q").alias("id"), F.lit(_spell(question)).alias("question")))

    def score(self, spans: DataFrame, meaning: str | Ask, *, text: str = "text", out: str = "p", near: str | None = None) -> DataFrame:
        ask = meaning if isinstance(meaning, Ask) else Ask(meaning)
        context = [F.lit(ask.context).alias("context")] if ask.context else []
        if near:  # a candidate, where it stands
            state, ref = F.to_json(F.struct(*context, F.struct(F.col(text).alias("value"), F.col(near).alias("in_context")).alias("candidate"))), "`candidate.value`"
        else:
            state, ref = F.to_json(F.struct(*context, F.col(text).alias("text"))), "`text`"
        rows = self._asked(spans, state, text, self._questions(ask.of(ref)))
        fault = F.when(F.col("_answer.type") == "refusal", F.raise_error(F.concat(F.lit("the judge refused: "), F.coalesce("_answer.reason", F.lit("it gave no reason")))))
        return rows.withColumn(out, F.coalesce(fault.cast("double"), F.col("_answer.noul"))).drop("_answer")

    def choose(self, rows: DataFrame, question: str, options: Mapping[str, str | None], *, text: str = "text", out: str = "pick") -> DataFrame:
        asked = self._asked(rows, F.to_json(F.struct(F.col(text).alias("text"))), text, self._questions(Choice(question, options)))
        a = F.col("_answer")
        pick = F.struct(a["choice"].alias("label"), F.coalesce(F.element_at(a["probabilities"], a["choice"]), F.lit(0.0)).alias("p"), a["confidence"].alias("confidence"), a["probabilities"].alias("probabilities"))
        return asked.withColumn(out, F.when(a.isNotNull(), pick).cast(PICK_TYPE)).drop("_answer")

    def rate(self, rows: DataFrame, question: str, levels: Sequence[str], *, text: str = "text", out: str = "rating") -> DataFrame:
        asked = self._asked(rows, F.to_json(F.struct(F.col(text).alias("text"))), text, self._questions(Score(question, levels)))
        a = F.col("_answer")
        odds = F.coalesce(F.transform_keys(a["probabilities"], lambda k, v: k.cast("int")), F.create_map().cast("map<int,double>"))
        return asked.withColumn(out, rating_of(a["score"], odds, levels, a["confidence"])).drop("_answer")

    def pick(self, rows: DataFrame, question: str, *, options: str, text: str = "text", out: str = "pick") -> DataFrame:
        ids = F.transform(F.sequence(F.lit(0), F.size(options) - 1), lambda i: F.concat(F.lit("O"), i.cast("string")))
        criteria = F.map_concat(F.map_from_arrays(ids, F.col(options)), F.create_map(F.lit(NONE_OPTION), F.lit("no option answers the question")))
        spelled = F.to_json(F.struct(F.lit("choice").alias("kind"), F.lit(question).alias("instructions"), criteria.alias("criteria")))
        asked = self._asked(rows, F.to_json(F.struct(F.col(text).alias("text"))), text, F.array(F.struct(F.lit("Q").alias("id"), spelled.alias("question"))))
        a = F.col("_answer")
        place = F.coalesce(F.try_element_at(F.split(F.regexp_extract(a["choice"], r"^O(\d+)$", 0), "O"), F.lit(2)).cast("int"), F.lit(-1))
        return asked.withColumn(out, F.struct(place.alias("place"), F.coalesce(F.element_at(a["probabilities"], a["choice"]), a["confidence"]).alias("p"))).drop("_answer")


def HttpJudge(url: str, *, model: str, key_env: str | None = None, timeout: float = 30.0, retries: int = 4, tasks: int | None = None, send: Callable | None = None) -> EngineJudge:
    """A judge behind a service of the first form; ``send(url, body, timeout, key_env) -> (status, headers, text)`` may be given for tests."""
    return EngineJudge(Engine(Backend(url, model, key_env, timeout, retries, send=send), tasks=tasks))


__all__ = ["ANSWER", "Backend", "DecisionLists", "Engine", "EngineJudge", "HttpJudge", "LongContext", "backend_from_env", "converse", "expect", "get_engine", "one_model", "replace", "requests_of_texts", "set_engine", "stats"]
