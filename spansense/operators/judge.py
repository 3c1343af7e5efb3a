"""Judges: what gives a text a probability, a choice or a score.

A judge works on a DataFrame of distinct questions to ask. The keyword judge is an expression, so that it stays in generated code; a
scripted judge is an Arrow function; a recorded judge is a lookup join; a judge behind a service (``operators/engine.py``) sends requests from the tasks.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spansense.functions.questions import Noul, Question

# What the keyword judge answers.
HIT, MISS, PICK, REST, SURE = 0.95, 0.03, 0.9, 0.1, 0.9
PICK_TYPE = "struct<label:string,p:double,confidence:double,probabilities:map<string,double>>"


@dataclass(frozen=True)
class Ask:
    """What is asked of spans: whether they fit ``meaning``, or a ``question`` of one's own in which ``{ref}`` is where the span goes; ``context`` is what the judge should know besides."""

    meaning: str
    question: str | None = None
    context: str | None = None

    def of(self, ref: str) -> Question:
        """The question about the span that a request calls ``ref``."""
        if self.question:
            return Noul(self.question.replace("{ref}", ref))
        return Noul(f"Does {ref} fit this description: {self.meaning}", {"true": f"{ref} fits the description.", "false": f"{ref} does not fit the description."})

    def __str__(self) -> str:
        return self.question.replace("{ref}", "`text`") if self.question else self.meaning


def literal_any(text: Column, words: Sequence[str]) -> Column:
    """True if the text holds one of the words, case aside; false for a null text."""
    low = F.lower(text)
    found = F.lit(False)
    for w in words:
        found = found | F.contains(low, F.lit(w.lower()))
    return F.coalesce(found, F.lit(False))


class Judge:
    """Gives ``p`` to the rows of ``spans``: how well their ``text`` fits ``meaning`` (a text or an :class:`Ask`). A null text gets a null.

    ``near`` names a column with the span in its surroundings, for judges that read it.
    """

    #: Questions a request may hold, and characters of its state.
    max_questions, max_state_chars = 32, 60_000
    price_per_mtok = 0.0

    @property
    def expression(self) -> Callable[[Column, str | Ask], Column] | None:
        """The probability of a text column as an expression, for judges that are one."""
        return None

    def score(self, spans: DataFrame, meaning: str | Ask, *, text: str = "text", out: str = "p", near: str | None = None) -> DataFrame:
        raise NotImplementedError

    def choose(self, rows: DataFrame, question: str, options: Mapping[str, str | None], *, text: str = "text", out: str = "pick") -> DataFrame:
        """Adds ``out``: ``struct<label, p, confidence, probabilities map>``."""
        raise NotImplementedError

    def rate(self, rows: DataFrame, question: str, levels: Sequence[str], *, text: str = "text", out: str = "rating") -> DataFrame:
        """Adds ``out``: ``struct<score, level, label, confidence, probabilities map>``."""
        raise NotImplementedError

    def pick(self, rows: DataFrame, question: str, *, options: str, text: str = "text", out: str = "pick") -> DataFrame:
        """Adds ``out``, ``struct<place int, p double>``: which of the row's own ``options`` (a column of arrays) answers the question, from 0, or -1 for none of them."""
        raise NotImplementedError


class KeywordJudge(Judge):
    """Answers by keywords: ``keywords`` maps a trigger, looked for in the question, to the words of which a text must hold one.

    The first trigger that the question holds decides; a question without one is a miss. A choice picks the first option whose name or
    description holds a keyword, else the last; a score is the top level on a hit, else the bottom.
    """

    def __init__(self, keywords: Mapping[str, Sequence[str]], *, hit: float = HIT, miss: float = MISS) -> None:
        self.keywords, self.hit, self.miss = dict(keywords), hit, miss

    def words(self, question: str) -> Sequence[str]:
        return next((w for trigger, w in self.keywords.items() if trigger.lower() in question.lower()), ())

    @property
    def expression(self) -> Callable[[Column, str | Ask], Column]:
        def p(text: Column, meaning: str | Ask) -> Column:
            return F.when(literal_any(text, self.words(str(meaning))), F.lit(self.hit)).when(text.isNotNull(), F.lit(self.miss))

        return p

    def score(self, spans: DataFrame, meaning: str | Ask, *, text: str = "text", out: str = "p", near: str | None = None) -> DataFrame:
        return spans.withColumn(out, self.expression(F.col(text), meaning))

    def choose(self, rows: DataFrame, question: str, options: Mapping[str, str | None], *, text: str = "text", out: str = "pick") -> DataFrame:
        words = [w.lower() for w in self.words(question)]
        names = list(options)
        pick = next((o for o in names if any(w in f"{o} {options[o] or ''}".lower() for w in words)), names[-1])
        rest = REST / max(1, len(names) - 1)
        probs = F.create_map(*[F.lit(x) for o in names for x in (o, PICK if o == pick else rest)])
        return rows.withColumn(out, F.struct(F.lit(pick).alias("label"), F.lit(PICK).alias("p"), F.lit(SURE).alias("confidence"), probs.alias("probabilities")))

    def rate(self, rows: DataFrame, question: str, levels: Sequence[str], *, text: str = "text", out: str = "rating") -> DataFrame:
        top = len(levels) - 1
        level = F.when(literal_any(F.col(text), self.words(question)), F.lit(top)).otherwise(F.lit(0))
        probs = F.map_from_arrays(F.array(*[F.lit(i) for i in range(top + 1)]), F.array(*[F.when(level == i, F.lit(PICK)).otherwise(F.lit(REST / top)) for i in range(top + 1)]))
        label = F.element_at(F.array(*[F.lit(x) for x in levels]), level + 1)
        return rows.withColumn(out, F.struct(level.cast("double").alias("score"), level.alias("level"), label.alias("label"), F.lit(SURE).alias("confidence"), probs.alias("probabilities")))


    def pick(self, rows: DataFrame, question: str, *, options: str, text: str = "text", out: str = "pick") -> DataFrame:
        words = self.words(question)
        place = F.array_position(F.transform(options, lambda o: literal_any(o, words)), F.lit(True)).cast("int") - 1
        return rows.withColumn(out, F.struct(F.coalesce(place, F.lit(-1)).alias("place"), F.lit(PICK).alias("p")))


class LabelJudge(KeywordJudge):
    """A choice per row: each option has keywords of its own, the first that the text holds wins, else the last option."""

    def __init__(self, options: Mapping[str, Sequence[str]], **kw) -> None:
        super().__init__({}, **kw)
        self.options = dict(options)

    def choose(self, rows: DataFrame, question: str, options: Mapping[str, str | None], *, text: str = "text", out: str = "pick") -> DataFrame:
        names = list(options)
        label = F.lit(names[-1])
        for o in reversed(names[:-1]):
            label = F.when(literal_any(F.col(text), self.options.get(o, ())), F.lit(o)).otherwise(label)
        rest = REST / max(1, len(names) - 1)
        probs = F.map_from_arrays(F.array(*[F.lit(o) for o in names]), F.array(*[F.when(label == o, F.lit(PICK)).otherwise(F.lit(rest)) for o in names]))
        return rows.withColumn(out, F.struct(label.alias("label"), F.lit(PICK).alias("p"), F.lit(SURE).alias("confidence"), probs.alias("probabilities")))


class ColumnJudge(Judge):
    """A judge made of expressions: ``of(text, meaning)`` gives the probability column, ``label(text, question)`` the label of a choice, ``level(text, question)`` the level of a scale."""

    def __init__(self, of: Callable[[Column, str], Column], *, label: Callable[[Column, str], Column] | None = None, level: Callable[[Column, str], Column] | None = None) -> None:
        self.of, self.label, self.level = of, label, level

    @property
    def expression(self) -> Callable[[Column, str | Ask], Column]:
        return lambda text, meaning: F.when(text.isNotNull(), self.of(text, str(meaning)).cast("double"))

    def score(self, spans: DataFrame, meaning: str | Ask, *, text: str = "text", out: str = "p", near: str | None = None) -> DataFrame:
        return spans.withColumn(out, F.when(F.col(text).isNotNull(), self.of(F.col(text), str(meaning)).cast("double")))

    def choose(self, rows: DataFrame, question: str, options: Mapping[str, str | None], *, text: str = "text", out: str = "pick") -> DataFrame:
        if self.label is None:
            raise NotImplementedError("this judge has no labels")
        label = self.label(F.col(text), question)
        return rows.withColumn(out, F.when(F.col(text).isNotNull(), F.struct(label.alias("label"), F.lit(1.0).alias("p"), F.lit(1.0).alias("confidence"), F.create_map(label, F.lit(1.0)).alias("probabilities"))))

    def rate(self, rows: DataFrame, question: str, levels: Sequence[str], *, text: str = "text", out: str = "rating") -> DataFrame:
        if self.level is None:
            raise NotImplementedError("this judge has no levels")
        return rows.withColumn(out, rating_of(self.level(F.col(text), question).cast("double"), F.create_map().cast("map<int,double>"), levels))


def rating_of(score: Column, odds: Column, levels: Sequence[str], confidence: Column | None = None) -> Column:
    """A rating from a score and a distribution over levels: the level is the likeliest, the lowest of equals, else the score rounded half to even."""
    ranked = F.array_sort(F.transform(F.map_entries(odds), lambda e: F.struct((-e["value"]).alias("w"), e["key"].cast("int").alias("k"))))
    level = F.coalesce(F.get(ranked, F.lit(0))["k"], F.bround(score).cast("int"))
    label = F.get(F.array(*[F.lit(x) for x in levels]), level)
    return F.when(score.isNotNull(), F.struct(score.alias("score"), level.alias("level"), label.alias("label"), (F.lit(1.0) if confidence is None else confidence).alias("confidence"), odds.alias("probabilities")))


class ScriptedJudge(Judge):
    """A judge made of Python functions, called batch by batch over Arrow.

    ``handler(text, question) -> probability`` may take a third argument, the span in its surroundings, and a fourth, the context. ``choose(text, question, options) -> label`` or
    ``(label, p)`` answers choices, and picks, where null is none; ``rate(text, question, levels) -> score`` scales.
    """

    def __init__(self, handler: Callable[..., float] | None = None, *, choose: Callable | None = None, rate: Callable | None = None) -> None:
        self.handler, self.chooser, self.rater = handler, choose, rate

    def score(self, spans: DataFrame, meaning: str | Ask, *, text: str = "text", out: str = "p", near: str | None = None) -> DataFrame:
        handler, question, context = self.handler, str(meaning), getattr(meaning, "context", None)
        if handler is None:
            raise NotImplementedError("this judge has no handler")
        extra = len([p for p in inspect.signature(handler).parameters.values() if p.default is p.empty]) - 2

        def one(t: str | None, around: str | None) -> float | None:
            return None if t is None else min(1.0, max(0.0, float(handler(t, question, *(around, context)[: max(0, extra)]))))

        @F.pandas_udf("double")
        def ask(texts: pd.Series, around: pd.Series) -> pd.Series:
            return pd.Series([one(t, a) for t, a in zip(texts, around)], dtype="float64")

        return spans.withColumn(out, ask(F.col(text), F.col(near or text)))

    def choose(self, rows: DataFrame, question: str, options: Mapping[str, str | None], *, text: str = "text", out: str = "pick") -> DataFrame:
        picked = self.pick(rows.withColumn("_options", F.array(*[F.lit(o) for o in options])), question, options="_options", text=text, out="_picked")
        label = F.get(F.col("_options"), F.col("_picked.place"))
        odds = F.create_map(F.coalesce(label, F.lit("")), F.col("_picked.p"))
        pick = F.struct(label.alias("label"), F.col("_picked.p").alias("p"), F.col("_picked.p").alias("confidence"), odds.alias("probabilities"))
        return picked.withColumn(out, F.when(F.col(text).isNotNull(), pick)).drop("_options", "_picked")

    def pick(self, rows: DataFrame, question: str, *, options: str, text: str = "text", out: str = "pick") -> DataFrame:
        chooser = self.chooser
        if chooser is None:
            raise NotImplementedError("this judge doesn't choose")

        def one(t: str | None, among: Sequence[str]) -> tuple[int, float]:
            got = None if t is None else chooser(t, question, list(among))
            label, p = got if isinstance(got, tuple) else (got, 1.0)
            return (list(among).index(label), float(p)) if label in list(among) else (-1, float(p))

        @F.pandas_udf("place int, p double")
        def ask(texts: pd.Series, among: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([one(t, a) for t, a in zip(texts, among)], columns=["place", "p"]).astype({"place": "int32", "p": "float64"})

        return rows.withColumn(out, ask(F.col(text), F.col(options)))

    def rate(self, rows: DataFrame, question: str, levels: Sequence[str], *, text: str = "text", out: str = "rating") -> DataFrame:
        rater, scale = self.rater, list(levels)
        if rater is None:
            raise NotImplementedError("this judge doesn't rate")

        @F.pandas_udf("double")
        def ask(texts: pd.Series) -> pd.Series:
            return pd.Series([None if t is None else float(rater(t, question, scale)) for t in texts], dtype="float64")

        return rows.withColumn("_score", ask(F.col(text))).withColumn(out, rating_of(F.col("_score"), F.create_map().cast("map<int,double>"), levels)).drop("_score")


def decision_key(meaning: Column, text: Column, *, model: str, version: int = 2) -> Column:
    """The identity of one question: a digest over its version, model, wording and text, in this order."""
    return F.sha2(F.to_json(F.struct(F.lit(version).alias("version"), F.lit(model).alias("model"), meaning.alias("question"), text.alias("state"))), 256)


class RecordedJudge(Judge):
    """Answers from a table ``(key, p)`` of recorded decisions, and ``(key, answer)`` with :data:`ANSWER` structs for choices and scales; a miss is asked of ``live``, or an error in replay (``live`` none).

    The decisions may be as many as the rows, and Spark takes their digests for shorter than they are: they are joined by sorting, never broadcast.
    """

    def __init__(self, decisions: DataFrame, *, model: str, live: Judge | None = None) -> None:
        columns = [F.col("key").alias("_key"), *([F.col("p").cast("double").alias("_p")] if "p" in decisions.columns else []), *([F.col("answer").alias("_answer")] if "answer" in decisions.columns else [])]
        self.decisions, self.model, self.live = decisions.select(*columns).dropDuplicates(["_key"]).hint("merge"), model, live

    def _lookup(self, rows: DataFrame, question: str, text: str, out: str, found: Column, ask: Callable[[Judge, DataFrame], DataFrame]) -> DataFrame:
        keyed = rows.withColumn("_k", decision_key(F.lit(question), F.col(text), model=self.model))
        known = keyed.join(self.decisions, F.col("_k") == F.col("_key"), "left")
        drop = ["_k", *self.decisions.columns]
        if self.live is None:
            # a row without a decision fails the job rather than come out without an answer
            missing = F.when(F.col(text).isNotNull() & F.col("_key").isNull(), F.raise_error(F.concat(F.lit("no recorded decision for "), F.col("_k"))).cast("boolean"))
            return known.where(F.coalesce(missing, F.lit(True))).withColumn(out, found).drop(*drop)
        hits = known.where("_key is not null").withColumn(out, found).drop(*drop)
        asked = ask(self.live, known.where("_key is null").drop(*drop))
        return hits.select(asked.columns).unionByName(asked)

    def score(self, spans: DataFrame, meaning: str | Ask, *, text: str = "text", out: str = "p", near: str | None = None) -> DataFrame:
        found = F.col("_p") if "_p" in self.decisions.columns else F.col("_answer.noul")
        if isinstance(self.live, KeywordJudge):
            # keywords are looked for where the text is, recorded or not: that costs less than to read the rows twice and to move the texts
            keyed = spans.withColumns({"_k": decision_key(F.lit(str(meaning)), F.col(text), model=self.model), "_live": self.live.expression(F.col(text), meaning)})
            known = keyed.join(self.decisions, F.col("_k") == F.col("_key"), "left")
            return known.withColumn(out, F.when(F.col("_key").isNotNull(), found).otherwise(F.col("_live"))).drop("_k", "_live", *self.decisions.columns)
        return self._lookup(spans, str(meaning), text, out, found, lambda live, rows: live.score(rows, meaning, text=text, out=out, near=near))

    def choose(self, rows: DataFrame, question: str, options: Mapping[str, str | None], *, text: str = "text", out: str = "pick") -> DataFrame:
        a = F.col("_answer")
        found = F.struct(a["choice"].alias("label"), F.coalesce(F.element_at(a["probabilities"], a["choice"]), F.lit(0.0)).alias("p"), a["confidence"].alias("confidence"), a["probabilities"].alias("probabilities"))
        return self._lookup(rows, question, text, out, F.when(a.isNotNull(), found).cast(PICK_TYPE), lambda live, rest: live.choose(rest, question, options, text=text, out=out))

    def rate(self, rows: DataFrame, question: str, levels: Sequence[str], *, text: str = "text", out: str = "rating") -> DataFrame:
        a = F.col("_answer")
        odds = F.coalesce(F.transform_keys(a["probabilities"], lambda k, v: k.cast("int")), F.create_map().cast("map<int,double>"))
        return self._lookup(rows, question, text, out, rating_of(a["score"], odds, levels, a["confidence"]), lambda live, rest: live.rate(rest, question, levels, text=text, out=out))

    def misses(self, spans: DataFrame, meaning: str | Ask, *, text: str = "text") -> DataFrame:
        """The distinct ``(key, text)`` that no decision covers."""
        keyed = spans.where(F.col(text).isNotNull()).select(decision_key(F.lit(str(meaning)), F.col(text), model=self.model).alias("key"), F.col(text).alias("text")).distinct()
        return keyed.join(self.decisions, F.col("key") == F.col("_key"), "left_anti")
