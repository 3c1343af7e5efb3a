"""Bounded sequences of records: named steps with gaps between them, within groups, a time window and relations.

Records are numbered within their group, and each step is joined to the next on the group and on a bucket of positions: a step's successor lies within its
gap, so it stands in one of two buckets. Equal joins on both spread a group of any size over the cluster.
"""

from __future__ import annotations

import datetime
import hashlib
import json
from dataclasses import dataclass, field, replace

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spansense.errors import CandidateLimitExceeded, DefinitionError, EvaluationFailed, InputError, PlanMismatch, ResultLimitExceeded, SpanSenseError
from spansense.operators.judge import Judge
from spansense.runtime import checkpointed
from spansense.semantic.expr import Band, Expr, Predicate, Relation, evaluate, field as record_field, kleene_or, leaves, needed, ref

# How many steps a sequence has, and how wide a gap is, at most.
STEPS, WIDEST = 16, 100


@dataclass(frozen=True)
class Limits:
    """Caps that stop a run with an error rather than cut its result; none by default."""

    candidates: int | None = None
    results: int | None = None
    #: Whether more results than allowed are an error, or the first ones in the order of the records are given and the report says so.
    truncate: bool = False


@dataclass(frozen=True)
class Plan:
    """What a run would do: its candidates and leaves as lazy tables, and a fingerprint of the settings it was made with."""

    candidates: DataFrame
    leaves: DataFrame
    fingerprint: str

    def describe(self) -> DataFrame:
        """One row per leaf: ``(name, records, distinct)``, how many records need it and how many distinct questions that takes."""
        return self.leaves.groupBy("name").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("leaf_id").alias("distinct"))


@dataclass(frozen=True)
class Report:
    """What a run found. ``outcome`` is YES (true), NO (false) or UNKNOWN (null); of an incomplete run it is null and ``issues`` say why, so that nothing is a NO by accident."""

    matches: DataFrame | None
    outcome: bool | None
    complete: bool
    truncated: bool = False
    issues: tuple[str, ...] = ()
    coverage: DataFrame | None = None


@dataclass(frozen=True)
class Step:
    name: str
    expr: Expr


@dataclass(frozen=True)
class Gap:
    """Up to ``max_items`` records of the group may lie between two steps."""

    max_items: int


def gap(max_items: int) -> Gap:
    if isinstance(max_items, bool) or not 0 <= max_items <= WIDEST:
        raise DefinitionError(f"a gap has 0 to {WIDEST} records")
    return Gap(max_items)


@dataclass(frozen=True)
class Sequence:
    """A pattern of steps; see :func:`sequence`."""

    steps: tuple[Step, ...]
    gaps: tuple[int, ...]
    group: str | None = None
    window: tuple[datetime.timedelta, str] | None = None
    relations: tuple[Relation, ...] = field(default=())

    def group_by(self, column: str) -> "Sequence":
        """Only records of one group match together; null is a group."""
        return replace(self, group=column)

    def within(self, duration: datetime.timedelta, timestamp: str) -> "Sequence":
        """The last record comes at most ``duration`` after the first, both ends included."""
        if duration < datetime.timedelta(0):
            raise DefinitionError("a duration isn't negative")
        return replace(self, window=(duration, timestamp))

    def require(self, *relations: Relation) -> "Sequence":
        """All relations must hold between their steps."""
        names = {s.name for s in self.steps}
        for r in relations:
            if r.steps is None or not set(r.steps) <= names:
                raise DefinitionError(f"relation {r.name} must lie between two steps")
        return replace(self, relations=self.relations + relations)

    # --- execution

    def positions(self, records: DataFrame, order: list[str], day: Column | None = None) -> DataFrame:
        """The records with ``_g`` and ``_pos``, their place within the group from 0.

        Without ``day`` a group is numbered in one window. With it, a coarse part of the order, groups are counted by it first and numbered within
        it only, so that no task sees a whole hot group.
        """
        g = F.col(self.group) if self.group else F.lit(1)
        rows = records.withColumn("_g", F.struct(g.alias("g")))
        if day is None:
            whole = Window.partitionBy("_g").orderBy(*order)
            return self._in_time(rows, whole).withColumn("_pos", F.row_number().over(whole) - 1)
        rows = rows.withColumn("_d", day)
        counts = rows.groupBy("_g", "_d").agg(F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy("_g").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.select(F.col("_g").alias("_g2"), F.col("_d").alias("_d2"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
        inner = Window.partitionBy("_g", "_d").orderBy(*order)
        rows = self._in_time(rows, inner)
        joined = rows.join(counts, F.col("_g").eqNullSafe(F.col("_g2")) & F.col("_d").eqNullSafe(F.col("_d2")))
        return joined.withColumn("_pos", (F.col("_base") + F.row_number().over(inner) - 1).cast("bigint")).drop("_d", "_g2", "_d2", "_base")

    def _in_time(self, rows: DataFrame, along: Window) -> DataFrame:
        """The rows; running them fails where the time falls along the order, for then the time window couldn't prune."""
        if self.window is None:
            return rows
        stamp = F.col(self.window[1])
        falls = F.coalesce(stamp < F.lag(stamp).over(along), F.lit(False))
        kept = rows.withColumn("_falls", falls)
        return kept.where(F.when(F.col("_falls"), F.raise_error(F.lit("the timestamps fall along the order of the records")).cast("boolean")).otherwise(F.lit(True))).drop("_falls")

    def check(self, records: DataFrame, key: str) -> None:
        """Raises unless keys are unique and timestamps have a zone."""
        if self.window and not isinstance(records.schema[self.window[1]].dataType, T.TimestampType):
            raise InputError("the timestamp must have a zone")
        if not records.groupBy(key).count().where("count > 1").isEmpty():
            raise InputError(f"{key} isn't unique")

    def candidates(self, records: DataFrame, key: str, order: list[str], judge: Judge, band: Band = Band(), *, day: Column | None = None, carry: list[str] | None = None) -> DataFrame:  # noqa: B008
        """``(g, <step> for each step, i_<step>, unary)``: every overlapping tuple of records whose steps aren't NO, with its unary outcome.

        ``<step>`` is the record's key, ``i_<step>`` its place in its group. Steps are pruned before they are joined, and the time window
        holds in every join, which is sound as time doesn't fall along the order.
        """
        carry = carry or []
        rows = self.positions(records, order, day)
        stamp = [self.window[1]] if self.window else []
        tuples: DataFrame | None = None
        for k, step in enumerate(self.steps):
            fits = rows.withColumn("outcome", F.lit(True)) if isinstance(step.expr, _Open) else evaluate(step.expr, rows, judge, band)
            side = fits.where("outcome is null or outcome")
            named = [F.col(key).alias(step.name), F.col("_pos").alias(f"i_{step.name}"), F.col("outcome").alias(f"_o{k}"), *[F.col(c).alias(f"_{c}_{step.name}") for c in carry], *[F.col(s).alias(f"_t{k}") for s in stamp]]
            if tuples is None:
                tuples = side.select("_g", *named)
                continue
            reach = self.gaps[k - 1] + 1
            side = side.select(F.col("_g").alias("_h"), F.floor(F.col("_pos") / reach).alias("_b"), *named)
            last = f"i_{self.steps[k - 1].name}"
            # a successor lies 1 to `reach` places on: in the bucket of the place itself or the next
            left = tuples.withColumn("_c", F.explode(F.array(F.floor(F.col(last) / reach), F.floor(F.col(last) / reach) + 1)))
            here = F.col(f"i_{step.name}")
            on = (F.col("_g") == F.col("_h")) & (F.col("_c") == F.col("_b")) & (here > F.col(last)) & (here <= F.col(last) + reach)
            if self.window:
                on = on & (F.col(f"_t{k}") - F.col("_t0") <= F.lit(self.window[0]))
            tuples = left.join(side, on).drop("_h", "_b", "_c")
        assert tuples is not None
        unary = F.lit(True)
        for k in range(len(self.steps)):
            unary = unary & F.col(f"_o{k}")
        drop = [f"_o{k}" for k in range(len(self.steps))] + [f"_t{k}" for k in range(len(self.steps)) if stamp]
        return tuples.withColumn("unary", unary).withColumn("g", F.col("_g.g")).drop("_g", *drop)

    def match(self, records: DataFrame, key: str, order: list[str], judge: Judge, band: Band = Band(), *, day: Column | None = None, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
        """``(g, <step> ..., i_<step> ..., outcome)``: the tuples that match (true) or can't be told (null).

        Keys must be unique and times not fall along the order. Relations are asked of tuples that the steps didn't already reject; each distinct pair of texts once.
        """
        self.check(records, key)
        return self._matches(self._tuples(records, key, order, judge, band, day), judge, band, limits)

    def _tuples(self, records: DataFrame, key: str, order: list[str], judge: Judge, band: Band, day: Column | None) -> DataFrame:
        carry = sorted({c for r in self.relations for c in r.columns()})
        return self.candidates(records, key, order, judge, band, day=day, carry=carry)

    def _matches(self, rows: DataFrame, judge: Judge, band: Band, limits: Limits) -> DataFrame:
        if limits.candidates is not None and rows.limit(limits.candidates + 1).count() > limits.candidates:
            raise CandidateLimitExceeded(f"more than {limits.candidates} candidates")
        outcome = F.col("unary")
        for i, r in enumerate(self.relations):
            rows = rows.withColumn("_state", r.state(lambda step, column: F.col(f"_{column}_{step}")))
            answers = judge.score(rows.select("_state").distinct(), r.question, text="_state", out=f"_r{i}").withColumnRenamed("_state", "_s")
            rows = rows.join(answers, F.col("_state") == F.col("_s"), "left").drop("_state", "_s")
            outcome = outcome & band.apply(F.col(f"_r{i}"))
        steps = [s.name for s in self.steps]
        out = rows.select("g", *steps, *[f"i_{s}" for s in steps], outcome.alias("outcome")).where("outcome is null or outcome")
        if limits.results is not None and limits.truncate:
            return out.orderBy(*[f"i_{s}" for s in steps], "g").limit(limits.results)
        if limits.results is not None and out.where("outcome").limit(limits.results + 1).count() > limits.results:
            raise ResultLimitExceeded(f"more than {limits.results} matches")
        return out

    def plan(self, records: DataFrame, key: str, order: list[str], judge: Judge, band: Band = Band(), *, day: Column | None = None, limits: Limits = Limits()) -> Plan:  # noqa: B008
        """The candidates by position and time alone and the leaves that their steps need, without asking the judge anything."""
        self.check(records, key)
        rows = self.positions(records, order, day)
        structural = replace(self, steps=tuple(Step(s.name, _Open()) for s in self.steps), relations=())
        asked = None
        for step in self.steps:
            want = needed(step.expr, rows.schema)
            for leaf in leaves(step.expr):
                part = rows.where(want[leaf.digest()]).select(F.lit(leaf.name).alias("name"), leaf.leaf_id().alias("leaf_id"))
                asked = part if asked is None else asked.unionByName(part)
        if asked is None:
            asked = rows.select(F.lit("").alias("name"), F.lit("").alias("leaf_id")).where("false")
        return Plan(structural.candidates(records, key, order, judge, band, day=day), asked, self.fingerprint(judge, band, limits))

    def fingerprint(self, judge: Judge, band: Band, limits: Limits) -> str:
        """A digest of the pattern and of what it is run with."""
        parts = [repr(self), repr(band), repr(limits), type(judge).__name__, getattr(judge, "model", None)]
        return hashlib.sha256(json.dumps(parts, default=str).encode()).hexdigest()

    def run(
        self, records: DataFrame, key: str, order: list[str], judge: Judge, band: Band = Band(), *, day: Column | None = None, limits: Limits = Limits(), errors: str = "raise", plan: Plan | None = None  # noqa: B008
    ) -> Report:
        """A whole evaluation: matches, outcome and coverage.

        A ``plan`` made with other settings is an error. With ``errors`` ``collect`` a failure comes back as an incomplete report, else as :class:`EvaluationFailed` with that report.
        """
        if errors not in ("raise", "collect"):
            raise DefinitionError("errors are raised or collected")
        if plan is not None and plan.fingerprint != self.fingerprint(judge, band, limits):
            raise PlanMismatch("the pattern, band, limits or judge changed since planning")
        try:
            self.check(records, key)
            tuples = checkpointed(self._tuples(records, key, order, judge, band, day))
            found = checkpointed(self._matches(tuples, judge, band, replace(limits, results=None)))
            issues: tuple[str, ...] = ()
            total = found.where("outcome").count()
            if limits.results is not None and total > limits.results:
                if not limits.truncate:
                    raise ResultLimitExceeded(f"more than {limits.results} matches")
                issues = (f"{total - limits.results} matches beyond the first {limits.results} are left out",)
            row = self.presence(found).first()
            shown = found if not issues else found.orderBy(*[f"i_{s.name}" for s in self.steps], "g").limit(limits.results)
            return Report(shown, None if issues else row["outcome"], not issues, bool(issues), issues, coverage(tuples, found))
        except (SpanSenseError, PySparkException) as e:
            report = Report(None, None, False, issues=(f"{type(e).__name__}: {str(e)[:500]}",))
            if errors == "collect":
                return report
            raise EvaluationFailed(report.issues[0], report, (e,)) from e

    def presence(self, matches: DataFrame) -> DataFrame:
        """One row ``(outcome, accepted, uncertain)``: YES if there is a match, else UNKNOWN if there is an uncertain tuple, else NO."""
        return matches.agg(kleene_or(F.col("outcome")).alias("outcome"), F.count_if(F.col("outcome")).alias("accepted"), F.count_if(F.col("outcome").isNull()).alias("uncertain"))


class _Open(Expr):
    """A step that any record fits."""


def sequence(*parts: Step | Gap) -> Sequence:
    """Steps, with at most one gap between two of them; none between means the records follow each other directly."""
    steps: list[Step] = []
    gaps: list[int] = []
    waiting: int | None = None
    for p in parts:
        if isinstance(p, Gap):
            if not steps or waiting is not None:
                raise DefinitionError("a gap stands between two steps")
            waiting = p.max_items
        elif isinstance(p, Step):
            if steps:
                gaps.append(waiting or 0)
            waiting = None
            steps.append(p)
        else:
            raise DefinitionError(f"{p!r} is no part of a sequence")
    if not 1 <= len(steps) <= STEPS or waiting is not None:
        raise DefinitionError(f"a sequence has 1 to {STEPS} steps and ends with one")
    if len({s.name for s in steps}) < len(steps):
        raise DefinitionError("steps have names of their own")
    return Sequence(tuple(steps), tuple(gaps))


def coverage(candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """One row ``(candidates, accepted, uncertain, rejected)`` of a run."""
    a = candidates.agg(F.count(F.lit(1)).alias("candidates"))
    b = matches.agg(F.count_if(F.col("outcome")).alias("accepted"), F.count_if(F.col("outcome").isNull()).alias("uncertain"))
    return a.join(F.broadcast(b)).withColumn("rejected", F.col("candidates") - F.col("accepted") - F.col("uncertain"))


def prior_turns(messages: DataFrame, group: str, order: list[str], speaker: str, text: str, n: int = 2, *, day: Column | None = None) -> DataFrame:
    """Adds ``prior``: up to ``n`` turns of the group before each, written ``speaker: text``, oldest first; turns without a speaker or text are left out.

    Without ``day`` a group is read in one window. With it, a coarse part of the order, places are counted by it first and every turn is sent to its successors' places, so that no task sees a whole hot group.
    """
    turn = F.concat(F.col(speaker), F.lit(": "), F.col(text))
    if day is None:
        w = Window.partitionBy(group).orderBy(*order).rowsBetween(-n, -1)
        return messages.withColumn("prior", F.collect_list(turn).over(w))
    rows = Sequence((), (), group).positions(messages, order, day)
    ahead = rows.select("_g", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("d"), "_pos", turn.alias("turn")).select("_g", (F.col("_pos") + F.col("d")).alias("_pos"), F.struct((-F.col("d")).alias("d"), "turn").alias("t"))
    lists = ahead.where("t.turn is not null").groupBy("_g", "_pos").agg(F.sort_array(F.collect_list("t")).alias("ts")).select("_g", "_pos", F.col("ts.turn").alias("prior"))
    joined = rows.join(lists, ["_g", "_pos"], "left").drop("_g", "_pos")
    return joined.withColumn("prior", F.coalesce("prior", F.array().cast("array<string>")))


def failed_remedy(*, group: str = "ticket_id", time: str = "time", speaker: str = "speaker", text: str = "text") -> Sequence:
    """A customer reports a problem, an agent offers a remedy, and the customer says that it didn't help: within two days, with up to three turns between two of these, about one problem."""
    by = lambda who: record_field(speaker).eq(who)
    problem = (by("customer") & Predicate("problem", "Does the text report a problem with a product?", {"text": text})).capture("problem")
    remedy = (by("agent") & Predicate("remedy", "Does the text offer a remedy or a step to try?", {"text": text})).capture("remedy")
    still = (by("customer") & Predicate("persists", "Does the text say that the problem persists?", {"text": text})).capture("persists")
    same = Relation("same_problem", "Do both texts speak of the same problem?", text, text).between("problem", "persists").seeing(remedy=ref("remedy").field(text))
    answers = Relation("answers_problem", "Is the second text meant to mend what the first reports?", text, text).between("problem", "remedy")
    return sequence(problem, gap(3), remedy, gap(3), still).group_by(group).within(datetime.timedelta(days=2), time).require(same, answers)
