"""The predicate algebra. An outcome is a nullable boolean: YES true, NO false, UNKNOWN null, so Spark's AND, OR and NOT are its truth tables."""

from __future__ import annotations

import datetime
import hashlib
import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from dataclasses import field as _field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spansense.errors import DefinitionError, InputError
from spansense.operators.judge import Judge

# How near to an edge of its band a probability counts as near, and the most nodes of an expression.
NEAR_EDGE, NODES = 0.05, 10_000


@dataclass(frozen=True)
class Band:
    """Probabilities up to ``no`` mean NO, from ``yes`` on YES, between them UNKNOWN."""

    no: float = 0.1
    yes: float = 0.9

    def __post_init__(self) -> None:
        if not 0 <= self.no < self.yes <= 1:
            raise DefinitionError("a band has 0 <= no < yes <= 1")

    def apply(self, p: Column) -> Column:
        return F.when(p <= self.no, F.lit(False)).when(p >= self.yes, F.lit(True))

    def edge_distance(self, p: Column) -> Column:
        return F.least(F.abs(p - self.no), F.abs(p - self.yes))

    def near_edge(self, p: Column) -> Column:
        return self.edge_distance(p) <= NEAR_EDGE + 1e-12


class Expr:
    """A node of the algebra; combine with ``&``, ``|`` and ``~``."""

    def __and__(self, other: "Expr") -> "Expr":
        return Composite("and", (self, _expr(other)))

    def __or__(self, other: "Expr") -> "Expr":
        return Composite("or", (self, _expr(other)))

    def __invert__(self) -> "Expr":
        return Composite("not", (self,))

    def __bool__(self) -> bool:
        raise TypeError("an expression has no truth value; use &, | and ~")

    def capture(self, name: str):
        """The expression as a named step of a sequence."""
        from spansense.semantic.sequence import Step

        return Step(name, self)

    def nodes(self) -> Iterator["Expr"]:
        yield self


def _expr(x) -> Expr:
    if not isinstance(x, Expr):
        raise DefinitionError(f"{x!r} is no expression")
    return x


@dataclass(frozen=True)
class Composite(Expr):
    op: str
    parts: tuple[Expr, ...]

    def nodes(self) -> Iterator[Expr]:
        yield self
        for p in self.parts:
            yield from p.nodes()


@dataclass(frozen=True)
class Predicate(Expr):
    """A leaf that a judge decides: ``question`` over the ``fields``, aliases mapped to column paths. Same name and version must mean the same."""

    name: str
    question: str
    fields: Mapping[str, str] = _field(default_factory=dict)
    version: int = 1
    criteria: Mapping[str, str] | None = None

    def __post_init__(self) -> None:
        if self.criteria and not set(self.criteria) <= {"true", "false"}:
            raise DefinitionError("criteria of a predicate are 'true' and 'false'")
        if not self.name or not str(self.question).strip() or not self.fields:
            raise DefinitionError("a predicate has a name, a question and fields")
        if isinstance(self.version, bool) or self.version < 1:
            raise DefinitionError("versions are whole numbers from 1")
        if not all(a.isidentifier() for a in self.fields):
            raise DefinitionError("aliases are identifiers")

    def digest(self) -> str:
        return hashlib.sha256(json.dumps([self.name, self.version, self.question, sorted(self.fields.items()), sorted((self.criteria or {}).items())]).encode()).hexdigest()

    def state(self) -> Column:
        """What the judge reads: the field itself if there is one, else all as JSON."""
        if len(self.fields) == 1:
            return F.col(next(iter(self.fields.values()))).cast("string")
        return F.to_json(F.struct(*[F.col(p).alias(a) for a, p in sorted(self.fields.items())]))

    def leaf_id(self) -> Column:
        return F.sha2(F.concat(F.lit(self.digest()), F.lit("|"), F.coalesce(self.state(), F.lit("\x00"))), 256)


@dataclass(frozen=True)
class Ref:
    """A captured record of a sequence, whose fields a relation between two others may see; made by :func:`ref`."""

    step: str

    def field(self, path: str) -> tuple[str, str]:
        return self.step, path


def ref(step: str) -> Ref:
    """The record that a step captured."""
    return Ref(step)


Side = str | Mapping[str, str]


def _side(side: Side) -> dict[str, str]:
    return {"value": side} if isinstance(side, str) else dict(side)


@dataclass(frozen=True)
class Relation:
    """A leaf over two records of a sequence; ``left`` and ``right`` are column paths of the records, or aliases mapped to paths, ``between`` the names of two steps; it may be :meth:`seeing` fields of other captures."""

    name: str
    question: str
    left: Side
    right: Side
    version: int = 1
    steps: tuple[str, str] | None = None
    context: Mapping[str, tuple[str, str]] = _field(default_factory=dict)

    def between(self, first: str, second: str) -> "Relation":
        return replace(self, steps=(first, second))

    def seeing(self, **fields: tuple[str, str]) -> "Relation":
        """With further fields, as ``seeing(offer=ref("remedy").field("text"))``."""
        return replace(self, context={**self.context, **fields})

    def columns(self) -> set[str]:
        """The columns that the records of a sequence must carry along."""
        return {*_side(self.left).values(), *_side(self.right).values(), *(path for _, path in self.context.values())}

    def state(self, of: Callable[[str, str], Column]) -> Column:
        """What the judge reads; ``of(step, column)`` is the column of a captured record."""
        first, second = self.steps  # type: ignore[misc]

        def side(step: str, fields: Side) -> Column:
            return of(step, fields) if isinstance(fields, str) else F.struct(*[of(step, path).alias(alias) for alias, path in sorted(fields.items())])

        seen = [F.struct(*[of(step, path).alias(alias) for alias, (step, path) in sorted(self.context.items())]).alias("context")] if self.context else []
        return F.to_json(F.struct(side(first, self.left).alias("left"), side(second, self.right).alias("right"), *seen))


_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _category(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(kind, _NUMBERS):
        return "int"
    if isinstance(kind, T.TimestampType):
        return "time"
    return "text" if isinstance(kind, T.StringType) else "other"


def _literal(value) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            raise InputError("literals are finite")
        return "float"
    if isinstance(value, datetime.datetime):
        if value.tzinfo is None:
            raise InputError("times need a zone")
        return "time"
    if value is None or isinstance(value, str):
        return "text" if value is not None else "null"
    raise InputError(f"{value!r} can't be compared")


@dataclass(frozen=True)
class Guard(Expr):
    """An exact test of a field, decided without a judge. Types are strict: 1, 1.0, true and "1" are four values."""

    path: str
    op: str
    values: tuple = ()

    def column(self, schema: T.StructType) -> Column:
        c = F.col(self.path)
        kind = _type_at(schema, self.path)
        if self.op == "exists":
            return F.lit(kind is not None)
        if kind is None:
            raise InputError(f"the records have no {self.path}")
        if self.op in ("eq", "one_of"):
            out = F.lit(False)
            for v in self.values:
                lit = _literal(v)
                if lit == "null":
                    out = out | c.isNull()
                elif lit == _category(kind):
                    out = out | c.eqNullSafe(F.lit(v))
            return out
        lit, cat = _literal(self.values[0]), _category(kind)
        if not ({lit, cat} <= {"int", "float"} or lit == cat == "time"):
            raise InputError(f"{self.path} is {cat}, it can't be ordered against {lit}")
        v = F.lit(self.values[0])
        test = {"lt": c < v, "le": c <= v, "gt": c > v, "ge": c >= v}[self.op]
        return F.when(c.isNull(), F.raise_error(F.lit(f"{self.path} is null and can't be ordered")).cast("boolean")).otherwise(test)


def _type_at(schema: T.DataType, path: str) -> T.DataType | None:
    for part in path.split("."):
        if not isinstance(schema, T.StructType) or part not in schema.fieldNames():
            return None
        schema = schema[part].dataType
    return schema


@dataclass(frozen=True)
class Field:
    """A field of the records, to be tested."""

    path: str

    def eq(self, value) -> Guard:
        _literal(value)
        return Guard(self.path, "eq", (value,))

    def one_of(self, values: Sequence) -> Guard:
        if isinstance(values, str):
            raise DefinitionError("the values of one_of are a sequence, not a text")
        for v in values:
            _literal(v)
        return Guard(self.path, "one_of", tuple(values))

    def exists(self) -> Guard:
        return Guard(self.path, "exists")

    def _ordered(self, op: str, value) -> Guard:
        if _literal(value) not in ("int", "float", "time"):
            raise InputError(f"{value!r} can't be ordered")
        return Guard(self.path, op, (value,))

    def lt(self, value) -> Guard:
        return self._ordered("lt", value)

    def le(self, value) -> Guard:
        return self._ordered("le", value)

    def gt(self, value) -> Guard:
        return self._ordered("gt", value)

    def ge(self, value) -> Guard:
        return self._ordered("ge", value)


def field(path: str) -> Field:
    """A field by its dotted path."""
    return Field(path)


def leaves(expr: Expr) -> list[Predicate]:
    """The predicates of an expression, each once; one name and version with two meanings is an error."""
    found: dict[tuple[str, int], Predicate] = {}
    for i, n in enumerate(expr.nodes()):
        if i >= NODES:
            raise DefinitionError(f"an expression has at most {NODES} nodes")
        if isinstance(n, Predicate) and found.setdefault((n.name, n.version), n).digest() != n.digest():
            raise DefinitionError(f"{n.name} version {n.version} is defined twice, differently")
    return list(found.values())


def compile_expr(expr: Expr, schema: T.StructType, answers: Mapping[str, Column]) -> Column:
    """The outcome column; ``answers`` has the outcome of each leaf by its digest, a leaf without one is UNKNOWN."""
    if isinstance(expr, Guard):
        return expr.column(schema)
    if isinstance(expr, Predicate):
        return answers.get(expr.digest(), F.lit(None).cast("boolean"))
    parts = [compile_expr(p, schema, answers) for p in expr.parts]  # type: ignore[attr-defined]
    if expr.op == "not":  # type: ignore[attr-defined]
        return ~parts[0]
    return parts[0] & parts[1] if expr.op == "and" else parts[0] | parts[1]  # type: ignore[attr-defined]


def partial(expr: Expr, schema: T.StructType) -> Column:
    """What the guards alone decide: the outcome with every leaf UNKNOWN. If it isn't null no leaf is needed."""
    return compile_expr(expr, schema, {})


def needed(expr: Expr, schema: T.StructType) -> dict[str, Column]:
    """For each leaf, by digest, whether a row needs it: iff no guard decides any node above some occurrence of it."""
    out: dict[str, Column] = {}

    def walk(e: Expr, open_: Column) -> None:
        if isinstance(e, Predicate):
            out[e.digest()] = out[e.digest()] | open_ if e.digest() in out else open_
        elif isinstance(e, Composite):
            here = open_ & partial(e, schema).isNull()
            for p in e.parts:
                walk(p, here)

    walk(expr, F.lit(True))
    return out


def judge_leaf(rows: DataFrame, leaf: Predicate, when: Column, judge: Judge, out: str) -> DataFrame:
    """Adds ``out``, the leaf's probability, to the rows that need it. Each distinct state is judged once; others get a null."""
    marked = rows.withColumn("_state", F.when(when, leaf.state()))
    states = marked.where("_state is not null").select("_state").distinct()
    answers = judge.score(states, leaf.question, text="_state", out=out).withColumnRenamed("_state", "_s")
    return marked.join(answers, F.col("_state") == F.col("_s"), "left").drop("_state", "_s")


def evaluate(expr: Expr, records: DataFrame, judge: Judge, band: Band = Band(), *, keep: bool = False) -> DataFrame:  # noqa: B008
    """The records with ``outcome`` (YES true, NO false, UNKNOWN null) and ``asked``, the number of leaves that a judge answered for them.

    Guards come first: a leaf is asked only of the rows where they leave its outcome open. With ``keep`` the probabilities stay, as ``p_<name>``.
    """
    schema, names = records.schema, []
    answers: dict[str, Column] = {}
    want = needed(expr, schema)
    rows = records
    for i, leaf in enumerate(leaves(expr)):
        name = f"p_{leaf.name}" if keep else f"_p{i}"
        rows = judge_leaf(rows, leaf, want[leaf.digest()], judge, name)
        answers[leaf.digest()] = band.apply(F.col(name))
        names.append(name)
    asked = sum((F.when(F.col(n).isNotNull(), 1).otherwise(0) for n in names), F.lit(0))
    rows = rows.withColumns({"outcome": compile_expr(expr, schema, answers), "asked": asked})
    return rows if keep else rows.drop(*names)


def kleene_or(outcome: Column) -> Column:
    """The aggregate of many outcomes: YES if any is, else UNKNOWN if any is, else NO; NO for none."""
    return F.when(F.coalesce(F.bool_or(outcome), F.lit(False)), F.lit(True)).when(F.count_if(outcome.isNull()) > 0, F.lit(None).cast("boolean")).otherwise(F.lit(False))


def empty_fields(records: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """``(alias, nulls, blanks, empties)``: how many records have a null, a blank text or an empty list under each alias. 0 and false aren't empty."""
    aggs = []
    for alias, path in fields.items():
        kind = _type_at(records.schema, path)
        c = F.col(path)
        blank = F.count_if(c.rlike(r"\A[\s\p{Z}]*\z")) if isinstance(kind, T.StringType) else F.lit(0)
        empty = F.count_if(F.size(c) == 0) if isinstance(kind, (T.ArrayType, T.MapType)) else F.lit(0)
        aggs.append(F.struct(F.lit(alias).alias("alias"), F.count_if(c.isNull()).cast("bigint").alias("nulls"), blank.cast("bigint").alias("blanks"), empty.cast("bigint").alias("empties")))
    return records.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("a")).select("a.*")


#: Bytes that the projected fields of one bound record may have.
MOST_RECORD_BYTES = 4 << 20


def bind(expr: Expr, records: DataFrame, key: str, *, revision: str | None = None) -> DataFrame:
    """``(key, revision, <fields>, digest)``: the records with only the fields that the expression reads, and a digest of them.

    Guards are checked against the schema at once, on every branch; a record whose fields have over 4 MiB fails the run.
    """
    paths = sorted({p for n in expr.nodes() for p in (n.fields.values() if isinstance(n, Predicate) else [n.path] if isinstance(n, Guard) else [])})
    partial(expr, records.schema)
    known = [p for p in paths if _type_at(records.schema, p) is not None]
    columns = [F.col(p).alias(p.replace(".", "_")) for p in known]
    rows = records.select(F.col(key).alias("key"), (F.col(revision) if revision else F.lit(None)).cast("string").alias("revision"), *columns)
    state = F.to_json(F.struct(*[F.col(p.replace(".", "_")) for p in known])) if known else F.lit("{}")
    size = F.when(F.octet_length(state) > MOST_RECORD_BYTES, F.raise_error(F.concat(F.lit("a record is too large: "), F.col("key").cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return rows.where(size).withColumn("digest", F.sha2(state, 256))


def explain(expr: Expr, records: DataFrame, key: str, judge: Judge, band: Band = Band()) -> DataFrame:  # noqa: B008
    """``(key, name, version, leaf_id, p, outcome, edge_distance, near_edge)``: one row per record and leaf that a judge answered, without what it read."""
    found = leaves(expr)
    rows = evaluate(expr, records.withColumns({f"_id_{i}": leaf.leaf_id() for i, leaf in enumerate(found)}), judge, band, keep=True)
    parts = F.array(*[F.struct(F.lit(x.name).alias("name"), F.lit(x.version).alias("version"), F.col(f"_id_{i}").alias("leaf_id"), F.col(f"p_{x.name}").alias("p")) for i, x in enumerate(found)])
    seen = rows.select(F.col(key).alias("key"), F.explode(parts).alias("l")).select("key", "l.*").where("p is not null")
    p = F.col("p")
    return seen.withColumns({"outcome": band.apply(p), "edge_distance": band.edge_distance(p), "near_edge": band.near_edge(p)})
