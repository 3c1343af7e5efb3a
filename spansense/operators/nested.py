"""Problem 5: deeply nested records as related flat tables.

A decision record holds a map of asked wordings and two JSON bodies, written as hexadecimal digits, in more than one layout. All of them
come out as one table of linked rows, each of which names its record, its kind of node and the question it belongs to; the flat tables of
questions, options, answers and probabilities are its parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spansense.functions.jsonindex import Node, StructuralIndex
from spansense.functions.text import has_text
from spansense.runtime import wide

#: Bytes of JSON that are indexed at once; a longer body is indexed alone.
BLOCK_BYTES = 4 << 20

LINKED = "decision_key string, node string, question_id string, item_no int, type string, label string, text string, value double"
_ARROW = pa.schema(
    [("decision_key", pa.string()), ("node", pa.string()), ("question_id", pa.string()), ("item_no", pa.int32()), ("type", pa.string()), ("label", pa.string()), ("text", pa.string()), ("value", pa.float64())]
)


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """One row per ``key``: the one with the latest ``recorded_at``; equal times go by a digest of the row, so repeated rows count once.

    A null time is the earliest; rows with a null key are taken as rows of one key.
    """
    asked = F.map_entries(F.col("asked"))
    rows = decisions.select("key", F.col("recorded_at").cast("timestamp").alias("recorded_at"), asked.alias("asked"), F.col("value.request_body").alias("request_body"), F.col("value.response_body").alias("response_body"))
    rank = F.struct(F.coalesce("recorded_at", F.lit("0001-01-01").cast("timestamp")), F.xxhash64("asked", "request_body", "response_body"))
    row = F.struct("asked", "request_body", "response_body")
    return rows.groupBy("key").agg(F.max_by(row, rank).alias("r")).select("key", "r.*")


def _entries(node: Node | None, *names: str) -> list[tuple[str | None, Node]]:
    """Named members of an object, or of a list of objects that say their name themselves. A repeated name counts once, its last value."""
    if node is None:
        return []
    if node.is_object:
        return node.members()
    found: dict = {}
    if node.is_list:
        for place, child in enumerate(node.children()):
            if not child.is_null:
                named = child.get(*names)
                name = named.text() if named is not None else None
                found[name if name is not None else place] = (name, child)
    return list(found.values())


def _options(question: Node) -> Iterator[tuple[str | None, str | None]]:
    """``(label, text)`` of each option, level or criterion in order."""
    for field in ("options", "criteria", "levels"):
        listed = question.get(field)
        if listed is not None and (listed.is_object or listed.is_list):
            if listed.is_object:
                yield from ((name, child.text()) for name, child in listed.members())
            else:
                for child in listed.children():
                    label, said = child.get("label", "name", "option"), child.get("description", "text")
                    yield (label.text() if label is not None else child.text(), said.text() if said is not None else None)
            return


def _probabilities(answer: Node) -> Iterator[tuple[str | None, float | None]]:
    listed = answer.get("probabilities")
    if listed is None:
        return
    if listed.is_object:
        yield from ((name, child.number()) for name, child in listed.members())
    elif listed.is_list:
        for child in listed.children():
            label, p = child.get("option", "label", "name"), child.get("p", "probability")
            yield (label.text() if label is not None else None, p.number() if p is not None else child.number())


def _text(node: Node | None) -> str | None:
    return None if node is None else node.text()


def request_rows(root: Node) -> Iterator[tuple]:
    """``(node, question_id, item_no, type, label, text, value)`` of a request body: its questions and what each lists."""
    for name, question in _entries(root.get("questions"), "name", "id"):
        if not question.is_object:
            continue
        yield ("request", name, 0, _text(question.get("type")), None, _text(question.get("instructions")), None)
        for place, (label, said) in enumerate(_options(question), 1):
            yield ("option", name, place, None, label, said, None)


def response_rows(root: Node) -> Iterator[tuple]:
    """Of a response body: its answers, nulls left out, and the probabilities of each."""
    answers = root.get("answers")
    if answers is None and (data := root.get("data")) is not None:
        answers = data.get("answers")
    for name, answer in _entries(answers, "name", "id"):
        if answer.is_null:
            continue
        pick = answer.get("choice", "reason")
        number = next((v for f in ("noul", "score") if (x := answer.get(f)) is not None and (v := x.number()) is not None), None)
        yield ("response", name, 0, _text(answer.get("type")), _text(pick), None, number)
        for place, (label, p) in enumerate(_probabilities(answer), 1):
            yield ("probability", name, place, None, label, None, p)


def index_bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``(key, is_request, body)`` to linked rows, block by block."""
    for batch in batches:
        keys, sides = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        body = batch.column(2).cast(pa.large_binary())
        bounds = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body) + 1]
        buffer = body.buffers()[2]
        data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(body):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + BLOCK_BYTES, "right")) - 1)
            to = min(to, len(body))
            index = StructuralIndex(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
            index.check_utf8()
            columns: list[list] = [[] for _ in _ARROW]
            for text, root in index.documents():
                for row in (request_rows if sides[at + text] else response_rows)(root):
                    for column, cell in zip(columns, (keys[at + text], *row)):
                        column.append(cell)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)
            at = to


def linked_rows(decisions: DataFrame) -> DataFrame:
    """All nodes of all decisions as linked rows ``(decision_key, node, question_id, item_no, type, label, text, value)``.

    ``node`` is ``asked``, ``request``, ``option``, ``response`` or ``probability``; ``(decision_key, question_id)`` is the parent of an option or a
    probability, ``decision_key`` of the others. Asked entries with a null or blank wording, null answers and bodies that aren't complete JSON (an odd or
    foreign digit, bytes that aren't UTF-8, a text that breaks off) give no rows; missing fields give nulls; an empty table gives no rows.
    """
    latest = latest_decisions(decisions)
    asked = latest.select("key", F.explode("asked").alias("a")).where(has_text(F.col("a.value")))
    asked = asked.select(
        F.col("key").alias("decision_key"), F.lit("asked").alias("node"), F.col("a.key").alias("question_id"), F.lit(0).alias("item_no"),
        F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("label"), F.col("a.value").alias("text"), F.lit(None).cast("double").alias("value"),
    )
    digits = lambda c: F.when(F.col(c).rlike(r"\A(?:[0-9A-Fa-f]{2})++\z"), F.unhex(c))
    bodies = latest.select("key", F.explode(F.array(F.struct(F.lit(True).alias("r"), digits("request_body").alias("b")), F.struct(F.lit(False).alias("r"), digits("response_body").alias("b")))).alias("x"))
    bodies = bodies.select("key", F.col("x.r").alias("is_request"), F.col("x.b").alias("body")).where("body is not null")
    bodies = bodies.repartition(wide(decisions.sparkSession))
    return asked.unionByName(bodies.mapInArrow(index_bodies, LINKED))


def p5_found(decisions: DataFrame) -> DataFrame:
    """The links of every node."""
    return linked_rows(decisions).select("decision_key", "node", "question_id", "item_no")
