import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spansense.functions.jsonindex import StructuralIndex
from spansense.operators.nested import linked_rows, p5_found

DECISIONS = "key string, asked map<string,string>, value struct<request_body:string,response_body:string>, recorded_at timestamp"


def index(texts: list[bytes]) -> StructuralIndex:
    data = np.frombuffer(b"".join(texts), np.uint8)
    ix = StructuralIndex(data, np.cumsum([0, *map(len, texts)]))
    ix.check_utf8()
    return ix


def is_json(raw: bytes) -> bool:
    def no(x):
        raise ValueError(x)

    try:
        json.loads(raw.decode(), parse_constant=no)
    except ValueError:
        return False
    return True


def rebuild(node):
    if node.is_object:
        return {k: rebuild(v) for k, v in node.members()}
    if node.is_list:
        return [rebuild(c) for c in node.children()]
    t = node.text()
    return t if node.index._kinds[node.at] == ord("s") else json.loads(t) if t is not None else None


values = st.recursive(st.none() | st.booleans() | st.integers(-99, 99) | st.floats(allow_nan=False, allow_infinity=False) | st.text(alphabet='ab"\\/{}[]:, \né漢\U0001f600', max_size=8), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(alphabet='ab"\\', max_size=3), c, max_size=4), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(values, min_size=1, max_size=5), st.booleans())
def test_round_trip(docs, ascii_only):
    texts = [json.dumps(d, ensure_ascii=ascii_only, indent=1 if ascii_only else None).encode() for d in docs]
    got = {i: rebuild(root) for i, root in index(texts).documents()}
    assert got == {i: json.loads(t) for i, t in enumerate(texts)}


def test_validity_agrees_with_a_parser():
    rng = random.Random(5)
    seed = [json.dumps({"a": [1, -2.5e3, {"b": None, "c\\": "x\"y\\u00e9"}], "d": {}, "e": [], "f": "z", "g": True}).encode(), b'[]', b'{"k":[{},[1,2]]}', b' "s" ', b"12"]
    alphabet = b'{}[]:,"\\ \n0123456789.-+eEtrufalsn\xc3\xa9\x01ab'
    for _ in range(400):
        texts = []
        for _ in range(12):
            t = bytearray(rng.choice(seed))
            for _ in range(rng.randint(0, 3)):
                p = rng.randrange(len(t) + 1)
                what = rng.random()
                if what < 0.4 and t:
                    del t[p : p + rng.randint(1, 3)]
                elif what < 0.8:
                    t[p:p] = bytes([rng.choice(alphabet)])
                else:
                    t = t[:p]
            texts.append(bytes(t))
        ix = index(texts)
        assert [bool(v) for v in ix.valid] == [is_json(t) for t in texts], [t for t, v in zip(texts, ix.valid) if bool(v) != is_json(t)]
        for i, root in ix.documents():
            assert rebuild(root) == json.loads(texts[i])


def h(x) -> str:
    return (x if isinstance(x, bytes) else json.dumps(x).encode()).hex()


@pytest.fixture
def decisions(spark):
    from datetime import datetime, timezone

    t = lambda d: datetime(2026, 1, d, tzinfo=timezone.utc)
    request = {"questions": {"Q1": {"type": "choice", "instructions": "pick", "criteria": {"a": None, "b": "about b"}}, "Q2": {"type": "score", "criteria": ["low", "high"]}}}
    listed = {"questions": [{"id": "Q3", "options": [{"label": "x"}, {"label": "y", "description": "d"}]}, {"name": "Q4", "criteria": {}}, None]}
    answer = {"answers": {"Q1": {"type": "choice", "choice": "a", "probabilities": {"a": 0.75, "b": 0.25}}, "Q2": None}}
    wrapped = {"data": {"answers": [{"name": "Q3", "noul": 0.5}, {"name": "Q4", "type": "refusal", "reason": None, "probabilities": [{"option": "x", "p": 1}]}]}}
    rows = [
        ("k1", {"A": "old"}, (h(request), h(answer)), t(1)),
        ("k1", {"A": "new", "B": " ", "C": None, "D": ""}, (h(request), h(answer).upper()), t(2)),
        ("k1", {"A": "new", "B": " ", "C": None, "D": ""}, (h(request), h(answer).upper()), t(2)),
        ("k2", None, (h(listed), h(wrapped)), t(1)),
        ("k3", {}, (h(request)[:-2], "zz"), t(1)),
        ("k4", None, None, None),
        ("k5", None, (h(b'{"questions": {"\xff": {}}}'), h([1, 2])), t(1)),
        ("k6", None, ("", h(request)[:-1]), t(1)),
    ]
    return spark.createDataFrame(rows, DECISIONS)


def test_linked_rows(decisions):
    got = {tuple(r) for r in p5_found(decisions).collect()}
    assert got == {
        ("k1", "asked", "A", 0), ("k1", "request", "Q1", 0), ("k1", "request", "Q2", 0), ("k1", "option", "Q1", 1), ("k1", "option", "Q1", 2), ("k1", "option", "Q2", 1), ("k1", "option", "Q2", 2),
        ("k1", "response", "Q1", 0), ("k1", "probability", "Q1", 1), ("k1", "probability", "Q1", 2),
        ("k2", "request", "Q3", 0), ("k2", "option", "Q3", 1), ("k2", "option", "Q3", 2), ("k2", "request", "Q4", 0), ("k2", "response", "Q3", 0), ("k2", "response", "Q4", 0), ("k2", "probability", "Q4", 1),
    }
    facts = {(r["node"], r["question_id"], r["item_no"]): r for r in linked_rows(decisions).where("decision_key in ('k1', 'k2')").collect()}
    assert facts["option", "Q1", 2]["label"] == "b" and facts["option", "Q1", 2]["text"] == "about b" and facts["probability", "Q1", 1]["value"] == 0.75
    assert facts["option", "Q3", 2]["text"] == "d" and facts["response", "Q3", 0]["value"] == 0.5 and facts["request", "Q1", 0]["type"] == "choice"


def test_empty_table_and_long_bodies(spark):
    assert p5_found(spark.createDataFrame([], DECISIONS)).collect() == []
    big = {"state": "x" * 5_000_000, "questions": {f"Q{i}": {"criteria": ["a"]} for i in range(3)}}
    rows = spark.createDataFrame([("k", None, (h(big), h({"answers": {}})), None)] , DECISIONS)
    assert p5_found(rows).count() == 6
