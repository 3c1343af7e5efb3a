import hashlib
import json
import random

import pytest

from spansense.llm.packing import p3_found, pack, packing_checks, rebuilt

REQ = "request_id string, capability_id string, state_utf8 binary, questions array<struct<name:string,instructions:string>>, estimated_tokens int"
CAP = "capability_id string, max_questions int, max_state_chars int, max_input_tokens int"


@pytest.fixture
def caps(spark):
    return spark.createDataFrame([("a", 4, 100, 50), ("b", None, 60, None), ("c", None, None, None)], CAP)


def request(i, cap, chars, questions, tokens):
    return (i, cap, None if chars is None else bytearray(("é" * chars).encode()), None if questions is None else [(str(q), "?") for q in range(questions)], tokens)


def test_every_piece_fits_and_nothing_is_lost(spark, caps):
    rng = random.Random(2)
    rows = [request(f"r{i}", rng.choice("aaab"), rng.randint(0, 130), rng.randint(0, 6), rng.choice([None, rng.randint(1, 60)])) for i in range(400)]
    df = spark.createDataFrame(rows + rows[:40], REQ)
    limits = {"a": (100, 4, 50), "b": (60, None, None)}
    want = {r[0] for r in rows if any(m is not None and x is not None and x > m for x, m in zip((len(r[2]) // 2, len(r[3]), r[4]), limits[r[1]]))}
    assert {r[0] for r in p3_found(df, caps).collect()} == want
    for per_task in (50_000, 100):
        got = pack(df, caps, rows_per_task=per_task).collect()
        assert all(all(r[1:]) for r in packing_checks(df, caps, rows_per_task=per_task).collect())
        whole = {(r["request_id"], r["digest"], r["questions"]) for r in rebuilt(df, caps, rows_per_task=per_task).collect()}
        assert whole == {(r[0], hashlib.sha256(bytes(r[2])).hexdigest(), len(r[3])) for r in rows}
        chars, windows = {}, {}
        for r in got:
            chars[r["request_id"]] = chars.get(r["request_id"], 0) + r["chars"]
            w = windows.setdefault(r["window_id"], [r["capability_id"], 0, 0, 0])
            assert w[0] == r["capability_id"]
            for k, c in enumerate(("chars", "questions", "tokens"), 1):
                w[k] += r[c]
            assert (r["pieces"] > 1) == (r["request_id"] in want)
        assert chars == {r[0]: len(r[2]) // 2 for r in rows}
        assert all(m is None or w[k] <= m for w in windows.values() for k, m in enumerate(limits[w[0]], 1))
        least = sum(c for r, c in chars.items() if r in {x[0] for x in rows if x[1] == "b"}) / 60
        assert sum(w[0] == "b" for w in windows.values()) <= 1.3 * least + 2


def test_nulls_and_unknown_capabilities(spark, caps):
    rows = [request("x", None, 9999, 99, 9999), request("y", "zz", 9999, 99, 9999), request("n", "a", None, None, None), request(None, "a", 500, 1, 1), request("c", "c", 99999, 999, 10**6)]
    df = spark.createDataFrame(rows, REQ)
    assert p3_found(df, caps).collect() == []
    got = pack(df, caps).collect()
    assert len({r["window_id"] for r in got if r["request_id"] in ("x", "y")}) == 2 and sum(r["request_id"] is None for r in got) == 5
    assert pack(spark.createDataFrame([], REQ), caps).collect() == []
    json.dumps([r["window_id"] for r in got])
