from datetime import datetime, timedelta, timezone

from spansense.llm.splits import p2_found, split_checks, split_messages

SCHEMA = "id string, ticket_id string, role string, text string, sent_at timestamp, source_speaker string, source_timestamp string"
T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


def test_ties(spark):
    roles = spark.createDataFrame([("customer", "customer"), ("agent", "agent")], "spelling string, speaker string")
    at = lambda m: T0 + timedelta(minutes=m)
    rows = [
        ("m1", "t1", "customer", "x", at(0), "U-1", None), ("m1", "t2", "agent", "y", at(1), "A-1", None),  # one message
        ("m2", "t3", "Customer ", "x", at(2), "u_ 2", None), ("m3", "t4", "customer", "z", at(3), "U-2", None),  # one customer
        ("m4", "t5", "agent", "Same  text", at(4), "A-9", None), ("m5", "t6", "agent", "same text ", None, "a9", "2026-01-01T00:04:00Z"),  # one source message
        ("m6", "t4", "agent", "q", at(9), "A-3", None), ("m7", "t5", "agent", "q", at(9), "A-3", None),  # carries t3-t4 over to t5-t6
        ("m8", "t7", "agent", "unlike", at(4), "A-9", None), ("m9", "t8", "agent", " ", at(4), "A-9", None), ("m10", "t9", "system", "Same text", at(4), "A-9", None),
        ("m11", "t10", "customer", None, None, None, None), ("m12", "t11", "customer", None, None, "--", None), ("m13", "t12", "customer", None, None, "-", None), ("m14", None, "customer", "x", at(0), "U-1", None), (None, "t13", None, None, None, None, None), (None, "t14", None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in p2_found(df, roles).collect()} == {("t1", "t2"), ("t3", "t4"), ("t3", "t5"), ("t3", "t6")}
    split = {r["id"]: (r["group_key"], r["split"]) for r in split_messages(df, roles).collect()}
    assert set(split) == {f"m{i}" for i in range(1, 15)} and len({split[m] for m in ("m2", "m3", "m4", "m5", "m6", "m7")}) == 1
    empty = spark.createDataFrame([], SCHEMA)
    assert p2_found(empty, roles).collect() == [] and split_messages(empty, roles).collect() == []


def test_proportions(spark):
    roles = spark.createDataFrame([("customer", "customer")], "spelling string, speaker string")
    rows = [(f"m{i}", f"t{i // 2 if i > 900 else 0}", "customer", None, None, None, None) for i in range(3000)]
    got = split_messages(spark.createDataFrame(rows, SCHEMA), roles).groupBy("split").count().collect()
    n = {r["split"]: r["count"] for r in got}
    assert abs(n["train"] - 2400) < 30 and abs(n["validation"] - 300) < 30 and abs(n["test"] - 300) < 30


def test_checks_tell_a_good_split(spark):
    roles = spark.createDataFrame([("customer", "customer")], "spelling string, speaker string")
    rows = [(f"m{i}", f"t{i // 2}", "customer", None, None, f"u{i // 6}", None) for i in range(1200)] + [("m0", "t0", "customer", None, None, "u0", None), (None, "t1", None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert tuple(split_checks(df, roles).first()) == (1200, True, True, True)
    assert not split_checks(df, roles, {"train": 1.0, "test": 0.0}, within=-1.0).first()["near_shares"]
