import random
from datetime import datetime, timedelta, timezone

import pytest

from spansense.llm.conversations import conversations, fragments, overlap_graph, p1_found, paths, verdicts

SCHEMA = "id string, revision string, ticket_id string, role string, text string, sent_at timestamp, prior_turns array<string>, source_timestamp string, received_at timestamp, extra int"
T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


@pytest.fixture
def roles(spark):
    return spark.createDataFrame([("customer", "customer"), ("user", "customer"), ("agent", "agent"), ("bot", "system")], "spelling string, speaker string")


def row(i, ticket, role, text, minute=None, prior=None, revision="1", stamp=None, got=0):
    return (i, revision, ticket, role, text, None if minute is None else T0 + timedelta(minutes=minute), prior, stamp, T0 + timedelta(minutes=got), 1)


def test_cases(spark, roles):
    rows = [
        row("a1", "ok", " User ", "hi", 0, []), row("a2", "ok", "agent", "yes", 1, ["customer: hi"]), row("a3", "ok", "bot", "note", 2), row("a2", "ok", "agent", "yes", 1, ["customer: hi"]),
        row("b1", "gap", "user", "hi", 0), row("b2", "gap", "agent", "yes", 1, ["customer: hello"]),
        row("c1", "oldtext", "user", "new", 0, None, "10"), row("c1", "oldtext", "user", "old", 0, None, "9"), row("c2", "oldtext", "agent", "yes", 1, ["customer: old"]),
        row("d1", "noreply", "user", "hi", 0), row("d2", "noreply", "agent", "yes", 1), row("d3", "noreply", "user", "and?", 2),
        row("e1", "blank", "user", "​ ", 0), row("f1", "badrole", "user", "hi", 0), row("f2", "badrole", "alien", "x", 1), row("f3", "badrole", "agent", "x", 2),
        row("g1", "notime", "user", "hi", None, None, None, "pending"), row("g2", "notime", "agent", "x", 2), row("h1", "spelled", "user", "hi", None, None, None, "1767225600000"), row("h2", "spelled", "agent", "x", 2),
        row("i1", None, "user", "hi", 0), row(None, "tie", "user", "hi", 0), row("z", "tie", "agent", "hi", 0), row("j1", "empty", None, None, None), row("k", "deep", "user", "1", 0), row("l", "deep", "agent", "4", 3, ["customer: 0", "customer: 1", "customer: 1"]),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r[0] for r in p1_found(df, roles).collect()} == {"gap", "noreply", "blank", "badrole", "notime", "empty", "deep"}
    turns = conversations(df, roles).orderBy("ticket_id", "turn_no").collect()
    assert [(r["ticket_id"], r["turn_no"], r["speaker"], r["text"]) for r in turns] == [
        ("ok", 1, "customer", "hi"), ("ok", 2, "agent", "yes"), ("ok", 3, "system", "note"), ("oldtext", 1, "customer", "new"), ("oldtext", 2, "agent", "yes"), ("spelled", 1, "customer", "hi"), ("spelled", 2, "agent", "x"),
        ("tie", 1, "customer", "hi"), ("tie", 2, "agent", "hi"),
    ]
    assert turns[0]["path"] == turns[1]["path"] != turns[2]["path"]


def test_empty_table(spark, roles):
    empty = spark.createDataFrame([], SCHEMA)
    assert p1_found(empty, roles).collect() == [] and conversations(empty, roles).collect() == []


def test_gaps_and_paths_against_brute_force(spark, roles):
    rng = random.Random(8)
    rows, quoted, said = [], {}, {}
    for t in range(60):
        turns = [(rng.choice(["user", "agent"]), rng.choice("abcdefgh") if t % 3 == 0 else f"t{i}") for i in range(rng.randint(1, 12))]
        names = [f"{'customer' if r == 'user' else r}: {x}" for r, x in turns]
        for i, (r, x) in enumerate(turns):
            if rng.random() < 0.06:
                continue
            prior = None if rng.random() < 0.2 else names[max(0, i - 2) : i]
            rows.append(row(f"{t}-{i}", f"t{t:02d}", r, x, i, prior))
            said.setdefault(f"t{t:02d}", set()).add(names[i])
            quoted.setdefault(f"t{t:02d}", set()).update(prior or [])
    df = spark.createDataFrame(rows, SCHEMA)
    want = {t for t in said if quoted[t] - said[t]}
    assert {r["ticket_id"] for r in verdicts(df, roles).where("gap").collect()} == want
    # every fragment with an unambiguous predecessor gets the head of its chain
    graph = overlap_graph(fragments(df, roles)).where("merged").collect()
    before = {}
    for g in sorted(graph, key=lambda g: g["turns"]):
        before[g["ticket_id"], g["start_min"]] = g["end_min"]

    def head(t, f):
        while (t, f) in before:
            f = before[t, f]
        return f

    got = {(r["ticket_id"], r["fragment"]): r["path"] for r in paths(overlap_graph(fragments(df, roles))).collect()}
    assert got == {k: head(*k) for k in before}
