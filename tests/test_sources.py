import json
import struct
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from spansense import cli
from spansense.errors import BackendError, LimitError
from spansense.functions.questions import ANSWER, Answer, Choice, Noul, Score, answer_column, answer_fault, answer_level, check_answers, read_answer, strict_answer, strict_reply
from spansense.functions.sqlfunctions import register
from spansense.functions.text import has_text, instant, strip
from spansense.operators.claims import check_claims
from spansense.operators.judge import KeywordJudge, ScriptedJudge
from spansense.operators.pattern import Pattern
from spansense.sources.lockfile import append_decisions, missing_keys, probabilities, read_lockfile
from spansense.sources.texts import image_fits, image_size, line_number, picture_assets, read_jsonl, read_texts, read_zip
from spansense.streaming.matches import stream_findall, stream_sequences, windowed_counts


def test_text_expressions(spark):
    df = spark.createDataFrame([(" a ",), ("​﻿ 　",), (None,), ("\n",), ("⠀",), ("é",)], "t string")
    assert [r[0] for r in df.select(has_text(F.col("t"))).collect()] == [True, False, False, False, False, True]
    assert df.select(strip(F.col("t"))).first()[0] == "a"


def test_instants(spark):
    want = datetime(2024, 9, 1, 18, 13, 21, 542000, tzinfo=timezone.utc)
    same = ["2024-09-01 23:43:21.542 +05:30", "2024-09-01T18:13:21.542Z", "2024-09-01T13:13:21.542-05:00", "1725214401542", " 2024-09-01t18:13:21.542z", "2024-09-01 20:13:21.542 +0200", "2024-09-01 18:13:21.542"]
    none = ["0000-00-00T00:00:00Z", "pending", "", "--", None, "2024-13-01T00:00:00Z", "12"]
    df = spark.createDataFrame([(s,) for s in same + none], "s string")
    got = [r[0] for r in df.select(instant(F.col("s")).cast("double")).collect()]
    assert got == [pytest.approx(want.timestamp())] * len(same) + [None] * len(none)


def test_lockfile(spark, tmp_path):
    rows = [("a", 1, "m", {"S1": ("noul", 0.25, None, None, None, None)}, {"S1": "x" * 300}), ("a", 1, "m", {"S1": ("noul", 0.25, None, None, None, None)}, {"S1": "x" * 300}), ("b", 1, "m", None, None)]
    from spansense.sources.lockfile import DECISIONS

    df = spark.createDataFrame(rows, DECISIONS)
    path = str(tmp_path / "lock")
    append_decisions(df, path)
    known = read_lockfile(spark, path)
    assert known.count() == 2 and len(known.where("key = 'a'").first()["asked"]["S1"]) == 160
    append_decisions(df, path, known)
    assert read_lockfile(spark, path).count() == 2
    assert probabilities(known, "S1").collect() == [("a", "S1", 0.25)]
    assert missing_keys(spark.createDataFrame([("a",), ("z",)], "key string"), known).collect() == [("z",)]
    (tmp_path / "bad").write_text('{"key": "a"}\n{"key": \n')
    with pytest.raises(Exception):
        read_lockfile(spark, str(tmp_path / "bad")).collect()


def test_files(spark, tmp_path):
    (tmp_path / "t.txt").write_bytes("a\r\nb\x85c".encode() + b"\xff")
    row = read_texts(spark, str(tmp_path / "t.txt")).withColumn("n", line_number(F.col("text"), F.lit(5))).first()
    assert row["text"].endswith("�") and row["n"] == 3
    (tmp_path / "d.jsonl").write_text('{"id": 1}\n\n{"id": 1}\n')
    assert read_jsonl(spark, str(tmp_path / "d.jsonl"), "id int").count() == 2
    with pytest.raises(ValueError):
        read_jsonl(spark, str(tmp_path / "d.jsonl"), "id int", key="id")


def test_archives_and_assets(spark, tmp_path):
    import hashlib
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.txt", "hé")
        z.writestr("y.txt", "unread")
    digest = hashlib.sha256((tmp_path / "a.zip").read_bytes()).hexdigest()
    assert [r["text"] for r in read_zip(spark, str(tmp_path / "a.zip"), ["x.txt"], sha256=digest).collect()] == ["hé"]
    for bad in ({"sha256": "0" * 64}, {"members": ["z.txt"]}):
        with pytest.raises(Exception):
            read_zip(spark, str(tmp_path / "a.zip"), **{"members": ["x.txt"], **bad}).collect()
    rows, assets = picture_assets(spark.createDataFrame([(1, bytearray(b"p")), (2, bytearray(b"p")), (3, None)], "id int, pic binary"), "pic")
    assert assets.count() == 1 and [r["pic"] for r in rows.orderBy("id").collect()] == [assets.first()["asset"]] * 2 + [None]


def test_images():
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480)
    assert image_size(png) == (640, 480) and image_fits(640, 480) and not image_fits(100, 900)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0" + struct.pack(">HBHH", 11, 8, 300, 400) + b"\0" * 8
    assert image_size(jpeg) == (400, 300)
    with pytest.raises(LimitError):
        image_size(b"GIF89a")


def test_questions_and_answers(spark):
    box = Answer("box", box=(0.25, 0.25, 0.5, 0.75), confidence=0.5)
    samples = [Answer("noul", noul=0.5), Answer("choice", choice="x", probabilities={"x": 0.7, "y": 0.3}, confidence=0.9), Answer("score", score=1.5, probabilities={"0": 0.5, "1": 0.5}, confidence=0.2, legend={"0": "low"}), box, Answer("refusal", reason="no")]
    for a in samples:
        assert read_answer(a.to_wire()) == a
    assert box.to_wire()["box"] == {"left": 0.25, "top": 0.25, "right": 0.5, "bottom": 0.75}
    assert read_answer({"type": "noul", "noul": 7}).p() == 1.0 and read_answer({"type": "refusal", "refusal": "why"}).reason == "why"
    pick = read_answer({"type": "choice", "probabilities": {"a": 0.5, "b": 0.5}})
    assert pick.choice == "a" and pick.confidence == 0.5 and pick.p("b") == 0.5 and pick.p() == 0.5
    assert Answer("score", score=2.5).level == 2 and Answer("score", score=0, probabilities={"0": 0.4, "1": 0.4}).level == 0
    assert Answer("choice", choice="a", probabilities={"a": 0.3, "b": 0.4, "c": 0.3}).top(2) == [("b", 0.4), ("a", 0.3)]
    assert box.area == 0.125 and box.pixels(100, 200) == (25, 50, 50, 150) and box.pad(0.5).box == (0, 0, 1, 1)
    for bad in (lambda: Noul(" "), lambda: Choice("q", {"a": None}), lambda: Score("q", ["a"]), lambda: Noul("q", {"maybe": "x"}), lambda: Score("q", "abc"), lambda: Choice("q", {"": None, "b": None})):
        with pytest.raises(LimitError):
            bad()
    for bad in ("text", {"type": "what"}, {"type": "noul"}, {"type": "choice"}, {"type": "box", "left": 0.1}, {"type": "box", "box": {"left": 1, "top": 0, "right": 0, "bottom": 1}}):
        with pytest.raises(BackendError):
            read_answer(bad)
    options = Choice("q", {"a": None, "b": None})
    with pytest.raises(BackendError, match="add up"):
        strict_answer(options, {"type": "choice", "choice": "a", "probabilities": {"a": 0.5, "b": 0.4}})
    with pytest.raises(BackendError, match="no option"):
        check_answers({"q": options}, {"q": Answer("choice", choice="z")})
    # the same reading by expressions
    wires = [json.dumps(a.to_wire()) for a in samples] + ['{"type": "choice", "probabilities": {"a": 0.5, "b": 1.5}}', '{"type": "noul", "noul": -3}', "no json"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in wires], "w string").select(answer_column(F.col("w")).alias("a")).collect()]
    assert got[0]["noul"] == 0.5 and got[1]["choice"] == "x" and got[3]["box"]["right"] == 0.5 and got[4]["reason"] == "no" and got[5]["choice"] == "b" and got[5]["confidence"] == 1.0 and got[6]["noul"] == 0.0 and got[7] is None


def test_strict_replies(spark):
    questions = {"a": Noul("q"), "b": Choice("q", {"x": None, "y": None}), "c": Score("q", ["l", "h"])}
    good = {"model": "m", "answers": {"a": {"type": "noul", "noul": 0.5}, "b": {"type": "choice", "choice": "x", "probabilities": {"x": 0.6, "y": 0.4}, "confidence": 0.1}, "c": {"type": "score", "score": 0.5, "probabilities": {"0": 0.5, "1": 0.5}}}}
    model, answers = strict_reply(json.dumps(good), questions)
    assert model == "m" and answers["c"].score == 0.5
    text = json.dumps(good)
    for bad in (text.replace('"model": "m", ', ""), text.replace('"noul": 0.5', '"noul": 1.5'), text.replace('"a": {', '"z": {"type": "noul", "noul": 0}, "a": {'), text.replace('"x": 0.6', '"x": 0.6, "x": 0.6'), text.replace('"score": 0.5', '"score": 2'), "{", text.replace('"choice": "x"', '"choice": "z"')):
        with pytest.raises(BackendError):
            strict_reply(bad, questions)
    faults = spark.createDataFrame([(json.dumps(w),) for w in (good["answers"]["b"], {"type": "choice", "choice": "z", "probabilities": {"x": 0.6, "y": 0.4}}, {"type": "choice", "choice": "x", "probabilities": {"x": 1.0}}, {"type": "noul", "noul": 1}, {"type": "refusal"})], "w string")
    rows = faults.select(answer_fault(F.from_json("w", ANSWER), questions["b"]).alias("f")).collect()
    assert [r["f"] for r in rows] == [None, "the pick is no option", "the distribution isn't over the options", "expected a choice answer", None]
    level = spark.createDataFrame([('{"type": "score", "score": 1.6, "probabilities": {"10": 0.4, "2": 0.4}}',), ('{"type": "score", "score": 2.5}',)], "w string").select(answer_level(F.from_json("w", ANSWER)).alias("l"))
    assert [r["l"] for r in level.collect()] == [2, 2]


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("SELECT u.text FROM VALUES ('mail a@b.cd now') AS t(x), LATERAL find_units(t.x, 'email') u").collect() == [("a@b.cd",)]
    assert spark.sql("SELECT outcome_band(0.5D), outcome_band(NULL), size(spans_of('1 2', 'number'))").collect() == [("review", None, 2)]


def test_claims(spark):
    text = "---\ntitle: x\n---\n# Head of the file is not prose\n\nWe measured 3 days of delays here. Nobody said that it took 4 days. It took 5 days, [see](http://x.invalid).\n\n```\ncode says it takes 6 days too\n```\n"
    judge = KeywordJudge({"claim": ["days"], "sourced": ["according"], "first-hand": ["we measured"]})
    rows = check_claims(spark.createDataFrame([(1, text)], "doc_id int, text string"), judge, claim="a claim", sourced="is it sourced", firsthand="first-hand").orderBy("ord").collect()
    assert [(r["line"], r["verdict"]) for r in rows] == [(6, "first-hand"), (6, "first-hand"), (6, "linked")]


def test_claims_read_paragraphs_links_before_and_the_uncertain_band(spark):
    text = (
        "> Quoted people wait for about 3 days.\n\n| a table | of 3 days | for all of us |\n\n~~~\ncode that waits for 3 days now\n~~~\n\n<!-- a remark on the 3 days of waiting -->\n\n"
        "We measured this ourselves last week. The weather was fine for all. Parcels took 3 days to arrive.\n\n"
        "The [filing](https://a.invalid/f) says so to everyone. Staff waited 4 days for an answer.\n\n"
        "Perhaps it took them 5 days then.\n\nNobody says why 6 days have passed."
    )

    def answer(state, question):
        sentence = state.split("Sentence:")[-1]
        if question == "a claim":
            return 0.9 if "days" in sentence else 0.1
        if question == "is it sourced":
            return 0.35 if "Perhaps" in sentence else 0.05
        return 0.9 if "We measured" in state else 0.1

    rows = check_claims(spark.createDataFrame([(1, text)], "doc_id int, text string"), ScriptedJudge(answer), claim="a claim", sourced="is it sourced", firsthand="first-hand").orderBy("ord").collect()
    assert [(r["text"].split()[0], r["verdict"]) for r in rows] == [("Parcels", "first-hand"), ("Staff", "linked"), ("Perhaps", "check"), ("Nobody", "unsourced")]


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("one\nyou fool\nthree\n")
    words = json.dumps({"insult": ["fool"]})
    assert cli.main(["grep", "an insult", str(tmp_path / "a.txt"), "--keywords", words, "-n"], spark) == 0
    assert capsys.readouterr().out == "2\tyou fool\n"
    assert cli.main(["grep", "an insult", "--text", "all good", "--keywords", words], spark) == 1
    assert cli.main(["grep", "an insult", "--text", "a\nfool", "--keywords", words, "-v", "-c"], spark) == 0
    assert capsys.readouterr().out == "text\t1\n"
    assert cli.main(["sub", "an insult", "--text", "fool", "-u", "line", "--repl", "x", "--keywords", words, "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"doc_id": "text", "text": "x", "n": 1}
    assert cli.main(["units"], spark) == 0
    assert cli.main(["findall", "m", "-u", "nonsense"], spark) == 2


def _drain(query):
    query.processAllAvailable()
    query.stop()


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    t0 = datetime(2026, 1, 1, tzinfo=timezone.utc)
    rows = [(1, t0, "you fool"), (2, t0 + timedelta(minutes=5), "fine"), (3, t0 + timedelta(hours=3), "a fool\nfool")]
    df = spark.createDataFrame(rows, "doc_id int, at timestamp, text string")
    df.write.mode("append").parquet(str(src))
    pattern = Pattern("an insult", KeywordJudge({"insult": ["fool"]}), unit="line")
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(src))
    _drain(stream_findall(stream(), pattern, ["at"]).writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "c1")).start())
    assert spark.table("hits").count() == 3
    counts = windowed_counts(stream_findall(stream(), pattern, ["at"]), "at")
    _drain(counts.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).start())
    assert sorted(r["matches"] for r in spark.table("counts").collect()) == [1, 2]


def test_stream_sequences(spark, tmp_path):
    src = tmp_path / "in"
    t0 = datetime(2026, 1, 1, tzinfo=timezone.utc)
    kinds = "axbaxxb"
    rows = [("u", t0 + timedelta(minutes=i), k) for i, k in enumerate(kinds)]
    df = spark.createDataFrame(rows, "user string, at timestamp, kind string")
    df.coalesce(1).write.parquet(str(src))
    found = stream_sequences(spark.readStream.schema(df.schema).parquet(str(src)), key="user", time="at", kind="kind", steps=["a", "b"], gap=1, within_seconds=3600)
    _drain(found.writeStream.format("memory").queryName("seqs").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start())
    assert [[(t - t0.timestamp()) / 60 for t in r["times"]] for r in spark.table("seqs").collect()] == [[0.0, 2.0]]
