"""The command line: ``python -m spansense.cli COMMAND ...``. Exit codes: 0 a match, 1 none, 2 an error."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spansense.functions.units import unit_names
from spansense.operators.engine import ADAPTERS, Engine, EngineJudge
from spansense.operators.judge import Judge, KeywordJudge
from spansense.operators.pattern import Pattern, classify, extract, rate
from spansense.sources.lockfile import read_records
from spansense.sources.texts import line_number, read_texts


def _unit(text: str):
    parts = tuple(p.strip() for p in text.split(",") if p.strip())
    for p in parts:
        if p not in unit_names():
            raise argparse.ArgumentTypeError(f"unknown unit {p!r}; one of {', '.join(unit_names())}")
    return parts[0] if len(parts) == 1 else parts


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spansense", description="Query texts by meaning.")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("test", "findall", "search", "scan", "sub", "diff", "split", "extract", "classify", "rate", "grep"):
        c = sub.add_parser(name)
        c.add_argument("meaning")
        c.add_argument("files", nargs="*", default=[])
        c.add_argument("--text", help="a text instead of files")
        c.add_argument("-u", "--unit", type=_unit, default="line" if name in ("grep", "split", "diff") else "sentence")
        c.add_argument("-t", "--threshold", type=float, default=0.5)
        c.add_argument("--prefilter")
        c.add_argument("--context")
        c.add_argument("--json", action="store_true")
        c.add_argument("--keywords", help='a JSON object of triggers and words: {"insult": ["idiot"]}')
        c.add_argument("--backend", help="the address of a judge")
        c.add_argument("--model", default="default")
        c.add_argument("--adapter", choices=sorted(ADAPTERS), default="plain")
        c.add_argument("--cache", help="recorded decisions, read and added to (a folder of JSON lines)")
        c.add_argument("--replay", action="store_true", help="answer from the cache only")
        c.add_argument("--max-cost", type=float)
        c.add_argument("--concurrency", type=int, default=8)
        if name == "grep":
            for flag in "vclnHp":
                c.add_argument(f"-{flag}", action="store_true", dest=f"flag_{flag}")
        if name == "sub":
            c.add_argument("--repl", default="")
            c.add_argument("--count", type=int, default=0)
        if name == "diff":
            c.add_argument("--regex", required=True)
        if name in ("classify", "rate"):
            c.add_argument("--options", required=True, help="comma-separated labels or levels")
        if name == "split":
            c.add_argument("--keep", action="store_true")
    sub.add_parser("units")
    return p


def _judge(args, spark: SparkSession) -> Judge:
    if args.backend:
        backend = ADAPTERS[args.adapter](args.backend, args.model, key_env="SPANSENSE_KEY")
        recorded = read_records(spark, args.cache) if args.cache else None
        return EngineJudge(Engine(backend, recorded=recorded, replay=args.replay, max_cost=args.max_cost, concurrency=args.concurrency, record_to=None if args.replay else args.cache))
    words = json.loads(args.keywords) if args.keywords else {args.meaning: [args.meaning]}
    return KeywordJudge(words)


def _texts(spark: SparkSession, args) -> DataFrame:
    if args.text is not None:
        return spark.createDataFrame([("text", args.text)], "doc_id string, text string")
    if not args.files or args.files == ["-"]:
        return spark.createDataFrame([("stdin", sys.stdin.buffer.read().decode("utf-8", "replace"))], "doc_id string, text string")
    return read_texts(spark, *args.files).withColumnRenamed("path", "doc_id")


def _grep(pattern: Pattern, texts: DataFrame, args) -> DataFrame:
    """The flags of grep as DataFrame operations: -v turns the test, -c counts, -l lists texts, -n adds line numbers, -H the text's name, -p the probability."""
    rows = pattern.scan(texts)
    hits = rows.where(F.col("p") < pattern.threshold) if args.flag_v else rows.where(F.col("p") >= pattern.threshold)
    if args.flag_l:
        return hits.select("doc_id").distinct().orderBy("doc_id")
    if args.flag_c:
        return texts.select("doc_id").join(hits.groupBy("doc_id").count(), "doc_id", "left").select("doc_id", F.coalesce("count", F.lit(0)).alias("count")).orderBy("doc_id")
    named = hits.join(texts.select(F.col("doc_id").alias("_d"), F.col("text").alias("_text")), F.col("doc_id") == F.col("_d"))
    columns = (["doc_id"] if args.flag_H or len(args.files) > 1 else []) + (["line"] if args.flag_n else []) + (["p"] if args.flag_p else []) + ["text"]
    return named.withColumn("line", line_number(F.col("_text"), F.col("start"))).orderBy("doc_id", "ord").select(*columns)


def run(spark: SparkSession, args) -> DataFrame:
    texts = _texts(spark, args)
    judge = _judge(args, spark)
    if args.command == "classify":
        return classify(texts, args.options.split(","), judge, question=args.meaning).select("doc_id", "pick.label", "pick.p")
    if args.command == "rate":
        return rate(texts, args.meaning, args.options.split(","), judge).select("doc_id", "rating.level", "rating.label", "rating.score")
    if args.command == "extract":
        unit = {"unit": args.unit} if args.unit != "sentence" else {}
        return extract(texts, args.meaning, judge, threshold=args.threshold, **unit)
    pattern = Pattern(args.meaning, judge, unit=args.unit, threshold=args.threshold, prefilter=args.prefilter, context=args.context)
    calls = {
        "test": lambda: pattern.test(texts).where("matched").select("doc_id", "p", "band"),
        "findall": lambda: pattern.findall(texts).orderBy("doc_id", "ord"),
        "search": lambda: pattern.search(texts),
        "scan": lambda: pattern.scan(texts).orderBy("doc_id", "ord"),
        "sub": lambda: pattern.subn(args.repl, texts, args.count),
        "diff": lambda: pattern.diff(args.regex, texts).where("side <> 'agree'").orderBy("doc_id", "ord"),
        "split": lambda: pattern.split(texts, keep=args.keep),
        "grep": lambda: _grep(pattern, texts, args),
    }
    return calls[args.command]()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    if args.command == "units":
        print("\n".join(unit_names()))
        return 0
    try:
        spark = spark or SparkSession.builder.appName("spansense").getOrCreate()
        found = False
        for row in run(spark, args).toLocalIterator():
            found = True
            print(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str) if args.json else "\t".join("" if v is None else str(v) for v in row))
        return 0 if found else 1
    except BrokenPipeError:
        return 0
    except Exception as e:  # noqa: BLE001
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
