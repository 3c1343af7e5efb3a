"""Recorded decisions: one JSON object a line, or a Parquet table; appended to, never rewritten."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DECISIONS = (
    "key string, key_version int, model string, answers map<string,struct<type:string,noul:double,choice:string,score:double,confidence:double,probabilities:map<string,double>>>, asked map<string,string>"
)


def read_lockfile(spark: SparkSession, path: str, *, form: str = "json") -> DataFrame:
    """The decisions of a lockfile; of a key written more than once the answers agree, so any row holds. A corrupt line is an error."""
    reader = spark.read.schema(DECISIONS)
    return reader.option("mode", "FAILFAST").json(path) if form == "json" else reader.parquet(path)


def probabilities(decisions: DataFrame, name: str | None = None) -> DataFrame:
    """``(key, question, p)`` of the yes-or-no answers; with ``name`` only those to that question."""
    rows = decisions.select("key", F.explode("answers").alias("question", "a")).where("a.type = 'noul'").select("key", "question", F.col("a.noul").alias("p"))
    return rows.where(F.col("question") == name) if name is not None else rows


def missing_keys(wanted: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of ``wanted (key, ...)`` that no decision covers."""
    return wanted.join(decisions.select("key").distinct(), "key", "left_anti")


def append_decisions(new: DataFrame, path: str, known: DataFrame | None = None, *, form: str = "json") -> None:
    """Appends the decisions whose keys aren't known yet, each once, the wording of its questions cut to 160 characters."""
    rows = (new if known is None else missing_keys(new, known)).dropDuplicates(["key"])
    if "asked" in rows.columns:
        rows = rows.withColumn("asked", F.transform_values("asked", lambda k, v: F.substring(v, 1, 160)))
    writer = rows.write.mode("append")
    writer.json(path) if form == "json" else writer.parquet(path)


RECORDS = "key string, question_id string, answer string, model string"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Recorded answers ``(key, question_id, answer, model)`` below a path, each question of a key once; none if there is no such path yet. A corrupt line is an error."""
    try:
        rows = spark.read.schema(RECORDS).option("mode", "FAILFAST").json(path)
    except AnalysisException:
        return spark.createDataFrame([], RECORDS)
    return rows.dropDuplicates(["key", "question_id"])


def conflicting_keys(decisions: DataFrame) -> DataFrame:
    """``(key)`` of decisions that were recorded more than once with different answers."""
    digest = F.xxhash64(F.to_json("answers"))
    return decisions.groupBy("key").agg(F.min(digest).alias("a"), F.max(digest).alias("b")).where("a <> b").select("key")
