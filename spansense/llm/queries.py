"""The queries of the subpackage, by name: each takes a session and a scale-factor folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spansense.llm import conversations, mixing, packing, pii, residue, splits, tokens
from spansense.runtime import table

#: The key under which the redaction query permutes numbers. A real run passes its own secret.
DEMO_KEY = "not a secret"


def _messages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "support_message"), table(spark, d, "speaker_role")


def _requests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "prepared_request"), table(spark, d, "backend_capability")


def _redacted(spark: SparkSession, d: str) -> DataFrame:
    contacts = table(spark, d, "contact")
    return pii.redacted(contacts, pii.lexicon_of(contacts), DEMO_KEY)


def _packing_report(spark: SparkSession, d: str) -> DataFrame:
    requests, capabilities = _requests(spark, d)
    return packing.packing_report(packing.pack(requests, capabilities), capabilities)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": lambda s, d: conversations.p1_found(*_messages(s, d)),
        "p1_verdicts": lambda s, d: conversations.verdicts(*_messages(s, d)),
        "p1_conversations": lambda s, d: conversations.conversations(*_messages(s, d)).select("ticket_id", "turn_no", "id", "speaker", F.unix_micros("sent_at").alias("sent_us"), "text"),
        "p1_paths": lambda s, d: conversations.conversations(*_messages(s, d)).groupBy("ticket_id").agg(F.count_distinct("path").alias("paths"), F.count(F.lit(1)).alias("turns")),
        "p2_found": lambda s, d: splits.p2_found(*_messages(s, d)),
        "p2_splits": lambda s, d: splits.split_messages(*_messages(s, d)),
        "p2_checks": lambda s, d: splits.split_checks(*_messages(s, d)),
        "p3_found": lambda s, d: packing.p3_found(*_requests(s, d)),
        "p3_packed": lambda s, d: packing.pack(*_requests(s, d)),
        "p3_report": _packing_report,
        "p3_rebuilt": lambda s, d: packing.rebuilt(*_requests(s, d)).distinct(),
        "p3_checks": lambda s, d: packing.packing_checks(*_requests(s, d)),
        # tasks so small that windows left open are merged over several rounds
        "p3_merged_checks": lambda s, d: packing.packing_checks(*_requests(s, d), rows_per_task=20),
        "p4_found": lambda s, d: pii.p4_found(table(s, d, "contact")),
        "p4_redacted": _redacted,
        "p4_scores": lambda s, d: pii.reviewed_scores(table(s, d, "contact")).select("listed", "recall_met"),
        "p6_ids": lambda s, d: tokens.p6_ids(table(s, d, "documents")),
        "p6_decoded": lambda s, d: tokens.decoded(tokens.p6_ids(table(s, d, "documents"))),
        "p7_mix": lambda s, d: mixing.mix(table(s, d, "documents"), table(s, d, "mix_target"))[0],
        "p7_shares": lambda s, d: mixing.mix(table(s, d, "documents"), table(s, d, "mix_target"))[1],
        "p7_checks": lambda s, d: mixing.mix_checks(table(s, d, "documents"), table(s, d, "mix_target")),
        "p8_found": lambda s, d: residue.p8_found(table(s, d, "documents")),
        "p8_clean": lambda s, d: residue.clean_documents(table(s, d, "documents")),
    }
