"""What the message operators share: speakers and times of raw message rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spansense.functions.text import instant, strip


def message_time() -> Column:
    """A row's time: ``sent_at``, or else the instant in ``source_timestamp``; null if neither says one."""
    return F.coalesce(F.col("sent_at").cast("timestamp"), instant(F.col("source_timestamp")))


def with_speaker(messages: DataFrame, roles: DataFrame) -> DataFrame:
    """Adds ``speaker``: what ``roles (spelling, speaker)`` says of the role, outer blanks and case aside; null if it says nothing.

    ``roles`` is a fixed list; a spelling listed twice counts once. Whether it is broadcast is left to the size that Spark sees.
    """
    known = roles.where("spelling is not null and speaker is not null")
    known = known.groupBy(F.lower(strip(F.col("spelling"))).alias("_spelling")).agg(F.min("speaker").alias("speaker"))
    rows = messages.drop("speaker").withColumn("_spelling", F.lower(strip(F.col("role"))))
    return rows.join(known, "_spelling", "left").drop("_spelling")


def account_name(speaker: Column) -> Column:
    """An account without case, blanks and punctuation; null if nothing is left."""
    bare = F.regexp_replace(F.lower(speaker), r"[^\p{L}\p{N}]+", "")
    return F.when(bare != "", bare)
