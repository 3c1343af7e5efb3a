"""Problem 2: train, validation and test splits that keep tied tickets together."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spansense.functions.text import has_text
from spansense.llm.messages import account_name, message_time, with_speaker
from spansense.operators.components import connected_components, star_edges
from spansense.runtime import checkpointed, running_total

#: Shares of the messages that each split should get.
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _key(kind: str, *parts: Column) -> Column:
    """Hashes of 64 and 32 bits of a key: together wide enough that no two of 10**11 keys are likely to meet."""
    return F.struct(F.xxhash64(F.lit(kind), *parts).alias("k1"), F.hash(F.lit(kind), *parts).alias("k2"))


def ticket_ties(messages: DataFrame, roles: DataFrame) -> DataFrame:
    """Edges ``(src, dst)`` between tickets that share a message, a customer or a source message.

    A shared message is an equal ``id``; a shared customer an equal account of customer rows, case, blanks and punctuation aside; a shared source
    message rows of one customer or agent account with the same time and the same text, white space and case aside, that isn't blank. Nulls and
    accounts without letters or digits tie nothing. The keys of a row are worked out once; the edges of a key form a star, so a key with any share of the rows gives no pairs.
    """
    rows = with_speaker(messages.where("ticket_id is not null"), roles)
    account, time = account_name(F.col("source_speaker")), message_time()
    person = F.col("speaker").isin("customer", "agent") & account.isNotNull()
    bare = F.regexp_replace(F.lower("text"), r"[\s\p{Z}\p{Cc}\p{Cf}]+", "")
    keys = F.array(
        F.when(F.col("id").isNotNull(), _key("message", F.col("id"))),
        F.when((F.col("speaker") == "customer") & account.isNotNull(), _key("customer", account)),
        F.when(person & time.isNotNull() & has_text(F.col("text")), _key("source", account, time, bare)),
    )
    members = rows.select("ticket_id", F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("k")).select("k.*", "ticket_id")
    return star_edges(members, ["k1", "k2"], "ticket_id")


def ticket_groups(messages: DataFrame, roles: DataFrame) -> DataFrame:
    """``(ticket_id, group_ticket)`` of each ticket tied to another; ``group_ticket`` is the smallest ticket, by string order, of its group."""
    groups = connected_components(ticket_ties(messages, roles))
    return groups.select(F.col("node").alias("ticket_id"), F.col("root").alias("group_ticket"))


def split_messages(messages: DataFrame, roles: DataFrame, shares: Mapping[str, float] = SHARES) -> DataFrame:
    """``(id, group_key, split)``: every message id once, all messages of tied tickets in one split.

    Groups follow each other in the order of their hash and fill the splits in the order of ``shares``, each group going where its first message
    falls; so a split misses its share by less than one group. Groups above half a hundredth of the messages (under 200 of them) come first
    and so fall into the first split. A message in no ticket is a group of its own. Null ids are no messages; an empty table gives no rows.
    """
    groups = ticket_groups(messages, roles)
    rows = messages.where("id is not null").select("id", "ticket_id").distinct()
    known = rows.join(groups, "ticket_id", "left")
    # tickets that share an id are tied, so the smallest is the group of all
    of = known.groupBy("id").agg(F.min(F.coalesce("group_ticket", "ticket_id")).alias("ticket"))
    of = checkpointed(of.select("id", F.coalesce(F.concat(F.lit("t "), F.col("ticket")), F.concat(F.lit("m "), F.col("id"))).alias("group_key")))
    sizes = of.groupBy("group_key").agg(F.count(F.lit(1)).alias("size")).withColumn("hash", F.xxhash64("group_key"))
    total = of.count()
    placed = running_total(sizes, [], "hash", ["group_key"], "size", "before", first=F.col("size") > F.lit(total / 200))
    low, split = 0.0, F.lit(None).cast("string")
    scale = total / (sum(shares.values()) or 1.0)
    for name, share in shares.items():
        split = F.when(F.col("before") >= F.lit(low * scale), F.lit(name)).otherwise(split)
        low += share
    return of.join(placed.select("group_key", split.alias("split")), "group_key").select("id", "group_key", "split")


def split_checks(messages: DataFrame, roles: DataFrame, shares: Mapping[str, float] = SHARES, *, within: float = 0.05) -> DataFrame:
    """One row ``(messages, once_each, tied_together, near_shares)``: that every message has one split, that no tie of two tickets crosses splits, and that the shares are met ``within`` a share of all messages."""
    splits = checkpointed(split_messages(messages, roles, shares))
    tickets = messages.where("id is not null and ticket_id is not null").select("id", "ticket_id").distinct().join(splits, "id").groupBy("ticket_id").agg(F.min("split").alias("a"), F.max("split").alias("b"))
    tickets = checkpointed(tickets)
    ties = ticket_ties(messages, roles).join(tickets.select(F.col("ticket_id").alias("src"), F.col("a").alias("x")), "src").join(tickets.select(F.col("ticket_id").alias("dst"), F.col("a").alias("y")), "dst")
    crossing = ties.where("x <> y").limit(1).count() + tickets.where("a <> b").limit(1).count()
    near = F.lit(True)
    for name, part in shares.items():
        share = F.count_if(F.col("split") == name) / F.count(F.lit(1))
        near = near & (F.abs(share - part / sum(shares.values())) <= within)
    return splits.agg(F.count_distinct("id").alias("messages"), (F.count_distinct("id") == F.count(F.lit(1))).alias("once_each"), F.lit(crossing == 0).alias("tied_together"), near.alias("near_shares"))


def p2_found(messages: DataFrame, roles: DataFrame) -> DataFrame:
    """``(group_ticket, ticket_id)`` of each ticket tied to a smaller one."""
    return ticket_groups(messages, roles).where("ticket_id > group_ticket").select("group_ticket", "ticket_id")
