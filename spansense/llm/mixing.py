"""Problem 7: sources mixed to target shares of the tokens, interleaved by a Pfair schedule."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spansense.llm.tokens import token_counts
from spansense.runtime import checkpointed, running_total

#: Slots of the shortest and longest scheduling period, tokens of a block, and sources that a mix may have.
PERIOD, LONGEST_PERIOD, BLOCK_TOKENS, MOST_SOURCES = 10_000, 1_000_000, 1_024, 1_000


def period_of(shares: dict[str, float], period: int = PERIOD) -> int:
    """The slots of a period: ``period``, or so many times ten of it that every source gets ten slots at least, so that rounding moves no share by more than a twentieth.

    A share that would need more than ``LONGEST_PERIOD`` slots is an error: no source is ever dropped.
    """
    least = min(shares.values()) / sum(shares.values())
    while least * period < 10:
        period *= 10
        if period > LONGEST_PERIOD:
            if least * LONGEST_PERIOD >= 1:
                return LONGEST_PERIOD
            raise ValueError(f"a source has {least:.2e} of the mix; shares go down to 1 in {LONGEST_PERIOD:,}")
    return period


def slots_of(shares: dict[str, float], period: int) -> dict[str, int]:
    """How many of ``period`` slots each source gets: its share to the nearest whole by largest remainder, one at least, so that they add up."""
    total = sum(shares.values())
    exact = {s: share / total * period for s, share in shares.items()}
    slots = {s: max(1, int(x)) for s, x in exact.items()}
    spare = period - sum(slots.values())
    for s in sorted(exact, key=lambda s: (slots[s] - exact[s], s))[: max(0, spare)]:
        slots[s] += 1
    for s in sorted(exact, key=lambda s: (exact[s] - slots[s], s)) * 2:
        if sum(slots.values()) <= period:
            break
        slots[s] -= slots[s] > 1
    return slots


def pfair_schedule(slots: dict[str, int]) -> list[tuple[str, int]]:
    """``(source, block)`` of each slot of a period; the slots of all sources add up to its length.

    Block j (from 0) of a source with k of P slots is released at floor(jP/k) and due at ceil((j+1)P/k). Of the released blocks the one due
    first is taken, ties by source. All shares together are 1, so every block meets its window, and at any time a source is less than
    one block away from its share.
    """
    period = sum(slots.values())
    waiting = [(0, s) for s in slots]
    heapq.heapify(waiting)
    done = dict.fromkeys(slots, 0)
    ready: list[tuple[int, str]] = []
    out: list[tuple[str, int]] = []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(done[s] + 1) * period // slots[s]), s))
        due, s = heapq.heappop(ready)
        assert due > t, "a block missed its deadline"
        out.append((s, done[s]))
        done[s] += 1
        if done[s] < slots[s]:
            heapq.heappush(waiting, (done[s] * period // slots[s], s))
    return out


def plan_mix(have: dict[str, int], targets: dict[str, tuple[float, int]], period: int = PERIOD, total: int | None = None) -> tuple[dict[str, int], dict[str, float]]:
    """``(slots, quotas)``: the slots of a period and the tokens wanted of each source that can give any.

    ``have`` holds the tokens of each source, ``targets`` its share and how often a document may occur in all. A source without tokens, share or
    leave to occur is left out and the others keep their proportions. Without ``total`` the mix is as large as the scarcest source allows at exact shares. With it,
    sources that can't give their share of ``total`` tokens give all they can and the others make up for them in proportion; the mix is smaller only if all together have less.
    """
    can = {s: have.get(s, 0) * max(0, repeats) for s, (_, repeats) in targets.items()}
    shares = {s: share for s, (share, _) in targets.items() if share > 0 and can[s] > 0}
    if not shares:
        return {}, {}
    if total is not None:
        quotas: dict[str, float] = {}
        left, open_ = float(min(total, sum(can[s] for s in shares))), dict(shares)
        while open_:
            scale = left / sum(open_.values())
            short = {s for s, share in open_.items() if can[s] <= share * scale}
            for s in short or set(open_):
                quotas[s] = float(can[s]) if short else open_[s] * scale
            left -= sum(quotas[s] for s in short)
            open_ = {s: share for s, share in open_.items() if s not in quotas}
        shares = quotas
    slots = slots_of(shares, period_of(shares, period))
    length = sum(slots.values())
    size = min(can[s] * length / n for s, n in slots.items())
    return slots, {s: size * n / length for s, n in slots.items()}


def sized_documents(documents: DataFrame) -> DataFrame:
    """``(doc_id, source, tokens)`` of the documents with a source and at least one token; rows with one ``doc_id`` count once."""
    sources = documents.where("doc_id is not null and source is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("source").alias("source"))
    counts = token_counts(documents).groupBy("doc_id").agg(F.max("tokens").alias("tokens")).where("tokens > 0")
    return sources.join(counts, "doc_id")


def mix(documents: DataFrame, targets: DataFrame, *, period: int = PERIOD, block_tokens: int = BLOCK_TOKENS, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(mix, report)``: the mixed corpus as ``(slot, source, block, doc_id, repeat, token_from, tokens)``, and the shares reached.

    Each source's documents, in the order of a hash, pass after pass, fill blocks of exactly ``block_tokens`` tokens: a document goes on in its source's next block where one is full, so a row is the piece of
    a document from token ``token_from`` on that lies in one block. A block's slot comes from the Pfair schedule of its place in the period, so the order is that of ``slot``, within it of ``repeat`` and
    the hash. A document is taken while the tokens before it, and half of its own, are within its source's quota, at most ``max_repeats`` times (null counts as 1). ``total_tokens`` states the size of
    the mix, see :func:`plan_mix`. The report has ``(source, target_share, reached_share, tokens, documents, occurrences, most_repeats)``, one row per target; sources without a
    target are no part of the mix, and targets that no document serves reach 0. Sources are few: over ``MOST_SOURCES`` is an error.
    """
    spark = documents.sparkSession
    wanted = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("max_repeats"))
    rows = wanted.limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"a mix has at most {MOST_SOURCES} sources")
    sized = checkpointed(sized_documents(documents.select("doc_id", "source", "text")).join(wanted.select("source", "max_repeats"), "source").withColumn("hash", F.xxhash64("doc_id")))
    have = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    slots, quotas = plan_mix(have, {r["source"]: (r["target_share"] or 0.0, r["max_repeats"]) for r in rows}, period, total_tokens)
    plan = spark.createDataFrame([(s, n, float(quotas[s]), have[s]) for s, n in slots.items()], "source string, slots int, quota double, have bigint")
    template = spark.createDataFrame([(s, j, t) for t, (s, j) in enumerate(pfair_schedule(slots))] if slots else [], "source string, place int, at int")
    placed = running_total(sized.join(plan, "source"), ["source"], "hash", ["doc_id"], "tokens", "before")
    # pass p of a document starts p * have + before tokens into its source: how many passes begin within the quota
    fits = F.floor((F.col("quota") - F.col("before") - F.col("tokens") / 2) / F.col("have")) + 1
    times = F.greatest(F.lit(0), F.least(F.col("max_repeats"), fits)).cast("int")
    taken = placed.withColumn("repeat", F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))))
    taken = taken.withColumn("at", F.col("repeat") * F.col("have") + F.col("before"))
    first, last = F.floor(F.col("at") / block_tokens), F.floor((F.col("at") + F.col("tokens") - 1) / block_tokens)
    pieces = taken.withColumn("block", F.explode(F.sequence(first, last)))
    begin, end = F.greatest(F.col("at"), F.col("block") * block_tokens), F.least(F.col("at") + F.col("tokens"), (F.col("block") + 1) * block_tokens)
    pieces = pieces.select("source", "slots", "block", "doc_id", (F.col("repeat") + 1).alias("repeat"), (begin - F.col("at")).alias("token_from"), (end - begin).alias("piece"))
    pieces = pieces.withColumn("_period", F.floor(F.col("block") / F.col("slots"))).withColumn("place", (F.col("block") - F.col("_period") * F.col("slots")).cast("int"))
    slot = F.col("_period") * F.lit(sum(slots.values()) or 1) + F.col("at")
    mixed = pieces.join(template, ["source", "place"]).select(slot.cast("bigint").alias("slot"), "source", "block", "doc_id", "repeat", "token_from", F.col("piece").alias("tokens"))
    mixed = checkpointed(mixed)
    sums = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count_distinct("doc_id").alias("documents"), F.count_if(F.col("token_from") == 0).alias("occurrences"), F.max("repeat").alias("most_repeats"))
    total = mixed.agg(F.sum("tokens").alias("total"))
    report = wanted.select("source", "target_share").join(sums, "source", "left").join(F.broadcast(total)).select(
        "source", "target_share", F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("reached_share"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("tokens", "documents", "occurrences", "most_repeats")],
    )
    return mixed, report


def measured_deviation(mixed: DataFrame, *, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``(source, blocks, full, deviation)`` of a mix as it lies: each source's blocks, how many of them hold exactly ``block_tokens``, and how many tokens, in blocks, it is from its share at worst.

    The share is that of the source among all blocks. A source is furthest from it right before or right after one of its blocks, so its blocks' slots tell.
    """
    blocks = mixed.groupBy("source", "block", "slot").agg(F.sum("tokens").alias("tokens"))
    sizes = blocks.groupBy("source").agg((F.max("block") + 1).alias("n"), (F.max("slot") + 1).alias("slots"))
    total = sizes.agg(F.sum("n").alias("all"))
    rows = blocks.join(F.broadcast(sizes.select("source", "n")), "source").join(F.broadcast(total))
    share = F.col("n") / F.col("all")
    off = F.greatest(F.abs(F.col("block") - share * F.col("slot")), F.abs(F.col("block") + 1 - share * (F.col("slot") + 1)))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("tokens") == block_tokens).alias("full"), F.max(off).alias("deviation"))


def mix_checks(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, share_met, within_repeats, blocks_filled, within_block)`` per target: that a mix keeps its promises.

    A share is met if it is within a hundredth of what the source's target is among those that have documents; all blocks of a source but the last are full; and no source is
    ever a whole block and a half (a half for the rounding of quotas to documents) from its share.
    """
    mixed, report = mix(documents, targets)
    repeats = targets.where("source is not null").groupBy("source").agg(F.coalesce(F.max("max_repeats"), F.lit(1)).alias("max_repeats"))
    rows = report.join(repeats, "source").join(measured_deviation(mixed), "source", "left")
    served = rows.agg(F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).alias("served"))
    goal = F.when(F.col("tokens") > 0, F.col("target_share") / F.col("served")).otherwise(F.lit(0.0))
    return rows.join(F.broadcast(served)).select(
        "source", (F.abs(F.col("reached_share") - goal) < 0.01).alias("share_met"), (F.col("most_repeats") <= F.col("max_repeats")).alias("within_repeats"),
        F.coalesce(F.col("full") >= F.col("blocks") - 1, F.lit(True)).alias("blocks_filled"), F.coalesce(F.col("deviation") < 1.5, F.lit(True)).alias("within_block"),
    )


def deviation(schedule: list[tuple[str, int]], slots: dict[str, int]) -> float:
    """The largest distance, in blocks, of a source from its share at any time of a period."""
    period, done, worst = len(schedule), dict.fromkeys(slots, 0), 0.0
    for t, (s, _) in enumerate(schedule, 1):
        done[s] += 1
        worst = max(worst, max(abs(done[x] - t * n / period) for x, n in slots.items()))
    return worst
