"""Problem 1: ordered conversations out of message rows.

Every row is a fragment of its conversation's export: the turns that its sender's tool had seen, then its own. Fragments that overlap, the
suffix of one being the prefix of the next, are joined into paths where the overlap is unambiguous; what the head of a path quotes and no
fragment says is a gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spansense.functions.text import has_text
from spansense.llm.messages import message_time, with_speaker
from spansense.runtime import checkpointed


def _window_of(*turns: Column) -> Column:
    """The key of a run of turns; runs of different length never share one by construction of the hash input."""
    return F.xxhash64(F.lit(len(turns)), *turns)


def fragments(messages: DataFrame, roles: DataFrame) -> DataFrame:
    """One row per message row with a ticket: its turn, its place in time and the hashes of the turns that its fragment is made of.

    ``said`` is the hash of the own turn (speaker and exact text), null if it has no known speaker or no text; ``quoted`` the hashes of the
    turns before it, nulls left out; ``fragment`` names the sequence of both.
    """
    rows = with_speaker(messages.where(F.col("ticket_id").isNotNull()), roles)
    quotes = F.filter(F.coalesce(F.col("prior_turns"), F.array().cast("array<string>")), lambda x: x.isNotNull())
    rows = rows.select(
        "ticket_id",
        "id",
        F.coalesce(F.col("revision").try_cast("bigint"), F.lit(-1).cast("bigint")).alias("revision"),
        F.col("received_at").cast("timestamp").alias("received_at"),
        message_time().alias("time"),
        "speaker",
        "text",
        F.xxhash64("text").alias("text_hash"),
        has_text(F.col("text")).alias("visible"),
        F.xxhash64(F.concat(F.col("speaker"), F.lit(": "), F.col("text"))).alias("said"),
        F.concat("speaker", F.lit(": "), "text").isNotNull().alias("_says"),
        F.transform(quotes, lambda x: F.xxhash64(x)).alias("quoted"),
    )
    rows = rows.withColumn("said", F.when(F.col("_says"), F.col("said"))).drop("_says")
    # a row that says nothing can be nobody's predecessor, but it has quotes
    return rows.withColumn("fragment", F.xxhash64("quoted", F.coalesce(F.col("said").cast("string"), F.concat(F.lit("row "), F.coalesce(F.col("id"), F.lit(""))))))


def overlap_graph(frags: DataFrame) -> DataFrame:
    """The overlap graph by junction: one row per ticket and window of one or two turns in which a fragment ends or before which one starts.

    A fragment ends in the window of its last turn and, if it has any before, of its last two; it starts after the window of its last one or two quotes.
    So a fragment whose end window is another's start window overlaps it by suffix and prefix. Only the smallest and largest fragment on
    each side are kept: they are equal iff the side is unambiguous. No pair of fragments is ever listed.
    """
    n = F.size("quoted")
    last, before = F.try_element_at("quoted", F.lit(-1)), F.try_element_at("quoted", F.lit(-2))
    null = F.lit(None).cast("bigint")

    def event(key: Column, size: Column, end: Column, start: Column, qa: Column, qb: Column) -> Column:
        return F.struct(key.alias("window"), size.alias("turns"), end.alias("end"), start.alias("start"), qa.alias("qa"), qb.alias("qb"))

    frag = F.col("fragment")
    events = F.array(
        F.when(F.col("said").isNotNull(), event(_window_of(F.col("said")), F.lit(1), frag, null, null, null)),
        F.when(F.col("said").isNotNull() & (n > 0), event(_window_of(last, F.col("said")), F.lit(2), frag, null, null, null)),
        F.when(n == 1, event(_window_of(last), F.lit(1), null, frag, null, last)),
        F.when(n > 1, event(_window_of(before, last), F.lit(2), null, frag, before, last)),
    )
    events = frags.select("ticket_id", F.explode(F.filter(events, lambda x: x.isNotNull())).alias("e")).select("ticket_id", "e.*")
    graph = events.groupBy("ticket_id", "window").agg(
        F.max("turns").alias("turns"),
        F.min("end").alias("end_min"), F.max("end").alias("end_max"),
        F.min("start").alias("start_min"), F.max("start").alias("start_max"),
        F.max("qa").alias("qa"), F.max("qb").alias("qb"),
    )
    return graph.withColumn("merged", F.coalesce((F.col("end_min") == F.col("end_max")) & (F.col("start_min") == F.col("start_max")), F.lit(False)))


def gaps(frags: DataFrame, graph: DataFrame) -> DataFrame:
    """``(ticket_id)`` of the tickets with a gap: a path's head quotes a turn that no fragment of the ticket says.

    Within a path every quote is the predecessor's turn or one that the predecessor quoted, so only heads need a look.
    """
    word = F.struct
    said = F.when((F.col("turns") == 1) & F.col("end_min").isNotNull(), word(F.col("window").alias("window"), F.lit(1).alias("said"), F.lit(0).alias("wanted")))
    head = F.col("start_min").isNotNull() & ~F.col("merged")
    want = [F.when(head & F.col(q).isNotNull(), word(_window_of(F.col(q)).alias("window"), F.lit(0).alias("said"), F.lit(1).alias("wanted"))) for q in ("qa", "qb")]
    turns = graph.select("ticket_id", F.explode(F.filter(F.array(said, *want), lambda x: x.isNotNull())).alias("e")).select("ticket_id", "e.*")
    # quotes further back than a window reaches are looked up one by one
    far = frags.where(F.size("quoted") > 2).select("ticket_id", F.explode(F.expr("slice(quoted, 1, size(quoted) - 2)")).alias("q"))
    turns = turns.unionByName(far.select("ticket_id", _window_of(F.col("q")).alias("window"), F.lit(0).alias("said"), F.lit(1).alias("wanted")))
    unsaid = turns.groupBy("ticket_id", "window").agg(F.max("said").alias("said"), F.max("wanted").alias("wanted")).where("said = 0 and wanted = 1")
    return unsaid.select("ticket_id").distinct()


def turns(frags: DataFrame, *, text: bool) -> DataFrame:
    """The kept row of each message that holds text: the one with the highest revision, among equals the last received, then a fixed order."""
    wanted = ["revision", "received_at", "time", "speaker", "text_hash", "visible", "fragment"]
    best = frags.select("ticket_id", "id", F.struct(*wanted, *(["text"] if text else [])).alias("row"))
    kept = best.groupBy("ticket_id", "id").agg(F.max("row").alias("row")).select("ticket_id", "id", "row.*")
    return kept.where("visible").drop("visible", "text_hash", "revision", "received_at")


def verdicts(messages: DataFrame, roles: DataFrame) -> DataFrame:
    """``(ticket_id, timeless, unknown_role, gap, unanswered, empty, broken)``: one row per ticket, and why it must be dropped.

    A ticket is broken if a turn has no time or no known role, if its fragments leave a gap, or if, system turns aside, it has no
    customer turn, no agent turn, or a customer turn after the last agent turn (equal times go by ``id``). Rows without ``ticket_id`` belong to no
    ticket; an empty table gives no rows; repeated rows change nothing; a null ``id`` is a message of its own.
    """
    frags = checkpointed(fragments(messages, roles).drop("text"))  # read by four branches
    return _verdicts(frags, overlap_graph(frags))


def _verdicts(frags: DataFrame, graph: DataFrame) -> DataFrame:
    at = F.struct(F.col("time"), F.col("id"))
    one = lambda x: F.coalesce(x.cast("int"), F.lit(0))
    by_ticket = turns(frags, text=False).groupBy("ticket_id").agg(
        F.max(one(F.col("time").isNull())).alias("timeless"),
        F.max(one(F.col("speaker").isNull())).alias("unknown_role"),
        F.max(F.when(F.col("speaker") == "customer", at)).alias("last_customer"),
        F.max(F.when(F.col("speaker") == "agent", at)).alias("last_agent"),
    )
    flags = by_ticket.select(
        "ticket_id", "timeless", "unknown_role", F.lit(0).alias("gap"),
        one(F.col("last_customer") > F.col("last_agent")).alias("unanswered"),
        F.lit(1).alias("has_turns"),
        one(F.col("last_customer").isNotNull() & F.col("last_agent").isNotNull()).alias("both"),
    )
    none = lambda df, gap: df.select("ticket_id", *[F.lit(v).alias(n) for n, v in (("timeless", 0), ("unknown_role", 0), ("gap", gap), ("unanswered", 0), ("has_turns", 0), ("both", 0))])
    all_tickets = frags.select("ticket_id").distinct()
    marks = flags.unionByName(none(gaps(frags, graph), 1)).unionByName(none(all_tickets, 0))
    summed = marks.groupBy("ticket_id").agg(*[F.max(c).alias(c) for c in ("timeless", "unknown_role", "gap", "unanswered", "has_turns", "both")])
    yes = lambda c: F.col(c) == 1
    return summed.select(
        "ticket_id", yes("timeless").alias("timeless"), yes("unknown_role").alias("unknown_role"), yes("gap").alias("gap"),
        (yes("unanswered") | (yes("has_turns") & ~yes("both"))).alias("unanswered"), (~yes("has_turns")).alias("empty"),
    ).withColumn("broken", F.col("timeless") | F.col("unknown_role") | F.col("gap") | F.col("unanswered") | F.col("empty"))


def paths(graph: DataFrame, *, max_rounds: int = 40) -> DataFrame:
    """``(ticket_id, fragment, path)``: the head of the merged path of each fragment that has a predecessor. Heads name their own path.

    Pointer doubling along the unambiguous overlaps: after round k every fragment within ``2**k`` of its head knows it, and only the others go
    on. When a round settles none of them they lie on cycles; each then stands alone.
    """
    links = graph.where("merged").groupBy("ticket_id", F.col("start_min").alias("fragment")).agg(F.max(F.struct("turns", "end_min")).alias("p"))
    links = checkpointed(links.select("ticket_id", "fragment", F.col("p.end_min").alias("path")).where("path <> fragment"))
    left = links.count()
    for _ in range(max_rounds):
        if not left:
            break
        step = links.select("ticket_id", F.col("fragment").alias("path"), F.col("path").alias("next"))
        links = checkpointed(links.join(step, ["ticket_id", "path"], "left").select("ticket_id", "fragment", F.coalesce("next", "path").alias("path"), F.col("next").isNull().alias("done")))
        now = links.where("not done").count()
        if now == left:
            links = links.withColumn("path", F.when(F.col("done"), F.col("path")).otherwise(F.col("fragment")))
            break
        left = now
    return links.select("ticket_id", "fragment", "path")


def conversations(messages: DataFrame, roles: DataFrame) -> DataFrame:
    """``(ticket_id, turn_no, id, speaker, sent_at, text, path)``: the turns of every unbroken ticket, numbered from 1 by time, then ``id``.

    ``path`` names the merged path of export fragments that the turn's row belongs to. A ticket may hold any share of the rows: turns are
    counted by ticket, day and second, and only those of one second are ordered by a task. See :func:`verdicts` for what is dropped.
    """
    frags = fragments(messages, roles)
    slim = checkpointed(frags.drop("text"))
    graph = checkpointed(overlap_graph(slim))
    sound = _verdicts(slim, graph).where("not broken").select("ticket_id")
    kept = turns(frags, text=True).join(sound, "ticket_id").withColumns({"day": F.unix_date(F.to_date("time")), "second": F.floor(F.unix_micros("time") / 1_000_000)})
    seconds = kept.groupBy("ticket_id", "day", "second").agg(F.count(F.lit(1)).alias("n"))
    days = seconds.groupBy("ticket_id", "day").agg(F.sum("n").alias("n"))
    before = lambda *keys: F.coalesce(F.sum("n").over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select("ticket_id", "day", before("ticket_id", "day").alias("of_days"))
    seconds = seconds.select("ticket_id", "day", "second", before("ticket_id", "day", "second").alias("of_seconds")).join(days, ["ticket_id", "day"])
    seconds = seconds.select("ticket_id", "second", (F.col("of_days") + F.col("of_seconds")).alias("base"))
    within = Window.partitionBy("ticket_id", "second").orderBy("time", "id")
    placed = kept.join(seconds, ["ticket_id", "second"]).withColumn("turn_no", (F.col("base") + F.row_number().over(within)).cast("bigint"))
    merged = placed.join(paths(graph), ["ticket_id", "fragment"], "left")
    return merged.select("ticket_id", "turn_no", "id", "speaker", F.col("time").alias("sent_at"), "text", F.coalesce("path", "fragment").alias("path"))


def p1_found(messages: DataFrame, roles: DataFrame) -> DataFrame:
    """The tickets to drop, once each."""
    return verdicts(messages, roles).where("broken").select("ticket_id")
