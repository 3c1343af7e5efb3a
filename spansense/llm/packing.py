"""Problem 3: requests packed into few containers of fixed capacity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spansense.runtime import checkpointed

#: Windows that a partition keeps open for each capability, and the requests that one packing task takes of a capability.
OPEN_WINDOWS, ROWS_PER_TASK = 16, 4_000

_ITEM = (
    "capability_id string, request_key string, piece int, pieces int, char_from bigint, question_from bigint, chars bigint, questions bigint, tokens bigint, oversize boolean, window_id string, is_window boolean"
)


def sized_requests(requests: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Every request once, with its size, its capability's limits and what it consists of.

    Columns: ``request_key`` (a digest of the row, so that repeated rows meet), ``request_id, capability_id, known, chars, questions, tokens, max_chars, max_questions, max_tokens, state, asked``. A limit that is null, and an
    unknown capability, limit nothing. A missing size counts as 0 characters, 0 questions or a third of the state's bytes plus 8 a question, at most the limit, so it exceeds nothing.
    """
    limits = capabilities.where("capability_id is not null").groupBy("capability_id").agg(
        F.min("max_state_chars").cast("bigint").alias("max_chars"), F.min("max_questions").cast("bigint").alias("max_questions"), F.min("max_input_tokens").cast("bigint").alias("max_tokens"), F.lit(True).alias("known")
    )
    state = F.col("state_utf8").cast("binary")
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(x, F.lit("\x00")) for x in (F.col("request_id"), F.col("capability_id"), F.sha2(state, 256), F.to_json("questions"), F.col("estimated_tokens").cast("string"))]), 256)
    text = state.cast("string")
    rows = requests.select(
        digest.alias("request_key"), "request_id", "capability_id", text.alias("state"), F.col("questions").alias("asked"),
        F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("chars"), F.greatest(F.coalesce(F.size("questions"), F.lit(0)), F.lit(0)).cast("bigint").alias("questions"),
        F.col("estimated_tokens").cast("bigint").alias("tokens"), F.coalesce(F.octet_length(state), F.lit(0)).cast("bigint").alias("bytes"),
    )
    rows = rows.dropDuplicates(["request_key"]).join(limits, "capability_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    guess = F.ceil(F.col("bytes") / 3) + 8 * F.col("questions")
    return rows.withColumn("tokens", F.coalesce("tokens", F.least(guess, F.coalesce("max_tokens", guess))).cast("bigint")).drop("bytes")


class _Window:
    """An open window: what it holds and, for the best fit, how full its fullest limited dimension is."""

    __slots__ = ("chars", "id", "questions", "tokens")

    def __init__(self, name: str) -> None:
        self.id, self.chars, self.questions, self.tokens = name, 0, 0, 0


def pack_partition(open_windows: int):
    """The online packer of one partition: rows come ordered by capability; each goes into the open window it fits best. One that exceeds even an empty window is cut.

    When none fits and ``open_windows`` are open, the fullest is closed and a new one opened. What is still open at a capability's end is
    emitted as a window row, to be merged later. Rows of unknown capabilities get a window each.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cap, salt, windows, made = None, None, [], 0
        out: list[tuple] = []

        def leave() -> None:
            for w in windows:
                out.append((cap, None, None, None, None, None, w.chars, w.questions, w.tokens, None, w.id, True))

        def fill(w: _Window, limits: tuple) -> float:
            return max([x / lim for x, lim in zip((w.chars, w.questions, w.tokens), limits) if lim] or [0.0])

        def place(sizes: tuple, limits: tuple, known: bool, item: str | None, row: tuple) -> None:
            """Puts one piece into the open window that it fits best, or into a new one."""
            nonlocal made
            best, best_fill = None, -1.0
            if known:
                for w in windows:
                    after = (w.chars + sizes[0], w.questions + sizes[1], w.tokens + sizes[2])
                    if all(lim is None or x <= lim for x, lim in zip(after, limits)):
                        full = max([x / lim for x, lim in zip(after, limits) if lim] or [0.0])
                        if full > best_fill:
                            best, best_fill = w, full
            if best is None:
                # a window on its way through a merging round keeps its name until another takes it in
                best, made = _Window(item or f"{cap or ''}/{salt}/{made}"), made + 1
                if known:
                    if len(windows) >= open_windows:
                        windows.remove(max(windows, key=lambda w: fill(w, limits)))
                    windows.append(best)
            best.chars, best.questions, best.tokens = best.chars + sizes[0], best.questions + sizes[1], best.tokens + sizes[2]
            out.append((cap, *row, best.id, False))

        for pdf in batches:
            names = ["capability_id", "salt", "known", "request_key", "chars", "questions", "tokens", "max_chars", "max_questions", "max_tokens", "item"]
            for c, s, known, key, *rest in zip(*[pdf[n].tolist() for n in names]):
                c = None if c != c else c
                if (c, s) != (cap, salt):
                    leave()
                    cap, salt, windows, made = c, s, [], 0
                limits = tuple(int(x) if x is not None and x == x else None for x in rest[3:6])
                whole, item = tuple(map(int, rest[:3])), rest[6] if rest[6] == rest[6] else None
                oversize = any(lim is not None and x > lim for x, lim in zip(whole, limits))
                # only what no empty window holds is cut, into the least number of equal parts; a limit below 1 counts as 1 for that
                pieces = max([-(-x // max(lim, 1)) for x, lim in zip(whole, limits) if lim is not None and x > lim] or [1])
                for k in range(pieces):
                    begin, end = [x * k // pieces for x in whole], [x * (k + 1) // pieces for x in whole]
                    sizes = tuple(b - a for a, b in zip(begin, end))
                    place(sizes, limits, known, item, (key, k, pieces, begin[0], begin[1], *sizes, oversize))
            yield frame(out)
            out.clear()
        leave()
        if out:
            yield frame(out)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        cols = ["capability_id", "request_key", "piece", "pieces", "char_from", "question_from", "chars", "questions", "tokens", "oversize", "window_id", "is_window"]
        pdf = pd.DataFrame(rows, columns=cols)
        return pdf.astype({"piece": "Int32", "pieces": "Int32", "char_from": "Int64", "question_from": "Int64", "oversize": "boolean"})

    return run


def _round(items: DataFrame, salts: DataFrame, name: str, open_windows: int) -> DataFrame:
    """One packing round: rows go to the task of their capability and salt, in a fixed order, and are packed there."""
    salted = items.join(salts, items["capability_id"].eqNullSafe(salts["_cap"]), "left").drop("_cap")
    salted = salted.withColumn("salt", F.concat(F.lit(name), F.pmod(F.xxhash64("request_key"), F.coalesce("_salts", F.lit(1))).cast("string"))).drop("_salts")
    placed = salted.repartition("capability_id", "salt").sortWithinPartitions("capability_id", "salt", "request_key")
    return checkpointed(placed.mapInPandas(pack_partition(open_windows), _ITEM))


def _salts(items: DataFrame, rows_per_task: int) -> tuple[DataFrame, int]:
    """How many tasks share the rows of each capability, and the largest such number."""
    n = items.groupBy(F.col("capability_id").alias("_cap")).agg(F.ceil(F.count(F.lit(1)) / rows_per_task).cast("int").alias("_salts"))
    return n, n.agg(F.max("_salts")).first()[0] or 0


def _packed(sized: DataFrame, open_windows: int, rows_per_task: int) -> DataFrame:
    """The pieces of all requests of :func:`sized_requests` and their windows."""
    items = sized.drop("state", "asked", "request_id").withColumn("item", F.lit(None).cast("string"))
    salts, most = _salts(items, rows_per_task)
    packed = _round(items, salts, "", open_windows)
    placed = packed.where("not is_window").drop("is_window")
    left, number = packed.where("is_window"), 0
    limits = sized.where("known").select("capability_id", "known", "max_chars", "max_questions", "max_tokens").distinct()
    while most > 1:
        number += 1
        again = left.select("capability_id", F.col("window_id").alias("request_key"), "chars", "questions", "tokens", F.col("window_id").alias("item"))
        salts, fewer = _salts(again, rows_per_task)
        most = 1 if fewer >= most else fewer  # a task that takes fewer rows than it leaves windows can't merge further
        merged = _round(again.join(limits, "capability_id"), salts, f"m{number}.", max(open_windows, 64))
        moves = merged.where("not is_window").select(F.col("request_key").alias("window_id"), F.col("window_id").alias("_to"))
        placed = placed.join(moves, "window_id", "left").withColumn("window_id", F.coalesce("_to", "window_id")).drop("_to")
        left = merged.where("is_window")
    return placed


def pack(requests: DataFrame, capabilities: DataFrame, *, open_windows: int = OPEN_WINDOWS, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``(request_id, request_key, capability_id, piece, pieces, char_from, question_from, chars, questions, tokens, oversize, window_id)``: where each request, or piece, is sent.

    Bounded-space best fit: the requests of a capability are spread over as many tasks as its rows need; each task keeps ``open_windows``
    open, places best-fit and closes the fullest when none fits; the windows left open are packed again as if they were requests until
    one task holds all of a capability's. No window exceeds a limit of its capability, and only requests that no empty window holds are cut (``oversize``): piece k, from 1, has
    ``chars`` code points of the state from ``char_from`` and ``questions`` questions from ``question_from`` on, both from 0. Unknown and null capabilities have no known limits, so their requests go out alone.
    Repeated rows are packed once; an empty table gives no rows; a null ``request_id`` is kept as it is.
    """
    sized = checkpointed(sized_requests(requests, capabilities).drop("state", "asked"))
    out = _packed(sized, open_windows, rows_per_task).join(sized.select("request_key", "request_id"), "request_key")
    return out.select("request_id", "request_key", "capability_id", (F.col("piece") + 1).alias("piece"), "pieces", "char_from", "question_from", "chars", "questions", "tokens", "oversize", "window_id")


def filled(requests: DataFrame, capabilities: DataFrame, *, open_windows: int = OPEN_WINDOWS, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``(window_id, capability_id, request_id, request_key, piece, pieces, state, questions)``: what each window holds, a row per piece with its part of the state and its questions.

    A window's rows in the order of ``request_key`` and ``piece`` are the request to send; the pieces of a request in order are its state, character by character. Null states stay null.
    """
    sized = checkpointed(sized_requests(requests, capabilities))
    rows = _packed(sized.drop("state", "asked"), open_windows, rows_per_task).join(sized.select("request_key", "request_id", "state", "asked"), "request_key")
    state = F.substring(F.col("state"), (F.col("char_from") + 1).cast("int"), F.col("chars").cast("int"))
    asked = F.when(F.col("asked").isNotNull(), F.slice(F.col("asked"), (F.col("question_from") + 1).cast("int"), F.col("questions").cast("int")))
    return rows.select("window_id", "capability_id", "request_id", "request_key", (F.col("piece") + 1).alias("piece"), "pieces", state.alias("state"), asked.alias("questions"))


def rebuilt(requests: DataFrame, capabilities: DataFrame, *, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``(request_id, digest, questions)``: each packed request put together again from the windows, as SHA-256 of its state and its number of questions. No request has more pieces than characters and questions."""
    rows = filled(requests, capabilities, rows_per_task=rows_per_task)
    lists = rows.groupBy("request_key").agg(F.first("request_id").alias("request_id"), F.sort_array(F.collect_list(F.struct("piece", "state", F.size("questions").alias("n")))).alias("p"))
    state = F.when(F.exists("p.state", lambda x: x.isNotNull()), F.array_join("p.state", ""))
    return lists.select("request_id", F.sha2(state, 256).alias("digest"), F.aggregate("p.n", F.lit(0), lambda a, x: a + F.greatest(x, F.lit(0))).alias("questions"))


def packing_checks(requests: DataFrame, capabilities: DataFrame, *, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``(capability_id, within_limits, complete, cut_only_if_too_large, close_to_least)`` per known capability with requests: that a packing keeps its promises.

    It is complete if its windows hold as many characters and questions as the requests have; close to the least if it takes at most twice the number of windows that its sizes allow and two
    (best fit never leaves two windows that would go into one).
    """
    sized = checkpointed(sized_requests(requests, capabilities).drop("state", "asked"))
    packed = _packed(sized, OPEN_WINDOWS, rows_per_task)
    sizes, most = ("chars", "questions", "tokens"), ("max_chars", "max_questions", "max_tokens")
    limits = sized.where("known").groupBy("capability_id").agg(*[F.max(c).alias(c) for c in most], *[F.sum(c).alias(f"all_{c}") for c in sizes])
    windows = packed.groupBy("capability_id", "window_id").agg(*[F.sum(c).alias(c) for c in sizes]).join(limits, "capability_id")
    cap = lambda m: F.when(m.isNotNull(), F.greatest(m, F.lit(1)))
    fits = F.lit(True)
    for c, m in zip(sizes, most):
        fits = fits & F.coalesce(F.col(c) <= cap(F.col(m)), F.lit(True))
    need = F.greatest(*[F.coalesce(F.ceil(F.max(f"all_{c}") / cap(F.max(m))), F.lit(1)) for c, m in zip(sizes, most)])
    held = windows.groupBy("capability_id").agg(F.bool_and(fits).alias("within_limits"), ((F.sum("chars") == F.max("all_chars")) & (F.sum("questions") == F.max("all_questions"))).alias("complete"), (F.count(F.lit(1)) <= 2 * need + 2).alias("close_to_least"))
    cut = packed.groupBy("capability_id").agg(F.bool_and((F.col("pieces") == 1) | F.col("oversize")).alias("cut_only_if_too_large"))
    return held.join(cut, "capability_id").select("capability_id", "within_limits", "complete", "cut_only_if_too_large", "close_to_least")


def packing_report(packed: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Per capability: pieces, windows, the least number of windows that its sizes allow, and their ratio."""
    sums = packed.groupBy("capability_id").agg(F.count(F.lit(1)).alias("pieces"), F.countDistinct("window_id").alias("windows"), *[F.sum(c).alias(c) for c in ("chars", "questions", "tokens")])
    limits = capabilities.select("capability_id", "max_state_chars", "max_questions", "max_input_tokens").dropDuplicates(["capability_id"])
    need = F.greatest(*[F.coalesce(F.ceil(F.col(s) / F.col(m)), F.lit(1)) for s, m in (("chars", "max_state_chars"), ("questions", "max_questions"), ("tokens", "max_input_tokens"))])
    return sums.join(limits, "capability_id").select("capability_id", "pieces", "windows", need.alias("least_windows"), (need / F.col("windows")).alias("fill"))


def p3_found(requests: DataFrame, capabilities: DataFrame) -> DataFrame:
    """The requests that exceed a limit of their capability alone, once each: those that the packer found to go into no empty window."""
    return pack(requests, capabilities).where("oversize and request_id is not null").select("request_id").distinct()

