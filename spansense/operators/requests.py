"""What is known of judge requests before they are sent: packing windows, token estimates and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spansense.errors import BudgetExceeded

# Bytes of a token, tokens of a question and of a picture, characters that a question adds to a request.
BYTES_PER_TOKEN, TOKENS_PER_QUESTION, TOKENS_PER_IMAGE, QUESTION_CHARS = 3, 8, 8_000, 140


def token_estimate(state: Column, questions: Column, images: Column | None = None) -> Column:
    """Tokens of a request: a third of the state's bytes, 8 a question, 8,000 a picture."""
    tokens = F.floor(F.octet_length(state) / BYTES_PER_TOKEN) + TOKENS_PER_QUESTION * questions
    return (tokens + TOKENS_PER_IMAGE * images if images is not None else tokens).cast("bigint")


def pack_windows(costs: Column, per: int, chars: int) -> Column:
    """The window of each item, from 0: an item opens a new one if the window holds ``per`` items or would exceed ``chars``.

    ``costs`` is an array of the items' characters in order. The fold copies its state per item: it is meant for the spans of a text, tens to hundreds.
    """
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("size"), F.lit(-1).alias("w"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, c: Column) -> Column:
        fresh = (a["n"] == 0) | (a["n"] >= per) | (a["size"] + c > chars)
        w = F.when(fresh, a["w"] + 1).otherwise(a["w"])
        return F.struct(
            F.when(fresh, 1).otherwise(a["n"] + 1).alias("n"), F.when(fresh, c.cast("bigint")).otherwise(a["size"] + c).alias("size"), w.alias("w"), F.concat(a["out"], F.array(w)).alias("out")
        )

    return F.aggregate(costs, start, step, lambda a: a["out"])


def requests_of(spans: DataFrame, *, keys: list[str], per: int = 32, chars: int = 60_000, overhead: int = QUESTION_CHARS, text: str = "text") -> DataFrame:
    """``(keys, window, items, chars)``: the requests that judging the spans of each text takes."""
    lists = spans.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ord", (F.length(text) + overhead).alias("cost")))).alias("s"))
    lists = lists.withColumn("w", pack_windows(F.col("s.cost"), per, chars))
    rows = lists.select(*keys, F.explode(F.arrays_zip(F.col("w").alias("w"), F.col("s.cost").alias("cost"))).alias("x")).select(*keys, F.col("x.w").alias("window"), F.col("x.cost").alias("cost"))
    return rows.groupBy(*keys, "window").agg(F.count(F.lit(1)).alias("items"), F.sum("cost").cast("bigint").alias("chars"))


def cost_estimate(requests: DataFrame, tokens: str, price_per_mtok: float) -> DataFrame:
    """One row ``(requests, tokens, cost)``: what sending all requests would cost."""
    return requests.agg(F.count(F.lit(1)).alias("requests"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens")).withColumn("cost", F.col("tokens") * F.lit(price_per_mtok) / 1e6)


def within_budget(requests: DataFrame, tokens: str, price_per_mtok: float, max_cost: float) -> float:
    """The estimated cost; an error if it exceeds ``max_cost``, before anything is sent."""
    cost = cost_estimate(requests, tokens, price_per_mtok).first()["cost"]
    if cost > max_cost:
        raise BudgetExceeded(f"the requests cost about {cost:.6f}, the cap is {max_cost:.6f}")
    return cost
