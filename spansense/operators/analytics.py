"""Scores of predictions and other evaluation statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spansense.operators.components import connected_components, star_edges
from spansense.runtime import checkpointed, skew_join


def ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    """``a / b``, or ``empty`` where ``b`` is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(empty).cast("double"))


def binary_scores(rows: DataFrame, predicted: Column, gold: Column, by: list[str] | None = None) -> DataFrame:
    """``(n, accuracy, precision, recall)`` of yes-or-no predictions, of each group of ``by``; a share of nothing is 1. Rows without a gold value don't count."""
    tp, fp, fn = F.count_if(predicted & gold), F.count_if(predicted & ~gold), F.count_if(~predicted & gold)
    right = F.count_if(predicted == gold)
    n = F.count(F.lit(1))
    return rows.where(gold.isNotNull()).groupBy(*(by or [])).agg(n.alias("n"), ratio(right, n, 1.0).alias("accuracy"), ratio(tp, tp + fp, 1.0).alias("precision"), ratio(tp, tp + fn, 1.0).alias("recall"))


def value_scores(rows: DataFrame, predicted: str, gold: str) -> DataFrame:
    """``(n, right, accuracy)``: texts are equal if they are without white space; a null equals a null."""
    bare = lambda c: F.regexp_replace(F.col(c), r"[\s\p{Z}]+", "")
    right = F.count_if(bare(predicted).eqNullSafe(bare(gold)))
    return rows.agg(F.count(F.lit(1)).alias("n"), right.alias("right"), ratio(right, F.count(F.lit(1)), 1.0).alias("accuracy"))


def accuracy_by(rows: DataFrame, by: list[str], predicted: Column, gold: Column) -> DataFrame:
    """``(by, n, accuracy)``."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((predicted == gold).cast("double")).alias("accuracy"))


def span_scores(predicted: DataFrame, gold: DataFrame, key: str, neutral: DataFrame | None = None) -> DataFrame:
    """One row ``(gold, covered, exact, predicted, landed, false_positives, leaked, precision, recall)`` of spans ``(key, start, end)``.

    A gold span is covered if predicted spans together cover all its characters; otherwise it leaks. A predicted span lands if it touches a gold span of
    its text; one that touches a neutral span instead is no false positive. Shares of nothing are 1.
    """
    p = predicted.select(F.col(key).alias("k"), F.col("start").alias("ps"), F.col("end").alias("pe")).distinct()
    g = gold.select(F.col(key).alias("k"), F.col("start").alias("gs"), F.col("end").alias("ge")).distinct()
    touch = g.join(p, (g["k"] == p["k"]) & (F.col("ps") < F.col("ge")) & (F.col("gs") < F.col("pe")), "left").select(g["k"].alias("k"), "gs", "ge", "ps", "pe")
    parts = touch.groupBy("k", "gs", "ge").agg(F.array_compact(F.sort_array(F.collect_list(F.when(F.col("ps").isNotNull(), F.struct("ps", "pe"))))).alias("s"))
    reach = F.aggregate("s", F.col("gs"), lambda a, x: F.when(x["ps"] <= a, F.greatest(a, x["pe"])).otherwise(a))
    golds = parts.withColumn("covered", reach >= F.col("ge")).withColumn("exact", F.exists("s", lambda x: (x["ps"] == F.col("gs")) & (x["pe"] == F.col("ge"))))
    a = golds.agg(F.count(F.lit(1)).alias("gold"), F.count_if("covered").alias("covered"), F.count_if("exact").alias("exact"))
    hits = p.join(g.withColumnRenamed("k", "gk"), (F.col("k") == F.col("gk")) & (F.col("ps") < F.col("ge")) & (F.col("gs") < F.col("pe")), "left_semi").withColumn("landed", F.lit(True))
    rest = p.join(hits.drop("landed"), ["k", "ps", "pe"], "left_anti")
    if neutral is not None:
        n = neutral.select(F.col(key).alias("nk"), F.col("start").alias("ns"), F.col("end").alias("ne"))
        rest = rest.join(n, (F.col("k") == F.col("nk")) & (F.col("ps") < F.col("ne")) & (F.col("ns") < F.col("pe")), "left_anti")
    counts = F.broadcast(p.agg(F.count(F.lit(1)).alias("predicted"))), F.broadcast(hits.agg(F.count(F.lit(1)).alias("landed"))), F.broadcast(rest.agg(F.count(F.lit(1)).alias("false_positives")))
    for c in counts:
        a = a.join(c)
    return a.withColumns({
        "leaked": F.col("gold") - F.col("covered"),
        "precision": ratio(F.col("landed"), F.col("landed") + F.col("false_positives"), 1.0),
        "recall": ratio(F.col("covered"), F.col("gold"), 1.0),
    })


def calibration(rows: DataFrame, p: str, gold: Column, bins: int = 10) -> DataFrame:
    """``(bin, n, mean_p, rate)``: predicted against observed by bins of equal width; 1 belongs to the last."""
    b = F.floor(F.least(F.col(p) * bins, F.lit(bins - 1))).cast("int").alias("bin")
    return rows.groupBy(b).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(gold.cast("double")).alias("rate"))


def brier(rows: DataFrame, p: str, gold: Column) -> DataFrame:
    """One row ``(n, brier)``: the mean squared distance of probability and outcome."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col(p) - gold.cast("double"), F.lit(2))).alias("brier"))


def risk_coverage(rows: DataFrame, p: str, gold: Column, thresholds: tuple[float, ...] = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99)) -> DataFrame:
    """``(threshold, coverage, risk)``: the share of rows sure to at least the threshold, either way, and how many of them are wrong."""
    sure = F.greatest(F.col(p), 1 - F.col(p))
    wrong = (F.col(p) >= 0.5) != gold
    aggs = [F.struct(F.lit(t).alias("threshold"), ratio(F.count_if(sure >= t), F.count(F.lit(1))).alias("coverage"), ratio(F.count_if((sure >= t) & wrong), F.count_if(sure >= t)).alias("risk")) for t in thresholds]
    return rows.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("a")).select("a.*")


def percentile_floor(column: str, q: float) -> Column:
    """The value at place floor(q n) of the sorted values, at most the last; null for none. Of a bounded group only: it holds its values."""
    xs = F.sort_array(F.collect_list(column))
    return F.get(xs, F.least(F.size(xs) - 1, F.floor(F.size(xs) * q).cast("int")))


def percentile_ceil(column: str, q: float) -> Column:
    """The value at place ceil(q n) - 1, the nearest rank; null for none. Of a bounded group only."""
    xs = F.sort_array(F.collect_list(column))
    return F.get(xs, F.greatest(F.lit(0), F.ceil(F.size(xs) * q).cast("int") - 1))


def percentile_ranks(rows: DataFrame, column: str, qs: list[float], *, nearest: bool = True) -> DataFrame:
    """``(q, value)`` of a whole column at exact ranks, by counting distinct values: no task holds them all unless they all differ in one bucket.

    Values are counted, the counts of ranges of values summed, and only the range that holds a rank is looked at.
    """
    from pyspark.sql import Window

    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.repartitionByRange("value").withColumn("part", F.spark_partition_id())
    counts = checkpointed(counts)  # a range's bounds are sampled: they must not be drawn twice
    parts = counts.groupBy("part").agg(F.sum("n").alias("m"))
    parts = parts.select("part", F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("m").over(Window.partitionBy()).alias("total"))
    placed = counts.join(F.broadcast(parts), "part")
    upto = F.col("base") + F.sum("n").over(Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("last", upto - 1).withColumn("first", F.col("last") - F.col("n") + 1)
    rank = lambda q: F.greatest(F.lit(0), F.ceil(F.col("total") * q) - 1) if nearest else F.least(F.col("total") - 1, F.floor(F.col("total") * q))
    wanted = F.array(*[F.struct(F.lit(q).alias("q"), rank(q).alias("r")) for q in qs])
    return placed.withColumn("w", F.explode(wanted)).where((F.col("w.r") >= F.col("first")) & (F.col("w.r") <= F.col("last"))).select(F.col("w.q").alias("q"), "value")


def bootstrap_f1(rows: DataFrame, key: str, tp: str, fp: str, fn: str, resamples: int = 1000, seed: int = 1) -> DataFrame:
    """One row ``(f1, low, high)``: F1 and its 95 % interval over resampled groups ``key``.

    Each group's weight in a resample is a Poisson(1) draw from a hash of seed, resample and group: what a resample with replacement of many
    groups tends to, without a shuffle of the rows for each.
    """
    sums = rows.groupBy(key).agg(*[F.sum(c).alias(c) for c in (tp, fp, fn)])
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("b"), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    cdf, weight, total = 0.36787944117144233, F.lit(0), 0.36787944117144233
    for k in range(1, 8):  # the number of cumulative probabilities that the draw exceeds
        weight = weight + F.when(u >= total, 1).otherwise(0)
        cdf /= k
        total += cdf
    drawn = sums.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("w", weight)
    f1 = lambda a, b, c: ratio(2 * a, 2 * a + b + c)
    each = drawn.groupBy("b").agg(f1(F.sum(F.col(tp) * F.col("w")), F.sum(F.col(fp) * F.col("w")), F.sum(F.col(fn) * F.col("w"))).alias("f"))
    low_high = each.agg(percentile_ceil("f", 0.025).alias("low"), percentile_ceil("f", 0.975).alias("high"))
    return sums.agg(f1(F.sum(tp), F.sum(fp), F.sum(fn)).alias("f1")).join(F.broadcast(low_high))


def adversarial_cells(clean: DataFrame, attacked: DataFrame, key: str, by: list[str], threshold: float = 0.5) -> DataFrame:
    """``(by, n, mean_clean, mean_attacked, flips, review)`` of pairs of a clean and an attacked text with probability ``p``."""
    c = clean.select(F.col(key).alias("_k"), F.col("p").alias("pc"))
    rows = attacked.join(c, F.col(key) == F.col("_k"))
    flip = (F.col("pc") >= threshold) != (F.col("p") >= threshold)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("pc").alias("mean_clean"), F.avg("p").alias("mean_attacked"), F.count_if(flip).alias("flips"), F.count_if((F.col("p") > 0.1) & (F.col("p") < 0.9)).alias("review"))


def capture_scores(predicted: DataFrame, gold: DataFrame, columns: list[str]) -> DataFrame:
    """One row ``(matched, predicted, gold, precision, recall)``: the multiset intersection of captured tuples."""
    p = predicted.groupBy(*columns).agg(F.count(F.lit(1)).alias("np"))
    g = gold.groupBy(*columns).agg(F.count(F.lit(1)).alias("ng"))
    both = p.withColumn("ng", F.lit(0).cast("bigint")).unionByName(g.withColumn("np", F.lit(0).cast("bigint"))).groupBy(*columns).agg(F.sum("np").alias("np"), F.sum("ng").alias("ng"))
    sums = both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in ((F.least("np", "ng"), "matched"), (F.col("np"), "predicted"), (F.col("ng"), "gold"))])
    return sums.withColumns({"precision": ratio(F.col("matched"), F.col("predicted"), 1.0), "recall": ratio(F.col("matched"), F.col("gold"), 1.0)})


def components_by_key(rows: DataFrame, node: str, keys: list[str]) -> DataFrame:
    """``(node, root)`` of the nodes that share all ``keys`` with another, directly or over others.

    Where every node has one key only, as a text's digest, its group is that of the key and needs no search.
    """
    members = checkpointed(rows.dropna(subset=[*keys, node]).select(*keys, F.col(node).alias("node")))
    key = F.xxhash64(*keys)
    if members.groupBy("node").agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a <> b").isEmpty():
        roots = members.groupBy(*keys).agg(F.min("node").alias("root"), F.max("node").alias("_last")).where("root < _last").drop("_last")
        return skew_join(members, roots, keys).select("node", "root").distinct()
    return connected_components(star_edges(members, keys, "node"))


def is_short_palindrome(text: Column) -> Column:
    """Whether a text, letters and digits only and in lower case, is a palindrome of 4 or 5 characters."""
    bare = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")
    return (F.length(bare) >= 4) & (F.length(bare) <= 5) & (bare == F.reverse(bare))


def text_fingerprint(text: Column) -> Column:
    """SHA-256 of a text with its line ends unified."""
    return F.sha2(F.regexp_replace(text, "\r\n", "\n"), 256)


def packing_effect(alone: DataFrame, together: DataFrame, key: str, threshold: float = 0.5) -> DataFrame:
    """One row ``(n, largest_rise, largest_fall, flips)``: how far the probabilities of the same texts move between two runs of a judge, as when each is asked alone or beside others."""
    a, b = alone.select(F.col(key).alias("k"), F.col("p").alias("a")), together.select(F.col(key).alias("k"), F.col("p").alias("b"))
    move = F.col("b") - F.col("a")
    return a.join(b, "k").agg(
        F.count(F.lit(1)).alias("n"), F.greatest(F.max(move), F.lit(0.0)).alias("largest_rise"), F.least(F.min(move), F.lit(0.0)).alias("largest_fall"),
        F.count_if((F.col("a") >= threshold) != (F.col("b") >= threshold)).alias("flips"),
    )


def roll_up(runs: DataFrame, by: list[str], sums: list[str], times: list[str]) -> DataFrame:
    """``(by, n, <sum>_total, <time>_p50, <time>_p95, <time>_max)``: what the runs of each group took together, and their nearest-rank percentiles.

    Values are counted before they are ranked, so a group may have any number of runs; nulls count for nothing.
    """
    out = runs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"{c}_total") for c in sums])
    from pyspark.sql import Window

    for c in times:
        counts = runs.where(F.col(c).isNotNull()).groupBy(*by, c).agg(F.count(F.lit(1)).alias("m"))
        upto = F.sum("m").over(Window.partitionBy(*by).orderBy(c).rowsBetween(Window.unboundedPreceding, 0))
        ranked = counts.withColumn("upto", upto).withColumn("all", F.sum("m").over(Window.partitionBy(*by)))
        rank = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * q), F.col(c)))
        part = ranked.groupBy(*by).agg(rank(0.5).alias(f"{c}_p50"), rank(0.95).alias(f"{c}_p95"), F.max(c).alias(f"{c}_max"))
        on = [F.col(f"l.{b}").eqNullSafe(F.col(f"r.{b}")) for b in by]
        keep = [f"{c}_p50", f"{c}_p95", f"{c}_max"]
        out = out.alias("l").join(part.alias("r"), on, "left").select("l.*", *[F.col(f"r.{k}").alias(k) for k in keep])
    return out


def compare_arms(rows: DataFrame, arms: dict[str, Column], gold: Column) -> DataFrame:
    """``(arm, n, precision, recall, f1)``: several ways to predict the same yes or no, scored over the same rows in one pass. Shares of nothing are 1; F1 of nothing is null."""
    known = rows.where(gold.isNotNull())
    cells = []
    for name, said in arms.items():
        said = F.coalesce(said, F.lit(False))
        tp, fp, fn = F.count_if(said & gold), F.count_if(said & ~gold), F.count_if(~said & gold)
        cells.append(F.struct(F.lit(name).alias("arm"), F.count(F.lit(1)).alias("n"), ratio(tp, tp + fp, 1.0).alias("precision"), ratio(tp, tp + fn, 1.0).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")))
    return known.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def label_faults(labels: DataFrame, records: DataFrame, key: str, fields: dict[str, list[str]] | None = None, *, digest: str | None = None) -> DataFrame:
    """``(key, fault)`` of labels that can't be used: ``unknown`` records, ``repeated`` labels, ``unlabelled`` records, ``stale`` ones (another ``digest`` than the record's) and values that a field of ``fields`` doesn't allow."""
    fault = lambda df, name: df.select(F.col(key).alias("key"), F.lit(name).alias("fault"))
    ids = records.select(key).distinct()
    out = fault(labels.join(ids, key, "left_anti"), "unknown").unionByName(fault(labels.groupBy(key).count().where("count > 1"), "repeated")).unionByName(fault(ids.join(labels.select(key).distinct(), key, "left_anti"), "unlabelled"))
    if digest is not None:
        own = records.select(key, F.col(digest).alias("_d"))
        out = out.unionByName(fault(labels.join(own, key).where(~F.col(digest).eqNullSafe(F.col("_d"))), "stale"))
    for name, allowed in (fields or {}).items():
        out = out.unionByName(fault(labels.where(~F.coalesce(F.col(name).isin(allowed), F.lit(False))), name))
    return out.distinct()


def disagreements(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, first, second)`` where two reviewers differ, a record that one of them left out included."""
    a, b = first.select(F.col(key).alias("key"), F.struct(F.col(value)).alias("a")), second.select(F.col(key).alias("key"), F.struct(F.col(value)).alias("b"))
    both = a.join(b, "key", "full").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("key", F.col(f"a.{value}").alias("first"), F.col(f"b.{value}").alias("second"))
