"""Connected components by many concurrent breadth-first searches and contraction of the label graph."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spansense.runtime import checkpointed, skew_join

#: Edges of a label graph that one task solves: two columns of labels of some 20 bytes, 20 MB in all.
SMALL_GRAPH = 500_000


def star_edges(members: DataFrame, keys: list[str], node: str) -> DataFrame:
    """Edges ``(src, dst)`` that connect all nodes sharing a key, without listing pairs.

    ``members`` holds one row per (key, node), repeats allowed; rows with a null node are ignored. It is evaluated once and written to the checkpoint
    folder. A key's smallest and largest node come from one aggregation that combines on the map side, whatever the key's share of the rows; every
    node of a key where they differ is tied to its smallest. Keys with very many rows are looked up without moving their rows.
    """
    rows = checkpointed(members.where(F.col(node).isNotNull()).select(*keys, F.col(node).alias("_n")))
    ends = rows.groupBy(*keys).agg(F.min("_n").alias("_root"), F.max("_n").alias("_last")).where("_root < _last").drop("_last")
    ties = skew_join(rows, ends, keys, how="inner")
    return ties.where("_n <> _root").select(F.col("_n").alias("src"), F.col("_root").alias("dst")).distinct()


def _union(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The label that comes first, by string or number order, of each label's component in a graph that one task holds."""
    parent: dict = {}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for pdf in batches:
        for a, b in zip(pdf["src"].tolist(), pdf["dst"].tolist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if parent:
        yield pd.DataFrame({"label": list(parent), "nxt": [root(x) for x in parent]})


def connected_components(edges: DataFrame, *, hops: int = 2, max_levels: int = 60, small_graph: int = SMALL_GRAPH) -> DataFrame:
    """``(node, root)`` for every node of ``edges (src, dst)``; ``root`` is the smallest node of its component.

    Each level hash-partitions the adjacency, takes as seeds all nodes that come first in their neighbourhood by a fixed hash order,
    expands all seeds at once for ``hops`` frontier steps (a node reached by several seeds keeps the first), and turns every edge between two labels
    into an edge of a smaller graph of labels. A label graph of up to ``small_graph`` edges is merged in one task, a larger one by the next level. Nodes that no
    frontier reached stay their own label. Every level at least merges each seed's neighbours, so the number of levels grows with the logarithm of the
    component size. Nothing is collected; each level's graph is written to the checkpoint folder, and nodes with very many edges and labels of very many nodes are
    looked up without moving their rows. Null ends and loops are ignored; no edges give no rows.
    """
    e = edges.where("src is not null and dst is not null and src <> dst").select("src", "dst")
    e = checkpointed(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    found: DataFrame | None = None
    for level in range(max_levels):
        left = e.count()
        if not left:
            break
        if level and left <= small_graph:
            kind = e.schema["src"].dataType.simpleString()
            merged = e.where("src < dst").repartition(1).mapInPandas(_union, f"label {kind}, nxt {kind}")
            found = _relabel(found, merged)  # type: ignore[arg-type]
            break
        order = F.struct(F.xxhash64("dst").alias("h"), F.col("dst").alias("n"))
        near = e.groupBy("src").agg(F.min(order).alias("m"))
        own = F.struct(F.xxhash64("src").alias("h"), F.col("src").alias("n"))
        labels = near.select(F.col("src").alias("node"), F.when(own < F.col("m"), own).alias("label"))
        for _ in range(hops):
            frontier = labels.where("label is not null").select(F.col("node").alias("dst"), F.col("label").alias("reached"))
            reached = skew_join(e, frontier, ["dst"], how="inner", rows=left).groupBy(F.col("src").alias("node")).agg(F.min("reached").alias("reached"))
            labels = labels.join(reached, "node", "left").select("node", F.coalesce("label", "reached").alias("label"))
        labels = checkpointed(labels.select("node", F.coalesce(F.col("label.n"), F.col("node")).alias("label")))
        found = labels if found is None else _relabel(found, labels.select(F.col("node").alias("label"), F.col("label").alias("nxt")))
        a = labels.select(F.col("node").alias("src"), F.col("label").alias("a"))
        b = labels.select(F.col("node").alias("dst"), F.col("label").alias("b"))
        both = skew_join(skew_join(e, a, ["src"], how="inner", rows=left), b, ["dst"], how="inner", rows=left)
        e = checkpointed(both.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
    else:
        raise RuntimeError(f"components did not settle within {max_levels} levels")
    if found is None:
        return e.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    smallest = found.groupBy("label").agg(F.min("node").alias("root"))
    return skew_join(found, smallest, ["label"], how="inner").select("node", "root")


def _relabel(found: DataFrame, labels: DataFrame) -> DataFrame:
    """``found (node, label)`` with each label replaced by its ``nxt`` where it has one."""
    return checkpointed(skew_join(found, labels, ["label"], how="left").select("node", F.coalesce("nxt", "label").alias("label")))
