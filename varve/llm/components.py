"""Connected components of a graph given by its edges, without gathering it anywhere.

Every node moves to the least of itself and its neighbours, edges are renamed and
made distinct, and so on until few edges remain; those (``REST`` at most, a checked
bound) one task finishes.  Nodes have to be numbered at random, so that the number of
nodes shrinks by a constant factor a round.  Each round is written to the shared
folder.  The least neighbour is an aggregate, which is combined before the shuffle, and
renaming is a join with a table of unique keys, whose large side Spark splits, so nodes
with very many edges hold up nothing.

Defined results: rows with a null end are no edges; an edge from a node to itself makes no component; repeated and
reversed edges are one; no edges give an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm._shared import stash

#: Edges at most that one task finishes.
REST = 16_000


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node that has an edge in ``edges`` (a, b: longs); nodes of a component share a label."""
    edges = edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both, _ = stash(both, "edges")
    maps = []
    while both.count() > 2 * REST:
        moved, _ = stash(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "moves")
        maps.append(moved)
        to = lambda name: moved.select(F.col("a").alias(name), F.col("to").alias(f"to_{name}"))  # noqa: E731,B023
        renamed = both.join(to("a"), "a").join(to("b"), "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        both, _ = stash(renamed.where("a <> b").distinct(), "edges")

    def finish(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for part in parts:
            for a, b in zip(part["a"].tolist(), part["b"].tolist(), strict=True):
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
        yield pd.DataFrame({"a": list(parent), "to": [root(x) for x in parent]}, dtype="int64")

    rest, _ = stash(both.where("a < b").coalesce(1).mapInPandas(finish, "a long, to long"), "rest")
    maps.append(rest)
    labels = maps[0].select(F.col("a").alias("node"), F.col("to").alias("label"))
    for moved in maps[1:]:
        labels = labels.join(moved.select(F.col("a").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return labels
