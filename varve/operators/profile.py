"""Call trees of profiler reports: self time, roll-ups, heaviest paths and drill-downs.

Nodes are (thread, idx, cls, method, total), edges (thread, parent, child).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def node_totals(times: Column) -> Column:
    """A node's time over all windows."""
    return F.aggregate(times, F.lit(0.0), lambda acc, x: acc + x)


def edges(nodes: DataFrame) -> DataFrame:
    """(thread, parent, child) of nodes with child numbers in ``refs``; numbers of no node are dropped."""
    out = nodes.select("thread", F.col("idx").alias("parent"), F.explode("refs").alias("child"))
    return out.join(nodes.select("thread", F.col("idx").alias("child")), ["thread", "child"], "left_semi").select("thread", "parent", "child")


def self_time(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes with ``self``: their time less their children's, at least 0."""
    child = nodes.select("thread", F.col("idx").alias("child"), F.col("total").alias("t"))
    inner = links.join(child, ["thread", "child"]).groupBy("thread", F.col("parent").alias("idx")).agg(F.sum("t").alias("inner"))
    own = F.greatest(F.col("total") - F.coalesce("inner", F.lit(0)), F.lit(0))
    return nodes.join(inner, ["thread", "idx"], "left").withColumn("self", own).drop("inner")


def hotspots(timed: DataFrame, top: int, *by: str) -> DataFrame:
    """The ``top`` of each thread by summed self time, with their share of the thread."""
    sums = timed.groupBy("thread", *by).agg(F.sum("self").alias("self"))
    thread = Window.partitionBy("thread")
    ranked = sums.withColumn("rank", F.row_number().over(thread.orderBy(F.desc("self"), *by))).where(F.col("rank") <= top)
    whole = timed.groupBy("thread").agg(F.sum("self").alias("whole"))
    return ranked.join(whole, "thread").withColumn("percent", F.when(F.col("whole") > 0, F.round(100.0 * F.col("self") / F.col("whole"), 4)).otherwise(0.0)).drop("whole")


def first_match(value: Column, rules: list[tuple[str, str, str]], other: str) -> Column:
    """The name of the first rule (name, 'starts' or 'has', text) that holds."""
    out = None
    for name, kind, text in rules:
        test = value.startswith(text) if kind == "starts" else value.contains(text)
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.lit(other) if out is None else out.otherwise(other)


def attributed(timed: DataFrame, sources: DataFrame, known_prefixes: list[str]) -> DataFrame:
    """Nodes with ``mod``: their class's source, else its first three name parts unless it is a known library's."""
    library = F.lit(False)
    for p in known_prefixes:
        library = library | F.col("cls").startswith(p)
    guess = F.when(~library, F.concat_ws(".", F.slice(F.split("cls", r"\."), 1, 3)))
    return timed.join(sources, "cls", "left").withColumn("mod", F.coalesce("mod", guess, F.lit("(library)")))


def as_json(analysis: DataFrame) -> DataFrame:
    """Each row of an analysis as a line of JSON, its columns by name; ``DataFrame.write.text`` dumps it."""
    return analysis.select(F.to_json(F.struct(*sorted(analysis.columns))).alias("line"))


def by_keyword(nodes: DataFrame, keywords: list[str]) -> DataFrame:
    """Inclusive time and nodes for each keyword in a node's name; a node may count for several."""
    name = F.lower(F.concat_ws(".", "cls", "method"))
    hits = nodes.select("total", F.explode(F.filter(F.array(*map(F.lit, keywords)), lambda k: F.instr(name, k) > 0)).alias("keyword"))
    return hits.groupBy("keyword").agg(F.sum("total").alias("total"), F.count("*").alias("nodes"))


def heaviest_child(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Each node's child of the greatest total (the smallest number of equals): (thread, idx, next)."""
    child = nodes.select("thread", F.col("idx").alias("child"), "total")
    best = links.join(child, ["thread", "child"]).groupBy("thread", F.col("parent").alias("idx"))
    return best.agg(F.max_by("child", F.struct("total", -F.col("child"))).alias("next"))


def heaviest_paths(nodes: DataFrame, links: DataFrame, roots: int = 3, depth: int = 24) -> DataFrame:
    """(thread, root, depth, idx, total) along the heaviest child from each thread's heaviest roots.

    A path has one node a level, so at each level a few rows join with the table of heaviest children;
    each level is looked at, and the first without rows is the last.
    """
    inner = links.select("thread", F.col("child").alias("idx"))
    w = Window.partitionBy("thread").orderBy(F.desc("total"), "idx")
    start = nodes.join(inner, ["thread", "idx"], "left_anti").withColumn("r", F.row_number().over(w)).where(F.col("r") <= roots)
    level = start.select("thread", F.col("idx").alias("root"), F.lit(0).alias("depth"), "idx").persist()
    follow, out = heaviest_child(nodes, links).persist(), level
    for k in range(1, depth + 1):
        level = level.join(follow, ["thread", "idx"]).select("thread", "root", F.lit(k).alias("depth"), F.col("next").alias("idx")).persist()
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.join(nodes.select("thread", "idx", "total"), ["thread", "idx"])


def top_children(nodes: DataFrame, links: DataFrame, text: str, top: int = 10) -> DataFrame:
    """The heaviest children of the first node of each thread whose name has ``text``."""
    match = nodes.where(F.instr(F.lower(F.concat_ws(".", "cls", "method")), text.lower()) > 0).groupBy("thread").agg(F.min("idx").alias("parent"))
    child = nodes.select("thread", F.col("idx").alias("child"), "cls", "method", "total")
    w = Window.partitionBy("thread").orderBy(F.desc("total"), "child")
    return links.join(match, ["thread", "parent"]).join(child, ["thread", "child"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
