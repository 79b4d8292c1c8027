"""The driver's tables as the engine's notions: changes, objects, headers, regions, scans and call trees."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.functions import ids, positions
from varve.operators.store import hash_objects

#: Cuts and limits of the registered queries.
ACTIVE_PACK_ROWS, PACK_BYTES, DEAD_SHARE, STORE_LIMIT = 9, 65_536, 0.5, 1_000_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; only on one machine, where none is set, a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="varve-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def changes(spark, sf) -> DataFrame:
    """(dim, pos, ts, seq, hash): events are saves of a user's cell in a dimension by event type."""
    hash_ = F.md5(F.concat_ws("|", F.col("event_id").cast("string"), "props").cast("binary"))
    return read(spark, sf, "events").select(F.col("event_type").alias("dim"), F.col("user_id").alias("pos"), "ts", F.col("event_id").alias("seq"), hash_.alias("hash"))


def stored(spark, sf) -> DataFrame:
    """(doc_id, source, hash, length) of documents as objects."""
    return hash_objects(read(spark, sf, "documents"), "text", "doc_id", "source")


def objects(spark, sf) -> DataFrame:
    """The store: one row a hash, in packs by the smallest doc_id that wrote it."""
    first = stored(spark, sf).groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.max("length").alias("length"))
    return first.withColumn("pack_id", F.expr("doc_id div 32").cast("long"))


def references(spark, sf) -> DataFrame:
    """(snapshot_id, hash, kind): labelled documents are referenced, by the snapshot of their id; toxic ones as files."""
    label = read(spark, sf, "labels").select("doc_id", "toxic")
    snapshot = F.format_string("snap-%02d", F.col("doc_id") % 7)
    kind = F.when(F.col("toxic") == 1, "file").otherwise("chunk")
    return stored(spark, sf).join(label, "doc_id").select(snapshot.alias("snapshot_id"), "hash", kind.alias("kind"))


def headers(spark, sf) -> DataFrame:
    """One header a day of orders, with a baseline on even days and incomplete ones after the third of a month."""
    day = read(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return day.select(
        ids.snapshot_id(F.col("day").cast("timestamp")).alias("snapshot_id"),
        (F.dayofmonth("day") % 2 == 0).alias("baseline_complete"),
        (F.dayofmonth("day") == 3).alias("incomplete"),
        (F.unix_seconds(F.col("day").cast("timestamp")) * 1000).alias("created_ms"),
    )


def pending_restore(spark, sf) -> DataFrame:
    """The flag of a waiting restore: the oldest snapshot."""
    return headers(spark, sf).agg(F.min("snapshot_id").alias("snapshot_id"))


def cells(spark, sf) -> DataFrame:
    """(dim, x, z, length): orders as cells around the origin."""
    x, z = (F.col("o_custkey") - 700).cast("long"), (F.col("o_orderkey") % 4001 - 2000).cast("long")
    return read(spark, sf, "orders").select(F.col("o_orderpriority").alias("dim"), x.alias("x"), z.alias("z"), F.floor(F.col("o_totalprice")).cast("long").alias("length"))


def slots(spark, sf) -> DataFrame:
    """(dim, rx, rz, slot, length): the largest cell of each slot."""
    c = cells(spark, sf)
    r = c.select("dim", positions.region(F.col("x")).alias("rx"), positions.region(F.col("z")).alias("rz"), positions.slot(F.col("x"), F.col("z")).alias("slot"), "length")
    return r.groupBy("dim", "rx", "rz", "slot").agg((F.max("length") * 4).alias("length"))


def scan_log(spark, sf) -> DataFrame:
    """(channel, dim, file, status): order lines' flags as progress of region files; no status where the flag is A."""
    status = F.when(F.col("l_returnflag") == "N", "committed").when(F.col("l_returnflag") == "R", "scanned")
    return read(spark, sf, "lineitem").select(
        F.lit("region").alias("channel"), F.col("l_linestatus").alias("dim"), F.format_string("r.%d.%d.mca", F.col("l_suppkey") % 8, F.col("l_partkey")).alias("file"), status.alias("status")
    )


def call_tree(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges: regions call nations, which call customers; each is a thread of its region.

    Totals are whole balances; a nation's is three quarters of its customers', so that its self time is 0.
    """
    nation = read(spark, sf, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r"), "n_name")
    customer = read(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n"), "c_mktsegment", F.abs(F.round("c_acctbal")).cast("long").alias("t")).join(nation, "n")
    leaf = customer.select(F.col("r").cast("string").alias("thread"), (F.col("c_custkey") + 1000).alias("idx"), F.concat(F.lit("org.shop."), F.lower("c_mktsegment")).alias("cls"), F.lit("pay").alias("method"), F.col("t").alias("total"))
    middle = customer.groupBy("r", "n", "n_name").agg(F.sum("t").alias("t")).select(F.col("r").cast("string").alias("thread"), (F.col("n") + 100).cast("long").alias("idx"), F.concat(F.lit("net.land."), F.lower("n_name")).alias("cls"), F.lit("tick").alias("method"), F.expr("t * 3 div 4").alias("total"))
    root = customer.groupBy("r").agg(F.sum("t").alias("t")).select(F.col("r").cast("string").alias("thread"), F.col("r").cast("long").alias("idx"), F.lit("java.lang.Thread").alias("cls"), F.lit("run").alias("method"), (F.col("t") * 2).alias("total"))
    links = customer.select(F.col("r").cast("string").alias("thread"), (F.col("n") + 100).cast("long").alias("parent"), (F.col("c_custkey") + 1000).alias("child")).union(
        nation.select(F.col("r").cast("string").alias("thread"), F.col("r").cast("long").alias("parent"), (F.col("n") + 100).cast("long").alias("child"))
    )
    # A tree is read many times over by what walks it, so it is written once; where it comes from a table, nothing needs keeping.
    path = shared_path(spark, "tree")
    root.union(middle).union(leaf).write.parquet(f"{path}/nodes")
    nodes = spark.read.parquet(f"{path}/nodes")
    links.join(nodes.select("thread", F.col("idx").alias("child")), ["thread", "child"], "left_semi").select("thread", "parent", "child").write.parquet(f"{path}/links")
    return nodes, spark.read.parquet(f"{path}/links")
