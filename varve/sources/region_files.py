"""Region files and other files of a world as DataFrames.

The listing and the bytes come through Spark's own ``binaryFile`` reader, so any storage
works; each file is a task's row and is parsed where it is read.  A single region is picked by its
file name before any file is opened; filters on dim, rx, rz act on paths, before contents are parsed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.sources.codecs import read_region

NAME = r"r\.(-?\d+)\.(-?\d+)\.mca$"
SCHEMA = "dim string, channel string, rx int, rz int, slot int, x long, z long, payload binary, status string, modified timestamp"


def folder_of(path: Column) -> tuple[Column, Column]:
    """The dimension and the channel of a file by the folder it lies in."""
    folder = F.regexp_extract(path, r"(?:^|/)(?:(DIM-?1)|dimensions/([^/]+)/(.+))/(?:region|entities)/[^/]+$", 1)
    space, name = (F.regexp_extract(path, r"/dimensions/([^/]+)/(.+)/(?:region|entities)/[^/]+$", k) for k in (1, 2))
    dim = F.when(space != "", F.concat_ws(":", space, name)).when(folder == "DIM-1", "minecraft:the_nether").when(folder == "DIM1", "minecraft:the_end").otherwise("minecraft:overworld")
    return dim, F.regexp_extract(path, r"/(region|entities)/[^/]+$", 1)


def list_regions(spark: SparkSession, world: str, modified_after: str | None = None, glob: str = "r.*.mca") -> DataFrame:
    """(path, dim, channel, rx, rz, modified) of the region files below a world; a name that is none is an error.

    Rows come in no order; ``by_name`` sorts them.  ``glob`` narrows the names before any file is opened.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    files = reader.load(world)
    path = F.col("path")
    dim, channel = folder_of(path)
    part = lambda k: F.regexp_extract(path, NAME, k)
    number = lambda k: F.when(part(k) != "", part(k).try_cast("int")).otherwise(F.raise_error(F.concat(F.lit("not a region file: "), path)))
    return files.select("path", dim.alias("dim"), channel.alias("channel"), number(1).alias("rx"), number(2).alias("rz"), F.col("modificationTime").alias("modified"), "content")


def read_slots(regions: DataFrame, validate: bool = True) -> DataFrame:
    """The used slots of listed region files, as rows of SCHEMA."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for f in batch.itertuples(index=False):
                rows = [
                    (f.dim, f.channel, f.rx, f.rz, slot, f.rx * 32 + slot % 32, f.rz * 32 + slot // 32, payload, status, f.modified)
                    for slot, payload, status in read_region(bytes(f.content), validate)
                ]
                if rows:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return regions.select("dim", "channel", "rx", "rz", "modified", "content").mapInPandas(parse, SCHEMA)


def read_cell(spark: SparkSession, world: str, dim: str, x: int, z: int) -> DataFrame:
    """One cell's slot; no rows if its region or slot is not there."""
    regions = list_regions(spark, world, glob=f"r.{x >> 5}.{z >> 5}.mca").where(F.col("dim") == dim)
    return read_slots(regions).where((F.col("x") == x) & (F.col("z") == z))


def with_external(slots: DataFrame, spark: SparkSession, world: str) -> DataFrame:
    """Slots with external payloads made whole: the stub's type byte and the bytes of the file that is named by the cell.

    The file lies in the folder of the region, so dimension and channel have to agree too.  Missing files are marked.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "c.*.mcc").option("recursiveFileLookup", "true").load(world)
    part = lambda k: F.regexp_extract("path", r"c\.(-?\d+)\.(-?\d+)\.mcc$", k).cast("long")
    dim, channel = folder_of(F.col("path"))
    outside = files.select(dim.alias("dim"), channel.alias("channel"), part(1).alias("x"), part(2).alias("z"), F.col("content").alias("outside"))
    stub = F.col("status") == "external"
    joined = slots.join(outside, ["dim", "channel", "x", "z"], "left")
    status = F.when(stub & F.col("outside").isNull(), "torn: external file is missing").otherwise(F.col("status"))
    whole = F.when(stub, F.concat(F.substring("payload", 1, 1), "outside")).otherwise(F.col("payload"))
    return joined.withColumn("payload", whole).withColumn("status", status).drop("outside")


def by_name(files: DataFrame) -> DataFrame:
    """Files in the order of their names."""
    return files.orderBy(F.element_at(F.split("path", "/"), -1), "path")


def dimensions(regions: DataFrame) -> DataFrame:
    """The dimensions that have region files, in order: the three known ones, then others by name."""
    known = ["minecraft:overworld", "minecraft:the_nether", "minecraft:the_end"]
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, known)), F.col("dim")), F.lit(0)), F.lit(len(known) + 1))
    return regions.select("dim").distinct().select("dim", rank.alias("rank")).orderBy("rank", "dim")


def whole_files(spark: SparkSession, world: str, folders: list[str]) -> DataFrame:
    """(path, hash, length) of all files below some folders of a world; folders that are not there give none, and neither do empty files, which Spark does not list."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(world)
    relative = F.substring_index("path", world.rstrip("/").split("/")[-1] + "/", -1)
    inside = F.substring_index(relative, "/", 1).isin(folders)
    return files.where(inside).select(relative.alias("path"), F.sha2("content", 256).alias("hash"), "length")


def level_file(spark: SparkSession, world: str, name: str = "level.dat") -> DataFrame:
    """(path, hash, length, content) of a world's level file; no rows if it is not there."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", "false").load(world)
    return files.select(F.lit(name).alias("path"), F.sha2("content", 256).alias("hash"), "length", "content")


def collect_stable(read: Callable[[], DataFrame], retries: int = 3) -> DataFrame:
    """Files of repeated reads, (path, hash, suspect): a file is read until two reads in a row agree, ``retries`` times at most; what still changes is suspect.

    ``read`` gives (path, hash) anew; only hashes are compared.
    """
    last = read().select("path", "hash", F.lit(True).alias("suspect"))
    for _ in range(retries):
        again = read().select("path", F.col("hash").alias("again"))
        both = last.join(again, "path", "left")
        steady = ~F.col("suspect") | F.col("hash").eqNullSafe(F.col("again"))
        last = both.select("path", F.when(steady, F.col("hash")).otherwise(F.coalesce("again", "hash")).alias("hash"), (~steady).alias("suspect"))
    return last


def suspects(first: DataFrame, second: DataFrame) -> DataFrame:
    """Files of two reads, marked if they changed in between."""
    again = second.select("path", F.col("hash").alias("again"))
    return first.join(again, "path", "left").select("path", "hash", (~F.col("hash").eqNullSafe(F.col("again"))).alias("suspect"))
