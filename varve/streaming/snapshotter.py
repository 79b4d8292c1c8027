"""A stream of changes to snapshots, one a micro-batch; and the two flow-control folds.

A batch has changes of cells (channels ``chunk`` and ``entity``: dim, pos) and of saved data (``savedData``:
path).  A snapshot is made in this order: the latest header is read, and if it cannot be, or is
of an unknown version, nothing is drained or written; changes are collapsed to the last writer of each key;
files and the level file are read anew (``files`` replace those of the snapshot before as a whole); new
objects are stored; then entries, then the header are written, and then the ``after`` steps run
(promotion, pruning, verification, collection).  The header is the last thing written, so a
snapshot that readers see is whole; a failed batch is run again from the checkpoint and replaces
what it had written.  Triggers: ``availableNow`` for manual runs, ``processingTime`` for scheduled ones.

New objects are found by an anti-join of the batch's hashes with the store's, which lies in folders by the first
``PREFIX`` digits of the hash; only the folders of hashes that the batch has are read.  Few and large batches want
one digit, many and small ones more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from varve.operators.snapshot import last_writer
from varve.operators.store import new_objects

VERSION = 1
KEY = ["channel", "dim", "pos", "path"]
PREFIX = 1


class CorruptBaseline(Exception):
    """The latest header cannot be trusted, so no snapshot may be built on it."""


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def latest_header(spark: SparkSession, path: str, before: int) -> Row | None:
    """The header of the last snapshot before a batch, None for the first; an error if it cannot be read or is of another version."""
    headers = _read(spark, f"{path}/headers")
    if headers is None:
        return None
    number = headers.where(F.col("batch") < before).agg(F.max("batch").alias("n")).first().n
    if number is None:
        return None
    try:
        found = spark.read.parquet(f"{path}/headers/batch={number}").first()
    except Exception as e:
        raise CorruptBaseline(f"the header of snapshot {number} cannot be read") from e
    if found is None or found.asDict().get("version") != VERSION:
        raise CorruptBaseline(f"the header of snapshot {number} is none of version {VERSION}")
    return found


def _complete(changes: DataFrame) -> DataFrame:
    """Changes with a channel (chunk, if they have none) and a path."""
    for name, value in (("channel", F.lit("chunk")), ("path", F.lit(None).cast("string"))):
        if name not in changes.columns:
            changes = changes.withColumn(name, value)
    return changes.select(*KEY, "seq", "hash", "length")


def _as_entries(files: DataFrame, channel: str, path, suspect) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    return files.select(F.lit(channel).alias("channel"), none("string").alias("dim"), none("long").alias("pos"), path.alias("path"), "hash", suspect.alias("suspect"))


def create(
    changes: DataFrame,
    path: str,
    number: int,
    files: Callable[[], DataFrame] | None = None,
    level: Callable[[], DataFrame] | None = None,
    after: tuple[Callable[[SparkSession, str, int], None], ...] = (),
) -> None:
    """Make snapshot ``number`` of changes; ``files`` gives (path, hash, length, suspect), ``level`` one row (hash, length) or none."""
    spark = changes.sparkSession
    latest_header(spark, path, number)
    batch = _complete(changes)
    cells, incoming = last_writer(batch, F.col("seq"), *KEY).withColumn("suspect", F.lit(False)), batch.select("hash", "length")
    for read, channel, name, suspect in ((files, "files", F.col("path"), F.col("suspect")), (level, "levelDat", F.lit("level.dat"), F.lit(False))):
        if read is not None:
            found = read()
            cells, incoming = cells.unionByName(_as_entries(found, channel, name, suspect)), incoming.unionByName(found.select("hash", "length"))
    incoming = incoming.withColumn("prefix", F.concat(F.lit("h"), F.substring("hash", 1, PREFIX)))
    objects, store = incoming.dropDuplicates(["hash"]), _read(spark, f"{path}/objects")
    if store is not None:
        # The batch's own part is left out, so that a batch that is run again finds what it first found.
        prefixes = [r.prefix for r in incoming.select("prefix").distinct().collect()]  # 16 ** PREFIX at most
        objects = new_objects(incoming, store.where(F.col("prefix").isin(prefixes) & (F.col("batch") < number)))
    objects.repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{path}/objects/batch={number}")
    cells.write.mode("overwrite").parquet(f"{path}/entries/batch={number}")
    stored = _read(spark, f"{path}/objects/batch={number}")
    delta = 0 if stored is None else stored.agg(F.sum("length")).first()[0] or 0
    n = lambda *names: F.count_if(F.col("channel").isin(*names))
    header = spark.read.parquet(f"{path}/entries/batch={number}").agg(
        F.lit(VERSION).alias("version"), n("chunk", "entity", "savedData").alias("n_entries"), n("files").alias("n_files"), F.count_if("suspect").alias("n_suspect"),
        F.count_distinct("hash").alias("n_hashes"), F.lit(delta).cast("long").alias("delta_bytes"), F.lit(files is not None).alias("read_files"),
    )
    header.write.mode("overwrite").parquet(f"{path}/headers/batch={number}")
    for step in after:
        step(spark, path, number)


def start(changes: DataFrame, path: str, checkpoint: str, interval: str | None = None, **parts) -> StreamingQuery:
    """Start writing snapshots of a streaming DataFrame (dim, pos, seq, hash, length; and channel, path) below ``path``; ``parts`` as for ``create``."""
    writer = changes.writeStream.foreachBatch(lambda batch, number: create(batch, path, number, **parts)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def read_changes(spark: SparkSession, path: str, schema, files_a_batch: int | None = None, bytes_a_batch: str | None = None) -> DataFrame:
    """A stream of changes out of files, so many a batch at most: a source that is ahead waits, and nothing is dropped."""
    if files_a_batch and bytes_a_batch:
        raise ValueError("a batch is bounded by files or by bytes")
    reader = spark.readStream.schema(schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    if bytes_a_batch:
        reader = reader.option("maxBytesPerTrigger", bytes_a_batch)
    return reader.parquet(path)


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """The entries of snapshots that have a header."""
    done = spark.read.parquet(f"{path}/headers").select("batch")
    return spark.read.parquet(f"{path}/entries").join(done, "batch", "left_semi")


def entries(spark: SparkSession, path: str) -> DataFrame:
    """All entries of the latest snapshot: cells, saved data and the level file from whichever snapshot wrote them last, files of the last that read them."""
    held, listed = _whole(spark, path), F.col("channel") == "files"
    newest = held.where(~listed).groupBy(*KEY).agg(F.max_by(F.struct("hash", "suspect"), "batch").alias("last")).select(*KEY, "last.hash", "last.suspect")
    last = spark.read.parquet(f"{path}/headers").where("read_files").agg(F.max("batch").alias("batch"))
    return newest.unionByName(held.where(listed & (F.col("batch") == last.scalar())).select(*KEY, "hash", "suspect"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The newest entry (dim, pos, hash) of each cell of the chunk channel over all snapshots that have a header."""
    cells = _whole(spark, path).where(F.col("channel") == "chunk")
    return cells.groupBy("dim", "pos").agg(F.max_by("hash", "batch").alias("hash"))


#: Rows that one task folds at most, where the numbers of a channel lie evenly.
BLOCK_ROWS = 1_000_000


class _Gate:
    """Shut (1) or open (0); what a run of levels does is the state it ends in from either."""

    start, identity, values = 0, (0, 1), ["level", "high"]

    @staticmethod
    def run(state: int, level: list[int], high: list[int]) -> tuple[int, list]:
        out = []
        for x, limit in zip(level, high, strict=True):
            state = int(x > limit // 2 if state else x >= limit)
            out.append(bool(state))
        return state, out

    @classmethod
    def summarize(cls, summary: tuple[int, int], *values: list) -> tuple[int, int]:
        return cls.run(summary[0], *values)[0], cls.run(summary[1], *values)[0]

    @staticmethod
    def chain(state: int, summary: tuple[int, int]) -> int:
        return summary[state]


class _Spacing:
    """When the next call may go; what a run of calls does to it is to add a sum and then raise it to a bound."""

    start, identity, values = -(1 << 61), (-(1 << 61), 0), ["now_ns", "rate"]

    @staticmethod
    def run(state: int, now_ns: list[int], rate: list[int]) -> tuple[int, list]:
        out = []
        for now, r in zip(now_ns, rate, strict=True):
            go = max(now, state)
            state = go + 1_000_000_000 // r
            out.append(go)
        return state, out

    @classmethod
    def summarize(cls, summary: tuple[int, int], now_ns: list[int], rate: list[int]) -> tuple[int, int]:
        return cls.run(summary[0], now_ns, rate)[0], summary[1] + sum(1_000_000_000 // r for r in rate)

    @staticmethod
    def chain(state: int, summary: tuple[int, int]) -> int:
        return max(summary[0], state + summary[1])


def _runs(batch: pd.DataFrame, group: str) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """The rows of each group and block, in order; a null group is one like others."""
    for (g, block), some in batch.groupby([group, "block"], sort=False, dropna=False):
        yield (None if pd.isna(g) else g, block), some


def _fold(rows: DataFrame, group: str, kind, result: str, result_type: str, keep: list[str], block_rows: int) -> DataFrame:
    """A fold over the rows of each group in the order of ``seq``.

    A group's numbers are cut into blocks of even width.  Each block is summed up by itself, the summaries, a few numbers a block, are
    chained in order, and each block is folded from the state that the ones before it leave; so no group has to pass
    through one task.  Up to ``block_rows`` rows there is but one block and nothing to chain.
    """
    first, last, n = rows.agg(F.min("seq"), F.max("seq"), F.count("*")).first()
    width = max(1, (last - first + 1) * block_rows // n) if n > block_rows and last is not None else 1 << 62
    rows = rows.withColumn("block", F.coalesce(F.floor((F.col("seq") - F.lit(first or 0)) / F.lit(width)), F.lit(-1)).cast("long"))
    order = [group, "block", "seq"]
    if n > block_rows:

        def sum_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, summary = None, kind.identity
            for b in batches:
                done = []
                for key, some in _runs(b, group):
                    if key != at:
                        if at is not None:
                            done.append((*at, *summary))
                        at, summary = key, kind.identity
                    summary = kind.summarize(summary, *(some[c].tolist() for c in kind.values))
                yield pd.DataFrame(done, columns=[group, "block", "p", "q"])
            if at is not None:
                yield pd.DataFrame([(*at, *summary)], columns=[group, "block", "p", "q"])

        def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, state = None, kind.start
            for b in batches:
                starts = []
                for g, p, q in zip(b[group], b["p"].tolist(), b["q"].tolist(), strict=True):
                    if g != at:
                        at, state = g, kind.start
                    starts.append(state)
                    state = kind.chain(state, (p, q))
                yield pd.DataFrame({group: b[group], "block": b["block"], "start": pd.Series(starts, dtype="int64")})

        sums = rows.repartition(group, "block").sortWithinPartitions(*order).mapInPandas(sum_up, f"{group} string, block long, p long, q long")
        starts = sums.repartition(group).sortWithinPartitions(group, "block").mapInPandas(chain, f"{group} string, block long, start long")
        other = starts.select(F.col(group).alias("start_group"), F.col("block").alias("start_block"), "start")
        rows = rows.join(other, rows[group].eqNullSafe(other["start_group"]) & (rows["block"] == other["start_block"])).drop("start_group", "start_block")
    else:
        rows = rows.withColumn("start", F.lit(kind.start).cast("long"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, kind.start
        for b in batches:
            out: list = []
            for key, some in _runs(b, group):
                if key != at:
                    at, state = key, int(some["start"].iloc[0])
                state, more = kind.run(state, *(some[c].tolist() for c in kind.values))
                out += more
            yield b[keep].assign(**{result: out})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keep), f"{result} {result_type}"])
    return rows.repartition(group, "block").sortWithinPartitions(*order).mapInPandas(fold, schema)


def gate(levels: DataFrame, group: str = "channel", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The gate at each level (group, seq, level, high): shut at ``high`` and above, open again at half of it and below."""
    rows = levels.select(F.col(group).cast("string").alias(group), *[F.col(c).cast("long").alias(c) for c in ("seq", "level", "high")])
    return _fold(rows, group, _Gate, "shut", "boolean", [group, "seq", "level"], block_rows)


def spacing(calls: DataFrame, group: str = "channel", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """When each call (group, seq, now_ns, rate) may go: 1e9 / rate after the one before, without credit for idle time."""
    rows = calls.select(F.col(group).cast("string").alias(group), *[F.col(c).cast("long").alias(c) for c in ("seq", "now_ns", "rate")])
    return _fold(rows, group, _Spacing, "go_ns", "long", [group, "seq"], block_rows)
