"""Reading inputs and keeping intermediate tables where every executor sees them."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of an input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application inside ``spark.checkpoint.dir``.

    That setting names the storage which all executors share.  Only where it
    is unset on one machine (tests) is it set here, to a new local folder; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="varve-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/varve-{spark.sparkContext.applicationId}"


_written: dict[str, SparkSession] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder; removed when Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def stash(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it again.

    The written table cuts the lineage: what is built on it survives the loss
    of any executor without running the stages before it again.
    """
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[str], None]]:
    """Delete at the end what was written inside, but for the paths that the function it gives was called with."""
    before, kept = set(_written), set()
    yield kept.add
    discard(spark, *(set(_written) - before - kept))


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that no later read needs."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        _written.pop(path, None)


@atexit.register
def _tidy() -> None:
    for path, spark in list(_written.items()):
        try:
            discard(spark, path)
        except Exception:  # the JVM has ended; a shared folder keeps what it cannot reach
            return
