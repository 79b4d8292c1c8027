"""Every registered query of the engine against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from varve.plans import records  # noqa: F401  (adds its queries)
from varve.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(map(repr, frame[names].astype(object).where(frame[names].notna(), None).values.tolist()))


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, tables, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(tables.execute(ORACLES[name]).fetchdf())


def test_every_cell_is_packed_and_unpacked(spark, tables):
    from varve.functions import positions
    from varve.plans import tables as t

    begin = ORACLES["position_pack_unpack"].partition("SELECT dim, x, z, (x & ")[0]
    high = "CAST((CAST(z & 4294967295 AS HUGEINT) * 4294967296 - CASE WHEN z < 0 THEN 18446744073709551616 ELSE 0 END) AS BIGINT)"
    want = tables.execute(f"{begin} SELECT dim, x, z, (x & 4294967295) | {high} AS pos, x AS x2, z AS z2 FROM (SELECT DISTINCT dim, x, z FROM cells)").fetchdf()
    c = t.cells(spark, SF).select("dim", "x", "z").distinct().withColumn("pos", positions.pack(F.col("x"), F.col("z")))
    got = c.withColumn("x2", positions.unpack_x(F.col("pos"))).withColumn("z2", positions.unpack_z(F.col("pos"))).toPandas()
    assert (want.z < 0).any() and rows(got) == rows(want)


def test_entry_runs_without_the_training_data_operators():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
