"""Versioned tables: whole versions, untouched folders, refused writers."""

import pytest
from pyspark.sql import functions as F

from priorframe.sources import tables as T

SCHEMA = "k long, season long, v double"


@pytest.fixture
def held(spark):
    df = spark.createDataFrame([(1, 1999, 1.0), (2, 1999, 2.0), (1, 2000, 3.0), (5, None, 9.0)], SCHEMA)
    table = T.VersionedTable(spark, T.Workspace(spark, "vt").path, df.schema, "season")
    assert table.version() == 0 and table.read().count() == 0
    table.append(df)
    return table


def rows(df):
    return sorted((r.k, r.season or 0, r.v) for r in df.collect())


def test_upsert_touches_its_seasons_only(spark, held):
    before = held.folders()
    new = spark.createDataFrame([(2, 1999, 20.0), (7, 2001, 7.0)], SCHEMA)
    assert held.change(new, lambda old, new: T.upsert(old, new, ["k", "season"])) == 2
    after = held.folders()
    assert after["2000"] == before["2000"] and after["__none"] == before["__none"] and after["1999"] != before["1999"]
    assert rows(held.read()) == [(1, 1999, 1.0), (1, 2000, 3.0), (2, 1999, 20.0), (5, 0, 9.0), (7, 2001, 7.0)]
    assert rows(held.read(1)) == [(1, 1999, 1.0), (1, 2000, 3.0), (2, 1999, 2.0), (5, 0, 9.0)]
    assert rows(held.read(values=["2001"])) == [(7, 2001, 7.0)]


def test_a_reader_during_a_commit_sees_the_version_before(spark, held):
    """What is written before the version file is not visible, and a reader that began keeps its files."""
    began = held.read()
    new = spark.createDataFrame([(1, 1999, -1.0)], SCHEMA)
    held._write(new)  # folders of a commit that never ends
    assert rows(held.read()) == rows(began) and held.version() == 1
    held.change(new, lambda old, new: T.upsert(old, new, ["k", "season"]))
    assert (1, 1999, 1.0) in rows(began) and (1, 1999, -1.0) in rows(held.read())


def test_one_of_two_writers_is_refused(spark, held):
    base = held.version()
    new = spark.createDataFrame([(9, 1999, 1.0)], SCHEMA)
    held.append(new, base)
    with pytest.raises(RuntimeError):
        held.append(new, base)
    assert held.version() == base + 1 and held.read().where("k = 9").count() == 1
    with pytest.raises(ValueError):
        held.replace(["2000"], new)


def test_promotion_moves_all_rows(spark):
    df = spark.createDataFrame([(k, "pending" if k % 3 else "approved") for k in range(30)] + [(99, "a/b =c")], "k long, run string")
    held = T.VersionedTable(spark, T.Workspace(spark, "runs").path, df.schema, "run")
    held.append(df)
    T.promote_run(held, "run", "pending", "approved")
    assert {r.run: r.n for r in held.read().groupBy("run").agg(F.count("*").alias("n")).collect()} == {"approved": 30, "a/b =c": 1}
    assert held.read(1).where("run = 'pending'").count() == 20
