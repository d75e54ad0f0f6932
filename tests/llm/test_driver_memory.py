"""No table that grows with the input goes through the driver as a broadcast that Spark chose by its own estimate."""

import pytest
from pyspark.sql import functions as F

from spanloom.llm import simhash_dedup
from spanloom.llm.common import small_side, written


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hot", [1, 512])
def test_signatures_are_not_broadcast(spark, hot):
    """Spark takes a table of one wildcard for as many rows as fingerprints; at 0.6 GB its broadcast ended the driver."""
    fps = [x ^ (1 << b) for x in (0, 1 << 40 | 5) for b in range(20)]
    prints = written(spark.createDataFrame([(x,) for x in fps], "fp long"), "prints")
    found = simhash_dedup.links(prints, hot)
    assert "SortMergeJoin [key" in plan(found)
    assert "BroadcastHashJoin [key" not in plan(found) and "BroadcastHashJoin [mask" not in plan(found)
    want = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}
    assert {(r.a, r.b) for r in found.collect()} == want


def test_near_groups_are_not_broadcast(spark):
    rows = spark.createDataFrame([(i, f"some text of three words {i // 2}") for i in range(20)], "doc_id long, text string")
    found = simhash_dedup.near_groups(rows)
    assert "BroadcastHashJoin" not in plan(found)
    assert found.agg(F.countDistinct("component_id")).first()[0] <= 10


@pytest.mark.parametrize("kind", ["left_anti", "left"])
def test_large_side_is_merged(spark, kind):
    """A written table of over ``max_rows`` rows has small files, by which Spark would broadcast it all the same."""
    rows = spark.range(100).withColumn("n", F.lit(1))
    side = written(rows.withColumnRenamed("id", "other"), "side")
    on = F.col("id").eqNullSafe(F.col("other"))
    assert "BroadcastHashJoin" in plan(rows.select("id").join(small_side(side), on, kind))
    large = rows.select("id").join(small_side(side, max_rows=99), on, kind)
    assert "Broadcast" not in plan(large) and large.count() == (0 if kind == "left_anti" else 100)
