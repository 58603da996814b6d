"""Lines and bars travel once each, and shuffle files go with the frame they made."""

import os
import time

from pyspark.sql import functions as F

from candlewick.operators.exits import first_touches
from candlewick.operators.series import index_rows
from candlewick.plans.catalog.inputs import daily
from candlewick.session import stored_once
from candlewick.sources.candles import bars_from_ticks
from tests.fixtures import KEYS, frame, noise

SMOKE_DIR = "/root/testdata/sf0.001"


def _plan(df) -> list[str]:
    """Lines of the initial plan."""
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def _shuffle_files(spark) -> set[str]:
    folders = spark._jsc.sc().env().blockManager().diskBlockManager().localDirs()
    return {name for top in folders for _, _, names in os.walk(top.getPath()) for name in names if name.startswith("shuffle_")}


def test_lines_are_dealt_once_to_become_numbered_bars(spark):
    """No exchange by bar time and no cached copy; ranks and offsets use the exchange that deals the lines."""
    bars = daily(spark, SMOKE_DIR).select(*KEYS, "idx", "ts", "high", "low", "close")
    plan = _plan(bars)
    assert sum("Exchange hashpartitioning(instrument" in line and "REPARTITION_BY_NUM" in line for line in plan) == 1
    assert not any("InMemoryRelation" in line and "high" in line for line in plan)
    assert sum("FileScan" in line and "l_extendedprice" in line for line in plan) == 1


def test_dealt_ticks_make_the_same_bars_and_numbers(spark):
    ticks = spark.sql("select 'S' || id % 3 as s, timestamp_seconds(id * 7919 % 4000000) as t, double(id * 31 % 101) as p, id from range(900)")
    ticks = ticks.unionByName(spark.sql("select 'S0' as s, cast(null as timestamp) as t, 5.0d as p, 900L as id"))
    made = [bars_from_ticks(ticks, F.col("s"), "D", F.col("t"), F.col("p"), F.col("id"), seconds) for seconds in (None, 10 * 86400)]
    plain = index_rows(made[0].persist(), KEYS, bucket_seconds=10 * 86400)
    times = made[0].select(*KEYS, "ts")
    got = index_rows(made[1], KEYS, bucket_seconds=10 * 86400, times=times)
    assert got.columns == plain.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect())) and got.count() > 100


def test_bars_meet_their_candidates_without_a_join(spark):
    bars = frame(spark, {"a": noise(300), "b": noise(40, seed=2)}).persist()
    cands = bars.select(*KEYS, F.col("idx").alias("_entry"), (F.col("close") * 0.999).alias("_floor"), (F.col("close") * 1.001).alias("_ceiling"))
    assert not any("Join" in line for line in _plan(first_touches(cands, bars, KEYS)))


def test_shuffles_of_a_stored_frame_are_freed(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = _shuffle_files(spark), spark.conf.get(name)
    made = stored_once(spark.range(1000).repartition(4, "id"), "freed")
    for _ in range(100):  # files are removed in the background
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(name) == setting and made.count() == 1000
