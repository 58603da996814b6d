"""Filters on keys reach the scan; filters on long derived columns are not copied into it."""

import pytest
from pyspark.sql import functions as F

from candlewick.functions.tickets import Goal
from candlewick.operators.indicators import walk_snapshots
from candlewick.operators.outcomes import decide
from candlewick.operators.regime import classify
from tests.fixtures import KEYS, frame, noise


@pytest.fixture
def snapshots(spark, tmp_path):
    walk_snapshots(frame(spark, {"A": noise(60, 1), "B": noise(50, 2)}), KEYS, 40).write.parquet(str(tmp_path / "snapshots"))
    return spark.read.parquet(str(tmp_path / "snapshots"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_key_filters_pass_the_checklist_and_the_gate(snapshots):
    for made, column, value in ((classify(snapshots), "regime", "trend"), (decide(classify(snapshots), Goal(mode="paper")), "risk.action", "wait")):
        found = made.filter((F.col("instrument") == "A") & (F.col(column) == value))
        text = plan(found)
        scan = next(line for line in text.splitlines() if "FileScan" in line)
        assert "EqualTo(instrument,A)" in scan
        assert found.count() == made.filter(F.col(column) == value).filter(F.col("instrument") == "A").count()
        assert "partition_id" not in text
    once = plan(classify(snapshots).filter(F.col("regime") == "trend").select("idx", "regime"))
    filters = [line for line in once.splitlines() if "Filter (" in line]
    assert not any("CASE WHEN" in line for line in filters)
