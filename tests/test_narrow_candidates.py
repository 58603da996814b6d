"""Candidates are those of the whole gate without its texts; values are rounded in tasks as the column function rounds them."""

import random

import numpy as np
from pyspark.sql import functions as F

from candlewick.functions.numbers import rounded, rounded_array
from candlewick.functions.tickets import Goal
from candlewick.operators.outcomes import decide, entry_candidates
from candlewick.operators.walk import label_steps
from tests.fixtures import KEYS, frame, noise, trend


def test_rounding_in_tasks_equals_the_column_function(spark):
    rng = random.Random(5)
    values = [rng.uniform(-1e4, 1e4) for _ in range(2000)] + [rng.randint(-(10**9), 10**9) / 10**7 for _ in range(2000)]
    values += [rng.randint(1, 10**7) / 100 / rng.randint(1, 50) for _ in range(2000)] + [0.0, -0.0, -1e-9, 2.5e-7, 0.5e-4, 1e12 + 0.5, 1e300, -1e17]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    for digits in (4, 6):
        want = [r[0] for r in df.orderBy("i").select(rounded(F.col("x"), digits)).collect()]
        assert rounded_array(np.array(values), digits).tolist() == want
    assert np.isnan(rounded_array(np.array([np.nan]), 4))[0] and not np.signbit(rounded_array(np.array([-1e-9]), 4))[0]


def test_candidates_equal_the_whole_gate_and_make_no_texts(spark):
    labelled = label_steps(frame(spark, {"A": noise(160, 1), "B": trend(90, 0.01)}), KEYS, 40)
    prices = ("side", "play_class", "entry", "stop", "target")
    for goal in (Goal(mode="paper"), Goal(mode="paper", open_risk_fraction=0.05), Goal(mode="log")):
        whole = decide(labelled, goal).filter("risk.action = 'pending_exec'").select("instrument", "idx", *[f"proposal.{c}" for c in prices])
        got = entry_candidates(labelled, KEYS, goal)
        assert sorted(map(tuple, got.select("instrument", "entry_idx", *prices).collect())) == sorted(map(tuple, whole.collect()))
    plan = entry_candidates(labelled, KEYS)._jdf.queryExecution().optimizedPlan().toString()
    assert "format_string" not in plan and "bround" not in plan.replace("bround(close", "")
