"""The ordered replay keeps the session's tasks, and missing statistics are nulls."""

import numpy as np
import pandas as pd

from tidewater.operators import quality
from tidewater.streaming.processors import _nulls


def test_replay_keeps_its_tasks(spark):
    rows = [(i, i % 9, i, "din", 50.0 + i % 13 * 9) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id INT, sensor_id INT, observed_at INT, field STRING, value DOUBLE")
    out = quality.replay_outliers(df, ["sensor_id"], ["observed_at", "event_id"])
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == quality.flag_outliers(df, ["sensor_id"], [("observed_at", True), ("event_id", True)]).count()
    assert _nulls(pd.array([1.5, None], dtype="Float64")).tolist() == _nulls(np.array([1.5, np.nan])).tolist() == [1.5, None]
