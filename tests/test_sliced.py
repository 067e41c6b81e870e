"""Positions and predecessors by slices against plain windows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import sliced


def frame_of(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice("pq"), rng.choice([None, *range(60)]), k, f"v{rng.randrange(5)}" if rng.random() < 0.8 else None) for k in range(300)]
    return spark.createDataFrame(rows, "g string, h string, at long, id long, v string")


def test_positions_and_previous_as_of_windows(spark):
    frame = frame_of(spark)
    plain = Window.partitionBy("g", "h").orderBy("at", "id")
    expected = sorted(map(str, frame.withColumns({"n": F.row_number().over(plain).cast("long"), "before": F.lag("v").over(plain)}).collect()))
    for width in (1, 7, 1000):
        slice_of = F.coalesce(F.floor(F.col("at") / width), F.lit(-1))
        found = sliced.with_position(frame, ["g", "h"], slice_of, [F.col("at"), F.col("id")], "n")
        found = sliced.with_previous(found, ["g", "h"], slice_of, ["at", "id"], "v", "before")
        assert sorted(map(str, found.collect())) == expected


def test_empty(spark):
    frame = frame_of(spark).limit(0)
    assert sliced.with_previous(sliced.with_position(frame, ["g"], F.col("at"), [F.col("id")], "n"), ["g"], F.col("at"), ["id"], "v", "b").count() == 0
