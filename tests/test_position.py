import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import plan_of, rows_of
from tidegauge.operators.position import after, before, with_nearest, with_neighbours, with_position


@pytest.fixture(scope="module")
def placed(walk):
    return with_position(walk, total="n_rows").cache()


def test_position_equals_row_number(walk, placed):
    in_time = Window.partitionBy("protocol").orderBy("window_start")
    naive = walk.withColumn("t", F.row_number().over(in_time) - 1).withColumn(
        "n_rows", F.count("*").over(Window.partitionBy("protocol"))
    )
    assert rows_of(placed, "protocol", "window_start", "t", "n_rows") == rows_of(
        naive, "protocol", "window_start", "t", "n_rows"
    )


def test_position_with_finer_bucket(walk, placed):
    hourly = with_position(walk, bucket=F.window("window_start", "1 hour").start)
    assert rows_of(hourly, "protocol", "window_start", "t") == rows_of(placed, "protocol", "window_start", "t")


@pytest.mark.parametrize("size", [1, 7, 13, 50, 100_000])
def test_neighbours_across_block_edges(placed, size):
    made = {"p1": before("x"), "p5": before("x", 5), "f3": after("x", 3)}
    got = with_neighbours(placed, made, back=5, ahead=3, block_rows=size)
    spec = Window.partitionBy("protocol").orderBy("t")
    naive = placed.withColumns(
        {"p1": F.lag("x").over(spec), "p5": F.lag("x", 5).over(spec), "f3": F.lead("x", 3).over(spec)}
    )
    columns = ("protocol", "t", "x", "p1", "p5", "f3")
    assert rows_of(got, *columns) == rows_of(naive, *columns)


@pytest.mark.parametrize("size", [3, 20, 100_000])
def test_nearest_cells(placed, size):
    holes = placed.withColumn("x", F.when((F.hash("x", "t") % 5 != 0) & (F.col("t") > 2), None).otherwise(F.col("x")))
    holes = holes.withColumn("x", F.when((F.col("protocol") == "b"), None).otherwise(F.col("x")))
    got = with_nearest(holes, ["x"], block_rows=size)
    spec = Window.partitionBy("protocol").orderBy("t")
    cell = F.when(F.col("x").isNotNull(), F.struct(F.col("t").alias("at"), F.col("x").alias("value")))
    naive = holes.withColumn("_prev_x", F.last(cell, True).over(spec.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "_next_x", F.first(cell, True).over(spec.rowsBetween(0, Window.unboundedFollowing))
    )
    columns = ("protocol", "t", "_prev_x", "_next_x")
    assert rows_of(got, *columns) == rows_of(naive, *columns)


def test_no_series_in_one_task(walk):
    numbered = with_position(walk)
    looked = with_neighbours(numbered, {"p": before("x")}, back=1, block_rows=50)
    filled = with_nearest(looked, ["x"], block_rows=50)
    plan = plan_of(filled)
    assert "SinglePartition" not in plan
    # Row-level windows are partitioned by bucket or block, never by series alone.
    for line in plan.splitlines():
        if "Window [" in line and "row_number" in line:
            assert "_bucket" in line
        if "Window [" in line and "lag(" in line:
            assert "_block" in line
