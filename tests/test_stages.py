"""Clustered and dated stage tables: results, plans and files."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from emberfield.operators.joins import paired_contrast
from emberfield.sources.stages import open_clustered, read_dated, write_clustered, write_dated

DAY = dt.date(2024, 1, 1)


def fresh_name():
    return f"stage_{uuid.uuid4().hex}"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_join_of_clustered_stages_moves_nothing(spark, tmp_path, no_broadcast):
    obs = spark.range(1000).select(F.concat(F.lit("o"), "id").alias("obs_id"), (F.col("id") * 2).alias("v"))
    predicted = spark.range(0, 3000).select(F.concat(F.lit("o"), F.col("id") % 1500).alias("obs_id"), F.rand(1).alias("p"))
    one = write_clustered(obs, fresh_name(), str(tmp_path / "one"), ["obs_id"], 7)
    two = write_clustered(predicted, fresh_name(), str(tmp_path / "two"), ["obs_id"], 7)
    joined = one.join(two, "obs_id")
    assert "Exchange" not in plan_of(joined) and "SortMergeJoin" in plan_of(joined)
    assert "Exchange" in plan_of(obs.join(predicted, "obs_id"))
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, obs.join(predicted, "obs_id").collect()))
    sums = two.groupBy("obs_id").agg(F.sum("p"))
    assert "Exchange" not in plan_of(sums) and sums.count() == 1500
    assert len(list((tmp_path / "one").glob("*.parquet"))) <= 7


def test_files_are_named_anew(spark, tmp_path, no_broadcast):
    rows = spark.range(500).select(F.col("id").alias("obs_id"), F.array("id").alias("a"), F.struct(F.lit("x").alias("s")).alias("an odd `name`"))
    name = fresh_name()
    write_clustered(rows, name, str(tmp_path / "t"), ["obs_id"], 5)
    spark.sql(f"DROP TABLE {name}")
    again = open_clustered(spark, fresh_name(), str(tmp_path / "t"), ["obs_id"], 5)
    assert again.columns == rows.columns and sorted(r["obs_id"] for r in again.collect()) == list(range(500))
    assert "Exchange" not in plan_of(again.join(again.select("obs_id").distinct(), "obs_id"))


def test_scenarios_of_a_stage_are_paired_without_a_shuffle(spark, tmp_path, no_broadcast):
    rows = spark.range(400).select((F.col("id") % 100).alias("obs_id"), (F.col("id") % 2).alias("draw_id"), F.when(F.col("id") < 200, "actual").otherwise("counterfactual").alias("scenario"), F.col("id").cast("double").alias("value"))
    stage = write_clustered(rows, fresh_name(), str(tmp_path / "p"), ["obs_id"], 4)
    pairs = paired_contrast(stage, ["obs_id", "draw_id"])
    assert "Exchange" not in plan_of(pairs)
    assert sorted(map(str, pairs.collect())) == sorted(map(str, paired_contrast(rows, ["obs_id", "draw_id"]).collect()))


def test_empty_and_missing(spark, tmp_path):
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "obs_id string, v int")
    stage = write_clustered(rows, fresh_name(), str(tmp_path / "m"), ["obs_id"])
    assert sorted(r["v"] for r in stage.collect()) == [1, 2, 3]
    assert write_clustered(rows.limit(0), fresh_name(), str(tmp_path / "e"), ["obs_id"], 3).count() == 0


def days(spark, rows):
    return spark.createDataFrame([(DAY + dt.timedelta(d) if d is not None else None, v) for d, v in rows], "day date, v int")


def test_days_are_replaced(spark, tmp_path):
    path = str(tmp_path / "d")
    write_dated(days(spark, [(0, 1), (0, 2), (1, 3), (2, 4), (None, 5)]), path, "day")
    write_dated(days(spark, [(1, 30), (3, 6)]), path, "day")
    assert {(r["day"] and (r["day"] - DAY).days, r["v"]) for r in read_dated(spark, path, "day").collect()} == {(0, 1), (0, 2), (1, 30), (2, 4), (3, 6), (None, 5)}
    window = read_dated(spark, path, "day", "2024-01-02", DAY + dt.timedelta(2))
    assert sorted(r["v"] for r in window.collect()) == [4, 30]
    filters = plan_of(window).split("PartitionFilters: [")[1].split("]")[0]
    assert "day" in filters and ">=" in filters and "<=" in filters
    assert window._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
    with pytest.raises(ValueError):
        write_dated(days(spark, [(0, 1)]).withColumn("day", F.col("day").cast("timestamp")), path, "day")


def test_a_day_without_new_rows_stays(spark, tmp_path):
    path = str(tmp_path / "s")
    write_dated(days(spark, [(0, 1), (1, 2)]), path, "day")
    write_dated(days(spark, []), path, "day")
    assert read_dated(spark, path, "day").count() == 2


def test_many_days_share_tasks(spark, tmp_path):
    path = tmp_path / "w"
    rows = spark.range(5000).select(F.date_add(F.lit(DAY), (F.col("id") % 50).cast("int")).alias("day"), F.col("id").alias("v")).repartition(9)
    write_dated(rows, str(path), "day")
    assert len(list(path.glob("day=*/*.parquet"))) == 50 and read_dated(spark, str(path), "day").count() == 5000
