"""Work that follows the rows of a table and not what they span."""

import pytest
from pyspark.sql import functions as F

from sidelines.operators import clocks, conversion, ingest
from sidelines.plans.catalog import QUERIES

DATA = "/root/testdata/sf0.001"
PARTS = "match_id int, seg_index int, composite_start_frame long, frame_count long, source_start_ms long, source_end_ms long"


def test_gaps_between_frames_are_one_row(spark):
    parts = spark.createDataFrame([(1, 1, 0, 10**12, 0, 10**16), (1, 2, 10**12 + 5, 0, 0, 9), (1, 3, 10**12 + 5, 3, 0, 9), (2, 1, 0, 4, 0, 9)], PARTS)
    objects = spark.createDataFrame([(1, 7, "a"), (1, 7, "b"), (1, 10**12 - 1, "a"), (1, 10**12 + 2, "a"), (1, 10**12 + 6, "a"), (3, 1, "a")], "match_id int, frame long, track_id string")
    runs = conversion.frame_runs(objects, parts).select("match_id", "seg_index", "frame", "frames", F.size("objects").alias("n")).orderBy("match_id", "frame").collect()
    big = 10**12
    assert [(r.match_id, r.seg_index, r.frame, r.frames, max(0, r.n or 0)) for r in runs] == [
        (1, 1, 0, 7, 0), (1, 1, 7, 1, 2), (1, 1, 8, big - 9, 0), (1, 1, big - 1, 1, 1), (1, 3, big + 5, 1, 0), (1, 3, big + 6, 1, 1), (1, 3, big + 7, 1, 0), (2, 1, 0, 4, 0),
    ]
    best = {r.match_id: (r.frame, r.n) for r in conversion.busiest_frame(conversion.frame_runs(objects, parts)).collect()}
    assert best == {1: (7, 2), 2: (0, 0)}


def test_dense_frames_are_every_frame_once(spark):
    parts = spark.createDataFrame([(1, 1, 0, 4, 1000, 1700), (1, 2, 6, 3, 5000, 9000)], PARTS)
    objects = spark.createDataFrame([(1, 1, "b"), (1, 1, "a"), (1, 5, "a"), (1, 8, "a")], "match_id int, frame long, track_id string")
    rows = conversion.densify(objects, parts, 5.0).orderBy("frame").collect()
    assert [(r.seg_index, r.frame, r.ts_ms, [o.track_id for o in r.objects or []]) for r in rows] == [
        (1, 0, 1000, []), (1, 1, 1200, ["a", "b"]), (1, 2, 1400, []), (1, 3, 1600, []), (2, 6, 5000, []), (2, 7, 5200, []), (2, 8, 5400, ["a"]),
    ]
    filled = conversion.filled_frames(objects, parts, 5.0).orderBy("frame").collect()
    assert filled == [r for r in rows if r.objects]


def plan(df):
    return df._jdf.queryExecution().executedPlan()


def shuffles(df):
    return plan(df).toString().count("Exchange hashpartitioning")


def longest_method(spark, df):
    """Bytes of the longest method that Spark makes for a query: the JVM never compiles those over 8000."""
    df.collect()
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    made = debug.codegenStringSeq(plan(df))
    return max(made.apply(i)._3().maxMethodCodeSize() for i in range(made.size()))


@pytest.mark.parametrize("name", ["located_detections", "dense_frames", "dense_objects", "imported_objects", "imported_detections", "import_frame_counts", "import_summaries", "import_errors"])
def test_methods_are_short_enough_to_be_compiled(spark, name):
    assert longest_method(spark, QUERIES[name](spark, DATA)) <= 8000


@pytest.mark.parametrize("name", ["imported_objects", "imported_detections", "import_frame_counts"])
def test_frames_are_shuffled_once(spark, name):
    df = QUERIES[name](spark, DATA)
    assert plan(df).toString().count("objects#") and shuffles(df) <= 4


def test_places_and_repeated_times(spark):
    values = ['{"x":1,"y":2}', ' {"x_bottom_middle":3,"y_bottom_middle":"4"}', " [5,6]", "none", '"x"', "[7]", "7", None, '{"x":"far","y":1}', '[{"x":1,"y":2}]']
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", ingest.pitch(F.col("v"), "x"), ingest.pitch(F.col("v"), "y")).orderBy("i").collect()
    assert [(r[1], r[2]) for r in rows] == [(1, 2), (3, 4), (5, 6), (None, None), (None, None), (7, None), (None, None), (None, None), (None, 1), (None, None)]
    frame = "match_id string, timestamp_ms double, frame_index double, width long, height long, field_score double, scene_cut boolean, replay_probability double, coordinate_space string"
    times = [("m", 5.0, 9), ("m", 5.0, 9), ("m", 5.0, 0), ("m", 6.0, 9), ("m", 6.0, 0), ("m", None, 9), ("m", None, 9), ("n", 7.0, 9), ("n", 7.0, 9), ("n", 7.0, 9)]
    raw = spark.createDataFrame([(m, t, None, w, 9, None, None, None, None) for m, t, w in times], frame).withColumn("objects", F.lit(None).cast(ingest.FRAME["objects"].dataType))
    heads = spark.createDataFrame([(m, "external", 0.0, "A") for m in "mn"], "match_id string, engine string, fps double, home_cluster string")
    frames, _, errors = ingest.validate_frames(raw, heads.drop("home_cluster"), heads.select("match_id", "home_cluster"))
    assert [(r.match_id, r.ts_ms) for r in frames.collect()] == [("m", 6)]
    assert sorted((r.match_id, r.ts_ms or 0, r.rule) for r in errors.collect()) == [("m", 0, "timestamp_missing"), ("m", 0, "timestamp_missing"), ("m", 5, "duplicate_timestamp"), ("m", 5, "out_of_range"), ("m", 6, "out_of_range"), ("n", 0, "no_frames"), ("n", 7, "duplicate_timestamp")]


def test_nearest_rows_take_one_sort_and_only_the_columns_asked_for(spark):
    df = QUERIES["fusion_errors"](spark, DATA)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Window [") == 3 and "objects" not in text  # two for the frames of both sides
    rows = clocks.asof_nearest(spark.createDataFrame([(1, 100), (1, 109), (1, 120), (2, 5)], "seg int, ts_ms long"), spark.createDataFrame([(1, 90, None), (1, 110, "b"), (1, 120, None)], "seg int, ts_ms long, v string"), 10)
    assert [(r.seg, r.ts_ms, r.near and (r.near.ts_ms, r.near.v)) for r in rows.orderBy("seg", "ts_ms").collect()] == [(1, 100, (110, "b")), (1, 109, (110, "b")), (1, 120, (120, None)), (2, 5, None)]


def test_coverage_is_one_pass(spark):
    assert "Join" not in QUERIES["fused_coverage"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


def test_detections_are_not_gathered_by_class(spark):
    df = QUERIES["class_counts"](spark, DATA)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "hashpartitioning(frame" in plan(df).toString() and "SortMergeJoin" not in plan(QUERIES["class_counts"](spark, DATA)).toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_spans_are_made_in_one_pass(spark):
    text = QUERIES["possession_spans"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in text and text.count("Relation [") == 1
    sheets = QUERIES["team_sheets"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert sheets.count("Relation [") == 4  # teams, events, possession, minutes
