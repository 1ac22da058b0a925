"""Streams against the same rules on tables, and folds against plain restatements."""

import itertools
import time

import pytest
from pyspark.sql import functions as F

from sidelines.operators import clocks, detections, events, possession
from sidelines.plans import detection
from sidelines.plans import fixtures as fx
from sidelines.plans.catalog import QUERIES
from sidelines.streaming import live

DATA = "/root/testdata/sf0.001"


def drained(spark, rows, parts, tmp_path, make, by="ts_ms", mode="append", until=None):
    """What `make` of a stream gives when the rows arrive in `parts` batches by the column `by`; `until` so many rows are there,
    where state that goes by the cluster's clock keeps the stream going."""
    path = tmp_path / "in"
    edges = rows.approxQuantile(by, [i / parts for i in range(1, parts)], 0.0)
    for i, (low, high) in enumerate(itertools.pairwise([-1.0, *edges, 1e18])):
        rows.where((F.col(by) > low) & (F.col(by) <= high)).coalesce(1).write.mode("append").parquet(str(path / f"p{i}"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))
    name = f"sink_{tmp_path.name.replace('-', '_')}"
    query = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    began = time.time()
    while query.isActive and time.time() - began < 120 and not (until and spark.table(name).count() >= until):
        query.awaitTermination(1)
    query.stop()
    return spark.table(name)


SAMPLE = ["seg", "ts_ms", "state", "team_key", "player_key", "round(ball_x, 6) as ball_x", "round(ball_y, 6) as ball_y", "round(confidence, 6) as confidence", "reason", "contenders", "coordinate_space"]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # each batch starts a worker for each partition
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def disordered(spark, people, balls, extra=()):
    """Frames with the time they were taken, that arrive up to four seconds late, and a last one that moves the watermark."""
    packed = people.groupBy("seg", "ts_ms").agg(F.array_sort(F.collect_list(F.struct("obj_ord", "team_key", "player_key", "confidence", "x", "y"))).alias("athletes"))
    frames = balls.join(packed, ["seg", "ts_ms"], "left").select("seg", "ts_ms", "field_score", "scene_cut", "replay_probability", "ball_x", "ball_y", "athletes", *extra)
    last = frames.limit(1).withColumn("seg", F.lit(-1).cast("long")).withColumn("ts_ms", F.lit(10**9).cast("long"))
    frames = frames.unionByName(last).withColumn("at", F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("ts_ms")))
    return frames.withColumn("arrives", F.col("ts_ms") + F.pmod(F.xxhash64("seg", "ts_ms"), F.lit(4000))).withColumn("arrives", F.col("arrives").cast("double"))


@pytest.mark.parametrize("metres", [False, True])
def test_live_possession_puts_late_frames_in_order(rocks, tmp_path, metres):
    spark = rocks
    people, balls = fx.athletes(spark, DATA).where("seg < 3 and ts_ms % 700 <> 0"), fx.frames(spark, DATA).where("seg < 3")
    balls = balls.withColumn("ball_seen", F.col("ball_x").isNotNull() | (F.col("ts_ms") % 900 == 0)).withColumn("scene_cut", F.col("ts_ms") % 1100 == 0)
    if metres:  # every third frame is in shares of the image
        place = lambda c, x: F.when(F.col("ts_ms") % 3 == 0, F.col(c)).otherwise(F.expr(f"{c} * 140 - 20" if c == x else f"{c} * 90 - 10")).alias(c)
        people, balls = people.withColumns({c: place(c, "x") for c in ("x", "y")}), balls.withColumns({c: place(c, "ball_x") for c in ("ball_x", "ball_y")})
    balls = balls.withColumn("coordinate_space", F.when(F.col("ts_ms") % 3 != 0, "pitch_meters") if metres else F.lit(None).cast("string"))
    wanted = possession.possession(balls, people)
    found = drained(spark, disordered(spark, people, balls, ("ball_seen", "coordinate_space")), 4, tmp_path, live.live_possession, by="arrives").where("seg >= 0")
    rows = found.selectExpr(*SAMPLE).collect()
    assert sorted(map(str, rows)) == sorted(map(str, wanted.selectExpr(*SAMPLE).collect()))
    seen = {r.state for r in rows}
    assert {"controlled", "contested", "loose", "unknown"} <= seen and ("out" in seen) == metres and {r.coordinate_space for r in rows} == {None, "image_normalized", *(["pitch_meters"] if metres else [])}
    for detect in (events.duels, events.outs, events.shots, lambda x: events.carries(events.controlled_runs(x))):
        assert sorted(map(str, detect(found).collect())) == sorted(map(str, detect(wanted).collect()))


def test_live_ball_equals_table(spark, tmp_path):
    rows = detection._balls(spark, DATA).selectExpr("frame div 200 as seg", "frame * 40 as ts_ms", "cast(det_id as long) as det_id", "cx", "cy", "confidence", "gain", "near")
    found = drained(spark, rows, 3, tmp_path, live.live_ball).collect()
    assert found and sorted(map(tuple, found)) == sorted(map(tuple, detections.select_ball(rows).select("seg", "ts_ms", "det_id").collect()))


def test_live_progress_equals_table(spark, tmp_path):
    rows = fx.frames(spark, DATA).selectExpr("seg as run_id", "ts_ms", "ts_ms div 3 + 5 as elapsed_ms")
    runs = rows.select("run_id").distinct().selectExpr("run_id", "run_id * 10 as start_ms", "90000 + run_id as duration_ms")
    found = drained(spark, rows, 3, tmp_path, lambda s: live.live_progress(s, runs), mode="update").collect()
    wanted = {r.run_id: r for r in clocks.progress(rows.join(runs, "run_id")).collect()}
    last = {}
    for r in sorted(found, key=lambda r: r.frames):
        last[r.run_id] = r
    assert len(found) > len(last) and last == wanted and {r.percent for r in last.values()} != {68}


def test_live_checks_name_every_bad_frame(rocks, tmp_path):
    spark = rocks
    frames = [(i, f"m{i % 4}", None if i == 4 else -40 if i == 8 else i % 60 * 40, 0 if i == 12 else None if i == 16 else 1280, 720) for i in range(160)]
    rows = spark.createDataFrame([(*f, "x") for f in frames], "ord long, match_id string, ts_ms long, width long, height long, payload string")
    heads = spark.createDataFrame([("m0", "s/1", "a"), ("m1", "s/1", "a"), ("m2", "s/0", "a")], "match_id string, schema string, engine string")
    found = drained(spark, rows, 3, tmp_path, lambda s: live.live_checks(s, heads, "s/1", "a"), by="ord", until=len(frames))
    assert found.columns == [*rows.columns, "rule"]
    got = {r.ord: r for r in found.collect()}
    assert len(got) == found.count() == 160 and sorted(map(tuple, found.drop("rule").collect())) == sorted(map(tuple, rows.collect()))
    good = {}
    for i, match, ts, width, _ in frames:
        rule = {"m2": "schema", "m3": "header_missing"}.get(match) or ("timestamp_missing" if ts is None else "size_missing" if width is None else "out_of_range" if ts < 0 or width <= 0 else None)
        if rule:
            assert got[i].rule == rule
        else:
            good.setdefault((match, ts), []).append(got[i].rule)
    assert all(sorted(map(str, rules)) == ["None", *["duplicate_timestamp"] * (len(rules) - 1)] for rules in good.values()) and max(map(len, good.values())) > 2


def overlap(a, b):
    i = max(0, min(a.x2, b.x2) - max(a.x1, b.x1)) * max(0, min(a.y2, b.y2) - max(a.y1, b.y1))
    p, q = ((o.x2 - o.x1) * (o.y2 - o.y1) for o in (a, b))
    return i / (p + q - i), i / min(p, q)


def test_distinct_boxes_against_plain_loop(spark):
    found = {(r.frame, r.det_id) for r in QUERIES["distinct_boxes"](spark, DATA).collect()}
    frames = {}
    for r in detection.boxes(spark, DATA).collect():
        frames.setdefault(r.frame, []).append(r)
    wanted = set()
    for rows in frames.values():
        kept = []
        for r in sorted(rows, key=lambda r: (-r.confidence, r.det_id)):
            if not any(i >= 0.6 or c >= 0.9 for i, c in (overlap(r, k) for k in kept)):
                kept.append(r)
        wanted |= {(r.frame, r.det_id) for r in kept}
    assert found == wanted


def test_repaired_clock_rises(spark):
    rows = QUERIES["repaired_clock"](spark, DATA).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.seg, r.frame)):
        assert r.ts_ms > by.get(r.seg, -1)
        by[r.seg] = r.ts_ms


def test_jersey_groups_split_two_clouds(spark):
    rows = [(1, i % 7 + (60.0 if i % 2 else 0.0), i % 5 + (150.0 if i % 2 else 40.0)) for i in range(40)] + [(2, 50.0, 50.0)] * 10
    features = spark.createDataFrame(rows, "match_id long, hue double, sat double")
    centres = {r.match_id: r for r in detections.fit_jersey_groups(features).collect()}
    assert centres[1].accepted and centres[1].a.sat < 50 < centres[1].b.sat and not centres[2].accepted
    teams = detections.classify_jersey(features, detections.fit_jersey_groups(features)).where("match_id = 1").collect()
    assert all(r.team == ("away" if r.sat > 100 else "home") for r in teams)
