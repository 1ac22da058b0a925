"""Reading and writing, against small files written here."""

import json

import pytest
from pyspark.sql import functions as F

from sidelines.operators import clocks, ingest, periods
from sidelines.sources import results, tracking

SCHEMA = "tracking/v1"
HEADER = {"type": "metadata", "schema": SCHEMA, "engine": "external", "fps": 25.0}
FRAME = {
    "timestamp_ms": 1000, "width": 1920, "height": 1080,
    "objects": [
        {"role": "player", "track_id": 42, "bbox_xyxy": [100, 200, 150, 320], "team_cluster": "B", "jersey_number": 10, "pitch_xy": {"x": 0.0, "y": -8.5}},
        {"role": "referee", "track_id": "r1", "bbox_ltwh": [300, 200, 40, 100]}, {"role": "ball", "track_id": 1, "bbox_xyxy": [1, 1, 2, 2]},
    ],
}


def test_import_of_lines_and_of_a_document(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text(json.dumps(HEADER) + "\n\n" + json.dumps(FRAME) + "\n")
    (tmp_path / "b.json").write_text(json.dumps({k: v for k, v in HEADER.items() if k != "type"} | {"frames": [FRAME]}, indent=1))
    matches = spark.createDataFrame([("m", "B")], "match_id string, home_cluster string")
    for raw, meta in (tracking.read_ndjson(spark, str(tmp_path / "a.ndjson"), "m"), tracking.read_document(spark, str(tmp_path / "b.json"), "m")):
        frames, objects, errors = ingest.validate_frames(raw, meta, matches)
        assert ingest.header_errors(meta, SCHEMA, "external").count() == 0 and errors.count() == 0 and frames.count() == 1
        player, referee = objects.orderBy("role").collect()
        assert (player.track_id, player.team_key, player.shirt_number, player.pitch_x, player.pitch_y) == ("gsr-42", "home", 10, 0.0, -8.5)
        assert (referee.x2, referee.y2, referee.confidence) == (340.0, 300.0, 1.0)


def test_document_of_another_shape_is_an_error(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"predictions": [1]}))
    raw, meta = tracking.read_document(spark, str(tmp_path / "c.json"), "m")
    assert raw.count() == 0 and [r.rule for r in ingest.header_errors(meta, SCHEMA).collect()] == ["schema"]


def test_roster_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "r.csv").write_text("﻿name,shirt_number,position\nAda,7,gk\n,3,ST\nBo,x,CM\nCy,,libero\n", encoding="utf-8")
    players, errors = tracking.read_roster(spark, str(tmp_path / "r.csv"), "t")
    assert sorted((r.name, r.shirt_number, r.position) for r in players.collect()) == [("Ada", 7, "GK"), ("Cy", None, "OTHER")]
    assert sorted(r.rule for r in errors.collect()) == ["name", "shirt_number"]


def test_runs_are_replaced_alone_and_keys_updated(spark, tmp_path):
    path = str(tmp_path / "facts")
    make = lambda rows: spark.createDataFrame(rows, "match_id long, run_id long, v long")
    results.overwrite_run(make([(1, 1, 1), (1, 2, 2)]), path)
    results.overwrite_run(make([(1, 2, 9)]), path)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 9]
    done = results.upsert(make([(1, 1, 1), (1, 2, 2)]), make([(1, 2, 7), (2, 1, 8)]), ["match_id", "run_id"])
    assert sorted(r.v for r in done.collect()) == [1, 7, 8]


def test_tracking_rows_and_report(spark, tmp_path):
    rows = spark.range(4).selectExpr("id as ts_ms", "1L as match_id", "id % 2 as period", "'x' as diagnostics")
    results.write_tracking(rows, str(tmp_path / "t"))
    assert set(spark.read.json(str(tmp_path / "t")).columns) == {"ts_ms", "match_id", "period"}
    runs = spark.createDataFrame([(1, 1, 10), (1, 2, 20)], "match_id long, run_id long, created_at long")
    events = spark.createDataFrame([(1, 2, 5, 1, "pending"), (1, 2, 6, 2, "rejected"), (1, 1, 7, 3, "pending")], "match_id long, run_id long, ts_ms long, event_id long, review_status string")
    stats = spark.createDataFrame([(1, 3, 60.0)], "match_id long, team_id long, share double")
    report = results.match_report(runs.select("match_id").distinct(), spark.createDataFrame([(1, 1)], "match_id long, number long"), stats, stats.selectExpr("match_id", "team_id as player_id"), events, runs).collect()[0]
    assert [e["event_id"] for e in json.loads(report.report)["events"]] == [1]


def test_fusion_keeps_the_first_ball_and_foreign_athletes(spark):
    kinds = "seg long, ts_ms long, objects array<struct<role:string, id:string>>"
    local = spark.createDataFrame([(1, 1060, [("player", "l"), ("ball", "b"), ("ball", "c")]), (1, 1200, [("ball", "d")])], kinds)
    found = clocks.fuse(local, spark.createDataFrame([(1, 1000, [("player", "e"), ("ball", "z")])], kinds), 80).orderBy("ts_ms").collect()
    assert [[o["id"] for o in r.objects] for r in found] == [["e", "b"], ["d"]]
    assert [(r.missing, r.source_ms) for r in found] == [(False, 1000), (True, None)]


PERIODS = "match_id string, number int, start_ms long, end_ms long, clock_start_ms long, clock_end_ms long, source string, confidence double, confirmed boolean"
EDITS = "match_id string, number int, start string, end string, clock_start string"


def halves(match, first=(0, 10_000), second=(20_000, 30_000), confirmed=(True, True)):
    return [(match, n, *x, (n - 1) * 2_700_000, n * 2_700_000, "manual" if c else "automatic", 0.7, c) for n, x, c in ((1, first, confirmed[0]), (2, second, confirmed[1]))]


def test_period_edits(spark):
    videos = spark.createDataFrame([("m", 6_300_000)], "match_id string, duration_ms long")
    old = spark.createDataFrame(halves("m", (0, 2_700_000), (3_300_000, 6_000_000)), PERIODS)
    edits = spark.createDataFrame([("m", 2, "48:53.000", "01:40:08.000", "45:00"), ("m", 1, "00:00.000", "45:04", None)], EDITS)
    runs = spark.createDataFrame([("m", 1, "sample", True, False), ("m", 2, "full", True, False)], "match_id string, run_id int, mode string, approved boolean, stale boolean")
    new, errors, stale = periods.apply_period_edits(old, edits, videos, runs)
    assert {r.number: tuple(r)[2:] for r in new.collect()} == {1: (0, 2_704_000, 0, 2_704_000, "manual", 1.0, True), 2: (2_933_000, 6_008_000, 2_700_000, 5_775_000, "manual", 1.0, True)}
    assert not errors.count() and [(r.run_id, r.stale, r.approved) for r in stale.collect()] == [(1, True, False)]


def test_an_edit_is_taken_as_a_whole_or_not_at_all(spark):
    good = ("0", "25", "0")
    cases = {
        "timecode": [(1, *good), (2, "x", "31", "45:00")], "order": [(1, *good), (2, "24", "31", "45:00")], "clock": [(1, *good), (2, "25", "31", "0")],
        "duration": [(1, *good), (2, "25", "61", "45:00")], "half": [(1, *good)], "fine": [(1, *good), (2, "25", "31", "45:00")], "unknown_length": [(1, *good), (2, "25", "9:00:00", "45:00")],
    }
    old = spark.createDataFrame([r for m in cases for r in halves(m)], PERIODS)
    edits = spark.createDataFrame([(m, *e) for m, rows in cases.items() for e in rows], EDITS)
    videos = spark.createDataFrame([(m, 60_000) for m in cases if m != "unknown_length"], "match_id string, duration_ms long")
    runs = spark.createDataFrame([(m, "sample", True, False) for m in cases], "match_id string, mode string, approved boolean, stale boolean")
    new, errors, stale = periods.apply_period_edits(old, edits, videos, runs)
    assert dict(map(tuple, errors.collect())) == {m: "timecode" if m == "half" else m for m in ("timecode", "order", "clock", "duration", "half")}
    bad = "match_id not in ('fine', 'unknown_length')"
    assert sorted(map(tuple, new.where(bad).collect())) == sorted(map(tuple, old.where(bad).collect()))
    assert [(r.start_ms, r.end_ms) for r in new.where("match_id = 'fine'").orderBy("number").collect()] == [(0, 25_000), (25_000, 31_000)]
    assert sorted(r.match_id for r in stale.collect()) == ["fine", "unknown_length"]
    again, _, same = periods.apply_period_edits(new, edits.where("match_id = 'fine'"), videos, runs)
    assert not same.count() and sorted(map(tuple, again.collect())) == sorted(map(tuple, new.collect()))


def test_sampling_and_decimation_of_the_survey(spark):
    spans = spark.createDataFrame([(1, 0, 5_400_000, 15_000), (2, 0, 7_200_000, 1_000)], "id long, start_ms long, end_ms long, step long")
    for key, step, last in ((1, 15_000, 5_385_000), (2, 1_000, 7_100_001)):
        got = clocks.sample_timestamps(spans.where(F.col("id") == key), step, 360).agg(F.count("*"), F.max("ts_ms")).first()
        assert got[0] == 360 and got[1] >= last
    frames = spark.range(26).selectExpr("1L as seg", "id * 40 as ts_ms")
    assert [r.ts_ms for r in clocks.decimate(frames, 8).orderBy("ts_ms").collect()] == [0, 160, 280, 400, 520, 640, 760, 880, 1000]


def test_two_confirmed_halves_or_none(spark):
    found = spark.createDataFrame([(m, n, a, b, 0.6) for m in "abcd" for n, a, b in ((1, -5, 90), (2, 100, 260))], "match_id string, number int, start_ms long, end_ms long, confidence double")
    known = spark.createDataFrame([*halves("a"), *halves("b", confirmed=(True, False)), *halves("c", (0, 90), (100, 200), (False, False))], PERIODS)
    videos = spark.createDataFrame([(m, 200) for m in "abcd"], "match_id string, duration_ms long")
    for again in (False, True):
        rows, moved = periods.resolve_periods(known, found, videos, again)
        got = {(r.match_id, r.number): r for r in rows.collect()}
        assert len(got) == 8 and {r.source for r in got.values() if r.match_id == "b"} == {"automatic"}
        assert [tuple(got["a", n]) for n in (1, 2)] == halves("a") if not again else got["a", 1].source == "automatic"
        assert tuple(got["b", 2])[2:6] == (100, 200, 2_700_000, 2_700_160) and tuple(got["d", 1])[2:6] == (0, 90, 0, 95)
        assert sorted(r.match_id for r in moved.collect()) == (["a", "b"] if again else ["b"])
    runs = spark.createDataFrame([("b", i, i, "sample" if i % 2 else "full", True, False) for i in range(40)], "match_id string, run_id int, created_at int, mode string, approved boolean, stale boolean")
    assert sorted(r.run_id for r in periods.make_stale(runs, moved, 25).collect()) == list(range(15, 40, 2))


def test_many_files_in_one_read(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    for i in range(300):
        lines = [json.dumps(HEADER | {"engine_revision": f"r{i}"}), "", *(json.dumps(FRAME | {"timestamp_ms": 40 * k}) for k in range(12))]
        if i == 7:
            lines[5] = lines[5][:40]
        if i == 8:
            lines[4] = "[1, 2]"
        if i == 9:
            lines = lines[2:]
        (tmp_path / f"day{i % 3}").mkdir(exist_ok=True)
        (tmp_path / f"day{i % 3}" / f"m{i}.tracks.ndjson").write_text("\n".join(lines) if i != 10 else "\n \n")
    (tmp_path / "d1.json").write_text(json.dumps({"metadata": {"engine": "external", "fps": 5}, "schema": SCHEMA, "frames": [FRAME]}))
    (tmp_path / "d2.json").write_text(json.dumps([FRAME, HEADER, {"type": "note"}]))
    (tmp_path / "d3.json").write_text("{")
    (tmp_path / "d4.json").write_text(json.dumps({"predictions": []}))
    frames, headers, errors = tracking.read_tracking(spark, str(tmp_path))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    counts = {r.match_id: r["count"] for r in frames.groupBy("match_id").count().collect()}
    assert counts == {f"m{i}": 11 if i in (7, 8) else 12 for i in range(300) if i != 10} | {"d1": 1, "d2": 1}
    found = {(r.match_id, r.line, r.rule) for r in errors.collect()}
    assert found == {("m7", 6, "line"), ("m8", 5, "not_object"), ("m10", None, "empty"), ("d3", None, "line"), ("d4", None, "shape")}
    heads = {r.match_id: r for r in headers.collect()}
    assert len(heads) == 304 and heads["m20"].revision == "r20" and (heads["d1"].schema, heads["d1"].fps) == (SCHEMA, 5.0)
    assert {r.match_id for r in ingest.header_errors(headers, SCHEMA, "external").collect()} == {"m9", "m10", "d3", "d4"}
    good, _, rules = ingest.validate_frames(frames, headers, headers.selectExpr("match_id", "'A' as home_cluster"))
    assert good.count() == frames.count() and {(r.match_id, r.rule) for r in rules.collect()} == {(m, "no_frames") for m in ("m10", "d3", "d4")}


def test_lines_with_fields_of_another_kind_keep_the_rest(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text("\n".join(json.dumps(x) for x in (HEADER, FRAME | {"width": "wide"}, FRAME)))
    frames, headers, errors = tracking.read_lines(spark, str(tmp_path))
    assert not errors.count()
    good, _, rules = ingest.validate_frames(frames, headers, headers.selectExpr("match_id", "'A' as home_cluster"))
    assert good.count() == 1 and [r.rule for r in rules.collect()] == ["size_missing"]


def test_merge_rewrites_touched_partitions_and_survives_a_loss(spark, tmp_path, monkeypatch):
    path, kinds = str(tmp_path / "sheets"), "match_id long, player_id long, v long"
    make = lambda rows: spark.createDataFrame(rows, kinds)
    merge = lambda rows, gone=None: results.merge(make(rows), path, ["match_id", "player_id"], ["match_id"], None if gone is None else make(gone).drop("v"))
    table = lambda: sorted(map(tuple, spark.read.schema(kinds).parquet(path).select("match_id", "player_id", "v").collect()))
    merge([(1, 1, 1), (1, 2, 2), (2, 1, 3), (3, 9, 4)])
    untouched = {f: f.stat().st_mtime_ns for f in (tmp_path / "sheets" / "match_id=2").iterdir()}
    merge([(1, 2, 7), (4, 1, 8)], [(3, 9, 0), (1, 1, 0)])
    assert table() == [(1, 2, 7), (2, 1, 3), (4, 1, 8)]
    assert untouched == {f: f.stat().st_mtime_ns for f in (tmp_path / "sheets" / "match_id=2").iterdir()}
    assert not (tmp_path / "sheets" / "match_id=3").exists()

    ended = results.recover
    calls = []

    def lost(*arguments):
        calls.append(arguments)
        if len(calls) == 2:
            raise RuntimeError("the driver is lost after the decision")
        return ended(*arguments)

    monkeypatch.setattr(results, "recover", lost)
    with pytest.raises(RuntimeError):
        merge([(2, 1, 30), (5, 5, 50)])
    monkeypatch.setattr(results, "recover", ended)
    results.recover(spark, path, ["match_id"])
    after = [(1, 2, 7), (2, 1, 30), (4, 1, 8), (5, 5, 50)]
    assert table() == after
    make([(2, 2, 99)]).write.partitionBy("match_id").parquet(f"{path}/{results.STAGED}")  # lost before the decision
    assert table() == after
    for _ in range(2):
        merge([(4, 1, 9)])
    assert table() == [*after[:2], (4, 1, 9), after[3]]


def test_tracker_state_and_events_written(spark, tmp_path):
    spark.createDataFrame([(1, 5, 0.9), (2, 6, 0.8), (9, 7, 0.7)], "image_id long, track_id long, confidence double").write.parquet(f"{tmp_path}/detections")
    spark.createDataFrame([(1, 100, "x"), (2, 101, "x"), (3, 102, "x")], "image_id long, frame long, path string").write.parquet(f"{tmp_path}/images")
    found = tracking.read_tracker_state(spark, f"{tmp_path}/detections", f"{tmp_path}/images")
    assert sorted((r.track_id, r.frame) for r in found.collect()) == [(5, 100), (6, 101)]
    for _ in range(2):
        results.write_events(spark.createDataFrame([(1, "pass"), (2, None)], "event_id long, event_type string"), f"{tmp_path}/events")
    assert sorted(map(tuple, spark.read.json(f"{tmp_path}/events").select("event_id", "event_type").collect())) == [(1, "pass"), (2, None)]
