"""Rules that depend on the row before, fits and reports, each restated plainly."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sidelines.operators import clocks, detections, diagnostics, possession, stats
from sidelines.plans import detection
from sidelines.plans import fixtures as fx
from sidelines.plans.catalog import QUERIES
from sidelines.sources import results

DATA = "/root/testdata/sf0.001"


def test_repaired_clock(spark):
    rng = random.Random(3)
    rows = [(seg, i, rng.choice([None, i * 40 + rng.randint(-90, 90)]), 100, 25.0) for seg in range(3) for i in range(80)]
    found = {(r.seg, r.frame): r.ts_ms for r in clocks.repair_clock(spark.createDataFrame(rows, "seg long, frame long, reported_ms long, start_ms long, fps double")).collect()}
    for seg in range(3):
        last = None
        for _, i, reported, start, _ in (r for r in rows if r[0] == seg):
            trusted = reported is not None and reported >= start and (last is None or reported > last)
            now = reported if trusted else i * 40
            last = now if last is None or now > last else last + 40
            assert found[seg, i] == last


def test_ball_choice(spark):
    rng = random.Random(4)
    rows = [(seg, ts, d, rng.uniform(0, 600), rng.uniform(0, 400), rng.random(), rng.choice([0.0, 0.2, 0.4]), rng.random() < 0.4) for seg in range(2) for ts in range(0, 6000, 240) for d in range(3)]
    frame = spark.createDataFrame(rows, "seg long, ts_ms long, det_id long, cx double, cy double, confidence double, gain double, near boolean")
    expected = set()
    for seg in range(2):
        last = None
        for ts in range(0, 6000, 240):
            scored = []
            for _, _, d, x, y, sure, gain, near in (r for r in rows if r[:2] == (seg, ts)):
                bonus = 0.0
                if last and ts - last[0] <= 1500:
                    reach = min(360.0, max(85.0, (ts - last[0]) * 1.1))
                    away = ((x - last[1]) ** 2 + (y - last[2]) ** 2) ** 0.5
                    near, bonus = (True, 0.5 * (1 - away / reach)) if away <= reach else (near, 0.0)
                if near:
                    scored.append((sure + gain + bonus, -d, x, y))
            if scored:
                _, d, x, y = max(scored)
                expected.add((seg, ts, -d))
                last = (ts, x, y)
    assert {(r.seg, r.ts_ms, r.det_id) for r in detections.select_ball(frame).collect()} == expected


def test_jersey_groups(spark):
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal((20, 40), 6, (60, 2)), rng.normal((90, 160), 9, (40, 2))])
    centres = [points[points[:, 1] <= points[:, 1].mean()].mean(axis=0), points[points[:, 1] > points[:, 1].mean()].mean(axis=0)]
    for _ in range(7):
        second = np.hypot(*(points - centres[1]).T) < np.hypot(*(points - centres[0]).T)
        centres = [points[~second].mean(axis=0), points[second].mean(axis=0)]
    row = detections.fit_jersey_groups(spark.createDataFrame([(1, float(a), float(b)) for a, b in points], "match_id long, hue double, sat double")).first()
    assert row.accepted and np.allclose([row.a.hue, row.a.sat, row.b.hue, row.b.sat], np.concatenate(centres))


def test_homography_fit_leaves_outliers_out(spark):
    h = np.array([[1.2, 0.1, 30], [-0.2, 0.9, 12], [0.0004, 0.0002, 1]])
    rng = np.random.default_rng(6)
    rows = []
    for i, (x, y) in enumerate(rng.uniform(0, 800, (24, 2))):
        p = h @ (x, y, 1)
        to = p[:2] / p[2] + (90 if i % 6 == 0 else 0)
        rows.append((1, *map(float, (x, y, *to))))
    rows += [(2, 0.0, 0.0, 1.0, 1.0), (2, 1.0, 1.0, 2.0, 2.0), (2, 5.0, None, 1.0, 1.0), (3, 1.0, 1.0, 1.0, 1.0)]
    found = detections.fit_homographies(spark.createDataFrame(rows, "seg long, x double, y double, to_x double, to_y double")).collect()
    assert [r.seg for r in found] == [1] and np.allclose(np.reshape(found[0].h, (3, 3)), h, atol=1e-4)


def test_duplicates_are_counted(spark):
    rows = [(1, 1, "player", 0.9, 0.0, 0.0, 10.0, 20.0), (1, 2, "player", 0.8, 0.0, 0.0, 10.0, 20.5), (1, 3, "ball", 0.5, 3.0, 3.0, 4.0, 4.0), (2, 4, "referee", 0.9, 0.0, 0.0, 5.0, 9.0)]
    found = spark.createDataFrame(rows, "frame long, det_id long, role string, confidence double, x1 double, y1 double, x2 double, y2 double")
    counted = detections.detection_counts(found, detections.suppress_duplicates(found.where("role <> 'ball'")))
    assert {r.frame: (r.detections, r.duplicates) for r in counted.collect()} == {1: (3, 1), 2: (1, 0)}


def test_frames_say_their_space_and_whether_a_ball_has_a_place(spark):
    kind = "seg int, ts_ms long, field_score double, scene_cut boolean, replay_probability double, ball_x double, ball_y double, coordinate_space string, ball_seen boolean"
    rows = [(1, 0, 0.8, False, 0.0, 50.0, 30.0, "pitch_meters", True), (1, 100, 0.8, False, 0.0, None, None, "pitch_meters", True), (1, 200, 0.8, False, 0.0, None, None, None, False), (1, 300, 0.8, False, 0.0, 106.0, 30.0, "pitch_meters", True), (1, 400, 0.8, False, 0.0, 0.5, 0.5, "image_normalized", True)]
    places = [(1, 0, 0, "home", "p1", 0.9, 52.0, 30.0, 0.1, 0.1), (1, 400, 0, "home", "p1", 0.9, None, 9.0, 0.54, 0.5)]
    athletes = possession.positions(spark.createDataFrame(places, "seg int, ts_ms long, obj_ord int, team_key string, player_key string, confidence double, pitch_x double, pitch_y double, image_x double, image_y double"))
    found = possession.possession(spark.createDataFrame(rows, kind), athletes).orderBy("ts_ms").collect()
    assert [(r.state, round(r.confidence, 2)) for r in found] == [("controlled", 0.25), ("unknown", 0.1), ("controlled", 0.35), ("out", 0.76), ("controlled", 0.25)]


def test_gap_follows_the_tracking_rate(spark):
    rates = spark.createDataFrame([(12.5,), (2.0,), (0.5,)], "fps double")
    assert [r[0] for r in rates.select(possession.gap_of(rates.fps)).collect()] == [1000, 1250, 5000]


def test_sheets_are_blank_without_events(spark):
    none = spark.createDataFrame([], "seg int, team_key string, event_type string, outcome string, qualifiers array<string>")
    spans = spark.createDataFrame([(1, 0, 90_000, "loose", None)], "seg int, start_ms long, end_ms long, state string, team_key string")
    rows = stats.team_sheets(spark.createDataFrame([(1, "home"), (2, "away")], "seg int, team_key string"), none, spans).orderBy("seg").collect()
    assert [r.minutes_played for r in rows] == [1.5, 0.0] and len(stats.METRICS) == 21
    assert all(r[m] == 0 for r in rows for m in stats.METRICS)


def test_coverage_gate_puts_its_issue_first(spark):
    runs = spark.createDataFrame([(1, "warning", ["a"]), (2, "pass", []), (3, "pass", [])], "run_id int, verdict string, issues array<string>")
    coverage = spark.createDataFrame([(1, 9, True), (2, 1, False)], "run_id int, missing_frames long, failed boolean")
    found = {r.run_id: (r.missing_frames, r.verdict, r.issues) for r in diagnostics.gate_coverage(runs, coverage).collect()}
    assert found == {1: (9, "fail", ["external_coverage", "a"]), 2: (1, "pass", []), 3: (0, "pass", [])}


def test_run_report_has_every_part(spark):
    runs = spark.createDataFrame([(7, 1, "full"), (8, 1, "sample")], "run_id int, match_id int, mode string")
    parts = {"quality": spark.createDataFrame([(7, 61.5, "B")], "run_id int, score double, grade string"), "backend": spark.createDataFrame([(7, "yolo")], "run_id int, backend string"), "periods": spark.createDataFrame([(7, 2, 9), (7, 1, 0)], "run_id int, number int, start_ms int")}
    found = {r.run_id: json.loads(r.report) for r in results.run_report(runs, parts, {"events": parts["periods"]}, "report/1").collect()}
    assert found[7]["quality"] == {"score": 61.5, "grade": "B"} and found[7]["backend"] == "yolo" and found[7]["counts"] == {"events": 2}
    assert [p["number"] for p in found[7]["periods"]] == [1, 2] and found[7]["windows"] == [] and found[7]["schema"] == "report/1"
    assert found[8]["counts"] == {"events": 0} and found[8]["periods"] == [] and found[8]["analysis_mode"] == "sample"


def two_groups(samples):
    mean = sum(s for _, s in samples) / len(samples)
    side, centres = [s > mean for _, s in samples], None
    for _ in range(40):
        if all(side) or not any(side):
            break
        new = []
        for k in (False, True):
            mine = [p for p, x in zip(samples, side, strict=True) if x == k]
            new.append((sum(h for h, _ in mine) / len(mine), sum(s for _, s in mine) / len(mine)))
        still = centres is not None and max(abs(a - b) for c, d in zip(new, centres, strict=True) for a, b in zip(c, d, strict=True)) <= 0.15
        centres = new
        side = [math.dist(p, centres[1]) < math.dist(p, centres[0]) for p in samples]
        if still:
            break
    if centres is None:
        return None, 0
    return sorted(centres, key=lambda c: (c[1], c[0])), min(sum(side), len(side) - sum(side))


def test_jersey_groups_in_force_over_a_whole_table(spark):
    drift = lambda i: (i % 2) * max(0, 40 - i // 10)  # noqa: E731  (the groups meet as the match goes on)
    rng = np.random.default_rng(5)
    rows = [(m, i, float(rng.normal(30 + drift(i), 3)), float(rng.normal(60 + 2 * drift(i), 4))) if i % 50 else (m, i, None, 1.0) for m in range(3) for i in range((0, 7, 900)[m] if m else 450)]
    table = spark.createDataFrame(rows, "match_id long, ord long, hue double, sat double")
    real = detection.jersey_features(spark, DATA).withColumnRenamed("vec_id", "ord").select("match_id", "ord", "hue", "sat")
    for features in (table, real):
        found = {(r.match_id, r.ord): (r.team, r.fits) for r in detections.calibrated_teams(features.repartition(3), ["ord"]).collect()}
        held, groups, last, fits, match, taken = [], None, 0, 0, None, set()
        for r in sorted(features.collect(), key=lambda r: (r.match_id, r.ord)):
            if r.match_id != match:
                match, held, groups, last, fits = r.match_id, [], None, 0, 0
            team = None
            if r.hue is not None:
                held = [*held, (r.hue, r.sat)][-400:]
                if len(held) >= 12 and (groups is None or len(held) - last >= 40):
                    centres, least = two_groups(held)
                    if least >= max(2, round(len(held) * 0.12)) and math.dist(*centres) >= 12:
                        groups, last, fits = centres, len(held), fits + 1
                if groups:
                    a, b = (math.dist((r.hue, r.sat), c) for c in groups)
                    team = ("home" if a <= b else "away") if abs(a - b) >= 3 else None
            assert found.pop((r.match_id, r.ord)) == (team, fits)
            taken.add((team, fits > 1))
        assert not found and {("home", True), ("away", True)} <= taken


@pytest.mark.parametrize("block", [1, 7, 256])
def test_products_of_blocks_are_those_of_a_plain_fold(spark, block):
    rng = np.random.default_rng(3)
    rows = []
    for seg, n in ((1, 600), (2, 1), (3, 40)):
        for i in range(n):
            h = np.eye(3) + rng.normal(0, 0.02, (3, 3))
            rows.append((seg, i * 40, None if i % 11 == 5 else h.ravel().tolist(), i % 5 != 3, seg == 3 and i % 9 == 0))
    camera = spark.createDataFrame(rows, "seg long, ts_ms long, h array<double>, reliable boolean, reset boolean")
    found = {(r.seg, r.ts_ms): r.total for r in detections.compose_homographies(camera, block).collect()}
    assert len(found) == len(rows)
    total = np.eye(3)
    for seg, ts, h, reliable, reset in rows:
        if ts == 0 or reset:
            total = np.eye(3)
        if reliable and h:
            total = total @ np.array(h).reshape(3, 3)
            total /= total[2, 2]
        assert np.allclose(found[seg, ts], total.ravel(), rtol=1e-6, atol=1e-9)


def test_a_long_shot_is_many_tasks(spark):
    camera = spark.range(100_000).selectExpr("1L as seg", "id * 40 as ts_ms", "array(1.0D, 0.0D, 0.5D, 0.0D, 1.0D, -0.25D, 0.0D, 0.0D, 1.0D) as h", "true as reliable", "id = 0 as reset")
    last = detections.compose_homographies(camera).agg(F.max_by("total", "ts_ms").alias("t"), F.count("*").alias("n")).first()
    assert last.n == 100_000 and np.allclose([last.t[2], last.t[5]], [50_000, -25_000])


def test_ball_and_clock_over_whole_tables(spark):
    rows = sorted((r for r in detection._balls(spark, DATA).selectExpr("frame div 200 as seg", "frame * 40 as ts_ms", "det_id", "cx", "cy", "confidence", "gain", "near").collect()), key=lambda r: (r.seg, r.ts_ms, r.det_id))
    wanted, before = set(), None
    for (seg, ts), group in itertools.groupby(rows, key=lambda r: (r.seg, r.ts_ms)):
        before = before if before and before[0] == seg else None
        scores = []
        for r in group:
            score, fits = r.confidence + r.gain, r.near
            if before and ts - before[1] <= 1500:
                limit = min(360.0, max(85.0, max(1, ts - before[1]) * 1.1))
                away = math.hypot(r.cx - before[2], r.cy - before[3])
                if away <= limit:
                    score, fits = score + 0.5 * (1 - away / limit), True
            if fits:
                scores.append((score, r))
        if scores:
            best = max(scores, key=lambda s: s[0])[1]
            wanted.add((seg, ts, best.det_id))
            before = (seg, ts, best.cx, best.cy)
    assert {tuple(r) for r in QUERIES["ball_choices"](spark, DATA).collect()} == wanted
    times = {(r.seg, r.frame): r.ts_ms for r in QUERIES["repaired_clock"](spark, DATA).collect()}
    last = None
    for r in fx.frames(spark, DATA).select("seg", "seq", "ts_ms").orderBy("seg", "seq").collect():
        reported = None if r.seq % 7 == 3 else r.ts_ms - 900 if r.seq % 11 == 5 else r.ts_ms
        before = last[1] if last and last[0] == r.seg else None
        now = reported if reported is not None and reported >= 0 and (before is None or reported > before) else round(r.seq * 1000 / 10.0)
        now = now if before is None or now > before else before + 100
        assert times.pop((r.seg, r.seq)) == now
        last = (r.seg, now)
    assert not times
