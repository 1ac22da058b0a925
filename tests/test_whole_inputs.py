"""Queries that leave nothing of their tables out."""

from pyspark.sql import functions as F

from sidelines.plans import detection, review
from sidelines.plans import fixtures as fx
from sidelines.plans.catalog import QUERIES

DATA = "/root/testdata/sf0.01"


def test_paths_hold_every_point(spark):
    points = QUERIES["track_paths"](spark, DATA).agg(F.sum("points")).first()[0]
    assert points == detection.objects(spark, DATA).count()


def test_timelines_hold_every_event(spark):
    assert QUERIES["event_timeline"](spark, DATA).count() == review.stored(spark, DATA).where("team_key = 'home'").count()


def test_clips_hold_every_event(spark):
    events = fx.base(spark, DATA).count()
    plan = QUERIES["clip_plan"](spark, DATA).collect()
    assert sum(len(r.events.split(",")) for r in plan) == events and 1000 < len(plan) < events
    assert QUERIES["clip_links"](spark, DATA).select("event_id").distinct().count() == events


def test_every_track_is_counted(spark):
    rows = QUERIES["assigned_tracks"](spark, DATA).collect()
    assert len(rows) == fx.base(spark, DATA).count()
    expected = {}
    for r in rows:
        expected[r.seg] = expected.get(r.seg, 0) + (r.player_id == -1)
    assert {r.seg: r.unassigned for r in QUERIES["unassigned_tracks"](spark, DATA).collect()} == expected
