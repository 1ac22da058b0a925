"""Reviews by their log, assignments, and sheets kept while tracks move."""

import random

from pyspark.sql import functions as F

from sidelines.operators import events, review, stats, tracks
from sidelines.sources import results

EVENT = "event_id long, event_type string, player_id long, outcome string, review_status string, source string"
ACTION = "event_id long, acted_at long, action_id long, action string, event_type string, player_id long, outcome string"


def test_a_correction_outlives_what_follows_it(spark):
    stored = spark.createDataFrame([(i, "pass", 7, "unknown", "pending", "ai") for i in range(6)], EVENT)
    log = [
        (0, 1, 1, "correct", "shot", 9, None), (0, 2, 2, "accept", None, None, None),
        (1, 1, 1, "correct", "shot", 9, None), (1, 1, 2, "correct", None, 8, "failure"), (1, 0, 9, "reject", "goal", 1, "x"),
        (2, 5, 1, "accept", "goal", 3, "x"), (3, 1, 1, "note", "goal", 3, "x"), (4, 1, 1, "correct", "duel", None, None), (4, 2, 1, "reject", None, None, None),
    ]
    found = {r.event_id: tuple(r)[1:] for r in review.apply_reviews(stored, spark.createDataFrame(log, ACTION)).collect()}
    assert found == {
        0: ("shot", 9, "unknown", "validated", "human"), 1: ("shot", 8, "failure", "corrected", "human"), 2: ("pass", 7, "unknown", "validated", "ai"),
        3: ("pass", 7, "unknown", "pending", "ai"), 4: ("duel", 7, "unknown", "rejected", "human"), 5: ("pass", 7, "unknown", "pending", "ai"),
    }


def test_assignment_keeps_the_team_and_tells_how_sure_it_is(spark):
    own = spark.createDataFrame([(1, 1, None, None, 0.4), (1, 2, 10, 5, 0.4), (1, 3, 10, 6, 0.4), (2, 1, 11, None, 0.4)], "seg long, track_id long, team_id long, player_id long, identity_confidence double")
    asked = spark.createDataFrame([(1, 1, 50), (1, 2, None), (1, 3, 60), (2, 1, 70), (2, 9, 50)], "seg long, track_id long, player_id long")
    players = spark.createDataFrame([(50, 10), (60, 11), (70, 12)], "player_id long, team_id long")
    teams = spark.createDataFrame([(s, t) for s in (1, 2) for t in (10, 11)], "seg long, team_id long")
    done, errors = review.assign_tracks(own, asked, players, teams)
    assert {tuple(r) for r in done.collect()} == {(1, 1, None, 50, 1.0), (1, 2, 10, None, 0.0), (1, 3, 10, 6, 0.4), (2, 1, 11, None, 0.4)}
    assert {tuple(r) for r in errors.collect()} == {(1, 3, 60, "team"), (2, 1, 70, "player"), (2, 9, 50, "track")}
    spans = spark.createDataFrame([(1, 1, 3), (1, 2, 5), (1, 3, 6), (1, None, None)], "seg long, player_key long, player_id long")
    rows = review.follow(spans, asked.where("track_id < 3"), ("player",)).collect()
    assert {(r.player_key, r.player_id) for r in rows} == {(1, 50), (2, None), (3, 6), (None, None)}


def test_a_match_without_a_run_keeps_its_events(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, None), (2, 7)], "match_id long, run_id long")
    runs = spark.createDataFrame([(1, 1, 5), (1, 2, 6)], "match_id long, run_id long, created_at long")
    assert sorted(map(str, review.of_latest_run(rows, runs).select("match_id", "run_id").collect())) == sorted(map(str, rows.where("match_id = 2 or run_id = 2").collect()))


def track_table(spark, rng, n):
    rows = [(i, i % 7, i // 6, i % 3, 0, rng.randint(-5, 90_000), *(rng.randint(0, 9) for _ in stats.COUNTERS)) for i in range(n)]
    counters = ", ".join(f"{c} long" for c in stats.COUNTERS)
    return spark.createDataFrame(rows, f"seg long, track_id long, match_id long, run_id long, start_ms long, end_ms long, {counters}")


def test_sheets_kept_over_many_moves_equal_a_recount(spark, tmp_path):
    rng = random.Random(12)
    table, path = track_table(spark, rng, 90).cache(), str(tmp_path / "sheets")
    keys = ["match_id", "run_id", "player_id"]
    owners = {i: rng.choice([None, *range(8)]) for i in range(90)}
    given = lambda: spark.createDataFrame([(i, i % 7, p) for i, p in owners.items()], "seg long, track_id long, player_id long")
    results.merge(stats.player_rollup(table, given()), path, keys, ["match_id", "run_id"])
    for _ in range(3):
        before, moved = given(), rng.sample(range(90), 25)
        owners |= {i: rng.choice([None, *range(8)]) for i in moved}
        changed, gone = stats.move_tracks(spark.read.parquet(path), table, before, given())
        results.merge(changed, path, keys, ["match_id", "run_id"], gone)
        wanted = stats.player_rollup(table, given())
        kept = spark.read.parquet(path).select(wanted.columns)
        assert sorted(map(str, kept.collect())) == sorted(map(str, wanted.collect()))
    assert kept.groupBy("player_id").agg(F.count_distinct("match_id").alias("n")).where("n > 1").count() > 0


def test_heatmaps_take_the_first_points_of_each_match(spark):
    paths = spark.range(12).selectExpr("id as seg", "id % 4 as track_id", "id div 6 as match_id", "0L as run_id", "transform(sequence(1, cast(5 + id as int)), i -> named_struct('ts_ms', cast(i as long), 'x', id * 1.0D)) as points")
    owners = paths.selectExpr("seg", "track_id", "if(seg = 3, null, seg % 2) as player_id")
    found = {(r.match_id, r.player_id): [(p.ts_ms, p.x) for p in r.heatmap] for r in tracks.heatmap(paths, owners, 17).collect()}
    wanted = {}
    for i in range(12):
        if i != 3:
            wanted.setdefault((i // 6, i % 2), []).extend((k, float(i)) for k in range(1, 6 + i))
    assert found == {k: v[:17] for k, v in wanted.items()}


def test_assists_are_marked_in_one_pass(spark):
    rows = spark.range(5).selectExpr("1L as seg", "id * 1000 as ts_ms", "if(id = 4, 'goal', 'pass') as event_type", "'home' as team_key", "if(id = 4, 'p9', 'p1') as player_key", "if(id % 2 = 0, 'p9', null) as recipient_key", "cast(array() as array<string>) as qualifiers")
    found = events.mark_assists(rows)
    assert [r.ts_ms for r in found.where("size(qualifiers) > 0").collect()] == [2000] and found.count() == 5
    assert found._jdf.queryExecution().executedPlan().toString().count("Range (") == 1
