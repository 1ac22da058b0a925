"""Rules on small hand-made sequences."""

from sidelines.functions.columns import clock_ms
from sidelines.operators import clips, events, possession, stats

SAMPLE = "seg int, ts_ms long, state string, team_key string, player_key string, ball_x double, ball_y double, confidence double, contenders array<struct<team_key: string, player_key: string>>"


def samples(spark, *rows):
    return spark.createDataFrame([(1, *r, *([None] * (8 - len(r)))) for r in rows], SAMPLE)


def held(ts, player, team="home", x=0.5, y=0.5):
    return (ts, "controlled", team, player, x, y, 0.9)


def kinds(df):
    return sorted(r.event_type for r in df.collect())


def test_pass(spark):
    found = events.detect_events(samples(spark, held(0, "p1"), held(500, "p1"), held(900, "p2"), held(1400, "p2"))).collect()
    assert [(r.event_type, r.player_key, r.recipient_key) for r in found] == [("pass", "p1", "p2")]


def test_loss_and_recovery(spark):
    assert kinds(events.detect_events(samples(spark, held(0, "p1"), held(500, "p2", "away")))) == ["loss", "recovery"]


def test_duel_and_dribble(spark):
    contenders = [("home", "p1"), ("away", "p2")]
    assert kinds(events.duels(samples(spark, held(0, "p1"), (300, "contested", None, None, 0.5, 0.5, 0.58, contenders), held(700, "p1")))) == ["dribble", "duel"]


def test_shot(spark):
    found = events.shots(samples(spark, held(0, "p9", x=0.70, y=0.45), held(400, "p9", x=0.78, y=0.46), (800, "loose", None, None, 0.91, 0.47, 0.5))).collect()
    assert len(found) == 1 and found[0].confidence < 0.92


def test_duplicates_go_from_a_sorted_stream(spark):
    columns = "seg long, ts_ms long, emit_ord int, event_type string, team_key string, player_key string, recipient_key string, outcome string, start_x double, start_y double, end_x double, end_y double, confidence double, qualifiers array<string>"
    every = [(i % 2, i * 37, i, ("pass", "carry")[i // 3 % 2], "home", (None, "p1", "p2")[i % 3], None, "x", 0.1, 0.2, None, None, i * 7 % 11 / 10, ["a"]) for i in range(6000)]
    expected = []
    for seg in (0, 1):
        kept = []
        for e in (e for e in every if e[0] == seg):
            hit = next((i for i in range(len(kept) - 1, max(-1, len(kept) - 7), -1) if kept[i][3] == e[3] and kept[i][5] == e[5] and e[1] - kept[i][1] <= 400), None)
            if hit is None:
                kept.append(e)
            elif e[12] > kept[hit][12]:
                kept[hit] = e
        expected += kept
    found = events.deduplicate(spark.createDataFrame(every, columns).repartition(3))
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, expected)) and len(expected) < 6000
    assert "collect_list" not in found._jdf.queryExecution().toString()


def test_assist_goes_to_latest_pass(spark):
    columns = "seg int, ts_ms long, event_type string, team_key string, player_key string, recipient_key string, qualifiers array<string>"
    rows = [(1, 0, "pass", "home", "p1", "p9", []), (1, 5000, "pass", "home", "p2", "p9", []), (1, 9000, "goal", "home", "p9", None, [])]
    assert [r.ts_ms for r in events.mark_assists(spark.createDataFrame(rows, columns)).where("array_contains(qualifiers, 'assist')").collect()] == [5000]


FRAME = "seg int, ts_ms long, field_score double, scene_cut boolean, replay_probability double, ball_x double, ball_y double"
ATHLETE = "seg int, ts_ms long, obj_ord int, team_key string, player_key string, confidence double, x double, y double"


def test_nearest_controls_and_contest(spark):
    frames = spark.createDataFrame([(1, 0, 0.8, False, 0.0, 0.5, 0.5), (1, 100, 0.8, False, 0.0, 0.5, 0.5), (1, 200, 0.05, False, 0.0, 0.5, 0.5), (1, 300, 0.8, False, 0.0, None, None)], FRAME)
    athletes = spark.createDataFrame([(1, 0, 0, "home", "p1", 0.9, 0.515, 0.5), (1, 100, 0, "home", "p1", 0.9, 0.51, 0.5), (1, 100, 1, "away", "p2", 0.9, 0.512, 0.5)], ATHLETE)
    found = possession.possession(frames, athletes).orderBy("ts_ms").collect()
    assert [(r.state, r.player_key) for r in found] == [("controlled", "p1"), ("contested", None), ("unknown", None), ("controlled", "p1")]
    assert len(found[1].contenders) == 2


def test_ball_past_the_lines_is_out(spark):
    places = [(52.0, 30.0), (53.0, 30.0), (105.5, 68.5), (106.0, 30.0), (50.0, -0.6), (None, None), (-0.5, -0.5)]
    frames = spark.createDataFrame([(1, 200 * i, 0.8, False, 0.0, *xy) for i, xy in enumerate(places)], FRAME)
    athletes = spark.createDataFrame([(1, 200 * i, 0, "home", "p1", 0.9, x + 1.0 if i < 2 else x, y) for i, (x, y) in enumerate(places) if x is not None], ATHLETE)
    found = possession.possession(frames, athletes, pitch=True).orderBy("ts_ms").collect()
    assert [r.state for r in found] == ["controlled", "controlled", "controlled", "out", "out", "controlled", "controlled"]
    assert [(r.player_key, r.confidence, r.reason, r.ball_x) for r in found[3:5]] == [(None, 0.76, "pitch_boundary", 106.0), (None, 0.76, "pitch_boundary", 50.0)]
    assert kinds(events.outs(possession.possession(frames, athletes, pitch=True))) == ["out"]
    assert {r.state for r in possession.possession(frames, athletes).collect()} <= {"controlled", "loose"}


def test_shares(spark):
    spans = spark.createDataFrame([(1, 0, 6000, "controlled", "home"), (1, 6000, 10000, "controlled", "away")], "seg int, start_ms long, end_ms long, state string, team_key string")
    assert {r.team_key: r.possession_pct for r in possession.possession_stats(spans).collect()} == {"home": 60.0, "away": 40.0}
    passes = spark.createDataFrame([("home", "pass", "success", []), ("home", "pass", "failure", [])], "team_key string, event_type string, outcome string, qualifiers array<string>")
    assert stats.event_stats(passes, ["team_key"]).first().pass_accuracy_pct == 50.0


def test_clip_label_leaves_out_contained_type(spark):
    found = spark.createDataFrame([(1, 10_000, 1, "aerial_duel"), (1, 12_000, 2, "duel"), (1, 60_000, 3, "shot")], "seg int, ts_ms long, event_id long, event_type string")
    plan = clips.clip_windows(found, spark.createDataFrame([(1, 61_000)], "seg int, duration_ms long")).orderBy("start_ms").collect()
    assert [(r.start_ms, r.end_ms, r.label) for r in plan] == [(5000, 17_000, "aerial_duel"), (51_000, 61_000, "shot")]


def test_timecodes(spark):
    rows = spark.createDataFrame([("12:34.500",), ("01:02:03",), ("90.5",), ("not-a-clock",)], "t string")
    assert [r[0] for r in rows.select(clock_ms(rows.t)).collect()] == [754_500, 3_723_000, 90_500, None]
