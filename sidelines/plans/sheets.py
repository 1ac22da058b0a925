"""Queries over sheets of teams and players, reports, edits by hand and imports as a whole."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sidelines.functions.columns import clock_ms
from sidelines.operators import clips, clocks, diagnostics, events, ingest, periods, possession, review, signals, stats, tracks
from sidelines.plans import fixtures as fx
from sidelines.plans.detection import OBJECTS, objects
from sidelines.plans.oracles import BASE, RUNS, SAMPLES, SPANS, TRANSFERS
from sidelines.plans.queries import shown
from sidelines.plans.registry import query
from sidelines.plans.review import IMPORTED, REVIEWED, RUN_ROWS, actions, imported, runs, stored
from sidelines.sources import results

BLANK = ["shots", "goals", "duels", "tackles", "interceptions", "fouls", "corners", "offsides", "duels_won", "shots_on_target", "assists", "carries"]


@query(
    RUNS + TRANSFERS + SPANS.removeprefix(SAMPLES) + """,
teams as (select seg, t as team_key from (select distinct seg from samples), (select unnest(['home', 'away', 'third']) as t)),
counts as (select seg, team_key, count(*) filter (event_type = 'pass') as passes, count(*) filter (event_type = 'pass' and qualifiers <> '') as progressive, count(*) filter (event_type = 'loss') as losses, count(*) filter (event_type = 'recovery') as recoveries from transfers group by seg, team_key),
totals as (select seg, sum(case when state in ('controlled', 'contested', 'loose') then end_ms - start_ms end) as in_play, sum(case when state = 'controlled' then end_ms - start_ms end) as held from spans group by seg),
own as (select seg, team_key, sum(end_ms - start_ms) as own from spans where state = 'controlled' group by seg, team_key)
select t.seg, t.team_key, round(in_play / 60000.0::double, 2) as minutes_played, coalesce(round(100 * own / greatest(1, held)::double, 2), 0.0::double) as possession_pct, case when own is null then 0.0::double else round(in_play / 1000.0::double, 1) end as ball_in_play_seconds, coalesce(round(own / 1000.0::double, 1), 0.0::double) as possession_seconds,
  case when passes > 0 then 100.0::double else 0.0::double end as pass_accuracy_pct, coalesce(passes, 0) as passes, coalesce(passes, 0) as passes_completed, coalesce(progressive, 0) as progressive_passes, coalesce(losses, 0) as losses, coalesce(recoveries, 0) as recoveries,
  """ + ", ".join(f"0::bigint as {c}" for c in BLANK) + """
from teams t left join counts using (seg, team_key) left join own using (seg, team_key) left join totals using (seg)"""
)
def team_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = fx.samples(spark, sf_dir)
    teams = samples.select("seg").distinct().withColumn("team_key", F.explode(F.array(*(F.lit(t) for t in ("home", "away", "third")))))
    return stats.team_sheets(teams, events.transfers(events.controlled_runs(samples)), possession.compress(samples))


def track_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of seven tracks per segment, whose events are those of `events`; two segments are one match of two runs."""
    rows = fx.base(spark, sf_dir).selectExpr("seg", "seq % 7 as track_id", "seq * 1000 as ts_ms", "element_at(array('pass', 'carry', 'shot', 'duel', 'loss', 'goal'), cast(k % 6 as int) + 1) as event_type", "if(k % 4 = 0, 'failure', 'success') as outcome", "if(k % 5 = 0, array('progressive_candidate', 'on_target'), array()) as qualifiers")
    spans = rows.groupBy("seg", "track_id").agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"))
    return stats.event_stats(rows, ["seg", "track_id"]).join(spans, ["seg", "track_id"]).withColumn("match_id", F.expr("seg div 2")).withColumn("run_id", F.col("seg") % 2)


def assigned(rows: DataFrame, turn: int) -> DataFrame:
    """Each track's player: those of two neighbouring matches share a few, so that one player has sheets in both."""
    return rows.selectExpr("seg", "track_id", f"if((seg + track_id) % 5 = 4, null, seg div 4 * 10 + (seg + track_id * 2 + if(track_id < 2, {turn}, 0)) % 5) as player_id")


TRACK_STATS = BASE + """,
acts as (select seg, seq % 7 as track_id, seq * 1000 as ts_ms, k % 6 as kind, k % 4 <> 0 as won, k % 5 = 0 as tagged from base),
track_stats as (select seg, seg // 2 as match_id, seg % 2 as run_id, track_id, min(ts_ms) as s, max(ts_ms) as e, count(*) filter (kind = 0) as passes, count(*) filter (kind = 0 and won) as completed, count(*) filter (kind = 0 and tagged) as progressive, count(*) filter (kind = 1) as carries, count(*) filter (kind = 2) as shots, count(*) filter (kind = 2 and tagged) as on_target, count(*) filter (kind = 3) as duels, count(*) filter (kind = 3 and won) as won, count(*) filter (kind = 4) as losses, count(*) filter (kind = 5) as goals from acts group by seg, track_id),
old as (select seg, match_id, run_id, track_id, case when (seg + track_id) % 5 <> 4 then seg // 4 * 10 + (seg + track_id * 2) % 5 end as player_id from track_stats),
new as (select seg, match_id, run_id, track_id, case when (seg + track_id) % 5 <> 4 then seg // 4 * 10 + (seg + track_id * 2 + case when track_id < 2 then 4 else 0 end) % 5 end as player_id from track_stats)"""
SHEET = """match_id, run_id, player_id, sum(passes)::bigint as passes, sum(completed)::bigint as passes_completed, sum(progressive)::bigint as progressive_passes, sum(carries)::bigint as carries, sum(shots)::bigint as shots, sum(on_target)::bigint as shots_on_target, sum(duels)::bigint as duels, sum(won)::bigint as duels_won, sum(losses)::bigint as losses, sum(goals)::bigint as goals,
  round(sum(e - s) / 60000.0::double, 6) as minutes, case when sum(passes) > 0 then round(100.0::double * sum(completed) / sum(passes), 2) else 0.0::double end as pass_accuracy_pct, count(*) as n_tracks"""
SHOWN = ["match_id", "run_id", "player_id", "passes", "passes_completed", "progressive_passes", "carries", "shots", "shots_on_target", "duels", "duels_won", "losses", "goals", "minutes", "pass_accuracy_pct", "n_tracks"]


@query(TRACK_STATS + f" select {SHEET} from track_stats join old using (seg, match_id, run_id, track_id) where player_id is not null group by match_id, run_id, player_id")
def player_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = track_stats(spark, sf_dir)
    return shown(stats.player_rollup(rows, assigned(rows, 0)).select(SHOWN))


@query(TRACK_STATS + f""", touched as (select distinct match_id, run_id, p as player_id from (select match_id, run_id, o.player_id as a, n.player_id as b from old o join new n using (seg, match_id, run_id, track_id) where o.player_id is distinct from n.player_id), lateral (select unnest([a, b]) as p) where p is not null)
select {SHEET}, false as gone from track_stats join new using (seg, match_id, run_id, track_id) join touched using (match_id, run_id, player_id) group by match_id, run_id, player_id
union all select match_id, run_id, player_id, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0.0, 0.0, 0, true from touched anti join new using (match_id, run_id, player_id)""")
def refreshed_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept sheets after tracks moved: moved tracks are subtracted and added, never counted anew."""
    rows = track_stats(spark, sf_dir)
    before = assigned(rows, 0)
    sheets, gone = stats.move_tracks(stats.player_rollup(rows, before), rows, before, assigned(rows, 4))
    return shown(sheets.select(SHOWN).withColumn("gone", F.lit(False)).unionByName(gone.withColumn("gone", F.lit(True)), allowMissingColumns=True).fillna(0))


@query(OBJECTS + """, capped as (select * from (select *, row_number() over (partition by seg, track_id order by ts_ms) as i from objects) where i <= 2000),
owned as (select seg // 2 as match_id, seg % 2 as run_id, seg // 4 * 3 + track_id % 3 as player_id, seg, ts_ms, track_id, coalesce(pitch_x, image_x) as x from capped where (seg + track_id) % 4 <> 0),
listed as (select *, row_number() over (partition by match_id, run_id, player_id order by seg, track_id, ts_ms) as i from owned)
select match_id, run_id, player_id, count(*) as points, round(sum(x), 4) as sum_x, max(ts_ms) as last_ms from listed where i <= 5000 group by match_id, run_id, player_id""")
def player_heatmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = tracks.trajectories(objects(spark, sf_dir)).withColumn("match_id", F.expr("seg div 2")).withColumn("run_id", F.col("seg") % 2)
    owners = paths.where("(seg + track_id) % 4 <> 0").selectExpr("seg", "track_id", "seg div 4 * 3 + track_id % 3 as player_id")
    points = tracks.heatmap(paths, owners).select("match_id", "run_id", "player_id", F.explode("heatmap").alias("p"))
    return points.groupBy("match_id", "run_id", "player_id").agg(F.count("*").alias("points"), F.round(F.sum("p.x"), 4).alias("sum_x"), F.max("p.ts_ms").alias("last_ms"))


@query(OBJECTS + """ select seg, ts_ms, case when role = 'referee' then 'p1-w2-o' || track_id else 'p1-w2-' || track_id end as track_id, case when role <> 'referee' then 'p1-w2-' || track_id end as player_key from objects""")
def qualified_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = objects(spark, sf_dir).withColumn("period", F.lit(1)).withColumn("window_index", F.lit(2))
    return tracks.qualify_ids(rows).select("seg", "ts_ms", "track_id", "player_key")


@query(SPANS + """, ends as (select seg, max(end_ms) - 700 as w_end, min(start_ms) + 40 as p_start from spans group by seg)
select seg, start_ms, least(end_ms, w_end) as end_ms, state, 2700000 + greatest(0, start_ms - p_start) as match_start_ms, 2700000 + greatest(0, least(end_ms, w_end) - p_start) as match_end_ms from spans join ends using (seg)""")
def clipped_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans at the gap of a tracking rate of 2.5 frames a second."""
    rows = fx.samples(spark, sf_dir).withColumn("gap_ms", possession.gap_of(F.lit(2.5)))
    spans = possession.compress(rows, "gap_ms")
    windows = spans.groupBy("seg").agg((F.max("end_ms") - 700).alias("end_ms"), (F.min("start_ms") + 40).alias("period_start_ms")).withColumn("clock_start_ms", F.lit(2_700_000))
    return possession.clip_spans(spans, windows).select("seg", "start_ms", "end_ms", "state", "match_start_ms", "match_end_ms")


@query(BASE + """, chosen as (select seg, seq * 21000 as ts_ms, event_id, k % 5 as kind from base), ends as (select seg, max(ts_ms) + 3000 as d from chosen group by seg),
padded as (select seg, ts_ms, event_id, greatest(0, ts_ms - case kind when 4 then 12000 else 9000 end) as s, least(d, ts_ms + case kind when 4 then 10000 else 7000 end) as e from chosen join ends using (seg) where kind in (1, 4)),
cuts as (select *, case when s <= max(e) over (partition by seg order by ts_ms, event_id rows between unbounded preceding and 1 preceding) + 2000 then 0 else 1 end as new from padded)
select seg, min(s) as start_ms, max(e) as end_ms, count(*) as events from (select *, sum(new) over (partition by seg order by ts_ms, event_id) as clip from cuts) group by seg, clip""")
def goal_and_shot_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.base(spark, sf_dir).selectExpr("seg", "seq * 21000 as ts_ms", "event_id", "element_at(array('pass', 'shot', 'duel', 'aerial_duel', 'goal'), cast(k % 5 as int) + 1) as event_type")
    videos = rows.groupBy("seg").agg((F.max("ts_ms") + 3000).alias("duration_ms"))
    return clips.clip_windows(rows, videos, ["goal", "shot"]).select("seg", "start_ms", "end_ms", F.size("event_ids").cast("long").alias("events"))


@query(BASE + """, acts as (select seg, event_id, seq * 700 as ts_ms, case when k % 8 = 0 then 'goal' when k % 3 = 0 then 'shot' else 'pass' end as event_type, case when k % 2 = 0 then 'home' else 'away' end as team, 'p' || k % 4 as player, 'p' || (k + 2) % 4 as recipient from base),
goals as (select seg, ts_ms as g_ms, team, player from acts where event_type = 'goal'),
latest as (select g.seg, g.g_ms, max_by(a.event_id, a.ts_ms) as event_id from goals g join acts a on a.seg = g.seg and a.team = g.team and a.recipient = g.player and a.event_type = 'pass' and a.ts_ms < g.g_ms and a.ts_ms >= g.g_ms - 12000 group by all)
select event_id, event_type, event_id in (select event_id from latest) as assist from acts""")
def assists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.base(spark, sf_dir).selectExpr("seg", "event_id", "seq * 700 as ts_ms", "case when k % 8 = 0 then 'goal' when k % 3 = 0 then 'shot' else 'pass' end as event_type", "if(k % 2 = 0, 'home', 'away') as team_key", "concat('p', k % 4) as player_key", "if(k % 8 <> 0 and k % 3 <> 0, concat('p', (k + 2) % 4), null) as recipient_key", "cast(array() as array<string>) as qualifiers")
    return events.mark_assists(rows).select("event_id", "event_type", F.array_contains("qualifiers", "assist").alias("assist"))


@query("""
with texts as (select o_orderkey as id, case o_orderkey % 5 when 0 then o_orderkey % 90 || ':' || lpad((o_custkey % 60)::varchar, 2, '0') || '.5' when 1 then o_orderkey % 3 || ':0' || o_orderkey % 7 || ':' || o_custkey % 60 when 2 then ' ' || o_custkey % 1000 || ',25 ' when 3 then 'half ' || o_orderkey else '' end as t,
  case o_orderkey % 5 when 0 then o_orderkey % 90 * 60000 + o_custkey % 60 * 1000 + 500 when 1 then o_orderkey % 3 * 3600000 + o_orderkey % 7 * 60000 + o_custkey % 60 * 1000 when 2 then o_custkey % 1000 * 1000 + 250 end as ms from orders)
select id, coalesce(ms, -1)::bigint as ms from texts""")
def timecodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "case o_orderkey % 5 when 0 then concat(o_orderkey % 90, ':', lpad(o_custkey % 60, 2, '0'), '.5') when 1 then concat(o_orderkey % 3, ':0', o_orderkey % 7, ':', o_custkey % 60) when 2 then concat(' ', o_custkey % 1000, ',25 ') when 3 then concat('half ', o_orderkey) else '' end as t")
    return rows.select("id", F.coalesce(clock_ms(F.col("t")), F.lit(-1)).alias("ms"))


def known_periods(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(known, detected, videos), a match per customer: two confirmed halves, one, none confirmed with the bounds detected, or
    none at all; some recordings end or begin inside the halves, and some have no length."""
    matches = fx.table(spark, sf_dir, "customer").selectExpr("c_custkey as match_id")
    detected = matches.selectExpr("match_id", "stack(2, 1, if(match_id % 5 = 0, -5000L, 600000L), 3300000L, 2, 4200000L, if(match_id % 7 = 0, 7300000L, 6900000L)) as (number, start_ms, end_ms)", "0.7D as confidence")
    first = "match_id", "1 as number", "if(match_id % 4 = 2, 600000L, 630000L) as start_ms", "3300000L as end_ms", "0 as clock_start_ms", "2700000L as clock_end_ms"
    second = "match_id", "2 as number", "if(match_id % 4 = 2, 4200000L, 4260000L) as start_ms", "6900000L as end_ms", "2700000 + match_id % 3 * 1000 as clock_start_ms", "5400000L as clock_end_ms"
    known = matches.where("match_id % 4 <> 3").selectExpr(*first, "match_id % 4 < 2 as confirmed").unionByName(matches.where("match_id % 4 <> 3").selectExpr(*second, "match_id % 4 = 0 as confirmed"))
    known = known.withColumn("source", F.when(F.col("confirmed"), "manual").otherwise("automatic")).withColumn("confidence", F.when(F.col("confirmed"), 1.0).otherwise(0.7))
    return known, detected, matches.selectExpr("match_id", "if(match_id % 11 = 0, null, 7200000L) as duration_ms")


KNOWN = """
with matches as (select c_custkey as m, case when c_custkey % 11 <> 0 then 7200000 end as d from customer),
known as (
  select m, 1 as number, case when m % 4 = 2 then 600000 else 630000 end as s, 3300000 as e, 0 as c, 2700000 as ce, m % 4 < 2 as confirmed from matches where m % 4 <> 3
  union all select m, 2, case when m % 4 = 2 then 4200000 else 4260000 end, 6900000, 2700000 + m % 3 * 1000, 5400000, m % 4 = 0 from matches where m % 4 <> 3),
detected as (select m, d, 1 as number, case when m % 5 = 0 then -5000 else 600000 end as s, 3300000 as e from matches union all select m, d, 2, 4200000, case when m % 7 = 0 then 7300000 else 6900000 end from matches),
ready as (select m from known group by m having count(*) filter (confirmed) = 2),
turns as (select unnest([false, true]) as again),
taken as (
  select again, m, number, s, e, c, ce, 'manual' as source, 1.0::double as confidence, true as confirmed from known join ready using (m) join turns on not again where confirmed
  union all select again, m, number, greatest(0, s), case when d is null then e else least(e, d) end, (number - 1) * 2700000, (number - 1) * 2700000 + e - s, 'automatic', 0.7::double, false from detected, turns where again or m not in (select m from ready))"""


@query(KNOWN + " select again, m as match_id, number, s::bigint as start_ms, e::bigint as end_ms, c::bigint as clock_start_ms, ce::bigint as clock_end_ms, source, confidence, confirmed from taken")
def resolved_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of runs that keep confirmed halves, and of runs that prepare the match again."""
    turns = [periods.resolve_periods(*known_periods(spark, sf_dir), again)[0].withColumn("again", F.lit(again)) for again in (False, True)]
    return turns[0].unionByName(turns[1])


@query(KNOWN + """, pairs as (select again, t.m, count(*) filter (k.s is distinct from t.s or k.e is distinct from t.e) as other, count(k.m) as n from taken t left join known k using (m, number) where not t.confirmed group by all)
select again, m as match_id from pairs where n > 0 and other > 0""")
def moved_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = [periods.resolve_periods(*known_periods(spark, sf_dir), again)[1].withColumn("again", F.lit(again)) for again in (False, True)]
    return turns[0].unionByName(turns[1])


def edited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """(periods, edits, videos, runs): every other match has an edit of both halves, and some of the first alone. Edits break
    each rule on purpose."""
    known, _, videos = known_periods(spark, sf_dir)
    matches = videos.select("match_id")
    first = matches.where("match_id % 2 = 0 or match_id % 6 = 3").selectExpr("match_id", "1 as number", "concat(match_id % 12, ':00') as start", "if(match_id % 10 = 0, '1:20:00', '55:30') as end", "if(match_id % 4 = 2, null, '0') as clock_start")
    second = matches.where("match_id % 2 = 0").selectExpr("match_id", "2 as number", "if(match_id % 9 = 0, 'later', '1:11:00') as start", "if(match_id % 14 = 0, '9:00:00', '1:55:00') as end", "case when match_id % 22 = 0 then '0' when match_id % 8 = 0 then null else '45:00' end as clock_start")
    return known, first.unionByName(second), videos, runs(spark, sf_dir)


EDITED = KNOWN + """,
posted as (
  select m, d, m % 12 * 60000 as s1, case when m % 10 = 0 then 4800000 else 3330000 end as e1, 0 as c1, case when m % 2 = 0 and m % 9 <> 0 then 4260000 end as s2,
    case when m % 2 = 0 then case when m % 14 = 0 then 32400000 else 6900000 end end as e2, case when m % 2 = 0 then case when m % 22 = 0 then 0 else 2700000 end end as c2
  from matches where m % 2 = 0 or m % 6 = 3),
judged as (select *, case when s2 is null or e2 is null or c2 is null then 'timecode' when not (s1 < e1 and e1 <= s2 and s2 < e2) then 'order' when c2 <= c1 then 'clock' when d > 0 and e2 > d then 'duration' end as rule from posted),
good as (select m, 1 as number, s1 as s, e1 as e, c1 as c from judged where rule is null union all select m, 2, s2, e2, c2 from judged where rule is null)"""


@query(EDITED + """ select m as match_id, number, s::bigint as start_ms, e::bigint as end_ms, c::bigint as clock_start_ms, (c + e - s)::bigint as clock_end_ms, 'manual' as source, 1.0::double as confidence, true as confirmed from good
union all select m, number, s, e, c, ce, case when confirmed then 'manual' else 'automatic' end, case when confirmed then 1.0::double else 0.7::double end, confirmed from known where m not in (select m from good)""")
def edited_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.apply_period_edits(*edited(spark, sf_dir))[0]


@query(EDITED + " select m as match_id, rule from judged where rule is not null")
def period_edit_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.apply_period_edits(*edited(spark, sf_dir))[1]


@query(EDITED + ", moved as (select distinct g.m from good g left join known k using (m, number) where k.s is distinct from g.s or k.e is distinct from g.e)" + RUN_ROWS.replace("\nwith runs", ",\nruns") + " select run_id from runs where mode = 'sample' and match_id in (select m from moved)")
def stale_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.apply_period_edits(*edited(spark, sf_dir))[2].where("stale and not approved").select("run_id")


@query("""
with heads as (select o_orderkey as m, case o_orderkey % 3 when 0 then 'tracks/1' when 1 then 'tracks/2' end as schema, case o_orderkey % 4 when 0 then 'other' when 1 then 'external' else 'tracker' end as engine from orders)
select m as match_id, case when schema is distinct from 'tracks/1' then 'schema' else 'engine' end as rule from heads where schema is distinct from 'tracks/1' or engine = 'other'""")
def header_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey as match_id", "case o_orderkey % 3 when 0 then 'tracks/1' when 1 then 'tracks/2' end as schema", "case o_orderkey % 4 when 0 then 'other' when 1 then 'external' else 'tracker' end as engine")
    return ingest.header_errors(heads, "tracks/1", "tracker")


FRAMES = IMPORTED + ", frames as (select distinct match_id, ts from lines where frame_rule is null)"


@query(FRAMES + " select match_id, ts as ts_ms, 1920::bigint as width, 1080::bigint as height, 1.0::double as field_score, false as scene_cut, 0.0::double as replay_probability, 'image_pixels+pitch_meters' as coordinate_space, 'external' as engine from frames")
def imported_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imported(spark, sf_dir)[0]


@query(FRAMES + " select match_id, 'external' as engine, 'r1' as revision, count(*) as frames, min(ts) as first_ms, max(ts) as last_ms, 40 as tolerance_ms from frames group by match_id")
def import_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = imported(spark, sf_dir)[0]
    meta = frames.select("match_id", "engine").distinct().withColumn("revision", F.lit("r1"))
    return ingest.import_audit(frames, meta, 40)


@query(IMPORTED + """ select match_id, ts as ts_ms, role, p % 1900 + 0.0::double as x1, 90.0::double + l_quantity as y2, round(case when p % 11 <= 1 then 1.0::double else 1.0::double - l_discount end, 6) as confidence from objects where rule is null""")
def imported_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw list of detections that each frame carries, one row for each."""
    listed = ingest.frame_counts(imported(spark, sf_dir)[1]).select("match_id", "ts_ms", F.explode("detections").alias("d"))
    return shown(listed.select("match_id", "ts_ms", "d.role", F.col("d.bbox")[0].alias("x1"), F.col("d.bbox")[3].alias("y2"), "d.confidence"))


@query(BASE + """, feats as (select event_id, (k % 60) / 100.0::double as g, (k % 50) / 125.0::double > 0.32::double as cut from base), each as (select *, least(1.0::double, g * 1.6::double) as fs from feats)
select event_id, p as provider, round(fs, 6) as field_score, case when cut and p = 'heuristic' and g < 0.12::double then 0.7::double when cut and p = 'detector' and fs < 0.2::double then 0.72::double else 0.0::double end as replay_probability from each, (select unnest(['heuristic', 'detector']) as p)""")
def provider_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.base(spark, sf_dir).selectExpr("event_id", "(k % 60) / 100.0D as green_ratio", "(k % 50) / 125.0D as motion_score")
    each = [signals.derive_signals(rows, provider=p).withColumn("provider", F.lit(p)) for p in ("heuristic", "detector")]
    return shown(each[0].unionByName(each[1]).select("event_id", "provider", "field_score", "replay_probability"))


@query(BASE + """, sums as (select user_id as run_id, count(*) as frames, count(*) filter (k % 13 = 0) as missing from base group by user_id)
select run_id, missing as missing_frames, case when missing > 0.05::double * frames then 'fail' when run_id % 2 = 0 then 'pass' else 'warning' end as verdict,
  case when missing > 0.05::double * frames then 'external_coverage' || case when run_id % 2 = 0 then '' else '|few_known_teams' end else case when run_id % 2 = 0 then '' else 'few_known_teams' end end as issues from sums""")
def coverage_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.base(spark, sf_dir).selectExpr("user_id as run_id", "k % 13 = 0 as missing")
    found = rows.select("run_id").distinct().selectExpr("run_id", "if(run_id % 2 = 0, 'pass', 'warning') as verdict", "if(run_id % 2 = 0, cast(array() as array<string>), array('few_known_teams')) as issues")
    return shown(diagnostics.gate_coverage(found, clocks.coverage(rows, "run_id")).select("run_id", "missing_frames", "verdict", "issues"))


@query(OBJECTS + """, ranked as (select *, row_number() over (partition by seg order by team_key nulls first, shirt_number nulls first, track_id, ts_ms) as place from objects)
select seg, track_id, ts_ms, place::int as place from ranked where place <= 300""")
def listed_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page's first 300, here of every observation as a track of its own."""
    rows = objects(spark, sf_dir).withColumn("own", F.col("track_id")).withColumn("track_id", F.struct("track_id", "ts_ms"))
    return review.listed_tracks(rows).select("seg", F.col("own").alias("track_id"), "ts_ms", "place")


@query(RUN_ROWS + " select status, count(*) as matches from newest where place = 1 group by status")
def status_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.status_totals(review.latest_runs(runs(spark, sf_dir)))


@query("select l_orderkey as id, l_linenumber as line, round(case when l_partkey % 5 <> 0 then least(greatest(0.5::double, l_quantity / 4.0::double, 6.0::double), (l_partkey % 5) * 12.5::double) else greatest(0.5::double, l_quantity / 4.0::double, 6.0::double) end, 3) as fps from lineitem")
def tracking_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "lineitem")
    native = F.when(F.col("l_partkey") % 5 != 0, (F.col("l_partkey") % 5) * 12.5)
    return rows.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), clocks.effective_fps(F.col("l_quantity") / 4.0, native, 6.0).alias("fps"))


@query(REVIEWED + """, made as (select match_id, max(run_id) as run_id from reviewed group by match_id), kept as (select r.* from reviewed r join made using (match_id, run_id) where review_status <> 'rejected')
select match_id, (select count(*) from kept k where k.match_id = m.match_id) as events, 2::bigint as periods, (select count(distinct team_key) from reviewed r where r.match_id = m.match_id) as teams from made m""")
def match_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the JSON document of each match holds, read back from it."""
    size = lambda part: F.coalesce(F.json_array_length(F.get_json_object("report", f"$.{part}")), F.lit(0)).cast("long")
    return reports(spark, sf_dir).select("match_id", size("events").alias("events"), size("periods").alias("periods"), size("team_stats").alias("teams"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review.apply_reviews(stored(spark, sf_dir), actions(spark, sf_dir))
    matches = rows.select("match_id").distinct()
    halves = matches.selectExpr("match_id", "stack(2, 1, 0L, 2, 2700000L) as (number, start_ms)")
    teams = rows.groupBy("match_id", F.col("team_key").alias("team_id")).agg(F.count("*").alias("events"))
    players = rows.groupBy("match_id", "player_id").agg(F.count("*").alias("events"))
    made = rows.select("match_id", "run_id").distinct().withColumn("created_at", F.col("run_id"))
    return results.match_report(matches, halves, teams, players, rows, made)


@query(REVIEWED + """, made as (select match_id, max(run_id) as run_id from reviewed group by match_id)
select match_id, (row_number() over (partition by match_id order by ts_ms, event_id) - 1)::int as place, event_id, ts_ms, event_type, team_key, player_id, outcome, review_status, source, round(confidence, 6) as confidence from reviewed join made using (match_id, run_id) where review_status <> 'rejected'""")
def reported_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each match's document, value by value and in its order."""
    event = "event_id long, ts_ms long, event_type string, team_key string, player_id long, outcome string, review_status string, source string, confidence double"
    listed = F.from_json(F.get_json_object("report", "$.events"), f"array<struct<{event.replace(' ', ':').replace(',:', ',')}>>")
    return shown(reports(spark, sf_dir).select("match_id", F.posexplode(listed).alias("place", "e")).select("match_id", "place", "e.*"))


@query(REVIEWED + """, sums as (select match_id, 'player' as kind, player_id::varchar as key, count(*) as events from reviewed group by all union all select match_id, 'team', team_key, count(*) from reviewed group by all)
select match_id, kind, key, events from sums union all select distinct match_id, 'period', n::varchar, (n - 1) * 2700000 from reviewed, (select unnest([1, 2]) as n)""")
def reported_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheets and periods of each match's document."""
    rows, found = reports(spark, sf_dir), None
    for part, kind, key, value in (("player_stats", "player", "player_id", "events"), ("team_stats", "team", "team_id", "events"), ("periods", "period", "number", "start_ms")):
        listed = F.from_json(F.get_json_object("report", f"$.{part}"), f"array<struct<{key}:string,{value}:long>>")
        each = rows.select("match_id", F.explode(listed).alias("x")).select("match_id", F.lit(kind).alias("kind"), F.col(f"x.{key}").alias("key"), F.col(f"x.{value}").alias("events"))
        found = each if found is None else found.unionByName(each)
    return found


@query(RUN_ROWS + """, lines as (select l_orderkey as run_id, count(*) as n, sum(l_quantity) as q from lineitem group by 1)
select r.run_id, r.mode as analysis_mode, r.grade, coalesce(n, 0) as tracks, 0::bigint as spans, coalesce(n, 0) as windows, 'sheets/1' as schema from runs r left join lines using (run_id)""")
def run_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the JSON document of each run holds, read back from it."""
    rows = runs(spark, sf_dir)
    lines = fx.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as run_id", "l_linenumber as window_index", "l_quantity as length")
    parts = {"quality": rows.select("run_id", "grade", F.lit(61.5).alias("score")), "backend": rows.select("run_id", "backend"), "windows": lines}
    found = results.run_report(rows, parts, {"tracks": lines, "possession_spans": lines.where("length < 0")}, "sheets/1")
    at = lambda path: F.get_json_object("report", f"$.{path}")
    return found.select("run_id", at("analysis_mode").alias("analysis_mode"), at("quality.grade").alias("grade"), at("counts.tracks").cast("long").alias("tracks"), at("counts.possession_spans").cast("long").alias("spans"), F.coalesce(F.json_array_length(at("windows")), F.lit(0)).cast("long").alias("windows"), at("schema").alias("schema"))
