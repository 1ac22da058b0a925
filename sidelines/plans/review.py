"""Queries over imports, diagnostics, runs and reviews. Orders stand for runs and actions, order lines for imported objects."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sidelines.operators import clips, diagnostics, events, ingest, possession, review
from sidelines.plans import fixtures as fx
from sidelines.plans.oracles import BASE, CARRIES, RUNS, SPANS
from sidelines.plans.queries import shown
from sidelines.plans.registry import query
from sidelines.sources import results, tracking


def imported(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frames, objects, errors) of orders as imported frames with their lines as objects; some break a rule on purpose."""
    one = F.struct(
        F.expr("element_at(array('Player', ' goalkeeper', 'referee', 'ball'), cast(l_partkey % 4 as int) + 1)").alias("role"), F.expr("if(l_partkey % 37 = 0, ' ', cast(l_suppkey as string))").alias("track_id"), F.lit(None).cast("string").alias("team_key"),
        F.expr("element_at(array('0', 'B', 'left', 'HOME', 'x'), cast(l_partkey % 5 as int) + 1)").alias("team_cluster"), F.lit(None).cast("string").alias("team"), F.expr("cast(l_partkey % 130 as string)").alias("shirt_number"), F.lit(None).cast("string").alias("jersey_number"),
        F.expr("case when l_partkey % 11 = 0 then 'high' when l_partkey % 11 = 1 then '-2' else cast(1.0D - l_discount as string) end").alias("confidence"),
        F.expr("case l_partkey % 3 when 0 then concat('{\"x\":', l_suppkey, ',\"y\":', l_linenumber, '}') when 1 then concat('[', l_suppkey, ',', l_linenumber, ']') else 'none' end").alias("pitch_xy"), F.lit(None).cast("string").alias("bbox_pitch"),
        F.expr("if(l_partkey % 2 = 0, array(cast(l_partkey % 1900 as double), 10.0D, l_partkey % 1900 + 40.0D, 90.0D + l_quantity), null)").alias("bbox_xyxy"),
        F.expr("case when l_partkey % 41 = 1 then array(1.0D, 2.0D) else array(cast(l_partkey % 1900 as double), 10.0D, 40.0D, 80.0D + l_quantity) end").alias("bbox_ltwh"),
    )
    lines = fx.table(spark, sf_dir, "lineitem").withColumn("match_id", F.expr("concat('m', l_orderkey div 16)"))
    meta = lines.select("match_id").distinct().selectExpr("match_id", "'external' as engine", "1000.0D as fps")
    # A match's lines are shuffled once, to where its frames are made and checked.
    lines = lines.select("match_id", "l_orderkey", one.alias("o")).repartition("match_id").groupBy("match_id", "l_orderkey").agg(F.collect_list("o").alias("objects"))
    raw = lines.selectExpr(
        "match_id", "if(l_orderkey % 2 = 0, cast(l_orderkey as double), null) as timestamp_ms", "if(l_orderkey % 29 = 3, null, cast(if(l_orderkey % 37 = 5, l_orderkey - 1, l_orderkey) as double)) as frame_index", "if((l_orderkey div 16) % 31 = 7, 0L, 1920L) as width", "1080L as height",
        "cast(null as double) as field_score", "cast(null as boolean) as scene_cut", "cast(null as double) as replay_probability", "cast(null as string) as coordinate_space", "objects",
    )
    return ingest.validate_frames(raw, meta, meta.selectExpr("match_id", "if(cast(substring(match_id, 2) as long) % 2 = 0, 'A', 'B') as home_cluster"))


IMPORTED = """
with every_line as (select l_orderkey as o, 'm' || l_orderkey // 16 as match_id, l_orderkey // 16 % 2 = 0 as swapped, case when l_orderkey % 2 = 1 and l_orderkey % 37 = 5 then l_orderkey - 1 else l_orderkey end as ts,
  case when l_orderkey % 2 = 1 and l_orderkey % 29 = 3 then 'timestamp_missing' when l_orderkey // 16 % 31 = 7 then 'out_of_range' end as frame_rule, l_partkey as p, l_suppkey, l_linenumber, l_quantity, l_discount from lineitem),
twice as (select match_id, ts from every_line where frame_rule is null group by all having count(distinct o) > 1),
lines as (select e.* exclude (frame_rule), coalesce(frame_rule, case when t.ts is not null then 'duplicate_timestamp' end) as frame_rule from every_line e left join twice t on t.match_id = e.match_id and t.ts = e.ts),
objects as (select *, trim(['player', ' goalkeeper', 'referee', 'ball'][p % 4 + 1]) as role, case when p % 37 = 0 or l_suppkey = 0 then 'track_id' when p % 2 = 1 and p % 41 = 1 then 'box_shape' when p % 1900 + 40 > 1920 then 'box_range' end as rule from lines where frame_rule is null and p % 4 <> 3)"""


@query(IMPORTED + """, every as (select match_id, frame_rule as rule from (select distinct o, match_id, frame_rule from lines where frame_rule is not null and frame_rule <> 'duplicate_timestamp') union all select match_id, 'duplicate_timestamp' from twice
  union all select match_id, rule from objects where rule is not null union all select match_id, 'no_frames' from lines group by match_id having count(*) filter (frame_rule is null) = 0)
select match_id, rule, count(*) as errors from every group by match_id, rule""")
def import_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imported(spark, sf_dir)[2].groupBy("match_id", "rule").agg(F.count("*").alias("errors"))


@query(IMPORTED + """ select match_id, ts as ts_ms, 'gsr-' || l_suppkey as track_id, role, round(case when p % 11 <= 1 then 1.0::double else 1.0::double - l_discount end, 6) as confidence,
  case p % 5 when 0 then case when swapped then 'home' else 'away' end when 1 then case when swapped then 'away' else 'home' end when 2 then case when swapped then 'home' else 'away' end when 3 then 'home' end as team_key,
  case when p % 130 <= 99 then p % 130 else -1 end::int as shirt_number, round((p % 1900 + 20) / 1920.0::double, 9) as image_x, round((90 + l_quantity) / 1080.0::double, 9) as image_y,
  case when p % 3 < 2 then l_suppkey::double end as pitch_x, case when p % 3 < 2 then l_linenumber::double end as pitch_y from objects where rule is null""")
def imported_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = imported(spark, sf_dir)[1].drop("obj_ord", "x1", "y1", "x2", "y2")
    return shown(rows.fillna(-1, ["shirt_number"]), 9)


@query(IMPORTED + """ select match_id, count(distinct ts) as frames, count(distinct l_suppkey) as tracks, min(ts) as first_ms, max(ts) as last_ms, count(*) filter (role = 'player') as players, count(*) filter (role = 'goalkeeper') as goalkeepers, count(*) filter (role = 'referee') as referees
from objects where rule is null group by match_id""")
def import_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.import_summary(imported(spark, sf_dir)[1])


@query(IMPORTED + """ select match_id, ts as ts_ms, count(*) filter (role <> 'referee') as athletes, count(*) filter (role = 'referee') as referees from objects where rule is null group by all""")
def import_frame_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.frame_counts(imported(spark, sf_dir)[1]).drop("detections")


@query("""
with rows as (select trim(case when c_custkey % 19 = 0 then '  ' else c_name end) as name, case c_custkey % 7 when 0 then '' when 1 then 'x' || c_custkey else ' ' || c_custkey % 100 end as shirt, case c_custkey % 4 when 0 then 'gk' when 1 then 'ST ' when 2 then 'sweeper' end as place, c_custkey from customer)
select c_custkey as player_id, name, case when shirt = '' then -1 else trim(shirt)::int end as shirt_number, case c_custkey % 4 when 0 then 'GK' when 1 then 'ST' else 'OTHER' end as position from rows where name <> '' and c_custkey % 7 <> 1""")
def roster_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "customer").selectExpr("c_custkey as player_id", "if(c_custkey % 19 = 0, '  ', c_name) as name", "case c_custkey % 7 when 0 then '' when 1 then concat('x', c_custkey) else concat(' ', c_custkey % 100) end as shirt_number", "case c_custkey % 4 when 0 then 'gk' when 1 then 'ST ' when 2 then 'sweeper' end as position")
    return tracking.check_roster(rows)[0].fillna(-1, ["shirt_number"])


@query(BASE + """, sums as (select user_id as run_id, count(*) as frames, sum(k % 25) as raw, sum(k % 25 - least(k % 25, k % 4)) as tracked, count(*) filter (k % 17 <> 0) as ball, count(*) filter (k % 9 <> 0) as live, count(*) filter (k % 5 <= 2) as playable, count(*) filter (k % 3 = 0) as home, count(*) filter (k % 3 = 1) * (user_id % 3) as away, count(distinct k) as tracks, count(*) * 125 * (1 + user_id % 4) as ms from base group by user_id),
d as (select run_id, frames, round(ms / 1000.0::double, 1) as duration_seconds, round(raw / frames::double, 2) as average_athletes_per_frame, round(tracked / frames::double, 2) as average_tracked_athletes_per_frame, round(100.0::double * tracked / greatest(raw, 1), 2) as tracker_retention_pct, round(100.0::double * ball / frames, 2) as ball_visibility_pct, round(100.0::double * live / frames, 2) as field_live_pct, round(100.0::double * playable / frames, 2) as playable_candidate_pct, tracks, round(tracks / greatest(ms / 60000.0::double, 1 / 60.0::double), 2) as tracks_per_minute,
  round(100.0::double * home / greatest(home + away, 1), 2) as home_team_share_pct, round(100.0::double * away / greatest(home + away, 1), 2) as away_team_share_pct, home + away as known_team_observations from sums),
j as (select *, list_filter([case when frames < 50 then 'few_frames' end, case when average_athletes_per_frame < 6 then 'few_detections' when average_tracked_athletes_per_frame < 6 then 'few_tracked' end, case when ball_visibility_pct < 10 then 'ball_rarely_visible' end, case when playable_candidate_pct < 10 then 'little_play' end,
  case when known_team_observations >= greatest(50, frames) and least(home_team_share_pct, away_team_share_pct) < 15 then 'unbalanced_teams' end, case when tracks_per_minute > 80 then 'fragmented_tracks' end], lambda x: x is not null) as f,
  list_filter([case when known_team_observations < greatest(50, frames) then 'few_known_teams' end, case when tracks_per_minute > 50 and tracks_per_minute <= 80 then 'fragile_tracks' end], lambda x: x is not null) as w from d)
select * exclude (f, w), case when len(f) > 0 then 'fail' when len(w) > 0 then 'warning' else 'pass' end as verdict, array_to_string(list_concat(f, w), '|') as issues from j""")
def run_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.base(spark, sf_dir).withColumnRenamed("user_id", "run_id")
    frames = rows.selectExpr("run_id", "k % 25 as raw_athletes", "k % 25 - least(k % 25, k % 4) as athletes", "k % 17 <> 0 as ball_visible", "k % 9 <> 0 as live", "element_at(array('controlled', 'contested', 'loose', 'out', 'unknown'), cast(k % 5 as int) + 1) as state")
    teams = rows.groupBy("run_id").agg(F.count_if(F.expr("k % 3 = 0")).alias("home"), F.count_if(F.expr("k % 3 = 1")).alias("one"), F.count_if(F.expr("k % 3 = 2")).alias("unknown")).selectExpr("run_id", "home", "one * (run_id % 3) as away", "unknown")
    found = rows.groupBy("run_id").agg(F.count_distinct("k").alias("tracks"))
    windows = rows.groupBy("run_id").agg(F.count("*").alias("n")).selectExpr("run_id", "n * 125 * (1 + run_id % 4) as duration_ms")
    return shown(diagnostics.run_diagnostics(frames, teams, found, windows))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "orders").selectExpr(
        "o_custkey as match_id", "o_orderkey as run_id", "o_orderdate as created_at", "element_at(array('sample', 'full', 'prepare'), cast(o_orderkey % 3 as int) + 1) as mode", "case when o_orderkey % 17 = 0 then 'running' when o_orderstatus = 'F' then 'failed' when o_orderstatus = 'O' then 'review' else 'completed' end as status",
        "if(substring(o_orderpriority, 1, 1) < '3', 'pass', 'fail') as verdict", "if(o_orderkey % 5 = 0, null, o_orderkey % 5 = 1) as approved", "if(o_orderkey % 7 = 0, null, o_orderkey % 7 = 1) as stale",
        "if(o_orderkey % 2 = 0, 'yolo', 'heuristic') as backend", "element_at(array('A', 'B', 'C', 'reject'), cast(o_orderkey % 4 as int) + 1) as grade",
    )


RUN_ROWS = """
with runs as (select o_custkey as match_id, o_orderkey as run_id, o_orderdate as created_at, ['sample', 'full', 'prepare'][o_orderkey % 3 + 1] as mode, case when o_orderkey % 17 = 0 then 'running' when o_orderstatus = 'F' then 'failed' when o_orderstatus = 'O' then 'review' else 'completed' end as status,
  case when o_orderpriority[1] < '3' then 'pass' else 'fail' end as verdict, case when o_orderkey % 5 <> 0 then o_orderkey % 5 = 1 else false end as approved, case when o_orderkey % 7 <> 0 then o_orderkey % 7 = 1 else false end as stale, case when o_orderkey % 2 = 0 then 'yolo' else 'heuristic' end as backend, ['A', 'B', 'C', 'reject'][o_orderkey % 4 + 1] as grade from orders),
newest as (select *, row_number() over (partition by match_id order by created_at desc, run_id desc) as place from runs),
passing as (select * from (select *, row_number() over (partition by match_id order by place) as rn from newest where place <= 25 and mode = 'sample' and status in ('review', 'completed') and (verdict = 'pass' or approved) and not stale) where rn = 1)"""


@query(RUN_ROWS + " select match_id, run_id, mode, status from newest where place = 1")
def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.latest_runs(runs(spark, sf_dir)).select("match_id", "run_id", "mode", "status")


@query(RUN_ROWS + " select match_id, run_id from passing")
def passing_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.passing_samples(runs(spark, sf_dir)).select("match_id", "run_id")


@query(RUN_ROWS + """, busy as (select match_id from runs where status = 'running')
select c_custkey as match_id, mode from customer, (select unnest(['prepare', 'sample', 'full']) as mode) where c_custkey not in (select match_id from busy) and (mode = 'prepare' or c_custkey % 3 <> 0) and (mode <> 'full' or c_custkey in (select match_id from passing))""")
def eligible_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By mode; no engine is needed to prepare, so the prepared ones are asked for without one."""
    matches = fx.table(spark, sf_dir, "customer").selectExpr("c_custkey as match_id")
    periods = matches.withColumn("number", F.explode(F.array(F.lit(1), F.lit(2)))).selectExpr("match_id", "number", "match_id % 3 <> 0 or number = 1 as confirmed")
    found = None
    for mode, engine in (("prepare", False), ("sample", True), ("full", True), ("reference", False)):
        rows = review.eligible_matches(matches, periods, runs(spark, sf_dir), mode, engine).withColumn("mode", F.lit(mode))
        found = rows if found is None else found.unionByName(rows)
    return found


@query(RUN_ROWS + " select c_custkey as match_id from customer where c_custkey in (select match_id from newest where place = 1 and mode = 'full' and status in ('review', 'completed'))")
def shown_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.shown_results(fx.table(spark, sf_dir, "customer").selectExpr("c_custkey as match_id"), runs(spark, sf_dir))


@query(RUN_ROWS + " select run_id, approved or (run_id % 4 = 0 and mode = 'sample' and status in ('review', 'completed') and not stale) as approved from runs")
def approved_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir)
    return review.approve(rows, rows.where("run_id % 4 = 0").select("run_id"))[0].select("run_id", "approved")


@query(RUN_ROWS + """, pending as (select distinct event_id as run_id from events where event_id % 3 = 0)
select run_id, case when mode <> 'full' or backend = 'heuristic' or grade in ('C', 'reject') or match_id % 3 = 0 or run_id in (select run_id from pending) then 'review' else 'completed' end as status,
  array_to_string(list_filter([case when backend = 'heuristic' then 'diagnostic_mode' end, case when match_id % 3 = 0 then 'periods_unconfirmed' end, case when grade in ('C', 'reject') then 'quality_limits' end, 'one_camera'], lambda x: x is not null), '|') as limitations from runs""")
def finished_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir).drop("status")
    periods = rows.select("match_id").distinct().selectExpr("match_id", "match_id % 3 <> 0 as confirmed")
    pending = fx.table(spark, sf_dir, "events").selectExpr("event_id as run_id", "if(event_id % 3 = 0, 'pending', 'rejected') as review_status")
    return shown(diagnostics.finish_status(rows, periods, pending).select("run_id", "status", "limitations"))


@query(RUN_ROWS + " select run_id, stale or (match_id % 5 = 0 and mode = 'sample') as stale, approved and not (match_id % 5 = 0 and mode = 'sample') as approved from runs")
def swapped_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir)
    matches = rows.select("match_id").distinct().withColumn("home_cluster", F.lit("B"))
    return review.swap_groups(matches, matches.where("match_id % 5 = 0"), rows)[1].select("run_id", "stale", "approved")


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as stored events of a match (a segment), its run chosen by the event's number."""
    return fx.base(spark, sf_dir).selectExpr(
        "event_id", "seg as match_id", "seg * 10 + event_id % 3 as run_id", "event_id * 40 as ts_ms", "event_type", "if(k % 2 = 0, 'home', 'away') as team_key", "k as player_id", "if(k % 3 = 0, k + 1, null) as recipient_id", "'unknown' as outcome", "(k % 100) / 100.0D as confidence",
        "element_at(array('pending', 'auto_accepted', 'rejected'), cast(k % 3 as int) + 1) as review_status", "'ai' as source",
    )


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of reviews: orders of one customer fall on few events, so most events see several actions."""
    return fx.table(spark, sf_dir, "orders").selectExpr(
        "o_custkey * 5 + o_orderkey % 5 as event_id", "o_orderkey as action_id", "o_orderdate as acted_at", "case when o_orderkey % 13 = 0 then 'note' when o_orderkey % 3 = 0 then 'accept' when o_orderkey % 3 = 1 and o_orderkey % 2 = 0 then 'reject' else 'correct' end as action",
        "if(o_orderkey % 4 < 2, 'goal', null) as event_type", "if(o_orderkey % 8 < 3, o_orderkey % 100, null) as player_id", "'success' as outcome",
    )


REVIEWED = BASE + """,
stored as (select event_id, seg as match_id, seg * 10 + event_id % 3 as run_id, event_id * 40 as ts_ms, event_type, case when k % 2 = 0 then 'home' else 'away' end as team_key, k as player_id, (k % 100) / 100.0::double as confidence, ['pending', 'auto_accepted', 'rejected'][k % 3 + 1] as review_status from base),
acts as (select o_custkey * 5 + o_orderkey % 5 as event_id, case when o_orderkey % 3 = 0 then 'accept' when o_orderkey % 3 = 1 and o_orderkey % 2 = 0 then 'reject' else 'correct' end as action, case when o_orderkey % 4 < 2 then 'goal' end as new_type, case when o_orderkey % 8 < 3 then o_orderkey % 100 end as new_player,
  row_number() over (partition by o_custkey * 5 + o_orderkey % 5 order by o_orderdate, o_orderkey) as i from orders where o_orderkey % 13 <> 0),
log as (select event_id, max_by(action, i) as last, bool_or(action = 'correct') as corrected, max_by(new_type, i) filter (action = 'correct' and new_type is not null) as new_type, max_by(new_player, i) filter (action = 'correct' and new_player is not null) as new_player from acts group by event_id),
reviewed as (select s.* exclude (event_type, review_status, player_id), coalesce(new_type, event_type) as event_type, coalesce(new_player, player_id) as player_id, case when corrected then 'success' else 'unknown' end as outcome,
  case last when 'accept' then 'validated' when 'reject' then 'rejected' when 'correct' then 'corrected' else review_status end as review_status, case when corrected then 'human' else 'ai' end as source from stored s left join log using (event_id))"""


@query(REVIEWED + " select event_id, event_type, player_id, outcome, review_status, source from reviewed")
def reviewed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.apply_reviews(stored(spark, sf_dir), actions(spark, sf_dir)).select("event_id", "event_type", "player_id", "outcome", "review_status", "source")


@query(REVIEWED + " select c_custkey as match_id, count(event_id) as events, count(event_id) filter (review_status = 'pending') as pending, count(event_id) filter (review_status <> 'rejected') as standing from customer left join reviewed on match_id = c_custkey group by c_custkey")
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.dashboard(fx.table(spark, sf_dir, "customer").selectExpr("c_custkey as match_id"), review.apply_reviews(stored(spark, sf_dir), actions(spark, sf_dir)))


@query(REVIEWED + " select * from (select run_id, event_id, ts_ms, row_number() over (partition by run_id order by ts_ms, event_id)::int as place from reviewed where team_key = 'home') where place <= 500")
def event_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.timeline(review.apply_reviews(stored(spark, sf_dir), actions(spark, sf_dir)), {"team_key": "home"}).select("run_id", "event_id", "ts_ms", "place")


@query(REVIEWED + """ select match_id, 1 as period, ts_ms as match_time_ms, ts_ms as video_time_ms, event_type as type, team_key || ' team' as team, coalesce(c_name, '') as player, '' as recipient, outcome, (player_id % 105) / 105.0::double as start_x, (player_id % 68) / 68.0::double as start_y, case when event_id % 2 = 0 then 0.5::double end as end_x, case when event_id % 2 = 0 then 0.25::double end as end_y, round(confidence, 4) as confidence, review_status, event_type || '|x' as qualifiers
from reviewed left join customer on c_custkey = player_id where run_id % 10 = 2 or match_id % 5 = 4""")
def event_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review.apply_reviews(stored(spark, sf_dir), actions(spark, sf_dir))
    rows = rows.withColumnRenamed("team_key", "team_id").withColumn("recipient_id", F.lit(None).cast("long")).withColumn("period", F.lit(1)).withColumn("match_time_ms", F.col("ts_ms")).withColumn("qualifiers", F.array("event_type", F.lit("x")))
    rows = rows.selectExpr("*", "(player_id % 105) / 105.0D as start_x", "(player_id % 68) / 68.0D as start_y", "if(event_id % 2 = 0, 0.5D, null) as end_x", "if(event_id % 2 = 0, 0.25D, null) as end_y")
    made = rows.where("match_id % 5 <> 4").select("match_id", "run_id").distinct().withColumn("created_at", F.col("run_id"))  # the others have no run
    teams = rows.select("team_id").distinct().withColumn("name", F.concat("team_id", F.lit(" team")))
    players = fx.table(spark, sf_dir, "customer").selectExpr("c_custkey as player_id", "c_name as name")
    return results.events_csv(rows, teams, players, made)


@query(RUNS + CARRIES + """ select seg, ts_ms, player_key, round(confidence, 6) as confidence, case when confidence >= 0.75 then 'full' else 'partial' end as visibility, case when confidence >= 0.92 then 'auto_accepted' else 'pending' end as review_status, 'yolo-baseline-v1' as model_version,
  'id-' || player_key as player_id from carries""")
def stored_carries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review.finalise_events(events.carries(events.controlled_runs(fx.samples(spark, sf_dir))))
    keys = rows.select("seg", F.col("player_key").alias("track_id")).distinct().withColumn("player_id", F.concat(F.lit("id-"), "track_id"))
    return shown(review.resolve(rows, keys, ("player",)).select("seg", "ts_ms", "player_key", "confidence", "visibility", "review_status", "model_version", "player_id"))


def assignments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """(tracks, asked, players, teams): a track for each event, three teams of which two play in a segment, players of all
    three, and requests that name players, none, or tracks that are not there."""
    rows = fx.base(spark, sf_dir).selectExpr("seg", "seq as track_id", "case when k % 5 = 0 then null else (seg + k % 2) % 3 end as team_id", "k", "if(k % 7 = 0, k, null) as player_id", "0.4D as identity_confidence")
    asked = rows.where("k % 4 <> 1").selectExpr("seg", "if(k % 19 = 2, -1 - track_id, track_id) as track_id", "if(k % 11 = 3, null, k * 5 + track_id % 3) as player_id")
    players = asked.where("player_id is not null").select("player_id").distinct().selectExpr("player_id", "player_id % 3 as team_id")
    teams = rows.select("seg").distinct().selectExpr("seg", "explode(array(seg % 3, (seg + 1) % 3)) as team_id")
    return rows, asked, players, teams


ASSIGNED = BASE + """, tracks as (select seg, seq as track_id, case when k % 5 <> 0 then (seg + k % 2) % 3 end as team_id, k, case when k % 7 = 0 then k end as player_id from base),
asked as (select seg, case when k % 19 = 2 then -1 - track_id else track_id end as track_id, team_id, k % 19 = 2 as unknown, case when k % 11 <> 3 then k * 5 + track_id % 3 end as player_id from tracks where k % 4 <> 1),
judged as (select *, case when unknown then 'track' when player_id % 3 not in (seg % 3, (seg + 1) % 3) then 'player' when player_id % 3 <> team_id then 'team' end as rule from asked),
done as (select t.seg, t.track_id, t.team_id, case when j.seg is null then t.player_id else j.player_id end as player_id, case when j.seg is null then 0.4::double when j.player_id is null then 0.0::double else 1.0::double end as identity_confidence, j.seg is not null as given from tracks t left join judged j on j.seg = t.seg and j.track_id = t.track_id and j.rule is null)"""


@query(ASSIGNED + " select seg, count(*) filter (player_id is null) as unassigned from done group by seg")
def unassigned_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.unassigned(review.assign_tracks(*assignments(spark, sf_dir))[0])


@query(ASSIGNED + " select seg, track_id, coalesce(team_id, -1) as team_id, coalesce(player_id, -1) as player_id, identity_confidence from done")
def assigned_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.assign_tracks(*assignments(spark, sf_dir))[0].select("seg", "track_id", "team_id", "player_id", "identity_confidence").fillna(-1, ["team_id", "player_id"])


@query(ASSIGNED + " select seg, track_id, coalesce(player_id, -1) as player_id, rule from judged where rule is not null")
def assignment_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.assign_tracks(*assignments(spark, sf_dir))[1].fillna(-1, ["player_id"])


@query(SPANS + """ select seg, start_ms, end_ms, state, player_key, case when player_key = 'p1' then -2 when player_key = 'p2' then seg * 10 + 2 when player_key is not null then seg * 100 + right(player_key, 1)::bigint else -1 end as player_id from spans""")
def resolved_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with their owner's player, after one track of each segment was given to another player and one to none (-2)."""
    spans = possession.compress(fx.samples(spark, sf_dir))
    tracks = spans.where("player_key is not null").select("seg", F.col("player_key").alias("track_id")).distinct().withColumn("player_id", F.expr("seg * 100 + cast(right(track_id, 1) as bigint)"))
    asked = tracks.where("track_id in ('p1', 'p2')").selectExpr("seg", "track_id", "if(track_id = 'p1', null, seg * 10 + 2) as player_id")
    rows = review.follow(review.resolve(spans, tracks, ("player",)), asked, ("player",))
    return rows.withColumn("player_id", F.expr("coalesce(player_id, if(player_key is null, -1, -2))")).select("seg", "start_ms", "end_ms", "state", "player_key", "player_id")


@query(REVIEWED + """, counts as (select match_id, count(*) filter (team_key = 'home' and event_type = 'click') as ch, count(*) filter (team_key = 'away' and event_type = 'click') as ca, count(*) filter (team_key = 'home' and event_type = 'goal') as gh, count(*) filter (team_key = 'away' and event_type = 'goal') as ga from reviewed group by match_id)
select match_id, 'clicks' as metric, ch as home, ca as away from counts union all select match_id, 'goals', gh, ga from counts""")
def team_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review.apply_reviews(stored(spark, sf_dir), actions(spark, sf_dir))
    stats = rows.groupBy("match_id", "team_key").agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "goal").alias("goals"))
    return review.compare_teams(stats, ["clicks", "goals"]).fillna(0)


@query(BASE + """, chosen as (select seg, seq * 21000 as ts_ms, event_id from base), wide as (select *, greatest(0, ts_ms - 5000) as s, least(ts_ms + 5000, max(ts_ms) over (partition by seg) + 3000) as e from chosen),
cuts as (select *, case when s <= max(e) over (partition by seg order by ts_ms, event_id rows between unbounded preceding and 1 preceding) + 2000 then 0 else 1 end as new from wide)
select seg, event_id, sum(new) over (partition by seg order by ts_ms, event_id)::int as clip, 'clip-' || lpad((sum(new) over (partition by seg order by ts_ms, event_id))::bigint::varchar, 3, '0') || '-pass.mp4' as name from cuts""")
def clip_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.base(spark, sf_dir).selectExpr("seg", "seq * 21000 as ts_ms", "event_id", "'pass' as event_type")
    videos = rows.groupBy("seg").agg((F.max("ts_ms") + 3000).alias("duration_ms"))
    return review.link_clips(clips.clip_windows(rows, videos))
