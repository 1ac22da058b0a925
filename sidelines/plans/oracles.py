"""SQL with the rows of the registered queries."""

BASE = """
with base as (
  select event_id, event_type, value, user_id, user_id // 4 as seg, cast(json_extract_string(props, '$.k') as bigint) as k,
    row_number() over (partition by user_id // 4 order by ts, event_id) - 1 as seq from events),
clock as (
  select seg, seq, k, seq*100 + (k % 5)*10 + 5000*(seq // 50) as ts_ms, (seq // 10 + (seq // 80) * 2) % 6 as owner,
    (((seq // 10) * 29 + (seq % 10) * 4 + (k % 4)) % 101) / 100.0::double as ball_x, (k % 68) / 68.0::double as ball_y from base)"""

SAMPLES = BASE + """,
states as (
  select *, (30 + k % 60) / 100.0::double as confidence,
    case when seq % 40 in (13,14) then 'contested' when seq % 40 in (27,28,29) then 'loose' when seq % 40 = 39 then 'out' when seq % 40 = 35 and k % 2 = 0 then 'unknown' else 'controlled' end as state from clock),
samples as (
  select seg, ts_ms, state, ball_x, ball_y, confidence, owner, (owner + 3) % 6 as rival,
    case when state = 'controlled' then case when owner < 3 then 'home' else 'away' end end as team_key,
    case when state = 'controlled' then 'p' || owner end as player_key from states)"""

RUNS = SAMPLES + """,
marked as (
  select *, case when state = 'controlled' and (lag(state) over w is distinct from 'controlled' or lag(player_key) over w is distinct from player_key or ts_ms - lag(ts_ms) over w > 3000) then 1 else 0 end as new
  from samples window w as (partition by seg order by ts_ms)),
numbered as (select *, sum(new) over (partition by seg order by ts_ms) as run from marked),
runs as (
  select seg, run, team_key, player_key, min(ts_ms) as start_ms, max(ts_ms) as end_ms, count(*) as n, min(confidence) as confidence,
    arg_min(ball_x, ts_ms) as start_ball_x, arg_min(ball_y, ts_ms) as start_ball_y, arg_min(confidence, ts_ms) as start_confidence,
    arg_max(ball_x, ts_ms) as end_ball_x, arg_max(ball_y, ts_ms) as end_ball_y, arg_max(confidence, ts_ms) as end_confidence
  from numbered where state = 'controlled' group by seg, run, team_key, player_key)"""

CARRIES = """,
carries as (
  select seg, end_ms as ts_ms, 'carry' as event_type, team_key, player_key, cast(null as varchar) as recipient_key, 'success' as outcome, start_ball_x as start_x, start_ball_y as start_y, end_ball_x as end_x, end_ball_y as end_y, confidence,
    case when abs(end_ball_x - start_ball_x) >= 0.12 then 'progressive_candidate' else '' end as qualifiers, 0 as kind, run as place, 0 as sub, end_ms - start_ms as duration_ms,
    round(sqrt((end_ball_x - start_ball_x) * (end_ball_x - start_ball_x) + (end_ball_y - start_ball_y) * (end_ball_y - start_ball_y)), 5) as distance
  from runs where n >= 2 and end_ms - start_ms >= 700
    and sqrt((end_ball_x - start_ball_x) * (end_ball_x - start_ball_x) + (end_ball_y - start_ball_y) * (end_ball_y - start_ball_y)) >= 0.08)"""

TRANSFERS = """,
pairs as (
  select *, lag(team_key) over w as b_team, lag(player_key) over w as b_player, lag(end_ms) over w as b_end, lag(end_ball_x) over w as b_x, lag(end_ball_y) over w as b_y, lag(end_confidence) over w as b_confidence
  from runs window w as (partition by seg order by run)),
moves as (select *, least(b_confidence, start_confidence) as low from pairs where b_end is not null and start_ms - b_end <= 3000 and b_player <> player_key),
transfers as (
  select seg, start_ms as ts_ms, 'pass' as event_type, b_team as team_key, b_player as player_key, player_key as recipient_key, 'success' as outcome, b_x as start_x, b_y as start_y, start_ball_x as end_x, start_ball_y as end_y, low as confidence,
    case when abs(start_ball_x - b_x) >= 0.12 then 'progressive_candidate' else '' end as qualifiers, 0 as kind, run as place, 1 as sub from moves where b_team = team_key
  union all select seg, start_ms, 'loss', b_team, b_player, null, 'failure', b_x, b_y, start_ball_x, start_ball_y, low * 0.82::double, '', 0, run, 1 from moves where b_team <> team_key
  union all select seg, start_ms, 'recovery', team_key, player_key, null, 'success', start_ball_x, start_ball_y, null, null, low * 0.82::double, '', 0, run, 2 from moves where b_team <> team_key)"""

DUELS = """,
around as (
  select *, case when state = 'contested' and lag(state) over w is distinct from 'contested' then 1 else 0 end as fresh,
    max(case when state = 'controlled' then ts_ms end) over (partition by seg order by ts_ms rows between unbounded preceding and 1 preceding) as before_ms,
    min(case when state = 'controlled' then ts_ms end) over (partition by seg order by ts_ms rows between 1 following and unbounded following) as after_ms
  from samples window w as (partition by seg order by ts_ms)),
contests as (
  select seg, run, min(ts_ms) as ts_ms, min(before_ms) as before_ms, min(after_ms) as after_ms, avg(confidence) as mean, arg_min(ball_x, ts_ms) as start_x, arg_min(ball_y, ts_ms) as start_y, arg_max(ball_x, ts_ms) as end_x, arg_max(ball_y, ts_ms) as end_y,
    arg_min(owner, ts_ms) as c1, arg_min(rival, ts_ms) as c2, arg_max(owner, ts_ms) as c3, arg_max(rival, ts_ms) as c4
  from (select *, sum(fresh) over (partition by seg order by ts_ms) as run from around) where state = 'contested' group by seg, run),
decided as (
  select c.*, a.player_key as after_player, a.team_key as after_team, a.ball_x as after_x, a.ball_y as after_y, a.confidence as after_confidence, b.player_key as before_player, b.ball_x as before_x, b.ball_y as before_y, b.confidence as before_confidence,
    coalesce(a.player_key, 'p' || c1) as winner, coalesce(a.team_key, case when c1 < 3 then 'home' else 'away' end) as winner_team
  from contests c left join samples a on a.seg = c.seg and a.ts_ms = c.after_ms left join samples b on b.seg = c.seg and b.ts_ms = c.before_ms),
duels as (
  select seg, ts_ms, 'duel' as event_type, winner_team as team_key, winner as player_key, cast(null as varchar) as recipient_key, case when after_ms is not null then 'success' else 'unknown' end as outcome, start_x, start_y, end_x, end_y, mean * 0.78::double as confidence,
    'ground_candidate|opponent_track:' || case when 'p' || c1 <> winner then 'p' || c1 when 'p' || c2 <> winner then 'p' || c2 when 'p' || c3 <> winner then 'p' || c3 else 'p' || c4 end as qualifiers, 1 as kind, ts_ms as place, 0 as sub from decided
  union all select seg, after_ms, 'dribble', after_team, after_player, null, 'success', before_x, before_y, after_x, after_y, least(before_confidence, after_confidence) * 0.75::double, 'after_contest', 1, ts_ms, 1 from decided where before_player = after_player)"""

OUTS = """,
outs as (
  select seg, ts_ms, 'out' as event_type, 'neutral' as outcome, confidence * 0.72::double as confidence
  from (select *, lag(state) over (partition by seg order by ts_ms) as before from samples) where state = 'out' and before <> 'out')"""

SHOTS = """,
sources as (select seg, ts_ms, team_key, player_key, ball_x, ball_y, confidence from samples where state = 'controlled'),
ahead as (
  select s.*, f.ts_ms as f_ms, f.state as f_state, f.player_key as f_player, f.ball_x as f_x, f.ball_y as f_y, f.confidence as f_confidence
  from sources s join samples f on f.seg = s.seg and f.ts_ms > s.ts_ms and f.ts_ms <= s.ts_ms + 2200),
stops as (select seg, ts_ms, min(f_ms) as stop_ms from ahead where f_state = 'controlled' and f_player <> player_key group by seg, ts_ms),
flights as (
  select a.seg, a.ts_ms, a.team_key, a.player_key, a.ball_x, a.ball_y, a.confidence, count(*) as n, arg_max(f_state, f_ms) as e_state, arg_max(f_x, f_ms) as e_x, arg_max(f_y, f_ms) as e_y, arg_max(f_confidence, f_ms) as e_confidence
  from ahead a left join stops using (seg, ts_ms) where stop_ms is null or f_ms < stop_ms group by all),
shots as (
  select seg, ts_ms, 'shot' as event_type, team_key, player_key, cast(null as varchar) as recipient_key, 'unknown' as outcome, ball_x as start_x, ball_y as start_y, e_x as end_x, e_y as end_y, least(confidence, e_confidence) * 0.68::double as confidence, 'trajectory_candidate|space:image_normalized' as qualifiers, 3 as kind, ts_ms as place, 0 as sub
  from flights where n >= 2 and e_state in ('loose', 'out') and (e_x <= 0.12 or e_x >= 0.88) and sqrt((e_x - ball_x) * (e_x - ball_x) + (e_y - ball_y) * (e_y - ball_y)) >= 0.12)"""

EVENT = "seg, ts_ms, event_type, team_key, player_key, recipient_key, outcome, round(start_x, 6) as start_x, round(start_y, 6) as start_y, round(end_x, 6) as end_x, round(end_y, 6) as end_y, round(confidence, 6) as confidence, qualifiers"

#: Of events of one type and player within 400 ms among the last six kept, the most confident stays: events pass one by one.
DETECTED = """,
every as (select * exclude (duration_ms, distance) from carries union all select * from transfers union all select * from duels
  union all select seg, ts_ms, event_type, null, null, null, outcome, null, null, null, null, confidence, '', 2, ts_ms, 0 from outs union all select * from shots),
queue as (select *, {'id': row_number() over (), 'kind': event_type, 'who': player_key, 'ts': ts_ms, 'sure': confidence} as e, row_number() over (partition by seg order by ts_ms, kind, place, sub) as i from every),
fold as (
  select seg, 0::bigint as i, []::struct(id bigint, kind varchar, who varchar, ts bigint, sure double)[] as kept, null::bigint as gone from (select distinct seg from queue)
  union all
  select seg, i, case when hit is not null then list_transform(range(1, len(kept) + 1), lambda j: case when j = hit and e.sure > kept[j].sure then e else kept[j] end) else list_append(kept, e)[-6:] end,
    case when hit is null and len(kept) = 6 then kept[1].id end
  from (select q.seg, q.i, q.e, f.kept, list_max(list_filter(range(1, len(f.kept) + 1), lambda j: f.kept[j].kind = q.e.kind and f.kept[j].who is not distinct from q.e.who and abs(f.kept[j].ts - q.e.ts) <= 400)) as hit
    from fold f join queue q on q.seg = f.seg and q.i = f.i + 1)),
left_over as (select gone as id from fold where gone is not null union all select unnest(kept).id from (select kept, i, max(i) over (partition by seg) as last from fold) where i = last),
detected as (select * from queue where e.id in (select id from left_over))"""

SPANS = SAMPLES + """,
gaps as (
  select *, ts_ms - lag(ts_ms) over w as gap, lead(ts_ms) over w as next_ms, lag(state) over w as p_state, lag(player_key) over w as p_player, row_number() over w as rn from samples window w as (partition by seg order by ts_ms)),
cuts as (select *, sum(case when rn = 1 or p_state <> state or p_player is distinct from player_key or gap > 1000 then 1 else 0 end) over (partition by seg order by ts_ms) as span from gaps),
usual as (select seg, cast(trunc(coalesce(quantile_cont(gap, 0.5), 0)) as bigint) as usual from gaps where gap > 0 and gap <= 1000 group by seg),
spans as (
  select seg, min(ts_ms) as start_ms, case when arg_max(coalesce(next_ms, 1000000000000), ts_ms) - max(ts_ms) <= 1000 then max(next_ms) else max(ts_ms) + any_value(usual) end as end_ms, state, team_key, player_key, avg(confidence) as confidence
  from cuts join usual using (seg) group by seg, span, state, team_key, player_key)"""

POSSESSION = BASE + """,
frames as (
  select *, case when seq % 40 = 35 and k % 2 = 0 then 0.05::double else (50 + k % 40) / 100.0::double end as field_score, k % 17 <> 0 as visible from clock),
athletes as (
  select seg, ts_ms, j, case when j < 3 then 'home' else 'away' end as team, 'p' || j as player, (60 + (k + j) % 40) / 100.0::double as conf,
    case when j = owner and seq % 40 in (27,28,29) then ball_x + 0.1::double when j = owner then ball_x + (k % 3) / 100.0::double
      when j = (owner + 3) % 6 and seq % 40 in (13,14) then ball_x + (k % 3) / 100.0::double + 0.005::double else ball_x + 0.2::double + j / 20.0::double end as x, ball_x
  from frames, (select unnest(range(6)) as j)),
ranked as (select *, sqrt((ball_x - x) * (ball_x - x)) as d, row_number() over (partition by seg, ts_ms order by sqrt((ball_x - x) * (ball_x - x)), j) as rk from athletes),
near as (
  select seg, ts_ms, max(case when rk = 1 then d end) as d1, max(case when rk = 1 then team end) as t1, max(case when rk = 1 then player end) as p1, max(case when rk = 1 then conf end) as c1,
    max(case when rk = 2 then d end) as d2, max(case when rk = 2 then team end) as t2, max(case when rk = 2 then player end) as p2 from ranked group by seg, ts_ms),
steps as (
  select f.*, n.* exclude (seg, ts_ms), case when field_score < 0.14 then 'dead' when not visible then 'no_ball' when d1 > 0.055 then 'loose' when t1 <> t2 and d2 <= 0.055::double * 1.15::double and d2 - d1 <= 0.055::double * 0.25::double then 'contested' else 'proposal' end as step
  from frames f join near n using (seg, ts_ms)),
offers as (select seg, ts_ms, p1, row_number() over w as rn, case when lag(p1) over w is distinct from p1 then ts_ms end as turn from steps where step = 'proposal' window w as (partition by seg order by ts_ms)),
since as (select *, max(turn) over (partition by seg order by ts_ms) as since_ms from offers),
promoted as (select seg, ts_ms, case when rn = 1 or (turn is null and ts_ms - since_ms >= 250) then ts_ms end as at from since),
current as (
  select s.*, max(p.at) over w as current_ms, max(case when step not in ('dead', 'no_ball') then s.ts_ms end) over w as seen_ms
  from steps s left join promoted p using (seg, ts_ms) window w as (partition by s.seg order by s.ts_ms)),
owned as (
  select c.*, o.p1 as own_player, o.t1 as own_team, e.ball_x as seen_x, e.ball_y as seen_y, (c.step = 'proposal' or (c.step = 'no_ball' and c.ts_ms - c.seen_ms <= 1500 and c.current_ms is not null)) as held
  from current c left join steps o on o.seg = c.seg and o.ts_ms = c.current_ms left join steps e on e.seg = c.seg and e.ts_ms = c.seen_ms)
select seg, ts_ms, case when coalesce(held, false) then 'controlled' when step in ('loose', 'contested') then step else 'unknown' end as state,
  case when held then own_team end as team_key, case when held then own_player end as player_key,
  round(case when step = 'dead' then null when step = 'no_ball' then case when held then seen_x end else ball_x end, 6) as ball_x,
  round(case when step = 'dead' then null when step = 'no_ball' then case when held then seen_y end else ball_y end, 6) as ball_y,
  round(case when step = 'dead' then greatest(0.45, 1 - field_score) when step = 'no_ball' then case when held then 0.35 else 0.15 end when step = 'loose' then 0.5 when step = 'contested' then 0.58
    else least(0.98, greatest(0.25, c1 * (1 - d1 / 0.055::double))) end, 6) as confidence,
  case when step = 'dead' then 'broadcast_not_live' end as reason, case when step = 'contested' then p1 || '|' || p2 else '' end as contenders, case when step in ('contested', 'proposal') then 'image_normalized' end as coordinate_space
from owned"""

ORACLE_SQL = {
    "event_runs": RUNS + " select seg, team_key, player_key, start_ms, end_ms, n, round(confidence, 6) as confidence, round(start_ball_x, 6) as start_ball_x, round(start_ball_y, 6) as start_ball_y, round(start_confidence, 6) as start_confidence, round(end_ball_x, 6) as end_ball_x, round(end_ball_y, 6) as end_ball_y, round(end_confidence, 6) as end_confidence from runs",
    "event_transfers": RUNS + TRANSFERS + f" select {EVENT} from transfers",
    "event_carries": RUNS + CARRIES + f" select {EVENT}, duration_ms, distance from carries",
    "event_duels": SAMPLES + DUELS + f" select {EVENT} from duels",
    "event_outs": SAMPLES + OUTS + " select seg, ts_ms, event_type, outcome, round(confidence, 6) as confidence from outs",
    "event_shots": SAMPLES + SHOTS + f" select {EVENT} from shots",
    "event_team_counters": RUNS + TRANSFERS + """ select seg, team_key, count(*) filter (event_type = 'pass') as passes, count(*) filter (event_type = 'pass') as passes_completed, count(*) filter (event_type = 'pass' and qualifiers <> '') as progressive_passes,
  count(*) filter (event_type = 'loss') as losses, count(*) filter (event_type = 'recovery') as recoveries, case when count(*) filter (event_type = 'pass') > 0 then 100.0::double else 0.0::double end as pass_accuracy_pct from transfers group by seg, team_key""",
    "event_detection": (RUNS + CARRIES + TRANSFERS + DUELS + OUTS + SHOTS + DETECTED).replace("with base", "with recursive base", 1) + f" select {EVENT} from detected",
    "event_player_counters": RUNS + CARRIES + TRANSFERS + DUELS + SHOTS + """, every as (select * exclude (duration_ms, distance) from carries union all select * from transfers union all select * from duels union all select * from shots)
select seg, player_key, count(*) filter (event_type = 'pass') as passes, count(*) filter (event_type = 'carry') as carries, count(*) filter (event_type = 'shot') as shots, count(*) filter (event_type = 'duel') as duels, count(*) filter (event_type = 'duel' and outcome = 'success') as duels_won,
  count(*) filter (event_type = 'loss') as losses, count(*) filter (event_type = 'recovery') as recoveries, case when count(*) filter (event_type = 'pass') > 0 then 100.0::double else 0.0::double end as pass_accuracy_pct from every group by seg, player_key""",
    "possession_samples": POSSESSION,
    "possession_spans": SPANS + " select seg, start_ms, end_ms, state, team_key, player_key, round(confidence, 6) as confidence from spans",
    "possession_shares": SPANS + """, totals as (select seg, sum(case when state in ('controlled', 'contested', 'loose') then end_ms - start_ms end) as in_play, sum(case when state = 'controlled' then end_ms - start_ms end) as held from spans group by seg)
select seg, team_key, round(any_value(in_play) / 1000, 1) as ball_in_play_seconds, round(sum(end_ms - start_ms) / 1000, 1) as possession_seconds, round(100 * sum(end_ms - start_ms) / greatest(1, any_value(held)), 2) as possession_pct
from spans join totals using (seg) where state = 'controlled' group by seg, team_key""",
    "clip_plan": BASE + """,
chosen as (select seg, seq * 21000 as ts_ms, event_id, ['pass', 'shot', 'duel', 'aerial_duel', 'goal'][k % 5 + 1] as event_type from base),
padded as (
  select c.*, greatest(0, ts_ms - case event_type when 'goal' then 12000 when 'shot' then 9000 else 5000 end) as s,
    least(max(ts_ms) over (partition by seg) + 3000, ts_ms + case event_type when 'goal' then 10000 when 'shot' then 7000 else 5000 end) as e from chosen c),
cuts as (select *, case when s > max(e) over (partition by seg order by ts_ms, event_id rows between unbounded preceding and 1 preceding) + 2000 then 1 else 0 end as new from padded),
clips as (select *, sum(new) over (partition by seg order by ts_ms, event_id) as clip from cuts),
folded as (select seg, clip, min(s) as start_ms, max(e) as end_ms, list(event_type order by ts_ms, event_id) as kinds, string_agg(cast(event_id as varchar), ',' order by ts_ms, event_id) as events from clips group by seg, clip)
select seg, start_ms, end_ms, events, list_reduce(kinds, lambda a, x: case when contains(a, x) then a else a || '-' || x end) as label from folded""",
}
