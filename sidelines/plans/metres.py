"""Queries over places in metres: stretches of four seconds are on the pitch, the others in shares of the image."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sidelines.operators import events, possession
from sidelines.plans import fixtures as fx
from sidelines.plans.oracles import CARRIES, EVENT, POSSESSION, RUNS, SAMPLES, SHOTS, TRANSFERS
from sidelines.plans.queries import METADATA, shown
from sidelines.plans.registry import query

METRES = "(ts_ms div 4000) % 2 = 0"
#: Places of both tables on the pitch; the ball is past its lines at either end.
X, Y = "{} * 120 - 10", "{} * 60 + 4"


def on_pitch(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.withColumns({c: F.expr(f"if({METRES}, {place.format(c)}, {c})") for c, place in ((x, X), (y, Y))})


def spaces(rows: DataFrame) -> DataFrame:
    return rows.withColumn("coordinate_space", F.expr(f"if({METRES}, 'pitch_meters', null)"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaces(on_pitch(fx.samples(spark, sf_dir), "ball_x", "ball_y"))


def _metres(ts: str) -> str:
    return f"({ts} // 4000) % 2 = 0"


def _sql(text: str, *thresholds: tuple[str, str]) -> str:
    """SQL over shares of the image, with samples that are partly in metres and the thresholds given in place of fixed ones."""
    moved = SAMPLES.replace("select seg, ts_ms, state, ball_x, ball_y, confidence, owner", f"select seg, ts_ms, state, case when {_metres('ts_ms')} then ball_x * 120 - 10 else ball_x end as ball_x, case when {_metres('ts_ms')} then ball_y * 60 + 4 else ball_y end as ball_y, confidence, owner")
    for old, new in thresholds:
        assert old in text
        text = text.replace(old, new)
    return moved + text.removeprefix(SAMPLES)


def _of(ts: str, image: float, pitch: float) -> str:
    return f"case when {_metres(ts)} then {pitch}::double else {image}::double end"


@query(_sql(RUNS + CARRIES, (">= 0.12 then", f">= {_of('start_ms', 0.12, 10)} then"), (">= 0.08)", f">= {_of('start_ms', 0.08, 5)})")) + f" select {EVENT}, duration_ms, round(distance, 6) as distance from carries")
def carries_in_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(events.carries(events.controlled_runs(samples(spark, sf_dir))))


@query(_sql(RUNS + TRANSFERS, (">= 0.12 then", f">= {_of('b_end', 0.12, 10)} then")) + f" select {EVENT} from transfers")
def transfers_in_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(events.transfers(events.controlled_runs(samples(spark, sf_dir))), without=METADATA)


@query(_sql(SAMPLES + SHOTS, ("e_x <= 0.12", f"e_x <= {_of('ts_ms', 0.12, 10)}"), ("e_x >= 0.88", f"e_x >= {_of('ts_ms', 0.88, 95)}"), (">= 0.12)", f">= {_of('ts_ms', 0.12, 8)})"), ("'trajectory_candidate|space:image_normalized'", f"case when {_metres('ts_ms')} then 'trajectory_candidate|space:pitch_meters' else 'trajectory_candidate|space:image_normalized' end")) + f" select {EVENT} from shots")
def shots_in_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(events.shots(samples(spark, sf_dir)), without=METADATA)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, people = fx.frames(spark, sf_dir), fx.athletes(spark, sf_dir)
    return possession.possession(spaces(on_pitch(frames, "ball_x", "ball_y")), on_pitch(people, "x", "y"))


RADIUS = "case when metres then 2.6::double / 120 else 0.055::double end"
OWNED = (
    POSSESSION.split("select seg, ts_ms, case when coalesce(held, false) then")[0]
    .replace("k % 17 <> 0 as visible from clock", f"k % 17 <> 0 as visible, {_metres('ts_ms')} as metres from clock")
    .replace("when not visible then 'no_ball' when d1 > 0.055 then", f"when not visible then 'no_ball' when metres and (ball_x * 120 - 10 < -0.5 or ball_x * 120 - 10 > 105.5) then 'out' when d1 > {RADIUS} then")
    .replace("0.055::double * 1.15::double", f"{RADIUS} * 1.15::double").replace("0.055::double * 0.25::double", f"{RADIUS} * 0.25::double")
)
SEEN = "case when step = 'dead' then null when step = 'no_ball' then case when held then case when (seen_ms // 4000) % 2 = 0 then seen_{0} * {1} else seen_{0} end end else case when metres then ball_{0} * {1} else ball_{0} end end"


@query(OWNED + f"""select seg, ts_ms, case when coalesce(held, false) then 'controlled' when step in ('loose', 'contested', 'out') then step else 'unknown' end as state, case when held then own_team end as team_key, case when held then own_player end as player_key,
  round({SEEN.format('x', '120 - 10')}, 6) as ball_x, round({SEEN.format('y', '60 + 4')}, 6) as ball_y,
  round(case when step = 'dead' then greatest(0.45, 1 - field_score) when step = 'no_ball' then case when held then 0.35 else 0.15 end when step = 'out' then 0.76 when step = 'loose' then 0.5 when step = 'contested' then 0.58 else least(0.98, greatest(0.25, c1 * (1 - d1 / {RADIUS}))) end, 6) as confidence,
  case when step = 'dead' then 'broadcast_not_live' when step = 'out' then 'pitch_boundary' end as reason, case when step = 'contested' then p1 || '|' || p2 else '' end as contenders,
  case when step in ('contested', 'proposal', 'out') then case when metres then 'pitch_meters' else 'image_normalized' end end as coordinate_space from owned""")
def possession_in_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(found(spark, sf_dir).withColumn("contenders", F.transform("contenders", lambda c: c["player_key"])))


@query(OWNED + """, seq_states as (select seg, ts_ms, step = 'out' as gone, lag(step) over (partition by seg order by ts_ms) as before from owned)
select seg, ts_ms, 'out' as event_type, 'neutral' as outcome, round(0.76::double * 0.72::double, 6) as confidence from seq_states where gone and before <> 'out'""")
def outs_in_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outs that possession itself finds past the lines."""
    return shown(events.outs(found(spark, sf_dir)).select("seg", "ts_ms", "event_type", "outcome", "confidence"))
