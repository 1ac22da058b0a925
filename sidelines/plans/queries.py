"""Registered queries: (spark, sf_dir) -> DataFrame. Doubles are rounded in the last step only."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sidelines.operators import clips, events, possession, stats
from sidelines.plans import fixtures as fx

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


#: What only a carry has.
METADATA = ("duration_ms", "distance")


def shown(df: DataFrame, digits: int = 6, without: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.concat_ws("|", c).alias(c) if t == "array<string>" else F.col(c) for c, t in df.dtypes if c not in ("emit_ord", "start_metres", "end_metres") and c not in without))


@query
def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(events.controlled_runs(fx.samples(spark, sf_dir)).drop("run"))


@query
def event_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(events.transfers(events.controlled_runs(fx.samples(spark, sf_dir))), without=METADATA)


@query
def event_carries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(events.carries(events.controlled_runs(fx.samples(spark, sf_dir))))


@query
def event_duels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(events.duels(fx.samples(spark, sf_dir)), without=METADATA)


@query
def event_outs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(events.outs(fx.samples(spark, sf_dir)).select("seg", "ts_ms", "event_type", "outcome", "confidence"))


@query
def event_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(events.shots(fx.samples(spark, sf_dir)), without=METADATA)


@query
def event_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(events.detect_events(fx.samples(spark, sf_dir)), without=METADATA)


@query
def event_team_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events.transfers(events.controlled_runs(fx.samples(spark, sf_dir)))
    return stats.event_stats(found, ["seg", "team_key"]).select("seg", "team_key", "passes", "passes_completed", "progressive_passes", "losses", "recoveries", "pass_accuracy_pct")


@query
def event_player_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.event_stats(events.candidates(fx.samples(spark, sf_dir)), ["seg", "player_key"]).select("seg", "player_key", "passes", "carries", "shots", "duels", "duels_won", "losses", "recoveries", "pass_accuracy_pct")


@query
def possession_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = possession.possession(fx.frames(spark, sf_dir), fx.athletes(spark, sf_dir))
    return shown(found.withColumn("contenders", F.transform("contenders", lambda c: c["player_key"])))


@query
def possession_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(possession.compress(fx.samples(spark, sf_dir)))


@query
def possession_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return possession.possession_stats(possession.compress(fx.samples(spark, sf_dir)))


@query
def clip_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.base(spark, sf_dir).selectExpr("seg", "seq * 21000 as ts_ms", "event_id", "element_at(array('pass', 'shot', 'duel', 'aerial_duel', 'goal'), cast(k % 5 as int) + 1) as event_type")
    videos = rows.groupBy("seg").agg((F.max("ts_ms") + 3000).alias("duration_ms"))
    found = clips.clip_windows(rows, videos)
    return found.withColumn("events", F.concat_ws(",", F.transform("event_ids", lambda e: e.cast("string")))).drop("event_ids")
