"""Operator inputs derived from the general tables: users' events as frames and samples of match segments, order lines as
detections. Every row of the table goes in; work grows with it."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sidelines.functions.columns import ordered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "user_id", "ts", F.expr("user_id div 4").alias("seg"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    return rows.withColumn("seq", F.row_number().over(ordered(["seg"], "ts", "event_id")).cast("long") - 1).drop("ts")


def _clock(rows: DataFrame) -> DataFrame:
    return rows.selectExpr(
        "seg", "seq", "k", "seq*100 + (k % 5)*10 + 5000*(seq div 50) as ts_ms", "(seq div 10 + (seq div 80) * 2) % 6 as owner",
        "(((seq div 10) * 29 + (seq % 10) * 4 + (k % 4)) % 101) / 100.0D as ball_x", "(k % 68) / 68.0D as ball_y",
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clock(base(spark, sf_dir)).withColumn("state", F.expr("case when seq % 40 in (13,14) then 'contested' when seq % 40 in (27,28,29) then 'loose' when seq % 40 = 39 then 'out' when seq % 40 = 35 and k % 2 = 0 then 'unknown' else 'controlled' end"))
    team = "if({0} < 3, 'home', 'away')"
    held = "if(state = 'controlled', {0}, null)"
    other = "(owner + 3) % 6"
    contender = "named_struct('team_key', " + team + ", 'player_key', concat('p', {0}))"
    return rows.selectExpr(
        "seg", "ts_ms", "state", held.format(team.format("owner")) + " as team_key", held.format("concat('p', owner)") + " as player_key", "ball_x", "ball_y", "(30 + k % 60) / 100.0D as confidence",
        f"if(state = 'contested', array({contender.format('owner')}, {contender.format(other)}), null) as contenders",
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clock(base(spark, sf_dir)).selectExpr(
        "seg", "seq", "k", "owner", "ts_ms", "if(seq % 40 = 35 and k % 2 = 0, 0.05D, (50 + k % 40) / 100.0D) as field_score", "false as scene_cut", "0.0D as replay_probability",
        "if(k % 17 <> 0, ball_x, null) as ball_x", "if(k % 17 <> 0, ball_y, null) as ball_y", "ball_x as bx", "ball_y as by",
    )


def athletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(5))))
    return rows.selectExpr(
        "seg", "ts_ms", "j as obj_ord", "if(j < 3, 'home', 'away') as team_key", "concat('p', j) as player_key", "(60 + (k + j) % 40) / 100.0D as confidence", "by as y",
        """case when j = owner and seq % 40 in (27,28,29) then bx + 0.1D when j = owner then bx + (k % 3) / 100.0D
           when j = (owner + 3) % 6 and seq % 40 in (13,14) then bx + (k % 3) / 100.0D + 0.005D else bx + 0.2D + j / 20.0D end as x""",
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as frame", "l_linenumber as det_ord", "l_suppkey % 8 as track_id", "l_partkey % 4 as class_id", "cast(l_partkey % 1800 as double) as left_px", "cast(l_suppkey % 100 * 9 as double) as top_px",
        "10.0D + l_quantity as w_px", "20.0D + 2 * l_quantity as h_px", "1.0D - l_discount as confidence", "l_partkey", "l_suppkey", "l_extendedprice",
    )
