"""Signals of sampled frames and the quality of a recording."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sidelines.functions.columns import clamp

#: Fixed values of each provider: weights of green and lines, and the replay's probability where a column is under a value.
PROVIDERS = {
    "quality": (1.55, 1.2, "field_score", 0.22, 0.7),
    "heuristic": (1.6, 0.0, "green_ratio", 0.12, 0.7),
    "detector": (1.6, 0.0, "field_score", 0.2, 0.72),
}


def derive_signals(features: DataFrame, cut: float = 0.32, provider: str = "quality") -> DataFrame:
    """features(green_ratio, motion_score, ...; line_score for `quality`) with field_score, scene_cut and replay_probability."""
    green, lines, column, under, replay = PROVIDERS[provider]
    score = F.col("green_ratio") * green + (F.col("line_score") * lines if lines else 0.0)
    rows = features.withColumn("field_score", clamp(score)).withColumn("scene_cut", F.col("motion_score") > cut)
    return rows.withColumn("replay_probability", F.when(F.col("scene_cut") & (F.col(column) < under), replay).otherwise(0.0))


def _grade(score: Column) -> Column:
    return F.when((score >= 78) & (F.col("width") >= 1920), "A").when((score >= 60) & (F.col("width") >= 1280), "B").when(score >= 40, "C").otherwise("reject")


def quality_report(signals: DataFrame, videos: DataFrame) -> DataFrame:
    """Per video its means, score of 0 to 100 and grade; without samples: score 0 and `reject`."""
    means = signals.groupBy("match_id").agg(
        F.avg("sharpness").alias("sharpness"), F.avg("brightness").alias("brightness"), F.avg("field_score").alias("field_score"),
        F.avg((F.col("field_score") >= 0.25).cast("double")).alias("field_presence"), F.avg(F.col("scene_cut").cast("double")).alias("scene_cut_rate"), F.count("*").alias("sample_count"),
    )
    size = F.least(F.lit(1.0), F.col("width") * F.col("height") / (1920 * 1080))
    sharp = F.least(F.lit(1.0), F.col("sharpness") / 180)
    light = F.greatest(F.lit(0.0), 1 - F.abs(F.col("brightness") - 125) / 125)
    steady = F.greatest(F.lit(0.0), 1 - F.col("scene_cut_rate") * 4)
    score = 100 * (size * 0.24 + sharp * 0.22 + light * 0.14 + F.col("field_score") * 0.20 + F.col("field_presence") * 0.12 + steady * 0.08)
    rows = videos.join(means, "match_id", "left").withColumn("raw", F.coalesce(score, F.lit(0.0)))
    return rows.select(
        "match_id", F.format_string("%dx%d", F.col("width").cast("int"), F.col("height").cast("int")).alias("resolution"), F.round("sharpness", 2).alias("sharpness"), F.round("brightness", 2).alias("brightness"), F.round("field_score", 4).alias("field_score"),
        F.round("field_presence", 4).alias("field_presence"), F.round("scene_cut_rate", 4).alias("scene_cut_rate"), F.coalesce("sample_count", F.lit(0)).alias("sample_count"), F.round("raw", 2).alias("score"), _grade(F.col("raw")).alias("grade"),
    )
