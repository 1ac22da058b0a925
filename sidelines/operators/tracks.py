"""Tracks summed up from their observations."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def qualify_ids(objects: DataFrame) -> DataFrame:
    """track_id as p{period}-w{window}-{track}, `o` before officials' own; the ball's stays. player_key follows athletes'."""
    own = F.when(F.col("role") == "referee", F.concat(F.lit("o"), "track_id")).otherwise(F.col("track_id").cast("string"))
    full = F.when(F.col("role") == "ball", own).otherwise(F.concat(F.lit("p"), "period", F.lit("-w"), "window_index", F.lit("-"), own))
    return objects.withColumn("player_key", F.when(F.col("role").isin("player", "goalkeeper"), full)).withColumn("track_id", full)


def majority(objects: DataFrame, column: str, by: list[str] = ["seg", "track_id"]) -> DataFrame:  # noqa: B006
    """The column's most frequent value per track, of equals the one seen first; tracks without a value have no row."""
    counts = objects.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"), F.min("ts_ms").alias("first"))
    return counts.groupBy(*by).agg(F.min_by(column, F.struct(-F.col("n"), "first", column)).alias(column))


def track_summary(objects: DataFrame) -> DataFrame:
    """Per track: role at first sight, first and last time, observations, mean confidence, majorities, and the identity
    confidence, which is the mean of each observation's least known confidence."""
    parts = [F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c))) for c in ("confidence", "reid_confidence", "role_confidence", "team_confidence", "jersey_confidence") if c in objects.columns]
    least = F.least(*parts) if len(parts) > 1 else parts[0]
    found = objects.groupBy("seg", "track_id").agg(F.min_by("role", "ts_ms").alias("role"), F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.count("*").alias("samples"), F.avg("confidence").alias("confidence"), F.avg(least).alias("identity_confidence"))
    for column in ("team_key", "shirt_number"):
        if column in objects.columns:
            found = found.join(majority(objects, column), ["seg", "track_id"], "left")
    return found


def trajectories(objects: DataFrame, cap: int = 2000) -> DataFrame:
    """Each track's first `cap` places in order of time, on the pitch where known, else in the image."""
    pitch = F.col("pitch_x").isNotNull() & F.col("pitch_y").isNotNull()
    point = F.struct("ts_ms", F.when(pitch, F.col("pitch_x")).otherwise(F.col("image_x")).alias("x"), F.when(pitch, F.col("pitch_y")).otherwise(F.col("image_y")).alias("y"), F.when(pitch, "pitch_meters").otherwise("image_normalized").alias("space"))
    rows = objects.withColumn("i", F.row_number().over(Window.partitionBy("seg", "track_id").orderBy("ts_ms"))).where(F.col("i") <= cap)
    return rows.groupBy("seg", "track_id").agg(F.array_sort(F.collect_list(point)).alias("points"))


def heatmap(paths: DataFrame, assignments: DataFrame, cap: int = 5000, by: tuple[str, ...] = ("match_id", "run_id")) -> DataFrame:
    """The first `cap` points of each player in a match and run over the assigned tracks' paths(seg, track_id, by, points), in
    order of segment, track and time. Lengths of paths are summed up first, a row a track; only the points that count are
    then taken out of their paths."""
    rows = paths.join(assignments.where("player_id is not null").select("seg", "track_id", "player_id"), ["seg", "track_id"])
    lengths = rows.select("seg", "track_id", *by, "player_id", F.size("points").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by, "player_id").orderBy("seg", "track_id").rowsBetween(Window.unboundedPreceding, -1))
    starts = lengths.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < cap).select("seg", "track_id", *by, "player_id", "_before")
    kept = paths.select("seg", "track_id", "points").join(starts, ["seg", "track_id"]).select(*by, "player_id", F.struct("_before", F.slice("points", 1, (F.lit(cap) - F.col("_before")).cast("int")).alias("points")).alias("p"))
    return kept.groupBy(*by, "player_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["points"])).alias("heatmap"))


def heat_grid(objects: DataFrame, by: list[str], columns: int = 12, lines: int = 8) -> DataFrame:
    """Observations per cell of a grid over the image, for each group."""
    cell = lambda c, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(F.col(c) * n))).cast("int")
    return objects.where("image_x is not null and image_y is not null").groupBy(*by, cell("image_x", columns).alias("cell_x"), cell("image_y", lines).alias("cell_y")).agg(F.count("*").alias("n"))


def team_observations(objects: DataFrame, by: str = "seg") -> DataFrame:
    athletes = objects.where(F.col("role").isin("player", "goalkeeper"))
    known = F.coalesce("team_key", F.lit("unknown"))
    return athletes.groupBy(by).agg(*(F.count_if(known == t).alias(t) for t in ("home", "away", "unknown")))
