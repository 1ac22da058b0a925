"""Diagnostics and verdicts of runs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_diagnostics(frames: DataFrame, teams: DataFrame, tracks: DataFrame, windows: DataFrame, by: str = "run_id") -> DataFrame:
    """Averages, shares and a verdict per run. frames(by, raw_athletes, athletes, ball_visible, live, state), one row a frame;
    teams(by, home, away, unknown); tracks(by, tracks); windows(by, duration_ms). A run without frames has no row."""
    count = lambda c, name: F.sum(F.col(c).cast("long")).alias(name)
    playable = F.count_if(F.col("state").isin("controlled", "contested", "loose")).alias("playable")
    rows = frames.groupBy(by).agg(F.count("*").alias("frames"), count("raw_athletes", "raw"), count("athletes", "tracked"), count("ball_visible", "ball"), count("live", "live"), playable)
    rows = rows.join(teams, by, "left").join(tracks, by, "left").join(windows, by, "left").fillna(0, ["home", "away", "unknown", "tracks", "duration_ms"])
    share = lambda a, b: 100.0 * F.col(a) / F.greatest(b if not isinstance(b, str) else F.col(b), F.lit(1))
    known = F.col("home") + F.col("away")
    minutes = F.greatest(F.col("duration_ms") / 60_000, F.lit(1 / 60))
    rows = rows.select(
        by, "frames", F.round(F.col("duration_ms") / 1000, 1).alias("duration_seconds"), F.round(F.col("raw") / F.col("frames"), 2).alias("average_athletes_per_frame"), F.round(F.col("tracked") / F.col("frames"), 2).alias("average_tracked_athletes_per_frame"),
        F.round(share("tracked", "raw"), 2).alias("tracker_retention_pct"), F.round(share("ball", "frames"), 2).alias("ball_visibility_pct"), F.round(share("live", "frames"), 2).alias("field_live_pct"), F.round(share("playable", "frames"), 2).alias("playable_candidate_pct"),
        "tracks", F.round(F.col("tracks") / minutes, 2).alias("tracks_per_minute"), F.round(share("home", known), 2).alias("home_team_share_pct"), F.round(share("away", known), 2).alias("away_team_share_pct"), known.alias("known_team_observations"),
    )
    return verdict(rows)


def verdict(rows: DataFrame) -> DataFrame:
    """Rows of run_diagnostics with issues (failures first) and verdict: fail, warning or pass."""
    c = F.col
    few_known = c("known_team_observations") < F.greatest(F.lit(50), c("frames"))
    failures = F.array(
        F.when(c("frames") < 50, "few_frames"),
        F.when(c("average_athletes_per_frame") < 6, "few_detections").when(c("average_tracked_athletes_per_frame") < 6, "few_tracked"),
        F.when(c("ball_visibility_pct") < 10, "ball_rarely_visible"),
        F.when(c("playable_candidate_pct") < 10, "little_play"),
        F.when(~few_known & (F.least("home_team_share_pct", "away_team_share_pct") < 15), "unbalanced_teams"),
        F.when(c("tracks_per_minute") > 80, "fragmented_tracks"),
    )
    warnings = F.array(F.when(few_known, "few_known_teams"), F.when((c("tracks_per_minute") > 50) & (c("tracks_per_minute") <= 80), "fragile_tracks"))
    rows = rows.withColumn("failures", F.array_compact(failures)).withColumn("warnings", F.array_compact(warnings))
    level = F.when(F.size("failures") > 0, "fail").when(F.size("warnings") > 0, "warning").otherwise("pass")
    return rows.withColumn("verdict", level).withColumn("issues", F.concat("failures", "warnings")).drop("failures", "warnings")


def gate_coverage(diagnostics: DataFrame, coverage: DataFrame, by: str = "run_id") -> DataFrame:
    """Diagnostics with the external frames that are missing; a run that lacks too many fails, and that is its first issue.
    coverage(by, missing_frames, failed); runs without a row there used no external frames."""
    rows = diagnostics.join(coverage.select(by, "missing_frames", "failed"), by, "left").fillna({"missing_frames": 0, "failed": False})
    issues = F.when(F.col("failed"), F.concat(F.array(F.lit("external_coverage")), "issues")).otherwise(F.col("issues"))
    return rows.withColumn("issues", issues).withColumn("verdict", F.when(F.col("failed"), "fail").otherwise(F.col("verdict"))).drop("failed")


def finish_status(runs: DataFrame, periods: DataFrame, events: DataFrame) -> DataFrame:
    """runs(run_id, match_id, mode, backend, grade) with status review or completed."""
    unsure = periods.groupBy("match_id").agg(F.bool_or(~F.col("confirmed")).alias("unconfirmed"))
    pending = events.where("review_status = 'pending'").select("run_id").distinct().withColumn("pending", F.lit(True))
    rows = runs.join(unsure, "match_id", "left").join(pending, "run_id", "left").fillna(False, ["unconfirmed", "pending"])
    review = (F.col("mode") != "full") | (F.col("backend") == "heuristic") | F.col("grade").isin("C", "reject") | F.col("unconfirmed") | F.col("pending")
    return rows.withColumn("status", F.when(review, "review").otherwise("completed")).withColumn("limitations", limitations(F.col("unconfirmed"))).drop("unconfirmed", "pending")


def limitations(unconfirmed):
    return F.array_compact(F.array(F.when(F.col("backend") == "heuristic", "diagnostic_mode"), F.when(unconfirmed, "periods_unconfirmed"), F.when(F.col("grade").isin("C", "reject"), "quality_limits"), F.lit("one_camera")))
