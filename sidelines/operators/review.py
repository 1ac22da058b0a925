"""Runs, review of events and tracks, and the tables behind their pages."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CORRECTED = ("event_type", "team_key", "player_id", "recipient_id", "outcome", "start_x", "start_y", "end_x", "end_y")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each match by created_at, of equals the greatest run_id."""
    best = F.max_by(F.struct(*runs.columns), F.struct("created_at", "run_id"))
    return runs.groupBy("match_id").agg(best.alias("r")).select("r.*")


def dashboard(matches: DataFrame, events: DataFrame) -> DataFrame:
    """matches with their numbers of events, pending and not rejected ones; zero without any."""
    counts = events.groupBy("match_id").agg(F.count("*").alias("events"), F.count_if(F.col("review_status") == "pending").alias("pending"), F.count_if(F.col("review_status") != "rejected").alias("standing"))
    return matches.join(counts, "match_id", "left").fillna(0, ["events", "pending", "standing"])


def status_totals(matches: DataFrame) -> DataFrame:
    return matches.groupBy("status").agg(F.count("*").alias("matches"))


def timeline(events: DataFrame, filters: dict[str, str] | None = None, most: int = 500) -> DataFrame:
    """Each run's first `most` events (the page's length) that have the filters' values, by time and id."""
    for column, value in (filters or {}).items():
        events = events.where(F.col(column) == value)
    w = Window.partitionBy("run_id").orderBy("ts_ms", "event_id")
    return events.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def passing_samples(runs: DataFrame, most: int = 25) -> DataFrame:
    """The newest run of each match, among its last `most`, that is a finished and approved sample of the present setup."""
    w = Window.partitionBy("match_id").orderBy(F.desc("created_at"), F.desc("run_id"))
    rows = runs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    fine = (F.col("mode") == "sample") & F.col("status").isin("review", "completed") & ((F.col("verdict") == "pass") | F.coalesce("approved", F.lit(False))) & ~F.coalesce("stale", F.lit(False))
    return latest_runs(rows.where(fine).drop("place"))


def eligible_matches(matches: DataFrame, periods: DataFrame, runs: DataFrame, mode: str = "full", engine_ready: bool = True) -> DataFrame:
    """Matches that may have a run of a mode (prepare, reference, sample or full) now: none is under way; all modes but prepare
    need two confirmed periods and a ready engine, and a full run needs a passing sample too."""
    rows = matches.join(runs.where(F.col("status").isin("queued", "running")), "match_id", "left_anti")
    if mode != "prepare":
        ready = periods.where("confirmed").groupBy("match_id").agg(F.count("*").alias("n")).where("n = 2")
        rows = rows.where(F.lit(engine_ready)).join(ready, "match_id", "left_semi")
    return rows.join(passing_samples(runs), "match_id", "left_semi") if mode == "full" else rows


def of_latest_run(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """The rows of each match's latest run; all rows of a match without any."""
    newest = latest_runs(runs).select("match_id", F.col("run_id").alias("_newest"))
    return rows.join(newest, "match_id", "left").where("_newest is null or run_id = _newest").drop("_newest")


def approve(runs: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, errors): approval by hand of asked(run_id), for finished samples of the present setup only."""
    fine = (F.col("mode") == "sample") & F.col("status").isin("review", "completed") & ~F.coalesce("stale", F.lit(False))
    rows = runs.join(asked.select("run_id", F.lit(True).alias("asked")).distinct(), "run_id", "left")
    done = rows.withColumn("approved", F.coalesce("approved", F.lit(False)) | (F.coalesce("asked", F.lit(False)) & F.coalesce(fine, F.lit(False))))
    return done.select(runs.columns), rows.where(F.col("asked") & ~F.coalesce(fine, F.lit(False))).select("run_id", F.lit("not_approvable").alias("rule"))


def apply_reviews(events: DataFrame, actions: DataFrame) -> DataFrame:
    """Events after all of actions(event_id, acted_at, action_id, action, new values), in order of acted_at and action_id. The
    last one of any known kind gives the status; each field keeps the value of the last correction that has one for it, also
    after it was accepted or rejected, and one correction makes the source `human`. Actions of unknown kinds change nothing."""
    known = actions.where(F.col("action").isin("accept", "reject", "correct"))
    new = [c for c in CORRECTED if c in actions.columns and c in events.columns]
    order, correct = F.struct("acted_at", "action_id"), F.col("action") == "correct"
    values = [F.max_by(c, F.when(correct & F.col(c).isNotNull(), order)).alias(f"new_{c}") for c in new]
    log = known.groupBy("event_id").agg(F.max_by("action", order).alias("last"), F.bool_or(correct).alias("corrected"), *values)
    rows = events.join(log, "event_id", "left")
    for c in new:
        rows = rows.withColumn(c, F.coalesce(f"new_{c}", c))
    status = F.when(F.col("last") == "accept", "validated").when(F.col("last") == "reject", "rejected").when(F.col("last") == "correct", "corrected").otherwise(F.col("review_status"))
    return rows.withColumn("review_status", status).withColumn("source", F.when(F.col("corrected"), "human").otherwise(F.col("source"))).select(events.columns)


def finalise_events(candidates: DataFrame, backend: str = "yolo") -> DataFrame:
    """Candidates as stored: confidence within 0 and 1, accepted at once from 0.92 unless heuristic, visibility, source."""
    rows = candidates.withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence"))))
    accepted = (F.col("confidence") >= 0.92) & F.lit(backend != "heuristic")
    return rows.withColumn("visibility", F.when(F.col("confidence") >= 0.75, "full").otherwise("partial")).withColumn("review_status", F.when(accepted, "auto_accepted").otherwise("pending")).withColumn("source", F.lit("ai")).withColumn("model_version", F.lit(f"{backend}-baseline-v1"))


def resolve(rows: DataFrame, tracks: DataFrame, columns: tuple[str, ...] = ("player", "recipient")) -> DataFrame:
    """rows(seg, player_key, recipient_key) with player_id and recipient_id of tracks(seg, track_id, player_id)."""
    for c in columns:
        side = tracks.select("seg", F.col("track_id").alias(f"{c}_key"), F.col("player_id").alias(f"{c}_id"))
        rows = rows.join(side, ["seg", f"{c}_key"], "left")
    return rows


def assign_tracks(tracks: DataFrame, asked: DataFrame, players: DataFrame, teams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tracks, errors) of tracks(seg, track_id, team_id, player_id, identity_confidence) after asked(seg, track_id, player_id;
    one row a track, null player: none). The player of players(player_id, team_id) must play for one of the match's
    teams(seg, team_id), and for the track's own where that is known. A track's team stays as it is; its identity is sure (1)
    with a player and open (0) without. Events and spans follow through `follow`."""
    rows = asked.join(players.select("player_id", F.col("team_id").alias("their_team")), "player_id", "left")
    rows = rows.join(teams.select("seg", F.col("team_id").alias("their_team"), F.lit(True).alias("plays")).distinct(), ["seg", "their_team"], "left")
    rows = rows.join(tracks.select("seg", "track_id", F.col("team_id").alias("own_team"), F.lit(True).alias("found")), ["seg", "track_id"], "left")
    rule = F.when(F.col("found").isNull(), "track").when(F.col("player_id").isNotNull() & F.col("plays").isNull(), "player").when(F.col("player_id").isNotNull() & (F.col("their_team") != F.col("own_team")), "team")
    rows = rows.withColumn("rule", rule)
    good = rows.where("rule is null").select("seg", "track_id", F.col("player_id").alias("new_player"), F.lit(True).alias("given"))
    done = tracks.join(good, ["seg", "track_id"], "left").withColumn("player_id", F.when(F.col("given"), F.col("new_player")).otherwise(F.col("player_id")))
    sure = F.when(F.col("given"), F.col("new_player").isNotNull().cast("double")).otherwise(F.col("identity_confidence"))
    return done.withColumn("identity_confidence", sure).select(tracks.columns), rows.where("rule is not null").select("seg", "track_id", "player_id", "rule")


def follow(rows: DataFrame, asked: DataFrame, columns: tuple[str, ...] = ("player", "recipient")) -> DataFrame:
    """Stored rows(seg, player_key, player_id, ...) after good asked(seg, track_id, player_id): those of an asked track take its
    player, or none; all others keep theirs. Spans have the `player` only."""
    for c in columns:
        side = asked.select("seg", F.col("track_id").alias(f"{c}_key"), F.col("player_id").alias("_new"), F.lit(True).alias("_given"))
        rows = rows.join(side, ["seg", f"{c}_key"], "left").withColumn(f"{c}_id", F.when(F.col("_given"), F.col("_new")).otherwise(F.col(f"{c}_id"))).drop("_new", "_given")
    return rows


def unassigned(tracks: DataFrame, by: str = "seg") -> DataFrame:
    return tracks.groupBy(by).agg(F.count_if(F.col("player_id").isNull()).alias("unassigned"))


def listed_tracks(tracks: DataFrame, most: int = 300) -> DataFrame:
    """The page's first `most` tracks of each segment by team, shirt and id."""
    w = Window.partitionBy("seg").orderBy("team_key", "shirt_number", "track_id")
    return tracks.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def swap_groups(matches: DataFrame, asked: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches, runs) with home_cluster A and B swapped for asked(match_id), whose sample runs become stale."""
    keys = asked.select("match_id", F.lit(True).alias("asked")).distinct()
    swapped = F.when(F.col("asked"), F.when(F.col("home_cluster") == "A", "B").otherwise("A")).otherwise(F.col("home_cluster"))
    hit = F.coalesce(F.col("asked") & (F.col("mode") == "sample"), F.lit(False))
    old = runs.join(keys, "match_id", "left").withColumn("stale", F.coalesce("stale", F.lit(False)) | hit).withColumn("approved", F.coalesce("approved", F.lit(False)) & ~hit)
    return matches.join(keys, "match_id", "left").withColumn("home_cluster", swapped).select(matches.columns), old.select(runs.columns)


def shown_results(matches: DataFrame, runs: DataFrame) -> DataFrame:
    """Matches whose results are shown: their latest run is full and finished."""
    return matches.join(latest_runs(runs).where((F.col("mode") == "full") & F.col("status").isin("review", "completed")), "match_id", "left_semi")


def compare_teams(stats: DataFrame, metrics: list[str]) -> DataFrame:
    """(match_id, metric, home, away) of stats(match_id, team_key, metrics...)."""
    long = stats.unpivot(["match_id", "team_key"], metrics, "metric", "value")
    value = lambda t: F.max(F.when(F.col("team_key") == t, F.col("value"))).alias(t)
    return long.groupBy("match_id", "metric").agg(value("home"), value("away"))


def link_clips(clips: DataFrame) -> DataFrame:
    """(seg, clip, event_id, name): a row for each event of each clip, numbered by start."""
    w = Window.partitionBy("seg").orderBy("start_ms")
    rows = clips.withColumn("clip", F.row_number().over(w))
    return rows.select("seg", "clip", F.explode("event_ids").alias("event_id"), F.format_string("clip-%03d-%s.mp4", "clip", "label").alias("name"))
