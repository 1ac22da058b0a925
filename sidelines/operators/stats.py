"""Counters of events by team or player, and player sheets over tracks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidelines.operators.possession import possession_stats

#: The counter of each event type.
COUNTER = {"pass": "passes", "carry": "carries", "shot": "shots", "goal": "goals", "duel": "duels", "aerial_duel": "duels", "recovery": "recoveries", "loss": "losses", "tackle": "tackles", "interception": "interceptions", "foul": "fouls", "corner": "corners", "offside": "offsides"}
COUNTERS = [*dict.fromkeys(COUNTER.values()), "passes_completed", "progressive_passes", "duels_won", "shots_on_target", "assists"]


def event_stats(events: DataFrame, by: list[str]) -> DataFrame:
    """COUNTERS and pass accuracy for each value of `by`; events without one of them don't count."""
    kind, won = F.col("event_type"), F.coalesce(F.col("outcome") == "success", F.lit(False))
    tagged = lambda t: F.coalesce(F.array_contains("qualifiers", t), F.lit(False))
    when = {c: kind.isin([k for k, v in COUNTER.items() if v == c]) for c in dict.fromkeys(COUNTER.values())}
    when |= {"passes_completed": (kind == "pass") & won, "progressive_passes": (kind == "pass") & tagged("progressive_candidate"), "duels_won": when["duels"] & won, "shots_on_target": (kind == "shot") & tagged("on_target"), "assists": (kind == "pass") & tagged("assist")}
    rows = events.dropna(subset=by).groupBy(*by).agg(*(F.count_if(when[c]).alias(c) for c in COUNTERS))
    return rows.withColumn("pass_accuracy_pct", F.when(F.col("passes") > 0, F.round(100.0 * F.col("passes_completed") / F.col("passes"), 2)).otherwise(0.0))


#: All metrics of a sheet, each 0 by default.
METRICS = ["possession_pct", "ball_in_play_seconds", "possession_seconds", "pass_accuracy_pct", *COUNTERS]


def effective_minutes(spans: DataFrame, by: str = "seg") -> DataFrame:
    """Minutes with the ball in play; none without such a span."""
    ms = F.sum(F.when(F.col("state").isin("controlled", "contested", "loose"), F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))))
    return spans.groupBy(by).agg(F.round(F.coalesce(ms, F.lit(0)) / 60_000, 2).alias("minutes_played"))


def team_sheets(teams: DataFrame, events: DataFrame, spans: DataFrame, by: str = "seg") -> DataFrame:
    """A row of minutes and METRICS for each of teams(by, team_key), blank where it has no event or span."""
    rows = teams.select(by, "team_key").join(event_stats(events, [by, "team_key"]), [by, "team_key"], "left").join(possession_stats(spans, by), [by, "team_key"], "left")
    rows = rows.join(effective_minutes(spans, by), by, "left").fillna(0)
    return rows.select(by, "team_key", "minutes_played", *METRICS)


def _accuracy(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pass_accuracy_pct", F.when(F.col("passes") > 0, F.round(100.0 * F.col("passes_completed") / F.col("passes"), 2)).otherwise(0.0))


def player_rollup(track_stats: DataFrame, assignments: DataFrame, by: tuple[str, ...] = ("match_id", "run_id")) -> DataFrame:
    """A sheet for each player of each match and run: sums of the counters of the tracks assigned to it, their number n_tracks
    and total length tracked_ms, accuracy anew and minutes. track_stats(seg, track_id, by, start_ms, end_ms, counters),
    assignments(seg, track_id, player_id; null: none)."""
    long = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))
    rows = track_stats.join(assignments.where("player_id is not null").select("seg", "track_id", "player_id"), ["seg", "track_id"])
    return finished(rows.groupBy(*by, "player_id").agg(*(F.sum(c).alias(c) for c in COUNTERS), F.count("*").alias("n_tracks"), F.sum(long).alias("tracked_ms")))


def finished(sheets: DataFrame) -> DataFrame:
    """Sheets with what follows from their sums."""
    return _accuracy(sheets).withColumn("minutes", F.col("tracked_ms") / 60_000)


def move_tracks(sheets: DataFrame, track_stats: DataFrame, before: DataFrame, after: DataFrame, by: tuple[str, ...] = ("match_id", "run_id")) -> tuple[DataFrame, DataFrame]:
    """(changed, gone): the kept sheets that change as tracks move from before to after, assignments(seg, track_id, player_id;
    null or no row: none), and those (by, player_id) left without a track.

    A moved track is subtracted from one sheet and added to another, so only moved tracks' counters and the sheets they touch
    are read; sums are of whole numbers, hence equal to a recount however often tracks move. Write both through
    `sources.results.merge`."""
    old = before.select("seg", "track_id", F.col("player_id").alias("old"))
    moved = after.select("seg", "track_id", F.col("player_id").alias("new")).join(old, ["seg", "track_id"], "full").where(~F.col("old").eqNullSafe(F.col("new")))
    signed = F.explode(F.array(F.struct(F.col("old").alias("player_id"), F.lit(-1).alias("sign")), F.struct(F.col("new").alias("player_id"), F.lit(1).alias("sign"))))
    rows = track_stats.join(moved.select("seg", "track_id", signed.alias("m")), ["seg", "track_id"]).where("m.player_id is not null")
    long = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))
    sums = [*COUNTERS, "n_tracks", "tracked_ms"]
    own = {c: F.col(c) for c in COUNTERS} | {"n_tracks": F.lit(1), "tracked_ms": long}
    deltas = rows.groupBy(*by, F.col("m.player_id").alias("player_id")).agg(*(F.sum(F.col("m.sign") * own[c]).alias(f"d_{c}") for c in sums))
    new = deltas.join(sheets.select(*by, "player_id", *sums), [*by, "player_id"], "left")
    new = new.select(*by, "player_id", *((F.coalesce(c, F.lit(0)) + F.col(f"d_{c}")).alias(c) for c in sums))
    return finished(new.where("n_tracks > 0")), new.where("n_tracks <= 0").select(*by, "player_id")
