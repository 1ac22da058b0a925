"""Who has the ball: a state for each frame, spans of equal states, and shares of time."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sidelines.functions.columns import changed, clamp, distance, ordered

BY = ["seg"]
#: By pitch: the radius of control, in shares of the image or metres.
RADIUS = {False: 0.055, True: 2.6}
#: A pitch's length and width in metres, and how far past its lines the ball is still in play.
PITCH, MARGIN = (105.0, 68.0), 0.5


def positions(objects: DataFrame) -> DataFrame:
    """Objects with x and y: the place on the pitch where both of its numbers are known, else that in the image, else null."""
    place = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    pick = lambda c: F.when(place("pitch_x", "pitch_y"), F.col(f"pitch_{c}")).when(place("image_x", "image_y"), F.col(f"image_{c}"))
    return objects.withColumn("x", pick("x")).withColumn("y", pick("y"))


def possession(frames: DataFrame, athletes: DataFrame, radius: float | None = None, grace_ms: int = 1500, dwell_ms: int = 250, pitch: bool = False) -> DataFrame:
    """samples of frames(seg, ts_ms, field_score, scene_cut, replay_probability, ball_x, ball_y; no ball: nulls) and
    athletes(seg, ts_ms, obj_ord, team_key, player_key, confidence, x, y), all in one space of coordinates:
    shares of the image, or metres if `pitch`, where a ball past the pitch's lines is out. Samples say the space of the
    places that decided them: those out, contested and controlled in sight of the ball. With a column coordinate_space in
    frames, each frame says itself whether it is in metres (`pitch_meters`). With a column ball_seen, a frame that has a
    ball without a place is unknown and bridges nothing."""
    metres = F.coalesce(F.col("coordinate_space") == "pitch_meters", F.lit(False)) if "coordinate_space" in frames.columns else F.lit(pitch)
    radius = F.when(metres, RADIUS[True]).otherwise(RADIUS[False]) if radius is None else F.lit(radius)
    placeless = F.coalesce("ball_seen", F.lit(False)) if "ball_seen" in frames.columns else F.lit(False)
    d = distance(F.col("ball_x"), F.col("ball_y"), F.col("x"), F.col("y"))
    near = athletes.join(frames.select("seg", "ts_ms", "ball_x", "ball_y"), ["seg", "ts_ms"]).where(d.isNotNull())
    near = near.groupBy("seg", "ts_ms").agg(F.slice(F.array_sort(F.collect_list(F.struct(d.alias("d"), "obj_ord", "team_key", "player_key", "confidence"))), 1, 2).alias("near"))
    one, two = F.get("near", F.lit(0)), F.get("near", F.lit(1))
    dead = F.col("scene_cut") | (F.col("replay_probability") >= 0.65) | (F.col("field_score") < 0.14)
    contested = (one["team_key"] != two["team_key"]) & (two["d"] <= radius * 1.15) & (two["d"] - one["d"] <= radius * 0.25)
    inside = F.col("ball_x").between(-MARGIN, PITCH[0] + MARGIN) & F.col("ball_y").between(-MARGIN, PITCH[1] + MARGIN)
    step = (
        F.when(dead, "dead")
        .when((F.col("ball_x").isNull() | F.col("ball_y").isNull()) & placeless, "no_place")
        .when(F.col("ball_x").isNull() | F.col("ball_y").isNull(), "no_ball")
        .when(metres & ~inside, "out")
        .when(one.isNull() | (one["d"] > radius), "loose")
        .when(F.coalesce(contested, F.lit(False)), "contested")
        .otherwise("proposal")
    )
    rows = frames.join(near, ["seg", "ts_ms"], "left").withColumn("step", step)
    w, wp = ordered(BY, "ts_ms"), ordered(["seg", "offered"], "ts_ms")
    rows = rows.withColumn("offered", F.col("step") == "proposal").withColumn("owner", F.when(F.col("offered"), F.struct(one["team_key"].alias("team_key"), one["player_key"].alias("player_key"))))
    first = F.row_number().over(wp) == 1
    new = first | ~F.lag("owner").over(wp).eqNullSafe(F.col("owner"))
    rows = rows.withColumn("new", new).withColumn("since", F.last(F.when(F.col("new"), F.col("ts_ms")), True).over(wp))
    promoted = F.col("offered") & (first | (~F.col("new") & (F.col("ts_ms") - F.col("since") >= dwell_ms)))
    rows = rows.withColumn("current", F.last(F.when(promoted, F.col("owner")), True).over(w))
    seen = F.when(~F.col("step").isin("dead", "no_ball", "no_place"), F.struct("ts_ms", "ball_x", "ball_y"))
    rows = rows.withColumn("seen", F.last(seen, True).over(w))
    bridged = (F.col("step") == "no_ball") & (F.col("ts_ms") - F.col("seen.ts_ms") <= grace_ms) & F.col("current").isNotNull()
    held = F.coalesce(bridged, F.lit(False)) | F.col("offered")
    state = F.when(held, "controlled").when(F.col("step").isin("out", "loose", "contested"), F.col("step")).otherwise("unknown")
    confidence = (
        F.when(F.col("step") == "dead", F.greatest(F.lit(0.45), 1 - F.col("field_score")))
        .when(F.col("step") == "no_ball", F.when(held, 0.35).otherwise(0.15))
        .when(F.col("step") == "no_place", 0.1)
        .when(F.col("step") == "out", 0.76)
        .when(F.col("step") == "loose", 0.5)
        .when(F.col("step") == "contested", 0.58)
        .otherwise(clamp(one["confidence"] * (1 - one["d"] / radius), 0.25, 0.98))
    )
    x = lambda c: F.when(F.col("step").isin("dead", "no_place"), None).when(F.col("step") == "no_ball", F.when(held, F.col(f"seen.{c}"))).otherwise(F.col(c))
    return rows.select(
        "seg",
        "ts_ms",
        state.alias("state"),
        F.when(held, F.col("current.team_key")).alias("team_key"),
        F.when(held, F.col("current.player_key")).alias("player_key"),
        x("ball_x").alias("ball_x"),
        x("ball_y").alias("ball_y"),
        confidence.alias("confidence"),
        F.when(F.col("step") == "dead", "broadcast_not_live").when(F.col("step") == "out", "pitch_boundary").alias("reason"),
        F.when(F.col("step").isin("out", "contested", "proposal"), F.when(metres, "pitch_meters").otherwise("image_normalized")).alias("coordinate_space"),
        F.when(F.col("step") == "contested", F.transform("near", lambda a: F.struct(a["team_key"].alias("team_key"), a["player_key"].alias("player_key")))).alias("contenders"),
    )


def gap_of(fps: Column) -> Column:
    """The longest gap within a span at a tracking rate."""
    return F.greatest(F.lit(1000), (2500 / fps).cast("int"))


def compress(samples: DataFrame, max_gap_ms: int | str = 1000) -> DataFrame:
    """Spans of samples with one state, team and player and gaps of max_gap_ms at most, a number or a column of samples that
    has one value in a segment."""
    w = ordered(BY, "ts_ms")
    samples = samples.withColumn("max_gap", F.col(max_gap_ms) if isinstance(max_gap_ms, str) else F.lit(max_gap_ms))
    max_gap_ms = F.col("max_gap")
    gap = F.col("ts_ms") - F.lag("ts_ms").over(w)
    rows = samples.withColumn("gap", gap).withColumn("next_ms", F.lead("ts_ms").over(w))
    rows = rows.withColumn("new", (changed(BY, "ts_ms", "state", "team_key", "player_key") | (F.col("gap") > max_gap_ms)).cast("int"))
    usual = F.percentile(F.when((F.col("gap") > 0) & (F.col("gap") <= max_gap_ms), F.col("gap")), F.lit(0.5)).over(Window.partitionBy(*BY))
    rows = rows.withColumn("span", F.sum("new").over(w)).withColumn("usual", F.coalesce(usual.cast("long"), F.lit(0)))
    spans = rows.groupBy("seg", "span", "state", "team_key", "player_key", "max_gap", "usual").agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("last_ms"), F.max_by(F.coalesce("next_ms", F.lit(1 << 60)), "ts_ms").alias("next_ms"), F.avg("confidence").alias("confidence"))
    end = F.when(F.col("next_ms") - F.col("last_ms") <= max_gap_ms, F.col("next_ms")).otherwise(F.col("last_ms") + F.col("usual"))
    return spans.select("seg", "start_ms", end.alias("end_ms"), "state", "team_key", "player_key", "confidence")


def clip_spans(spans: DataFrame, windows: DataFrame) -> DataFrame:
    """Spans that end at their window's end at latest, with both clocks. windows(seg, end_ms, period_start_ms, clock_start_ms)."""
    rows = spans.join(windows.withColumnRenamed("end_ms", "window_end"), "seg").withColumn("end_ms", F.least("end_ms", "window_end"))
    match = lambda c: F.col("clock_start_ms") + F.greatest(F.lit(0), F.col(c) - F.col("period_start_ms"))
    return rows.select(spans.columns + [match("start_ms").alias("match_start_ms"), match("end_ms").alias("match_end_ms")])


def possession_stats(spans: DataFrame, by: str = "seg") -> DataFrame:
    """Seconds in play, and each team's seconds and share of controlled time. A team without any has no row."""
    long = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))
    held = (F.col("state") == "controlled") & F.col("team_key").isNotNull()
    rows = spans.withColumn("ms", long)
    sums = rows.groupBy(by, "team_key").agg(F.sum(F.when(F.col("state").isin("controlled", "contested", "loose"), F.col("ms"))).alias("in_play"), F.sum(F.when(held, F.col("ms"))).alias("own"))
    whole = Window.partitionBy(by)
    teams = sums.withColumn("in_play", F.sum("in_play").over(whole)).withColumn("all", F.sum("own").over(whole)).where("own is not null")
    return teams.select(by, "team_key", F.round(F.col("in_play") / 1000, 1).alias("ball_in_play_seconds"), F.round(F.col("own") / 1000, 1).alias("possession_seconds"), F.round(100 * F.col("own") / F.greatest(F.lit(1), F.col("all")), 2).alias("possession_pct"))
