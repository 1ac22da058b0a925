"""Tables of a tracker's state (detections, images) turned into frames of the source recording."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a frame says of each object.
PAYLOAD = ("track_id", "role", "x1", "y1", "x2", "y2", "confidence", "cluster", "shirt_number", "pitch_x", "pitch_y", "role_confidence", "jersey_confidence", "period", "window_index", "side")
ROLES = ("player", "goalkeeper", "referee")


def segment_offsets(windows: DataFrame, separator: int = 0) -> DataFrame:
    """windows(match_id, position, frame_count, ...) with composite_start_frame: frames and separators of those before."""
    w = Window.partitionBy("match_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return windows.withColumn("composite_start_frame", F.coalesce(F.sum(F.col("frame_count") + separator).over(w), F.lit(0)))


def source_clock(frame: Column, fps: float) -> Column:
    return F.least(F.col("source_start_ms") + F.bround((frame - F.col("composite_start_frame")) * 1000.0 / fps).cast("long"), F.col("source_end_ms") - 1)


def locate(detections: DataFrame, segments: DataFrame, fps: float) -> DataFrame:
    """Detections(match_id, frame) with their segment's number seg_index and source time; frames of separators go. A match's
    segments travel as one sorted array, so this is an equal join on match_id and no range join."""
    columns = ["composite_start_frame", "frame_count", "seg_index", "source_start_ms", "source_end_ms"]
    held = segments.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("segments"))
    hit = F.get(F.filter("segments", lambda s: (s["composite_start_frame"] <= F.col("frame")) & (F.col("frame") < s["composite_start_frame"] + s["frame_count"])), F.lit(0))
    rows = detections.join(held, "match_id").withColumn("hit", hit).where("hit is not null")
    rows = rows.select(*detections.columns, "hit.*").withColumn("ts_ms", source_clock(F.col("frame"), fps))
    return rows.drop("composite_start_frame", "frame_count", "source_start_ms", "source_end_ms")


def _finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(F.abs(x) < float("inf"), x)  # no number counts as greater than all numbers


def clean_detections(detections: DataFrame, width: int = 1920, height: int = 1080) -> DataFrame:
    """Valid rows only: a known role (`role`, else `role_detection`), a track number, and a box within the image; cluster 0
    as A and 1 as B, jersey numbers of 0 to 99, pitch places with both numbers, confidence within 0 and 1 (1: unknown).

    What a row is judged by is made once and exploded, so that the filter isn't taken below it with a copy of all that it uses:
    such copies make a method too long for the JVM to compile."""
    known = F.filter(F.array(F.lower(F.trim("role")), F.lower(F.trim("role_detection"))), lambda r: r.isin(*ROLES))
    edge = lambda c, top: F.greatest(F.lit(0.0), F.least(F.lit(float(top)), c))
    left, up, w, h = (_finite(c) for c in ("left_px", "top_px", "w_px", "h_px"))
    made = F.struct(
        F.get(known, F.lit(0)).alias("role"), F.bround(_finite("track_id")).cast("long").cast("string").alias("track_id"), edge(left, width).alias("x1"), edge(up, height).alias("y1"), edge(left + w, width).alias("x2"), edge(up + h, height).alias("y2"),
        _finite("team_cluster").alias("team_cluster"), _finite("jersey_number").alias("jersey_number"), _finite("pitch_x").alias("pitch_x"), _finite("pitch_y").alias("pitch_y"), _finite("confidence").alias("confidence"),
    )
    kept = [c for c in detections.columns if c not in ("role", "role_detection", "left_px", "top_px", "w_px", "h_px", "jersey_number", "pitch_x", "pitch_y", "confidence", "track_id", "team_cluster")]
    rows = detections.select(*kept, F.explode(F.array(made)).alias("d")).select(*kept, "d.*").where("role is not null and track_id is not null and x2 > x1 and y2 > y1")
    both = F.col("pitch_x").isNotNull() & F.col("pitch_y").isNotNull()
    return rows.select(
        *kept, "role", "track_id", F.when(F.col("team_cluster") == 0, "A").when(F.col("team_cluster") == 1, "B").alias("cluster"), "x1", "y1", "x2", "y2",
        F.when(F.col("jersey_number").between(0, 99), F.bround("jersey_number").cast("int")).alias("shirt_number"), F.when(both, F.col("pitch_x")).alias("pitch_x"), F.when(both, F.col("pitch_y")).alias("pitch_y"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(1.0)))).alias("confidence"),
    )


def goal_sides(detections: DataFrame, by: list[str]) -> DataFrame:
    """Per segment the clusters whose goals are left and right, by mean pitch x; no row where a cluster has no place."""
    mean = lambda k: F.avg(F.when(F.col("cluster") == k, F.col("pitch_x")))
    means = detections.groupBy(*by).agg(mean("A").alias("a"), mean("B").alias("b")).where("a is not null and b is not null")
    return means.select(*by, F.when(F.col("a") < F.col("b"), "A").otherwise("B").alias("left_cluster"), F.when(F.col("a") < F.col("b"), "B").otherwise("A").alias("right_cluster"))


def place_goalkeepers(detections: DataFrame, by: list[str]) -> DataFrame:
    """Goalkeepers without a cluster take that of their side (`side` left or right)."""
    rows = detections.join(goal_sides(detections, by), by, "left")
    side = F.when(F.col("side") == "left", F.col("left_cluster")).when(F.col("side") == "right", F.col("right_cluster"))
    return rows.withColumn("cluster", F.when((F.col("role") == "goalkeeper") & F.col("cluster").isNull(), side).otherwise(F.col("cluster"))).drop("left_cluster", "right_cluster")


def best_per_track(detections: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row per frame and track: the most confident, of equals the first in `order`."""
    w = Window.partitionBy(*by).orderBy(F.desc("confidence"), *order)
    return detections.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def frame_runs(objects: DataFrame, segments: DataFrame) -> DataFrame:
    """The frames of every segment as runs: (the segment's columns, frame, frames, objects), a row of frames = 1 for each frame with
    objects and one for each gap between them, by its first frame. Rows grow with the objects and segments, never with the frames
    that hold nothing. Segments of a match don't overlap; objects outside all of them go."""
    part = F.struct("composite_start_frame", "frame_count", "seg_index", "source_start_ms", "source_end_ms")
    packed = objects.groupBy("match_id", "frame").agg(F.array_sort(F.collect_list(F.struct(*(c for c in PAYLOAD if c in objects.columns)))).alias("objects"))
    rows = packed.withColumn("filled", F.lit(1)).unionByName(segments.select("match_id", F.col("composite_start_frame").alias("frame"), F.lit(0).alias("filled"), part.alias("part")), allowMissingColumns=True)
    w = Window.partitionBy("match_id").orderBy("frame", "filled", "part.frame_count")
    rows = rows.withColumn("next", F.lead("frame").over(w)).withColumn("part", F.last("part", True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.select("match_id", "part.*", "frame", "filled", "next", "objects").withColumn("end", F.col("composite_start_frame") + F.col("frame_count")).where("frame < end")
    first, kind = F.col("frame") + F.col("filled"), rows.schema["objects"].dataType
    run = lambda frame, n, o: F.struct(frame.cast("long").alias("frame"), n.cast("long").alias("frames"), o.cast(kind).alias("objects"))
    gap = run(first, F.least("end", F.coalesce("next", "end")) - first, F.lit(None))
    runs = F.array(F.when(F.col("filled") == 1, run(F.col("frame"), F.lit(1), F.col("objects"))), gap)
    rows = rows.select("match_id", "seg_index", "composite_start_frame", "source_start_ms", "source_end_ms", F.explode(runs).alias("run"))
    return rows.where("run.frames > 0").select("match_id", "seg_index", "composite_start_frame", "source_start_ms", "source_end_ms", "run.*")


def filled_frames(objects: DataFrame, segments: DataFrame, fps: float) -> DataFrame:
    """The rows of densify() that hold objects."""
    rows = frame_runs(objects, segments).where("objects is not null")
    return rows.select("match_id", "frame", "seg_index", source_clock(F.col("frame"), fps).alias("ts_ms"), "objects")


def densify(objects: DataFrame, segments: DataFrame, fps: float) -> DataFrame:
    """A row for every frame of every segment with its objects, none for frames without; separators' frames have no row. Empty
    frames are written out where their run is: they are not joined or shuffled."""
    rows = frame_runs(objects, segments).withColumn("frame", F.explode(F.expr("sequence(frame, frame + frames - 1)")))
    return rows.select("match_id", "frame", "seg_index", source_clock(F.col("frame"), fps).alias("ts_ms"), "objects")


def busiest_frame(frames: DataFrame) -> DataFrame:
    """The first of the frames with most objects; of frame_runs(), a gap counts by its first frame."""
    n = F.greatest(F.lit(0), F.coalesce(F.size("objects"), F.lit(0)))
    return frames.groupBy("match_id").agg(F.min(F.struct((-n).alias("n"), "frame")).alias("b")).select("match_id", F.col("b.frame").alias("frame"), (-F.col("b.n")).alias("n"))
