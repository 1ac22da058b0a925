"""Sampling, clocks, tracking windows and joins by nearest time. Times are whole milliseconds."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sidelines.functions.streams import sorted_fold

#: Where the windows of a half lie, as a share of the time that is free, by windows per half.
POSITIONS = {1: (0.5,), 2: (0.25, 0.7), 3: (0.18, 0.5, 0.78), 4: (0.1, 0.36, 0.64, 0.9)}


def sample_timestamps(spans: DataFrame, interval_ms: float, max_samples: int) -> DataFrame:
    """Spans with a row per sample time ts_ms: evenly spaced, at most max_samples a span, all before its end."""
    length = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))
    step = F.greatest(F.lit(float(interval_ms)), length / max_samples)
    count = F.least(F.lit(max_samples), F.ceil(length / step)).cast("int")
    rows = spans.withColumn("step", step).withColumn("i", F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1))))
    rows = rows.withColumn("ts_ms", F.col("start_ms") + (F.col("i") * F.col("step")).cast("long"))
    return rows.where("ts_ms < end_ms").drop("step", "i")


def decimate(frames: DataFrame, fps: float, by: list[str] = ["seg"]) -> DataFrame:  # noqa: B006
    """The first frame of each cell of a fixed grid of 1000 / fps ms that begins at the first frame, so it cannot drift."""
    start = F.min("ts_ms").over(Window.partitionBy(*by))
    rows = frames.withColumn("cell", F.floor((F.col("ts_ms") + 1 - start) / (1000.0 / fps)))
    first = F.row_number().over(Window.partitionBy(*by, "cell").orderBy("ts_ms"))
    return rows.withColumn("first", first).where("first = 1").drop("cell", "first")


def repair_clock(frames: DataFrame) -> DataFrame:
    """frames(seg, frame, reported_ms, start_ms, fps) with ts_ms: the reported time if it is not before start_ms and later
    than the frame before, else the frame number's time, and always one native frame after the last at least. Every
    time depends on the one before: a segment is one sorted pass."""

    def begin():
        last = None

        def step(frame: int, reported: float | None, start: int, fps: float) -> tuple[int]:
            nonlocal last
            good = reported is not None and reported == reported and reported >= start and (last is None or reported > last)
            now = int(reported) if good else round(frame * 1000 / fps)
            last = now if last is None or now > last else last + max(1, round(1000 / fps))
            return (last,)

        return step

    return sorted_fold(frames, ["seg"], ["frame"], ["frame", "reported_ms", "start_ms", "fps"], [T.StructField("ts_ms", T.LongType())], begin)


def to_match_time(rows: DataFrame, periods: DataFrame) -> DataFrame:
    """Rows with period and match_ms of the first of periods(match_id, number, start_ms, end_ms, clock_start_ms) that holds
    ts_ms, ends included; outside all: nulls. A match's few periods travel as one array, so rows never multiply."""
    held = periods.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("number", "start_ms", "end_ms", "clock_start_ms"))).alias("held"))
    hit = F.get(F.filter("held", lambda p: (p["start_ms"] <= F.col("ts_ms")) & (F.col("ts_ms") <= p["end_ms"])), F.lit(0))
    found = rows.join(held, "match_id", "left").withColumn("hit", hit)
    return found.withColumn("period", F.col("hit.number")).withColumn("match_ms", F.col("hit.clock_start_ms") + F.col("ts_ms") - F.col("hit.start_ms")).drop("held", "hit")


def tracking_windows(periods: DataFrame, mode: str = "full", window_s: float = 5, per_half: int = 4) -> DataFrame:
    """(match_id, number, window_index, start_ms, end_ms): whole periods, or short windows at fixed places of each."""
    if mode == "full":
        return periods.select("match_id", "number", F.lit(1).alias("window_index"), "start_ms", "end_ms")
    length = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))
    rows = periods.withColumn("length", F.least(F.lit(max(5000, int(window_s * 1000))), length)).withColumn("free", length - F.col("length"))
    places = F.array(*(F.lit(p) for p in POSITIONS[max(1, min(4, per_half))]))
    rows = rows.select("match_id", "number", F.posexplode(places).alias("i", "place"), "start_ms", "length", "free")
    start = F.col("start_ms") + (F.col("free") * F.col("place")).cast("long")
    return rows.select("match_id", "number", (F.col("i") + 1).alias("window_index"), start.alias("start_ms"), (start + F.col("length")).alias("end_ms"))


def effective_fps(requested: Column, native: Column, floor: float = 0.0) -> Column:
    """At least 0.5 and the engine's floor, at most the recording's own rate where that is known."""
    wanted = F.greatest(F.lit(0.5), requested, F.lit(floor))
    return F.round(F.when(native > 0, F.least(wanted, native)).otherwise(wanted), 3)


def frame_tolerance(fps: Column, least_ms: int = 120) -> Column:
    """How far a result's frame may lie from the frame asked for, at the result's rate."""
    return F.greatest(F.lit(least_ms), F.ceil(500 / F.greatest(F.lit(0.1), fps)) + 5)


def estimated_frames(windows: DataFrame, fps: Column | float, by: list[str] = ["match_id"]) -> DataFrame:  # noqa: B006
    """(by, frames): how many frames the windows of tracking_windows() have at a rate, a number or a column of windows."""
    rate = F.max(fps) if isinstance(fps, Column) else F.lit(fps)
    return windows.groupBy(*by).agg(F.ceil(F.sum(F.col("end_ms") - F.col("start_ms")) / 1000 * rate).alias("frames"))


def _nearest(left: DataFrame, right: DataFrame, tolerance_ms: int | str, by: list[str]) -> DataFrame:
    """Left rows with `found` and the columns of asof_nearest()'s right row as near_*. Each column is carried by itself, so that
    those that nobody asks for are neither sorted nor kept."""
    kinds = dict(right.dtypes)
    rows = left.select("*", F.lit(1).alias("side"), *(F.lit(None).cast(kinds[c]).alias(f"r_{c}") for c in kinds))
    rows = rows.unionByName(right.select(*by, "ts_ms", F.lit(0).alias("side"), *(F.col(c).alias(f"r_{c}") for c in kinds)), allowMissingColumns=True)
    held, own = (lambda c: F.when(F.col("side") == 0, F.struct(f"r_{c}")).alias(f"r_{c}")), [c for c in rows.columns if not c.startswith("r_")]
    rows = rows.select(*own, *(held(c) for c in kinds))
    w = Window.partitionBy(*by).orderBy("ts_ms", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = f"over (partition by {', '.join(by)} order by ts_ms, side)"  # of one sort with w
    rows = rows.select("*", *(F.last(f"r_{c}", True).over(w).alias(f"b_{c}") for c in kinds), *(F.expr(f"lead(r_{c}, 1) ignore nulls {after}").alias(f"a_{c}") for c in kinds))
    rows = rows.select(*own, *(F.col(f"{n}_{c}")[f"r_{c}"].alias(f"{n}_{c}") for n in "ab" for c in kinds))
    rows = rows.where("side = 1")
    far = lambda c: F.abs(F.col(f"{c}_ts_ms") - F.col("ts_ms"))
    ahead = F.col("b_ts_ms").isNull() | (far("a") <= far("b"))
    most = F.col(tolerance_ms) if isinstance(tolerance_ms, str) else F.lit(tolerance_ms)
    found = F.coalesce(F.when(ahead, far("a")).otherwise(far("b")) <= most, F.lit(False))
    return rows.select(*left.columns, found.alias("found"), *(F.when(found, F.when(ahead, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))).alias(f"near_{c}") for c in kinds))


def asof_nearest(left: DataFrame, right: DataFrame, tolerance_ms: int | str, by: list[str] = ["seg"]) -> DataFrame:  # noqa: B006
    """Left rows with `near`, a struct of the right row nearest in ts_ms within the tolerance (ties: the later), else null. The
    tolerance is a number or a column of the left rows.
    Both sides pass through one shuffle and one sort, in which the row before and the row after are looked up, so work is linear
    in a segment's rows."""
    rows = _nearest(left, right, tolerance_ms, by)
    return rows.select(*left.columns, F.when(F.col("found"), F.struct(*(F.col(f"near_{c}").alias(c) for c in right.columns))).alias("near"))


def fuse(local: DataFrame, external: DataFrame, tolerance_ms: int | str) -> DataFrame:
    """Local frames(seg, ts_ms, objects array of structs with a role) with the athletes of the nearest external frame and the
    first local ball; `missing` marks frames without an external one, which keep the ball alone. Where both sides have width
    and height, frames whose external one has another size break the `rule` size and take no athlete from it."""
    sizes = ["width", "height"] if {"width", "height"} <= {*local.columns} & {*external.columns} else []
    athletes = F.filter("objects", lambda o: o["role"].isin("player", "goalkeeper", "referee"))
    ball = F.slice(F.filter("objects", lambda o: o["role"] == "ball"), 1, 1)
    rows = _nearest(local.withColumn("objects", ball), external.select("seg", "ts_ms", athletes.alias("objects"), *sizes), tolerance_ms, ["seg"]).withColumn("missing", ~F.col("found"))
    other = F.col("found") & ~F.struct(*sizes).eqNullSafe(F.struct(*(F.col(f"near_{c}").alias(c) for c in sizes))) if sizes else F.lit(False)
    rows = rows.withColumn("rule", F.when(other, "size"))
    taken = F.when(F.col("rule").isNull(), F.col("near_objects"))
    rows = rows.withColumn("objects", F.concat(F.coalesce(taken, F.slice("objects", 1, 0)), "objects"))
    return rows.select(*local.columns, "missing", "rule", F.col("near_ts_ms").alias("source_ms"))


def coverage(frames: DataFrame, by: str = "seg", most: float = 0.05, *more: Column) -> DataFrame:
    """Frames, those without external data, and whether their share fails the run; with any other sums, from the same pass."""
    missing = F.count_if("missing")
    return frames.groupBy(by).agg(F.count("*").alias("frames"), missing.alias("missing_frames"), (missing > most * F.count("*")).alias("failed"), *more)


def progress(batches: DataFrame, low: int = 22, high: int = 68) -> DataFrame:
    """Per run of batches(run_id, start_ms, duration_ms, ts_ms, elapsed_ms): time done, share, speed, time left, percent."""
    found = batches.groupBy("run_id").agg(F.max(F.col("ts_ms") - F.col("start_ms")).alias("done_ms"), F.max("duration_ms").alias("all_ms"), F.max("elapsed_ms").alias("elapsed_ms"), F.count("*").alias("frames"))
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("done_ms") / F.greatest(F.lit(1), F.col("all_ms"))))
    speed = F.col("done_ms") / F.greatest(F.lit(1), F.col("elapsed_ms"))
    left = F.when(speed > 0, F.greatest(F.lit(0), F.col("all_ms") - F.col("done_ms")) / speed)
    return found.select("run_id", "frames", "done_ms", ratio.alias("ratio"), speed.alias("speed"), left.alias("left_ms"), F.floor(low + (high - low) * ratio).alias("percent"))
