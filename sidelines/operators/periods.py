"""The two halves of a recording, found in its field scores, and edits of them by hand."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sidelines.functions.columns import clock_ms, ordered

BY = ["match_id"]
MINUTE = 60_000
HALF_CLOCK_MS = 45 * MINUTE


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("long")


def sample_interval(signals: DataFrame) -> DataFrame:
    """(match_id, interval_ms, samples): the mean of the positive distances, 1000 without any."""
    gap = F.col("ts_ms") - F.lag("ts_ms").over(ordered(BY, "ts_ms"))
    return signals.select("match_id", gap.alias("gap")).groupBy("match_id").agg(F.coalesce(F.avg(F.when(F.col("gap") > 0, F.col("gap"))).cast("long"), F.lit(1000)).alias("interval_ms"), F.count("*").alias("samples"))


def field_blocks(signals: DataFrame, videos: DataFrame, threshold: float = 0.24, bridge_ms: int = 75_000, least_ms: int = 12 * MINUTE) -> DataFrame:
    """Stretches of field samples. A sample off the field ends one if it lies over bridge_ms after the last on it."""
    w = ordered(BY, "ts_ms")
    on = F.when(F.col("field_score") >= threshold, F.col("ts_ms"))
    rows = signals.withColumn("on", on).withColumn("last_on", F.last("on", True).over(w))
    rows = rows.withColumn("block", F.sum((F.col("ts_ms") - F.col("last_on") > bridge_ms).cast("int")).over(w))
    rows = rows.withColumn("open", F.col("block") == F.max("block").over(Window.partitionBy(*BY)))
    found = rows.where("on is not null").groupBy("match_id", "block", "open").agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("last_ms"), F.avg("field_score").alias("confidence"))
    found = found.join(sample_interval(signals), "match_id").join(videos.select("match_id", "duration_ms"), "match_id")
    end = F.col("last_ms") + F.col("interval_ms")
    found = found.withColumn("end_ms", F.when(F.col("open"), F.least("duration_ms", end)).otherwise(end))
    return found.where(F.col("end_ms") - F.col("start_ms") >= least_ms).select("match_id", "start_ms", "end_ms", "confidence")


def central_break(signals: DataFrame, videos: DataFrame, threshold: float = 0.24) -> DataFrame:
    """The best short break near the middle, as both halves around it; no row without one."""
    w = ordered(BY, "ts_ms")
    rows = signals.join(videos.select("match_id", "duration_ms"), "match_id").join(sample_interval(signals), "match_id").where("samples >= 8 and duration_ms > 0")
    rows = rows.withColumn("on", F.col("field_score") >= threshold).withColumn("share", F.col("on").cast("double"))
    before, after = F.avg("share").over(w.rangeBetween(-4 * MINUTE, 0)), F.avg("share").over(w.rangeBetween(0, 4 * MINUTE))
    rows = rows.withColumn("before", F.struct("ts_ms", "on", before.alias("ratio"))).withColumn("after", F.struct("ts_ms", "on", after.alias("ratio")))
    rows = rows.withColumn("before", F.lag("before").over(w)).withColumn("after", F.lead("after").over(w))
    middle = (F.col("ts_ms") >= (F.col("duration_ms") * 0.35).cast("long")) & (F.col("ts_ms") <= (F.col("duration_ms") * 0.65).cast("long"))
    rows = rows.withColumn("off", middle & ~F.col("on"))
    rows = rows.withColumn("run", F.sum((F.col("off") & ~F.coalesce(F.lag("off").over(w), F.lit(False))).cast("int")).over(w))
    runs = rows.where("off").groupBy("match_id", "run", "duration_ms", "interval_ms").agg(F.min_by("before", "ts_ms").alias("before"), F.max_by("after", "ts_ms").alias("after"))
    long = F.col("after.ts_ms") - F.col("before.ts_ms")
    runs = runs.where(F.col("before.on") & F.col("after.on")).withColumn("long", long)
    runs = runs.where((F.col("long") >= F.greatest(F.lit(20_000), (F.col("interval_ms") * 1.8).cast("long"))) & (F.col("long") <= 20 * MINUTE) & (F.least("before.ratio", "after.ratio") >= 0.45))
    central = F.greatest(F.lit(0.0), 1 - F.abs((F.col("before.ts_ms") + F.col("after.ts_ms")) / 2 - F.col("duration_ms") / 2) / F.greatest(F.lit(1.0), F.col("duration_ms") * 0.15))
    score = central * 0.55 + F.least(F.lit(1.0), F.col("long") / 120_000) * 0.25 + (F.col("before.ratio") + F.col("after.ratio")) / 2 * 0.20
    runs = runs.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc("score"), "before.ts_ms"))).where("rank = 1")
    ends = signals.where(F.col("field_score") >= threshold).groupBy("match_id").agg(F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))
    found = runs.join(ends, "match_id").withColumn("end_ms", F.least("duration_ms", F.col("last_ms") + F.col("interval_ms")))
    found = found.select("match_id", F.col("first_ms").alias("start1"), F.col("before.ts_ms").alias("end1"), F.col("after.ts_ms").alias("start2"), F.col("end_ms").alias("end2"), F.least(F.lit(0.85), 0.55 + F.col("score") * 0.30).alias("c1"), F.col("score"))
    return found.where((F.col("end1") - F.col("start1") >= 30 * MINUTE) & (F.col("end2") - F.col("start2") >= 30 * MINUTE)).withColumn("c2", F.col("c1"))


def pair_halves(blocks: DataFrame) -> DataFrame:
    """Two of a match's four longest blocks that balance best; a single long block is cut around its middle."""
    long = F.col("end_ms") - F.col("start_ms")
    ranked = blocks.withColumn("long", long).withColumn("rank", F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc("long"), "start_ms"))).where("rank <= 4")
    side = lambda s: ranked.select("match_id", *(F.col(c).alias(f"{s}_{c}") for c in ("start_ms", "end_ms", "confidence", "long", "rank")))
    pairs = side("a").join(side("b"), "match_id").where("b_start_ms - a_end_ms >= 60000")
    pairs = pairs.withColumn("score", F.least("a_long", "b_long") / F.greatest("a_long", "b_long") + F.col("a_confidence") + F.col("b_confidence"))
    best = pairs.withColumn("best", F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc("score"), "a_rank", "b_rank"))).where("best = 1")
    two = best.select("match_id", F.col("a_start_ms").alias("start1"), F.col("a_end_ms").alias("end1"), F.col("b_start_ms").alias("start2"), F.col("b_end_ms").alias("end2"), F.least(F.lit(0.95), "a_confidence").alias("c1"), F.least(F.lit(0.95), "b_confidence").alias("c2"))
    one = blocks.withColumn("n", F.count("*").over(Window.partitionBy("match_id"))).withColumn("long", long).where(f"n = 1 and long >= {70 * MINUTE}")
    middle = F.col("start_ms") + _div(F.col("long"), 2)
    cut = one.select("match_id", F.col("start_ms").alias("start1"), (middle - 5 * MINUTE).alias("end1"), (middle + 5 * MINUTE).alias("start2"), F.col("end_ms").alias("end2"), F.lit(0.45).alias("c1"), F.lit(0.45).alias("c2"))
    return two.unionByName(cut)


def _proportional(videos: DataFrame) -> DataFrame:
    d = F.col("duration_ms")
    lead = F.least((d * 0.03).cast("long"), F.lit(10 * MINUTE))
    usable = F.greatest(lead, d - F.least((d * 0.02).cast("long"), F.lit(5 * MINUTE)))
    pause = F.least(F.lit(15 * MINUTE), (d * 0.10).cast("long"))
    middle = lead + _div(usable - lead, 2)
    return videos.select("match_id", lead.alias("start1"), F.greatest(lead, middle - _div(pause, 2)).alias("end1"), F.least(usable, middle + _div(pause, 2)).alias("start2"), usable.alias("end2"), F.lit(0.2).alias("c1"), F.lit(0.2).alias("c2"))


def detect_periods(signals: DataFrame, videos: DataFrame, threshold: float = 0.24) -> DataFrame:
    """Two rows per video: (match_id, number, start_ms, end_ms, confidence, overall, requires_review, method). A central break
    wins over paired blocks, and those over fixed shares of the recording."""
    methods = [central_break(signals, videos, threshold).drop("score"), pair_halves(field_blocks(signals, videos, threshold)), _proportional(videos)]
    every = None
    for rank, (name, rows) in enumerate(zip(("central_broadcast_break", "field_blocks", "proportional"), methods, strict=True)):
        rows = rows.withColumn("rank", F.lit(rank)).withColumn("method", F.lit(name))
        every = rows if every is None else every.unionByName(rows)
    columns = ["rank", "method", "start1", "end1", "start2", "end2", "c1", "c2"]
    best = every.groupBy("match_id").agg(F.min(F.struct(*columns)).alias("b")).select("match_id", "b.*")
    apart = F.col("start2") - F.col("end1")
    factor = F.when(F.col("rank") == 0, F.greatest(F.lit(0.65), apart / 120_000)).otherwise(F.greatest(F.lit(0.35), apart / (8 * MINUTE)))
    overall = F.when(F.col("rank") == 2, 0.2).otherwise(F.least("c1", "c2") * F.least(F.lit(1.0), factor))
    best = best.withColumn("overall", overall)
    half = lambda n: F.struct(F.lit(n).alias("number"), F.col(f"start{n}").alias("start_ms"), F.col(f"end{n}").alias("end_ms"), F.col(f"c{n}").alias("confidence"))
    rows = best.withColumn("p", F.explode(F.array(half(1), half(2))))
    return rows.select("match_id", "p.*", F.round("overall", 4).alias("overall"), ((F.col("rank") == 2) | (F.col("overall") < 0.86)).alias("requires_review"), "method")


#: Columns of a match's periods.
PERIOD = ["match_id", "number", "start_ms", "end_ms", "clock_start_ms", "clock_end_ms", "source", "confidence", "confirmed"]


def resolve_periods(known: DataFrame, detected: DataFrame, videos: DataFrame, prepare_again: bool = False) -> tuple[DataFrame, DataFrame]:
    """(periods, moved): a match's two confirmed periods of known(PERIOD), as they are, or else the detected ones, never one of
    each; a match prepared again takes the detected ones. Detected halves end at the recording's bounds and run from 0 and
    45 minutes for as long as they were found to be. moved(match_id) had other bounds before."""
    bound = F.struct(*(F.col(c).cast("long").alias(c) for c in ("number", "start_ms", "end_ms")))
    bounds = F.array_sort(F.collect_list(F.when(F.col("number").isin(1, 2), bound)))
    before = known.groupBy("match_id").agg(F.count_if("confirmed").alias("ready"), bounds.alias("before"))
    fixed = F.coalesce(F.col("ready") == 2, F.lit(False)) & F.lit(not prepare_again)
    kept = known.where("confirmed").join(before, "match_id").where(fixed).select(PERIOD)
    found = detected.join(before, "match_id", "left").where(~fixed).join(videos.select("match_id", "duration_ms"), "match_id", "left")
    start, end = F.greatest(F.lit(0), "start_ms"), F.least("end_ms", "duration_ms")
    clock = F.when(F.col("number") == 2, HALF_CLOCK_MS).otherwise(0)
    long = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))
    new = found.select("match_id", "number", start.alias("start_ms"), end.alias("end_ms"), clock.alias("clock_start_ms"), (clock + long).alias("clock_end_ms"), F.lit("automatic").alias("source"), "confidence", F.lit(False).alias("confirmed"))
    after = new.groupBy("match_id").agg(F.array_sort(F.collect_list(bound)).alias("after"))
    moved = after.join(before, "match_id").where(F.size("before") > 0).where("before <> after").select("match_id")
    return kept.unionByName(new), moved


def make_stale(runs: DataFrame, moved: DataFrame, newest: int | None = None) -> DataFrame:
    """Sample runs of moved(match_id), of which none is approved any more; with `newest`, those among a match's last runs."""
    if newest:
        w = Window.partitionBy("match_id").orderBy(F.desc("created_at"), F.desc("run_id"))
        runs = runs.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= newest).drop("_place")
    stale = runs.where("mode = 'sample'").join(moved.select("match_id").distinct(), "match_id", "left_semi")
    return stale.withColumn("stale", F.lit(True)).withColumn("approved", F.lit(False))


def apply_period_edits(periods: DataFrame, edits: DataFrame, videos: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(periods, errors, stale runs) of periods(PERIOD) after edits(match_id, number, start, end, clock_start as timecodes; one
    row for each half, without a clock: 0 and 45 minutes).

    A match's edit is of both halves and is taken as a whole or not at all: one that cannot be read or lacks a half
    (`timecode`), whose bounds are not in order (`order`), whose second clock does not follow the first (`clock`) or that ends
    past the recording, where its length is known (`duration`), is one error row. Edited halves are confirmed by hand; other
    bounds than before make the match's sample runs stale."""
    rows = edits.withColumn("clock_start", F.coalesce("clock_start", F.when(F.col("number") == 2, "45:00").otherwise("00:00")))
    for name in ("start", "end", "clock_start"):
        rows = rows.withColumn(f"new_{name}", clock_ms(F.col(name)))
    half = lambda n: F.max(F.when(F.col("number") == n, F.struct("new_start", "new_end", "new_clock_start"))).alias(f"h{n}")
    both = rows.groupBy("match_id").agg(half(1), half(2)).join(videos.select("match_id", "duration_ms"), "match_id", "left")
    values = [F.col(f"h{n}.new_{c}") for n in (1, 2) for c in ("start", "end", "clock_start")]
    s1, e1, c1, s2, e2, c2 = values
    unread = values[0].isNull()
    for v in values[1:]:
        unread |= v.isNull()
    rule = F.when(unread, "timecode").when(~((s1 < e1) & (e1 <= s2) & (s2 < e2)), "order").when(c2 <= c1, "clock").when((F.col("duration_ms") > 0) & (e2 > F.col("duration_ms")), "duration")
    both = both.withColumn("rule", rule)
    made = lambda n: F.struct(F.lit(n).alias("number"), F.col(f"h{n}.new_start").alias("start_ms"), F.col(f"h{n}.new_end").alias("end_ms"), F.col(f"h{n}.new_clock_start").alias("clock_start_ms"))
    new = both.where("rule is null").select("match_id", F.explode(F.array(made(1), made(2))).alias("p")).select("match_id", "p.*")
    new = new.withColumn("clock_end_ms", F.col("clock_start_ms") + F.col("end_ms") - F.col("start_ms")).withColumn("source", F.lit("manual")).withColumn("confidence", F.lit(1.0)).withColumn("confirmed", F.lit(True))
    old = periods.select("match_id", "number", F.col("start_ms").alias("old_start"), F.col("end_ms").alias("old_end"))
    moved = new.join(old, ["match_id", "number"], "left").where("not (start_ms <=> old_start and end_ms <=> old_end)")
    after = new.select(PERIOD).unionByName(periods.select(PERIOD).join(new.select("match_id", "number"), ["match_id", "number"], "left_anti"))
    return after, both.where("rule is not null").select("match_id", "rule"), make_stale(runs, moved)
