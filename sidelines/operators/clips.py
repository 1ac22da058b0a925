"""Clip windows around events, merged where they are near."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidelines.functions.columns import earlier, ordered

#: Milliseconds before and after an event; others have 5000 each.
PADDING = {"goal": (12_000, 10_000), "shot": (9_000, 7_000), "pass": (5_000, 5_000), "carry": (5_000, 4_000), "duel": (5_000, 5_000), "aerial_duel": (5_000, 5_000), "tackle": (5_000, 5_000)}


def clip_windows(events: DataFrame, videos: DataFrame, types: list[str] | None = None, merge_gap_ms: int = 2000) -> DataFrame:
    """(seg, start_ms, end_ms, event_ids, label) of events(seg, ts_ms, event_id, event_type) and videos(seg, duration_ms),
    in order of ts_ms and event_id. A label lists types in order, leaving out one that is part of what it has."""
    pad = lambda i: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in PADDING.items() for x in (k, v[i]))), F.col("event_type")), F.lit(5000))
    rows = (events.where(F.col("event_type").isin(types)) if types else events).join(videos, "seg")
    rows = rows.withColumn("start_ms", F.greatest(F.lit(0), F.col("ts_ms") - pad(0))).withColumn("end_ms", F.least("duration_ms", F.col("ts_ms") + pad(1)))
    w = ordered(["seg"], "ts_ms", "event_id")
    before = F.max("end_ms").over(earlier(["seg"], "ts_ms", "event_id"))
    rows = rows.withColumn("new", F.coalesce((F.col("start_ms") > before + merge_gap_ms).cast("int"), F.lit(1))).withColumn("clip", F.sum("new").over(w))
    found = rows.groupBy("seg", "clip").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.array_sort(F.collect_list(F.struct("ts_ms", "event_id", "event_type"))).alias("all"))
    label = F.aggregate("all", F.lit(""), lambda a, x: F.when(a == "", x["event_type"]).when(F.contains(a, x["event_type"]), a).otherwise(F.concat(a, F.lit("-"), x["event_type"])))
    return found.select("seg", "start_ms", "end_ms", F.transform("all", lambda x: x["event_id"]).alias("event_ids"), label.alias("label"))
