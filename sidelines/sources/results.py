"""Writing results: tracking rows, events, exports, and tables that runs replace or update."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sidelines.operators.review import of_latest_run


def write_tracking(rows: DataFrame, path: str, bulky: tuple[str, ...] = ("raw_detections", "diagnostics")) -> None:
    rows.drop(*bulky).write.mode("overwrite").partitionBy("match_id", "period").json(path)


def write_events(events: DataFrame, path: str) -> None:
    events.write.mode("overwrite").json(path)


def events_csv(events: DataFrame, teams: DataFrame, players: DataFrame, runs: DataFrame) -> DataFrame:
    """The export's columns for the events of each match's latest run, or all of a match without one: names for ids, qualifiers joined by |."""
    name = lambda rows, key, out: rows.select(F.col(key).alias(out), F.col("name").alias(out.replace("_id", "")))
    rows = of_latest_run(events, runs)
    rows = rows.join(name(teams, "team_id", "team_id"), "team_id", "left").join(name(players, "player_id", "player_id"), "player_id", "left").join(name(players, "player_id", "recipient_id"), "recipient_id", "left")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select(
        "match_id", "period", "match_time_ms", F.col("ts_ms").alias("video_time_ms"), F.col("event_type").alias("type"), text("team"), text("player"), text("recipient"), "outcome", "start_x", "start_y", "end_x", "end_y",
        F.round("confidence", 4).alias("confidence"), "review_status", F.concat_ws("|", "qualifiers").alias("qualifiers"),
    )


def write_events_csv(export: DataFrame, path: str) -> None:
    export.write.mode("overwrite").partitionBy("match_id").option("header", True).csv(path)


def match_report(matches: DataFrame, periods: DataFrame, team_stats: DataFrame, player_stats: DataFrame, events: DataFrame, runs: DataFrame) -> DataFrame:
    """(match_id, report): one JSON document per match, of the latest run and without rejected events. A document holds one
    match, whose events are a few thousand; each list is collected within its match only."""

    def listed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
        fields = [*order, *(c for c in rows.columns if c not in ("match_id", *order))]
        return rows.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))

    kept = of_latest_run(events.where("review_status <> 'rejected'"), runs)
    rows = matches.select("match_id", F.struct(*matches.columns).alias("match"))
    for part in (listed(periods, ["number"], "periods"), listed(team_stats, ["team_id"], "team_stats"), listed(player_stats, ["player_id"], "player_stats"), listed(kept, ["ts_ms", "event_id"], "events")):
        rows = rows.join(part, "match_id", "left")
    names = ["periods", "team_stats", "player_stats", "events"]
    return rows.select("match_id", F.to_json(F.struct("match", *names)).alias("report"))


#: Parts of a run's report that hold one value a run, and those that are lists.
REPORT, LISTS = ("video", "quality", "backend", "tracking_fps", "camera", "diagnostics", "clips", "limitations"), ("periods", "windows", "previews")


def run_report(runs: DataFrame, parts: dict[str, DataFrame], counted: dict[str, DataFrame], schema: str) -> DataFrame:
    """(run_id, report): a JSON document of each of runs(run_id, match_id, mode).

    parts names any of REPORT (one row per run_id) and LISTS (rows of a run, listed in order of their columns: a few
    dozen); a part of one column besides run_id is that value, a wider one an object. counted names tables whose rows are
    counted by run_id. Parts that are not given or have no row are null, lists empty, counts 0."""
    rows = runs.select("run_id", F.col("match_id").cast("string").alias("match_id"), F.col("mode").alias("analysis_mode"))
    for name in [*REPORT, *LISTS]:
        if name not in parts:
            rows = rows.withColumn(name, F.array().cast("array<string>") if name in LISTS else F.lit(None).cast("string"))
            continue
        own = [c for c in parts[name].columns if c != "run_id"]
        value = F.col(own[0]) if len(own) == 1 else F.struct(*own)
        made = parts[name].groupBy("run_id").agg((F.array_sort(F.collect_list(value)) if name in LISTS else F.first(value)).alias(name))
        rows = rows.join(made, "run_id", "left")
        if name in LISTS:
            rows = rows.withColumn(name, F.coalesce(name, F.array().cast(made.schema[name].dataType)))
    for name, table in counted.items():
        rows = rows.join(table.groupBy("run_id").agg(F.count("*").alias(f"n_{name}")), "run_id", "left").fillna(0, [f"n_{name}"])
    counts = F.struct(*(F.col(f"n_{name}").alias(name) for name in counted)) if counted else F.lit(None).cast("string")
    document = F.struct(F.lit(schema).alias("schema"), F.col("run_id").cast("string").alias("run_id"), "match_id", "analysis_mode", *REPORT, *LISTS, counts.alias("counts"))
    return rows.select("run_id", F.to_json(document).alias("report"))


def overwrite_run(rows: DataFrame, path: str) -> None:
    """Replaces the partitions of the rows' runs alone, so a run can be written again."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("match_id", "run_id").parquet(path)


def upsert(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """updates, and the rows of target whose key they do not hold. Keys must be unique in updates."""
    return updates.select(target.columns).unionByName(target.join(updates.select(*keys), keys, "left_anti"))


#: Folders inside a merged table, which readers skip: staged partitions, and those whose swap has been decided.
STAGED, DECIDED = "_staged", "_decided"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), lambda *parts: spark._jvm.org.apache.hadoop.fs.Path("/".join([path.rstrip("/"), *parts]))


def _folders(fs, at, names: list[str], depth: int) -> list[list[str]]:
    """Names of the partition folders `depth` levels down."""
    if not depth:
        return [names]
    below = [s.getPath().getName() for s in fs.listStatus(at(*names)) if s.isDirectory() and "=" in s.getPath().getName()]
    return [found for name in below for found in _folders(fs, at, [*names, name], depth - 1)]


def recover(spark: SparkSession, path: str, by: list[str]) -> None:
    """Ends a merge that was lost: one whose staging was complete is carried through, any other is taken back. Repeating it
    changes nothing."""
    fs, at = _fs(spark, path)
    if fs.exists(at(DECIDED)):
        for names in _folders(fs, at, [DECIDED], len(by)):
            fs.mkdirs(at(*names[1:-1]))
            fs.delete(at(*names[1:]), True)
            if fs.listStatus(at(*names)):
                fs.rename(at(*names), at(*names[1:]))
        fs.delete(at(DECIDED), True)
    fs.delete(at(STAGED), True)


def merge(updates: DataFrame, path: str, keys: list[str], by: list[str], gone: DataFrame | None = None) -> None:
    """Upserts updates into the Parquet table at path, partitioned by the columns `by` (among keys), and deletes gone(keys).

    Only partitions that updates or gone name are read and written: their new contents are staged in a folder that readers
    skip, one rename decides the merge, and each partition is then swapped in. A merge lost before the rename leaves the table as it
    was, one lost after it is carried through by the next merge or by `recover`. One merge of a table runs at a time; its
    readers may see some partitions before others. A partition that loses all rows goes. Keys must be unique in updates."""
    spark = updates.sparkSession
    fs, at = _fs(spark, path)
    recover(spark, path, by)
    changes = updates.select(*keys)
    changes = changes.unionByName(gone.select(*keys)) if gone is not None else changes
    touched = changes.select(*by).distinct()
    made = updates
    if fs.exists(at()) and _folders(fs, at, [], len(by)):
        table = spark.read.schema(updates.schema).parquet(path)
        kept = table.join(touched, by, "left_semi").join(changes, keys, "left_anti")
        made = updates.unionByName(kept)
    made.write.partitionBy(*by).parquet("/".join([path.rstrip("/"), STAGED]))
    written = {tuple(names[1:]) for names in _folders(fs, at, [STAGED], len(by))}
    for names in (_names(row, by) for row in touched.toLocalIterator()) if gone is not None else ():
        if tuple(names) not in written:
            fs.mkdirs(at(STAGED, *names))
    fs.rename(at(STAGED), at(DECIDED))
    recover(spark, path, by)


def _names(row, by: list[str]) -> list[str]:
    return [f"{c}={'__HIVE_DEFAULT_PARTITION__' if row[c] is None else row[c]}" for c in by]
