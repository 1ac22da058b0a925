"""Event candidates from possession samples of a segment, in order of time.

samples(seg, ts_ms, state, team_key, player_key, ball_x, ball_y, confidence, contenders); ts_ms is unique in a segment.
Coordinates are shares of the image; `pitch` turns thresholds to metres. With a column coordinate_space, each sample names its
own space (`pitch_meters`, else the image), and an event is measured in the space of the sample it begins with.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sidelines.functions.columns import distance, earlier, later, ordered

BY = ["seg"]
#: Fixed values of the rules: (image shares, metres).
CARRY, PROGRESS, SHOT, NEAR, FAR = (0.08, 5.0), (0.12, 10.0), (0.12, 8.0), (0.12, 10.0), (0.88, 95.0)
COLUMNS = ["seg", "ts_ms", "emit_ord", "event_type", "team_key", "player_key", "recipient_key", "outcome", "start_x", "start_y", "end_x", "end_y", "confidence", "qualifiers", "duration_ms", "distance"]


def _event(found: Column, kind: int, event_type: str, **columns: Column) -> Column:
    """An event's struct where it is found; columns that are not given are those of the row, or null."""
    none = {"recipient_key": "string", "end_x": "double", "end_y": "double", "duration_ms": "long", "distance": "double"}
    c = {k: F.lit(None).cast(t) for k, t in none.items()} | {"qualifiers": F.array().cast("array<string>"), "sub": F.lit(0), "at": F.col("ts_ms")} | columns
    c["emit_ord"] = F.struct(F.lit(kind).alias("kind"), c.pop("at").cast("long").alias("at"), c.pop("sub").alias("sub"))
    c["event_type"] = F.lit(event_type)
    return F.when(found, F.struct(*(c.get(k, F.col(k)).alias(k) for k in COLUMNS[1:])))


def _emit(rows: DataFrame, *events: Column) -> DataFrame:
    """All events of each row, from one pass over the rows."""
    return rows.select("seg", F.explode(F.array_compact(F.array(*events))).alias("e")).select("seg", "e.*")


def _tag(condition: Column, name: str) -> Column:
    return F.when(condition, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))


def _metres(samples: DataFrame, pitch: bool = False) -> Column:
    """Whether a sample is in metres."""
    return F.coalesce(F.col("coordinate_space") == "pitch_meters", F.lit(False)) if "coordinate_space" in samples.columns else F.lit(pitch)


def _in_space(values: tuple[float, float], metres: Column) -> Column:
    return F.when(metres, values[1]).otherwise(values[0])


_ENDS = ("ball_x", "ball_y", "confidence", "metres")


def _with_runs(samples: DataFrame, max_gap_ms: int, pitch: bool) -> DataFrame:
    """Samples with `held`, and `new` where a run of one owner begins."""
    w = ordered(BY, "ts_ms")
    held = (F.col("state") == "controlled") & F.col("player_key").isNotNull()
    rows = samples.withColumn("held", F.coalesce(held, F.lit(False))).withColumn("metres", _metres(samples, pitch))
    owner = F.struct("team_key", "player_key")
    new = ~F.coalesce(F.lag("held").over(w), F.lit(False)) | ~F.lag(owner).over(w).eqNullSafe(owner) | (F.col("ts_ms") - F.lag("ts_ms").over(w) > max_gap_ms)
    return rows.withColumn("new", F.col("held") & new)


def controlled_runs(samples: DataFrame, max_gap_ms: int = 3000, pitch: bool = False) -> DataFrame:
    """Runs of one owner's controlled samples, numbered in a segment, with what their first and last sample hold."""
    rows = _with_runs(samples, max_gap_ms, pitch)
    rows = rows.withColumn("run", F.sum(F.col("new").cast("int")).over(ordered(BY, "ts_ms"))).where("held")
    ends = [f(c, "ts_ms").alias(f"{name}_{c}") for name, f in (("start", F.min_by), ("end", F.max_by)) for c in _ENDS]
    return rows.groupBy("seg", "run", "team_key", "player_key").agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.count("*").alias("n"), F.min("confidence").alias("confidence"), *ends)


def _carry(min_ms: int = 700) -> Column:
    long = F.col("end_ms") - F.col("start_ms")
    d = distance(F.col("end_ball_x"), F.col("end_ball_y"), F.col("start_ball_x"), F.col("start_ball_y"))
    forward = F.abs(F.col("end_ball_x") - F.col("start_ball_x")) >= _in_space(PROGRESS, F.col("start_metres"))
    found = (F.col("n") >= 2) & (d >= _in_space(CARRY, F.col("start_metres"))) & (long >= min_ms)
    return _event(found, 0, "carry", ts_ms=F.col("end_ms"), at=F.col("run"), outcome=F.lit("success"), start_x=F.col("start_ball_x"), start_y=F.col("start_ball_y"), end_x=F.col("end_ball_x"), end_y=F.col("end_ball_y"), qualifiers=_tag(forward, "progressive_candidate"), duration_ms=long, distance=F.round(d, 5))


def carries(runs: DataFrame, min_ms: int = 700) -> DataFrame:
    return _emit(runs, _carry(min_ms))


def _with_run_before(runs: DataFrame) -> DataFrame:
    before = F.lag(F.struct("team_key", "player_key", "end_ms", "end_ball_x", "end_ball_y", "end_confidence", "end_metres")).over(ordered(BY, "run"))
    return runs.withColumn("b", before)


def _transfers(max_gap_ms: int = 3000) -> list[Column]:
    near = F.col("b").isNotNull() & (F.col("start_ms") - F.col("b.end_ms") <= max_gap_ms)
    near &= ~F.struct("team_key", "player_key").eqNullSafe(F.struct("b.team_key", "b.player_key"))
    low = F.least("b.end_confidence", "start_confidence")
    common = {"ts_ms": F.col("start_ms"), "at": F.col("run")}
    first = {"team_key": F.col("b.team_key"), "player_key": F.col("b.player_key"), "start_x": F.col("b.end_ball_x"), "start_y": F.col("b.end_ball_y"), "end_x": F.col("start_ball_x"), "end_y": F.col("start_ball_y")}
    forward = F.coalesce(F.abs(F.col("start_ball_x") - F.col("b.end_ball_x")), F.lit(0.0)) >= _in_space(PROGRESS, F.col("b.end_metres"))
    same, other = near & (F.col("team_key") == F.col("b.team_key")), near & (F.col("team_key") != F.col("b.team_key"))
    return [
        _event(same, 0, "pass", **common, **first, sub=F.lit(1), recipient_key=F.col("player_key"), outcome=F.lit("success"), confidence=low, qualifiers=_tag(forward, "progressive_candidate")),
        _event(other, 0, "loss", **common, **first, sub=F.lit(1), outcome=F.lit("failure"), confidence=low * 0.82),
        _event(other, 0, "recovery", **common, sub=F.lit(2), outcome=F.lit("success"), start_x=F.col("start_ball_x"), start_y=F.col("start_ball_y"), confidence=low * 0.82),
    ]


def transfers(runs: DataFrame, max_gap_ms: int = 3000) -> DataFrame:
    """Passes inside a team, and a loss with a recovery between teams, where the owner changes."""
    return _emit(_with_run_before(runs), *_transfers(max_gap_ms))


#: What a duel takes from the controlled samples around it.
_CONTROLLED = ("ts_ms", "team_key", "player_key", "ball_x", "ball_y", "confidence")


def _contest() -> list[Column]:
    """Sums of a run of contested samples."""
    nobody = F.expr("cast(array() as array<struct<team_key:string,player_key:string>>)")
    contenders = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("state") == "contested", F.struct("ts_ms", F.coalesce("contenders", nobody).alias("c"))))), lambda x: x["c"]))
    return [contenders.alias("contenders"), F.avg("confidence").alias("mean"), *(f(c, "ts_ms").alias(f"{k}_{c}") for c in ("ball_x", "ball_y") for k, f in (("start", F.min_by), ("end", F.max_by)))]


def _with_winner(contests: DataFrame) -> DataFrame:
    follows = F.col("after.player_key").isNotNull()
    rows = contests.withColumn("winner", F.when(follows, F.struct("after.team_key", "after.player_key")).otherwise(F.get("contenders", F.lit(0))))
    return rows.withColumn("opponent", F.get(F.filter("contenders", lambda x: x["player_key"] != F.col("winner.player_key")), F.lit(0))["player_key"])


def _duel(contested: Column) -> list[Column]:
    found = contested & F.col("winner.player_key").isNotNull()
    tags = F.concat(F.array(F.lit("ground_candidate")), F.when(F.col("opponent").isNotNull(), F.array(F.concat(F.lit("opponent_track:"), "opponent"))).otherwise(F.array().cast("array<string>")))
    won = _event(found, 1, "duel", team_key=F.col("winner.team_key"), player_key=F.col("winner.player_key"), outcome=F.when(F.col("after").isNotNull(), "success").otherwise("unknown"), start_x=F.col("start_ball_x"), start_y=F.col("start_ball_y"), end_x=F.col("end_ball_x"), end_y=F.col("end_ball_y"), confidence=F.col("mean") * 0.78, qualifiers=tags)
    same = found & (F.col("before.player_key") == F.col("after.player_key"))
    past = _event(same, 1, "dribble", ts_ms=F.col("after.ts_ms"), sub=F.lit(1), team_key=F.col("after.team_key"), player_key=F.col("after.player_key"), outcome=F.lit("success"), start_x=F.col("before.ball_x"), start_y=F.col("before.ball_y"), end_x=F.col("after.ball_x"), end_y=F.col("after.ball_y"), confidence=F.least("before.confidence", "after.confidence") * 0.75, qualifiers=F.array(F.lit("after_contest")))
    return [won, past]


def duels(samples: DataFrame) -> DataFrame:
    """A duel for each run of contested samples, and a dribble if one player controls the ball before and after."""
    w = ordered(BY, "ts_ms")
    held = F.when(F.col("state") == "controlled", F.struct(*_CONTROLLED))
    contested = F.col("state") == "contested"
    rows = samples.withColumn("before", F.last(held, True).over(earlier(BY, "ts_ms"))).withColumn("after", F.last(held, True).over(later(BY, "ts_ms")))
    rows = rows.withColumn("run", F.sum((contested & ~F.coalesce(F.lag("state").over(w) == "contested", F.lit(False))).cast("int")).over(w)).where(contested)
    runs = rows.groupBy("seg", "run").agg(F.min("ts_ms").alias("ts_ms"), F.first("before").alias("before"), F.first("after").alias("after"), *_contest())
    return _emit(_with_winner(runs), *_duel(F.lit(True)))


def _with_state_before(samples: DataFrame) -> DataFrame:
    return samples.withColumn("state_before", F.lag("state").over(ordered(BY, "ts_ms")))


def _out() -> Column:
    none = F.lit(None)
    found = (F.col("state") == "out") & (F.col("state_before") != "out")
    return _event(found, 2, "out", team_key=none.cast("string"), player_key=none.cast("string"), outcome=F.lit("neutral"), start_x=none.cast("double"), start_y=none.cast("double"), confidence=F.col("confidence") * 0.72)


def outs(samples: DataFrame) -> DataFrame:
    return _emit(_with_state_before(samples), _out())


def _with_flight(samples: DataFrame, horizon_ms: int = 2200, pitch: bool = False) -> DataFrame:
    """Samples with the last place of the ball within the horizon and before another player controls it, and how many
    places there are."""
    held = F.col("state") == "controlled"
    rows = samples.withColumn("metres", _metres(samples, pitch)).withColumn("last_player", F.last(F.when(held, F.col("player_key")), True).over(earlier(BY, "ts_ms")))
    new = held & F.coalesce(F.col("player_key") != F.col("last_player"), F.lit(False))
    rows = rows.withColumn("owners", F.sum(new.cast("int")).over(ordered(BY, "ts_ms")))
    point = F.when(F.col("ball_x").isNotNull() & F.col("ball_y").isNotNull(), F.struct("ts_ms", "state", "ball_x", "ball_y", "confidence"))
    ahead = ordered([*BY, "owners"], "ts_ms").rangeBetween(1, horizon_ms)
    return rows.withColumn("end", F.max(point).over(ahead)).withColumn("points", F.count(point).over(ahead))


def _shot() -> Column:
    near = (F.col("end.ball_x") <= _in_space(NEAR, F.col("metres"))) | (F.col("end.ball_x") >= _in_space(FAR, F.col("metres")))
    moved = distance(F.col("end.ball_x"), F.col("end.ball_y"), F.col("ball_x"), F.col("ball_y")) >= _in_space(SHOT, F.col("metres"))
    found = (F.col("state") == "controlled") & F.col("player_key").isNotNull() & (F.col("points") >= 2) & F.col("end.state").isin("loose", "out") & near & moved
    space = F.when(F.col("metres"), "space:pitch_meters").otherwise("space:image_normalized")
    return _event(found, 3, "shot", outcome=F.lit("unknown"), start_x=F.col("ball_x"), start_y=F.col("ball_y"), end_x=F.col("end.ball_x"), end_y=F.col("end.ball_y"), confidence=F.least("confidence", "end.confidence") * 0.68, qualifiers=F.array(F.lit("trajectory_candidate"), space))


def shots(samples: DataFrame, pitch: bool = False, horizon_ms: int = 2200) -> DataFrame:
    """A controlled sample from which the ball goes loose or out near a goal before another player controls it."""
    return _emit(_with_flight(samples, horizon_ms, pitch), _shot())


def _units(samples: DataFrame, pitch: bool, max_gap_ms: int = 3000) -> DataFrame:
    """One row for each run of an owner, run of contested samples and stretch between them, in one pass over the sorted samples:
    what the detectors of runs and contests take from it, and in `own` the events of its single samples."""
    w = ordered(BY, "ts_ms")
    rows = _with_flight(_with_state_before(_with_runs(samples, max_gap_ms, pitch)), pitch=pitch)
    kind = F.when(F.col("held"), 0).when(F.col("state") == "contested", 1).otherwise(2)
    rows = rows.withColumn("kind", kind).withColumn("own", F.array_compact(F.array(_out(), _shot())))
    begins = F.col("new") | ~F.lag("kind").over(w).eqNullSafe(F.col("kind"))
    rows = rows.withColumn("run", F.sum(begins.cast("int")).over(w))
    seen = F.when(F.col("state") == "controlled", F.struct(*_CONTROLLED))
    ends = [f(c, "ts_ms").alias(f"{name}_{c}") for name, f in (("start", F.min_by), ("end", F.max_by)) for c in ("confidence", "metres")]
    units = rows.groupBy("seg", "run", "kind").agg(
        F.first("team_key").alias("team_key"), F.first("player_key").alias("player_key"), F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.count("*").alias("n"), F.min("confidence").alias("confidence"),
        *_contest(), *ends, F.flatten(F.collect_list("own")).alias("own"), F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"),
    )
    last_run = F.when(F.col("kind") == 0, F.struct("team_key", "player_key", "end_ms", "end_ball_x", "end_ball_y", "end_confidence", "end_metres"))
    before = earlier(BY, "run")
    return units.withColumns({"b": F.last(last_run, True).over(before), "before": F.last("last_seen", True).over(before), "after": F.last("first_seen", True).over(later(BY, "run")), "ts_ms": F.col("start_ms")})


def candidates(samples: DataFrame, pitch: bool = False) -> DataFrame:
    """All detectors' events before duplicates go, from one pass over samples and one over their units."""
    units = _with_winner(_units(samples, pitch))
    run, contest = F.col("kind") == 0, F.col("kind") == 1
    of_runs = [F.when(run, e) for e in (_carry(), *_transfers())]
    found = F.concat("own", F.array_compact(F.array(*of_runs, *_duel(contest))))
    return units.select("seg", F.explode(found).alias("e")).select("seg", "e.*")


def deduplicate(events: DataFrame, within_ms: int = 400, last: int = 6) -> DataFrame:
    """Of events of one type and player within `within_ms` among the last `last` kept, the most confident stays, in place.

    A segment's events pass as a sorted stream; only the last kept ones are held."""
    columns = [*COLUMNS[:3], *(c for c in events.columns if c not in COLUMNS[:3])]
    order = columns[1:]
    what, who, when, sure = (order.index(c) for c in ("event_type", "player_key", "ts_ms", "confidence"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, kept = None, []
        for batch in batches:
            done, types = [], batch.schema.types
            for key, *e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != seg:
                    done += [(seg, *x) for x in kept]
                    seg, kept = key, []
                hit = next((i for i in range(len(kept) - 1, -1, -1) if kept[i][what] == e[what] and kept[i][who] == e[who] and abs(kept[i][when] - e[when]) <= within_ms), None)
                if hit is None:
                    kept.append(e)
                    if len(kept) > last:
                        done.append((seg, *kept.pop(0)))
                elif e[sure] is not None and kept[hit][sure] is not None and e[sure] > kept[hit][sure]:
                    kept[hit] = e
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), types, strict=True)], columns)
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*((seg, *x) for x in kept), strict=True), types, strict=True)], columns)

    rows = events.select(*columns)
    return rows.repartition("seg").sortWithinPartitions(*columns).mapInArrow(run, rows.schema)


def mark_assists(events: DataFrame, within_ms: int = 12_000) -> DataFrame:
    """Adds "assist" to the latest pass to each goal's scorer, of the same team and at most `within_ms` before. All events
    pass one window; those without a player to meet by lie beside the others under the null key and are never marked."""
    after = later(["seg", "team_key", "who"], "ts_ms", "last")
    kind = F.col("event_type")
    who = F.when(kind == "pass", F.col("recipient_key")).when(kind == "goal", F.col("player_key"))
    rows = events.withColumn("who", who).withColumn("last", (kind == "goal").cast("int"))
    goal_after, pass_after = (F.last(F.when(kind == k, F.col("ts_ms")), True).over(after) for k in ("goal", "pass"))
    rows = rows.withColumn("g", goal_after).withColumn("p", pass_after)
    hit = (kind == "pass") & F.col("who").isNotNull() & (F.col("g") - F.col("ts_ms") <= within_ms) & (F.col("p").isNull() | (F.col("p") > F.col("g")))
    return rows.withColumn("qualifiers", F.when(hit, F.array_union("qualifiers", F.array(F.lit("assist")))).otherwise(F.col("qualifiers"))).select(events.columns)


def detect_events(samples: DataFrame, pitch: bool = False) -> DataFrame:
    return deduplicate(mark_assists(candidates(samples, pitch)))
