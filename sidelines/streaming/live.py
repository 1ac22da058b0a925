"""The same rules on streams of frames: possession, the ball, progress, and checks of arriving frames.

Possession and checks keep their state through transformWithStateInPandas, which needs the RocksDB state store
(spark.sql.streaming.stateStore.providerClass)."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sidelines.functions.columns import distance
from sidelines.operators.clocks import progress
from sidelines.operators.detections import follow_ball
from sidelines.operators.ingest import frame_rule, header_errors
from sidelines.operators.possession import MARGIN, PITCH, RADIUS

#: A segment's state ends when it has been silent so long: frames after that begin anew.
IDLE_MS = 3_600_000
SAMPLE = "seg long, ts_ms long, state string, team_key string, player_key string, ball_x double, ball_y double, confidence double, reason string, coordinate_space string, contenders array<struct<team_key: string, player_key: string>>"
_SAMPLE = ["seg", "ts_ms", "state", "team_key", "player_key", "ball_x", "ball_y", "confidence", "reason", "coordinate_space", "contenders"]
_NEAR = [f"{c}_{k}" for k in (1, 2) for c in ("d", "team", "player", "sure")]
#: What is held of a frame until no earlier one can come.
_HELD = ["at_ms", "ts_ms", "dead", "field_score", "ball_seen", "ball_x", "ball_y", "metres", *_NEAR]
HELD = "at_ms long, ts_ms long, dead boolean, field_score double, ball_seen boolean, ball_x double, ball_y double, metres boolean, " + ", ".join(f"{c} {'double' if c[0] in 'ds' else 'string'}" for c in _NEAR)
OWNER = "seen_ms long, ball_x double, ball_y double, team string, player string, next_team string, next_player string, since_ms long, last_at_ms long"


def nearest(frames: DataFrame) -> DataFrame:
    """frames(seg, ts_ms, field_score, scene_cut, replay_probability, ball_x, ball_y, athletes array of team_key, player_key,
    confidence, x, y) with the two athletes nearest to the ball, by distance and place in the array."""
    far = lambda a: distance(F.col("ball_x"), F.col("ball_y"), a["x"], a["y"])
    ranked = F.transform("athletes", lambda a, i: F.struct(far(a).alias("d"), i.alias("i"), a["team_key"].alias("team_key"), a["player_key"].alias("player_key"), a["confidence"].alias("confidence")))
    return frames.withColumn("near", F.slice(F.array_sort(F.filter(ranked, lambda a: a["d"].isNotNull())), 1, 2)).drop("athletes")


def _known(value) -> bool:
    return value is not None and value == value


def _text(value) -> str | None:
    return value if _known(value) else None


class _Possession(StatefulProcessor):
    """Holds a segment's frames in list state until the watermark has passed them, then walks over them in order of ts_ms."""

    def __init__(self, radius: float | None, grace_ms: int, dwell_ms: int):
        self.radius, self.grace_ms, self.dwell_ms = radius, grace_ms, dwell_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames, self.owner = handle.getListState("frames", HELD), handle.getValueState("owner", OWNER)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            new = part[_HELD].astype(object).where(part[_HELD].notna(), None)
            self.frames.appendList([tuple(r) for r in new.itertuples(index=False)])
            least = int(part["at_ms"].min())
            first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(max(first, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted((dict(zip(_HELD, f, strict=True)) for f in self.frames.get()), key=lambda f: (f["at_ms"], f["ts_ms"]))
        ready, later = [f for f in held if f["at_ms"] <= now], [f for f in held if f["at_ms"] > now]
        state = tuple(self.owner.get()) if self.owner.exists() else (None,) * 9
        if not held and (state[8] is None or state[8] + IDLE_MS <= now):
            self.owner.clear()
            return
        if later:
            self.frames.put([tuple(f[c] for c in _HELD) for f in later])
            self.handle.registerTimer(later[0]["at_ms"])
        else:
            self.frames.clear()
        if ready:
            out, state = self._walk(sorted(ready, key=lambda f: f["ts_ms"]), state[:8])
            last = max(f["at_ms"] for f in ready)
            self.owner.update((*state, last))
            self.handle.registerTimer(last + IDLE_MS)
            yield pd.DataFrame([(key[0], *o) for o in out], columns=[f.split()[0] for f in ("seg", "ts_ms", "state", "team_key", "player_key", "ball_x", "ball_y", "confidence", "reason", "contenders", "coordinate_space")])[_SAMPLE]

    def _walk(self, frames: list[dict], state: tuple) -> tuple[list[tuple], tuple]:
        seen, last_x, last_y, team, player, next_team, next_player, since = state
        out = []
        for f in frames:
            ts, x, y, metres = int(f["ts_ms"]), f["ball_x"], f["ball_y"], bool(f["metres"])
            space = "pitch_meters" if metres else "image_normalized"
            radius = RADIUS[metres] if self.radius is None else self.radius
            d1, d2 = f["d_1"], f["d_2"]
            if f["dead"]:
                out.append((ts, "unknown", None, None, None, None, max(0.45, 1 - f["field_score"]), "broadcast_not_live", None, None))
                continue
            if not (_known(x) and _known(y)):
                if f["ball_seen"]:
                    out.append((ts, "unknown", None, None, None, None, 0.1, None, None, None))
                elif seen is not None and ts - seen <= self.grace_ms and player is not None:
                    out.append((ts, "controlled", team, player, last_x, last_y, 0.35, None, None, None))
                else:
                    out.append((ts, "unknown", None, None, None, None, 0.15, None, None, None))
                continue
            seen, last_x, last_y = ts, x, y
            one, two = (_text(f["team_1"]), _text(f["player_1"])), (_text(f["team_2"]), _text(f["player_2"]))
            if metres and not (-MARGIN <= x <= PITCH[0] + MARGIN and -MARGIN <= y <= PITCH[1] + MARGIN):
                out.append((ts, "out", None, None, x, y, 0.76, "pitch_boundary", None, space))
            elif not _known(d1) or d1 > radius:
                out.append((ts, "loose", None, None, x, y, 0.5, None, None, None))
            elif _known(d2) and one[0] and two[0] and one[0] != two[0] and d2 <= radius * 1.15 and d2 - d1 <= radius * 0.25:
                both = [{"team_key": t, "player_key": p} for t, p in (one, two)]
                out.append((ts, "contested", None, None, x, y, 0.58, None, both, space))
            else:
                if since is None or one != (next_team, next_player):
                    if since is None:
                        team, player = one
                    next_team, next_player, since = *one, ts
                elif ts - since >= self.dwell_ms:
                    team, player = one
                out.append((ts, "controlled", team, player, x, y, min(0.98, max(0.25, f["sure_1"] * (1 - d1 / radius))), None, None, space))
        return out, (seen, last_x, last_y, team, player, next_team, next_player, since)


def live_possession(frames: DataFrame, late: str = "10 seconds", radius: float | None = None, grace_ms: int = 1500, dwell_ms: int = 250, pitch: bool = False) -> DataFrame:
    """Possession samples of a stream, as operators.possession gives them for a table.

    frames as in nearest(), with the time `at` they were taken, by which a segment's ts_ms rises, and where present ball_seen
    and coordinate_space as in operators.possession. Frames may come in any order: each is held until the watermark, `late`
    behind the newest frame of all segments, has passed it, so samples come out in order; frames later than that are dropped
    by Spark and counted in the query's progress. State per segment: frames held, when and where the ball was last seen, the
    owner, and the owner proposed since when; it ends after IDLE_MS without a frame."""
    rows = nearest(frames)
    metres = F.coalesce(F.col("coordinate_space") == "pitch_meters", F.lit(False)) if "coordinate_space" in frames.columns else F.lit(pitch)
    seen = F.coalesce("ball_seen", F.lit(False)) if "ball_seen" in frames.columns else F.lit(False)
    dead = F.col("scene_cut") | (F.col("replay_probability") >= 0.65) | (F.col("field_score") < 0.14)
    near = {f"{out}_{k}": F.get("near", F.lit(k - 1))[c] for k in (1, 2) for out, c in (("d", "d"), ("team", "team_key"), ("player", "player_key"), ("sure", "confidence"))}
    rows = rows.select("seg", "at", F.unix_millis("at").alias("at_ms"), "ts_ms", F.coalesce(dead, F.lit(False)).alias("dead"), "field_score", seen.alias("ball_seen"), "ball_x", "ball_y", metres.alias("metres"), *(c.alias(n) for n, c in near.items()))
    return rows.withWatermark("at", late).groupBy("seg").transformWithStateInPandas(_Possession(radius, grace_ms, dwell_ms), SAMPLE, "append", "eventTime")


def live_ball(candidates: DataFrame) -> DataFrame:
    """At most one of a stream's ball candidates per time, as operators.detections.select_ball; state: the last choice."""

    def choose(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = state.get if state.exists else None
        chosen = [(key[0], r.ts_ms, r.det_id, r.cx, r.cy) for r in follow_ball(pd.concat(list(batches)), before)]
        if chosen:
            state.update((int(chosen[-1][1]), *map(float, chosen[-1][3:])))
            state.setTimeoutDuration(IDLE_MS)
            yield pd.DataFrame([c[:3] for c in chosen], columns=["seg", "ts_ms", "det_id"])

    return candidates.groupBy("seg").applyInPandasWithState(choose, "seg long, ts_ms long, det_id long", "ts_ms long, cx double, cy double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def live_progress(frames: DataFrame, runs: DataFrame) -> DataFrame:
    """operators.clocks.progress of a stream of frames(run_id, ts_ms, elapsed_ms) and the table runs(run_id, start_ms,
    duration_ms): frames, time done, share, speed, time left and percent of each run. Write it in update mode."""
    return progress(frames.join(runs.select("run_id", "start_ms", "duration_ms"), "run_id"))


#: Repeats of a time are looked for among those of its minute.
BUCKET_MS = 60_000


class _Repeats(StatefulProcessor):
    """Gives good rows whose time was there before the rule of repeats. State: a bucket's times, packed, until they are old."""

    def __init__(self, keep_ms: int, columns: list[str]):
        self.keep_ms, self.columns = keep_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "times binary", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = set(np.frombuffer(self.seen.get()[0], np.int64).tolist()) if self.seen.exists() else set()
        known = len(before)
        for part in rows:
            rules = part["rule"].astype(object).where(part["rule"].notna(), None).tolist()
            for i, (rule, ts) in enumerate(zip(rules, part["ts_ms"].tolist(), strict=True)):
                if rule is None and int(ts) in before:
                    rules[i] = "duplicate_timestamp"
                elif rule is None:
                    before.add(int(ts))
            yield part.assign(rule=rules)[self.columns]
        if len(before) > known:
            self.seen.update((np.fromiter(before, np.int64, len(before)).tobytes(),))


def live_checks(frames: DataFrame, headers: DataFrame | None = None, schema: str | None = None, engine: str | None = None, keep_ms: int = 600_000) -> DataFrame:
    """All arriving frames(match_id, ts_ms, width, height, ...) with the `rule` each breaks, null for good ones: nothing is
    dropped, so good and bad rows together are what arrived. Write both parts from one foreachBatch.

    Rules are those of an import: `header_missing`, `schema` and `engine` by the table headers(match_id, schema, engine),
    where given; `timestamp_missing`, `size_missing`, `out_of_range`; and `duplicate_timestamp` for all but the first good
    frame of a match's time to come within keep_ms by the cluster's clock, after which its state goes. As that clock runs on,
    the stream does not end by itself under an availableNow trigger."""
    rule = frame_rule(F.col("ts_ms"), F.col("width"), F.col("height"))
    rows = frames
    if headers is not None:
        bad = header_errors(headers, schema, engine).select("match_id", F.col("rule").alias("_header"))
        heads = headers.select("match_id").distinct().join(bad.groupBy("match_id").agg(F.first("_header").alias("_header")), "match_id", "left").withColumn("_known", F.lit(True))
        rows = rows.join(heads, "match_id", "left")
        rule = F.when(F.col("_known").isNull(), "header_missing").otherwise(F.coalesce("_header", rule))
    rows = rows.withColumn("rule", rule).drop("_header", "_known").withColumn("_bucket", F.when(F.col("rule").isNull(), F.expr(f"ts_ms div {BUCKET_MS}")))
    rows = rows.select(*frames.columns, "rule", "_bucket")
    out = T.StructType(rows.schema.fields[:-1])
    return rows.groupBy("match_id", "_bucket").transformWithStateInPandas(_Repeats(keep_ms, out.names), out, "append", "processingTime")
