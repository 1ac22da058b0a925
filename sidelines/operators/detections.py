"""Raw detections of a frame: roles, filters, duplicates, the ball, teams, projections and velocities.

A frame holds tens of boxes at most, so per-frame arrays stay small."""

from collections.abc import Iterator
from itertools import groupby
from math import hypot

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sidelines.functions.columns import distance, ordered
from sidelines.functions.streams import sorted_fold

#: Other names of the roles.
ALIASES = {
    "player": "player", "players": "player", "goalkeeper": "goalkeeper", "goalie": "goalkeeper", "keeper": "goalkeeper",
    "referee": "referee", "ref": "referee", "ball": "ball", "football": "ball", "soccer-ball": "ball",
}
BOX = ("x1", "y1", "x2", "y2")


def assign_roles(detections: DataFrame, classes: DataFrame) -> DataFrame:
    """Detections with the role of classes(class_id, name, role): a given role wins, else its name's, else `other`. A model has
    few classes: they go to the detections, which would else gather in as many tasks as there are classes."""
    name = F.regexp_replace(F.lower(F.trim("name")), "[ _]", "-")
    alias = F.element_at(F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair)), name)
    named = classes.select("class_id", F.coalesce("role", alias, F.lit("other")).alias("role"))
    return detections.join(F.broadcast(named), "class_id", "left").withColumn("role", F.coalesce("role", F.lit("other")))


def confident(detections: DataFrame, ball: float = 0.1, athletes: float = 0.25) -> DataFrame:
    return detections.where(F.col("confidence") >= F.when(F.col("role") == "ball", ball).otherwise(athletes))


def _overlap(a: Column, b: Column) -> tuple[Column, Column]:
    """Intersection over union, and the covered share of the smaller box."""
    zero = F.lit(0.0)
    area = lambda o: F.greatest(zero, o["x2"] - o["x1"]) * F.greatest(zero, o["y2"] - o["y1"])
    both = F.greatest(zero, F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])) * F.greatest(zero, F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    union = area(a) + area(b) - both
    small = F.least(area(a), area(b))
    return F.when(union > 0, both / union).otherwise(0.0), F.when(small > 0, both / small).otherwise(0.0)


def pairwise_iou(detections: DataFrame) -> DataFrame:
    """(frame, a, b, iou, coverage) of the boxes of one frame that touch; a < b are their det_id."""
    box = F.struct(*BOX)
    side = lambda n: detections.select("frame", F.col("det_id").alias(n), box.alias(f"box_{n}"))
    iou, cover = _overlap(F.col("box_a"), F.col("box_b"))
    return side("a").join(side("b"), "frame").where("a < b").select("frame", "a", "b", iou.alias("iou"), cover.alias("coverage")).where("iou > 0")


def suppress_duplicates(detections: DataFrame, iou: float = 0.82, coverage: float = 0.92) -> DataFrame:
    """Detections(frame, det_id, confidence, box) in order of confidence, without those that overlap one kept before."""
    item = F.struct((-F.col("confidence")).alias("rank"), "det_id", *BOX)

    def keep(kept: Column, one: Column) -> Column:
        def same(other: Column) -> Column:
            i, c = _overlap(one, other)
            return (i >= iou) | (c >= coverage)

        return F.when(F.exists(kept, same), kept).otherwise(F.concat(kept, F.array(one)))

    frames = detections.groupBy("frame").agg(F.array_sort(F.collect_list(item)).alias("all"))
    kept = frames.select("frame", F.explode(F.aggregate("all", F.slice("all", 1, 0), keep)).alias("k")).select("frame", F.col("k.det_id").alias("det_id"))
    return detections.join(kept, ["frame", "det_id"])


def ball_candidates(balls: DataFrame, athletes: DataFrame, width: int = 1920, height: int = 1080) -> DataFrame:
    """Ball boxes of a plausible size and shape with their centre and the best nearness to an athlete's feet (0: none)."""
    w, h = F.greatest(F.lit(0.0), F.col("x2") - F.col("x1")), F.greatest(F.lit(0.0), F.col("y2") - F.col("y1"))
    rows = balls.withColumn("w", w).withColumn("h", h).where(f"w >= 1 and h >= 1 and w <= {width * 0.025} and h <= {height * 0.04} and w / h between 0.45 and 2.2")
    rows = rows.withColumn("cx", (F.col("x1") + F.col("x2")) / 2).withColumn("cy", (F.col("y1") + F.col("y2")) / 2).drop("w", "h")
    feet = F.struct(((F.col("x1") + F.col("x2")) / 2).alias("x"), F.col("y2").alias("y"), F.greatest(F.lit(85.0), F.greatest(F.lit(1.0), F.col("y2") - F.col("y1")) * 3.5).alias("limit"))
    feet = athletes.groupBy("frame").agg(F.collect_list(feet).alias("feet"))
    gain = F.array_max(F.transform("feet", lambda a: F.when(distance(F.col("cx"), F.col("cy"), a["x"], a["y"]) <= a["limit"], 0.45 * (1 - distance(F.col("cx"), F.col("cy"), a["x"], a["y"]) / a["limit"]))))
    return rows.join(feet, "frame", "left").withColumn("gain", gain).withColumn("near", F.col("gain").isNotNull()).withColumn("gain", F.coalesce("gain", F.lit(0.0))).drop("feet")


def pick_ball(ts: int, candidates: list[tuple], before: tuple | None) -> int | None:
    """Which of one time's candidates(cx, cy, confidence, gain, near) is the ball, given (ts_ms, cx, cy) of the last choice."""
    best, most = None, 0.0
    for i, (x, y, confidence, gain, near) in enumerate(candidates):
        score, fits = confidence + gain, near
        if before is not None and ts - before[0] <= 1500:
            away = hypot(x - before[1], y - before[2])
            limit = min(360.0, max(85.0, max(1, ts - before[0]) * 1.1))
            if away <= limit:
                score, fits = score + 0.5 * (1 - away / limit), True
        if fits and (best is None or score > most):
            best, most = i, score
    return best


_BALL = ("cx", "cy", "confidence", "gain", "near")


def follow_ball(rows: pd.DataFrame, before: tuple | None) -> Iterator:
    """The candidate chosen at each time; before: (ts_ms, cx, cy) of the choice before these rows."""
    for ts, group in groupby(rows.sort_values(["ts_ms", "det_id"]).itertuples(), key=lambda r: r.ts_ms):
        group = list(group)
        best = pick_ball(ts, [tuple(getattr(r, c) for c in _BALL) for r in group], before)
        if best is not None:
            before = (ts, group[best].cx, group[best].cy)
            yield group[best]


def select_ball(candidates: DataFrame) -> DataFrame:
    """At most one of candidates(seg, ts_ms, det_id, cx, cy, confidence, gain, near) per time: near an athlete or near the
    ball chosen before, whose place raises the score. The choice feeds the next one, so a segment is one sorted pass over
    its times, each with its few candidates."""
    columns = [c for c in candidates.columns if c not in ("seg", "ts_ms", "det_id")]
    times = candidates.groupBy("seg", "ts_ms").agg(F.array_sort(F.collect_list(F.struct("det_id", *columns))).alias("c"))

    def begin():
        before = None

        def step(ts: int, found: list[dict]) -> tuple[int | None]:
            nonlocal before
            best = pick_ball(ts, [tuple(f[c] for c in _BALL) for f in found], before)
            if best is not None:
                before = (ts, found[best]["cx"], found[best]["cy"])
            return (best,)

        return step

    chosen = sorted_fold(times, ["seg"], ["ts_ms"], ["ts_ms", "c"], [T.StructField("best", T.IntegerType())], begin).where("best is not null")
    return chosen.withColumn("c", F.get("c", F.col("best"))).select("seg", "ts_ms", "c.*").select(candidates.columns)


def vote_team(seen: DataFrame) -> DataFrame:
    """seen(seg, track_id, ts_ms, team) with `voted`: the team ahead so far by max(1, round(0.12 n)) votes, else null."""
    w = ordered(["seg", "track_id"], "ts_ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    votes = lambda t: F.count_if(F.coalesce(F.col("team") == t, F.lit(False))).over(w)
    rows = seen.withColumn("h", votes("home")).withColumn("a", votes("away"))
    ahead = F.abs(F.col("h") - F.col("a")) >= F.greatest(F.lit(1), F.bround((F.col("h") + F.col("a")) * 0.12).cast("int"))
    return rows.withColumn("voted", F.when(ahead, F.when(F.col("h") > F.col("a"), "home").otherwise("away"))).drop("h", "a")


def fit_jersey_groups(features: DataFrame, iterations: int = 8, least_share: float = 0.12, least_distance: float = 12.0) -> DataFrame:
    """(match_id, a, b, accepted): two centres of features(match_id, hue, sat) per match, a the one of lower saturation.
    Starts from the means below and above the match's mean saturation; each round is one aggregation by match, in which
    partial sums meet, and centres stay a few numbers a match."""
    centre = lambda hue, sat: F.struct(hue.alias("hue"), sat.alias("sat"))
    means = features.groupBy("match_id").agg(F.avg("sat").alias("m"))
    side = F.col("sat") > F.col("m")
    centres = means
    for step in range(iterations):
        rows = features.join(centres, "match_id")
        if step:
            side = distance(F.col("hue"), F.col("sat"), F.col("b.hue"), F.col("b.sat")) < distance(F.col("hue"), F.col("sat"), F.col("a.hue"), F.col("a.sat"))
        mean = lambda c, s: F.avg(F.when(s, F.col(c)))
        found = rows.groupBy("match_id").agg(centre(mean("hue", ~side), mean("sat", ~side)).alias("a"), centre(mean("hue", side), mean("sat", side)).alias("b"), F.count_if(side).alias("nb"), F.count("*").alias("n"))
        centres = found.select("match_id", "a", "b", "nb", "n") if step == iterations - 1 else found.select("match_id", "a", "b")
    share = F.least(F.col("nb"), F.col("n") - F.col("nb")) / F.col("n")
    apart = distance(F.col("a.hue"), F.col("a.sat"), F.col("b.hue"), F.col("b.sat"))
    low, high = F.when(F.col("a.sat") <= F.col("b.sat"), F.col("a")).otherwise(F.col("b")), F.when(F.col("a.sat") <= F.col("b.sat"), F.col("b")).otherwise(F.col("a"))
    return centres.select("match_id", low.alias("a"), high.alias("b"), ((share >= least_share) & (apart >= least_distance)).alias("accepted"))


def classify_jersey(features: DataFrame, centres: DataFrame, home: str = "A", margin: float = 3.0) -> DataFrame:
    """Features with team: the nearer centre's, null if the other is less than margin farther."""
    rows = features.join(centres.where("accepted").select("match_id", "a", "b"), "match_id", "left")
    away = lambda c: distance(F.col("hue"), F.col("sat"), F.col(f"{c}.hue"), F.col(f"{c}.sat"))
    group = F.when(F.abs(away("a") - away("b")) >= margin, F.when(away("a") < away("b"), "A").otherwise("B"))
    return rows.withColumn("team", F.when(group == home, "home").when(group.isNotNull(), "away")).drop("a", "b")


def _two_groups(samples: np.ndarray, rounds: int = 40, rest: float = 0.15) -> tuple[np.ndarray, np.ndarray]:
    """Two centres of samples(hue, sat), the one of lower saturation first, and how many samples each has: means below and above
    the mean saturation, moved until they rest."""
    side = samples[:, 1] > samples[:, 1].mean()
    centres = np.full((2, 2), np.nan)
    for _ in range(rounds):
        if side.all() or not side.any():
            break
        new = np.array([samples[~side].mean(axis=0), samples[side].mean(axis=0)])
        still = np.abs(new - centres).max() <= rest
        centres = new
        far = np.linalg.norm(samples[:, None, :] - centres[None], axis=2)
        side = far[:, 1] < far[:, 0]
        if still:
            break
    order = np.lexsort((centres[:, 0], centres[:, 1]))
    return centres[order], np.array([(~side).sum(), side.sum()])[order]


def calibrated_teams(features: DataFrame, order: list[str], home: str = "A", keep: int = 400, first: int = 12, every: int = 40, least_share: float = 0.12, least_distance: float = 12.0, margin: float = 3.0) -> DataFrame:
    """features(match_id, order, hue, sat, ...) with `team`, by the two jersey groups in force when each was seen, and `fits`, how
    many fits there had been.

    A match's features come in the given order. The last `keep` are held; groups are fitted from `first` of them on and again
    when `every` more are held than at the last fit, hence not any more once all `keep` are held and fitted. A fit with a group
    under least_share of the samples (two at least) or closer centres than least_distance is not taken, and the next feature tries again.
    The nearer group's team, null before the first fit or if the other is less than margin farther. Features without a hue or
    sat have no team and are not held. The state is the held samples: a match passes as a sorted stream and is never held whole."""
    names = {0: "home", 1: "away"} if home == "A" else {0: "away", 1: "home"}

    def begin():
        held, centres, last, fits = [], None, 0, 0

        def step(hue: float | None, sat: float | None) -> tuple[str | None, int]:
            nonlocal centres, last, fits
            if hue is None or sat is None:
                return None, fits
            held.append((hue, sat))
            del held[:-keep]
            if len(held) >= first and (centres is None or len(held) - last >= every):
                found, sizes = _two_groups(np.array(held, float))
                if sizes.min() >= max(2, round(len(held) * least_share)) and np.linalg.norm(found[0] - found[1]) >= least_distance:
                    centres, last, fits = found.tolist(), len(held), fits + 1
            if centres is None:
                return None, fits
            a, b = (hypot(c[0] - hue, c[1] - sat) for c in centres)
            return names[int(b < a)] if abs(b - a) >= margin else None, fits

        return step

    added = [T.StructField("team", T.StringType()), T.StructField("fits", T.IntegerType())]
    return sorted_fold(features, ["match_id"], order, ["hue", "sat"], added, begin)


def detection_counts(detections: DataFrame, kept: DataFrame | None = None, threshold: float = 0.25) -> DataFrame:
    """Per frame: detections of each kind, with athletes under the threshold apart, and, if `kept` holds what
    suppress_duplicates left of the persons, how many of them were duplicates."""
    person = F.col("role").isin("player", "goalkeeper")
    if kept is not None:
        people = lambda rows, n: rows.where(F.col("role").isin("player", "goalkeeper", "referee")).groupBy("frame").agg(F.count("*").alias(n))
        left = people(detections, "before").join(people(kept, "after"), "frame", "left")
        gone = left.select("frame", F.greatest(F.lit(0), F.col("before") - F.coalesce("after", F.lit(0))).alias("duplicates"))
        return detection_counts(detections, threshold=threshold).join(gone, "frame", "left").fillna(0, ["duplicates"])
    return detections.groupBy("frame").agg(
        F.count("*").alias("detections"), F.count_if(person & (F.col("confidence") >= threshold)).alias("athletes"), F.count_if(person & (F.col("confidence") < threshold)).alias("rejected_athletes"),
        F.count_if(F.col("role") == "referee").alias("referees"), F.count_if(F.col("role") == "ball").alias("balls"), F.count_if(F.col("role") == "other").alias("others"),
    )


def project(x: Column, y: Column, h: Column) -> Column:
    """Struct (x, y) of a point under a row-major 3 by 3 matrix; near the horizon, or without a matrix, the point itself."""
    row = lambda i: F.get(h, F.lit(i)) * x + F.get(h, F.lit(i + 1)) * y + F.get(h, F.lit(i + 2))
    fine = F.coalesce(F.abs(row(6)) >= 1e-9, F.lit(False))
    return F.struct(F.when(fine, row(0) / row(6)).otherwise(x).alias("x"), F.when(fine, row(3) / row(6)).otherwise(y).alias("y"))


def project_points(points: DataFrame, matrices: DataFrame, by: list[str] = ["seg"]) -> DataFrame:  # noqa: B006
    """points(by, x, y) with px, py under their segment's matrices(by, h)."""
    rows = points.join(matrices.select(*by, "h"), by, "left").withColumn("p", project(F.col("x"), F.col("y"), F.col("h")))
    return rows.withColumn("px", F.col("p.x")).withColumn("py", F.col("p.y")).drop("h", "p")


def fit_homographies(pairs: DataFrame, within: float = 4.0, trials: int = 200, seed: int = 3) -> DataFrame:
    """(seg, h) from pairs(seg, x, y, to_x, to_y): the row-major matrix that most pairs agree with within `within`, fitted to
    those by least squares; no row under four usable pairs. A segment's pairs are the few points that someone marked."""

    def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
        def plain(p: np.ndarray) -> np.ndarray:  # centre 0, mean distance sqrt(2)
            spread = np.sqrt(((p - p.mean(axis=0)) ** 2).sum(axis=1)).mean()
            k = np.sqrt(2) / spread if spread > 0 else 1.0
            return np.array([[k, 0, -k * p[:, 0].mean()], [0, k, -k * p[:, 1].mean()], [0, 0, 1]])

        ta, tb = plain(a), plain(b)
        one = np.ones((len(a), 1))
        p, q = np.hstack([a, one]) @ ta.T, np.hstack([b, one]) @ tb.T
        zero = np.zeros_like(p)
        rows = np.vstack([np.hstack([p, zero, -q[:, :1] * p]), np.hstack([zero, p, -q[:, 1:2] * p])])
        _, values, v = np.linalg.svd(rows)
        if values[7] < 1e-9:
            return None
        h = np.linalg.inv(tb) @ v[-1].reshape(3, 3) @ ta
        return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None

    def miss(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        p = np.hstack([a, np.ones((len(a), 1))]) @ h.T
        with np.errstate(all="ignore"):
            return np.nan_to_num(np.hypot(*(p[:, :2] / p[:, 2:] - b).T), nan=np.inf)

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.dropna().sort_values(["x", "y", "to_x", "to_y"])
        a, b = part[["x", "y"]].to_numpy(float), part[["to_x", "to_y"]].to_numpy(float)
        rng, best = np.random.default_rng(seed), np.zeros(len(part), bool)
        for trial in range(trials + 1 if len(part) >= 4 else 0):
            chosen = np.arange(len(part)) if trial == 0 else rng.choice(len(part), 4, replace=False)
            h = solve(a[chosen], b[chosen])
            if h is not None and (near := miss(h, a, b) <= within).sum() > best.sum():
                best = near
        h = solve(a[best], b[best]) if best.sum() >= 4 else None
        rows = pd.DataFrame({"seg": [key[0]], "h": [[] if h is None else h.ravel().tolist()]})
        return rows if h is not None else rows[:0]

    kind = pairs.schema["seg"].dataType.simpleString()
    return pairs.select("seg", "x", "y", "to_x", "to_y").groupBy("seg").applyInPandas(fit, f"seg {kind}, h array<double>")


def reprojection_error(pairs: DataFrame) -> DataFrame:
    """Per segment of pairs(seg, x, y, to_x, to_y, h): the mean distance of projected points, null under four pairs."""
    p = project(F.col("x"), F.col("y"), F.col("h"))
    error = F.avg(distance(p["x"], p["y"], F.col("to_x"), F.col("to_y")))
    return pairs.groupBy("seg").agg(F.count("*").alias("pairs"), F.when(F.count("*") >= 4, error).alias("mean_error"))


def _product(a: Column, b: Column) -> Column:
    """Of two row-major 3 by 3 matrices, so scaled that its last entry is 1 where that is not 0."""
    cells = [F.get(a, F.lit(3 * i)) * F.get(b, F.lit(j)) + F.get(a, F.lit(3 * i + 1)) * F.get(b, F.lit(3 + j)) + F.get(a, F.lit(3 * i + 2)) * F.get(b, F.lit(6 + j)) for i in range(3) for j in range(3)]
    by = F.when(F.abs(cells[8]) > 1e-12, cells[8]).otherwise(1.0)
    return F.array(*(c / by for c in cells))


def _running(rows: DataFrame, by: list[str], order: str, matrix: str, out: str) -> DataFrame:
    """rows with the products of a key's matrices up to each row; null ones change nothing."""

    def begin():
        total = np.eye(3)

        def step(h: list[float] | None) -> tuple[list[float]]:
            nonlocal total
            if h is not None:
                total = total @ np.array(h, float).reshape(3, 3)
                total = total / total[2, 2] if abs(total[2, 2]) > 1e-12 else total
            return (total.ravel().tolist(),)

        return step

    return sorted_fold(rows, by, [order], [matrix], [T.StructField(out, T.ArrayType(T.DoubleType()))], begin)


def compose_homographies(camera: DataFrame, block: int = 256) -> DataFrame:
    """camera(seg, ts_ms, h, reliable, reset) with `shot` and `total`: the product of the reliable matrices since the last reset.

    Products don't commute but may be bracketed at will: a shot is cut into blocks of `block` frames, which are multiplied in
    parallel, the blocks' own products are then multiplied up in order, one row a block, and each frame's total is the product before its
    block times the one inside it. So no task holds more than a block, or a shot's blocks."""
    rows = camera.withColumn("shot", F.sum(F.col("reset").cast("int")).over(ordered(["seg"], "ts_ms")))
    place = F.row_number().over(ordered(["seg", "shot"], "ts_ms")) - 1
    rows = rows.withColumn("_block", F.floor(place / block)).withColumn("_h", F.when(F.col("reliable"), F.col("h")))
    inside = _running(rows, ["seg", "shot", "_block"], "ts_ms", "_h", "_inside")
    blocks = inside.groupBy("seg", "shot", "_block").agg(F.max_by("_inside", "ts_ms").alias("_own"))
    upto = _running(blocks, ["seg", "shot"], "_block", "_own", "_before")
    before = upto.select("seg", "shot", (F.col("_block") + 1).alias("_block"), "_before")
    found = inside.join(before, ["seg", "shot", "_block"], "left")
    total = F.when(F.col("_before").isNull(), F.col("_inside")).otherwise(_product(F.col("_before"), F.col("_inside")))
    return found.select(*camera.columns, "shot", total.alias("total"))


def camera_summary(camera: DataFrame, by: str = "seg") -> DataFrame:
    return camera.groupBy(by).agg(F.count("*").alias("frames"), F.count_if("reliable").alias("reliable_frames"), F.round(F.count_if("reliable") / F.count("*"), 4).alias("reliable_ratio"), F.count_if("reset").alias("resets"), F.round(F.avg("inlier_ratio"), 4).alias("mean_inlier_ratio"))


def track_velocity(objects: DataFrame) -> DataFrame:
    """objects(seg, frame, track_id, cx, cy; one row per frame and track) with vx, vy, speed and shown (speed of 1 at least):
    the mean step over the last five places, begun again when the track skips a frame."""
    w = ordered(["seg", "track_id"], "frame")
    rows = objects.withColumn("island", F.sum(F.coalesce((F.col("frame") - F.lag("frame").over(w) != 1).cast("int"), F.lit(1))).over(w))
    track = ordered(["seg", "track_id", "island"], "frame")
    for c in ("x", "y"):
        place = F.col(f"c{c}").cast("int")
        rows = rows.withColumn(f"d{c}", place - F.lag(place).over(track))
    for c in ("x", "y"):
        rows = rows.withColumn(f"v{c}", F.avg(f"d{c}").over(track.rowsBetween(-3, 0)))
    speed = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))
    return rows.withColumn("speed", speed).withColumn("shown", F.coalesce(speed >= 1.0, F.lit(False))).drop("dx", "dy", "island")
