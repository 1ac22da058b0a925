"""Rules for imported tracking frames: good frames and objects, and one row per broken rule.

Objects arrive as strings or numbers of many spellings, so scalar fields are read as text and cast with try_cast."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXTS = ("role", "track_id", "team_key", "team_cluster", "team", "shirt_number", "jersey_number", "confidence", "pitch_xy", "bbox_pitch")
OBJECT = T.StructType([T.StructField(c, T.StringType()) for c in TEXTS] + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("bbox_xyxy", "bbox_ltwh")])
FRAME = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("schema", T.StringType()), T.StructField("engine", T.StringType()), T.StructField("fps", T.DoubleType()), T.StructField("engine_revision", T.StringType()),
    T.StructField("timestamp_ms", T.DoubleType()), T.StructField("frame_index", T.DoubleType()), T.StructField("width", T.LongType()), T.StructField("height", T.LongType()), T.StructField("field_score", T.DoubleType()),
    T.StructField("scene_cut", T.BooleanType()), T.StructField("replay_probability", T.DoubleType()), T.StructField("coordinate_space", T.StringType()), T.StructField("objects", T.ArrayType(OBJECT)),
])


def timestamp_ms(timestamp: Column, frame_index: Column, fps: Column) -> Column:
    return F.coalesce(timestamp.cast("long"), F.when(fps > 0, F.bround(frame_index * 1000 / fps).cast("long")))


def team_key(value: Column, home_cluster: Column) -> Column:
    """home or away of a team named so, or by cluster: 0, a, left are A and 1, b, right are B; anything else is null."""
    v = F.lower(F.trim(value))
    cluster = F.when(v.isin("0", "a", "left"), "A").when(v.isin("1", "b", "right"), "B")
    return F.when(v.isin("home", "away"), v).when(cluster.isNotNull(), F.when(cluster == F.upper(home_cluster), "home").otherwise("away"))


def shirt(value: Column) -> Column:
    n = value.try_cast("int")
    return F.when(n.between(0, 99), n)


def sure(value: Column) -> Column:
    x = value.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (x < 0), 1.0).otherwise(F.least(F.lit(1.0), x))


def pitch(value: Column, axis: str) -> Column:
    """x or y of text that holds {x, y}, {x_bottom_middle, y_bottom_middle} or [x, y]; anything else is null."""
    at = {"x": 0, "y": 1}[axis]
    named = F.coalesce(*(F.get_json_object(value, f"$.{k}") for k in (axis, f"{axis}_bottom_middle")))
    listed = F.get_json_object(value, f"$[{at}]")
    return F.when(F.substring(F.trim(value), 1, 1) == "[", listed).when(F.contains(value, F.lit("{")), named).try_cast("double")


def header_errors(meta: DataFrame, schema: str, engine: str | None = None) -> DataFrame:
    """One row for each header whose schema isn't the expected one, or that names another engine."""
    rule = F.when(~F.col("schema").eqNullSafe(schema), "schema")
    if engine:
        rule = rule.when(~F.col("engine").isin(engine, "external"), "engine")
    return meta.withColumn("rule", rule).where("rule is not null").select("match_id", "rule")


def frame_rule(ts_ms: Column, width: Column, height: Column) -> Column:
    """The rule that a frame breaks, null for none."""
    return F.when(ts_ms.isNull(), "timestamp_missing").when(width.isNull() | height.isNull(), "size_missing").when((ts_ms < 0) | (width <= 0) | (height <= 0), "out_of_range")


def validate_frames(raw: DataFrame, meta: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frames, objects, errors) of raw frames by match_id, headers meta(match_id, engine, fps) and
    matches(match_id, home_cluster). A frame that breaks a rule goes with its objects; an object that does goes alone."""
    heads = meta.select("match_id", "engine", "fps").join(matches.select("match_id", "home_cluster"), "match_id")
    rows = raw.join(heads, "match_id").withColumn("ts_ms", timestamp_ms(F.col("timestamp_ms"), F.col("frame_index"), F.col("fps")))
    rows = rows.withColumn("rule", frame_rule(F.col("ts_ms"), F.col("width"), F.col("height")))
    # Windows keep the rows where the join by match has put them; frames without a fault of their own come first.
    w = Window.partitionBy("match_id", "ts_ms").orderBy(F.asc_nulls_first("rule"))
    same = F.count(F.when(F.col("rule").isNull(), 1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("same", same).withColumn("place", F.row_number().over(w))
    good = rows.where("rule is null and same = 1")
    frames = good.select(
        "match_id", "ts_ms", "width", "height", F.coalesce("field_score", F.lit(1.0)).alias("field_score"), F.coalesce("scene_cut", F.lit(False)).alias("scene_cut"), F.coalesce("replay_probability", F.lit(0.0)).alias("replay_probability"),
        F.coalesce("coordinate_space", F.lit("image_pixels+pitch_meters")).alias("coordinate_space"), "engine",
    )
    checked = check_objects(good.select("match_id", "ts_ms", "width", "height", "home_cluster", F.posexplode("objects").alias("obj_ord", "o")).select("match_id", "ts_ms", "width", "height", "home_cluster", "obj_ord", "o.*"))
    empty = matches.join(frames.select("match_id").distinct(), "match_id", "left_anti").select("match_id", F.lit(None).cast("long").alias("ts_ms"), F.lit("no_frames").alias("rule"))
    broken = F.coalesce("rule", F.when((F.col("same") > 1) & (F.col("place") == 1), "duplicate_timestamp"))
    errors = rows.select("match_id", "ts_ms", broken.alias("rule")).where("rule is not null").unionByName(empty)
    errors = errors.unionByName(checked.where("rule is not null").select("match_id", "ts_ms", "rule"))
    return frames, checked.where("rule is null").drop("rule"), errors


def check_objects(rows: DataFrame) -> DataFrame:
    """Exploded objects of known roles in the library's columns, with `rule` where one is broken. A track_id of 0 counts as
    missing; as ids are read as text, the text "0" does too. What an object is judged by is exploded, so that filters by the
    rule aren't taken below it with a copy of all that it uses, which the JVM would no longer compile."""
    role = F.lower(F.trim("role"))
    track = F.trim("track_id")
    ltwh = F.when(F.size("bbox_ltwh") == 4, F.expr("array(bbox_ltwh[0], bbox_ltwh[1], bbox_ltwh[0] + bbox_ltwh[2], bbox_ltwh[1] + bbox_ltwh[3])"))
    box = F.when(F.col("bbox_xyxy").isNotNull(), F.when(F.size("bbox_xyxy") == 4, F.col("bbox_xyxy"))).otherwise(ltwh)
    rows = rows.where(role.isin("player", "goalkeeper", "referee")).withColumn("box", box)
    x1, y1, x2, y2 = (F.get("box", F.lit(i)) for i in range(4))
    fits = (x1 >= 0) & (x1 < x2) & (x2 <= F.col("width")) & (y1 >= 0) & (y1 < y2) & (y2 <= F.col("height"))
    rule = F.when(track.isNull() | track.isin("", "0"), "track_id").when(F.col("box").isNull(), "box_shape").when(~F.coalesce(fits, F.lit(False)), "box_range")
    judged = F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), rule.alias("rule"))
    rows = rows.select(*(c for c in rows.columns if c not in ("box", "bbox_xyxy", "bbox_ltwh")), F.explode(F.array(judged)).alias("j")).select("*", "j.*")
    x1, x2, y2 = (F.col(c) for c in ("x1", "x2", "y2"))
    place = F.coalesce("pitch_xy", "bbox_pitch")
    return rows.select(
        "match_id", "ts_ms", "obj_ord", F.concat(F.lit("gsr-"), track).alias("track_id"), role.alias("role"), "x1", "y1", "x2", "y2", sure(F.col("confidence")).alias("confidence"),
        team_key(F.coalesce("team_key", "team_cluster", "team"), F.col("home_cluster")).alias("team_key"), shirt(F.coalesce("shirt_number", "jersey_number")).alias("shirt_number"),
        ((x1 + x2) / 2 / F.col("width")).alias("image_x"), (y2 / F.col("height")).alias("image_y"), pitch(place, "x").alias("pitch_x"), pitch(place, "y").alias("pitch_y"), "rule",
    )


def frame_counts(objects: DataFrame) -> DataFrame:
    """Per frame its athletes and referees, and the list of its detections in order; a frame holds tens of objects."""
    athlete = F.col("role").isin("player", "goalkeeper")
    box = F.array("x1", "y1", "x2", "y2").alias("bbox")
    listed = F.array_sort(F.collect_list(F.struct("obj_ord", box, "role", "confidence")))
    return objects.groupBy("match_id", "ts_ms").agg(F.count_if(athlete).alias("athletes"), F.count_if(F.col("role") == "referee").alias("referees"), F.transform(listed, lambda o: o.dropFields("obj_ord")).alias("detections"))


def import_summary(objects: DataFrame) -> DataFrame:
    return objects.groupBy("match_id").agg(
        F.count_distinct("ts_ms").alias("frames"), F.count_distinct("track_id").alias("tracks"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"),
        *(F.count_if(F.col("role") == r).alias(f"{r}s") for r in ("player", "goalkeeper", "referee")),
    )


def import_audit(frames: DataFrame, meta: DataFrame, tolerance_ms: int) -> DataFrame:
    found = frames.groupBy("match_id").agg(F.count("*").alias("frames"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))
    return meta.select("match_id", "engine", "revision").join(found, "match_id").withColumn("tolerance_ms", F.lit(tolerance_ms))
