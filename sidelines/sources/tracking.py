"""Reading tracking results, tracker state and rosters."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sidelines.operators.ingest import FRAME

#: Positions of a roster; others count as OTHER.
POSITIONS = ("GK", "CB", "FB", "DM", "CM", "AM", "W", "ST", "OTHER")
HEADER = ["schema", "engine", "engine_revision", "fps"]
_FRAME = [f for f in FRAME.fields if f.name not in ("type", *HEADER)]
_RECORD = T.StructType([*FRAME.fields, T.StructField("_broken", T.StringType())])
_DOCUMENT = T.StructType([T.StructField(f, FRAME[f].dataType) for f in HEADER] + [T.StructField("metadata", T.StructType([FRAME[f] for f in HEADER])), T.StructField("frames", T.ArrayType(FRAME))])


def file_stem(path: Column) -> Column:
    """The file's name without folders and endings."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^/.]*)*$", 1)


def _headers(files: DataFrame, found: DataFrame) -> DataFrame:
    """A header for each file, of nulls where it has none."""
    return files.join(found, "file", "left").select("file", "match_id", *HEADER[:2], F.col("engine_revision").alias("revision"), "fps")


def _files(spark: SparkSession, paths: list[str], match_of: Callable[[Column], Column], glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    rows = reader.load(paths).select(F.col("_metadata.file_path").alias("file"))
    return rows.where(F.lit(bool(glob)) | ~F.col("file").endswith(".json")).withColumn("match_id", match_of(F.col("file")))


def read_lines(spark: SparkSession, paths: list[str] | str, match_of: Callable[[Column], Column] = file_stem) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frames, headers, errors) of all files under paths but *.json, in one read: an object per line, of which the first of type
    `metadata` is the file's header and the others are frames where they don't name another type; blank lines don't count.

    match_of makes the match_id of a file's path. A file is cut into tasks by size like any other, so a match of any length
    is read in parallel. errors(file, match_id, line, rule) names each line that is no JSON (`line`) or no object
    (`not_object`), numbered from 1 and only in files that have one, and
    files of blank lines (`empty`); files of no bytes are not seen by Spark's readers."""
    paths = [paths] if isinstance(paths, str) else paths
    text = spark.read.option("recursiveFileLookup", True).text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    text = text.where(~F.col("file").endswith(".json")).withColumn("match_id", match_of(F.col("file")))
    line = F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))
    rows = text.withColumn("line", line).withColumn("r", F.from_json("line", _RECORD, {"columnNameOfCorruptRecord": "_broken"}))
    unread = F.col("r").isNull() | F.col("r._broken").isNotNull()
    rule = F.when(F.col("line") == "", None).when(unread & F.try_parse_json("line").isNull(), "line").when(~F.col("line").startswith("{"), "not_object")
    rows = rows.withColumn("rule", rule)
    good = rows.where("rule is null and line <> ''").withColumn("type", F.coalesce("r.type", F.lit("frame")))
    first = F.min_by(F.struct(*(F.col(f"r.{c}").alias(c) for c in HEADER)), F.struct("block", "at"))
    found = good.where("type = 'metadata'").groupBy("file").agg(first.alias("h")).select("file", "h.*")
    files = _files(spark, paths, match_of, None)
    frames = good.where("type = 'frame'").select("file", "match_id", *(F.col(f"r.{f.name}").alias(f.name) for f in _FRAME))
    broken = rows.where("rule is not null").select("file").distinct()
    places = rows.select("file", "match_id", "block", "at", "rule").join(broken, "file", "left_semi")
    places = places.withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("block", "at")).cast("long")).where("rule is not null").select("file", "match_id", "line", "rule")
    empty = files.join(rows.where("line <> ''").select("file").distinct(), "file", "left_anti").select("file", "match_id", F.lit(None).cast("long").alias("line"), F.lit("empty").alias("rule"))
    return frames, _headers(files, found), places.unionByName(empty)


def read_documents(spark: SparkSession, paths: list[str] | str, match_of: Callable[[Column], Column] = file_stem) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frames, headers, errors) of all *.json files under paths in one read: an object with a list of frames, its header in
    `metadata` or beside the list, or a list of the records that lines have. errors(file, match_id, line, rule): documents
    that are no JSON (`line`) or neither shape (`shape`), or an empty list (`empty`). A document is one value of one task."""
    paths = [paths] if isinstance(paths, str) else paths
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    listed = F.substring(F.trim(F.regexp_replace("value", r"^\s+", "")), 1, 1) == "["
    rows = text.withColumn("match_id", match_of(F.col("file"))).withColumn("d", F.when(~listed, F.from_json("value", _DOCUMENT))).withColumn("records", F.when(listed, F.from_json("value", T.ArrayType(FRAME))))
    header = F.get(F.filter("records", lambda r: r["type"] == "metadata"), F.lit(0))
    rows = rows.withColumn("records", F.coalesce("records", "d.frames")).withColumn("h", F.when(listed, F.struct(*(header[c].alias(c) for c in HEADER))).otherwise(F.struct(*(F.coalesce(f"d.metadata.{c}", f"d.{c}").alias(c) for c in HEADER))))
    each = rows.select("file", "match_id", F.explode("records").alias("r")).where("coalesce(r.type, 'frame') = 'frame'")
    frames = each.select("file", "match_id", *(F.col(f"r.{f.name}").alias(f.name) for f in _FRAME))
    files = _files(spark, paths, match_of, "*.json")
    found = rows.select("file", "h.*")
    rule = F.when(F.try_parse_json("value").isNull(), "line").when(F.col("records").isNull(), "shape").when(listed & (F.size("records") == 0), "empty")
    errors = rows.withColumn("rule", rule).where("rule is not null").select("file", "match_id", F.lit(None).cast("long").alias("line"), "rule")
    return frames, _headers(files, found), errors


def read_tracking(spark: SparkSession, paths: list[str] | str, match_of: Callable[[Column], Column] = file_stem) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frames, headers, errors) of all files under paths: *.json as documents, others as lines."""
    lines, documents = read_lines(spark, paths, match_of), read_documents(spark, paths, match_of)
    return tuple(a.unionByName(b) for a, b in zip(lines, documents, strict=True))


def read_ndjson(spark: SparkSession, path: str, match_id: str) -> tuple[DataFrame, DataFrame]:
    """(frames, header) of one match's file with an object per line."""
    frames, header, _ = read_lines(spark, path, lambda _: F.lit(match_id))
    return frames.drop("file"), header.drop("file")


def read_document(spark: SparkSession, path: str, match_id: str) -> tuple[DataFrame, DataFrame]:
    """(frames, header) of one match's JSON document. A document without frames gives a header without schema, which
    header_errors reports."""
    frames, header, _ = read_documents(spark, path, lambda _: F.lit(match_id))
    return frames.drop("file"), header.drop("file")


def read_tracker_state(spark: SparkSession, detections: str, images: str) -> DataFrame:
    """Parquet detections with their image's frame number; those without an image go."""
    return spark.read.parquet(detections).join(spark.read.parquet(images).select("image_id", "frame"), "image_id")


def check_roster(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(players, errors) of rows(name, shirt_number, position, ...) as text."""
    name, number = F.trim("name"), F.trim("shirt_number")
    rule = F.when(F.coalesce(name, F.lit("")) == "", "name").when((number != "") & number.try_cast("int").isNull(), "shirt_number")
    place = F.upper(F.trim("position"))
    rows = rows.withColumn("rule", rule)
    players = rows.where("rule is null").withColumn("name", name).withColumn("shirt_number", number.try_cast("int")).withColumn("position", F.when(place.isin(*POSITIONS), place).otherwise("OTHER"))
    return players.drop("rule"), rows.where("rule is not null")


def read_roster(spark: SparkSession, path: str, team_id: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    rows = rows.toDF(*(c.lstrip("﻿").strip() for c in rows.columns)).withColumn("team_id", F.lit(team_id))
    return check_roster(rows)
