"""Annotations from and to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import file_label, image_path
from ..operators.timegrid import with_time_before
from .split_json import top_objects

#: The 9 columns of a ground-truth file, and the classes that its 12 numbers stand for.
MOT_COLUMNS = "frame_id int, traj_id long, left double, top double, width double, height double, confidence double, class int, visibility double"
MOT_CLASSES = ["person", "vehicle", "other"]
PERSONS, VEHICLES = (1, 2, 7), (3, 4, 5, 6)

POINT_LISTS = "pose_pos array<array<double>>, pose_conf array<double>, face_pos array<array<double>>, face_conf array<double>, attr array<double>, subbox array<double>, subbox_conf double"
PAYLOADS = ", ".join([f"{n}_jpeg: struct<time: double, data: string>, {n}_embedding: struct<time: double, quality: double, data: array<float>>" for n in ("face", "clip")])
OBJECT = "struct<box: array<double>, class: int, conf: double, " + POINT_LISTS.replace(" array", ": array").replace("subbox_conf double", "subbox_conf: double") + f", {PAYLOADS}>"
DETECTION = "struct<class: int, confidence: double, box: array<double>>"
DEBUG = f"struct<detections: struct<data: struct<detections: array<{DETECTION}>>>, detection_roi: struct<data: struct<roi: array<double>>>, motion_roi: struct<data: struct<roi: array<double>>>>"
NATIVE = (
    "metadata struct<frame_rate: double, width: int, height: int, classes: array<string>, original_video: string>, "
    f"frames array<struct<frame_id: bigint, frame_time: double, image_path: string, result_type: string, objects: map<string, {OBJECT}>, tracker_debug: {DEBUG}>>"
)


def _rounded(value: Column, places: int | None) -> Column:
    return value if places is None else F.bround(value, places)


def normalise_mot(rows: DataFrame, places: int | None = 4) -> DataFrame:
    """Objects from ground-truth rows with im_width, im_height, frame_rate and im_dir: boxes over the image size, three
    classes, confidence 1, frames from 0."""
    c = F.col
    kind = F.when(c("class").isin(*PERSONS), 0).when(c("class").isin(*VEHICLES), 1).otherwise(2)
    box = {"x1": c("left") / c("im_width"), "y1": c("top") / c("im_height"), "x2": (c("left") + c("width")) / c("im_width"), "y2": (c("top") + c("height")) / c("im_height")}
    return rows.withColumns({k: _rounded(v, places) for k, v in box.items()} | {
        "class_id": kind, "conf": F.lit(1.0), "frame_idx": (c("frame_id") - 1).cast("long"), "frame_time": (c("frame_id") - 1) / c("frame_rate"), "image_path": image_path(c("im_dir"), c("frame_id")),
    })


def normalise_boxes(rows: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """Objects from rows with a label and 1-based left, top, width and height: four places; class_id is the label's place in
    `person` and then the other labels (given, or all of the table in order)."""
    c = F.col
    box = {"x1": (c("left") - 1) / c("im_width"), "y1": (c("top") - 1) / c("im_height"), "x2": (c("left") - 1 + c("width")) / c("im_width"), "y2": (c("top") - 1 + c("height")) / c("im_height")}
    out = rows.withColumns({k: F.bround(v, 4) for k, v in box.items()} | {"conf": F.lit(1.0)})
    if classes is not None:
        return out.withColumn("class_id", F.array_position(F.array(*map(F.lit, classes)), c("label")) - 1)
    names = rows.groupBy().agg(F.array_distinct(F.concat(F.array(F.lit("person")), F.array_sort(F.collect_set("label")))).alias("classes"))
    return out.crossJoin(F.broadcast(names)).withColumn("class_id", F.array_position("classes", c("label")) - 1)  # one row of labels


def read_seqinfo(spark: SparkSession, glob: str) -> DataFrame:
    """folder, name, frame_rate, length, width, height, im_dir and im_ext of each seqinfo.ini."""
    text = spark.read.text(glob, wholetext=True).select(F.regexp_replace(F.input_file_name(), "/[^/]*$", "").alias("folder"), "value")
    value = lambda key: F.regexp_extract("value", rf"(?m)^{key}\s*=\s*(.*?)\s*$", 1)
    return text.select("folder", value("name").alias("name"), value("frameRate").cast("double").alias("frame_rate"), value("seqLength").cast("int").alias("length"), value("imWidth").cast("int").alias("im_width"), value("imHeight").cast("int").alias("im_height"), value("imDir").alias("im_dir"), value("imExt").alias("im_ext"))


def read_mot(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sequences, frames and objects of all sequences under `folder` (*/seqinfo.ini and */gt/gt.txt).

    A sequence's last frame is left out, as its format has it; frames without objects stay. A sequence without ground truth
    fails.
    """
    info = read_seqinfo(spark, f"{folder}/*/seqinfo.ini")
    rows = spark.read.schema(MOT_COLUMNS).csv(f"{folder}/*/gt/gt.txt").withColumn("folder", F.regexp_replace(F.input_file_name(), "/gt/[^/]*$", ""))
    found = info.join(rows.select("folder").distinct().withColumn("has_gt", F.lit(True)), "folder", "left")
    info = found.withColumn("length", F.when(F.col("has_gt"), F.col("length")).otherwise(F.raise_error(F.concat(F.lit("no ground truth in "), F.col("folder"))).cast("int")))
    named = info.withColumns({"seq": F.regexp_extract("folder", "([^/]*)$", 1), "im_dir": F.concat("folder", F.lit("/"), "im_dir")})
    sequences = named.select("seq", "name", "frame_rate", F.col("im_width").alias("width"), F.col("im_height").alias("height"), F.array(*map(F.lit, MOT_CLASSES)).alias("classes"))
    numbers = named.select("*", F.explode(F.when(F.col("length") > 1, F.sequence(F.lit(1), F.col("length") - 1))).alias("frame_id"))
    frames = numbers.select("seq", (F.col("frame_id") - 1).cast("long").alias("frame_idx"), ((F.col("frame_id") - 1) / F.col("frame_rate")).alias("frame_time"), F.lit(True).alias("tracked"), F.concat(F.col("im_dir"), F.lit("/"), F.format_string("%06d", "frame_id"), F.col("im_ext")).alias("image_path"))
    objects = normalise_mot(rows.join(named, "folder").filter("frame_id BETWEEN 1 AND length - 1"))
    return sequences, frames, objects.select("seq", "frame_idx", "frame_time", "traj_id", "class_id", "conf", "x1", "y1", "x2", "y2")


def read_native(spark: SparkSession, glob: str, large: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """sequences, frames, objects, detections and regions of annotation files (JSON, one object a file). A frame without an
    object map is untracked; frames that a run skipped for its frame rate are left out, and of frames with a result type those
    with neither objects nor debug data, which a run doesn't store.

    large: a file is read by many tasks, frame by frame (split_json); else each file by one, which needs no shuffle.
    """
    name = lambda path: F.regexp_extract(path, r"([^/]*)\.[^./]*$", 1).alias("seq")
    kinds = {f.name: f.dataType for f in T._parse_datatype_string(NATIVE)}
    if large:
        parts = top_objects(spark, glob)
        sequences = parts.filter("label = 'metadata'").select(name(F.col("path")), F.from_json("text", kinds["metadata"]).alias("m")).select("seq", "m.*")
        each = parts.filter("label = 'frames'").select(name(F.col("path")), F.col("n").alias("frame_idx"), F.from_json("text", kinds["frames"].elementType).alias("f"))
    else:
        docs = spark.read.schema(NATIVE).option("multiLine", True).json(glob).withColumn("seq", name(F.input_file_name()))
        sequences = docs.select("seq", "metadata.*")
        each = docs.select("seq", F.posexplode("frames").alias("frame_idx", "f"))
    each = each.filter("f.result_type IS NULL OR f.result_type <> 'SKIP_FRAMERATE'").filter("f.objects IS NOT NULL OR f.tracker_debug IS NOT NULL OR f.result_type IS NULL")
    each = each.select("seq", F.col("frame_idx").cast("long").alias("frame_idx"), "f.*")
    frames = each.select("seq", "frame_idx", "frame_time", F.col("objects").isNotNull().alias("tracked"), "image_path")
    box = [F.get("o.box", F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]
    picture = lambda n: F.when(F.col(f"o.{n}_jpeg").isNotNull(), F.struct(F.col(f"o.{n}_jpeg.time").alias("time"), F.unbase64(f"o.{n}_jpeg.data").alias("data"))).alias(f"{n}_jpeg")
    objects = each.select("seq", "frame_idx", "frame_time", F.explode("objects").alias("id", "o")).select("seq", "frame_idx", "frame_time", F.col("id").cast("long").alias("traj_id"), F.col("o.class").alias("class_id"), "o.conf", *box, *(f"o.{x.split()[0]}" for x in POINT_LISTS.split(", ")), picture("face"), picture("clip"), "o.face_embedding", "o.clip_embedding")
    raw = each.select("seq", "frame_idx", "frame_time", F.posexplode("tracker_debug.detections.data.detections").alias("det_id", "o"))
    detections = raw.select("seq", "frame_idx", "frame_time", F.col("det_id").cast("long").alias("det_id"), F.col("o.class").alias("class_id"), F.col("o.confidence").alias("conf"), *box)
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"tracker_debug.{k}_roi.data.roi").alias("box")) for k in ("detection", "motion"))))
    regions = each.select("seq", "frame_idx", kinds.alias("o")).filter("o.box IS NOT NULL").select("seq", "frame_idx", "o.kind", *box)
    return sequences, frames, objects, detections, regions


def _frame_rows(frames: DataFrame, objects: DataFrame) -> DataFrame:
    """seq, frame_time, frame_idx and `frame`, as the files have it. Of points, attributes, sub-boxes, pictures (as base64) and
    embeddings those columns are written that objects have."""
    have, more = set(objects.columns), []
    more += [F.col(n) for n in (x.split()[0] for x in POINT_LISTS.split(", ")) if n in have]
    for n in ("face_jpeg", "clip_jpeg"):
        if n in have:
            more.append(F.when(F.col(n).isNotNull(), F.struct(F.col(f"{n}.time").alias("time"), F.base64(f"{n}.data").alias("data"))).alias(n))
    more += [F.col(n) for n in ("face_embedding", "clip_embedding") if n in have]
    one = F.struct(F.array("x1", "y1", "x2", "y2").alias("box"), F.col("class_id").alias("class"), "conf", *more)
    maps = objects.groupBy("seq", "frame_idx").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("traj_id").cast("string").alias("key"), one.alias("value"))))).alias("objects"))
    none = F.create_map().cast(maps.schema["objects"].dataType)
    filled = frames.join(maps, ["seq", "frame_idx"], "left").withColumn("objects", F.when(F.col("tracked"), F.coalesce("objects", none)))
    return filled.select("seq", "frame_time", "frame_idx", F.struct("frame_time", F.col("frame_idx").alias("frame_id"), "image_path", "objects").alias("frame"))


def _with_metadata(sequences: DataFrame, original_video: tuple[str, str] | None) -> DataFrame:
    if original_video and "original_video" in sequences.columns:
        sequences = sequences.withColumn("original_video", F.regexp_replace("original_video", *original_video))
    return sequences.select("seq", file_label(F.col("seq")).alias("file"), F.struct(*(c for c in sequences.columns if c != "seq")).alias("metadata"))


def native_documents(sequences: DataFrame, frames: DataFrame, objects: DataFrame, original_video: tuple[str, str] | None = None) -> DataFrame:
    """file (a clean name) and document (JSON text) of each sequence with frames: for short sequences, as each is one row.
    Frames are in order of time and number, untracked ones without an object map; nulls are left out. original_video:
    (pattern, replacement) for the video's path."""
    rows = _frame_rows(frames, objects)
    ordered_ = F.array_sort(F.collect_list(F.struct("frame_time", "frame_idx", F.to_json("frame").alias("text"))))
    lists = rows.groupBy("seq").agg(F.array_join(F.transform(ordered_, lambda x: x["text"]), ",").alias("frames"))
    told = _with_metadata(sequences, original_video).join(lists, "seq")
    return told.select("file", F.concat(F.lit('{"metadata":'), F.to_json("metadata"), F.lit(',"frames":['), "frames", F.lit("]}")).alias("document"))


def native_lines(sequences: DataFrame, frames: DataFrame, objects: DataFrame, original_video: tuple[str, str] | None = None) -> DataFrame:
    """file, seq, part, frame_time, frame_idx and line: the same documents in lines, in order of these columns: a head, a line for each
    frame, a tail. Without the line ends they are native_documents(), as JSON text has none of its own."""
    rows = _frame_rows(frames, objects)
    first = rows.groupBy("seq").agg(F.min(F.struct("frame_time", "frame_idx")).alias("first"))
    named = _with_metadata(sequences, original_video).join(first, "seq")
    ends = F.explode(F.array(F.struct(F.lit(0).alias("part"), F.concat(F.lit('{"metadata":'), F.to_json("metadata"), F.lit(',"frames":[')).alias("line")), F.struct(F.lit(2).alias("part"), F.lit("]}").alias("line"))))
    edges = named.select("file", "seq", ends.alias("e")).select("file", "seq", "e.part", F.lit(None).cast("double").alias("frame_time"), F.lit(None).cast("long").alias("frame_idx"), "e.line")
    is_first = F.struct("frame_time", "frame_idx") == F.col("first")
    body = rows.join(named.select("seq", "file", "first"), "seq").select("file", "seq", F.lit(1).alias("part"), F.col("frame_time").cast("double"), F.col("frame_idx").cast("long"), F.concat(F.when(is_first, "").otherwise(","), F.to_json("frame")).alias("line"))
    return edges.unionByName(body)


def write_native(sequences: DataFrame, frames: DataFrame, objects: DataFrame, folder: str, original_video: tuple[str, str] | None = None) -> None:
    """One folder `file=<name>` with one text file for each sequence: a task writes it line by line from sorted rows, so that
    its memory is that of a frame, and the sort spills."""
    order = ["file", "seq", "part", "frame_time", "frame_idx"]
    lines = native_lines(sequences, frames, objects, original_video).repartition("file").sortWithinPartitions(*order)
    lines.select("file", "line").write.partitionBy("file").text(folder)


def convert_mot(spark: SparkSession, folder: str, out: str) -> None:
    """All sequences under `folder` as annotation files under `out`: one job for the whole corpus."""
    sequences, frames, objects = read_mot(spark, folder)
    write_native(sequences, frames, objects, out)


def append_results(results: DataFrame, path: str, datasets: DataFrame) -> None:
    """Append results to the table at `path`, but for data sets marked no_cache."""
    skip = datasets.filter("no_cache").select("ds_key")
    results.join(F.broadcast(skip), "ds_key", "left_anti").write.mode("append").parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A report as one CSV file: as many rows as results, already in order."""
    rows.coalesce(1).write.option("header", True).csv(path)


def search_log(entries: DataFrame, path: str) -> None:
    """Append (iteration, vector, score, split) rows of a search."""
    entries.write.mode("append").parquet(path)


def ordered(frames: DataFrame) -> DataFrame:
    """Frames with `in_order`: whether each is later than the one before it in its sequence."""
    return with_time_before(frames, ["seq"]).withColumn("in_order", F.col("before").isNull() | (F.col("frame_time") > F.col("before"))).drop("before")
