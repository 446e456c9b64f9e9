"""Reading one large annotation file with many tasks: the document is cut at its objects, wherever the file's blocks end.

Spark's text reader splits a file at `}`. Of each segment the quotes and braces are counted; sums from the file's beginning on,
block by block, tell whether it starts inside a string, at which depth it ends, and how many objects of the second level have
ended before it. The segments of one such object, a frame or the metadata, are put together and parsed alone: no row or
task holds a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import pieces
from ..operators.tables import drop, kept

PATH = ["path"]


def _running(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """rows with the sum of a column over the file's segments up to and with each."""
    cut = pieces.carry(rows.withColumn("_value", value), PATH, {"_sum": F.sum("_value")}, {"_sum_before": F.sum("_sum").over(pieces.earlier(PATH))})
    here = pieces.up_to_here(PATH, "id")
    return cut.withColumn(name, F.sum("_value").over(here) + F.coalesce("_sum_before", F.lit(0))).drop("_value", "_sum_before")


def top_objects(spark: SparkSession, glob: str) -> DataFrame:
    """path, label, n and text (JSON) of the objects one level below a file's own: label is the key of the object, or of the list
    that it is in, n its place there. Files must hold one JSON object each, lists objects alone."""
    segments = spark.read.option("lineSep", "}").text(glob).select(F.input_file_name().alias("path"), F.col("_metadata.file_block_start").alias(pieces.PIECE), F.monotonically_increasing_id().alias("id"), "value")
    clean = F.regexp_replace("value", r"(?s)\\.", "")
    counted = lambda text, c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    segments = kept(segments, "segments")
    quoted = _running(segments, counted(clean, '"'), "quotes")
    inside = (F.col("quotes") - counted(clean, '"')) % 2 == 1
    ends_inside = F.col("quotes") % 2 == 1
    bare = F.regexp_replace(F.concat(F.when(inside, '"').otherwise(""), clean, F.when(ends_inside, '"').otherwise("")), '"[^"]*"', "")
    closing = (~ends_inside).cast("int")
    deep = kept(_running(quoted.withColumns({"closing": closing, "change": counted(bare, "{") - closing}), F.col("change"), "depth"), "depths")
    ended = ((F.col("closing") == 1) & (F.col("depth") == 1)).cast("int")
    numbered = _running(deep.withColumn("ended", ended), F.col("ended"), "ends").withColumn("number", F.col("ends") - F.col("ended"))
    part = F.struct(pieces.PIECE, "id", "value")
    whole = numbered.groupBy(*PATH, "number").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.max("ended").alias("ended")).filter("ended = 1")
    text = F.concat(F.array_join(F.transform("parts", lambda p: p["value"]), "}"), F.lit("}"))
    text = F.when(F.col("number") == 0, F.regexp_replace(text, r"^[^{]*\{", "")).otherwise(text)
    prefix, body = F.regexp_extract("text", r"^[^{]*", 0), F.regexp_replace("text", r"^[^{]*", "")
    whole = whole.select(*PATH, "number", text.alias("text")).select(*PATH, "number", F.regexp_extract(prefix, r'"([^"]*)"\s*:\s*\[?\s*$', 1).alias("label"), body.alias("text"))
    whole = kept(whole, "objects")
    drop(segments, deep)
    starts = whole.filter("label <> ''").select(*PATH, "label", F.col("number").alias("start"))  # as many as a file has keys
    starts = starts.withColumn("stop", F.lead("start").over(Window.partitionBy(*PATH).orderBy("start")))
    found = whole.drop("label").join(starts, PATH).filter("number >= start AND (stop IS NULL OR number < stop)")
    return found.select(*PATH, "label", (F.col("number") - F.col("start")).alias("n"), "text")
