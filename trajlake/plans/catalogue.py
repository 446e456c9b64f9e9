"""All queries over the driver's tables, and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import labels, points, vectors
from ..operators import associate, clearmot, detection, identity, motion, pairs, rollup, sweep, timegrid
from ..operators import frames as fr
from ..operators.tables import kept
from . import fixtures as fx

SEQ, FRAME = ["seq_id"], ["seq_id", "frame_idx"]
BOX = ["x1", "y1", "x2", "y2"]
CORE = [*FRAME, "traj_id"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql if sql.lstrip().startswith("--plain") else fx.SQL + sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def unit(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c) / fx.SIDE for c in BOX})


# --- projections and filters


@query("SELECT seq_id, frame_idx, traj_id, frame_time FROM fx_gt WHERE frame_time BETWEEN 10.0 AND 30.0")
def trim_range(spark: SparkSession, d: str) -> DataFrame:
    return timegrid.trim(fx.gt(spark, d), 10.0, 30.0).select(*CORE, "frame_time")


@query("SELECT seq_id, frame_idx, traj_id, CASE traj_id % 3 WHEN 0 THEN 1 WHEN 2 THEN 0 END AS class_id FROM fx_gt WHERE traj_id % 3 <> 1")
def class_remap(spark: SparkSession, d: str) -> DataFrame:
    classed = fx.gt(spark, d).withColumn("class_id", (F.col("traj_id") % 3).cast("int"))
    return fr.remap_classes(classed, ["person", "vehicle", "other"], ["other", "person"]).select(*CORE, "class_id")


@query("SELECT seq_id, frame_idx, traj_id, CASE traj_id % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'vehicle' ELSE 'other' END AS class_name FROM fx_gt")
def class_names(spark: SparkSession, d: str) -> DataFrame:
    classes = F.array(F.lit("person"), F.lit("vehicle"), F.lit("other"))
    return fx.gt(spark, d).select(*CORE, labels.class_name(classes, (F.col("traj_id") % 3).cast("int")).alias("class_name"))


@query("SELECT seq_id, frame_idx, traj_id FROM fx_hyp WHERE traj_id % 3 <> 1")
def known_classes(spark: SparkSession, d: str) -> DataFrame:
    classed = fx.hyp(spark, d).withColumn("class_id", (F.col("traj_id") % 3).cast("int"))
    return fr.known_classes(classed, ["person", "vehicle", "face"], ["person", "face"]).select(*CORE)


@query("SELECT seq_id, frame_idx, traj_id, conf FROM fx_hyp WHERE conf >= 0.5 AND class_id IS NOT NULL")
def min_confidence(spark: SparkSession, d: str) -> DataFrame:
    return fr.confident(fx.hyp(spark, d), 0.5).select(*CORE, "conf")


@query("SELECT seq_id, frame_idx, traj_id, CAST(trunc(x1/1024*1920) AS INTEGER) AS left_px, CAST(trunc(y1/1024*1080) AS INTEGER) AS top_px, CAST(trunc((x2/1024-x1/1024)*1920) AS INTEGER) AS width_px, CAST(trunc((y2/1024-y1/1024)*1080) AS INTEGER) AS height_px FROM fx_hyp")
def pixel_boxes(spark: SparkSession, d: str) -> DataFrame:
    parts = g.pixels(g.box(), F.lit(1920), F.lit(1080))
    return unit(fx.hyp(spark, d)).select(*CORE, *(p.alias(n) for p, n in zip(parts, ("left_px", "top_px", "width_px", "height_px"), strict=True)))


@query("SELECT seq_id, frame_idx, traj_id, x1 - (x2-x1)*0.125 AS x1, y1 - (y2-y1)*0.125 AS y1, x2 + (x2-x1)*0.125 AS x2, y2 + (y2-y1)*0.125 AS y2 FROM fx_gt")
def expand_box(spark: SparkSession, d: str) -> DataFrame:
    return fx.gt(spark, d).select(*CORE, *(v.alias(n) for v, n in zip(g.expand(g.box(), 1.25), BOX, strict=True)))


@query("SELECT g.seq_id, g.frame_idx, g.traj_id, least(x1, min(k.x) FILTER (kp_conf > 0.05)) AS x1, least(y1, min(k.y) FILTER (kp_conf > 0.05)) AS y1, greatest(x2, max(k.x) FILTER (kp_conf > 0.05)) AS x2, greatest(y2, max(k.y) FILTER (kp_conf > 0.05)) AS y2 FROM fx_gt g JOIN fx_kp k USING (seq_id, frame_idx, traj_id) GROUP BY g.seq_id, g.frame_idx, g.traj_id, x1, y1, x2, y2")
def grow_box_by_points(spark: SparkSession, d: str) -> DataFrame:
    return fx.points(spark, d).select(*CORE, *(v.alias(n) for v, n in zip(g.grow(g.box(), F.col("points")), BOX, strict=True)))


@query("SELECT seq_id, frame_idx, traj_id, x1/2+x2/2 AS cx, y1/2+y2/2 AS cy, (x2-x1)/(y2-y1) AS a, y2-y1 AS h FROM fx_gt")
def centre_form(spark: SparkSession, d: str) -> DataFrame:
    return fx.gt(spark, d).select(*CORE, *(v.alias(n) for v, n in zip(g.centre_form(g.box()), ("cx", "cy", "a", "h"), strict=True)))


@query("SELECT seq_id, frame_idx, det_id, CASE WHEN conf > 0.6 THEN 'initial' WHEN conf > 0.4 THEN 'high' WHEN conf > 0.3 THEN 'low' ELSE 'none' END AS tier FROM fx_det")
def conf_tiers(spark: SparkSession, d: str) -> DataFrame:
    return fx.det(spark, d).select(*FRAME, "det_id", points.tier(F.col("conf"), 0.3, 0.4, 0.6).alias("tier"))


@query("SELECT d.seq_id, d.frame_idx, det_id, r.x1 + d.x1/1024*(r.x2-r.x1) AS x1, r.y1 + d.y1/1024*(r.y2-r.y1) AS y1, r.x1 + d.x2/1024*(r.x2-r.x1) AS x2, r.y1 + d.y2/1024*(r.y2-r.y1) AS y2 FROM fx_det d JOIN fx_roi r USING (seq_id, frame_idx)")
def unmap_roi(spark: SparkSession, d: str) -> DataFrame:
    return fr.unmap_boxes(unit(fx.det(spark, d)), fx.roi(spark, d), FRAME).select(*FRAME, "det_id", *BOX)


@query("""SELECT seq_id, frame_idx, greatest(0, least(1, m - w*0.5625)) AS x1, greatest(0, least(1, y1 - (y2-y1)*0.0625)) AS y1, greatest(0, least(1, m + w*0.5625)) AS x2, greatest(0, least(1, y2 + (y2-y1)*0.0625)) AS y2
FROM (SELECT seq_id, frame_idx, (min(x1)+max(x2))/2048 AS m, greatest((max(x2)-min(x1))/1024, 0.05) AS w, min(y1)/1024 AS y1, max(y2)/1024 AS y2 FROM fx_hyp GROUP BY ALL)""")
def roi_union(spark: SparkSession, d: str) -> DataFrame:
    return fr.region_of(unit(fx.hyp(spark, d)), FRAME, 1.125)


@query("""SELECT d.seq_id, d.frame_idx, traj_id, round(r.x1 + x/1024*(r.x2-r.x1), 6) AS x, round(r.y1 + y/1024*(r.y2-r.y1), 6) AS y, round(r.x1 + d.x1/1024*(r.x2-r.x1), 6) AS sub_x1, round(r.y1 + d.y2/1024*(r.y2-r.y1), 6) AS sub_y2
FROM (SELECT g.*, x, y FROM fx_gt g JOIN fx_kp k USING (seq_id, frame_idx, traj_id) WHERE kp_idx = 5) d JOIN fx_roi r ON r.seq_id = d.seq_id AND r.frame_idx = d.frame_idx""")
def unmap_part_points(spark: SparkSession, d: str) -> DataFrame:
    """A point of each pose and the corners of sub-boxes, taken into the region as relative, out again."""
    at = lambda n: F.transform("points", lambda p: F.array(p["x"] / fx.SIDE, p["y"] / fx.SIDE)).alias(n)
    rows = fx.points(spark, d).select(*CORE, at("pose_pos"), F.array(*(F.col(c) / fx.SIDE for c in BOX)).alias("subbox"))
    found = fr.unmap_parts(rows, fx.roi(spark, d), FRAME)
    five = F.get("pose_pos", F.lit(5))
    return rounded(found.select(*CORE, F.get(five, F.lit(0)).alias("x"), F.get(five, F.lit(1)).alias("y"), F.get("subbox", F.lit(0)).alias("sub_x1"), F.get("subbox", F.lit(3)).alias("sub_y2")))


@query("SELECT seq_id, frame_idx, tracked AND (x2-x1)*(y2-y1) >= 700000 AS tracked FROM fx_frames JOIN fx_roi USING (seq_id, frame_idx)")
def skip_still_frames(spark: SparkSession, d: str) -> DataFrame:
    both = fx.frames(spark, d).join(fx.roi(spark, d), FRAME)
    return fr.skip_still(both, g.area(g.box()), 700000.0).select(*FRAME, "tracked")


@query("SELECT seq_id, frame_idx, traj_id, x1/1024 AS x1, y1/1024 AS y1, x2/1024 AS x2, y2/1024 AS y2, CASE WHEN cls IN (1,2,7) THEN 0 WHEN cls BETWEEN 3 AND 6 THEN 1 ELSE 2 END AS class_id, frame_time, '/img1/' || lpad(CAST(frame_idx + 1 AS VARCHAR), 6, '0') || '.jpg' AS image_path FROM (SELECT *, traj_id % 12 + 1 AS cls FROM fx_gt)")
def mot_import_norm(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.annotations import normalise_mot

    rows = fx.gt(spark, d).select("seq_id", (F.col("frame_idx") + 1).alias("frame_id"), "traj_id", F.col("x1").alias("left"), F.col("y1").alias("top"), (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height"), (F.col("traj_id") % 12 + 1).cast("int").alias("class"))
    rows = rows.withColumns({"im_width": F.lit(1024), "im_height": F.lit(1024), "frame_rate": F.lit(32.0), "im_dir": F.lit("/img1")})
    exact = normalise_mot(rows, places=None)
    return exact.select(*CORE, *BOX, "class_id", "frame_time", "image_path")


@query("SELECT seq_id, frame_idx, traj_id, round_even((x1-1)/1024, 4) AS x1, round_even((y1-1)/1024, 4) AS y1, round_even((x1-1+100)/1024, 4) AS x2, round_even((y1-1+400)/1024, 4) AS y2, traj_id % 3 AS class_id FROM fx_gt")
def caltech_norm(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.annotations import normalise_boxes

    rows = fx.gt(spark, d).withColumns({"label": F.element_at(F.array(F.lit("person"), F.lit("people"), F.lit("rider")), (F.col("traj_id") % 3 + 1).cast("int")), "left": F.col("x1"), "top": F.col("y1"), "width": F.lit(100.0), "height": F.lit(400.0), "im_width": F.lit(1024), "im_height": F.lit(1024)})
    out = normalise_boxes(rows, ["person", "people", "rider"])
    return out.select(*CORE, *BOX, F.col("class_id").cast("int").alias("class_id"))


@query("SELECT seq_id, frame_idx, det_id FROM fx_det WHERE det_id <= 3")
def top_detections(spark: SparkSession, d: str) -> DataFrame:
    return fr.top_detections(fx.det(spark, d), FRAME, 3).select(*FRAME, "det_id")


# --- time


GRID = "fx_grid AS (SELECT seq_id, a + k/64.0 AS t FROM (SELECT seq_id, min(frame_time) AS a, max(frame_time) AS b FROM fx_half_frames GROUP BY seq_id), LATERAL (SELECT unnest(range(CAST(ceil((b - a) * 64) AS BIGINT) + 1)) AS k) r WHERE k/64.0 < b - a)"
HALF = fx.SQL.rstrip() + ",\nfx_half_frames AS (SELECT * FROM fx_frames WHERE frame_idx % 2 = 0),\n" + GRID + "\n"


def grid(spark: SparkSession, d: str) -> DataFrame:
    """Whole sequences."""
    return timegrid.time_grid(timegrid.extent(fx.half_frames(spark, d), SEQ), SEQ, F.lit(1 / 64), max_duration=float("inf")).drop("k")


@query("SELECT seq_id, CAST(k AS BIGINT) AS k, a + k/16.0 AS t FROM (SELECT seq_id, min(frame_time) AS a, max(frame_time) AS b FROM fx_frames GROUP BY seq_id), range(16016) r(k) WHERE k/16.0 < least(b - a, 1000.0)")
def eval_grid(spark: SparkSession, d: str) -> DataFrame:
    divisor = timegrid.eval_divisor(F.lit(fx.RATE), 15.0)
    return timegrid.time_grid(timegrid.extent(fx.frames(spark, d), SEQ), SEQ, divisor / fx.RATE)


@query("SELECT seq_id, min(frame_time) AS first_time, max(frame_time) AS last_time, max(frame_time) AS duration FROM fx_frames GROUP BY seq_id")
def sequence_extent(spark: SparkSession, d: str) -> DataFrame:
    return timegrid.extent(fx.frames(spark, d), SEQ)


@query("SELECT seq_id, frame_idx, coalesce(lag(frame_time) OVER w, frame_time) AS previous_time, coalesce(lead(frame_time) OVER w, frame_time) AS next_time FROM fx_frames WINDOW w AS (PARTITION BY seq_id ORDER BY frame_time)")
def frame_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return timegrid.neighbours(fx.frames(spark, d), SEQ).select(*FRAME, "previous_time", "next_time")


@query("SELECT seq_id, frame_idx FROM (SELECT *, lag(t) OVER (PARTITION BY seq_id ORDER BY frame_idx) AS before FROM (SELECT *, CASE WHEN frame_idx % 50 = 0 THEN frame_time - 0.5 ELSE frame_time END AS t FROM fx_frames)) WHERE t <= before")
def order_check(spark: SparkSession, d: str) -> DataFrame:
    bent = fx.frames(spark, d).withColumn("frame_time", F.when(F.col("frame_idx") % 50 == 0, F.col("frame_time") - 0.5).otherwise(F.col("frame_time")))
    return timegrid.out_of_order(bent, SEQ).select(*FRAME)


@query(""", fx_bent AS (SELECT seq_id, frame_idx, CASE WHEN frame_idx % 50 = 0 THEN frame_time - 0.5 WHEN frame_idx % 70 = 1 THEN CAST(frame_idx - 1 AS DOUBLE) / 32 ELSE frame_time END AS frame_time FROM fx_frames)
SELECT seq_id, frame_idx, frame_time, coalesce(frame_time > max(frame_time) OVER (PARTITION BY seq_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS accepted FROM fx_bent""")
def append_checked(spark: SparkSession, d: str) -> DataFrame:
    """Frames with late and equal times, appended in four batches by number, the last of them twice."""
    from ..operators.tables import new_path
    from ..sources import append

    n = F.col("frame_idx")
    time = F.when(n % 50 == 0, F.col("frame_time") - 0.5).when(n % 70 == 1, (n - 1) / fx.RATE).otherwise(F.col("frame_time"))
    bent = fx.frames(spark, d).select(*FRAME, time.alias("frame_time"))
    cuts = [-1, *bent.agg(F.percentile_approx("frame_idx", [0.25, 0.5, 0.75], 1000)).first()[0], 1 << 62]
    path = new_path(spark, "appended")
    for batch, (low, high) in enumerate([*zip(cuts[:-1], cuts[1:], strict=True), (cuts[-2], cuts[-1])]):
        append.append_batch(bent.filter((n > low) & (n <= high)), min(batch, 3), path, SEQ)
    sides = [append.appended(spark, path, name).drop("batch").withColumn("accepted", F.lit(name == "accepted")) for name in ("accepted", "rejected")]
    return sides[0].unionByName(sides[1])


@query("--plain\n" + HALF + "SELECT g.seq_id, g.t, f.frame_idx, f.frame_time FROM fx_grid g ASOF JOIN fx_half_frames f ON g.seq_id = f.seq_id AND g.t >= f.frame_time")
def asof_backward(spark: SparkSession, d: str) -> DataFrame:
    return timegrid.asof(grid(spark, d), fx.half_frames(spark, d), SEQ)


@query("--plain\n" + HALF + """SELECT g.seq_id, g.t, CASE WHEN b.frame_time - g.t < g.t - a.frame_time THEN b.frame_idx ELSE a.frame_idx END AS frame_idx, CASE WHEN b.frame_time - g.t < g.t - a.frame_time THEN b.frame_time ELSE a.frame_time END AS frame_time
FROM fx_grid g ASOF JOIN fx_half_frames a ON g.seq_id = a.seq_id AND g.t >= a.frame_time ASOF LEFT JOIN fx_half_frames b ON g.seq_id = b.seq_id AND g.t <= b.frame_time""")
def asof_nearest(spark: SparkSession, d: str) -> DataFrame:
    return timegrid.nearest(grid(spark, d), fx.half_frames(spark, d), SEQ)


NEAREST = """, fx_near AS (SELECT g.seq_id, g.t, CASE WHEN b.frame_time - g.t < g.t - a.frame_time THEN b.frame_idx ELSE a.frame_idx END AS frame_idx
FROM fx_grid g ASOF JOIN fx_half_frames a ON g.seq_id = a.seq_id AND g.t >= a.frame_time ASOF LEFT JOIN fx_half_frames b ON g.seq_id = b.seq_id AND g.t <= b.frame_time)
"""


@query("--plain\n" + HALF.rstrip() + NEAREST + "SELECT seq_id, t, '/img/' || lpad(CAST(frame_idx AS VARCHAR), 6, '0') || '.jpg' AS image_path FROM fx_near")
def image_at_time(spark: SparkSession, d: str) -> DataFrame:
    frames = fx.half_frames(spark, d).withColumn("image_path", labels.image_path(F.lit("/img"), F.col("frame_idx")))
    return timegrid.frame_at(grid(spark, d), frames, SEQ, ["image_path"]).select("seq_id", "t", "image_path")


@query("--plain\n" + HALF.rstrip() + NEAREST + "SELECT seq_id, t, NOT tracked AS skipped FROM fx_near JOIN fx_half_frames USING (seq_id, frame_idx)")
def skipped_at_time(spark: SparkSession, d: str) -> DataFrame:
    found = timegrid.frame_at(grid(spark, d), fx.half_frames(spark, d), SEQ, ["tracked"])
    return found.select("seq_id", "t", (~F.col("tracked")).alias("skipped"))


BRACKET = """, fx_tracked AS (SELECT * FROM fx_half_frames WHERE tracked),
fx_edge AS (SELECT seq_id, min(frame_time) AS first_time, max(frame_time) AS last_time, min(frame_idx) AS first_idx, max(frame_idx) AS last_idx FROM fx_half_frames GROUP BY seq_id),
fx_left AS (SELECT g.seq_id, g.t, coalesce(a.frame_idx, first_idx) AS left_idx, coalesce(a.frame_time, first_time) AS left_time, last_idx, last_time FROM fx_grid g JOIN fx_edge USING (seq_id) ASOF LEFT JOIN fx_tracked a ON g.seq_id = a.seq_id AND g.t >= a.frame_time),
fx_bracket AS (SELECT l.seq_id, l.t, left_idx, left_time, coalesce(b.frame_idx, last_idx) AS right_idx, coalesce(b.frame_time, last_time) AS right_time,
  greatest(0.0, least(1.0, (l.t - left_time) / (coalesce(b.frame_time, last_time) - left_time + 1e-7))) AS share FROM fx_left l ASOF LEFT JOIN fx_tracked b ON l.seq_id = b.seq_id AND l.left_time < b.frame_time)
"""


@query("--plain\n" + HALF.rstrip() + BRACKET + "SELECT seq_id, t, left_idx, left_time, right_idx, right_time, round(share, 6) AS share FROM fx_bracket")
def bracket_frames(spark: SparkSession, d: str) -> DataFrame:
    return timegrid.bracket(grid(spark, d), fx.half_frames(spark, d), SEQ).withColumn("share", F.round("share", 6))


INTERPOLATED = """,
fx_both AS (
  SELECT coalesce(a.seq_id, b.seq_id) AS seq_id, coalesce(a.t, b.t) AS t, coalesce(a.traj_id, b.traj_id) AS traj_id, coalesce(a.share, b.share) AS f, coalesce(a.left_time, b.left_time) AS lt, coalesce(a.right_time, b.right_time) AS rt,
         a.traj_id IS NOT NULL AS l, b.traj_id IS NOT NULL AS r, a.class_id AS ac, b.class_id AS bc, a.conf AS ak, b.conf AS bk, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2
  FROM (SELECT k.*, h.traj_id, class_id, conf, x1, y1, x2, y2 FROM fx_bracket k JOIN fx_half h ON k.seq_id=h.seq_id AND k.left_idx=h.frame_idx) a
  FULL JOIN (SELECT k.*, h.traj_id, class_id, conf, x1, y1, x2, y2 FROM fx_bracket k JOIN fx_half h ON k.seq_id=h.seq_id AND k.right_idx=h.frame_idx) b ON a.seq_id=b.seq_id AND a.t=b.t AND a.traj_id=b.traj_id),
fx_source AS (SELECT *, CASE WHEN f > 0.99 THEN CASE WHEN r THEN 'right' END WHEN f < 0.01 THEN CASE WHEN l THEN 'left' END WHEN l AND r THEN 'both' WHEN l AND f <= 0.5 AND t - lt < 0.1 THEN 'left'
  WHEN r AND NOT (f <= 0.5 AND t - lt < 0.1) AND f >= 0.5 AND rt - t < 0.1 THEN 'right' END AS s FROM fx_both)
"""


@query("--plain\n" + HALF.rstrip() + BRACKET.rstrip() + INTERPOLATED + """
SELECT seq_id, t, traj_id, CASE WHEN s='right' THEN bc ELSE ac END AS class_id, round(CASE s WHEN 'both' THEN ak+(bk-ak)*f WHEN 'left' THEN ak ELSE bk END, 6) AS conf, round(CASE s WHEN 'both' THEN ax1+(bx1-ax1)*f WHEN 'left' THEN ax1 ELSE bx1 END, 4) AS x1,
  round(CASE s WHEN 'both' THEN ay1+(by1-ay1)*f WHEN 'left' THEN ay1 ELSE by1 END, 4) AS y1, round(CASE s WHEN 'both' THEN ax2+(bx2-ax2)*f WHEN 'left' THEN ax2 ELSE bx2 END, 4) AS x2, round(CASE s WHEN 'both' THEN ay2+(by2-ay2)*f WHEN 'left' THEN ay2 ELSE by2 END, 4) AS y2 FROM fx_source WHERE s IS NOT NULL""")
def interpolate_objects(spark: SparkSession, d: str) -> DataFrame:
    out = timegrid.objects_at(grid(spark, d), fx.half_frames(spark, d), fx.half(spark, d), SEQ)
    return out.withColumns({"conf": F.round("conf", 6)} | {c: F.round(c, 4) for c in BOX})


@query("SELECT seq_id, frame_idx FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY frame_time) AS n FROM fx_frames) WHERE n % 5 = 0")
def sample_every_n(spark: SparkSession, d: str) -> DataFrame:
    return timegrid.every_nth(fx.frames(spark, d), SEQ, 5).select(*FRAME)


WALK = """, fx_walk AS (SELECT seq_id, min(frame_time) AS frame_time FROM fx_frames GROUP BY seq_id
  UNION ALL SELECT w.seq_id, (SELECT min(f.frame_time) FROM fx_frames f WHERE f.seq_id = w.seq_id AND f.frame_time - w.frame_time >= 0.199) FROM fx_walk w WHERE w.frame_time IS NOT NULL)
"""


@query(WALK + "SELECT seq_id, frame_time FROM fx_walk WHERE frame_time IS NOT NULL")
def sample_min_interval(spark: SparkSession, d: str) -> DataFrame:
    return timegrid.at_interval(fx.frames(spark, d), SEQ, 0.199)


# --- pairs and events


PAIRS = "SELECT seq_id, frame_idx, oid, hid, round(d, 6) AS d FROM fx_pairs"


@query(PAIRS)
def iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pairs.iou_pairs(fx.gt(spark, d), fx.hyp(spark, d), FRAME))


@query(PAIRS)
def grid_iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pairs.grid_iou_pairs(fx.gt(spark, d), fx.hyp(spark, d), FRAME, fx.SIDE, fx.SIDE))


def log(spark: SparkSession, d: str) -> DataFrame:
    return clearmot.events(fx.gt(spark, d), fx.hyp(spark, d), SEQ)


@query("SELECT seq_id, frame_idx, type, oid, hid, round(d, 6) AS d FROM fx_log")
def clear_mot_events(spark: SparkSession, d: str) -> DataFrame:
    return rounded(log(spark, d))


def _labels_sql(side: str, table: str) -> str:
    return f"""SELECT n.seq_id, n.frame_idx, n.traj_id, '{side}' AS side, CASE type WHEN 'MATCH' THEN 'OK' WHEN 'SWITCH' THEN 'SW' ELSE type END AS label FROM (
  SELECT o.*, CASE WHEN b.frame_time - o.t < o.t - a.frame_time THEN b.frame_idx ELSE a.frame_idx END AS log_frame FROM (SELECT seq_id, frame_idx, traj_id, frame_time + 0.0234375 AS t FROM {table}) o
  ASOF JOIN fx_frames a ON o.seq_id = a.seq_id AND o.t >= a.frame_time ASOF LEFT JOIN fx_frames b ON o.seq_id = b.seq_id AND o.t <= b.frame_time) n
  LEFT JOIN fx_log l ON l.seq_id = n.seq_id AND l.frame_idx = n.log_frame AND l.{side} = n.traj_id"""


@query(f"{_labels_sql('oid', 'fx_gt')} UNION ALL {_labels_sql('hid', 'fx_hyp')}")
def object_labels(spark: SparkSession, d: str) -> DataFrame:
    """Objects and predictions seen three quarters of a frame later."""
    events, times, out = clearmot.kept_events(fx.gt(spark, d), fx.hyp(spark, d), SEQ), fx.frames(spark, d), []
    for side, rows in (("oid", fx.gt(spark, d)), ("hid", fx.hyp(spark, d))):
        later = rows.select(*CORE, (F.col("frame_time") + 0.0234375).alias("frame_time"))
        out.append(clearmot.label_objects(later, events, times, SEQ, side).select(*CORE, F.lit(side).alias("side"), "label"))
    return out[0].unionByName(out[1])


@query("""SELECT seq_id, frame_idx, num_match, num_miss, num_fp, num_switch, num_gt, round(1-(num_miss+num_fp+num_switch)/CASE WHEN num_gt>0 THEN num_gt ELSE 1e-7 END, 6) AS mota, CASE WHEN num_gt>0 THEN round(1-(num_miss+num_fp+num_switch)/num_gt, 6) END AS mota_or_null
FROM (SELECT seq_id, frame_idx, count(*) FILTER (type='MATCH') AS num_match, count(*) FILTER (type='MISS') AS num_miss, count(*) FILTER (type='FP') AS num_fp, count(*) FILTER (type='SWITCH') AS num_switch, count(oid) AS num_gt FROM fx_log GROUP BY ALL)""")
def frame_mota(spark: SparkSession, d: str) -> DataFrame:
    return rounded(clearmot.frame_scores(log(spark, d), SEQ))


COUNTS = ["num_frames", "num_objects", "num_predictions", "num_matches", "num_switches", "num_false_positives", "num_misses", "num_unique_objects", "mostly_tracked", "partially_tracked", "mostly_lost", "mostly_lost2", "missed", "num_fragmentations", "fp_tracks", "idtp", "idfp", "idfn"]
RATES = ["motp", "recall", "precision", "mota", "idf1", "idp", "idr", "mostly_tracked_frac", "partially_tracked_frac", "mostly_lost2_frac", "missed_frac", "fp_tracks_frac", "fp_per_frame", "fn_per_obj", "switch_per_obj", "frag_per_obj", "fitness"]
MEASURES = ", ".join([*COUNTS, *(f"round({r}, 6) AS {r}" for r in RATES)])


def all_measures(spark: SparkSession, d: str) -> DataFrame:
    """Pairs and the log are written once, as both have several readers."""
    objects, predictions = fx.gt(spark, d), fx.hyp(spark, d)
    gated = kept(pairs.iou_pairs(objects, predictions, FRAME), "pairs")
    told = kept(clearmot.events(objects, predictions, SEQ, pairs=gated), "log")
    return clearmot.measures(told, SEQ, identity.identity_matches(gated, SEQ))


@query(f"SELECT seq_id, {MEASURES} FROM fx_measures")
def mot_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(all_measures(spark, d).select("seq_id", *COUNTS, *RATES))


@query("SELECT seq_id, hid FROM fx_log WHERE hid IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (type='MATCH') = 0")
def fp_tracks(spark: SparkSession, d: str) -> DataFrame:
    return clearmot.never_matched(log(spark, d), SEQ, "hid")


@query(", fx_few AS (SELECT *, oid IS NOT NULL AND seq_id = oid % 8 AS hidden FROM fx_log) SELECT seq_id, oid FROM fx_few WHERE oid IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (type='MATCH' AND NOT hidden) = 0")
def missed_trajectories(spark: SparkSession, d: str) -> DataFrame:
    hidden = log(spark, d).withColumn("type", F.when(F.col("oid").isNotNull() & (F.col("seq_id") == F.col("oid") % 8), "MISS").otherwise(F.col("type")))
    return clearmot.never_matched(hidden, SEQ, "oid")


@query("SELECT seq_id, oid, frames, tracked, matched, round(tracked/frames, 6) AS share, CASE WHEN tracked/frames >= 0.8 THEN 'mostly_tracked' WHEN tracked/frames >= 0.2 THEN 'partially_tracked' ELSE 'mostly_lost' END AS coverage FROM fx_object")
def trajectory_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(clearmot.coverage(log(spark, d), SEQ))


@query("SELECT seq_id, oid, fragmentations FROM fx_frag")
def fragmentations(spark: SparkSession, d: str) -> DataFrame:
    return clearmot.fragmentations(log(spark, d), SEQ)


@query("SELECT seq_id, idtp FROM fx_ids")
def idf1(spark: SparkSession, d: str) -> DataFrame:
    return identity.identity_matches(pairs.iou_pairs(fx.gt(spark, d), fx.hyp(spark, d), FRAME), SEQ)


@query(""", fx_met AS (SELECT seq_id, ln AS oid, 100 + CASE WHEN (ok*7+ln*3)%5 < 2 THEN xor(ln, 1) ELSE ln END AS hid, count(*) AS n FROM fx_gt GROUP BY ALL),
fx_cell AS (SELECT seq_id, oid // 2 AS grp, oid % 2 AS o, hid % 2 AS h, n FROM fx_met),
fx_choice AS (SELECT seq_id, grp, greatest(coalesce(sum(n) FILTER (o = h), 0), coalesce(sum(n) FILTER (o <> h), 0)) AS best FROM fx_cell GROUP BY ALL)
SELECT seq_id, CAST(sum(best) AS BIGINT) AS idtp FROM fx_choice GROUP BY seq_id""")
def identity_crossed(spark: SparkSession, d: str) -> DataFrame:
    """Identities of objects whose predictions change places with a neighbour's: components of two objects and two predictions."""
    ok, ln = F.col("ok"), F.col("ln")
    hid = 100 + F.when((ok * 7 + ln * 3) % 5 < 2, ln.bitwiseXOR(F.lit(1).cast("long"))).otherwise(ln)
    met = fx.gt(spark, d).select(*FRAME, F.col("traj_id").alias("oid"), hid.alias("hid"), F.lit(0.0).alias("d"))
    return identity.identity_matches(met, SEQ)


@query("SELECT seq_id, frame_idx, oid, type, CAST(sum(CASE WHEN type='MISS' THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id, oid, island ORDER BY frame_idx) AS BIGINT) AS missed_in_row FROM (SELECT *, sum(CASE WHEN type='MISS' THEN 0 ELSE 1 END) OVER (PARTITION BY seq_id, oid ORDER BY frame_idx) AS island FROM fx_log WHERE oid IS NOT NULL)")
def consecutive_misses(spark: SparkSession, d: str) -> DataFrame:
    return fr.miss_runs(log(spark, d), SEQ).select(*FRAME, "oid", "type", "missed_in_row")


@query("""SELECT seq_id, count(*) AS tracked_frames, count(*) FILTER (NOT tracked) AS tracked_frames_skipped, round(count(*) FILTER (NOT tracked)/count(*), 6) AS tracked_frames_skipped_frac, max(frame_time)-min(frame_time) AS tracked_time,
round(count(*)/(max(frame_time)-min(frame_time)), 6) AS tracked_fps, round(sum((x2-x1)/1024*(y2-y1)/1024) FILTER (tracked)/(count(*) FILTER (tracked)+1e-7), 6) AS average_detection_roi_area FROM fx_frames JOIN fx_roi USING (seq_id, frame_idx) GROUP BY seq_id""")
def frame_stats_roi(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fr.stats(fx.frames(spark, d), unit(fx.roi(spark, d)), SEQ))


# --- roll-ups


RESULTS = ", fx_results AS (SELECT CAST(seq_id AS VARCHAR) AS ds_key, seq_id % 2 AS grp, 'gate45' AS test_key, * EXCLUDE (seq_id) FROM fx_measures UNION ALL SELECT CAST(seq_id AS VARCHAR), seq_id % 2, 'shifted', * EXCLUDE (seq_id) REPLACE (num_misses + 7 AS num_misses, mota - 0.125 AS mota) FROM fx_measures)\n"
ROLLED = """, fx_rolled AS (SELECT test_key, CASE WHEN grouping(grp) = 1 THEN '_overall' ELSE '__ovr' || CAST(grp AS VARCHAR) END AS ds_key, CAST(sum(num_frames) AS BIGINT) AS num_frames, CAST(sum(num_objects) AS BIGINT) AS num_objects, CAST(sum(num_switches) AS BIGINT) AS num_switches,
 CAST(sum(num_false_positives) AS BIGINT) AS num_false_positives, CAST(sum(num_misses) AS BIGINT) AS num_misses, CAST(sum(num_unique_objects) AS BIGINT) AS num_unique_objects, CAST(sum(fp_tracks) AS BIGINT) AS fp_tracks, CAST(sum(idtp) AS BIGINT) AS idtp, CAST(sum(idfp) AS BIGINT) AS idfp, CAST(sum(idfn) AS BIGINT) AS idfn,
 sum(motp*idtp)/(sum(idtp)+1e-7) AS motp, sum(fp_tracks_frac)/count(*) AS fp_tracks_frac FROM fx_results GROUP BY GROUPING SETS ((test_key, grp), (test_key)))
SELECT ds_key, test_key, num_frames, num_objects, num_switches, num_false_positives, num_misses, num_unique_objects, fp_tracks, idtp, round(2*idtp/(2*idtp+idfp+idfn+1e-7), 6) AS idf1, round(1-(num_false_positives+num_misses+num_switches)/(num_objects+1e-7), 6) AS mota, round(motp, 6) AS motp, round(fp_tracks_frac, 6) AS fp_tracks_frac,
 round(1-(num_false_positives+num_misses+num_switches)/(num_objects+1e-7) - 0.0005*fp_tracks - 0.002*num_false_positives/(num_frames+1e-7), 6) AS fitness FROM fx_rolled"""


def results(spark: SparkSession, d: str) -> DataFrame:
    """The measures of each sequence as two tests."""
    one = kept(all_measures(spark, d), "measures").withColumns({"ds_key": F.col("seq_id").cast("string"), "grp": F.col("seq_id") % 2}).drop("seq_id")
    other = one.withColumns({"test_key": F.lit("shifted"), "num_misses": F.col("num_misses") + 7, "mota": F.col("mota") - 0.125})
    return one.withColumn("test_key", F.lit("gate45")).unionByName(other)


@query(RESULTS + ROLLED)
def overall_rollup(spark: SparkSession, d: str) -> DataFrame:
    out = rollup.pooled(results(spark, d))
    return rounded(out.select("ds_key", "test_key", "num_frames", "num_objects", "num_switches", "num_false_positives", "num_misses", "num_unique_objects", "fp_tracks", "idtp", "idf1", "mota", "motp", "fp_tracks_frac", "fitness"))


@query(RESULTS + "SELECT CASE WHEN grouping(grp) = 1 THEN '_arithmean' ELSE '__mean(' || CAST(grp AS VARCHAR) || ')' END AS ds_key, test_key, metric, round(avg(value), 6) AS value FROM (UNPIVOT (SELECT ds_key, grp, test_key, CAST(mota AS DOUBLE) AS mota, CAST(num_misses AS DOUBLE) AS num_misses, CAST(fitness AS DOUBLE) AS fitness, CAST(idf1 AS DOUBLE) AS idf1 FROM fx_results) ON mota, num_misses, fitness, idf1 INTO NAME metric VALUE value) GROUP BY GROUPING SETS ((test_key, metric, grp), (test_key, metric))")
def group_mean(spark: SparkSession, d: str) -> DataFrame:
    long = rollup.long_form(results(spark, d).select("ds_key", F.col("grp").cast("string").alias("grp"), "test_key", "mota", "num_misses", "fitness", "idf1"), ["ds_key", "grp", "test_key"])
    return rounded(rollup.means(long))


@query(""", fx_runs AS (SELECT '0' AS run_id, seq_id, frame_idx, count(oid) AS n, count(*) FILTER (type='MISS') + count(*) FILTER (type='FP') + count(*) FILTER (type='SWITCH') AS bad FROM fx_log GROUP BY ALL
UNION ALL SELECT '1', seq_id, frame_idx, count(oid), count(*) FILTER (type='MISS') + count(*) FILTER (type='SWITCH') FROM fx_log GROUP BY ALL), fx_scores AS (SELECT run_id, seq_id, frame_idx, 1 - bad/n AS mota FROM fx_runs WHERE n > 0)
SELECT s.run_id, seq_id, frame_idx, round(s.mota, 6) AS mota, round(b.mota, 6) AS base, round(s.mota - b.mota, 6) AS delta, abs(s.mota - b.mota) > 0.001 AS differs FROM fx_scores s JOIN fx_scores b USING (seq_id, frame_idx) WHERE b.run_id = '0'""")
def compare_runs(spark: SparkSession, d: str) -> DataFrame:
    events = log(spark, d)
    runs = events.withColumn("run_id", F.lit("0")).unionByName(events.filter("type <> 'FP'").withColumn("run_id", F.lit("1")))
    scores = clearmot.frame_scores(runs, ["run_id", "seq_id"]).filter("mota_or_null IS NOT NULL").select("run_id", *FRAME, "mota")
    return rounded(rollup.compare_runs(scores, FRAME))


@query(RESULTS + "SELECT ds_key, metric, round(max(value) FILTER (test_key='gate45'), 6) AS gate45, round(max(value) FILTER (test_key='shifted'), 6) AS shifted FROM (UNPIVOT (SELECT ds_key, test_key, CAST(mota AS DOUBLE) AS mota, CAST(num_misses AS DOUBLE) AS num_misses, CAST(motp AS DOUBLE) AS motp FROM fx_results) ON mota, num_misses, motp INTO NAME metric VALUE value) GROUP BY ds_key, metric")
def metric_by_run(spark: SparkSession, d: str) -> DataFrame:
    one = results(spark, d).select("ds_key", F.col("test_key").alias("run_id"), "mota", "num_misses", "motp")
    return rounded(rollup.metric_table(rollup.long_form(one, ["ds_key", "run_id"]), ["gate45", "shifted"], ["ds_key"]))


@query(RESULTS + "SELECT dataset, test_key, CAST((dense_rank() OVER (ORDER BY dataset) - 1)*1000 + num_misses AS BIGINT) AS position FROM (SELECT substr('ds_' || ds_key || '_x', 1, 2) || replace(substr('ds_' || ds_key || '_x', 3), '_', '') AS dataset, test_key, num_misses FROM fx_results)")
def report_table(spark: SparkSession, d: str) -> DataFrame:
    rows = results(spark, d).withColumn("name", F.concat(F.lit("ds_"), "ds_key", F.lit("_x")))
    return rollup.report_order(rows, labels.dataset_label(F.col("name")), "num_misses").select("dataset", "test_key", "position")


@query(RESULTS + "SELECT ds_key, test_key, printf(' MOTA:%6.5f Fit:%6.5f FPTr:%d', floor(round(mota, 9)*1e5 + 0.5)/1e5, floor(round(fitness, 9)*1e5 + 0.5)/1e5, fp_tracks) AS line FROM fx_results")
def summary_lines(spark: SparkSession, d: str) -> DataFrame:
    near = lambda c: F.floor(F.round(c, 9) * 1e5 + 0.5) / 1e5
    line = labels.summary([("mota", "MOTA:", "%6.5f"), ("fitness", "Fit:", "%6.5f"), ("fp_tracks", "FPTr:", "%d")])
    return results(spark, d).withColumns({c: near(c) for c in ("mota", "fitness")}).select("ds_key", "test_key", F.concat(F.lit(" "), line).alias("line"))


@query(RESULTS + ROLLED.replace("\nSELECT ds_key", ", fx_pooled AS (SELECT ds_key") + """), fx_means AS (SELECT CASE WHEN grouping(grp) = 1 THEN '_arithmean' ELSE '__mean(' || CAST(grp AS VARCHAR) || ')' END AS ds_key, test_key, avg(mota) AS mota, avg(num_misses) AS num_misses, avg(fitness) AS fitness FROM fx_results GROUP BY GROUPING SETS ((test_key, grp), (test_key)))
SELECT ds_key, test_key, round(mota, 6) AS mota, CAST(num_misses AS DOUBLE) AS num_misses, round(fitness, 6) AS fitness FROM (SELECT ds_key, test_key, mota, num_misses, fitness FROM fx_results UNION ALL SELECT ds_key, test_key, mota, num_misses, fitness FROM fx_pooled UNION ALL SELECT * FROM fx_means)""")
def report_rows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rollup.with_pooled(results(spark, d)).select("ds_key", "test_key", "mota", F.col("num_misses").cast("double").alias("num_misses"), "fitness"))


@query("--plain\nSELECT k, n AS x, CASE WHEN k % 3 = 0 THEN 1.0 ELSE low END::DOUBLE AS y, CASE WHEN k % 3 = 0 THEN 2.0 END::DOUBLE AS z FROM (SELECT l_partkey % 20 AS k, count(*)::DOUBLE AS n, min(l_quantity)::DOUBLE AS low FROM lineitem GROUP BY ALL)")
def merged_settings(spark: SparkSession, d: str) -> DataFrame:
    base = spark.read.parquet(f"{d}/lineitem.parquet").groupBy((F.col("l_partkey") % 20).alias("k")).agg(F.count("*").cast("double").alias("n"), F.min("l_quantity").cast("double").alias("low"))
    over = F.when(F.col("k") % 3 == 0, F.create_map(F.lit("y"), F.lit(1.0), F.lit("z"), F.lit(2.0)))
    both = rollup.merged(F.create_map(F.lit("x"), F.col("n"), F.lit("y"), F.col("low")), over)
    return base.select("k", *(F.try_element_at(both, F.lit(c)).alias(c) for c in "xyz"))


@query("SELECT seq_id, frame_idx, traj_id, greatest(0.01, least(0.95, conf*1.75 - 0.5)) AS threshold FROM fx_hyp")
def clamped_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return fx.hyp(spark, d).select(*CORE, points.clamped(F.col("conf") * 1.75 - 0.5).alias("threshold"))


@query("SELECT seq_id, frame_idx, traj_id, [x1, y1, x2, y2] AS box, class_id, conf FROM fx_hyp")
def detection_structs(spark: SparkSession, d: str) -> DataFrame:
    one = g.detection(g.box(), F.col("class_id"), F.col("conf"), F.col("traj_id").cast("double"))
    return fx.hyp(spark, d).select(*FRAME, one.alias("o")).select(*FRAME, "o.traj_id", "o.box", "o.class_id", "o.conf")


TESTS = """, fx_tests AS (SELECT 'p' || l_partkey AS test_key, CASE WHEN l_partkey % 3 = 0 THEN 0.25 END AS min_interval FROM (SELECT DISTINCT l_partkey % 20 AS l_partkey FROM lineitem)),
fx_expanded AS (SELECT test_key, CAST(min_interval AS DOUBLE) AS min_interval FROM fx_tests WHERE min_interval IS NOT NULL UNION ALL SELECT test_key || ', ' || name || 'fps', CASE WHEN rate < 0 THEN rate ELSE 1/(rate+0.01) END FROM fx_tests, (VALUES ('5', 5.0::DOUBLE), ('12.5', 12.5::DOUBLE), ('-2', -2.0::DOUBLE)) r(name, rate) WHERE min_interval IS NULL)
"""


def tests(spark: SparkSession, d: str) -> DataFrame:
    part = (F.col("l_partkey") % 20).alias("p")
    base = spark.read.parquet(f"{d}/lineitem.parquet").select(part).distinct()
    return base.select(F.concat(F.lit("p"), F.col("p").cast("string")).alias("test_key"), F.when(F.col("p") % 3 == 0, 0.25).alias("min_interval"))


@query(TESTS + "SELECT test_key, round(min_interval, 6) AS min_interval FROM fx_expanded")
def expand_tests(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rollup.expand_tests(tests(spark, d), [5.0, 12.5, -2.0]))


@query(TESTS + """, fx_sets AS (SELECT CAST(seq_id AS VARCHAR) AS ds_key, CASE seq_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' END AS split, seq_id = 6 AS regenerate FROM (SELECT DISTINCT seq_id FROM fx_gt)),
fx_done AS (SELECT ds_key, test_key FROM fx_sets, fx_tests WHERE (CAST(ds_key AS INT) + length(test_key)) % 2 = 0)
SELECT ds_key, test_key FROM fx_sets s, fx_tests t WHERE (split IS NULL OR split = 'train') AND (regenerate OR NOT EXISTS (SELECT 1 FROM fx_done x WHERE x.ds_key = s.ds_key AND x.test_key = t.test_key))""")
def tests_to_run(spark: SparkSession, d: str) -> DataFrame:
    seq = F.col("seq_id")
    sets = fx.gt(spark, d).select("seq_id").distinct().select(seq.cast("string").alias("ds_key"), F.when(seq % 3 == 0, "train").when(seq % 3 == 1, "val").alias("split"), (seq == 6).alias("regenerate"))
    named = tests(spark, d).withColumn("config_hash", F.sha2("test_key", 256))
    done = sets.crossJoin(named).filter((F.col("ds_key").cast("int") + F.length("test_key")) % 2 == 0).select("ds_key", "test_key", "config_hash")
    return rollup.tests_to_run(sets, named, done, "train").select("ds_key", "test_key")


# --- detections, vectors and points


@query("""SELECT d.seq_id, d.frame_idx, d.det_id, CASE WHEN g.traj_id IS NULL THEN 0 ELSE 1 END AS tp, g.traj_id AS gt_id FROM fx_det d LEFT JOIN fx_gt g ON d.seq_id=g.seq_id AND d.frame_idx=g.frame_idx AND d.y1=g.y1 AND
 greatest(0, least(d.x2,g.x2)-greatest(d.x1,g.x1))/(200-greatest(0, least(d.x2,g.x2)-greatest(d.x1,g.x1))) > 0.5""")
def det_greedy_match(spark: SparkSession, d: str) -> DataFrame:
    return detection.greedy_matches(fx.gt(spark, d), fx.det(spark, d), FRAME).select(*FRAME, "det_id", "tp", "gt_id")


@query(""", fx_hits AS (SELECT d.seq_id, d.frame_idx, d.det_id, d.conf, CASE WHEN g.traj_id IS NULL THEN 0 ELSE 1 END AS tp FROM fx_det d LEFT JOIN fx_gt g ON d.seq_id=g.seq_id AND d.frame_idx=g.frame_idx AND d.y1=g.y1 AND
 greatest(0, least(d.x2,g.x2)-greatest(d.x1,g.x1))/(200-greatest(0, least(d.x2,g.x2)-greatest(d.x1,g.x1))) > 0.5),
fx_n AS (SELECT seq_id, count(*) AS n_objects FROM fx_gt GROUP BY seq_id),
fx_curve AS (SELECT h.*, n_objects, sum(tp) OVER w AS tps, count(*) OVER w AS n FROM fx_hits h JOIN fx_n USING (seq_id) WINDOW w AS (PARTITION BY seq_id ORDER BY conf DESC, frame_idx, det_id ROWS UNBOUNDED PRECEDING)),
fx_parts AS (SELECT *, max(tps/n) OVER (PARTITION BY seq_id ORDER BY conf DESC, frame_idx, det_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * (tps/n_objects - coalesce(lag(tps/n_objects) OVER (PARTITION BY seq_id ORDER BY conf DESC, frame_idx, det_id), 0)) AS part FROM fx_curve)
SELECT seq_id, any_value(n_objects) AS n_objects, round(sum(part), 6) AS ap, round(sum(tp)/count(*), 6) AS p, round(sum(tp)/any_value(n_objects), 6) AS r, round(sum(tp) FILTER (conf>=0.25)/count(*) FILTER (conf>=0.25), 6) AS p_th25, round(sum(tp) FILTER (conf>=0.25)/any_value(n_objects), 6) AS r_th25,
 round(sum(tp) FILTER (conf>=0.3)/count(*) FILTER (conf>=0.3), 6) AS p_th30, round(sum(tp) FILTER (conf>=0.3)/any_value(n_objects), 6) AS r_th30 FROM fx_parts GROUP BY seq_id""")
def det_ap(spark: SparkSession, d: str) -> DataFrame:
    hits = detection.greedy_matches(fx.gt(spark, d), fx.det(spark, d), FRAME)
    n = fx.gt(spark, d).groupBy("seq_id").agg(F.count("*").alias("n_objects"))
    ties = ["frame_idx", "det_id"]
    return rounded(detection.average_precision(detection.precision_recall(hits, n, SEQ, ties), SEQ, ties))


TWO_CLASSES = "--plain\n" + fx.SQL.rstrip() + """,
fx_half_frames AS (SELECT * FROM fx_frames WHERE frame_idx % 2 = 0), fx_grid AS (SELECT seq_id, frame_time AS t FROM fx_frames WHERE frame_idx % 2 = 1),
fx_true AS (SELECT seq_id, frame_idx, traj_id, traj_id % 2 AS class_id, conf, x1, y1, x2, y2 FROM fx_gt WHERE frame_idx % 2 = 0 AND frame_idx % 10 <> 7)""" + BRACKET.rstrip() + INTERPOLATED.replace("fx_half h", "fx_true h").rstrip() + """,
fx_truth AS (SELECT seq_id % 2 AS run, seq_id, t, CASE WHEN s='right' THEN bc ELSE ac END AS class_id, CASE s WHEN 'both' THEN ax1+(bx1-ax1)*f WHEN 'left' THEN ax1 ELSE bx1 END AS x1, CASE s WHEN 'both' THEN ay1+(by1-ay1)*f WHEN 'left' THEN ay1 ELSE by1 END AS y1,
  CASE s WHEN 'both' THEN ax2+(bx2-ax2)*f WHEN 'left' THEN ax2 ELSE bx2 END AS x2, CASE s WHEN 'both' THEN ay2+(by2-ay2)*f WHEN 'left' THEN ay2 ELSE by2 END AS y2 FROM fx_source WHERE s IS NOT NULL),
fx_d AS (SELECT seq_id % 2 AS run, seq_id, frame_time AS t, traj_id % 2 AS class_id, conf, x1, y1, x2, y2, row_number() OVER (PARTITION BY seq_id, frame_idx ORDER BY conf DESC, x1, y1) AS det_id FROM fx_hyp WHERE frame_idx % 2 = 1),
fx_over AS (SELECT DISTINCT d.seq_id, d.t, d.det_id FROM fx_d d JOIN fx_truth g ON d.seq_id=g.seq_id AND d.t=g.t AND d.class_id=g.class_id AND greatest(0, least(d.x2,g.x2)-greatest(d.x1,g.x1))*greatest(0, least(d.y2,g.y2)-greatest(d.y1,g.y1))
  > 0.5*((d.x2-d.x1)*(d.y2-d.y1)+(g.x2-g.x1)*(g.y2-g.y1)-greatest(0, least(d.x2,g.x2)-greatest(d.x1,g.x1))*greatest(0, least(d.y2,g.y2)-greatest(d.y1,g.y1)))),
fx_hits AS (SELECT d.*, CASE WHEN o.det_id IS NULL THEN 0 ELSE 1 END AS tp FROM fx_d d LEFT JOIN fx_over o ON o.seq_id=d.seq_id AND o.t=d.t AND o.det_id=d.det_id),
fx_n AS (SELECT run, class_id, count(*) AS n_objects FROM fx_truth GROUP BY ALL)
"""


def two_classes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Detections of odd frames against truth interpolated from even ones; trajectories with even numbers are persons."""
    parity = (F.col("traj_id") % 2).cast("int")
    order = Window.partitionBy(*FRAME).orderBy(F.col("conf").desc(), "x1", "y1")
    odd = F.col("frame_idx") % 2 == 1
    detections = fx.hyp(spark, d).filter(odd).select("seq_id", F.col("frame_time").alias("t"), F.row_number().over(order).cast("long").alias("det_id"), parity.alias("class_id"), "conf", *BOX)
    objects = fx.gt(spark, d).filter((F.col("frame_idx") % 2 == 0) & (F.col("frame_idx") % 10 != 7)).withColumn("class_id", parity)
    processed = fx.frames(spark, d).filter(odd).select("seq_id", F.col("frame_time").alias("t"))
    matched, truth = detection.match_at_detections(fx.half_frames(spark, d), objects, processed, detections, SEQ)
    run = (F.col("seq_id") % 2).alias("run")
    return matched.select("*", run), truth.select("*", run)


@query(TWO_CLASSES.rstrip() + """,
fx_curve AS (SELECT h.*, n_objects, sum(tp) OVER w AS tps, count(*) OVER w AS n FROM fx_hits h JOIN fx_n USING (run, class_id) WINDOW w AS (PARTITION BY run, class_id ORDER BY conf DESC, seq_id, t, det_id ROWS UNBOUNDED PRECEDING)),
fx_parts AS (SELECT *, max(tps/n) OVER (PARTITION BY run, class_id ORDER BY conf DESC, seq_id, t, det_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * tp / n_objects AS part FROM fx_curve)
SELECT run, CASE class_id WHEN 0 THEN 'person' ELSE 'face' END AS class_name, any_value(n_objects) AS n_objects, round(sum(part), 6) AS ap, round(sum(tp)/count(*), 6) AS p, round(sum(tp)/any_value(n_objects), 6) AS r,
 round(sum(tp) FILTER (conf*999>=250)/count(*) FILTER (conf*999>=250), 6) AS p_th25, round(sum(tp) FILTER (conf*999>=250)/any_value(n_objects), 6) AS r_th25,
 round(sum(tp) FILTER (conf*999>=300)/count(*) FILTER (conf*999>=300), 6) AS p_th30, round(sum(tp) FILTER (conf*999>=300)/any_value(n_objects), 6) AS r_th30 FROM fx_parts GROUP BY run, class_id""")
def det_ap_by_class(spark: SparkSession, d: str) -> DataFrame:
    matched, truth = two_classes(spark, d)
    return rounded(detection.class_measures(matched, truth, ["run"], ["person", "face"], ["seq_id", "t", "det_id"]))


@query(TWO_CLASSES.rstrip() + """,
fx_axis AS (SELECT run, class_id, n_objects, k FROM fx_n, range(1000) r(k)),
fx_last AS (SELECT run, class_id, CAST(floor(conf*999) AS BIGINT) AS k, sum(tp) AS hits, count(*) AS n FROM fx_hits GROUP BY ALL),
fx_sums AS (SELECT a.run, a.class_id, a.k, n_objects, coalesce(sum(hits) OVER w, 0) AS hits, coalesce(sum(n) OVER w, 0) AS n FROM fx_axis a LEFT JOIN fx_last l USING (run, class_id, k) WINDOW w AS (PARTITION BY a.run, a.class_id ORDER BY a.k DESC ROWS UNBOUNDED PRECEDING))
SELECT run, CAST(class_id AS INT) AS class_id, CAST(k AS INT) AS k, round(k/999, 6) AS least_conf, round(CASE WHEN n = 0 THEN 1 ELSE hits/n END, 6) AS precision, round(hits/n_objects, 6) AS recall FROM fx_sums""")
def det_confidence_axis(spark: SparkSession, d: str) -> DataFrame:
    matched, truth = two_classes(spark, d)
    n = truth.groupBy("run", "class_id").agg(F.count("*").alias("n_objects"))
    return rounded(detection.confidence_axis(matched, n, ["run", "class_id"]))


DIMS = "--plain\nWITH e AS (SELECT vec_id, label, embedding FROM embeddings), x AS (SELECT label, unnest(range(1, len(embedding)+1)) AS dim, unnest(embedding) AS v FROM e), m AS (SELECT label, dim, avg(v::DOUBLE) AS v FROM x GROUP BY ALL), means AS (SELECT label, list(v ORDER BY dim) AS mean FROM m GROUP BY label)\n"


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", "embedding")


@query(DIMS + "SELECT label, list_transform(mean, lambda v: round(v, 6)) AS mean FROM means")
def frame_mean_embedding(spark: SparkSession, d: str) -> DataFrame:
    out = fr.mean_embedding(embeddings(spark, d), ["label"], "embedding")
    return out.withColumn("mean", F.transform("mean", lambda v: F.round(v, 6)))


@query(DIMS + """, c AS (SELECT vec_id, label, list_transform(range(1, len(embedding)+1), lambda i: embedding[i]::DOUBLE - mean[i]) AS v FROM e JOIN means USING (label)), f AS (SELECT label, arg_min(v, vec_id) AS first FROM c GROUP BY label)
SELECT vec_id, round(list_sum(list_transform(range(1, len(v)+1), lambda i: v[i]*first[i])) / (sqrt(list_sum(list_transform(v, lambda y: y*y))) * sqrt(list_sum(list_transform(first, lambda y: y*y)))), 6) + 0.0 AS cosine FROM c JOIN f USING (label)""")
def centered_cosine(spark: SparkSession, d: str) -> DataFrame:
    rows = embeddings(spark, d)
    less = rows.join(fr.mean_embedding(rows, ["label"], "embedding"), "label").withColumn("v", vectors.centred(F.col("embedding"), F.col("mean")))
    first = less.groupBy("label").agg(F.min_by("v", "vec_id").alias("first"))
    return less.join(first, "label").select("vec_id", (F.round(vectors.cosine(F.col("v"), F.col("first")), 6) + 0.0).alias("cosine"))


@query("""--plain
WITH RECURSIVE e AS (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
r AS (SELECT label, n, list_transform(embedding, lambda v: v::DOUBLE) AS s FROM e WHERE n = 1 UNION ALL SELECT e.label, e.n, list_transform(range(1, len(s)+1), lambda i: 0.5*e.embedding[i] + 0.5*s[i]) FROM r JOIN e ON e.label = r.label AND e.n = r.n + 1)
SELECT label, list_transform(arg_max(s, n), lambda v: round(v, 6)) AS blend FROM r GROUP BY label""")
def embedding_ema(spark: SparkSession, d: str) -> DataFrame:
    out = fr.running_embedding(embeddings(spark, d), ["label"], "embedding", "vec_id")
    return out.select("label", F.transform("blend", lambda x: F.round(x, 6)).alias("blend"))


@query("--plain\nWITH p AS (SELECT vec_id, embedding AS b, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS a FROM embeddings) SELECT vec_id, list_transform(range(1, len(a)+1), lambda i: round(greatest(a[i], b[i])::DOUBLE*0.9 + least(a[i], b[i])::DOUBLE*0.1, 6)) AS blend FROM p WHERE a IS NOT NULL")
def attribute_blend(spark: SparkSession, d: str) -> DataFrame:
    out = fr.with_previous(embeddings(spark, d), ["label"], "embedding", "vec_id", "a").filter("a IS NOT NULL")
    wide = lambda c: F.transform(c, lambda x: x.cast("double"))
    return out.select("vec_id", F.transform(vectors.max_blend(wide("a"), wide("embedding")), lambda x: vectors.rounded(x, 6)).alias("blend"))


@query(""", fx_sig AS (SELECT i, s FROM (SELECT unnest(range(17)) AS i, unnest([0.026,0.025,0.025,0.035,0.035,0.079,0.079,0.072,0.072,0.062,0.062,0.107,0.107,0.087,0.087,0.089,0.089]::DOUBLE[]) AS s)),
fx_next AS (SELECT a.seq_id, a.frame_idx, a.traj_id, a.x AS ax, a.y AS ay, a.kp_conf AS ac, b.x AS bx, b.y AS by_, b.kp_conf AS bc, s FROM fx_kp a JOIN fx_kp b ON a.seq_id=b.seq_id AND a.traj_id=b.traj_id AND b.frame_idx=a.frame_idx+1 AND a.kp_idx=b.kp_idx JOIN fx_sig ON i=a.kp_idx)
SELECT seq_id, frame_idx, traj_id, CASE WHEN count(*) FILTER (ac>0 AND bc>0) > 4 THEN round(sum(exp(-((ax-bx)^2+(ay-by_)^2)/(2*(40000+40000)*0.5*0.53*4*s*s+1e-7))) FILTER (ac>0 AND bc>0)/(count(*) FILTER (ac>0 AND bc>0)+1e-7), 6) END AS oks FROM fx_next GROUP BY ALL""")
def oks_similarity(spark: SparkSession, d: str) -> DataFrame:
    a = fx.points(spark, d).select(*CORE, F.col("points").alias("p"))
    b = a.select("seq_id", (F.col("frame_idx") - 1).alias("frame_idx"), "traj_id", F.col("p").alias("q"))
    size = F.lit(40000.0)
    return a.join(b, CORE).select(*CORE, F.round(points.similarity(F.col("p"), F.col("q"), size, size), 6).alias("oks"))


@query("SELECT g.seq_id, g.frame_idx, g.traj_id, conf + 0.0625*sum(kp_conf) AS adjusted FROM fx_gt g JOIN fx_kp k USING (seq_id, frame_idx, traj_id) GROUP BY g.seq_id, g.frame_idx, g.traj_id, conf")
def adjusted_confidence(spark: SparkSession, d: str) -> DataFrame:
    confs = F.transform("points", lambda p: p["conf"])
    return fx.points(spark, d).select(*CORE, points.adjusted_confidence(F.col("conf"), confs, 0.0625).alias("adjusted"))


@query("SELECT seq_id, frame_idx, traj_id, kp_idx, x, y, kp_conf FROM fx_kp")
def unpack_points(spark: SparkSession, d: str) -> DataFrame:
    one = points.unpacked(fx.points(spark, d).select(*CORE, "flat"), "flat", "kp_idx")
    return one.select(*CORE, F.col("kp_idx").cast("long").alias("kp_idx"), "x", "y", F.col("conf").alias("kp_conf"))


@query("SELECT DISTINCT traj_id, printf('%x', 3203334144 + traj_id) AS label FROM fx_hyp")
def hex_labels(spark: SparkSession, d: str) -> DataFrame:
    return fx.hyp(spark, d).select("traj_id").distinct().select("traj_id", labels.hex_id(F.lit(0xBEEF0000) + F.col("traj_id")).alias("label"))


@query("SELECT seq_id, frame_idx, traj_id, cy*8 + cx AS cell FROM (SELECT *, unnest(range(least(7, greatest(0, CAST(floor(x1/128) AS BIGINT))), least(7, greatest(0, CAST(floor(x2/128) AS BIGINT)))+1)) AS cx FROM fx_hyp), range(8) r(cy) WHERE cy BETWEEN least(7, greatest(0, floor(y1/128))) AND least(7, greatest(0, floor(y2/128)))")
def box_cells(spark: SparkSession, d: str) -> DataFrame:
    return unit(fx.hyp(spark, d)).select(*CORE, F.explode(g.grid_cells(g.box())).alias("cell"))


# --- motion, trajectories and sweeps


@query(""", fx_sample AS (SELECT * FROM (VALUES (0.5,0.5,0.5),(0.35,0.5,0.125),(0.65,0.5,0.125),(0.5,0.35,0.125),(0.5,0.65,0.125)) v(xf, yf, w)),
fx_move AS (SELECT g.seq_id, g.frame_idx, g.traj_id, sum(w::DOUBLE*dx) AS mx, sum(w::DOUBLE*dy) AS my FROM fx_gt g, fx_sample, fx_motion m WHERE m.seq_id=g.seq_id AND m.frame_idx=g.frame_idx AND
 m.gx = greatest(0, least(7, floor((g.x1/1024*xf::DOUBLE+g.x2/1024*(1-xf::DOUBLE))*8+0.5))) AND m.gy = greatest(0, least(7, floor((g.y1/1024*yf::DOUBLE+g.y2/1024*(1-yf::DOUBLE))*8+0.5))) GROUP BY ALL)
SELECT seq_id, frame_idx, traj_id, round(greatest(0, least(1, x1/1024-mx)), 6) AS x1, round(greatest(0, least(1, y1/1024-my)), 6) AS y1, round(greatest(0, least(1, x2/1024-mx)), 6) AS x2, round(greatest(0, least(1, y2/1024-my)), 6) AS y2 FROM fx_gt JOIN fx_move USING (seq_id, frame_idx, traj_id)""")
def motion_lookup(spark: SparkSession, d: str) -> DataFrame:
    out = motion.shift_boxes(unit(fx.gt(spark, d)), fx.motion(spark, d), FRAME, ["traj_id"])
    return rounded(out.select(*CORE, *BOX))


def _kalman_sql() -> str:
    names = ("cx", "cy", "a", "h")
    q = {n: ("1e-4", "1e-10", "1e-2") if n == "a" else ("power(hb/20, 2)", "power(hb/160, 2)", "power(ha/20, 2)") for n in names}
    start = ", ".join(f"{n} AS {n}_p, 0.0::DOUBLE AS {n}_v, {'1e-4' if n == 'a' else 'power(h/10, 2)'}::DOUBLE AS {n}_00, 0.0::DOUBLE AS {n}_01, {'1e-10' if n == 'a' else 'power(h/16, 2)'}::DOUBLE AS {n}_11" for n in names)
    ahead = ", ".join(f"{n}_p + dt*{n}_v AS {n}_p, {n}_v, {n}_00 + 2*dt*{n}_01 + dt*dt*{n}_11 + {q[n][0]} AS {n}_00, {n}_01 + dt*{n}_11 AS {n}_01, {n}_11 + {q[n][1]} AS {n}_11" for n in names)
    after = ", ".join(f"{n}_p + {n}_00/({n}_00+{q[n][2]})*(z{n}-{n}_p), {n}_v + {n}_01/({n}_00+{q[n][2]})*(z{n}-{n}_p), {n}_00 - {n}_00*{n}_00/({n}_00+{q[n][2]}), {n}_01 - {n}_00*{n}_01/({n}_00+{q[n][2]}), {n}_11 - {n}_01*{n}_01/({n}_00+{q[n][2]})" for n in names)
    return f""", fx_z AS (SELECT seq_id, traj_id, frame_time, (x1+x2)/2048 AS cx, (y1+y2)/2048 AS cy, (x2-x1)/(y2-y1) AS a, (y2-y1)/1024 AS h, row_number() OVER (PARTITION BY seq_id, traj_id ORDER BY frame_time) AS n FROM fx_gt WHERE seq_id < 2 OR TRUE),
fx_walk AS (SELECT seq_id, traj_id, frame_time, n, {start} FROM fx_z WHERE n = 1 UNION ALL
  SELECT seq_id, traj_id, zt, zn, {after} FROM (SELECT *, abs(h_p) AS ha FROM (SELECT seq_id, traj_id, zt, zn, zcx, zcy, za, zh, hb, {ahead} FROM (
    SELECT w.*, z.frame_time AS zt, z.n AS zn, z.cx AS zcx, z.cy AS zcy, z.a AS za, z.h AS zh, (z.frame_time - w.frame_time)*7.5 AS dt, abs(w.h_p) AS hb FROM fx_walk w JOIN fx_z z ON z.seq_id=w.seq_id AND z.traj_id=w.traj_id AND z.n=w.n+1))))
SELECT seq_id, traj_id, frame_time, round(cx_p, 5) AS cx, round(cy_p, 5) AS cy, round(a_p, 5) AS a, round(h_p, 5) AS h FROM fx_walk"""


@query(_kalman_sql())
def kalman_smooth(spark: SparkSession, d: str) -> DataFrame:
    return rounded(motion.kalman_smooth(unit(fx.gt(spark, d)), ["seq_id", "traj_id"]), 5)


@query(", fx_state AS (SELECT *, CASE WHEN traj_id % 2 = 0 THEN 'Tracked' ELSE 'Lost' END AS state, x1 - CASE WHEN traj_id % 2 = 1 THEN 120 ELSE 0 END AS sx1, x2 - CASE WHEN traj_id % 2 = 1 THEN 120 ELSE 0 END AS sx2 FROM fx_gt) SELECT seq_id, frame_idx, traj_id FROM fx_state s WHERE state = 'Tracked' OR NOT EXISTS (SELECT 1 FROM fx_state o WHERE o.state='Tracked' AND o.seq_id=s.seq_id AND o.frame_idx=s.frame_idx AND least(o.sx2,s.sx2)-greatest(o.sx1,s.sx1) > 0 AND (least(o.sx2,s.sx2)-greatest(o.sx1,s.sx1))/(200-(least(o.sx2,s.sx2)-greatest(o.sx1,s.sx1))) >= 0.6)")
def suppress_duplicates(spark: SparkSession, d: str) -> DataFrame:
    odd = F.col("traj_id") % 2 == 1
    shift = F.when(odd, 120).otherwise(0)
    rows = fx.gt(spark, d).withColumns({"state": F.when(odd, "Lost").otherwise("Tracked"), "x1": F.col("x1") - shift, "x2": F.col("x2") - shift})
    return pairs.suppress_duplicates(rows, FRAME, 0.6).select(*CORE)


@query()
def associate_batch(spark: SparkSession, d: str) -> DataFrame:
    return associate.associate(fx.frames(spark, d), unit(fx.det(spark, d)), SEQ)


@query()
def sweep_scores(spark: SparkSession, d: str) -> DataFrame:
    candidates = {"default": {}, "strict": {"new_traj_thr": 0.6}, "loose": {"match_thr_low": 0.05, "traj_low_thr": 0.05}}
    return sweep.sweep(candidates, fx.frames(spark, d), unit(fx.det(spark, d)), unit(fx.gt(spark, d)), SEQ)


@query()
def sweep_best(spark: SparkSession, d: str) -> DataFrame:
    return sweep.best(sweep_scores(spark, d))


VECTORS = """--plain
WITH s AS (SELECT 'p' || k AS name, min(l_quantity) AS low, max(l_quantity) AS high, 0.5::DOUBLE AS step, median(l_quantity) AS value FROM (SELECT l_partkey % 5 AS k, l_quantity FROM lineitem) GROUP BY k),
m AS (SELECT name AS moved, sign FROM s, (VALUES (1), (-1)) x(sign))
SELECT moved || CASE WHEN sign > 0 THEN '+' ELSE '-' END AS candidate, name, round(value + CASE WHEN name = moved THEN sign * 4.0 * step ELSE 0 END, 3) AS value, round(value + CASE WHEN name = moved THEN sign * 4.0 * step ELSE 0 END, 3) BETWEEN low AND high AS in_bounds FROM s, m"""


@query(VECTORS)
def neighbor_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.concat(F.lit("p"), (F.col("l_partkey") % 5).cast("string")).alias("name"), "l_quantity")
    space = rows.groupBy("name").agg(F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.median("l_quantity").alias("value")).withColumn("step", F.lit(0.5))
    return sweep.neighbour_vectors(space.select("name", "value"), space.drop("value"), 4.0)


@query("""--plain
WITH g AS (SELECT 'p' || l_partkey % 5 AS name, sum(CAST(round(l_discount*100) AS BIGINT) - 5) AS gain FROM lineitem WHERE CAST(round(l_discount*100) AS BIGINT) > 5 GROUP BY ALL)
SELECT name, CAST(gain AS BIGINT) AS gain, round(gain/(sum(gain) OVER ()), 6) AS share FROM g""")
def improvement_shares(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    log_ = rows.select(F.concat(F.lit("p"), (F.col("l_partkey") % 5).cast("string")).alias("name"), (F.round(F.col("l_discount") * 100).cast("long") - 5).alias("delta"))
    return rounded(sweep.improvement_shares(log_))


@query("""--plain
SELECT CAST(l_suppkey % 10 AS VARCHAR) AS ds_key, l_returnflag AS test_key, arg_max(l_quantity, l_orderkey*1e9 + l_partkey*100 + l_linenumber) AS value FROM (SELECT DISTINCT ON (l_orderkey, l_partkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_partkey, l_linenumber, l_quantity, l_suppkey, l_returnflag) GROUP BY ALL""")
def latest_results(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    same = Window.partitionBy("l_orderkey", "l_partkey", "l_linenumber").orderBy("l_quantity", "l_suppkey", "l_returnflag")
    rows = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("n", F.row_number().over(same)).filter("n = 1")
    stamp = F.col("l_orderkey") * 1e9 + F.col("l_partkey") * 100 + F.col("l_linenumber")
    results_ = rows.select((F.col("l_suppkey") % 10).cast("string").alias("ds_key"), F.col("l_returnflag").alias("test_key"), F.lit("h").alias("config_hash"), F.lit("mota").alias("metric"), F.col("l_quantity").alias("value"), stamp.alias("computed_at"))
    return rollup.latest(results_).select("ds_key", "test_key", "value")


#: Rows of a micro-batch, about: a worker holds those of one sequence.
BATCH_ROWS = 5_000_000


def _replayed(spark: SparkSession, rows: DataFrame, name: str, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Quarters of rows by time, or smaller parts of large tables, each written as files of a folder and taken by the stream as
    one batch; what the stream wrote."""
    from ..operators.tables import drop, new_path

    source, out, checkpoint = new_path(spark, name), new_path(spark, name), new_path(spark, "checkpoint")
    rows = kept(rows, "rows")
    n = max(4, -(-rows.count() // BATCH_ROWS))
    cuts = rows.agg(F.percentile_approx("frame_time", [k / n for k in range(1, n)], 1000 * n)).first()[0]
    cuts = [-1.0, *sorted(set(cuts)), float("inf")]
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):  # one after the other, as a stream's files come
        rows.filter((F.col("frame_time") > low) & (F.col("frame_time") <= high)).write.mode("overwrite").parquet(f"{source}/part")
        stream = spark.readStream.schema(rows.schema).parquet(f"{source}/part")
        query_ = run(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query_.awaitTermination()
    drop(rows)
    return spark.read.parquet(out)


@query()
def associate_stream(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming import online

    rows = fx.frames(spark, d).select(*FRAME, "frame_time").join(unit(fx.det(spark, d)).drop("frame_time"), FRAME, "left")
    return _replayed(spark, rows, "stream", online.associate_stream)


@query()
def associate_keyed_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same with an entry for each trajectory as state."""
    from ..streaming import keyed

    rows = fx.frames(spark, d).select(*FRAME, "frame_time").join(unit(fx.det(spark, d)).drop("frame_time"), FRAME, "left")
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, keyed.PROVIDER)
    try:
        return _replayed(spark, rows, "stream", keyed.associate_keyed)
    finally:
        spark.conf.set(setting, before)


@query("SELECT seq_id, frame_idx, type, oid, hid, round(d, 6) AS d FROM fx_match")
def online_mot_stream(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming import online

    gated = pairs.iou_pairs(fx.gt(spark, d), fx.hyp(spark, d), FRAME).withColumn("frame_time", F.col("frame_idx") / fx.RATE)
    return rounded(_replayed(spark, gated, "stream", online.matches_stream).drop("late"))


@query("SELECT seq_id, frame_idx, type, oid, hid, round(d, 6) AS d FROM fx_log")
def online_mot_events(spark: SparkSession, d: str) -> DataFrame:
    """The whole log as a stream, a second behind the latest frame; a tick at the end closes the last ones."""
    from ..streaming import online

    columns = [*FRAME, "frame_time", "traj_id", "x1", "y1", "x2", "y2"]
    sides = [rows.select(*columns, F.lit(name).alias("side")) for rows, name in ((fx.gt(spark, d), "object"), (fx.hyp(spark, d), "prediction"))]
    end = fx.frames(spark, d).agg(F.max("frame_time").alias("end"))
    ticks = fx.frames(spark, d).select("seq_id").distinct().join(F.broadcast(end)).select("seq_id", (F.col("end") + 2).alias("frame_time"), F.lit("tick").alias("side"))
    rows = sides[0].unionByName(sides[1]).unionByName(ticks, allowMissingColumns=True)

    def run(stream: DataFrame) -> DataFrame:
        one = lambda name: stream.filter(F.col("side") == name)
        return online.events_stream(one("object"), one("prediction"), delay=1.0, ticks=one("tick"))

    return rounded(_replayed(spark, rows, "stream", run).drop("late"))


@query(WALK + "SELECT seq_id, CAST(frame_time * 32 AS BIGINT) AS frame_idx, frame_time FROM fx_walk WHERE frame_time IS NOT NULL")
def rate_limit_stream(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming import online

    return _replayed(spark, fx.frames(spark, d), "stream", lambda s: online.rate_limited(s, 0.199)).drop("late")


#: Parameters under which a detection goes on with the last box that it overlaps by 0.3, and trajectories are tracked at once.
LANES = {
    "kf_weight": 0.0, "fuse_scores": 0.0, "traj_initial_thr": 0.0, "traj_high_thr": 0.0, "traj_low_thr": 0.0, "new_traj_thr": 0.0,
    "immediate_confirm_thr": 0.0, "match_thr_initial": 0.3, "traj_buffer_seconds": 2.0, "delete_dup_iou": 2.0,
}
SURE = {k: 0.5 for k in ("traj_initial_thr", "traj_high_thr", "traj_low_thr", "new_traj_thr")}
#: Boxes of one object overlap by 0.35 or more at any time, those of different ones by less than 0.05, so that trajectories are
#: islands of detections: one ends after ten frames without any, or after three or more if two seconds have passed.
LANES_SQL = """, fx_try AS (SELECT * FROM (VALUES ('all', 0.0), ('sure', 0.5)) v(candidate, least)),
fx_lane AS (SELECT candidate, seq_id, frame_idx, frame_time, CASE WHEN traj_id >= 900 THEN 0 WHEN traj_id > 110 THEN traj_id - 110 ELSE traj_id - 100 END AS lane, conf, x1/1024 AS x1, y1/1024 AS y1, x2/1024 AS x2, y2/1024 AS y2
  FROM fx_hyp, fx_try WHERE conf > least AND (traj_id >= 900 OR (frame_idx*8 + seq_id + CASE WHEN traj_id > 110 THEN traj_id - 110 ELSE traj_id - 100 END) % 23 <> 0)),
fx_nth AS (SELECT seq_id, frame_idx, frame_time, row_number() OVER (PARTITION BY seq_id ORDER BY frame_time) AS nth FROM fx_frames),
fx_seen AS (SELECT l.*, nth FROM fx_lane l JOIN fx_nth USING (seq_id, frame_idx)),
fx_gap AS (SELECT *, nth - lag(nth) OVER w - 1 AS missed, lag(frame_time) OVER w AS before FROM fx_seen WINDOW w AS (PARTITION BY candidate, seq_id, lane ORDER BY nth)),
fx_start AS (SELECT g.*, CASE WHEN missed IS NULL OR (missed >= 3 AND (missed >= 10 OR p.frame_time - before >= 2)) THEN g.frame_idx END AS start FROM fx_gap g LEFT JOIN fx_nth p ON p.seq_id = g.seq_id AND p.nth = g.nth - 1),
fx_island AS (SELECT * EXCLUDE (start), last_value(start IGNORE NULLS) OVER (PARTITION BY candidate, seq_id, lane ORDER BY nth ROWS UNBOUNDED PRECEDING) AS start_idx FROM fx_start),
fx_traj AS MATERIALIZED (SELECT candidate, seq_id, frame_idx, lane, start_idx, conf, x1, y1, x2, y2 FROM fx_island UNION ALL
  SELECT i.candidate, i.seq_id, n.frame_idx, i.lane, i.start_idx, i.conf, i.x1, i.y1, i.x2, i.y2 FROM fx_island i JOIN fx_nth n ON n.seq_id = i.seq_id AND n.nth = i.nth + 1 ANTI JOIN fx_island o ON o.candidate = i.candidate AND o.seq_id = i.seq_id AND o.lane = i.lane AND o.nth = i.nth + 1)
"""
LANES_OUT = LANES_SQL.rstrip() + " SELECT seq_id, frame_idx, start_idx, round(conf, 6) AS conf, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM fx_traj WHERE candidate = 'all'"


def lanes(spark: SparkSession, d: str) -> DataFrame:
    """Detections without those that leave their object's place."""
    ln = F.when(F.col("traj_id") > 110, F.col("traj_id") - 110).otherwise(F.col("traj_id") - 100)
    return unit(fx.hyp(spark, d).filter((F.col("traj_id") >= 900) | ((F.col("frame_idx") * 8 + F.col("seq_id") + ln) % 23 != 0))).drop("traj_id")


def by_start(trajectories: DataFrame) -> DataFrame:
    """Trajectories named by the frame that they start with."""
    first = F.min("frame_idx").over(Window.partitionBy("seq_id", "traj_id"))
    return rounded(trajectories.select(*FRAME, first.alias("start_idx"), "conf", *BOX))


@query(LANES_OUT)
def associate_lanes(spark: SparkSession, d: str) -> DataFrame:
    return by_start(associate.associate(fx.frames(spark, d), lanes(spark, d), SEQ, LANES))


@query(LANES_OUT)
def associate_lanes_stream(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming import online

    rows = fx.frames(spark, d).select(*FRAME, "frame_time").join(lanes(spark, d).drop("frame_time"), FRAME, "left")
    return by_start(_replayed(spark, rows, "stream", lambda s: online.associate_stream(s, params=LANES)))


SWEPT = LANES_SQL.rstrip() + """,
fx_near AS (SELECT candidate, g.seq_id, g.frame_idx, g.traj_id AS oid, lane * 1000000000 + start_idx AS hid, least(g.x2/1024,h.x2)-greatest(g.x1/1024,h.x1) AS w, least(g.y2/1024,h.y2)-greatest(g.y1/1024,h.y1) AS hh, (g.x2-g.x1)*(g.y2-g.y1)/1048576 + (h.x2-h.x1)*(h.y2-h.y1) AS sizes
  FROM fx_gt g JOIN fx_traj h ON g.seq_id = h.seq_id AND g.frame_idx = h.frame_idx),
fx_met AS MATERIALIZED (SELECT candidate, seq_id, frame_idx, oid, hid FROM fx_near WHERE w > 0 AND hh > 0 AND 1 - w*hh/(sizes - w*hh) <= 0.45),
fx_told AS (SELECT *, coalesce(lag(hid) OVER (PARTITION BY candidate, seq_id, oid ORDER BY frame_idx) <> hid, FALSE) AS switch FROM fx_met),
fx_sure AS (SELECT candidate, seq_id, hid, count(*) FILTER (NOT switch) AS n FROM fx_told GROUP BY ALL),
fx_all AS (SELECT candidate, count(*) AS predictions FROM fx_traj GROUP BY ALL),
fx_sums AS (SELECT candidate, (SELECT count(*) FROM fx_gt) AS num_objects, (SELECT count(*) FROM fx_gt) - count(*) AS num_misses, any_value(predictions) - count(*) AS num_false_positives, count(*) FILTER (switch) AS num_switches FROM fx_told JOIN fx_all USING (candidate) GROUP BY candidate),
fx_false AS (SELECT candidate, count(*) AS fp_tracks FROM (SELECT DISTINCT candidate, seq_id, lane * 1000000000 + start_idx AS hid FROM fx_traj) t LEFT JOIN fx_sure s USING (candidate, seq_id, hid) WHERE coalesce(s.n, 0) = 0 GROUP BY candidate),
fx_seen_frames AS (SELECT candidate, count(*) AS num_frames FROM (SELECT candidate, seq_id, frame_idx FROM fx_traj UNION SELECT candidate, seq_id, frame_idx FROM fx_gt, fx_try) GROUP BY candidate),
fx_swept AS (SELECT *, 1 - (num_misses + num_false_positives + num_switches)/(num_objects + 1e-7) AS mota, num_false_positives/(num_frames + 1e-7) AS fp_per_frame FROM fx_sums JOIN fx_false USING (candidate) JOIN fx_seen_frames USING (candidate)),
fx_fit AS (SELECT *, mota - 0.0005*fp_tracks - 0.002*fp_per_frame AS fitness FROM fx_swept)
"""


@query(SWEPT + "SELECT candidate, num_objects, num_misses, num_false_positives, num_switches, fp_tracks, num_frames, round(mota, 6) AS mota, round(fp_per_frame, 6) AS fp_per_frame, round(fitness, 6) AS fitness FROM fx_fit")
def sweep_lanes(spark: SparkSession, d: str) -> DataFrame:
    """Two candidates, of which one takes sure detections alone."""
    return rounded(sweep.sweep({"all": LANES, "sure": LANES | SURE}, fx.frames(spark, d), lanes(spark, d), unit(fx.gt(spark, d)), SEQ))


@query(SWEPT + "SELECT candidate, round(fitness, 6) AS fitness FROM fx_fit ORDER BY fitness DESC LIMIT 1")
def sweep_lanes_best(spark: SparkSession, d: str) -> DataFrame:
    return sweep.best(sweep_lanes(spark, d))


AHEAD = LANES_SQL.rstrip() + """,
fx_alive AS (SELECT i.*, lead(nth) OVER (PARTITION BY candidate, seq_id, lane ORDER BY nth) AS following FROM fx_island i WHERE candidate = 'all'),
fx_ahead AS (SELECT a.seq_id, n.frame_idx, a.lane, a.start_idx, a.x1, a.y1, a.x2, a.y2 FROM fx_alive a JOIN fx_nth n ON n.seq_id = a.seq_id AND n.nth > a.nth AND n.nth <= coalesce(a.following, a.nth + 10) AND n.nth <= a.nth + 10
  LEFT JOIN fx_nth p ON p.seq_id = a.seq_id AND p.nth = n.nth - 1 WHERE n.nth <= a.nth + 3 OR p.frame_time - a.frame_time < 2)
"""


@query(AHEAD + "SELECT seq_id, frame_idx, lane, round(x1, 6) AS from_x1, round(y2, 6) AS from_y2, round(x1, 6) AS flow_x1, round(y2, 6) AS flow_y2 FROM fx_ahead")
def predicted_boxes(spark: SparkSession, d: str) -> DataFrame:
    """What association expects before each frame, lost trajectories too; without a field the flow moves nothing."""
    lane = F.when(F.col("from_y1") > 0.5, 0).otherwise(F.floor(F.col("from_x1") * fx.SIDE / 140 + 0.25) + 1).cast("int")
    found = associate.predict(fx.frames(spark, d), lanes(spark, d), SEQ, LANES)
    return rounded(found.select(*FRAME, lane.alias("lane"), "from_x1", "from_y2", "flow_x1", "flow_y2"))


@query(AHEAD.rstrip() + """,
fx_look AS (SELECT seq_id, frame_idx, x1, y1, x2, y2 FROM fx_ahead UNION ALL SELECT seq_id, frame_idx, x1/1024, y1/1024, x2/1024, y2/1024 FROM fx_roi WHERE frame_idx % 3 = 0),
fx_union AS (SELECT seq_id, frame_idx, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM fx_look GROUP BY ALL)
SELECT seq_id, frame_idx, round(greatest(0, x1 - greatest(0.05, x2-x1)*0.125), 6) AS x1, round(greatest(0, y1 - greatest(0.05, y2-y1)*0.125), 6) AS y1, round(least(1, x2 + greatest(0.05, x2-x1)*0.125), 6) AS x2, round(least(1, y2 + greatest(0.05, y2-y1)*0.125), 6) AS y2 FROM fx_union""")
def region_from_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Predictions joined with the motion of every third frame; the filter's boxes give way to the flow's, as SQL has no filter."""
    ahead = associate.predict(fx.frames(spark, d), lanes(spark, d), SEQ, LANES)
    ahead = ahead.withColumns({f"filter_{c}": F.col(f"flow_{c}") for c in BOX})
    motion = unit(fx.roi(spark, d).filter(F.col("frame_idx") % 3 == 0))
    return rounded(fr.regions_ahead(ahead, motion, FRAME, 0.25))
