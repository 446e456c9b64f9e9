"""Annotation tables derived from `lineitem`: pixel boxes in pictures of 1024 x 1024 at 32 frames a second, as DataFrames and,
for the comparison, as SQL. All sizes and times are exact binary fractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIDE, RATE = 1024.0, 32.0

SQL = """WITH RECURSIVE fx_base AS (SELECT DISTINCT CAST(l_orderkey AS BIGINT) ok, CAST(l_linenumber AS BIGINT) ln FROM lineitem),
fx_gt AS (
  SELECT ok % 8 AS seq_id, ok // 8 AS frame_idx, CAST(ok // 8 AS DOUBLE) / 32.0 AS frame_time, ln AS traj_id, 0 AS class_id, CAST(1.0 AS DOUBLE) AS conf,
         CAST((ln-1)*140 + (ok*37+ln*11)%17 AS DOUBLE) AS x1, CAST(200 AS DOUBLE) AS y1, CAST((ln-1)*140 + (ok*37+ln*11)%17 + 100 AS DOUBLE) AS x2, CAST(600 AS DOUBLE) AS y2, ok, ln FROM fx_base),
fx_hyp AS (
  SELECT seq_id, frame_idx, frame_time, 100 + ln + CASE WHEN frame_idx >= 60 + ln*5 THEN 10 ELSE 0 END AS traj_id, 0 AS class_id,
         (30 + (ok*17+ln*3)%70) / CAST(128.0 AS DOUBLE) AS conf, x1 + dx AS x1, y1, x2 + dx AS x2, y2
  FROM (SELECT *, CASE WHEN (ok+ln)%23=0 THEN 60 ELSE ((ok*13+ln*5)%9-4)*4 END AS dx FROM fx_gt) WHERE (ok*31+ln*7)%11 <> 0
  UNION ALL
  SELECT DISTINCT ok%8, ok//8, CAST(ok//8 AS DOUBLE)/32.0, 900 + ok%3, 0, CAST(0.375 AS DOUBLE), 400.0, 700.0, 500.0, 900.0 FROM fx_base WHERE ok%13=0),
fx_frames AS (SELECT DISTINCT ok % 8 AS seq_id, ok // 8 AS frame_idx, CAST(ok // 8 AS DOUBLE) / 32.0 AS frame_time, (ok // 8) % 10 <> 7 AS tracked FROM fx_base),
fx_half AS (SELECT h.* FROM fx_hyp h JOIN fx_frames f USING (seq_id, frame_idx) WHERE f.tracked AND h.frame_idx % 2 = 0),
fx_det AS (SELECT seq_id, frame_idx, frame_time, class_id, conf, x1, y1, x2, y2, row_number() OVER (PARTITION BY seq_id, frame_idx ORDER BY conf DESC, x1, y1) AS det_id FROM fx_hyp),
fx_roi AS (
  SELECT seq_id, frame_idx, CAST(((frame_idx*8+seq_id)%5)*64 AS DOUBLE) AS x1, CAST(((frame_idx*8+seq_id)%3)*64 AS DOUBLE) AS y1,
         CAST(1024 - ((frame_idx*8+seq_id)%7)*32 AS DOUBLE) AS x2, CAST(1024 - ((frame_idx*8+seq_id)%4)*32 AS DOUBLE) AS y2 FROM fx_frames),
fx_motion AS (
  SELECT f.seq_id, f.frame_idx, 8 AS gw, 8 AS gh, gx, gy, ((gx*3 + gy*5 + f.frame_idx)%7 - 3)/CAST(256.0 AS DOUBLE) AS dx, ((gx*5 + gy*3 + f.frame_idx)%5 - 2)/CAST(256.0 AS DOUBLE) AS dy
  FROM fx_frames f, range(8) a(gx), range(8) b(gy)),
fx_kp AS (SELECT seq_id, frame_idx, traj_id, i AS kp_idx, x1 + i*6 AS x, y1 + i*24 AS y, ((ok + ln + i)%10)/CAST(16.0 AS DOUBLE) AS kp_conf FROM fx_gt, range(17) t(i)),
fx_pairs AS MATERIALIZED (
  SELECT * FROM (
    SELECT g.seq_id, g.frame_idx, g.traj_id AS oid, h.traj_id AS hid,
           1 - (least(g.x2,h.x2)-greatest(g.x1,h.x1))*(least(g.y2,h.y2)-greatest(g.y1,h.y1)) / ((g.x2-g.x1)*(g.y2-g.y1) + (h.x2-h.x1)*(h.y2-h.y1) - (least(g.x2,h.x2)-greatest(g.x1,h.x1))*(least(g.y2,h.y2)-greatest(g.y1,h.y1))) AS d
    FROM fx_gt g JOIN fx_hyp h ON g.seq_id=h.seq_id AND g.frame_idx=h.frame_idx AND least(g.x2,h.x2)>greatest(g.x1,h.x1) AND least(g.y2,h.y2)>greatest(g.y1,h.y1)) WHERE d <= 0.45),
fx_match AS MATERIALIZED (SELECT seq_id, frame_idx, CASE WHEN lag(hid) OVER (PARTITION BY seq_id, oid ORDER BY frame_idx) <> hid THEN 'SWITCH' ELSE 'MATCH' END AS type, oid, hid, d FROM fx_pairs),
fx_log AS MATERIALIZED (
  SELECT seq_id, frame_idx, type, oid, hid, d FROM fx_match
  UNION ALL SELECT seq_id, frame_idx, 'MISS', traj_id, NULL, NULL FROM fx_gt g ANTI JOIN fx_match m ON m.seq_id=g.seq_id AND m.frame_idx=g.frame_idx AND m.oid=g.traj_id
  UNION ALL SELECT seq_id, frame_idx, 'FP', NULL, traj_id, NULL FROM fx_hyp h ANTI JOIN fx_match m ON m.seq_id=h.seq_id AND m.frame_idx=h.frame_idx AND m.hid=h.traj_id),
fx_object AS (
  SELECT seq_id, oid, count(*) AS frames, count(*) FILTER (type <> 'MISS') AS tracked, count(*) FILTER (type = 'MATCH') AS matched FROM fx_log WHERE oid IS NOT NULL GROUP BY ALL),
fx_frag AS (
  SELECT seq_id, oid, count(*) FILTER (hit AND NOT coalesce(before, TRUE) AND coalesce(earlier, FALSE)) AS fragmentations FROM (
    SELECT seq_id, oid, type <> 'MISS' AS hit, lag(type <> 'MISS') OVER w AS before, max(type <> 'MISS') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier
    FROM fx_log WHERE oid IS NOT NULL WINDOW w AS (PARTITION BY seq_id, oid ORDER BY frame_idx)) GROUP BY ALL),
fx_ids AS (SELECT seq_id, CAST(sum(best) AS BIGINT) AS idtp FROM (SELECT seq_id, oid, max(n) AS best FROM (SELECT seq_id, oid, hid, count(*) AS n FROM fx_pairs GROUP BY ALL) GROUP BY ALL) GROUP BY ALL),
fx_base_measures AS (
  SELECT seq_id, count(DISTINCT frame_idx) AS num_frames, count(oid) AS num_objects, count(hid) AS num_predictions, count(*) FILTER (type='MATCH') AS num_matches, count(*) FILTER (type='SWITCH') AS num_switches,
         count(*) FILTER (type='FP') AS num_false_positives, count(*) FILTER (type='MISS') AS num_misses, avg(d) AS motp FROM fx_log GROUP BY seq_id),
fx_by_object AS (
  SELECT seq_id, count(*) AS num_unique_objects, count(*) FILTER (tracked/frames >= 0.8) AS mostly_tracked, count(*) FILTER (tracked/frames < 0.8 AND tracked/frames >= 0.2) AS partially_tracked,
         count(*) FILTER (tracked/frames < 0.2) AS mostly_lost, count(*) FILTER (matched=0) AS missed, CAST(sum(fragmentations) AS BIGINT) AS num_fragmentations FROM fx_object JOIN fx_frag USING (seq_id, oid) GROUP BY seq_id),
fx_fp AS (SELECT seq_id, count(*) AS fp_tracks FROM (SELECT seq_id, hid FROM fx_log WHERE hid IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (type='MATCH') = 0) GROUP BY seq_id),
fx_counts AS (
  SELECT b.*, o.* EXCLUDE (seq_id), coalesce(fp_tracks, 0) AS fp_tracks, mostly_lost - missed AS mostly_lost2, idtp, num_objects - idtp AS idfn, num_predictions - idtp AS idfp,
         (num_matches + num_switches) / num_objects AS recall, (num_matches + num_switches) / num_predictions AS precision, 1 - (num_misses + num_false_positives + num_switches) / num_objects AS mota
  FROM fx_base_measures b JOIN fx_by_object o USING (seq_id) LEFT JOIN fx_fp USING (seq_id) JOIN fx_ids USING (seq_id)),
fx_measures AS (
  SELECT *, 2*idtp/(2*idtp+idfp+idfn) AS idf1, idtp/num_predictions AS idp, idtp/num_objects AS idr, mostly_tracked/(num_unique_objects+1e-7) AS mostly_tracked_frac, partially_tracked/(num_unique_objects+1e-7) AS partially_tracked_frac,
         mostly_lost2/(num_unique_objects+1e-7) AS mostly_lost2_frac, missed/(num_unique_objects+1e-7) AS missed_frac, fp_tracks/(num_unique_objects+1e-7) AS fp_tracks_frac,
         num_false_positives/(num_frames+1e-7) AS fp_per_frame, num_misses/(num_objects+1e-7) AS fn_per_obj, num_switches/(num_unique_objects+1e-7) AS switch_per_obj, num_fragmentations/(num_unique_objects+1e-7) AS frag_per_obj,
         mota - 0.0005*fp_tracks - 0.002*num_false_positives/(num_frames+1e-7) AS fitness FROM fx_counts)
"""


def _ids() -> tuple[Column, Column]:
    return F.col("ok"), F.col("ln")


def base(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").cast("long").alias("ok"), F.col("l_linenumber").cast("long").alias("ln")).distinct()


def _frame() -> list[Column]:
    ok, _ = _ids()
    index = F.floor(ok / 8)
    return [(ok % 8).alias("seq_id"), index.alias("frame_idx"), (index / RATE).alias("frame_time")]


def gt(spark: SparkSession, d: str) -> DataFrame:
    ok, ln = _ids()
    left = ((ln - 1) * 140 + (ok * 37 + ln * 11) % 17).cast("double")
    return base(spark, d).select(*_frame(), ln.alias("traj_id"), F.lit(0).alias("class_id"), F.lit(1.0).alias("conf"), left.alias("x1"), F.lit(200.0).alias("y1"), (left + 100).alias("x2"), F.lit(600.0).alias("y2"), "ok", "ln")


def hyp(spark: SparkSession, d: str) -> DataFrame:
    ok, ln = _ids()
    dx = F.when((ok + ln) % 23 == 0, 60).otherwise(((ok * 13 + ln * 5) % 9 - 4) * 4)
    trajectory = 100 + ln + F.when(F.col("frame_idx") >= 60 + ln * 5, 10).otherwise(0)
    near = gt(spark, d).filter((ok * 31 + ln * 7) % 11 != 0).select("seq_id", "frame_idx", "frame_time", trajectory.alias("traj_id"), "class_id", ((30 + (ok * 17 + ln * 3) % 70) / 128.0).alias("conf"), (F.col("x1") + dx).alias("x1"), "y1", (F.col("x2") + dx).alias("x2"), "y2")
    false = base(spark, d).filter(ok % 13 == 0).select("ok").distinct().select(*_frame(), (900 + ok % 3).alias("traj_id"), F.lit(0).alias("class_id"), F.lit(0.375).alias("conf"), F.lit(400.0).alias("x1"), F.lit(700.0).alias("y1"), F.lit(500.0).alias("x2"), F.lit(900.0).alias("y2"))
    return near.unionByName(false)


def frames(spark: SparkSession, d: str) -> DataFrame:
    return base(spark, d).select(*_frame()).distinct().withColumn("tracked", F.col("frame_idx") % 10 != 7)


def half(spark: SparkSession, d: str) -> DataFrame:
    return hyp(spark, d).filter((F.col("frame_idx") % 10 != 7) & (F.col("frame_idx") % 2 == 0))


def half_frames(spark: SparkSession, d: str) -> DataFrame:
    """The frames of half(): every second one, some of them untracked."""
    return frames(spark, d).filter(F.col("frame_idx") % 2 == 0)


def det(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("seq_id", "frame_idx").orderBy(F.col("conf").desc(), "x1", "y1")
    return hyp(spark, d).withColumn("det_id", F.row_number().over(order).cast("long")).drop("traj_id")


def roi(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("frame_idx") * 8 + F.col("seq_id")
    values = {"x1": (n % 5) * 64, "y1": (n % 3) * 64, "x2": 1024 - (n % 7) * 32, "y2": 1024 - (n % 4) * 32}
    return frames(spark, d).select("seq_id", "frame_idx", *(v.cast("double").alias(k) for k, v in values.items()))


def motion(spark: SparkSession, d: str) -> DataFrame:
    cells = F.explode(F.sequence(F.lit(0), F.lit(7)))
    out = frames(spark, d).select("seq_id", "frame_idx", F.lit(8).alias("gw"), F.lit(8).alias("gh"), cells.alias("gx")).select("*", cells.alias("gy"))
    gx, gy, n = F.col("gx"), F.col("gy"), F.col("frame_idx")
    return out.withColumns({"dx": ((gx * 3 + gy * 5 + n) % 7 - 3) / 256.0, "dy": ((gx * 5 + gy * 3 + n) % 5 - 2) / 256.0})


def points(spark: SparkSession, d: str) -> DataFrame:
    """gt() with its 17 key points as an array, and as flat numbers."""
    ok, ln = _ids()
    i = F.sequence(F.lit(0), F.lit(16))
    value = lambda k: [(F.col("x1") + k * 6).alias("x"), (F.col("y1") + k * 24).alias("y"), (((ok + ln + k) % 10) / 16.0).alias("conf")]
    flat = F.array(*(v.cast("double") for k in range(17) for v in value(k)))
    return gt(spark, d).withColumns({"points": F.transform(i, lambda k: F.struct(*value(k))), "flat": flat})
