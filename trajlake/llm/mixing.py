"""Mixing sources to target weights, in DataFrame functions alone.

Each source's rows, in hashed order, are dealt to blocks of equal numbers of rows. Weights are whole parts of a period of
slots. Block k of a source with c parts of W has the release floor(k * W / c) and the deadline ceil((k + 1) * W / c), its
Pfair window; earliest deadline first among the released blocks gives every block a slot in its window, so that after any
number of slots each source is less than one block from its share. The schedule of one period is made once, by a fold in
SQL, and repeats. When a source has no blocks left its slots stay empty; the others go on at their mutual weights, and no
row is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.tables import kept

ROWS_PER_BUCKET, ROWS_PER_PART = 2048, 1 << 16
MISSING = "<null>"


def tempered(counts: DataFrame, exponent: float, period: int) -> DataFrame:
    """Whole parts of about `period` by source, in proportion to rows ** exponent, one at least."""
    power = F.pow("n", F.lit(exponent))
    return counts.withColumn("parts", F.greatest(F.lit(1), F.round(period * power / F.sum(power).over(Window.partitionBy(F.lit(0)))).cast("int")))


def schedule(parts: DataFrame) -> DataFrame:
    """source, parts, period and, for each of the source's blocks in a period (nth), its slot in the period.

    parts has a row for each source: there are as many slots as parts in all.
    """
    one = parts.agg(F.array_sort(F.collect_list(F.struct("source", "parts"))).alias("x")).select("x", F.col("x.parts").alias("c"), F.col("x.source").alias("names"), F.aggregate("x.parts", F.lit(0), lambda a, b: a + b).alias("period"))
    state = F.struct(F.transform("c", lambda _: F.lit(0)).alias("done"), F.array().cast("array<int>").alias("order"))

    def step(s: Column, t: Column) -> Column:
        def window(i: Column) -> Column:
            k, c = F.get(s["done"], i), F.get(F.col("c"), i)
            release, deadline = F.floor(k * F.col("period") / c), F.ceil((k + 1) * F.col("period") / c)
            return F.when((k < c) & (release <= t), F.struct(deadline.alias("deadline"), i.alias("i")))

        chosen = F.array_min(F.array_compact(F.transform(F.sequence(F.lit(0), F.size("c") - 1), window)))["i"]
        return F.struct(F.transform(s["done"], lambda k, i: F.when(i == chosen, k + 1).otherwise(k)).alias("done"), F.array_append(s["order"], chosen).alias("order"))

    order = F.aggregate(F.sequence(F.lit(0), F.col("period") - 1), state, step, lambda s: s["order"])
    slots = one.filter("size(c) > 0").select("names", "c", "period", F.posexplode(order).alias("slot_in_period", "i"))
    nth = F.row_number().over(Window.partitionBy("source").orderBy("slot_in_period")) - 1
    return slots.select(F.get("names", F.col("i")).alias("source"), F.get("c", F.col("i")).alias("parts"), "period", "slot_in_period").withColumn("nth", nth)


def mix(rows: DataFrame, weights: dict[str | None, int] | None = None, key: str = "doc_id", source: str = "source", block_rows: int = 64, exponent: float = 0.5, period: int = 1000, ties: list[str] | None = None) -> DataFrame:
    """rows with block (of its source), slot (of the block, in all) and place (in the block), all long.

    weights: whole parts by source, 1 at least (a ValueError otherwise, as no row may be lost); a source that isn't named gets
    one part. Without weights, parts follow rows ** exponent. The period, and so the number of sources, bounds the one row
    that the schedule is made in: it is meant for some thousands. A null source is a source like others. Rows of a source are ordered by a hash of the key and the columns `ties`, then by
    the key and two more hashes of the ties; rows that are equal in them follow one another, in one task, so that ties should tell rows apart where keys are
    null or repeated. The last block of a source may be short. An empty table gives an empty one; columns called block, slot or
    place are replaced, others go along whatever their names.
    """
    if weights and min(weights.values()) < 1:
        raise ValueError("every source's weight must be 1 or more")
    told = [key, *(ties or [])]
    digest = [F.xxhash64(F.lit(k), *ties).alias(f"h{k}") for k in range(2)] if ties else []  # in place of the ties, which can be whole texts
    hashed = rows.select(
        F.struct(*rows.drop("block", "slot", "place").columns).alias("row"), F.struct(F.col(key), *digest).alias("_key"),
        F.coalesce(F.col(source).cast("string"), F.lit(MISSING)).alias("_source"), F.shiftrightunsigned(F.xxhash64(*told), 1).alias("_order"),
    )
    counts = kept(hashed.groupBy("_source").agg(F.count("*").alias("n")).withColumnRenamed("_source", "source"), "counts")
    if weights is None:
        parts = tempered(counts, exponent, period)
    else:
        given = F.create_map(*(F.lit(x) for k, v in weights.items() for x in (MISSING if k is None else k, v))) if weights else F.create_map().cast("map<string,int>")
        parts = counts.withColumn("parts", F.greatest(F.lit(1), F.coalesce(F.try_element_at(given, F.col("source")), F.lit(1))))
    plan = kept(schedule(parts.select("source", "parts")), "schedule")  # as many rows as the weights have parts
    total = counts.agg(F.sum("n")).first()[0] or 0
    n_buckets = min(1 << 20, max(1, total // ROWS_PER_BUCKET))
    hashed = hashed.withColumn("_bucket", F.shiftrightunsigned(F.shiftrightunsigned("_order", 32) * n_buckets, 31))
    sizes = hashed.groupBy("_source", "_bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("_source").orderBy("_bucket")) - F.col("n")
    ahead = sizes.select("_source", "_bucket", before.alias("_before")).join(plan.filter("nth = 0").select(F.col("source").alias("_source"), "parts", "period"), "_source")
    rank = F.row_number().over(Window.partitionBy("_source", "_bucket").orderBy("_order", "_key")) - 1
    ranked = hashed.withColumn("_rank", rank).join(ahead, ["_source", "_bucket"])
    ordinal = F.col("_before") + F.col("_rank")
    block = F.floor(ordinal / block_rows)
    placed = ranked.withColumns({"block": block.cast("long"), "place": ordinal % block_rows}).withColumns({"_nth": (F.col("block") % F.col("parts")).cast("int"), "_turn": F.floor(F.col("block") / F.col("parts")).cast("long")})
    slots = plan.select(F.col("source").alias("_source"), F.col("nth").alias("_nth"), "slot_in_period")
    out = placed.join(slots, ["_source", "_nth"]).withColumn("slot", F.col("_turn") * F.col("period") + F.col("slot_in_period"))
    return out.select("row.*", "block", "slot", "place")


def in_order(mixed: DataFrame) -> DataFrame:
    """The rows of mix() in the order of their slots: partition by partition, and within each. With many rows there are more
    partitions, each with about ROWS_PER_PART of them."""
    last, total = mixed.agg(F.max("slot"), F.count("*")).first()
    last = last or 0
    parts = max(int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // ROWS_PER_PART)
    dealt = mixed.repartitionById(parts, F.floor(F.col("slot") * parts / (last + 1)).cast("int"))
    return dealt.sortWithinPartitions("slot", "place")
