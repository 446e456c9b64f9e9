"""Document fingerprints that add up: a homomorphic multiset hash of paragraphs, in DataFrame functions alone.

A paragraph is hashed to a wide vector: its own hash and the hashes of its word pairs each give 128 bits, a bit 1 counts +1
and a bit 0 counts -1 in its lane. A text's vector is the sum of its paragraphs' vectors, each lane modulo 2**16. So the
order of paragraphs plays no part, a paragraph is put in by adding its vector and taken out by subtracting it, and texts
with the same paragraphs have the same vector. The cosine of two vectors estimates the share of common word pairs, with a
standard error of 1/sqrt(128), as long as no lane wraps: a text that repeats one word pair 32,768 times or more has a
fingerprint that tells equality, but no likeness.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANES, BITS = 128, 16
MODULUS = 1 << BITS
SEGMENTS, PER_BUCKET, MOST_BUCKETS = 1024, 2000, 1 << 20
#: Cuts that are looked through at a time.
STEP = 32


def elements(text: Column) -> Column:
    """Two 64-bit hashes, neither made from the other, of a text's paragraphs and of the word pairs in each (the last word stands
    alone)."""

    def both(*values: Column) -> Column:
        return F.struct(F.xxhash64(*values).alias("h0"), F.xxhash64(F.lit(7), *values).alias("h1"))

    def of(paragraph: Column) -> Column:
        words = F.split(paragraph, " ")
        pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: both(a, b))
        return F.array_append(pairs, both(paragraph, F.lit("paragraph")))

    return F.flatten(F.transform(F.split(text, "\n"), of))


def lane_sums(element: str) -> list[Column]:
    """Sums over elements: how many hashes have each of 128 bits set, two counters of 32 bits in a long."""
    both = F.lit((1 << 32) + 1)
    sums = [F.sum(F.shiftrightunsigned(f"{element}.h{k}", j).bitwiseAND(both)).alias(f"s{k}_{j}") for k in range(2) for j in range(32)]
    return [F.count("*").alias("n"), *sums]


def lanes() -> Column:
    """The vector from lane_sums: in each lane, bits set less bits not set, modulo 2**16, between -2**15 and 2**15."""
    counts = [c for k in range(2) for j in range(32) for c in (F.col(f"s{k}_{j}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"s{k}_{j}", 32))]
    return reduced(F.array(*(2 * c - F.col("n") for c in counts)))


def reduced(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.pmod(x + MODULUS // 2, F.lit(MODULUS)) - MODULUS // 2)


def insert(vector: Column, other: Column) -> Column:
    """The vector of both texts' paragraphs together."""
    return reduced(F.zip_with(vector, other, lambda a, b: a + b))


def remove(vector: Column, other: Column) -> Column:
    """The vector without the other text's paragraphs."""
    return reduced(F.zip_with(vector, other, lambda a, b: a - b))


def as_text(vector: Column) -> Column:
    """Four hex digits a lane."""
    return F.array_join(F.transform(vector, lambda x: F.lpad(F.lower(F.hex(F.pmod(x, F.lit(MODULUS)))), 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 for equal vectors, near 0 for texts without common word pairs."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0).cast("long"), lambda s, p: s + p)

    cosine = dot(a, b) / F.sqrt(dot(a, a).cast("double") * dot(b, b))
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)), F.lit(0.0)))


def vectors(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and the vector of each row's text. keys must tell rows apart; where rows are dealt out by a prefix of keys, no
    further shuffle is needed."""
    exploded = rows.select(*keys, F.explode(elements(F.col(text))).alias("element"))
    return exploded.groupBy(*keys).agg(*lane_sums("element")).select(*keys, lanes().alias("vector"))


def order_buckets(rows: DataFrame, key: str, tie: Column) -> tuple[Column, int]:
    """An expression that deals rows to buckets of about PER_BUCKET rows, ascending with the key (long, not null).

    The key's range is cut at quantiles into as many segments as there are buckets, SEGMENTS at most, each evenly into
    buckets, so that uneven ids do no harm. A key at which two or more quantiles lie (any with 2 / SEGMENTS of all rows, or
    with two buckets' rows where there are fewer segments) has buckets of its own, by ranges of `tie` (a long that is spread
    evenly).
    """
    n = rows.count()
    wanted = min(MOST_BUCKETS, max(1, n // PER_BUCKET))
    segments = min(SEGMENTS, wanted)
    found = rows.agg(F.percentile_approx(key, [k / segments for k in range(segments + 1)], 20 * SEGMENTS)).first()[0]
    times = Counter(found or [0])
    cuts = sorted(times)
    each = max(1, wanted // max(1, len(cuts) - 1))
    own = [0, *(wanted * (times[c] - 1) // segments for c in cuts)]  # buckets of the cut that a leaf begins with
    firsts = [k * each + sum(own[:k]) for k in range(len(cuts) + 1)]
    value, blocks = F.col(key), [cuts[k : k + STEP] for k in range(0, len(cuts), STEP)]
    numbers = lambda x: F.array(*map(F.lit, x)).cast("array<bigint>")
    not_above = lambda x: F.size(F.filter(x, lambda c: c <= value))
    block = F.greatest(F.lit(0), not_above(numbers([b[0] for b in blocks])) - 1)
    leaf = block * STEP + not_above(F.get(F.array(*map(numbers, blocks)), block))  # how many cuts are not above the key
    of_leaf = lambda x: F.get(numbers(x), leaf)
    low, high = of_leaf([cuts[0], *cuts]), of_leaf([*cuts, cuts[-1]])
    share = F.coalesce(F.try_divide(value.cast("double") - low.cast("double"), high.cast("double") - low.cast("double")), F.lit(0.0))
    rest = of_leaf(firsts) + of_leaf(own) + F.least(F.lit(each - 1), F.greatest(F.lit(0), (share * each).cast("int")))
    part = F.floor((tie.cast("double") / 2.0**64 + 0.5) * of_leaf(own)).cast("long")
    return F.when((of_leaf(own) > 0) & (value == low), of_leaf(firsts) + F.least(of_leaf(own) - 1, part)).otherwise(rest), n


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's fingerprint, and that of its edited text, whose last half is the start of the next document.

    Next is the row that follows by descending key (equal keys by text, of a key with a large share of all rows by ranges
    of the text's hash first; null keys last); after the last comes the first. A null text is empty; an empty text is one empty paragraph. Repeated rows follow one another. An empty table gives an
    empty one; extra columns play no part. Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.
    """
    rows = documents.select(F.col(key).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("k"))
    bucket, _ = order_buckets(rows, "k", F.xxhash64("text"))
    rows = rows.withColumn("bucket", bucket)
    # the first row of each bucket also stands at the end of the bucket before; there are MOST_BUCKETS of them at most
    down = Window.orderBy(F.col("bucket").desc())
    firsts = rows.groupBy("bucket").agg(F.max("k").alias("k"))
    firsts = firsts.select("k", "bucket", F.coalesce(F.lag("bucket").over(down), F.min("bucket").over(Window.partitionBy(F.lit(0)))).alias("before"))
    guests = rows.join(F.broadcast(firsts), ["bucket", "k"]).groupBy("before").agg(F.min("k").alias("k"), F.min("text").alias("text"))
    nobody = F.lit(None).cast(rows.schema["doc_id"].dataType)
    guests = guests.select(nobody.alias("doc_id"), "text", "k", F.col("before").alias("bucket"), F.lit(True).alias("guest"))
    every = rows.withColumn("guest", F.lit(False)).unionByName(guests)
    order = Window.partitionBy("bucket").orderBy("guest", F.col("k").desc(), "text")
    placed = every.withColumns({"row": F.row_number().over(order), "next": F.lead("text").over(order), "n_chars": F.char_length("text").cast("long")})
    half = (F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left(F.coalesce("next", F.lit("")), half))
    edited = F.when(half > 0, edited).otherwise(F.col("text"))
    told = placed.withColumn("edited", edited).withColumn("edited_sha256", F.sha2("edited", 256))
    keys = ["bucket", "row", "doc_id", "n_chars", "guest", "edited_sha256"]
    both = told.select(*keys, F.posexplode(F.array("text", "edited")).alias("which", "body"))
    each = vectors(both, [*keys, "which"], "body")
    ahead = Window.partitionBy("bucket").orderBy("row", "which")
    pairs = each.withColumns({"edited_vector": F.lead("vector", 1).over(ahead), "next_vector": F.lead("vector", 2).over(ahead)}).filter("which = 0 AND NOT guest")
    return pairs.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("vector")).alias("fingerprint"), as_text(F.col("edited_vector")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"), likeness(F.col("vector"), F.col("next_vector")).alias("near_next"),
    )
