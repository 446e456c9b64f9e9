"""MinHash near-duplicates: documents whose sets of word shingles have a similarity of 0.75 or more, and their components.

One hash of each shingle gives a whole signature of 300 bins (one-permutation hashing): its top bits choose a bin, the smallest value of
a bin is the bin's entry, and an empty bin takes the entry of the first filled bin in a random order of its own (optimal
densification). 60 bands of five bins make buckets. Equal sets are one class from the start, and of buckets with the same
classes one is enough. In a bucket of two or three classes every pair is a candidate; in a larger one only edges to one centre
(a star), the class that shares most buckets with others, which in a group of copies is the one nearest to all. What the
stars leave open, classes of one bucket in different components, is compared in blocks, every pair. All candidates are
compared by their full sets: no signature decides. One link of similarity 0.75 in eleven million has no common bucket, and of
0.8 one in twenty thousand million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..operators.tables import drop, kept
from ._scratch import map_batches
from ._skew import join_groups
from ._text import lower, mix, pieces, row_of, short_hash, windows, word_hashes, words

BANDS, ROWS = 60, 5
BINS = BANDS * ROWS
#: Most classes and shingles that a block of a bucket holds on average, and values compared at a time.
BLOCK, BLOCK_SHINGLES, COLUMNS = 256, 1 << 19, 8192
#: Members of buckets for each task that compares blocks; many members make more tasks.
MEMBERS_PER_PART = 1 << 16
#: Parts that the pairs of one centre are dealt into.
SALTS = 1024


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in ascending order, a second hash of each, and the texts' offsets in them."""
    data = lower(data)
    starts, ends, at = words(data, offsets)
    short = np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < k))
    found = []
    for seed, values in zip((1, 2), word_hashes(data, starts, ends, 11, 12), strict=True):
        begin, hashes = windows(values, at, k, seed)
        found.append(np.concatenate([hashes, short_hash(values, at[short], at[short + 1], seed)]))
    row = np.concatenate([row_of(at)[begin], short])
    order = np.lexsort((found[0], row))
    row, hashes, second = row[order], found[0][order], found[1][order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], second[new], np.searchsorted(row[new], np.arange(len(offsets)))


def _orders() -> np.ndarray:
    random = np.random.default_rng(99)
    return np.array([random.permutation(BINS) for _ in range(BINS)], np.int16)


ORDERS = _orders()


def signatures(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, BINS) entries; of a text without shingles, zeros."""
    n = len(at) - 1
    row = row_of(at)
    bins = ((hashes >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (bins[1:] != bins[:-1])  # ascending hashes: the first of a bin is its smallest
    out, filled = np.zeros((n, BINS), np.uint64), np.zeros((n, BINS), bool)
    out[row[first], bins[first]] = mix(hashes[first], 31)
    filled[row[first], bins[first]] = True
    text, hole = np.nonzero(~filled & (np.diff(at) > 0)[:, None])
    for attempt in range(BINS):
        if not len(text):
            break
        donor = ORDERS[hole, attempt]
        ready = filled[text, donor]
        out[text[ready], hole[ready]] = out[text[ready], donor[ready]]
        text, hole = text[~ready], hole[~ready]
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    entries = signature[:, : BANDS * ROWS].reshape(len(signature), BANDS, ROWS)
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signature), 1))
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + entries[:, :, r], r)
    return keys


def set_digest(hashes: np.ndarray, second: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of a set, whatever its order: sums of the two scrambled hashes of its shingles."""
    out = []
    for values, seed in ((hashes, 41), (second, 42)):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(values, seed))])
        out.append((sums[at[1:]] - sums[at[:-1]]).view(np.int64))
    return out[0], out[1]


def text_hash(text: str) -> Column:
    """Tells the rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def sketch(documents: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """doc_id, text_hash, n (size of the set), d1, d2 (its digest) and bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column("text")):
                hashes, second, at = shingle_sets(data, offsets, k)
                d1, d2 = set_digest(hashes, second, at)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * BANDS), pa.array(band_keys(signatures(hashes, at)).view(np.int64).ravel()))
                columns = [*(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "text_hash")), pa.array(np.diff(at)), pa.array(d1), pa.array(d2), bands]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n", "d1", "d2", "bands"])

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), text_hash(text).alias("text_hash"), F.col(text).alias("text"))
    return map_batches(rows, run, "doc_id long, text_hash long, n long, d1 long, d2 long, bands array<long>")


def marks(places: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2**bits with the numbers in `place` set."""
    place = F.col("place")
    segments = places.groupBy(F.shiftright(place, 15).alias("segment")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(32767))).alias("bits"))
    out = np.zeros((1 << bits - 15, 4096), np.uint8)
    for row in segments.toLocalIterator():  # 2**bits at most
        out[row.segment] = np.frombuffer(row.bits, np.uint8)
    return out.ravel()


def marked(bitmap: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def bits_for(n: int, each: int, most_bits: int) -> int:
    return min(most_bits, max(18, (each * n).bit_length()))


def place_of(doc_id: Column, text_hash: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(doc_id, text_hash), F.lit(1 << bits))


def full_sets(documents: DataFrame, wanted: DataFrame, key: str, text: str, k: int, most_bits: int = 28) -> DataFrame:
    """rep, n and the set (ascending 64-bit hashes) of the classes in `wanted` (rep, d1, d2, first_id, text_hash), made again
    from the member with that id and hash.

    Only rows that a bitmap of these (32 MB at most; a full one costs work, not links) lets pass are made into sets, and no
    text is shuffled.
    """
    bits = bits_for(wanted.count(), 16, most_bits)
    sent = documents.sparkSession.sparkContext.broadcast(marks(wanted.select(place_of(F.col("first_id"), F.col("text_hash"), bits).alias("place")), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(marked(sent.value, np.asarray(batch.column("place")))))
            for _, _, data, offsets in pieces(batch.column("text")):
                hashes, second, at = shingle_sets(data, offsets, k)
                d1, d2 = set_digest(hashes, second, at)
                sets = pa.array([hashes[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(d2), pa.array(np.diff(at)), sets], names=["d1", "d2", "n", "hashes"])

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), text_hash(text).alias("text_hash"), F.col(text).alias("text")).filter("doc_id IS NOT NULL")
    rows = rows.select(place_of(F.col("doc_id"), F.col("text_hash"), bits).alias("place"), "text")
    found = map_batches(rows, run, "d1 long, d2 long, n long, hashes binary").dropDuplicates(["d1", "d2"])
    return found.join(wanted.select("rep", "d1", "d2"), ["d1", "d2"]).select("rep", "n", "hashes")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
    return 100 * common >= percent * (len(a) + len(b) - common)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar. No a has more than a few pairs for each band; those of one b are dealt
    into SALTS parts."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)))
    left = salted.join(sets.select(F.col("rep").alias("a"), F.col("hashes").alias("set_a")), "a")
    right = salted.select("b", "salt").distinct().join(sets.select(F.col("rep").alias("b"), F.col("hashes").alias("set_b")), "b")
    both = left.join(right, ["b", "salt"]).select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("set_a", "set_b"))
            keep = pa.array([similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(a, b, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    return map_batches(both, run, "a long, b long")


def distinct_buckets(keys: DataFrame) -> DataFrame:
    """key, size, lo, hi and x0 of the buckets of (key, rep) with two members or more; of those with the same members one."""
    rep = F.col("rep")
    found = keys.groupBy("key").agg(F.count("*").alias("size"), F.min(rep).alias("lo"), F.max(rep).alias("hi"), F.bit_xor(rep).alias("x0"), F.bit_xor(F.xxhash64(rep)).alias("x1")).filter("lo < hi")
    return found.groupBy("size", "lo", "hi", "x0", "x1").agg(F.min("key").alias("key")).drop("x1")


def members_of(banded: DataFrame, large: DataFrame, most_bits: int = 28) -> DataFrame:
    """rep, key and size of all members of the buckets `large` (key, size) among the classes (rep, bands).

    Of the bands only those are rows that a bitmap of these keys lets pass (32 MB at most; a fuller one costs work, not members); the join
    to the keys decides. So what is joined grows with the members, not with all bands of all classes.
    """
    told = large.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    bits = bits_for(told[0], 64, most_bits)
    low = (1 << bits) - 1
    sent = banded.sparkSession.sparkContext.broadcast(marks(large.select(F.col("key").bitwiseAND(F.lit(low)).alias("place")), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = batch.column("bands")
            keys, parents = np.asarray(bands.flatten()), np.asarray(pc.list_parent_indices(bands))
            passed = np.flatnonzero(marked(sent.value, keys & low))
            yield pa.RecordBatch.from_arrays([batch.column("rep").take(pa.array(parents[passed])), pa.array(keys[passed])], names=["rep", "key"])

    rows = kept(map_batches(banded.select("rep", "bands"), run, "rep long, key long"), "passed")
    out = kept(join_groups(rows, large, ["key"], "size", told[1]), "members")
    drop(rows)
    return out


def close_sizes(percent: int) -> Column:
    """Sizes alone don't rule out a link."""
    return 100 * F.least("n", "m") >= percent * F.greatest("n", "m")


def small_pairs(buckets: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) in buckets of two or three members: the third is what is left of the sum of bits. None has more than
    two for each band."""
    lo, hi = F.col("lo"), F.col("hi")
    mid = F.col("x0").bitwiseXOR(lo).bitwiseXOR(hi)
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    pairs = F.when(F.col("size") == 2, F.array(pair(lo, hi))).otherwise(F.array(pair(lo, mid), pair(lo, hi), pair(mid, hi)))
    sized = buckets.filter("size <= 3").select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()
    for end, n in (("a", "n"), ("b", "m")):
        sized = sized.join(reps.select(F.col("rep").alias(end), F.col("n").alias(n)), end)
    return sized.filter(close_sizes(percent)).select("a", "b")


def star_pairs(members: DataFrame, total: int, percent: int) -> DataFrame:
    """Pairs (a, b) of classes (key, rep, size, n): in each bucket, every member with b, the one that shares most buckets with
    others."""
    degree = members.groupBy("rep").agg(F.sum("size").alias("degree"))
    best = members.join(degree, "rep").groupBy("key").agg(F.max(F.struct("degree", F.xxhash64("rep").alias("h"), "rep", "n")).alias("best"), F.count("*").alias("members"))
    joined = join_groups(members.select("key", F.col("rep").alias("a"), "n"), best.select("key", "members", F.col("best.rep").alias("b"), F.col("best.n").alias("m")), ["key"], "members", total)
    return joined.filter((F.col("a") != F.col("b")) & close_sizes(percent)).select("a", "b")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each two sets have in common: products of 0-1 matrices, over COLUMNS values at a time."""
    sets = left + right
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1  # values of one set alone count nowhere
    row, column = row[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(shared.sum()), COLUMNS):
        part = slice(*np.searchsorted(column, [lo, lo + COLUMNS]))
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[row[part], column[part] - lo] = 1
        out += held[: len(left)] @ held[len(left) :].T
    return out.astype(np.int64)


def joining(left: list[tuple], right: list[tuple] | None, percent: int) -> list[tuple[int, int]]:
    """Links between different components among all pairs (rep, component, set) of left and right, or of left alone: as
    many as join what is similar, none that closes a circle."""
    other = left if right is None else right
    sets = [[np.frombuffer(x[2], np.uint64) for x in side] for side in (left, other)]
    n, m = (np.array([len(x) for x in side]) for side in sets)
    common = common_counts(*sets)
    mine, theirs = (np.array([x[1] for x in side], np.int64) for side in (left, other))
    fits = (100 * common >= percent * (n[:, None] + m - common)) & (mine[:, None] != theirs)
    above, out = {}, []

    def root(x: int) -> int:
        while x in above:
            x = above[x]
        return x

    for i, j in np.argwhere(fits).tolist():
        a, b = root(left[i][1]), root(other[j][1])
        if a != b:
            above[a] = b
            out.append((left[i][0], other[j][0]))
    return out


def open_blocks(named: DataFrame, total: int) -> DataFrame:
    """key, i, j, own and rep: the members of buckets over several components (key, rep, component, n), dealt into blocks so
    that each two members of one bucket in different components meet in one group (key, i, j).

    The members of a bucket's largest component are compared with the others only, not among themselves.
    """
    parts = named.groupBy("key", "component").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    whole = parts.groupBy("key").agg(F.max(F.struct("size", "component", "weight")).alias("major"), F.sum("size").alias("size"), F.sum("weight").alias("weight")).filter("size > major.size")
    blocks = lambda size, weight: F.ceil(F.greatest(size / BLOCK, weight / BLOCK_SHINGLES))
    major = F.col("major.size"), F.col("major.weight")
    dealt = whole.select("key", "size", F.col("major.component").alias("main"), blocks(F.col("size") - major[0], F.col("weight") - major[1]).alias("minors"), blocks(*major).alias("majors"))
    rows = join_groups(named.select("key", "rep", "component"), kept(dealt, "dealt"), ["key"], "size", total)
    few, all_, h = F.col("minors"), F.col("minors") + F.col("majors"), F.xxhash64("rep")
    is_main = F.col("component") == F.col("main")
    own = F.when(is_main, few + F.pmod(h, F.col("majors"))).otherwise(F.pmod(h, few))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(is_main, few).otherwise(all_) - 1)))
    return rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "component")


def open_links(members: DataFrame, labels: DataFrame, sets: DataFrame, total: int, percent: int) -> DataFrame:
    """Links between members of one bucket that lie in different components; every such pair is compared by its full sets,
    and only what joins two components leaves a task."""
    named = members.select("key", "rep", "n").join(labels, F.col("rep") == labels.v, "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("component"))
    named = kept(named, "open")
    rows = open_blocks(named, total).join(sets.select("rep", "hashes"), "rep")
    parts = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // MEMBERS_PER_PART)
    dealt = rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(key: int, i: int, j: int, group: list[tuple]) -> pa.RecordBatch:
            left = [g[:3] for g in group if g[3] == i]
            right = None if i == j else [g[:3] for g in group if g[3] == j]
            a, b = np.array(joining(left, right, percent) if left and right != [] else [], np.int64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        now, group = None, []
        for batch in batches:
            names = [batch.column(c).to_pylist() for c in ("key", "i", "j", "rep", "component", "hashes", "own")]
            for key, i, j, *row in zip(*names, strict=True):
                if (key, i, j) != now:
                    if len(group) > 1:
                        yield compare(*now, group)
                    now, group = (key, i, j), []
                group.append(row)
        if len(group) > 1:
            yield compare(*now, group)

    return map_batches(dealt, run, "a long, b long").distinct()


def judged(documents: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and stays (the row's set is that of the component's first class) of every row.

    A class is named by a number of its own, given once and written with the class: ids can be shared by several sets.
    """
    rows = kept(sketch(documents, key, text, k), "sketch")
    total = rows.count()
    usable = rows.filter("n > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    banded = kept(classes.select("d1", "d2", F.col("least.doc_id").alias("first_id"), F.col("least.text_hash").alias("text_hash"), "size", "n", "bands").withColumn("rep", F.monotonically_increasing_id()), "banded")
    plain = kept(rows.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "d1", "d2"), "plain")
    drop(rows)
    reps = kept(banded.drop("bands"), "classes")
    buckets = kept(distinct_buckets(banded.select("rep", F.explode("bands").alias("key"))), "buckets")
    large = buckets.filter("size > 3").select("key", "size")
    found = members_of(banded, large)
    drop(banded)
    members = kept(found.join(reps.select("rep", "n"), "rep"), "sized")
    n_members = members.count()
    pairs = kept(small_pairs(buckets, reps, percent).unionByName(star_pairs(members, n_members, percent)).distinct(), "pairs")
    ends = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).unionByName(members.select("rep")).distinct()
    wanted = kept(reps.join(ends, "rep", "left_semi"), "wanted")
    sets = kept(full_sets(documents, wanted, key, text, k), "sets")
    links = kept(confirm(pairs, sets, percent), "links")
    labels = kept(components(links), "labels")
    more = kept(open_links(members, labels, sets, n_members, percent), "links")
    if not more.isEmpty():
        drop(labels)
        labels = kept(components(links.unionByName(more)), "labels")
    drop(sets, found, members, wanted, pairs, buckets, links, more)
    named = kept(reps.join(labels, F.col("rep") == F.col("v"), "left").select("d1", "d2", "first_id", "size", F.coalesce("component", "rep").alias("component")), "named")
    firsts = named.groupBy("component").agg(F.min(F.struct("first_id", "d1", "d2")).alias("head"), F.count("*").alias("members"))
    told = join_groups(named, firsts, ["component"], "members", reps.count())
    told = kept(told.select("d1", "d2", "size", F.col("head.first_id").alias("component_id"), ((F.col("d1") == F.col("head.d1")) & (F.col("d2") == F.col("head.d2"))).alias("head")), "told")
    drop(reps, labels, named)
    columns = ["doc_id", "text_hash", "n_shingles", "component_id", "stays"]
    joined = join_groups(plain.filter("n_shingles > 0 AND doc_id IS NOT NULL"), told, ["d1", "d2"], "size", total)
    joined = joined.withColumn("stays", F.col("head") & (F.col("doc_id") == F.col("component_id")))
    alone = plain.filter("n_shingles = 0 OR doc_id IS NULL").withColumns({"component_id": F.col("doc_id"), "stays": F.lit(True)})
    return joined.select(*columns).unionByName(alone.select(*columns))


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the component) and kept (doc_id = component_id), a row for each row.

    A-Z are lowered, words are runs without ASCII white space, a set holds the distinct shingles of k words, or the whole
    sequence where there are fewer. Documents without words are linked with nothing. A null doc_id takes part in nothing:
    its component is null and it is kept. Rows repeated in full are one class; rows that share a doc_id but not the set
    are judged each for itself. Extra columns play no part.
    """
    out = judged(documents, key, text, k, percent).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(documents: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """The rows of documents without near-duplicates: of each component the rows with the smallest key, and of several sets with
    that key those of one set. Rows with a null key, and rows without words, stay; rows repeated in full stay or go together."""
    gone = judged(documents, key, text, k, percent).filter("NOT stays").select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_gone_hash")).distinct()
    return documents.join(gone, (F.col(key).cast("long") == F.col("_gone")) & (text_hash(text) == F.col("_gone_hash")), "left_anti")
