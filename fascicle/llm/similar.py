"""Verified links between shingle sets, for near-duplicates beyond a SimHash's reach.

At a similarity of 0.8 two 64-bit fingerprints lie about ten bits apart, where no segment of
useful length stays equal. So candidates share a band of minimum hashes here (16 bands of 4: a
pair of similarity 0.8 is missed with a chance of 2 in 10,000), and each is verified on the
sets themselves: if one holds SKETCH shingles or more, the SKETCH smallest hashes of their union
(standard error below 0.009) decide only beyond MARGIN of the threshold; between, the whole sets do.

A bucket of at most ``pair_block`` sets is compared in pairs. In a larger one each set is first
compared with the bucket's hub, the set that shares buckets with most others, and with about
two others that a salt picks anew in every band: rows in proportion to the bucket. A large
bucket whose sets are then in one component needs no more. The sets of all others go through
an exact join on their whole shingle sets (``exact_links``), so no pair is lost to a bucket's size.

Defined results: no words, no links (a set without words is left to the fingerprints); null
ids have no links; repeated rows change nothing; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fascicle.llm.common import attach, broadcast_if_small, components, slices, small_batches, written

BANDS, ROWS = 16, 4
#: Smallest hashes of a set that are kept to compare it.
SKETCH = 2048
#: Four standard errors of a likeness on cut sketches.
MARGIN = 0.036
#: Sets of a salted part of a large bucket, on average.
SALTED = 3
#: Sets of a larger bucket are not compared in all pairs at once.
PAIR_BLOCK = 16
#: Sets of a shingle's postings that meet in one part of the exact join.
POSTINGS = 512
#: Parts of the hash range whose shingles are counted together, to order shingles from rare to frequent.
COUNTED = 1 << 18
_RANDOM = np.random.default_rng(20240229)
_FACTOR = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSET = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def bands_of(values: np.ndarray) -> list[int]:
    """The signed keys of a set's bands; none for an empty set."""
    import xxhash

    if not len(values):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 1024):
        least = np.minimum(least, (values[None, at : at + 1024] * _FACTOR[:, None] + _OFFSET[:, None]).min(axis=1))
    keys = [xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def likeness(a: bytes, b: bytes) -> float:
    """The Jaccard similarity of two sketches (sorted 32-bit hashes)."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    union = np.union1d(x, y)
    if len(x) == SKETCH or len(y) == SKETCH:
        union = union[:SKETCH]
    if not len(union):
        return 0.0
    last = union[-1]
    return len(np.intersect1d(x[x <= last], y[y <= last], assume_unique=True)) / len(union)


def shingle_sets(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, digest of the set, its size, bands, sketch) for every row."""
    import xxhash

    from fascicle.llm.simhash import shingle_hashes, simhash_of

    small_batches(docs.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64()), ("digest", pa.binary()), ("size", pa.int32()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def row(text: bytes) -> tuple:
        hashes = shingle_hashes(text, shingle)
        values = np.unique(hashes)
        sketch = np.unique((values >> np.uint64(32)).astype(np.uint32))[:SKETCH]
        return simhash_of(hashes), xxhash.xxh3_128_digest(values.tobytes()), len(values), bands_of(values), sketch.tobytes()

    def run(batches):
        for b in slices(batches):
            done = list(zip(*(row(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()))) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(done, list(schema)[1:]))], schema=schema)

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "id long, fp long, digest binary, size int, bands array<long>, sketch binary")


def whole_sets(docs: DataFrame, wanted: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, values array<long>, sorted as unsigned) of the wanted sets (node, digest), from their texts."""
    import xxhash

    from fascicle.llm.simhash import shingle_hashes

    wanted = broadcast_if_small(wanted.select("node", "digest"), 64, wanted.count())
    rows = docs.select(F.col(id_col).cast("long").alias("node"), text_col).join(wanted, "node").select("node", "digest", text_col)
    schema = pa.schema([("node", pa.int64()), ("values", pa.list_(pa.int64()))])

    def run(batches):
        for b in slices(batches, 64):
            nodes, sets = [], []
            for node, digest, text in zip(*(c.to_pylist() for c in (b.column(0), b.column(1), b.column(2).cast(pa.binary())))):
                values = np.unique(shingle_hashes(text or b"", shingle))
                if xxhash.xxh3_128_digest(values.tobytes()) == bytes(digest):  # an id's other texts are other sets
                    nodes.append(node)
                    sets.append(values.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, schema.field("values").type)], schema=schema)

    return rows.mapInArrow(run, "node long, values array<long>").dropDuplicates(["node"])


def bucketed(sets: DataFrame) -> DataFrame:
    """(t, key, node, size, n) of the sets in buckets of n > 1 sets, a written table."""
    keyed = written(sets.select("node", "size", F.posexplode("bands").alias("t", "key")), "bands")
    sizes = written(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "band-sizes")
    return written(attach(keyed, sizes, ["t", "key"], "n", keyed.count()), "band-blocks")


def candidates(blocks: DataFrame, similarity: float, pair_block: int = PAIR_BLOCK) -> DataFrame:
    """Distinct pairs (u, v) of bucketed sets, sizes within reach of the similarity: all pairs of
    small buckets, a few of large ones."""
    salt = F.when(F.col("n") <= pair_block, 0).otherwise(F.pmod(F.xxhash64("node", "t"), F.ceil(F.col("n") / SALTED)))
    parts = blocks.select("t", "key", salt.alias("salt"), F.col("node").alias("u"), F.col("size").alias("a"))
    other = parts.select("t", "key", "salt", F.col("u").alias("v"), F.col("a").alias("b"))
    pairs = parts.join(other, ["t", "key", "salt"]).where("u < v")
    large = blocks.where(F.col("n") > pair_block)
    typical = large.groupBy("node").agg(F.sum("n").alias("shared"))
    hub = F.max(F.struct("shared", -F.col("node"), F.col("node").alias("v"), F.col("size").alias("b"))).alias("hub")
    hubs = written(large.join(typical, "node").groupBy("t", "key").agg(hub, F.count("*").alias("m")).select("t", "key", "m", "hub.v", "hub.b"), "hubs")
    stars = attach(large, hubs, ["t", "key"], "m", large.count()).select(F.col("node").alias("u"), F.col("size").alias("a"), "v", "b").where("u <> v")
    both = pairs.select("u", "a", "v", "b").unionByName(stars)
    return both.where(F.least("a", "b") >= similarity * F.greatest("a", "b")).select("u", "v").distinct()


def unsettled(blocks: DataFrame, known: DataFrame, pair_block: int = PAIR_BLOCK) -> DataFrame:
    """(node, size, component) of the sets in large buckets of more than one of the known components (node, component)."""
    large = blocks.where(F.col("n") > pair_block).select("t", "key", "node", "size")
    named = written(large.join(known, "node", "left").withColumn("component", F.coalesce("component", "node")), "large-buckets")
    apart = named.groupBy("t", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m")).where("lo <> hi")
    return attach(named, written(apart.select("t", "key", "m"), "open-buckets"), ["t", "key"], "m", named.count()).select("node", "size", "component").distinct()


def _most(size: Column, overlap: Column) -> Column:
    """The last place that a set's first shared shingle can have if it shares so many."""
    return size - F.ceil(overlap - 1e-9)


def prefixes(rest: DataFrame, whole: DataFrame, similarity: float) -> DataFrame:
    """(node, size, component, place, w): each set's first shingles, those that a link must reach.

    Any order of shingles that is the same in all sets will do. They go from rare to frequent by
    the counts of COUNTED parts of the hash range, a table of fixed size, so that no set has to
    be joined with the counts of its own shingles: only prefixes are shuffled.
    """
    part = F.col("w").bitwiseAND(F.lit(COUNTED - 1).cast("long")).alias("part")
    counts = whole.select(F.explode("values").alias("w")).groupBy(part).agg(F.count("*").alias("n")).toArrow()  # at most COUNTED rows
    often = np.zeros(COUNTED, np.int64)
    often[counts["part"].to_numpy()] = counts["n"].to_numpy()
    first = (_most(F.col("size"), similarity * F.col("size")) + 1).cast("int").alias("first")
    rows = rest.join(whole, "node").select("node", "size", "component", first, "values")
    schema = pa.schema([("node", pa.int64()), ("size", pa.int32()), ("component", pa.int64()), ("place", pa.int32()), ("w", pa.int64())])

    def run(batches):
        for b in slices(batches, 64):
            firsts = []
            for n, values in zip(b.column(3).to_pylist(), b.column(4)):
                values = values.values.to_numpy()
                firsts.append(values[np.lexsort((values, often[values & (COUNTED - 1)]))[:n]])
            lengths = [len(x) for x in firsts]
            at = pa.array(np.repeat(np.arange(len(firsts)), lengths), pa.int64())
            place = pa.array(np.concatenate([np.zeros(0, np.int32), *(np.arange(n, dtype=np.int32) for n in lengths)]), pa.int32())
            w = pa.array(np.concatenate([np.zeros(0, np.int64), *firsts]), pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(3)), place, w], schema=schema)

    return rows.mapInArrow(run, "node long, size int, component long, place int, w long")


def prefix_pairs(rest: DataFrame, whole: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (u, v) of different components that can reach the similarity.

    Shingles are ordered from rare to frequent. Two sets of sizes a <= b share at least
    o = similarity / (1 + similarity) * (a + b) shingles, so the first that they share stands
    at most at place a - o of the one and b - o of the other: within the first (1 - similarity)
    of the larger set, and less of the smaller. A shingle's postings meet in parts of POSTINGS,
    without those pairs of which both are in the component that holds most of them.
    """
    places = written(prefixes(rest, whole, similarity), "prefixes")
    each = places.groupBy("w", "component").agg(F.count("*").alias("m"))
    posts = each.groupBy("w").agg(F.sum("m").alias("n"), F.max(F.struct("m", "component")).alias("top"), F.count("*").alias("c")).where("c > 1")
    posts = written(posts.select("w", "n", (F.col("n") - F.col("top.m")).alias("others"), F.col("top.component").alias("top")), "postings")
    rows = written(attach(places, posts, ["w"], "n", places.count()).withColumn("is_top", F.col("component") == F.col("top")), "posted")
    parts = lambda is_top: F.ceil(F.when(is_top, F.col("others")).otherwise(F.col("n")) / POSTINGS)
    least = 2 * similarity / (1 + similarity)
    small = rows.where(F.col("place") <= _most(F.col("size"), least * F.col("size"))).withColumn("meets", F.explode(F.when(F.col("is_top"), F.array(F.lit(False))).otherwise(F.array(F.lit(True), F.lit(False)))))
    small = small.select("w", F.col("meets").alias("is_top"), F.pmod(F.xxhash64("node"), parts(F.col("meets"))).alias("part"), F.col("node").alias("u"), F.col("size").alias("a"), F.col("component").alias("cu"), F.col("place").alias("i"))
    large = rows.select("w", "is_top", F.explode(F.sequence(F.lit(0).cast("long"), parts(F.col("is_top")) - 1)).alias("part"), F.col("node").alias("v"), F.col("size").alias("b"), F.col("component").alias("cv"), F.col("place").alias("j"))
    overlap = similarity / (1 + similarity) * (F.col("a") + F.col("b"))
    near = (F.col("i") <= _most(F.col("a"), overlap)) & (F.col("j") <= _most(F.col("b"), overlap))
    order = (F.col("a") < F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("u") < F.col("v")))
    return small.join(large, ["w", "is_top", "part"]).where((F.col("cu") != F.col("cv")) & order & near).select("u", "v").distinct()


def verified_whole(pairs: DataFrame, whole: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose whole shingle sets (node, values) reach the similarity."""
    partners = pairs.groupBy("v").agg(F.count("*").alias("n"))
    right = written(whole.select(F.col("node").alias("v"), F.col("values").alias("y")).join(partners, "v"), "right-sets")
    rows = attach(pairs, right, ["v"], "n", pairs.count()).select("u", "v", "y")
    rows = rows.join(whole.select(F.col("node").alias("u"), F.col("values").alias("x")), "u").select("u", "v", "x", "y")

    def run(batches):
        for b in slices(batches, 64):
            near = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(near, pa.bool_()))

    return rows.mapInArrow(run, "u long, v long")


def exact_links(alone: DataFrame, blocks: DataFrame, known: DataFrame, whole_of, similarity: float) -> DataFrame | None:
    """All links between sets of unsettled large buckets that lie in different known components; None if there are no such sets.

    ``whole_of`` makes the whole sets (node, values) of wanted ones (node, digest).
    """
    rest = written(unsettled(blocks, known), "unsettled")
    if rest.isEmpty():
        return None
    whole = written(whole_of(alone.select("node", "digest").join(rest.select("node"), "node")), "whole-sets")
    return verified_whole(written(prefix_pairs(rest, whole, similarity), "prefix-pairs"), whole, similarity)


def classes(alone: DataFrame, sets: DataFrame, similarity: float, whole_of, known: DataFrame) -> DataFrame:
    """(node, component) of the distinct sets (node, digest, size, bands) that have links, the known links (u, v) among them."""
    blocks = bucketed(alone)
    judged = written(sketch_links(candidates(blocks, similarity), alone, sets, similarity), "judged")
    found = judged.where("sure").select("u", "v").unionByName(known)
    doubtful = judged.where("NOT sure").select("u", "v")
    if not doubtful.isEmpty():
        nodes = doubtful.select(F.col("u").alias("node")).unionByName(doubtful.select(F.col("v").alias("node"))).distinct()
        whole = written(whole_of(written(alone.select("node", "digest").join(nodes, "node"), "doubtful")), "doubtful-sets")
        found = found.unionByName(verified_whole(doubtful, whole, similarity))
    first = written(components(found), "first-components")
    more = exact_links(alone, blocks, first, whole_of, similarity)
    if more is None:
        return first
    return components(first.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))


def sketch_links(pairs: DataFrame, alone: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v, sure) of the candidate pairs: sure ones reach the similarity, the others may do so on whole sets.

    ``sets`` holds the sketches; only those of candidates are moved. Hubs stand in v alone, so
    u has few partners and is joined by shuffle; v goes by attach.
    """
    small_batches(alone.sparkSession)
    pairs = written(pairs, "candidates")
    partners = written(pairs.select(F.col("v").alias("node")).unionByName(pairs.select(F.col("u").alias("node"))).groupBy("node").agg(F.count("*").alias("n")), "partners")
    wanted = written(alone.select("node", "digest").join(partners, "node"), "wanted")
    wanted = broadcast_if_small(wanted.withColumnRenamed("node", "id"), 64, wanted.count())
    sketches = written(sets.select("id", "digest", "sketch").join(wanted, ["id", "digest"]).dropDuplicates(["id", "digest"]), "sketches")
    right = sketches.select(F.col("id").alias("v"), "n", F.col("sketch").alias("y"))
    rows = attach(pairs, right, ["v"], "n", 2 * pairs.count()).select("u", "v", "y")
    rows = rows.join(sketches.select(F.col("id").alias("u"), F.col("sketch").alias("x")), "u").select("u", "v", "x", "y")

    def run(batches):
        for b in slices(batches):
            near, sure = [], []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                margin = MARGIN if max(len(x), len(y)) >= 4 * SKETCH else 0.0
                found = likeness(x, y)
                near.append(found >= similarity - margin)
                sure.append(found >= similarity + margin)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sure, pa.bool_())], ["u", "v", "sure"]).filter(pa.array(near, pa.bool_()))

    return rows.mapInArrow(run, "u long, v long, sure boolean")
