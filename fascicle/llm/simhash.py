"""SimHash near-duplicates with a pigeonring candidate filter.

Fingerprints are 64 bits over word shingles. They are cut into m ring segments; two
fingerprints within ``max_bits`` bits must, from some segment on, have every chain of l
consecutive segments differ in at most floor(l * max_bits / m) bits (Qin and Xiao, "Pigeonring",
PVLDB 2018). With m = 5 and max_bits = 2 the first two segments of such a chain are equal, so
chains are joined on those 25 or 26 bits, then pruned by the longer chains, then checked whole.

Only distinct fingerprints are compared. A block of at most ``pair_block`` of them is compared
in pairs. In a larger block, fingerprints at most two bits apart are those that share a
midpoint one flip away from both, so every fingerprint is linked to the smallest one of each
of its midpoints: the same links' components with a number of rows in proportion to the block.

Defined results: null and empty texts have no words and fingerprint zero, linked like any
other; repeated rows share a class; null ids are ignored as class ids unless a class has no
other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fascicle.llm.common import attach, components, keep_ids, slices, small_batches, written

SEGMENTS, MAX_BITS = 5, 2


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of every word shingle of a UTF-8 text, repeats included."""
    import xxhash

    words = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, 42) for g in grams), np.uint64)


def fingerprint_of(text: bytes, shingle: int = 3) -> int:
    """The signed 64-bit SimHash of a UTF-8 text; zero if it has no words."""
    return simhash_of(shingle_hashes(text, shingle))


def simhash_of(hashes: np.ndarray) -> int:
    """The signed 64-bit SimHash of shingle hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory on long texts
        block = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) for every row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in slices(batches):
            texts = b.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint_of(t or b"", shingle) for t in texts], pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "id long, fp long")


def _bounds(segments: int) -> list[tuple[int, int]]:
    cuts = [64 * i // segments for i in range(segments + 1)]
    return list(zip(cuts, cuts[1:]))


def _mask(lo: int, hi: int) -> int:
    value = ((1 << hi) - 1) ^ ((1 << lo) - 1)
    return value - (1 << 64) if value >> 63 else value


def _ring(segments: int, start: int, length: int) -> int:
    """The bits of a chain of ring segments, as a signed mask."""
    value = 0
    for i in range(length):
        value |= _mask(*_bounds(segments)[(start + i) % segments])
    return value


def _chain(diff: Column, start: int, segments: int, bits: int) -> Column:
    """Whether all chains from a start keep to their budgets."""
    ok = F.lit(True)
    for length in range(1, segments + 1):
        ok = ok & (F.bit_count(diff.bitwiseAND(F.lit(_ring(segments, start, length)))) <= length * bits // segments)
    return ok


def links(distinct: DataFrame, total: int, pair_block: int = 64, segments: int = SEGMENTS, bits: int = MAX_BITS) -> DataFrame:
    """Links (u, v) between distinct fingerprints (node, fp), enough for the exact components."""
    if bits != 2:
        raise ValueError("the midpoint step is written for links of at most two bits")
    zero = [length * bits // segments for length in range(1, segments + 1)].count(0)  # equal segments a chain begins with
    masks = [_ring(segments, i, zero) for i in range(segments)]
    start = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])).alias("k")
    keyed = distinct.select("node", "fp", start).select("node", "fp", "k.t", "k.key")
    sizes = written(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "block-sizes")
    blocks = written(attach(keyed, sizes, ["t", "key"], "n", segments * total), "blocks")
    light = blocks.where(F.col("n") <= pair_block)
    a = light.select("t", "key", F.col("node").alias("u"), F.col("fp").alias("x"))
    b = light.select("t", "key", F.col("node").alias("v"), F.col("fp").alias("y"))
    diff = F.col("x").bitwiseXOR(F.col("y"))
    chains = F.lit(False)
    for i in range(segments):
        chains = chains | ((F.col("t") == i) & _chain(diff, i, segments, bits))
    pairs = a.join(b, ["t", "key"]).where("u < v").where(chains).where(F.bit_count(diff) <= bits).select("u", "v")
    free = [~m & 0xFFFFFFFFFFFFFFFF for m in masks]
    flips = [[1 << i if i < 63 else -(1 << 63) for i in range(64) if f >> i & 1] for f in free]
    flip = F.element_at(F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(x) for x in f]) for f in flips]), F.col("t") + 1)
    mids = blocks.where(F.col("n") > pair_block).select("t", "node", "fp", F.explode(flip).alias("bit"))
    mids = mids.select("t", "node", F.col("fp").bitwiseXOR(F.col("bit")).alias("mid"))
    mids = written(mids, "midpoints")
    least = written(mids.groupBy("t", "mid").agg(F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1"), "midpoint-least")
    stars = mids.join(least, ["t", "mid"]).where("node <> v").select(F.col("node").alias("u"), "v")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, pair_block: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long, component): component is the smallest id reachable over links of <= 2 bits."""
    prints = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("id").alias("node"), F.count("*").alias("n")), "classes")
    total, distinct = prints.count(), classes.count()
    found = components(links(classes.where("node IS NOT NULL").select("node", "fp"), distinct, pair_block))
    named = classes.join(found, "node", "left").select("fp", "n", F.coalesce("component", "node").alias("component"))
    return attach(prints, written(named, "named"), ["fp"], "n", total).select(F.col("id").alias(id_col), "fp", "component")


def keep_representatives(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near-duplicates: that of the smallest id.

    Documents are linked by fingerprints within two bits and by a similarity of shingle sets
    of at least ``similarity`` (see similar.py: two bits alone miss most of these). Rows that
    repeat a kept id stay with it; rows without an id stay, as none stands for them.
    """
    from fascicle.llm import similar

    sets = written(similar.shingle_sets(docs, shingle, id_col, text_col), "shingle-sets")
    classes = written(sets.groupBy("digest").agg(F.min("id").alias("node"), F.count("*").alias("n")), "set-classes")
    alone = sets.drop("sketch").join(classes.select("digest", F.col("node").alias("id")), ["digest", "id"]).dropDuplicates(["digest"])
    alone = written(alone.withColumnRenamed("id", "node"), "set-representatives")
    prints = written(alone.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")), "set-fingerprints")
    same = alone.select("fp", "node").join(prints.where("n > 1"), "fp").where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    near = links(prints.select(F.col("first").alias("node"), "fp"), prints.count())
    whole = lambda wanted: similar.whole_sets(docs, wanted, shingle, id_col, text_col)
    found = similar.classes(alone, sets, similarity, whole, same.unionByName(near))
    named = classes.join(found, "node", "left").select("digest", "n", F.coalesce("component", "node").alias("component"))
    rows = sets.select("id", "digest")
    lost = attach(rows, written(named, "set-components"), ["digest"], "n", rows.count()).where("id <> component")
    return keep_ids(docs, written(lost.select(F.col("id").alias(id_col)), "lost"), id_col, "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_duplicates(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
