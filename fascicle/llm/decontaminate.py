"""Benchmark decontamination by a prefix-filtered containment join.

A window is ``size`` consecutive words of a benchmark item (an item of fewer words, but not
none, is one window). It is a set of shingles of GRAM words (fewer, if it has fewer), ordered
from rare to frequent among the benchmark's own shingles. A window must be contained whole, so
its necessary prefix is its rarest shingle alone:

1. Windows. A sliding minimum over each item's shingles gives each window its prefix.
2. Scan. Documents are read once. A bitmap of a fixed size tells which places may hold a
   prefix; such a place goes on with the ``size`` - 1 words on either side. The bitmap lets
   through what shares a bit, and never loses a prefix.
3. Join. Places meet windows by prefix, frequent prefixes in salted parts. A window whose prefix
   stands at offset o can only start at p - o, not before the document (positional bound), and
   must end within it (length bound); what is left is compared word by word.

Nothing grows with the benchmark on the driver or in a broadcast, and no text is shuffled.

Defined results: null and empty texts have no words and no hits; null or empty items have no
windows; items of one id count once; items without an id hit too and count as one item, with no
part in the digest of ids; repeated documents are scored alike; null ids stay; an empty
benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fascicle.llm.common import broadcast_if_small, salted_join, slices, small_batches, written

#: Bytes of a word: digits, letters (A-Z lower-cased) and all of any character beyond ASCII.
WORD_BYTES = bytes((b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256))
#: Words of a shingle.
GRAM = 3
#: A shingle's key: XXH64 of its words, the second turned by so many bits, the third by twice as many, joined by xor.
TURN = 21
#: Item words of a part in which windows are made.
BLOCK_WORDS = 1_000_000
#: The bitmap has 2 ** SLOT_BITS bits, 8 MB.
SLOT_BITS = 26
_SLOTS, _BUCKET = (1 << SLOT_BITS) - 1, 32768
#: Places that a worker holds before it hands them on.
FLUSH = 4096


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def item_words(benchmark: DataFrame, block_words: int, item_col: str, text_col: str) -> DataFrame:
    """(row, item, words) of the items that have words, in parts of about block_words words."""

    def run(batches):
        for b in slices(batches):
            words = [[w.decode() for w in words_of(t)] for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.list_(pa.string()))], names=["row", "item", "words"])

    rows = benchmark.select(F.monotonically_increasing_id().alias("row"), F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string"))
    rows = written(rows.mapInArrow(run, "row long, item string, words array<string>").where(F.size("words") > 0), "benchmark-words")
    total = rows.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    return rows.repartition(-(-total // block_words), "row") if total > block_words else rows


def _key(i: Column, words: int) -> Column:
    """The key of the shingle at place i of ``words``; words beyond the end have no part in it."""
    out = F.lit(0).cast("long")
    for j in range(words):
        word = F.get("words", i + j)
        h = F.xxhash64(word)
        turned = F.shiftleft(h, TURN * j).bitwiseOR(F.shiftrightunsigned(h, 64 - TURN * j)) if j else h
        out = out.bitwiseXOR(F.when(word.isNull(), F.lit(0).cast("long")).otherwise(turned))
    return out


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """(item, window, n, g, key, off): each item's windows of n words, with the key, words and offset of their rarest shingle."""
    gram = min(GRAM, size)
    length = F.size("words")
    text = lambda i, n: F.array_join(F.slice("words", i + 1, n), " ")
    last = F.greatest(length - size, F.lit(0))
    shape = lambda i: F.struct(i.alias("i"), _key(i, gram).alias("key"), F.length(text(i, gram)).alias("chars"), F.when(i <= last, text(i, size)).alias("window"))
    grams = items.select("row", "item", length.alias("length"), F.explode(F.transform(F.sequence(F.lit(0), F.greatest(length - gram, F.lit(0))), shape)).alias("e"))
    grams = grams.select("row", "item", F.least("length", F.lit(size)).alias("n"), F.least("length", F.lit(gram)).alias("g"), "e.*")
    ranked = grams.join(grams.groupBy("key").agg(F.count("*").alias("times")), "key")
    near = Window.partitionBy("row").orderBy("i").rowsBetween(0, size - gram)
    rarest = F.min(F.struct("times", (-F.col("chars")).alias("short"), "key", F.col("i").alias("at"))).over(near)
    windows = ranked.withColumn("r", rarest).where("window IS NOT NULL")
    return windows.select("item", "window", "n", "g", "r.key", (F.col("r.at") - F.col("i")).alias("off"))


def bitmap(windows: DataFrame) -> tuple[np.ndarray, tuple[int, ...]]:
    """The windows' keys as bits, a fixed number of bytes however many windows, and the numbers of words of their shingles."""
    slot = windows.select("g", (F.col("key").bitwiseAND(F.lit(_SLOTS)) + 1).alias("slot"))
    parts = slot.groupBy(F.bitmap_bucket_number("slot").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"), F.collect_set("g").alias("g"))
    out, grams = np.zeros((_SLOTS + 1) // 8, np.uint8), set()
    for b, bits, g in parts.collect():  # at most 2 ** SLOT_BITS / 32768 rows of 4 KB
        at = (b - 1) * (_BUCKET // 8)
        out[at : at + len(bits)] |= np.frombuffer(bits, np.uint8)
        grams.update(g)
    return out, tuple(sorted(grams))


def places(words: list[bytes], grams: tuple[int, ...], keys: np.ndarray) -> list[tuple[int, int]]:
    """(place, signed key) of the shingles whose key's bit is set."""
    import xxhash

    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(42)), np.uint64, len(words))
    out: list[tuple[int, int]] = []
    for g in grams:
        n = len(words) - g + 1
        if n > 0:
            key = hashes[:n].copy()
            for j in range(1, g):
                h, turn = hashes[j : n + j], np.uint64(TURN * j)
                key ^= h << turn | h >> np.uint64(64) - turn
            slot = (key & np.uint64(_SLOTS)).astype(np.int64)
            at = np.flatnonzero(keys[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
            out += zip(at.tolist(), key[at].view(np.int64).tolist())
    return out


def text_mark(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def scanned(docs: DataFrame, windows: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """One row (row, id, mark, n_words) for each document, and one with (p, key, lo, near) for each place."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bitmap(windows))  # 8 MB
    names = ["row", "id", "mark", "n_words", "p", "key", "lo", "near"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.string())]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches):
        keys, grams = shared.value
        rows: list[tuple] = []
        for b in slices(batches):
            for row, i, mark, text in zip(*(b.column(c).to_pylist() for c in range(3)), b.column(3).cast(pa.binary()).to_pylist()):
                words = words_of(text)
                rows.append((row, i, mark, len(words), None, None, None, None))
                if words and grams:
                    for p, k in places(words, grams, keys):
                        lo = max(0, p - size + 1)
                        rows.append((row, i, mark, len(words), p, k, lo, [w.decode() for w in words[lo : p + size]]))
                        if len(rows) >= FLUSH:
                            yield batch(rows)
                            rows = []
            if rows:
                yield batch(rows)
                rows = []

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), text_mark(text_col).alias("mark"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "row long, id long, mark long, n_words long, p int, key long, lo int, near array<string>")


def verified(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """Distinct (row, lo, hi, window): the places at which a whole window stands."""
    counts = hits.groupBy("key").agg(F.count("*").alias("times"))
    met = salted_join(hits, windows.select("window", "n", "key", "off"), ["key"], counts, "times", hits.count(), ["row", "p"])
    start = F.col("p") - F.col("off")
    met = met.where((start >= F.lit(0)) & (start >= F.col("lo")) & (start + F.col("n") <= F.col("n_words")))
    met = met.where(F.array_join(F.slice("near", start - F.col("lo") + 1, F.col("n")), " ") == F.col("window"))
    return met.select("row", start.alias("lo"), (start + F.col("n")).alias("hi"), "window").distinct()


def _judged(docs: DataFrame, benchmark: DataFrame, size: int, block_words: int, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """(id, mark, n_words, spans, items) for every row; mark is a hash of its text."""
    small_batches(docs.sparkSession)
    held = written(item_windows(item_words(benchmark, block_words, item_col, item_text), size).distinct(), "item-windows")
    windows = held.drop("item").distinct()
    rows = written(scanned(docs, windows, size, id_col, text_col), "scanned")
    found = written(verified(rows.where("p IS NOT NULL").select("row", "n_words", "p", "key", "lo", "near"), windows), "window-hits")
    # Overlapping and touching spans of a row are one: a new one starts beyond all ends before it.
    order = Window.partitionBy("row").orderBy("lo", "hi")
    spans = found.select("row", "lo", "hi").distinct()
    spans = spans.withColumn("opens", (F.col("lo") > F.coalesce(F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
    spans = spans.withColumn("part", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("row", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    spans = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    hit = found.select("row", "window").distinct()
    items = salted_join(hit, held.select("window", "item"), ["window"], hit.groupBy("window").agg(F.count("*").alias("times")), "times", found.count(), ["row"])
    items = items.select("row", "item").distinct().groupBy("row").agg(F.array_sort(F.transform(F.collect_list(F.struct("item")), lambda s: s["item"])).alias("items"))
    out = rows.where("p IS NULL").select("row", "id", "mark", "n_words").join(spans, "row", "left").join(items, "row", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c)
    return out.select("id", "mark", "n_words", empty("spans"), empty("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, n_words, spans array<struct<lo,hi>> of words, items array<string>) for every row."""
    return _judged(docs, benchmark, size, block_words, id_col, text_col, item_col, item_text).drop("mark").withColumnRenamed("id", id_col)


def report(docs: DataFrame, benchmark: DataFrame, size: int = 10, **names) -> DataFrame:
    """The spans of contamination() as counts, and contaminated = any word hit."""
    found = contamination(docs, benchmark, size, **names)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"])
    ids = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    out = found.select(found.columns[0], "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a benchmark window.

    A row is known again by its id (null too) and a hash of its text, so rows of one id are
    judged each by its own text.
    """
    found = _judged(docs, benchmark, size, BLOCK_WORDS, id_col, text_col, "item_id", "text")
    lost = written(found.where(F.size("spans") > 0).select(F.col("id").alias("__id"), F.col("mark").alias("__mark")).distinct(), "contaminated")
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (text_mark(text_col) == F.col("__mark"))
    return docs.join(broadcast_if_small(lost, 64), same, "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ip AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM ip),
sizes AS (SELECT DISTINCT n FROM iw),
dp AS (SELECT doc_id, w, s.n, unnest(range(1, len(w) - s.n + 2)) AS p FROM d, sizes s WHERE len(w) >= s.n),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM dp),
hits AS (SELECT dw.doc_id, dw.p, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
