"""Best-fit packing of token sequences, with large items matched in pairs first.

Only the number of pieces of each length matters for a packing, and there are at most
``capacity`` lengths. So one pass encodes every text and writes its pieces; their lengths are
counted; ``plan`` packs the counts on the driver, a table whose size follows the capacity and
not the corpus; and every piece finds its place by its number among the pieces of its length.

The plan, over counts:

1. Large items, of more than a third of the capacity, stand at most two in a bin. From the
   longest on, each is matched with the longest other large item that fits beside it.
2. The others, from the longest on, go to the bin of the smallest gap that holds them, as many
   as fit, and open a bin where no gap does.

Equal lengths move together, so a step handles any number of bins of one content, and the plan
has at most a few such groups for each length. Numbers within a length are dealt in the order
of tasks: each task counts its own pieces, and sums over the tasks before it are added.

Defined results: a null text is encoded as an empty one (the end token alone); the strings of
special tokens in a text are ordinary text; rows may repeat and each is packed; null ids stay;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fascicle.llm.bpe import Codec, read_ranks
from fascicle.llm.common import broadcast_if_small, kept, slices, small_batches, written

CAPACITY, END = 1024, 2
#: A text is encoded in blocks of about this many characters; what has no place to cut for LONGEST is encoded up a tree.
BLOCK, LONGEST = 1 << 15, 1 << 18


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of bins of one content: (number of bins, [(length, pieces of it in a bin), ...])."""
    left = {size: n for size, n in counts.items() if n}
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError("a length is not between 1 and the capacity")
    by_gap: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}

    def put(bins: int, content: tuple[tuple[int, int], ...]) -> None:
        if bins:
            by_gap.setdefault(capacity - sum(size * n for size, n in content), []).append((bins, content))

    large = sorted((size for size in left if 3 * size > capacity), reverse=True)
    for a in large:
        for b in large:
            if a + b > capacity or not left[a]:
                continue
            if a == b:
                put(left[a] // 2, ((a, 2),))
                left[a] %= 2
            elif left[b]:
                both = min(left[a], left[b])
                put(both, ((a, 1), (b, 1)))
                left[a], left[b] = left[a] - both, left[b] - both
        put(left[a], ((a, 1),))
        left[a] = 0
    for size in sorted((size for size in left if 3 * size <= capacity), reverse=True):
        n = left[size]
        while n:
            gap = min((g for g in by_gap if g >= size), default=0)
            if not gap:
                most = capacity // size
                put(n // most, ((size, most),))
                put(int(n % most > 0), ((size, n % most),))
                break
            bins, content = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap]
            most = gap // size
            full = min(bins, n // most)
            put(full, (*content, (size, most)))
            n -= full * most
            rest = int(full < bins and n > 0)  # one more bin takes what is left, fewer than fill it
            if rest:
                put(1, (*content, (size, n)))
                n = 0
            put(bins - full - rest, content)
    return [(bins, list(content)) for gap in sorted(by_gap) for bins, content in by_gap[gap]]


def places(groups: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first number, bin of the first, pieces in a bin, offset) by length, then number."""
    rows, used, first = [], {}, 0
    for bins, content in groups:
        at = 0
        for size, n in content:
            rows.append((size, used.get(size, 0), first, n, at))
            used[size] = used.get(size, 0) + bins * n
            at += size * n
        first += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def placed(table: np.ndarray, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each piece by its length and its number among those of the length."""
    key = lambda size, n: (size.astype(np.uint64) << np.uint64(48)) | n.astype(np.uint64)
    row = table[np.searchsorted(key(table[:, 0], table[:, 1]), key(length, number), "right") - 1]
    n = number - row[:, 1]
    return row[:, 2] + n // row[:, 3], row[:, 4] + n % row[:, 3] * length


class Encoder:
    """Token ids of whole texts, as the tokenizers library gives them for the same vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, block: int = BLOCK, longest: int = LONGEST):
        import tiktoken

        self.codec, self.block, self.longest = Codec(ranks, pattern), block, longest
        self._encode = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
        self._cut = re.compile("[a-z](?= [a-z])")

    def blocks(self, text: str) -> Iterator[str]:
        """Parts of a text, cut before single spaces between letters: a pre-token begins there whatever stands around."""
        at = 0
        while len(text) - at > self.block:
            found = self._cut.search(text, at + self.block)
            if not found:
                break
            yield text[at : found.end()]
            at = found.end()
        yield text[at:]

    def encode(self, text: str) -> np.ndarray:
        parts = [self._encode(b, disallowed_special=()) if len(b) <= self.longest else self.codec.encode(b) for b in self.blocks(text)]
        return np.concatenate(parts).astype(np.uint32, copy=False)


def cuts(n: int, capacity: int) -> list[int]:
    """Where the pieces of n tokens begin, and n: the first piece is the short one."""
    return [0, *range(n % capacity or capacity, n, capacity), n]


def pieces(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, capacity: int = CAPACITY, end: int = END, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, nth) of every text's pieces, and with ``ids`` their token ids.

    part is the task and nth the number of its earlier pieces of the length.
    """
    import public_tokenizers

    small_batches(docs.sparkSession)
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))  # a fixed vocabulary: about 1 MB
    names = ["id", "piece", "start", "length", "ids_crc32", "part", "nth"] + ["ids"] * ids

    def run(batches):
        from pyspark import TaskContext

        encoder = kept(f"packing {vocabulary} {pattern}", lambda: Encoder(ranks.value, pattern))
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for b in slices(batches, 64):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tokens = np.append(encoder.encode(text or ""), np.uint32(end))
                for i, (lo, hi) in enumerate(pairwise(cuts(len(tokens), capacity))):
                    rows.append((doc, i, lo, hi - lo, zlib.crc32(tokens[lo:hi].astype("<u4").tobytes()), part, seen[hi - lo], *([tokens[lo:hi]] * ids)))
                    seen[hi - lo] += 1
            columns = list(zip(*rows)) or [()] * len(names)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    schema = "id long, piece int, start long, length int, ids_crc32 long, part int, nth long" + ", ids array<int>" * ids
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, ids: bool = False, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every text's pieces, and with ``ids`` their token ids."""
    rows = written(pieces(docs, capacity=capacity, ids=ids, id_col=id_col, text_col=text_col, **how), "pieces")
    sizes = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    totals = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    table = docs.sparkSession.sparkContext.broadcast(places(plan(totals, capacity)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = written(sizes.select("length", "part", F.coalesce(before, F.lit(0)).alias("before")), "piece-numbers")
    numbered = rows.join(broadcast_if_small(starts, 24), ["length", "part"]).withColumn("number", F.col("before") + F.col("nth"))
    own = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
    numbered = numbered.select(*own, "number")

    def run(batches):
        for b in batches:
            length, number = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "number"))
            bins, offsets = placed(table.value, length, number) if len(b) else (length, length)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(bins), pa.array(offsets)], names=[*own, "sequence_id", "offset"])

    schema = numbered.drop("number").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return numbered.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def sequences(docs: DataFrame, capacity: int = CAPACITY, **how) -> DataFrame:
    """(sequence_id, ids array<int>): the packed sequences, each of at most capacity tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    rows = pack(docs, capacity, ids=True, **how).groupBy("sequence_id").agg(parts.alias("parts"))
    return rows.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
