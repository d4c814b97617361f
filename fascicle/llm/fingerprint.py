"""Document fingerprints by content-defined chunking.

A gear hash over the last 16 bytes cuts a text's UTF-8 bytes; cut points are normalised: a
strict mask before ``normal`` bytes, a loose one up to ``most``, none before ``least``. A
fingerprint is the set of its chunks, each as 48 bits of XXH3 and 16 bits of length. The
likeness of a text to another is the share of its length in chunks that the other has too:
cut points depend on content alone, so text that moves keeps its chunks.

To edit a text by its successor, documents are dealt into ranges of descending id, sorted
within them, and streamed; the first document of the next range is sent along, so one
shuffle of the texts is all, and no task holds more than two documents at once.

Defined results: a null text is empty; an empty text has the empty fingerprint, alike (1) to
another empty one only; a null id comes after all others; rows of one id follow in order of
their texts' XXH64, so that many of them need not meet in one task; a table of one row is its own successor; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fascicle.llm.common import slices, small_batches
from fascicle.llm.language import _iterated

LEAST, NORMAL, MOST = 16, 48, 192
#: Top bits of the hash that are zero at a cut: before the normal size, and after it.
STRICT, LOOSE = 7, 4
WINDOW = 16
NO_ID = -(1 << 63)


def gear() -> np.ndarray:
    """A random number for each byte value, by rule."""
    return np.array([int.from_bytes(hashlib.sha256(b"gear %d" % b).digest()[:4], "big") for b in range(256)], np.uint32)


GEAR = gear()


def cuts(data: bytes) -> list[int]:
    """The ends of a byte string's chunks."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    width = 1
    while width < WINDOW:
        shifted = h[:-width] << np.uint32(width)
        h[width:] += shifted
        width *= 2
    loose = np.flatnonzero(h < np.uint32(1 << (32 - LOOSE))) + 1
    strict = loose[h[loose - 1] < np.uint32(1 << (32 - STRICT))].tolist()
    loose = loose.tolist()
    out, at = [], 0
    while at < n:
        end = min(n, at + MOST)
        i = bisect.bisect_left(strict, at + LEAST)
        if i < len(strict) and strict[i] <= at + NORMAL:
            end = min(end, strict[i])
        elif at + NORMAL < n:
            i = bisect.bisect_right(loose, at + NORMAL)
            if i < len(loose):
                end = min(end, loose[i])
        out.append(end)
        at = end
    return out


def chunks(data: bytes) -> np.ndarray:
    """A text's fingerprint: its distinct chunks, sorted, as 48 bits of digest and 16 of length."""
    import xxhash

    digest, found, at = xxhash.xxh3_64_intdigest, [], 0
    for end in cuts(data):
        found.append((digest(data[at:end]) & 0xFFFFFFFFFFFF) << 16 | (end - at))
        at = end
    return np.unique(np.array(found, np.uint64))


def weight(codes: np.ndarray) -> int:
    return int((codes & np.uint64(0xFFFF)).sum())


def likeness(codes: np.ndarray, other: np.ndarray) -> float:
    """The share of a fingerprint's length that another has too."""
    if not len(codes):
        return float(not len(other))
    return round(weight(np.intersect1d(codes, other, assume_unique=True)) / weight(codes), 6)


def as_text(codes: np.ndarray) -> str:
    return base64.b64encode(codes.astype(">u8").tobytes()).decode()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint array<long>) for every row."""

    def run(batches):
        for b in slices(batches):
            codes = [chunks(t or b"").view(np.int64) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.list_(pa.int64()))], names=[id_col, "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, f"`{id_col}` long, fingerprint array<long>")


def bounds(keys: DataFrame, ranges: int) -> list[tuple[int, int]]:
    """The bounds (-key, mark) of about as many ranges of descending keys: a key of many rows is cut by mark."""
    if ranges < 2:
        return []
    out = {(-int(q), -(1 << 63)) for q in keys.approxQuantile("key", [i / ranges for i in range(1, ranges)], 0.2 / ranges)}
    share = max(1, keys.count() // ranges)
    for k, n in keys.groupBy("key").count().where(F.col("count") > share).collect():  # fewer than ranges
        m = -(-n // share)
        out |= {(-k, (i << 64) // m - (1 << 63)) for i in range(m)}
    return sorted(out)


def with_successors(docs: DataFrame, edit, schema: str, ranges: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Streams every document with its successor in descending id (after the last: the first).

    ``edit(id, text, next_text, state)`` gives a row of the schema; state is a dict that
    lives as long as both are the next pair's and may carry work over from one to the other.
    """
    spark = docs.sparkSession
    small_batches(spark)
    key, mark = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    place = F.struct(key.alias("key"), mark.alias("mark"))
    edges = spark.sparkContext.broadcast(bounds(docs.select(key.alias("key")), ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def found(rows) -> list[int]:
        return [bisect.bisect_right(edges.value, (-k, m)) for k, m in zip(rows.field(0).to_pylist(), rows.field(1).to_pylist())]

    def ranged(batches):
        for rows in batches:
            yield pa.array(found(rows), pa.int32())

    first = F.min(F.struct((-F.col("at.key").cast("decimal(20,0)")).alias("k"), "at.mark"))
    heads = docs.select(place.alias("at")).select("at", _iterated(ranged, "int")(F.col("at")).alias("r")).groupBy("r").agg(first.alias("h")).collect()  # one row a range
    heads = {x["r"]: (-int(x["h"]["k"]), x["h"]["mark"]) for x in heads}
    order = sorted(heads)
    sent = spark.sparkContext.broadcast({heads[r]: order[i - 1] for i, r in enumerate(order)})  # a head ends the range before its own

    def deal(batches):
        for rows in batches:
            ends = [sent.value.get(x) for x in zip(rows.field(0).to_pylist(), rows.field(1).to_pylist())]
            out = [[{"r": r, "tail": False}] + ([] if x is None else [{"r": x, "tail": True}]) for r, x in zip(found(rows), ends)]
            yield pa.array(out, pa.list_(pa.struct([("r", pa.int32()), ("tail", pa.bool_())])))

    dealt = docs.select(F.col(id_col).cast("long").alias("__id"), place.alias("__at"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    dealt = dealt.select("*", F.explode(_iterated(deal, "array<struct<r:int,tail:boolean>>")(F.col("__at"))).alias("__to"))
    dealt = dealt.select("__id", "__at", "__text", "__to.r", "__to.tail").repartitionById(len(edges.value) + 1, F.col("r"))
    dealt = dealt.sortWithinPartitions("r", "tail", F.desc("__at.key"), "__at.mark", "__text")

    def run(batches):
        fields, rows, state = None, [], {}
        last = None  # the document that waits for its successor: (range, id, text)
        for b in slices(batches):
            for i, text, r, tail in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                if last and last[0] == r:
                    rows.append(edit(last[1], last[2], text, state))
                if tail:
                    last, state = None, {}
                else:
                    if not (last and last[0] == r):
                        state = {}
                    last = r, i, text
                if len(rows) >= 256:
                    yield pa.RecordBatch.from_pylist(rows, fields)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, fields)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def typed(batches):
        for b in run(batches):
            yield pa.RecordBatch.from_arrays([b.column(f.name).cast(f.type) for f in kinds], schema=kinds)

    return dealt.mapInArrow(typed, schema)


def _edited(i, text: str, following: str, state: dict) -> dict:
    n = len(text)
    m = n // 3
    new = (text[: n - m] + following[:m]).encode()
    own = state.pop("codes", None)
    own = chunks(text.encode()) if own is None else own
    changed, after = chunks(new), chunks(following.encode())
    state["codes"] = after
    return {
        "doc_id": i, "n_chars": n, "edited_sha256": hashlib.sha256(new).hexdigest(), "fingerprint": as_text(own), "edited_fingerprint": as_text(changed),
        "near_edited": likeness(own, changed), "near_next": likeness(own, after),
    }


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_successors(docs, _edited, schema)
