"""Substring dedup by suffix automata of reference documents.

A word goes if a window of ``size`` consecutive words that covers it also starts in a document
with a smaller id. The reference is the corpus itself, which no broadcast can hold, so each
document meets only the references it needs, in shuffled shards:

1. Anchors. A window's anchor is the least of its hashes of ``size`` // 2 + 1 consecutive words;
   equal windows have equal anchors wherever they stand. Each row sends its distinct anchors,
   about one for every 13 words, under its id and a hash of its text.
2. References. An anchor's reference is the row of the smallest id that holds it. Anchors of one
   document only are done with: their windows occur nowhere else.
3. Matching statistics. Shards hold a reference's suffix automaton; the rows that share an
   anchor with it are streamed through it and lose the maximal spans of at least ``size`` words.
   A reference with many rows is copied to as many shards as keeps each small, and one of over
   REFERENCE words is cut into parts that overlap by a window less a word, so that an automaton
   is bounded whatever the text.
4. The rest. A window with a shared anchor that its reference doesn't hold may still stand in
   another earlier document. Such windows are compared by 128-bit hash, pre-aggregated to the
   smallest id that holds each.

Every repeated window is found by step 3 or 4, so the result is exact but for hash collisions.

Defined results: words are [^\\x20\\x09-\\x0D]+ unchanged; null and empty texts have none; rows
with a null id neither lose words nor are references; rows of one id don't count against each
other, and each loses what its own text shares with smaller ids; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fascicle.llm.common import attach, broadcast_if_small, slices, small_batches, written
from fascicle.llm.decontaminate import merged
from fascicle.llm.line_dedup import row_mark

SIZE = 50
#: Documents a shard streams through one copy of a reference, about.
SHARD_DOCS = 200
#: Words of a reference that one automaton holds.
REFERENCE = 1 << 15
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _rolling(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive numbers, by doubling."""
    done, step, out, at = {}, h, None, 0
    power, size, base = _BASE, 1, None
    while True:
        done[size] = (step, power)
        if 2 * size > width:
            break
        step, power, size = step[:-size] + power * step[size:], power * power, 2 * size
    for size in sorted(done, reverse=True):
        step, power = done[size]
        if at + size <= width:
            out = step if out is None else out[: len(h) - at - size + 1] + base * step[at : at + len(h) - at - size + 1]
            base = power if base is None else base * power
            at += size
    return out


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive numbers."""
    step, size = x, 1
    while 2 * size <= width:
        step, size = np.minimum(step[:-size], step[size:]), 2 * size
    return np.minimum(step[: len(x) - width + 1], step[width - size :][: len(x) - width + 1])


def anchors(words: list[bytes], size: int = SIZE) -> np.ndarray:
    """The anchor of each window of size words."""
    import xxhash

    if len(words) < size:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        gram = size // 2 + 1
        k = _rolling(h, gram)
        k = (k ^ (k >> np.uint64(32))) * _MIX
        k ^= k >> np.uint64(29)
    return _least(k, size - gram + 1).view(np.int64)


class Automaton:
    """The suffix automaton of a word sequence."""

    def __init__(self, words: list[bytes]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.long = [-1], [0]
        nxt, link, long = self.next, self.link, self.long
        last = 0
        for w in words:
            cur = len(nxt)
            nxt.append({})
            link.append(0)
            long.append(long[last] + 1)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                if long[q] == long[p] + 1:
                    link[cur] = q
                else:
                    copy = len(nxt)
                    nxt.append(dict(nxt[q]))
                    link.append(link[q])
                    long.append(long[p] + 1)
                    while p >= 0 and nxt[p].get(w) == q:
                        nxt[p][w] = copy
                        p = link[p]
                    link[q] = link[cur] = copy
            last = cur

    def statistics(self, words: list[bytes]) -> np.ndarray:
        """For each word, the length of the longest sequence ending there that the automaton holds."""
        nxt, link, long = self.next, self.link, self.long
        state = length = 0
        out = np.zeros(len(words), np.int64)
        for i, w in enumerate(words):
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                length = long[state]
                to = nxt[state].get(w)
            if to is None:
                state = length = 0
            else:
                state, length = to, length + 1
            out[i] = length
        return out


def _anchor_table(docs: DataFrame, size: int) -> DataFrame:
    """(doc, mark, anchor): the distinct anchors of each row."""

    def run(batches):
        for b in slices(batches):
            ids, marks, out = [], [], []
            for i, m, t in zip(*(b.column(k).to_pylist() for k in (0, 1)), b.column(2).cast(pa.binary()).to_pylist()):
                a = np.unique(anchors((t or b"").split(), size))
                ids.append(np.full(len(a), i, np.int64))
                marks.append(np.full(len(a), m, np.int64))
                out.append(a)
            none = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or none)) for x in (ids, marks, out)], names=["doc", "mark", "anchor"])

    return docs.where("doc IS NOT NULL").select("doc", "mark", "text").mapInArrow(run, "doc long, mark long, anchor long")


def _stream(pairs: DataFrame, size: int, reference: int) -> DataFrame:
    """Streams each shard's rows through its part of a reference's automaton.

    pairs: (ref, rmark, part, salt, doc, mark, text, anchors), with doc null for the reference
    itself, which is sorted first. Gives spans (doc, mark, lo, hi) and, with hashes h1, h2,
    windows that this part doesn't hold. A row of the reference's own id gives only the latter.
    """
    import xxhash

    def run(batches):
        key, automaton = None, None
        for b in slices(batches):
            rows = []
            for ref, rmark, part, salt, doc, mark, text, wanted in zip(*(b.column(i).to_pylist() for i in range(8))):
                words = text.encode().split()
                if doc is None:
                    if key != (ref, rmark, part, salt):
                        lo = part * (reference - size + 1)
                        key, automaton = (ref, rmark, part, salt), Automaton(words[lo : lo + reference])
                    continue
                held = automaton.statistics(words) >= size
                if doc != ref:
                    rows += [(doc, mark, lo, hi, None, None) for lo, hi in merged([(e - size + 1, e + 1) for e in np.flatnonzero(held).tolist()])]
                own = np.isin(anchors(words, size), np.array(wanted, np.int64)) & ~held[size - 1 :]
                for i in np.flatnonzero(own).tolist():
                    h = xxhash.xxh3_128_digest(b" ".join(words[i : i + size]))
                    rows.append((doc, mark, i, i + size, int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True)))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc", "mark", "lo", "hi", "h1", "h2"])

    return pairs.mapInArrow(run, "doc long, mark long, lo int, hi int, h1 long, h2 long")


def repeated_spans(docs: DataFrame, size: int = SIZE, reference: int = REFERENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, mark, spans array<struct<lo,hi>>): the words of each row that an earlier document holds; mark is row_mark()'s."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), row_mark(text_col).alias("mark"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    table = written(_anchor_table(docs, size), "anchors")
    least = table.groupBy("anchor").agg(F.min(F.struct("doc", "mark")).alias("r"), F.max("doc").alias("top"), F.count("*").alias("n"))
    shared = written(least.where("top > r.doc").select("anchor", F.col("r.doc").alias("ref"), F.col("r.mark").alias("rmark"), "n"), "shared-anchors")
    found = attach(table, shared, ["anchor"], "n", table.count()).where("doc > ref OR mark <> rmark")
    pairs = written(found.groupBy("doc", "mark", "ref", "rmark").agg(F.collect_set("anchor").alias("anchors")), "pairs")
    refs = written(pairs.groupBy("ref", "rmark").agg(F.ceil(F.count("*") / SHARD_DOCS).cast("int").alias("shards"), F.count("*").alias("n")), "references")
    ids = written(pairs.select("doc", "mark").unionByName(refs.select(F.col("ref").alias("doc"), F.col("rmark").alias("mark"))).distinct(), "involved")
    texts = written(docs.join(broadcast_if_small(ids, 24), ["doc", "mark"]).dropDuplicates(["doc", "mark"]), "involved-texts")
    n_words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    parts = F.greatest(F.lit(1), F.ceil((n_words - (size - 1)) / (reference - size + 1))).cast("int")
    bodies = refs.join(texts.select(F.col("doc").alias("ref"), F.col("mark").alias("rmark"), "text"), ["ref", "rmark"])
    bodies = written(bodies.withColumn("parts", parts), "reference-texts")
    dealt = attach(pairs, bodies.drop("text"), ["ref", "rmark"], "n", pairs.count()).withColumn("salt", F.pmod(F.xxhash64("doc", "mark"), F.col("shards")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    streamed = dealt.join(texts, ["doc", "mark"]).select("ref", "rmark", each, "salt", "doc", "mark", "text", "anchors")
    heads = bodies.select("ref", "rmark", "shards", "text", each).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    heads = heads.select("ref", "rmark", "part", "salt", F.lit(None).cast("long").alias("doc"), F.lit(None).cast("long").alias("mark"), "text", F.lit(None).cast("array<long>").alias("anchors"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["ref", "rmark", "part", "salt"]
    met = heads.unionByName(streamed).repartition(n, *key).sortWithinPartitions(*key, "doc")
    out = written(_stream(met, size, reference), "matches")
    rest = out.where("h1 IS NOT NULL")
    first = rest.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("top"), F.count("*").alias("n")).where("top > first").drop("top")
    later = attach(rest, written(first, "first-windows"), ["h1", "h2"], "n", rest.count()).where("doc > first").select("doc", "mark", "lo", "hi")
    spans = out.where("h1 IS NULL").select("doc", "mark", "lo", "hi").unionByName(later)
    return spans.groupBy("doc", "mark").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans"))


def remove_repeats(docs: DataFrame, size: int = SIZE, reference: int = REFERENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept string): kept words joined by one space, for every row."""
    spans = written(repeated_spans(docs, size, reference, id_col, text_col), "spans")
    weigh = spans.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    spans = broadcast_if_small(spans, 1, 48 * weigh[0] + 24 * weigh[1])
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("__text"), row_mark(text_col).alias("__mark"))
    rows = rows.join(spans, (F.col(id_col) == F.col("doc")) & (F.col("__mark") == F.col("mark")), "left").select(id_col, "__text", "spans")

    def run(batches):
        for b in slices(batches):
            n, gone, kept = [], [], []
            for t, s in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
                words = (t or b"").split()
                left, at, lost = [], 0, 0
                for lo, hi in merged([(x["lo"], x["hi"]) for x in s or ()]):
                    left += words[at:lo]
                    at, lost = hi, lost + hi - lo
                left += words[at:]
                n.append(len(words))
                gone.append(lost)
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[id_col, "n_words", "n_removed", "kept"])

    return rows.mapInArrow(run, f"`{id_col}` long, n_words long, n_removed long, kept string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
p AS (SELECT row, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
g AS (SELECT row, doc_id, i, md5_number(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT g.row, unnest(range(i, i + 50)) AS q FROM g JOIN f USING (h) WHERE g.doc_id > first),
x AS (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM d)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT row, count(*) AS n FROM r GROUP BY row) c USING (row)
LEFT JOIN (SELECT row, string_agg(word, ' ' ORDER BY q) AS kept FROM x ANTI JOIN r USING (row, q) GROUP BY row) k USING (row)
"""
