"""Phrase collocations by pivot partitioning, as in MG-FSM.

Every phrase belongs to its rarest word, its pivot. Texts are rewritten into fragments, one for
each place of a possible pivot: the words around it as far as a phrase of that pivot can reach.
Fragments are routed to their pivot and mined there, and only the pivot's own phrases come out,
each with its whole count (Miliaraki et al., "Mind the Gap", SIGMOD 2013, without gaps).

1. First pass: words are counted by language, and pairs of neighbouring words by a hash into
   PAIR_PARTS parts. Two tables of fixed size come of it, whatever the corpus: the counts of
   WORD_PARTS parts of the words' hash range, which order words by rarity, and one bit a pair
   part, set if the part was met ``least`` times: a pair whose bit isn't set is in no frequent
   phrase. Both are only bounds from above, so they prune and never drop.
2. Second pass: texts are cut where a pair isn't frequent. A fragment is a place's word with up
   to max_words - 1 neighbours on either side, as long as these aren't rarer (on the left also
   not the same word: a phrase is told at the leftmost place of its pivot). Fragments are
   counted within a chunk of text and sent to their pivot; the pivots of one part of the hash
   range travel in one row.
3. Mining: each pivot's fragments meet in one task and are counted phrase by phrase. A pivot of
   many occurrences is dealt into parts by its fragments; its phrases' counts are added up
   afterwards. Other phrases are done with and are dropped here if they are rare.
4. Scores are exact integers of up to 38 digits, from the counts of a candidate's parts: words
   of step 1, and pairs that are candidates themselves.

Defined results: null texts have no words, a null language is ``und``; rows may repeat and all
count; an empty table gives no rows; other columns are ignored. A phrase's words are joined by
one space, which no word holds.
"""

from __future__ import annotations

from collections import Counter
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fascicle.llm.common import attach, broadcast_if_small, slices, small_batches, written

SEPARATORS = b".,;:!?\n\x0b\x0c\r"
#: Words of a chunk that are counted together, and bytes of a text that become words at a time.
CHUNK, SLICE = 1 << 21, 1 << 20
WORD_PARTS, PAIR_PARTS = 1 << 20, 1 << 27
#: Ranges of pair parts that are added up together.
RANGES = 1 << 9
#: Occurrences of a pivot from which it is dealt into parts, about.
PIVOT_PART = 100_000
#: Rows that a chunk's pivots of one language travel in, at most.
GROUPS = 1 << 11
#: Phrases that a group of pivots may hold before they are passed on in parts.
HELD = 1 << 19
SHARE, TOP = 50, 2000
_BREAK = b"\xff"  # stands in no UTF-8 text
_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _table() -> bytes:
    out = bytearray(range(256))
    out[65:91] = out[97:123]
    out[9] = 32
    for b in SEPARATORS:
        out[b] = 0xFF
    return bytes(out)


_FOLD = _table()


def words_of(text: bytes):
    """Lists of a text's words in lower case, with a break after each piece."""
    text = text.translate(_FOLD)
    at = 0
    while at < len(text):
        to = text.find(b" ", at + SLICE)
        to = len(text) if to < 0 else to
        yield text[at:to].replace(_BREAK, b" \xff ").split()
        at = to
    yield [_BREAK]


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two words' hashes, in order."""
    h = (a * _ONE) ^ ((b + _TWO) * _TWO)
    h ^= h >> np.uint64(29)
    h *= _ONE
    return h ^ (h >> np.uint64(32))


class Chunk:
    """Words of one language as numbers; 0 is the break between pieces."""

    def __init__(self):
        self.number: dict[bytes, int] = {_BREAK: 0}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        fresh = count(len(self.number))
        number = self.number
        for words in words_of(text):
            for w in set(words).difference(number):
                number[w] = next(fresh)
            self.parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
            self.size += len(words)

    def close(self, lang: str) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Numbers in order, the words by number, and their hashes."""
        import xxhash

        words = list(self.number)
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        return np.concatenate(self.parts), words, np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def chunks(batches, size: int):
    """(lang, numbers, words, hashes) of Arrow batches (lang, text), about size words each."""
    held: dict[str, Chunk] = {}
    total = 0
    for b in slices(batches, 64):
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
            if text:
                c = held.setdefault(lang, Chunk())
                total -= c.size
                c.add(text)
                total += c.size
        if total >= size:
            for lang, c in held.items():
                yield lang, *c.close(lang)
            held, total = {}, 0
    for lang, c in held.items():
        yield lang, *c.close(lang)


def _pairs(numbers: np.ndarray) -> np.ndarray:
    """Where a pair of words begins."""
    return np.flatnonzero((numbers[:-1] != 0) & (numbers[1:] != 0))


# First pass


def counted(texts: DataFrame, least: int, size: int, pair_parts: int) -> tuple[DataFrame, DataFrame]:
    """(lang, word, f), and the bits (at, bits long) of the pair parts met least times: 64 parts a row."""
    width = pair_parts // RANGES

    def run(batches):
        for lang, numbers, words, hashes in chunks(batches, size):
            n = np.bincount(numbers, minlength=len(words))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(words) - 1), pa.string()), pa.array(words[1:], pa.binary()).cast(pa.string()), pa.array(n[1:]), pa.nulls(len(words) - 1, pa.int32()), pa.nulls(len(words) - 1, pa.binary())], names=names)
            at = _pairs(numbers)
            with np.errstate(over="ignore"):
                part = (mixed(hashes[numbers[at]], hashes[numbers[at + 1]]) % np.uint64(pair_parts)).astype(np.int64)
            part, n = np.unique(part, return_counts=True)
            cuts = np.searchsorted(part, np.arange(RANGES + 1) * width)
            n = np.minimum(n, min(least, 255)).astype(np.uint8)  # more than least tells nothing more
            offset = (part % width).astype(np.uint32)
            blobs = [offset[lo:hi].tobytes() + n[lo:hi].tobytes() for lo, hi in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.nulls(RANGES, pa.string()), pa.nulls(RANGES, pa.string()), pa.nulls(RANGES, pa.int64()), pa.array(range(RANGES), pa.int32()), pa.array(blobs, pa.binary())], names=names)

    names = ["lang", "word", "n", "range", "counts"]
    both = written(texts.mapInArrow(run, "lang string, word string, n long, range int, counts binary"), "words-and-pairs")
    words = written(both.where("word IS NOT NULL").groupBy("lang", "word").agg(F.sum("n").alias("f")), "word-counts")

    def add(batches):
        now, sums = None, None

        def done():
            bits = np.packbits(sums >= least, bitorder="little").view(np.uint64).view(np.int64)
            at = np.flatnonzero(bits)
            return pa.RecordBatch.from_arrays([pa.array(at + now * (width // 64)), pa.array(bits[at])], names=["at", "bits"])

        for b in slices(batches, 16):
            for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != now:
                    if now is not None:
                        yield done()
                    now, sums = k, np.zeros(width, np.uint32)
                n = len(blob) // 5
                np.add.at(sums, np.frombuffer(blob, np.uint32, n), np.frombuffer(blob, np.uint8, n, 4 * n))
        if now is not None:
            yield done()

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.where("range IS NOT NULL").select("range", "counts").repartition(min(parts, RANGES), "range").sortWithinPartitions("range")
    return words, written(dealt.mapInArrow(add, "at long, bits long"), "pair-bits")


def rarity(words: DataFrame, parts: int) -> np.ndarray:
    """How often the words of each part of the hash range stand in the corpus: parts numbers."""
    import xxhash

    def run(batches):
        for b in batches:
            seeds = {lang: xxhash.xxh3_64_intdigest(lang.encode()) for lang in b.column(0).unique().to_pylist()}
            h = np.fromiter((xxhash.xxh3_64_intdigest(w, seeds[lang]) for lang, w in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist())), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([pa.array((h % np.uint64(parts)).astype(np.int64)), b.column(2)], names=["part", "n"])

    found = words.select("lang", "word", "f").mapInArrow(run, "part long, n long").groupBy("part").agg(F.sum("n").alias("n"))
    table = found.toArrow()  # at most parts rows
    out = np.zeros(parts, np.int64)
    out[table["part"].to_numpy()] = table["n"].to_numpy()
    return out


# Second pass


def frequent(bits: np.ndarray, part: np.ndarray) -> np.ndarray:
    return (bits[part >> 6] >> (part & 63).astype(np.uint64)) & np.uint64(1) == 1


def fragments_of(numbers: np.ndarray, linked: np.ndarray, order: np.ndarray, reach: int) -> np.ndarray:
    """Rows of 2 * reach + 1 numbers, 0 where the fragment has ended: each place's fragment with its word in the middle.

    linked: whether a place and the next are a frequent pair; order: a word's place from rare to
    frequent. Only fragments of two words or more.
    """
    n = len(numbers)
    places = np.flatnonzero(np.concatenate([linked, [False]]) | np.concatenate([[False], linked]))
    own = order[numbers[places]]
    rows = np.zeros((len(places), 2 * reach + 1), np.int32)
    rows[:, reach] = numbers[places]
    left = right = np.ones(len(places), bool)
    for d in range(1, reach + 1):
        at = places - d
        left = left & (at >= 0) & linked[np.maximum(at, 0)]
        left = left & (order[numbers[np.maximum(at, 0)]] > own)
        rows[left, reach - d] = numbers[at[left]]
        at = places + d
        right = right & (at < n) & linked[np.minimum(at - 1, n - 2)]
        right = right & (order[numbers[np.minimum(at, n - 1)]] >= own)
        rows[right, reach + d] = numbers[at[right]]
    return rows[(rows > 0).sum(1) > 1]


def routed(texts: DataFrame, weights: np.ndarray, bits: np.ndarray, size: int, max_words: int, pivot_part: int) -> DataFrame:
    """(lang, group, fragments binary): for each pivot of the group a line of a tab, the pivot and its number of parts, then lines of a number and a fragment's words."""
    shared = texts.sparkSession.sparkContext.broadcast((weights, bits))  # fixed sizes
    reach = max_words - 1

    def run(batches):
        weights, bits = shared.value
        for lang, numbers, words, hashes in chunks(batches, size):
            at = _pairs(numbers)
            with np.errstate(over="ignore"):
                part = (mixed(hashes[numbers[at]], hashes[numbers[at + 1]]) % np.uint64(len(bits) * 64)).astype(np.int64)
            linked = np.zeros(max(1, len(numbers) - 1), bool)
            linked[at] = frequent(bits, part)
            weight = weights[(hashes % np.uint64(len(weights))).astype(np.int64)]
            order = np.empty(len(words), np.int64)
            order[np.lexsort((hashes, weight))] = np.arange(len(words))
            rows = fragments_of(numbers, linked, order, reach)
            if not len(rows):
                continue
            rows = rows[np.lexsort([rows[:, i] for i in range(2 * reach, -1, -1) if i != reach] + [rows[:, reach]])]
            first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)]))
            times = np.diff(np.append(first, len(rows)))
            rows = rows[first]
            cuts = np.flatnonzero(np.concatenate([[True], rows[1:, reach] != rows[:-1, reach], [True]]))
            text = [w + b" " for w in words]
            text[0] = b""
            lines = [b"%d %b" % (n, b"".join([text[i] for i in row])) for n, row in zip(times.tolist(), rows.tolist())]
            groups: dict[int, list[bytes]] = {}
            for lo, hi in zip(cuts.tolist(), cuts[1:].tolist()):
                pivot = rows[lo, reach]
                parts, own = int(1 + weight[pivot] // pivot_part), int(hashes[pivot] >> np.uint64(32))
                dealt = {0: lines[lo:hi]}
                if parts > 1:
                    dealt = {}
                    for row, line in zip(rows[lo:hi].tolist(), lines[lo:hi]):
                        dealt.setdefault(hash(tuple(int(hashes[i]) for i in row)) % parts, []).append(line)
                for k, some in dealt.items():
                    groups.setdefault((own + k) % GROUPS, []).extend([b"\t%b %d" % (words[pivot], parts), *some])
            keys = sorted(groups)
            for lo in range(0, len(keys), 256):
                some = keys[lo : lo + 256]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array([b"\n".join(groups[k]) for k in some], pa.binary())], names=["lang", "group", "fragments"])

    return texts.mapInArrow(run, "lang string, group int, fragments binary")


def own_phrases(fragment: list[bytes], pivot: bytes, max_words: int):
    """The phrases of a fragment that hold its pivot's (leftmost) place."""
    at = fragment.index(pivot)
    for lo in range(max(0, at - max_words + 1), at + 1):
        for hi in range(max(at, lo + 1) + 1, min(len(fragment), lo + max_words) + 1):
            yield b" ".join(fragment[lo:hi])


def mined(sent: DataFrame, least: int, max_words: int) -> DataFrame:
    """(lang, phrase, a) of the phrases that stand least times or more."""
    names = ["lang", "phrase", "a", "whole"]

    def run(batches):
        now, own, split, passed = None, Counter(), Counter(), False

        def close(final: bool):
            """The group's phrases: those of undivided pivots are whole if none were passed on before, and rare ones go."""
            nonlocal own, split, passed
            whole = final and not passed
            for counts, done in ((own, whole), (split, False)):
                some = [(p.decode(), n) for p, n in counts.items() if n >= least or not done]
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array([now[0]] * len(some), pa.string()), pa.array([p for p, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64()), pa.array([done] * len(some))], names=names)
            own, split, passed = Counter(), Counter(), not final

        for b in slices(batches, 64):
            for lang, group, lines in zip(*(b.column(i).to_pylist() for i in range(3))):
                if now != (lang, group):
                    if now is not None:
                        yield from close(True)
                    now = (lang, group)
                for line in lines.split(b"\n"):
                    if line[0] == 9:
                        pivot, parts = line[1:].split()
                        counts = own if parts == b"1" else split
                        continue
                    n, *fragment = line.split()
                    n = int(n)
                    for phrase in own_phrases(fragment, pivot, max_words):
                        counts[phrase] += n
                if len(own) + len(split) > HELD:
                    yield from close(False)
        if now is not None:
            yield from close(True)

    parts = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sent.repartition(parts, "lang", "group").sortWithinPartitions("lang", "group")
    out = written(dealt.mapInArrow(run, "lang string, phrase string, a long, whole boolean"), "mined-phrases")
    split = out.where("NOT whole").groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return out.where("whole").select("lang", "phrase", "a").unionByName(split)


# Scores


def scored(found: DataFrame, words: DataFrame) -> DataFrame:
    """found with n_words, l, r and score of the lowest-scoring cut; words: (lang, phrase, f)."""
    w = F.split("phrase", " ", -1)
    rows = found.withColumn("w", w).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    sides = F.explode(F.array(F.struct(F.lit("l").alias("side"), F.slice("w", F.lit(1), F.col("k")).alias("p")), F.struct(F.lit("r").alias("side"), F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")).alias("p")))).alias("s")
    asked = rows.select("lang", F.col("phrase").alias("whole"), "a", "k", sides).select("lang", "whole", "a", "k", "s.side", F.array_join("s.p", " ").alias("phrase"))
    asked = written(asked, "asked-counts")
    times = asked.groupBy("lang", "phrase").agg(F.count("*").alias("n"))
    known = words.unionByName(found.select("lang", "phrase", F.col("a").alias("f")))
    known = written(times.join(known, ["lang", "phrase"]), "known-counts")
    told = attach(asked, known, ["lang", "phrase"], "n", asked.count())
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("f"))).alias(s)
    cut = told.groupBy("lang", "whole", "a", "k").agg(side("l"), side("r"))
    score = F.expr("CAST(CAST(1000000 AS DECIMAL(38, 0)) * CAST(a AS DECIMAL(19, 0)) * CAST(a AS DECIMAL(19, 0)) AS DECIMAL(38, 0)) DIV (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
    cut = cut.withColumn("score", score.cast("long"))
    best = cut.groupBy("lang", "whole", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    return best.select("lang", F.col("whole").alias("phrase"), "a", "c.l", "c.r", "c.score")


def collocations(docs: DataFrame, least: int = 10, max_words: int = 3, share: int = SHARE, top: int = TOP, size: int = CHUNK, word_parts: int = WORD_PARTS, pair_parts: int = PAIR_PARTS, pivot_part: int = PIVOT_PART, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to max_words words."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    words, pair_bits = counted(texts, least, size, pair_parts)
    bits = np.zeros(pair_parts // 64, np.int64)
    table = pair_bits.toArrow()  # at most pair_parts / 64 rows
    bits[table["at"].to_numpy()] = table["bits"].to_numpy()
    sent = routed(texts, rarity(words, word_parts), bits.view(np.uint64), size, max_words, pivot_part)
    found = written(mined(sent, least, max_words), "candidates")
    best = scored(found, words.where(F.col("f") >= least).select("lang", F.col("word").alias("phrase"), "f"))
    # A candidate goes if a longer one holds it in at least share percent of its places.
    w = F.split("phrase", " ", -1)
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    longer = found.withColumn("w", w).where(F.size("w") > 2).select("lang", F.explode(F.array_distinct(inside)).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")
    # The first of each part of a language, then of the language.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    by = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    firsts = kept.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    out = firsts.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).join(broadcast_if_small(written(total, "languages"), 64), "lang")
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


SQL = r"""
WITH p AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) t(k))),
c AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE k = 1 GROUP BY lang),
a AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM c WHERE k > 1 AND f >= 10),
q AS MATERIALIZED (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS lp, array_to_string(w[cut + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS cut FROM a)),
v AS MATERIALIZED (SELECT lang, phrase, f FROM c SEMI JOIN (SELECT lang, lp AS phrase FROM q UNION SELECT lang, rp FROM q) x USING (lang, phrase)),
s AS (SELECT q.lang, q.phrase, q.a, cut, l.f AS l, r.f AS r, (1000000::HUGEINT * q.a * q.a) // (l.f::HUGEINT * r.f) AS score
  FROM q JOIN v l ON l.lang = q.lang AND l.phrase = lp JOIN v r ON r.lang = q.lang AND r.phrase = rp),
b AS MATERIALIZED (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
d AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM a WHERE k = 3) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM b LEFT JOIN d USING (lang, phrase) JOIN n USING (lang) WHERE longer IS NULL OR 100 * longer < 50 * a QUALIFY rank <= 2000
"""
