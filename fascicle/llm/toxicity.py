"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lower-cases, maps homoglyphs (Cyrillic, Greek, full-width, accents stripped only where
a map entry says so) and digit or symbol substitutions to letters, and leaves words separated
by single spaces. Lexicon entries are whole words (`` idiot ``) or word beginnings (`` lowei``);
a hit inside an exception phrase is void. A text's score is a logistic function of its total
hit weight and of that weight a thousand words.

A seed list gives words a weight before any label is seen. Learning takes at most about
``per_class`` labelled documents of either class, chosen by a hash of the id: words and word
beginnings that are far likelier in toxic documents become entries, greedily, while they
explain toxic documents that no entry does yet; weights are smoothed log-likelihood ratios.
Scoring covers every row and whole texts.

Defined results: null and empty texts have no hits and get the score of a text without any;
documents without a label are scored, not learned from; a label repeated for an id counts as
often; with no labels the seed list and fixed coefficients hold; null ids are scored; other
columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fascicle.llm.common import kept, slices, small_batches, written
from fascicle.llm.language import _iterated, held_out

#: Characters that look like Latin letters, and the letters.
LOOKALIKE, LATIN = "аеорсухіјѕԁһкмтвнαορτνικεⅰ０１３４５７", "aeopcyxijsdhkmtbhaoptvikeioieast"
HOMOGLYPHS = str.maketrans(LOOKALIKE, LATIN)
HOMOGLYPH = re.compile(f"[{LOOKALIKE}]")
#: Beyond ASCII: punctuation and spaces, which end a word.
MARKS = re.compile("[\u0080-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u2000-\u206f\u3000-\u303f]")
SYMBOL = re.compile(r"(?<=\w)[@$!](?=\w)")
SYMBOLS = {"@": "a", "$": "s", "!": "i"}
#: UTF-8 bytes: digits become letters, other ASCII but lower-case letters a space.
FOLDED = bytes(b"oi2eas6t8"[b - 48] if 48 <= b < 57 else b if b == 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Plain insults, as a start; learned weights take their place where labels say more.
SEEDS = ("idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "imbecile", "dumbass", "jerk", "filth", "vermin")
#: Phrases in which a seed word isn't an insult.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "circus clown", "take out the trash", "pond scum", "sore loser award")
SEED_WEIGHT, PER_CLASS, LEAST_WEIGHT, BEGINNINGS = 6.0, 3000, 4.0, (4, 5, 6, 7, 8)
#: Intercept, and factors of log(1 + weight) and log(1 + weight a thousand words), without labels.
COEFFICIENTS = (-4.0, 2.0, 1.0)


def fold(text: str | None) -> str:
    """The folded words, with one space before, between and after them."""
    text = (text or "").lower()
    if not text.isascii():
        if HOMOGLYPH.search(text):
            text = text.translate(HOMOGLYPHS)
        text = MARKS.sub(" ", text)
    if "@" in text or "$" in text or "!" in text:
        text = SYMBOL.sub(lambda m: SYMBOLS[m[0]], text)
    return f" {b' '.join(text.encode().translate(FOLDED).split()).decode()} "


class Lexicon:
    """Entry (with its leading, and for whole words trailing, space) to weight; exceptions; coefficients."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS, coefficients=COEFFICIENTS):
        self.weights, self.exceptions, self.coefficients = weights, exceptions, tuple(coefficients)
        self._automaton = None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            found = ahocorasick.Automaton()
            for k, w in self.weights.items():
                found.add_word(k, (len(k), w, k))
            for e in self.exceptions:
                key = f" {e} "
                found.add_word(key, (len(key), 0.0, ""))
            found.make_automaton()
            self._automaton = found
        return self._automaton

    def hits(self, folded: str) -> list[tuple[int, str, float]]:
        """(place, entry, weight) of each hit outside exception phrases; the heaviest at a place."""
        if not self.weights:
            return []
        best: dict[int, tuple[str, float]] = {}
        void: list[tuple[int, int]] = []
        for end, (n, w, k) in self.automaton().iter(folded):
            at = end - n + 1
            if not k:
                void.append((at, end))
            elif at not in best or best[at][1] < w:
                best[at] = k, w
        out, reach, spans = [], -1, iter(sorted(void))
        span = next(spans, None)
        for at, (k, w) in sorted(best.items()):
            while span and span[0] <= at:
                reach, span = max(reach, span[1]), next(spans, None)
            if at >= reach:
                out.append((at, k, w))
        return out

    def features(self, text: str | None) -> tuple[float, float]:
        folded = fold(text)
        total = sum(w for _, _, w in self.hits(folded))
        words = max(1, folded.count(" ") - 1)
        return math.log1p(total), math.log1p(1000 * total / words)

    def score(self, text: str | None) -> float:
        a, b, c = self.coefficients
        x, y = self.features(text)
        return round(1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y)))), 6)


def _candidates(folded: str) -> set[str]:
    words = set(folded.split())
    out = {f" {w} " for w in words if len(w) >= 3}
    for w in words:
        out.update(f" {w[:n]}" for n in BEGINNINGS if len(w) > n)
    return out


def explaining(where: dict[str, set[int]], covered: set[int], least: float, weights: dict[str, float]) -> list[str]:
    """Entries in the order in which each explains most documents that none before it does.

    Ends with the first that would explain fewer than ``least``; ties go to the heavier, then the
    last by name. What an entry explains only shrinks, so one that is still first after a new
    count is the best, and few are counted anew.
    """
    covered, out = set(covered), []
    rank = lambda k: (-len(where[k] - covered), -weights[k], [-ord(c) for c in k] + [1])
    heap = [(rank(k), k) for k in where]
    heapq.heapify(heap)
    while heap:
        _, k = heapq.heappop(heap)
        now = rank(k)
        if heap and now > heap[0][0]:
            heapq.heappush(heap, (now, k))
            continue
        if -now[0] < least:
            break
        covered |= where[k]
        out.append(k)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> tuple[float, ...]:
    """Newton steps for a ridge logistic regression; the first coefficient is the intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (p - y) + ridge * b
        step = np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-6)) @ x + ridge * np.eye(len(b)), g)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in b)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """Learns a lexicon from labelled rows that aren't held out, about per_class of either class."""
    small_batches(docs.sparkSession)
    seeds = {f" {w} ": SEED_WEIGHT for w in SEEDS}
    marks = labels.where(~held_out(id_col, 5, 0) & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"))
    counts = {r[0]: r[1] for r in marks.groupBy("__y").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return Lexicon(seeds)
    share = F.when(F.col("__y") == 1, F.lit(min(1.0, per_class / counts[1]))).otherwise(F.lit(min(1.0, per_class / counts[0])))
    marks = marks.where(F.pmod(F.xxhash64(F.lit("toxicity"), F.col("__id")), F.lit(1_000_000)) / 1e6 < share)
    # At most about 2 * per_class ids: a bounded broadcast.
    rows = docs.select(F.col(id_col).alias("__id"), text_col).join(F.broadcast(marks), "__id")
    rows = written(rows.select("__y", F.col(text_col).alias("__text")), "toxicity-sample")

    def features(batches):
        for b in slices(batches):
            n = Counter(), Counter()
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n[y].update(_candidates(fold(t)))
            for y in (0, 1):
                yield pa.RecordBatch.from_arrays([pa.array(list(n[y]), pa.string()), pa.array([y] * len(n[y]), pa.int32()), pa.array(list(n[y].values()), pa.int64())], names=["entry", "y", "n"])

    sizes = {r[0]: r[1] for r in rows.groupBy("__y").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    counted = rows.mapInArrow(features, "entry string, y int, n long").groupBy("entry").agg(F.sum(F.expr("if(y = 1, n, 0)")).alias("bad"), F.sum(F.expr("if(y = 0, n, 0)")).alias("good"))
    ratio = F.log((F.col("bad") + 0.1) / (bad + 0.2)) - F.log((F.col("good") + 0.1) / (good + 0.2))
    # Each candidate stands in at least 4 toxic documents, so their number is bounded by the sample.
    wanted = counted.where((F.col("bad") >= 4) & (ratio >= LEAST_WEIGHT)).select("entry", "bad", ratio.alias("w"))
    found = {r[0]: (r[1], r[2]) for r in wanted.collect()}
    known = {r[0]: r[1] for r in counted.where(F.col("entry").isin(list(seeds)) & (F.col("bad") + F.col("good") >= 4)).select("entry", ratio).collect()}
    trial = Lexicon({**{k: w for k, (_, w) in found.items()}}, exceptions=())
    shared = rows.sparkSession.sparkContext.broadcast(trial)

    def incidence(batches):
        for b in slices(batches):
            ks = [sorted({k for _, k, _ in _all_hits(shared.value, fold(t))}) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ks, pa.list_(pa.string()))], names=["y", "entries"])

    where: dict[str, set[int]] = {k: set() for k in found}
    for i, r in enumerate(rows.where("__y = 1").mapInArrow(incidence, "y int, entries array<string>").toLocalIterator()):
        for k in r["entries"]:
            where[k].add(i)
    weights = {k: w for k, w in seeds.items()} | {k: max(0.0, w) for k, w in known.items()}
    covered: set[int] = set().union(*(where[k] for k in weights if k in where)) if where else set()
    for k in explaining(where, covered, max(3, 0.001 * bad), {k: w for k, (_, w) in found.items()}):
        weights[k] = found[k][1]
    lexicon = Lexicon(weights)
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def measured(batches):
        for b in slices(batches):
            xs = [shared.value.features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in xs], pa.float64()), pa.array([x[1] for x in xs], pa.float64())], names=["y", "a", "b"])

    table = rows.mapInArrow(measured, "y int, a double, b double").toPandas()
    lexicon.coefficients = fit_logistic(table[["a", "b"]].to_numpy(), table["y"].to_numpy(float))
    return lexicon


def _all_hits(lexicon: Lexicon, folded: str):
    for end, (n, w, k) in lexicon.automaton().iter(folded) if lexicon.weights else ():
        yield end - n + 1, k, w


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", into: str = "toxicity") -> DataFrame:
    """docs with a score column added; only the text goes to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    key = uuid.uuid4().hex

    def run(batches):
        lexicon = kept(key, lambda: shared.value)
        for texts in slices(batches):
            yield pa.array([lexicon.score(t) for t in texts.to_pylist()], pa.float64())

    return docs.withColumn(into, _iterated(run, "double")(F.col(text_col).cast("string")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lexicon = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, lexicon)
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
