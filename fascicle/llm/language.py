"""Language ID by segmentation-marginalised unigrams.

Pieces come from a fixed public vocabulary. A word (letters only, lower-cased, with the
vocabulary's word-start mark before it) has under language l the probability

    P(word | l) = sum over all its segmentations into pieces of the product of P(piece | l),

which a forward pass computes in time linear in the word. P(piece | l) is learned by EM from
uniform probabilities: a forward-backward pass gives each piece's expected count over all
segmentations. A text's score for l is the sum of its words' log probabilities; the
prediction is the best language and the score its posterior under equal priors.

Training takes at most about ``per_lang`` labelled documents of each language, chosen by a hash
of the id; scoring covers every row and whole texts. What reaches the driver is one number a
piece and language.

Defined results: a null text or one without letters is ``und`` with score 0; with no labelled
rows everything is ``und``; rows with a null id are scored, never learned from; rows may
repeat; ties go to the first language in name order; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fascicle.llm.common import kept, slices, small_batches, written

WORD = re.compile(r"[^\W\d_]+")
START = "▁"
PER_LANG, ROUNDS, SMOOTH = 800, 2, 0.1
#: Words whose log probabilities a worker keeps.
CACHED = 250_000


def read_pieces(path: str) -> list[str]:
    """The lower-case pieces of a SentencePiece vocabulary, without control and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
    pieces = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not skip(i)}
    return sorted(p for p in pieces if p == p.lower() and re.fullmatch(rf"{START}?[^\W\d_]*", p))


class Lattice:
    """The pieces that may stand at each place of a word. The last piece id is any other character."""

    def __init__(self, pieces: list[str]):
        self.other = len(pieces)
        self.prefix: dict[str, int] = {}
        for p in pieces:
            for i in range(1, len(p)):
                self.prefix.setdefault(p[:i], -1)
        for i, p in enumerate(pieces):
            self.prefix[p] = i

    def arcs(self, word: str) -> list[list[tuple[int, int]]]:
        """For each start, the (end, piece id) of pieces found there."""
        text, find = START + word, self.prefix.get
        out, n = [], len(text)
        for i in range(n):
            here, single = [], False
            for j in range(i + 1, n + 1):
                k = find(text[i:j])
                if k is None:
                    break
                if k >= 0:
                    here.append((j, k))
                    single |= j == i + 1
            if not single:
                here.append((i + 1, self.other))
            out.append(here)
        return out

    def forward(self, word: str, probs: list[tuple[float, ...]], langs: int) -> list[float]:
        """log P(word | l) for each language."""
        arcs = self.arcs(word)
        alpha = [None] * (len(arcs) + 1)
        alpha[0], scale = [1.0] * langs, 0.0
        for i, here in enumerate(arcs):
            a = alpha[i]
            alpha[i] = None
            if max(a) < 1e-100:  # long words: scale all open ends alike
                scale += 100 * math.log(10)
                a = [x * 1e100 for x in a]
                for j in range(i + 1, len(alpha)):
                    if alpha[j] is None:
                        break
                    alpha[j] = [x * 1e100 for x in alpha[j]]
            for j, k in here:
                p, b = probs[k], alpha[j]
                alpha[j] = [x * y for x, y in zip(a, p)] if b is None else [z + x * y for x, y, z in zip(a, p, b)]
            # a gap can't arise: every start has an arc of one character
        return [math.log(max(x, 1e-300)) - scale for x in alpha[-1]]

    def expected(self, word: str, p: list[float], weight: float, into: dict[int, float]) -> None:
        """Adds each piece's expected count, over all segmentations, times weight."""
        if len(word) > 64:
            return self._expected_long(word, p, weight, into)
        arcs = self.arcs(word)
        n = len(arcs)
        a, b = [0.0] * (n + 1), [0.0] * (n + 1)
        a[0] = b[n] = 1.0
        for i in range(n):
            for j, k in arcs[i]:
                a[j] += a[i] * p[k]
        for i in range(n - 1, -1, -1):
            b[i] = sum(p[k] * b[j] for j, k in arcs[i])
        if a[n] > 0:
            for i in range(n):
                for j, k in arcs[i]:
                    into[k] += weight * a[i] * p[k] * b[j] / a[n]

    def _expected_long(self, word: str, p: list[float], weight: float, into: dict[int, float]) -> None:
        """As expected(), in logarithms, which do not underflow on long words."""
        arcs = [[(j, k, math.log(p[k])) for j, k in here if p[k] > 0] for here in self.arcs(word)]
        n, none = len(arcs), -math.inf
        a, b = [none] * (n + 1), [none] * (n + 1)
        a[0] = b[n] = 0.0
        for i in range(n):
            for j, _, q in arcs[i]:
                a[j] = _log_sum(a[j], a[i] + q)
        for i in range(n - 1, -1, -1):
            for j, _, q in arcs[i]:
                b[i] = _log_sum(b[i], q + b[j])
        if a[n] > none:
            for i in range(n):
                for j, k, q in arcs[i]:
                    into[k] += weight * math.exp(a[i] + q + b[j] - a[n])


def _log_sum(x: float, y: float) -> float:
    """log(exp(x) + exp(y))."""
    hi, lo = max(x, y), min(x, y)
    return hi if lo == -math.inf else hi + math.log1p(math.exp(lo - hi))


class Model:
    """Languages and, for each piece, its probability in each of them."""

    def __init__(self, langs: list[str], pieces: list[str], probs: np.ndarray):
        self.langs, self.pieces, self.probs = langs, pieces, probs

    def scorer(self):
        return Scorer(self)


class Scorer:
    """Predicts languages; keeps the log probabilities of words it has met."""

    def __init__(self, model: Model):
        self.langs, self.lattice, self.probs = model.langs, Lattice(model.pieces), model.probs
        self.rows = [tuple(row) for row in model.probs.tolist()]
        self.at: dict[str, int] = {}
        self.logs = np.zeros((CACHED, max(1, len(self.langs))))

    def _learn(self, words: set[str]) -> None:
        """Adds words' log probabilities; words of one length go through the forward pass together."""
        by_length: dict[int, list[str]] = defaultdict(list)
        for w in words:
            by_length[len(w)].append(w)
        for n, group in by_length.items():
            lo = len(self.at)
            self.at.update(zip(group, range(lo, lo + len(group))))
            if n > 40 or len(group) < 4:
                self.logs[lo : lo + len(group)] = [self.lattice.forward(w, self.rows, len(self.langs)) for w in group]
            else:
                self.logs[lo : lo + len(group)] = self._forward(group, n + 1)

    def _forward(self, group: list[str], n: int) -> np.ndarray:
        find, other = self.lattice.prefix.get, self.lattice.other
        alpha = np.zeros((n + 1, len(group), len(self.langs)))
        alpha[0] = 1.0
        texts = [START + w for w in group]
        for i in range(n):
            arcs: list[tuple[list[int], list[int]]] = [([], []) for _ in range(n - i)]
            for r, t in enumerate(texts):
                k = find(t[i])
                if k is None or k < 0:
                    arcs[0][0].append(r)
                    arcs[0][1].append(other)
                else:
                    arcs[0][0].append(r)
                    arcs[0][1].append(k)
                j = i + 2
                while k is not None and j <= n:
                    k = find(t[i:j])
                    if k is not None and k >= 0:
                        found = arcs[j - i - 1]
                        found[0].append(r)
                        found[1].append(k)
                    j += 1
            for step, (rows, ids) in enumerate(arcs):
                if rows:
                    alpha[i + step + 1, rows] += alpha[i, rows] * self.probs[ids]
        return np.log(np.maximum(alpha[n], 1e-300))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, posterior) of each text."""
        out = []
        for lo in range(0, len(texts), 256):
            part = [WORD.findall((t or "").lower()) for t in texts[lo : lo + 256]]
            if max(map(len, part)) > CACHED // 4:
                out += self._long(texts[lo : lo + 256])
            else:
                out += self._score(part)
        return out

    def _long(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """As predict(), each text by itself and in parts."""
        out = []
        for t in texts:
            words = WORD.findall((t or "").lower())
            totals = [self._total(words[i : i + CACHED // 4]) for i in range(0, len(words), CACHED // 4)]
            out.append(self._best(words, sum(totals) if totals else None))
        return out

    def _total(self, words: list[str]) -> np.ndarray:
        new = set(words).difference(self.at)
        if len(self.at) + len(new) > CACHED:
            self.at.clear()
            new = set(words)
        self._learn(new)
        return self.logs[list(map(self.at.__getitem__, words))].sum(0)

    def _best(self, words: list[str], total: np.ndarray | None) -> tuple[str, float]:
        if not self.langs or total is None or not any(c.isalpha() for w in words for c in w):
            return "und", 0.0
        best = int(total.argmax())
        return self.langs[best], round(float(1 / np.exp(total - total[best]).sum()), 6)

    def _score(self, part: list[list[str]]) -> list[tuple[str, float]]:
        new: set[str] = set().union(*part).difference(self.at)
        if len(self.at) + len(new) > CACHED:
            self.at.clear()
            new = set().union(*part)
        if len(new) > CACHED:
            return [self._best(w, self._total(w) if w else None) for w in part]
        self._learn(new)
        get = self.at.__getitem__
        return [self._best(w, self.logs[list(map(get, w))].sum(0) if w else None) for w in part]


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def train(labelled: DataFrame, vocabulary: str, per_lang: int = PER_LANG, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns a model from rows whose language is set, about per_lang of each language."""
    small_batches(labelled.sparkSession)
    pieces = read_pieces(vocabulary)
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], pieces, np.zeros((len(pieces) + 1, 1)))
    share = F.create_map(*[x for l in langs for x in (F.lit(l), F.lit(min(1.0, per_lang / counts[l])))])  # noqa: E741
    chance = F.pmod(F.xxhash64(F.lit("language"), F.col(id_col)), F.lit(1_000_000)) / 1e6
    sample = rows.where(chance < share[F.col(lang_col)]).select(lang_col, text_col)

    def words(batches):
        for b in slices(batches):
            n: Counter[tuple[str, str]] = Counter()
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w, c in Counter(WORD.findall((text or "").lower())).items():
                    n[lang, w] += c
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["lang", "word", "n"])

    table = written(sample.mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    size = len(pieces) + 1
    probs = np.full((size, len(langs)), 1.0 / size)
    for _ in range(rounds):
        now = labelled.sparkSession.sparkContext.broadcast((langs, pieces, probs))  # a number a piece and language

        def count(batches, now=now):
            names, vocabulary, p = now.value
            lattice, column = Lattice(vocabulary), {l: p[:, i].tolist() for i, l in enumerate(names)}  # noqa: E741
            into: dict[str, dict[int, float]] = defaultdict(lambda: defaultdict(float))
            for b in batches:
                for lang, word, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                    lattice.expected(word, column[lang], n, into[lang])
            flat = [(l, k, c) for l, d in into.items() for k, c in d.items()]  # noqa: E741
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.int32()), pa.array([x[2] for x in flat], pa.float64())], names=["lang", "piece", "c"])

        found = table.mapInArrow(count, "lang string, piece int, c double").groupBy("lang", "piece").agg(F.sum("c").alias("c")).toPandas()
        probs = np.full((size, len(langs)), SMOOTH)
        np.add.at(probs, (found["piece"].to_numpy(int), found["lang"].map({l: i for i, l in enumerate(langs)}).to_numpy(int)), found["c"].to_numpy(float))  # noqa: E741
        probs /= probs.sum(0)
    return Model(langs, pieces, probs)


def predict(docs: DataFrame, model: Model, text_col: str = "text", into: str = "language") -> DataFrame:
    """docs with a struct column (lang_pred, score) added; only the text goes to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])
    key = uuid.uuid4().hex

    def run(batches):
        scorer = kept(key, lambda: shared.value.scorer())
        for texts in slices(batches):
            found = scorer.predict(texts.to_pylist())
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], fields=list(kind))

    return docs.withColumn(into, _iterated(run, "lang_pred string, score double")(F.col(text_col).cast("string")))


def _iterated(run, schema: str):
    """An Arrow UDF over an iterator of columns, evaluated once a row."""
    from collections.abc import Iterator

    def udf(batches):
        yield from run(batches)

    udf.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(udf, schema).asNondeterministic()


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def identify(docs: DataFrame, vocabulary: str | None = None, per_lang: int = PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", into: str = "language") -> DataFrame:
    """docs with the prediction added, by a model learned from the rows that aren't held out."""
    labelled = docs.where(~held_out(id_col)).select(id_col, text_col, lang_col)
    model = train(labelled, vocabulary or vocabulary_path(), per_lang, id_col=id_col, text_col=text_col, lang_col=lang_col)
    return predict(docs, model, text_col, into)


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without texts that have no letters or whose best language has a posterior under ``least``."""
    own = docs.columns
    out = identify(docs, into="__language")
    return out.where((F.col("__language.lang_pred") != "und") & (F.col("__language.score") >= least)).select(*own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    return out.select("doc_id", held_out().alias("held_out"), "language.lang_pred", "language.score")
