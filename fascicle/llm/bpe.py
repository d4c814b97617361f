"""Byte-level BPE encoding and decoding by monoid tree reduction.

Two levels use the same idea: encode the halves, then join neighbours by re-encoding a
window around the seam that grows until what lies outside is proven stable.

* Text: a piece's value is its pre-tokens. On the left of a seam a pre-token that ended at
  least three characters before it cannot change, as the pattern looks no further ahead; on
  the right all is stable from the first boundary that both splits share, as the pattern
  never looks back.
* Pre-token: a piece's value is its tokens. A token list is the BPE encoding of its bytes if
  each neighbouring pair is the encoding of its own bytes, so a window is done once the pairs
  at its two edges are.

Decoding concatenates the bytes of the tokens up a tree of halves: any tree gives the same.
Each row is encoded within its task, and a row's memory is in proportion to its text.

Defined results: a null text is encoded as an empty one (no tokens); a null id list decodes to
no bytes; ids outside the vocabulary raise; rows may repeat; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fascicle.llm.common import kept, slices, small_batches

#: Characters of a text (tokens of a list) and bytes of a pre-token that are encoded (decoded) without halving.
LEAF_CHARS, LEAF_BYTES = 4096, 8
#: Characters before a seam that the pattern may look at: a contraction's letters.
LOOKAHEAD = 3
#: Distinct pre-tokens whose tokens a worker keeps, in each of two generations.
CACHED = 150_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def ascii_form(pattern: str) -> str:
    """A pattern of \\p{L}, \\p{N}, \\s and \\S that splits ASCII texts alike, with plain classes."""
    inside = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": r"\x09-\x0d "}
    out = re.sub(r"\[[^\]]*\]", lambda m: re.sub(r"\\p\{[LN]\}|\\s", lambda x: inside[x[0]], m[0]).replace("[", "\0"), pattern)
    for k, v in {**inside, r"\S": r"^\x09-\x0d "}.items():
        out = re.sub(rf"{re.escape(k)}(?![^\0\[]*\])", lambda _, v=v: f"[{v}]", out)
    return out.replace("\0", "[")


class Codec:
    """Encodes and decodes by ranks and a pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        import regex

        self.ranks, self.leaf_chars, self.leaf_bytes = ranks, leaf_chars, leaf_bytes
        self._split, self._ascii = regex.compile(pattern).findall, re.compile(ascii_form(pattern)).findall
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.short: dict[bytes, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    # Pre-tokens

    def merged(self, data: bytes) -> list[int]:
        """The encoding of a short byte string: always join the neighbours of the lowest rank."""
        if len(data) > 64:
            return self._merged_long(data)
        get, none = self.ranks.get, 1 << 60
        cuts = list(range(len(data) + 1))
        pairs = [get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs:
            low = min(pairs)
            if low == none:
                break
            i = pairs.index(low)
            del pairs[i], cuts[i + 1]
            if i < len(pairs):
                pairs[i] = get(data[cuts[i] : cuts[i + 2]], none)
            if i:
                pairs[i - 1] = get(data[cuts[i - 1] : cuts[i + 1]], none)
        return [self.ranks[data[a:b]] for a, b in zip(cuts, cuts[1:])]

    def _merged_long(self, data: bytes) -> list[int]:
        """merged() with a heap of pairs: n log n steps."""
        get, n = self.ranks.get, len(data)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(k, i, 2) for i in range(n - 1) if (k := get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        size = [1] * n  # 0: merged into the part before
        while heap:
            _, i, length = heapq.heappop(heap)
            j = after[i]
            if not size[i] or j >= n or size[i] + size[j] != length:
                continue
            size[i], size[j], after[i] = length, 0, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (k := get(data[i : i + length + size[after[i]]])) is not None:
                    heapq.heappush(heap, (k, i, length + size[after[i]]))
            if (h := before[i]) >= 0 and (k := get(data[h : i + length])) is not None:
                heapq.heappush(heap, (k, h, i + length - h))
        return [self.ranks[data[i : i + size[i]]] for i in range(n) if size[i]]

    def part(self, data: bytes) -> list[int]:
        """merged(), remembered; the list must not be changed."""
        if len(data) > 64:
            return self.merged(data)
        found = self.short.get(data)
        if found is None:
            if len(self.short) >= CACHED:
                self.short.clear()
            found = self.short[data] = self.merged(data)
        return found

    def _stable(self, left: int, right: int) -> bool:
        """Whether two tokens side by side are the encoding of their bytes."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= CACHED:
                self.pairs.clear()
            found = self.pairs[left, right] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return found

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encodings' bytes together."""
        if not left or not right:
            return left + right
        if self._stable(left[-1], right[0]):
            return left + right
        a = b = 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            window = self.part(b"".join([self.tokens[t] for t in left[len(left) - a :] + right[:b]]))
            left_ok = a == len(left) or self._stable(left[-a - 1], window[0])
            right_ok = b == len(right) or self._stable(window[-1], right[b])
            if left_ok and right_ok:
                return left[: len(left) - a] + window + right[b:]
            a, b = a if left_ok else 2 * a, b if right_ok else 2 * b

    def pretoken(self, data: bytes) -> list[int]:
        """The encoding of one pre-token: its own token, or leaves, then joins up the tree."""
        if data in self.ranks:
            return [self.ranks[data]]
        return self._tree(data)

    def _tree(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf_bytes:
            return self.part(data)
        half = len(data) // 2
        return self.joined(self._tree(data[:half]), self._tree(data[half:]))

    # Texts

    def split(self, text: str) -> list[str]:
        return self._ascii(text) if text.isascii() else self._split(text)

    def pretokens(self, text: str) -> list[str]:
        """A text's pre-tokens: leaves, then joins up the tree."""
        if len(text) <= self.leaf_chars:
            return self.split(text)
        level = [self.split(text[i : i + self.leaf_chars]) for i in range(0, len(text), self.leaf_chars)]
        while len(level) > 1:
            level = [self.seam(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def seam(self, left: list[str], right: list[str]) -> list[str]:
        """The pre-tokens of two pieces' text together."""
        keep, tail = len(left), 0
        while keep and (tail < LOOKAHEAD or keep == len(left)):
            keep -= 1
            tail += len(left[keep])
        head = "".join(left[keep:])
        take = 1
        while True:
            take = min(take, len(right))
            window = self.split(head + "".join(right[:take]))
            if take == len(right):
                return left[:keep] + window
            # Its last pre-tokens may still change; the earlier boundaries may not.
            ends, at, last = {}, 0, len(head) + sum(map(len, right[:take])) - LOOKAHEAD
            for i, w in enumerate(window):
                at += len(w)
                if len(head) <= at <= last:
                    ends[at] = i + 1
            at = len(head)
            for j in range(take + 1):
                if at in ends:
                    return left[:keep] + window[: ends[at]] + right[j:]
                at += len(right[j]) if j < take else 0
            take *= 2

    def encode(self, text: str) -> np.ndarray:
        """A text's token ids."""
        pieces = self.pretokens(text)
        for p in set(pieces).difference(self.young):
            self.young[p] = self.old.get(p) or array("i", self.pretoken(p.encode())).tobytes()
        out = np.frombuffer(b"".join(map(self.young.__getitem__, pieces)), np.int32)
        if len(self.young) >= CACHED:
            self.young, self.old = {}, self.young
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of token ids."""
        if ids and min(ids) < 0:
            raise ValueError("a token id is negative")
        return self._bytes(ids)

    def _bytes(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf_chars:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self._bytes(ids[:half]) + self._bytes(ids[half:])


def encoded_part(codec: Codec, texts: pa.Array) -> pa.ListArray:
    """The token ids of an Arrow array of texts; null is encoded as empty."""
    ids = [codec.encode(t or "") for t in texts.to_pylist()]
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))


def _shared_codec(spark: SparkSession, vocabulary: str, pattern: str) -> Callable[[], Codec]:
    """Gives each Python worker its codec. The driver reads the file; its ranks are broadcast."""
    small_batches(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))  # a fixed vocabulary: about 1 MB
    key = hashlib.sha256(repr((sorted(ranks.value.items()), pattern)).encode()).hexdigest()

    return lambda: kept(key, lambda: Codec(ranks.value, pattern))


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row."""
    codec = _shared_codec(docs.sparkSession, vocabulary, pattern)

    def run(batches):
        c = codec()
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), encoded_part(c, part.column(1))], names=[id_col, "ids"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, f"`{id_col}` long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """encoded with ``decoded`` binary added."""
    codec = _shared_codec(encoded.sparkSession, vocabulary, pattern)
    at = encoded.columns.index(ids_col)
    schema = encoded.select("*", F.lit(b"").alias("decoded")).schema

    def run(batches):
        c = codec()
        for part in slices(batches):
            texts = [c.decode(i or []) for i in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for every row."""
    import public_tokenizers

    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN
    codec = _shared_codec(docs.sparkSession, vocabulary, pattern)

    def run(batches):  # both ways in one worker, which halves the workers and their codecs
        c = codec()
        for part in slices(batches):
            ids = encoded_part(c, part.column(1))
            texts = pa.array([c.decode(i) for i in ids.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), ids, texts], names=[id_col, "ids", "decoded"])

    out = docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, f"`{id_col}` long, ids array<int>, decoded binary")
    return out.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
