"""Packing: ids against the tokenizers library, plans against their bounds, whole results."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fascicle.llm import bpe, packing

SCHEMA = "doc_id long, text string, piece string, length string, part string, id string"
ODD = [None, "", "  \n\t", "a", "a", "É x\u0085y", "x" * 30000, "a <|endoftext|> b", "don't we'll  go\n\n 12 34", "日本 語" * 700]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def texts_of(n):
    rng = random.Random(5)
    return [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(int(rng.paretovariate(0.8)) % 2500)) for _ in range(n)]


def test_plans_hold_every_piece_within_the_capacity():
    rng = random.Random(1)
    for _ in range(1500):
        capacity = rng.choice([1, 2, 3, 7, 12, 30])
        counts = {rng.randint(1, capacity): rng.randint(0, 9) for _ in range(rng.randint(0, 6))}
        held = Counter()
        for bins, content in packing.plan(counts, capacity):
            assert bins > 0 and sum(size * n for size, n in content) <= capacity and all(n > 0 for _, n in content)
            assert sum(n for size, n in content if 3 * size > capacity) <= 2
            for size, n in content:
                held[size] += bins * n
        assert held == Counter({size: n for size, n in counts.items() if n})


def fewest(items, capacity):
    """Bins of an exact search over small sets."""
    best = [len(items)]

    def put(i, gaps):
        if len(gaps) >= best[0]:
            return
        if i == len(items):
            best[0] = len(gaps)
            return
        for g in sorted({*gaps, capacity}):
            if g >= items[i]:
                rest = list(gaps)
                if g in rest:
                    rest.remove(g)
                    put(i + 1, rest + [g - items[i]])
        put(i + 1, gaps + [capacity - items[i]])

    put(0, [])
    return best[0]


def test_plans_are_close_to_the_fewest_bins():
    rng = random.Random(2)
    more = 0
    for _ in range(60):
        items = sorted((rng.randint(1, 20) for _ in range(9)), reverse=True)
        mine = sum(bins for bins, _ in packing.plan(Counter(items), 20))
        least = fewest(items, 20)
        assert mine <= least + 1
        more += mine - least
    assert more <= 6
    large = Counter(rng.randint(8, 20) for _ in range(4000))  # pairs at most: matching is exact
    left, pairs = sorted(large.elements(), reverse=True), 0
    while left:
        a = left.pop(0)
        fit = next((b for b in left if a + b <= 20), None)
        if fit:
            left.remove(fit)
        pairs += 1
    assert sum(bins for bins, _ in packing.plan(large, 20)) == pairs


def test_blocks_encode_as_the_whole(library):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    small = packing.Encoder(ranks, public_tokenizers.PATTERN, block=20, longest=60)
    for text in [t or "" for t in ODD] + texts_of(40):
        assert small.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_cuts_leave_the_short_piece_first():
    assert packing.cuts(1, 4) == [0, 1] and packing.cuts(4, 4) == [0, 4] and packing.cuts(5, 4) == [0, 1, 5] and packing.cuts(12, 4) == [0, 4, 8, 12]


def test_pack(spark, library):
    texts = ODD + texts_of(300)
    docs = spark.createDataFrame([(i if i else None, t, "x", "x", "x", "x") for i, t in enumerate(texts)], SCHEMA).repartition(5)
    got = packing.pack(docs, ids=True).toPandas()
    assert list(got.columns) == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    by_doc = defaultdict(list)
    for r in got.itertuples():
        by_doc[0 if np.isnan(r.doc_id) else int(r.doc_id)].append(r)
    assert len(by_doc) == len(texts)
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids + [2]
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [x for r in parts for x in r.ids] == want
        assert [r.piece for r in parts] == list(range(len(parts))) and all(r.length == 1024 for r in parts[1:])
        for r in parts:
            own = want[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() <= 1024
    n = got.sequence_id.nunique()
    assert n <= 1.01 * got.length.sum() / 1024 + 2
    whole = packing.sequences(docs).toPandas()
    assert len(whole) == n and sum(map(len, whole.ids)) == got.length.sum()


def test_pack_empty(spark):
    out = packing.pack(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and not out.collect()
