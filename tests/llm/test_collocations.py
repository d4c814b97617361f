"""Collocations against plain counting, with split pivots, small chunks and colliding parts."""

import random
import re
from collections import Counter

import pytest

from fascicle.llm import collocations as c

SCHEMA = "doc_id long, lang string, text string, phrase string, a string, score string, rank string, n string, f string"


def plain(rows, least, top, max_words=3):
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    count[lang, tuple(words[i : i + k])] += 1
    candidates = {p: a for p, a in count.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in candidates.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
        if any(m == lang and len(q) > len(p) and inside(q) and 100 * b >= 50 * a for (m, q), b in candidates.items()):
            continue
        score, k, l, r = min((1000000 * a * a // (count[lang, p[:k]] * count[lang, p[k:]]), k, count[lang, p[:k]], count[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, l, r, total[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        rows = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(rows[:top])]
    return sorted(ranked)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["of", "the", "The", "a", "new", "york", "città", "é\u0085x", "ice", "cream", "--", "u\x1cv"] + [f"w{i}" for i in range(40)]
    rows = []
    for _ in range(n):
        text = ""
        for _ in range(rng.randint(0, 60)):
            text += rng.choice(words[: rng.choice([3, 8, 52])]) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " \r "])
        rows.append((rng.choice(["en", "fr", None, "und"]), text))
    return rows + [("en", None), ("en", ""), (None, " \t\n"), ("de", "solo"), ("en", "the the the the the the the the the the the the"), ("fr", "new york " * 300), ("en", "ice cream. " * 20)]


@pytest.mark.parametrize("how", [{}, {"size": 50, "held": 3}, {"word_parts": 4, "pair_parts": c.RANGES * 64}, {"pivot_part": 40}, {"least": 3, "top": 5, "size": 400, "pivot_part": 25}])
def test_equals_plain_counting(spark, monkeypatch, how):
    how = dict(how)
    monkeypatch.setattr(c, "HELD", how.pop("held", c.HELD))
    rows = corpus(1, 250)
    docs = spark.createDataFrame([(i, *r, *"xxxxxx") for i, r in enumerate(rows)], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in c.collocations(docs, **how).collect())
    assert got == plain(rows, how.get("least", 10), how.get("top", 2000))


def test_words_of_long_texts_are_whole(monkeypatch):
    monkeypatch.setattr(c, "SLICE", 7)
    text = b"One two, three\tfour.five  six\n\nseven " * 9
    flat = [w for part in c.words_of(text) for w in part]
    want = []
    for piece in re.split(rb"[.,;:!?\n-\r]", text.lower()):
        want += piece.split() + [b"\xff"]
    assert flat == want


def test_own_phrases_hold_the_leftmost_pivot():
    assert sorted(c.own_phrases([b"a", b"b", b"p", b"p", b"c"], b"p", 3)) == sorted([b"b p", b"p p", b"a b p", b"b p p", b"p p c"])


def test_exact_scores_pass_64_bits(spark):
    found = spark.createDataFrame([("en", "x y", 3_000_000_019)], "lang string, phrase string, a long")
    words = spark.createDataFrame([("en", "x", 4_000_000_007), ("en", "y", 5_000_000_029)], "lang string, phrase string, f long")
    row = c.scored(found, words).first()
    assert row.score == 1000000 * 3_000_000_019**2 // (4_000_000_007 * 5_000_000_029)


def test_empty(spark):
    assert not c.collocations(spark.createDataFrame([], SCHEMA)).collect()
