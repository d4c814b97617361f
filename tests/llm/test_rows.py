"""Rows of one id: each is judged by its own text."""

import random
from collections import defaultdict

from fascicle.llm import substrings

rng = random.Random(9)


def fresh(n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(n))


def lost(spark, rows, **how):
    out = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **how).collect()
    return sorted(((r.doc_id is not None, r.doc_id or 0), r.n_words, r.n_removed, r.kept) for r in out)


def brute(rows, size):
    starts = defaultdict(set)
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - size + 1):
            starts[tuple(w[k : k + size])].add(i)
    out = []
    for i, t in rows:
        w = (t or "").split()
        gone = set()
        if i is not None:
            for k in range(len(w) - size + 1):
                if any(j is not None and j < i for j in starts[tuple(w[k : k + size])]):
                    gone.update(range(k, k + size))
        out.append(((i is not None, i or 0), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def test_texts_of_one_id_are_judged_apart(spark):
    a, b, c = fresh(60), fresh(60), fresh(70)
    rows = [(1, a), (2, a), (2, b)]
    assert sorted((i[1], n) for i, _, n, _ in lost(spark, rows)) == [(1, 0), (2, 0), (2, 60)]
    # A window that stands in the reference's id only, but in another of its texts.
    shared = fresh(55)
    rows = [(1, f"{shared} {b}"), (1, f"{shared} {c}"), (2, f"x {shared} {c} y"), (3, c), (None, a), (4, a), (4, a), (5, None), (6, "")]
    assert lost(spark, rows) == brute(rows, 50)


def test_references_in_parts(spark):
    long = fresh(400).split()
    rows = [(0, " ".join(long))] + [(i, " ".join(long[k : k + rng.randint(5, 90)]) + " " + fresh(3)) for i, k in enumerate(range(0, 390, 13), 1)]
    rows += [(50, " ".join(long[100:300])), (51, " ".join(long[:120] + long[200:]))]
    for reference in (10, 23, 64, 1 << 15):
        assert lost(spark, rows, size=8, reference=reference) == brute(rows, 8)


def test_exceptions_take_time_in_proportion():
    import time

    from fascicle.llm import toxicity

    lexicon = toxicity.Lexicon({" trash ": 1.0, " tra": 0.5, " can ": 0.2})
    plain = lambda hits, void: [h for h in hits if not any(lo <= h[0] < hi for lo, hi in void)]
    phrase = next(e for e in toxicity.EXCEPTIONS)
    folded = toxicity.fold(f"trash {phrase} can {phrase} {phrase} trash")
    void = [(i, i + len(phrase) + 1) for i in range(len(folded)) if folded.startswith(f" {phrase} ", i)]
    free = toxicity.Lexicon(lexicon.weights, exceptions=())
    assert sorted(lexicon.hits(folded)) == sorted(plain(free.hits(folded), void)) and void
    began = time.process_time()
    lexicon.score("trash can x " * 100_000)
    assert time.process_time() - began < 4


def test_context_on_both_sides(spark, monkeypatch):
    import re

    from pyspark.sql import functions as F

    from fascicle.llm import native, pii

    monkeypatch.setattr(native, "PIECE", 64)
    parts = ["123-45-6789", "987-65-4321", " ssn ", "é", "😀", " or ", "xssn", "-", "a@b.co", " Mail ", "lorem ipsum dolor sit amet ", "\n", "10.0.0.1", "social security"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(250)] + [None, "", "123-45-6789 (SSN)", "ssn" + "." * 38 + "123-45-6789", "ssn" + "." * 37 + " 123-45-6789"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = docs.select("doc_id", native.spans(F.coalesce("text", F.lit("")), r"[0-9]{3}", context=40).alias("s")).collect()
    for r in found:
        t = texts[r.doc_id] or ""
        assert [tuple(x) for x in r.s] == [(m.start(), m.end(), m[0], t[max(0, m.start() - 40) : m.start()], t[m.end() : m.end() + 40]) for m in re.finditer("[0-9]{3}", t)]
    scores = {r.doc_id: {(s.kind, s.lo): s.score for s in r.spans} for r in pii.find(docs).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        near = lambda m, words: any(re.search(rf"(?:^|[^a-z])(?:{words})", x.lower()) for x in (t[max(0, m.start() - 40) : m.start()], t[m.end() : m.end() + 40]))  # noqa: B023, E731
        want = {("ssn", m.start()): 0.8 for m in re.finditer(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", t) if near(m, "ssn|social security")}
        assert {k: v for k, v in scores[i].items() if k[0] == "ssn"} == want


def test_repositories_tell_copies_from_live_values(spark):
    from fascicle.llm import secrets

    live, template, spread = "Zx9kQ2mLp4Rt7Vb1Nc8Ws3Yd", "Qa1Ws2Ed3Rf4Tg5Yh6Uj7Ik8", "Mn1Bv2Cx3Za4Sd5Fg6Hj7Kl8"
    rows = [(1, f"k {live}", "acme/a"), (2, f"k {live}", "acme/b"), *[(10 + i, f"k {template}", f"acme/r{i}") for i in range(10)], *[(30 + i, f"token={spread}", f"o{i}/r") for i in range(3)], (40, "token=abcdefghijkl", None)]
    out = {r.doc_id: [(s.kind, s["class"], s.repos, s.owners) for s in r.spans] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[1] == out[2] == [("live", "live", 2, 1)]
    assert all(out[10 + i] == [] for i in range(10))  # one owner's template in ten repositories: no live token
    assert all(out[30 + i] == [("assign", "copied", 3, 3)] for i in range(3)) and out[40] == [("assign", "unclear", 1, 1)]


def test_ibans_in_groups(spark):
    from fascicle.llm import pii

    texts = ["DE89 3704 0044 0532 0130 00", "xx DE89 3704 0044 0532 0130 00 is, GB82 WEST 1234 5698 7654 32.", "DE89 3704 0044 0532 0130 01", "é DE89370400440532013000 NO93 8601 1117 947", "aDE89 3704 0044 0532 0130 00", "DE89  3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 00IS"]
    found = {r.doc_id: [(s.kind, s.lo, s.hi) for s in r.spans if s.kind == "iban"] for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found == {0: [("iban", 0, 27)], 1: [("iban", 3, 30), ("iban", 35, 62)], 2: [], 3: [("iban", 2, 24), ("iban", 25, 43)], 4: [], 5: [], 6: []}
