"""Methods and plans of the training-data operators: runs, repeats, long texts, decoding trees."""

import time

from pyspark.sql import functions as F

from fascicle.llm import line_dedup

from test_operators import docs_of, rows


def test_settled_lines_leave_the_runs(spark):
    store = line_dedup.LineRuns(spark, fanout=2, buckets=2, settle_at=3)
    keys = lambda *x: spark.createDataFrame([(a, a) for a in x], "h1 long, h2 long")
    for part in ((1, 1, 1, 2), (1, 2, 3), (1, 2, 4), (1, 2, 4)):
        store.add(keys(*part))
    assert {r.h1 for r in store.frequent(3).collect()} == {1, 2}
    assert {r.h1: r.df for r in store.spark.table(store.settled[0]).collect()} == {1: 3}
    assert sorted(r.h1 for name in store.runs() for r in spark.table(name).collect()) == [3, 4]
    assert sorted(r.h1 for r in store.unseen(keys(1, 2, 3), store.settled).collect()) == [3]
    store.drop()


def test_lines_are_counted_by_document(spark):
    docs = docs_of(spark, ["once\nTwice"] * 12).withColumn("doc_id", F.when(F.col("doc_id") < 9, F.col("doc_id")).when(F.col("doc_id") < 11, F.lit(8)))
    assert [r.n_dropped for r in line_dedup.drop_frequent_lines(docs).collect()] == [0] * 12  # nine ids, and one row without
    out = line_dedup.drop_frequent_lines(docs, min_docs=9).collect()
    assert [(r.n_lines, r.n_dropped, r.text) for r in out] == [(2, 2, "")] * 12
    two = spark.createDataFrame([(i, "a\nb\na") for i in range(10)] + [(3, "x\na\ny\na"), (None, "a\nq"), (None, "z")], "doc_id long, text string")
    out = sorted((r.doc_id or -1, r.text) for r in line_dedup.drop_frequent_lines(two, counts=False).collect())
    assert out == sorted([(i or -1, "") for i in range(10)] + [(3, "x\ny"), (-1, "q"), (-1, "z")])


def test_line_dedup_takes_long_texts(spark):
    def seconds(n):
        docs = docs_of(spark, ["\n".join(f"line {j}" for j in range(n))] * 10 + ["\n".join(["a", "line 3", "b"])])
        began = time.time()
        out = rows(line_dedup.drop_frequent_lines(docs))
        assert out[0].n_dropped == n and out[10].text == "a\nb"
        return time.time() - began

    seconds(10)
    assert seconds(32_000) < 20 * max(1.0, seconds(2_000))


def test_decoding_tree(spark):
    import public_tokenizers

    from fascicle.llm import bpe

    codec = bpe.Codec(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, leaf_chars=3)
    for text in ("", "a", "héllo wörld " * 50, "x" * 1000):
        assert codec.decode(codec.encode(text).tolist()) == text.encode()


def plain_simhash(text):
    import re

    import xxhash

    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), seed=42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def test_simhash_bits(spark):
    from fascicle.llm import simhash

    texts = ["", None, "One", "one two", "One TWO three", "É x\u0085y \xa0 z Q", "tie " * 700, " ".join(f"w{i * i % 97}" for i in range(500)), "a b c d a b c d"]
    out = rows(simhash.near_duplicates(docs_of(spark, texts)))
    assert [out[i].fp & (2**64 - 1) for i in range(len(texts))] == [plain_simhash(t) for t in texts]


def segmentations(text, pieces):
    """All ways to cut a text into pieces, or single characters that are none (piece id len(pieces))."""
    if not text:
        yield []
    for j in range(1, len(text) + 1):
        part = text[:j]
        if part in pieces or j == 1:
            for rest in segmentations(text[j:], pieces):
                yield [pieces.get(part, len(pieces)), *rest]


def test_language_probabilities_and_counts_by_enumeration():
    import math
    import random
    from collections import defaultdict

    import numpy as np
    import pytest

    from fascicle.llm import language

    r = random.Random(5)
    names = ["▁", "a", "b", "ab", "ba", "aba", "▁a", "▁ab", "bb"]
    ids = {p: i for i, p in enumerate(names)}
    probs = np.array([[r.random() for _ in range(2)] for _ in range(len(names) + 1)])
    probs /= probs.sum(0)
    model = language.Model(["x", "y"], names, probs)
    scorer = model.scorer()
    words = ["".join(r.choice("abc") for _ in range(n)) for n in (1, 2, 3, 5, 8) for _ in range(5)]
    scorer._learn(set(words))
    for w in words:
        cuts = list(segmentations(language.START + w, ids))
        for l in range(2):
            weights = [math.prod(probs[k, l] for k in cut) for cut in cuts]
            assert scorer.logs[scorer.at[w], l] == pytest.approx(math.log(sum(weights)))
            wanted, counts = defaultdict(float), defaultdict(float)
            for cut, weight in zip(cuts, weights):
                for k in cut:
                    wanted[k] += 3 * weight / sum(weights)
            scorer.lattice.expected(w, probs[:, l].tolist(), 3, counts)
            assert dict(counts) == pytest.approx(dict(wanted))


def test_language_forward_passes_agree():
    import random

    import numpy as np
    import pytest

    from fascicle.llm import language

    r = random.Random(6)
    names = sorted({"".join(r.choice("abcd") for _ in range(r.randint(1, 4))) for _ in range(60)} | {"▁"})
    probs = np.array([[r.random() ** 8 + 1e-9 for _ in range(3)] for _ in range(len(names) + 1)])
    probs /= probs.sum(0)
    scorer = language.Model(["x", "y", "z"], names, probs).scorer()
    for n in (1, 2, 7, 20, 39, 40):
        group = ["".join(r.choice("abcdé") for _ in range(n)) for _ in range(6)]
        together = scorer._forward(group, n + 1)
        for i, w in enumerate(group):
            assert together[i].tolist() == pytest.approx(scorer.lattice.forward(w, scorer.rows, 3))
    long = "abé" * 2000  # its probability is far below the least float
    assert all(x < -2000 for x in scorer.lattice.forward(long, scorer.rows, 3))


def plain_hits(folded, lexicon):
    """Hits by looking for every entry at every place."""
    void = [(i, i + len(e) + 2) for e in lexicon.exceptions for i in range(len(folded)) if folded.startswith(f" {e} ", i)]
    out = {}
    for i in range(len(folded)):
        for k, w in lexicon.weights.items():
            if folded.startswith(k, i) and (i not in out or out[i] < w):
                out[i] = w
    return {i: w for i, w in out.items() if not any(lo <= i < hi - 1 for lo, hi in void)}


def test_toxicity_scores_by_a_plain_matcher(spark):
    import math
    import random

    from fascicle.llm import toxicity

    r = random.Random(7)
    lexicon = toxicity.Lexicon({" trash ": 3.0, " id": 1.5, " idiot ": 6.0, " clown ": 2.0, " worthless ": 4.25, " " + "q" * 60 + " ": 9.0}, coefficients=(-3.0, 1.5, 0.75))
    parts = ["trash", "TRASH", "trash can", "take out the trash", "1diot", "іdiot", "ideas", "clown fish", "cl0wn", "w0rth1ess", "worthless!", "fish", "can", "q" * 60, "é", ",", "-"]
    texts = [None, "", *[" ".join(r.choice(parts) for _ in range(r.randint(1, 30))) for _ in range(300)]]
    out = rows(toxicity.score(docs_of(spark, texts), lexicon, into="tox").select("doc_id", "tox"))
    for i, t in enumerate(texts):
        folded = toxicity.fold(t)
        total, words = sum(plain_hits(folded, lexicon).values()), max(1, len(folded.split()))
        x = -3.0 + 1.5 * math.log1p(total) + 0.75 * math.log1p(1000 * total / words)
        assert out[i].tox == round(1 / (1 + math.exp(-x)), 6)
    assert toxicity.fold("Q" * 60 + " І am a TRАSH-c4n!") == " " + "q" * 60 + " i am a trash can "


def test_long_words_become_entries():
    from fascicle.llm import toxicity

    assert f" {'z' * 50} " in toxicity._candidates(f" {'z' * 50} a ")


def test_entries_are_chosen_as_by_counting_all():
    import random

    from fascicle.llm import toxicity

    r = random.Random(8)
    where = {f"e{i}": {r.randrange(80) for _ in range(r.randint(1, 30))} for i in range(60)}
    weights = {k: float(r.randint(1, 3)) for k in where}
    covered, left, wanted = {1, 2, 3}, dict(where), []
    while left:
        k = max(left, key=lambda e: (len(left[e] - covered), weights[e], e))
        new = left.pop(k) - covered
        if len(new) < 3:
            break
        wanted.append(k)
        covered = covered | new
    assert toxicity.explaining(where, {1, 2, 3}, 3, weights) == wanted


def plain_chunks(data):
    """Chunks by a gear hash rolled byte by byte, tested at every byte."""
    from fascicle.llm import fingerprint as f

    out, at = [], 0
    h = 0
    ends = []
    for b in data:
        h = (h << 1) + int(f.GEAR[b]) & 0xFFFFFFFF
        ends.append(h)
    # Only the last WINDOW bytes count: older ones are taken out again.
    for i in range(len(data)):
        h = 0
        for j in range(max(0, i - f.WINDOW + 1), i + 1):
            h = (h << 1) + int(f.GEAR[data[j]]) & 0xFFFFFFFF
        ends[i] = h
    for i, h in enumerate(ends):
        size = i + 1 - at
        if size < f.LEAST:
            continue
        bits = f.STRICT if size <= f.NORMAL else f.LOOSE
        if h >> (32 - bits) == 0 or size == f.MOST:
            out.append(data[at : i + 1])
            at = i + 1
    return out + ([data[at:]] if at < len(data) else [])


def test_chunks_and_likeness_byte_by_byte(spark):
    import base64
    import random

    import xxhash

    from fascicle.llm import fingerprint as f

    r = random.Random(9)
    words = ["".join(r.choice("abcdefgé ") for _ in range(r.randint(2, 9))) for _ in range(300)]
    texts = [None, "", "a", "x" * 700, *[" ".join(r.choice(words) for _ in range(r.randint(5, 400))) for _ in range(25)]]
    texts += [texts[-1] + " tail", "head " + texts[-2]]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    out = rows(f.with_successors(docs_of(spark, texts), f._edited, schema, ranges=3))
    code = lambda c: (xxhash.xxh3_64_intdigest(c) % (1 << 48)) << 16 | len(c)
    prints = lambda t: {code(c) for c in plain_chunks(t.encode())}
    text_of = lambda s: base64.b64encode(b"".join(x.to_bytes(8, "big") for x in sorted(s))).decode()

    def like(a, b):
        size = lambda s: sum(x & 0xFFFF for x in s)
        return round(size(a & b) / size(a), 6) if a else float(not b)

    plain = [t or "" for t in texts]
    for i, t in enumerate(plain):
        m = len(t) // 3
        own, edited, after = prints(t), prints(t[: len(t) - m] + plain[i - 1][:m]), prints(plain[i - 1])
        assert (out[i].fingerprint, out[i].edited_fingerprint) == (text_of(own), text_of(edited))
        assert (out[i].near_edited, out[i].near_next) == (like(own, edited), like(own, after))


def test_successors_of_a_hot_id(spark):
    from fascicle.llm import fingerprint as f

    docs = spark.createDataFrame([(None if i % 2 else i, f"text {i}") for i in range(200)], "doc_id long, text string")
    edges = f.bounds(docs.select(F.coalesce("doc_id", F.lit(f.NO_ID)).alias("key")), 8)
    assert sum(1 for k, _ in edges if k == -f.NO_ID) >= 4
    pairs = f.with_successors(docs, lambda i, t, n, s: {"t": t, "n": n}, "t string, n string", ranges=8).collect()
    after = {r.t: r.n for r in pairs}
    seen, at = [], "text 198"
    for _ in range(200):
        seen.append(at)
        at = after[at]
    assert at == "text 198" and len(set(seen)) == 200 and seen[:100] == [f"text {i}" for i in range(198, -1, -2)]


def test_pipeline_stages_by_brute_force(spark, tmp_path):
    """Each stage's rows against a plain version on the same input, with clashing columns."""
    import random
    import re
    from collections import defaultdict

    import corpus_pipeline
    from test_operators import five_word_sets

    r = random.Random(10)
    new = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(n))
    item = new(14)
    texts = [new(80) + "\nThe same line" + ("\nown " + new(9) if i % 2 else "") for i in range(24)]
    texts += [texts[3], texts[4] + " tail", texts[5].replace(" ", "  "), new(30) + " " + item, item, "123", None, "", texts[2].upper()]
    docs_of(spark, texts).drop("spans").withColumn("n_dropped", F.lit("own")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "bpe" or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        steps[name] = rows(docs)
    assert sorted(steps["language_id"]) == [i for i, t in enumerate(texts) if t and re.search("[a-z]", t.lower())]
    seen = defaultdict(set)
    for i in steps["language_id"]:
        for line in texts[i].split("\n"):
            seen[line.strip().lower()].add(i)
    kept = {i: "\n".join(x for x in texts[i].split("\n") if len(seen[x.strip().lower()]) < 10) for i in steps["language_id"]}
    assert {i: (x.text, x.n_chars, x.n_dropped, x.n_lines) for i, x in steps["line_dedup"].items()} == {i: (t, len(t), "own", "x") for i, t in kept.items()}
    ids = sorted(kept)
    sets = dict(zip(ids, five_word_sets([kept[i] for i in ids])))
    least = {i: min(j for j in ids if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for i in ids}  # copies of one original each
    assert sorted(steps["near_dedup"]) == sorted(set(least.values()))
    assert sorted(steps["decontaminate"]) == [i for i in sorted(steps["near_dedup"]) if item not in kept[i]]
    assert sorted(steps["bpe"]) == sorted(steps["decontaminate"])


def test_components_of_paths_stars_and_random_edges(spark):
    import numpy as np

    from fascicle.llm.common import components

    pick = np.random.default_rng(5)
    edges = [(i + 1, i) for i in range(30)] + [(100 + i, 200) for i in range(20)] + [(7, 7), (300, 301), (301, 300)]
    edges += [(int(a), int(b)) for a, b in pick.integers(1000, 1080, (50, 2))]
    least = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in least:
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    found = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted(map(tuple, found)) == sorted(least.items())
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
