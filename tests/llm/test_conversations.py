"""Conversation repair against a search over all edit sequences, with fragments of two turns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

from fascicle.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string, n string, conv string, frag string"
STRIP = " \t\n\x0b\f\r"


def cheapest(rows):
    """(cost, audit, lines) of the cheapest edits by trying them all; rows (role, text, fault)."""
    best = None

    def go(i, cost, audit, roles, lines):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows):
            for tail in ([], [("user", "")], [("assistant", "")], [("user", ""), ("assistant", "")]):
                final = "".join(roles) + "".join(r[0] for r, _ in tail)
                if re.fullmatch("(s?(ua)+)?", final):
                    found = (cost + 3 * len(tail), audit + "I" * len(tail), lines + [f"{r}:{t}" for r, t in tail])
                    if best is None or found[:2] < best[:2]:
                        best = found
            return
        role, text, fault = rows[i]
        for ins in ([], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]):
            r2, l2, c2, a2 = roles + [r[0] for r in ins], lines + [f"{r}:" for r in ins], cost + 3 * len(ins), audit + "I" * len(ins)
            go(i + 1, c2 + 4, a2 + "D", r2, l2)
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            go(i + 1, c2 + more, a2 + "K", r2 + [role[:1] or "x"], l2 + [f"{role}:{text}"])
            for to in ("user", "assistant"):
                go(i + 1, c2 + 3 + more, a2 + "R", r2 + [to[0]], l2 + [f"{to}:{text}"])

    go(0, 0, "", [], [])
    return best


def brute(rows, damage):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        s = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20 if damage else 19
        convs[conv]
        role, text = s(role), s(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        seen, faults, illegal = set(), [], 0
        for i, (_, role, text) in enumerate(turns):
            body = text.rstrip(STRIP)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
            illegal += i > 0 and turns[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        numbers = [t for t, _, _ in turns if t is not None]
        cost, audit, lines = cheapest([(r, t, f) for (_, r, t), f in zip(turns, faults)])
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA).repartition(3)


def made(seed, convs):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn + 1, None]), role, rng.choice(["Yes.", "No!", "Why?", "so", " \t", "", None, "Well. ", "fin"])))
    return rows


def told(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_report_equals_the_search(spark):
    rows = made(1, 60)
    turns = c.turns_of(table(spark, rows))
    for size in (2, 512):  # fragments of two turns chain; both give the same
        assert told(c.report(turns, size)) == brute(rows, False)


def test_damage(spark):
    rows = made(2, 80) + [(None, None, "user", "Hi."), (999, 5, None, None)]
    dropped = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    rows.append((dropped, 1, "user", "gone."))
    got = told(c.report(c.damage(c.turns_of(table(spark, rows)))))
    assert got == brute(rows, True)
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_trie_answers_equal_single_ones():
    signatures = sorted({"".join(p) for n in range(5) for p in product("duaSx", repeat=n)})
    together = dict(c.trie_answers(signatures, (0, 1, 2, 3)))
    for s in signatures[::7]:
        assert together[s] == next(c.trie_answers([s], (0, 1, 2, 3)))[1]


def test_copies_and_long_conversations(spark):
    """A turn repeated 5,000 times is one row, and a long conversation passes in fragments."""
    many = [(7, 1, "user", "Hi.")] * 5000 + [(7, 2, "assistant", "Hello.")]
    long = [(8, i, ("user", "assistant")[i % 2], f"{i}.") for i in range(4001)]
    got = told(c.report(c.turns_of(table(spark, many + long))))
    assert got[7][2] == 4999 and got[7][5] == 4 * 4999 and got[7][6] == "K" + "D" * 4999 + "K"
    assert got[8][5:7] == (3, "K" * 4001 + "I")
    lines = [f"{('user', 'assistant')[i % 2]}:{i}." for i in range(4001)] + ["assistant:"]
    assert got[8][7] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    kept = c.repaired(c.turns_of(table(spark, long))).orderBy("place").collect()
    assert [f"{r.role}:{r.text}" for r in kept] == lines and kept[-1].edit == "I"


def test_empty(spark):
    assert not c.report(c.damage(c.turns_of(table(spark, made(3, 1)).limit(0)))).collect()
