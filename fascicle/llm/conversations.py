"""Conversation repair by a dynamic program over a prefix trie of signatures.

A conversation's turns are to have the roles (s?(ua)+)?: perhaps one system turn, then user and
assistant by turns. A turn's symbol tells its role's initial and its fault; a conversation's
symbols in order are its signature. Edits keep a turn, give it the other role, delete it or
insert an empty one; the cheapest sequence of edits is found, the ASCII-least one of its letters
(K, R, D, I) on ties.

1. Turns that are alike (turn number, role and text) are counted, so that any number of copies
   is one row, and a turn whose role and text stand at an earlier number is a duplicate.
2. The rows are range-partitioned by conversation, number, role and text, so that a conversation
   of any length is dealt over many tasks. Each task cuts its rows into fragments of at most
   FRAGMENT turns; few conversations have more than one.
3. The fragments' distinct signatures are sorted and walked as a prefix trie: one layer of the
   dynamic program for each trie node, on a stack, shared by all signatures below it; each
   terminal node emits its answers. A layer holds for each of four states (nothing yet, after
   system, user, assistant) the least cost and the rank of its letters among the states'. Layers
   are normalised, so there are few different ones and a step is a look-up. A fragment that may
   lie inside a conversation is answered from every state it may begin in.
4. A conversation's fragments are chained through those answers, costs and ranks alone, and the
   chosen edits are applied to the turns in order, turn by turn.

Why ranks suffice: a layer's letters end with the edit of its last turn (insertions stand before
the next one), so no state's letters are a prefix of another's, and what follows can't change
their order.

Step 4 hashes a conversation's turns one after the other, so the turns of one conversation pass
through one task, as a stream: a digest of a whole text can't be taken in parts.

Defined results: null roles and texts are one space, and an empty role's initial is none of the
three; turns of one number stand in the order of role, then text; rows that repeat are
duplicates; a null conversation id is an id like others; a conversation without turns has an
empty repair; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fascicle.llm.common import attach, broadcast_if_small, slices, small_batches, written

STRIP = " \t\n\x0b\f\r"
FRAGMENT = 512
#: Bytes of a fragment's texts from which it is closed.
FRAGMENT_BYTES = 4 << 20
#: Costs of edits; an undeleted truncated turn adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Faults of a turn.
NONE, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3
#: The state after a turn of the role that must follow a state, and what is inserted at the end.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
TAIL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
LEGAL = ("su", "ua", "au")

Layer = tuple[tuple[int, int] | None, ...]


# The dynamic program


def edits(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what may be done with a turn: d must be deleted, capitals are truncated."""
    out = [("D", DELETE, state)]
    if symbol != "d":
        extra = TRUNCATED if symbol.isupper() else 0
        role, follows = symbol.lower(), NEXT[state]
        if role == "s" and state == START:
            out.append(("K", extra, SYSTEM))
        if role == ("u" if follows == USER else "a"):
            out.append(("K", extra, follows))
        out.append(("R", REROLE + extra, follows))
    return out


def ranked(best: dict[int, tuple]) -> tuple[int, Layer, tuple]:
    """(least cost, layer, way to each state) of state -> (cost, order of letters, way)."""
    least = min(v[0] for v in best.values())
    ranks = {state: i for i, state in enumerate(sorted(best, key=lambda q: best[q][1]))}
    return least, tuple((best[q][0] - least, ranks[q]) if q in best else None for q in range(4)), tuple(best[q][2] if q in best else None for q in range(4))


@cache
def step(layer: Layer, symbol: str) -> tuple[int, Layer, tuple]:
    """One layer further: (cost added, layer, for each state the state before and the letters)."""
    best: dict[int, tuple] = {}
    for before, held in enumerate(layer):
        if held is None:
            continue
        state, letters, cost = before, "", held[0]
        for _ in range(3):  # two insertions come back to the state or, at the start, to its like
            for letter, more, to in edits(symbol, state):
                found = (cost + more, (held[1], letters + letter), (before, letters + letter))
                if to not in best or found[:2] < best[to][:2]:
                    best[to] = found
            state, letters, cost = NEXT[state], letters + "I", cost + INSERT
    return ranked(best)


def first_layer(state: int) -> Layer:
    return tuple((0, 0) if q == state else None for q in range(4))


def trie_answers(signatures, starts: tuple[int, ...]):
    """For signatures in sorted order: (signature, [(start, end, cost, rank, letters)]).

    The stack holds the layers of the trie's current path; what two neighbours share stays.
    """
    path, stacks = "", [[(0, first_layer(s), None)] for s in starts]
    for signature in signatures:
        shared = 0
        for a, b in zip(path, signature):
            if a != b:
                break
            shared += 1
        answers = []
        for start, stack in zip(starts, stacks):
            del stack[shared + 1 :]
            for symbol in signature[shared:]:
                cost, layer, _ = stack[-1]
                more, layer, ways = step(layer, symbol)
                stack.append((cost + more, layer, ways))
            cost, layer, _ = stack[-1]
            for end, held in enumerate(layer):
                if held is not None:
                    letters, state = [], end
                    for _, _, ways in reversed(stack[1:]):
                        state, last = ways[state]
                        letters.append(last)
                    answers.append((start, end, cost + held[0], held[1], "".join(reversed(letters))))
        path = signature
        yield signature, answers


def chained(fragments: list[list[tuple[int, int, int, int]]]) -> tuple[int, list[tuple[int, int]]]:
    """The least cost over a conversation's fragments [(start, end, cost, rank)], insertions at the end included, and each fragment's (start, end)."""
    least, layer, ways = 0, first_layer(START), []
    for answers in fragments:
        best: dict[int, tuple] = {}
        for start, end, cost, rank in answers:
            if layer[start] is not None:
                found = (layer[start][0] + cost, (layer[start][1], rank), start)
                if end not in best or found[:2] < best[end][:2]:
                    best[end] = found
        more, layer, back = ranked(best)
        least += more
        ways.append(back)
    cost, _, state = min((held[0] + INSERT * len(TAIL[q]), held[1], q) for q, held in enumerate(layer) if held)
    chosen = []
    for back in reversed(ways):
        chosen.append((back[state], state))
        state = back[state]
    return least + cost, chosen[::-1]


# Faults and fragments


def initial(role: Column) -> Column:
    """The role's initial, or x where it is none of s, u, a."""
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("x")


def faults(turns: DataFrame) -> DataFrame:
    """(conv, turn, role, text, n, fault) of rows (conv, turn, role, text, n): alike rows once with their number.

    A row of n = 0 stands for no turn, only for its conversation. Of n copies the first has the
    fault; the others are duplicates, or blank as it is.
    """
    rows = turns.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))
    rows = written(rows.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "role", "text")}), "turns")
    real = rows.where("n > 0").select("conv", "turn", "h1", "h2")
    # Blank turns are blank whatever stood before them.
    firsts = real.groupBy("conv", "h1", "h2").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("m")).where("m > 1")
    firsts = written(firsts, "first-turns")  # so that adaptive execution can split the other side of the join
    again = real.alias("r").join(firsts.alias("f"), F.expr("r.conv <=> f.conv AND r.h1 = f.h1 AND r.h2 = f.h2")).where(~F.col("r.turn").eqNullSafe(F.col("f.first.turn")))
    again = written(again.select(*[F.col(f"r.{c}").alias(f"_{c}") for c in ("conv", "turn", "h1", "h2")]), "later-turns")  # a turn stands once in it
    held = rows.join(broadcast_if_small(again, 40), F.expr("conv <=> _conv AND turn <=> _turn AND h1 = _h1 AND h2 = _h2"), "left")
    body = F.rtrim(F.col("text"), F.lit(STRIP))
    fault = F.when(body == "", BLANK).when(F.col("_h1").isNotNull(), DUPLICATE).when(F.right(body, F.lit(1)).isin(".", "!", "?"), NONE).otherwise(CUT)
    return held.select("conv", "turn", "role", "text", "n", fault.alias("fault"), initial(F.col("role")).alias("initial"))


_FRAGMENT = "conv long, frag long, sig string, whole boolean, roles array<string>, texts array<string>, blank long, duplicate long, truncated long, illegal long, head string, foot string, least long, most long, first long, last long, numbers long"


class _Fragment:
    """What a fragment gathers; times of copies beyond the first are counted, not held."""

    def __init__(self, conv, first: bool):
        self.conv, self.opened, self.symbols, self.roles, self.texts = conv, first, [], [], []
        self.turns = self.bytes = 0
        self.counts, self.illegal, self.head, self.foot = [0, 0, 0, 0], 0, "", ""
        self.least = self.most = self.first = self.last = None
        self.numbers = 0

    def add(self, turn, role, text, n: int, fault: int, initial: str) -> None:
        if turn is not None and turn != self.last:
            self.numbers += 1
            if self.first is None:
                self.first = self.least = turn
            self.last = self.most = turn
        self.turns += n
        self.counts[fault] += 1
        self.counts[fault if fault == BLANK else DUPLICATE] += n - 1
        if self.foot:
            self.illegal += self.foot + initial not in LEGAL
        else:
            self.head = initial
        self.illegal += n - 1  # no role may follow itself
        self.foot = initial
        if fault in (BLANK, DUPLICATE):
            self.symbols.append("d" * n)
        else:
            self.symbols.append((initial.upper() if fault == CUT else initial) + "d" * (n - 1))
            self.roles.append(role)
            self.texts.append(text)
            self.bytes += len(text)

    def row(self, frag: int, closed: bool) -> tuple:
        return (self.conv, frag, "".join(self.symbols), self.opened and closed, self.roles, self.texts, self.counts[BLANK], self.counts[DUPLICATE], self.counts[CUT], self.illegal, self.head, self.foot, self.least, self.most, self.first, self.last, self.numbers)


def fragments(turns: DataFrame, size: int = FRAGMENT) -> DataFrame:
    """The fragments of faults(), of at most size turns each; ``whole`` tells one that surely is a whole conversation."""
    small_batches(turns.sparkSession)
    names = [c.split()[0] for c in _FRAGMENT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 5]

    def run(batches):
        from pyspark import TaskContext

        frag, now, begun = TaskContext.get().partitionId() << 40, None, False
        out: list[tuple] = []

        def batch():
            rows = list(zip(*out)) or [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)

        def close(closed: bool) -> None:
            nonlocal frag
            out.append(now.row(frag, closed))
            frag += 1

        for b in slices(batches):
            for conv, turn, role, text, n, fault, first in zip(*(b.column(i).to_pylist() for i in range(7))):
                if now is None or conv != now.conv:
                    if now is not None:
                        close(True)
                    now, begun = _Fragment(conv, begun), True  # a task's first conversation may have begun in the task before
                held = 0
                while n > held:  # n may pass what a fragment takes
                    room = size - now.turns
                    if room <= 0 or now.bytes >= FRAGMENT_BYTES:
                        close(False)
                        now = _Fragment(conv, False)
                        room = size
                    take = min(room, n - held)
                    now.add(turn, role, text, take, fault if not held or fault == BLANK else DUPLICATE, first)
                    held += take
            yield batch()
        if now is not None:
            close(False)
        yield batch()

    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv", "turn", "role", "text"]
    dealt = turns.select(*order, "n", "fault", "initial").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, _FRAGMENT)


# Answers of signatures and conversations


def answers(found: DataFrame) -> DataFrame:
    """(sig, whole, n, ways array<struct<start,end,cost,rank,letters>>) for each distinct signature, n times held."""
    sigs = written(found.groupBy("sig", "whole").agg(F.count("*").alias("n")), "signatures")
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    way = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32()), ("letters", pa.string())])

    def run(batches):
        rows = ((sig, whole, n) for b in slices(batches) for sig, whole, n in zip(*(b.column(i).to_pylist() for i in range(3))))
        kept, out = [], []

        def walk():  # sorted by whole, then signature: one trie each
            from itertools import groupby

            for whole, group in groupby(rows, key=lambda r: r[1]):
                counts = []
                signatures = (counts.append(n) or sig for sig, _, n in group)
                for sig, ways in trie_answers(signatures, (START,) if whole else (START, SYSTEM, USER, ASSISTANT)):
                    yield sig, whole, counts.pop(), ways

        for sig, whole, n, ways in walk():
            kept.append((sig, whole, n))
            out.append([dict(zip(("start", "end", "cost", "rank", "letters"), w)) for w in ways])
            if len(kept) == 256:
                yield batch(kept, out)
        yield batch(kept, out)

    def batch(kept, out):
        cols = list(zip(*kept)) or [()] * 3
        made = pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.int64()), pa.array(out, pa.list_(way))], names=["sig", "whole", "n", "ways"])
        kept.clear()
        out.clear()
        return made

    dealt = sigs.repartitionByRange(parts, "whole", "sig").sortWithinPartitions("whole", "sig")
    return written(dealt.mapInArrow(run, "sig string, whole boolean, n long, ways array<struct<start:int,end:int,cost:long,rank:int,letters:string>>"), "answers")


def chosen(found: DataFrame) -> DataFrame:
    """(conv, frag, letters, cost): each fragment's edits; a conversation's cost and last insertions stand with its last fragment."""
    table, total = answers(found), found.count()
    narrow = F.transform("ways", lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), w["cost"].alias("cost"), w["rank"].alias("rank")))
    costs = attach(found.select("conv", "frag", "sig", "whole"), table.select("sig", "whole", "n", narrow.alias("ways")), ["sig", "whole"], "n", total)
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names, kinds = ["conv", "frag", "sig", "whole", "start", "end", "cost"], [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int64()]

    def run(batches):
        out, conv, held = [], None, []

        def done():
            cost, ways = chained([h[3] for h in held])
            for i, ((frag, sig, whole, _), (start, end)) in enumerate(zip(held, ways)):
                out.append((conv, frag, sig, whole, start, end, cost if i == len(held) - 1 else None))

        for b in slices(batches):
            for c, frag, sig, whole, ways in zip(*(b.column(i).to_pylist() for i in range(5))):
                if held and c != conv:
                    done()
                    held = []
                conv = c
                held.append((frag, sig, whole, [(w["start"], w["end"], w["cost"], w["rank"]) for w in ways]))
            yield flush(out)
        if held:
            done()
        yield flush(out)

    def flush(out):
        cols = list(zip(*out)) or [()] * len(names)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    order = costs.select("conv", "frag", "sig", "whole", "ways").repartition(parts, "conv").sortWithinPartitions("conv", "frag")
    picked = written(order.mapInArrow(run, "conv long, frag long, sig string, whole boolean, start int, end int, cost long"), "chosen-ways")
    told = attach(picked, table, ["sig", "whole"], "n", total)
    way = F.element_at(F.filter("ways", lambda w: (w["start"] == F.col("start")) & (w["end"] == F.col("end"))), 1)
    tail = F.when(F.col("cost").isNull(), "").when(F.col("end") == SYSTEM, TAIL[SYSTEM]).when(F.col("end") == USER, TAIL[USER]).otherwise("")
    return told.select("conv", "frag", F.concat(way["letters"], tail).alias("letters"), "cost")


class Applied:
    """Applies letters to a conversation's turns in order: lines (edit, role, text) of what remains."""

    def __init__(self):
        self.state = START

    def lines(self, letters: str, sig: str, roles: list[str], texts: list[str]):
        symbols, held = iter(sig), iter(zip(roles, texts))
        for letter in letters:
            role, text = "", ""
            if letter != "I":
                symbol = next(symbols)
                if symbol != "d":
                    role, text = next(held)
                if letter == "D":
                    continue
            if letter == "K":
                self.state = SYSTEM if symbol in "sS" else NEXT[self.state]
            else:
                role, self.state = ("user", "assistant")[NEXT[self.state] == ASSISTANT], NEXT[self.state]
            yield letter, role, text


_OUT = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TURN = "conv long, edit string, role string, text string, place long"


def _applied(turns: DataFrame, size: int, whole_turns: bool) -> DataFrame:
    found = written(fragments(faults(turns), size), "fragments")
    letters = chosen(found)
    columns = [c.split()[0] for c in _FRAGMENT.split(", ") if c.split()[0] != "whole"]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = found.select(*columns, F.lit(None).cast("string").alias("letters"), F.lit(None).cast("long").alias("cost")).unionByName(letters, allowMissingColumns=True)
    # A fragment's edits come right before it.
    both = both.repartition(parts, "conv").sortWithinPartitions("conv", "frag", F.col("letters").isNull())
    at = {c: i for i, c in enumerate(both.columns)}
    schema = _TURN if whole_turns else _OUT
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in schema.split(", ")]

    def run(batches):
        out: list[tuple] = []
        now = None

        def batch():
            rows = list(zip(*out)) or [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)

        for b in slices(batches):
            for row in zip(*(b.column(i).to_pylist() for i in range(len(at)))):
                if row[at["letters"]] is not None:
                    edits, cost = row[at["letters"]], row[at["cost"]]
                    continue
                if now is None or now.conv != row[at["conv"]]:
                    if now is not None and not whole_turns:
                        out.append(now.row())
                    now = _Report(row[at["conv"]])
                for letter, role, text in now.take(edits, cost, {c: row[i] for c, i in at.items()}):
                    if whole_turns:
                        out.append((now.conv, letter, role, text, now.place))
                        if len(out) >= 4096:
                            yield batch()
            yield batch()
        if now is not None and not whole_turns:
            out.append(now.row())
        yield batch()

    return both.mapInArrow(run, schema)


class _Report:
    """A conversation's counts, edits and digest, gathered fragment by fragment."""

    def __init__(self, conv):
        self.conv, self.applied, self.digest, self.place = conv, Applied(), hashlib.sha256(), 0
        self.counts, self.cost, self.audit = [0, 0, 0, 0], 0, []
        self.foot, self.least, self.most, self.last, self.numbers = "", None, None, None, 0

    def take(self, letters: str, cost: int | None, f: dict):
        for i, c in enumerate(("blank", "duplicate", "truncated", "illegal")):
            self.counts[i] += f[c]
        if self.foot and f["head"]:
            self.counts[3] += self.foot + f["head"] not in LEGAL
        self.foot = f["foot"] or self.foot
        if f["first"] is not None:
            self.numbers += f["numbers"] - (f["first"] == self.last)
            self.least, self.most, self.last = f["least"] if self.least is None else self.least, f["most"], f["last"]
        self.audit.append(letters)
        self.cost = self.cost if cost is None else cost
        for letter, role, text in self.applied.lines(letters, f["sig"], f["roles"], f["texts"]):
            self.digest.update(f"{chr(10) if self.place else ''}{role}:{text}".encode())
            self.place += 1
            yield letter, role, text

    def row(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.numbers
        return (self.conv, gaps, *self.counts, self.cost, "".join(self.audit), self.digest.hexdigest())


def turns_of(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, n = 1) of a table of turns."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"), F.lit(1).cast("long").alias("n"))


def repaired(turns: DataFrame, size: int = FRAGMENT) -> DataFrame:
    """(conv, edit, role, text, place): the repaired turns of turns_of(), in order of place."""
    return _applied(turns, size, True)


def report(turns: DataFrame, size: int = FRAGMENT) -> DataFrame:
    """One row a conversation of turns_of(): gaps, counts of faults, cost, audit and the digest of the repaired turns."""
    return _applied(turns, size, False)


def damage(turns: DataFrame) -> DataFrame:
    """turns_of() damaged by crc32(conv:turn) % 20: 0 drops, 1 empties, 2 takes [.!?] out, 3 repeats, 4 makes it the user's."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", text("conv"), text("turn")).cast("binary")) % 20
    rows = turns.withColumn("kind", kind)
    gone = F.col("kind") == 0
    return rows.select(
        "conv",
        F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, "").when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(gone, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return report(damage(turns_of(rows))).withColumnRenamed("conv", "conv_id")


_STEP = "(VALUES (0, 0, '', 0, []::VARCHAR[]), (0, 2, 'I', 3, ['user:']), (0, 3, 'II', 6, ['user:', 'assistant:']), (1, 1, '', 0, []), (1, 2, 'I', 3, ['user:']), (1, 3, 'II', 6, ['user:', 'assistant:']), (2, 2, '', 0, []), (2, 3, 'I', 3, ['assistant:']), (3, 3, '', 0, []), (3, 2, 'I', 3, ['user:'])) i(q, q1, letters, icost, added)"
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, tab[((xor(c, b) & 255) + 1)::INT])), 4294967295)"

#: The same program, row by row over all conversations at once.
SQL = f"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
k AS (SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS kind FROM conversations, tab),
d AS (SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS n, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM d),
f AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY n) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv ORDER BY n) AS before FROM o),
dp AS (SELECT DISTINCT conv, 0::BIGINT AS n, 0 AS q, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM f
  UNION ALL (SELECT conv, n, q, cost, audit, lines FROM (
    SELECT dp.conv, f.n, e.to_q AS q, dp.cost + icost + CASE op WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN fault = 'truncated' AND op <> 'D' THEN 3 ELSE 0 END AS cost, audit || letters || op AS audit,
      list_concat(list_concat(dp.lines, added), CASE op WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [CASE e.to_q WHEN 3 THEN 'assistant:' ELSE 'user:' END || text] END) AS lines
    FROM dp JOIN f ON f.conv IS NOT DISTINCT FROM dp.conv AND f.n = dp.n + 1 JOIN {_STEP} ON i.q = dp.q
    JOIN (VALUES (0, 'D', 0, ''), (1, 'D', 1, ''), (2, 'D', 2, ''), (3, 'D', 3, ''), (0, 'K', 1, 's'), (0, 'K', 2, 'u'), (1, 'K', 2, 'u'), (3, 'K', 2, 'u'), (2, 'K', 3, 'a'), (0, 'R', 2, ''), (1, 'R', 2, ''), (3, 'R', 2, ''), (2, 'R', 3, '')) e(q1, op, to_q, needs) ON e.q1 = i.q1
    WHERE (op = 'D' OR fault NOT IN ('blank', 'duplicate')) AND (needs = '' OR needs = initial))
    QUALIFY row_number() OVER (PARTITION BY conv, q ORDER BY cost, audit) = 1)),
z AS (SELECT * FROM (SELECT dp.conv, cost + CASE q WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END AS cost, audit || CASE q WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit, list_concat(lines, CASE q WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END) AS lines
  FROM dp JOIN (SELECT conv, max(n) AS n FROM f GROUP BY conv) m ON m.conv IS NOT DISTINCT FROM dp.conv AND m.n = dp.n) QUALIFY row_number() OVER (PARTITION BY conv ORDER BY cost, audit) = 1),
g AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
  count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv IS NOT DISTINCT FROM c.conv_id
"""
