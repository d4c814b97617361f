"""PII by proposed spans, checksum validators and context words, in DataFrame functions only.

Regular expressions propose spans of six kinds: email, ip, card, phone, iban, ssn. Validators
confirm them: parts of an ip are at most 255, a card has 16 to 19 digits and passes Luhn, a
phone has 8 to 15 digits, an iban passes mod-97. A span's score starts from its kind, rises
with a checksum and with a context word within CONTEXT characters before or after it, and stays
in 0 to 1. An iban is one run of letters and digits or stands in its printed groups of four; a
word of capitals right after the groups that could be one more is taken for one. The first four kinds are always kept once valid; iban and ssn are added from ``least`` on, which
an iban reaches by its checksum and an ssn by its context only.

Defined results: null and empty texts have no spans; rows may repeat; null ids stay; spans of
different kinds may overlap; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fascicle.llm.native import joined, spans

_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: In one run, or printed: groups of four, the last of up to three.
IBAN = "[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)"
#: kind -> (pattern; a run's later starts are skipped where they can't match; score; context words)
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.8, "mail|contact|write"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", 0.6, "ip|host|server|address"),
    "card": (r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++", 0.5, "card|visa|credit|payment"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, "phone|call|tel|mobile"),
    "iban": (r"(?<![A-Za-z0-9_])" + IBAN + "(?![A-Za-z0-9_])", 0.5, "iban|account|bank"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.5, "ssn|social security"),
}
BASE = ("email", "ip", "card", "phone")
LEAST = 0.8
#: Characters on either side of a span that its context words are looked for in.
CONTEXT = 40


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def mod97(text: Column) -> Column:
    """The mod-97 remainder of an IBAN: its first four characters moved to the end, letters as 10 to 35."""
    chars = F.filter(F.split(F.concat(F.substring(text, 5, 64), F.substring(text, 1, 4)), ""), lambda c: c != "")
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(chars, F.lit(0), step)


def _valid(kind: str, m: Column) -> Column:
    n = F.length(digits(m))
    if kind == "ip":
        return m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.when(n.between(16, 19), F.call_function("luhn_check", digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    if kind == "iban":
        return mod97(F.replace(m, F.lit(" "), F.lit(""))) == 1
    return F.lit(True)


def find(docs: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind,rank,lo,hi,score>>): all spans of every row, by kind, then start."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    proposed = docs.select(F.col(id_col), *[spans(text, p, context=CONTEXT).alias(f"__{k}") for k, (p, _, _) in KINDS.items()])
    parts = [_scored(rank, kind, least) for rank, kind in enumerate(KINDS)]
    return proposed.select(id_col, F.flatten(F.array(*parts)).alias("spans"))


def _start(kind: str, score: float) -> int:
    """Hundredths of a confirmed span's score without its context."""
    return round(100 * score) + (40 if kind in ("card", "iban") else 0)


def _scored(rank: int, kind: str, least: float) -> Column:
    """A kind's confirmed spans with their scores."""
    _, start, words = KINDS[kind]
    word = rf"(?:^|[^a-z])(?:{words})"
    near = lambda r: F.lower(r["before"]).rlike(word) | F.lower(r["after"]).rlike(word)
    score = lambda r: F.least(F.lit(100), F.lit(_start(kind, start)) + F.when(near(r), 30).otherwise(0)) / 100
    shape = lambda r: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), r["lo"].alias("lo"), r["hi"].alias("hi"), score(r).alias("score"))
    made = F.transform(F.filter(f"__{kind}", lambda r: _valid(kind, r["m"])), shape)
    return made if kind in BASE else F.filter(made, lambda r: r["score"] >= least)


def count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda r: r["kind"] == kind)).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda r: r["kind"].isin(*BASE))
    counts = [count(k).alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base, "rank", "lo").cast("binary"), 256).alias("base_sha256"), joined(F.col("spans"), "rank", "lo").alias("spans"), F.array_join(F.transform("spans", lambda r: F.round(r["score"] * 100).cast("int").cast("string")), ",").alias("scores"))


def sql_spans(kind: str, rank: int, pattern: str, where: str, source: str = "d", more: str = "") -> str:
    """SQL for rows (doc_id, kind, rank, lo, hi, m, before, after) of a pattern's matches for which ``where`` holds."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, lo, lo + length(m) AS hi, m, substr(t, greatest(lo - {CONTEXT}, 0) + 1, least(lo, {CONTEXT})) AS before, substr(t, lo + length(m) + 1, {CONTEXT}) AS after{more and ', v'} FROM (
  SELECT doc_id, t, ms[i] AS m, (list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS lo{more}
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, t, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS ps{', ' + f"regexp_extract_all(t, '{p}', 2) AS vs" if more else ''} FROM {source}))) WHERE {where}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN substr(reverse({_DIGITS}), j, 1)::INT ELSE (2 * substr(reverse({_DIGITS}), j, 1)::INT) % 10 + (2 * substr(reverse({_DIGITS}), j, 1)::INT) // 10 END)) % 10 = 0"
_IBAN = "list_reduce(list_prepend(0, list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(m, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, v: CASE WHEN v < 10 THEN (a * 10 + v) % 97 ELSE (a * 100 + v) % 97 END) = 1"
_NEAR = " ".join(f"WHEN '{kind}' THEN {_start(kind, start)} + CASE WHEN regexp_matches(lower(before), '(?:^|[^a-z])(?:{words})') OR regexp_matches(lower(after), '(?:^|[^a-z])(?:{words})') THEN 30 ELSE 0 END" for kind, (_, start, words) in KINDS.items())

SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (
{sql_spans('email', 0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+', 'true')}
UNION ALL {sql_spans('ip', 1, '[0-9]+(?:[.][0-9]+)(?:[.][0-9]+)(?:[.][0-9]+)', f"regexp_full_match(m, '{_BYTE}(?:[.]{_BYTE}){{3}}')")}
UNION ALL {sql_spans('card', 2, '[0-9](?:[ -]?[0-9])+', f"CASE WHEN length({_DIGITS}) BETWEEN 16 AND 19 THEN {_LUHN} ELSE false END")}
UNION ALL {sql_spans('phone', 3, '[+][0-9][ ().0-9-]+[0-9]', f"length({_DIGITS}) BETWEEN 8 AND 15")}
UNION ALL {sql_spans('iban', 4, chr(92) + 'b' + IBAN + chr(92) + 'b', _IBAN)}
UNION ALL {sql_spans('ssn', 5, '[0-9-]+', "regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}')")}),
s AS (SELECT *, least(100, CASE kind {_NEAR} END) AS score FROM p),
k AS (SELECT * FROM s WHERE rank < 4 OR score >= {round(100 * LEAST)})
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip, count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone,
  sha256(coalesce(string_agg(kind || ':' || lo || ':' || hi, ',' ORDER BY rank, lo) FILTER (WHERE rank < 4), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || lo || ':' || hi, ',' ORDER BY rank, lo) FILTER (WHERE kind IS NOT NULL), '') AS spans,
  coalesce(string_agg(score::VARCHAR, ',' ORDER BY rank, lo) FILTER (WHERE kind IS NOT NULL), '') AS scores
FROM d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id
"""
