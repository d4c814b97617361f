"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Patterns propose candidates of three kinds (assign, access, hex) and one of long mixed tokens.
Every candidate value is hashed; over the whole corpus a hash is counted by distinct
repositories and distinct owners (a repository's name up to its first slash). A value that at
least ``copied`` owners or ``copied_repos`` repositories hold, even of one owner, is a copied
example; a value of a single owner in fewer repositories that looks live (letters and digits, at
least ``live_chars`` characters, no placeholder word) is a live-looking credential. Tokens that no base span covers are added as kind ``live`` if they are; base spans
stay whatever their class, which ``classes`` tells.

Defined results: null and empty texts have no spans; a null repository counts as one of its
own; rows may repeat and each has its own spans; null ids stay; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fascicle.llm.common import attach, written
from fascicle.llm.native import joined, spans
from fascicle.llm.pii import count, sql_spans

KEYWORDS = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
ASSIGN = KEYWORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+"
BASE = ("assign", "access", "hex")
COPIED, COPIED_REPOS, LIVE_CHARS = 3, 10, 24
PLACEHOLDER = "(?i)example|sample|dummy|your|xxxx|changeme|placeholder|test"


def _live(value: Column, chars: int) -> Column:
    return (F.length(value) >= chars) & value.rlike("[A-Za-z]") & value.rlike("[0-9]") & ~value.rlike(PLACEHOLDER)


def candidates(docs: DataFrame, repo_col: str = "source", id_col: str = "doc_id", text_col: str = "text", live_chars: int = LIVE_CHARS) -> DataFrame:
    """(id, repo, owner, found array<struct<kind,rank,lo,hi,value>>): base spans, then tokens outside them."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(repo_col).cast("string").alias("repo"),
        spans(text, ASSIGN, (2,)).alias("assign"), spans(text, ACCESS).alias("access"), spans(text, HEX).alias("hex"), spans(text, TOKEN).alias("token"),
    )
    rows = rows.withColumn("owner", F.coalesce(F.split_part("repo", F.lit("/"), F.lit(1)), F.lit(""))).withColumn("repo", F.coalesce("repo", F.lit("")))
    shape = lambda c, kind, rank, value: F.transform(c, lambda r: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), r["lo"].alias("lo"), r["hi"].alias("hi"), r[value].alias("value")))
    base = F.concat(shape(F.filter("assign", lambda r: F.length(r["g2"]) >= 12), "assign", 0, "g2"), shape(F.col("access"), "access", 1, "m"), shape(F.col("hex"), "hex", 2, "m"))
    rows = rows.select("id", "repo", "owner", base.alias("base"), "token")
    tokens = F.filter("token", lambda t: _live(t["m"], live_chars) & ~F.exists("base", lambda b: (b["lo"] < t["hi"]) & (t["lo"] < b["hi"])))
    return rows.select("id", "repo", "owner", F.concat("base", shape(tokens, "live", 3, "m")).alias("found"))


def scan(docs: DataFrame, copied: int = COPIED, copied_repos: int = COPIED_REPOS, live_chars: int = LIVE_CHARS, repo_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind,rank,lo,hi,repos,owners,class>>) for every row, by start, then kind."""
    rows = written(candidates(docs, repo_col, id_col, text_col, live_chars).withColumn("row", F.monotonically_increasing_id()), "secret-candidates")
    each = rows.where(F.size("found") > 0).select("row", "repo", "owner", F.explode("found").alias("f"))
    each = each.select("row", "repo", "owner", "f.kind", "f.rank", "f.lo", "f.hi", F.sha2("f.value", 256).alias("hash"), _live(F.col("f.value"), live_chars).alias("looks"))
    by_repo = each.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    owners = written(by_owner.groupBy("hash").agg(F.sum("repos").alias("repos"), F.count("*").alias("owners"), F.sum("n").alias("n")), "secret-owners")
    total = owners.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    told = attach(each, owners, ["hash"], "n", total)
    kind = F.when((F.col("owners") >= copied) | (F.col("repos") >= copied_repos), "copied").when((F.col("owners") == 1) & F.col("looks"), "live").otherwise("unclear")
    told = told.withColumn("class", kind).where((F.col("kind") != "live") | (F.col("class") == "live"))
    grouped = told.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("lo", "rank", "hi", "kind", "repos", "owners", "class"))).alias("spans"))
    shape = F.transform(F.coalesce("spans", F.array().cast(grouped.schema["spans"].dataType)), lambda r: F.struct(*[r[c].alias(c) for c in ("kind", "rank", "lo", "hi", "repos", "owners", "class")]))
    return rows.select("row", "id").join(grouped, "row", "left").select(F.col("id").alias(id_col), shape.alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda r: r["kind"].isin(*BASE))
    counts = [count(k).alias(f"n_{k}") for k in BASE]
    classes = F.array_join(F.transform("spans", lambda r: r["class"]), ",")
    return found.select("doc_id", *counts, F.sha2(joined(base, "lo", "rank").cast("binary"), 256).alias("base_sha256"), joined(F.col("spans"), "lo", "rank").alias("spans"), classes.alias("classes"))


_LIVE = "length(v) >= 24 AND regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]') AND NOT regexp_matches(v, '(?i)example|sample|dummy|your|xxxx|changeme|placeholder|test')"

SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (
SELECT doc_id, kind, rank, lo, hi, v FROM ({sql_spans('assign', 0, ASSIGN.replace(chr(92) + 'x20', ' '), "length(v) >= 12", more=", vs[i] AS v")})
UNION ALL SELECT doc_id, kind, rank, lo, hi, m AS v FROM ({sql_spans('access', 1, 'AKIA[A-Z0-9]+', "length(m) >= 18")})
UNION ALL SELECT doc_id, kind, rank, lo, hi, m AS v FROM ({sql_spans('hex', 2, '[0-9a-f]+', "length(m) >= 16")})),
k AS (SELECT doc_id, kind, rank, lo, hi, m AS v FROM ({sql_spans('live', 3, '[A-Za-z0-9+/_-]+', "length(m) >= 24")})),
c AS (SELECT * FROM b UNION ALL SELECT * FROM k WHERE {_LIVE} AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = k.doc_id AND b.lo < k.hi AND k.lo < b.hi)),
o AS (SELECT v, count(DISTINCT split_part(coalesce(source, ''), '/', 1)) AS owners, count(DISTINCT coalesce(source, '')) AS repos FROM c JOIN documents USING (doc_id) GROUP BY v),
s AS (SELECT c.*, CASE WHEN owners >= {COPIED} OR repos >= {COPIED_REPOS} THEN 'copied' WHEN owners = 1 AND {_LIVE} THEN 'live' ELSE 'unclear' END AS class FROM c JOIN o USING (v)),
f AS (SELECT * FROM s WHERE kind <> 'live' OR class = 'live')
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || lo || ':' || hi, ',' ORDER BY lo, rank) FILTER (WHERE rank < 3), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || lo || ':' || hi, ',' ORDER BY lo, rank) FILTER (WHERE kind IS NOT NULL), '') AS spans,
  coalesce(string_agg(class, ',' ORDER BY lo, rank) FILTER (WHERE kind IS NOT NULL), '') AS classes
FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id
"""
