"""Driver queries: the operators on the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from fascicle import schema
from fascicle.functions import markdown
from fascicle.functions.keys import fingerprint, garbage_ratio, path_key
from fascicle.operators import cards, checkpoint, ledger, match, merge, prepare, provenance, quality, rewrite, scope, sync

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Most (document, item) rows of a part in the scored match, about.
PAIRS = 1 << 19
#: Distinct words of items, each item's counted, that the scored match broadcasts at once.
BLOCK_WORDS = 1 << 18
#: Bytes of items of few words that are tested against all documents.
SHORT_BYTES = 8 << 20

_KEY = r"[^\p{L}\p{N}_]"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_key(c):
    return F.regexp_replace(F.lower(c), _KEY, "")


@query(f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, regexp_replace(lower(line), '{_KEY}', '', 'g') AS fingerprint FROM l)
SELECT fingerprint, count(*) AS copies, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc, arg_min(line, doc_id * 1000000 + pos) AS line
FROM k WHERE fingerprint <> '' GROUP BY fingerprint
""")
def line_fingerprint_merge(spark, sf_dir):
    """Lines as blocks: one row a fingerprint, with the first line as its text."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.withColumn("fingerprint", plain_key(F.col("line"))).where("fingerprint <> ''")
    # Two levels: a very common line meets as one row for each document.
    each = keyed.groupBy("fingerprint", "doc_id").agg(F.count("*").alias("n"), F.min_by("line", "pos").alias("line"))
    return each.groupBy("fingerprint").agg(F.sum("n").alias("copies"), F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"), F.min_by("line", "doc_id").alias("line"))


@query(f"""
SELECT regexp_replace(lower(text), '{_KEY}', '', 'g') AS fingerprint, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1
""")
def doc_fingerprint_dedup(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(plain_key(F.col("text")).alias("fingerprint")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("""
SELECT arg_min(doc_id, doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY substr(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), 1, 40)
""")
def doc_first40_dedup(spark, sf_dir):
    head = F.substring(F.regexp_replace(F.lower("text"), "[^a-z0-9]", ""), 1, 40).alias("head")  # whole texts need not move
    return cards.first_wins(table(spark, sf_dir, "documents").select("doc_id", "source", head), "head", ["doc_id"]).select("doc_id", "source")


@query("""
SELECT sha256(text) AS digest, min(doc_id) AS first_doc, count(*) AS copies, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents GROUP BY 1 HAVING count(*) > 1
""")
def doc_dup_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return rows.where("copies > 1")


@query(r"""
WITH m AS (SELECT doc_id, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS chars,
  CASE WHEN length(text) = 0 THEN 1.0 ELSE (length(text) - length(regexp_replace(text, '[\x{fffd}\x00-\x08\x0b\x0e-\x1f]', '', 'g')))::DOUBLE / length(text) END AS garbage FROM documents)
SELECT doc_id, chars::BIGINT AS chars, garbage, CASE WHEN chars < 50 THEN 'fail' WHEN garbage > 0.02 THEN 'fail' WHEN chars < 200 THEN 'warning' ELSE 'pass' END AS status FROM m
""")
def doc_quality_ladder(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", quality.alnum_count(F.col("text")).cast("long").alias("chars"), garbage_ratio(F.col("text")).cast("double").alias("garbage"))
    return rows.withColumn("status", quality.text_status(F.col("chars"), F.col("garbage")))


_ALLOWED = ", ".join(f"'{w}'" for w in schema.JOINED_WORD_ALLOWLIST)


@query(rf"""
SELECT doc_id, regexp_matches(text, '{quality.BROKEN_SPACING}') AS broken_spacing,
  len(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_matches(w, '{quality.JOINED_WORD}') AND lower(w) NOT IN ({_ALLOWED})))::BIGINT AS joined_words,
  regexp_matches(text, '{quality.CITATION}') AS citation
FROM documents
""")
def doc_ocr_signals(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", quality.has_broken_spacing(t).alias("broken_spacing"), F.size(quality.joined_words(t)).cast("long").alias("joined_words"), quality.has_citation(t).alias("citation"))


@query("""
SELECT d.doc_id, count(l.doc_id) AS n_labels, CASE WHEN count(l.doc_id) = 0 THEN 'missing' WHEN count(l.doc_id) = 1 THEN 'duplicate' ELSE 'ambiguous' END AS decision
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.doc_id
""")
def doc_label_match_plan(spark, sf_dir):
    """Match classification: none, one or many."""
    counted = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count("*").alias("n_labels"))
    n = F.col("n_labels")
    out = table(spark, sf_dir, "documents").select("doc_id").join(counted, "doc_id", "left").fillna(0, ["n_labels"])
    return out.withColumn("decision", F.when(n == 0, "missing").when(n == 1, "duplicate").otherwise("ambiguous"))


@query("""
SELECT source, count(*) AS n_docs, CASE WHEN bool_or(quality = 0 AND toxic = 1) THEN 'failed' WHEN bool_or(toxic = 1) THEN 'changed' WHEN bool_or(quality = 0) THEN 'planned' ELSE 'unchanged' END AS status
FROM documents JOIN labels USING (doc_id) GROUP BY source
""")
def source_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    status = F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "failed").when(F.col("toxic") == 1, "changed").when(F.col("quality") == 0, "planned").otherwise("unchanged")
    grouped = rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.collect_set(status).alias("s"))
    return grouped.select("source", "n_docs", sync.worst(F.col("s")).alias("status"))


@query(r"""
SELECT page_id, regexp_replace(trim(replace(lower(url), '\', '/'), ' ./'), '/+', '/', 'g') AS path_key, CASE WHEN contains(url, '?') THEN regexp_extract(url, '^([^?]*)', 1) ELSE url END AS bare FROM pages
""")
def page_url_norm(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", path_key(F.col("url")).alias("path_key"), F.regexp_extract("url", r"^([^?]*)", 1).alias("bare"))


@query("""
SELECT page_id, pos::INT AS ordinal, block FROM (SELECT page_id, unnest(string_split(html, '<p>')) AS block, generate_subscripts(string_split(html, '<p>'), 1) AS pos FROM pages) WHERE pos > 1
""")
def page_text_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split("html", "<p>")).alias("ordinal", "block"))
    return rows.where("ordinal > 0").withColumn("ordinal", F.col("ordinal") + 1)


@query("""
SELECT conv_id, count(*) AS turns, string_agg(n || '. ' || role || ': ' || text, chr(10) ORDER BY turn) AS body FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id
""")
def conversation_sections(spark, sf_dir):
    """Ordered assembly with renumbering."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), parts.alias("p"))
    return rows.select("conv_id", "turns", F.array_join(F.transform("p", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["role"], F.lit(": "), x["text"])), "\n").alias("body"))


@query("""
SELECT conv_id, substr(sha256(string_agg(lower(trim(text)), chr(10) ORDER BY turn)), 1, 16) AS conv_key FROM conversations GROUP BY conv_id
""")
def conversation_ordered_key(spark, sf_dir):
    parts = F.array_sort(F.collect_list(F.struct("turn", F.lower(F.btrim("text")).alias("t"))))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(parts.alias("p"))
    return rows.select("conv_id", F.substring(F.sha2(F.array_join(F.transform("p", lambda x: x["t"]), "\n"), 256), 1, 16).alias("conv_key"))


#: The ledger state that an event of the driver's stream asks for (our own mapping).
EVENT_STATES = {"signup": "queued", "view": "running", "click": "draft_ready", "purchase": "accepted", "error": "failed"}
_STATES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_STATES.items())
_ALLOWED_SQL = " OR ".join(f"(s = '{a}' AND t IN ({', '.join(repr(x) for x in b)}))" for a, b in schema.LEDGER_TRANSITIONS.items() if b)


@query(f"""
WITH RECURSIVE e AS (SELECT user_id, CASE event_type {_STATES} END AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, 0::BIGINT AS n, 'manifest_ready' AS s, 0::BIGINT AS attempts, 0::BIGINT AS rejected FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT user_id, n, CASE WHEN ok THEN t ELSE s END, attempts + CASE WHEN ok AND t = 'running' AND s <> 'running' THEN 1 ELSE 0 END, rejected + CASE WHEN ok THEN 0 ELSE 1 END
  FROM (SELECT f.user_id, e.n, f.s, e.t, f.attempts, f.rejected, (f.s = e.t OR {_ALLOWED_SQL}) AS ok FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1))
SELECT user_id::VARCHAR AS lecture_key, s AS status, attempts, rejected FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1
""")
def event_ledger_fold(spark, sf_dir):
    """The state machine over each user's events in order."""
    to = F.create_map(*[F.lit(x) for kv in EVENT_STATES.items() for x in kv])
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("lecture_key"), "ts", "event_id", to[F.col("event_type")].alias("status"), *[F.lit(None).cast("string").alias(c) for c in ledger.FIELDS])
    return ledger.fold(rows, order=("ts", "event_id")).select("lecture_key", "status", "attempts", "rejected")


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type")
def event_latest(spark, sf_dir):
    """The latest run of a key."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", F.struct("ts", "event_id").alias("at"))
    return checkpoint.latest_of(rows, ["user_id", "event_type"], "at").drop("at")


@query("""
WITH a AS (SELECT o_orderkey AS path, md5(o_orderstatus || o_orderpriority) AS h FROM orders WHERE o_orderstatus <> 'F'),
b AS (SELECT o_orderkey AS path, md5(CASE WHEN o_orderpriority = '1-URGENT' THEN 'O' ELSE o_orderstatus END || o_orderpriority) AS h FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'new' WHEN a.path IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.path = b.path WHERE b.path IS NULL OR a.path IS NULL OR a.h <> b.h
""")
def snapshot_preflight(spark, sf_dir):
    """A full outer comparison of two snapshots of orders."""
    o = table(spark, sf_dir, "orders")
    now = o.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("path"), F.md5(F.concat("o_orderstatus", "o_orderpriority")).alias("sha256"))
    status = F.when(F.col("o_orderpriority") == "1-URGENT", "O").otherwise(F.col("o_orderstatus"))
    was = o.where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("path"), F.md5(F.concat(status, "o_orderpriority")).alias("sha256"))
    return sync.preflight(now, was)


@query("""
SELECT source AS project_id, ((n - 1) // 3)::INT AS batch, string_agg(doc_id::VARCHAR, ',' ORDER BY n) AS source_ids
FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) GROUP BY 1, 2
""")
def doc_batches_of_3(spark, sf_dir):
    # Ordinals need a source's rows in order: within (source, id range) first, then ranges added up,
    # so that a source with a third of all rows is not one task.
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.floor(F.col("doc_id") / 4096).alias("r"))
    before = d.groupBy("source", "r").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    rows = d.withColumn("k", F.row_number().over(Window.partitionBy("source", "r").orderBy("doc_id"))).join(before, ["source", "r"])
    scope = rows.select(F.col("source").alias("project_id"), (F.col("before") + F.col("k")).alias("ordinal"), F.col("doc_id").cast("string").alias("source_id"))
    return merge.question_scope(scope).withColumn("source_ids", F.array_join("source_ids", ","))


_TOPIC = rf"list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda w: length(w) >= 3 AND w NOT IN ({', '.join(f"'{w}'" for w in match.GENERIC)}) AND NOT regexp_full_match(w, '[0-9]{{4}}')))"


@query(f"""
WITH bw AS (SELECT item_id, unnest({_TOPIC}) AS w FROM benchmark),
dw AS (SELECT doc_id, unnest({_TOPIC}) AS w FROM documents),
s AS (SELECT doc_id, item_id, count(*) AS score FROM dw JOIN bw USING (w) GROUP BY 1, 2)
SELECT doc_id, item_id, score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) = 1
""")
def doc_top1_topic_score(spark, sf_dir):
    """Scored match on all topic words: those of three characters or more, without the fixed generic ones and years.

    Only words that items hold move, all of a document to one part; there are so many parts that
    the (document, item) rows of one are about PAIRS at most. Items beyond BLOCK_WORDS words are matched
    in blocks, each against the same shuffled words, and a document's best of all blocks wins.
    """
    word = lambda w: (F.length(w) >= 3) & ~w.isin(*match.GENERIC) & ~w.rlike(r"^\d{4}$")
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    b = items.select("item_id", F.explode(F.array_distinct(F.filter(words(F.col("text")), word))).alias("w"))
    blocks = max(1, math.ceil(b.count() / BLOCK_WORDS))
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(docs.count() * math.ceil(items.count() / blocks) / PAIRS))
    # The items' words are topic words, so a document's need no test of their own.
    d = docs.select("doc_id", F.explode(F.array_distinct(words(F.col("text")))).alias("w")).join(b.select("w"), "w", "left_semi").repartition(parts, "doc_id")
    # The smaller item wins a tie; unlike -item_id, ~item_id can't overflow.
    top = lambda rows: rows.groupBy("doc_id").agg(F.max_by(F.struct("item_id", "score"), F.struct("score", F.bitwise_not("item_id"))).alias("r")).select("doc_id", "r.*")
    score = lambda block: d.join(F.broadcast(block), "w").groupBy("doc_id", "item_id").agg(F.count("*").alias("score"))
    best = [top(score(b.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i))) for i in range(blocks)]
    # A union of equal partitionings would run all blocks of a part in one task.
    return best[0] if blocks == 1 else top(reduce(DataFrame.unionByName, [x.repartition("doc_id") for x in best]))


@query("""
SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)
""")
def doc_benchmark_contains(spark, sf_dir):
    """Containment match: hashes of three words find candidates, which are then tested whole.

    Items of fewer than five words have no such key: they are tested against each document in
    one pass, if all of them fit SHORT_BYTES, and raise beyond it.
    """
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"), F.split("text", r"\s+").alias("ws")).where("item <> ''")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    # The item's second to fourth word stand whole in a document that holds it.
    grams = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("ws") - 3)), lambda i: F.xxhash64(F.slice("ws", i + 1, 3))))
    keyed = b.where(F.size("ws") >= 5).select("item_id", F.xxhash64(F.slice("ws", 2, 3)).alias("key"))
    shared = d.select("doc_id", F.split("text", r"\s+").alias("ws")).select("doc_id", F.explode(grams).alias("key"))
    # Only keys move; texts are fetched for the documents that share one.
    shared = shared.join(keyed, "key").select("doc_id", "item_id").distinct()
    near = shared.join(b.select("item_id", "item"), "item_id").join(d, "doc_id").where(F.contains("text", F.col("item"))).select("doc_id", "item_id")
    short = b.where(F.size("ws") < 5).select("item_id", "item")
    if short.agg(F.coalesce(F.sum(F.length("item") + 16), F.lit(0))).first()[0] > SHORT_BYTES:
        raise ValueError("too many short items for one pass")
    return near.unionByName(d.join(F.broadcast(short), F.contains("text", F.col("item"))).select("doc_id", "item_id")).distinct()


@query(rf"""
WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents), h AS (SELECT *, substr(t, 1, 868) AS head FROM t),
k AS (SELECT *, regexp_replace(regexp_extract(head, '(?s)^(.*)\n', 1), '\s+$', '') AS whole FROM h)
SELECT doc_id, CASE WHEN length(t) <= 900 THEN t ELSE (CASE WHEN whole <> '' THEN whole ELSE regexp_replace(head, '\s+$', '') END) || chr(10) || '{rewrite.OMITTED}' END AS fragment FROM k
""")
def doc_fragment_900(spark, sf_dir):
    """Size-bound fragments, cut at a line's end."""
    return table(spark, sf_dir, "documents").select("doc_id", rewrite.truncated(F.col("text"), 900).alias("fragment"))


@query(r"""
WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\r\n|[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g'), chr(10)) AS l FROM documents),
r AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM l),
p AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY n) AS prev FROM r)
SELECT doc_id, regexp_replace(string_agg(CASE WHEN regexp_matches(line, '^\s*\|') AND regexp_matches(coalesce(prev, ''), '^\s*[^\s|]') THEN chr(10) ELSE '' END || regexp_replace(line, '\s+$', ''), chr(10) ORDER BY n), '^\s+|\s+$', '', 'g') AS text
FROM p GROUP BY doc_id
""")
def doc_table_spacing(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", rewrite.table_spacing(F.col("text")).alias("text"))


@query(f"""
WITH a AS (SELECT conv_id, turn, text FROM conversations)
SELECT conv_id, turn, 'short_answer' AS code FROM a WHERE length(text) < 50 AND trim(text) NOT IN ({', '.join(f"'{m}'" for m in schema.EMPTY_MARKERS)})
UNION ALL SELECT conv_id, turn, 'error_payload' AS code FROM a WHERE {' OR '.join(f"contains(lower(text), '{x}')" for x in provenance.ERROR_SIGNALS)}
""")
def conversation_answer_errors(spark, sf_dir):
    """Turns that are too short or are error messages."""
    rows = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("doc_id"), F.lit("answer").alias("kind"), F.col("text").alias("answer"))
    return provenance.answer_rules(rows).select("doc_id.conv_id", "doc_id.turn", "code")


@query("""
WITH q AS (SELECT doc_id, source || '-' || (doc_id // 500) AS section, substr(regexp_replace(lower(text), '[^a-z]', '', 'g'), 1, 12) AS stem FROM documents),
g AS (SELECT section, stem, min(doc_id) AS first, count(*) AS copies FROM q GROUP BY ALL)
SELECT section, stem, first, copies, row_number() OVER (PARTITION BY section ORDER BY first) AS number FROM g
""")
def doc_question_merge(spark, sf_dir):
    """Documents as written questions of sections of at most 500: repeated ones merged and numbered."""
    stem = F.substring(F.regexp_replace(F.lower("text"), "[^a-z]", ""), 1, 12)
    section = F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 500).cast("string"))
    block = F.concat(F.lit("### Question "), F.col("doc_id").cast("string"), F.lit("\n**Question:** "), stem, F.lit("\n**Source:** "), "source", F.lit("\n**Model Answer:** x\n"))
    rows = table(spark, sf_dir, "documents").select(section.alias("doc_id"), F.lit("written").alias("kind"), F.col("doc_id").alias("ordinal"), block.alias("block"))
    return merge.merge_questions(markdown.with_fields(rows)).select(F.col("doc_id").alias("section"), F.col("fingerprint").alias("stem"), "first", "copies", F.col("number").cast("long").alias("number"))


@query("""
SELECT doc_id::VARCHAR AS relative_path, count(l.doc_id) FILTER (WHERE quality = 1) AS n_matches,
  CASE count(l.doc_id) FILTER (WHERE quality = 1) WHEN 0 THEN 'missing' WHEN 1 THEN 'duplicate' ELSE 'ambiguous' END AS decision
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY doc_id
""")
def doc_dedup_plan(spark, sf_dir):
    """Documents as local files, labels as remote sources of the same stems, of which those of quality are ready."""
    name = F.concat(F.lit("Dir/Doc_"), F.col("doc_id").cast("string"))
    none = F.lit("")
    local = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("relative_path"), F.concat(name, F.lit(".pdf")).alias("name"), F.lit("use").alias("preparation_action"), F.array().cast("array<string>").alias("hashes"), none.alias("original_name"), none.alias("prepared_name"))
    status = F.when(F.col("quality") == 1, "2").otherwise("1")
    remote = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("source_id"), F.concat(F.lit("doc "), F.col("doc_id").cast("string"), F.lit(".TXT")).alias("title"), none.alias("content_hash"), status.alias("status"))
    return match.deduplication_plan(local, remote).select("relative_path", "n_matches", "decision")


@query("SELECT d.doc_id FROM documents d ANTI JOIN labels l USING (doc_id)")
def doc_pending(spark, sf_dir):
    """Documents as recordings without a transcript."""
    recordings = table(spark, sf_dir, "documents").select("doc_id", F.format_string("Talk %d.m4a", "doc_id").alias("title"))
    done = table(spark, sf_dir, "labels").select(F.format_string("talk_%d.md", "doc_id").alias("name"))
    return scope.pending_recordings(recordings, done).select("doc_id")


_EXT = {"en": ".pdf", "fr": ".ppt", "de": ".mkv", "es": ".docx"}


@query(f"""
SELECT doc_id, CASE lang WHEN 'fr' THEN 'convert' WHEN 'de' THEN 'convert' WHEN 'en' THEN CASE WHEN n_chars < 50 THEN 'ocr' WHEN n_chars * 40000 > {prepare.LARGE_BYTES} THEN 'wait' ELSE 'use' END ELSE CASE WHEN n_chars * 40000 > {prepare.LARGE_BYTES} THEN 'wait' ELSE 'use' END END AS action,
  CASE lang WHEN 'en' THEN '.pdf' WHEN 'fr' THEN '.pdf' WHEN 'de' THEN '.m4a' WHEN 'es' THEN '.docx' ELSE '' END AS target
FROM documents
""")
def doc_prepare_plan(spark, sf_dir):
    """Documents as files of several kinds, with the preparation each needs."""
    ext = F.coalesce(F.create_map(*[F.lit(x) for kv in _EXT.items() for x in kv])[F.col("lang")], F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("relative_path"), F.lit("auto").alias("action"), F.lit("").alias("target_format"), F.array().cast("array<int>").alias("pages"),
        (F.col("n_chars") * 40000).alias("size"), F.lit(None).cast("long").alias("max_upload_bytes"), (F.col("n_chars") < 50).alias("needs_ocr"), F.lit(0.0).alias("garbage_ratio"),
    )
    return prepare.plan(rows).select("doc_id", F.col("planned_action").alias("action"), "target")


@query("""
SELECT conv_id AS doc_id, string_agg('## ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id
""")
def conversation_documents(spark, sf_dir):
    """Turns as a document's sections."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("section_no"), F.concat(F.lit("## "), "role").alias("heading"), F.col("text").alias("body"))
    return merge.assemble(rows)


@query(r"""
WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents),
k AS (SELECT regexp_replace(regexp_replace(replace(lower(nfc_normalize(line)), 'ß', 'ss'), '^\s*(?:question\s*)?[0-9]+\s*[).:;-]\s*', ''), '[^\p{L}\p{N}\p{M}_\x{600}-\x{6ff}]+', '', 'g') AS fingerprint FROM l)
SELECT fingerprint, count(*) AS copies FROM k WHERE fingerprint <> '' GROUP BY fingerprint
""")
def line_question_fingerprints(spark, sf_dir):
    """Lines by their question fingerprint."""
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.select(fingerprint(F.col("line")).alias("fingerprint")).where("fingerprint <> ''").groupBy("fingerprint").agg(F.count("*").alias("copies"))
