"""More driver queries: the library's operators on rows made from the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fascicle import schema
from fascicle.functions import canonical, keys, markdown
from fascicle.operators import answers, cards, containment, manifest, merge, scope, sync
from fascicle.plans.queries import query, table
from fascicle.sources import payloads

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_NONE = "array<struct<notebook_uuid:string,source_id:string,source_name:string,error:string>>"


def _results(spark, sf_dir, kind, answer):
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("doc_id"), F.lit(kind).alias("kind"), F.col("turn").alias("ordinal"), answer.alias("answer"), F.array("role").alias("source_names"), F.array().cast(_NONE).alias("quarantine"))


@query(f"""
WITH t AS (SELECT conv_id, turn, role, {_STRIP.format("text")} AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
r AS (SELECT conv_id, string_agg(role, ',' ORDER BY first) AS names FROM (SELECT conv_id, role, min(turn) AS first FROM t GROUP BY ALL) GROUP BY conv_id)
SELECT conv_id, string_agg('### MCQ ' || n || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS answer, any_value(names) AS names FROM t JOIN r USING (conv_id) GROUP BY conv_id
""")
def conversation_answers_numbered(spark, sf_dir):
    """Turns as the answers of several notebooks: blocks numbered through, names once."""
    answer = F.concat(F.lit("### MCQ "), F.col("turn").cast("string"), F.lit("\n"), F.regexp_replace("text", r"^\s+", ""))
    out = answers.merge_results(_results(spark, sf_dir, "mcq", answer))
    return out.select(F.col("doc_id").alias("conv_id"), "answer", F.array_join("source_names", ",").alias("names"))


_IMP = ", ".join(f"({i}, '{h.replace(chr(39), chr(39) * 2)}')" for i, h in enumerate(schema.IMP_HEADINGS))


@query(rf"""
WITH h(i, heading) AS (VALUES {_IMP}),
t AS (SELECT conv_id, turn, turn % 5 AS i, {_STRIP.format("text")} AS text FROM conversations),
s AS (SELECT conv_id, i, string_agg(CASE WHEN i = 4 THEN regexp_extract(text, '(?s)^(.*?)(?:\n\s*\n.*)?$', 1) ELSE text END, chr(10) || chr(10) ORDER BY turn) AS body FROM t WHERE text <> '' GROUP BY ALL)
SELECT conv_id, string_agg(heading || chr(10) || coalesce(body, '{answers.NOTHING}'), chr(10) || chr(10) ORDER BY h.i) AS answer
FROM (SELECT DISTINCT conv_id FROM conversations) c CROSS JOIN h LEFT JOIN s USING (conv_id, i) GROUP BY conv_id
""")
def conversation_answers_by_heading(spark, sf_dir):
    """Turns as answers under the fixed headings, each heading once."""
    headings = F.array(*[F.lit(h) for h in schema.IMP_HEADINGS])
    answer = F.concat(F.element_at(headings, (F.col("turn") % 5 + 1).cast("int")), F.lit("\n"), F.col("text"))
    return answers.merge_results(_results(spark, sf_dir, "imp", answer)).select(F.col("doc_id").alias("conv_id"), "answer")


@query("""
SELECT doc_id, CASE WHEN doc_id = 0 THEN '' WHEN doc_id % 6 < 4 THEN doc_id::VARCHAR END AS source_id, CASE WHEN doc_id % 6 < 4 THEN source || ' ' || doc_id || '.pdf' END AS title,
  CASE WHEN doc_id % 6 < 4 THEN CASE WHEN lang = 'en' THEN 'ready' ELSE 'processing' END END AS status, CASE doc_id % 6 WHEN 4 THEN 'no_sources' WHEN 5 THEN 'not_json' END AS error
FROM documents
""")
def doc_payload_inventory(spark, sf_dir):
    """A payload for each document, in six shapes, two of which hold no sources."""
    d = table(spark, sf_dir, "documents").withColumn("title", F.concat("source", F.lit(" "), F.col("doc_id").cast("string"), F.lit(".pdf")))
    one = F.struct(F.col("doc_id").alias("id"), "title", F.when(F.col("lang") == "en", 2).otherwise(1).alias("status"))
    named = F.struct(F.struct(F.col("title").alias("name"), F.col("doc_id").cast("string").alias("source_id"), F.when(F.col("lang") == "en", " Ready").otherwise("PROCESSING").alias("state")).alias("u"))
    shapes = [F.to_json(F.array(one)), F.to_json(F.struct(F.array(one).alias("sources"))), F.to_json(F.struct(F.struct(F.array(one).alias("items")).alias("data"))), F.to_json(named), F.concat(F.lit('{"items": [], "results": '), F.to_json(F.array(one)), F.lit("}"))]
    payload = F.lit("{")
    for i, shape in enumerate(shapes):
        payload = F.when(F.col("doc_id") % 6 == i, shape).otherwise(payload)
    told = payloads.entries(d.select("doc_id", payload.alias("payload")), "doc_id")
    s, held = F.col("source"), F.col("place").isNotNull()
    return told.select("doc_id", F.when(held, payloads.first_text(s, payloads.IDS)).alias("source_id"), F.when(held, payloads.first_text(s, payloads.TITLES)).alias("title"), F.when(held, payloads.status(s)).alias("status"), "error")


@query(r"""
SELECT event_id, sha256('{"event": "' || event_type || '", "id": ' || event_id || ', "owner": {"tags": ["' || event_type || '", null], "user": ' || user_id || '}, "props": "' || replace(replace(props, '\', '\\'), '"', '\"') || '", "value": ' || CASE WHEN value IS NULL THEN 'null' ELSE value::VARCHAR END || '}') AS digest FROM events
""")
def event_canonical_hash(spark, sf_dir):
    """Events as records, by the hash of their canonical JSON."""
    owner = F.struct(F.col("user_id").alias("user"), F.array(F.col("event_type"), F.lit(None).cast("string")).alias("tags"))
    rows = table(spark, sf_dir, "events").select("event_id", F.struct("value", "props", F.col("event_id").alias("id"), F.col("event_type").alias("event"), owner.alias("owner")).alias("r"))
    return rows.select("event_id", canonical.json_hash(F.col("r"), rows.schema["r"].dataType).alias("digest"))


@query("""
WITH a AS (SELECT DISTINCT regexp_extract(lower(text), '[a-z]{1,3}') AS name FROM documents), b AS (SELECT DISTINCT array_to_string(regexp_extract_all(lower(text), '[a-z]+')[1:3], ' ') AS expected FROM benchmark)
SELECT name, expected FROM a, b WHERE contains(expected, name) OR contains(name, expected)
""")
def doc_names_within(spark, sf_dir):
    """The first letters of documents within the first words of benchmark items."""
    a = table(spark, sf_dir, "documents").select(F.regexp_extract(F.lower("text"), "[a-z]{1,3}", 0).alias("name"))
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), 1, 3)
    return containment.fuzzy_matches(a, table(spark, sf_dir, "benchmark").select(F.array_join(words, " ").alias("name")))


_TYPES = {"en": "past_exam", "fr": "question_bank", "de": "ignore"}
_PATHS = ("Questions/a", "Questions/x/../b", "../c", "Exams/d", "Questions/..")


@query(f"""
WITH m AS (SELECT doc_id::VARCHAR AS manifest_id, n_chars > 50 AS recorded, CASE lang WHEN 'en' THEN 'past_exam' WHEN 'fr' THEN 'question_bank' WHEN 'de' THEN 'ignore' ELSE 'other' END AS type, ([{', '.join(repr(p) for p in _PATHS)}])[(doc_id % 5 + 1)::INT] AS path, CASE WHEN doc_id % 3 = 0 THEN 1990 + doc_id % 50 END AS year FROM documents)
SELECT manifest_id, 'no_recordings' AS code, NULL AS subject FROM m WHERE NOT recorded
UNION ALL SELECT manifest_id, 'assessment_type', path FROM m WHERE type = 'other'
UNION ALL SELECT manifest_id, 'exam_without_year', path FROM m WHERE type = 'past_exam' AND year IS NULL
UNION ALL SELECT manifest_id, 'year_on_other_type', path FROM m WHERE type <> 'past_exam' AND year IS NOT NULL
UNION ALL SELECT manifest_id, 'year_out_of_range', path FROM m WHERE type = 'past_exam' AND year NOT BETWEEN 2000 AND 2026
UNION ALL SELECT manifest_id, 'assessment_outside', path FROM m WHERE path NOT IN ('Questions/a', 'Questions/x/../b')
""")
def doc_manifest_errors(spark, sf_dir):
    """Documents as lecture manifests with one assessment each, faults told."""
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in _TYPES.items() for x in kv])[F.col("lang")], F.lit("other"))
    path = F.element_at(F.array(*[F.lit(p) for p in _PATHS]), (F.col("doc_id") % 5 + 1).cast("int"))
    year = F.when(F.col("doc_id") % 3 == 0, (1990 + F.col("doc_id") % 50).cast("string"))
    source = F.struct(path.alias("path"), kind.alias("type"), year.alias("year"), F.lit(None).cast("array<string>").alias("years"))
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("manifest_id"), F.when(F.col("n_chars") > 50, F.array(F.concat("source", F.lit(".m4a")))).otherwise(F.array().cast("array<string>")).alias("recording_sources"), F.lit(None).cast("array<string>").alias("approved_uploads"),
        F.lit('{"a": 1}').alias("exam_style_profile"), F.array(source).alias("assessment_sources"), F.lit(None).cast("array<struct<path:string,type:string>>").alias("references"),
    )
    return manifest.lecture_errors(rows, 2025)


@query("""
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(text, '[0-9]+'), lambda r: length(r) = 4), lambda r: r::INT), lambda y: y BETWEEN 2000 AND 2026))), ',') AS years FROM documents
""")
def doc_exam_years(spark, sf_dir):
    """Standalone years in texts."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(keys.exam_years(F.col("text"), 2025).cast("array<string>"), ",").alias("years"))


_CATEGORY = " ".join(f"WHEN {' OR '.join(f'contains(lower(text), {w!r})' for w in words)} THEN '{name}'" for name, words in schema.CARD_KEYWORDS)


@query(f"SELECT CASE {_CATEGORY} ELSE 'past_exams' END AS category, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1")
def doc_card_categories(spark, sf_dir):
    """Documents by the card category of their text."""
    return table(spark, sf_dir, "documents").select("doc_id", cards.category(F.col("text")).alias("category")).groupBy("category").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("""
SELECT 'nb' AS notebook_uuid, 's' || doc_id AS source_id, CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN quality = 1 THEN 's' ELSE 'x' END || doc_id END AS live_id,
  CASE WHEN l.doc_id IS NOT NULL AND n_chars % 2 = 0 THEN 'Lecture/doc_' || doc_id || '.pdf' END AS relative_path, CASE WHEN l.doc_id IS NULL THEN 'no live source' WHEN n_chars % 2 = 1 THEN 'no local file' END AS error
FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def doc_quarantine_plan(spark, sf_dir):
    """Documents as rejected sources: a label is the live source by id or name, an even length a local file."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id").cast("string")
    asked = d.select(F.lit("nb").alias("notebook_uuid"), F.concat(F.lit("s"), n).alias("source_id"), F.concat(F.lit("Doc "), n, F.lit(".pdf")).alias("source_name"))
    live = table(spark, sf_dir, "labels").select(F.lit("nb").alias("notebook_uuid"), F.concat(F.when(F.col("quality") == 1, "s").otherwise("x"), n).alias("source_id"), F.concat(F.lit("doc "), n, F.lit(".PDF")).alias("title"))
    local = d.where("n_chars % 2 = 0").select(F.concat(F.lit("Lecture/doc_"), n, F.lit(".pdf")).alias("relative_path"), F.concat(F.lit("doc_"), n, F.lit(".pdf")).alias("name"), F.lit("slides").alias("role"))
    return scope.quarantine_plan(asked, live, local).drop("source_name")


@query("""
WITH s AS (SELECT d.doc_id, nb, CASE WHEN l.doc_id IS NULL OR nb <> CASE WHEN quality = 1 THEN 'a' ELSE 'b' END THEN CASE WHEN d.doc_id % 7 = 0 THEN 'not-approved' ELSE 'planned-upload' END
  WHEN d.doc_id % 5 = 0 THEN 'processing' WHEN d.doc_id % 2 = 0 THEN 'unchanged' ELSE 'changed' END AS status FROM documents d CROSS JOIN (VALUES ('a'), ('b')) n(nb) LEFT JOIN labels l USING (doc_id))
SELECT 'p/' || doc_id AS path, CASE WHEN bool_or(status = 'changed') THEN 'changed' WHEN bool_or(status = 'planned-upload') THEN 'planned' WHEN bool_and(status = 'not-approved') THEN 'not-approved' ELSE 'unchanged' END AS status FROM s GROUP BY doc_id
""")
def doc_sync_statuses(spark, sf_dir):
    """Documents in two notebooks, of which labels say what each holds: the worst status of each."""
    n, none = F.col("doc_id").cast("string"), F.lit("")
    name = F.concat(F.lit("doc "), n, F.lit(".pdf"))
    local = table(spark, sf_dir, "documents").select(F.concat(F.lit("p/"), n).alias("relative_path"), name.alias("name"), none.alias("original_name"), none.alias("prepared_name"), F.array(F.lit("h")).alias("hashes"), F.lit("use").alias("preparation_action"), (F.col("doc_id") % 7 != 0).alias("approved"))
    status = F.when(F.col("doc_id") % 5 == 0, "processing").otherwise("ready")
    remote = table(spark, sf_dir, "labels").select(F.concat(F.lit("s"), n).alias("source_id"), F.upper(name).alias("title"), F.when(F.col("quality") == 1, "a").otherwise("b").alias("notebook_uuid"), F.when(F.col("doc_id") % 2 == 0, "h").otherwise("g").alias("content_hash"), status.alias("status"))
    notebooks = spark.createDataFrame([("a",), ("b",)], "notebook_uuid string")
    return sync.rollup(sync.notebook_statuses(local, remote, notebooks))


@query("""
SELECT CASE WHEN quality = 1 THEN 'a' ELSE 'b' END AS project_id, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS ordinal, 's' || doc_id AS source_id
FROM documents JOIN labels USING (doc_id) WHERE doc_id % 5 <> 0
""")
def doc_scope(spark, sf_dir):
    """Documents as titles, labels as the projects' sources: by name, or by stem where the extension differs."""
    n = F.col("doc_id").cast("string")
    titles = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), F.concat(F.lit("Doc "), n, F.lit(".txt")).alias("title"))
    title = F.concat(F.lit("doc_"), n, F.when(F.col("doc_id") % 2 == 0, ".txt").otherwise(".pdf"))
    remote = table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "a").otherwise("b").alias("notebook_uuid"), F.concat(F.lit("s"), n).alias("source_id"), title.alias("title"), F.when(F.col("doc_id") % 5 == 0, "error").otherwise("2").alias("status"))
    return scope.build_scope(titles, remote).select("project_id", F.col("ordinal").cast("long").alias("ordinal"), "source_id")


@query("""
WITH q AS (SELECT doc_id, source || '-' || (doc_id // 500) AS section, substr(regexp_replace(lower(text), '[^a-z]', '', 'g'), 1, 4) AS stem, CASE WHEN doc_id % 4 <> 0 THEN 2015 + doc_id % 8 END AS year FROM documents),
g AS (SELECT section, stem, min(doc_id) AS first, bool_or(year IS NULL) AS bank, string_agg(DISTINCT year::VARCHAR, ', ' ORDER BY year::VARCHAR) AS years, count(DISTINCT year) AS n FROM q GROUP BY ALL)
SELECT section, stem, row_number() OVER (PARTITION BY section ORDER BY first) AS number, concat_ws(' ', CASE WHEN n > 0 THEN '**[Past Exams - ' || years || ']**' END, CASE WHEN bank THEN '**[Question Bank]**' END) AS badges FROM g
""")
def doc_badge_merge(spark, sf_dir):
    """Documents as questions with badges: repeated ones merged, their years and badges united."""
    stem = F.substring(F.regexp_replace(F.lower("text"), "[^a-z]", ""), 1, 4)
    section = F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 500).cast("string"))
    badge = F.when(F.col("doc_id") % 4 == 0, "**[Question Bank]**").otherwise(F.concat(F.lit("**[Past Exams - "), (2015 + F.col("doc_id") % 8).cast("string"), F.lit("]**")))
    block = F.concat(F.lit("### Question "), F.col("doc_id").cast("string"), F.lit(" "), badge, F.lit("\n**Question:** "), stem, F.lit("\n**Source:** "), "source", F.lit("\n**Model Answer:** x\n"))
    rows = table(spark, sf_dir, "documents").select(section.alias("doc_id"), F.lit("written").alias("kind"), F.col("doc_id").alias("ordinal"), block.alias("block"))
    out = merge.merge_questions(markdown.with_fields(rows))
    return out.select(F.col("doc_id").alias("section"), F.col("fingerprint").alias("stem"), F.col("number").cast("long").alias("number"), F.array_join("badges", " ").alias("badges"))


@query(r"""
WITH t AS (SELECT conv_id, turn, substr(regexp_replace(lower(text), '[^a-z]', '', 'g'), 1, 6) AS stem FROM conversations),
g AS (SELECT conv_id, stem, min(turn) AS first FROM t GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY first) AS n FROM g)
SELECT conv_id, string_agg('### Clinical Case ' || n || chr(10) || chr(10) || trim('**Scenario:** ' || stem), '|' ORDER BY n) AS answer FROM n GROUP BY conv_id
""")
def conversation_case_merge(spark, sf_dir):
    """Turns as clinical cases in three forms, TIP callouts among them: repeated ones merged, all in one form and numbered."""
    from fascicle.operators import finalize

    stem = F.substring(F.regexp_replace(F.lower("text"), "[^a-z]", ""), 1, 6)
    n = F.col("turn").cast("string")
    head = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("### Case "), n)).when(F.col("conv_id") % 3 == 1, F.concat(F.lit("### Clinical Case "), n)).otherwise(F.concat(F.lit("> [!TIP]\n> **🩺 Clinical Case "), n, F.lit(":**")))
    quote = F.when(F.col("conv_id") % 3 == 2, "> ").otherwise("")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(head, F.lit("\n"), quote, F.lit("**Scenario:** "), stem).alias("block"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "block"))), lambda x: x["block"]), "\n\n")
    whole = rows.groupBy(F.col("conv_id").alias("doc_id")).agg(body.alias("answer")).withColumn("kind", F.lit("case"))
    out = finalize.normalize_answers(whole.select("doc_id", "kind", "answer"))
    return out.select(F.col("doc_id").alias("conv_id"), F.replace("answer", F.lit("\n\n###"), F.lit("|###")).alias("answer"))


@query("""
WITH r AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 2 ELSE 1 END AS n FROM labels WHERE quality = 1),
l AS (SELECT doc_id, n_chars, CASE lang WHEN 'en' THEN 'past_exam' WHEN 'fr' THEN 'slides' ELSE 'lecture_material' END AS role, doc_id % 4 = 0 AS exe, doc_id % 6 = 1 AS remote, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE coalesce(n, 0) END AS n FROM documents LEFT JOIN r USING (doc_id))
SELECT 'L/doc_' || doc_id AS relative_path, 'unreadable' AS code FROM l WHERE n_chars < 100 AND n = 0 AND NOT remote
UNION ALL SELECT 'L/doc_' || doc_id, 'not_uploadable' FROM l WHERE exe AND n = 0 AND (role = 'past_exam' OR doc_id % 10 = 3 OR doc_id % 7 = 2)
UNION ALL SELECT 'L/doc_' || doc_id, 'no_remote' FROM l WHERE remote AND n = 0
UNION ALL SELECT 'L/doc_' || doc_id, 'ambiguous' FROM l WHERE n > 1 AND NOT remote AND (role = 'past_exam' OR doc_id % 7 = 2)
""")
def doc_blocking_errors(spark, sf_dir):
    """Documents as a workspace's files, labels as remote sources: what blocks a run that asks for every seventh."""
    from fascicle.operators import blocking, match

    n, none = F.col("doc_id").cast("string"), F.lit("")
    d = table(spark, sf_dir, "documents")
    role = F.when(F.col("lang") == "en", "past_exam").when(F.col("lang") == "fr", "slides").otherwise("lecture_material")
    local = d.select(
        F.concat(F.lit("L/doc_"), n).alias("relative_path"), F.concat(F.lit("doc_"), n, F.when(F.col("doc_id") % 4 == 0, ".exe").otherwise(".pdf")).alias("name"), none.alias("original_name"), none.alias("prepared_name"), F.array().cast("array<string>").alias("hashes"),
        F.when(F.col("doc_id") % 6 == 1, "use_remote").otherwise("use").alias("preparation_action"), role.alias("role"), F.when(F.col("n_chars") < 100, "fail").otherwise("pass").alias("ocr_status"), F.lit(False).alias("planned"),
    )
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("doc_id") % 9 == 0, 2).otherwise(1)))
    remote = table(spark, sf_dir, "labels").where("quality = 1").select(n.alias("i"), copies.alias("c")).select(F.concat("i", F.lit("-"), F.col("c").cast("string")).alias("source_id"), F.concat(F.lit("doc "), "i", F.lit(".TXT")).alias("title"), none.alias("content_hash"), F.lit("ready").alias("status"))
    asked = d.where("doc_id % 7 = 2").select(F.concat(F.lit("Doc "), n, F.when(F.col("doc_id") % 4 == 0, ".exe").otherwise(".pdf")).alias("name"))
    references = d.where("doc_id % 10 = 3").select(F.concat(F.lit("l\\DOC_"), n).alias("relative_path"))
    return blocking.blocking_errors(match.deduplication_plan(local, remote), asked, references)


@query("""
WITH a AS (SELECT conv_id, string_agg(CASE WHEN conv_id % 2 = 0 THEN '### MCQ ' ELSE '### Question ' END || turn || CASE WHEN turn % 2 = 0 THEN CASE WHEN conv_id % 5 = 0 THEN ' **[Past Exams (2020) / IMP]**' ELSE ' **[Question Bank]**' END ELSE '' END, chr(10) ORDER BY turn) AS t, count(*) AS n, count(*) FILTER (WHERE turn % 2 = 0) AS badges FROM conversations GROUP BY conv_id),
k AS (SELECT *, CASE WHEN conv_id % 2 = 0 THEN 'mcq' ELSE 'written' END AS kind FROM a)
SELECT conv_id, kind, 'badge_count' AS code FROM k WHERE badges < n
UNION ALL SELECT conv_id, kind, 'missing_citation' FROM k WHERE conv_id % 3 <> 1
UNION ALL SELECT conv_id, kind, 'missing_recording' FROM k WHERE conv_id % 5 = 0 AND badges > 0 AND conv_id % 3 <> 0
""")
def conversation_phase_rules(spark, sf_dir):
    """Conversations as question phases: badges to each question, exams and recordings cited."""
    from fascicle.operators import phases

    badge = F.when(F.col("conv_id") % 5 == 0, " **[Past Exams (2020) / IMP]**").otherwise(" **[Question Bank]**")
    head = F.concat(F.when(F.col("conv_id") % 2 == 0, "### MCQ ").otherwise("### Question "), F.col("turn").cast("string"), F.when(F.col("turn") % 2 == 0, badge).otherwise(""))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", head.alias("h")).groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "h"))).alias("x"))
    names = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("Talk_1.M4A"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("final exam.txt"))).otherwise(F.array().cast("array<string>"))
    results = rows.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "mcq").otherwise("written").alias("kind"), F.array_join(F.transform("x", lambda v: v["h"]), "\n").alias("answer"), names.alias("source_names"))
    name = lambda n: spark.createDataFrame([(n,)], "name string")
    return phases.phase_rules(results, name("talk 1.m4a"), name("Final Exam.pdf")).select(F.col("doc_id").alias("conv_id"), "kind", "code")
