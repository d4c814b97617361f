"""The reference's behaviours on small tables of our own."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fascicle.functions import keys, markdown
from fascicle.operators import cards, checkpoint, ledger, match, merge, provenance, quality, rewrite, sync, validate
from fascicle.plans import queries as plans

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


@pytest.mark.parametrize("name,key", [("Dir/Ｌecture_01.PDF", "lecture 01 pdf"), ("Año ٢٠٢٣.txt", "año 2023 txt"), ("", ""), ("Straße-2", "strasse 2")])
def test_source_key(spark, name, key):
    assert one(spark, keys.source_key(F.col("n")), n=name) == key


def test_scalar_keys(spark):
    assert one(spark, keys.source_stem(F.col("n")), n="a/b.c/Final Exam.v2.pdf") == "final exam v2"
    assert one(spark, keys.path_key(F.col("n")), n=".\\A//B\\c.TXT") == "a/b/c.txt"
    assert one(spark, keys.exam_years(F.col("n"), 2026), n="in 2019, ٢٠٢١ and 20215 or 2099") == [2019, 2021]
    assert one(spark, keys.filename_years(F.col("n"), 2026), n="exam 23 (2020)") == [2020, 2023]
    assert one(spark, keys.page_numbers(F.col("n")), n="3, 1-2,7:8, x, 0") == [1, 2, 3, 7, 8]
    assert one(spark, keys.is_newer(F.col("a"), F.col("b")), a="v1.10.0", b="1.9.9")
    assert one(spark, keys.html(F.col("n")), n="<a> & **b**") == "&lt;a&gt; &amp; <strong>b</strong>"
    assert one(spark, keys.cache_stem(F.col("n")), n="..") == "source"
    assert one(spark, keys.fingerprint(F.col("n")), n="Question 12) What IS it?") == "whatisit"
    first = keys.identity_key(F.col("a"), F.col("b"))
    assert one(spark, first, a="x", b="y") != one(spark, first, a="y", b="x")


MCQ = """intro
### MCQ 1 **[Past Exams - 2021]**
**Question:** 3) Which drug?
**Options:** a. One b. Two c. Three d. Four
**Source:** Exam A and "Bank" (2020)
**Correct Answer:** b. Two
**Clinical Explanation:** because
### MCQ 2 **[Past Exams - 2019]**
**Question:** Which drug?
**Options:**
a. One
b. Two
c. Three
d. Four
**Source:** Exam B
**Correct Answer:** b. Two
**Clinical Explanation:** because
### MCQ 3 **[IMP]**
**Question:** Which drug?
**Options:** a. One b. Two c. Three d. Four
**Correct Answer:** c. Three
**Clinical Explanation:** because
"""


@pytest.fixture(scope="module")
def blocks(spark):
    rows = spark.createDataFrame([("d", "mcq", MCQ), ("e", "written", "### Question 4\n**Question:** Why?\n"), ("n", "mcq", None)], "doc_id string, kind string, answer string")
    return markdown.with_fields(markdown.blocks(rows)).cache()


def test_blocks_and_fields(blocks):
    rows = {(r.doc_id, r.ordinal): r for r in blocks.collect()}
    assert sorted(rows) == [("d", 1), ("d", 2), ("d", 3), ("e", 1)]
    a = rows["d", 1]
    assert (a.number, a.sources, a.badge_years, a.is_imp) == ("1", ["Exam A", "Bank"], [2021], False)
    assert a.fingerprint == rows["d", 2].fingerprint != rows["d", 3].fingerprint
    assert a.stem == rows["d", 3].stem
    assert rows["e", 1].question == "Why?"


def test_option_entries(blocks):
    found = blocks.select("doc_id", "ordinal", markdown.option_entries(F.col("options")).alias("o")).where("doc_id = 'd'").collect()
    assert all([(x.key, x.text) for x in r.o] == [("a", "One"), ("b", "Two"), ("c", "Three"), ("d", "Four")] for r in found)


def test_merge_unites_years_and_sources(blocks):
    rows = merge.rendered(merge.merge_questions(blocks.where("doc_id = 'd'"))).orderBy("number").collect()
    assert [(r.number, r.copies, r.badges) for r in rows] == [(1, 2, ["**[Past Exams - 2019, 2021]**"]), (2, 1, ["**[IMP]**"])]
    assert rows[0].sources == ["Exam A", "Bank", "Exam B"] and rows[0].text.startswith("### MCQ 1 **[Past Exams - 2019, 2021]**\n**Source:** Exam A, Bank, Exam B\n")


def test_merge_does_not_depend_on_partitions(blocks):
    plain = merge.merge_questions(blocks).orderBy("doc_id", "number").collect()
    assert merge.merge_questions(blocks.repartition(7, "ordinal")).orderBy("doc_id", "number").collect() == plain


def test_validation(spark, blocks):
    codes = {(r.doc_id, r.number, r.code) for r in validate.validate_blocks(blocks, 2026).collect()}
    assert ("d", "2", "duplicate_question") in codes and ("d", "1", "unsafe_duplicate_merge") in codes
    assert ("e", "4", "missing_field") in codes and ("e", "4", "missing_source") in codes
    assert not any(c in ("option_shape", "answer_text", "broken_ocr", "invalid_badge") for d, _, c in codes if d == "d")
    proof = spark.createDataFrame([("Exam A", [2021]), ("Exam B", [2018])], "source string, years array<int>")
    years = {(r.number, r.code) for r in validate.year_rules(blocks.where("doc_id = 'd'"), proof).collect()}
    assert ("2", "source_year_mismatch") in years and ("1", "source_year_mismatch") not in years and ("1", "unknown_source") in years


def test_ocr_signals(spark):
    assert one(spark, quality.has_broken_spacing(F.col("t")), t="w h a t is the d r u g now")
    assert one(spark, quality.joined_words(F.col("t")), t="signsandsymptoms of anesthesia") == ["signsandsymptoms"]


def test_document_rules(spark):
    good = "\n\n".join(f"{h}\n\nbody" for h in validate.schema.SECTION_HEADINGS)
    docs = spark.createDataFrame([("ok", good), ("bad", good + "\n[1, 2] see notes.pdf\n> [!FOO] x\n")], "doc_id string, text string")
    assert {(r.doc_id, r.code) for r in validate.document_rules(docs).collect()} == {("bad", "leaked_citation"), ("bad", "leaked_file_name"), ("bad", "callout"), ("bad", "callout_body")}
    assert markdown.sections(docs).where("doc_id = 'ok'").count() == 5


def sources(spark):
    local = spark.createDataFrame(
        [("a.pdf", "A.pdf", "use", ["h1"]), ("b.pdf", "b.pdf", "use", []), ("c.pdf", "c.pdf", "use", []), ("d.pdf", "d.pdf", "ignore", []), ("e.pdf", "e.pdf", "use_remote", []), ("f.pdf", "f.pdf", "use", ["h1"])],
        "relative_path string, name string, preparation_action string, hashes array<string>",
    ).withColumns({"prepared_name": F.lit(""), "original_name": F.lit("")})
    remote = spark.createDataFrame(
        [("1", "a.txt", "", "2"), ("2", "b.pdf", "", ""), ("3", "b 0123456789ab.pdf", "", "ready"), ("4", "c.pdf", "", "1"), ("5", "f.pdf", "h2", "ready"), ("6", "a.docx", "", "ready")],
        "source_id string, title string, content_hash string, status string",
    ).withColumn("notebook_uuid", F.lit("n"))
    return local, remote


def test_deduplication_plan(spark):
    found = {r.relative_path: (r.decision, r.source_ids) for r in match.deduplication_plan(*sources(spark)).collect()}
    assert found == {"a.pdf": ("duplicate", ["1"]), "b.pdf": ("ambiguous", ["2", "3"]), "c.pdf": ("missing", []), "e.pdf": ("duplicate", []), "f.pdf": ("missing", [])}


def test_catalog_and_years(spark):
    local, remote = sources(spark)
    local = local.withColumns({"role": F.lit("past_exam"), "years": F.array(F.lit(2020))})
    rows = {r.canonical_name: r.content_status for r in match.evidence_catalog(local, remote).collect()}
    assert rows["A.pdf"] == "available" and rows["c.pdf"] == "local_only" and rows["a.docx"] == "remote_only"
    assert match.year_map(match.evidence_catalog(local, remote)).first()["names"] == ["A.pdf", "b.pdf"]


def test_names_and_topics(spark):
    have = spark.createDataFrame([("Heart.pdf",), ("heart.txt",), ("Lung.pdf",)], ["name"])
    want = spark.createDataFrame([("heart.pdf",), ("Lung.docx",), ("heart.m4a",), ("x",)], ["name"])
    assert {r.request: r.resolution for r in match.resolve_names(want, have).collect()} == {"heart.pdf": "unique", "Lung.docx": "unique", "heart.m4a": "ambiguous", "x": "not_found"}
    exams, banks = spark.createDataFrame([("Heart final 2020",), ("Other",)], ["name"]), spark.createDataFrame([("heart bank",), ("lung bank",)], ["name"])
    assert sorted(map(tuple, match.link_by_topic(exams, banks).collect())) == [("Heart final 2020", "heart bank"), ("Other", "heart bank"), ("Other", "lung bank")]
    assert match.best_by_tokens(exams, banks).collect()[0].candidate == "heart bank"


def test_preflight_and_rollup(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    was = spark.createDataFrame([("a", "1", ""), ("b", "x", ""), ("d", "4", ""), ("e", "5", "ignored")], "path string, sha256 string, status string")
    assert sorted(map(tuple, sync.preflight(now, was).collect())) == [("b", "changed"), ("c", "new"), ("d", "removed")]
    rows = spark.createDataFrame([("a", "unchanged"), ("a", "changed"), ("b", "processing"), ("c", "not-approved")], "path string, status string")
    assert dict(map(tuple, sync.rollup(rows).collect())) == {"a": "changed", "b": "unchanged", "c": "not-approved"}


UPDATES = [("k", i, s, None) for i, s in enumerate(["queued", "running", "failed", "queued", "running", "running"])] + [("bad", 0, "verified", None), ("bad", 1, "queued", "a1")]


def test_ledger(spark):
    rows = spark.createDataFrame(UPDATES, "lecture_key string, seq long, status string, agent_id string").withColumns({c: F.lit(None).cast("string") for c in ("run_id", "artifact_path", "reason")})
    found = {r.lecture_key: r for r in ledger.fold(rows).collect()}
    assert (found["k"].status, found["k"].attempts, found["k"].rejected) == ("running", 2, 0)
    assert (found["bad"].status, found["bad"].rejected, found["bad"].agent_id) == ("queued", 1, "a1")


def test_ledger_stream(spark, tmp_path):
    from fascicle.streaming.ledger import stream

    rows = spark.createDataFrame(UPDATES, "lecture_key string, seq long, status string, agent_id string").drop("agent_id")
    rows.write.parquet(str(tmp_path / "in"))
    q = stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("ledger_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    last = spark.table("ledger_out").groupBy("lecture_key").agg(F.max_by("status", "seq").alias("s"), F.max("attempts").alias("a")).collect()
    assert {(r.lecture_key, r.s, r.a) for r in last} == {("k", "running", 2), ("bad", "queued", 0)}


def test_stale_phases(spark):
    cols = "run_id string, title string, recordings string, slides string, assessments string, style string"
    was = checkpoint.phase_fingerprints(spark.createDataFrame([("r", "t", "a", "b", "c", "d")], cols)).withColumn("status", F.lit("validated"))
    now = checkpoint.phase_fingerprints(spark.createDataFrame([("r", "t", "a", "b", "NEW", "d")], cols))
    assert sorted(r.phase for r in checkpoint.stale(now, was).collect()) == ["mcqs", "written"]


def test_cards(spark):
    docs = spark.createDataFrame([("d", f"# T\n\n## MCQ\n{MCQ}\n## Written\n### Question 1 **[IMP]**\n**Question:** Define shock\n**Model Answer:** - one\n- two\n")], "doc_id string, text string")
    rows = cards.extract(docs)
    assert rows.count() == 4
    kept = {r.front: r for r in cards.first_wins(rows, "front", ["kind", "ordinal"]).collect()}
    assert len(kept) == 3 and kept["Define shock"].back_bullets == ["one", "two"] and kept["Define shock"].category == "def" and kept["Define shock"].badge == "IMP"


def test_batches(spark):
    rows = spark.createDataFrame([("p", i, f"s{i:02}") for i in range(1, 13)], "project_id string, ordinal int, source_id string")
    out = merge.question_scope(rows).orderBy("batch").collect()
    assert [len(r.source_ids) for r in out] == [3] * 4 and out[0].source_ids == ["s01", "s02", "s03"]


def test_rewriting(spark):
    assert one(spark, rewrite.table_spacing(F.col("t")), t="\n| x |\na  \n| b |\n|c|\n\n| d |\n") == "| x |\na\n\n| b |\n|c|\n\n| d |"
    assert one(spark, rewrite.table_spacing(F.col("t")), t="") == ""
    assert one(spark, rewrite.cleaned(F.col("t")), t="[AI-GENERATED x]\nThoughts\nA fact [1, 2] .\nlet me know if you like\nB") == "A fact .\n\nB"
    long = "first line\n" + "x" * 60
    assert one(spark, rewrite.truncated(F.col("t"), 50), t=long) == f"first line\n{rewrite.OMITTED}"
    assert one(spark, rewrite.truncated(F.col("t"), 50), t="y" * 60) == "y" * 18 + f"\n{rewrite.OMITTED}"
    assert one(spark, rewrite.truncated(F.col("t"), 10), t=long) == "first line"
    assert one(spark, rewrite.compact_context(F.col("t"), 60), t="Canonical: a\nother\nCanonical: a\n- 2020: b\n" + "z" * 99) == "Canonical: a\n- 2020: b"
    assert one(spark, rewrite.empty_note(F.col("t"), "none"), t=" NO_GROUNDED_MCQS\n") == "> [!NOTE]\n> none"


def test_provenance(spark, blocks):
    catalog = spark.createDataFrame(
        [("Exam A.pdf", ["exam a"], "past_exam", [2021], "available"), ("Bank.pdf", ["bank"], "question_bank", [], "available"), ("Exam B.pdf", [], "past_exam", [2018], "available"), ("exam b.txt", [], "past_exam", [2019], "available"), ("old.pdf", [], "past_exam", [], "local_only")],
        "canonical_name string, aliases array<string>, role string, verified_years array<int>, content_status string",
    )
    names = spark.createDataFrame([("Exam A",), ("exam b.pdf",), ("EXAM B",), ("old",), ("",)], ["source"])
    assert sorted((r.source, r.canonical_name) for r in provenance.catalog_matches(names, catalog).collect()) == [("EXAM B", "Exam B.pdf"), ("EXAM B", "exam b.txt"), ("Exam A", "Exam A.pdf"), ("exam b.pdf", "Exam B.pdf")]
    found = {(r.doc_id, r.number, r.code, r.message) for r in provenance.provenance_rules(blocks, catalog).collect()}
    codes = {(d, n, c) for d, n, c, _ in found}
    assert ("d", "1", "source_role_mismatch", "a question-bank source needs its badge") in found and ("d", "1", "source_year_mismatch") not in codes
    assert ("d", "2", "ambiguous_source", "Exam B") in found and ("d", "2", "missing_supported_year") in codes
    assert not any(n == "3" for _, n, _ in codes) and ("e", "4", "missing_badge") in codes and ("e", "4", "missing_source") in codes


def test_approvals_and_conflicts(spark):
    asked = spark.createDataFrame([("a.pdf",), ("Exams/B.pdf",), ("../x/y",), ("no.pdf",), ("two.pdf",), ("c.pdf",), ("C.PDF",)], ["name"])
    missing = spark.createDataFrame([("Lecture/a.pdf", "a.pdf"), ("Exams/b.pdf", "b.pdf"), ("p/two.pdf", "two.pdf"), ("q/two.pdf", "two.pdf"), ("c.pdf", "c.pdf")], ["relative_path", "name"])
    found = {r.name.lower(): (r.relative_path, r.error) for r in provenance.approved_uploads(asked, missing).collect()}
    assert found == {"a.pdf": ("Lecture/a.pdf", None), "exams/b.pdf": ("Exams/b.pdf", None), "../x/y": (None, "escapes"), "no.pdf": (None, "not_found"), "two.pdf": (None, "ambiguous"), "c.pdf": (None, "repeated")}
    local, remote = sources(spark)
    local = local.withColumns({"preparation_action": F.lit("convert"), "prepared_sha256": F.lit("h1")})
    assert [tuple(r) for r in provenance.prepared_conflicts(local, remote, "n").collect()] == [("f.pdf", ["5"], False)]
    bad = spark.createDataFrame([("1", "mcq", "no"), ("2", "mcq", "NO_GROUNDED_MCQS"), ("3", "mcq", "x" * 60 + " Timed out"), ("4", "mcq", None)], "doc_id string, kind string, answer string")
    assert {(r.doc_id, r.code) for r in provenance.answer_rules(bad).collect()} == {("1", "short_answer"), ("3", "error_payload"), ("4", "short_answer")}
    told = lambda m, ids: one(spark, provenance.source_rejected(F.col("m"), F.col("s")), m=m, s=ids)
    assert told("Query request is invalid: source IDs", ["Q7"]) is False and told("query request is invalid for a1", ["A1"]) and told("bad source id", ["z9"]) and not told("bad source id", ["z9", "z8"])


def test_docx_round_trip(spark, tmp_path):
    from fascicle.sources import docx

    text = "# Title\n\n> [!NOTE] mind **this**\n\n- item\n| a | b |\n|---|---|\n| c & d |\n\nلا \x01 <end>\n---"
    docs = spark.createDataFrame([("one", text), ("empty", None)], "name string, text string")
    docx.write_docx(docs, str(tmp_path / "out"))
    (tmp_path / "out" / "bad.docx").write_bytes(b"no zip")
    rows = {os.path.basename(r.path): (r.text, r.error) for r in docx.read_docx(spark, str(tmp_path / "out")).collect()}
    assert rows == {"one.docx": ("Title NOTE: mind  this • item a b c & d لا  <end>", None), "empty.docx": ("", None), "bad.docx": (None, "BadZipFile")}


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_driver_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    wanted, got = con.execute(plans.SQL[name]).df(), plans.QUERIES[name](spark, SF).toPandas()
    rows = lambda d: sorted(map(str, d[sorted(d.columns)].astype(object).itertuples(index=False, name=None)))
    assert rows(got) == rows(wanted)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_top1_topic_score_counts_short_words(spark, tmp_path):
    import re

    from fascicle.operators.match import GENERIC
    from fascicle.plans import queries

    docs = [(1, "red fox ran"), (2, "final exam 2020"), (3, "Enumeration of red cats"), (4, None), (5, "an ox"), (6, "red fox cats")]
    items = [(1, "Red cats; fox"), (2, "red fox 2020 final exam"), (3, "enumeration only")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    tokens = lambda t: {w for w in re.findall(r"[a-z0-9]+", (t or "").lower()) if len(w) >= 3 and w not in GENERIC and not re.fullmatch(r"\d{4}", w)}
    want = {}
    for doc, text in docs:
        score, item = max((len(tokens(text) & tokens(t)), -i) for i, t in items)
        if score:
            want[doc] = (-item, score)
    assert {r.doc_id: (r.item_id, r.score) for r in queries.doc_top1_topic_score(spark, str(tmp_path)).collect()} == want


def test_top1_topic_score_parts_grow_with_the_pairs(spark, tmp_path, monkeypatch):
    from fascicle.plans import queries

    monkeypatch.setattr(queries, "PAIRS", 100, raising=False)
    spark.range(400).selectExpr("id AS doc_id", "concat('shared word', id) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(20).selectExpr("id AS item_id", "'shared' AS text").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.doc_top1_topic_score(spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == {(d, 0, 1) for d in range(400)}
    parts = [len(rows) for rows in got.rdd.glom().collect()]  # the task that scores a document's items ends with its row
    assert len(parts) >= 80 and max(parts) < 40


@pytest.mark.parametrize("words", [1 << 18, 3])  # one block of items, several
def test_top1_topic_score_odd_rows_in_blocks(spark, tmp_path, monkeypatch, words):
    from fascicle.plans import queries

    monkeypatch.setattr(queries, "BLOCK_WORDS", words, raising=False)
    least = -(2**63)
    docs = [(1, "red fox ran"), (1, "red hen"), (None, "blue fox"), (2, None), (3, "blue blue hen 2020"), (4, ""), (5, "hen"), (6, "owl question")]
    items = [(4, "red fox"), (4, "Red; hen"), (least, "fox ran"), (None, "blue hen"), (7, "blue hen 2020"), (8, None), (9, "exam 2020"), (10, "owl question"), (None, "owl")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(queries.SQL["doc_top1_topic_score"]).fetchall()
    rows = queries.doc_top1_topic_score(spark, str(tmp_path)).select("doc_id", "item_id", "score").collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want)) and (5, 4, 1) in want


def test_top1_topic_score_runs_blocks_apart(spark, tmp_path, monkeypatch):
    from fascicle.plans import queries

    monkeypatch.setattr(queries, "BLOCK_WORDS", 10, raising=False)
    spark.range(50).selectExpr("id AS doc_id", "concat('shared word', id) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(40).selectExpr("id AS item_id", "'shared' AS text").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.doc_top1_topic_score(spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == {(d, 0, 1) for d in range(50)}
    plan = got._jdf.queryExecution()
    # Four blocks: the documents' words shuffled once, each block's rows after it.
    assert plan.optimizedPlan().toString().count("RepartitionByExpression [doc_id") == 8
    assert plan.executedPlan().toString().split("== Initial Plan ==")[0].count("ReusedExchange") >= 3
