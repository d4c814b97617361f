"""Normal forms, merged sections, finalized drafts and case rules on small texts of our own."""

from pyspark.sql import functions as F

from fascicle import schema
from fascicle.functions import keys
from fascicle.operators import checkpoint, finalize, quality, sync, validate
from fascicle.streaming import ledger

MCQ = """> ### MCQ 4 **[Past Exams - 2021]**
> **Question (verbatim):** Which bone? [3]
> **Options (verbatim):** a. Femur b. Tibia c. Ulna d. Rib
> **Source:** exam a
> **Correct Answer:** b. Tibia
> **Clinical Explanation (Egyptian Arabic):** because
"""


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def catalog(spark):
    return spark.createDataFrame(
        [("Exam A.pdf", ["exam a"], "past_exam", [2021], "available"), ("Exam B.pdf", ["exam b"], "past_exam", [2019], "available"), ("Bank.pdf", ["bank"], "question_bank", [], "available"), ("Old.pdf", ["old"], "past_exam", [], "available")],
        "canonical_name string, aliases array<string>, role string, verified_years array<int>, content_status string",
    )


def test_normal_form(spark):
    text = one(spark, finalize.normalized(F.col("b"), F.lit("mcq")), b=MCQ)
    assert text == "### MCQ 4 **[Past Exams - 2021]**\n**Question:** Which bone?\n**Options:**\n- **a.** Femur\n- **b.** Tibia\n- **c.** Ulna\n- **d.** Rib\n\n**Source:** exam a\n**Correct Answer:** b. Tibia\n**Clinical Explanation:** because"
    assert one(spark, finalize.normalized(F.col("b"), F.lit("mcq")), b=text) == text
    case = "> [!TIP]\n> **🩺 Clinical Case 2:** A\n> **Scenario:** s\n>**Model Answer (Short):** m [1, 2]"
    assert one(spark, finalize.normalized(F.col("b"), F.lit("case")), b=case) == "### Clinical Case 2 A\n**Scenario:** s\n**Model Answer:** m"
    assert one(spark, finalize.heading_without_badges(F.col("b")), b="### MCQ 1 **[Past Exams (2020) / IMP]** [IMP] x ") == "### MCQ 1 x"


def test_merge_takes_roles_and_years_of_the_catalog(spark):
    second = MCQ.replace("MCQ 4 **[Past Exams - 2021]**", "MCQ 9").replace("exam a", "Exam B and bank")
    imp = "### MCQ 2 **[IMP]**\n**Question:** Why?\n**Source:** old\n**Correct Answer:** a. X\n"
    rows = spark.createDataFrame([("d", "mcq", f"Lead\n\n{MCQ}\n{second}\n{imp}"), ("e", "written", "nothing here")], "doc_id string, kind string, answer string")
    out = {r.doc_id: r.answer for r in finalize.normalize_answers(rows, catalog(spark)).collect()}
    assert out["e"] == "nothing here" and out["d"].startswith("Lead\n\n### MCQ 1 **[Past Exams - 2019, 2021]** **[Question Bank]**\n\n**Question:** Which bone?\n")
    assert "**Source:** Exam A.pdf\n**Source:** Exam B.pdf\n**Source:** Bank.pdf\n**Correct Answer:** b. Tibia" in out["d"]
    assert "### MCQ 2\n\n**Question:** Why?\n**Source:** Old.pdf\n**Correct Answer:**" in out["d"]  # a past exam without years: no IMP


def draft(*bodies):
    return "# Title\n\n" + "\n\n".join(f"{h}\n\n{b}" for h, b in zip(schema.SECTION_HEADINGS, bodies))


def test_finalize(spark):
    good = draft("guide", "points", MCQ + "\n" + MCQ.replace("MCQ 4", "MCQ 5"), "NO_GROUNDED_WRITTEN_QUESTIONS", "cases")
    late = good.replace("- 2021]", "- 2020]").replace("MCQ 5 **[Past Exams - 2021]", "MCQ 5 **[Past Exams - 2020]")
    docs = spark.createDataFrame([("good", good), ("late", late), ("bad", good + "\nNEEDS_SOURCE_REVIEW"), ("none", None)], "doc_id string, text string")
    out = {r.doc_id: r for r in finalize.finalize(docs, 2026, catalog(spark)).collect()}
    assert out["good"].errors == [] and out["good"].text.count("### MCQ") == 1 and "### MCQ 1 **[Past Exams - 2021]**" in out["good"].text and "Source" not in out["good"].text and "[3]" not in out["good"].text
    assert [e.code for e in out["late"].errors] == ["source_year_mismatch"] and out["late"].text is None
    assert {e.code for e in out["bad"].errors} == {"review_marker"} and [e.code for e in out["none"].errors] == ["section_structure"]
    again = spark.createDataFrame([("good", out["good"].text)], "doc_id string, text string")
    assert finalize.finalize(again, 2026).first()["text"] == out["good"].text


def test_case_rules(spark):
    case = lambda n, badge="", more="": f"### Clinical Case {n} {badge}\n**Scenario:** s\n**Questions:** 1. a\n2. b\n**Model Answer:** m\n{more}"
    rows = spark.createDataFrame(
        [("ok", case(1, "**[Past Exams - 2020]**", "**Source:** Exam Y\n") + case(2, "**[IMP]**"), ["exam y.pdf", "Talk.m4a"]), ("one", case(1), []), ("loose", "> [!TIP]\n> **Scenario:** s\nfree\n---\n> [!TIP]\n> x", []),
         ("unproved", case(1, "**[Past Exams - 2021]**", "**Source:** Exam Y\n") + case(2).replace("Questions", "Asked") + case(3, "**[IMP]**") + "x" * 3600, ["Exam Y"]), ("null", None, None)],
        "doc_id string, answer string, source_names array<string>",
    )
    found = {(r.doc_id, r.number, r.code) for r in finalize.case_rules(rows, ["Exam Y.pdf"], {2020: ["Exam Y.pdf"]}, ["Talk.m4a"]).collect()}
    assert not any(d == "ok" for d, _, _ in found) and ("one", "", "too_few_cases") in found and ("loose", "", "unquoted_line") in found and ("loose", "1", "missing_field") in found
    assert {c for d, _, c in found if d == "unproved"} == {"source_year_mismatch", "missing_field", "missing_recording", "long_answer"}


def test_mended_rules(spark):
    from fascicle.functions import markdown

    rows = spark.createDataFrame([("a", "mcq", MCQ.replace("b. Tibia\n> **Clin", "e. Five\n> **Clin")), ("b", "mcq", MCQ.replace("> **Correct Answer:** b. Tibia\n", ""))], "doc_id string, kind string, answer string")
    found = {(r.doc_id, r.code) for r in validate.validate_blocks(finalize.question_blocks(rows), 2026).collect()}
    assert ("a", "answer_label") in found and ("b", "missing_field") in found
    assert one(spark, quality.has_broken_spacing(F.col("t")), t="ab " * 20_000) and not one(spark, quality.has_broken_spacing(F.col("t")), t="abcd " * 20_000)
    assert one(spark, keys.is_newer(F.col("a"), F.col("b")), a="v20260101120000", b="v20251231235959") and not one(spark, keys.is_newer(F.col("a"), F.col("b")), a="1.02", b="1.2")
    assert one(spark, keys.page_errors(F.col("n")), n="3, 5-3, x, 0, 7:8, 1 - 2") == ["5-3", "x", "0"] and one(spark, keys.page_numbers(F.col("n")), n="3, 5-3, 1 - 2") == [1, 2, 3]
    assert one(spark, keys.identity_key(F.col("a")), a="Mod\\Talk 1.M4A ") == one(spark, keys.identity_key(F.col("a")), a="mod/talk 1.m4a") != one(spark, keys.identity_key(F.col("a")), a="mod/talk ١.m4a")
    nulls = spark.createDataFrame([("a", None), (None, "a")], "x string, y string").select(keys.identity_key(F.col("x"), F.col("y")).alias("k")).distinct()
    assert nulls.count() == 2
    entries = one(spark, markdown.option_entries(F.col("t")), t="a. One b. Two a. Three")
    assert [(e.key, e.text) for e in entries] == [("a", "Three"), ("b", "Two")]


def test_notebook_ladder(spark):
    status = lambda execute=False, **v: one(spark, sync.notebook_status(*[F.col(c) for c in ("e", "n", "h", "w", "k", "a", "u", "x")], execute), **({"e": 0, "n": 0, "h": 0, "w": 0, "k": False, "a": "use", "u": True, "x": ".pdf"} | v))
    assert status(e=1, n=2) == "unchanged" and status(e=2) == "ambiguous"
    assert status(a="use_remote", n=1) == "accepted-remote" and status(a="use_remote", n=2) == "ambiguous"
    assert status(n=1, h=1, k=True, w=1) == "changed" and status(n=1, w=1) == "processing" and status(w=1) == "processing"
    assert status() == "planned-upload" and status(True) == "uploaded" and status(u=False) == "not-approved" and status(x=".exe") == "failed"
    assert status(True, a="convert", n=1, h=1, k=True) == "uploaded" and status(a="convert", n=1, h=1, k=True) == "changed"
    rows = lambda *s: spark.createDataFrame([(x,) for x in s], "status string")
    none, some = spark.createDataFrame([], "e string"), spark.createDataFrame([("x",)], "e string")
    told = lambda *a: sync.report_status(*a).first()[0]
    assert (told(rows(), some), told(rows("unchanged"), some), told(rows("changed")), told(rows("unchanged"), none), told(rows("unchanged"), none, True)) == ("blocked", "partial", "partial", "planned", "completed")
    assert {r.status: r.n for r in sync.report_counts(rows("a", "a", "b")).collect()} == {"a": 2, "b": 1, None: 3}


def test_notebook_statuses(spark):
    local = spark.createDataFrame([("a.pdf", "a.pdf", "use", ["h"], True), ("b.pdf", "b.pdf", "use", ["h"], True), ("c.pdf", "c.pdf", "use", [], False)], "relative_path string, name string, preparation_action string, hashes array<string>, approved boolean").withColumns({"prepared_name": F.lit(""), "original_name": F.lit("")})
    remote = spark.createDataFrame([("1", "a.pdf", "h", "ready", "n1"), ("2", "b.pdf", "x", "ready", "n1"), ("3", "a.pdf", "", "processing", "n2")], "source_id string, title string, content_hash string, status string, notebook_uuid string")
    books = spark.createDataFrame([("n1",), ("n2",)], "notebook_uuid string")
    found = {(r.path, r.notebook_uuid): r.status for r in sync.notebook_statuses(local, remote, books).collect()}
    assert found == {("a.pdf", "n1"): "unchanged", ("b.pdf", "n1"): "changed", ("c.pdf", "n1"): "not-approved", ("a.pdf", "n2"): "processing", ("b.pdf", "n2"): "planned-upload", ("c.pdf", "n2"): "not-approved"}


def test_checkpoints(spark):
    cols = "run_id string, title string, recordings string, slides string, assessments string, style string, manifest string"
    was = checkpoint.phase_fingerprints(spark.createDataFrame([("r", "t", "a", "b", "c", "d", "m1")], cols)).withColumn("status", F.lit("validated"))
    now = checkpoint.phase_fingerprints(spark.createDataFrame([("r", "t", "a", "b", "c", "d", "m2")], cols))
    assert sorted(r.phase for r in checkpoint.stale(now, was).collect()) == ["cases", "mcqs", "written"]
    saved = spark.createDataFrame([("r", "imp", "failed", "old", 1), ("r", "guide", "validated", "g", 1)], "run_id string, phase string, status string, answer string, saved long")
    newer = spark.createDataFrame([("r", "imp", "failed", "newer", 2)], saved.schema)
    table = checkpoint.save_phases(saved, newer)
    assert {r.phase: r.answer for r in table.collect()} == {"imp": "newer", "guide": "g"}
    given = lambda path: spark.createDataFrame([("r", "imp", path, "mended"), ("r", "guide", "r/g.md", "other")], "run_id string, phase string, path string, answer string")
    errors = lambda *p: spark.createDataFrame([("r", x) for x in p], "run_id string, phase string")
    done = lambda path, *e: {r.phase: (r.status, r.answer, r.rejected) for r in checkpoint.recover(table, given(path), errors(*e)).collect()}
    assert done("r/imp.md") == {"imp": ("repaired", "mended", None), "guide": ("validated", "g", "already accepted")}
    assert done("r/../x")["imp"] == ("failed", "newer", "outside the run's folder") and done("r/imp.md", "imp")["imp"] == ("failed", "newer", "not valid")


def test_stream_keeps_fields(spark, tmp_path):
    rows = spark.createDataFrame([("k", 1, "queued", "a1"), ("k", 2, "running", None)], "lecture_key string, seq long, status string, agent_id string")
    rows.write.parquet(f"{tmp_path}/in")
    q = ledger.stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("ledger_fields").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.seq, r.agent_id, r.reason) for r in spark.table("ledger_fields").orderBy("seq").collect()] == [(1, "a1", ""), (2, "a1", "")]
