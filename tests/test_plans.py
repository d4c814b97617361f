"""Manifests, preparation plans, scopes and inventories on small tables of our own."""

from pyspark.sql import functions as F

from fascicle.operators import manifest, prepare, scope


def codes(df, subject=False):
    return sorted((r.manifest_id, r.code) for r in df.collect())


def test_lecture_manifests(spark):
    profile = '{"mcq": 1}'
    rows = spark.createDataFrame(
        [
            ("ok", ["a.m4a"], ["x.pdf", "Lecture/y.pdf"], profile, [("Questions/e.pdf", "past_exam", "2020", ["2020"]), ("Questions/b.pdf", "question_bank", None, None)], [("Lecture/r.pdf", "reference")]),
            ("names", ["a.m4a", "A.m4a "], ["../x", "Other/y.pdf", "z", "Z"], "{}", [], []),
            ("years", ["a"], None, profile, [("Questions/a", "past_exam", None, None), ("Questions/b", "question_bank", "2020", None), ("Questions/c", "past_exam", "2020", ["2021"]), ("Exams/d", "past_exam", "20x", None), ("questions/A", "ignore", None, None), ("Questions/./a", "ignore", None, None)], [("Notes/x", None), ("", None), ("Lecture/a", None), ("lecture/A", None)]),
            ("none", [], [], None, None, None),
        ],
        manifest.LECTURE,
    )
    found = codes(manifest.lecture_errors(rows))
    assert not any(m == "ok" for m, _ in found)
    assert [c for m, c in found if m == "names"] == ["no_style_profile", "repeated_recording", "repeated_upload", "upload_escapes", "upload_outside"]
    assert {c for m, c in found if m == "years"} == {"exam_without_year", "year_on_other_type", "year_conflict", "year_not_a_number", "assessment_outside", "repeated_assessment", "reference_outside", "reference_without_path", "repeated_reference"}
    assert [c for m, c in found if m == "none"] == ["no_recordings", "no_style_profile"]


def test_sync_and_module_manifests(spark):
    rows = spark.createDataFrame(
        [("ok", 1, "Heart", "heart", ["n"], [("Lecture/a.pdf", "slides", "use", True)]), ("bad", 2, "x", "heart", [" "], [("Lecture/a", None, "burn", None), ("lecture\\A", None, None, None), ("../b", None, "use", None), ("Else/c", None, "ignore", True)]), ("none", 1, "heart", "heart", None, [])],
        manifest.SYNC,
    )
    found = codes(manifest.sync_errors(rows))
    assert [c for m, c in found if m == "bad"] == ["blank_target", "ignored_upload", "invalid_path", "module", "path_outside", "repeated_source", "unknown_action", "version"]
    assert [x for x in found if x[0] != "bad"] == [("none", "no_sources")]
    modules = spark.createDataFrame([("heart-1", 1, "Heart", ["cardio"], [("n", "t")]), ("lung", 1, "Lung", ["Cardio "], [("n", "t"), ("n", "u")]), ("Bad_Id", 2, "", None, None)], manifest.MODULES)
    assert codes(manifest.module_errors(modules)) == [("Bad_Id", "display_name"), ("Bad_Id", "module_id"), ("Bad_Id", "no_notebooks"), ("Bad_Id", "schema_version"), ("heart-1", "shared_alias"), ("lung", "repeated_notebook"), ("lung", "shared_alias")]


def test_auto_manifest(spark):
    files = [("m", f) for f in ("Lecture/Kidney stones.pptx", "Lecture/kidney.pdf", "Lecture/Book.pdf", "Lecture/renal talk.mp3", "Lecture/.x.pdf", "Lecture/sub/kidney.pdf", "Questions/final 2019 2021.pdf", "Questions/mid 23.docx", "Questions/bank.txt", "Questions/x.exe")]
    asked = spark.createDataFrame([("m", "Kidney stones"), ("m", "Zzyx"), ("m", "Heart.MP3"), ("n", "Alone")], "module string, lecture string")
    out = {r.lecture: r for r in manifest.auto_manifest(asked, spark.createDataFrame(files, "module string, relative_path string"), {"kidney": "Renal"}).collect()}
    assert (out["Kidney stones"].slides, out["Kidney stones"].recordings, out["Kidney stones"].slug) == ("Lecture/Kidney stones.pptx", ["renal talk.mp3"], "kidney-stones")
    assert (out["Zzyx"].slides, out["Zzyx"].recordings) == ("Lecture/Book.pdf", ["Zzyx.mp3"])
    assert (out["Heart.MP3"].title, out["Heart.MP3"].recordings) == ("Heart", ["Heart.MP3"]) and (out["Alone"].slides, out["Alone"].assessments) == ("Lecture/Alone.pdf", [])
    assert [(a.relative_path, a.type, a.year) for a in out["Zzyx"].assessments] == [("Questions/bank.txt", "question_bank", None), ("Questions/final 2019 2021.pdf", "past_exam", 2021), ("Questions/mid 23.docx", "past_exam", 2023)]


def test_preparation_plan(spark):
    entry = lambda p, a="auto", t="", pages=None, size=1, ocr=False, g=0.0: (p, a, t, pages, size, None, ocr, g)
    rows = [entry("a.ppt"), entry("b.pptx"), entry("c.doc"), entry("d.txt"), entry("e.mkv"), entry("f.mp4"), entry("g.pdf", ocr=True), entry("h.pdf", g=0.5), entry("i.pdf", size=prepare.LARGE_BYTES + 1), entry("j.pdf", ocr=None), entry("k.pdf"),
            entry("l.docx", "ocr"), entry("m.pdf", "chunk"), entry("n.pdf", "chunk", pages=[1]), entry("o.mov", "convert"), entry("p.ppsx", "convert", "DOCX"), entry("q", "melt"), entry("../r.pdf", "use"), entry("S.pdf", "use"), entry("s.pdf", "use")]
    schema = "relative_path string, action string, target_format string, pages array<int>, size long, max_upload_bytes long, needs_ocr boolean, garbage_ratio double"
    out = {r.relative_path: (r.planned_action, r.target, r.error) for r in prepare.plan(spark.createDataFrame(rows, schema)).collect()}
    assert {k: v[:2] for k, v in out.items() if k < "l" and v[2] is None and k[0].islower()} == {
        "a.ppt": ("convert", ".pdf"), "b.pptx": ("use", ".pptx"), "c.doc": ("convert", ".pdf"), "d.txt": ("convert", ".pdf"), "e.mkv": ("convert", ".m4a"), "f.mp4": ("use", ".mp4"),
        "g.pdf": ("ocr", ".pdf"), "h.pdf": ("ocr", ".pdf"), "i.pdf": ("wait", ".pdf"), "j.pdf": ("ocr", ".pdf"), "k.pdf": ("use", ".pdf"),
    }
    assert {k: v[2] for k, v in out.items() if v[2]} == {"l.docx": "needs_pdf", "m.pdf": "needs_pages", "q": "unknown_action", "../r.pdf": "escapes", "S.pdf": "repeated", "s.pdf": "repeated"}
    assert out["n.pdf"][1] == ".pdf" and out["o.mov"][1] == ".m4a" and out["p.ppsx"][1] == ".docx"


def test_paths_and_equivalents(spark):
    files = spark.createDataFrame([("Lecture/a.pdf",), ("Questions/b.pdf",), ("Lecture/b.pdf",)], ["relative_path"])
    asked = spark.createDataFrame([("Lecture/a.pdf",), ("A.pdf",), ("b.pdf",), ("c.pdf",)], ["relative_path"])
    assert {r.relative_path: (r.found, r.error) for r in prepare.resolve_paths(asked, files).collect()} == {"Lecture/a.pdf": ("Lecture/a.pdf", None), "A.pdf": ("Lecture/a.pdf", None), "b.pdf": (None, "ambiguous"), "c.pdf": (None, "not_found")}
    local, remote = spark.createDataFrame([("a.pdf",), ("b.pdf",), ("c.pdf",)], ["name"]), spark.createDataFrame([("A 0123456789ab.docx",), ("b.mp3",)], ["title"])
    assert [r.name for r in prepare.remote_equivalents(local, remote).collect()] == ["a.pdf"]


def test_scopes_and_bisection(spark):
    remote = spark.createDataFrame([("p", "1", "A.pdf", "ready"), ("p", "2", "a.txt", "ready"), ("p", "3", "b.txt", ""), ("q", "4", "A.pdf", "2"), ("q", "5", "c", "1")], "notebook_uuid string, source_id string, title string, status string")
    titles = spark.createDataFrame([(1, "b.pdf"), (2, "a.pdf"), (3, "A.pdf"), (4, "c")], "ordinal int, title string")
    rows = scope.build_scope(titles, remote)
    assert sorted(map(tuple, rows.collect())) == [("p", 1, "3", "b.txt"), ("p", 2, "1", "A.pdf"), ("q", 1, "4", "A.pdf")]
    assert [r.source_name for r in scope.scope_names(rows, spark.createDataFrame([("p", "1"), ("p", "9")], "project_id string, source_id string")).collect()] == ["A.pdf"]
    bad = F.array(F.lit("s3"), F.lit("s6"))
    hit = F.arrays_overlap("source_ids", bad)
    ask = lambda b: b.select("project_id", "batch", F.array_join("source_ids", "+").alias("answer"), hit.alias("rejected"), F.when(hit, "rejected").alias("error"))
    batches = spark.createDataFrame([("p", 0, ["s1", "s2", "s3"]), ("p", 1, ["s4", "s5"]), ("p", 2, ["s6"])], "project_id string, batch int, source_ids array<string>")
    answers, gone = scope.bisect_scopes(batches, ask)
    assert sorted(r.answer for r in answers.collect()) == ["s1", "s2", "s4+s5"] and sorted(r.source_id for r in gone.collect()) == ["s3", "s6"]
    tries = spark.createDataFrame([("a", 1, None, False, "x"), ("b", 1, "e", False, ""), ("c", 3, "e", False, ""), ("d", 1, "e", True, ""), ("e", 2, "e", False, "text")], "request_id string, attempt int, error string, quarantined boolean, answer string")
    assert {r.request_id: (r.next, r.wait) for r in scope.retry_plan(tries).collect()} == {"a": ("done", None), "b": ("retry", 5), "c": ("stop", None), "d": ("stop", None), "e": ("stop", None)}


def test_quarantine_plan(spark):
    remote = spark.createDataFrame([("n", "1", "a.pdf"), ("n", "2x", "b.txt"), ("n", "3x", "c.pdf"), ("n", "3y", "C.pdf"), ("n", "5", "e 0123456789ab.pdf")], "notebook_uuid string, source_id string, title string")
    local = spark.createDataFrame([("L/a.pdf", "a.pdf", "slides"), ("L/b.pdf", "b.pdf", "slides"), ("L/c.pdf", "c.pdf", "slides"), ("L/e.pdf", "e.pdf", "slides"), ("M/e.pdf", "e.pdf", "slides"), ("L/d.pdf", "d.pdf", "ignore")], "relative_path string, name string, role string")
    asked = spark.createDataFrame([("n", "1", "zzz"), ("n", "2", "b.pdf"), ("n", "3", "c.pdf"), ("n", "4", "d.pdf"), ("n", "5", "e.pdf")], "notebook_uuid string, source_id string, source_name string")
    out = {r.source_id: (r.live_id, r.relative_path, r.error) for r in scope.quarantine_plan(asked, remote, local).collect()}
    assert out == {"1": ("1", "L/a.pdf", None), "2": ("2x", "L/b.pdf", None), "3": (None, None, "several live sources"), "4": (None, None, "no live source"), "5": ("5", None, "several local files")}


def test_inventories(spark):
    remote = spark.createDataFrame([("n", "2", "Talk.m4a", ""), ("n", "1", "talk.M4A", ""), ("n", "3", "Clip", "Video"), ("n", "4", "x.pdf", "pdf")], "notebook_uuid string, source_id string, title string, source_type string")
    found = scope.recording_inventory(remote)
    assert sorted((r.title, r.source_id) for r in found.collect()) == [("Clip", "3"), ("talk.M4A", "1")]
    assert [r.title for r in scope.pending_recordings(found, spark.createDataFrame([("TALK.md",)], ["name"])).collect()] == ["Clip"]
    books = spark.createDataFrame([("0a0a0a0a-0000-0000-0000-000000000001", "Heart"), ("b", "Lung"), ("c", "lung")], "id string, title string")
    asked = spark.createDataFrame([("see 0A0A0A0A-0000-0000-0000-000000000001",), ("heart",), ("Lung",), ("x",)], ["request"])
    assert sorted((r.notebook_id or "", r.error or "") for r in scope.find_notebooks(asked, books).collect()) == [("", "ambiguous"), ("", "not_found")] + [("0a0a0a0a-0000-0000-0000-000000000001", "")] * 2
    lectures = spark.createDataFrame([("Heart 1",), ("y",)], ["lecture"])
    assert {r.lecture: r.slides for r in scope.configured_slides(lectures, spark.createDataFrame([("heart_1", "s.pdf")], "lecture string, slides string")).collect()} == {"Heart 1": "s.pdf", "y": None}
    missing = spark.createDataFrame([("a.pdf", "past_exam"), ("b.pdf", "slides"), ("c.pdf", "slides")], "name string, role string")
    assert sorted(r.name for r in scope.required_missing(missing, spark.createDataFrame([("B.docx",)], ["name"])).collect()) == ["a.pdf", "b.pdf"]
    local = spark.createDataFrame([("a.pdf", "slides", "use", ""), ("b.exe", "slides", "use", ""), ("c.exe", "ignore", "use", ""), ("d.doc", "slides", "convert", "d.pdf")], "name string, role string, preparation_action string, prepared_name string")
    assert {r.name: r.support for r in scope.upload_split(local).collect()} == {"a.pdf": "supported", "b.exe": "unsupported", "c.exe": "ignored", "d.doc": "supported"}
