"""The ledger's fold, containment joins, evidence, bisection, payloads and canonical JSON against plain versions."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fascicle import schema
from fascicle.functions import canonical
from fascicle.operators import containment, ledger, provenance, scope
from fascicle.sources import payloads

UPDATES = "lecture_key string, seq long, status string, agent_id string, run_id string, artifact_path string, reason string"


def folded(rows):
    out = {}
    for key, _, status, *fields in sorted(rows, key=lambda r: (r[0], r[1])):
        s = out.setdefault(key, ["manifest_ready", 0, 0, "", "", "", ""])
        if status == s[0] or status in schema.LEDGER_TRANSITIONS[s[0]]:
            s[1] += status == "running" and s[0] != "running"
            s[0] = status
            for i, f in enumerate(fields):
                s[3 + i] = s[3 + i] if f is None else f
        else:
            s[2] += 1
    return {k: tuple(v) for k, v in out.items()}


def test_ledger_slices_agree(spark):
    rng = random.Random(4)
    states = list(schema.LEDGER_TRANSITIONS)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b"]), i, rng.choice(states + ["running", "queued", "draft_ready"] * 3 + [None]), *[rng.choice([None, None, f"v{i}"]) for _ in range(4)]) for i in range(1500)]
    want = folded(rows)
    df = spark.createDataFrame(rows, UPDATES).repartition(5)
    for parts in (1, 7, 64):
        got = {r[0]: tuple(r)[1:] for r in ledger.fold(df, parts=parts).collect()}
        assert got == want
    deep = ledger.composed(ledger.slices(df, 64), 64, fan=3)
    last = F.element_at("map", ledger.STATES.index("manifest_ready") + 1)
    assert {r.lecture_key: (r.s.status, r.s.attempts) for r in deep.select("lecture_key", last.alias("s")).collect()} == {k: v[:2] for k, v in want.items()}
    hot = ledger.slices(df, 64).where("lecture_key = 'hot'").count()
    assert hot > 20  # a key with most of the updates is dealt over many slices
    assert not ledger.fold(df.limit(0)).collect()


def test_containment_equals_all_pairs(spark):
    rng = random.Random(6)
    name = lambda: " ".join(rng.choice(["heart", "lung", "exam", "final", "a", "b7", "é", "kidney stones", "2020", "x"]) for _ in range(rng.randint(0, 4))) + rng.choice(["", ".pdf", ".txt"])
    names, expected = [name() for _ in range(1000)] + ["", None], [name() for _ in range(1000)] + ["", "!!", None]
    a, b = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(n,) for n in expected], "name string")
    from fascicle.functions.keys import source_key, source_stem

    keys = {r[0]: (r[1], r[2]) for r in a.union(b).select(F.coalesce("name", F.lit("")).alias("n")).distinct().select("n", source_key(F.col("n")), source_stem(F.col("n"))).collect()}
    want = {(x or "", y or "") for x in set(names) for y in set(expected) if keys[x or ""][1] == keys[y or ""][1] or keys[x or ""][0] in keys[y or ""][0] or keys[y or ""][0] in keys[x or ""][0]}
    out = containment.fuzzy_matches(a, b)
    assert {tuple(r) for r in out.collect()} == want and out.count() == len(want)
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert not containment.fuzzy_matches(a.limit(0), b).collect()


def test_evidence_falls_back_to_names_alike(spark):
    catalog = spark.createDataFrame([("Final 2020.pdf", ["f20"], "past_exam", [2020], "available"), ("Gone.pdf", [], "slides", [], "missing")], "canonical_name string, aliases array<string>, role string, verified_years array<int>, content_status string")
    names = spark.createDataFrame([("F20",), ("midterm heart",), ("gone",), ("zzz",), (None,)], "source string")
    exams = spark.createDataFrame([(2019, "Heart"), (2021, "midterm heart.pdf"), (2018, "Lung")], "year int, name string")
    expected = spark.createDataFrame([("Heart",), ("Gone (copy).pdf",)], "name string")
    out = {(r.source, r.canonical_name): (r.role, r.verified_years) for r in provenance.source_evidence(names, catalog, exams, expected).collect()}
    assert out == {("F20", "Final 2020.pdf"): ("past_exam", [2020]), ("midterm heart", "Heart"): (None, [2019, 2021]), ("gone", "Gone (copy).pdf"): (None, [])}


def test_bisection_asks_each_scope_once(spark):
    asked = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def rejected(ids):
        asked.add(1)
        return "s3" in ids or "s6" in ids

    ask = lambda b: b.withColumn("rejected", rejected.asNondeterministic()("source_ids")).select("project_id", "batch", F.array_join("source_ids", "+").alias("answer"), "rejected", F.when(F.col("rejected"), "no").alias("error"))
    batches = spark.createDataFrame([("p", 0, [f"s{i}" for i in range(8)])], "project_id string, batch int, source_ids array<string>")
    answers, gone = scope.bisect_scopes(batches, ask)
    assert sorted(r.answer for r in answers.collect()) == ["s0+s1", "s2", "s4+s5", "s7"] and sorted(r.source_id for r in gone.collect()) == ["s3", "s6"]
    answers.count(), gone.count()
    assert asked.value == 11  # 8; 4, 4; 2, 2, 2, 2; s2, s3, s6, s7
    with pytest.raises(RuntimeError):
        scope.bisect_scopes(batches, ask, max_rounds=2)
    with pytest.raises(ValueError):
        scope.bisect_scopes(batches, lambda b: ask(b).limit(0))
    empty = scope.bisect_scopes(batches.limit(0), ask)
    assert not empty[0].collect() and not empty[1].collect()


def items(payload):
    """The sources of a payload, told plainly."""
    if isinstance(payload, list):
        return [e for e in payload if isinstance(e, dict)]
    if not isinstance(payload, dict):
        return []
    for key in ("sources", "items", "data", "results"):
        if isinstance(payload.get(key), list):
            return items(payload[key])
        if isinstance(payload.get(key), dict) and items(payload[key]):
            return items(payload[key])
    own = [v for v in payload.values() if isinstance(v, dict)]
    return own if own and all(any(t in v for t in payloads.TITLES) for v in own) else []


def test_payload_shapes(spark):
    s = lambda t, **more: {"title": t, **more}
    shapes = [
        [s("a"), 3, None, s("b")], {"sources": [s("a")]}, {"data": {"items": [s("x"), s("y")]}}, {"data": {"items": {"results": {"sources": [s("deep")]}}}}, {"sources": [], "items": [s("never")]}, {"data": {"sources": []}, "results": [s("later")]},
        {"u1": s("m"), "u2": {"name": "n"}}, {"u1": s("m"), "u2": {"other": 1}}, {"u1": s("m"), "k": 5}, {"data": {"u": s("mapped")}}, {"sources": None, "items": {"a": 1}}, 5, "text", None, {}, [], {"items": {"items": {"a": {"display_name": None}}}},
    ]
    rows = [(f"n{i}", json.dumps(p)) for i, p in enumerate(shapes)] + [("bad", "{"), ("none", None)]
    out = payloads.entries(spark.createDataFrame(rows, "notebook_uuid string, payload string")).select("notebook_uuid", "place", F.to_json("source").alias("source"), "error").collect()
    for i, p in enumerate(shapes):
        mine = [json.loads(r.source) for r in sorted((r for r in out if r.notebook_uuid == f"n{i}" and r.place is not None), key=lambda r: r.place)]
        assert mine == items(p), p
        assert [r.error for r in out if r.notebook_uuid == f"n{i}"] == ([None] * len(mine) or ["no_sources"]), p
    assert {r.notebook_uuid: r.error for r in out if r.notebook_uuid in ("bad", "none")} == {"bad": "not_json", "none": "not_json"}


def test_payload_fields(spark):
    entry = [{"id": 7, "title": " T ", "hash": " AB ", "status": 2}, {"source_id": "x", "id": "", "title": "", "name": "N.pdf", "sha256": None, "checksum": "c", "status": None, "state": " Ready "}, {"display_name": "D", "status": 3.0, "type": "pdf"}, {"title": 0, "id": 1}, {"source_name": "S", "status": True, "source_type": "audio"}, {"title": "U", "processing_status": 9}]
    rows, errors = payloads.inventory(spark.createDataFrame([("n", json.dumps(entry))], "notebook_uuid string, payload string"))
    got = sorted((r.source_id, r.title, r.source_type, r.content_hash, r.status) for r in rows.collect())
    assert got == sorted([("7", "T", "", "ab", "ready"), ("x", "N.pdf", "", "c", "ready"), ("", "D", "pdf", "", "error"), ("", "S", "audio", "", "true"), ("", "U", "", "", "9")])
    assert not errors.collect() and {r.normalized_stem for r in rows.collect()} == {"t", "n", "d", "s", "u"}


def test_canonical_json_equals_a_sorted_dump(spark):
    kind = T.StructType([T.StructField("b", T.StringType()), T.StructField("a", T.ArrayType(T.DoubleType())), T.StructField("é", T.MapType(T.StringType(), T.LongType())), T.StructField("Z", T.StructType([T.StructField("y", T.BooleanType()), T.StructField("x", T.IntegerType())]))])
    values = [0.0, -0.0, 1.0, 0.1, 1e16, 1e15, 123456789012345680.0, 1e-4, 9.9e-5, 1.5e-7, 1e100, -2.5e-310, 3.141592653589793, 100.0, 1e22, 12345.678, 1 / 3, 2.0**53, 5e-324, 1.7976931348623157e308]
    rng = random.Random(8)
    values += [rng.uniform(-1, 1) * 10.0 ** rng.randint(-20, 20) for _ in range(300)]
    texts = ['q"\\/', "\n\t\r\b\f\x01\x1f\x7f", "héé 日本 😀", "", None]
    rows = [{"b": t, "a": [*values, None], "é": {"k2": 1, "k1": None, "É": -5}, "Z": {"y": True, "x": None}} for t in texts] + [{"b": "x", "a": None, "é": {}, "Z": None}]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], T.StructType([T.StructField("i", T.IntegerType()), T.StructField("r", kind)]))
    out = df.select("i", canonical.canonical_json(F.col("r"), kind).alias("j"), canonical.json_hash(F.col("r"), kind).alias("h")).collect()
    for r in out:
        want = json.dumps(rows[r.i], ensure_ascii=False, sort_keys=True)
        assert r.j == want and r.h == hashlib.sha256(want.encode()).hexdigest()
