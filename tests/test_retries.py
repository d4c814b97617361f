"""The retry ladder: decisions one by one, and as a stream whose timers give what is due."""

import time

from fascicle.streaming import retries

Q = "MCQs of the lecture\nlong manifest prose\nExtract every relevant MCQ from it"


def outcome(request, attempt=1, error="timed out", quarantined=False, answer="", phase="mcqs", query=Q):
    return (request, phase, query, attempt, error, quarantined, answer)


def told(o, compacted=False):
    return retries.decide(dict(zip([c.split()[0] for c in retries.OUTCOMES.split(", ")], o)), compacted, 3, 5.0)[:4:1]


def test_decisions():
    assert told(outcome("a", error=None)) == ("done", 1, Q, 0.0)
    assert told(outcome("a", quarantined=True)) == told(outcome("a", answer="text")) == ("stop", 1, Q, 0.0)
    assert told(outcome("a")) == ("wait", 2, Q, 5.0) and told(outcome("a", 2)) == ("wait", 3, Q, 10.0) and told(outcome("a", 3)) == ("stop", 3, Q, 0.0)
    refused = "Query request is INVALID"
    action, attempt, query, wait = told(outcome("a", error=refused))
    assert (action, attempt, wait) == ("ask", 2, 0.0) and query.startswith("MCQs of the lecture\n\n") and query.endswith("Extract every relevant MCQ from it") and "manifest" not in query
    assert told(outcome("a", error=refused), True) == ("wait", 2, Q, 5.0)
    assert told(outcome("a", error=refused, phase="guide"))[0] == "wait" and told(outcome("a", error=refused, query="no body"))[0] == "wait"


def test_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        folder = f"{tmp_path}/in"
        put = lambda rows: spark.createDataFrame(rows, retries.OUTCOMES).coalesce(1).write.mode("append").parquet(folder)
        put([outcome("ok", error=None), outcome("bad", quarantined=True), outcome("text", answer="x"), outcome("wait"), outcome("wording", error=retries.REFUSED)])
        stream = spark.readStream.schema(retries.OUTCOMES).parquet(folder)
        q = retries.ladder(stream, step=0.5).writeStream.format("memory").queryName("ladder").option("checkpointLocation", f"{tmp_path}/cp").start()
        seen = lambda: sorted((r.request_id, r.action, r.attempt) for r in spark.table("ladder").collect())

        def until(n):
            end = time.time() + 90  # batches follow one another while there may be timers, so none is the last
            while len(seen()) < n and time.time() < end and q.exception() is None:
                time.sleep(0.5)
            assert q.exception() is None
            return seen()

        first = [("bad", "stop", 1), ("ok", "done", 1), ("text", "stop", 1), ("wait", "ask", 2), ("wording", "ask", 2)]
        assert until(5) == first
        put([outcome("wait", 2), outcome("wording", 2, error=retries.REFUSED), outcome("ok", 2), outcome("wait", 1)])  # over and told: nothing
        assert until(7) == sorted([*first, ("wait", "ask", 3), ("wording", "ask", 3)])
        put([outcome("wait", 3), outcome("wording", 3, error=None)])
        assert until(9) == sorted([*first, ("wait", "ask", 3), ("wording", "ask", 3), ("wait", "stop", 3), ("wording", "done", 3)])
        q.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
