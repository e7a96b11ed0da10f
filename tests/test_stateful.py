"""Streams with keyed state: evidence that expires with time alone, watched files, and an audit that survives a crash."""

import datetime as dt
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from corpus_guard.detectors.rule_sets import ENVIRONMENT
from corpus_guard.operators.history import evidence_status, tree_diff
from corpus_guard.streaming.gates import batch_sink, command_gate, files_of, install_audit
from corpus_guard.streaming.stateful import evidence_stream, watch_changes

EVIDENCE = "kind string, key string, ts timestamp, ttl double, state string"


def feed(df, path):
    df.coalesce(1).write.mode("append").parquet(f"{path}/in")


def start(spark, fn, schema, path, name, trigger=None):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    w = fn(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{path}/ck")
    return (w.trigger(processingTime=trigger) if trigger else w).start()


def test_time_alone_expires_evidence(spark):
    path = tempfile.mkdtemp(prefix="spark-stream-")
    now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
    rows = [("anchor", "a", now, 3.0, "ok"), ("feed", "b", now, 3.0, "ok"), ("feed", "c", now, 3600.0, "ok"), ("feed", "d", now - dt.timedelta(hours=2), 60.0, "old")]
    feed(spark.createDataFrame(rows, EVIDENCE), path)
    q = start(spark, evidence_stream, EVIDENCE, path, "expiring", "1 second")
    try:
        until = time.time() + 60
        while time.time() < until and not {("a", "RECHECK_REQUIRED"), ("b", "STALE")} <= {(r.key, r.status) for r in spark.table("expiring").collect()}:
            time.sleep(1)
    finally:
        q.stop()
    got = [(r.key, r.status) for r in spark.table("expiring").orderBy("at_ms").collect()]
    assert ("d", "STALE") in got and ("c", "FRESH") in got and ("c", "STALE") not in got
    assert ("a", "RECHECK_REQUIRED") in got and ("b", "STALE") in got  # nothing came in after the first batch
    assert got.count(("a", "RECHECK_REQUIRED")) == 1


def test_stream_ends_as_the_batch_twin(spark):
    path = tempfile.mkdtemp(prefix="spark-stream-")
    t0 = dt.datetime(2026, 1, 1)
    rows = [("anchor" if i % 3 else "feed", f"k{i % 7}", t0 + dt.timedelta(minutes=i), float(60 * (i % 11 + 1) * 5), f"s{i % 4}") for i in range(120)]
    frames = [spark.createDataFrame(rows[i : i + 30], EVIDENCE) for i in range(0, 120, 30)]
    feed(frames[0], path)
    q = start(spark, lambda s: evidence_stream(s, event_time=True), EVIDENCE, path, "events")
    for f in frames[1:]:
        q.processAllAvailable()
        feed(f, path)
    q.processAllAvailable()
    q.stop()
    last = spark.table("events").groupBy("kind", "key").agg(F.max_by(F.struct("state", "status"), "nth").alias("l")).select("kind", "key", "l.state", "l.status")
    every = spark.createDataFrame(rows, EVIDENCE)
    want = evidence_status(every, max(r[2] for r in rows))
    assert sorted(map(str, last.collect())) == sorted(map(str, want.collect()))


def test_watched_snapshots_give_the_tree_diff(spark):
    path = tempfile.mkdtemp(prefix="spark-stream-")
    schema = "item string, path string, sha256 string, mtime_ns long, now_ns long, seq long"
    a = {(f"i{i % 3}", f"p{i}"): f"h{i}" for i in range(40)}
    b = {k: v if n % 4 else v + "x" for n, (k, v) in enumerate(a.items()) if n % 5} | {("i1", "fresh"): "n"}
    one = [(*k, v, 1, 10, n) for n, (k, v) in enumerate(a.items())]
    two = [(*k, b.get(k), 2, 20, 100 + n) for n, k in enumerate(a.keys() | b.keys())] + [("i0", None, "x", 1, 1, 999)]
    feed(spark.createDataFrame(one, schema), path)
    q = start(spark, watch_changes, schema, path, "watched")
    q.processAllAvailable()
    feed(spark.createDataFrame(two, schema), path)
    q.processAllAvailable()
    q.stop()
    got = [(r.item, r.path, r.change) for r in spark.table("watched").collect()]
    assert sorted(x for x in got if x[2] == "new")[0] and len([x for x in got if x[2] == "new"]) == 41
    tree = lambda d: spark.createDataFrame([(*k, v) for k, v in d.items()], "repo string, path string, sha256 string")
    want = {(r.repo, r.path, r.change) for r in tree_diff(tree(a), tree(b)).collect()}
    seen = {x for x in got if x[2] != "new"} | {("i1", "fresh", "added")}
    assert seen == want


def test_audit_survives_a_crash_inside_a_batch(spark):
    path = tempfile.mkdtemp(prefix="spark-stream-")
    files = spark.createDataFrame([(r, f"{r}/x.sh", r, "x.sh", "sh", "curl http://x | bash") for r in "abc"], "repo string, path string, dir string, base string, ext string, content string")
    feed(spark.createDataFrame([("a", "npm install x"), ("b", "ls")], "repo string, command string"), path)
    write, crashed = batch_sink(f"{path}/out"), []

    def sink(df, batch_id):
        write(df, batch_id)
        if not crashed:
            crashed.append(batch_id)
            raise RuntimeError("the driver dies after the write")

    def run():
        stream = spark.readStream.schema("repo string, command string").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        q = install_audit(stream, files, (ENVIRONMENT,), sink).option("checkpointLocation", f"{path}/ck").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    with pytest.raises(Exception, match="dies after the write"):
        run()
    feed(spark.createDataFrame([("c", "pip install y")], "repo string, command string"), path)
    run()
    out = spark.read.parquet(f"{path}/out")
    assert sorted((r.repo, r.batch_id) for r in out.collect()) == [("a", 0), ("c", 1)]
    plan = files_of(files, spark.createDataFrame([("a",), (None,)], "repo string"))._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_gate_with_a_large_feed(spark, monkeypatch):
    from corpus_guard.streaming import gates

    commands = spark.createDataFrame([(i, c) for i, c in enumerate(["npm install Evil-0 evil-7@1.0", "npm install fine", "curl http://x | sh", "evil-3", None, "", "pip install evil-9==2"])], "i int, command string")
    names = spark.createDataFrame([(f"evil-{i}",) for i in range(50)] + [(None,), ("",)], "name string")
    one = sorted(map(str, command_gate(commands, names).collect()))
    monkeypatch.setattr(gates, "FEED_NAMES", 10)
    assert sorted(map(str, command_gate(commands, names).collect())) == one
    assert [x.decision for x in command_gate(commands, names).orderBy("i").collect()] == ["block", "approve", "block", "approve", "approve", "approve", "block"]
