"""Streams with state by key: equal to the batch forms however the lines are cut into micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import logs, traces
from tidewater.session import Scratch
from tidewater.streaming import stateful

SCHEMA = "app string, pos long, line string"


def _lines():
    rng = random.Random(4)
    made = []
    for app in ("api", "job", None):
        at = 0
        for k in range(30):
            if k or app != "job":
                source, body = rng.choice([("APP/PROC/WEB/0", "started"), ("RTR/1", 'h - [x] "GET /a HTTP/1.1" 404 1'), ("APP/PROC/WEB/0", '{"level": "warn", "msg": "m"}'), ("APP/0", "")])
                made.append((app, at, f"2026-03-01T08:00:{k:02d}.00+0000 [{source}] {rng.choice(['OUT', 'ERR'])} {body}"))
                at += 1
            for _ in range(rng.randrange(3)):
                made.append((app, at, rng.choice(["  at frame", "caused by an error", "", "Retrieving logs for app x", "\tfatal"])))
                at += 1
    return made


@pytest.fixture()
def feed(spark, tmp_path):
    stateful.use_rocksdb(spark)
    (tmp_path / "in").mkdir()

    def put(rows, k):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k:03d}")

    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    return put, stream, tmp_path


def _drain(rows, path, checkpoint, mode):
    def put(found, batch):
        found.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    rows.writeStream.outputMode(mode).option("checkpointLocation", str(checkpoint)).foreachBatch(put).trigger(availableNow=True).start().awaitTermination()


FIELDS = ["app", "pos", "timestamp_raw", "source", "stream", "level", "message", "n_lines"]


def test_entries_over_batches(spark, feed):
    put, stream, tmp = feed
    rows = _lines()
    by_pos = sorted(rows, key=lambda r: (r[1], str(r[0])))
    cut = [by_pos[:70], by_pos[70:71], by_pos[71:]]
    want = {tuple(r) for r in logs.entries(spark.createDataFrame(rows, SCHEMA), "app", Scratch(spark, "t")).select(*FIELDS).collect()}
    assert any(r[0] is None for r in want)
    put(cut[0], 0)
    put(cut[1], 1)
    _drain(stateful.entries(stream()), tmp / "out", tmp / "cp", "update")
    put(cut[2] + cut[0][-3:], 2)  # a restart from the checkpoint, with lines that were there before
    _drain(stateful.entries(stream()), tmp / "out", tmp / "cp", "update")
    found = spark.read.option("basePath", str(tmp / "out")).parquet(f"{tmp}/out")
    last = found.groupBy("app", "id").agg(F.max_by(F.struct(*FIELDS[1:]), "n_lines").alias("r"), F.count("*").alias("times"), F.count_if(F.col("n_before") == 0).alias("new"))
    assert {tuple(r) for r in last.select("app", "r.*").collect()} == want
    assert last.where("new <> 1").count() == 0 and last.where("times > 1").count() > 0
    grown = found.where("n_before > 0")
    assert grown.where(~F.startswith("message", F.col("message_before"))).count() == 0 and grown.count() > 0
    assert stateful.only_new(found).count() == len(want)
    # entries that a filter shows: in the end those that it shows of the whole, each given once as new or newly visible
    severe = lambda level, message: level.isin("error", "fatal")
    shown = stateful.newly_visible(found, severe).groupBy("app", "id").count()
    assert shown.count() == sum(r[5] in ("error", "fatal") for r in want) and shown.where("count > 1").count() == 0


def test_entries_once_they_are_closed(spark, feed):
    put, stream, tmp = feed
    rows = _lines()
    want = {tuple(r) for r in logs.entries(spark.createDataFrame(rows, SCHEMA), "app", Scratch(spark, "t")).select(*FIELDS).collect()}
    for k in range(3):
        put([r for r in rows if r[1] * 3 // 60 == k], k)
    put([r for r in rows if r[1] * 3 // 60 > 2] or [("new", 0, "x")], 3)
    _drain(stateful.entries(stream(), closed_only=True), tmp / "out", tmp / "cp", "append")
    got = [tuple(r) for r in spark.read.parquet(f"{tmp}/out").select(*FIELDS).collect()]
    assert len(got) == len(set(got)) and set(got) <= want | {("new", 0, "N/A", "SYSTEM", "OUT", "info", "x", 1)}
    open_ = {r[0]: max(x[1] for x in want if x[0] == r[0]) for r in want}
    assert {r for r in want if r[1] != open_[r[0]]} <= set(got)


def test_state_is_bounded(spark, feed):
    put, stream, tmp = feed
    rows = _lines()
    put(rows[: len(rows) // 2], 0)
    put(rows[len(rows) // 2 :], 1)
    _drain(stateful.entries(stream(), keep_rows=4, keep_chars=50), tmp / "out", tmp / "cp", "update")
    want = [tuple(r) for r in logs.entries(spark.createDataFrame(rows, SCHEMA), "app", Scratch(spark, "t")).select(*FIELDS).collect()]
    last = {r for app in ("api", "job", None) for r in sorted((x for x in want if x[0] == app), key=lambda x: x[1])[-4:]}
    assert {tuple(r) for r in stateful.tail_rows(spark, str(tmp / "cp")).select(*FIELDS).collect()} == last
    texts = {app: "\n".join(line for a, _, line in rows if a == app)[-50:] for app in ("api", "job", None)}
    assert dict(tuple(r) for r in stateful.tail_text(spark, str(tmp / "cp")).collect()) == texts


def test_idle_key_gives_its_open_entry(spark, feed):
    put, stream, tmp = feed
    put([("a", 0, "one"), ("a", 1, "two"), ("b", 0, "three")], 0)
    put([("b", 1, "four")], 1)
    query = stateful.entries(stream(), idle_ms=1, closed_only=True).writeStream.outputMode("append").option("checkpointLocation", str(tmp / "cp")).format("memory").queryName("idle").start()
    try:
        for _ in range(60):
            if spark.table("idle").count() >= 2:
                break
            query.awaitTermination(1)
    finally:
        query.stop()
    found = {(r["app"], r["n_lines"], r["message"]) for r in spark.table("idle").collect()}
    assert ("a", 2, "one\ntwo") in found and any(r[0] == "b" for r in found)


def test_running_summary(spark, tmp_path):
    stateful.use_rocksdb(spark)
    schema = "app string, pos long, shown_url string, method string, status int, duration_ms double, at string"
    rng = random.Random(9)
    rows = [(rng.choice("ab"), k, f"/{rng.randrange(3)}", rng.choice(["GET", "PUT"]), rng.choice([200, 302, 404, 503, 99, None]), k / 2, f"t{k // 3:03d}") for k in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    stateful.running_summary(stream, lambda e: traces.url_summaries(e, "app"), f"{tmp_path}/out", f"{tmp_path}/cp", keep=12).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/batch=2").collect()}
    last = [r for app in "ab" for r in [x for x in rows if x[0] == app][-12:]]
    assert got == {tuple(r) for r in traces.url_summaries(spark.createDataFrame(last, schema), "app").collect()}
    for app, url, methods, total, *counts, status, duration, at in got:
        own = [r for r in last if r[0] == app and r[2] == url]
        assert total == len(own) == sum(counts) and methods == ",".join(sorted({r[3] for r in own}))
        assert counts == [*(sum(r[4] is not None and r[4] // 100 == k for r in own) for k in (2, 3, 4, 5)), sum(r[4] in (99, None) for r in own)]
        assert (status, duration, at) == (own[-1][4], own[-1][5], own[-1][6])
