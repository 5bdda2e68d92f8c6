"""Streams over several micro-batches and restarts equal the batch fold."""

import hashlib

from pyspark.sql import functions as F

from leafmill.operators.windows import chunk_summary
from leafmill.schemas import RUN_EVENTS
from leafmill.sources.files import hashed_files
from leafmill.streaming import chunks as SC
from leafmill.streaming import intake as SI
from leafmill.streaming import review as SR
from leafmill.streaming import runs as SN
from leafmill.streaming import state

EVENTS = [
    (1, "x", "agent_progress", "a", 0.1, "m", None),
    (2, "x", "agent_progress", None, 0.2, "m", None),
    (3, "x", "agent_progress", "b", None, "m", None),
    (4, "y", "agent_progress", "q", 0.5, "m", None),
    (5, "y", "agent_failed", None, None, "m", None),
    (6, "z", "note", None, None, "m", None),
]


def events(spark, rows):
    return spark.createDataFrame(rows, RUN_EVENTS).withColumn("created_at", F.timestamp_seconds(F.col("id")))


def stream(spark, path):
    return spark.readStream.schema(RUN_EVENTS).option("maxFilesPerTrigger", 1).parquet(path)


def test_run_state_over_batches(spark, tmp_path):
    log, out, ck = (str(tmp_path / n) for n in ("log", "out", "ck"))
    for part in (EVENTS[:2], EVENTS[2:4]):
        events(spark, part).coalesce(1).write.mode("append").parquet(log)
    SN.stream_run_state(stream(spark, log), out, ck).awaitTermination()
    seen = {r.run_id: r for r in SN.run_states(spark, out).collect()}
    assert (seen["x"].stage, seen["x"].progress, seen["x"].status) == ("b", 0.2, "running")
    # Restart with later events.
    events(spark, EVENTS[4:]).coalesce(1).write.mode("append").parquet(log)
    SN.stream_run_state(stream(spark, log), out, ck).awaitTermination()
    got = SN.run_states(spark, out)
    want = SN.fold_run_events(events(spark, EVENTS))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert {r.run_id: r.status for r in got.collect()} == {"x": "running", "y": "failed", "z": "running"}


def test_event_log_and_tail(spark, tmp_path):
    src, log, ck = (str(tmp_path / n) for n in ("src", "log", "ck"))
    events(spark, EVENTS).write.parquet(src)
    SN.event_append(stream(spark, src), log, ck).awaitTermination()
    SN.event_append(stream(spark, src), log, ck).awaitTermination()
    assert [r.id for r in SN.event_history(spark.read.parquet(log), "x").collect()] == [1, 2, 3]
    assert SN.event_tail(spark, log).isStreaming
    assert "rangepartitioning" not in SN.event_history(spark.read.parquet(log))._jdf.queryExecution().executedPlan().toString()


def test_replay_hands_over_without_loss_or_repeat(spark, tmp_path):
    log, out, ck = (str(tmp_path / n) for n in ("log", "out", "ck"))
    events(spark, EVENTS[:2]).write.parquet(log)
    past, following = SN.replay_and_follow(spark, log, "x")
    # Written between the replay's start and the tail's: the replay leaves it to the tail.
    events(spark, EVENTS[2:4]).write.mode("append").parquet(log)
    assert [r.id for r in past.collect()] == [1, 2]
    following.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    assert [r.id for r in spark.read.parquet(out).collect()] == [3]
    past, _ = SN.replay_and_follow(spark, log, "nobody")
    assert past.count() == 0


def test_state_ignores_the_clock_and_survives_a_killed_compaction(spark, tmp_path, monkeypatch):
    """Late rows, a fresh checkpoint, compactions and one that dies: always the fold of all events."""
    import time

    out = str(tmp_path / "out")
    parts = [EVENTS[3:5], EVENTS[:1], EVENTS[5:], EVENTS[1:3]]
    for i, part in enumerate(parts):
        monkeypatch.setattr(time, "time_ns", lambda i=i: 10**18 - i * 10**15)  # each later run at an earlier time
        log = str(tmp_path / f"log{i}")
        events(spark, part).coalesce(1).write.parquet(log)
        SN.stream_run_state(stream(spark, log), out, str(tmp_path / f"ck{i // 2}{i}")).awaitTermination()
        if i == 1:
            assert state.compact(spark, out, "run_id", buckets=4) == 1
    (tmp_path / "out" / "snapshot" / "version=2").mkdir()  # what a compaction that died leaves
    (tmp_path / "out" / "snapshot" / "version=2" / "half.parquet").write_bytes(b"PAR1")
    want = sorted(map(tuple, SN.fold_run_events(events(spark, EVENTS)).collect()))
    assert sorted(map(tuple, SN.run_states(spark, out).collect())) == want
    assert state.compact(spark, out, "run_id", buckets=4) == 2
    assert sorted(map(tuple, SN.run_states(spark, out).collect())) == want
    assert state.compact(spark, out, "run_id", buckets=4) == 2  # nothing new
    assert {r.run_id: r.error for r in SN.run_states(spark, out).collect()}["y"] == "m"


def test_reading_touches_one_snapshot_and_later_batches(spark, tmp_path):
    out = str(tmp_path / "out")
    for i in range(3):
        log = str(tmp_path / f"log{i}")
        events(spark, EVENTS[2 * i : 2 * i + 2]).coalesce(1).write.parquet(log)
        SN.stream_run_state(stream(spark, log), out, str(tmp_path / f"ck{i}")).awaitTermination()
        if i < 2:
            state.compact(spark, out, "run_id", buckets=4)
    files = [f.rsplit("/out/", 1)[1] for f in state.stored_states(spark, out, "run_id").inputFiles()]
    assert {f.split("/")[0] for f in files} == {"snapshot", "tail"} and {f.split("/")[1] for f in files if f.startswith("snapshot")} == {"version=2"}
    assert len({f.split("/")[1] for f in files if f.startswith("tail")}) == 1
    assert not (tmp_path / "out" / "snapshot" / "version=0").exists() and len(list((tmp_path / "out" / "manifest").glob("*.json"))) == 2
    one = state.stored_states(spark, out, "run_id", spark.createDataFrame([("x",)], "run_id string"), buckets=4)
    assert {r.run_id for r in one.collect()} == {"x"}
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().executedPlan().toString()


def test_edits_over_batches_equal_the_batch_fold(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    example = {"reaction_text": "", "tags": [""]}
    rows = [
        (5, "a", "edit", '{"reaction_text":"late","tags":[]}', None, 50),
        (1, "a", "review", '{"any":1}', "approved", 10),
        (2, "a", "edit", '{"reaction_text":"bad","tags":"t"}', None, 20),
        (3, "b", "review", None, "rejected", 30),
        (4, "b", "edit", '{"reaction_text":"again","tags":["x",""],"more":2}', "approved", 40),
        (6, "b", "edit", "[]", None, 60),
        (7, "c", "review", '{"any":2}', None, 70),
    ]
    schema = "seq long, reaction_id string, kind string, j string, review_status string, at long"
    for r in rows:
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(src)

    def shaped(df):
        return df.withColumn("payload", F.parse_json("j")).drop("j")

    patches = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    SR.stream_review(shaped(patches), out, ck, example).awaitTermination()
    batch = state.values(SR.partial_edits(shaped(spark.createDataFrame(rows, schema)), example), "reaction_id")
    told = [{r.reaction_id: (r.p, r.review_status, r.updated_at) for r in df.withColumn("p", F.to_json("payload")).collect()} for df in (state.current(spark, out, "reaction_id"), batch)]
    assert told[0] == told[1]
    assert told[0] == {
        "a": ('{"reaction_text":"late","tags":[]}', "pending", 50),
        "b": ('{"reaction_text":"again","tags":["x",null]}', "pending", 40),
        "c": ('{"any":2}', "edited", 70),
    }
    bad = {r.seq: list(r.errors) for r in SR.refused(shaped(spark.createDataFrame(rows, schema)), example).collect()}
    assert set(bad) == {2, 6} and bad[2] == ['tags expected "array", got "t"']


def test_intake_reads_the_folders_of_its_hashes(spark, tmp_path):
    out = str(tmp_path / "cat")
    rows = [(f"{i:02x}" + "0" * 62, f"{i}.pdf") for i in range(256)]
    known = spark.createDataFrame(rows, "sha256 string, filename string").withColumn("prefix", F.substring("sha256", 1, 2))
    whole = known.select(F.col("sha256").alias("id"), "filename", F.lit(None).cast("string").alias("file_path"), "sha256", F.lit(None).cast("int").alias("page_count"), F.lit(1).cast("bigint").alias("bytes"), F.lit("uploaded").alias("parse_status"), F.lit(None).cast("string").alias("parse_error"), "prefix")
    whole.coalesce(1).write.partitionBy("prefix").parquet(f"{out}/query_id=other/batch_id=0")
    read = SI.read_catalogue(spark, out).where(F.col("prefix").isin(["0a", "ff"]))
    assert {f.split("prefix=")[1][:2] for f in read.inputFiles()} >= {"0a"} and read.count() == 2
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [prefix" in plan

def test_intake_stream(spark, tmp_path):
    box, out, ck = tmp_path / "in", str(tmp_path / "cat"), str(tmp_path / "ck")
    box.mkdir()

    def run():
        SI.stream_intake(hashed_files(SI.watch_folder(spark, str(box))), out, ck).awaitTermination()
        return sorted(r.filename for r in SI.read_catalogue(spark, out).collect())

    (box / "a.pdf").write_bytes(b"one")
    (box / "b.pdf").write_bytes(b"two!")
    assert run() == ["a.pdf", "b.pdf"]
    (box / "late.pdf").write_bytes(b"one")
    (box / "c.PDF").write_bytes(b"three")
    assert run() == ["a.pdf", "b.pdf", "c.PDF"]
    assert run() == ["a.pdf", "b.pdf", "c.PDF"]


def test_intake_with_a_new_checkpoint(spark, tmp_path):
    box, out = tmp_path / "in", str(tmp_path / "cat")
    box.mkdir()

    def run(ck, initial=None):
        hashed = hashed_files(SI.watch_folder(spark, str(box)))
        SI.stream_intake(hashed, out, str(tmp_path / ck), initial).awaitTermination()
        return sorted((r.filename, r.bytes) for r in SI.read_catalogue(spark, out).collect())

    (box / "a.pdf").write_bytes(b"one")
    assert run("ck1") == [("a.pdf", 3)]
    (box / "b.pdf").write_bytes(b"two!")
    assert run("ck1") == [("a.pdf", 3), ("b.pdf", 4)]
    (box / "a.pdf").unlink()
    (box / "b.pdf").rename(box / "other.pdf")
    (box / "c.pdf").write_bytes(b"three")
    (box / "known.pdf").write_bytes(b"catalogued elsewhere")
    sha = hashlib.sha256(b"catalogued elsewhere").hexdigest()
    initial = spark.createDataFrame([(sha, "k.pdf", "/k.pdf", sha, 1, 20, "uploaded", None)], SI.CATALOGUE)
    want = [("a.pdf", 3), ("b.pdf", 4), ("c.pdf", 5)]
    assert run("ck2", initial) == want
    assert run("ck2") == want


def test_run_state_with_a_new_checkpoint(spark, tmp_path):
    log, other, out = (str(tmp_path / n) for n in ("log", "other", "out"))
    events(spark, EVENTS[:4]).coalesce(1).write.parquet(log)
    SN.stream_run_state(stream(spark, log), out, str(tmp_path / "ck1")).awaitTermination()
    events(spark, EVENTS[5:]).coalesce(1).write.parquet(other)
    SN.stream_run_state(stream(spark, other), out, str(tmp_path / "ck2")).awaitTermination()
    assert {r.run_id for r in SN.run_states(spark, out).collect()} == {"x", "y", "z"}


def test_chunk_progress_stream(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    rows = [("d", 1, "pending", 1), ("d", 2, "pending", 2), ("d", 1, "retrying", 3), ("d", 1, "completed", 4), ("d", 2, "failed", 5)]
    schema = "document_id string, chunk_ord int, status string, seq bigint"
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    updates = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    SC.stream_chunk_progress(updates, out, ck).awaitTermination()
    got = SC.progress(spark, out).first()
    want = chunk_summary(spark.createDataFrame([("d", 1, "completed"), ("d", 2, "failed")], "document_id string, chunk_ord int, status string")).first()
    assert got == want and got.overall == "chunks_done"


def test_current_runs(spark):
    runs = spark.createDataFrame([("x",), ("new",)], "run_id string").selectExpr(
        "run_id", "'doc' as document_id", "'running' as status", "'queued' as stage", "0.0D as progress", "timestamp_seconds(0) as updated_at"
    )
    got = {r.run_id: r for r in SN.current_runs(runs, SN.fold_run_events(events(spark, EVENTS))).collect()}
    assert (got["x"].stage, got["x"].progress) == ("b", 0.2)
    assert (got["new"].stage, got["new"].progress, got["new"].status) == ("queued", 0.0, "running")


def test_a_batch_is_made_of_several_files(spark, sf, monkeypatch):
    """No task holds a whole micro-batch; still there are three, and a key's rows stay together."""
    from leafmill.fixtures import q_stream

    monkeypatch.setattr(q_stream, "FILE_BYTES", 20_000)
    seen = []

    def save(batch, batch_id):
        files = batch.select("doc_id", "text", F.input_file_name().alias("f")).collect()
        seen.append(files)

    stream = q_stream._batches(spark, sf, "documents", "text")
    stream.writeStream.foreachBatch(save).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 3 and all(len({r.f for r in b}) > 1 for b in seen)
    want = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for b in seen for r in b) == sorted(want)
    homes = {}
    for b in seen:
        for r in b:
            homes.setdefault(r.text, set()).add(r.f)
    assert all(len(h) == 1 for h in homes.values())
