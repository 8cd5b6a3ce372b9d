import random
import time

import pytest
from pyspark.sql import functions as F

from cuegrid.operators.scenes import segment
from cuegrid.streaming.live import ROCKSDB, drop_repeats, live_scenes, live_sessions


def run(stream, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()


SCHEMA = "track_id string, seq long, start_ms long, end_ms long, ts timestamp"


def timed(spark, rows):
    made = spark.createDataFrame(rows, "track_id string, seq long, start_ms long, end_ms long")
    return made.withColumn("ts", F.timestamp_millis(F.col("start_ms") + 1_000_000_000))


def scenes_of(spark, tmp_path, name, batches, **options):
    """The stream's rows over micro-batches, and its query."""
    at = tmp_path / name
    for rows in batches:
        timed(spark, rows).coalesce(1).write.mode("append").parquet(str(at))
        time.sleep(0.05)  # files are taken by their time
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(at))
    q = live_scenes(stream, **options).writeStream.outputMode("append").format("memory").queryName(name).start()
    q.processAllAvailable()
    state = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    q.stop()
    return {(r["track_id"], r["seq"]): r["scene_no"] for r in spark.table(name).collect()}, state


@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_live_scenes_out_of_order_equal_batch_scenes(spark, tmp_path, rocksdb):
    rng = random.Random(3)
    rows = [("ab"[i % 2], i // 2, i * 900 + (4000 if i % 23 == 0 else 0), i * 900 + 4300) for i in range(160)]
    # each cue comes up to six places late, about five seconds
    came = sorted(rows, key=lambda r: rows.index(r) + rng.randint(0, 6))
    end = [("z", 0, 10_000_000, 10_000_100), ("z", 1, 10_100_000, 10_100_100)]
    batches = [came[k : k + 40] for k in range(0, 160, 40)] + [end[:1], end[1:]]
    got, _ = scenes_of(spark, tmp_path, "late_scenes", batches, late="30 seconds")
    want = {(r["track_id"], r["seq"]): r["scene_no"] for r in segment(spark.createDataFrame(rows, "track_id string, seq long, start_ms long, end_ms long")).collect()}
    assert {k: v for k, v in got.items() if k[0] != "z"} == want and max(want.values()) > 2


def test_idle_tracks_leave_no_state(spark, tmp_path, rocksdb):
    rows = [(f"t{i}", s, s * 1000, s * 1000 + 500) for i in range(20) for s in range(3)]
    clock = [("z", k, 1_000_000 * (k + 1), 1_000_000 * (k + 1) + 1) for k in range(3)]
    got, state = scenes_of(spark, tmp_path, "idle_scenes", [rows, *[[c] for c in clock]], late="1 second", idle_ms=60_000)
    assert {k: v for k, v in got.items() if k[0] != "z"} == {(t, s): 1 for t, s, _, _ in rows}
    assert state <= 8  # the clock's own; twenty tracks of three cues have left


def test_sessions_and_repeats(spark, tmp_path):
    schema = "user_id long, ts timestamp"
    spark.sql(
        "SELECT 1L user_id, timestamp_seconds(1000 + x) ts FROM (SELECT explode(array(0, 1, 1, 2, 20, 21, 500)) x)",
    ).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    run(live_sessions(stream()), "live_sessions_out", "complete")
    assert sorted(r["events"] for r in spark.table("live_sessions_out").collect()) == [1, 2, 4]
    run(drop_repeats(stream(), "ts", ["user_id", "ts"]), "repeats_out")
    assert spark.table("repeats_out").count() == 6
