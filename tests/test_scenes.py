"""Scenes of long tracks over many tasks: maps of runs, and the same numbers as the fold."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuegrid.operators.scenes import chunk_map, fold_breaks, segment, segment_chunks

CUE = "track_id string, seq long, start_ms long, end_ms long, more string"


@pytest.mark.parametrize("seed", range(8))
def test_maps_of_runs_equal_the_fold(seed):
    rng = np.random.default_rng(seed)
    low, high = int(rng.integers(1, 12)), 0
    high = low + int(rng.integers(1, 20))
    gap = rng.random(int(rng.integers(1, 400))) < rng.choice([0.0, 0.05, 0.4, 1.0])
    left, opened = chunk_map(gap, low, high)
    none = np.zeros(len(gap), bool)
    for n in range(1, high + 1):
        # the first cue is in the scene already: n - 1 before it, and no pause
        g = gap.copy()
        g[0] = False
        if n - 1 >= high:
            continue
        made, behind, last = fold_breaks(g, none, n - 1, 7, low, high)
        if n - 1 == 0:  # an open scene of no cues: the first cue is its first
            assert made[0] == 7
        assert (left[n], opened[n]) == (behind, last - 7), n


def test_maps_compose():
    rng = np.random.default_rng(3)
    gap = rng.random(300) < 0.1
    whole = chunk_map(gap, 10, 30)
    a, b = chunk_map(gap[:120], 10, 30), chunk_map(gap[120:], 10, 30)
    for n in range(1, 31):
        held, more = a[0][n], a[1][n]
        opens = held >= 30 or (held >= 10 and gap[120])
        entry = 1 if opens else held + 1
        assert (whole[0][n], whole[1][n]) == (b[0][entry], more + opens + b[1][entry])


def rows(rng, tracks, most):
    out = []
    for t in tracks:
        at = 0
        for i in range(rng.randint(1, most)):
            at += rng.choice([0, 100, 2500, 3000, 5000])
            out.append((t, i * rng.choice([1, 1, 1]) + (i // 50) * 1000, at, at + 900, "m"))
            at += 900
    return out


@pytest.mark.parametrize("chunk", [1, 7, 64, 1000, 10**9])
def test_many_tasks_equal_one(spark, chunk):
    cues = spark.createDataFrame(rows(random.Random(4), ["a", "b", "c", None], 400), CUE).repartition(5)
    want = {(r["track_id"], r["seq"]): r["scene_no"] for r in segment(cues).collect()}
    out = segment_chunks(cues, chunk)
    assert out.columns == [*cues.columns, "scene_no"]
    assert {(r["track_id"], r["seq"]): r["scene_no"] for r in out.collect()} == want
    assert segment_chunks(cues.limit(0), chunk).count() == 0


def test_unknown_times_are_no_pause(spark):
    made = [("t", i, None if i % 9 == 0 else i * 4000, None if i % 7 == 0 else i * 4000 + 500, "m") for i in range(200)]
    cues = spark.createDataFrame(made, CUE)
    want = {r["seq"]: r["scene_no"] for r in segment(cues).collect()}
    assert {r["seq"]: r["scene_no"] for r in segment_chunks(cues, 16).collect()} == want


def test_one_track_of_many_cues(spark):
    n = 300_000
    one = spark.range(n).select(F.lit("t").alias("track_id"), F.col("id").alias("seq"), (F.col("id") * 3000 + F.pmod(F.xxhash64("id"), F.lit(2900))).alias("start_ms"))
    one = one.withColumn("end_ms", F.col("start_ms") + 400)
    out = segment_chunks(one, 20_000)
    joined = out.join(segment(one).select("seq", F.col("scene_no").alias("want")), "seq")
    assert joined.where("scene_no <> want").count() == 0 and joined.count() == n
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
