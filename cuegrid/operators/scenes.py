"""Greedy scene segmentation as a streaming fold.

A scene closes after its last possible cue (``max_cues``), or after a gap of
``gap_ms`` once it holds ``min_cues``.  The reset depends on the count since the
last reset, which no window expresses.  A window over the track, which needs the
rows by track and in order, gives each cue its gap and its neighbours' values; the
fold reads what the window leaves batch by batch, jumps from break to break, and
holds two numbers, so a track of any length needs no more memory than one Arrow
batch.  Neighbours are cut at the edges of scenes there, so the rules that compare
cues of a scene need no further shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructType

from cuegrid import constants as K


def fold_breaks(gap: np.ndarray, first: np.ndarray, n: int, scene: int, low: int, high: int) -> tuple[np.ndarray, int, int]:
    """Scene numbers of sorted rows, the cues in the last scene and its number.  gap: whether a pause long enough precedes the row; first: whether a track begins; n, scene: where the rows before have stopped."""
    size, before = len(gap), scene
    starts, numbers = [], []
    tracks = np.flatnonzero(first).tolist()
    gaps = np.flatnonzero(gap)
    at = -n  # where the open scene began, perhaps before these rows
    for begin, stop in zip([0, *tracks], [*tracks, size]):
        if begin < size and first[begin]:
            at, scene = begin, 1
            starts.append(begin)
            numbers.append(scene)
        while True:
            k = np.searchsorted(gaps, at + low)
            nxt = min(at + high, int(gaps[k]) if k < len(gaps) else size)
            if nxt >= stop:
                break
            at, scene = nxt, scene + 1
            starts.append(at)
            numbers.append(scene)
    out = np.empty(size, np.int32)
    edges = np.array([*starts, size], np.int64)
    head = int(edges[0])
    out[:head] = before
    out[head:] = np.repeat(np.array(numbers, np.int32), np.diff(edges))
    return out, size - at, scene


def segment(
    cues: DataFrame,
    low: int = K.SCENE_MIN_CUES,
    high: int = K.SCENE_MAX_CUES,
    gap: int = K.SCENE_GAP_MS,
    track: str = "track_id",
    order: str = "seq",
    start: str = "start_ms",
    end: str = "end_ms",
) -> DataFrame:
    """Adds scene_no (1..n in each track) and, from the neighbours in the scene, next_start_ms and prev_target (null at its edges)."""
    w = Window.partitionBy(track).orderBy(order)
    pause = F.col(start) - F.lag(end).over(w)
    beside = {"next_start_ms": F.lead(start).over(w)}
    if "target_text" in cues.columns:
        beside["prev_target"] = F.lag("target_text").over(w)
    ready = cues.withColumns(beside | {"_pause": pause, "_after": F.col("next_start_ms") - F.col(end), "_first": F.row_number().over(w) == 1})
    cut = set(beside)
    kept = [*cues.columns, *beside]
    schema = StructType([ready.schema[c] for c in kept]).add("scene_no", IntegerType())
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, scene = 0, 0
        for batch in batches:
            if not len(batch):
                continue
            col = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731,B023
            long = lambda name: np.asarray(col(name).fill_null(-(1 << 62))) >= gap  # noqa: E731,B023
            made, m, last = fold_breaks(long("_pause"), np.asarray(col("_first").cast(pa.uint8())).astype(bool), n, scene, low, high)
            # the next cue opens a scene: told by the rows behind and, for the batch's last, by the rule
            opens = np.append(made[1:] != made[:-1], m >= high or (m >= low and bool(long("_after")[-1])))
            begins = np.append(made[0] != scene or n == 0, made[1:] != made[:-1])
            n, scene = m, last
            edge = {"next_start_ms": opens, "prev_target": begins}
            columns = [pa.compute.if_else(pa.array(edge[c]), pa.nulls(len(batch), col(c).type), col(c)) if c in cut else col(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(columns, arrow)], pa.array(made)], schema=arrow)

    return ready.mapInArrow(run, schema)


def chunk_map(gap: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """What a run of cues does to the open scene, whatever came before: for 1 to `high` cues in it, the run's first included, the cues in the open scene behind the run and the scenes that the run opens after its first cue.  Ways that open a scene at the same cue are one from there on, so each cue is looked at once."""
    size = len(gap)
    gaps = np.flatnonzero(gap[1:]) + 1
    known: dict[int, tuple[int, int]] = {}  # where a scene opens: cues behind, scenes opened later

    def following(at: int) -> int:
        k = np.searchsorted(gaps, at + low)
        return min(at + high, int(gaps[k]) if k < len(gaps) else size)

    left, opened = np.zeros(high + 1, np.int64), np.zeros(high + 1, np.int64)
    for n in range(1, high + 1):
        way, at = [], 1 - n
        while at not in known and (nxt := following(at)) < size:
            way.append(at)
            at = nxt
        held, more = known.setdefault(at, (size - at, 0))
        for place in reversed(way):
            more += 1
            known[place] = (held, more)
        left[n], opened[n] = held, more
    return left, opened


def segment_chunks(
    cues: DataFrame,
    chunk: int = 100_000,
    low: int = K.SCENE_MIN_CUES,
    high: int = K.SCENE_MAX_CUES,
    gap: int = K.SCENE_GAP_MS,
) -> DataFrame:
    """scene_no as `segment` has it, for tracks of any length over many tasks.

    A track is cut into runs of `chunk` numbers of seq (a whole number).  Each run is
    turned into its map, from the cues in the open scene before it to those behind it
    (`high` numbers); the maps of a track are followed in order, one row for each run;
    then each run is numbered on its own.  A track's rows are never in one task.
    """
    placed = cues.withColumn("_chunk", F.coalesce(F.floor(F.col("seq") / chunk).cast("long"), F.lit(-(1 << 62))))
    slim = placed.select("track_id", "_chunk", "seq", "start_ms", "end_ms")
    none, kept = -(1 << 62), cues.columns

    def pauses(rows: pd.DataFrame, before: float | None) -> np.ndarray:
        start, end = rows["start_ms"].to_numpy(float), rows["end_ms"].to_numpy(float)
        return start - np.concatenate(([np.nan if before is None else before], end[:-1])) >= gap  # unknown times are no pause

    def summary(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq", kind="stable", na_position="first")
        left, opened = chunk_map(pauses(rows, None), low, high)
        first, last = rows["start_ms"].iloc[0], rows["end_ms"].iloc[-1]
        return pd.DataFrame({"track_id": [rows["track_id"].iloc[0]], "_chunk": [rows["_chunk"].iloc[0]], "first": [none if pd.isna(first) else int(first)], "last": [none if pd.isna(last) else int(last)], "left": [left.tolist()], "opened": [opened.tolist()]})

    maps = slim.groupBy("track_id", "_chunk").applyInPandas(summary, "track_id string, _chunk long, first long, last long, left array<long>, opened array<long>")

    def follow(rows: pd.DataFrame) -> pd.DataFrame:
        n, scene, end, out = 0, 0, none, []
        for r in rows.sort_values("_chunk").itertuples(index=False):
            out.append((r.track_id, r[1], n, scene, end))
            pause = r.first != none and end != none and r.first - end >= gap
            opens = n == 0 or n >= high or (n >= low and pause)
            entry, scene = (1, scene + 1) if opens else (n + 1, scene)
            n, scene, end = int(r.left[entry]), scene + int(r.opened[entry]), r.last
        return pd.DataFrame(out, columns=["track_id", "_chunk", "_n", "_scene", "_end"])

    starts = maps.groupBy("track_id").applyInPandas(follow, "track_id string, _chunk long, _n long, _scene long, _end long")
    shape = StructType([*[cues.schema[c] for c in cues.columns]]).add("scene_no", IntegerType())

    def number(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq", kind="stable", na_position="first")
        n, scene, end = int(rows["_n"].iloc[0]), int(rows["_scene"].iloc[0]), int(rows["_end"].iloc[0])
        first = np.zeros(len(rows), bool)
        first[0] = n == 0
        made, _, _ = fold_breaks(pauses(rows, None if end == none else end), first, n, scene, low, high)
        return rows[kept].assign(scene_no=made)

    joined = placed.join(starts, placed["track_id"].eqNullSafe(starts["track_id"]) & (placed["_chunk"] == starts["_chunk"]))
    joined = joined.select(*[placed[c] for c in cues.columns], placed["_chunk"], "_n", "_scene", "_end")
    return joined.groupBy("track_id", "_chunk").applyInPandas(number, shape)


def bounds(cues: DataFrame) -> DataFrame:
    """A row for each scene: cues, first start, the last cue's end (not the largest), id, neighbours' ids, text."""
    facts = cues.groupBy("track_id", "scene_no").agg(
        F.count("*").alias("cues"),
        F.min_by("start_ms", "seq").alias("start_ms"),
        F.max_by("end_ms", "seq").alias("end_ms"),
    )
    name = lambda n: F.format_string("S%03d", n)
    w = Window.partitionBy("track_id").orderBy("scene_no")
    return facts.withColumns(
        {"scene_id": name(F.col("scene_no")), "previous_id": name(F.lag("scene_no").over(w)), "next_id": name(F.lead("scene_no").over(w))},
    ).withColumns({k: F.when(F.col(k) != "Snull", F.col(k)) for k in ("previous_id", "next_id")})


def scene_text(cues: DataFrame) -> DataFrame:
    """The source texts of each scene in order, joined by blanks; scenes hold max_cues at most."""
    return cues.groupBy("track_id", "scene_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "source_text"))), lambda x: x["source_text"]), " ").alias("text"),
    )
