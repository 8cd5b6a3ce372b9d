"""Readability metrics and retiming: projections and one window pass.

cues: track_id, seq, start_ms, end_ms, source_text, target_text and, where scenes
matter, scene_no.  Neighbours are those of the same track and scene.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.functions import text as T
from cuegrid.profiles import HOUSE, Profile


def neighbours(cues: DataFrame, keys: tuple[str, ...] = ("track_id", "scene_no")) -> Window:
    return Window.partitionBy(*[k for k in keys if k in cues.columns]).orderBy("seq")


def next_start(cues: DataFrame, keys: tuple[str, ...] = ("track_id", "scene_no")) -> Column:
    """The start of the next cue of the scene: as segmentation has left it, else by a window."""
    return F.col("next_start_ms") if "next_start_ms" in cues.columns and "scene_no" in keys else F.lead("start_ms").over(neighbours(cues, keys))


def metrics(cues: DataFrame, keys: tuple[str, ...] = ("track_id", "scene_no"), profile: Profile = HOUSE) -> DataFrame:
    """Adds duration_ms, char_count, line_count, max_cpl, cps_x100 (characters a second, in hundredths, rounded half up), gap_ms to the next cue and the five flags."""
    shown = F.coalesce(F.nullif("target_text", F.lit("")), "source_text")
    lines = F.transform(F.filter(F.split(shown, "\n"), lambda x: T.strip(x) != ""), lambda x: F.length(T.strip(x)))
    out = cues.withColumn("duration_ms", F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).withColumn("line_lengths", lines)
    out = out.withColumns(
        {
            "line_count": F.size("line_lengths"),
            "char_count": F.aggregate("line_lengths", F.lit(0), lambda a, n: a + n).cast("long"),
            "max_cpl": F.coalesce(F.array_max("line_lengths"), F.lit(0)),
        },
    ).drop("line_lengths")
    span = F.greatest(F.lit(100), F.col("duration_ms"))
    out = out.withColumn("cps_x100", F.floor((F.col("char_count") * 200000 + span) / (span * 2)))
    out = out.withColumn("gap_ms", next_start(cues, keys) - F.col("end_ms"))
    return out.withColumns({
        "cps_exceeded": F.col("cps_x100") > int(profile.hard_max_cps * 100), "cpl_exceeded": F.col("max_cpl") > profile.hard_max_cpl, "lines_exceeded": F.col("line_count") > profile.max_lines,
        "too_short": F.col("duration_ms") < profile.min_duration_ms, "gap_too_short": F.coalesce(F.col("gap_ms") < profile.min_gap_ms, F.lit(False)),
    })


def retime(cues: DataFrame, keys: tuple[str, ...] = ("track_id", "scene_no"), profile: Profile = HOUSE) -> DataFrame:
    """new_end_ms: cues read too fast last longer, as far as the gap to the next one allows; without a next one, as long as needed."""
    m = metrics(cues, keys, profile)
    needed = F.floor(F.col("char_count") * 1000 / profile.preferred_cps) - F.col("duration_ms")
    room = F.when(F.col("gap_ms").isNull(), needed).otherwise(F.least(needed, F.greatest(F.lit(0), F.col("gap_ms") - profile.min_gap_ms)))
    return m.withColumn("new_end_ms", F.col("end_ms") + F.when(F.col("cps_exceeded") & (needed > 0), F.greatest(F.lit(0), room)).otherwise(0))


def shift(cues: DataFrame, offset_ms: int) -> DataFrame:
    start = F.greatest(F.lit(0), F.col("start_ms") + offset_ms)
    return cues.withColumns({"start_ms": start, "end_ms": F.greatest(start + 100, F.col("end_ms") + offset_ms)})


def _trunc(x: Column) -> Column:
    return x.cast("long")


def convert_rate(cues: DataFrame, source_fps: float, target_fps: float) -> DataFrame:
    if source_fps <= 0 or target_fps <= 0 or source_fps == target_fps:
        return cues
    ratio = F.lit(source_fps / target_fps)
    return cues.withColumns({"start_ms": _trunc(F.col("start_ms") * ratio), "end_ms": _trunc(F.col("end_ms") * ratio)})


def two_point_sync(cues: DataFrame, first: tuple[int, int], second: tuple[int, int]) -> DataFrame:
    """A line through two (old, new) points; equal old points are an offset."""
    (o1, s1), (o2, s2) = first, second
    if o1 == o2:
        return shift(cues, s1 - o1)
    slope = (s2 - s1) / (o2 - o1)
    start = F.greatest(F.lit(0), _trunc(F.col("start_ms") * F.lit(slope) + F.lit(s1 - slope * o1)))
    return cues.withColumns({"start_ms": start, "end_ms": start + _trunc((F.col("end_ms") - F.col("start_ms")) * F.lit(slope))})


def progress(cues: DataFrame) -> DataFrame:
    """Permille done after each cue of its track, rounded half up."""
    w = Window.partitionBy("track_id")
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy("seq"))
    return cues.withColumn("permille", F.floor((i * 2000 + n) / (n * 2)))
