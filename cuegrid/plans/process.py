"""The whole way of a folder of subtitle files: scan, scenes, routing, memory, provider, glossary, timing, line breaks, quality, review, state, export.

`localize` is one lazy plan over cues.  `process` runs it over files, which are told
apart by their path below the folder.  What it makes is written once, as a version of
the scene state, and all exports read that.  A scene's row carries a hash of its cues
(places, times, texts, speakers) and of the profile, terms, names and provider; a second
run takes the scenes whose hash is there and done, and works on the others: new ones,
changed ones and those in which a translation failed.  Scenes that are in no file any
more are left out of the run and removed from the state.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuegrid.functions import text as T
from cuegrid.operators import memory as M
from cuegrid.operators import provider as P
from cuegrid.operators import quality, review, scenes, timing
from cuegrid.profiles import HOUSE, Profile
from cuegrid.sources import subtitles, writers
from cuegrid.sources.files import reachable
from cuegrid.sources.state import StateTable

KEPT = [
    "track_id",
    "scene_no",
    "seq",
    "start_ms",
    "end_ms",
    "source_text",
    "target_text",
    "speaker",
    "origin",
    "failed",
    "technical",
    "linguistic",
    "semantic",
    "overall",
    "passed",
    "requires_review",
    "issues",
    "meaning",
    "decision",
    "alternative",
    "escalated",
]


def localize(
    cues: DataFrame,
    provider: P.Provider | None = None,
    memory: DataFrame | None = None,
    terms: dict[str, tuple[str, str]] | None = None,
    names: list[str] | None = None,
    profile: Profile = HOUSE,
) -> DataFrame:
    """Segmented cues to translated, retimed, wrapped and evaluated ones (KEPT).  The provider analyzes each scene, translates what memory lacks and gives a second opinion on what awaits review.  origin: given, routed, memory or provider; failed: a cue of its scene got no translation, so the scene has no points and awaits review."""
    given = F.coalesce("target_text", F.lit(""))
    # cleaned and routed once: what follows reads columns
    routed = cues.withColumns({"original": F.col("source_text"), "source_text": T.clean_source(F.col("source_text"), F.col("speaker"))})
    routed = routed.withColumn("route", T.route(F.col("source_text")))
    opaque = F.col("route")["case_type"] == "B"
    routed = routed.withColumns(
        {
            "was": F.when(given != "", "given").when(opaque, "routed"),
            "target_text": F.when(opaque, F.col("route")["indicator"]).otherwise(F.col("target_text")),
        },
    ).drop("route")
    provider = provider or P.DictionaryProvider()
    made = P.translate_missing(P.with_meanings(routed, provider), provider, memory, profile.memory_threshold)
    made = made.withColumns(
        {
            "origin": F.coalesce("was", "origin"),
            "source_text": F.col("original"),
            "target_text": T.enforce_honorifics(F.col("source_text"), F.col("target_text"), T.glossary(terms)),
        },
    ).drop("was", "original")
    timed = timing.retime(made, profile=profile).select(*made.columns, "new_end_ms")
    wrapped = timed.withColumns(
        {
            "end_ms": F.col("new_end_ms"),
            "target_text": F.when(
                F.coalesce("target_text", F.lit("")) != "",
                T.line_breaks(F.col("target_text"), profile.preferred_cpl),
            ).otherwise(F.col("target_text")),
        },
    )
    # the neighbour's text as it is now
    judged = quality.evaluate(wrapped.drop("prev_target", "new_end_ms"), names, profile=profile)
    failed = F.max(F.col("target_text").isNull()).over(Window.partitionBy("track_id", "scene_no"))
    out = judged.withColumn("failed", failed)
    out = out.withColumns(
        {
            "overall": F.when(F.col("failed"), 0).otherwise(F.col("overall")),
            "passed": ~F.col("failed") & F.col("passed"),
            "requires_review": F.col("failed") | F.col("requires_review"),
        },
    )
    return P.with_verdicts(out, provider).select(*KEPT)


@dataclass
class Run:
    """What a run has left: the evaluated cues, rejected blocks, refused files, the review queue, new memory entries and the one-row summary."""

    cues: DataFrame
    rejects: DataFrame
    refused: DataFrame
    queue: DataFrame
    memory: DataFrame
    summary: DataFrame
    version: int = 0


#: A scene's row in the state: its cues as localize gives them, and failed or done.
SCENE_KEY = ["track_id", "scene_no"]
MEMORY = "source_text string, target_text string, context_notes string"


def scene_keys(segmented: DataFrame, said: str = "") -> DataFrame:
    """track_id, scene_no, scene_key: a hash of what the scene is made from, and of what else is said."""
    cue = F.struct("seq", "start_ms", "end_ms", "source_text", "target_text", "speaker")
    content = F.to_json(F.array_sort(F.collect_list(cue)), {"ignoreNullFields": "false"})
    return segmented.groupBy(*SCENE_KEY).agg(F.sha2(F.concat(F.lit(said + "\n"), content), 256).alias("scene_key"))


def scene_rows(judged: DataFrame, keys: DataFrame) -> DataFrame:
    """One row for each scene: its key, status (done or failed) and cues."""
    cue = F.struct("seq", *[c for c in judged.columns if c not in ("seq", *SCENE_KEY)])
    rows = judged.groupBy(*SCENE_KEY).agg(F.array_sort(F.collect_list(cue)).alias("cues"), F.max("failed").alias("_failed"))
    status = F.when(F.col("_failed"), "failed").otherwise("done").alias("status")
    return rows.join(keys, SCENE_KEY).select(*SCENE_KEY, "scene_key", status, "cues")


def resume_scenes(state: StateTable, segmented: DataFrame, keys: DataFrame, work) -> tuple[DataFrame, int]:
    """Every scene's cues and the version that holds them: work(cues) for scenes that the state lacks, or has with another key or as failed, the state's for the rest."""
    done = state.read().where("status = 'done'").select(*SCENE_KEY, "scene_key")
    todo = segmented.join(keys.join(done, [*SCENE_KEY, "scene_key"], "left_anti").select(*SCENE_KEY), SCENE_KEY)
    version = state.upsert(scene_rows(work(todo), keys))
    gone = state.read(version).select(*SCENE_KEY).join(keys, SCENE_KEY, "left_anti")
    version = max(version, state.delete(gone))
    now = state.read(version).join(keys, [*SCENE_KEY, "scene_key"], "left_semi")
    return now.select(*SCENE_KEY, F.inline("cues")), version


def summarize(judged: DataFrame) -> DataFrame:
    """One row: cues, passed, pass_permille, critical_issues, failed_scenes, queue, memory lookups and hits."""
    critical = F.size(F.filter("issues", lambda x: x["severity"] == "critical"))
    asked, hit = F.col("origin").isin("memory", "provider"), F.col("origin") == "memory"
    n = F.count("*")
    failed = F.count_distinct(F.when(F.col("failed"), F.struct("track_id", "scene_no")))
    return judged.agg(
        n.alias("cues"),
        F.count_if("passed").alias("passed"),
        F.floor(F.count_if("passed") * 1000 / F.greatest(F.lit(1), n)).alias("pass_permille"),
        F.coalesce(F.sum(critical), F.lit(0)).cast("long").alias("critical_issues"),
        failed.alias("failed_scenes"),
        F.count_if("requires_review").alias("queue"),
        F.count_if(asked).alias("lookups"),
        F.count_if(hit).alias("hits"),
    )


def new_memory(judged: DataFrame) -> DataFrame:
    """source_text, target_text and context of the translations that passed: one for each text."""
    good = judged.where("passed AND NOT failed AND coalesce(target_text, '') <> ''").withColumn(
        "source_text",
        T.clean_source(F.col("source_text"), F.col("speaker")),
    ).where("source_text <> ''")
    where = F.format_string("scene:S%03d project:%s", "scene_no", "track_id")
    return good.groupBy("source_text").agg(
        F.max_by(F.struct("target_text", where.alias("context_notes")), F.struct("track_id", "seq")).alias("x"),
    ).select("source_text", "x.*")


def process(
    spark: SparkSession,
    source: str,
    out: str,
    provider: P.Provider | None = None,
    memory: DataFrame | None = None,
    terms: dict[str, tuple[str, str]] | None = None,
    names: list[str] | None = None,
    profile: Profile = HOUSE,
    strict: bool = False,
    remember: bool = False,
) -> Run:
    """All subtitle files below a folder, to SRT, VTT, ASS, HTML and QC reports (one of each for a file) under `out`, with the state beside them.

    A track is a file's path below the folder.  strict: a file that can't be scanned
    fails the run; else it is refused.  remember: what passes goes to the memory in the
    state, and earlier runs' memory is looked up where none is given; what it holds isn't
    part of a scene's key, so scenes that are done stay as they are.
    """
    provider = provider or P.DictionaryProvider()
    files = subtitles.read_files(spark, source).withColumn("path", subtitles.below(spark, source, F.col("path")))
    rows, rejects = subtitles.scan(files, strict=strict)
    cues = rows.withColumns({"seq": F.col("cue_id").cast("long"), "target_text": F.lit(None).cast("string")}).drop("cue_id")
    segmented = scenes.segment(cues, profile.scene_min_cues, profile.scene_max_cues)
    known = StateTable(spark, f"{out}/state/memory", MEMORY, ["source_text"])
    if remember and memory is None and known.version():
        memory = known.read().withColumn("tm_id", F.xxhash64("source_text"))
    work = lambda todo: localize(todo, provider, memory, terms, names, profile)
    said = json.dumps([asdict(profile), terms, names, P.identity(provider)], sort_keys=True, default=str)
    made = work(segmented).schema
    shape = scene_rows(spark.createDataFrame([], made), spark.createDataFrame([], "track_id string, scene_no int, scene_key string")).schema
    state = StateTable(spark, f"{out}/state/scenes", shape, SCENE_KEY)
    judged, version = resume_scenes(state, segmented, scene_keys(segmented, said), work)
    judged = judged.select(*KEPT)
    if reachable(out):
        writers.save_all(judged, out)
    else:
        writers.save_folders(judged, out)
    learnt = new_memory(judged)
    if remember:
        known.upsert(learnt)
    queue = review.queue(judged.withColumn("version", F.lit(1)))
    return Run(judged, rejects, subtitles.guard(files), queue, learnt, summarize(judged), version)


__all__ = ["KEPT", "Run", "localize", "new_memory", "process", "resume_scenes", "scene_keys", "scene_rows", "summarize"]
