"""Scans: subtitle files to cues, directory listings to track candidates, gold sets.

A scan is one row per file (path, content) and explodes into one row per cue:
track_id, cue_id (1..n over the kept blocks), start_ms, end_ms, source_text,
speaker.  Cues with unreadable timestamps go to a reject table in bulk mode; with
``strict`` they fail the query.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuegrid.functions import text as T
from cuegrid.functions import timecode as C

MAX_BYTES = 10 * 1024 * 1024


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 if they are that, else Latin-1."""
    return F.coalesce(F.call_function("try_validate_utf8", content.cast("string")), F.decode(content, "ISO-8859-1"))


def _fixed(path: str) -> str:
    """The part of a path before its first pattern."""
    cut = re.search(r"[*?\[{]", path)
    return (path[: cut.start()].rsplit("/", 1)[0] if cut else path).rstrip("/") or "/"


def below(spark: SparkSession, source: str, path: Column) -> Column:
    """A file's path below the folder that was read (below its fixed part, where that is a pattern); a single file's own name."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_fixed(source))
    base = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substring(path, len(base) + 1, 1 << 20)).otherwise(F.regexp_extract(path, r"([^/]*)$", 1))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, size, content (UTF-8, else Latin-1), one row per file of the folder and the folders in it; files beyond the size limit keep a null content.  Empty files, which the reader skips, are listed by the driver."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), "content")
    full = raw.select("path", "size", F.when(F.col("size") <= MAX_BYTES, decoded(F.col("content"))).alias("content"))
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system, none = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), []
    for top in system.globStatus(at) or []:
        listed = system.listFiles(top.getPath(), True)
        while listed.hasNext():
            file = listed.next()
            if file.getLen() == 0 and file.getPath().getName()[0] not in "._":
                none.append((file.getPath().toString(), 0, ""))
    return full.where("size > 0").unionByName(spark.createDataFrame(none, "path string, size long, content string"))


def guard_reason(files: DataFrame, content: str = "content") -> Column:
    """Why a file can't be scanned; null if it can."""
    return F.when(F.col("size") == 0, "empty").when(F.col("size") > MAX_BYTES, "too large").when(
        F.col(content).isNull() | ~F.col(content).rlike(r"\S"),
        "blank",
    )


def guard(files: DataFrame) -> DataFrame:
    """path and reason of the files that can't be scanned."""
    return files.select("path", guard_reason(files).alias("reason")).where("reason IS NOT NULL")


def _body(content: Column) -> Column:
    return F.regexp_replace(content, "^\\uFEFF", "")


def _stripped(lines: Column) -> Column:
    return F.filter(F.transform(lines, lambda x: T.strip(x)), lambda x: x != "")


def _block(start: Column, end: Column, words: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), words.alias("source_text"))


def _bound(x: Column, f) -> Column:
    """f(x) with x made once."""
    return F.transform(F.array(x), f)[0]


def _paragraphs(content: Column, arrow) -> Column:
    """Blocks between blank lines that hold an arrow line; arrow(lines) is its place, from 1, 0 without one."""
    lines = F.transform(F.split(T.strip(_body(content)), r"(?U)\n\s*\n"), lambda b: _stripped(F.split(b, "\n")))
    placed = F.filter(F.transform(lines, lambda ls: F.struct(ls.alias("ls"), arrow(ls).cast("int").alias("at"))), lambda x: x["at"] > 0)
    ends = F.transform(
        placed,
        lambda x: F.struct(
            F.split(F.get(x["ls"], x["at"] - 1), "-->").alias("ends"),
            F.array_join(F.slice(x["ls"], x["at"] + 1, F.size(x["ls"])), "\n").alias("words"),
        ),
    )
    return F.transform(ends, lambda x: _block(T.strip(F.get(x["ends"], F.lit(0))), F.get(T.tokens(F.get(x["ends"], F.lit(1))), F.lit(0)), x["words"]))


def srt_blocks(content: Column) -> Column:
    """The kept blocks of an SRT file: an array of start and end (texts) and source_text.  The stamp is the first line, or the second one after a number."""
    is_stamp = lambda ls, k: F.coalesce(F.contains(F.get(ls, F.lit(k)), F.lit("-->")), F.lit(False))
    numbered = lambda ls: F.coalesce(F.get(ls, F.lit(0)).rlike(r"(?U)^\d+$"), F.lit(False))
    return _paragraphs(content, lambda ls: F.when(numbered(ls), F.when(is_stamp(ls, 1), 2).otherwise(0)).otherwise(F.when(is_stamp(ls, 0), 1).otherwise(0)))


def vtt_blocks(content: Column) -> Column:
    """Runs of lines between blank ones that hold an arrow; lines before the arrow are ignored."""
    is_arrow = lambda x: F.contains(x, F.lit("-->")) & ~F.startswith(x, F.lit("WEBVTT")) & ~F.startswith(x, F.lit("NOTE"))
    return _paragraphs(content, lambda ls: F.array_position(F.transform(ls, is_arrow), F.lit(True)))


def ass_blocks(content: Column) -> Column:
    """Dialogue lines of the [Events] section, split as its Format line says; the last field keeps its commas."""
    events = F.regexp_extract(_body(content), r"(?is)(?:^|\n)[ \t]*\[events\][^\n]*\n(.*?)(?=\n[ \t]*\[|\z)", 1)
    default = F.lit("layer,start,end,style,name,marginl,marginr,marginv,effect,text")

    def rows(ls: Column) -> Column:
        formats = F.filter(ls, lambda x: F.startswith(F.lower(x), F.lit("format:")))
        fields = F.transform(F.split(F.coalesce(F.lower(F.regexp_replace(F.get(formats, F.lit(0)), r"(?i)^format:", "")), default), ","), lambda x: F.trim(x))
        return _bound(
            fields,
            lambda names: F.transform(
                F.filter(ls, lambda x: F.startswith(x, F.lit("Dialogue:"))),
                lambda line: row(names, F.call_function("split", F.regexp_replace(line, "^Dialogue:", ""), F.lit(","), F.size(names))),
            ),
        )

    def row(names: Column, values: Column) -> Column:
        field = lambda v, name: T.strip(F.get(v, F.array_position(names, F.lit(name)).cast("int") - 1))
        words = lambda v: T.strip(F.regexp_replace(F.regexp_replace(field(v, "text"), r"\\[Nn]", "\n"), r"\{[^}]*\}", ""))
        return _bound(values, lambda v: _block(F.coalesce(field(v, "start"), F.lit("0:00:00.00")), F.coalesce(field(v, "end"), F.lit("0:00:00.00")), words(v)))

    return F.filter(_bound(F.transform(F.split(events, "\n"), lambda x: T.strip(x)), rows), lambda x: x["source_text"] != "")


def parsed(files: DataFrame, content: str = "content", track: str = "path") -> DataFrame:
    """One row per file: track_id, good and bad blocks.  The file is read once whatever its format, by the name's extension (SRT unless VTT, ASS or SSA), and cues are numbered in place: no rows are moved."""
    ext = F.lower(F.regexp_extract(F.col(track), r"\.([^./]*)$", 1))

    def timed(split, to_ms) -> Column:
        return F.transform(
            split(F.col(content)),
            lambda b,
            i: F.struct(
                i.alias("pos"),
                b["start"].alias("start"),
                b["end"].alias("end"),
                to_ms(b["start"]).alias("start_ms"),
                to_ms(b["end"]).alias("end_ms"),
                b["source_text"].alias("source_text"),
            ),
        )

    blocks = F.when(ext == "vtt", timed(vtt_blocks, C.vtt_ms)).when(ext.isin("ass", "ssa"), timed(ass_blocks, C.ass_ms)).otherwise(timed(srt_blocks, C.srt_ms))
    rows = files.select(F.col(track).alias("track_id"), (~ext.isin("vtt", "ass", "ssa")).alias("speakers"), blocks.alias("blocks"))
    known = lambda b: b["start_ms"].isNotNull() & b["end_ms"].isNotNull()
    return rows.select("track_id", "speakers", F.filter("blocks", known).alias("good"), F.filter("blocks", lambda b: ~known(b)).alias("bad"))


def scan(files: DataFrame, content: str = "content", track: str = "path", strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Cues and rejects of files of any of the formats.  strict: a file that the guards refuse, a bad timestamp, or a file without a cue fails the query."""
    one = parsed(files, content, track)
    if strict:
        reason = guard_reason(files, content) if "size" in files.columns else F.lit(None).cast("string")
        why = F.when(F.size("bad") > 0, F.concat(F.lit("bad timestamp in "), "track_id")).when(F.size("good") == 0, F.concat(F.lit("no cues in "), "track_id"))
        if "size" in files.columns:
            refused = files.select(F.col(track).alias("track_id"), reason.alias("reason"))
            one = one.join(refused, "track_id")
            why = F.coalesce(F.concat(F.col("reason"), F.lit(" file: "), F.col("track_id")), why)
        one = one.withColumn("good", F.when(why.isNull(), F.col("good")).otherwise(F.raise_error(why).cast(one.schema["good"].dataType)))
    cues = one.select("track_id", "speakers", F.posexplode("good").alias("i", "b")).select(
        "track_id",
        (F.col("i") + 1).alias("cue_id"),
        "b.start_ms",
        "b.end_ms",
        "b.source_text",
        "speakers",
    )
    bad = one.select("track_id", F.explode("bad").alias("b")).select("track_id", "b.pos", "b.start", "b.end")
    return cues.withColumn("speaker", F.when(F.col("speakers"), T.speaker_label(F.col("source_text")))).drop("speakers"), bad


def track_candidates(paths: DataFrame, media: str = "media", path: str = "path") -> DataFrame:
    """Sidecar candidates of a media file with a score in hundredths: 90, 5 more for the media's name, 5 for English in the name."""
    low = F.lower(F.regexp_extract(F.col(path), r"([^/]*)$", 1))
    base = F.lower(F.regexp_replace(F.regexp_extract(F.col(media), r"([^/]*)$", 1), r"\.[^.]*$", ""))
    english = F.contains(low, F.lit("en"))
    kind = F.when(F.contains(low, F.lit("forced")), "forced").when(F.contains(low, F.lit("sdh")) | F.contains(low, F.lit("cc")), "sdh").otherwise("full")
    fmt = F.regexp_extract(low, r"\.(srt|ass|vtt)$", 1)
    score = 90 + F.when(F.startswith(low, base), 5).otherwise(0) + F.when(english, 5).otherwise(0)
    return paths.select(
        media,
        path,
        F.when(english, "en").otherwise("unknown").alias("language"),
        fmt.alias("format"),
        kind.alias("track_type"),
        score.alias("score"),
    ).where("format <> ''")


PROBE = "streams array<struct<codec_type: string, codec_name: string, tags: struct<language: string, title: string>>>"


def embedded_candidates(probes: DataFrame, media: str = "media", probe: str = "probe") -> DataFrame:
    """Subtitle streams as a media probe lists them (JSON), with the scores of embedded tracks: 95 for English, else 50.  Unreadable probes give none."""
    streams = probes.select(media, F.posexplode(F.from_json(F.col(probe), PROBE)["streams"]).alias("number", "s")).where("s.codec_type = 'subtitle'")
    title, language = F.lower(F.coalesce("s.tags.title", F.lit(""))), F.coalesce("s.tags.language", F.lit("unknown"))
    kind = F.when(F.contains(title, F.lit("forced")), "forced").when(F.contains(title, F.lit("sdh")) | F.contains(title, F.lit("cc")), "sdh").otherwise("full")
    return streams.select(
        media,
        F.concat(F.col(media), F.lit("#"), F.col("number")).alias("path"),
        F.when(language.isin("eng", "en"), "en").otherwise(language).alias("language"),
        F.coalesce("s.codec_name", F.lit("srt")).alias("format"),
        kind.alias("track_type"),
        F.when(language == "eng", 95).otherwise(50).alias("score"),
    )


def master_track(
    candidates: DataFrame,
    overrides: DataFrame | None = None,
    media: str = "media",
    path: str = "path",
    files: DataFrame | None = None,
) -> DataFrame:
    """The candidate of each media file: a manual override wins, then the score, then the path.  files: all media files; one without a candidate gets a row that asks for speech recognition."""
    marked = candidates.withColumn("manual", F.lit(0)) if overrides is None else candidates.join(
        overrides.select(media, path, F.lit(1).alias("manual")),
        [media, path],
        "left",
    ).fillna(0, ["manual"])
    order = Window.partitionBy(media).orderBy(F.desc("manual"), F.desc("score"), path)
    best = marked.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank", "manual")
    if files is None:
        return best
    asked = files.select(media).distinct().join(best.select(media), media, "left_anti")
    return best.unionByName(
        asked.select(
            media,
            F.col(media).alias(path),
            F.lit("en").alias("language"),
            F.lit("asr").alias("format"),
            F.lit("full").alias("track_type"),
            F.lit(70).alias("score"),
        ),
    )


def gold_items(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of gold items; no rows where there is no such file."""
    from cuegrid.schema import GOLD

    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], GOLD)
    return spark.read.schema(GOLD).json(path, multiLine=True)
