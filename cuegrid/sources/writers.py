"""Sinks: cues to subtitle texts (one row per track), HTML, QC reports and training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuegrid import constants as K
from cuegrid.functions import text as T
from cuegrid.functions import timecode as C
from cuegrid.sources import files


def shown() -> Column:
    """The translation; the source only where there is none at all."""
    return F.coalesce(F.col("target_text"), F.col("source_text"))


def _layout(head: str = "", sep: str = "\n", tail: str = "\n", numbered: bool = False) -> dict:
    return {"head": head, "sep": sep, "tail": tail, "numbered": numbered}


def _joined(blocks: DataFrame, layout: dict) -> DataFrame:
    """Blocks of a track in cue order, if wanted with their number before them, as one text."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "block")))
    shown_as = (lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), x["block"])) if layout["numbered"] else (lambda x: x["block"])
    text = F.array_join(F.transform(parts, shown_as), layout["sep"])
    return blocks.groupBy("track_id").agg(F.concat(F.lit(layout["head"]), text, F.lit(layout["tail"])).alias("content"))


def _srt(cues: DataFrame) -> tuple[DataFrame, dict]:
    block = F.concat(C.srt_stamp(F.col("start_ms")), F.lit(" --> "), C.srt_stamp(F.col("end_ms")), F.lit("\n"), shown())
    return cues.select("track_id", "seq", block.alias("block")), _layout(sep="\n\n", numbered=True)


def _vtt(cues: DataFrame) -> tuple[DataFrame, dict]:
    stamps = F.concat(C.vtt_stamp(F.col("start_ms")), F.lit(" --> "), C.vtt_stamp(F.col("end_ms")))
    block = F.concat(F.col("seq"), F.lit("\n"), stamps, F.lit("\n"), shown(), F.lit("\n"))
    return cues.select("track_id", "seq", block.alias("block")), _layout("WEBVTT\n\n", tail="")


def _ass(cues: DataFrame, title: str) -> tuple[DataFrame, dict]:
    line = F.concat(
        F.lit("Dialogue: 0,"),
        C.ass_stamp(F.col("start_ms")),
        F.lit(","),
        C.ass_stamp(F.col("end_ms")),
        F.lit(",Default,,0,0,0,,"),
        F.replace(shown(), F.lit("\n"), F.lit("\\N")),
    )
    return cues.select("track_id", "seq", line.alias("block")), _layout(K.ASS_HEADER.format(title=title))


def _html(cues: DataFrame, qc: DataFrame, title: str) -> tuple[DataFrame, dict]:
    rows = to_html_rows(cues, qc)
    return rows.select("track_id", "seq", F.col("html").alias("block")), _layout(PAGE.format(title=title), tail="\n</tbody>\n</table>\n</body>\n</html>\n")


def to_srt(cues: DataFrame) -> DataFrame:
    """cues: track_id, seq (the order), start_ms, end_ms, source_text, target_text.  Blocks are numbered from 1 whatever seq is."""
    return _joined(*_srt(cues))


def to_vtt(cues: DataFrame) -> DataFrame:
    return _joined(*_vtt(cues))


def to_ass(cues: DataFrame, title: str = "Subtitles") -> DataFrame:
    return _joined(*_ass(cues, title))


def escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def to_html_rows(cues: DataFrame, qc: DataFrame) -> DataFrame:
    """A table row for each cue: track_id, seq, html.  qc: track_id, seq, version, confidence (hundredths), passed, messages; of several the last counts."""
    last = qc.groupBy("track_id", "seq").agg(F.max_by(F.struct("confidence", "passed", "messages"), "version").alias("q"))
    joined = cues.join(last, ["track_id", "seq"], "left")
    colour = F.when(F.coalesce(F.col("q.passed"), F.lit(False)), "#28a745").otherwise("#dc3545")
    conf = F.coalesce(F.format_string("%d.%02d", F.floor(F.col("q.confidence") / 100), F.col("q.confidence") % 100), F.lit("N/A"))
    cells = [
        F.col("seq").cast("string"),
        F.concat(C.srt_stamp(F.col("start_ms")), F.lit(" --&gt; "), C.srt_stamp(F.col("end_ms"))),
        escape(T.clean_source(F.col("source_text"), F.col("speaker"))),
    ]
    tail = [
        F.concat(F.lit('<td dir="rtl">'), escape(F.coalesce("target_text", F.lit(""))), F.lit("</td>")),
        F.concat(F.lit('<td style="color: '), colour, F.lit('">'), F.when(F.col("q").isNull(), "N/A").otherwise(conf), F.lit("</td>")),
        F.concat(F.lit("<td>"), escape(F.coalesce(F.array_join("q.messages", ", "), F.lit(""))), F.lit("</td>")),
    ]
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], *tail, F.lit("</tr>"))
    return joined.select("track_id", "seq", row.alias("html"))


PAGE = """<!DOCTYPE html>
<html lang="en">
<head>
<meta charset="UTF-8">
<title>{title}</title>
<style>table {{ border-collapse: collapse }} td, th {{ border: 1px solid #ccc; padding: 8px }}</style>
</head>
<body>
<table>
<thead><tr><th>#</th><th>Time</th><th>Source</th><th>Translation</th><th>Confidence</th><th>Issues</th></tr></thead>
<tbody>
"""


def to_html(cues: DataFrame, qc: DataFrame, title: str = "Bilingual inspection") -> DataFrame:
    """A page for each track: track_id, content.  qc: as for to_html_rows."""
    return _joined(*_html(cues, qc, title))


def to_qc_report(evaluated: DataFrame) -> DataFrame:
    """track_id and a JSON report: totals, the average confidence (0 to 1, three places, halves up) and the evaluations of the track in cue order."""
    one = F.struct("seq", "technical", "linguistic", "semantic", "overall", "passed", "requires_review", "issues")
    facts = evaluated.groupBy("track_id").agg(
        F.count("*").alias("total_cues"),
        F.count_if("passed").alias("passed_cues"),
        F.count_if("requires_review").alias("review_required_cues"),
        F.sum("overall").cast("long").alias("points"),
        F.array_sort(F.collect_list(one)).alias("evaluations"),
    )
    average = F.floor((F.col("points") * 20 + F.col("total_cues")) / (2 * F.col("total_cues"))) / 1000
    return facts.select(
        "track_id",
        F.to_json(
            F.struct("track_id", "total_cues", "passed_cues", "review_required_cues", average.alias("average_confidence"), "evaluations"),
        ).alias("content"),
    )


def save(contents: DataFrame, path: str, content: str = "content") -> None:
    """Writes each track's text as a file of its own, in a folder track_id=... under path; an older one of the same track is replaced, other tracks stay."""
    # the writer ends each text with a line break of its own
    rows = contents.select("track_id", F.regexp_replace(content, r"\n\z", "").alias("value"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("track_id").text(path)


def _judgements(evaluated: DataFrame) -> DataFrame:
    """What the page shows of each cue's evaluation."""
    said = F.transform("issues", lambda x: x["message"])
    return evaluated.select("track_id", "seq", F.lit(1).alias("version"), F.col("overall").alias("confidence"), "passed", said.alias("messages"))


def save_all(evaluated: DataFrame, path: str, title: str = "Subtitles", page_title: str = "Bilingual inspection") -> None:
    """All outputs of evaluated cues in one pass: path/srt, vtt, ass, html and qc, a file for each track, under the track's name.  Blocks go from rows to files; only a track's QC report is one row.  Files of tracks that aren't there any more go."""
    qc = _judgements(evaluated)
    report = to_qc_report(evaluated).select("track_id", F.lit(0).cast("long").alias("seq"), F.col("content").alias("block"))
    made = {
        "srt": _srt(evaluated),
        "vtt": _vtt(evaluated),
        "ass": _ass(evaluated, title),
        "html": _html(evaluated, qc, page_title),
        "qc": (report, _layout(tail="\n")),
    }
    blocks = None
    for kind, (rows, _) in made.items():
        rows = rows.select("track_id", F.lit(kind).alias("kind"), F.col("seq").cast("long").alias("seq"), "block")
        blocks = rows if blocks is None else blocks.unionByName(rows)
    files.save(blocks, path, {kind: layout for kind, (_, layout) in made.items()}, overwrite=True)


def save_tracks(cues: DataFrame, path: str, kind: str, title: str = "Subtitles") -> None:
    """Cues as files of one kind (srt, vtt or ass), path/kind/track; others stay."""
    rows, layout = {"srt": _srt, "vtt": _vtt, "ass": lambda c: _ass(c, title)}[kind](cues)
    files.save(rows.withColumn("kind", F.lit(kind)), path, {kind: layout})


def save_folders(evaluated: DataFrame, path: str) -> None:
    """The same outputs by Spark's own text writer, for stores that only Spark reaches: a folder for each track, in which a part file holds the text."""
    qc = _judgements(evaluated)
    for kind, contents in (
        ("srt", to_srt(evaluated)),
        ("vtt", to_vtt(evaluated)),
        ("ass", to_ass(evaluated)),
        ("html", to_html(evaluated, qc)),
        ("qc", to_qc_report(evaluated)),
    ):
        save(contents, f"{path}/{kind}")


def training_rows(corrections: DataFrame, limit: int = 10_000) -> DataFrame:
    """Of the latest corrections, those that changed something by an edit.  The limit comes before the filter."""
    latest = corrections.orderBy(F.desc("ts"), F.desc("id")).limit(limit)
    return latest.where("correction_type = 'edit' AND corrected_translation <> original_translation").select(
        "id",
        F.to_json(
            F.struct(
                F.col("source_text").alias("source"),
                F.col("original_translation").alias("original"),
                F.col("corrected_translation").alias("corrected"),
                "project_id",
                "scene_id",
            ),
        ).alias("line"),
    )
