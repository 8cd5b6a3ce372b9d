"""The cue table that the queries share, derived from conversations.

One cue for each line that isn't blank: track = conversation, seq in the order of
turn and line.  Times follow from the lengths, in whole milliseconds.  Every so
many cues get a question mark, a speaker's label, tags, a number or a marker of
foreign speech, and translations get the defects that the rules look for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LATIN, SCRIPT = "aeiouybcdfghjklmnpqrstvwxz,;", "اێیۆويبکدفگهژكلمنپقرستڤوخز،؛"
SAME, NOUN = "هەمان دەق بۆ هەردوو", "ـی باش ی جوان ی گەورە ی نوێ ی"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("track_id"),
        "turn",
        "role",
        F.posexplode(F.split("text", "\n")).alias("line_no", "line"),
    ).where(F.col("line").rlike(r"\S"))
    order = Window.partitionBy("track_id").orderBy("turn", "line_no", "line", "role")
    return rows.select("turn", "role", "line", "track_id", F.row_number().over(order).cast("long").alias("seq"))


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, seq, start_ms, end_ms, source_text, target_text, speaker."""
    rows = lines(spark, sf_dir).withColumn("n", F.length("line").cast("long"))
    rows = rows.withColumns({"dur": 400 + (F.col("n") * 53) % 4000, "gap": (F.col("n") * 131 + F.col("turn") * 977) % 5000})
    upto = Window.partitionBy("track_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("start_ms", F.sum(F.col("dur") + F.col("gap")).over(upto) - F.col("dur") - F.col("gap"))
    every = lambda k: F.col("seq") % k == 0
    line = F.col("line")
    source = F.when(every(13), F.lit("[Speaking Spanish]")).when(every(17), F.concat(F.lit("[in French] "), line)).when(every(19), F.concat(F.lit("JOHN: "), line)).when(
        every(23),
        F.concat(F.lit("<i>"), line, F.lit("</i> {b}")),
    )
    source = source.when(every(29), F.concat(line, F.lit(" 42"))).when(every(11), F.concat(line, F.lit("?"))).when(
        every(7),
        F.concat(line, F.lit(" never")),
    ).otherwise(line)
    script = F.translate(F.lower(line), LATIN, SCRIPT)
    target = F.when(every(31), F.lit(None)).when(every(26), F.lit("")).when((F.col("seq") % 16).isin(6, 7), F.lit(SAME)).when(
        every(43),
        F.concat(F.lit("تەرجەمەی: "), line),
    )
    target = target.when(every(58), F.concat(script, F.lit(" ٤٢"))).when(every(22), F.concat(script, F.lit(" ؟"))).when(
        every(5),
        F.concat(script, F.lit(" hello ok (see note) **")),
    ).when(every(9), F.concat(F.lit(NOUN + " "), script)).when(every(12), F.concat(script, F.lit("ê تە   ?")))
    target = target.when(every(8), F.concat(script, F.lit("\n"), script, F.lit("\nدوو"))).otherwise(script)
    return rows.select(
        "track_id",
        "seq",
        "start_ms",
        (F.col("start_ms") + F.col("dur")).alias("end_ms"),
        source.alias("source_text"),
        target.alias("target_text"),
        F.when(every(19), F.lit("JOHN")).alias("speaker"),
    )
