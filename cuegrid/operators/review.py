"""Review queue, decisions, corrections, dictionary joins, checkpoints and overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrid import constants as K


def queue(evaluated: DataFrame, severity: str | None = None) -> DataFrame:
    """What awaits review: the last evaluation of a cue counts; optionally only those with an issue of the severity."""
    w = Window.partitionBy("track_id", "seq").orderBy(F.desc("version"))
    last = evaluated.withColumn("r", F.row_number().over(w)).where("r = 1 AND requires_review").drop("r")
    return last.where(F.exists("issues", lambda x: x["severity"] == severity)) if severity else last


def decide(cues: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions: track_id, seq, action, approved, alternative.  accept keeps, choose_alternative takes the alternative if there is one, others take the approved text."""
    was = F.coalesce("target_text", F.lit(""))
    final = F.when(F.col("action") == "accept", was).when(
        (F.col("action") == "choose_alternative") & (F.coalesce("alternative", F.lit("")) != ""),
        F.col("alternative"),
    ).otherwise(F.coalesce("approved", was))
    out = cues.join(decisions, ["track_id", "seq"], "left")
    return out.withColumns(
        {
            "final_text": F.when(F.col("action").isNull(), F.col("target_text")).otherwise(final),
            "status": F.when(F.col("action").isNull(), "pending").when(F.col("action") == "accept", "accepted").otherwise("edited"),
        },
    )


def record(corrections: DataFrame) -> DataFrame:
    """Corrections worth keeping: both texts there."""
    return corrections.where("coalesce(source_text, '') <> '' AND coalesce(corrected_translation, '') <> ''")


def frequent(corrections: DataFrame, at_least: int = 3) -> DataFrame:
    hits = corrections.where("correction_type = 'edit'").groupBy("source_text", "corrected_translation").agg(F.count("*").alias("frequency"))
    return hits.where(F.col("frequency") >= at_least).orderBy(F.desc("frequency"), "source_text", "corrected_translation")


def recent(corrections: DataFrame, n: int, project: str | None = None) -> DataFrame:
    rows = corrections if project is None else corrections.where(F.col("project_id") == project)
    return rows.orderBy(F.desc("ts"), F.desc("id")).limit(n)


#: A dictionary of up to so many bytes (some hundred terms) is tested term by term in each row.
FOLD_BYTES = 1 << 14
#: Terms' words of up to so many characters are met at their length; longer ones by their first 32, 64, 128 ... characters.
WHOLE = 32


def _runs(x: Column) -> Column:
    """Runs of blanks and of other characters, in turn."""
    return F.regexp_extract_all(x, F.lit(r"\s+|\S+"), F.lit(0))


def _width(x: Column) -> Column:
    """How many characters of a word are met."""
    n = F.length(x)
    return F.when(n <= WHOLE, n).otherwise(F.lit(WHOLE) * F.pow(F.lit(2), F.floor(F.log2(n / WHOLE)))).cast("int")


def _needle(x: Column, exact: Column, term: str) -> tuple[Column, Column]:
    """Whether case counts for an entry, and what is looked for."""
    kind = F.coalesce(exact, F.lit(False))
    return kind, F.when(kind, x[term]).otherwise(F.lower(x[term]))


def words_holding(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """exact, word, piece: distinct words with the pieces, themselves without a border between blanks and others, that stand in them.  words: exact, word; pieces: exact, piece."""
    sized = pieces.withColumn("width", _width(F.col("piece")))
    # WHOLE + 1 lengths and one more for each doubling at most
    widths = sorted(r[0] for r in sized.select("width").distinct().collect())
    asked = words.withColumn("width", F.explode(F.filter(F.array(*[F.lit(w) for w in widths]).cast("array<int>"), lambda w: (w <= F.length("word")) & ((w > 0) | (F.col("word") == "")))))
    windows = F.array_distinct(F.transform(F.expr("sequence(1, length(word) - width + 1)"), lambda i: F.xxhash64("exact", F.substring("word", i, F.col("width")))))
    index = sized.select("exact", "piece", F.xxhash64("exact", F.substring("piece", F.lit(1), F.col("width"))).alias("k"))
    met = asked.select("exact", "word", F.explode(windows).alias("k")).join(index, ["k", "exact"])
    return met.where(F.contains("word", "piece")).select("exact", "word", "piece")


def _large_join(texts: DataFrame, known: DataFrame, text: str, term: str, exact) -> DataFrame:
    """texts' columns and _x, the entry, of each text and term that it holds."""
    kind, needle = _needle(F.col("_x"), exact(F.col("_x")), term)
    entries = known.select(F.struct(*known.columns).alias("_x")).withColumns({"_exact": kind, "_needle": needle})
    needles = entries.select(F.col("_exact").alias("exact"), F.col("_needle").alias("needle")).distinct().withColumn("parts", _runs(F.col("needle")))
    kinds = needles.groupBy("exact").agg(F.max(F.size("parts") > 1)).collect()
    # distinct texts, numbered by 96 bits
    numbers = lambda x: {"_text_id": F.xxhash64(x), "_text_no": F.hash(x)}
    once = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).distinct().withColumns(numbers("t"))
    ways = F.array(*[F.struct(F.lit(k).alias("exact"), (F.col("t") if k else F.lower("t")).alias("t")) for k, _ in kinds])
    told = once.select("_text_id", "_text_no", F.explode(ways).alias("w")).select("_text_id", "_text_no", "w.exact", F.explode(F.array_distinct(F.concat(_runs(F.col("w.t")), F.array(F.lit(""))))).alias("word"))
    # a needle of one run stands in one of the text's; of another, each run does
    one = needles.where("size(parts) <= 1").select("exact", F.col("needle").alias("piece"), "needle")
    more = needles.where("size(parts) > 1").select("exact", F.explode(F.array_distinct(F.filter("parts", lambda p: p.rlike(r"\S")))).alias("piece"), "needle")
    several = any(r[1] for r in kinds)
    pieces = one.select("exact", "piece").unionByName(more.select("exact", "piece")).distinct() if several else one.select("exact", "piece")
    met = words_holding(told.select("exact", "word").distinct(), pieces)
    asked = one
    if several:
        # it is looked for in the texts that hold its rarest word
        texts_of = told.groupBy("exact", "word").agg(F.count("*").alias("n"))
        counts = met.join(texts_of, ["exact", "word"]).groupBy("exact", "piece").agg(F.sum("n").alias("n"))
        rare = more.join(counts, ["exact", "piece"], "left").groupBy("exact", "needle").agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)), "piece")).alias("piece"))
        asked = one.unionByName(rare.select("exact", "piece", "needle"))
    held = told.join(met.join(asked, ["exact", "piece"]).select("exact", "word", "needle"), ["exact", "word"])
    held = held.select("_text_id", "_text_no", F.col("exact").alias("_exact"), F.col("needle").alias("_needle")).distinct()
    full = texts.withColumns(numbers(text)).join(held, ["_text_id", "_text_no"]).join(entries, ["_exact", "_needle"])
    if several:
        full = full.where(F.contains(F.when(F.col("_exact"), F.col(text)).otherwise(F.lower(text)), F.col("_needle")))
    return full.drop("_text_id", "_text_no", "_exact", "_needle")


def contains_join(texts: DataFrame, terms: DataFrame, text: str, term: str = "term", case_sensitive: bool | str = False) -> DataFrame:
    """Each text with each term of a dictionary that it contains; case_sensitive may name a column of the dictionary.

    A dictionary of FOLD_BYTES or less, which is measured, is folded into the rows as
    one array.  Of a larger one, a term without blanks inside stands within a word of
    the text, so distinct words meet distinct terms on their runs of the terms' lengths,
    and texts get the terms of their words; a term of several words is checked in the
    texts that hold its rarest.  Null texts and terms hold and are nothing; an empty
    term is in every text; equal entries count each.
    """
    fields = [c for c in terms.columns]
    exact = (lambda x: x[case_sensitive]) if isinstance(case_sensitive, str) else (lambda x: F.lit(case_sensitive))
    low = F.lower(F.col(text))
    hit = lambda x: F.when(F.coalesce(exact(x), F.lit(False)), F.contains(F.col(text), x[term])).otherwise(F.contains(low, F.lower(x[term])))
    known = terms.where(F.col(term).isNotNull())
    size = known.agg(F.sum(F.octet_length(F.to_json(F.struct(*fields))))).first()[0] or 0
    if size <= FOLD_BYTES:
        packed = known.agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_terms"))
        joined = texts.withColumn("_terms", packed.scalar()).withColumn("_x", F.explode(F.filter("_terms", hit))).drop("_terms")
    else:
        joined = _large_join(texts, known, text, term, exact)
    return joined.select(*texts.columns, *[F.col(f"_x.{f}").alias(f) for f in fields])


def glossary_matches(texts: DataFrame, entries: DataFrame, text: str = "text") -> DataFrame:
    """The approved entries that each text holds.  entries: term, status and, if there, case_sensitive for each entry."""
    approved = entries.where("status = 'approved'").drop("status")
    return contains_join(texts, approved, text, case_sensitive="case_sensitive" if "case_sensitive" in entries.columns else False)


def compliance(targets: DataFrame, text: str = "target_text") -> DataFrame:
    terms = targets.sparkSession.createDataFrame(K.COMPLIANCE, "term string, replacement string, severity string")
    return contains_join(targets, terms, text, case_sensitive=True)


def active_characters(scenes: DataFrame, characters: DataFrame, text: str = "text") -> DataFrame:
    """Each character once for a scene that names it or one of its aliases.  characters: id, name, aliases."""
    names = characters.select(
        "id",
        F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("term"),
    )
    keys = [c for c in scenes.columns if c != text]
    return contains_join(scenes, names, text).select(*keys, "id").distinct()


def resume(cues: DataFrame, checkpoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(done, to do): scenes in the checkpoint table keep their stored texts, timing and QC; the rest is an anti-join on project and scene."""
    keys = ["track_id", "scene_no"]
    done = cues.drop("target_text").join(checkpoints, [*keys, "seq"])
    return done, cues.join(checkpoints.select(*keys).distinct(), keys, "left_anti")


def overlay(cues: DataFrame, edits: DataFrame) -> DataFrame:
    """The last edit of a cue replaces its translation.  edits: track_id, seq, version, target_text."""
    last = edits.groupBy("track_id", "seq").agg(F.max_by("target_text", "version").alias("edited"))
    return cues.join(last, ["track_id", "seq"], "left").withColumn("target_text", F.coalesce("edited", "target_text")).drop("edited")


def zip_files(first: DataFrame, second: DataFrame) -> DataFrame:
    """Cues of two files side by side, by position; the longer file's rest is dropped."""
    return first.join(second.withColumnsRenamed({c: f"other_{c}" for c in second.columns if c not in ("track_id", "seq")}), ["track_id", "seq"])


def first_interpretation(cues: DataFrame, interpretations: DataFrame) -> DataFrame:
    """The first interpretation whose cue ids hold the cue.  interpretations: track_id, pos, cue_ids, meaning."""
    flat = interpretations.select("track_id", "pos", "meaning", F.explode("cue_ids").alias("seq"))
    first = flat.groupBy("track_id", "seq").agg(F.min_by("meaning", "pos").alias("meaning"))
    return cues.join(first, ["track_id", "seq"], "left")
