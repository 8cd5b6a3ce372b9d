"""Every query by name: (spark, sf_dir) to a DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuegrid.functions import responses as R
from cuegrid.functions import text as T
from cuegrid.operators import cost, memory, provider, quality, review, scenes, scoring, timing
from cuegrid.plans import process
from cuegrid.plans.cues import cues, lines, load
from cuegrid.sources import subtitles, writers
from cuegrid.sources.state import StateTable, scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
MODEL = "gemini-2.5-flash"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def segmented(spark: SparkSession, d: str) -> DataFrame:
    return scenes.segment(cues(spark, d))


def evaluated(spark: SparkSession, d: str) -> DataFrame:
    return quality.evaluate(segmented(spark, d))


# --- timing and scenes


@query
def cue_metrics(spark, d):
    return timing.metrics(cues(spark, d)).select(
        "track_id",
        "seq",
        "duration_ms",
        "char_count",
        "line_count",
        "max_cpl",
        "cps_x100",
        "gap_ms",
        "cps_exceeded",
        "cpl_exceeded",
        "lines_exceeded",
        "too_short",
        "gap_too_short",
    )


@query
def scene_segments(spark, d):
    return segmented(spark, d).select("track_id", "seq", "scene_no")


@query
def scene_bounds(spark, d):
    return scenes.bounds(segmented(spark, d))


@query
def scene_texts(spark, d):
    return scenes.scene_text(segmented(spark, d)).select("track_id", "scene_no", F.sha2("text", 256).alias("text_hash"), F.length("text").alias("n_chars"))


@query
def one_long_track(spark, d):
    """All cues as one track, an hour for each of theirs, cut into runs of few cues: the scenes of one key over many tasks."""
    n = F.col("track_id").cast("long")
    one = cues(spark, d).select(
        F.lit("all").alias("track_id"),
        (n * 100_000 + F.col("seq")).alias("seq"),
        (F.col("start_ms") + n * 3_600_000).alias("start_ms"),
        (F.col("end_ms") + n * 3_600_000).alias("end_ms"),
    )
    return scenes.segment_chunks(one, chunk=100_000).select("seq", "start_ms", "scene_no")


@query
def session_gap_events(spark, d):
    """The scene rule on users' events: sessions of 10 to 30 events, closed by a pause of two hours."""
    e = load(spark, d, "events").select(
        "user_id",
        "event_id",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
    ).withColumn("seq", F.struct("ms", "event_id"))
    out = scenes.segment(e, gap=2 * 3600 * 1000, track="user_id", start="ms", end="ms")
    return out.groupBy("user_id", F.col("scene_no").alias("session")).agg(
        F.count("*").alias("events"),
        F.min("ms").alias("first_ms"),
        F.max("ms").alias("last_ms"),
    )


@query
def retime(spark, d):
    return timing.retime(segmented(spark, d)).select("track_id", "seq", "end_ms", "new_end_ms")


@query
def offset_shift(spark, d):
    return timing.shift(cues(spark, d), -1500).select("track_id", "seq", "start_ms", "end_ms")


@query
def framerate(spark, d):
    return timing.convert_rate(cues(spark, d), 25.0, 24.0).select("track_id", "seq", "start_ms", "end_ms")


@query
def two_point_sync(spark, d):
    return timing.two_point_sync(cues(spark, d), (10000, 11000), (50000, 55000)).select("track_id", "seq", "start_ms", "end_ms")


@query
def progress(spark, d):
    return timing.progress(cues(spark, d)).select("track_id", "seq", "permille")


@query
def inspect_stats(spark, d):
    c = cues(spark, d).withColumn("clean", T.clean_source(F.col("source_text"), F.col("speaker")))
    rate = F.floor(F.length("clean") * 100000 / F.greatest(F.lit(100), F.col("end_ms") - F.col("start_ms")))
    return c.groupBy("track_id").agg(
        F.count("*").alias("cues"),
        (F.max_by("end_ms", "seq") - F.min_by("start_ms", "seq")).alias("span_ms"),
        F.sum(F.size(T.tokens(F.col("clean")))).cast("long").alias("words"),
        F.sum(rate).alias("cps_x100_sum"),
    )


# --- text


@query
def clean_text(spark, d):
    return cues(spark, d).select(
        "track_id",
        "seq",
        T.clean_source(F.col("source_text"), F.col("speaker")).alias("clean"),
        T.speaker_label(F.col("source_text")).alias("label"),
    )


@query
def clean_pages(spark, d):
    return load(spark, d, "pages").select("page_id", F.sha2(T.clean_source(F.col("html")), 256).alias("clean_hash"))


@query
def normalize_text(spark, d):
    return cues(spark, d).select("track_id", "seq", T.normalize(F.col("target_text")).alias("normal"))


@query
def normalize_marks(spark, d):
    return cues(spark, d).select(
        "track_id",
        "seq",
        T.normalize(F.col("target_text"), digits=True, marks=True).alias("normal"),
        T.score_key(F.col("target_text")).alias("score_key"),
    )


@query
def line_breaks(spark, d):
    return cues(spark, d).select("track_id", "seq", T.line_breaks(F.col("source_text")).alias("broken"))


@query
def detectors(spark, d):
    t = F.coalesce("target_text", F.lit(""))
    return cues(spark, d).select(
        "track_id",
        "seq",
        F.array_join(T.kurmanji(t), ",").alias("kurmanji"),
        F.array_join(T.untranslated(t), ",").alias("english"),
        F.array_join(F.array_sort(T.llm_errors(t)), ",").alias("llm"),
        F.array_join(T.ezafe_chains(t), ",").alias("ezafe"),
    )


@query
def validate_counts(spark, d):
    return quality.findings(load(spark, d, "documents"))


@query
def suspicious_names(spark, d):
    return cues(spark, d).select(
        "track_id",
        "seq",
        F.array_join(T.suspicious_names(T.clean_source(F.col("source_text"), F.col("speaker"))), ",").alias("names"),
    )


@query
def foreign_routing(spark, d):
    r = T.route(T.clean_source(F.col("source_text"), F.col("speaker")))
    return cues(spark, d).select("track_id", "seq", r.alias("r")).select("track_id", "seq", "r.*")


@query
def glossary_enforce(spark, d):
    source = F.when(
        F.col("seq") % 6 == 0,
        F.concat(F.lit("Captain and Dr. "), F.col("source_text")),
    ).when(F.col("seq") % 6 == 1, F.concat(F.lit("Mrs. "), F.col("source_text"))).otherwise(F.col("source_text"))
    return cues(spark, d).select("track_id", "seq", T.enforce_honorifics(source, F.col("target_text")).alias("enforced"))


@query
def dictionary_translation(spark, d):
    return lines(spark, d).select("track_id", "seq", T.dictionary_translation(F.col("line")).alias("translation"))


@query
def content_keys(spark, d):
    return load(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_key"))


@query
def cue_search(spark, d):
    return cues(spark, d).where(
        F.contains("source_text", F.lit("the")) | F.contains(
            F.coalesce("target_text", F.lit("")),
            F.lit("باش"),
        ) | F.contains(F.col("seq").cast("string"), F.lit("7")),
    ).select("track_id", "seq")


@query
def number_consistency(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "text", F.translate("text", "13579", "٠٢٤٦٨").alias("target"))
    return docs.select("doc_id", F.size(F.array_except(T.numbers(F.col("text")), T.numbers(T.normalize_digits(F.col("target"))))).alias("missing"))


@query
def duplicate_prev(spark, d):
    w = timing.neighbours(cues(spark, d), ("track_id",))
    c = cues(spark, d).withColumn("prev", F.lag("target_text").over(w))
    return c.where((F.col("prev") == F.col("target_text")) & (F.length("target_text") > 5)).select("track_id", "seq")


# --- quality


@query
def qc_issues(spark, d):
    return quality.issues_long(evaluated(spark, d))


@query
def qc_eval(spark, d):
    return evaluated(spark, d).select("track_id", "seq", "scene_no", "technical", "linguistic", "semantic", "overall", "passed", "requires_review")


@query
def qc_summary(spark, d):
    return quality.summary(evaluated(spark, d), "track_id", "scene_no")


@query
def run_summary(spark, d):
    return evaluated(spark, d).agg(
        F.count("*").alias("cues"),
        F.count_if("passed").alias("passed"),
        F.floor(F.count_if("passed") * 1000 / F.count("*")).alias("pass_permille"),
        F.sum(F.size(F.filter("issues", lambda x: x["severity"] == "critical"))).cast("long").alias("critical_issues"),
        F.count_if("requires_review").alias("queue"),
    )


@query
def proper_nouns(spark, d):
    ev = quality.evaluate(segmented(spark, d), names=["John", "Spanish"])
    return quality.issues_long(ev).where("rule = 'proper_noun_missing'").drop("status")


@query
def verification(spark, d):
    ev = evaluated(spark, d)
    verdicts = cues(spark, d).select(
        "track_id",
        "seq",
        F.when(F.col("seq") % 3 == 0, "disagree").otherwise("agree").alias("decision"),
        F.when(F.col("seq") % 4 == 0, "major").otherwise("none").alias("severity"),
        F.lit(None).cast("string").alias("alternative"),
    )
    return quality.verification(ev, verdicts).drop("alternative")


@query
def review_queue(spark, d):
    return review.queue(evaluated(spark, d).withColumn("version", F.lit(1)), "critical").select("track_id", "seq", "overall")


@query
def decisions(spark, d):
    c = cues(spark, d)
    made = c.where("seq % 4 <> 0").select(
        "track_id",
        "seq",
        F.when(F.col("seq") % 4 == 1, "accept").when(F.col("seq") % 4 == 2, "choose_alternative").otherwise("edit").alias("action"),
        F.concat(F.lit("ok "), F.col("seq")).alias("approved"),
        F.when(F.col("seq") % 8 == 2, F.lit("alt")).alias("alternative"),
    )
    return review.decide(c, made).select("track_id", "seq", "final_text", "status")


# --- dictionaries


@query
def compliance_terms(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.regexp_replace("text", "[Tt]he ", "سگ ").alias("target_text"))
    return review.compliance(docs).select("doc_id", "term", "replacement", "severity")


@query
def glossary_match(spark, d):
    rows = [
        ("Licensed", "approved", True),
        ("licensed", "approved", True),
        ("THE and", "approved", False),
        ("idiot", "approved", None),
        ("of the", "draft", False),
    ]
    terms = spark.createDataFrame(rows, "term string, status string, case_sensitive boolean")
    return review.glossary_matches(load(spark, d, "documents").select("doc_id", "text"), terms).select("doc_id", "term")


@query
def glossary_custom(spark, d):
    """A project's own honorific, one that takes the place of a fixed one, and a general term, which changes nothing."""
    terms = T.glossary({"Sheriff": ("شێریف", "honorific"), "captain": ("سەرکردە", "honorific"), "Dr.": ("پزیشک", "general")})
    source = F.when(
        F.col("seq") % 4 == 0,
        F.concat(F.lit("Captain and Dr. "), F.col("source_text")),
    ).when(F.col("seq") % 4 == 1, F.concat(F.lit("The sheriff "), F.col("source_text"))).otherwise(F.col("source_text"))
    return cues(spark, d).select("track_id", "seq", T.enforce_honorifics(source, F.col("target_text"), terms).alias("enforced"))


@query
def cue_records(spark, d):
    """Without audio: flags for names and foreign speech."""
    return quality.cue_records(cues(spark, d)).select("track_id", "seq", "suspicious_names", "foreign_speech", "note")


@query
def active_characters(spark, d):
    people = spark.createDataFrame(
        [("c1", "Thandor", ["than", "ander"]), ("c2", "Idiot", ["scum", "clown"]), ("c3", "Erin", None)],
        "id string, name string, aliases array<string>",
    )
    return review.active_characters(scenes.scene_text(segmented(spark, d)), people)


# --- scoring


def _benchmark_pairs(spark, d) -> DataFrame:
    b = load(spark, d, "benchmark")
    return b.select("item_id", F.col("text").alias("reference")).join(
        b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("hypothesis")),
        "item_id",
    )


@query
def chrf_pairs(spark, d):
    return scoring.chrf(_benchmark_pairs(spark, d), ["item_id"])


@query
def chrf_words(spark, d):
    return scoring.chrf(_benchmark_pairs(spark, d), ["item_id"], words=2)


def _gold(spark, d) -> DataFrame:
    b = load(spark, d, "benchmark")
    text = F.col("text")
    got = F.when(F.col("item_id") % 5 == 0, F.concat(text, F.lit(" !"))).when(F.col("item_id") % 5 == 1, F.lower(text)).when(
        F.col("item_id") % 5 == 2,
        F.concat(F.lit("wrong "), text),
    ).when(F.col("item_id") % 5 == 3, F.lit("ok")).otherwise(F.substring(text, 1, 40))
    return b.select(
        F.col("item_id").alias("id"),
        F.concat(F.lit("cat"), F.col("item_id") % 3).alias("category"),
        text.alias("gold"),
        F.array(F.lower(text)).alias("alternatives"),
        F.array(F.lit("wrong")).alias("literals"),
        got.alias("translation"),
    )


@query
def gold_scoring(spark, d):
    return scoring.gold_verdicts(_gold(spark, d)).select("id", "category", "literal", "exact", "acceptable", "score_x100")


@query
def category_rollup(spark, d):
    g = _gold(spark, d)
    return scoring.category_report(scoring.gold_verdicts(g).join(scoring.gold_chrf(g), "id"))


@query
def ensemble_consensus(spark, d):
    """Two providers, the second without every third cue."""
    c = lines(spark, d)
    first = c.select("track_id", "seq", T.dictionary_translation(F.col("line")).alias("translation"))
    second = c.where("seq % 3 <> 0").select("track_id", "seq", T.dictionary_translation(F.lower("line")).alias("translation"))
    return scoring.ensemble(first, second).select("track_id", "seq", F.length("second").alias("second_length"), "score")


@query
def benchmark_run(spark, d):
    """A gold set through the built-in provider, scored by category."""
    b = load(spark, d, "benchmark")
    text = F.col("text")
    gold = F.when(F.col("item_id") % 3 == 0, T.dictionary_translation(text)).otherwise(F.lit("سڵاو هاوڕێم"))
    items = b.select(
        F.col("item_id").alias("id"),
        F.concat(F.lit("cat"), F.col("item_id") % 4).alias("category"),
        text.alias("source"),
        gold.alias("gold"),
        F.array(T.dictionary_translation(F.lower(text))).alias("alternatives"),
        F.array(F.lit("وشە")).alias("literals"),
    )
    return scoring.benchmark(items, provider.DictionaryProvider())


@query
def diff_metrics(spark, d):
    pairs = cues(spark, d).select(
        "track_id",
        "seq",
        "source_text",
        F.col("target_text").alias("original"),
        F.regexp_replace("target_text", "ا", "").alias("revised"),
    )
    return scoring.compare(pairs).select("track_id", "seq", "has_changes", "wer", "cer", F.length("diff_html").alias("html_length"))


@query
def edit_distance(spark, d):
    """Over the printable ASCII characters, which every engine counts alike."""
    p = _benchmark_pairs(spark, d).withColumns({k: F.regexp_replace(k, "[^ -~]", "") for k in ("reference", "hypothesis")})
    return p.select("item_id", F.levenshtein("reference", "hypothesis").cast("long").alias("distance"), F.length("reference").cast("long").alias("n"))


@query
def asr_mismatch(spark, d):
    c = cues(spark, d).select("track_id", "seq", F.lower("source_text").alias("a"), F.lower(F.regexp_replace("source_text", "th", "t")).alias("b"))
    return c.select("track_id", "seq", F.round(F.lit(1.0) - scoring.match_ratio("a", "b"), 3).alias("mismatch"))


# --- translation memory and providers


def _memory(spark, d) -> DataFrame:
    return load(spark, d, "conversations").where("text IS NOT NULL").groupBy(F.col("text").alias("source_text")).agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("tm_id")).select(
        "tm_id",
        "source_text",
        F.translate(F.lower("source_text"), "aeiou", "اێیۆو").alias("target_text"),
    )


@query
def tm_exact(spark, d):
    return memory.exact(
        load(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit(" "), F.col("text"), F.lit(" ")).alias("source_text")),
        _memory(spark, d),
    ).select("conv_id", "turn", "tm_id")


@query
def tm_fuzzy(spark, d):
    c = lines(spark, d).select("track_id", "seq", F.regexp_replace("line", "and", "nd").alias("source_text"))
    m = lines(spark, d).groupBy(F.col("line").alias("source_text")).agg(
        F.min(F.col("track_id").cast("long") * 1000 + F.col("seq")).alias("tm_id"),
    ).select("tm_id", "source_text", F.col("source_text").alias("target_text"))
    return memory.fuzzy(c, m, ["track_id", "seq"]).drop("tm_target")


@query
def tm_upsert(spark, d):
    old = load(spark, d, "documents").where("text IS NOT NULL").select(
        F.col("doc_id").alias("tm_id"),
        F.sha2("text", 256).alias("source_text"),
        F.col("source").alias("target_text"),
        F.lit(None).cast("string").alias("context_notes"),
        F.lit(1).cast("long").alias("version"),
    )
    new = old.withColumns({"tm_id": F.col("tm_id") + 1000000, "version": F.lit(2).cast("long"), "target_text": F.upper("target_text")}).where("tm_id % 2 = 0")
    return memory.upsert(old, new).select("tm_id", "source_text", "target_text", "version")


@query
def translate_missing(spark, d):
    return provider.translate_missing(cues(spark, d), provider.DictionaryProvider()).select("track_id", "seq", "origin", "target_text")


@query
def tm_hit_rate(spark, d):
    hits = memory.exact(
        lines(spark, d).select("track_id", "seq", F.col("line").alias("source_text")),
        _memory(spark, d),
    ).select("track_id", "seq", F.lit(1).alias("hit"))
    return lines(spark, d).join(hits, ["track_id", "seq"], "left").agg(F.count("*").alias("cues"), F.count("hit").alias("hits"))


# --- review and cost


def _corrections(spark, d) -> DataFrame:
    docs = load(spark, d, "documents")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("src "), F.col("lang")).alias("source_text"),
        F.col("source").alias("original_translation"),
        F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.upper("source")).alias("corrected_translation"),
        F.when(F.col("doc_id") % 2 == 0, "edit").otherwise("accept").alias("correction_type"),
        F.concat(F.lit("p"), F.col("doc_id") % 4).alias("project_id"),
        F.lit(None).cast("string").alias("scene_id"),
        F.timestamp_seconds(F.col("doc_id") % 977).alias("ts"),
    )


@query
def recorded_corrections(spark, d):
    """Corrections without a source or a corrected text aren't kept."""
    c = _corrections(spark, d)
    gaps = c.withColumns({
        "source_text": F.when(F.col("id") % 5 != 0, F.col("source_text")),
        "corrected_translation": F.when(F.col("id") % 6 == 0, F.lit("")).otherwise(F.col("corrected_translation")),
    })
    return review.record(gaps).select("id", "source_text", "corrected_translation")


@query
def frequent_corrections(spark, d):
    return review.frequent(_corrections(spark, d))


@query
def recent_corrections(spark, d):
    return review.recent(_corrections(spark, d), 50, "p1").select("id", "source_text")


@query
def training_export(spark, d):
    return writers.training_rows(_corrections(spark, d)).select("id", "line")


@query
def cost_scene(spark, d):
    return cost.scene_cost(segmented(spark, d), MODEL)


@query
def cost_file(spark, d):
    return cost.file_cost(cues(spark, d), "gpt-4o")


@query
def budget_running(spark, d):
    calls = cost.scene_cost(segmented(spark, d), MODEL).select(F.col("track_id").alias("project_id"), F.col("scene_no").alias("call_id"), "usd_e6")
    return cost.ledger(calls, 1000)


@query
def resume_scenes(spark, d):
    c = segmented(spark, d)
    saved = c.where("scene_no = 1").select("track_id", "scene_no", "seq", F.lit("saved").alias("target_text"))
    done, todo = review.resume(c, saved)
    return done.select("track_id", "seq", F.lit("done").alias("state")).unionByName(todo.select("track_id", "seq", F.lit("todo").alias("state")))


def _localized(spark, d) -> DataFrame:
    fresh = cues(spark, d).withColumn("target_text", F.lit(None).cast("string"))
    return process.localize(scenes.segment(fresh))


@query
def localized_scenes(spark, d):
    """The whole way from untranslated cues to evaluated ones, a row for each scene."""
    out = _localized(spark, d).groupBy("track_id", "scene_no")
    critical = F.size(F.filter("issues", lambda x: x["severity"] == "critical"))
    return out.agg(
        F.count("*").alias("cues"),
        F.count_if("passed").alias("passed"),
        F.count_if("requires_review").alias("for_review"),
        F.sum(critical).cast("long").alias("critical_issues"),
        F.sum("overall").cast("long").alias("points"),
        F.sum("end_ms").alias("ends"),
        F.sum(F.length("target_text")).alias("chars"),
        F.count_if(F.col("origin") == "routed").alias("routed"),
    )


@query
def localized_opinions(spark, d):
    """What the built-in provider means and decides, cue by cue."""
    return _localized(spark, d).select("track_id", "seq", "meaning", "origin", "decision", "alternative", "escalated")


@query
def localized_summary(spark, d):
    return process.summarize(_localized(spark, d))


@query
def term_search(spark, d):
    """A dictionary that grows with the texts: all longer words of the lines, each with the number of lines that hold it anywhere."""
    rows = lines(spark, d).select("track_id", "seq", F.lower("line").alias("line"))
    terms = rows.select(F.explode(T.tokens(F.col("line"))).alias("term")).where("length(term) >= 8").distinct()
    return review.contains_join(rows, terms, "line").groupBy("term").agg(F.count("*").alias("lines"))


@query
def resumed_scenes(spark, d):
    """Three runs over one state: all tracks; then without every fifth track and with every 31st cue changed; then the same again, and no work.  A row for each scene: the run that made it."""
    state = StateTable(spark, scratch(spark), "track_id string, scene_no int, scene_key string, status string, cues array<struct<seq: long, run: int, failed: boolean>>", process.SCENE_KEY)
    first = cues(spark, d)
    changed = first.where("cast(track_id as long) % 5 <> 0").withColumn("source_text", F.when(F.col("seq") % 31 == 0, "changed").otherwise(F.col("source_text")))
    for run, rows in ((1, first), (2, changed), (3, changed)):
        seg = scenes.segment(rows)
        work = lambda todo, run=run: todo.select("track_id", "scene_no", "seq", F.lit(run).alias("run"), F.lit(False).alias("failed"))
        out, _ = process.resume_scenes(state, seg, process.scene_keys(seg), work)
    return out.groupBy("track_id", "scene_no").agg(F.max("run").alias("run"), F.count("*").alias("cues"))


@query
def nested_tracks(spark, d):
    """Tracks as SRT files of a few base names in seven folders, written and read again by their paths below the top."""
    at = scratch(spark)
    named = cues(spark, d).withColumn("n", F.col("track_id").cast("long"))
    named = named.withColumn("track_id", F.concat(F.lit("s"), F.col("n") % 7, F.lit("/film"), F.expr("n div 7"), F.lit(".srt")))
    writers.save_tracks(named.withColumn("target_text", F.lit(None).cast("string")), at, "srt")
    got = subtitles.read_files(spark, f"{at}/srt").withColumn("path", subtitles.below(spark, f"{at}/srt", F.col("path")))
    rows, _ = subtitles.scan(got)
    return rows.select("track_id", F.col("cue_id").cast("long").alias("seq"), "start_ms", "end_ms", "source_text")


@query
def overlay_edits(spark, d):
    c = cues(spark, d)
    edits = c.where("seq % 3 = 0").select(
        "track_id",
        "seq",
        F.explode(F.array(F.lit(1), F.lit(2))).alias("version"),
    ).withColumn("target_text", F.concat(F.lit("edit "), F.col("version")))
    return review.overlay(c, edits).select("track_id", "seq", "target_text")


@query
def zip_files(spark, d):
    a = cues(spark, d).select("track_id", "seq", "source_text")
    b = cues(spark, d).where("seq % 5 <> 0").select("track_id", "seq", "target_text")
    return review.zip_files(a, b)


@query
def first_interpretation(spark, d):
    c = cues(spark, d).select("track_id", "seq")
    said = c.where("seq % 2 = 1").select(
        "track_id",
        F.col("seq").alias("pos"),
        F.array("seq", F.col("seq") + 1, F.col("seq") + 2).alias("cue_ids"),
        F.concat(F.lit("m"), F.col("seq")).alias("meaning"),
    )
    return review.first_interpretation(c, said)


# --- sources and sinks


@query
def export_srt(spark, d):
    # numbered anew, whatever seq is
    return writers.to_srt(cues(spark, d).withColumn("seq", F.col("seq") * 3 + 5)).select(
        "track_id",
        F.sha2("content", 256).alias("content_hash"),
        F.length("content").alias("n_chars"),
    )


@query
def export_vtt(spark, d):
    return writers.to_vtt(cues(spark, d)).select("track_id", F.sha2("content", 256).alias("content_hash"), F.length("content").alias("n_chars"))


@query
def export_ass(spark, d):
    return writers.to_ass(cues(spark, d)).select("track_id", F.sha2("content", 256).alias("content_hash"), F.length("content").alias("n_chars"))


@query
def export_html(spark, d):
    ev = evaluated(spark, d)
    qc = ev.where("seq % 5 <> 0").select(
        "track_id",
        "seq",
        F.lit(1).alias("version"),
        F.col("overall").alias("confidence"),
        "passed",
        F.transform("issues", lambda x: x["message"]).alias("messages"),
    )
    return writers.to_html(cues(spark, d), qc).select("track_id", F.sha2("content", 256).alias("content_hash"), F.length("content").alias("n_chars"))


@query
def qc_report(spark, d):
    """The report's totals, and what its evaluations add up to."""
    rep = writers.to_qc_report(evaluated(spark, d))
    shape = "total_cues long, passed_cues long, review_required_cues long, average_confidence double, evaluations array<struct<seq: long, overall: long, issues: array<struct<rule: string, points: long, status: string>>>>"
    r = rep.select("track_id", F.from_json("content", shape).alias("r")).select("track_id", "r.*")
    fired = F.flatten(F.transform("evaluations", lambda e: e["issues"]))
    return r.select(
        "track_id", "total_cues", "passed_cues", "review_required_cues", F.round(F.col("average_confidence") * 1000).cast("long").alias("average_permille"), F.size("evaluations").cast("long").alias("evaluations"), F.aggregate(
            "evaluations",
            F.lit(0).cast("long"),
            lambda a,
            e: a + e["overall"],
        ).alias("points"),
        F.aggregate(fired, F.lit(0).cast("long"), lambda a, i: a + i["points"]).alias("lost"), F.array_join(
            F.transform("evaluations", lambda e: e["seq"].cast("string")),
            ",",
        ).alias("seqs"), F.size(F.filter(fired, lambda i: i["status"] == "open")).cast("long").alias("open_issues"),
    )


def _roundtrip(spark, d, write, ext: str) -> DataFrame:
    shown = cues(spark, d).withColumn("target_text", F.lit(None).cast("string"))
    files = write(shown).withColumn("path", F.concat("track_id", F.lit(ext)))
    got, _ = subtitles.scan(files)
    return got.select(
        F.regexp_replace("track_id", r"\.[a-z]+$", "").alias("track_id"),
        F.col("cue_id").cast("long").alias("seq"),
        "start_ms",
        "end_ms",
        "source_text",
        "speaker",
    )


@query
def srt_roundtrip(spark, d):
    return _roundtrip(spark, d, writers.to_srt, ".srt")


@query
def vtt_roundtrip(spark, d):
    return _roundtrip(spark, d, writers.to_vtt, ".vtt")


@query
def ass_roundtrip(spark, d):
    return _roundtrip(spark, d, writers.to_ass, ".ass")


@query
def decoded_files(spark, d):
    """Every second text as Latin-1 bytes."""
    latin = F.regexp_replace("text", r"[^\x00-\xFF]", "?")
    raw = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode(latin, "ISO-8859-1"))
    docs = load(spark, d, "documents").select("doc_id", raw.alias("content"))
    return docs.select("doc_id", F.sha2(subtitles.decoded(F.col("content")), 256).alias("text_hash"))


@query
def file_guards(spark, d):
    """Why files of these contents and sizes can't be scanned."""
    content = F.when(F.col("doc_id") % 7 == 0, F.lit(" \n\t")).when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(F.col("text"))
    files = load(spark, d, "documents").select(F.col("doc_id").alias("path"), content.alias("content"))
    sized = files.withColumn("size", F.when(F.col("path") % 13 == 0, F.lit(subtitles.MAX_BYTES + 1)).otherwise(F.octet_length("content")))
    return subtitles.guard(sized)


@query
def track_ranking(spark, d):
    """Sidecars and embedded streams of each media file; one without either asks for speech recognition."""
    pages = load(spark, d, "pages").select("page_id", "url", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("media"))
    listed = pages.select(
        "media",
        F.concat(F.col("url"), F.when(F.col("page_id") % 3 == 0, ".en.srt").when(F.col("page_id") % 3 == 1, ".forced.ass").otherwise(".txt")).alias("path"),
    ).where(F.length("media") % 3 != 0)
    probe = F.when(
        F.col("page_id") % 4 == 0,
        F.lit('{"streams":[{"codec_type":"video"},{"codec_type":"subtitle","codec_name":"subrip","tags":{"language":"eng","title":"SDH"}}]}'),
    ).when(F.col("page_id") % 4 == 1, F.lit('{"streams":[{"codec_type":"subtitle"}]}')).otherwise(F.lit("no probe"))
    probes = pages.where(F.length("media") % 3 == 1).groupBy("media").agg(F.max("page_id").alias("page_id")).select("media", probe.alias("probe"))
    return subtitles.master_track(subtitles.track_candidates(listed).unionByName(subtitles.embedded_candidates(probes)), files=pages)


@query
def response_content(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.col("source").alias("s"))
    body = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit('{"choices":[{"message":{"content":"'), F.col("s"), F.lit('"}}]}'))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit('{"content":[{"text":"'), F.col("s"), F.lit('"}]}'))).when(
        F.col("doc_id") % 4 == 2,
        F.concat(F.lit('{"candidates":[{"content":{"parts":[{"text":"'), F.col("s"), F.lit('"}]}}]}')),
    ).otherwise(F.lit("{}"))
    return docs.select("doc_id", R.content(body).alias("content"))


#: An item for each remainder of doc_id, and the ids it must give ({0} stands for doc_id).
ITEMS = [
    (
        '{{"cue_ids":[{0},"{0}","x",null]}}',
        "{0},{0}",
    ), ('{{"cue_id":"{0}"}}', "{0}"), ('{{"id":{0}}}', "{0}"), ('{{"cue_ids":"none"}}', "1"), ("{{}}", "1"), ('{{"cue_ids":[-{0}.5,{0}.9]}}', "-{0},{0}"), ('{{"cue_ids":["{0}.5"]}}', "1"),
    ('{{"cue_id":-{0}.7}}', "-{0}"), (
        '{{"cue_ids":null,"cue_id":null,"id":" {0} "}}',
        "{0}",
    ), ('{{"cue_ids":[],"id":{0}}}', "1"), ('{{"cue_ids":{{"a":{0}}}}}', "1"), ("no JSON {0}", "1"), ('{{"cue_ids":[[{0}],true,{0}]}}', "1,{0}"),
]


def _by_remainder(texts: list[str], n: str = "doc_id") -> Column:
    out = F.lit(None).cast("string")
    for k, t in enumerate(texts):
        plain = t.replace("{{", "{").replace("}}", "}").split("{0}")
        parts = [x for i, piece in enumerate(plain) for x in ((F.col(n).cast("string"), F.lit(piece)) if i else (F.lit(piece),))]
        out = F.when(F.col(n) % len(texts) == k, F.concat(*parts)).otherwise(out)
    return out


@query
def cue_id_coercion(spark, d):
    return load(spark, d, "documents").select("doc_id", F.array_join(R.cue_ids(_by_remainder([a for a, _ in ITEMS])), ",").alias("ids"))


#: Answers of a model, and what they hold.
ANSWERS = [
    ('```json\n{{"id": {0}}}\n```', '{{"id": {0}}}'), ("Sure: [{0}] done", '{{"items": [{0}], "translations": [{0}]}}'), ("nothing here {0}", "{{}}"), (
        "```\n[{0}, 1]",
        '{{"items": [{0}, 1], "translations": [{0}, 1]}}',
    ), ('So {{"a": [{0}]}} it is', '{{"a": [{0}]}}'),
    (
        "Text ```JSON [{0}]``` and more",
        '{{"items": [{0}], "translations": [{0}]}}',
    ), ("broken {{ x }} then [{0}]", '{{"items": [{0}], "translations": [{0}]}}'), ('{{"a": {0}', "{{}}"),
]


@query
def lenient_json(spark, d):
    return load(spark, d, "documents").select("doc_id", R.lenient_json(_by_remainder([a for a, _ in ANSWERS])).alias("parsed"))


@query
def project_ids(spark, d):
    return load(spark, d, "pages").select("page_id", R.valid_project(F.regexp_extract("url", "/([^/]*)$", 1)).alias("valid"))
