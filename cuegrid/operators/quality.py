"""The QC rule engine: one projection over the cue and its neighbours, in integer points of 100."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuegrid import constants as K
from cuegrid.functions import text as T
from cuegrid.operators.scoring import match_ratio
from cuegrid.operators.timing import metrics, neighbours
from cuegrid.profiles import HOUSE, Profile

ISSUES = "array<struct<rule: string, category: string, severity: string, points: int, message: string, status: string>>"


def conditions() -> dict[str, Column]:
    """When each rule fires, over the columns that `evaluate` prepares."""
    src, tgt, n_tgt = F.col("clean"), F.col("tgt"), F.length("tgt")
    words, letters = F.col("src_word_chars"), F.col("tgt_letters")
    compared = (src != "") & (n_tgt > 2) & (words > 3) & (letters > 0)
    return {
        "hard_max_cps": F.col("cps_exceeded"), "hard_max_cpl": F.col("cpl_exceeded"), "max_lines": F.col("lines_exceeded"), "min_duration": F.col("too_short"),
        "kurmanji_contamination": F.size("found_kurmanji") > 0, "untranslated_english": F.size("found_english") > 0, "llm_error_pattern": F.size("found_llm") > 0, "excessive_ezafe_chain": F.size("found_ezafe") > 0,
        "number_inconsistency": F.size("lost_numbers") > 0,
        "negation_reversal": src.rlike(r"(?iU)\b(not|n't|never|no)\b") & ~tgt.rlike("|".join(K.TARGET_NEGATIONS)),
        "question_mark_missing": F.contains(src, F.lit("?")) & ~F.contains(tgt, F.lit("؟")) & ~F.contains(tgt, F.lit("?")) & (n_tgt > 2),
        "mock_fallback_detected": F.startswith(tgt, F.lit(K.PLACEHOLDER)) | F.startswith(tgt, F.lit(K.PLACEHOLDER[:-1] + " :")),
        "length_ratio_too_short": compared & (letters * 10 < words * 3), "length_ratio_too_long": compared & (letters > words * 3),
        "duplicate_translation": F.coalesce((F.col("prev_target") == tgt) & (n_tgt > 5), F.lit(False)),
    }


def _hundredths(x: Column) -> Column:
    return F.format_string("%d.%02d", F.floor(x / 100), x % 100)


def messages(profile: Profile) -> dict[str, Column]:
    """What each rule says, over the columns that `evaluate` prepares."""
    joined = lambda x: F.array_join(x, ", ")
    ratio = F.concat(F.lit("ratio "), F.format_string("%d %%", F.floor(F.col("tgt_letters") * 100 / F.greatest(F.lit(1), F.col("src_word_chars")))))
    return {
        "hard_max_cps": F.concat(
            F.lit("reading speed "),
            _hundredths(F.col("cps_x100")),
            F.lit(f" above {profile.hard_max_cps:g} characters a second"),
        ), "hard_max_cpl": F.concat(F.lit("line of "), F.col("max_cpl").cast("string"), F.lit(f" characters above {profile.hard_max_cpl}")),
        "max_lines": F.concat(F.col("line_count").cast("string"), F.lit(f" lines, {profile.max_lines} allowed")), "min_duration": F.concat(
            F.lit("shown for "),
            F.col("duration_ms").cast("string"),
            F.lit(f" ms, less than {profile.min_duration_ms}"),
        ),
        "kurmanji_contamination": F.concat(F.lit("Kurmanji: "), joined("found_kurmanji")), "untranslated_english": F.concat(
            F.lit("English left: "),
            joined("found_english"),
        ),
        "llm_error_pattern": F.concat(F.lit("error patterns: "), joined(F.slice("found_llm", 1, 3))), "excessive_ezafe_chain": F.concat(
            F.lit("chains of words in yeh: "),
            joined(F.transform(F.slice("found_ezafe", 1, 2), lambda n: n.cast("string"))),
        ),
        "number_inconsistency": F.concat(
            F.lit("numbers lost: "),
            joined("lost_numbers"),
        ), "negation_reversal": F.lit("the source denies, the translation may not"), "question_mark_missing": F.lit("question mark lost"),
        "mock_fallback_detected": F.lit(
            "a placeholder, no translation",
        ), "length_ratio_too_short": F.concat(F.lit("very short, "), ratio), "length_ratio_too_long": F.concat(F.lit("very long, "), ratio), "duplicate_translation": F.lit("the same as the cue before"),
    }


def evaluate(cues: DataFrame, names: list[str] | None = None, keys: tuple[str, ...] = ("track_id", "scene_no"), profile: Profile = HOUSE) -> DataFrame:
    """Adds issues (an array, in rule order), the points of each dimension, overall, passed and requires_review.

    names: characters whose names must leave something in the translation; each that does not costs 15 points.
    An issue is open until a reviewer closes it.
    """
    m = metrics(cues, keys, profile)
    if "prev_target" not in cues.columns or "scene_no" not in keys:
        m = m.withColumn("prev_target", F.lag("target_text").over(neighbours(cues, keys)))
    # found once here; the rules below read columns
    base = m.withColumns({"clean": T.clean_source(F.col("source_text"), F.col("speaker")), "tgt": F.coalesce("target_text", F.lit(""))})
    base = base.withColumn("runs", T.runs(F.col("tgt")))
    base = base.withColumns({
        "found_kurmanji": T.kurmanji(F.col("tgt"), F.col("runs")), "found_english": T.untranslated(F.col("tgt")), "found_llm": T.llm_errors(F.col("tgt"), F.col("runs")), "found_ezafe": T.ezafe_chains(F.col("tgt"), F.col("runs")),
        "lost_numbers": F.array_except(T.numbers(F.col("clean")), T.numbers(T.normalize_digits(F.col("tgt")))),
        "src_word_chars": F.length(F.regexp_replace("clean", r"[^\p{L}\p{N}_]", "")), "tgt_letters": F.length(F.regexp_replace("tgt", r"[^\p{L}]", "")),
    })
    when, says = conditions(), messages(profile)
    issue = lambda rule, category, severity, points, message: F.struct(F.lit(rule).alias("rule"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(points).alias("points"), message.alias("message"), F.lit("open").alias("status"))
    fired = [F.when(when[r], issue(r, c, s, p, says[r])) for r, c, s, p in K.RULES if getattr(profile, c)]
    for name in names or []:
        if len(name) > 2 and profile.semantic:
            fired.append(
                F.when(
                    F.contains(F.lower("clean"), F.lit(name.lower())) & (F.length(T.strip(F.col("tgt"))) < 3),
                    issue("proper_noun_missing", "semantic", "major", 15, F.lit(f"the name {name} is lost")),
                ),
            )
    out = base.withColumn("issues", F.array_compact(F.array(*fired)) if fired else F.array().cast(ISSUES))
    points = lambda c: F.greatest(F.lit(0), 100 - F.aggregate(F.filter("issues", lambda x: x["category"] == c), F.lit(0), lambda a, x: a + x["points"]))
    out = out.withColumns({c: points(c) for c in ("technical", "linguistic", "semantic")})
    critical = F.exists("issues", lambda x: x["severity"] == "critical")
    overall = F.floor((20 * 100 + 40 * F.col("semantic") + 20 * F.col("linguistic") + 20 * F.col("technical")) / 100).cast("int")
    out = out.withColumn("overall", overall)
    return out.withColumns({"requires_review": (F.col("overall") < profile.review_below) | critical, "passed": (F.col("overall") >= K.PASS_FROM) & ~critical})


def issues_long(evaluated: DataFrame) -> DataFrame:
    """A row for each issue.  The outer explode, whose empty row is dropped behind it, keeps the optimizer from asking before it which cues have any, by a second copy of all rules."""
    return evaluated.select("track_id", "seq", F.explode_outer("issues").alias("i")).where("i IS NOT NULL").select("track_id", "seq", "i.*")


def cue_records(cues: DataFrame, heard: DataFrame | None = None, text: str = "source_text") -> DataFrame:
    """The verification record of each cue: mismatch with what was heard (heard: track_id, seq, transcript; 0 without it), flags for names and foreign speech, and a note."""
    clean = T.clean_source(F.col(text), F.col("speaker"))
    out = cues.join(heard, ["track_id", "seq"], "left") if heard is not None else cues.withColumn("transcript", F.lit(None).cast("string"))
    said = F.coalesce("transcript", F.lit("")) != ""
    foreign = F.col("foreign_language") if "foreign_language" in cues.columns else F.lit(False)
    out = out.withColumns({"clean": clean, "names": T.suspicious_names(clean)})
    return out.select(
        "track_id", "seq", F.when(
            said,
            F.round(1.0 - match_ratio(F.lower("clean"), F.lower("transcript")), 3),
        ).otherwise(0.0).alias("mismatch"), F.lit(False).alias("missing_speech"), (F.size("names") > 0).alias("suspicious_names"),
        (
            F.coalesce(foreign, F.lit(False)) | F.col("clean").rlike(r"(?iU)\[(speaking|in)\s+[a-z]+\]")
        ).alias("foreign_speech"), F.when(said, F.col("transcript")).alias("transcript"), F.when(F.size("names") > 0, F.concat(F.lit("possible names: "), F.size("names"))).alias("note"),
    )


def summary(evaluated: DataFrame, *keys: str) -> DataFrame:
    """Counts for each key: cues, passed, for review, critical issues, sum of the overall points."""
    critical = F.size(F.filter("issues", lambda x: x["severity"] == "critical"))
    return evaluated.groupBy(*keys).agg(
        F.count("*").alias("cues"),
        F.count_if("passed").alias("passed"),
        F.count_if("requires_review").alias("for_review"),
        F.sum(critical).cast("long").alias("critical_issues"),
        F.sum("overall").cast("long").alias("points"),
    )


def findings(texts: DataFrame, text: str = "text") -> DataFrame:
    """Findings of each detector over all texts: category, n_findings, n_texts."""
    t = F.col(text)
    known = texts.select(F.coalesce(t, F.lit("")).alias(text)).withColumn("runs", T.runs(t))
    found = {
        "kurmanji": T.kurmanji(t, F.col("runs")),
        "untranslated": T.untranslated(t),
        "ezafe": T.ezafe_chains(t, F.col("runs")),
        "llm_errors": T.llm_errors(t, F.col("runs")),
    }
    sizes = known.select(F.explode(F.create_map(*[x for k, f in found.items() for x in (F.lit(k), F.size(f))])).alias("category", "n"))
    return sizes.groupBy("category").agg(F.sum("n").cast("long").alias("n_findings"), F.count_if(F.col("n") > 0).alias("n_texts"))


def verification(evaluated: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The second opinion, asked for only where confidence is low or an issue critical.  verdicts: track_id, seq, decision, severity, alternative.  Never overrides."""
    # one pass over the evaluated cues: a verdict that wasn't asked for doesn't count
    joined = evaluated.select("track_id", "seq", "requires_review").join(verdicts, ["track_id", "seq"], "left")
    joined = joined.withColumns({c: F.when(F.col("requires_review"), F.col(c)) for c in ("decision", "severity", "alternative")})
    decision, severity = F.coalesce("decision", F.lit("agree")), F.coalesce("severity", F.lit("none"))
    escalate = F.col("requires_review") & (decision.isin("disagree", "uncertain") | severity.isin("major", "critical"))
    return joined.select("track_id", "seq", decision.alias("decision"), severity.alias("severity"), "alternative", escalate.alias("escalated"))
