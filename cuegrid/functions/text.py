"""Column builders over text: cleaning, normalization, line breaks, detectors.  All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuegrid import constants as K

ARABIC_RUN = "[\\u0600-\\u06FF]+"


def strip(x: Column) -> Column:
    """Without blanks of any kind at both ends (Spark's trim knows spaces only)."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def tokens(x: Column) -> Column:
    """Runs of non-blanks."""
    return F.filter(F.split(x, r"(?U)\s+"), lambda t: t != "")


def clean_source(text: Column, speaker: Column | None = None) -> Column:
    """Without tags, style overrides and the speaker's label."""
    out = F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), r"\{[^}]+\}", "")
    if speaker is not None:
        label = F.concat(speaker, F.lit(":"))
        out = F.when(speaker.isNotNull() & (speaker != "") & F.startswith(out, label), F.substring(out, F.length(label) + 1, F.length(out))).otherwise(out)
    return strip(out)


def speaker_label(text: Column) -> Column:
    """The label in capitals before a colon, 30 characters at most, else null."""
    name = strip(F.regexp_extract(text, r"(?sU)^([A-Z0-9\s_]+):\s*(.*)", 1))
    return F.when(text.rlike(r"(?sU)^[A-Z0-9\s_]+:") & (F.length(name) <= 30), name)


def normalize_letters(x: Column) -> Column:
    return strip(F.regexp_replace(F.translate(x, K.LETTERS_FROM, K.LETTERS_TO), r"[ \t]+", " "))


def normalize_punctuation(x: Column) -> Column:
    out = F.when(x.rlike("[\\u0600-\\u06FF]"), F.translate(x, "?,;", "؟،؛")).otherwise(x)
    for pattern, to in (("؟{2,}", "؟"), ("!{2,}", "!"), ("…", "..."), (r"\.{4,}", "..."), (r"(?U)\s+([،؛؟])", "$1"), (r"(?U)([،؛؟])(?=[^\s،؛؟)])", "$1 ")):
        out = F.regexp_replace(out, pattern, to)
    return out


def normalize_digits(x: Column) -> Column:
    return F.translate(x, K.DIGITS_FROM, K.DIGITS_TO)


def rtl_marks(x: Column) -> Column:
    head = F.when((x != "") & ~F.startswith(x, F.lit(K.RLM)), F.concat(F.lit(K.RLM), x)).otherwise(x)
    return F.when((head != "") & ~F.endswith(head, F.lit(K.RLM)), F.concat(head, F.lit(K.RLM))).otherwise(head)


def normalize(x: Column, letters: bool = True, punctuation: bool = True, digits: bool = False, marks: bool = False) -> Column:
    out = F.coalesce(x, F.lit(""))
    for on, step in ((letters, normalize_letters), (punctuation, normalize_punctuation), (digits, normalize_digits), (marks, rtl_marks)):
        out = step(out) if on else out
    return out


def score_key(x: Column) -> Column:
    """Normalized, without outer marks, for comparing translations."""
    return F.call_function("btrim", normalize(x), F.lit(".,!؟? "))


def line_breaks(text: Column, width: int = K.PREFERRED_CPL) -> Column:
    """Two lines, broken at the word end nearest to the middle; five characters are granted to a clause's end."""
    flat = strip(F.regexp_replace(text, "\n", " "))
    # bound by lambdas, so that each is made once
    bind = lambda x, f: F.transform(F.array(x), f)[0]

    def broken(t: Column, words: Column) -> Column:
        half = F.floor(F.length(t) / 2).cast("int")
        state = lambda upto, i, d, at: F.struct(upto.alias("upto"), i.alias("i"), d.alias("d"), at.alias("at"))

        def step(s: Column, w: Column) -> Column:
            upto = s["upto"] + F.length(w) + 1
            cost = F.abs(upto - half) - F.when(w.rlike("[،؛.]$"), 5).otherwise(0)
            return state(upto, s["i"] + 1, F.least(s["d"], cost), F.when(cost < s["d"], s["i"] + 1).otherwise(s["at"]))

        # one pass over the words but the last: the length so far, and the best break so far
        best = F.aggregate(F.slice(words, F.lit(1), F.size(words) - 1), state(F.lit(0), F.lit(0), F.lit(999), F.lit(0)), step)
        cut = lambda i: F.when(i > 0, F.concat(F.array_join(F.slice(words, F.lit(1), i), " "), F.lit("\n"), F.array_join(F.slice(words, i + 1, F.size(words)), " "))).otherwise(t)
        return bind(best["at"], cut)

    return bind(flat, lambda t: F.when(F.length(t) <= width, t).otherwise(bind(tokens(t), lambda ws: F.when(F.size(ws) <= 2, t).otherwise(broken(t, ws)))))


def runs(x: Column) -> Column:
    """Runs of letters of the Arabic block."""
    return F.regexp_extract_all(x, F.lit(ARABIC_RUN), 0)


def kurmanji(x: Column, arabic: Column | None = None) -> Column:
    """Distinct Kurmanji letters and markers, sorted.  arabic: the text's runs, where they are known."""
    chars = F.regexp_extract_all(x, F.lit(f"[{K.KURMANJI_CHARS}]"), 0)
    markers = F.filter(runs(x) if arabic is None else arabic, lambda w: w.isin(K.KURMANJI_MARKERS))
    return F.array_sort(F.array_distinct(F.concat(chars, markers)))


def untranslated(x: Column) -> Column:
    """English words of two letters or more that aren't allowed, in order."""
    return F.filter(F.regexp_extract_all(x, F.lit(r"(?U)\b[A-Za-z]{2,}\b"), 0), lambda w: ~F.lower(w).isin(K.ALLOWED_ENGLISH))


def ezafe_chains(x: Column, arabic: Column | None = None) -> Column:
    """Lengths of the chains of four or more words in a row that end in ی."""
    marks = F.array_join(F.transform(runs(x) if arabic is None else arabic, lambda w: F.when(F.endswith(w, F.lit("ی")), "1").otherwise("0")), "")
    return F.transform(F.regexp_extract_all(marks, F.lit("1{4,}"), 0), lambda run: F.length(run))


def llm_errors(x: Column, arabic: Column | None = None) -> Column:
    """Names of the error patterns, once for each finding."""
    arabic = runs(x) if arabic is None else arabic
    kaf = F.transform(F.filter(arabic, lambda w: F.contains(w, F.lit("ك")) & F.contains(w, F.lit("ی"))), lambda _: F.lit("mixed_script"))
    yeh = F.transform(F.filter(arabic, lambda w: F.contains(w, F.lit("ي"))), lambda _: F.lit("arabic_yeh"))
    triple = F.transform(
        F.array(tokens(x)),
        lambda ws: F.transform(
            F.filter(
                F.when(F.size(ws) > 2, F.sequence(F.lit(0), F.size(ws) - 3)).otherwise(F.array().cast("array<int>")),
                lambda i: (F.get(ws, i) == F.get(ws, i + 1)) & (F.get(ws, i) == F.get(ws, i + 2)) & (F.length(F.get(ws, i)) > 1),
            ),
            lambda _: F.lit("triple_word"),
        ),
    )[0]
    single = F.array_compact(
        F.array(
            F.when(x.rlike(r"\([^)]*[A-Za-z]{3,}[^)]*\)"), "note"),
            F.when(F.contains(x, F.lit("**")) | F.contains(x, F.lit("__")), "markdown"),
            F.when(x.rlike(r"(?U)^\d+[.)]\s"), "numbered_list"),
        ),
    )
    return F.concat(kaf, yeh, triple, single)


def suspicious_names(x: Column) -> Column:
    """Distinct capitalised words, sorted; the first word only when longer than four letters."""
    bare = F.transform(tokens(x), lambda w: F.call_function("btrim", w, F.lit(".,!?\"'()[]")))
    cased = lambda w: (F.substring(w, 1, 1).rlike(r"^\p{Lu}")) & (F.upper(w) != w)
    return F.array_sort(F.array_distinct(F.filter(bare, lambda w, i: cased(w) & ((i > 0) | (F.length(w) > 4)))))


def numbers(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(r"(?U)\b\d+\b"), 0))


def dictionary_translation(text: Column) -> Column:
    """The first phrase inside the text decides, else the text behind a placeholder."""
    phrases = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in K.PHRASES])
    low = F.call_function("btrim", F.lower(text), F.lit(".,!?\"'"))
    # a folded list keeps the generated code small
    hit = F.transform(F.array(low), lambda t: F.get(F.filter(phrases, lambda p: F.contains(t, p["k"])), F.lit(0))["v"])[0]
    return F.coalesce(hit, F.concat(F.lit(K.PLACEHOLDER + " "), text))


def glossary(custom: dict[str, tuple[str, str]] | None = None) -> list[tuple[str, str]]:
    """The honorifics in force, in order: the fixed ones and the project's own terms (source: target, category).  A term of another category takes the place of an honorific of the same key and then changes nothing."""
    terms = {key: (name, "honorific") for key, name in K.HONORIFICS}
    for source, (target, category) in (custom or {}).items():
        terms[source.strip().lower()] = (target.strip(), category)
    return [(key, name) for key, (name, category) in terms.items() if category == "honorific"]


def enforce_honorifics(source: Column, target: Column, terms: list[tuple[str, str]] | None = None) -> Column:
    """Honorifics of the source that the target lacks are put before it, in order."""
    low = F.lower(source)
    hit = lambda key: low.rlike(rf"(?U)(?:\b|^)\Q{key}\E(?:\b|$|\s)")
    named = F.array_compact(F.array(*[F.when(hit(key), F.lit(name)) for key, name in (K.HONORIFICS if terms is None else terms)]))
    # a fold: each step sees what the ones before have put in front
    out = F.aggregate(named, target, lambda t, name: F.when(F.contains(t, name), t).otherwise(F.concat(name, F.lit(" "), t)))
    return F.when(target.isNull() | (target == ""), target).otherwise(out)


def route(clean: Column, foreign: Column | None = None) -> Column:
    """case_type, opaque, indicator and action of foreign dialogue."""
    opaque = r"(?i)^\[(speaking|in|speaks)\s+([a-z\s]+)\]$"
    language = strip(F.regexp_extract(clean, opaque, 2))
    names = F.create_map(*[F.lit(x) for kv in K.LANGUAGES.items() for x in kv])
    indicator = normalize(F.concat(F.lit("["), F.coalesce(F.try_element_at(names, F.lower(language)), language), F.lit(f" {K.SPEAKS}]")))
    made = lambda case, action, ind=F.lit(None).cast("string"), o=False: F.struct(F.lit(case).alias("case_type"), F.lit(o).alias("opaque"), ind.alias("indicator"), F.lit(action).alias("action"))
    missing = (foreign if foreign is not None else F.lit(False)) & (clean == "")
    return F.when(
        clean.rlike(opaque),
        made("B", "preserve_opaque", indicator, True),
    ).when(missing, made("D", "transcribe_exception")).otherwise(made("A", "translate"))


def content_key(*parts: Column) -> Column:
    """SHA-256 of a canonical JSON of the parts."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])), 256)
