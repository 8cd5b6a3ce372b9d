"""The SQL that queries must equal, for engines with ANSI windows, lists and recursive CTEs."""

from __future__ import annotations

import re

from cuegrid import constants as K
from cuegrid.plans.cues import LATIN, NOUN, SAME, SCRIPT
from cuegrid.plans.queries import ANSWERS, ITEMS
from cuegrid.sources.writers import PAGE

SQL: dict[str, str] = {}
WORD = r"[\p{L}\p{N}_]+"


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listing(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def toks(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda t: t <> '')"


LINES = r"""
flat AS (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM conversations),
lines AS (SELECT CAST(conv_id AS VARCHAR) AS track_id, turn, role, line, row_number() OVER (PARTITION BY conv_id ORDER BY turn, line_no, line, role) AS seq FROM flat WHERE regexp_matches(line, '\S'))"""

CUES = f"""{LINES},
timed AS (SELECT *, 400 + (length(line) * 53) % 4000 AS dur, (length(line) * 131 + turn * 977) % 5000 AS gap, translate(lower(line), {q(LATIN)}, {q(SCRIPT)}) AS script FROM lines),
cues AS (SELECT track_id, seq, CAST(sum(dur + gap) OVER (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING) - dur - gap AS BIGINT) AS start_ms,
  CAST(sum(dur + gap) OVER (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING) - gap AS BIGINT) AS end_ms,
  CASE WHEN seq % 13 = 0 THEN '[Speaking Spanish]' WHEN seq % 17 = 0 THEN '[in French] ' || line WHEN seq % 19 = 0 THEN 'JOHN: ' || line WHEN seq % 23 = 0 THEN '<i>' || line || '</i> {{b}}'
    WHEN seq % 29 = 0 THEN line || ' 42' WHEN seq % 11 = 0 THEN line || '?' WHEN seq % 7 = 0 THEN line || ' never' ELSE line END AS source_text,
  CASE WHEN seq % 31 = 0 THEN NULL WHEN seq % 26 = 0 THEN '' WHEN seq % 16 IN (6, 7) THEN {q(SAME)} WHEN seq % 43 = 0 THEN 'تەرجەمەی: ' || line
    WHEN seq % 58 = 0 THEN script || ' ٤٢' WHEN seq % 22 = 0 THEN script || ' ؟' WHEN seq % 5 = 0 THEN script || ' hello ok (see note) **' WHEN seq % 9 = 0 THEN {q(NOUN + " ")} || script
    WHEN seq % 12 = 0 THEN script || 'ê تە   ?' WHEN seq % 8 = 0 THEN script || chr(10) || script || chr(10) || 'دوو' ELSE script END AS target_text,
  CASE WHEN seq % 19 = 0 THEN 'JOHN' END AS speaker FROM timed)"""

SCENES = f"""{CUES},
walk(track_id, seq, end_ms, n, scene_no) AS (SELECT track_id, seq, end_ms, 1, 1 FROM cues WHERE seq = 1
  UNION ALL SELECT c.track_id, c.seq, c.end_ms,
    CASE WHEN w.n >= {K.SCENE_MAX_CUES} OR (w.n >= {K.SCENE_MIN_CUES} AND c.start_ms - w.end_ms >= {K.SCENE_GAP_MS}) THEN 1 ELSE w.n + 1 END,
    CASE WHEN w.n >= {K.SCENE_MAX_CUES} OR (w.n >= {K.SCENE_MIN_CUES} AND c.start_ms - w.end_ms >= {K.SCENE_GAP_MS}) THEN w.scene_no + 1 ELSE w.scene_no END
  FROM walk w JOIN cues c ON c.track_id = w.track_id AND c.seq = w.seq + 1),
seg AS (SELECT c.*, w.scene_no FROM cues c JOIN walk w USING (track_id, seq))"""


def metrics(src: str, keys: str) -> str:
    return rf"""m0 AS (SELECT *, greatest(0, end_ms - start_ms) AS duration_ms,
  list_transform(list_filter(string_split(coalesce(nullif(target_text, ''), source_text), chr(10)), lambda x: {strip("x")} <> ''), lambda x: length({strip("x")})) AS ls FROM {src}),
m1 AS (SELECT *, CAST(coalesce(list_sum(ls), 0) AS BIGINT) AS char_count, CAST(len(ls) AS INTEGER) AS line_count, CAST(coalesce(list_max(ls), 0) AS INTEGER) AS max_cpl,
  lead(start_ms) OVER (PARTITION BY {keys} ORDER BY seq) - end_ms AS gap_ms, lag(target_text) OVER (PARTITION BY {keys} ORDER BY seq) AS prev_target FROM m0),
m AS (SELECT * EXCLUDE (ls), (char_count * 200000 + greatest(100, duration_ms)) // (2 * greatest(100, duration_ms)) AS cps_x100 FROM m1)"""


_BARE = r"regexp_replace(regexp_replace(source_text, '<[^>]+>', '', 'g'), '\{[^}]+\}', '', 'g')"
CLEAN = strip(f"CASE WHEN speaker IS NOT NULL AND starts_with({_BARE}, speaker || ':') THEN substr({_BARE}, length(speaker) + 2) ELSE {_BARE} END")

RUNS = r"regexp_extract_all({x}, '[\x{{0600}}-\x{{06FF}}]+')"


def runs(x: str) -> str:
    return RUNS.format(x=x)


def kurmanji(x: str) -> str:
    return f"list_sort(list_distinct(list_concat(regexp_extract_all({x}, '[{K.KURMANJI_CHARS}]'), list_filter({runs(x)}, lambda w: list_contains({listing(K.KURMANJI_MARKERS)}, w)))))"


def english(x: str) -> str:
    return f"list_filter(regexp_extract_all({x}, '{WORD}'), lambda w: regexp_matches(w, '^[A-Za-z]{{2,}}$') AND NOT list_contains({listing(K.ALLOWED_ENGLISH)}, lower(w)))"


def llm(x: str) -> str:
    triple = f"list_transform(list_filter(range(1, len({toks(x)}) - 1), lambda i: {toks(x)}[i] = {toks(x)}[i + 1] AND {toks(x)}[i] = {toks(x)}[i + 2] AND length({toks(x)}[i]) > 1), lambda i: 'triple_word')"
    return (
        f"list_concat(list_transform(list_filter({runs(x)}, lambda w: contains(w, 'ك') AND contains(w, 'ی')), lambda w: 'mixed_script'), list_transform(list_filter({runs(x)}, lambda w: contains(w, 'ي')), lambda w: 'arabic_yeh'), {triple}, "
        + rf"list_filter([CASE WHEN regexp_matches({x}, '\([^)]*[A-Za-z]{{3,}}[^)]*\)') THEN 'note' END, CASE WHEN contains({x}, '**') OR contains({x}, '__') THEN 'markdown' END, CASE WHEN regexp_matches({x}, '^\p{{Nd}}+[.)]\s') THEN 'numbered_list' END], lambda e: e IS NOT NULL))"
    )


def ezafe(x: str) -> str:
    return f"list_transform(regexp_extract_all(array_to_string(list_transform({runs(x)}, lambda w: CASE WHEN ends_with(w, 'ی') THEN '1' ELSE '0' END), ''), '1{{4,}}'), lambda r: length(r))"


def letters(x: str) -> str:
    return strip(rf"regexp_replace(translate({x}, {q(K.LETTERS_FROM)}, {q(K.LETTERS_TO)}), '[ \t]+', ' ', 'g')")


def punct(x: str) -> str:
    out = rf"CASE WHEN regexp_matches({x}, '[\x{{0600}}-\x{{06FF}}]') THEN translate({x}, '?,;', '؟،؛') ELSE {x} END"
    for a, b in (("؟{2,}", "؟"), ("!{2,}", "!"), ("…", "..."), (r"\.{4,}", "..."), (r"\s+([،؛؟])", r"\1"), (r"([،؛؟])([^\s،؛؟)])", r"\1 \2")):
        out = f"regexp_replace({out}, '{a}', '{b}', 'g')"
    return out


def normal(x: str) -> str:
    return punct(letters(f"coalesce({x}, '')"))


def digits(x: str) -> str:
    return f"translate({x}, '{K.DIGITS_FROM}', '{K.DIGITS_TO}')"


def numbers(x: str) -> str:
    return rf"list_distinct(list_filter(regexp_extract_all({x}, '{WORD}'), lambda w: regexp_matches(w, '^\p{{Nd}}+$')))"


def lacking(a: str, b: str) -> str:
    return f"len(list_filter({a}, lambda n: NOT list_contains({b}, n)))"


TGT = "coalesce(target_text, '')"
_found = f"""f AS (SELECT *, {CLEAN} AS clean, {TGT} AS tgt FROM m),
g AS (SELECT *, {kurmanji("tgt")} AS fk, {english("tgt")} AS fe, {llm("tgt")} AS fl, {ezafe("tgt")} AS fz,
  length(regexp_replace(clean, '[^\\p{{L}}\\p{{N}}_]', '', 'g')) AS sw, length(regexp_replace(tgt, '[^\\p{{L}}]', '', 'g')) AS tl FROM f)"""
_when = {
    "hard_max_cps": f"cps_x100 > {K.HARD_MAX_CPS * 100}", "hard_max_cpl": f"max_cpl > {K.HARD_MAX_CPL}", "max_lines": f"line_count > {K.MAX_LINES}", "min_duration": f"duration_ms < {K.MIN_DURATION_MS}",
    "kurmanji_contamination": "len(fk) > 0", "untranslated_english": "len(fe) > 0", "llm_error_pattern": "len(fl) > 0", "excessive_ezafe_chain": "len(fz) > 0",
    "number_inconsistency": f"{lacking(numbers('clean'), numbers(digits('tgt')))} > 0",
    "negation_reversal": f"len(list_filter(regexp_extract_all(lower(clean), '{WORD}'), lambda w: w IN ('not', 'never', 'no'))) > 0 AND NOT regexp_matches(tgt, '{'|'.join(K.TARGET_NEGATIONS)}')",
    "question_mark_missing": "contains(clean, '?') AND NOT contains(tgt, '؟') AND NOT contains(tgt, '?') AND length(tgt) > 2",
    "mock_fallback_detected": f"starts_with(tgt, '{K.PLACEHOLDER}') OR starts_with(tgt, '{K.PLACEHOLDER[:-1]} :')",
    "length_ratio_too_short": "clean <> '' AND length(tgt) > 2 AND sw > 3 AND tl > 0 AND tl * 10 < sw * 3", "length_ratio_too_long": "clean <> '' AND length(tgt) > 2 AND sw > 3 AND tl > 0 AND tl > sw * 3",
    "duplicate_translation": "coalesce(prev_target = tgt AND length(tgt) > 5, false)",
}
_flags = ", ".join(f"({_when[r]}) AS {r}" for r, *_ in K.RULES)


def _points(category: str) -> str:
    return "greatest(0, 100 - (" + " + ".join(f"CASE WHEN {r} THEN {p} ELSE 0 END" for r, c, _, p in K.RULES if c == category) + "))"


_critical = " + ".join(f"CAST({r} AS INTEGER)" for r, _, s, _ in K.RULES if s == "critical")
QC = f"""{SCENES}, {metrics("seg", "track_id, scene_no")}, {_found},
h AS (SELECT *, {_flags} FROM g),
i AS (SELECT *, {_points("technical")} AS technical, {_points("linguistic")} AS linguistic, {_points("semantic")} AS semantic, {_critical} AS n_critical FROM h),
j AS (SELECT *, (2000 + 40 * semantic + 20 * linguistic + 20 * technical) // 100 AS overall FROM i),
qc AS (SELECT *, overall < {K.REVIEW_BELOW} OR n_critical > 0 AS requires_review, overall >= {K.PASS_FROM} AND n_critical = 0 AS passed FROM j)"""


def on(base: str, tail: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{base} {tail}"


SQL["cue_metrics"] = on(
    f"{CUES}, {metrics('cues', 'track_id')}",
    f"SELECT track_id, seq, duration_ms, char_count, line_count, max_cpl, cps_x100, gap_ms, cps_x100 > {K.HARD_MAX_CPS * 100} AS cps_exceeded, max_cpl > {K.HARD_MAX_CPL} AS cpl_exceeded, line_count > {K.MAX_LINES} AS lines_exceeded, duration_ms < {K.MIN_DURATION_MS} AS too_short, coalesce(gap_ms < {K.MIN_GAP_MS}, false) AS gap_too_short FROM m",
)
SQL["scene_segments"] = on(SCENES, "SELECT track_id, seq, scene_no FROM seg", True)
SQL["scene_bounds"] = on(SCENES, """, b AS (SELECT track_id, scene_no, count(*) AS cues, arg_min(start_ms, seq) AS start_ms, arg_max(end_ms, seq) AS end_ms FROM seg GROUP BY ALL)
SELECT *, format('S{:03d}', scene_no) AS scene_id, format('S{:03d}', lag(scene_no) OVER w) AS previous_id, format('S{:03d}', lead(scene_no) OVER w) AS next_id FROM b WINDOW w AS (PARTITION BY track_id ORDER BY scene_no)""", True)
SQL["scene_texts"] = on(
    SCENES,
    "SELECT track_id, scene_no, sha256(string_agg(source_text, ' ' ORDER BY seq)) AS text_hash, CAST(length(string_agg(source_text, ' ' ORDER BY seq)) AS INTEGER) AS n_chars FROM seg GROUP BY ALL",
    True,
)
SQL["session_gap_events"] = """WITH RECURSIVE e AS (SELECT user_id, CAST(epoch_ns(CAST(ts AS TIMESTAMP_NS)) // 1000000 AS BIGINT) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
walk(user_id, seq, ms, n, session) AS (SELECT user_id, seq, ms, 1, 1 FROM e WHERE seq = 1 UNION ALL
  SELECT e.user_id, e.seq, e.ms, CASE WHEN w.n >= 30 OR (w.n >= 10 AND e.ms - w.ms >= 7200000) THEN 1 ELSE w.n + 1 END, CASE WHEN w.n >= 30 OR (w.n >= 10 AND e.ms - w.ms >= 7200000) THEN w.session + 1 ELSE w.session END
  FROM walk w JOIN e ON e.user_id = w.user_id AND e.seq = w.seq + 1)
SELECT user_id, session, count(*) AS events, min(ms) AS first_ms, max(ms) AS last_ms FROM walk GROUP BY ALL"""
SQL["retime"] = on(
    f"{SCENES}, {metrics('seg', 'track_id, scene_no')}, r AS (SELECT *, char_count * 1000 // {K.PREFERRED_CPS} - duration_ms AS needed FROM m)",
    f"SELECT track_id, seq, end_ms, end_ms + CASE WHEN cps_x100 > {K.HARD_MAX_CPS * 100} AND needed > 0 THEN greatest(0, CASE WHEN gap_ms IS NULL THEN needed ELSE least(needed, greatest(0, gap_ms - {K.MIN_GAP_MS})) END) ELSE 0 END AS new_end_ms FROM r",
    True,
)
SQL["offset_shift"] = on(
    CUES,
    "SELECT track_id, seq, greatest(0, start_ms - 1500) AS start_ms, greatest(greatest(0, start_ms - 1500) + 100, end_ms - 1500) AS end_ms FROM cues",
)
SQL["framerate"] = on(
    CUES,
    "SELECT track_id, seq, CAST(trunc(start_ms * CAST(25.0 / 24.0 AS DOUBLE)) AS BIGINT) AS start_ms, CAST(trunc(end_ms * CAST(25.0 / 24.0 AS DOUBLE)) AS BIGINT) AS end_ms FROM cues",
)
SQL["two_point_sync"] = on(
    CUES,
    ", s AS (SELECT *, greatest(0, CAST(trunc(start_ms * CAST(1.1 AS DOUBLE) + CAST(0 AS DOUBLE)) AS BIGINT)) AS s FROM cues) SELECT track_id, seq, s AS start_ms, s + CAST(trunc((end_ms - start_ms) * CAST(1.1 AS DOUBLE)) AS BIGINT) AS end_ms FROM s",
)
SQL["progress"] = on(
    CUES,
    "SELECT track_id, seq, (row_number() OVER (PARTITION BY track_id ORDER BY seq) * 2000 + count(*) OVER (PARTITION BY track_id)) // (2 * count(*) OVER (PARTITION BY track_id)) AS permille FROM cues",
)
SQL["inspect_stats"] = on(
    f"{CUES}, c AS (SELECT *, {CLEAN} AS clean FROM cues)",
    f"SELECT track_id, count(*) AS cues, arg_max(end_ms, seq) - arg_min(start_ms, seq) AS span_ms, CAST(sum(len({toks('clean')})) AS BIGINT) AS words, CAST(sum(length(clean) * 100000 // greatest(100, end_ms - start_ms)) AS BIGINT) AS cps_x100_sum FROM c GROUP BY track_id",
)

SQL["clean_text"] = on(
    CUES,
    rf", t AS (SELECT *, regexp_extract(source_text, '(?s)^([A-Z0-9\s_]+):\s*(.*)', 1) AS l FROM cues) SELECT track_id, seq, {CLEAN} AS clean, CASE WHEN regexp_matches(source_text, '(?s)^[A-Z0-9\s_]+:') AND length({strip('l')}) <= 30 THEN {strip('l')} END AS label FROM t",
)
SQL["clean_pages"] = rf"SELECT page_id, sha256({strip(r'''regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\{[^}]+\}', '', 'g')''')}) AS clean_hash FROM pages"
SQL["normalize_text"] = on(CUES, f"SELECT track_id, seq, {normal('target_text')} AS normal FROM cues")
SQL["normalize_marks"] = on(
    f"{CUES}, n AS (SELECT track_id, seq, {digits(normal('target_text'))} AS d, trim({normal('target_text')}, '.,!؟? ') AS score_key FROM cues), n1 AS (SELECT *, CASE WHEN d <> '' AND NOT starts_with(d, '{K.RLM}') THEN '{K.RLM}' || d ELSE d END AS e FROM n)",
    f"SELECT track_id, seq, CASE WHEN e <> '' AND NOT ends_with(e, '{K.RLM}') THEN e || '{K.RLM}' ELSE e END AS normal, score_key FROM n1",
)
SQL["line_breaks"] = on(CUES, rf""", t AS (SELECT track_id, seq, {strip("replace(source_text, chr(10), ' ')")} AS t FROM cues), w AS (SELECT *, {toks("t")} AS ws FROM t),
p AS (SELECT track_id, seq, t, ws, unnest(range(1, len(ws))) AS i FROM w WHERE length(t) > {K.PREFERRED_CPL} AND len(ws) > 2),
c AS (SELECT *, abs(list_sum(list_transform(ws[1:i], lambda x: length(x) + 1)) - length(t) // 2) - CASE WHEN regexp_matches(ws[i], '[،؛.]$') THEN 5 ELSE 0 END AS diff FROM p),
best AS (SELECT track_id, seq, arg_min(i, diff * 100000 + i) AS i, min(diff) AS diff FROM c GROUP BY ALL)
SELECT track_id, seq, CASE WHEN b.i IS NOT NULL AND b.diff < 999 THEN array_to_string(ws[1:b.i], ' ') || chr(10) || array_to_string(ws[b.i + 1:], ' ') ELSE t END AS broken FROM w LEFT JOIN best b USING (track_id, seq)""")
SQL["detectors"] = on(
    f"{CUES}, t AS (SELECT *, {TGT} AS x FROM cues)",
    f"SELECT track_id, seq, array_to_string({kurmanji('x')}, ',') AS kurmanji, array_to_string({english('x')}, ',') AS english, array_to_string(list_sort({llm('x')}), ',') AS llm, array_to_string({ezafe('x')}, ',') AS ezafe FROM t",
)
SQL["validate_counts"] = f"WITH n AS (SELECT len({kurmanji('text')}) AS kurmanji, len({english('text')}) AS untranslated, len({ezafe('text')}) AS ezafe, len(list_concat(list_transform(list_filter({runs('text')}, lambda w: contains(w, 'ك') AND contains(w, 'ی')), lambda w: 'a'), list_filter({runs('text')}, lambda w: contains(w, 'ي')))) AS arabic, " + rf"CAST(regexp_matches(text, '\([^)]*[A-Za-z]{{3,}}[^)]*\)') AS INTEGER) + CAST(contains(text, '**') OR contains(text, '__') AS INTEGER) + CAST(regexp_matches(text, '^\p{{Nd}}+[.)]\s') AS INTEGER) AS single, {toks('text')} AS ws FROM (SELECT coalesce(text, '') AS text FROM documents)), k AS (SELECT *, arabic + single + len(list_filter(list_zip(ws, ws[2:], ws[3:]), lambda z: z[1] = z[2] AND z[2] = z[3] AND length(z[1]) > 1)) AS llm_errors FROM n), u AS (UNPIVOT (SELECT CAST(kurmanji AS BIGINT) AS kurmanji, CAST(untranslated AS BIGINT) AS untranslated, CAST(ezafe AS BIGINT) AS ezafe, CAST(llm_errors AS BIGINT) AS llm_errors FROM k) ON kurmanji, untranslated, ezafe, llm_errors INTO NAME category VALUE n) SELECT category, CAST(sum(n) AS BIGINT) AS n_findings, count(*) FILTER (WHERE n > 0) AS n_texts FROM u GROUP BY category"
SQL["suspicious_names"] = on(
    f"{CUES}, c AS (SELECT track_id, seq, {CLEAN} AS clean FROM cues), b AS (SELECT track_id, seq, list_transform({toks('clean')}, lambda w: trim(w, '.,!?\"''()[]')) AS ws FROM c)",
    r"SELECT track_id, seq, array_to_string(list_sort(list_distinct(list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda z: regexp_matches(z[1], '^\p{Lu}') AND upper(z[1]) <> z[1] AND (z[2] > 1 OR length(z[1]) > 4)), lambda z: z[1]))), ',') AS names FROM b",
)
_lang = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in K.LANGUAGES.items())
SQL["foreign_routing"] = on(
    rf"{CUES}, c AS (SELECT track_id, seq, {CLEAN} AS clean FROM cues), o AS (SELECT *, regexp_matches(clean, '(?i)^\[(speaking|in|speaks)\s+([a-z\s]+)\]$') AS b, {strip(r'''regexp_extract(clean, '(?i)^\[(speaking|in|speaks)\s+([a-z\s]+)\]$', 2)''')} AS l FROM c)",
    f"SELECT track_id, seq, CASE WHEN b THEN 'B' ELSE 'A' END AS case_type, b AS opaque, CASE WHEN b THEN '[' || CASE lower(l) {_lang} ELSE l END || ' {K.SPEAKS}]' END AS indicator, CASE WHEN b THEN 'preserve_opaque' ELSE 'translate' END AS action FROM o",
)


def honorifics(start: str, terms, tail: str, recursive: bool = False) -> str:
    """A step for each term over h0 (t: translation, s: source in lower case)."""
    return on(
        start + "".join(
            rf", h{i + 1} AS (SELECT * REPLACE (CASE WHEN t <> '' AND regexp_matches(s, '(\b|^){key.replace('.', chr(92) + '.')}(\b|$|\s)') AND NOT contains(t, {q(name)}) THEN {q(name + ' ')} || t ELSE t END AS t) FROM h{i})" for i, (key, name) in enumerate(terms)
        ),
        f"{tail} FROM h{len(terms)}",
        recursive,
    )


SQL["glossary_enforce"] = honorifics(
    f"{CUES}, h0 AS (SELECT track_id, seq, target_text AS t, lower(CASE WHEN seq % 6 = 0 THEN 'Captain and Dr. ' || source_text WHEN seq % 6 = 1 THEN 'Mrs. ' || source_text ELSE source_text END) AS s FROM cues)",
    K.HONORIFICS,
    "SELECT track_id, seq, t AS enforced",
)


def dictionary(x: str) -> str:
    low = f"trim(lower({x}), '.,!?\"''')"
    return "CASE " + " ".join(f"WHEN contains({low}, {q(k)}) THEN {q(v)}" for k, v in K.PHRASES) + f" ELSE {q(K.PLACEHOLDER + ' ')} || {x} END"


SQL["dictionary_translation"] = on(LINES, f"SELECT track_id, seq, {dictionary('line')} AS translation FROM lines")
SQL["content_keys"] = "SELECT doc_id, sha256(coalesce(text, '')) AS content_key FROM documents"
SQL["cue_search"] = on(
    CUES,
    f"SELECT track_id, seq FROM cues WHERE contains(source_text, 'the') OR contains({TGT}, 'باش') OR contains(CAST(seq AS VARCHAR), '7')",
)
SQL["number_consistency"] = f"SELECT doc_id, CAST({lacking(numbers('text'), numbers(digits('''translate(text, '13579', '٠٢٤٦٨')''')))} AS INTEGER) AS missing FROM documents"
SQL["duplicate_prev"] = on(
    CUES,
    "SELECT track_id, seq FROM (SELECT *, lag(target_text) OVER (PARTITION BY track_id ORDER BY seq) AS prev FROM cues) WHERE prev = target_text AND length(target_text) > 5",
)

_ratio = "'ratio ' || (tl * 100 // greatest(1, sw)) || ' %'"
_says = {
    "hard_max_cps": f"'reading speed ' || printf('%d.%02d', cps_x100 // 100, cps_x100 % 100) || ' above {K.HARD_MAX_CPS} characters a second'", "hard_max_cpl": f"'line of ' || max_cpl || ' characters above {K.HARD_MAX_CPL}'", "max_lines": f"line_count || ' lines, {K.MAX_LINES} allowed'",
    "min_duration": f"'shown for ' || duration_ms || ' ms, less than {K.MIN_DURATION_MS}'", "kurmanji_contamination": "'Kurmanji: ' || array_to_string(fk, ', ')", "untranslated_english": "'English left: ' || array_to_string(fe, ', ')",
    "llm_error_pattern": "'error patterns: ' || array_to_string(fl[1:3], ', ')", "excessive_ezafe_chain": "'chains of words in yeh: ' || array_to_string(fz[1:2], ', ')",
    "number_inconsistency": f"'numbers lost: ' || array_to_string(list_filter({numbers('clean')}, lambda n: NOT list_contains({numbers(digits('tgt'))}, n)), ', ')", "negation_reversal": "'the source denies, the translation may not'", "question_mark_missing": "'question mark lost'",
    "mock_fallback_detected": "'a placeholder, no translation'", "length_ratio_too_short": f"'very short, ' || {_ratio}", "length_ratio_too_long": f"'very long, ' || {_ratio}", "duplicate_translation": "'the same as the cue before'",
}
_each = " UNION ALL ".join(
    f"SELECT track_id, seq, '{r}' AS rule, '{c}' AS category, '{s}' AS severity, {p} AS points, {_says[r]} AS message, 'open' AS status FROM qc WHERE {r}" for r, c, s, p in K.RULES
)
SQL["qc_issues"] = on(QC, _each, True)
SQL["qc_eval"] = on(
    QC,
    "SELECT track_id, seq, scene_no, technical, linguistic, semantic, CAST(overall AS INTEGER) AS overall, passed, requires_review FROM qc",
    True,
)
SQL["qc_summary"] = on(
    QC,
    "SELECT track_id, scene_no, count(*) AS cues, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE requires_review) AS for_review, CAST(sum(n_critical) AS BIGINT) AS critical_issues, CAST(sum(overall) AS BIGINT) AS points FROM qc GROUP BY ALL",
    True,
)
SQL["run_summary"] = on(
    QC,
    "SELECT count(*) AS cues, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE passed) * 1000 // count(*) AS pass_permille, CAST(sum(n_critical) AS BIGINT) AS critical_issues, count(*) FILTER (WHERE requires_review) AS queue FROM qc",
    True,
)
SQL["proper_nouns"] = on(
    QC,
    f"SELECT track_id, seq, 'proper_noun_missing' AS rule, 'semantic' AS category, 'major' AS severity, 15 AS points, 'the name ' || name || ' is lost' AS message FROM qc, (VALUES ('John'), ('Spanish')) n(name) WHERE contains(lower(clean), lower(name)) AND length({strip('tgt')}) < 3",
    True,
)
SQL["verification"] = on(
    QC,
    "SELECT track_id, seq, CASE WHEN requires_review AND seq % 3 = 0 THEN 'disagree' ELSE 'agree' END AS decision, CASE WHEN requires_review AND seq % 4 = 0 THEN 'major' ELSE 'none' END AS severity, requires_review AND (seq % 3 = 0 OR seq % 4 = 0) AS escalated FROM qc",
    True,
)
SQL["review_queue"] = on(QC, "SELECT track_id, seq, CAST(overall AS INTEGER) AS overall FROM qc WHERE requires_review AND n_critical > 0", True)
SQL["decisions"] = on(
    CUES,
    f"SELECT track_id, seq, CASE WHEN seq % 4 = 0 THEN target_text WHEN seq % 4 = 1 THEN {TGT} WHEN seq % 8 = 2 THEN 'alt' ELSE 'ok ' || seq END AS final_text, CASE seq % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'accepted' ELSE 'edited' END AS status FROM cues",
)

_rules = ", ".join(f"({q(a)}, {q(b)}, {q(c)})" for a, b, c in K.COMPLIANCE)
SQL["compliance_terms"] = f"SELECT doc_id, term, replacement, severity FROM documents, (VALUES {_rules}) t(term, replacement, severity) WHERE contains(regexp_replace(text, '[Tt]he ', 'سگ ', 'g'), term)"
SQL["glossary_match"] = "SELECT doc_id, term FROM documents, (VALUES ('Licensed', true), ('licensed', true), ('THE and', false), ('idiot', false)) t(term, exact) WHERE CASE WHEN exact THEN contains(text, term) ELSE contains(lower(text), lower(term)) END"
_terms = [
    ("mr.", "بەڕێز"),
    ("mrs.", "خاتوونی"),
    ("ms.", "خاتوو"),
    ("professor", "پڕۆفیسۆر"),
    ("captain", "سەرکردە"),
    ("detective", "پشکنەر"),
    ("sheriff", "شێریف"),
]
SQL["glossary_custom"] = honorifics(
    f"{CUES}, h0 AS (SELECT track_id, seq, target_text AS t, lower(CASE WHEN seq % 4 = 0 THEN 'Captain and Dr. ' || source_text WHEN seq % 4 = 1 THEN 'The sheriff ' || source_text ELSE source_text END) AS s FROM cues)",
    _terms,
    "SELECT track_id, seq, t AS enforced",
)
SQL["cue_records"] = on(
    f"{CUES}, c AS (SELECT track_id, seq, {CLEAN} AS clean FROM cues), b AS (SELECT track_id, seq, clean, list_transform({toks('clean')}, lambda w: trim(w, '.,!?\"''()[]')) AS ws FROM c), n AS (SELECT *, " + r"len(list_distinct(list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda z: regexp_matches(z[1], '^\p{Lu}') AND upper(z[1]) <> z[1] AND (z[2] > 1 OR length(z[1]) > 4)), lambda z: z[1]))) AS names FROM b)",
    r"SELECT track_id, seq, names > 0 AS suspicious_names, regexp_matches(clean, '(?i)\[(speaking|in)\s+[a-z]+\]') AS foreign_speech, CASE WHEN names > 0 THEN 'possible names: ' || names END AS note FROM n",
)
SQL["active_characters"] = on(
    SCENES,
    ", s AS (SELECT track_id, scene_no, lower(string_agg(source_text, ' ' ORDER BY seq)) AS t FROM seg GROUP BY ALL) SELECT DISTINCT track_id, scene_no, id FROM s, (VALUES ('c1', 'thandor'), ('c1', 'than'), ('c1', 'ander'), ('c2', 'idiot'), ('c2', 'scum'), ('c2', 'clown'), ('c3', 'erin')) n(id, name) WHERE contains(t, name)",
    True,
)

_pairs = "pairs AS (SELECT a.item_id, a.text AS r, b.text AS h FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)"


def chrf(src: str, keys: str, words: int = 0) -> str:
    """CTEs from a table (keys, r, h) to one (keys, chrf_e4)."""
    word_part = f" UNION ALL SELECT {keys}, side, 'w', n, array_to_string(ws[i:i + n - 1], ' ') FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM (SELECT {keys}, side, {toks('t')} AS ws, unnest(range(1, {words} + 1)) AS n FROM sides))" if words else ""
    return rf"""sides AS (SELECT {keys}, 'r' AS side, r AS t FROM {src} UNION ALL SELECT {keys}, 'h', h FROM {src}),
wd AS (SELECT {keys}, side, ' ' || unnest({toks("t")}) || ' ' AS w FROM sides),
wn AS (SELECT *, unnest(range(1, 7)) AS n FROM wd),
gr AS (SELECT {keys}, side, 'c' AS kind, n, substr(w, CAST(i AS BIGINT), n) AS gram FROM (SELECT *, unnest(range(1, length(w) - n + 2)) AS i FROM wn){word_part}),
ct AS (SELECT {keys}, kind, n, gram, count(*) FILTER (WHERE side = 'h') AS ch, count(*) FILTER (WHERE side = 'r') AS cr FROM gr GROUP BY ALL),
sm AS (SELECT {keys}, kind, n, sum(ch) AS th, sum(cr) AS tr, sum(least(ch, cr)) AS m FROM ct GROUP BY ALL HAVING sum(ch) > 0 AND sum(cr) > 0),
av AS (SELECT {keys}, avg(m / th) AS p, avg(m / tr) AS s FROM sm GROUP BY ALL),
chrf AS (SELECT {keys}, CASE WHEN {strip("r")} = '' OR {strip("h")} = '' THEN CASE WHEN {strip("r")} = {strip("h")} THEN 10000 ELSE 0 END ELSE CAST(floor(coalesce(CASE WHEN p + s > 0 THEN 5 * p * s / (4 * p + s) ELSE 0 END, 0) * 10000 + 1e-6) AS BIGINT) END AS chrf_e4 FROM {src} LEFT JOIN av USING ({keys}))"""


SQL["chrf_pairs"] = on(f"{_pairs}, {chrf('pairs', 'item_id')}", "SELECT item_id, chrf_e4 FROM chrf")
SQL["chrf_words"] = on(f"{_pairs}, {chrf('pairs', 'item_id', 2)}", "SELECT item_id, chrf_e4 FROM chrf")
_gold = f"""gold AS (SELECT item_id AS id, 'cat' || item_id % 3 AS category, text AS gold, lower(text) AS alt,
  CASE item_id % 5 WHEN 0 THEN text || ' !' WHEN 1 THEN lower(text) WHEN 2 THEN 'wrong ' || text WHEN 3 THEN 'ok' ELSE substr(text, 1, 40) END AS translation FROM benchmark),
keyed AS (SELECT *, trim({normal("translation")}, '.,!؟? ') AS got, trim({normal("gold")}, '.,!؟? ') AS key, trim({normal("alt")}, '.,!؟? ') AS altkey FROM gold),
verdict AS (SELECT id, category, contains(got, 'wrong') AS literal, got = key AS exact, got = altkey AS acceptable, CASE WHEN contains(got, 'wrong') THEN 0 WHEN got = key THEN 100 WHEN got = altkey THEN 90 WHEN length(got) > 2 THEN 50 ELSE 0 END AS score_x100, got, key, altkey FROM keyed)"""
SQL["gold_scoring"] = on(_gold, "SELECT id, category, literal, exact, acceptable, score_x100 FROM verdict")
SQL["category_rollup"] = on(
    f"{_gold}, refs AS (SELECT id, 0 AS k, key AS r, got AS h FROM verdict UNION ALL SELECT id, 1, altkey, got FROM verdict), {chrf('refs', 'id, k')}, top AS (SELECT id, max(chrf_e4) AS chrf_e4 FROM chrf GROUP BY id)",
    "SELECT category, count(*) AS items, count(*) FILTER (WHERE score_x100 >= 90) AS passed, count(*) FILTER (WHERE literal) AS literal_errors, CAST(sum(score_x100) AS BIGINT) AS score_sum, CAST(sum(chrf_e4) AS BIGINT) AS chrf_sum FROM verdict JOIN top USING (id) GROUP BY ROLLUP (category)",
)
SQL["ensemble_consensus"] = on(
    f"{LINES}, p AS (SELECT track_id, seq, {dictionary('line')} AS a, CASE WHEN seq % 3 = 0 THEN '' ELSE {dictionary('lower(line)')} END AS b FROM lines), n AS (SELECT track_id, seq, b AS s, {normal('a')} AS a, {normal('b')} AS b FROM p)",
    "SELECT track_id, seq, CAST(length(s) AS INTEGER) AS second_length, CASE WHEN a = b THEN 100 WHEN a <> '' AND b <> '' THEN 75 ELSE 0 END AS score FROM n",
)
SQL["edit_distance"] = on(
    _pairs,
    "SELECT item_id, levenshtein(regexp_replace(r, '[^ -~]', '', 'g'), regexp_replace(h, '[^ -~]', '', 'g')) AS distance, length(regexp_replace(r, '[^ -~]', '', 'g')) AS n FROM pairs",
)

_memory = "mem AS (SELECT text AS source_text, min(conv_id * 1000 + turn) AS tm_id FROM conversations WHERE text IS NOT NULL GROUP BY text)"
SQL["tm_exact"] = on(
    f"{_memory}, k AS (SELECT lower({strip('source_text')}) AS k, min(tm_id) AS tm_id FROM mem GROUP BY 1)",
    f"SELECT conv_id, turn, tm_id FROM conversations JOIN k ON k.k = lower({strip('text')})",
)
SQL["tm_upsert"] = "WITH o AS (SELECT doc_id AS tm_id, sha256(text) AS source_text, source AS target_text, CAST(1 AS BIGINT) AS version FROM documents WHERE text IS NOT NULL), a AS (SELECT * FROM o UNION ALL SELECT tm_id + 1000000, source_text, upper(target_text), 2 FROM o WHERE (tm_id + 1000000) % 2 = 0) SELECT tm_id, source_text, target_text, version FROM a QUALIFY row_number() OVER (PARTITION BY source_text ORDER BY version DESC, tm_id DESC) = 1"
SQL["translate_missing"] = on(
    CUES,
    f"SELECT track_id, seq, CASE WHEN {TGT} = '' THEN 'provider' ELSE 'given' END AS origin, CASE WHEN {TGT} = '' THEN {dictionary('source_text')} ELSE target_text END AS target_text FROM cues",
)
SQL["tm_hit_rate"] = on(
    f"{LINES}, {_memory}, k AS (SELECT DISTINCT lower({strip('source_text')}) AS k FROM mem)",
    f"SELECT count(*) AS cues, count(k.k) AS hits FROM lines LEFT JOIN k ON k.k = lower({strip('line')})",
)

_corr = "corr AS (SELECT doc_id AS id, 'src ' || lang AS source_text, source AS original_translation, CASE WHEN doc_id % 3 = 0 THEN source ELSE upper(source) END AS corrected_translation, CASE WHEN doc_id % 2 = 0 THEN 'edit' ELSE 'accept' END AS correction_type, 'p' || doc_id % 4 AS project_id, doc_id % 977 AS ts FROM documents)"
SQL["recorded_corrections"] = on(_corr, "SELECT id, source_text, corrected_translation FROM corr WHERE id % 5 <> 0 AND id % 6 <> 0 AND source_text <> '' AND corrected_translation <> ''")
SQL["frequent_corrections"] = on(
    _corr,
    "SELECT source_text, corrected_translation, count(*) AS frequency FROM corr WHERE correction_type = 'edit' GROUP BY ALL HAVING count(*) >= 3",
)
SQL["recent_corrections"] = on(_corr, "SELECT id, source_text FROM corr WHERE project_id = 'p1' ORDER BY ts DESC, id DESC LIMIT 50")
SQL["training_export"] = on(
    f"{_corr}, l AS (SELECT * FROM corr ORDER BY ts DESC, id DESC LIMIT 10000)",
    """SELECT id, '{"source":"' || source_text || '","original":"' || original_translation || '","corrected":"' || corrected_translation || '","project_id":"' || project_id || '"}' AS line FROM l WHERE correction_type = 'edit' AND corrected_translation <> original_translation""",
)
_prices = {m: (i, o) for m, i, o in K.PRICES}
_in, _out = _prices["gemini-2.5-flash"]
_cost = f"""cost AS (SELECT track_id, scene_no, (2000 + sum(length(source_text)) + 50 * count(*)) // 4 AS input_tokens, (sum(length(source_text)) * 12 + 1000) // 20 AS output_tokens FROM seg GROUP BY ALL),
priced AS (SELECT track_id, scene_no, CAST(input_tokens AS BIGINT) AS input_tokens, CAST(output_tokens AS BIGINT) AS output_tokens, CAST(round((CAST(input_tokens AS DOUBLE) * CAST({_in} AS DOUBLE) + CAST(output_tokens AS DOUBLE) * CAST({_out} AS DOUBLE)) * 1000) AS BIGINT) AS usd_e6 FROM cost)"""
SQL["cost_scene"] = on(f"{SCENES}, {_cost}", "SELECT * FROM priced", True)
_fin, _fout = _prices["gpt-4o"]
SQL["cost_file"] = on(
    f"{CUES}, f AS (SELECT track_id, count(*) AS cues, CAST(sum(length(source_text)) // count(*) AS BIGINT) AS avg_len FROM cues GROUP BY ALL), g AS (SELECT *, greatest(1, cues // 20) AS scenes FROM f), h AS (SELECT *, (2000 + 20 * (avg_len + 50)) * scenes * 5 // 8 AS input_tokens, avg_len * 24 * scenes AS output_tokens FROM g)",
    f"SELECT track_id, cues, avg_len, scenes, input_tokens, output_tokens, CAST(round((CAST(input_tokens AS DOUBLE) * CAST({_fin} AS DOUBLE) + CAST(output_tokens AS DOUBLE) * CAST({_fout} AS DOUBLE)) * 10) AS BIGINT) AS usd_e4 FROM h",
)
SQL["budget_running"] = on(
    f"{SCENES}, {_cost}, s AS (SELECT track_id AS project_id, scene_no AS call_id, usd_e6, CAST(sum(usd_e6) OVER (PARTITION BY track_id ORDER BY scene_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent_e6 FROM priced)",
    "SELECT *, greatest(0, 1000 - spent_e6) AS remaining_e6, spent_e6 <= 1000 AS fits FROM s",
    True,
)
SQL["resume_scenes"] = on(SCENES, "SELECT track_id, seq, CASE WHEN scene_no = 1 THEN 'done' ELSE 'todo' END AS state FROM seg", True)
SQL["resumed_scenes"] = on(
    SCENES,
    "SELECT track_id, scene_no, CAST(CASE WHEN bool_or(seq % 31 = 0) THEN 2 ELSE 1 END AS INTEGER) AS run, count(*) AS cues FROM seg WHERE CAST(track_id AS BIGINT) % 5 <> 0 GROUP BY ALL",
    True,
)
SQL["nested_tracks"] = on(
    CUES,
    "SELECT 's' || CAST(track_id AS BIGINT) % 7 || '/film' || CAST(track_id AS BIGINT) // 7 || '.srt' AS track_id, seq, start_ms, end_ms, source_text FROM cues",
)
SQL["term_search"] = on(
    LINES,
    f", l AS (SELECT track_id, seq, lower(line) AS line FROM lines), t AS (SELECT DISTINCT unnest({toks('line')}) AS term FROM l) SELECT term, count(*) AS lines FROM t JOIN l ON contains(l.line, t.term) WHERE length(term) >= 8 GROUP BY term",
)
SQL["one_long_track"] = on(
    f"""{CUES},
o AS (SELECT CAST(track_id AS BIGINT) * 100000 + seq AS seq, start_ms + CAST(track_id AS BIGINT) * 3600000 AS start_ms, end_ms + CAST(track_id AS BIGINT) * 3600000 AS end_ms FROM cues),
r AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY seq) AS r FROM o),
walk(r, end_ms, n, scene_no) AS (SELECT r, end_ms, 1, 1 FROM r WHERE r = 1
  UNION ALL SELECT c.r, c.end_ms,
    CASE WHEN w.n >= {K.SCENE_MAX_CUES} OR (w.n >= {K.SCENE_MIN_CUES} AND c.start_ms - w.end_ms >= {K.SCENE_GAP_MS}) THEN 1 ELSE w.n + 1 END,
    CASE WHEN w.n >= {K.SCENE_MAX_CUES} OR (w.n >= {K.SCENE_MIN_CUES} AND c.start_ms - w.end_ms >= {K.SCENE_GAP_MS}) THEN w.scene_no + 1 ELSE w.scene_no END
  FROM walk w JOIN r c ON c.r = w.r + 1)""",
    "SELECT seq, start_ms, CAST(scene_no AS INTEGER) AS scene_no FROM r JOIN walk USING (r)",
    True,
)
SQL["localized_opinions"] = on(
    f"{CUES}, c AS (SELECT track_id, seq, {CLEAN} AS clean FROM cues)",
    r"SELECT track_id, seq, clean AS meaning, CASE WHEN regexp_matches(clean, '(?i)^\[(speaking|in|speaks)\s+([a-z\s]+)\]$') THEN 'routed' ELSE 'provider' END AS origin, 'agree' AS decision, CAST(NULL AS VARCHAR) AS alternative, false AS escalated FROM c",
)
SQL["overlay_edits"] = on(CUES, "SELECT track_id, seq, CASE WHEN seq % 3 = 0 THEN 'edit 2' ELSE target_text END AS target_text FROM cues")
SQL["zip_files"] = on(CUES, "SELECT track_id, seq, source_text, target_text AS other_target_text FROM cues WHERE seq % 5 <> 0")
SQL["first_interpretation"] = on(
    CUES,
    "SELECT track_id, seq, CASE WHEN seq <= 2 THEN 'm1' WHEN seq % 2 = 1 THEN 'm' || (seq - 2) ELSE 'm' || (seq - 1) END AS meaning FROM cues",
)


def stamp(ms: str, sep: str) -> str:
    return f"printf('%02d:%02d:%02d{sep}%03d', {ms} // 3600000, {ms} % 3600000 // 60000, {ms} % 60000 // 1000, {ms} % 1000)"


def ass_stamp(ms: str) -> str:
    return f"printf('%d:%02d:%02d.%02d', {ms} // 3600000, {ms} % 3600000 // 60000, {ms} % 60000 // 1000, {ms} % 1000 // 10)"


_shown = "coalesce(target_text, source_text)"
_file = "SELECT track_id, sha256(c) AS content_hash, CAST(length(c) AS INTEGER) AS n_chars FROM f"
SQL["export_srt"] = on(
    f"{CUES}, f AS (SELECT track_id, string_agg(seq || chr(10) || {stamp('start_ms', ',')} || ' --> ' || {stamp('end_ms', ',')} || chr(10) || {_shown}, chr(10) || chr(10) ORDER BY seq) || chr(10) AS c FROM cues GROUP BY track_id)",
    _file,
)
SQL["export_vtt"] = on(
    f"{CUES}, f AS (SELECT track_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(seq || chr(10) || {stamp('start_ms', '.')} || ' --> ' || {stamp('end_ms', '.')} || chr(10) || {_shown} || chr(10), chr(10) ORDER BY seq) AS c FROM cues GROUP BY track_id)",
    _file,
)
SQL["export_ass"] = on(
    rf"{CUES}, f AS (SELECT track_id, {q(K.ASS_HEADER.format(title='Subtitles'))} || string_agg('Dialogue: 0,' || {ass_stamp('start_ms')} || ',' || {ass_stamp('end_ms')} || ',Default,,0,0,0,,' || replace({_shown}, chr(10), '\N'), chr(10) ORDER BY seq) || chr(10) AS c FROM cues GROUP BY track_id)",
    _file,
)


def esc(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


_fired = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {r} THEN {_says[r]} END" for r, *_ in K.RULES) + "], lambda e: e IS NOT NULL), ', ')"
_row = f"""'<tr><td>' || seq || '</td><td>' || {stamp('start_ms', ',')} || ' --&gt; ' || {stamp('end_ms', ',')} || '</td><td>' || {esc('clean')} || '</td><td dir="rtl">' || {esc(TGT)} || '</td><td style="color: ' || CASE WHEN seq % 5 <> 0 AND passed THEN '#28a745' ELSE '#dc3545' END || '">' || CASE WHEN seq % 5 = 0 THEN 'N/A' ELSE printf('%d.%02d', overall // 100, overall % 100) END || '</td><td>' || CASE WHEN seq % 5 = 0 THEN '' ELSE {esc(_fired)} END || '</td></tr>'"""
_end = "\n</tbody>\n</table>\n</body>\n</html>\n"
SQL["export_html"] = on(
    f"{QC}, page AS (SELECT track_id, {q(PAGE.format(title='Bilingual inspection'))} || string_agg({_row}, chr(10) ORDER BY seq) || {q(_end)} AS c FROM qc GROUP BY track_id)",
    _file.replace("FROM f", "FROM page"),
    True,
)
_lost = " + ".join(f"CASE WHEN {r} THEN {p} ELSE 0 END" for r, _, _, p in K.RULES)
_open = " + ".join(f"CAST({r} AS INTEGER)" for r, *_ in K.RULES)
SQL["qc_report"] = on(
    QC,
    f"SELECT track_id, count(*) AS total_cues, count(*) FILTER (WHERE passed) AS passed_cues, count(*) FILTER (WHERE requires_review) AS review_required_cues, CAST((sum(overall) * 20 + count(*)) // (2 * count(*)) AS BIGINT) AS average_permille, count(*) AS evaluations, CAST(sum(overall) AS BIGINT) AS points, CAST(sum({_lost}) AS BIGINT) AS lost, string_agg(seq, ',' ORDER BY seq) AS seqs, CAST(sum({_open}) AS BIGINT) AS open_issues FROM qc GROUP BY track_id",
    True,
)
SQL["srt_roundtrip"] = on(
    CUES,
    "SELECT track_id, seq, start_ms, end_ms, source_text, CASE WHEN seq % 19 = 0 AND starts_with(source_text, 'JOHN: ') THEN 'JOHN' END AS speaker FROM cues",
)
SQL["vtt_roundtrip"] = on(CUES, "SELECT track_id, seq, start_ms, end_ms, source_text, CAST(NULL AS VARCHAR) AS speaker FROM cues")
SQL["ass_roundtrip"] = on(
    CUES,
    rf"SELECT track_id, seq, start_ms // 10 * 10 AS start_ms, end_ms // 10 * 10 AS end_ms, {strip(r'''regexp_replace(source_text, '\{[^}]*\}', '', 'g')''')} AS source_text, CAST(NULL AS VARCHAR) AS speaker FROM cues",
)
SQL["decoded_files"] = r"SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN text ELSE regexp_replace(text, '[^\x{00}-\x{FF}]', '?', 'g') END) AS text_hash FROM documents"
_guarded = "SELECT doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN ' ' || chr(10) || chr(9) WHEN doc_id % 11 = 0 THEN '' ELSE text END AS content FROM documents"
SQL["file_guards"] = rf"""WITH f AS ({_guarded}), g AS (SELECT path, CASE WHEN path % 13 <> 0 AND strlen(content) = 0 THEN 'empty' WHEN path % 13 = 0 THEN 'too large' WHEN content IS NULL OR NOT regexp_matches(content, '\S') THEN 'blank' END AS reason FROM f)
SELECT path, reason FROM g WHERE reason IS NOT NULL"""
SQL["track_ranking"] = r"""WITH p AS (SELECT *, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS media FROM pages),
l AS (SELECT media, url || CASE page_id % 3 WHEN 0 THEN '.en.srt' WHEN 1 THEN '.forced.ass' ELSE '.txt' END AS path FROM p WHERE length(media) % 3 <> 0),
n AS (SELECT *, lower(regexp_extract(path, '([^/]*)$', 1)) AS low, lower(regexp_replace(regexp_extract(media, '([^/]*)$', 1), '\.[^.]*$', '')) AS base FROM l),
c AS (SELECT media, path, CASE WHEN contains(low, 'en') THEN 'en' ELSE 'unknown' END AS language, regexp_extract(low, '\.(srt|ass|vtt)$', 1) AS format, CASE WHEN contains(low, 'forced') THEN 'forced' WHEN contains(low, 'sdh') OR contains(low, 'cc') THEN 'sdh' ELSE 'full' END AS track_type, 90 + CASE WHEN starts_with(low, base) THEN 5 ELSE 0 END + CASE WHEN contains(low, 'en') THEN 5 ELSE 0 END AS score FROM n),
e AS (SELECT media, max(page_id) % 4 AS k FROM p WHERE length(media) % 3 = 1 GROUP BY media),
a AS (SELECT * FROM c WHERE format <> '' UNION ALL SELECT media, media || '#1', 'en', 'subrip', 'sdh', 95 FROM e WHERE k = 0 UNION ALL SELECT media, media || '#0', 'unknown', 'srt', 'full', 50 FROM e WHERE k = 1),
best AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY media ORDER BY score DESC, path) = 1)
SELECT * FROM best UNION ALL SELECT DISTINCT media, media, 'en', 'asr', 'full', 70 FROM p WHERE media NOT IN (SELECT media FROM best)"""
SQL["response_content"] = "SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN '' ELSE source END AS content FROM documents"


def by_remainder(texts: list[str]) -> str:
    plain = [t.replace("{{", "{").replace("}}", "}").split("{0}") for t in texts]
    return f"CASE doc_id % {len(texts)} " + " ".join(f"WHEN {k} THEN {' || doc_id || '.join(q(x) for x in t)}" for k, t in enumerate(plain)) + " END"


SQL["cue_id_coercion"] = f"SELECT doc_id, {by_remainder([b for _, b in ITEMS])} AS ids FROM documents"
SQL["lenient_json"] = f"SELECT doc_id, {by_remainder([b for _, b in ANSWERS])} AS parsed FROM documents"

# The whole way: routed or translated, honorifics, retimed, wrapped, evaluated.
_routed = rf"""{SCENES},
r0 AS (SELECT track_id, scene_no, seq, start_ms, end_ms, source_text, speaker, {CLEAN} AS clean FROM seg),
r1 AS (SELECT *, regexp_matches(clean, '(?i)^\[(speaking|in|speaks)\s+([a-z\s]+)\]$') AS routed, {strip(r'''regexp_extract(clean, '(?i)^\[(speaking|in|speaks)\s+([a-z\s]+)\]$', 2)''')} AS l FROM r0),
h0 AS (SELECT * EXCLUDE (l, clean), lower(clean) AS s, CASE WHEN routed THEN '[' || CASE lower(l) {_lang} ELSE l END || ' {K.SPEAKS}]' ELSE {dictionary('clean')} END AS t FROM r1)"""
_steps = honorifics(_routed, K.HONORIFICS, "SELECT *", True).removeprefix("WITH RECURSIVE ").removesuffix(f" SELECT * FROM h{len(K.HONORIFICS)}")
_before = re.sub(r"\bm AS\b", "nm AS", re.sub(r"\bm([01])\b", r"n\1", metrics("plain", "track_id, scene_no")))
_localized = rf"""{_steps},
plain AS (SELECT * EXCLUDE (s, t), t AS target_text FROM h{len(K.HONORIFICS)}), {_before},
rt AS (SELECT *, char_count * 1000 // {K.PREFERRED_CPS} - duration_ms AS needed FROM nm),
rn AS (SELECT *, end_ms + CASE WHEN cps_x100 > {K.HARD_MAX_CPS * 100} AND needed > 0 THEN greatest(0, CASE WHEN gap_ms IS NULL THEN needed ELSE least(needed, greatest(0, gap_ms - {K.MIN_GAP_MS})) END) ELSE 0 END AS new_end, {strip("replace(target_text, chr(10), ' ')")} AS flat FROM rt),
lw AS (SELECT *, {toks("flat")} AS ws FROM rn),
lp AS (SELECT track_id, seq, flat, ws, unnest(range(1, len(ws))) AS i FROM lw WHERE length(flat) > {K.PREFERRED_CPL} AND len(ws) > 2),
lc AS (SELECT *, abs(list_sum(list_transform(ws[1:i], lambda x: length(x) + 1)) - length(flat) // 2) - CASE WHEN regexp_matches(ws[i], '[،؛.]$') THEN 5 ELSE 0 END AS diff FROM lp),
lb AS (SELECT track_id, seq, arg_min(i, diff * 100000 + i) AS i, min(diff) AS diff FROM lc GROUP BY ALL),
ready AS (SELECT track_id, scene_no, seq, start_ms, new_end AS end_ms, source_text, speaker, routed, CASE WHEN target_text = '' THEN target_text WHEN lb.i IS NOT NULL AND lb.diff < 999 THEN array_to_string(ws[1:lb.i], ' ') || chr(10) || array_to_string(ws[lb.i + 1:], ' ') ELSE flat END AS target_text FROM lw LEFT JOIN lb USING (track_id, seq)),
{metrics("ready", "track_id, scene_no")}, {QC[QC.index("f AS (SELECT *, "):]}"""
SQL["localized_scenes"] = on(
    _localized,
    "SELECT track_id, scene_no, count(*) AS cues, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE requires_review) AS for_review, CAST(sum(n_critical) AS BIGINT) AS critical_issues, CAST(sum(overall) AS BIGINT) AS points, CAST(sum(end_ms) AS BIGINT) AS ends, CAST(sum(length(target_text)) AS BIGINT) AS chars, count(*) FILTER (WHERE routed) AS routed FROM qc GROUP BY ALL",
    True,
)
SQL["localized_summary"] = on(
    _localized,
    "SELECT count(*) AS cues, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE passed) * 1000 // count(*) AS pass_permille, CAST(sum(n_critical) AS BIGINT) AS critical_issues, CAST(0 AS BIGINT) AS failed_scenes, count(*) FILTER (WHERE requires_review) AS queue, count(*) FILTER (WHERE NOT routed) AS lookups, CAST(0 AS BIGINT) AS hits FROM qc",
    True,
)
_run = f"""gold AS (SELECT item_id AS id, 'cat' || item_id % 4 AS category, CASE WHEN item_id % 3 = 0 THEN {dictionary('text')} ELSE 'سڵاو هاوڕێم' END AS gold, {dictionary('lower(text)')} AS alt, {dictionary('text')} AS translation FROM benchmark),
keyed AS (SELECT *, trim({normal("translation")}, '.,!؟? ') AS got, trim({normal("gold")}, '.,!؟? ') AS key, trim({normal("alt")}, '.,!؟? ') AS altkey FROM gold),
verdict AS (SELECT id, category, contains(got, 'وشە') AS literal, CASE WHEN contains(got, 'وشە') THEN 0 WHEN got = key THEN 100 WHEN got = altkey THEN 90 WHEN length(got) > 2 THEN 50 ELSE 0 END AS score_x100, got, key, altkey FROM keyed)"""
SQL["benchmark_run"] = on(
    f"{_run}, refs AS (SELECT id, 0 AS k, key AS r, got AS h FROM verdict UNION ALL SELECT id, 1, altkey, got FROM verdict), {chrf('refs', 'id, k')}, top AS (SELECT id, max(chrf_e4) AS chrf_e4 FROM chrf GROUP BY id)",
    "SELECT category, count(*) AS items, count(*) FILTER (WHERE score_x100 >= 90) AS passed, count(*) FILTER (WHERE literal) AS literal_errors, CAST(sum(score_x100) AS BIGINT) AS score_sum, CAST(sum(chrf_e4) AS BIGINT) AS chrf_sum FROM verdict JOIN top USING (id) GROUP BY ROLLUP (category)",
)
SQL["project_ids"] = r"SELECT page_id, regexp_matches(regexp_extract(url, '/([^/]*)$', 1), '^[a-zA-Z0-9_\-]+$') AS valid FROM pages"
