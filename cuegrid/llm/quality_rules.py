"""Quality rules whose cutoffs are certified on labelled documents.

Every rule is a share of a document (symbols, repeated lines, repeated words,
capitals, exclamation marks) and rejects what lies above a cutoff.  Cutoffs are
chosen per stratum.  For each rule and stratum the candidates form a sequence
from "reject nothing" downwards; a candidate is valid while the exact binomial
test rejects "more than alpha of the good documents would be lost".  Fixed
sequence testing inside a sequence and a Bonferroni division over rules and
strata keep the chance of any wrong certificate under delta.  Among the valid
cutoffs the one that rejects most bad documents, less a price for good ones, is
taken, the highest at ties.

The certificate is about the cutoffs: it counts good documents that pass the base
rules and are rejected by a cutoff; what the base rules themselves reject, which the
contract fixes, is not counted.

Defined results: a null text is empty (no words: base_failed).  Very long texts are
measured whole.  A null stratum is a stratum of its own; a stratum without enough
labels gets no cutoff, so only the base rules act there.  Repeated ids are scored row
by row; repeated labels count once, with the larger label.  An empty table gives no
rows.  Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrid.llm.stages import gather, map_texts, materialise, one_label, table
from cuegrid.llm.textblock import TextBlock, ngrams

BINS = 200
#: rule: (numerator, denominator)
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "exclaims": ("n_exclaims", "n_words"),
}


def _marks(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _CAPITAL, _EXCLAIM = _marks(b"#*$%&|<>"), _marks(bytes(range(65, 91))), _marks(b"!")
_LEAD = np.array([(b & 0xC0) != 0x80 for b in range(256)])


def measures(block: TextBlock, _: pa.RecordBatch | None = None) -> dict:
    """The counts of each text of a block."""
    words, n = block.word_hash(), block.n
    lead = np.concatenate(([0], np.cumsum(_LEAD[block.data], dtype=np.int64)))
    chars = np.concatenate(([0], np.cumsum(lead[block.end] - lead[block.start])))
    # lines with a word: cut at \n and at the ends of texts
    breaks = np.flatnonzero(block.data == 10)
    # a line starts at each text's start and behind each \n inside it; one that starts where its text ends has no word
    starts = np.unique(np.concatenate((block.text_ptr[:-1], breaks + 1)))
    starts = starts[starts < len(block.data)]
    text = np.searchsorted(block.text_ptr, starts, "right") - 1
    # a line ends at the \n before the next start, or with its text
    after, ends = np.append(starts[1:], len(block.data)), block.text_ptr[text + 1]
    inside = (after <= ends) & (block.data[after - 1] == 10) if len(starts) else np.zeros(0, bool)
    ends = np.where(inside, after - 1, ends)
    has = np.searchsorted(block.start, ends) > np.searchsorted(block.start, starts)
    starts, ends, text = starts[has], ends[has], text[has]
    line = block.span_hash(starts, ends) ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(line, return_index=True)
    n_lines = np.bincount(text, minlength=n)
    n_dup = n_lines - np.bincount(text[first], minlength=n)
    # words inside 8-word windows that occur twice or more in their text
    grams, ptr = ngrams(words, block.word_ptr, 8)
    owner = np.repeat(np.arange(n), np.diff(ptr))
    key = grams ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    at = at - ptr[owner[at]] + block.word_ptr[owner[at]]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + 8, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))
    at = block.word_ptr
    return {
        "n_words": block.n_words, "word_chars": chars[at[1:]] - chars[at[:-1]], "n_symbols": block.count_bytes(_SYMBOL), "n_dup_lines": n_dup,
        "n_repeat_words": covered[at[1:]] - covered[at[:-1]], "n_lines": n_lines, "n_capitals": block.count_bytes(_CAPITAL), "n_exclaims": block.count_bytes(_EXCLAIM),
    }


def _beta_cf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / ((1 - (a + b) * x / (a + 1)) or tiny)
    h = d
    for m in range(1, 2000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-12:
            break
    return h


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly (regularised incomplete beta)."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_cf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_cf(b, a, 1 - x) / b


def certified_cutoff(good: np.ndarray, bad: np.ndarray, alpha: float, delta: float, price: float = 10.0) -> int:
    """The bin above which to reject, from the good and bad documents in each bin; BINS rejects nothing."""
    n, best, gain, lost, won = int(good.sum()), BINS, 0.0, 0, 0
    for b in range(BINS - 1, -1, -1):
        lost, won = lost + int(good[b + 1]), won + int(bad[b + 1])
        if n == 0 or binomial_cdf(lost, n, alpha) > delta:
            break
        if won - price * lost > gain:
            best, gain = b, won - price * lost
    return best


def with_shares(metrics: DataFrame) -> DataFrame:
    out = metrics.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return out.withColumns(
        {f"bin_{r}": F.least(F.lit(BINS), F.floor(BINS * F.col(a) / F.greatest(F.lit(1), F.col(b)))).cast("int") for r, (a, b) in RULES.items()},
    )


def calibrate(scored: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> dict[str, dict[str, int]]:
    """Cutoff bins by stratum and rule from all labelled documents that pass the base rules.  What reaches the driver is one row per stratum, rule and bin: 1,005 for each stratum at most."""
    known = scored.where(~F.col("base_failed")).join(one_label(labels, "quality"), "doc_id")
    long = known.select("stratum", "y", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"bin_{r}").alias("bin")) for r in RULES])).alias("x"))
    counts = gather(
        long.groupBy("stratum", "x.rule", "x.bin").agg(
            F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("y") == 1, 0).otherwise(1)).alias("bad"),
        ),
    ).to_pylist()
    hist: dict[tuple[str, str], np.ndarray] = {}
    for r in counts:
        h = hist.setdefault((r["stratum"], r["rule"]), np.zeros((2, BINS + 1), np.int64))
        h[:, r["bin"]] += (r["good"], r["bad"])
    out: dict[str, dict[str, int]] = {}
    for (stratum, rule), (good, bad) in sorted(hist.items()):
        out.setdefault(stratum, {})[rule] = certified_cutoff(good, bad, alpha / len(RULES), delta / len(hist))
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """doc_id, counts, base_failed, failed_rule (null if none), kept."""
    ddl = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long, n_exclaims long"
    rows = docs.select("doc_id", "text", F.coalesce(F.col(stratum).cast("string"), F.lit("\0")).alias("stratum"))
    scored = with_shares(materialise(map_texts(rows, measures, ddl)))
    cutoffs = calibrate(scored, labels, alpha, delta)
    spark = docs.sparkSession
    cut = spark.createDataFrame(
        [(s, *(c.get(r, BINS) for r in RULES)) for s, c in cutoffs.items()],
        "stratum string, " + ", ".join(f"cut_{r} int" for r in RULES),
    )
    failed = F.coalesce(*[F.when(F.col(f"bin_{r}") > F.coalesce(F.col(f"cut_{r}"), F.lit(BINS)), F.lit(r)) for r in RULES])
    out = scored.join(cut, "stratum", "left").withColumn("failed_rule", F.when(F.col("base_failed"), F.lit("base")).otherwise(failed))
    return out.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "failed_rule",
        F.col("failed_rule").isNull().alias("kept"),
    )


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
