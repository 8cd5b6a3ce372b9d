"""Translation scoring: n-gram F-scores by joins of counts, gold verdicts, consensus, edit metrics."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

from cuegrid.functions import text as T


def char_ngrams(rows: DataFrame, key: list[str], text: str, order: int = 6) -> DataFrame:
    """key, n, gram, cnt: character n-grams of each blank-separated word with a blank at both ends."""
    words = rows.select(*key, F.explode(T.tokens(F.col(text))).alias("w")).withColumn("w", F.concat(F.lit(" "), F.col("w"), F.lit(" ")))
    sized = words.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(order)))).where(F.length("w") >= F.col("n"))
    grams = sized.select(
        *key,
        "n",
        F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - F.col("n") + 1), lambda i: F.substring(F.col("w"), i, F.col("n")))).alias("gram"),
    )
    return grams.groupBy(*key, "n", "gram").agg(F.count("*").alias("cnt"))


def word_ngrams(rows: DataFrame, key: list[str], text: str, order: int) -> DataFrame:
    ws = rows.select(*key, T.tokens(F.col(text)).alias("ws")).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(order)))).where(F.size("ws") >= F.col("n"))
    grams = ws.select(
        *key,
        "n",
        F.explode(F.transform(F.sequence(F.lit(0), F.size("ws") - F.col("n")), lambda i: F.array_join(F.slice("ws", i + 1, F.col("n")), " "))).alias("gram"),
    )
    return grams.groupBy(*key, "n", "gram").agg(F.count("*").alias("cnt"))


def chrf(
    pairs: DataFrame,
    key: list[str],
    reference: str = "reference",
    hypothesis: str = "hypothesis",
    chars: int = 6,
    words: int = 0,
    beta: int = 2,
) -> DataFrame:
    """key, chrf_e4: floor of 10,000 times the F-score; 10,000 where both are blank or equal after stripping of blanks, 0 where one is blank."""
    both = pairs.select(*key, F.col(reference).alias("r"), F.col(hypothesis).alias("h"))

    def counts(side: str) -> DataFrame:
        out = char_ngrams(both, key, side, chars).withColumn("kind", F.lit("c"))
        return out.unionByName(word_ngrams(both, key, side, words).withColumn("kind", F.lit("w"))) if words else out

    at = [*key, "kind", "n"]
    # one exchange serves both: the two sides are counted, then met, by the same key and gram
    met = counts("h").withColumn("side", F.lit("h")).unionByName(counts("r").withColumn("side", F.lit("r")))
    met = met.groupBy(*at, "gram").agg(
        F.sum(F.when(F.col("side") == "h", F.col("cnt")).otherwise(0)).alias("ch"),
        F.sum(F.when(F.col("side") == "r", F.col("cnt")).otherwise(0)).alias("cr"),
    )
    sums = met.groupBy(*at).agg(F.sum("ch").alias("th"), F.sum("cr").alias("tr"), F.sum(F.least("ch", "cr")).alias("m")).where("th > 0 AND tr > 0")
    avg = sums.groupBy(*key).agg(F.avg(F.col("m") / F.col("th")).alias("p"), F.avg(F.col("m") / F.col("tr")).alias("q"))
    b2 = beta * beta
    f = F.when(F.col("p") + F.col("q") > 0, (1 + b2) * F.col("p") * F.col("q") / (b2 * F.col("p") + F.col("q"))).otherwise(0.0)
    blank = (T.strip(F.col("r")) == "") | (T.strip(F.col("h")) == "")
    same = T.strip(F.col("r")) == T.strip(F.col("h"))
    scored = both.join(avg.select(*key, f.alias("f")), key, "left")
    return scored.select(
        *key,
        F.when(blank, F.when(same, 10000).otherwise(0)).otherwise(F.floor(F.coalesce("f", F.lit(0.0)) * 10000 + 1e-6)).cast("long").alias("chrf_e4"),
    )


def gold_verdicts(items: DataFrame, translation: str = "translation") -> DataFrame:
    """items: id, category, gold, alternatives, literals and a translation.  score_x100: 0 for a literal error, 100 exact, 90 acceptable, else 50 if longer than two."""
    got = T.score_key(F.col(translation))
    facts = items.withColumns({"got": got, "key": T.score_key(F.col("gold"))})
    literal = F.exists("literals", lambda x: F.contains(F.col("got"), T.normalize(x)))
    near = F.exists("alternatives", lambda x: T.score_key(x) == F.col("got"))
    score = F.when(literal, 0).when(F.col("got") == F.col("key"), 100).when(near, 90).when(F.length("got") > 2, 50).otherwise(0)
    return facts.withColumns({"literal": literal, "exact": F.col("got") == F.col("key"), "acceptable": near}).withColumn("score_x100", score)


def gold_chrf(items: DataFrame, translation: str = "translation") -> DataFrame:
    """id, chrf_e4: the best against the gold text and its alternatives."""
    refs = items.select(
        "id",
        T.score_key(F.col(translation)).alias("hypothesis"),
        F.posexplode(F.concat(F.array("gold"), F.coalesce("alternatives", F.array().cast("array<string>")))).alias("k", "ref"),
    )
    return chrf(refs.withColumn("reference", T.score_key(F.col("ref"))), ["id", "k"]).groupBy("id").agg(F.max("chrf_e4").alias("chrf_e4"))


def category_report(scored: DataFrame) -> DataFrame:
    """Per category and, in the row without one, over all: items, passed, literal errors, sums of scores."""
    return scored.rollup("category").agg(
        F.count("*").alias("items"),
        F.count_if(F.col("score_x100") >= 90).alias("passed"),
        F.count_if("literal").alias("literal_errors"),
        F.sum("score_x100").cast("long").alias("score_sum"),
        F.sum("chrf_e4").cast("long").alias("chrf_sum"),
    )


def consensus(first: Column, second: Column | None) -> Column:
    """Hundredths: 100 equal after normalization or a single model, 75 both there, else 0."""
    if second is None:
        return F.lit(100)
    a, b = T.normalize(first), T.normalize(second)
    return F.when(a == b, 100).when((a != "") & (b != ""), 75).otherwise(0)


def ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


@pandas_udf(DoubleType())
def match_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks; not symmetric."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def _spans(a, b) -> int:
    return sum(max(i2 - i1, j2 - j1) for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b).get_opcodes() if tag != "equal")


def _rate(a, b) -> float:
    return (1.0 if len(b) else 0.0) if not len(a) else round(min(1.0, _spans(a, b) / len(a)), 3)


@pandas_udf(DoubleType())
def word_error_rate(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    return pd.Series([_rate((r or "").split(), (h or "").split()) for r, h in zip(reference, hypothesis)], dtype="float64")


@pandas_udf(DoubleType())
def char_error_rate(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    return pd.Series([_rate(r or "", h or "") for r, h in zip(reference, hypothesis)], dtype="float64")


@pandas_udf(StringType())
def diff_html(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """Words with deletions and insertions marked."""

    def one(r: str, h: str) -> str:
        a, b, out = r.split(), h.split(), []
        gone, new = "<del style='background:#7f1d1d; color:#fca5a5;'>{}</del>", "<ins style='background:#14532d; color:#86efac;'>{}</ins>"
        for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b).get_opcodes():
            old, add = " ".join(a[i1:i2]), " ".join(b[j1:j2])
            out.append({"equal": old, "replace": f"{gone.format(old)} {new.format(add)}", "delete": gone.format(old), "insert": new.format(add)}[tag])
        return " ".join(out)

    return pd.Series([one(r or "", h or "") for r, h in zip(reference, hypothesis)])


def compare(pairs: DataFrame, original: str = "original", revised: str = "revised") -> DataFrame:
    """Adds has_changes, wer, cer and diff_html of the normalized texts; the UDFs see changed pairs only."""
    facts = pairs.withColumns({"o": T.normalize(F.col(original)), "n": T.normalize(F.col(revised))}).withColumn("has_changes", F.col("o") != F.col("n"))
    changed = facts.where("has_changes").withColumns({"wer": word_error_rate("o", "n"), "cer": char_error_rate("o", "n"), "diff_html": diff_html("o", "n")})
    same = facts.where("NOT has_changes").withColumns(
        {"wer": F.lit(0.0), "cer": F.lit(0.0), "diff_html": F.concat(F.lit("<span>"), F.col("o"), F.lit("</span>"))},
    )
    return changed.unionByName(same).drop("o", "n")


def ensemble(first: DataFrame, second: DataFrame, keys: tuple[str, ...] = ("track_id", "seq")) -> DataFrame:
    """Two providers' translations of the same cues: those of the first, and the second's where there is one ('' else), with their consensus."""
    other = second.groupBy(*keys).agg(F.max("translation").alias("second"))
    both = first.select(*keys, F.col("translation").alias("first")).join(other, [*keys], "left").withColumn("second", F.coalesce("second", F.lit("")))
    return both.withColumn("score", consensus(F.col("first"), F.col("second")))


def benchmark(items: DataFrame, provider) -> DataFrame:
    """A provider's run over a gold set, by category.  items: id, category, source, gold, alternatives, literals."""
    asked = items.select(F.lit("gold").alias("track_id"), F.col("id").alias("seq"), F.col("source").alias("source_text"))
    said = provider.translate(asked).select(F.col("seq").alias("id"), "translation")
    answered = items.join(said, "id", "left").withColumn("translation", F.coalesce("translation", F.lit("")))
    return category_report(gold_verdicts(answered).join(gold_chrf(answered), "id"))
