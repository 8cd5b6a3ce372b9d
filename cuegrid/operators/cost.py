"""Cost model: prices, scene and file estimates, the running ledger.  Tokens are integers, money is in USD."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuegrid import constants as K


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.PRICES, "model string, input double, output double")


def priced(rows: DataFrame, model: str = "model") -> DataFrame:
    """Adds price_in and price_out; an unknown model has the default price."""
    table = {m: (i, o) for m, i, o in K.PRICES}
    pick = lambda k: F.coalesce(*[F.when(F.col(model) == m, p[k]) for m, p in table.items()], F.lit(table["_default"][k]))
    return rows.withColumns({"price_in": pick(0), "price_out": pick(1)})


def scene_cost(cues: DataFrame, model: str, keys: tuple[str, ...] = ("track_id", "scene_no")) -> DataFrame:
    """input_tokens, output_tokens and usd_e6 (millionths, rounded) of translating each scene."""
    n, chars = F.count("*"), F.sum(F.length("source_text"))
    facts = cues.groupBy(*keys).agg(F.floor((2000 + chars + 50 * n) / 4).alias("input_tokens"), F.floor((chars * 12 + 1000) / 20).alias("output_tokens"))
    out = priced(facts.withColumn("model", F.lit(model)))
    return out.select(
        *keys,
        "input_tokens",
        "output_tokens",
        F.round((F.col("input_tokens") * F.col("price_in") + F.col("output_tokens") * F.col("price_out")) * 1000).cast("long").alias("usd_e6"),
    )


def file_cost(cues: DataFrame, model: str) -> DataFrame:
    """For each track, from its number of cues and their average length (whole characters): scenes of twenty, two and a half calls of input, two of output."""
    facts = cues.groupBy("track_id").agg(F.count("*").alias("cues"), F.floor(F.sum(F.length("source_text")) / F.count("*")).alias("avg_len"))
    facts = facts.withColumn("scenes", F.greatest(F.lit(1), F.floor(F.col("cues") / 20)))
    tokens = facts.withColumns(
        {
            "input_tokens": F.floor((2000 + 20 * (F.col("avg_len") + 50)) * F.col("scenes") * 5 / 8),
            "output_tokens": F.floor(F.col("avg_len") * 24 * F.col("scenes")),
        },
    )
    out = priced(tokens.withColumn("model", F.lit(model)))
    return out.select(
        "track_id",
        "cues",
        "avg_len",
        "scenes",
        "input_tokens",
        "output_tokens",
        F.round((F.col("input_tokens") * F.col("price_in") + F.col("output_tokens") * F.col("price_out")) * 10).cast("long").alias("usd_e4"),
    )


def ledger(calls: DataFrame, limit_e6: int, keys: tuple[str, ...] = ("project_id",), order: tuple[str, ...] = ("call_id",)) -> DataFrame:
    """Running spend of each project, what remains (0 at least) and whether the call fitted.  calls: usd_e6."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = calls.withColumn("spent_e6", F.sum("usd_e6").over(w))
    return out.withColumns({"remaining_e6": F.greatest(F.lit(0).cast("long"), limit_e6 - F.col("spent_e6")), "fits": F.col("spent_e6") <= limit_e6})
