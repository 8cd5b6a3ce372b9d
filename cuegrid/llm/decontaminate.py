"""Benchmark decontamination by SimHash windows, Hamming blocks and an exact check; DataFrame operations only.

Words are runs of letters, marks and digits in lower case, shingles are five of
them.  Windows have the size of the benchmark items.  One is laid wherever a
shingle of an item occurs in a text, at the place the item would then have (cut at
the text's ends); a window that shares no shingle with any item has similarity 0
and needs no fingerprint.  The items' shingles are first looked up by one of 2**20
slots, a table of fixed size, while the text is scanned; few positions are left to
join, and they travel without words.  Windows are numbers until they are distinct:
only then are the texts that hold some read again and cut, each text once, however
many documents share it.

Each distinct window gets a 64-bit SimHash of its words.  Fingerprints are cut
into five blocks of 13 bits (the last has 12): within radius 19 some block differs
in 3 bits at most, so joining the windows' blocks with all values that near to the
blocks of the items of the window's size finds every pair within the radius.  What
is within it is verified by the weighted Jaccard similarity of the two multisets of
shingles (sum of the smaller counts over sum of the larger).  The radius is a
choice: of windows at the threshold of 0.8 it holds all but one in some thousands
(tests/llm compares with all windows).

Defined results: null or empty texts and texts or items of fewer than five words
match nothing; very long texts and items are whole, and work grows with their
length; repeated documents and items give one row for each pair; of several
windows the most similar, then the first, is reported; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuegrid.llm.stages import materialise, table

K, SLOTS, BLOCKS, BLOCK_BITS, RADIUS = 5, 1 << 20, 5, 13, 19


def words_of(text: str) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}\p{M}]+", " ")), " ")


def _gram(w: Column, i: Column) -> Column:
    return F.xxhash64(*[w[i + j] for j in range(K)])


def _places(w: Column) -> Column:
    """0 .. the last shingle's place; empty for fewer than K words."""
    return F.when(F.size(w) >= K, F.sequence(F.lit(0), F.size(w) - K)).otherwise(F.array().cast("array<int>"))


def _grams(words: str) -> Column:
    """The shingles' hashes.  The words are bound by a lambda: however the optimizer moves this, they are made once."""
    return F.transform(F.array(F.col(words)), lambda w: F.transform(_places(w), lambda i: _gram(w, i)))[0]


def fingerprint(words: Column) -> Column:
    """64-bit SimHash of an array of words: each bit by the majority of the words' hashes."""
    hashes = F.transform(words, lambda x: F.xxhash64(x))
    bit = lambda hs, b: F.size(F.filter(hs, lambda h: F.getbit(h, b) == 1)) * 2 > F.size(hs)
    # the hashes are bound by a lambda, so they are computed once
    return F.transform(
        F.array(hashes),
        lambda hs: F.aggregate(
            F.sequence(F.lit(0), F.lit(63)),
            F.lit(0).cast("long"),
            lambda acc,
            b: F.when(bit(hs, b), acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(acc),
        ),
    )[0]


def _block(fp: Column, i: Column) -> Column:
    return F.call_function("shiftrightunsigned", fp, i * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("long")).cast("int")


def hamming_pairs(left: DataFrame, right: DataFrame, on: str | None = None) -> DataFrame:
    """All pairs within RADIUS of left.fp and right.item_fp (and with the same value of `on`), once each.  The right side, the benchmark, is the one that is widened."""
    near = [sum(1 << b for b in bits) for n in range(RADIUS // BLOCKS + 1) for bits in combinations(range(BLOCK_BITS), n)]
    each = F.sequence(F.lit(0), F.lit(BLOCKS - 1))
    a = left.withColumn("block", F.explode(each)).withColumn("part", _block(F.col("fp"), F.col("block")))
    b = right.withColumn("block", F.explode(each)).withColumn("mask", F.explode(F.lit(near))).withColumn(
        "part",
        _block(F.col("item_fp"), F.col("block")).bitwiseXOR(F.col("mask")),
    ).drop("mask")
    pairs = a.join(b, ["block", "part", *([on] if on else [])]).withColumn(
        "distance",
        F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))),
    ).where(F.col("distance") <= RADIUS)
    # a pair meets in several blocks: it counts in the first that is near enough
    earlier = F.exists(each, lambda i: (i < F.col("block")) & (F.bit_count(_block(F.col("fp"), i).bitwiseXOR(_block(F.col("item_fp"), i))) <= RADIUS // BLOCKS))
    return pairs.where(~earlier).drop("block", "part")


def _histograms(rows: DataFrame, key: list[str], grams: str) -> DataFrame:
    """key, counts: how often each shingle occurs."""
    counted = rows.select(*key, F.explode(grams).alias("g")).groupBy(*key, "g").agg(F.count("*").cast("int").alias("c"))
    return counted.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("g", "c"))).alias("counts"))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two multisets given as maps of counts."""
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0), lambda s, c: s + c)
    nil = F.lit(0)
    both = total(F.map_zip_with(a, b, lambda _, x, y: F.least(F.coalesce(x, nil), F.coalesce(y, nil))))
    return F.transform(F.array(both), lambda m: m / F.greatest(F.lit(1), total(a) + total(b) - m))[0]


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, text_hash, item_id, similarity, distance, start_word, n_words: texts of documents with a window as similar to an item."""
    items = benchmark.select("item_id", words_of("text").alias("iw")).where(F.size("iw") >= K)
    # items of the same words are one
    items = items.groupBy("iw").agg(F.collect_set("item_id").alias("ids")).withColumn("ik", F.xxhash64("iw"))
    items = materialise(items.withColumn("length", F.size("iw")).withColumn("item_fp", fingerprint(F.col("iw"))).withColumn("item_grams", _grams("iw")))
    grams = materialise(items.select("length", F.posexplode("item_grams").alias("offset", "g")).distinct())
    slot = lambda h: F.pmod(h, F.lit(SLOTS).cast("long")).cast("int")
    # SLOTS rows at most, whatever the benchmark's size: a proven bound for the broadcast
    slots = grams.select(slot(F.col("g")).alias("slot")).distinct()

    texts = docs.where("text IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("tk"))
    all_grams = texts.select("tk", words_of("text").alias("w")).select("tk", F.size("w").alias("n"), _grams("w").alias("gs"))
    # outer: the plain form infers a filter below, which would make the grams twice
    near = all_grams.select(
        "tk",
        "n",
        F.posexplode_outer("gs").alias("p", "g"),
    ).withColumn("slot", slot(F.col("g"))).join(F.broadcast(slots), "slot", "left_semi")
    laid = near.join(grams, "g").select(
        "tk",
        F.greatest(F.lit(0), F.col("p") - F.col("offset")).alias("start"),
        F.least(F.col("n"), F.col("p") - F.col("offset") + F.col("length")).alias("stop"),
        "length",
    ).distinct()
    spots = materialise(laid.groupBy("tk").agg(F.collect_list(F.struct("start", "stop", "length")).alias("spots")))
    # the texts with windows; a text that many documents share is one skewed key, which a join alone may split
    matched = materialise(texts.join(spots.select("tk"), "tk"))
    whole = matched.groupBy("tk").agg(F.first("text").alias("text")).join(spots, "tk").select("tk", "spots", words_of("text").alias("w"))
    # exploded first, cut after: no row holds the words of more than one window beside the text's
    cut = F.slice(F.col("w"), F.col("x.start") + 1, F.col("x.stop") - F.col("x.start")).alias("ww")
    windows = materialise(whole.select("tk", "w", F.explode("spots").alias("x")).select("tk", "x.start", "x.length", cut).withColumn("wh", F.xxhash64("ww")))

    once = windows.groupBy("wh", "length").agg(F.first("ww").alias("ww")).where(F.size("ww") >= K).withColumn("fp", fingerprint(F.col("ww")))
    once = materialise(once.withColumn("grams", _grams("ww")).drop("ww"))
    pairs = hamming_pairs(once.select("wh", "length", "fp"), items.select("ik", "length", "item_fp"), "length").select("wh", "length", "ik", "distance")
    seen = _histograms(once, ["wh", "length"], "grams").join(materialise(pairs), ["wh", "length"])
    checked = seen.join(_histograms(items, ["ik"], "item_grams").withColumnRenamed("counts", "item_counts"), "ik")
    checked = checked.withColumn("similarity", similarity(F.col("counts"), F.col("item_counts")))
    found = materialise(checked.where(F.col("similarity") >= threshold).select("wh", "length", "ik", "similarity", "distance"))
    back = windows.select("tk", "start", "wh", "length", F.size("ww").alias("n_words")).join(found, ["wh", "length"])
    best = back.groupBy("tk", "ik").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), (-F.col("distance")).alias("d"), "n_words")).alias("x"))
    named = best.join(items.select("ik", F.explode("ids").alias("item_id")), "ik").select("tk", "item_id", "x")
    out = matched.select("doc_id", "tk").distinct().join(named, "tk")
    return out.select(
        "doc_id",
        F.col("tk").alias("text_hash"),
        "item_id",
        "x.similarity",
        (-F.col("x.d")).alias("distance"),
        (-F.col("x.s")).alias("start_word"),
        F.col("x.n_words").alias("n_words"),
    )


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    """The best window of each document and item; an id may stand for several texts."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    best = found.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("similarity", (-F.col("start_word")).alias("s"), (-F.col("distance")).alias("d"), "n_words")).alias("x"),
    )
    return best.select(
        "doc_id",
        "item_id",
        "x.similarity",
        (-F.col("x.d")).alias("distance"),
        (-F.col("x.s")).alias("start_word"),
        F.col("x.n_words").alias("n_words"),
    )
