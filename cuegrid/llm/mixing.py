"""Mixing sources to target weights by a minimum-cost flow over membership patterns.

Documents that belong to the same set of sources form a pattern; its capacity is
the sum of its documents' sizes.  A pattern may be used up to ``repeats`` times,
each further time at a higher cost (0, 1, 2 ... a word), and feeds the quotas of
its sources.  The cheapest flow that fills the quotas is found on this small
graph (one node for each pattern and source).  Each pattern then takes its whole
epochs, and for the rest a seeded choice of documents: those that come first in
the order of a hash, up to the first that doesn't fit any more, and then, from
large to small, others that still fit, until the room is below the smallest left.

The hash order is cut by buckets whose sizes are added up beforehand, so only the
documents of one bucket in 4,096 are ordered; no pattern is ever in one task.  The
fill is one task for each pattern.  Its room is smaller than one document, and of
each size class (powers of two) it gets no more than reach the room: at most twice
as many rows as the largest document has words.  A pass may leave room that the
rest of a class fits, so passes go on until nothing fits; each halves the largest
size that can still be open, in practice one or two do.

Defined results: a null text or size counts 0; a null source is a source of its
own, last in order; rows that share id, pattern and size are numbered and taken
one by one; very long texts are documents like any other; ties of the hash are
broken by id, number and size; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.llm.stages import materialise, table

BUCKETS = 4096
KEY = ["h", "doc_id", "copy", "size"]


def word_count(text: str) -> Column:
    """Runs of other than the ASCII blanks."""
    t = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"[\x20\x09-\x0D]+"))).cast("long")


def capped_targets(sizes: list[int], weights: list[float], repeats: int = 3, total: int | None = None) -> list[float]:
    """Shares of the total (the sum of sizes, unless sources overlap) by weight; none above `repeats` times its size, the excess shared again by weight."""
    out, free, rest = [0.0] * len(sizes), [i for i in range(len(sizes)) if sizes[i] > 0], float(sum(sizes) if total is None else total)
    while free:
        shares = sum(weights[i] for i in free)
        over = [i for i in free if rest * weights[i] / shares > repeats * sizes[i]]
        if not over:
            for i in free:
                out[i] = rest * weights[i] / shares
            break
        for i in over:
            out[i] = float(repeats * sizes[i])
        rest -= sum(out[i] for i in over)
        free = [i for i in free if i not in over]
    return out


def cheapest_flow(capacity: list[int], members: list[list[int]], demand: list[int], repeats: int = 3) -> list[list[int]]:
    """flow[pattern][k]: words of pattern for its k-th source, by successive shortest paths.  Unfilled demand stays unfilled."""
    n_p, n_s = len(capacity), len(demand)
    start, goal = n_p + n_s, n_p + n_s + 1
    graph: list[list[int]] = [[] for _ in range(goal + 1)]
    to, room, cost = [], [], []

    def arc(a: int, b: int, c: int, w: int) -> int:
        for x, y, z, v in ((a, b, c, w), (b, a, 0, -w)):
            graph[x].append(len(to))
            to.append(y), room.append(z), cost.append(v)
        return len(to) - 2

    for p, c in enumerate(capacity):
        for k in range(repeats):  # convex: each further use costs one more a word
            arc(start, p, c, k)
    uses = [[arc(p, n_p + s, sum(demand), 0) for s in m] for p, m in enumerate(members)]
    for s, d in enumerate(demand):
        arc(n_p + s, goal, d, 0)
    height = [0] * (goal + 1)
    while True:
        dist: dict[int, int] = {start: 0}
        by: dict[int, int] = {}
        heap, fixed = [(0, start)], set()
        while heap:
            d, x = heapq.heappop(heap)
            if x in fixed:
                continue
            fixed.add(x)
            for e in graph[x]:
                y = to[e]
                if room[e] and (v := d + cost[e] + height[x] - height[y]) < dist.get(y, 1 << 60):
                    dist[y], by[y] = v, e
                    heapq.heappush(heap, (v, y))
        if goal not in dist:
            break
        for x, d in dist.items():
            height[x] += d
        for x in range(goal + 1):
            if x not in dist:
                height[x] += max(dist.values())
        path, x = [], goal
        while x != start:
            path.append(by[x])
            x = to[by[x] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    return [[room[e ^ 1] for e in m] for m in uses]


def _same(a: DataFrame, b: DataFrame, nullable: str, *keys: str) -> Column:
    """Rows of both sides with the same keys; the first may be null."""
    out = a[nullable].eqNullSafe(b[nullable])
    for k in keys:
        out &= a[k] == b[k]
    return out


def _first_in_order(units: DataFrame, state: DataFrame) -> DataFrame:
    """i, cut, last, room: a pattern takes the buckets before `cut` and, in it, the units up to `last` (null: none of them); `room` is what stays open.  Never all units of a pattern fit, its rest being smaller than its capacity."""
    open_ = units.join(state, units["pattern"].eqNullSafe(state["p"])).where("size > 0")
    # one row for each pattern and bucket; a window over the buckets of a pattern, BUCKETS at most
    upto = F.sum("words").over(Window.partitionBy("i").orderBy("bucket"))
    sums = open_.groupBy("i", "rest", "bucket").agg(F.sum("size").alias("words")).withColumn("upto", upto).where("upto > rest")
    cuts = materialise(
        sums.groupBy("i", "rest").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("c")).select("i", "rest", "c.*"),
    )
    inside = open_.drop("rest").join(cuts, ["i", "bucket"]).withColumn(
        "upto",
        F.col("before") + F.sum("size").over(Window.partitionBy("i").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, 0)),
    )
    last = inside.where("upto <= rest").groupBy("i").agg(F.max(F.struct("upto", F.struct(*KEY).alias("me"))).alias("x"))
    return cuts.join(last, "i", "left").select(
        "i",
        F.col("bucket").alias("cut"),
        F.col("x.me").alias("last"),
        (F.col("rest") - F.coalesce("x.upto", "before")).alias("room"),
    )


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one pattern's candidates those that fit one after the other, the large classes first."""
    rows = rows.sort_values(["class", *KEY], ascending=[False] + [True] * len(KEY), kind="stable")
    room, keep = int(rows["room"].iloc[0]), np.zeros(len(rows), bool)
    for k, size in enumerate(rows["size"].tolist()):
        if size <= room:
            keep[k] = True
            room -= size
    return rows.loc[keep, ["i", *KEY]]


def _choose(units: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What _first_in_order gives, and the units that fill the room it leaves."""
    edges = materialise(_first_in_order(units, state))
    named = state.select("i", "p").join(edges.where("room > 0"), "i")
    later = F.col("last").isNull() | (F.struct(*KEY) > F.col("last"))
    left = units.join(named, units["pattern"].eqNullSafe(named["p"])).where("size > 0 AND size <= room").where(
        (F.col("bucket") > F.col("cut")) | ((F.col("bucket") == F.col("cut")) & later),
    )
    left = left.select("i", "bucket", *KEY, F.floor(F.log2("size")).cast("int").alias("class"))
    room, parts = edges.select("i", "room"), []
    while True:
        open_ = left.join(room, "i").where("size <= room")
        for p in parts:
            open_ = open_.join(p, _same(open_, p, "doc_id", "i", "h", "copy", "size"), "left_anti")
        group = Window.partitionBy("i", "class")
        sums = open_.groupBy("i", "class", "bucket", "room").agg(F.sum("size").alias("words"))
        sums = sums.withColumn("before", F.sum("words").over(group.orderBy("bucket")) - F.col("words")).where("before < room")
        near = open_.join(sums.select("i", "class", "bucket", "before"), ["i", "class", "bucket"])
        order = Window.partitionBy("i", "class", "bucket").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, 0)
        near = near.withColumn("upto", F.col("before") + F.sum("size").over(order)).where("upto - size < room")
        part = materialise(near.select("i", "class", "room", *KEY).groupBy("i").applyInPandas(_fill, "i int, h long, doc_id long, copy long, size long"))
        if part.isEmpty():
            break
        parts.append(part)
        used = part.groupBy("i").agg(F.sum("size").alias("used"))
        room = materialise(room.join(used, "i", "left").select("i", (F.col("room") - F.coalesce("used", F.lit(0))).alias("room")).where("room > 0"))
    taken = part
    for p in parts:
        taken = taken.unionByName(p)
    return edges, taken


def mix(
    docs: DataFrame,
    members: str = "sources",
    size: str = "size",
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    repeats: int = 3,
    seed: int = 11,
) -> DataFrame:
    """docs: doc_id, size, and an array of the sources it belongs to.  Adds pattern, source_size and target (of its first source), epochs, picked and taken.  Sources get the weights in turn, by code point, null last; one row for each pattern reaches the driver."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.greatest(F.lit(0), F.coalesce(F.col(size), F.lit(0))).cast("long").alias("size"),
        F.array_sort(F.array_distinct(F.col(members))).alias("pattern"),
    )
    # rows that share id, pattern and size are numbered
    rows = rows.groupBy("pattern", "doc_id", "size").agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "copy",
        F.explode(F.sequence(F.lit(1).cast("long"), "rows")),
    ).drop("rows")
    # the sign bit is turned, so h and the buckets are in the hash's unsigned order
    units = materialise(
        rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "copy").bitwiseXOR(F.lit(-(1 << 63)))).withColumn("bucket", (F.shiftright("h", 52)).cast("int")),
    )
    patterns = [(tuple(r["pattern"] or []), r["cap"]) for r in units.groupBy("pattern").agg(F.sum("size").alias("cap")).collect()]
    patterns.sort(key=lambda x: [(s is None, s or "") for s in x[0]])
    sources = sorted({s for p, _ in patterns for s in p}, key=lambda s: (s is None, s or ""))
    place = {s: i for i, s in enumerate(sources)}
    size_of = [0] * len(sources)
    for p, cap in patterns:
        for s in p:
            size_of[place[s]] += cap
    target = capped_targets(size_of, [weights[i % len(weights)] for i in range(len(sources))], repeats, sum(cap for _, cap in patterns))
    flow = cheapest_flow([cap for _, cap in patterns], [[place[s] for s in p] for p, _ in patterns], [round(t) for t in target], repeats)
    plan = []
    for i, ((p, cap), f) in enumerate(zip(patterns, flow)):
        whole, rest = divmod(sum(f), cap) if cap else (0, 0)
        first = place[p[0]] if p else None
        plan.append((i, list(p), size_of[first] if p else 0, target[first] if p else 0.0, whole, rest))
    # written, so that Spark knows its size and broadcasts it only while it is small
    plan = materialise(spark.createDataFrame(plan, "i int, p array<string>, source_size long, target double, epochs long, rest long").coalesce(1))
    edges, filled = _choose(units, plan.select("i", "p", "rest").where("rest > 0"))
    plan = plan.join(edges.drop("room").withColumnRenamed("i", "ei"), F.col("i") == F.col("ei"), "left").drop("ei", "rest")
    out = units.join(plan, units["pattern"].eqNullSafe(plan["p"]), "left")
    filled = filled.select(F.col("i").alias("fi"), *[F.col(k).alias(f"f_{k}") for k in KEY])
    me = (F.col("i") == F.col("fi")) & F.col("doc_id").eqNullSafe(F.col("f_doc_id"))
    for k in ("h", "copy", "size"):
        me &= F.col(k) == F.col(f"f_{k}")
    out = out.join(filled, me, "left")
    first = (F.col("bucket") < F.col("cut")) | ((F.col("bucket") == F.col("cut")) & (F.struct(*KEY) <= F.col("last")))
    out = out.withColumn("picked", (F.col("size") > 0) & (F.col("fi").isNotNull() | F.coalesce(first, F.lit(False))))
    return out.select(
        "doc_id",
        "size",
        "pattern",
        "source_size",
        "target",
        "epochs",
        "picked",
        (F.col("size") * (F.col("epochs") + F.col("picked").cast("long"))).alias("taken"),
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """Documents with one source each."""
    return mix(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_count("text").alias("size"), F.array(F.col("source").cast("string")).alias("sources")),
        **options,
    )


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
