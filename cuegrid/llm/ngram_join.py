"""N-gram Jaccard join by a MinHash LSH forest and exact verification.

A text is the set of its shingles of five words (blanks separate, A-Z in lower
case; a shorter text is one shingle).  Texts with one set are copies: they are one
class from here on, whatever their number.

The forest has ``TREES`` tries of MinHash signatures, ``DEPTH`` values of 16 bits
in each.  A trie is kept as its sorted keys: rows are dealt by tree and shortest
prefix and sorted, and each key's longest common prefix with its neighbours tells
how deep it is matched; keys without a match go.  Matching starts at the full
depth, where the pairs found are verified.  Their similarities say how many others
each depth would still miss: a found pair of similarity s stands for 1 / p(s)
pairs, p(s) = 1 - (1 - s**depth) ** TREES being its chance to be met there, and one
pair at the threshold is always supposed.  The prefix is shortened to the longest
at which the estimated recall reaches the target, the pairs met there for the first
time are verified, and so on until the estimate holds.  It is never shorter than
the depth at which a pair at the threshold itself is met with the target
probability, where no estimate is needed.

Groups of the same content, met in several tries or before, are kept once.  Every
pair of a group is verified by the exact Jaccard similarity, in the first trie where
it meets; groups too large for one task are cut into blocks, and each pair of blocks
is a task of its own.  Pairs are never written out: a task returns, for each
class, how many documents it is linked to, the root of its links inside the task,
and a histogram of similarities.  Links between tasks are joined to connected groups
by pointer jumping.

Result: one row for each document with class_id (the smallest id among the
documents linked to it directly or through others), copy_id (the smallest id with
the same set of shingles) and n_links (other documents of similarity at or above
the threshold, copies included).

Defined results: a null or empty text has no links and is its own class; repeated
rows are copies of each other; rows without an id are linked like any other, the ids
of a class are the smallest that are not null, and null where none is; very long texts are whole sets like any other (one text's
shingles must fit a task); ties don't arise, links being symmetric; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuegrid.llm.stages import emit_rows, map_texts, materialise, ragged, table
from cuegrid.llm.textblock import TextBlock, mix, shingles

K, TREES, DEPTH, BINS = 5, 20, 8, 40
VALUE = 2  # bytes of a signature's value
BLOCK_SHINGLES, BLOCK_CLASSES = 200_000, 1000
_MULT = np.random.default_rng(3).integers(1, 1 << 63, TREES * DEPTH // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def met(similarity: float | np.ndarray, depth: int) -> float | np.ndarray:
    """The chance that a pair shares a prefix of that depth in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def least_depth(threshold: float, target: float) -> int:
    """The longest prefix at which the forest meets a pair at the threshold with the target probability."""
    return max((d for d in range(1, DEPTH + 1) if met(threshold, d) >= target), default=1)


def estimated_recall(found: np.ndarray, threshold: float, at: int, depth: int) -> float:
    """The least recall at `depth` of the bins of similarity in which pairs were found at depth `at`, and that of all pairs with one more at the threshold: many near copies don't make up for lost pairs of less likeness, and nothing found is no proof."""
    low = threshold + (1 - threshold) * np.arange(BINS) / BINS  # the lower edges, the worse side
    seen = found.astype(float)
    seen[0] += met(threshold, at)
    pairs, share = seen / met(low, at), met(low, depth)
    return float(min((pairs * share).sum() / pairs.sum(), share[np.asarray(found) > 0].min(initial=1.0)))


def _sets(block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted inside it, and where each text's begin."""
    grams, ptr = shingles(block.lowered().word_hash(), block.word_ptr, K)
    owner = np.repeat(np.arange(block.n), np.diff(ptr))
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], np.searchsorted(owner[new], np.arange(block.n + 1))


def _set_hash(grams: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(grams ^ np.uint64(0x5851F42D4C957F2D)))))
    return mix(upto[ptr[1:]] - upto[ptr[:-1]] + np.diff(ptr).astype(np.uint64)).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, set_hash, n (0: no words) and the signature: DEPTH values for each tree."""

    def sign(block: TextBlock, _: pa.RecordBatch) -> dict:
        grams, ptr = _sets(block)
        n = np.diff(ptr)
        full = np.flatnonzero(n)
        values = np.zeros((len(full), TREES * DEPTH), np.uint16)
        if len(full):
            head = ptr[:-1][full]
            for k, m in enumerate(_MULT):
                x = grams * m
                x ^= x >> np.uint64(31)  # a product alone keeps too much of the order of the low bits
                x *= np.uint64(0x9E3779B97F4A7C15)
                x ^= x >> np.uint64(32)
                # the halves are two hash functions
                values[:, 2 * k] = np.minimum.reduceat(x.astype(np.uint32), head)
                values[:, 2 * k + 1] = np.minimum.reduceat((x >> np.uint64(32)).astype(np.uint32), head)
        width = values.shape[1] * VALUE
        at = np.concatenate(([0], np.cumsum(np.where(n > 0, width, 0)))).astype(np.int32)
        sig = pa.Array.from_buffers(pa.binary(), block.n, [None, pa.py_buffer(at), pa.py_buffer(values.tobytes())])
        return {"set_hash": _set_hash(grams, ptr), "n": n, "sig": sig}

    return map_texts(docs, sign, "doc_id long, text_hash long, set_hash long, n long, sig binary")


def _prefix(depth: int | str) -> Column:
    return F.expr(f"substring(key, 1, {VALUE} * {depth})")


def _deepest(least: int):
    """Sorted keys of the tries -> those that share a prefix of `least` values or more with a neighbour, and how many they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        tail: dict[str, np.ndarray] | None = None  # the last row so far, and what it shares with the one before
        for batch in batches:
            if not len(batch):
                continue
            col = {n: np.asarray(batch.column(k)) for k, n in enumerate(("tree", "set_hash", "n"))}
            key = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint16).reshape(-1, DEPTH)
            if tail:
                col = {n: np.concatenate((tail[n], x)) for n, x in col.items()}
                key = np.concatenate((tail["key"], key))
            same = (key[1:] == key[:-1]) & (col["tree"][1:] == col["tree"][:-1])[:, None]
            shared = np.concatenate((tail["shared"] if tail else [0], np.minimum.accumulate(same, axis=1).sum(axis=1)))
            yield from _kept(col, key, np.maximum(shared[:-1], shared[1:]), least)
            tail = {n: x[-1:] for n, x in col.items()} | {"key": key[-1:], "shared": shared[-1:]}
        if tail:
            yield from _kept({n: tail[n] for n in ("tree", "set_hash", "n")}, tail["key"], tail["shared"], least)

    return run


def _kept(col: dict[str, np.ndarray], key: np.ndarray, deep: np.ndarray, least: int) -> Iterator[dict]:
    at = np.flatnonzero(deep >= least)
    if len(at):
        yield {n: x[at] for n, x in col.items()} | {"key": [x.tobytes() for x in key[at]], "deep": deep[at]}


def forest(classes: DataFrame, least: int) -> DataFrame:
    """tree, set_hash, n, key, deep: the matched keys of the tries."""
    each = classes.select("set_hash", "n", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    each = each.select("tree", "set_hash", "n", F.expr(f"substring(sig, tree * {DEPTH * VALUE} + 1, {DEPTH * VALUE})").alias("key"))
    tries = each.repartition("tree", _prefix(least)).sortWithinPartitions("tree", "key")
    return emit_rows(tries, _deepest(least), "tree int, set_hash long, n long, key binary, deep int")


def _prefixes(sig: np.ndarray, depth: int) -> np.ndarray:
    """A number for the prefix of each row (and tree): equal where the values are."""
    out = np.zeros(sig.shape[:2], np.uint64)
    for d in range(depth):
        out = mix(out * np.uint64(31) + sig[:, :, d])
    return out


def _verify(threshold: float, depth: int, before: int | None):
    """Links among the classes of a task that share a prefix of `depth` in its tree; `before`: the depth whose pairs are known."""
    bound = Fraction(str(threshold))
    num, den = bound.numerator, bound.denominator

    def group(rows: dict[str, np.ndarray]) -> dict | None:
        """Links among the classes of one pair of blocks."""
        ids, side, copies, grams, size = (rows[k] for k in ("set_hash", "block", "copies", "grams", "n"))
        m, t = len(ids), int(rows["tree"][0])
        ptr = np.concatenate(([0], np.cumsum(size)))
        kinds, back, times = np.unique(grams, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(times > 1)  # the others can't be in an intersection
        place = np.full(len(kinds), -1, np.int64)
        place[shared] = np.arange(len(shared))
        column, row = place[back], np.repeat(np.arange(m), np.diff(ptr))
        row, column = row[column >= 0], column[column >= 0]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((m, m), np.float32)
        step = max(256, (1 << 22) // m)
        for c in range(0, len(shared), step):
            i, j = np.searchsorted(column, (c, c + step))
            a = np.zeros((m, min(step, len(shared) - c)), np.float32)
            a[row[i:j], column[i:j] - c] = 1
            both += a @ a.T
        meet = both.astype(np.int64)
        near = den * meet >= num * (size[:, None] + size[None, :] - meet)
        near &= ids[:, None] != ids[None, :]
        if rows["other"][0] != side[0]:  # two blocks: pairs inside one have a task of their own
            near &= side[:, None] != side[None, :]
        i, j = np.nonzero(near)
        first = np.ones(len(i), bool)
        seen = [_prefixes(rows["sig"][:, :t], depth)] if t else []
        if before:
            seen.append(_prefixes(rows["sig"], before))
        for prefix in seen:
            for s in range(0, len(i), 1 << 16):
                x, y = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                first[s : s + (1 << 16)] &= ~(prefix[x] == prefix[y]).any(axis=1)
        i_new, j_new = i[first], j[first]
        if not len(i):
            return None
        root = np.arange(m)
        while True:  # the smallest number that is reachable
            low = root.copy()
            np.minimum.at(low, i, root[j])
            low = low[low]
            if (low == root).all():
                break
            root = low
        docs = np.bincount(i_new, copies[j_new], minlength=m).astype(np.int64)
        keep = np.flatnonzero((docs > 0) | (root != np.arange(m)))
        x, y = i_new[i_new < j_new], j_new[i_new < j_new]
        likeness = meet[x, y] / (size[x] + size[y] - meet[x, y])
        counts = np.bincount(np.clip(((likeness - threshold) / (1 - threshold) * BINS + 1e-9).astype(np.int64), 0, BINS - 1), minlength=BINS)
        histogram = [None] * len(keep)
        histogram[0] = counts
        return {"set_hash": ids[keep], "root": ids[root[keep]], "linked": docs[keep], "counts": histogram}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[pa.RecordBatch] = []
        key = None

        def flush() -> Iterator[dict]:
            if sum(len(b) for b in held) > 1:
                x = pa.Table.from_batches(held).combine_chunks()
                get = lambda n: np.asarray(x[n].combine_chunks())
                flat = lambda n: np.asarray(x[n].combine_chunks().flatten())
                sig = np.frombuffer(b"".join(x["sig"].to_pylist()), np.uint16).reshape(len(x), TREES, DEPTH)
                made = group({n: get(n) for n in ("set_hash", "block", "other", "copies", "tree", "n")} | {"sig": sig, "grams": flat("grams")})
                if made:
                    yield made
            held.clear()

        for batch in batches:
            keys = np.asarray(batch.column(0))
            cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if b > a:
                    if keys[a] != key:
                        yield from flush()
                        key = keys[a]
                    held.append(batch.slice(a, b - a))
        yield from flush()

    return run


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: the smallest node of each component, by passing on the least label and jumping pointers.  edges: a, b."""
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    label = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    for _ in range(rounds):
        least = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        new = label.join(least, label["node"] == least["a"]).select("node", F.least("root", "m").alias("mid"), F.col("root").alias("was"))
        jump = new.select(F.col("node").alias("mid"), F.col("mid").alias("to"))
        new = materialise(new.join(jump, "mid").select("node", F.least("mid", "to").alias("root"), "was"))
        label = new.select("node", "root")
        if new.where("root <> was").isEmpty():
            break
    else:
        raise RuntimeError(f"components are not joined after {rounds} rounds")
    return label


def _groups(matched: DataFrame, depth: int, known: list[DataFrame]) -> DataFrame:
    """tree, prefix, blocks, content, m: the prefix groups of a depth that hold two classes or more; of those with the same content one, and none that is known."""
    at = matched.where(F.col("deep") >= depth).groupBy("tree", _prefix(depth).alias("prefix"))
    groups = at.agg(F.count("*").alias("m"), F.bit_xor("set_hash").alias("content"), F.sum("n").alias("volume")).where("m > 1")
    groups = groups.groupBy("content", "m").agg(F.min(F.struct("tree", "prefix", "volume")).alias("g")).select("g.*", "content", "m")
    for k in known:
        groups = groups.join(k, ["content", "m"], "left_anti")
    cut = F.greatest(F.ceil(F.col("volume") / BLOCK_SHINGLES), F.ceil(F.col("m") / BLOCK_CLASSES)).cast("int")
    return groups.select("tree", "prefix", cut.alias("blocks"), "content", "m")


def ngram_join(docs: DataFrame, threshold: float = 0.8, target: float = 0.9999) -> DataFrame:
    """doc_id, class_id, copy_id, n_links; text_hash and class_key (null without words) for rows that share ids or have none."""
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "xxhash64(cast(text as string)) text_hash")
    signed = materialise(signatures(docs))
    classes = materialise(
        signed.where("n > 0").groupBy("set_hash").agg(
            F.min("doc_id").alias("copy_id"),
            F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("one"),
            F.count("*").alias("copies"),
            F.first("n").alias("n"),
            F.first("sig").alias("sig"),
        ),
    )
    least = least_depth(threshold, target)
    matched = materialise(forest(classes, least))

    wanted = materialise(matched.select("set_hash").distinct().join(classes.select("set_hash", "one", "copies", "sig"), "set_hash"))
    # one text of each class
    side = wanted.select(F.col("one.doc_id").alias("one_id"), F.col("one.text_hash").alias("one_hash"), F.col("set_hash").alias("wanted"))
    texts = docs.join(side, docs["doc_id"].eqNullSafe(side["one_id"]) & (docs["text_hash"] == side["one_hash"]))

    def grams_of(block: TextBlock, _: pa.RecordBatch) -> dict:
        grams, ptr = _sets(block)
        return {"set_hash": _set_hash(grams, ptr), "n": np.diff(ptr), "grams": ragged(grams.view(np.int64), ptr)}

    grams = map_texts(texts, grams_of, "wanted long, set_hash long, n long, grams array<long>").where("set_hash = wanted").drop("wanted")
    facts = materialise(wanted.select("set_hash", "copies", "sig").join(grams.dropDuplicates(["set_hash"]), "set_hash"))

    found, parts, known = np.zeros(BINS, np.int64), [], []
    depth, before = DEPTH, None
    while True:
        groups = materialise(_groups(matched, depth, known))
        known.append(groups.select("content", "m"))
        placed = matched.where(F.col("deep") >= depth).select("set_hash", "tree", _prefix(depth).alias("prefix")).join(
            groups.select("tree", "prefix", "blocks"),
            ["tree", "prefix"],
        )
        placed = placed.withColumn("block", F.pmod(F.xxhash64("set_hash", F.lit(1)), F.col("blocks").cast("long")).cast("int"))
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        placed = placed.withColumn("task", F.xxhash64("tree", "prefix", F.least("block", "other"), F.greatest("block", "other")))
        tasks = placed.join(facts, "set_hash").select("task", "set_hash", "block", "other", "copies", "tree", "n", "sig", "grams")
        # a task's rows follow each other
        tasks = tasks.repartition("task").sortWithinPartitions("task", "set_hash")
        part = materialise(emit_rows(tasks, _verify(threshold, depth, before), "set_hash long, root long, linked long, counts array<long>"))
        parts.append(part)
        # BINS numbers reach the driver
        for r in part.where("counts IS NOT NULL").select(F.posexplode("counts").alias("bin", "n")).groupBy("bin").agg(F.sum("n").alias("n")).collect():
            found[r["bin"]] += r["n"]
        if depth == least or estimated_recall(found, threshold, depth, depth) >= target:
            break
        before, depth = depth, max((d for d in range(least, depth) if estimated_recall(found, threshold, depth, d) >= target), default=least)
    links = parts[0].drop("counts")
    for part in parts[1:]:
        links = links.unionByName(part.drop("counts"))

    linked = links.groupBy("set_hash").agg(F.sum("linked").alias("linked"))
    found = connected(
        links.where("set_hash <> root").select(F.col("set_hash").alias("a"), F.col("root").alias("b")).distinct(),
    ).select(F.col("node").alias("set_hash"), F.col("root").alias("class_key"))
    keyed = classes.select("set_hash", "copy_id", "copies").join(found, "set_hash", "left").withColumn("class_key", F.coalesce("class_key", "set_hash"))
    named = keyed.groupBy("class_key").agg(F.min("copy_id").alias("class_id"))
    per_class = materialise(
        keyed.join(named, "class_key").join(linked, "set_hash", "left").select(
            "set_hash",
            "class_key",
            "copy_id",
            "class_id",
            (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
        ),
    )
    # few distinct classes hold most documents: Spark splits the documents' side where it is skewed
    out = ["doc_id", "class_id", "copy_id", "n_links", "text_hash", "class_key"]
    with_words = signed.where("n > 0").select("doc_id", "text_hash", "set_hash").join(per_class, "set_hash").select(*out)
    without = signed.where("n = 0").select(
        "doc_id",
        F.col("doc_id").alias("class_id"),
        F.col("doc_id").alias("copy_id"),
        F.lit(0).cast("long").alias("n_links"),
        "text_hash",
        F.lit(None).cast("long").alias("class_key"),
    )
    return with_words.unionByName(without)


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_id", "n_links")


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (SELECT DISTINCT rid, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS m FROM sh a JOIN sh b ON a.g = b.g AND a.rid <> b.rid GROUP BY ALL),
l AS (SELECT x, y, m = nx.n AND m = ny.n AS same FROM p JOIN n nx ON nx.rid = x JOIN n ny ON ny.rid = y WHERE 5 * m >= 4 * (nx.n + ny.n - m)),
reach(rid, other) AS (SELECT rid, rid FROM w UNION SELECT r.rid, l.y FROM reach r JOIN l ON l.x = r.other),
class AS (SELECT r.rid, min(o.doc_id) AS class_id FROM reach r JOIN w o ON o.rid = r.other GROUP BY r.rid),
copy AS (SELECT x AS rid, min(o.doc_id) AS low FROM l JOIN w o ON o.rid = y WHERE same GROUP BY x),
cnt AS (SELECT x AS rid, count(*) AS n_links FROM l GROUP BY x)
SELECT doc_id, class_id, least(doc_id, coalesce(low, doc_id)) AS copy_id, coalesce(n_links, 0) AS n_links
FROM w JOIN class USING (rid) LEFT JOIN copy USING (rid) LEFT JOIN cnt USING (rid)
"""
