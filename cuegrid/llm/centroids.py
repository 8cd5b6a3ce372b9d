"""Clustering of vectors to centroids (Lloyd's rounds) with Yinyang's bounds.

The centroids are cut once into groups of near ones.  A vector keeps its cluster, an
upper bound of the distance to its centroid and, for each group, a lower bound of the
distance to the group's other centroids.  A round widens the bounds by what the
centroids moved; a vector whose upper bound is below all its lower bounds keeps its
cluster (the global filter, tried again with the exact distance), else only the groups
whose bound is not above are scanned (the group filter), every centroid of them exactly.

Components are integers, so distances and means are exact and results are the same at
any partitioning; bounds are square roots and are only trusted beyond a margin, so ties
are always scanned.  Each round is one pass that writes the vectors with their new
bounds and, beside them, each task's sums for every cluster; the driver sees the added
sums alone: clusters times components, at most.

Defined results: vectors with another number of components, or with null or non-finite
ones, and null vectors are left out; a null id is a vector like others and counts as the
empty text where seeds are chosen; repeated rows are vectors each, equal vectors with one
id tie and each may be a seed; fewer vectors than clusters give as many clusters as
vectors; an empty table gives no rows; other columns are ignored.  A component of 2^27 or
more (after scaling) is an error, as distances would not fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuegrid.llm.stages import gather, materialise, ragged, release, schema_of, table

LARGEST = 1 << 27
MARGIN = 1e-9


def kept_vectors(vectors: DataFrame, dim: int, scale: int, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and v, the scaled components as integers, of the vectors that count."""
    x = F.col("x")
    sound = (F.size("x") == dim) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform("x", lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
    rows = vectors.select(F.col(id_).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x")).where(x.isNotNull() & sound)
    return rows.select("vec_id", whole.alias("v"))


def seeds(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids hash lowest; k rows reach the driver."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in first], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to centroids."""
    top = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if top >= LARGEST:
        raise OverflowError(f"a component of {top} is too large for distances in 64 bits")
    if float(top) ** 2 * x.shape[1] < 2.0**51:  # products and their sums are whole numbers that doubles hold
        cross = (x.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
        return (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * cross
    return np.stack([((x - y) ** 2).sum(1) for y in c], 1)


def group_centroids(centroids: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """The group of each centroid: a few rounds of the same clustering among the centroids themselves."""
    groups = max(1, min(groups, len(centroids)))
    middle = centroids[np.linspace(0, len(centroids) - 1, groups).astype(int)].astype(np.float64)
    of = np.zeros(len(centroids), np.int64)
    for _ in range(rounds):
        of = ((centroids[:, None, :] - middle[None]) ** 2).sum(2).argmin(1)
        for g in np.unique(of):
            middle[g] = centroids[of == g].mean(0)
    return np.unique(of, return_inverse=True)[1]  # groups without centroids are left out


class Yinyang:
    """One round's centroids, their groups and how far they moved since the bounds were made."""

    def __init__(self, centroids: np.ndarray, group: np.ndarray, moved: np.ndarray):
        self.centroids, self.group, self.n_groups = centroids, group, int(group.max()) + 1
        self.moved = moved
        self.group_moved = np.array([moved[group == g].max() for g in range(self.n_groups)])
        self.members = [np.flatnonzero(group == g) for g in range(self.n_groups)]
        self.scanned = 0  # distances found, for tests

    def own(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        """Exact squared distance of each row to its own centroid."""
        if max(np.abs(x).max(initial=0), np.abs(self.centroids).max(initial=0)) >= LARGEST:
            raise OverflowError("a component is too large for distances in 64 bits")
        return ((x - self.centroids[cluster]) ** 2).sum(1)

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Clusters, upper and lower bounds without earlier ones."""
        d = squared(x, self.centroids)
        self.scanned += d.size
        cluster = d.argmin(1)  # the smaller number of equal ones
        rows = np.arange(len(x))
        upper = np.sqrt(d[rows, cluster])
        rest = d.astype(np.float64)
        rest[rows, cluster] = np.inf
        return cluster, upper, np.sqrt(np.stack([rest[:, m].min(1) for m in self.members], 1))

    def again(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same from the bounds of the round before."""
        cluster = cluster.copy()
        upper = upper + self.moved[cluster]
        lower = lower - self.group_moved
        safe = lambda u, low: u * (1 + MARGIN) + MARGIN < low * (1 - MARGIN)
        todo = np.flatnonzero(~safe(upper, lower.min(1)))
        if not len(todo):
            return cluster, upper, lower
        exact = self.own(x[todo], cluster[todo])
        self.scanned += len(todo)
        upper[todo] = np.sqrt(exact)
        still = ~safe(upper[todo], lower[todo].min(1))
        todo, exact = todo[still], exact[still]
        if not len(todo):
            return cluster, upper, lower
        old, rows = cluster[todo], np.arange(len(todo))
        known = np.full((len(todo), len(self.centroids)), np.iinfo(np.int64).max)
        known[rows, old] = exact
        open_ = ~safe(upper[todo][:, None], lower[todo])
        for g, members in enumerate(self.members):
            hit = np.flatnonzero(open_[:, g])
            if len(hit):
                known[np.ix_(hit, members)] = squared(x[todo[hit]], self.centroids[members])
                self.scanned += len(hit) * len(members)
        best = known.argmin(1)  # the smaller number of equal ones; what wasn't scanned is farther
        cluster[todo], upper[todo] = best, np.sqrt(known[rows, best])
        others = known.astype(np.float64)
        others[rows, best] = np.inf
        others[others >= 2.0**62] = np.inf
        found = np.sqrt(np.stack([others[:, m].min(1) for m in self.members], 1))
        # a group left unscanned has its bound, or the centroid that the vector has just left
        lower[todo] = np.where(open_, found, np.minimum(lower[todo], found))
        return cluster, upper, lower


def _round(state: DataFrame, round_: Yinyang, known: bool, last: bool) -> DataFrame:
    """The vectors with their new clusters and bounds (sums = false); and for each task and cluster the number of vectors, the sum of their distances and their sum, in v (sums = true)."""
    kind, arrow = schema_of("vec_id long, v array<long>, cluster int, upper double, lower array<double>, distance long, n long, sums boolean")
    k, groups = len(round_.centroids), round_.n_groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = round_.centroids.shape[1]
        n, total, added = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            if known:
                lower = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, groups)
                cluster, upper, lower = round_.again(x, batch.column(2).to_numpy(), batch.column(3).to_numpy(), lower)
            else:
                cluster, upper, lower = round_.first(x)
            distance = round_.own(x, cluster) if last else np.zeros(len(x), np.int64)
            n += np.bincount(cluster, minlength=k)
            np.add.at(total, cluster, distance)
            np.add.at(added, cluster, x)
            size = np.arange(len(x) + 1)
            none = pa.nulls(len(x), pa.int64())
            made = [batch.column(0), ragged(x.ravel(), size * dim), pa.array(cluster, pa.int32()), pa.array(upper), ragged(lower.ravel(), size * groups), pa.array(distance)]
            yield pa.RecordBatch.from_arrays([*made, none, pa.array(np.zeros(len(x), bool))], schema=arrow)
        if n.any():
            at = np.flatnonzero(n)
            made = [pa.nulls(len(at), pa.int64()), ragged(added[at].ravel(), np.arange(len(at) + 1) * dim), pa.array(at, pa.int32()), pa.nulls(len(at), pa.float64())]
            made += [pa.nulls(len(at), arrow.field("lower").type), pa.array(total[at]), pa.array(n[at]), pa.array(np.ones(len(at), bool))]
            yield pa.RecordBatch.from_arrays(made, schema=arrow)

    return state.mapInArrow(run, kind)


def yinyang(
    vectors: DataFrame,
    dim: int = 64,
    k: int = 8,
    rounds: int = 10,
    seed: int = 3,
    scale: int = 1024,
    groups: int | None = None,
) -> DataFrame:
    """vec_id, cluster, distance (squared), centroid (the cluster's final components), n and cluster_inertia of the cluster, and inertia.  groups: a tenth of the clusters, two at least, unless given."""
    spark = vectors.sparkSession
    kept = materialise(kept_vectors(vectors, dim, scale))
    centroids = seeds(kept, k, seed)
    clusters = "cluster int, centroid array<long>, n long, cluster_inertia long, inertia long"
    if not len(centroids):
        return kept.selectExpr("vec_id").limit(0).crossJoin(spark.createDataFrame([], clusters))
    group = group_centroids(centroids, groups or max(2, k // 10))
    state, moved = kept.selectExpr("vec_id", "v", "0 cluster", "0D upper", "array(0D) lower"), np.zeros(len(centroids))
    before = kept
    for r in range(rounds + 1):
        last = r == rounds
        at = materialise(_round(state, Yinyang(centroids, group, moved), known=r > 0, last=last), by="sums")
        release(before)
        before, sums = at, at.where("sums")
        state = at.where("NOT sums").select("vec_id", "v", "cluster", "upper", "lower")
        if not last:
            added = gather(
                sums.select("cluster", "n", F.posexplode("v").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")),
            )  # clusters times components
            new = centroids.copy()
            c, i = added["cluster"].to_numpy(), added["at"].to_numpy()
            new[c, i] = np.floor_divide(added["x"].to_numpy(), added["n"].to_numpy())
            moved = np.sqrt(((new - centroids).astype(np.float64) ** 2).sum(1)) * (1 + MARGIN)
            centroids = new
    by_cluster = gather(sums.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("distance").alias("d")))
    found = dict(zip(by_cluster["cluster"].to_pylist(), zip(by_cluster["n"].to_pylist(), by_cluster["d"].to_pylist())))
    whole = sum(d for _, d in found.values())
    rows = [(c, centroids[c].tolist(), *found[c], whole) for c in sorted(found)]
    ends = spark.createDataFrame(rows, clusters).coalesce(1)  # a row for each cluster
    return at.where("NOT sums").select("vec_id", "cluster", "distance").join(F.broadcast(ends), "cluster")


def digest(centroid: str) -> Column:
    """sha256 of the components as decimal integers, joined by commas."""
    return F.sha2(F.array_join(F.col(centroid).cast("array<string>"), ","), 256)


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    found = yinyang(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest("centroid").alias("centroid_sha256"))


def _op12_sql(dim: int = 64, k: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024) -> str:
    """Each round as two tables: every vector's nearest centroid, and the centroids that follow."""
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, v FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS v, embedding AS e FROM embeddings
    WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}))""",
        f"""c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS cluster, v AS c FROM (
    SELECT sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT {k}))""",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (
  SELECT vec_id, v, n.cluster, n.d FROM (
    SELECT vec_id, v, (SELECT min({{'d': CAST(list_sum(list_transform(list_zip(kept.v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), 'cluster': cluster}}) FROM c{r}) AS n
    FROM kept))""",
        )
        if r < rounds:
            steps.append(
                f"""c{r + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(m, c) AS c FROM c{r} LEFT JOIN (
    SELECT cluster, list(x ORDER BY i) AS m FROM (
      SELECT cluster, i, CAST((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
      FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY cluster, i) GROUP BY cluster) USING (cluster))""",
            )
    return f"""WITH {", ".join(steps)}
SELECT vec_id, cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""


OP12_SQL = _op12_sql()
