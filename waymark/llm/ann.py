"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample of vectors and has about four times the root of the table's size in leaves; what
the sample is too small to split is split further by a k-means for each leaf, on the executors. Every vector is then sent
to its leaf. A query keeps a priority queue of branches ordered by how near their centres are and visits leaves in that
order. How many leaves are visited is calibrated: the number is raised until the wanted recall against brute force is
reached on sampled queries.

Leaves that follow each other in the tree form regions of a bounded number of points. A region's points are held by one
task, past which the queries that visit it are streamed, each with the leaves that it visits there.

Equal vectors are one point with a list of its smallest ids (no more than a query can need), so that a vector which
is repeated very often stays one row of its leaf.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


@dataclass
class Tree:
    """Inner nodes have ``children``; leaves have a number. Vectors get one more component, which makes inner-product order distance order."""

    radius: float
    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.radius**2 - np.einsum("ij,ij->i", x, x), 0)
        return np.hstack([x, np.sqrt(rest)[:, None]])

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        x, out = self.lifted(x), np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            near = nearest_centre(x[rows], self.centres[node])
            todo += [(c, rows[near == k]) for k, c in enumerate(self.children[node]) if (near == k).any()]
        return out

    def visit(self, query: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        q = np.append(query, 0.0)
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            while self.children[node]:
                far = ((self.centres[node] - q) ** 2).sum(1)
                best = int(far.argmin())
                for k, c in enumerate(self.children[node]):
                    if k != best:
                        heapq.heappush(queue, (float(far[k]), c))
                node = self.children[node][best]
            yield self.leaf[node]

    def split(self, centres: dict[int, np.ndarray]) -> Tree:
        """The tree with new leaves around the given centres in place of some leaves; leaves are numbered in the tree's order."""
        out = Tree(self.radius)

        def grow(node: int) -> int:
            here = len(out.centres)
            out.centres.append(self.centres[node])
            out.children.append([])
            out.leaf.append(-1)
            below = self.children[node]
            if below:
                out.children[here] = [grow(c) for c in below]
            elif (own := centres.get(self.leaf[node])) is not None and len(own) > 1:
                out.centres[here] = own
                for _ in own:
                    out.children[here].append(len(out.centres))
                    out.centres.append(np.zeros((0, own.shape[1])))
                    out.children.append([])
                    out.leaf.append(out.leaves)
                    out.leaves += 1
            else:
                out.leaf[here] = out.leaves
                out.leaves += 1
            return here

        grow(0)
        return out


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = nearest_centre(x, centres)
        for j in range(k):
            if (own := x[near == j]).size:
                centres[j] = own.mean(0)
    return centres


def fit_tree(sample: np.ndarray, radius: float, leaf_size: int, branching: int = 16, seed: int = 5) -> Tree:
    """Splits the sample by k-means until a part has at most ``leaf_size`` vectors or no two different ones."""
    tree, rng = Tree(radius), np.random.default_rng(seed)
    x = tree.lifted(sample) if len(sample) else np.zeros((0, 1))

    def grow(rows: np.ndarray) -> int:
        node = len(tree.centres)
        tree.centres.append(np.zeros((0, x.shape[1])))
        tree.children.append([])
        tree.leaf.append(-1)
        if len(rows) > leaf_size:
            centres = k_means(x[rows], min(branching, len(rows)), rng)
            near = nearest_centre(x[rows], centres)
            kept = [j for j in range(len(centres)) if (near == j).any()]
            if len(kept) > 1:
                tree.centres[node] = centres[kept]
                tree.children[node] = [grow(rows[near == j]) for j in kept]
                return node
        tree.leaf[node] = tree.leaves
        tree.leaves += 1
        return node

    grow(np.arange(len(x)))
    return tree


def split_leaves(points: DataFrame, tree: Broadcast, parts: int) -> dict[int, np.ndarray]:
    """Centres of about ``parts`` new leaves for each leaf, from at most ``32 * parts`` of its points; all centres are as many as leaves."""
    low = points.withColumn("h", F.xxhash64("embedding"))
    order = Window.partitionBy("leaf").orderBy("h", "embedding")
    some = low.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= 32 * parts)

    def fit(own: pd.DataFrame) -> pd.DataFrame:
        x = tree.value.lifted(np.stack(own.embedding.to_numpy()).astype(np.float64))
        centres = k_means(x, max(1, min(parts, len(x) // 8)), np.random.default_rng(5))
        return pd.DataFrame({"leaf": int(own.leaf.iloc[0]), "centre": list(centres.astype(np.float32))})

    rows = some.groupBy("leaf").applyInPandas(fit, "leaf int, centre array<float>").collect()
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r.leaf, []).append(r.centre)
    return {leaf: np.array(own, np.float64) for leaf, own in out.items()}


def usable(c: Column) -> Column:
    """Not null, not empty, not all zero, with finite components only."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return c.isNotNull() & (F.size(c) > 0) & ~F.exists(c, bad) & F.exists(c, lambda v: v != 0)


def brute_force(points: DataFrame, queries: np.ndarray, k: int) -> list[np.ndarray]:
    """For some queries, the point numbers of the k nearest of all points; used to calibrate."""

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b.embedding.to_numpy()).astype(np.float64)
            s = queries @ x.T
            top = np.argsort(-s, 1, kind="stable")[:, :k]
            q = np.repeat(np.arange(len(queries)), top.shape[1])
            yield pd.DataFrame({"q": q, "leaf": b.leaf.to_numpy()[top.ravel()], "s": s[q, top.ravel()]})

    near = points.mapInPandas(best, "q long, leaf int, s double")
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s")))).filter(F.col("r") <= k)
    found = ranked.select("q", "leaf").toPandas()
    return [found.leaf[found.q == i].to_numpy() for i in range(len(queries))]


def best_of(queries: pd.DataFrame, x: np.ndarray, flat: np.ndarray, owner: np.ndarray, spans: dict[int, slice], k: int) -> pd.DataFrame:
    """The k nearest to each query among the points ``x`` of the leaves that it visits; ``flat`` are the points' ids and ``owner`` their points."""
    q = np.stack(queries.embedding.to_numpy()).astype(np.float64)
    by_leaf: dict[int, list[int]] = {}
    for i, leaves in enumerate(queries.leaves):
        for leaf in leaves:
            by_leaf.setdefault(leaf, []).append(i)
    scores = np.full((len(q), len(x)), -np.inf)
    for leaf, rows in by_leaf.items():
        if leaf in spans:
            scores[np.array(rows), spans[leaf]] = q[rows] @ x[spans[leaf]].T
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for own, near in zip(queries.id.to_numpy(), scores, strict=True):
        least = np.partition(near, len(near) - k - 1)[len(near) - k - 1] if len(near) > k + 1 else -np.inf
        mask = (near[owner] >= least) & (near[owner] > -np.inf) & (flat != own)
        s, v = near[owner[mask]], flat[mask]
        best = np.lexsort((v, -s))[:k]
        out.append((np.full(len(best), own), v[best], s[best]))
    ids, found, s = map(np.concatenate, zip(*out, strict=True))
    return pd.DataFrame({"query_id": ids, "vec_id": found, "score": s})


def nearest_neighbours(vectors: DataFrame, queries: Column, k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.97, sample_rows: int = 20_000, calibrate: int = 100, region_rows: int = 4096, most_leaves: int = 1 << 16) -> DataFrame:
    """The ``k`` rows with the largest inner product for each row that ``queries`` selects, without the row itself.

    Returns ``query_id``, ``rank`` from 1, ``vec_id`` and ``score`` (in double precision on the vectors as given),
    nearest first and ties to the smaller id. A query has fewer rows only where there are fewer candidates. Rows whose
    id is null, or whose vector is null, empty, all zero, not finite, or of another length than most, take no part. Of
    rows with one id and one vector, one counts. Columns other than the two named are not read. An empty table gives an
    empty result.

    The tree is fitted on about ``sample_rows`` points, has at most about ``most_leaves`` leaves, and is calibrated on at most
    ``calibrate`` queries against all points. A region has at most about ``region_rows`` points.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), queries.alias("is_query")).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if common is None:
        return empty
    # the k + 1 smallest ids of equal vectors are all that any query's answer can hold
    order = Window.partitionBy("embedding").orderBy("vec_id")
    ids = rows.filter(F.size("embedding") == common.n).select("vec_id", "embedding").distinct().withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    points = written(ids.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "ann-points")
    asked = rows.filter(F.col("is_query") & (F.size("embedding") == common.n)).select(F.col("vec_id").alias("query_id"), "embedding").distinct()
    size = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))).alias("r")).first()

    share = min(1.0, sample_rows / size.n)
    sample = points.filter(F.pmod(F.xxhash64("embedding"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("embedding").toPandas().embedding
    wanted = min(most_leaves, int(4 * np.sqrt(size.n)))
    at_first = max(1, min(wanted, len(sample) // 16))
    fitted = fit_tree(np.stack(sample.to_numpy()).astype(np.float64), float(np.sqrt(size.r)), -(-len(sample) // at_first)) if len(sample) else Tree(0.0, [np.zeros((0, 1))], [[]], [0], 1)

    def placed_by(tree: Broadcast) -> DataFrame:
        def leaves(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for b in batches:
                yield pd.Series(tree.value.leaf_of(np.stack(b.to_numpy()).astype(np.float64)) if len(b) else [], dtype="int32")

        return written(points.withColumn("leaf", F.pandas_udf(leaves, "int")(F.col("embedding"))), "ann-index")

    tree = spark.sparkContext.broadcast(fitted)
    placed = placed_by(tree)
    if wanted > 2 * fitted.leaves and len(sample) < size.n:
        tree = spark.sparkContext.broadcast(fitted.split(split_leaves(placed, tree, -(-wanted // fitted.leaves))))
        placed = placed_by(tree)
    some = asked.orderBy(F.xxhash64("query_id"), "query_id").limit(calibrate).toPandas().embedding
    if not len(some):
        return empty
    trial = np.stack(some.to_numpy()).astype(np.float64)
    places = []
    for q, near in zip(trial, brute_force(placed, trial, k), strict=True):
        at = {leaf: i for i, leaf in enumerate(tree.value.visit(q))}
        places += [at[x] for x in near]
    # as many visits as the wanted share of all neighbours found takes
    visits = 1 + int(np.sort(places)[max(0, int(np.ceil(recall * len(places))) - 1)])

    counts = {r.leaf: r["count"] for r in placed.groupBy("leaf").count().collect()}  # one row per leaf
    regions, n_regions, filled = {}, 0, region_rows
    for leaf in sorted(counts):
        if filled + counts[leaf] > region_rows:
            n_regions, filled = n_regions + 1, 0
        pieces = -(-counts[leaf] // region_rows)
        regions[leaf] = (n_regions - 1, pieces)  # a larger leaf is dealt out to regions of its own
        n_regions, filled = n_regions + pieces - 1, filled + counts[leaf]
    shared = spark.sparkContext.broadcast((regions, counts))
    vector = points.schema["embedding"].dataType.simpleString()
    schema = f"region int, kind int, leaf int, id long, ids array<long>, leaves array<int>, embedding {vector}"
    columns = [c.split()[0] for c in schema.split(", ")]

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, _ = shared.value
        for b in batches:
            first, pieces = (np.array([where[x][j] for x in b.leaf], np.int64) for j in (0, 1))
            spread = np.array([crc32(x.tobytes()) for x in b.ids.map(np.asarray)], np.int64) if len(b) and pieces.max() > 1 else 0
            yield b.assign(region=first + spread % np.maximum(pieces, 1), kind=0, id=0, leaves=None)[columns]

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, counts = shared.value
        for b in batches:
            out, rows = [], []
            for i, x in enumerate(b.embedding):
                got, visited = 0, {}
                for nth, leaf in enumerate(tree.value.visit(np.asarray(x, np.float64))):
                    if nth >= visits and got > k:  # never fewer than k where there are as many
                        break
                    got += counts.get(leaf, 0)
                    first, pieces = where.get(leaf, (0, 0))
                    for p in range(pieces):
                        visited.setdefault(first + p, []).append(leaf)
                rows += [i] * len(visited)
                out += visited.items()
                if len(out) > 2000 or i == len(b) - 1:
                    own = b.iloc[rows]
                    yield pd.DataFrame({"region": [r for r, _ in out], "kind": 1, "leaf": -1, "id": own.query_id.to_numpy(), "ids": None, "leaves": [v for _, v in out], "embedding": own.embedding.to_numpy()})
                    out, rows = [], []

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come by region: its points, by leaf, and then its queries."""
        now, held, ready = None, [], None
        for b in batches:
            cuts = np.flatnonzero(np.r_[True, (b.region.to_numpy()[1:] != b.region.to_numpy()[:-1]) | (b.kind.to_numpy()[1:] != b.kind.to_numpy()[:-1])]) if len(b) else []
            for at, to in zip(cuts, np.append(cuts[1:], len(b)), strict=True):
                own = b.iloc[at:to]
                if now != own.region.iloc[0]:
                    now, held, ready = own.region.iloc[0], [], None
                if own.kind.iloc[0] == 0:
                    held.append(own)
                    continue
                if not held:
                    continue
                if ready is None:
                    there = pd.concat(held)
                    ids = there.ids.map(len).to_numpy()
                    leaf = there.leaf.to_numpy()
                    first = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
                    spans = {leaf[i]: slice(i, j) for i, j in zip(first, np.append(first[1:], len(leaf)), strict=True)}
                    ready = np.stack(there.embedding.to_numpy()).astype(np.float64), np.concatenate(there.ids.to_numpy()).astype(np.int64), np.repeat(np.arange(len(there)), ids), spans
                for i in range(0, len(own), 256):
                    yield best_of(own.iloc[i : i + 256], *ready, k)

    # few bytes but much work: dealt by number, which isn't coalesced
    dealt = asked.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "query_id")
    both = placed.mapInPandas(index, schema).unionByName(dealt.mapInPandas(plan, schema))
    by_region = both.repartition("region").sortWithinPartitions("region", "kind", "leaf")
    near = by_region.mapInPandas(search, "query_id long, vec_id long, score double")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
