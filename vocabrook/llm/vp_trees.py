"""Nearest neighbours by vantage-point trees, one for each shard, pruned by the triangle inequality.

A subtree whose distance from the query is at least b can be left out when relax * b is more than the
distance of the k-th neighbour found so far. relax = 1 gives exact search; larger factors prune more.
Distances are Euclidean, in double precision, of the vectors as given; ties go to the smaller vec_id.

1. Shards: vectors go to the nearest of at most PIVOTS pivots (those vectors with the smallest hashes of vec_id), and a
   pivot's vectors to parts of about SHARD_ROWS by a hash, so a shard is bounded, and so are copies of one vector.
2. Each shard's tree is built once and kept as a row of a table in the shared folder.
3. A query first asks a shard of its own nearest pivot. Its k-th distance there is a bound for the others: pivots whose
   ring of distances lies beyond the bound are skipped with all their shards, and trees are searched from that bound on.
   Queries meet a tree in blocks of about QUERY_ROWS. Leaves are screened by one matrix product; what it can't exclude
   is measured exactly.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, nor do rows
with a null vec_id; vectors are only compared with those of equal length; a query with fewer than k
candidates gets all of them; repeated candidate rows are candidates each, a repeated query is asked once; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, settle

SHARD_ROWS = 16384
QUERY_ROWS = 4096
PIVOTS = 256
LEAF = 256
K = 10
RELAX = 1.0
#: Distances are rounded in the last places; a bound has to be clear of that.
SLACK = 1e-9


def distances(points: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """(queries, points) distances; components are added in order, so equal inputs give equal results anywhere."""
    total = np.zeros((len(queries), len(points)))
    for j in range(points.shape[1]):
        d = points[None, :, j] - queries[:, None, j]
        total += d * d
    return np.sqrt(total)


def paired(points: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """distances() of rows side by side."""
    total = np.zeros(len(points))
    for j in range(points.shape[1]):
        d = points[:, j] - queries[:, j]
        total += d * d
    return np.sqrt(total)


class Tree:
    """nodes: first and last point, vantage point (-1: a leaf), inner child, outer child; radius of each. Points lie in leaf order."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, nodes: np.ndarray, radius: np.ndarray):
        self.ids, self.points, self.nodes, self.radius = ids, points, nodes, radius
        self.square = (points * points).sum(axis=1)

    @classmethod
    def build(cls, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF, seed: int = 7) -> Tree:
        order = np.argsort(ids, kind="stable")
        nodes, radius = [], []
        rng, todo = np.random.default_rng(seed), [(0, len(ids), -1, 0)] if len(ids) else []
        while todo:
            a, z, parent, side = todo.pop()
            me = len(nodes)
            if parent >= 0:
                nodes[parent][side] = me
            nodes.append([a, z, -1, -1, -1])
            radius.append(0.0)
            if z - a <= leaf:
                continue
            # of a few candidates, the one whose distances to a sample spread most
            tries, some = a + rng.choice(z - a, min(5, z - a), replace=False), a + rng.choice(z - a, min(64, z - a), replace=False)
            at = tries[np.argmax(distances(points[order[some]], points[order[tries]]).std(axis=1))]
            order[[a, at]] = order[[at, a]]
            d = distances(points[order[a + 1 : z]], points[order[a : a + 1]])[0]
            mu = float(np.median(d))
            inner = d <= mu
            if inner.all():  # many equal distances can't be halved: one leaf
                continue
            order[a + 1 : z] = np.concatenate([order[a + 1 : z][inner], order[a + 1 : z][~inner]])
            nodes[me][2], radius[me] = a, mu
            cut = a + 1 + int(inner.sum())
            todo += [(a + 1, cut, me, 3), (cut, z, me, 4)]
        return cls(ids[order], points[order], np.array(nodes, np.int32).reshape(-1, 5), np.array(radius))

    def packed(self) -> tuple[bytes, bytes, bytes, bytes]:
        return tuple(x.astype(t).tobytes() for x, t in ((self.ids, "<i8"), (self.points, "<f8"), (self.nodes, "<i4"), (self.radius, "<f8")))

    @classmethod
    def unpacked(cls, ids: bytes, points: bytes, nodes: bytes, radius: bytes) -> Tree:
        ids = np.frombuffer(ids, "<i8")
        return cls(ids, np.frombuffer(points, "<f8").reshape(len(ids), -1), np.frombuffer(nodes, "<i4").reshape(-1, 5), np.frombuffer(radius, "<f8"))

    def search(self, qids: np.ndarray, queries: np.ndarray, k: int = K, relax: float = RELAX, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest to each query within bound, other than its own id; inf where there are fewer."""
        n = len(queries)
        best_d, best_i = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)
        limit = np.full(n, np.inf) if bound is None else bound.astype(np.float64).copy()
        square = (queries * queries).sum(axis=1)
        # a query never loses a neighbour to its own row, nor a tie to a larger id

        def offer(active: np.ndarray, a: int, z: int) -> None:
            rough = square[active][:, None] + self.square[None, a:z] - 2 * queries[active] @ self.points[a:z].T
            slack = SLACK * (square[active][:, None] + self.square[None, a:z])
            q, p = np.nonzero((rough - slack <= (limit[active] ** 2)[:, None]) & (self.ids[a:z][None, :] != qids[active][:, None]))
            if not len(q):
                return
            d = paired(self.points[a + p], queries[active[q]])
            near = d <= limit[active[q]]
            q, p, d = q[near], p[near], d[near]
            if not len(q):
                return
            met, row = np.unique(q, return_inverse=True)
            start = np.concatenate([[0], np.cumsum(np.bincount(row))])
            all_d = np.full((len(met), k + int(np.diff(start).max())), np.inf)
            all_i = np.full(all_d.shape, np.iinfo(np.int64).max)
            all_d[:, :k], all_i[:, :k] = best_d[active[met]], best_i[active[met]]
            column = k + np.arange(len(q)) - start[row]  # np.nonzero lists pairs by query
            all_d[row, column], all_i[row, column] = d, self.ids[a + p]
            order = np.lexsort((all_i, all_d), axis=1)[:, :k]
            own = active[met]
            best_d[own], best_i[own] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_i, order, 1)
            limit[own] = np.minimum(limit[own], best_d[own, -1])

        todo = [(0, np.arange(n), np.zeros(n))] if len(self.ids) else []
        while todo:
            node, active, least = todo.pop()
            active = active[relax * least * (1 - SLACK) - SLACK <= limit[active]]
            if not len(active):
                continue
            a, z, at, inner, outer = self.nodes[node].tolist()
            if at < 0:
                offer(active, a, z)
                continue
            mu = self.radius[node]
            d = distances(self.points[at : at + 1], queries[active])[:, 0]
            offer(active, at, at + 1)
            within = d <= mu
            todo.append((outer, active[within], mu - d[within]))
            todo.append((inner, active[~within], d[~within] - mu))
            todo.append((inner, active[within], np.zeros(within.sum())))
            todo.append((outer, active[~within], np.zeros((~within).sum())))
        return best_i, best_d


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of double), dim of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0.0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).withColumn("dim", F.size("v"))


def _cells(pivots: dict[int, np.ndarray]):
    """Number of and distance from the nearest pivot of equal length."""

    def run(batches):
        for pdf in batches:
            cell, away = np.zeros(len(pdf), np.int32), np.zeros(len(pdf))
            for dim in pdf["dim"].unique():
                rows = np.flatnonzero((pdf["dim"] == dim).to_numpy())
                d = distances(pivots[dim], np.stack(pdf["v"].to_numpy()[rows]))
                cell[rows], away[rows] = d.argmin(axis=1), d.min(axis=1)
            yield pdf.assign(cell=cell, away=away)

    return run


_PLACED = "vec_id long, v array<double>, dim int, cell int, away double"
_TREE = "dim int, cell int, part int, ids binary, points binary, nodes binary, radius binary"
_FOUND = "query_id long, vec_id long, score double"


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    tree = Tree.build(pdf["vec_id"].to_numpy(np.int64), np.stack(pdf["v"].to_numpy()).astype(np.float64))
    return pd.DataFrame([(pdf["dim"].iat[0], pdf["cell"].iat[0], pdf["part"].iat[0], *tree.packed())], columns=["dim", "cell", "part", "ids", "points", "nodes", "radius"])


def _ask(k: int, relax: float):
    def run(trees: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(trees) or not len(asked):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        t = trees.iloc[0]
        tree, qids = Tree.unpacked(t["ids"], t["points"], t["nodes"], t["radius"]), asked["vec_id"].to_numpy(np.int64)
        ids, d = tree.search(qids, np.stack(asked["v"].to_numpy()).astype(np.float64), k, relax, asked["bound"].to_numpy(np.float64))
        found = np.isfinite(d)
        return pd.DataFrame({"query_id": np.repeat(qids, found.sum(axis=1)), "vec_id": ids[found], "score": d[found]})

    return run


def _searched(trees: DataFrame, asked: DataFrame, k: int, relax: float, query_rows: int) -> DataFrame:
    """asked(vec_id, v, bound, dim, cell, part) of each tree, in blocks: query_id, vec_id, score."""
    key = ["dim", "cell", "part"]
    blocks = asked.groupBy(*key).agg(F.ceil(F.count("*") / query_rows).cast("int").alias("blocks"))
    spread = trees.join(blocks, key).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    dealt = asked.join(blocks, key).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).drop("blocks")
    return spread.groupBy(*key, "block").cogroup(dealt.groupBy(*key, "block")).applyInPandas(_ask(k, relax), _FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, relax: float = RELAX, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(vec_id, embedding) twice -> query_id, rank, vec_id, score: each query's k nearest of vectors but itself."""
    vectors, queries = usable(vectors), usable(queries).dropDuplicates(["vec_id"])
    sizes = {r["dim"]: r["n"] for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).toLocalIterator()}
    pivots: dict[int, np.ndarray] = {}
    for dim, n in sizes.items():
        some = vectors.filter(F.col("dim") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(PIVOTS, max(1, -(-n // shard_rows))))
        pivots[dim] = np.array([r["v"] for r in some.select("v").collect()])  # at most PIVOTS
    if not pivots:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    placed = settle(vectors.mapInPandas(_cells(pivots), _PLACED), "placed")
    rings = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts"), F.min("away").alias("near"), F.max("away").alias("far"))
    rings = F.broadcast(settle(rings, "rings"))  # a row a pivot: at most PIVOTS of each length
    shards = placed.join(rings, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    trees = settle(shards.groupBy("dim", "cell", "part").applyInPandas(_build, _TREE), "trees")
    asked = queries.filter(F.col("dim").isin(*pivots)).mapInPandas(_cells(pivots), _PLACED)
    home = asked.join(rings, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    home = settle(home.select("vec_id", "v", "dim", "cell", "part", F.lit(float("inf")).alias("bound")), "home")
    first = settle(_searched(trees, home, k, relax, query_rows), "first")
    bounds = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.max("score").alias("score"), F.count("*").alias("n"))
    bound = F.when(F.col("n") >= k, F.col("score")).otherwise(float("inf"))
    known = home.select("vec_id", "v", "dim", F.col("cell").alias("home"), F.col("part").alias("home_part")).join(bounds, "vec_id", "left").withColumn("bound", bound).drop("n", "score")

    def rings_met(batches):
        for pdf in batches:
            out = []
            for dim in pdf["dim"].unique():
                rows = pdf[pdf["dim"] == dim]
                d = distances(pivots[dim], np.stack(rows["v"].to_numpy()))
                q, c = np.nonzero(np.ones(d.shape, bool))
                out.append(rows.iloc[q].assign(cell=c.astype(np.int32), away=d[q, c]))
            yield from out

    # pivots are few, so a query's rows here are too
    met = known.mapInPandas(rings_met, "vec_id long, v array<double>, dim int, home int, home_part int, bound double, cell int, away double").join(rings, ["dim", "cell"])
    gap = F.greatest(F.col("away") - F.col("far"), F.col("near") - F.col("away"), F.lit(0.0))
    met = met.filter(relax * gap * (1 - SLACK) - SLACK <= F.col("bound")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.filter((F.col("cell") != F.col("home")) | (F.col("part") != F.col("home_part"))).select("vec_id", "v", "dim", "cell", "part", "bound")
    rest = settle(_searched(trees, settle(met, "met"), k, relax, query_rows), "rest")
    out = best(first.unionByName(rest), k)
    discard(placed, trees, home)
    return out


def brute_force(vectors: pd.DataFrame, query_ids, k: int = K) -> set[tuple[int, int, int]]:
    """(query, rank, neighbour) by comparing with every row; for tests and recall."""
    ids, points = vectors["vec_id"].to_numpy(np.int64), np.stack(vectors["embedding"].to_numpy()).astype(np.float64)
    out = set()
    for q in query_ids:
        d = distances(points, points[ids == q][:1])[0]
        d[ids == q] = np.inf
        for rank, i in enumerate(np.lexsort((ids, d))[:k], 1):
            if np.isfinite(d[i]):
                out.add((int(q), rank, int(ids[i])))
    return out


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL),
f AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda p: (p[2] - p[1]) * (p[2] - p[1])), lambda a, b: a + b)) AS score
    FROM f q JOIN f c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
