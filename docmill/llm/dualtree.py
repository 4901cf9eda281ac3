"""Centroid clustering: Lloyd's rounds over two trees.

The vectors are dealt into blocks of bounded size, and each block has a cover tree: a node's children are chosen
greedily so that each lies beyond half the node's radius from the others and covers what lies within it, and the first
child keeps the node's own point.  The trees are written once and read in every round.  The centroids get a cover tree
in every round.  A task walks pairs of nodes of the two trees, all of a level at once: a pair goes when its least
distance exceeds what another pair promises for the whole vector node; a node left with one centroid is assigned whole;
what is left at the leaves is compared exactly, in whole numbers.  A round's only shuffle is of sums by centroid.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, saved, table, whole_vectors

#: Vectors of a block; distinct points of a leaf; pairs whose distances are computed at once.
BLOCK, LEAF, PAIRS = 2048, 8, 1 << 14
#: What rounding may amount to in a distance, as a share of it.
ROUNDING = 2.0**-40


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of whole numbers."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


class CoverTree:
    """A cover tree over distinct points.

    ``order`` lists the points so that a node's are ``order[start:end]``; its children are ``count`` nodes from ``child``
    on (none: a leaf of up to ``leaf`` points); no point of a node is farther than ``radius`` from point ``centre``.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        nodes = [[0, 0, len(points), 0, 0]] if len(points) else []
        radius = []
        at = 0
        while at < len(nodes):
            centre, start, end = nodes[at][:3]
            own = self.order[start:end].copy()
            far = apart(points[own], points[centre])
            widest = float(far.max())
            radius.append(widest**0.5 * (1 + ROUNDING))
            if end - start > leaf:
                # within half the radius: in squares, a quarter
                left, first, place = own, centre, start
                nodes[at][3] = len(nodes)
                while len(left):
                    near = (far if first == centre else apart(points[left], points[first])) * 4 <= widest
                    n = int(near.sum())
                    nodes.append([first, place, place + n, 0, 0])
                    self.order[place : place + n] = left[near]
                    place, left = place + n, left[~near]
                    first = left[0] if len(left) else None
                nodes[at][4] = len(nodes) - nodes[at][3]
            at += 1
        self.centre, self.start, self.end, self.child, self.count = np.array(nodes, np.int64).reshape(-1, 5).T.copy()
        self.radius = np.array(radius)


def runs(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of ``counts`` from ``starts``: the range of each member, and the members."""
    which = np.repeat(np.arange(len(starts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[which]


def nearest(points: np.ndarray, tree: CoverTree, centroids: np.ndarray, other: CoverTree, number: np.ndarray) -> tuple[np.ndarray, int]:
    """The nearest centroid of each point (ties: the smaller ``number``), and how many distances that took.

    ``centroids`` are distinct, and ``other`` is their tree, with one in each leaf.
    """
    out, work = np.empty(len(points), np.int64), 0
    a, b = np.zeros(min(1, len(points)), np.int64), np.zeros(min(1, len(points)), np.int64)
    while len(a):
        d = np.concatenate([apart(points[tree.centre[a[i : i + PAIRS]]], centroids[other.centre[b[i : i + PAIRS]]]) for i in range(0, len(a), PAIRS)])
        work += len(a)
        d, r = np.sqrt(d.astype(np.float64)), tree.radius[a]
        # pairs of a node stand together; the centre of a centroid node is a centroid itself
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        sizes = np.diff(np.r_[first, len(a)])
        sure = np.repeat(np.minimum.reduceat(d + r, first), sizes)
        keep = d - r - other.radius[b] <= sure + ROUNDING * (d + r + other.radius[b])
        a, b, r = a[keep], b[keep], r[keep]
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        sizes = np.diff(np.r_[first, len(a)])
        alone = np.repeat(sizes == 1, sizes) & (other.count[b] == 0)
        for node, to in zip(a[alone].tolist(), number[other.centre[b[alone]]].tolist(), strict=True):
            out[tree.order[tree.start[node] : tree.end[node]]] = to
        a, b, r = a[~alone], b[~alone], r[~alone]
        if not len(a):
            break
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        sizes = np.diff(np.r_[first, len(a)])
        opens = (other.count[b] > 0) & ((other.radius[b] >= r) | (tree.count[a] == 0))
        inner = np.repeat(np.logical_or.reduceat(opens, first), sizes)
        ends = ~inner & (tree.count[a] == 0)
        if ends.any():
            # every point of the leaf against every centroid left there
            which, place = runs(tree.start[a[ends]], (tree.end - tree.start)[a[ends]])
            p, c = tree.order[place], other.centre[b[ends]][which]
            d = np.concatenate([apart(points[p[i : i + PAIRS]], centroids[c[i : i + PAIRS]]) for i in range(0, len(p), PAIRS)])
            work += len(p)
            best = np.lexsort((number[c], d, p))
            best = best[np.r_[True, p[best][1:] != p[best][:-1]]]
            out[p[best]] = number[c[best]]
        deeper = ~inner & ~ends
        # a vector node goes on as its children, each with all its pairs; a centroid node as its children
        down, kids = runs(tree.child[a[deeper]], tree.count[a[deeper]])
        split, parts = runs(other.child[b[opens]], other.count[b[opens]])
        stay = inner & ~opens
        a, b = np.concatenate([kids, a[opens][split], a[stay]]), np.concatenate([b[deeper][down], parts, b[stay]])
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
    return out, work


def blocks(rows: DataFrame, dims: int, size: int) -> DataFrame:
    """Blocks of up to ``size`` vectors with their cover trees, as packed arrays; equal vectors are one point."""
    schema = f"ids array<{dict(rows.dtypes)['vec_id']}>, at binary, points binary, nodes binary, order binary, radius binary"
    kind = arrow(schema)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                q = part.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                points, at = np.unique(q, axis=0, return_inverse=True)
                tree = CoverTree(points)
                nodes = np.stack([tree.centre, tree.start, tree.end, tree.child, tree.count])
                packed = {"at": at.ravel(), "points": points, "nodes": nodes, "order": tree.order}
                yield pa.RecordBatch.from_pydict({"ids": [part.column("vec_id").to_pylist()], "radius": [tree.radius.tobytes()]} | {k: [v.astype("<i8").tobytes()] for k, v in packed.items()}, schema=kind)

    return saved(rows.select("vec_id", "q").mapInArrow(run, schema), "cover-trees")


def unpacked(row: dict, dims: int) -> tuple[np.ndarray, np.ndarray, CoverTree]:
    """The points of a block, the point of each of its vectors, and the tree."""
    tree = CoverTree.__new__(CoverTree)
    tree.centre, tree.start, tree.end, tree.child, tree.count = np.frombuffer(row["nodes"], "<i8").reshape(5, -1)
    tree.order, tree.radius = np.frombuffer(row["order"], "<i8"), np.frombuffer(row["radius"])
    return np.frombuffer(row["points"], "<i8").reshape(-1, dims), np.frombuffer(row["at"], "<i8"), tree


def rows_of(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: batch.column(c)[k].as_py() for c in batch.schema.names}


def model(centroids: np.ndarray) -> tuple[np.ndarray, CoverTree, np.ndarray]:
    """Distinct centroids, their tree, and the smallest number of each."""
    distinct, number = np.unique(centroids, axis=0, return_index=True)
    return distinct, CoverTree(distinct, 1), number


def totals(trees: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """For each centroid that has vectors: how many, and their sum.  A task sends one row a centroid and dimension."""
    k, dims = centroids.shape
    schema = "cluster int, dim int, n long, s long"
    kind = arrow(schema)

    def run(batches):
        distinct, other, number = model(centroids)
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for row in rows_of(batches):
            points, at, tree = unpacked(row, dims)
            to, held = nearest(points, tree, distinct, other, number)[0], np.bincount(at, minlength=len(points))
            np.add.at(n, to, held)
            np.add.at(sums, to, points * held[:, None])
        live = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cluster": np.repeat(live, dims).astype(np.int32), "dim": np.tile(np.arange(dims, dtype=np.int32), len(live)), "n": np.repeat(n[live], dims), "s": sums[live].ravel()}, schema=kind)

    got = trees.select("at", "points", "nodes", "order", "radius").mapInArrow(run, schema).groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(got, key=lambda r: (r["cluster"], r["dim"])):
        out.setdefault(r["cluster"], (r["n"], []))[1].append(r["s"])
    return out


def assigned(trees: DataFrame, centroids: np.ndarray, id_type: str) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""
    dims = centroids.shape[1]
    schema = f"vec_id {id_type}, cluster int, distance long"
    kind = arrow(schema)

    def run(batches):
        distinct, other, number = model(centroids)
        for row in rows_of(batches):
            points, at, tree = unpacked(row, dims)
            to = nearest(points, tree, distinct, other, number)[0]
            yield pa.RecordBatch.from_pydict({"vec_id": row["ids"], "cluster": to[at].astype(np.int32), "distance": apart(points, centroids[to])[at]}, schema=kind)

    return trees.mapInArrow(run, schema)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """A row for each vector: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Vectors of ``dims`` components, none null or not finite, take part, as whole numbers floor(``scale`` * x); the first
    centroids are the ``k`` of them with the smallest hash of ``seed`` and ``vec_id`` (fewer vectors: all of them; those
    without a ``vec_id`` come last).  Every row counts, also a repeated one, which may be a centroid twice; of equal
    centroids the smaller number gets all, and the other stays as it is.  Ties go to the smaller number.  Components so large
    that a squared distance might not fit 64 bits raise ValueError.  An empty table gives no rows; other columns are
    ignored.
    """
    spark = vectors.sparkSession
    rows = saved(whole_vectors(vectors.where(F.size("embedding") == dims), scale), "vectors")
    id_type = dict(rows.dtypes)["vec_id"]
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(drawn.asc_nulls_last(), "q").limit(k).select("q").collect()
    if not first:
        return spark.createDataFrame([], f"vec_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    most = rows.agg(F.max(F.array_max("q")).alias("hi"), F.min(F.array_min("q")).alias("lo")).first()
    if dims * (int(most["hi"]) - int(most["lo"])) ** 2 >> 63:
        raise ValueError("components are so large that a distance may not fit 64 bits; scale the vectors down")
    trees = blocks(rows, dims, block)
    centroids = np.array([r["q"] for r in first], np.int64)
    for _ in range(rounds):
        for c, (n, sums) in totals(trees, centroids).items():
            centroids[c] = [s // n for s in sums]
    out = saved(assigned(trees, centroids, id_type), "assigned")
    # a row for each of the k centroids
    own = out.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    everything = sum(r["cluster_inertia"] for r in own)
    named = [(r["cluster"], r["cluster_inertia"], everything, hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in own]
    return out.join(F.broadcast(spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_dualtree(spark, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings", spread=True))


def sql(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> str:
    """Every round as three more common table expressions, comparing every vector with every centroid."""
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
WHERE embedding IS NOT NULL AND len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY h, q) - 1 AS INTEGER) AS c, q FROM (SELECT sha256('{seed}:' || vec_id) AS h, q FROM v ORDER BY h, q LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        distance = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, vq, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM (SELECT v.r, v.vec_id, v.q AS vq, c.c, CAST({distance} AS BIGINT) AS d FROM v, c{i} c) GROUP BY ALL)")
        if i < rounds:
            steps.append(f"m{i} AS (SELECT c, list(x ORDER BY j) AS q FROM (SELECT c, j, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM (SELECT c, unnest(vq) AS x, generate_subscripts(vq, 1) AS j FROM a{i}) GROUP BY c, j) GROUP BY c)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN m{i} m ON c.c = m.c)")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, a.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.c = c.c"""


SQL = sql()
