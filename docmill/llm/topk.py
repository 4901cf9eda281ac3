"""Exact top-k inner products by vector-approximation files.

Components become whole numbers.  Equal vectors are one entry that carries its ``k`` + 1 smallest ids, so a vector
that a third of all rows share is compared once.  The approximation file has a ``BITS``-bit cell for every
component, on one grid for each dimension; from the cells a query gets a lower and an upper bound of each score.

Queries are dealt into blocks and the file into parts, both of bounded size; each pair of a block and a part is one
group of one job, which any executor can do again.  A first scan of the cells finds, for each query, a score that k
candidates are sure to reach (each group sends its k best lower bounds).  A second scan keeps the candidates whose
upper bound reaches it.  Exact vectors are then read in the order of their bounds: the first few of each query give
a k-th best score, and only candidates whose bound reaches that are read as well, so the result is exact for any data.
A query's candidates are dealt into lots, each of which ends by itself once its k-th score is above every bound left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, matrix, saved, table, whole_vectors

#: Bits of a cell; queries in a block and entries in a part of the file at most; entries in a part at least, where fewer
#: parts would leave cores idle.  Every query goes to every part and every entry to every block, so both are as large as a
#: task can hold (about 16 MB of cells and 32 MB of queries).
BITS, QUERIES, PART, PART_LEAST = 6, 1 << 16, 1 << 18, 1 << 14
#: Bounds that a task holds at one time.
BOUNDS = 1 << 22
#: Candidates of a query that are read first, for each of its k; lots of a part's candidates.
FIRST, LOTS = 4, 16
#: What rounding of floating-point bounds may amount to, as a share of the largest sum that can arise.
ROUNDING = 2.0**-40


def whole(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, q`` (array of long): floor(scale * x) of the vectors that take part."""
    return whole_vectors(vectors.where("vec_id is not null"), scale)


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """``entry, q, ids``: each vector once, named by its smallest id, with its k + 1 smallest ids in order."""
    first = F.row_number().over(Window.partitionBy("q").orderBy("vec_id"))
    few = rows.distinct().select("vec_id", "q", first.alias("n")).where(F.col("n") <= k + 1)
    return few.groupBy("q").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("entry"), "q", "ids")


def grid(entries: DataFrame, n_entries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least component, cell width and largest absolute component of each dimension; where a vector is shorter, it has
    a zero there.

    Raises ValueError if the sum of products could pass 64 bits, where scores would wrap around.
    """
    flat = entries.select(F.posexplode("q").alias("dim", "x")).groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).orderBy("dim").collect()
    if sum(max(abs(r.lo), abs(r.hi)) ** 2 for r in flat) >= 1 << 63:
        raise ValueError("components are so large that a score may not fit 64 bits; scale the vectors down")
    # vectors without components have a score of 0, as those of one component 0
    lo = np.array([r.lo if r.n == n_entries else min(r.lo, 0) for r in flat] or [0], np.int64)
    hi = np.array([r.hi if r.n == n_entries else max(r.hi, 0) for r in flat] or [0], np.int64)
    return lo, np.maximum(1, -(-(hi - lo + 1) // (1 << BITS))), np.maximum(np.abs(lo), np.abs(hi))


def approximation(entries: DataFrame, lo: np.ndarray, width: np.ndarray, parts: int) -> DataFrame:
    """``entry, part, cells, more``: a byte for each component's cell, and how many ids the entry stands for."""
    schema = "entry long, part long, cells binary, more int"
    kind = arrow(schema)

    def run(batches):
        for batch in batches:
            cells = ((matrix(batch.column("q"), len(lo)) - lo) // width).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"entry": batch.column("entry"), "part": batch.column("part"), "cells": [c.tobytes() for c in cells], "more": batch.column("more")}, schema=kind)

    return entries.select("entry", F.pmod(F.xxhash64("entry"), F.lit(parts)).alias("part"), "q", F.size("ids").alias("more")).mapInArrow(run, schema)


def scan(cells: DataFrame, queries: DataFrame, model: tuple, k: int, parts: int, blocks: int) -> DataFrame:
    """Bounds from the approximation file, a group for each block of ``queries`` and part of ``cells``.

    ``queries``: ``query_id, own, block, q`` and, in the second scan, ``reach``.  Without it the best lower bounds of
    each group; with it all candidates whose upper bound reaches it.
    """
    second = "reach" in queries.columns
    schema = "query_id long, part long, entry long, bound double" if second else "query_id long, bound double"
    kind = arrow(schema)
    lo, width, largest = model
    # half of what a cell holds besides its middle
    half = (width - 1) / 2

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        nothing = pa.Table.from_pydict({f.name: [] for f in kind}, schema=kind)
        if not left.num_rows or not right.num_rows:
            return nothing
        ids, alone = left.column("query_id").to_numpy(), left.column("own").to_numpy()
        q = matrix(left.column("q"), len(lo)).astype(np.float64)
        entry, more = right.column("entry").to_numpy(), right.column("more").to_numpy()
        cell = np.frombuffer(b"".join(right.column("cells").to_pylist()), np.uint8).reshape(len(entry), len(lo)).astype(np.float64)
        # the middle of a cell gives the middle of the bounds; the rest is the same for every candidate
        base, slack = q @ (lo + half), np.abs(q) @ half + ROUNDING * (np.abs(q) @ (largest + width.astype(np.float64)))
        steps, out = q * width, []
        # queries in small lots, so that the table of bounds stays small
        lot = max(1, BOUNDS // len(entry))
        for a in range(0, len(ids), lot):
            mid = base[a : a + lot, None] + steps[a : a + lot] @ cell.T
            if second:
                high = mid + slack[a : a + lot, None]
                i, j = np.nonzero(high >= left.column("reach").to_numpy()[a : a + lot, None])
                out.append({"query_id": ids[a + i], "part": np.full(len(i), right.column("part")[0].as_py()), "entry": entry[j], "bound": high[i, j]})
            else:
                low = mid - slack[a : a + lot, None]
                # an entry with one id may be the query itself, which is no candidate
                low[(entry[None, :] == alone[a : a + lot, None]) & (more[None, :] == 1)] = -np.inf
                n = min(k, low.shape[1])
                best = -np.partition(-low, n - 1, axis=1)[:, :n]
                i, j = np.nonzero(np.isfinite(best))
                out.append({"query_id": ids[a + i], "bound": best[i, j]})
        return pa.Table.from_pydict({f.name: np.concatenate([x[f.name] for x in out]) for f in kind}, schema=kind)

    to_parts = queries.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    to_blocks = cells.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return to_parts.groupBy("block", "part").cogroup(to_blocks.groupBy("block", "part")).applyInArrow(run, schema)


def refine(found: DataFrame, entries: DataFrame, queries: DataFrame, dims: int, k: int, lot) -> DataFrame:
    """Exact scores in the order of the bounds, until the k-th of the lot is certain: ``query_id, vec_id, score``, at
    most k of each query and lot.  ``lot`` deals a query's candidates out, so that no query is one task's alone."""
    own = queries.select("query_id", F.col("q").alias("wanted"))
    exact = found.join(entries, "entry").join(own, "query_id").withColumn("lot", lot)
    exact = exact.repartition("query_id", "lot").sortWithinPartitions("query_id", "lot", F.desc("bound"), "entry")
    schema = "query_id long, vec_id long, score long"
    kind = arrow(schema)

    def run(batches):
        at, best, kth, sure = None, [], None, False
        for batch in batches:
            out = {"query_id": [], "vec_id": [], "score": []}

            def flush(out=out):
                for score, vec in best:
                    for c, v in zip(out, (at[0], vec, -score), strict=True):
                        out[c].append(v)

            # 64-bit sums cannot wrap around: see grid()
            scores = (matrix(batch.column("q"), dims) * matrix(batch.column("wanted"), dims)).sum(1).tolist()
            for i, (q, own_lot, bound, ids) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("query_id", "lot", "bound", "ids")), strict=True)):
                if (q, own_lot) != at:
                    flush()
                    at, best, kth, sure = (q, own_lot), [], None, False
                if sure or (kth is not None and bound < kth):
                    sure = True
                    continue
                best = sorted([*best, *((-scores[i], v) for v in ids if v != q)])[:k]
                kth = -best[-1][0] if len(best) == k else None
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(out, schema=kind)
        if at is not None:
            yield pa.RecordBatch.from_pydict({"query_id": [at[0]] * len(best), "vec_id": [v for _, v in best], "score": [-s for s, _ in best]}, schema=kind)

    return exact.select("query_id", "lot", "bound", "ids", "q", "wanted").mapInArrow(run, schema)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, block_size: int = QUERIES, part_size: int | None = None) -> DataFrame:
    """The ``k`` best candidates of every query: ``query_id, rank, vec_id, score``.

    ``queries`` has rows of ``vectors``; candidates are all rows but the query's own id.  Ties go to the smaller
    id.  Vectors that are null or hold a null or a number that is not finite take no part; shorter vectors count as
    ending in zeros.  Rows that repeat an id and its vector count once.  Scores are exact 64-bit numbers; vectors so
    large that a score might not fit (the squares of the largest components sum to 2**63) raise ValueError.  Fewer
    than k candidates: all of them; no vectors: no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    entries = saved(distinct_vectors(whole(vectors), k), "vectors")
    wanted = whole(queries).groupBy("vec_id").agg(F.min("q").alias("q"))
    wanted = saved(wanted.join(entries.select("q", F.col("entry").alias("own")), "q").select(F.col("vec_id").alias("query_id"), "own", "q"), "queries")
    n_entries, n_queries = entries.count(), wanted.count()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    model = grid(entries, n_entries)
    blocks, dims, pieces = -(-n_queries // block_size), len(model[0]), lambda size: -(-n_entries // size)
    busy = -(-4 * spark.sparkContext.defaultParallelism // blocks)
    parts = pieces(part_size) if part_size else max(pieces(PART), min(pieces(PART_LEAST), busy))
    cells = saved(approximation(entries, *model[:2], parts), "cells")
    dealt = wanted.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    top = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound")))
    sure = scan(cells, dealt, model, k, parts, blocks).withColumn("n", top).where(F.col("n") == k).select("query_id", F.col("bound").alias("reach"))
    reaching = dealt.join(sure, "query_id", "left").withColumn("reach", F.coalesce("reach", F.lit(float("-inf"))))
    found = saved(scan(cells, reaching, model, k, parts, blocks), "candidates")
    early = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "entry"))
    first = found.withColumn("n", early).where(F.col("n") <= FIRST * k).drop("n")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    kth = saved(refine(first, entries, wanted, dims, k, F.lit(0).cast("long")).withColumn("n", place).where(F.col("n") == k).select("query_id", "score"), "kth-scores")
    left = found.join(kth, "query_id", "left").where(F.col("score").isNull() | (F.col("bound") >= F.col("score"))).drop("score")
    lot = F.col("part") * LOTS + F.pmod(F.xxhash64("entry"), F.lit(LOTS))
    best = refine(left, entries, wanted, dims, k, lot)
    return best.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 50 = 0"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""
