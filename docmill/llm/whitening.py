"""Embedding whitening by a tiled covariance.

The dimensions are cut into column blocks, and pairs of column blocks are the tile keys.  Each task cuts its vectors
into row-blocks and writes a packed matrix for each column block; these are shuffled by row-block, where every pair of
column blocks is one matrix product.  A task adds up its products of each tile before they are shuffled by tile and
summed.  The assembled covariance has a size that depends on the dimensions alone; the driver finds its eigenvectors,
and one more pass projects every vector.

Components become whole numbers first, so that means are exact fractions; centring takes the whole part of a mean off
as a whole number, so a large common shift (which cancels) costs no precision.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, matrix, saved, table, whole_vectors

#: Rows of a row-block; least dimensions of a column block, and most column blocks.
ROW_BLOCK, TILE, BLOCKS = 2048, 32, 16
#: Components returned; bits of a whole component, and of the number of rows times one.
COMPONENTS, BITS, SUM_BITS = 32, 48, 57
#: Tasks whose tiles are summed in the first of two rounds.
SALTS = 64
#: An eigenvalue below this share of the largest one, for each dimension, is rounding alone.
NOTHING = 2.0**-48

OUT = "vec_id {}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def moments(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension (as many as the longest vector has).

    Raises ValueError for components so large that sums of squares cannot be held exactly.
    """
    r = rows.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("dims"), F.min(F.array_min("q")).alias("lo"), F.max(F.array_max("q")).alias("hi")).first()
    dims, most = r["dims"] or 0, max(abs(r["lo"] or 0), abs(r["hi"] or 0))
    if most >> BITS or 2 * r["n"] * most >> SUM_BITS:
        raise ValueError("components are so large that exact sums do not fit; scale the vectors down")
    schema = "dim int, s decimal(38,0)"
    kind = arrow(schema)

    def run(batches):
        sums = [0] * dims
        for batch in batches:
            sums = [a + b for a, b in zip(sums, matrix(batch.column("q"), dims).sum(0).tolist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"dim": list(range(dims)), "s": [Decimal(s) for s in sums]}, schema=kind)

    flat = rows.select("q").mapInArrow(run, schema).groupBy("dim").agg(F.sum("s").alias("s")).collect() if dims else []
    return r["n"], [int(x["s"]) for x in sorted(flat, key=lambda x: x["dim"])]


def centring(n: int, sums: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """What takes the mean off whole vectors: its whole part exactly, then the fraction that is left."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return lambda q: (q - whole).astype(np.float64) - rest


def column_blocks(rows: DataFrame, dims: int, values: Callable[[np.ndarray], np.ndarray], wide: int, tile: int, row_block: int) -> DataFrame:
    """``row_block, block, data``: the matrix of ``values`` of each row-block, cut into column blocks of ``tile``."""
    schema = "row_block long, block int, data binary"
    kind = arrow(schema)

    def run(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            q = matrix(batch.column("q"), dims)
            for a in range(0, len(q), row_block):
                x = values(q[a : a + row_block])
                cut = [np.ascontiguousarray(x[:, c : c + tile]).tobytes() for c in range(0, wide, tile)]
                yield pa.RecordBatch.from_pydict({"row_block": [at] * len(cut), "block": list(range(len(cut))), "data": cut}, schema=kind)
                at += 1

    return rows.select("q").mapInArrow(run, schema)


def products(pairs: DataFrame, wide: int, tile: int) -> DataFrame:
    """``i, j, salt, data``: for each task and tile, the sum of its pairs' products."""
    schema = "i int, j int, salt int, data binary"
    kind = arrow(schema)
    width = lambda block: min(tile, wide - block * tile)

    def run(batches):
        from pyspark import TaskContext

        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, j, a, b in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "a", "b")), strict=True):
                part = np.frombuffer(a).reshape(-1, width(i)).T @ np.frombuffer(b).reshape(-1, width(j))
                sums[i, j] = sums[i, j] + part if (i, j) in sums else part
        salt = TaskContext.get().partitionId() % SALTS
        for (i, j), x in sums.items():
            yield pa.RecordBatch.from_pydict({"i": [i], "j": [j], "salt": [salt], "data": [x.tobytes()]}, schema=kind)

    return pairs.select("i", "j", "a", "b").mapInArrow(run, schema)


def summed(tiles: DataFrame, *keys: str) -> DataFrame:
    """Tiles with equal ``keys`` added up as they stream by; one tile of each key is held at a time."""
    schema = "i int, j int, salt int, data binary"
    kind = arrow(schema)

    def run(batches):
        at, total = None, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "salt")), batch.column("data"), strict=True):
                key, x = row[: len(keys)], np.frombuffer(row[3].as_buffer())
                if key == at:
                    total = total + x
                    continue
                if at is not None:
                    yield pa.RecordBatch.from_pydict({"i": [at[0]], "j": [at[1]], "salt": [0], "data": [total.tobytes()]}, schema=kind)
                at, total = key, x
        if at is not None:
            yield pa.RecordBatch.from_pydict({"i": [at[0]], "j": [at[1]], "salt": [0], "data": [total.tobytes()]}, schema=kind)

    return tiles.repartition(*keys).sortWithinPartitions(*keys).select("i", "j", "salt", "data").mapInArrow(run, schema)


def gram(rows: DataFrame, dims: int, values: Callable[[np.ndarray], np.ndarray], wide: int, tile: int | None = None, row_block: int = ROW_BLOCK) -> np.ndarray:
    """The sum over all rows of the outer products of ``values`` (``wide`` numbers a row), tile by tile."""
    tile = tile or max(TILE, -(-wide // BLOCKS))
    blocks = column_blocks(rows, dims, values, wide, tile, row_block)
    left = blocks.select("row_block", F.col("block").alias("i"), F.col("data").alias("a"))
    right = blocks.select("row_block", F.col("block").alias("j"), F.col("data").alias("b"))
    pairs = left.join(right.hint("merge"), "row_block").where("i <= j")
    tiles = summed(summed(products(pairs, wide, tile), "i", "j", "salt"), "i", "j")
    out = np.zeros((wide, wide))
    for r in tiles.collect():
        x = np.frombuffer(bytes(r["data"])).reshape(min(tile, wide - r["i"] * tile), -1)
        out[r["i"] * tile :, r["j"] * tile :][: x.shape[0], : x.shape[1]] = x
        out[r["j"] * tile :, r["i"] * tile :][: x.shape[1], : x.shape[0]] = x.T
    return out


def directions(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``most`` largest eigenvalues, falling, their unit eigenvectors as columns, and how many are not nothing."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    live = int((values > NOTHING * len(covariance) * max(values[0], 0)).sum()) if len(values) else 0
    return values, vectors, live


def squares(v: np.ndarray) -> list[Decimal]:
    """The exact sum of squares of each row of whole numbers below 2**57, which may need more than 64 bits: products of
    20 bits each are summed as numbers of the machine, and put together as Python's."""
    v, low = np.abs(v), (1 << 20) - 1
    a, b, c = v >> 40, v >> 20 & low, v & low
    parts = ((c * c).sum(1), 2 * (b * c).sum(1), (2 * a * c + b * b).sum(1), 2 * (a * b).sum(1), (a * a).sum(1))
    return [Decimal(sum(x << 20 * k for k, x in enumerate(row))) for row in zip(*(p.tolist() for p in parts), strict=True)]


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = 64, tile: int | None = None, row_block: int = ROW_BLOCK) -> DataFrame:
    """A row for each vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    ``embedding`` entries c become x = floor(``scale`` * c); a constant added to x changes nothing here.  Vectors that are
    null or hold a null or a number that is not finite take no part; shorter ones end in zeros.  Every row counts, also
    one that repeats a ``vec_id`` or has none.  Components along which nothing varies have a null ``whitened`` and no part
    in ``identity_error``.  Components so large that sums of squares could not be exact raise ValueError; vectors without
    entries, and an empty table, give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = saved(whole_vectors(vectors, scale), "vectors")
    schema = OUT.format(dict(rows.dtypes)["vec_id"])
    n, sums = moments(rows)
    dims = len(sums)
    if not dims:
        return spark.createDataFrame([], schema)
    centre = centring(n, sums)
    covariance = gram(rows, dims, centre, dims, tile, row_block) / n
    values, vectors_, live = directions(covariance, min(components, dims))
    shares = (np.maximum(values, 0) / max(float(np.trace(covariance)), np.finfo(float).tiny)).tolist()
    onto = vectors_[:, :live] / np.sqrt(values[:live])
    # a column of ones beside the whitened ones gives their means, too
    error = 0.0
    if live:
        g = gram(rows, dims, lambda q: np.c_[centre(q) @ onto, np.ones(len(q))], live + 1, tile, row_block) / n
        error = float(np.abs(g[:live, :live] - np.outer(g[live, :live], g[live, :live]) - np.eye(live)).max())
    kind, k, all_sums = arrow(schema), len(values), np.array(sums, np.int64)

    def run(batches):
        for batch in batches:
            ids, q = batch.column("vec_id"), matrix(batch.column("q"), dims)
            for a in range(0, len(q), row_block):
                part = q[a : a + row_block]
                rows_, wide = len(part), np.full((len(part), k), np.nan)
                wide[:, :live] = centre(part) @ onto
                each = pa.array(np.repeat(np.arange(rows_), k))
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": ids.slice(a, rows_).take(each),
                        "component": np.tile(np.arange(1, k + 1, dtype=np.int32), rows_),
                        "n": np.full(rows_ * k, n),
                        "deviation": pa.array(squares(part * n - all_sums), pa.decimal128(38, 0)).take(each),
                        "whitened": pa.array(wide.ravel(), from_pandas=True),
                        "explained": np.tile(shares, rows_),
                        "identity_error": np.full(rows_ * k, error),
                    },
                    schema=kind,
                )

    return rows.mapInArrow(run, schema)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """``deviation`` as a long: null where it does not fit one."""
    out = whiten(table(spark, sf_dir, "embeddings", spread=True))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))
