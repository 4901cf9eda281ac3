"""What the operators share: the shared folder, saved tables and Arrow batches in bounded pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators.tasks import saved  # noqa: F401

#: Characters of text that a Python worker holds as tokens at one time.
CHUNK_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A table of the folder.  ``spread``: a file that Spark reads in fewer tasks than there are cores (it has few row
    groups) is dealt out to all of them, for work that costs more than the shuffle of so small an input."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` (null becomes empty), without any other column, whatever it is called."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def repeated(docs: DataFrame) -> DataFrame:
    """``_again``: every ``doc_id`` that several rows have."""
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_again"))
    return saved(again, "repeated-ids")


def without_repeats(kept: DataFrame, docs: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """``kept``, rows of ``docs``, with one row of those that repeat a ``doc_id`` and its text.  Rows without a
    ``doc_id`` stay.  Only ids are counted; texts are compared where an id occurs again (``again``: see ``repeated``)."""
    again = repeated(docs) if again is None else again
    if again.isEmpty():
        return kept
    same = kept["doc_id"] == again["_again"]
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


class Recent(dict):
    """A table of what ``make`` gives for each key, bounded by two generations of ``size`` entries.

    When the young one is full it becomes the old one, and what is still in use comes back from there, so that
    words that occur once do not push out those that keep coming.
    """

    def __init__(self, size: int, make: Callable | None = None):
        super().__init__()
        self.size, self.make, self.old = size, make, {}

    def turn(self) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.turn()
        self[key] = value
        return value

    def missing(self, keys: set) -> set:
        """Those of ``keys`` that must be made; what the old generation has is taken over."""
        self.turn()
        fresh, old = keys.difference(self), self.old
        if old:
            for key in [k for k in fresh if k in old]:
                self[key] = old[key]
                fresh.discard(key)
        return fresh


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds about ``limit`` bytes at most (a longer row comes alone)."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and held + (size or 0) > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size or 0
        if start < len(sizes):
            yield batch.slice(start)


def arrow(schema: str) -> pa.Schema:
    """The Arrow schema of a DDL string (on the driver; tasks get it pickled)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def map_texts(df: DataFrame, work: Callable, schema: str, *args) -> DataFrame:
    """``work(piece, *args) -> dict of columns`` over every piece of ``df``."""
    out = arrow(schema)

    def run(batches):
        for piece in pieces(batches):
            yield pa.RecordBatch.from_pydict(work(piece, *args), schema=out)

    return df.mapInArrow(run, schema)


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """``vec_id, q`` (array of long): floor(``scale`` * x) of the vectors without a null or a number that is not finite."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    usable = F.col("embedding").isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(usable).select("vec_id", F.transform(x, lambda v: F.floor(v * scale)).alias("q"))


def matrix(column, dims: int) -> np.ndarray:
    """An Arrow list column as rows of ``dims`` whole numbers; shorter vectors end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.arange(dims)[None, :] < lengths[:, None]] = flat
    return out
