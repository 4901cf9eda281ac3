"""Python inside tasks, for what no expression says: one function over each row of a frame, in Arrow batches.  And the
folder that tasks share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.  Where that is unset, one of our own, if executors
    are threads of this process; on a cluster each of them would write to its own disk, so there it is an error."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        base = tempfile.mkdtemp(prefix="docmill-")
        context.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier call has returned."""
    return f"{shared_dir(spark)}/docmill/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df`` written to the shared folder and read from there: its lineage is cut, and lost executors lose nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def ddl(types: list[tuple[str, str]]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in types)


def map_rows(df: DataFrame, work: Callable[[dict[str, Any]], Any], name: str, kind: str, drop: list[str] | None = None, limit: int = 256) -> DataFrame:
    """``df`` without the columns ``drop``, and with ``name`` (of type ``kind``): what ``work`` gives for each row.

    Batches are cut into ``limit`` rows, so that only so many results are held at a time.
    """
    kept = [(c, t) for c, t in df.dtypes if c not in (drop or ())]
    schema = ddl([*kept, (name, kind)])
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, limit):
                piece = batch.slice(start, limit)
                made = pa.array([work(row) for row in piece.to_pylist()], out.field(name).type)
                yield pa.RecordBatch.from_arrays([*(piece.column(c).cast(out.field(c).type) for c, _ in kept), made], schema=out)

    return df.mapInArrow(run, schema)
