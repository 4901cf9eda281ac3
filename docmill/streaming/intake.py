"""Intake as a stream: new files in a folder, deduplicated by content across runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from docmill.sources.keyed import KeyedIndex

FILES = "path string, modificationTime timestamp, length long, content binary"


def files(spark: SparkSession, folder: str, pattern: str = "*", per_batch: int = 1000) -> DataFrame:
    """A stream of the files in ``folder``."""
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).load(folder)


def rows(spark: SparkSession, folder: str, schema: str, per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def first_of_content(stream: DataFrame, content: str, within: str | None = None, at: str | None = None) -> DataFrame:
    """The first row of each content.  State holds one hash a row; ``within`` a watermark it is bounded by time."""
    hashed = stream.withColumn("sha256", F.sha2(F.col(content), 256))
    if within is None:
        return hashed.dropDuplicates(["sha256"])
    return hashed.withWatermark(at, within).dropDuplicatesWithinWatermark(["sha256"])


def to_table(stream: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame, int], DataFrame] | None = None) -> StreamingQuery:
    """Process what is there and stop; started again, it goes on where the checkpoint says.

    ``each`` transforms a micro-batch.  A batch that is repeated after a failure overwrites its own folder.
    """
    if each is None:
        return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def write(batch: DataFrame, epoch: int) -> None:
        each(batch, epoch).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, at: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts and sums in tumbling windows of event time (a platform extension)."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def refresh_index(stream: DataFrame, index: KeyedIndex, checkpoint: str, order: str | None = None, name: str = "rows") -> StreamingQuery:
    """Keep an index up to date with a stream of its rows: each micro-batch writes its own rows as a delta, once.

    Of rows of a batch with one key the last by ``order`` counts.  ``name`` tells streams into one index apart.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        index.upsert(batch, order, once=f"{name}-{epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_contents(stream: DataFrame, index: KeyedIndex, path: str, checkpoint: str, key: str, order: str, name: str = "new") -> StreamingQuery:
    """Write the rows of a stream whose ``key`` no earlier run has seen, each key once, to ``path/batch=N``.

    What has been seen is the index, not the state of the query, so it can be compacted, repaired and shared; a micro-batch
    reads the buckets its keys fall into.  Of rows of a batch with one key the first by ``order`` is written.  A batch that
    is repeated after a failure gives the same rows.
    """
    columns = stream.columns

    def write(batch: DataFrame, epoch: int) -> None:
        once = f"{name}-{epoch}"
        if once in index.state().done:
            return
        first = batch.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(F.struct(F.col(order).alias("_order"), *(F.col(c) for c in columns))).alias("r")).select("r.*").select(*columns)
        saved_at = f"{path}/batch={epoch}"
        index.unknown(first, key).write.mode("overwrite").parquet(saved_at)
        index.upsert(batch.sparkSession.read.schema(stream.schema).parquet(saved_at), once=once)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audit_listener(spark: SparkSession, keep: Callable[[dict], None]) -> StreamingQueryListener:
    """A listener that hands a record of every start, step and end of a stream to ``keep`` (see ``sinks.audit``)."""

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event):
            keep({"event": "start", "query": str(event.id), "at": event.timestamp, "rows": None})

        def onQueryProgress(self, event):
            keep({"event": "step", "query": str(event.progress.id), "at": event.progress.timestamp, "rows": event.progress.numInputRows})

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            keep({"event": "end", "query": str(event.id), "at": None, "rows": None})

    out = Listener()
    spark.streams.addListener(out)
    return out
