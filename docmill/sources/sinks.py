"""Writing packages, indexes, summaries and logs."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Folders that the documents of one run are dealt to.
BUCKETS = 64


def bucket(key: str, n: int = BUCKETS) -> F.Column:
    """The folder of a document: a hash of its key, so that a run has ``n`` folders and not one for each document."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def packages(rows: DataFrame, path: str, run: str = "run_ts", key: str = "doc_id", mode: str = "append") -> None:
    """Run packages by run and bucket of documents; a reader of one document names its bucket and reads one folder."""
    out = rows.withColumn("bucket", bucket(key))
    out.repartition(run, "bucket").sortWithinPartitions(key).write.mode(mode).partitionBy(run, "bucket").parquet(path)


def publish(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Approved rows by family, so that a search in one family reads one folder."""
    rows.where("approval_state = 'approved'").repartition("contract_family").write.mode(mode).partitionBy("contract_family").parquet(path)


def envelope(rows: DataFrame, updated_at: str, version: int = 1) -> DataFrame:
    return rows.withColumns({"version": F.lit(version), "updated_at": F.lit(updated_at)})


def _file_system(spark, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def versions(spark, path: str) -> list[int]:
    """The whole versions of an index, oldest first: folders ``v=N`` whose writers have come to their end."""
    fs, where = _file_system(spark, path)
    if not fs.exists(where):
        return []
    done = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(where) if s.getPath().getName().startswith("v=") and done(s.getPath()))


def claimed(spark, path: str, first: int) -> int:
    """The first version from ``first`` on that no writer has claimed; it is claimed now."""
    fs, _ = _file_system(spark, path)
    while True:
        mine = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_claims/{first}")
        if not fs.exists(mine):
            try:
                fs.create(mine, False).close()
                return first
            except Py4JJavaError:
                if not fs.exists(mine):
                    raise
        first += 1


def read_index(spark, path: str) -> DataFrame:
    """The newest whole version."""
    every = versions(spark, path)
    if not every:
        raise FileNotFoundError(f"no version of an index in {path}")
    return spark.read.parquet(f"{path}/v={every[-1]}")


def index(rows: DataFrame, path: str, updated_at: str, merge_key: str | None = None, keep: int = 3) -> int:
    """A new version of an index with its time; with ``merge_key`` old rows are kept beside new ones.  Gives its number.

    A version is a folder of its own, and counts once its writer's mark is there, so whoever reads meanwhile, or after
    a failure, has the one before it.  A number is claimed by a file that only one writer can make, so two never write one
    folder; but each keeps the old rows that it has read, so writers of single rows side by side need a ``KeyedIndex``.  The
    last ``keep`` versions stay.
    """
    spark, every = rows.sparkSession, versions(rows.sparkSession, path)
    version = claimed(spark, path, every[-1] + 1 if every else 1)
    out = envelope(rows, updated_at, version)
    if merge_key and every:
        old = read_index(spark, path).join(rows.select(merge_key).distinct(), merge_key, "left_anti")
        out = out.unionByName(old, allowMissingColumns=True)
    out.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{path}/v={version}")
    for old_version in every[: max(0, len(every) + 1 - keep)]:
        fs, where = _file_system(spark, f"{path}/v={old_version}")
        fs.delete(where, True)
    return version


def json_export(rows: DataFrame, path: str, by: str = "doc_id", n: int = BUCKETS) -> None:
    """One JSON record a line, in buckets of documents."""
    rows.withColumn("bucket", bucket(by, n)).repartition("bucket").sortWithinPartitions(by).write.mode("overwrite").partitionBy("bucket").option("ignoreNullFields", "false").json(path)


def text_export(rows: DataFrame, path: str, column: str = "md", by: str = "doc_id") -> None:
    """A text file a document: for people, not for a corpus; ``json_export`` and ``packages`` hold many in a file."""
    rows.select(by, F.col(column).alias("value")).repartition(by).write.mode("overwrite").partitionBy(by).option("lineSep", "\n").text(path)


def batch_summary(results: DataFrame, path: str, timestamp: str) -> None:
    """Results of a batch, a record a line; grouped into one struct only by those who export it for people."""
    results.withColumn("timestamp", F.lit(timestamp)).write.mode("overwrite").json(path)


def manifest_yaml(row: dict) -> str:
    """One manifest for people, fields in their order."""
    import yaml

    return yaml.dump(row, allow_unicode=True, default_flow_style=False, sort_keys=False)


def audit(rows: DataFrame, path: str) -> None:
    """An append-only log."""
    rows.write.mode("append").parquet(path)
