"""A keyed index that grows by deltas.

Rows live in folders, one for each batch, dealt into buckets by a hash of their key, with a Parquet Bloom filter on the key.  A
log of numbered files says which folders count; a file of the log is made only if no one has made it before, so of two
writers one has to take the next number, and a reader sees whole versions only.  A batch writes its own rows and nothing
else; of rows with one key the latest folder's counts.  When many folders have come together they are made into one.

A probe reads the buckets that its keys fall into, and where there are few keys it names them, so that Parquet's Bloom
filters leave out row groups that cannot hold one.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Keys that a probe names in its filter; folders at which they are made into one.
KEYS_NAMED, FOLDERS = 1000, 16


class Taken(Exception):
    """Another writer has made this version."""


@dataclass
class State:
    """What one version of the log says: folders with their versions, for some buckets the version that they begin with, the
    batches that have come in, and folders that no longer count but may still be read by those who began before."""

    version: int = 0
    folders: dict[str, int] = field(default_factory=dict)
    begins: dict[int, int] = field(default_factory=dict)
    done: list[str] = field(default_factory=list)
    old: list[str] = field(default_factory=list)


class KeyedIndex:
    """``path``: a folder that all executors share; ``key``: one column, never null; ``schema``: of all columns."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = 64):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets
        self._jvm = spark._jvm
        where = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = where.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def bucket(self, key: str | None = None) -> F.Column:
        return F.pmod(F.xxhash64(F.col(key or self.key)), F.lit(self.buckets)).cast("int")

    def state(self) -> State:
        """The newest version."""
        if not self._fs.exists(self._at("_log")):
            return State()
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._at("_log")))
        if not names:
            return State()
        stream = self._fs.open(self._at(f"_log/{names[-1]}"))
        try:
            raw = json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()
        return State(raw["version"], raw["folders"], {int(k): v for k, v in raw["begins"].items()}, raw["done"], raw["old"])

    def _commit(self, state: State) -> None:
        """Make the next version, or raise ``Taken``.  A file is written under a name of its own and then renamed, which fails
        where the name is there."""
        mine, wanted = self._at(f"_new-{uuid.uuid4().hex}"), self._at(f"_log/{state.version:012d}.json")
        out = self._fs.create(mine, False)
        out.write(bytearray(json.dumps(state.__dict__).encode()))
        out.close()
        self._fs.mkdirs(self._at("_log"))
        if self._fs.exists(wanted) or not self._fs.rename(mine, wanted):
            self._fs.delete(mine, False)
            raise Taken(f"version {state.version}")

    def _write(self, rows: DataFrame, each: int = KEYS_NAMED) -> str:
        """A new folder with these rows, about ``each`` keys to a bucket; no one reads it before it is in the log."""
        name = f"d={uuid.uuid4().hex}"
        out = rows.select(*self._columns()).withColumn("_bucket", self.bucket()).repartition("_bucket").sortWithinPartitions("_bucket", self.key)
        out.write.partitionBy("_bucket").option(f"parquet.bloom.filter.enabled#{self.key}", "true").option(f"parquet.bloom.filter.expected.ndv#{self.key}", each).parquet(f"{self.path}/{name}")
        return name

    def _columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def _change(self, change, tries: int = 20) -> State:
        """Commit ``change`` of the newest version, again from the next one where another writer was first."""
        for _ in range(tries):
            state = self.state()
            if change(state) is False:
                return state
            state.version += 1
            try:
                self._commit(state)
            except Taken:
                continue
            return state
        raise Taken(f"no version in {tries} tries")

    def upsert(self, rows: DataFrame, order: str | None = None, once: str | None = None) -> State:
        """Add ``rows``, which win over older ones of their key.

        Of rows of this batch with one key the last by ``order`` counts (equal ones: the largest row).  ``once`` names the
        batch: one that has come in before changes nothing, so a batch that is repeated after a failure counts once.  Rows
        without a key are left out.
        """
        if once is not None and once in self.state().done:
            return self.state()
        whole = F.struct(*([F.col(order).alias("_order")] if order else []), *(F.col(c) for c in self._columns()))
        last = rows.where(F.col(self.key).isNotNull()).groupBy(F.col(self.key).alias("_k")).agg(F.max(whole).alias("r")).select("r.*")
        folder = self._write(last.select(*self._columns()))

        def add(state: State):
            if once is not None and once in state.done:
                return False
            state.folders[folder] = state.version + 1
            state.done = [*state.done, once][-1000:] if once is not None else state.done
            return True

        out = self._change(add)
        return self.compact() if len(out.folders) > FOLDERS else out

    def _rows(self, state: State, buckets: list[int] | None = None, keys: list | None = None, checking: bool = False) -> DataFrame:
        """All rows that count, with ``_v``, the version of their folder."""
        if not state.folders:
            return self.spark.createDataFrame([], f"{self.schema}, _bucket int, _v int")
        reader = self.spark.read.schema(f"{self.schema}, _bucket int").option("basePath", self.path)
        if checking:
            reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
        parts = []
        for folder, version in sorted(state.folders.items()):
            there = reader.option("basePath", f"{self.path}/{folder}").parquet(f"{self.path}/{folder}").withColumn("_v", F.lit(version))
            if buckets is not None:
                there = there.where(F.col("_bucket").isin(buckets))
            if keys is not None:
                there = there.where(F.col(self.key).isin(keys))
            late = [b for b, v in state.begins.items() if v > version]
            parts.append(there.where(~F.col("_bucket").isin(late)) if late else there)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _latest(self, rows: DataFrame) -> DataFrame:
        newest = F.row_number().over(Window.partitionBy(self.key).orderBy(F.desc("_v")))
        return rows.withColumn("_n", newest).where("_n = 1").drop("_n")

    def read(self, checking: bool = False) -> DataFrame:
        """The newest row of each key."""
        return self._latest(self._rows(self.state(), checking=checking)).select(*self._columns())

    def known(self, keys: DataFrame, key: str | None = None) -> DataFrame:
        """The index's rows for ``keys``: of the buckets they fall into alone, and where they are few, of their names."""
        own = keys.select(F.col(key or self.key).alias(self.key)).where(F.col(self.key).isNotNull()).distinct()
        some = [r[0] for r in own.limit(KEYS_NAMED + 1).collect()]
        buckets = [r[0] for r in own.select(self.bucket()).distinct().collect()]  # at most as many as there are buckets
        named = some if len(some) <= KEYS_NAMED else None
        return self._latest(self._rows(self.state(), buckets, named).join(own, self.key, "left_semi")).select(*self._columns())

    def unknown(self, rows: DataFrame, key: str | None = None) -> DataFrame:
        """The rows whose key the index does not have."""
        found = self.known(rows, key).select(F.col(self.key).alias("_known"))
        return rows.join(found, F.col(key or self.key) == F.col("_known"), "left_anti")

    def compact(self) -> State:
        """One folder in place of all.  Folders that come in meanwhile stay beside it, and are newer.  Those it takes the place
        of are deleted by the next merge, so that readers have until then."""
        before = self.state()
        if len(before.folders) < 2:
            return before
        rows = self._rows(before)
        folder = self._write(self._latest(rows), max(KEYS_NAMED, rows.count() // self.buckets))

        def swap(state: State):
            if not before.folders.items() <= state.folders.items() or state.begins != before.begins:
                return False  # another writer has done it, or repaired what was read
            state.folders = {k: v for k, v in state.folders.items() if k not in before.folders} | {folder: max(before.folders.values())}
            state.old = list(before.folders)
            return True

        out = self._change(swap)
        for gone in before.old if folder in out.folders else [folder]:
            self._fs.delete(self._at(gone), True)
        return out

    def digests(self, rows: DataFrame) -> DataFrame:
        """``_bucket, n, x, s`` of rows in any order: how many, and two sums of their hashes."""
        h = F.xxhash64(*self._columns())
        return rows.withColumn("_bucket", self.bucket()).groupBy("_bucket").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(20,0)")).alias("s"))

    def differing(self, rows: DataFrame) -> list[int]:
        """The buckets whose rows are not those of ``rows``; files that are gone or cannot be read count as without rows."""
        mine, theirs = self.digests(self.read(checking=True)), self.digests(rows.select(*self._columns()))
        both = mine.join(theirs.select(F.col("_bucket").alias("_b"), F.struct("n", "x", "s").alias("_other")), F.col("_bucket") == F.col("_b"), "full_outer")
        return sorted(r[0] for r in both.where(~F.struct("n", "x", "s").eqNullSafe(F.col("_other"))).select(F.coalesce("_bucket", "_b")).collect())

    def repair(self, rows: DataFrame) -> list[int]:
        """Make the index equal to ``rows`` (one for each key): buckets whose digests differ are written anew, others stay as
        they are.  Gives the buckets that were written."""
        wrong = self.differing(rows)
        if wrong:
            folder = self._write(rows.where(self.bucket().isin(wrong)))

            def replace(state: State):
                state.folders[folder] = state.version + 1
                state.begins |= {b: state.version + 1 for b in wrong}
                return True

            self._change(replace)
        return wrong
