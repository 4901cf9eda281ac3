"""Exact dedup by an extendible-hash index on shared files.

Keys are 64-bit hashes of whole texts.  One grouped pass compares texts byte by byte inside each hash (so
colliding texts stay apart, chained in the order of their digest) and combines copies on the map side, which is
what keeps a hot group of copies harmless.  A histogram of key prefixes drives the directory: level d halves every
bucket of level d-1, and a prefix stops doubling at the first level at which its bucket holds at most ``capacity``
keys; while a bucket is overfull at the finest level, the directory doubles on.  Buckets go to owner tasks by range
and are written, sorted, as the files of the index.

Documents then probe the index: the directory says which bucket a key's slot belongs to, and bucket, key and salt are
the key of the join.  An entry stands once under every salt that a copy of its text has, at most ``SALTS`` of them, so
the copies of one text meet it in many tasks.  In a probe a text's 256-bit digest stands for its bytes.

Everything is DataFrame operations; no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, table, texts, without_repeats

#: Keys in a bucket before it splits.
CAPACITY = 100_000
#: Bits of a key that the directory uses at first, by which it grows, and at most: 100,000 keys that share 48 bits by
#: chance would need 2**64 keys.  Slots that are sent to every task; a larger directory is joined.
DEPTH, STEP, MAX_DEPTH, SLOTS_SENT = 16, 8, 48, 1 << 16
#: Tasks that the copies of one text are dealt to.
SALTS = 48


def salt(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("string")), F.lit(SALTS)).cast("int")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """``(slot, depth, bucket)`` for each used slot of the finest directory, and its bits, from a frame with ``key``.

    A bucket is named by its depth and prefix.
    """
    bits = DEPTH
    while True:
        slots = keys.groupBy(F.shiftrightunsigned("key", 64 - bits).alias("slot")).agg(F.count("*").alias("n"))
        levels = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
        levels = levels.withColumn("prefix", F.expr(f"shiftright(slot, {bits} - depth)"))
        fits = saved(levels.groupBy("depth", "prefix").agg(F.sum("n").alias("held")).where((F.col("held") <= capacity) | (F.col("depth") == bits)), "dedup-levels")
        fits = F.broadcast(fits) if bits == DEPTH else fits  # fewer than 2 * 2**DEPTH rows
        chosen = levels.join(fits, ["depth", "prefix"]).groupBy("slot").agg(F.min_by(F.struct("prefix", "held"), "depth").alias("p"), F.min("depth").alias("depth"))
        chosen = saved(chosen.select("slot", "depth", F.expr(f"shiftleft(p.prefix, {bits} - depth)").alias("bucket"), F.col("p.held").alias("held")), "dedup-directory")
        if bits >= MAX_DEPTH or chosen.where(F.col("held") > capacity).isEmpty():
            return chosen.drop("held"), bits
        bits += STEP


def located(rows: DataFrame, slots: DataFrame, bits: int) -> DataFrame:
    """``rows`` (with ``key``) and the ``bucket`` and ``depth`` that the directory gives their keys."""
    slots = F.broadcast(slots) if slots.count() <= SLOTS_SENT else slots
    return rows.withColumn("slot", F.shiftrightunsigned("key", 64 - bits)).join(slots, "slot").drop("slot")


def build_index(docs: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame, int]:
    """The index, read from its files: one row per distinct text, in owner tasks by range of buckets; its directory, and
    the bits that the directory uses."""
    rows = texts(docs).select("doc_id", "text", F.xxhash64("text").alias("key"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.coalesce(salt(F.col("doc_id")), F.lit(0)))
    groups = rows.groupBy("key", "text").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"), F.bit_or(one).alias("salts"))
    entries = saved(groups.select("key", F.sha2("text", 256).alias("text_sha256"), "group_size", "keep_id", "salts"), "dedup-entries")
    slots, bits = directory(entries.select("key").distinct(), capacity)
    chain = located(entries, slots, bits).select("bucket", "depth", "key", "text_sha256", "group_size", "keep_id", "salts")
    return saved(chain.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key", "text_sha256"), "dedup-index"), slots, bits


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null texts count as empty, and empty texts are copies of each other; texts of any length are compared whole.  Of
    equal texts the largest ``doc_id`` stays; rows that repeat one ``doc_id`` with the same text are members of the
    group, and all rows of the kept ``doc_id`` say ``kept``.  Rows without a ``doc_id`` get ``kept`` false unless no
    row of the group has one (then ``keep_id`` is null and each is kept).  An empty table gives an empty result; other
    columns are ignored.
    """
    index, slots, bits = build_index(docs, capacity)
    rows = texts(docs).select("doc_id", F.xxhash64("text").alias("key"), F.sha2("text", 256).alias("text_sha256")).withColumn("salt", F.coalesce(salt(F.col("doc_id")), F.lit(0)))
    bit = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit("salts", i) == 1)
    entries = index.select("bucket", "key", F.col("text_sha256").alias("sha"), "group_size", "keep_id", F.explode(bit).alias("salt"))
    found = located(rows, slots, bits).join(entries, ["bucket", "key", "salt"]).where(F.col("sha") == F.col("text_sha256"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The documents that stay, with all their columns; which ones those are: see ``exact_dedup``.  Of rows that
    repeat the kept ``doc_id`` one stays; of texts that only rows without a ``doc_id`` have, each row."""
    keep = build_index(docs, capacity)[0].select(F.col("keep_id").alias("_keep"), F.col("text_sha256").alias("_sha"))
    same = docs["doc_id"].eqNullSafe(keep["_keep"]) & (F.sha2(F.coalesce(docs["text"], F.lit("")), 256) == keep["_sha"])
    return without_repeats(docs.join(keep, same, "left_semi"), docs)


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
