import hashlib

import pytest
from pyspark.sql import functions as F

from docmill.llm import exact_dedup as e


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    out = []
    for d, t in rows:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        out.append((d, keep, len(g), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(1, "a"), (2, "a"), (3, "A"), (4, None), (5, ""), (5, ""), (7, "é"), (8, "é"), (9, "x" * 200_000), (10, "x" * 200_000), (None, "a"), (None, "alone"), (11, " a")] + [(100 + i, "hot") for i in range(50)]


@pytest.mark.parametrize("capacity", [1, 100_000])
def test_against_brute_force(spark, capacity):
    df = spark.createDataFrame([(*r, "k", 0) for r in ROWS], "doc_id long, text string, key string, salt int")
    assert sorted((tuple(r) for r in e.exact_dedup(df, capacity).collect()), key=repr) == brute(ROWS)
    kept = e.deduplicate(df, capacity)
    assert kept.columns == df.columns
    stay = {(x[0], x[4]) for x in brute(ROWS) if x[3]}
    want = {(d, t) for d, t in ROWS if (d, hashlib.sha256((t or "").encode()).hexdigest()) in stay}
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)


def test_directory_doubles_until_buckets_fit(spark):
    keys = spark.range(2000).select(F.shiftleft("id", 40).alias("key"))  # all share their first bits
    keys = keys.union(spark.range(4).select(F.shiftleft("id", 62).alias("key")))
    slots, bits = e.directory(keys, 100)
    slots = {r.slot: r for r in slots.collect()}
    held = {}
    for k in {i << 40 for i in range(2000)} | {i << 62 for i in range(4)}:
        s = slots[k >> (64 - bits)]
        held.setdefault((s.bucket, s.depth), set()).add(k)
    assert all(len(v) <= 100 for v in held.values()) and bits > e.DEPTH
    assert max(r.depth for r in slots.values()) > min(r.depth for r in slots.values())


def test_keys_that_cannot_be_told_apart(spark):
    keys = spark.range(10).select(F.lit(5).cast("long").alias("key"))
    slots, bits = e.directory(keys, 3)
    assert bits == e.MAX_DEPTH and slots.count() == 1


def test_colliding_keys_are_chained(spark, monkeypatch):
    monkeypatch.setattr(F, "xxhash64", lambda *a: F.lit(7).cast("long"))
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert sorted((tuple(r) for r in e.exact_dedup(df).collect()), key=repr) == brute(ROWS)


def test_empty(spark):
    assert e.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
