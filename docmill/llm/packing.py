"""Packing documents into sequences of a fixed number of tokens by minimum bin slack.

Which documents share a sequence depends on their lengths alone, and there are at most as many lengths as tokens in a
sequence, however many documents there are.  So the pieces are counted by length, and the counts are packed: each
sequence starts with the longest length left, and a subset-sum over bits finds the fullest combination of available
lengths for the rest.  A combination is taken as often as the counts allow, which is what finding it again for each
sequence would do.  The pieces of each length are numbered (within the tasks that made them, plus the counts of the
tasks before), and a piece's number says which sequence is its own: no group of pieces meets in one task.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import bpe, vocabulary
from .common import arrow, map_texts, saved, table, texts

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END = 4096, 1
#: Bits of a piece's number among those of its length.
NUMBER_BITS = 46


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int | None = END) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: every whole text encoded and ended, and cut where it is longer than a
    sequence.  A null text counts as empty; without an end id such a text has no piece."""

    def work(batch, path):
        tail = b"" if end_id is None else end_id.to_bytes(4, "little")
        own, piece, length, crc = [], [], [], []
        for row, ids in enumerate(bpe(path).encode(batch.column("text").to_pylist())):
            raw = memoryview(ids + tail)
            for n, at in enumerate(range(0, len(raw), 4 * capacity)):
                cut = raw[at : at + 4 * capacity]
                own.append(row)
                piece.append(n)
                length.append(len(cut) // 4)
                crc.append(zlib.crc32(cut))
        return {"doc_id": batch.column("doc_id").take(pa.array(own, pa.int64())), "piece": piece, "start": [n * capacity for n in piece], "length": length, "ids_crc32": crc}

    return map_texts(texts(docs), work, f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long", path)


def numbered(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``_part`` (the task) and ``_nth`` (the number within it among those of its ``length``), saved."""
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", _part int, _nth long"
    kind = arrow(schema)

    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            length = batch.column("length").to_numpy()
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.empty(0, np.int64)
            sizes, nth = np.diff(np.r_[first, len(ranked)]), np.empty(len(length), np.int64)
            before = np.array([seen[x] for x in ranked[first].tolist()], np.int64)
            nth[order] = np.arange(len(ranked)) - np.repeat(first - before, sizes)
            seen.update(dict(zip(ranked[first].tolist(), sizes.tolist(), strict=True)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part, np.int32)), pa.array(nth)], schema=kind)

    return saved(pieces.mapInArrow(run, schema), "pieces")


def fullest(available: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """``(length, how many)`` of a combination that fills ``room`` best, from ``(length, how many there are)``.

    Bit t of ``reach`` says that some combination has t tokens.  Lengths come falling, so that of the fullest combinations
    one of long pieces is taken, and the search ends as soon as the room can be filled.
    """
    reach, inside, trail = 1, (1 << room + 1) - 1, []
    for length, count in available:
        left, step = min(count, room // length), 1
        if not left:
            continue
        trail.append((length, reach))
        while left:
            step = min(step, left)
            reach |= reach << length * step & inside
            left, step = left - step, step * 2
        if reach >> room:
            break
    full, out = reach.bit_length() - 1, []
    for length, before in reversed(trail):
        n = 0
        while not before >> full & 1:
            full, n = full - length, n + 1
        if n:
            out.append((length, n))
    return out


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """``(how often, [(length, how many)])``: the sequences, equal ones together, until every piece has its place."""
    left, out = dict(sorted(counts.items(), reverse=True)), []
    while left:
        longest = next(iter(left))
        own = Counter({longest: 1})
        if capacity > longest:
            for length, n in fullest([(x, n - (x == longest)) for x, n in left.items() if n > (x == longest)], capacity - longest):
                own[length] += n
        often = min(left[length] // n for length, n in own.items())
        out.append((often, list(own.items())))
        for length, n in own.items():
            left[length] -= often * n
            if not left[length]:
                del left[length]
    return out


def slots(plan: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """For each pattern and length, falling into one row: the key ``length, first number``, first sequence, how many of
    the length a sequence has, and where they begin in it.  Sorted by key."""
    rows, taken, sequence = [], Counter(), 0
    for often, own in plan:
        offset = 0
        for length, n in own:
            rows.append((length << NUMBER_BITS | taken[length], taken[length], sequence, n, offset))
            taken[length] += often * n
            offset += n * length
        sequence += often
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``, for any frame with a ``length`` (long) from 1 to ``capacity``.

    Sequences are filled from the start without gaps.  Equal rows are pieces of their own; an empty frame gives an empty
    one.  A length outside the range raises ValueError.
    """
    columns = pieces.columns
    rows = numbered(pieces)
    counted = saved(rows.groupBy("length", "_part").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).limit(capacity + 1).collect()}
    if counts and (min(counts) < 1 or max(counts) > capacity):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    place = slots(patterns(counts, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    based = counted.select("length", "_part", F.coalesce(before, F.lit(0)).alias("_base"))
    found = rows.join(based, ["length", "_part"]).select(*columns, (F.col("_base") + F.col("_nth")).alias("_number"))
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    kind = arrow(schema)

    def run(batches):
        keys, first, sequence, many, begin = place.T
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("_number").to_numpy()
            at = np.searchsorted(keys, length << NUMBER_BITS | number, side="right") - 1
            nth = number - first[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence[at] + nth // many[at]), pa.array(begin[at] + nth % many[at] * length)], schema=kind)

    return found.mapInArrow(run, schema)


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int | None = END) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of every whole text.

    Null and empty texts are the end id alone; texts of any length are encoded whole and only cut where they are longer
    than a sequence; repeated rows, and those without a ``doc_id``, are documents of their own; an empty table gives no
    rows; other columns are ignored.
    """
    return pack(pieces_of(docs, path, capacity, end_id), capacity)


def op12_packing(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents", spread=True), vocabulary("word_bpe_49k.json"))
