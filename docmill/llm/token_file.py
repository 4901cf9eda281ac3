"""Token ids as Simple-8b words in files, in document order.

Ids are cut into blocks of ``BLOCK`` and each block into 64-bit words.  A word's top four bits select how many ids
share the other 60 and how wide each is; selector 15 is the escape, for one id of more than 60 bits that fills
the next word alone.  A segment holds whole documents: a header, the blocks' first words and the documents'
lengths as arrays, then the words, so that a reader starts all blocks side by side.  Segments are rows of files
that Spark writes, keyed by range part and ordinal, so a task that is run again replaces its own rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import MARKS, byte_letters, vocabulary
from .common import Recent, arrow, pieces, saved, table, texts

#: Fixed values of the format: (ids in a word, bits of each) by selector; escape; ids in a block; first bytes.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE, BLOCK, MAGIC = 15, 1024, b"S8B1"
HEAD = struct.Struct("<4sQQQ")
#: Ids in a segment, but for a longer document, which comes alone.
SEGMENT_IDS = 1 << 20
#: Bytes of input to a range of documents (files are about half as large as their texts); sizes from here on are unknown.
RANGE_BYTES, KNOWN_BYTES = 16 << 20, 1 << 50
#: Segments whose places are sent to every task (24 bytes each); with more, the join shuffles.
SEGMENTS_SENT = 1 << 20
#: Words in each of the two generations of a worker's table.
TABLE_WORDS = 400_000
#: A space between two visible characters begins a new word whatever surrounds it.
CUT = re.compile(r"(?<=\S) (?=\S)")
RARE_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: The letter that stands for a space in the vocabulary.
SPACE_LETTER = byte_letters()[32]


def widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, at least 1."""
    if len(ids) and ids.max() < 1 << 16:
        return _narrow()[ids]
    return np.maximum(1, np.searchsorted(2 ** np.arange(64, dtype=np.uint64), ids, side="right")).astype(np.uint8)


@lru_cache(maxsize=1)
def _narrow() -> np.ndarray:
    return np.maximum(1, np.searchsorted(2 ** np.arange(17), np.arange(1 << 16), side="right")).astype(np.uint8)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit words of unsigned 64-bit ids, and where each block's words begin (with the end as last)."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    if not n:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    # a row for each block, with a margin no window may reach into
    wide = np.full((blocks, BLOCK + 60), 255, np.uint8)
    tail = n - (blocks - 1) * BLOCK
    bits = widths(ids)
    wide[:-1, :BLOCK] = bits[: n - tail].reshape(blocks - 1, BLOCK)
    wide[-1, :tail] = bits[n - tail :]
    takes, picks = np.ones((blocks, BLOCK), np.uint8), np.full((blocks, BLOCK), ESCAPE, np.uint8)
    most, held = wide.copy(), 1
    # the widest id among the next so many, for growing counts: the last selector that fits has the most ids
    for code in range(len(SELECTORS) - 1, -1, -1):
        count, limit = SELECTORS[code]
        while held < count:
            step = min(held, count - held)
            np.maximum(most[:, :-step], most[:, step:], out=most[:, :-step])
            held += step
        fits = most[:, :BLOCK] <= limit
        takes[fits], picks[fits] = count, code
    takes, picks = takes.ravel(), picks.ravel()
    # all blocks step on together from word to word
    at = np.arange(blocks) * BLOCK
    bounds = np.minimum(at + BLOCK, n)
    starts = []
    while len(at):
        starts.append(at)
        at = at + takes[at]
        stay = at < bounds
        if not stay.all():
            at, bounds = at[stay], bounds[stay]
    start = np.sort(np.concatenate(starts))
    pick = picks[start]
    place = np.cumsum(1 + (pick == ESCAPE)) - 1 - (pick == ESCAPE)
    words = np.zeros(int(place[-1]) + 1 + int(pick[-1] == ESCAPE), np.uint64)
    words[place] = pick.astype(np.uint64) << np.uint64(60)
    words[place[pick == ESCAPE] + 1] = ids[start[pick == ESCAPE]]
    for code, (count, bits) in enumerate(SELECTORS):
        mine = np.flatnonzero(pick == code)
        for k in range(count):
            words[place[mine]] |= ids[start[mine] + k] << np.uint64(bits * k)
    first = np.searchsorted(start, np.arange(blocks) * BLOCK)
    return words, np.r_[place[first], len(words)].astype(np.int64)


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ids again: all blocks are walked side by side only where escapes can hide, else word by word at once."""
    words = np.asarray(words, np.uint64)
    if not n:
        return np.empty(0, np.uint64)
    code = (words >> np.uint64(60)).astype(np.int64)
    head = np.ones(len(words), bool)
    if (code == ESCAPE).any():
        # a word after an escape is no selector; which words those are follows from each block's start
        head[:] = False
        at = offsets[:-1].copy()
        ends = offsets[1:]
        while len(at):
            head[at] = True
            at = at + 1 + (code[at] == ESCAPE)
            stay = at < ends
            at, ends = at[stay], ends[stay]
    place = np.flatnonzero(head)
    code = code[place]
    counts = np.array([c for c, _ in SELECTORS] + [0, 1])[code]
    begins = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.uint64)
    for k, (count, bits) in enumerate(SELECTORS):
        mine = np.flatnonzero(code == k)
        mask = np.uint64((1 << bits) - 1)
        for j in range(count):
            out[begins[mine] + j] = words[place[mine]] >> np.uint64(bits * j) & mask
    mine = np.flatnonzero(code == ESCAPE)
    out[begins[mine]] = words[place[mine] + 1]
    if len(out) != n:
        raise ValueError(f"segment holds {len(out)} ids, its header says {n}")
    return out


def seal(ids: np.ndarray, lengths: list[int]) -> bytes:
    """A segment: header, blocks' offsets, documents' lengths, words."""
    words, offsets = pack(ids)
    return HEAD.pack(MAGIC, len(ids), len(lengths), len(words)) + offsets.astype("<u8").tobytes() + np.array(lengths, "<u8").tobytes() + words.astype("<u8").tobytes()


def unseal(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids and the documents' lengths of a segment."""
    magic, n, docs, size = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    at, blocks = HEAD.size, -(-n // BLOCK) + 1
    offsets = np.frombuffer(data, "<u8", blocks, at).astype(np.int64)
    lengths = np.frombuffer(data, "<u8", docs, at + 8 * blocks).astype(np.int64)
    return unpack(np.frombuffer(data, "<u8", size, at + 8 * (blocks + docs)), offsets, n), lengths


class Words:
    """Ids of words as they follow a space, encoded by the library.

    A word of letters alone is not cut by the library either, so its model is called directly.
    """

    def __init__(self, library):
        self.library, self.model = library, library.model
        self.letters = dict(enumerate(byte_letters()))
        self.table, self.marks = Recent(TABLE_WORDS, self.make), Recent(TABLE_WORDS // 10, self.whole)

    def make(self, word: str) -> bytes:
        body = word.rstrip(MARKS)
        if len(body) < len(word) and body[-1:].isalpha():
            # marks after a letter are a word of their own
            return self.table[body] + self.marks[word[len(body) :]]
        if word.isalpha():
            raw = word.encode().decode("latin-1").translate(self.letters) if not word.isascii() else word
            return array("I", [t.id for t in self.model.tokenize(SPACE_LETTER + raw)]).tobytes()
        return self.whole(" " + word)

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()


class Encoder:
    """The library's encoder behind a table of words it has encoded before."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        self.words = Words(library)

    def encode(self, batch: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        words, out = self.words, []
        get = words.table.__getitem__
        for text in batch:
            if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or RARE_SPACE.search(text):
                first, *rest = CUT.sub("\0", text).split("\0") if "\0" not in text else [text]
            else:
                first, *rest = text.split(" ")
            out.append(words.whole(first) + b"".join(map(get, rest)))
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write(docs: DataFrame, path: str, end_id: int | None = 0, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Encode ``docs`` and write the segments; returns them as read from the files.

    Rows: ``part`` (range of doc_id), ``seq`` (ordinal in it), ``n_ids``, ``doc_ids``, ``data``.  Documents come
    in ascending ``doc_id`` order, null ids first; rows that repeat a doc_id stay, in no fixed order.
    """
    rows = texts(docs)
    # as many ranges as keep each to about RANGE_BYTES, where Spark knows the input's size (else it says 2**63 or so)
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES) if size < KNOWN_BYTES else 1)
    rows = rows.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id")
    own = dict(docs.dtypes)["doc_id"]
    schema = f"part int, seq int, n_ids long, doc_ids array<{own}>, data binary"
    kind = arrow(schema)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        held, ids, size, seq = [], [], 0, 0

        def flush():
            nonlocal held, ids, size, seq
            flat = np.frombuffer(b"".join(ids), "<u4")
            row = {"part": [part], "seq": [seq], "n_ids": [len(flat)], "doc_ids": [held], "data": [seal(flat, [len(x) // 4 for x in ids])]}
            held, ids, size, seq = [], [], 0, seq + 1
            return pa.RecordBatch.from_pydict(row, schema=kind)

        for piece in pieces(batches):
            for doc, made in zip(piece.column("doc_id").to_pylist(), encoder(path).encode(piece.column("text").to_pylist()), strict=True):
                held.append(doc)
                ids.append(made + tail)
                size += len(ids[-1]) // 4
                if size >= segment_ids:
                    yield flush()
        if held:
            yield flush()

    return saved(rows.mapInArrow(run, schema), "token-segments")


def starts(segments: DataFrame) -> DataFrame:
    """Segments with ``base``: ids of all segments before.  Parts are summed first; only their sums meet in one task."""
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("all_ids"))
    before = parts.select("part", (F.sum("all_ids").over(Window.orderBy("part")) - F.col("all_ids")).alias("before"))
    inside = segments.select("part", "seq", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("inside"))
    base = saved(inside.join(before, "part").select("part", "seq", (F.col("inside") + F.col("before")).alias("base")), "segment-places")
    return segments.join(F.broadcast(base) if base.count() <= SEGMENTS_SENT else base, ["part", "seq"])


def read(segments: DataFrame) -> DataFrame:
    """One row per document of the files: ``doc_id, start, n_tokens, ids_crc32``, in the order written."""
    own = dict(segments.dtypes)["doc_ids"][6:-1]
    schema = f"doc_id {own}, start long, n_tokens long, ids_crc32 long"
    kind = arrow(schema)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids, lengths = unseal(batch.column("data")[row].as_py())
                raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(lengths)
                begins = ends - lengths
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_ids")[row].as_py(),
                        "start": begins + batch.column("base")[row].as_py(),
                        "n_tokens": lengths,
                        "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)],
                    },
                    schema=kind,
                )

    return starts(segments).select("base", "doc_ids", "data").mapInArrow(run, schema)


def token_files(docs: DataFrame, path: str, end_id: int | None = 0) -> DataFrame:
    """Write the files of ``docs`` and read them back.

    Null and empty texts have the end id alone; an empty table writes no segment and gives no row.
    """
    return read(write(docs, path, end_id))


def op6_token_file(spark, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
