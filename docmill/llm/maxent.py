"""LM scoring with a hashed maximum-entropy model.

The ``VOCABULARY`` most frequent words are cut into classes of about equal mass, all others are one more class; a
class of several words is cut again in the same way, down to single words.  A token's probability is the product of
the choices on the way to its word, each a softmax over weights of hashed features: the word before, the one before that
(a skip), and both words, each together with the node where the choice is made.  Only within the last class, of the words outside the vocabulary, is it an add-one estimate with one share for unseen words, so the probabilities
of all tokens sum to one.  The rows of weights grow with the distinct words counted, from ``HASHED`` to
``HASHED_MOST``, which is what a worker holds and a task sends.

Training is one pass in ``ROUNDS`` rounds.  Each task starts from the round's weights, takes adaptive gradient
steps over its own documents and sends how far each feature it met has moved; moves are averaged by how often each
task met the feature, streamed through tasks of constant memory.  Word counts are exact and grouped in Spark.  Words
outside the bounded vocabulary never travel to a task as a table: their occurrences are joined with the counts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, pieces, saved, table, texts

#: Words known to every task; classes (the last is of all other words); rows of weights; rounds of training.
VOCABULARY, CLASSES, HASHED, ROUNDS = 200_000, 24, 1 << 14, 2
#: Tokens in a gradient step; its length; rows of weights in a message.
STEP, RATE, ROWS = 8192, 0.5, 256
#: Most rows of weights; distinct words to a row below that; tokens to a task of a round, at least where there are
#: more tasks than cores (a task sends the rows it met, so small tasks would send more than they read).
HASHED_MOST, LOAD, TASK = 1 << 18, 4, 2_000_000
#: Choices whose scores are worked out at a time, so that they stay in a core's cache; choices of one row, in a step,
#: above which they are added up alone.
BLOCK, LARGE = 2048, 32
#: A row of weights as one item.
ROW, ONES = np.dtype(f"V{4 * CLASSES}"), np.ones(CLASSES, np.float32)
#: Distinct words that a task counts before it hands them on.
HELD = 400_000
#: Bytes of text that a task splits at a time: their words are looked up together, in a table made for each call.
TEXTS = 8_000_000
#: Endings of words outside the vocabulary are features of their own.
ENDINGS = 1024
END = b""


def split(column: pa.Array) -> pa.ListArray:
    """The words of each text: A-Z lower-cased, split at ASCII white space, then the end."""
    whole = pc.ascii_ltrim_whitespace(pc.ascii_lower(column))
    # what follows the last white space is the end, an empty word; an empty text is one already
    whole = pc.if_else(pc.equal(whole, ""), "", pc.binary_join_element_wise(whole, "", " "))
    return pc.ascii_split_whitespace(whole).cast(pa.list_(pa.binary()))


def words(text: str) -> list[bytes]:
    """The words of one text, and the end."""
    return split(pa.array([text], pa.string()))[0].as_py()


def listed(batch: pa.ListArray | list[list[bytes]]) -> pa.ListArray:
    return batch if isinstance(batch, pa.ListArray) else pa.array(batch, pa.list_(pa.binary()))


def lengths(batch: pa.ListArray) -> np.ndarray:
    return pc.list_value_length(batch).to_numpy(zero_copy_only=False).astype(np.int64)


def fold(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def counted(docs: DataFrame) -> DataFrame:
    """``word, c``: how often each word, and the end, occurs in ``docs``."""
    kind = arrow("word binary, n long")

    def run(batches):
        held, rows = [], 0
        for piece in pieces(batches, limit=TEXTS):
            found = split(piece.column("text")).flatten().value_counts()
            held.append(pa.table([found.field("values"), found.field("counts")], schema=kind))
            rows += len(found)
            if rows > 2 * HELD:
                held = [pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})]
                rows = held[0].num_rows
                if rows > HELD:
                    yield from held[0].to_batches()
                    held, rows = [], 0
        if held:
            yield from pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).to_batches()

    return texts(docs).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def rows_for(types: int) -> int:
    """Rows of weights for so many distinct words: a power of two."""
    return min(HASHED_MOST, max(HASHED, 1 << (max(1, -(-types // LOAD)) - 1).bit_length()))


def tree(c: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The way to each word of counts ``c`` (most frequent first) below the root, whose branches are ``group``: where
    it starts and ends in ``nodes`` and ``branches``, and the log shares of the branches of every node but the root."""
    nodes, branches, biases = [[0] for _ in c], [[g] for g in group.tolist()], []
    cuts = np.flatnonzero(np.diff(group)) + 1
    todo = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(c)], strict=True))
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        own = c[a:b]
        at = np.arange(b - a) if b - a <= CLASSES else np.minimum(((np.cumsum(own) - own / 2) / own.sum() * CLASSES).astype(np.int64), CLASSES - 1)
        held = np.bincount(at, weights=own, minlength=CLASSES)
        with np.errstate(divide="ignore"):
            biases.append(np.log(held / held.sum()))
        for i, k in enumerate(at.tolist(), a):
            nodes[i].append(len(biases))
            branches[i].append(k)
        cuts = np.flatnonzero(np.diff(at)) + 1 + a
        todo += zip([a, *cuts.tolist()], [*cuts.tolist(), b], strict=True)
    ends = np.cumsum([len(x) for x in nodes], dtype=np.int64)
    return ends, np.array([x for own in nodes for x in own], np.int64), np.array([x for own in branches for x in own], np.int64), biases


def summed(e: np.ndarray, source: np.ndarray, begin: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The sum of the rows ``source[begin : begin + times]`` of ``e``, for each of the groups; they have two or more."""
    order = np.argsort(-times, kind="stable")
    begin, times = begin[order], times[order]
    sums = np.take(e, source[begin], axis=0)
    # the groups that still have rows are the first ones; the few large groups are summed one by one
    large = int(np.count_nonzero(times > LARGE))
    for i in range(large):
        sums[i] = np.take(e, source[begin[i] : begin[i] + times[i]], axis=0).sum(0)
    for j in range(1, LARGE):
        left = int(np.count_nonzero(times > j))
        if left <= large:
            break
        sums[large:left] += np.take(e, source[begin[large:left] + j], axis=0)
    out = np.empty_like(sums)
    out[order] = sums
    return out


class Model:
    """What every task knows: frequent words, the ways to them and the weights."""

    def __init__(self, frequent: list[tuple[bytes, int]], tokens: int, types: int, rows: int | None = None):
        self.tokens, self.types = tokens, types
        self.known = pa.array([w for w, _ in frequent], pa.binary())
        c = np.array([n for _, n in frequent], np.float64)
        self.log_count = np.log10(c + 1)
        self.rest_tokens, self.rest_types = tokens - int(c.sum()), types - len(frequent)
        mass = (np.cumsum(c) - c / 2) / max(1.0, c.sum())
        group = np.minimum((mass * (CLASSES - 1)).astype(np.int64), CLASSES - 2)
        held = np.bincount(group, weights=c, minlength=CLASSES)
        held[-1] = self.rest_tokens
        ends, nodes, branches, biases = tree(c, group)
        # all words outside the vocabulary end at the root's last branch
        self.start = np.r_[0, ends]
        self.depth = np.diff(np.r_[self.start, len(nodes) + 1])
        self.nodes, self.branches = np.r_[nodes, 0], np.r_[branches, CLASSES - 1]
        self.bias = np.array([np.log((held + 0.5) / (held.sum() + 0.5 * CLASSES)), *biases], np.float32)
        self.weights = np.zeros((rows or HASHED, CLASSES), np.float32)

    def __getstate__(self):
        return self.__dict__

    @property
    def place(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.known.to_pylist())}

    def ids(self, batch: pa.ListArray | list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[dict[bytes, int]]]:
        """Places of all tokens, each document behind two starts (-1), which are tokens, and each document's words
        outside the vocabulary with how often they occur.  Such a word is ``len(known)`` plus a number of its ending."""
        batch = listed(batch)
        n, every, sizes = len(self.known), batch.flatten(), lengths(batch)
        ids, is_token = np.full(len(every) + 2 * len(sizes), -1, np.int64), np.ones(len(every) + 2 * len(sizes), bool)
        starts = np.cumsum(sizes + 2) - sizes - 2
        is_token[starts] = is_token[starts + 1] = False
        found = pc.index_in(every, value_set=self.known).fill_null(n).to_numpy(zero_copy_only=False).astype(np.int64)
        other = np.flatnonzero(found == n)
        rare = every.take(pa.array(other)).to_pylist()
        found[other] = [n + zlib.crc32(w[-2:]) % ENDINGS for w in rare]
        ids[is_token] = found
        cut = np.searchsorted(other, np.cumsum(sizes) - sizes).tolist()
        outside = [Counter(rare[a:b]) if a < b else {} for a, b in zip(cut, [*cut[1:], len(rare)], strict=True)] if cut else []
        return ids, is_token, outside

    def choices(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The choices on the way to each token, those at the root first: the token each belongs to, rows of weights,
        the node and the branch taken.  Rows come in three lots, each with one for every choice: of the word before, of
        the one before that, and of both words."""
        own = np.minimum(ids[at], len(self.known))
        start, below, n = self.start[own], self.depth[own] - 1, np.arange(len(at))
        token = np.r_[n, np.repeat(n, below)]
        way = np.r_[start, np.arange(below.sum()) + np.repeat(start + 1 - np.cumsum(below) + below, below)]
        node = self.nodes[way]
        one, two = ids[at - 1].astype(np.uint64) + np.uint64(2), ids[at - 2].astype(np.uint64) + np.uint64(2)
        one *= np.uint64(0x9E3779B97F4A7C15)
        two *= np.uint64(0xC2B2AE3D27D4EB4F)
        here = node.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
        h = np.concatenate([one[token] + here, two[token] + here + np.uint64(2), (one + two + np.uint64(1))[token] + here])
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return token, (h >> np.uint64(64 - len(self.weights).bit_length() + 1)).astype(np.int64), node, self.branches[way]

    def branch_scores(self, rows: np.ndarray, node: np.ndarray, out: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """The scores of all branches of the choices, ``BLOCK`` choices at a time, each block a part of ``out`` (or the
        whole of it, again and again, where it has no more rows than that)."""
        m, more = len(node), np.empty((min(BLOCK, len(node)), CLASSES), np.float32)
        for a in range(0, m, BLOCK):
            b = min(m, a + BLOCK)
            z, x = out[a:b] if len(out) >= m else out[: b - a], more[: b - a]
            # every place is within its table: "clip" only spares the copy that "raise" makes of the output
            self.weights.take(rows[a:b], axis=0, out=z, mode="clip")
            for table, at in ((self.weights, rows[m + a : m + b]), (self.weights, rows[2 * m + a : 2 * m + b]), (self.bias, node[a:b])):
                z += table.take(at, axis=0, out=x, mode="clip")
            # kept below the largest number a float can hold; weights of that size would need millions of steps
            np.minimum(z, 80, out=z)
            yield slice(a, b), z

    def score(self, batch: pa.ListArray | list[list[bytes]]) -> dict[str, list]:
        """For each document: tokens, known ones and log counts in the vocabulary, the model's part of the score,
        and the words outside with how often they occur."""
        batch = listed(batch)
        ids, is_token, outside = self.ids(batch)
        at, n, sizes = np.flatnonzero(is_token), len(self.known), lengths(batch)
        own, logs = ids[at], np.empty(len(at))
        held, places = np.empty((BLOCK, CLASSES), np.float32), np.arange(BLOCK) * CLASSES
        for i in range(0, len(at), STEP):
            token, rows, node, k = self.choices(ids, at[i : i + STEP])
            taken, total = np.empty(len(k), np.float32), np.empty(len(k), np.float32)
            for part, z in self.branch_scores(rows, node, held):
                taken[part] = z.ravel()[places[: len(z)] + k[part]]
                total[part] = np.exp(z, out=z) @ ONES
            logs[i : i + STEP] = np.bincount(token, weights=(taken - np.log(total)) / np.log(10))
        inside = own < n
        size = len(sizes)
        doc = np.repeat(np.arange(size), sizes)
        known = np.bincount(doc[inside], minlength=size)
        return {
            "n_tokens": sizes,
            "in_known": known,
            "in_log": np.bincount(doc[inside], weights=self.log_count[own[inside]], minlength=size),
            "model_log": np.bincount(doc, weights=logs, minlength=size),
            "words": [list(o) for o in outside],
            "times": [list(o.values()) for o in outside],
        }

    def train(self, batch: pa.ListArray | list[list[bytes]], seen: np.ndarray, energy: np.ndarray) -> None:
        """Gradient steps over the documents; ``seen`` and ``energy`` grow by how often and how strongly rows are met."""
        ids, is_token, _ = self.ids(batch)
        every, places = np.flatnonzero(is_token), np.arange(BLOCK) * CLASSES
        buffers = np.empty((2, BLOCK, CLASSES), np.float32)
        # a row of weights as one item: numpy puts items of any size, but rows only number by number
        whole = self.weights.view(ROW).ravel()
        for i in range(0, len(every), STEP):
            at = every[i : i + STEP]
            _, rows, node, k = self.choices(ids, at)
            e, norm = np.empty((len(k), CLASSES), np.float32), np.empty(len(k), np.float32)
            for part, z in self.branch_scores(rows, node, e):
                z *= (-1 / (np.exp(z, out=z) @ ONES))[:, None]
                z.ravel()[places[: len(z)] + k[part]] += 1
                norm[part] = np.einsum("ij,ij->i", z, z)
            # each row's choices side by side: row and choice in one number, which is sorted faster than places are
            order = np.sort((rows << 32).reshape(3, -1) | np.arange(len(k)), axis=None)
            found, source = order >> 32, order & 0xFFFFFFFF
            begin = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
            met, times, first = found[begin], np.diff(np.r_[begin, len(found)]), source[begin]
            seen[met] += times
            strength, often = norm[first], np.flatnonzero(times > 1)
            if len(often):
                sums = summed(e, source, begin[often], times[often])
                strength[often] = np.einsum("ij,ij->i", sums, sums)
            energy[met] = strength = energy[met] + strength
            rate = (RATE / np.sqrt(strength + 1))[:, None]
            # most rows are met once: what moves them is one choice's slope
            cut = np.searchsorted(often, np.arange(0, len(met) + BLOCK, BLOCK))
            for j, a in enumerate(range(0, len(met), BLOCK)):
                own = met[a : a + BLOCK]
                step, more = buffers[0][: len(own)], buffers[1][: len(own)]
                e.take(first[a : a + BLOCK], axis=0, out=step, mode="clip")
                some = slice(cut[j], cut[j + 1])
                if some.start < some.stop:
                    step[often[some] - a] = sums[some]
                step *= rate[a : a + BLOCK]
                step += self.weights.take(own, axis=0, out=more, mode="clip")
                whole.put(own, step.view(ROW).ravel(), mode="clip")


def moved(docs: DataFrame, model) -> DataFrame:
    """``part, rows, seen, moves``: what the tasks' steps over ``docs`` have changed, by part of the weights."""
    schema = "part int, rows binary, seen binary, moves binary"
    kind = arrow(schema)

    def run(batches):
        import copy

        own = copy.copy(model.value)
        start, own.weights = own.weights, own.weights.copy()
        hashed = len(start)
        seen, energy = np.zeros(hashed), np.zeros(hashed, np.float32)
        for piece in pieces(batches, limit=TEXTS):
            own.train(split(piece.column("text")), seen, energy)
        for a in range(0, hashed, ROWS):
            met = np.flatnonzero(seen[a : a + ROWS])
            if len(met):
                move = (own.weights[a + met] - start[a + met]).astype("<f2")
                yield pa.RecordBatch.from_pydict({"part": [a], "rows": [met.astype("<u2").tobytes()], "seen": [seen[a + met].astype("<f4").tobytes()], "moves": [move.tobytes()]}, schema=kind)

    return texts(docs).mapInArrow(run, schema)


def averaged(moves: DataFrame) -> DataFrame:
    """``part, rows, moves``: means by part, each part streamed through one task that holds its sums alone."""
    schema = "part int, rows binary, moves binary"
    kind = arrow(schema)

    def run(batches):
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                seen, move = sums.setdefault(row["part"], (np.zeros(ROWS), np.zeros((ROWS, CLASSES))))
                met, n = np.frombuffer(row["rows"], "<u2"), np.frombuffer(row["seen"], "<f4")
                seen[met] += n
                move[met] += n[:, None] * np.frombuffer(row["moves"], "<f2").reshape(-1, CLASSES)
        for part, (seen, move) in sums.items():
            met = np.flatnonzero(seen)
            mean = (move[met] / seen[met, None]).astype("<f4")
            yield pa.RecordBatch.from_pydict({"part": [part], "rows": [met.astype("<u2").tobytes()], "moves": [mean.tobytes()]}, schema=kind)

    return moves.repartition("part").mapInArrow(run, schema)


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The words above the lowest count that at most ``most`` words reach, most frequent first.

    A histogram of counts (exact below 10,000, then 1,000 steps to each doubling) finds that count, so that the
    driver gets those words alone and not the best of every task.
    """
    step = F.when(F.col("c") < 10_000, F.col("c")).otherwise(F.lit(10_000) + F.floor(F.log2(F.col("c") / 10_000) * 1000))
    held, least = 0, None
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect(), key=lambda r: -r["s"]):
        held += r["n"]
        if held > most:
            break
        least = r["c"]
    if least is None:
        return []
    found = counts.where(F.col("c") >= least).toArrow()
    return sorted(zip(found.column("word").to_pylist(), found.column("c").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))


def fit(docs: DataFrame, counts: DataFrame, vocabulary: int | None = None, rounds: int = ROUNDS) -> Model:
    """The model of ``docs``, whose word counts are ``counts``; every document is trained on in one of the rounds."""
    spark = docs.sparkSession
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    frequent = most_frequent(counts, vocabulary or VOCABULARY)
    model = Model(frequent, total["n"], total["v"], rows_for(total["v"]))
    tasks = max(spark.sparkContext.defaultParallelism, total["n"] // (rounds * TASK))
    for k in range(rounds if frequent else 0):
        own = docs.coalesce(tasks).where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == k)
        shared = spark.sparkContext.broadcast(model)
        for r in averaged(moved(own, shared)).collect():  # HASHED_MOST rows of weights at most
            model.weights[r["part"] + np.frombuffer(r["rows"], "<u2").astype(np.int64)] += np.frombuffer(r["moves"], "<f4").reshape(-1, CLASSES)
        shared.unpersist()
    return model


def scores(docs: DataFrame, train: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every whole text in ``docs``.

    ``base_score`` is the add-one estimate from the counts of ``train``, ``score`` the model's log10 probability.  A
    null text counts as empty and has the end alone; texts of any length are read whole.  Repeated rows stay repeated;
    an empty table gives an empty result; without training documents every token is unseen.  The model's score
    depends, in its last digits, on how rows fall into tasks, for each task trains on its own; ``base_score`` does not.
    Other columns are ignored.
    """
    counts = saved(counted(train), "word-counts")
    model = fit(train, counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by VOCABULARY and HASHED_MOST
    own = dict(docs.dtypes)["doc_id"]
    schema = f"row long, doc_id {own}, n_tokens long, in_known long, in_log double, model_log double, words array<binary>, times array<long>"
    kind = arrow(schema)

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for piece in pieces(batches, limit=TEXTS):
            n = piece.num_rows
            made = shared.value.score(split(piece.column("text")))
            yield pa.RecordBatch.from_pydict({"row": range(row, row + n), "doc_id": piece.column("doc_id")} | made, schema=kind)
            row += n

    rows = saved(texts(docs).mapInArrow(run, schema), "token-scores")
    rest = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    found = rest.join(counts, "word").groupBy("row").agg(F.sum("times").alias("out_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("out_log"))
    out = rows.drop("words", "times").withColumn("n_out", F.col("n_tokens") - F.col("in_known")).join(found, "row", "left").na.fill(0, ["out_known", "out_log"])
    base = F.col("in_log") + F.col("out_log") - F.col("n_tokens") * F.lit(float(np.log10(model.tokens + model.types + 1)))
    score = F.col("model_log") + F.col("out_log") - F.col("n_out") * F.lit(float(np.log10(model.rest_tokens + model.rest_types + 1)))
    return out.select("doc_id", "n_tokens", (F.col("in_known") + F.col("out_known")).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


def op4_maxent(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", spread=True)
    out = scores(docs, docs.where(~fold(F.col("doc_id"))))
    return out.select("doc_id", fold(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
