"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are the lower-cased words of a text, and the beginnings of ``PREFIXES`` letters that tell the labels apart, so
that inflected or compounded words of one stem meet.  All words of the examples are in the index.  A term's weight is
its logarithmic frequency in the text, times its inverse document frequency over all documents that may be learnt
from, times how significantly the labels of the examples differ with it: between ``FLOOR`` for a word that says
nothing and 1.

The examples are a bounded sample of labelled rows, sorted by how much of their weight is in telling terms and cut into
blocks.  A term's postings lie block by block, with its largest weight in each block.  From those a text gets an upper
bound of its cosine with any example of a block; the blocks of the highest bounds are opened first, then all whose
bound is not below the k-th best cosine, so the neighbours are exact.

Votes are weighed by the cosine's square; the share of toxic votes is then calibrated on the examples themselves, each scored
with its own vote left out.  The score also has evidence: the neighbours' ids.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, map_texts, pieces, table, texts

#: Bound of what is fitted: examples of each label.  It holds at every size of the corpus.
EXAMPLES = 1000
#: Neighbours that vote, examples in a block, blocks that are opened first, letters of a beginning.
NEIGHBOURS, BLOCK, FIRST, PREFIXES = 31, 64, 2, (4, 5, 6, 7)
#: Half of a term's significance: by chance one in e**12 terms has that log-likelihood ratio.  The least weight.
TELLING, FLOOR = 12.0, 0.05
#: A beginning is a term from this ratio on.
STEM = 9.0
#: From this score on a text is predicted toxic.
CUT = 0.3
#: Weight of a vote for the corpus at large in each text's ballot.
PRIOR = 0.05
WORD = re.compile(r"[^\W\d_]+")
#: Tokens in a worker's table before it is emptied.
TABLE_WORDS = 200_000


def terms(token: str) -> list[str]:
    """The terms of a token without white space: its words, and ``word*`` for beginnings."""
    out = []
    for w in WORD.findall(token.lower()):
        out.append(w)
        out += (w[:n] + "*" for n in PREFIXES if n <= len(w))
    return out


def term_counts(text: str) -> Counter:
    """Each term of a whole text with how often it occurs."""
    return Counter(t for token in text.split() for t in terms(token))


def ratio(others: int, toxic: int, share: float) -> float:
    """Log-likelihood ratio of a term that is in so many examples, over what ``share`` leads to expect; 0 below it."""
    n, q = others + toxic, toxic / max(1, others + toxic)
    if not 0 < share < 1 or q <= share:
        return 0.0
    return n * (q * math.log(q / share) + ((1 - q) * math.log((1 - q) / (1 - share)) if q < 1 else 0.0))


def significance(r: float) -> float:
    """A term's weight by its log-likelihood ratio: near ``FLOOR`` for what chance gives, towards 1 beyond it."""
    return FLOOR + (1 - FLOOR) * r**2 / (r**2 + TELLING**2)


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each run, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + size, size)


class Columns(dict):
    """The columns of a token's terms, for tokens met lately: little-endian 32-bit integers in one string of bytes."""

    def __init__(self, column: dict[str, int]):
        super().__init__()
        self.column = column
        self.heads = {t[: PREFIXES[0]] for t in column if t.endswith("*")}

    def __missing__(self, token: str) -> bytes:
        get, out = self.column.get, array("i")
        body = token.rstrip(".,;:!?").lower()
        for w in (body,) if body.isalpha() else WORD.findall(token.lower()):
            if (c := get(w)) is not None:
                out.append(c)
            if w[: PREFIXES[0]] in self.heads:
                out.extend(c for n in PREFIXES if n <= len(w) and (c := get(w[:n] + "*")) is not None)
        own = self[token] = out.tobytes()
        return own

    def of(self, tokens) -> np.ndarray:
        """The columns of all tokens, as often as they occur."""
        if len(self) > TABLE_WORDS:
            self.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, tokens)), np.int32)


@dataclass
class Index:
    """Examples as unit vectors over the terms, as postings by term and block, with block maxima."""

    #: Weight of each term, IDF and significance together.
    weights: dict[str, float]
    ids: list
    toxic: np.ndarray
    #: Postings: where those of each term and block begin, their examples and weights.
    begin: np.ndarray
    example: np.ndarray
    value: np.ndarray
    #: The largest weight of each term in each block.
    tops: np.ndarray
    knots: np.ndarray = field(default_factory=lambda: np.empty((0, 2)))

    @classmethod
    def build(cls, weights: dict[str, float], ids: list, toxic: np.ndarray, counts: list[dict[str, int]]) -> Index:
        """From each example's terms.  The order of examples is kept: it decides ties and blocks."""
        column, w = {t: i for i, t in enumerate(weights)}, np.fromiter(weights.values(), np.float64, len(weights))
        blocks = max(1, -(-len(ids) // BLOCK))
        at, doc, value = [], [], []
        for i, own in enumerate(counts):
            found = [(column[t], n) for t, n in own.items() if t in column]
            if found:
                c = np.array([x for x, _ in found])
                v = (1 + np.log([n for _, n in found])) * w[c]
                at.append(c)
                doc.append(np.full(len(c), i))
                value.append(v / math.sqrt(float(v @ v)))
        at, doc, value = (np.concatenate(x) if x else np.empty(0, k) for x, k in ((at, np.int64), (doc, np.int64), (value, np.float64)))
        cell = at * blocks + doc // BLOCK
        order = np.lexsort((doc, cell))
        begin = np.r_[0, np.cumsum(np.bincount(cell, minlength=len(weights) * blocks))].astype(np.int32)
        tops = np.zeros(len(weights) * blocks, np.float32)
        np.maximum.at(tops, cell, value)
        return cls(weights, list(ids), np.asarray(toxic, np.float64), begin, doc[order].astype(np.int32), value[order], tops.reshape(len(weights), blocks))

    @cached_property
    def column(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.weights)}

    @cached_property
    def weight(self) -> np.ndarray:
        return np.fromiter(self.weights.values(), np.float64, len(self.weights))

    @cached_property
    def known(self) -> Columns:
        return Columns(self.column)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("column", "weight", "known")}

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Columns and unit weights of a whole text; empty where it holds no term of the index."""
        at, n = np.unique(self.known.of(text.split()), return_counts=True)
        at = at.astype(np.int64)
        w = (1 + np.log(n)) * self.weight[at]
        return at, w / math.sqrt(float(w @ w) or 1.0)

    def cosines(self, at: np.ndarray, w: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Examples of ``blocks`` that share a term with the text, and their cosines."""
        n = self.tops.shape[1]
        if 2 * len(blocks) <= n:
            cell = (at[:, None] * n + blocks[None, :]).ravel()
            begin, end, own = self.begin[cell], self.begin[cell + 1], np.repeat(w, len(blocks))
        else:
            # a term's blocks lie one after the other: all are read, and those that are shut are left out
            begin, end, own = self.begin[at * n], self.begin[at * n + n], w
        place = _spread(begin, end - begin)
        sums = np.bincount(self.example[place], weights=self.value[place] * np.repeat(own, end - begin), minlength=len(self.ids))
        if 2 * len(blocks) > n:
            is_open = np.zeros(n, bool)
            is_open[blocks] = True
            sums *= np.repeat(is_open, BLOCK)[: len(sums)]
        found = np.flatnonzero(sums > 0)
        return found, sums[found]

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of the largest cosine (over 0), ties to the earlier: their places and cosines."""
        if not len(at) or not len(self.ids):
            return np.empty(0, np.int64), np.empty(0)
        bounds = w @ self.tops[at]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        places, cosines = self.best(*self.cosines(at, w, order[:FIRST]), k, leave)
        # a hair of slack, for the largest weights are kept with 24 bits and sums come in another order
        rest = order[FIRST:]
        rest = rest[bounds[rest] >= (cosines[-1] - 1e-5 if len(places) == k else 0)]
        if len(rest):
            more, cos = self.best(*self.cosines(at, w, rest), k, leave)
            places, cosines = self.best(np.r_[places, more], np.r_[cosines, cos], k, -1)
        return places, cosines

    @staticmethod
    def best(places: np.ndarray, cosines: np.ndarray, k: int, leave: int) -> tuple[np.ndarray, np.ndarray]:
        if leave >= 0:
            places, cosines = places[places != leave], cosines[places != leave]
        if len(places) > 4 * k:
            near = cosines >= np.partition(cosines, len(cosines) - k)[len(cosines) - k]
            places, cosines = places[near], cosines[near]
        order = np.lexsort((places, -cosines))[:k]
        return places[order], cosines[order]

    def share(self, places: np.ndarray, cosines: np.ndarray) -> float:
        """Share of toxic votes, one vote being its cosine squared; a text near nothing has only the corpus's vote."""
        base, votes = float(self.toxic.mean()) if len(self.toxic) else 0.0, cosines * cosines
        return (float(votes @ self.toxic[places]) + PRIOR * base * 0.1) / (float(votes.sum()) + PRIOR)

    def calibrate(self, counts: list[dict[str, int]], stands_for: tuple[float, float] = (1.0, 1.0)) -> None:
        """Monotone steps from share to frequency among the examples, each left out of its own vote.

        ``stands_for``: how many labelled rows an example without and with the label stands for.
        """
        raw = []
        for i, own in enumerate(counts):
            at = np.array(sorted(self.column[t] for t in own if t in self.column), np.int64)
            n = {self.column[t]: k for t, k in own.items() if t in self.column}
            w = (1 + np.log([n[c] for c in at.tolist()])) * self.weight[at] if len(at) else np.empty(0)
            raw.append(self.share(*self.nearest(at, w / max(1e-300, math.sqrt(float(w @ w))), leave=i)))
        # equal shares are one step; steps that fall are pooled
        steps: dict[float, list[float]] = {}
        for x, y in zip(np.round(raw, 9).tolist(), self.toxic.tolist(), strict=True):
            n, own = stands_for[int(y)], steps.setdefault(x, [0.0, 0.0])
            own[0] += y * n
            own[1] += n
        pools: list[list[float]] = []  # least and largest share, toxic weight, weight
        for x in sorted(steps):
            pools.append([x, x, *steps[x]])
            while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
                _, last, y, n = pools.pop()
                pools[-1][1] = last
                pools[-1][2] += y
                pools[-1][3] += n
        # half an example of each kind keeps scores off 0 and 1; a step is level, and only between steps lies a slope
        value = lambda y, n: (y + 0.5 * min(stands_for)) / (n + min(stands_for))
        self.knots = np.array([[x, value(y, n)] for first, last, y, n in pools for x in (first, last)]).reshape(-1, 2)

    def score(self, places: np.ndarray, cosines: np.ndarray) -> float:
        raw = self.share(places, cosines)
        if not len(self.knots):
            return raw
        return float(np.interp(raw, self.knots[:, 0], np.maximum.accumulate(self.knots[:, 1])))


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def term_ratios(counts: list[Counter], bodies: list[str], toxic: list[float]) -> dict[str, float]:
    """The log-likelihood ratio of each term of the examples; copies of one text are one witness."""
    witnesses = {text: (c, t) for text, c, t in zip(bodies, counts, toxic, strict=True)}
    share = sum(t for _, t in witnesses.values()) / max(1, len(witnesses))
    seen: dict[str, list[int]] = {}
    for c, t in witnesses.values():
        for term in c:
            seen.setdefault(term, [0, 0])[int(t)] += 1
    return {t: ratio(a, b, share) for t, (a, b) in seen.items()}


def model(rows: list[tuple], ratios: dict[str, float], idf: dict[str, float], stands_for: tuple[float, float]) -> Index:
    """The index of ``rows``: id, label and terms of each example."""
    weights = {t: idf[t] * significance(ratios[t]) for t in idf}
    telling = [sum(n > 0 and ratios[t] >= STEM for t, n in c.items() if t in weights) / max(1, len(c)) for _, _, c in rows]
    order = sorted(range(len(rows)), key=lambda i: (-telling[i], i))
    ids, toxic, counts = zip(*(rows[i] for i in order), strict=True) if rows else ((), (), ())
    index = Index.build(weights, list(ids), np.array(toxic, np.float64), list(counts))
    index.calibrate(list(counts), stands_for)
    return index


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Index:
    """The index of up to ``examples`` rows of each label that may be learnt from, chosen by a hash of their id.

    Document frequencies of the terms are counted over all documents that may be learnt from.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"))
    pick = F.xxhash64("_id")
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = known.where("toxic = 1").orderBy(pick, "_id").limit(examples).union(known.where("toxic = 0").orderBy(pick, "_id").limit(examples))
    toxic = {r["_id"]: r["toxic"] for r in chosen.collect()}  # 2 * examples rows at most
    rows = texts(docs).where(F.col("doc_id").isin(list(toxic))).groupBy("doc_id").agg(F.min("text").alias("text")).collect() if toxic else []
    rows.sort(key=lambda r: r["doc_id"])
    counts = [term_counts(r["text"]) for r in rows]
    y = [float(toxic[r["doc_id"]]) for r in rows]
    ratios = term_ratios(counts, [r["text"] for r in rows], y)
    idf = frequencies(docs, sorted(t for t, r in ratios.items() if not t.endswith("*") or r >= STEM))
    stands_for = tuple(total.get(k, 0) / max(1, sum(x == k for x in y)) for k in (0, 1))
    return model([(r["doc_id"], t, c) for r, t, c in zip(rows, y, counts, strict=True)], ratios, idf, stands_for)


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """Inverse document frequencies of the examples' terms over all documents that may be learnt from.

    A task counts all its documents before it hands the counts on, so at most as many rows as terms leave it.
    """
    schema = "term long, n long"
    kind, shared = arrow(schema), docs.sparkSession.sparkContext.broadcast(vocabulary)  # terms of EXAMPLES texts

    def run(batches):
        known = Columns({t: i for i, t in enumerate(shared.value)})
        n = np.zeros(len(known.column) + 1, np.int64)
        for piece in pieces(batches):
            for text in piece.column("text").to_pylist():
                n[-1] += 1
                n[np.unique(known.of(set(text.split())))] += 1
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"term": some, "n": n[some]}, schema=kind)

    counted = texts(docs).where(~held_out(F.col("doc_id"))).mapInArrow(run, schema)
    n = dict(zip(*(c.to_pylist() for c in counted.groupBy("term").agg(F.sum("n").alias("n")).toArrow().columns), strict=True))  # a row for each term
    total = n.get(len(vocabulary), 0)
    return {t: math.log((1 + total) / (1 + n.get(i, 0))) + 1 for i, t in enumerate(vocabulary)}


def scored(docs: DataFrame, index: Index, cut: float = CUT) -> DataFrame:
    """``doc_id, held_out, score, predicted, neighbours`` (ids of the labelled examples that voted).

    A null text counts as empty; a text that shares no term with any example gets the score of no votes; texts of any
    length are read whole.  Repeated rows stay repeated; an empty table gives an empty result; without labelled rows
    every score is 0.  Other columns are ignored.
    """

    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by EXAMPLES texts

    def work(piece):
        own = shared.value
        near = [own.nearest(*own.vector(t)) for t in piece.column("text").to_pylist()]
        score = [own.score(*x) for x in near]
        return {"doc_id": piece.column("doc_id"), "score": score, "predicted": [int(x >= cut) for x in score], "neighbours": [[own.ids[i] for i in p] for p, _ in near]}

    kind = dict(docs.dtypes)["doc_id"]
    out = map_texts(texts(docs), work, f"doc_id {kind}, score double, predicted int, neighbours array<{kind}>")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", "neighbours")


def clean(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The documents that are not rejected, with all their columns, in one pass over them; nulls, empty tables and
    repeated rows are taken as in ``scored``, so a row whose text is null or empty stays unless empty texts are toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @F.pandas_udf("boolean")
    def ok(text):
        own = shared.value
        return text.fillna("").map(lambda t: own.score(*own.nearest(*own.vector(t))) < cut)

    return docs.where(ok("text"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", spread=True)
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
