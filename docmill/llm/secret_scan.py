"""Secret scan: fixed patterns, and a guess-cost search over values in a credential context.

The cost of a value is the least number of guesses (as a power of ten) over all ways to cut it into dictionary
words, dates, repeats, keyboard walks and brute-force spans: a shortest path over its positions, where every segment
of a kind, at whatever place, is an edge.  Values named like a credential whose cheapest cut still costs ``THRESHOLD``
powers of ten are reported as ``guess`` spans beside the fixed patterns.  A document is one row and never leaves its
task, so nothing shuffles and a lost executor only repeats its own rows.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from functools import lru_cache

from pyspark.sql import DataFrame

from .bpe import vocabulary
from .common import map_texts, table, texts

#: Fixed patterns, in the order that breaks ties, with the least length of what they must hold.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "guess")
#: What every match of ASSIGN or CONTEXT holds at least one of, in lower case.
ANNOUNCE = ("passw", "secret", "token", "key", "pwd", "passphrase", "passcode", "credential", "bearer", "authorization")
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pwd|passphrase|passcode|credentials?|authorization|bearer|password|passwd|secret|token|(?:private|access|api)[_-]?key)["']?[ \t]*(?:[:=][ \t]*|(?<=bearer)[ \t]+)(?:bearer[ \t]+|basic[ \t]+)?["']?([^\s"'<>]{8,})""",
    re.ASCII | re.IGNORECASE,
)
#: Powers of ten that make a value a secret.
THRESHOLD = 10.0
#: Common words of passwords, most common first: fixed values.
COMMON = (
    "password 123456 qwerty letmein admin welcome monkey dragon master login hello freedom whatever trustno secret "
    "summer winter spring autumn sunshine princess shadow football baseball superman batman michael jordan test user "
    "root pass changeme default guest token key api example value your string none null true false name here insert "
    "the and for with this that from have will you are not use all can one see out new get put set"
).split()
#: Rows of a keyboard; the keys of a walk are neighbours.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
PLAIN = str.maketrans("4@301!5$7", "aaeoiisst")
#: Dates, and how many there are of each form.
DATES = (
    (re.compile(r"(?:19|20)[0-9]{2}([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])"), 365 * 120),
    (re.compile(r"(?:0[1-9]|[12][0-9]|3[01])([-/._]?)(?:0[1-9]|1[0-2])\1(?:19|20)[0-9]{2}"), 365 * 120),
    (re.compile(r"(?:19|20)[0-9]{2}"), 120),
)
#: A brute-force span pays for its alphabet; and each further segment for the order of segments.
ALPHABETS = ((re.compile(r"[0-9]"), 10), (re.compile(r"[a-z]"), 26), (re.compile(r"[A-Z]"), 26), (re.compile(r"[^0-9A-Za-z]"), 33))
SEGMENT = 0.5
#: Lengths of blocks whose repeats are one segment; of the shortest walk; guesses of a walk's key, price of a turn.
PERIODS, WALK, KEYS, TURN = (1, 2, 3, 4), 3, 47, 0.6
#: Letters of the words taken from a vocabulary.
WORD_LETTERS = (3, 16)


@lru_cache(maxsize=1)
def _near() -> dict[str, set[str]]:
    """The neighbours of each key: beside it, or above and below."""
    at = {c: (y, x + y / 2) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
    return {a: {b for b, (v, u) in at.items() if b != a and abs(v - y) <= 1 and abs(u - x) <= 1} for a, (y, x) in at.items()}


def _runs(value: str, joins, period: int = 1) -> list[int]:
    """For each position, where the run that holds it ends: characters ``period`` apart are ``joins``-ed all along."""
    n = len(value)
    out, end = [0] * n, n
    for i in range(n - 1, -1, -1):
        if i + period < n and not joins(value[i], value[i + period]):
            end = i + period
        out[i] = end
    return out


class Starts:
    """Places where a run's segment may begin, of which only those that can still be the cheapest are kept.

    The segment from one of them to ``j`` costs what it has cost to get there and the logarithm of its length, so an
    earlier start that is dearer than a later one is of no use any more, and a later one never is if the earlier one,
    longer by so much, is still cheaper at the later one's shortest segment: from there on it stays so.
    """

    def __init__(self, least: int):
        self.least, self.end, self.held = least, -1, []

    def add(self, end: int, at: int, cost: float) -> None:
        if end != self.end:
            self.end, self.held = end, []
        self.held = held = [x for x in self.held if x[1] < cost]
        if all(c + math.log10((self.least + at - i) / self.least) > cost for i, c in held):
            held.append((at, cost))

    def cheapest(self, at: int) -> float:
        return min(c + math.log10(at - i) for i, c in self.held)


def _lower(value: str) -> str:
    """In lower case, character by character, so that places stay the same."""
    return value.lower() if value.isascii() else "".join(x if len(x := c.lower()) == 1 else c for c in value)


def guess_cost(value: str, words: dict[str, int] | None = None) -> float:
    """The least power of ten of guesses over all cuts of ``value``; 0 for an empty one.

    A position has two costs, for cuts that end in a brute-force span (which may go on without the price of a new
    segment) and for others.  Words are bounded by the longest of the dictionary, dates by their form; repeats and
    walks may begin and end anywhere in their run.  The time is about linear in the length.
    """
    n, ranks = len(value), dictionary() if words is None else words
    longest, low, near = _longest(ranks), _lower(value), _near()
    plain = low.translate(PLAIN)
    size = sum(k for has, k in ALPHABETS if has.search(value))
    each = math.log10(max(size, 10))
    repeats = ((p, _runs(low, lambda a, b: a == b, p)) for p in PERIODS)
    runs = [(p, ends, 3 if p == 1 else 2) for p, ends in repeats if any(e - i >= max(3, 2 * p) for i, e in enumerate(ends))]
    starts = {p: [Starts(least) for _ in range(p)] for p, _, least in runs}
    walk = _runs(low, lambda a, b: b in near.get(a, ()))
    walks = Starts(WALK) if any(e - i >= WALK for i, e in enumerate(walk)) else None
    # turns of a walk before each place
    turns = [0, 0]
    for a, b, c in zip(low, low[1:], low[2:]):
        turns.append(turns[-1] + (ord(b) - ord(a) != ord(c) - ord(b)))
    free, brute = [0.0] + [math.inf] * n, [math.inf] * (n + 1)
    best = [0.0] + [math.inf] * n
    for i in range(n + 1):
        for p, ends, least in runs:
            begin = i - least * p
            if begin >= 0 and ends[begin] >= i:
                own = starts[p][i % p]
                own.add(ends[begin], begin // p, best[begin])
                free[i] = min(free[i], own.cheapest(i // p) + p * each + SEGMENT)
        if walks and i >= WALK and walk[i - WALK] >= i:
            walks.add(walk[i - WALK], i - WALK, best[i - WALK] - TURN * turns[i - WALK + 1])
            free[i] = min(free[i], walks.cheapest(i) + math.log10(KEYS) + TURN * turns[i - 1] + SEGMENT)
        here = best[i] = min(free[i], brute[i])
        if i == n:
            break
        brute[i + 1] = min(brute[i], free[i] + SEGMENT) + each
        for j in range(i + 3, min(i + longest, n) + 1):
            part = low[i:j]
            rank = ranks.get(part, 0)
            if plain[i:j] != part and (other := 4 * ranks.get(plain[i:j], 0)):
                rank = min(rank or other, other)
            if rank:
                free[j] = min(free[j], here + math.log10(rank + 1) + (0 if value[i:j] == part else 0.5) + SEGMENT)
        if value[i] in "0123456789":
            for form, many in DATES:
                if found := form.match(value, i):
                    free[found.end()] = min(free[found.end()], here + math.log10(many) + SEGMENT)
    return best[n]


@lru_cache(maxsize=4)
def dictionary(path: str | None = None) -> dict[str, int]:
    """Ranks of words, most common first: ``COMMON``, then the words of a public vocabulary file of the word-end kind
    in the order of its ids, which is that of its merges and so about that of how common they are."""
    words = list(COMMON)
    if path:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end = model["end_of_word_suffix"]
        names = (t.removesuffix(end) for t in sorted(model["vocab"], key=model["vocab"].get) if t.endswith(end))
        words += (w for w in names if w.isascii() and w.isalpha() and WORD_LETTERS[0] <= len(w) <= WORD_LETTERS[1])
    return {w: i + 1 for i, w in enumerate(dict.fromkeys(words))}


_lengths: dict[int, tuple[dict, int]] = {}


def _longest(ranks: dict[str, int]) -> int:
    """Letters of the longest word, kept for the last dictionary used."""
    held = _lengths.get(0)
    if held is None or held[0] is not ranks:
        held = _lengths[0] = (ranks, max(map(len, ranks), default=0))
    return held[1]


def find(text: str, threshold: float = THRESHOLD, words: dict[str, int] | None = None) -> list[tuple[int, int, str, float]]:
    """``(start, end, kind, cost)`` of every secret of a whole text, by start, then kind.

    ``start`` and ``end`` count code points.  Within one kind spans are the leftmost that do not overlap; a
    ``guess`` span that lies within one of the fixed patterns' spans is the same secret and not told twice.
    """
    low, out = text.lower(), []
    if any(w in low for w in ANNOUNCE):
        out += ((*m.span(), "assign", guess_cost(m[2], words)) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST)
        for m in CONTEXT.finditer(text):
            if (cost := guess_cost(value := m[1].rstrip(".,;:!?)]}"), words)) >= threshold:
                out.append((m.start(1), m.start(1) + len(value), "guess", cost))
    if "AKIA" in text:
        out += ((*m.span(), "access", guess_cost(m[0], words)) for m in ACCESS.finditer(text))
    out += ((*m.span(), "hex", guess_cost(m[0], words)) for m in HEX.finditer(text))
    kept, reached = [], -1
    for x in sorted(out, key=lambda x: (x[0], KINDS.index(x[2]))):
        # fixed patterns that begin no later and end no earlier hold the same secret
        if x[2] != "guess" or x[1] > reached:
            kept.append(x)
        if x[2] != "guess":
            reached = max(reached, x[1])
    return kept


def secrets(docs: DataFrame, threshold: float = THRESHOLD, words: dict[str, int] | None = None) -> DataFrame:
    """One row per secret: ``doc_id, kind, start, end, value, guess_log10``."""

    def work(piece, threshold, words):
        out = {k: [] for k in ("doc_id", "kind", "start", "end", "value", "guess_log10")}
        for doc, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), strict=True):
            for a, b, kind, cost in find(text, threshold, words):
                for k, v in zip(out, (doc, kind, a, b, text[a:b], cost), strict=True):
                    out[k].append(v)
        return out

    return map_texts(texts(docs), work, f"doc_id {dict(docs.dtypes)['doc_id']}, kind string, start long, end long, value string, guess_log10 double", threshold, words)


def scan(docs: DataFrame, threshold: float = THRESHOLD, words: dict[str, int] | None = None) -> DataFrame:
    """One row per document: counts by kind, the digest of the fixed patterns' spans, and all spans as text.

    A null text counts as empty and holds nothing: zero counts, the digest of an empty string, empty ``spans``.
    Texts of any length are read whole, and a span may be as long as its text.
    Repeated rows stay repeated; an empty table gives an empty result; other columns are ignored.
    """

    def work(piece, threshold, words):
        out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "max_guess_log10")}
        for text in piece.column("text").to_pylist():
            found = find(text, threshold, words)
            told = lambda x: ",".join(f"{kind}:{a}:{b}" for a, b, kind, _ in x)
            for kind in KINDS:
                out[f"n_{kind}"].append(sum(x[2] == kind for x in found))
            out["base_sha256"].append(hashlib.sha256(told(x for x in found if x[2] != "guess").encode()).hexdigest())
            out["spans"].append(told(found))
            out["max_guess_log10"].append(max((x[3] for x in found), default=None))
        return {"doc_id": piece.column("doc_id")} | out

    return map_texts(
        texts(docs),
        work,
        f"doc_id {dict(docs.dtypes)['doc_id']}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, max_guess_log10 double",
        threshold,
        words,
    )


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents", spread=True), words=dictionary(vocabulary("word_bpe_49k.json")))
