"""Small helpers on one pair of texts: word scripts and the heaviest order-keeping match.  Tasks call them row by row."""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Hashable, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A word, or one other character: so white space is kept to the letter and every script restores both texts.
TOKEN = re.compile(r"\w+|\W", re.UNICODE)
#: Changed tokens up to which the shortest script of a gap is searched; in a longer one unique tokens are anchors first.
MOST_CHANGES = 400


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text or "")


def anchors(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int]]:
    """Places of elements that are unique on both sides, as the longest run of them that is in order on both."""
    once_a, once_b = ({x for x, n in Counter(s).items() if n == 1} for s in (a, b))
    place = {x: i for i, x in enumerate(b) if x in once_b}
    pairs = [(i, place[x]) for i, x in enumerate(a) if x in once_a and x in place]
    # patience: the last element of the best run of each length, and what came before it
    ends: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(ends, j)
        before[k] = at[n - 1] if n else -1
        ends[n : n + 1], at[n : n + 1] = [j], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _shortest(a: Sequence[str], b: Sequence[str], most: int) -> tuple[list[tuple[int, int]], int, int]:
    """The kept places of a shortest script, by furthest-reaching paths, and how far it goes in both: to their ends, or after
    ``most`` changes as far as any such path."""
    zero, trail = min(most, len(a) + len(b)) + 1, []
    reach = [0] * (2 * zero + 1)
    for d in range(zero):
        # diagonals -d - 1 to d + 1, as they were before this change
        trail.append(array("i", reach[zero - d - 1 : zero + d + 2]))
        for k in range(-d, d + 1, 2):
            at = zero + k
            x = reach[at + 1] if k == -d or (k != d and reach[at - 1] < reach[at + 1]) else reach[at - 1] + 1
            y = x - k
            while x < len(a) and y < len(b) and a[x] == b[y]:
                x, y = x + 1, y + 1
            reach[at] = x
            if x >= len(a) and y >= len(b):
                return _walk_back(trail, x, y), x, y
    ends = [(reach[zero + k], reach[zero + k] - k) for k in range(-most, most + 1, 2)]
    x, y = max((e for e in ends if e[0] <= len(a) and 0 <= e[1] <= len(b)), key=sum)
    return _walk_back(trail, x, y), x, y


def _walk_back(trail: list[array], x: int, y: int) -> list[tuple[int, int]]:
    kept = []
    for d in range(len(trail) - 1, -1, -1):
        reach, k, zero = trail[d], x - y, d + 1
        last = k + 1 if k == -d or (k != d and reach[zero + k - 1] < reach[zero + k + 1]) else k - 1
        to_x = reach[zero + last] if d else 0
        to_y = to_x - last if d else 0
        while x > to_x and y > to_y:
            x, y = x - 1, y - 1
            kept.append((x, y))
        x, y = to_x, to_y
    return kept[::-1]


def kept_places(a: Sequence[str], b: Sequence[str], most: int = MOST_CHANGES) -> list[tuple[int, int]]:
    """Places (in ``a``, in ``b``) of the elements that stay.

    Equal ends are set aside.  What is left gets a shortest script if that has ``most`` changes or fewer; else it is cut
    at the elements unique on both sides, and each gap is taken in the same way.  In a gap without such elements the path
    that has come farthest after ``most`` changes is kept, and the search begins anew from there, so the work is bounded
    by the length times ``most``.
    """
    most = max(1, most)
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        own_a, own_b = a[a0:a1], b[b0:b1]
        found, x, y = _shortest(own_a, own_b, most)
        cuts = anchors(own_a, own_b) if (x, y) != (len(own_a), len(own_b)) else []
        if not cuts:
            out += ((a0 + i, b0 + j) for i, j in found)
            todo.append((a0 + x, a1, b0 + y, b1))
            continue
        last = (a0, b0)
        for i, j in cuts:
            out.append((a0 + i, b0 + j))
            todo.append((last[0], a0 + i, last[1], b0 + j))
            last = (a0 + i + 1, b0 + j + 1)
        todo.append((last[0], a1, last[1], b1))
    return sorted(out)


def script(old: str | None, new: str | None, most: int = MOST_CHANGES) -> list[tuple[str, str]]:
    """``(op, text)`` spans in order: ``keep``, ``delete`` and ``insert``.  Kept and deleted spans make the old text, kept
    and inserted ones the new one."""
    a, b = tokens(old), tokens(new)
    out: list[tuple[str, list[str]]] = []

    def add(op: str, some: list[str]) -> None:
        if some and out and out[-1][0] == op:
            out[-1][1].extend(some)
        elif some:
            out.append((op, list(some)))

    x = y = 0
    for i, j in [*kept_places(a, b, most), (len(a), len(b))]:
        add("delete", a[x:i])
        add("insert", b[y:j])
        add("keep", a[i : i + 1])
        x, y = i + 1, j + 1
    return [(op, "".join(own)) for op, own in out]


def errors_inside(wanted: Sequence[str], text: Sequence[str], most: int) -> int | None:
    """The least number of elements to insert, delete or replace that turn some run of ``text`` into ``wanted``; None if more
    than ``most``.  Columns that cannot end within the bound are not computed further, so the work is about the length of
    ``text`` times ``most``."""
    n, best = len(wanted), most + 1
    # before any element of the text, and so at every place, the run may begin
    column, last = list(range(n + 1)), min(n, most)
    if n <= most:
        best = n
    for x in text:
        corner, column[0], top = column[0], 0, 0
        for i in range(1, min(n, last + 1) + 1):
            # what lies below the last live cell counts as beyond the bound
            left = column[i] if i <= last else most + 1
            cell = min(corner + (wanted[i - 1] != x), column[i - 1] + 1, left + 1)
            corner, column[i] = left, cell
            if cell <= most:
                top = i
        last = top
        if last == n:
            best = min(best, column[n])
    return best if best <= most else None


def heaviest(pairs: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Of ``(i, j, weight)`` the chain that rises in both and weighs most; of equal ones an earliest.

    Chains are kept in a tree of prefix maxima over j, so p pairs take p log p steps and nothing of size i times j is made.
    """
    if not pairs:
        return []
    pairs = sorted(pairs, key=lambda p: (p[0], -p[1]))
    size = max(j for _, j, _ in pairs) + 1
    best: list[tuple[float, int]] = [(0.0, -1)] * (size + 1)
    before = []
    for k, (_, j, weight) in enumerate(pairs):
        top, at = (0.0, -1), j
        while at > 0:
            top = max(top, best[at], key=lambda t: t[0])
            at -= at & -at
        before.append(top[1])
        mine, at = (top[0] + weight, k), j + 1
        while at <= size:
            if mine[0] > best[at][0]:
                best[at] = mine
            at += at & -at
    top, at = (0.0, -1), size
    while at > 0:
        top = max(top, best[at], key=lambda t: t[0])
        at -= at & -at
    out, k = [], top[1]
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def alike(a: Sequence[str], b: Sequence[str], least: float) -> list[tuple[int, int, float]]:
    """``(i, j, similarity)`` of every pair of texts whose words overlap enough: twice the words in common (with how often)
    over the words of both.

    A text's words are ordered from the rarest; two texts that are alike share one among the first few of each, so common
    words do not bring every text together with every other.
    """
    bags = [[Counter(w.lower() for w in TOKEN.findall(t) if w.isalnum()) for t in side] for side in (a, b)]
    held = Counter(w for side in bags for bag in side for w in bag)

    def first(bag: Counter) -> list[tuple[str, int]]:
        every = sorted((held[w], w, k) for w, n in bag.items() for k in range(n))
        return [(w, k) for _, w, k in every[: len(every) - ceil(least / (2 - least) * len(every) - 1e-9) + 1]]

    where: dict[tuple[str, int], list[int]] = defaultdict(list)
    for j, bag in enumerate(bags[1]):
        for x in first(bag):
            where[x].append(j)
    sizes, out = [sum(bag.values()) for bag in bags[1]], []
    for i, bag in enumerate(bags[0]):
        size = sum(bag.values())
        for j in sorted({j for x in first(bag) for j in where.get(x, ())}):
            common = sum(min(n, bags[1][j][w]) for w, n in bag.items())
            if 2 * common >= least * (size + sizes[j]):
                out.append((i, j, 2 * common / (size + sizes[j])))
    return out


def aligned(old: Sequence[str], new: Sequence[str], least: float = 0.5) -> list[tuple[int | None, int | None, float]]:
    """Rows ``(old place, new place, similarity)`` of two sequences of texts, in reading order; equal texts have 1.

    Equal texts that are unique on both sides and in order are anchors.  Between them the match weighs most in which
    equal texts count 1 and others their similarity, if that is ``least`` or more.  What has no partner stands alone.
    """
    match: list[tuple[int, int, float]] = []
    a0 = b0 = 0
    for i, j in [*anchors(old, new), (len(old), len(new))]:
        own, other = old[a0:i], new[b0:j]
        pairs = {(x, y): s for x, y, s in alike(own, other, least)}
        at: dict[str, list[int]] = defaultdict(list)
        for y, t in enumerate(other):
            at[t].append(y)
        pairs |= {(x, y): 1.0 + 1e-6 for x, t in enumerate(own) for y in at.get(t, ())}
        match += ((a0 + x, b0 + y, min(1.0, s)) for x, y, s in heaviest([(x, y, s) for (x, y), s in pairs.items()]))
        if i < len(old):
            match.append((i, j, 1.0))
        a0, b0 = i + 1, j + 1
    out: list[tuple[int | None, int | None, float]] = []
    x = y = 0
    for i, j, s in [*match, (len(old), len(new), 0.0)]:
        out += ((k, None, 0.0) for k in range(x, i))
        out += ((None, k, 0.0) for k in range(y, j))
        if i < len(old):
            out.append((i, j, s))
        x, y = i + 1, j + 1
    return out


def packed(lengths: Sequence[int], begins: Sequence[int], most: int) -> list[tuple[int, int, int | None]]:
    """``(start, stop, part)`` of chunks of at most ``most`` over elements of ``lengths``: whole sections, which start at
    ``begins``, as many as fit; a section that does not fit is cut at elements, and numbers its chunks as parts."""
    cuts = sorted({0, *begins, len(lengths)})
    out: list[tuple[int, int, int | None]] = []
    start, held = 0, 0
    for a, b in zip(cuts, cuts[1:], strict=False):
        size = sum(lengths[a:b])
        if held + size > most and a > start:
            out.append((start, a, None))
            start, held = a, 0
        if size <= most:
            held += size
            continue
        part = 1
        for i in range(a, b):
            if held + lengths[i] > most and i > start:
                out.append((start, i, part))
                start, held, part = i, 0, part + 1
            held += lengths[i]
        out.append((start, b, part))
        start, held = b, 0
    return out if start == len(lengths) else [*out, (start, len(lengths), None)]


def on_cycles(edges: Sequence[tuple[int | None, int | None]]) -> list[bool]:
    """For each edge whether it lies on a way back to where it starts.  Edges from or to nowhere do not.

    Two searches, forwards in the order of finishing and backwards, tell which nodes reach each other.
    """
    there = [(a, b) for a, b in edges if a is not None and b is not None]
    to, back = defaultdict(list), defaultdict(list)
    for a, b in there:
        to[a].append(b)
        back[b].append(a)
    done, seen = [], set()
    for root in list(to):
        todo = [(root, iter(to[root]))] if root not in seen else []
        seen.add(root)
        while todo:
            node, rest = todo[-1]
            step = next((x for x in rest if x not in seen), None)
            if step is None:
                done.append(node)
                todo.pop()
            else:
                seen.add(step)
                todo.append((step, iter(to.get(step, ()))))
    group: dict[int, int] = {}
    for root in reversed(done):
        todo = [root] if root not in group else []
        while todo:
            node = todo.pop()
            if node not in group:
                group[node] = root
                todo += (x for x in back.get(node, ()) if x not in group)
    return [a is not None and b is not None and group[a] == group[b] for a, b in edges]


def _order(label: str) -> list[tuple[int, str]]:
    """Labels in the order of their numbers, of any length: 5.2 before 5.10."""
    return [(len(n), n) for n in (part.lstrip("0") for part in label.split("."))]


def referred(labels: Sequence[dict], refs: Sequence[dict]) -> list[tuple]:
    """``from_line, from_label, ref, style, to_label, to_line, cyclic`` of each place that a reference points at.

    ``labels``: ``style, label, line``; ``refs``: ``line, style, ref, first, last``.  Labels are sorted once, by number for
    each style and by line, and looked up by halving.
    """
    by_line = sorted((x["line"], x["label"]) for x in labels)
    lines = [line for line, _ in by_line]
    own: dict[str, list[dict]] = defaultdict(list)
    for x in labels:
        own[x["style"]].append(x)
    sorted_own = {style: sorted(((_order(x["label"]), x["label"], x["line"]) for x in xs), key=lambda t: t[0]) for style, xs in own.items()}
    orders = {style: [t[0] for t in xs] for style, xs in sorted_own.items()}
    names = {style: {x["label"] for x in xs} for style, xs in own.items()}
    out, pairs = [], []
    for r in refs:
        style, first, last = r["style"], _order(r["first"]), _order(r["last"])
        keys = orders.get(style, [])
        inside = [(label, line) for _, label, line in sorted_own.get(style, [])[bisect_left(keys, first) : bisect_right(keys, last)]]
        lost = [(end, None) for end in dict.fromkeys((r["first"], r["last"])) if first > last or end not in names.get(style, ())]
        at = bisect_right(lines, r["line"]) - 1
        from_line, from_label = by_line[at] if at >= 0 else (None, None)
        for label, line in inside + lost:
            out.append((r["line"], from_label, r["ref"], style, label, line))
            pairs.append((from_line, line))
    return [(*x, c) for x, c in zip(out, on_cycles(pairs), strict=True)]


def reached(starts: Sequence, edges: Sequence[tuple]) -> dict:
    """The length of the shortest way from any of ``starts`` to each node; ``edges``: from, to."""
    to = defaultdict(list)
    for a, b in edges:
        to[a].append(b)
    depth = dict.fromkeys(starts, 0)
    todo = list(depth)
    for node in todo:  # grows as it is read
        for x in to.get(node, ()):
            if x not in depth:
                depth[x] = depth[node] + 1
                todo.append(x)
    return depth


#: Words in this share of the sets, and this many at most, are counted by products of matrices; sets asked at a time.
COMMON_SHARE, COMMON_WORDS, ASKED_AT_ONCE = 0.04, 1024, 128


def _words_of(sets: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the sets, and which set each is of."""
    lists = pc.split_pattern(sets, " ")
    words, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    there = pc.not_equal(words, "")
    return words.filter(there), rows.filter(there).to_numpy()


def most_alike(asked: pa.Array, held: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each set of words the place of the one in ``held`` that it is most like, the first of equal ones, and the share
    of words in common (0 if both are empty).  A set is a text: its words, each once, with blanks between.

    Words that many sets of ``held`` have are columns of a matrix, of the others each has the list of its sets, and words
    that are nowhere in ``held`` cost nothing.
    """
    n = len(held)
    words, rows = _words_of(held)
    sizes, words = np.bincount(rows, minlength=n), words.dictionary_encode()
    ids, dictionary = words.indices.to_numpy(), words.dictionary
    known = len(dictionary)
    often = np.bincount(ids, minlength=known)
    common = np.argsort(-often, kind="stable")[:COMMON_WORDS]
    common = common[often[common] > COMMON_SHARE * n]
    column = np.full(known, -1)
    column[common] = np.arange(len(common))
    dense, of = np.zeros((len(common), n), np.float32), column[ids]
    dense[of[of >= 0], rows[of >= 0]] = 1
    postings, ends = rows[np.argsort(ids, kind="stable")], np.cumsum(often)

    words, mine = _words_of(asked)
    own, ids = np.bincount(mine, minlength=len(asked)), pc.fill_null(pc.index_in(words, value_set=dictionary), -1).to_numpy()
    mine, ids = mine[ids >= 0], ids[ids >= 0]
    of, at, share = column[ids], np.zeros(len(asked), int), np.zeros(len(asked))
    for start in range(0, len(asked), ASKED_AT_ONCE):
        stop = min(start + ASKED_AT_ONCE, len(asked))
        some = slice(*np.searchsorted(mine, (start, stop)))
        rows, words, columns = mine[some] - start, ids[some], of[some]
        wanted = np.zeros((stop - start, len(common)), np.float32)
        wanted[rows[columns >= 0], columns[columns >= 0]] = 1
        both = (wanted @ dense).astype(np.int64)
        rows, words = rows[columns < 0], words[columns < 0]
        for k, hits in enumerate(np.split(words, np.searchsorted(rows, np.arange(1, stop - start)))):
            if len(hits):
                both[k] += np.bincount(np.concatenate([postings[ends[w] - often[w] : ends[w]] for w in hits]), minlength=n)
        shares = both / np.maximum(own[start:stop, None] + sizes - both, 1)
        at[start:stop] = shares.argmax(axis=1)
        share[start:stop] = shares.max(axis=1)
    return at, share
