"""Near duplicates by fast similarity sketches, banding and exact verification.

A document's sketch has ``T`` coordinates.  In rounds 0..T-1 every shingle is thrown into one hashed bin with the
value round + fraction, in rounds T..2T-1 into the bin of that round, so every coordinate is filled for sure and a
set of n shingles needs about 1 + T ln T / n rounds.  Bins keep their least value; two sets agree on a coordinate
with a probability equal to their similarity, with concentration as of independent draws.

Documents with equal word sequences are one node.  Nodes meet in the buckets of bands of ``ROWS``
coordinates.  Every bucket first links its members to its smallest one (a star: as many pairs as members), and
pairs are confirmed on their full shingle sets.  Links are contracted to components.  Only buckets that still hold
several components go on: in large ones, members outside the largest component
try other hubs in it; then members of different components whose sketches agree widely enough are compared as well, in
blocks of bounded size.  A bucket too large for that is first regrouped by its members' rarest shingles (two
sets over the threshold must share one of those), which loses nothing.  So no group of copies is ever expanded
into its pairs, no partner is capped, and each pair in a bucket is either compared or already in one component.

A bucket that many documents share is one key of a join.  What is known of each bucket is therefore written down
first, so that both sides of the join are plain shuffles and Spark splits the large key between tasks.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, map_texts, pieces, repeated, saved, table, texts, without_repeats

#: Coordinates in a band, for thresholds of 0.85 and more; 5 below (see bands_for).
ROWS = 7
#: Members of a block; a bucket with more than BIG members outside its main component is regrouped by rare shingles.
BLOCK, BIG = 128, 512
#: Standard deviations below the threshold at which agreeing sketches still send a pair to the exact test.
SLACK = 6.0
#: Buckets of more members than FEW try other hubs of their largest component first, in so many turns, and then
#: compare shingles themselves where they stand.
FEW, HUB_TURNS = 32, 1
#: Fixed odd multipliers.
ODD, SEED, LEAP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0xBF58476D1CE4E5B9)
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def bands_for(threshold: float) -> tuple[int, int]:
    """Bands and rows: at the threshold at most one link in a million is missed by all bands."""
    rows = ROWS if threshold >= 0.85 else 5
    return max(1, math.ceil(math.log(1e-6) / math.log(1 - threshold**rows))), rows


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * LEAP
    x = (x ^ (x >> np.uint64(29))) * ODD
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of ODD and of its inverse, modulo 2**64."""
    return tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)]) for x in (ODD, np.uint64(pow(int(ODD), -1, 2**64))))


def words(text: str) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return text.encode().translate(LOWER).split()


def shingles(text: str, k: int) -> set:
    """The full set, as tuples of words; the whole sequence where it is shorter than ``k``."""
    w = words(text)
    return set(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else {tuple(w)} if w else set()


def hashed_sets(batch: list[str], k: int) -> list[np.ndarray]:
    """For each text the distinct 64-bit hashes of its shingles, sorted; one pass over the bytes of all texts."""
    raw = [t.encode().translate(LOWER) for t in batch]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    space = IS_SPACE[data]
    begins = np.flatnonzero(~space & np.r_[True, space[:-1]])
    ends = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
    powers, back = _powers(1 << (len(data) - 1).bit_length())
    sums = np.r_[np.uint64(0), np.cumsum((data + np.uint64(1)) * powers[: len(data)], dtype=np.uint64)]
    # a word's sum is divided by the power it begins with, so that equal words have equal hashes wherever they stand
    word = mix((sums[ends] - sums[begins]) * back[begins] + (ends - begins).astype(np.uint64))
    edges = np.searchsorted(begins, np.r_[0, np.cumsum([len(r) + 1 for r in raw])])
    n = max(0, len(word) - k + 1)
    all_k = np.zeros(n, np.uint64)
    for i in range(k):
        all_k = mix(all_k * ODD + word[i : i + n])
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(all_k[a : b - k + 1]))
        else:
            h = np.full(1, SEED ^ np.uint64(b - a), np.uint64)
            for i in range(a, b):
                h = mix(h * ODD + word[i : i + 1])
            out.append(h[: b - a])  # nothing for no words
    return out


def sketch(shingle: np.ndarray, t: int) -> np.ndarray:
    """The ``t`` coordinates of a set of hashes (not empty), as 16 bits each."""
    out, last, at = np.full(t, np.iinfo(np.uint64).max), 2 * t, 0
    # rounds come in lots, for later rounds cannot change a coordinate that is filled
    lot = max(1, 4096 // len(shingle))
    while at < last:
        rounds = np.arange(at, min(at + lot, last), dtype=np.uint64)[:, None]
        h = mix(shingle[None, :] + (rounds + np.uint64(1)) * SEED)
        place = np.where(rounds < t, (h & np.uint64(0xFFFFFF)) % np.uint64(t), rounds - np.uint64(t)).astype(np.int64)
        np.minimum.at(out, place.ravel(), (rounds << np.uint64(54) | h >> np.uint64(24)).ravel())
        at += lot
        if out.max() < np.iinfo(np.uint64).max:
            break
    return (mix(out) >> np.uint64(48)).astype("<u2")


def word_key(text: str) -> bytes:
    """A digest of the word sequence."""
    return hashlib.blake2b(b" ".join(words(text)), digest_size=16).digest()


def sketches(docs: DataFrame, k: int, t: int) -> DataFrame:
    """``doc_id, n_shingles, word_key, sketch``; the key is a digest of the word sequence."""

    def work(piece, k, t):
        batch = piece.column("text").to_pylist()
        sets = hashed_sets(batch, k)
        return {
            "doc_id": piece.column("doc_id"),
            "n_shingles": [len(s) for s in sets],
            "word_key": [word_key(x) for x in batch],
            "sketch": [sketch(s, t).tobytes() if len(s) else None for s in sets],
        }

    return map_texts(texts(docs), work, f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, word_key binary, sketch binary", k, t)


def confirmed(pairs: DataFrame, whole: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets have 100 * intersection >= percent * union."""
    b = pairs.join(whole.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
    both = b.join(whole.select(F.col("rep").alias("a"), "text"), "a").select("a", "b", "text", "text_b")
    schema = f"a {dict(pairs.dtypes)['a']}, b {dict(pairs.dtypes)['b']}"
    kind = arrow(schema)

    def run(batches):
        held, own = None, set()
        for piece in pieces(batches):
            out = {"a": [], "b": []}
            for a, b, text, other in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                if text != held:
                    held, own = text, shingles(text, k)
                set_b = shingles(other, k)
                common = len(own & set_b)
                if 100 * common >= percent * (len(own) + len(set_b) - common):
                    out["a"].append(a)
                    out["b"].append(b)
            yield pa.RecordBatch.from_pydict(out, schema=kind)

    return both.mapInArrow(run, schema).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node on an edge (a, b): the smallest node it reaches.

    Large-star and small-star steps in turn: in each the edges of a node move to its smallest neighbour, so hubs
    shrink instead of growing, and a chain of n nodes needs about log n rounds.  Every round is a written table.
    """
    edges = saved(edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component")).where("node != component").distinct(), "links")
    while True:
        roots = edges.select(F.col("component").alias("root")).distinct()
        more = edges.groupBy("node").count().where("count > 1").select("node").union(roots.join(edges.select("node"), F.col("root") == F.col("node"), "left_semi").select(F.col("root").alias("node")))
        if more.isEmpty():
            return edges
        both = edges.select(F.col("node").alias("u"), F.col("component").alias("v")).union(edges.select("component", "node"))
        low = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("m").alias("component")), F.struct(F.col("v").alias("node"), F.col("m").alias("component")))).alias("e")).select("e.*")
        edges = saved(small.where("node != component").distinct(), "links")


def mixed(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``grp, band, rep, comp, main, held, few`` of the buckets in ``rows`` (grp, band, rep) that hold several
    components; ``main`` is the largest, ``few`` counts the members outside it."""
    labelled = rows.select("grp", "band", "rep").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("grp", "band", "rep", F.coalesce("component", "rep").alias("comp"))
    per = labelled.groupBy("grp", "comp").agg(F.count("*").alias("n")).groupBy("grp").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("held"), (F.sum("n") - F.max("n")).alias("few"))
    return saved(labelled.join(saved(per.where("few > 0"), "mixed-buckets"), "grp"), "mixed")


def across(groups: DataFrame, percent: int, rows_each: int, each: bool = False) -> DataFrame:
    """Pairs (a, b) of a group's members in different components that may be links.

    ``groups``: ``grp, band, rep, comp, n_shingles, sketch, h``.  A group's largest component needs no comparison
    within itself: its members only meet the others.  Both sides are dealt into blocks of about ``BLOCK`` members by
    hash, and each pair of blocks is one row of bounded size.  A pair passes if neither its sizes nor its sketches
    rule a link out, in the first band alone that it shares (``band`` null: in any).  Where the members' shingles
    are there (``h``, 32 bits each) they are compared as well, and a member needs one link to each component, unless
    ``each`` asks for all pairs.
    """
    groups = groups.select("grp", "band", "rep", "comp", "n_shingles", "sketch", "h")
    per = groups.groupBy("grp", "comp").agg(F.count("*").alias("n"))
    sizes = per.groupBy("grp").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("held"), F.max("n").alias("top")).where("held > top")
    sizes = saved(sizes.select("grp", "main", F.ceil((F.col("held") - F.col("top")) / BLOCK).alias("few"), F.ceil(F.col("top") / BLOCK).alias("many")), "block-counts")
    dealt = groups.join(sizes, "grp").withColumn("own", F.when(F.col("comp") == F.col("main"), F.pmod(F.xxhash64("rep"), "many") + F.col("few")).otherwise(F.pmod(F.xxhash64("rep"), "few")))
    others = F.when(F.col("comp") == F.col("main"), F.sequence(F.lit(0).cast("long"), F.col("few") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("few") + F.col("many") - 1))
    dealt = dealt.withColumn("other", F.explode(others))
    dealt = dealt.groupBy("grp", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = dealt.agg(F.collect_list(F.struct("rep", "comp", "n_shingles", "sketch", "own", "h")).alias("m")).select("band", "i", "j", "m")
    schema = f"a {dict(groups.dtypes)['rep']}, b {dict(groups.dtypes)['rep']}"
    kind, share = arrow(schema), percent / 100

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                band, i, j, m = (batch.column(c)[row].as_py() for c in ("band", "i", "j", "m"))
                rep, comp, n, own = ([x[c] for x in m] for c in ("rep", "comp", "n_shingles", "own"))
                comp, n, own = np.array(comp), np.array(n), np.array(own)
                sets = [None if x["h"] is None else np.frombuffer(x["h"], "<u4") for x in m]
                all_t = np.stack([np.frombuffer(x["sketch"], "<u2") for x in m])
                t = all_t.shape[1]
                need = t * (share - SLACK * math.sqrt(share * (1 - share) / t))
                out = {"a": [], "b": []}
                for x in range(len(m)):
                    y = x + 1 + np.flatnonzero((comp[x + 1 :] != comp[x]) & ((own[x + 1 :] != own[x]) | (i == j)) & (100 * np.minimum(n[x + 1 :], n[x]) >= percent * np.maximum(n[x + 1 :], n[x])))
                    if not len(y):
                        continue
                    same = all_t[y] == all_t[x]
                    alike = same.sum(1)
                    ok = alike >= need
                    if band is not None:
                        ok &= same.reshape(len(y), -1, rows_each).all(2).argmax(1) == band
                    linked = set()
                    for v in y[ok][np.argsort(-alike[ok], kind="stable")].tolist():
                        if sets[x] is not None and sets[v] is not None:
                            # shingles of one text that share 32 bits count for the benefit of the doubt
                            common = len(np.intersect1d(sets[x], sets[v], assume_unique=True)) + n[x] - len(sets[x])
                            if (not each and int(comp[v]) in linked) or 100 * common < percent * (n[x] + n[v] - common):
                                continue
                            linked.add(int(comp[v]))
                        out["a"].append(min(rep[x], rep[v]))
                        out["b"].append(max(rep[x], rep[v]))
                if out["a"]:
                    yield pa.RecordBatch.from_pydict(out, schema=kind)

    return rows.mapInArrow(run, schema).distinct()


def with_shingles(rows: DataFrame, whole: DataFrame, k: int) -> DataFrame:
    """``rows`` with ``h``: the shingles of their nodes, 32 bits each."""

    def work(piece, k):
        return {"rep": piece.column("rep"), "h": [np.unique(x.astype("<u4")).tobytes() for x in hashed_sets(piece.column("text").to_pylist(), k)]}

    used = whole.join(rows.select("rep").distinct(), "rep", "left_semi")
    sets = saved(map_texts(used, work, f"rep {dict(rows.dtypes)['rep']}, h binary", k), "shingles")
    # of a doc_id with several texts one set does not rule out the others
    return rows.join(sets.groupBy("rep").agg(F.when(F.count("*") == 1, F.first("h")).alias("h")), "rep")


def by_rare_shingle(members: DataFrame, whole: DataFrame, k: int, percent: int) -> DataFrame:
    """``grp, rep``: nodes that share one of their rarest shingles; every two sets over the threshold do."""

    def work(piece, k):
        sets = hashed_sets(piece.column("text").to_pylist(), k)
        return {"rep": piece.column("rep"), "h": [s.view(np.int64) for s in sets]}

    own = dict(members.dtypes)["rep"]
    sets = map_texts(whole.join(members.select("rep").distinct(), "rep", "left_semi"), work, f"rep {own}, h array<long>", k)
    flat = sets.select("rep", F.size("h").alias("n"), F.explode("h").alias("h"))
    often = saved(flat.groupBy("h").count().where("count > 1"), "shared-shingles")
    kept = flat.join(often, "h", "left").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("count", F.lit(1)).alias("c"), "h"))).alias("s"))
    prefix = F.slice("s", F.lit(1), F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100).cast("int") + 1)
    return kept.select("rep", F.explode(prefix).alias("x")).where("x.c > 1").select(F.col("x.h").alias("grp"), "rep")


def grouped(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept, word_key``: see ``near_duplicates``."""
    bands, rows_each = bands_for(percent / 100)
    drawn = saved(sketches(docs, k, bands * rows_each), "sketches")
    nodes = drawn.where("n_shingles > 0 and doc_id is not null").groupBy("word_key").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles"))
    nodes = saved(nodes, "nodes")
    step = 2 * rows_each
    places = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring("sketch", i * step + 1, F.lit(step))))
    flat = nodes.select("rep", "n_shingles", F.posexplode(places).alias("band", "grp"))
    hubs = flat.groupBy("grp").agg(F.min("rep").alias("hub"), F.max("rep").alias("far"), F.min_by("n_shingles", "rep").alias("hub_n")).where("hub != far").drop("far")
    hubs = saved(hubs, "hubs")
    members = saved(flat.join(hubs, "grp"), "buckets")
    fits = F.lit(100) * F.least("n_shingles", "hub_n") >= F.lit(percent) * F.greatest("n_shingles", "hub_n")
    stars = members.where((F.col("rep") != F.col("hub")) & fits).select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    used = members.select("rep").distinct()
    # of a doc_id with several texts all are read; the node is the document
    whole = saved(texts(docs).join(used, F.col("doc_id") == F.col("rep"), "left_semi").select(F.col("doc_id").alias("rep"), "text"), "candidates")
    links = saved(confirmed(stars, whole, k, percent), "star-links")
    groups = components(links)

    rest = mixed(members, groups)
    for turn in range(HUB_TURNS):
        wide = rest.where(F.col("held") > FEW)
        main = F.col("comp") == F.col("main")
        hub = saved(wide.where(main).groupBy("grp").agg(F.min_by("rep", F.xxhash64("rep", "grp", F.lit(turn))).alias("hub")), "more-hubs")
        tries = wide.where(~main).join(hub, "grp").select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct()
        more = saved(confirmed(tries, whole, k, percent), "more-links")
        if more.isEmpty():
            break
        groups = components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
        rest = mixed(rest, groups)
    drawn_of = nodes.select("rep", "n_shingles", "sketch")
    narrow = rest.where(F.col("held") <= FEW).join(drawn_of, "rep").withColumn("h", F.lit(None).cast("binary"))
    found = across(narrow, percent, rows_each)
    wide, tested = rest.where(F.col("held") > FEW), None
    if not wide.isEmpty():
        compared = with_shingles(wide.where(F.col("few") <= BIG), whole, k).join(drawn_of, "rep").select("grp", "band", "rep", "comp", "n_shingles", "sketch", "h")
        big = wide.where(F.col("few") > BIG)
        if not big.isEmpty():
            rare = by_rare_shingle(big, whole, k, percent).join(big.select("rep", "comp").distinct(), "rep").withColumn("band", F.lit(None).cast("int"))
            compared = compared.unionByName(with_shingles(rare, whole, k).join(drawn_of, "rep").select(*compared.columns))
        tested = saved(across(compared, percent, rows_each), "tested-pairs")
        found = found.union(tested).distinct()
    more = saved(confirmed(found, whole, k, percent), "more-links")
    if tested is not None:
        # a pair whose hashed shingles agreed and whose shingles do not may have hidden a link to the same component
        failed = saved(tested.join(more, ["a", "b"], "left_anti").select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "failed")
        if not failed.isEmpty():
            unsure = saved(compared.join(failed, "rep", "left_semi").select("grp").distinct(), "unsure-buckets")
            again = across(compared.join(unsure, "grp", "left_semi"), percent, rows_each, each=True)
            more = more.union(saved(confirmed(again, whole, k, percent), "more-links")).distinct()
    if not more.isEmpty():
        groups = components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    named = nodes.select("word_key", "rep").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("word_key", F.coalesce("component", "rep").alias("named"))
    out = drawn.select("doc_id", "n_shingles", "word_key").join(named, "word_key", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("named")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), "word_key")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked if their sets of ``k``-word shingles have 100 * intersection >= percent * union; a
    component is named by its smallest ``doc_id``, which is ``kept``.  Null texts count as empty; a text without
    words has an empty set and is alone in its component; texts of any length are read whole.  Rows that repeat a
    doc_id with other texts have a component each, that of their text.  Rows without a doc_id have no component and are
    not kept.  An empty table gives an empty result; other columns are ignored.
    """
    return grouped(docs, k, percent).drop("word_key")


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, one of each component, with all their columns.  Rows that repeat a ``doc_id`` with other
    texts stay or go by their own text; of those that repeat its text, too, one stays.  Rows without a ``doc_id`` cannot
    be told apart by it, and all stay."""
    again = repeated(docs)
    dropped = grouped(docs, k, percent).where("not kept and doc_id is not null").select(F.col("doc_id").alias("_dropped"), "word_key")
    if again.isEmpty():
        return docs.join(dropped, docs["doc_id"] == dropped["_dropped"], "left_anti")
    dropped = saved(dropped.distinct(), "dropped")
    own = dropped.join(again, F.col("_dropped") == F.col("_again"), "left_anti")
    kept = docs.join(own, docs["doc_id"] == own["_dropped"], "left_anti")
    # few rows repeat an id: theirs are the only texts read again
    sha = lambda text: F.sha2(F.coalesce(text, F.lit("")), 256)
    several = texts(docs).join(again, F.col("doc_id") == F.col("_again"), "left_semi").dropDuplicates(["doc_id", "text"]).withColumn("sha", sha(F.col("text")))
    keys = map_texts(several, lambda piece: {"_id": piece.column("doc_id"), "_sha": piece.column("sha"), "_key": [word_key(x) for x in piece.column("text").to_pylist()]}, f"_id {dict(docs.dtypes)['doc_id']}, _sha string, _key binary")
    gone = keys.join(dropped, (F.col("_id") == F.col("_dropped")) & (F.col("_key") == F.col("word_key")), "left_semi").select("_id", "_sha")
    return without_repeats(kept.join(gone, (kept["doc_id"] == gone["_id"]) & (sha(kept["text"]) == gone["_sha"]), "left_anti"), docs, again)


def op3_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", spread=True), 3, 85)


#: All pairs that share a shingle, counted, and the closure of the links: the plain way, for small tables.
SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, len(s) AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id, s.doc_id = least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS kept
FROM s LEFT JOIN r ON s.doc_id = r.a GROUP BY s.doc_id, len(s)
"""
