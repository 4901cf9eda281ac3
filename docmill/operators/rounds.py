"""Negotiation rounds: what changed, what is carried forward, where to go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import editing
from docmill.functions.text import jaccard
from docmill.operators.tasks import map_rows, saved

#: The type of a word script, a column of ``word_diff``.
SCRIPT = "array<struct<op: string, text: string>>"

#: Edges and changed clauses of one document that are searched in its row.
MOST_EDGES = 1 << 16


def with_ordinal(clauses: DataFrame, key: list[str], order: str, name: str = "ordinal") -> DataFrame:
    return clauses.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(order)))


def diff(prior: DataFrame, current: DataFrame, on: list[str], text: str = "text") -> DataFrame:
    """Both sides' clauses by ``on`` with ``diff_status``: unchanged, modified, added or removed."""
    a, b = (df.select(*on, F.sha2(F.coalesce(text, F.lit("")), 256).alias(f"{side}_hash"), F.col(text).alias(f"{side}_text"), F.lit(True).alias(f"_{side}")) for df, side in ((prior, "prior"), (current, "current")))
    status = F.when(F.col("_prior").isNull(), "added").when(F.col("_current").isNull(), "removed").when(F.col("prior_hash") == F.col("current_hash"), "unchanged").otherwise("modified")
    return a.join(b, on, "full_outer").withColumn("diff_status", status).drop("_prior", "_current", "prior_hash", "current_hash")


def align(prior: DataFrame, current: DataFrame, key: str, order: str = "ordinal", text: str = "text", least: float = 0.5) -> DataFrame:
    """The clauses of two rounds of each document side by side: ``key, prior_no, current_no, diff_status, moved, similarity,
    prior_text, current_text``, with the place of each clause in ``order``.

    An inserted or removed clause shifts nothing: equal clauses that are unique in both rounds and in order are anchors, and
    between them the match keeps the order and weighs most (see ``editing.aligned``).  ``unchanged`` clauses are equal,
    ``modified`` ones share ``least`` of their words; the rest is ``added`` or ``removed``, but an equal clause that stands
    elsewhere now is one ``unchanged`` row that has ``moved``.  A null text counts as empty; a document in one round alone is
    all added or all removed; rows without a ``key`` are one document.  A document's clauses meet in one row.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        one = F.struct(F.col(order).cast("long").alias("no"), F.coalesce(text, F.lit("")).alias("text"))
        return df.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias(name))

    a, b = side(prior, "_a"), side(current, "_b").withColumnRenamed(key, "_key")
    both = a.join(b, a[key].eqNullSafe(b["_key"]), "full_outer").select(F.coalesce(key, "_key").alias(key), "_a", "_b")

    def work(old: list | None, new: list | None) -> list[tuple]:
        old, new = old or [], new or []
        rows = editing.aligned([x["text"] for x in old], [x["text"] for x in new], least)
        alone: dict[str, list[int]] = {}
        for _, j, _ in (r for r in rows if r[0] is None):
            alone.setdefault(new[j]["text"], []).append(j)
        moved = {i: alone[old[i]["text"]].pop(0) for i, j, _ in rows if j is None and alone.get(old[i]["text"])}
        out = []
        for i, j, s in rows:
            if i is None and j in moved.values():
                continue
            to = moved.get(i) if j is None else j
            left, right = old[i] if i is not None else {}, new[to] if to is not None else {}
            status = "added" if i is None else "removed" if to is None else "unchanged" if left["text"] == right["text"] else "modified"
            out.append((left.get("no"), right.get("no"), status, i in moved, 1.0 if status == "unchanged" else s, left.get("text"), right.get("text")))
        return out

    fields = ("prior_no", "current_no", "diff_status", "moved", "similarity", "prior_text", "current_text")
    kind = "array<struct<prior_no: long, current_no: long, diff_status: string, moved: boolean, similarity: double, prior_text: string, current_text: string>>"
    out = map_rows(both, lambda r: [dict(zip(fields, x, strict=True)) for x in work(r["_a"], r["_b"])], "_rows", kind, ["_a", "_b"])
    return out.select(key, F.explode("_rows").alias("_r")).select(key, "_r.*")


def word_diff(pairs: DataFrame, prior: str = "prior_text", current: str = "current_text", name: str = "script", most: int = editing.MOST_CHANGES) -> DataFrame:
    """``pairs`` with the word script from ``prior`` to ``current``: spans ``op`` (keep, delete, insert) and ``text``, in order.

    A span of white space is kept to the letter, so ``before`` and ``after`` give both texts back.  The script is a shortest
    one where up to ``most`` tokens change between two that are unique on both sides; else a gap is replaced whole, which
    bounds the work on long clauses.  A null text counts as empty.
    """
    return map_rows(pairs, lambda r: [{"op": op, "text": text} for op, text in editing.script(r[prior], r[current], most)], name, SCRIPT)


def before(script: Column) -> Column:
    """The text that a script starts from."""
    return F.array_join(F.transform(F.filter(script, lambda s: s["op"] != "insert"), lambda s: s["text"]), "")


def after(script: Column) -> Column:
    """The text that a script leads to."""
    return F.array_join(F.transform(F.filter(script, lambda s: s["op"] != "delete"), lambda s: s["text"]), "")


def change_kind(prior: Column, current: Column) -> Column:
    """Heuristic: a much shorter clause is narrower, a much longer one broader, a similar one a clarification."""
    share = F.length(current) / F.greatest(F.lit(1), F.length(prior))
    return F.when(share < 0.8, "narrowing").when(share > 1.25, "broadening").when(jaccard(prior, current) >= 0.5, "clarification").otherwise("rewrite")


def carry_forward(current: DataFrame, prior: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """``current`` with the prior round's ``columns`` as ``prior_...``."""
    return current.join(prior.select(*on, *(F.col(c).alias(f"prior_{c}") for c in columns)), on, "left")


def prior_value(rows: DataFrame, key: list[str], order: str, column: str) -> DataFrame:
    return rows.withColumn(f"prior_{column}", F.lag(column).over(Window.partitionBy(*key).orderBy(order)))


def latest_round(rows: DataFrame, matter: str = "matter_id", number: str = "round") -> DataFrame:
    return rows.groupBy(matter).agg(F.max(number).alias("latest"), (F.max(number) + 1).alias("next"))


def answer(prior: Column, proposed: Column, current: Column, partly: float = 0.5) -> Column:
    """What the other side did with our proposal: ``accepted`` (the text is ours now), ``rejected`` (it is theirs
    again, or has nothing of ours), ``partial`` in between; null where we proposed nothing."""
    gained = jaccard(current, proposed)
    return F.when(proposed.isNull(), None).when(current == proposed, "accepted").when(current.isNull() | (current == prior) | (gained < partly), "rejected").otherwise("partial")


def delta_report(diffs: DataFrame, key: list[str] | None = None, proposed: str | None = None) -> DataFrame:
    """Counts by bucket: new, resolved, changed, open; where ``proposed`` names our wording, its fate comes first."""
    bucket = F.when(F.col("diff_status") == "added", "new").when(F.col("diff_status") == "removed", "resolved").when(F.col("diff_status") == "modified", "changed").otherwise("open")
    if proposed:
        bucket = F.coalesce(answer(F.col("prior_text"), F.col(proposed), F.col("current_text")), bucket)
    return diffs.withColumn("bucket", bucket).groupBy(*(key or []), "bucket").agg(F.count("*").alias("n"))


def edit_distance(prior: Column, current: Column, most: int = 1000) -> Column:
    """Letters to change, up to ``most`` (beyond that -1), which bounds the work on long clauses."""
    return F.levenshtein(F.coalesce(prior, F.lit("")), F.coalesce(current, F.lit("")), most)


def resume_point(states: DataFrame, key: str, step: str, at: str) -> DataFrame:
    """The last completed step of each pipeline."""
    return states.groupBy(key).agg(F.max_by(step, F.struct(at, step)).alias("last_step"), F.max(at).alias("at"))


def affected(changed: DataFrame, edges: DataFrame, key: str = "doc_id", node: str = "clause_id", most: int = MOST_EDGES) -> DataFrame:
    """``key, node, depth``: the ``changed`` clauses (0) and all that lean on them over any number of ``edges``.

    ``edges``: ``key, from_id, to_id``, a clause that refers to another or uses its term; they are worked out once.  A
    document's edges meet in one row and are searched there, whatever the length of the ways.  Documents with more than
    ``most`` edges and changed clauses are searched by rounds instead, in which the clauses found last are joined with the
    edges that lead to them; what is known already is left out, so cycles end.  A clause has the length of its shortest way.
    """
    starts = changed.select(F.col(key), F.lit(True).alias("_start"), F.col(node).alias("_to"), F.lit(None).cast(dict(changed.dtypes)[node]).alias("_from"))
    leads = edges.where(F.col(key).isNotNull() & F.col("to_id").isNotNull()).select(F.col(key), F.lit(False).alias("_start"), F.col("to_id").alias("_to"), F.col("from_id").alias("_from"))
    rows = saved(starts.union(leads), "affected")
    large = saved(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(key), "affected")
    some = not large.isEmpty()
    small = (rows.join(large, key, "left_anti") if some else rows).where(F.col(key).isNotNull())
    own = small.groupBy(key).agg(F.collect_list(F.struct("_start", "_to", "_from")).alias("_e")).where(F.exists("_e", lambda e: e["_start"]))

    def work(row: dict) -> list[dict]:
        found = editing.reached([e["_to"] for e in row["_e"] if e["_start"]], [(e["_to"], e["_from"]) for e in row["_e"] if not e["_start"]])
        return [{"node": n, "depth": d} for n, d in found.items()]

    out = map_rows(own, work, "_r", f"array<struct<node: {dict(rows.dtypes)['_to']}, depth: int>>", ["_e"], limit=8)
    out = out.select(key, F.explode("_r").alias("_r")).select(key, F.col("_r.node").alias(node), F.col("_r.depth").alias("depth"))
    # without a document nothing leads anywhere
    out = out.union(rows.where(F.col(key).isNull()).select(key, F.col("_to").alias(node), F.lit(0).alias("depth")).distinct())
    if not some:
        return out
    rest = rows.join(large, key, "left_semi")
    seen = saved(rest.where("_start").select(key, F.col("_to").alias(node), F.lit(0).alias("depth")).distinct(), "affected")
    ways, last, depth = saved(rest.where("not _start").select(key, "_to", "_from").distinct(), "affected"), seen, 0
    while not last.isEmpty():
        depth += 1
        step = last.select(F.col(key).alias("_key"), F.col(node).alias("_node"))
        found = ways.join(step, (F.col(key) == F.col("_key")) & (F.col("_to") == F.col("_node"))).select(key, F.col("_from").alias(node)).distinct()
        known = seen.select(F.col(key).alias("_key"), F.col(node).alias("_node"))
        last = saved(found.join(known, F.col(key).eqNullSafe(F.col("_key")) & F.col(node).eqNullSafe(F.col("_node")), "left_anti").withColumn("depth", F.lit(depth)), "affected")
        seen = seen.union(last)
    return out.union(seen)


def only_affected(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows that a partial run has to look at again."""
    return rows.join(keys.select(*on).distinct(), on, "left_semi")
