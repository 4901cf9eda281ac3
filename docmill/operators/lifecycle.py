"""What happens to assets later: decisions, retention, supersession, library commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import fixed
from docmill.operators.tasks import saved


def destination(decision: Column) -> Column:
    """Where a decision sends an asset; null for one that is none."""
    table = F.create_map(*(F.lit(x) for pair in fixed.DECISIONS.items() for x in pair))
    return F.try_element_at(table, decision)


def decide(rows: DataFrame, decisions: DataFrame, key: str = "doc_id") -> DataFrame:
    """``rows`` with their decision applied to ``approval_state`` and ``status``; others stay."""
    out = rows.join(decisions.select(key, F.col("decision").alias("_d")), key, "left")
    state = F.when(F.col("_d").isin("approve", "reference_only"), "approved").when(F.col("_d") == "reject", "quarantined").when(F.col("_d") == "archive", "archived").otherwise(F.col("approval_state"))
    level = F.when(F.col("_d") == "reference_only", "reference_only").otherwise(F.col("authority_level"))
    return out.withColumns({"approval_state": state, "authority_level": level, "status": F.when(F.col("_d") == "archive", "archived").otherwise(F.col("status"))}).drop("_d")


def overdue(rows: DataFrame, since: str, as_of: Column, days: int = fixed.STAGING_DAYS) -> DataFrame:
    """Staged rows that have waited for more than ``days``."""
    return rows.where((F.col("approval_state") == "staging") & (F.datediff(as_of, F.col(since)) > days))


def waiting(rows: DataFrame, since: str, as_of: Column, days: int = fixed.STAGING_DAYS) -> DataFrame:
    """Rows that wait for people (pending or staging) with ``waited`` days and whether a reminder is due."""
    waited = F.datediff(as_of, F.col(since))
    return rows.where(F.col("approval_state").isin("pending", "staging")).withColumn("waited", waited).withColumn("reminder", waited > days)


def set_status(rows: DataFrame, ids: DataFrame, status: str, key: str = "doc_id") -> DataFrame:
    """``deprecate`` and ``archive``: a new table in which ``ids`` have ``status``."""
    return rows.join(ids.select(key, F.lit(True).alias("_hit")).distinct(), key, "left").withColumn("status", F.when(F.col("_hit"), status).otherwise(F.col("status"))).drop("_hit")


def supersede(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (old_id, new_id): the old ones are superseded, the new ones say by what."""
    old = pairs.groupBy(F.col("old_id").alias("doc_id")).agg(F.max("new_id").alias("_by"))
    new = pairs.groupBy(F.col("new_id").alias("doc_id")).agg(F.max("old_id").alias("_of"))
    out = rows.drop("supersedes", "superseded_by").join(old, "doc_id", "left").join(new, "doc_id", "left")
    return out.withColumn("status", F.when(F.col("_by").isNotNull(), "superseded").otherwise(F.col("status"))).withColumnsRenamed({"_by": "superseded_by", "_of": "supersedes"})


def chains(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """``doc_id, latest_id, depth, cycle`` of every document that is superseded, from ``edges`` (doc_id, next_id).

    Pointers are doubled, so a chain of n links needs log2 n rounds and each round is one equi-join.  Documents on
    or before a cycle never reach an end and are told apart by ``cycle``; their ``latest_id`` is null.
    """
    out = edges.groupBy("doc_id").agg(F.max("next_id").alias("latest_id")).withColumn("depth", F.lit(1).cast("long"))
    for _ in range(rounds):
        step = out.select(F.col("doc_id").alias("_at"), F.col("latest_id").alias("_next"), F.col("depth").alias("_more"))
        out = out.join(step, F.col("latest_id") == F.col("_at"), "left").select("doc_id", F.coalesce("_next", "latest_id").alias("latest_id"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"), F.col("_next").isNotNull().alias("moved"))
        out = saved(out, "chains")
        state = out.agg(F.count("*").alias("n"), F.count_if("moved").alias("moved"), F.min(F.when(F.col("moved"), F.col("depth"))).alias("least")).first()
        out = out.drop("moved")
        # what has moved farther than there are documents goes round in a cycle
        if not state["moved"] or state["least"] > state["n"]:
            break
    ends = out.select(F.col("doc_id").alias("_d")).distinct()
    return out.join(ends, F.col("latest_id") == F.col("_d"), "left").select("doc_id", F.when(F.col("_d").isNull(), F.col("latest_id")).alias("latest_id"), F.when(F.col("_d").isNull(), F.col("depth")).alias("depth"), F.col("_d").isNotNull().alias("cycle"))


def search(rows: DataFrame, text: str | None = None, **values) -> DataFrame:
    """``list`` and ``search``: equal values, and a part of the title or header."""
    for c, v in values.items():
        rows = rows.where(F.col(c).isin(v) if isinstance(v, (list, tuple)) else F.col(c) == v)
    if text is None:
        return rows
    hit = F.lit(False)
    for c in ("title", "title_en", "header", "term"):
        if c in rows.columns:
            hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
    return rows.where(hit)
