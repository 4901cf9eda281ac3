"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic; one grouped pass sums their tokens.  The cells' weights
are then raked: in turn they are scaled so that their sums over each source, each language and each topic equal
the target marginals.  A document is drawn with a probability in proportion to weight over tokens of its cell,
calibrated so that the expected tokens are ``share`` of the corpus, no probability is above one, and what cells
that are full cannot give is spread over the others.

Texts are read once: each document's cell and tokens are written, and the cells, the join and the draw come from
those.  Everything is DataFrame operations on the main path.  Only the table of cells is iterated on, and it grows
with the number of sources, not with documents.  Few cells are one task's windows, without a shuffle; many are dealt
out by the marginal.  Raking goes on until no marginal misses its target, or no further rounds help.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, table

#: Rounds of raking before marginals are looked at again; how far from their targets they may be.
RAKES, TOLERANCE = 24, 1e-6
#: Rounds of spreading in the SQL; here they go on until no further cell is full.
SPREADS = 8
#: Expected tokens of the sample over those of the corpus.
SHARE = 0.5
SEED = 17
#: How strongly targets even the marginals out: 1 keeps the corpus's shares, 0 makes all equal.
TEMPERATURE = 0.5
#: The most cells that are sent to every task, or raked in one; with more, joins and windows shuffle.
CELLS_SENT = 20_000
DIMS = ("source", "lang", "topic")


def topic(text: Column) -> Column:
    """A topic by rule, the first that holds: tables, contact pages, notices, shouting, long and short prose."""
    return (
        F.when(text.contains(" | "), "table")
        .when(text.rlike(r"@[A-Za-z0-9-]+\.|\+1 \("), "contact")
        .when(text.rlike("(?i)licen[sc]e|copyright|all rights reserved"), "notice")
        .when(text.rlike("!!|###|\\*\\*\\*"), "noise")
        .when(F.length(text) >= 4000, "long")
        .otherwise("prose")
    )


def tokens(text: Column) -> Column:
    """Words between white space, as the weight of a document; at least 1, so that empty ones can be drawn."""
    return F.greatest(F.lit(1), F.size(F.split(F.trim(text), "[ \\t\\n\\x0B\\f\\r]+"))).cast("long")


def described(docs: DataFrame, topics: Callable[[Column], Column] | None = None) -> DataFrame:
    """``doc_id`` and the document's cell and tokens; null source, language or topic is a value of its own.

    ``topics``: an expression of the text that names its topic, in place of the rule.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(F.col("doc_id"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce((topics or topic)(text), F.lit("")).alias("topic"), tokens(text).alias("n_tokens"))


def total(rows: DataFrame, value) -> float:
    """A sum over all cells, as a number: partial sums of tasks, not a window in one of them."""
    return float(rows.agg(F.sum(value).alias("s")).first()["s"] or 0.0)


def tempered(cells: DataFrame, dim: str, temperature: float = TEMPERATURE) -> DataFrame:
    """Default targets ``value, target``: the corpus's shares to the power of ``temperature``, summing to 1."""
    own = cells.groupBy(F.col(dim).alias("value")).agg(F.pow(F.sum("n_tokens").cast("double"), F.lit(temperature)).alias("p"))
    return own.select("value", (F.col("p") / F.lit(total(own, "p"))).alias("target"))


def residual(cells: DataFrame) -> float:
    """The most by which a marginal of ``cells`` (with ``weight`` and goals) misses its target."""
    parts = [cells.groupBy(d).agg(F.abs(F.sum("weight") - F.max(f"goal_{d}")).alias("r")).select("r") for d in DIMS]
    return float(parts[0].union(parts[1]).union(parts[2]).agg(F.max("r").alias("r")).first()["r"] or 0.0)


def raked(cells: DataFrame, targets: dict[str, DataFrame] | None = None, rakes: int = RAKES, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` with ``weight``: shares of the mix, raked over the three marginals in lots of ``rakes`` rounds.

    It ends when every marginal is within ``tolerance`` of its target, or when a lot does not halve what is missing,
    as where targets contradict each other; ``marginals`` tells what was reached.  ``targets``: for each dimension a
    frame ``value, target``; the corpus's tempered shares where it has none.  Values without a target get nothing;
    targets of values that the corpus lacks are spread over the others.
    """
    few, out = cells.count() <= CELLS_SENT, cells
    for d in DIMS:
        goal = (targets or {}).get(d)
        if goal is None:
            goal, there = tempered(cells, d), 1.0
        else:
            goal = goal.groupBy("value").agg(F.sum("target").alias("target"))
            there = total(goal.join(cells.select(F.col(d).alias("value")).distinct(), "value", "left_semi"), "target") or 1.0
        out = out.join(goal.select(F.col("value").alias(d), (F.col("target") / F.lit(there)).alias(f"goal_{d}")), d, "left").withColumn(f"goal_{d}", F.coalesce(f"goal_{d}", F.lit(0.0)))
    out, missed = saved(out.withColumn("weight", F.col("n_tokens") / F.lit(total(cells, "n_tokens") or 1.0)), "cells"), float("inf")
    while True:
        for done in range(rakes):
            # one task has all of few cells, so that no window needs a shuffle
            out = out.coalesce(1) if few and done % 4 == 0 else out
            for d in DIMS:
                sums = F.sum("weight").over(Window.partitionBy(d))
                out = out.withColumn("weight", F.when(sums > 0, F.col("weight") * F.col(f"goal_{d}") / sums).otherwise(0.0))
            if done % 4 == 3 or done == rakes - 1:
                out = saved(out, "cells")
        before, missed = missed, residual(out)
        if missed <= tolerance or missed > before / 2:
            break
    return out.withColumn("weight", F.col("weight") / F.lit(total(out, "weight") or 1.0))


def marginals(cells: DataFrame) -> DataFrame:
    """``dim, value, target, reached`` of raked cells: what each marginal has, beside what it was to have."""
    parts = [cells.groupBy(F.col(d).alias("value")).agg(F.max(f"goal_{d}").alias("target"), F.sum("weight").alias("reached")).select(F.lit(d).alias("dim"), "value", "target", "reached") for d in DIMS]
    return parts[0].union(parts[1]).union(parts[2])


def probabilities(cells: DataFrame, share: float = SHARE) -> DataFrame:
    """``cells`` with ``probability``: weight over tokens, calibrated to ``share`` of all tokens and at most 1.

    What full cells cannot give is spread over the others, until no more of them are full.
    """
    out = cells.withColumn("ratio", F.col("weight") / F.col("n_tokens"))
    wanted, everything = share * total(out, "n_tokens"), total(out, "weight")
    scale, seen = wanted / everything if everything else 0.0, -1
    while True:
        full = F.col("ratio") * F.lit(scale) >= 1
        r = out.agg(F.coalesce(F.sum(F.when(full, F.col("n_tokens")).otherwise(0)), F.lit(0)).alias("given"), F.coalesce(F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.lit(0.0)).alias("left"), F.count_if(full).alias("full")).first()
        if r["full"] == seen or r["left"] <= 0:
            break
        seen, scale = r["full"], max(0.0, wanted - r["given"]) / r["left"]
    return out.withColumn("probability", F.least(F.lit(1.0), F.col("ratio") * F.lit(max(scale, 0.0)))).select(*DIMS, "n_docs", "n_tokens", "weight", "probability")


def cell_table(rows: DataFrame) -> DataFrame:
    """Documents and tokens of each cell, of described documents or of documents."""
    rows = rows if "n_tokens" in rows.columns and "topic" in rows.columns and "text" not in rows.columns else described(rows)
    return saved(rows.groupBy(*DIMS).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")), "cell-sums")


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on the document and the seed alone."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f"-{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, share: float = SHARE, seed: int = SEED, topics: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per document: its cell, tokens, the cell's ``weight``, its ``probability``, and ``sampled``.

    Null and empty texts have one token; null source, language and topic are the value ''; texts of any length are read
    whole.  Rows that repeat a doc_id are drawn together; a null doc_id is drawn as one value.  An empty table gives
    an empty result; other columns are ignored.
    """
    rows = saved(described(docs, topics), "described")
    cells = saved(probabilities(raked(cell_table(rows), targets), share), "cell-probabilities")
    own = cells.select(*DIMS, "weight", "probability")
    rows = rows.join(F.broadcast(own) if cells.count() <= CELLS_SENT else own, list(DIMS))
    return rows.select("doc_id", *DIMS, "n_tokens", "weight", "probability", (draw(F.col("doc_id"), seed) < F.col("probability")).alias("sampled"))


def sample(docs: DataFrame, targets: dict[str, DataFrame] | None = None, share: float = SHARE, seed: int = SEED, topics: Callable[[Column], Column] | None = None) -> DataFrame:
    """The documents drawn, with all their columns, in one more pass over ``docs`` (no shuffle of texts).  Nulls, empty
    tables and repeated rows are taken as in ``mix``."""
    cells = saved(probabilities(raked(cell_table(described(docs, topics)), targets), share), "cell-probabilities")
    own = cells.select(*(F.col(d).alias(f"_{d}") for d in DIMS), F.col("probability").alias("_p"))
    own = F.broadcast(own) if cells.count() <= CELLS_SENT else own
    cell = {"source": F.coalesce(docs["source"], F.lit("")), "lang": F.coalesce(docs["lang"], F.lit("")), "topic": F.coalesce((topics or topic)(F.coalesce(docs["text"], F.lit(""))), F.lit(""))}
    same = draw(docs["doc_id"], seed) < own["_p"]
    for d in DIMS:
        same = same & (cell[d] == own[f"_{d}"])
    return docs.join(own, same, "left_semi")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """Weights and probabilities rounded to nine places, for sums come in any order."""
    rounded = {c: F.round(c, 9) for c in ("weight", "probability")}
    return mix(table(spark, sf_dir, "documents")).withColumns(rounded)


def sql() -> str:
    """The same in SQL: every scaling is one more common table expression."""
    steps = [
        r"""d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CASE WHEN contains(t, ' | ') THEN 'table' WHEN regexp_matches(t, '@[A-Za-z0-9-]+\.|\+1 \(') THEN 'contact'
WHEN regexp_matches(t, '(?i)licen[sc]e|copyright|all rights reserved') THEN 'notice' WHEN regexp_matches(t, '!!|###|\*\*\*') THEN 'noise' WHEN length(t) >= 4000 THEN 'long' ELSE 'prose' END AS topic,
greatest(1, len(regexp_split_to_array(trim(t), '[ \t\n\x0B\f\r]+'))) AS n_tokens FROM (SELECT *, coalesce(text, '') AS t FROM documents))""",
        "c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS n FROM d GROUP BY ALL)",
    ]
    goals = ""
    for dim in DIMS:
        steps.append(f"g_{dim} AS (SELECT {dim}, p / sum(p) OVER () AS goal_{dim} FROM (SELECT {dim}, pow(sum(n), {TEMPERATURE}) AS p FROM c GROUP BY {dim}))")
        goals += f" JOIN g_{dim} USING ({dim})"
    steps.append(f"w0 AS (SELECT *, n / sum(n) OVER () AS w FROM c{goals})")
    at = 0
    for _ in range(RAKES):
        for dim in DIMS:
            steps.append(f"w{at + 1} AS (SELECT * REPLACE (w * goal_{dim} / sum(w) OVER (PARTITION BY {dim}) AS w) FROM w{at})")
            at += 1
    steps.append(f"s0 AS (SELECT *, w / n AS ratio, {SHARE} * sum(n) OVER () AS wanted, {SHARE} * sum(n) OVER () AS scale FROM (SELECT * REPLACE (w / sum(w) OVER () AS w) FROM w{at}))")
    for k in range(SPREADS):
        left = "sum(CASE WHEN ratio * scale >= 1 THEN 0 ELSE w END) OVER ()"
        steps.append(f"s{k + 1} AS (SELECT * REPLACE (CASE WHEN {left} > 0 THEN greatest(0, wanted - sum(CASE WHEN ratio * scale >= 1 THEN n ELSE 0 END) OVER ()) / {left} ELSE scale END AS scale) FROM s{k})")
    draw = f"CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '-{SEED}'), 1, 13) AS BIGINT) / {float(1 << 52)}"
    return f"WITH {', '.join(steps)} SELECT doc_id, source, lang, topic, n_tokens, round(w, 9) AS weight, round(least(1, ratio * scale), 9) AS probability, {draw} < least(1, ratio * scale) AS sampled FROM d JOIN s{SPREADS} USING (source, lang, topic)"


SQL = sql()
