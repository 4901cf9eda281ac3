"""Review of a target against the house's clauses: modes, playbook, comments, the firewall, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import editing, fixed
from docmill.functions.rules import first_match
from docmill.functions.text import jaccard
from docmill.operators.tasks import map_rows

#: Words of a key by which a paragraph is looked for.
ANCHOR = 5


def modes(spark) -> DataFrame:
    rows = [(m, v["redline"], v["tiers"], v["comments"], v["tolerance"], v["families"]) for m, v in fixed.MODES.items()]
    return spark.createDataFrame(rows, "mode string, redline_scope array<string>, acceptable_tiers array<string>, comment_scope array<string>, risk_tolerance string, recommended_for array<string>")


def with_mode(rows: DataFrame, modes: DataFrame, default: str = fixed.DEFAULT_MODE) -> DataFrame:
    """``rows`` (with ``mode``) and their mode's settings; the table of modes is a few rows.

    No row is lost: one whose mode is not in the table, or null, gets the settings of ``default`` and keeps its ``mode``.
    """
    known = rows.join(F.broadcast(modes.select("mode", F.lit(True).alias("_known"))), "mode", "left")
    known = known.withColumn("_mode", F.when(F.col("_known"), F.col("mode")).otherwise(F.lit(default))).drop("_known")
    return known.join(F.broadcast(modes.withColumnRenamed("mode", "_mode")), "_mode", "left").drop("_mode")


def redline_scope(rows: DataFrame, risk: str = "risk_level") -> DataFrame:
    return rows.where(F.array_contains("redline_scope", F.col(risk)))


def comment_scope(rows: DataFrame, risk: str = "risk_level") -> DataFrame:
    return rows.where(F.array_contains("comment_scope", F.col(risk)))


def tier_acceptance(rows: DataFrame, tier: str = "playbook_tier") -> DataFrame:
    return rows.withColumn("acceptable", F.coalesce(F.array_contains("acceptable_tiers", F.col(tier)), F.lit(False)))


def mode_of_text(text: Column, words: list[tuple[str, list[str]]] | None = None) -> Column:
    """The mode that a request names; of several the first in the list, the strictest (our rule); null if none."""
    return first_match([F.lower(text)], fixed.MODE_WORDS if words is None else words)


def resolve_mode(rows: DataFrame, modes: DataFrame, override: str, family: str = "contract_family", default: str = fixed.DEFAULT_MODE) -> DataFrame:
    """``mode``: the override, else the mode recommended for the family, else the default."""
    own = modes.select(F.explode("recommended_for").alias("_family"), F.col("mode").alias("_mode"))
    return rows.join(F.broadcast(own), F.col(family) == F.col("_family"), "left").withColumn("mode", F.coalesce(override, "_mode", F.lit(default))).drop("_family", "_mode")


def with_playbook(clauses: DataFrame, playbook: DataFrame, on: tuple[str, ...] = ("clause_type", "contract_family")) -> DataFrame:
    """``clauses`` with their playbook entry and ``playbook_missing``; then the template's text is the baseline."""
    return clauses.join(playbook.withColumn("_there", F.lit(True)), list(on), "left").withColumn("playbook_missing", F.col("_there").isNull()).drop("_there")


def pick_comment(clauses: DataFrame, bank: DataFrame, key: list[str], order: list[Column], on: list[str]) -> DataFrame:
    """The first fitting comment of each clause; clauses without one stay, with nulls."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return clauses.join(bank, on, "left").withColumn("_n", n).where("_n = 1").drop("_n")


def mandatory_missing(rows: DataFrame, risk: str = "risk_level", fields: tuple[str, ...] = ("external_comment", "suggested_redline")) -> DataFrame:
    """Rows of high risk that lack a field they must have."""
    lacks = F.lit(False)
    for f in fields:
        lacks = lacks | F.col(f).isNull()
    return rows.where(F.col(risk).isin("critical", "high") & lacks)


def external(comments: DataFrame, text: str = "text", audience: str | None = None) -> DataFrame:
    """Comments that may leave the house: without internal ones."""
    out = comments.where(~F.coalesce(F.col(text).startswith("[INTERNAL]"), F.lit(False)))
    return out if audience is None else out.where(F.coalesce(F.col(audience) != "internal", F.lit(True)))


def or_manual(text: Column, what: str = "comment") -> Column:
    """What people must write where no text came through."""
    return F.coalesce(text, F.lit(f"[MANUAL_REQUIRED] {what}"))


def analyse(pairs: DataFrame, ours: str = "text", theirs: str = "lib_text") -> DataFrame:
    """Heuristic stand-in for judgment: ``similarity``, ``risk_level`` and ``playbook_tier`` by word overlap.

    A deterministic rule table of our own; it claims no legal judgment.
    """
    s = jaccard(F.col(ours), F.coalesce(F.col(theirs), F.lit("")))
    risk = F.when(F.col("similarity") >= 0.9, "acceptable").when(F.col("similarity") >= 0.7, "low").when(F.col("similarity") >= 0.5, "medium").when(F.col("similarity") >= 0.25, "high").otherwise("critical")
    tier = F.when(F.col("similarity") >= 0.7, "preferred").when(F.col("similarity") >= 0.5, "acceptable").when(F.col("similarity") >= 0.25, "fallback")
    return pairs.withColumn("similarity", s).withColumns({"risk_level": risk, "playbook_tier": tier, "review_basis": F.lit("library")})


def general(rows: DataFrame, text: str = "text", rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """Clauses reviewed without a house position: ``risk_level`` by the first rule whose words the text holds (our own list),
    ``review_basis`` general, and comments that name the risk alone; nothing is compared and no wording is proposed."""
    risk = F.coalesce(first_match([F.lower(F.coalesce(text, F.lit("")))], fixed.GENERAL_RISKS if rules is None else rules), F.lit("low"))
    told = F.col("risk_level").isin("critical", "high", "medium")
    out = rows.withColumns({"library_empty": F.lit(True), "review_basis": F.lit("general"), "risk_level": risk, "playbook_tier": F.lit(None).cast("string"), "suggested_redline": F.lit(None).cast("string")})
    return out.withColumns({"external_comment": F.when(told, F.lit("Please explain the reasons for this wording.")), "internal_note": F.when(told, F.concat(F.lit("[INTERNAL] "), "risk_level", F.lit(" risk by general rules; no house position")))})


def comment_texts(rows: DataFrame) -> DataFrame:
    """Template texts: an external comment, an internal note and a suggested redline, where risk asks for them."""
    hot = F.col("risk_level").isin("critical", "high", "medium")
    return rows.withColumns(
        {
            "external_comment": F.when(hot, F.concat(F.lit("We propose our standard wording for "), "clause_type", F.lit("."))),
            "internal_note": F.when(hot, F.concat(F.lit("[INTERNAL] "), "risk_level", F.lit(" risk; similarity "), F.format_number("similarity", 2))),
            "suggested_redline": F.when(hot, F.col("lib_text")),
        }
    )


def edit_table(rows: DataFrame, key: str = "clause_id", old: str = "text", new: str = "suggested_redline") -> DataFrame:
    """The redline as data: ``clause_id, op, old_text, new_text`` for body paragraphs."""
    changed = rows.where(F.col(new).isNotNull() & ~F.col(old).eqNullSafe(F.col(new)))
    ops = changed.select(key, F.explode(F.array(F.struct(F.lit("del").alias("op"), F.col(old).alias("old_text"), F.lit(None).cast("string").alias("new_text")), F.struct(F.lit("ins").alias("op"), F.lit(None).cast("string").alias("old_text"), F.col(new).alias("new_text")))).alias("e"))
    return ops.select(key, "e.*").where("coalesce(old_text, new_text) <> ''")


def paragraph_map(clauses: DataFrame, paragraphs: DataFrame, text: str = "text", body: str = "body") -> DataFrame:
    """``clauses`` with the ``paragraph_id`` of equal text, by a hashed join on the normal form."""
    norm = lambda c: F.sha2(F.lower(F.regexp_replace(F.trim(c), r"\s+", " ")), 256)
    there = paragraphs.select(norm(F.col(text)).alias("_h"), "paragraph_id").groupBy("_h").agg(F.min("paragraph_id").alias("paragraph_id"))
    return clauses.withColumn("_h", norm(F.col(body))).join(there, "_h", "left").drop("_h")


#: Rows that may be sent to every task: keys of paragraphs, 16 bytes each.
KEYS_SENT = 1 << 20


def _normal(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))


def _grams(words: Column, n: int) -> Column:
    """The hashes of all runs of ``n`` words, in order; none for fewer words."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(n))))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<bigint>"))


def paragraph_contains(clauses: DataFrame, paragraphs: DataFrame, key: str, text: str = "text", body: str = "body") -> DataFrame:
    """``key, paragraph_id``: each paragraph whose whole text stands in a clause of that key, in the normal form.

    Words inside a paragraph, all but its first and last, are whole words of a clause that holds it: three of them (one
    in a paragraph of three or four words) are the key of a hash join.  Of one or two words only an end and a beginning are
    known: pieces of that length of a clause's distinct words, or pairs of them, are the key, one for each length that a
    paragraph has.  The paragraphs found in a document are compared inside its row, where its text is once; empty ones are
    nowhere.
    """
    said = clauses.select(F.col(key), _normal(F.col(body)).alias("_body")).where("_body is not null")
    own = paragraphs.select("paragraph_id", _normal(F.col(text)).alias("_text")).where("_text <> ''").withColumn("_w", F.split("_text", " ")).withColumn("_n", F.size("_w"))
    # equal bodies are one, so that copies of a document meet a paragraph once
    bodies = said.groupBy(F.sha2("_body", 256).alias("_h")).agg(F.first("_body").alias("_body")).withColumn("_w", F.split("_body", " "))
    found = []
    for least, most, n in ((3, 4, 1), (5, None, 3)):
        some = own.where(F.col("_n") >= least if most is None else F.col("_n").between(least, most))
        found.append((some.select("paragraph_id", "_text", F.xxhash64(*(F.get("_w", F.lit(1 + k)) for k in range(n))).alias("_k")), bodies.select("_h", F.explode(F.array_distinct(_grams(F.col("_w"), n))).alias("_k"))))
    short = own.where("_n < 3").withColumns({"_a": F.length(F.get("_w", F.lit(0))), "_b": F.when(F.col("_n") == 2, F.length(F.get("_w", F.lit(1))))})
    # at most as many as there are lengths of words, squared
    for r in short.select("_a", "_b").distinct().collect():
        some = short.where(F.col("_a").eqNullSafe(r["_a"]) & F.col("_b").eqNullSafe(r["_b"])).select("paragraph_id", "_text", F.xxhash64("_text").alias("_k"))
        long_enough = F.filter(F.array_distinct("_w"), lambda w: F.length(w) >= r["_a"])
        if r["_b"] is None:
            pieces = F.flatten(F.transform(long_enough, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - r["_a"] + 1), lambda i: F.substring(w, i, F.lit(r["_a"])))))
        else:
            pairs = F.transform(F.sequence(F.lit(0), F.size("_w") - 2), lambda i: F.struct(F.get("_w", i).alias("a"), F.get("_w", i + 1).alias("b")))
            pairs = F.filter(F.when(F.size("_w") > 1, pairs), lambda p: (F.length(p["a"]) >= r["_a"]) & (F.length(p["b"]) >= r["_b"]))
            pieces = F.transform(pairs, lambda p: F.concat(F.right(p["a"], F.lit(r["_a"])), F.lit(" "), F.left(p["b"], F.lit(r["_b"]))))
        found.append((some, bodies.select("_h", F.explode(F.transform(F.array_distinct(pieces), lambda x: F.xxhash64(x))).alias("_k"))))
    pairs = None
    for keys, there in found:
        one = there.join(keys, "_k").select("_h", "paragraph_id", "_text")
        pairs = one if pairs is None else pairs.union(one)
    held = pairs.distinct().groupBy("_h").agg(F.collect_list(F.struct("paragraph_id", "_text")).alias("_p"))
    sure = held.join(bodies.select("_h", "_body"), "_h").select("_h", F.explode(F.filter("_p", lambda p: F.contains(F.col("_body"), p["_text"]))).alias("_p"))
    return said.select(key, F.sha2("_body", 256).alias("_h")).join(sure, "_h").select(key, F.col("_p.paragraph_id").alias("paragraph_id")).distinct()


def paragraph_fuzzy(clauses: DataFrame, paragraphs: DataFrame, key: str, text: str = "text", body: str = "body", percent: int = 10) -> DataFrame:
    """``key, paragraph_id, distance``: each paragraph that stands in a clause of that key with few words changed.

    The distance is the least number of words to insert, delete or replace that turn some run of the clause's words into
    the paragraph; up to ``percent`` of the paragraph's words, rounded down, may differ (none of a short one).  A paragraph
    with e errors at most, cut into e + 1 pieces, has one piece without error, so the runs of ``ANCHOR`` words (fewer where
    pieces are shorter) that are rarest among the paragraphs in each piece are the keys of a hash join, and nothing within
    the bound is missed.  A match gives the place at which the paragraph would begin; the words around it are cut out of
    the document's own row, and a banded edit distance decides.  Equal paragraphs and equal bodies are compared once.  Null
    and blank texts are nowhere.
    """
    # the words of the normal form, which nothing here needs as a text
    stripped = lambda c: F.btrim(F.col(c), F.lit(" \t\n\x0b\f\r"))
    words = lambda c: F.split(F.lower(stripped(c)), r"\s+")
    said = clauses.select(F.col(key), F.col(body).alias("_body")).where(stripped("_body") != "").withColumn("_h", F.sha2("_body", 256))
    bodies = said.groupBy("_h").agg(F.first("_body").alias("_body"))
    own = paragraphs.select("paragraph_id", _normal(stripped(text)).alias("_text")).where("_text <> ''").withColumn("_p", F.sha2("_text", 256))
    distinct = own.groupBy("_p").agg(F.first("_text").alias("_text")).select("_p", F.split("_text", " ").alias("_pw"))
    distinct = distinct.withColumn("_n", F.size("_pw")).withColumn("_e", F.floor(F.col("_n") * percent / 100).cast("int"))
    # piece i of e + 1 has the words from i * n / (e + 1) on; every piece has as many words as the shortest or one more
    size = F.least(F.lit(ANCHOR), F.floor(F.col("_n") / (F.col("_e") + 1)).cast("int"))
    cut = distinct.select("_p", "_n", "_e", "_pw", size.alias("_size"), F.explode(F.sequence(F.lit(0), F.col("_e"))).alias("_i"))
    begin = lambda i: F.floor(i * F.col("_n") / (F.col("_e") + 1)).cast("int")
    runs = F.sequence(begin(F.col("_i")), begin(F.col("_i") + 1) - F.col("_size"))
    grams = cut.select("_p", "_n", "_e", "_size", "_i", F.explode(F.transform(runs, lambda at: F.struct(at.alias("at"), F.xxhash64(F.slice("_pw", at + 1, F.col("_size"))).alias("k")))).alias("g")).select("_p", "_n", "_e", "_size", "_i", "g.at", "g.k")
    common = grams.groupBy("_size", "k").agg(F.count("*").alias("_often"))
    rarest = grams.join(common, ["_size", "k"]).groupBy("_p", "_n", "_e", "_size", "_i").agg(F.min(F.struct("_often", "at", "k")).alias("g"))
    keys = rarest.select("_p", "_n", "_e", "_size", F.col("g.at").alias("_at"), F.col("g.k").alias("_k"))
    sizes = sorted(r["_size"] for r in keys.select("_size").distinct().collect())  # ANCHOR of them at most
    spark = clauses.sparkSession
    if not sizes:
        return spark.createDataFrame([], f"`{key}` {dict(clauses.dtypes)[key]}, paragraph_id {dict(paragraphs.dtypes)['paragraph_id']}, distance int")
    # each word beside those that follow it: rows of strings are hashed by generated code, which a lambda's slices are not
    most = range(sizes[-1])
    beside = bodies.select("_h", words("_body").alias("_w")).select("_h", F.posexplode(F.arrays_zip(*(F.slice("_w", 1 + k, F.greatest(F.lit(0), F.size("_w") - k)).alias(f"w{k}") for k in most))).alias("_pos", "_run"))
    beside = beside.select("_h", "_pos", *(F.col(f"_run.w{k}").alias(f"w{k}") for k in most))
    one = lambda n: F.struct(F.lit(n).alias("_size"), F.when(F.col(f"w{n - 1}").isNotNull(), F.xxhash64(*(f"w{k}" for k in range(n)))).alias("_k"))
    there = beside.select("_h", "_pos", F.explode(F.array(*map(one, sizes))).alias("_g")).select("_h", "_pos", "_g.*")
    few = F.broadcast(keys) if keys.count() <= KEYS_SENT else keys
    found = there.join(few, ["_size", "_k"]).select("_h", "_p", "_n", "_e", (F.col("_pos") - F.col("_at")).alias("_from"))
    places = found.distinct().groupBy("_h").agg(F.collect_list(F.struct("_p", "_n", "_e", "_from")).alias("_places"))
    window = lambda x: F.slice(F.col("_w"), F.greatest(F.lit(1), x["_from"] - x["_e"] + 1), F.greatest(F.lit(0), x["_n"] + 2 * x["_e"] + F.least(F.lit(0), x["_from"] - x["_e"])))
    cuts = places.join(bodies, "_h").withColumn("_w", words("_body")).select("_h", F.explode(F.transform("_places", lambda x: F.struct(x["_p"].alias("_p"), x["_e"].alias("_e"), window(x).alias("_words")))).alias("x")).select("_h", "x.*").distinct()
    near = map_rows(cuts.join(distinct.select("_p", "_pw"), "_p"), lambda r: editing.errors_inside(r["_pw"], r["_words"], r["_e"]), "distance", "int", ["_pw", "_words"], limit=4096)
    best = near.where("distance is not null").groupBy("_h", "_p").agg(F.min("distance").alias("distance"))
    rows = said.select(key, "_h").join(best, "_h").join(own.select("_p", "paragraph_id"), "_p")
    return rows.groupBy(key, "paragraph_id").agg(F.min("distance").alias("distance"))


def mapping_coverage(mapped: DataFrame, goal: float = fixed.MAPPING_TARGET) -> DataFrame:
    out = mapped.agg(F.count("*").alias("n"), F.count("paragraph_id").alias("mapped"))
    rate = F.when(F.col("n") > 0, F.col("mapped") / F.col("n")).otherwise(0.0)
    return out.withColumns({"coverage": rate, "reached": rate >= goal})


def risk_profile(rows: DataFrame, risk: str = "risk_level") -> DataFrame:
    """One row: how many clauses of each risk."""
    return rows.agg(*(F.count_if(F.col(risk) == r).alias(f"n_{r}") for r in fixed.RISKS))


def severity(risk: Column) -> Column:
    table = F.create_map(*(F.lit(x) for i, r in enumerate(fixed.RISKS) for x in (r, i)))
    return F.coalesce(F.try_element_at(table, risk), F.lit(len(fixed.RISKS)))


def top_issues(rows: DataFrame, key: str = "clause_id", k: int = 5, risk: str = "risk_level") -> DataFrame:
    return rows.orderBy(severity(F.col(risk)), key).limit(k)


def draft_tier(leverage: Column) -> Column:
    """The tier of clause that a bargaining position drafts from."""
    table = F.create_map(*(F.lit(x) for pair in fixed.LEVERAGE.items() for x in pair))
    return F.coalesce(F.try_element_at(table, leverage), F.lit("acceptable"))


def output_language(override: Column, contract: Column) -> Column:
    return F.coalesce(override, contract, F.lit("ko"))


def inject_context(chunks: DataFrame, *contexts: DataFrame) -> DataFrame:
    """Shared context of a document beside each of its chunks."""
    for c in contexts:
        chunks = chunks.join(c, "doc_id", "left")
    return chunks


def merge_chunks(*parts: DataFrame, key: tuple[str, ...] = ("doc_id", "clause_id")) -> DataFrame:
    """The results of a document's chunks as one table; of rows that overlapping chunks share, one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.dropDuplicates(list(key))


def report(rows: DataFrame, key: str = "doc_id", k: int = 5, risk: str = "risk_level") -> DataFrame:
    """The data of a review's report, one JSON text a document: counts by risk, scopes and its ``k`` gravest clauses.

    The gravest are taken by a group limit before anything is gathered, so a row holds ``k`` of them at most.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(severity(F.col(risk)), "clause_id"))
    top = rows.withColumn("_n", place).where(F.col("_n") <= k).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", "clause_id", risk))).alias("_top"))
    counts = rows.groupBy(key).agg(F.count("*").alias("clauses"), *(F.count_if(F.col(risk) == r).alias(f"n_{r}") for r in fixed.RISKS), F.count_if("redline").alias("redlines"), F.count_if("comment").alias("comments"))
    whole = counts.join(top, key, "left")
    body = F.struct("clauses", *(f"n_{r}" for r in fixed.RISKS), "redlines", "comments", F.transform("_top", lambda x: F.struct(x["clause_id"].alias("clause_id"), x[risk].alias(risk))).alias("key_issues"))
    return whole.select(key, F.to_json(body).alias("report"))
