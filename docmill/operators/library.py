"""Classification, manifests, validation, the approval gate and the indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import fixed
from docmill.functions.rules import cascade
from docmill.functions.text import percent, ratio, rounded, slug

from docmill.operators.tasks import saved

from . import structure

#: Tasks that the copies of one file are dealt to.
SALTS = 16


def fingerprints(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with ``sha256`` of their bytes."""
    return files.withColumn("sha256", F.sha2(F.col(content), 256))


def doc_id(name: Column) -> Column:
    """The identifier of a file name."""
    return slug(F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(?<=.)\.[^.]*$", ""), fixed.SLUG_WORDS, fixed.SLUG_SUFFIX)


def flag_duplicates(files: DataFrame, known: DataFrame, within: bool = False) -> DataFrame:
    """``files`` with ``status``: ``duplicate`` if ``known`` (sha256) has the hash, else ``new``.

    ``within``: files that repeat an earlier one (by path) of the same batch are duplicates as well.  Hashes are then written
    once beside their paths, and only those that occur again are joined, by a salt, too, so that the copies of one file
    are dealt to several tasks.
    """
    seen = known.select(F.col("sha256").alias("_seen")).distinct()
    status = lambda known_by: F.when(F.col(known_by).isNotNull(), "duplicate").otherwise("new")
    if not within:
        return files.join(seen, F.col("sha256") == F.col("_seen"), "left").withColumn("status", status("_seen")).drop("_seen")
    keys = saved(files.select("path", "sha256"), "hashes")
    again = keys.groupBy("sha256").agg(F.min("path").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    again = again.select("sha256", "_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    later = keys.withColumn("_salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")).join(again, ["sha256", "_salt"]).where("path > _first")
    old = keys.join(seen, F.col("sha256") == F.col("_seen"), "left_semi")
    copies = later.select("path").union(old.select("path")).distinct().withColumnRenamed("path", "_path")
    return files.join(copies, F.col("path") == F.col("_path"), "left").withColumn("status", status("_path")).drop("_path")


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """The files whose hash is not known; comes before any parsing."""
    return files.join(known.select("sha256").distinct(), "sha256", "left_anti")


def near_duplicates(docs: DataFrame, others: DataFrame, limit: float = 0.9) -> DataFrame:
    """Pairs of one family whose word sets are alike; flags, never blocks.

    Two sets of that similarity share one of the words that are rarest in the family, of which a set of n words needs
    n - ceil(limit * n) + 1; only documents that share such a word are compared.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"(?U)[^\w]+"), lambda w: w != ""))
    side = lambda df, name: df.select(F.col("doc_id").alias(name), F.col("contract_family").alias("_family"), words.alias(f"_w_{name}"))
    a, b = side(docs, "doc_id"), side(others, "other_id")
    flat = lambda df, name: df.select(name, "_family", F.size(f"_w_{name}").alias("_n"), F.explode(f"_w_{name}").alias("_word"))
    often = flat(a, "doc_id").unionByName(flat(b, "other_id").withColumnRenamed("other_id", "doc_id")).groupBy("_family", "_word").agg(F.count("*").alias("_c"))

    def rare(df, name):
        ranked = flat(df, name).join(often, ["_family", "_word"]).withColumn("_place", F.row_number().over(Window.partitionBy(name, "_family").orderBy("_c", "_word")))
        return ranked.where(F.col("_place") <= F.col("_n") - F.ceil(F.lit(limit) * F.col("_n")) + 1).select(name, "_family", "_word")

    pairs = rare(a, "doc_id").join(rare(b, "other_id"), ["_family", "_word"]).where("doc_id != other_id").select("doc_id", "other_id", "_family").distinct()
    both = pairs.join(a, ["doc_id", "_family"]).join(b, ["other_id", "_family"])
    shared = F.size(F.array_intersect("_w_doc_id", "_w_other_id"))
    alike = both.withColumn("similarity", ratio(shared, F.size("_w_doc_id") + F.size("_w_other_id") - shared))
    return alike.where(F.col("similarity") >= limit).select("doc_id", "other_id", "similarity")


def status_summary(rows: DataFrame, column: str = "status") -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def run_totals(rows: DataFrame, state: str = "approval_state") -> DataFrame:
    """``processed, approved, staged, quarantined`` of a run, in one pass."""
    return rows.agg(F.count("*").alias("processed"), *(F.count_if(F.col(state) == s).alias(n) for n, s in (("approved", "approved"), ("staged", "staging"), ("quarantined", "quarantined"))))


def classify(docs: DataFrame, by: str = "doc_id", source: str = "source_file") -> DataFrame:
    """``docs`` with the classification axes, from an identifier's parts: first match wins, else ``other``."""
    key = F.col(by)
    stages = [cascade(key, [(part, F.lit(names[i])) for part, *names in fixed.STAGES], F.lit("")) for i in (0, 1)]
    has_stage = stages[0] != ""
    part, whole, apart = fixed.FORMS
    forms = [F.when(key.contains(part), whole[i]).otherwise(apart[i]) for i in (0, 1)]

    def title(i: int, pattern: str, bare: str | None) -> Column:
        pieces: list[Column] = []
        for k, text in enumerate(pattern.split("{stage}")):
            if k:
                pieces += [F.lit("["), stages[i], F.lit("] ")]
            head, found, tail = text.partition("{form_en}") if "{form_en}" in text else text.partition("{form}")
            pieces.append(F.lit(head))
            if found:
                pieces += [forms[1] if found == "{form_en}" else forms[0], F.lit(tail)]
        full = F.concat(*pieces)
        return full if bare is None else F.when(has_stage, full).otherwise(bare)

    rows = fixed.FAMILIES
    axis = lambda value, default: cascade(key, [(r[0], value(r)) for r in rows], default)
    known = F.lit(False)
    for r in rows:
        known = known | key.contains(r[0])
    columns = {k: F.lit(v) for k, v in fixed.CONSTANT.items()} | {
        "contract_family": axis(lambda r: F.lit(r[1]), F.lit(fixed.OTHER_FAMILY[0])),
        "subtype": axis(lambda r: F.lit(r[2]), F.lit(fixed.OTHER_FAMILY[1])),
        "title": axis(lambda r: title(0, r[3], r[5]), F.col(source)),
        "title_en": axis(lambda r: title(1, r[4], r[6]), F.lit("")),
        "classification_confidence": F.when(known, "high").otherwise("low"),
    }
    return docs.withColumns(columns)


def with_sidecar(docs: DataFrame, sidecar: DataFrame, key: str = "doc_id") -> DataFrame:
    """Values of ``sidecar`` win over those of ``docs``; columns it lacks stay."""
    own = [c for c in sidecar.columns if c != key and c in docs.columns]
    side = sidecar.select(key, *(F.col(c).alias(f"_side_{c}") for c in own))
    return docs.join(side, key, "left").withColumns({c: F.coalesce(f"_side_{c}", c) for c in own}).drop(*(f"_side_{c}" for c in own))


def resolve_alias(rows: DataFrame, families: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``contract_family`` of an alias, id or name, without regard to case; null if unknown."""
    every = families.select(F.col("id"), F.explode(F.concat(F.array("id", "name"), F.coalesce("aliases", F.array()))).alias("a"))
    aliases = every.select(F.lower("a").alias("_alias"), F.col("id").alias("contract_family")).dropDuplicates(["_alias"])
    return rows.join(F.broadcast(aliases), F.lower(F.col(name)) == F.col("_alias"), "left").drop("_alias")


def clause_stats(clauses: DataFrame) -> DataFrame:
    """``doc_id, total_clauses, unmapped_clauses, unmapped_ratio``."""
    out = clauses.groupBy("doc_id").agg(F.count("*").alias("total_clauses"), F.count_if(F.col("clause_type") == fixed.NO_TYPE).alias("unmapped_clauses"))
    return out.withColumn("unmapped_ratio", rounded(ratio(F.col("unmapped_clauses"), F.col("total_clauses"))))


def _clause_counts(types: str) -> list[Column]:
    total, unmapped = F.size(types), F.size(F.filter(types, lambda t: t == fixed.NO_TYPE))
    return [total.cast("long").alias("total_clauses"), unmapped.cast("long").alias("unmapped_clauses"), rounded(ratio(unmapped, total)).alias("unmapped_ratio")]


def clause_counts(docs: DataFrame, text: str = "text", is_boundary=structure.boundary, **rules) -> DataFrame:
    """``docs`` with the struct ``stats`` of its clauses' counts alone, for checks that look at no other part."""
    return structure.with_types(docs, text, is_boundary, "_types", **rules).withColumn("stats", F.struct(*_clause_counts("_types"))).drop("_types")


def document_stats(docs: DataFrame, text: str = "text", term_pattern: str = fixed.TERM, is_boundary=structure.boundary, **rules) -> DataFrame:
    """``docs`` with the struct ``stats``: all counts of a document's parts, worked out inside its row, so that nothing
    shuffles; documents without any have zeros."""
    rows = structure.with_types(docs, text, is_boundary, "_types", **rules)
    rows = structure.with_outline(structure.with_terms(rows, text, term_pattern), text)
    count = lambda x: F.size(x).cast("long")
    parts = [count("_terms").alias("defined_terms"), count("_outline").alias("sections"), count(structure.exhibit_array(F.col(text))).alias("exhibits")]
    return rows.withColumn("stats", F.struct(*_clause_counts("_types"), *parts)).drop("_types", "_terms", "_outline")


def manifest(docs: DataFrame, run_ts: str) -> DataFrame:
    """Manifest rows of classified documents with ``source_file``, ``sha256`` and ``stats``, in the order of fields."""
    lit = F.lit
    return docs.select(
        "doc_id", "title", "title_en", "doc_class", "contract_family", "subtype", "paper_role", "jurisdiction", "governing_law", "language",
        lit("pending").alias("approval_state"), lit("active").alias("status"), "sha256", "source_file", lit(run_ts).alias("created_at"), lit(run_ts).alias("updated_at"),
        "classification_confidence", lit("preferred").alias("authority_level"), lit(False).alias("external_safe"), lit(False).alias("freshness_sensitive"),
        F.array(*map(lit, fixed.TAGS)).alias("tags"), lit(fixed.NOTES).alias("notes"), lit(fixed.INDUSTRY).alias("industry"), "stats",
    )


def validate(rows: DataFrame, required: list[str] | None = None, unmapped_limit: float = fixed.UNMAPPED_LIMIT, least_clauses: int = fixed.LEAST_CLAUSES, enums: bool | dict[str, list[str]] = False, more_soft: list[Column] | None = None) -> DataFrame:
    """``rows`` with ``hard_fails``, ``soft_fails`` and ``schema_valid``.  An empty required field counts as missing.

    ``enums``: values outside the allowed ones (the fixed ones, or those of a schema policy) fail as well.
    ``more_soft``: further checks, each null or a reason.
    """
    allowed = fixed.ALLOWED if enums is True else enums or {}
    empty = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    hard = [F.when(empty(c), F.lit(f"Missing required field: {c}")) for c in (fixed.REQUIRED if required is None else required)]
    if "doc_id" in rows.columns:
        hard.append(F.when(~F.coalesce("doc_id", F.lit("")).rlike(fixed.DOC_ID), F.concat(F.lit("Invalid doc_id format: "), F.coalesce("doc_id", F.lit("None")))))
    if "sha256" in rows.columns:
        hard.append(F.when(~F.coalesce("sha256", F.lit("")).rlike(fixed.SHA256), F.lit("Invalid sha256 format")))
    hard += [F.when(~empty(c) & ~F.col(c).isin(v), F.concat(F.lit(f"Invalid {c}: "), F.col(c))) for c, v in allowed.items() if c in rows.columns]
    part, total = F.col("stats.unmapped_ratio"), F.col("stats.total_clauses")
    soft = [
        F.when(part > unmapped_limit, F.concat(F.lit("Unmapped clause ratio "), percent(part), F.lit(f" exceeds {unmapped_limit:.0%}"))),
        F.when(F.col("classification_confidence") == "low", F.lit("Low classification confidence")),
        F.when(total < least_clauses, F.concat(F.lit("Only "), total.cast("string"), F.lit(" clauses detected"))),
        *(more_soft or []),
    ]
    out = rows.withColumns({"hard_fails": F.array_compact(F.array(*hard)), "soft_fails": F.array_compact(F.array(*soft))})
    return out.withColumn("schema_valid", F.size("hard_fails") == 0)


def gate(rows: DataFrame, auto: bool = True, asset_rules: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``approval_state``: quarantined, staging or approved, a partition of all rows.

    ``auto`` off stages what would be approved; so does an asset type that ``asset_rules`` sends to people.
    """
    state = F.when(F.size("hard_fails") > 0, "quarantined").when(F.size("soft_fails") > 0, "staging")
    if not auto:
        return rows.withColumn("approval_state", state.otherwise("staging"))
    if asset_rules is None:
        return rows.withColumn("approval_state", state.otherwise("approved"))
    rules = F.broadcast(asset_rules.select(F.col("asset_type").alias("doc_class"), F.col("auto_approvable").alias("_auto")))
    return rows.join(rules, "doc_class", "left").withColumn("approval_state", state.when(F.coalesce("_auto", F.lit(False)), "approved").otherwise("staging")).drop("_auto")


def asset_rules(spark) -> DataFrame:
    """The approval rules by asset type."""
    return spark.createDataFrame(fixed.ASSET_RULES, "asset_type string, auto_approvable boolean, requires_human_fields array<string>, default_authority_level string, default_external_safe boolean")


def enrich(rows: DataFrame, asset_rules: DataFrame) -> DataFrame:
    """Authority and external safety by asset type where a row has none of its own."""
    side = F.broadcast(asset_rules.select(F.col("asset_type").alias("doc_class"), F.col("default_authority_level").alias("_level"), F.col("default_external_safe").alias("_safe")))
    own = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    return rows.join(side, "doc_class", "left").withColumns({"authority_level": F.coalesce(own("authority_level"), "_level"), "external_safe": F.coalesce(own("external_safe"), "_safe")}).drop("_level", "_safe")


def index_documents(manifests: DataFrame) -> DataFrame:
    """Index rows of approved manifests."""
    path = F.concat(F.lit("approved/templates/"), "contract_family", F.lit("/"), "doc_id", F.lit("/"))
    ok = manifests.where(F.col("approval_state") == "approved")
    return ok.select(
        "doc_id", "title", "doc_class", "contract_family", F.coalesce("subtype", F.lit("")).alias("subtype"), "paper_role", "jurisdiction", "language",
        F.coalesce("authority_level", F.lit("preferred")).alias("authority_level"), "approval_state", F.lit("active").alias("status"), "sha256", "source_file", path.alias("path"), "created_at",
    )


def index_clauses(documents: DataFrame, clauses: DataFrame) -> DataFrame:
    return clauses.join(documents.select("doc_id", "contract_family"), "doc_id").select("doc_id", "clause_id", "clause_type", "header", "contract_family")


def index_terms(documents: DataFrame, terms: DataFrame) -> DataFrame:
    return terms.join(documents.select("doc_id"), "doc_id", "left_semi").select("doc_id", "term", "first_line")


def retrieval_map(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "contract_family", F.coalesce("subtype", F.lit("")).alias("subtype"), F.coalesce("authority_level", F.lit("preferred")).alias("authority_level"), "path")


def clause_bank(documents: DataFrame, clauses: DataFrame) -> DataFrame:
    """The clauses of approved documents with their texts."""
    return clauses.join(documents.select("doc_id", "contract_family", "authority_level"), "doc_id")


def extraction_loss(docs: DataFrame, before: str, after: str, limit: float = fixed.LOSS_LIMIT, headings: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with ``kept_ratio`` of characters and whether too much was ``lost``.

    ``headings``: patterns that tell a heading in the source and in what was made of it; then the numbers of both are
    compared as well (``headings_before, headings_after, headings_lost``).
    """
    kept = ratio(F.length(after), F.length(before))
    out = docs.withColumn("kept_ratio", kept).withColumn("lost", kept < limit)
    if headings:
        counts = (F.regexp_count(F.coalesce(c, F.lit("")), F.lit(p)).cast("long") for c, p in zip((before, after), headings, strict=True))
        out = out.withColumns(dict(zip(("headings_before", "headings_after"), counts, strict=True))).withColumn("headings_lost", F.col("headings_after") < F.col("headings_before"))
    return out
