"""The commands of a document library as lazily built plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import fixed
from docmill.functions.text import jaccard, line_count, word_count
from docmill.operators import library, lifecycle, retrieve, review, rounds, structure
from docmill.sources.keyed import KeyedIndex
from docmill.sources.policy import Policies


@dataclass
class Package:
    """What an ingest makes; every part is a plan."""

    files: DataFrame
    manifests: DataFrame
    clauses: DataFrame
    terms: DataFrame
    outline: DataFrame
    crossrefs: DataFrame
    exhibits: DataFrame
    #: Every reference with the label it points at, by the document's own index.
    references: DataFrame | None = None

    @property
    def approved(self) -> DataFrame:
        return library.index_documents(self.manifests)

    def indexes(self) -> dict[str, DataFrame]:
        docs = self.approved
        return {"documents": docs, "clauses": library.index_clauses(docs, self.clauses), "terms": library.index_terms(docs, self.terms), "retrieval_map": library.retrieval_map(docs)}


class Library:
    """Ingest, list, search and change a library held as tables."""

    @staticmethod
    def run_records(files: DataFrame, run_ts: str) -> DataFrame:
        """Records of normalised files: ``doc_id, source_file, sha256, timestamp, md_lines, word_count``."""
        return files.select("doc_id", "source_file", "sha256", F.lit(run_ts).alias("timestamp"), F.lit(True).alias("normalized"), line_count(F.col("md")).alias("md_lines"), word_count(F.col("plain")).alias("word_count"))

    @staticmethod
    def ingest(files: DataFrame, known: DataFrame, run_ts: str, auto: bool | None = None, term_pattern: str = fixed.TERM, sidecar: DataFrame | None = None, policies: Policies | None = None, check_structure: bool = False) -> Package:
        """``files``: ``path, file_name, sha256, md``; those whose hash is ``known`` are left out before parsing.

        ``sidecar``: values by ``doc_id`` that win over the inferred ones.  ``auto`` overrides the approval policy.
        ``check_structure``: breaks in the numbering and references that point nowhere are soft fails.
        """
        own = policies or Policies()
        auto = own.approval.auto if auto is None else auto
        flagged = library.flag_duplicates(files, known)
        docs = flagged.where("status = 'new'").select(library.doc_id(F.col("file_name")).alias("doc_id"), F.col("file_name").alias("source_file"), "sha256", F.col("md").alias("text"))
        classified = library.classify(docs)
        if sidecar is not None:
            classified = library.with_sidecar(classified, sidecar)
        classified = library.document_stats(classified, term_pattern=term_pattern)
        required, allowed = own.schema.required["manifest"], own.schema.allowed["manifest"] if policies else False
        rows, references = library.manifest(classified, run_ts), structure.reference_graph(docs)
        if check_structure:
            lost = references.where("not resolved").groupBy("doc_id").agg(F.count("*").alias("_lost"))
            rows = rows.join(structure.numbering_fails(docs).withColumnRenamed("gaps", "_gaps"), "doc_id", "left").join(lost, "doc_id", "left")
            told = lambda c, what: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(what)))
            checked = library.validate(rows, required, enums=allowed, more_soft=[told("_gaps", " breaks in the numbering"), told("_lost", " references point nowhere")]).drop("_gaps", "_lost")
        else:
            checked = library.validate(rows, required, enums=allowed)
        manifests = library.gate(checked, auto, own.approval.frame(files.sparkSession) if policies else None)
        return Package(flagged, manifests, structure.clauses(docs), structure.defined_terms(docs, pattern=term_pattern), structure.outline(docs), structure.crossrefs(docs), structure.exhibits(docs), references)

    list = staticmethod(lifecycle.search)
    search = staticmethod(lifecycle.search)
    supersede = staticmethod(lifecycle.supersede)
    decide = staticmethod(lifecycle.decide)

    @staticmethod
    def show(rows: DataFrame, doc_id: str) -> DataFrame:
        return rows.where(F.col("doc_id") == doc_id)

    @staticmethod
    def deprecate(rows: DataFrame, ids: DataFrame) -> DataFrame:
        return lifecycle.set_status(rows, ids, "deprecated")

    @staticmethod
    def archive(rows: DataFrame, ids: DataFrame) -> DataFrame:
        return lifecycle.set_status(rows, ids, "archived")

    @staticmethod
    def refresh(rows: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
        hit = rows.join(ids.select("doc_id", F.lit(True).alias("_hit")).distinct(), "doc_id", "left")
        return hit.withColumn("last_legal_refresh_date", F.when(F.col("_hit"), as_of).otherwise(F.col("last_legal_refresh_date"))).drop("_hit")

    @staticmethod
    def rebuild_index(package: Package) -> dict[str, DataFrame]:
        return package.indexes()

    @staticmethod
    def repair_indexes(manifests: DataFrame, clauses: DataFrame, terms: DataFrame, folder: str) -> dict[str, list[int]]:
        """Make the stored indexes in ``folder`` what the stored packages say, and tell which buckets were not.

        All of ``manifests`` (with ``approval_state``), ``clauses`` and ``terms`` is read; buckets whose digests agree are not
        written.  An index that is not there yet is made.
        """
        stored = Package(manifests, manifests, clauses, terms, manifests, manifests, manifests).indexes()
        names = {"documents": ["doc_id"], "clauses": ["doc_id", "clause_id"], "terms": ["doc_id", "term"], "retrieval_map": ["doc_id"]}
        out = {}
        for name, parts in names.items():
            rows = stored[name].withColumn("key", F.concat_ws("/", *parts))
            schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
            out[name] = KeyedIndex(rows.sparkSession, f"{folder}/{name}", "key", schema).repair(rows)
        return out


class Review:
    """Comparing a target's clauses with the library's."""

    @staticmethod
    def run(target: DataFrame, bank: DataFrame, documents: DataFrame, modes: DataFrame | None = None, pairs: DataFrame | None = None, external: bool = False, override: str | None = None, as_of: Column | None = None, policies: Policies | None = None) -> DataFrame:
        """One row per target clause: its best house clause, risk, tier, texts, and the scopes of its mode.

        ``target``: ``clause_id, clause_type, contract_family, text, jurisdiction, governing_law``;
        ``bank``: library clauses with their document's fields and ``text``.  What may not be shown or used leaves the
        bank before any candidate is taken from it, so that related families cannot bring it back.  ``as_of``: the day
        by which clauses of documents that were not refreshed in time are ranked down, left out or flagged.  An empty
        ``bank`` means ``general``.
        """
        own, spark = policies or Policies(), target.sparkSession
        rules = own.retrieval
        modes = own.review.frame(spark) if modes is None else modes
        if override is not None and modes.where(F.col("mode") == override).isEmpty():
            raise ValueError(f"no mode is called {override}")
        if bank.isEmpty():
            return Review.general(target, modes, own, override)
        pairs = retrieve.affinity_pairs(spark, rules.affinity) if pairs is None else pairs
        bank = retrieve.external_only(retrieve.exclude(bank, documents, prefix="", values=rules.excluded, superseded=rules.superseded), external, rules.external_field)
        if as_of is not None and rules.refreshed in bank.columns:
            bank = retrieve.freshness(bank, rules.refreshed, as_of, rules.stale_handling, rules.stale_days, rules.penalty).withColumnRenamed("penalty", "stale_penalty")
        how = {"family": rules.family, "optional": tuple(c for c in rules.optional if c in bank.columns and c in target.columns), "required": rules.required}
        late = F.col("lib_stale_penalty") if "stale_penalty" in bank.columns else F.lit(0)
        own_rank = retrieve.rank_of(retrieve.priority(F.col("lib_doc_class"), F.col("lib_authority_level"), F.col("lib_approval_state")), rules.priority) + late
        wide = retrieve.likeliest(target, bank, pairs, "clause_id", own_rank, narrow_by=rules.narrow_by, above=rules.narrow_above, below=rules.widen_below, penalty=rules.penalty, **how)
        rank = own_rank + F.col("penalty")
        order = [F.col("rank"), F.desc(F.col("clause_type") == F.col("lib_clause_type")), F.desc(jaccard(F.col("text"), F.coalesce("lib_text", F.lit("")))), F.col("lib_doc_id"), F.col("lib_clause_id")]
        top = retrieve.best(wide.withColumn("rank", rank), "clause_id", order).drop("place")
        lost = [c for c in top.columns if c not in target.columns]
        rows = target.join(top.select("clause_id", *lost), "clause_id", "left").withColumn("library_empty", F.col("lib_doc_id").isNull())
        rows = review.comment_texts(review.analyse(rows))
        rows = review.with_mode(review.resolve_mode(rows.withColumn("_override", F.lit(override).cast("string")), modes, "_override", default=own.review.default).drop("_override"), modes, own.review.default)
        return review.tier_acceptance(rows).withColumns({"redline": F.array_contains("redline_scope", F.col("risk_level")), "comment": F.array_contains("comment_scope", F.col("risk_level"))})

    @staticmethod
    def general(target: DataFrame, modes: DataFrame, own: Policies, override: str | None = None) -> DataFrame:
        """The review without a library: risks by general rules over the clauses' own words, and no house position."""
        rows = review.general(target).withColumn("_override", F.lit(override).cast("string"))
        rows = review.with_mode(review.resolve_mode(rows, modes, "_override", default=own.review.default).drop("_override"), modes, own.review.default)
        return rows.withColumns({"redline": F.lit(False), "comment": F.array_contains("comment_scope", F.col("risk_level"))})

    external = staticmethod(review.external)
    report = staticmethod(review.report)
    template = staticmethod(retrieve.template_for)
    diff = staticmethod(rounds.diff)
    align = staticmethod(rounds.align)
    affected = staticmethod(rounds.affected)
    resume = staticmethod(rounds.resume_point)
