"""Policies from YAML files; the folder is a parameter.  What a file lacks, and a missing file, has the fixed values."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from docmill.functions import fixed

FAMILIES = "id string, name string, aliases array<string>, subtypes array<string>"
CLAUSE_TYPES = "category string, clause_type string, name string"
MODES = "mode string, redline_scope array<string>, acceptable_tiers array<string>, comment_scope array<string>, risk_tolerance string, recommended_for array<string>"
ASSET_RULES = "asset_type string, auto_approvable boolean, requires_human_fields array<string>, default_authority_level string, default_external_safe boolean"


def load(folder: str, name: str) -> dict:
    """One policy file; policies are edited by people and a few kilobytes long, so the driver reads them."""
    import yaml

    path = os.path.join(folder, f"{name}.yaml")
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def families(spark: SparkSession, folder: str) -> DataFrame:
    rows = [(f["id"], f.get("name"), f.get("aliases") or [], f.get("subtypes") or []) for f in load(folder, "contract-families").get("families", [])]
    return spark.createDataFrame(rows, FAMILIES)


def clause_types(spark: SparkSession, folder: str) -> DataFrame:
    rows = [(c["id"], t["id"], t.get("name")) for c in load(folder, "clause-taxonomy").get("categories", []) for t in c.get("clause_types", [])]
    return spark.createDataFrame(rows, CLAUSE_TYPES)


@dataclass
class ReviewModes:
    """Scopes, tiers and words of the review modes."""

    modes: dict[str, dict] = field(default_factory=lambda: dict(fixed.MODES))
    default: str = fixed.DEFAULT_MODE
    words: list[tuple[str, list[str]]] = field(default_factory=lambda: list(fixed.MODE_WORDS))
    output_language: str | None = None

    @classmethod
    def load(cls, folder: str) -> ReviewModes:
        data, own = load(folder, "review-mode"), cls()
        if data.get("modes"):
            own.modes = {
                name: {"redline": m.get("redline_scope") or [], "tiers": m.get("acceptable_playbook_tiers") or [], "comments": m.get("comment_generation") or [], "tolerance": m.get("risk_tolerance"), "families": m.get("recommended_for") or []}
                for name, m in data["modes"].items()
            }
        own.default = data.get("default_mode", own.default)
        if data.get("mode_triggers"):
            own.words = [(name, [str(w).lower() for w in words]) for name, words in data["mode_triggers"].items()]
        # match_input means that there is no language of its own
        said = (data.get("output_language") or {}).get("default")
        own.output_language = None if said in (None, "match_input") else said
        return own

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(m, v["redline"], v["tiers"], v["comments"], v["tolerance"], v["families"]) for m, v in self.modes.items()], MODES)


@dataclass
class Retrieval:
    """Filters, thresholds, affinity groups, ranks and freshness of retrieval."""

    family: str = "contract_family"
    optional: tuple[str, ...] = ("jurisdiction", "governing_law")
    required: dict[str, str] = field(default_factory=lambda: {"approval_state": "approved", "status": "active"})
    narrow_above: int = fixed.NARROW_ABOVE
    narrow_by: str = "clause_type"
    excluded: dict[str, list[str]] = field(default_factory=lambda: {"status": ["archived"], "approval_state": ["quarantined"]})
    superseded: bool = True
    external_field: str = "external_safe"
    widen_below: int = fixed.WIDEN_BELOW
    penalty: int = fixed.PENALTY
    affinity: list[list[str]] = field(default_factory=lambda: list(fixed.AFFINITY))
    priority: list[tuple[str, int]] = field(default_factory=lambda: list(fixed.PRIORITY))
    stale_days: int = fixed.STALE_DAYS
    stale_handling: str = "downrank"
    refreshed: str = "last_legal_refresh_date"

    @classmethod
    def load(cls, folder: str) -> Retrieval:
        data, own = load(folder, "retrieval-priority"), cls()
        rules = data.get("filter_rules") or {}
        if first := rules.get("stage_1"):
            own.family = next((r["filter"] for r in first if r.get("required") and "value" not in r), own.family)
            own.optional = tuple(r["filter"] for r in first if r.get("match") == "exact_or_null")
            own.required = {r["filter"]: r["value"] for r in first if r.get("required") and "value" in r}
        narrow = rules.get("stage_1_5") or {}
        own.narrow_above, own.narrow_by = narrow.get("trigger_threshold", own.narrow_above), narrow.get("filter", own.narrow_by)
        if second := rules.get("stage_2"):
            own.excluded, own.superseded = {}, False
            for rule in second.get("exclude") or []:
                if rule.get("condition") == "active_successor_exists":
                    own.superseded = True
                    continue
                for column, value in rule.items():
                    own.excluded.setdefault(column, []).append(value)
            own.external_field = (second.get("external_context") or {}).get("field", own.external_field)
        if third := rules.get("stage_3_affinity"):
            own.affinity, own.penalty = third.get("affinity_groups") or [], third.get("penalty", own.penalty)
            own.widen_below = third.get("below", own.widen_below)
        if data.get("priority_order"):
            own.priority = [(name, int(rank)) for rank, name in data["priority_order"].items()]
        fresh = data.get("freshness_rules") or {}
        own.stale_days, own.stale_handling, own.refreshed = fresh.get("stale_threshold_days", own.stale_days), fresh.get("stale_handling", own.stale_handling), fresh.get("freshness_field", own.refreshed)
        return own


@dataclass
class Approval:
    """When rows are approved without people, what decisions there are, and how long rows may wait."""

    auto: bool = True
    assets: list[tuple] = field(default_factory=lambda: list(fixed.ASSET_RULES))
    decisions: list[str] = field(default_factory=lambda: list(fixed.DECISIONS))
    staging_days: int = fixed.STAGING_DAYS
    reminder: bool = True

    @classmethod
    def load(cls, folder: str) -> Approval:
        data, own = load(folder, "approval-rules"), cls()
        own.auto = (data.get("auto_approval") or {}).get("enabled", own.auto)
        if data.get("per_asset_type"):
            own.assets = [(name, r.get("auto_approvable", False), r.get("requires_human_fields") or [], r.get("default_authority_level"), r.get("default_external_safe", False)) for name, r in data["per_asset_type"].items()]
        own.decisions = (data.get("approval_decisions") or {}).get("valid_values", own.decisions)
        retention = data.get("staging_retention") or {}
        own.staging_days, own.reminder = retention.get("max_days", own.staging_days), retention.get("reminder_enabled", own.reminder)
        return own

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.assets, ASSET_RULES)


@dataclass
class Schema:
    """Required fields, allowed values and formats of a manifest, a playbook and a comment bank."""

    required: dict[str, list[str]] = field(default_factory=lambda: {"manifest": list(fixed.REQUIRED), "playbook": [], "comment_bank": []})
    allowed: dict[str, dict[str, list[str]]] = field(default_factory=lambda: {"manifest": dict(fixed.ALLOWED), "playbook": {}, "comment_bank": {}})
    patterns: dict[str, dict[str, str]] = field(default_factory=lambda: {"manifest": {}, "playbook": {}, "comment_bank": {}})

    @classmethod
    def load(cls, folder: str) -> Schema:
        data, own = load(folder, "metadata-schema"), cls()
        for kind in own.required:
            if not (part := data.get(f"{kind}_schema")):
                continue
            fields = (part.get("required_fields") or []) + (part.get("optional_fields") or [])
            own.required[kind] = [f["field"] for f in part.get("required_fields") or []]
            own.allowed[kind] = {f["field"]: [v for v in f["values"] if v is not None] for f in fields if f.get("values")}
            own.patterns[kind] = {f["field"]: f["pattern"] for f in fields if f.get("pattern")}
        return own

    def fails(self, rows: DataFrame, kind: str = "manifest") -> DataFrame:
        """``rows`` with ``schema_fails``: missing fields, values that are not allowed, wrong formats."""
        from pyspark.sql import functions as F

        there = lambda c: F.col(c) if c in rows.columns else F.lit(None)
        empty = lambda c: there(c).isNull() | (there(c).cast("string") == "")
        out = [F.when(empty(c), F.lit(f"Missing required field: {c}")) for c in self.required[kind]]
        out += [F.when(~empty(c) & ~there(c).cast("string").isin([str(x) for x in v]), F.concat(F.lit(f"Invalid {c}: "), there(c).cast("string"))) for c, v in self.allowed[kind].items() if c in rows.columns]
        out += [F.when(~empty(c) & ~there(c).rlike(v), F.lit(f"Invalid {c} format")) for c, v in self.patterns[kind].items() if c in rows.columns]
        return rows.withColumn("schema_fails", F.array_compact(F.array(*out)) if out else F.array().cast("array<string>"))


@dataclass
class Policies:
    """All that people may edit, read once from a folder."""

    review: ReviewModes = field(default_factory=ReviewModes)
    retrieval: Retrieval = field(default_factory=Retrieval)
    approval: Approval = field(default_factory=Approval)
    schema: Schema = field(default_factory=Schema)
    folder: str | None = None

    @classmethod
    def load(cls, folder: str) -> Policies:
        return cls(ReviewModes.load(folder), Retrieval.load(folder), Approval.load(folder), Schema.load(folder), folder)

    @cached_property
    def mode_words(self) -> list[tuple[str, list[str]]]:
        return self.review.words


def unknown_values(rows: DataFrame, column: str, allowed: DataFrame, value: str) -> DataFrame:
    """Rows whose value is in no policy table."""
    from pyspark.sql import functions as F

    return rows.join(F.broadcast(allowed.select(F.col(value).alias("_v")).distinct()), F.col(column) == F.col("_v"), "left_anti")
