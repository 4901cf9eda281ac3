import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docmill.functions import fixed, text
from docmill.functions.rules import first_match
from docmill.operators import library, lifecycle, retrieve, review, rounds, structure
from docmill.plans.library import Library, Review
from docmill.sources import docx, inbox, keyed, policy, sinks
from docmill.streaming import intake

#: A folder of known packages (clean.md, clauses, structure, manifest); set to compare with them.
GOLDEN = os.environ.get("DOCMILL_GOLDEN")

DOC = """preamble "Preamble Term" line
제1장 총칙
(정의)
본 계약에서 "주식" 및 "주식" 과 "회사" 는 제3조 참조
(아주 긴 괄호 문장으로 시작하지만 마흔 자를 넘기 때문에 조문의 제목이 될 수 없는 줄입니다 정말로)
# 제목 "제목속" 제9조
(통지)
통지 방법
별지 1. 목록
(주주총회)
이하 의결
"""


def one(spark, body=DOC):
    return spark.createDataFrame([("d", body)], "doc_id string, text string")


def test_outline(spark):
    got = [tuple(r) for r in structure.outline(one(spark)).orderBy("line").collect()]
    assert got == [("d", 2, 1, "제1장 총칙", "ch1"), ("d", 3, 2, "정의", "art2"), ("d", 6, 1, '제목 "제목속" 제9조', None), ("d", 7, 2, "통지", "art3"), ("d", 10, 2, "주주총회", "art4")]


def test_terms_refs_exhibits(spark):
    assert [tuple(r) for r in structure.defined_terms(one(spark)).collect()] == [("d", "Preamble Term", 1), ("d", "주식", 4), ("d", "회사", 4)]
    assert [tuple(r) for r in structure.crossrefs(one(spark)).collect()] == [("d", 4, "제3조")]
    assert [tuple(r) for r in structure.exhibits(one(spark)).collect()] == [("d", 9, "별지 1")]
    curly = structure.defined_terms(one(spark, "“갑을” 및 \"병정\""), pattern=fixed.TERM_CURLY)
    assert [r.term for r in curly.collect()] == ["갑을", "병정"]


def test_clauses(spark):
    got = structure.clauses(one(spark)).collect()
    assert [(r.clause_id, r.header, r.start_line, r.end_line, r.clause_type) for r in got] == [
        ("clause-001", "제1장 총칙", 2, 2, "recitals"),
        ("clause-002", "(정의)", 3, 6, "definitions"),
        ("clause-003", "(통지)", 7, 8, "notices"),
        ("clause-004", "별지 1. 목록", 9, 9, "exhibits_schedules"),
        ("clause-005", "(주주총회)", 10, 12, "board_composition"),
    ]
    assert got[2].char_count == len("(통지)\n통지 방법")
    for body in ("", None, "no boundary\nat all"):
        assert structure.clauses(one(spark, body)).count() == 0


def test_rules_are_tried_in_order(spark):
    df = spark.createDataFrame([("b a",), ("b",), ("c",), (None,)], "x string")
    assert [r[0] for r in df.select(first_match([F.col("x")], [("one", ["a"]), ("two", ["a", "b"])], "none")).collect()] == ["one", "two", "none", "none"]


def test_text_functions(spark):
    row = spark.createDataFrame([("　 a b\t\n", "/x/[초기] 투자계약서_주주간계약서(분리형)_2309개정.docx", 0.0625, "<p>a&amp;b</p><script>x</script>c")], "a string, n string, r double, h string")
    got = row.select(text.strip(F.col("a")).alias("strip"), text.word_count(F.col("a")).alias("words"), text.line_count(F.lit("a\nb\n")).alias("lines"), library.doc_id(F.col("n")).alias("id"), text.rounded(F.col("r")).alias("r"), text.percent(F.lit(0.335)).alias("p"), text.strip_html(F.col("h")).alias("h"), text.placeholder(F.lit("pay $____")).alias("ph"), text.jaccard(F.lit("a B c"), F.lit("b c d")).alias("j"), text.word_count(F.lit(" ")).alias("none")).first()
    assert got.strip == "a b" and (got.words, got.lines, got.none) == (2, 2, 0)
    assert got.id == "early-investment-sha-separated" and got.r == round(0.0625, 3) and got.p == "33.5%"
    assert got.h == "a&b\nc" and got.ph and got.j == 0.5


def test_classification(spark):
    ids = ["1-early-sha-separated", "x-sha-separated", "0-safe-conditional-equity", "mid-convertible-bond-integrated", "late-bond-with-warrants", "late-rcps-separated", "rcps-integrated", "mid-convertible-preferred-integrated", "early-common-separated", "memo"]
    rows = library.classify(spark.createDataFrame([(i, f"{i}.docx") for i in ids], "doc_id string, source_file string")).collect()
    got = {r.doc_id: (r.contract_family, r.subtype, r.title, r.title_en, r.classification_confidence) for r in rows}
    assert got["1-early-sha-separated"] == ("sha", "investor_sha", "[초기] 주주간계약서 (분리형)", "[Early-stage] Shareholders Agreement (Separated)", "high")
    assert got["x-sha-separated"][2:4] == ("주주간계약서", "Shareholders Agreement")
    assert got["rcps-integrated"][2:4] == ("[] 투자계약서 — 상환전환우선주식 (통합형)", "[] Investment Agreement — RCPS (Integrated)")
    assert got["mid-convertible-preferred-integrated"][3] == "[Mid-stage] Investment Agreement — Convertible Preferred (통합형)"
    assert got["early-common-separated"][1] == "common_share_subscription" and got["memo"] == ("other", "general", "memo.docx", "", "low")


def manifest_row(spark, **over):
    base = {"doc_id": "a-1", "title": "t", "doc_class": "template", "contract_family": "sha", "paper_role": "neutral", "approval_state": "pending", "status": "active", "sha256": "0" * 64, "source_file": "f", "created_at": "now", "classification_confidence": "high"}
    stats = {"unmapped_ratio": 0.3, "total_clauses": 5}
    for k, v in over.items():
        (stats if k in stats else base)[k] = v
    names = ", ".join(f"{k} string" for k in base)
    return library.gate(library.validate(spark.createDataFrame([(*base.values(), tuple(stats.values()))], f"{names}, stats struct<unmapped_ratio: double, total_clauses: int>"))).first()


@pytest.mark.parametrize(
    ("over", "hard", "soft", "state"),
    [
        ({}, [], [], "approved"),
        ({"title": ""}, ["Missing required field: title"], [], "quarantined"),
        ({"title": None}, ["Missing required field: title"], [], "quarantined"),
        ({"doc_id": "A B"}, ["Invalid doc_id format: A B"], [], "quarantined"),
        ({"sha256": "xyz"}, ["Invalid sha256 format"], [], "quarantined"),
        ({"unmapped_ratio": 0.301}, [], ["Unmapped clause ratio 30.1% exceeds 30%"], "staging"),
        ({"classification_confidence": "low"}, [], ["Low classification confidence"], "staging"),
        ({"total_clauses": 4}, [], ["Only 4 clauses detected"], "staging"),
    ],
)
def test_validation_and_gate(spark, over, hard, soft, state):
    r = manifest_row(spark, **over)
    assert (r.hard_fails, r.soft_fails, r.approval_state) == (hard, soft, state)


def test_gate_toggle_and_asset_rules(spark):
    rows = spark.createDataFrame([("template", [], []), ("playbook", [], []), ("odd", [], [])], "doc_class string, hard_fails array<string>, soft_fails array<string>")
    assert {r.approval_state for r in library.gate(rows, auto=False).collect()} == {"staging"}
    assert {r.doc_class: r.approval_state for r in library.gate(rows, asset_rules=library.asset_rules(spark)).collect()} == {"template": "approved", "playbook": "staging", "odd": "staging"}


def test_ingest_end_to_end(spark):
    files = spark.createDataFrame([("/a/[초기] 주주간계약서(분리형).docx", "[초기] 주주간계약서(분리형).docx", "0" * 64, DOC), ("/a/known.docx", "known.docx", "1" * 64, DOC)], "path string, file_name string, sha256 string, md string")
    known = spark.createDataFrame([("1" * 64,)], "sha256 string")
    p = Library.ingest(files, known, "2024-01-01T00:00:00")
    assert {r.file_name[:5]: r.status for r in p.files.collect()} == {"[초기] ": "new", "known": "duplicate"}
    m = p.manifests.first()
    assert (m.doc_id, m.approval_state) == ("early-sha-separated", "approved")
    assert (m.stats.total_clauses, m.stats.unmapped_clauses, m.stats.sections, m.stats.exhibits, m.stats.defined_terms) == (5, 0, 5, 1, 3)
    index = p.indexes()
    assert [index[k].count() for k in ("documents", "clauses", "terms", "retrieval_map")] == [1, 5, 3, 1]
    assert index["documents"].first().path == "approved/templates/sha/early-sha-separated/"
    records = Library.run_records(files.select("md", F.col("md").alias("plain"), "sha256", F.lit("d").alias("doc_id"), F.col("file_name").alias("source_file")), "t")
    assert records.first().md_lines == 11


def test_twins_in_one_batch(spark):
    files = spark.createDataFrame([("b", "h"), ("a", "h")], "path string, sha256 string")
    none = files.limit(0)
    assert {r.status for r in library.flag_duplicates(files, none).collect()} == {"new"}
    assert {r.path: r.status for r in library.flag_duplicates(files, none, within=True).collect()} == {"a": "new", "b": "duplicate"}


@pytest.mark.parametrize(("n", "kept"), [(50, 50), (51, 3)])
def test_narrowing_threshold(spark, n, kept):
    rows = spark.range(n).select(F.lit("t").alias("t"), (F.col("id") < 3).alias("same"))
    assert retrieve.narrow(rows, "t", F.col("same")).count() == kept


@pytest.mark.parametrize(("n", "more"), [(2, 1), (3, 0)])
def test_affinity_threshold(spark, n, more):
    lib = spark.createDataFrame([(f"d{i}", "ssa", None) for i in range(n)] + [("o", "sha", "KR"), ("x", "nda", None)], "doc_id string, contract_family string, jurisdiction string").withColumns({"approval_state": F.lit("approved"), "status": F.lit("active")})
    target = spark.createDataFrame([("t", "ssa", None)], "t string, contract_family string, jurisdiction string")
    found = retrieve.stage_one(target, lib, optional=("jurisdiction",))
    got = retrieve.widen(found, target, lib, retrieve.affinity_pairs(spark), "t", optional=("jurisdiction",)).collect()
    assert len(got) == n + more and sum(r.penalty for r in got) == more and {r.contract_family for r in got} == {"ssa"}


def test_null_tolerance_and_exclusion(spark):
    rows = [("a", "KR", "approved", "active", None), ("b", None, "approved", "active", "c"), ("c", None, "approved", "superseded", None), ("e", "US", "approved", "active", None), ("f", "KR", "approved", "archived", None), ("g", None, "quarantined", "active", None), ("h", None, "approved", "superseded", None)]
    lib = spark.createDataFrame([(*r, "x") for r in rows], "doc_id string, jurisdiction string, approval_state string, status string, supersedes string, contract_family string")
    target = spark.createDataFrame([("t", "x", "KR")], "t string, contract_family string, jurisdiction string")
    found = retrieve.stage_one(target, lib, optional=("jurisdiction",), required={})
    assert {r.lib_doc_id for r in found.collect()} == {"a", "b", "c", "f", "g", "h"}
    assert {r.lib_doc_id for r in retrieve.exclude(found, lib).collect()} == {"a", "b", "h"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_freshness_and_external(spark):
    rows = spark.createDataFrame([("2023-01-01", True), ("2023-01-02", None), (None, False)], "d string, lib_external_safe boolean").withColumn("d", F.col("d").cast("date"))
    as_of = F.lit("2024-01-02").cast("date")
    assert [r.stale for r in retrieve.freshness(rows, "d", as_of).collect()] == [True, False, False]
    assert retrieve.freshness(rows, "d", as_of, "exclude").count() == 2 and "penalty" not in retrieve.freshness(rows, "d", as_of, "warn_only").columns
    assert retrieve.external_only(rows, True).count() == 1 and retrieve.external_only(rows, False).count() == 3


def test_review_scopes(spark):
    modes = review.modes(spark)
    rows = spark.createDataFrame([(m, r) for m in fixed.MODES for r in fixed.RISKS], "mode string, risk_level string")
    both = review.with_mode(rows, modes)
    count = lambda df: {r["mode"]: r["count"] for r in df.groupBy("mode").count().collect()}
    assert count(review.redline_scope(both)) == {"strict": 4, "moderate": 2, "loose": 1}
    assert count(review.comment_scope(both)) == {"strict": 4, "moderate": 3, "loose": 2}


def test_firewall_and_manual(spark):
    rows = spark.createDataFrame([("[INTERNAL] no", "internal"), ("yes", "external"), (None, None)], "text string, audience string")
    assert review.external(rows).count() == 2 and review.external(rows, audience="audience").count() == 2
    assert [r[0] for r in rows.select(review.or_manual(F.col("text"))).collect()][2] == "[MANUAL_REQUIRED] comment"


def test_review_run(spark):
    target = spark.createDataFrame([("c1", "notices", "sha", "the notice shall be sent by mail", "KR", None), ("c2", "taxes", "nda", "each pays its own", None, None)], "clause_id string, clause_type string, contract_family string, text string, jurisdiction string, governing_law string")
    bank = spark.createDataFrame([("d1", "k1", "taxes", "sha", "other words here", "preferred"), ("d2", "k1", "notices", "sha", "the notice shall be sent by mail", "preferred"), ("d0", "k0", "notices", "ssa", "the notice", "preferred")], "doc_id string, clause_id string, clause_type string, contract_family string, text string, authority_level string")
    bank = bank.withColumns({"doc_class": F.lit("template"), "approval_state": F.lit("approved"), "status": F.lit("active"), "supersedes": F.lit(None).cast("string"), "jurisdiction": F.lit(None).cast("string"), "governing_law": F.lit(None).cast("string"), "external_safe": F.lit(False)})
    got = {r.clause_id: r for r in Review.run(target, bank, bank, review.modes(spark), retrieve.affinity_pairs(spark)).collect()}
    assert got["c1"].lib_doc_id == "d2" and got["c1"].risk_level == "acceptable" and got["c1"].mode == "strict" and not got["c1"].redline
    assert got["c2"].library_empty and got["c2"].risk_level == "critical" and got["c2"].mode == "loose" and got["c2"].redline
    edits = review.edit_table(spark.createDataFrame([("c", "old", "new"), ("d", "same", "same")], "clause_id string, text string, suggested_redline string"))
    assert [(r.op, r.old_text, r.new_text) for r in edits.collect()] == [("del", "old", None), ("ins", None, "new")]


def test_rounds(spark):
    schema = "k string, text string"
    got = rounds.diff(spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None)], schema), spark.createDataFrame([("a", "x"), ("b", "y"), ("d", "z"), ("c", None)], schema), ["k"])
    assert {r.k: r.diff_status for r in got.collect()} == {"a": "unchanged", "b": "modified", "d": "added", "c": "unchanged"}
    assert {r.bucket: r.n for r in rounds.delta_report(got).collect()} == {"open": 2, "changed": 1, "new": 1}
    kinds = spark.createDataFrame([("a b c d e", "a"), ("a", "a b c d e"), ("a b c d", "a b c e"), ("a b c d", "w x y z")], "p string, c string")
    assert [r[0] for r in kinds.select(rounds.change_kind(F.col("p"), F.col("c"))).collect()] == ["narrowing", "broadening", "clarification", "rewrite"]


def test_supersession(spark):
    edges = [(i, i + 1) for i in range(200)] + [(900, 901), (901, 902), (902, 900), (899, 900)]
    got = {r.doc_id: r for r in lifecycle.chains(spark.createDataFrame(edges, "doc_id long, next_id long")).collect()}
    assert (got[0].latest_id, got[0].depth, got[0].cycle) == (200, 200, False) and got[199].depth == 1
    assert all(got[i].cycle and got[i].latest_id is None for i in (899, 900, 901, 902))
    rows = spark.createDataFrame([("a", "active"), ("b", "active")], "doc_id string, status string")
    out = {r.doc_id: r for r in lifecycle.supersede(rows, spark.createDataFrame([("a", "b")], "old_id string, new_id string")).collect()}
    assert (out["a"].status, out["a"].superseded_by, out["b"].supersedes) == ("superseded", "b", "a")
    assert {r.doc_id: r.status for r in Library.archive(rows, rows.where("doc_id = 'a'")).collect()} == {"a": "archived", "b": "active"}


def test_numbering_and_chunks(spark):
    rows = spark.createDataFrame([("d", 1), ("d", 2), ("d", 4)], "doc_id string, n int")
    assert [r.n for r in structure.numbering_gaps(rows, "doc_id", "n").collect()] == [4]
    assert review.inject_context(rows, spark.createDataFrame([("d", "x")], "doc_id string, terms string")).where("terms = 'x'").count() == 3


def test_docx_and_inbox(spark, tmp_path):
    body = [("Heading 1", "Title\nnext"), ("", " plain  "), ("", ""), ("제목 2", "둘"), ("Title", "T")]
    data = docx.build(body, [[["a", "b\nc"], ["1", "2"]]])
    md, plain = docx.read(data)
    assert md == "# Title\nnext\nplain\n\n## 둘\n# T\n| a | b c |\n| --- | --- |\n| 1 | 2 |\n"
    assert plain == "Title\nnext\n plain  \n\n둘\nT\na\tb\nc\n1\t2"
    (tmp_path / "in").mkdir()
    for name, content in (("A.DOCX", data), ("b.docx", b"broken"), ("c.html", b"<p>x</p>"), ("d.txt", "글".encode()), ("e.pdf", b"%PDF"), ("f.md", b""), (".gitkeep", b"")):
        (tmp_path / "in" / name).write_bytes(content)
    files = inbox.listing(spark, f"{tmp_path}/in")
    assert [(r.file_name, r.ordinal, r.of) for r in inbox.in_order(files).orderBy("ordinal").collect()] == [(n, i + 1, 5) for i, n in enumerate(["A.DOCX", "b.docx", "c.html", "d.txt", "e.pdf"])]
    assert "Exchange" not in files._jdf.queryExecution().executedPlan().toString()
    assert {r.file_name: r.skip_reason for r in inbox.supported(files).collect() if r.skip_reason} == {"e.pdf": "unsupported"}
    got = {r.file_name: r for r in inbox.normalised(files).collect()}
    assert got["A.DOCX"].md == md and got["b.docx"].error and got["c.html"].plain == "x" and got["d.txt"].plain == "글"
    assert sorted(r.file_name for r in inbox.listing(spark, f"{tmp_path}/in", only_docx=True).collect()) == ["A.DOCX", "b.docx"]
    pdf = lambda rows: rows.withColumns({"md": F.lit("read"), "plain": F.lit("read"), "error": F.lit(None).cast("string")}).drop("content")
    more = {r.file_name: r.md for r in inbox.normalised(files, {"pdf": pdf}).collect()}
    assert more["e.pdf"] == "read" and len(more) == 5


def test_policies_and_sinks(spark, tmp_path):
    (tmp_path / "contract-families.yaml").write_text('families:\n  - id: nda\n    name: N\n    aliases: ["비밀", "CDA"]\n    subtypes: [one]\n', encoding="utf-8")
    families = policy.families(spark, str(tmp_path))
    names = spark.createDataFrame([("cda",), ("비밀",), ("zz",)], "n string")
    assert [r.contract_family for r in library.resolve_alias(names, families, "n").orderBy("n").collect()] == ["nda", None, "nda"]
    assert policy.clause_types(spark, str(tmp_path)).count() == 0
    assert policy.unknown_values(names, "n", families, "id").count() == 3
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, v int")
    path = f"{tmp_path}/index"
    sinks.index(rows, path, "t1", merge_key="doc_id")
    sinks.index(rows.where("doc_id = 'b'").withColumn("v", F.lit(9)), path, "t2", merge_key="doc_id")
    assert {(r.doc_id, r.v, r.updated_at) for r in sinks.read_index(spark, path).collect()} == {("a", 1, "t1"), ("b", 9, "t2")}
    # a version whose writer did not come to its end does not count
    rows.write.parquet(f"{path}/v=3")
    os.remove(f"{path}/v=3/_SUCCESS")
    assert sinks.versions(spark, path) == [1, 2] and sinks.read_index(spark, path).count() == 2
    assert [sinks.index(rows, path, "t3", "doc_id") for _ in range(3)] == [3, 4, 5] and sinks.versions(spark, path) == [3, 4, 5]
    sinks.packages(rows.withColumn("run_ts", F.lit("r1")), f"{tmp_path}/packages")
    assert spark.read.parquet(f"{tmp_path}/packages").where(F.col("bucket") == sinks.bucket("doc_id")).count() == 2
    sinks.json_export(rows, f"{tmp_path}/json")
    assert {r.doc_id for r in spark.read.json(f"{tmp_path}/json").collect()} == {"a", "b"}
    sinks.text_export(spark.createDataFrame([("a", "x\ny")], "doc_id string, md string"), f"{tmp_path}/text")
    sinks.batch_summary(rows, f"{tmp_path}/summary", "t")
    assert spark.read.json(f"{tmp_path}/summary").count() == 2
    assert sinks.manifest_yaml({"b": 1, "a": "글"}) == "b: 1\na: 글\n"
    (tmp_path / "sum").mkdir()
    for n, s in (("1_batch-summary.json", "duplicate"), ("2_batch-summary.json", "normalized")):
        (tmp_path / "sum" / n).write_text(json.dumps({"timestamp": n, "results": [{"file": "f", "status": s}]}, indent=2))
    assert [r.status for r in inbox.latest_summary(spark, f"{tmp_path}/sum").collect()] == ["normalized"]
    assert inbox.index_or_empty(spark, "no_such_table", "sha256 string").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    schema = "doc_id long, text string"
    rows = [(i, f"t{i % 7}") for i in range(30)]
    src = f"{tmp_path}/src"
    spark.createDataFrame(rows[:15], schema).write.parquet(src)
    stream = lambda: intake.first_of_content(intake.rows(spark, src, schema), "text")
    intake.to_table(stream(), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    spark.createDataFrame(rows[15:], schema).write.mode("append").parquet(src)
    intake.to_table(stream(), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 7
    intake.to_table(intake.rows(spark, src, schema), f"{tmp_path}/each", f"{tmp_path}/state2", lambda df, i: df.withColumn("epoch", F.lit(i))).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/each").count() == 30


def review_bank(spark, *rows):
    """Bank rows: doc_id, family, status, external_safe, supersedes, refreshed."""
    bank = spark.createDataFrame([(d, f"k{d}", "notices", f, "the notice shall be sent by mail", "preferred", "template", s, e, p, r) for d, f, s, e, p, r in rows], "doc_id string, clause_id string, clause_type string, contract_family string, text string, authority_level string, doc_class string, status string, external_safe boolean, supersedes string, last_legal_refresh_date string")
    return bank.withColumns({"approval_state": F.when(F.col("status") == "quarantined", "quarantined").otherwise("approved"), "jurisdiction": F.lit(None).cast("string"), "governing_law": F.lit(None).cast("string"), "last_legal_refresh_date": F.col("last_legal_refresh_date").cast("date")})


TARGET = ("clause_id string, clause_type string, contract_family string, text string, jurisdiction string, governing_law string", [("c1", "notices", "sha", "the notice shall be sent by mail", None, None)])


@pytest.mark.parametrize(
    ("row", "external", "found"),
    [
        (("r", "ssa", "active", False, None, None), True, None),
        (("r", "ssa", "active", None, None, None), True, None),
        (("r", "ssa", "active", True, None, None), True, "r"),
        (("r", "ssa", "active", False, None, None), False, "r"),
        (("r", "ssa", "archived", True, None, None), False, None),
        (("r", "ssa", "superseded", True, None, None), False, None),
        (("r", "ssa", "quarantined", True, None, None), False, None),
    ],
)
def test_filters_hold_for_related_families(spark, row, external, found):
    """Too few candidates in the family: what related families add has to pass the same filters."""
    bank = review_bank(spark, row)
    target = spark.createDataFrame(TARGET[1], TARGET[0])
    assert [r.lib_doc_id for r in Review.run(target, bank, bank, external=external).collect()] == [found]


def test_successors_hold_for_related_families(spark):
    """Where a policy lets superseded rows through the first filter, the second drops those with an active successor."""
    rules = policy.Policies()
    rules.retrieval.required = {"approval_state": "approved"}
    target = spark.createDataFrame(TARGET[1], TARGET[0])
    for state, found in (("active", "new"), ("deprecated", "old")):
        bank = review_bank(spark, ("old", "ssa", "superseded", True, None, None), ("new", "nda", state, True, "old", None))
        got = Review.run(target, bank, bank.withColumn("doc_id", F.col("doc_id")), policies=rules).collect()
        assert [r.lib_doc_id for r in got] == [None if found == "new" else "old"]


def test_stale_rows_are_ranked_down(spark):
    bank = review_bank(spark, ("a", "sha", "active", True, None, "2020-01-01"), ("b", "sha", "active", True, None, "2024-01-01"))
    target = spark.createDataFrame(TARGET[1], TARGET[0])
    run = lambda **how: Review.run(target, bank, bank, **how).first().lib_doc_id
    day = F.lit("2024-06-01").cast("date")
    assert run() == "a" and run(as_of=day) == "b"
    for handling, want in (("warn_only", "a"), ("exclude", "b")):
        rules = policy.Policies()
        rules.retrieval.stale_handling = handling
        assert run(as_of=day, policies=rules) == want


def test_similar_text_wins_between_equal_ranks(spark):
    bank = review_bank(spark, ("a", "sha", "active", True, None, None), ("b", "sha", "active", True, None, None)).withColumn("text", F.when(F.col("doc_id") == "a", "nothing alike").otherwise(F.col("text")))
    assert Review.run(spark.createDataFrame(TARGET[1], TARGET[0]), bank, bank).first().lib_doc_id == "b"


POLICIES = {
    "review-mode": "default_mode: loose\nmodes:\n  loose:\n    redline_scope: [low]\n    acceptable_playbook_tiers: [fallback]\n    comment_generation: [low]\n    risk_tolerance: high\n    recommended_for: [sha]\nmode_triggers:\n  loose: [whatever]\noutput_language:\n  default: en\n",
    "retrieval-priority": "priority_order:\n  1: fallback_template\n  2: preferred_template\nfilter_rules:\n  stage_1:\n    - {filter: contract_family, match: exact, required: true}\n    - {filter: language, match: exact_or_null, required: false}\n    - {filter: status, match: exact, value: active, required: true}\n  stage_1_5: {trigger_threshold: 7, filter: clause_type}\n  stage_2:\n    exclude:\n      - status: archived\n    external_context: {field: may_leave}\n  stage_3_affinity:\n    affinity_groups: [[sha, nda]]\n    penalty: 4\nfreshness_rules: {stale_threshold_days: 10, stale_handling: exclude, freshness_field: seen}\n",
    "approval-rules": "auto_approval: {enabled: false}\nper_asset_type:\n  template: {auto_approvable: false, requires_human_fields: [text], default_authority_level: fallback, default_external_safe: true}\napproval_decisions: {valid_values: [approve]}\nstaging_retention: {max_days: 3, reminder_enabled: false}\n",
    "metadata-schema": "manifest_schema:\n  required_fields:\n    - {field: doc_id, type: string, pattern: '^x'}\n    - {field: owner, type: string}\n  optional_fields:\n    - {field: paper_role, type: enum, values: [house, null]}\ncomment_bank_schema:\n  required_fields:\n    - {field: audience, type: enum, values: [external]}\n",
}


def test_policy_files_change_results(spark, tmp_path):
    assert policy.Policies.load(str(tmp_path)) == policy.Policies(folder=str(tmp_path))
    for name, body in POLICIES.items():
        (tmp_path / f"{name}.yaml").write_text(body, encoding="utf-8")
    own = policy.Policies.load(str(tmp_path))
    assert (own.review.default, own.review.output_language, list(own.review.modes), own.review.words) == ("loose", "en", ["loose"], [("loose", ["whatever"])])
    r = own.retrieval
    assert (r.optional, r.required, r.narrow_above, r.excluded, r.superseded, r.external_field) == (("language",), {"status": "active"}, 7, {"status": ["archived"]}, False, "may_leave")
    assert (r.affinity, r.penalty, r.priority, r.stale_days, r.stale_handling, r.refreshed) == ([["sha", "nda"]], 4, [("fallback_template", 1), ("preferred_template", 2)], 10, "exclude", "seen")
    assert (own.approval.auto, own.approval.decisions, own.approval.staging_days, own.approval.reminder) == (False, ["approve"], 3, False)
    assert own.approval.frame(spark).first().default_external_safe
    said = spark.createDataFrame([("Whatever you like",), ("strict",)], "x string")
    assert [x[0] for x in said.select(review.mode_of_text(F.col("x"), own.mode_words)).collect()] == ["loose", None]
    rows = spark.createDataFrame([("x1", "me", "house"), ("y", "", "none")], "doc_id string, owner string, paper_role string")
    assert [x.schema_fails for x in own.schema.fails(rows).collect()] == [[], ["Missing required field: owner", "Invalid paper_role: none", "Invalid doc_id format"]]
    # a family that only the file relates, a field that only the file names, and the file's ranks
    bank = review_bank(spark, ("a", "nda", "active", True, None, None), ("b", "nda", "active", True, None, None), ("c", "ssa", "active", True, None, None))
    bank = bank.withColumns({"may_leave": F.col("doc_id") != "c", "authority_level": F.when(F.col("doc_id") == "b", "fallback").otherwise("preferred")})
    target = spark.createDataFrame(TARGET[1], TARGET[0])
    assert Review.run(target, bank, bank).first().lib_doc_id == "c"
    got = Review.run(target, bank, bank, external=True, policies=own).first()
    assert (got.lib_doc_id, got.mode, got.penalty) == ("b", "loose", 4)
    files = spark.createDataFrame([("/a/[초기] 주주간계약서(분리형).docx", "[초기] 주주간계약서(분리형).docx", "0" * 64, DOC)], "path string, file_name string, sha256 string, md string")
    none = spark.createDataFrame([], "sha256 string")
    assert Library.ingest(files, none, "t").manifests.first().approval_state == "approved"
    own.schema = policy.Schema()
    assert Library.ingest(files, none, "t", policies=own).manifests.first().approval_state == "staging"
    side = spark.createDataFrame([("early-sha-separated", "A Title")], "doc_id string, title string")
    assert Library.ingest(files, none, "t", sidecar=side).manifests.first().title == "A Title"


def test_statistics_stay_in_the_row(spark):
    docs = spark.createDataFrame([("d", DOC, 1), ("e", None, 2), ("e", "", 2)], "doc_id string, text string, n int")
    out = library.document_stats(docs)
    assert out.columns == ["doc_id", "text", "n", "stats"]
    assert sorted(tuple(r.stats) for r in out.collect()) == [(0, 0, 0.0, 0, 0, 0)] * 2 + [(5, 0, 0.0, 3, 5, 1)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_chunks_and_reports(spark):
    body = "\n".join(f"line {i}" for i in range(30))
    got = structure.chunks(one(spark, body), 50).orderBy("chunk_no").collect()
    assert "\n".join(r.body for r in got) == body and [r.chunk_no for r in got] == list(range(1, len(got) + 1)) and all(a.end_line + 1 == b.start_line for a, b in zip(got, got[1:]))
    rows = spark.createDataFrame([("d", f"c{i}", r, True, False) for i, r in enumerate(fixed.RISKS * 2)], "doc_id string, clause_id string, risk_level string, redline boolean, comment boolean")
    data = json.loads(Review.report(rows, k=3).first().report)
    assert data["clauses"] == 10 and data["n_critical"] == 2 and data["redlines"] == 10 and data["comments"] == 0 and [x["clause_id"] for x in data["key_issues"]] == ["c0", "c5", "c1"]
    assert review.merge_chunks(rows.limit(4), rows).count() == 10


def test_answers_to_proposals(spark):
    schema = "k string, text string"
    both = rounds.diff(spark.createDataFrame([("a", "old one"), ("b", "old two"), ("c", "old three"), ("d", "same")], schema), spark.createDataFrame([("a", "our words here"), ("b", "old two"), ("c", "our words but theirs"), ("d", "same")], schema), ["k"])
    both = both.withColumn("ours", F.when(F.col("k") != "d", "our words here"))
    assert {r.bucket: r.n for r in rounds.delta_report(both, proposed="ours").collect()} == {"accepted": 1, "rejected": 2, "open": 1}
    near = both.withColumn("ours", F.when(F.col("k") == "c", "our words but mine"))
    assert {r.bucket: r.n for r in rounds.delta_report(near, proposed="ours").where("bucket in ('partial', 'changed')").collect()} == {"partial": 1, "changed": 1}
    assert both.where("k = 'a'").select(rounds.edit_distance(F.lit("abc"), F.lit("abd"))).first()[0] == 1


def test_templates_waiting_headings_and_near_files(spark):
    docs = spark.createDataFrame([("t1", "sha", "x", "acceptable"), ("t2", "sha", "y", "fallback"), ("t3", "sha", "x", "preferred")], "doc_id string, contract_family string, subtype string, authority_level string").withColumns({"doc_class": F.lit("template"), "approval_state": F.lit("approved"), "status": F.lit("active")})
    asked = spark.createDataFrame([("r1", "sha", "y"), ("r2", "sha", "x"), ("r3", "nda", "x")], "request_id string, contract_family string, subtype string")
    assert {r.request_id: r.template_id for r in Review.template(asked, docs).collect()} == {"r1": "t2", "r2": "t3", "r3": None}
    rows = spark.createDataFrame([("a", "staging", "2024-01-01"), ("b", "pending", "2024-03-01"), ("c", "approved", "2024-01-01")], "doc_id string, approval_state string, at string").withColumn("at", F.col("at").cast("date"))
    assert {r.doc_id: (r.waited, r.reminder) for r in lifecycle.waiting(rows, "at", F.lit("2024-03-02").cast("date")).collect()} == {"a": (61, True), "b": (1, False)}
    page = spark.createDataFrame([("<h1>a</h1><h2>b</h2>", "# a")], "html string, md string")
    got = library.extraction_loss(page, "html", "md", headings=("<h[1-6]>", "(?m)^#{1,6} ")).first()
    assert (got.headings_before, got.headings_after, got.headings_lost) == (2, 1, True)
    words = [f"w{i}" for i in range(20)]
    texts = spark.createDataFrame([("a", "f", " ".join(words)), ("b", "f", " ".join(words[:19])), ("c", "f", " ".join(words[:10])), ("d", "g", " ".join(words)), ("e", "f", None)], "doc_id string, contract_family string, text string")
    assert sorted((r.doc_id, r.other_id, round(r.similarity, 2)) for r in library.near_duplicates(texts, texts).collect()) == [("a", "b", 0.95), ("b", "a", 0.95)]


def test_index_from_a_stream_and_audit(spark, tmp_path):
    said = []
    listener = intake.audit_listener(spark, said.append)
    src, schema = f"{tmp_path}/src", "doc_id string, v int"
    index = keyed.KeyedIndex(spark, f"{tmp_path}/index", "doc_id", schema)
    for rows in ([("a", 1), ("b", 1)], [("b", 2), ("c", 2)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        intake.refresh_index(intake.rows(spark, src, schema), index, f"{tmp_path}/state").awaitTermination()
    assert {r.doc_id: r.v for r in index.read().collect()} == {"a": 1, "b": 2, "c": 2}
    spark._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    spark.streams.removeListener(listener)
    assert {"start", "end"} <= {x["event"] for x in said}


def own_packages(folder):
    """One small package of our own, its results worked out by hand."""
    run = folder / "20240101T000000_early-sha-separated"
    for part in ("normalized", "clauses", "structure"):
        (run / part).mkdir(parents=True)
    (run / "normalized" / "clean.md").write_text(DOC, encoding="utf-8")
    rows = [("제1장 총칙", 2, 2, "recitals", 7), ("(정의)", 3, 6, "definitions", 111), ("(통지)", 7, 8, "notices", 10), ("별지 1. 목록", 9, 9, "exhibits_schedules", 8), ("(주주총회)", 10, 12, "board_composition", 12)]
    lines = DOC.split("\n")
    for i, (header, a, b, kind, _) in enumerate(rows, 1):
        size = len("\n".join(lines[a - 1 : b]).strip())
        record = {"clause_id": f"clause-{i:03d}", "header": header, "start_line": a, "end_line": b, "clause_type": kind, "char_count": size}
        (run / "clauses" / f"clause-{i:03d}.json").write_text(json.dumps(record), encoding="utf-8")
    (run / "structure" / "exhibits.json").write_text(json.dumps([{"line": 9, "label": "별지 1"}]), encoding="utf-8")
    manifest = {"doc_id": "early-sha-separated", "title": "[초기] 주주간계약서 (분리형)", "contract_family": "sha", "subtype": "investor_sha", "approval_state": "approved", "source_file": "[초기] 주주간계약서(분리형).docx", "sha256": "0" * 64, "stats": {"total_clauses": 5, "unmapped_clauses": 0, "unmapped_ratio": 0.0, "defined_terms": 3, "sections": 5, "exhibits": 1}}
    (run / "manifest.yaml").write_text(json.dumps(manifest), encoding="utf-8")
    return folder


def test_known_packages(spark, tmp_path):
    """Packages of DOCMILL_GOLDEN, or one of our own."""
    yaml = pytest.importorskip("yaml")
    folder = Path(GOLDEN) if GOLDEN else own_packages(tmp_path)
    docs, clauses, manifests, exhibits = [], {}, {}, {}
    for run in sorted(folder.iterdir()):
        name = run.name.split("_", 1)[1]
        docs.append((name, (run / "normalized" / "clean.md").read_text(encoding="utf-8")))
        manifests[name] = yaml.safe_load((run / "manifest.yaml").read_text(encoding="utf-8"))
        for f in (run / "clauses").glob("*.json"):
            c = json.loads(f.read_text(encoding="utf-8"))
            clauses[name, c["clause_id"]] = c
        if (run / "structure" / "exhibits.json").exists():
            exhibits[name] = json.loads((run / "structure" / "exhibits.json").read_text(encoding="utf-8"))
    df = spark.createDataFrame([(*d, manifests[d[0]]["source_file"], manifests[d[0]]["sha256"]) for d in docs], "doc_id string, text string, source_file string, sha256 string")
    got = {(r.doc_id, r.clause_id): r for r in structure.clauses(df).collect()}
    for key, c in clauses.items():
        assert {k: got[key][k] for k in c} == c
    found = {}
    for r in structure.exhibits(df).collect():
        found.setdefault(r.doc_id, []).append({"line": r.line, "label": r.label})
    assert all(sorted(found.get(n, []), key=lambda x: x["line"]) == e for n, e in exhibits.items())
    rows = library.gate(library.validate(library.manifest(library.document_stats(library.classify(df)), "t"))).collect()
    for r in rows:
        want = manifests[r.doc_id]
        assert r.stats.asDict() == want["stats"]
        assert {k: v for k, v in r.asDict().items() if k in want and k not in ("stats", "created_at", "updated_at")} == {k: v for k, v in want.items() if k not in ("stats", "created_at", "updated_at")}
    ids = spark.createDataFrame([(m["source_file"], n) for n, m in manifests.items()], "f string, want string").select(library.doc_id(F.col("f")).alias("got"), "want")
    assert [r.got for r in ids.collect()] == [r.want for r in ids.collect()]
    assert len(rows) == len(docs)


def test_paragraph_contains(spark):
    from docmill.operators import review

    docs = [(1, "so ONE two\n three  four five six it is"), (2, "one two three four five seven"), (None, "x alpha beta gamma y"), (3, "analphabeta"), (4, "preone two three four five sixty"), (5, None), (5, "")]
    items = [(10, "one two three four five six"), (11, "alpha beta gamma"), (12, "alpha"), (13, " "), (14, None), (15, "two\tthree")]
    got = review.paragraph_contains(spark.createDataFrame(docs, "id int, body string"), spark.createDataFrame(items, "paragraph_id int, text string"), "id")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, 10), (1, 15), (2, 15), (4, 10), (4, 15), (None, 11), (None, 12), (3, 12)], key=repr)


def test_template_lookup_makes_no_pairs(spark):
    docs = spark.createDataFrame([(i, "f", ("a", "b", None)[i % 3], "template", ("fallback", "preferred")[i % 2], "approved", "active") for i in range(60)], "doc_id long, contract_family string, subtype string, doc_class string, authority_level string, approval_state string, status string")
    asked = spark.createDataFrame([(1, "f", "a"), (2, "f", "b"), (3, "f", None), (4, "f", "z"), (5, "g", "a"), (6, None, "a"), (7, "f", "z"), (7, "f", "b")], "request_id long, contract_family string, subtype string")
    found = retrieve.template_for(asked, docs)
    # of the two rows of request 7 the one whose subtype is there decides
    assert sorted((r.request_id, r.subtype or "", r.template_id) for r in found.collect()) == [(1, "a", 3), (2, "b", 1), (3, "", 1), (4, "z", 1), (5, "a", None), (6, "a", None), (7, "b", 1), (7, "z", 1)]
    # the requests never meet all templates of their family to be sorted
    assert "Window" not in found._jdf.queryExecution().toString()


def test_review_finds_what_all_pairs_find(spark):
    from random import Random

    from docmill.functions.text import jaccard

    r = Random(5)
    said = lambda: " ".join(r.choice("fee term party law due pay act sum").strip() for _ in range(r.randint(0, 5)))
    families, kinds, places = ["safe", "rcps", "common"], ["a", "b"], ["KR", "US", None]
    held = [(i, f"c{i % 2}", r.choice(families), r.choice(kinds), r.choice(places), r.choice(["preferred", "acceptable"]), said()) for i in range(120)]
    bank = spark.createDataFrame(held, "doc_id long, clause_id string, contract_family string, clause_type string, jurisdiction string, authority_level string, text string").withColumns({"doc_class": F.lit("template"), "approval_state": F.lit("approved"), "status": F.lit("active"), "stale_penalty": F.col("doc_id") % 2})
    wanted = [(i, r.choice([*families, "none"]), r.choice(kinds), r.choice(places), None if i == 3 else said()) for i in range(60)]
    targets = spark.createDataFrame(wanted, "id long, contract_family string, clause_type string, jurisdiction string, text string")
    near = retrieve.affinity_pairs(spark, [["safe", "none"], ["rcps", "common"]])
    rank = retrieve.rank_of(retrieve.priority(F.col("lib_doc_class"), F.col("lib_authority_level"), F.col("lib_approval_state"))) + F.col("lib_stale_penalty")
    order = [rank + F.col("penalty"), F.desc(F.col("clause_type") == F.col("lib_clause_type")), F.desc(jaccard(F.col("text"), F.col("lib_text"))), F.col("lib_doc_id")]
    answer = lambda rows: {x.id: (x.lib_doc_id, x.penalty) for x in retrieve.best(rows, "id", order).collect()}
    for above, below in ((10, 5), (1000, 30)):
        found = retrieve.candidates(targets, bank, "id", above=above, optional=("jurisdiction",))
        want = answer(retrieve.widen(found, targets, bank, near, "id", below=below, penalty=1, optional=("jurisdiction",)))
        assert answer(retrieve.likeliest(targets, bank, near, "id", rank, above=above, below=below, penalty=1, optional=("jurisdiction",))) == want and len(want) > 40


def test_large_families_are_joined_in_blocks(spark):
    lib = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("f").alias("contract_family"), F.lit("approved").alias("approval_state"), F.lit("active").alias("status"))
    targets = spark.range(200).select("id", F.lit("f").alias("contract_family")).union(spark.createDataFrame([(900, "g"), (901, None)], "id long, contract_family string"))
    got = retrieve.stage_one(targets, lib, optional=(), block=32)
    assert got.columns == [*targets.columns, *(f"lib_{c}" for c in lib.columns)]
    assert sorted((r.id, r.lib_doc_id) for r in got.collect()) == [(i, j) for i in range(200) for j in range(300)]


def test_nearest_are_those_of_all_pairs(spark):
    from random import Random

    r = Random(3)
    size = lambda: r.choice([None, *range(0, 60, 3)])
    lib = spark.createDataFrame([(i, r.choice("fg"), r.choice(["a", "b", None]), r.choice(["KR", "US", None]), size(), "approved", "active") for i in range(80)], "doc_id long, contract_family string, clause_type string, jurisdiction string, n long, approval_state string, status string")
    targets = spark.createDataFrame([(i, r.choice("fgh"), r.choice(["a", "b", None]), r.choice(["KR", "US", "JP", None]), size()) for i in range(120)], "id long, contract_family string, clause_type string, jurisdiction string, n long")
    same, off = F.when(F.col("clause_type") == F.col("lib_clause_type"), 0).otherwise(1), F.abs(F.col("n") - F.col("lib_n"))
    for gap in (off.asc_nulls_first(), off.asc_nulls_last()):
        answer = lambda rows: sorted((x.id, x.lib_doc_id) for x in retrieve.best(rows, "id", [same, gap, F.col("lib_doc_id")]).collect())  # noqa: B023, E731
        want = answer(retrieve.stage_one(targets, lib, optional=("jurisdiction",)))
        assert answer(retrieve.nearest(targets, lib, "id", "n", optional=("jurisdiction",))) == want and len(want) > 60


def test_docx_files_are_read_a_few_at_a_time():
    import pyarrow as pa

    files = [docx.build([("", "x" * n)]) for n in (10, 500, 20, 30, 40)] + [b"broken", None]
    kind = pa.schema([("id", pa.int64()), ("md", pa.string()), ("plain", pa.string()), ("error", pa.string())])
    batch = pa.RecordBatch.from_arrays([pa.array(range(7), pa.int64()), pa.array(files, pa.binary())], names=["id", "content"])
    parts = list(docx.read_batch(batch, "content", ["id"], kind, rows=3, letters=600))
    assert [p.column("id").to_pylist() for p in parts] == [[0, 1], [2, 3, 4], [5, 6]]
    assert [len(x or "") for p in parts for x in p.column("plain").to_pylist()] == [10, 500, 20, 30, 40, 0, 0]
    assert [x is None for p in parts for x in p.column("error").to_pylist()] == [True] * 5 + [False] * 2
