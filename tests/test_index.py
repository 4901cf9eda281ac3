"""The keyed index, streams that rest on it, waits, and operators on a document's own structure."""

import glob
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docmill.operators import joins, review, rounds, structure
from docmill.plans.library import Review
from docmill.sources import keyed
from docmill.streaming import intake, waits

SCHEMA = "k string, v int"


def rows_of(index):
    return {r.k: r.v for r in index.read().collect()}


def frame(spark, pairs):
    return spark.createDataFrame(pairs, SCHEMA)


def size(path):
    return sum(os.path.getsize(f) for f in glob.glob(f"{path}/**/*.parquet", recursive=True))


def test_upserts_write_their_own_rows(spark, tmp_path):
    index = keyed.KeyedIndex(spark, f"{tmp_path}/i", "k", SCHEMA, buckets=8)
    assert rows_of(index) == {} and index.known(frame(spark, [("a", 1)])).count() == 0
    index.upsert(spark.range(20000).select(F.col("id").cast("string").alias("k"), F.col("id").cast("int").alias("v")))
    first = size(f"{tmp_path}/i")
    index.upsert(frame(spark, [("5", -1), ("5", -2), ("new", 7), (None, 3)]), order="v")
    assert size(f"{tmp_path}/i") - first < first / 20
    got = rows_of(index)
    assert len(got) == 20001 and got["5"] == -1 and got["new"] == 7 and got["6"] == 6
    assert sorted((r.k, r.v) for r in index.known(frame(spark, [("5", 0), ("new", 0), ("none", 0)])).collect()) == [("5", -1), ("new", 7)]
    assert [r.k for r in index.unknown(frame(spark, [("5", 0), ("none", 0)])).collect()] == ["none"]
    many = spark.range(19990, 22000).select(F.col("id").cast("string").alias("k"), F.lit(0).alias("v"))
    assert index.unknown(many).count() == 2000


def test_a_batch_counts_once_and_folders_are_merged(spark, tmp_path):
    index = keyed.KeyedIndex(spark, f"{tmp_path}/i", "k", SCHEMA, buckets=4)
    for n in range(3):
        index.upsert(frame(spark, [("a", n), (f"k{n}", n)]), once=f"b{n}")
    index.upsert(frame(spark, [("a", 99)]), once="b1")
    assert rows_of(index) == {"a": 2, "k0": 0, "k1": 1, "k2": 2}
    state = index.compact()
    assert len(state.folders) == 1 and rows_of(index) == {"a": 2, "k0": 0, "k1": 1, "k2": 2}
    index.upsert(frame(spark, [("a", 5)]))
    assert rows_of(index)["a"] == 5
    there = lambda: {os.path.basename(d) for d in glob.glob(f"{tmp_path}/i/d=*")}
    assert there() == {*index.state().folders, *index.state().old}
    index.compact()
    assert there() == {*index.state().folders, *index.state().old} and len(there()) == 3 and rows_of(index)["a"] == 5


def test_two_writers(spark, tmp_path, monkeypatch):
    """Another writer takes the version between a writer's reading and writing of the log: both batches count."""
    one, two = (keyed.KeyedIndex(spark, f"{tmp_path}/i", "k", SCHEMA, buckets=4) for _ in range(2))
    commit, done = one._commit, []

    def late(state):
        if not done:
            done.append(True)
            two.upsert(frame(spark, [("b", 2), ("x", 2)]))
        commit(state)

    monkeypatch.setattr(one, "_commit", late)
    one.upsert(frame(spark, [("a", 1), ("x", 1)]))
    assert rows_of(two) == {"a": 1, "b": 2, "x": 1} and one.state().version == 2
    with pytest.raises(keyed.Taken):
        commit(keyed.State(version=2))


def test_a_damaged_index_comes_back(spark, tmp_path):
    index = keyed.KeyedIndex(spark, f"{tmp_path}/i", "k", SCHEMA, buckets=8)
    stored = spark.range(500).select(F.col("id").cast("string").alias("k"), F.col("id").cast("int").alias("v"))
    index.upsert(stored)
    assert index.repair(stored) == []
    files = sorted(glob.glob(f"{tmp_path}/i/d=*/_bucket=*/*.parquet"))
    os.remove(files[0])
    with open(files[1], "wb") as f:
        f.write(b"not parquet")
    os.remove(os.path.join(os.path.dirname(files[1]), "." + os.path.basename(files[1]) + ".crc"))
    index.upsert(frame(spark, [("7", -7), ("too many", 1)]))
    want = {str(i): i for i in range(500)}
    wrong = index.repair(stored)
    assert 3 <= len(wrong) <= 4 and rows_of(index) == want
    assert index.repair(stored) == []
    index.upsert(frame(spark, [("8", 0)]))
    assert rows_of(index) == want | {"8": 0}


def test_contents_across_runs(spark, tmp_path):
    index = keyed.KeyedIndex(spark, f"{tmp_path}/i", "k", SCHEMA, buckets=4)
    src, seen = f"{tmp_path}/src", []
    for n, pairs in enumerate(([("a", 1), ("b", 2), ("a", 0)], [("b", 3), ("c", 4)], [("c", 5)])):
        frame(spark, pairs).coalesce(1).write.mode("append").parquet(src)
        stream = intake.rows(spark, src, SCHEMA)
        # a run of its own each time, with no state but the index
        intake.new_contents(stream, index, f"{tmp_path}/out{n}", f"{tmp_path}/state{n}", "k", "v", name=f"run{n}").awaitTermination()
        seen.append(sorted((r.k, r.v) for r in spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out{n}").collect()))
    assert seen == [[("a", 0), ("b", 2)], [("c", 4)], []]


def test_waits_as_a_stream_and_in_one_pass(spark, tmp_path):
    start = datetime(2024, 1, 1)
    day = lambda n: start + timedelta(days=n)
    batches = [
        [("a", "staged", day(0)), ("b", "staged", day(1)), ("c", "decided", day(1)), ("c", "viewed", day(1)), (None, "staged", day(1))],
        [("a", "staged", day(20)), ("b", "decided", day(25)), ("d", "staged", day(28)), ("e", "staged", None)],
        [("c", "staged", day(35)), ("b", "staged", day(40))],
        [("a", "decided", day(50)), ("c", "decided", day(66)), ("a", "staged", day(60))],
        [("f", "staged", day(99))],
    ]
    schema = "asset string, event string, at timestamp"
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, waits.STORE)
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/src")
            stream = intake.rows(spark, f"{tmp_path}/src", schema)
            intake.to_table(waits.waits(stream), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    finally:
        spark.conf.set(store, before)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    every = spark.createDataFrame([r for b in batches for r in b], schema)
    want = sorted(tuple(r) for r in waits.waits_of(every, F.lit(day(99)).cast("timestamp")).collect())
    assert got == want
    assert ("a", day(0), "reminder", day(30), False) in got and ("a", day(0), "decided", day(50), True) in got and ("b", day(1), "decided", day(25), False) in got
    assert ("d", day(28), "reminder", day(58), False) in got and ("c", day(35), "decided", day(66), True) in got and not [r for r in got if r[0] in ("e", "f")]


def test_numbering(spark):
    text = "제1장 총칙\n제1조 (목적)\n① 하나\n② 둘\n1. item\n2. item\n4. gap\n③ 셋\n1. again\n제2조 (정의)\n② begins late\n제2조 same\n제1장 repeat\nArticle 7 odd\n(a) x\n(b) y\n(a) restart\nplain\n제5장 far"
    got = structure.numbering(spark.createDataFrame([("d", text), ("e", None), ("f", "no list")], "doc_id string, text string")).orderBy("line").collect()
    assert [(r.line, r.kind) for r in got if r.kind not in ("first", "next")] == [(7, "gap"), (11, "gap"), (12, "repeat"), (13, "repeat"), (14, "gap"), (17, "restart"), (19, "gap")]
    assert [(r.level, r.number) for r in got][:6] == [(1, 1), (2, 1), (3, 1), (3, 2), (4, 1), (4, 2)]
    fails = structure.numbering_fails(spark.createDataFrame([("d", text)], "doc_id string, text string")).collect()
    assert [(r.doc_id, r.gaps) for r in fails] == [("d", 6)]


def test_reference_graph(spark):
    korean = "제1조 (목적) 제3조 참조\n제2조 (정의) 제1조 내지 제3조\n제3조 (통지) 제1조와 제9조\n제4조 (끝) 없음"
    titled = "(정의)\n제2조 및 제5조\n(통지)\nx"
    english = "preamble of Section 2\n# Section 1 Fees\nas Sections 1.2 to 2 say\nSection 1.2 More\nSection 1.10 Last, see Article 2\nArticle 2 Term\nsee Sections 7 through 9"
    df = spark.createDataFrame([("k", korean), ("t", titled), ("e", english), ("n", None), ("z", "제1조 (alone)")], "doc_id string, text string")
    got = {(r.doc_id, r.from_line, r.to_label): (r.from_label, r.to_line, r.resolved, r.cyclic) for r in structure.reference_graph(df).collect()}
    assert got == {
        ("k", 1, "3"): ("1", 3, True, True), ("k", 2, "1"): ("2", 1, True, False), ("k", 2, "2"): ("2", 2, True, True), ("k", 2, "3"): ("2", 3, True, False), ("k", 3, "1"): ("3", 1, True, True), ("k", 3, "9"): ("3", None, False, False),
        ("t", 2, "2"): ("1", 3, True, False), ("t", 2, "5"): ("1", None, False, False),
        ("e", 1, "2"): (None, 6, True, False), ("e", 3, "1.2"): ("1", 4, True, False), ("e", 3, "1.10"): ("1", 5, True, False), ("e", 3, "2"): ("1", 6, True, False), ("e", 5, "2"): ("1.10", 6, True, False), ("e", 7, "7"): ("2", None, False, False), ("e", 7, "9"): ("2", None, False, False),
    }


def test_affected_clauses(spark):
    edges = spark.createDataFrame([("d", "a", "b"), ("d", "b", "c"), ("d", "c", "a"), ("d", "x", "b"), ("d", "y", "x"), ("e", "a", "b"), ("d", "q", "z")], "doc_id string, from_id string, to_id string")
    changed = spark.createDataFrame([("d", "b"), ("d", "b"), ("e", "z")], "doc_id string, clause_id string")
    got = {(r.doc_id, r.clause_id): r.depth for r in rounds.affected(changed, edges).collect()}
    assert got == {("d", "b"): 0, ("d", "a"): 1, ("d", "x"): 1, ("d", "c"): 2, ("d", "y"): 2, ("e", "z"): 0}
    clauses = spark.createDataFrame([("d", "c1", 1, 2, 'the "Fee" is 5'), ("d", "c2", 3, 4, "pay the Fee"), ("d", "c3", 5, 6, "nothing")], "doc_id string, clause_id string, start_line int, end_line int, body string")
    terms = spark.createDataFrame([("d", "Fee", 1), ("d", "Other", 5)], "doc_id string, term string, first_line int")
    assert [tuple(r) for r in structure.term_edges(clauses, terms).collect()] == [("d", "c2", "c1")]


def test_reference_graph_of_a_long_document(spark):
    # labels are looked up by halving; numbers of any length have an order
    far = "9" * 25
    text = "\n".join([*(f"Section {i}. as Section {i % 3000 + 1} says" for i in range(1, 3001)), f"Section {far}. see Sections 2999 to {far}, Sections 5 to 3"])
    rows = structure.reference_graph(spark.createDataFrame([("d", text)], "doc_id string, text string")).collect()
    got = {(r.from_line, r.to_label): (r.from_label, r.to_line, r.cyclic) for r in rows}
    want = {(i, str(i % 3000 + 1)): (str(i), i % 3000 + 1, True) for i in range(1, 3001)}
    # a range that runs backwards has nothing in it
    assert got == want | {(3001, "2999"): (far, 2999, False), (3001, "3000"): (far, 3000, False), (3001, far): (far, 3001, True), (3001, "5"): (far, None, False), (3001, "3"): (far, None, False)} and len(rows) == len(got)


def test_affected_clauses_over_long_ways(spark):
    chain = [("d", i + 1, i) for i in range(60)] + [("d", 0, 60), ("e", 5, 4), (None, 2, 1), ("e", 9, None), ("e", None, 4)]
    edges = spark.createDataFrame(chain, "doc_id string, from_id int, to_id int")
    changed = spark.createDataFrame([("d", 0), ("e", 4), ("f", 7), (None, 1)], "doc_id string, clause_id int")
    want = sorted([("d", i, i) for i in range(61)] + [("e", 4, 0), ("e", 5, 1), ("e", None, 1), ("f", 7, 0), (None, 1, 0)], key=repr)
    context = spark.sparkContext
    for most in (2, 10_000):
        context.setJobGroup(f"affected-{most}", "")
        assert sorted((tuple(r) for r in rounds.affected(changed, edges, most=most).collect()), key=repr) == want
    # the number of jobs does not grow with the length of a way
    assert len(context.statusTracker().getJobIdsForGroup("affected-10000")) < 15 < len(context.statusTracker().getJobIdsForGroup("affected-2"))
    context.setLocalProperty("spark.jobGroup.id", None)


def test_section_chunks(spark):
    text = "\n".join(["intro", "(one)", "x" * 10, "(two)", "y" * 40, "z" * 40, "w" * 90, "v", "(three)", "u", "(four)", "t"])
    got = structure.section_chunks(spark.createDataFrame([("d", text), ("e", None)], "doc_id string, text string"), 60).orderBy("doc_id", "chunk_no").collect()
    assert [(r.start_line, r.end_line, r.part, r.sections) for r in got if r.doc_id == "d"] == [(1, 3, None, ["(one)"]), (4, 5, 1, ["(two)"]), (6, 6, 2, ["(two)"]), (7, 7, 3, ["(two)"]), (8, 8, 4, ["(two)"]), (9, 12, None, ["(three)", "(four)"])]
    assert "\n".join(r.body for r in got if r.doc_id == "d") == text


def test_ordinals_and_overlaps(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x"), F.lit("s").alias("s")).repartition(7)
    got = joins.with_ordinals(rows, "s", "x").collect()
    assert sorted((r.x, r.ordinal, r.of) for r in got) == [(i, i + 1, 1000) for i in range(1000)]
    assert joins.with_ordinals(rows.limit(0), "x").collect() == []
    a = [("k", 1.0, 4.0), ("k", 5.0, 5.0), ("k", 0.0, 100.0), ("m", 1.0, 2.0), ("k", None, 3.0)]
    b = [("k", 3.5, 9.0), ("k", 4.0, 5.0), ("k", 99.5, 200.0), ("n", 1.0, 2.0)]
    left, right = spark.createDataFrame(a, "k string, s double, e double"), spark.createDataFrame(b, "j string, t double, f double")
    want = sorted((x, y) for x in a for y in b if x[0] == y[0] and x[1] is not None and x[1] < x[2] and max(x[1], y[1]) < min(x[2], y[2]))
    for width in (1, 7, 1000):
        assert sorted((tuple(r)[:3], tuple(r)[3:]) for r in joins.overlapping(left, right, ("k", "j"), ("s", "e", "t", "f"), width).collect()) == want


def test_unknown_mode_loses_no_row(spark):
    modes = review.modes(spark)
    rows = spark.createDataFrame([("a", "strict"), ("b", "lenient"), ("c", None)], "id string, mode string")
    got = {r.id: (r.mode, r.risk_tolerance) for r in review.with_mode(rows, modes).collect()}
    strict, default = (modes.where(F.col("mode") == m).first().risk_tolerance for m in ("strict", "moderate"))
    assert got == {"a": ("strict", strict), "b": ("lenient", default), "c": (None, default)}
    with pytest.raises(ValueError, match="no mode is called lenient"):
        Review.run(rows, rows, rows, override="lenient")


def test_an_empty_library_means_general_review(spark):
    target = spark.createDataFrame([("c1", "x", "nda", "Seller shall INDEMNIFY all", "KR", "KR"), ("c2", "x", "zzz", None, None, None), ("c3", "x", "spa", "may terminate", None, None)], "clause_id string, clause_type string, contract_family string, text string, jurisdiction string, governing_law string")
    bank = spark.createDataFrame([], "doc_id string, clause_id string, status string, approval_state string, supersedes string")
    got = {r.clause_id: r for r in Review.run(target, bank, bank).collect()}
    assert {k: r.risk_level for k, r in got.items()} == {"c1": "high", "c2": "low", "c3": "medium"}
    assert all(r.review_basis == "general" and r.library_empty and not r.redline and r.suggested_redline is None and r.playbook_tier is None for r in got.values())
    assert got["c1"].mode == "loose" and got["c3"].mode == "strict"


def test_ingest_resolves_references_and_repairs_its_indexes(spark, tmp_path):
    from docmill.plans.library import Library

    body = "\n".join(f"제{i}조 (조항)\n(제목 {i})\n본문 {i} 제{i % 3 + 1}조 참조\n" for i in range(1, 8))
    bad = body.replace("제5조 (", "제6조 (").replace("본문 2 ", "본문 제40조 ")
    files = spark.createDataFrame([("a", "1.투자계약서.docx", "a" * 64, body), ("b", "2.투자계약서.docx", "b" * 64, bad)], "path string, file_name string, sha256 string, md string")
    known = files.select("sha256").limit(0)
    package = Library.ingest(files, known, "t", check_structure=True)
    refs = package.references.collect()
    assert {(r.ref, r.to_label) for r in refs if not r.resolved} == {("제40조", "40")} and any(r.cyclic for r in refs)
    fails = {r.source_file[0]: list(r.soft_fails) for r in package.manifests.collect()}
    assert not any("numbering" in f or "nowhere" in f for f in fails["1"])
    assert "2 breaks in the numbering" in fails["2"] and "1 references point nowhere" in fails["2"]
    manifests = package.manifests.withColumn("approval_state", F.lit("approved"))
    first = Library.repair_indexes(manifests, package.clauses, package.terms, f"{tmp_path}/indexes")
    assert first["documents"] and first["clauses"]
    assert all(b == [] for b in Library.repair_indexes(manifests, package.clauses, package.terms, f"{tmp_path}/indexes").values())
    for f in glob.glob(f"{tmp_path}/indexes/clauses/d=*/_bucket=*/*.parquet")[:2]:
        os.remove(f)
    again = Library.repair_indexes(manifests, package.clauses, package.terms, f"{tmp_path}/indexes")
    assert len(again["clauses"]) == 2 and again["documents"] == []
