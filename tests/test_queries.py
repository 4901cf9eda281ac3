"""Every named query against the SQL of the same result, at the smallest size."""

import glob
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

from docmill.queries import QUERIES, SQL  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in SQL:
        return
    out = con.execute(SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in out.fetchall()), key=repr)
    assert got == want


def test_contract_review_reads_whole_texts(spark, tmp_path, monkeypatch):
    """Texts alike in their first 200 letters are told apart by what follows, in one block of sets or in several."""
    from docmill.operators import retrieve

    head = "the parties agree " * 20
    tails = {3: "alpha beta gamma", 6: "delta epsilon zeta", 9: "eta theta iota", 12: ""}
    own = {1: "delta epsilon zeta", 2: "eta theta kappa", 4: "nothing of these", 5: "alpha beta gamma"}
    docs = [(i, head + t, "en", "src0", 100) for i, t in (tails | own).items()] + [(7, "", "en", "src0", 100), (8, "", "en", "src1", 100)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 1) for i, *_ in docs], "doc_id long, toxic long, quality long").write.parquet(f"{tmp_path}/labels.parquet")
    c = duckdb.connect()
    for name in ("documents", "labels"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = sorted(c.execute(SQL["contract_review"]).fetchall())
    assert [r[:3] for r in want] == [(1, 6, 1.0), (2, 9, round(5 / 7, 6)), (4, 12, 0.5), (5, 3, 1.0), (7, 3, 0.0), (8, None, 0.0)]
    for most in (1 << 20, 8):
        monkeypatch.setattr(retrieve, "WORDS_BLOCK", most)
        assert sorted(map(tuple, QUERIES["contract_review"](spark, str(tmp_path)).collect())) == want


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize(("name", "never", "ever"), [("segment_clauses", "Exchange", "Generate"), ("line_scan", "Exchange", "Generate"), ("defined_terms", "Exchange", "Generate"), ("retrieve_stage1", "NestedLoop", "HashJoin"), ("retrieve_rank_top1", "NestedLoop", "WindowGroupLimit"), ("pricing_summary", "Cartesian", "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate")])
def test_plans(spark, name, never, ever):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().toString()
    assert never not in plan.split("Physical Plan")[1] and ever in plan


def test_files_are_marked_once(spark):
    """A file is written, marked, and read in both copies: four steps in Python, none of them twice."""
    plan = QUERIES["docx_redline"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 4
