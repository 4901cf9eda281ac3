import hashlib
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as p
from docmill.llm import mixing, toxicity
from docmill.llm.bpe import vocabulary
from test_minhash import brute as brute_components


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    r = random.Random(9)
    path = tmp_path_factory.mktemp("sf")
    word = lambda: "".join(r.choice(["an", "th", "er", "on", "in", "es", "ou"]) for _ in range(r.randint(1, 5)))
    rows, labels = [], []
    for i in range(260):
        w = [word() for _ in range(r.choice([6, 40, 120]))]
        if i % 5 == 0:
            for bad in ("grobian", "knilch"):
                w.insert(r.randrange(len(w)), bad)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 5 == 0)))
    for i in range(1, 60, 3):  # exact and near copies
        rows.append((300 + i, rows[i][1]))
        w = rows[i][1].split()
        w[len(w) // 2] = "changed"
        rows.append((400 + i, " ".join(w)))
    rows += [(900, None), (901, ""), (902, "one two")]
    docs = {"doc_id": [d for d, _ in rows], "text": [t for _, t in rows], "lang": [r.choice(["en", "de", None]) for _ in rows], "source": [r.choice(["a", "a", "b"]) for _ in rows], "n_chars": [len(t or "") for _, t in rows]}
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    pq.write_table(pa.table(docs, schema), path / "documents.parquet")
    ids, quality, toxic = zip(*labels, strict=True)
    pq.write_table(pa.table({"doc_id": ids, "quality": pa.array(quality, pa.int32()), "toxic": pa.array(toxic, pa.int32())}), path / "labels.parquet")
    return str(path)


def test_stages_against_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    index = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    before = {r.doc_id: r for r in docs.collect()}
    made = []
    for name, stage in p.STAGES:
        docs = p.saved(stage(spark, docs, folder), f"test-{name}")
        made.append({r.doc_id: r for r in docs.collect()})
        if name != "bpe":
            assert docs.columns == list(p.COLUMNS)
    clean, single, apart, mixed, ids = made
    rejected = {d for d, r in before.items() if index.score(*index.nearest(*index.vector(r.text or ""))) >= toxicity.CUT}
    assert set(clean) == set(before) - rejected
    assert {d for d in range(0, 260, 5)} <= rejected and len(rejected) < 75
    last = {}
    for d, r in clean.items():
        last[r.text or ""] = max(d, last.get(r.text or "", d))
    assert set(single) == set(last.values())
    assert set(apart) == set(brute_components([(d, r.text) for d, r in single.items()], 5, 80).values())
    drawn = mixing.mix(spark.createDataFrame([tuple(r) for r in apart.values()], "doc_id long, text string, lang string, source string, n_chars long"))
    assert set(mixed) == {r.doc_id for r in drawn.collect() if r.sampled}
    lib = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    assert set(ids) == set(mixed)
    for d, r in ids.items():
        want = lib.encode(mixed[d].text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(want)
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert {r.doc_id for r in p.run(spark, folder).collect()} == set(ids)


def test_odd_rows_and_empty_tables(spark, folder, tmp_path):
    """Repeated ids, rows without one, nulls in any column, and columns of the stages' own names."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = docs.selectExpr("*", "1 AS kept", "'x' AS score", "'y' AS topic", "2 AS _keep", "3 AS _again")
    odd = spark.createDataFrame([(1000, "alpha beta gamma delta epsilon zeta", "en", "a", 5), (1000, "alpha beta gamma delta epsilon zeta", "en", "a", 5), (None, "theta iota kappa lambda my ny", None, None, None), (None, None, None, None, None), (1001, "z " * 60_000, None, "b", None)], docs.schema).selectExpr("*", "1 AS kept", "'x' AS score", "'y' AS topic", "2 AS _keep", "3 AS _again")
    extra.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    rows, made = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in p.STAGES:
        rows = p.saved(stage(spark, rows, str(tmp_path)), f"odd-{name}")
        assert name == "bpe" or rows.columns == list(p.COLUMNS)
        made[name] = [(r.doc_id, r.text) for r in rows.collect()] if name != "bpe" else rows.collect()
    assert sum(d == 1000 for d, _ in made["toxicity"]) == 2 and [sum(d == 1000 for d, _ in made[k]) for k in ("exact_dedup", "near_dedup")] == [1, 1]
    assert (None, "theta iota kappa lambda my ny") in made["near_dedup"] and sum(d == 1001 for d, _ in made["near_dedup"]) == 1
    assert len(made["bpe"]) == len(made["mixing"])
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert p.run(spark, f"{tmp_path}/none").count() == 0
