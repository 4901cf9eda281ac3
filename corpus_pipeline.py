"""From documents to encoded training text: each stage reads what the one before has written.

All stages but the last return the columns of ``documents``, whatever other columns the table has; a row that an
earlier stage has dropped is gone for all later ones.  In every stage a null text counts as empty, texts of any length
are read whole, and an empty table gives an empty one of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docmill.llm import bpe, exact_dedup, minhash, mixing, toxicity
from docmill.llm.common import saved, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the cut stay; examples come from labelled rows of these documents.  Rows without a
    doc_id are scored like others and never examples; repeated rows are kept or dropped together."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays, and of rows that repeat it one; rows without a doc_id go where a row with
    one has their text."""
    return exact_dedup.deduplicate(docs).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five words, similarity 0.8) the smallest doc_id stays; texts without words are
    near nothing, and rows without a doc_id stay."""
    return minhash.deduplicate(docs, 5, 80).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the raked source, language and topic weights.  A null source or language is a value of
    its own; rows of one doc_id are drawn together, and so are those without one."""
    return mixing.sample(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text's ids, and the digests of its round trip: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, a row for each
    row, repeated ones and those without a doc_id too; no ids for an empty text."""
    return bpe.round_trip(docs, bpe.vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Near copies, nearest examples, raking and BPE can't be said in SQL; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
