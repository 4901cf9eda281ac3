"""Reading a folder of incoming files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.text import extension, stem, strip_html
from docmill.operators.joins import with_ordinals

from . import docx

SUPPORTED = ("docx", "md", "html", "htm", "txt")


def listing(spark: SparkSession, folder: str, only_docx: bool = False) -> DataFrame:
    """``path, file_name, ext, length, content`` of the files; names that begin with a dot are left out, and so are
    empty files, which Spark's readers do not list.

    Content is read only by plans that use it: a listing or a hash of names prunes the column.  Rows come in no order,
    so that no content is shuffled; ``in_order`` numbers the listing alone.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if only_docx:
        reader = reader.option("pathGlobFilter", "*.[dD][oO][cC][xX]")
    files = reader.load(folder).withColumn("file_name", F.element_at(F.split("path", "/"), -1))
    return files.where(~F.col("file_name").startswith(".")).select("path", "file_name", extension(F.col("file_name")).alias("ext"), "length", "content")


def in_order(files: DataFrame) -> DataFrame:
    """The listing by path, without content: ``path, file_name, ext, length, ordinal, of``."""
    return with_ordinals(files.select("path", "file_name", "ext", "length"), "path")


def supported(files: DataFrame, formats: tuple[str, ...] = SUPPORTED) -> DataFrame:
    """``files`` with ``skip_reason``: null, ``empty`` or ``unsupported``."""
    return files.withColumn("skip_reason", F.when(F.col("length") <= 0, "empty").when(~F.col("ext").isin(*formats), "unsupported"))


def normalised(files: DataFrame, readers: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """``path, file_name, ext, length, md, plain, error`` of supported files; text formats never leave the JVM.

    ``readers`` adds formats that need a library, such as ``pdf``: each takes rows with ``content`` and gives rows with
    ``md, plain, error`` in its place.
    """
    readers = readers or {}
    ok = supported(files, (*SUPPORTED, *readers)).where("skip_reason is null").drop("skip_reason")
    more = [read(ok.where(F.col("ext") == name)) for name, read in readers.items()]
    ok = ok.where(~F.col("ext").isin(*readers)) if readers else ok
    text = F.decode("content", "UTF-8")
    plain = F.when(F.col("ext").isin("html", "htm"), strip_html(text)).otherwise(text)
    others = ok.where("ext <> 'docx'").withColumns({"md": plain, "plain": plain, "error": F.lit(None).cast("string")}).drop("content")
    out = others.unionByName(docx.extract(ok.where("ext = 'docx'")))
    for rows in more:
        out = out.unionByName(rows.select(*out.columns))
    return out


def sidecars(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON sidecars with the stem of their name as ``doc_stem``."""
    rows = spark.read.schema(schema).option("multiLine", "true").json(folder)
    return rows.withColumn("doc_stem", stem(F.col("_metadata.file_name")))


def latest_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The results of the batch summary whose file name is last; an empty frame if there is none."""
    schema = "timestamp string, results array<struct<file string, doc_id string, status string, sha256 string, run_dir string, error string>>"
    rows = spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", "*_batch-summary.json").json(folder).withColumn("_name", F.col("_metadata.file_name"))
    last = rows.orderBy(F.desc("_name")).limit(1)
    return last.select("timestamp", F.explode("results").alias("r")).select("timestamp", "r.*")


def index_or_empty(spark: SparkSession, name: str, schema: str) -> DataFrame:
    """A table of the catalog, or no rows of its schema before the first run."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)
