"""Corpus reader: a flat directory of ``*.log`` files to numbered, decoded lines."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.staging import fits_broadcast, stage

FILE_GLOB = "*.log"

_LISTING_CONF = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
LISTING_WAVES = 4  # tasks per core that list folders


@contextmanager
def _few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Many folders to a task while Spark lists a path: by default each is a task of its own."""
    before = spark.conf.get(_LISTING_CONF)
    most = LISTING_WAVES * spark.sparkContext.defaultParallelism
    spark.conf.set(_LISTING_CONF, str(min(int(before), most)))
    try:
        yield
    finally:
        spark.conf.set(_LISTING_CONF, before)


def _plain_path(uri: Column) -> Column:
    """Undo the URI form Spark reports: percent escapes, and slashes after ``file:``."""
    decoded = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:/+", "/")


def _scan(spark: SparkSession, log_dir: str, skip_unreadable: bool = False) -> DataFrame:
    reader = spark.read.option("pathGlobFilter", FILE_GLOB).option(
        "ignoreCorruptFiles", str(skip_unreadable).lower()
    )
    with _few_listing_tasks(spark):
        return reader.text(log_dir)


def _unlisted(file: Column) -> Column:
    return F.raise_error(F.concat(F.lit("not among the listed files: "), file)).cast("bigint")


def list_files(
    spark: SparkSession, log_dir: str, corpus_rank: int = 0, first_ord: int = 0
) -> DataFrame:
    """The files in path order, empty ones included: file, corpus_rank, file_ord.

    The names come from the listing that Spark's driver makes to plan the scan anyway;
    the scan itself drops empty files.
    """
    schema = "uri STRING, corpus_rank INT"
    names = [(uri, corpus_rank) for uri in _scan(spark, log_dir).inputFiles()]
    files = spark.createDataFrame(names, schema).select(
        _plain_path(F.col("uri")).alias("file"), "corpus_rank"
    )
    # One narrow row per file, as many as the driver listed.
    in_order = Window.partitionBy("corpus_rank").orderBy("file")
    return files.withColumn(
        "file_ord", (F.row_number().over(in_order) + F.lit(first_ord - 1)).cast("bigint")
    )


def read_lines(
    spark: SparkSession,
    log_dir: str,
    files: DataFrame | None = None,
    skip_unreadable: bool = False,
) -> DataFrame:
    """Every line of the corpus: file, file_ord, line_no (from 1) and decoded value.

    ``skip_unreadable`` leaves out the rest of a file that fails while it is read. A file that
    appears after ``files`` was listed is an error, not left out.

    Splits lose the position in the file, so one map-only pass writes each line with its
    split and a running id; the per-split counts then give every split its first line
    number. No line is shuffled or sorted for that. The written table also keeps the
    numbers stable when the rest of a job reads the lines several times or loses a task.
    """
    files = list_files(spark, log_dir) if files is None else files
    staged = stage(
        _scan(spark, log_dir, skip_unreadable).select(
            _plain_path(F.col("_metadata.file_path")).alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("mid"),
            F.col("value").cast("binary").alias("raw"),
        ),
        "lines",
    )
    return number_lines(staged, files)


def number_lines(staged: DataFrame, files: DataFrame) -> DataFrame:
    """Turn (file, block, mid, raw) rows into numbered lines, decoded file by file."""
    whole_file = Window.partitionBy("file")
    earlier = (
        whole_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    per_block = staged.groupBy("file", "block").agg(
        F.min("mid").alias("first_mid"),
        F.count(F.lit(1)).alias("n"),
        F.bool_and(F.is_valid_utf8(F.col("raw").cast("string"))).alias("valid"),
    )
    blocks = stage(
        per_block.select(
            "file",
            "block",
            # line_no = mid + shift
            (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first_mid") + 1).alias("shift"),
            F.bool_and("valid").over(whole_file).alias("utf8"),
        )
        .join(files.select("file", "file_ord"), "file", "left")
        .withColumn("file_ord", F.coalesce("file_ord", _unlisted(F.col("file")))),
        "blocks",
        measured=True,
    )
    side = F.broadcast(blocks) if fits_broadcast(blocks) else blocks
    return staged.join(side, ["file", "block"]).select(
        "file",
        "file_ord",
        (F.col("mid") + F.col("shift")).alias("line_no"),
        # One byte that is not UTF-8 makes the whole file latin-1.
        F.when(F.col("utf8"), F.col("raw").cast("string"))
        .otherwise(F.decode("raw", "ISO-8859-1"))
        .alias("value"),
    )
