"""Log lines, corpora and vectors derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators.ordered import with_row_number
from faultline.staging import new_folder

MS_PER_DAY = 8_640  # the clock below runs at 10 real seconds per millisecond
# Healthy entries: those of the first day, from before the devices had the VIEW component.
HEALTHY_DAY, NEW_COMPONENT = 0, "VIEW"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table; one that is too small to fill the cores is spread over them."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _text(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def log_lines(spark: SparkSession, sf_dir: str, daily: bool = False) -> DataFrame:
    """``events`` as raw lines of four device logs: file, line_no, value.

    With ``daily`` each log is cut into one file per day, numbered from 1 again.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 10_000_000) - F.lit(170_406_720)
    device = F.concat(F.lit("f"), _text(F.col("user_id") % 4))
    stamped = events.withColumn("ms", ms.cast("bigint"))
    day = F.floor(F.col("ms") / MS_PER_DAY).cast("bigint")
    name = F.concat(device, F.lit("-"), _text(day)) if daily else device
    numbered = with_row_number(
        stamped.withColumn("file", F.concat(name, F.lit(".log"))),
        keys=["file"],
        coarse={"day": day},
        coarse_order=[F.col("_unit_day")],
        order=[F.col("ms"), F.col("event_id")],
        out="line_no",
    )
    return numbered.select("file", "line_no", _line_text().alias("value"))


# One line in so many is of a rule that the ordinary lines do not reach.
RARE_EVENT = 29
RARE_TEXTS = (
    "check_for_bad_handle: timer 0x1a is already free",
    "Log Type: DIAGNOSTIC Error Msg: assert 7",
    "ASSOC_RESP: Association Failed with status code = 17",
    "WIFI_SET_BACKGROUND_SCAN_CNF with result failure",
    "kernel panic after RNDIS hardReset",
)
# The clock of these devices stands still, or runs backwards from a late start.
CLOCKLESS_DEVICE, BACKWARDS_DEVICE, LATE_MS = 3, 2, 1_000_000_000


def _clock() -> Column:
    """What the device prints for the time ms."""
    device = F.col("user_id") % 4
    return (
        F.when(device == CLOCKLESS_DEVICE, F.lit(0))
        .when(device == BACKWARDS_DEVICE, LATE_MS - F.col("ms"))
        .otherwise(F.col("ms"))
        .cast("bigint")
    )


def _line_text() -> Column:
    event_id, kind, clock = F.col("event_id"), F.col("event_type"), _clock()
    second = F.floor(clock / 1000).cast("bigint")
    rare = F.array(*map(F.lit, RARE_TEXTS))
    head = F.concat(
        F.lit("["), _text(second), F.lit("."), F.lpad(_text(clock % 1000), 3, "0"),
        F.lit("] [t"), _text(F.col("user_id") % 8), F.lit("] ["), F.upper(kind), F.lit("] "),
    )
    reason = F.substr(F.lit("1237f"), (event_id % 5).cast("int") + 1, F.lit(1))
    message = (
        F.when(
            event_id % RARE_EVENT == 0,
            F.get(rare, (F.floor(event_id / RARE_EVENT) % len(RARE_TEXTS)).cast("int")),
        )
        .when(
            (kind == "purchase") & (event_id % 4 < 3),
            F.concat(F.lit("SDPQueueManager: classic queue full, "), _text("user_id"), F.lit(" waiting")),
        )
        .when(
            (kind == "error") & (event_id % 7 == 0),
            F.concat(F.lit("Deauthenticated (reason 0x0"), reason, F.lit(")")),
        )
        .when(kind == "error", F.lit("Trace |SSPLogger |Error: dump"))
        .when(
            (kind == "click") & (event_id % 5 == 0),
            F.concat(F.lit("kernel panic at 10.0.0."), _text(event_id % 50)),
        )
        .when(
            kind == "view",
            F.concat(
                F.lit("Warning: scan timeout after "), _text(event_id % 300),
                F.lit(" ms on wlan"), _text(event_id % 3),
            ),
        )
        .otherwise(
            F.concat(F.lit("Level6: user "), _text("user_id"), F.lit(" "), kind, F.lit(" ok"))
        )
    )
    return (
        F.when(event_id % 23 == 0, F.concat(F.lit("debug dump "), _text(event_id)))
        .when(
            event_id % 19 == 0,
            F.concat(F.lit("  continued at 0x"), F.lpad(_text(event_id % 100), 2, "0")),
        )
        .otherwise(F.concat(head, message))
    )


def log_corpus(spark: SparkSession, sf_dir: str) -> str:
    """The daily log files written as real ``.log`` files; returns the path to read."""
    path = new_folder(spark, "corpus")
    _write_logs(log_lines(spark, sf_dir, daily=True), path)
    return f"{path}/{ALL_NAMES}"


def _write_logs(lines: DataFrame, path: str, **options: str) -> None:
    (
        lines.repartition("file")
        .sortWithinPartitions("file", "line_no")
        .select("file", "value")
        .write.partitionBy("file")
        .options(extension="log", sep="\u0001", quote="", **options)
        .options(ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")
        .csv(path)
    )


# What ends each line, and how a device's files are written.
ACCENTS = " \u00e9\u00fc\u00bf"
ENCODINGS = {
    0: {"encoding": "ISO-8859-1", "lineSep": "\n"},
    1: {"encoding": "UTF-8", "lineSep": "\r"},
    2: {"encoding": "UTF-8", "lineSep": "\r\n"},
    3: {"encoding": "ISO-8859-1", "lineSep": "\r"},
}


def encoded_corpus(spark: SparkSession, sf_dir: str) -> str:
    """The daily log files with accents in every line, in the encodings and line ends above."""
    path = new_folder(spark, "corpus")
    lines = log_lines(spark, sf_dir, daily=True).withColumn("value", F.concat("value", F.lit(ACCENTS)))
    for device, options in ENCODINGS.items():
        own = lines.withColumns(file_parts()).filter(F.col("device") == device)
        _write_logs(own, f"{path}/device{device}", **options)
    return f"{path}/*/file=*"


def file_parts() -> dict[str, Column]:
    """Device and day of a daily log."""
    device, day = (F.regexp_extract("file", r"^f(\d+)-(\d+)", i).cast("bigint") for i in (1, 2))
    return {"device": device, "day": day}


# Two ways to deal all files to two directories: by device, and by day.
NORMAL_FILES, ANOMALY_FILES = "device < 2", "device >= 2"
HEALTHY_FILES = f"day <= {HEALTHY_DAY}"
OTHER_FILES = f"day > {HEALTHY_DAY}"

# The same sides as names of files below a written corpus, so that each line is written once.
ALL_NAMES = "file=*"
SIDE_NAMES = {
    NORMAL_FILES: "file=f[01]-[0-9]*.log",
    ANOMALY_FILES: "file=f[23]-[0-9]*.log",
    HEALTHY_FILES: f"file=f[0-9]-{HEALTHY_DAY}.log",
    OTHER_FILES: "file=f[0-9]-[1-9]*.log",
}


def side_of(corpus: str, side: str) -> str:
    """The path that reads only one side of a ``log_corpus``."""
    return f"{corpus.removesuffix(ALL_NAMES)}{SIDE_NAMES[side]}"


MD5_DIM = 32


def md5_embedding(text: Column) -> Column:
    """An embedder of plain expressions: each word adds a weight to a slot, both from its md5."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")

    def digits(word: Column, at: int, many: int) -> Column:
        return F.conv(F.substring(F.md5(word.cast("binary")), at, many), 16, 10).cast("bigint")

    parts = F.transform(
        words,
        lambda w: F.struct(
            (digits(w, 1, 8) % MD5_DIM).alias("slot"),
            (1 + (digits(w, 9, 4) % 997) / F.lit(997.0)).alias("weight"),
        ),
    )

    def total(slot: Column) -> Column:
        own = F.filter(parts, lambda part: part["slot"] == slot)
        return F.aggregate(own, F.lit(0.0), lambda done, part: done + part["weight"])

    slots = F.sequence(F.lit(0).cast("bigint"), F.lit(MD5_DIM - 1).cast("bigint"))
    return F.transform(slots, lambda slot: total(slot).cast("float"))


def corpus_file(path: Column) -> Column:
    """Name of a daily log from the path it was written to."""
    return F.regexp_extract(path, r"file=([^/]+)/", 1)


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document: doc_id, line_no, message."""
    lines = read(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "message")
    )
    return lines.select("doc_id", (F.col("at") + 1).cast("bigint").alias("line_no"), "message")


def document_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines as training messages: pos, message, normal.

    A document labelled with quality 1 is healthy.
    """
    healthy = read(spark, sf_dir, "labels").filter("quality = 1").select(
        "doc_id", F.lit(True).alias("good")
    )
    return (
        document_lines(spark, sf_dir)
        .join(healthy, "doc_id", "left")
        .select(
            (F.shiftleft("doc_id", 32) + F.col("line_no")).alias("pos"),
            "message",
            F.coalesce("good", F.lit(False)).alias("normal"),
        )
    )
