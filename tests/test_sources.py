import random

from pyspark.sql import functions as F

from faultline.operators.assemble import assemble_entries
from faultline.sources.logs import list_files, read_lines

SAMPLE = [
    "junk before",
    "  orphan continuation",
    "[1.001] [t1] [NET] Error: link 12 down 10.0.0.1",
    "  more detail 0x1F",
    "DEBUG ignored",
    "\tattached anyway",
    "[1.500] [t1] [NET] Deauthenticated (reason 0x07)\r",
    "[0.0004] [t] [X]    ",
]
SAMPLE_ENTRIES = [
    (3, 1000, "NET", "Error", "Error: link 12 down 10.0.0.1\nmore detail 0x1F\nattached anyway"),
    (7, 1500, "NET", "Unknown", "Deauthenticated (reason 0x07)"),
    (8, 0, "X", "Unknown", ""),
]


def test_files_and_lines(spark, write_log):
    folder = write_log("a b+c.log", SAMPLE)
    write_log("100%.log", ["[1.0] [a] [b] x"])
    write_log("empty.log", [])
    write_log("other.txt", ["[1.0] [a] [b] not a log"])
    write_log("deep.log", ["[1.0] [a] [b] below"], folder="logs/sub")
    files = list_files(spark, folder).orderBy("file_ord").collect()
    assert [f["file"] for f in files] == [
        f"{folder}/{n}" for n in ("100%.log", "a b+c.log", "empty.log")
    ]
    assert [f["file_ord"] for f in files] == [0, 1, 2]
    rows = read_lines(spark, folder).orderBy("file_ord", "line_no").collect()
    expected = [(0, 1, "[1.0] [a] [b] x")]
    expected += [(1, i, v.rstrip("\r")) for i, v in enumerate(SAMPLE, 1)]
    assert [(r["file_ord"], r["line_no"], r["value"]) for r in rows] == expected


def test_line_ends(spark, write_log):
    folder = write_log("mixed.log", ["a\rb", "c\r", "", "d"])
    rows = read_lines(spark, folder).orderBy("line_no").collect()
    assert [(r["line_no"], r["value"]) for r in rows] == [
        (1, "a"), (2, "b"), (3, "c"), (4, ""), (5, "d"),
    ]


def test_one_bad_byte_makes_the_file_latin_1(spark, write_log):
    folder = write_log("utf.log", ["[1.0] [a] [b] é"])
    write_log("latin.log", ["[1.0] [a] [b] é", "[2.0] [a]\xa0[b] ok"], encoding="latin-1")
    rows = read_lines(spark, folder).orderBy("file", "line_no").collect()
    assert [r["value"] for r in rows] == [
        "[1.0] [a] [b] é", "[2.0] [a]\xa0[b] ok", "[1.0] [a] [b] é",
    ]


def test_numbers_do_not_depend_on_splits(spark, write_log):
    rng = random.Random(3)
    texts = {
        name: [f"{i} {'x' * rng.randrange(60)}" for i in range(1, n + 1)]
        for name, n in (("big.log", 5000), ("mid.log", 700), ("one.log", 1))
    }
    for name, rows in texts.items():
        folder = write_log(name, rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    try:
        lines = read_lines(spark, folder)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    wrong = lines.filter(F.col("line_no") != F.substring_index("value", " ", 1).cast("bigint"))
    assert lines.count() == 5701
    assert wrong.count() == 0


def test_shuffle_plan_of_the_block_join(spark, write_log, monkeypatch):
    monkeypatch.setattr("faultline.sources.logs.fits_broadcast", lambda df: False)
    folder = write_log("a.log", [f"{i}" for i in range(1, 40)])
    rows = read_lines(spark, folder).collect()
    assert sorted((r["line_no"], r["value"]) for r in rows) == [(i, str(i)) for i in range(1, 40)]


def test_entries(spark, write_log):
    folder = write_log("s.log", SAMPLE)
    lines = read_lines(spark, folder)
    for chunk_lines in (1, 2, 3, 5, 1 << 18):
        rows = assemble_entries(lines, chunk_lines).orderBy("line_no").collect()
        assert [tuple(r)[2:] for r in rows] == SAMPLE_ENTRIES


def plain_entries(values):
    out = []
    for no, value in enumerate(values, 1):
        if value.startswith("["):
            out.append((no, value.split("] ")[-1].strip()))
        elif value[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], out[-1][1] + "\n" + value.strip())
    return out


def test_entries_do_not_depend_on_chunks(spark):
    rng = random.Random(5)
    rows, expected = [], []
    for file in ("f", "g", "h"):
        kinds = rng.choices(["ps", "more", "noise"], weights=[2, 5, 1], k=150)
        values = [
            {"ps": f"[1.0] [t] [C] m{i}", "more": f" \tpart {i}", "noise": f"noise {i}"}[k]
            for i, k in enumerate(kinds)
        ]
        rows += [(file, no, v) for no, v in enumerate(values, 1)]
        expected += [(file, *e) for e in plain_entries(values)]
    lines = spark.createDataFrame(rows, "file STRING, line_no BIGINT, value STRING")
    for chunk_lines in (1, 4, 17, 1 << 18):
        got = assemble_entries(lines, chunk_lines).select("file", "line_no", "message").collect()
        assert sorted(map(tuple, got)) == sorted(expected)
