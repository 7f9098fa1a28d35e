import pytest
from pyspark.sql import functions as F

from faultline.functions import lines as ln
from faultline.functions import templates as tpl
from faultline.operators.rule_hits import rule_hits
from faultline.rules import RULE_LIBRARY, rules_table


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "v STRING").select(expression(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("text", "masked"),
    [
        ("len=35 seq 0x1F", "len=<*> seq <*>"),
        ("wlan0 12ms 1.2.3", "wlan0 12ms <*>.<*>"),
        ("10.0.0.1:80 aa:bb:cc:dd:ee:ff", "<*>:<*> <*>"),
        ("E5 v2.0 0xZZ 7", "E5 v2.<*> 0xZZ <*>"),
        ("300.1.2.3.4 é5 5é", "<*>.<*> é5 5é"),
    ],
)
def test_masking(spark, text, masked):
    assert one(spark, text, tpl.mask) == masked


def test_masked_text_joins_tokens_by_one_blank(spark):
    assert one(spark, " a\t b\n 7 \x1c", tpl.masked_text) == "a b <*>"
    assert one(spark, " a\t b\n 7 \x1c", lambda v: tpl.n_tokens(tpl.masked_text(v))) == 3
    assert one(spark, "   ", lambda v: tpl.n_tokens(tpl.masked_text(v))) == 0
    assert one(spark, "   ", lambda v: tpl.prefix(tpl.masked_text(v))) == "<empty>"
    assert one(spark, "   ", lambda v: tpl.tokens(tpl.masked_text(v))) == []


def test_params_in_order(spark):
    text = "Error: link 12 down 10.0.0.1\nmore detail 0x1F\nattached anyway"
    assert one(spark, text, tpl.params) == ["12", "10.0.0.1", "0x1F"]


def test_similarity_and_merge(spark):
    def pair(template, toks):
        return spark.createDataFrame(
            [(template, toks)], "m ARRAY<STRING>, t ARRAY<STRING>"
        ).select(
            tpl.similarity(F.col("m"), F.col("t")).alias("s"), tpl.merge(F.col("m"), F.col("t"))
        ).first()

    assert tuple(pair(["link", "up", "eth0"], ["link", "down", "eth0"])) == (
        pytest.approx(2 / 3), ["link", "<*>", "eth0"],
    )
    assert pair(["a", "<*>"], ["a", "z"])["s"] == 1.0
    assert pair(["a", "z"], ["a", "<*>"])["s"] == 0.5
    assert pair(["a"], ["a", "b"])["s"] == 0.0
    assert tuple(pair([], [])) == (1.0, [])


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("[1.5] [t] [NET] x", True),
        ("[1.5] [t] [NET] x\u0085y", True),
        (" [1.5] [t] [NET] x", False),
        ("[15] [t] [NET] x", False),
        ("[1.5] [] [NET] x", False),
        ("[1.5] [t] [NET]x", False),
        ("[1.5] [t] [NET] ", False),
    ],
)
def test_ps_line(spark, text, expected):
    assert one(spark, text, ln.is_ps_line) is expected


def test_ps_fields(spark):
    text = "[1.001] [t[1] [ [NET ]  Warning : a ] b  "
    row = spark.createDataFrame([(text,)], "v STRING").select(
        *[c.alias(n) for n, c in ln.ps_fields(F.col("v")).items()]
    ).first()
    assert tuple(row) == (1000, "[NET", "Warning", "Warning : a ] b")


def test_raw_meta(spark):
    def meta(text):
        return tuple(
            spark.createDataFrame([(text,)], "v STRING")
            .select(*ln.raw_meta(F.col("v")).values())
            .first()
        )

    assert meta("  [9.25] [w] [ NET ] x") == ("9.25", 9250, " NET ")
    assert meta("[9.25] [w] x") == ("9.25", 9250, "w")
    assert meta("plain") == ("", 0, "")
    assert meta("[1.0] [w] " + "x" * 200 + "[late]") == ("1.0", 1000, "w")


@pytest.mark.parametrize(
    ("text", "fired"),
    [
        ("[9.5] [w] [NET] Deauthenticated (reason 0x07)", ["deauth_reason_07_class3_frame"]),
        ("[9.5] [w] [NET] deauthenticated (REASON 0xF)", ["deauth_reason_0f_cipher_mismatch"]),
        ("[9.5] [w] [NET] Deauthenticated (reason 0x03)", ["deauth_unexpected_reason"]),
        ("[9.5] [w] [USB] RNDIS watchdog reset", []),
        ("[9.5] [w] [SYS] Watchdog timer fired", ["watchdog_or_hard_reset"]),
        ("[9.5] [w] [SYS] uſe-after-free", ["use_after_free_timer"]),
        ("[9.5] [w] [SYS] Log Type: DIAGNOSTIC Error Msg: x", ["firmware_diagnostic_error"]),
        ("[9.5] [w] [SYS] Trace |SSPLogger |Error: x", ["firmware_error_burst"]),
        (
            "[9.5] [w] [SYS] ASSOC_RESP: Association Failed status code = 17",
            ["association_rejected_with_status"],
        ),
        (
            "[9.5] [w] [SYS] WIFI_SET_BACKGROUND_SCAN_CNF with result failure",
            ["background_scan_failed"],
        ),
        ("[9.5] [w] [SYS] SDPQueueManager x classic queue full", ["tx_queue_overflow_storm"]),
        (
            "[9.5] [w] [SYS] kernel panic, use after free, already free: timer",
            ["use_after_free_timer", "watchdog_or_hard_reset"],
        ),
        ("Deauthenticated (reason 0x07)", []),
    ],
)
def test_rules(spark, text, fired):
    lines = spark.createDataFrame([("f", 1, text)], "file STRING, line_no BIGINT, value STRING")
    got = [r["rule_ord"] for r in rule_hits(lines).orderBy("rule_ord").collect()]
    assert [RULE_LIBRARY[i].name for i in got] == fired


def test_rules_table(spark):
    rows = rules_table(spark).orderBy("rule_ord").collect()
    assert [r["name"] for r in rows] == [rule.name for rule in RULE_LIBRARY]
    assert [r["rule_ord"] for r in rows if r["burst_min"] is not None] == [5, 8]


def test_literals_only_save_time(spark):
    texts = [
        "Already Free: the tİmer", "USE AFTER FREE", "use-after-Free", "Log Type:DIAGNOSTICError Msg:",
        "check_for_bad_handle: it is already free", "x|SSPLogger   |ERROR: y", "kernel panic",
        "ASSOC_RESP Association Failed with status code = 5", "WatchDog has Reset", "forced reboot",
        "wifi_set_background_scan_cnf with result failure", "trecknetworkadapter send failure",
        "SDPQueueManager: Classic Queue Full", "DeauthentIcated(reason 0x2)", "nothing to see",
        "\u212aernel panic", "forced reboot during hardReset",
    ]
    rows = [("f", i, f"[1.0] [t] [C] {t}") for i, t in enumerate(texts)]
    lines = spark.createDataFrame(rows, "file STRING, line_no BIGINT, value STRING")
    plain = [rule._replace(literals=()) for rule in RULE_LIBRARY]
    expected = sorted(map(tuple, rule_hits(lines, plain).collect()))
    assert len({r[4] for r in expected}) >= 8
    assert sorted(map(tuple, rule_hits(lines).collect())) == expected
