import pytest
from pyspark.sql import functions as F

from sparkledger.functions import extract as x

CASES = [
    (x.timestamp_text, "2025-01-15 08:23:45.123 Some log entry", "2025-01-15 08:23:45.123"),
    (x.timestamp_text, "15/Jan/2025:08:23:45 +0800 GET /api/users 200", "15/Jan/2025:08:23:45 +0800"),
    (x.timestamp_text, "Jan 15 08:23:45 hostname sshd[123]: message", "Jan 15 08:23:45"),
    (x.timestamp_text, "No timestamp here", None),
    (x.ip_address, "10.0.0.55 zhangsan LOGIN FAIL", "10.0.0.55"),
    (x.ip_address, "999.999.999.999 is not valid", None),
    (x.ip_address, "300.1.2.3", "00.1.2.3"),
    (x.ip_address, "1.2.3.256", "1.2.3.25"),
    (x.operation, "user login success", "LOGIN"),
    (x.operation, 'CONFIG by root "Updated"', "UPDATE"),
    (x.operation, 'ACCESS "/api/config"', "CONFIG"),
    (x.operation, "Some random text", "UNKNOWN"),
    (x.operation_result, "操作成功完成", "SUCCESS"),
    (x.operation_result, "LOGIN FAIL: wrong password", "FAIL"),
    (x.operation_result, "an ERROR", "FAIL"),
    (x.operation_result, "fail success", "UNKNOWN"),
    (x.operation_result, "DENIED", "UNKNOWN"),
    (x.severity, "CRITICAL: disk full", "CRITICAL"),
    (x.severity, "a Warning", "WARN"),
    (x.severity, "发生错误", "INFO"),
    (x.severity, "发生 错误", "ERROR"),
    (x.severity, "just a regular log entry", "INFO"),
    (x.username, "username=zhangsan LOGIN FAIL", "zhangsan"),
    (x.username, "user:lisi QUERY SUCCESS", "lisi"),
    (x.username, 'user="bob" x', "bob"),
    (x.username, "Query user list now", "list"),
    (x.username, "LOGIN SUCCESS", "unknown"),
    (x.detail, 'User admin LOGIN SUCCESS "logged in from workstation"', "logged in from workstation"),
    (x.detail, 'a "" b', ""),
    (x.detail, "it 'was' so", "was"),
    (x.detail, "LOGIN SUCCESS", None),
    (x.source_file, "Traceback in app.py line 42", "app.py"),
    (x.source_file, "[gateway.log] x", "[gateway.log"),
    (x.source_file, 'see fixtures.json" x', "fixtures.js"),
    (x.source_file, "no file here", None),
]


def test_extractors(spark):
    rows = spark.createDataFrame([(i, line) for i, (_, line, _) in enumerate(CASES)], "i int, line string")
    for f in {f for f, _, _ in CASES}:
        got = {r["i"]: r["v"] for r in rows.select("i", f(F.col("line")).alias("v")).collect()}
        for i, (g, line, want) in enumerate(CASES):
            if g is f:
                assert got[i] == want, (f.__name__, line)


@pytest.mark.parametrize(
    ("text", "want"),
    [("2025-01-15  08:23:45.1", "2025-01-15 08:23:45.1"), ("2025-01-15 08:23:45.123456789", "2025-01-15 08:23:45.123456"), ("15/Jan/2025:08:23:45 +0800", "2025-01-15 00:23:45"), ("Jan  5 08:23:45", "2024-01-05 08:23:45"), ("2025-13-45 99:00:00", None), (None, None)],
)
def test_typed_timestamp(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(x.typed_timestamp(F.col("t"), 2024).cast("string").alias("v")).first()
    assert row["v"] == want


def test_parse_lines_skips_blanks_and_keeps_columns(spark):
    rows = spark.createDataFrame([(1, "　 \t"), (2, " 10.0.0.1 LOGIN FAIL "), (3, None), (4, "")], "severity int, line string")
    got = x.parse_lines(rows.withColumnRenamed("severity", "extra"), "line").collect()
    assert [(r["extra"], r["raw_line"]) for r in got] == [(2, "10.0.0.1 LOGIN FAIL")]


ODD_LINES = [
    "CRİTICAL x", "crıtical x", "uſer=bob", "USER:  'a b'", "no level here", "warned only", "WARN", "a.log", "x.logs y", "1.2.3.4", "1..2.3.4", "1.2", "at 08:00", "2025-01-15  08:00:05.123 x", "[15/Jan/2025:08:00:05 +0800]", "Jan 15 08:00:05", "success SUCCESS", "失败 成功", "érror 错误", "", "User", "user name=z", "emergencyé", "INFO_x", "ＥRROR",
]


def test_what_patterns_need_is_looked_for_first(spark):
    """The quick looks change nothing: each field against its pattern alone."""
    rows = spark.createDataFrame([(line,) for line in [*ODD_LINES, None]], "t string")
    t = F.col("t")
    level = F
    for p, label in x.LEVELS:
        level = level.when(t.rlike(rf"(?iU)\b({p})\b"), label)
    result = F
    for p, label in x.RESULTS:
        result = result.when(t.rlike(p), label)
    found = F.regexp_extract(t, x.USER, 2)
    plain = {
        "timestamp_text": F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in x.TIMESTAMPS]), "ip_address": F.nullif(F.regexp_extract(t, x.IPV4, 1), F.lit("")),
        "severity": level.otherwise("INFO"), "operation_result": result.otherwise("UNKNOWN"), "source_file": F.nullif(F.regexp_extract(t, x.SOURCE, 1), F.lit("")),
        "username": F.when(found == "", "unknown").otherwise(F.regexp_replace(found, "^[\"']+|[\"']+$", "")),
    }
    got = rows.select("t", *[c.alias(k) for k, c in x.parse_line(t).items() if k in plain]).collect()
    want = rows.select("t", *[plain[k].alias(k) for k in x.parse_line(t) if k in plain]).collect()
    for a, b in zip(got, want, strict=True):
        assert a == b
