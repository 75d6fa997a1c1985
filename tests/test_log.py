import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkledger import schemas
from sparkledger.operators import anomaly, audit, search, stats, triage
from sparkledger.plans import pipelines
from sparkledger.sources import partials, readers, sinks
from sparkledger.streaming import detect

DAY = datetime(2025, 1, 15)
LOG = "id bigint, timestamp timestamp_ntz, ip_address string, username string, operation string, operation_result string, detail string, severity string, source_file string"


def frame(spark, rows):
    return spark.createDataFrame(rows, LOG)


def logins(spark):
    """Six failures of one address, four successes of another, a minute apart."""
    return frame(spark, [(i, DAY + timedelta(minutes=i), "10.0.0.1" if i < 6 else "192.168.1.10", "test", "login", "FAIL" if i < 6 else "SUCCESS", None, "WARN", None) for i in range(10)])


@pytest.mark.parametrize(("threshold", "want"), [(1, "HIGH"), (2, "HIGH"), (3, "MEDIUM"), (5, "LOW"), (6, "LOW"), (7, None)])
def test_brute_force_tiers(spark, threshold, want):
    got = anomaly.brute_force(logins(spark), threshold).collect()
    assert [(r["ip_address"], r["failed_attempts"], r["unique_users"], r["operations_attempted"], r["risk_level"]) for r in got] == ([("10.0.0.1", 6, 1, ["login"], want)] if want else [])


def test_nulls_and_empty(spark):
    empty = frame(spark, [])
    assert anomaly.brute_force(empty).collect() == []
    assert stats.failure_rate(empty).first().asDict() == {"total_records": 0, "failed_records": 0, "failure_rate": 0.0}
    assert stats.day_stats(empty, "2025-01-15").first().asDict() == {"total": 0, "abnormal": 0}
    nulls = frame(spark, [(1, None, None, None, None, None, None, None, None), (2, DAY, None, "u", "LOGIN", "FAIL", None, None, None)])
    assert anomaly.failures_per_ip(nulls).collect() == []
    assert stats.severities(nulls).collect() == []
    assert stats.unique_ips(nulls).first()[0] == 0
    text = report_text(anomaly.report(empty))
    assert "失败操作数:         0\n" in text and "可疑 IP 数:         0 (阈值=5)" in text


def report_text(found, threshold=5):
    return "\n".join(r["line"] for r in anomaly.report_lines(found, threshold).orderBy(*anomaly.ORDER).collect())


def test_report(spark):
    text = report_text(anomaly.report(logins(spark)))
    assert "总日志条数:         10" in text and "6 (60.00%)" in text and "    [!] 10.0.0.1 — 失败 6 次 [LOW]" in text and "    - login: 6 次" in text


def test_pages_agree_with_keysets(spark):
    log = frame(spark, [(i, DAY + timedelta(minutes=i // 3), "a", "u", "LOGIN", "FAIL", None, "INFO", None) for i in range(30)])
    second = [r["id"] for r in search.page(log, 2, 7).collect()]
    last = search.page(log, 1, 7).collect()[-1]
    assert second == [r["id"] for r in search.keyset_page(log, (last["timestamp"], last["id"]), 7).collect()]
    info, _ = search.envelope(log, 2, 7)
    assert info == {"total": 30, "page": 2, "page_size": 7, "pages": 5}
    with pytest.raises(ValueError, match="pages"):
        search.page(log, 0)


def test_predicate_skips_empty_and_includes_bounds(spark):
    log = logins(spark)
    assert search.search(log, ip_address="", operation=None).count() == 10
    assert search.search(log, start=DAY, end=DAY + timedelta(minutes=2)).count() == 3
    assert search.search(log, operation="LOGIN").count() == 0
    assert search.search(log, operation="LOGIN", ignore_case=True).count() == 10


def test_csv(spark, tmp_path):
    (tmp_path / "a.CSV").write_text('timestamp,ip,user,action,result,message,extra\n2025-01-15 08:00:05,10.0.0.5,张三,LOGIN,FAIL,"a ""b"", c",1\nbad,NA,,LOGIN,None,x,2\n')
    got = readers.read_logs(spark, [str(tmp_path / "a.CSV")]).orderBy("extra").collect()
    assert (got[0]["username"], got[0]["detail"], got[0]["timestamp"], got[0]["severity"]) == ("张三", 'a "b", c', datetime(2025, 1, 15, 8, 0, 5), None)
    assert (got[1]["ip_address"], got[1]["username"], got[1]["operation_result"], got[1]["timestamp"], got[1]["timestamp_text"]) == (None, None, None, None, "bad")
    (tmp_path / "b.csv").write_text("ip,ip_address\n1,2\n")
    with pytest.raises(ValueError, match="more than one"):
        readers.read_csv(spark, str(tmp_path / "b.csv"))


def test_line_numbers_over_small_splits(spark, tmp_path):
    for name in ("a.log", "b.log"):
        (tmp_path / name).write_bytes(b"".join(b"\r\n" if i % 7 == 0 else f"{name} {i + 1} 10.0.0.{i % 9}\n".encode() for i in range(800)) + b"x\xff 801\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = readers.read_text(spark, [str(tmp_path / "a.log"), str(tmp_path / "b.log")])
        assert rows.rdd.getNumPartitions() > 8
        got = rows.select("raw_line", "line_number").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 2 * (801 - 115)
    assert all(int(r["raw_line"].split()[1]) == r["line_number"] for r in got)
    assert sum("�" in r["raw_line"] for r in got) == 2
    (tmp_path / "empty.log").write_text("")
    assert readers.read_text(spark, str(tmp_path / "empty.log")).count() == 0


def test_json_batch(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps([{"timestamp": "2025-01-15T08:00:00", "ipAddress": "1.1.1.1", "operationResult": "FAIL", "sourceFile": "a.log"}, {}]))
    got = readers.read_json_batch(spark, str(tmp_path / "x.json"))
    assert set(schemas.FIELDS) <= set(got.columns)
    assert sorted((str(r["ip_address"]), str(r["operation_result"])) for r in got.collect()) == [("1.1.1.1", "FAIL"), ("None", "None")]


def test_append_assigns_ids_and_rejects(spark, tmp_path):
    log = logins(spark).drop("id")
    bad = log.limit(1).withColumn("username", F.lit(None).cast("string"))
    for _ in range(2):
        sinks.append_logs(spark, log.unionByName(bad), str(tmp_path / "log"), str(tmp_path / "bad"))
    rows = readers.read_table(spark, str(tmp_path / "log"))
    assert rows.count() == 20 == rows.select("id").distinct().count()
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 2


@pytest.mark.parametrize(("text", "want"), [(None, "NULL"), ("hello", "'hello'"), ("it's", "'it\\'s'"), ("path\\to", "'path\\\\to'"), ("a\r\nb\x00c", "'a bc'"), ("", "''")])
def test_sql_text(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(sinks.sql_text(F.col("t"))).first()[0] == want


def test_sql_dump(spark, tmp_path):
    rows = spark.createDataFrame([("2025-01-15 08:00:00", "1.1.1.1"), ("soon", None)], "timestamp string, ip_address string")
    got = sorted(r["value"] for r in sinks.insert_statements(rows).collect())
    assert got[0].endswith("VALUES ('2025-01-15 08:00:00', '1.1.1.1', NULL, NULL, NULL, NULL, NULL, NULL);") and "('soon', NULL," in got[1]
    sinks.write_sql(spark, rows.limit(0), str(tmp_path / "dump"))
    assert any("Auto-generated" in r["value"] for r in spark.read.text(str(tmp_path / "dump/head")).collect())


RULES = [
    ("SQL injection: ' OR '1'='1 in username field", "CRITICAL", "ATTACK", True), ("XSS detected: <script>alert(1)</script>", "CRITICAL", "ATTACK", True), ("Unauthorized path traversal attempt: ../../etc/passwd", "HIGH", "ATTACK", True),
    ("2025-01-15 08:00:05 User zhangsan LOGIN FAIL wrong password", "LOW", "LOGIN", False), ("Unauthorized access attempt to /admin by scanner", "MEDIUM", "ACCESS", False), ("all fine", "NORMAL", "UNKNOWN", False), (None, "NORMAL", "UNKNOWN", False),
]


def test_rules(spark):
    rows = spark.createDataFrame([(i, r[0]) for i, r in enumerate(RULES)], "i int, t string").select("i", triage.rules(F.col("t")).alias("v")).orderBy("i").collect()
    assert [(r["v"]["risk_level"], r["v"]["operation_type"], r["v"]["need_intervention"]) for r in rows] == [r[1:] for r in RULES]


REPLIES = [
    ('{"operationType":"LOGIN","riskLevel":"HIGH","needIntervention":true,"suggestion":"s","summary":"m","sourceIp":"172.31.0.50"}', ("LOGIN", "HIGH", True, "172.31.0.50"), True),
    ('Sure:\n```json\n{"operationType":"QUERY","riskLevel":"LOW","sourceIp":null}\n```', ("QUERY", "LOW", False, None), True), ('{"operationType": "UNKNOWN"}', ("UNKNOWN", "NORMAL", False, None), True),
    ('{"operationType": "X"} trailing', ("UNKNOWN", "NORMAL", False, None), False), ("{bad}", ("UNKNOWN", "NORMAL", False, None), False), ("login: fail", ("LOGIN", "LOW", False, None), False), ("[1,2]", ("UNKNOWN", "NORMAL", False, None), False), (None, ("UNKNOWN", "NORMAL", False, None), False),
]


def test_replies(spark):
    rows = spark.createDataFrame([(i, r[0]) for i, r in enumerate(REPLIES)], "i int, t string").select("i", triage.parse_reply(F.col("t")).alias("r")).orderBy("i").collect()
    for r, (text, want, parsed) in zip(rows, REPLIES, strict=True):
        v = r["r"]["verdict"]
        assert (v["operation_type"], v["risk_level"], v["need_intervention"], v["source_ip"]) == want, text
        assert r["r"]["parsed"] == parsed, text


def test_envelopes_and_payloads(spark):
    bodies = ['{"content":[{"type":"text","text":"A"}]}', '{"choices":[{"message":{"content":"B"}}]}', "plain"]
    assert [r[0] for r in spark.createDataFrame([(b,) for b in bodies], "b string").select(triage.envelope_text(F.col("b"))).collect()] == ["A", "B", "plain"]
    row = spark.createDataFrame([("x",)], "t string").select(triage.request_payload(F.col("t"), "http://anthropic", "m").alias("a"), triage.request_payload(F.col("t"), "http://o", "m").alias("b")).first()
    a, b = json.loads(row["a"]), json.loads(row["b"])
    assert a["messages"][0]["content"][0]["text"] == "x" and "temperature" not in a and b["temperature"] == 0.3 and b["messages"][1]["content"] == "x"


def test_history_isolation_and_deletion(spark):
    logs = spark.createDataFrame([(1, "a", "LOGIN FAIL"), (2, "b", "../x")], "log_id long, username string, log_content string")
    rows = triage.history(triage.resolve(logs, spark.createDataFrame([(1, 500, None)], "log_id long, status int, body string"), "m"))
    assert {r["model_used"] for r in rows.collect()} == {triage.API_FAILURE}
    assert triage.lookup(rows, 2, "a").count() == 0 and triage.lookup(rows, 2, "b").count() == 1
    assert [r["id"] for r in triage.without(rows, rows.filter("id = 1")).collect()] == [2]
    assert triage.recent(rows, 500).count() == 2


def test_audit(spark):
    rows = spark.createDataFrame([(1, None, "VIEW_LOGS", None, None, 5, 2, "", "9.9.9.9", True, None), (2, "u", "VIEW_DETAIL", "i", "o", 5, 2, " 1.1.1.1 , 2.2.2.2", "9.9.9.9", False, None)], "id long, user string, action string, ip string, operation string, log_id long, count long, forwarded string, peer string, ok boolean, at timestamp_ntz")
    got = audit.records(rows).orderBy("id").collect()
    assert [(r["operator"], r["target"], r["ip_address"], r["status"]) for r in got] == [("anonymous", "ip=null, operation=null", "9.9.9.9", "SUCCESS"), ("u", "logId=5", "1.1.1.1", "FAILED")]


def test_report_job(spark, tmp_path):
    (tmp_path / "s.log").write_text("\n".join(f"2025-01-15 08:00:{i:02d} 172.16.0.88 User u{i % 2} LOGIN FAIL" for i in range(10)) + "\n")
    written = pipelines.log_report(spark, [str(tmp_path / "s.log")], str(tmp_path / "out"), sql=True, sections=True)
    text = pipelines.preview(spark, written["report_text"])
    assert text.split("\n")[1] == anomaly.TITLE and text.endswith("\n\n" + anomaly.RULE)
    assert pipelines.preview(spark, written["report_text"], 3).split("\n") == [anomaly.RULE, anomaly.TITLE, anomaly.RULE]
    assert "172.16.0.88 — 失败 10 次 [MEDIUM]" in text
    assert spark.read.csv(str(tmp_path / "out/suspicious_ips"), header=True).first()["unique_users"] == "2"
    assert spark.read.text(str(tmp_path / "out/sql/statements")).count() == 10
    info, page = pipelines.load_and_search(spark, [str(tmp_path / "s.log")], str(tmp_path / "table"), operation="LOGIN")
    assert info["total"] == 10 and page.count() == 10
    pipelines.log_report(spark, [str(tmp_path / "s.log")], str(tmp_path / "none"), threshold=11)
    assert not (tmp_path / "none/suspicious_ips").exists()
    with pytest.raises(ValueError, match="threshold"):
        pipelines.log_report(spark, [], "x", threshold=0)


def test_stream_finds_what_the_batch_finds(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [f"2025-01-15 08:{m:02d}:00 10.0.0.1 LOGIN FAIL" for m in range(6)] + ["2025-01-15 12:00:00 10.0.0.2 LOGIN SUCCESS", "2025-01-15 12:00:00 10.0.0.2 LOGIN FAIL"]
    (tmp_path / "in/a.log").write_text("\n".join(lines) + "\n")
    detect.stream_detect(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), threshold=5).awaitTermination()
    batch = detect.sliding_brute_force(readers.read_text(spark, str(tmp_path / "in")), 5)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, batch.collect())) != []


def test_ids_go_on_after_a_job_that_died(spark, tmp_path):
    path = str(tmp_path / "log")
    for k in range(3):
        sinks.append_logs(spark, logins(spark).drop("id"), path)
        if k == 1:  # as if the second job had died between its batch and its mark
            partials.mark(spark, path, None)
    rows = readers.read_table(spark, path)
    assert rows.count() == 30 == rows.select("id").distinct().count()
    assert spark.read.parquet(f"{path}/_largest_id").first()["id"] == rows.agg(F.max("id")).first()[0]


def test_replies_are_parsed_once(spark):
    logs = spark.createDataFrame([(1, "x")], "log_id long, log_content string")
    plan = triage.resolve(logs, spark.createDataFrame([(1, 200, "{}")], "log_id long, status int, body string"), "m")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and plan.count("try_parse_json") + plan.count("parse_json") <= 2


def test_database_round_trip(spark):
    url, known = "jdbc:derby:memory:test-log;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = logins(spark).select("id", "ip_address", "operation_result")
    for part in (rows.filter("id < 4"), rows.filter("id >= 4")):  # the second is appended
        sinks.write_jdbc(part, url, "log_entry", batch=3, **known)
    one = readers.read_jdbc(spark, url, "log_entry", **known)
    many = readers.read_jdbc(spark, url, "log_entry", ['"id" < 5', '"id" >= 5'], **known)
    assert many.rdd.getNumPartitions() == 2
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect())) == sorted(map(tuple, rows.collect()))


def test_no_python_in_plans(spark):
    log = logins(spark)
    for df in (anomaly.brute_force(log), stats.report_counts(log), search.page(log, 1)):
        assert "Python" not in df._jdf.queryExecution().toString()


def test_long_pages_are_those_by_order(spark, monkeypatch):
    """Null times and ids, and rows of one key at the ends of pages."""
    monkeypatch.setattr(search, "TOP", 3)
    rows = [(None if i % 7 == 3 else i // 4, None if i % 5 == 0 else DAY + timedelta(microseconds=i // 3)) for i in range(60)]
    logs = frame(spark, [(i, t, "10.0.0.1", "u", "LOGIN", "FAIL", None, "WARN", None) for i, t in rows])
    key = lambda r: (r[1] is None, -(r[1] - DAY) // timedelta(microseconds=1) if r[1] else 0, r[0] is None, -(r[0] or 0))
    want = sorted(rows, key=key)
    for size in (7, 20, 59, 60, 61):
        got = [(r["id"], r["timestamp"]) for n in range(1, 60 // size + 2) for r in search.page(logs, n, size).collect()]
        assert got == want
    for at in (0, 11, 30, 50):
        later = [r for r in want if key(r) > key(want[at])]
        for size in (5, 20, 100):
            assert [(r["id"], r["timestamp"]) for r in search.keyset_page(logs, want[at][::-1], size).collect()] == later[:size]
    assert search.page(logs, 9, 20).collect() == []


def test_no_task_takes_a_long_page(spark, capsys):
    logs = frame(spark, [(1, DAY, "10.0.0.1", "u", "LOGIN", "FAIL", None, "WARN", None)]).drop("id").crossJoin(spark.range(30_000))
    for page in (search.page(logs, 1, 20_000), search.keyset_page(logs, (DAY, 29_000), 20_000), search.page(logs, 2, 12_000)):
        page.explain()
        assert not [w for w in ("TakeOrdered", "GlobalLimit", "CollectLimit") if w in capsys.readouterr().out]
        assert page.count() in (20_000, 12_000)
