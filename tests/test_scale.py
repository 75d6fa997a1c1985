"""What the operators read, write and keep: scans counted, order across files, panes, block counts, owners of scratch."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkledger.functions import extract
from sparkledger.operators import anomaly, search, stats
from sparkledger.plans import pipelines, queries
from sparkledger.sources import partials, readers, scratch, sinks
from sparkledger.streaming import detect

DAY = datetime(2025, 1, 15)
LOG = "id bigint, timestamp timestamp_ntz, ip_address string, username string, operation string, operation_result string, detail string, severity string, source_file string"


def failures(spark, n, addresses):
    return spark.createDataFrame([(i, DAY + timedelta(seconds=37 * i), f"10.0.{i % addresses // 250}.{i % addresses % 250}", f"u{i % 7}", "LOGIN", "FAIL", None, "WARN", None) for i in range(n)], LOG)


def executed(spark):
    """The final plans of what ran so far, by number."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return {found.apply(i).executionId(): found.apply(i).physicalPlanDescription() for i in range(found.size())}


def scans_of(spark, path, f, kind=""):
    """How often f, run to its end, scans what lies at the path."""
    before, n = executed(spark).keys(), 0
    f()
    for k, text in executed(spark).items():
        if k not in before:
            used = set(re.findall(r"\((\d+)\)[^\n]*$", text.split("== Initial Plan ==")[0].split("\n\n\n")[0], re.M))
            for node, what in re.findall(r"^\((\d+)\) Scan (.*?)(?=^\(\d+\) |\Z)", text, re.M | re.S):
                n += node in used and what.startswith(kind) and path in what.partition("Location:")[2].split("\n")[0]
    return n


def test_scans_are_counted(spark, tmp_path):
    path = str(tmp_path / "log")
    failures(spark, 20, 2).write.parquet(path)
    log = spark.read.parquet(path)
    assert scans_of(spark, path, lambda: log.agg(F.max("id")).collect()) == 1
    assert scans_of(spark, path, lambda: log.groupBy("id").count().join(log, "id").collect()) == 2


@pytest.mark.parametrize("name", ["anomaly_report", "anomaly_report_lines", "report_sections", "suspicious_csv", "ordered_report_text"])
def test_one_scan_of_the_log(spark, name):
    run = queries.QUERIES[name]
    assert scans_of(spark, "/root/testdata/sf0.001/events.parquet", lambda: run(spark, "/root/testdata/sf0.001").collect()) == 1


def test_report_job_scans_the_log_once_for_its_counts(spark, tmp_path):
    (tmp_path / "s.csv").write_text("timestamp,ip,user,action,result,level\n" + "\n".join(f"2025-01-15 08:00:{i:02d},172.16.0.{i % 3},u{i % 2},LOGIN,FAIL,WARN" for i in range(60)) + "\n")
    run = lambda **x: pipelines.log_report(spark, [str(tmp_path / "s.csv")], str(tmp_path / "out"), sections=True, **x)
    assert scans_of(spark, str(tmp_path / "s.csv"), run, "csv") == 1


def test_reports_of_rows_by_hand(spark):
    """Null and repeated users, addresses and times; operations that aren't asked for."""
    at = lambda m: DAY + timedelta(minutes=m)
    rows = [("a", "x", "login", "FAIL"), ("a", "x", "LOGIN", "FAIL"), ("a", None, "LOGIN", "FAIL"), ("a", "y", "DELETE", "FAIL"), ("a", "y", "LOGIN", "SUCCESS"), (None, "x", "LOGIN", "FAIL"), ("b", "z", None, "FAIL"), ("b", None, "LOGIN", None), ("a", "z", "LOGIN", "FAIL")]
    log = spark.createDataFrame([(i, None if i == 1 else at(i), ip, user, op, res, None, "INFO" if i % 2 else None, None) for i, (ip, user, op, res) in enumerate(rows)], LOG)
    for ops in (("LOGIN",), None):
        got = {r["key"]: r for r in anomaly.report_rows(log, ops).filter("section = 'ip'").collect()}
        want = {r["ip_address"]: r for r in anomaly.failures_per_ip(log, ops).collect()}
        for ip in "ab":
            for c in ("failed_attempts", "first_seen", "last_seen", "unique_users", "operations_attempted"):
                assert got[ip][c] == (want[ip][c] if ip in want else {"failed_attempts": 0, "unique_users": 0, "operations_attempted": []}.get(c)), (ip, c)
        assert (got["a"]["n"], got["a"]["n_failed"], got["b"]["n"], got["b"]["n_failed"]) == (6, 5, 2, 1)
    cells = {(r["section"], r["key"]): (r["n"], r["n_failed"]) for r in anomaly.report_rows(log).collect()}
    assert cells["total", None] == (9, 7) and cells["operation", "LOGIN"] == (6, 4) and cells["severity", "INFO"] == (4, 3) and ("severity", None) not in cells


def test_report_is_whole_beyond_a_thousand_addresses(spark, tmp_path):
    """Every address has its line, in the order of the ranks, over several files."""
    log = failures(spark, 6500, 2500)
    with scratch.owned(spark):
        lines = anomaly.report_lines(anomaly.report(log, 2), 2)
        before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            sinks.write_ordered_text(lines, str(tmp_path / "text"), anomaly.ORDER)
        finally:
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        want = [r["line"] for r in sorted(lines.collect(), key=lambda r: (r["part"], r["place"], r["name"]))]
    files = sorted(p for p in (tmp_path / "text").iterdir() if p.name.startswith("part"))
    assert len([p for p in files if p.stat().st_size]) > 1
    assert "".join(p.read_text() for p in files).splitlines() == want  # as other programs read them
    got = readers.read_ordered_text(spark, str(tmp_path / "text")).collect()
    assert sorted(r["line_number"] for r in got) == list(range(1, len(want) + 1))
    assert [r["value"] for r in sorted(got, key=lambda r: r["line_number"])] == want and sum("[!]" in x for x in want) == 2500


def test_scratch_has_an_owner(spark):
    with scratch.owned(spark) as own:
        kept = scratch.table(spark, spark.range(3), "x")
        assert kept.count() == 3 and len(own) == 1 and readers.exists(spark, own[0])
        with scratch.owned(spark) as inner:
            scratch.table(spark, spark.range(3), "y")
        assert not readers.exists(spark, inner[0]) and readers.exists(spark, own[0])
    assert not readers.exists(spark, own[0])
    with pytest.raises(ZeroDivisionError), scratch.owned(spark) as own:
        scratch.table(spark, spark.range(3), "z")
        1 / 0  # noqa: B018
    assert not readers.exists(spark, own[0])


# pages


def test_keyset_pages_with_null_times_and_ids(spark):
    rows = [(i if i % 4 else None, DAY if i % 2 else None, "a", "u", "LOGIN", "FAIL", None, "INFO", None) for i in range(1, 12)]
    log = spark.createDataFrame(rows, LOG)
    by_offset, by_key, after = [], [], None
    for k in range(1, 9):
        page = search.page(log, k, 3).collect()
        by_offset += [(r["timestamp"], r["id"]) for r in page]
        page = search.keyset_page(log, after, 3).collect()
        by_key += [(r["timestamp"], r["id"]) for r in page]
        if page:
            after = page[-1]["timestamp"], page[-1]["id"]
    ids = lambda x: [i for _, i in x if i is not None]
    assert ids(by_offset) == ids(by_key) == [11, 9, 7, 5, 3, 1, 10, 6, 2]  # then rows without time and id, which nothing tells apart
    assert by_offset[:11][-2:] == [(None, None)] * 2


# windows


@pytest.mark.parametrize(("length", "slide"), [("10 minutes", "1 minute"), ("10 minutes", "4 minutes"), ("7 minutes", "7 minutes"), ("1 hour", "25 minutes")])
def test_windows_by_panes(spark, length, slide):
    """Against windows over the rows themselves; lengths that are no multiple of the slide among them."""
    log = failures(spark, 400, 5).withColumn("timestamp", F.when(F.col("id") % 11 != 0, F.col("timestamp")))
    rows = log.filter("timestamp IS NOT NULL").groupBy(F.window("timestamp", length, slide).alias("w"), "ip_address").agg(F.count("*").alias("n")).filter("n >= 2")
    want = sorted((r["w"]["start"], r["w"]["end"], r["ip_address"], r["n"]) for r in rows.collect())
    got = detect.sliding_brute_force(log, 2, length, slide)
    assert sorted(tuple(r)[:4] for r in got.collect()) == want != []


def test_windows_expand_counts_not_rows(spark):
    plan = detect.sliding_brute_force(failures(spark, 10, 2), 2)._jdf.queryExecution().optimizedPlan().toString()
    depth = {name: [len(x) - len(x.lstrip(" :+-")) for x in plan.splitlines() if re.match(rf"[ :+-]*{name}", x)] for name in ("Expand", "Aggregate")}
    assert len(depth["Expand"]) == 1 and len(depth["Aggregate"]) == 2 and min(depth["Aggregate"]) < depth["Expand"][0] < max(depth["Aggregate"])


# numbers of lines


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def numbers(df):
    return {(r["input_file"][-5:], r["line_number"]): r["value"] for r in df.collect()}


def test_block_index(spark, tmp_path, small_splits):
    folder, index = tmp_path / "in", str(tmp_path / "index")
    folder.mkdir()
    for name in ("a.log", "b.log"):
        (folder / name).write_text("\n".join(f"{name} {i}" for i in range(1, 1200)) + "\n")
    want = {(name, i): f"{name} {i}" for name in ("a.log", "b.log") for i in range(1, 1200)}
    read = lambda: numbers(readers.numbered_lines(spark, str(folder), index))
    assert not readers.index_holds(spark, str(folder), index)
    assert read() == want
    assert readers.index_holds(spark, str(folder), index)
    got = {}
    assert scans_of(spark, str(folder), lambda: got.update(read()), "text") == 1
    assert got == want
    # other splits, another file, another content: the index is made anew
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    assert not readers.index_holds(spark, str(folder), index) and read() == want and readers.index_holds(spark, str(folder), index)
    (folder / "c.log").write_text("new\n")
    assert not readers.index_holds(spark, str(folder), index) and read() == want | {("c.log", 1): "new"}
    (folder / "c.log").write_text("other, and longer\nx\n")
    assert read() == want | {("c.log", 1): "other, and longer", ("c.log", 2): "x"}


def test_counts_of_other_splits_are_an_error(spark, tmp_path, small_splits):
    """Were the settings changed between the counts and the read, no wrong number comes out."""
    (tmp_path / "a.log").write_text("\n".join(f"line {i}" for i in range(3000)) + "\n")
    lines = readers.numbered_lines(spark, str(tmp_path / "a.log"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        got = numbers(lines)
    except Exception as e:
        assert "line counts" in str(e)
    else:
        assert all(int(v.split()[1]) + 1 == k for (_, k), v in got.items())
    again = readers.numbered_lines(spark, str(tmp_path / "a.log"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    with pytest.raises(Exception, match="line counts"):  # a new plan of the same frame
        again.filter("value <> ''").select("value", "line_number", "input_file").collect()


# the log table


def spread(spark, n, start=0, day=DAY, minutes=1):
    """n rows of as many addresses, a few minutes apart; every fifth failed, every tenth an error."""
    i = F.col("id")
    ip = F.concat(F.lit("10."), F.pmod(F.xxhash64("id"), F.lit(250)), F.lit("."), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(250)), F.lit("."), i % 200)
    at = F.lit(day).cast("timestamp_ntz") + F.make_interval(mins=(i * minutes).cast("int"))
    return spark.range(start, start + n).select(at.alias("timestamp"), ip.alias("ip_address"), F.concat(F.lit("u"), i % 9).alias("username"), F.lit("LOGIN").alias("operation"), F.when(i % 5 == 0, "FAIL").otherwise("SUCCESS").alias("operation_result"), F.lit(None).cast("string").alias("detail"), F.when(i % 10 == 0, "ERROR").otherwise("INFO").alias("severity"), F.lit(None).cast("string").alias("source_file"))


def rows_read(df):
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value()


@pytest.mark.parametrize("layout", ["time", "address"])
def test_point_lookups_read_few_row_groups(spark, tmp_path, layout):
    path = str(tmp_path / "log")
    rows = spread(spark, 30_000).withColumn("timestamp", F.lit(DAY).cast("timestamp_ntz"))  # of one day, so that no folder is left out
    sinks.append_logs(spark, rows.repartition(2, "username"), path, layout=layout, row_group=64 << 10, values=2000)
    log = readers.read_table(spark, path)
    one = log.filter("id % 7000 = 77").first()
    assert log.count() == 30_000
    for found in (search.by_id(log, one["id"]), search.search(log, ip_address=one["ip_address"])):
        assert one["id"] in [r["id"] for r in found.collect()] and rows_read(found.select("id", "username")) < 3000
    assert rows_read(search.search(log, ip_address="10.9.9.x").select("id")) == 0


def exact(spark, path, a=None, b=None):
    rows = readers.read_table(spark, path)
    if a is not None:
        rows = rows.filter((F.col("timestamp") >= F.lit(a).cast("timestamp_ntz")) & (F.col("timestamp") < F.lit(b).cast("timestamp_ntz")))
    return rows.agg(F.count_distinct("ip_address")).first()[0]


def counts_agree(spark, path):
    rows = lambda df: sorted(map(tuple, df.collect()))
    log = readers.read_table(spark, path)
    assert rows(partials.abnormal_rate_by_day(spark, path)) == rows(stats.abnormal_rate_by_day(log)) != []
    assert partials.day_stats(spark, path, "2025-01-15").first() == stats.day_stats(log, "2025-01-15").first()


def test_hour_counts_are_kept_with_appends(spark, tmp_path):
    path = str(tmp_path / "log")
    sinks.append_logs(spark, spread(spark, 3000), path)
    sinks.append_logs(spark, spread(spark, 2000, 3000), path)
    sinks.append_logs(spark, spread(spark, 500, 9000, DAY - timedelta(days=20)).unionByName(spread(spark, 100, 50)), path)  # an old day, and hours that were there
    sinks.append_logs(spark, spread(spark, 0), path)
    assert partials.whole(spark, path)
    counts_agree(spark, path)
    assert scans_of(spark, f"{path}]", lambda: partials.abnormal_rate_by_day(spark, path).collect()) == 0
    assert readers.read_table(spark, path).count() == 5600  # the counts are no part of the log


def test_hour_counts_after_a_job_that_died(spark, tmp_path):
    """Between the rows and their counts, and before counts were kept at all."""
    path = str(tmp_path / "log")
    sinks.append_logs(spark, spread(spark, 300), path)
    kept = spark.read.parquet(f"{path}/_hours").count()
    real, partials.add = partials.add, lambda *x: 1 / 0
    try:
        with pytest.raises(ZeroDivisionError):
            sinks.append_logs(spark, spread(spark, 300, 300), path)
    finally:
        partials.add = real
    assert not partials.whole(spark, path) and spark.read.parquet(f"{path}/_hours").count() == kept
    counts_agree(spark, path)  # from the log itself
    sinks.append_logs(spark, spread(spark, 100, 600), path)
    assert partials.whole(spark, path)
    counts_agree(spark, path)
    scratch.delete(spark, f"{path}/_hours")
    counts_agree(spark, path)
    sinks.append_logs(spark, spread(spark, 100, 700), path)
    assert partials.whole(spark, path)
    counts_agree(spark, path)
    assert readers.read_table(spark, path).select("id").distinct().count() == 800


def test_hour_counts_are_compacted(spark, tmp_path):
    path = str(tmp_path / "log")
    for k in range(3):
        sinks.append_logs(spark, spread(spark, 400, 100 * k), path)
    kept = lambda: spark.read.parquet(f"{path}/_hours").count()
    before, rows = kept(), sorted(map(str, partials.hours(spark, path).drop("ips").collect()))
    partials.compact(spark, path)
    assert partials.whole(spark, path) and kept() == len(rows) < before
    assert sorted(map(str, partials.hours(spark, path).drop("ips").collect())) == rows
    true = exact(spark, path)
    assert abs(partials.unique_ips(spark, path).first()[0] - true) <= partials.error_bound() * true  # a union of unions may estimate otherwise, within the bound
    sinks.append_logs(spark, spread(spark, 100, 900), path)
    counts_agree(spark, path)
    assert readers.read_table(spark, path).select("id").distinct().count() == 1300
    # died while the folders were swapped
    partials.mark(spark, path, None)
    scratch.delete(spark, f"{path}/_hours")
    counts_agree(spark, path)
    sinks.append_logs(spark, spread(spark, 100, 1000), path)
    assert partials.whole(spark, path) and readers.read_table(spark, path).select("id").distinct().count() == 1400
    counts_agree(spark, path)
    partials.compact(spark, str(tmp_path / "none"))  # nothing there


def test_different_addresses_of_any_range(spark, tmp_path):
    path, at = str(tmp_path / "log"), lambda **x: DAY + timedelta(**x)
    for k in range(3):
        sinks.append_logs(spark, spread(spark, 9000, 9000 * k, DAY, minutes=1).unionByName(spread(spark, 500, 9000 * max(k - 1, 0))), path)
    near = lambda got, want: abs(got.first()[0] - want) <= partials.error_bound() * want + 0.5
    assert near(partials.unique_ips(spark, path), exact(spark, path))
    for a, b in ((at(), at(days=3)), (at(hours=5), at(hours=6)), (at(hours=5, minutes=7), at(days=2, minutes=1)), (at(minutes=3), at(minutes=44)), (at(minutes=50), at(minutes=70)), (at(minutes=60), at(minutes=61)), (at(days=-3), at(days=-2)), (at(days=1), at(days=1))):
        assert near(partials.unique_ips(spark, path, a, b), exact(spark, path, a, b)), (a, b)
    assert scans_of(spark, f"{path}]", lambda: partials.unique_ips(spark, path, at(hours=5), at(days=4)).collect()) == 0
    assert scans_of(spark, f"{path}]", lambda: partials.unique_ips(spark, path, at(hours=5, minutes=1), at(days=4)).collect()) == 1
    got = partials.active_ips(spark, path, at(days=4))
    assert near(got, stats.active_ips(readers.read_table(spark, path), "2025-01-19 00:00:00").first()[0])


@pytest.mark.parametrize("name", ["load_and_search_job", "log_report_job", "stream_brute_force", "stream_alerts"])
def test_jobs_over_text_keep_addresses_of_any_user(spark, tmp_path, name):
    """From user 12800 on the third number of an address is over 255."""
    duckdb = pytest.importorskip("duckdb")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.withColumn("user_id", F.col("user_id") + 12_800).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = queries.QUERIES[name](spark, str(tmp_path))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert want


def test_addresses_are_ipv4_unless_a_pattern_is_given(spark):
    lines = spark.createDataFrame([("10.0.255.7 LOGIN",), ("10.0.256.7 LOGIN",)], "line string")
    assert [r["ip_address"] for r in extract.parse_lines(lines, "line").collect()] == ["10.0.255.7", None]
    assert [r["ip_address"] for r in extract.parse_lines(lines, "line", address=queries.ADDRESS).collect()] == ["10.0.255.7", "10.0.256.7"]
