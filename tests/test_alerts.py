"""Alerts on crossing, over several runs of a stream with late rows, against batch."""

import random
from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st

from sparkledger.sources import readers
from sparkledger.streaming import alerts

DAY = datetime(2025, 1, 15)


def write(folder, name, rows):
    """rows: (minutes after midnight, address)."""
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(f"{DAY + timedelta(minutes=m):%Y-%m-%d %H:%M:%S} {ip} LOGIN FAIL\n" for m, ip in rows))


def runs(spark, tmp_path, **x):
    alerts.stream_alerts(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), **x).awaitTermination()
    return sorted((r["ip_address"], r["window_start"], r["failed_attempts"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def batch(spark, tmp_path, **x):
    return sorted(map(tuple, alerts.episodes(readers.read_text(spark, str(tmp_path / "in")), **x).select("ip_address", "window_start", "last_end", "failed_attempts").collect()))


def test_alerts_over_several_runs(spark, tmp_path):
    at = lambda m: DAY + timedelta(minutes=m)
    a, b, c = "10.0.0.1", "10.0.0.2", "10.0.0.3"
    write(tmp_path / "in", "1.log", [(480, a), (481, a), (482, b)])
    assert runs(spark, tmp_path, threshold=3) == []  # two failures, and no window is over yet
    write(tmp_path / "in", "2.log", [(483, a), (484, b)])
    one = [(a, at(474), 3)]
    assert runs(spark, tmp_path, threshold=3) == one  # raised while its window is open
    write(tmp_path / "in", "3.log", [(484, a), (485, a), (490, a), (482, c), (484, c)])
    assert runs(spark, tmp_path, threshold=3) == one  # the same attack goes on
    write(tmp_path / "in", "4.log", [(481, b)])  # late, within the watermark: the third of b
    two = [*one, (b, at(475), 3)]
    assert runs(spark, tmp_path, threshold=3) == two
    write(tmp_path / "in", "5.log", [(600, a), (601, a), (602, a)])
    three = sorted([*two, (a, at(593), 3)])
    assert runs(spark, tmp_path, threshold=3) == three  # another attack
    write(tmp_path / "in", "6.log", [(483, c), (485, c)])  # far behind the watermark: not counted any more
    assert runs(spark, tmp_path, threshold=3) == three
    write(tmp_path / "in", "7.log", [(1000, "10.0.0.9")])
    runs(spark, tmp_path, threshold=3)  # timers remove what is over
    write(tmp_path / "in", "8.log", [(1001, c), (1002, c), (1003, c)])
    assert runs(spark, tmp_path, threshold=3) == sorted([*three, (c, at(994), 3)])
    states = spark.read.format("state-metadata").load(str(tmp_path / "cp")).collect()
    assert any("transformWithState" in r["operatorName"] for r in states)


def test_alerts_of_random_batches_are_the_episodes(spark, tmp_path):
    """Rows that come at most as late as is allowed for: each episode of the whole gets one alert or, where late rows join episodes, one for each part; none is raised besides."""
    rng = random.Random(4)
    rows = sorted((rng.randrange(0, 700) if rng.random() < 0.5 else 60 * rng.randrange(12) + rng.randrange(6), f"10.0.0.{rng.randrange(4)}") for _ in range(260))
    moved = sorted(rows, key=lambda r: r[0] + rng.randrange(25))  # up to 25 minutes out of order
    for k in range(6):
        write(tmp_path / "in", f"{k}.log", moved[k * 45 : (k + 1) * 45])
        got = runs(spark, tmp_path, threshold=4, late="30 minutes")
    want = batch(spark, tmp_path, threshold=4)
    minute = timedelta(minutes=1)
    for ip, start, end, _ in want:
        assert any(g[0] == ip and start <= g[1] <= end - 10 * minute for g in got), (ip, start)
    for g in got:
        assert any(g[0] == ip and start <= g[1] <= end - 10 * minute for ip, start, end, _ in want), g
    assert len(want) > 10 and len(set(got)) == len(got) <= len(want) + 4


def test_one_run_gives_the_episodes(spark, tmp_path):
    rng = random.Random(5)
    store = spark.conf.get(alerts.STORE[0], None)
    write(tmp_path / "in", "a.log", [(rng.randrange(600), f"10.0.0.{rng.randrange(5)}") for _ in range(300)])
    for length, slide in (("10 minutes", "1 minute"), ("10 minutes", "4 minutes")):
        at = tmp_path / slide[0]
        at.mkdir()
        (at / "in").symlink_to(tmp_path / "in")
        assert runs(spark, at, threshold=4, length=length, slide=slide) == [(ip, s, n) for ip, s, _, n in batch(spark, tmp_path, threshold=4, length=length, slide=slide)] != []
    assert spark.conf.get(alerts.STORE[0], None) == store  # the session is as it was


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 3)), max_size=25), st.integers(1, 4), st.integers(1, 8), st.integers(1, 4))
@settings(max_examples=200, deadline=None)
def test_crossings(rows, slide, length, threshold):
    length = max(length, slide)
    _, crossings = alerts._processor(threshold, length, slide)
    counts = {}
    for at, n in rows:
        counts[at] = counts.get(at, 0) + n
    raised = set()
    found = crossings(counts, raised, -1000)
    n = {s: sum(k for at, k in counts.items() if s <= at < s + length) for s in range(-20 * slide, 80 * slide, slide)}
    over = {s for s, k in n.items() if k >= threshold}
    assert found == [(s, n[s]) for s in sorted(over) if s - slide not in over] and raised == over
    assert crossings(counts, raised, -1000) == []
