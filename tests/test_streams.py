"""Streams and tables that change: the same results for any layout of files, restarts, replays and failures."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from catalens.operators import log as L
from catalens.sources.keyed_table import BatchLog, KeyedTable
from catalens.sources.paged import PagedTable
from catalens.streaming import jobs, ordered
from catalens.streaming.digest import send_digest

START = datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Every partition of a stateful stream starts a worker a batch, which is most of a small stream's time."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def feed(spark, folder, rows, schema, n_files, per_trigger=1000):
    """Rows as a stream of ``n_files`` files, in the order given."""
    size = -(-len(rows) // n_files)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def layouts(spark, tmp_path, rows, schema):
    """The rows as one file, as many files in order of time with a batch each, and as shuffled files."""
    rows = sorted(rows, key=lambda r: r[-1])
    mixed = random.Random(1).sample(rows, len(rows))
    yield feed(spark, str(tmp_path / "one"), rows, schema, 1)
    yield feed(spark, str(tmp_path / "many"), rows, schema, 3, per_trigger=1)
    yield feed(spark, str(tmp_path / "mixed"), mixed, schema, 3, per_trigger=1)


def at(seconds):
    return START + timedelta(seconds=seconds)


def test_rate_limit_counts_the_edge(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, i * 10 + k, at(rng.randrange(0, 600))) for k in range(3) for i in range(15)] + [(9, 900, at(0)), (9, 901, at(60)), (9, 902, at(60)), (9, 903, at(121))]
    expected = set()
    for key in {r[0] for r in rows}:
        hits = []
        for _, event, t in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            hits = [h for h in hits if h >= t - timedelta(seconds=60)]
            expected.add((key, event, len(hits) < 2))
            if len(hits) < 2:
                hits.append(t)
    assert (9, 902, False) in expected
    for stream in layouts(spark, tmp_path, rows, "key long, event_id long, at timestamp"):
        got = jobs.drain(stream, lambda s: ordered.rate_limit(s, limit=2, seconds=60), late="1 hour")
        assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_lockout_by_event_time(spark, tmp_path):
    rows = [(1, 1, True, at(0)), (1, 2, True, at(10)), (1, 3, True, at(20)), (1, 4, False, at(30)), (1, 5, True, at(320)), (2, 6, True, at(0)), (2, 7, False, at(1)), (2, 8, True, at(2)), (2, 9, True, at(3)), (3, 10, True, at(0)), (3, 11, True, at(300)), (3, 12, True, at(301)), (3, 13, False, at(599))]
    for stream in layouts(spark, tmp_path, rows, "key long, event_id long, failed boolean, at timestamp"):
        got = jobs.drain(stream, lambda s: ordered.lockout(s, failures=3, seconds=300), late="1 hour").collect()
        assert {r["event_id"] for r in got if r["locked"]} == {4}
        assert len(got) == len(rows)


def test_state_goes_with_its_window(spark, tmp_path):
    rows = [(k, k, at(k)) for k in range(5)] + [(100, 100, at(10_000)), (101, 101, at(20_000))]
    stream = feed(spark, str(tmp_path / "in"), rows, "key long, event_id long, at timestamp", 7, per_trigger=1)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    made = ordered.rate_limit(stream.withColumn("closing", F.lit(False)).withWatermark("at", "10 seconds"), limit=2, seconds=60)
    query = made.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["event_id"] for r in spark.table("limited").collect()} == {0, 1, 2, 3, 4, 100}
    left = spark.read.format("statestore").option("path", str(tmp_path / "check")).option("stateVarName", "known").load()
    assert {r["key"]["key"] for r in left.collect()} <= {100}
    waiting = spark.read.format("statestore").option("path", str(tmp_path / "check")).option("stateVarName", "waiting").load()
    assert {r["key"]["key"] for r in waiting.collect()} == {101}


def test_first_of_each_within_the_delay(spark, tmp_path):
    rows = [("a", "p", 1, at(0)), ("a", "p", 2, at(59)), ("a", "p", 3, at(60)), ("a", "p", 4, at(100)), ("a", "q", 5, at(30)), ("b", "p", 6, at(30)), (None, None, 7, at(0)), (None, None, 8, at(5))]
    for stream in layouts(spark, tmp_path, rows, "action string, product_id string, event_id long, at timestamp"):
        got = jobs.drain(stream, lambda s: ordered.first_of_each(s, {"action": "string", "product_id": "string"}, 60), late="1 hour")
        assert sorted(r["event_id"] for r in got.collect()) == [1, 3, 5, 6, 7]


def test_a_late_copy_is_dropped_and_state_expires(spark, tmp_path):
    rows = [(1, at(0)), (2, at(100)), (1, at(0)), (3, at(5000)), (1, at(0)), (2, at(9000))]
    stream = feed(spark, str(tmp_path / "in"), rows, "event_id long, at timestamp", 6, per_trigger=1)
    got = jobs.drain(stream, lambda s: jobs.delivered_once(s, ["event_id"]), late="10 minutes").collect()
    # the second copy of 1 comes within the delay, the third too late for the watermark; 2 comes again long after
    assert sorted((r["event_id"], r["at"]) for r in got) == [(1, at(0)), (2, at(100)), (2, at(9000)), (3, at(5000))]


def test_sessions_of_shuffled_files(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, rng.choice("xy"), at(rng.randrange(0, 40_000))) for k in range(3) for _ in range(25)] + [(7, "x", at(0)), (7, "y", at(1799)), (7, "x", at(1799 + 1801))]
    expected = []
    for key in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == key)
        mine.sort(key=lambda r: r[2])
        groups = []
        for r in mine:
            if groups and r[2] - groups[-1][-1][2] < timedelta(minutes=30):
                groups[-1].append(r)
            else:
                groups.append([r])
        expected += [(key, g[0][2], g[-1][2] + timedelta(minutes=30), len(g), sum(r[1] == "x" for r in g), sum(r[1] == "y" for r in g)) for g in groups]
    for stream in layouts(spark, tmp_path, rows, "key long, kind string, at timestamp"):
        got = jobs.drain(stream, lambda s: jobs.sessions(s, "key", "kind", ["x", "y"]), late="1 day")
        assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_windows_come_out_for_any_layout(spark, tmp_path):
    rows = [("k" + str(i % 2), at(i * 700)) for i in range(30)]
    expected = {}
    for k, t in rows:
        start = t.replace(minute=0, second=0)
        expected[(start, k)] = expected.get((start, k), 0) + 1
    for stream in layouts(spark, tmp_path, rows, "kind string, at timestamp"):
        got = jobs.drain(stream, lambda s: jobs.windowed_counts(s, "kind"), late="1 day").collect()
        assert {(r["start"], r["kind"]): r["n"] for r in got} == expected


def test_price_drift_by_event_time(spark, tmp_path):
    rows = [("p", "s", 100, "USD", 1, 1, at(0)), ("p", "s", 110, "USD", 2, 1, at(86_400)), ("p", "t", 50, "USD", 3, 1, at(86_400)), ("p", "s", 120, "EUR", 4, 1, at(3 * 86_400)), ("p", "s", 130, "EUR", 5, 1, at(20 * 86_400))]
    for stream in layouts(spark, tmp_path, rows, "product_id string, source string, price_cents long, currency string, order_no long, line_no long, at timestamp"):
        got = jobs.drain(stream, lambda s: ordered.price_drift(s, days=10), late="30 days").collect()
        assert {(r["source"], r["price_cents"]): r["previous_cents"] for r in got} == {("s", 100): None, ("s", 110): 100, ("t", 50): None, ("s", 120): 110, ("s", 130): None}


def test_keys_share_buckets_of_state(spark, tmp_path, monkeypatch):
    """State is read and written a bucket at a time; keys of one bucket, nulls among them, don't touch each other's."""
    monkeypatch.setattr(ordered, "BUCKETS", 2)
    rng = random.Random(8)
    rows = [(rng.choice([None, "a", "b", "c", "d"]), rng.choice([None, "s", "t"]), rng.randrange(1, 2**60), "USD", i, 1, at(rng.randrange(0, 40 * 86_400))) for i in range(120)]
    expected, last = [], {}
    for product, source, cents, currency, order_no, line_no, t in sorted(rows, key=lambda r: (r[-1], r[4])):
        old = last.get((product, source))
        near = old is not None and t - old[1] <= timedelta(days=5)
        expected.append((product, source, cents, old[0] if near else None))
        last[product, source] = (cents, t)
    for stream in layouts(spark, tmp_path, rows, "product_id string, source string, price_cents long, currency string, order_no long, line_no long, at timestamp"):
        got = jobs.drain(stream, lambda s: ordered.price_drift(s, days=5), late="60 days").collect()
        assert sorted(((r["product_id"], r["source"], r["price_cents"], r["previous_cents"]) for r in got), key=repr) == sorted(expected, key=repr)
    made = ordered.rate_limit(feed(spark, str(tmp_path / "in"), [(k, k, at(k)) for k in range(40)], "key long, event_id long, at timestamp", 1).withColumn("closing", F.lit(False)).withWatermark("at", "1 day"))
    query = made.writeStream.format("memory").queryName("bucketed").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    waiting = spark.read.format("statestore").option("path", str(tmp_path / "check")).option("stateVarName", "waiting").load()
    assert {r["key"]["key"] for r in waiting.collect()} == {0, 1}


# ---- pages -------------------------------------------------------------------------------------


def test_a_task_takes_many_pages_and_every_row_once(tmp_path, monkeypatch):
    """Before, each page was a task that read its whole row group."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from catalens.sources import paged

    pq.write_table(pa.table({"n": list(range(200_000))}), tmp_path / "a.parquet", row_group_size=150_000)
    pq.write_table(pa.table({"n": list(range(200_000, 200_950))}), tmp_path / "b.parquet")
    schema = PagedTable({"path": str(tmp_path)}).schema()
    reader = paged.PagedReader(str(tmp_path), 100, schema)
    for start in (0, 130_050):
        tasks = reader.partitions({"rows": start}, reader.latestOffset())
        assert len(tasks) == 2
        got = [row for task in tasks for batch in reader.read(task) for row in zip(*(c.to_pylist() for c in batch.columns))]
        assert got == [(n, n // 100) for n in range(start, 200_950)]


def test_pages_go_on_after_the_last_committed_row(spark, tmp_path):
    folder, seen = str(tmp_path / "part"), []
    spark.dataSource.register(PagedTable)
    spark.range(0, 350).coalesce(1).write.parquet(folder)

    def run():
        pages = spark.readStream.format("paged_table").option("size", 100).load(folder)
        jobs.each_batch(pages, lambda batch, n: seen.append([(r["page"], r["id"]) for r in batch.collect()]), str(tmp_path / "check"))

    run()
    assert sorted(sum(seen, [])) == [(i // 100, i) for i in range(350)]
    seen.clear()
    run()
    assert sum(seen, []) == []  # nothing new
    spark.range(350, 520).coalesce(1).write.mode("append").option("compression", "snappy").parquet(str(tmp_path / "more"))
    (source,) = (tmp_path / "more").glob("*.parquet")
    source.rename(tmp_path / "part" / "z.parquet")  # files are taken in order of name
    run()
    assert sorted(sum(seen, [])) == [(i // 100, i) for i in range(350, 520)]


# ---- tables that change ------------------------------------------------------------------------


def files_of(folder):
    return {str(f): f.stat().st_mtime_ns for f in folder.rglob("*.parquet")}


def test_changes_rewrite_only_their_folders(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", "k long, v string, at long", ["k"], n_buckets=16)
    table.upsert(spark.createDataFrame([(i, "old", 1) for i in range(200)], "k long, v string, at long"))
    before = files_of(tmp_path / "t")
    new = spark.createDataFrame([(3, "new", 2), (3000, "more", 2)], "k long, v string, at long")
    touched = table.upsert(new, version="at")
    after = files_of(tmp_path / "t")
    changed = {f for f in before.keys() | after.keys() if before.get(f) != after.get(f)}
    assert changed and all(any(f"bucket={b}/" in f for b in touched) for f in changed)
    assert len(touched) <= 2
    table.upsert(spark.createDataFrame([(3, "stale", 1)], "k long, v string, at long"), version="at")
    table.update(spark.createDataFrame([(4,)], "k long"), {"v": F.lit("set")})
    table.upsert(new, version="at")  # again
    rows = {r["k"]: r["v"] for r in table.read().collect()}
    assert len(rows) == 201 and rows[3] == "new" and rows[3000] == "more" and rows[4] == "set" and rows[5] == "old"


def test_delete_empties_folders(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", "k long, v string", ["k"], bucket=(F.col("k") / 10).cast("int"))
    table.insert(spark.createDataFrame([(i, "x") for i in range(50)], "k long, v string"))
    before = files_of(tmp_path / "t")
    assert table.delete(F.col("k") < 25, F.col("bucket") <= 2) == [0, 1, 2]
    assert sorted(r["k"] for r in table.read().collect()) == list(range(25, 50))
    after = files_of(tmp_path / "t")
    assert {f: t for f, t in before.items() if "bucket=3/" in f or "bucket=4/" in f}.items() <= after.items()
    assert table.delete(F.col("k") < 25) == []


def test_a_large_folder_is_written_by_several_tasks(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", "k long, v string", ["k"], n_buckets=2)
    parts = lambda: [len(list(folder.glob("part-*.parquet"))) for folder in sorted((tmp_path / "t").glob("bucket=*"))]
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        table.insert(spark.range(0, 20000, 1, 8).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")))
        assert len(parts()) == 2 and min(parts()) > 1
        table.update(spark.range(0, 20000, 2, 4).select(F.col("id").alias("k")), {"v": F.lit("set")})
        assert len(parts()) == 2
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    got = table.read().selectExpr("count(*)", "count(DISTINCT k)", "count_if(v = 'set')", "count_if(v = sha2(string(k), 256))").first()
    assert tuple(got) == (20000, 20000, 10000, 10000)


def test_a_failed_change_leaves_the_old_rows(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", "k long, v string", ["k"], n_buckets=2)
    table.upsert(spark.createDataFrame([(i, "old") for i in range(20)], "k long, v string"))
    bad = spark.range(20).select(F.col("id").alias("k"), F.when(F.col("id") == 13, F.raise_error(F.lit("no")).cast("string")).otherwise("new").alias("v"))
    with pytest.raises(Exception):
        table._rewrite([0, 1], lambda old: bad)
    assert {r["v"] for r in table.read().collect()} == {"old"} and table.read().count() == 20


def test_a_batch_written_again_replaces_itself(spark, tmp_path):
    log = BatchLog(spark, f"file://{tmp_path}/log", "id long")
    assert log.read().count() == 0 and not log.has(0)
    for batch in (0, 1, 0):
        log.append(spark.range(batch * 10, batch * 10 + 3), batch)
    assert sorted(r["id"] for r in log.read().collect()) == [0, 1, 2, 10, 11, 12] and log.has(1)


# ---- digest ------------------------------------------------------------------------------------

LOG_SCHEMA = "id long, action string, product_id string, detail string, created_at timestamp, notified boolean"


def test_digest_has_total_counts_and_the_last_lines(spark):
    rows = [(i, "ab"[i % 2], str(i), f"d{i}", at(i), None) for i in range(300)] + [(300, "c", None, None, at(0), False)]
    (r,) = L.digest(spark.createDataFrame(rows, LOG_SCHEMA).repartition(5)).collect()
    lines = r["body"].split("\n")
    assert r["total"] == 301 and lines[2] == "Total actions: 301"
    assert lines[5:8] == ["  - a: 150", "  - b: 150", "  - c: 1"]
    assert lines[10:] == [f"  - [2024-01-01 00:0{i // 60}] {'ab'[i % 2]} product={i} :: d{i}" for i in range(101, 300)] + ["  - [2024-01-01 00:00] c product=None :: None"]
    assert L.digest(spark.createDataFrame([], LOG_SCHEMA)).collect() == []


def test_digest_is_sent_once(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, f"file://{tmp_path}/log", LOG_SCHEMA, ["id"], n_buckets=4)
    table.insert(spark.createDataFrame([(i, "a", "p", "d", at(i * 3600), i % 5 == 0) for i in range(48)], LOG_SCHEMA))
    now = str(at(47 * 3600))
    with monkeypatch.context() as m:  # the marking fails after the message was written
        m.setattr(KeyedTable, "update", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            send_digest(table, f"file://{tmp_path}/out", 0, now)
    table.upsert(spark.createDataFrame([(99, "late", "p", "d", at(46 * 3600), False)], LOG_SCHEMA))
    (first,) = send_digest(table, f"file://{tmp_path}/out", 0, now).collect()
    assert first["total"] == sum(i % 5 != 0 for i in range(23, 48))
    (second,) = send_digest(table, f"file://{tmp_path}/out", 1, now).collect()
    assert second["total"] == 1 and "late: 1" in second["body"]
    assert send_digest(table, f"file://{tmp_path}/out", 2, now).collect() == []
