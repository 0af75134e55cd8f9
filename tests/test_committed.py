"""The committed store: reruns, writers that die or meet, readers at work, and a stream whose batch fails once."""

import pytest
from pyspark.sql import functions as F

from tabsplit.operators.committed import Overtaken, Store, Table
from tabsplit.streaming import debounce


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), {"items": Table("k long, v string", ("k",), 4), "users": Table("k long, u string, n long", ("k", "u"), 4)})


def items(spark, *rows):
    return spark.createDataFrame(list(rows), "k long, v string")


def held(df):
    return sorted(map(tuple, df.collect()))


def test_reruns_change_nothing(spark, store):
    assert held(store.read("items")) == [] and store.upsert({"items": items(spark)}) == 0
    assert store.upsert({"items": items(spark, (1, "a"), (2, None))}) == 1
    assert store.upsert({"items": items(spark, (1, "a"), (2, None))}) == 1
    assert store.upsert({"items": items(spark, (2, "b"), (3, "c"))}) == 2
    assert held(store.read("items")) == [(1, "a"), (2, "b"), (3, "c")] and store.versions() == [1, 2]


def test_only_buckets_with_a_change_are_rewritten(spark, store):
    store.upsert({"items": spark.range(100).select(F.col("id").alias("k"), F.lit("a").alias("v"))})
    before = store.version()["tables"]["items"]
    store.upsert({"items": items(spark, (5, "b"), (6, "a"))})
    after = store.version()["tables"]["items"]
    assert sum(before[b] != after[b] for b in before) == 1 and len(before) == 4
    assert store.read("items").where("v = 'b'").count() == 1 and store.read("items").count() == 100


def test_a_writer_that_dies_before_the_commit_changes_nothing(spark, store):
    store.upsert({"items": items(spark, (1, "a"))})
    store.stage(store.version(), {"items": items(spark, (1, "z"), (2, "z"))})
    assert held(store.read("items")) == [(1, "a")]
    store.upsert({"items": items(spark, (1, "z"))})
    assert held(store.read("items")) == [(1, "z")]
    store.clean(keep=1)
    assert held(store.read("items")) == [(1, "z")] and store.versions() == [2]


def test_readers_go_on_with_their_version(spark, store):
    store.upsert({"items": items(spark, (1, "a")), "users": spark.createDataFrame([(1, "u", 0)], "k long, u string, n long")})
    begun = store.snapshot()
    store.upsert({"items": items(spark, (1, "b")), "users": spark.createDataFrame([(1, "u", 1)], "k long, u string, n long")})
    assert (held(begun["items"]), held(begun["users"])) == ([(1, "a")], [(1, "u", 0)])
    assert [held(df) for df in store.snapshot().values()] == [[(1, "b")], [(1, "u", 1)]]


def test_of_two_writers_the_second_begins_again(spark, store, monkeypatch):
    store.upsert({"items": items(spark, (1, "a"))})
    base = store.version()
    staged = store.stage(base, {"items": items(spark, (1, "late"))})
    store.upsert({"items": items(spark, (1, "first"), (2, "first"))})
    with pytest.raises(Overtaken):
        store.commit(base, staged, {})
    plain, bases = store.version, [base]
    monkeypatch.setattr(store, "version", lambda *n: bases.pop() if bases else plain(*n))
    assert store.upsert({"items": items(spark, (1, "late"))}) == 3
    assert held(store.read("items")) == [(1, "late"), (2, "first")]


def test_a_batch_that_fails_once_leaves_the_same_store(spark, tmp_path):
    rows = [(k, f"2024-01-0{1 + k // 40} {k % 24:02d}:00:00", k % 3, "x", 1.0, f"p{k}") for k in range(120)] + [(999, "2024-03-01 00:00:00", 9, "x", 1.0, "end")]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for part in range(2):
        events.where((F.col("event_id") < 60) == (part == 0)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    plain = debounce.party_store(spark, f"{tmp_path}/plain")
    debounce.sync_store(spark, f"{tmp_path}/in", plain, f"{tmp_path}/checkpoint").awaitTermination(120)

    failing, calls = debounce.party_store(spark, f"{tmp_path}/failing"), []
    commit = failing.commit

    def once(base, staged, done):
        calls.append(1)
        found = commit(base, staged, done)
        if len(calls) == 2:
            raise OSError("the answer was lost, the version was made")
        return found

    failing.commit = once
    run = debounce.sync_store(spark, f"{tmp_path}/in", failing, f"{tmp_path}/again")
    with pytest.raises(Exception, match="answer was lost"):
        run.awaitTermination(120)
    debounce.sync_store(spark, f"{tmp_path}/in", failing, f"{tmp_path}/again").awaitTermination(120)
    assert held(failing.read("parties")) == held(plain.read("parties")) and held(plain.read("parties"))
    assert failing.version()["number"] == len(set(failing.versions())) == plain.version()["number"]


def test_a_stream_of_shuffled_and_late_changes_gives_the_batch_result(spark, tmp_path):
    """Changes come in eight files in an order of their own, at most 50 minutes late, and two that are far too late."""
    import random

    shuffled = random.Random(7)
    rows = []
    for party in range(6):
        minute = 0
        for revision in range(60):
            minute += shuffled.choice([1, 4, 12, 29, 30, 31, 95])
            rows.append((minute, party, 100 * revision + party))
    rows.sort(key=lambda r: r[0] + shuffled.uniform(0, 50))
    rows.append((10_000, 77, 99_000))
    told = [(revision, f"2024-01-{1 + minute // 1440:02d} {minute // 60 % 24:02d}:{minute % 60:02d}:00", party, "x", 1.0, f"p{revision}") for minute, party, revision in rows]
    make = lambda part: spark.createDataFrame(part, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for k in range(8):
        make(told[k * len(told) // 8 : (k + 1) * len(told) // 8]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    store = debounce.party_store(spark, f"{tmp_path}/store")
    debounce.sync_store(spark, f"{tmp_path}/in", store, f"{tmp_path}/checkpoint").awaitTermination(180)
    expected = debounce.settled_revisions(debounce.changes_of(make(told)), 1_800_000).where("party <> 77").groupBy("party").agg(F.max("revision").alias("revision"))
    assert held(store.read("parties").select("party", "revision")) == held(expected)
    # an older revision that comes when a later one is synced does not win
    make([(3, "2024-01-08 00:00:00", 0, "x", 1.0, "old"), (99_001, "2024-02-01 00:00:00", 78, "x", 1.0, "end")]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    debounce.sync_store(spark, f"{tmp_path}/in", store, f"{tmp_path}/checkpoint").awaitTermination(180)
    assert held(store.read("parties").where("party = 0").select("party", "revision")) == held(expected.where("party = 0"))
