"""The debounced change stream: of the changes of a party within a quiet gap only the latest revision is synced."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tabsplit.operators.committed import Store, Table
from tabsplit.shared import new_path

CHANGES = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def debounce_latest(changes: DataFrame, gap: str) -> DataFrame:
    """party, start and end of each burst, how many changes it holds, and its latest revision with payload.

    The same function serves batches and streams; a stream needs a watermark on ts.
    """
    burst = F.session_window("ts", gap)
    latest = F.max(F.struct("ts", "revision", "payload"))
    found = changes.groupBy("party", burst.alias("burst")).agg(F.count("*").alias("changes"), latest.alias("latest"))
    return found.select("party", F.col("burst.start").alias("start"), F.col("burst.end").alias("end"), "changes", F.col("latest.revision").alias("revision"), F.col("latest.payload").alias("payload"))


def changes_of(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("party"), F.col("event_id").alias("revision"), F.col("ts").cast("timestamp").alias("ts"), F.col("props").alias("payload"))


def sync_stream(spark: SparkSession, folder: str, store: str, checkpoint: str, gap: str = "30 minutes", late: str = "1 hour"):
    """Files of change events to a store of synced revisions: one appended Parquet batch a trigger, then it stops.

    Batches are keyed by their number, so a replayed one replaces itself; bursts still open at the end stay in the state.
    """
    events = spark.readStream.schema(CHANGES).parquet(folder)
    bursts = debounce_latest(changes_of(events).withWatermark("ts", late), gap)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")

    return bursts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def latest_state(synced: DataFrame) -> DataFrame:
    """The store's state: the highest revision of each party."""
    return synced.groupBy("party").agg(F.max_by("payload", "revision").alias("payload"), F.max("revision").alias("revision"))


def synced(spark: SparkSession, folder: str) -> DataFrame:
    """party and revision of the bursts that a run of the stream has synced; a second run over the same files adds nothing."""
    store, checkpoint = new_path(spark, "synced"), new_path(spark, "stream")
    for _ in range(2):
        sync_stream(spark, folder, store, checkpoint).awaitTermination()
    return spark.read.schema("party long, revision long, start timestamp, end timestamp, changes long, payload string, batch int").parquet(store).select("party", "revision")


def settled_revisions(changes: DataFrame, gap_ms: int) -> DataFrame:
    """party, revision and payload of the changes that are still a party's latest when the gap after them is over: no higher
    revision is of an earlier time than that. What the stream gives for changes of any order, as one batch."""
    after = Window.partitionBy("party").orderBy(F.desc("revision")).rowsBetween(Window.unboundedPreceding, -1)
    following = F.min(F.unix_millis("ts")).over(after)
    return changes.withColumn("_next", following).where(F.col("_next").isNull() | (F.col("_next") >= F.unix_millis("ts") + gap_ms)).select("party", "revision", "payload")


def settling(gap_ms: int):
    """The stateful form for one party: changes wait until the watermark is a gap past them, so that all that could overtake them
    is known; then the highest revision wins, and one that is lower than a decided one is dropped, however late it comes.

    The state holds the changes of the last gap and lateness, and the highest revision decided.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top, revisions, times, payloads = state.get if state.exists else (-(2**63), [], [], [])
        waiting = list(zip(times, revisions, payloads, strict=True))
        for frame in frames:
            waiting += zip(frame["ms"].tolist(), frame["revision"].tolist(), [None if x is None or x != x else x for x in frame["payload"]], strict=True)
        waiting.sort(key=lambda w: w[:2])
        now, won, decided = state.getCurrentWatermarkMs(), [], 0
        for at, (ms, revision, payload) in enumerate(waiting):
            if ms + gap_ms > now:
                break
            decided += 1
            overtaken = top > revision
            for later, other, _ in waiting[at + 1 :]:
                if later >= ms + gap_ms or overtaken:
                    break
                overtaken = other > revision
            top = max(top, revision)
            if not overtaken:
                won.append((key[0], revision, payload))
        waiting = waiting[decided:]
        state.update((top, [w[1] for w in waiting], [w[0] for w in waiting], [w[2] for w in waiting]))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] + gap_ms - 1, now + 1))
        yield pd.DataFrame(won, columns=["party", "revision", "payload"])

    return run


def settled_stream(changes: DataFrame, gap_ms: int, late: str) -> DataFrame:
    """settled_revisions of a stream of changes (party, revision, ts, payload) that come at most `late` after later ones."""
    waiting = changes.withWatermark("ts", late).select("party", "revision", "payload", F.unix_millis("ts").alias("ms"), "ts")
    return waiting.groupBy("party").applyInPandasWithState(
        settling(gap_ms), "party long, revision long, payload string", "top long, revisions array<long>, times array<long>, payloads array<string>", "append", GroupStateTimeout.EventTimeTimeout
    )


def party_store(spark: SparkSession, path: str) -> Store:
    """The store of what was synced last of each party."""
    return Store(spark, path, {"parties": Table("party long, revision long, payload string", ("party",))})


def sync_store(spark: SparkSession, folder: str, store: Store, checkpoint: str, gap_ms: int = 1_800_000, late: str = "1 hour", files: int = 1):
    """Files of change events to a committed store, `files` of them a batch, then it stops.

    A batch that failed is run again by the stream: if its version was made before the failure, the store skips it. Changes of a
    batch that can't be written stay in the stream's checkpoint, so nothing that was once settled is lost.
    """
    events = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files).parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("party").agg(F.max("revision").alias("revision"), F.max_by("payload", "revision").alias("payload")).persist()
        try:
            latest.count()  # once, and also where the store skips the batch: the stream's state is a part of it
            held = store.read("parties").select("party", F.col("revision").alias("_held"))
            newer = latest.join(held, "party", "left").where(F.col("_held").isNull() | (F.col("revision") > F.col("_held"))).drop("_held")
            store.upsert({"parties": newer}, checkpoint, number)
        finally:
            latest.unpersist()

    stream = settled_stream(changes_of(events), gap_ms, late)
    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def settled(spark: SparkSession, folder: str) -> DataFrame:
    """party, revision and payload of all that a run of the stream settles."""
    out, checkpoint = new_path(spark, "settled"), new_path(spark, "stream")
    stream = settled_stream(changes_of(spark.readStream.schema(CHANGES).parquet(folder)), 1_800_000, "1 hour")
    stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("party long, revision long, payload string").parquet(out)


def store_synced(spark: SparkSession, folder: str) -> DataFrame:
    """The store after the stream has run over all files, and once more over none."""
    store, checkpoint = party_store(spark, new_path(spark, "store")), new_path(spark, "stream")
    for _ in range(2):
        sync_store(spark, folder, store, checkpoint).awaitTermination()
    return store.read("parties")
