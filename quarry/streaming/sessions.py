"""Chat sessions as keyed state: a state row for each message, forgotten when it is cleared or runs out.

The messages are a list state, so a batch writes only those that it brings. Each has a time to live of its own, and a timer
forgets the whole session where nothing came for that long. What a session holds is read from the checkpoint by Spark's state source, a
row a message; the stream itself says what happened.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

TTL_SECONDS = 86_400
#: The role of a message that forgets all turns up to its own.
CLEAR = "clear"
MESSAGE = "turn long, role string, text string"
CHANGE = "session_id long, kind string, turn long, messages long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Sessions(StatefulProcessor):
    """kind is `added` or `cleared`, with the last turn and the messages that are there then, or `expired`."""

    def __init__(self, ttl: float = TTL_SECONDS):
        self.ttl_ms = int(ttl * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.messages = handle.getListState("messages", MESSAGE, self.ttl_ms)
        #: How many messages there are, and the last turn that was cleared.
        self.head = handle.getValueState("head", "held long, cleared long")

    def handleInputRows(self, key, rows, timerValues):
        held, cleared = self.head.get() if self.head.exists() else (0, None)
        last, kind, most = None, "added", None
        for frame in rows:
            cuts = frame.loc[frame["role"] == CLEAR, "turn"]
            if len(cuts):
                kind = "cleared"
                cut = int(cuts.max())
                most = cut if most is None else max(most, cut)
            fresh = frame[frame["role"] != CLEAR].sort_values(["turn", "role", "text"])
            if cleared is not None:
                fresh = fresh[fresh["turn"] > cleared]
            if len(fresh):
                self.messages.appendList([(int(t), r, x) for t, r, x in zip(fresh["turn"], fresh["role"], fresh["text"], strict=True)])
                held += len(fresh)
                last = max(last or 0, int(fresh["turn"].max()))
        if most is not None and (cleared is None or most > cleared):
            cleared = most
            later = [m for m in self.messages.get() if m[0] > cleared]
            self.messages.clear()
            if later:
                self.messages.put(later)
            held = len(later)
        self.head.update((held, cleared))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms)
        yield pd.DataFrame({"session_id": [key[0]], "kind": [kind], "turn": [last if last is not None else cleared], "messages": [held]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.head.get()[0] if self.head.exists() else 0
        self.messages.clear()
        self.head.clear()
        yield pd.DataFrame({"session_id": [key[0]], "kind": ["expired"], "turn": [None], "messages": [held]}).astype({"turn": "Int64"})

    def close(self) -> None:
        pass


def changes(messages: DataFrame, ttl: float = TTL_SECONDS) -> DataFrame:
    """A stream of messages (session_id, turn, role, text) as a stream of what happens to the sessions (CHANGE).

    Messages may come in any order and in any number of batches. A null turn, role or text is 0 or empty; a message without
    a session goes. A message up to the last cleared turn goes, also where it comes late.
    """
    whole = messages.where("session_id is not null").select(
        F.col("session_id").cast("long").alias("session_id"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    )
    return whole.groupBy("session_id").transformWithStateInPandas(Sessions(ttl), CHANGE, "Update", "ProcessingTime")


def start(messages: DataFrame, checkpoint: str, sink: str, *, ttl: float = TTL_SECONDS, once: bool = True):
    """Run the stream; each batch's changes are a folder of their own below `sink`, so that one that is repeated replaces itself."""
    # A stream keeps the settings that it begins with. With timers of processing time there is always one more batch without
    # data; one that is to stop has none.
    own = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false" if once else "true"}
    conf = messages.sparkSession.conf
    before = {k: conf.get(k, None) for k in own}
    for k, v in own.items():
        conf.set(k, v)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = changes(messages, ttl).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    try:
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def held(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(session_id, turn, role, text): the messages that the sessions hold after the last batch, read from the state itself."""
    rows = spark.read.format("statestore").option("stateVarName", "messages").option("flattenCollectionTypes", "true").load(checkpoint)
    return rows.select(F.col("key.session_id").alias("session_id"), *(F.col(f"list_element.value.{c}" if "value" in rows.schema["list_element"].dataType.fieldNames() else f"list_element.{c}").alias(c) for c in ("turn", "role", "text")))
