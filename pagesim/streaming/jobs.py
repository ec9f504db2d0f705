"""Checks and feedback as streams."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators.feedback import ANSWERS
from ..sources.writers import current_signatures


def detect_stream(checks: DataFrame, detect_batch: Callable[[DataFrame], DataFrame], out: str,
                  checkpoint: str, **trigger) -> StreamingQuery:
    """Run the batch detection on every micro-batch.

    A batch writes its own folder and replaces it when it is replayed, so a restart neither
    loses nor repeats detections. ``detect_batch`` is called anew each time, and whatever it
    reads (see ``with_current_feed``) is as fresh as that batch."""
    def run(batch: DataFrame, batch_id: int) -> None:
        detect_batch(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (checks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def with_current_feed(root: str, detect_with: Callable[[DataFrame, DataFrame], DataFrame]):
    """A batch function that looks up against the newest published signatures."""
    return lambda batch: detect_with(batch, current_signatures(batch.sparkSession, root))


class _KeepOnePerLifetime(StatefulProcessor):
    """State of one url: the times of kept checks that can still answer another."""

    def __init__(self, columns: list[str], life: int):
        self.columns, self.life = columns, life

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "us long")

    def _unanswered(self, times: np.ndarray, kept: list[int]) -> np.ndarray:
        """Which times no kept check answers."""
        if not kept:
            return np.ones(len(times), bool)
        starts = np.array(kept)
        before = np.searchsorted(starts, times, "right") - 1
        return (before < 0) | (times >= starts[before] + self.life)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = sorted(us for (us,) in self.kept.get())
        timed = kept[0] if kept else None  # the state's one timer is set for the end of its first lifetime
        # no check before the watermark will come, so one from the first that is open to there answers the rest
        sure = timerValues.getCurrentWatermarkInMs() * 1000 + self.life
        held = None
        for frame in rows:
            frame = frame.set_axis([*self.columns, "_us"], axis=1)  # names with a leading underscore do not arrive
            frame = frame[self._unanswered(frame["_us"].to_numpy(), kept)]
            held = frame if held is None else pd.concat([held, frame])
            held = held.drop_duplicates("_us")
            if len(held):
                first = held["_us"].min()
                held = held[(held["_us"] <= first) | (held["_us"] >= sure)]
        if held is None or not len(held):
            return
        held = held.sort_values("_us", kind="stable")
        chosen, before = [], len(kept)
        for position, moment in enumerate(held["_us"].tolist()):
            at = bisect.bisect_right(kept, moment)
            if at and moment < kept[at - 1] + self.life:
                continue
            chosen.append(position)
            kept.insert(at, moment)
        if len(kept) > before:
            self.kept.put([(us,) for us in kept])
            if kept[0] != timed:
                self._time(kept[0])
        yield held.iloc[chosen][self.columns]

    def _time(self, us: int) -> None:
        self.handle.registerTimer((us + self.life) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The watermark has passed the end of a lifetime: nothing that comes is answered by it, nor by any other whose
        end it has passed. What is left gets the next timer, so a url has one at a time however many checks it keeps."""
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        kept = sorted(us for (us,) in self.kept.get())
        live = [us for us in kept if (us + self.life) // 1000 + 1 > now]
        if len(live) < len(kept):  # else the timer of a check before which a late one was kept
            self.kept.put([(us,) for us in live]) if live else self.kept.clear()
            if live:
                self._time(live[0])
        return iter([])

    def close(self) -> None:
        pass


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def dedupe_checks(checks: DataFrame, ttl_seconds: int = 3600, ts: str = "ts",
                  late: str = "1 hour") -> DataFrame:
    """R2: keep a check unless its url (and flag) was kept less than ``ttl_seconds`` before it.

    The built-in watermark deduplication drops repeats for up to twice its delay; here a kept check answers for
    exactly its lifetime of event time, then the next one is kept. State is the times of the kept checks of a url;
    a timer at the end of the first lifetime clears what has ended and moves on to the next. A check that comes late, up to ``late``, is kept if no kept
    check answers it, also when a later one was kept already. Within a micro-batch the checks of a url are taken
    in time order; frames are thinned as they arrive, and the trigger's rate limit bounds the rest. Needs the
    RocksDB state store, which is set for the session."""
    if "skip_signature" not in checks.columns:
        checks = checks.withColumn("skip_signature", F.lit(False))
    checks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = checks.withColumn("_us", F.unix_micros(ts)).withWatermark(ts, late)
    return timed.groupBy("url", "skip_signature").transformWithStateInPandas(
        _KeepOnePerLifetime(checks.columns, ttl_seconds * 1_000_000), checks.schema, "append", "eventTime")


def feedback_stream(feedback: DataFrame, detections: DataFrame, within: str = "1 hour",
                    late: str = "1 hour", rejected: bool = False) -> DataFrame:
    """Feedback joined to the detection it names, if it came ``within`` that time after.

    ``feedback(id, correct, ts)``, ``detections(detection_id, url, verdict, detected_at)``. Both
    sides are watermarked and the time bound lets old detections leave the state.

    With ``rejected`` every entry gets exactly one answer, in ``status``: 200 with its detection, 400 at once for
    an answer that is no yes or no, and 404 when the watermark has passed the entry and no detection was found
    that it could name. The watermark moves with entries and detections that have an id; where neither may come for
    long, a heartbeat of each with an id of its own lets the last entries be answered. Rows without id get none."""
    known = detections.withWatermark("detected_at", late)
    bound = F.expr(f"id = detection_id AND ts >= detected_at AND ts <= detected_at + INTERVAL {within}")
    answer = F.lower("correct")
    columns = ["id", "url", "verdict", answer.alias("user_feedback"), F.col("ts").alias("timestamp"),
               F.col("detected_at").alias("detection_timestamp")]
    valid = F.coalesce(answer.isin(ANSWERS), F.lit(False))
    entries = feedback.filter(valid).withWatermark("ts", late)
    if not rejected:
        return entries.join(known, bound).select(*columns)
    joined = entries.join(known, bound, "left_outer").where(F.col("id").isNotNull()).select(
        *columns, "correct", F.when(F.col("detection_id").isNull(), 404).otherwise(200).alias("status"))
    types = {f.name: f.dataType for f in joined.schema.fields}
    bad = feedback.filter(~valid & F.col("id").isNotNull()).select(
        "id", F.lit(None).cast(types["url"]).alias("url"), F.lit(None).cast(types["verdict"]).alias("verdict"),
        answer.alias("user_feedback"), F.col("ts").alias("timestamp"),
        F.lit(None).cast(types["detection_timestamp"]).alias("detection_timestamp"), "correct", F.lit(400).alias("status"))
    return joined.unionByName(bad)


def metrics_stream(detections: DataFrame) -> DataFrame:
    """Running counts per source; run in update or complete mode."""
    return detections.groupBy("source").agg(F.count("*").alias("detections"))
