"""Keyed state with timers and maps: evidence that expires, and watched files (K3, K5).

Both keep their state in the RocksDB provider, which ``use_rocksdb`` sets on the session: state lives on disk with
changelogs in the checkpoint, so it may outgrow memory and survives lost executors.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that map state and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Evidence(StatefulProcessor):
    """The latest evidence of one (kind, key), and a timer at the moment it expires."""

    def __init__(self, event_time: bool, keep_ms: int | None):
        self.event_time, self.keep_ms = event_time, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts_us long, ttl double, state string, told long", None if self.event_time else self.keep_ms)

    def _now(self, timers) -> int:
        return timers.getCurrentWatermarkInMs() if self.event_time else timers.getCurrentProcessingTimeInMs()

    @staticmethod
    def _expires(ts_us: int, ttl: float) -> int:
        """The first millisecond at which evidence is too old, by whole seconds."""
        return (int(ts_us // 1_000_000 + ttl) + 1) * 1000

    def _row(self, key, state: str, expired: bool, now: int, nth: int) -> Row:
        kind, name = key
        status = "FRESH" if not expired else "RECHECK_REQUIRED" if kind == "anchor" else "STALE"
        return Row(kind=kind, key=name, state=state, status=status, at_ms=now, nth=nth)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = self.last.get() if self.last.exists() else None
        best = old
        for r in rows:
            if best is None or (r.ts_us, r.state) > (best[0], best[2]):
                best = (r.ts_us, r.ttl, r.state, 0)
        if old is not None and best[:3] == tuple(old)[:3]:
            return
        if old is not None:
            self.handle.deleteTimer(self._expires(old[0], old[1]))
        nth = 1 if old is None else old[3] + 1
        self.last.update((best[0], best[1], best[2], nth))
        now, expires = self._now(timerValues), self._expires(best[0], best[1])
        if expires > now:
            self.handle.registerTimer(expires)
        yield self._row(key, best[2], expires <= now, now, nth)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.last.exists():
            ts_us, ttl, state, nth = self.last.get()
            if self._expires(ts_us, ttl) <= expiredTimerInfo.getExpiryTimeInMs():
                self.last.update((ts_us, ttl, state, nth + 1))
                yield self._row(key, state, True, self._now(timerValues), nth + 1)

    def close(self) -> None:
        pass


def evidence_stream(events: DataFrame, event_time: bool = False, delay: str = "0 seconds", keep_ms: int | None = None) -> DataFrame:
    """K5 as a stream: (kind, key, state, status, at_ms, nth) whenever the latest evidence(kind, key, ts, ttl seconds, state) of a key changes or, with no new input, expires.

    ``event_time`` lets time pass with the watermark, ``delay`` behind the newest ``ts``; otherwise it is the clock, and
    ``keep_ms`` drops keys that have had no new evidence for so long. The row of a key with the highest ``nth`` is what
    ``evidence_status`` gives at that time; null states count as empty.
    """
    use_rocksdb(events.sparkSession)
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", delay) if event_time else rows
    rows = rows.select("kind", "key", "ts", F.unix_micros("ts").alias("ts_us"), F.col("ttl").cast("double").alias("ttl"), F.coalesce("state", F.lit("")).alias("state"))
    mode = "EventTime" if event_time else "ProcessingTime"
    return rows.groupBy("kind", "key").transformWithState(Evidence(event_time, keep_ms), "kind string, key string, state string, status string, at_ms long, nth long", "Append", mode)


class Watch(StatefulProcessor):
    """The files of one item as a map: path to hash and time stamp, read and written one path at a time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.files = handle.getMapState("files", "path string", "sha256 string, mtime_ns long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: r.seq):
            known = self.files.getValue((r.path,)) if self.files.containsKey((r.path,)) else None
            if r.sha256 is None:
                if known is not None:
                    self.files.removeKey((r.path,))
                    yield Row(item=key[0], path=r.path, change="removed")
                continue
            if known is not None and known[1] == r.mtime_ns and r.mtime_ns <= r.now_ns:
                continue
            if known is None or known[0] != r.sha256:
                yield Row(item=key[0], path=r.path, change="new" if known is None else "changed")
            self.files.updateValue((r.path,), (r.sha256, r.mtime_ns))

    def close(self) -> None:
        pass


def watch_changes(stream: DataFrame) -> DataFrame:
    """K3: changes of watched files(item, path, sha256 or null when gone, mtime_ns, now_ns, seq).

    A row whose time stamp is known and not in the future is not compared. Rows of an item in one micro-batch are taken by
    ``seq``, so a task holds an item's new rows of one batch, not its files. A null path is ignored.
    """
    use_rocksdb(stream.sparkSession)
    rows = stream.where("path is not null").select("item", "path", "sha256", "mtime_ns", "now_ns", "seq")
    return rows.groupBy("item").transformWithState(Watch(), "item string, path string, change string", "Append", "None")
