"""Stateful streams whose rows take effect in event-time order: alert lifecycle, failures since the last success."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidewright.sources.scratch import shared_folder

DAY = 86_400_000_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Keeps each key's rows until the watermark has passed them, then applies them by time: the result is the same in
    whatever order and in however many batches they came. `fields` are the columns kept of a row, the first its time in
    microseconds; `memory` is the schema of what is remembered of a key."""

    fields: str
    memory: str

    def init(self, handle) -> None:
        self.handle = handle
        self.names = [f.split()[0] for f in self.fields.split(", ")]
        self.waiting = handle.getListState("waiting", self.fields)
        self.known = handle.getValueState("known", self.memory)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803  (names that Spark calls)
        own = [tuple(r[c] for c in self.names) for r in rows]
        self.waiting.appendList(own)
        self.handle.registerTimer(max(r[0] for r in own) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        rows = [tuple(r) for r in self.waiting.get()]
        due = sorted((r for r in rows if r[0] // 1000 <= until), key=lambda r: tuple((x is not None, x) for x in r))
        rest = [r for r in rows if r[0] // 1000 > until]
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
        known, out = self.apply(key, tuple(self.known.get()) if self.known.exists() else None, due, until)
        if known is not None:
            self.known.update(known)
        yield from out

    def apply(self, key, known: tuple | None, rows: list[tuple], until: int) -> tuple[tuple | None, list[Row]]:
        """What is remembered after these rows, all of them up to `until` (milliseconds), and what they give out."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class AlertLifecycle(InOrder):
    """One alert a key. `holds` opens it, reopens a resolved one; `gone` resolves an open one; `acknowledged` closes an
    open one for good. An open alert of severity critical or high is escalated once, `days` after it was first opened:
    by a timer, or as soon as it is open again if that was earlier. Rows of one moment count before an escalation."""

    fields = "us long, seq long, action string, severity string"
    memory = "state string, created long, severity string, escalated boolean"
    gives = "dedupe_key string, at timestamp, transition string, severity string"

    def __init__(self, days: int):
        self.wait = days * DAY

    def apply(self, key, known, rows, until):
        state, created, severity, escalated = known or ("none", 0, None, False)
        out = []

        def gave(us: int, transition: str) -> None:
            out.append((key[0], us, transition, severity))

        def late(us: int) -> bool:
            return state == "open" and not escalated and severity in ("critical", "high") and created + self.wait <= us

        for us, own in groupby(rows, key=lambda r: r[0]):
            if late(us - 1):
                gave(created + self.wait, "escalated")
                escalated = True
            for _, _, action, how in own:
                if action == "holds" and state == "none":
                    state, created, severity = "open", us, how
                    gave(us, "opened")
                elif action == "holds" and state == "auto_resolved":
                    state = "open"
                    gave(us, "reopened")
                elif state == "open" and action in ("gone", "acknowledged"):
                    state = "auto_resolved" if action == "gone" else "acknowledged"
                    gave(us, state)
            if late(us):
                gave(us, "escalated")
                escalated = True
        if late(until * 1000):
            gave(created + self.wait, "escalated")
            escalated = True
        if state == "open" and not escalated and severity in ("critical", "high"):
            self.handle.registerTimer(-(-(created + self.wait) // 1000))
        made = [Row(dedupe_key=k, at=_moment(us), transition=t, severity=s) for k, us, t, s in out]
        return (None if state == "none" else (state, created, severity, escalated)), made


class FailuresSince(InOrder):
    """At each failure, how many the key has had in the last `width` microseconds and since its last success. Only
    failures that may still count are remembered."""

    fields = "us long, event_id long, failed boolean"
    memory = "failures array<long>"

    def __init__(self, width: int):
        self.width = width

    def apply(self, key, known, rows, until):
        held, out = list(known[0]) if known else [], []
        for us, own in groupby(rows, key=lambda r: r[0]):
            own = list(own)
            if not all(r[2] for r in own):  # a success of the same moment comes first
                held = []
            failures = [r[1] for r in own if r[2]]
            held = [t for t in held if t >= us - self.width] + [us] * len(failures)
            out += [Row(key=key[0], event_id=e, failures=len(held)) for e in failures]
        return (held,), out


def _moment(us: int):
    import datetime as dt

    return dt.datetime.fromtimestamp(us // 1_000_000, dt.UTC).replace(microsecond=us % 1_000_000)


def _to_table(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """What a stream gives out until its input ends, as a table in the shared folder; state is kept beside it."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        run = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def alert_transitions(changes: DataFrame, days: int = 3, late: str = "0 seconds") -> DataFrame:
    """Transitions (dedupe_key, at, transition, severity) of a stream of changes (dedupe_key, at, seq, action, severity).

    Rows of one moment count by seq. Rows may come in any order within `late`; later ones go with the watermark. Rows
    without a key or a time are dropped. State is as large as the alerts that exist, not as the rows seen.
    """
    timed = changes.where("dedupe_key is not null and at is not null").withColumn("us", F.unix_micros("at")).withWatermark("at", late)
    return timed.groupBy("dedupe_key").transformWithState(AlertLifecycle(days), AlertLifecycle.gives, "append", "eventTime")


def failures_since_success(events: DataFrame, key: str, event_id: str, at: str, failed: Column, succeeded: Column, minutes: int, late: str = "0 seconds") -> DataFrame:
    """(key, event_id, failures) at each failure of a stream: those of the last `minutes`, since the last success."""
    rows = events.where(failed | succeeded).select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("at"), F.col(event_id).cast("long").alias("event_id"), failed.alias("failed"))
    timed = rows.where("key is not null and at is not null").withColumn("us", F.unix_micros("at")).withWatermark("at", late)
    schema = f"key {rows.schema['key'].dataType.simpleString()}, event_id long, failures long"
    return timed.groupBy("key").transformWithState(FailuresSince(minutes * 60_000_000), schema, "append", "eventTime")


def to_table(spark: SparkSession, path: str, of) -> DataFrame:
    """`of(stream)` over the files at `path` (a pattern) as a stream that ends with its input, as a table."""
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 64).parquet(path)
    return _to_table(spark, of(source))
