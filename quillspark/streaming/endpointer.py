"""Endpointing of live streams: stateful operators over chunks (stream, seq, ts, energy).

endpoints() is for a source that keeps each stream's order: a stream's state is a few numbers, a
micro-batch's chunks are taken in order of seq, and one that comes after a later chunk's batch is left out.
endpoints_in_order() is for one that does not: chunks wait in a keyed buffer until the watermark has
passed their time, and are then taken in order, so that any order of arrival inside the watermark gives the
same utterances; what comes later still is counted.

A finished utterance is emitted and the state begins anew. Where
`idle` is set, a processing-time timer ends the recording of a stream that sends nothing for so many
seconds: what had begun is emitted, and the stream's state goes. A query with timers never runs out of
batches, so a replay that should end by itself (availableNow) goes without.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, fields, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.endpoint import FIXED, HELD, Rules, Tracker

OUTPUT = "stream string, start long, complete long"
_STATE = ", ".join(f"{f.name} {'double' if f.type == 'float' else 'long'}" for f in fields(Tracker))


class Endpointer(StatefulProcessor):
    """Utterances under some rules; see operators.endpoint."""

    def __init__(self, rules: Rules = FIXED, idle: float | None = None) -> None:
        self.rules, self.idle = rules, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", _STATE)

    def close(self) -> None:
        pass

    def _tracker(self) -> Tracker:
        return Tracker(*self.state.get()) if self.state.exists() else Tracker()

    @staticmethod
    def _out(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["stream", "start", "complete"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("seq")
        tracker, out = self._tracker(), []
        for seq, energy in zip(pdf["seq"], pdf["energy"]):
            if got := tracker.step(int(seq), energy, self.rules):
                out.append((key[0], *got))
        self.state.update(astuple(tracker))
        if self.idle is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.idle * 1000))
        yield self._out(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        got = self._tracker().end()
        self.state.clear()
        yield self._out([(key[0], *got)] if got else [])


class FixedEndpointer(Endpointer):
    """Voiced is energy above a threshold."""

    def __init__(self, threshold: float = 20.0, shortest: int = 5, silence: int = 10, most: int = 2400, idle: float | None = None) -> None:
        super().__init__(replace(FIXED, threshold=threshold, shortest=shortest, silence=silence, most=most), idle)


class AdaptiveEndpointer(Endpointer):
    """Voiced is a smoothed level well above a tracked background, which the first chunks give. rules:
    operators.endpoint.HELD, RUN, or others."""

    def __init__(self, rules: Rules = HELD, idle: float | None = None, **changes) -> None:
        super().__init__(replace(rules, **changes), idle)


#: late: chunks that came too late, or again, in rows without an utterance.
IN_ORDER = "stream string, start long, complete long, late long"


class Reordered(StatefulProcessor):
    """Utterances under some rules, of chunks that wait in order of seq until the watermark has passed their time.

    Waiting chunks are a map from seq to time and energy. A chunk is let go when the watermark has
    reached its time and no earlier one still waits, by an event-time timer for the first of them. One
    whose seq was already reached is late, whether it comes too late or for a second time. idle: seconds of
    event time after a stream's last chunk at which its recording ends.
    """

    def __init__(self, rules: Rules = FIXED, idle: float | None = None) -> None:
        self.rules, self.idle = rules, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", f"{_STATE}, at long")
        self.waiting = handle.getMapState("waiting", "seq long", "at long, energy double")

    def close(self) -> None:
        pass

    def _held(self) -> tuple[Tracker, int]:
        if not self.state.exists():
            return Tracker(), 0
        *numbers, at = self.state.get()
        return Tracker(*numbers), at

    @staticmethod
    def _rows(key, found: list, late: int) -> pd.DataFrame:
        rows = [(key[0], *x, 0) for x in found] + ([(key[0], None, None, late)] if late else [])
        return pd.DataFrame(rows, columns=["stream", "start", "complete", "late"]).astype({"start": "Int64", "complete": "Int64", "late": "int64"})

    def _let_go(self, tracker: Tracker, at: int, new: dict[int, tuple], watermark: int) -> list[tuple[int, int]]:
        """Takes the chunks that are due, and sets the timer for the next; new: those just come."""
        waiting = {k[0]: tuple(v) for k, v in self.waiting.iterator()} | new
        found, left = [], sorted(waiting)
        while left and waiting[left[0]][0] <= watermark:
            seq = left.pop(0)
            at, energy = waiting[seq]
            if got := tracker.step(seq, energy, self.rules):
                found.append(got)
            if seq not in new:
                self.waiting.removeKey((seq,))
        for seq in left:
            if seq in new:
                self.waiting.updateValue((seq,), waiting[seq])
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if left:
            self.handle.registerTimer(max(waiting[left[0]][0], watermark + 1))
        elif self.idle is not None and tracker.last >= 0:
            end = at + int(self.idle * 1000)
            if watermark >= end:
                found += [got] if (got := tracker.end()) else []
            else:
                self.handle.registerTimer(end)
        self.state.update((*astuple(tracker), at))
        return found

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tracker, at = self._held()
        new, late = {}, 0
        for pdf in rows:
            for seq, when, energy in zip(pdf["seq"], pdf["at"], pdf["energy"]):
                again = int(seq) in new or self.waiting.containsKey((int(seq),))
                late += again or int(seq) <= tracker.last
                if not again and int(seq) > tracker.last:
                    new[int(seq)] = (int(when), None if pd.isna(energy) else float(energy))
        yield self._rows(key, self._let_go(tracker, at, new, timerValues.getCurrentWatermarkInMs()), late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        tracker, at = self._held()
        yield self._rows(key, self._let_go(tracker, at, {}, timerValues.getCurrentWatermarkInMs()), 0)


def endpoints_in_order(chunks: DataFrame, rules: Rules = FIXED, delay: str = "10 seconds", idle: float | None = None) -> DataFrame:
    """A streaming DataFrame (see IN_ORDER) of finished utterances from streaming chunks (stream, seq, ts,
    energy) in any order of arrival within `delay` of the latest ts seen in any stream.

    Each chunk counts once. sum(late) says how many did not count. Chunks without a stream, a seq or a
    time are left out; a chunk without energy is silent. What the watermark has not passed is still waiting.
    """
    rows = chunks.where("stream is not null and seq is not null and ts is not null").withWatermark("ts", delay)
    # The time goes on as a number: rows behind the watermark are to be counted, not dropped before.
    rows = rows.selectExpr("cast(stream as string) as stream", "cast(seq as long) as seq", "unix_millis(ts) as at", "cast(energy as double) as energy")
    return rows.groupBy("stream").transformWithStateInPandas(statefulProcessor=Reordered(rules, idle), outputStructType=IN_ORDER, outputMode="Append", timeMode="EventTime")


def endpoints(chunks: DataFrame, processor: Endpointer | None = None) -> DataFrame:
    """A streaming DataFrame of finished utterances (see OUTPUT) from streaming chunks."""
    rows = chunks.selectExpr("cast(stream as string) as stream", "seq", "energy")
    processor = processor or FixedEndpointer()
    timed = "None" if processor.idle is None else "ProcessingTime"
    return rows.groupBy("stream").transformWithStateInPandas(statefulProcessor=processor, outputStructType=OUTPUT, outputMode="Append", timeMode=timed)


def chunk_stream(spark, path: str, schema: str = "stream string, seq long, ts timestamp, samples array<smallint>", files_per_trigger: int = 1) -> DataFrame:
    """Chunks as they land in a folder of Parquet files, with their energy: the stand-in for a
    microphone, whose recorder writes chunks there."""
    from pyspark.sql import functions as F

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    total = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return rows.withColumn("energy", F.when(total > 0, F.ln(total)))


def windows(chunks: DataFrame, width: str = "25 milliseconds", slide: str = "10 milliseconds", late: str = "1 second") -> DataFrame:
    """Framing by event time: mean energy of hopping windows, with a watermark for late chunks."""
    from pyspark.sql import functions as F

    return chunks.withWatermark("ts", late).groupBy("stream", F.window("ts", width, slide)).agg(F.avg("energy").alias("energy"), F.count("*").alias("n"))
