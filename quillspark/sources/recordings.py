"""Recordings as Spark data sources: WAV files by byte ranges, their sink, and a recorder's spool as a stream.

`wav` (batch): a file is read in ranges by as many tasks as its size asks for, small files go together,
and each row is a block of samples. Filters on header fields are decided before any sample is read, those on
path and length before a task is made; a schema without samples reads headers alone.

`wav` (sink): a row (utt, rate, samples) becomes a file; files appear when the job commits, and a
failed job leaves none.

`recorder` (stream): raw 16-bit samples that recorders append to a folder's files, in chunks. Its offset is
each file's bytes, which Spark keeps in the query's checkpoint, so after a restart each chunk comes once.
"""

from __future__ import annotations

import operator
import struct
import uuid
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from .files import Commit, listed, opened
from .wav import decode, encode

HEADER = 44
WAV = "path string, length long, rate int, channels int, bits int, declared int, first long, samples array<smallint>, error string"
_KINDS = {"path": pa.string(), "length": pa.int64(), "rate": pa.int32(), "channels": pa.int32(), "bits": pa.int32(), "declared": pa.int32(), "first": pa.int64(), "samples": pa.list_(pa.int16()), "error": pa.string()}
_COMPARE = {EqualTo: operator.eq, EqualNullSafe: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, In: lambda x, values: x in values}
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_PUSHED = ("path", "length", "rate", "channels", "bits", "declared")


@dataclass
class Ranges(InputPartition):
    """(path, first byte, last byte + 1, file's bytes) of what one task reads."""

    pieces: list[tuple[str, int, int, int]]


class WavReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.columns = options["path"], schema.names
        if unknown := set(self.columns) - set(_KINDS):
            raise ValueError(f"wav has no columns {sorted(unknown)}")
        self.pattern, self.recursive = options.get("pattern", "*.wav"), options.get("recursive", "false") == "true"
        self.trust_length = options.get("trustLength", "true") == "true"
        # Whole samples: even numbers of bytes.
        self.partition_bytes = max(2, int(options.get("partitionBytes", 64 << 20)) // 2 * 2)
        self.block = max(1, int(options.get("blockSamples", 1 << 16)))
        self.filters: list[tuple[str, object, object]] = []

    def _passes(self, row: dict) -> bool:
        return all(row[c] is not None and test(row[c], value) for c, test, value in self.filters if c in row)

    def partitions(self) -> list[Ranges]:
        out, now, held = [], [], 0
        for path, size in listed(self.path, self.pattern, self.recursive):
            if not self._passes({"path": path, "length": size}):
                continue
            end = size if "samples" in self.columns else min(size, HEADER)
            at = 0  # the first range holds the header; others begin at a sample
            while at == 0 or at < end:
                to = min(end, max(HEADER, at) + self.partition_bytes)
                if held and held + to - at > self.partition_bytes:
                    out.append(Ranges(now))
                    now, held = [], 0
                now.append((path, at, to, size))
                held += max(1, to - at)
                at = max(to, 1)
        return out + ([Ranges(now)] if now else [])

    def read(self, partition: Ranges):
        for path, at, to, size in partition.pieces:
            where, _ = opened(self.path)
            with where.open_input_file(path) as f:
                head = f.read_at(min(HEADER, size), 0)
                row = decode(head, trust_length=False)
                real = struct.unpack_from("<I", head, 40)[0] if row["error"] is None else 0
                if row["error"] is None and self.trust_length and size - HEADER < real:
                    row["error"] = "shorter than its header says"
                row |= {"path": path, "length": size, "samples": None, "first": None}
                if not self._passes(row):
                    continue
                end = min(to, HEADER + real) if self.trust_length else to
                first = (max(at, HEADER) - HEADER) // 2
                n = 0 if row["error"] else max(0, (end - HEADER) // 2 - first)
                if "samples" not in self.columns or row["error"] or (not n and not at):
                    if not at:
                        yield self._batch([row])
                    continue
                for k in range(first, first + n, self.block):
                    many = min(self.block, first + n - k)
                    yield self._batch([row | {"first": k, "samples": np.frombuffer(f.read_at(2 * many, HEADER + 2 * k), "<i2")}])

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], _KINDS[c]) for c in self.columns], self.columns)


class FilteredWavReader(WavReader):
    """With filters pushed to it, which a session must allow (spark.sql.python.filterPushdown.enabled)."""

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if type(f) in _COMPARE and len(f.attribute) == 1 and f.attribute[0] in _PUSHED:
                self.filters.append((f.attribute[0], _COMPARE[type(f)], f.value))
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WavWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.to = Commit(options["path"], overwrite)

    def write(self, iterator) -> Written:
        task, files = uuid.uuid4().hex, []
        for row in iterator:
            files.append(self.to.write(f"{row['utt']}.wav", [encode(row["samples"] or [], row["rate"])], task))
        return Written(files)

    def commit(self, messages) -> None:
        self.to.commit([f for m in messages if m is not None for f in m.files])

    def abort(self, messages) -> None:
        self.to.abort()


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return WAV

    def reader(self, schema: StructType) -> WavReader:
        return (FilteredWavReader if self.options.get("pushFilters") == "true" else WavReader)(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> WavWriter:
        if missing := {"utt", "rate", "samples"} - set(schema.names):
            raise ValueError(f"a recording needs the columns {sorted(missing)}")
        return WavWriter(self.options, overwrite)


class RecorderReader(DataSourceStreamReader):
    """Offsets are whole chunks' bytes of each file; a file's tail waits until its chunk is full."""

    def __init__(self, options: dict) -> None:
        self.path, self.pattern = options["path"], options.get("pattern", "*.pcm")
        self.chunk, self.rate = int(options.get("chunk", 400)), int(options.get("rate", 16000))
        self.start = datetime.fromisoformat(options.get("start", "1970-01-01T00:00:00")).replace(tzinfo=timezone.utc)
        self.partition_bytes = max(2 * self.chunk, int(options.get("partitionBytes", 16 << 20)) // (2 * self.chunk) * 2 * self.chunk)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        whole = 2 * self.chunk
        return {p: size // whole * whole for p, size in listed(self.path, self.pattern) if size >= whole}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        out = []
        for p, to in sorted(end.items()):
            for at in range(start.get(p, 0), to, self.partition_bytes):
                out.append(Ranges([(p, at, min(to, at + self.partition_bytes), to)]))
        return out

    def read(self, partition: Ranges):
        for path, at, to, _ in partition.pieces:
            where, _ = opened(self.path)
            stream = path.rpartition("/")[2].rpartition(".")[0]
            with where.open_input_file(path) as f:
                x = np.frombuffer(f.read_at(to - at, at), "<i2").reshape(-1, self.chunk)
            first = at // (2 * self.chunk)
            for k, samples in enumerate(x):
                yield stream, first + k, self.start + timedelta(seconds=(first + k) * self.chunk / self.rate), samples.tolist()

    def commit(self, end: dict) -> None:
        """Nothing is deleted: a spool may have other readers."""


class RecorderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorder"

    def schema(self) -> str:
        return "stream string, seq long, ts timestamp, samples array<smallint>"

    def streamReader(self, schema: StructType) -> RecorderReader:
        return RecorderReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes `wav` and `recorder` known to the session."""
    for source in (WavSource, RecorderSource):
        spark.dataSource.register(source)


def scan(spark: SparkSession, path: str, columns: str | None = None, **options) -> DataFrame:
    """The recordings under path in blocks (see WAV; columns: some of them, as a schema): first is the
    place of the block's first sample. Files whose fields, samples or errors read() of sources.wav would give
    in a row of their own have them here in as many rows as blocks; a file without samples has one row.

    options: pattern, recursive, trustLength, partitionBytes (of a task), blockSamples (of a row). Filters are
    pushed where the session allows it, as session.session() does.
    """
    register(spark)
    options = {"pushFilters": spark.conf.get(_PUSHDOWN, "false")} | options
    rows = spark.read.format("wav").options(**{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()})
    return (rows.schema(columns) if columns else rows).load(path)


def blocks_signal(blocks: DataFrame) -> DataFrame:
    """(utt, i, x), a row a sample, of scan()'s blocks; utt is the file's name."""
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    rows = blocks.where("samples is not null").select(name.alias("utt"), "first", F.posexplode("samples").alias("k", "x"))
    return rows.select("utt", (F.col("first") + F.col("k")).alias("i"), F.col("x").cast("double").alias("x"))


def save(waves: DataFrame, path: str, mode: str = "append") -> None:
    """Writes (utt, rate, samples) as one file a row under path: an action, which commits or leaves nothing.
    A null utt or rate, a name with a slash, and two rows of one name fail the job; null samples are none."""
    register(waves.sparkSession)
    waves.select(F.assert_true(F.col("utt").isNotNull() & F.col("rate").isNotNull()).isNull().alias("_ok"), F.col("utt").cast("string"), F.col("rate").cast("int"), F.col("samples").cast("array<smallint>")).where("_ok").drop("_ok").write.format("wav").mode(mode).save(path)


def recorder(spark: SparkSession, path: str, **options) -> DataFrame:
    """A streaming DataFrame (stream, seq, ts, samples) of the raw samples that recorders append to the
    files of a folder, with the energy of each chunk. options: pattern, chunk (samples), rate, start (the time
    of a file's first sample), partitionBytes."""
    register(spark)
    rows = spark.readStream.format("recorder").options(**{k: str(v) for k, v in options.items()}).load(path)
    total = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return rows.withColumn("energy", F.when(total > 0, F.ln(total)))
