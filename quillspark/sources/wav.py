"""RIFF/WAVE files: PCM, 16 bits, one channel, in a 44-byte header and samples."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, rate int, channels int, bits int, declared int, samples array<smallint>, error string"


def decode(content: bytes, trust_length: bool = True) -> dict:
    """A file's fields. error names what is wrong; samples are then null. trust_length False sizes
    the samples by the end of the file instead of the header."""
    out = dict.fromkeys(("rate", "channels", "bits", "declared", "samples", "error"))
    if len(content) < 44 or content[:4] != b"RIFF" or content[8:16] != b"WAVEfmt ":
        return out | {"error": "no RIFF/WAVE header"}
    kind, channels, rate = struct.unpack_from("<HHI", content, 20)
    bits, declared = struct.unpack_from("<H", content, 34)[0], struct.unpack_from("<I", content, 40)[0]
    out |= {"rate": min(rate, 2**31 - 1), "channels": channels, "bits": bits, "declared": min(declared, 2**31 - 1)}
    if kind != 1 or bits != 16 or channels != 1:
        return out | {"error": "not 16-bit PCM of one channel"}
    body = content[44 : 44 + declared] if trust_length else content[44:]
    if trust_length and len(body) < declared:
        return out | {"error": "shorter than its header says"}
    return out | {"samples": np.frombuffer(body[: len(body) // 2 * 2], "<i2")}


def encode(samples, rate: int) -> bytes:
    raw = np.asarray(samples, "<i2").tobytes()
    return struct.pack("<4sI8sIHHIIHH4sI", b"RIFF", 36 + len(raw), b"WAVEfmt ", 16, 1, 1, rate, rate * 2, 2, 16, b"data", len(raw)) + raw


def read(spark: SparkSession, path: str, trust_length: bool = True, recursive: bool = False, pattern: str = "*.wav") -> DataFrame:
    """One row a file (see SCHEMA); a file that cannot be read has its error and no samples."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)

    def run(batches):
        for b in batches:
            rows = [decode(c, trust_length) for c in b.column(1).to_pylist()]
            cols = [pa.array([r[k] for r in rows], t) for k, t in (("rate", pa.int32()), ("channels", pa.int32()), ("bits", pa.int32()), ("declared", pa.int32()), ("samples", pa.list_(pa.int16())), ("error", pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["path", "rate", "channels", "bits", "declared", "samples", "error"])

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def header(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """(path, length, rate, channels, bits, declared, valid, seconds) decoded in the JVM."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    # Little-endian fields: bytes in reverse order, as hexadecimal, as a number.
    number = lambda at, n: F.conv(F.hex(F.concat(*[F.substring("content", at + k, 1) for k in reversed(range(n))])), 16, 10).cast("long")
    rows = files.select("path", "length", number(25, 4).alias("rate"), number(23, 2).alias("channels"), number(35, 2).alias("bits"), number(41, 4).alias("declared"), ((F.substring("content", 1, 4) == b"RIFF") & (F.substring("content", 9, 7) == b"WAVEfmt")).alias("valid"))
    return rows.withColumn("seconds", F.try_divide(F.col("declared") / 2, F.col("rate")))


def signal(waves: DataFrame) -> DataFrame:
    """(utt, i, x) of the files that could be read; utt is the file's name."""
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    return waves.where("error is null").select(name.alias("utt"), F.posexplode("samples").alias("i", "x")).select("utt", F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x"))


def chunks(waves: DataFrame, size: int = 400) -> DataFrame:
    """(utt, seq, samples) in chunks of `size`, the last one shorter."""
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    n = F.ceil(F.size("samples") / size)
    rows = waves.where("error is null and size(samples) > 0").withColumn("seq", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return rows.select(name.alias("utt"), "seq", F.slice("samples", (F.col("seq") * size + 1).cast("int"), F.lit(size)).alias("samples"))


def write(waves: DataFrame, path: str) -> DataFrame:
    """Writes (utt, rate, samples) as one file a row under path, and returns (utt, file, bytes).

    path must be a folder that all executors share. A file is written beside its place and moved
    there, so a repeated task does no harm.
    """
    import os

    def run(batches):
        os.makedirs(path, exist_ok=True)
        for b in batches:
            names, files, sizes = [], [], []
            for utt, rate, samples in zip(*(c.to_pylist() for c in b.columns)):
                raw, to = encode(samples, rate), os.path.join(path, f"{utt}.wav")
                part = f"{to}.{os.getpid()}"
                with open(part, "wb") as f:
                    f.write(raw)
                os.replace(part, to)
                names.append(utt)
                files.append(to)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(files, pa.string()), pa.array(sizes, pa.int64())], ["utt", "file", "bytes"])

    return waves.select(F.col("utt").cast("string"), F.col("rate").cast("int"), F.col("samples").cast("array<smallint>")).mapInArrow(run, "utt string, file string, bytes long")
