"""Queries of sources and sinks: what `events` and `embeddings` hold is written in each format, read
back, and compared with SQL over the tables themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gauss, scoring, signal
from ..session import fleeting, table
from ..sources import models, recordings, wav
from .model_queries import frames
from .signal_queries import wave


def _waves(s: SparkSession, d: str) -> str:
    """One file a user: the integer parts of its values at 16 kHz."""
    path = fleeting(s, "wav-")
    rows = wave(s, d).groupBy(F.col("utt").cast("string").alias("utt")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.floor("x").cast("smallint").alias("x")))), lambda z: z.x).alias("samples"))
    recordings.save(rows.withColumn("rate", F.lit(16000)), path)
    return path


def _ranges(s: SparkSession, d: str) -> DataFrame:
    """One file a type of event, read by ranges so short that several tasks read each."""
    path = fleeting(s, "wav-")
    rows = signal.sequence_index(table(s, d, "events"), "event_type", ["ts", "event_id"], "ts", "day")
    rows = rows.groupBy(F.col("event_type").alias("utt")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.floor("value").cast("smallint").alias("x")))), lambda z: z.x).alias("samples"))
    recordings.save(rows.withColumn("rate", F.lit(16000)), path)
    size = max(64, table(s, d, "events").count() // 8)
    return recordings.blocks_signal(recordings.scan(s, path, partitionBytes=size, blockSamples=100).where("rate = 16000 and channels = 1"))


def _features(s: SparkSession, d: str) -> str:
    """Each vector as a line of its label's feature file."""
    path = fleeting(s, "features-")
    lines = frames(s, d).groupBy("model").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", F.col("vec").alias("v")))), lambda z: F.array_join(F.transform(z.v, lambda x: x.cast("string")), " ")), "\n").alias("value"))
    lines.write.partitionBy("model").text(path)
    return path


def _read_features(s: SparkSession, d: str) -> DataFrame:
    got = models.features(s, _features(s, d) + "/*")
    rows = got.select(F.regexp_extract("path", "model=([0-9]+)", 1).cast("long").alias("model"), F.col("t").cast("long").alias("t"), F.posexplode("vec").alias("d", "x"))
    return rows.select("model", "t", "d", F.round("x", 6).alias("x"))


def _model_table(s: SparkSession, d: str) -> DataFrame:
    path = fleeting(s, "models-")
    models.write_table(gauss.fit(frames(s, d), ["model"]), path)
    return s.read.parquet(path).select(F.col("model").cast("int").alias("model"), "n", F.posexplode(F.arrays_zip("mean", "var")).alias("d", "p")).select("model", "n", "d", F.round("p.mean", 6).alias("mean"), F.round("p.var", 6).alias("var"))


def _chains(s: SparkSession, d: str) -> DataFrame:
    """A model for every five labels of `embeddings`, a state a label; transition costs from counts."""
    rows = frames(s, d).select(F.floor(F.col("model") / 5).cast("int").alias("model"), (F.col("model") % 5).cast("int").alias("state"), "vec")
    got = gauss.fit(rows, ["model", "state"])
    n = F.col("n").cast("double")
    return got.select("model", "state", "mean", "var", F.ln(n).alias("stay"), F.ln(n + 1).alias("next"), F.ln(n + 2).alias("skip"))


def _by_dimension(df: DataFrame, *keys: str) -> DataFrame:
    rows = df.select(*keys, F.posexplode(F.arrays_zip("mean", "var")).alias("d", "p"))
    return rows.select(*[F.round(k, 6).alias(k) if k in ("stay", "next", "skip", "alpha") else F.col(k).cast("int").alias(k) for k in keys], "d", F.round("p.mean", 6).alias("mean"), F.round("p.var", 6).alias("var"))


def _hmm_files(s: SparkSession, d: str) -> DataFrame:
    path = fleeting(s, "hmm-")
    models.write_hmm_text(_chains(s, d), path)
    return _by_dimension(models.hmm_text(s, path), "model", "state", "stay", "next")


def _skip_files(s: SparkSession, d: str) -> DataFrame:
    """With an entry row before each model's states, so that a state's row is one more."""
    path = fleeting(s, "skip-")
    rows = _chains(s, d).withColumn("row", F.col("state") + 1)
    entry = rows.groupBy("model").agg(F.lit(0).alias("row"), F.lit(None).cast("array<double>").alias("mean"), F.lit(None).cast("array<double>").alias("var"), F.lit(0.0).alias("stay"), F.lit(0.5).alias("next"), F.lit(0.75).alias("skip"))
    columns = ["model", "row", "mean", "var", "stay", "next", "skip"]
    models.write_skip_text(rows.select(*columns).union(entry.select(*columns)), path)
    return _by_dimension(models.skip_text(s, path).where("row > 0"), "model", "row", "stay", "next", "skip")


def _dat_file(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    path, rows = fleeting(s, "dat-"), _chains(s, d)
    comps = gauss.split(rows.select("model", "state", F.lit(0).alias("g"), F.lit(1.0).alias("alpha"), "mean", "var"))
    stay = rows.select("model", F.col("state").alias("src"), F.col("state").alias("dst"), F.col("stay").alias("cost"))
    models.write_dat(comps, stay.union(rows.select("model", "state", F.col("state") + 1, "next")), path)
    return models.dat(s, path, "*.dat")


def queries() -> dict:
    return {
        "wav_signal": lambda s, d: wav.signal(wav.read(s, _waves(s, d))).select(F.col("utt").cast("long").alias("utt"), "i", "x"),
        "wav_header": lambda s, d: wav.header(s, _waves(s, d)).select(F.regexp_extract("path", r"([0-9]+)\.wav$", 1).cast("long").alias("utt"), "rate", "channels", "bits", "declared", "valid", F.round("seconds", 6).alias("seconds")),
        "wav_chunks": lambda s, d: wav.chunks(wav.read(s, _waves(s, d)), 4).select(F.col("utt").cast("long").alias("utt"), "seq", F.aggregate("samples", F.lit(0).cast("long"), lambda a, x: a + x).alias("total")),
        "wav_ranges": _ranges,
        "wav_to_end": lambda s, d: wav.signal(wav.read(s, _waves(s, d), trust_length=False)).select(F.col("utt").cast("long").alias("utt"), "i", "x"),
        "hmm_files": _hmm_files,
        "skip_files": _skip_files,
        "dat_components": lambda s, d: _by_dimension(_dat_file(s, d)[0], "model", "state", "g", "alpha"),
        "dat_transitions": lambda s, d: _dat_file(s, d)[1].select("model", "src", "dst", F.round("cost", 6).alias("cost")),
        "feature_files": _read_features,
        "model_table": _model_table,
        "numbered_names": lambda s, d: scoring.numbered_names(table(s, d, "part").select(F.col("p_brand").alias("digits"), F.col("p_partkey").cast("string").alias("file"))),
    }


_SIG = "sig AS (SELECT user_id AS utt, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, floor(CAST(value AS DOUBLE)) AS x FROM events)"


_STATES = "WITH st AS (SELECT CAST(label // 5 AS INTEGER) AS model, CAST(label % 5 AS INTEGER) AS state, count(*) AS n, CAST(d AS INTEGER) AS d, avg(x) AS raw, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS var FROM (SELECT label, unnest(range(0, len(embedding))) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label, d)"


def oracle_sql() -> dict[str, str]:
    return {
        "wav_signal": f"WITH {_SIG} SELECT utt, i, x FROM sig",
        "wav_to_end": f"WITH {_SIG} SELECT utt, i, x FROM sig",
        "hmm_files": f"{_STATES} SELECT model, state, round(ln(n), 6) AS stay, round(ln(n + 1), 6) AS next, d, mean, var FROM st",
        "skip_files": f"{_STATES} SELECT model, state + 1 AS row, round(ln(n), 6) AS stay, round(ln(n + 1), 6) AS next, round(ln(n + 2), 6) AS skip, d, mean, var FROM st",
        "dat_components": f"{_STATES} SELECT model, state, g, 0.5::DOUBLE AS alpha, d, round(raw * CASE g WHEN 0 THEN 1.01 ELSE 0.99 END, 6) AS mean, var FROM st, (VALUES (0), (1)) two(g)",
        "dat_transitions": f"{_STATES}, n AS (SELECT DISTINCT model, state, n FROM st) SELECT model, state AS src, state AS dst, round(ln(n), 6) AS cost FROM n UNION ALL SELECT model, state, state + 1, round(ln(n + 1), 6) FROM n WHERE state < (SELECT max(state) FROM n)",
        "wav_ranges": "SELECT event_type AS utt, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, floor(CAST(value AS DOUBLE)) AS x FROM events",
        "wav_header": f"WITH {_SIG} SELECT utt, 16000 AS rate, 1 AS channels, 16 AS bits, 2 * count(*) AS declared, true AS valid, round(count(*) / 16000, 6) AS seconds FROM sig GROUP BY utt",
        "wav_chunks": f"WITH {_SIG} SELECT utt, i // 4 AS seq, CAST(sum(x) AS BIGINT) AS total FROM sig GROUP BY utt, i // 4",
        "feature_files": "SELECT label AS model, t, CAST(unnest(range(0, len(e))) AS INTEGER) AS d, round(CAST(unnest(e) AS DOUBLE), 6) AS x FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, embedding AS e FROM embeddings)",
        "model_table": "SELECT CAST(label AS INTEGER) AS model, count(*) AS n, CAST(d AS INTEGER) AS d, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS var FROM (SELECT label, unnest(range(0, len(embedding))) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label, d",
        "numbered_names": "SELECT p_brand AS digits, row_number() OVER (PARTITION BY p_brand ORDER BY CAST(p_partkey AS VARCHAR)) - 1 AS place, CAST(p_partkey AS VARCHAR) AS file FROM part",
    }
