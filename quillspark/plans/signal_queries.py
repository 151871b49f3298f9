"""Queries of the signal front end and of endpointing, over `events` as signals by user.

Widths are small so that each can be compared with SQL; the operators' own defaults are the full
ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import endpoint, signal
from ..session import table

PY = signal.small(signal.PY, frame=16, shift=8, fft=32, bands=8, dct=8, keep=5)
CPP = signal.small(signal.CPP, frame=16, shift=8, fft=32, bands=4, dct=4, keep=3)
G5 = signal.small(signal.G5, frame=16, shift=6, fft=32, bands=8, dct=12, keep=5, rate=16000)


def wave(spark: SparkSession, d: str) -> DataFrame:
    rows = signal.sequence_index(table(spark, d, "events"), "user_id", ["ts", "event_id"], "ts", "day")
    return rows.select(F.col("user_id").alias("utt"), F.col("i").cast("long").alias("i"), F.col("value").cast("double").alias("x"))


def _features(spark, d):
    w = wave(spark, d)
    both = F.array(F.struct(F.lit(0).alias("d"), F.col("x").alias("v")), F.struct(F.lit(1).alias("d"), (F.col("i") % 7).cast("double").alias("v")))
    return w.select("utt", F.col("i").alias("t"), F.explode(both).alias("p")).select("utt", "t", "p.d", "p.v")


def _long(df: DataFrame, name: str, digits: int = 6) -> DataFrame:
    return df.select("utt", F.col("f").cast("long").alias("f"), F.posexplode(name).alias("j", "v")).select("utt", "f", "j", F.round("v", digits).alias("v"))


_SIG = "sig AS (SELECT user_id AS utt, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, CAST(value AS DOUBLE) AS x FROM events)"
_EMPHASISED = _SIG.replace("sig AS", "raw AS") + ", sig AS (SELECT utt, i, coalesce(x - 0.95 * lag(x) OVER (PARTITION BY utt ORDER BY i), x) AS x FROM raw)"
_FEAT = _SIG + ", feat AS (SELECT utt, i AS t, 0 AS d, x AS v FROM sig UNION ALL SELECT utt, i, 1, CAST(i % 7 AS DOUBLE) FROM sig)"


def _frames_sql(p) -> str:
    count = {"drop": f"greatest(CAST(floor((n - {p.frame}) / {p.shift}.0) AS BIGINT) + 1, 0)", "keep": f"greatest(CAST(ceil((n - {p.frame}) / {p.shift}.0) AS BIGINT) + 1, 0)", "every": f"CAST(ceil(n / {p.shift}.0) AS BIGINT)"}[p.tail]
    off = (p.fft - p.frame) // 2 if p.centred else 0
    return f"""{_SIG}, len AS (SELECT utt, max(i) + 1 AS n FROM sig GROUP BY utt),
      fr AS (SELECT l.utt, f.f, j.j, CASE WHEN j.j BETWEEN {off} AND {off + p.frame - 1} THEN coalesce(s.x, 0.0) ELSE 0.0 END AS v
             FROM (SELECT utt, unnest(generate_series(0, ({count}) - 1)) AS f FROM len) f JOIN len l ON l.utt = f.utt
             CROSS JOIN (SELECT unnest(generate_series(0, {p.fft - 1})) AS j) j
             LEFT JOIN sig s ON s.utt = l.utt AND s.i = f.f * {p.shift} + j.j - {off} AND j.j BETWEEN {off} AND {off + p.frame - 1})"""


def _window_sql(p) -> str:
    off, n = ((p.fft - p.frame) // 2 if p.centred else 0), (p.frame if p.periodic else p.frame - 1)
    return _frames_sql(p) + f", win AS (SELECT utt, f, j, v * CASE WHEN j BETWEEN {off} AND {off + p.frame - 1} THEN 0.54 - 0.46 * cos(2 * pi() * (j - {off}) / {n}) ELSE 0 END AS v FROM fr)"


def _spectrum_sql(p) -> str:
    power = "sum(v * cos(2 * pi() * j * k / {0})) ^ 2 + sum(v * sin(2 * pi() * j * k / {0})) ^ 2".format(p.fft)
    return _window_sql(p) + f", spec AS (SELECT utt, f, k, {power if p.power else f'sqrt({power})'} AS v FROM win CROSS JOIN (SELECT unnest(generate_series(0, {p.fft // 2})) AS k) GROUP BY utt, f, k)"


def _mel_sql(p) -> str:
    mel = "2595 * log10(1 + ({}) / 700.0)".format
    top = mel(f"{p.rate / 2}")
    if p.triangular:
        hz = lambda b: f"700 * (pow(10, {top} * ({b}) / {p.bands + 1} / 2595) - 1)"
        fq = f"(k * {p.rate / p.fft})"
        w = f"greatest(least(({fq} - {hz('b')}) / ({hz('b + 1')} - {hz('b')}), ({hz('b + 2')} - {fq}) / ({hz('b + 2')} - {hz('b + 1')})), 0)"
    else:
        slot = f"floor({mel(f'k * {p.rate / p.fft}')} / ({top} / {p.bands + 1}))"
        rest = f"({mel(f'k * {p.rate / p.fft}')} - {slot} * ({top} / {p.bands + 1})) / ({top} / {p.bands + 1})"
        w = f"CASE WHEN {slot} = b + 1 THEN CASE WHEN {slot} < {p.bands} THEN 1 ELSE 1 - {rest} END ELSE 0 END"
    bank = f"bank AS (SELECT b, k, {w} AS w FROM (SELECT unnest(generate_series(0, {p.bands - 1})) AS b) CROSS JOIN (SELECT unnest(generate_series(0, {p.fft // 2})) AS k))"
    return _spectrum_sql(p) + f", {bank}, mel AS (SELECT utt, f, b, sum(v * w) AS m FROM spec JOIN bank USING (k) GROUP BY utt, f, b), lm AS (SELECT utt, f, b, CASE WHEN m > 0 THEN ln(m) END AS v FROM mel)"


def _dct_sql(p) -> str:
    scale = f"CASE WHEN c = 0 THEN sqrt(1.0 / {p.dct}) ELSE sqrt(2.0 / {p.dct}) END" if p.ortho else "2"
    return _mel_sql(p) + f", cep AS (SELECT utt, f, c, sum(v * cos(pi() * (b + 0.5) * c / {p.dct})) * {scale} AS v FROM lm CROSS JOIN (SELECT unnest(generate_series(0, {p.keep - 1})) AS c) GROUP BY utt, f, c)"


def _out(body: str, source: str, j: str = "j", digits: int = 6) -> str:
    return f"WITH {body} SELECT utt, CAST(f AS BIGINT) AS f, CAST({j} AS INTEGER) AS j, round(v, {digits}) AS v FROM {source}"


def _spec(spark, d, p):
    return signal.spectrum(signal.windowed(signal.frames(wave(spark, d), p), p), p)


def _cep(spark, d, p):
    return signal.cepstra(signal.log_mel(_spec(spark, d, p), p), p)


def _feature_out(df: DataFrame, name: str) -> DataFrame:
    return df.select("utt", F.col("t").cast("long").alias("t"), "d", F.round(name, 6).alias("v"))


def _mfcc(spark, d, p):
    out = signal.mfcc(wave(spark, d), p, 3)
    return out.select("utt", "t", F.transform("vec", lambda v: F.round(v, 5) + 0.0).alias("vec"))


def _mfcc_sql(p) -> str:
    """Cepstra, normalisation and differences, each as in its own query, put together."""
    score = "CASE WHEN stddev_pop(v) OVER q > 1e-12 THEN (v - avg(v) OVER q) / stddev_pop(v) OVER q END"
    base = f"SELECT utt, f AS t, c AS d, {score if p.normalise_first else 'v'} AS v FROM cep WINDOW q AS (PARTITION BY utt, c)"
    if p.forward:
        one = f"SELECT *, coalesce(lead(v) OVER ({_D}) - v, v) AS d1 FROM m0"
        two = f"SELECT *, coalesce(lead(d1) OVER ({_D}) - d1, d1) AS d2 FROM m1"
    else:
        last = "max(t) OVER (PARTITION BY utt)"
        one = f"SELECT *, CASE WHEN t BETWEEN 1 AND {last} - 1 THEN lead(v) OVER ({_D}) - lag(v) OVER ({_D}) ELSE 0.0 END AS d1 FROM m0"
        two = f"SELECT *, CASE WHEN t BETWEEN 2 AND {last} - 2 THEN lead(d1) OVER ({_D}) - lag(d1) OVER ({_D}) ELSE 0.0 END AS d2 FROM m1"
    k = p.keep
    long = f"SELECT utt, t, d, v FROM m2 UNION ALL SELECT utt, t, d + {k}, d1 FROM m2 UNION ALL SELECT utt, t, d + {2 * k}, d2 FROM m2"
    kept = f"SELECT utt, t - {p.trim} AS t, d, v FROM (SELECT *, max(t) OVER (PARTITION BY utt) AS last FROM m3) WHERE t BETWEEN {p.trim} AND last - {p.trim}"
    final = "v" if p.normalise_first else score
    return f"WITH {_dct_sql(p).replace(_SIG, _EMPHASISED)}, m0 AS ({base}), m1 AS ({one}), m2 AS ({two}), m3 AS ({long}), m4 AS ({kept}), m5 AS (SELECT utt, t, d, {final} AS v FROM m4 WINDOW q AS (PARTITION BY utt, d)) SELECT utt, CAST(t AS BIGINT) AS t, list(round(v, 5) + 0.0 ORDER BY d) AS vec FROM m5 GROUP BY utt, t"


def _chunks(spark, d, form="ln", size=4):
    return endpoint.chunk_energy(wave(spark, d), size, form)


def _flags(spark, d):
    return _chunks(spark, d).select("utt", "seq", F.coalesce(F.col("energy") > 11, F.lit(False)).alias("voiced"))


_CH = _SIG + ", ch AS (SELECT utt, i // 4 AS seq, sum(x * x) AS s FROM sig GROUP BY utt, i // 4), en AS (SELECT utt, seq, CASE WHEN s > 0 THEN ln(s) END AS energy, s FROM ch), fl AS (SELECT utt, seq, coalesce(energy > 11, false) AS voiced, energy FROM en)"

_D = "PARTITION BY utt, d ORDER BY t"
_DELTA = _FEAT + f", a AS (SELECT *, max(t) OVER (PARTITION BY utt) AS last, lead(v) OVER ({_D}) AS nx, lag(v) OVER ({_D}) AS pv FROM feat), d1 AS (SELECT utt, t, d, last, CASE WHEN t >= 1 AND t <= last - 1 THEN nx - pv ELSE 0.0 END AS v FROM a), b AS (SELECT *, lead(v) OVER ({_D}) AS nx, lag(v) OVER ({_D}) AS pv FROM d1), d2 AS (SELECT utt, t, d, CASE WHEN t >= 2 AND t <= last - 2 THEN nx - pv ELSE 0.0 END AS v FROM b)"
_FORWARD = _FEAT + f", a AS (SELECT *, lead(v) OVER ({_D}) AS nx FROM feat), d1 AS (SELECT utt, t, d, coalesce(nx - v, v) AS v FROM a), b AS (SELECT *, lead(v) OVER ({_D}) AS nx FROM d1), d2 AS (SELECT utt, t, d, coalesce(nx - v, v) AS v FROM b)"


def _feature_sql(body: str, source: str) -> str:
    return f"WITH {body} SELECT utt, CAST(t AS BIGINT) AS t, CAST(d AS INTEGER) AS d, round(v, 6) AS v FROM {source}"


_ADAPTIVE = f"""
WITH RECURSIVE {_SIG}, ch AS (SELECT utt, i // 4 AS seq, sum(x * x) AS s FROM sig GROUP BY utt, i // 4),
en AS (SELECT utt, seq, CASE WHEN s > 0 THEN ln(s) END AS energy FROM ch),
lv(utt, seq, level, background) AS (
  SELECT DISTINCT utt, CAST(-1 AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE FROM en
  UNION ALL
  SELECT utt, seq, greatest(l, b), b FROM (
    SELECT utt, seq, l, CASE WHEN e < background THEN l ELSE background + (e - background) * 0.05 END AS b FROM (
      SELECT lv.utt, lv.seq + 1 AS seq, (lv.level + coalesce(en.energy, lv.background)) / 2 AS l, coalesce(en.energy, lv.background) AS e, lv.background
      FROM lv JOIN en ON en.utt = lv.utt AND en.seq = lv.seq + 1)))
SELECT utt, seq, round(level, 6) AS level, round(background, 6) AS background, level - background > 5 AS voiced FROM lv WHERE seq >= 0
"""


def queries() -> dict:
    return {
        "preemphasis": lambda s, d: signal.pre_emphasis(wave(s, d)).select("utt", "i", F.round("y", 6).alias("y")),
        "frame_py": lambda s, d: _long(signal.frames(wave(s, d), PY), "frame"),
        "frame_cpp": lambda s, d: _long(signal.frames(wave(s, d), CPP), "frame"),
        "frame_g5": lambda s, d: _long(signal.frames(wave(s, d), G5), "frame"),
        "hamming_symmetric": lambda s, d: _long(signal.windowed(signal.frames(wave(s, d), PY), PY), "frame"),
        "hamming_periodic": lambda s, d: _long(signal.windowed(signal.frames(wave(s, d), CPP), CPP), "frame"),
        "power_dft": lambda s, d: _long(_spec(s, d, PY), "spectrum", 4),
        "magnitude_dft": lambda s, d: _long(_spec(s, d, G5), "spectrum", 5),
        "mel_tri": lambda s, d: _long(signal.log_mel(_spec(s, d, PY), PY), "logmel"),
        "mel_rect": lambda s, d: _long(signal.log_mel(_spec(s, d, CPP), CPP), "logmel"),
        "dct_ortho": lambda s, d: _long(_cep(s, d, PY), "cepstra", 5),
        "dct_raw": lambda s, d: _long(_cep(s, d, CPP), "cepstra", 5),
        "dct_padded": lambda s, d: _long(_cep(s, d, G5), "cepstra", 5),
        "delta_central": lambda s, d: _feature_out(signal.delta_central(_features(s, d)), "delta"),
        "delta2_central": lambda s, d: _feature_out(signal.delta_central(signal.delta_central(_features(s, d)), "delta", "delta2", 2), "delta2"),
        "delta_forward": lambda s, d: _feature_out(signal.delta_forward(_features(s, d)), "delta"),
        "delta2_forward": lambda s, d: _feature_out(signal.delta_forward(signal.delta_forward(_features(s, d)), "delta", "delta2"), "delta2"),
        "zscore": lambda s, d: _feature_out(signal.z_score(_features(s, d)), "v"),
        "edge_trim": lambda s, d: _feature_out(signal.edge_trim(_features(s, d)), "v"),
        "mfcc_py": lambda s, d: _mfcc(s, d, PY),
        "mfcc_cpp": lambda s, d: _mfcc(s, d, CPP),
        "mfcc_g5": lambda s, d: _mfcc(s, d, G5),
        "mel_scale": lambda s, d: table(s, d, "events").select("event_id", F.round(C.hz_to_mel(F.col("value")), 6).alias("mel"), F.round(C.mel_to_hz(C.hz_to_mel(F.col("value"))), 6).alias("hz"), F.round(C.hz_to_mel_ln(F.col("value")), 6).alias("mel_ln"), F.round(C.mel_to_hz_ln(C.hz_to_mel_ln(F.col("value"))), 6).alias("hz_ln")),
        "chunk_energy": lambda s, d: _chunks(s, d).select("utt", "seq", F.round("energy", 6).alias("energy")),
        "chunk_energy_db": lambda s, d: _chunks(s, d, "db").select("utt", "seq", F.round("energy", 6).alias("energy")),
        "chunk_energy_ln1": lambda s, d: _chunks(s, d, "ln1").select("utt", "seq", F.round("energy", 6).alias("energy")),
        "endpoint_fixed": lambda s, d: endpoint.fixed(_chunks(s, d), 11.0, 3, 2),
        "endpoint_adaptive": lambda s, d: endpoint.adaptive(_chunks(s, d), 5.0).select("utt", "seq", F.round("level", 6).alias("level"), F.round("background", 6).alias("background"), "voiced"),
        "noise_floor": lambda s, d: endpoint.noise_floor(_chunks(s, d), 2, 5).select("utt", F.round("floor", 6).alias("floor")),
        "voiced_run_start": lambda s, d: endpoint.run_start(_flags(s, d), 2),
        "tail_prune": lambda s, d: endpoint.tail_prune(_flags(s, d), 3, 4),
        "start_rewind": lambda s, d: endpoint.fixed(_chunks(s, d), 11.0, 3, 2).select("utt", C.rewind(F.col("start") * 4, 2, 4).alias("start_sample")),
        "recording_cap": lambda s, d: endpoint.capped(_chunks(s, d), 0.5, 4, 80).select("utt", "seq"),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "preemphasis": f"WITH {_SIG} SELECT utt, i, round(coalesce(x - 0.95 * lag(x) OVER (PARTITION BY utt ORDER BY i), x), 6) AS y FROM sig",
        "frame_py": _out(_frames_sql(PY), "fr"),
        "frame_cpp": _out(_frames_sql(CPP), "fr"),
        "frame_g5": _out(_frames_sql(G5), "fr"),
        "hamming_symmetric": _out(_window_sql(PY), "win"),
        "hamming_periodic": _out(_window_sql(CPP), "win"),
        "power_dft": _out(_spectrum_sql(PY), "spec", "k", 4),
        "magnitude_dft": _out(_spectrum_sql(G5), "spec", "k", 5),
        "mel_tri": _out(_mel_sql(PY), "lm", "b"),
        "mel_rect": _out(_mel_sql(CPP), "lm", "b"),
        "dct_ortho": _out(_dct_sql(PY), "cep", "c", 5),
        "dct_raw": _out(_dct_sql(CPP), "cep", "c", 5),
        "dct_padded": _out(_dct_sql(G5), "cep", "c", 5),
        "mfcc_py": _mfcc_sql(PY),
        "mfcc_cpp": _mfcc_sql(CPP),
        "mfcc_g5": _mfcc_sql(G5),
        "delta_central": _feature_sql(_DELTA, "d1"),
        "delta2_central": _feature_sql(_DELTA, "d2"),
        "delta_forward": _feature_sql(_FORWARD, "d1"),
        "delta2_forward": _feature_sql(_FORWARD, "d2"),
        "zscore": _feature_sql(_FEAT + ", z AS (SELECT utt, t, d, CASE WHEN stddev_pop(v) OVER (PARTITION BY utt, d) <> 0 THEN (v - avg(v) OVER (PARTITION BY utt, d)) / stddev_pop(v) OVER (PARTITION BY utt, d) END AS v FROM feat)", "z"),
        "edge_trim": _feature_sql(_FEAT + ", z AS (SELECT utt, t - 2 AS t, d, v FROM (SELECT *, max(t) OVER (PARTITION BY utt) AS last FROM feat) WHERE t BETWEEN 2 AND last - 2)", "z"),
        "mel_scale": "SELECT event_id, round(2595 * log10(1 + value / 700), 6) AS mel, round(700 * (pow(10, 2595 * log10(1 + value / 700) / 2595) - 1), 6) AS hz, round(1127 * ln(1 + value / 700), 6) AS mel_ln, round(700 * (exp(1127 * ln(1 + value / 700) / 1127) - 1), 6) AS hz_ln FROM events",
        "chunk_energy": f"WITH {_CH} SELECT utt, seq, round(energy, 6) AS energy FROM en",
        "chunk_energy_db": f"WITH {_CH} SELECT utt, seq, round(CASE WHEN s > 0 THEN log10(s) * 10 END, 6) AS energy FROM en",
        "chunk_energy_ln1": f"WITH {_CH} SELECT utt, seq, round(ln(s + 1) * 10, 6) AS energy FROM en",
        "endpoint_fixed": f"WITH {_CH}, w AS (SELECT *, count(*) FILTER (voiced) OVER q AS n, max(CASE WHEN voiced THEN seq END) OVER q AS last FROM fl WINDOW q AS (PARTITION BY utt ORDER BY seq ROWS UNBOUNDED PRECEDING)) SELECT utt, min(CASE WHEN voiced THEN seq END) AS start, min(CASE WHEN n >= 3 AND seq - last >= 2 THEN seq END) AS complete FROM w GROUP BY utt",
        "endpoint_adaptive": _ADAPTIVE,
        "noise_floor": f"WITH {_CH} SELECT utt, round(avg(energy), 6) AS floor FROM en WHERE seq BETWEEN 2 AND 5 GROUP BY utt",
        "voiced_run_start": f"WITH {_CH}, g AS (SELECT *, count(*) FILTER (NOT voiced) OVER (PARTITION BY utt ORDER BY seq) AS grp FROM fl), r AS (SELECT *, count(*) FILTER (voiced) OVER (PARTITION BY utt, grp ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT utt, min(CASE WHEN voiced AND run > 2 THEN seq END) AS start FROM r GROUP BY utt",
        "tail_prune": f"WITH {_CH}, r AS (SELECT *, count(*) FILTER (voiced) OVER (PARTITION BY utt ORDER BY seq ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) = 3 AS hit FROM fl) SELECT utt, least(coalesce(max(CASE WHEN hit THEN seq END), min(seq)) + 7, max(seq) + 1) AS keep_chunks FROM r GROUP BY utt",
        "start_rewind": f"WITH {_CH} SELECT utt, greatest(min(CASE WHEN voiced THEN seq END) * 4 - 8, CASE WHEN bool_or(voiced) THEN 0 END) AS start_sample FROM fl GROUP BY utt",
        "recording_cap": f"WITH {_CH} SELECT utt, seq FROM en WHERE seq < 10",
    }
