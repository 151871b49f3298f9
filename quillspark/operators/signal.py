"""The signal front end: pre-emphasis, framing, spectra, mel bands, cepstra, deltas, normalisation.

Signals are long: (utt, i, x), one row a sample. Frames are rows (utt, f, frame array). Features
are long again: (utt, t, d, v). What looks at neighbours works in blocks of an utterance with the
rows it needs from the next block copied in, so one long utterance spreads over many tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored

BLOCK = 1 << 16


@dataclass(frozen=True)
class Profile:
    """One definition of the features. The three below differ in nearly every step."""

    frame: int = 400
    shift: int = 160
    fft: int = 512
    rate: int = 16000
    centred: bool = False  # where the frame stands in the transform's window
    tail: str = "drop"  # drop, keep (zero-filled last frame) or every (each start inside the signal)
    periodic: bool = False
    power: bool = True
    bands: int = 40
    triangular: bool = True
    ortho: bool = True
    dct: int = 40
    keep: int = 13
    forward: bool = True
    normalise_first: bool = True
    trim: int = 0
    alpha: float = 0.95


PY = Profile()
CPP = Profile(centred=True, tail="keep", periodic=True, triangular=False, ortho=False, forward=False, normalise_first=False)
G5 = Profile(frame=1024, shift=362, fft=1024, rate=44100, tail="every", periodic=True, power=False, ortho=False, dct=64, forward=False, normalise_first=False, trim=2)


def sequence_index(df: DataFrame, key: str, order: list[str], time: str, unit: str = "hour") -> DataFrame:
    """df with i, each row's place (from 0) in its key's order.

    Two levels: rows are counted by unit of time first, so only one unit of one key is ordered in a
    task. order must begin with the time.
    """
    rows = df.withColumn("_unit", F.date_trunc(unit, F.col(time)))
    counts = rows.groupBy(key, "_unit").agg(F.count("*").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy("_unit").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(key).alias("_key"), F.col("_unit").alias("_u"), ahead.alias("_ahead"))
    rows = rows.withColumn("_own", F.row_number().over(W.partitionBy(key, "_unit").orderBy(*order)))
    rows = rows.join(starts, F.col(key).eqNullSafe(F.col("_key")) & F.col("_unit").eqNullSafe(F.col("_u")))
    return rows.withColumn("i", F.col("_ahead") + F.col("_own") - 1).drop("_unit", "_key", "_u", "_own", "_ahead")


def neighbours(df: DataFrame, keys: list[str], index: str, build: dict[str, Column], before: int = 0, after: int = 0, block: int = BLOCK) -> DataFrame:
    """df with the columns of build, window expressions made by calling each with a window over a
    block; the block holds `before` rows and `after` rows of its neighbours as well."""
    own = F.floor(F.col(index) / block)
    blocks = [own]
    if before:
        blocks.append(F.when(F.col(index) % block >= block - before, own + 1))
    if after:
        blocks.append(F.when((F.col(index) % block < after) & (own > 0), own - 1))
    rows = df.withColumn("_block", F.explode(F.array_compact(F.array(*blocks)))) if len(blocks) > 1 else df.withColumn("_block", own)
    w = W.partitionBy(*keys, "_block").orderBy(index)
    rows = rows.withColumns({k: v(w) for k, v in build.items()})
    return rows.where(F.col("_block") == own).drop("_block")


def pre_emphasis(signal: DataFrame, alpha: float = 0.95) -> DataFrame:
    """(utt, i, x) with y: x less alpha times the sample before; the first sample stays."""
    x = F.col("x")
    return neighbours(signal, ["utt"], "i", {"y": lambda w: F.coalesce(x - F.lag("x").over(w) * alpha, x)}, before=1)


def n_frames(n: Column, p: Profile) -> Column:
    if p.tail == "keep":
        return F.greatest(F.ceil((n - p.frame) / p.shift) + 1, F.lit(0))
    if p.tail == "every":
        return F.ceil(n / p.shift)
    return F.greatest(F.floor((n - p.frame) / p.shift) + 1, F.lit(0))


def frames(signal: DataFrame, p: Profile = PY, value: str = "x", frames_per_block: int = 2048) -> DataFrame:
    """(utt, f, frame array of p.fft): overlapping frames, zero-filled to the transform's width.

    Samples are gathered by blocks of frames; one is in one block, but for those that a frame of the next
    block needs too. Frames are slices of their block's samples. i counts an utterance's samples from 0.
    """
    length = signal.groupBy("utt").agg((F.max("i") + 1).alias("n")).select(F.col("utt").alias("u"), n_frames(F.col("n"), p).alias("frames"))
    first = F.greatest(F.ceil((F.col("i") - p.frame + 1) / p.shift), F.lit(0))
    last = F.floor(F.col("i") / p.shift)
    at = lambda f: F.floor(f / frames_per_block).cast("long")
    rows = signal.select("utt", F.struct(F.col("i").cast("long").alias("i"), F.col(value).cast("double").alias("v")).alias("s"), F.explode(F.sequence(at(F.least(first, last)), at(last))).alias("b"))
    got = rows.groupBy("utt", "b").agg(F.array_sort(F.collect_list("s")).alias("s"))
    got = got.join(length, F.col("utt").eqNullSafe(F.col("u"))).select("utt", "b", "frames", F.col("s")[0]["i"].alias("first"), F.transform("s", lambda s: s["v"]).alias("x"))
    low, high = F.col("b") * frames_per_block, F.least((F.col("b") + 1) * frames_per_block, F.col("frames")) - 1
    cut = lambda f: F.struct(f.alias("f"), F.slice("x", (f * p.shift - F.col("first") + 1).cast("int"), F.lit(p.frame)).alias("frame"))
    # Slices first, so that no row carries its block's samples.
    got = got.where(low <= high).select("utt", F.transform(F.sequence(low, high), cut).alias("c")).select("utt", F.explode("c").alias("c")).select("utt", "c.*")
    left = (p.fft - p.frame) // 2 if p.centred else 0
    zero = F.lit(0.0)
    return got.withColumn("frame", F.concat(F.array_repeat(zero, left), F.col("frame"), F.array_repeat(zero, F.lit(p.fft - left) - F.size("frame"))))


def hamming(p: Profile) -> list[float]:
    """The window over the transform's width; 0 where the frame's zero filling stands."""
    n, left = (p.frame if p.periodic else p.frame - 1), (p.fft - p.frame) // 2 if p.centred else 0
    w = [0.54 - 0.46 * math.cos(2 * math.pi * j / n) for j in range(p.frame)]
    return [0.0] * left + w + [0.0] * (p.fft - left - p.frame)


def windowed(framed: DataFrame, p: Profile = PY) -> DataFrame:
    weights = F.array(*[F.lit(w) for w in hamming(p)])
    return framed.withColumn("frame", F.zip_with("frame", weights, lambda a, b: a * b))


def mel_bank(p: Profile) -> np.ndarray:
    """Bands by bins. Triangular: peaks of 1 at equally spaced mels. Rectangular: each bin weighs 1
    in the band that its mel falls into, which is what adding both slopes to one band comes to; bins
    below the first band are dropped."""
    bins = p.fft // 2 + 1
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    hz = np.arange(bins) * (p.rate / p.fft)
    edges = np.linspace(0, mel(p.rate / 2), p.bands + 2)
    if p.triangular:
        cut = 700 * (10 ** (edges / 2595) - 1)
        up = (hz[None, :] - cut[:-2, None]) / (cut[1:-1] - cut[:-2])[:, None]
        down = (cut[2:, None] - hz[None, :]) / (cut[2:] - cut[1:-1])[:, None]
        return np.maximum(np.minimum(up, down), 0)
    step = edges[1]
    slot = np.floor(mel(hz) / step).astype(int)
    bank = np.zeros((p.bands, bins))
    for j, s in enumerate(slot):
        if 1 <= s < p.bands:
            bank[s - 1, j] = 1
        elif s >= p.bands and s - 1 < p.bands:
            bank[s - 1, j] = 1 - (mel(hz[j]) - step * s) / step
    return bank


def dct_matrix(p: Profile) -> np.ndarray:
    """Cepstra by inputs: the cosine transform of p.dct values, orthonormal or doubled."""
    j, k = np.arange(p.dct), np.arange(p.keep)
    m = np.cos(math.pi * (j[None, :] + 0.5) * k[:, None] / p.dct)
    if not p.ortho:
        return 2 * m
    return m * np.where(k == 0, math.sqrt(1 / p.dct), math.sqrt(2 / p.dct))[:, None]


def _per_frame(framed: DataFrame, name: str, f) -> DataFrame:
    """framed (utt, f, frame) with the array `name` in place of frame: f maps a batch's matrix."""
    kind = dict(framed.dtypes)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            y = f(x)
            flat = pa.array(y.ravel(), from_pandas=False)
            offsets = pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(offsets, flat)], ["utt", "f", name])

    return framed.select("utt", "f", "frame").mapInArrow(run, f"utt {kind['utt']}, f {kind['f']}, {name} array<double>")


def spectrum(framed: DataFrame, p: Profile = PY) -> DataFrame:
    """(utt, f, spectrum): power, or magnitude, of bins 0 to p.fft / 2."""

    def f(x):
        s = np.abs(np.fft.rfft(x, axis=1))
        return s * s if p.power else s

    return _per_frame(framed, "spectrum", f)


def _matrix_product(values: Column, matrix: np.ndarray) -> Column:
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in matrix])
    return F.transform(rows, lambda row: F.aggregate(F.zip_with(row, values, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))


def log_mel(spectra: DataFrame, p: Profile = PY) -> DataFrame:
    """(utt, f, logmel): logs of the bands' sums; an empty band is null."""
    bands = _matrix_product(F.col("spectrum"), mel_bank(p))
    return spectra.select("utt", "f", F.transform(bands, lambda x: F.when(x > 0, F.ln(x))).alias("logmel"))


def cepstra(logmels: DataFrame, p: Profile = PY) -> DataFrame:
    """(utt, f, cepstra): p.keep values; bands beyond p.bands count as zero."""
    pad = F.concat("logmel", F.array_repeat(F.lit(0.0), p.dct - p.bands)) if p.dct > p.bands else F.col("logmel")
    return logmels.select("utt", "f", _matrix_product(pad, dct_matrix(p)).alias("cepstra"))


def cepstra_direct(framed: DataFrame, p: Profile = PY) -> DataFrame:
    """Window to cepstra in one pass over Arrow batches: the form for production sizes."""
    weights, bank, turn = np.array(hamming(p)), mel_bank(p), dct_matrix(p)

    def f(x):
        s = np.abs(np.fft.rfft(x * weights, axis=1))
        m = (s * s if p.power else s) @ bank.T
        logs = np.log(np.where(m > 0, m, np.nan))
        if p.dct > p.bands:
            logs = np.hstack([logs, np.zeros((len(logs), p.dct - p.bands))])
        return logs @ turn.T

    return _per_frame(framed, "cepstra", f)


def long_form(df: DataFrame, name: str) -> DataFrame:
    """(utt, t, d, v) of an array column."""
    return df.select("utt", F.col("f").alias("t"), F.posexplode(name).alias("d", "v"))


def _last(features: DataFrame) -> DataFrame:
    return features.groupBy("utt").agg(F.max("t").alias("last"))


def delta_central(features: DataFrame, value: str = "v", name: str = "delta", edge: int = 1) -> DataFrame:
    """With the next value less the one before; 0 in the first and last `edge` frames."""
    rows = neighbours(features, ["utt", "d"], "t", {"_a": lambda w: F.lag(value).over(w), "_b": lambda w: F.lead(value).over(w)}, before=1, after=1)
    last = _last(features).withColumnRenamed("utt", "u")
    rows = rows.join(last, F.col("utt").eqNullSafe(F.col("u")))
    inside = (F.col("t") >= edge) & (F.col("t") <= F.col("last") - edge)
    return rows.withColumn(name, F.when(inside, F.coalesce(F.col("_b") - F.col("_a"), F.lit(0.0))).otherwise(0.0)).drop("_a", "_b", "u", "last")


def delta_forward(features: DataFrame, value: str = "v", name: str = "delta") -> DataFrame:
    """With the next value less this one; the last frame repeats its own value."""
    x = F.col(value)
    return neighbours(features, ["utt", "d"], "t", {name: lambda w: F.coalesce(F.lead(value).over(w) - x, x)}, after=1)


def z_score(features: DataFrame, value: str = "v") -> DataFrame:
    """value less its mean over its population deviation, by utterance and dimension; null where the
    deviation is 0. Sums are combined before the shuffle and joined back."""
    stats = features.groupBy(F.col("utt").alias("u"), F.col("d").alias("e")).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    rows = features.join(stats, F.col("utt").eqNullSafe(F.col("u")) & (F.col("d") == F.col("e")))
    return rows.withColumn(value, F.try_divide(F.col(value) - F.col("_m"), F.col("_s"))).drop("u", "e", "_m", "_s")


def edge_trim(features: DataFrame, n: int = 2) -> DataFrame:
    """Without the first and last n frames of each utterance; frames are numbered anew."""
    last = _last(features).withColumnRenamed("utt", "u")
    rows = features.join(last, F.col("utt").eqNullSafe(F.col("u")))
    return rows.where((F.col("t") >= n) & (F.col("t") <= F.col("last") - n)).withColumn("t", F.col("t") - n).drop("u", "last")


def vectors(features: DataFrame, value: str = "v") -> DataFrame:
    """(utt, t, vec) from long features."""
    return features.groupBy("utt", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", F.col(value).alias("x")))), lambda s: s["x"]).alias("vec"))


#: Frames that one block owns, and frames that it holds besides on either side for the differences.
FRAMES, HALO = 2048, 2


def sample_blocks(signal: DataFrame, p: Profile = PY, frames_per_block: int = FRAMES) -> DataFrame:
    """(utt, b, n, first, x array<double>): the samples that block b's frames need, from place `first` on,
    of an utterance of n. A sample is in one block, but for those near a block's ends, which are in two."""
    length = signal.groupBy(F.col("utt").alias("u")).agg((F.max("i") + 1).alias("n"))
    low = F.greatest(F.ceil((F.col("i") - p.frame + 1) / p.shift) - HALO, F.lit(0))
    high = F.floor((F.col("i") + 1) / p.shift) + HALO
    rows = signal.withColumn("b", F.explode(F.sequence(F.floor(low / frames_per_block), F.floor(high / frames_per_block))))
    got = rows.groupBy("utt", "b").agg(F.array_sort(F.collect_list(F.struct("i", F.col("x").cast("double").alias("x")))).alias("s"))
    got = got.join(length, F.col("utt").eqNullSafe(F.col("u")))
    return got.select("utt", "b", "n", F.col("s")[0]["i"].alias("first"), F.transform("s", lambda s: s["x"]).alias("x"))


def array_blocks(recordings: DataFrame, p: Profile = PY, frames_per_block: int = FRAMES) -> DataFrame:
    """sample_blocks() of recordings (utt, samples array), cut from the arrays: no row a sample."""
    n = F.size("samples").cast("long")
    blocks = F.sequence(F.lit(0).cast("long"), F.floor(F.floor(F.greatest(n - 1, F.lit(0)) / p.shift) / frames_per_block))

    def cut(b: Column) -> Column:
        first = F.greatest((b * frames_per_block - HALO) * p.shift - 1, F.lit(0))
        size = ((b + 1) * frames_per_block + HALO) * p.shift + p.frame - first
        x = F.slice("samples", (first + 1).cast("int"), size.cast("int"))
        return F.struct(b.alias("b"), first.alias("first"), F.transform(x, lambda v: v.cast("double")).alias("x"))

    # Cut first, so that no row carries the whole recording.
    rows = recordings.where(F.size("samples") > 0).select("utt", n.alias("n"), F.transform(blocks, cut).alias("c"))
    return rows.select("utt", "n", F.explode("c").alias("c")).select("utt", "c.b", "n", "c.first", "c.x")


def _total(n: int, p: Profile) -> int:
    return {"drop": max(0, (n - p.frame) // p.shift + 1), "keep": max(0, -(-(n - p.frame) // p.shift) + 1), "every": -(-n // p.shift)}[p.tail]


def _cepstra_of(x: np.ndarray, first: int, n: int, low: int, high: int, p: Profile, weights: np.ndarray, bank: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """The cepstra of frames low to high of an utterance of n samples, of which x begins at first."""
    y = x.copy()
    y[1:] -= p.alpha * x[:-1]
    at = np.arange(low, high)[:, None] * p.shift + np.arange(p.frame)[None, :]
    inside = at < n
    left = (p.fft - p.frame) // 2 if p.centred else 0
    frame = np.zeros((high - low, p.fft))
    frame[:, left : left + p.frame] = np.where(inside, y[np.where(inside, at - first, 0)], 0.0)
    s = np.abs(np.fft.rfft(frame * weights, axis=1))
    m = (s * s if p.power else s) @ bank.T
    logs = np.log(np.where(m > 0, m, np.nan))
    if p.dct > p.bands:
        logs = np.hstack([logs, np.zeros((len(logs), p.dct - p.bands))])
    return logs @ turn.T


def _differences(base: np.ndarray, low: int, total: int, p: Profile) -> np.ndarray:
    """base, of frames from low on, with first and second differences beside it; right for all but the
    HALO frames at an end that is not the utterance's."""
    t, last = np.arange(low, low + len(base))[:, None], total - 1

    def central(v, edge):
        d = np.zeros_like(v)
        d[1:-1] = v[2:] - v[:-2]
        return np.where((t >= edge) & (t <= last - edge), d, 0.0)

    def forward(v):
        return np.where(t < last, np.vstack([v[1:] - v[:-1], v[-1:]]), v)

    one = forward(base) if p.forward else central(base, 1)
    two = forward(one) if p.forward else central(one, 2)
    return np.hstack([base, one, two])


def mfcc_blocks(blocks: DataFrame, p: Profile = PY, frames_per_block: int = FRAMES) -> DataFrame:
    """(utt, t, vec): cepstra with first and second differences under one profile, from the blocks of
    sample_blocks() or array_blocks().

    A block goes from samples to cepstra as matrices in one pass. Its values' counts, means and squared
    deviations are merged by utterance, and come back to the block for the normalisation. A frame
    without energy in a band is null and counts in no mean; a dimension that does not vary is null.
    """
    kind = dict(blocks.dtypes)["utt"]
    weights, bank, turn, k = np.array(hamming(p)), mel_bank(p), dct_matrix(p), p.keep * (1 if p.normalise_first else 3)
    doubles = pa.list_(pa.float64())

    def own(b: int, total: int) -> tuple[int, int]:
        """The frames that block b gives, those that a trim leaves out not among them."""
        trim = p.trim
        return max(b * frames_per_block, trim), min((b + 1) * frames_per_block, total - trim)

    def first_pass(batches):
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                b, n, first = (batch.column(c)[i].as_py() for c in (1, 2, 3))
                total = _total(n, p)
                low, high = max(0, b * frames_per_block - HALO), min(total, (b + 1) * frames_per_block + HALO)
                start, end = own(b, total)
                if start >= end:
                    continue
                x = np.array(batch.column(4)[i].values.to_numpy(zero_copy_only=False), float)
                v = _cepstra_of(x, first, n, low, high, p, weights, bank, turn)
                if not p.normalise_first:
                    v = _differences(v, low, total, p)
                mine = v[start - low : end - low]
                some = ~np.isnan(mine)
                count = some.sum(0)
                zero = np.array([c[s][0] if s.any() else 0.0 for c, s in zip(mine.T, some.T)])  # so that what does not vary has no deviation
                mean = np.where(some, mine - zero, 0.0).sum(0) / np.maximum(count, 1)
                square = np.where(some, (mine - zero - mean) ** 2, 0.0).sum(0)
                rows.append((i, b, total, low, v.ravel(), count.astype(float), mean + zero, square))
            cols = list(zip(*rows)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *[pa.array(c, pa.int64()) for c in cols[1:4]], *[pa.array(list(c), doubles) for c in cols[4:]]], ["utt", "b", "total", "low", "v", "count", "mean", "square"])

    done = stored(blocks.select("utt", "b", "n", "first", "x").mapInArrow(first_pass, f"utt {kind}, b long, total long, low long, v array<double>, count array<double>, mean array<double>, square array<double>"))
    part = done.select(F.col("utt").alias("u"), F.posexplode(F.arrays_zip("count", "mean", "square")).alias("d", "z")).select("u", "d", "z.*")
    mean = part.groupBy("u", "d").agg((F.try_divide(F.sum(F.col("count") * F.col("mean")), F.sum("count"))).alias("m"), F.sum("count").alias("n"), F.min("mean").alias("lo"), F.max("mean").alias("hi"))
    both = part.join(mean.select(F.col("u").alias("mu"), F.col("d").alias("md"), "m", "n", "lo", "hi"), F.col("u").eqNullSafe(F.col("mu")) & (F.col("d") == F.col("md")))
    apart = F.when(F.col("lo") == F.col("hi"), 0.0).otherwise(F.col("mean") - F.col("m"))
    spread = both.groupBy("u", "d").agg(F.first("m").alias("m"), F.sqrt(F.try_divide(F.sum(F.col("square") + F.col("count") * apart * apart), F.first("n"))).alias("s"))
    stats = spread.groupBy("u").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", F.coalesce("m", F.lit(0.0)).alias("m"), F.coalesce("s", F.lit(0.0)).alias("s")))), lambda z: F.struct(z.m.alias("m"), z.s.alias("s"))).alias("z"))
    rows = done.join(stats, F.col("utt").eqNullSafe(F.col("u"))).select("utt", "b", "total", "low", "v", F.transform("z", lambda z: z.m).alias("m"), F.transform("z", lambda z: z.s).alias("s"))

    def second_pass(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                b, total, low = (batch.column(c)[i].as_py() for c in (1, 2, 3))
                v, m, s = (batch.column(c)[i].values.to_numpy() for c in (4, 5, 6))
                v = (v.reshape(-1, k) - m) / np.where(s > 0, s, np.nan)
                if p.normalise_first:
                    v = _differences(v, low, total, p)
                start, end = own(b, total)
                v = v[start - low : end - low]
                flat = pa.array(v.ravel(), from_pandas=True)  # not a number: null
                offsets = pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(v), batch.column(0).type), pa.array(np.arange(start - p.trim, end - p.trim)), pa.ListArray.from_arrays(offsets, flat)], ["utt", "t", "vec"])

    return rows.mapInArrow(second_pass, f"utt {kind}, t long, vec array<double>")


def mfcc(signal: DataFrame, p: Profile = PY, frames_per_block: int = FRAMES) -> DataFrame:
    """mfcc_blocks() of a signal (utt, i, x)."""
    return mfcc_blocks(sample_blocks(signal, p, frames_per_block), p, frames_per_block)


def stages(signal: DataFrame, p: Profile = PY) -> dict[str, DataFrame]:
    """Every intermediate of mfcc() by name, for inspection; lazy, nothing is written."""
    y = pre_emphasis(signal, p.alpha)
    framed = frames(y, p, "y")
    shaped = windowed(framed, p)
    spectra = spectrum(shaped, p)
    logs = log_mel(spectra, p)
    cep = cepstra(logs, p)
    return {"preemphasis": y, "frames": framed, "window": shaped, "spectrum": spectra, "logmel": logs, "cepstra": cep, "mfcc": mfcc(signal, p)}


def small(p: Profile, **kw) -> Profile:
    """p with some values changed."""
    return replace(p, **kw)
