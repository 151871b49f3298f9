"""Endpointing in batch: chunk energies, fixed and adaptive thresholds, pruning.

Chunks are rows (stream, seq, energy). Counting rules and the adaptive level, which depends on its own
past, are found in blocks of a stream, so that a long one spreads over many tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import discard, small, stored
from .signal import neighbours


def chunk_energy(signal: DataFrame, size: int = 400, form: str = "ln") -> DataFrame:
    """(utt, seq, energy): ln of the chunk's summed squares, or ten times log10 ("db"), or ten times
    ln of the sum plus one ("ln1"); null where there is no energy to take a logarithm of."""
    s = F.sum(F.col("x") * F.col("x"))
    energy = {"ln": F.when(s > 0, F.ln(s)), "db": F.when(s > 0, F.log10(s) * 10), "ln1": F.ln(s + 1) * 10}[form]
    return signal.groupBy("utt", F.floor(F.col("i") / size).alias("seq")).agg(energy.alias("energy"))


#: Chunks of a stream that one task takes in order.
BLOCK = 8192


def _same(*names: str):
    """Rows of one block, null keys included, between aliases x and y."""
    return [F.col(f"x.{n}").eqNullSafe(F.col(f"y.{n}")) for n in names]


def _before(*order: str) -> W:
    return W.partitionBy("utt").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)


def fixed(chunks: DataFrame, threshold: float = 20.0, shortest: int = 5, silence: int = 10, block: int = BLOCK) -> DataFrame:
    """(utt, start, complete): the first voiced chunk, and the chunk at which voiced ones of at least
    `shortest` chunks in all is followed by `silence` silent ones in a row; null where never.

    Blocks of a stream are counted first, so that no task orders more than a block; what stands before a
    block comes from a row a block.
    """
    rows = chunks.withColumn("_b", F.floor(F.col("seq") / block)).withColumn("_v", F.coalesce(F.col("energy") > threshold, F.lit(False)))
    ahead = rows.groupBy("utt", "_b").agg(F.count_if("_v").alias("n"), F.max(F.when(F.col("_v"), F.col("seq"))).alias("last"))
    ahead = ahead.select("utt", "_b", F.coalesce(F.sum("n").over(_before("_b")), F.lit(0)).alias("_n0"), F.max("last").over(_before("_b")).alias("_last0"))
    w = W.partitionBy("utt", "_b").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_n", F.sum(F.col("_v").cast("int")).over(w)).withColumn("_last", F.max(F.when(F.col("_v"), F.col("seq"))).over(w))
    rows = rows.alias("x").join(ahead.alias("y"), _same("utt", "_b")).select("x.utt", "seq", "_v", (F.col("_n") + F.col("_n0")).alias("_n"), F.coalesce("_last", "_last0").alias("_last"))
    done = (F.col("_n") >= shortest) & (F.col("seq") - F.col("_last") >= silence)
    return rows.groupBy("utt").agg(F.min(F.when(F.col("_v"), F.col("seq"))).alias("start"), F.min(F.when(done, F.col("seq"))).alias("complete"))


def noise_floor(chunks: DataFrame, first: int = 10, last: int = 19) -> DataFrame:
    """(utt, floor): the mean energy of the chunks from first to last, both included."""
    return chunks.where(F.col("seq").between(first, last)).groupBy("utt").agg(F.avg("energy").alias("floor"))


@dataclass
class Adaptive:
    """The adaptive classifier's state for one stream. track: what the background falls to when a
    chunk lies below it, the level or the chunk itself."""

    level: float
    background: float
    forget: float = 1.0
    adjustment: float = 0.05
    threshold: float = 10.0
    track: str = "level"
    hold: int = 0  # silent chunks that still count as voiced
    silent: int = field(default=0)

    def step(self, energy: float, offset: float = 0.0) -> bool:
        self.level = (self.level * self.forget + energy) / (self.forget + 1)
        if energy < self.background:
            self.background = self.level if self.track == "level" else energy
        else:
            self.background += (energy - self.background) * self.adjustment
        self.level = max(self.level, self.background)
        if self.level - self.background > self.threshold + offset:
            self.silent = 0
            return True
        self.silent += 1
        return self.silent < self.hold


def adaptive(chunks: DataFrame, threshold: float = 10.0, forget: float = 1.0, adjustment: float = 0.05, track: str = "level", hold: int = 0, start: float = 0.0, block: int = BLOCK) -> DataFrame:
    """(utt, seq, level, background, voiced) of every chunk; a chunk without energy counts as the
    background.

    A stream is folded in blocks at once, each from a guess of the state before it. Those whose guess was not
    what the block before leaves are folded again, until none is: then every block has begun with its
    true state, and the result is that of one fold, to the bit. As the state forgets, a guess matters for some
    hundred to a few thousand chunks, so that a block or two later nothing changes any more; a stream
    that never forgets takes a round a block.
    """
    kind = dict(chunks.dtypes)["utt"]
    state, out = ["level", "background", "silent"], ["out_level", "out_background", "out_silent"]
    first = F.struct(F.lit(float(start)).alias("level"), F.lit(float(start)).alias("background"), F.lit(0).cast("long").alias("silent"))

    def fold(energies, level, background, silent):
        a = Adaptive(level, background, forget, adjustment, threshold, track, hold, silent)
        for e in energies:
            voiced = a.step(a.background if e is None or math.isnan(e) else e)
            yield a, voiced

    def leaves(batches):
        for b in batches:
            got = []
            for e, *entry in zip(*(b.column(c).to_pylist() for c in range(3, 7))):
                a = None
                for a, _ in fold(e, *entry):
                    pass
                got.append((a.level, a.background, min(a.silent, hold)))  # beyond hold it makes no difference
            cols = [pa.array(x, t) for x, t in zip(zip(*got), (pa.float64(), pa.float64(), pa.int64()))] if got else [pa.array([], t) for t in (pa.float64(), pa.float64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(4), b.column(5), b.column(6), *cols], ["utt", "b", *state, *out])

    def rows(batches):
        for b in batches:
            where, seqs, levels, backgrounds, flags = [], [], [], [], []
            for i, (seq, e, *entry) in enumerate(zip(*(b.column(c).to_pylist() for c in range(2, 7)))):
                for a, voiced in fold(e, *entry):
                    levels.append(a.level)
                    backgrounds.append(a.background)
                    flags.append(voiced)
                where += [i] * len(seq)
                seqs += seq
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(where, pa.int64())), pa.array(seqs, pa.int64()), pa.array(levels, pa.float64()), pa.array(backgrounds, pa.float64()), pa.array(flags, pa.bool_())], ["utt", "seq", "level", "background", "voiced"])

    held = chunks.select("utt", F.floor(F.col("seq") / block).cast("long").alias("b"), F.struct(F.col("seq").cast("long").alias("seq"), F.col("energy").cast("double").alias("energy")).alias("c"))
    held = held.groupBy("utt", "b").agg(F.array_sort(F.collect_list("c")).alias("c"))
    held = stored(held.select("utt", "b", F.transform("c", lambda c: c["seq"]).alias("seq"), F.transform("c", lambda c: c["energy"]).alias("energy")))

    def entered(entries: DataFrame) -> DataFrame:
        """Blocks with the states before them."""
        return held.alias("x").join(small(entries).alias("y"), _same("utt", "b")).select("x.utt", "x.b", "x.seq", "x.energy", *state)

    kinds = f"utt {kind}, b long, level double, background double, silent long"

    def folded(df: DataFrame) -> DataFrame:
        return df.mapInArrow(leaves, kinds + ", out_level double, out_background double, out_silent long")

    known = stored(folded(held.withColumn("s", first).select("utt", "b", "seq", "energy", "s.*")))
    while True:
        true = F.coalesce(F.lag(F.struct(*[F.col(o).alias(n) for n, o in zip(state, out)])).over(W.partitionBy("utt").orderBy(F.col("b").asc_nulls_last())), first)
        wrong = known.withColumn("true", true).where(~F.col("true").eqNullSafe(F.struct(*state)))
        wrong = stored(wrong.select("utt", "b", "true.*"))
        if wrong.isEmpty():
            break
        rest = known.alias("x").join(small(wrong.select("utt", "b")).alias("y"), _same("utt", "b"), "left_anti")
        last, known = known, stored(rest.unionByName(folded(entered(wrong))))
        discard(last)
    return entered(known.select("utt", "b", *state)).mapInArrow(rows, f"utt {kind}, seq long, level double, background double, voiced boolean")


@dataclass(frozen=True)
class Rules:
    """How a live stream's utterances are told. Without `adaptive` a chunk is voiced above the
    threshold. Else the first `warm` chunks are only heard: those from floor[0] to floor[1] give the
    background, and the first one the level where first_level says so. An utterance begins with the
    chunk that ends a run of more than start_run voiced ones, until when the threshold is higher by
    `offset`, and is complete after `shortest` voiced chunks and `silence` others in a row, or, with what
    it has, after `most` chunks of the recording."""

    threshold: float = 20.0
    adaptive: bool = False
    forget: float = 1.0
    adjustment: float = 0.05
    track: str = "level"
    hold: int = 0
    warm: int = 0
    floor: tuple[int, int] = (0, -1)
    first_level: bool = False
    offset: float = 0.0
    start_run: int = 0
    shortest: int = 5
    silence: int = 10
    most: int = 2400


#: The three recorders' rules: fixed; with a held tail of half a second; with a run that begins it.
FIXED = Rules()
HELD = Rules(threshold=2.0, adaptive=True, hold=20, warm=10, floor=(0, 9), first_level=True)
RUN = Rules(threshold=40.0, adaptive=True, track="chunk", warm=20, floor=(9, 18), offset=3.0, start_run=6, shortest=7, silence=131)


@dataclass
class Tracker:
    """One stream's place under some rules, in plain numbers that a state store can keep."""

    voiced: int = 0
    silent: int = 0
    start: int = -1
    first: int = -1
    last: int = -1
    heard: int = 0
    run: int = 0
    held: int = 0
    level: float = 0.0
    background: float = 0.0
    floor_sum: float = 0.0

    def _voiced(self, energy: float | None, r: Rules) -> bool:
        none = energy is None or math.isnan(energy)
        if not r.adaptive:
            return not none and energy > r.threshold
        a = Adaptive(self.level, self.background, r.forget, r.adjustment, r.threshold, r.track, r.hold, self.held)
        out = a.step(self.background if none else energy, r.offset if self.start < 0 else 0.0)
        self.level, self.background, self.held = a.level, a.background, a.silent
        return out

    def _warm(self, i: int, energy: float | None, r: Rules) -> None:
        energy = 0.0 if energy is None or math.isnan(energy) else energy
        if i == 0 and r.first_level:
            self.level = energy
        if r.floor[0] <= i <= r.floor[1]:
            self.floor_sum += energy
        if i == r.floor[1]:
            self.background = self.floor_sum / (r.floor[1] - r.floor[0] + 1)

    def step(self, seq: int, energy: float | None, r: Rules) -> tuple[int, int] | None:
        """(start, complete) of the utterance that this chunk ends. A chunk that does not come after the
        last one is late, and is left out."""
        if seq <= self.last:
            return None
        self.last, self.first = seq, seq if self.first < 0 else self.first
        i, self.heard = self.heard, self.heard + 1
        if r.adaptive and i < r.warm:
            self._warm(i, energy, r)
        elif self._voiced(energy, r):
            self.run += 1
            if self.start < 0 and self.run > r.start_run:
                self.start, self.voiced = seq, self.run - 1
            if self.start >= 0:
                self.voiced, self.silent = self.voiced + 1, 0
        else:
            self.run = 0
            self.silent += self.start >= 0
        if self.start >= 0 and self.voiced >= r.shortest and self.silent >= r.silence or seq - self.first + 1 >= r.most:
            return self.end()
        return None

    def end(self) -> tuple[int, int] | None:
        """Ends the recording here: what began is given, and the next one begins anew, with the level
        and the background as they are."""
        out = (self.start, self.last) if self.start >= 0 else None
        self.voiced = self.silent = self.run = self.held = 0
        self.start = self.first = -1
        return out


def utterances(chunks: DataFrame, rules: Rules = FIXED) -> DataFrame:
    """(utt, start, complete) of every complete utterance of each stream, as the live form gives them.
    A stream is folded in one task, with its chunks' energies as one array."""
    kind = dict(chunks.dtypes)["utt"]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("seq")
        tracker, out = Tracker(), []
        for seq, energy in zip(t.column("seq").to_pylist(), t.column("energy").to_pylist()):
            if got := tracker.step(seq, energy, rules):
                out.append(got)
        return pa.table({"utt": pa.array(t.column("utt").to_pylist()[:1] * len(out), t.schema.field("utt").type), "start": pa.array([o[0] for o in out], pa.int64()), "complete": pa.array([o[1] for o in out], pa.int64())})

    return chunks.select("utt", F.col("seq").cast("long").alias("seq"), F.col("energy").cast("double").alias("energy")).groupBy("utt").applyInArrow(run, f"utt {kind}, start long, complete long")


def run_start(flags: DataFrame, need: int = 6, block: int = BLOCK) -> DataFrame:
    """(utt, start): the first chunk that ends a run of more than `need` voiced chunks, whose seq follow one
    another. Runs are found inside blocks; the run that goes on from the block before comes from a row a block."""
    rows = flags.where("voiced").select("utt", "seq", F.floor(F.col("seq") / block).alias("_b"))
    inside = W.partitionBy("utt", "_b").orderBy("seq")
    new = F.lag("seq").over(inside) != F.col("seq") - 1  # null for a block's first
    rows = rows.withColumn("_new", F.when(new, F.col("seq")))
    ends = rows.groupBy("utt", "_b").agg(F.min("seq").alias("low"), F.max("seq").alias("high"), F.max("_new").alias("_new"))
    before = F.lag("high").over(W.partitionBy("utt").orderBy("_b"))
    ends = ends.withColumn("own", F.when(before.isNull() | (before != F.col("low") - 1), F.col("low")))
    ends = ends.select("utt", "_b", F.coalesce("own", F.max(F.coalesce("_new", "own")).over(_before("_b"))).alias("_from"))
    rows = rows.withColumn("_new", F.max("_new").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
    rows = rows.alias("x").join(ends.alias("y"), _same("utt", "_b")).select("x.utt", F.when(F.col("seq") - F.coalesce("_new", "_from") + 1 > need, F.col("seq")).alias("at"))
    return rows.union(flags.select("utt", F.lit(None).cast(flags.schema["seq"].dataType))).groupBy("utt").agg(F.min("at").alias("start"))


def tail_prune(flags: DataFrame, run: int = 5, keep: int = 15, block: int = BLOCK) -> DataFrame:
    """(utt, keep_chunks): back from the end to `run` voiced chunks in a row; those and `keep` more
    stay. Without such a run all before the last look stays. Chunks' seq follow one another; a stream is looked
    through in blocks, which hold the first few chunks of the next."""
    ahead = lambda w: F.count_if("voiced").over(w.rowsBetween(0, run - 1)) == run
    rows = neighbours(flags, ["utt"], "seq", {"_hit": ahead}, after=run - 1, block=max(block, run))
    got = rows.groupBy("utt").agg(F.max("seq").alias("_top"), F.max(F.when(F.col("_hit"), F.col("seq"))).alias("_at"), F.min("seq").alias("_low"))
    end = F.least(F.coalesce("_at", "_low") + run + keep, F.col("_top") + 1)
    return got.select("utt", end.alias("keep_chunks"))


def capped(chunks: DataFrame, seconds: float = 60.0, chunk: int = 400, rate: int = 16000) -> DataFrame:
    """The chunks within the longest recording."""
    return chunks.where(F.col("seq") < math.floor(seconds * rate / chunk))
