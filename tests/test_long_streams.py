"""Endpointing rules over blocks of a stream, against one fold of the whole."""

import math
import random

import pytest

from quillspark.operators import endpoint


def stream(rng, n):
    out = []
    while len(out) < n:
        out += [10 + rng.random() for _ in range(rng.randint(1, 40))] + [30 + 5 * rng.random() for _ in range(rng.randint(1, 20))]
    return [None if rng.random() < 0.01 else float("nan") if rng.random() < 0.01 else x for x in out[:n]]


def chunks_of(spark, level, gaps=False):
    rng = random.Random(1)
    rows = [(u, i, e) for u, own in level.items() for i, e in enumerate(own) if not gaps or rng.random() > 0.02]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "utt string, seq long, energy double")


@pytest.mark.parametrize("track,hold", [("level", 0), ("chunk", 20)])
@pytest.mark.parametrize("block", [50, 700, 100_000])
def test_adaptive_is_one_fold_to_the_bit(spark, track, hold, block):
    level = {"a": stream(random.Random(2), 6000), "b": stream(random.Random(3), 30), None: stream(random.Random(4), 120)}
    rows, chunks = chunks_of(spark, level)
    got = {(r.utt, r.seq): (r.level, r.background, r.voiced) for r in endpoint.adaptive(chunks, 5.0, track=track, hold=hold, block=block).collect()}
    assert len(got) == len(rows)
    for u, own in level.items():
        a = endpoint.Adaptive(0.0, 0.0, threshold=5.0, track=track, hold=hold)
        for i, e in enumerate(own):
            voiced = a.step(a.background if e is None or math.isnan(e) else e)
            assert got[u, i] == (a.level, a.background, voiced)
    assert endpoint.adaptive(chunks.limit(0)).count() == 0


@pytest.mark.parametrize("block", [7, 64, 100_000])
@pytest.mark.parametrize("gaps", [False, True])
def test_counting_rules_in_blocks(spark, block, gaps):
    level = {f"s{k}": stream(random.Random(k), n) for k, n in enumerate((1, 5, 90, 400))} | {"quiet": [1.0] * 30, None: stream(random.Random(9), 60)}
    rows, chunks = chunks_of(spark, level, gaps)
    fixed = {r.utt: (r.start, r.complete) for r in endpoint.fixed(chunks, 20.0, 5, 4, block).collect()}
    starts = {r.utt: r.start for r in endpoint.run_start(chunks.selectExpr("utt", "seq", "coalesce(energy > 20 and not isnan(energy), false) as voiced"), 3, block).collect()}
    assert set(fixed) == set(starts) == {u for u, _, _ in rows}
    for u in fixed:
        start = complete = first = last = before = None
        n = run = 0
        for seq, e in sorted((i, e) for v, i, e in rows if v == u):
            voiced = e is not None and (math.isnan(e) or e > 20)  # Spark's order has NaN above all
            n, last = (n + 1, seq) if voiced else (n, last)
            start = seq if voiced and start is None else start
            if complete is None and n >= 5 and seq - last >= 4:
                complete = seq
            loud = voiced and not math.isnan(e)
            run = (run + 1 if before == seq - 1 else 1) if loud else 0
            before = seq if loud else None
            if first is None and run > 3:
                first = seq
        assert (fixed[u], starts[u]) == ((start, complete), first)


@pytest.mark.parametrize("block", [5, 33, 100_000])
def test_tail_in_blocks(spark, block):
    rng = random.Random(block)
    flags = {f"s{k}": [rng.random() < p for _ in range(n)] for k, (n, p) in enumerate(((1, 1), (4, 1), (5, 1), (40, 0.5), (200, 0.8), (300, 0.6), (50, 0)))}
    rows = spark.createDataFrame([(u, i, v) for u, own in flags.items() for i, v in enumerate(own)], "utt string, seq long, voiced boolean")
    got = {r.utt: r.keep_chunks for r in endpoint.tail_prune(rows, 5, 15, block).collect()}
    for u, own in flags.items():
        at = max((i for i in range(len(own)) if len(own[i : i + 5]) == 5 and all(own[i : i + 5])), default=0)
        assert got[u] == min(at + 20, len(own))


@pytest.mark.parametrize("per_block", [1, 3, 2048])
def test_frames_by_blocks(spark, per_block):
    from quillspark.operators import signal

    for p in (signal.small(signal.PY, frame=16, shift=8, fft=32), signal.small(signal.CPP, frame=16, shift=6, fft=32), signal.small(signal.G5, frame=16, shift=20, fft=32)):
        own = {f"u{n}": [float(i * 7 % 11) for i in range(n)] for n in (1, 15, 16, 17, 100)}
        rows = spark.createDataFrame([(u, i, x) for u, xs in own.items() for i, x in enumerate(xs)], "utt string, i long, x double").repartition(3)
        got = {(r.utt, r.f): r.frame for r in signal.frames(rows, p, frames_per_block=per_block).collect()}
        want, left = {}, (32 - 16) // 2 if p.centred else 0
        for u, xs in own.items():
            for f in range(signal._total(len(xs), p)):
                frame = xs[f * p.shift : f * p.shift + 16]
                if frame:
                    want[u, f] = [0.0] * left + frame + [0.0] * (32 - left - len(frame))
        assert got == want
