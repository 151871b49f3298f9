"""Hand-computed cases, brute force and invariants of the library's operators."""

import math
import os
import random
import struct
import time
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.operators import endpoint, gauss, grammar, relational, scoring, signal, training, trellis
from quillspark.sources import models, wav
from quillspark.streaming import endpointer


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def wave_of(spark, *signals):
    return spark.createDataFrame([(f"u{k}", i, float(x)) for k, s in enumerate(signals) for i, x in enumerate(s)], "utt string, i long, x double")


def by_frame(df, name):
    out = {}
    for r in df.collect():
        out.setdefault(r.utt, {})[r.f if "f" in df.columns else r.t] = r[name]
    return {u: np.array([fs[k] for k in sorted(fs)], float) for u, fs in out.items()}


# --- columns


def test_costs(spark):
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert value(spark, C.gaussian_cost(arr(1), arr(0), arr(1))) == pytest.approx(1.418939, abs=1e-6)
    comps = F.array(*[F.struct(F.lit(a).alias("alpha"), arr(m).alias("mean"), arr(1).alias("var")) for a, m in ((0.5, 0), (0.5, 2), (0.0, 5))])
    assert value(spark, C.mixture_cost(arr(0), comps)) == pytest.approx(1.485158, abs=1e-6)
    assert value(spark, C.mixture_cost(arr(0), comps, 2)) == pytest.approx(1.485158 + math.log(2), abs=1e-6)
    assert value(spark, C.cluster_score(arr(1), arr(0), arr(1), F.lit(0.5))) == pytest.approx(1.418939 + math.log(2), abs=1e-6)
    assert value(spark, C.squared_distance(arr(1, 2), arr(4, 6))) == 25.0
    assert value(spark, C.safe_ln(F.lit(0.0))) is None


def test_labels(spark):
    assert value(spark, C.filename_label(F.lit("FBH_8O39A"))) == [10, 8, 11, 3, 9]
    assert value(spark, C.word_to_digit(F.lit("Oh"), 0)) == 0 and value(spark, C.word_to_digit(F.lit("what"))) is None
    assert value(spark, C.edit_distance(F.lit("12"), F.lit("12345"))) == 3
    assert [value(spark, C.edit_distance(F.lit(a), F.lit(b), True)) for a, b in (("123", "123"), ("12", "12345"))] == [3, 5]
    assert value(spark, C.boundary_offsets(F.array(F.lit("sil"), F.lit("1"), F.lit("sil")), F.lit("sil"))) == [0, 2, 7]
    assert value(spark, C.quoted_digit(F.lit('0_"7"_1_state_3'))) == "7"


# --- signal


def test_pre_emphasis_and_blocks(spark):
    got = signal.pre_emphasis(wave_of(spark, [10, 20, 30])).orderBy("i").collect()
    assert [r.y for r in got] == [10.0, 10.5, 11.0]
    rng = np.random.default_rng(0).normal(size=50)
    w = wave_of(spark, rng)
    rows = signal.neighbours(w, ["utt"], "i", {"a": lambda v: F.lag("x").over(v), "b": lambda v: F.lead("x").over(v)}, before=1, after=1, block=7).orderBy("i").collect()
    assert [r.a for r in rows] == [None, *rng[:-1]] and [r.b for r in rows] == [*rng[1:], None]


@pytest.mark.parametrize(("profile", "n"), [(signal.CPP, 5), (signal.PY, 4), (signal.G5, 3)])
def test_frame_counts(spark, profile, n):
    assert signal.frames(wave_of(spark, range(1000)), profile).count() == n


def test_deltas(spark):
    f = spark.createDataFrame([("u", t, 0, float(v)) for t, v in enumerate((1, 4, 9, 16, 25))], "utt string, t long, d int, v double")
    pick = lambda df, c: [r[c] for r in df.orderBy("t").collect()]
    central = signal.delta_central(f)
    assert pick(central, "delta") == [0, 8, 12, 16, 0]
    assert pick(signal.delta_central(central, "delta", "d2", 2), "d2") == [0, 0, 8, 0, 0]
    forward = signal.delta_forward(f)
    assert pick(forward, "delta") == [3, 5, 7, 9, 25] and pick(signal.delta_forward(forward, "delta", "d2"), "d2") == [2, 2, 2, 16, 25]
    z = signal.z_score(f.where("t < 3").withColumn("v", F.col("t") + 1.0))
    assert pick(z, "v") == pytest.approx([-1.224745, 0, 1.224745], abs=1e-6)
    assert signal.edge_trim(f, 2).select("t", "v").collect() == [(0, 9.0)]


def slow_mfcc(x, p):
    y = np.append(x[0], x[1:] - p.alpha * x[:-1])
    n = len(x)
    count = {"keep": math.ceil((n - p.frame) / p.shift) + 1, "drop": (n - p.frame) // p.shift + 1, "every": math.ceil(n / p.shift)}[p.tail]
    off = (p.fft - p.frame) // 2 if p.centred else 0
    cep = []
    for f in range(count):
        part = y[f * p.shift : f * p.shift + p.frame]
        buf = np.zeros(p.fft)
        k = np.arange(len(part))
        buf[off : off + len(part)] = part * (0.54 - 0.46 * np.cos(2 * np.pi * k / (p.frame if p.periodic else p.frame - 1)))
        s = np.abs(np.fft.fft(buf))[: p.fft // 2 + 1]
        m = signal.mel_bank(p) @ (s**2 if p.power else s)
        logs = np.append(np.log(m), np.zeros(max(0, p.dct - p.bands)))
        j = np.arange(p.dct)
        c = [sum(logs * np.cos(np.pi * (j + 0.5) * i / p.dct)) for i in range(p.keep)]
        cep.append([v * ((math.sqrt((1 if i == 0 else 2) / p.dct)) if p.ortho else 2) for i, v in enumerate(c)])
    c = np.array(cep)
    norm = lambda a: (a - a.mean(0)) / a.std(0)
    if p.normalise_first:
        c = norm(c)
    if p.forward:
        d1 = np.vstack([c[1:] - c[:-1], c[-1:]])
        d2 = np.vstack([d1[1:] - d1[:-1], d1[-1:]])
    else:
        d1, d2 = np.zeros_like(c), np.zeros_like(c)
        d1[1:-1] = c[2:] - c[:-2]
        d2[2:-2] = d1[3:-1] - d1[1:-3]
    out = np.hstack([c, d1, d2])
    if p.trim:
        out = out[p.trim : -p.trim]
    return out if p.normalise_first else norm(out)


@pytest.mark.parametrize("profile", [
    signal.PY, signal.CPP, signal.small(signal.G5, rate=44100),
])
def test_mfcc_matches_direct_computation(spark, profile):
    x = np.random.default_rng(3).normal(scale=1000, size=4000).round()
    with np.errstate(divide="ignore"):
        want = slow_mfcc(x, profile)
    if not np.isfinite(want).all():
        pytest.skip("an empty band at this width")
    got = by_frame(signal.mfcc(wave_of(spark, x), profile), "vec")["u0"]
    assert got.shape == want.shape and np.allclose(got, want, atol=1e-6)


def test_stages_agree_with_the_direct_form(spark):
    w = wave_of(spark, np.random.default_rng(4).normal(size=1200))
    p = signal.PY
    a = by_frame(signal.stages(w, p)["cepstra"], "cepstra")["u0"]
    b = by_frame(signal.cepstra_direct(signal.frames(signal.pre_emphasis(w), p, "y"), p), "cepstra")["u0"]
    assert np.allclose(a, b, atol=1e-8)


def test_mel_banks():
    tri, rect = signal.mel_bank(signal.PY), signal.mel_bank(signal.CPP)
    assert tri.shape == rect.shape == (40, 257) and tri.max() <= 1 and set(np.unique(rect[:-1])) <= {0.0, 1.0}


# --- models


def test_gaussians_and_classes(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 3, [float(v) for v in rng.normal(3 * (i % 3), 1, 4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, model int, vec array<double>")
    fitted = {r.model: r for r in gauss.fit(df, ["model"]).collect()}
    x = np.array([v for _, m, v in rows if m == 1])
    assert np.allclose(fitted[1].mean, x.mean(0)) and np.allclose(fitted[1].var, x.var(0)) and fitted[1].n == 100
    out = gauss.classify(df.withColumnRenamed("model", "label"), gauss.fit(df, ["model"]), ["id", "label"]).collect()
    assert sum(r.label == r.predicted for r in out) > 285
    tie = spark.createDataFrame([(2, [0.0], [1.0]), (1, [0.0], [1.0])], "model int, mean array<double>, var array<double>")
    assert gauss.classify(spark.createDataFrame([(0, [1.0])], "id int, vec array<double>"), tie, ["id"]).first().predicted == 1


def test_starved_components(spark):
    """Every component gets two frames where there are enough to share; nothing changes where not."""
    rows = [(i, 0, [float(i)], 0) for i in range(8)] + [(i, 1, [float(i)], 0) for i in range(3)] + [(9, 0, [50.0], 1)]
    got = spark.createDataFrame(rows, "id int, model int, vec array<double>, g int")
    comps = spark.createDataFrame([(m, g, 1.0, [at], [1.0]) for m in (0, 1) for g, at in enumerate((3.0, 5.0, -9.0))], "model int, g int, alpha double, mean array<double>, var array<double>")
    out = {(r.model, r.id): r.g for r in gauss.repaired(got, comps, ["model"], "id").collect()}
    assert [out[0, i] for i in range(8)] == [2, 2, 0, 0, 1, 1, 0, 0] and out[0, 9] == 1
    assert [out[1, i] for i in range(3)] == [0, 0, 0]
    assert gauss.repaired(got.limit(0), comps, ["model"], "id").count() == 0


def test_clustered_components(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(-6, 1, 200), rng.normal(0, 1, 200), rng.normal(6, 1, 200)])
    df = spark.createDataFrame([(i, i % 2, [float(v)]) for i, v in enumerate(x)], "id long, model int, vec array<double>")
    out = gauss.clustered_components(df, ["model"], "id", 3, epsilon=0.01).collect()
    for m in (0, 1):
        own = sorted((r.mean[0], r.alpha) for r in out if r.model == m)
        assert [v for v, _ in own] == pytest.approx([-6, 0, 6], abs=0.5) and sum(a for _, a in own) == pytest.approx(1)
    same = spark.createDataFrame([(i, 0, [1.0 + (i == 0)]) for i in range(9)], "id long, model int, vec array<double>")
    assert len(gauss.clustered_components(same, ["model"], "id", 3).collect()) == 3


def test_mixtures(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(-4, 1, 300), rng.normal(4, 1, 100)])
    df = spark.createDataFrame([(i, 0, [float(v)]) for i, v in enumerate(x)], "id long, model int, vec array<double>")
    one = gauss.fit(df, ["model"]).withColumns({"g": F.lit(0), "alpha": F.lit(1.0)}).drop("n")
    two = gauss.split(one).orderBy("g").collect()
    assert [r.alpha for r in two] == [0.5, 0.5] and two[0].mean[0] == pytest.approx(x.mean() * 1.01) and two[0].var == two[1].var
    start = gauss.initial_components(df, ["model"], 2)
    hard = sorted((r.mean[0], r.alpha) for r in gauss.hard_cluster(df, start, ["model"]).collect())
    soft = sorted((r.mean[0], r.alpha) for r in gauss.em(df, start, ["model"], epsilon=0.01).collect())
    for got in (hard, soft):
        assert [m for m, _ in got] == pytest.approx([-4, 4], abs=0.3) and got[0][1] == pytest.approx(0.75, abs=0.02)
    p = gauss.posterior(df, start, ["model"]).select(F.aggregate("gamma", F.lit(0.0), lambda s, c: s + c["p"]).alias("s")).collect()
    assert all(abs(r.s - 1) < 0.002 for r in p)


def brute_path(e, stay, move, skip=None):
    n, best = e.shape[1], (math.inf, ())
    import itertools

    for path in itertools.product(range(n), repeat=len(e)):
        if path[0] != 0 or path[-1] != n - 1:
            continue
        c = e[0, 0]
        for t in range(1, len(e)):
            step = path[t] - path[t - 1]
            if step == 0:
                c += stay[path[t]]
            elif step == 1:
                c += move[path[t - 1]]
            elif step == 2 and skip:
                c += skip[path[t - 1]]
            else:
                c = math.inf
                break
            c += e[t, path[t]]
        best = min(best, (c, path))
    return best


def test_trellis_forms_agree_with_brute_force(spark):
    rng = np.random.default_rng(5)
    stay, move, skip = [0.1, 0.4, 0.2], [0.3, 0.2, 0.0], [0.9, 0.5, 0.0]
    cases = [rng.uniform(0, 3, (n, 3)) for n in (3, 4, 6, 7)]
    df = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(cases)], "utt int, e array<array<double>>")
    for sk in (None, skip):
        want = [brute_path(c, stay, move, sk) for c in cases]
        fold = [r.c for r in df.select("utt", F.get(trellis.chain_fold(F.col("e"), 3, stay, move, sk), F.lit(2)).alias("c")).orderBy("utt").collect()]
        arrow = trellis.align(df, trellis.Graph.chain(stay, move, sk)).orderBy("utt").collect()
        assert fold == pytest.approx([c for c, _ in want]) and [r.cost for r in arrow] == pytest.approx([c for c, _ in want])
        assert [tuple(r.path) for r in arrow] == [p for _, p in want]
    wide = trellis.align(df, trellis.Graph.chain(stay, move), beam=1e9).orderBy("utt").collect()
    assert [r.path for r in wide] == [r.path for r in trellis.align(df, trellis.Graph.chain(stay, move)).orderBy("utt").collect()]


def test_trellis_cases():
    e = np.array([[1, 5], [2, 1], [4, 0.5]], float)
    g = trellis.Graph.chain([0.1, 0.2], [0.3, 0])
    assert trellis.best_path(e, g) == (pytest.approx(3.0), [0, 1, 1])
    assert trellis.best_path(np.zeros((1, 2)), g) == (math.inf, []) and trellis.best_path(np.zeros((0, 2)), g) == (math.inf, [])
    tie = np.zeros((3, 2))
    same = trellis.Graph.chain([0, 0], [0, 0])
    assert trellis.best_path(tie, same)[1] == [0, 1, 1] and trellis.best_path(tie, same, prefer_move=True)[1] == [0, 0, 1]


def test_uniform_and_greedy(spark):
    assert value(spark, trellis.uniform_starts(F.lit(17))) == [0, 3, 6, 10, 13]
    e = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ((0.0, 9.0), (0.0, 9.0), (1.0, 5.0), (9.0, 1.0), (9.0, 0.0))])
    r = value(spark, trellis.greedy_fold(e, [0.0, 0.0], [0.5, 0.0]))
    assert (r.state, r.cost) == (1, 1.0 + 1.5)


def test_grammar(spark):
    lines = ["N_States: 3", 'Edge 0 1 "2""', 'Edge 1 2 "0"', "", "Edge 2 0", "junk"]
    edges = grammar.parse(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [tuple(r) for r in edges.collect()] == [(0, 1, "2"), (1, 2, "0"), (2, 0, None)]
    assert {(r.state, r.steps) for r in grammar.reachable(edges).collect()} == {(0, 0), (1, 1), (2, 2)}


def decode(e, edges, words, start, end, penalty):
    m = {w: {"emit": [i], "stay": [0.0], "move": [0.0]} for i, w in enumerate(words)}
    graph, entries = grammar.compile_graph(edges, m, start, end, penalty)
    cost, path = trellis.best_path(e, graph)
    return cost, "".join(trellis.words_of(path, graph, entries))


def test_decoding_finds_the_cheapest_sentence():
    import itertools

    rng = np.random.default_rng(7)
    words = "ab"
    fixed = [(0, 1, w) for w in words] + [(1, 2, w) for w in words] + [(2, 3, "a"), (1, 3, None)]
    for _ in range(20):
        e = rng.uniform(0, 4, (5, 2))
        best = math.inf
        for sentence in [s for n in (1, 3) for s in itertools.product(words, repeat=n)]:
            if len(sentence) == 3 and sentence[2] != "a":
                continue
            # each word takes one frame at least; cuts between words
            for cuts in itertools.combinations(range(1, 5), len(sentence) - 1):
                b = (0, *cuts, 5)
                c = sum(e[t, words.index(w)] for w, s, f in zip(sentence, b, b[1:]) for t in range(s, f)) + 0.7 * len(sentence)
                best = min(best, c)
        assert decode(e, fixed, words, 0, 3, 0.7)[0] == pytest.approx(best)
        loop = [(0, 1, w) for w in words] + [(1, 0, None)]
        cost, said = decode(e, loop, words, 0, 1, 0.7)
        assert said and cost <= decode(e, [(0, 1, w) for w in words], words, 0, 1, 0.7)[0] + 1e-9


def test_scoring(spark):
    pairs = spark.createDataFrame([("12", "13"), ("123", "12"), ("4", "4")], "result string, label string")
    r = scoring.accuracy(pairs).first()
    assert (r.words_right, r.words, r.sentences_right, r.sentences) == (2, 5, 1, 3)
    a = spark.createDataFrame([(0, "1"), (1, "2")], "idx int, result string")
    b = spark.createDataFrame([(0, "1"), (1, "3")], "idx int, label string")
    assert scoring.by_position(a, b).count() == 2
    with pytest.raises(ValueError, match="2 results"):
        scoring.by_position(a, b.limit(1))


# --- training


def voiced(rng, model, n):
    centers = {"a": [0, 5, 10], "b": [10, 0, 5]}[model]
    return [[float(rng.normal(c, 0.5))] for c in centers for _ in range(rng.integers(3, 8))] if n else []


def test_segmental_k_means(spark):
    rng = np.random.default_rng(11)
    seqs = spark.createDataFrame([(m, f"{m}{i}", voiced(rng, m, 1)) for m in "ab" for i in range(12)], "model string, utt string, frames array<array<double>>")
    got = training.segmental_k_means(seqs, states=3)
    assert all(a >= b - 1e-6 for a, b in zip(got.costs, got.costs[1:]))
    assert [round(s[0][1][0]) for s in got.models["a"].states] == [0, 5, 10]
    assert [round(s[0][1][0]) for s in got.models["b"].states] == [10, 0, 5]
    mixed = training.mixture_schedule(seqs, states=3, doublings=1, rounds=1)
    assert all(len(s) == 2 for s in mixed.models["a"].states)
    assert training.two_level(seqs, states=3, outer=3).models.keys() == {"a", "b"}
    again = training.segmental_k_means(seqs, states=3, start=got.models)
    assert again.costs[0] == pytest.approx(got.costs[-1], rel=1e-3)


def test_mixture_schedule_is_whole(spark):
    """Two doublings of ten rounds each, after single Gaussians that end by their own rule."""
    rng = np.random.default_rng(5)
    utts = [("a", f"a{i}", [[float(v)] for c in (0, 20) for v in c + rng.choice([-3, -1, 1, 3], 12) + rng.normal(0, 0.2, 12)]) for i in range(8)]
    seqs = spark.createDataFrame(utts, "model string, utt string, frames array<array<double>>")
    singles = training.segmental_k_means(seqs, states=2, rounds=None)
    got = training.mixture_schedule(seqs, states=2)
    assert singles.converged and got.converged and len(got.costs) == len(singles.costs) + 20
    assert [len(s) for s in got.models["a"].states] == [4, 4]
    assert got.costs[-1] < got.costs[-11] < singles.costs[-1]


def test_clustering_goes_on_until_no_frame_changes(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.exponential(40, 200), 2)
    comps, rounds, last = {("a", 0): [(0, 0.5, [1.0], [4.0]), (1, 0.5, [2.0], [9.0])]}, 0, None
    (mix,) = comps.values()
    while True:
        g = training._nearest(x[:, None], mix)
        if last is not None and (g == last).all():
            break
        last, rounds = g, rounds + 1
        mix = [(j, (g == j).mean(), [x[g == j].mean()], [x[g == j].var()]) for j in (0, 1)]
    assert rounds > 5
    values, n = np.unique(x, return_counts=True)
    frames = spark.createDataFrame([("a", 0, [float(v)], int(k)) for v, k in zip(values, n)] + [("b", 0, [1.5], 2)], "model string, state int, vec array<double>, n long")
    for most in (10**6, 2, 0):  # in a task; one state in a task and one by jobs; by jobs
        got = training._clustered(frames, comps, most)
        assert [(g, a, *m, *v) for g, a, m, v in got["a", 0]] == [pytest.approx((g, a, *m, *v)) for g, a, m, v in mix]
        assert got["b", 0] == [(0, 1.0, [1.5], [0.0])]


def test_transition_costs(spark):
    r = training.transition_costs(spark.createDataFrame([(0, 12, 3), (1, 4, 4)], "state int, n long, visits long")).orderBy("state").collect()
    assert (r[0].next, r[0].stay) == (pytest.approx(1.386294, abs=1e-6), pytest.approx(0.287682, abs=1e-6)) and r[1].stay == math.inf
    s = training.skip_costs(spark.createDataFrame([(0, 10, 4, 1), (1, 10, 4, 0)], "state int, n long, visits long, skipped long")).orderBy("state").collect()
    assert s[0].next == pytest.approx(-math.log(0.3)) and s[0].skip == pytest.approx(-math.log(0.1)) and s[1].skip == math.inf


# --- endpointing


def test_adaptive_state(spark):
    a = endpoint.Adaptive(10.0, 10.0)
    seen = []
    for e in (10.0, 30.0, 9.0):
        a.step(e)
        seen.append((a.level, a.background))
    assert seen == [(10, 10), (20, 11), (14.5, 14.5)]


ENERGY = [1, 1, 30, 30, 30, 30, 30, 1, 1, 30, *[1] * 12, 30, 30, 30, 30, 30, *[1] * 11]


def test_fixed_and_pruning(spark):
    chunks = spark.createDataFrame([("s", i, float(e)) for i, e in enumerate(ENERGY)] + [("q", 0, None)], "utt string, seq long, energy double")
    got = {r.utt: (r.start, r.complete) for r in endpoint.fixed(chunks).collect()}
    assert got == {"s": (2, 19), "q": (None, None)}
    flags = chunks.where("utt = 's'").select("utt", "seq", (F.col("energy") > 20).alias("voiced"))
    assert endpoint.run_start(flags, 4).first().start == 6
    assert endpoint.tail_prune(flags, 5, 2).first().keep_chunks == 22 + 5 + 2
    assert endpoint.noise_floor(chunks, 0, 2).where("utt = 's'").first().floor == pytest.approx(32 / 3)
    assert endpoint.capped(chunks, 1.0, 400, 1600).where("utt = 's'").count() == 4


def direct_utterances(energies, threshold, start_run, offset, shortest, silence, hold, warm, floor, first_level, to_chunk):
    """The adaptive rules written out once more, without a state object."""
    level = energies[0] if first_level else 0.0
    background = sum(energies[floor[0] : floor[1] + 1]) / (floor[1] - floor[0] + 1)
    out, start, voiced, quiet, run, held = [], None, 0, 0, 0, 0
    for seq in range(warm, len(energies)):
        e = energies[seq]
        level = (level + e) / 2
        background = (e if to_chunk else level) if e < background else background + (e - background) * 0.05
        level = max(level, background)
        loud = level - background > threshold + (offset if start is None else 0)
        held = 0 if loud else held + 1
        if loud or held < hold:
            run += 1
            if start is None and run > start_run:
                start, voiced = seq, run - 1
            if start is not None:
                voiced, quiet = voiced + 1, 0
        else:
            run = 0
            if start is not None:
                quiet += 1
        if start is not None and voiced >= shortest and quiet >= silence:
            out.append((start, seq))
            start, voiced, quiet, run, held = None, 0, 0, 0, 0
    return out


def live_energies():
    rng = random.Random(11)
    quiet = lambda n: [20 + rng.random() for _ in range(n)]
    return quiet(30) + [90.0] * 12 + quiet(5) + [95.0] * 9 + quiet(160) + [99.0] * 40 + quiet(150) + [90.0] * 8


def test_adaptive_utterances(spark):
    e = live_energies()
    chunks = spark.createDataFrame([("s", i, x) for i, x in enumerate(e)] + [("q", 0, None)], "utt string, seq long, energy double")
    got = {name: sorted((r.start, r.complete) for r in endpoint.utterances(chunks, rules).where("utt = 's'").collect()) for name, rules in (("held", endpoint.HELD), ("run", endpoint.RUN))}
    assert got["held"] == direct_utterances(e, 2.0, 0, 0.0, 5, 10, 20, 10, (0, 9), True, False) and got["held"]
    assert got["run"] == direct_utterances(e, 40.0, 6, 3.0, 7, 131, 0, 20, (9, 18), False, True) and len(got["run"]) == 2
    short = endpoint.utterances(chunks, replace(endpoint.HELD, most=50)).where("utt = 's'")
    assert max(r.complete - r.start for r in short.collect()) < 50


@pytest.fixture
def rocks(spark):
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(conf, before)


def replay(spark, tmp_path, energies, processor, name):
    """Chunks in five files, a micro-batch each."""
    rows = [("s", i, None, [0]) for i in range(len(energies))]
    step = -(-len(rows) // 5)
    level = {i: x for i, x in enumerate(energies)}
    for k in range(0, len(rows), step):
        part = rows[k : k + step]
        random.Random(k).shuffle(part)
        spark.createDataFrame([(a, b, level[b]) for a, b, _, _ in part], "stream string, seq long, energy double").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    live = spark.readStream.schema("stream string, seq long, energy double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    q = endpointer.endpoints(live, processor).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted((r.start, r.complete) for r in spark.sql(f"select * from {name}").collect())


@pytest.mark.parametrize("name,energies,processor,rules", [
    ("fixed", [float(x) for x in ENERGY], endpointer.FixedEndpointer(), endpoint.FIXED),
    ("held", live_energies(), endpointer.AdaptiveEndpointer(), endpoint.HELD),
    ("run", live_energies(), endpointer.AdaptiveEndpointer(endpoint.RUN), endpoint.RUN),
])
def test_stream_equals_batch(spark, tmp_path, rocks, name, energies, processor, rules):
    chunks = spark.createDataFrame([("s", i, x) for i, x in enumerate(energies)], "utt string, seq long, energy double")
    want = sorted((r.start, r.complete) for r in endpoint.utterances(chunks, rules).collect())
    assert want and replay(spark, tmp_path, energies, processor, name) == want
    if name == "fixed":
        assert want == [(2, 19), (22, 36)]


def test_timer_ends_a_silent_stream(spark, tmp_path, rocks):
    spark.createDataFrame([("s", i, 30.0) for i in range(8)], "stream string, seq long, energy double").coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema("stream string, seq long, energy double").parquet(str(tmp_path / "in"))
    q = endpointer.endpoints(live, endpointer.FixedEndpointer(idle=2.0)).writeStream.format("memory").queryName("timed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            rows = spark.sql("select * from timed").collect()
            if rows:
                break
            time.sleep(1)
    finally:
        q.stop()
    assert [(r.stream, r.start, r.complete) for r in rows] == [("s", 0, 7)]


def test_chunk_stream_reads_samples(spark, tmp_path):
    spark.createDataFrame([("s", 0, None, [3, 4]), ("s", 1, None, [0])], "stream string, seq long, ts timestamp, samples array<smallint>").write.parquet(str(tmp_path / "in"))
    q = endpointer.chunk_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("raw").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {r.seq: r.energy for r in spark.sql("select * from raw").collect()}
    assert got[0] == pytest.approx(math.log(25)) and got[1] is None


def test_gaussian_noise(spark):
    rows = spark.range(20000).select(C.gaussian_noise(7).alias("x"))
    r = rows.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.avg((F.abs("x") < 1.96).cast("int")).alias("inside")).first()
    assert abs(r.m) < 0.03 and abs(r.s - 1) < 0.03 and abs(r.inside - 0.95) < 0.01
    assert rows.limit(5).collect() == rows.limit(5).collect()


def test_blocks_of_any_size_give_the_same_features(spark):
    rng = random.Random(4)
    data = {"a": [rng.randint(-9000, 9000) for _ in range(3000)], "b": [rng.randint(-90, 90) for _ in range(401)], "c": [5] * 700, "d": [1, 2]}
    arrays = spark.createDataFrame(list(data.items()), "utt string, samples array<int>")
    rows = spark.createDataFrame([(k, i, float(x)) for k, v in data.items() for i, x in enumerate(v)], "utt string, i long, x double")
    for p in (signal.PY, signal.CPP, signal.small(signal.G5, frame=64, shift=40, fft=64)):
        flat = lambda df: {(r.utt, r.t): r.vec for r in df.collect()}
        want = flat(signal.mfcc(rows, p))
        assert want
        for other in (flat(signal.mfcc(rows, p, 4)), flat(signal.mfcc_blocks(signal.array_blocks(arrays, p, 5), p, 5))):
            assert set(other) == set(want)
            assert all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-6) for k in want for x, y in zip(want[k], other[k]))


# --- sources


def test_wav_round_trip(spark, tmp_path):
    rng = random.Random(1)
    data = {f"w{k}": [rng.randint(-32768, 32767) for _ in range(n)] for k, n in enumerate((0, 7, 900))}
    folder = str(tmp_path / "wavs")
    wav.write(spark.createDataFrame([(k, 16000, v) for k, v in data.items()], "utt string, rate int, samples array<int>"), folder).collect()
    (tmp_path / "wavs" / "bad.wav").write_bytes(b"RIFFxxxx")
    whole = wav.encode([1, 2, 3], 8000)
    (tmp_path / "wavs" / "cut.wav").write_bytes(whole[:-2])
    rows = {os.path.basename(r.path): r for r in wav.read(spark, folder).collect()}
    assert {k: rows[f"{k}.wav"].samples for k in data} == data
    assert rows["bad.wav"].error and rows["cut.wav"].samples is None
    loose = {os.path.basename(r.path): r for r in wav.read(spark, folder, trust_length=False).collect()}
    assert loose["cut.wav"].samples == [1, 2]
    head = {os.path.basename(r.path): r for r in wav.header(spark, folder).collect()}
    assert (head["w2.wav"].rate, head["w2.wav"].declared, head["w2.wav"].valid) == (16000, 1800, True) and not head["bad.wav"].valid
    assert head["w2.wav"].seconds == pytest.approx(900 / 16000)
    assert wav.signal(wav.read(spark, folder)).where("utt = 'w1'").count() == 7
    assert [r.seq for r in wav.chunks(wav.read(spark, folder)).where("utt = 'w2'").orderBy("seq").collect()] == [0, 1, 2]
    assert struct.unpack_from("<I", whole, 40)[0] == 6


def test_model_files(spark, tmp_path):
    d = tmp_path / "m"
    d.mkdir()
    for name, rows in {"3hmm_mean": [[1, 2], [3, 4]], "3hmm_var": [[1, 1], [2, 2]], "3hmm_self_trans": [[0.5], [0.1]], "3hmm_trans_p": [[0.7], [0.9]], "1gmm_mean1": [[1, 1]], "1gmm_mean2": [[2, 2]], "1gmm_var1": [[1, 1]], "1gmm_var2": [[1, 1]], "1gmm_weight": [[0.25, 0.75]]}.items():
        np.savetxt(d / f"{name}.txt", np.array(rows, float))
    got = models.hmm_text(spark, str(d), last_leave=200).orderBy("state").collect()
    assert [(r.model, r.state, r.mean, r.stay, r.next) for r in got] == [(3, 0, [1.0, 2.0], 0.5, 0.7), (3, 1, [3.0, 4.0], 0.0, 200.0)]
    assert [(r.g, r.alpha, r.mean) for r in models.gmm_text(spark, str(d)).orderBy("g").collect()] == [(0, 0.25, [1.0, 1.0]), (1, 0.75, [2.0, 2.0])]
    (d / "x.dat").write_text("1 2 1 2\n1.0\n1 2\n3 4\n1.0\n5 6\n7 8\n0.1 0.2\n-6.2e+066 0.3\n")
    comps, trans = models.dat(spark, str(d), "*.dat")
    assert [(r.state, r.alpha, r["mean"], r["var"]) for r in comps.orderBy("state").collect()] == [(0, 1.0, [1.0, 2.0], [3.0, 4.0]), (1, 1.0, [5.0, 6.0], [7.0, 8.0])]
    assert {(r.src, r.dst, r.cost) for r in trans.collect()} == {(0, 0, 0.1), (0, 1, 0.2), (1, 1, 0.3)}
    lines = spark.createDataFrame([("one oh three (fa_1)",), ("nine (fb)",)], "value string")
    assert [tuple(r) for r in models.transcripts(lines).collect()] == [("1o3", "fa_1"), ("9", "fb")]
    assert models.random_labels(spark, 5, 7, first_from=2).where("digits rlike '^[2-9][0-9]{6}$'").count() == 5
    models.write_table(models.hmm_text(spark, str(d)), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    (d / "u1.txt").write_text("1 2 3\n4 5 6\n")
    assert models.features(spark, str(d), "u1.txt").orderBy("t").select("vec").collect()[1].vec == [4.0, 5.0, 6.0]


def test_as_of_and_ranges(spark):
    a = spark.createDataFrame([(1, 1, 5), (2, 1, 90000), (3, 2, 7)], "id int, k int, s int").withColumn("ts", F.timestamp_seconds("s"))
    b = spark.createDataFrame([(1, 3, 10.0, 1), (1, 5, 20.0, 2), (2, 8, 5.0, 3)], "k int, s int, v double, i int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: r.v_as_of for r in relational.as_of(a, b, "k", "ts", "v", "i").collect()}
    assert got == {1: 20.0, 2: 20.0, 3: None}
    assert [r.idx for r in relational.ranked(spark.range(100).withColumn("z", -F.col("id")), ["z"]).orderBy("z").collect()] == list(range(100))


def test_entry_points_without_the_optional_part():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_phone_numbers_are_decoded(spark):
    from quillspark.operators import decoding

    rng = np.random.default_rng(13)
    center = {d: 10.0 * i for i, d in enumerate("0123456789")} | {"sil": -20.0}
    models_ = {w: training.Model([[(1.0, [c], [1.0])], [(1.0, [c + 4], [1.0])]], [0.1, 0.1], [0.3, 0.3]) for w, c in center.items()}
    said = {"a": "2345678", "b": "0123", "c": "9876"}
    say = lambda w: [[float(rng.normal(center[w] + 4 * (k > 1), 0.4))] for k in range(4)]
    rows = [(u, [x for w in ["sil", *ds[:2], "sil", *ds[2:], "sil"] for x in say(w)]) for u, ds in said.items()] + [("none", [])]
    seqs = spark.createDataFrame(rows, "utt string, frames array<array<double>>")
    edges = grammar.phone_grammar(silence="sil")
    got = {r.utt: "".join(r.words) for r in decoding.decode(seqs, edges, models_, 0, 7, exit_penalty=5.0, silence="sil").collect()}
    assert got == said | {"none": ""}
    beam = {r.utt: "".join(r.words) for r in decoding.decode(seqs, edges, models_, 0, 7, 5.0, beam=200.0, silence="sil").collect()}
    assert beam == got
    one = spark.createDataFrame([("x", say("7")), ("short", [[1.0]])], "utt string, frames array<array<double>>")
    assert {r.utt: r.word for r in decoding.recognise(one, models_).collect()} == {"x": "7", "short": None}


def test_continuous_training(spark):
    rng = np.random.default_rng(17)
    center = {"1": (0, 4), "2": (10, 14), "sil": (-10, -16)}
    say = lambda w: [[float(rng.normal(c, 0.4))] for c in center[w] for _ in range(rng.integers(3, 6))]
    labels = ["12", "21", "112", "2", "1"] * 4
    rows = [(f"u{i}", list(ws), [x for w in ["sil", *ws, "sil"] for x in say(w)]) for i, ws in enumerate(labels)]
    seqs = spark.createDataFrame(rows, "utt string, label array<string>, frames array<array<double>>")
    got = training.continuous_k_means(seqs, states=2, rounds=8, stop=1.0, penalty=1.0, silence="sil")
    assert {w: [round(s[0][1][0]) for s in m.states] for w, m in got.models.items()} == {"1": [0, 4], "2": [10, 14], "sil": [-10, -16]}
    aligned = training.align_labels(seqs, got.models, 1.0, "sil")
    one = aligned.where("utt = 'u2'").groupBy("pos", "model").count().orderBy("pos").collect()
    assert [(r.pos, r.model) for r in one] == [(0, "sil"), (1, "1"), (2, "1"), (3, "2"), (4, "sil")]
    assert sum(r["count"] for r in one) == len(rows[2][2])
    more = training.continuous_k_means(seqs, states=2, rounds=2, stop=1.0, penalty=1.0, silence="sil", start=got.models, doublings=1)
    assert all(len(s) == 2 for s in more.models["1"].states)
    assert training.align_labels(spark.createDataFrame([("x", ["9"], [[1.0]]), ("y", [], [[1.0]])], seqs.schema), got.models).count() == 0


def test_greedy_training(spark):
    rng = np.random.default_rng(19)
    seqs = spark.createDataFrame([("a", f"a{i}", voiced(rng, "a", 1)) for i in range(10)], "model string, utt string, frames array<array<double>>")
    got = training.segmental_k_means(seqs, states=3, greedy=True)
    assert [round(s[0][1][0]) for s in got.models["a"].states] == [0, 5, 10]
    e = rng.uniform(0, 3, (9, 3))
    row = spark.createDataFrame([(e.tolist(),)], "e array<array<double>>").select(trellis.greedy_fold(F.col("e"), [0.1] * 3, [0.2] * 3).alias("g")).first().g
    cost, path = training.greedy_path(e, [0.1] * 3, [0.2] * 3)
    assert (row.cost, row.state) == (pytest.approx(cost), path[-1])


def test_skip_model_files_and_text_sink(spark, tmp_path):
    d = tmp_path / "g"
    d.mkdir()
    np.savetxt(d / "mean7.txt", [[1.0, 2.0], [3.0, 4.0]])
    np.savetxt(d / "vari7.txt", [[1.0, 1.0], [2.0, 2.0]])
    np.savetxt(d / "tran7.txt", [[0.1, 0.2, 0.3], [0.4, 0.5, 0.6], [0.7, 0.8, 0.9]])
    got = models.skip_text(spark, str(d)).orderBy("row").collect()
    assert [(r["mean"], r.stay, r.skip) for r in got] == [(None, 0.1, 0.3), ([1.0, 2.0], 0.4, 0.6), ([3.0, 4.0], 0.7, 0.9)]
    rows = spark.createDataFrame([(1, 1, [3.0, 4.0], 0.5), (1, 0, [1.0, 2.0], 0.25)], "model int, state int, mean array<double>, stay double")
    models.write_text(rows, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out" / "kind=mean" / "model=1")).collect()
    assert [r.value for r in back] == ["1.0 2.0", "3.0 4.0"]


def test_table_functions(spark):
    from quillspark.functions import tables

    tables.register(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM frames(array(1, 2, 3, 4, 5), 3, 2)").collect()] == [(0, [1.0, 2.0, 3.0]), (1, [3.0, 4.0, 5.0])]
    assert spark.sql("""SELECT * FROM grammar_edges('Edge 0 1 "2""\nEdge 1 0\nx')""").collect() == [(0, 1, "2"), (1, 0, None)]
    r = spark.sql("SELECT power_spectrum(array(1D, 0D, 0D, 0D)) AS p, power_spectrum(CAST(NULL AS ARRAY<DOUBLE>)) AS n").first()
    assert r.p == [1.0, 1.0, 1.0] and r.n is None
