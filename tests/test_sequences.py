"""Long utterances in blocks, token passing, bounded trace-back, fused training rounds, layers of a graph,
and table functions: against the serial and row forms."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions import tables
from quillspark.operators import blocks, grammar, passing, training, trellis
from quillspark.operators.trellis import Graph, best_path, words_of

INF = math.inf


def random_chain(rng, ties):
    cost = (lambda: rng.choice([0.0, 0.25, 0.5])) if ties else rng.random
    n = rng.randint(1, 5)
    return Graph.chain([cost() for _ in range(n)], [cost() for _ in range(n)], [cost() for _ in range(n)] if rng.random() < 0.5 else None)


def random_words(rng):
    """A graph with empty states, and in half of the cases a loop."""
    parts = {w: {"emit": [2 * i, 2 * i + 1], "stay": [0.25, 0.5], "move": [0.25, 0.25]} for i, w in enumerate("123")}
    loop = rng.random() < 0.5
    edges = [(0, 1, w) for w in "123"] + ([(1, 0, None)] if loop else [(1, 2, w) for w in "12"] + [(1, 2, None)])
    return grammar.compile_graph(edges, parts, 0, 1 if loop else 2, 2.0, 0.0)


def random_costs(rng, frames, width, ties):
    e = np.array([[rng.choice([0, 1, 2, 0.5]) if ties else rng.random() * 5 for _ in range(width)] for _ in range(frames)], float)
    if rng.random() < 0.2:
        e[rng.randrange(frames), rng.randrange(width)] = INF
    return e


def in_blocks(g, e, block, prefer_move, own_first):
    """The operator's passes over one utterance, one block after another."""
    k, parts = blocks.Columns(g, trellis._Plan.of(g, prefer_move), own_first), [e[i : i + block] for i in range(0, len(e), block)]
    v, before = None, []
    for b, part in enumerate(parts):
        before.append(v)
        m = k.matrix(part, b == 0)
        v = m[0] if v is None else blocks.product(v[None], m)[0]
    final = min(g.final, key=lambda j: (v[j], j))
    if not v[final] < INF:
        return INF, []
    path, j = [], final
    for entry, part in zip(before[::-1], parts[::-1]):
        path = [s for _, s in k.path(entry, part, j)] + path
        j = int(k.origins(entry, part)[j]) if j >= 0 else -1
    return v[final], path


def test_blocks_give_the_serial_path():
    rng = random.Random(3)
    for _ in range(250):
        ties = rng.random() < 0.6
        g = random_chain(rng, ties) if rng.random() < 0.5 else random_words(rng)[0]
        e = blocks._grains(random_costs(rng, rng.randint(1, 40), max(g.emit) + 1, ties), blocks.GRAIN)
        g, prefer_move, own_first = blocks.rounded(g, blocks.GRAIN), rng.random() < 0.5, rng.random() < 0.7
        assert in_blocks(g, e, rng.randint(1, 9), prefer_move, own_first) == best_path(e, g, prefer_move, own_first=own_first)


def test_min_plus_product_is_associative():
    rng = np.random.default_rng(1)
    a, b, c = (blocks._grains(np.where(rng.random((6, 6)) < 0.2, INF, rng.random((6, 6)) * 100), blocks.GRAIN) for _ in range(3))
    assert (blocks.product(blocks.product(a, b), c) == blocks.product(a, blocks.product(b, c))).all()


@pytest.mark.parametrize("block,bits", [(1, 1), (7, 2), (1000, 5)])
def test_align_in_blocks(spark, block, bits):
    """Utterances of many lengths, one without a way through, one with a null frame; columns that clash."""
    rng = random.Random(block)
    g, _ = random_words(rng)
    es = {f"u{i}": random_costs(rng, n, 6, i % 2).tolist() for i, n in enumerate((1, 2, 9, 40, 61))}
    es["short"] = [[1.0] * 6]
    es["gap"] = [[1.0] * 6, None, [1.0] * 6]
    es["hole"] = [[1.0] * 6, [1.0, None, 1.0, 1.0, None, 1.0], [0.5] * 6, [0.25] * 6]
    rows = [(u, t, e, "clash", 7) for u, own in es.items() for t, e in enumerate(own)] + [(None, 0, [0.0] * 6, "x", 1), ("u0", None, [0.0] * 6, "x", 1)]
    random.Random(1).shuffle(rows)
    frames = spark.createDataFrame(rows, "utt string, t long, e array<double>, key string, b int")
    got = blocks.align(frames, g, block=block, bits=bits)
    costs = {r.utt: r.cost for r in got.costs.collect()}
    paths: dict = {}
    for r in sorted(got.paths.collect(), key=lambda r: r.t):
        paths.setdefault(r.utt, []).append(r.state)
    own = blocks.rounded(g, blocks.GRAIN)
    for u, e in es.items():
        e = np.array([[INF] * 6 if f is None else [INF if x is None else x for x in f] for f in e])
        cost, path = best_path(blocks._grains(e, blocks.GRAIN), own)
        assert (costs[u], paths.get(u, [])) == (cost, path)
    assert set(costs) == set(es) and costs["gap"] == INF
    none = blocks.align(frames.limit(0), g, block=block)
    assert none.costs.count() == 0 and none.paths.count() == 0


def test_align_in_blocks_refuses_large_graphs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "MOST_STATES", 3)
    with pytest.raises(ValueError):
        blocks.align(spark.createDataFrame([], "utt string, t long, e array<double>"), Graph.chain([0.0] * 4, [0.0] * 4))


def test_one_long_utterance_in_many_tasks(spark):
    """30,000 frames with the shape of three states."""
    n, g = 30_000, Graph.chain([0.1, 0.1, 0.0], [0.5, 0.5, 0.0])
    rows = spark.range(n).select(F.lit("u").alias("utt"), F.col("id").alias("t"), F.array(*[F.abs(F.floor(F.col("id") * 3 / n) - s).cast("double") + F.pmod(F.xxhash64("id"), F.lit(100)) / 1000 for s in range(3)]).alias("e"))
    got = blocks.align(rows, g, block=1000)
    e = np.array([r.e for r in rows.orderBy("t").collect()])
    cost, path = best_path(blocks._grains(e, blocks.GRAIN), blocks.rounded(g, blocks.GRAIN))
    assert got.costs.first().cost == cost
    assert [r.state for r in got.paths.orderBy("t").collect()] == path
    assert got.paths.select(F.floor(F.col("t") / 1000)).distinct().count() == 30


def test_trace_back_in_segments(monkeypatch):
    rng = random.Random(9)
    for _ in range(150):
        g = random_chain(rng, True) if rng.random() < 0.5 else random_words(rng)[0]
        e, beam, prefer = random_costs(rng, rng.randint(1, 60), max(g.emit) + 1, True), rng.choice([None, 3.0]), rng.random() < 0.5
        want = best_path(e, g, prefer, beam)
        monkeypatch.setattr(trellis, "MOST_POINTERS", 1)
        assert best_path(e, g, prefer, beam) == want
        monkeypatch.undo()


def test_trace_back_memory_follows_the_root(monkeypatch):
    import tracemalloc

    e, g = np.zeros((40_000, 20), np.float32), Graph.chain([0.0] * 20, [0.0] * 20)
    monkeypatch.setattr(trellis, "MOST_POINTERS", 1000)
    tracemalloc.start()
    cost, path = best_path(e, g)
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(path) == 40_000 and top < 4_000_000  # pointers of all frames would take 3.2 MB, as 64-bit ones 6.4


@pytest.mark.parametrize("sweep", [1, 1 << 16])
def test_passing_says_what_the_path_says(monkeypatch, sweep):
    monkeypatch.setattr(passing, "FIRST_SWEEP", sweep)
    monkeypatch.setattr(passing, "SIDE_BY_SIDE", 300)
    rng, scored = random.Random(sweep), {None: 0, 8.0: 0}
    for _ in range(40):
        models = {w: training.Model([[(0.4, [rng.uniform(-5, 5), 0.0], [1.0, 2.0]), (0.6, [rng.uniform(-5, 5), 1.0], [1.0, 1.0])][: rng.randint(1, 2)] for _ in range(2)], [0.25, 0.5], [0.25, 0.25]) for w in "123"}
        g, entries = random_words(rng)
        xs = [np.array([[rng.uniform(-6, 6), rng.uniform(-1, 2)] for _ in range(rng.randint(0, 50))]).reshape(-1, 2) for _ in range(8)]
        scorer = passing.Scorer([mix for w in "123" for mix in models[w].states])
        for beam in scored:
            own = rng.random() < 0.5
            for x, h in zip(xs, passing.decode(xs, g, entries, scorer, beam, own)):
                e = np.hstack([models[w].emissions(x) for w in "123"]) if len(x) else np.zeros((0, 1))
                cost, path = best_path(e, g, beam=beam, own_first=own)
                assert h.words == words_of(path, g, entries)
                assert h.cost == cost or abs(h.cost - cost) < 1e-9
                scored[beam] += h.scored
    assert scored[8.0] < 0.9 * scored[None]


def test_word_histories_stand_once():
    """A long utterance of few possible words keeps few entries."""
    parts = {w: {"emit": [i], "stay": [0.0], "move": [0.0]} for i, w in enumerate("12")}
    g, entries = grammar.compile_graph([(0, 1, "1"), (0, 1, "2"), (1, 2, "1"), (1, 2, "2")], parts, 0, 2, 1.0)
    x = np.random.default_rng(1).normal(size=(3000, 1))
    heard = passing.decode([x], g, entries, passing.Scorer([[(1.0, [0.0], [1.0])], [(1.0, [1.0], [1.0])]]))[0]
    assert len(heard.words) == 2 and heard.entries <= 2 + 4


def sequences_of(spark, rng, n=30):
    center = {"a": (0.0, 10.0, 20.0), "b": (5.0, -5.0, 15.0)}
    rows = []
    for i in range(n):
        m = "ab"[i % 2]
        rows.append((m, f"u{i}", [[c + rng.gauss(0, 1), rng.gauss(0, 1)] for c in center[m] for _ in range(rng.randint(3, 9))]))
    return spark.createDataFrame(rows, "model string, utt string, frames array<array<double>>")


def test_fused_rounds_are_the_row_forms(spark):
    """Statistics and models of a fused round equal those of the rows by frame."""
    seqs = sequences_of(spark, random.Random(2))
    labelled = seqs.select(F.array("model").alias("label"), "frames")
    even = training.refitted(training.statistics(labelled, training.Uniform(3)), 3)
    want = training.collect_models(training.uniform_alignment(seqs, 3), None, 3)
    for got, rows in ((even, want), (training.refitted(training.statistics(labelled, training.Best(even)), 3), training.collect_models(training.align_models(seqs, even), None, 3))):
        assert set(got) == set(rows) == {"a", "b"}
        for m in got:
            assert np.allclose(got[m].stay, rows[m].stay, rtol=1e-9) and np.allclose(got[m].move, rows[m].move, rtol=1e-9)
            for (x,), (y,) in zip(got[m].states, rows[m].states):
                assert np.allclose(x[1], y[1], rtol=1e-9, atol=1e-9) and np.allclose(x[2], y[2], rtol=1e-9)
    both = seqs.select("utt", F.array(F.lit("a"), F.lit("b")).alias("label"), "frames")
    r = training.statistics(both, training.Best(want, 1.5))
    rows = training.align_labels(both, want, 1.5)
    assert r.cost == pytest.approx(rows.agg(F.sum("cost")).first()[0]) and r.aligned == 30
    n = {(x.model, x.state): x.n for x in rows.groupBy("model", "state").agg(F.count("*").alias("n")).collect()}
    assert {k: sum(x[1] for x in v) for k, v in r.stats.items()} == n


def test_rounds_count_what_is_left_out(spark):
    seqs = sequences_of(spark, random.Random(4), 10)
    odd = spark.createDataFrame([("a", "short", [[0.0, 0.0]]), ("a", "none", []), ("a", "null", None), ("a", "hole", [[0.0, None], [1.0, 1.0], [2.0, 1.0]]), (None, "who", [[0.0, 0.0]] * 5), ("z", "unknown", [[0.0, 0.0]] * 5)], seqs.schema)
    models = training.segmental_k_means(seqs, 3).models
    how = training.Best(models)
    rows = seqs.union(odd).select("utt", F.array("model").alias("label"), "frames", F.lit(1).alias("cost"))
    r = training.statistics(rows, how)
    assert (r.aligned, r.left_out) == (10, 6)
    assert {x.utt for x in training.unaligned(rows, how).collect()} == {"short", "none", "null", "hole", "who", "unknown"}
    got = training.segmental_k_means(seqs.union(odd), 3, rounds=2, start=models)
    assert got.left_out[0] == 6 and got.aligned[0] == 10 and not training.segmental_k_means(seqs, 3, rounds=1).converged
    assert training.segmental_k_means(seqs, 3).converged
    empty = training.segmental_k_means(seqs.limit(0), 3, rounds=3)
    assert empty.models == {} and empty.costs == [0.0, 0.0] and empty.converged


def test_a_rounds_writes_follow_the_models(spark, tmp_path, monkeypatch):
    """Ten times the frames do not make a round write more."""
    written = []
    monkeypatch.setattr(training, "stored", lambda df: written.append(len(df.coalesce(1).collect())) or spark.createDataFrame(df.collect(), df.schema))
    seqs = sequences_of(spark, random.Random(5), 6).select(F.array("model").alias("label"), "frames").coalesce(1)
    for times in (1, 10):
        training.statistics(seqs.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("k").coalesce(1), training.Uniform(3))
    assert written == [2 * 3 + 1] * 2


def test_reachable_by_layers(spark):
    rows = [(3 * k + a, 3 * (k + 1) + b) for k in range(14) for a in range(3) for b in range(3)] + [(5, None), (None, 4)]
    edges = spark.createDataFrame(rows, "src int, dst int")
    assert {(r.state, r.steps) for r in grammar.reachable(edges).collect()} == {(0, 0)} | {(3 * k + a, k) for k in range(1, 15) for a in range(3)}
    assert {r.state for r in grammar.reachable(edges, 0, max_steps=2).collect()} == {0, 3, 4, 5, 6, 7, 8}
    chain = spark.createDataFrame([(i, i + 1) for i in range(120)] + [(120, 7)], "src int, dst int")
    assert {(r.state, r.steps) for r in grammar.reachable(chain, hops=16).collect()} == {(i, i) for i in range(121)}
    assert [tuple(r) for r in grammar.reachable(edges.limit(0), 9).collect()] == [(9, 0)]


def test_table_functions(spark):
    tables.register(spark)
    rng = random.Random(6)
    es = {"a": random_costs(rng, 12, 2, True).tolist(), "b": random_costs(rng, 1, 2, True).tolist(), "c": [[1.0, 1.0], None, [1.0, 1.0]]}
    rows = [(u, t, e) for u, own in es.items() for t, e in enumerate(own)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "utt string, t long, e array<double>").createOrReplaceTempView("emissions")
    got: dict = {}
    for r in spark.sql("SELECT * FROM align(TABLE(emissions) PARTITION BY utt ORDER BY (t), array(0.25D, 0.0D), array(0.5D, 0.0D))").collect():
        got.setdefault(r.utt, []).append((r.t, r.state, r.cost))
    for u in es:
        e = np.array([[INF] * 2 if f is None else f for f in es[u]])
        cost, path = best_path(e, Graph.chain([0.25, 0.0], [0.5, 0.0]))
        assert sorted(got[u], key=str) == sorted([(t, s, cost) for t, s in enumerate(path)] or [(None, None, INF)], key=str)
    spark.createDataFrame([("a", i, float(i)) for i in range(20)] + [("b", 0, 1.0)], "utt string, i long, x double").createOrReplaceTempView("samples")
    for width, shift in ((4, 2), (3, 3), (2, 5)):
        got = spark.sql(f"SELECT * FROM framed(TABLE(samples) PARTITION BY utt ORDER BY (i), {width}, {shift})").collect()
        assert {(r.utt, r.f, tuple(r.frame)) for r in got} == {("a", f, tuple(float(x) for x in range(f * shift, f * shift + width))) for f in range((20 - width) // shift + 1)}
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM framed(TABLE(emissions) PARTITION BY utt ORDER BY (t), 2, 2)").collect()


def test_paths_side_by_side_are_the_serial_ones(monkeypatch):
    """Utterances of many lengths, empty ones and ones without a way through among them."""
    rng = random.Random(8)
    for most in (1 << 22, 60):
        monkeypatch.setattr(trellis, "MOST_POINTERS", most)
        for _ in range(40):
            g, prefer = random_chain(rng, True), rng.random() < 0.5
            es = [random_costs(rng, n, max(g.emit) + 1, rng.random() < 0.5) if (n := rng.randint(0, 30)) else np.zeros((0, max(g.emit) + 1)) for _ in range(12)]
            sizes = np.array([len(e) for e in es])
            costs, states = trellis.best_paths(np.concatenate(es), sizes, g, prefer)
            for e, cost, own in zip(es, costs, np.split(states, np.cumsum(sizes)[:-1])):
                want, path = best_path(e, g, prefer)
                assert cost == want and own.tolist() == (path or [-1] * len(e))
            n = rng.randint(1, 4)
            es, stay, move = [np.array([[rng.choice([0, 1, 0.5]) for _ in range(n)] for _ in range(k)]).reshape(k, n) for k in sizes], [0.25] * n, [0.5] * n
            costs, states = training.greedy_paths(np.concatenate(es), sizes, stay, move)
            for e, cost, own in zip(es, costs, np.split(states, np.cumsum(sizes)[:-1])):
                want, path = training.greedy_path(e, stay, move)
                assert own.tolist() == path and (cost == want if len(e) else cost == INF)


def test_a_round_takes_a_tasks_sequences_together(spark, monkeypatch):
    """Emissions are computed once for the sequences of a label, not once for each."""
    calls = []
    emissions = training.Model.emissions
    monkeypatch.setattr(training.Model, "emissions", lambda self, x: calls.append(len(x)) or emissions(self, x))
    models = {"a": training.Model([[(1.0, [float(k)], [1.0])] for k in range(2)], [0.1] * 2, [0.3] * 2)}
    xs = [np.array([[0.0], [1.0], [1.0]])] * 50 + [np.zeros((0, 1)), np.array([[np.nan]]), np.array([[0.0]])]
    sums = training._Moments(None)
    sums.sequences([["a"]] * len(xs), xs, training.Best(models), training.Best(models))
    assert calls == [151, 150] and (sums.aligned, sums.left_out, sums.moved, sums.lengths) == (50, 3, 0.0, 100)
    assert {k: v[:2] for k, v in sums.by.items()} == {("a", 0, 0): (50, 50), ("a", 1, 0): (100, 50)}


def test_blocks_side_by_side_are_the_single_ones(monkeypatch):
    """Blocks of many lengths, with and without a column before them, and few or all of them at once."""
    rng = random.Random(9)
    for most in (1_000_000, 60):
        monkeypatch.setattr(blocks, "SIDE_BY_SIDE", most)
        for _ in range(30):
            g = random_chain(rng, True) if rng.random() < 0.5 else random_words(rng)[0]
            k = blocks.Columns(g, trellis._Plan.of(g, rng.random() < 0.5), rng.random() < 0.5)
            es = [random_costs(rng, rng.randint(1, 9), max(g.emit) + 1, True) for _ in range(10)]
            entries = [None if rng.random() < 0.3 else np.array([rng.choice([0.0, 1.0, INF]) for _ in g.emit]) for _ in es]
            leaves = [rng.randrange(-1, k.n) for _ in es]
            for got, e, v in zip(k.matrices(es, [v is None for v in entries]), es, entries):
                assert (got == k.matrix(e, v is None)).all()
            for got, way, e, v, j in zip(k.all_origins(entries, es), k.paths(entries, es, leaves), es, entries, leaves):
                assert (got == k.origins(v, e)).all() and way == k.path(v, e, j)


def test_neighbouring_groups_of_a_tree_go_together():
    assert blocks._more(2, 5) == 10 and blocks._more(5, 2_000) == 0
    t, groups = blocks._groups(pa.table({"b": [9, 1, 0, 4, 8], "p": [2, 0, 0, 1, 2]}))
    assert t.column("b").to_pylist() == [0, 1, 4, 8, 9] and groups == [(0, 2), (2, 3), (3, 5)]
