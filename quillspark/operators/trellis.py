"""The trellis kernel: minimum-cost paths of frame sequences through states.

Two forms with the same results. The fold keeps a column of costs in the JVM and gives final costs;
it suits short sequences. The Arrow form keeps back-pointers as well, in numpy, and gives paths; it
is linear in the frames. A sequence is serial by nature: one utterance is one row, however long.

Emissions are arrays by frame of arrays by state; unreachable is infinity.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")
#: Pointers, of four bytes each, that are kept for a whole utterance.
MOST_POINTERS = 1 << 22


def chain_fold(emissions: Column, n: int, stay: list[float], move: list[float], skip: list[float] | None = None, beam: float | None = None, free_first: bool = False) -> Column:
    """The array of final costs of a left-to-right chain started in state 0.

    stay, move and skip are the costs of remaining in a state, leaving it for the next, and leaving
    it for the one after. beam: after each frame, states dearer than the best by more are dropped.
    free_first: the first frame is not scored.
    """
    inf = F.lit(INF)
    add = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    stays, moves = add(stay), add(move)
    skips = add(skip) if skip is not None else None
    first = F.array(F.lit(0.0) if free_first else F.get(F.get(emissions, F.lit(0)), F.lit(0)), *[inf] * (n - 1))

    def step(c: Column, e: Column) -> Column:
        came = F.zip_with(c, stays, lambda a, b: a + b)
        moved = F.concat(F.array(inf), F.slice(F.zip_with(c, moves, lambda a, b: a + b), 1, n - 1))
        best = F.zip_with(came, moved, lambda a, b: F.least(a, b))
        if skips is not None and n > 2:
            skipped = F.concat(F.array(inf, inf), F.slice(F.zip_with(c, skips, lambda a, b: a + b), 1, n - 2))
            best = F.zip_with(best, skipped, lambda a, b: F.least(a, b))
        out = F.zip_with(best, e, lambda a, b: a + b)
        if beam is not None:
            out = F.transform(out, lambda x: F.when(x > F.array_min(out) + beam, inf).otherwise(x))
        return out

    rest = F.slice(emissions, 2, F.greatest(F.size(emissions) - 1, F.lit(0)))
    return F.aggregate(rest, first, step)


def greedy_fold(emissions: Column, stay: list[float], move: list[float], start: int = 2) -> Column:
    """(cost, state) of the segmentation without a look ahead: from frame `start` on, move when
    staying costs more."""
    costs = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    stays, moves, n = costs(stay), costs(move), len(stay)
    zero = F.struct(F.aggregate(F.slice(emissions, 1, start), F.lit(0.0), lambda s, e: s + F.get(e, F.lit(0))).alias("cost"), F.lit(0).alias("state"))

    def step(acc: Column, e: Column) -> Column:
        s = acc["state"]
        a = F.get(e, s) + F.get(stays, s)
        b = F.coalesce(F.get(e, s + 1) + F.get(moves, s), F.lit(INF))
        go = (a > b) & (s < n - 1)
        return F.struct((acc["cost"] + F.when(go, b).otherwise(a)).alias("cost"), F.when(go, s + 1).otherwise(s).alias("state"))

    return F.aggregate(F.slice(emissions, start + 1, F.greatest(F.size(emissions) - start, F.lit(0))), zero, step)


def uniform_starts(n: Column, states: int = 5) -> Column:
    """The first frame of each state when n frames are shared out evenly."""
    return F.transform(F.sequence(F.lit(0), F.lit(states - 1)), lambda s: F.floor(s * n / states).cast("int"))


@dataclass(frozen=True)
class Graph:
    """States in topological order of their ε moves.

    before[j]: (i, cost) of the moves into j. A state that emits comes from the frame before; an
    empty (ε) state from the same frame, so those before it must stand before it, but for `back`
    moves, which come from the frame before. emit[j]: the column of emissions, or -1 for ε. word[j]:
    what is said on leaving j, or "".
    """

    before: list[list[tuple[int, float]]]
    emit: list[int]
    start: list[int]
    final: list[int]
    word: list[str] = field(default_factory=list)
    back: frozenset[tuple[int, int]] = frozenset()

    @classmethod
    def chain(cls, stay: list[float], move: list[float], skip: list[float] | None = None) -> Graph:
        n = len(stay)
        before = [[(j, stay[j])] + ([(j - 1, move[j - 1])] if j else []) + ([(j - 2, skip[j - 2])] if skip and j > 1 else []) for j in range(n)]
        return cls(before, list(range(n)), [0], [n - 1], [""] * n)

    @classmethod
    def label(cls, models: list[dict], penalty: float = 0.0) -> Graph:
        """Models one after another: each a dict of emit, stay, move lists. The last state of a model
        is left for the next model at its own cost plus the penalty."""
        stay, move, emit = [], [], []
        for m in models:
            stay += m["stay"]
            move += [*m["move"][:-1], m["move"][-1] + penalty]
            emit += m["emit"]
        g = cls.chain(stay, move)
        return cls(g.before, emit, g.start, g.final, g.word)


@dataclass
class _Plan:
    """A graph as arrays: emitting states advance together, ε states one by one."""

    emitting: np.ndarray
    column: np.ndarray
    source: np.ndarray  # emitting state x move, padded with a state of no way
    cost: np.ndarray
    empty: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]  # state, sources, costs, from this frame

    @classmethod
    def of(cls, g: Graph, prefer_move: bool) -> _Plan:
        n = len(g.emit)
        order = (lambda m: m[::-1]) if prefer_move else (lambda m: m)
        emitting = np.array([j for j in range(n) if g.emit[j] >= 0], int)
        width = max([len(g.before[j]) for j in emitting.tolist()] + [1])
        source, cost = np.full((len(emitting), width), n), np.zeros((len(emitting), width))
        for r, j in enumerate(emitting.tolist()):
            for c, (i, v) in enumerate(order(g.before[j])):
                source[r, c], cost[r, c] = i, v
        empty = []
        for j in range(n):
            if g.emit[j] < 0:
                moves = order(g.before[j])
                empty.append((j, np.array([i for i, _ in moves], int), np.array([v for _, v in moves], float), np.array([(i, j) not in g.back for i, _ in moves], bool)))
        return cls(emitting, np.array([g.emit[j] for j in emitting.tolist()], int), source, cost, empty)


def best_path(e: np.ndarray, g: Graph, prefer_move: bool = False, beam: float | None = None, own_first: bool = True, plan: _Plan | None = None) -> tuple[float, list[int]]:
    """(cost, state by frame) of the cheapest path over emissions e (frames x columns).

    Ties go to the move listed first, which is staying, or with prefer_move to the one listed last;
    of final states to the first. own_first False scores every start state by the first start
    state's column, as one decoder did. An utterance without a way through has cost infinity and no
    path. Beyond MOST_POINTERS pointers only every root-of-frames-th column is kept, and the pointers
    between are computed again for the trace back: memory then follows the root, at twice the time.
    """
    frames, n = len(e), len(g.emit)
    if not frames:
        return INF, []
    plan = plan or _Plan.of(g, prefer_move)
    rows = np.arange(len(plan.emitting))

    def column(cost: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """The next column, and the state that each of its states came from."""
        new, came = np.full(n + 1, INF), np.full(n, -1, np.int32)  # the last stands for no way
        if t == 0:
            for j in g.start:
                new[j] = e[0, g.emit[j] if own_first else g.emit[g.start[0]]]
        else:
            ways = cost[plan.source] + plan.cost
            at = ways.argmin(1)
            best = ways[rows, at]
            new[plan.emitting] = best + e[t, plan.column]
            came[plan.emitting] = np.where(best < INF, plan.source[rows, at], -1)
        for j, source, move, same in plan.empty:
            if not len(source):
                continue
            ways = np.where(same, new[source], cost[source] if t else INF) + move
            at = int(ways.argmin())
            if ways[at] < INF:
                new[j], came[j] = ways[at], source[at]
        if beam is not None:
            new[new > new.min() + beam] = INF
        return new, came

    # Pointers of all frames, or of a segment at a time, which is then computed again from the column before it.
    size = frames if frames * n <= MOST_POINTERS else math.isqrt(frames - 1) + 1
    pointers, entries = np.empty((min(size, frames), n), np.int32), []
    cost = np.full(n + 1, INF)
    for t in range(frames):
        if t % size == 0:
            entries.append(cost)
        cost, pointers[t % size] = column(cost, t)
    final = min(g.final, key=lambda j: (cost[j], j))
    if not cost[final] < INF:
        return INF, []
    path, j, t, held = [], final, frames - 1, (frames - 1) // size
    while j >= 0:
        if t // size < held:
            held = t // size
            c = entries[held]
            for k in range(held * size, (held + 1) * size):
                c, pointers[k % size] = column(c, k)
        i = int(pointers[t % size, j])
        if g.emit[j] >= 0:
            path.append(j)
            if t == 0:
                return float(cost[final]), path[::-1]
            t -= 1
        elif (i, j) in g.back:
            t -= 1
        j = i
    return INF, []


def side_by_side(sizes: np.ndarray, most: int) -> list[np.ndarray]:
    """The places of sizes, the largest first, in runs of at most `most` together, or of one."""
    order = np.argsort(-sizes, kind="stable")
    runs, held = [], 0
    for i in order.tolist():
        if not runs or held + int(sizes[i]) > most:
            runs.append([])
            held = 0
        runs[-1].append(i)
        held += int(sizes[i])
    return [np.array(r) for r in runs]


def best_paths(e: np.ndarray, sizes: np.ndarray, g: Graph, prefer_move: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(cost by utterance, state by frame) as best_path gives them, of utterances whose emissions stand in e one
    after another, sizes[u] frames each; they advance side by side. All states of g emit. An utterance without
    frames or a way through has cost infinity, and -1 for its frames. One of more than MOST_POINTERS pointers
    goes by best_path.
    """
    n, plan = len(g.emit), _Plan.of(g, prefer_move)
    costs, states, offsets = np.full(len(sizes), INF), np.full(len(e), -1, np.int32), np.cumsum(sizes) - sizes
    final = np.array(sorted(g.final))
    for run in side_by_side(sizes, max(1, MOST_POINTERS // n)):
        if sizes[run[0]] * n > MOST_POINTERS:
            at, size = int(offsets[run[0]]), int(sizes[run[0]])
            costs[run[0]], path = best_path(e[at : at + size], g, prefer_move, plan=plan)
            if path:
                states[at : at + size] = path
            continue
        run = run[sizes[run] > 0]
        if not len(run):
            continue
        # Column t of all is at first[t] of the pointers; those that have ended are the last of it.
        live = len(run) - np.searchsorted(np.sort(sizes[run]), np.arange(sizes[run[0]]), side="right")
        first, start = np.cumsum(live) - live, offsets[run]
        choice = np.zeros((int(live.sum()), n), np.int8 if plan.source.shape[1] < 128 else np.int32)
        cost = np.full((len(run), n + 1), INF)  # the last stands for no way
        for j in g.start:
            cost[:, j] = e[start, g.emit[j]]
        for t in range(1, len(live)):
            k = live[t]
            old, at = cost[:k], choice[first[t] : first[t] + k]
            best = old[:, plan.source[:, 0]] + plan.cost[:, 0]
            for w in range(1, plan.source.shape[1]):
                way = old[:, plan.source[:, w]] + plan.cost[:, w]
                less = way < best
                at[less] = w
                np.minimum(best, way, out=best)
            cost[:k, :n] = best + e[start[:k] + t][:, plan.column]
        ends = cost[:, final]
        state = final[ends.argmin(1)]
        costs[run] = ends.min(1)
        found = costs[run] < INF
        state = np.where(found, state, -1)
        for t in range(len(live) - 1, -1, -1):
            k = live[t]
            now = state[:k]
            states[start[:k] + t] = now
            if t:
                state[:k] = np.where(now >= 0, plan.source[now, choice[first[t] + np.arange(k), now]], -1)
    return costs, states


def words_of(path: list[int], g: Graph, entries: dict[int, str]) -> list[str]:
    """The words of a path: one at each entry into a model's first state from outside of it."""
    out = []
    for k, j in enumerate(path):
        if j in entries and (k == 0 or path[k - 1] != j):
            out.append(entries[j])
    return out


def align(sequences: DataFrame, graph: Graph, key: str = "utt", emissions: str = "e", prefer_move: bool = False, beam: float | None = None, own_first: bool = True) -> DataFrame:
    """(key, cost double, path array<int>) of each row's emissions; the graph is shared out."""
    shared = sequences.sparkSession.sparkContext.broadcast(graph)
    kind = dict(sequences.dtypes)[key]

    def run(batches):
        plan = _Plan.of(shared.value, prefer_move)
        for b in batches:
            got = [best_path(np.array(e or [], float).reshape(len(e or []), -1), shared.value, prefer_move, beam, own_first, plan) for e in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c for c, _ in got], pa.float64()), pa.array([p for _, p in got], pa.list_(pa.int32()))], [key, "cost", "path"])

    return sequences.select(key, emissions).mapInArrow(run, f"{key} {kind}, cost double, path array<int>")


def segments(paths: DataFrame, model_of: list[int], key: str = "utt") -> DataFrame:
    """(key, pos, model, start_t, end_t) from paths: cuts where the state's model position changes;
    model_of maps a state to its place in the label. end_t is exclusive."""
    m = F.array(*map(F.lit, model_of))
    rows = paths.select(key, F.posexplode("path").alias("t", "s")).withColumn("pos", F.get(m, F.col("s")))
    return rows.groupBy(key, "pos").agg(F.min("t").alias("start_t"), (F.max("t") + 1).alias("end_t"))


def sequences(frames: DataFrame, key: str, index: str, values: Column, name: str = "e") -> DataFrame:
    """One row a key with its frames' values in order of index."""
    return frames.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), values.alias("v")))), lambda s: s["v"]).alias(name))
