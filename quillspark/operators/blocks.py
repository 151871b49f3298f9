"""Cheapest paths of long utterances, spread over many tasks.

trellis.align folds an utterance's frames in one task. Here they are cut into blocks. What a block
does to the costs of its states is a matrix: the cheapest way from each state of the column before it
to each of its last column. Such matrices combine by min-plus products, which are associative, so a tree
of groups of blocks gives the column before every block, in rounds of the logarithm of their number.
From there each block says, for each state it may end in, the state that its cheapest path came from;
these maps combine as well, and tell every block the state in which the whole path leaves it. A last
pass finds the path inside each block. Every pass runs over all blocks of all utterances at once, and
no task holds more than a group of blocks' matrices or one block.

A matrix costs as many columns as the graph has states, so this form does that many times the work of
the serial one, at a depth of a block plus the tree: it is for utterances that one task cannot hold or
would be too slow for. A beam depends on all that came before and cannot be combined; there is none here.

Sums in another order round differently. Emissions and costs are therefore rounded to multiples of
`grain`, a power of two, of which sums below 2^53 grains are exact in any order: costs, paths and ties
are those of trellis.best_path over the same rounded costs, whatever the blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .trellis import INF, Graph, _Plan, side_by_side

#: A block's matrix has the square of the states; more belong into trellis.align.
MOST_STATES = 2_000
#: Doubles of entry columns that are broadcast; more meet their blocks by a shuffle.
MOST_DOUBLES = 4_000_000
#: 2^BITS neighbours are combined in a round.
BITS = 5
#: Doubles of matrices, or of pointers, that advance side by side in a task.
SIDE_BY_SIDE = 1_000_000
#: Nodes of a tree, and doubles of theirs, that a task takes at once: neighbouring groups go together.
TOGETHER, MOST_TOGETHER = 1 << 12, 1 << 20
GRAIN = 2.0**-20


def rounded(graph: Graph, grain: float) -> Graph:
    """The graph with its costs as multiples of the grain."""
    return replace(graph, before=[[(i, _grains(np.float64(c), grain).item()) for i, c in moves] for moves in graph.before])


def _grains(x: np.ndarray, grain: float) -> np.ndarray:
    return np.rint(x / grain) * grain


@dataclass
class Columns:
    """Steps of trellis columns, for many columns side by side. The last entry of a column stands for no way."""

    graph: Graph
    plan: _Plan
    own_first: bool = True

    @property
    def n(self) -> int:
        return len(self.graph.emit)

    def first(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(column, came) of an utterance's first frame."""
        new, came, g = np.full(self.n + 1, INF), np.full(self.n, -1), self.graph
        for j in g.start:
            new[j] = e[g.emit[j] if self.own_first else g.emit[g.start[0]]]
        for j, source, move, same in self.plan.empty:
            if len(source):
                ways = np.where(same, new[source], INF) + move
                at = ways.argmin()
                if ways[at] < INF:
                    new[j], came[j] = ways[at], source[at]
        return new, came

    def step(self, cost: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From columns (rows x states + 1) and emissions of one frame, or of one a row: the next columns, and
        the state that each of their states came from (-1: none)."""
        p, rows = self.plan, np.arange(len(cost))
        new, came = np.full_like(cost, INF), np.full((len(cost), self.n), -1)
        ways = cost[:, p.source] + p.cost
        at = ways.argmin(2)
        best = np.take_along_axis(ways, at[..., None], 2)[..., 0]
        new[:, p.emitting] = best + e[..., p.column]
        came[:, p.emitting] = np.where(best < INF, p.source[np.arange(len(p.emitting)), at], -1)
        for j, source, move, same in p.empty:
            if not len(source):
                continue
            ways = np.where(same, new[:, source], cost[:, source]) + move
            at = ways.argmin(1)
            best = ways[rows, at]
            new[:, j] = np.where(best < INF, best, INF)
            came[:, j] = np.where(best < INF, source[at], -1)
        return new, came

    def matrix(self, e: np.ndarray, opens: bool) -> np.ndarray:
        """What a block does: states x states, or one row where it opens the utterance."""
        return self.matrices([e], [opens])[0]

    def matrices(self, es: list[np.ndarray], opens: list[bool]) -> list[np.ndarray]:
        """matrix() of blocks, which advance side by side."""
        out: list = [None] * len(es)
        for run in side_by_side(np.array([self.n * self.n] * len(es)), SIDE_BY_SIDE):
            # By frames that are still to come; the first of an opening block is no step.
            run = run[np.argsort([-(len(es[i]) - opens[i]) for i in run.tolist()], kind="stable")]
            starts = []
            for i in run.tolist():
                if opens[i]:
                    starts.append(self.first(es[i][0])[0][None])
                else:
                    cost = np.full((self.n, self.n + 1), INF)
                    np.fill_diagonal(cost, 0.0)
                    starts.append(cost)
            rows = np.array([len(x) for x in starts])
            cost, e = np.concatenate(starts), np.concatenate([es[i] for i in run.tolist()])
            left = np.array([len(es[i]) - opens[i] for i in run.tolist()])
            sizes = np.array([len(es[i]) for i in run.tolist()])
            begin = np.repeat(np.cumsum(sizes) - left, rows)
            for t in range(int(left[0])):
                k = int(rows[left > t].sum())
                cost[:k] = self.step(cost[:k], e[begin[:k] + t])[0]
            for i, x in zip(run.tolist(), np.split(cost, np.cumsum(rows)[:-1])):
                out[i] = x[:, :-1]
        return out

    def run(self, entries: list[np.ndarray | None], es: list[np.ndarray]):
        """(t, blocks, came) of blocks of falling length side by side, from the columns before them (None: it
        opens the utterance): came of frame t of the first so many of them."""
        sizes = np.array([len(e) for e in es])
        e, begin = np.concatenate(es), np.cumsum(sizes) - sizes
        opens = np.array([v is None for v in entries])
        cost = np.array([np.full(self.n + 1, INF) if v is None else np.append(v, INF) for v in entries])
        for t in range(int(sizes[0])):
            k = int((sizes > t).sum())
            new, came = self.step(cost[:k], e[begin[:k] + t])
            if not t:
                for i in np.flatnonzero(opens).tolist():
                    new[i], came[i] = self.first(es[i][0])
            cost[:k] = new
            yield t, k, came

    def origins(self, entry: np.ndarray | None, e: np.ndarray) -> np.ndarray:
        """For each state at a block's end, the state of the column before it that its path came from."""
        return self.all_origins([entry], [e])[0]

    def all_origins(self, entries: list[np.ndarray | None], es: list[np.ndarray]) -> np.ndarray:
        """origins() of blocks, which advance side by side."""
        out = np.empty((len(es), self.n), int)
        for run in side_by_side(np.array([len(e) for e in es]), SIDE_BY_SIDE // self.n):
            own = np.tile(np.append(np.arange(self.n), -1), (len(run), 1))
            own[[entries[i] is None for i in run.tolist()]] = -1
            for _, k, came in self.run([entries[i] for i in run.tolist()], [es[i] for i in run.tolist()]):
                new = np.full((k, self.n + 1), -1)
                new[:, :-1] = np.take_along_axis(own[:k], came, 1)
                for j, source, _, same in self.plan.empty:  # in order: an ε move stays in the frame
                    inside = np.isin(came[:, j], source[same])
                    new[inside, j] = new[inside, came[inside, j]]
                own[:k] = new
            out[run] = own[:, :-1]
        return out

    def path(self, entry: np.ndarray | None, e: np.ndarray, leaves: int) -> list[tuple[int, int]]:
        """(frame of the block, emitting state) of the path that leaves it in a given state."""
        return self.paths([entry], [e], [leaves])[0]

    def paths(self, entries: list[np.ndarray | None], es: list[np.ndarray], leaves: list[int]) -> list[list[tuple[int, int]]]:
        """path() of blocks, whose columns advance side by side."""
        paths: list = [None] * len(es)
        for run in side_by_side(np.array([len(e) for e in es]), SIDE_BY_SIDE // self.n):
            run, sizes = run.tolist(), np.array([len(es[i]) for i in run])
            begin, pointers = np.cumsum(sizes) - sizes, np.empty((int(sizes.sum()), self.n), np.int32)
            for t, k, came in self.run([entries[i] for i in run], [es[i] for i in run]):
                pointers[begin[:k] + t] = came
            for i, at in zip(run, begin.tolist()):
                came, out, j, t = pointers[at : at + len(es[i])].tolist(), [], leaves[i], len(es[i]) - 1
                while t >= 0 and j >= 0:
                    before = came[t][j]
                    if self.graph.emit[j] >= 0:
                        out.append((t, j))
                        t -= 1
                    elif (before, j) in self.graph.back:
                        t -= 1
                    j = before
                paths[i] = out[::-1]
        return paths


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The min-plus product of rows of a with b."""
    return np.stack([(row[:, None] + b).min(0) for row in a])


def _values(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.array(x, float) for x in column.to_pylist()]


def _more(bits: int, n: int) -> int:
    """2^this neighbouring groups of 2^bits nodes of n x n doubles go to Python together."""
    return max(0, min(TOGETHER, MOST_TOGETHER // (n * n)).bit_length() - 1 - bits)


def _groups(t: pa.Table):
    """The rows of a table in order of b, and (first, end) of those of each p."""
    t = t.sort_by("b")
    p = t.column("p").to_numpy()
    cuts = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), len(p)]
    return t, list(zip(cuts, cuts[1:]))


def _up(nodes: DataFrame, kind: str, bits: int, more: int, merge: Callable[[list[np.ndarray]], np.ndarray]) -> list[DataFrame]:
    """nodes (key, b, m) and above them the tables of 2^bits of them merged, to the last with one a key."""

    def run(t: pa.Table) -> pa.Table:
        t, groups = _groups(t)
        first, ms = pa.array([a for a, _ in groups]), _values(t.column("m"))
        return pa.table({"key": t.column("key").take(first), "b": t.column("p").take(first), "m": pa.array([merge(ms[a:b]).ravel() for a, b in groups], pa.list_(pa.float64()))})

    levels, top = [nodes], nodes.agg(F.max("b")).first()[0] or 0
    while top:
        rows = nodes.withColumn("p", F.shiftright("b", bits)).withColumn("q", F.shiftright("p", more))
        nodes = stored(rows.groupBy("key", "q").applyInArrow(run, f"key {kind}, b long, m array<double>"))
        levels.append(nodes)
        top >>= bits
    return levels


def _down(levels: list[DataFrame], kind: str, bits: int, more: int, given: DataFrame | None, spread: Callable[[np.ndarray | None, list[np.ndarray]], list]) -> DataFrame:
    """(key, b, v) of the lowest level's nodes, from that of the highest (key, v); null where not given."""

    def run(t: pa.Table) -> pa.Table:
        t, groups = _groups(t)
        ms, out = _values(t.column("m")), []
        for a, b in groups:
            v = t.column("v")[a].as_py()
            out += spread(None if v is None else np.array(v, float), ms[a:b])
        return pa.table({"key": t.column("key"), "b": t.column("b"), "v": pa.array(out, pa.list_(pa.float64()))})

    root = levels[-1].select("key", "b")
    v = root.withColumn("v", F.lit(None).cast("array<double>")) if given is None else root.join(given, "key")
    for nodes in levels[-2::-1]:
        held = nodes.withColumn("p", F.shiftright("b", bits)).join(v.select("key", F.col("b").alias("p"), "v"), ["key", "p"])
        v = stored(held.withColumn("q", F.shiftright("p", more)).groupBy("key", "q").applyInArrow(run, f"key {kind}, b long, v array<double>"))
    return v


def in_blocks(frames: DataFrame, key: str, index: str, emissions: Column | str, block: int) -> DataFrame:
    """(key, b, e): frames gathered by blocks, in order; the frame's place says its block."""
    e = F.col(emissions) if isinstance(emissions, str) else emissions
    rows = frames.select(F.col(key).alias("key"), F.floor(F.col(index) / block).cast("long").alias("b"), F.struct(F.col(index).cast("long").alias("t"), e.cast("array<double>").alias("e")).alias("f"))
    return rows.groupBy("key", "b").agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["e"]).alias("e"))


@dataclass
class Aligned:
    """costs: (key, cost double), infinity where there is no way through. paths: (key, t long, state int)
    of each frame that a state of the path emits."""

    costs: DataFrame
    paths: DataFrame


def align(frames: DataFrame, graph: Graph, key: str = "utt", index: str = "t", emissions: Column | str = "e", block: int = 4096, bits: int = BITS, prefer_move: bool = False, own_first: bool = True, grain: float = GRAIN) -> Aligned:
    """The cheapest path of every utterance of frames (key, index, emissions), a row a frame, as
    trellis.best_path finds it, with blocks of `block` frames.

    index counts an utterance's frames from 0 without gaps (relational.ranked gives such a one); emissions
    are an array by column. A null emission, or a null array, is no way through its frame. Ties go to the
    move listed first, or with prefer_move to the one listed last. Utterances with a null key or index
    take no part. A graph of more than MOST_STATES states raises a ValueError.
    """
    if len(graph.emit) > MOST_STATES:
        raise ValueError(f"{len(graph.emit)} states are too many for a block's matrix; {MOST_STATES} are allowed")
    if block < 1 or bits < 1:
        raise ValueError("a block holds a frame at least, and a group two blocks")
    kind, n = dict(frames.dtypes)[key], len(graph.emit)
    graph = rounded(graph, grain)
    shared = frames.sparkSession.sparkContext.broadcast((graph, prefer_move, own_first))
    width = max(graph.emit) + 1

    def kernel() -> Columns:
        g, moves, own = shared.value
        return Columns(g, _Plan.of(g, moves), own)

    def read(column: pa.ListArray) -> list[np.ndarray]:
        frames = column.flatten()
        if frames.null_count or frames.value_lengths().unique().to_pylist() != [width]:
            return [_grains(np.array([[INF] * width if f is None else [INF if x is None else x for x in f] for f in e], float), grain) for e in column.to_pylist()]
        e = _grains(frames.flatten().fill_null(INF).to_numpy(zero_copy_only=False).astype(float).reshape(-1, width), grain)
        return np.split(e, np.cumsum(column.value_lengths().to_numpy())[:-1])

    def arrays(column: pa.ListArray) -> list[np.ndarray | None]:
        return [None if v is None else np.array(v, float) for v in column.to_pylist()]

    def matrices(batches):
        own = kernel()
        for b in batches:
            got = [m.ravel() for m in own.matrices(read(b.column(2)), [at == 0 for at in b.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.list_(pa.float64()))], ["key", "b", "m"])

    def joined(ms: list[np.ndarray]) -> np.ndarray:
        out = ms[0].reshape(-1, n)
        for m in ms[1:]:
            out = product(out, m.reshape(n, n))
        return out

    def entries(v: np.ndarray | None, ms: list[np.ndarray]) -> list:
        out = []
        for m in ms:
            out.append(v)
            v = m if v is None else product(v[None], m.reshape(n, n))[0]
        return out

    more = _more(bits, n)
    blocks = stored(in_blocks(frames.where(F.col(key).isNotNull() & F.col(index).isNotNull()), key, index, emissions, block))
    levels = _up(stored(blocks.mapInArrow(matrices, f"key {kind}, b long, m array<double>")), kind, bits, more, joined)
    ends = F.array(*[F.struct(F.get("m", F.lit(j)).alias("cost"), F.lit(j).alias("state")) for j in graph.final])
    ends = stored(levels[-1].select("key", F.array_min(ends).alias("end")).select("key", "end.*"))
    before = _down(levels, kind, bits, more, None, entries)

    def held(v: DataFrame, name: str) -> DataFrame:
        v = stored(v.select("key", "b", F.col("v").alias(name)))
        return F.broadcast(v) if v.count() * n <= MOST_DOUBLES else v.hint("shuffle_hash")

    blocks = blocks.join(held(before, "entry"), ["key", "b"])

    def came(batches):
        own = kernel()
        for b in batches:
            got = own.all_origins(arrays(b.column(3)), read(b.column(2))).astype(float)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(got), pa.list_(pa.float64()))], ["key", "b", "m"])

    def composed(fs: list[np.ndarray]) -> np.ndarray:
        at = np.arange(n + 1)
        at[-1] = -1
        for f in fs[::-1]:
            at = np.append(f, -1).astype(int)[at]
        return at[:-1].astype(float)

    def exits(v: np.ndarray | None, fs: list[np.ndarray]) -> list:
        out, j = [], int(v[0])
        for f in fs[::-1]:
            out.append([float(j)])
            j = int(f[j]) if j >= 0 else -1
        return out[::-1]

    last = ends.where(F.col("cost") < INF).select("key", F.array(F.col("state").cast("double")).alias("v"))
    levels = _up(stored(blocks.select("key", "b", "e", "entry").mapInArrow(came, f"key {kind}, b long, m array<double>")), kind, bits, more, composed)
    after = _down(levels, kind, bits, more, last, exits)

    def path(batches):
        own = kernel()
        for b in batches:
            keys, rows = [], []
            leaves = [int(j) for j, in b.column(4).to_pylist()]
            for i, (at, got) in enumerate(zip(b.column(1).to_pylist(), own.paths(arrays(b.column(3)), read(b.column(2)), leaves))):
                keys += [i] * len(got)
                rows += [(at * block + t, j) for t, j in got]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, pa.int64())), pa.array([t for t, _ in rows], pa.int64()), pa.array([j for _, j in rows], pa.int32())], [key, "t", "state"])

    paths = blocks.join(held(after, "leaves"), ["key", "b"]).select("key", "b", "e", "entry", "leaves").mapInArrow(path, f"`{key}` {kind}, t long, state int")
    return Aligned(ends.select(F.col("key").alias(key), "cost"), paths)
