"""Grammars of word models: an edge list is parsed, compiled to a state graph, and decoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, stored
from .trellis import Graph


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """(src int, dst int, word string) of `Edge from to ["word"]` lines; a line without a word is an
    empty move; other lines are left out. A stray second quote does no harm."""
    pattern = r'^\s*Edge\s+(\d+)\s+(\d+)(?:\s+"([^"\s]*)"*)?\s*$'
    rows = lines.where(F.col(column).rlike(pattern))
    part = lambda k: F.regexp_extract(column, pattern, k)
    return rows.select(part(1).cast("int").alias("src"), part(2).cast("int").alias("dst"), F.when(part(3) != "", part(3)).alias("word"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def reachable(edges: DataFrame, start: int = 0, max_steps: int | None = None, hops: int = 8) -> DataFrame:
    """(state int, steps int): what is reached from start, and by how few moves at least; in max_steps
    moves, if given.

    A search by layers: each state is kept once, with its least steps, and moves go on only from states that
    are new. A job takes `hops` layers, in each of which a state stands once, so that the rows of a job are at
    most hops times the states, however many paths there are, and a chain of n states takes n / hops jobs.
    Edges with a null end lead nowhere.
    """
    spark = edges.sparkSession
    moves = stored(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    reached = layer = stored(spark.createDataFrame([(int(start), 0)], "state int, steps int"))
    done = 0
    while max_steps is None or done < max_steps:
        many = hops if max_steps is None else min(hops, max_steps - done)
        found, now = None, layer
        for _ in range(many):
            now = now.join(moves, F.col("state") == F.col("src")).groupBy(F.col("dst").cast("int").alias("state")).agg((F.min("steps") + 1).alias("steps"))
            found = now if found is None else found.union(now)
        found = found.groupBy("state").agg(F.min("steps").alias("steps")).join(reached.select("state"), "state", "left_anti")
        last, reached = reached, stored(reached.union(found))
        discard(last)
        done += many
        layer = reached.where(F.col("steps") == done)
        if layer.isEmpty():
            break
    return reached


def compile_graph(edges: list[tuple[int, int, str | None]], models: dict[str, dict], start: int, end: int, exit_penalty: float = 200.0, back_penalty: float = 0.0) -> tuple[Graph, dict[int, str]]:
    """The state graph of a grammar, and each model's entry state with its word.

    Every grammar state is an empty state; each worded edge is its model's states in a chain. An
    emitting first state is entered from the frame before. Empty moves to a later grammar state pass
    within a frame; those to an earlier one (a loop) come from the frame before. Leaving a word's
    last state costs exit_penalty, and staying in it nothing.
    """
    order = sorted({s for a, b, _ in edges for s in (a, b)} | {start, end})
    inner: dict[int, list[tuple[int, int, str]]] = {s: [] for s in order}
    for a, b, w in edges:
        if w is not None:
            inner[b].append((a, b, w))
    before: list[list[tuple[int, float]]] = []
    emit: list[int] = []
    word: list[str] = []
    place: dict[int, int] = {}
    pending: list[tuple[int, int]] = []
    entries: dict[int, str] = {}
    first_states = {start}  # what empty moves reach before any frame
    while more := {b for a, b, w in edges if w is None and a in first_states} - first_states:
        first_states |= more
    exits: dict[int, list[int]] = {s: [] for s in order}
    starts = []
    for s in order:
        for a, _, w in inner[s]:
            m, first = models[w], len(emit)
            n = len(m["emit"])
            for k in range(n):
                last = k == n - 1
                moves = [(first + k, 0.0 if last else m["stay"][k])]
                if k:
                    moves.append((first + k - 1, m["move"][k - 1]))
                before.append(moves)
                emit.append(m["emit"][k])
                word.append("")
            entries[first] = w
            pending.append((first, a))
            if a in first_states:
                starts.append(first)
            exits[s].append(first + n - 1)
            word[-1] = w
        place[s] = len(emit)
        before.append([(x, exit_penalty) for x in exits[s]])
        emit.append(-1)
        word.append("")
    back = set()
    for first, a in pending:
        before[first].append((place[a], 0.0))
    for a, b, w in edges:
        if w is None:
            before[place[b]].append((place[a], back_penalty if place[a] >= place[b] else 0.0))
            if place[a] >= place[b]:
                back.add((place[a], place[b]))
    return Graph(before, emit, starts, [place[end]], word, frozenset(back)), entries


def phone_grammar(digits: str = "0123456789", first: str = "23456789", silence: str | None = None) -> list[tuple[int, int, str | None]]:
    """Numbers of seven digits, the first of `first`, or of the last four alone; silence, where it
    has a model, may stand before, between and behind digits, and may repeat."""
    edges: list[tuple[int, int, str | None]] = [(k, k + 1, d) for k in range(7) for d in (first if k == 0 else digits)]
    edges.append((0, 3, None))
    if silence is not None:
        edges += [(k, k, silence) for k in range(8)]
    return edges
