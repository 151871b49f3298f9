"""Decoding: feature sequences to words, under a grammar and with trained models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import passing
from .grammar import compile_graph
from .training import Model, _checked, _frames
from .trellis import best_path


def decode(sequences: DataFrame, edges: list[tuple[int, int, str | None]], models: dict[str, Model], start: int, end: int, exit_penalty: float = 200.0, back_penalty: float = 0.0, beam: float | None = None, own_first: bool = True, silence: str | None = None, counts: bool = False) -> DataFrame:
    """(utt, cost double, words array<string>) of sequences (utt, frames array<array<double>>).

    The grammar is compiled once and shared out with the models; a batch's utterances advance side by
    side (see passing). Words equal to silence are left out. An utterance without frames, or that no
    sentence fits, has cost infinity and no words. counts: a column scored, of how many frames were
    scored in how many states together.
    """
    names = sorted(models)
    at, layout = {}, 0
    for w in names:
        at[w], layout = layout, layout + len(models[w].states)
    parts = {w: {"emit": list(range(at[w], at[w] + len(models[w].states))), "stay": models[w].stay, "move": models[w].move} for w in names}
    graph, entries = compile_graph(edges, parts, start, end, exit_penalty, back_penalty)
    shared = sequences.sparkSession.sparkContext.broadcast((graph, entries, [mix for w in names for mix in _checked(models)[w].states]))
    kind = dict(sequences.dtypes)["utt"]

    def run(batches):
        graph, entries, columns = shared.value
        scorer = passing.Scorer(columns)
        for b in batches:
            heard = passing.decode([_frames(b.column(1)[i]) for i in range(b.num_rows)], graph, entries, scorer, beam, own_first)
            words = [[w for w in h.words if w != silence] for h in heard]
            cols = [b.column(0), pa.array([h.cost for h in heard], pa.float64()), pa.array(words, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols + [pa.array([h.scored for h in heard], pa.int64())] * counts, ["utt", "cost", "words"] + ["scored"] * counts)

    return sequences.select("utt", "frames").mapInArrow(run, f"utt {kind}, cost double, words array<string>" + ", scored long" * counts)


def recognise(sequences: DataFrame, models: dict[str, Model]) -> DataFrame:
    """(utt, word, cost): each sequence as one word, the model of least cost; ties go to the first
    by name, and a sequence too short for all models has none."""
    names = sorted(models)
    from .trellis import Graph

    shared = sequences.sparkSession.sparkContext.broadcast([(w, _checked(models)[w]) for w in names])
    kind = dict(sequences.dtypes)["utt"]

    def run(batches):
        for b in batches:
            words, costs = [], []
            for frames in b.column(1).to_pylist():
                best = (float("inf"), None)
                for w, m in shared.value if frames else []:
                    cost, _ = best_path(m.emissions(np.array(frames, float)), Graph.chain(m.stay, m.move))
                    if cost < best[0]:
                        best = (cost, w)
                costs.append(best[0])
                words.append(best[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.string()), pa.array(costs, pa.float64())], ["utt", "word", "cost"])

    return sequences.select("utt", "frames").mapInArrow(run, f"utt {kind}, word string, cost double")


def as_text(decoded: DataFrame) -> DataFrame:
    return decoded.withColumn("result", F.array_join("words", ""))
