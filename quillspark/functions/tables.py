"""Table functions and Arrow functions for SQL users.

Those over tables take any table that has their columns, a partition of it at a time, in order:

    SELECT * FROM align(TABLE(emissions) PARTITION BY utt ORDER BY (t), array(0.2, 0.2), array(0.7, 0.7))
    SELECT * FROM framed(TABLE(samples) PARTITION BY utt ORDER BY (i), 400, 160)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, SelectedColumn


@F.udtf(returnType="f int, frame array<double>")
class Frames:
    """frames(samples, width, shift): the full frames of one array of samples."""

    def eval(self, samples, width: int, shift: int):
        for f in range(max(0, (len(samples or []) - width) // shift + 1)):
            yield f, [float(x) for x in samples[f * shift : f * shift + width]]


@F.udtf(returnType="src int, dst int, word string")
class GrammarEdges:
    """grammar_edges(text): the edges of a grammar's text."""

    def eval(self, text: str):
        import re

        for line in (text or "").splitlines():
            m = re.fullmatch(r'\s*Edge\s+(\d+)\s+(\d+)(?:\s+"([^"\s]*)"*)?\s*', line)
            if m:
                yield int(m[1]), int(m[2]), m[3] or None


@F.arrow_udf(ArrayType(DoubleType()))
def power_spectrum(frames: pa.Array) -> pa.Array:
    """Squared magnitudes of the real transform of each frame; a null frame stays null."""
    return pa.array([None if f is None else (np.abs(np.fft.rfft(f)) ** 2).tolist() for f in frames.to_pylist()], pa.list_(pa.float64()))


def _columns(rows: AnalyzeArgument, *names: str) -> dict:
    """The types of a table argument's columns of these names; a ValueError where one lacks."""
    if not rows.isTable:
        raise ValueError("the first argument is to be a table: TABLE(...) PARTITION BY utt ORDER BY ...")
    kinds = {f.name: f.dataType for f in rows.dataType.fields}
    if missing := [n for n in names if n not in kinds]:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    return kinds


@F.udtf
class Align:
    """align(table(utt, t, e), stay, move): the cheapest path of each partition's frames, in order of t,
    through a chain with these costs of staying in a state and of leaving it; e has a cost a state.

    Rows utt, t, state and the whole path's cost. A partition without a way through has one row, without t
    and state, whose cost is infinity. A null e is no way through its frame.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, stay: AnalyzeArgument, move: AnalyzeArgument) -> AnalyzeResult:
        kinds = _columns(rows, "utt", "t", "e")
        schema = StructType().add("utt", kinds["utt"]).add("t", LongType()).add("state", IntegerType()).add("cost", DoubleType())
        return AnalyzeResult(schema=schema, select=[SelectedColumn("utt"), SelectedColumn("t"), SelectedColumn("e")])

    def __init__(self) -> None:
        self.utt, self.t, self.e, self.costs = None, [], [], None

    def eval(self, row, stay, move):
        self.utt, self.costs = row["utt"], (stay, move)
        self.t.append(row["t"])
        self.e.append(row["e"])

    def terminate(self):
        if self.costs is None:
            return
        from ..operators.trellis import INF, Graph, best_path

        stay, move = ([float(x) for x in c] for c in self.costs)
        e = np.array([[INF] * len(stay) if x is None else [INF if v is None else float(v) for v in x] for x in self.e])
        cost, path = best_path(e, Graph.chain(stay, move))
        for t, state in zip(self.t, path):
            yield self.utt, t, state, cost
        if not path:
            yield self.utt, None, None, cost


@F.udtf
class Framed:
    """framed(table(utt, i, x), width, shift): the full frames of each partition's samples, in order of i,
    with a frame's samples in memory at a time."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, width: AnalyzeArgument, shift: AnalyzeArgument) -> AnalyzeResult:
        kinds = _columns(rows, "utt", "i", "x")
        schema = StructType().add("utt", kinds["utt"]).add("f", LongType()).add("frame", ArrayType(DoubleType()))
        return AnalyzeResult(schema=schema, select=[SelectedColumn("utt"), SelectedColumn("i"), SelectedColumn("x")])

    def __init__(self) -> None:
        self.held, self.first, self.f = [], 0, 0

    def eval(self, row, width, shift):
        begin = self.f * shift
        if self.first + len(self.held) < begin and not self.held:  # between frames
            self.first += 1
            return
        self.held.append(None if row["x"] is None else float(row["x"]))
        if len(self.held) == width:
            yield row["utt"], self.f, self.held
            self.f += 1
            self.first, self.held = (self.first + shift, self.held[shift:]) if shift <= width else (self.first + width, [])


def register(spark: SparkSession) -> None:
    """Makes frames(), grammar_edges(), align(), framed() and power_spectrum() known to SQL."""
    spark.udtf.register("align", Align)
    spark.udtf.register("framed", Framed)
    spark.udtf.register("frames", Frames)
    spark.udtf.register("grammar_edges", GrammarEdges)
    spark.udf.register("power_spectrum", power_spectrum)
