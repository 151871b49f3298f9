"""Benchmark decontamination: pigeonhole search and Myers' bit-parallel distance.

A benchmark item within `budget` edits of a passage shares at least one of its budget + 1 pieces
with it unchanged. All pieces of all items go into one automaton, each document is read through it
once, and what lies around a hit is verified with Myers' bit-parallel edit distance.

Both sides are compared as lower-case words joined by single blanks.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


_WORDS = re.compile(r"\w+")

#: Letters of benchmark text in one automaton; larger benchmarks are searched in several.
BLOCK_CHARS = 4_000_000


def normal(text: str | None) -> str:
    return " ".join(_WORDS.findall(text or "")).lower()


def budget_of(length: int, rate: float) -> int:
    """The edits allowed for an item of so many letters: pieces keep 8 letters at least."""
    return max(0, min(int(length * rate), length // 8 - 1))


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(distance, end): the least edit distance of pattern to any passage of text, and where the
    first such passage ends. Bit-parallel, one step a letter of text."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up) & full
        mh = up & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        up = mh | ~(xv | ph) & full
        down = ph & xv
        if score < best:
            best, end = score, i + 1
    return best, end


class Matcher:
    """Finds the items of a benchmark in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        """items: ids and normal texts. Repeated texts share one pattern."""
        ids: dict[str, list[int]] = {}
        for i, t in items:
            if t:
                ids.setdefault(t, []).append(i)
        self.items = [(t, budget_of(len(t), rate), sorted(set(own))) for t, own in sorted(ids.items())]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (t, k, _) in enumerate(self.items):
            cuts = [len(t) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(t[a:b], []).append((n, b))
        self.automaton = ahocorasick.Automaton()
        for p, where in pieces.items():
            self.automaton.add_word(p, where)
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of each item's nearest passage within its budget, the
        first of equals, in the normal text given."""
        if self.empty or not text:
            return []
        starts: dict[int, set[int]] = {}
        for last, where in self.automaton.iter(text):
            for n, end in where:
                starts.setdefault(n, set()).add(last + 1 - end)
        out = []
        for n, own in sorted(starts.items()):
            pattern, k, ids = self.items[n]
            m, best = len(pattern), None
            reach, done = -1, sorted(own)
            for at in done:
                if at >= 0 and text.startswith(pattern, at) and (k or (text[at - 1 : at] in ("", " ") and text[at + m : at + m + 1] in ("", " "))):
                    best = (0, at, at + m)
                    break
            if best is None and k:
                i = 0
                while i < len(done):
                    lo, hi = done[i] - k, done[i] + m + k
                    while i + 1 < len(done) and done[i + 1] - k <= lo + m:  # windows that overlap are read once
                        i += 1
                        hi = done[i] + m + k
                    i += 1
                    lo = max(0, lo)
                    d, end = myers(pattern, text[lo:hi])
                    if d <= k and (best is None or d < best[0]):
                        _, back = myers(pattern[::-1], text[max(0, lo + end - m - k) : lo + end][::-1])
                        best = (d, lo + end - back, lo + end)
            if best:
                out += [(i, *best) for i in ids]
        return out


_LAST: list = []


def _matcher(items: list[tuple[int, str]], rate: float) -> Matcher:
    """The matcher of a broadcast list, kept by a worker for its next tasks."""
    if not (_LAST and _LAST[0] is items and _LAST[1] == rate):
        _LAST[:] = [items, rate, Matcher(items, rate)]
    return _LAST[2]


def _original(text: str, plain: str, start: int, end: int) -> tuple[int, int]:
    """Where the words of the normal text's passage stand in the text itself."""
    first, last = plain.count(" ", 0, start), plain.count(" ", 0, end)
    a = b = 0
    for i, m in enumerate(_WORDS.finditer(text)):
        if i == first:
            a = m.start()
        if i == last:
            b = m.end()
            break
    return a, b


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """The benchmark's (id, normal text), in lists of a bounded size."""
    own = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t is not null and i is not null")
    chars = own.agg(F.sum(F.length("t") + 64)).first()[0] or 0
    n = -(-int(chars) // BLOCK_CHARS)
    for k in range(n):
        rows = own if n == 1 else own.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r["i"], normal(r["t"])) for r in rows.collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id long, item_id long, distance int, start int, end int): every document and item where
    a passage lies within the item's budget, `rate` edits a letter; the nearest passage's distance
    and place (code points of the text as given, the end exclusive).

    Items too short for two pieces of 8 letters are looked for unchanged and as whole words; null
    and empty items, and null item ids, are looked for not at all. Null and empty texts hold
    nothing. Rows with a null or repeated doc_id are read like any other. No other column is read.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, distance int, start int, end int"
    out = None
    for items in _item_blocks(benchmark, item_id_col, item_text_col):
        shared = spark.sparkContext.broadcast(items)  # at most about BLOCK_CHARS letters

        def run(batches, shared=shared):
            matcher = _matcher(shared.value, rate)
            for b in batches:
                rows = []
                for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    plain = normal(t)
                    for i, dist, s, e in matcher.find(plain):
                        rows.append((d, i, dist, *_original(t, plain, s, e)))
                cols = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "distance", "start", "end"])

        part = own.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark item within its budget, with all their columns."""
    spark = docs.sparkSession
    i = docs.columns.index(text_col)
    for items in _item_blocks(benchmark, item_id_col, item_text_col):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            matcher = _matcher(shared.value, rate)
            for b in batches:
                yield b.filter(pa.array([not matcher.find(normal(t)) for t in b.column(i).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
