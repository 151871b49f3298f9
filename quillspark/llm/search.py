"""Ranked lexical search over document-sharded postings.

The index is a table with a row for each shard of documents: its documents in order of id, its terms
in order, and its postings in compressed sparse rows, term by term, each with its document's place in
the shard and an integer impact that is computed beforehand. A search reads each shard once: term by
term, impacts are added up in a dense array by document, the best k are taken with argpartition, ties
by id, and merged over the shards.

Building it takes one pass over the texts, which stores each shard's counts; a term's weight is
computed from its document frequency, summed over shards by a shuffle of (term, shard, frequency), and
goes back to the shards where more than one has the term; there impacts are computed. A shard holds a bounded number of words and
documents, so neither a hot source nor a hot term gathers in one task: a term has one row a shard.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, fleeting, stored

#: Words and documents after which a shard is closed.
SHARD_WORDS = 1 << 20
SHARD_DOCS = 1 << 16
#: Bytes of a text that are cut into terms at once.
BLOCK = 1 << 20
#: Letters of items that are broadcast at once; of more, each block reads the index.
ITEM_CHARS = 4_000_000

# A term is a run of ASCII letters, digits and all that is not ASCII; in UTF-8 the latter are the bytes from 80 on.
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_BREAK = re.compile(rb"[^0-9a-z\x80-\xff]")
#: Row groups are small: a reader holds whole ones, and a row holds a shard.
_WRITE = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "compression": "zstd"}

_SHARD = "shard long, n_docs long, n_words long, doc_ids array<long>, lengths array<long>, terms array<binary>, dfs array<int>, docs array<int>, tfs array<int>"
_INDEX = "shard long, doc_ids array<long>, terms array<binary>, dfs array<int>, docs array<int>, impacts array<long>"


def terms_of(data: bytes, block: int = BLOCK):
    """The terms of a text's UTF-8 bytes, repeats included, as lists: one for each block of it. Only A-Z
    become lower case."""
    at = 0
    while at < len(data):
        end = at + block
        if end < len(data):
            gap = _BREAK.search(data[at:end].lower()[::-1])
            if gap:  # back to the last break
                end -= gap.start()
            else:
                while end < len(data) and not _BREAK.match(data[end : end + 1].lower()):
                    end += 1
        yield _TERM.findall(data[at:end].lower())
        at = end


class _Shard:
    """Counts of documents until they are put out as a row."""

    def __init__(self) -> None:
        self.vocabulary: dict = defaultdict(count().__next__)
        self.ids, self.lengths, self.parts, self.words = [], [], [], 0

    def add(self, doc_id: int | None, data: bytes) -> None:
        place, n = len(self.ids), 0
        for terms in terms_of(data):
            if terms:
                n += len(terms)
                got = np.fromiter(map(self.vocabulary.__getitem__, terms), np.int32, len(terms))
                term, times = np.unique(got, return_counts=True)
                self.parts.append((term.astype(np.int32), times.astype(np.int32), place))
        if n:
            self.ids.append(doc_id)
            self.lengths.append(n)
            self.words += n

    def row(self, shard: int) -> pa.RecordBatch:
        # Places follow the ids, null ones last, so that ties fall to the smaller place.
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        terms = sorted(self.vocabulary)
        rank = np.empty(len(terms), np.int64)
        rank[[self.vocabulary[t] for t in terms]] = np.arange(len(terms))
        key = np.concatenate([rank[t] * len(order) + place[p] for t, _, p in self.parts])
        times = np.concatenate([c for _, c, _ in self.parts])
        at = key.argsort(kind="stable")
        key, times = key[at], times[at]
        first = np.flatnonzero(np.diff(key, prepend=-1))  # a long text's blocks are summed
        key, times = key[first], np.add.reduceat(times, first)
        term, doc = np.divmod(key, len(order))
        cells = [pa.array([shard]), pa.array([len(order)]), pa.array([self.words])]
        lists = [
            pa.array([self.ids[i] for i in order], pa.int64()), pa.array([self.lengths[i] for i in order], pa.int64()), pa.array(terms, pa.binary()),
            pa.array(np.bincount(term, minlength=len(terms)).astype(np.int32)), pa.array(doc.astype(np.int32)), pa.array(times.astype(np.int32)),
        ]
        return _row(cells, lists, _SHARD)


def _row(cells: list, lists: list[pa.Array], schema: str) -> pa.RecordBatch:
    """One row: cells, then lists."""
    whole = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
    return pa.RecordBatch.from_arrays(cells + whole, [c.split()[0] for c in schema.split(", ")])


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of _SHARD, one a shard: documents with at least one term, and their counts."""

    def run(batches):
        task, n, now = TaskContext.get().partitionId(), 0, _Shard()
        for b in batches:
            for i, data in zip(b.column(0).to_pylist(), b.column(1)):
                now.add(i, data.as_py() or b"")
                if now.words >= SHARD_WORDS or len(now.ids) >= SHARD_DOCS:
                    yield now.row((task << 32) + n)
                    n, now = n + 1, _Shard()
        if now.ids:
            yield now.row((task << 32) + n)

    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string").cast("binary")).mapInArrow(run, _SHARD)


def _weight(df, n_docs: int):
    """floor(1000 ln((2 N + 2) / (2 df + 1)))."""
    return F.floor(F.lit(1000.0) * F.ln(F.lit(float(2 * n_docs + 2)) / (2 * df + 1)))


def shared_weights(counted: DataFrame, n_docs: int) -> DataFrame:
    """(shard, shared), an array of (place, w) a shard: the weights of those of its terms that other
    shards have too. Most terms are rare and stand in one shard, which knows their frequency."""
    each = counted.select("shard", F.posexplode(F.arrays_zip("terms", "dfs")).alias("place", "x"))
    df = F.sum("x.dfs").over(W.partitionBy("x.terms"))
    each = each.select("shard", "place", F.col("x.dfs").alias("own"), df.alias("df")).where("df > own")
    return each.groupBy("shard").agg(F.collect_list(F.struct("place", _weight(F.col("df"), n_docs).alias("w"))).alias("shared"))


def _impacts(counted: DataFrame, n_docs: int, n_words: int) -> DataFrame:
    rows = counted.join(shared_weights(counted, n_docs).hint("shuffle_hash"), "shard", "left")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                shard, ids, lengths, terms, dfs, docs, tfs, w, places, shared = (b.column(c)[i] for c in range(10))
                m = np.array([50 + 50 * n * n_docs // n_words for n in lengths.values.to_pylist()], np.int64)
                docs, tf, df, w = docs.values.to_numpy(), tfs.values.to_numpy().astype(np.int64), dfs.values.to_numpy(), w.values.to_numpy().copy()
                if places.is_valid:
                    w[places.values.to_numpy()] = shared.values.to_numpy()
                impact = np.repeat(w, df) * (1_000_000_000 * tf // (1000 * tf + 20 * m[docs]))
                yield _row([pa.array([shard.as_py()])], [ids.values, terms.values, dfs.values, pa.array(docs), pa.array(impact)], _INDEX)

    own = F.transform("dfs", lambda df: _weight(df, n_docs)).alias("w")
    return rows.select("shard", "doc_ids", "lengths", "terms", "dfs", "docs", "tfs", own, F.col("shared.place"), F.col("shared.w").alias("shared")).mapInArrow(run, _INDEX)


def best(places: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, highest first; of equals those of the smaller places."""
    if len(scores) > k:
        least = scores[np.argpartition(scores, -k)[-k]]
        above, ties = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        room = k - len(above)
        if len(ties) > room:
            ties = ties[np.argpartition(places[ties], room - 1)[:room]] if room else ties[:0]
        taken = np.concatenate([above, ties])
    else:
        taken = np.arange(len(scores))
    return taken[np.lexsort((places[taken], -scores[taken]))]


class Index:
    """An index of documents, kept as Parquet in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> Index:
        """Indexes every row of docs. path: where the index stays; without one it goes when the driver ends.

        A null text has no term, and documents without one are not found and not counted. Rows that
        repeat an id are documents of their own; ids may be null. Other columns are not read.
        """
        spark = docs.sparkSession
        counted = stored(shards(docs, id_col, text_col), **_WRITE)
        n_docs, n_words = counted.agg(F.sum("n_docs"), F.sum("n_words")).first()
        out = cls(spark, path or fleeting(spark))
        made = _impacts(counted, n_docs, n_words) if n_docs else spark.createDataFrame([], _INDEX)
        made.write.options(**_WRITE).parquet(out.path)
        discard(counted)
        return out

    def read(self) -> DataFrame:
        return self.spark.read.schema(_INDEX).parquet(self.path)

    def search(self, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
        """(item_id long, rank int, doc_id long, score long): the k documents of each item with the highest
        scores above 0 (all, if fewer), highest first; equal scores by doc_id, null ids last.

        An item is all rows of its id, null being one; its terms count once. Items without a term get no
        rows. Scores are sums of 64-bit integers, so the result does not depend on shards or partitions.
        """
        out = None
        for block in _item_blocks(items, id_col, text_col):
            part = self._search(block, k)
            out = part if out is None else out.union(part)
        if out is None:
            return self.spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        for keys in (["item_id", "part"], ["item_id"]):  # merged in two steps: a part is some tasks' best
            out = out.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
        return out.select("item_id", "rank", "doc_id", "score")

    def _search(self, items: list[tuple[int | None, list[bytes]]], k: int) -> DataFrame:
        """(item_id, part, doc_id, score): each task's best of the shards it reads."""
        asked = sorted({t for _, terms in items for t in terms})
        at = {t: i for i, t in enumerate(asked)}
        shared = self.spark.sparkContext.broadcast(([i for i, _ in items], [[at[t] for t in terms] for _, terms in items], asked))  # at most about ITEM_CHARS letters

        def run(batches):
            ids, wanted, names = shared.value
            names = pa.array(names, pa.binary())
            kept: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
            for b in batches:
                for i in range(b.num_rows):
                    doc_ids, terms, df, docs, impacts = (b.column(c)[i].values for c in range(5))
                    where = pc.index_in(names, value_set=terms).fill_null(-1).to_numpy()
                    end = np.cumsum(df.to_numpy(), dtype=np.int64)
                    begin, docs, impacts = end - df.to_numpy(), docs.to_numpy(), impacts.to_numpy()
                    null = doc_ids.is_null().to_numpy(zero_copy_only=False)
                    number = doc_ids.fill_null(0).to_numpy()
                    total = np.zeros(len(number), np.int64)
                    for j, own in enumerate(wanted):
                        met = [t for t in where[own].tolist() if t >= 0]
                        if not met:
                            continue
                        total[:] = 0
                        for t in met:  # a term's documents differ, so each gets its impact once
                            total[docs[begin[t] : end[t]]] += impacts[begin[t] : end[t]]
                        found = np.flatnonzero(total > 0)
                        found = found[best(found, total[found], k)]
                        here = (null[found], number[found], total[found])
                        if j in kept:
                            here = tuple(np.concatenate(x) for x in zip(kept[j], here))
                        if len(here[2]) > k:
                            place = np.empty(len(here[2]), np.int64)
                            place[np.lexsort((here[1], here[0]))] = np.arange(len(place))
                            top = best(place, here[2], k)
                            here = tuple(x[top] for x in here)
                        kept[j] = here
            part = TaskContext.get().partitionId() % 64
            for j, (null, number, score) in kept.items():
                n = len(score)
                yield pa.RecordBatch.from_arrays([pa.array([ids[j]] * n, pa.int64()), pa.array([part] * n, pa.int32()), pa.array(number, mask=null), pa.array(score)], ["item_id", "part", "doc_id", "score"])

        return self.read().select("doc_ids", "terms", "dfs", "docs", "impacts").mapInArrow(run, "item_id long, part int, doc_id long, score long")


def _item_blocks(items: DataFrame, id_col: str, text_col: str):
    """The items' (id, distinct terms), in lists of a bounded size that keep an id's rows together."""
    own = items.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("t")).where("t is not null")
    chars = own.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = -(-int(chars) // ITEM_CHARS)
    for part in range(n):
        terms: dict = defaultdict(set)
        for r in (own if n == 1 else own.where(F.pmod(F.xxhash64("i"), F.lit(n)) == part)).collect():
            for found in terms_of(bytes(r["t"])):
                terms[r["i"]].update(found)
        block = [(i, sorted(t)) for i, t in terms.items() if t]
        if block:
            yield block


def ranked(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """search() of items (item_id, text) in an index of docs (doc_id, text) that is built for it."""
    return Index.build(docs).search(items, k)
