"""Approximate nearest neighbours over balanced posting lists.

Fitting: hierarchical balanced k-means over a bounded sample gives the lists' centroids: a cluster
is split again until it holds no more sample rows than its share. Centroids are searched through an
in-memory neighbour graph by a beam that walks for a whole batch at once.

Indexing: every vector goes to its nearest list and, where it lies near a boundary, to further
lists whose centroid is at most `closure` times as far, unless an already chosen centroid is nearer
to that centroid than `spread` times the vector is (it would bring little new; in many dimensions
centroids lie nearer to each other than vectors to them, so that a spread of 1 would leave no copies).

Searching: a query reads the lists whose centroid is at most `ratio` times as far as the nearest
one, at least `least_lists` or an eighth of the lists if that is less, and always enough lists to hold
`k` other vectors. Lists are packed into shards of bounded size; a list above that size is dealt over
several. A query goes to a shard once, with the numbers of the lists that it reads there, and a shard
with many queries is read by several tasks. Only each shard's best k a query are shuffled again.

An index is built once and searched as often as need be; save() and load() keep it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import least_hashed, stored

#: Bounds of what is fitted on the driver: sample rows, and centroids. Both are the operator's parameters.
SAMPLE_ROWS = 32768
MAX_LISTS = 8192


def _sq(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's rounds with a size penalty, so that no cluster grows far beyond its share."""
    c = x[rng.choice(len(x), k, replace=False)]
    size = np.zeros(k)
    for _ in range(rounds):
        d = _sq(x, c)
        own = (d + d.mean() * 0.1 * (size / (len(x) / k))).argmin(1)
        size = np.bincount(own, minlength=k).astype(float)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
    return c, _sq(x, c).argmin(1)


def balanced_centroids(x: np.ndarray, n_lists: int, seed: int = 0) -> np.ndarray:
    """Centroids of clusters of x, each split until it holds at most twice its share of rows.

    Equal rows cannot be told apart and stay one cluster however many they are.
    """
    rng, limit = np.random.default_rng(seed), max(1, 2 * len(x) // max(1, n_lists))
    todo, out = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        own = x[rows]
        if len(rows) <= limit or (own == own[0]).all():
            out.append(own.mean(0))
            continue
        k = int(min(16, max(2, len(rows) * 1.5 // limit)))
        _, label = _kmeans(own, min(k, len(rows)), rng)
        parts = [rows[label == i] for i in np.unique(label)]
        if len(parts) == 1:  # one point drew everything: part it from the rest
            far = _sq(own, own[:1])[:, 0] > 0
            parts = [rows[far], rows[~far]]
        todo += parts
    return np.array(out)


@dataclass
class Centroids:
    """Centroids and the graph that searches them."""

    points: np.ndarray
    near: np.ndarray  # neighbours of each, and a few far ones that keep the graph connected

    @classmethod
    def build(cls, points: np.ndarray, degree: int = 24, far: int = 8, seed: int = 0) -> Centroids:
        n = len(points)
        degree = min(degree, n - 1)
        if degree <= 0:
            return cls(points, np.zeros((n, 1), np.int64))
        near = np.empty((n, degree), np.int64)
        for at in range(0, n, 1024):
            d = _sq(points[at : at + 1024], points)
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            near[at : at + 1024] = np.argpartition(d, degree - 1, axis=1)[:, :degree]
        links = np.random.default_rng(seed).integers(0, n, (n, min(far, n)))
        return cls(points, np.hstack([near, links, (np.arange(n)[:, None] + 1) % n]))

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of q up to `beam` of its nearest centroids, nearest first, with distances.

        A best-first walk for all rows at once: each step opens every row's nearest unopened
        centroid, until a row's beam has none.
        """
        m, n = len(q), len(self.points)
        beam = min(beam, n)
        start = np.unique(np.linspace(0, n - 1, min(n, max(beam // 2, 8))).astype(np.int64))
        d0 = _sq(q, self.points[start])
        pick = np.argsort(d0, axis=1, kind="stable")[:, :beam]
        ids, ds = start[pick], np.take_along_axis(d0, pick, 1)
        if ids.shape[1] < beam:
            pad = beam - ids.shape[1]
            ids = np.hstack([ids, np.zeros((m, pad), np.int64)])
            ds = np.hstack([ds, np.full((m, pad), np.inf)])
        opened = np.zeros((m, beam), bool) | ~np.isfinite(ds)
        seen = np.zeros((m, n), bool)
        seen[:, start] = True
        q2, p2, rows = (q * q).sum(1), (self.points * self.points).sum(1), np.arange(m)
        while True:
            live = rows[~opened.all(1)]
            if not len(live):
                break
            at = np.argmin(np.where(opened[live], np.inf, ds[live]), axis=1)
            opened[live, at] = True
            nb = np.sort(self.near[ids[live, at]], axis=1)
            fresh = ~seen[live[:, None], nb]
            fresh[:, 1:] &= nb[:, 1:] != nb[:, :-1]
            seen[live[:, None], nb] = True
            d = q2[live, None] + p2[nb] - 2 * np.einsum("mkd,md->mk", self.points[nb], q[live])
            d = np.where(fresh, np.maximum(d, 0), np.inf)
            all_d = np.hstack([ds[live], d])
            keep = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            ids[live] = np.take_along_axis(np.hstack([ids[live], nb]), keep, 1)
            ds[live] = np.take_along_axis(all_d, keep, 1)
            opened[live] = np.take_along_axis(np.hstack([opened[live], ~np.isfinite(d)]), keep, 1)
        return ids, np.sqrt(ds)


def closure_lists(x: np.ndarray, c: Centroids, closure: float, replicas: int, spread: float) -> list[list[int]]:
    """The lists of each row of x, its nearest first."""
    ids, ds = c.search(x, max(16, 2 * replicas))
    out = []
    near = ds <= closure * ds[:, :1] + 1e-12
    gap = {}
    for row in range(len(x)):
        own = [int(ids[row, 0])]
        for i, d, ok in zip(ids[row, 1:].tolist(), ds[row, 1:].tolist(), near[row, 1:].tolist()):
            if not ok or len(own) >= replicas:
                break
            for o in own:
                key = (o, i)
                if key not in gap:
                    gap[key] = float(np.linalg.norm(c.points[o] - c.points[i]))
                if gap[key] < spread * d:
                    break
            else:
                own.append(i)
        out.append(own)
    return out


def clean_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id long, v array<double>) of the rows that take part.

    Left out: null ids; vectors null, of another length than the table's commonest, all zero, or
    with a null or non-finite component. Of rows with the same id and vector one stays.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    dim = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (dim["n"] if dim else 0)).dropDuplicates(["vec_id", "v"])


def _matrix(col: pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


#: Queries of one shard that one task answers.
SHARD_QUERIES = 8192


@dataclass
class Index:
    """Centroids with their graph, and the posts (list int, vec_id long, v array<double>, home boolean) of
    every row; the table of lists is on the driver: there are as many as centroids."""

    centroids: Centroids
    posts: DataFrame | None
    rows_of: np.ndarray  # of each list
    homes_of: np.ndarray  # of these the distinct ids whose nearest list it is
    replicas: int

    @classmethod
    def build(cls, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", list_rows: int = 256, closure: float = 1.1, replicas: int = 4, spread: float = 0.55, sample_rows: int = SAMPLE_ROWS, max_lists: int = MAX_LISTS, path: str | None = None) -> Index:
        """The index of every row of vectors that clean_vectors() leaves, its posts at path, or in the
        shared folder until the session ends. There are as many lists as lists of `list_rows` rows,
        or the root of the number of rows where that is more. The centroids are fitted on the
        `sample_rows` rows whose ids have the least hash."""
        spark = vectors.sparkSession
        rows = stored(clean_vectors(vectors, id_col, vec_col))
        n = rows.count()
        if not n:
            return cls(Centroids.build(np.zeros((1, 1))), None, np.zeros(1, np.int64), np.zeros(1, np.int64), replicas)
        sample = least_hashed(rows, "vec_id", sample_rows, n).toArrow()
        x = _matrix(sample.column("v")) if sample.num_rows else _matrix(rows.limit(1).toArrow().column("v"))
        n_lists = max(1, min(max_lists, max(n // list_rows, math.isqrt(n)), len(x) // 4 or 1))
        cents = Centroids.build(balanced_centroids(x, n_lists))
        shared = spark.sparkContext.broadcast(cents)  # at most 2 * max_lists points

        def assign(batches):
            for b in batches:
                lists = closure_lists(_matrix(b.column(1)), shared.value, closure, replicas, spread)
                counts = [len(o) for o in lists]
                take = np.repeat(np.arange(len(lists)), counts)
                first = np.zeros(len(take), bool)
                first[np.cumsum([0, *counts[:-1]])] = True
                flat = np.array([i for o in lists for i in o], np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take)), b.column(1).take(pa.array(take)), pa.array(flat), pa.array(first)], ["vec_id", "v", "list", "home"])

        posts = rows.mapInArrow(assign, "vec_id long, v array<double>, list int, home boolean")
        if path is None:
            posts = stored(posts)
        else:
            posts.write.parquet(f"{path}/posts")
            posts = spark.read.schema(posts.schema).parquet(f"{path}/posts")
        return cls._of(cents, posts, replicas)

    @classmethod
    def _of(cls, cents: Centroids, posts: DataFrame, replicas: int) -> Index:
        rows_of, homes_of = np.zeros(len(cents.points), np.int64), np.zeros(len(cents.points), np.int64)
        for r in posts.groupBy("list").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("home"), F.col("vec_id"))).alias("home")).collect():  # one a list
            rows_of[r["list"]], homes_of[r["list"]] = r["n"], r["home"]
        return cls(cents, posts, rows_of, homes_of, replicas)

    def save(self, path: str) -> None:
        """Writes what build() did not write to path: the centroids and their graph."""
        spark = self.posts.sparkSession
        rows = pa.table({"i": pa.array(range(len(self.centroids.points)), pa.int32()), "point": pa.array(self.centroids.points.tolist(), pa.list_(pa.float64())), "near": pa.array(self.centroids.near.tolist(), pa.list_(pa.int64())), "replicas": pa.array([self.replicas] * len(self.centroids.points), pa.int32())})
        spark.createDataFrame(rows).write.parquet(f"{path}/centroids")

    @classmethod
    def load(cls, spark, path: str) -> Index:
        """The index that build(path=...) and save() left at path."""
        rows = spark.read.parquet(f"{path}/centroids").toArrow().sort_by("i")
        cents = Centroids(_matrix(rows.column("point")), _matrix(rows.column("near")))
        return cls._of(cents, spark.read.parquet(f"{path}/posts"), rows.column("replicas")[0].as_py())

    def lists_of(self, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", ratio: float = 1.18, least_lists: int = 8) -> DataFrame:
        """(query_id long, q array<double>, lists array<int>): the lists that each query reads."""
        cents = self.centroids
        shared = queries.sparkSession.sparkContext.broadcast((cents, self.homes_of))  # bounded by max_lists
        least = max(1, min(least_lists, len(cents.points) // 8))

        def route(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                cents, homes = shared.value
                q, beam = _matrix(b.column(1)), 64
                while True:  # widen the beam until the ratio, not the beam, ends every row's lists
                    ids, ds = cents.search(q, beam)
                    whole = ids.shape[1] >= len(cents.points)
                    few = np.cumsum(homes[ids], axis=1) - homes[ids] <= k
                    take = (ds <= ratio * ds[:, :1]) | few
                    take[:, :least] = True  # a query next to a centroid has no ratio to go by
                    if whole or not take[:, -1].any():
                        break
                    beam *= 2
                lists = [row[t].astype(np.int32) for row, t in zip(ids, take)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists, pa.list_(pa.int32()))], ["query_id", "q", "lists"])

        asked = clean_vectors(queries, id_col, vec_col).where(F.size("v") == cents.points.shape[1])
        return asked.mapInArrow(route, "query_id long, q array<double>, lists array<int>")

    def _shards(self, shard_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(first shard, shards) of each list: small lists share one, a large list has several."""
        first, pieces, at, room = np.zeros(len(self.rows_of), np.int64), np.ones(len(self.rows_of), np.int64), 0, 0
        for i, size in enumerate(self.rows_of.tolist()):
            if size > shard_rows:
                at += room > 0
                first[i], pieces[i], room = at, -(-size // shard_rows), 0
                at += int(pieces[i])
            else:
                if room + size > shard_rows:
                    at, room = at + 1, 0
                first[i], room = at, room + size
        return first, pieces

    def search(self, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", ratio: float = 1.18, least_lists: int = 8, shard_rows: int = 8192) -> DataFrame:
        """(query_id long, rank int from 1, vec_id long, score double); see nearest()."""
        spark = queries.sparkSession
        if self.posts is None:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        first, pieces = self._shards(shard_rows)
        places = spark.sparkContext.broadcast((first, pieces))  # as many as centroids

        def to_shards(batches):
            for b in batches:
                first, pieces = places.value
                rows, shards, own = [], [], []
                for r, lists in enumerate(b.column(2).to_pylist()):
                    by: dict[int, list[int]] = {}
                    for i in lists:
                        for s in range(int(first[i]), int(first[i] + pieces[i])):
                            by.setdefault(s, []).append(i)
                    rows += [r] * len(by)
                    shards += by
                    own += by.values()
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(own, pa.list_(pa.int32())), pa.array(shards, pa.int64())], ["query_id", "q", "lists", "shard"])

        def found_by(routed: DataFrame) -> DataFrame:
            asked = stored(routed.mapInArrow(to_shards, "query_id long, q array<double>, lists array<int>, shard long"))
            return self._scan(asked, first, pieces, k)

        asked = stored(self.lists_of(queries, k, id_col, vec_col, ratio, least_lists))
        found = stored(found_by(asked))
        # Where ids repeat over lists, lists of k others may hold fewer: such queries read all lists.
        counts = found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n"))
        few = asked.groupBy("query_id").agg(F.max(F.size("lists")).alias("read")).where(F.col("read") < len(first))
        few = stored(few.join(counts, F.col("query_id") == F.col("id"), "left").where(F.coalesce("n", F.lit(0)) < k).select("query_id"))
        if not few.isEmpty():
            again = asked.join(few, "query_id", "left_semi").select("query_id", "q", F.sequence(F.lit(0), F.lit(len(first) - 1)).alias("lists"))
            found = found.join(few, "query_id", "left_anti").union(found_by(again))
        rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")

    def _scan(self, asked: DataFrame, first: np.ndarray, pieces: np.ndarray, k: int) -> DataFrame:
        """(query_id, vec_id, score) of at least the k nearest in the lists that asked (query_id, q, lists,
        shard; stored) names."""
        spark = asked.sparkSession
        load = asked.groupBy(F.col("shard").alias("of")).agg(F.ceil(F.count("*") / SHARD_QUERIES).alias("parts"))
        load = F.broadcast(stored(load))  # bounded by the number of shards
        where = spark.createDataFrame(pa.table({"at": pa.array(range(len(first)), pa.int32()), "shard0": pa.array(first), "pieces": pa.array(pieces)}))
        posts = self.posts.join(F.broadcast(where), F.col("list") == F.col("at"))
        posts = posts.select("list", "vec_id", "v", (F.col("shard0") + F.pmod(F.xxhash64("vec_id", "v"), F.col("pieces"))).alias("shard"))
        posts = posts.join(load, F.col("shard") == F.col("of")).select("list", "vec_id", "v", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        asked = asked.join(load, F.col("shard") == F.col("of")).select("query_id", "q", "lists", "shard", F.pmod(F.xxhash64("query_id"), F.col("parts")).alias("part"))
        replicas = self.replicas

        def scan(left: pa.Table, right: pa.Table) -> pa.Table:
            out_q, out_v, out_s = [], [], []
            if left.num_rows and right.num_rows:
                vec, ids, own = _matrix(left.column("v")), left.column("vec_id").to_numpy(), left.column("list").to_numpy()
                order = np.argsort(own, kind="stable")
                vec, ids, own = vec[order], ids[order], own[order]
                sq = (vec * vec).sum(1)
                qs, qids, qlists = _matrix(right.column("q")), right.column("query_id").to_numpy(), right.column("lists").to_pylist()
                by = np.argsort(qids, kind="stable")
                cuts = np.append(np.flatnonzero(np.append(True, qids[by][1:] != qids[by][:-1])), len(by))
                for s, e in zip(cuts[:-1], cuts[1:]):
                    near_ids, near_d = [], []
                    for at in by[s:e].tolist():
                        q, mine = qs[at], np.array(sorted(qlists[at]))
                        lo, hi = np.searchsorted(own, mine), np.searchsorted(own, mine, "right")
                        cand = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi)])
                        cand = cand[ids[cand] != qids[at]]
                        if not len(cand):
                            continue
                        rough = sq[cand] - 2 * (vec[cand] @ q) + q @ q
                        most = k * replicas
                        while most < len(cand):  # an id stands once for each of its vectors and their lists
                            last = np.partition(rough, most - 1)[most - 1]
                            if len(np.unique(ids[cand[rough <= last]])) >= k:
                                cand = cand[rough <= last + 1e-9 * (q @ q + abs(last) + 1)]
                                break
                            most *= 4
                        near_ids.append(ids[cand])
                        near_d.append(np.sqrt(((vec[cand] - q) ** 2).sum(1)))
                    if near_ids:
                        i, d = np.concatenate(near_ids), np.concatenate(near_d)
                        o = np.lexsort((i, d))
                        i, d = i[o], d[o]
                        _, first_at = np.unique(i, return_index=True)
                        keep = np.sort(first_at)[:k]
                        out_q += [int(qids[by[s]])] * len(keep)
                        out_v += i[keep].tolist()
                        out_s += d[keep].tolist()
            return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

        found = posts.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInArrow(scan, "query_id long, vec_id long, score double")
        return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    list_rows: int = 256,
    ratio: float = 1.18,
    closure: float = 1.1,
    replicas: int = 4,
    spread: float = 0.55,
    least_lists: int = 8,
    shard_rows: int = 8192,
    sample_rows: int = SAMPLE_ROWS,
    max_lists: int = MAX_LISTS,
) -> DataFrame:
    """(query_id long, rank int from 1, vec_id long, score double): each query's k nearest found, by an
    index that is built for it.

    score is the Euclidean distance of the vectors as given, in double precision; ties go to the
    smaller vec_id. A query is never its own neighbour. Fewer than k candidates give fewer rows; an
    empty table, or no queries, give none. A repeated vec_id counts once as a candidate, by its nearest
    row, and as a query by all its rows together. See clean_vectors() for the rows that take no part.
    Other columns are not read.
    """
    index = Index.build(vectors, id_col, vec_col, list_rows, closure, replicas, spread, sample_rows, max_lists)
    return index.search(queries, k, id_col, vec_col, ratio, least_lists, shard_rows)
