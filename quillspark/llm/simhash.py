"""Near-duplicates by SimHash, linked through BK-trees.

A document's fingerprint has a bit set where over half of its shingles' 64-bit hashes have it.
Documents whose fingerprints differ in at most `radius` bits are linked, and links join into
components.

Search: of m equal slices of their bits, two fingerprints within the radius agree in m - radius at
least, so every distinct fingerprint goes to one bucket for each choice of so many slices: four
buckets of 16 bits up to some ten million fingerprints, and beyond that more slices, whose buckets
are told apart by more bits, so that buckets stay small however many fingerprints there are. Buckets
are packed into shards; in each, a bucket's members stand in a BK-tree (children keyed by their
integer Hamming distance to the parent) and a search follows only the edges within the radius of its
own distance. Trees are not broadcast: the one of a shard is built and searched in the task that the
shard's members are shuffled to, so that none need fit into every executor. A bucket above `piece` members is cut into pieces by hash, and each pair of pieces is
a task of its own, so no task holds an unbounded group and no pair is lost. Inside a bucket links are
joined at once: at most one link a member leaves it, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, components, keyed, short_batches, stored, with_groups

_CHUNK = 1 << 16
#: Rows, of 20 bytes each, in a table of large buckets that is broadcast.
_MOST_BROADCAST = 200_000


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a whole text; 0 where there is no word.

    A-Z become lower case, words are runs of anything but ASCII white space, and a text of fewer
    words than a shingle needs is one shingle.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(parts)
    if not n:
        return 0
    h = xxhash.xxh64_intdigest
    joined = b" ".join(parts)
    if n <= words:
        return h(joined, seed)
    length = np.fromiter(map(len, parts), np.int64, n)
    ends = np.cumsum(length + 1) - 1
    starts, ends = (ends - length)[: n - words + 1], ends[words - 1 :]
    total = n - words + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, total, _CHUNK):
        s, e = starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist()
        hashes = np.array([h(joined[a:b], seed) for a, b in zip(s, e)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        if len(hashes) < 512:
            counts += np.unpackbits(hashes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        else:
            for j in range(8):
                counts[8 * j : 8 * j + 8] += np.bincount(hashes[:, j], minlength=256) @ _BITS
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id long, fp long) of every row; fp holds the fingerprint's 64 bits as a signed number."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """A BK-tree over integers under the Hamming distance."""

    def __init__(self) -> None:
        self.keys: list[int] = []
        self.edges: list[dict[int, int]] = []

    def add(self, key: int) -> None:
        at = len(self.keys)
        self.keys.append(key)
        self.edges.append({})
        if not at:
            return
        node = 0
        while True:
            d = (self.keys[node] ^ key).bit_count()
            child = self.edges[node].get(d)
            if child is None:
                self.edges[node][d] = at
                return
            node = child

    def search(self, key: int, radius: int) -> list[int]:
        """Positions, in the order of adding, of the members within the radius."""
        if not self.keys:
            return []
        keys, edges, found, stack = self.keys, self.edges, [], [0]
        while stack:
            node = stack.pop()
            d = (keys[node] ^ key).bit_count()
            if d <= radius:
                found.append(node)
            for e, child in edges[node].items():
                if -radius <= e - d <= radius:
                    stack.append(child)
        return found


    def nearest(self, key: int, radius: int) -> tuple[int, int] | None:
        """(position, distance) of the nearest member within the radius, the first added of equals."""
        if not self.keys:
            return None
        keys, edges, best, stack = self.keys, self.edges, None, [0]
        while stack:
            node = stack.pop()
            d = (keys[node] ^ key).bit_count()
            if d <= radius and (best is None or (d, node) < (best[1], best[0])):
                best, radius = (node, d), d
            for e, child in edges[node].items():
                if -radius <= e - d <= radius:
                    stack.append(child)
        return best


def _join(parent: list[int], a: int, b: int) -> None:
    while parent[a] != a:
        parent[a] = a = parent[parent[a]]
    while parent[b] != b:
        parent[b] = b = parent[parent[b]]
    if a != b:
        parent[max(a, b)] = min(a, b)


#: Members from which a bucket's tree is built and searched level by level for all at once.
_BULK = 160


def _bucket_links(fps: list[int], side: list[bool], cross: bool, radius: int) -> list[tuple[int, int]]:
    """A forest of links inside one bucket, or between its two pieces."""
    parent = list(range(len(fps)))
    tree, members = BKTree(), []
    if len(fps) >= _BULK:
        for i, near in _near_pairs(np.array(fps, np.uint64), np.array(side) if cross else None, radius):
            for j in near.tolist():
                _join(parent, i, j)
    elif cross:
        for i, f in enumerate(fps):
            if side[i]:
                tree.add(f)
                members.append(i)
        for i, f in enumerate(fps):
            if not side[i]:
                for j in tree.search(f, radius):
                    _join(parent, i, members[j])
    else:
        for i, f in enumerate(fps):
            for j in tree.search(f, radius):
                _join(parent, i, j)
            tree.add(f)
    out = []
    for i in range(len(fps)):
        r = i
        while parent[r] != r:
            r = parent[r]
        if r != i:
            out.append((i, r))
    return out


def slice_choices(n: int, radius: int, bucket: float = 256, bits: int = 64) -> list[list[tuple[int, int]]]:
    """Choices of slices, each a list of (first bit, width), such that n random fingerprints fill a
    bucket with about `bucket` members at most."""
    m = radius + 1
    while m < bits // 2 and n > bucket * 2 ** (bits // m * (m - radius)):
        m += 1
    cuts = [bits * i // m for i in range(m + 1)]
    slices = [(a, b - a) for a, b in zip(cuts, cuts[1:])]
    return [list(c) for c in combinations(slices, m - radius)]


def links(reps: DataFrame, radius: int = 3, piece: int = 2048, shard_rows: int = 16384, bucket: float = 256) -> DataFrame:
    """Links (u, v) between the nodes of reps (fp long, rep long), whose fp are distinct.

    They connect exactly what lies within the radius: a forest a bucket, not all pairs.
    """

    def value(choice: list[tuple[int, int]]):
        out, at = F.lit(0).cast("long"), 0
        for first, width in choice:
            part = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            out, at = out.bitwiseOR(F.shiftleft(part, at)), at + width
        return out

    choices = slice_choices(reps.count(), radius, bucket)
    keyed = reps.select("fp", "rep", F.explode(F.array(*[F.struct(F.lit(i).alias("slice"), value(c).alias("value")) for i, c in enumerate(choices)])).alias("k")).select("fp", "rep", "k.slice", "k.value")
    sizes = keyed.groupBy("slice", "value").agg(F.count("*").alias("n"))
    pieces = F.ceil(F.col("n") / piece)
    sizes = stored(sizes.where("n > 1").select("slice", "value", "n", pieces.alias("pieces")))
    total = sizes.agg(F.sum(F.col("n") * F.col("pieces"))).first()[0] or 0
    n_shards = max(1, -(-int(total) // shard_rows))
    large = sizes.where("pieces > 1").select("slice", "value", "pieces")
    few = large.count() <= _MOST_BROADCAST  # else the engine joins by a shuffle
    rows = keyed.join(F.broadcast(large) if few else large, ["slice", "value"], "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("pieces")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    rows = rows.select("fp", "rep", "slice", "value", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("slice", "value", "a", "b"), F.lit(n_shards)))

    def run(t: pa.Table) -> pa.Table:
        c = {k: t.column(k).to_numpy() for k in ("slice", "value", "a", "b", "own", "fp", "rep")}
        order = np.lexsort((c["rep"], c["b"], c["a"], c["value"], c["slice"]))
        c = {k: v[order] for k, v in c.items()}
        new = np.zeros(len(order), bool)
        new[:1] = True
        for k in ("slice", "value", "a", "b"):
            new[1:] |= c[k][1:] != c[k][:-1]
        edges = np.append(np.flatnonzero(new), len(order))
        us, vs = [], []
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if e - s > 1:
                cross = c["a"][s] != c["b"][s]
                rep = c["rep"][s:e]
                side = (c["own"][s:e] == c["a"][s]).tolist()
                for i, j in _bucket_links(c["fp"][s:e].view(np.uint64).tolist(), side, bool(cross), radius):
                    us.append(int(rep[i]))
                    vs.append(int(rep[j]))
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return rows.groupBy("shard").applyInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id long, fingerprint string, component_id long) for every row of docs.

    component_id is the smallest id reachable over links, the document's own included. A null
    text counts as empty; texts without a word have fingerprint zero and link like any other.
    Repeated ids keep all their rows. A row whose id is null gets its fingerprint and a null
    component, and links nothing. Other columns are not read, so their names cannot clash.
    """
    with short_batches(docs.sparkSession):
        fps = stored(fingerprints(docs, id_col, text_col, words))
    reps = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("rep is not null"))
    # An id that repeats with two texts, and is the smallest for both, is one node for both.
    found = links(reps, radius)
    label = components(found)
    marked = reps.join(label, F.col("rep") == F.col("node"), "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id"))
    out = with_groups(fps, "fp", stored(marked), "left")
    return out.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


# --- texts that share most of their shingles

#: Bands of a text's MinHash values and values in a band. Of two texts that share 0.8 of their shingles
#: all bands differ with a probability of (1 - 0.8 ** 5) ** 16 = 0.002.
BANDS, BAND_ROWS = 16, 5
#: Bits in which the SimHashes of two such texts may differ. 9.7 are expected at 0.8, with a
#: standard deviation of 2.9.
WIDE_RADIUS = 20
_MULTIPLIERS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct 64-bit hashes of a whole text's word shingles, in order; words as in
    fingerprint(), and a text of fewer words than a shingle needs is one shingle."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n, h = len(parts), xxhash.xxh64_intdigest
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    length = np.fromiter(map(len, parts), np.int64, n)
    ends = np.cumsum(length + 1) - 1
    total = max(1, n - shingle + 1)
    starts, ends = (ends - length)[:total].tolist(), ends[n - total :].tolist()
    return np.unique(np.array([h(joined[a:b], 42) for a, b in zip(starts, ends)], np.uint64))


def set_fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a set of hashes; 0 for an empty set."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        raw = hashes[at : at + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def band_values(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit value for each band of the set's MinHash values; an empty set has values too."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(least, (hashes[at : at + 512, None] * _MULTIPLIERS).min(axis=0), out=least)
    raw, width = least.tobytes(), 8 * BAND_ROWS
    return np.array([xxhash.xxh64_intdigest(raw[width * b : width * (b + 1)], b) for b in range(BANDS)], np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The share of two sets of distinct values that both hold; 1 where both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


class BulkTree:
    """The BK-tree that adding distinct keys one by one would give, built level by level for all keys
    at once, and searched for many keys at once."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        live, node = np.arange(1, len(keys)), np.zeros(max(0, len(keys) - 1), np.int64)
        parents, edges, children = [], [], []
        while len(live):
            d = np.bitwise_count(keys[live] ^ keys[node]).astype(np.int64)
            slot, first, own = np.unique(node * 65 + d, return_index=True, return_inverse=True)
            child = live[first]  # of those that come to one edge the first stays there
            parents.append(node[first])
            edges.append(d[first])
            children.append(child)
            to = child[own]
            on = live != to
            live, node = live[on], to[on]
        none = [np.zeros(0, np.int64)]
        parent = np.concatenate(parents or none)
        order = np.argsort(parent, kind="stable")
        self.edge, self.child = np.concatenate(edges or none)[order], np.concatenate(children or none)[order]
        self.start = np.searchsorted(parent[order], np.arange(len(keys) + 1))

    def search(self, wanted: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in wanted, place in keys) of every pair within the radius, following only edges
        within the radius of a node's own distance."""
        asked, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if not len(self.keys):
            return asked[0], found[0]
        q, node = np.arange(len(wanted)), np.zeros(len(wanted), np.int64)
        while len(q):
            d = np.bitwise_count(self.keys[node] ^ wanted[q]).astype(np.int64)
            hit = d <= radius
            asked.append(q[hit])
            found.append(node[hit])
            n = self.start[node + 1] - self.start[node]
            at = np.repeat(self.start[node] - np.cumsum(n) + n, n) + np.arange(n.sum())
            q, d = np.repeat(q, n), np.repeat(d, n)
            on = np.abs(self.edge[at] - d) <= radius
            q, node = q[on], self.child[at[on]]
        return np.concatenate(asked), np.concatenate(found)


def _near_pairs(fps: np.ndarray, side: np.ndarray | None, radius: int):
    """Yields (i, the places near i) of one bucket's fingerprints, or of those between its two sides,
    found through the BK-tree of the distinct ones; of a pair within one side the later has the
    earlier."""
    n = len(fps)
    own, ask = (np.arange(n), np.arange(n)) if side is None else (np.flatnonzero(side), np.flatnonzero(~side))
    keys, which = np.unique(fps[own], return_inverse=True)
    tree, by = BulkTree(keys), np.argsort(which, kind="stable")
    first = np.searchsorted(which[by], np.arange(len(keys) + 1))
    step = max(1, 400_000 // max(1, len(keys)))
    for at in range(0, len(ask), step):
        part = ask[at : at + step]
        q, k = tree.search(fps[part], radius)
        order = np.argsort(q, kind="stable")
        q, k = q[order], k[order]
        cut = np.searchsorted(q, np.arange(len(part) + 1))
        for j, i in enumerate(part.tolist()):
            near = k[cut[j] : cut[j + 1]]
            if len(near):
                members = own[np.concatenate([by[first[x] : first[x + 1]] for x in near.tolist()])]
                yield i, members if side is not None else members[members < i]


def _pieces(rows: DataFrame, sizes: DataFrame, piece: int, shard_rows: int) -> DataFrame:
    """rows (bucket, node, ...) with a and b, the two pieces of their bucket that a task compares, own,
    the row's piece, and shard: buckets of sizes (bucket, n; stored) above `piece` rows are cut, and
    each pair of pieces, a piece with itself too, stands for itself."""
    sizes = sizes.select(F.col("bucket").alias("cut_bucket"), F.col("n"), F.ceil(F.col("n") / piece).alias("pieces"))
    total, large = sizes.agg(F.sum(F.col("n") * F.col("pieces")), F.count_if(F.col("pieces") > 1)).first()
    n_shards = max(1, -(-int(total or 0) // shard_rows))
    cut = sizes.where("pieces > 1")
    if large <= _MOST_BROADCAST:  # else the engine joins by a shuffle
        cut = F.broadcast(cut)
    rows = rows.join(cut, F.col("bucket") == F.col("cut_bucket"), "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("pieces")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    rows = rows.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")})
    return rows.drop("cut_bucket", "n", "pieces", "other").withColumn("shard", F.pmod(F.xxhash64("bucket", "a", "b"), F.lit(n_shards)))


def _groups_of(t: pa.Table, keys: tuple[str, ...], last: str) -> tuple[dict, list[tuple[int, int]], np.ndarray]:
    """The table's long columns in order of keys and last, where each group of equal keys of two rows
    or more lies in it, and the order."""
    c = {k: t.column(k).to_numpy() for k in t.column_names if pa.types.is_int64(t.schema.field(k).type)}
    order = np.lexsort([c[last], *[c[k] for k in reversed(keys)]])
    c = {k: v[order] for k, v in c.items()}
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[k][1:] != c[k][:-1] for k in keys])
    cuts = np.append(np.flatnonzero(new), len(order))
    return c, [(s, e) for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if e - s > 1], order


def _open_members(rows: DataFrame, radius: int) -> DataFrame:
    """(bucket, a, b, node) of rows (bucket, a, b, own, node, fp, label, shard) that are within the
    radius of a row of their bucket with another label."""

    def run(t: pa.Table) -> pa.Table:
        c, groups, _ = _groups_of(t, ("bucket", "a", "b"), "node")
        fp, keep = c["fp"].view(np.uint64), np.zeros(t.num_rows, bool)
        for s, e in groups:
            side = None if c["a"][s] == c["b"][s] else c["own"][s:e] == c["a"][s]
            label = c["label"][s:e]
            if (label == label[0]).all():
                continue
            for i, near in _near_pairs(fp[s:e], side, radius):
                other = near[label[near] != label[i]]
                if len(other):
                    keep[s + i] = keep[s + other] = True
        return pa.table({k: pa.array(c[k][keep]) for k in ("bucket", "a", "b", "node")})

    return rows.groupBy("shard").applyInArrow(run, "bucket long, a long, b long, node long")


def _exact_links(rows: DataFrame, similarity: float, radius: int) -> DataFrame:
    """Links (u, v) of rows (bucket, a, b, own, node, fp, label, hashes, shard): those found within the
    radius whose sets share the similarity, less those that earlier links of the bucket imply."""

    def run(t: pa.Table) -> pa.Table:
        c, groups, order = _groups_of(t, ("bucket", "a", "b"), "node")
        fp, sets, us, vs = c["fp"].view(np.uint64), t.column("hashes").combine_chunks(), [], []
        flat, at = sets.flatten().to_numpy(), np.append(0, np.cumsum(sets.value_lengths().to_numpy()))
        of = lambda i: flat[at[order[i]] : at[order[i] + 1]]
        for s, e in groups:
            label = c["label"][s:e].copy()
            side = None if c["a"][s] == c["b"][s] else c["own"][s:e] == c["a"][s]
            for i, near in _near_pairs(fp[s:e], side, radius):
                for j in near.tolist():
                    if label[j] == label[i]:
                        continue
                    x, y = of(s + i), of(s + j)
                    if min(len(x), len(y)) >= similarity * max(len(x), len(y)) and jaccard(x, y) >= similarity:
                        us.append(int(c["node"][s + i]))
                        vs.append(int(c["node"][s + j]))
                        label[label == label[j]] = label[i]
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return rows.groupBy("shard").applyInArrow(run, "u long, v long")


def _text_groups(docs: DataFrame, similarity: float, shingle: int, id_col: str, text_col: str) -> tuple[DataFrame, list[str], DataFrame]:
    """(docs with row keys, their names, rows (key_file, key_at, doc_id, part)): part is one for all
    rows whose texts are linked.

    Texts of one shingle set are one node. Nodes meet in buckets of equal bands. Each bucket's
    heaviest node, that with most company over all its buckets, is held against its other nodes:
    so copies edited each apart from one text are held against that one. What this leaves apart is
    searched in the buckets by BK-trees, and compared there. Links are decided on whole shingle sets
    alone, which move only where a fingerprint lies within WIDE_RADIUS.
    """
    docs, names = keyed(docs)
    own = docs.select(F.col(names[0]).alias("key_file"), F.col(names[1]).alias("key_at"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def read(batches):
        for b in batches:
            node, fp, bands = [], [], []
            for text in b.column(3).to_pylist():
                hashes = shingle_set(text, shingle)
                node.append(xxhash.xxh64_intdigest(hashes.tobytes()))
                fp.append(set_fingerprint(hashes))
                bands.append(band_values(hashes))
            flat = np.concatenate(bands) if bands else np.zeros(0, np.uint64)
            values = pa.ListArray.from_arrays(np.arange(len(bands) + 1, dtype=np.int32) * BANDS, flat.view(np.int64))
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, fp)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *longs, values], ["key_file", "key_at", "doc_id", "node", "fp", "bands"])

    with short_batches(docs.sparkSession):
        rows = stored(own.mapInArrow(read, "key_file long, key_at long, doc_id long, node long, fp long, bands array<long>"))
    place = F.min(F.struct("key_file", "key_at")).alias("k")
    nodes = stored(rows.groupBy("node").agg(place, F.count("*").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    spread = nodes.select("node", "fp", F.explode("bands").alias("bucket"))
    sizes = stored(spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    met = stored(with_groups(spread, "bucket", sizes.withColumn("members", F.col("n")), most=_MOST_GROUPS))
    weight = met.groupBy("node").agg(F.sum("members").alias("weight"))
    heavy = met.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node", "fp")).alias("h"), F.count("*").alias("n"))
    stars = with_groups(met.select("bucket", "node", "fp"), "bucket", stored(heavy), most=_MOST_GROUPS).where("node <> h.node")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("h.fp"))) <= WIDE_RADIUS
    stars = stored(stars.where(near).select(F.col("h.node").alias("u"), F.col("node").alias("v")).distinct())

    def hash_sets(wanted: DataFrame) -> DataFrame:
        """(node, hashes) of the wanted (node), each read again from one of its rows."""
        at = nodes.select("node", "k").join(wanted, "node", "left_semi")
        texts = by_key(docs, names, stored(at.select("k.key_file", "k.key_at")), "left_semi").select(F.col(f"rows.`{text_col}`").alias("text"))

        def run(batches):
            for b in batches:
                sets = [shingle_set(t, shingle) for t in b.column(0).to_pylist()]
                node = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["node", "hashes"])

        with short_batches(docs.sparkSession):
            return stored(texts.mapInArrow(run, "node long, hashes array<long>"))

    def verify(batches):
        for b in batches:
            (x, y), keep = (b.column(i) for i in (2, 3)), np.zeros(b.num_rows, bool)
            fx, fy = x.flatten().to_numpy(), y.flatten().to_numpy()
            ax, ay = (np.append(0, np.cumsum(c.value_lengths().to_numpy())) for c in (x, y))
            for i in range(b.num_rows):
                keep[i] = jaccard(fx[ax[i] : ax[i + 1]], fy[ay[i] : ay[i + 1]]) >= similarity
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(keep))

    sets = hash_sets(stars.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    # A heavy node's set goes to a few tasks for every _STAR of its links, so that none waits for all.
    stars_of = stars.groupBy("u").agg(F.ceil(F.count("*") / _STAR).alias("salts"))
    left = sets.join(stars_of, F.col("node") == F.col("u")).select("u", "hashes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    salted = stars.join(stars_of, "u").withColumn("salt", F.pmod(F.xxhash64("v"), F.col("salts")))
    pairs = salted.join(left, ["u", "salt"]).join(sets.select(F.col("node").alias("v"), F.col("hashes").alias("other")), "v").select("u", "v", "hashes", "other")
    sized = F.least(F.size("hashes"), F.size("other")) >= F.greatest(F.size("hashes"), F.size("other")) * (similarity - 1e-9)
    with short_batches(docs.sparkSession):
        found = stored(pairs.where(sized).mapInArrow(verify, "u long, v long"))
    label = components(found)

    # Buckets whose nodes the stars have not all joined.
    marked = met.join(label.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left").select("bucket", "node", "fp", F.coalesce("component", "node").alias("label"))
    marked = stored(marked)
    open_ = marked.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low <> high").select("bucket", "n")
    open_ = stored(open_)
    inside = with_groups(marked, "bucket", open_, most=_MOST_GROUPS)
    members = stored(_open_members(_pieces(inside, open_, 2048, 65536), WIDE_RADIUS))
    if not members.isEmpty():
        # Parts of buckets that hold the same nodes are compared once.
        same = members.groupBy("bucket", "a", "b").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("all"))
        same = same.groupBy("n", "low", "all").agg(F.min(F.struct("bucket", "a", "b")).alias("p")).select("p.*")
        members = members.join(same, ["bucket", "a", "b"]).select(F.xxhash64("bucket", "a", "b").alias("bucket"), "node")
        sets = hash_sets(members.select("node").distinct())
        facts = marked.select("node", "fp", "label").dropDuplicates(["node"])
        held = stored(members.join(facts, "node").join(sets, "node"))
        words = stored(held.groupBy("bucket").agg(F.sum(F.size("hashes") + 16).cast("long").alias("n")))
        more = _exact_links(_pieces(held, words, _PIECE_HASHES, _SHARD_HASHES), similarity, WIDE_RADIUS)
        label = components(found.union(more))
    parts = nodes.select("node", "n").join(label.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left").select("node", "n", F.coalesce("component", "node").alias("part"))
    out = with_groups(rows.select("key_file", "key_at", "doc_id", "node"), "node", stored(parts))
    return docs, names, stored(out.select("key_file", "key_at", "doc_id", "part"))


#: Links of one heavy node that one task compares; hashes, of 8 bytes, in one task's sets where buckets
#: are small, and in each of the pieces that a larger bucket is cut into.
_STAR = 1024
_SHARD_HASHES = 500_000
_PIECE_HASHES = 4_000_000
#: Buckets, of some 40 bytes each, that are broadcast.
_MOST_GROUPS = 1_000_000


def similar_documents(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, component_id long): groups of documents that share `similarity` of their distinct
    word shingles, for every row of docs.

    Every link is decided on the whole sets of both texts. Of pairs at 0.8 over 0.99 are found, nearer
    ones more surely: BANDS and WIDE_RADIUS say what is lost. component_id is the smallest id of the
    group. A null text counts as empty; texts without a word are alike. Repeated ids keep all their
    rows. A row whose id is null has no component, but its text joins others. Other columns are not
    read.
    """
    _, _, rows = _text_groups(docs, similarity, shingle, id_col, text_col)
    least = rows.groupBy("part").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    out = with_groups(rows, "part", stored(least), "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def without_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of similar_documents(): that of the smallest id, null last;
    of several such rows the first by place in its file. All columns stay."""
    columns = docs.columns
    docs, names, rows = _text_groups(docs, similarity, shingle, id_col, text_col)
    best = rows.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key_file", "key_at")).alias("b"), F.count("*").alias("n")).where("n > 1")
    gone = with_groups(rows, "part", stored(best)).where("key_file <> b.key_file or key_at <> b.key_at").select("key_file", "key_at")
    return by_key(docs, names, stored(gone), "left_anti").select(*[F.col(f"rows.`{c}`") for c in columns])
