"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations alone.

Each source's documents stand in a shuffled queue, repeated as often as the cap allows, up to the
source's target; the copy that the target falls into gives the words before it. A queued copy's
virtual finish time is the words of its source up to and with it, divided by the source's target, so
that all sources advance in step. All copies are range-partitioned by finish time, summed up in that
order, and truncated where the total budget ends, inside a copy if need be.

Running sums are split, inside a source as over all copies: parts (by the leading digits of the
shuffle key, or by range of finish time) are summed first, and only a part is ordered in one task, so
that a source with a third of all rows spreads over many.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, keyed, stored

#: Rows that one part of a source's queue should hold at most, where the sources are alike.
_PART_ROWS = 200_000


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """sources (source, source_size) with their target: `share` of all words by weight, none above
    `cap` times its source's size; what a capped source leaves goes to the others by weight.

    Weights go round the sources in order of code point, null last. In order of cap by weight the
    capped sources come first, and the level of the others follows from running sums. One row a
    source is ordered in one task, no more.
    """
    by_name, by_ratio = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("ratio", "place")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = sources.withColumn("place", F.row_number().over(by_name))
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") - 1) % len(weights) + 1))
    rows = rows.withColumn("most", F.col("source_size") * cap).withColumn("ratio", F.col("most") / F.col("weight"))
    rows = rows.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    rows = rows.withColumn("level", (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(rest))
    rows = rows.withColumn("level", F.min_by(F.when(F.col("ratio") > F.col("level"), F.col("level")), F.when(F.col("ratio") > F.col("level"), F.col("ratio"))).over(everything))
    target = F.least(F.col("most").cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.col("most").cast("double")))
    return rows.select("source", "source_size", target.alias("target"))


def queues(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, weights: tuple[int, ...], share: float, cap: int, keys: list[str]) -> DataFrame:
    """Each document with its size, its source's size and target, and done: the words of its
    source's shuffled queue up to and with it. A row without an id has its place by its text."""
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    rows = docs.select(*keys, F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), size.alias("size"), F.when(F.col(f"`{id_col}`").cast("long").isNull(), F.md5(text)).alias("no_id"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), "no_id")).cast("binary"))
    rows = stored(rows.withColumn("shuffle", key).drop("no_id"))
    digits = max(2, math.ceil(math.log(max(1, rows.count()) / _PART_ROWS, 16)))
    rows = rows.withColumn("bucket", F.substring("shuffle", 1, digits))
    sums = stored(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    ahead = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    starts = sums.join(goal, sums["source"].eqNullSafe(goal["source"])).select(sums["source"].alias("s"), sums["bucket"].alias("b"), "ahead", "source_size", "target")
    inside = W.partitionBy("source", "bucket").orderBy("shuffle", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("inside", F.sum("size").over(inside))
    rows = rows.join(starts, rows["source"].eqNullSafe(F.col("s")) & (rows["bucket"] == F.col("b")))
    return rows.select(*keys, "doc_id", "source", "size", "source_size", "target", (F.col("ahead") + F.col("inside")).alias("done"))


def serve(queued: DataFrame, budget: float, cap: int) -> DataFrame:
    """The copies of queued (from queues(); stored) with copy (0 first), finish, words, of which its
    source's target leaves the copy so many, and taken, of which the budget leaves so many.

    Ranges of (finish, source) are partitions; a running sum over the ranges, of which there are as
    many as partitions, and one inside each give every copy's place in the budget.
    """
    def copy(e: int) -> Column:
        start = F.col("done") - F.col("size") + F.col("source_size") * e
        words = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - start))
        return F.struct(F.lit(e).alias("copy"), words.alias("words"), ((start + words) / F.col("target")).alias("finish"))

    copies = queued.where("size > 0 and target > 0").withColumn("c", F.explode(F.array(*map(copy, range(cap)))))
    copies = copies.select(*queued.columns, "c.*").where("words > 0")
    ranged = stored(copies.repartitionByRange(F.col("finish"), F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()))
    ranges = ranged.groupBy(F.col("range").alias("r")).agg(F.sum("words").alias("in_range"))
    ranges = ranges.withColumn("before", F.coalesce(F.sum("in_range").over(W.orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = W.partitionBy("range").orderBy("finish", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = ranged.withColumn("inside", F.sum("words").over(inside)).join(F.broadcast(ranges.select("r", "before")), F.col("range") == F.col("r"))
    left = F.lit(int(budget)) - (F.col("before") + F.col("inside") - F.col("words"))
    return placed.select(*queued.columns, "copy", "finish", "words", F.greatest(F.lit(0), F.least("words", left)).cast("long").alias("taken"))


def allocate(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: int = 2,
    budget: float | None = None,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keys: list[str] | None = None,
) -> DataFrame:
    """Every row of docs as (doc_id long, source, size long, source_size long, target double,
    taken long, finish double), before them the columns named by keys.

    size counts the words of the whole text (null: 0). taken is what the mix takes of the document,
    repeats counted: copies in order of virtual finish time, then of source, while the budget (default:
    `share` of all words) lasts. Where the budget reaches all targets, a source's sum is its target
    rounded down. No document gives more than `cap` times its size. finish is the first copy's virtual
    finish time, null where the mix's queue does not hold it. Null sources are one source, the last.
    Rows of one id stand together in their queue, ordered by size, and rows without an id by their
    text; equal rows may change places among themselves. Reruns agree. An empty table gives no rows;
    other columns are not read.
    """
    keys = list(keys or [])
    rows = stored(queues(docs, id_col, text_col, source_col, seed, weights, share, cap, keys))
    if budget is None:
        budget = share * (rows.agg(F.sum("size")).first()[0] or 0)
    same = [*keys, "doc_id", "source", "size", "source_size", "target"]
    # Of documents with words, source and done name one.
    given = serve(rows, budget, cap).groupBy(*same, "done").agg(F.sum("taken").alias("taken"), F.min("finish").alias("finish"))
    idle = rows.where("size = 0 or target <= 0 or floor(target) <= done - size")
    return given.select(*same, "taken", "finish").union(idle.select(*same, F.lit(0).cast("long"), F.lit(None).cast("double")))


def words_of(text: Column, first: Column, count: Column) -> Column:
    """`count` words of a text from the one at place `first` (0-based), joined by blanks."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.array_join(F.slice(words, (first + 1).cast("int"), count.cast("int")), " ")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: int = 2,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mixed stream: (copy int, finish double, taken long, then docs' columns as `doc`), one row
    for every copy taken, globally range-sorted by finish time. Of the copy that the budget cuts,
    taken words count (words_of() gives them).

    The documents' columns come as one struct, so their names cannot clash. Ids may be null or repeat.
    """
    columns = docs.columns
    docs, keys = keyed(docs)
    rows = stored(queues(docs, id_col, text_col, source_col, seed, weights, share, cap, keys))
    budget = share * (rows.agg(F.sum("size")).first()[0] or 0)
    plan = serve(rows, budget, cap).where("taken > 0").select(F.col(keys[0]).alias("f"), F.col(keys[1]).alias("r"), F.col("copy"), F.col("finish"), F.col("taken"), F.col("source"))
    own = docs.select(*keys, F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"))
    out = own.join(plan, (F.col(keys[0]) == F.col("f")) & (F.col(keys[1]) == F.col("r")))
    return out.orderBy("finish", F.col("source").asc_nulls_last()).select("copy", "finish", "taken", "doc")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs, a row for each, with what allocate() says of it: size, source_size, target, taken (0
    where the mix leaves it out) and finish. A column of docs of such a name gets a `_` at its end."""
    columns = docs.columns
    docs, keys = keyed(docs)
    given = allocate(docs, keys=keys, **options)
    facts = ["size", "source_size", "target", "taken", "finish"]
    given = given.select(F.col(keys[0]).alias("f"), F.col(keys[1]).alias("r"), *facts).alias("given")
    out = docs.alias("docs").join(given.hint("shuffle_hash"), (F.col(f"docs.{keys[0]}") == F.col("given.f")) & (F.col(f"docs.{keys[1]}") == F.col("given.r")))
    return out.select(*[F.col(f"docs.`{c}`").alias(fresh(docs, c) if c.lower() in facts else c) for c in columns], *[F.col(f"given.{c}") for c in facts])
