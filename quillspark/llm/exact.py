"""Exact duplicates by a tree-merge of sorted digest runs, in DataFrame operations alone.

Each partition of the table is a run: one entry for every text in it, with the identifier to keep
and how many rows have it. In each round 2^bits neighbouring runs are merged into one: entries of
one text, which are 2^bits at most, meet in sorted order and leave one, with the identifier that
stays. So copies are gone from every level before the next exchange, and a text that a third of all
rows share is never more than 2^bits rows of a task. Runs are dealt out by run and digest together:
no run, the last one included, is in one task.

An entry's digest is the SHA-256 of the text followed by its length in bytes and its 64-bit xxHash.
Two texts are merged at a level only where all three agree, so that entries are verified there, and
a clash of one of them parts texts instead of joining them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_key, keyed, stored, with_groups

#: 2^BITS runs are merged into one.
BITS = 4


def entries(docs: DataFrame, names: list[str], keep: str = "largest", normal: Callable[[Column], Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, run, digest binary, own), one for each row of keyed() docs, whose keys are names:
    the digest of its normal text, the run it stands in, and own, which orders the rows of a text by
    their claim to stay: by id, null ids last, then by place in the files."""
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep is largest or smallest, not {keep}")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    data = (normal(text) if normal else text).cast("binary")
    number = lambda c: F.lpad(F.hex(c.cast("long")), 16, "0")
    digest = F.unhex(F.concat(F.sha2(data, 256), number(F.octet_length(data)), number(F.xxhash64(data))))
    doc_id = F.col(f"`{id_col}`").cast("long")
    rank = doc_id.isNotNull() if keep == "largest" else doc_id.isNull()
    own = F.struct(rank.alias("rank"), doc_id.alias("doc_id"), F.col(names[0]).alias("key_file"), F.col(names[1]).alias("key_at"))
    return docs.select(doc_id.alias("doc_id"), F.spark_partition_id().alias("run"), digest.alias("digest"), own.alias("own"))


def merged(rows: DataFrame, keep: str = "largest", bits: int = BITS) -> DataFrame:
    """(digest, best, n), one for each text of entries() (stored): who stays, and how many rows."""
    best = F.max if keep == "largest" else F.min
    last = rows.agg(F.max("run")).first()[0] or 0
    runs = rows.groupBy("run", "digest").agg(best("own").alias("best"), F.count("*").alias("n"))
    while last:
        last >>= bits
        runs = runs.withColumn("run", F.shiftright("run", bits)).groupBy("run", "digest").agg(best("best").alias("best"), F.sum("n").alias("n"))
    return runs.drop("run")


def _labelled(rows: DataFrame, keep: str, bits: int) -> DataFrame:
    shared = stored(merged(rows, keep, bits).where("n > 1").select("digest", "n", F.col("n").alias("group_size"), "best"))
    return with_groups(rows.drop("run"), "digest", shared, "left")


def copies(docs: DataFrame, keep: str = "largest", bits: int = BITS, normal: Callable[[Column], Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string) for every row
    of docs.

    Texts are equal where they are identical after `normal`, an expression over the text (none: as they
    are); a null text counts as empty. Of equal texts the row with the largest (or smallest) doc_id
    stays; rows without an id stay only where no other has the text, and of rows that also share their id
    the last (first) in the files' order does. text_sha256 is of the normal text. An empty table gives no
    rows; other columns are not read.
    """
    rows = stored(entries(*keyed(docs), keep, normal, id_col, text_col))
    out = _labelled(rows, keep, bits)
    alone = F.col("best").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("best") == F.col("own"))).alias("kept"),
        F.lower(F.hex(F.substring("digest", 1, 32))).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, keep: str = "largest", bits: int = BITS, normal: Callable[[Column], Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; their texts stay where they are read."""
    columns = docs.columns
    docs, names = keyed(docs)
    rows = stored(entries(docs, names, keep, normal, id_col, text_col))
    gone = _labelled(rows, keep, bits).where("best <> own").select("own.key_file", "own.key_at")
    return by_key(docs, names, stored(gone), "left_anti").select(*[F.col(f"rows.`{c}`") for c in columns])
