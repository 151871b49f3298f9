"""What the operators of this package share: stored tables, row keys, samples, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session may leave it unset; it then gets a temporary folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def fleeting(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/quillspark/{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame, **options: str) -> DataFrame:
    """df written as Parquet, with the writer's options, to the shared folder and read back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation. The folder goes
    when the driver's JVM ends, or with discard().
    """
    path = fleeting(df.sparkSession)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table of a DataFrame that stored() gave, and that nothing reads any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        spark = df.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession, size: int = 8 << 20) -> None:
    """From now on the session hands Python about so many bytes at once, at most: texts are long, and a
    worker holds a batch in several forms. No result depends on it."""
    number, unit = re.fullmatch(r"(\d+)([kmg]?)b?", spark.conf.get(_BYTES).strip().lower()).groups()
    if int(number) << {"": 0, "k": 10, "m": 20, "g": 30}[unit] > size:
        spark.conf.set(_BYTES, str(size))


@contextmanager
def short_batches(spark: SparkSession, rows: int = 512):
    """Inside it, what is run hands Python at most so many rows at once: whole texts and sets are
    long. The session's own setting is back afterwards."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with two more columns that tell its rows apart, whatever they hold, and their names: a
    hash of the row's file, and its place there. Rows that are not read from Parquet are stored first.
    """
    names = [fresh(docs, "row_file"), fresh(docs, "row_at")]
    for rows in (docs, None):
        rows = stored(docs) if rows is None else rows
        try:
            meta = rows.metadataColumn("_metadata")
            out = rows.select(*[F.col(f"`{c}`") for c in rows.columns], F.xxhash64(meta["file_path"]).alias(names[0]), meta["row_index"].alias(names[1]))
            out.schema  # resolves the columns
            return out, names
        except AnalysisException:
            continue
    raise ValueError("the stored rows have no place in a file")


#: Row keys, of 16 bytes each, that are broadcast; of more, a bitmap of BITS bits.
MOST_KEYS = 1_000_000
BITS = 1 << 29


def by_key(rows: DataFrame, names: list[str], keys: DataFrame, how: str) -> DataFrame:
    """rows (of keyed()) that are among keys, a stored table of row keys ("left_semi"), or not among
    them ("left_anti").

    Up to MOST_KEYS keys are broadcast, and the rows stay where they are read. Of more, a bitmap of
    their hashes is, 64 MB at most whatever their number: rows that it rules out stay where they
    are, and only the others stream, unsorted, past hash tables of keys.
    """
    keys = keys.toDF("key_file", "key_at").alias("keys")
    on = (F.col(f"rows.{names[0]}") == F.col("keys.key_file")) & (F.col(f"rows.{names[1]}") == F.col("keys.key_at"))
    if keys.count() <= MOST_KEYS:
        return rows.alias("rows").join(F.broadcast(keys), on, how)
    place = lambda *cols: F.pmod(F.xxhash64(*cols), F.lit(BITS))
    maps = keys.select(place("key_file", "key_at").alias("p")).groupBy(F.bitmap_bucket_number("p").alias("map_number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("map"))
    maps = stored(maps).alias("maps")
    at = place(F.col(f"rows.{names[0]}"), F.col(f"rows.{names[1]}"))
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(F.col("maps.map"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = F.coalesce(F.floor(byte / F.pow(F.lit(2), bit % 8)).cast("int") % 2 == 1, F.lit(False))
    probed = rows.alias("rows").join(F.broadcast(maps), F.bitmap_bucket_number(at) == F.col("maps.map_number"), "left")
    own = [F.col(f"rows.`{c}`") for c in rows.columns]
    some = probed.where(met).select(*own).alias("rows").join(keys.hint("shuffle_hash"), on, how)
    return some.alias("rows") if how == "left_semi" else probed.where(~met).select(*own).union(some).alias("rows")


#: A key of more rows than HOT_ROWS, and than one in MOST_HOT of all, is hot; MOST_HOT keys are at most.
HOT_ROWS = 1000
MOST_HOT = 100_000


def with_groups(rows: DataFrame, key: str, groups: DataFrame, how: str = "inner", most: int | None = None) -> DataFrame:
    """rows joined ("inner" or "left") with groups (key, n, facts; stored, one row a key), n being the
    rows that have the key; n itself is left out.

    Up to `most` groups (MOST_HOT unless given) are broadcast. Of more only the hot ones are, whose number is bounded whatever
    the tables' size, so that no task gets all rows of such a key; the others meet by a shuffle.
    """
    count, total = groups.agg(F.count("*"), F.sum("n")).first()
    if count <= (MOST_HOT if most is None else most):
        return rows.join(F.broadcast(groups.drop("n")), key, how)
    hot = F.col("n") > max(HOT_ROWS, int(total) // MOST_HOT)
    first = F.broadcast(groups.where(hot).drop("n"))
    rest = rows.join(first.select(key), key, "left_anti").join(groups.where(~hot).drop("n"), key, how)
    return rows.join(first, key).unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def least_hashed(df: DataFrame, key: str, rows: int, n: int) -> DataFrame:
    """At most `rows` of df's n rows: those whose key has the least hash.

    A first cut by the hash's share of its range leaves about twice as many as are asked for, so
    that what is sorted does not grow with n.
    """
    h = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    share = min(1.0, (2.0 * rows + 1000) / max(1, n))
    return df.where(h < int(share * (1 << 40))).orderBy(h, key).limit(rows)


def held_out(doc_id):
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u long, v long): the least node reachable.

    Alternates large-star and small-star steps. Each is a min per node, combined before the
    shuffle, and an equi-join that the engine may split where one node has very many links. Only
    two numbers a round reach the driver.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = stored(e.distinct())
    before = None  # a round's tables go when the next one's are written
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("k"), F.least("u", "m").alias("m")
        )
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(least, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, stored(small.union(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct())
        discard(last)
        discard(large)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    label = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return label.union(roots)
