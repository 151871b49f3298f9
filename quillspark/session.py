"""Sessions and tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast


def session(app: str = "quillspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; master only where none is configured outside."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.python.filterPushdown.enabled": "true"}
    for k, v in (defaults | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; only a local session may
    leave it unset, and gets a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def fleeting(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/quillspark/{name}{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: this cuts the lineage of an iteration, and
    survives the loss of an executor."""
    path = fleeting(df.sparkSession, "")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table of a DataFrame that stored() gave, and that nothing reads any more."""
    if path := getattr(df, "_stored_at", None):
        spark = df.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of a table of models or components that is broadcast.
MOST_BROADCAST = 100_000


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df to be broadcast where it has `most` rows at most, which is counted; else the engine joins
    it by a shuffle."""
    df = stored(df)
    return broadcast(df) if df.count() <= most else df


def one_row(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df, to be gathered into one row, stored; a ValueError where it has more than `most` rows."""
    df = stored(df)
    n = df.count()
    if n > most:
        raise ValueError(f"{n} rows are too many for one; {most} are allowed")
    return df
