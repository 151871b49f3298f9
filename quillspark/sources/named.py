"""A sink of text files by name, as model readers expect them: all files appear when the job commits, and
a failed job leaves none."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter
from pyspark.sql.types import StructType

from .files import Commit
from .recordings import Written


class NamedWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.to = Commit(options["path"], overwrite)

    def write(self, iterator) -> Written:
        task = uuid.uuid4().hex
        return Written([self.to.write(row["name"], [(row["value"] or "").encode()], task) for row in iterator])

    def commit(self, messages) -> None:
        self.to.commit([f for m in messages if m is not None for f in m.files])

    def abort(self, messages) -> None:
        self.to.abort()


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_text"

    def schema(self) -> str:
        return "name string, value string"

    def writer(self, schema: StructType, overwrite: bool) -> NamedWriter:
        return NamedWriter(self.options, overwrite)


def save(files: DataFrame, path: str, mode: str = "append") -> None:
    """Writes (name, value), a file a row, under path. A null or impossible name, and two rows of one
    name, fail the job; a null value is an empty file."""
    files.sparkSession.dataSource.register(NamedFiles)
    files.select(F.coalesce(F.col("name").cast("string"), F.lit("")).alias("name"), F.col("value").cast("string")).write.format("named_text").mode(mode).save(path)
