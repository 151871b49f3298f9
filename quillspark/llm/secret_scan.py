"""Secret scans over an incremental ledger of blobs.

Every version of a text is addressed by the SHA-256 of its content. The ledger holds, for each
pair of address and rule version scanned before, what was found. A scan takes only the pairs the
ledger lacks, reads one copy of each such blob, and then joins findings back to all its paths.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, keyed, stored

#: The kinds of secret in the order of listing, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
RULES = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII, 2, 6),
    "access": (r"AKIA[A-Z0-9]+", re.ASCII, 0, 20),
    "hex": (r"[0-9a-f]+", re.ASCII, 0, 24),
}
#: Of these rules; to be raised with any change, so that all blobs are scanned anew.
RULE_VERSION = 1

_COMPILED = {k: (re.compile(p, flags), group, least) for k, (p, flags, group, least) in RULES.items()}
# The same matches: a run that is long enough is matched whole from its start, a shorter one fails.
_COMPILED["hex"] = (re.compile(r"[0-9a-f]{24,}"), 0, 24)

_FOUND = "array<struct<kind:string,start:int,end:int>>"
_FOUND_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret of a whole text by start, then kind; code points."""
    text, out = text or "", []
    for order, kind in enumerate(KINDS):
        if kind == "access" and "AKIA" not in text or kind == "assign" and "=" not in text and ":" not in text:
            continue
        pattern, group, least = _COMPILED[kind]
        out += [(m.start(), order, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(KINDS[o], s, e) for s, o, e in sorted(out)]


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], f"sha string, rule_version int, found {_FOUND}")


def scan_new(docs: DataFrame, ledger: DataFrame | None = None, rule_version: int = RULE_VERSION, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(paths, additions): every row of docs as (doc_id long, sha string), and the ledger's new rows
    (sha, rule_version, found) for the blobs that it has not yet under this rule version.

    An id that stands with several texts is a path with several versions. Addresses are computed where
    the texts lie; of each new blob one row is read again, also where it lies, and scanned. Where
    the ledger has all blobs, no text is read again. A null text counts as empty. Ids may be null
    or repeat. Other columns are not read.
    """
    docs, names = keyed(docs)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    paths = stored(docs.select(F.col(names[0]).alias("key_file"), F.col(names[1]).alias("key_at"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("sha")))
    new = paths.groupBy("sha").agg(F.min(F.struct("key_file", "key_at")).alias("k"))
    if ledger is not None:
        new = new.join(ledger.where(F.col("rule_version") == rule_version).select("sha"), "sha", "left_anti")
    new = stored(new.select("k.*"))
    texts = by_key(docs, names, new, "left_semi").select(F.coalesce(F.col(f"rows.`{text_col}`"), F.lit("")).alias("text"))
    texts = texts.select(F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "text")

    def run(batches):
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(text)] for text in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _FOUND_ARROW)], ["sha", "found"])

    if new.isEmpty():
        found = empty_ledger(docs.sparkSession).select("sha", "found")
    else:
        found = texts.mapInArrow(run, f"sha string, found {_FOUND}")
    return paths.select("doc_id", "sha"), found.select("sha", F.lit(rule_version).alias("rule_version"), "found")


def _joined(paths: DataFrame, known: DataFrame) -> DataFrame:
    # Most blobs hold nothing: only the others are joined back.
    hits = known.where(F.size("found") > 0).select("sha", "found").dropDuplicates(["sha"])
    return paths.join(hits, "sha", "left").select("doc_id", "sha", F.coalesce("found", F.array().cast(_FOUND)).alias("found"))


def findings(docs: DataFrame, ledger: DataFrame | None = None, rule_version: int = RULE_VERSION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, sha string, found array of (kind, start, end)) for every row of docs."""
    paths, additions = scan_new(docs, ledger, rule_version, id_col, text_col)
    known = stored(additions)
    if ledger is not None:
        known = known.unionByName(ledger.where(F.col("rule_version") == rule_version))
    return _joined(paths, known)


class Ledger:
    """A ledger kept as Parquet in a folder that driver and executors share.

    Only whole appends are seen; where two runs add one blob at once, it stands twice and counts once.
    """

    def __init__(self, spark, path: str) -> None:
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        """(sha, rule_version, found) of all that was scanned before."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return empty_ledger(self.spark)
        return self.spark.read.schema(f"sha string, rule_version int, found {_FOUND}").parquet(self.path)

    def findings(self, docs: DataFrame, rule_version: int = RULE_VERSION, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
        """(findings(), how many blobs were scanned for it): what is new is scanned and appended, and
        all comes from the ledger."""
        paths, new = scan_new(docs, self.read(), rule_version, id_col, text_col)
        new = stored(new)
        scanned = new.count()
        if scanned:
            new.write.mode("append").parquet(self.path)
        return _joined(paths, self.read().where(F.col("rule_version") == rule_version)), scanned

    def merge(self, other: DataFrame) -> None:
        """Adds the rows of another ledger that this one has not."""
        own = self.read().select("sha", "rule_version")
        stored(other.dropDuplicates(["sha", "rule_version"]).join(own, ["sha", "rule_version"], "left_anti").select("sha", "rule_version", "found")).write.mode("append").parquet(self.path)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the operator's query, from findings()."""
    count = lambda k: F.size(F.filter("found", lambda x: x.kind == k)).cast("long")
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(spans.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))
