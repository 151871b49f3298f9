"""Fill-in-the-middle over run-length encoded texts.

A text is cut between code points, which UTF-8 holds in one to four bytes. Its code points fall into
classes by that width, and a text is stored as the maximal runs of one class, each with the code
points and bytes before it. The run that holds a cut is found by binary search, and the cut's byte is
the run's first byte plus width times the units into the run. Plain ASCII is one run, whatever its
length, and no text is ever decoded or turned into a list of characters.

Only texts go to Python, and two byte offsets a text come back; what is rearranged is cut out of the
column's own bytes in the JVM. Rows stay where they are read: there is no shuffle.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Bytes of a text that are encoded at once.
BLOCK = 1 << 20

#: The markers before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")


@dataclass(frozen=True)
class Runs:
    """The maximal runs of equally wide code points: units and bytes before each, and its width.

    The last entries of units and bytes are the whole text's."""

    units: list[int]
    bytes: list[int]
    width: list[int]

    @property
    def total(self) -> int:
        return self.units[-1]

    def offset(self, cut: int) -> int:
        """The byte at which unit `cut` (0 to total) begins."""
        if cut >= self.total:
            return self.bytes[-1]
        run = bisect_right(self.units, cut) - 1
        return self.bytes[run] + (cut - self.units[run]) * self.width[run]


def encode(data: bytes, block: int = BLOCK) -> Runs:
    """The runs of a text's UTF-8 bytes. It is read a block at a time, so that what stands beside
    the text in memory follows the block and the number of runs."""
    units, starts, widths = [], [], []
    whole, at, done = np.frombuffer(data, np.uint8), 0, 0
    if data.isascii():
        return Runs([0, len(data)], [0, len(data)], [1]) if data else Runs([0], [0], [])
    while at < len(data):
        end = min(at + block, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:  # a code point is not cut
            end += 1
        first = np.flatnonzero((whole[at:end] & 0xC0) != 0x80)
        if not len(first) or first[0]:
            first = np.concatenate([[0], first])
        wide = np.diff(first, append=end - at)
        new = np.concatenate([[0], np.flatnonzero(np.diff(wide)) + 1])
        if widths and widths[-1] == wide[0]:  # goes on from the block before
            new = new[1:]
        units += (new + done).tolist()
        starts += (first[new] + at).tolist()
        widths += wide[new].tolist()
        done, at = done + len(first), end
    return Runs([*units, done], [*starts, len(data)], widths)


_CUTS = "n long, prefix long, middle long, first long, second long"


def cuts(text: Column, h1: Column, h2: Column) -> Column:
    """For a binary column of UTF-8 texts and two unsigned numbers: a struct of n, the text's code
    points; prefix and middle, in code points, where the prefix ends after the smaller of h1 mod
    (n + 1) and h2 mod (n + 1) of them and the middle after the larger; and first and second, the
    bytes at which they end. A null text counts as empty."""

    def run(texts: pa.Array, ones: pa.Array, twos: pa.Array) -> pa.Array:
        out = np.zeros((5, len(texts)), np.int64)
        for i, (t, a, b) in enumerate(zip(texts, ones.to_numpy(zero_copy_only=False), twos.to_numpy(zero_copy_only=False))):
            runs = encode(t.as_py() or b"")
            n = runs.total
            a, b = sorted((int(a) % (n + 1), int(b) % (n + 1)))
            out[:, i] = n, a, b - a, runs.offset(a), runs.offset(b)
        return pa.StructArray.from_arrays([pa.array(x) for x in out], ["n", "prefix", "middle", "first", "second"])

    return F.arrow_udf(run, _CUTS)(text, h1, h2)


def transform(docs: DataFrame, rate: int = 90, spm: int = 20, seed: str = "1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, a row for each, with n long (code points), form string, prefix_chars and middle_chars long
    (code points; null where plain) and output string.

    Draws are the first four 8-digit groups of the hex SHA-256 of "seed:id". Of each hundred of the third,
    `rate` are rearranged, and of each hundred of the fourth, `spm` begin with the suffix. Form is plain,
    and output the text, for the others, for empty texts, and for texts that hold a marker, which could
    not be told apart afterwards. A null text counts as empty, a null id as an empty one in the draw; rows
    that repeat are treated alike. An empty table gives no rows. A column of docs of a result's name
    gets a `_` at its end.
    """
    results = ["n", "form", "prefix_chars", "middle_chars", "output"]
    names = [fresh(docs, c) if c.lower() in results else c for c in docs.columns]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    whole = F.lit(False)
    for m in MARKERS:
        whole = whole | F.contains(text, F.lit(m))
    plain = (text == "") | whole | (h[2] % 100 >= rate)
    own = "fim_cuts"
    while own in (c.lower() for c in docs.columns):
        own += "_"
    rows = docs.withColumn(own, cuts(text.cast("binary"), h[0], h[1]))
    cut, data = F.col(own), text.cast("binary")
    prefix = F.substring(data, F.lit(1), cut["first"].cast("int"))
    middle = F.substring(data, (cut["first"] + 1).cast("int"), (cut["second"] - cut["first"]).cast("int"))
    suffix = F.substring(data, (cut["second"] + 1).cast("int"), F.octet_length(data))
    p, s, m = [F.lit(x).cast("binary") for x in MARKERS]
    form = F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    output = F.when(plain, data).when(h[3] % 100 < spm, F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.concat(p, prefix, s, suffix, m, middle))
    facts = [cut["n"], form, F.when(~plain, cut["prefix"]), F.when(~plain, cut["middle"]), output.cast("string")]
    return rows.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, names)], *[x.alias(k) for x, k in zip(facts, results)])


def restore(output: Column, form: Column) -> Column:
    """The text that an output of transform() was made of: it is cut again at its markers, which
    stand in it once each."""
    p, s, m = MARKERS

    def part(body: Column, before: str, after: str | None) -> Column:
        rest = F.substring(body, F.locate(before, body) + len(before), F.length(body))
        return rest if after is None else F.substring_index(rest, after, 1)

    psm = F.concat(part(output, p, s), part(output, m, None), part(output, s, m))
    spm = F.concat(part(output, p, m), part(output, m, None), part(output, s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(rows: DataFrame) -> DataFrame:
    """The columns of the operator's query, from transform()."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))
