"""Quality classifier: regularised quadratic discriminant over document statistics.

Statistics of the whole text are transformed (logarithms of counts and of smoothed shares) so that
each class is close to a Gaussian. Each class's mean and covariance come from sums over the
labelled training rows, of which there is a bound; covariances are shrunk towards their diagonal and towards the pooled one.
The score is the logistic of the difference of the classes' Mahalanobis log densities and of their
log priors, computed with each class's Cholesky factor, which is inverted once and kept.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, least_hashed, stored

_SENTENCE = re.compile(r"[.!?\n]+")
_CLASS = np.zeros((256, 6))
for _i in range(256):
    _ch = chr(_i)
    _CLASS[_i] = [_ch.isascii() and _ch.isalpha() or _i >= 192, _ch.isascii() and _ch.isupper(), _i < 128 and _ch.isdigit(), _i < 128 and (_ch.isspace()), _ch in ".,;:!?'\"()-", 32 < _i < 127 and not _ch.isalnum() and _ch not in ".,;:!?'\"()-"]

N_STATS = 14
#: Pseudo-counts of an ordinary text in each share.
_SMOOTH = 10


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text; a null text counts as empty."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    letters, upper, digits, space, marks, symbols = (np.bincount(raw, minlength=256) @ _CLASS).tolist()
    chars = letters + digits + marks + symbols
    words = text.split()
    n = len(words)
    counts = Counter(words)
    sentences = [s for s in map(str.strip, _SENTENCE.split(text)) if s]
    unique = len(set(sentences))
    # Smoothed by _SMOOTH words or letters of an ordinary text, so that short texts stand close to it.
    share = lambda a, b, usual: np.log((a + _SMOOTH * usual) / (b + _SMOOTH))
    longest = max(counts.values(), default=0)
    return [
        np.log1p(n),
        np.log((letters + 5 * _SMOOTH) / (n + _SMOOTH)),
        share(symbols, chars, 0.01),
        share(marks, chars, 0.04),
        share(digits, chars, 0.01),
        share(upper, letters, 0.04),
        share(max(0, longest - 1), n, 0.05),
        share(len(counts), n, 0.8),
        share(unique, len(sentences), 1.0),
        share(len(sentences), n, 0.1),
        share(sum(c for w, c in counts.items() if len(w) == 1), n, 0.02),
        share(sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:!?'\")"), n, 0.01),
        share(sum(c for w, c in counts.items() if len(w) <= 3), n, 0.35),
        share(space, n, 1.0),
    ]


@dataclass
class Discriminant:
    """Two Gaussian classes; None where the training rows lack one of them."""

    log_prior: np.ndarray
    mean: np.ndarray
    inverse_factor: np.ndarray  # of each covariance's Cholesky factor
    log_det: np.ndarray

    @classmethod
    def fit(cls, n: np.ndarray, total: np.ndarray, cross: np.ndarray, shrink: float, pool: float) -> Discriminant | None:
        if (n < 2).any():
            return None
        mean = total / n[:, None]
        cov = cross / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
        common = (cov * n[:, None, None]).sum(0) / n.sum()
        inverse, log_det = [], []
        for c in cov:
            c = (1 - pool) * c + pool * common
            c = (1 - shrink) * c + shrink * np.diag(np.diag(c)) + 1e-4 * np.eye(len(c))
            low = np.linalg.cholesky(c)
            inverse.append(np.linalg.inv(low))
            log_det.append(2 * np.log(np.diag(low)).sum())
        return cls(np.log(n / n.sum()), mean, np.array(inverse), np.array(log_det))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1."""
        logs = []
        for k in (0, 1):
            z = (x - self.mean[k]) @ self.inverse_factor[k].T
            logs.append(self.log_prior[k] - 0.5 * (self.log_det[k] + (z * z).sum(1)))
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -500, 500)))


#: Labelled documents that the classes are fitted on, at most.
TRAIN_ROWS = 65536


def _matrix(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t) for t in texts.to_pylist()]).reshape(len(texts), N_STATS)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", shrink: float = 0.1, pool: float = 0.2, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Discriminant | None:
    """Fitted on the labelled documents that are not held out: all, or the `train_rows` whose ids have
    the least hash. Only their texts are read for it, where they lie.

    Only sums for each class leave the executors: 2 * (1 + d + d * d) numbers in all. Labels other
    than 0 and 1, and null ids, are left out; an id labelled more than once takes its lowest label.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    own = own.where("id is not null and y in (0, 1)").where(~held_out(F.col("id"))).groupBy("id").agg(F.min("y").alias("y"))
    own = stored(own)
    own = stored(least_hashed(own, "id", train_rows, own.count()))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.join(F.broadcast(own), F.col("doc_id") == F.col("id")).select("y", "text")  # train_rows at most
    d = N_STATS

    def sums(batches):
        total = np.zeros((2, 1 + d + d * d))
        for b in batches:
            y, x = b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1))
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        for k in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(total.shape[1], k, np.int32)), pa.array(np.arange(total.shape[1], dtype=np.int32)), pa.array(total[k])], ["y", "i", "s"])

    total = np.zeros((2, 1 + d + d * d))
    for r in rows.mapInArrow(sums, "y int, i int, s double").groupBy("y", "i").agg(F.sum("s").alias("s")).collect():
        total[r["y"], r["i"]] = r["s"]
    return Discriminant.fit(total[:, 0], total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d), shrink, pool)


def _scores(model: Discriminant | None, texts: pa.Array) -> np.ndarray:
    """Where the training rows lack a class nothing can be told apart, and every score is 1."""
    return np.ones(len(texts)) if model is None else model.score(_matrix(texts))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, held_out boolean, score double, predicted int) for every row of docs.

    Empty and null texts are scored like any other. Where the training rows lack a class nothing
    can be told apart, and every score is 1. A null id is not held out. Repeated rows each get a
    row. Only the id and the text are read from docs; labels, lang and source never enter a score.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, train_rows=train_rows, id_col=id_col, text_col=text_col))  # a few hundred numbers

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(model.value, b.column(1)))], ["doc_id", "score"])

    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = own.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that classify() predicts to be of class 1, with all their columns. A row is
    judged by its text where it is read, so null and repeated ids are judged like others."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, train_rows=train_rows, id_col=id_col, text_col=text_col))
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_scores(model.value, b.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
