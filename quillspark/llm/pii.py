"""Personal data by weak supervision.

Candidates come from strict patterns and from looser ones. Labelers vote on each (yes, no or
nothing): a strict pattern, a checksum or shape test, a gazetteer, the words before it, and its
neighbouring letters. How often each vote pattern occurs in the whole corpus is counted on the
executors; expectation-maximisation over these counts estimates each labeler's reliability and each
pattern's probability, and a logistic span classifier is trained on those probabilities. What it
accepts among the loose candidates is added to the strict matches, which always stay.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: The kinds of personal data in the order of listing.
KINDS = ("email", "ip", "card", "phone")

_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Each match of these starts where a run of digits does, so that long runs cost no second look.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Looser forms, which only the classifier can accept: kind, pattern, and the strict
#: labeler's vote. A form that is whole in itself but stands in a run that the strict pattern read
#: as one too long match (a number next to a number) gets no vote from it; others get a no.
_LOOSE = (
    ("card", re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])"), 0),
    ("phone", re.compile(r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{4}(?![0-9])"), 0),
    ("phone", re.compile(r"(?<![0-9+(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"), -1),
    ("email", re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]{2,63}){1,4}", re.IGNORECASE), -1),
)

#: Gazetteers of address endings, country calling codes and words that go before.
_ENDINGS = frozenset("com org net edu gov info io co uk de fr es it nl eu ch at be pl pt se no dk fi ie us ca au nz jp cn in br mx ru".split())
_CALLING = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_CUES = {
    "email": frozenset("email mail e-mail contact write courriel correo schreiben".split()),
    "ip": frozenset("ip address host server login adresse servidor".split()),
    "card": frozenset("card visa mastercard credit debit carte karte tarjeta".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax telefon teléfono téléphone".split()),
}
_AGAINST = frozenset("version isbn order invoice ticket build serial part doi page".split())
_WORDS = re.compile(r"[\w-]+")

N_VOTES = 5
#: Fixed values of a feature: how long a span is, and what stands before and behind it.
_LENGTHS = (10, 14, 18, 24)


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern: from each @ back over what may stand before it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        n = len(before) - len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if n else None
        if m:
            out.append((at - n, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return out


def strict(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base matches of a whole text, by kind, then start; code points."""
    out = [(0, s, e) for s, e in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 or int((p.lstrip("0") or "0")[:4]) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
                out.append((3, *m.span()))
    return out


def _votes(text: str, kind: int, s: int, e: int, own: int) -> tuple[int, ...]:
    span = text[s:e]
    digits = "".join(c for c in span if c.isdigit())
    if kind == 0:
        tail = re.split(r"[.\])\x20]", span.lower())[-1]
        shape = 1 if tail.isalpha() and 2 <= len(tail) <= 24 else -1
        listed = 1 if tail in _ENDINGS else 0
    elif kind == 1:
        first = int(digits[:1] and span.split(".")[0][:4])
        shape = 1 if all(p == "0" or p[:1] != "0" for p in span.split(".")) else -1
        listed = -1 if first in (0, 127) or first >= 224 else 1
    elif kind == 2:
        shape = 1 if 13 <= len(digits) <= 19 and luhn(digits) else -1
        listed = 1 if digits[:1] in "23456" else -1
    else:
        shape = 1 if 9 <= len(digits) <= 15 else -1
        listed = (1 if digits.startswith(_CALLING) else -1) if span[0] == "+" else 0
    words = _WORDS.findall(text[max(0, s - 40) : s].lower())[-4:]
    cue = 1 if any(w in _CUES[KINDS[kind]] for w in words) else -1 if any(w in _AGAINST for w in words) else 0
    edge = 1 if not text[s - 1 : s].isalnum() and not text[e : e + 1].isalnum() else -1
    return (own, shape, listed, cue, edge)


def _features(text: str, kind: int, s: int, e: int) -> tuple[int, ...]:
    side = lambda c: 0 if not c or c.isspace() else 1 if c.isalnum() else 2
    return (sum(e - s > b for b in _LENGTHS), side(text[s - 1 : s]), side(text[e : e + 1]))


def candidates(text: str | None) -> list[tuple[int, int, int, bool, tuple[int, ...], tuple[int, ...]]]:
    """(kind, start, end, base, votes, features) of a whole text; loose ones that touch a base
    match, or an earlier loose one, are not candidates."""
    text = text or ""
    base = strict(text)
    spans = [(k, s, e, 1) for k, s, e in base]
    taken = sorted((s, e) for _, s, e in base)
    digits = _DIGIT.search(text) is not None
    for name, pattern, own in _LOOSE:
        kind = KINDS.index(name)
        if not ("[" in text or "(" in text) if name == "email" else not digits:
            continue
        free, at = [], 0
        for m in pattern.finditer(text):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            if at < len(taken) and taken[at][0] < m.end():
                continue
            if name == "card" and not luhn(m[0].replace(" ", "").replace("-", "")):
                continue
            free.append((kind, *m.span(), own))
        spans += free
        taken = sorted(taken + [(s, e) for _, s, e, _ in free])
    return [(k, s, e, own == 1, _votes(text, k, s, e, own), _features(text, k, s, e)) for k, s, e, own in spans]


def _code(votes: tuple[int, ...], features: tuple[int, ...]) -> int:
    """Votes and features as one number below 3**5 * 5 * 3 * 3."""
    n = 0
    for v in votes:
        n = 3 * n + v + 1
    for f, size in zip(features, (5, 3, 3)):
        n = size * n + f
    return n


def _decode(code: int) -> tuple[list[int], list[int]]:
    features = []
    for size in (3, 3, 5):
        code, f = divmod(code, size)
        features.insert(0, f)
    votes = []
    for _ in range(N_VOTES):
        code, v = divmod(code, 3)
        votes.insert(0, v - 1)
    return votes, features


@dataclass
class SpanModel:
    """The estimates by kind, and the classifier's probability of every (kind, code) met."""

    reliability: np.ndarray  # kind, labeler, class, vote
    prior: np.ndarray  # kind
    weight: np.ndarray  # kind, feature

    @staticmethod
    def _row(code: int) -> np.ndarray:
        votes, (length, left, right) = _decode(code)
        x = np.zeros(1 + 3 * N_VOTES + 5 + 3 + 3)
        x[0] = 1
        for j, v in enumerate(votes):
            x[1 + 3 * j + v + 1] = 1
        x[1 + 3 * N_VOTES + length] = x[6 + 3 * N_VOTES + left] = x[9 + 3 * N_VOTES + right] = 1
        return x

    @classmethod
    def fit(cls, counts: dict[tuple[int, int], int], rounds: int = 100) -> SpanModel:
        """Expectation-maximisation over the vote patterns' counts, then logistic regression."""
        k = len(KINDS)
        rel, prior = np.full((k, N_VOTES, 2, 3), 1 / 3), np.full(k, 0.5)
        weight = np.zeros((k, 12 + 3 * N_VOTES))
        for kind in range(k):
            own = sorted((c, n) for (kk, c), n in counts.items() if kk == kind)
            if not own:
                continue
            votes = np.array([_decode(c)[0] for c, _ in own])
            n = np.array([m for _, m in own], float)
            p = 1 / (1 + np.exp(-1.5 * votes.sum(1)))
            for _ in range(rounds):
                prior[kind] = min(max((n * p).sum() / n.sum(), 1e-3), 1 - 1e-3)
                for y, w in ((0, n * (1 - p)), (1, n * p)):
                    for j in range(N_VOTES):
                        c = np.array([(w * (votes[:, j] == v)).sum() for v in (-1, 0, 1)])
                        # What is believed of a labeler before: it is right oftener than wrong.
                        c += (1, 1, 3) if y else (3, 1, 1)
                        rel[kind, j, y] = c / c.sum()
                logs = [np.log(rel[kind, np.arange(N_VOTES), y][np.arange(N_VOTES), votes + 1]).sum(1) for y in (0, 1)]
                p = 1 / (1 + np.exp(-np.clip(np.log(prior[kind] / (1 - prior[kind])) + logs[1] - logs[0], -50, 50)))
            x, w = np.array([cls._row(c) for c, _ in own]), n / n.sum()
            b = np.zeros(x.shape[1])
            for _ in range(400):
                q = 1 / (1 + np.exp(-np.clip(x @ b, -50, 50)))
                b -= 1.0 * (x.T @ (w * (q - p)) + 1e-4 * b)
            weight[kind] = b
        return cls(rel, prior, weight)

    def probability(self, kind: int, code: int) -> float:
        return float(1 / (1 + np.exp(-np.clip(self._row(code) @ self.weight[kind], -50, 50))))


_FOUND = "array<struct<kind:int,start:int,end:int,base:boolean,code:int>>"
_FOUND_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("code", pa.int32())]))


def _structs(text: str | None) -> list[dict]:
    return [{"kind": k, "start": s, "end": e, "base": b, "code": _code(v, f)} for k, s, e, b, v, f in candidates(text)]


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, found) with every row's candidates; null texts count as empty."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_structs(t) for t in b.column(1).to_pylist()], _FOUND_ARROW)], ["doc_id", "found"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"doc_id long, found {_FOUND}")


def fit(found: DataFrame) -> SpanModel:
    """Fitted on all candidates: their counts by kind and code, at most 4 * 3**5 * 45 numbers."""
    rows = found.select(F.explode("found").alias("f")).groupBy("f.kind", "f.code").count().collect()
    return SpanModel.fit({(r["kind"], r["code"]): r["count"] for r in rows})


def accepted(model: SpanModel, spans: list[dict], threshold: float) -> list[dict]:
    """The base spans and what the classifier adds, by kind, then start."""
    keep = [x for x in spans if x["base"] or model.probability(x["kind"], x["code"]) >= threshold]
    return sorted(keep, key=lambda x: (x["kind"], x["start"]))


def personal_data(docs: DataFrame, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, spans array of (kind string, start, end, base)) for every row of docs.

    Spans stand by kind as listed, then start, and count code points, the end exclusive. A null
    text counts as empty; null and repeated ids keep their rows; other columns are not read.
    """
    found = stored(extract(docs, id_col, text_col))
    model = docs.sparkSession.sparkContext.broadcast(fit(found))  # some hundred numbers

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for b in batches:
            out = [[{"kind": KINDS[x["kind"]], "start": x["start"], "end": x["end"], "base": x["base"]} for x in accepted(model.value, row, threshold)] for row in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    return found.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean>>")


def redact(docs: DataFrame, threshold: float = 0.9, text_col: str = "text") -> DataFrame:
    """docs with every span of personal data in text_col replaced by its kind in brackets.

    All columns and rows stay as they are otherwise; a null text stays null. Overlapping spans
    become one, named by the first.
    """
    found = stored(extract(docs.select(F.lit(None).cast("long").alias("doc_id"), text_col), "doc_id", text_col).where(F.size("found") > 0))
    model = docs.sparkSession.sparkContext.broadcast(fit(found))

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for x in sorted(accepted(model.value, _structs(text), threshold), key=lambda x: (x["start"], -x["end"])):
            if x["start"] >= at:
                out += [text[at : x["start"]], f"[{KINDS[x['kind']].upper()}]"]
            at = max(at, x["end"])
        return "".join(out) + text[at:] if out else text

    i = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            cols = list(b.columns)
            cols[i] = pa.array([clean(t) for t in cols[i].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def digest(spans: DataFrame) -> DataFrame:
    """The columns of the operator's query, from personal_data()."""
    base = F.filter("spans", lambda x: x.base)
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x.base & (x.kind == k))).cast("long").alias(f"n_{k}")
    return spans.select("doc_id", *map(count, KINDS), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
