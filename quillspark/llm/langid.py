"""Language identification by Bayesian evidence fusion.

The text gives byte-trigram likelihoods per language; the markup's declared language, where there
is one, gives a factor from how declarations and texts agree over the whole table; the host gives a
prior. Host priors are smoothed by levels: a host's counts lean on its address suffix, a suffix on
the whole table. All counts are grouped aggregations over all rows, a row's own share taken out of
its host's.
"""

from __future__ import annotations

import html as markup
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_hashed, stored, with_groups

_CODES = 1 << 16
#: Ids with a known language that the likelihoods are fitted on, at most; of each language about so
#: many or all that it has, whatever its share; and languages, above which fit() raises.
TRAIN_ROWS = 8000
LANGUAGE_ROWS = 200
MAX_LANGUAGES = 64
#: Trigrams of a text are not independent: their summed log likelihood counts by this much.
TEMPER = 0.25

_CLEAN = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))
_HTML = re.compile(r"<html\b", re.IGNORECASE)
_ENDS = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_CODE = re.compile(r"\s*([A-Za-z]{2,3})(?![A-Za-z])")
_END = {k: re.compile(f"</{k}", re.IGNORECASE) for k in ("script", "style")}
_TAG = re.compile(r"(script|style)\b", re.IGNORECASE)


def visible(html: str | None) -> str:
    """The text of a page outside tags, comments, scripts and styles."""
    html, out, at = html or "", [], 0
    while True:
        lt = html.find("<", at)
        if lt < 0:
            out.append(html[at:])
            break
        out.append(html[at:lt])
        if html.startswith("<!--", lt):
            end = html.find("-->", lt)
            at = end + 3 if end >= 0 else len(html)
            continue
        name = _TAG.match(html, lt + 1)
        if name:
            close = _END[name[1].lower()].search(html, name.end())
            lt = close.start() if close else len(html)
        end = html.find(">", lt)
        at = end + 1 if end >= 0 else len(html)
        if at >= len(html):
            break
    text = " ".join(out)
    return markup.unescape(text) if "&" in text else text


def _tag_end(html: str, at: int) -> int:
    """Where the tag that `at` is in ends: the first > outside quotes, or without one, the text's end. A
    quote that never closes is read as a letter."""
    while m := _ENDS.search(html, at):
        if m[0] == ">":
            return m.start()
        close = html.find(m[0], m.end())
        at = close + 1 if close >= 0 else m.end()
    return len(html)


def declared(html: str | None) -> str | None:
    """The language of the first <html tag whose attribute lang (or xml:lang) names one; each tag is
    read once, whole."""
    html, at = html or "", 0
    while tag := _HTML.search(html, at):
        at = _tag_end(html, tag.end())
        for m in _ATTRIBUTE.finditer(html, tag.end(), at):
            if m[1].lower() in ("lang", "xml:lang") and (code := _CODE.match(m[2] or m[3] or m[4] or "")):
                return code[1].lower()
    return None


def trigrams(text: str | None) -> np.ndarray:
    """Codes of the byte trigrams of the letters of a whole text."""
    raw = " ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_CLEAN).decode("latin-1").split())
    a = np.frombuffer(f" {raw} ".encode("latin-1"), np.uint8).astype(np.int64)
    return ((a[:-2] << 10) ^ (a[1:-1] << 5) ^ a[2:]) & (_CODES - 1)


@dataclass
class Likelihoods:
    languages: list[str]
    logs: np.ndarray  # code, language

    def of(self, text: str | None) -> np.ndarray:
        codes, total = trigrams(text), np.zeros(len(self.languages))
        for at in range(0, len(codes), 1 << 18):
            total += self.logs[codes[at : at + (1 << 18)]].sum(0)
        return total * TEMPER


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS, max_languages: int = MAX_LANGUAGES) -> Likelihoods:
    """From labelled (id, text, lang): the rows of the `rows` ids of least hash, their whole texts,
    and, so that no language is missed, of about LANGUAGE_ROWS ids of least hash in each language.

    More than `max_languages` languages raise a ValueError. Counts by language and trigram are summed
    on the executors: 65,536 a language at most.
    """
    known = labelled.where("lang is not null and id is not null")
    named = stored(known.select("id", F.lower("lang").alias("lang")).distinct())
    sizes = named.groupBy("lang").count().limit(max_languages + 1).collect()
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages are named; raise max_languages to tell them apart")
    ids = named.select("id").distinct()
    least = F.lit(0).cast("long")
    for r in sizes:
        least = F.when(F.col("lang") == r["lang"], F.lit(int(min(1.0, LANGUAGE_ROWS / r["count"]) * (1 << 40)))).otherwise(least)
    some = named.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < least).select("id")
    pick = stored(least_hashed(ids, "id", rows, ids.count()).union(some).distinct())

    def count(batches):
        for b in batches:
            sums: dict[str, np.ndarray] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[lang] = sums.get(lang, 0) + np.bincount(trigrams(text), minlength=_CODES)
            for lang, s in sums.items():
                at = np.flatnonzero(s)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(s[at].astype(np.int64))], ["lang", "code", "n"])

    texts = known.select("id", "text", F.lower("lang").alias("lang")).join(F.broadcast(pick), "id", "left_semi")
    got = texts.select("lang", "text").mapInArrow(count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    names = got.column("lang").to_pylist()
    languages = sorted(set(names))
    table = np.full((_CODES, max(1, len(languages))), 0.1)
    place = {x: i for i, x in enumerate(languages)}
    for lang, code, n in zip(names, got.column("code").to_pylist(), got.column("n").to_pylist()):
        table[code, place[lang]] += n
    return Likelihoods(languages or ["und"], np.log(table / table.sum(0)))


def evidence(rows: DataFrame, model: Likelihoods) -> DataFrame:
    """rows (key columns, body, is_html, url) with declared, host, suffix, and ll: the tempered log
    likelihoods; body and url go."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # 65,536 numbers a language
    keys = [c for c in rows.columns if c not in ("body", "is_html", "url")]  # free of "host" and the other names used here
    host = F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]+)", 1))
    own = rows.select(*keys, F.when(host != "", host).alias("host"), "is_html", "body")
    n = len(keys) + 1

    def run(batches):
        for b in batches:
            said, lls = [], []
            for is_html, body in zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist()):
                said.append(declared(body) if is_html else None)
                lls.append(shared.value.of(visible(body) if is_html else body))
            cols = [b.column(i) for i in range(n)] + [pa.array(said, pa.string()), pa.array(lls, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, [*keys, "host", "declared", "ll"])

    kinds = dict(own.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in [*keys, "host"]] + ["declared string", "ll array<double>"])
    out = own.mapInArrow(run, schema)
    suffix = F.when(F.col("host").contains("."), F.substring_index("host", ".", -1))
    return out.withColumn("suffix", suffix)


def _softmax(logs: list) -> list:
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    exps = [F.exp(x - top) for x in logs]
    total = sum(exps[1:], exps[0])
    return [x / total for x in exps]


def fuse(seen: DataFrame, languages: list[str], strength: float = 20.0) -> DataFrame:
    """seen (from evidence()) with lang, confidence and text_lang."""
    n = len(languages)
    p = _softmax([F.col("ll")[i] for i in range(n)])
    seen = stored(seen.withColumn("p", F.array(*p)))
    share = [F.sum(F.col("p")[i]).alias(f"n{i}") for i in range(n)]
    host = stored(seen.groupBy("host", "suffix").agg(F.count("*").alias("n"), *share))
    # One row for each declared language, one column for each language: languages are few.
    agree = {}
    said = F.when(F.col("declared").isin(languages), F.col("declared")).otherwise(F.lit("other"))
    for r in seen.where("declared is not null").groupBy(said.alias("d")).agg(*share).collect():
        agree[r["d"]] = [r[f"n{i}"] for i in range(n)]
    kinds = [*languages, "other"]
    table = np.array([agree.get(d, [0.0] * n) for d in kinds]) + 0.5 + 2.0 * np.eye(n + 1, n)
    table = np.log(table / table.sum(0))
    row = host.agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(n)]).first()
    whole = np.array([row[f"n{i}"] or 0.0 for i in range(n)]) + 1.0
    whole = whole / whole.sum()
    # Levels: the table's share, then the suffix's, then the host's.
    suffix = host.where("suffix is not null").groupBy("suffix").agg(*[F.sum(f"n{i}").alias(f"s{i}") for i in range(n)]).withColumnRenamed("suffix", "level2")
    total = sum((F.col(f"s{i}") for i in range(1, n)), F.col("s0"))
    prior = host.join(suffix, F.col("suffix") == F.col("level2"), "left")
    prior = prior.where("host is not null").select(
        "host",
        "n",
        F.array(*[F.col(f"n{i}") for i in range(n)]).alias("h"),
        F.array(*[F.coalesce((F.col(f"s{i}") + strength * float(whole[i])) / (total + strength), F.lit(float(whole[i]))) for i in range(n)]).alias("s"),
    )
    # Rows without a host, which may be most, meet nothing.
    none = seen.where("host is null").withColumns({k: F.lit(None).cast("array<double>") for k in ("h", "s")})
    out = with_groups(seen.where("host is not null"), "host", stored(prior), "left").unionByName(none)
    rest = [F.greatest(F.col("h")[i] - F.col("p")[i], F.lit(0.0)) for i in range(n)]
    sum_rest = sum(rest[1:], rest[0])
    logs = []
    for i in range(n):
        own = F.coalesce(F.ln((rest[i] + strength * F.col("s")[i]) / (sum_rest + strength)), F.lit(float(np.log(whole[i]))))
        said_log = F.lit(0.0)
        for d, logs_d in zip(kinds, table):
            hit = ~F.col("declared").isin(languages) if d == "other" else F.col("declared") == d
            said_log = F.when(F.col("declared").isNotNull() & hit, F.lit(float(logs_d[i]))).otherwise(said_log)
        logs.append(F.col("ll")[i] + own + said_log)
    names = F.array(*map(F.lit, languages))
    out = out.withColumn("post", F.array(*_softmax(logs)))
    best = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    keys = [c for c in seen.columns if c not in ("host", "declared", "ll", "suffix", "p")]
    return out.select(*keys, best(F.col("post")).alias("lang"), F.array_max("post").alias("confidence"), best(F.col("p")).alias("text_lang"), F.col("declared").alias("declared_lang"))


def identify(rows: DataFrame, labelled: DataFrame, train_rows: int = TRAIN_ROWS, strength: float = 20.0, max_languages: int = MAX_LANGUAGES) -> DataFrame:
    """Every row of rows with lang, confidence (the posterior), text_lang and declared_lang.

    rows: any key columns, body string, is_html boolean, url string. labelled: id, text, lang; the
    languages are those it names, `max_languages` at most (more raise a ValueError), and a fit without rows knows one, "und". Null or empty bodies rest
    on the declared language and the priors; null urls have no host and take the whole table's
    shares; ties go to the language first by name. A key column named like a result gets a `_` at its end.
    Rows that repeat each get a row; labelled rows without an id, a text or a language teach nothing.
    """
    columns = [c for c in rows.columns if c not in ("body", "is_html", "url")]
    names = {c: f"key{i}_{c}" for i, c in enumerate(columns)}
    model = fit(labelled, train_rows, max_languages)
    out = fuse(evidence(rows.withColumnsRenamed(names), model), model.languages, strength)
    own = {c: c + "_" if c.lower() in RESULTS else c for c in columns}
    return out.select(*[F.col(f"`{names[c]}`").alias(own[c]) for c in columns], *RESULTS)


#: What identify() says of a row.
RESULTS = ("lang", "confidence", "text_lang", "declared_lang")
