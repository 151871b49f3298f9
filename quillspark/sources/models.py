"""Model parameters and features in text files, and their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import one_row
from . import named

_NAME = r"([^/]+)$"


def _tokens(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(file, tokens) of whole files; files are small."""
    reader = spark.read
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.text(path, wholetext=True).withColumn("file", F.regexp_extract(F.input_file_name(), _NAME, 1))
    return rows.select("file", F.filter(F.split("value", r"\s+"), lambda t: t != "").alias("tokens"))


def matrices(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(file, row, values, path): numbers by line, as numeric text writers leave them. Blank lines do not
    count."""
    rows = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).withColumn("path", F.input_file_name()).withColumn("file", F.regexp_extract("path", _NAME, 1))
    lines = F.filter(F.split("value", r"\r?\n"), lambda s: F.trim(s) != "")
    rows = rows.select("file", "path", F.posexplode(lines).alias("row", "line"))
    return rows.select("file", "row", F.transform(F.filter(F.split(F.trim("line"), r"\s+"), lambda t: t != ""), lambda t: t.try_cast("double")).alias("values"), "path")


def features(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(utt, t, vec, path) of feature files, one frame a line."""
    return matrices(spark, path, pattern).select(F.regexp_replace("file", r"\.[^.]*$", "").alias("utt"), F.col("row").cast("long").alias("t"), F.col("values").alias("vec"), "path")


def hmm_text(spark: SparkSession, path: str, last_leave: float | None = None) -> DataFrame:
    """(model, state, mean, var, stay, next) of one model's four files each: <digit>hmm_mean.txt,
    _var, _self_trans and _trans_p. last_leave: what the last state costs to leave (staying in it
    is then free), since files may hold a raw probability there."""
    rows = matrices(spark, path, "*hmm_*.txt").withColumn("model", F.regexp_extract("file", r"^(\d+)hmm_", 1)).withColumn("kind", F.regexp_extract("file", r"hmm_(mean|var|self_trans|trans_p)\.txt$", 1)).where("kind <> '' and model <> ''")
    part = lambda k: F.max(F.when(F.col("kind") == k, F.col("values")))
    got = rows.groupBy(F.col("model").cast("int").alias("model"), F.col("row").alias("state")).agg(part("mean").alias("mean"), part("var").alias("var"), part("self_trans")[0].alias("stay"), part("trans_p")[0].alias("next"))
    if last_leave is None:
        return got
    top = got.groupBy("model").agg(F.max("state").alias("_top"))
    last = F.col("state") == F.col("_top")
    return got.join(F.broadcast(top), "model").withColumns({"stay": F.when(last, 0.0).otherwise(F.col("stay")), "next": F.when(last, float(last_leave)).otherwise(F.col("next"))}).drop("_top")


def skip_text(spark: SparkSession, path: str) -> DataFrame:
    """(model, row, mean, var, stay, next, skip) of mean<m>.txt, vari<m>.txt and tran<m>.txt, whose
    rows hold three transition costs. A transition row more than there are states stands for the
    entry: row 0 is then the entry, with null mean and variance, and states follow from row 1."""
    rows = matrices(spark, path, "*.txt").withColumn("model", F.regexp_extract("file", r"^(?:mean|vari|tran)(\d+)\.txt$", 1).try_cast("int")).withColumn("kind", F.substring("file", 1, 4)).where("model is not null")
    counts = rows.groupBy("model").agg((F.count_if(F.col("kind") == "tran") - F.count_if(F.col("kind") == "mean")).cast("int").alias("_entry"))
    rows = rows.join(F.broadcast(counts), "model").withColumn("row", F.when(F.col("kind") == "tran", F.col("row")).otherwise(F.col("row") + F.greatest("_entry", F.lit(0))))
    part = lambda k: F.max(F.when(F.col("kind") == k, F.col("values")))
    got = rows.groupBy("model", "row").agg(part("mean").alias("mean"), part("vari").alias("var"), part("tran").alias("_t"))
    return got.select("model", "row", "mean", "var", F.get("_t", F.lit(0)).alias("stay"), F.get("_t", F.lit(1)).alias("next"), F.get("_t", F.lit(2)).alias("skip"))


def gmm_text(spark: SparkSession, path: str) -> DataFrame:
    """(model, state, g, alpha, mean, var) of <digit>gmm_mean<g>.txt, _var<g> and _weight files."""
    rows = matrices(spark, path, "*gmm_*.txt").withColumn("model", F.regexp_extract("file", r"^(\d+)gmm_", 1).try_cast("int")).where("model is not null")
    comp = rows.withColumn("kind", F.regexp_extract("file", r"gmm_(mean|var)\d+\.txt$", 1)).withColumn("g", F.regexp_extract("file", r"(\d+)\.txt$", 1).try_cast("int") - 1).where("kind <> ''")
    part = lambda k: F.max(F.when(F.col("kind") == k, F.col("values")))
    comp = comp.groupBy("model", F.col("row").alias("state"), "g").agg(part("mean").alias("mean"), part("var").alias("var"))
    weights = rows.where(F.col("file").endswith("gmm_weight.txt")).select("model", F.col("row").alias("state"), F.posexplode("values").alias("g", "alpha"))
    return comp.join(weights, ["model", "state", "g"]).select("model", "state", "g", "alpha", "mean", "var")


def dat(spark: SparkSession, path: str, pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The components (file, model, state, g, alpha, mean, var) and transitions (file, model, src,
    dst, cost) of `.dat` files: a header `models states components dimensions`, then for each model
    its states' components as weight, means, variances, and its transition matrix. Costs off the
    chain (other than staying and the next state) are unset memory and left out."""
    t = _tokens(spark, path, pattern).withColumn("h", F.transform(F.slice("tokens", 1, 4), lambda x: x.try_cast("int")))
    m, s, g, d = (F.get("h", F.lit(k)) for k in range(4))
    per_state = g * (1 + 2 * d)
    per_model = s * per_state + s * s
    rows = t.withColumn("model", F.explode(F.sequence(F.lit(0), m - 1)))
    base = F.lit(4) + F.col("model") * per_model
    cells = rows.withColumn("state", F.explode(F.sequence(F.lit(0), s - 1))).withColumn("g", F.explode(F.sequence(F.lit(0), g - 1)))
    at = base + F.col("state") * per_state + F.col("g") * (1 + 2 * d)
    numbers = lambda first, n: F.transform(F.slice("tokens", first + 1, n), lambda x: x.try_cast("double"))
    comps = cells.select("file", "model", "state", "g", F.get("tokens", at).try_cast("double").alias("alpha"), numbers(at + 1, d).alias("mean"), numbers(at + 1 + d, d).alias("var"))
    pairs = rows.withColumn("src", F.explode(F.sequence(F.lit(0), s - 1))).withColumn("dst", F.explode(F.array("src", F.col("src") + 1))).where(F.col("dst") < s)
    cost = F.get("tokens", base + s * per_state + F.col("src") * s + F.col("dst")).try_cast("double")
    return comps, pairs.select("file", "model", "src", "dst", cost.alias("cost"))


def transcripts(lines: DataFrame, column: str = "value", oh: str = "o") -> DataFrame:
    """(digits, file) of lines of spoken digits followed by `(file)`."""
    from ..functions.columns import DIGITS

    words = F.filter(F.split(F.trim(column), r"\s+"), lambda w: w != "")
    names = F.create_map(*[F.lit(x) for k, v in (DIGITS | {"oh": oh}).items() for x in (k, str(v))])
    digits = F.array_join(F.transform(F.filter(words, lambda w: ~w.startswith("(")), lambda w: F.coalesce(F.try_element_at(names, F.lower(w)), w)), "")
    return lines.select(digits.alias("digits"), F.regexp_extract(column, r"\(([^()]*)\)\s*$", 1).alias("file"))


def write_table(df: DataFrame, path: str, by: str = "model") -> None:
    """Models as Parquet, one folder a model, so that a reader of few models opens few files."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def write_text(models: DataFrame, path: str) -> None:
    """(model, state, mean, ...) as text, one folder a model and column, one state a line in order
    of state: what hmm_text() and numeric text readers take apart."""
    for c in [c for c in models.columns if c not in ("model", "state")]:
        values = F.col(c) if dict(models.dtypes)[c].startswith("array") else F.array(c)
        lines = models.groupBy("model").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("state", values.alias("v")))), lambda s: F.array_join(F.transform(s["v"], lambda x: x.cast("string")), " ")), "\n").alias("value"))
        lines.withColumn("kind", F.lit(c)).write.mode("append").partitionBy("kind", "model").text(path)


def _lines(values: F.Column, order: str) -> F.Column:
    """A group's arrays of numbers as text, one a line in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), values.alias("v")))), lambda s: F.array_join(F.transform(s["v"], lambda x: x.cast("string")), " ")), "\n")


def write_hmm_text(models: DataFrame, path: str) -> None:
    """(model, state, mean, var, stay, next) as the four files a model that hmm_text() reads."""
    for kind, values in {"mean": F.col("mean"), "var": F.col("var"), "self_trans": F.array("stay"), "trans_p": F.array("next")}.items():
        named.save(models.groupBy("model").agg(_lines(values, "state").alias("value")).select(F.concat(F.col("model").cast("string"), F.lit(f"hmm_{kind}.txt")).alias("name"), "value"), path)


def write_skip_text(models: DataFrame, path: str) -> None:
    """(model, row, mean, var, stay, next, skip) as the three files a model that skip_text() reads; an entry
    row has transition costs alone."""
    for kind, values in {"mean": F.col("mean"), "vari": F.col("var"), "tran": F.array("stay", "next", "skip")}.items():
        rows = models if kind == "tran" else models.where("mean is not null")
        named.save(rows.groupBy("model").agg(_lines(values, "row").alias("value")).select(F.concat(F.lit(kind), F.col("model").cast("string"), F.lit(".txt")).alias("name"), "value"), path)


def write_dat(components: DataFrame, transitions: DataFrame, path: str, name: str = "model.dat") -> None:
    """(model, state, g, alpha, mean, var) and (model, src, dst, cost) as one file that dat() reads; models
    and states count from 0. Costs that are not given are 0, as off the chain."""
    parts = F.concat(F.array("alpha"), "mean", "var")
    packed = one_row(components)
    size = packed.agg((F.max("model") + 1).alias("m"), (F.max("state") + 1).alias("s"), (F.max("g") + 1).alias("g"), F.max(F.size("mean")).alias("d"))
    states = packed.groupBy("model").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("state", "g", parts.alias("v")))), lambda x: x["v"])).alias("states"))
    every = size.select(F.explode(F.sequence(F.lit(0), F.col("m").cast("int") - 1)).alias("model"), "s")
    every = every.select("model", F.explode(F.sequence(F.lit(0), F.col("s").cast("int") - 1)).alias("src"), "s").select("model", "src", F.explode(F.sequence(F.lit(0), F.col("s").cast("int") - 1)).alias("dst"))
    costs = every.join(transitions.select("model", "src", "dst", "cost"), ["model", "src", "dst"], "left").groupBy("model").agg(F.transform(F.array_sort(F.collect_list(F.struct("src", "dst", F.coalesce("cost", F.lit(0.0)).alias("c")))), lambda x: x["c"]).alias("costs"))
    whole = states.join(costs, "model").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("model", F.concat("states", "costs").alias("v")))), lambda x: x["v"])).alias("v"))
    text = F.concat(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("m", "s", "g", "d")]), F.lit("\n"), F.array_join(F.transform("v", lambda x: x.cast("string")), " "))
    named.save(whole.crossJoin(size).select(F.lit(name).alias("name"), text.alias("value")), path)  # one row with one row


def random_labels(spark: SparkSession, n: int, length: int, seed: int = 100, first_from: int = 0) -> DataFrame:
    """(idx, digits): n reproducible digit strings; the first digit is at least first_from."""
    digit = lambda k, low: (F.pmod(F.xxhash64("id", F.lit(k), F.lit(seed)), F.lit(10 - low)) + low).cast("string")
    return spark.range(n).select(F.col("id").cast("int").alias("idx"), F.concat(*[digit(k, first_from if k == 0 else 0) for k in range(length)]).alias("digits"))
