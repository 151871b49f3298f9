"""Diagonal Gaussians and mixtures: fitting, scoring, clustering and EM as aggregations.

Frames are rows with a label and a vector; models are small tables (models x states x components),
whose size does not follow the data, and are broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import gaussian_cost
from ..session import one_row, small, stored


def fit(frames: DataFrame, by: list[str], vec: str = "vec") -> DataFrame:
    """(by..., n, mean array, var array): means and population variances by group.

    Dimensions are aggregated one by one, so partial sums combine before the shuffle.
    """
    d = frames.select(*by, F.posexplode(vec).alias("d", "x"))
    stats = d.groupBy(*by, "d").agg(F.avg("x").alias("m"), F.var_pop("x").alias("s"), F.count("*").alias("n"))
    s = F.array_sort(F.collect_list(F.struct("d", "m", "s")))
    return stats.groupBy(*by).agg(F.max("n").alias("n"), s.alias("a")).select(*by, "n", F.transform("a", lambda x: x["m"]).alias("mean"), F.transform("a", lambda x: x["s"]).alias("var"))


def scores(frames: DataFrame, models: DataFrame, model: str = "model", vec: str = "vec", name: str = "scores") -> DataFrame:
    """frames with an array of (model, cost), in order of model: every model is scored in the row
    itself. The models come as one array, broadcast, of session.MOST_BROADCAST models at most."""
    packed = one_row(models.select(model, "mean", "var")).agg(F.array_sort(F.collect_list(F.struct(model, "mean", "var"))).alias("_models"))
    cost = lambda m: F.struct(m[model].alias(model), gaussian_cost(F.col(vec), m["mean"], m["var"]).alias("cost"))
    return frames.crossJoin(F.broadcast(packed)).withColumn(name, F.transform("_models", cost)).drop("_models")  # with one row


def score(frames: DataFrame, models: DataFrame, model: str = "model", vec: str = "vec") -> DataFrame:
    """frames with every model and its cost, a row each: scores() taken apart, for few models."""
    return scores(frames, models, model, vec, "_s").withColumn("_s", F.explode("_s")).select("*", f"_s.{model}", "_s.cost").drop("_s")


def classify(frames: DataFrame, models: DataFrame, keys: list[str], model: str = "model", vec: str = "vec", digits: int | None = None) -> DataFrame:
    """keys with the cheapest model; ties go to the first. See scores()."""
    keep = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    rows = scores(frames, models, model, vec, "_s")
    best = F.array_min(F.transform("_s", lambda x: F.struct(keep(x["cost"]).alias("cost"), x[model].alias("model"))))
    return rows.withColumn("_best", best).select(*keys, F.col("_best.model").alias("predicted"), F.col("_best.cost").alias("cost"))


def split(components: DataFrame, epsilon: float = 0.01) -> DataFrame:
    """Each component (…, g, alpha, mean, var) as two: means moved apart, variances copied, weights
    halved."""
    two = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(1 + s * epsilon).alias("k")) for j, s in ((0, 1), (1, -1))]))
    rows = components.withColumn("_s", two)
    return rows.withColumns({"g": F.col("g") * 2 + F.col("_s.j"), "alpha": F.col("alpha") / 2, "mean": F.transform("mean", lambda m: m * F.col("_s.k"))}).drop("_s")


def _packed(components: DataFrame, by: list[str]) -> DataFrame:
    return components.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("g", "alpha", "mean", "var"))).alias("_c"))


def assign(frames: DataFrame, components: DataFrame, by: list[str], vec: str = "vec", cost_name: str | None = None) -> DataFrame:
    """frames with g: the component of least Gaussian cost less log weight; ties go to the first.
    cost_name: a column for that cost, if wanted."""
    rows = frames.join(small(_packed(components, by)), by)
    live = F.filter("_c", lambda c: c["alpha"] > 0)
    cost = F.transform(live, lambda c: F.struct((gaussian_cost(F.col(vec), c["mean"], c["var"]) - F.ln(c["alpha"])).alias("cost"), c["g"].alias("g")))
    rows = rows.withColumn("_best", F.array_min(cost)).withColumn("g", F.col("_best.g"))
    if cost_name:
        rows = rows.withColumn(cost_name, F.col("_best.cost"))
    return rows.drop("_c", "_best")


def refit(assigned: DataFrame, by: list[str], vec: str = "vec") -> DataFrame:
    """Components from assigned frames: weight is a cluster's share of its group."""
    got = fit(assigned, [*by, "g"], vec)
    return got.withColumn("alpha", F.col("n") / F.sum("n").over(W.partitionBy(*by))).select(*by, "g", "alpha", "mean", "var")


def hard_cluster(frames: DataFrame, components: DataFrame, by: list[str], vec: str = "vec", rounds: int = 20) -> DataFrame:
    """Assigns and refits until no frame changes its component (seen by counts and costs)."""
    before = None
    for _ in range(rounds):
        got = assign(frames, components, by, vec)
        components = stored(refit(got, by, vec))
        now = {tuple(r) for r in components.select(*by, "g", F.round("alpha", 12), F.round(F.col("mean")[0], 9)).collect()}
        if now == before:
            break
        before = now
    return components


def repaired(assigned: DataFrame, components: DataFrame, by: list[str], key: str, vec: str = "vec") -> DataFrame:
    """assigned (by, key, vec, g) in which no component starves: one that holds a frame at most takes
    the two that cost least in it, ties by key, from components of more than three frames.

    A round serves one starved component of each group, the lowest; a group whose frames are too few
    to share stays as it is. key must tell a group's frames apart.
    """
    for _ in range(int(components.agg(F.max("g")).first()[0] or 0) + 1):
        held = assigned.groupBy(*by, "g").agg(F.count("*").alias("n"))
        sizes = stored(components.select(*by, "g").join(held, [*by, "g"], "left").select(*by, "g", F.coalesce("n", F.lit(0)).alias("n")))
        rich = sizes.where("n > 3").select(*by, "g")
        poor = sizes.where("n <= 1").groupBy(*by).agg(F.min("g").alias("g")).join(rich.select(*by).distinct(), by, "left_semi")
        poor = stored(poor.join(components, [*by, "g"]).select(*by, F.col("g").alias("_to"), "mean", "var"))
        if poor.isEmpty():
            break
        pool = assigned.join(small(rich), [*by, "g"]).join(small(poor), by)
        place = F.row_number().over(W.partitionBy(*by).orderBy(gaussian_cost(F.col(vec), F.col("mean"), F.col("var")), key))
        taken = pool.withColumn("_place", place).where("_place <= 2").select(*by, key, "_to")
        assigned = stored(assigned.join(small(taken), [*by, key], "left").withColumn("g", F.coalesce("_to", "g")).drop("_to"))
    return assigned


def clustered_components(frames: DataFrame, by: list[str], key: str, k: int, vec: str = "vec", epsilon: float = 100.0, rounds: int = 20, least_var: float = 1e-6) -> DataFrame:
    """k components a group by k-means under Gaussian costs, without weights, with starved ones
    repaired in every round, until the summed cost moves by less than epsilon: a start for em().
    Variances are least_var at least."""
    frames = stored(frames.select(*by, key, vec))
    components, before = initial_components(frames, by, k, vec), math.inf
    for _ in range(rounds):
        got = stored(assign(frames, components.withColumn("alpha", F.lit(1.0)), by, vec, "_cost"))
        cost = got.agg(F.sum("_cost")).first()[0] or 0.0
        got = repaired(got.drop("_cost"), components, by, key, vec)
        components = stored(refit(got, by, vec).withColumn("var", F.transform("var", lambda v: F.greatest(v, F.lit(least_var)))))
        if abs(before - cost) < epsilon:
            break
        before = cost
    return components


def posterior(frames: DataFrame, components: DataFrame, by: list[str], vec: str = "vec", floor: float = 1e-30, least: float = 0.001) -> DataFrame:
    """frames with gamma, an array of (g, p): each component's posterior. One of `floor` or less
    becomes `least`; the sum is not normalised again."""
    rows = frames.join(small(_packed(components, by)), by)
    logs = F.transform("_c", lambda c: F.ln(c["alpha"]) - gaussian_cost(F.col(vec), c["mean"], c["var"]))
    rows = rows.withColumn("_l", logs).withColumn("_top", F.array_max("_l"))
    rows = rows.withColumn("_lse", F.col("_top") + F.ln(F.aggregate("_l", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("_top")))))
    p = F.transform("_c", lambda c, i: F.struct(c["g"].alias("g"), F.exp(F.get("_l", i) - F.col("_lse")).alias("p")))
    p = F.transform(p, lambda x: F.struct(x["g"].alias("g"), F.when(x["p"] <= floor, least).otherwise(x["p"]).alias("p")))
    return rows.withColumn("gamma", p).drop("_c", "_l", "_top").withColumnRenamed("_lse", "log_likelihood")


def em_update(with_gamma: DataFrame, by: list[str], vec: str = "vec") -> DataFrame:
    """Components from posteriors: weights, weighted means and variances.

    One pass: a batch's frames go into matrix sums by group, around the batch's own means, and the few
    partial moments are merged by component and dimension. A frame without a vector, or with a null
    in it, takes no part.
    """
    kinds = dict(with_gamma.dtypes)
    keys = ", ".join(f"`{k}` {kinds[k]}" for k in by)
    gammas = with_gamma.select(*by, F.transform("gamma", lambda c: c["g"].cast("int")).alias("_g"), F.transform("gamma", lambda c: c["p"]).alias("_p"), F.col(vec).cast("array<double>").alias("_x"))
    gammas = gammas.where(F.col("_p").isNotNull() & F.col("_x").isNotNull() & ~F.exists("_x", lambda x: x.isNull()))

    def run(batches):
        at = len(by)
        for b in batches:
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(b.column(k).to_pylist() for k in range(at)), (tuple(g) for g in b.column(at).to_pylist()))):
                groups.setdefault(key, []).append(i)
            out = []
            for (*_, gs), rows in groups.items():
                take = pa.array(rows)
                p = b.column(at + 1).take(take).flatten().to_numpy().reshape(len(rows), -1)
                x = b.column(at + 2).take(take).flatten().to_numpy().reshape(len(rows), -1)
                w = p.sum(0)
                mean = (p.T @ x) / np.where(w > 0, w, 1)[:, None]
                for j, g in enumerate(gs):
                    out.append((rows[0], g, float(len(rows)), w[j], mean[j], p[:, j] @ (x - mean[j]) ** 2))
            first, g, n, w, mean, square = list(zip(*out)) or [[]] * 6
            where, doubles = pa.array(first, pa.int64()), pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(where) for k in range(at)), pa.array(g, pa.int32()), pa.array(n, pa.float64()), pa.array(w, pa.float64()), pa.array(list(mean), doubles), pa.array(list(square), doubles)], [*by, "g", "n", "w", "mean", "square"])

    part = stored(gammas.mapInArrow(run, f"{keys}, g int, n double, w double, mean array<double>, square array<double>"))
    part = part.select(*by, "g", "n", "w", F.posexplode(F.arrays_zip("mean", "square")).alias("d", "z")).select(*by, "g", "n", "w", "d", "z.*")
    m = part.groupBy(*by, "g", "d").agg((F.sum(F.col("w") * F.col("mean")) / F.sum("w")).alias("m"))
    both = part.join(small(m), [*by, "g", "d"])
    apart = F.col("mean") - F.col("m")
    var = both.groupBy(*by, "g", "d").agg(F.max("m").alias("m"), (F.sum(F.col("square") + F.col("w") * apart * apart) / F.sum("w")).alias("s"), (F.sum("w") / F.sum("n")).alias("alpha"))
    got = var.groupBy(*by, "g").agg(F.max("alpha").alias("alpha"), F.array_sort(F.collect_list(F.struct("d", "m", "s"))).alias("a"))
    return got.select(*by, "g", "alpha", F.transform("a", lambda x: x["m"]).alias("mean"), F.transform("a", lambda x: x["s"]).alias("var"))


def em(frames: DataFrame, components: DataFrame, by: list[str], vec: str = "vec", epsilon: float = 100.0, rounds: int = 50) -> DataFrame:
    """EM until the total cost moves by less than epsilon."""
    before = math.inf
    for _ in range(rounds):
        got = posterior(frames, components, by, vec)
        cost = -(got.agg(F.sum("log_likelihood")).first()[0] or 0.0)
        components = stored(em_update(got, by, vec))
        if abs(before - cost) < epsilon:
            break
        before = cost
    return components


def initial_components(frames: DataFrame, by: list[str], k: int, vec: str = "vec") -> DataFrame:
    """k components a group from the group's Gaussian, its means spread by one deviation; a start
    that needs no draw, and in which none starves."""
    one = fit(frames, by, vec)
    place = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    rows = one.withColumn("g", place)
    step = (F.col("g") - (k - 1) / 2) * (2 / max(1, k))
    return rows.select(*by, "g", F.lit(1.0 / k).alias("alpha"), F.zip_with("mean", "var", lambda m, v: m + step * F.sqrt(v)).alias("mean"), "var")


def accuracy(right: Column) -> Column:
    return F.avg(right.cast("int"))
