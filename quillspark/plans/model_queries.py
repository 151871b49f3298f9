"""Queries of Gaussian models, mixtures, trellises and training steps.

Classes are the labels of `embeddings`; sequences are the values of `events` by user in time.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import tables
from ..operators import blocks, decoding, gauss, relational, signal, training, trellis
from ..session import small, table
from .signal_queries import _SIG, wave

STATES = 5
STAY, MOVE, SKIP = [0.2] * 5, [0.7] * 5, [1.9] * 5
MODELS = (0, 1, 2)


def _center(model: int, state: int) -> float:
    return 50.0 + 90.0 * state + 25.0 * model


def frames(s, d) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id", F.col("label").alias("model"), F.col("embedding").cast("array<double>").alias("vec"))


def _models(s, d) -> DataFrame:
    return gauss.fit(frames(s, d), ["model"])


def _classified(s, d) -> DataFrame:
    f = frames(s, d)
    return gauss.classify(f, _models(s, d), ["vec_id", F.col("model").alias("label")], digits=4)


def _components(s, d, k=2) -> DataFrame:
    return gauss.initial_components(frames(s, d), ["model"], k)


def _repaired(s, d) -> DataFrame:
    """Two components a class, and a third so far off that no frame is nearest to it."""
    comps = _components(s, d).select("model", "g", F.lit(1.0).alias("alpha"), "mean", "var")
    far = _components(s, d).where("g = 0").select("model", F.lit(2).alias("g"), F.lit(1.0).alias("alpha"), F.zip_with("mean", "var", lambda m, v: m + 100 * F.sqrt(v)).alias("mean"), "var")
    comps = comps.union(far)
    return gauss.repaired(gauss.assign(frames(s, d), comps, ["model"]), comps, ["model"], "vec_id")


def _params(df: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """Means and variances by dimension."""
    return df.select(*keys, F.posexplode(F.arrays_zip("mean", "var")).alias("d", "p")).select(*keys, "d", F.round("p.mean", digits).alias("mean"), F.round("p.var", digits).alias("var"))


def _mixture(s, d) -> DataFrame:
    packed = _components(s, d).groupBy("model").agg(F.array_sort(F.collect_list(F.struct("g", "alpha", "mean", "var"))).alias("components"))
    return frames(s, d).join(small(packed), "model")


_X = "x AS (SELECT vec_id, label AS model, unnest(range(0, len(embedding))) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
_FIT = _X + ", g AS (SELECT model, d, avg(x) AS mean, var_pop(x) AS var, count(*) AS n FROM x GROUP BY model, d)"
_COST = _FIT + ", cost AS (SELECT x.vec_id, x.model AS label, g.model, 0.5 * sum(ln(2 * pi() * g.var) + (x.x - g.mean) * (x.x - g.mean) / g.var) AS c FROM x JOIN g ON x.d = g.d GROUP BY x.vec_id, x.model, g.model)"
_CLASS = _COST + ", best AS (SELECT vec_id, label, arg_min(model, (round(c, 4), model)) AS predicted FROM cost GROUP BY vec_id, label)"
_COMP = _FIT + ", comp AS (SELECT model, d, k AS g, 0.5 AS alpha, mean + (k - 0.5) * sqrt(var) AS mean, var FROM g CROSS JOIN (VALUES (0), (1)) v(k))"
_LOGS = _COMP + ", lg AS (SELECT x.vec_id, x.model, c.g, ln(0.5) - 0.5 * sum(ln(2 * pi() * c.var) + (x.x - c.mean) * (x.x - c.mean) / c.var) AS l FROM x JOIN comp c ON x.d = c.d AND x.model = c.model GROUP BY x.vec_id, x.model, c.g), lse AS (SELECT vec_id, model, max(l) + ln(exp(min(l) - max(l)) + 1) AS z FROM lg GROUP BY vec_id, model)"
_GAMMA = _LOGS + ", gm AS (SELECT lg.vec_id, lg.model, lg.g, CASE WHEN exp(l - z) <= 1e-30 THEN 0.001 ELSE exp(l - z) END AS p FROM lg JOIN lse USING (vec_id, model))"
_ASSIGN = _LOGS + ", asg AS (SELECT vec_id, model, arg_max(g, (l, -g)) AS g FROM lg GROUP BY vec_id, model)"
_EM = _GAMMA + ", em AS (SELECT model, g, d, sum(p * x) / sum(p) AS mean, sum(p) / count(*) AS alpha, sum(p) AS w FROM gm JOIN x USING (vec_id, model) GROUP BY model, g, d), ev AS (SELECT em.model, em.g, em.d, any_value(em.alpha) AS alpha, any_value(em.mean) AS mean, sum(p * (x - em.mean) * (x - em.mean)) / any_value(em.w) AS var FROM gm JOIN x USING (vec_id, model) JOIN em ON em.model = gm.model AND em.g = gm.g AND em.d = x.d GROUP BY em.model, em.g, em.d)"


def _emission(model: int, x) -> F.Column:
    """The costs of one value in each state of a model: variance 10,000."""
    return F.array(*[(math.log(2 * math.pi * 10000.0) + (x - _center(model, k)) * (x - _center(model, k)) / 10000.0) * 0.5 for k in range(STATES)])


def _sequences(s, d, model: int = 0) -> DataFrame:
    return trellis.sequences(wave(s, d), "utt", "i", _emission(model, F.col("x")))


def _aligned(s, d) -> DataFrame:
    return trellis.align(_sequences(s, d), trellis.Graph.chain(STAY, MOVE))


def _path_rows(s, d) -> DataFrame:
    p = _aligned(s, d).select("utt", F.posexplode("path").alias("t", "state"), "path")
    return p.withColumn("enters", (F.col("t") == 0) | (F.get("path", F.col("t") - 1) != F.col("state"))).drop("path")


def _isolated(s, d) -> DataFrame:
    xs = trellis.sequences(wave(s, d), "utt", "i", F.col("x"), "xs")

    def cost(m: int):
        final = F.get(trellis.chain_fold(F.transform("xs", lambda x: _emission(m, x)), STATES, STAY, MOVE), F.lit(STATES - 1))
        return F.struct(F.round(final, 4).alias("cost"), F.lit(m).alias("model"))

    best = F.array_min(F.array(*map(cost, MODELS)))
    return xs.select("utt", best["model"].alias("model"), best["cost"].alias("cost"))


def _fold(s, d, **kw) -> DataFrame:
    got = trellis.chain_fold(F.col("e"), STATES, STAY, MOVE, **kw)
    return _sequences(s, d).select("utt", F.posexplode(got).alias("state", "cost")).where(F.col("cost") < 1e300).select("utt", "state", F.round("cost", 6).alias("cost"))


def _dtw(s, d) -> DataFrame:
    """Squared distances to a template of five values; stay, next and skip cost nothing, and the
    first frame is not scored."""
    t = [_center(0, k) for k in range(STATES)]
    e = trellis.sequences(wave(s, d), "utt", "i", F.array(*[(F.col("x") - v) * (F.col("x") - v) for v in t]))
    got = trellis.chain_fold(F.col("e"), STATES, [0.0] * 5, [0.0] * 5, [0.0] * 5, free_first=True)
    return e.select("utt", F.round(F.get(got, F.lit(STATES - 1)), 4).alias("cost"))


#: Word models of one letter each, for the grammar decoders: state k of word w lies at 60 + 120 w + 40 k.
WORDS = ("1", "2", "3")


LOOP = [(0, 1, w) for w in WORDS] + [(1, 0, None)]
FIXED = [(0, 1, w) for w in WORDS] + [(1, 2, w) for w in WORDS] + [(2, 3, "1"), (2, 3, "2"), (1, 3, None)]


def _decode(s, d, edges, start: int, end: int, penalty: float, beam: float | None = None) -> DataFrame:
    models = {w: training.Model([[(1.0, [60.0 + 120 * i + 40 * k], [2500.0])] for k in range(2)], [0.1, 0.0], [0.3, 0.3]) for i, w in enumerate(WORDS)}
    e = trellis.sequences(wave(s, d), "utt", "i", F.array("x"), "frames")
    got = decoding.as_text(decoding.decode(e, edges, models, start, end, penalty, beam=beam))
    return got.select("utt", F.when(F.col("cost") < 1e300, F.round("cost", 4)).alias("cost"), F.col("result").alias("words"))


def _decode_sql(beam: float | None = None) -> str:
    """FIXED by recursion: p is the place in the sentence, w the word, k its state."""
    e = "0.5 * (ln(2 * pi() * 2500.0) + (x - (60.0 + 120 * (w - 1) + 40 * k)) * (x - (60.0 + 120 * (w - 1) + 40 * k)) / 2500.0)"
    pruned = f" WHERE c <= best + {beam}" if beam is not None else ""
    leaves = f"AND (tr.q = d.p OR d.c + 2.0 <= d.best + {beam})" if beam is not None else ""  # a word's end is a state of its own
    ends = f"AND d.c + 2.0 <= d.best + {beam}" if beam is not None else ""
    return f"""WITH RECURSIVE {_SIG}, len AS (SELECT utt, max(i) AS last FROM sig GROUP BY utt),
      tr(p, w, k, q, v, l, cost) AS (
        SELECT p, w, 0, p, w, 0, 0.1::DOUBLE FROM (VALUES (1), (2), (3)) a(p), (VALUES (1), (2), (3)) b(w)
        UNION ALL SELECT p, w, 1, p, w, 1, 0.0 FROM (VALUES (1), (2), (3)) a(p), (VALUES (1), (2), (3)) b(w)
        UNION ALL SELECT p, w, 0, p, w, 1, 0.3 FROM (VALUES (1), (2), (3)) a(p), (VALUES (1), (2), (3)) b(w)
        UNION ALL SELECT p, w, 1, p + 1, v, 0, 2.0 FROM (VALUES (1), (2)) a(p), (VALUES (1), (2), (3)) b(w), (VALUES (1), (2), (3)) n(v) WHERE p = 1 OR v < 3),
      d(utt, t, p, w, k, c, words, best) AS (
        SELECT utt, t, p, w, k, c, words, best FROM (
          SELECT utt, i AS t, 1 AS p, w, 0 AS k, {e} AS c, CAST(w AS VARCHAR) AS words, min({e}) OVER (PARTITION BY utt) AS best
          FROM sig, (SELECT 0 AS k, unnest([1, 2, 3]) AS w) WHERE i = 0)
        {pruned}
        UNION ALL
        SELECT utt, t, p, w, k, c, words, best FROM (
          SELECT *, min(c) OVER (PARTITION BY utt) AS best FROM (
            SELECT utt, t, p, w, k, c + {e} AS c, words FROM (
              SELECT d.utt, d.t + 1 AS t, tr.q AS p, tr.v AS w, tr.l AS k, min(d.c + tr.cost) AS c, any_value(x) AS x,
                     arg_min(d.words || CASE WHEN tr.q > d.p THEN CAST(tr.v AS VARCHAR) ELSE '' END, d.c + tr.cost) AS words
              FROM d JOIN tr ON tr.p = d.p AND tr.w = d.w AND tr.k = d.k JOIN sig ON sig.utt = d.utt AND sig.i = d.t + 1 {leaves}
              GROUP BY d.utt, d.t, tr.q, tr.v, tr.l)))
        {pruned}),
      f AS (SELECT d.utt, min(c) + 2.0 AS c, arg_min(words, c) AS words FROM d JOIN len ON len.utt = d.utt AND len.last = d.t WHERE k = 1 AND p IN (1, 3) {ends} GROUP BY d.utt)
      SELECT len.utt, round(f.c, 4) AS cost, coalesce(words, '') AS words FROM len LEFT JOIN f ON f.utt = len.utt"""


def _rounds_sql(rounds: int, soft: bool) -> str:
    """Rounds of EM, or of assigning and refitting, one after another from _COMP's start."""
    cost = lambda c: f"0.5 * sum(ln(2 * pi() * {c}.var) + (x.x - {c}.mean) * (x.x - {c}.mean) / {c}.var)"
    out = _COMP + ", c0 AS (SELECT model, d, g, alpha, mean, var FROM comp)"
    for r in range(rounds):
        c = f"c{r}"
        out += f", l{r} AS (SELECT x.vec_id, x.model, {c}.g, ln(any_value({c}.alpha)) - {cost(c)} AS l FROM x JOIN {c} ON x.d = {c}.d AND x.model = {c}.model GROUP BY x.vec_id, x.model, {c}.g)"
        if soft:
            out += f", z{r} AS (SELECT vec_id, model, max(l) + ln(exp(min(l) - max(l)) + 1) AS z FROM l{r} GROUP BY vec_id, model), p{r} AS (SELECT l.vec_id, l.model, l.g, CASE WHEN exp(l - z) <= 1e-30 THEN 0.001 ELSE exp(l - z) END AS p FROM l{r} l JOIN z{r} USING (vec_id, model))"
        else:
            out += f", p{r} AS (SELECT vec_id, model, arg_max(g, (l, -g)) AS g, 1.0::DOUBLE AS p FROM l{r} GROUP BY vec_id, model)"
        out += f", n{r} AS (SELECT model, g, sum(p) AS w FROM p{r} GROUP BY model, g), k{r} AS (SELECT model, count(DISTINCT vec_id) AS n FROM p{r} GROUP BY model)"
        out += f", m{r} AS (SELECT p.model, p.g, x.d, sum(p * x.x) / sum(p) AS mean FROM p{r} p JOIN x USING (vec_id, model) GROUP BY p.model, p.g, x.d)"
        out += f", c{r + 1} AS (SELECT p.model, x.d, p.g, any_value(n.w / k.n) AS alpha, any_value(m.mean) AS mean, sum(p * (x.x - m.mean) * (x.x - m.mean)) / sum(p) AS var FROM p{r} p JOIN x USING (vec_id, model) JOIN m{r} m ON m.model = p.model AND m.g = p.g AND m.d = x.d JOIN n{r} n ON n.model = p.model AND n.g = p.g JOIN k{r} k ON k.model = p.model GROUP BY p.model, p.g, x.d)"
    return f"WITH {out} SELECT model, g, CAST(d AS INTEGER) AS d, round(mean, 4) AS mean, round(var, 4) AS var FROM c{rounds}"


_LOOP_SQL = """WITH RECURSIVE %s, len AS (SELECT utt, max(i) AS last FROM sig GROUP BY utt), ws AS (SELECT unnest([1, 2, 3]) AS w),
      tr(w, k, v, l, cost) AS (SELECT w, 0, w, 0, 0.1::DOUBLE FROM ws UNION ALL SELECT w, 0, w, 1, 0.3 FROM ws UNION ALL SELECT w, 1, w, 1, 0.0 FROM ws
        UNION ALL SELECT w, 1, 0, 2, 2.0 FROM ws UNION ALL SELECT 0, 2, w, 0, 0.0 FROM ws),
      d(utt, t, w, k, c, words) AS (
        SELECT utt, i, w, 0, 0.5 * (ln(2 * pi() * 2500.0) + (x - (60.0 + 120 * (w - 1))) * (x - (60.0 + 120 * (w - 1))) / 2500.0), CAST(w AS VARCHAR) FROM sig, ws WHERE i = 0
        UNION ALL
        SELECT d.utt, d.t + 1, tr.v, tr.l, min(d.c + tr.cost) + CASE WHEN tr.l = 2 THEN 0.0 ELSE any_value(0.5 * (ln(2 * pi() * 2500.0) + (x - (60.0 + 120 * (tr.v - 1) + 40 * tr.l)) * (x - (60.0 + 120 * (tr.v - 1) + 40 * tr.l)) / 2500.0)) END,
               arg_min(d.words || CASE WHEN tr.k = 2 THEN CAST(tr.v AS VARCHAR) ELSE '' END, d.c + tr.cost)
        FROM d JOIN tr ON tr.w = d.w AND tr.k = d.k JOIN sig ON sig.utt = d.utt AND sig.i = d.t + 1 GROUP BY d.utt, d.t, tr.v, tr.l),
      f AS (SELECT d.utt, min(c) + 2.0 AS c, arg_min(words, c) AS words FROM d JOIN len ON len.utt = d.utt AND len.last = d.t WHERE k = 1 GROUP BY d.utt)
      SELECT len.utt, round(f.c, 4) AS cost, coalesce(words, '') AS words FROM len LEFT JOIN f ON f.utt = len.utt""" % _SIG  # k = 2: between words, a frame that no word scores


def _training_sql(rounds: int, chain: list[int], leave: dict[int, float], shares: bool, start: str | None = None, greedy: bool = False) -> str:
    """Rounds of aligning and refitting, one after another, of a chain whose states have the parameter
    sets of `chain`; leave: what leaving a state costs besides. f<k> has round k's paths and costs, al<k>
    its alignment, q<k> the models made of it; start: q0, else made of frames shared out evenly. greedy: states
    are left without a look ahead."""
    n = len(chain)
    st = ", ".join(f"({s}, {g}, {leave.get(s, 0.0)}::DOUBLE)" for s, g in enumerate(chain))
    at = f"i * {n} // n" if shares else f"(i + 1) * {n} // n - CASE WHEN (i + 1) * {n} % n = 0 THEN 1 ELSE 0 END"
    out = f"""WITH RECURSIVE {_SIG}, st(s, g, pen) AS (VALUES {st}), len AS (SELECT utt, count(*) AS n FROM sig GROUP BY utt),
      al0 AS MATERIALIZED (SELECT *, coalesce(lag(s) OVER (PARTITION BY utt ORDER BY t) <> s, true) AS enters FROM (SELECT utt, i AS t, x, CAST({at} AS INTEGER) AS s FROM sig JOIN len USING (utt)))"""
    for k in range(1, rounds + 1):
        way = f"""v{k}(utt, t, s, c, path) AS (SELECT utt, CAST(1 AS BIGINT), 0, sum(e), [0, 0] FROM e{k} WHERE t < 2 AND s = 0 GROUP BY utt
        UNION ALL SELECT utt, t, s, c, list_append(path, s) FROM (
          SELECT v.utt, v.t + 1 AS t, v.path, v.s + CASE WHEN a.e + st.cost > b.e + go.cost THEN 1 ELSE 0 END AS s, v.c + least(a.e + st.cost, coalesce(b.e + go.cost, 1e308)) AS c
          FROM v{k} v JOIN e{k} a ON a.utt = v.utt AND a.t = v.t + 1 AND a.s = v.s JOIN tr{k} st ON st.a = v.s AND st.b = v.s
          LEFT JOIN e{k} b ON b.utt = v.utt AND b.t = v.t + 1 AND b.s = v.s + 1 LEFT JOIN tr{k} go ON go.a = v.s AND go.b = v.s + 1)),
      f{k} AS MATERIALIZED (SELECT v.utt, c, path FROM v{k} v JOIN len ON v.utt = len.utt AND v.t = len.n - 1),""" if greedy else f"""v{k}(utt, t, s, c, path) AS (SELECT utt, t, 0, e, [0] FROM e{k} WHERE t = 0 AND s = 0
        UNION ALL SELECT v.utt, v.t + 1, tr.b, min(v.c + tr.cost) + any_value(em.e), arg_min(list_append(v.path, tr.b), (v.c + tr.cost, tr.a))
          FROM v{k} v JOIN tr{k} tr ON tr.a = v.s JOIN e{k} em ON em.utt = v.utt AND em.t = v.t + 1 AND em.s = tr.b GROUP BY v.utt, v.t, tr.b),
      f{k} AS MATERIALIZED (SELECT v.utt, c, path FROM v{k} v JOIN len ON v.utt = len.utt AND v.t = len.n - 1 WHERE s = {n - 1}),"""
        given = f""",
      q0(g, mean, var, stay, move) AS (VALUES {start})""" if start and k == 1 else f""",
      q{k - 1} AS MATERIALIZED (SELECT g, mean, var, CASE WHEN v < n THEN -ln(1 - v / n) ELSE 50.0 END AS stay, -ln(v / n) AS move
        FROM (SELECT g, avg(x) AS mean, greatest(var_pop(x), 1e-6) AS var, count(*) AS n, count(*) FILTER (enters) AS v FROM al{k - 1} JOIN st USING (s) GROUP BY g))"""
        out += f"""{given},
      e{k} AS MATERIALIZED (SELECT utt, i AS t, s, 0.5 * (ln(2 * pi() * var) + (x - mean) * (x - mean) / var) AS e FROM sig, st JOIN q{k - 1} USING (g)),
      tr{k} AS MATERIALIZED (SELECT s AS a, s AS b, stay AS cost FROM st JOIN q{k - 1} USING (g) UNION ALL SELECT s, s + 1, move + pen FROM st JOIN q{k - 1} USING (g) WHERE s < {n - 1}),
      {way}
      al{k} AS MATERIALIZED (SELECT utt, t, x, s, coalesce(lag(s) OVER (PARTITION BY utt ORDER BY t) <> s, true) AS enters
        FROM (SELECT utt, unnest(range(0, len(path))) AS t, unnest(path) AS s FROM f{k}) JOIN sig ON sig.utt = utt AND sig.i = t)""".replace("JOIN sig ON sig.utt = utt AND sig.i = t)", "p JOIN sig USING (utt) WHERE sig.i = p.t)")
    costs = " UNION ALL ".join(f"SELECT {k} AS r, sum(c) AS c, count(*) AS aligned FROM f{k}" for k in range(1, rounds + 1))
    return out + f", costs AS MATERIALIZED ({costs}), utts AS (SELECT count(*) AS n FROM len)"


def _ended_sql(rule: str) -> str:
    """The rounds up to the first that the rule ends."""
    return f", rule AS (SELECT *, {rule} AS done FROM costs WINDOW o AS (ORDER BY r)), shown AS (SELECT * FROM rule WHERE r <= (SELECT coalesce(min(r) FILTER (done), max(r)) FROM rule))"


_SHOWN = " SELECT CAST(r - 1 AS BIGINT) AS round, round(c, 3) AS cost, aligned, utts.n - aligned AS left_out FROM shown, utts"
_FALLS = "coalesce(lag(c) OVER o - c <= 1e-6 * abs(c), false)"


def _two_level_sql(outer: int, rounds: int) -> str:
    """Inner and outer rounds as a walk over one chain of rounds; lengths of any two are compared."""
    lengths = " UNION ALL ".join(f"SELECT {k} AS r, utt, s, count(*) AS n FROM al{k} GROUP BY utt, s" for k in range(1, rounds + 1))
    return _training_sql(rounds, [0, 1, 2, 3, 4], {}, False) + f""", lengths AS MATERIALIZED ({lengths}),
      change AS MATERIALIZED (SELECT a.r AS q, b.r, avg(abs(a.n - b.n)) AS moved FROM lengths a JOIN lengths b ON a.utt = b.utt AND a.s = b.s AND a.r < b.r GROUP BY a.r, b.r),
      walk(r, before, last, inner_round, outer_round) AS (SELECT 1, NULL::DOUBLE, NULL::INTEGER, 1, 1
        UNION ALL SELECT r + 1, CASE WHEN ends THEN NULL ELSE c END, CASE WHEN ends THEN r ELSE last END, CASE WHEN ends THEN 1 ELSE inner_round + 1 END, outer_round + CASE WHEN ends THEN 1 ELSE 0 END
          FROM (SELECT walk.*, costs.c, coalesce(abs(before - costs.c) <= 5.0, false) OR inner_round = 10 AS ends, coalesce(moved <= 2.0, false) AS settled
                FROM walk JOIN costs ON costs.r = walk.r LEFT JOIN change ON change.q = walk.last AND change.r = walk.r)
          WHERE NOT (ends AND (settled OR outer_round = {outer})) AND r < {rounds}),
      shown AS (SELECT costs.* FROM costs JOIN walk ON walk.r = costs.r)""" + _SHOWN


def _mixture_sql(doublings: int = 2, rounds: int = 10) -> str:
    """Single Gaussians until their cost stops falling, by recursion; then for each doubling and each of its
    rounds the components of the states, assigned and refitted until none changes, and the cost of aligning with
    them. q is the models as a list by state, of which each sequence's path keeps where a state starts; a state's
    frames are its values with their number."""
    kind = "STRUCT(mix STRUCT(g INTEGER, n HUGEINT, alpha DOUBLE, mean DOUBLE, var DOUBLE)[], stay DOUBLE, move DOUBLE)[]"
    logs = lambda s: f"list_transform(q[{s}].mix, lambda z: ln(z.alpha) - 0.5 * (ln(2 * pi() * z.var) + (x - z.mean) * (x - z.mean) / z.var))"
    cost = lambda s: f"list_transform([{logs(s)}], lambda l: -(list_max(l) + ln(list_sum(list_transform(l, lambda y: exp(y - list_max(l)))))))[1]"
    stays, moves = (lambda s: f"a.c[{s}] + q[{s}].stay"), (lambda s: f"a.c[{s - 1}] + q[{s - 1}].move")
    each = range(1, STATES + 1)
    first = f"CASE WHEN i = 1 THEN [{', '.join('f[1]' if s == 1 else chr(39) + 'inf' + chr(39) + '::DOUBLE' for s in each)}] ELSE []::DOUBLE[] END"
    frame = f"list_transform(list_transform(xs, lambda x: [{', '.join(map(cost, each))}]), lambda f, i: {{'t': i - 1, 'e': f, 'c': {first}, 'b': [{', '.join('[0::BIGINT]' if s == 1 else '[]::BIGINT[]' for s in each)}]}})"
    step = ", ".join(f"least({stays(s)}, {moves(s)}) + f.e[{s}]" if s > 1 else f"{stays(s)} + f.e[{s}]" for s in each)
    begun = ", ".join(f"CASE WHEN {moves(s)} <= {stays(s)} THEN list_append(a.b[{s - 1}], f.t) ELSE a.b[{s}] END" if s > 1 else "a.b[1]" for s in each)
    way = f"list_reduce({frame}, lambda a, f: {{'t': f.t, 'e': f.e, 'c': [{step}], 'b': [{begun}]}})"
    paths = lambda source: f"(SELECT w.* EXCLUDE (p), p.c[{STATES}] AS c, p.b[{STATES}] AS b FROM (SELECT src.*, utt, xs, {way} AS p FROM seq, {source} src) w WHERE p.c[{STATES}] < 'inf'::DOUBLE)"
    held = "xs[b[s + 1] + 1 : coalesce(b[s + 2], len(xs))]"  # of state s
    going = "CASE WHEN v < n THEN -ln(1 - v / n) ELSE 50.0 END AS stay, -ln(v / n) AS move"
    single = "list({'mix': [{'g': 0, 'n': n::HUGEINT, 'alpha': 1.0::DOUBLE, 'mean': mean, 'var': var}], 'stay': stay, 'move': move} ORDER BY s)"
    fit = "avg(x) AS mean, greatest(var_pop(x), 1e-6) AS var, count(*) AS n"
    out = f"""WITH RECURSIVE {_SIG}, st AS (SELECT CAST(unnest(range(0, {STATES})) AS INTEGER) AS s),
      seq AS MATERIALIZED (SELECT utt, list(x ORDER BY i) AS xs FROM sig GROUP BY utt),
      al0 AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY utt ORDER BY t) <> s, true) AS enters
        FROM (SELECT utt, i AS t, x, CAST((i + 1) * {STATES} // len(xs) - CASE WHEN (i + 1) * {STATES} % len(xs) = 0 THEN 1 ELSE 0 END AS INTEGER) AS s FROM sig JOIN seq USING (utt))),
      one(r, c, aligned, used, q, done) AS (
        SELECT 0, NULL::DOUBLE, 0::BIGINT, NULL::{kind}, {single}::{kind}, false FROM (SELECT s, mean, var, n, {going} FROM (SELECT s, {fit}, count(*) FILTER (enters) AS v FROM al0 GROUP BY s))
        UNION ALL
        SELECT r + 1, c, v, used, q::{kind}, coalesce(before - c <= 1e-6 * abs(c), false) FROM (
          SELECT any_value(r) AS r, any_value(before) AS before, sum(c) AS c, CAST(any_value(v) AS BIGINT) AS v, any_value(used) AS used, {single} AS q FROM (
            SELECT *, {going} FROM (
              SELECT s, any_value(r) AS r, any_value(before) AS before, sum(c) AS c, any_value(used) AS used, {fit}, any_value(v) AS v FROM (
                SELECT r, before, used, s, v, unnest({held}) AS x, unnest(list_transform({held}, lambda y, j: CASE WHEN s = 0 AND j = 1 THEN c END)) AS c
                FROM (SELECT *, count(*) OVER () AS v FROM {paths('(SELECT r, c AS before, q AS used, q FROM one WHERE NOT done)')}), st)
              GROUP BY s))
          HAVING count(*) > 0)),
      ended AS MATERIALIZED (SELECT * FROM one WHERE r = (SELECT max(r) FROM one)), utts AS (SELECT count(*) AS n FROM seq),
      q0 AS MATERIALIZED (SELECT used AS q FROM ended)"""
    same = "n = old.n AND abs(mean - old.mean) <= 1e-9 * (abs(old.mean) + sqrt(old.var))"
    for k in range(1, doublings * rounds + 1):
        start = f"(SELECT q FROM {'ended' if k == 1 else f'q{k - 1}'})"
        mix = "list_transform(q, lambda s: list_transform(s.mix, lambda z: {'g': z.g, 'n': -1::HUGEINT, 'alpha': z.alpha, 'mean': z.mean, 'var': z.var}))"
        if (k - 1) % rounds == 0:
            half = lambda j, by: f"{{'g': 2 * z.g + {j}, 'n': -1::HUGEINT, 'alpha': z.alpha / 2, 'mean': z.mean * {by}::DOUBLE, 'var': z.var}}"
            mix = f"list_transform(q, lambda s: flatten(list_transform(s.mix, lambda z: [{half(0, 1.01)}, {half(1, 0.99)}])))"
        comps = "STRUCT(g INTEGER, n HUGEINT, alpha DOUBLE, mean DOUBLE, var DOUBLE)[][]"
        out += f""",
      p{k} AS MATERIALIZED (SELECT utt, xs, c, b FROM {paths(f'q{k - 1}')}),
      f{k} AS MATERIALIZED (SELECT sum(c) AS c, count(*) AS aligned FROM p{k}),
      h{k} AS MATERIALIZED (SELECT s, x, count(*) AS n FROM (SELECT s, unnest({held}) AS x FROM p{k}, st) GROUP BY s, x),
      w{k}(i, m, done) AS (SELECT 0, {mix}::{comps}, false FROM {start}
        UNION ALL SELECT i + 1, m::{comps}, done FROM (
          SELECT any_value(i) AS i, list(m ORDER BY s) AS m, bool_and(done) AS done FROM (
            SELECT any_value(i) AS i, s, list({{'g': old.g, 'n': n::HUGEINT, 'alpha': n / t, 'mean': mean, 'var': greatest(var, 1e-6)}} ORDER BY old.g) AS m, bool_and({same}) AS done FROM (
              SELECT *, sum(n) OVER (PARTITION BY s) AS t, old.mean + away AS mean, square - away * away AS var FROM (
                SELECT any_value(i) AS i, s, any_value(old) AS old, sum(n) AS n, sum(n * (x - old.mean)) / sum(n) AS away, sum(n * (x - old.mean) * (x - old.mean)) / sum(n) AS square FROM (
                  SELECT i, s, x, n, z[list_position(l, list_min(l))] AS old FROM (
                    SELECT i, s, x, n, m[s + 1] AS z, list_transform(m[s + 1], lambda z: 0.5 * (ln(2 * pi() * z.var) + (x - z.mean) * (x - z.mean) / z.var) - ln(z.alpha)) AS l FROM w{k}, h{k} WHERE NOT done))
                GROUP BY s, old.g))
            GROUP BY s)
          HAVING count(*) > 0)),
      q{k} AS MATERIALIZED (SELECT list({{'mix': m[s + 1], 'stay': stay, 'move': move}} ORDER BY s)::{kind} AS q
        FROM (SELECT s, m, {going} FROM (SELECT s, sum(n) AS n, (SELECT aligned FROM f{k}) AS v FROM h{k} GROUP BY s), (SELECT m FROM w{k} ORDER BY i DESC LIMIT 1)))"""
    last = doublings * rounds
    out += f""",
      f{last + 1} AS MATERIALIZED (SELECT sum(c) AS c, count(*) AS aligned FROM {paths(f'q{last}')})
      SELECT CAST(r - 1 AS BIGINT) AS round, round(c, 3) AS cost, aligned, utts.n - aligned AS left_out FROM one, utts WHERE r > 0"""
    for k in range(1, last + 1):
        out += f" UNION ALL SELECT CAST(r + {k - 1} AS BIGINT), round(f.c, 3), f.aligned, utts.n - f.aligned FROM f{k + 1} f, ended, utts"
    return out


def _e(x: str, model: str, state: str) -> str:
    return f"0.5 * (ln(2 * pi() * 10000.0) + ({x} - (50.0 + 90.0 * {state} + 25.0 * {model})) * ({x} - (50.0 + 90.0 * {state} + 25.0 * {model})) / 10000.0)"


def _viterbi_sql(models: str = "(VALUES (0))", skip: bool = False, path: bool = False, beam: float | None = None) -> str:
    """A recursion over frames with the least cost by state: costs, and paths where asked for."""
    extra = " UNION ALL SELECT s, s + 2, 1.9::DOUBLE FROM st WHERE s < 3" if skip else ""
    keep = ", arg_min(list_append(v.path, tr.b), (v.c + tr.cost, -tr.a)) AS path" if path else ", CAST([] AS INTEGER[]) AS path"
    first, last = ("SELECT utt, model, t, s, c, path FROM (SELECT *, min(c) OVER (PARTITION BY utt, model) AS best FROM (", f")) WHERE c <= best + {beam}") if beam is not None else ("", "")
    return f"""WITH RECURSIVE {_SIG}, st AS (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS s),
      tr(a, b, cost) AS (SELECT s, s, 0.2::DOUBLE FROM st UNION ALL SELECT s, s + 1, 0.7::DOUBLE FROM st WHERE s < 4{extra}),
      v(utt, model, t, s, c, path) AS (
        SELECT utt, m.model, i, 0, {_e('x', 'm.model', '0')}, [0] FROM sig CROSS JOIN {models} m(model) WHERE i = 0
        UNION ALL
        {first}SELECT utt, model, t, s, c + {_e('x', 'model', 's')} AS c, path FROM (
          SELECT v.utt, v.model, v.t + 1 AS t, tr.b AS s, min(v.c + tr.cost) AS c, any_value(sig.x) AS x{keep}
          FROM v JOIN tr ON tr.a = v.s JOIN sig ON sig.utt = v.utt AND sig.i = v.t + 1 GROUP BY v.utt, v.model, v.t, tr.b){last}),
      len AS (SELECT utt, max(i) AS last FROM sig GROUP BY utt)"""


_FINAL = "FROM v JOIN len ON v.utt = len.utt AND v.t = len.last"
_PATH = _viterbi_sql(path=True) + f", p AS (SELECT v.utt, v.path {_FINAL} WHERE s = 4), pr AS (SELECT utt, unnest(range(0, len(path))) AS t, unnest(path) AS state FROM p), pe AS (SELECT utt, t, state, coalesce(lag(state) OVER (PARTITION BY utt ORDER BY t) <> state, true) AS enters FROM pr)"

def queries() -> dict:
    return {
        "gauss_fit": lambda s, d: _params(_models(s, d), ["model"]),
        "gauss_score": lambda s, d: gauss.score(frames(s, d).withColumnRenamed("model", "label"), _models(s, d)).select("vec_id", "model", F.round("cost", 4).alias("cost")),
        "gauss_classify": lambda s, d: _classified(s, d).select("vec_id", "predicted"),
        "gauss_accuracy": lambda s, d: _classified(s, d).agg(F.count("*").alias("n"), F.sum((F.col("label") == F.col("predicted")).cast("long")).alias("n_right"), F.round(gauss.accuracy(F.col("label") == F.col("predicted")), 6).alias("accuracy")),
        "squared_distance": lambda s, d: frames(s, d).join(small(_models(s, d)), "model").select("vec_id", F.round(C.squared_distance(F.col("vec"), F.col("mean")), 6).alias("distance")),
        "gmm_logsumexp": lambda s, d: _mixture(s, d).select("vec_id", F.round(C.mixture_cost(F.col("vec"), F.col("components")), 4).alias("cost")),
        "gmm_weight_twice": lambda s, d: _mixture(s, d).select("vec_id", F.round(C.mixture_cost(F.col("vec"), F.col("components"), 2), 4).alias("cost")),
        "gmm_split": lambda s, d: _params(gauss.split(_models(s, d).withColumns({"g": F.lit(0), "alpha": F.lit(1.0)})), ["model", "g", "alpha"]),
        "kmeans_assign": lambda s, d: gauss.assign(frames(s, d), _components(s, d), ["model"]).select("vec_id", "g"),
        "cluster_score": lambda s, d: _cluster_score(s, d),
        "kmeans_repair": lambda s, d: _repaired(s, d).select("vec_id", "model", "g"),
        "kmeans_update": lambda s, d: _params(gauss.refit(gauss.assign(frames(s, d), _components(s, d), ["model"]), ["model"]).withColumn("alpha", F.round("alpha", 6)), ["model", "g", "alpha"]),
        "em_posterior": lambda s, d: gauss.posterior(frames(s, d), _components(s, d), ["model"]).select("vec_id", F.explode("gamma").alias("c")).select("vec_id", "c.g", F.round("c.p", 6).alias("p")),
        "em_cost": lambda s, d: gauss.posterior(frames(s, d), _components(s, d), ["model"]).agg(F.round(-F.sum("log_likelihood"), 3).alias("cost")),
        "em_mstep": lambda s, d: _params(gauss.em_update(gauss.posterior(frames(s, d), _components(s, d), ["model"]), ["model"]).withColumn("alpha", F.round("alpha", 6)), ["model", "g", "alpha"], 5),
        "em_fit": lambda s, d: _params(gauss.em(frames(s, d), _components(s, d), ["model"], epsilon=0.0, rounds=3), ["model", "g"], 4),
        "hard_cluster": lambda s, d: _params(gauss.hard_cluster(frames(s, d), _components(s, d), ["model"], rounds=5), ["model", "g"], 4),
        "viterbi_isolated": _isolated,
        "viterbi_costs": lambda s, d: _fold(s, d),
        "viterbi_skip": lambda s, d: _fold(s, d, skip=SKIP),
        "viterbi_beam": lambda s, d: _fold(s, d, beam=3.0),
        "dtw_template": _dtw,
        "forced_align": lambda s, d: _path_rows(s, d).select("utt", F.col("t").cast("long").alias("t"), "state"),
        "word_segments": lambda s, d: trellis.segments(_aligned(s, d), [0, 0, 1, 1, 2]).select("utt", "pos", F.col("start_t").cast("long").alias("start_t"), F.col("end_t").cast("long").alias("end_t")),
        "path_changes": lambda s, d: _path_rows(s, d).where("enters").select("utt", "state", F.col("t").cast("long").alias("t")),
        "occupancy": lambda s, d: training.occupancy(_path_rows(s, d), []),
        "transition_cost": lambda s, d: training.transition_costs(training.occupancy(_path_rows(s, d), [])).select("state", F.round("next", 6).alias("next"), F.round("stay", 6).alias("stay")),
        "segment_change": lambda s, d: training.segment_change(_uniform_lengths(s, d), _path_rows(s, d).groupBy("utt", "state").agg(F.count("*").alias("length")), ["utt", "state"]).select(F.round("change", 6).alias("change")),
        "greedy_segment": lambda s, d: _sequences(s, d).select("utt", trellis.greedy_fold(F.col("e"), STAY, MOVE).alias("g")).select("utt", F.col("g.state").alias("state"), F.round("g.cost", 4).alias("cost")),
        "uniform_segment": lambda s, d: wave(s, d).groupBy("utt").agg(F.count("*").alias("n")).select("utt", F.posexplode(trellis.uniform_starts(F.col("n"))).alias("state", "start")),
        "decode_loop": lambda s, d: _decode(s, d, LOOP, 0, 1, 2.0),
        "decode_fixed": lambda s, d: _decode(s, d, FIXED, 0, 3, 2.0),
        "decode_beam": lambda s, d: _decode(s, d, FIXED, 0, 3, 2.0, beam=6.0),
        "segmental_kmeans": _trained,
        "retraining": _retrained,
        "greedy_training": lambda s, d: _costs(s, training.segmental_k_means(_one_model(s, d), STATES, rounds=4, greedy=True)),
        "two_level_training": lambda s, d: _costs(s, training.two_level(_one_model(s, d), STATES, outer=3)),
        "mixture_training": lambda s, d: _costs(s, training.mixture_schedule(_one_model(s, d), STATES)),
        "continuous_training": lambda s, d: _costs(s, training.continuous_k_means(_one_model(s, d).select("utt", F.array(F.lit("a"), F.lit("b")).alias("label"), "frames"), 2, rounds=4, silence="sil", silence_states=1)),
        "aligned_labels": _aligned_labels,
        "total_path_cost": lambda s, d: _aligned(s, d).where("cost < 1e300").agg(F.round(F.sum("cost"), 2).alias("cost"), F.count("*").alias("n")),
        "score_change": lambda s, d: _score_change(s, d),
        "skip_transition_cost": lambda s, d: _skip_transitions(s, d),
        "frames_in_segments": lambda s, d: _frames_in_segments(s, d),
        "label_models": lambda s, d: _label_models(s, d),
        "block_align": _block_align,
        "block_costs": _block_costs,
        "align_from_sql": _align_sql,
        "framed_from_sql": _framed_sql,
        "state_parameters": lambda s, d: _params(gauss.fit(_path_rows(s, d).join(wave(s, d).select(F.col("utt").alias("u"), "i", F.array("x").alias("vec")), (F.col("utt") == F.col("u")) & (F.col("t") == F.col("i"))), ["state"]), ["state"], 4),
        "path_start": lambda s, d: _aligned(s, d).select("utt", F.get("path", F.lit(0)).alias("first_state"), F.get("path", F.size("path") - 1).alias("last_state")),
    }


def _cluster_score(s, d) -> DataFrame:
    """What each frame costs in each cluster of its model."""
    rows = frames(s, d).join(small(_components(s, d)), "model")
    return rows.select("vec_id", "g", F.round(C.cluster_score(F.col("vec"), F.col("mean"), F.col("var"), F.col("alpha")), 4).alias("score"))


def _score_change(s, d) -> DataFrame:
    """Summed absolute difference between paths' costs without and with skips."""
    a = trellis.align(_sequences(s, d), trellis.Graph.chain(STAY, MOVE)).select("utt", "cost")
    b = trellis.align(_sequences(s, d), trellis.Graph.chain(STAY, MOVE, SKIP)).select("utt", F.col("cost").alias("other"))
    return a.join(b, "utt").where("cost < 1e300 and other < 1e300").agg(F.round(F.sum(F.abs(F.col("cost") - F.col("other"))), 4).alias("change"))


def _skip_transitions(s, d) -> DataFrame:
    """Costs of the states of paths with skips: a state is skipped where a path jumps over it."""
    p = trellis.align(_sequences(s, d), trellis.Graph.chain(STAY, MOVE, SKIP)).select("utt", F.posexplode("path").alias("t", "state"), "path")
    nxt = F.get("path", F.col("t") + 1)
    rows = p.select("state", (F.get("path", F.col("t") - 1) != F.col("state")).alias("enters"), (F.col("t") == 0).alias("first"), (nxt - F.col("state") == 2).alias("jumps"))
    n = rows.groupBy("state").agg(F.count("*").alias("n"), F.count_if(F.col("first") | F.col("enters")).alias("visits"), F.count_if("jumps").alias("skipped"))
    return training.skip_costs(n).select("state", "n", "visits", "skipped", *[F.when(F.col(c) < 1e300, F.round(c, 6)).alias(c) for c in ("next", "stay", "skip")])


def _frames_in_segments(s, d) -> DataFrame:
    """Frames joined with the segment that holds them: here segments are evenly shared frames."""
    n = wave(s, d).groupBy("utt").agg(F.count("*").alias("n"))
    seg = n.select(F.col("utt").alias("u"), "n", F.posexplode(trellis.uniform_starts(F.col("n"))).alias("state", "start")).withColumn("stop", F.floor((F.col("state") + 1) * F.col("n") / STATES))
    return relational.in_ranges(wave(s, d), seg, "i", "start", "stop", 16).where("utt = u").select("utt", "i", "state")


def _long(s, d) -> DataFrame:
    """The values of `events` by type as a few long utterances, a row a frame."""
    rows = signal.sequence_index(table(s, d, "events"), "event_type", ["ts", "event_id"], "ts", "day")
    return rows.select(F.col("event_type").alias("utt"), F.col("i").cast("long").alias("t"), _emission(0, F.col("value").cast("double")).alias("e"))


def _block_align(s, d) -> DataFrame:
    """Paths of long utterances, in blocks and groups so small that the tree has several levels."""
    return blocks.align(_long(s, d), trellis.Graph.chain(STAY, MOVE), block=48, bits=2).paths


def _from_sql(s, d, rows: DataFrame, sql: str) -> DataFrame:
    """A statement over the library's table functions; `rows` stands for the table."""
    tables.register(s)
    name = f"rows_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(name)
    try:
        return s.sql(sql.replace("rows", name))
    finally:
        s.catalog.dropTempView(name)


def _align_sql(s, d) -> DataFrame:
    rows = wave(s, d).select("utt", F.col("i").alias("t"), _emission(0, F.col("x")).alias("e"), "x")
    costs = ", ".join(f"array({', '.join(f'{c}D' for c in xs)})" for xs in (STAY, MOVE))
    return _from_sql(s, d, rows, f"SELECT utt, t, state, round(cost, 4) AS cost FROM align(TABLE(rows) PARTITION BY utt ORDER BY (t), {costs})")


def _framed_sql(s, d) -> DataFrame:
    return _from_sql(s, d, wave(s, d), "SELECT utt, f, j, round(v, 6) AS v FROM framed(TABLE(rows) PARTITION BY utt ORDER BY (i), 16, 6) LATERAL VIEW posexplode(frame) AS j, v")


def _block_costs(s, d) -> DataFrame:
    got = blocks.align(_long(s, d), trellis.Graph.chain(STAY, MOVE, SKIP), block=64)
    return got.costs.select("utt", F.round("cost", 4).alias("cost"))


def _long_sql(skip: bool = False) -> str:
    """Serial recursion over whole utterances, with costs in the same grains, so that sums are exact."""
    g = lambda x: f"(round_even({x} * 1048576.0, 0) / 1048576.0)"
    extra = f" UNION ALL SELECT s, s + 2, {g('1.9::DOUBLE')} FROM st WHERE s < 3" if skip else ""
    return f"""WITH RECURSIVE sig AS (SELECT event_type AS utt, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t, CAST(value AS DOUBLE) AS x FROM events),
      st AS (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS s), tr(a, b, cost) AS (SELECT s, s, {g('0.2::DOUBLE')} FROM st UNION ALL SELECT s, s + 1, {g('0.7::DOUBLE')} FROM st WHERE s < 4{extra}),
      em AS (SELECT utt, t, s, {g(_e('x', '0', 's'))} AS e FROM sig CROSS JOIN st),
      v(utt, t, s, c, came) AS (SELECT utt, t, 0, e, -1 FROM em WHERE t = 0 AND s = 0
        UNION ALL SELECT v.utt, v.t + 1, tr.b, min(v.c + tr.cost) + any_value(em.e), arg_min(tr.a, (v.c + tr.cost, -tr.a))
          FROM v JOIN tr ON tr.a = v.s JOIN em ON em.utt = v.utt AND em.t = v.t + 1 AND em.s = tr.b GROUP BY v.utt, v.t, tr.b),
      len AS (SELECT utt, max(t) AS last FROM sig GROUP BY utt)"""


def _label_models(s, d) -> DataFrame:
    """The models of each conversation's roles in order of turn, with their state counts."""
    states = s.createDataFrame([("user", 5), ("assistant", 5), ("system", 2)], "role string, states int")
    c = table(s, d, "conversations").select("conv_id", "turn", "role")
    return c.join(F.broadcast(states), "role").select("conv_id", "turn", "role", "states")


def _uniform_lengths(s, d) -> DataFrame:
    n = wave(s, d).groupBy("utt").agg(F.count("*").alias("n")).where(f"n >= {STATES}")
    starts = n.select("utt", "n", F.posexplode(trellis.uniform_starts(F.col("n"))).alias("state", "start"))
    return starts.select("utt", "state", (F.floor((F.col("state") + 1) * F.col("n") / STATES) - F.col("start")).alias("length"))


def _one_model(s, d) -> DataFrame:
    return trellis.sequences(wave(s, d), "utt", "i", F.array("x"), "frames").withColumn("model", F.lit("all"))


def _costs(s, got) -> DataFrame:
    """Each round's cost, and how many sequences it is of, and how many found no way through."""
    rows = [(i, round(c, 3), n, out) for i, (c, n, out) in enumerate(zip(got.costs, got.aligned, got.left_out))]
    return s.createDataFrame(rows, "round long, cost double, aligned long, left_out long")


def _trained(s, d) -> DataFrame:
    """Trains one model on all users' sequences; the cost of each round."""
    return _costs(s, training.segmental_k_means(_one_model(s, d), STATES, rounds=6))


def _retrained(s, d) -> DataFrame:
    """Training that goes on from given models."""
    given = training.Model([[(1.0, [_center(0, k)], [10000.0])] for k in range(STATES)], STAY, MOVE)
    return _costs(s, training.segmental_k_means(_one_model(s, d), STATES, rounds=3, start={"all": given}))


def _aligned_labels(s, d) -> DataFrame:
    """Forced alignment to a label of two models, of three and of two states, which are one chain of
    the states of _e: the join of labels with models as the operator makes it."""
    own = {name: training.Model([[(1.0, [_center(0, k)], [10000.0])] for k in part], [0.2] * len(part), [0.7] * len(part)) for name, part in (("a", (0, 1, 2)), ("b", (3, 4)))}
    seq = _one_model(s, d).select("utt", F.array(F.lit("a"), F.lit("b")).alias("label"), "frames")
    got = training.align_labels(seq, own, 0.7, prefer_move=False)
    return got.select("utt", F.col("t").cast("long").alias("t"), "model", (F.when(F.col("model") == "b", 3).otherwise(0) + F.col("state")).alias("state"))


def oracle_sql() -> dict[str, str]:
    v = _viterbi_sql()
    rows = "SELECT model, CAST(d AS INTEGER) AS d, round(mean, 6) AS mean, round(var, 6) AS var"
    return {
        "gauss_fit": f"WITH {_FIT} {rows} FROM g",
        "gauss_score": f"WITH {_COST} SELECT vec_id, model, round(c, 4) AS cost FROM cost",
        "gauss_classify": f"WITH {_CLASS} SELECT vec_id, predicted FROM best",
        "gauss_accuracy": f"WITH {_CLASS} SELECT count(*) AS n, count(*) FILTER (label = predicted) AS n_right, round(avg(CAST(label = predicted AS INTEGER)), 6) AS accuracy FROM best",
        "squared_distance": f"WITH {_FIT} SELECT vec_id, round(sum((x - mean) * (x - mean)), 6) AS distance FROM x JOIN g USING (model, d) GROUP BY vec_id",
        "gmm_logsumexp": f"WITH {_LOGS} SELECT vec_id, round(-z, 4) AS cost FROM lse",
        "gmm_weight_twice": f"WITH {_LOGS} SELECT vec_id, round(-(z + ln(0.5)), 4) AS cost FROM lse",
        "gmm_split": f"WITH {_FIT} SELECT model, k AS g, 0.5::DOUBLE AS alpha, CAST(d AS INTEGER) AS d, round(mean * CASE WHEN k = 0 THEN 1.01 ELSE 0.99 END, 6) AS mean, round(var, 6) AS var FROM g CROSS JOIN (VALUES (0), (1)) q(k)",
        "kmeans_assign": f"WITH {_ASSIGN} SELECT vec_id, g FROM asg",
        "kmeans_repair": f"""WITH {_ASSIGN}, far AS (SELECT x.vec_id, x.model, sum(ln(2 * pi() * c.var) + (x.x - c.mean - 100 * sqrt(c.var)) * (x.x - c.mean - 100 * sqrt(c.var)) / c.var) AS c
            FROM x JOIN comp c ON c.model = x.model AND c.d = x.d AND c.g = 0 GROUP BY x.vec_id, x.model),
          n AS (SELECT *, count(*) OVER (PARTITION BY model, g) AS n FROM asg JOIN far USING (vec_id, model)),
          r AS (SELECT *, row_number() OVER (PARTITION BY model, n > 3 ORDER BY c, vec_id) AS place FROM n)
          SELECT vec_id, model, CASE WHEN n > 3 AND place <= 2 THEN 2 ELSE g END AS g FROM r""",
        "kmeans_update": f"WITH {_ASSIGN}, n AS (SELECT model, g, count(*) AS n FROM asg GROUP BY model, g), a AS (SELECT model, g, n / sum(n) OVER (PARTITION BY model) AS alpha FROM n) SELECT asg.model, asg.g, round(any_value(a.alpha), 6) AS alpha, CAST(d AS INTEGER) AS d, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS var FROM asg JOIN x USING (vec_id, model) JOIN a ON a.model = asg.model AND a.g = asg.g GROUP BY asg.model, asg.g, d",
        "em_posterior": f"WITH {_GAMMA} SELECT vec_id, g, round(p, 6) AS p FROM gm",
        "em_cost": f"WITH {_LOGS} SELECT round(-sum(z), 3) AS cost FROM lse",
        "em_mstep": f"WITH {_EM} SELECT model, g, round(alpha, 6) AS alpha, CAST(d AS INTEGER) AS d, round(mean, 5) AS mean, round(var, 5) AS var FROM ev",
        "em_fit": _rounds_sql(3, True),
        "hard_cluster": _rounds_sql(5, False),
        "cluster_score": f"WITH {_LOGS} SELECT vec_id, g, round(-l, 4) AS score FROM lg",
        "viterbi_beam": _viterbi_sql(beam=3.0) + f" SELECT v.utt, s AS state, round(c, 6) AS cost {_FINAL}",
        "decode_fixed": _decode_sql(),
        "decode_beam": _decode_sql(6.0),
        "aligned_labels": _PATH + " SELECT utt, t, CASE WHEN state < 3 THEN 'a' ELSE 'b' END AS model, state FROM pr",
        "viterbi_isolated": _viterbi_sql("(VALUES (0), (1), (2))") + f" SELECT v.utt, CAST(arg_min(model, (round(c, 4), model)) AS INTEGER) AS model, min(round(c, 4)) AS cost {_FINAL} WHERE s = 4 GROUP BY v.utt",
        "viterbi_costs": v + f" SELECT v.utt, s AS state, round(c, 6) AS cost {_FINAL}",
        "viterbi_skip": _viterbi_sql(skip=True) + f" SELECT v.utt, s AS state, round(c, 6) AS cost {_FINAL}",
        "forced_align": _PATH + " SELECT utt, t, state FROM pr",
        "word_segments": _PATH + " SELECT utt, [0, 0, 1, 1, 2][state + 1] AS pos, min(t) AS start_t, max(t) + 1 AS end_t FROM pr GROUP BY 1, 2",
        "path_changes": _PATH + " SELECT utt, state, t FROM pe WHERE enters",
        "occupancy": _PATH + " SELECT state, count(*) AS n, count(*) FILTER (enters) AS visits FROM pe GROUP BY state",
        "transition_cost": _PATH + " SELECT state, round(-ln(k / n), 6) AS next, round(-ln(1 - k / n), 6) AS stay FROM (SELECT state, count(*) AS n, count(*) FILTER (enters) AS k FROM pe GROUP BY state)",
        "total_path_cost": v + f" SELECT round(sum(c), 2) AS cost, count(*) AS n {_FINAL} WHERE s = 4",
        "score_change": f"SELECT round(sum(abs(a.c - b.c)), 4) AS change FROM ({v} SELECT v.utt, c {_FINAL} WHERE s = 4) a JOIN ({_viterbi_sql(skip=True)} SELECT v.utt, c {_FINAL} WHERE s = 4) b USING (utt)",
        "frames_in_segments": f"WITH {_SIG}, n AS (SELECT utt, count(*) AS n FROM sig GROUP BY utt), seg AS (SELECT utt, state, floor(state * n / 5) AS a, floor((state + 1) * n / 5) AS b FROM n CROSS JOIN (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS state)) SELECT sig.utt, i, state FROM sig JOIN seg ON sig.utt = seg.utt AND i >= a AND i < b",
        "label_models": "SELECT conv_id, turn, role, CAST(CASE role WHEN 'system' THEN 2 ELSE 5 END AS INTEGER) AS states FROM conversations WHERE role IN ('user', 'assistant', 'system')",
        "segment_change": _PATH + ", n AS (SELECT utt, count(*) AS n FROM sig GROUP BY utt HAVING count(*) >= 5), u AS (SELECT utt, s AS state, floor((s + 1) * n / 5) - floor(s * n / 5) AS old FROM n CROSS JOIN st), c AS (SELECT utt, state, count(*) AS new FROM pr GROUP BY utt, state) SELECT round(avg(abs(new - old)), 6) AS change FROM u JOIN c USING (utt, state)",
        "state_parameters": _PATH + " SELECT state, 0 AS d, round(avg(x), 4) AS mean, round(var_pop(x), 4) AS var FROM pr JOIN sig ON sig.utt = pr.utt AND sig.i = pr.t GROUP BY state",
        "decode_loop": _LOOP_SQL,
        "align_from_sql": _viterbi_sql(path=True) + f", p AS (SELECT v.utt, v.path, round(c, 4) AS cost {_FINAL} WHERE s = 4) SELECT utt, unnest(range(0, len(path))) AS t, unnest(path) AS state, cost FROM p",
        "framed_from_sql": f"WITH {_SIG}, n AS (SELECT utt, count(*) AS n FROM sig GROUP BY utt), f AS (SELECT utt, unnest(range(0, (n - 16) // 6 + 1)) AS f FROM n WHERE n >= 16) SELECT f.utt, f, CAST(i - f * 6 AS INTEGER) AS j, round(x, 6) AS v FROM f JOIN sig ON sig.utt = f.utt AND i >= f * 6 AND i < f * 6 + 16",
        "segmental_kmeans": _training_sql(6, [0, 1, 2, 3, 4], {}, False) + _ended_sql(_FALLS) + _SHOWN,
        "retraining": _training_sql(3, [0, 1, 2, 3, 4], {}, False, ", ".join(f"({k}, {_center(0, k)}::DOUBLE, 10000.0::DOUBLE, 0.2::DOUBLE, 0.7::DOUBLE)" for k in range(STATES))) + _ended_sql(_FALLS) + _SHOWN,
        "greedy_training": _training_sql(4, [0, 1, 2, 3, 4], {}, False, greedy=True) + _ended_sql(_FALLS) + _SHOWN,
        "continuous_training": _training_sql(4, [0, 1, 2, 3, 4, 0], {0: 200.0, 2: 200.0, 4: 200.0}, True)
        + _ended_sql("coalesce(abs(c - lag(c) OVER o) < 500 AND abs(lag(c) OVER o - lag(c, 2) OVER o) < 500, false)") + _SHOWN,
        "two_level_training": _two_level_sql(3, 30),
        "mixture_training": _mixture_sql(),
        "skip_transition_cost": _viterbi_sql(skip=True, path=True) + f""", p AS (SELECT v.utt, v.path {_FINAL} WHERE s = 4),
          r AS (SELECT utt, unnest(range(0, len(path))) AS t, unnest(path) AS state FROM p), n AS (SELECT *, lag(state) OVER w AS before, lead(state) OVER w AS after FROM r WINDOW w AS (PARTITION BY utt ORDER BY t)),
          c AS (SELECT state, count(*) AS n, count(*) FILTER (before IS DISTINCT FROM state) AS visits, count(*) FILTER (after - state = 2) AS skipped FROM n GROUP BY state)
          SELECT state, n, visits, skipped, CASE WHEN visits > skipped THEN round(-ln((visits - skipped) / n), 6) END AS next, CASE WHEN visits < n THEN round(-ln(1 - visits / n), 6) END AS stay,
                 CASE WHEN skipped > 0 THEN round(-ln(skipped / n), 6) END AS skip FROM c""",
        "block_align": _long_sql() + ", w AS MATERIALIZED (SELECT * FROM v), back(utt, t, s) AS (SELECT w.utt, w.t, w.s FROM w JOIN len ON w.utt = len.utt AND w.t = len.last WHERE w.s = 4 UNION ALL SELECT w.utt, w.t - 1, w.came FROM back JOIN w ON w.utt = back.utt AND w.t = back.t AND w.s = back.s WHERE w.t > 0) SELECT utt, t, s AS state FROM back",
        "block_costs": _long_sql(True) + f" SELECT v.utt, round(c, 4) AS cost {_FINAL} WHERE s = 4",
        "path_start": _PATH + " SELECT utt, path[1] AS first_state, path[len(path)] AS last_state FROM p",
        "uniform_segment": f"WITH {_SIG} SELECT utt, state, CAST(floor(state * n / 5) AS INTEGER) AS start FROM (SELECT utt, count(*) AS n FROM sig GROUP BY utt) CROSS JOIN (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS state)",
        "dtw_template": f"""WITH RECURSIVE {_SIG}, st AS (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS s), len AS (SELECT utt, max(i) AS last FROM sig GROUP BY utt),
          v(utt, t, s, c) AS (SELECT utt, i, 0, 0.0::DOUBLE FROM sig WHERE i = 0 UNION ALL
            SELECT v.utt, v.t + 1, st.s, min(v.c) + any_value((x - (50.0 + 90 * st.s)) * (x - (50.0 + 90 * st.s))) FROM v JOIN st ON st.s BETWEEN v.s AND v.s + 2 JOIN sig ON sig.utt = v.utt AND sig.i = v.t + 1 GROUP BY v.utt, v.t, st.s)
          SELECT v.utt, round(c, 4) AS cost {_FINAL} WHERE s = 4""",
        "greedy_segment": f"""WITH RECURSIVE {_SIG}, len AS (SELECT utt, max(i) AS last FROM sig GROUP BY utt),
          v(utt, t, s, c) AS (SELECT utt, CAST(1 AS BIGINT), 0, sum({_e('x', '0', '0')}) FROM sig WHERE i < 2 GROUP BY utt UNION ALL
            SELECT v.utt, v.t + 1, CASE WHEN s < 4 AND {_e('x', '0', 's')} + 0.2 > {_e('x', '0', '(s + 1)')} + 0.7 THEN s + 1 ELSE s END,
              v.c + CASE WHEN s < 4 AND {_e('x', '0', 's')} + 0.2 > {_e('x', '0', '(s + 1)')} + 0.7 THEN {_e('x', '0', '(s + 1)')} + 0.7 ELSE {_e('x', '0', 's')} + 0.2 END
            FROM v JOIN sig ON sig.utt = v.utt AND sig.i = v.t + 1)
          SELECT v.utt, s AS state, round(c, 4) AS cost {_FINAL}""",
    }
