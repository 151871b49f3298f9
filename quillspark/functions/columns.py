"""Column functions: costs, mel scale, labels, distances. All stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spoken digits.
DIGITS = {"zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9}


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    """Sum of squared differences of two arrays."""
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def gaussian_cost(x: Column, mean: Column, var: Column) -> Column:
    """Negative log density of a diagonal Gaussian."""
    terms = F.zip_with(F.zip_with(x, mean, lambda p, q: (p - q) * (p - q)), var, lambda d, v: F.ln(v * (2 * math.pi)) + d / v)
    return total(terms) * 0.5


def log_sum_exp(logs: Column) -> Column:
    """ln of the sum of exps of an array, taken from its maximum; small terms are added first."""
    top = F.array_max(logs)
    return top + F.ln(total(F.array_sort(F.transform(logs, lambda x: F.exp(x - top)))))


def mixture_cost(x: Column, components: Column, weight_power: int = 1) -> Column:
    """Negative log density of a mixture: components is an array of (alpha, mean, var).

    Components of weight 0 are skipped. weight_power 2 counts each weight twice, as one decoder of
    old did; keep 1.
    """
    live = F.filter(components, lambda c: c["alpha"] > 0)
    return -log_sum_exp(F.transform(live, lambda c: F.ln(c["alpha"]) * weight_power - gaussian_cost(x, c["mean"], c["var"])))


def cluster_score(x: Column, mean: Column, var: Column, weight: Column) -> Column:
    """What a frame costs in a cluster: its Gaussian cost less the log weight."""
    return gaussian_cost(x, mean, var) - F.ln(weight)


def hz_to_mel(hz: Column) -> Column:
    return F.log10(hz / 700.0 + 1) * 2595.0


def mel_to_hz(mel: Column) -> Column:
    return (F.pow(F.lit(10.0), mel / 2595.0) - 1) * 700.0


def hz_to_mel_ln(hz: Column) -> Column:
    """The natural-logarithm form of the scale."""
    return F.ln(hz / 700.0 + 1) * 1127.0


def mel_to_hz_ln(mel: Column) -> Column:
    return (F.exp(mel / 1127.0) - 1) * 700.0


def safe_ln(x: Column) -> Column:
    """ln, null at 0 and below."""
    return F.when(x > 0, F.ln(x))


def word_to_digit(word: Column, oh: int = 10) -> Column:
    """The digit of a spoken word; "oh" maps to 10 or 0 by corpus; others are null."""
    pairs = [F.lit(v) for kv in (DIGITS | {"oh": oh}).items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(word))


def filename_label(name: Column) -> Column:
    """Digits of an encoded file name: from the fifth letter on, the last dropped; Z is 0, O is 11;
    silence (10) stands first."""
    letters = F.filter(F.split(F.substring(name, 5, 1_000_000), ""), lambda c: c != "")
    body = F.slice(letters, 1, F.greatest(F.size(letters) - 1, F.lit(0)))
    code = F.transform(body, lambda c: F.when(c == "Z", 0).when(c == "O", 11).otherwise(c.try_cast("int")))
    return F.concat(F.array(F.lit(10)), F.filter(code, lambda x: x.isNotNull()))


def with_silence(label: Column) -> Column:
    return F.concat(F.array(F.lit("sil")), label, F.array(F.lit("sil")))


def without_silence(words: Column) -> Column:
    return F.filter(words, lambda w: w != "sil")


def same_start(a: Column, b: Column, n: int = 3) -> Column:
    return F.substring(a, 1, n) == F.substring(b, 1, n)


def edit_distance(a: Column, b: Column, whole_string: bool = False) -> Column:
    """Levenshtein distance by letter. whole_string: substitutions never match, as where a letter is
    held against the whole other string; the distance is then the longer length."""
    return F.greatest(F.length(a), F.length(b)) if whole_string else F.levenshtein(a, b)


def base_name(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def quoted_digit(description: Column) -> Column:
    """The letter behind the first quote of a node's description."""
    return F.regexp_extract(description, '"(.)', 1)


def template_concat(label: Column, templates: Column) -> Column:
    """The states of a label's models one after another; templates maps a model to its states."""
    return F.flatten(F.transform(label, lambda m: F.element_at(templates, m)))


def boundary_offsets(label: Column, silence: Column, digit_states: int = 5, silence_states: int = 2) -> Column:
    """The first state of each of a label's models in their concatenation."""
    step = lambda m: F.when(m == silence, silence_states).otherwise(digit_states)
    return F.aggregate(label, F.array(F.lit(0)), lambda acc, m: F.concat(acc, F.array(F.element_at(acc, -1) + step(m))), lambda acc: F.slice(acc, 1, F.size(acc) - 1))


def gaussian_noise(seed: int = 0) -> Column:
    """Standard normal draws, the same again for the same seed and partitioning."""
    return F.randn(seed)


def rewind(start: Column, chunks: int = 10, chunk: int = 400) -> Column:
    """`chunks` chunks before start, but not before 0; null where there is no start."""
    return F.when(start.isNotNull(), F.greatest(start - chunks * chunk, F.lit(0)))
