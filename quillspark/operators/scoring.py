"""Scoring recognised sequences against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def word_hits(result: Column, label: Column) -> Column:
    """Places at which two strings agree; 0 where their lengths differ, so that a sentence of the
    wrong length has all its words wrong."""
    agree = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(label), F.lit(1))), F.lit(0), lambda s, i: s + F.when((F.length(label) > 0) & (F.substring(result, i, F.lit(1)) == F.substring(label, i, F.lit(1))), 1).otherwise(0))
    return F.when(F.length(result) == F.length(label), agree).otherwise(0)


def accuracy(pairs: DataFrame, result: str = "result", label: str = "label") -> DataFrame:
    """One row: words right, words, sentences right, sentences, and both ratios (null over none)."""
    hits, n = word_hits(F.col(result), F.col(label)), F.length(label)
    whole = (F.length(result) == n) & (hits == n)
    sums = pairs.agg(F.sum(hits).cast("long").alias("words_right"), F.sum(n).cast("long").alias("words"), F.count_if(whole).cast("long").alias("sentences_right"), F.count("*").alias("sentences"))
    return sums.withColumns({"word_accuracy": F.try_divide(F.col("words_right"), F.col("words")), "sentence_accuracy": F.try_divide(F.col("sentences_right"), F.col("sentences"))})


def by_position(results: DataFrame, labels: DataFrame, index: str = "idx") -> DataFrame:
    """Results beside labels of the same place; raises where their numbers differ."""
    a, b = results.count(), labels.count()
    if a != b:
        raise ValueError(f"{a} results stand against {b} labels")
    return results.join(labels, index)


def digit_counts(labels: DataFrame, digits: str = "digits") -> DataFrame:
    """(digit, n): how often each digit occurs in all labels, repeats counted."""
    return labels.select(F.explode(digits).alias("digit")).groupBy("digit").agg(F.count("*").alias("n"))


def by_sequence(names: DataFrame, sequence: str = "digits", name: str = "file") -> DataFrame:
    """(sequence, files): the names of each sequence, sorted. A list grows with its sequence's names,
    so this is for reports; numbered_names() gives the same as rows."""
    return names.groupBy(sequence).agg(F.array_sort(F.collect_list(name)).alias("files"))


def numbered_names(names: DataFrame, sequence: str = "digits", name: str = "file") -> DataFrame:
    """(sequence, place, file): the names of each sequence, a row each, with their place from 0. No
    sequence is gathered, and one with very many names is ordered in parts."""
    part = F.substring(F.col(name), 1, 2)
    rows = names.select(F.col(sequence), F.col(name), part.alias("_p"))
    counts = rows.groupBy(F.col(sequence).alias("_s"), F.col("_p").alias("_q")).agg(F.count("*").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(W.partitionBy("_s").orderBy("_q").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_own", F.row_number().over(W.partitionBy(sequence, "_p").orderBy(name)))
    rows = rows.join(counts.withColumn("_ahead", ahead), F.col(sequence).eqNullSafe(F.col("_s")) & F.col("_p").eqNullSafe(F.col("_q")))
    return rows.select(sequence, (F.col("_ahead") + F.col("_own") - 1).alias("place"), name)
