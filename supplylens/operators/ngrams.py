"""Substring search for many needles at once, by an index of n-grams.

The index holds each gram of one to ``N`` characters with the names it occurs in. A needle looks only at the names of its rarest gram, which the index knows by
its counts, and compares them by ``contains``. All needles are searched in one job; a hot gram is used only by needles that have no rarer one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest grams.
N = 3
#: Names of a gram that are looked at together; a longer list is dealt into parts of about this size.
PART = 4096


@dataclass
class NgramIndex:
    """``postings`` (gram, name) and ``counts`` (gram, names)."""

    postings: DataFrame
    counts: DataFrame


def grams(c, n: int = N) -> Column:
    """All different grams of one to ``n`` characters."""
    at = F.sequence(F.lit(1), F.char_length(c))
    made = F.transform(at, lambda i: F.array(*[F.substr(c, i, F.lit(k)) for k in range(1, n + 1)]))
    return F.when(F.char_length(c) > 0, F.array_distinct(F.flatten(made))).otherwise(F.array().cast("array<string>"))


def build_ngrams(names: DataFrame, name: str = "name", n: int = N) -> NgramIndex:
    """Index the different values of a column; null and empty names are in no gram."""
    postings = names.select(F.col(name).alias("name")).filter("name is not null").distinct().select(F.explode(grams(F.col("name"), n)).alias("gram"), "name")
    return NgramIndex(postings, postings.groupBy("gram").agg(F.count("*").alias("names")))


def substring_search(index: NgramIndex, needles: DataFrame, needle: str = "needle", n: int = N) -> DataFrame:
    """(needle, name) for every indexed name that contains the needle, compared as they are; empty and null needles find nothing.

    A needle with a gram that no name has finds nothing without looking at any. Repeated needles are answered once.
    """
    asked = needles.select(F.col(needle).alias("needle")).filter("needle != ''").distinct()
    # The longest grams that a needle has are its rarest candidates.
    longest = F.filter(grams(F.col("needle"), n), lambda g: F.char_length(g) == F.least(F.lit(n), F.char_length(F.col("needle"))))
    each = asked.select("needle", F.explode(longest).alias("gram")).join(index.counts, "gram", "left").withColumn("names", F.coalesce("names", F.lit(0).cast("long")))
    rarest = each.groupBy("needle").agg(F.min(F.struct("names", "gram")).alias("r")).filter("r.names > 0").select("needle", "r.gram", "r.names")
    # Lists and needles of a long list meet part by part.
    parts = F.ceil(F.col("names") / PART).cast("int")
    spread = rarest.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("names")
    used = index.counts.join(rarest.select("gram").distinct(), "gram", "left_semi")
    lists = index.postings.join(used, "gram").withColumn("part", F.pmod(F.xxhash64("name"), parts).cast("int")).drop("names")
    return spread.join(lists, ["gram", "part"]).filter(F.contains("name", "needle")).select("needle", "name")
