"""Full-text and box searches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def terms(text: Column) -> Column:
    """The words of a text in lower case, split at whatever is neither a letter nor a digit of ASCII."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """term, id and how often the text holds the term: an inverted index, to be written partitioned by term."""
    return docs.select(F.col(id_col).alias("id"), F.explode(terms(F.col(text_col))).alias("term")).groupBy("term", "id").agg(F.count("*").alias("n"))


def matching(index: DataFrame, *words: str) -> DataFrame:
    """id and hits of the texts that hold all words; only the words' postings are read."""
    wanted = sorted({w.lower() for w in words})
    found = index.where(F.col("term").isin(wanted)).groupBy("id").agg(F.count("*").alias("__k"), F.sum("n").alias("hits"))
    return found.where(F.col("__k") == len(wanted)).drop("__k")


def within(**ranges: tuple) -> Column:
    """Whether a row's columns lie in the sides of a box, both ends included: a filter that reaches the scan."""
    return reduce(lambda a, b: a & b, [F.col(c).between(low, high) for c, (low, high) in ranges.items()])
