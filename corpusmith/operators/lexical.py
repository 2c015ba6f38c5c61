"""Inverted index and lexical scores.

The index is a table of postings, one row for each term and text. Everything downstream reads
postings by term, so a written index is best partitioned by a hash of the term; the terms of a
batch of queries are joined to it, and only matching postings are shuffled again.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from corpusmith.functions import rules
from corpusmith.functions.query import analyze, fts_groups, priority_terms
from corpusmith.session import materialize


def postings(texts: DataFrame, key: str, tokens: Column) -> DataFrame:
    """term, ``key``, tf, positions and dl (the text's number of tokens), one row for each term of each text.

    Texts without tokens have no postings; rows with the same key count as separate texts only if
    the caller keeps them apart.
    """
    placed = texts.select(key, tokens.alias("_t")).select(key, F.size("_t").cast("long").alias("dl"), F.posexplode("_t").alias("_p", "term"))
    return placed.groupBy("term", key, "dl").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("_p")).alias("positions"))


def asked_postings(texts: DataFrame, key: str, tokens: Column, terms: DataFrame, positions: bool = False) -> DataFrame:
    """term, ``key``, tf and dl of the given terms (term) only, with their positions if asked for, written once.

    Terms are met before anything is counted or shuffled.
    """
    placed = texts.select(key, tokens.alias("_t")).select(key, F.size("_t").cast("long").alias("dl"), F.posexplode("_t").alias("_p", "term"))
    met = placed.join(terms.select("term").distinct(), "term", "left_semi")
    more = [F.sort_array(F.collect_list("_p")).alias("positions")] if positions else []
    return materialize(met.groupBy("term", key, "dl").agg(F.count("*").alias("tf"), *more), "asked")


def term_statistics(index: DataFrame, key: str) -> DataFrame:
    """df, the number of texts of each term."""
    return index.groupBy("term").agg(F.count_distinct(key).alias("df"))


def corpus_statistics(texts: DataFrame, tokens: Column) -> DataFrame:
    """One row: n texts and their average length in tokens, avgdl; no texts give 0 and null."""
    return texts.agg(F.count("*").alias("n"), F.avg(F.size(tokens)).alias("avgdl"))


def bm25(index: DataFrame, statistics: DataFrame, queries: DataFrame, key: str, k1: float = rules.BM25_K1, b: float = rules.BM25_B) -> DataFrame:
    """query_id, ``key`` and score > 0 of every text that holds a term of a query.

    ``queries`` has query_id and terms (array); a term named twice counts twice. Terms that no
    text has and empty queries give nothing.
    """
    asked = queries.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    frequency = term_statistics(index.join(asked.select("term").distinct(), "term", "left_semi"), key)
    hits = index.select("term", key, "tf", "dl").join(asked.join(frequency, "term"), "term")
    hits = hits.withColumn("n", statistics.select("n").scalar()).withColumn("avgdl", statistics.select("avgdl").scalar())
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    length = 1 - b + b * F.greatest(F.col("dl"), F.lit(1)) / F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0)
    part = F.col("times") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * length)
    return hits.groupBy("query_id", key).agg(F.sum(part).alias("score")).where("score > 0")


def top_k(scores: DataFrame, k: int, key: str, score: str = "score", digits: int = 6) -> DataFrame:
    """The ``k`` best of each query with their rank; scores equal to ``digits`` digits go to the smaller key."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round(score, digits)), key)
    return scores.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def boolean_matches(index: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """query_id and ``key`` of the texts that hold a term of every group.

    ``groups`` has query_id and groups, an array of arrays of terms; a query without groups
    matches nothing.
    """
    needed = groups.select("query_id", F.size("groups").alias("_n"), F.posexplode("groups").alias("_g", "_terms"))
    terms = needed.select("query_id", "_n", "_g", F.explode("_terms").alias("term"))
    met = index.select("term", key).join(terms, "term").groupBy("query_id", key, "_n").agg(F.count_distinct("_g").alias("_met"))
    return met.where("_met = _n").select("query_id", key)


@F.pandas_udf(T.DoubleType())
def cover_density(positions: pd.Series) -> pd.Series:
    """Cover density of the positions of each matched term (array of arrays): the shortest spans that
    hold every matched term, each counting the number of terms by its length.

    Public definition of the measure (Clarke, Cormack and Tudhope); it orders texts like database
    text search does for such queries, but its values aren't those of any database.
    """

    def density(lists) -> float:
        lists = [list(x) for x in lists if x is not None and len(x)]
        if not lists:
            return 0.0
        merged = sorted((p, i) for i, own in enumerate(lists) for p in own)
        if len(lists) == 1:
            return float(len(merged)) * 0.1
        seen: dict[int, int] = {}
        total, before = 0.0, -1
        for p, i in merged:
            seen[i] = p
            if len(seen) == len(lists):
                start = min(seen.values())
                if start > before:  # a new shortest cover
                    total += len(lists) / (p - start + 1)
                    before = start
        return total

    return positions.map(density)


def cover_density_scores(index: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """query_id, ``key`` and score of the texts that a boolean query matches, by cover density."""
    matched = boolean_matches(index, groups, key)
    terms = groups.select("query_id", F.explode(F.array_distinct(F.flatten("groups"))).alias("term"))
    held = index.select("term", key, "positions").join(terms, "term").join(matched, ["query_id", key], "left_semi")
    return held.groupBy("query_id", key).agg(F.collect_list("positions").alias("_p")).select("query_id", key, cover_density("_p").alias("score"))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def query_groups(raw: pd.Series) -> pd.Series:
    """The boolean query of a query's text, with its identifiers' parts first."""
    return raw.map(lambda q: fts_groups(q or "", priority_terms(analyze(q))))
