"""Comparing and evaluating rankings, and reachability over edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cotejo.session import cut

# Bounds within which two rankings agree.
LEAST_JACCARD, MOST_RANK_DIFFERENCE, MOST_SCORE_ERROR = 0.7, 2.0, 0.05


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row a query of two rankings (query_id, doc_id, rank, score): overlap, rank and score differences."""
    left = a.select("query_id", "doc_id", F.col("rank").alias("rank_a"), F.col("score").alias("score_a"))
    right = b.select("query_id", "doc_id", F.col("rank").alias("rank_b"), F.col("score").alias("score_b"))
    both = left.join(right, ["query_id", "doc_id"], "full")
    shared = F.col("rank_a").isNotNull() & F.col("rank_b").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = both.groupBy("query_id").agg(
        (F.count_if(shared) / F.count("*")).alias("jaccard"), zero(F.avg(F.when(shared, F.abs(F.col("rank_a") - F.col("rank_b"))))).alias("rank_difference"),
        zero(F.avg(F.when(shared, F.abs(F.col("score_a") - F.col("score_b"))))).alias("score_error"),
        F.count_if(F.col("rank_b").isNull()).alias("only_a"), F.count_if(F.col("rank_a").isNull()).alias("only_b"),
    )
    agrees = (F.col("jaccard") >= LEAST_JACCARD) & (F.col("rank_difference") <= MOST_RANK_DIFFERENCE) & (F.col("score_error") <= MOST_SCORE_ERROR)
    return rows.withColumn("agrees", agrees)


def largest_differences(a: DataFrame, b: DataFrame, most: int = 5) -> DataFrame:
    joined = a.select("query_id", "doc_id", F.col("score").alias("score_a")).join(b.select("query_id", "doc_id", F.col("score").alias("score_b")), ["query_id", "doc_id"])
    joined = joined.withColumn("difference", F.abs(F.col("score_a") - F.col("score_b")))
    order = Window.partitionBy("query_id").orderBy(F.desc("difference"), "doc_id")
    return joined.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, ["query_id", "doc_id"], "left_anti")


def evaluate(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Precision, recall and F1 of found against expected (query_id, doc_id), one row a query."""
    hits = found.select("query_id", "doc_id", F.lit(1).alias("f")).join(expected.select("query_id", "doc_id", F.lit(1).alias("e")), ["query_id", "doc_id"], "full")
    sums = hits.groupBy("query_id").agg(F.count("f").alias("found"), F.count("e").alias("expected"), F.count_if(F.col("f").isNotNull() & F.col("e").isNotNull()).alias("hits"))
    part = lambda n: F.when(F.col(n) > 0, F.col("hits") / F.greatest(F.col(n), F.lit(1))).otherwise(0.0)
    rows = sums.select("query_id", "found", "expected", "hits", part("found").alias("precision"), part("expected").alias("recall"))
    both = F.col("precision") + F.col("recall")
    return rows.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / F.when(both > 0, both)).otherwise(0.0))


def macro(evaluated: DataFrame) -> DataFrame:
    return evaluated.agg(*[F.avg(c).alias(f"mean_{c}") for c in ("precision", "recall", "f1")])


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """All nodes that the start nodes lead to over (a, b), breadth first; each round adds a distance.

    A round writes the nodes that are new in it, and none of those before.
    """
    edges = cut(edges.distinct())
    seen = fresh = cut(start.select("node").distinct())
    while True:
        fresh = cut(fresh.join(edges, fresh["node"] == edges["a"]).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti"))
        if fresh.isEmpty():
            return seen
        seen = seen.union(fresh)
