"""Reranking by intent, the guard for the first place, semantic reranking and hybrid scores."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotejo.functions import taxonomy
from cotejo.functions.text import let, normalize_key, preprocess, words

DIGITS = 6
# Weights of the reranker, of the semantic reranker and of the hybrid engine.
WEIGHTS = {"bm25": 0.35, "model": 0.45, "category": 0.30, "accessory": 0.95, "missing_model": 0.55}
BONUS_STEP, BONUS_MOST = 0.04, 0.12
SEMANTIC, CROSS, NUMERIC, GATE, CROSS_TOP = 0.7, 0.2, 0.1, 0.75, 20
HYBRID = {"tfidf": 0.25, "semantic": 0.40, "rerank": 0.20, "domain": 0.15}


def rerank(rows: DataFrame, doc_type: str | None = None, doc_category: str | None = None, weights: dict = WEIGHTS, bonus: bool = True, **dictionaries) -> DataFrame:
    """Scores (query_id, query, doc_id, text, score) by the query's intent; adds the parts and final_score.

    ``doc_type`` and ``doc_category`` name columns that take precedence over what the text shows.
    """
    return weighted(rerank_parts(rows, doc_type, doc_category, **dictionaries), weights, bonus)


def rerank_parts(rows: DataFrame, doc_type: str | None = None, doc_category: str | None = None, **dictionaries) -> DataFrame:
    """What ``rerank`` reads from texts, without the weights: the parts of the score, doc_type and intent."""
    order = Window.partitionBy("query_id")
    rows = rows.withColumn("parsed", taxonomy.parse_query(F.col("query"), **dictionaries))
    rows = rows.withColumn("doc", taxonomy.classify_doc(F.col("text"), F.col("parsed.model_numbers"), *[F.col(c) if c else None for c in (doc_category, doc_type)], **dictionaries))
    top = F.max("score").over(order)
    numbers = F.size("parsed.model_numbers") > 0
    named = let(normalize_key(F.col("text")), lambda norm: F.size(F.filter(F.col("parsed.accessory_terms"), lambda a: norm.contains(a))))
    rows = rows.select(
        "*",
        F.when(top > 0, F.col("score") / top).otherwise(0.0).alias("bm25_norm"),
        F.col("doc.has_model").cast("int").alias("model_boost"),
        F.coalesce(F.col("doc.category") == F.col("parsed.main_category"), F.lit(False)).cast("int").alias("category_boost"),
        ((F.col("parsed.intent") == "EQUIPAMENTO") & (F.col("doc.doc_type") == "ACESSORIO")).cast("int").alias("accessory_penalty"),
        (numbers & ~F.col("doc.has_model")).cast("int").alias("missing_model_penalty"),
        F.when((F.size("parsed.accessory_terms") > 0) & (F.col("doc.doc_type") == "EQUIPAMENTO"), F.least(F.lit(BONUS_MOST), BONUS_STEP * named)).otherwise(0.0).alias("accessory_bonus"),
    )
    return rows.withColumn("doc_type", F.col("doc.doc_type")).withColumn("intent", F.col("parsed.intent")).drop("parsed", "doc")


def weighted(rows: DataFrame, weights: dict = WEIGHTS, bonus: bool = True) -> DataFrame:
    """Adds final_score to the parts of a score; without ``bonus`` accessories that both name count nothing."""
    rows = rows if bonus else rows.withColumn("accessory_bonus", F.lit(0.0))
    total = (
        weights["bm25"] * F.col("bm25_norm") + weights["model"] * F.col("model_boost") + weights["category"] * F.col("category_boost") + F.col("accessory_bonus")
        - weights["accessory"] * F.col("accessory_penalty") - weights["missing_model"] * F.col("missing_model_penalty")
    )
    return rows.withColumn("final_score", F.round(F.greatest(F.lit(0.0), total), DIGITS))


def guard_first(ranked: DataFrame) -> DataFrame:
    """Adds rank and guarded_rank to reranked rows.

    If equipment is wanted and the first place has an accessory, the first equipment takes its place
    and the others move down by one.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "doc_id")
    every = Window.partitionBy("query_id")
    rows = ranked.withColumn("rank", F.row_number().over(order))
    first_type = F.max(F.when(F.col("rank") == 1, F.col("doc_type"))).over(every)
    equipment = F.min(F.when(F.col("doc_type") == "EQUIPAMENTO", F.col("rank"))).over(every)
    applies = (F.col("intent") == "EQUIPAMENTO") & (first_type == "ACESSORIO") & equipment.isNotNull()
    moved = F.when(F.col("rank") == equipment, 1).when(F.col("rank") < equipment, F.col("rank") + 1).otherwise(F.col("rank"))
    return rows.withColumn("guarded_rank", F.when(F.coalesce(applies, F.lit(False)), moved).otherwise(F.col("rank")))


def word_f1(query: Column, document: Column) -> Column:
    """F1 of shared words; words that a text repeats count as often."""
    q, d = words(preprocess(query), " "), words(preprocess(document), " ")
    hits = F.size(F.filter(q, lambda w: F.array_contains(d, w)))
    precision, recall = F.try_divide(hits, F.size(d)), F.try_divide(hits, F.size(q))
    return F.coalesce(F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)), F.lit(0.0))


def min_max(score: Column, group: str = "query_id") -> Column:
    """Scaled to [0, 1] within a group; 0.5 where all are equal."""
    every = Window.partitionBy(group)
    low, high = F.min(score).over(every), F.max(score).over(every)
    return F.when(high - low < 1e-9, 0.5).otherwise((score - low) / (high - low))


def semantic_rerank(rows: DataFrame) -> DataFrame:
    """Of (query_id, doc_id, semantic, cross, numeric): combined score.

    Where the best semantic score is below the gate, the cross scores of the top rows count, scaled;
    otherwise none do.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("semantic"), "doc_id")
    placed = rows.withColumn("place", F.row_number().over(order))
    gate = F.max("semantic").over(Window.partitionBy("query_id")) < GATE
    taken = placed.withColumn("used", F.when(gate & (F.col("place") <= CROSS_TOP), F.col("cross")))
    scaled = taken.withColumn("cross_norm", F.when(F.col("used").isNotNull(), min_max(F.col("used"))).otherwise(0.0))
    total = SEMANTIC * F.col("semantic") + CROSS * F.col("cross_norm") + NUMERIC * F.col("numeric")
    # semantic scores have DIGITS digits, so at as many the weighted sum would often lie halfway
    return scaled.withColumn("final_score", F.round(total, DIGITS + 3)).drop("used", "place")


def hybrid_score(tfidf: Column, semantic: Column, rerank_: Column, domain: Column) -> Column:
    parts = {"tfidf": tfidf, "semantic": semantic, "rerank": rerank_, "domain": domain}
    total = F.lit(0.0)
    for name, value in parts.items():
        total = total + HYBRID[name] * F.coalesce(value, F.lit(0.0))
    return total


# The score where nothing crosses query and text, and what stands between them in a key.
NO_CROSS, SEPARATOR = 0.5, "|||"


def no_cross(rows: DataFrame) -> DataFrame:
    """Adds cross, the same for all rows: what ranks if there is no provider of cross scores."""
    return rows.withColumn("cross", F.lit(NO_CROSS))


def pair_key(query: Column, document: Column) -> Column:
    return F.concat_ws(SEPARATOR, preprocess(query), preprocess(document))


def listed_cross(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds cross to (query, text) from a table of pairs (query, doc, score), by their normalised texts; 0 where there is none."""
    known = pairs.select(pair_key(F.col("query"), F.col("doc")).alias("_key"), "score").groupBy("_key").agg(F.max("score").alias("_score"))
    joined = rows.withColumn("_key", pair_key(F.col("query"), F.col("text"))).join(known, "_key", "left")
    return joined.withColumn("cross", F.coalesce("_score", F.lit(0.0))).drop("_key", "_score")


class CrossProvider(Protocol):
    """Anything that scores a query against texts in batches; it is sent to the executors."""

    def score(self, pairs: Sequence[tuple[str, str]]) -> list[float | None]:
        """A score for each (query, text); None where there is none."""


def crossed(rows: DataFrame, provider: CrossProvider, batch: int = 32) -> DataFrame:
    """Adds cross to (query, text) from a provider; a batch that fails is halved, and a pair that fails by itself has 0."""

    def attempt(pairs: list[tuple[str, str]]) -> list[float]:
        try:
            found = provider.score(pairs)
            if len(found) != len(pairs):
                raise ValueError(f"{len(found)} scores for {len(pairs)} pairs")
            return [0.0 if x is None or x != x else float(x) for x in found]
        except Exception:  # whatever a provider raises
            return [0.0] if len(pairs) == 1 else attempt(pairs[: len(pairs) // 2]) + attempt(pairs[len(pairs) // 2 :])

    @F.pandas_udf("double")
    def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
        pairs = list(zip(queries.fillna(""), texts.fillna(""), strict=True))
        return pd.Series([x for at in range(0, len(pairs), batch) for x in attempt(pairs[at : at + batch])], dtype="float64")

    return rows.withColumn("cross", run("query", "text"))
