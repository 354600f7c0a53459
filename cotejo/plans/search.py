"""The whole search, from a batch of queries to ranked results with confidence.

All stages are transformations of one DataFrame of queries; a batch is many rows, not a loop.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cotejo.functions import attributes, domain, taxonomy
from cotejo.functions.text import normalize_equipment, normalize_key
from cotejo.operators import embed, rank, rerank, retrieve, stored
from cotejo.operators import rewrite as rewriting
from cotejo.operators.index import small, vocabulary
from cotejo.operators.timing import Timings, step
from cotejo.session import cut


@dataclass
class SearchConfig:
    """Sizes and switches; the word lists can be replaced."""

    top_k: int = 10
    min_score: float = 0.0
    fuzzy: bool = True
    rewrite: bool = True
    abbreviations: rewriting.Abbreviations = field(default_factory=rewriting.Abbreviations)
    #: A stored vocabulary (term, ord); without one it is made of the corpus at each search.
    vocabulary: DataFrame | None = None
    #: A stored BM25 index of the corpus, which also has its vocabulary; without one texts are read.
    index: stored.Stored | None = None
    #: Collects how long each step takes; every step ends in a checkpoint then.
    timings: Timings | None = None

    def __post_init__(self):
        if not 1 <= self.top_k:
            raise ValueError("top_k must be at least 1")
        if not 0.0 <= self.min_score <= 1.0:
            raise ValueError("min_score must be in [0, 1]")


def check_queries(queries: list[str], most: int | None = None) -> list[str]:
    """Queries, trimmed; ValueError for empty ones, ones over 500 characters, or too many of them."""
    trimmed = [q.strip() for q in queries]
    if any(not 1 <= len(q) <= 500 for q in trimmed):
        raise ValueError("a query must have 1 to 500 characters")
    if most is not None and not 1 <= len(trimmed) <= most:
        raise ValueError(f"a batch must have 1 to {most} queries")
    return trimmed


def diversified(ranked: DataFrame, top_k: int) -> DataFrame:
    """The first top_k rows of each query; of queries that navigate, few of each subtype come first, and rank is their place."""
    category = taxonomy.detect_category(F.col("text"))
    listed = ranked.where("navigation").select("query_id", "rank", "doc_id", rank.subtype_key(F.col("text"), F.col("doc_id"), category).alias("subtype"), category.alias("category"), taxonomy.detect_category(F.col("query")).alias("query_category"))
    chosen = rank.diversify(listed, top_k).select(F.col("query_id").alias("of"), F.col("doc_id").alias("taken"), "place")
    # a query's candidates are bounded, and so are the places of a batch
    several = ranked.where("navigation").join(chosen, (F.col("query_id") == F.col("of")) & (F.col("doc_id").cast("string") == F.col("taken")))
    several = several.withColumn("rank", F.col("place").cast("int")).select(*ranked.columns)
    return ranked.where((F.col("rank") <= top_k) & ~F.col("navigation")).unionByName(several)


def hydrate(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """The candidates (query_id, doc_id, more) with the text of their documents.

    A document that the corpus lacks, as where an index is older than it, has its id as text.
    """
    here = cut(corpus.select("doc_id", "text").join(small(found), "doc_id"))
    lost = found.join(here.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").withColumn("text", F.col("doc_id").cast("string"))
    return here.unionByName(lost)


def search(corpus: DataFrame, queries: DataFrame, config: SearchConfig | None = None) -> DataFrame:
    """Results of (query_id, query) on (doc_id, text): rank, scores, confidence of items and of the list.

    Accessories are taken out of the query before retrieval, misspelt words are corrected and the
    query is rewritten; each variant fetches candidates, which are summed by weight, reranked by
    intent and cut to top_k, after a choice by subtypes where a query navigates. guarded_rank is the
    place that the guard gives a row; the list is cut by rank, the final order.
    """
    config = config or SearchConfig()
    parsed = taxonomy.parse_query(F.col("query"))
    context = taxonomy.navigation_context(F.col("query"))
    asked = queries.select("query_id", "query", taxonomy.core_query(F.col("query"), parsed).alias("core"), taxonomy.is_navigation(context).alias("navigation"), taxonomy.specificity(F.col("query")).alias("specificity"), (F.size(parsed["accessory_terms"]) > 0).alias("has_accessories"))
    asked = asked.withColumn("candidates", rank.candidate_k(F.lit(config.top_k), F.col("navigation")))
    looked_for = asked.select("query_id", normalize_key(F.col("core")).alias("query"))
    if config.fuzzy:
        known = config.vocabulary if config.vocabulary is not None else config.index.vocabulary if config.index else vocabulary(corpus)
        looked_for = rewriting.correct_queries(looked_for, known).select("query_id", F.col("corrected").alias("query"))
        looked_for = looked_for if config.timings is None else config.timings.step("correct", looked_for)
    maps = config.abbreviations if config.rewrite else rewriting.Abbreviations()
    # a few rows a query from here on: kept, so that the corpus is read once for each of them
    variants = step(config.timings, "rewrite", rewriting.rewrite_plan(looked_for, maps))
    most = config.top_k * rank.NAV_CANDIDATES[0] + rank.NAV_CANDIDATES[2]
    lexical = stored.bm25_variants(config.index, variants, most, most) if config.index else retrieve.bm25_variants(corpus, variants, per_variant=most, k=most)
    found = lexical.join(small(asked.select("query_id", "candidates")), "query_id")
    found = found.where(F.col("rank") <= F.col("candidates")).select("query_id", "doc_id", "score")
    found = step(config.timings, "retrieve", found)
    hydrated = hydrate(found, corpus).join(small(asked), "query_id")
    ranked = rerank.guard_first(rank.keep_best(rerank.rerank(hydrated), "doc_id", "final_score", "score"))
    ranked = diversified(ranked, config.top_k)
    ranked = step(config.timings, "rank", rank.item_confidence(ranked, 0.7 + 0.3 * F.col("specificity")))
    every = Window.partitionBy("query_id")
    tops = ranked.groupBy("query_id").agg(
        F.first("query").alias("query"), F.max_by("text", -F.col("rank")).alias("top_text"), F.coalesce(F.max(F.when(F.col("rank") == 1, F.col("score"))), F.lit(0.0)).alias("s1"),
        F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)).alias("s2"), F.max("score").alias("max_score"), F.first("has_accessories").alias("has_accessories"), F.first("navigation").alias("is_navigation"),
    )
    overall = rank.global_confidence(tops).select("query_id", F.col("confidence").alias("list_confidence"), "level")
    done = ranked.join(small(overall), "query_id").where(F.col("score") >= config.min_score)
    shown = done.select("query_id", "rank", "guarded_rank", "doc_id", "score", (F.col("score") / F.max("score").over(every)).alias("score_share"), "final_score", "doc_type", "confidence", "list_confidence", "level")
    return shown if config.timings is None else config.timings.step("confidence", shown)


def search_texts(spark: SparkSession, corpus: DataFrame, queries: list[str], config: SearchConfig | None = None) -> DataFrame:
    rows = list(enumerate(check_queries(queries)))
    return search(corpus, spark.createDataFrame(rows, "query_id int, query string"), config)


#: Candidates that the lexical stage hands to the semantic ones.
SMART_CANDIDATES = 50


def smart_search(corpus: DataFrame, queries: DataFrame, provider: embed.EmbeddingProvider, top_k: int = 10, min_score: float = 0.0) -> DataFrame:
    """Hybrid results of (query_id, query) on (doc_id, text): lexical, semantic, cross and domain scores combined.

    Only the lexical candidates are embedded. The least score is applied to the list that was cut
    to top_k. Attributes that query and text share only order the semantic rerank, whose score is
    given as rerank_score.
    """
    asked = queries.select("query_id", "query", normalize_equipment(F.col("query")).alias("norm"))
    docs = corpus.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    normal = docs.select("doc_id", normalize_equipment(F.col("text")).alias("text"))
    found = retrieve.tfidf_hybrid(normal, asked.select("query_id", F.col("norm").alias("query")), SMART_CANDIDATES).select("query_id", "doc_id", F.col("score").alias("tfidf"))
    found = cut(found)
    rows = hydrate(found, docs).join(small(asked), "query_id")
    vectors = embed.embed(rows.select("doc_id", "text").distinct(), provider).select("doc_id", F.col("embedding").alias("doc_vector"))
    asked_vectors = embed.embed(asked.select("query_id", F.col("norm").alias("text")), provider).select("query_id", F.col("embedding").alias("query_vector"))
    rows = rows.join(vectors, "doc_id").join(small(asked_vectors), "query_id")
    rows = rows.withColumn("semantic", F.coalesce(retrieve.cosine(F.col("query_vector"), F.col("doc_vector")), F.lit(0.0)))
    rows = rows.withColumn("cross", rerank.word_f1(F.col("query"), F.col("text")))
    rows = rows.withColumn("numeric", attributes.numeric_boost(attributes.full_attributes(F.col("query")), attributes.full_attributes(F.col("text"))))
    rows = rows.withColumn("domain", domain.domain_score(domain.classify(F.col("query")), domain.classify(F.col("text"))))
    ranked = rerank.semantic_rerank(rows).withColumnRenamed("final_score", "rerank_score")
    score = rerank.hybrid_score(F.col("tfidf"), F.col("semantic"), F.col("cross_norm"), F.col("domain"))
    best = retrieve.top_k(ranked.withColumn("score", F.round(score, rerank.DIGITS)), top_k).where(F.col("score") >= min_score)
    return best.select("query_id", "rank", "doc_id", "score", "tfidf", "semantic", "cross_norm", "domain", "rerank_score")


def embedding_search(corpus: DataFrame, queries: DataFrame, provider: embed.EmbeddingProvider, top_k: int = 10) -> DataFrame:
    """Results by cosine of embedded, normalised texts alone."""
    docs = embed.embed(corpus.select("doc_id", normalize_equipment(F.col("text")).alias("text")), provider)
    asked = embed.embed(queries.select("query_id", normalize_equipment(F.col("query")).alias("text")), provider)
    return retrieve.dense_top(docs, asked.select("query_id", F.col("embedding").alias("query_vector")), top_k, provider.dimension)


def engine_mode(value: str | None) -> str:
    """Which engine answers, as a setting names it: python, ts or both (dual); ts if it names none."""
    named = (value or "").strip().lower()
    return named if named in ("python", "ts", "dual") else "ts"
