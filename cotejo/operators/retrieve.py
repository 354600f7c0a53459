"""Retrieval: BM25, TF-IDF, hybrid and dense, for a batch of queries at once.

``queries`` is (query_id, query). All rankings end in the document id, so they are the same in
every run; scores are rounded before they are ranked, so the order of summation can't swap rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cotejo.functions import text as t
from cotejo.operators.index import K1, MIN_TOKEN, B, as_small_as, small, tfidf
from cotejo.session import cut

DIGITS = 6
#: Vectors that a dense search takes as queries in one block.
MOST_QUERIES = 4_096
#: Most terms of a batch that are named in an expression; more are joined.
LISTED = 1_000
#: Vectors of a block of the grid, and of one matrix product in it.
CELL_VECTORS, SLICE = 16_384, 2_048
#: Scores that a worker holds at once: 16 MB, however many queries there are.
CELLS = 1 << 21
# Weights of the hybrid lexical score and its penalties.
HYBRID, HYBRID_SINGLE = (0.60, 0.25, 0.15), (0.75, 0.15, 0.10)
ANCHOR_PENALTY, HEAD_PENALTY, SINGLE_PENALTY, ANCHOR_LENGTH, ANCHORS = 0.8, 0.9, 0.225, 3, 5


def top_k(scored: DataFrame, k: int | Column, *ties: str, by: str = "score", group: str = "query_id") -> DataFrame:
    """The k best rows of each group, with their rank; a window limit, so partitions hand on k rows each."""
    order = Window.partitionBy(group).orderBy(F.desc(by), *(ties or ("doc_id",)))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25(corpus: DataFrame, queries: DataFrame, k1: float = K1, b: float = B, min_token: int = MIN_TOKEN) -> DataFrame:
    """(query_id, doc_id, score) of every document that has a term of a query.

    Of a text only its length and the counts of the queries' own terms leave its row, if they are few enough
    to be named there. Ids are without repeats. A term that a query repeats counts as often; terms
    below the least length match nothing.
    """
    asked = queries.select("query_id", F.explode(t.bm25_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    asked = asked.where(F.length("term") >= min_token)
    asked = cut(asked)
    wanted_terms = [r["term"] for r in asked.select("term").distinct().limit(LISTED + 1).collect()]
    tokens = corpus.select("doc_id", t.bm25_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    lengths = tokens.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    own = F.filter("tokens", lambda w: w.isin(wanted_terms)) if len(wanted_terms) <= LISTED else F.col("tokens")
    hits = tokens.select("doc_id", F.size("tokens").alias("doc_len"), F.explode(t.counted(own)).alias("e")).select("doc_id", "doc_len", "e.term", "e.tf")
    postings = hits if len(wanted_terms) <= LISTED else hits.join(small(asked.select("term").distinct()), "term", "left_semi")
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(lengths)).select("term", "avgdl", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0).alias("idf"))
    wanted = asked.join(idf, "term")
    matched = postings.join(as_small_as(wanted, asked), "term")
    weight = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * (1.0 - b + b * F.col("doc_len") / F.col("avgdl")))
    return matched.groupBy("query_id", "doc_id").agg(F.round(F.sum(weight), DIGITS).alias("score"))


def bm25_variants(corpus: DataFrame, variants: DataFrame, per_variant: int, k: int) -> DataFrame:
    """Of (query_id, ord, query, weight): each variant's best documents, then the weighted sum over variants."""
    named = variants.select(F.concat_ws("#", "query_id", "ord").alias("variant"), "query_id", "weight", "query")
    scored = bm25(corpus, named.select(F.col("variant").alias("query_id"), "query"))
    best = top_k(scored, per_variant).select(F.col("query_id").alias("variant"), "doc_id", "score")
    summed = best.join(small(named.select("variant", "query_id", "weight")), "variant").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("score") * F.col("weight")), DIGITS).alias("score"))
    return top_k(summed, k)


def query_vectors(queries: DataFrame, grams: Column, idf: DataFrame) -> DataFrame:
    """Unit vectors of queries over the terms that the corpus has."""
    counts = queries.select("query_id", F.explode(grams).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("tf"))
    raw = counts.join(idf.hint("merge"), "term").select("query_id", "term", (F.col("tf") * F.col("idf")).alias("raw"))
    norms = raw.groupBy("query_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norms, "query_id").select("query_id", "term", (F.col("raw") / F.col("norm")).alias("qw"))


def tfidf_scores(corpus: DataFrame, queries: DataFrame, grams) -> DataFrame:
    """(query_id, doc_id, score): cosine of TF-IDF vectors; ``grams`` makes the terms of a text column."""
    weights = tfidf(corpus.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), grams(F.col("text")))
    asked = cut(query_vectors(queries, grams(F.col("query")), weights.idf))
    return weights.vectors(asked).join(as_small_as(asked, asked), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("w") * F.col("qw")), DIGITS).alias("score"))


def tfidf_top(corpus: DataFrame, queries: DataFrame, grams, k: int, min_score: float = 0.0) -> DataFrame:
    """Best documents by cosine. With a least score of 0, documents without a match fill up the list."""
    scored = tfidf_scores(corpus, queries, grams)
    if min_score <= 0:
        # Only the k smallest ids can fill a list up, so no query meets all documents.
        fill = small(queries.select("query_id")).crossJoin(F.broadcast(corpus.select("doc_id").orderBy("doc_id").limit(2 * k))).withColumn("score", F.lit(0.0))
        # scores are never negative, so a document that fills up and has a score keeps the score
        every = scored.unionByName(fill).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
        return top_k(every, k)
    return top_k(scored.where(F.col("score") >= min_score), k)


def tfidf_hybrid(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Character and word cosine and the share of anchor words, with penalties for missing anchors and head.

    Anchors are a query's five rarest words of three letters or more ("mop" first); the head is its
    first such word. Rows without any match in characters, words or anchors are left out.
    """
    folded = queries.select("query_id", t.strip_accents(F.col("query")).alias("query"))
    chars = tfidf_scores(corpus, folded, t.char_ngrams).withColumnRenamed("score", "char_score")
    terms = tfidf_scores(corpus, folded, t.word_ngrams).withColumnRenamed("score", "word_score")
    docs = corpus.select("doc_id", F.array_distinct(t.simple_tokens(F.coalesce("text", F.lit("")))).alias("doc_tokens"))
    n = docs.agg(F.count("*").alias("n"))
    idf = docs.select(F.explode("doc_tokens").alias("term")).groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("term", (F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))
    parsed = folded.select("query_id", t.simple_tokens(F.col("query")).alias("q"))
    listed = parsed.select("query_id", F.posexplode("q").alias("pos", "term")).where(F.length("term") >= ANCHOR_LENGTH).join(idf.hint("merge"), "term", "left")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.col("term") == "mop"), F.desc(F.round(F.coalesce("idf", F.lit(0.0)), DIGITS)), "pos")
    ranked = listed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= ANCHORS)
    anchors = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "term", F.coalesce("idf", F.lit(1.0)).alias("idf")))).alias("anchors"))
    asked = parsed.join(anchors, "query_id", "left").select(
        "query_id", (F.size("q") <= 1).alias("single"), F.coalesce("anchors", F.array().cast("array<struct<place:int,term:string,idf:double>>")).alias("anchors"),
        F.try_element_at(F.filter("q", lambda x: (F.length(x) >= ANCHOR_LENGTH) & ~F.regexp_like(x, F.lit(r"^\d+$"))), F.lit(1)).alias("head"),
    )
    found = chars.join(terms, ["query_id", "doc_id"], "full")
    rows = found.join(docs.hint("merge"), "doc_id").join(as_small_as(asked, parsed), "query_id")
    total = F.aggregate("anchors", F.lit(0.0), lambda s, a: s + a["idf"])
    once = F.filter("anchors", lambda a, i: ~F.exists(F.slice(F.col("anchors"), F.lit(1), i), lambda e: e["term"] == a["term"]))
    overlap = F.aggregate(F.filter(once, lambda a: F.array_contains(F.col("doc_tokens"), a["term"])), F.lit(0.0), lambda s, a: s + a["idf"])
    share = F.when(total > 0, overlap / total).otherwise(0.0)
    weights = [F.when(F.col("single"), s).otherwise(m) for m, s in zip(HYBRID, HYBRID_SINGLE, strict=True)]
    score = weights[0] * F.coalesce("char_score", F.lit(0.0)) + weights[1] * F.coalesce("word_score", F.lit(0.0)) + weights[2] * share
    anchored = F.exists("anchors", lambda a: F.array_contains(F.col("doc_tokens"), a["term"]))
    score = F.when((F.size("anchors") > 0) & ~F.col("single") & ~anchored, score * (1.0 - ANCHOR_PENALTY)).otherwise(score)
    head = F.col("head")
    alike = F.exists("doc_tokens", lambda d: (F.length(d) >= ANCHOR_LENGTH) & (head.contains(d) | d.contains(head) | (F.substring(head, 1, ANCHOR_LENGTH) == F.substring(d, 1, ANCHOR_LENGTH))))
    kept = F.when(F.col("single"), F.when(alike, 1.0).otherwise(1.0 - SINGLE_PENALTY)).otherwise(F.when(F.array_contains("doc_tokens", head), 1.0).otherwise(1.0 - HEAD_PENALTY))
    score = F.when(head.isNotNull(), score * kept).otherwise(score)
    return top_k(rows.select("query_id", "doc_id", F.round(score, DIGITS).alias("score")), k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either has no length; an error where their sizes differ."""
    both = norm(a) * norm(b)
    safe = F.when(both > 0, dot(a, b) / both).otherwise(0.0)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in size")).cast("double")).otherwise(safe)


def unit(a: Column) -> Column:
    return t.let(norm(a), lambda size: F.when(size < 1e-12, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / size)))


def valid_vector(a: Column, size: int) -> Column:
    """Of the right size, all finite, not all zero."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(a) == size) & finite & (norm(a) > 0), F.lit(False))


def dense_top(vectors: DataFrame, queries: DataFrame, k: int, size: int = 64) -> DataFrame:
    """Best of (doc_id, embedding) by cosine for each of (query_id, query_vector).

    Up to ``MOST_QUERIES`` queries are sent to the vectors, which stay where they are: one matrix product a
    batch, and a task hands on the k best of each query. More queries are a grid: blocks of
    queries and blocks of vectors are shuffled to each other, in one plan, and nothing passes the driver.
    """
    docs = vectors.where(valid_vector(F.col("embedding"), size)).select("doc_id", unit(F.col("embedding")).alias("u"))
    asked = queries.where(valid_vector(F.col("query_vector"), size)).select("query_id", unit(F.col("query_vector")).alias("q"))
    asked = cut(asked)
    number = asked.count()
    schema = T.StructType([asked.schema["query_id"], docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    if number <= MOST_QUERIES:
        return top_k(docs.mapInPandas(_best_of_block(asked.toPandas(), k), schema), k)
    # blocks of queries meet blocks of vectors, each pair in a task; a cell hands on the k best of its queries
    rows, columns = -(-number * 2 // MOST_QUERIES), max(1, -(-docs.count() // CELL_VECTORS))
    block = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = docs.select("doc_id", "u", block("doc_id", columns).alias("column"), every(rows).alias("row"))
    right = asked.select("query_id", "q", block("query_id", rows).alias("row"), every(columns).alias("column"))

    def cell(vectors: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        slices = (vectors.iloc[at : at + SLICE] for at in range(0, len(vectors), SLICE))
        best = list(_best_of_block(block, k)(slices)) if len(block) else []
        return best[0] if best else pd.DataFrame({f.name: [] for f in schema}).astype({"score": float})

    return top_k(left.groupBy("row", "column").cogroup(right.groupBy("row", "column")).applyInPandas(cell, schema), k)


def _best_of_block(block: pd.DataFrame, k: int):
    names = block["query_id"].to_numpy()
    asked = np.vstack(block["q"].to_numpy()) if len(block) else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame({"place": [], "doc_id": [], "score": []})
        reached = np.full(len(names), -2.0)  # of each query the k-th best so far, if there are k
        rows = max(1, CELLS // max(1, len(names)))
        for batch in (some.iloc[at : at + rows] for some in batches for at in range(0, len(some), rows)):
            if asked is None:
                continue
            score = np.vstack(batch["u"].to_numpy()) @ asked.T
            np.round(score, DIGITS, out=score)
            score += 0.0
            # of each query the k-th best of these rows, and what is as good
            least = np.maximum(reached, np.partition(score, -k, axis=0)[-k]) if len(batch) > k else reached
            row, place = np.nonzero(score >= least)
            if not len(row):
                continue
            more = pd.DataFrame({"place": place, "doc_id": batch["doc_id"].to_numpy()[row], "score": score[row, place]})
            held = pd.concat((held, more)) if len(held) else more
            groups = held.sort_values(["place", "score", "doc_id"], ascending=[True, False, True]).groupby("place")
            held, last = groups.head(k), groups.nth(k - 1)
            reached[last["place"].to_numpy()] = last["score"].to_numpy()
        if len(held):
            yield pd.DataFrame({"query_id": names[held["place"].to_numpy()], "doc_id": held["doc_id"].to_numpy(), "score": held["score"].to_numpy()})

    return run


def alpha_hybrid(lexical: DataFrame, semantic: DataFrame, alpha: float, k: int) -> DataFrame:
    """alpha times the lexical score by its maximum, and the rest of the semantic one; missing ones are 0."""
    alpha = min(1.0, max(0.0, alpha))

    def scaled(df: DataFrame, name: str) -> DataFrame:
        top = F.greatest(F.max("score").over(Window.partitionBy("query_id")), F.lit(0.0001))
        return df.select("query_id", "doc_id", (F.col("score") / top).alias(name))

    both = scaled(lexical, "lexical").join(scaled(semantic, "semantic"), ["query_id", "doc_id"], "full")
    both = both.fillna(0.0, ["lexical", "semantic"])
    score = alpha * F.col("lexical") + (1.0 - alpha) * F.col("semantic")
    return top_k(both.select("query_id", "doc_id", F.round(score, DIGITS).alias("score")), k)
