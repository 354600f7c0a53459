"""Inverted index and TF-IDF vectors as DataFrames, and their storage.

An index is three tables: postings (doc_id, term, tf), docs (doc_id, doc_len) and terms (term, df).
For a batch of queries that is all the corpus will see, ``retrieve`` reads texts directly instead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.functions import text as t
from cotejo.session import cut

# Parameters of the lexical score.
K1, B, MIN_TOKEN = 1.5, 0.75, 2
FORMAT_VERSION = 1
#: Most rows that are broadcast, and most characters in them; larger sides are joined by shuffling.
BROADCAST_ROWS, BROADCAST_CHARS = 50_000, 64 << 20


def small(df: DataFrame, most: int = BROADCAST_ROWS, chars: int = BROADCAST_CHARS) -> DataFrame:
    """The same rows, to be broadcast if they are few and short, which is counted first."""
    size = F.coalesce(F.sum(F.length(F.struct("*").cast("string"))), F.lit(0))
    rows, length = df.limit(most + 1).agg(F.count(F.lit(1)), size).first()
    return F.broadcast(df) if rows <= most and length <= chars else df


def as_small_as(df: DataFrame, bound: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Like ``small`` for rows that can't be more than those of ``bound``, which is counted in their place."""
    return F.broadcast(df) if bound.limit(most + 1).count() <= most else df


@dataclass
class Index:
    postings: DataFrame
    docs: DataFrame
    terms: DataFrame


def build(corpus: DataFrame, min_token: int = MIN_TOKEN) -> Index:
    """Of ``corpus`` (doc_id, text). Tokens below the least length count in a document's length only."""
    tokens = corpus.select("doc_id", t.bm25_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    docs = tokens.select("doc_id", F.size("tokens").cast("long").alias("doc_len"))
    kept = tokens.select("doc_id", F.explode(F.filter("tokens", lambda x: F.length(x) >= min_token)).alias("term"))
    postings = kept.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    terms = postings.groupBy("term").agg(F.count("*").alias("df"))
    return Index(postings, docs, terms)


def stats(docs: DataFrame) -> DataFrame:
    """One row: n documents, avgdl their mean length (0 if there are none)."""
    return docs.agg(F.count("*").alias("n"), F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avgdl"))


def vocabulary(corpus: DataFrame, least: int = 3) -> DataFrame:
    """(term, ord): distinct lower-case tokens from a length on; ord is where a term was first seen."""
    seen = corpus.select("doc_id", F.posexplode(t.bm25_tokens(F.coalesce("text", F.lit("")))).alias("pos", "term")).where(F.length("term") >= least)
    return seen.groupBy("term").agg(F.min(F.struct("doc_id", "pos")).alias("ord"))


def with_terms(known: DataFrame, terms: DataFrame) -> DataFrame:
    """A vocabulary (term, ord) with more terms (column term), lower-case; those it has already stay where they are, others come last."""
    last = F.struct(F.lit(1 << 62).alias("doc_id"), F.lit(0).alias("pos"))
    fresh = terms.select(F.lower("term").alias("term")).where("term <> ''").distinct().join(known, "term", "left_anti")
    return known.unionByName(fresh.select("term", last.cast(known.schema["ord"].dataType).alias("ord")))


def save_vocabulary(known: DataFrame, path: str) -> None:
    known.write.mode("overwrite").parquet(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save(index: Index, path: str) -> None:
    """Writes the tables and, last, a manifest with the version and a checksum over each table."""
    spark = index.docs.sparkSession
    sums = []
    for name in ("postings", "docs", "terms"):
        table = getattr(index, name)
        table.write.mode("overwrite").parquet(f"{path}/{name}")
        sums.append(_checksum(spark.read.parquet(f"{path}/{name}")).select(F.lit(name).alias("table"), "rows", "checksum"))
    manifest = sums[0].union(sums[1]).union(sums[2]).withColumn("version", F.lit(FORMAT_VERSION))
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def _checksum(table: DataFrame) -> DataFrame:
    """Rows and a checksum that doesn't depend on their order."""
    hashed = table.select(F.xxhash64(*sorted(table.columns)).cast("decimal(38,0)").alias("h"))
    total = F.concat_ws(":", F.count("*").cast("string"), F.coalesce(F.sum("h"), F.lit(0)).cast("string"))
    return hashed.agg(F.count("*").alias("rows"), F.sha2(total.cast("binary"), 256).alias("checksum"))


def load(spark: SparkSession, path: str, verify: bool = True) -> Index | None:
    """The stored index, or None if it is missing, of another version or doesn't have its checksums."""
    from pyspark.errors import AnalysisException

    try:
        manifest = {r["table"]: r for r in spark.read.json(f"{path}/manifest").collect()}
        tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("postings", "docs", "terms")}
    except AnalysisException:
        return None
    if set(manifest) != set(tables) or any(r["version"] != FORMAT_VERSION for r in manifest.values()):
        return None
    if verify and any(_checksum(tables[name]).first()["checksum"] != manifest[name]["checksum"] for name in tables):
        return None
    return Index(**tables)


def is_stale(index: Index, corpus: DataFrame) -> bool:
    """Whether the index has another number of documents than the corpus."""
    return index.docs.count() != corpus.count()


@dataclass
class Weights:
    """A corpus' terms by document: counts (doc_id, term, tf) and terms (term, idf), which are stored."""

    counts: DataFrame
    idf: DataFrame

    def vectors(self, terms: DataFrame) -> DataFrame:
        """(doc_id, term, w): of the given terms (column term, few) the weights in vectors of length 1.

        A document's rows are grouped once, for its length and for the terms asked, so no side of a join
        has a row for each document.
        """
        asked = small(terms.select("term").distinct().withColumn("asked", F.lit(True)))
        raw = self.counts.join(kept_apart(self.idf), "term").select("doc_id", "term", (F.col("tf") * F.col("idf")).alias("raw"))
        raw = raw.join(asked, "term", "left")
        own = F.collect_list(F.when(F.col("asked"), F.struct("term", "raw"))).alias("own")
        docs = raw.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"), own).where(F.size("own") > 0)
        return docs.select("doc_id", "norm", F.explode("own").alias("e")).select("doc_id", "e.term", (F.col("e.raw") / F.col("norm")).alias("w"))


def kept_apart(df: DataFrame) -> DataFrame:
    """The side of a join that is broadcast only if its rows, counted, are few: Spark's own choice goes by the size of files,
    from which the rows that a text is exploded to don't show."""
    found = small(df)
    return df.hint("merge") if found is df else found


def tfidf(corpus: DataFrame, grams: Column) -> Weights:
    """TF-IDF of (doc_id, ...; ids without repeats) over the terms that ``grams`` makes: idf is ln((n + 1) / (df + 1)) + 1.

    A document's terms are counted in its own row, so only terms and lengths are shuffled, and vectors are
    made for the terms that somebody asks for.
    """
    counts = corpus.select("doc_id", F.explode(t.counted(grams)).alias("e")).select("doc_id", "e.term", "e.tf")
    n = corpus.count()
    idf = counts.groupBy("term").agg(F.count("*").alias("df")).select("term", (F.log((F.lit(n) + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))
    return Weights(counts, cut(idf))
