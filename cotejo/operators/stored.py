"""A stored index that retrieval reads: postings in blocks, each with its largest impact.

Both lexical scores are sums over a query's terms of the term's weight in the query and its impact in
the document. An index holds the impacts:

    blocks  (bucket, term, segment, n, most, doc_ids, impacts)  partitioned by bucket, each file of few segments and ordered by term
    terms   (bucket, term, df, idf)                             partitioned by bucket, ordered by term
    docs    (doc_id, doc_len)
    vocabulary (term, ord), for misspelt words
    manifest  kind, version, parameters, rows and checksums; written last

A segment is a set of documents of about equal length, so the impacts of a term are alike within it and
the largest one is a tight bound. A query reads the buckets of its own terms; bounds and sizes come
first, without the lists. The segments with the best bounds are scored, which gives a score that the k-th
result has at least, and then only those whose bound reaches it. Nothing is lost: a bound is never
below a score of its segment.

No group of the build grows with the corpus: a block has a document of its segment once at most, and the
documents of a segment are bounded.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cotejo.functions import text as t
from cotejo.operators.index import K1, MIN_TOKEN, B, _checksum, as_small_as, kept_apart, small, vocabulary
from cotejo.operators.retrieve import DIGITS, query_vectors, top_k
from cotejo.session import cut

VERSION = 2
#: Files are cut by this many hashes of terms (more of them for more data); documents of a segment, about.
BUCKETS, SEGMENT = 16, 1_024
#: Most terms or segments that are named in a scan's filter; more are joined.
LISTED = 1_000
#: Tokens whose postings are grouped in one task, about.
TASK_TOKENS = 1_000_000
_TABLES = ("blocks", "terms", "docs", "vocabulary")


@dataclass
class Stored:
    """An opened index: its tables, read lazily, and what its manifest says."""

    blocks: DataFrame
    terms: DataFrame
    docs: DataFrame
    vocabulary: DataFrame
    kind: str
    meta: dict


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _segments(docs: DataFrame, segment: int) -> Callable[[Column, Column], Column]:
    """The segment of a document by its id and length, for ``docs`` (doc_id, doc_len).

    Classes of length, four an octave, are cut by hashes of ids. There are as many classes as lengths
    have octaves times four, so their sizes fit on the driver.
    """
    of_class = lambda doc_len: F.floor(F.log2(doc_len + 1.0) * 4).cast("int")
    sizes = docs.groupBy(of_class(F.col("doc_len")).alias("class")).agg(F.count("*").alias("n")).orderBy("class").collect()
    parts = {r["class"]: -(-r["n"] // segment) for r in sizes} or {0: 1}
    starts = dict(zip(parts, accumulate(parts.values(), initial=0), strict=False))

    def place(doc_id: Column, doc_len: Column) -> Column:
        of = lambda known: F.element_at(F.map_from_arrays(F.array(*map(F.lit, known)), F.array(*[F.lit(v).cast("long") for v in known.values()])), of_class(doc_len))
        return of(starts) + F.pmod(F.xxhash64(doc_id), of(parts))

    return place


def _write_blocks(postings: DataFrame, path: str, buckets: int) -> None:
    """Blocks of ``postings`` (doc_id, segment, term, impact), which are dealt out by segment."""
    entry = F.sort_array(F.collect_list(F.struct("doc_id", "impact")))
    blocks = postings.groupBy(_bucket(F.col("term"), buckets).alias("bucket"), "term", "segment").agg(F.count("*").alias("n"), F.max("impact").alias("most"), entry.alias("e"))
    blocks = blocks.select("bucket", "term", "segment", "n", "most", F.col("e.doc_id").alias("doc_ids"), F.col("e.impact").alias("impacts"))
    # blocks are written where they are made: each file has few segments and is in order of terms
    ordered = blocks.sortWithinPartitions("bucket", "term", "segment")
    ordered.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")


def _opened(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of an index; those that are cut by buckets have no file where nothing was written, so no schema to infer."""
    if name in ("docs", "vocabulary"):
        return spark.read.parquet(f"{path}/{name}")
    if name == "terms":
        return spark.read.schema("term string, df long, idf double, bucket int").parquet(f"{path}/terms")
    kind = spark.read.parquet(f"{path}/docs").schema["doc_id"].dataType.simpleString()
    return spark.read.schema(f"term string, segment long, n long, most double, doc_ids array<{kind}>, impacts array<double>, bucket int").parquet(f"{path}/blocks")


def _finished(corpus: DataFrame, path: str, kind: str, meta: dict) -> Stored:
    """Writes the vocabulary and, last, the manifest, and opens the index."""
    spark = corpus.sparkSession
    vocabulary(corpus).write.mode("overwrite").parquet(f"{path}/vocabulary")
    sums = {name: _checksum(_opened(spark, path, name)).first().asDict() for name in _TABLES}
    manifest = {"version": VERSION, "kind": kind, "meta": json.dumps(meta), "tables": json.dumps(sums)}
    spark.createDataFrame([manifest]).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    opened = load(spark, path, verify=False)
    if opened is None:
        raise RuntimeError(f"the index at {path} can't be read")
    return opened


def _write_terms(df: DataFrame, idf: Column, path: str, buckets: int) -> DataFrame:
    """Writes ``df`` (term, df) with idf by buckets, and reads it again."""
    made = df.select(_bucket(F.col("term"), buckets).alias("bucket"), "term", "df", idf.alias("idf"))
    made.repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    return _opened(df.sparkSession, path, "terms")


def _prepared(corpus: DataFrame, tokens: Column, path: str, segment: int) -> tuple[DataFrame, DataFrame, Callable[[Column, Column], Column]]:
    """Writes docs, and gives them, the corpus' terms (doc_id, doc_len, term, tf) and the segments."""
    listed = corpus.select("doc_id", tokens.alias("tokens"))
    length = F.size("tokens").cast("long").alias("doc_len")
    listed.select("doc_id", length).write.mode("overwrite").parquet(f"{path}/docs")
    docs = corpus.sparkSession.read.parquet(f"{path}/docs")
    found = listed.select("doc_id", length, F.explode(t.counted(F.col("tokens"))).alias("e")).select("doc_id", "doc_len", "e.term", "e.tf")
    return docs, found, _segments(docs, segment)


def _dealt(rows: DataFrame, tokens: int) -> DataFrame:
    """Rows dealt out by segment, to tasks of about as many tokens however many there are."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-tokens // TASK_TOKENS)), "segment")


def build_bm25(corpus: DataFrame, path: str, k1: float = K1, b: float = B, min_token: int = MIN_TOKEN, buckets: int = BUCKETS, segment: int = SEGMENT) -> Stored:
    """Stores the BM25 impacts of ``corpus`` (doc_id, text; ids without repeats) at a path all executors share."""
    spark = corpus.sparkSession
    tokens = t.bm25_tokens(F.coalesce("text", F.lit("")))
    docs, _, place = _prepared(corpus, tokens, path, segment)
    stats = docs.agg(F.count("*").alias("n"), F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avgdl"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("tokens")).first()
    # a text is shorter than its postings, so texts are shuffled by their segments and postings are made and grouped where they arrive
    dealt = _dealt(corpus.select("doc_id", "text", place(F.col("doc_id"), F.size(tokens).cast("long")).alias("segment")), stats["tokens"])
    listed = dealt.select("doc_id", "segment", tokens.alias("tokens"))
    found = listed.select("doc_id", "segment", F.size("tokens").cast("long").alias("doc_len"), F.explode(t.counted(F.col("tokens"))).alias("e")).select("doc_id", "segment", "doc_len", "e.term", "e.tf")
    impact = F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * (1.0 - b + b * F.col("doc_len") / stats["avgdl"]))
    _write_blocks(found.where(F.length("term") >= min_token).select("doc_id", "segment", "term", impact.alias("impact")), path, buckets)
    df = _opened(spark, path, "blocks").groupBy("term").agg(F.sum("n").alias("df"))
    _write_terms(df, F.log((stats["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0), path, buckets)
    meta = {"n": stats["n"], "avgdl": stats["avgdl"], "k1": k1, "b": b, "min_token": min_token, "buckets": buckets, "segment": segment}
    return _finished(corpus, path, "bm25", meta)


def build_tfidf(corpus: DataFrame, path: str, grams: Callable[[Column], Column], name: str, buckets: int = BUCKETS, segment: int = SEGMENT) -> Stored:
    """Stores the unit TF-IDF vectors of ``corpus`` (doc_id, text; ids without repeats) over the terms that ``grams`` makes; name says which."""
    docs, found, place = _prepared(corpus, grams(F.coalesce("text", F.lit(""))), path, segment)
    n = docs.count()
    terms = _write_terms(found.groupBy("term").agg(F.count("*").alias("df")), F.log((n + 1.0) / (F.col("df") + 1.0)) + 1.0, path, buckets)
    raw = found.join(kept_apart(terms.select("term", "idf")), "term").select("doc_id", "doc_len", "term", (F.col("tf") * F.col("idf")).alias("raw"))
    raw = raw.withColumn("norm", F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("doc_id"))))
    impacts = raw.select("doc_id", place(F.col("doc_id"), F.col("doc_len")).alias("segment"), "term", (F.col("raw") / F.col("norm")).alias("impact"))
    _write_blocks(_dealt(impacts, docs.agg(F.coalesce(F.sum("doc_len"), F.lit(0))).first()[0]), path, buckets)
    return _finished(corpus, path, "tfidf", {"n": n, "grams": name, "buckets": buckets, "segment": segment})


def load(spark: SparkSession, path: str, verify: bool = True) -> Stored | None:
    """The index at a path, or None if it is missing, incomplete, of another version or not what its checksums say."""
    try:
        manifest = spark.read.json(f"{path}/manifest").first()
        tables = {name: _opened(spark, path, name) for name in _TABLES}
    except AnalysisException:
        return None
    if manifest is None or set(manifest.asDict()) != {"version", "kind", "meta", "tables"} or manifest["version"] != VERSION:
        return None
    sums = json.loads(manifest["tables"])
    if verify and any(_checksum(tables[name]).first().asDict() != sums.get(name) for name in _TABLES):
        return None
    return Stored(**tables, kind=manifest["kind"], meta=json.loads(manifest["meta"]))


def is_stale(index: Stored, corpus: DataFrame) -> bool:
    """Whether the index has another number of documents than the corpus."""
    return index.meta["n"] != corpus.count()


def _of_terms(table: DataFrame, asked: DataFrame, buckets: int) -> DataFrame:
    """The rows of a table (bucket, term, ...) for the terms of ``asked`` (term): few are named in the scan's filters."""
    named = asked.select("term").distinct()
    first = [r["term"] for r in named.limit(LISTED + 1).collect()]
    if len(first) > LISTED:
        keys = named.select(_bucket(F.col("term"), buckets).alias("bucket"), "term")
        return table.join(small(keys), ["bucket", "term"], "left_semi")
    if not first:
        return table.where(F.lit(False))
    places = table.sparkSession.createDataFrame([(x,) for x in first], "term string").select(_bucket(F.col("term"), buckets).alias("bucket")).distinct()
    return table.where(F.col("bucket").isin([r["bucket"] for r in places.collect()]) & F.col("term").isin(first))


def asked_bm25(index: Stored, queries: DataFrame) -> DataFrame:
    """(query_id, term, weight): a query's terms that the index has, times as often as the query says them."""
    terms = queries.select("query_id", F.explode(t.bm25_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    known = _of_terms(index.terms, terms, index.meta["buckets"]).select("term", "idf")
    return terms.join(known, "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight"))


def asked_tfidf(index: Stored, queries: DataFrame, grams: Callable[[Column], Column]) -> DataFrame:
    """(query_id, term, weight): unit vectors of the queries over the index' terms."""
    made = grams(F.col("query"))
    known = _of_terms(index.terms, queries.select(F.explode(made).alias("term")), index.meta["buckets"]).select("term", "idf")
    return query_vectors(queries, made, known).withColumnRenamed("qw", "weight")


@dataclass
class Found:
    """A ranking, and how many of the segments that hold a term of a query were scored for it."""

    top: DataFrame
    opened: DataFrame


def search(index: Stored, asked: DataFrame, k: int) -> Found:
    """The k best documents of each query of ``asked`` (query_id, term, weight): (query_id, doc_id, score, rank).

    A term that no document has, and a query without terms, give nothing. Ties are ordered by id.
    """
    asked = cut(asked)
    mine = _of_terms(index.blocks, asked, index.meta["buckets"])
    joined = mine.select("term", "segment", "most").join(as_small_as(asked, asked), "term")
    bounds = cut(joined.groupBy("query_id", "segment").agg(F.sum(F.col("weight") * F.col("most")).alias("bound")))
    # k segments have k documents at least
    first = top_k(bounds, k, "segment", by="bound").select("query_id", "segment")
    seen = cut(_scored(mine, asked, cut(first)))
    least = top_k(seen, k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    # scores are rounded, so a bound may lie below the rounded score by half a digit
    able = bounds.join(least.select("query_id", "least"), "query_id", "left").where(F.coalesce(F.col("bound") + 10.0**-DIGITS >= F.col("least"), F.lit(True)))
    rest = cut(able.join(first, ["query_id", "segment"], "left_anti").select("query_id", "segment"))
    top = top_k(seen.unionByName(_scored(mine, asked, rest)), k)
    opened = first.unionByName(rest).groupBy("query_id").agg(F.count("*").alias("opened")).join(bounds.groupBy("query_id").agg(F.count("*").alias("segments")), "query_id")
    return Found(top, opened)


def _scored(mine: DataFrame, asked: DataFrame, segments: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of all documents with a term of the query in its ``segments`` (query_id, segment)."""
    first = [r["segment"] for r in segments.select("segment").distinct().limit(LISTED + 1).collect()]
    if len(first) <= LISTED:
        mine = mine.where(F.col("segment").isin(first) if first else F.lit(False))
    wanted = asked.join(segments, "query_id")
    lists = mine.select("term", "segment", "doc_ids", "impacts").join(small(wanted), ["term", "segment"])
    rows = lists.select("query_id", "weight", F.explode(F.arrays_zip("doc_ids", "impacts")).alias("e"))
    return rows.groupBy("query_id", F.col("e.doc_ids").alias("doc_id")).agg(F.round(F.sum(F.col("weight") * F.col("e.impacts")), DIGITS).alias("score"))


def bm25_top(index: Stored, queries: DataFrame, k: int) -> DataFrame:
    """Like ``top_k(bm25(corpus, queries), k)``, from the index."""
    return search(index, asked_bm25(index, queries), k).top


def bm25_variants(index: Stored, variants: DataFrame, per_variant: int, k: int) -> DataFrame:
    """Like ``retrieve.bm25_variants``, from the index."""
    named = variants.select(F.concat_ws("#", "query_id", "ord").alias("variant"), "query_id", "weight", "query")
    best = bm25_top(index, named.select(F.col("variant").alias("query_id"), "query"), per_variant)
    best = best.select(F.col("query_id").alias("variant"), "doc_id", "score")
    summed = best.join(small(named.select("variant", "query_id", "weight")), "variant").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("score") * F.col("weight")), DIGITS).alias("score"))
    return top_k(summed, k)


def tfidf_top(index: Stored, queries: DataFrame, grams: Callable[[Column], Column], k: int, min_score: float = 0.0) -> DataFrame:
    """Like ``retrieve.tfidf_top``, from the index; with a least score of 0 the smallest ids fill a list up."""
    found = search(index, asked_tfidf(index, queries, grams), k).top.drop("rank")
    if min_score > 0:
        return top_k(found.where(F.col("score") >= min_score), k)
    found = cut(found)
    ids = index.docs.select("doc_id").orderBy("doc_id").limit(2 * k)
    fill = small(queries.select("query_id")).crossJoin(F.broadcast(ids)).withColumn("score", F.lit(0.0))
    return top_k(found.unionByName(fill.join(found, ["query_id", "doc_id"], "left_anti")), k)
