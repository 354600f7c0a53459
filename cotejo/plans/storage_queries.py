"""Queries of what is stored and read again: the index, the relational store, workbooks, versions, and of two engines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.functions import text
from cotejo.operators import embed, index, rerank, retrieve, shadow, state, stored
from cotejo.operators.timing import Timings
from cotejo.plans import retrieval_queries as r
from cotejo.plans import sqltext as s
from cotejo.plans.search import SearchConfig, search
from cotejo.session import cut, one_process, remove, shared_dir
from cotejo.sources import relational, tables, versions, workbook
from cotejo.sources.tables import table
from cotejo.streaming import analytics, stateful

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return register


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _kept(spark: SparkSession, path: str, df: DataFrame) -> DataFrame:
    """A small result, written for itself, so that the folder it was read from can go."""
    done = cut(df)
    remove(spark, path)
    return done


# --- the stored index -----------------------------------------------------------------------------


@query("bm25_indexed_topk", r.ORACLE_SQL["bm25_topk"])
def bm25_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "index")
    made = stored.build_bm25(r.documents(spark, sf_dir), path)
    return _kept(spark, path, stored.bm25_top(made, r.doc_queries(spark), 10))


@query("tfidf_indexed_topk", r.ORACLE_SQL["tfidf_word_topk"])
def tfidf_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "index")
    made = stored.build_tfidf(r.parts(spark, sf_dir), path, text.word_ngrams, "words")
    return _kept(spark, path, stored.tfidf_top(made, r.part_queries(spark), text.word_ngrams, 10))


_TOKENS = s.bm25_tokens("text")


@query("index_round_trip", f"""WITH seen AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents), postings AS (SELECT DISTINCT doc_id, term FROM seen WHERE length(term) >= 2)
SELECT 'docs' AS part, count(*)::BIGINT AS n FROM documents UNION ALL SELECT 'postings', count(*) FROM postings UNION ALL SELECT 'terms', count(DISTINCT term) FROM postings
UNION ALL SELECT 'most documents of a term', max(n) FROM (SELECT count(*) AS n FROM postings GROUP BY term) UNION ALL SELECT 'vocabulary', count(DISTINCT term) FROM seen WHERE length(term) >= 3""")
def index_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index holds that was saved, checked and loaded again."""
    path, corpus = _folder(spark, "index"), r.documents(spark, sf_dir)
    stored.build_bm25(corpus, path)
    made = stored.load(spark, path)
    if made is None or stored.is_stale(made, corpus):
        raise RuntimeError("a fresh index is not what its manifest says")
    sizes = [
        ("docs", made.docs.agg(F.count("*"))), ("postings", made.blocks.agg(F.sum("n"))), ("terms", made.terms.agg(F.count("*"))),
        ("most documents of a term", made.terms.agg(F.max("df"))), ("vocabulary", made.vocabulary.agg(F.count("*"))),
    ]
    out = None
    for name, df in sizes:
        row = df.toDF("n").select(F.lit(name).alias("part"), F.col("n").cast("long").alias("n"))
        out = row if out is None else out.unionByName(row)
    return _kept(spark, path, out)


@query("indexed_search", r.ORACLE_SQL["integrated_search"])
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of integrated_search, with an index in the texts' place."""
    path, corpus = _folder(spark, "index"), r.parts(spark, sf_dir)
    config = SearchConfig(top_k=10, index=stored.build_bm25(corpus, path))
    return _kept(spark, path, search(corpus, r.part_queries(spark), config))


@query("search_timings")
def search_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each step of a search: its milliseconds and rows."""
    timings = Timings()
    search(r.parts(spark, sf_dir), r.part_queries(spark), SearchConfig(top_k=10, timings=timings))
    return timings.table(spark)


# --- two engines ----------------------------------------------------------------------------------

_SHADOW_RATE = 0.6
_HEX = "list_reduce(list_transform(range(1, 9), lambda i: strpos('0123456789abcdef', substr(md5(query), i, 1)) - 1), lambda a, x: a * 16 + x)"
_FIRST = r.ORACLE_SQL["tfidf_charwb_topk"]
_SECOND = r.ORACLE_SQL["tfidf_word_topk"]


def _shadowed(spark: SparkSession, sf_dir: str) -> shadow.Answer:
    corpus = r.parts(spark, sf_dir)
    first = lambda asked: retrieve.tfidf_top(corpus, asked, text.char_ngrams, 10)
    second = lambda asked: retrieve.tfidf_top(corpus, asked, text.word_ngrams, 10)
    answer = shadow.shadow(r.part_queries(spark), first, second, _SHADOW_RATE)
    if answer.error is not None:
        raise answer.error
    return answer


@query("shadow_search", _FIRST)
def shadow_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first engine's rows, which a comparison beside them leaves as they are."""
    return _shadowed(spark, sf_dir).result


@query("shadow_comparison", f"""WITH a AS ({_FIRST}), b AS ({_SECOND}), q AS (SELECT query_id FROM {r.PART_SQL} WHERE {_HEX} < {int(_SHADOW_RATE * shadow.SPACE)}),
j AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, a.rank AS ra, b.rank AS rb, a.score AS sa, b.score AS sb FROM a FULL JOIN b ON a.query_id = b.query_id AND a.doc_id = b.doc_id),
m AS (SELECT query_id, count(*) FILTER (ra IS NOT NULL AND rb IS NOT NULL) / count(*)::DOUBLE AS jaccard, coalesce(avg(abs(ra - rb)), 0) AS rank_difference, coalesce(avg(abs(sa - sb)), 0) AS score_error, (count(*) FILTER (rb IS NULL))::BIGINT AS only_a, (count(*) FILTER (ra IS NULL))::BIGINT AS only_b FROM j WHERE query_id IN (SELECT query_id FROM q) GROUP BY query_id)
SELECT query_id, round(jaccard, 6) AS jaccard, round(rank_difference, 6) AS rank_difference, round(score_error, 5) AS score_error, only_a, only_b, jaccard >= 0.7 AND rank_difference <= 2.0 AND score_error <= 0.05 AS agrees FROM m""")
def shadow_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _shadowed(spark, sf_dir).comparison
    return found.select("query_id", *[F.round(c, d).alias(c) for c, d in (("jaccard", 6), ("rank_difference", 6), ("score_error", 5))], "only_a", "only_b", "agrees")


# --- the relational store -------------------------------------------------------------------------


def _store(spark: SparkSession) -> relational.Store | relational.Shared:
    """The database that the session names; else one in memory for a local session, and a shared folder on a cluster."""
    url = spark.conf.get("spark.cotejo.jdbc.url", None)
    if url:
        store = relational.Store(url)
    else:
        store = relational.Store.embedded(spark) if one_process(spark) else relational.Shared(spark, _folder(spark, "store"))
    store.create(spark)
    return store


def _read(store: relational.Store | relational.Shared, df: DataFrame) -> DataFrame:
    """A small result of a store; the folder that was made for it goes."""
    return _kept(df.sparkSession, store.path, df) if isinstance(store, relational.Shared) else cut(df)


def _preferences(events: DataFrame) -> DataFrame:
    last = events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return last.select(F.col("user_id").cast("string").alias("user_id"), F.to_json(F.struct("event_id")).alias("data"))


_LAST = "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_id % 2 = {}) WHERE n = 1"


@query("relational_preferences", f"SELECT coalesce(b.user_id, a.user_id)::VARCHAR AS user_id, coalesce(b.event_id, a.event_id) AS event_id FROM ({_LAST.format(0)}) a FULL JOIN ({_LAST.format(1)}) b ON a.user_id = b.user_id")
def relational_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preferences upserted twice: of each user one row is left, the second one's where there is one."""
    store, events = _store(spark), table(spark, sf_dir, "events")
    for half in (0, 1):
        store.upsert(_preferences(events.where(f"event_id % 2 = {half}")), "user_preferences")
    rows = store.read(spark, "user_preferences", by="id", partitions=4)
    return _read(store, rows.select("user_id", F.from_json("data", "event_id long")["event_id"].alias("event_id")))


@query("relational_entities", """SELECT 'search_history' AS entity, count(*)::BIGINT AS n, sum(floor(value))::DOUBLE AS total FROM events
UNION ALL SELECT 'favorites', count(*), round(sum(p_retailprice), 2) FROM part UNION ALL SELECT 'kit_items', count(*), sum(l_quantity)::DOUBLE FROM lineitem WHERE l_linenumber = 1
UNION ALL SELECT 'user_preferences', count(DISTINCT user_id), sum(DISTINCT user_id)::DOUBLE FROM events UNION ALL SELECT 'daily_analytics', count(DISTINCT ts::DATE), count(*)::DOUBLE FROM events""")
def relational_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five tables written by the executors and read back in parallel parts."""
    store, events, part = _store(spark), table(spark, sf_dir, "events"), table(spark, sf_dir, "part")
    user = F.col("user_id").cast("string").alias("user_id")
    store.append(events.select(user, F.col("event_type").alias("query"), F.floor("value").cast("int").alias("results_count")), "search_history")
    store.append(part.select(F.col("p_brand").alias("user_id"), F.col("p_name").alias("item_name"), F.col("p_retailprice").alias("price")), "favorites")
    items = table(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    store.append(items.select(F.col("l_suppkey").cast("string").alias("user_id"), F.col("l_shipmode").alias("item_name") if "l_shipmode" in items.columns else F.lit("item").alias("item_name"), F.col("l_quantity").cast("int").alias("qty")), "kit_items")
    store.upsert(_preferences(events), "user_preferences")
    day = F.to_date("ts").cast("string")
    store.upsert(events.groupBy(day.alias("date")).agg(F.count("*").cast("int").alias("total_queries")).select(F.col("date").alias("id"), "date", "total_queries"), "daily_analytics")
    numbers = {"search_history": F.col("results_count"), "favorites": F.col("price"), "kit_items": F.col("qty"), "user_preferences": F.col("user_id").cast("long"), "daily_analytics": F.col("total_queries")}
    out = None
    for name, number in numbers.items():
        rows = store.read(spark, name, by=None if name == "daily_analytics" else "id", partitions=4)
        sums = rows.agg(F.count("*").alias("n"), F.round(F.sum(number), 2).cast("double").alias("total")).select(F.lit(name).alias("entity"), "n", "total")
        out = sums if out is None else out.unionByName(sums)
    return _read(store, out)


# --- files ----------------------------------------------------------------------------------------


@query("workbook_round_trip", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def workbook_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products written as a folder of workbooks, and read again as quote rows, which are text."""
    path = _folder(spark, "workbooks")
    columns = ["p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"]
    workbook.write_workbooks(table(spark, sf_dir, "part").select(*columns).repartition(4, "p_partkey"), path, "Itens")
    rows = workbook.read_workbooks(spark, path, {c: c for c in columns}, "Itens")
    kinds = dict(table(spark, sf_dir, "part").dtypes)
    return _kept(spark, path, rows.select(*[F.col(c).cast(kinds[c]).alias(c) for c in columns]))


@query("versioned_corpus", """SELECT 'first' AS version, p_partkey FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 'second', p_partkey FROM part UNION ALL SELECT 'rolled back', p_partkey FROM part WHERE p_size % 2 = 0""")
def versioned_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version, the next one, the first read by its name meanwhile, and the current one after a rollback."""
    kept = versions.Versions(spark, _folder(spark, "versions"))
    part = table(spark, sf_dir, "part")
    first = kept.write(part.where("p_size % 2 = 0").select("p_partkey", "p_name"))
    kept.write(part.select("p_partkey", "p_name"))
    shown = [("first", kept.read(first)), ("second", kept.read())]
    kept.rollback()
    shown.append(("rolled back", kept.read()))
    out = None
    for name, df in shown:
        named = df.select(F.lit(name).alias("version"), "p_partkey")
        out = named if out is None else out.unionByName(named)
    return _kept(spark, kept.path, out)


@query("csv_round_trip", "SELECT p_partkey::VARCHAR AS id, p_name AS name, CASE WHEN p_size % 5 = 0 THEN 'N/A' ELSE p_brand END AS brand FROM part")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "csv")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).alias("brand"))
    tables.write_csv(rows, path)
    return _kept(spark, path, tables.read_quotes(spark, path, {"id": "id", "name": "name", "brand": "brand"}).drop("row_idx"))


@query("corpus_shapes", "SELECT shape, p_partkey::VARCHAR AS id, p_name AS text, p_size::DOUBLE AS life_months FROM part CROSS JOIN (VALUES ('array'), ('envelope')) AS v(shape)")
def corpus_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products as JSON corpora, as an array in each file and inside an envelope, read to one schema."""
    path = _folder(spark, "corpus")
    p = table(spark, sf_dir, "part")
    old = F.struct(F.col("p_partkey").alias("groupId"), F.col("p_name").alias("groupDescription"), F.col("p_size").alias("vida_util_meses"))
    new = F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("text"), F.struct(F.struct(F.col("p_size").alias("display")).alias("vidaUtilMeses")).alias("metrics"))
    out = None
    for shape, document in (("array", old), ("envelope", new)):
        # a file for every thousand products or so
        listed = p.groupBy(F.floor(F.col("p_partkey") / 1000).alias("file")).agg(F.collect_list(document).alias("d"))
        line = F.to_json("d") if shape == "array" else F.to_json(F.struct(F.struct(F.lit("3.0.0").alias("version")).alias("metadata"), F.col("d").alias("corpus")))
        listed.select(line.alias("value")).repartition(4).write.option("lineSep", "\n").text(f"{path}/{shape}")
        rows = _one_each(spark, f"{path}/{shape}").select(F.lit(shape).alias("shape"), "id", "text", "life_months")
        out = rows if out is None else out.unionByName(rows)
    return _kept(spark, path, out)


def _one_each(spark: SparkSession, path: str) -> DataFrame:
    """Corpora that stand a line each in the files of a folder, as read_corpus reads whole files."""
    raw = spark.read.json(path)
    return tables.normalize_corpus(raw.select(F.explode("corpus").alias("d")).select("d.*") if "corpus" in raw.columns else raw)


@query("favourites_round_trip", """SELECT p_name AS name, p_type AS description, CASE WHEN p_size % 4 = 0 THEN 'N/A' ELSE p_retailprice::DECIMAL(12, 2)::VARCHAR END AS price, 'N/A' AS brand, (p_size % 11 * 10)::VARCHAR AS confidence FROM part""")
def favourites_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Favourites as a spreadsheet reads them: a byte order mark, whole percentages, N/A for what is missing."""
    path, p = _folder(spark, "favourites"), table(spark, sf_dir, "part")
    price = F.when(F.col("p_size") % 4 != 0, F.col("p_retailprice").cast("decimal(12,2)"))
    none = F.lit(None).cast("string")
    rows = p.select(F.col("p_name").alias("name"), F.col("p_type").alias("description"), price.alias("price"), none.alias("life_months"), none.alias("maintenance"), (F.col("p_size") % 11 / 10).alias("confidence"), none.alias("brand"))
    tables.write_favourites(rows, path)
    back = {old: new for old, new in tables.FAVOURITES.items() if new in ("name", "description", "price", "brand", "confidence")}
    return _kept(spark, path, tables.read_quotes(spark, path, back).drop("row_idx"))


@query("cart_figures", "SELECT count(*)::BIGINT AS lines, sum(l_quantity)::BIGINT AS units, round(sum(l_extendedprice * l_quantity), 2) AS value, round(sum(l_extendedprice * l_quantity) / sum(l_quantity)::BIGINT, 2) AS mean_price FROM lineitem")
def cart_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.cart_summary(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity")


_EXTRA = ["Esfregão", "WIDGET", "", "zzz"]


@query("vocabulary_appended", f"""WITH seen AS (SELECT p_partkey AS doc_id, unnest({s.bm25_tokens('p_name')}) AS term, unnest(range(len({s.bm25_tokens('p_name')}))) AS pos FROM part),
vocab AS (SELECT term, min((doc_id, pos)) AS ord FROM seen WHERE length(term) >= 3 GROUP BY term)
SELECT term, false AS added FROM vocab UNION ALL SELECT DISTINCT lower(x), true FROM (SELECT unnest({s.listed(_EXTRA)}) AS x) WHERE x <> '' AND lower(x) NOT IN (SELECT term FROM vocab)""")
def vocabulary_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary that was stored and loaded, with more terms behind its own."""
    path = _folder(spark, "vocabulary")
    index.save_vocabulary(index.vocabulary(r.parts(spark, sf_dir)), path)
    more = spark.createDataFrame([(x,) for x in _EXTRA], "term string")
    rows = index.with_terms(index.load_vocabulary(spark, path), more)
    return _kept(spark, path, rows.select("term", (F.col("ord.doc_id") == 1 << 62).alias("added")))


@query("abbreviations_round_trip", f"SELECT kind, count(*)::BIGINT AS n FROM ({r.ORACLE_SQL['abbrev_compile']}) GROUP BY kind")
def abbreviations_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compiled dictionary, stored as one JSON object as searches load it."""
    path = _folder(spark, "abbreviations")
    compiled = r.QUERIES["abbrev_compile"](spark, sf_dir).select(F.col("kind").alias("k"), F.struct("key", "value").alias("e"))
    maps = [F.collect_list(F.when(F.col("k") == kind, F.col("e"))).alias(kind) for kind in ("exact", "token", "expand")]
    compiled.agg(*maps).coalesce(1).write.json(path)
    known = tables.read_abbreviations(spark, path)
    remove(spark, path)
    return spark.createDataFrame([(kind, len(entries)) for kind, entries in (known or {}).items() if entries], "kind string, n long")


@query("listed_cross", "SELECT a.p_partkey, coalesce(b.score, 0.0)::DOUBLE AS score FROM part a LEFT JOIN (SELECT lower(p_name) AS n, max(p_size / 50.0) AS score FROM part WHERE p_size % 2 = 0 GROUP BY 1) b ON lower(a.p_name) = b.n")
def listed_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross scores that are known for pairs of texts, found by the normalised pair."""
    p = table(spark, sf_dir, "part")
    pairs = p.where("p_size % 2 = 0").select(F.lit("  MOP ").alias("query"), F.upper("p_name").alias("doc"), (F.col("p_size") / 50.0).alias("score"))
    rows = rerank.listed_cross(p.select("p_partkey", F.lit(" mop").alias("query"), F.col("p_name").alias("text")), pairs)
    return rows.select("p_partkey", F.col("cross").cast("double").alias("score"))


@query("grouped_by_confidence", """SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC NULLS LAST, doc_id)::INTEGER AS rank
FROM (SELECT l_orderkey AS query_id, l_partkey * 10 + l_linenumber AS doc_id, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity / 50.0 END AS confidence FROM lineitem)""")
def grouped_by_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a batch of queries, ranked anew within each."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("doc_id"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity") / 50.0).alias("confidence"))
    return state.ranked_by_confidence(rows).select("query_id", "doc_id", "rank")


@query("embedding_resumed", "SELECT p_partkey AS doc_id, true AS there, 'StandIn' AS provider FROM part")
def embedding_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job over one half of the products, then over all of them: the second embeds only what is missing."""
    path, corpus = _folder(spark, "embeddings"), r.parts(spark, sf_dir)
    provider = embed.StandIn(16)
    embed.embedding_job(corpus.where("doc_id % 2 = 0"), provider, path, waves=2)
    counts = embed.embedding_job(corpus, provider, path, waves=2)
    if counts["embedded"] + counts["there"] != counts["texts"]:
        raise RuntimeError(f"texts were lost: {counts}")
    rows = embed.embedded(corpus, path).select("doc_id", (F.size("embedding") == 16).alias("there"), "provider")
    return _kept(spark, path, rows)


# --- streams with state -----------------------------------------------------------------------------


@query("flushed_analytics", "SELECT count(*)::BIGINT AS total_queries, (count(*) FILTER (event_type = 'error'))::BIGINT AS zero_result_queries, round(sum(value), 3) AS latency_sum FROM events")
def flushed_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream of events has flushed when it was stopped; its days are those of the flush, so they are added up."""
    path = _folder(spark, "flushing")
    events = analytics.events_of(spark, sf_dir).select("event_id", (F.col("event_type") == "error").alias("zero"), F.col("value").cast("double").alias("latency"))
    flushing = stateful.Flushing(spark, path)
    flushing.stop(events)
    sums = [F.sum(c).alias(c) for c in ("total_queries", "zero_result_queries")]
    return _kept(spark, path, flushing.daily().agg(*sums, F.round(F.sum("latency_sum"), 3).alias("latency_sum")))


_MOST, _SECONDS = 3, 7200


@query("rate_limited", f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts::TIMESTAMP) AS t FROM events),
starts AS (SELECT user_id, min(t) AS s FROM e GROUP BY user_id UNION ALL SELECT e.user_id, min(t) FROM starts JOIN e ON e.user_id = starts.user_id AND e.t >= starts.s + {_SECONDS * 1_000_000} GROUP BY e.user_id),
w AS (SELECT event_id, e.user_id, row_number() OVER (PARTITION BY e.user_id, s ORDER BY t, event_id) AS place FROM e JOIN starts ON starts.user_id = e.user_id AND t >= s AND t < s + {_SECONDS * 1_000_000})
SELECT event_id, user_id, place FROM w WHERE place > {_MOST}""")
def rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests that a limit turns away, of a stream of all events."""
    path = _folder(spark, "limit")
    stream = analytics.events_of(spark, sf_dir).select("event_id", "user_id", "ts")
    rows = stateful.drained(spark, stateful.limited(stream, _MOST, _SECONDS), path)
    return _kept(spark, path, rows.where("not allowed").select("event_id", "user_id", "place"))
