"""Queries of retrieval, rewriting, reranking, confidence and comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.functions import text
from cotejo.operators import compare, embed, rank, rerank, retrieve, rewrite
from cotejo.operators.index import vocabulary
from cotejo.plans import sqltext as s
from cotejo.plans import text_queries
from cotejo.plans.search import SearchConfig, embedding_search, search, smart_search
from cotejo.plans.text_queries import PHRASES
from cotejo.session import cut, spread
from cotejo.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return register


def _values(rows: list[tuple]) -> str:
    cell = lambda v: s.quoted(v) if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows) + ")"


# Queries whose words the generated texts have.
DOC_QUERIES = [(1, "the and with"), (2, "license version the"), (3, "der die und nicht"), (4, "token the the idiot")]
PART_QUERIES = [(1, "red widget"), (2, "hot gear"), (3, "widgt blue"), (4, "bolt"), (5, "red")]
PART_SQL = f"{_values(PART_QUERIES)} AS q(query_id, query)"
DOC_SQL = f"{_values(DOC_QUERIES)} AS q(query_id, query)"


def doc_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DOC_QUERIES, "query_id int, query string")


def part_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PART_QUERIES, "query_id int, query string")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text")))


def _bm25_sql(queries: str, documents: str = "documents") -> str:
    """CTEs ending in scored(query_id, doc_id, score) of queries(query_id, query) over documents(doc_id, text)."""
    return f"""asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({s.bm25_tokens('query')}) AS term FROM {queries}) WHERE length(term) >= 2 GROUP BY query_id, term),
toks AS MATERIALIZED (SELECT doc_id, {s.bm25_tokens('text')} AS tokens FROM {documents}),
stats AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM toks),
postings AS MATERIALIZED (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM toks) WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, dl, term),
freq AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
scored AS (SELECT query_id, doc_id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM asked JOIN postings USING (term) JOIN freq USING (term) CROSS JOIN stats GROUP BY query_id, doc_id)"""


_TOP = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER"


@query("bm25_topk", f"WITH {_bm25_sql(DOC_SQL)} SELECT * FROM (SELECT query_id, doc_id, score, {_TOP} AS rank FROM scored) WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.top_k(retrieve.bm25(documents(spark, sf_dir), doc_queries(spark)), 10)


_VARIANTS = [(1, 1, "the and", 1.0), (1, 2, "with from", 0.6), (2, 1, "der die", 1.0), (2, 2, "license version", 0.6)]


@query("bm25_weighted_variants", f"""WITH {_bm25_sql(f"(SELECT query_id * 10 + ord AS query_id, query FROM {_values(_VARIANTS)} AS v(query_id, ord, query, weight))")},
best AS (SELECT * FROM (SELECT *, {_TOP} AS rank FROM scored) WHERE rank <= 20),
summed AS (SELECT v.query_id, doc_id, round(sum(score * weight), 6)::DOUBLE AS score FROM best JOIN {_values(_VARIANTS)} AS v(query_id, ord, query, weight) ON best.query_id = v.query_id * 10 + v.ord GROUP BY v.query_id, doc_id)
SELECT * FROM (SELECT query_id, doc_id, score, {_TOP} AS rank FROM summed) WHERE rank <= 10""")
def bm25_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants = spark.createDataFrame(_VARIANTS, "query_id int, ord int, query string, weight double")
    return retrieve.bm25_variants(documents(spark, sf_dir), variants, 20, 10)


def _tfidf_sql(name: str, doc_grams: str, query_grams: str, queries: str = PART_SQL) -> str:
    """CTEs ending in <name>_scored(query_id, doc_id, score) over part names."""
    return f"""{name}_tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT p_partkey AS doc_id, unnest({doc_grams}) AS term FROM part) GROUP BY doc_id, term),
{name}_idf AS MATERIALIZED (SELECT term, ln(((SELECT count(*) FROM part) + 1.0) / (count(*) + 1.0)) + 1.0 AS idf FROM {name}_tf GROUP BY term),
{name}_raw AS (SELECT doc_id, term, tf * idf AS raw FROM {name}_tf JOIN {name}_idf USING (term)),
{name}_norm AS (SELECT doc_id, sqrt(sum(raw * raw)) AS norm FROM {name}_raw GROUP BY doc_id),
{name}_q AS (SELECT query_id, term, tf * idf AS raw FROM (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest({query_grams}) AS term FROM {queries}) GROUP BY query_id, term) JOIN {name}_idf USING (term)),
{name}_qn AS (SELECT query_id, sqrt(sum(raw * raw)) AS norm FROM {name}_q GROUP BY query_id),
{name}_scored AS MATERIALIZED (SELECT q.query_id, r.doc_id, round(sum(r.raw / n.norm * q.raw / m.norm), 6) AS score FROM {name}_q q JOIN {name}_raw r USING (term) JOIN {name}_norm n ON n.doc_id = r.doc_id JOIN {name}_qn m ON m.query_id = q.query_id GROUP BY q.query_id, r.doc_id)"""


def _word_grams(x: str) -> str:
    return f"flatten([{s.grams(s.simple_tokens(x), 1)}, {s.grams(s.simple_tokens(x), 2)}])"


def _filled(name: str) -> str:
    return f"(SELECT q.query_id, p.p_partkey AS doc_id, coalesce(x.score, 0.0) AS score FROM {PART_SQL} CROSS JOIN part p LEFT JOIN {name}_scored x ON x.query_id = q.query_id AND x.doc_id = p.p_partkey)"


@query("tfidf_charwb_topk", f"WITH {_tfidf_sql('c', s.char_grams('p_name'), s.char_grams('query'))} SELECT * FROM (SELECT query_id, doc_id, score, {_TOP} AS rank FROM {_filled('c')}) WHERE rank <= 10")
def tfidf_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.tfidf_top(parts(spark, sf_dir), part_queries(spark), text.char_ngrams, 10)


@query("tfidf_word_topk", f"WITH {_tfidf_sql('w', _word_grams('p_name'), _word_grams('query'))} SELECT * FROM (SELECT query_id, doc_id, score, {_TOP} AS rank FROM {_filled('w')}) WHERE rank <= 10")
def tfidf_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.tfidf_top(parts(spark, sf_dir), part_queries(spark), text.word_ngrams, 10)


_QT = s.simple_tokens("query")
_HYBRID_SQL = f"""WITH {_tfidf_sql('c', s.char_grams('p_name'), s.char_grams('strip_accents(query)'))}, {_tfidf_sql('w', _word_grams('p_name'), _word_grams('query'))},
docs AS (SELECT p_partkey AS doc_id, list_distinct({s.simple_tokens('p_name')}) AS d FROM part),
idf AS (SELECT term, ln(((SELECT count(*) FROM part) + 1.0) / (count(*) + 1.0)) + 1.0 AS idf FROM (SELECT unnest(d) AS term FROM docs) GROUP BY term),
qs AS (SELECT query_id, {_QT} AS qt, len({_QT}) <= 1 AS single, list_filter({_QT}, lambda w: length(w) >= 3 AND NOT regexp_matches(w, '^\\d+$'))[1] AS head FROM {PART_SQL}),
listed AS (SELECT query_id, term, pos, idf FROM (SELECT query_id, unnest(qt) AS term, unnest(range(len(qt))) AS pos FROM qs) LEFT JOIN idf USING (term) WHERE length(term) >= 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY term = 'mop' DESC, round(coalesce(idf, 0.0), 6) DESC, pos) AS place FROM listed),
anchors AS (SELECT query_id, term, coalesce(idf, 1.0) AS idf FROM ranked WHERE place <= 5),
totals AS (SELECT query_id, sum(idf) AS total, count(*) AS n FROM anchors GROUP BY query_id),
found AS (SELECT coalesce(c.query_id, w.query_id) AS query_id, coalesce(c.doc_id, w.doc_id) AS doc_id, coalesce(c.score, 0) AS cs, coalesce(w.score, 0) AS ws FROM c_scored c FULL JOIN w_scored w ON c.query_id = w.query_id AND c.doc_id = w.doc_id),
hits AS (SELECT f.query_id, f.doc_id, sum(idf) AS s FROM found f JOIN docs USING (doc_id) JOIN (SELECT DISTINCT query_id, term, idf FROM anchors) a ON a.query_id = f.query_id AND list_contains(d, a.term) GROUP BY f.query_id, f.doc_id),
base AS (SELECT f.query_id, f.doc_id, d, single, head, coalesce(t.n, 0) AS n, h.s AS hit,
    CASE WHEN single THEN 0.75 ELSE 0.6 END * cs + CASE WHEN single THEN 0.15 ELSE 0.25 END * ws + CASE WHEN single THEN 0.1 ELSE 0.15 END * coalesce(h.s / t.total, 0) AS score
  FROM found f JOIN docs USING (doc_id) JOIN qs USING (query_id) LEFT JOIN totals t USING (query_id) LEFT JOIN hits h ON h.query_id = f.query_id AND h.doc_id = f.doc_id),
done AS (SELECT query_id, doc_id, round(score * CASE WHEN n > 0 AND NOT single AND hit IS NULL THEN 1.0 - 0.8 ELSE 1.0 END * CASE WHEN head IS NULL THEN 1.0
    WHEN single THEN CASE WHEN len(list_filter(d, lambda t: length(t) >= 3 AND (contains(head, t) OR contains(t, head) OR left(head, 3) = left(t, 3)))) > 0 THEN 1.0 ELSE 1.0 - 0.225 END
    WHEN list_contains(d, head) THEN 1.0 ELSE 1.0 - 0.9 END, 6)::DOUBLE AS score FROM base)
SELECT * FROM (SELECT query_id, doc_id, score, {_TOP} AS rank FROM done) WHERE rank <= 10"""


@query("tfidf_hybrid_topk", _HYBRID_SQL)
def tfidf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.tfidf_hybrid(parts(spark, sf_dir), part_queries(spark), 10)


_COSINE = "list_cosine_similarity(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE))"
_DENSE_SQL = f"SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round({_COSINE}, 6) AS score FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 100 = 0"


def dense(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return retrieve.dense_top(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), asked, k)


@query("semantic_topk", f"SELECT * FROM (SELECT query_id, doc_id, score, {_TOP} AS rank FROM ({_DENSE_SQL})) WHERE rank <= 10")
def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense(spark, sf_dir, 10)


_DENSE_TOP = f"(SELECT * FROM (SELECT query_id, doc_id, score, {_TOP} AS rank FROM ({_DENSE_SQL})) WHERE rank <= 20)"


@query("hybrid_alpha_topk", f"""WITH {_bm25_sql(DOC_SQL)}, lex AS (SELECT query_id, doc_id, score / greatest(max(score) OVER (PARTITION BY query_id), 0.0001) AS l FROM (SELECT *, {_TOP} AS rank FROM scored) WHERE rank <= 20),
sem AS (SELECT query_id, doc_id, score / greatest(max(score) OVER (PARTITION BY query_id), 0.0001) AS m FROM {_DENSE_TOP}),
done AS (SELECT coalesce(lex.query_id, sem.query_id)::BIGINT AS query_id, coalesce(lex.doc_id, sem.doc_id) AS doc_id, round(0.4 * coalesce(l, 0) + 0.6 * coalesce(m, 0), 6)::DOUBLE AS score FROM lex FULL JOIN sem ON lex.query_id = sem.query_id AND lex.doc_id = sem.doc_id)
SELECT * FROM (SELECT query_id, doc_id, score, {_TOP} AS rank FROM done) WHERE rank <= 10""")
def hybrid_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexical = retrieve.top_k(retrieve.bm25(documents(spark, sf_dir), doc_queries(spark)), 20)
    return retrieve.alpha_hybrid(lexical.withColumn("query_id", F.col("query_id").cast("long")), dense(spark, sf_dir, 20), 0.4, 10)


@query("semantic_rerank", f"""WITH t AS {_DENSE_TOP}, u AS (SELECT *, (doc_id % 7) / 7.0 AS cross_score, (doc_id % 3) / 3.0 AS num, max(score) OVER (PARTITION BY query_id) < 0.75 AS gate FROM t),
v AS (SELECT *, CASE WHEN gate AND rank <= 20 THEN cross_score END AS used FROM u),
w AS (SELECT *, CASE WHEN used IS NULL THEN 0.0 WHEN max(used) OVER p - min(used) OVER p < 1e-9 THEN 0.5 ELSE (used - min(used) OVER p) / (max(used) OVER p - min(used) OVER p) END AS cn FROM v WINDOW p AS (PARTITION BY query_id))
SELECT query_id, doc_id, round(0.7 * score + 0.2 * cn + 0.1 * num, 9)::DOUBLE AS final_score FROM w""")
def semantic_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dense(spark, sf_dir, 20).select("query_id", "doc_id", F.col("score").alias("semantic"), (F.col("doc_id") % 7 / 7.0).alias("cross"), (F.col("doc_id") % 3 / 3.0).alias("numeric"))
    return rerank.semantic_rerank(rows).select("query_id", "doc_id", "final_score")


@query("embedding_validity", "SELECT vec_id, len(embedding) = 64 AS valid, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def embedding_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", retrieve.valid_vector(v, 64).alias("valid"), F.round(retrieve.norm(v), 6).alias("norm"))


_TYPOS = [(1, "widgte"), (2, "blu gaer"), (3, "anvil hot"), (4, "sprokcet"), (5, "red"), (6, "zzzzzzzz bracketts")]
_TYPO_SQL = f"{_values(_TYPOS)} AS q(query_id, query)"


@query("fuzzy_correct", f"""WITH seen AS (SELECT p_partkey AS doc_id, unnest({s.bm25_tokens('p_name')}) AS term, unnest(range(len({s.bm25_tokens('p_name')}))) AS pos FROM part),
vocab AS (SELECT term, min((doc_id, pos)) AS ord FROM seen WHERE length(term) >= 3 GROUP BY term),
tok AS (SELECT query_id, unnest(string_split(query, ' ')) AS token, unnest(range(len(string_split(query, ' ')))) AS pos FROM {_TYPO_SQL}),
pairs AS (SELECT token, term, ord, levenshtein(token, term) AS d FROM (SELECT DISTINCT token FROM tok WHERE length(token) >= 4 AND token NOT IN (SELECT term FROM vocab)) CROSS JOIN vocab),
best AS (SELECT token, arg_min(term, (-(1.0 - d / greatest(length(token), length(term))::DOUBLE), ord)) AS term FROM pairs WHERE d <= 2 AND 1.0 - d / greatest(length(token), length(term))::DOUBLE >= 0.75 GROUP BY token)
SELECT query_id, string_agg(coalesce(best.term, tok.token), ' ' ORDER BY pos) AS corrected FROM tok LEFT JOIN best ON best.token = tok.token GROUP BY query_id""")
def fuzzy_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = spark.createDataFrame(_TYPOS, "query_id int, query string")
    return rewrite.correct_queries(queries, vocabulary(parts(spark, sf_dir))).select("query_id", "corrected")


@query("fuzzy_similarity", "SELECT a.n_name AS a, b.n_name AS b, round(1.0 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name)), 6)::DOUBLE AS similarity, levenshtein(a.n_name, b.n_name) <= 2 AND 1.0 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name)) >= 0.75 AND (length(a.n_name) >= 4 AND length(b.n_name) >= 4 OR a.n_name = b.n_name) AS alike FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def fuzzy_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    pairs = n.select(F.col("n_name").alias("a"), "n_regionkey").join(n.select(F.col("n_name").alias("b"), "n_regionkey"), "n_regionkey")
    return pairs.select("a", "b", F.round(rewrite.similarity(F.col("a"), F.col("b")), 6).alias("similarity"), rewrite.is_fuzzy_match(F.col("a"), F.col("b")).alias("alike"))


@query("word_overlap_f1", f"""WITH t AS (SELECT p_partkey, {s.words(s.collapse('lower(p_name)'))} AS d, ['red', 'widget', 'red'] AS q FROM part), u AS (SELECT p_partkey, len(list_filter(q, lambda w: list_contains(d, w))) AS h, len(q) AS nq, len(d) AS nd FROM t)
SELECT p_partkey, round(CASE WHEN h > 0 THEN 2.0 * (h / nd::DOUBLE) * (h / nq::DOUBLE) / (h / nd::DOUBLE + h / nq::DOUBLE) ELSE 0.0 END, 6)::DOUBLE AS f1 FROM u""")
def word_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(rerank.word_f1(F.lit("red widget red"), F.col("p_name")), 6).alias("f1"))


_MAPS = rewrite.Abbreviations(
    {"vassoura": "vassoura nylon", "esfregao": "esfregão de pó", "vassoura nylon 60 cm": "vassoura 60"},
    {"asp": "aspirador", "hp": "potencia", "red": "vermelho", "gear": "engrenagem dentada", "mop": "Mop"},
    {"vassouras": ["vassoura verde", "vassoura preta", "vassouras"], "notebook": ["n"]},
)
_PRIMARY = f"len({s.words('query')}) = 1 AND {text_queries._DETECTED} <> 'UNKNOWN'"


def _step_sql(name: str, before: str, rewritten: str) -> str:
    """A step of the plan: new is the rewritten query, keeps whether the primary one stays, hit whether there is a new one."""
    return f"""{name} AS (SELECT query_id, query, variants, new, {_PRIMARY} AS keeps, coalesce(new <> '' AND new <> query, false) AS hit FROM (SELECT *, {s.key(rewritten)} AS new FROM {before})),
{name}_done AS (SELECT query_id, CASE WHEN hit AND NOT keeps THEN new ELSE query END AS query, CASE WHEN hit THEN list_append(variants, {{'query': new, 'weight': CASE WHEN keeps THEN {rewrite.EXPAND_WEIGHT} ELSE 1.0 END::DOUBLE, 'reason': '{name}'}}) ELSE variants END AS variants FROM {name})"""


_TOKEN_SQL = f"array_to_string(list_transform({s.words('query')}, lambda w: coalesce(({s.mapped(_MAPS.token)})[w], w)), ' ')"
_EXPAND_SQL = "map([" + ", ".join(s.quoted(k) for k in _MAPS.expand) + "], [" + ", ".join(s.listed(v[: rewrite.EXPANDED]) for v in _MAPS.expand.values()) + "])"
_PLAN_SQL = f"""WITH start AS (SELECT query_id, {s.key('query')} AS query, [] AS none FROM {text_queries.MIXED_SQL}),
first AS (SELECT query_id, query, []::STRUCT(query VARCHAR, weight DOUBLE, reason VARCHAR)[] AS variants FROM start),
{_step_sql('exactMap', 'first', f"({s.mapped(_MAPS.exact)})[query]")},
{_step_sql('tokenMap', 'exactMap_done', _TOKEN_SQL)},
grown AS (SELECT query_id, query, variants, CASE WHEN len({s.words('query')}) = 1 AND length(query) >= 2 AND NOT regexp_matches(query, '\\d') THEN list_filter(list_transform(coalesce(({_EXPAND_SQL})[query], []), lambda x: {s.key('x')}), lambda x: x <> '' AND x <> query) ELSE [] END AS more FROM tokenMap_done),
listed AS (SELECT query_id, list_concat([{{'query': query, 'weight': 1.0::DOUBLE, 'reason': 'primary'}}], variants, list_transform(more, lambda x: {{'query': x, 'weight': {rewrite.EXPAND_WEIGHT}::DOUBLE, 'reason': 'expandMap'}})) AS every FROM grown),
rows AS (SELECT query_id, unnest(every) AS v, unnest(range(len(every))) AS pos FROM listed),
fresh AS (SELECT query_id, v, pos, row_number() OVER (PARTITION BY query_id, v.query ORDER BY pos) AS again FROM rows)
SELECT query_id, ord, query, weight, reason FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos)::INTEGER AS ord, v.query AS query, v.weight AS weight, v.reason AS reason FROM fresh WHERE again = 1) WHERE ord <= {rewrite.VARIANTS}"""


@query("rewrite_plan", _PLAN_SQL)
def rewrite_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.rewrite_plan(text_queries.mixed(spark, sf_dir), _MAPS)


def _synonym_table() -> dict[str, list[str]]:
    """Each term's list: its own, else that of the first entry that has it."""
    reverse: dict[str, str] = {}
    for key, listed in rewrite.SYNONYMS.items():
        for word in listed:
            reverse.setdefault(word, key)
    return {**{w: rewrite.SYNONYMS[k] for w, k in reverse.items()}, **rewrite.SYNONYMS}


def _synonym_sql() -> str:
    rows = _values([(k, "|".join(v)) for k, v in _synonym_table().items()])
    return f"SELECT p_partkey, token, coalesce(v.listed, token) AS synonyms FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'mop' WHEN 1 THEN 'vácuo' WHEN 2 THEN 'industrial' ELSE p_name END AS token FROM part) LEFT JOIN {rows} AS v(k, listed) ON v.k = lower(trim(token))"


def _expand_sql() -> str:
    known = _synonym_table()
    table_sql = "map([" + ", ".join(s.quoted(k) for k in known) + "], [" + ", ".join(s.listed(v) for v in known.values()) + "])"
    return f"""WITH t AS (SELECT query_id, lower(query) AS low, string_split_regex(lower(query), '\\s+') AS t FROM {text_queries.MIXED_SQL}),
places AS (SELECT query_id, t, unnest(range(1, len(t) + 1)) AS i FROM t),
others AS (SELECT query_id, t, i, list_filter(coalesce(({table_sql})[trim(t[i])], [trim(t[i])]), lambda x: x <> t[i]) AS o FROM places WHERE t[i] <> ''),
swaps AS (SELECT query_id, t, i, unnest(o) AS x, unnest(range(len(o))) AS j FROM others),
variants AS (SELECT query_id, 0 AS i, 0 AS j, low AS v FROM t UNION ALL SELECT query_id, i, j, array_to_string(list_concat(t[:i - 1], [x], t[i + 1:]), ' ') FROM swaps),
fresh AS (SELECT query_id, v, i, j, row_number() OVER (PARTITION BY query_id, v ORDER BY i, j) AS again FROM variants),
placed AS (SELECT query_id, v, row_number() OVER (PARTITION BY query_id ORDER BY i, j) AS n FROM fresh WHERE again = 1)
SELECT query_id, string_agg(v, '|' ORDER BY n) AS variants FROM placed WHERE n <= 5 GROUP BY query_id"""


@query("synonym_lookup", _synonym_sql())
def synonym_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_size") % 4
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(kind == 0, "mop").when(kind == 1, "vácuo").when(kind == 2, "industrial").otherwise(F.col("p_name")).alias("token"))
    return rows.select("p_partkey", "token", F.array_join(rewrite.synonyms_of(F.col("token")), "|").alias("synonyms"))


@query("synonym_expand", _expand_sql())
def synonym_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_queries.mixed(spark, sf_dir).select("query_id", F.array_join(rewrite.expand_synonyms(F.col("query")), "|").alias("variants"))


_KEY, _VALUE = "lower(p_brand) || ' ' || p_size % 7", "p_name || CASE WHEN p_size % 5 = 0 THEN ', blue gear, steel bolt' ELSE '' END"


@query("abbrev_compile", f"""WITH raw AS (SELECT p_partkey AS ord, unnest([p_brand || ' ' || p_partkey % 1500, 'k' || p_partkey % 1900]) AS raw, {_VALUE} AS value FROM part),
norm AS (SELECT ord, {s.key('raw')} AS norm, value, {s.key('value')} AS nv, {s.distinct(f"list_filter(list_transform(string_split(value, ','), lambda x: {s.key('x')}), lambda x: x <> '')")} AS items, regexp_matches(value, ',\\s+\\pL') AS listed FROM raw),
obs AS (SELECT ord, CASE WHEN listed AND len(items) >= 2 THEN 'expand' WHEN regexp_matches(norm, '^[a-z0-9]{{2,6}}$') THEN 'token' ELSE 'exact' END AS kind, norm, nv, array_to_string(items, '|') AS items FROM norm),
keyed AS (SELECT ord, kind, CASE WHEN kind = 'expand' AND NOT norm LIKE '%s' THEN norm || 's' ELSE norm END AS key, nv, items, CASE WHEN kind = 'expand' THEN 'LIST:' || items ELSE 'SINGLE:' || nv END AS sig FROM obs),
clear AS (SELECT key FROM keyed GROUP BY key HAVING count(DISTINCT sig) = 1 AND count(DISTINCT kind) = 1)
SELECT key, kind, CASE WHEN kind = 'expand' THEN any_value(items) ELSE any_value(nv) END AS value FROM keyed JOIN clear USING (key) GROUP BY key, kind HAVING kind = 'expand' OR (any_value(nv) <> key AND (kind = 'token' OR length(any_value(nv)) >= 4))""")
def abbrev_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.compile_abbreviations(_abbreviation_pairs(spark, sf_dir))


def _abbreviation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key = F.concat(F.col("p_brand"), F.lit(" "), F.col("p_partkey") % 1500, F.lit("|k"), F.col("p_partkey") % 1900)
    value = F.concat(F.col("p_name"), F.when(F.col("p_size") % 5 == 0, ", blue gear, steel bolt").otherwise(""))
    return p.select(F.col("p_partkey").alias("ord"), key.alias("key"), value.alias("value"))


@query("abbrev_top_tokens", "SELECT 'k' || p_partkey % 1900 AS token, count(*)::BIGINT AS n FROM part WHERE p_size % 5 <> 0 GROUP BY 1 ORDER BY n DESC, token LIMIT 20")
def abbrev_top_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.token_usage(_abbreviation_pairs(spark, sf_dir))


# --- reranking and confidence over products as candidates ------------------------------------------

#: A query's candidates are the products of fifty successive keys, so there are as many queries as the table needs.
_EACH = 50
_PHRASE_OF = f"({s.listed(PHRASES)})[{{}} % {len(PHRASES)} + 1]"
_CANDIDATE_SQL = f"(SELECT p_partkey // {_EACH} AS query_id, p_partkey AS doc_id, {_PHRASE_OF.format(f'(p_partkey // {_EACH})')} AS query, {_PHRASE_OF.format('(p_partkey * 5)')} || ' ' || p_name AS text, ((p_partkey * 7 + p_partkey // {_EACH} * 3) % 11 + 1.0)::DOUBLE AS score FROM part)"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrase = lambda k: F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (k % len(PHRASES) + 1).cast("int"))
    key = F.col("p_partkey")
    number = F.floor(key / _EACH)
    score = (key * 7 + number * 3) % 11 + 1.0
    return spread(table(spark, sf_dir, "part")).select(number.alias("query_id"), key.alias("doc_id"), phrase(number).alias("query"), F.concat(phrase(key * 5), F.lit(" "), F.col("p_name")).alias("text"), score.alias("score"))


def _rerank_sql(grid: str = f"(VALUES ('', 0.35, 0.45, 0.30, 0.95, 0.55, true)) AS g(name, w_bm25, w_model, w_category, w_accessory, w_missing, bonus)") -> str:
    """CTEs ending in f: the scored candidates, for each set of weights."""
    t = text_queries
    asked = f"(SELECT query_id, query, {t._INTENT} AS intent, {t._MAIN} AS main, {s.model_numbers('query')} AS models, {t._CANON} AS acc FROM (SELECT DISTINCT query_id, query FROM {_CANDIDATE_SQL}))"
    docs = f"(SELECT of, doc_id, score, {s.key('query')} AS norm, {t._contains(s.key('query'), t.taxonomy.ACCESSORIES)} AS has_acc, {t._MAIN} AS cat, {s.model_numbers('query')} AS nums FROM (SELECT query_id AS of, doc_id, score, text AS query FROM {_CANDIDATE_SQL}))"
    return f"""WITH c AS (SELECT a.*, d.* FROM {asked} a JOIN {docs} d ON d.of = a.query_id),
e AS (SELECT *, CASE WHEN has_acc THEN 'ACESSORIO' WHEN cat IS NOT NULL THEN 'EQUIPAMENTO' ELSE 'INDEFINIDO' END AS doc_type, list_has_any(nums, models) AS has_model, score / max(score) OVER (PARTITION BY query_id) AS bm FROM c),
f AS (SELECT name, query_id, doc_id, intent, doc_type, round(greatest(0.0, w_bm25 * bm + w_model * has_model::INT + w_category * coalesce(cat = main, false)::INT
   + CASE WHEN bonus AND len(acc) > 0 AND doc_type = 'EQUIPAMENTO' THEN least(0.12, 0.04 * len(list_filter(acc, lambda x: contains(norm, x)))) ELSE 0 END
   - w_accessory * (intent = 'EQUIPAMENTO' AND doc_type = 'ACESSORIO')::INT - w_missing * (len(models) > 0 AND NOT has_model)::INT), 6)::DOUBLE AS final_score FROM e CROSS JOIN {grid})"""


@query("rerank_scores", f"{_rerank_sql()} SELECT query_id, doc_id, intent, doc_type, final_score FROM f")
def rerank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.rerank(_candidates(spark, sf_dir)).select("query_id", "doc_id", "intent", "doc_type", "final_score")


def _guard_sql(scored: str) -> str:
    """CTEs ending in guarded, from those of ``_rerank_sql``."""
    return f"""{scored}, g AS (SELECT *, row_number() OVER (PARTITION BY name, query_id ORDER BY final_score DESC, doc_id) AS rank FROM f),
h AS (SELECT *, max(CASE WHEN rank = 1 THEN doc_type END) OVER (PARTITION BY name, query_id) AS first_type, min(CASE WHEN doc_type = 'EQUIPAMENTO' THEN rank END) OVER (PARTITION BY name, query_id) AS eq FROM g),
guarded AS (SELECT name, query_id, doc_id, intent, doc_type, final_score, rank::INTEGER AS rank, (CASE WHEN intent = 'EQUIPAMENTO' AND first_type = 'ACESSORIO' AND eq IS NOT NULL THEN CASE WHEN rank = eq THEN 1 WHEN rank < eq THEN rank + 1 ELSE rank END ELSE rank END)::INTEGER AS guarded_rank FROM h)"""


_GUARD = _guard_sql(_rerank_sql())


@query("rerank_guard", f"{_GUARD} SELECT query_id, doc_id, rank, guarded_rank FROM guarded")
def rerank_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.guard_first(rerank.rerank(_candidates(spark, sf_dir))).select("query_id", "doc_id", "rank", "guarded_rank")


@query("item_confidence", f"{_GUARD} SELECT query_id, doc_id, round(min(least(1.0, exp((final_score - m) / 1.2)) * 0.85) OVER (PARTITION BY query_id ORDER BY rank), 6)::DOUBLE AS confidence FROM (SELECT *, max(final_score) OVER (PARTITION BY query_id) AS m FROM guarded)")
def item_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = rerank.guard_first(rerank.rerank(_candidates(spark, sf_dir)))
    return rank.item_confidence(ranked, F.lit(0.85)).select("query_id", "doc_id", "confidence")


_SCORED = f"WITH {_bm25_sql(DOC_SQL)}, top AS (SELECT * FROM (SELECT *, {_TOP} AS rank FROM scored) WHERE rank <= 15)"


def _top15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.top_k(retrieve.bm25(documents(spark, sf_dir), doc_queries(spark)), 15)


@query("minmax_confidence", f"{_SCORED} SELECT query_id, doc_id, round(CASE WHEN max(score) OVER p = min(score) OVER p THEN 1.0 ELSE (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) END, 6)::DOUBLE AS confidence FROM top WINDOW p AS (PARTITION BY query_id)")
def minmax_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.min_max_confidence(_top15(spark, sf_dir)).select("query_id", "doc_id", "confidence")


@query("softmax_confidence", f"{_SCORED} SELECT query_id, doc_id, round(exp(score) / sum(exp(score)) OVER (PARTITION BY query_id), 6)::DOUBLE AS confidence FROM top")
def softmax_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.softmax_confidence(_top15(spark, sf_dir)).select("query_id", "doc_id", "confidence")


@query("score_share", f"{_SCORED} SELECT query_id, doc_id, round(score / max(score) OVER (PARTITION BY query_id), 6)::DOUBLE AS share FROM top")
def score_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    return _top15(spark, sf_dir).select("query_id", "doc_id", F.round(F.col("score") / F.max("score").over(Window.partitionBy("query_id")), 6).alias("share"))


def _confidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("query_id")
    texts = text_queries.mixed(spark, sf_dir).select("query_id", "query", F.concat(F.col("query"), F.when(k % 3 == 0, " modelo industrial 510").when(k % 3 == 1, "").otherwise(" x")).alias("top_text"))
    # a first result that says something else, for every fourth query
    texts = texts.withColumn("top_text", F.when(k % 4 == 3, F.concat(F.lit("balde "), F.reverse(F.split("top_text", " "))[0])).otherwise(F.col("top_text")))
    return texts.select("*", (k % 7 * 4.0).alias("s1"), F.least(k % 7 * 4.0, k % 5 * 3.0).alias("s2"), F.greatest(k % 7 * 4.0, F.lit(20.0)).alias("max_score"))


_TOP_TEXT = "(query || CASE WHEN query_id % 3 = 0 THEN ' modelo industrial 510' WHEN query_id % 3 = 1 THEN '' ELSE ' x' END)"


def _confidence_steps() -> str:
    """CTEs from q(query_id, query, top_text, s1, s2, max_score, has_accessories, is_navigation) to levels: the phases one after the other."""
    plain = lambda x: f"regexp_replace({x}, '[/()]', ' ', 'g')"
    longer = lambda x: f"list_filter({s.words(x, chr(92) + 's+')}, lambda w: length(w) > 1)"
    number = "regexp_matches(w, '^\\d+[a-z]*$|^[a-z]*\\d+$')"
    inside = lambda x: f"len(list_filter({x}, lambda w: contains(tt, w)))"
    ratio = lambda a, b, none: f"CASE WHEN {b} > 0 THEN {a} / {b}::DOUBLE ELSE {none} END"
    runs = lambda k: f"(SELECT count(*) FROM windows w WHERE w.query_id = b.query_id AND w.size = {k} AND w.inside) * {2 * k}"
    return f"""n AS (SELECT *, {plain("trim(lower(query))")} AS qn, {plain("lower(top_text)")} AS tt FROM q),
w AS (SELECT *, {longer('qn')} AS qw, len({longer('tt')}) AS top_words FROM n),
b AS MATERIALIZED (SELECT *, len(qw) AS n, list_filter(qw, lambda w: {number}) AS numbers, list_filter(qw, lambda w: NOT {number} AND length(w) >= 4 AND w NOT IN ({', '.join(s.quoted(x) for x in rank.COMMON_WORDS)})) AS keys FROM w),
chain AS (SELECT query_id, tt, qw, n, 0 AS found, 0 AS spot FROM b UNION ALL
  SELECT query_id, tt, qw, n, found + 1, spot + instr(substr(tt, spot + 1), qw[found + 1]) FROM chain WHERE found < n AND instr(substr(tt, spot + 1), qw[found + 1]) > 0),
followed AS (SELECT query_id, max(found) AS found FROM chain GROUP BY query_id),
windows AS MATERIALIZED (SELECT query_id, size, contains(tt, array_to_string(qw[i:i + size - 1], ' ')) AS inside FROM (SELECT query_id, tt, qw, size, unnest(range(1, n - size + 2)) AS i FROM b CROSS JOIN (VALUES (2), (3), (4)) AS v(size) WHERE n >= size)),
hits AS (SELECT b.*, f.found, {inside('qw')} AS hit, {inside('numbers')} AS hit_numbers, {inside('keys')} AS hit_keys, {runs(2)} + {runs(3)} + {runs(4)} AS sequences FROM b JOIN followed f USING (query_id)),
r AS (SELECT *, {ratio('hit', 'n', 0.0)} AS coverage, {ratio('hit_numbers', 'len(numbers)', 1.0)} AS number_ratio, {ratio('hit_keys', 'len(keys)', 1.0)} AS key_ratio, {ratio('hit', 'top_words', 0.0)} AS density,
  CASE WHEN s1 > 0 THEN (s1 - s2) / s1 ELSE 0.0 END AS gap, CASE WHEN max_score > 0 THEN least(1.0, s1 / max_score) ELSE 0.0 END AS s1_norm, len(numbers) > 0 AND hit_numbers < len(numbers) AS missing FROM hits),
o AS (SELECT *, CASE WHEN n >= 2 THEN found / n::DOUBLE * 0.10 + least(1.0, sequences / (n * 2.0)) * 0.10 + CASE WHEN contains(tt, qn) THEN 0.03 ELSE 0 END + CASE WHEN len(keys) > 0 AND starts_with(tt, keys[1]) THEN 0.02 ELSE 0 END ELSE 0 END AS order_score FROM r),
total AS (SELECT *, coverage * 0.15 + number_ratio * 0.10 + key_ratio * 0.05 + order_score + CASE WHEN n >= 2 AND found = n THEN 0.02 ELSE 0 END + s1_norm * 0.12 + gap * 0.08 + density * 0.08 + coverage * 0.07
  + CASE WHEN coverage >= 0.95 AND order_score > 0.15 THEN 0.05 ELSE 0 END + CASE WHEN len(numbers) > 0 AND NOT missing THEN 0.03 ELSE 0 END + CASE WHEN s1 > 20 THEN 0.02 ELSE 0 END
  - CASE WHEN missing THEN 0.30 * (1.0 - number_ratio) ELSE 0 END - CASE WHEN hit_keys < len(keys) THEN 0.20 * (1.0 - key_ratio) ELSE 0 END - CASE WHEN coverage < 0.5 THEN 0.25 * (0.5 - coverage) / 0.5 ELSE 0 END
  - CASE WHEN n >= 2 AND order_score < 0.05 THEN 0.15 ELSE 0 END - CASE WHEN s1 < 4 THEN 0.20 * (1.0 - s1 / 4) ELSE 0 END - CASE WHEN s1 > 0 AND s2 > 0 AND gap < 0.15 THEN 0.10 ELSE 0 END - CASE WHEN density < 0.3 AND top_words > 10 THEN 0.08 ELSE 0 END AS score FROM o),
bounded AS (SELECT query_id, CASE WHEN max_score <= 0 THEN 0 ELSE least(least(1.0, greatest(0.0, score)), CASE WHEN missing THEN 0.60 ELSE 1.0 END, CASE WHEN coverage < 0.7 THEN 0.65 ELSE 1.0 END, CASE WHEN s1_norm < 0.3 THEN 0.50 ELSE 1.0 END) END - CASE WHEN has_accessories THEN {rank.ACCESSORY_CONFIDENCE} ELSE 0 END AS c, is_navigation FROM total),
judged AS (SELECT query_id, round(greatest(0.0, c) * CASE WHEN is_navigation THEN {rank.NAV_CONFIDENCE} ELSE 1 END, 6)::DOUBLE AS confidence FROM bounded),
levels AS (SELECT query_id, confidence, CASE WHEN confidence >= 0.8 THEN 'alta' WHEN confidence >= 0.6 THEN 'media' ELSE 'baixa' END AS level FROM judged)"""


_CONFIDENCE_ROWS = f"""q AS (SELECT query_id, query, CASE WHEN query_id % 4 = 3 THEN 'balde ' || string_split({_TOP_TEXT}, ' ')[-1] ELSE {_TOP_TEXT} END AS top_text, (query_id % 7 * 4.0)::DOUBLE AS s1, least(query_id % 7 * 4.0, query_id % 5 * 3.0)::DOUBLE AS s2, greatest(query_id % 7 * 4.0, 20.0)::DOUBLE AS max_score, false AS has_accessories, false AS is_navigation FROM {text_queries.MIXED_SQL})"""


@query("global_confidence", f"WITH RECURSIVE {_CONFIDENCE_ROWS}, {_confidence_steps()} SELECT * FROM levels")
def global_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.global_confidence(_confidence_rows(spark, sf_dir)).select("query_id", "confidence", "level")


#: Candidates of a query that are diversified: the products of so many successive keys.
_LIST = 220


def _subtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    p = table(spark, sf_dir, "part").withColumn("query_id", F.floor(F.col("p_partkey") / _LIST))
    order = Window.partitionBy("query_id").orderBy(F.desc("p_retailprice"), "p_partkey")
    return p.select("query_id", F.row_number().over(order).alias("rank"), F.col("p_partkey").alias("doc_id"), rank.subtype_key(F.col("p_name"), F.col("p_partkey"), F.lit("GEAR"), {"GEAR": "gear"}).alias("subtype"), F.element_at(F.split("p_name", " "), -1).alias("category"), F.lit("gear").alias("query_category"))


@query("diversify")
def diversify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.diversify(_subtypes(spark, sf_dir), 10)


_RUN_B = f"b AS (SELECT query_id, doc_id, round(score * 1.01, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score * 1.01, 6) * CASE WHEN doc_id % 4 = 0 THEN 0.5 ELSE 1 END DESC, doc_id) AS rank FROM scored), a10 AS (SELECT query_id, doc_id, score, rank FROM top WHERE rank <= 10), b10 AS (SELECT * FROM b WHERE rank <= 10)"


def _two_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    scored = retrieve.bm25(documents(spark, sf_dir), doc_queries(spark))
    other = scored.withColumn("score", F.round(F.col("score") * 1.01, 6)).withColumn("key", F.col("score") * F.when(F.col("doc_id") % 4 == 0, 0.5).otherwise(1.0))
    return retrieve.top_k(scored, 10), retrieve.top_k(other, 10, by="key").drop("key")


@query("compare_rankings", f"""{_SCORED}, {_RUN_B}, j AS (SELECT coalesce(a10.query_id, b10.query_id) AS query_id, a10.rank AS ra, b10.rank AS rb, a10.score AS sa, b10.score AS sb FROM a10 FULL JOIN b10 ON a10.query_id = b10.query_id AND a10.doc_id = b10.doc_id)
SELECT query_id, round(count(*) FILTER (ra IS NOT NULL AND rb IS NOT NULL) / count(*)::DOUBLE, 6) AS jaccard, round(coalesce(avg(abs(ra - rb)), 0), 6) AS rank_difference, round(coalesce(avg(abs(sa - sb)), 0), 4) AS score_error, (count(*) FILTER (rb IS NULL))::BIGINT AS only_a, (count(*) FILTER (ra IS NULL))::BIGINT AS only_b FROM j GROUP BY query_id""")
def compare_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compare.compare(*_two_runs(spark, sf_dir))
    return found.select("query_id", F.round("jaccard", 6).alias("jaccard"), F.round("rank_difference", 6).alias("rank_difference"), F.round("score_error", 4).alias("score_error"), "only_a", "only_b")


@query("only_in_first", f"{_SCORED}, {_RUN_B} SELECT query_id, doc_id FROM a10 WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM b10)")
def only_in_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.only_in(*_two_runs(spark, sf_dir)).select("query_id", "doc_id")


@query("precision_recall", f"""{_SCORED}, {_RUN_B}, j AS (SELECT coalesce(a10.query_id, b10.query_id) AS query_id, a10.doc_id IS NOT NULL AS f, b10.doc_id IS NOT NULL AS e FROM a10 FULL JOIN b10 ON a10.query_id = b10.query_id AND a10.doc_id = b10.doc_id),
k AS (SELECT query_id, count(*) FILTER (f) AS found, count(*) FILTER (e) AS expected, count(*) FILTER (f AND e) AS hits FROM j GROUP BY query_id)
SELECT query_id, round(hits / found::DOUBLE, 6) AS "precision", round(hits / expected::DOUBLE, 6) AS recall, round(CASE WHEN hits > 0 THEN 2.0 * hits / (found + expected) ELSE 0.0 END, 6)::DOUBLE AS f1 FROM k""")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.evaluate(*_two_runs(spark, sf_dir)).select("query_id", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"))


# Weight sets of the tuning grid.
GRID = [
    ("Baseline", 0.35, 0.45, 0.30, 0.95, 0.55), ("High Accessory Penalty", 0.35, 0.45, 0.30, 0.98, 0.55), ("High Model Boost", 0.35, 0.55, 0.30, 0.95, 0.55),
    ("Balanced Boost + Penalty", 0.35, 0.50, 0.35, 0.97, 0.60), ("No Accessory Bonus", 0.35, 0.45, 0.30, 0.95, 0.55), ("BM25 Priority", 0.45, 0.40, 0.25, 0.95, 0.55), ("Rerank Priority", 0.25, 0.50, 0.35, 0.97, 0.60),
]


_GRID_SQL = _values([(*g, 0 if g[0] == "No Accessory Bonus" else 1) for g in GRID])
_RATE = "round(avg(CASE WHEN {} = 1 THEN (doc_type = intent OR intent = 'INDEFINIDO')::INT END), 6)::DOUBLE"


@query("weight_grid", f"""{_guard_sql(_rerank_sql(f"(SELECT * REPLACE (bonus = 1 AS bonus) FROM {_GRID_SQL} AS g(name, w_bm25, w_model, w_category, w_accessory, w_missing, bonus)) AS g"))}
SELECT name, {_RATE.format('rank')} AS plain, {_RATE.format('guarded_rank')} AS guarded FROM guarded GROUP BY name""")
def weight_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of queries whose first result is of the wanted type, by weight set, with and without the guard."""
    # texts are parsed once for all sets of weights
    parts_of, out = cut(rerank.rerank_parts(_candidates(spark, sf_dir)).drop("query", "text")), None
    for name, *values in GRID:
        scored = rerank.guard_first(rerank.weighted(parts_of, dict(zip(rerank.WEIGHTS, values, strict=True)), bonus=name != "No Accessory Bonus"))
        good = ((F.col("doc_type") == F.col("intent")) | (F.col("intent") == "INDEFINIDO")).cast("double")
        rate = scored.agg(*[F.round(F.avg(F.when(F.col(c) == 1, good)), 6).alias(n) for n, c in (("plain", "rank"), ("guarded", "guarded_rank"))])
        rate = rate.select(F.lit(name).alias("name"), "plain", "guarded")
        out = rate if out is None else out.unionByName(rate)
    return out


def _search_sql(top_k: int = 10) -> str:
    """The whole search for queries that don't navigate, whose results are not diversified."""
    t, many = text_queries, rank.CANDIDATES
    candidates = max(min(max(top_k * many[0], many[1]), many[2]), top_k)
    known = "(SELECT p_partkey AS doc_id, p_name AS text FROM part)"
    words = s.words("lower(query)", "\\s+")
    return f"""WITH RECURSIVE asked0 AS (SELECT query_id, query, {t.ORACLE_SQL['core_query'].split('SELECT query_id, ')[1].rsplit(' AS core FROM ', 1)[0]} AS core, len({t._FOUND}) > 0 AS has_accessories, {t.ORACLE_SQL['query_specificity'].split('SELECT query_id, ')[1].rsplit(' AS specificity FROM ', 1)[0]} AS specificity,
  {t._INTENT} AS intent, {t._MAIN} AS main, {s.model_numbers('query')} AS models, {t._CANON} AS acc FROM {PART_SQL}),
looked AS (SELECT query_id, {s.key('core')} AS query FROM asked0),
seen AS (SELECT p_partkey AS doc_id, unnest({s.bm25_tokens('p_name')}) AS term, unnest(range(len({s.bm25_tokens('p_name')}))) AS pos FROM part),
vocab AS (SELECT term, min((doc_id, pos)) AS ord FROM seen WHERE length(term) >= 3 GROUP BY term),
tok AS (SELECT query_id, unnest({words}) AS token, unnest(range(len({words}))) AS pos FROM looked),
pairs AS (SELECT token, term, ord, levenshtein(token, term) AS d FROM (SELECT DISTINCT token FROM tok WHERE length(token) >= 4 AND token NOT IN (SELECT term FROM vocab)) CROSS JOIN vocab),
best AS (SELECT token, arg_min(term, (-(1.0 - d / greatest(length(token), length(term))::DOUBLE), ord)) AS term FROM pairs WHERE d <= 2 AND 1.0 - d / greatest(length(token), length(term))::DOUBLE >= 0.75 GROUP BY token),
fixed AS (SELECT query_id, {s.key("string_agg(coalesce(best.term, tok.token), ' ' ORDER BY pos)")} AS query FROM tok LEFT JOIN best ON best.token = tok.token GROUP BY query_id),
{_bm25_sql('fixed', known)},
found AS (SELECT * FROM (SELECT *, {_TOP} AS place FROM scored) WHERE place <= {candidates}),
docs AS (SELECT doc_id, query AS text, {s.key('query')} AS norm, {t._contains(s.key('query'), t.taxonomy.ACCESSORIES)} AS has_acc, {t._MAIN} AS cat, {s.model_numbers('query')} AS nums FROM (SELECT doc_id, text AS query FROM {known})),
e AS (SELECT a.*, f.doc_id, f.score, d.* EXCLUDE (doc_id), CASE WHEN has_acc THEN 'ACESSORIO' WHEN cat IS NOT NULL THEN 'EQUIPAMENTO' ELSE 'INDEFINIDO' END AS doc_type, list_has_any(nums, models) AS has_model, f.score / max(f.score) OVER (PARTITION BY f.query_id) AS bm
  FROM found f JOIN asked0 a ON a.query_id = f.query_id JOIN docs d ON d.doc_id = f.doc_id),
f AS (SELECT *, round(greatest(0.0, 0.35 * bm + 0.45 * has_model::INT + 0.30 * coalesce(cat = main, false)::INT
   + CASE WHEN len(acc) > 0 AND doc_type = 'EQUIPAMENTO' THEN least(0.12, 0.04 * len(list_filter(acc, lambda x: contains(norm, x)))) ELSE 0 END
   - 0.95 * (intent = 'EQUIPAMENTO' AND doc_type = 'ACESSORIO')::INT - 0.55 * (len(models) > 0 AND NOT has_model)::INT), 6)::DOUBLE AS final_score FROM e),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, doc_id) AS rank FROM f),
h AS (SELECT *, max(CASE WHEN rank = 1 THEN doc_type END) OVER (PARTITION BY query_id) AS first_type, min(CASE WHEN doc_type = 'EQUIPAMENTO' THEN rank END) OVER (PARTITION BY query_id) AS eq FROM g),
listed AS (SELECT *, (CASE WHEN intent = 'EQUIPAMENTO' AND first_type = 'ACESSORIO' AND eq IS NOT NULL THEN CASE WHEN rank = eq THEN 1 WHEN rank < eq THEN rank + 1 ELSE rank END ELSE rank END)::INTEGER AS guarded_rank FROM h WHERE rank <= {top_k}),
shown AS (SELECT *, round(min(least(1.0, exp((final_score - m) / 1.2)) * (0.7 + 0.3 * specificity)) OVER (PARTITION BY query_id ORDER BY rank), 6)::DOUBLE AS item_confidence FROM (SELECT *, max(final_score) OVER (PARTITION BY query_id) AS m FROM listed)),
q AS (SELECT query_id, any_value(query) AS query, arg_min(text, rank) AS top_text, coalesce(max(score) FILTER (rank = 1), 0.0) AS s1, coalesce(max(score) FILTER (rank = 2), 0.0) AS s2, max(score) AS max_score, bool_or(has_accessories) AS has_accessories, false AS is_navigation FROM shown GROUP BY query_id),
{_confidence_steps()}
SELECT query_id, rank::INTEGER AS rank, guarded_rank, doc_id, score, score / max(score) OVER (PARTITION BY query_id) AS score_share, final_score, doc_type, item_confidence AS confidence, levels.confidence AS list_confidence, level FROM shown JOIN levels USING (query_id)"""


@query("integrated_search", _search_sql())
def integrated_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(parts(spark, sf_dir), part_queries(spark), SearchConfig(top_k=10))


@query("smart_search")
def smart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smart_search(parts(spark, sf_dir), part_queries(spark), embed.StandIn(32))


@query("embedding_search")
def embedding_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_search(parts(spark, sf_dir), part_queries(spark), embed.StandIn(32))


__all__ = ["ORACLE_SQL", "PHRASES", "QUERIES"]
