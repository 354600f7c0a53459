"""Queries of quote aggregation, filters, ranking checks, state tables and analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cotejo.functions import text
from cotejo.functions.text import is_valid
from cotejo.operators import aggregate, compare, embed, rank, state
from cotejo.plans import sqltext as s
from cotejo.sources.tables import table
from cotejo.streaming import analytics

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return register


# Lines repeat their numbers, so a line is known by its part and supplier as well.
_LINE = "(l_linenumber * 100000 + l_partkey) * 10000 + l_suppkey"
_ROW = "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey"

# --- quotes: line items as quote rows -------------------------------------------------------------


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as quote rows: numbers as Brazilian text, the line's place as row_idx."""
    l, p, u = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))  # noqa: E741
    rows = l.join(p, l.l_partkey == p.p_partkey).join(u, l.l_suppkey == u.s_suppkey)
    price = F.translate(F.format_number("l_extendedprice", 2), ",.", ".,")
    return rows.select(
        F.expr(_ROW).alias("row_idx"), F.concat(F.upper("p_name"), F.lit("!")).alias("description"), F.col("s_name").alias("supplier"),
        F.concat(F.lit("BID "), F.col("l_linenumber")).alias("source"), F.col("p_brand").alias("brand"), price.alias("price"), F.col("l_quantity").cast("int").cast("string").alias("life_months"),
        F.format_string("%d", (F.col("l_tax") * 100).cast("int")).alias("maintenance"),
    )


_QUOTES = f"""q AS MATERIALIZED (SELECT {_ROW} AS row_idx, upper(p_name) || '!' AS description, {s.key("upper(p_name) || '!'")} AS equipment_id, s_name AS supplier, 'BID ' || l_linenumber AS source, p_brand AS brand,
  {s.number("replace(replace(translate(format('{:,.2f}', l_extendedprice), ',.', '.,'), '.', ''), ',', '.')")} AS price, l_quantity::INT::DOUBLE AS life, trunc(l_tax * 100)::INT::DOUBLE AS maintenance
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


def _in_order(column: str) -> str:
    return f"(SELECT equipment_id, string_agg(v, '|' ORDER BY r) AS {column}s FROM (SELECT equipment_id, {column} AS v, min(row_idx) AS r FROM q GROUP BY ALL) GROUP BY equipment_id)"


@query("quote_metrics", f"""WITH {_QUOTES}, m AS (SELECT equipment_id, min(row_idx) AS first_row, count(*) AS rows, round(median(price) FILTER (price > 0), 4) AS display_price, round(avg(price) FILTER (price > 0), 4) AS mean_price, min(price) FILTER (price > 0) AS min_price, max(price) FILTER (price > 0) AS max_price, count(*) FILTER (price > 0) AS n_price,
  round(median(life) FILTER (life > 0), 4) AS display_life, round(avg(CASE WHEN maintenance > 1 THEN maintenance / 100 ELSE maintenance END) FILTER (maintenance >= 0), 6) AS mean_maintenance, arg_min(description, row_idx) AS title FROM q GROUP BY equipment_id)
SELECT m.*, b.brands, c.sources, a.suppliers FROM m JOIN {_in_order('brand')} b USING (equipment_id) JOIN {_in_order('source')} c USING (equipment_id) JOIN {_in_order('supplier')} a USING (equipment_id)""")
def quote_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.aggregate_quotes(quotes(spark, sf_dir)).select(
        "equipment_id", "first_row", "rows", F.round("price.display", 4).alias("display_price"), F.round("price.mean", 4).alias("mean_price"), F.col("price.min").alias("min_price"), F.col("price.max").alias("max_price"), F.col("price.n").alias("n_price"),
        F.round("life_months.display", 4).alias("display_life"), F.round("maintenance.mean", 6).alias("mean_maintenance"), "title", *[F.array_join(f"{c}s", "|").alias(f"{c}s") for c in ("brand", "source", "supplier")],
    )


@query("quote_documents", f"""WITH {_QUOTES}, m AS (SELECT equipment_id, min(row_idx) AS r, arg_min(description, row_idx) AS title FROM q GROUP BY equipment_id)
SELECT equipment_id, 'DOC_' || lpad((row_number() OVER (ORDER BY r) - 1)::VARCHAR, 5, '0') AS id, title || ' | Fornecedor: ' || replace(suppliers, '|', ', ') || ' | Marca: ' || replace(brands, '|', ', ') || ' | Fonte: ' || replace(sources, '|', ', ') AS semantic_text
FROM m JOIN {_in_order('brand')} b USING (equipment_id) JOIN {_in_order('source')} c USING (equipment_id) JOIN {_in_order('supplier')} a USING (equipment_id)""")
def quote_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = aggregate.aggregate_quotes(quotes(spark, sf_dir))
    return aggregate.number_documents(products).select("equipment_id", "id", "semantic_text")


@query("quote_first_row", f"WITH {_QUOTES} SELECT trim(lower(description)) AS group_id, count(*) AS rows, arg_min(supplier, row_idx) AS supplier, arg_min(price, row_idx) AS price_value FROM q GROUP BY 1")
def quote_first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.first_row_products(quotes(spark, sf_dir)).select("group_id", "rows", "supplier", "price_value")


@query("quote_trimmed_mean", """SELECT l_suppkey, round(avg(l_extendedprice), 4) AS trimmed_mean, any_value(n) AS n FROM (SELECT l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS r, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
WHERE r > CASE WHEN n <= 2 THEN 0 ELSE floor(n * 0.1) END AND r <= n - CASE WHEN n <= 2 THEN 0 ELSE floor(n * 0.1) END GROUP BY l_suppkey""")
def quote_trimmed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aggregate.trimmed_mean(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice")
    return found.select("l_suppkey", F.round("trimmed_mean", 4).alias("trimmed_mean"), "n")


@query("metric_coverage", """SELECT count(*) AS rows, count(doc_id) - count(DISTINCT doc_id) AS duplicate_keys, round(100.0 * count(quality) / count(*), 2)::DOUBLE AS pct_quality, round(100.0 * count(rare) / count(*), 2)::DOUBLE AS pct_rare
FROM (SELECT doc_id // 2 AS doc_id, quality, CASE WHEN toxic = 1 THEN quality END AS rare FROM labels)""")
def metric_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(F.floor(F.col("doc_id") / 2).alias("doc_id"), "quality", F.when(F.col("toxic") == 1, F.col("quality")).alias("rare"))
    return aggregate.coverage(rows, ["quality", "rare"], "doc_id")


@query("dataset_status", "SELECT count(*) AS total_products, round(avg(p_retailprice) FILTER (p_retailprice > 0), 2) AS avg_price, round(min(p_retailprice) FILTER (p_retailprice > 0), 2) AS min_price, round(max(p_retailprice) FILTER (p_retailprice > 0), 2) AS max_price, count(DISTINCT p_type) AS categories, 'loaded' AS status FROM part")
def dataset_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.dataset_status(table(spark, sf_dir, "part"), F.col("p_retailprice"), F.col("p_type"))


@query("group_details", "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_name = 'RED WIDGET' OR lower(p_name) = 'red widget'")
def group_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.group_details(table(spark, sf_dir, "part"), "p_name", "RED WIDGET").select("p_partkey", "p_name", "p_retailprice")


@query("group_statistics", "SELECT p_name, round(avg(p_retailprice), 2) AS mean_price, round(avg(p_size), 0) AS mean_life, count(*) AS items FROM part GROUP BY p_name")
def group_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.group_statistics(table(spark, sf_dir, "part"), "p_name", "p_retailprice", "p_size")


@query("point_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey = 42").select("c_custkey", "c_name")


@query("valid_values", "SELECT count(*) FILTER (text IS NOT NULL AND trim(text) <> '') AS valid_texts, count(*) FILTER (n_chars IS NOT NULL) AS valid_sizes FROM documents")
def valid_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.count_if(is_valid(F.col("text"))).alias("valid_texts"), F.count_if(is_valid(F.col("n_chars").cast("double"), numeric=True)).alias("valid_sizes"))


@query("favourites_filter", "SELECT p_partkey FROM part WHERE (contains(lower(p_name), 'gear') OR contains(lower(p_type), 'gear')) AND p_brand = (SELECT min(p_brand) FROM part)")
def favourites_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    brand = p.agg(F.min("p_brand").alias("b")).first()["b"]
    return state.matching(state.of_user(p, brand, "p_brand"), "GEAR", "p_name", "p_type").select("p_partkey")


@query("category_audit", f"SELECT DISTINCT p_name FROM part WHERE contains({s.key('p_name')}, 'widget') ORDER BY 1")
def category_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(text.normalize_key(F.col("p_name")).contains("widget")).select("p_name").distinct().orderBy("p_name")


# --- lists of results -------------------------------------------------------------------------------


def _offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.expr(_LINE).alias("doc_id"), (F.col("l_suppkey") % 3).alias("equipment_id"), F.col("l_extendedprice").alias("score"), F.when(F.col("l_quantity") > 25, F.col("l_quantity")).alias("rank_score"))
    return rows


_OFFERS = f"(SELECT l_orderkey AS query_id, {_LINE} AS doc_id, l_suppkey % 3 AS equipment_id, l_extendedprice AS score, CASE WHEN l_quantity > 25 THEN l_quantity END AS rank_score FROM lineitem)"


@query("dedup_best", f"SELECT query_id, doc_id, equipment_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, equipment_id ORDER BY coalesce(rank_score, score) DESC, doc_id) AS n FROM {_OFFERS}) WHERE n = 1")
def dedup_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.keep_best(_offers(spark, sf_dir), "equipment_id", "rank_score", "score").select("query_id", "doc_id", "equipment_id")


@query("confidence_minmax", f"""WITH r AS (SELECT query_id, doc_id, coalesce(rank_score, score) AS x FROM {_OFFERS}), m AS (SELECT *, min(x) OVER (PARTITION BY query_id) AS lo, max(x) OVER (PARTITION BY query_id) AS hi FROM r)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, doc_id)::INTEGER AS rank, round(CASE WHEN hi = lo THEN 1.0 ELSE (x - lo) / (hi - lo) END, 6)::DOUBLE AS confidence FROM m""")
def confidence_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.confidence(_offers(spark, sf_dir).drop("rank"), "rank_score", "score").select("query_id", "doc_id", "rank", "confidence")


@query("display_values", """SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN p_retailprice END, CASE WHEN p_size % 2 = 0 THEN 1.5 END)::DOUBLE AS price, coalesce(CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_size % 4 = 0 THEN p_size::DOUBLE ELSE p_size / 50.0 * 100 END END, 7.0)::DOUBLE AS maintenance FROM part""")
def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    metric = F.when(size % 3 == 0, F.when(size % 4 == 0, size.cast("double")).otherwise(size / 50.0))
    unit = F.when(size % 4 == 0, "percent")
    price = aggregate.display_value(F.when(size % 3 == 0, F.col("p_retailprice")), F.when(size % 2 == 0, 1.5))
    return table(spark, sf_dir, "part").select("p_partkey", price.alias("price"), aggregate.display_maintenance(metric, unit, F.lit(7.0)).alias("maintenance"))


@query("coverage_gate", """WITH c AS (SELECT doc_id, 'quality' AS name, quality IS NOT NULL AS there FROM labels UNION ALL SELECT doc_id, 'rare', toxic = 1 FROM labels)
SELECT name, round(100.0 * count(*) FILTER (there) / count(*), 2)::DOUBLE AS pct, round(100.0 * count(*) FILTER (there) / count(*), 2) >= 80 AS enough, array_to_string(list_sort(list(doc_id) FILTER (NOT there))[1:5], ',') AS examples FROM c GROUP BY name""")
def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality", F.when(F.col("toxic") == 1, 1).alias("rare"))
    return aggregate.coverage_gate(rows, ["quality", "rare"], "doc_id").withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ","))


@query("coherence_check", f"SELECT query_id, doc_id FROM (SELECT *, lag(score) OVER (PARTITION BY query_id ORDER BY doc_id) AS before FROM {_OFFERS}) WHERE score > before + 1e-4")
def coherence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.incoherent(_offers(spark, sf_dir).withColumn("rank", F.col("doc_id")), "score").select("query_id", "doc_id")


@query("duplicate_check", f"SELECT query_id, equipment_id, count(*) AS n FROM {_OFFERS} GROUP BY query_id, equipment_id HAVING count(*) > 1")
def duplicate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.duplicates(_offers(spark, sf_dir), "equipment_id")


def _placed(order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy("p_brand").orderBy(*order, "p_partkey"))


@query("batch_sorts", """SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY price ASC NULLS LAST, p_partkey)::INTEGER AS by_price, row_number() OVER (PARTITION BY p_brand ORDER BY price DESC NULLS LAST, p_partkey)::INTEGER AS by_price_desc, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC NULLS LAST, p_partkey)::INTEGER AS by_life
FROM (SELECT *, CASE WHEN p_size % 10 <> 0 THEN p_retailprice END AS price FROM part)""")
def batch_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("price", F.when(F.col("p_size") % 10 != 0, F.col("p_retailprice")))
    return rows.select("p_partkey", _placed([F.col("price").asc_nulls_last()]).alias("by_price"), _placed([F.col("price").desc_nulls_last()]).alias("by_price_desc"), _placed([F.col("p_size").desc_nulls_last()]).alias("by_life"))


@query("candidate_sizes", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN greatest(least(greatest(p_size * 8, 60), 220), p_size) ELSE greatest(least(greatest(p_size * 3, 30), 120), p_size) END AS candidates FROM part")
def candidate_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", rank.candidate_k(F.col("p_size"), F.col("p_partkey") % 2 == 0).alias("candidates"))


# --- per-user tables ---------------------------------------------------------------------------------


@query("kit_budget", """SELECT o_custkey, count(*) AS items, sum(CASE WHEN q = 0 THEN 1 ELSE q END)::BIGINT AS units, round(sum(coalesce(price, 0) * CASE WHEN q = 0 THEN 1 ELSE q END), 2) AS subtotal, 0.0::DOUBLE AS tax, round(sum(coalesce(price, 0) * CASE WHEN q = 0 THEN 1 ELSE q END), 2) AS total
FROM (SELECT o_custkey, CASE WHEN l_linenumber % 4 <> 0 THEN l_extendedprice END AS price, (l_quantity % 5)::INT AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY o_custkey""")
def kit_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")  # noqa: E741
    items = l.join(o, l.l_orderkey == o.o_orderkey).select("o_custkey", F.when(F.col("l_linenumber") % 4 != 0, F.col("l_extendedprice")).alias("price"), (F.col("l_quantity") % 5).cast("int").alias("q"))
    return state.budget(items, "o_custkey", "price", "q")


@query("cart_summary", "SELECT l_orderkey, l_partkey, sum(l_quantity)::BIGINT AS units, round(sum(l_extendedprice * l_quantity), 2) AS value FROM lineitem GROUP BY l_orderkey, l_partkey")
def cart_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.cart(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"], "l_extendedprice", "l_quantity")


@query("cart_units", "SELECT l_orderkey, l_linenumber, unnest(range(1, l_quantity::INT + 1))::INTEGER AS unit FROM lineitem")
def cart_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.per_unit(table(spark, sf_dir, "lineitem"), "l_quantity").select("l_orderkey", "l_linenumber", "unit")


@query("history_recent", "SELECT user_id, event_id, place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INTEGER AS place FROM events) WHERE place <= 20")
def history_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.recent(table(spark, sf_dir, "events"), 20, "user_id", "ts", "event_id").select("user_id", "event_id", "place")


@query("upsert_latest", "SELECT user_id, event_id, k FROM (SELECT user_id, event_id, json_extract(props, '$.k')::BIGINT AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.from_json("props", "k long")["k"].alias("k"))
    return state.upsert_latest(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 <> 0"), "user_id", "ts", "event_id").select("user_id", "event_id", "k")


@query("query_analytics_daily", "SELECT ts::DATE AS day, count(*) AS total_queries, count(*) FILTER (event_type = 'error') AS zero_result_queries, round(sum(value), 4) AS latency_sum, round(avg(value), 6) AS avg_latency FROM events GROUP BY 1")
def query_analytics_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").withColumn("results", F.when(F.col("event_type") == "error", 0).otherwise(1))
    halves = [state.query_analytics(log.where(f"event_id % 2 = {k}"), F.to_date("ts"), "value", "results") for k in (0, 1)]
    merged = state.merge_analytics(*halves)
    return merged.select("day", "total_queries", "zero_result_queries", F.round("latency_sum", 4).alias("latency_sum"), F.round("avg_latency", 6).alias("avg_latency"))


@query("top_terms", "SELECT ts::DATE AS day, lower(trim(event_type)) AS term, count(*) AS n FROM events GROUP BY 1, 2")
def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.term_counts(table(spark, sf_dir, "events"), "event_type", F.to_date("ts").alias("day"))


@query("merged_terms", "SELECT event_type AS term, count(*) AS n FROM events GROUP BY 1")
def merged_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events")
    maps = [state.term_counts(log.where(f"event_id % 2 = {k}"), "event_type").agg(F.map_from_entries(F.collect_list(F.struct("term", "n"))).alias(f"m{k}")) for k in (0, 1)]
    return maps[0].crossJoin(maps[1]).select(F.explode(state.merge_terms(F.col("m0"), F.col("m1"))).alias("term", "n"))


@query("api_metrics", "SELECT count(*) AS requests, round(avg(value), 6) AS avg_latency, round(avg(value), 6) AS p50_estimate, round(avg(value) * 1.5, 6) AS p95_estimate, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(100.0 * count(*) FILTER (event_type = 'error') / count(*), 6)::DOUBLE AS error_pct FROM events")
def api_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.api_metrics(table(spark, sf_dir, "events"), "value", F.col("event_type") == "error")


@query("rate_limit_violations", "SELECT user_id, time_bucket(INTERVAL 1 hour, ts) AS window_start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def rate_limit_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.over_limit(table(spark, sf_dir, "events"), "user_id", "ts", most=1, window="1 hour")


@query("analytics_windows", "SELECT time_bucket(INTERVAL 5 minute, ts) AS window_start, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 4) AS value_sum FROM events GROUP BY 1")
def analytics_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return analytics.windowed(events).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("analytics_stream_5min", ORACLE_SQL["analytics_windows"])
def analytics_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.windows_of_table(spark, sf_dir)


@query("reachability", """WITH RECURSIVE r AS (SELECT min(o_custkey) AS node FROM orders UNION SELECT o_orderkey FROM r JOIN orders ON o_custkey = r.node) SELECT node FROM r""")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that the least customer's number leads to, from customers to their orders, read as customers again."""
    orders = table(spark, sf_dir, "orders")
    return compare.reachable(orders.select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b")), orders.select(F.min("o_custkey").alias("node")))


@query("corpus_stamp", "SELECT sha256(count(*)::VARCHAR || '_' || count(DISTINCT text)::VARCHAR) AS stamp FROM documents")
def corpus_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "documents").agg(F.count("*").alias("rows"), F.count_distinct("text").alias("texts"))
    return counted.select(text.corpus_hash(F.col("rows"), F.col("texts")).alias("stamp"))


@query("embedding_job")
def embedding_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names embedded by the stand-in provider."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("text"))
    return embed.embed(parts, embed.StandIn(16))
