"""Per-user tables: history, preferences, kits and carts, and daily analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HISTORY_DEFAULT, HISTORY_MOST = 20, 100


def recent(history: DataFrame, limit: int = HISTORY_DEFAULT, user: str = "user_id", when: str = "created_at", key: str = "id") -> DataFrame:
    """Each user's latest rows, newest first; at most HISTORY_MOST of them."""
    order = Window.partitionBy(user).orderBy(F.desc(when), F.desc(key))
    return history.withColumn("place", F.row_number().over(order)).where(F.col("place") <= min(limit, HISTORY_MOST))


def of_user(df: DataFrame, user: str, column: str = "user_id") -> DataFrame:
    return df.where(F.col(column) == user)


def matching(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows that have the text in one of the columns, whatever its case."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    return df.where(found)


def upsert_latest(current: DataFrame, changes: DataFrame, key: str, when: str, tie: str) -> DataFrame:
    """One row a key: the latest of both tables; of equally late ones that with the greater tie."""
    every = current.unionByName(changes)
    latest = every.groupBy(key).agg(F.max_by(F.struct(*every.columns), F.struct(when, tie)).alias("r"))
    return latest.select("r.*")


def line_total(price: Column, quantity: Column) -> Column:
    """A missing price is 0, a missing or zero quantity 1."""
    return F.coalesce(price, F.lit(0.0)) * F.coalesce(F.nullif(quantity, F.lit(0)), F.lit(1))


def budget(items: DataFrame, user: str, price: str, quantity: str) -> DataFrame:
    """Items, units, subtotal, tax (none) and total of each user's kit."""
    rows = items.groupBy(user).agg(
        F.count("*").alias("items"), F.sum(F.coalesce(F.nullif(F.col(quantity), F.lit(0)), F.lit(1))).cast("long").alias("units"),
        F.round(F.sum(line_total(F.col(price), F.col(quantity))), 2).alias("subtotal"),
    )
    return rows.withColumn("tax", F.lit(0.0)).withColumn("total", F.col("subtotal"))


def cart(items: DataFrame, keys: list[str], price: str, quantity: str) -> DataFrame:
    """Lines of a cart: quantity and value of each item."""
    return items.groupBy(*keys).agg(F.sum(quantity).cast("long").alias("units"), F.round(F.sum(F.col(price) * F.col(quantity)), 2).alias("value"))


def per_unit(lines: DataFrame, quantity: str) -> DataFrame:
    """One row a unit, numbered from 1; lines without units give none."""
    return lines.where(F.col(quantity) >= 1).withColumn("unit", F.explode(F.sequence(F.lit(1), F.col(quantity).cast("int"))))


def query_analytics(log: DataFrame, day: Column, latency: str, results: str) -> DataFrame:
    """Sufficient statistics of a day: queries, those without results, and the sum of latencies."""
    return log.groupBy(day.alias("day")).agg(F.count("*").alias("total_queries"), F.count_if(F.col(results) == 0).alias("zero_result_queries"), F.sum(latency).alias("latency_sum"))


def merge_analytics(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Days of both tables added up; means come from the sums, so the order of merging doesn't matter."""
    every = stored.unionByName(fresh)
    sums = every.groupBy("day").agg(*[F.sum(c).alias(c) for c in ("total_queries", "zero_result_queries", "latency_sum")])
    return sums.withColumn("avg_latency", F.try_divide(F.col("latency_sum"), F.col("total_queries")))


def merge_terms(a: Column, b: Column) -> Column:
    """Counts of two maps by term, added."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def term_counts(log: DataFrame, query: str, *keys: Column) -> DataFrame:
    """How often each trimmed, lower-case query of three letters or more was asked."""
    term = F.trim(F.lower(query))
    return log.groupBy(*keys, term.alias("term")).agg(F.count("*").alias("n")).where(F.length("term") > 2)


def api_metrics(log: DataFrame, latency: str, failed: Column) -> DataFrame:
    """Mean latency, the service's estimates from it, true percentiles and the share of errors."""
    mean = F.avg(latency)
    return log.agg(
        F.count("*").alias("requests"), F.round(mean, 6).alias("avg_latency"), F.round(mean, 6).alias("p50_estimate"), F.round(mean * 1.5, 6).alias("p95_estimate"),
        F.round(F.percentile(latency, 0.5), 6).alias("p50"), F.round(F.percentile(latency, 0.95), 6).alias("p95"), F.round(100.0 * F.count_if(failed) / F.greatest(F.count("*"), F.lit(1)), 6).alias("error_pct"),
    )


#: Addresses that no limit holds for.
EXEMPT = ("127.0.0.1", "::1", "localhost")


def over_limit(requests: DataFrame, user: str, when: str, most: int = 100, window: str = "1 minute", exempt: tuple[str, ...] = EXEMPT) -> DataFrame:
    """Users with more requests in a window than allowed; the exempt ones may have any number."""
    counted = requests.where(~F.col(user).cast("string").isin(*exempt)).groupBy(user, F.window(F.col(when).cast("timestamp"), window).alias("w")).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > most).select(user, F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n")


def cart_summary(items: DataFrame, price: str, quantity: str) -> DataFrame:
    """One row: lines, units, value and mean price of a unit; what heads a cart's export."""
    units, value = F.coalesce(F.sum(quantity), F.lit(0)).cast("long"), F.coalesce(F.sum(F.col(price) * F.col(quantity)), F.lit(0.0))
    return items.agg(F.count("*").alias("lines"), units.alias("units"), F.round(value, 2).alias("value"), F.round(F.coalesce(F.try_divide(value, units), F.lit(0.0)), 2).alias("mean_price"))


def ranked_by_confidence(rows: DataFrame, query: str = "query_id", tie: str = "doc_id") -> DataFrame:
    """Results of a batch grouped by query: rank anew by falling confidence, those without one last."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc_nulls_last("confidence"), tie)))
