"""From quote rows to products: robust metrics, provenance, coverage and status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotejo.functions import taxonomy, text
from cotejo.operators.index import BROADCAST_ROWS, small
from cotejo.session import cut

QUOTE_COLUMNS = ("row_idx", "description", "supplier", "source", "brand", "price", "life_months", "maintenance")


def as_fraction(x: Column) -> Column:
    """Values above 1 are percent."""
    return F.when(x > 1, x / 100).otherwise(x)


#: Different values of one key that are ranked in one task, and the ranges that more are cut into.
MEDIAN_VALUES, MEDIAN_RANGES = 100_000, 64


def medians(values: DataFrame, *keys: str, most: int = MEDIAN_VALUES) -> DataFrame:
    """The exact median of column value by keys; equal values are counted first.

    Values of a key with many different ones are cut into ranges of about as many values, and only the
    range that holds the middle is kept, again and again until it is small. So no task ranks more
    than ``most`` values, however many a key has.
    """
    return medians_of(counted_values(values, *keys), *keys, most=most)


def counted_values(values: DataFrame, *keys: str) -> DataFrame:
    """(keys, value, c): how often a key has each value of column value, without nulls; written, to be read several times."""
    return cut(values.where("value is not null").groupBy(*keys, "value").agg(F.count("*").alias("c")))


def medians_of(counted: DataFrame, *keys: str, most: int = MEDIAN_VALUES) -> DataFrame:
    """``medians`` of values that were counted."""
    sizes = counted.groupBy(*keys).agg(F.sum("c").alias("n"), F.count("*").alias("m"))
    hot = cut(sizes.where(F.col("m") > most).select(*keys, "n"))
    none = F.lit(0).cast("long").alias("below")
    if hot.isEmpty():
        every = Window.partitionBy(*keys)
        return _middle(counted.select("*", F.sum("c").over(every).alias("n"), none), *keys)
    small_ones = _null_safe(counted, hot.select(*keys), keys, "left_anti")
    cold = _middle(small_ones.select("*", F.sum("c").over(Window.partitionBy(*keys)).alias("n"), none), *keys)
    held = _null_safe(counted, small(hot), keys, "inner").select(*keys, "value", "c", "n", none)
    return cold.unionByName(_middle(_narrowed(held, keys, most), *keys))


def _null_safe(rows: DataFrame, other: DataFrame, keys: tuple[str, ...], how: str) -> DataFrame:
    """A join by keys in which nulls are equal, without the other side's keys."""
    renamed = other.toDF(*[f"_{c}" if c in keys else c for c in other.columns])
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(renamed[f"_{k}"]) for k in keys])
    return rows.join(renamed, same, how).drop(*[f"_{k}" for k in keys])


def _ranks(n: Column) -> tuple[Column, Column]:
    """The two middle places, which are one where the number is odd."""
    return F.floor((n + 1) / 2), F.floor(n / 2) + 1


def _middle(held: DataFrame, *keys: str) -> DataFrame:
    """Medians from (keys, value, c, n, below): below counts the values under those that are left."""
    upto = F.col("below") + F.sum("c").over(Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = held.select(*keys, "value", "c", "n", upto.alias("upto"))
    at = lambda place: F.max(F.when((F.col("upto") - F.col("c") < place) & (F.col("upto") >= place), F.col("value")))
    low, high = _ranks(F.col("n"))
    return placed.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias("median"))


def _narrowed(held: DataFrame, keys: tuple[str, ...], most: int) -> DataFrame:
    """The same medians from few values: of (keys, value, c, n, below) only the ranges that hold a middle place."""
    shares = [k / MEDIAN_RANGES for k in range(1, MEDIAN_RANGES)]
    while True:
        held = cut(held)
        sizes = held.groupBy(*keys).agg(F.count("*").alias("m"), F.percentile_approx("value", shares, 10_000).alias("splits"))
        wide = cut(sizes.where(F.col("m") > most).select(*keys, "splits"))
        if wide.isEmpty():
            return held
        cut_up = _null_safe(held, small(wide), keys, "inner").withColumn("range", F.size(F.filter("splits", lambda s: s < F.col("value")))).drop("splits")
        order = Window.partitionBy(*keys).orderBy("range")
        ranges = cut_up.groupBy(*keys, "range").agg(F.sum("c").alias("w"), F.first("n").alias("n"), F.first("below").alias("under"))
        # as many rows a key as there are ranges
        ranges = ranges.withColumn("upto", F.col("under") + F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        low, high = _ranks(F.col("n"))
        chosen = ranges.where((F.col("upto") >= low) & (F.col("upto") - F.col("w") < high)).withColumn("below", F.min(F.col("upto") - F.col("w")).over(Window.partitionBy(*keys)))
        kept = _null_safe(cut_up.drop("below"), small(chosen.select(*keys, "range", "below")), (*keys, "range"), "inner").select(*keys, "value", "c", "n", "below")
        held = _null_safe(held, wide.select(*keys), keys, "left_anti").unionByName(kept)


def distinct_in_order(rows: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """Of each key and column the distinct trimmed values (as <column>s) in the order in which they were first seen.

    A value is one row before any list is made, so lists are as long as there are different values.
    """
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.when(text.is_valid(F.col(c)), F.trim(c)).alias("v")) for c in columns]))
    seen = rows.select(key, F.col(order).alias("r"), kinds.alias("k")).where("k.v is not null").groupBy(key, "k.kind", "k.v").agg(F.min("r").alias("r"))
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == c, F.struct("r", "v")))), lambda x: x["v"]).alias(f"{c}s") for c in columns]
    return seen.groupBy(key).agg(*lists)


def _with_key(quotes: DataFrame) -> DataFrame:
    """Adds equipment_id, the normalised description: rows are read several times, so where few descriptions differ each is normalised once."""
    key = text.normalize_key(F.col("description"))
    known = cut(quotes.where("description is not null").select("description").distinct().limit(BROADCAST_ROWS + 1))
    if small(known) is known:
        return quotes.withColumn("equipment_id", key)
    keys = cut(known.select(F.col("description").alias("_of"), key.alias("equipment_id")))
    return quotes.join(F.broadcast(keys), quotes["description"] == keys["_of"], "left").drop("_of")


def aggregate_quotes(quotes: DataFrame) -> DataFrame:
    """One row a product of quote rows (QUOTE_COLUMNS; numbers as Brazilian text).

    Products are rows of one normalised description; rows without one are left out. Prices and lives
    count above 0, maintenance from 0 on and as a fraction. Sums are taken per task before the shuffle;
    for medians and provenance lists, equal values of a product are one row first.
    """
    price, life, kept_up = (text.parse_br_number(F.col(c)) for c in ("price", "life_months", "maintenance"))
    rows = _with_key(quotes).where("equipment_id <> ''")
    used = {"price": F.when(price > 0, price), "life_months": F.when(life > 0, life), "maintenance": F.when(as_fraction(kept_up) >= 0, as_fraction(kept_up))}
    rows = rows.select("row_idx", "equipment_id", "description", "supplier", "source", "brand", *[x.alias(f"u_{name}") for name, x in used.items()])
    numbers = F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), F.col(f"u_{name}").alias("value")) for name in used]))
    # numbers are read from their texts once: all metrics come from the counted values
    counted = counted_values(rows.select("equipment_id", numbers.alias("x")).select("equipment_id", "x.metric", "x.value"), "equipment_id", "metric")
    middle = medians_of(counted, "equipment_id", "metric")
    middle = middle.groupBy("equipment_id").agg(*[F.max(F.when(F.col("metric") == name, F.col("median"))).alias(f"m_{name}") for name in used])
    spans = counted.groupBy("equipment_id", "metric").agg((F.sum(F.col("value") * F.col("c")) / F.sum("c")).alias("a"), F.min("value").alias("l"), F.max("value").alias("h"), F.sum("c").alias("n"))
    spans = spans.groupBy("equipment_id").agg(*[F.max(F.when(F.col("metric") == name, F.col(x))).alias(f"{x}_{name}") for name in used for x in ("a", "l", "h", "n")])
    first = F.struct("supplier", "source", "brand")
    grouped = rows.groupBy("equipment_id").agg(F.trim(F.min_by("description", "row_idx")).alias("title"), F.min("row_idx").alias("first_row"), F.count("*").alias("rows"), F.min_by(first, "row_idx").alias("first"))
    joined = grouped.join(middle, "equipment_id", "left").join(spans, "equipment_id", "left").fillna(0, [f"n_{name}" for name in used]).join(distinct_in_order(rows, "equipment_id", ["supplier", "source", "brand"], "row_idx"), "equipment_id", "left")
    none = F.array().cast("array<string>")
    # struct<display, mean, median, min, max, n> over the kept values; display is the median
    metrics = [F.struct(*[F.col(f"{x}_{name}").alias(label) for x, label in (("m", "display"), ("a", "mean"), ("m", "median"), ("l", "min"), ("h", "max"), ("n", "n"))]).alias(name) for name in used]
    products = joined.select("equipment_id", "title", "first_row", "rows", *metrics, *[F.coalesce(f"{c}s", none).alias(f"{c}s") for c in ("supplier", "source", "brand")], "first")
    listed = {label: F.array_join(c, ", ") for label, c in (("Fornecedor", "suppliers"), ("Marca", "brands"), ("Fonte", "sources"))}
    return products.select(
        "*", F.col("equipment_id").alias("text"), text.semantic_text(F.col("title"), **listed).alias("semantic_text"),
        taxonomy.detect_category(F.col("title")).alias("doc_category"), taxonomy.detect_doc_type(F.col("title")).alias("doc_type"),
    )


def first_row_products(quotes: DataFrame) -> DataFrame:
    """The older form: grouped by the trimmed lower-case description, values of the first row only."""
    rows = quotes.withColumn("group_id", F.trim(F.lower("description"))).where("group_id <> ''")
    first = rows.groupBy("group_id").agg(F.min_by(F.struct(*[c for c in QUOTE_COLUMNS]), "row_idx").alias("f"), F.count("*").alias("rows"))
    return first.select("group_id", "rows", "f.*", text.parse_br_number(F.col("f.price")).alias("price_value"))


def number_documents(products: DataFrame, order: str = "first_row") -> DataFrame:
    """Adds id, DOC_ and the place in order of first appearance, from 0; products whose text or semantic_text is blank are left out.

    Places are counted per range of the order and the ranges' sizes added up, so no task sorts all.
    """
    for name in ("text", "semantic_text"):
        if name in products.columns:
            products = products.where(F.trim(F.coalesce(name, F.lit(""))) != "")
    # made once for the borders, the sizes and the places
    products = cut(products)
    ranges = max(8, int(products.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = products.agg(F.percentile_approx(order, [k / ranges for k in range(1, ranges)])).first()[0]
    splits = F.array(*[F.lit(c) for c in sorted(set(cuts or []))]) if cuts else F.array().cast("array<long>")
    placed = products.withColumn("_range", F.size(F.filter(splits, lambda s: s <= F.col(order))))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    offset = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    numbered = placed.join(F.broadcast(sizes.select("_range", offset.alias("_offset"))), "_range")
    return numbered.withColumn("id", F.format_string("DOC_%05d", F.col("_offset") + inside)).drop("_range", "_offset")


def trimmed_mean(rows: DataFrame, keys: list[str], value: str, share: float = 0.1) -> DataFrame:
    """The mean without the given share of values at either end; all of up to two values."""
    every = Window.partitionBy(*keys)
    ranked = rows.where(F.col(value).isNotNull()).select(*keys, value, F.row_number().over(every.orderBy(value)).alias("_r"), F.count("*").over(every).alias("_n"))
    drop = F.when(F.col("_n") <= 2, 0).otherwise(F.floor(F.col("_n") * share))
    return ranked.where((F.col("_r") > drop) & (F.col("_r") <= F.col("_n") - drop)).groupBy(*keys).agg(F.avg(value).alias("trimmed_mean"), F.max("_n").alias("n"))


def coverage(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """One row: rows, duplicate keys, and the percentage of rows with each column."""
    shares = [F.round(100.0 * F.count(c) / F.greatest(F.count("*"), F.lit(1)), 2).alias(f"pct_{c}") for c in columns]
    return df.agg(F.count("*").alias("rows"), (F.count(key) - F.count_distinct(key)).alias("duplicate_keys"), *shares)


def sample_rows(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows at random, each once; the sampling is the operation."""
    return df.orderBy(F.rand(seed)).limit(n)


def dataset_status(products: DataFrame, price: Column, category: Column) -> DataFrame:
    """One row: number of products, their mean, least and greatest price above 0, number of categories, status."""
    paid = F.when(price > 0, price)
    zero = lambda c: F.coalesce(F.round(c, 2), F.lit(0.0))
    return products.agg(
        F.count("*").alias("total_products"), zero(F.avg(paid)).alias("avg_price"), zero(F.min(paid)).alias("min_price"), zero(F.max(paid)).alias("max_price"),
        F.count_distinct(F.nullif(category, F.lit(""))).alias("categories"), F.when(F.count("*") > 0, "loaded").otherwise("empty").alias("status"),
    )


def group_details(products: DataFrame, group: str, wanted: str) -> DataFrame:
    """Rows of a group by its exact name or, failing case, by its lower-case name."""
    return products.where((F.col(group) == wanted) | (F.lower(group) == wanted.lower()))


def group_statistics(products: DataFrame, group: str, price: str, life: str) -> DataFrame:
    return products.groupBy(group).agg(F.round(F.avg(price), 2).alias("mean_price"), F.round(F.avg(life), 0).alias("mean_life"), F.count("*").alias("items"))


def display_value(metric: Column, legacy: Column) -> Column:
    """What is shown of a metric: its display value, else that of the older format, else nothing."""
    return F.coalesce(metric, legacy)


def display_maintenance(metric: Column, unit: Column, legacy: Column) -> Column:
    """Maintenance as a percentage; a metric without a unit is a fraction."""
    percent = F.when(F.coalesce(unit, F.lit("fraction")) == "fraction", metric * 100).otherwise(metric)
    return F.coalesce(percent, legacy)


# Rows that must have a price, in percent, and examples in a report.
LEAST_COVERAGE, EXAMPLES = 80.0, 5


def coverage_gate(df: DataFrame, columns: list[str], key: str, least: float = LEAST_COVERAGE) -> DataFrame:
    """One row a column: the percentage of rows that have it, whether that is enough, and the first keys that lack it."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).isNotNull().alias("there")) for c in columns]))
    rows = df.select(F.col(key).alias("key"), cells.alias("c")).select("key", "c.name", "c.there")
    shares = rows.groupBy("name").agg(F.round(100.0 * F.count_if("there") / F.count("*"), 2).alias("pct"))
    first = Window.partitionBy("name").orderBy("key")
    lacking = rows.where("not there and key is not null").withColumn("n", F.row_number().over(first)).where(F.col("n") <= EXAMPLES)
    lists = lacking.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "key"))), lambda x: x["key"]).alias("examples"))
    return shares.join(lists, "name", "left").select("name", "pct", (F.col("pct") >= least).alias("enough"), "examples")
