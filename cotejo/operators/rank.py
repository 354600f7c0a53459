"""Confidence, removal of duplicates, diversification and checks of result lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotejo.functions import taxonomy
from cotejo.functions.text import normalize_key, words

DIGITS = 6
# Temperature and multiplier of item confidence; limits of navigation.
TEMPERATURE = 1.2
NAV_CANDIDATES, CANDIDATES = (8, 60, 220), (3, 30, 120)
MAX_PER_SUBTYPE, MIN_COVERAGE, NAV_CONFIDENCE, ACCESSORY_CONFIDENCE = 1, 5, 0.75, 0.08
COMMON_WORDS = ["de", "do", "da", "com", "para", "tipo", "modelo", "mod"]


def candidate_k(top_k: Column, navigation: Column) -> Column:
    """How many candidates to fetch: a multiple of top_k between bounds, never fewer than top_k."""
    bounded = lambda x: F.greatest(F.least(F.greatest(top_k * x[0], F.lit(x[1])), F.lit(x[2])), top_k)
    return F.when(navigation, bounded(NAV_CANDIDATES)).otherwise(bounded(CANDIDATES))


def item_confidence(ranked: DataFrame, multiplier: Column, score: str = "final_score", temperature: float = TEMPERATURE) -> DataFrame:
    """Adds confidence: exp((score - best) / temperature) by the query's multiplier, never rising down the list."""
    every = Window.partitionBy("query_id")
    so_far = every.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    relative = F.least(F.lit(1.0), F.exp((F.col(score) - F.max(score).over(every)) / temperature)) * multiplier
    rows = ranked.withColumn("_c", relative)
    return rows.withColumn("confidence", F.round(F.min("_c").over(so_far), DIGITS)).drop("_c")


def min_max_confidence(rows: DataFrame, score: str = "score") -> DataFrame:
    every = Window.partitionBy("query_id")
    low, high = F.min(score).over(every), F.max(score).over(every)
    return rows.withColumn("confidence", F.round(F.when(high == low, 1.0).otherwise(F.try_divide(F.col(score) - low, high - low)), DIGITS))


def softmax_confidence(rows: DataFrame, score: str = "score", temperature: float = 1.0) -> DataFrame:
    every = Window.partitionBy("query_id")
    # less the maximum: the same quotient, without overflow
    part = F.exp((F.col(score) - F.max(score).over(every)) / temperature)
    rows = rows.withColumn("_e", part)
    return rows.withColumn("confidence", F.round(F.col("_e") / F.sum("_e").over(every), DIGITS)).drop("_e")


def confidence(rows: DataFrame, *scores: str, method: str = "minmax", temperature: float = 1.0, tie: str = "doc_id") -> DataFrame:
    """Adds rank, by the first of the scores that is there, and confidence by the method, minmax or softmax, in that score."""
    if method not in ("minmax", "softmax"):
        raise ValueError("method must be minmax or softmax")
    order = Window.partitionBy("query_id").orderBy(F.desc("_score"), tie)
    placed = rows.withColumn("_score", F.coalesce(*scores)).withColumn("rank", F.row_number().over(order))
    done = softmax_confidence(placed, "_score", temperature) if method == "softmax" else min_max_confidence(placed, "_score")
    return done.drop("_score")


def _plain(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"[/()]", " ")


def confidence_parts(rows: DataFrame) -> DataFrame:
    """Adds the parts of the confidence in a query's first result.

    ``rows`` has one row a query: query, top_text, s1 and s2 (scores of the first two results, 0 if
    there are none) and max_score. Each phase is a column of its own.
    """
    # All weights, steps and bounds below are those of the confidence formula.
    normalized = F.regexp_replace(F.trim(F.lower("query")), r"[/()]", " ")
    top = _plain(F.coalesce("top_text", F.lit("")))
    longer = lambda x: F.filter(words(x), lambda w: F.length(w) > 1)
    number = lambda w: F.regexp_like(w, F.lit(r"^\d+[a-z]*$|^[a-z]*\d+$"))
    rows = rows.select("*", normalized.alias("qn"), top.alias("tt"), longer(normalized).alias("qw"), F.size(longer(top)).alias("top_words"))
    rows = rows.withColumn("numbers", F.filter("qw", number)).withColumn("keys", F.filter("qw", lambda w: ~number(w) & (F.length(w) >= 4) & ~w.isin(COMMON_WORDS)))
    inside = lambda name: F.size(F.filter(name, lambda w: F.col("tt").contains(w)))
    n = F.size("qw")
    rows = rows.select("*", n.alias("n"), inside("qw").alias("hit"), inside("numbers").alias("hit_numbers"), inside("keys").alias("hit_keys"))
    ratio = lambda a, b, none: F.when(b > 0, a / F.greatest(b, F.lit(1))).otherwise(F.lit(float(none)))
    rows = rows.select(
        "*", ratio(F.col("hit"), F.col("n"), 0).alias("coverage"), ratio(F.col("hit_numbers"), F.size("numbers"), 1).alias("number_ratio"), ratio(F.col("hit_keys"), F.size("keys"), 1).alias("key_ratio"),
    ).withColumn("coverage_score", F.col("coverage") * 0.15 + F.col("number_ratio") * 0.10 + F.col("key_ratio") * 0.05)

    # words in order: each is looked for behind the one before, until one is missing
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("found"), F.lit(True).alias("going"))

    def follow(s: Column, w: Column) -> Column:
        place = F.position(w, F.col("tt"), s["at"] + 1)
        ok = s["going"] & (place > 0)
        return F.struct(F.when(ok, place).otherwise(s["at"]).alias("at"), (s["found"] + ok.cast("int")).alias("found"), ok.alias("going"))

    chain = F.aggregate("qw", start, follow)

    def runs(size: int) -> Column:
        """Weight of the runs of so many words that the text contains as they stand."""
        places = F.sequence(F.lit(1), F.greatest(F.col("n") - size + 1, F.lit(1)))
        found = F.size(F.filter(places, lambda i: F.col("tt").contains(F.array_join(F.slice(F.col("qw"), i, F.lit(size)), " "))))
        return F.when(F.col("n") >= size, found * size * 2).otherwise(0)

    sequences = runs(4) + runs(3) + runs(2)
    several = F.col("n") >= 2
    rows = rows.select("*", chain.alias("chain"), F.least(F.lit(1.0), F.try_divide(sequences, F.col("n") * 2)).alias("sequence_ratio"))
    begins = F.coalesce(F.col("tt").startswith(F.try_element_at("keys", F.lit(1))), F.lit(False))
    order = F.col("chain.found") / F.greatest(F.col("n"), F.lit(1)) * 0.10 + F.col("sequence_ratio") * 0.10 + F.when(F.col("tt").contains(F.col("qn")), 0.03).otherwise(0.0) + F.when(begins, 0.02).otherwise(0.0)
    gap = F.when(F.col("s1") > 0, (F.col("s1") - F.col("s2")) / F.col("s1")).otherwise(0.0)
    rows = rows.select(
        "*", F.when(several, order).otherwise(0.0).alias("order_score"), F.when(several & F.col("chain.going"), 0.02).otherwise(0.0).alias("position_bonus"),
        F.when(F.col("max_score") > 0, F.least(F.lit(1.0), F.col("s1") / F.col("max_score"))).otherwise(0.0).alias("s1_norm"), gap.alias("gap_ratio"),
        ratio(F.col("hit"), F.col("top_words"), 0).alias("density"),
    )
    rows = rows.withColumn("score_part", F.col("s1_norm") * 0.12 + F.col("gap_ratio") * 0.08).withColumn("density_score", F.col("density") * 0.08 + F.col("coverage") * 0.07)
    some = F.size("numbers") > 0
    missing = some & (F.col("hit_numbers") < F.size("numbers"))
    bonus = F.when((F.col("coverage") >= 0.95) & (F.col("order_score") > 0.15), 0.05).otherwise(0.0) + F.when(some & ~missing, 0.03).otherwise(0.0) + F.when(F.col("s1") > 20, 0.02).otherwise(0.0)
    penalty = (
        F.when(missing, 0.30 * (1.0 - F.col("number_ratio"))).otherwise(0.0)
        + F.when(F.col("hit_keys") < F.size("keys"), 0.20 * (1.0 - F.col("key_ratio"))).otherwise(0.0)
        + F.when(F.col("coverage") < 0.5, 0.25 * (0.5 - F.col("coverage")) / 0.5).otherwise(0.0)
        + F.when(several & (F.col("order_score") < 0.05), 0.15).otherwise(0.0)
        + F.when(F.col("s1") < 4, 0.20 * (1.0 - F.col("s1") / 4)).otherwise(0.0)
        + F.when((F.col("s1") > 0) & (F.col("s2") > 0) & (F.col("gap_ratio") < 0.15), 0.10).otherwise(0.0)
        + F.when((F.col("density") < 0.3) & (F.col("top_words") > 10), 0.08).otherwise(0.0)
    )
    return rows.withColumn("bonus", bonus).withColumn("penalty", penalty).withColumn("missing_numbers", missing)


def global_confidence(rows: DataFrame) -> DataFrame:
    """Adds confidence and level to one row a query (see ``confidence_parts``), and where they are there uses
    has_accessories (less by a fixed step) and is_navigation (a fixed share)."""
    parts = confidence_parts(rows)
    total = F.col("coverage_score") + F.col("order_score") + F.col("position_bonus") + F.col("score_part") + F.col("density_score") + F.col("bonus") - F.col("penalty")
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))
    score = F.when(F.col("missing_numbers"), F.least(score, F.lit(0.60))).otherwise(score)
    score = F.when(F.col("coverage") < 0.7, F.least(score, F.lit(0.65))).otherwise(score)
    score = F.when(F.col("s1_norm") < 0.3, F.least(score, F.lit(0.50))).otherwise(score)
    score = F.when(F.col("max_score") <= 0, 0.0).otherwise(score)
    if "has_accessories" in rows.columns:
        score = F.when(F.col("has_accessories"), F.greatest(F.lit(0.0), score - ACCESSORY_CONFIDENCE)).otherwise(score)
    if "is_navigation" in rows.columns:
        score = F.when(F.col("is_navigation"), score * NAV_CONFIDENCE).otherwise(score)
    done = parts.withColumn("confidence", F.round(score, DIGITS))
    return done.select(*rows.columns, "confidence", taxonomy.confidence_level(F.col("confidence")).alias("level"))


def keep_best(rows: DataFrame, key: str, *scores: str, tie: str = "doc_id", group: str = "query_id") -> DataFrame:
    """The row of each key with the highest of the first score that is there."""
    order = Window.partitionBy(group, key).orderBy(F.desc(F.coalesce(*scores)), tie)
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def incoherent(rows: DataFrame, score: str = "confidence") -> DataFrame:
    """Rows whose score is above that of the row before by more than a ten-thousandth."""
    before = F.lag(score).over(Window.partitionBy("query_id").orderBy("rank"))
    return rows.withColumn("before", before).where(F.col(score) > F.col("before") + 1e-4)


def duplicates(rows: DataFrame, key: str, group: str = "query_id") -> DataFrame:
    return rows.groupBy(group, key).agg(F.count("*").alias("n")).where("n > 1")


def subtype_key(title: Column, doc_id: Column, category: Column, category_tokens: dict = taxonomy.CATEGORY_TOKENS, stopwords: list[str] = taxonomy.STOPWORDS) -> Column:
    """A title's words without stopwords and the category's own word; the id if nothing is left."""
    own = F.coalesce(F.create_map(*[x for k, v in category_tokens.items() for x in (F.lit(k), F.lit(v))])[F.coalesce(category, F.lit(""))], F.lit(""))
    kept = F.filter(words(normalize_key(title), " "), lambda w: ~w.isin(stopwords) & (w != own))
    return F.coalesce(F.nullif(F.array_join(kept, " "), F.lit("")), doc_id.cast("string"))


def diversify(rows: DataFrame, top_k: int, max_per_subtype: int = MAX_PER_SUBTYPE, min_coverage: int = MIN_COVERAGE) -> DataFrame:
    """Selects from (query_id, rank, doc_id, subtype, category, query_category) and adds place.

    First documents of the query's category, few of each subtype, up to the coverage; then all, few
    of each subtype; then, while there is room, what was passed over. A query's candidates are
    bounded, so a fold over them in order keeps the state.
    """
    top_k, cap, cover = max(1, top_k), max(1, max_per_subtype), max(0, min(min_coverage, top_k))
    item = F.struct("rank", "doc_id", "subtype", (F.col("category") == F.col("query_category")).alias("own"))
    listed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.first("query_category").isNotNull().alias("asked"))
    state = F.struct(F.array().cast("array<struct<doc_id:string,subtype:string>>").alias("taken"))

    def one(s: Column, d: Column, allowed: Column, capped: bool, most: int) -> Column:
        taken = s["taken"]
        fresh = ~F.exists(taken, lambda t: t["doc_id"] == d["doc_id"].cast("string"))
        few = F.size(F.filter(taken, lambda t: t["subtype"] == d["subtype"])) < cap if capped else F.lit(True)
        ok = F.coalesce(allowed & fresh & few & (F.size(taken) < most), F.lit(False))
        entry = F.array(F.struct(d["doc_id"].cast("string").alias("doc_id"), d["subtype"].alias("subtype")))
        return F.struct(F.when(ok, F.concat(taken, entry)).otherwise(taken).alias("taken"))

    own = lambda d: F.coalesce(d["own"], F.lit(False))
    enough = F.col("asked") & (F.size(F.filter("items", own)) >= cover) & F.lit(cover > 0)
    first = F.aggregate("items", state, lambda s, d: one(s, d, enough & own(d), True, cover))
    waits = lambda s, d: ~(F.col("asked") & ~own(d) & (F.size(s["taken"]) < cover))
    listed = listed.withColumn("s", first)
    listed = listed.withColumn("s", F.aggregate("items", F.col("s"), lambda s, d: one(s, d, waits(s, d), True, top_k)))
    listed = listed.withColumn("s", F.aggregate("items", F.col("s"), lambda s, d: one(s, d, waits(s, d), False, top_k)))
    chosen = listed.select("query_id", F.posexplode("s.taken").alias("place", "t"))
    return chosen.select("query_id", (F.col("place") + 1).alias("place"), F.col("t.doc_id").alias("doc_id"), F.col("t.subtype").alias("subtype"))
