"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key, -ln(u) / quality; within a source the documents with the
smallest keys come first, which is weighted sampling without replacement. A source's target is
taken as complete epochs of the source, and what is left as the documents whose sizes, summed in
order of their keys, fill it; the one document that the budget ends in gives the words that are
missing and no more.

Prefix sums are two-level: keys fall into slices of a source by the distribution of its keys, which
follows from how many documents it has of each quality; slice totals are summed over the slices of
a source, and only a slice is ever sorted in one task. A source with a third of all rows has as many
more slices, and a low quality fills none of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cotejo.llm.common import WORD_PATTERN, cut, table

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
#: Rows of a slice, about; a source has its rows divided by this many slices.
SLICE_ROWS = 4_000
SEED = "mix"
#: Different quality weights, the words at which half of the weight for length is reached, and symbols.
QUALITIES, SHORT_WORDS = 20, 25
SYMBOLS = "0123456789#$%&()*+/<=>@[\\]^_`{|}~"
#: Sources whose budgets are broadcast at most; more are joined by shuffling.
BROADCAST_SOURCES = 10_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def uniform(doc_id: Column, text: Column) -> Column:
    """A draw in (0, 1) from the id and the text, the same in every run: 52 bits of an MD5."""
    name = F.concat_ws(":", F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("")), F.xxhash64(text).cast("string"))
    return (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def quality_of(text: Column, size: Column) -> Column:
    """A document's quality weight from whole-text statistics, in twentieths from 0.05 to 1.

    It is the product of three shares: of words of a prose-like length (3 to 9 characters on average),
    of characters that are no digits or symbols (squared), and of a length beyond a few words.
    """
    chars = F.greatest(F.length(text), F.lit(1))
    mean = chars / F.greatest(size, F.lit(1))
    prose = F.when(mean < 4, mean / 4).when(mean > 10, 10 / mean).otherwise(1.0)
    plain = F.length(F.translate(text, SYMBOLS, "")) / chars
    value = prose * plain * plain * size / (size + SHORT_WORDS)
    return F.coalesce(F.greatest(F.lit(1), F.round(value * QUALITIES)) / QUALITIES, F.lit(1.0 / QUALITIES))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Adds target to a table of sources (source, source_size), one row a source.

    Sources in order of code points, null last, get the weights in turn and share all sizes by
    them; none gets over ``most`` times its size, and what is over is shared again by weight. That
    ends where all below their limit have the same target per weight, so the limits reached are
    found in one pass, in order of limit per weight. The table has one row a source, not a document.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    every = sources.select("source", "source_size", weight.alias("w"), (F.col("source_size") * float(most)).alias("most"))
    everything = Window.partitionBy(F.lit(0))
    by_limit = everything.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    after = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after)
    leveled = every.withColumn("level", level).withColumn("full", F.col("most") <= F.col("level") * F.col("w"))
    shared = F.min(F.when(~F.col("full"), F.col("level"))).over(everything)
    first = F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.col("most") / F.col("w"))).over(everything)
    final = leveled.withColumn("shared", F.coalesce(first, shared))
    return final.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.col("shared") * F.col("w")).alias("target"))


def drawn(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source, size, chars, quality and key, the exponential one, of each row; and the columns named."""
    size = size_of(F.col("text"))
    sized = docs.select(*more, "doc_id", "source", size.alias("size"), quality_of(F.col("text"), size).alias("quality"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"), uniform(F.col("doc_id"), F.col("text")).alias("draw"))
    return sized.select(*more, "doc_id", "source", "size", "chars", "quality", (-F.log(F.col("draw")) / F.col("quality")).alias("key"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, slice_rows: int = SLICE_ROWS, keep_keys: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken, epochs for every row of ``docs`` (doc_id, text, source).

    taken counts words with repeats. A null or wordless text has size 0 and nothing is taken of it.
    A null source is a source of its own, the last. Ties of keys go by id and size; repeated rows
    draw the same key, stand next to each other and each count for themselves; rows without an id draw by
    their texts, so they are spread like any others. An empty table
    gives no rows; other columns are ignored.
    """
    keyed = cut(drawn(docs))
    weighed = keyed.groupBy("source", "quality").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    sources = weighed.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("rows").alias("n"), F.collect_list(F.struct("quality", "rows")).alias("qualities"))
    goals = targets(sources, weights, most).withColumnRenamed("source", "name")
    counted = goals.join(sources.select(F.col("source").alias("again"), "n", F.array_sort("qualities").alias("qualities")), F.col("name").eqNullSafe(F.col("again"))).drop("again")
    counted = cut(counted.withColumn("slices", F.greatest(F.lit(1), F.ceil(F.col("n") / slice_rows)).cast("int")))

    joined = keyed.join(counted, F.col("source").eqNullSafe(F.col("name")))
    # how many keys of a source are expected below a key: each quality's are exponential, so slices are about equal
    below = F.aggregate("qualities", F.lit(0.0), lambda s, q: s + q["rows"] * (1 - F.exp(-F.col("key") * q["quality"])))
    slot = F.least(F.floor(below / F.col("n") * F.col("slices")), F.col("slices") - 1).cast("int")
    sliced = joined.select("doc_id", "source", "size", "chars", "key", "source_size", "target", slot.alias("slot"))
    totals = sliced.groupBy("source", "slot").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("source").alias("of"), F.col("slot").alias("at"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    placed = sliced.join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("slot") == F.col("at")))
    inside = Window.partitionBy("source", "slot").orderBy("key", "doc_id", "size", "chars").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    ranked = placed.withColumn("before", before).withColumn("epochs", epochs).withColumn("rest", rest)
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("before")))
    keys = ["key", "chars"] if keep_keys else []
    return ranked.select(*keys, "doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), "epochs", part.cast("long").alias("part"))


def resample(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, and not at all if it takes none of it.

    What is taken of a row follows from its source's complete epochs and from where its key stands
    to the key at which the source's budget ends, so texts are not shuffled: one row a source is
    joined to them. The document that the budget ends in is cut after the words it gives, and
    n_chars follows where there is such a column; rows equal to it in key, id and size are cut alike.
    """
    names = docs.columns
    place = F.struct("key", "doc_id", "size", "chars")
    end = F.min(F.when((F.col("part") < F.col("size")), F.struct(*[place.alias("place"), F.col("part").alias("part")])))
    ends = cut(mix(docs, weights, most, keep_keys=True).groupBy(F.col("source").alias("_name")).agg(F.first("epochs").alias("_epochs"), end.alias("_end")))
    few = ends.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    own = drawn(docs.select(F.struct(*names).alias("_row"), "doc_id", "source", "text"), "_row")
    rows = own.join(F.broadcast(ends) if few else ends, own["source"].eqNullSafe(ends["_name"]))
    before = F.coalesce(place < F.col("_end.place"), F.lit(False))
    copies = F.when(F.col("size") > 0, F.col("_epochs") + before.cast("int")).otherwise(0).cast("int")
    words = F.when(place == F.col("_end.place"), F.col("_end.part")).cast("int")
    each = F.concat(F.array_repeat(F.lit(-1), copies), F.when(words > 0, F.array(words)).otherwise(F.array().cast("array<int>")))
    rows = rows.select("_row", F.explode(each).alias("_words"))
    text = F.col("_row.text")
    head = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("_words")), "")
    cut_text = F.when(F.col("_words") >= 0, head).otherwise(text)
    columns = []
    for name in names:
        if name == "text":
            columns.append(cut_text.alias("text"))
        elif name == "n_chars":
            columns.append(F.when(F.col("_words") >= 0, F.length(head)).otherwise(F.col("_row.n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            columns.append(F.col("_row").getField(name).alias(name))
    return rows.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
