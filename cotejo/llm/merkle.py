"""Merkle fingerprints of documents, in DataFrame functions only.

A text is cut without loss into sections (beginning at a blank line), paragraphs (lines) and leaves
(four words with the white space around them). A leaf's digest is the SHA-256 of its text, a
paragraph's that of its leaves' digests, a section's that of its paragraphs' and the root's that
of its sections'. Equal roots mean equal texts; where roots differ, the branches that differ lead
to the edit. The fingerprint writes the tree level by level,

    root|section*paragraphs,...|paragraph*leaves,...|leaf,leaf,...

with the whole digest of the root and the first 12 hex digits of those below it: that two branches
which differ have the same 48 bits has a chance of 2^-48 for any two compared, and never makes
unequal texts equal.

Likeness is the share of leaves that texts have in common. Leaves under equal branches are equal, so
it is what a descent along differing branches finds, but taken level by level, in linear time.

The next document by id is found without sorting all rows in one place: ids are cut into ranges
of about equal size in bytes, and an id that would fill several by itself into parts by the hash of
its texts; a range is sorted by itself, and the first rows of the next range also go to the range
before it. Texts are shuffled once, and fingerprinted where they arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cotejo.llm.common import table

SECTION = r"(?<=\n)(?=[ \t]*\n)"
PARAGRAPH = r"(?<=\n)"
LEAF = r"\s*+(?:\S++\s*+){1,4}|\s++"
SHORT = 12
#: Bytes of the texts of a range of ids, about, and ranges at least; there is no upper limit.
RANGE_BYTES, LEAST_RANGES = 64 << 20, 64


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def tree(text: Column) -> Column:
    """array<struct<hash, paragraphs: array<struct<hash, leaves: array<string>>>>> of a text, by section."""

    def paragraph(one: Column) -> Column:
        leaves = F.transform(F.regexp_extract_all(one, F.lit(LEAF), F.lit(0)), _sha)
        return F.struct(leaves.alias("leaves"))

    def section(one: Column) -> Column:
        return F.struct(F.transform(F.filter(F.split(one, PARAGRAPH, -1), lambda p: p != ""), paragraph).alias("paragraphs"))

    raw = F.transform(F.filter(F.split(text, SECTION, -1), lambda s: s != ""), section)
    hashed = F.transform(raw, lambda s: F.transform(s["paragraphs"], lambda p: F.struct(_sha(F.array_join(p["leaves"], "")).alias("hash"), p["leaves"].alias("leaves"))))
    return F.transform(hashed, lambda s: F.struct(_sha(F.array_join(F.transform(s, lambda p: p["hash"]), "")).alias("hash"), s.alias("paragraphs")))


def written(sections: Column) -> Column:
    """The fingerprint of a tree as a string."""
    short = lambda h: F.substring(h, 1, SHORT)
    root = _sha(F.array_join(F.transform(sections, lambda s: s["hash"]), ""))
    paragraphs = F.flatten(F.transform(sections, lambda s: s["paragraphs"]))
    return F.concat_ws(
        "|",
        root,
        F.array_join(F.transform(sections, lambda s: F.concat(short(s["hash"]), F.lit("*"), F.size(s["paragraphs"]))), ","),
        F.array_join(F.transform(paragraphs, lambda p: F.concat(short(p["hash"]), F.lit("*"), F.size(p["leaves"]))), ","),
        F.array_join(F.flatten(F.transform(paragraphs, lambda p: F.transform(p["leaves"], short))), ","),
    )


def level(fingerprint: Column, number: int) -> Column:
    """The digests of a level: 1 the root, 2 sections, 3 paragraphs, 4 leaves."""
    part = F.split_part(fingerprint, F.lit("|"), F.lit(number))
    return F.filter(F.split(part, ","), lambda x: x != "")


def likeness(one: Column, two: Column) -> Column:
    """1 for equal roots, else twice the shared distinct leaves over the distinct leaves of both."""
    a, b = F.array_distinct(level(one, 4)), F.array_distinct(level(two, 4))
    both = F.size(a) + F.size(b)
    return F.when(F.split_part(one, F.lit("|"), F.lit(1)) == F.split_part(two, F.lit("|"), F.lit(1)), 1.0).when(both == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def first_edit(one: Column, two: Column, number: int = 4) -> Column:
    """The place (from 0) of the first branch of a level that differs; null if none does."""
    a, b = level(one, number), level(two, number)
    shared = F.least(F.size(a), F.size(b))
    differs = F.array_position(F.zip_with(F.slice(a, F.lit(1), shared), F.slice(b, F.lit(1), shared), lambda x, y: x != y), True)
    return F.when(differs > 0, differs - 1).when(F.size(a) != F.size(b), shared).cast("int")


def _listed(values: list[int]) -> Column:
    """Numbers as one literal, however many."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>") if values else F.array().cast("array<long>")


def _range_of(doc_id: Column, splits: list[int]) -> Column:
    """How many of the sorted splits an id has reached, by a search of two levels; null ids come first."""
    if not splits:
        return F.lit(0)
    width = int(len(splits) ** 0.5) + 1
    block = F.size(F.filter(_listed(splits[::width]), lambda s: s <= doc_id)) - 1
    inside = F.slice(_listed(splits), F.greatest(block, F.lit(0)) * width + 1, F.lit(width))
    found = F.when(block < 0, 0).otherwise(block * width + F.size(F.filter(inside, lambda s: s <= doc_id)))
    return F.coalesce(F.when(doc_id.isNotNull(), found), F.lit(0)).cast("int")


def with_next(docs: DataFrame, columns: dict[str, Column], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``docs`` (doc_id, text) with ``columns``, made of them, and next_<column> of the next row by doc_id, then hash of the text.

    Null ids come first; after the last row comes the first, so a single row is its own next.
    """
    bulk = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = max(LEAST_RANGES, -(-bulk // range_bytes))
    found = docs.agg(F.percentile_approx("doc_id", F.lit([k / ranges for k in range(1, ranges)]), F.lit(20 * ranges))).first()[0]
    splits = sorted(set(found or []))
    mark, size = F.xxhash64("text"), F.octet_length("text")
    ranged = docs.select("doc_id", "text", mark.alias("mark"), size.alias("size"), _range_of(F.col("doc_id"), splits).alias("range"), F.col("doc_id").isNull().alias("none"))
    # one row a range, twice for null ids: as many as the texts have multiples of ``range_bytes``
    bounds = ranged.groupBy("range", "none").agg(F.sum("size").alias("bytes"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).orderBy("range", F.desc("none")).collect()
    parts, one_id = {}, {}
    for r in bounds:
        key = (r["range"], r["none"])
        one_id[key] = r["low"] == r["high"]  # null ids are all alike
        parts[key] = max(1, -(-r["bytes"] // range_bytes)) if one_id[key] else 1
    start, at = {}, 0
    for key in parts:
        start[key], at = at, at + parts[key]
    table_of = lambda of, none: _listed([of.get((k, none), 0) for k in range(len(splits) + 1)])
    pick = lambda of: F.when(F.col("none"), F.element_at(table_of(of, True), F.col("range") + 1)).otherwise(F.element_at(table_of(of, False), F.col("range") + 1))
    # hashes are uniform, so equal parts of their values hold about as many texts
    part = F.floor((F.col("mark").cast("double") / 2.0**64 + 0.5) * pick(parts))
    ranged = ranged.withColumn("slot", (pick(start) + F.least(F.greatest(part, F.lit(0)), pick(parts) - 1)).cast("int")).drop("size", "range", "none")
    place = F.struct("doc_id", "mark")
    firsts = {r["slot"]: r for r in ranged.groupBy("slot").agg(F.min(place).alias("first")).select("slot", "first.*").collect()}
    there = sorted(firsts)
    before = {slot: there[k - 1] for k, slot in enumerate(there)}
    slots = F.col("slot") + 1
    first_id = F.element_at(F.split(F.lit(",".join("null" if k not in firsts or firsts[k]["doc_id"] is None else str(firsts[k]["doc_id"]) for k in range(at))), ","), slots)
    first_mark = F.element_at(_listed([firsts[k]["mark"] if k in firsts else 0 for k in range(at)]), slots)
    is_first = (F.coalesce(F.col("doc_id").cast("string"), F.lit("null")) == first_id) & (F.col("mark") == first_mark)
    own = F.struct(F.col("slot").alias("slot"), F.lit(False).alias("halo"))
    halo = F.struct(F.element_at(_listed([before.get(k, 0) for k in range(at)]), slots).cast("int").alias("slot"), F.lit(True).alias("halo"))
    placed = ranged.select("doc_id", "text", "mark", F.explode(F.when(is_first, F.array(own, halo)).otherwise(F.array(own))).alias("to"))
    placed = placed.select("doc_id", "text", "mark", "to.slot", "to.halo").repartition("slot").select("*", *[c.alias(name) for name, c in columns.items()])
    order = Window.partitionBy("slot").orderBy("halo", F.col("doc_id").asc_nulls_first(), "mark", "text")
    led = placed.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in ("text", *columns)])
    return led.where(~F.col("halo")).drop("slot", "halo", "mark")


def fingerprints(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, first_edit.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or
    all) of the next document. A null text is empty; the empty text's tree has no section, and two
    empty texts are alike by 1. Repeated ids are in order of their texts' hashes. Other columns are
    ignored; an empty table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    led = with_next(rows, {"fingerprint": written(tree(F.col("text")))}, range_bytes)
    size = F.length("text")
    cut = F.floor(size / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), size - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    led = led.select("doc_id", size.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    led = led.withColumn("tree", tree(F.col("edited"))).withColumn("edited_fingerprint", written(F.col("tree")))
    return led.select(
        "doc_id", "n_chars", _sha(F.col("edited")).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        first_edit(F.col("fingerprint"), F.col("edited_fingerprint")).alias("first_edit"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
