"""Spelling variants: words that differ by one code point, found by a self-join of tries.

Words are hung into tries by a part they share whole, and the rest of them, in which two words may
differ, is the trie. For words of b and b or b + 1 code points that differ first at place k: if k is
in the second half (from h = b // 2 on), both begin with the same h code points; if it is in the
first half, both end with the same b - h. So the vocabulary is partitioned once by prefixes and once,
read backwards, by prefixes of the reversed words, and a near pair is met in exactly one partition.

A partition's rests make one trie, and a task walks it from its root with each node's active nodes, those
of the trie within distance one, made from the active nodes of its parent:

    active(child by c) = the node itself, its other children, the child's children, and child by c of each active node

where a terminal node is reached, the terminals among its active nodes are its near words.

A partition of more words than ``MOST`` is cut again by halves of the rests in which its words may differ,
until it is small enough. That always ends, without a cap: rests of one and two code points of an
alphabet of 90 letters are 8,190 at most. No partition depends on the number of rows in the corpus,
and a task hands on a word's number of near words and the best of them, not pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.llm.common import cut, table

#: Fixed values of the task: runs, the divisor of hashes that drop a letter, and bounds.
LEAST_LENGTH, LEAST_COUNT, DIVISOR, FACTOR = 7, 2, 31, 10
RUN = f"[A-Za-z\\u00C0-\\u00FF]{{{LEAST_LENGTH},}}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a partition that one task holds as a trie; at least 90 + 90 * 90, see above.
MOST = 8_192
#: The cuts in a partition's key: side and place. Shared parts are letters only.
_STEP = re.compile(r"([<>])(\d+):")


def runs(docs: DataFrame) -> DataFrame:
    """(word) for every run of seven letters or more of ``docs`` (doc_id, text), one in 31 with a letter less.

    A shorter run can't give a word of seven letters, and a longest run of seven or more is what the
    pattern finds, since it takes all letters that follow. A null id counts as empty text.
    """
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(F.regexp_extract_all("text", F.lit(f"({RUN})"))).alias("run"))
    found = found.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    found = found.select("run", F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return found.select(F.when(F.col("h") % DIVISOR == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words of at least seven code points that occur at least twice. Texts stay where they are."""
    counted = runs(docs).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def _halves(words: DataFrame, key: Column, rest: Column, base: Column) -> DataFrame:
    """Each row in the partitions of its halves: (key, base, word, n, rest), base the length of the shorter rests.

    Rests of ``base`` and ``base + 1`` code points meet; where both have base + 1, the next base has them.
    """
    # the halves of the shorter word; the longer one has one code point more in the half in which they differ
    half, longer = F.floor(base / 2).cast("int"), F.length(rest) - base
    same_head = F.struct(
        F.concat(key, F.lit(">"), half.cast("string"), F.lit(":"), base.cast("string"), F.lit(":"), F.substring(rest, F.lit(1), half)).alias("key"),
        (base - half).alias("base"),
        F.substring(rest, half + 1, F.length(rest)).alias("rest"),
    )
    same_tail = F.struct(
        F.concat(key, F.lit("<"), half.cast("string"), F.lit(":"), base.cast("string"), F.lit(":"), F.substring(rest, half + longer + 1, F.length(rest))).alias("key"),
        half.alias("base"),
        F.reverse(F.substring(rest, F.lit(1), half + longer)).alias("rest"),
    )
    return words.select("word", "n", F.explode(F.array(same_head, same_tail)).alias("p")).select("p.key", "p.base", "word", "n", "p.rest")


def partitions(words: DataFrame, most: int = MOST) -> DataFrame:
    """(key, base, word, n, rest): partitions of at most ``most`` words (8,190 where base is 1), in one of which each near pair is.

    Counts of keys decide which are cut again. Few are, so the rounds after the first touch little.
    """
    # each word as the shorter one (or one of two as long) and as the longer one
    size = F.length("word")
    roles = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("b"))
    now = cut(_halves(roles, F.lit(""), F.col("word"), F.col("b")))
    done: DataFrame | None = None
    while True:
        sizes = now.where("base > 1").groupBy("key").agg(F.count("*").alias("words"))
        heavy = cut(sizes.where(F.col("words") > most).select("key"))
        if heavy.isEmpty():
            return now if done is None else done.union(now)
        light = now.join(heavy, "key", "left_anti")
        done = light if done is None else done.union(light)
        hot = now.join(heavy, "key", "left_semi")
        now = cut(_halves(hot, F.col("key"), F.col("rest"), F.col("base")))


def _meets_here(one: str, two: str, steps: list[tuple[str, int]]) -> bool:
    """Whether the cuts that made a partition are those that two words take by their first difference.

    An inserted letter beside an equal one can be seen in both halves; it belongs to the half of the
    first difference.
    """
    for side, half in steps:
        head = one[:half] == two[:half]
        if head != (side == ">"):
            return False
        longer = max(len(one), len(two)) - min(len(one), len(two))
        more_one, more_two = (longer, 0) if len(one) > len(two) else (0, longer)
        one, two = (one[half:], two[half:]) if head else (one[: half + more_one][::-1], two[: half + more_two][::-1])
    return True


def near_in_trie(rests: list[str]) -> Iterator[tuple[int, int]]:
    """The places of every two of distinct ``rests`` at distance one, once in each direction."""
    children: list[dict[str, int]] = [{}]
    ends: list[int] = [-1]
    for place, rest in enumerate(rests):
        node = 0
        for c in rest:
            after = children[node].get(c)
            if after is None:
                after = children[node][c] = len(children)
                children.append({})
                ends.append(-1)
            node = after
        ends[node] = place
    walk = [(0, set(children[0].values()))]
    while walk:
        node, active = walk.pop()
        here = ends[node]
        if here >= 0:
            yield from ((here, ends[other]) for other in active if ends[other] >= 0)
        below = children[node]
        for c, child in below.items():
            near = {children[v][c] for v in active if c in children[v]}
            near.add(node)
            near.update(below.values())
            near.update(children[child].values())
            near.discard(child)
            walk.append((child, near))


def _join_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, base, word, n, rest) to (word, n_near, form, form_n), one partition after another."""
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form", pa.string()), ("form_n", pa.int64())])
    out: list[tuple] = []

    def join(key: str, base: int, rows: list[tuple[str, int, str]]) -> None:
        near, best = [0] * len(rows), [(0, "")] * len(rows)
        steps = [(side, int(half)) for side, half in _STEP.findall(key)]
        for one, two in near_in_trie([r[2] for r in rows]):
            # two rests that are both longer than the base belong to the partition of the next base
            if min(len(rows[one][2]), len(rows[two][2])) == base and _meets_here(rows[one][0], rows[two][0], steps):
                near[one] += 1
                best[one] = min(best[one], (-rows[two][1], rows[two][0]))
        out.extend((rows[k][0], near[k], best[k][1], -best[k][0]) for k in range(len(rows)) if near[k])

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
        out.clear()
        return made

    key, base, rows = None, 0, []
    for part in batches:
        for k, b, word, n, rest in zip(*(column.to_pylist() for column in part.columns), strict=True):
            if k != key:
                if len(rows) > 1:
                    join(key, base, rows)
                key, base, rows = k, b, []
            rows.append((word, n, rest))
        if len(out) >= 10_000:
            yield batch()
    if len(rows) > 1:
        join(key, base, rows)
    if out:
        yield batch()


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n_near, form, form_n) for each of ``words`` (word, n; distinct) with a near word; form is the best near word."""
    parts = partitions(words, most).select("key", "base", "word", "n", "rest").repartition("key").sortWithinPartitions("key")
    found = parts.mapInArrow(_join_groups, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form")))
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return merged.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root): the last form of each of ``links`` (word, form), by doubling the steps.

    A form occurs ten times as often as its word, so a chain has fewer links than counts have digits,
    and no cycles.
    """
    now = cut(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("further"))
        then = cut(now.join(ahead, now["root"] == ahead["at"], "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        now = then.select("word", "root")
        if then.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, most: int = MOST) -> DataFrame:
    """One row per word of ``docs`` (doc_id, text): word, form, root, n, n_near, form_n.

    Null and empty texts have no words; texts and words may have any length, since a word longer than
    a partition's shared part is cut by halves; of near words with equal n the form is the
    smallest in code-point order; repeated rows count as often as they stand there; other columns are
    ignored, whatever their names; an empty table gives no rows.
    """
    words = cut(vocabulary(docs))
    near = cut(near_words(words, most))
    formed = near.join(words, "word").where(F.col("form_n") >= F.col("n") * FACTOR).select("word", "form", "form_n")
    formed = cut(formed)
    last = roots(formed)
    return (
        words.join(near.select("word", "n_near"), "word", "left")
        .join(formed, "word", "left")
        .join(last, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
