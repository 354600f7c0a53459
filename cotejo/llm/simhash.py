"""SimHash near-duplicates, with candidates pruned by pigeonring filtering.

A fingerprint's 64 bits lie on a ring of d + 1 segments, where d is the number of bits in which two
fingerprints may differ. By the pigeonring principle some segment starts a chain whose first l
segments differ in at most floor(d l / (d + 1)) = l - 1 bits, for every l. So the start segment is
equal, and so is one half of the segment after it: those bits are the key that candidates share.
Within a key the budgets of the longer chains are checked before the full Hamming distance.

Only distinct fingerprints are compared, so copies cost nothing. A key that many distinct
fingerprints share is split by the same principle, by d + 1 parts of its other bits at a time; what
is crowded still, and could be without bound, is cut into blocks and every two blocks are compared:
nothing is dropped and no group is unbounded. Within a key only a spanning forest of the links is
emitted, nearest first, never all pairs.

Where links are checked further and some fail, a forest may have spared one that would have passed. So
groups that the check tears apart are compared once more, all fingerprints with all in blocks, and every
link between two of their pieces is checked, until none is left or the pieces are one.

``near_duplicates`` links fingerprints of three-word shingles that differ in two bits.
``keep_one``, which filters a corpus, is after texts whose sets of five-word shingles have a
similarity (Jaccard) of 0.8 or more: it takes several fingerprints of a text, lets each differ in
more bits, and checks the similarity of the linked texts themselves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cotejo.llm.common import WORD_PATTERN, components, cut, may_be_among, release_memory, table

SEED, SHINGLE, DISTANCE = 42, 3, 2
#: Distinct fingerprints of one key that are compared in one go; keys with more are split.
KEY_LIMIT = 2048
#: Of the filter: words of a shingle, least similarity, fingerprints of a text, bits that each may
#: differ in, and the limit of a key.
WIDE_SHINGLE, SIMILARITY, RINGS, WIDE_DISTANCE, WIDE_LIMIT = 5, 0.8, 3, 9, 16_384
#: Fingerprints that a forest compares at once, and nodes and shingles of a block of a torn group.
CELLS, TORN_NODES, TORN_SHINGLES = 1 << 18, 1_024, 1 << 18
#: Levels of keys, and the free bits up to which a key can't be crowded without bound.
LEVELS, BOUNDED_BITS = 3, 15


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _runs(bits: list[int], parts: int) -> list[list[int]]:
    """A list of bit positions cut into consecutive parts of nearly equal size."""
    size, more = divmod(len(bits), parts)
    ends = np.cumsum([size + (k < more) for k in range(parts)])
    return [bits[e - size - (k < more) : e] for k, e in enumerate(ends)]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


class Ring:
    """Keys of fingerprints that differ in up to ``distance`` bits.

    ``keys`` has masks of all levels: level, mask, start, and the places of the child masks.
    ``chains`` has, of each start, masks of its first l segments with their budgets, the whole ring last.
    """

    def __init__(self, distance: int):
        self.distance, self.keys, self.chains = distance, [], []
        ring = _runs(list(range(64)), distance + 1)
        for start in range(distance + 1):
            around = ring[start:] + ring[:start]
            self.chains.append([(_mask([b for part in around[:size] for b in part]), size - 1) for size in range(2, distance + 2)])
            for half in _runs(around[1], 2):
                self._add(0, _mask(around[0]) | _mask(half), start)

    def _add(self, level: int, mask: int, start: int) -> int:
        at = len(self.keys)
        self.keys.append({"level": level, "mask": mask, "start": start, "children": []})
        free = [b for b in range(64) if not mask >> b & 1]
        if level + 1 < LEVELS:
            self.keys[at]["children"] = [self._add(level + 1, mask | _mask(part), start) for part in _runs(free, self.distance + 1)]
        return at


RING = Ring(DISTANCE)


def _shingled(text: str | None, shingle: int) -> tuple[bytes, np.ndarray]:
    """The words, lower-case in A-Z and joined by spaces, and the hashes of their shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, SEED)] if words else []
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    return joined, np.array(hashes, dtype=np.uint64)


def _majority(hashes: np.ndarray) -> int:
    """Of each bit, whether over half of the hashes have it, as a signed number."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        block = hashes[at : at + 8192].astype(">u8")
        votes += np.unpackbits(block.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes)).view(">i8")[0])


def _mixed(hashes: np.ndarray, ring: int) -> np.ndarray:
    """Other hashes of the same shingles, by a multiply-and-shift mixer; ring 0 has them as they are."""
    if not ring:
        return hashes
    mixed = (hashes ^ np.uint64(ring * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return mixed ^ (mixed >> np.uint64(32))


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as a signed 64-bit number; 0 if it has no word or is null."""
    return _majority(_shingled(text, shingle)[1])


@F.pandas_udf(T.LongType())
def _simhash_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash(t) for t in texts], dtype="int64")


def _prints_udf(shingle: int, rings: int):
    """fps, of each ring, and digest, which is that of equal sequences of words."""

    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            joined, hashes = _shingled(text, shingle)
            out.append(([_majority(_mixed(hashes, ring)) for ring in range(rings)], xxhash.xxh128_digest(joined)))
        release_memory()
        return pd.DataFrame(out, columns=["fps", "digest"])

    return F.pandas_udf(run, "fps array<long>, digest binary")


def fingerprint_hex(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def forest(prints: np.ndarray, nodes: np.ndarray, chain: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links between nodes whose fingerprints stay within every budget, as a spanning forest, nearest first."""
    size = len(prints)
    root = np.arange(size)
    found: list[tuple[int, int]] = []
    longer = chain[min(2, len(chain) - 1)]
    step = max(1, CELLS // max(1, size))
    for at in range(0, size, step):
        apart = prints[at : at + step, None] ^ prints[None, at:]
        i, j = np.nonzero(np.bitwise_count(apart & np.uint64(longer[0])) <= longer[1])
        i, j = i[j > i], j[j > i]
        bits = apart[i, j]
        for mask, budget in chain:
            near = np.bitwise_count(bits & np.uint64(mask)) <= budget
            i, j, bits = i[near], j[near], bits[near]
        order = np.lexsort((j, i, np.bitwise_count(bits)))
        i, j = i[order] + at, j[order] + at
        while len(i):
            between = root[i] != root[j]
            i, j = i[between], j[between]
            for p, q in zip(i[:64].tolist(), j[:64].tolist(), strict=True):
                low, high = sorted((int(root[p]), int(root[q])))
                if low != high:
                    root[root == high] = low
                    found.append((int(nodes[p]), int(nodes[q])))
            i, j = i[64:], j[64:]
    return found


_LINKS = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def _forest_udf(ring: Ring):
    def run(which: pd.Series, prints: pd.Series, nodes: pd.Series) -> pd.Series:
        out = []
        for k, some, names in zip(which, prints, nodes, strict=True):
            chain = ring.chains[ring.keys[k]["start"]]
            links = forest(np.asarray(some, dtype=np.int64).view(np.uint64), np.asarray(names, dtype=np.int64), chain)
            out.append([{"a": a, "b": b} for a, b in links])
        release_memory()
        return pd.Series(out)

    return F.pandas_udf(run, _LINKS)


def _struct(key: dict, which: int) -> Column:
    return F.struct(F.lit(which).alias("which"), F.lit(_signed(key["mask"])).alias("mask"))


def links(prints: DataFrame, key_limit: int = KEY_LIMIT, ring: Ring = RING) -> DataFrame:
    """Links (a, b) that connect all rows (fp, and node where that isn't the fingerprint itself) within the distance."""
    named = "node" in prints.columns
    columns = ["fp", "node"] if named else ["fp"]
    keys, udf = ring.keys, _forest_udf(ring)
    level = [k for k, x in enumerate(keys) if x["level"] == 0]

    def keyed(rows: DataFrame, masks: Column) -> DataFrame:
        rows = rows.select(*columns, F.explode(masks).alias("k"))
        return rows.select(*columns, "k.which", F.col("fp").bitwiseAND(F.col("k.mask")).alias("value"))

    def linked(rows: DataFrame, *by: str) -> DataFrame:
        lists = F.collect_list(F.struct(*columns)).alias("x")
        groups = rows.groupBy("which", *by).agg(lists).where(F.size("x") > 1)
        return groups.select(F.explode(udf("which", F.col("x.fp"), F.col("x.node") if named else F.col("x.fp"))).alias("e")).select("e.a", "e.b")

    found = None
    rows = keyed(prints, F.array(*[_struct(keys[k], k) for k in level]))
    while level:
        crowded = rows.groupBy("which", "value").agg(F.count("*").alias("n")).where(F.col("n") > key_limit)
        last = not keys[level[0]]["children"]
        bounded = last and max(64 - keys[k]["mask"].bit_count() for k in level) <= BOUNDED_BITS
        crowded = None if bounded else cut(crowded)
        if crowded is None or crowded.isEmpty():
            part = linked(rows, "value")
            return part if found is None else found.unionByName(part)
        part = linked(rows.join(crowded, ["which", "value"], "left_anti"), "value")
        found = part if found is None else found.unionByName(part)
        dense = rows.join(crowded, ["which", "value"])
        if last:
            blocks = F.ceil(F.col("n") * 2 / key_limit).cast("int")
            own = F.pmod(F.xxhash64(F.lit("block"), *columns), blocks).cast("int")
            pair = F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.struct(F.least(own, other).alias("low"), F.greatest(own, other).alias("high")))
            return found.unionByName(linked(dense.select(*columns, "which", "value", F.explode(F.array_distinct(pair)).alias("pair")), "value", "pair"))
        children = F.create_map(*[x for k in level for x in (F.lit(k), F.array(*[_struct(keys[c], c) for c in keys[k]["children"]]))])
        rows = keyed(dense, children[F.col("which")])
        level = [c for k in level for c in keys[k]["children"]]
    return found


def near_duplicates(docs: DataFrame, key_limit: int = KEY_LIMIT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint (hex), component_id.

    Texts within two bits of each other are linked and component_id is the smallest doc_id of a
    component. Null and wordless texts have fingerprint zero, linked like any other. Repeated rows
    stay, each with the same result; a null doc_id is kept but never names a component unless no
    other member has an id. Other columns of ``docs`` are ignored. An empty table gives no rows.
    """
    prints = cut(docs.select("doc_id", _simhash_udf("text").alias("fp")))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = cut(components(links(distinct.select("fp"), key_limit)))
    grouped = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    named = grouped.join(lowest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def mended(verified: DataFrame, failed: DataFrame, nodes: DataFrame, distance: int, similarity: float, block_nodes: int = TORN_NODES, block_shingles: int = TORN_SHINGLES) -> DataFrame:
    """Edges (a, b) with the components of all links within the distance that have the similarity.

    ``verified`` and ``failed`` are a spanning forest's links (a, b) of ``nodes`` (node, fps, s: its shingles), with
    and without the similarity. Where no failed link has its ends in different components of the verified ones,
    they are all there is. Other components are compared with those that failed links lead to: blocks of
    their nodes meet in every pair, so a task holds two blocks whatever a group's size.
    """
    pieces = cut(components(verified))
    own = lambda side: pieces.select(F.col("node").alias(side), F.col("root").alias(f"of_{side}"))
    apart = failed.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).where("a <> b").distinct()
    apart = cut(apart)
    stars = pieces.select(F.col("node").alias("a"), F.col("root").alias("b"))
    if apart.isEmpty():
        return stars
    torn = components(apart).select(F.col("node").alias("piece"), F.col("root").alias("torn"))
    members = nodes.join(pieces, "node", "left").withColumn("piece", F.coalesce("root", "node")).join(torn, "piece").select("torn", "piece", "node", "fps", "s")
    sizes = members.groupBy("torn").agg(F.greatest(F.ceil(F.count("*") / block_nodes), F.ceil(F.sum(F.size("s")) / block_shingles)).cast("int").alias("blocks"))
    placed = members.join(sizes, "torn").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least("block", other).alias("low"), F.greatest("block", other).alias("high")))
    placed = placed.select("torn", "piece", "node", "fps", "s", "block", F.explode(pair).alias("pair")).select("*", "pair.low", "pair.high").drop("pair")

    def between(group: pd.DataFrame) -> pd.DataFrame:
        own = (group["block"] == group["low"]).to_numpy()
        left = np.flatnonzero(own)
        right = left if group["low"].iloc[0] == group["high"].iloc[0] else np.flatnonzero(~own)
        found = links_between(group["piece"].to_numpy(), np.stack(group["fps"].to_numpy()).view(np.uint64), group["s"].tolist(), left, right, distance, similarity)
        release_memory()
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    more = placed.groupBy("torn", "low", "high").applyInPandas(between, "a long, b long")
    return stars.unionByName(more.distinct())


def links_between(pieces: np.ndarray, prints: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, distance: int, similarity: float) -> list[tuple[int, int]]:
    """Pairs of pieces with a link within the distance that has the similarity, as a spanning forest.

    Rows ``left`` meet rows ``right``, or each other if both are the same; a row has its piece, fingerprints (of
    all rings) and distinct shingles.
    """
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    names, places = np.unique(np.concatenate([np.asarray(s, dtype=np.int64) for s in sets]), return_inverse=True)
    has = np.zeros(len(names), bool)
    root = np.unique(pieces, return_inverse=True)[1]
    found: list[tuple[int, int]] = []
    for k, i in enumerate(left.tolist()):
        rest = left[k + 1 :] if right is left else right
        near = (np.bitwise_count(prints[rest] ^ prints[i]) <= distance).any(axis=1)
        others = rest[near & (root[rest] != root[i])]
        mine = places[ends[i] - sizes[i] : ends[i]]
        has[mine] = True
        for j in others.tolist():
            if root[j] == root[i]:
                continue
            both = np.count_nonzero(has[places[ends[j] - sizes[j] : ends[j]]])
            if both >= (sizes[i] + sizes[j] - both) * similarity:
                found.append((int(pieces[i]), int(pieces[j])))
                root[root == root[j]] = root[i]
        has[mine] = False
    return found


def similar(docs: DataFrame, shingle: int, similarity: float, rings: int, distance: int, key_limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, hash, node) and links (a, b) that connect nodes.

    hash is the text's; a node is a sequence of words. Connected are nodes by links within the
    distance in some ring whose sets of shingles have the similarity, all of them.
    """
    prints = docs.select("doc_id", F.xxhash64("text").alias("hash"), _prints_udf(shingle, rings)("text").alias("p")).select("doc_id", "hash", "p.fps", "p.digest")
    prints = cut(prints)
    nodes = prints.groupBy("digest").agg(F.first("fps").alias("fps"), F.min(F.struct("doc_id", "hash")).alias("row")).withColumn("node", F.monotonically_increasing_id())
    nodes = cut(nodes)  # numbers stay as they are from here on
    ring = Ring(distance)
    found = None
    for k in range(rings):
        part = links(nodes.select(F.col("fps")[k].alias("fp"), "node"), key_limit, ring)
        found = part if found is None else found.unionByName(part)
    candidates = cut(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    # shingles of the texts in question only
    asked = candidates.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select("node", "row.doc_id", "row.hash")
    asked = cut(asked)
    may = may_be_among(asked.select(F.xxhash64("doc_id", "hash").alias("hash")))
    texts = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text").where(may(F.xxhash64("doc_id", "hash")))
    here = asked["doc_id"].eqNullSafe(texts["doc_id"]) & (asked["hash"] == texts["hash"])
    sets = texts.join(asked, here).select("node", shingle_set(F.col("text"), shingle).alias("s")).dropDuplicates(["node"])
    sets = cut(sets)
    pairs = candidates.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    judged = cut(pairs.select("a", "b", (both >= (F.size("sa") + F.size("sb") - both) * similarity).alias("holds")))
    edges = mended(judged.where("holds").select("a", "b"), judged.where("not holds").select("a", "b"), sets.join(nodes.select("node", "fps"), "node"), distance, similarity)
    return prints.join(nodes.select("digest", "node"), "digest").select("doc_id", "hash", "node"), cut(edges)


def shingle_set(text: Column, shingle: int) -> Column:
    """Hashes of a text's distinct shingles; of fewer words the one of all; none of no word."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def of(words: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(words) - shingle + 1, F.lit(1)))
        return F.when(F.size(words) > 0, F.transform(places, lambda k: F.xxhash64(F.array_join(F.slice(words, k, F.lit(shingle)), " ")))).otherwise(F.array().cast("array<long>"))

    # as a variable, so that a text is cut into words once and not at each place
    return F.array_distinct(F.transform(F.array(F.regexp_extract_all(low, F.lit(WORD_PATTERN), F.lit(0))), of)[0])


def keep_one(docs: DataFrame, shingle: int = WIDE_SHINGLE, similarity: float = SIMILARITY, rings: int = RINGS, distance: int = WIDE_DISTANCE, key_limit: int = WIDE_LIMIT) -> DataFrame:
    """``docs`` (doc_id, text, more) without near-duplicates: of each group of linked texts one row stays.

    It is decided by row, not by id: rows of one id with unlike texts all stay. The row that stays
    has the smallest id (null ids come after all others), then the smallest hash of its text; of rows
    equal in both, the one whose other columns come first as JSON. Texts of equal words are linked, so of
    null, empty and wordless ones one row stays. No rows give no rows.
    """
    rows, edges = similar(docs, shingle, similarity, rings, distance, key_limit)
    roots = components(edges)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    grouped = rows.join(roots, "node", "left").select("doc_id", "hash", F.coalesce("root", "node").alias("root"))
    counted = grouped.groupBy("root", "doc_id", "hash").agg(F.count("*").alias("n"))
    first = counted.groupBy("root").agg(F.min(place).alias("first"))
    judged = cut(counted.join(first, "root").select("doc_id", "hash", "n", (place == F.col("first")).alias("stays")))
    # only rows that may have to go meet the decisions in a join; the texts of the others stay where they are
    suspect = may_be_among(judged.where("not stays or n > 1").select(F.xxhash64("doc_id", "hash").alias("hash")))
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"))
    own = own.withColumn("suspect", suspect(F.xxhash64("id", "mark")))
    kept = judged.where("stays")
    back = own.where("suspect").join(kept, own["id"].eqNullSafe(kept["doc_id"]) & (own["mark"] == kept["hash"]), "left_semi")
    back = back.groupBy("id", "mark").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return own.where("not suspect").select("row.*").unionByName(back.select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


__all__ = ["Ring", "fingerprint_hex", "forest", "keep_one", "links", "near_duplicates", "query", "shingle_set", "simhash"]
