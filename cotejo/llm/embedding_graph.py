"""Embedding near-duplicates over a robust-pruned flat graph.

Vectors of one label are dealt to overlapping shards around pivots. In each shard every vector
gets a short, robust-pruned list of neighbours; the lists of a vector from all its shards are
united. Range-expanding greedy search then walks the united lists inside each shard, from the
shard's medoid, and from the vector itself, until no more vectors come within the range. Pruning
leaves out no neighbour within the range; a vector whose candidates are all within it may have more
than those, so it is held against its whole shard as well. What is found is verified by cosine in
double precision, and its recall is audited against brute force for every vector whose id is
divisible by 100; a recall below the target repeats the work with wider overlaps and, if it stays,
compares all vectors of a label with each other, by blocks.

Two vectors within the range share a shard: overlaps are as wide as the range at least, and the
pivot nearest to the one that is nearer to its own is then within the overlap of the other.

Equal vectors are one node with a weight, so copies cost nothing. A link is counted in the first
shard that both its ends share, so counts need no list of pairs, and a shard hands on only a
spanning forest of its links. Shards above the limit are dealt again; those that don't get
smaller, because their vectors are too much alike, are cut into blocks and every two blocks become a
shard: all links are found and no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cotejo.llm.common import components, cut, table

THRESHOLD = 0.98
#: Vectors of a shard at most; pivots of a shard that is dealt again at most; times it is dealt.
LIMIT, PIVOTS, LEVELS = 8_192, 256, 4
#: Degrees beyond its nearest pivot up to which a vector also joins others; never less than the range.
MARGIN = 6.0
#: Degrees that pivots are apart at least.
SEPARATION = 25.0
#: Neighbours kept, candidates looked at, and the factor of the robust pruning.
DEGREE, CANDIDATES, ALPHA = 24, 64, 1.2
#: Neighbours that a vector can always be reached from.
SURE = 6
#: Width of the greedy search.
WIDTH = 24
#: Audited vectors that meet all others at a time, and the least recall.
AUDITED, RECALL = 4_096, 0.9
TIMES = 3
#: What cosines may differ by when they are computed in another order.
ROUNDING = 1e-12


def flagged(vectors: DataFrame) -> DataFrame:
    """vec_id, label, mark (of equal raw values), vector (double, of length 1), able.

    A row can link unless its vector, label or id is null, or a component is null or not finite, or
    all are zero; vector is null where it can't.
    """
    fits = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    wide = F.transform("embedding", lambda x: x.cast("double"))
    # scaled by the largest component first, so that no square overflows or vanishes
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.sha2(F.col("embedding").cast("string").cast("binary"), 256).alias("mark"), F.when(fits & good, wide).alias("raw"))
    rows = rows.withColumn("top", F.array_max(F.transform("raw", F.abs)))
    rows = rows.withColumn("raw", F.when(F.col("top") > 0, F.transform("raw", lambda x: x / F.col("top"))))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x * x)))
    return rows.select("vec_id", "label", "mark", F.transform("raw", lambda x: x / F.col("norm")).alias("vector"), F.coalesce(F.col("norm") > 0, F.lit(False)).alias("able"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def _deal(margin: float):
    """Assigns rows to the pivots near them: the nearest, and all within the margin beyond it."""

    def run(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"node": np.zeros(0, np.int64), "vector": np.zeros(0, object), "shard": np.zeros(0, object)})
        centres = _matrix(pivots.sort_values(["node"])["vector"])
        angles = np.degrees(np.arccos(np.clip(_matrix(rows["vector"]) @ centres.T, -1.0, 1.0)))
        row, pivot = np.nonzero(angles <= angles.min(axis=1, keepdims=True) + margin)
        taken = rows.iloc[row]
        return pd.DataFrame({"node": taken["node"].to_numpy(), "vector": taken["vector"].to_numpy(), "shard": [f"{s}/{p}" for s, p in zip(taken["shard"], pivot, strict=True)]})

    return run


_PIVOT = T.ArrayType(T.StructType([T.StructField("node", T.LongType()), T.StructField("vector", T.ArrayType(T.DoubleType()))]))


@F.pandas_udf(_PIVOT)
def _separate(drawn: pd.Series, wanted: pd.Series) -> pd.Series:
    """Of the rows drawn for a shard, in order, up to so many that are apart from each other."""
    near = np.cos(np.radians(SEPARATION))
    out = []
    for some, most in zip(drawn, wanted, strict=True):
        kept: list[dict] = []
        centres = np.zeros((0, 0))
        for one in some:
            vector = np.asarray(one["vector"], dtype=np.float64)
            if len(kept) < most and (not kept or (centres @ vector).max() < near):
                kept.append({"node": one["node"], "vector": vector})
                centres = np.vstack([k["vector"] for k in kept])
        out.append(kept)
    return pd.Series(out)


def _shard_of_label() -> Column:
    return F.concat_ws(":", "label", F.size("vector").cast("string"))


def shards(nodes: DataFrame, limit: int = LIMIT, margin: float = MARGIN, levels: int = LEVELS) -> DataFrame:
    """(node, vector, shard): overlapping shards of at most ``limit`` rows each."""
    done = None
    open_ = nodes.select("node", "vector", _shard_of_label().alias("shard"))
    for level in range(levels + 1):
        sizes = cut(open_.groupBy("shard").agg(F.count("*").alias("n")))
        small = open_.join(sizes.where(F.col("n") <= limit).select("shard"), "shard", "left_semi").select("node", "vector", "shard")
        done = small if done is None else done.unionByName(small)
        large = sizes.where(F.col("n") > limit)
        if large.isEmpty():
            break
        crowded = open_.join(large, "shard")
        # pivots: of the rows with the smallest hashes, about four times as many as are wanted
        wanted = F.least(F.lit(PIVOTS), F.ceil(F.col("n") * 4 / limit)).cast("int")
        drawn = crowded.withColumn("draw", F.xxhash64("node", F.lit(level)).cast("double") / 2.0**64 + 0.5).where(F.col("draw") < 4.0 * wanted / F.col("n"))
        drawn = drawn.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("draw", "node", "vector"))).alias("drawn"), F.max("n").alias("n"))
        pivots = cut(drawn.select("shard", "n", _separate("drawn", wanted).alias("p")))
        split = pivots.where(F.size("p") > 1)
        # one pivot: the shard's vectors are too much alike for dealing them to help
        alike = crowded.join(split.select("shard"), "shard", "left_anti") if level < levels else crowded
        done = done.unionByName(_blocks(alike, limit).select("node", "vector", "shard"))
        if level == levels or split.isEmpty():
            break
        salts = F.ceil(F.col("n") / limit).cast("int")
        salted = split.select("shard", "p", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")).select(F.col("shard").alias("of"), F.col("salt").alias("part"), F.explode("p").alias("x")).select("of", "part", "x.node", "x.vector")
        rows = crowded.join(split.select("shard"), "shard", "left_semi").select("shard", F.pmod(F.xxhash64(F.lit("salt"), "node"), salts).cast("int").alias("salt"), "node", "vector")
        dealt = cut(rows.groupBy("shard", "salt").cogroup(salted.groupBy("of", "part")).applyInPandas(_deal(margin), "node long, vector array<double>, shard string"))
        # where overlaps leave as many comparisons as all of the shard's pairs, half at least, blocks are cheaper
        parent = F.regexp_replace("shard", "/[^/]*$", "")
        work = dealt.groupBy("shard").agg(F.count("*").alias("k")).groupBy(parent.alias("shard")).agg(F.sum(F.col("k") * F.col("k")).alias("work"))
        vain = cut(work.join(split, "shard").where(F.col("work") * 2 > F.col("n") * F.col("n")).select("shard"))
        done = done.unionByName(_blocks(crowded.join(vain, "shard", "left_semi"), limit).select("node", "vector", "shard"))
        open_ = dealt.join(vain.select(F.col("shard").alias("of")), parent == F.col("of"), "left_anti")
    return done


def _blocks(crowded: DataFrame, limit: int) -> DataFrame:
    """Every two blocks of a crowded shard as a shard of its own."""
    blocks = F.ceil(F.col("n") * 2 / limit).cast("int")
    cut_up = crowded.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.concat_ws("+", "shard", F.least("block", other).cast("string"), F.greatest("block", other).cast("string")))
    return cut_up.select("node", "vector", F.explode(F.array_distinct(pair)).alias("shard"))


def robust_neighbours(vectors: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> list[list[int]]:
    """Pruned lists: the nearest stays and rules out those that are nearer to it, by alpha, than to the vector."""
    size = len(vectors)
    lists: list[list[int]] = []
    for at in range(0, size, 512):
        block = vectors[at : at + 512] @ vectors.T
        block[np.arange(len(block)), np.arange(at, at + len(block))] = -2.0
        count = min(candidates, size - 1)
        nearest = np.argpartition(-block, count - 1, axis=1)[:, :count] if count else np.zeros((len(block), 0), int)
        for row, some in zip(block, nearest, strict=True):
            order = some[np.argsort(-row[some], kind="stable")]
            apart = 2.0 - 2.0 * row[order]
            within = 2.0 - 2.0 * (vectors[order] @ vectors[order].T)
            left = np.ones(len(order), bool)
            kept: list[int] = []
            for k in range(len(order)):
                if left[k]:
                    kept.append(int(order[k]))
                    if len(kept) == degree:
                        break
                    left &= alpha * alpha * within[k] > apart
            lists.append(kept)
    return lists


def _build(threshold: float):
    """The shard's graph, with edges in the other direction as well: those to the nearest always, else while there is room.

    ``near`` also has all of a vector's neighbours within the range, if they are fewer than the
    candidates; if they aren't, ``full`` is true.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        nodes, vectors = rows["node"].to_numpy(), _matrix(rows["vector"])
        lists = robust_neighbours(vectors)
        both: list[set[int]] = [set(x) for x in lists]
        for k, some in enumerate(lists):
            for rank, other in enumerate(some):
                if rank < SURE or len(both[other]) < 2 * DEGREE:
                    both[other].add(k)
        full = np.zeros(len(nodes), bool)
        for at in range(0, len(nodes), 512):
            close = vectors[at : at + 512] @ vectors.T >= threshold - ROUNDING
            close[np.arange(len(close)), np.arange(at, at + len(close))] = False
            full[at : at + 512] = close.sum(axis=1) >= CANDIDATES
            for k in np.flatnonzero(~full[at : at + 512]).tolist():
                both[at + k].update(np.flatnonzero(close[k]).tolist())
        return pd.DataFrame({"node": nodes, "near": [nodes[sorted(x)] for x in both], "full": full})

    return run


def range_search(start: list[int], query: np.ndarray, vectors: np.ndarray, near: list[np.ndarray], threshold: float, width: int = WIDTH) -> np.ndarray:
    """Places of all vectors found within the range of a query.

    Greedy search keeps the best ``width`` places seen and expands the best not yet expanded. Once
    it comes to rest, every place within the range is expanded too, and so on with what that finds.
    """
    seen = np.zeros(len(vectors), bool)
    places = np.unique(np.array(start))
    seen[places] = True
    score = vectors[places] @ query
    opened: set[int] = set()
    every, scores = [places], [score]

    def look(fresh: np.ndarray) -> np.ndarray:
        seen[fresh] = True
        every.append(fresh)
        scores.append(vectors[fresh] @ query)
        return scores[-1]

    pool = list(zip(score.tolist(), places.tolist(), strict=True))
    while True:
        pool.sort(reverse=True)
        del pool[width:]
        at = next((p for _, p in pool if p not in opened), None)
        if at is None:
            break
        opened.add(at)
        fresh = near[at][~seen[near[at]]]
        if len(fresh):
            pool += zip(look(fresh).tolist(), fresh.tolist(), strict=True)
    inside = np.concatenate(every)[np.concatenate(scores) >= threshold]
    edge = [p for p in inside.tolist() if p not in opened]
    while edge:
        fresh = np.unique(np.concatenate([near[p] for p in edge]))
        fresh = fresh[~seen[fresh]]
        edge = fresh[look(fresh) >= threshold].tolist()
    found = np.concatenate(every)
    return found[np.concatenate(scores) >= threshold]


def _search(threshold: float, width: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node").reset_index(drop=True)
        nodes, vectors = rows["node"].to_numpy(), _matrix(rows["vector"])
        weights, shard = rows["weight"].to_numpy(), rows["shard"].iloc[0]
        size = len(nodes)
        near = []
        for some in rows["near"]:
            some = np.asarray(some, dtype=np.int64)
            at = np.searchsorted(nodes, some)
            at, some = at[at < size], some[at < size]
            near.append(at[nodes[at] == some])
        medoid = int(np.argmax(vectors @ vectors.mean(axis=0)))
        owners = [set(x) for x in rows["shards"]]
        alone = all(len(x) == 1 for x in owners)
        linked = np.zeros((size, size), bool)
        for k in range(size):
            linked[k, range_search([medoid, k], vectors[k], vectors, near, threshold, width)] = True
        full = np.flatnonzero(rows["full"].to_numpy())
        for at in range(0, len(full), 512):
            linked[full[at : at + 512]] |= vectors[full[at : at + 512]] @ vectors.T >= threshold
        for at in range(0, size, 512):  # either end may have found it
            linked[at : at + 512] |= linked[:, at : at + 512].T
        root = np.arange(size)
        counts = np.zeros(size, np.int64)
        for k in range(size):
            linked[k, k] = True
            found = np.flatnonzero(linked[k])
            joined = np.unique(root[found])
            if len(joined) > 1:
                root[np.isin(root, joined[1:])] = joined[0]
            found = found[found != k]
            if len(found) and not alone:
                mine = owners[k]
                found = found[[shard == min(mine & owners[o]) for o in found.tolist()]]
            counts[k] = weights[found].sum()
        return pd.DataFrame({"node": nodes, "links": counts, "root": nodes[root]})

    return run


def audited_recall(nodes: DataFrame, counted: DataFrame, threshold: float = THRESHOLD, block: int = AUDITED) -> float | None:
    """Share of the links of all vectors whose id is divisible by 100, against brute force over all of their label; null if they have none.

    Equal vectors are one node here, whose copies link with each other. The vectors asked for meet
    the others in blocks, so no broadcast grows with their number.
    """
    chosen = cut(nodes.where("asked").join(counted, "node").select("node", "label", "vector", "weight", "links"))
    parts = 1 + chosen.count() // block
    every = found = 0
    for part in range(parts):
        asked = chosen.where(F.pmod(F.xxhash64("node"), F.lit(parts)) == part).collect()
        counts = nodes.select("node", "label", "vector", "weight").mapInPandas(_true_links(asked, threshold), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect() if asked else []
        truth = {r["place"]: r["n"] for r in counts}
        copies = [r["weight"] - 1 for r in asked]
        every += sum(truth.values()) + sum(copies)
        found += sum(min(truth[k], r["links"]) for k, r in enumerate(asked)) + sum(copies)
    return found / every if every else None


def _true_links(asked: list, threshold: float):
    ids, labels = np.array([r["node"] for r in asked]), np.array([r["label"] for r in asked])
    lengths, vectors = np.array([len(r["vector"]) for r in asked]), [np.array(r["vector"]) for r in asked]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(len(ids), np.int64)
        for batch in batches:
            for (label, length), whole in batch.groupby([batch["label"], batch["vector"].map(len)]):
                mine = np.flatnonzero((lengths == length) & (labels == label))
                for at in range(0, len(whole) if len(mine) else 0, 2_000):
                    part = whole.iloc[at : at + 2_000]
                    close = np.vstack([vectors[k] for k in mine]) @ _matrix(part["vector"]).T >= threshold
                    close &= ids[mine][:, None] != part["node"].to_numpy()[None, :]
                    sums[mine] += close @ part["weight"].to_numpy()
        yield pd.DataFrame({"place": np.arange(len(ids)), "n": sums})

    return run


def _searched(nodes: DataFrame, threshold: float, limit: int, margin: float, width: int) -> DataFrame:
    """(node, links, root) of each shard, by the graph."""
    members = cut(shards(nodes, limit, margin))
    united = members.groupBy("shard").applyInPandas(_build(threshold), "node long, near array<long>, full boolean").groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.max("full").alias("full"))
    return _by_shard(members, united, nodes, threshold, width)


def _compared(nodes: DataFrame, threshold: float, limit: int) -> DataFrame:
    """(node, links, root) of each two blocks of a label, every vector held against all of them."""
    whole = nodes.select("node", "vector", _shard_of_label().alias("shard"))
    members = cut(_blocks(whole.join(whole.groupBy("shard").agg(F.count("*").alias("n")), "shard"), limit).select("node", "vector", "shard"))
    every = nodes.select("node", F.array().cast("array<long>").alias("near"), F.lit(True).alias("full"))
    return _by_shard(members, every, nodes, threshold, 1)


def _by_shard(members: DataFrame, united: DataFrame, nodes: DataFrame, threshold: float, width: int) -> DataFrame:
    owners = members.groupBy("node").agg(F.collect_set("shard").alias("shards"))
    known = united.join(owners, "node").join(nodes.select("node", "weight"), "node")
    return cut(members.join(known, "node").groupBy("shard").applyInPandas(_search(threshold, width), "node long, links long, root long"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, limit: int = LIMIT, margin: float = MARGIN) -> DataFrame:
    """vec_id, n_links, component_id, kept, recall for every row of ``vectors`` (vec_id, embedding, label).

    Vectors are compared only with those of an equal label and length. A row that can't link (see
    ``flagged``) has no links and is its own component. It is rows that link, not ids: two vectors
    under one id are two, equal ones link with each other, and repeated rows count as often as they
    stand there. component_id of a null vec_id is null and it isn't kept. recall is the audited one,
    the same in all rows. An empty table gives no rows.
    """
    rows = cut(flagged(vectors))
    nodes = rows.where("able").groupBy("label", "mark").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"), F.any_value("vector").alias("vector"), F.max(F.col("vec_id") % 100 == 0).alias("asked"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))  # numbers stay as they are from here on
    width = WIDTH
    margin = max(margin, float(np.degrees(np.arccos(threshold))) + 1e-6)
    for time in range(TIMES + 1):
        searched = _searched(nodes, threshold, limit, margin, width) if time < TIMES else _compared(nodes, threshold, limit)
        counted = cut(searched.groupBy("node").agg(F.sum("links").alias("links")))
        recall = audited_recall(nodes, counted, threshold)
        if recall is None or recall >= RECALL:
            break
        margin, width = margin * 2, width * 2
    roots = components(searched.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    found = nodes.join(counted, "node").join(roots, "node", "left").select("label", "mark", "low", (F.col("links") + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    found = found.join(found.groupBy("root").agg(F.min("low").alias("component_id")), "root").drop("root", "low")
    linked = rows.where("able").join(found, ["label", "mark"]).select("vec_id", "n_links", "component_id")
    rest = rows.where("not able").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"), F.lit(recall).cast("double").alias("recall"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a
), n AS (
  SELECT a AS vec_id, count(*)::BIGINT AS n_links FROM l GROUP BY a
)
SELECT c.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept,
  CASE WHEN EXISTS (SELECT 1 FROM l WHERE a % 100 = 0) THEN 1.0::DOUBLE END AS recall
FROM c LEFT JOIN n ON c.vec_id = n.vec_id
"""
