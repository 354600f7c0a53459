"""Vector codes: product quantisation by Yinyang Lloyd, in whole numbers.

Components become integers (4096 times, rounded down), a vector is cut into equal parts, and each
part's codebook is settled by Lloyd rounds. Assigning a part to its nearest entry need not look at all
entries: those of a codebook are clustered into groups once, and every part carries an upper bound of
the distance to its entry and a lower bound a group of the distances to all others in it. When entries
move, the upper bound grows by the entry's drift and a group's lower bound shrinks by the
largest drift in it; only groups whose bound fails are scanned. Bounds are floating-point numbers with
a margin; every decision between entries, ties too, is one between whole squared distances.

A round is one pass without a shuffle over vectors and their bounds, which stay cached on the executors, and a sum of at
most entries x components numbers. The lineage of a state is narrow and at most seven passes long, so a
lost executor's share is made again from the source. What reaches the driver is the codebooks,
whose size depends on the length of vectors only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.llm.common import cut, table

#: Fixed values of the task: scale, parts of a vector, entries of a codebook, rounds; and groups of entries.
SCALE, PARTS, ENTRIES, ROUNDS, GROUPS = 4096, 8, 16, 6, 4
#: Relative and absolute margin of bounds, far above what rounding can add up to in a few rounds.
MARGIN = 1e-9
#: Shares into which the rows of a label are dealt where its sum is joined to them.
SALTS = 32


def whole(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, x): the rows whose vector has finite components only, as integers."""
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: F.coalesce((F.abs(c) < float("inf")), F.lit(False)))
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform("embedding", lambda c: F.floor(c.cast("double") * scale)).alias("x"))


@dataclass
class Codebooks:
    """Entries of every part, (parts, entries, width) of int64, with the groups they are in."""

    entries: np.ndarray
    group: np.ndarray  # (parts, entries)

    def moved(self, entries: np.ndarray) -> tuple[Codebooks, np.ndarray]:
        """The codebooks after a round, and how far each entry went."""
        return Codebooks(entries, self.group), np.sqrt(((entries - self.entries).astype(np.float64) ** 2).sum(2))

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def grouped(entries: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Each entry's group, by a few Lloyd rounds over the entries of its codebook. Any grouping gives the same codes."""
    parts, count, _ = entries.shape
    found = np.zeros((parts, count), np.int64)
    groups = min(groups, count)
    for part in range(parts if groups else 0):
        at = entries[part].astype(np.float64)
        centres = at[np.linspace(0, count - 1, groups).astype(int)]
        for _ in range(5):
            found[part] = ((at[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            centres = np.stack([at[found[part] == g].mean(0) if (found[part] == g).any() else centres[g] for g in range(groups)])
    return found


def reassign(x: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray, entries: np.ndarray, group: np.ndarray, drift: np.ndarray) -> int:
    """One part of many vectors after its entries moved by ``drift``; changes entry, upper and lower in place.

    ``x`` is (n, width), ``lower`` (n, groups). Gives the number of distances that were taken.
    """
    groups = lower.shape[1]
    upper += drift[entry]
    lower -= np.array([drift[group == g].max(initial=0.0) for g in range(groups)])
    least = lambda bound: bound * (1 + MARGIN) + MARGIN
    open_ = np.flatnonzero(lower.min(1) <= least(upper))
    if not len(open_):
        return 0
    exact = ((x[open_] - entries[entry[open_]]) ** 2).sum(1)
    upper[open_] = np.sqrt(exact)
    taken = len(open_)
    fails = lower[open_] <= least(upper[open_])[:, None]
    keep = fails.any(1)
    open_, exact, fails = open_[keep], exact[keep], fails[keep]
    old, best, best_at = entry[open_], exact.copy(), entry[open_].copy()
    scans = []
    for g in range(groups):
        rows, members = np.flatnonzero(fails[:, g]), np.flatnonzero(group == g)
        if not len(rows) or not len(members):
            continue
        squared = ((x[open_[rows], None, :] - entries[members][None]) ** 2).sum(2)
        taken += squared.size
        first = squared.argmin(1)  # the lowest index of those that are nearest
        nearest, at = squared[np.arange(len(rows)), first], members[first]
        better = (nearest < best[rows]) | ((nearest == best[rows]) & (at < best_at[rows]))
        best[rows[better]], best_at[rows[better]] = nearest[better], at[better]
        scans.append((g, rows, members, squared))
    for g, rows, members, squared in scans:
        others = np.where(members[None] == best_at[rows, None], np.iinfo(np.int64).max, squared)
        lower[open_[rows], g] = np.sqrt(others.min(1).astype(np.float64))
    changed = np.flatnonzero(best_at != old)
    left, of = open_[changed], group[old[changed]]
    lower[left, of] = np.minimum(lower[left, of], np.sqrt(exact[changed].astype(np.float64)))
    entry[open_], upper[open_] = best_at, np.sqrt(best.astype(np.float64))
    return taken


_STATE = "vec_id long, label {label}, x binary, entry binary, upper binary, lower binary, taken long"


def _started(width: int, groups: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(vec_id, label, x) to states: entry 0, and bounds that let everything be scanned once."""
    blank = [pa.scalar(a.tobytes(), pa.binary()) for a in (np.zeros(PARTS, np.int8), np.full(PARTS, np.inf), np.zeros((PARTS, groups)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            x = np.asarray(batch.column(2).flatten(), np.int64).astype(np.int32).reshape(rows, width)  # see _checked
            packed = pa.array([row.tobytes() for row in x], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), packed, *[pa.array([b.as_py()] * rows, pa.binary()) for b in blank], pa.array(np.zeros(rows, np.int64))],
                names=["vec_id", "label", "x", "entry", "upper", "lower", "taken"],
            )

    return run


def _matrix(column: pa.Array, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape).copy()


def _assigned(books: Codebooks, drift: np.ndarray, groups: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """States after the codebooks moved: the same rows, assigned anew where bounds fail."""
    width = books.entries.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), np.int32, PARTS, width).astype(np.int64)
            entry, upper, lower = _matrix(batch.column(3), np.int8, PARTS).astype(np.int64), _matrix(batch.column(4), np.float64, PARTS), _matrix(batch.column(5), np.float64, PARTS, groups)
            taken = 0
            for part in range(PARTS):
                mine = [np.ascontiguousarray(a) for a in (entry[:, part], upper[:, part], lower[:, part])]
                taken += reassign(x[:, part], *mine, books.entries[part], books.group[part], drift[part])
                entry[:, part], upper[:, part], lower[:, part] = mine
            spent = np.asarray(batch.column(6), np.int64).copy()
            if len(spent):
                spent[0] += taken  # a batch's distances stand at its first row; only their sum has a meaning
            packed = [pa.array([row.tobytes() for row in a], pa.binary()) for a in (entry.astype(np.int8), upper, lower)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *packed, pa.array(spent)], names=["vec_id", "label", "x", "entry", "upper", "lower", "taken"])

    return run


def _sums(width: int, entries: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """States to (at, total): at most parts x entries x (components and a count) rows a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, entries, width + 1), np.int64)
        for batch in batches:
            x, entry = _matrix(batch.column(0), np.int32, PARTS, width).astype(np.int64), _matrix(batch.column(1), np.int8, PARTS)
            for part in range(PARTS):
                np.add.at(total[part, :, :width], entry[:, part], x[:, part])
                total[part, :, width] += np.bincount(entry[:, part], minlength=entries)
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at], pa.int64())], names=["at", "total"])

    return run


def _coded(books: Codebooks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """States to (vec_id, label, code, error, taken)."""
    width = books.entries.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, entry = _matrix(batch.column(2), np.int32, PARTS, width).astype(np.int64), _matrix(batch.column(3), np.int8, PARTS)
            error = sum(((x[:, part] - books.entries[part][entry[:, part]]) ** 2).sum(1) for part in range(PARTS))
            code = pa.array([bytes(row.tolist()).hex() for row in entry], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), code, pa.array(np.asarray(error, np.int64)), batch.column(6)], names=["vec_id", "label", "code", "error", "taken"])

    return run


def first_entries(rows: DataFrame, count: int = ENTRIES) -> np.ndarray:
    """The parts of the ``count`` smallest vec_ids as (parts, entries, width); null ids come last, equal ids by their vectors."""
    first = rows.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(count).collect()
    return np.array([r["x"] for r in first], np.int64).reshape(len(first), PARTS, -1).transpose(1, 0, 2)


def _checked(rows: DataFrame) -> int:
    """The one length of all vectors; raises where vectors don't fit the codes."""
    size = F.size("x")
    found = rows.agg(F.min(size).alias("low"), F.max(size).alias("high"), F.max(F.array_max(F.transform("x", F.abs))).alias("most")).first()
    if found["low"] is None:
        return 0
    if found["low"] != found["high"] or found["low"] % PARTS or not found["low"]:
        raise ValueError(f"vectors of {found['low']} to {found['high']} components can't be cut into {PARTS} equal parts")
    if found["low"] * (2 * found["most"]) ** 2 >= 1 << 63:
        raise ValueError(f"components of up to {found['most'] / SCALE} are too large for whole squared distances of 64 bits")
    return found["low"]


def compress(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, groups: int = GROUPS) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code, error, taken) for each usable row of ``vectors`` (vec_id, embedding, label), and the codebooks.

    Rows whose vector is null or holds null or non-finite components are dropped; repeated rows and
    ids are rows of their own, a null id is kept, and starts a codebook only where there are too few
    others. With fewer rows than entries a codebook has as many entries as there are rows. An empty
    table gives no rows and no codebooks. Vectors must be of one length, a multiple of the
    parts; other columns are ignored, whatever their names. The sum of ``taken`` is the number of
    distances that were taken.
    """
    rows = whole(vectors)
    if not 0 < entries <= 128:
        raise ValueError("a codebook has 1 to 128 entries")
    width = _checked(rows) // PARTS
    kind = dict(rows.dtypes)["label"]
    if not width:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("taken")), None
    first = first_entries(rows, entries)
    count = first.shape[1]
    groups = min(groups, count)
    books, drift = Codebooks(first, grouped(first, groups)), np.zeros((PARTS, count))
    schema = _STATE.format(label=kind)
    state = rows.mapInArrow(_started(width * PARTS, groups), schema)
    held: DataFrame | None = None
    for number in range(rounds + 1):
        state = state.mapInArrow(_assigned(books, drift, groups), schema).persist(StorageLevel.MEMORY_AND_DISK)
        if number == rounds:
            break
        found = state.select("x", "entry").mapInArrow(_sums(width, count), "at long, total long").groupBy("at").agg(F.sum("total").alias("total")).collect()
        total = np.zeros(PARTS * count * (width + 1), np.int64)
        for row in found:
            total[row["at"]] = row["total"]
        total = total.reshape(PARTS, count, width + 1)
        used = total[:, :, width:]
        books, drift = books.moved(np.where(used > 0, total[:, :, :width] // np.maximum(used, 1), books.entries))
        if held is not None:
            held.unpersist()
        held = state
    coded = cut(state.mapInArrow(_coded(books), f"vec_id long, label {kind}, code string, error long, taken long"))
    for done in (held, state):
        if done is not None:
            done.unpersist()
    return coded, books


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error, the errors of all rows of equal label; rows without a label are together.

    Sums are dealt to shares of a label's rows, so a label that holds a third of all rows is
    not joined in one task.
    """
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = sums.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("share"))
    dealt = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return dealt.join(sums, dealt["label"].eqNullSafe(sums["of"]) & (dealt["salt"] == sums["share"])).drop("of", "salt", "share")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    digest: Column = F.lit(books.sha256() if books else hashlib.sha256(b"").hexdigest())
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def _oracle() -> str:
    """The same rounds over all entries, in whole numbers, one common table expression a step."""
    steps = [f"""
kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
parts AS MATERIALIZED (
  SELECT r, p, list_transform(embedding[p * (len(embedding) // {PARTS}) + 1:(p + 1) * (len(embedding) // {PARTS})], lambda c: CAST(floor(CAST({SCALE} * c AS DOUBLE)) AS BIGINT)) AS x
  FROM kept, range({PARTS}) AS t(p)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= {ENTRIES})"""]
    for k in range(ROUNDS + 1):
        steps.append(f"""
near{k} AS MATERIALIZED (
  SELECT r, p, min(CAST(d AS HUGEINT) * 256 + e) AS best
  FROM (SELECT r, p, e, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM parts JOIN book{k} USING (p))
  GROUP BY r, p)""")
        if k < ROUNDS:
            steps.append(f"""
sums{k} AS (
  SELECT p, e, i, CAST(sum(v) AS HUGEINT) AS s, count(*) AS n
  FROM (SELECT p, CAST(best % 256 AS INT) AS e, unnest(x) AS v, unnest(range(len(x))) AS i FROM near{k} JOIN parts USING (r, p))
  GROUP BY p, e, i),
new{k} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM sums{k} GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(w.c, b.c) AS c FROM book{k} b LEFT JOIN new{k} w USING (p, e))""")
    return f"""
WITH {','.join(steps)},
coded AS (
  SELECT r, string_agg(printf('%02x', CAST(best % 256 AS INT)), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error
  FROM near{ROUNDS} GROUP BY r),
labelled AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM coded JOIN kept USING (r) GROUP BY label)
SELECT vec_id, code, error, label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (r) JOIN labelled l ON kept.label IS NOT DISTINCT FROM l.label"""


ORACLE_SQL = _oracle()
