"""What several operators of this subpackage share: checkpoints, table access, folds, components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cotejo.session import cut, shared_dir

__all__ = ["WORD_PATTERN", "components", "cut", "fold", "may_be_among", "release_memory", "shared_dir", "table"]

#: Words in every contract of this subpackage: runs of anything but the six ASCII blanks.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, by a modulus; a null id counts as empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


#: Bits of a filter that tells what may be in a set: 2 MB at any size of the set.
FILTER_BITS = 1 << 24
_BLOCK = 1 << 15


def may_be_among(hashes: DataFrame) -> Callable[[Column], Column]:
    """A test on hashes that never misses one of ``hashes`` (column hash, long) and seldom takes another.

    The set may have any size; the more of it, the more others pass, so what passes still meets
    the set in a join, and what doesn't pass need not be shuffled.
    """
    at = F.pmod(F.col("hash"), F.lit(FILTER_BITS))
    blocks = hashes.groupBy(F.floor(at / _BLOCK).alias("block")).agg(F.bitmap_construct_agg(at % _BLOCK).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in blocks:
        start = int(row["block"]) * _BLOCK // 8
        bits[start : start + _BLOCK // 8] = np.frombuffer(bytes(row["bits"]), np.uint8)

    def run(hashes: pd.Series) -> pd.Series:
        place = hashes.to_numpy(np.int64) % FILTER_BITS
        return pd.Series((bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool))

    return F.pandas_udf(run, T.BooleanType())


def release_memory() -> None:
    """Gives back to the system what a worker has freed, since it stays for the tasks after this one."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges`` has long columns a and b. Returns (node, root) for every node that has an edge to
    another node; root is the smallest node of its component. The work of a round is linear in
    the edges, no neighbourhood is gathered in one task, and the rounds grow with the logarithm
    of a component's diameter.
    """

    def ordered(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = cut(ordered(edges))
    seen = mark(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = ordered(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        now = cut(ordered(small))
        before, seen = seen, mark(now)
        if before == seen:
            break
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    roots = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.union(now.select("v", "v").distinct())
