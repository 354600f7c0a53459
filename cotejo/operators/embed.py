"""Embedding texts with a pluggable provider, and a deterministic stand-in for tests."""

from __future__ import annotations

import signal
import threading
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cotejo.functions.text import first_text
from cotejo.operators.retrieve import valid_vector
from cotejo.session import exists

DIMENSION, BATCH = 384, 32


class EmbeddingProvider(Protocol):
    """Anything that embeds texts in batches; it is sent to the executors."""

    dimension: int

    def embed(self, texts: Sequence[str]) -> list[np.ndarray | None]:
        """A vector for each text; None where that text failed."""


def _int32(x: int) -> int:
    """The low 32 bits as a signed number."""
    return (x + 2**31) % 2**32 - 2**31


class StandIn:
    """Vectors from a hash of the text: equal texts get equal unit vectors, others unrelated ones."""

    def __init__(self, dimension: int = DIMENSION):
        self.dimension = dimension

    @staticmethod
    def seed(text: str) -> int:
        """A 32-bit shift-and-xor hash over UTF-16 units, without its sign."""
        at = 5381
        for unit in np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16).tolist():
            at = _int32(_int32(at << 5) + at) ^ unit
        return abs(at)

    def embed(self, texts: Sequence[str]) -> list[np.ndarray | None]:
        out: list[np.ndarray | None] = []
        for text in texts:
            x = np.sin(float(self.seed(text)) * np.arange(1, self.dimension + 1)) * 10_000
            vector = x - np.floor(x) - 0.5
            size = np.sqrt((vector * vector).sum())
            out.append(vector / size if size > 0 else vector)
        return out


class Listed:
    """Vectors from a dictionary by text, for tests; a text that it lacks has the zero vector."""

    def __init__(self, vectors: dict[str, Sequence[float]], dimension: int):
        self.vectors, self.dimension = vectors, dimension

    def embed(self, texts: Sequence[str]) -> list[np.ndarray | None]:
        return [np.array(self.vectors.get(t, np.zeros(self.dimension)), dtype=np.float64) for t in texts]


@contextmanager
def deadline(seconds: float | None) -> Iterator[None]:
    """Ends what runs inside with a TimeoutError after so many seconds; nothing runs on behind it.

    The alarm is the process', so there is no limit outside its main thread. Workers run Python there.
    """
    if not seconds or threading.current_thread() is not threading.main_thread():
        yield
        return

    def late(*_: object) -> None:
        raise TimeoutError(f"no answer within {seconds} s")

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


class Fallback:
    """The first provider, or the second for a batch that the first fails on or takes too long for.

    ``counts`` has the texts that each answered and the failures of the first, ``answered`` who did last.
    """

    def __init__(self, first: EmbeddingProvider, second: EmbeddingProvider, seconds: float = 2.5):
        if first.dimension != second.dimension:
            raise ValueError("providers differ in dimension")
        self.first, self.second, self.seconds, self.dimension = first, second, seconds, first.dimension
        self.counts: Counter[str] = Counter()
        self.answered = ""

    def embed(self, texts: Sequence[str]) -> list[np.ndarray | None]:
        try:
            with deadline(self.seconds):
                found = self.first.embed(texts)
            self.answered = "first"
        except Exception as failed:  # whatever a provider raises, or the time it took
            self.counts["late" if isinstance(failed, TimeoutError) else "failed"] += 1
            found, self.answered = self.second.embed(texts), "second"
        self.counts[self.answered] += len(texts)
        return found


def attempt(provider: EmbeddingProvider, texts: Sequence[str], seconds: float | None = None) -> list[tuple[np.ndarray | None, str | None, str | None]]:
    """(vector, who answered, error) of each text. A batch that fails is halved until the failing text stands alone."""
    try:
        with deadline(seconds):
            found = provider.embed(texts)
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
    except Exception as failed:  # whatever a provider raises
        if len(texts) == 1:
            return [(None, None, f"{type(failed).__name__}: {failed}"[:500])]
        half = len(texts) // 2
        return attempt(provider, texts[:half], seconds) + attempt(provider, texts[half:], seconds)
    who = getattr(provider, "answered", None) or type(provider).__name__
    good = lambda v: v is not None and len(v) == provider.dimension and bool(np.isfinite(v).all())
    return [(v, who, None) if good(v) else (None, who, "no valid vector") for v in found]


def embed(corpus: DataFrame, provider: EmbeddingProvider, batch: int = BATCH) -> DataFrame:
    """``corpus`` with embedding filled: valid ones stay, others are made from the best text of a row.

    Texts are semantic_text, else raw_text, else text, as far as there are such columns; a row
    without any text, or whose text failed, has a null embedding. Texts go to the provider in
    batches; one that fails is halved, so a failing text costs itself only.
    """
    text = first_text(*[F.col(c) for c in ("semantic_text", "raw_text", "text") if c in corpus.columns])

    def run(texts: pd.Series) -> pd.Series:
        out: list[np.ndarray | None] = [None] * len(texts)
        places = [k for k, t in enumerate(texts) if t is not None]
        for at in range(0, len(places), batch):
            some = places[at : at + batch]
            for k, (vector, _, _) in zip(some, attempt(provider, [texts.iloc[k] for k in some]), strict=True):
                out[k] = vector
        return pd.Series(out)

    # a filter on vectors must not be moved below the call: it would embed every text twice, once in the few tasks that read the table
    made = F.pandas_udf(run, T.ArrayType(T.DoubleType())).asNondeterministic()(text)
    if "embedding" not in corpus.columns:
        return corpus.withColumn("embedding", made)
    valid = valid_vector(F.col("embedding"), provider.dimension)
    todo = corpus.where(~valid).drop("embedding").withColumn("embedding", made)
    ready = corpus.where(valid).withColumn("embedding", F.col("embedding").cast("array<double>"))
    return ready.unionByName(todo.select(*ready.columns))


#: What a job keeps of each text it has tried.
_MADE = "doc_id {kind}, mark long, embedding array<double>, provider string, error string"


def _texts(corpus: DataFrame) -> DataFrame:
    text = first_text(*[F.col(c) for c in ("semantic_text", "raw_text", "text") if c in corpus.columns])
    rows = corpus.select("doc_id", text.alias("text")).where("text is not null")
    return rows.withColumn("mark", F.xxhash64("text"))


def embedding_job(corpus: DataFrame, provider: EmbeddingProvider, path: str, batch: int = BATCH, waves: int = 8, seconds: float | None = None) -> dict[str, int]:
    """Embeds the texts of ``corpus`` (doc_id, text; ids without repeats) that are not embedded yet under a path, and counts.

    The work is cut into waves by a hash of the id, and each is committed when it is done: a job
    that is stopped is run again and takes up what is missing. What is there with the same text is not
    embedded again; failed and changed texts are. Gives the texts embedded, failed and found there.
    """
    spark = corpus.sparkSession
    rows = _texts(corpus)
    kind = rows.schema["doc_id"].dataType
    schema = _MADE.format(kind=kind.simpleString())
    total = rows.count()
    todo, run = rows, uuid.uuid4().hex[:8]
    if exists(spark, path):
        todo = rows.join(_tried(spark, path, kind).where("embedding is not null").select("doc_id", "mark"), ["doc_id", "mark"], "left_anti")

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                some = frame.iloc[at : at + batch]
                made = attempt(provider, some["text"].tolist(), seconds)
                yield pd.DataFrame({"doc_id": some["doc_id"].to_numpy(), "mark": some["mark"].to_numpy(), "embedding": [v for v, _, _ in made], "provider": [w for _, w, _ in made], "error": [e for _, _, e in made]})

    counts: Counter[str] = Counter()
    for wave in range(waves):
        seen = Observation(f"wave-{run}-{wave}")
        part = todo.where(F.pmod(F.xxhash64("doc_id"), F.lit(waves)) == wave).select("doc_id", "mark", "text").mapInPandas(make, schema)
        found = part.observe(seen, F.count("embedding").alias("embedded"), F.count("error").alias("failed"), F.count_if(F.col("provider") == "second").alias("by_second"))
        # a number that rises with time, so that the newest answer to a text can be told
        found.write.parquet(f"{path}/{_stamp(spark, path):08d}-{run}")
        counts.update(seen.get)
    return {"texts": total, "there": total - counts["embedded"] - counts["failed"], **counts}


def _waves(spark: SparkSession, path: str) -> list[str]:
    """The finished waves under a path, oldest first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    names = sorted(s.getPath().getName() for s in system.listStatus(folder))
    return [n for n in names if exists(spark, f"{path}/{n}/_SUCCESS")]


def _stamp(spark: SparkSession, path: str) -> int:
    done = _waves(spark, path)
    return int(done[-1].split("-")[0]) + 1 if done else 1


def _tried(spark: SparkSession, path: str, kind: T.DataType) -> DataFrame:
    """All that was tried: (doc_id, mark, embedding, provider, error, wave)."""
    schema = _MADE.format(kind=kind.simpleString())
    names = _waves(spark, path)
    if not names:
        return spark.createDataFrame([], f"{schema}, wave string")
    read = spark.read.schema(schema).parquet(*[f"{path}/{n}" for n in names])
    return read.withColumn("wave", F.element_at(F.split(F.input_file_name(), "/"), -2))


def embedded(corpus: DataFrame, path: str) -> DataFrame:
    """(doc_id, embedding, provider) of the texts of ``corpus`` as they are now, from a job's path."""
    rows = _texts(corpus)
    tried = _tried(corpus.sparkSession, path, rows.schema["doc_id"].dataType).where("embedding is not null")
    newest = Window.partitionBy("doc_id", "mark").orderBy(F.desc("wave"))
    last = tried.withColumn("n", F.row_number().over(newest)).where("n = 1")
    return rows.select("doc_id", "mark").join(last, ["doc_id", "mark"]).select("doc_id", "embedding", "provider")
