"""From raw documents to token ids: the corpus pipeline, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows the stage before has kept, and returns
the columns of documents; the last adds token ids. Between stages the rows are written as Parquet
in the shared folder and read again, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cotejo.llm import mixing, secrets, sentencepiece_codec, simhash, toxicity
from cotejo.llm.common import shared_dir, table
from cotejo.session import exists, remove


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go: the grammar is learned on the labelled ones, every whole text is scored.

    Null and empty texts score as texts without a match and stay; repeated rows share their fate.
    """
    return toxicity.drop_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts whose five-word shingles have a similarity of 0.8 or more one stays, the one with the smallest id.

    Decided by row: unlike texts of one id stay, null ids come last, of equal rows one stays, and of
    all null, empty or wordless texts one stays.
    """
    return simhash.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets and what belongs to them are masked; no document goes. Null and empty texts stay as they are."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand there as often as their source's target takes them.

    A null source is one of its own; null and wordless texts give no words and are not taken;
    repeated rows and ties of keys are taken alike.
    """
    return mixing.resample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds n_tokens, ids and exact; null and empty texts have no ids. Every row stays."""
    return sentencepiece_codec.encode(docs, sentencepiece_codec.load())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: No SQL: toxicity and the encoding are not expressible; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over the documents table; an empty table runs through all of them.

    A stage's rows are removed once the next stage's are written. With a folder, which must be
    shared, a run that failed goes on: of the stages finished there the last is read.
    """
    docs = table(spark, sf_dir, "documents")
    base = folder or f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    paths = [f"{base}/{number}-{name}" for number, (name, _) in enumerate(STAGES[:-1])]
    done = [number for number, path in enumerate(paths) if folder and exists(spark, f"{path}/_SUCCESS")]
    start = max(done) + 1 if done else 0
    if done:
        docs = spark.read.parquet(paths[start - 1])
    for number, (_, stage) in enumerate(STAGES[start:], start):
        docs = stage(spark, docs, sf_dir)
        if number < len(paths):
            docs.write.mode("overwrite").parquet(paths[number])
            docs = spark.read.parquet(paths[number])
            if number:
                remove(spark, paths[number - 1])
    return docs
