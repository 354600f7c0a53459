"""A relational store through JDBC: parallel reads with pushed-down filters, and transactional upserts.

The tables are those of a search service's state: history, favourites, kits, preferences and daily
analytics. Rows are written by the executors; only statements (DDL, and the last step of an upsert) run on the driver.
A cluster that has no database server keeps the same tables as versions in its shared folder (``Shared``).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.session import one_process, remove
from cotejo.sources.versions import Versions

# The tables, their columns and keys.
ENTITIES = {
    "search_history": ("id BIGINT GENERATED BY DEFAULT AS IDENTITY PRIMARY KEY, user_id VARCHAR(255) NOT NULL, query VARCHAR(4000) NOT NULL, context_tags VARCHAR(4000), results_count INTEGER DEFAULT 0 NOT NULL, created_at TIMESTAMP DEFAULT CURRENT_TIMESTAMP", ()),
    "favorites": ("id BIGINT GENERATED BY DEFAULT AS IDENTITY PRIMARY KEY, user_id VARCHAR(255) NOT NULL, item_name VARCHAR(4000) NOT NULL, price DOUBLE, extra VARCHAR(4000), created_at TIMESTAMP DEFAULT CURRENT_TIMESTAMP", ()),
    "kit_items": ("id BIGINT GENERATED BY DEFAULT AS IDENTITY PRIMARY KEY, user_id VARCHAR(255) NOT NULL, item_name VARCHAR(4000) NOT NULL, price DOUBLE, qty INTEGER DEFAULT 1 NOT NULL, extra VARCHAR(4000), created_at TIMESTAMP DEFAULT CURRENT_TIMESTAMP", ()),
    "user_preferences": ("id BIGINT GENERATED BY DEFAULT AS IDENTITY PRIMARY KEY, user_id VARCHAR(255) NOT NULL UNIQUE, data VARCHAR(4000) NOT NULL, updated_at TIMESTAMP DEFAULT CURRENT_TIMESTAMP", ("user_id",)),
    "daily_analytics": ("id VARCHAR(64) PRIMARY KEY, date VARCHAR(10) NOT NULL UNIQUE, total_queries INTEGER DEFAULT 0 NOT NULL, zero_result_queries INTEGER DEFAULT 0 NOT NULL, avg_latency_ms DOUBLE DEFAULT 0 NOT NULL, top_terms_json VARCHAR(4000) DEFAULT '{}' NOT NULL, created_at TIMESTAMP DEFAULT CURRENT_TIMESTAMP, updated_at TIMESTAMP DEFAULT CURRENT_TIMESTAMP", ("date",)),
}
INDEXES = {"search_history": ("user_id", "created_at"), "favorites": ("user_id",), "kit_items": ("user_id",)}
DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


@dataclass(frozen=True)
class Store:
    """A database by its URL; executors must be able to reach it (an embedded one only in local mode)."""

    url: str
    properties: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def embedded(spark: SparkSession, name: str | None = None) -> Store:
        """A database in this JVM's memory, for tests and local sessions."""
        if not one_process(spark):
            raise RuntimeError("an embedded database is one for each JVM; give the URL of a server")
        return Store(f"jdbc:derby:memory:{name or uuid.uuid4().hex};create=true", {"driver": DERBY})

    @contextmanager
    def connection(self, spark: SparkSession):
        """One transaction: committed at the end, rolled back where something fails."""
        jvm = spark._jvm
        if "driver" in self.properties:
            jvm.java.lang.Class.forName(self.properties["driver"])
        known = jvm.java.util.Properties()
        for name, value in self.properties.items():
            known.setProperty(name, value)
        connection = jvm.java.sql.DriverManager.getConnection(self.url, known)
        try:
            connection.setAutoCommit(False)
            yield connection
            connection.commit()
        except BaseException:
            if not connection.isClosed():
                connection.rollback()
            raise
        finally:
            connection.close()

    def execute(self, spark: SparkSession, *statements: str) -> list[int]:
        """Runs statements in one transaction and gives the rows that each changed."""
        with self.connection(spark) as connection:
            changed = []
            for text in statements:
                statement = connection.createStatement()
                changed.append(statement.executeUpdate(text))
                statement.close()
            return changed

    def tables(self, spark: SparkSession) -> set[str]:
        with self.connection(spark) as connection:
            found, names = connection.getMetaData().getTables(None, None, "%", None), set()
            while found.next():
                names.add(found.getString("TABLE_NAME").lower())
            return names

    def create(self, spark: SparkSession) -> None:
        """Makes the tables and indexes that are not there yet."""
        there = self.tables(spark)
        for name, (columns, _) in ENTITIES.items():
            if name not in there:
                self.execute(spark, f"CREATE TABLE {name} ({columns})", *[f"CREATE INDEX {name}_{c} ON {name} ({c})" for c in INDEXES.get(name, ())])

    def read(self, spark: SparkSession, name: str, by: str | None = None, partitions: int = 8) -> DataFrame:
        """A table; with a numeric column to cut it by, in so many parallel parts. Filters and columns are pushed down."""
        options: dict = {"properties": self.properties}
        if by is not None:
            low, high = spark.read.jdbc(self.url, f"(SELECT MIN({by}) AS low, MAX({by}) AS high FROM {name}) AS bounds", properties=self.properties).first()
            if low is not None:
                options |= {"column": by, "lowerBound": int(low), "upperBound": int(high) + 1, "numPartitions": partitions}
        rows = spark.read.jdbc(self.url, name, **options)
        return rows.toDF(*map(str.lower, rows.columns))  # as they are written here, whatever the database makes of them

    def append(self, df: DataFrame, name: str) -> None:
        """Adds rows; columns that ``df`` lacks get their defaults."""
        df.write.option("batchsize", 5_000).jdbc(self.url, name, mode="append", properties=self.properties)

    def upsert(self, df: DataFrame, name: str, keys: Sequence[str] = ()) -> None:
        """Rows of ``df`` take the place of those with the same keys, and others are added, all at once.

        Executors write to a staging table first, and one transaction updates and inserts from it, so readers
        see the old rows until all new ones are in. Keys that the stage holds twice, also those of a task that ran
        twice, are an error, and nothing changes. Keys are the table's own unless others are given.
        """
        spark = df.sparkSession
        keys = tuple(keys) or ENTITIES[name][1]
        if not keys:
            raise ValueError(f"{name} has no key to upsert by")
        stage = f"stage_{uuid.uuid4().hex[:16]}"
        columns = ", ".join(df.columns)
        self.execute(spark, f"CREATE TABLE {stage} AS SELECT {columns} FROM {name} WITH NO DATA")
        try:
            self.append(df, stage)
            match = " AND ".join(f"{name}.{k} = s.{k}" for k in keys)
            others = [c for c in df.columns if c not in keys]
            assign = [f"{c} = (SELECT s.{c} FROM {stage} s WHERE {match})" for c in others]
            if "updated_at TIMESTAMP" in ENTITIES.get(name, ("",))[0] and "updated_at" not in df.columns:
                assign.append("updated_at = CURRENT_TIMESTAMP")
            with self.connection(spark) as connection:
                statement = connection.createStatement()
                result = statement.executeQuery(f"SELECT COUNT(*) FROM (SELECT {', '.join(keys)} FROM {stage} GROUP BY {', '.join(keys)} HAVING COUNT(*) > 1) AS twice")
                result.next()
                if result.getInt(1):
                    raise ValueError(f"rows to upsert into {name} hold keys twice")
                if assign:
                    statement.executeUpdate(f"UPDATE {name} SET {', '.join(assign)} WHERE EXISTS (SELECT 1 FROM {stage} s WHERE {match})")
                statement.executeUpdate(f"INSERT INTO {name} ({columns}) SELECT {columns} FROM {stage} s WHERE NOT EXISTS (SELECT 1 FROM {name} WHERE {match})")
                statement.close()
        finally:
            self.execute(spark, f"DROP TABLE {stage}")


#: Spark's types for those of the tables.
_KINDS = {"BIGINT": "long", "INTEGER": "int", "DOUBLE": "double", "TIMESTAMP": "timestamp"}


class Shared:
    """The same tables without a database server: each a versioned table in a folder that all executors share.

    A change writes the next version by executors and moves the pointer last, so readers see the old rows until all
    new ones are in, and nothing changes where it fails. There is one writer at a time. Types, lengths,
    defaults, generated ids and NOT NULL are those of the tables; of unique columns the upsert's keys are checked.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _columns(self, name: str) -> dict[str, str]:
        return dict(c.split(" ", 1) for c in ENTITIES[name][0].split(", "))

    def _versions(self, name: str) -> Versions:
        return Versions(self.spark, f"{self.path}/{name}")

    def create(self, spark: SparkSession) -> None:
        """Makes the tables that are not there yet, without rows."""
        for name in ENTITIES:
            if self._versions(name).current() is None:
                columns = ", ".join(f"{c} {_KINDS.get(d.split(' ')[0], 'string')}" for c, d in self._columns(name).items())
                self._versions(name).write(spark.createDataFrame([], columns))

    def read(self, spark: SparkSession, name: str, by: str | None = None, partitions: int = 8) -> DataFrame:
        """A table; it is read in parallel parts as it is, so ``by`` and ``partitions`` have no effect."""
        return self._versions(name).read()

    def _cast(self, name: str, column: str, value: Column) -> Column:
        """A value as its column takes it; an error where it is too long, or missing and must not be."""
        define = self._columns(name)[column]
        kind = define.split(" ")[0]
        value = value.cast(_KINDS.get(kind, "string"))
        if kind.startswith("VARCHAR"):
            most = int(kind[len("VARCHAR(") : -1])
            value = F.when(F.length(value) > most, F.raise_error(F.lit(f"a value is too long for {name}.{column}"))).otherwise(value)
        if "NOT NULL" in define or "PRIMARY KEY" in define:
            value = F.coalesce(value, F.raise_error(F.lit(f"{name}.{column} must not be null")).cast(_KINDS.get(kind, "string")))
        return value

    def _default(self, name: str, column: str) -> Column:
        define = self._columns(name)[column]
        text = define.partition("DEFAULT ")[2].removesuffix(" NOT NULL")
        if "CURRENT_TIMESTAMP" in text:
            return F.current_timestamp()
        if not text or "IDENTITY" in text:
            return F.lit(None)
        return F.lit(text.strip("'"))

    def _next_id(self, name: str) -> int | None:
        """The first generated id that is free; None where ids are not generated."""
        if "IDENTITY" not in self._columns(name)["id"]:
            return None
        return (self.read(self.spark, name).agg(F.max("id")).first()[0] or 0) + 1

    def _changed(self, name: str, rows: DataFrame) -> None:
        self._versions(name).write(rows)
        self._versions(name).prune(2)  # a reader of the version before goes on

    def _rows(self, df: DataFrame, name: str) -> DataFrame:
        """Whole rows of the table, with defaults and ids."""
        start = self._next_id(name)
        made = {c: F.col(c) if c in df.columns else self._default(name, c) for c in self._columns(name)}
        if start is not None and "id" not in df.columns:
            made["id"] = F.monotonically_increasing_id() + start
        return df.select(*[self._cast(name, c, v).alias(c) for c, v in made.items()])

    def append(self, df: DataFrame, name: str) -> None:
        """Adds rows; columns that ``df`` lacks get their defaults."""
        self._changed(name, self.read(self.spark, name).unionByName(self._rows(df, name)))

    def upsert(self, df: DataFrame, name: str, keys: Sequence[str] = ()) -> None:
        """Rows of ``df`` take the place of those with the same keys, and others are added, all at once, as in ``Store``."""
        keys = tuple(keys) or ENTITIES[name][1]
        if not keys:
            raise ValueError(f"{name} has no key to upsert by")
        columns = list(self._columns(name))
        stage = f"{self.path}/stage-{uuid.uuid4().hex[:16]}"
        self._rows(df, name).write.parquet(stage)
        try:
            fresh = self.spark.read.parquet(stage)
            if not fresh.groupBy(*keys).count().where("count > 1").isEmpty():
                raise ValueError(f"rows to upsert into {name} hold keys twice")
            given = [c for c in columns if c in df.columns or c == "updated_at"]
            both = self.read(self.spark, name).select(*keys, F.struct(*columns).alias("old")).join(fresh.select(*keys, F.struct(*columns).alias("new")), list(keys), "full")
            there, comes = F.col("old").isNotNull(), F.col("new").isNotNull()
            chosen = [F.when(comes & (F.lit(c in given) | ~there), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in columns]
            self._changed(name, both.select(*chosen))
        finally:
            remove(self.spark, stage)
