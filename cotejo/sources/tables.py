"""Reading and writing: tables, corpora in their historic shapes, CSV and state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cotejo.functions import domain


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_quotes(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Quote rows from CSV with a header: every value as text, columns renamed, and row_idx in file order.

    A column that the file lacks is null. row_idx rises in the order of lines of one file.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).csv(path)
    named = [(F.col(f"`{old}`") if old in raw.columns else F.lit(None).cast("string")).alias(new) for old, new in columns.items()]
    return raw.select(F.monotonically_increasing_id().alias("row_idx"), *named)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A JSON corpus in any of its shapes: an array of documents, {metadata, corpus}, or that in an array."""
    raw = spark.read.option("multiLine", True).json(path)
    if "corpus" in raw.columns:
        raw = raw.where("corpus is not null").select(F.explode("corpus").alias("d")).select("d.*")
    elif "_corrupt_record" in raw.columns:
        raise ValueError(f"{path} is no JSON corpus")
    return normalize_corpus(raw)


def _field(df: DataFrame, path: str) -> Column | None:
    """A nested field if the schema has it."""
    kind: T.DataType = df.schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.fieldNames():
            return None
        kind = kind[part].dataType
    return F.col(path)


def _first(df: DataFrame, kind: str, *paths: str) -> Column:
    found = [c.cast(kind) for c in (_field(df, p) for p in paths) if c is not None]
    if kind == "string":
        found = [F.nullif(c, F.lit("")) for c in found]
    return F.coalesce(*found, F.lit(None).cast(kind))


def normalize_corpus(df: DataFrame) -> DataFrame:
    """One schema for documents of all versions: historic spellings, metrics for display, maintenance in percent."""
    display = _first(df, "double", "metrics.manutencao.display")
    unit = _first(df, "string", "metrics.manutencao.unit")
    percent = F.when(F.coalesce(unit, F.lit("fraction")) == "fraction", display * 100).otherwise(display)
    text = _first(df, "string", "text", "searchableText", "groupDescription", "descricao")
    return df.select(
        _first(df, "string", "id", "groupId", "grupo").alias("id"),
        _first(df, "string", "groupId", "grupo", "equipmentId", "id").alias("group_id"),
        _first(df, "string", "equipmentId").alias("equipment_id"),
        _first(df, "string", "title").alias("title"),
        F.coalesce(text, F.lit("")).alias("text"),
        F.coalesce(_first(df, "string", "rawText", "text"), F.lit("")).alias("raw_text"),
        _first(df, "string", "semanticText").alias("semantic_text"),
        _first(df, "string", "docCategory").alias("doc_category"),
        _first(df, "string", "docType").alias("doc_type"),
        _first(df, "string", "dominantDomain", "domain").alias("domain"),
        _first(df, "string", "brand", "marca").alias("brand"),
        _first(df, "string", "supplier", "fornecedor").alias("supplier"),
        _first(df, "double", "price", "valor_unitario", "metrics.valorUnitario.display").alias("price"),
        _first(df, "double", "lifespanMonths", "vida_util_meses", "vidaUtilMeses", "metrics.vidaUtilMeses.display").alias("life_months"),
        F.coalesce(_first(df, "double", "maintenancePercent", "manutencao_percent"), percent).alias("maintenance_percent"),
    )


def with_domain(corpus: DataFrame) -> DataFrame:
    """A corpus with its domain, as stored or else as classified, and the confidence in it."""
    found = domain.classify_document(F.col("text"), F.col("raw_text"))
    rows = corpus.withColumn("_found", found)
    return rows.withColumn("domain_confidence", F.when(F.col("domain").isNull(), F.col("_found.confidence")).otherwise(1.0)).withColumn("domain", F.coalesce("domain", "_found.category")).drop("_found")


def write_corpus(df: DataFrame, path: str) -> str:
    """Writes a new version of a corpus under the path and returns where; earlier versions stay as backup."""
    stamp = df.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string")).cast("binary"), 256)).first()[0]
    target = f"{path}/version={stamp[:16]}"
    df.write.mode("overwrite").parquet(target)
    return target


def write_csv(df: DataFrame, path: str, missing: str = "N/A") -> None:
    """CSV with a header and every value quoted; null is written as the given word."""
    text = df.select([F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(c) for c in df.columns])
    text.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


# Columns of the export of favourites.
FAVOURITES = {"Equipamento": "name", "Descrição Original": "description", "Valor Unitário (R$)": "price", "Vida Útil (meses)": "life_months", "Manutenção (%)": "maintenance", "Confiança (%)": "confidence", "Marca": "brand"}


def write_favourites(df: DataFrame, path: str) -> None:
    """Favourites as CSV for spreadsheets: a byte order mark before the header, confidence as a whole percentage."""
    texts = ("name", "description")
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("" if c in texts else "N/A"))
    percent = F.coalesce(F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("N/A"))
    columns = [(percent if c == "confidence" else cell(c)).alias(("\ufeff" if k == 0 else "") + name) for k, (name, c) in enumerate(FAVOURITES.items())]
    df.select(*columns).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def read_abbreviations(spark: SparkSession, path: str) -> dict | None:
    """A compiled dictionary from JSON; None if it is missing or broken."""
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.option("multiLine", True).json(path).first()
    except AnalysisException:
        return None
    return None if row is None or "_corrupt_record" in row else row.asDict(recursive=True)


def by_id(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.where(F.col(key) == value)


def suggestions(spark: SparkSession, text: str) -> list[str]:
    """There is no source of suggestions: always empty."""
    return []
