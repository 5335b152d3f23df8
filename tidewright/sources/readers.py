"""Sources with explicit schemas: tables, JSON lines, CSV with mapped columns, paged text documents, JDBC; sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.text import sniff


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jsonl(spark: SparkSession, path: str, schema: str, defaults: dict | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped, missing keys get defaults."""
    df = spark.read.schema(schema).json(path)
    return df.fillna(defaults) if defaults else df


def csv(spark: SparkSession, path: str, schema: str, mapping: dict[str, str], dates: tuple[str, ...] = ()) -> DataFrame:
    """Columns renamed by `mapping`; unreadable dates become null."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    df = df.select(*[F.col(c).alias(mapping.get(c, c)) for c in df.columns])
    return df.withColumns({d: F.try_to_date(F.col(d), "yyyy-MM-dd") for d in dates})


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, kind, page, text): whole files; text files are cut at form feeds and fall back to latin-1."""
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), sniff(F.col("content")).alias("kind"), "content")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    return files.where("kind in ('text', 'html')").select("path", "sha256", "kind", F.posexplode(F.split(text, "\f")).alias("page", "text")).withColumn("page", F.col("page") + 1)


def jdbc(spark: SparkSession, url: str, dbtable: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=dbtable, **options).load()


def append(df: DataFrame, path: str) -> None:
    """Append-only sink, as an audit log needs."""
    df.write.mode("append").parquet(path)
