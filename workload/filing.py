"""Reading and writing files: each query writes a whole table and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.session import scratch_path
from tidemark.sources import files
from workload.tables import table


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with quotes, separators and line breaks survive; types come from the schema."""
    documents = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "documents-csv")
    files.write_csv(documents, path, sep=";")
    return files.read_csv(spark, path, sep=";", schema=documents.schema, multiline=True)


def csv_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "part-csv")
    files.write_csv(table(spark, sf_dir, "part"), path)
    return files.read_csv(spark, path)


def csv_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables written as result files, read as one with their names."""
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
    )
    folder = scratch_path(spark, "accounts")
    files.write_results({"customer": customer, "supplier": supplier}, folder)
    paths = {name: f"{folder}/{name}" for name in ("customer", "supplier")}
    return files.read_tagged(spark, paths, schemas={"customer": customer.schema, "supplier": supplier.schema})


def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "orders")
    files.write_parquet(table(spark, sf_dir, "orders"), path)
    return files.read_parquet(spark, path)


QUERIES = {
    "csv_roundtrip": csv_roundtrip,
    "csv_inferred": csv_inferred,
    "csv_tagged": csv_tagged,
    "parquet_roundtrip": parquet_roundtrip,
}

SQL = {
    "csv_roundtrip": "select * from documents",
    "csv_inferred": "select * replace (cast(p_partkey as int) as p_partkey) from part",
    "csv_tagged": """
        select c_name as name, c_acctbal as balance, c_mktsegment as segment, 'customer' as dataset from customer
        union all
        select s_name, s_acctbal, null, 'supplier' from supplier""",
    "parquet_roundtrip": "select * from orders",
}
