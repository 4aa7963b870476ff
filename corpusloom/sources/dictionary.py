"""Dictionary tables: categories, stacks and the derived map tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORY = "id string, name string, parent_id string, aliases array<string>, summary string, related_ids array<string>"
STACK = (
    "id string, name string, category_id string, summary string, aliases array<string>, package_names array<string>, status string, "
    "related_ids array<string>, relationships array<struct<target_id:string,kind:string,label:string>>"
)


def load_dictionary(spark: SparkSession, path: str, format: str = "json") -> tuple[DataFrame, DataFrame]:
    """Category and stack tables from ``path/categories`` and ``path/stacks`` (JSON lines or Parquet)."""
    read = lambda name, schema: spark.read.schema(schema).format(format).load(f"{path}/{name}")
    return read("categories", CATEGORY), read("stacks", STACK)


def map_tree(categories: DataFrame, stacks: DataFrame) -> DataFrame:
    """Categories and stacks as one parent table: (``id``, ``parent_id``, ``kind``)."""
    return categories.select(F.concat(F.lit("category:"), "id").alias("id"), F.concat(F.lit("category:"), "parent_id").alias("parent_id"), F.lit("category").alias("kind")).unionByName(
        stacks.select(F.concat(F.lit("stack:"), "id").alias("id"), F.concat(F.lit("category:"), "category_id").alias("parent_id"), F.lit("stack").alias("kind"))
    )
