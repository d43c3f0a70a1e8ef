"""Database catalogs as DataFrames, and the connections that supply them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changefeed.functions.names import glob_matches, name_matches

# --- Fixed values -----------------------------------------------------------
SYSTEM_DATABASES = ("master", "tempdb", "model", "msdb", "postgres", "template0", "template1")
BASE_TABLE = "BASE TABLE"
PRIMARY_KEY = "PRIMARY KEY"
CATALOG_TABLES = "INFORMATION_SCHEMA.TABLES"
CATALOG_COLUMNS = "INFORMATION_SCHEMA.COLUMNS"
SIZED_TYPES = ("varchar", "nvarchar", "char", "nchar")
# --- End of fixed values ----------------------------------------------------


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple[object, object] | None = None,
    partitions: int = 1,
    fetch_size: int = 10_000,
    **options: str,
) -> DataFrame:
    """A table over JDBC. Give a partition column and bounds to read it in parallel."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=str(fetch_size), **options)
    if partition_column:
        if bounds is None:
            raise ValueError("a partitioned read needs the bounds of its partition column")
        reader = reader.options(
            partitionColumn=partition_column,
            lowerBound=str(bounds[0]),
            upperBound=str(bounds[1]),
            numPartitions=str(partitions),
        )
    return reader.load()


@dataclass(frozen=True)
class InventoryFilters:
    """Which databases, schemas and tables an inventory counts."""

    databases_ignored: Sequence[str] = ()
    databases_included: Sequence[str] = ()
    database_glob: str | None = None
    schemas_excluded: Sequence[str] = ()
    tables_included: Sequence[str] = ()
    tables_excluded: Sequence[str] = ()


def inventory(tables: DataFrame, filters: InventoryFilters = InventoryFilters()) -> DataFrame:
    """Databases with the number of schemas and base tables that pass the filters.

    ``tables`` has one row per table: db_name, server, schema_name, table_name, table_type.
    A database stays in the inventory with a count of 0 when all its tables are filtered.
    """
    f = filters
    db = F.col("db_name")
    databases = tables.filter(
        ~F.lower(db).isin(*SYSTEM_DATABASES)
        & ~name_matches(db, f.databases_ignored)
        & name_matches(db, f.databases_included, when_empty=True)
        & glob_matches(db, f.database_glob)
    )
    in_schema = ~name_matches("schema_name", f.schemas_excluded)
    counted = (
        in_schema
        & (F.col("table_type") == BASE_TABLE)
        & name_matches("table_name", f.tables_included, when_empty=True)
        & ~name_matches("table_name", f.tables_excluded)
    )
    return databases.groupBy("server", "db_name").agg(
        F.count_distinct(F.when(in_schema, F.col("schema_name"))).alias("schema_count"),
        F.count_if(counted).alias("table_count"),
    )


def column_catalog(columns: DataFrame, constraints: DataFrame) -> DataFrame:
    """Columns with a primary-key flag.

    ``constraints`` has one row per constrained column with ``constraint_type``; a column in
    several constraints still gives one row.
    """
    at = ["schema_name", "table_name", "column_name"]
    keys = (
        constraints.filter(F.col("constraint_type") == PRIMARY_KEY)
        .select(*at)
        .distinct()
        .withColumn("primary_key", F.lit(True))
    )
    return columns.join(keys, at, "left").withColumn("primary_key", F.coalesce("primary_key", F.lit(False)))


def foreign_keys(keys: DataFrame, key_columns: DataFrame) -> DataFrame:
    """Foreign keys with the column they constrain and the column they reference."""
    return keys.join(key_columns, "constraint_id").select(
        "table_name",
        "constraint_name",
        "column_name",
        F.concat_ws(".", "referenced_table", "referenced_column").alias("references"),
    )


def sized_type(type_name: str = "type_name", max_length: str = "max_length") -> object:
    """Character types with their length: ``nvarchar(50)``, ``varchar(MAX)``; others unchanged."""
    size = F.when(F.col(max_length) == -1, F.lit("MAX")).otherwise(F.col(max_length).cast("string"))
    sized = F.col(type_name).isin(*SIZED_TYPES) & (F.coalesce(F.col(max_length), F.lit(0)) != 0)
    return F.when(sized, F.concat(F.col(type_name), F.lit("("), size, F.lit(")"))).otherwise(F.col(type_name))
