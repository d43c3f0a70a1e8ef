"""A keyed target kept as plain Parquet, partitioned by tenant (or route and tenant), for catalogs without MERGE.

A merge rewrites the partitions its batch touches and no other, by Spark's dynamic partition overwrite. The new
contents of those partitions are written beside the target first; only when they are complete does the
overwrite begin. A crash before leaves the target as it was, a crash after is mended by the next attempt of the same
batch, which finds the complete contents and repeats the overwrite alone. A batch that was applied before changes
nothing: changes that are not newer than the stored row are ignored, and deletes stay as flagged rows.

With a table format that has MERGE (a v2 catalog), use ``merge_into`` instead.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changefeed.operators.apply import apply_changes, live
from changefeed.plans.files import SharedFiles
from changefeed.spec import OP_DELETE, Position

DELETED = "__deleted"


class PartitionedTarget:
    """A target table: its ``schema`` holds the partition columns, the keys and the columns that order changes.

    Keys are unique within a partition. Partition columns are texts or numbers, not null.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | str, keys: Sequence[str], partition: Sequence[str]) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.partition = list(partition)
        self.keys = list(dict.fromkeys([*partition, *keys]))
        missing = [c for c in self.keys if c not in self.schema.names]
        if missing or not partition:
            raise ValueError(f"the schema lacks {missing}" if missing else "name at least one partition column")
        self.files = SharedFiles(spark, self.root)

    @property
    def path(self) -> str:
        return f"{self.root}/rows"

    def stored(self) -> DataFrame:
        """Current rows and the deletes kept beside them."""
        schema = T.StructType([*self.schema.fields, T.StructField(DELETED, T.BooleanType())])
        if not self.files.is_dir("rows"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path).select(*schema.names)

    def read(self) -> DataFrame:
        """The current rows."""
        return live(self.stored(), DELETED)

    def _within(self, parts: Sequence[Sequence[object]]) -> Column:
        """Whether a row lies in one of the partitions; literals, so other partitions are not read."""
        each = [F.col(c).isin(sorted({p[i] for p in parts})) for i, c in enumerate(self.partition)]
        if len(self.partition) == 1:
            return each[0]
        exact = F.struct(*self.partition).isin([F.struct(*[F.lit(v).cast(self.schema[c].dataType).alias(c) for c, v in zip(self.partition, p)]) for p in parts])
        return reduce(lambda a, b: a & b, each) & exact

    def parts_of(self, rows: DataFrame) -> list[tuple]:
        """The partitions that rows lie in: as many as folders will be written."""
        return [tuple(r) for r in rows.select(*self.partition).dropna().distinct().collect()]

    def _laid_out(self, rows: DataFrame):  # noqa: ANN202 - a writer
        # Rebalancing gives a partition as many files as its size calls for.
        return rows.hint("rebalance", *self.partition).write.mode("overwrite").partitionBy(*self.partition)

    def _swap(self, next_rows: str) -> None:
        schema = T.StructType([*self.schema.fields, T.StructField(DELETED, T.BooleanType())])
        ready = self.spark.read.schema(schema).parquet(f"{self.root}/{next_rows}")
        self._laid_out(ready).option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def merge(
        self,
        batch: DataFrame,
        batch_id: int | str,
        mode: str = "hard",
        order: Sequence[str] = Position().columns,
        op: str = "op_code",
        guard: bool = True,
    ) -> None:
        """Apply one batch of changes, in which rows without a partition are ignored. Repeating it is harmless.

        ``batch_id`` must not be used again for other changes while that batch may still be repeated.
        """
        ready = f"next/{batch_id}"
        if not self.files.exists(f"{ready}/_SUCCESS"):
            touched = self.parts_of(batch)
            if not touched:
                return
            current = self.stored().where(self._within(touched))
            merged = apply_changes(current, batch.dropna(subset=self.partition), self.keys, mode, order, op, guard=guard, tombstone=DELETED, stage=True)
            self._laid_out(merged).parquet(f"{self.root}/{ready}")
        self._swap(ready)

    def replace(self, rows: DataFrame, parts: Iterable[Sequence[object]], batch_id: int | str) -> int:
        """Give the partitions ``parts`` the contents ``rows``, as a snapshot load does; returns the number of rows.

        Rows of other partitions are ignored. A partition without rows is emptied. Files of other partitions are not touched.
        """
        parts, ready = [tuple(p) for p in parts], f"next/{batch_id}"
        if not parts:
            return 0
        if not self.files.exists(f"{ready}/_SUCCESS"):
            fresh = rows.where(self._within(parts)).select(*self.schema.names, F.lit(False).alias(DELETED))
            self._laid_out(fresh).parquet(f"{self.root}/{ready}")
        schema = T.StructType([*self.schema.fields, T.StructField(DELETED, T.BooleanType())])
        loaded = self.spark.read.schema(schema).parquet(f"{self.root}/{ready}")
        filled = set(self.parts_of(loaded))
        # Overwriting writes what has rows; what has none keeps its old rows as deleted ones, without a position.
        emptied = [p for p in parts if p not in filled]
        if emptied:
            gone = self.stored().where(self._within(emptied)).withColumn(DELETED, F.lit(True))
            self._laid_out(gone).parquet(f"{self.root}/{ready}-emptied")
            self._swap(f"{ready}-emptied")
        if filled:
            self._swap(ready)
        return loaded.count()

    def forget(self, batch_id: int | str) -> None:
        """Delete the contents written for a batch that will not be repeated."""
        for name in (f"next/{batch_id}", f"next/{batch_id}-emptied"):
            self.files.delete(name)


def merge_into(batch: DataFrame, table: str, keys: Sequence[str], op: str = "op_code", mode: str = "hard") -> None:
    """Apply a batch that has one row per key to a v2 table, by the catalog's own MERGE."""
    on = reduce(lambda a, b: a & b, [F.col(f"target.{k}") == F.col(f"batch.{k}") for k in keys])
    columns = [c for c in batch.columns if c != op]
    values = {c: F.col(f"batch.{c}") for c in columns}
    merge = batch.alias("batch").mergeInto(f"{table} AS target", on)
    if mode == "hard":
        removed = F.col(f"batch.{op}") == OP_DELETE
        merge = merge.whenMatched(removed).delete().whenMatched().update(values).whenNotMatched(~removed).insert(values)
    else:
        merge = merge.whenMatched().update(values).whenNotMatched().insert(values)
    merge.merge()
