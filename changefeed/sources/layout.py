"""A change feed laid out by ranges of positions, so that a pull reads only what can lie after its cursors.

Changes are appended below a folder for each range of positions (the leading hex digits of the lsn). Beside them
each append leaves one small row for every feed and range: its lowest and highest position. Bounds, gaps
and first checkpoints come from those rows, and the lowest cursor of all feeds, found when the query runs, decides
which folders and row groups are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changefeed.functions.expressions import position_struct
from changefeed.operators.apply import initialise_checkpoints, retention_gaps
from changefeed.spec import Position

RANGE = "__lsn_range"


class PositionedFeed:
    """A feed of many tenants and tables below one folder.

    ``digits``: how many leading hex digits of the lsn make a range. Fewer give larger ranges: choose
    them so that a range holds some hundred megabytes. Positions are hex text of one width, or binary.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | str, keys: Sequence[str], digits: int = 18, position: Position = Position()) -> None:
        self.spark, self.root, self.keys, self.digits, self.position = spark, root.rstrip("/"), list(keys), digits, position
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _range_of(self, lsn: Column) -> Column:
        binary = isinstance(self.schema[self.position.lsn].dataType, T.BinaryType)
        return F.substring(F.hex(lsn) if binary else lsn, 1, self.digits)

    def append(self, changes: DataFrame) -> None:
        """Add changes. Each range is sorted by position, so that row groups can be skipped too."""
        p = self.position
        rows = changes.select(*self.schema.names).withColumn(RANGE, self._range_of(F.col(p.lsn)))
        laid_out = rows.repartitionByRange(p.lsn, p.seq).sortWithinPartitions(RANGE, p.lsn, p.seq)
        laid_out.write.mode("append").partitionBy(RANGE).parquet(f"{self.root}/changes")
        at = position_struct(p.lsn, p.seq)
        edges = rows.groupBy(*self.keys, RANGE).agg(F.min(p.lsn).alias("min_lsn"), F.max(at).alias("top"), F.count("*").alias("n"))
        edges.write.mode("append").parquet(f"{self.root}/edges")

    def changes(self) -> DataFrame:
        """All changes, with their range."""
        fields = [*self.schema.fields, T.StructField(RANGE, T.StringType())]
        return self.spark.read.schema(T.StructType(fields)).parquet(f"{self.root}/changes")

    def bounds(self) -> DataFrame:
        """Lowest and highest position of each feed, from the rows that the appends left."""
        edges = self.spark.read.parquet(f"{self.root}/edges").groupBy(*self.keys).agg(F.min("min_lsn").alias("min_lsn"), F.max("top").alias("top"))
        return edges.select(*self.keys, "min_lsn", F.col("top.lsn").alias("max_lsn"), F.col("top.seq").alias("max_seqval"))

    def after(self, checkpoints: DataFrame) -> DataFrame:
        """The changes that a pull from these checkpoints can need, as a superset: those from the lowest cursor on.

        A feed without a checkpoint counts from its lowest position; one that has lost changes is not pulled and does
        not count. Which changes of a feed come after its own cursor is left to ``scan_after_checkpoints``.
        """
        bounds = self.bounds()
        known = initialise_checkpoints(checkpoints, bounds, self.keys).join(bounds.select(*self.keys), self.keys, "left_semi")
        pulled = known.join(retention_gaps(known, bounds, self.keys).select(*self.keys), self.keys, "left_anti")
        lowest = pulled.agg(F.min("last_start_lsn")).scalar()
        here = (F.col(RANGE) >= self._range_of(lowest)) & (F.col(self.position.lsn) >= lowest)
        return self.changes().where(here).drop(RANGE)
