"""Applying changes to a target, and the positions that go with it.

Every function maps DataFrames to a DataFrame. A batch is reduced to one row per key by a
partial aggregate before anything is joined, so a key with very many changes never gathers
in one task. Joins carry no hints; see ``apply_changes`` for how a batch meets its target.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changefeed.functions.expressions import position_struct
from changefeed.operators.columns import stamp_metadata
from changefeed.session import shared_dir
from changefeed.spec import APPLIED_OPS, OP_DELETE, Position

def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The row with the highest ``order`` per key.

    ``max_by`` aggregates partially before the shuffle. Equal order values leave the choice
    open; add a tie-breaking column to ``order`` where that matters. Keys whose collation ignores case have
    the spelling of the chosen row.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    if not rest:
        return df.distinct()
    spelt = [k for k in keys if "collate" in df.schema[k].dataType.simpleString()]
    values = [*[F.col(c) for c in rest], *[F.col(k).alias(f"__spelt_{k}") for k in spelt]]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*values), rank).alias("__best")).select(*keys, "__best.*")
    return best.withColumns({k: F.col(f"__spelt_{k}") for k in spelt}).select(*df.columns)


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Insert rows, or on an existing key replace all its other columns.

    The batch may repeat keys only if ``order`` says which row is last.
    """
    rows = latest_per_key(batch, keys, order) if order else batch
    kept = target.join(rows.select(*keys), list(keys), "left_anti")
    return kept.unionByName(rows.select(*target.columns))


def delete_keys(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete the rows whose key occurs in the batch."""
    return target.join(batch.select(*keys), list(keys), "left_anti")


def _winners(changes: DataFrame, keys: list[str], order: Sequence[str], op: str, delete_order: str) -> DataFrame:
    """One row per key: its last change, or its delete if any delete is to win."""
    if delete_order == "last":
        return latest_per_key(changes, keys, order)
    rest = [c for c in changes.columns if c not in keys]
    rank = F.struct(*[F.col(o) for o in order])
    is_delete = F.col(op) == OP_DELETE
    found = changes.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(c) for c in rest]), F.when(~is_delete, rank)).alias("__best"),
        F.max(F.when(is_delete, F.lit(OP_DELETE))).alias("__deleted"),
    )
    spread = found.select(*keys, "__best.*", "__deleted")
    return spread.withColumn(op, F.coalesce(F.col("__deleted"), F.col(op))).drop("__deleted")


def _staged(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder: its true size, not an estimate, plans what follows."""
    path = shared_dir(df.sparkSession, "batch")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apply_changes(
    target: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    mode: str = "hard",
    order: Sequence[str] = Position().columns,
    op: str = "op_code",
    delete_order: str = "last",
    guard: bool = False,
    target_order: Sequence[str] | None = None,
    tombstone: str | None = None,
    stage: bool = False,
) -> DataFrame:
    """The target after a batch of changes.

    ``hard``: the last change of a key wins; a delete removes the row. ``soft``: every
    change is an upsert, so deletes stay as rows whose operation column says so.

    ``delete_order='any'`` instead removes every key that has a delete anywhere in the
    batch, even one inserted again later. ``guard`` ignores changes that are not newer than
    the stored row, whose position is in ``target_order``. A removed row has no position, so
    a replay that must not bring it back needs ``tombstone``: the name of a boolean column of the
    target. Deletes then stay as rows with that column true; ``live`` leaves them out and
    ``expire_tombstones`` drops old ones.

    Every batch is merged by one anti join and union: all rows of a changed key are replaced
    by one, also where the target repeats a key. ``stage`` writes the batch, reduced to a row per key, to the
    shared folder first: a small one is then planned as a broadcast by its true size, and the target is not shuffled.
    """
    if mode not in ("hard", "soft"):
        raise ValueError(f"mode must be 'hard' or 'soft', not {mode!r}")
    if delete_order not in ("last", "any"):
        raise ValueError(f"delete_order must be 'last' or 'any', not {delete_order!r}")
    keys = list(keys)
    needed = dict.fromkeys([*keys, *[c for c in target.columns if c in batch.columns], *order, op])
    changes = batch.select(*needed)
    if mode == "hard":
        changes = changes.filter(F.col(op).isin(*APPLIED_OPS))
    last = _winners(changes, keys, order, op, delete_order if mode == "hard" else "last")
    if stage:
        last = _staged(last)
    if guard:
        stored = dict(zip(target_order or order, order))
        current = target.select(*keys, *[F.col(c).alias(f"__old_{c}") for c in stored])
        incoming = last.select(*keys, *[F.col(o).alias(f"__new_{o}") for o in stored.values()])
        old = F.struct(*[F.col(f"__old_{c}").alias(f"p{i}") for i, c in enumerate(stored)])
        new = F.struct(*[F.col(f"__new_{o}").alias(f"p{i}") for i, o in enumerate(stored.values())])
        stale = current.join(incoming, keys).filter(old >= new).select(*keys)
        last = last.join(stale, keys, "left_anti")
    removes = F.col(op) == OP_DELETE if mode == "hard" else F.lit(False)
    survivors = target.join(last.select(*keys), keys, "left_anti")
    arriving = last.withColumn(tombstone, removes) if tombstone else last.filter(~removes)
    columns = [
        (F.col(c) if c in arriving.columns else F.lit(None).cast(target.schema[c].dataType)).alias(c) for c in target.columns
    ]
    return survivors.unionByName(arriving.select(*columns))


def live(target: DataFrame, tombstone: str) -> DataFrame:
    """The rows that are not deleted, without the column that says so."""
    return target.filter(~F.coalesce(F.col(tombstone), F.lit(False))).drop(tombstone)


def expire_tombstones(target: DataFrame, tombstone: str, before: Column | str, lsn: str = Position().lsn) -> DataFrame:
    """The target without deletes below a position from which nothing is delivered again."""
    return target.filter(~F.coalesce(F.col(tombstone) & (F.col(lsn) < before), F.lit(False)))


def advance_checkpoints(
    checkpoints: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    position: Position = Position(),
) -> DataFrame:
    """Checkpoints after a batch: per feed the highest of the stored and the batch's position.

    One union and one aggregate; a checkpoint without a sequence ranks below any change of
    the same lsn.
    """
    stored = checkpoints.select(*keys, position_struct("last_start_lsn", "last_seqval").alias("p"))
    pulled = batch.select(*keys, position_struct(*position.columns).alias("p"))
    top = stored.unionByName(pulled).groupBy(*keys).agg(F.max("p").alias("p"))
    return top.select(*keys, F.col("p.lsn").alias("last_start_lsn"), F.col("p.seq").alias("last_seqval"))


def initialise_checkpoints(checkpoints: DataFrame, bounds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add a checkpoint at the lowest valid position for feeds that have none."""
    fresh = bounds.join(checkpoints.select(*keys), list(keys), "left_anti")
    seq_type = checkpoints.schema["last_seqval"].dataType
    return checkpoints.select(*keys, "last_start_lsn", "last_seqval").unionByName(
        fresh.select(
            *keys, F.col("min_lsn").alias("last_start_lsn"), F.lit(None).cast(seq_type).alias("last_seqval")
        )
    )


def initial_cursor(bounds: DataFrame, checkpoints: DataFrame, keys: Sequence[str], mode: str = "beginning") -> DataFrame:
    """Where each feed starts: its checkpoint, or else its beginning or its current end."""
    if mode not in ("beginning", "current"):
        raise ValueError(f"mode must be 'beginning' or 'current', not {mode!r}")
    stored = checkpoints.select(
        *keys, F.col("last_start_lsn").alias("__lsn"), F.col("last_seqval").alias("__seq")
    )
    has = F.col("__lsn").isNotNull()
    if mode == "beginning":
        lsn, seq = F.col("min_lsn"), F.lit(None)
    else:
        lsn, seq = F.col("max_lsn"), F.col("max_seqval")
    return bounds.join(stored, list(keys), "left").select(
        *keys,
        F.coalesce("__lsn", lsn).alias("start_lsn"),
        F.when(has, F.col("__seq")).otherwise(seq).alias("seqval"),
        F.when(has, F.lit("checkpoint")).otherwise(F.lit(mode)).alias("origin"),
    )


def retention_gaps(checkpoints: DataFrame, bounds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Feeds whose checkpoint is older than what the source still keeps: changes were lost."""
    return (
        checkpoints.join(bounds, list(keys))
        .filter(F.col("last_start_lsn") < F.col("min_lsn"))
        .select(*keys, "last_start_lsn", "min_lsn")
    )


def bootstrap(
    target: DataFrame,
    snapshot: DataFrame,
    boundaries: DataFrame,
    tenant: str,
    now: Column,
    database: str = "",
    table: str = "",
) -> DataFrame:
    """Replace the slices of the tenants in ``boundaries`` by their snapshot.

    ``boundaries`` holds (tenant, start_lsn, seqval), read before the snapshot was taken;
    the rows are stamped with it, so later changes apply on top and earlier ones do not.
    """
    kept = target.join(boundaries.select(tenant), tenant, "left_anti")
    loaded = snapshot.join(boundaries, tenant)
    stamped = stamp_metadata(
        loaded, "snapshot", now, database, table, lsn=F.col("start_lsn"), seq=F.col("seqval")
    )
    columns = {
        c: (F.col(c) if c in stamped.columns else F.lit(None).cast(target.schema[c].dataType)) for c in target.columns
    }
    return kept.unionByName(stamped.select(*[v.alias(c) for c, v in columns.items()]))


def bootstrap_checkpoints(checkpoints: DataFrame, boundaries: DataFrame, tenant: str, table: str) -> DataFrame:
    """Set the checkpoints of bootstrapped tenants to their boundary, whatever they were."""
    fresh = boundaries.select(
        F.col(tenant),
        F.lit(table).alias("table_name"),
        F.col("start_lsn").alias("last_start_lsn"),
        F.col("seqval").alias("last_seqval"),
    )
    return upsert(checkpoints.select(*fresh.columns), fresh, [tenant, "table_name"])


def expire_changes(
    df: DataFrame,
    keys: Sequence[str],
    cutoff: Column,
    changed_at: str = "changed_at",
    lsn: str = "start_lsn",
    low_water: DataFrame | None = None,
) -> DataFrame:
    """Changes at or above the position each feed had reached at ``cutoff``.

    A feed with nothing that old keeps everything. ``low_water`` (keys, low_lsn) is the mark
    already in force; the new one never lies below it.
    """
    marks = df.groupBy(*keys).agg(F.max(F.when(F.col(changed_at) <= cutoff, F.col(lsn))).alias("__mark"))
    if low_water is not None:
        marks = marks.join(low_water, list(keys), "left").select(
            *keys, F.greatest("__mark", "low_lsn").alias("__mark")
        )
    marks = marks.select(*[F.col(k).alias(f"__of_{k}") for k in keys], "__mark")
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys])
    kept = df.join(marks, same).filter(F.col("__mark").isNull() | (F.col(lsn) >= F.col("__mark")))
    return kept.select(*df.columns)


def dedupe_batch(df: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Drop redelivered rows of a batch by their identity."""
    return df.dropDuplicates(list(identity))
