"""Helpers shared by the operators on training data: written tables, row keys, labels of components.

Rows are told apart by a key ``rid``: the id itself where ids are unique and not null, else the
row's place in the order of id (nulls last) and text. Both orders agree, so an operator that asks
for "earlier" documents compares ``rid`` alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changefeed.session import shared_dir

# Words of a text: runs without ASCII white space. bytes.split() gives the same words.
WORD = r"[^\x20\x09-\x0D]+"


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends here."""
    path = shared_dir(df.sparkSession, f"llm-{purpose}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``rid``, doc_id, text and the columns ``keep`` of each row; null texts become empty.

    Rows with equal or null ids are numbered by a distributed sort; identical rows are
    interchangeable, so any order among them gives the same set of results.
    """
    picked = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        *[F.col(f"`{c}`") for c in keep],
    )
    ids = picked.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if not ids.take(1):
        return picked.withColumn("rid", F.col("doc_id"))
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text"), F.col("text"), *map(F.col, keep)]
    ordered = picked.repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order)
    return materialise(ordered.withColumn("rid", F.monotonically_increasing_id()), "keyed")


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in one, ``rest``, where no name of theirs can clash."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*rest) if rest else F.lit(0)).alias("rest"))


def unpacked(rows: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` from packed rows."""
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`").alias(c) for c in like.columns])


def components(links: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of undirected ``links`` (a, b): columns node, label.

    Every round takes the smallest label among neighbours and then the label of that label, so
    long chains shrink by more than half each time. Labels are written between rounds.
    """
    both = materialise(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        near = (
            both.join(labels, both.b == labels.node)
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
            .join(labels, "node")
            .select("node", F.col("label").alias("old"), F.least("label", "near").alias("at"))
        )
        up = labels.select(F.col("node").alias("at"), F.col("label").alias("above"))
        step = near.join(up, "at", "left").select("node", "old", F.least("at", F.coalesce("above", "at")).alias("label"))
        step = materialise(step, "labels")
        labels = step.select("node", "label")
        if not step.where("old <> label").take(1):
            return labels


def worker_cache(name: str) -> dict:
    """A dictionary that outlives the task in this Python worker; losing it costs time only.

    A worker serves one operator after the other, so those of other names are emptied and their memory is given back.
    """
    import ctypes
    import gc
    import sys

    caches = sys.__dict__.setdefault("_changefeed_cache", {})
    if any(other != name and kept for other, kept in caches.items()):
        for other in caches:
            if other != name:
                caches[other].clear()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not this C library
            pass
    return caches.setdefault(name, {})


class Memory(dict):
    """What a worker remembers of pieces of texts, most of which occur once: those met again are kept longest."""

    def __init__(self) -> None:
        self.again: set = set()

    def room_for(self, met: set, most: int) -> set:
        """The pieces of ``met`` that are not remembered, after making room for them."""
        new = {x for x in met if x not in self}  # a difference with keys() would walk through all that is remembered
        self.again |= met - new
        if len(self) + len(new) > most:
            kept = self.again if 2 * len(self.again) + len(new) <= most else met - new
            values = [(x, self[x]) for x in kept if x in self]
            self.clear()
            self.update(values)
            self.again = set()
        return new


class Recent(dict):
    """What a worker remembers of pieces of texts: looking up a new one learns it.

    About ``most`` are kept, in two generations: when the present one is full it becomes the past one, and only what
    is looked up again comes back from there.
    """

    def __init__(self, learn: Callable[[str], bytes], most: int) -> None:
        self.learn, self.full, self.past = learn, max(1, most // 2), {}

    def __missing__(self, x: str) -> bytes:  # _kept and put in one: most of the time of looking up goes here
        value = self.past.pop(x, None)
        if value is None:
            value = self.learn(x)
        if len(self) >= self.full:
            self.past = dict(self)
            self.clear()
        self[x] = value
        return value

    def _kept(self, x: str, learn: Callable[[str], bytes]) -> bytes:
        value = self.past.pop(x, None)
        return self.put(x, learn(x) if value is None else value)

    def put(self, x: str, value: bytes) -> bytes:
        if len(self) >= self.full:
            self.past = dict(self)
            self.clear()
        self[x] = value
        return value

    def get_or(self, x: str, learn: Callable[[str], bytes]) -> bytes:
        value = self.get(x)
        return self._kept(x, learn) if value is None else value

    def knows(self, x: str) -> bool:
        return x in self or x in self.past


def numbered(rows: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """``rows`` with their place in ``order``, from 0 without gaps, as column ``name``.

    Rows are dealt by ranges of the order and then of their places in the input, so that many rows equal in
    ``order`` do not meet in one task; which of them comes first is open. They are written once: the
    numbers of a range begin where the counts of the ranges before it, one row each, end.
    """
    keys = [*order, F.col("__tie")]
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(partitions(rows), *keys).sortWithinPartitions(*keys).drop("__tie")
    placed = materialise(dealt.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("__range", F.shiftright("__at", 33))  # the engine's id: range, then place in it
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    bases = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    place = F.col("__base") + F.col("__at").bitwiseAND((1 << 33) - 1)
    return placed.join(bases, "__range").withColumn(name, place).drop("__range", "__base", "__at")
