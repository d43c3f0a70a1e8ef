"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are put in a hashed order and laid end to end, pass after pass; that
stream is cut into blocks of equal numbers of words. Slot i of the schedule has the i-th van der Corput
point, which falls into one source's part of the cumulated targets; the slots of a source are
ranked and slot of rank r takes block r of the stream. So every stretch of the
schedule holds the sources near their weights. A source's last block ends at its target; ranks that the points
left out close the schedule. Mixed documents are laid out by the slots of their first pieces.

The running sums that place documents in a stream are made in two levels (ranges of the hash,
then within), so a source with a third of all rows is never sorted in one task. Sources are
a matter of configuration: their totals, one small row each, are read by the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changefeed.llm.common import WORD, keyed, materialise, packed, partitions, unpacked

BLOCK = 4096
PASSES = 3
SLOTS_A_CHUNK = 1 << 16
ROWS_A_RANGE = 20_000
POINT_BITS = 45


def targets(sizes: list[int], weights: list[float], passes: int = PASSES) -> list[float]:
    """Shares of the total by weight, none above ``passes`` times its size; the excess is shared again."""
    total, capped = float(sum(sizes)), [s == 0 for s in sizes]
    out = [0.0] * len(sizes)
    while True:
        rest = total - sum(passes * s for s, c in zip(sizes, capped) if c)
        weight = sum(w for w, c in zip(weights, capped) if not c)
        out = [float(passes * s) if c else rest * w / weight for s, w, c in zip(sizes, weights, capped)]
        over = [not c and t > passes * s for t, s, c in zip(out, sizes, capped)]
        if not any(over):
            return out
        capped = [c or o for c, o in zip(capped, over)]


def points(slots: np.ndarray) -> np.ndarray:
    """The van der Corput sequence in base two: the digits of the number mirrored behind the point."""
    out, rest = np.zeros(len(slots)), slots.astype(np.int64)
    for bit in range(1, POINT_BITS + 1):
        out += (rest & 1) * 2.0**-bit
        rest = rest >> 1
    return out


def _sources_of(chunk: int, n_slots: int, bounds: np.ndarray) -> np.ndarray:
    slots = np.arange(chunk * SLOTS_A_CHUNK, min(n_slots, (chunk + 1) * SLOTS_A_CHUNK))
    return np.searchsorted(bounds, points(slots) * bounds[-1], side="right")


def schedule(spark, wanted: list[int], block: int = BLOCK) -> DataFrame:  # noqa: ANN001
    """slot, src, rank: the order in which the blocks of all sources are taken.

    ``wanted`` has the words of each source. Every source gets exactly the ranks that its words
    need; those that the points gave beyond that are left out, missing ones follow at the end.
    """
    blocks = np.array([-(-w // block) for w in wanted], np.int64)
    n_slots, bounds = int(blocks.sum()), np.cumsum(np.array(wanted, float))
    chunks = spark.range(0, -(-n_slots // SLOTS_A_CHUNK) if n_slots else 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk in b.column(0).to_pylist():
                n = np.bincount(_sources_of(chunk, n_slots, bounds), minlength=len(bounds))
                src = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(src), chunk)), pa.array(src), pa.array(n[src])], ["chunk", "src", "n"]
                )

    counts = materialise(chunks.mapInArrow(count, "chunk long, src long, n long"), "slots")
    before = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    by_chunk = ranked.groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("src", "before"))).alias("before"))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, pairs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                src = _sources_of(chunk, n_slots, bounds)
                order = np.argsort(src, kind="stable")
                start = np.searchsorted(src[order], np.arange(len(bounds)))
                ranks = np.empty(len(src), np.int64)
                ranks[order] = np.arange(len(src)) - start[src[order]]
                offset = np.zeros(len(bounds), np.int64)
                for s, n in pairs:
                    offset[s] = n
                ranks += offset[src]
                keep = ranks < blocks[src]
                slots = chunk * SLOTS_A_CHUNK + np.flatnonzero(keep)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slots), pa.array(src[keep]), pa.array(ranks[keep])], ["slot", "src", "rank"]
                )

    by_points = by_chunk.mapInArrow(rank, "slot long, src long, rank long")
    got = counts.groupBy("src").agg(F.sum("n").alias("got"))
    needs = spark.createDataFrame([(i, int(b)) for i, b in enumerate(blocks) if b], "src long, blocks long")
    missing = (
        needs.join(got, "src", "left")
        .select("src", F.coalesce("got", F.lit(0)).alias("got"), "blocks")
        .where("got < blocks")
        .select("src", F.explode(F.expr("sequence(got, blocks - 1)")).alias("rank"))
    )
    return by_points.union(missing.select((F.lit(n_slots) + F.col("rank")).alias("slot"), "src", "rank"))


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


class Mix:
    """What a mix takes: ``documents`` (rid, doc_id, source, size, source_size, target) and ``pieces``
    (slot, rid, pass, at, from_word, to_word); ``at`` is the piece's place in the stream of its source."""

    def __init__(self, documents: DataFrame, pieces: DataFrame) -> None:
        self.documents, self.pieces = documents, pieces


def mix(sized: DataFrame, weights=None, block: int = BLOCK, passes: int = PASSES) -> Mix:  # noqa: ANN001
    """Mix rows of ``sized`` (rid, doc_id, source, size, order) so that sources reach their targets.

    ``weights`` maps the sources in code point order, null last, to weights: 1, 2, 3, repeating, by
    default. Documents without words are never taken. No document is taken more than ``passes`` times.
    """
    spark = sized.sparkSession
    totals = sized.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["s"]) for r in totals]
    weights = [1 + i % 3 for i in range(len(totals))] if weights is None else weights([r["source"] for r in totals])
    wanted = targets(sizes, weights, passes) if sum(sizes) else [0.0] * len(sizes)
    takes = [min(passes * s, round(t)) for s, t in zip(sizes, wanted)]
    table = spark.createDataFrame(
        [(r["source"], i, s, t, k) for i, (r, s, t, k) in enumerate(zip(totals, sizes, wanted, takes))],
        "name string, src long, source_size long, target double, takes long",
    )
    bits = max(1, math.ceil(math.log2(1 + sum(r["n"] for r in totals) / ROWS_A_RANGE)))
    docs = sized.join(table, sized.source.eqNullSafe(table.name)).drop("name")
    docs = docs.withColumn("range", F.shiftrightunsigned("order", 64 - bits))
    up_to_now = Window.partitionBy("src", "range").orderBy("order", "rid").rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = docs.groupBy("src", "range").agg(F.sum("size").alias("of_range"))
    sums = sums.select("src", "range", F.coalesce(F.sum("of_range").over(ranges), F.lit(0)).alias("base"))
    placed = docs.withColumn("in_range", F.coalesce(F.sum("size").over(up_to_now), F.lit(0)))
    placed = placed.join(sums, ["src", "range"]).withColumn("start", F.col("base") + F.col("in_range"))
    spans = (
        placed.where("size > 0")
        .select("rid", "src", "size", "start", "source_size", "takes", F.explode(F.expr(f"sequence(0, {passes - 1})")).alias("pass"))
        .withColumn("low", F.col("start") + F.col("pass") * F.col("source_size"))
        .withColumn("high", F.least(F.col("low") + F.col("size"), F.col("takes")))
        .where("low < high")
        .withColumn("rank", F.explode(F.expr(f"sequence(low div {block}, (high - 1) div {block})")))
    )
    slots = schedule(spark, takes, block)
    pieces = spans.join(slots, ["src", "rank"]).select(
        "slot",
        "rid",
        "pass",
        F.greatest("low", F.col("rank") * block).alias("at"),
        (F.greatest("low", F.col("rank") * block) - F.col("low")).alias("from_word"),
        (F.least("high", (F.col("rank") + 1) * block) - F.col("low")).alias("to_word"),
    )
    return Mix(docs.select("rid", "doc_id", "source", "size", "source_size", "target"), pieces)


def sized(keyed_docs: DataFrame) -> DataFrame:
    """Size and hashed order of each keyed document (rid, doc_id, source, text), written once."""
    order = F.xxhash64("rid", "text").alias("order")
    source = F.col("source").cast("string").alias("source")
    return materialise(keyed_docs.select("rid", "doc_id", source, words(F.col("text")).alias("size"), order), "sized")


def mix_documents(docs: DataFrame, weights=None, block: int = BLOCK) -> Mix:  # noqa: ANN001
    """Mix documents (doc_id, text, source). Null texts are empty, a null source is a source of its own."""
    return mix(sized(keyed(docs, keep=("source",))), weights, block)


def mixed_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix as documents: a row for each pass that takes a document, all columns, in the order of the schedule.

    Only the last document of a source's target is cut, to its first words; every other row has its whole text.
    """
    rows = keyed(packed(docs), keep=("rest",))
    pieces = mix(sized(rows.withColumn("source", F.col("rest.source"))), block=block).pieces
    ends = (F.min("from_word").alias("from"), F.max("to_word").alias("to"), F.min("slot").alias("slot"), F.min("at").alias("at"))
    spans = pieces.groupBy("rid", "pass").agg(*ends)
    whole = (F.col("from") == 0) & (F.col("to") == words(F.col("text")))
    all_words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    part = F.array_join(F.slice(all_words, F.col("from") + 1, F.col("to") - F.col("from")), " ")
    taken_rows = rows.join(spans, "rid").withColumn("text", F.when(whole, F.col("text")).otherwise(part))
    order = ("slot", "at", "rid", "pass")
    out = unpacked(taken_rows.repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order), docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def taken(m: Mix) -> DataFrame:
    """Words that the mix takes of each document, repeats counted, and the slot of its first piece (null if none)."""
    sums = m.pieces.groupBy("rid").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"), F.min("slot").alias("first_slot"))
    return m.documents.join(sums, "rid", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
