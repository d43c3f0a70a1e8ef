"""Near duplicates by 64-bit fingerprints within three bits, over an index of byte positions.

A fingerprint is eight bytes at known positions. Three differing bits touch at most three of
them, so linked fingerprints share at least five positional bytes: the guaranteed count.
The lists of single bytes hold 1/256 of all fingerprints each, so the index's terms are
conjunctions of four positional bytes, chosen so that every set of five positions contains
one of them: any pair that reaches the count meets in some list. Pairs that meet are tallied (shared
positional bytes), kept from the guaranteed count on, and verified by their differing bits.

Dense groups make long lists. Members of a list longer than ``long_list`` go to finer terms instead: five
positional bytes and, in the other three, three of six half bytes (three bits touch at most three half bytes).
Those leave twelve free bits, so a list holds at most 4096 fingerprints whatever the
data. Only distinct fingerprints are indexed; copies never form pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changefeed.llm.common import components, keyed, materialise, packed, unpacked, worker_cache

SEED, SHINGLE, BITS, GUARANTEED, FREE = 42, 3, 3, 5, 1 << 16
LONG_LIST = 256


def fingerprint(text: bytes, words: int = SHINGLE) -> int:
    """Majority of the bits of all shingle hashes, as a signed 64-bit integer; 0 without words."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    size = min(words, len(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(parts) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), FREE):
        part = np.array(hashes[i : i + FREE], np.uint64).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """rid, doc_id and fp of each row of keyed documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("")
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            fps = pa.array([fingerprint(t.as_py()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("doc_id"), fps], ["rid", "doc_id", "fp"])

    return docs.select("rid", "doc_id", "text").mapInArrow(run, "rid long, doc_id long, fp long")


def covering(points: int, large: int, small: int) -> list[tuple[int, ...]]:
    """Sets of ``small`` points such that every set of ``large`` points contains one: greedy, fixed order."""
    left = set(combinations(range(points), large))
    chosen: list[tuple[int, ...]] = []
    while left:
        best = max(combinations(range(points), small), key=lambda s: sum(set(s) <= set(t) for t in left))
        chosen.append(best)
        left = {t for t in left if not set(best) <= set(t)}
    return chosen


def _mask(units: tuple[int, ...], width: int) -> int:
    unsigned = sum(((1 << width) - 1) << (width * u) for u in units)
    return unsigned - (1 << 64) if unsigned >> 63 else unsigned


def coarse_masks() -> list[int]:
    return [_mask(s, 8) for s in covering(8, GUARANTEED, 4)]


def fine_masks() -> list[int]:
    """Five whole bytes and three of the six half bytes of the others."""
    out = []
    for whole in combinations(range(8), GUARANTEED):
        halves = [h for p in range(8) if p not in whole for h in (2 * p, 2 * p + 1)]
        full = tuple(h for p in whole for h in (2 * p, 2 * p + 1))
        out += [_mask(full + three, 4) for three in combinations(halves, 3)]
    return out


def _terms(fps: DataFrame, masks: list[int]) -> DataFrame:
    values = F.transform(F.lit(masks), lambda m: F.col("fp").bitwiseAND(m))
    return fps.select("fp", F.posexplode(values).alias("which", "value"))


def shared_bytes(a: Column, b: Column) -> Column:
    """How many of the eight positional bytes two fingerprints share."""
    same = [a.bitwiseXOR(b).bitwiseAND(F.lit(_mask((p,), 8))) == 0 for p in range(8)]
    return reduce(lambda x, y: x + y, [s.cast("int") for s in same])


def _meet(terms: DataFrame) -> DataFrame:
    """Pairs that meet in a list, tallied and verified."""
    a, b = terms.alias("a"), terms.alias("b")
    x, y = F.col("a.fp"), F.col("b.fp")
    on = (
        (F.col("a.which") == F.col("b.which"))
        & (F.col("a.value") == F.col("b.value"))
        & (x < y)
        & (shared_bytes(x, y) >= GUARANTEED)
        & (F.bit_count(x.bitwiseXOR(y)) <= BITS)
    )
    return a.join(b, on).select(x.alias("a"), y.alias("b"))


def links(fps: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """All pairs (a, b) of distinct fingerprints within three bits, each once."""
    terms = materialise(_terms(fps, coarse_masks()), "terms")
    sizes = terms.groupBy("which", "value").count().where("count > 1")
    short = terms.join(sizes.where(F.col("count") <= long_list), ["which", "value"], "left_semi")
    dense = terms.join(sizes.where(F.col("count") > long_list), ["which", "value"], "left_semi").select("fp").distinct()
    fine = _terms(materialise(dense, "dense"), fine_masks())
    met = fine.groupBy("which", "value").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    fine = fine.join(met, ["which", "value"], "left_semi")
    return _meet(short).union(_meet(fine)).distinct()


def classes(keyed_docs: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """rid, doc_id, fp, component_id and component_rid of each row of keyed documents."""
    rows = materialise(fingerprints(keyed_docs), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.min("rid").alias("first_rid"))
    distinct = materialise(distinct, "distinct")
    labels = components(links(distinct.select("fp"), long_list))
    grouped = distinct.join(labels, distinct.fp == labels.node, "left").select(
        "fp", "first_id", "first_rid", F.coalesce("label", "fp").alias("class")
    )
    firsts = grouped.groupBy("class").agg(F.min("first_id").alias("component_id"), F.min("first_rid").alias("component_rid"))
    of = grouped.join(firsts, "class").select("fp", "component_id", "component_rid")
    return rows.join(of, "fp").select("rid", "doc_id", "fp", "component_id", "component_rid")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_list: int = LONG_LIST) -> DataFrame:
    """doc_id, fp and component_id (smallest non-null id of the group) of each row.

    Null texts are empty; texts without words have fingerprint zero and link like any other. A
    group without any id has a null component. Repeated rows each get a row. An empty table gives an empty result.
    """
    return classes(keyed(docs, id_col, text_col), long_list).drop("rid", "component_rid")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The first row of each group stays, null ids after all others; all columns stay."""
    rows = keyed(packed(docs), keep=("rest",))
    keep = classes(rows).where("rid = component_rid").select("rid")
    return unpacked(rows.join(keep, "rid", "left_semi"), docs)


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
